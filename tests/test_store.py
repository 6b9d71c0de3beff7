"""Roll-ups that are kept between runs."""

from __future__ import annotations

import glob
import os
import re
from datetime import date

import pytest
from pyspark.sql import functions as F
from retail_rows import by_key, rows

from aislewise.operators.channels import ORDER_TIME, RAW_STAMP_TIME, WEBLOG_TIME, day_of
from aislewise.plans import categories, funnel, hours, products
from aislewise.plans.registry import REPORTS
from aislewise.plans.store import RollupStore
from aislewise.sources.relations import RetailTables
from aislewise.sources.variants import stored_rollups


def log_line(day, path, status=200):
    return f'1.2.3.4 - - [{day}:23:30:13 -0400] "GET {path} HTTP/1.1" {status} 1063 "-" "UA"'


CART = "/department/golf/category/balls/product/ball/add_to_cart"


@pytest.fixture
def logs(tmp_path):
    """Writes log files, one for each name."""
    folder = tmp_path / "logs"
    folder.mkdir()

    def write(name, *lines):
        (folder / name).write_text("".join(line + "\n" for line in lines))
        return str(folder)

    return write


def views(store):
    return by_key(store.web().groupBy("pageType").agg(F.sum("hits").alias("n")), "pageType", "n")


def test_only_new_files_are_counted(spark, logs, tmp_path):
    store = RollupStore(spark, str(tmp_path / "store"), buckets=2)
    folder = logs("a.log", log_line("14/Jun/2014", CART), log_line("14/Jun/2014", "/home"))
    assert store.update(logs=[folder]) == {"logs": 1}
    assert store.update(logs=[folder]) == {"logs": 0}
    logs("b.log", log_line("15/Jun/2014", CART))
    # A file that is counted is not opened again: its text may be gone, as long as it is as long as before.
    (tmp_path / "logs" / "a.log").write_text("x" * (tmp_path / "logs" / "a.log").stat().st_size)
    again = RollupStore(spark, str(tmp_path / "store"))
    assert again.update(logs=[folder]) == {"logs": 1}
    assert views(again) == {"add_to_cart": (2,), "home": (1,)} and again.buckets == 2
    assert sorted(rows(again.files(), "batch", "relation")) == [(1, "logs"), (2, "logs")]


def test_a_counted_file_that_changes_is_an_error(spark, logs, tmp_path):
    store = RollupStore(spark, str(tmp_path / "store"))
    folder = logs("a.log", log_line("14/Jun/2014", CART))
    store.update(logs=[folder])
    logs("a.log", log_line("14/Jun/2014", CART), log_line("14/Jun/2014", CART))
    logs("b.log", log_line("14/Jun/2014", CART))
    with pytest.raises(ValueError, match="a.log"):
        store.update(logs=[folder])
    assert views(store) == {"add_to_cart": (1,)}


def test_a_batch_that_was_not_finished_is_made_anew(spark, logs, tmp_path, monkeypatch):
    store = RollupStore(spark, str(tmp_path / "store"))
    folder = logs("a.log", log_line("14/Jun/2014", CART))
    store.update(logs=[folder])
    logs("b.log", log_line("15/Jun/2014", CART), log_line("16/Jun/2014", CART))
    whole = RollupStore._write_batch

    def stopped(self, relation, batch, rollup):
        whole(self, relation, batch, rollup)
        raise KeyboardInterrupt

    monkeypatch.setattr(RollupStore, "_write_batch", stopped)
    with pytest.raises(KeyboardInterrupt):
        store.update(logs=[folder])
    monkeypatch.undo()
    assert views(store) == {"add_to_cart": (1,)}
    assert store.update(logs=[folder]) == {"logs": 1}
    assert views(store) == {"add_to_cart": (3,)}


def test_days_prune_files(spark, logs, tmp_path):
    store = RollupStore(spark, str(tmp_path / "store"))
    days = [f"{n:02}/Jun/2014" for n in range(1, 11)]
    folder = logs("a.log", *[log_line(day, CART) for day in days], log_line("nothing", "/home"))
    store.update(logs=[folder])
    logs("b.log", log_line("03/Jun/2014", "/home"))
    store.update(logs=[folder])
    some = store.web(date(2014, 6, 3), date(2014, 6, 4))
    assert rows(some.agg(F.sum("hits"))) == [(3,)]
    read = some.select(F.input_file_name().alias("f")).distinct().collect()
    assert len(read) == 3 and all(re.search(r"day=2014-06-0[34]/", row.f) for row in read)
    scan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "day#" in scan[scan.index("PartitionFilters") :].split("]")[0]
    # An event of no day is in the whole only.
    assert rows(store.web().agg(F.sum("hits"))) == [(12,)]
    assert rows(hours.peak_hours(RetailTables({"weblog": store.web, "orders": lambda: no_orders(spark)}))) != []


def no_orders(spark):
    return spark.createDataFrame([], "order_id string, order_date string, customer_id string, order_status string")


def test_rows_of_a_page_type_lie_together(spark, logs, tmp_path):
    store = RollupStore(spark, str(tmp_path / "store"))
    lines = [log_line("14/Jun/2014", f"/department/d/category/c{n % 7}/product/p{n}") for n in range(50)]
    lines += [log_line("14/Jun/2014", f"/department/d{n}") for n in range(50)]
    store.update(logs=[logs("a.log", *lines)])
    for file in glob.glob(f"{tmp_path}/store/logs/batch=1/day=2014-06-14/*.parquet"):
        found = rows(spark.read.parquet(file), "pageType", "category")
        assert found == sorted(found)


def test_the_star_climb_of_stored_sales_has_no_exchange(spark, sf_dir):
    """From the scans up to the sum by category nothing is dealt out: buckets meet buckets."""
    settings = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in settings:
        spark.conf.set(key, "-1")
    try:
        tables = stored_rollups(spark, sf_dir)
        from aislewise.operators.channels import _sales_by_category_id

        frame = _sales_by_category_id(tables.order_items, tables.products)
        plan = frame._jdf.queryExecution().executedPlan().toString()
        lines = plan.splitlines()
        first = next(i for i, text in enumerate(lines) if "Exchange" in text)
        assert "hashpartitioning(cat_id" in lines[first]
        assert not any("Exchange" in text for text in lines[first + 1 :])
        assert plan.count("SelectedBucketsCount: 8 out of 8") == 2
        names = REPORTS["product_presence"].build(tables)
        assert len(rows(names)) > 0
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_every_report_is_that_of_the_facts(spark, sf_dir, storefront):
    stored = stored_rollups(spark, sf_dir)
    for name in ("category_presence_sales", "catalog_coverage", "funnel_by_category", "product_rank_gap", "dept_efficiency"):
        report = REPORTS[name].build
        assert sorted(rows(report(stored)), key=repr) == sorted(rows(report(storefront)), key=repr)
    assert rows(categories.channel_share_top5(stored)) == rows(categories.channel_share_top5(storefront))
    assert rows(funnel.funnel_total(stored)) == rows(funnel.funnel_total(storefront))
    assert rows(products.product_presence_summary(stored)) == rows(products.product_presence_summary(storefront))


def test_csv_order_items_and_new_products(spark, tmp_path):
    store = RollupStore(spark, str(tmp_path / "store"), buckets=3)
    (tmp_path / "items").mkdir()
    (tmp_path / "items" / "a.csv").write_text("1,1,7,2,10.10,5.05\n2,1,8,x,,1\n")
    schema = "product_id string, cat_id string, product_name string"
    store.update(order_items=[str(tmp_path / "items")], products=spark.createDataFrame([("7", "1", "ball")], schema))
    (tmp_path / "items" / "b.csv").write_text("3,2,7,1,0.20,0.20\n,2,7,1,0.20,0.20\n")
    more = spark.createDataFrame([("7", "1", "ball"), ("8", "1", "club")], schema)
    store.update(order_items=[str(tmp_path / "items")], products=more)
    found = by_key(store.sales(), "product_id", "order_rows", "order_lines", "quantity", "revenue")
    assert {k: (*v[:3], None if v[3] is None else float(v[3])) for k, v in found.items()} == {
        "7": (3, 2, 4, 10.5),
        "8": (1, 1, None, None),
    }
    assert sorted(rows(store.products(), "product_id")) == [("7",), ("8",)]


def test_an_empty_store(spark, tmp_path):
    store = RollupStore(spark, str(tmp_path / "store"))
    assert store.files().count() == 0 and store.update() == {}
    with pytest.raises(KeyError, match="logs"):
        store.web()
    (tmp_path / "none").mkdir()
    assert store.update(logs=[str(tmp_path / "none")]) == {"logs": 0}
    with pytest.raises(ValueError, match="read times"):
        RollupStore(spark, str(tmp_path / "store"), time_format=RAW_STAMP_TIME)
    assert os.listdir(tmp_path / "store") == ["settings"]


@pytest.mark.parametrize(
    ("text", "time_format", "day"),
    [
        ("14/Jun/2014 23:30:13", WEBLOG_TIME, date(2014, 6, 14)),
        ("1/JUN/2014 1:2:3 x", WEBLOG_TIME, date(2014, 6, 1)),
        ("31/Jun/2014 23:30:13", WEBLOG_TIME, None),
        ("14/Jun/2014", WEBLOG_TIME, None),
        ("2013-07-25 00:00:00.0", ORDER_TIME, date(2013, 7, 25)),
        ("2013-7-5 0:0:0", ORDER_TIME, date(2013, 7, 5)),
        ("2012-02-29 10:00:00", ORDER_TIME, date(2012, 2, 29)),
        ("2013-02-29 10:00:00", ORDER_TIME, None),
        ("14/Jun/2014:23:30:13 +0000", RAW_STAMP_TIME, date(2014, 6, 14)),
        (None, WEBLOG_TIME, None),
        ("", ORDER_TIME, None),
    ],
)
def test_days(spark, text, time_format, day):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(day_of(F.col("t"), time_format)).first()[0] == day


def test_command_line(spark, logs, tmp_path, capsys):
    from aislewise.__main__ import main

    store, data = str(tmp_path / "store"), tmp_path / "data"
    data.mkdir()
    (data / "items.csv").write_text("1,1,7,2,10.10,5.05\n")
    (data / "products.csv").write_text("7,1,ball,,10,\n")
    (data / "categories.csv").write_text("1,1,balls\n")
    folder = logs("a.log", log_line("14/Jun/2014", CART), log_line("16/Jun/2014", CART))
    more = ["--order-items", str(data / "items.csv"), "--products", str(data / "products.csv"), "--buckets", "2"]
    main(["update", store, "--logs", folder, *more])
    main(["update", store, "--logs", folder])
    assert "logs: 1 new files" in capsys.readouterr().out
    out = ["--only", "product_presence", "funnel_total", "--single-files", "--store", store]
    main(["reports", str(data), str(tmp_path / "all"), *out])
    main(["reports", str(data), str(tmp_path / "some"), *out, "--first-day", "2014-06-15"])
    for name, adds in (("all", 2), ("some", 1)):
        (file,) = glob.glob(f"{tmp_path}/{name}/analysis3b_product_presence/*.csv")
        with open(file) as found:
            assert found.read().splitlines()[1].startswith(f"ball,{adds},1,2,")
