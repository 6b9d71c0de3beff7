"""Roll-ups that are kept between runs: each run reads the files that are new, and reports read the roll-ups.

A store is a folder.  ``files`` lists the source files that are counted, each with its batch; every batch is a
partition of the roll-ups, so a file is counted once and nothing that is counted is read again.  Sums add up
over batches, whatever files they are made of.

* The web roll-up lies by batch and day, rows of a page type and category together: a report over some days
  reads the files of these days only.
* The sales roll-up and the products lie in the same number of buckets by product id, sorted.  Their join and
  the sum over batches need no exchange, and a hot product is one row a batch.

A batch counts once its files are listed.  A run that stops before that leaves a batch that no report reads,
and the next run overwrites it.  One run at a time may update a store.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aislewise.operators.channels import WEBLOG_TIME, marked_rollup
from aislewise.operators.rollups import merged_sales, sales_activity, web_activity
from aislewise.operators.weblog import parse_access_log
from aislewise.sources.readers import read_access_log, read_relation, read_table
from aislewise.sources.relations import RetailTables

LOGS, ORDER_ITEMS, PRODUCTS = "logs", "order_items", "products"
_FILES = "relation string, path string, length long, batch int"
_KEY = "product_id"


class RollupStore:
    """Roll-ups below ``folder``; ``buckets`` and ``time_format`` count when the store is made, and stay."""

    def __init__(
        self, spark: SparkSession, folder: str, buckets: int = 64, time_format: str = WEBLOG_TIME
    ) -> None:
        self._spark = spark
        self._folder = folder.rstrip("/")
        self._prefix = "store_" + hashlib.md5(self._folder.encode()).hexdigest()[:16]
        found = self._read("settings")
        if found is None:
            settings = spark.createDataFrame([(buckets, time_format)], "buckets int, time_format string")
            settings.coalesce(1).write.parquet(self._path("settings"))
            self.buckets, self.time_format = buckets, time_format
        else:
            self.buckets, self.time_format = found.first()
            if time_format != self.time_format:
                raise ValueError(f"the store has read times as {self.time_format!r}, not as {time_format!r}")

    def _path(self, name: str) -> str:
        return f"{self._folder}/{name}"

    def _read(self, name: str) -> DataFrame | None:
        try:
            return self._spark.read.parquet(self._path(name))
        except AnalysisException as missing:
            # Nothing is there yet, or only what a run left that wrote no row.
            if missing.getCondition() not in {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}:
                raise
            return None

    def files(self) -> DataFrame:
        """relation, path, length, batch of every source file that is counted."""
        found = self._read("files")
        return self._spark.createDataFrame([], _FILES) if found is None else found

    def update(
        self,
        logs: Sequence[str] = (),
        order_items: Sequence[str] = (),
        products: DataFrame | None = None,
        columnar: bool = False,
    ) -> dict[str, int]:
        """Count the new files below the paths, and say how many there were of each relation.

        ``order_items`` are CSV, or Parquet if ``columnar``; ``products`` replace those stored.  A file that
        is shorter or longer than when it was counted is an error, and nothing is counted then.
        """
        given = {LOGS: list(logs), ORDER_ITEMS: list(order_items)}
        new = {relation: self._new_files(relation, paths) for relation, paths in given.items() if paths}
        for relation, files in new.items():
            if not files:
                continue
            batch = 1 + self._last_batch(relation)
            paths = [path for path, _ in files]
            rollup = self._log_rollup(paths) if relation == LOGS else self._sales_rollup(paths, columnar)
            self._write_batch(relation, batch, rollup)
            listed = self._spark.createDataFrame([(relation, *file, batch) for file in files], _FILES)
            listed.coalesce(1).write.mode("append").parquet(self._path("files"))
        if products is not None:
            self._write_products(products)
        return {relation: len(files) for relation, files in new.items()}

    def _new_files(self, relation: str, paths: list[str]) -> list[tuple[str, int]]:
        """Files not counted yet; only their names and lengths are read."""
        present = self._spark.read.format("binaryFile").load(paths).select("path", "length")
        known = self.files().where(F.col("relation") == relation).select("path", F.col("length").alias("counted"))
        found = present.where("length > 0").join(known, "path", "left")
        changed = found.where("counted <> length").select("path").take(3)
        if changed:
            raise ValueError(f"counted files have changed: {[row.path for row in changed]}")
        return [(row.path, row.length) for row in found.where("counted IS NULL").orderBy("path").collect()]

    def _last_batch(self, relation: str) -> int:
        return self.files().where(F.col("relation") == relation).agg(F.max("batch")).first()[0] or 0

    def _log_rollup(self, paths: list[str]) -> DataFrame:
        weblog = parse_access_log(read_access_log(self._spark, paths))
        return web_activity(weblog, self.time_format, by_day=True)

    def _sales_rollup(self, paths: list[str], columnar: bool) -> DataFrame:
        read = read_table if columnar else read_relation
        return sales_activity(read(self._spark, paths, ORDER_ITEMS))

    def _write_batch(self, relation: str, batch: int, rollup: DataFrame) -> None:
        """The batch's partitions, in place of those that an earlier run may have left."""
        rollup = rollup.withColumn("batch", F.lit(batch))
        if relation == LOGS:
            # Days are dealt out, and a day's rows of one page type and category lie together.
            rows = rollup.repartition("day", "pageType").sortWithinPartitions("day", "pageType", "category", "product")
            partitions = ["batch", "day"]
        else:
            rows = rollup.repartition(self.buckets, _KEY)
            partitions = ["batch"]
        path, files = self._on_disk(f"{relation}/batch={batch}")
        files.delete(path, True)
        table = self._table(relation, rollup.schema, partitions)
        columns = [name for name in rollup.columns if name not in partitions]
        rows.select(*columns, *partitions).write.mode("append").insertInto(table)

    def _write_products(self, products: DataFrame) -> None:
        table = self._table(PRODUCTS, products.schema, [])
        products.repartition(self.buckets, _KEY).write.mode("overwrite").insertInto(table)

    def _table(self, name: str, schema: T.StructType, partitions: list[str]) -> str:
        """The catalog's table over a folder of the store: buckets are known to the catalog only."""
        table = f"{self._prefix}_{name}"
        columns = [field for field in schema if field.name not in partitions]
        columns += [schema[partition] for partition in partitions]
        listed = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in columns)
        options = f"PARTITIONED BY ({', '.join(partitions)})" if partitions else ""
        if name != LOGS:
            options += f" CLUSTERED BY ({_KEY}) SORTED BY ({_KEY}) INTO {self.buckets} BUCKETS"
        self._spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._spark.sql(f"CREATE TABLE {table} ({listed}) USING parquet {options} LOCATION '{self._path(name)}'")
        path, files = self._on_disk(name)
        if partitions and files.exists(path):
            self._spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
        return table

    def _on_disk(self, name: str) -> tuple:
        """A path of the store, and the file system that has it."""
        path = self._spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
        return path, path.getFileSystem(self._spark._jsc.hadoopConfiguration())

    def _opened(self, name: str, partitions: list[str]) -> DataFrame:
        found = self._read(name)
        if found is None:
            raise KeyError(f"the store has no {name}")
        table = self._spark.table(self._table(name, found.schema, partitions))
        if partitions:
            table = table.where(F.col("batch") <= self._last_batch(name))
        return table

    def web(self, first_day: date | None = None, last_day: date | None = None) -> DataFrame:
        """The web roll-up, of all days or of some; events whose time names no day are of no day."""
        rows = self._opened(LOGS, ["batch", "day"])
        if first_day is not None:
            rows = rows.where(F.col("day") >= F.lit(first_day))
        if last_day is not None:
            rows = rows.where(F.col("day") <= F.lit(last_day))
        # A table of the catalog has lost the mark that its files have.
        return rows.withColumn("hits", marked_rollup(F.col("hits"), "hits", self.time_format)).drop("batch", "day")

    def sales(self) -> DataFrame:
        """The sales roll-up: one row a product, over all batches."""
        return merged_sales(self._opened(ORDER_ITEMS, ["batch"]).drop("batch"))

    def products(self) -> DataFrame:
        return self._opened(PRODUCTS, [])

    def tables(
        self, others: RetailTables, first_day: date | None = None, last_day: date | None = None
    ) -> RetailTables:
        """The relations for reports: what the store has in place of the facts, and all others as given."""
        replaced = {"weblog": self.web(first_day, last_day), "order_items": self.sales()}
        if self._read(PRODUCTS) is not None:
            replaced["products"] = self.products()
        return others.replaced(**replaced)
