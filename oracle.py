"""SQL answers to the queries, for DuckDB over the same parquet tables.

They are written from the meaning of the reports, with plain joins, window totals and
RANK(), and share nothing with the Spark code.  Ratios are doubles; a value is rounded
as a decimal so that halves go up as they do in Spark.
"""

from __future__ import annotations


def _r2(value: str) -> str:
    return f"CAST(ROUND(CAST({value} AS DECIMAL(38,8)), 2) AS DOUBLE)"


# --- fixed values -----------------------------------------------------------
# The four request patterns; labels and output names below are fixed as well.
_PRODUCT = r"""([^ ]*) - - \[([^]]*)] "[^ ]* /department/([^/]*)/category/([^/]*)/product/([^ ]*) HTTP[^ ]* (\d{3})"""
_CATEGORY = r"""([^ ]*) - - \[([^]]*)] "[^ ]* /department/([^/]*)/category/([^ ]*) HTTP[^ ]* (\d{3})"""
_DEPARTMENT = r"""([^ ]*) - - \[([^]]*)] "[^ ]* /department/([^ ]*) HTTP[^ ]* (\d{3})"""
_PAGE = r"""([^ ]*) - - \[([^]]*)] "[^ ]* /([^ /]*) HTTP[^ ]* (\d{3})"""

# ----------------------------------------------------------------------------


def _group(kind_groups: dict[str, tuple[str, int]]) -> str:
    """CASE that takes a regex group, which one depending on the matched kind."""
    arms = " ".join(
        f"WHEN kind = '{kind}' THEN regexp_extract(value, '{pattern}', {group})"
        for kind, (pattern, group) in kind_groups.items()
    )
    return f"CASE {arms} ELSE '' END"


def _decoded(text: str) -> str:
    return f"url_decode(replace({text}, '+', ' '))"


_KIND = f"""CASE WHEN regexp_matches(value, '{_PRODUCT}') THEN 'product'
                 WHEN regexp_matches(value, '{_CATEGORY}') THEN 'category'
                 WHEN regexp_matches(value, '{_DEPARTMENT}') THEN 'department'
                 WHEN regexp_matches(value, '{_PAGE}') THEN 'page' END"""
_IP = _group({k: (p, 1) for k, p in
              (("product", _PRODUCT), ("category", _CATEGORY), ("department", _DEPARTMENT), ("page", _PAGE))})
_STAMP = _IP.replace(", 1)", ", 2)")
_STATUS = _group({"product": (_PRODUCT, 6), "category": (_CATEGORY, 5), "department": (_DEPARTMENT, 4),
                  "page": (_PAGE, 4)})
_DEPT = _decoded(_group({"product": (_PRODUCT, 3), "category": (_CATEGORY, 3), "department": (_DEPARTMENT, 3)}))
_CAT = _decoded(_group({"product": (_PRODUCT, 4), "category": (_CATEGORY, 4)}))
_PROD = _decoded(_group({"product": (_PRODUCT, 5)}))
_PAGE_NAME = _group({"page": (_PAGE, 3)})

_STORE = """
catalog AS (
  SELECT p_partkey AS product_id, p_type AS dept_id, p_retailprice AS price,
         concat(p_type, '|', p_brand) AS cat_id,
         CASE WHEN CAST(split_part(p_brand, '#', 2) AS INTEGER) % 5 = 0 THEN replace(p_brand, '#', '/')
              ELSE concat(p_type, ' ', p_brand) END AS cat_name,
         concat(p_name, ' ', p_brand, CASE WHEN p_partkey % 7 = 0 THEN '+' ELSE '' END) AS product_name
  FROM part),
departments AS (SELECT DISTINCT dept_id, dept_id AS dept_name FROM catalog),
categories AS (SELECT DISTINCT cat_id, dept_id, cat_name FROM catalog),
products AS (SELECT product_id, cat_id, product_name, price FROM catalog),
order_items AS (
  SELECT l_orderkey AS item_id, l_partkey AS product_id, CAST(trunc(l_quantity) AS INTEGER) AS quantity,
         l_extendedprice AS subtotal
  FROM lineitem)"""

_WEB = f"""
visited AS (
  SELECT e.event_id, e.ts, e.user_id, e.event_type, c.dept_id, c.cat_name, c.product_name
  FROM events e LEFT JOIN catalog c ON CAST(regexp_extract(e.props, '([0-9]+)', 1) AS BIGINT) = c.product_id),
paths AS (
  SELECT *, replace(replace(concat('/department/', dept_id), '#', '%23'), ' ', '%20') AS dept_path,
         replace(replace(concat('/category/', cat_name), '#', '%23'), ' ', '%20') AS cat_path,
         replace(replace(concat('/product/', product_name), '#', '%23'), ' ', '%20') AS prod_path
  FROM visited),
weblog_raw AS (
  SELECT concat('10.', (user_id >> 16) % 256, '.', (user_id >> 8) % 256, '.', user_id % 256,
                ' - - [', strftime(ts, '%d/%b/%Y:%H:%M:%S'), ' +0000] "GET ',
                CASE event_type
                  WHEN 'view' THEN concat(dept_path, cat_path, prod_path)
                  WHEN 'error' THEN concat(dept_path, cat_path, prod_path)
                  WHEN 'purchase' THEN concat(dept_path, cat_path, prod_path, '/add_to_cart')
                  WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN concat(dept_path, cat_path) ELSE dept_path END
                  ELSE CASE event_id % 3 WHEN 0 THEN '/view_cart' WHEN 1 THEN '/checkout' ELSE '/home' END
                END,
                ' HTTP/1.1" ', CASE WHEN event_type = 'error' THEN '500' ELSE '200' END,
                ' 1063 "-" "Mozilla/5.0"') AS value
  FROM paths WHERE dept_id IS NOT NULL OR event_type = 'signup'),
kinds AS (SELECT value, {_KIND} AS kind FROM weblog_raw),
pieces AS (
  SELECT kind, {_IP} AS ip, {_STAMP} AS stamp, {_DEPT} AS dept, {_CAT} AS category, {_PROD} AS raw_product,
         {_PAGE_NAME} AS page, {_STATUS} AS status
  FROM kinds WHERE kind IS NOT NULL),
weblog AS (
  SELECT ip,
         concat(split_part(stamp, ':', 1), ' ', split_part(stamp, ':', 2), ':', split_part(stamp, ':', 3), ':',
                split_part(split_part(stamp, ':', 4), ' ', 1)) AS datetime,
         dept, category,
         CASE WHEN suffix(raw_product, '/add_to_cart') THEN replace(raw_product, '/add_to_cart', '')
              ELSE raw_product END AS product,
         CASE WHEN kind <> 'product' THEN CASE kind WHEN 'page' THEN page ELSE kind END
              WHEN suffix(raw_product, '/add_to_cart') THEN 'add_to_cart' ELSE 'product' END AS pageType,
         status AS respCode
  FROM pieces WHERE status = '200')"""

_LINES_COUNTED = f""",
untidy AS (
  SELECT CASE length(value) % 7 WHEN 0 THEN replace(value, ' HTTP/', ' FTP/')
                                WHEN 1 THEN concat('proxy ', value) ELSE value END AS value
  FROM weblog_raw),
untidy_kinds AS (SELECT value, {_KIND} AS kind FROM untidy),
met AS (SELECT value, kind, CASE WHEN kind IS NOT NULL THEN {_STATUS} END AS status FROM untidy_kinds),
lines AS (
  SELECT 'log' AS source, unnest([
    {{'counter': 'lines', 'lines': count(*)}},
    {{'counter': 'product', 'lines': count(*) FILTER (kind = 'product')}},
    {{'counter': 'category', 'lines': count(*) FILTER (kind = 'category')}},
    {{'counter': 'department', 'lines': count(*) FILTER (kind = 'department')}},
    {{'counter': 'page', 'lines': count(*) FILTER (kind = 'page')}},
    {{'counter': 'unmatched', 'lines': count(*) FILTER (kind IS NULL)}},
    {{'counter': 'other_status', 'lines': count(*) FILTER (status <> '200')}},
    {{'counter': 'cut_directly', 'lines': count(*) FILTER (kind IS NOT NULL AND NOT starts_with(value, 'proxy '))}}]) AS count
  FROM met
  UNION ALL
  SELECT 'products', unnest([
    {{'counter': 'lines', 'lines': count(*)}},
    {{'counter': 'too_short', 'lines': count(*) FILTER (p_partkey % 6 IN (1, 3, 5))}},
    {{'counter': 'other_width', 'lines': count(*) FILTER (p_partkey % 6 IN (2, 4))}}])
  FROM part)
SELECT source, count.counter AS counter, count.lines AS lines FROM lines"""

_CATEGORY_PAGES = "pageType IN ('add_to_cart', 'product', 'category') AND category IS NOT NULL AND category <> ''"
_CART_ADDS = "pageType = 'add_to_cart' AND product IS NOT NULL AND product <> ''"
_KEY = "lower(trim({}))".format

_WEB_CATEGORIES = f"""
web AS (SELECT {_KEY('category')} AS name, count(*) AS cnt FROM weblog WHERE {_CATEGORY_PAGES} GROUP BY 1)"""
_SOLD_CATEGORIES = f"""
store AS (
  SELECT {_KEY('c.cat_name')} AS name, count(*) AS cnt
  FROM order_items oi JOIN products p ON oi.product_id = p.product_id JOIN categories c ON p.cat_id = c.cat_id
  GROUP BY 1)"""
_CATALOG_CATEGORIES = f"""
store AS (SELECT DISTINCT {_KEY('cat_name')} AS name FROM categories)"""


def _presence(both: str, web_only: str, store_only: str, web: str = "w.name", store: str = "s.name") -> str:
    return (f"CASE WHEN {web} IS NOT NULL AND {store} IS NOT NULL THEN '{both}' "
            f"WHEN {web} IS NOT NULL THEN '{web_only}' ELSE '{store_only}' END")


_SALES = _presence("Both (Web & Store)", "Web Only", "Store Only")
_CATALOG = _presence("Both (Web & Catalog)", "Web Only", "Catalog Only (no web traffic)")
_PRODUCTS = _presence("Both (Web & Store)", "Web Only (abandoned)", "Store Only")
_OUTER = "FROM web w FULL OUTER JOIN store s ON w.name = s.name"

_WORDS = "list_transform(string_split({}, ' '), lambda w: concat(upper(w[1:1]), w[2:]))".format


def _title(text: str) -> str:
    return f"array_to_string({_WORDS(text)}, ' ')"


_FRAGMENTS_CUT = """CASE WHEN contains(category, '/product') THEN split_part(category, '/product', 1)
                        ELSE split_part(category, '/add_to_cart', 1) END"""

_WEB_PRODUCTS = f"""
web AS (SELECT {_KEY('product')} AS name, count(*) AS adds FROM weblog WHERE {_CART_ADDS} GROUP BY 1)"""
_SOLD_PRODUCTS = f"""
store AS (
  SELECT {_KEY('p.product_name')} AS name, count(oi.item_id) AS lines, CAST(sum(oi.quantity) AS BIGINT) AS qty,
         avg(oi.quantity) AS avg_qty, sum(oi.subtotal) AS revenue
  FROM order_items oi JOIN products p ON oi.product_id = p.product_id
  GROUP BY 1)"""
_RANKED = """
web_ranked AS (SELECT *, RANK() OVER (ORDER BY adds DESC) AS place FROM web),
store_ranked AS (SELECT *, RANK() OVER (ORDER BY qty DESC) AS place FROM store)"""
_RANKED_OUTER = "FROM web_ranked w FULL OUTER JOIN store_ranked s ON w.name = s.name"

_WEB_SHARE = "COALESCE(w.cnt * CAST(100 AS DOUBLE) / (SELECT sum(cnt) FROM web), 0)"
_STORE_SHARE = "COALESCE(s.cnt * CAST(100 AS DOUBLE) / (SELECT sum(cnt) FROM store), 0)"

_DEPARTMENTS = f"""
web AS (
  SELECT {_KEY('dept')} AS name, count(*) AS cnt, count(*) FILTER (WHERE pageType = 'add_to_cart') AS adds
  FROM weblog WHERE dept IS NOT NULL AND dept <> '' GROUP BY 1),
store AS (
  SELECT {_KEY('d.dept_name')} AS name, CAST(sum(oi.quantity) AS BIGINT) AS qty, sum(oi.subtotal) AS exact_revenue,
         {_r2('sum(oi.subtotal)')} AS revenue
  FROM order_items oi JOIN products p ON oi.product_id = p.product_id
  JOIN categories c ON p.cat_id = c.cat_id JOIN departments d ON c.dept_id = d.dept_id
  GROUP BY 1)"""
_REVENUE_SHARE = "COALESCE(s.revenue * 100 / (SELECT sum(exact_revenue) FROM store), 0)"

_FUNNEL = f"""
funnel AS (
  SELECT {_KEY('category')} AS category, pageType FROM weblog
  WHERE pageType IN ('product', 'view_cart', 'checkout', 'add_to_cart') AND respCode = '200'
    AND category IS NOT NULL AND category <> '')"""


def _pages(page: str) -> str:
    return f"count(*) FILTER (WHERE pageType = '{page}')"


def _page_rate(reached: str, started: str) -> str:
    return _r2(f"{_pages(reached)} * CAST(100 AS DOUBLE) / NULLIF({_pages(started)}, 0)")


def _tiers(cuts: tuple[int, ...], names_once: bool = False) -> str:
    floors = (0, *cuts)
    arms = " ".join(
        f"WHEN price < {cut} THEN '{tier}. ${floors[tier - 1]}-${cut}'" for tier, cut in enumerate(cuts, 1)
    )
    adds = "sum(w.adds)"
    if names_once:
        adds = (f"(SELECT sum(a.adds) FROM (SELECT DISTINCT i.price_range, {_KEY('i.product_name')} AS name "
                "FROM ranges i) n JOIN web a ON a.name = n.name WHERE n.price_range = r.price_range)")
    return f"""
ranges AS (
  SELECT product_id, product_name, price, CASE {arms} ELSE '{len(floors)}. ${floors[-1]}+' END AS price_range
  FROM products WHERE price IS NOT NULL),
web AS (
  SELECT {_KEY('product')} AS name, count(*) AS adds FROM weblog WHERE pageType = 'add_to_cart' GROUP BY 1),
store AS (SELECT product_id, sum(quantity) AS qty FROM order_items GROUP BY product_id),
tiers AS (
  SELECT r.price_range, {_r2('avg(r.price)')} AS avg_price, count(DISTINCT w.name) AS web_unique_products,
         CAST(COALESCE({adds}, 0) AS BIGINT) AS web_cart_adds,
         count(DISTINCT s.product_id) AS store_unique_products,
         CAST(COALESCE(sum(s.qty), 0) AS BIGINT) AS store_qty_sold
  FROM ranges r LEFT JOIN web w ON {_KEY('r.product_name')} = w.name
  LEFT JOIN store s ON r.product_id = s.product_id
  GROUP BY r.price_range)"""


_UNIT_RATE = _r2("CAST(web_cart_adds AS DOUBLE) / NULLIF(store_qty_sold, 0)")
_TIER_REPORT = f"""
SELECT *, {_UNIT_RATE} AS web_events_per_unit FROM tiers"""


def _hours(time_format: str) -> str:
    return f"""
order_rows AS (SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS order_date FROM orders),
web AS (
  SELECT CAST(hour(try_strptime(datetime, '{time_format}')) AS INTEGER) AS h, count(*) AS cnt,
         count(*) FILTER (WHERE pageType = 'add_to_cart') AS adds
  FROM weblog WHERE datetime IS NOT NULL GROUP BY 1),
placed AS (
  SELECT CAST(hour(try_strptime(order_date, '%Y-%m-%d %H:%M:%S')) AS INTEGER) AS h, count(*) AS cnt
  FROM order_rows WHERE order_date IS NOT NULL GROUP BY 1)"""


_HOUR_REPORT = """
SELECT COALESCE(w.h, o.h) AS hour_of_day, COALESCE(w.cnt, 0) AS web_events, COALESCE(w.adds, 0) AS web_cart_adds,
       COALESCE(o.cnt, 0) AS store_orders, COALESCE(o.cnt, 0) - COALESCE(w.adds, 0) AS order_vs_cart_gap
FROM web w FULL OUTER JOIN placed o ON w.h = o.h"""
_HOUR_PEAKS = """
SELECT (SELECT h FROM web ORDER BY cnt DESC, h NULLS LAST LIMIT 1) AS peak_web_hour,
       (SELECT h FROM web ORDER BY adds DESC, h NULLS LAST LIMIT 1) AS peak_cart_add_hour,
       (SELECT h FROM placed ORDER BY cnt DESC, h NULLS LAST LIMIT 1) AS peak_order_hour"""
_READABLE_TIME, _LITERAL_TIME = "%d/%b/%Y %H:%M:%S", "%d/%b/%Y:%H:%M:%S %z"


def _with(*parts: str) -> str:
    *tables, query = parts
    return "WITH " + ",".join(tables) + query


def _as_text(query: str, plain: tuple[str, ...], two_decimals: tuple[str, ...]) -> str:
    """The fields of a report's file: nothing for NULL, percentages with two places."""
    fields = [f"COALESCE(CAST({name} AS VARCHAR), '') AS {name}" for name in plain]
    fields += [f"COALESCE(printf('%.2f', {name}), '') AS {name}" for name in two_decimals]
    return f"SELECT {', '.join(fields)} FROM ({query})"


def statements() -> dict[str, str]:
    found = _reports()
    found["channel_share_text"] = _as_text(
        found["channel_share"],
        ("category", "web_events", "store_sales"),
        ("web_pct", "store_pct", "pct_difference"),
    )
    found["catalog_coverage_text"] = _as_text(
        found["catalog_coverage"],
        ('"both"', "web_only", "catalog_only", "total_web_categories", "total_catalog_categories"),
        ("catalog_coverage_pct",),
    )
    # The last row of a repeated id: some products moved away, some categories renamed.
    again = found["category_presence_tagged"]
    for before, after in (
        ("products AS (SELECT product_id, cat_id,",
         "products AS (SELECT product_id, CASE WHEN product_id % 3 = 0 THEN 'none' ELSE cat_id END AS cat_id,"),
        ("categories AS (SELECT DISTINCT cat_id, dept_id, cat_name",
         "categories AS (SELECT DISTINCT cat_id, dept_id,"
         " CASE WHEN length(cat_id) % 2 = 0 THEN concat('New ', cat_name) ELSE cat_name END AS cat_name"),
    ):
        again = again.replace(before, after)
    found["category_presence_tagged_repeats"] = again
    return found


def _reports() -> dict[str, str]:
    base = (_STORE, _WEB)
    cuts = (925, 950, 975)
    outer = f"{_OUTER}"
    return {
        "weblog_etl": _with(*base, "\nSELECT * FROM weblog"),
        "category_presence_tagged": _with(
            *base,
            f"""
web AS (
  SELECT DISTINCT lower(CASE WHEN contains(category, '/product') THEN split_part(category, '/product', 1)
                             ELSE split_part(category, '/add_to_cart', 1) END) AS name
  FROM weblog WHERE {_CATEGORY_PAGES} AND trim(category) <> '')""",
            _SOLD_CATEGORIES,
            f"""
SELECT {_title("trim(regexp_replace(COALESCE(w.name, s.name), '\\s+', ' ', 'g'))")} AS category,
       {_SALES} AS presence {outer}""",
        ),
        "product_coverage": _with(
            *base,
            f"""
web AS (SELECT DISTINCT {_KEY('product')} AS name FROM weblog WHERE trim(product) <> ''),
store AS (SELECT DISTINCT {_KEY('product_name')} AS name FROM products WHERE trim(product_name) <> ''),
counts AS (
  SELECT count(*) FILTER (WHERE w.name IS NOT NULL AND s.name IS NOT NULL) AS n_both,
         count(*) FILTER (WHERE s.name IS NULL) AS n_web, count(*) FILTER (WHERE w.name IS NULL) AS n_store
  {outer})""",
            f"""
SELECT n_both AS "both", n_web AS web_only, n_store AS store_only, n_both + n_web AS total_web_products,
       n_both + n_store AS total_db_products,
       CASE WHEN n_both + n_store > 0 THEN {_r2('n_both * CAST(100 AS DOUBLE) / (n_both + n_store)')}
            ELSE 0 END AS catalog_coverage_pct
FROM counts""",
        ),
        "category_presence_clean": _with(
            *base,
            f"""
cleaned AS (SELECT {_FRAGMENTS_CUT} AS category, pageType FROM weblog),
web AS (SELECT DISTINCT {_KEY('category')} AS name FROM cleaned WHERE {_CATEGORY_PAGES})""",
            _SOLD_CATEGORIES,
            f"""
SELECT {_title('COALESCE(w.name, s.name)')} AS "Category", {_SALES} AS presence {outer}""",
        ),
        "category_presence_sales": _with(
            *base, _WEB_CATEGORIES, _SOLD_CATEGORIES,
            f"\nSELECT COALESCE(w.name, s.name) AS category, {_SALES} AS presence {outer}",
        ),
        "category_presence_sales_summary": _with(
            *base, _WEB_CATEGORIES, _SOLD_CATEGORIES,
            f"\nflags AS (SELECT {_SALES} AS presence {outer})",
            f"""
SELECT presence, count(*) AS category_count,
       {_r2('count(*) * CAST(100 AS DOUBLE) / sum(count(*)) OVER ()')} AS pct_of_total
FROM flags GROUP BY presence""",
        ),
        "category_presence_catalog": _with(
            *base, _WEB_CATEGORIES, _CATALOG_CATEGORIES,
            f"\nSELECT COALESCE(w.name, s.name) AS category, {_CATALOG} AS presence {outer}",
        ),
        "catalog_coverage": _with(
            *base, _WEB_CATEGORIES, _CATALOG_CATEGORIES,
            f"""
counts AS (
  SELECT CAST(sum(CASE WHEN w.name IS NOT NULL AND s.name IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_both,
         CAST(sum(CASE WHEN s.name IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_web,
         CAST(sum(CASE WHEN w.name IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_catalog
  {outer})""",
            f"""
SELECT n_both AS "both", n_web AS web_only, n_catalog AS catalog_only, n_both + n_web AS total_web_categories,
       n_both + n_catalog AS total_catalog_categories,
       {_r2('n_both * CAST(100 AS DOUBLE) / NULLIF(n_both + n_catalog, 0)')} AS catalog_coverage_pct
FROM counts""",
        ),
        "channel_share": _with(
            *base, _WEB_CATEGORIES, _SOLD_CATEGORIES,
            f"""
SELECT COALESCE(w.name, s.name) AS category, COALESCE(w.cnt, 0) AS web_events, {_r2(_WEB_SHARE)} AS web_pct,
       COALESCE(s.cnt, 0) AS store_sales, {_r2(_STORE_SHARE)} AS store_pct,
       {_r2(f'ABS({_WEB_SHARE} - {_STORE_SHARE})')} AS pct_difference
{outer}""",
        ),
        "channel_share_top5": _with(
            *base, _WEB_CATEGORIES, _SOLD_CATEGORIES,
            f"""
SELECT COALESCE(w.name, s.name) AS category, {_r2(_WEB_SHARE)} AS web_pct, {_r2(_STORE_SHARE)} AS store_pct,
       {_r2(f'ABS({_WEB_SHARE} - {_STORE_SHARE})')} AS pct_difference
{outer} ORDER BY pct_difference DESC, category LIMIT 5""",
        ),
        "product_rank_gap": _with(
            *base, _WEB_PRODUCTS, _SOLD_PRODUCTS, _RANKED,
            f"""
SELECT COALESCE(w.name, s.name) AS product, COALESCE(w.adds, 0) AS web_cart_adds,
       COALESCE(w.place, 9999) AS web_rank, COALESCE(s.qty, 0) AS store_qty_sold,
       COALESCE(s.place, 9999) AS store_rank, COALESCE(s.place, 9999) - COALESCE(w.place, 9999) AS rank_gap
{_RANKED_OUTER}""",
        ),
        "product_rank_gap_top5": _with(
            *base, _WEB_PRODUCTS, _SOLD_PRODUCTS, _RANKED,
            f"""
SELECT COALESCE(w.name, s.name) AS product, COALESCE(w.place, 9999) AS web_rank,
       COALESCE(s.place, 9999) AS store_rank,
       ABS(COALESCE(s.place, 9999) - COALESCE(w.place, 9999)) AS abs_gap
{_RANKED_OUTER} WHERE w.name IS NOT NULL ORDER BY abs_gap DESC, product LIMIT 5""",
        ),
        "product_presence": _with(
            *base, _WEB_PRODUCTS, _SOLD_PRODUCTS,
            f"""
SELECT COALESCE(w.name, s.name) AS product, COALESCE(w.adds, 0) AS web_cart_adds,
       COALESCE(s.lines, 0) AS actual_order_lines, COALESCE(s.qty, 0) AS total_qty_sold,
       COALESCE({_r2('s.avg_qty')}, 0) AS avg_qty_per_order, COALESCE({_r2('s.revenue')}, 0) AS total_revenue,
       {_r2('CAST(COALESCE(w.adds, 0) AS DOUBLE) / NULLIF(s.qty, 0)')} AS web_events_per_unit_sold,
       {_r2('COALESCE(s.lines, 0) * CAST(100 AS DOUBLE) / NULLIF(w.adds, 0)')} AS cart_to_order_pct,
       {_PRODUCTS} AS presence
{outer}""",
        ),
        "product_presence_summary": _with(
            *base, _WEB_PRODUCTS, _SOLD_PRODUCTS,
            f"\nflags AS (SELECT {_PRODUCTS} AS presence, COALESCE(s.revenue, 0) AS revenue {outer})",
            f"""
SELECT presence, count(*) AS product_count, {_r2('sum(revenue)')} AS total_revenue,
       {_r2('avg(revenue)')} AS avg_revenue_per_product
FROM flags GROUP BY presence""",
        ),
        "dept_traffic_revenue": _with(
            *base, _DEPARTMENTS,
            f"""
SELECT COALESCE(w.name, s.name) AS department, COALESCE(w.cnt, 0) AS web_total_events,
       COALESCE(w.adds, 0) AS web_cart_adds, {_r2(_WEB_SHARE)} AS web_traffic_pct,
       COALESCE(s.qty, 0) AS store_qty_sold, COALESCE(s.revenue, 0) AS store_revenue,
       {_r2(_REVENUE_SHARE)} AS revenue_pct,
       {_r2(f'{_REVENUE_SHARE} - {_WEB_SHARE}')} AS revenue_vs_traffic_gap
{outer}""",
        ),
        "dept_efficiency": _with(
            *base, _DEPARTMENTS,
            f"""
gaps AS (SELECT COALESCE(w.name, s.name) AS department, {_REVENUE_SHARE} - {_WEB_SHARE} AS g {outer})""",
            f"""
SELECT department, {_r2('g')} AS gap,
       CASE WHEN g > 2 THEN 'Efficient (high revenue, low web need)'
            WHEN g < -2 THEN 'Underperforming (high traffic, low revenue)' ELSE 'Balanced' END AS classification
FROM gaps""",
        ),
        "funnel_by_category": _with(
            *base, _FUNNEL,
            f"""
SELECT category, {_pages('product')} AS product_views, {_pages('view_cart')} AS cart_views,
       {_pages('checkout')} AS checkouts, {_pages('add_to_cart')} AS add_to_carts,
       {_page_rate('view_cart', 'product')} AS pct_view_to_cart,
       {_page_rate('checkout', 'view_cart')} AS pct_cart_to_checkout,
       {_page_rate('add_to_cart', 'checkout')} AS pct_checkout_to_add
FROM funnel GROUP BY category""",
        ),
        "funnel_total": _with(
            *base, _FUNNEL,
            f"""
SELECT {_pages('product')} AS total_product_views, {_pages('view_cart')} AS total_cart_views,
       {_pages('checkout')} AS total_checkouts, {_pages('add_to_cart')} AS total_add_to_carts,
       {_page_rate('view_cart', 'product')} AS overall_view_to_cart_pct,
       {_page_rate('checkout', 'view_cart')} AS overall_cart_to_checkout_pct,
       {_page_rate('add_to_cart', 'checkout')} AS overall_checkout_to_add_pct
FROM funnel""",
        ),
        "price_tiers": _with(*base, _tiers(cuts), _TIER_REPORT),
        "price_tiers_dedup": _with(*base, _tiers(cuts, names_once=True), _TIER_REPORT),
        "price_tiers_default_cuts": _with(*base, _tiers((50, 100, 200)), _TIER_REPORT),
        "price_tier_verdict": _with(
            *base, _tiers(cuts),
            f"""
SELECT price_range, {_UNIT_RATE} AS web_events_per_unit,
       CASE WHEN {_UNIT_RATE} < 1 THEN 'Best Converter' ELSE 'Review Needed' END AS verdict
FROM tiers""",
        ),
        "peak_hours": _with(*base, _hours(_READABLE_TIME), _HOUR_REPORT),
        "peak_hours_summary": _with(*base, _hours(_READABLE_TIME), _HOUR_PEAKS),
        "peak_hours_untidy": _with(
            *base,
            _hours(_READABLE_TIME).replace(
                f"try_strptime(order_date, '%Y-%m-%d %H:%M:%S')", "CAST(order_date AS TIMESTAMP)"
            ),
            _HOUR_REPORT,
        ),
        "lines_counted": _with(*base, _LINES_COUNTED),
        "products_from_lines": """
SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_brand AS cat_id,
       CASE p_partkey % 6 WHEN 2 THEN concat(p_name, ', boxed') ELSE p_name END AS product_name
FROM part WHERE p_partkey % 6 IN (0, 2, 4)""",
        "peak_hours_literal": _with(*base, _hours(_LITERAL_TIME), _HOUR_REPORT),
        "peak_hours_summary_literal": _with(*base, _hours(_LITERAL_TIME), _HOUR_PEAKS),
    }
