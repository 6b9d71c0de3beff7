"""Access-log lines to structured page events, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislewise.functions.text import CART_MARK, decode_url
from aislewise.sources.counters import PassCounters

# --- fixed values -----------------------------------------------------------
# A line is a visit followed by one of four requests.  The requests are tried in this
# order; the first that is found in a line decides.
VISIT = r'([^ ]*) - - \[([^]]*)] "[^ ]* '
PRODUCT_REQUEST = r"/department/([^/]*)/category/([^/]*)/product/([^ ]*) HTTP[^ ]* (\d{3})"
CATEGORY_REQUEST = r"/department/([^/]*)/category/([^ ]*) HTTP[^ ]* (\d{3})"
DEPARTMENT_REQUEST = r"/department/([^ ]*) HTTP[^ ]* (\d{3})"
PAGE_REQUEST = r"/([^ /]*) HTTP[^ ]* (\d{3})"

ADD_TO_CART = "add_to_cart"
PRODUCT = "product"
CATEGORY = "category"
DEPARTMENT = "department"
VIEW_CART = "view_cart"
CHECKOUT = "checkout"
OK_STATUS = "200"

WEBLOG_COLUMNS = ("ip", "datetime", "dept", "category", "product", "pageType", "respCode")
# ----------------------------------------------------------------------------

# Requests and the parts their groups hold.  Each kind of request has a part of its own
# for the status, which thereby tells the kind.
_STATUS_OF = {
    PRODUCT: "product_status",
    CATEGORY: "category_status",
    DEPARTMENT: "department_status",
    None: "page_status",
}
_REQUESTS = (
    (PRODUCT_REQUEST, ("dept", "category", "product", _STATUS_OF[PRODUCT])),
    (CATEGORY_REQUEST, ("dept", "category", _STATUS_OF[CATEGORY])),
    (DEPARTMENT_REQUEST, ("dept", _STATUS_OF[DEPARTMENT])),
    (PAGE_REQUEST, ("page", _STATUS_OF[None])),
)
# A time comes as the log has it or, from a line of the usual shape, as it is reported.
_PARTS = (*_STATUS_OF.values(), "ip", "time", "datetime", "dept", "category", "product", "page")
_VISITOR_MARK = " - - ["

# The same requests in a line of the usual shape, each part up to the delimiter that ends it.  A part never
# gives a character back (``*+``), so a line is read once.  No blank stands in a path, and the digit behind
# ``HTTP/`` keeps a department or category from going on behind it, so the patterns find the same parts.
_TO_BLANK, _TO_STEP = "([^ ]*+)", "([^/ ]*+)"
# Its time has a day, three numbers of a clock and a zone, which is not reported.
_USUAL_VISIT = r'([^ ]*+) - - \[([^]:]*+):([^]: ]*+:[^]: ]*+:[^]: ]*+)(?: [^]:]*+)?+] "[^ ]*+ '
_USUAL_PATHS = (
    f"/department/{_TO_STEP}/category/{_TO_STEP}/product/{_TO_BLANK}",
    f"/department/{_TO_STEP}/category/{_TO_BLANK}",
    f"/department/{_TO_BLANK}",
    f"/{_TO_STEP}",
)
_USUAL_REQUESTS = tuple(
    (rf"{path} HTTP/\d[^ ]*+ (\d{{3}})", parts)
    for path, (_, parts) in zip(_USUAL_PATHS, _REQUESTS, strict=True)
)


def parse_access_log(
    lines: DataFrame, line_column: str = "value", counters: PassCounters | None = None
) -> DataFrame:
    """One row per line whose request matches and whose status is 200.

    A line that matches a pattern with another status is dropped; later patterns are
    not tried on it.  The stage is a scan, a generator and projections: no exchange.

    A line of the usual shape is cut at its delimiters from left to right, without a step
    back; only what is left over is searched by the patterns.  Both give a list of parts.
    The one-element ``explode`` keeps the optimizer from copying this work into the filters
    above it, where it would run a second time.

    ``counters`` count, as ``log``, the lines of each kind of request whatever their status,
    those that match none, those dropped for their status, and those cut without a search.
    """
    line, cut = F.col("line"), F.col("cut")
    both = lines.select(F.col(line_column).alias("line"), _cut(F.col(line_column)).alias("cut"))
    # A second mark has come through as part of the rest of a line.
    usual = F.startswith(cut, F.lit("\n")) & ~F.contains(cut, F.lit(_VISITOR_MARK))
    parts = F.split(F.when(usual, cut).otherwise(_rewritten(line)), "\n")
    parsed = both.select(F.explode(F.array(parts)).alias("part"))

    def part(name: str) -> Column:
        return F.get("part", F.lit(_PARTS.index(name) + 1))

    # Lines without a match have no parts.
    status = F.concat(*[part(name) for name in _STATUS_OF.values()])
    if counters is not None:
        kinds = {kind or "page": part(name) != "" for kind, name in _STATUS_OF.items()}
        parsed = counters.watch(
            "log",
            parsed,
            **kinds,
            unmatched=status.isNull(),
            other_status=status != OK_STATUS,
            cut_directly=part("datetime") != "",
        )
    parsed = parsed.where(status == OK_STATUS)

    raw_product = decode_url(part("product"))
    in_cart = F.endswith(raw_product, F.lit(CART_MARK))
    page_type = F.when(in_cart, ADD_TO_CART)
    for kind in (PRODUCT, CATEGORY, DEPARTMENT):
        page_type = page_type.when(part(_STATUS_OF[kind]) != "", kind)
    values = (
        part("ip"),
        F.when(part("datetime") != "", part("datetime")).otherwise(_readable_time(part("time"))),
        decode_url(part("dept")),
        decode_url(part("category")),
        F.when(in_cart, F.replace(raw_product, F.lit(CART_MARK), F.lit(""))).otherwise(raw_product),
        page_type.otherwise(part("page")),
        F.lit(OK_STATUS),
    )
    return parsed.select(*[value.alias(name) for name, value in zip(WEBLOG_COLUMNS, values)])


def _rewritten(line: Column) -> Column:
    """The parts below each other, after a blank line; a line without a match as it is.

    Where a line has the mark between visitor and time once, as access logs do, a request
    can only be found behind it, and one alternation of the four in their order decides
    like the sequence.  Other lines go through the sequence: each request is looked for
    in the whole line before the next one is tried.
    """
    one_record = F.substring_index(line, _VISITOR_MARK, 2) == line
    one_pass = _rewrite(line, *_REQUESTS)
    in_sequence = line
    for request in _REQUESTS:
        in_sequence = _rewrite(in_sequence, request)
    return F.when(one_record, one_pass).otherwise(in_sequence)


def _cut(line: Column) -> Column:
    """The parts of a line of the usual shape, and the rest of the line behind them; other lines as they are."""
    any_request, parts = _listed({"ip": "$1", "datetime": "$2 $3"}, _USUAL_REQUESTS)
    rest = 4 + sum(len(own) for _, own in _USUAL_REQUESTS)
    return F.regexp_replace(line, rf"(?s)^{_USUAL_VISIT}(?:{any_request})(.*+)$", f"{parts}\n${rest}")


def _rewrite(line: Column, *requests: tuple[str, tuple[str, ...]]) -> Column:
    """List the parts of the first of some requests; parts it does not have are empty.

    Lines hold no line feed, so one at the start marks what is rewritten already.  The
    visitor group takes all non-blanks it can, so a match begins at a word if anywhere.
    """
    any_request, parts = _listed({"ip": "$1", "time": "$2"}, requests)
    return F.regexp_replace(line, rf"(?s)^(?!\n)(?:.*? )??{VISIT}(?:{any_request}).*$", parts)


def _listed(visit: dict[str, str], requests: tuple[tuple[str, tuple[str, ...]], ...]) -> tuple[str, str]:
    """One expression for any of some requests, and the list of parts in terms of the groups before and in it."""
    groups = dict.fromkeys(_PARTS, "") | visit
    group = "".join(visit.values()).count("$")
    for _, parts in requests:
        for part in parts:
            group += 1
            groups[part] += f"${group}"
    any_request = "|".join(pattern for pattern, _ in requests)
    return any_request, "".join(f"\n{groups[part]}" for part in _PARTS)


def _readable_time(stamp: Column) -> Column:
    """``14/Jun/2014:23:30:13 -0400`` to ``14/Jun/2014 23:30:13``; NULL if parts lack."""
    parts = F.split(stamp, ":")
    day, hour, minute, second = (F.get(parts, F.lit(position)) for position in range(4))
    clock = F.concat(hour, F.lit(":"), minute, F.lit(":"), F.substring_index(second, " ", 1))
    return F.concat(day, F.lit(" "), clock)
