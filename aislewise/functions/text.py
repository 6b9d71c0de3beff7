"""Name keys, blank tests, URL clean-up and display names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
PRODUCT_MARK = "/product"
CART_MARK = "/add_to_cart"
# ----------------------------------------------------------------------------

_CONTROL_AND_SPACE = "".join(chr(code) for code in range(33))


def name_key(name: Column) -> Column:
    """Key under which web and store names meet: spaces off both ends, lower case.

    Spaces inside the name stay as they are.
    """
    return F.lower(F.trim(name))


def line_key(name: Column) -> Column:
    """Like :func:`name_key`, but tabs and other control characters go as well."""
    return F.lower(trim_controls(name))


def trim_controls(text: Column) -> Column:
    return F.btrim(text, F.lit(_CONTROL_AND_SPACE))


def is_given(text: Column) -> Column:
    """Neither NULL nor empty. Text of spaces only counts as given."""
    return text.isNotNull() & (text != "")


def strip_url_fragments(category: Column) -> Column:
    """Cut a category at its first ``/product``; without one, at ``/add_to_cart``."""
    before_product = F.substring_index(category, PRODUCT_MARK, 1)
    return F.when(before_product != category, before_product).otherwise(
        F.substring_index(category, CART_MARK, 1)
    )


def decode_url(text: Column) -> Column:
    """Percent-decode (``+`` is a space); text that does not decode stays as it is."""
    encoded = F.contains(text, F.lit("%")) | F.contains(text, F.lit("+"))
    return F.when(encoded, F.coalesce(F.try_url_decode(text), text)).otherwise(text)


def title_words(name: Column) -> Column:
    """Capital at each word start, spacing kept."""
    return F.initcap(name)


def title_words_collapsed(name: Column) -> Column:
    """Capital at each word start, any run of white space turned into one space."""
    return F.initcap(F.trim(F.regexp_replace(name, r"\s+", " ")))
