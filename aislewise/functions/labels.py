"""Labels of the reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PresenceLabels:
    both: str
    web_only: str
    store_only: str

    def of(self, in_web: Column, in_store: Column) -> Column:
        """Label for two existence tests; at least one of them holds."""
        return (
            F.when(in_web & in_store, self.both).when(in_web, self.web_only).otherwise(self.store_only)
        )


# --- fixed values -----------------------------------------------------------
SALES_LABELS = PresenceLabels("Both (Web & Store)", "Web Only", "Store Only")
CATALOG_LABELS = PresenceLabels("Both (Web & Catalog)", "Web Only", "Catalog Only (no web traffic)")
PRODUCT_LABELS = PresenceLabels("Both (Web & Store)", "Web Only (abandoned)", "Store Only")

EFFICIENT = "Efficient (high revenue, low web need)"
UNDERPERFORMING = "Underperforming (high traffic, low revenue)"
BALANCED = "Balanced"
GAP_LIMIT = 2.0

BEST_CONVERTER = "Best Converter"
REVIEW_NEEDED = "Review Needed"
VERDICT_LIMIT = 1.0

PRICE_CUTS = (50, 100, 200)
MISSING_RANK = 9999
# ----------------------------------------------------------------------------


def price_range(price: Column, cuts: tuple[int, ...] = PRICE_CUTS) -> Column:
    """Tier label such as ``2. $50-$100``; a NULL price falls in the last tier."""
    floors = (0, *cuts)
    label = F.lit(f"{len(floors)}. ${floors[-1]}+")
    for tier in range(len(cuts), 0, -1):
        name = f"{tier}. ${floors[tier - 1]}-${floors[tier]}"
        label = F.when(price < cuts[tier - 1], name).otherwise(label)
    return label


def efficiency(gap: Column) -> Column:
    return (
        F.when(gap > GAP_LIMIT, EFFICIENT)
        .when(gap < -GAP_LIMIT, UNDERPERFORMING)
        .otherwise(BALANCED)
    )


def verdict(events_per_unit: Column) -> Column:
    return F.when(events_per_unit < VERDICT_LIMIT, BEST_CONVERTER).otherwise(REVIEW_NEEDED)
