"""Look-ups over the price history and site price lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def history_browse(history: DataFrame, text: str = "", limit: int = 100) -> DataFrame:
    """Latest facts whose name is like %text%; ASCII case is ignored, % and _ are wildcards."""
    limit = max(1, min(500, limit))
    pattern = "%" + text.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\") + "%"
    found = history.where(F.translate("name", UPPER, LOWER).like(pattern)) if text else history
    return found.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def site_browse(site_prices: DataFrame, text: str = "", limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """(first rows whose name or category holds the text in any case, their counts)."""
    low = text.lower()
    found = site_prices.where(F.contains(F.lower("name"), F.lit(low)) | F.contains(F.lower("category"), F.lit(low))) if low else site_prices
    counts = found.agg(F.count("*").alias("matched"), F.count_distinct(F.nullif("category", F.lit(""))).alias("categories"))
    return found.orderBy("ord").limit(limit), counts
