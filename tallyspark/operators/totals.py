"""Totals of positions, their roll-up, and the chain of mark-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions import fixed

MEASURES = ("labor", "material", "machines", "total")
SUM = "decimal(38,2)"


def _r2(c: Column) -> Column:
    return F.round(c, 2).cast("decimal(28,2)")


def position_totals(positions: DataFrame, materials: Column | bool = True) -> DataFrame:
    """Adds unit_price, labor, material, machines, total. Each is rounded by itself, so the
    total is not the sum of its parts. materials: whether they count."""
    material = F.when(F.lit(materials) if isinstance(materials, bool) else materials, F.coalesce("material_price", F.lit(0))).otherwise(F.lit(0)).cast("decimal(18,6)")
    price = {"labor": F.coalesce("labor_price", F.lit(0)).cast("decimal(18,6)"), "material": material, "machines": F.coalesce("machines_price", F.lit(0)).cast("decimal(18,6)")}
    quantity = F.coalesce("quantity", F.lit(0)).cast("decimal(18,6)")
    unit = _r2(price["labor"] + price["material"] + price["machines"])
    return positions.withColumns({"unit_price": unit} | {k: _r2(p * quantity) for k, p in price.items()} | {"total": _r2(unit * quantity)})


def rollup(totals: DataFrame) -> DataFrame:
    """Sums by division, estimate and object, in one pass. level: 0 division, 1 estimate, 3 object."""
    keys = ("object_id", "estimate_id", "division_id")
    sums = totals.rollup(*keys).agg(F.grouping_id().cast("int").alias("level"), *(F.sum(m).cast(SUM).alias(m) for m in MEASURES), F.count("*").alias("positions"))
    return sums.where(F.col("level") < 7)


def settings_with_defaults(stored: DataFrame) -> DataFrame:
    """Stored settings over the defaults, column by column."""
    given = set(stored.columns)
    pct = {k: (F.coalesce(F.col(k).cast("decimal(9,4)"), F.lit(v).cast("decimal(9,4)")) if k in given else F.lit(v).cast("decimal(9,4)")) for k, v in fixed.SETTINGS.items()}
    rest = {"materials_included": F.coalesce(F.col("materials_included"), F.lit(True)) if "materials_included" in given else F.lit(True)}
    return stored.withColumns(pct | rest)


def mark_up(objects: DataFrame) -> DataFrame:
    """The chain from direct costs to the grand total; each step is rounded.

    objects: object_id, labor, material, machines, total and the percentages.
    """
    share = lambda base, pct: _r2(F.col(base).cast("decimal(24,2)") * F.col(pct) / 100)
    return (
        objects.withColumn("base", (F.col("labor") + F.col("machines")).cast("decimal(24,2)"))
        .withColumn("overhead", share("base", "overhead_pct"))
        .withColumn("subtotal", _r2(F.col("total") + F.col("overhead")))
        .withColumn("_with", (F.col("base") + F.col("overhead")).cast("decimal(24,2)"))
        .withColumn("profit", share("_with", "profit_pct"))
        .withColumn("admin", share("subtotal", "admin_pct"))
        .withColumn("risk", share("subtotal", "risk_pct"))
        .withColumn("before_vat", _r2(F.col("subtotal") + F.col("profit") + F.col("admin") + F.col("risk")))
        .withColumn("vat", share("before_vat", "vat_pct"))
        .withColumn("grand_total", _r2(F.col("before_vat") + F.col("vat")))
        .drop("base", "_with")
    )


#: key, label, column, whether it is a part of the line above, percentage shown in the label
LINES = [
    ("direct", "Прямі витрати", "total", False, None), ("labor", "у т.ч. вартість робіт", "labor", True, None),
    ("material", "у т.ч. вартість матеріалів", "material", True, None), ("machines", "у т.ч. експлуатація машин", "machines", True, None),
    ("overhead", "Загальновиробничі витрати", "overhead", False, "overhead_pct"), ("subtotal", "Разом", "subtotal", False, None),
    ("profit", "Кошторисний прибуток", "profit", False, "profit_pct"), ("admin", "Адміністративні витрати", "admin", False, "admin_pct"),
    ("risk", "Кошти на покриття ризиків", "risk", False, "risk_pct"), ("before_vat", "Разом без ПДВ", "before_vat", False, None),
    ("vat", "ПДВ", "vat", False, "vat_pct"), ("total", "Усього кошторисна вартість", "grand_total", False, None),
]


def summary_lines(marked: DataFrame) -> DataFrame:
    """object_id, ord, key, label, value, sub: twelve lines for each object."""
    plain = lambda pct: F.regexp_replace(F.col(pct).cast("string"), r"\.?0+$", "")
    label = lambda text, pct: F.lit(text) if pct is None else F.concat(F.lit(f"{text} ("), F.when(F.col(pct) == 0, "0").otherwise(plain(pct)), F.lit("%)"))
    lines = [
        F.struct(F.lit(i).alias("ord"), F.lit(k).alias("key"), label(t, p).alias("label"), F.col(c).cast("decimal(28,2)").alias("value"), F.lit(s).alias("sub"))
        for i, (k, t, c, s, p) in enumerate(LINES)
    ]
    return marked.select("object_id", F.inline(F.array(*lines)))


def through_numbers(positions: DataFrame) -> DataFrame:
    """Adds number: 1..n over the object in tree order."""
    order = [F.coalesce(F.col(c), F.lit(0)) for c in ("estimate_ord",)]
    w = Window.partitionBy("object_id").orderBy(*order, "estimate_id", "division_ord", "division_id", "ordinal", "position_id")
    return positions.withColumn("number", F.row_number().over(w))


def tree(positions: DataFrame) -> DataFrame:
    """Nested objects: estimates, divisions and positions, each in order. Objects are bounded
    documents, so an array of one is too. Positions are dealt by object first: what is put
    together of them lies together already and is not shuffled again."""
    positions = positions.repartition("object_id")
    p = F.struct("ordinal", "position_id", "name", "unit", "quantity", "total")
    divisions = positions.groupBy("object_id", "estimate_ord", "estimate_id", "division_ord", "division_id").agg(F.array_sort(F.collect_list(p)).alias("positions"))
    estimates = divisions.groupBy("object_id", "estimate_ord", "estimate_id").agg(F.array_sort(F.collect_list(F.struct("division_ord", "division_id", "positions"))).alias("divisions"))
    return estimates.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("estimate_ord", "estimate_id", "divisions"))).alias("estimates"))


def object_list(objects: DataFrame, positions: DataFrame, marked: DataFrame) -> DataFrame:
    """All objects with their count of positions and grand total, latest first."""
    n = positions.groupBy("object_id").agg(F.count("*").alias("positions_count"))
    out = objects.join(n, "object_id", "left").join(marked.select("object_id", "grand_total"), "object_id", "left")
    zero = F.lit(0).cast("decimal(28,2)")
    return out.withColumns({"positions_count": F.coalesce("positions_count", F.lit(0)).cast("long"), "grand_total": F.coalesce("grand_total", zero)}).orderBy(F.desc("updated_at"), F.desc("object_id"))
