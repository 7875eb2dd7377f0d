"""The price catalogue, its overrides, and regional factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions import fixed
from tallyspark.functions import text as T
from tallyspark.sources.shared import numbered

PRICES = ("labor", "material", "machines")
MONEY = "decimal(18,6)"


def overlay(base: DataFrame, overrides: DataFrame) -> DataFrame:
    """Base rows with overrides laid over them by code; new codes follow in the overrides' order.

    base: ord, code, name, unit, category, prices. overrides: the same without ord; their
    order is that of their column ``seq``, if they have one, then of their codes. New codes
    get the numbers after the greatest ord of the base. One full outer join; the base is not
    shuffled again.
    """
    order = ["seq", "code"] if "seq" in overrides.columns else ["code"]
    new = numbered(overrides.join(base.select("code"), "code", "left_anti").select(*order), "place", *order)
    last = base.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("last"))  # one row
    new = new.join(F.broadcast(last)).select(F.col("code").alias("n_code"), (F.col("last") + F.col("place")).alias("n_ord"))
    b, o = base.alias("b"), overrides.alias("o")
    own = F.col("o.code").isNotNull()
    joined = b.join(o, F.col("b.code") == F.col("o.code"), "full").join(new, F.col("o.code") == F.col("n_code"), "left")
    return joined.select(
        F.coalesce("b.ord", "n_ord").cast(base.schema["ord"].dataType).alias("ord"),
        F.coalesce("o.code", "b.code").alias("code"),
        F.when(own, F.col("o.name")).otherwise(F.col("b.name")).alias("name"),
        F.when(own, T.normalise_unit(F.col("o.unit"))).otherwise(F.col("b.unit")).alias("unit"),
        F.coalesce(F.nullif("o.category", F.lit("")), F.col("b.category"), F.lit("")).alias("category"),
        *(F.when(own, F.col(f"o.{p}")).otherwise(F.col(f"b.{p}")).cast(MONEY).alias(p) for p in PRICES),
        F.when(own, F.lit("override")).otherwise(F.lit("base")).alias("source"),
    )


def by_code(items: DataFrame, code: str) -> DataFrame:
    return items.where(F.col("code") == code)


def categories(items: DataFrame) -> DataFrame:
    return items.select("category").where(F.col("category") != "").distinct()


def upsert(overrides: DataFrame, changes: DataFrame, known: DataFrame) -> DataFrame:
    """Latest row by code. changes: code, name, ..., updated_at; blank names are left out.

    A blank code becomes the first free one of U0001, U0002, ... that neither known codes
    nor each other's take: the n-th blank row gets the n-th free number.
    """
    changes = changes.where(F.trim(F.coalesce("name", F.lit(""))) != "")
    blank = F.trim(F.coalesce("code", F.lit(""))) == ""
    new = changes.where(blank)
    n = new.count()
    named = changes.where(~blank)
    if n:
        taken = known.select("code").union(overrides.select("code")).union(named.select("code")).where(F.col("code").rlike("^U[0-9]{4,}$")).distinct()
        # n + the taken codes are enough numbers; one row per row that is added.
        numbers = changes.sparkSession.range(1, n + taken.count() + 1).select(F.format_string("U%04d", "id").alias("free"), "id")
        free = numbered(numbers.join(taken, numbers["free"] == taken["code"], "left_anti"), "n", "id").select("free", "n")
        asked = numbered(new, "n", "updated_at", "name")
        named = named.unionByName(asked.join(free, "n").withColumn("code", F.col("free")).drop("n", "free"))
    clean = named.withColumns({"unit": T.normalise_unit(F.col("unit"))} | {p: F.coalesce(F.col(p).cast(MONEY), F.lit(0).cast(MONEY)) for p in PRICES})
    both = overrides.withColumn("_new", F.lit(0)).unionByName(clean.select(*overrides.columns).withColumn("_new", F.lit(1)))
    latest = Window.partitionBy("code").orderBy(F.desc("updated_at"), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n", "_new")


def delete(overrides: DataFrame, codes: DataFrame) -> DataFrame:
    """Without these codes; the base row shows again in the overlay."""
    return overrides.join(codes.select("code"), "code", "left_anti")


def region_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """kind (city, region), name, factor, ord; of the built-in values or of a JSON file
    with the maps ``cities`` and ``regions``."""
    if path is None:
        rows = [("city", k, float(v), i) for i, (k, v) in enumerate(fixed.CITIES.items())]
        rows += [("region", k, float(v), i) for i, (k, v) in enumerate(fixed.REGIONS.items())]
        return spark.createDataFrame(rows, "kind string, name string, factor double, ord int")
    maps = "map<string,double>"
    data = spark.read.schema(f"regions {maps}, cities {maps}").option("multiLine", True).json(path)
    part = lambda kind, c: data.select(F.lit(kind).alias("kind"), F.posexplode(c).alias("ord", "name", "factor")).select("kind", "name", "factor", "ord")
    return part("city", "cities").unionByName(part("region", "regions"))


#: Rows that a table of factors may have: it becomes constants of the plan.
MOST_FACTORS = 10_000


def factor_maps(table: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """(cities, regions) of a region_table, in its order; such a table is a small setting."""
    rows = table.orderBy("ord").limit(MOST_FACTORS + 1).collect()
    if len(rows) > MOST_FACTORS:
        raise ValueError(f"a table of factors has at most {MOST_FACTORS} rows")
    return tuple({r.name: r.factor for r in rows if r.kind == kind} for kind in ("city", "region"))


def region_factor(city: Column, region: Column, cities: dict[str, float] = fixed.CITIES, regions: dict[str, float] = fixed.REGIONS) -> tuple[Column, Column]:
    """Factor and its label: the city, else the region, else the first region whose first
    word the given one contains, else 1. The two tables are plan-time constants, so no join."""
    city, region = T.clean_text(city), T.clean_text(region)
    by_city, by_region = F.try_element_at(T.literal_map(cities), city), F.try_element_at(T.literal_map(regions), region)
    # One literal table and a lambda, not a branch for each region: the code stays small.
    rows = F.array(*[F.struct(F.lit(k.split()[0].lower()).alias("start"), F.lit(k).alias("name"), F.lit(v).alias("factor")) for k, v in regions.items()])
    inside = F.filter(rows, lambda r: (region != "") & F.contains(F.lower(region), r["start"]))
    first = F.try_element_at(inside, F.lit(1))
    factor, label = F.coalesce(first["factor"], F.lit(1.0)), F.coalesce(first["name"], F.lit(fixed.BASE_REGION))
    return (
        F.coalesce(by_city, by_region, factor),
        F.when(by_city.isNotNull(), F.concat(F.lit("місто "), city)).when(by_region.isNotNull(), region).otherwise(label),
    )
