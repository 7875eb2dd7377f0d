"""Prices in texts: search snippets and rows of price lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions import fixed
from tallyspark.functions import text as T
from tallyspark.sources.shared import dealt, written

# fixed values: how prices and units are written. A plain run of digits counts whole; with
# legacy=True it is read as the older rule did, three digits at a time.
_DIGITS = r"(?:\d{1,3}(?:[  ]\d{3})+|\d+)(?:[.,]\d+)?"
_DIGITS_LEGACY = r"\d{1,3}(?:[  ]\d{3})*(?:[.,]\d+)?"
_SNIPPET_UNIT = r"м2|м²|кв\.?\s?м|м\.?кв|м3|м³|куб\.?\s?м|пог\.?\s?м|м\.?п|м|шт|компл\.?|комплект|точк[ауи]|т|кг|блок|годин[ауи]"
_LEAST, _MOST = 1.0, 5_000_000.0
_CELL_LENGTH, _NAME_LENGTH, _LEAST_NAME, _LEAST_LETTERS = 26, 120, 6, 5
_NOISE = r"(?iuU)^(?:ціна|вартість|назва|найменування|послуга|роботи|од\.?|одиниц|разом|всього|телефон|адреса|copyright|©|меню|головна)\b"


def _number(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit(" "), F.lit("")), F.lit(" "), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def price_kind(c: Column) -> Column:
    """material if a sign of material occurs and none of labour, else labor."""
    low = F.lower(c)
    return F.when(low.rlike(T.any_of(fixed.MATERIAL_SIGNS)) & ~low.rlike(T.any_of(fixed.LABOR_SIGNS)), "material").otherwise("labor")


def snippet_samples(text: Column, want: Column, legacy: bool = False) -> Column:
    """array<struct<value, unit, kind>>: middles of ranges first, then single prices whose
    unit is not another one. A range's upper end is a single price too."""
    digits = _DIGITS_LEGACY if legacy else rf"(?<!\d){_DIGITS}"
    text, want = T.clean_text(text), T.normalise_unit(want)
    kind = price_kind(text)
    span = rf"(?iu)({digits})\s*[-–—]\s*({digits.replace('(?<!\\d)', '')})\s*(?:грн|₴)"
    unit = rf"({_SNIPPET_UNIT})?" if legacy else rf"(?:({_SNIPPET_UNIT})(?!\w))?"  # else "м" would be read from a word
    single = rf"(?iuU)({digits})\s*(?:грн|₴|uah)\.?\s*(?:/|за\s+)?\s*{unit}"
    pair = lambda p, i, j: F.arrays_zip(F.regexp_extract_all(text, F.lit(p), F.lit(i)).alias("x"), F.regexp_extract_all(text, F.lit(p), F.lit(j)).alias("y"))
    sample = lambda value, unit: F.struct(value.alias("value"), unit.alias("unit"), kind.alias("kind"))
    ranges = F.transform(pair(span, 1, 2), lambda m: F.struct(_number(m["x"]).alias("a"), _number(m["y"]).alias("b")))
    ranges = F.transform(F.filter(ranges, lambda m: (m["a"] > 0) & (m["a"] <= m["b"])), lambda m: sample((m["a"] + m["b"]) / 2, want))
    singles = F.transform(pair(single, 1, 2), lambda m: F.struct(_number(m["x"]).alias("v"), T.normalise_unit(m["y"]).alias("u")))
    fits = lambda m: m["v"].between(_LEAST, _MOST) & ((want == "") | (m["u"] == "") | (m["u"] == want))
    singles = F.transform(F.filter(singles, fits), lambda m: sample(m["v"], F.when(m["u"] != "", m["u"]).otherwise(want)))
    return F.concat(ranges, singles)


def trimmed_medians(samples: DataFrame, *keys: str) -> DataFrame:
    """keys, median: of column value; of more than four values a fifth is cut from each end.

    Equal values are counted before the shuffle, and the two middle places after the cut are
    found in running counts, so no key's values meet in an array.
    """
    counts = samples.groupBy(*keys, "value").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("value")
    placed = counts.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(Window.partitionBy(*keys))})
    cut = F.when(F.col("all") > 4, F.greatest(F.lit(1), F.floor(F.col("all") / 5))).otherwise(0)
    kept = F.col("all") - 2 * cut
    at = lambda place: F.min(F.when(F.col("upto") >= cut + place, F.col("value")))
    middle = (at(F.floor((kept + 1) / 2)) + at(F.floor(kept / 2) + 1)) / 2
    return placed.groupBy(*keys).agg(middle.alias("median"))


#: Samples of a web price that are kept.
KEPT_SAMPLES = 12


def web_prices(results: DataFrame, most_results: int = 20) -> DataFrame:
    """Labour and material prices of each (work_key, city, provider) from search results, with
    the first samples. results: work_key, city, provider, unit, rank, title, snippet."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("snippet", F.lit("")))
    keys = ["work_key", "city", "provider"]
    asked = results.where(F.col("rank") <= most_results)
    samples = dealt(asked, *keys, "rank", "snippet").select(*keys, "rank", F.posexplode(snippet_samples(text, F.col("unit"))).alias("at", "s"))
    samples = written(samples.select(*keys, "rank", "at", "s.value", "s.unit", "s.kind"), "samples")
    money = lambda c: F.round(F.coalesce(c, F.lit(0.0)).cast("decimal(18,6)"), 2).cast("decimal(18,2)")
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("median")))
    prices = trimmed_medians(samples, *keys, "kind").groupBy(*keys).agg(money(of("labor")).alias("labor"), money(of("material")).alias("material"))
    order = Window.partitionBy(*keys).orderBy("rank", "at", "value", "unit", "kind")
    first = samples.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= KEPT_SAMPLES)
    first = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_n", F.struct("value", "unit", "kind").alias("s")))).alias("samples"))
    first = first.withColumn("samples", F.transform("samples", lambda x: x["s"]))
    size = samples.groupBy(*keys).agg(F.count("*").cast("int").alias("n_samples"))
    # Every request has a row, also if nothing was found.
    joined = asked.select(*keys).distinct()
    for part in (prices, size, first):
        joined = joined.join(part, keys, "left")
    zero = F.lit(0).cast("decimal(18,2)")
    none = F.array().cast(joined.schema["samples"].dataType)
    return joined.select(*keys, F.coalesce("labor", zero).alias("labor"), F.coalesce("material", zero).alias("material"), F.coalesce("n_samples", F.lit(0)).alias("n_samples"), F.coalesce("samples", none).alias("samples"))


def cell_price(c: Column, legacy: bool = False) -> Column:
    """Price of a short cell, the middle of a range; null if there is none."""
    digits = (_DIGITS_LEGACY if legacy else _DIGITS).replace("[  ]", r"[\s ]")
    pattern = rf"(?iuU)(?:від\s*)?({digits})(?:\s*[-–—]\s*({digits}))?\s*(?:грн|₴|uah)?"
    ends = lambda t: F.struct(_number(F.regexp_extract(t, pattern, 1)).alias("low"), _number(F.regexp_extract(t, pattern, 2)).alias("high"))

    def price(m: Column) -> Column:
        value = F.when(m["high"].isNotNull() & (m["low"] <= m["high"]) & (m["high"] <= _MOST), (m["low"] + m["high"]) / 2).otherwise(m["low"])
        return F.when(m["low"].between(_LEAST, _MOST), F.round(value.cast("decimal(18,6)"), 2).cast("decimal(18,2)"))

    return T.let(T.clean_text(c), lambda t: F.when(t.rlike(r"\d") & (F.length(t) <= _CELL_LENGTH), T.let(ends(t), price)))


LIST_UNITS = T.unit_set(fixed.LIST_UNITS)


def cell_unit(c: Column) -> Column:
    return T.let(T.let(T.unit_raw(c), T.unit_of), lambda u: F.when(u.isin(LIST_UNITS), u).otherwise(""))


def is_noise(name: Column) -> Column:
    """Headings, navigation, several rows in one, or hardly a letter."""
    return F.trim(name).rlike(_NOISE) | (F.length(name) > _NAME_LENGTH) | name.rlike(r"(?iu)грн|₴") | (F.length(F.regexp_replace(name, r"[^\p{L}]", "")) < _LEAST_LETTERS)


def _split_cells(cells: Column, legacy: bool) -> Column:
    """struct<name, unit, price>: the price is the right-most cell that has one, the unit the
    left-most other one, the name the longest of the rest."""
    read = F.transform(cells, lambda c, i: F.struct(i.alias("i"), c.alias("c"), cell_price(c, legacy).alias("p"), cell_unit(c).alias("u")))
    last = lambda at: F.try_element_at(F.filter(at, lambda x: x["p"].isNotNull()), F.lit(-1))
    first = lambda at, p: F.try_element_at(F.filter(at, lambda x: (x["i"] != p["i"]) & (x["u"] != "")), F.lit(1))

    def name(at: Column, p: Column, u: Column) -> Column:
        rest = F.filter(at, lambda x: (x["i"] != p["i"]) & (u.isNull() | (x["i"] != u["i"])))
        return F.array_max(F.transform(rest, lambda x: F.struct(F.length(x["c"]).alias("n"), (-x["i"]).alias("i"), x["c"].alias("c"))))["c"]

    row = lambda at, p, u: F.struct(name(at, p, u).alias("name"), F.coalesce(u["u"], F.lit("")).alias("unit"), p["p"].alias("price"))
    return T.let(read, lambda at: T.let(last(at), lambda p: T.let(first(at, p), lambda u: row(at, p, u))))


def _one_line(cells: Column, legacy: bool) -> Column:
    """struct<name, unit, price> of cells that are one line "name unit price"."""
    digits = (_DIGITS_LEGACY if legacy else _DIGITS).replace("[  ]", r"[\s ]")
    line = rf"(?iuU)^(.+?)[\s ]+([^\s ]{{1,7}})[\s ]+(?:від\s*)?({digits})\s*(?:грн|₴)?\.?$"
    part = lambda j, i: F.regexp_extract(j, line, i)
    read = lambda j: F.struct(T.clean_text(part(j, 1)).alias("name"), cell_unit(part(j, 2)).alias("unit"), cell_price(part(j, 3), legacy).alias("price"))
    return T.let(T.clean_text(F.array_join(cells, " ")), read)


def price_rows(rows: DataFrame, legacy: bool = False) -> DataFrame:
    """Rows of cells -> name, unit, price, category; rows without a price go.

    rows: cells (array of string), category and any other columns, which stay. It is one
    generator: a filter after a projection would be pushed down with a copy of all of it.
    """
    named = lambda r: (F.length(r["name"]) >= _LEAST_NAME) & ~is_noise(r["name"])
    kind = "array<struct<name:string,unit:string,price:decimal(18,2)>>"
    one = lambda r: F.array(F.struct(T.clean_text(r["name"]).alias("name"), r["unit"].alias("unit"), r["price"].alias("price"))).cast(kind)
    none = F.array().cast(kind)
    cells = F.col("cells")
    line = T.let(_one_line(cells, legacy), lambda r: F.when((r["unit"] != "") & r["price"].isNotNull() & named(r), one(r)).otherwise(none))
    found = T.let(_split_cells(cells, legacy), lambda r: F.when(r["price"].isNotNull() & named(r), one(r)))
    rest = [c for c in rows.columns if c not in ("category", "name", "unit", "price")]
    return rows.select(*rest, T.clean_text(F.col("category")).alias("category"), F.inline(T.let(found, lambda x: F.coalesce(x, line))))


def first_of_each(prices: DataFrame, *order: str) -> DataFrame:
    """The first row of each work and price in the order of pages and rows, by site."""
    w = Window.partitionBy("site", T.work_key(F.col("name"), F.col("unit")), "price").orderBy(*order)
    return prices.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def list_profile(prices: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a price list looks like: rows by unit (top 8), by category (top 15), and one row
    of bounds by site, with its upper median and rows that look wrong."""
    top = lambda c, empty, k: prices.groupBy(F.when(F.col(c) == "", empty).otherwise(F.col(c)).alias(c)).count().orderBy(F.desc("count"), c).limit(k)
    odd = (F.col("price") < 5) | (F.length("name") < 10) | (F.col("unit") == "")
    # The upper median is the lower one from above; percentiles are counts of values, combined before the shuffle.
    median = F.expr("percentile_disc(0.5) within group (order by price desc)")
    bounds = prices.groupBy("site").agg(F.count("*").alias("rows"), F.min("price").alias("least"), F.max("price").alias("most"), median.alias("median"), F.count_if(odd).alias("suspicious"))
    return top("unit", "—", 8), top("category", "(без розділу)", 15), bounds


# fixed values: what counts as a mention of a price and of a unit
PRICE_MENTION = r"(?iu)\d[\d\s]{0,7}\s*(?:грн|₴)"
UNIT_MENTION = r"(?iuU)\b(?:м2|м²|кв\.?\s?м|шт|м\.?п|пог\.?\s?м)\b"


def page_diagnosis(pages: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """page_id, length, how often prices and units are mentioned; with the pages' rows
    (page_id, cells) also how many rows there are and how many hold a price."""
    html = F.coalesce("html", F.lit(""))
    out = pages.select(
        "page_id", F.length(html).alias("length"), F.regexp_count(html, F.lit(PRICE_MENTION)).alias("price_mentions"), F.regexp_count(html, F.lit(UNIT_MENTION)).alias("unit_mentions"),
    )
    if rows is None:
        return out
    priced = F.exists("cells", lambda c: c.rlike(PRICE_MENTION))
    counts = rows.groupBy("page_id").agg(F.count("*").alias("rows"), F.count_if(priced).alias("priced_rows"))
    return out.join(counts, "page_id", "left").na.fill(0, ["rows", "priced_rows"])
