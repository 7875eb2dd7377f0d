"""Views of the driver's tables as objects, positions, catalogue, history and so on.

The tables are of another trade, so names are built from theirs: the first word of a part
gives an action, the second a thing to act on. Only the queries use this module; the
operators know nothing of it. Each view has its SQL twin in plans.oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.text import literal_map

ACTIONS = {
    "blue": "Демонтаж", "new": "Улаштування", "cold": "Фарбування", "red": "Розбирання", "large": "Установлення", "small": "Заміна",
    "hot": "Штукатурення", "old": "Монтаж",
}
THINGS = {
    "plate": "плитки на стінах", "rod": "розеток", "anvil": "дверей", "widget": "шпалер", "ring": "стяжки бетонної", "bolt": "вікон",
    "gear": "радіаторів", "gizmo": "плінтусів",
}
OTHER_FORMS = {
    "plate": "плиток стін", "rod": "розетки", "anvil": "двері", "widget": "шпалери", "ring": "стяжка з бетону", "bolt": "вікна",
    "gear": "радіатори", "gizmo": "плінтуси",
}
UNITS = ["м2", "шт", "м", "компл"]
RAW_UNITS = ["кв.м", "штук", "пог. м", "к-т"]
PLACES = ["Київ", "Львів", "Лохвиця", "Полтава", "Невідоме", ""]
AREAS = ["Полтавська область", "київська обл.", "Сумська область", "десь", ""]
MONEY = "decimal(18,6)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def work_name(part: Column, things: dict[str, str] = THINGS) -> Column:
    words = F.split(part, " ")
    return F.concat_ws(" ", F.try_element_at(literal_map(ACTIONS), words[0]), F.try_element_at(literal_map(things), words[1]))


SYLLABLE_LETTERS = "абвгдежзик"


def wide_name(things: dict[str, str] = THINGS) -> Column:
    """A part's name with its type and a word of its own, so that words grow with the table."""
    own = F.translate(F.col("p_partkey").cast("string"), "0123456789", SYLLABLE_LETTERS)
    return F.concat(work_name(F.col("p_name"), things), F.lit(" "), F.lower("p_type"), F.lit(" серії "), own, F.lit("ор"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("object_id"), F.concat(F.lit("Об'єкт "), F.col("o_orderkey").cast("string")).alias("name"),
        F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("вул. "), "c_mktsegment")).alias("address"),
        pick(PLACES, F.col("c_nationkey")).alias("city"), pick(AREAS, F.col("o_custkey")).alias("region"), F.col("c_name").alias("customer"),
        F.when(F.col("o_orderstatus") == "F", "118_ДЦ_ВОБ").otherwise("").alias("doc_code"), F.col("o_orderdate").alias("updated_at"),
        # settings as they are stored: JSON, sometimes none
        F.when(F.col("o_orderkey") % 4 == 0, F.lit(None)).when(F.col("o_orderkey") % 4 == 1, F.lit("no json"))
        .otherwise(F.concat(F.lit('{"overhead_pct": '), (F.col("o_custkey") % 20).cast("string"), F.lit(', "vat_pct": 7}'))).alias("settings"),
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as positions; prices are fixed shares of the line's price."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    # Names are made once for each part, not for each line.
    plain = work_name(F.col("p_name"))
    forms = {"plain": plain, "other": work_name(F.col("p_name"), OTHER_FORMS), "upper": F.concat(F.upper(plain), F.lit(",  ")), "p_unit": pick(RAW_UNITS, F.col("p_size"))}
    part = read(spark, sf_dir, "part").select("p_partkey", *(c.alias(k) for k, c in forms.items()))
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    form = F.col("l_linenumber") % 3
    name = F.when(form == 0, F.col("plain")).when(form == 1, F.col("other")).otherwise(F.col("upper"))
    share = lambda s: (price * F.lit(s).cast("decimal(4,3)")).cast(MONEY)
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("object_id"), F.col("l_linestatus").alias("estimate_id"), F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("estimate_ord"),
        F.col("l_returnflag").alias("division_id"), F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3).alias("division_ord"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", price).alias("position_id"), F.col("l_linenumber").alias("ordinal"), name.alias("name"),
        F.col("p_unit").alias("unit"), F.col("l_quantity").cast(MONEY).alias("quantity"),
        share("0.010").alias("labor_price"), share("0.005").alias("material_price"), share("0.002").alias("machines_price"), (F.col("l_linenumber") == 7).alias("manual"),
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    price = F.col("p_retailprice").cast("decimal(18,2)").cast(MONEY)
    return part.select(
        F.col("p_partkey").alias("ord"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("code"), work_name(F.col("p_name")).alias("name"),
        pick(UNITS, F.col("p_size")).alias("unit"), F.col("p_type").alias("category"), price.alias("labor"),
        (price * F.lit("0.5").cast("decimal(2,1)")).cast(MONEY).alias("material"), (price * F.lit("0.1").cast("decimal(2,1)")).cast(MONEY).alias("machines"),
    )


def wide_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue with wide names; names come back with other endings and orders when asked for."""
    names = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), wide_name().alias("wide"))
    return catalogue(spark, sf_dir).join(names, "ord").withColumn("name", F.col("wide")).drop("wide")


def wide_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, unit: each part's wide name in other words."""
    return read(spark, sf_dir, "part").select(wide_name(OTHER_FORMS).alias("name"), pick(RAW_UNITS, F.col("p_size")).alias("unit"))


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed prices for every tenth part (few rows of a catalogue have any), and codes that
    the base does not know."""
    c = catalogue(spark, sf_dir).where(F.col("ord") % 10 == 0)
    more = {"labor": (F.col("labor") + 1).cast(MONEY), "unit": F.lit("кв. м"), "category": F.when(F.col("ord") % 20 == 0, "").otherwise("ЗМІНА")}
    changed = c.withColumns(more)
    new = changed.where(F.col("ord") % 100 == 0).withColumn("code", F.concat(F.lit("N"), F.col("ord").cast("string")))
    return changed.union(new).drop("ord")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices paid: positions with the supplier's place and the order's date. Works on parts of
    sizes that three divides were never paid for, so that other sources have something to price."""
    from tallyspark.functions import text as T

    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    name, unit = work_name(F.col("p_name")), pick(UNITS, F.col("p_size"))
    part = read(spark, sf_dir, "part").where(F.col("p_size") % 3 != 0).select("p_partkey", name.alias("name"), unit.alias("unit"))
    # Keys are made once for each name and unit, not for each part.
    keys = part.select("name", "unit").distinct().withColumn("work_key", T.work_key(F.col("name"), F.col("unit")))
    part = part.join(keys, ["name", "unit"])
    order = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    joined = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    share = lambda s: (price * F.lit(s).cast("decimal(4,3)")).cast(MONEY)
    return joined.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", price).alias("id"), "work_key", "name", "unit", pick(PLACES, F.col("s_nationkey")).alias("city"), pick(AREAS, F.col("s_suppkey")).alias("region"),
        share("0.010").alias("labor_price"), share("0.005").alias("material_price"), share("0.002").alias("machines_price"), F.col("o_orderdate").alias("created_at"),
    )


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search might say about a part: prices, ranges, other units, materials."""
    p = F.col("p_retailprice").cast("int")
    n, low, high = p.cast("string"), (p - 50).cast("string"), (p + 50).cast("string")
    name = work_name(F.col("p_name"))
    form = F.col("p_partkey") % 5
    text = (
        F.when(form == 0, F.concat(name, F.lit(" — "), n, F.lit(" грн/м2, роботи з гарантією")))
        .when(form == 1, F.concat(F.lit("Купити "), F.lower(name), F.lit(" по "), n, F.lit(" грн за м.кв, товар з доставкою")))
        .when(form == 2, F.concat(name, F.lit(" "), low, F.lit("-"), high, F.lit(" грн/шт")))
        .when(form == 3, F.concat(name, F.lit(": "), n, F.lit(" грн/м.п, або "), high, F.lit(",50 грн монтаж")))
        .otherwise(F.concat(name, F.lit(" без ціни")))
    )
    return read(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("work_key"), pick(PLACES, F.col("p_size")).alias("city"), F.lit("serpapi").alias("provider"), pick(UNITS, F.col("p_size")).alias("unit"),
        (F.col("p_partkey") % 25 + 1).cast("int").alias("rank"), name.alias("title"), text.alias("snippet"),
    )


def list_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of price lists as cells: split ones, single lines, headings and noise."""
    p = F.col("p_retailprice").cast("int").cast("string")
    name = work_name(F.col("p_name"))
    unit = pick(RAW_UNITS, F.col("p_size"))
    form = F.col("p_partkey") % 6
    cells = (
        F.when(form == 0, F.array(name, unit, F.concat(p, F.lit(" грн"))))
        .when(form == 1, F.array(F.concat(name, F.lit("   м2  від "), p, F.lit(" грн"))))
        .when(form == 2, F.array(F.lit("12"), name, unit, F.concat(F.lit("150-"), p, F.lit(" грн/м2"))))
        .when(form == 3, F.array(F.lit("Найменування робіт"), F.lit("Ціна"), p))
        .when(form == 4, F.array(name, unit, F.lit("за домовленістю")))
        .otherwise(F.array(F.concat(name, F.lit(" 5 грн")), unit, p))
    )
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row_no"), F.concat(F.lit("site"), (F.col("p_size") % 5).cast("string")).alias("site"), cells.alias("cells"), F.col("p_type").alias("category")
    )


def price_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price lists as HTML: fifty parts a page, five sites; every third page names no prices."""
    n = F.col("p_partkey")
    page = F.floor(n / 50)
    order = F.floor(page / 5)
    price = F.when(order % 3 == 1, "за домовленістю").otherwise(F.concat(F.col("p_retailprice").cast("int").cast("string"), F.lit(" грн")))
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), cell(work_name(F.col("p_name"))), cell(pick(RAW_UNITS, F.col("p_size"))), cell(price), F.lit("</tr>"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(n.alias("n"), row.alias("row")))), lambda x: x["row"]), "")
    pages = read(spark, sf_dir, "part").groupBy(page.alias("page_id"), (page % 5).alias("site"), order.alias("page_ord")).agg(rows.alias("rows"))
    title = F.concat(F.lit("<h2>Розділ "), F.col("page_id").cast("string"), F.lit("</h2><table>"))
    return pages.select(
        "page_id", F.concat(F.lit("site"), F.col("site").cast("string")).alias("site"), "page_ord", F.concat(F.lit("https://site"), F.col("site").cast("string"), F.lit(".example/"), F.col("page_ord").cast("string")).alias("url"),
        F.concat(title, "rows", F.lit("</table>")).alias("html"),
    )


def site_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One site's price list: every third part (a site offers a share of all works), its price
    a little above the catalogue's."""
    c = catalogue(spark, sf_dir).where(F.col("ord") % 3 == 0)
    return c.select("ord", "name", "unit", (F.col("labor") + F.lit("10.50").cast("decimal(6,2)")).cast(MONEY).alias("price"), "category", F.lit("site").alias("site"))
