"""The rows of a printed estimate, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TITLE = "Локальний кошторис"


def report_rows(positions: DataFrame, title: str = TITLE) -> DataFrame:
    """Headers, positions and totals of each object as one ordered table.

    positions: object_id, estimate_ord, estimate_code, estimate_title, division_ord,
    division_code, division_title, number, name, unit, quantity, unit_price, total. One
    grouping-sets pass gives the totals of divisions and estimates; row_no is left to the
    reader's sort by (object_id, estimate_ord, division_ord, place, number).
    """
    head = F.when(F.col("division_code") != "", F.concat(F.lit("Розділ "), "division_code", F.lit(". "), "division_title")).otherwise(F.col("division_title"))
    named = F.trim(F.concat_ws(" ", F.nullif("estimate_code", F.lit("")), F.nullif("estimate_title", F.lit(""))))
    p = positions.withColumns({"head": F.trim(head), "e_title": named})
    order = ["object_id", "estimate_ord", "division_ord"]
    sums = p.groupingSets(
        [[F.col(c) for c in ("object_id", "estimate_ord", "e_title")], [F.col(c) for c in ("object_id", "estimate_ord", "e_title", "division_ord", "head", "division_title")]],
        *(F.col(c) for c in ("object_id", "estimate_ord", "e_title", "division_ord", "head", "division_title")),
    ).agg(F.sum("total").cast("decimal(38,2)").alias("total"), F.grouping("division_ord").alias("whole"))
    whole, part = F.col("whole") == 1, (F.col("whole") == 0) & (F.col("head") != "")
    row = lambda kind, place, text, total: F.struct(F.lit(kind).alias("kind"), F.lit(place).alias("place"), text.alias("name"), total.alias("total"))
    none = F.lit(None).cast("decimal(38,2)")
    rows = F.when(
        whole, F.array(row("estimate", 0, F.trim(F.concat_ws(" ", F.lit(title), F.nullif("e_title", F.lit("")))), none), row("estimate_total", 9, F.trim(F.concat(F.lit("Разом по кошторису "), "e_title")), F.col("total")))
    ).when(part, F.array(row("division", 1, F.col("head"), none), row("division_total", 3, F.concat(F.lit("Разом по розділу «"), "division_title", F.lit("»")), F.col("total"))))
    # The estimate's own rows come before and after all of its divisions.
    marks = sums.where(whole | part).select(*order, F.inline(rows))
    marks = marks.withColumn("division_ord", F.when(F.col("kind") == "estimate", -1).when(F.col("kind") == "estimate_total", 2147483647).otherwise(F.col("division_ord")).cast("int"))
    empty = {"number": "int", "unit": "string", "quantity": "decimal(18,6)", "unit_price": "decimal(28,2)"}
    marks = marks.withColumns({c: F.lit(None).cast(t) for c, t in empty.items()})
    body = p.select(*[F.col(c) for c in order], F.lit("position").alias("kind"), F.lit(2).alias("place"), "name", F.col("total").cast("decimal(38,2)").alias("total"), *(F.col(c).cast(t).alias(c) for c, t in empty.items()))
    # Each object's rows stand together and in order; objects need none among themselves.
    return body.unionByName(marks).repartition("object_id").sortWithinPartitions("object_id", "estimate_ord", "division_ord", "place", "number")


def header_lines(objects: DataFrame, day: str) -> DataFrame:
    """object_id, ord, line: what stands above an estimate; empty fields give no line."""
    text = lambda c: F.coalesce(c, F.lit(""))
    with_label = lambda label, c: F.when(text(F.col(c)) != "", F.concat(F.lit(label), c)).otherwise("")
    place = F.concat_ws(", ", F.nullif("city", F.lit("")), F.nullif("region", F.lit("")))
    lines = F.array(
        text(F.col("name")), with_label("Адреса: ", "address"), F.when(place != "", F.concat(F.lit("Місце будівництва: "), place)).otherwise(""),
        with_label("Замовник: ", "customer"), with_label("Шифр: ", "doc_code"), F.lit(f"Складено станом на {day}"),
    )
    return objects.select("object_id", F.posexplode(F.filter(lines, lambda x: x != "")).alias("ord", "line"))
