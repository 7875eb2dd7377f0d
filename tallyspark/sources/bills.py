"""Bills of quantities as tables of cells or of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions import text as T

# fixed values: lines of the print form that carry no content, and the code of a document
FOOTER = "Програмний комплекс"
NOISE = (
    r"^(?:\s*\d+\s*$|\s*1\s+2\s+3\s+4\s+5\s*$|Додаток\s|до ДБН|затверджений|Мінрегіонбуд|від \d{2}\.\d{2}\.\d{4}|"
    r"\s*№\s*$|п/п\s|вимір[уy]\s|\[посада)"
)
NOISE_STARTS = list("0123456789ДдзМв№п[")  # first letters of NOISE
CODE = r"(?U)\b(\d{2,5}[_-][А-ЯЇІЄҐA-Z]{1,5}[_-][А-ЯЇІЄҐA-Z]{2,6})\b"


#: A quoted part: doubled quotes inside stand for one. No part of it is tried twice.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
#: A line of a text that starts with a line end; quotes at the start of a cell hold line ends and delimiters.
_LINE = rf'\n([^\n"]*+(?:(?:(?<=[\n;,\t]){_QUOTED}|")[^\n"]*+)*+)'


def _cells(line: Column, delimiter: str) -> Column:
    """Cells of a line; a cell that starts with a quote goes to the quote that closes it."""
    d = F.lit(delimiter)
    raw = F.regexp_extract_all(F.concat(d, line), F.lit(rf"{delimiter}((?:{_QUOTED})?+[^{delimiter}]*+)"), F.lit(1))
    plain = lambda c: F.replace(F.regexp_replace(c, r'(?s)^"([^"]*+(?:""[^"]*+)*+)"?+', "$1"), F.lit('""'), F.lit('"'))
    return F.transform(raw, lambda c: F.when(F.startswith(c, F.lit('"')), plain(c)).otherwise(c))


def split_cells(lines: DataFrame) -> DataFrame:
    """Lines of delimited text -> cells. lines: doc_id, row_no, line. The delimiter of a
    document is the one of ; , tab that its first line has most of outside quotes, ; if none.
    Cells may be quoted, with delimiters and doubled quotes inside."""
    order = Window.partitionBy("doc_id").orderBy("row_no")
    lines = T.compose_all(lines, "line").withColumn("is_first", F.lag("row_no").over(order).isNull())
    first = F.regexp_replace("line", _QUOTED, "")
    n = lambda c, d: F.length(c) - F.length(F.replace(c, F.lit(d), F.lit("")))
    best = lambda h: F.when((n(h, ";") >= n(h, ",")) & (n(h, ";") >= n(h, "\t")), ";").when(n(h, ",") >= n(h, "\t"), ",").otherwise("\t")
    lines = lines.withColumn("delimiter", F.when(F.col("is_first"), T.let(first, best)))
    lines = lines.withColumn("delimiter", F.first("delimiter", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    line = F.col("line")
    cells = F.when(F.col("delimiter") == ";", _cells(line, ";")).when(F.col("delimiter") == ",", _cells(line, ",")).otherwise(_cells(line, "\t"))
    return clean_cells(T.computed(lines.select("doc_id", "row_no", "line", "delimiter"), cells=cells).select("doc_id", "row_no", "cells"))


def clean_cells(rows: DataFrame) -> DataFrame:
    """Cells cleaned, rows without any text gone."""
    return rows.where(F.array_join("cells", "").rlike(r"(?U)\S")).withColumn("cells", T.clean_all(F.col("cells")))


def text_lines(texts: DataFrame) -> DataFrame:
    """doc_id, row_no, line of whole texts (doc_id, text); a quoted cell may go over lines."""
    text = F.concat(F.lit("\n"), F.replace(F.regexp_replace("text", "^\ufeff", ""), F.lit("\r\n"), F.lit("\n")))
    return texts.select("doc_id", F.posexplode(F.regexp_extract_all(text, F.lit(_LINE), F.lit(1))).alias("row_no", "line"))


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """Files of delimited text, a document each."""
    return split_cells(text_lines(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))))


def marked_lines(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, line (cleaned), content, doc_code: lines with any text; whether one is content, and the code
    that a footer has. Footers and the print form are no content. lines: doc_id, line_no, line."""
    line = F.col("line")
    # Each line is cleaned once: Spark does not move filters below the composing, whose function it does not know.
    clean = lines.select("doc_id", "line_no", F.when(T.plain(line), F.rtrim(line)).otherwise(T.soft_clean_once(T.composed(line))).alias("line")).where(F.trim("line") != "")
    footer = F.contains("line", F.lit(FOOTER))
    first = T.first_letter(line)
    left = F.when(first.isNotNull(), F.ltrim("line")).otherwise(F.regexp_replace("line", r"(?U)^\s+", ""))
    noise = F.coalesce(first.isin(NOISE_STARTS), F.lit(True)) & left.rlike(NOISE)  # the right end is trimmed
    return clean.select("doc_id", "line_no", "line", (~footer & ~noise).alias("content"), F.when(footer, F.nullif(F.regexp_extract("line", CODE, 1), F.lit(""))).alias("doc_code"))


def content_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines with content, code of each document). lines: doc_id, line_no, line.

    The code comes from the first footer that has one; footers and the print form go.
    """
    marked = marked_lines(lines)
    codes = marked.where("doc_code is not null").groupBy("doc_id").agg(F.min_by("doc_code", "line_no").alias("doc_code"))
    return marked.where("content").select("doc_id", "line_no", "line"), codes
