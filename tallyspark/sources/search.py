"""Answers of search services as one table of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import compose_all

#: provider -> (schema of the answer, path of the results, columns of title, snippet, url)
SHAPES = {
    "serpapi": ("organic_results array<struct<title:string,snippet:string,link:string>>", "organic_results", ("title", "snippet", "link")),
    "brave": ("web struct<results:array<struct<title:string,description:string,url:string>>>", "web.results", ("title", "description", "url")),
    "google": ("items array<struct<title:string,snippet:string,link:string>>", "items", ("title", "snippet", "link")),
    "custom": ("results array<struct<title:string,snippet:string,url:string>>", "results", ("title", "snippet", "url")),
}


def _row(keys):
    columns = list(zip(keys, ("title", "snippet", "url"), strict=True))
    return lambda r: F.struct(*(F.coalesce(r[a], F.lit("")).alias(b) for a, b in columns))


def search_results(answers: DataFrame) -> DataFrame:
    """answers: provider, answer (JSON) and other columns, which stay. Adds rank from 1,
    title, snippet, url; missing keys are empty, answers without results give no row."""
    one = "array<struct<title:string,snippet:string,url:string>>"
    found = F.lit(None).cast(one)
    for name, (schema, path, keys) in SHAPES.items():
        parsed = F.from_json("answer", schema)
        for step in path.split("."):
            parsed = parsed[step]
        found = F.when(F.col("provider") == name, F.transform(parsed, _row(keys))).otherwise(found)
    rest = [c for c in answers.columns if c != "answer"]
    rows = answers.select(*rest, F.posexplode(found).alias("_at", "r")).select(*rest, (F.col("_at") + 1).alias("rank"), "r.*")
    return compose_all(rows, "title", "snippet")


def search_text(name: Column, unit: Column, city: Column, region: Column) -> Column:
    given = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    place = F.coalesce(given(city), given(region), F.lit("Україна"))
    return F.format_string("%s ціна %s грн за %s", name, place, F.coalesce(given(unit), F.lit("одиницю")))
