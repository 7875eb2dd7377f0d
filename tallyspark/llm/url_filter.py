"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes.

A rule is a host with a path, such as ``example.com/en/``; it fits its host and all
subdomains of it if the path of the url starts with the rule's. Each distinct url (host
and path) is expanded into its host suffixes; those that are a rule's host are expanded
into the path prefixes of the lengths that rules of that host have, so every rule that
fits is met by equality. Both joins go by the first 32 bits of a SHA-256, and full digests
confirm. The longest rule wins, and block wins over allow where one rule is given with
both. All of it is DataFrame operations; of the rules, only the greatest number of labels
comes to the driver.

Defined results: a null url, or one without ://, has an empty host and path, no rule and
the default verdict; rows that repeat a url each get its verdict; a null page_id stays;
other columns are ignored; an empty table gives an empty result, empty rules the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Hexadecimal digits of a digest that the join goes by.
SHORT = 8
#: The rules of the registered query: (action, host, path).
RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def _hashed(df: DataFrame, column: str, digest: str) -> DataFrame:
    """Adds the column's digest and the digest's short prefix."""
    return df.withColumn(digest, F.sha2(column, 256)).withColumn("short", F.substring(digest, 1, SHORT))


def digested(rules: DataFrame) -> DataFrame:
    """rules: action, host, path. rule_host, labels, len, rule, action: each distinct rule once."""
    host = F.translate("host", UPPER, LOWER)
    return (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & (F.col("host") != ""))
        .select("action", host.alias("rule_host"), F.concat(host, F.col("path")).alias("rule"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("len"))
        .groupBy("rule_host", "rule", "labels", "len").agg(F.max("action").alias("action"))  # block comes after allow
    )


def expressions(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, suffix, expr: a url's host suffixes that are hosts of rules, with the path
    prefixes of the lengths that those rules have."""
    most = rules.agg(F.max("labels")).first()[0]
    hosts = _hashed(rules.groupBy("rule_host").agg(F.collect_set("len").alias("lens")), "rule_host", "digest")
    n = F.size("l")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(most))), lambda k: F.concat_ws(".", F.slice("l", F.size("l") - k + 1, k)))
    split = urls.select("host", "path", F.split("host", r"\.").alias("l"))
    split = _hashed(split.select("host", "path", F.explode(suffixes).alias("suffix")), "suffix", "full")
    met = split.join(hosts, "short").where(F.col("full") == F.col("digest"))
    return (
        met.select("host", "path", "suffix", F.explode(F.filter("lens", lambda n: n <= F.length("path"))).alias("len"))
        .select("host", "path", "suffix", F.concat("suffix", F.expr("substring(path, 1, len)")).alias("expr"))
    )


def judge(pages: DataFrame, rules: DataFrame | list | None = None, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict: one row per row of pages."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(RULES if rules is None else rules, "action string, host string, path string")
    rows = pages.select("page_id", host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"))
    rules = digested(rules)
    if rules.isEmpty():
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    found = _hashed(expressions(rows.select("host", "path").distinct(), rules), "expr", "full")
    # A rule and an expression of equal text are the same if their hosts are too.
    fits = (F.col("full") == F.col("digest")) & (F.col("suffix") == F.col("rule_host"))
    # No broadcast is asked for: Spark compares the rules' size with its threshold.
    best = (
        found.join(_hashed(rules, "rule", "digest"), "short").where(fits)
        .groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "labels", "action", "rule")).alias("best"))
    )
    # Written, so that the join deals both sides anew and can split a url with very many pages; a
    # merge join, since the urls grow with the pages.
    best = written(best.select("host", "path", "best.rule", "best.action"), "judged")
    return rows.join(best.hint("merge"), ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))
