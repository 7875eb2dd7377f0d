"""Secret scans with an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its content. The ledger, a
Parquet table in append mode, has a row for each scan of a blob: the rule versions that
were applied and the spans that they found. A scan takes only pairs of blob and rule
version that the ledger lacks, each blob once however many paths hold it, and joins the
findings back to all paths.

Spans are in code points, end exclusive; of each kind leftmost ones that do not overlap.
Base kinds: assign, access, hex. The others add well-known token shapes.

Defined results: a null text counts as empty and has no spans; rows that repeat a path
are paths of their own; a null path stays; columns other than path and text are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import by_batch, record, shared_dir, with_row_id, written

#: kind -> (version, pattern, group whose length counts, least length), in the order in
#: which kinds are listed. A match that is too short is dropped, not tried again.
RULES: dict[str, tuple[int, str, int, int]] = {
    "assign": (1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (1, r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (1, r"[0-9a-f]{32,}", 0, 32),
    "pem": (1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 0),
    "github": (1, r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    "slack": (1, r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    "google": (1, r"(?<![A-Za-z0-9])AIza[0-9A-Za-z_-]{35}", 0, 0),
    "jwt": (1, r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    "basic": (1, r"[A-Za-z][A-Za-z0-9+.-]{0,15}://[^\s/:@?#]{1,64}:[^\s/:@?#]{3,64}@", 0, 0),
}
BASE = ("assign", "access", "hex")
#: A literal that each match of the rule holds, lower-cased where case is free; texts without it are passed over.
_HOLDS = {"access": "AKIA", "pem": "PRIVATE KEY", "slack": "xox", "google": "AIza", "jwt": "eyJ", "basic": "://"}

SPAN = "array<struct<kind:string,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def rule_versions(rules=RULES) -> list[str]:
    return [f"{kind}@{version}" for kind, (version, *_) in rules.items()]


def compiled(rules=RULES) -> dict:
    return {kind: (re.compile(pattern, re.ASCII), group, least) for kind, (_, pattern, group, least) in rules.items()}


def find_spans(text: str, kinds, patterns: dict) -> list[dict]:
    out = []
    for kind in kinds:
        pattern, group, least = patterns[kind]
        if _HOLDS.get(kind, "") in text:
            out += [{"kind": kind, "start": m.start(), "end": m.end()} for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return out


#: Blobs to scan that are sent to all tasks, so that other texts need not move (64 bytes each).
FEW_BLOBS = 200_000


def scan(versions: DataFrame, ledger: str, rules=RULES) -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger lacks. versions: path, text.

    Returns (paths: _row, path, blob; findings: blob, spans). The ledger is a path; it is
    made if it is not there. Findings cover every blob of versions, in array order of the rules.
    """
    spark = versions.sparkSession
    wanted = rule_versions(rules)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = versions.select(F.col("path"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("blob"))
    paths = written(with_row_id(rows.select("path", "blob")), "paths")
    schema = f"blob binary, rules array<string>, spans {SPAN}"
    spark.createDataFrame([], schema).write.mode("append").parquet(ledger)
    seen = spark.read.schema(schema).parquet(ledger)
    # Of the ledger only the blobs that are asked for: its history costs a read of digests.
    asked = written(paths.select("blob").distinct(), "asked")
    done = seen.join(asked, "blob", "left_semi").groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("done"))
    every = F.array(*map(F.lit, wanted))
    # What is to do is found out by digests alone; no text moves for a blob that the ledger has.
    left = asked.join(done, "blob", "left").select("blob", F.array_except(every, F.coalesce("done", F.array().cast("array<string>"))).alias("todo"))
    left = written(left.where(F.size("todo") > 0), "todo")
    few = left.limit(FEW_BLOBS + 1).count() <= FEW_BLOBS
    left = F.broadcast(left) if few else left
    texts = rows.join(left, "blob") if few else rows
    # First copies are picked before the shuffle, so a blob with very many paths is no hot key.
    blobs = texts.groupBy("blob").agg(F.first("text").alias("text"))
    todo = blobs.join(left, "blob").select("blob", "text", "todo")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        patterns = compiled(rules)
        pending = batch.column("todo").to_pylist()
        spans = [find_spans(t, [r.split("@")[0] for r in k], patterns) for t, k in zip(batch.column("text").to_pylist(), pending, strict=True)]
        kinds = {"blob": pa.binary(), "rules": pa.list_(pa.string()), "spans": _SPANS}
        return record(kinds, blob=batch.column("blob"), rules=pending, spans=spans)

    by_batch(todo, run, schema).write.mode("append").parquet(ledger)
    ledger_now = spark.read.schema(schema).parquet(ledger).where(F.size("spans") > 0).join(asked, "blob", "left_semi")
    findings = ledger_now.select("blob", F.posexplode("rules").alias("_", "rule"), "spans").where(F.col("rule").isin(wanted))
    findings = findings.select("blob", F.explode(F.expr("filter(spans, s -> s.kind = substring_index(rule, '@', 1))")).alias("s")).groupBy("blob").agg(F.collect_set("s").alias("spans"))
    return paths, written(findings, "findings")


def in_order(spans: Column, kinds=tuple(RULES)) -> Column:
    """Spans by start, then by kind as listed."""
    rank = F.array(*map(F.lit, kinds))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(keyed)


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def secrets_by_path(versions: DataFrame, ledger: str | None = None, rules=RULES) -> DataFrame:
    """path, spans (array of start, rank, end, kind in order): one row per row of versions."""
    paths, findings = scan(versions, ledger or shared_dir(versions.sparkSession, "ledger"), rules)
    none = F.array().cast(SPAN)
    return paths.join(findings, "blob", "left").select("path", in_order(F.coalesce("spans", none), tuple(rules)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and all spans as text."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        F.col("path").alias("doc_id"),
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(as_text(base), 256).alias("base_sha256"),
        as_text(F.col("spans")).alias("spans"),
    )
