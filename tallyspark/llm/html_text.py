"""Main text of pages: a suffix array of each host, with markup as the check of what it says.

The word streams of a host's pages, outside articles, are concatenated. Substrings of RUN
words or more that occur on two or more distinct pages are boilerplate; the words that they
cover are removed and unique runs stay, in page order. Markup corrects the array where the
two differ: an article stays whole (articles may quote and repeat each other), and so does
the main element of a page without articles; of blocks that markup tells as furniture
(menus, headers, footers, sidebars, notices, adverts, forms, comments), the words that
occur on one page only go as well. ``n_repeated`` and ``n_marked`` count the words of a page
that the array and that markup alone removed.

The array is dealt in blocks of pages. A block is sorted by prefix doubling down to RUN
words, so suffixes of equal rank share a run; it sends one row for each distinct run of a
host, with its least and greatest page, and those are combined over all blocks. A word is
covered by a repeated substring of RUN words or more exactly if it is covered by a repeated
run of RUN words, since each run of such a substring repeats on the same two pages; so the
cover is that of all maximal repeats, and it does not depend on how pages are dealt. Runs
are compared by 128-bit hashes of host and words; no text moves for them, and a host with a
third of all pages is spread like any other.

A page goes by a 128-bit hash of its row, so nothing has to be stored to name it: the
blocks that the array judges, a small part of a page, are written once, and the last pass
reads the pages again rather than a copy of their texts.

Defined results: null html gives an empty text; pages without a host (null url) form a host
of their own; rows that are equal in page_id, url and html are one page to the array, and
each gives a row of the result; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import by_batch, record, written
from tallyspark.llm.markup import ARTICLE, FURNITURE, MAIN, blocks_of

#: Words of a run; pages of a block of the array.
RUN, BLOCK_PAGES = 8, 2048
_END = ""  # fills up blocks of fewer words

HOST = r"(?s)^.*?://([^/?#]*)"
#: What becomes of a block: it stays whole, its unique runs stay, all of it goes.
STAYS, OPEN, GOES = 0, 1, 2


def _told(html: str | None) -> tuple[list[str], list[int]]:
    """The blocks of a page and what markup says of them."""
    blocks = blocks_of(html)
    whole = ARTICLE if any(p == ARTICLE for p, _ in blocks) else MAIN
    return [t for _, t in blocks], [STAYS if p == whole else GOES if p == FURNITURE else OPEN for p, _ in blocks]


def _judged(batch: pa.RecordBatch) -> pa.RecordBatch:
    """page, host, blocks: the blocks that the array judges."""
    names = {"page": pa.binary(), "host": pa.string(), "blocks": pa.list_(pa.string())}
    blocks = [[t for t, told in zip(*_told(html), strict=True) if told != STAYS] for html in batch.column("html").to_pylist()]
    return record(names, page=batch.column("page"), host=batch.column("host"), blocks=blocks)


def _parsed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """All blocks of pages, of those that go only the number of words."""
    names = {"page": pa.binary(), "page_id": pa.int64(), "url": pa.string(), "blocks": pa.list_(pa.string()), "gone": pa.list_(pa.int32()), "judged": pa.list_(pa.bool_())}
    out = {k: [] for k in ("blocks", "gone", "judged")}
    for html in batch.column("html").to_pylist():
        texts, told = _told(html)
        out["blocks"].append([t for t, x in zip(texts, told, strict=True) if x != GOES])
        out["gone"].append([len(t.split()) if x == GOES else -1 for t, x in zip(texts, told, strict=True) if x != STAYS])
        out["judged"].append([x != STAYS for x in told if x != GOES])
    return record(names, page=batch.column("page"), page_id=batch.column("page_id"), url=batch.column("url"), **out)


def _padded(block: str) -> list[str]:
    words = block.split()
    return words + [_END] * (RUN - len(words))


def run_hash(host: str, words: list[str]) -> bytes:
    return xxhash.xxh3_128_digest("\n".join([host, *words]).encode("utf-8", "surrogatepass"))


def suffix_ranks(stream: np.ndarray, depth: int = RUN) -> np.ndarray:
    """Ranks of the suffixes by their first words, depth being a power of two."""
    rank = stream.astype(np.int64)
    step = 1
    while step < depth:
        after = np.zeros_like(rank)
        after[:-step] = rank[step:] + 1
        order = np.lexsort((after, rank))
        new = np.r_[False, (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])]
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(new)
        step *= 2
    return rank


_RUNS = {"run": pa.binary(), "least": pa.binary(), "most": pa.binary()}


def _runs_of_block(batch: pa.RecordBatch) -> pa.RecordBatch:
    """run, least, most: distinct runs of the hosts of a block of pages, with their least and greatest page."""
    rows = sorted(batch.to_pylist(), key=lambda r: r["page"])
    names = sorted({r["page"] for r in rows})
    number = {k: i for i, k in enumerate(names)}
    words, page, start, host, ids, hosts = [], [], [], [], {}, {}
    for row in rows:
        of = hosts.setdefault(row["host"], len(hosts))
        for block in row["blocks"]:
            w = _padded(block)
            words += [ids.setdefault(x, len(ids) + 1) for x in w] + [0]
            start += [True] * (len(w) - RUN + 1) + [False] * RUN
            page += [number[row["page"]]] * (len(w) + 1)
            host += [of] * (len(w) + 1)
    at = np.flatnonzero(start)
    if not len(at):
        return record(_RUNS, run=[], least=[], most=[])
    rank = suffix_ranks(np.array(words, np.int64))[at]
    page, host = np.array(page, np.int64)[at], np.array(host, np.int64)[at]
    order = np.lexsort((page, host, rank))
    rank, page, host, at = rank[order], page[order], host[order], at[order]
    first = np.flatnonzero(np.r_[True, (rank[1:] != rank[:-1]) | (host[1:] != host[:-1])])
    last = np.r_[first[1:], len(at)] - 1
    texts, of = [_END, *ids], list(hosts)
    runs = [run_hash(of[h], [texts[k] for k in words[i : i + RUN]]) for i, h in zip(at[first].tolist(), host[first].tolist(), strict=True)]
    return record(_RUNS, run=runs, least=[names[k] for k in page[first].tolist()], most=[names[k] for k in page[last].tolist()])


def repeated_runs(judged: DataFrame) -> DataFrame:
    """run: hashes of the runs that occur on two or more distinct pages of a host."""
    runs = by_batch(judged, _runs_of_block, "run binary, least binary, most binary", rows=BLOCK_PAGES)
    return runs.groupBy("run").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least < most").select("run")


def _places(batch: pa.RecordBatch) -> pa.RecordBatch:
    """page, block, at, run: each place of each run."""
    names = {"page": pa.binary(), "block": pa.int32(), "at": pa.int32(), "run": pa.binary()}
    out = {k: [] for k in names}
    for row in batch.to_pylist():
        for b, text in enumerate(row["blocks"]):
            w = _padded(text)
            n = len(w) - RUN + 1
            out["page"] += [row["page"]] * n
            out["block"] += [b] * n
            out["at"] += range(n)
            out["run"] += [run_hash(row["host"], w[i : i + RUN]) for i in range(n)]
    return record(names, **out)


def _unique(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Pages without what the array covers and what else is furniture."""
    names = {"page_id": pa.int64(), "url": pa.string(), "text": pa.string(), "n_repeated": pa.int64(), "n_marked": pa.int64()}
    texts, repeated, marked = [], [], []
    for r in batch.to_pylist():
        covered: dict[int, set[int]] = {}
        for c in r["covered"] or ():
            covered.setdefault(c["block"], set()).update(range(c["at"], c["at"] + RUN))
        number = (b for b, n in enumerate(r["gone"]) if n < 0)  # judged blocks that do not go, in order
        n_repeated, stay = 0, []
        for text, judged in zip(r["blocks"], r["judged"], strict=True):
            if judged:
                words, gone = text.split(), covered.get(next(number), ())
                left = [x for i, x in enumerate(words) if i not in gone]
                n_repeated, text = n_repeated + len(words) - len(left), " ".join(left)
            if text:
                stay.append(text)
        by_array = sum(sum(i < n for i in covered.get(b, ())) for b, n in enumerate(r["gone"]))
        texts.append(" ".join(stay))
        repeated.append(n_repeated + by_array)
        marked.append(sum(n for n in r["gone"] if n > 0) - by_array)
    return record(names, page_id=batch.column("page_id"), url=batch.column("url"), text=texts, n_repeated=repeated, n_marked=marked)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_repeated, n_marked: one row per row of pages."""
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    page = F.unhex(F.md5(F.to_json(F.struct("page_id", "url", F.md5("html").alias("html")))))
    host = F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit(""))
    named = given.withColumns({"page": page, "host": host})
    judged = written(by_batch(named.select("page", "host", "html"), _judged, "page binary, host string, blocks array<string>", rows=200), "judged", "zstd")
    runs = written(repeated_runs(judged), "runs")
    places = by_batch(judged, _places, "page binary, block int, at int, run binary")
    # Merge joins: runs grow with the pages, and adaptive execution splits a run that very many pages hold.
    covered = places.join(runs.hint("merge"), "run", "left_semi").groupBy("page").agg(F.collect_set(F.struct("block", "at")).alias("covered"))
    parsed = by_batch(named.select("page", "page_id", "url", "html"), _parsed, "page binary, page_id long, url string, blocks array<string>, gone array<int>, judged array<boolean>", rows=200)
    joined = parsed.join(covered.hint("merge"), "page", "left").select("page_id", "url", "blocks", "gone", "judged", "covered")
    done = by_batch(joined, _unique, "page_id long, url string, text string, n_repeated long, n_marked long")
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated", "n_marked")
