"""Embedding whitening by the exact characteristic polynomial of the integer scatter.

Entries become integers, x = floor(256 c). Over the fit list, each distinct x once, the
scatter n * sum(x x') - S S' is an integer matrix. Tasks add up its parts exactly; Spark
sums them. Its characteristic polynomial is found modulo primes, one Hessenberg reduction a
prime, dealt to tasks, and put together by Chinese remaindering, a coefficient a group. All
roots of a scatter are real, so by the rule of signs the sign changes of the polynomial's
shift by t count the roots above t exactly, repeated ones too: bisection on that count
isolates each of the largest roots, to GUARD bits beyond doubles. Components are null vectors
of scatter - root: inverse iteration in integers of fixed point, orthogonal to the
components before. Only matrices of dimension x dimension meet on the driver.

Defined results: rows with a null vector or a null or non-finite entry are dropped, and
so are those of another dimension than most rows have (of equally many, the larger one);
rows that repeat a vec_id or a vector are rows of their own (the fit list has a vector once);
components of variance zero cannot be scaled and have no rows; deviation is null where it
does not fit a long; entries beyond the range of long are cut to it; other columns are
ignored; an empty table, or one of one distinct vector, gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import written

SCALE, COMPONENTS = 256, 4
#: Bits of an integer that one exact product in doubles takes; rows of one such product.
LIMB_BITS, BLOCK_ROWS = 20, 4096
#: Sums travel in words of so many bits, so that a long holds the sum of 2**30 parts.
WORD_BITS, WORDS = 32, 6
#: Bits of roots and components beyond the size of the numbers themselves.
GUARD = 192


def integers(df: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, x (array of long): the rows that can be used, written; their dimension, 0 if there are none)."""
    whole = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    rows = df.where(F.col(column).isNotNull() & (F.size(column) > 0)).where(whole)
    most = float(2**63 - 1)
    x = F.transform(column, lambda c: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), c.cast("double") * SCALE))).cast("long"))
    rows = written(rows.select("vec_id", x.alias("x")), "integers")
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (rows, 0) if usual is None else (rows.where(F.size("x") == usual["d"]), usual["d"])


def matrix_of(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def exact_products(x: np.ndarray) -> np.ndarray:
    """x' x of integers as Python integers, by products of limbs that doubles hold exactly."""
    d = x.shape[1]
    top = max(abs(int(x.max())), abs(int(x.min()))) if len(x) else 0
    limbs, rest = [], x
    for _ in range(max(1, math.ceil((top.bit_length() + 1) / LIMB_BITS)) - 1):
        limbs.append((rest & ((1 << LIMB_BITS) - 1)).astype(np.float64))
        rest = rest >> LIMB_BITS
    limbs.append(rest.astype(np.float64))
    total = np.zeros((d, d), object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            part = np.zeros((d, d), np.int64)  # fewer than 2**10 blocks a batch
            for at in range(0, len(x), BLOCK_ROWS):
                part += (a[at : at + BLOCK_ROWS].T @ b[at : at + BLOCK_ROWS]).astype(np.int64)
            total += part.astype(object) << (LIMB_BITS * (i + j))
    return total


def _words(values: np.ndarray) -> list[np.ndarray]:
    """Python integers as WORDS words, the last one signed."""
    mask, out = (1 << WORD_BITS) - 1, []
    for _ in range(WORDS - 1):
        out.append((values & mask).astype(np.int64))
        values = values >> WORD_BITS
    return [*out, values.astype(np.int64)]


def scatter(fit: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """n, sums (Python integers), n * sum(x x') - S S' (Python integers) of distinct vectors."""
    upper, names = np.triu_indices(d + 1), ["i", "j", *(f"w{k}" for k in range(WORDS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1), object)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS << 8):
                x = matrix_of(batch.slice(at, BLOCK_ROWS << 8).column(0), d)
                total += exact_products(np.c_[x, np.ones(len(x), np.int64)])  # the last row: sums and n
        arrays = [upper[0].astype(np.int64), upper[1].astype(np.int64), *_words(total[upper])]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=names)

    parts = fit.select("x").mapInArrow(run, ", ".join(f"{c} long" for c in names))
    m = np.zeros((d + 1, d + 1), object)
    for r in parts.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in names[2:])).collect():
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = sum(r[f"w{k}"] << (WORD_BITS * k) for k in range(WORDS))
    n, sums = m[d, d], m[d, :d]
    return n, sums, n * m[:d, :d] - np.outer(sums, sums)


def primes(count: int) -> list[int]:
    """The largest primes below 2**31."""
    def prime(n: int) -> bool:
        odd, twos = n - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for base in (2, 3, 5, 7):  # enough below 3.2 * 10**9
            x = pow(base, odd, n)
            if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
                return False
        return True

    out, n = [], (1 << 31) - 1
    while len(out) < count:
        if prime(n):
            out.append(n)
        n -= 2
    return out


def polynomial_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(t - matrix) modulo p, the constant first: reduction to Hessenberg form."""
    a = np.array(matrix % p, np.int64)
    d = len(a)
    for m in range(1, d - 1):
        full = np.flatnonzero(a[m:, m - 1])
        if not len(full):
            continue
        k = m + int(full[0])
        if k != m:
            a[[m, k]], a[:, [m, k]] = a[[k, m]], a[:, [k, m]]
        factors = a[m + 1 :, m - 1] * pow(int(a[m, m - 1]), -1, p) % p
        a[m + 1 :] = (a[m + 1 :] - factors[:, None] * a[m] % p) % p
        a[:, m] = (a[:, m] + (a[:, m + 1 :] * factors % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        new = np.zeros(d + 1, np.int64)
        new[1:] = polys[k - 1, :-1]
        weights, below = np.zeros(k, np.int64), 1
        for i in range(k - 1, -1, -1):  # column k - 1 above the diagonal, times the entries below it in between
            weights[i] = a[i, k - 1] * below % p
            below = below * int(a[i, i - 1]) % p if i else below
        polys[k] = (new - (weights[:, None] * polys[:k] % p).sum(axis=0)) % p
    return polys[d]


def characteristic_polynomial(spark, matrix: np.ndarray) -> list[int]:
    """Exact coefficients of det(t - matrix), the constant first, of a symmetric matrix without
    negative roots. A coefficient is at most binom(d, k) * (trace / d)**k: primes for twice that."""
    d, trace = len(matrix), int(sum(matrix.diagonal()))
    bound = max(math.comb(d, k) * (-(-(trace**k) // d**k)) for k in range(d + 1))
    chosen = primes((2 * bound).bit_length() // 30 + 2)
    shared = spark.sparkContext.broadcast(matrix)  # d x d, whatever the number of rows

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p in pdf["p"]:
                yield pd.DataFrame({"p": p, "k": range(d + 1), "residue": polynomial_mod(shared.value, int(p))})

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        value, modulus = 0, 1
        for p, r in zip(pdf["p"].tolist(), pdf["residue"].tolist(), strict=True):
            value += modulus * ((r - value) * pow(modulus, -1, p) % p)
            modulus *= p
        value -= modulus if 2 * value > modulus else 0
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "value": [hex(value)]})

    # A row a prime: dealt evenly to all cores.
    tasks = min(len(chosen), 2 * spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame([(p,) for p in chosen], "p long").repartition(tasks)
    found = rows.mapInPandas(reduced, "p long, k int, residue long").groupBy("k").applyInPandas(joined, "k int, value string")
    return [int(r["value"], 16) for r in sorted(found.collect(), key=lambda r: r["k"])]


def _shifted(poly: list[int], at: int) -> list[int]:
    """Coefficients of poly(t + at)."""
    out = poly[:]
    for i in range(len(out) - 1):
        for k in range(len(out) - 2, i - 1, -1):
            out[k] += at * out[k + 1]
    return out


def roots_above(poly: list[int], at: int) -> int:
    """Roots above `at`, counted as often as they repeat, of a polynomial whose roots are all
    real: the sign changes of the coefficients of its shift (rule of signs)."""
    signs = [c > 0 for c in _shifted(poly, at) if c]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _value(poly: list[int], at: int) -> int:
    total = 0
    for c in reversed(poly):
        total = total * at + c
    return total


def largest_roots(poly: list[int], count: int, bits: int) -> list[int]:
    """Floors of the largest positive roots times 2**bits, largest first."""
    d = len(poly) - 1
    scaled = [c << (bits * (d - k)) for k, c in enumerate(poly)]  # its roots are 2**bits as large
    top = 1 << (abs(scaled[d - 1]).bit_length() + 1) if d else 1  # above the sum of the roots
    positive, out = roots_above(scaled, 0), []
    for k in range(1, min(count, positive) + 1):
        low, high = 0, top
        n_low, n_high = positive, 0
        while high - low > 1 and not (n_low == k and n_high == k - 1):
            mid = (low + high) // 2
            n = roots_above(scaled, mid)
            low, high, n_low, n_high = (mid, high, n, n_high) if n >= k else (low, mid, n_low, n)
        while high - low > 1:  # one root alone, above low and not above high: signs tell the side
            mid = (low + high) // 2
            v = _value(scaled, mid)
            if v == 0:
                low = high = mid
            elif (v > 0) == (k % 2 == 0):
                low = mid
            else:
                high = mid
        out.append(low)
    return out


def _solved(matrix: np.ndarray, columns: np.ndarray, bits: int) -> np.ndarray:
    """Fixed-point solution of matrix y = columns (Gauss, largest pivot)."""
    a, d = np.c_[matrix, columns], len(matrix)
    for k in range(d):
        best = max(range(k, d), key=lambda i: abs(a[i, k]))
        if best != k:
            a[[k, best]] = a[[best, k]]
        if a[k, k] == 0:
            a[k, k] = 1
        if k + 1 < d:
            factors = (a[k + 1 :, k] << bits) // a[k, k]
            a[k + 1 :, k:] -= np.outer(factors, a[k, k:]) >> bits
    y = np.zeros(columns.shape, object)
    for k in range(d - 1, -1, -1):
        rest = a[k, d:] - ((a[k, k + 1 : d] @ y[k + 1 :]) >> bits) if k + 1 < d else a[k, d:]
        y[k] = (rest << bits) // a[k, k]
    return y


def null_vectors(matrix: np.ndarray, roots: list[int], bits: int) -> np.ndarray:
    """A unit vector for each root (times 2**bits): inverse iteration, orthogonal to the ones
    before, as integers times 2**bits rounded to doubles at the end; one column each."""
    d, done, one = len(matrix), [], 1 << bits
    for at, root in enumerate(roots):
        system = np.array(matrix * one, object)
        system[np.diag_indices(d)] -= root
        v = np.array([[one * (1 + (7 * i * i + 3 * i * at) % 11)] for i in range(d)], object)
        for _ in range(4):
            v = _solved(system, v, bits)
            size = max(1, max(abs(c) for c in v[:, 0]).bit_length() - bits)
            v = v >> size if size > 0 else v << -size
            for _ in range(2):
                for u in done:
                    v[:, 0] -= (u * ((u @ v[:, 0]) >> bits)) >> bits
            norm = math.isqrt(int(v[:, 0] @ v[:, 0]))
            v = (v << bits) // max(1, norm)
        done.append(v[:, 0])
    out = np.array([[int(c) / one for c in v] for v in done], np.float64).T.reshape(d, len(roots))
    for k in range(out.shape[1]):  # the largest entry is positive: one sign for all rows, the same in every run
        out[:, k] *= np.sign(out[np.argmax(np.abs(out[:, k])), k])
    return out


def components(spark, n: int, matrix: np.ndarray, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values of x's covariance, unit vectors in columns, shares of the trace), largest first."""
    trace = int(sum(matrix.diagonal()))
    if not trace:
        return np.zeros(0), np.zeros((len(matrix), 0)), np.zeros(0)
    g = math.gcd(*(int(c) for c in matrix.ravel()))
    small = matrix // g
    bits = GUARD + 2 * int(small.max()).bit_length().bit_length()
    roots = largest_roots(characteristic_polynomial(spark, small), count, bits)
    vectors = null_vectors(small, roots, bits)
    # Divisions of Python integers: rounded once, whatever their size.
    return np.array([r * g / (n * n << bits) for r in roots]), vectors, np.array([r * g / (trace << bits) for r in roots])


def whitened(df: DataFrame, column: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = df.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, d = integers(df, column)
    if not d:
        return spark.createDataFrame([], schema)
    # Equal vectors are put together before the shuffle, so one that a third of the rows hold is no hot key.
    fit = written(rows.select("x").distinct(), "fit")
    n, sums, matrix = scatter(fit, d)
    values, vectors, shares = components(spark, n, matrix, count)
    most = len(values)
    if not most:
        return spark.createDataFrame([], schema)
    sums_long = sums.astype(np.int64) if max(abs(int(s)) for s in sums) < 1 << 62 else None
    top_sum, factors = max(abs(int(s)) for s in sums), vectors / np.sqrt(values)

    def centred(x: np.ndarray) -> np.ndarray:
        """n x - S, in long if it fits, else in Python integers."""
        top = max(abs(int(x.max())), abs(int(x.min())))
        if sums_long is not None and n * top + top_sum < 1 << 53:
            return x * n - sums_long
        return x.astype(object) * n - sums

    def projected(diff: np.ndarray) -> np.ndarray:
        return (diff / n).astype(np.float64) @ factors

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                w = projected(centred(matrix_of(batch.slice(at, BLOCK_ROWS).column(0), d)))
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(w[:, k])) for k in range(most)], names=[f"w{k}" for k in range(most)])

    # The covariance of what comes out, centred as Spark's covar_pop does it.
    pairs = [(i, j) for i in range(most) for j in range(i, most)]
    seen = fit.select("x").mapInArrow(spread, ", ".join(f"w{k} double" for k in range(most)))
    cov = seen.agg(*(F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs)).first()
    error = max(abs(cov[f"c{i}_{j}"] - (i == j)) for i, j in pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                diff = centred(matrix_of(part.column(1), d))
                top = max(abs(int(diff.max())), abs(int(diff.min())))
                wide = diff if top * top * d < 1 << 63 else diff.astype(object)
                deviation = (wide * wide).sum(axis=1)
                if deviation.dtype == object:
                    deviation = [int(v) if v < 1 << 63 else None for v in deviation]
                size = part.num_rows
                again = pa.array(np.repeat(np.arange(size), most))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(pa.int64()).take(again), pa.array(np.tile(np.arange(1, most + 1, dtype=np.int32), size)), pa.array(np.full(size * most, n, np.int64)),
                        pa.array(deviation, pa.int64()).take(again), pa.array(projected(diff).ravel()), pa.array(np.tile(shares, size)), pa.array(np.full(size * most, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(run, schema)
