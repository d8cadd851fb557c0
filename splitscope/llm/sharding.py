"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows lie in parts (by a hash of their key). How many rows each part sends to each shard is
drawn without replacement, given the exact shard sizes: a multivariate hypergeometric row
per part. Every part permutes its rows and deals them out by these counts; after the
exchange every shard permutes what it received. The outcome is a uniform permutation of
the table cut into shards whose row counts differ by one at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splitscope.llm.common import ship


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good items among ``n`` drawn from ``good + bad`` without replacement, any size.

    Inversion outwards from the mode: expected steps grow as the standard deviation.
    """
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))

    def choose(a: int, b: int) -> float:
        return math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)

    peak = math.exp(choose(good, mode) + choose(bad, n - mode) - choose(good + bad, n))
    left = rng.random() - peak
    down, up, p_down, p_up = mode, mode, peak, peak
    while left >= 0 and (down > low or up < high):
        if up < high:
            p_up *= (good - up) * (n - up) / ((up + 1) * (bad - n + up + 1))
            up += 1
            left -= p_up
            if left < 0:
                return up
        if down > low:
            p_down *= down * (bad - n + down) / ((good - down + 1) * (n - down + 1))
            down -= 1
            left -= p_down
            if left < 0:
                return down
    return mode


def draw_row(rng: np.random.Generator, sizes: list[int], n: int) -> list[int]:
    """How many of ``n`` rows fall to each shard with ``sizes`` places left."""
    out, rest = [], sum(sizes)
    for s in sizes:
        rest -= s
        got = hypergeometric(rng, s, rest, n)
        out.append(got)
        n -= got
    return out


def matrix_rows(counts: np.ndarray, sizes: list[int], seed: int, parts: list[int]) -> list[list[int]]:
    """The rows of the communication matrix for ``parts``.

    The parts are halved again and again; each half's total row is drawn from its
    parent's with a generator seeded by the range, so tasks that need the same range
    draw the same numbers and no task needs the whole matrix.
    """
    ends = np.concatenate([[0], np.cumsum(counts)])
    known: dict[tuple[int, int], list[int]] = {(0, len(counts)): sizes}

    def row(lo: int, hi: int, up: tuple[int, int]) -> list[int]:
        if (lo, hi) not in known:
            mid, (a, b) = (up[0] + up[1]) // 2, up
            first = draw_row(np.random.default_rng([seed, a, b]), known[up], int(ends[mid] - ends[a]))
            known[a, mid] = first
            known[mid, b] = [x - y for x, y in zip(known[up], first, strict=True)]
        return known[lo, hi]

    out = []
    for p in parts:
        lo, hi = 0, len(counts)
        while hi - lo > 1:
            up, mid = (lo, hi), (lo + hi) // 2
            lo, hi = (lo, mid) if p < mid else (mid, hi)
            row(lo, hi, up)
        out.append(known[lo, hi])
    return out


def shard(docs: DataFrame, shards: int = 24, *, key: tuple[str, ...] = ("doc_id", "text"), seed: int = 42, part_rows: int = 1 << 14) -> DataFrame:
    """``docs`` with columns ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in its shard).

    ``part_rows`` is the mean size of a part and of the ranges a shard is permuted in, so
    no task ever holds a whole shard. Row counts of the parts (one number for each
    ``part_rows`` rows) pass through the driver, no rows do. Rows with an equal key are
    told apart only by their other columns; where all columns agree they are
    interchangeable. Nulls hash like any value; an empty table gives an empty result; a
    ``shard`` or ``slot`` column of the input is replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("shard", "slot")
    total = docs.count()
    n_parts = max(1, math.ceil(total / part_rows))
    cols = [F.col(c) for c in key]
    placed = docs.withColumns(
        {
            "_part": F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(n_parts)),
            "_first": F.xxhash64(F.lit(seed + 1), *cols),
            "_second": F.xxhash64(F.lit(seed + 2), *cols),
        }
    )
    counts = np.zeros(n_parts, dtype=np.int64)
    for r in placed.groupBy("_part").count().collect():
        counts[r["_part"]] = r["count"]
    sizes = [total // shards + (s < total % shards) for s in range(shards)]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [int(p) for p in b["id"]]
            upto = [np.cumsum(r).tolist() for r in matrix_rows(counts, sizes, seed, parts)]
            yield pd.DataFrame({"_part": parts, "_upto": upto})

    matrix = spark.range(n_parts).mapInPandas(rows, "_part bigint, _upto array<bigint>")
    local = Window.partitionBy("_part").orderBy("_first", "_second")
    dealt = (
        placed.withColumn("_rank", F.row_number().over(local).cast("long"))
        .join(matrix, "_part")
        .withColumn("shard", F.expr("size(filter(_upto, c -> c < _rank))"))
        .drop("_upto", "_rank", "_part")
    )
    ranges = max(1, math.ceil(total / shards / part_rows))
    dealt = dealt.withColumn("_range", F.shiftright(F.shiftrightunsigned("_second", 34) * F.lit(ranges), 30).cast("int"))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        dealt.groupBy("shard", "_range").count().select("shard", "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    )
    within = Window.partitionBy("shard", "_range").orderBy("_second", "_first")
    return (
        dealt.withColumn("_rank", F.row_number().over(within).cast("long"))
        .join(bases, ["shard", "_range"])
        .withColumn("slot", F.col("_base") + F.col("_rank") - 1)
        .select(*docs.columns, "shard", "slot")
    )
