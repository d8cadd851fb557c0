"""Mixing sources to target weights.

The words of each source form one stream, packed into blocks of fixed length. Output
shards have a fixed number of slots; how many of them each source fills is drawn per
shard. The counts are those of multinomial draws by the targets' shares, one for each
shard, given that over all shards they add up to the slots the sources' targets call for:
then no draw can fall on a source whose blocks are used up, no slot stays empty, and each
source comes as near its target as whole blocks allow. The n-th slot of a source takes
block ``perm(n mod blocks)`` of its stream, where ``perm`` is a pseudorandom permutation of
the block numbers, another one for each pass over the source. Slots and blocks meet in a
join by block number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitscope.llm.common import WORD, materialize, ship, word_count
from splitscope.llm.sharding import draw_row


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Element-wise: the place of ``index`` in a permutation of range(size) chosen by ``key``.

    A four-round Feistel network over the next power of four, walked until the value
    falls below ``size``.
    """
    x = index.astype(np.uint64)
    size = size.astype(np.uint64)
    half = np.ceil(np.log2(np.maximum(size, 2).astype(np.float64)) / 2 + 1e-9).astype(np.uint64)
    half = np.maximum(half, np.uint64(1))
    mask = (np.uint64(1) << half) - np.uint64(1)
    key = key.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = x[todo] >> h, x[todo] & m
        for r in range(1, 5):
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r * 0xBF58476D1CE4E5B9 % 2**64)
            f ^= f >> np.uint64(31)
            f *= np.uint64(0x94D049BB133111EB)
            f ^= f >> np.uint64(29)
            left, right = right, (left ^ f) & m
        x[todo] = (left << h) | right
        todo = todo[x[todo] >= size[todo]]
    return x.astype(np.int64)


def _place(index: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(permuted(index.to_numpy(), size.to_numpy(), key.to_numpy()))


def source_targets(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """Per source: ``source_no`` (by code point, null last), ``source_size`` and ``target`` words.

    Sources weigh ``weights`` in turn and share ``share`` of all words. No target exceeds
    ``cap`` times its source; what lies above is shared again by weight. That is water
    filling: with the sources in the order of cap to weight, the level follows from
    running sums.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("source_no"), F.lit(len(weights))) + 1).cast("int"))
    every = Window.partitionBy()
    by_level = Window.orderBy("_level", "source_no")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    return (
        per.withColumn("source_no", (F.row_number().over(by_name) - 1).cast("long"))
        .withColumns({"_w": turn, "_cap": F.col("source_size") * F.lit(float(cap))})
        .withColumn("_level", F.col("_cap") / F.col("_w"))
        .withColumn("_reach", (F.sum("source_size").over(every) * F.lit(float(share)) - earlier("_cap")) / (F.sum("_w").over(every) - earlier("_w")))
        .withColumn("_open", F.when(F.col("_level") > F.col("_reach"), F.col("_reach")))
        .withColumn("_first", F.first("_open", ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("target", F.when(F.col("_first").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_w") * F.col("_first"))))
        .select("source", "source_no", F.col("source_size").cast("long"), "target")
    )


def shard_counts(slots: list[int], shards: int, first: int, last: int, seed: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """Per shard from ``first`` to ``last``: slots of each source, and those of all shards before it.

    ``slots`` are the sources' slots in all ``shards``, whose sizes differ by one at most.
    The range of shards is halved again and again, and what each half takes of every
    source is drawn without replacement (multinomial draws, given their sums), with a
    generator seeded by the range: tasks that meet the same range draw the same numbers,
    and none draws for shards it does not need.
    """
    edge = lambda s: s * sum(slots) // shards

    def halves(lo: int, hi: int, counts: list[int], before: list[int]) -> Iterator[tuple[int, list[int], list[int]]]:
        if hi <= first or lo > last:
            return
        if hi - lo == 1:
            yield lo, counts, before
            return
        mid = (lo + hi) // 2
        left = draw_row(np.random.default_rng([seed, lo, hi]), counts, edge(mid) - edge(lo))
        yield from halves(lo, mid, left, before)
        yield from halves(mid, hi, [c - n for c, n in zip(counts, left, strict=True)], [c + n for c, n in zip(before, left, strict=True)])

    yield from halves(0, shards, slots, [0] * len(slots))


class Mix:
    """A drawn mix: ``sources`` (targets), ``rows`` (documents with their place) and ``spans``.

    ``spans`` has a row for every stretch of a document in a slot: shard, slot, source_no,
    pass_no, block, doc_id, at (its document's first word in the source's stream), start
    (first word taken, in the document) and words.
    """

    def __init__(self, sources: DataFrame, rows: DataFrame, spans: DataFrame):
        self.sources, self.rows, self.spans = sources, rows, spans

    def taken(self) -> DataFrame:
        """Each input row with the words the mix takes of it, repeats counted."""
        got = self.spans.groupBy("source_no", "at").agg(F.sum("words").alias("taken"))
        rows = self.rows.withColumn("_at", F.when(F.col("size") > 0, F.col("at")))
        got = got.withColumnRenamed("source_no", "_no").withColumnRenamed("at", "_got")
        return (
            rows.join(got, (F.col("source_no") == F.col("_no")) & (F.col("_at") == F.col("_got")), "left")
            .join(self.sources.select("source_no", "source_size", "target"), "source_no")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source", "source_no")
        )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    *,
    share: float = 1.0,
    cap: int = 3,
    block: int = 64,
    shard_slots: int = 4096,
    seed: int = 42,
    range_rows: int = 1 << 14,
) -> Mix:
    """Mix ``docs`` (doc_id, text, source) to the weights of their sources.

    Each slot takes a whole block of ``block`` words (the last block of a source may be
    shorter), and no block is taken more than ``cap`` times, so no document exceeds
    ``cap`` times its size. The order in a source's stream follows hashed ranges of about
    ``range_rows`` rows, so a source with most rows is numbered by many tasks. One line
    per source passes through the driver. Null and empty texts have no words and are
    never taken; null sources form a source of their own; repeated rows are taken like
    others; an empty table gives no slots. Extra columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    place = F.pandas_udf(_place, "bigint")
    sized = materialize(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("mark")), "mix-sizes"
    )
    total = sized.count()
    targets = source_targets(sized, weights, share, cap)
    known = sorted(targets.collect(), key=lambda r: r["source_no"])
    sources = spark.createDataFrame([tuple(r) for r in known], targets.schema)

    ranges = max(1, math.ceil(total / range_rows))
    ranged = sized.join(sources.select("source", "source_no").withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    ranged = ranged.withColumn("_range", F.pmod("mark", F.lit(ranges)))
    before = Window.partitionBy("source_no").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        ranged.groupBy("source_no", "_range").agg(F.sum("size").alias("_n")).select("source_no", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )
    inside = Window.partitionBy("source_no", "_range").orderBy("doc_id", "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = materialize(
        ranged.withColumn("_upto", F.sum("size").over(inside))
        .join(bases, ["source_no", "_range"])
        .select("doc_id", "source", "source_no", "size", "mark", (F.col("_base") + F.col("_upto") - F.col("size")).alias("at")),
        "mix-rows",
    )

    sizes = np.array([r["source_size"] for r in known], dtype=np.float64)
    blocks = np.ceil(sizes / block).astype(np.int64)
    expected = np.array([r["target"] for r in known], dtype=np.float64) * blocks / np.maximum(sizes, 1)
    wanted = [int(n) for n in np.minimum(np.rint(expected).astype(np.int64), blocks * cap)]
    shards = max(1, math.ceil(sum(wanted) / shard_slots))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                for shard, counts, before in shard_counts(wanted, shards, int(b["id"].min()), int(b["id"].max()), seed):
                    n = np.array(counts, dtype=np.int64)
                    yield pd.DataFrame({"shard": shard, "source_no": np.arange(len(n)), "slots": n, "_first": before, "_from": np.cumsum(n) - n, "_all": n.sum(), "_blocks": blocks})

    drawn = spark.range(shards).mapInPandas(draw, "shard bigint, source_no bigint, slots bigint, _first bigint, _from bigint, _all bigint, _blocks bigint").filter("slots > 0")
    key: Column = F.xxhash64(F.lit(seed), "source_no", "pass_no")
    slots = (
        drawn.repartition(max(1, shards // 16), "shard")
        .withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
        .withColumn("_nth", F.col("_first") + F.col("_i"))
        .withColumn("pass_no", F.expr("_nth div _blocks"))
        .withColumn("block", place(F.col("_nth") % F.col("_blocks"), F.col("_blocks"), key))
        .withColumn("slot", place(F.col("_from") + F.col("_i"), F.col("_all"), F.xxhash64(F.lit(seed + 1), "shard")))
        .select("shard", "slot", "source_no", "pass_no", "block")
    )
    ends = F.col("at") + F.col("size")
    pieces = (
        rows.filter("size > 0")
        .withColumn("block", F.explode(F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}"))))
        .withColumn("_lo", F.greatest(F.col("at"), F.col("block") * block))
        .withColumn("_hi", F.least(ends, (F.col("block") + 1) * block))
        .select("source_no", "block", "doc_id", "mark", "at", (F.col("_lo") - F.col("at")).alias("start"), (F.col("_hi") - F.col("_lo")).alias("words"))
    )
    # both sides grow with the input, and sizes measured before an explode understate them
    return Mix(sources, rows, slots.hint("merge").join(pieces, ["source_no", "block"]))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), **options) -> DataFrame:
    """The mix as documents: a row for each document and pass the mix takes words of.

    Columns are those of ``docs``. The text is the document's own where all its words are
    taken in that pass, else the taken words in order, parted by blanks; ``n_chars``
    follows where it exists. Documents without words are never taken.
    """
    m = mix(docs, weights, **options)
    took = m.spans.groupBy("source_no", "at", "pass_no").agg(
        F.first("doc_id").alias("_doc"), F.first("mark").alias("_mark"), F.sum("words").alias("_words"), F.collect_list(F.struct("start", "words")).alias("_spans")
    )
    # identical rows of the input differ only by their place in the stream
    same = Window.partitionBy("doc_id", "mark").orderBy("at")
    nth = m.rows.filter("size > 0").withColumn("_nth", F.row_number().over(same)).select("source_no", "at", "_nth", F.col("size").alias("_size"))
    took = took.join(nth, ["source_no", "at"]).select("_doc", "_mark", "_nth", "_size", "_words", "_spans")
    marked = docs.withColumn("_own", F.xxhash64("doc_id", "text")).filter(word_count(F.col("text")) > 0)
    marked = marked.withColumn("_own_nth", F.row_number().over(Window.partitionBy("doc_id", "_own").orderBy("_own")))
    both = marked.join(took, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_mark")) & (F.col("_own_nth") == F.col("_nth")))
    cut = F.expr(f"""array_join(flatten(transform(array_sort(_spans), s -> slice(regexp_extract_all(text, r'{WORD}', 0), int(s.start) + 1, int(s.words)))), ' ')""")
    out = both.withColumn("text", F.when(F.col("_words") == F.col("_size"), F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
