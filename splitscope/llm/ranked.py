"""Ranked lexical search, reversed: the documents stream through an index of the queries.

The stated items are indexed, not the corpus: each term leads to the items that hold it.
That index is broadcast in blocks of bounded size, and every document's term counts pass
through it once, giving its scores for all items of the block. A task keeps one bounded
heap for each item, so what it returns does not grow with the documents it read; the heaps
of all tasks are merged by rank. Statistics (documents, words, document frequencies of the
items' terms) are counted over all documents first, so scores of all tasks compare.

Scores are whole numbers: a term weighs floor(1000 ln((2 N + 2) / (2 df + 1))), and adds
that times (10**9 tf) div (1000 tf + 8 m), m = 10 + (90 n N) div L.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splitscope.llm.common import byte_runs, lower_ascii, materialize, range_numbers, run_strings, ship, slices, text_bytes, windows

# Bytes of terms: digits, letters and all bytes beyond ASCII.
TERM_BYTES = np.ones(256, dtype=bool)
TERM_BYTES[[*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)]] = False
_CELLS = 1 << 22  # scores (documents x items) held at once


@dataclass
class ItemIndex:
    """A block of items: its terms, and the items of each term (numbered within the block)."""

    terms: pa.Array
    first: np.ndarray  # where the items of a term begin in ``items``
    items: np.ndarray
    ids: list  # item_id of each number
    weight: np.ndarray | None = None


def term_counts(column: pa.Array, known: pa.Array, rows: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of whole texts: first row, terms of each text, and (text, number in ``known``, count) of the known ones."""
    data, offsets = text_bytes(column)
    for lo, hi in windows(offsets, rows=rows):
        part, own = lower_ascii(data[offsets[lo] : offsets[hi]]), offsets[lo : hi + 1] - offsets[lo]
        inside = TERM_BYTES[part]
        start, end, text = byte_runs(inside, own)
        words = run_strings(part, inside, start, end)
        number = pc.fill_null(pc.index_in(words.dictionary, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        number = number[words.indices.to_numpy(zero_copy_only=False)]
        hit = number >= 0
        key, count = np.unique(text[hit] * max(len(known), 1) + number[hit], return_counts=True)
        yield lo, np.bincount(text, minlength=hi - lo), key // max(len(known), 1), key % max(len(known), 1), count


def term_weights(documents: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of each term, computed in doubles."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)


def lengths_m(n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """m of documents of ``n`` terms: 100 - 90 + (90 n N) div L."""
    if len(n) and 90 * int(n.max()) * documents < 2**63:
        return 10 + (90 * n * documents) // words
    return np.array([10 + 90 * x * documents // words for x in n.tolist()], dtype=np.int64)


def window_scores(index: ItemIndex, rows: int, m: np.ndarray, text: np.ndarray, term: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Scores of ``rows`` documents for all items of the block, as whole numbers."""
    part = index.weight[term] * ((1_000_000_000 * count) // (1000 * count + 8 * m[text]))
    size = index.first[term + 1] - index.first[term]
    cell = np.repeat(text * len(index.ids), size) + index.items[range_numbers(index.first[term], size)]
    part = np.repeat(part, size)
    cells = rows * len(index.ids)
    # sums of halves are exact in doubles
    high = np.bincount(cell, weights=part >> 20, minlength=cells).astype(np.int64)
    low = np.bincount(cell, weights=part & 0xFFFFF, minlength=cells).astype(np.int64)
    return ((high << 20) + low).reshape(rows, len(index.ids))


class Heaps:
    """The k best (score, id) of each item: greater scores first, then smaller ids, null ids last."""

    def __init__(self, items: int, k: int):
        self.k, self.kept = k, [[] for _ in range(items)]
        self.least = np.ones(items, dtype=np.int64)  # a score below this changes nothing

    def add(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.least)
        if not len(row):
            return
        score = scores[row, item]
        order = np.lexsort((ids[row], ~known[row], -score, item))
        row, item, score = row[order], item[order], score[order]
        begin = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
        place = np.arange(len(item)) - np.repeat(begin, np.diff(np.append(begin, len(item))))
        top = place < self.k
        for i, s, r in zip(item[top].tolist(), score[top].tolist(), row[top].tolist(), strict=True):
            heap, entry = self.kept[i], (s, -int(ids[r]) if known[r] else -math.inf)
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.least[i] = heap[0][0]


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item's whole text; rows of one item_id are one item."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in windows(offsets):
                part, own = lower_ascii(data[offsets[lo] : offsets[hi]]), offsets[lo : hi + 1] - offsets[lo]
                inside = TERM_BYTES[part]
                start, end, text = byte_runs(inside, own)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + text)), run_strings(part, inside, start, end).dictionary_decode()], names=["item_id", "term"])

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(split, "item_id long, term string").distinct()


def item_blocks(terms: DataFrame, most_terms: int, most_items: int) -> Iterator[ItemIndex]:
    """The items in blocks of at most ``most_terms`` (item, term) pairs and ``most_items`` items.

    Items are dealt by hash; the blocks' sizes are counted before any is brought to the driver,
    and there are more blocks while one is too large. An item alone may have more terms: it is one row.
    """
    sizes = terms.groupBy("item_id").agg(F.count("*").alias("n"))
    total = sizes.agg(F.count("*").alias("items"), F.sum("n").alias("n")).first()
    if not total["items"]:
        return
    blocks = max(-(-total["n"] // most_terms), -(-total["items"] // most_items))
    dealt = lambda b: F.pmod(F.xxhash64("item_id"), F.lit(b))
    while True:
        over = sizes.groupBy(dealt(blocks).alias("b")).agg(F.count("*").alias("items"), F.sum("n").alias("n"))
        if not over.filter((F.col("items") > 1) & ((F.col("n") > most_terms) | (F.col("items") > most_items))).limit(1).count():
            break
        blocks *= 2
    for b in range(blocks):
        pairs = terms.filter(dealt(blocks) == b).orderBy("term", F.col("item_id").asc_nulls_first()).toArrow()
        if pairs.num_rows:
            term, item = (pairs.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in ("term", "item_id"))
            first = np.searchsorted(term.indices.to_numpy(), np.arange(len(term.dictionary) + 1))
            yield ItemIndex(term.dictionary, first, item.indices.to_numpy().astype(np.int64), item.dictionary.to_pylist())


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, *, block_terms: int = 1 << 20, block_items: int = 1 << 14) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best of ``docs`` (doc_id, text) for each of ``items`` (item_id, text).

    Equal scores come by ascending doc_id, null ids last; only scores above 0 are listed, so
    items without terms, null texts and empty tables give no rows. Rows of one item_id (null
    is one too) are one item, with the terms of all its texts once each; repeated documents
    are ranked each by itself. Null and termless texts count in no statistic. Extra columns are ignored.

    ``docs`` is read twice for each block of items: once for the statistics, once for the scores.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    terms = materialize(item_terms(items), "items")
    schema = "item_id long, doc_id long, score long"
    found = None
    for index in item_blocks(terms, block_terms, block_items):
        block = _block(spark, docs, index, k)
        found = block if found is None else found.unionByName(block)
    if found is None:
        found = spark.createDataFrame([], schema)
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _block(spark, docs: DataFrame, index: ItemIndex, k: int) -> DataFrame:
    rows = max(1, min(1 << 14, _CELLS // len(index.ids)))
    shared = spark.sparkContext.broadcast(index.terms)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        df, n, words = np.zeros(len(known), np.int64), 0, 0
        for batch in slices(batches):
            for _, length, _, term, _ in term_counts(batch.column(0), known, 1 << 14):
                df += np.bincount(term, minlength=len(known))
                n, words = n + int((length > 0).sum()), words + int(length.sum())
        own = np.flatnonzero(df)
        # the row of term -1 counts documents and words
        yield pa.RecordBatch.from_arrays([pa.array(np.append(own, -1)), pa.array(np.append(df[own], n)), pa.array(np.append(np.zeros(len(own), np.int64), words))], names=["term", "df", "words"])

    counted = docs.select("text").mapInArrow(measure, "term long, df long, words long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words"))
    # at most one row for each term of the block
    stats = {r["term"]: r for r in counted.collect()}
    documents, words = (stats[-1]["df"], stats[-1]["words"]) if -1 in stats else (0, 0)
    index.weight = term_weights(documents, np.array([stats[t]["df"] if t in stats else 0 for t in range(len(index.terms))], dtype=np.int64))
    whole = spark.sparkContext.broadcast(index)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = whole.value
        heaps = Heaps(len(index.ids), k)
        for batch in slices(batches):
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for lo, length, text, term, count in term_counts(batch.column(1), index.terms, rows):
                if len(text):
                    hi = lo + len(length)
                    heaps.add(window_scores(index, len(length), lengths_m(length, documents, words), text, term, count), ids[lo:hi], known[lo:hi])
        out = [(index.ids[i], None if d == -math.inf else -d, s) for i, heap in enumerate(heaps.kept) for s, d in heap]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in range(3)], names=["item_id", "doc_id", "score"])

    return docs.mapInArrow(search, "item_id long, doc_id long, score long")
