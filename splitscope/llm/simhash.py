"""SimHash near-duplicates, linked by pigeonring filtering.

A fingerprint's 64 bits are cut into ``max_bits + 1`` segments on a ring. If two
fingerprints differ in ``max_bits`` bits at most, then from some segment on every chain of
l consecutive segments differs in at most l * max_bits / (max_bits + 1) bits (the strong
form of the pigeonring principle): no bit in the first segment, one at most in the first
two, and so on. The first two links of such a chain are a join key: both segments, with
one bit of the second left out. Fingerprints that share a key are checked on the whole
chain, and only those that pass on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splitscope.llm.common import materialize, ship
from splitscope.llm.components import components

GROUP = 2048  # members of a key that are compared in one go; larger groups are cut into blocks


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """SimHash of a text, unsigned: words (ASCII letters lower-cased) in shingles of ``width``.

    Shingles count as often as they occur; a shorter text is one shingle; a text without
    words gives 0. A bit is set where it is set in over half of the shingles' XXH64.
    """
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    flat = b" ".join(words)
    n = len(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (np.concatenate([[0], ends[:-1] + 1])).tolist()
    digest = xxhash.xxh64_intdigest
    if n <= width:
        hashes = [digest(flat, seed)]
    else:
        hashes = [digest(flat[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())]
    found = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(found), 4096):
        ones += np.unpackbits(found[lo : lo + 4096], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(found), bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, *, width: int = 3, seed: int = 42, to: str = "_fp") -> DataFrame:
    """``docs`` with the fingerprint of the whole text as a signed long."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([fingerprint(t.as_py(), width, seed) for t in texts], dtype=np.uint64).view(np.int64), pa.int64())

    return docs.withColumn(to, F.arrow_udf(run, "bigint")(F.col("text")))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


class Ring:
    """The segments of a fingerprint for a distance of ``max_bits``."""

    def __init__(self, max_bits: int):
        self.max_bits, self.m = max_bits, max_bits + 1
        cut = [64 * k // self.m for k in range(self.m + 1)]
        self.masks = [sum(1 << b for b in range(cut[k], cut[k + 1])) for k in range(self.m)]
        #: (first segment, bit of the second left out, mask of the key, is it the first such bit)
        self.kinds = []
        for i in range(self.m):
            j = (i + 1) % self.m
            bits = [b for b in range(64) if self.masks[j] >> b & 1]
            self.kinds += [(i, b, (self.masks[i] | self.masks[j]) & ~(1 << b), b == bits[0]) for b in bits]

    def keyed(self, prints: DataFrame) -> DataFrame:
        """(kind, part, fp): a row for every key of each distinct fingerprint ``fp``."""
        keys = F.array(*[F.struct(F.lit(k).alias("kind"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("part")) for k, (_, _, mask, _) in enumerate(self.kinds)])
        return prints.select("fp", F.explode(keys).alias("key")).select("key.kind", "key.part", "fp")

    def linked(self, kind: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs that share a key of ``kind`` pass the chain and the whole check.

        A pair whose second segments are equal shares all keys of that segment; only the
        first counts.
        """
        x = a ^ b
        table = np.array([(i, bit, first) for i, bit, _, first in self.kinds], dtype=np.uint64)
        start, bit, first = table[kind].T
        keep = ((x >> bit) & np.uint64(1)).astype(bool) | first.astype(bool)
        masks = np.array(self.masks, dtype=np.uint64)
        budget = np.zeros(len(x), dtype=np.int64)
        for step in range(self.m):
            budget += np.bitwise_count(x & masks[(start.astype(np.int64) + step) % self.m])
            keep &= budget <= (step + 1) * self.max_bits // self.m
        return keep


def _forest(kind: np.ndarray, part: np.ndarray, fp: np.ndarray, side: np.ndarray | None, ring: Ring) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the linked pairs of each group join: one a member at most.

    Rows come sorted by (kind, part). With ``side``, only pairs of different sides count,
    or all if the group has one side.
    """
    n = len(fp)
    label = np.arange(n)
    here, found = np.arange(n - 1), []
    off = 1
    while len(here):
        here = here[here + off < n]
        here = here[(kind[here] == kind[here + off]) & (part[here] == part[here + off])]
        ok = here
        if side is not None:
            ok = here[side[here] != side[here + off]]
        for lo in range(0, len(ok), 1 << 16):
            i = ok[lo : lo + (1 << 16)]
            i = i[ring.linked(kind[i], fp[i], fp[i + off])]
            if len(i):
                found.append(np.stack([i, i + off]))
        off += 1
    if not found:
        return fp[:0], fp[:0]
    a, b = np.concatenate(found, axis=1)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    hung = np.flatnonzero(label != np.arange(n))
    return fp[hung], fp[label[hung]]


_SCHEMA = "kind int, part bigint, block int, a bigint, b bigint"
_ARROW = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("block", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])


def _rows(kind, part, block, a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((kind, part, block, a, b), _ARROW.types, strict=True)], schema=_ARROW)


def links(prints: DataFrame, max_bits: int = 3, *, group: int = GROUP) -> DataFrame:
    """Links (a, b) that connect just what fingerprints (``fp``, distinct) within ``max_bits`` connect.

    Rows meet by key in sorted order and are compared as a stream. From each group only
    a spanning forest leaves, never all pairs. A group of more than ``group`` members is
    cut into blocks, and every two of its blocks meet in a task of their own, so a large
    group is spread and memory stays bounded, and no pair is left out.
    """
    ship(prints.sparkSession)
    ring = Ring(max_bits)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Forest links of groups up to ``group`` members; members of larger ones by block."""
        held = [np.zeros(0, t) for t in (np.int64, np.int64, np.uint64)]
        open_key, sent = None, 0

        def settle(rows: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, open_key, sent
            kind, part, fp = rows
            if not len(fp):
                return
            edge = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (part[1:] != part[:-1])]))
            size = np.diff(np.append(edge, len(fp)))
            begun = open_key == (kind[0], part[0])  # a large group goes on here
            big = size > group
            big[0] |= begun
            for g in np.flatnonzero(big):
                lo, hi = edge[g], edge[g] + size[g]
                number = (sent if g == 0 and begun else 0) + np.arange(hi - lo)
                yield _rows(kind[lo:hi], part[lo:hi], number // group, fp[lo:hi].view(np.int64), fp[lo:hi].view(np.int64))
                open_key, sent = (kind[lo], part[lo]), int(number[-1]) + 1
            done = ~big
            if not last and done[-1]:
                done[-1] = False
                lo = edge[-1]
                held = [kind[lo:], part[lo:], fp[lo:]]
            else:
                held = [x[:0] for x in rows]
            pick = np.repeat(done & (size > 1), size)
            a, b = _forest(kind[pick], part[pick], fp[pick], None, ring)
            if len(a):
                yield _rows(np.zeros(len(a)), np.zeros(len(a)), np.full(len(a), -1), a.view(np.int64), b.view(np.int64))

        for batch in batches:
            new = [batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
            yield from settle([np.concatenate([x, y]) for x, y in zip(held, new, strict=True)], False)
        yield from settle(held, True)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches]
        if not rows:
            return
        kind, part, block, fp = (np.concatenate([b.column(i).to_numpy() for b in rows]) for i in range(4))
        side = block if (block != block[0]).any() else None
        a, b = _forest(kind.astype(np.int64), part, fp.view(np.uint64), side, ring)
        yield _rows(np.zeros(len(a)), np.zeros(len(a)), np.full(len(a), -1), a.view(np.int64), b.view(np.int64))

    keyed = ring.keyed(prints).repartition("kind", "part").sortWithinPartitions("kind", "part")
    first = materialize(keyed.mapInArrow(stream, _SCHEMA), "simhash-links")
    large = first.filter("block >= 0").select("kind", "part", "block", F.col("a").alias("fp"))
    blocks = large.groupBy("kind", "part").agg(F.max("block").alias("_last"))
    # a member goes to a meeting with each block of its group, and to one of its own block
    spread = (
        large.join(blocks, ["kind", "part"])
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_last"))))
        .select("kind", "part", "block", "fp", F.least("block", "_other").alias("lo"), F.greatest("block", "_other").alias("hi"))
    )
    met = spread.groupBy("kind", "part", "lo", "hi").applyInArrow(lambda t: _meet_table(t, meet), _SCHEMA)
    return first.filter("block < 0").select("a", "b").union(met.select("a", "b"))


def _meet_table(table: pa.Table, meet) -> pa.Table:
    out = list(meet(table.select(["kind", "part", "block", "fp"]).combine_chunks().to_batches()))
    return pa.Table.from_batches(out, schema=_ARROW)


def near_duplicates(docs: DataFrame, *, width: int = 3, max_bits: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, mark, fingerprint, component_id): every row's SimHash and near-duplicate class.

    Fingerprints within ``max_bits`` differing bits are linked; component_id is the
    smallest doc_id reachable over links, its own included. Texts without words all have
    fingerprint 0 and are linked like others. A null text has no words; null doc_ids are
    never smallest, and a class of them alone has a null id; repeated rows keep their
    number; an empty table gives an empty result. Equal texts meet as one fingerprint, so
    copies are never paired. ``mark`` is a hash of the text.
    """
    prints = with_fingerprint(docs.select("doc_id", "text", F.xxhash64("text").alias("mark")), width=width, seed=seed)
    prints = materialize(prints.select("doc_id", "mark", F.col("_fp").alias("fp")), "simhash")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    labels = components(links(distinct.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    classed = distinct.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    ids = classed.groupBy("label").agg(F.min("least").alias("component_id"))
    classed = classed.join(ids, "label").select("fp", "label", "component_id")
    return prints.join(classed, "fp").select(
        "doc_id", "mark", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("fp").alias("_fp"), F.col("label").alias("_label")
    )


def deduplicated(docs: DataFrame, *, width: int = 3, max_bits: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` with one row left of each near-duplicate class: that of the smallest doc_id.

    Among rows with that doc_id the least hash of the text decides, and of rows that agree
    in both one stays. Classes are told apart by a fingerprint of theirs, not by that
    doc_id: unlike texts under one doc_id are two classes, and each keeps its row.
    """
    found = near_duplicates(docs, width=width, max_bits=max_bits, seed=seed)
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("mark").alias("m"))
    kept = found.groupBy("_label").agg(F.min(order).alias("o")).select(F.col("o.d").alias("_d"), F.col("o.m").alias("_m"), F.col("o.n").alias("_n")).distinct()
    marked = docs.withColumns({"_mark": F.xxhash64("text"), "_key": F.coalesce(F.col("doc_id"), F.lit(0)), "_null": F.col("doc_id").isNull()})
    marked = marked.withColumn("_nth", F.row_number().over(Window.partitionBy("_key", "_null", "_mark").orderBy("_mark"))).filter("_nth = 1")
    kept = kept.select(F.coalesce("_d", F.lit(0)).alias("_key"), F.col("_n").alias("_null"), F.col("_m").alias("_mark"))
    return marked.join(kept, ["_key", "_null", "_mark"], "left_semi").select(*docs.columns)
