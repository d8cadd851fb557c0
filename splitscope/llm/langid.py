"""Language identification by prediction by partial matching (PPM).

Each language has byte context trees of orders 0 to ``order``: how often each byte follows
each context. A byte seen in a context costs -log2(count / (total + distinct)) bits; an
unseen one costs an escape, -log2(distinct / (total + distinct)), and is looked up in the
next shorter context; below order 0 all 256 bytes are alike. The statistics are frozen
after training, so a text's code length under each language is an exact sum, and the
shortest code names the language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitscope.llm.common import materialize, ship, slices, text_bytes, unit
from splitscope.session import ensure_short_batches

UNKNOWN = "und"
_WINDOW = 1 << 18  # bytes worked on at once


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.fill_null(""))


def grams(data: np.ndarray, starts: np.ndarray, lo: int, hi: int, order: int) -> np.ndarray:
    """For the bytes at [lo, hi): the byte (lowest 8 bits) with its ``order`` predecessors.

    ``starts`` gives, for those bytes, where their text begins; before it stand zero bytes.
    """
    out = data[lo:hi].astype(np.uint64)
    at = np.arange(lo, hi)
    for j in range(1, order + 1):
        before = np.zeros(hi - lo, dtype=np.uint64)
        ok = at - j >= starts
        before[ok] = data[at[ok] - j]
        out |= before << np.uint64(8 * j)
    return out


@dataclass
class Ppm:
    """Frozen trees of several languages, as sorted tables.

    ``pairs[k]``: (context of k bytes, byte) seen in any language, with the bits that the
    byte costs in each language once its context of k bytes is reached. ``contexts[k]``:
    the bits of an escape from that context in each language, 0 where it is unknown.
    """

    languages: list[str]
    order: int
    pairs: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def train(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int) -> Ppm:
        """From each language's counts of (context of ``order`` bytes, byte)."""
        languages = sorted(counts)
        n_lang = len(languages)
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        contexts: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(order + 1):
            mask = np.uint64((1 << 8 * (k + 1)) - 1)
            own = {}
            for l in languages:
                codes, n = counts[l]
                short, where = np.unique(codes & mask, return_inverse=True)
                own[l] = short, np.bincount(where, weights=n, minlength=len(short))
            every = np.unique(np.concatenate([own[l][0] for l in languages])) if languages else np.zeros(0, np.uint64)
            tops, place = np.unique(every >> np.uint64(8), return_inverse=True)
            bits = np.zeros((len(every), n_lang), dtype=np.float64)
            escapes = np.zeros((len(tops), n_lang), dtype=np.float64)
            for i, l in enumerate(languages):
                short, n = own[l]
                mine = np.searchsorted(every, short)
                total = np.bincount(place[mine], weights=n, minlength=len(tops))
                distinct = np.bincount(place[mine], minlength=len(tops))
                known = total > 0
                escapes[known, i] = -np.log2(distinct[known] / (total[known] + distinct[known]))
                if k:
                    lower_codes, lower = pairs[k - 1]
                    below = lower[np.searchsorted(lower_codes, every & np.uint64((1 << 8 * k) - 1)), i]
                else:
                    below = np.full(len(every), 8.0)
                bits[:, i] = escapes[place, i] + below
                bits[mine, i] = -np.log2(n / (total + distinct)[place[mine]])
            pairs.append((every, bits))
            contexts.append((tops, escapes))
        return cls(languages, order, pairs, contexts)

    def costs(self, codes: np.ndarray) -> np.ndarray:
        """Bits of each (context, byte) in each language."""
        out = np.zeros((len(codes), len(self.languages)))
        todo = np.arange(len(codes))
        for k in range(self.order, -1, -1):
            mine = codes[todo] & np.uint64((1 << 8 * (k + 1)) - 1)
            table, bits = self.pairs[k]
            at = np.minimum(np.searchsorted(table, mine), len(table) - 1)
            hit = table[at] == mine
            out[todo[hit]] += bits[at[hit]]
            todo, mine = todo[~hit], mine[~hit] >> np.uint64(8)
            if not len(todo):
                return out
            table, bits = self.contexts[k]
            at = np.minimum(np.searchsorted(table, mine), len(table) - 1)
            hit = table[at] == mine
            out[todo[hit]] += bits[at[hit]]
        out[todo] += 8.0
        return out

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text in each language; texts lie in a row, cut at ``offsets``."""
        n = len(offsets) - 1
        out = np.zeros((n, len(self.languages)))
        for lo in range(0, len(data), _WINDOW):
            hi = min(lo + _WINDOW, len(data))
            text = np.searchsorted(offsets, np.arange(lo, hi), side="right") - 1
            costs = self.costs(grams(data, offsets[text], lo, hi, self.order))
            first = text[0]
            for i in range(len(self.languages)):
                got = np.bincount(text - first, weights=costs[:, i])
                out[first : first + len(got), i] += got
        return out


def train(
    docs: DataFrame, lang: str = "lang", *, learn: Column | None = None, order: int = 4, docs_per_language: int = 600, rounds: int = 2, margin: float = 0.5, least: float = 0.5, stretch: int = 64, seed: int = 42
) -> Ppm:
    """Fit the trees on about ``docs_per_language`` documents of each language.

    The sample is bounded by that parameter: each language keeps the documents whose
    hashed key falls below its share, so reruns agree. Texts are lower-cased and taken
    whole. Documents quote other languages, so after the first of ``rounds`` each round
    learns only from the stretches (of ``stretch`` bytes) that the last round's trees code
    shortest in their own document's language, by ``margin`` bits a byte. A language near
    another has few such stretches or none: where they hold less than the share ``least``
    of its sample's bytes, it learns from all that no other language codes shorter, and
    where these hold less too, from its whole sample, so no language of the sample is
    lost. Rows with a null text or language are not learned from. The trees pass through
    the driver; their size is bounded by the sample.
    """
    spark = docs.sparkSession
    ship(spark)
    ensure_short_batches(spark)
    known = docs.filter(F.col(lang).isNotNull() & F.col("text").isNotNull() & F.coalesce(learn if learn is not None else F.lit(True), F.lit(False)))
    # one number a language: as a literal, so that no text crosses an exchange for it
    share = {r["_lang"]: docs_per_language / r["count"] for r in known.groupBy(F.col(lang).alias("_lang")).count().collect()}
    pairs = [F.lit(x) for l in sorted(share) for x in (l, share[l])]
    part = F.try_element_at(F.create_map(*pairs), F.col(lang)) if pairs else F.lit(None).cast("double")
    sample = known.filter(unit(F.lit(seed), F.col("doc_id")) < part).select(F.col(lang).alias("_lang"), "text")
    sample = materialize(sample, "langid-sample")
    model: Ppm | None = None
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(model)

        def count(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            last = held.value
            for batch in slices(batches):
                names = np.array(batch.column(0).to_pylist(), dtype=object)
                data, offsets = text_bytes(lowered(batch.column(1)))
                text = np.repeat(np.arange(len(names)), np.diff(offsets))
                for lo in range(0, len(data), _WINDOW):
                    own = text[lo : lo + _WINDOW]
                    codes = grams(data, offsets[own], lo, lo + len(own), order)
                    rank = np.zeros(len(own), np.int32)  # 0: ahead by the margin, 1: not behind, 2: the others
                    if last is not None:
                        # bits of every stretch of ``stretch`` bytes of a text
                        piece = (np.arange(lo, lo + len(own)) - offsets[own]) // stretch
                        cut = np.concatenate([[True], (piece[1:] != piece[:-1]) | (own[1:] != own[:-1])])
                        bits = np.add.reduceat(last.costs(codes), np.flatnonzero(cut), axis=0)
                        size = np.diff(np.append(np.flatnonzero(cut), len(own)))
                        mine = np.array(last.languages, dtype=object)[None, :] == names[own[cut]][:, None]
                        ahead = np.where(mine, np.inf, bits).min(axis=1) - np.where(mine, bits, np.inf).min(axis=1)
                        rank = (2 - (ahead >= 0) - (ahead >= margin * size)).astype(np.int32)[np.cumsum(cut) - 1]
                    for name in sorted(set(names[own])):
                        for r in range(3):
                            found, n = np.unique(codes[(rank == r) & (names[own] == name)], return_counts=True)
                            if len(found):
                                yield pa.RecordBatch.from_arrays(
                                    [pa.array([name] * len(found), pa.string()), pa.array(np.full(len(found), r, np.int32)), pa.array(found.astype(np.int64)), pa.array(n)],
                                    names=["lang", "rank", "code", "n"],
                                )

        counted = sample.mapInArrow(count, "lang string, rank int, code bigint, n bigint").groupBy("lang", "rank", "code").agg(F.sum("n").alias("n"))
        if model is not None:
            counted = materialize(counted, "langid-counts")
            sizes = {(r["lang"], r["rank"]): r["n"] for r in counted.groupBy("lang", "rank").agg(F.sum("n").alias("n")).collect()}
            last = {}  # of each language the last rank it learns from
            for l in {l for l, _ in sizes}:
                own = np.cumsum([sizes.get((l, r), 0) for r in range(3)])
                last[l] = int(np.flatnonzero(own >= least * own[-1])[0])
            pairs = [F.lit(x) for l in sorted(last) for x in (l, last[l])]
            if pairs:
                counted = counted.filter(F.col("rank") <= F.try_element_at(F.create_map(*pairs), F.col("lang")))
        counted = counted.groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
        model = Ppm.train({l: (g["code"].to_numpy(np.uint64), g["n"].to_numpy(np.float64)) for l, g in counted.groupby("lang")}, order)
    return model


def with_language(docs: DataFrame, model: Ppm, *, to: str = "lang_pred", score: str = "score", bits: str = "bits_per_byte") -> DataFrame:
    """``docs`` with the predicted language, its score and the bits a byte costs in it.

    The score is the language's posterior, all languages alike beforehand. Texts that are
    null or have no letter are ``und`` with score 0; so is everything under a model
    without languages. Ties go to the language first by name. Output columns of the same
    names are replaced; other columns pass unchanged.
    """
    spark = docs.sparkSession
    ship(spark)
    ensure_short_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = held.value
        for texts in slices(batches):
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            n = len(texts)
            name = np.full(n, UNKNOWN, dtype=object)
            sure, per_byte = np.zeros(n), np.zeros(n)
            if own.languages:
                data, offsets = text_bytes(lowered(texts))
                lengths = own.code_lengths(data, offsets)
                best = lengths.argmin(axis=1)
                least = lengths[np.arange(n), best]
                name[letters] = np.array(own.languages, dtype=object)[best[letters]]
                sure = np.where(letters, 1 / np.exp2(np.maximum(least[:, None] - lengths, -1000)).sum(axis=1), 0.0)
                per_byte = np.where(letters, least / np.maximum(np.diff(offsets), 1), 0.0)
            yield pa.StructArray.from_arrays([pa.array(name, pa.string()), pa.array(sure), pa.array(per_byte)], names=["name", "score", "bits"])

    # as nondeterministic: the optimizer then never evaluates it twice, below and above a filter on its result
    found = F.arrow_udf(predict, "struct<name: string, score: double, bits: double>").asNondeterministic()(F.col("text"))
    keep = [c for c in docs.columns if c not in (to, score, bits)]
    return docs.withColumn("_found", found).select(
        *keep, F.col("_found.name").alias(to), F.col("_found.score").alias(score), F.col("_found.bits").alias(bits)
    )
