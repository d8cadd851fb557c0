"""Phrase collocation mining by dynamic itemset counting.

The documents are dealt into shards, which are scanned in turn, again and again. Words are
counted from the first scan on. A longer phrase is activated as soon as both its subphrases
(all words but the last, all but the first) have been counted often enough so far, even
while these are still being counted, and is counted from the next scan on, until it has seen
every shard once: one full cycle, after which its count is that of the whole corpus.
Phrases of all lengths so share the scans; a phrase that reaches the threshold has
subphrases that reach it, so none is missed.

Tasks learn which phrases were activated when from a table of one byte a slot: each phrase
that reaches the threshold writes the number of the scan into a few slots, chosen by hash,
that are still empty. A phrase counts as reached in the last scan found in its slots, or
not yet while one is empty. Slots never change again, so every task sees the same scan for
the same phrase whenever it looks, and collisions only activate phrases early: they are
counted in vain, but by one full cycle like all others, so counts stay exact. The table's
size is fixed; with more phrases than it can tell apart, more are counted in vain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitscope.llm.common import byte_runs, discard, lower_ascii, range_numbers, run_hashes, run_strings, scratch, ship, slices, text_bytes, windows

# Bytes outside words: the blank and the tab between words, the others between pieces.
BLANKS = b"\x20\x09"
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
# each byte's kind: 0 of a word, 1 a blank, 2 a break
_KINDS = bytes(2 if b in BREAKS else 1 if b in BLANKS else 0 for b in range(256))
EMPTY = 255  # a slot no phrase has written yet
_PROBES = 4
# A counted phrase: its language, a tab, its words; and (since * 16 + k) * 256 + reach in one number.
_STATE = "key string, total long, meta int"


# ------------------------------------------------------------------ hashes and slots


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(29))


def string_hashes(values: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(values)
    return run_hashes(data, offsets[:-1], offsets[1:])


def extend(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase that goes on with a word."""
    return _mix(h * np.uint64(0xD1342543DE82EF95) + word)


def phrase_hashes(lang: pa.Array, phrase: pa.Array) -> np.ndarray:
    """The hash of each (lang, space-joined phrase): that of its language, extended word by word."""
    data, offsets = text_bytes(phrase)
    start, end, text = byte_runs(data != 32, offsets)
    word, h = run_hashes(data, start, end), string_hashes(lang)
    first = np.searchsorted(text, np.arange(len(phrase) + 1))
    for j in range(int(np.diff(first).max(initial=0))):
        on = np.flatnonzero(np.diff(first) > j)
        h[on] = extend(h[on], word[first[on] + j])
    return h


def _slot(h: np.ndarray, size: int) -> np.ndarray:
    h = h >> np.uint64(7)
    return (h % np.uint64(size) if size & (size - 1) else h & np.uint64(size - 1)).astype(np.int64)


def slots_of(h: np.ndarray, size: int) -> np.ndarray:
    """The slots of each hash, one row for each probe."""
    step = _mix(h) | np.uint64(1)
    return np.stack([_slot(h + np.uint64(i) * step, size) for i in range(_PROBES)])


def reached(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The scan in which each hash counts as having reached the threshold; EMPTY: not yet."""
    out = table[_slot(h, len(table))]
    some = np.flatnonzero(out < EMPTY)  # one empty slot tells
    h = h[some]
    step = _mix(h) | np.uint64(1)
    for _ in range(1, _PROBES):
        h = h + step
        found = table[_slot(h, len(table))]
        out[some] = np.maximum(out[some], found)
        left = found < EMPTY
        some, h, step = some[left], h[left], step[left]
    return out


# ------------------------------------------------------------------ one scan


def _kinds(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to words, and how many breaks there are up to each."""
    kind = np.frombuffer(part.tobytes().translate(_KINDS), np.uint8)
    return kind == 0, np.cumsum(kind == 2, dtype=np.int32)


def _codes(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers 0, 1, ... of equal keys (0 or more each), and the key of each number."""
    bits = len(key).bit_length()
    if len(key) and not int(key.max()) >> (63 - bits):
        # keys and places fit one number: sorted together, equal keys stand side by side
        both = np.sort(key << bits | np.arange(len(key)))
        place, both = both & ((1 << bits) - 1), both >> bits
        first = np.concatenate([[True], both[1:] != both[:-1]])
        code = np.empty(len(key), np.int64)
        code[place] = np.cumsum(first) - 1
        return code, both[first]
    found = pa.array(key).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.to_numpy(zero_copy_only=False)


def scan_texts(lang: pa.Array, text: pa.Array, table: np.ndarray, step: int, shards: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Partial counts (key, total, meta) of the phrases that scan ``step`` counts, not reached yet.

    k 0 counts all words of a language; words count in the first cycle; a longer phrase
    counts in the ``shards`` scans from ``since`` on, the one after its subphrases' last reach.
    """
    if step > shards:
        yield from _late_scan(lang, text, table, step, shards, longest)
        return
    names = lang.fill_null("und").dictionary_encode()
    data, offsets = text_bytes(text)
    of_text = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    salt = string_hashes(names.dictionary)
    for lo, hi in windows(offsets, 1 << 22):
        part, own = lower_ascii(data[offsets[lo] : offsets[hi]]), offsets[lo : hi + 1] - offsets[lo]
        inside, breaks = _kinds(part)
        start, end, doc = byte_runs(inside, own)
        if not len(start):
            continue
        # words of one piece have one number: breaks before them, and texts before theirs
        piece = breaks[start] + doc
        words = run_strings(part, inside, start, end)
        del part, inside, breaks
        hashes = string_hashes(words.dictionary)
        code, kind = _codes(words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(salt) + of_text[lo + doc])
        word, of_lang = kind // len(salt), kind % len(salt)

        def counts(lang_no: np.ndarray, parts: list[np.ndarray], n: np.ndarray, since: np.ndarray, words=words) -> pa.RecordBatch:
            strings = [words.dictionary.take(pa.array(p)) for p in parts]
            phrase = pc.binary_join_element_wise(*strings, " ") if len(parts) > 1 else strings[0] if parts else pa.array([""] * len(n), pa.string())
            key = pc.binary_join_element_wise(names.dictionary.take(pa.array(lang_no)).cast(pa.string()), phrase, "\t")
            meta = (since.astype(np.int32) * 16 + len(parts)) * 256 + EMPTY
            return pa.RecordBatch.from_arrays([key, pa.array(n), pa.array(meta)], names=["key", "total", "meta"])

        if step < shards:
            n = np.bincount(code, minlength=len(word))
            yield counts(of_lang, [word], n, np.zeros(len(n), np.int32))
            per = np.bincount(of_lang[code], minlength=len(salt))
            some = np.flatnonzero(per)
            yield counts(some, [], per[some], np.zeros(len(some), np.int32))
        # a gram: its first word's place, its number, and per number its words, hash and scan of reach
        at, parts, h = np.arange(len(code)), [word], extend(salt[of_lang], hashes[word])
        reach, langs = reached(table, h), of_lang
        for k in range(2, longest + 1):
            # grams whose two subphrases have both been reached, within one piece
            on = reach[code] < EMPTY
            left = np.flatnonzero(on[:-1] & on[1:] & (at[1:] == at[:-1] + 1))
            left = left[piece[at[left]] == piece[at[left] + k - 1]]
            if not len(left):
                break
            a, b = code[left], code[left + 1]
            at = at[left]
            number, key = _codes(a * len(h) + b)
            a, b = key // len(h), key % len(h)
            since = np.maximum(reach[a], reach[b]).astype(np.int64) + 1
            last = parts[-1][b]
            parts, langs, h = [p[a] for p in parts] + [last], langs[a], extend(h[a], hashes[last])
            active = np.flatnonzero(step < since + shards)
            if len(active):
                n = np.bincount(number, minlength=len(key))
                yield counts(langs[active], [p[active] for p in parts], n[active], since[active])
            code, reach = number, reached(table, h)


def _late_scan(lang: pa.Array, text: pa.Array, table: np.ndarray, step: int, shards: int, longest: int) -> Iterator[pa.RecordBatch]:
    """``scan_texts`` of the scans that count no words any more and few pairs: most words reach in
    the first scan, so most pairs are counted by the end of the second cycle's first.

    The few phrases still counted are found by hashes at every place of the texts; only these
    are read as strings, and told apart as strings.
    """
    names = lang.fill_null("und").dictionary_encode()
    data, offsets = text_bytes(text)
    of_text = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    salt = string_hashes(names.dictionary)
    for lo, hi in windows(offsets, 1 << 20):
        part, own = lower_ascii(data[offsets[lo] : offsets[hi]]), offsets[lo : hi + 1] - offsets[lo]
        inside, breaks = _kinds(part)
        start, end, doc = byte_runs(inside, own)
        if not len(start):
            continue
        piece = breaks[start] + doc
        word, of_lang = run_hashes(part, start, end), of_text[lo + doc]
        # a gram: its first word's place, its hash and scan of reach
        at, h = np.arange(len(start)), extend(salt[of_lang], word)
        for k in range(2, longest + 1):
            reach = reached(table, h)
            on = reach < EMPTY
            left = np.flatnonzero(on[:-1] & on[1:] & (at[1:] == at[:-1] + 1))
            left = left[piece[at[left]] == piece[at[left] + k - 1]]
            if not len(left):
                break
            since = np.maximum(reach[left], reach[left + 1]).astype(np.int64) + 1
            at, h = at[left], extend(h[left], word[at[left] + k - 1])
            active = np.flatnonzero(step < since + shards)
            if len(active):
                first = at[active]
                strings = [names.dictionary.take(pa.array(of_lang[first])).cast(pa.string()), pc.binary_join_element_wise(*(_strings(part, start[first + j], end[first + j]) for j in range(k)), " ")]
                found = pc.binary_join_element_wise(*strings, "\t").dictionary_encode()
                code = found.indices.to_numpy(zero_copy_only=False)
                when = np.zeros(len(found.dictionary), dtype=np.int32)
                when[code] = since[active]
                yield pa.RecordBatch.from_arrays([found.dictionary, pa.array(np.bincount(code)), pa.array((when * 16 + k) * 256 + EMPTY)], names=["key", "total", "meta"])


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.StringArray:
    """Byte runs, in any order, as strings."""
    offsets = np.zeros(len(start) + 1, dtype=np.int32)
    np.cumsum(end - start, out=offsets[1:])
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[range_numbers(start, end - start)]))


# ------------------------------------------------------------------ the job


def count_phrases(docs: DataFrame, *, least: int = 30, longest: int = 4, shards: int = 3, slots: int = 1 << 24) -> DataFrame:
    """(lang, phrase, k, total): phrases of 1 to ``longest`` words that occur ``least`` times or more.

    ``docs`` needs lang and text. Rows of k 0 hold all words of a language. Counts are those
    of the whole corpus. Scans end when no phrase is active; their number is at most
    ``shards`` times ``longest``. Each scan writes its state, and what it builds on goes
    once that is written, so a lost executor repeats part of one scan.
    """
    spark = docs.sparkSession
    ship(spark)
    if shards * longest >= EMPTY or longest > 15:
        raise ValueError("too many scans for one byte a slot, or phrases too long")
    folder = scratch(spark, "phrases")
    dealt = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    # equal texts of one language go on by a number of their task, so that copies spread over the shards
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("lang", "text") + F.monotonically_increasing_id(), F.lit(shards)).cast("int"))
    dealt.write.partitionBy("shard").parquet(f"{folder}/texts")
    texts = spark.read.schema("lang string, text string, shard int").parquet(f"{folder}/texts")
    table = np.full(slots, EMPTY, dtype=np.uint8)
    before, step = None, 0
    while True:
        shared = spark.sparkContext.broadcast(table)

        def scan(batches: Iterator[pa.RecordBatch], step=step, shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 4096):
                yield from scan_texts(batch.column(0), batch.column(1), shared.value, step, shards, longest)

        fresh = texts.filter(F.col("shard") == step % shards).select("lang", "text")
        fresh = fresh.mapInArrow(scan, _STATE)
        if before is not None:
            fresh = fresh.unionByName(before)
        k, since, reach = (F.shiftright("meta", 8).bitwiseAND(15), F.shiftright("meta", 12), F.col("meta").bitwiseAND(255))
        now = (F.col("total") >= least) & k.between(1, longest - 1) & (reach == EMPTY)
        state = fresh.groupBy(F.col("key").cast("binary").alias("key")).agg(F.sum("total").alias("total"), F.min("meta").alias("meta"))
        state = state.withColumn("key", F.col("key").cast("string"))
        state = state.withColumn("meta", F.when(now, F.col("meta") - EMPTY + step).otherwise(F.col("meta")))
        over = since + shards - 1 <= step
        # over * 2 + new: files of one column's value are sorted by that number alone
        state = state.withColumn("part", over.cast("int") * 2 + (reach == step).cast("int")).filter(~over | (F.col("total") >= least) | (k == 0))
        state.write.partitionBy("part").parquet(f"{folder}/step-{step}")
        if before is not None:
            for i in (0, 1):
                discard(f"{folder}/step-{step - 1}/part={i}")
        shared.unpersist()
        state = spark.read.schema(_STATE + ", part int").parquet(f"{folder}/step-{step}")
        new = _mark(state.filter("part IN (1, 3)").select(*_named()), slots)
        table[new[table[new] == EMPTY]] = step
        before = state.filter("part < 2").drop("part")
        step += 1
        # after the first cycle only phrases over a subphrase reached within the last cycle are active
        recent = table < EMPTY
        if step >= shards and not (recent & (table.astype(np.int16) >= step - shards)).any():
            break
    discard(f"{folder}/texts")
    steps = [spark.read.schema(_STATE + ", part int").parquet(f"{folder}/step-{i}").filter("part >= 2") for i in range(shards - 1, step)]
    out = steps[0]
    for more in steps[1:]:
        out = out.unionByName(more)
    return out.select(*_named(), F.shiftright("meta", 8).bitwiseAND(15).alias("k"), "total")


def _named() -> list[Column]:
    """Language and phrase of a key: words hold no tab, a language may."""
    phrase = F.substring_index("key", "\t", -1)
    return [F.expr("left(key, length(key) - length(substring_index(key, '\t', -1)) - 1)").alias("lang"), phrase.alias("phrase")]


def _mark(phrases: DataFrame, slots: int) -> np.ndarray:
    """The slots that phrases (lang, phrase) write to. Tasks and reducers join them as bit sets,
    so at most one row for every 32 slots reaches the driver."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 14):
            if len(batch):
                slot = np.unique(slots_of(phrase_hashes(batch.column(0), batch.column(1)), slots))
                first = np.flatnonzero(np.concatenate([[True], slot[1:] >> 5 != slot[:-1] >> 5]))
                bits = np.bitwise_or.reduceat(np.int64(1) << (slot & 31), first)
                yield pa.RecordBatch.from_arrays([pa.array((slot[first] >> 5).astype(np.int32)), pa.array(bits)], names=["place", "bits"])

    rows = phrases.mapInArrow(mark, "place int, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    held = np.zeros(-(-slots // 32), dtype="<u4")
    held[rows.column("place").to_numpy()] = rows.column("bits").to_numpy()
    return np.flatnonzero(np.unpackbits(held.view(np.uint8), bitorder="little")[:slots])


def _words(i: int | Column, n: int | Column, phrase: str = "phrase") -> Column:
    """``n`` words of a phrase from the i-th on."""
    i, n = (c if isinstance(c, Column) else F.lit(c) for c in (i, n))
    head = F.call_function("substring_index", F.col(phrase), F.lit(" "), i + n - 1)
    return F.call_function("substring_index", head, F.lit(" "), -n)


def collocations(docs: DataFrame, *, least: int = 30, longest: int = 4, top: int = 2000, share: int = 80, shards: int = 3, slots: int = 1 << 24, buckets: int = 64) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    ``docs`` needs lang (null: ``und``) and text (null: empty). A-Z are lower-cased; pieces end
    at ``BREAKS``, words at ``BLANKS``; a phrase stays within one piece. A phrase of two words
    or more that occurs a >= ``least`` times scores floor(2000000 a / (l + r)) at its
    lowest-scoring cut (ties: the earliest), l and r being the counts of the two parts, unless
    a longer phrase that holds its words occurs at least ``share`` percent as often. Equal scores
    come by a descending, then by phrase in byte order. Repeated rows count each; empty
    and null texts, texts of blanks and breaks only, and empty tables give no phrase; extra
    columns are ignored. Arithmetic is in DECIMAL(38,0).
    """
    counts = count_phrases(docs, least=least, longest=longest, shards=shards, slots=slots)
    all_words = counts.filter("k = 0").select("lang", F.col("total").alias("n"))
    phrases = counts.filter("k > 1").select("lang", "phrase", "k", F.col("total").alias("a"))
    # the greatest count of a longer phrase around each shorter one
    inner = phrases.filter("k > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
    inner = inner.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1)))
    around = inner.select("lang", _words(F.col("i"), F.col("m")).alias("phrase"), F.col("a").alias("b")).groupBy("lang", "phrase").agg(F.max("b").alias("b"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    held = phrases.join(around, ["lang", "phrase"], "left").filter(F.col("b").isNull() | (wide("b") * 100 < wide("a") * share)).drop("b")
    # every cut of a phrase, and the counts of both its parts
    cuts = held.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    parts = counts.filter("k > 0").select("lang", F.col("phrase").alias("part"), "total")
    cuts = cuts.withColumns({"left": _words(1, F.col("cut")), "right": _words(F.col("cut") + 1, F.col("k") - F.col("cut"))})
    cuts = cuts.join(parts.select("lang", F.col("part").alias("left"), F.col("total").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("part").alias("right"), F.col("total").alias("r")), ["lang", "right"])
    score = F.expr("CAST((CAST(2000000 * CAST(a AS DECIMAL(28,0)) AS DECIMAL(38,0))) div (CAST(l AS DECIMAL(38,0)) + r) AS BIGINT)")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("c"))
    scored = scored.select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    # a language may hold most phrases: the best of each bucket first, then the best of these
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(buckets))).orderBy(*order)
    scored = scored.withColumn("_place", F.row_number().over(some)).filter(F.col("_place") <= top)
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return scored.join(all_words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
