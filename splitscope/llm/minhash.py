"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Every shingle is hashed once. The hash's highest bits choose one of ``bins`` bins, and each
bin keeps its least hash. An empty bin copies a bin that is not: bins tried in an order
that depends on the empty bin alone (optimal densification: uniform over the bins that
are not empty, independent from bin to bin, and alike for all texts). Of each bin the
lowest four bits are stored, one hexadecimal digit; the share of equal digits is corrected
for those equal by chance.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 4  # a hexadecimal digit a bin


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _bin(h: Column, bins: int) -> Column:
    """Bin of a hash by its highest bits, rising with the signed hash."""
    return F.shiftright(h, 64 - int(math.log2(bins))) + F.lit(bins // 2)


def shingles(text: Column, width: int = 5) -> Column:
    """Hashes of all shingles of ``width`` words (parted by blanks and the controls 9 to 13).

    A shorter text is one shingle, a text without words one empty shingle.
    """
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    # beyond the end get() is null, which a hash skips: a short text hashes what it has
    return _let(hashes, lambda a: F.transform(F.sequence(F.lit(0), F.greatest(F.size(a) - width, F.lit(0))), lambda i: F.xxhash64(*[F.get(a, i + k) for k in range(width)])))


def _minima(hashes: Column, bins: int) -> Column:
    """The least hash of each bin that is not empty, by bin."""
    return _let(F.sort_array(hashes), lambda a: F.filter(a, lambda x, i: (i == 0) | (_bin(x, bins) != _bin(F.get(a, i - 1), bins))))


def _dense(minima: Column, bins: int) -> Column:
    """The minima in an array with a place for each bin, null for the empty ones."""
    blank = F.lit(None).cast("bigint")

    def spread(a: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(-1).cast("long")).otherwise(_bin(F.get(a, i - 1), bins))
            return F.concat(F.array_repeat(blank, (_bin(x, bins) - before - 1).cast("int")), F.array(x))

        last = _bin(F.get(a, F.size(a) - 1), bins)
        return F.concat(F.flatten(F.transform(a, one)), F.array_repeat(blank, (F.lit(bins - 1) - last).cast("int")))

    return _let(minima, spread)


def _densified(dense: Column, bins: int, tries: int = 12) -> Column:
    """Each empty bin filled from the first bin not empty in its own order of bins.

    The order is first ``tries`` bins drawn by hash; where all of these are empty, the
    rest follows by the hash of both bins.
    """
    places = F.sequence(F.lit(0), F.lit(bins - 1))

    def fill(a: Column) -> Column:
        def rest(j: Column) -> Column:
            full = F.filter(places, lambda i: F.get(a, i).isNotNull())
            return F.get(a, F.array_min(F.transform(full, lambda i: F.struct(F.xxhash64(j, i, F.lit("rest")).alias("h"), i.alias("i"))))["i"])

        def one(x: Column, j: Column) -> Column:
            drawn = [F.get(a, F.pmod(F.xxhash64(j, F.lit(t)), F.lit(bins)).cast("int")) for t in range(tries)]
            return F.coalesce(x, *drawn, rest(j))

        return F.transform(a, one)

    return _let(dense, fill)


def _packed(values: Column) -> Column:
    """A hexadecimal digit for each bin: four bits of its value hashed with its number, so
    that bins filled from one another do not agree by the same chance."""
    return F.array_join(F.transform(values, lambda x, j: F.lower(F.hex(F.xxhash64(x, j).bitwiseAND(F.lit((1 << BITS) - 1))))), "")


def fingerprint(text: Column, *, bins: int = 256, width: int = 5) -> Column:
    """Fingerprint of a whole text: ``bins`` hexadecimal digits. A null text counts as empty.

    ``bins`` is a power of two. Equal texts have equal fingerprints.
    """
    return _packed(_densified(_dense(_minima(shingles(F.coalesce(text, F.lit("")), width), bins), bins), bins))


def likeness(a: Column, b: Column, *, bins: int = 256) -> Column:
    """Estimated share of common shingles: equal digits, less those expected by chance, 0 to 1."""
    equal = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda e: e))
    chance = 1 / (1 << BITS)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (equal / F.lit(float(bins)) - F.lit(chance)) / F.lit(1 - chance)))


def range_number(docs: DataFrame, *, range_rows: int = 2048, most_bounds: int = 4096) -> Column:
    """Number of a row's range of ids, rising with doc_id, about ``range_rows`` rows in each.

    The bounds are approximate quantiles of the ids themselves, so ids may lie as unevenly
    as they like; only rows of one id always share a range. At most ``most_bounds`` of
    them go into the plan: where more ranges are wanted, the ids between two bounds are
    parted evenly by value. Null ids have negative numbers, by the hash of ``text``.
    """
    ranges = max(1, math.ceil(docs.count() / range_rows))
    mark = F.xxhash64("text")
    number = F.lit(0)
    if ranges > 1:
        shares = min(ranges, most_bounds)
        parts = math.ceil(ranges / shares)
        # lists go in as one literal: an expression for each of their items would be slow to plan
        wanted = F.split(F.lit(",".join(repr(i / shares) for i in range(1, shares))), ",").cast("array<double>")
        found = docs.agg(F.percentile_approx("doc_id", wanted, F.lit(max(10_000, 8 * shares))).alias("b"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
        if found["b"]:
            bounds = sorted({max(found["lo"] - 1, -(1 << 63)), *found["b"], found["hi"]})
            table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
            steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
            # binary search for the number of bounds below the id; beyond the end get() is null
            below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) < F.col("doc_id"), at + step).otherwise(at))
            number = below
            if parts > 1:
                edge = lambda at: F.get(table, at).cast("double")
                inside = lambda at: (F.col("doc_id").cast("double") - edge(at - 1)) / F.nullif(edge(at) - edge(at - 1), F.lit(0.0))
                part = lambda at: F.coalesce(F.least(F.lit(parts - 1), F.floor(inside(at) * parts).cast("int")), F.lit(0))
                number = _let(below.cast("int"), lambda at: at.cast("long") * parts + part(at))
    return F.when(F.col("doc_id").isNull(), -1 - F.pmod(mark, F.lit(ranges))).otherwise(number).cast("long")


def with_next(docs: DataFrame, carried: list[str], *, range_rows: int = 2048) -> DataFrame:
    """``docs`` with ``next``, a struct of the ``carried`` columns of the next row in descending doc_id.

    After the last row comes the first. Rows are cut into ranges of ids of about
    ``range_rows`` rows, each ordered by itself; only the first row of each range meets the
    last row of the range before it, so no task holds more than a range. Ranges find the next
    one in blocks of 1,024 of them; only the blocks are ordered as a whole. Texts move once:
    the first rows are taken from the exchange that the ranges are ordered from. Equal doc_ids
    follow by the hash of ``text``; null doc_ids come last, in ranges by that hash.
    """
    number = range_number(docs, range_rows=range_rows)
    ranges = docs.select(number.alias("_range")).distinct().withColumn("_block", F.shiftright("_range", 10))
    blocks = ranges.groupBy("_block").agg(F.max("_range").alias("_top"))
    down = Window.orderBy(F.col("_block").desc())
    every = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.withColumn("_below", F.coalesce(F.lead("_top").over(down), F.first("_top").over(every)))
    within = Window.partitionBy("_block").orderBy(F.col("_range").desc())
    turn = ranges.withColumn("_then", F.lead("_range").over(within)).join(blocks, "_block").select("_range", F.coalesce("_then", "_below").alias("_then"))

    base = docs.select("doc_id", *carried, F.xxhash64("text").alias("_mark"), number.alias("_range"))
    order = Window.partitionBy("_range").orderBy(F.col("doc_id").desc_nulls_last(), "_mark")
    # not by row_number() = 1, which would be limited before the exchange: another exchange then
    heads = base.withColumn("_head", F.lag("_mark").over(order).isNull()).filter("_head")
    heads = heads.select(F.col("_range").alias("_then"), *[F.col(c).alias(f"_head_{c}") for c in carried])
    donors = turn.join(heads, "_then").drop("_then")
    ordered = base.withColumns({"_last": F.lead("_mark").over(order).isNull(), **{f"_next_{c}": F.lead(c).over(order) for c in carried}})
    following = F.struct(*[F.when(F.col("_last"), F.col(f"_head_{c}")).otherwise(F.col(f"_next_{c}")).alias(c) for c in carried])
    return ordered.join(donors, "_range").withColumn("next", following).select("doc_id", *carried, "next")


def edited_likeness(docs: DataFrame, *, bins: int = 256, width: int = 5) -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document.

    The edited text has its last third (rounded down, in code points) replaced by the
    first as many of the next document's, in descending doc_id, or all it has. Null texts
    are empty; an empty table gives an empty result; extra columns are ignored.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("fingerprint", fingerprint(F.col("text"), bins=bins, width=width))
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next.text"), F.lit(1), third))
    return (
        with_next(base, ["text", "fingerprint"])
        .select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", F.col("next.fingerprint").alias("_next"))
        .withColumn("edited_fingerprint", fingerprint(F.col("edited"), bins=bins, width=width))
        .select(
            "doc_id",
            "n_chars",
            F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            "fingerprint",
            "edited_fingerprint",
            likeness(F.col("fingerprint"), F.col("edited_fingerprint"), bins=bins).alias("near_edited"),
            likeness(F.col("fingerprint"), F.col("_next"), bins=bins).alias("near_next"),
        )
    )
