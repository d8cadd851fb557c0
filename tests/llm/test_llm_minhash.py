import hashlib

import numpy as np
from llm_tables import clashing, no_docs, odd_docs  # noqa: F401
from pyspark.sql import functions as F

from splitscope.llm import minhash


def _shingles(text, width=5):
    words = text.split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_estimates_follow_jaccard(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(2000)]
    rows = []
    for i in range(120):
        words = list(rng.choice(vocabulary, int(rng.integers(8, 700))))
        other = list(words)
        cut = int(len(words) * rng.random())
        other[cut:] = rng.choice(vocabulary, len(words) - cut)
        rows.append((i, " ".join(words), " ".join(other)))
    table = spark.createDataFrame(rows, "i long, a string, b string")
    got = table.select("i", minhash.likeness(minhash.fingerprint(F.col("a")), minhash.fingerprint(F.col("b"))).alias("s")).collect()
    want = {i: len(_shingles(a) & _shingles(b)) / len(_shingles(a) | _shingles(b)) for i, a, b in rows}
    errors = np.array([r["s"] - want[r["i"]] for r in got])
    assert abs(errors).max() < 0.16 and abs(errors.mean()) < 0.015


def test_densified_bins_copy_full_ones(spark):
    """Every bin holds the least hash of some full bin; full bins keep their own."""
    table = spark.createDataFrame([(" ".join(f"w{i}" for i in range(n)),) for n in (1, 4, 5, 6, 9, 40)], "t string")
    hashes = minhash.shingles(F.col("t"))
    least = minhash._minima(hashes, 32)
    dense = minhash._dense(least, 32)
    for r in table.select(hashes.alias("h"), least.alias("m"), dense.alias("d"), minhash._densified(dense, 32).alias("f")).collect():
        bins = {}
        for h in r["h"]:
            b = (h >> 59) + 16
            bins[b] = min(bins.get(b, h), h)
        assert r["m"] == [bins[b] for b in sorted(bins)]
        assert r["d"] == [bins.get(b) for b in range(32)]
        assert all(f == d if d is not None else f in set(r["m"]) for f, d in zip(r["f"], r["d"]))


def test_edited_texts_against_brute_force(spark, odd_docs):
    got = sorted(minhash.edited_likeness(odd_docs).collect(), key=str)
    rows = odd_docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("m")).collect()
    known = sorted((r for r in rows if r["doc_id"] is not None), key=lambda r: (-r["doc_id"], r["m"]))
    none = sorted((r for r in rows if r["doc_id"] is None), key=lambda r: r["m"])
    order = known + none
    want = []
    for r, n in zip(order, [*order[1:], order[0]]):
        t, third = r["text"], len(r["text"]) // 3
        e = t[: len(t) - third] + n["text"][:third]
        want.append((str(r["doc_id"]), len(t), hashlib.sha256(e.encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    assert all(len(r["fingerprint"]) == 256 and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_next_row_across_ranges(spark):
    ids = [3, 5, 6, 100, 101, 102, 103, 900, -7, 2**40]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    down = sorted(ids, reverse=True)
    for size in (1, 2, 3, 100):
        got = {r["doc_id"]: r["next"]["text"] for r in minhash.with_next(docs, ["text"], range_rows=size).collect()}
        assert got == {a: f"t{b}" for a, b in zip(down, [*down[1:], down[0]])}


def test_ranges_follow_the_ids(spark):
    clustered = [*range(4000), 2**50]
    signed = [-(2**63), 2**63 - 1, *[(i * 0x9E3779B97F4A7C15) % 2**64 - 2**63 for i in range(1, 3000)]]
    for ids in (clustered, signed):
        docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
        rows = docs.select("doc_id", minhash.range_number(docs, range_rows=100).alias("r")).collect()
        numbers = [r["r"] for r in sorted(rows, key=lambda r: r["doc_id"])]
        assert numbers == sorted(numbers) and max(numbers.count(k) for k in set(numbers)) <= 200
        down = sorted(ids, reverse=True)
        got = {r["doc_id"]: r["next"]["text"] for r in minhash.with_next(docs, ["text"], range_rows=100).collect()}
        assert got == {a: f"t{b}" for a, b in zip(down, [*down[1:], down[0]])}


def test_few_bounds_part_the_ids_between_them(spark):
    ids = [-(2**63), 2**63 - 1, *range(-500, 2500), *range(10**6, 10**9, 10**7)]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    numbers = {}
    for most in (2, 5, 4096):
        rows = docs.select("doc_id", minhash.range_number(docs, range_rows=50, most_bounds=most).alias("r")).collect()
        numbers[most] = [r["r"] for r in sorted(rows, key=lambda r: r["doc_id"])]
        assert numbers[most] == sorted(numbers[most])
    # a range is never larger than what lies between two bounds
    assert max(numbers[5].count(k) for k in set(numbers[5])) <= len(ids) / 5 * 1.1
    assert len(set(numbers[4096])) > 50


def test_texts_move_once(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat(concat('t', id, ' '), 40) AS text")
    out = minhash.with_next(docs, ["text"], range_rows=100)
    out.write.format("noop").mode("overwrite").save()
    out.collect()
    plan = _plan(out)
    final = plan.split("Initial Plan")[0]
    assert "ReusedExchange" in final


def test_equal_texts_empty_tables_and_plan(spark, clashing, no_docs):
    same = spark.createDataFrame([(i, "a b c d e f g") for i in range(5)], "doc_id long, text string")
    assert same.select(minhash.fingerprint(F.col("text")).alias("f")).distinct().count() == 1
    assert minhash.edited_likeness(no_docs).count() == 0
    assert minhash.edited_likeness(clashing).count() == clashing.count()
    plan = _plan(minhash.edited_likeness(same))
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
