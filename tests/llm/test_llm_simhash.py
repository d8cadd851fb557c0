import random

import numpy as np
import xxhash

from llm_tables import clashing, no_docs, odd_docs  # noqa: F401
from splitscope.llm import simhash
from splitscope.llm.components import components


def _brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _classes(prints, max_bits):
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= max_bits:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(prints))]


def test_fingerprints():
    for t in [None, "", "  \n", "One", "one two", "A b C", "a b c d", "ÄB äb x y\x0bz w " * 40, "the cat " * 500]:
        assert simhash.fingerprint(t) == _brute_print(t), t


def test_links_against_brute_force(spark):
    rng = random.Random(3)
    prints = {0, (1 << 64) - 1, 7, 1 << 63}
    for _ in range(12):
        base = rng.getrandbits(64)
        prints.add(base)
        for _ in range(25):
            x = base
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(p,) for p in signed], "fp long")
    for max_bits, group in ((3, 2048), (3, 3), (1, 2048), (0, 2048), (5, 8)):
        got = {r["node"]: r["label"] for r in components(simhash.links(table, max_bits, group=group)).collect()}
        want = _classes(prints, max_bits)
        mine = [got.get(s, s) for s in signed]
        pairs = lambda x: {(i, j) for i in range(len(x)) for j in range(i) if x[i] == x[j]}
        assert pairs(mine) == pairs(want), (max_bits, group)


def test_no_more_links_than_members(spark):
    """A dense group leaves a forest, not its pairs."""
    table = spark.createDataFrame([(i,) for i in range(256)], "fp long")
    n = simhash.links(table, 3).distinct().count()
    assert 0 < n < 256 * 64


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 500), (600, 601), (601, 600), (None, 3)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(101)}, 600: 600, 601: 600}
    assert components(links.limit(0)).count() == 0


def test_near_duplicates_of_odd_rows(odd_docs, no_docs, clashing):
    rows = odd_docs.collect()
    prints = [simhash.fingerprint(r["text"]) for r in rows]
    classes = _classes(prints, 3)
    want = []
    for r, p, c in zip(rows, prints, classes):
        ids = [q["doc_id"] for q, d in zip(rows, classes) if d == c and q["doc_id"] is not None]
        want.append((str(r["doc_id"]), f"{p:016x}", str(min(ids) if ids else None)))
    got = simhash.near_duplicates(odd_docs).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == sorted(want)
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.near_duplicates(clashing).count() == len(rows)
    kept = simhash.deduplicated(clashing)
    assert kept.columns == clashing.columns
    assert kept.count() == len(set(classes)) == simhash.deduplicated(odd_docs).count()
    assert {r["doc_id"] for r in kept.collect()} == {min((q["doc_id"] for q, d in zip(rows, classes) if d == c and q["doc_id"] is not None), default=None) for c in set(classes)}
    assert simhash.deduplicated(no_docs).count() == 0


def test_unlike_texts_under_one_id_both_stay(spark):
    x, y = "the quick brown fox jumps over the lazy dog", "ein ganz anderer text ohne gemeinsame worte"
    assert _classes([simhash.fingerprint(x), simhash.fingerprint(y)], 3) == [0, 1]
    for i in (5, None):
        docs = spark.createDataFrame([(i, x), (i, y), (9, x), (9, y), (i, y)], "doc_id long, text string")
        assert sorted((str(r["doc_id"]), r["text"]) for r in simhash.deduplicated(docs).collect()) == sorted([(str(i or 9), x), (str(i or 9), y)])
    nulls = spark.createDataFrame([(None, x), (None, y), (None, x)], "doc_id long, text string")
    assert sorted(r["text"] for r in simhash.deduplicated(nulls).collect()) == sorted([x, y])


def test_linked_checks_chain_and_distance():
    ring = simhash.Ring(3)
    kinds = np.arange(len(ring.kinds))
    rng = np.random.default_rng(0)
    for _ in range(300):
        x = 0
        for b in rng.choice(64, size=int(rng.integers(0, 6)), replace=False):
            x |= 1 << int(b)
        # some key must be shared and pass just when the distance allows it
        shared = [k for k, (_, _, mask, _) in enumerate(ring.kinds) if x & mask == 0]
        ok = ring.linked(kinds[shared], np.zeros(len(shared), np.uint64), np.full(len(shared), x, np.uint64))
        assert ok.any() == (x.bit_count() <= 3)
