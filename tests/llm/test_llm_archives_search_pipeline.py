import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from llm_tables import SF01, clashing, no_docs, odd_docs  # noqa: F401
from pyspark.sql import functions as F

from splitscope.llm import search, warc
from splitscope.llm.common import open_fs

PAGES = "page_id long, url string, html string"


def _sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (9, "http://a/9", "<p>same</p>"),
        (3, None, None), (4, "http://b", ""), (5, "http://c", "é" * 70000), (6, "http://d\r\nX: y", "<b>\r\n\r\nWARC/1.1\r\n</b>"),
        (7, "u", "twice"), (7, "u", "twice"), (7, "v", "twice"), (None, "n", "no id"), (None, None, "no id"), (8, "n", "no id"),
    ]
    return spark.createDataFrame(rows, PAGES)


def test_archives_round_trip(pages):
    manifest = warc.write_archives(pages, file_bytes=400)
    got = warc.read_archives(manifest, payloads=True).collect()
    want = pages.collect()
    key = lambda r: (str(r["page_id"]), r["payload_digest"] if "payload_digest" in r else _sha(r["html"]))
    assert sorted((str(r["page_id"]), r["payload_digest"], r["payload_bytes"]) for r in got) == sorted(
        (str(r["page_id"]), _sha(r["html"]), len((r["html"] or "").encode())) for r in want
    )
    by_payload = {}
    for r in got:
        by_payload.setdefault(r["payload_digest"], []).append(r)
    for digest, own in by_payload.items():
        top = [r for r in own if r["record_type"] == "response"]
        assert len(top) == 1
        assert (top[0]["page_id"] or -1) == max(r["page_id"] or -1 for r in own)
        assert top[0]["payload"].decode() in {r["html"] or "" for r in want}
        for r in own:
            if r is not top[0]:
                assert (r["record_type"], r["refers_to"], bytes(r["payload"])) == ("revisit", top[0]["page_id"], b"")
    assert key(got[0]) and all(r["refers_to"] is None for r in got if r["record_type"] == "response")


def test_small_payloads_are_all_responses(pages):
    got = warc.read_archives(warc.write_archives(pages, min_revisit_bytes=6)).collect()
    for r in got:
        if r["payload_bytes"] < 6:
            assert r["record_type"] == "response"
    assert sum(r["record_type"] == "revisit" for r in got) == 2


def test_archives_of_empty_and_clashing_tables(spark, pages):
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0
    wide = pages.withColumns({n: F.lit(1) for n in ("file", "records", "refers_to", "payload", "folder")})
    assert warc.read_archives(warc.write_archives(wide)).count() == pages.count()


def test_files_are_standard_gzip_members(pages):
    m = warc.write_archives(pages).first()
    system, path = open_fs(f"{m['folder']}/{m['file']}")
    with system.open_input_stream(path, compression=None) as f:
        raw = f.read()
    members = 0
    while raw:
        d = zlib.decompressobj(31)
        text = d.decompress(raw)
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: ") and text.endswith(b"\r\n\r\n") and d.eof
        raw = d.unused_data
        members += 1
    assert members == m["records"] + 1


def _reader(raw):
    at = [0]

    def read(n):
        out = raw[at[0] : at[0] + n]
        at[0] += n
        return out

    return read


def test_reader_finds_faults():
    head = {"WARC-Record-ID": "<urn:page:1>", "Content-Type": "application/http; msgtype=response"}
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nhello"
    good = warc.record("response", head | {"WARC-Payload-Digest": f"sha1:{warc.base32_sha1(b'hello')}"}, block)
    for piece in (1, 7, 65536):
        rows = list(warc.read_records(_reader(good * 3), piece=piece, payloads=True))
        assert [r["payload"] for r in rows] == [b"hello"] * 3 and rows[0]["http"]["content-length"] == "5"
    wrong = warc.record("response", head | {"WARC-Payload-Digest": f"sha1:{warc.base32_sha1(b'other')}"}, block)
    plain = zlib.decompress(good, 31)

    def packed(text):
        p = zlib.compressobj(6, zlib.DEFLATED, 31)
        return p.compress(text) + p.flush()

    bad = [wrong, good[:-9], packed(plain[:-4]), packed(plain + b"x"), packed(plain.replace(b"WARC/1.1", b"FTP/1")), packed(plain.replace(b"hello", b"jello")), packed(b"WARC/1.1\r\n")]
    for raw in bad:
        with pytest.raises(ValueError):
            list(warc.read_records(_reader(raw)))
    assert list(warc.read_records(_reader(b""))) == []


# ------------------------------------------------------------------ search


def _bm25(docs, query):
    words = re.compile(rb"[0-9a-z\x80-\xff]+")
    bags = [Counter(words.findall((t or "").lower().encode())) for _, t in docs]
    n, size = len(bags), [sum(b.values()) for b in bags]
    mean = sum(size) / n
    df = Counter(t for b in bags for t in b)
    asked = Counter(words.findall((query or "").lower().encode()))
    out = []
    for (i, _), b, l in zip(docs, bags, size):
        s = sum(q * math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * l / mean)) for t, q in asked.items() if b[t])
        if s > 0:
            out.append((i, s))
    return sorted(out, key=lambda x: (-x[1], x[0]))


def test_search_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").filter("doc_id < 300").collect()]
    docs += [(1000, "same words here"), (1001, "same words here"), (1002, None), (1003, "")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    asked = [(i, t) for i, t in docs if i % 20 == 0] + [(5000, "the the of"), (5001, "same words"), (5002, None), (5003, "zzzunknown"), (None, "the")]
    queries = spark.createDataFrame(asked, "query_id long, text string").withColumn("doc_id", F.lit("x"))
    for shard_rows in (40, 1 << 14):
        rows = search.bm25_top_k(table, queries, 5, shard_rows=shard_rows, query_rows=7).collect()
        got = {}
        for r in sorted(rows, key=lambda r: r["rank"]):
            got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
        for q, t in asked:
            want = _bm25(docs, t)[:5] if q is not None else []
            mine = got.get(q, [])
            assert [s for _, s in mine] == pytest.approx([s for _, s in want]), q
        assert got[5001] == got[5001] and [d for d, _ in got[5001]][:2] == [1000, 1001]


def test_search_of_empty_tables(spark, no_docs, odd_docs, clashing):
    asked = spark.createDataFrame([(1, "quick fox")], "query_id long, text string")
    assert search.bm25_top_k(no_docs, asked).count() == 0
    assert search.bm25_top_k(odd_docs, asked.limit(0)).count() == 0
    rows = search.bm25_top_k(clashing, asked, 3).collect()
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["rank"])] == [1, 2, 2]


def test_search_carries_its_threshold_through_the_shards(spark, tmp_path):
    """Queries meet index files one after the other: results are those of brute force, and later shards are pruned."""
    import numpy as np
    import pyarrow as pa

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(5000 + i, t) for i, t in enumerate(["same words here"] * 3 + [None, ""])]
    bags = [next(search.terms(pa.array([t], pa.string())), None) for _, t in docs]
    n, mean = len(docs), sum(int(b[5].sum()) for b in bags) / len(docs)
    df = Counter(t for b in bags for t in b[3].tolist())
    asked = [i for i in range(n) if i % 25 == 0]
    weights = [np.array([math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * c for t, c in zip(bags[i][3].tolist(), bags[i][4].tolist())]) for i in asked]
    cut = np.append(0, np.cumsum([len(w) for w in weights]))
    queries = search.Queries(cut, np.concatenate([bags[i][3] for i in asked]), np.concatenate(weights), 3)
    share = []
    for s in range(3):
        own = range(s, n, 3)
        text = np.concatenate([np.full(len(bags[d][3]), j, dtype=np.int32) for j, d in enumerate(own)])
        whole = [np.concatenate([bags[d][i] for d in own]) for i in (3, 4, 5)]
        index = search.Index(np.array([docs[d][0] for d in own]), text, *whole, mean, block=8)
        with pa.OSFile(str(tmp_path / "index"), "wb") as out:
            index.write(out)
        index = search.Index.read_from(pa.OSFile(str(tmp_path / "index")))
        index.search(queries)
        share.append(index.read / index.asked)
    assert max(share[1:]) < 0.9 * share[0], share
    for j, i in enumerate(asked):
        want = _bm25(docs, docs[i][1])[:3]
        assert queries.scores[j].tolist() == pytest.approx([s for _, s in want]), i
        assert len({d for d, _ in want} - set(queries.docs[j].tolist())) == 0 or len({round(s, 9) for _, s in want}) < len(want), i


def test_search_keeps_matrices_by_panel(tmp_path):
    """Documents of two vocabularies: a panel multiplies its own frequent terms only, and results are those of scoring all
    documents; also in a shard too large for postings of 4 bytes."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    for n, words in ((600, 12), (1 << 16 | 40, 3)):
        rows = [np.unique(rng.zipf(1.4, words) % 500 + 1000 * (d % 2)) for d in range(n)]
        text, term = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows]), np.concatenate(rows)
        count, mean = rng.integers(1, 4, len(term)), 10.0
        length = np.bincount(text, weights=count, minlength=n).astype(np.int64)
        index = search.Index(np.arange(n) * 7, text, term, count, length, mean, block=16, often=6, panel=100)
        with pa.OSFile(str(tmp_path / f"index{n}"), "wb") as out:
            index.write(out)
        index = search.Index.read_from(pa.OSFile(str(tmp_path / f"index{n}")))
        asked = rng.choice(n, 60, replace=False)
        weight = {t: float(w) for t, w in zip(np.unique(term).tolist(), rng.random(len(np.unique(term))) + 0.1)}
        cut = np.append(0, np.cumsum([len(rows[d]) for d in asked]))
        names = np.concatenate([rows[d] for d in asked])
        queries = search.Queries(cut, names, np.array([weight[t] for t in names.tolist()]), 5)
        index.search(queries, together=25)
        if n == 600:
            assert sum(matrix.size for _, _, _, matrix, _ in index.parts) < 0.6 * index.n * len(index.columns)
        each = count * 2.2 / (count + 1.2 * (0.25 + 0.75 * length / mean)[text])
        for i, d in enumerate(asked):
            score = np.bincount(text, weights=each * np.where(np.isin(term, rows[d]), [weight[t] for t in term.tolist()], 0), minlength=n)
            best = np.lexsort((np.arange(n), -np.round(score, 9)))[:5]
            assert queries.scores[i].tolist() == pytest.approx(score[best][score[best] > 0].tolist()), (n, i)
            held = np.isin(queries.docs[i], np.flatnonzero(score >= score[best[-1]] - 1e-9) * 7)
            assert held.all() and len(set(queries.docs[i].tolist())) == len(queries.docs[i]), (n, i)


def test_search_sorts_terms_that_share_their_first_bits(monkeypatch):
    """Terms come by text, then term, with their counts, whatever their hashes have in common."""
    import numpy as np
    import pyarrow as pa

    texts = ["b a c a", "", None, "c b b a d", "d"]
    for spread in (1, 1 << 61, -(1 << 61)):
        monkeypatch.setattr(search, "run_hashes", lambda data, start, end: (data[start].astype(np.int64) * spread).view(np.uint64))
        for window in (1 << 21, 1):
            found = {}
            for lo, hi, text, term, count, length in search.terms(pa.array(texts), window):
                assert np.array_equal(np.lexsort((term, text)), np.arange(len(text)))
                found |= {(lo + i, t): n for i, t, n in zip(text.tolist(), term.tolist(), count.tolist())}
                assert length.tolist() == [len((t or "").split()) for t in texts[lo:hi]]
            want = {}
            for i, t in enumerate(texts):
                for word in (t or "").split():
                    key = (i, int((np.array([ord(word)], np.int64) * spread)[0]))
                    want[key] = want.get(key, 0) + 1
            assert found == want


def test_search_scores_found_documents_by_the_terms_they_share():
    """Long and short documents found by one query, in blocks of unequal size: scores are those of all their terms."""
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [np.unique(np.append(rng.integers(0, 40, 5), rng.integers(1000, 9000, 800 if d % 9 == 0 else 2))) for d in range(101)]
    text, term = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows]), np.concatenate(rows)
    count = rng.integers(1, 300, len(term))
    length = np.bincount(text, weights=count).astype(np.int64)
    index = search.Index(np.arange(len(rows)), text, term, count, length, length.mean(), block=7, panel=30)
    asked = [np.arange(0, 40, 3), rows[9], rows[10]]
    weight = [rng.random(len(a)) + 0.1 for a in asked]
    queries = search.Queries(np.append(0, np.cumsum([len(a) for a in asked])), np.concatenate(asked), np.concatenate(weight), 12)
    index.search(queries)
    index.search(queries)
    each = count * 2.2 / (count + 1.2 * (0.25 + 0.75 * length / length.mean())[text])
    for i, (a, w) in enumerate(zip(asked, weight)):
        own = dict(zip(a.tolist(), w.tolist()))
        score = np.bincount(text, weights=each * [own.get(t, 0) for t in term.tolist()])
        # each document is found twice, once in each pass
        best = np.lexsort((np.arange(len(rows)), -score))[:6]
        assert queries.docs[i].tolist() == np.repeat(best, 2).tolist(), i
        assert queries.scores[i].tolist() == pytest.approx(np.repeat(score[best], 2).tolist()), i


def test_search_gathers_no_lists_by_shard(spark):
    """A query's task lists its k best of all shards: nothing is ranked again after it; many equal rows make many indexes."""
    table = spark.createDataFrame([(1, "one word")] * 50 + [(2, "one other word"), (3, "third")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "other word"), (8, "third"), (9, "none")], "query_id long, text string")
    found = search.bm25_top_k(table, asked, 4, shard_rows=5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan, plan
    rows = sorted((r["query_id"], r["rank"], r["doc_id"]) for r in found.collect())
    assert rows == [(7, 1, 2), (7, 2, 1), (7, 3, 1), (7, 4, 1), (8, 1, 3)]
    assert search.bm25_top_k(table, asked, 0).count() == 0
    assert search.bm25_top_k(table, asked, 100).count() == 52


# ------------------------------------------------------------------ pipeline


def test_language_stage_rejects_noise_and_foreign_texts(spark):
    """Planted letter noise and texts of languages no label names go; every other document stays."""
    import random

    import corpus_pipeline

    source = spark.read.parquet(f"{SF01}/documents.parquet")
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)) for n in (60, 200, 1000, 5000)]
    texts += [
        "Ez egy magyar nyelvű szöveg, amelyet a modell sohasem látott, és amelyet el kellene utasítania.",
        "Это русский текст, который модель никогда не видела, поэтому его следует отбросить.",
        "Tämä on suomenkielinen teksti, jota malli ei ole koskaan nähnyt, joten se pitäisi hylätä.",
        "日本語の文章はこのモデルには未知のものであり、取り除かれるべきです。",
    ]
    planted = spark.createDataFrame([(-1 - i, t, None, "planted", len(t)) for i, t in enumerate(texts)], source.schema)
    stage = corpus_pipeline.language(spark, source.unionByName(planted), SF01)
    plan = stage._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1, plan
    ids = {r["doc_id"] for r in stage.select("doc_id").collect()}
    assert min(ids) >= 0 and len(ids) >= 0.999 * source.count()


def test_pipeline_stages(spark, odd_docs, no_docs, clashing):
    import corpus_pipeline

    from splitscope.llm import langid, mixing, pieces, quality, simhash

    source = spark.read.parquet(f"{SF01}/documents.parquet")
    docs = source
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, before, SF01).cache()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == source.columns
        kept.append((before, docs))
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for _, d in kept]
    # language: what is left is what the model is sure of
    model = langid.train(kept[0][0], learn=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    sure = [r for r in langid.with_language(kept[0][0], model).collect() if r["lang_pred"] != "und" and r["score"] >= 0.5]
    assert ids[0] == {r["doc_id"] for r in sure if (r["bits_per_byte"] - 8) * len(r["text"].encode()) <= 64}
    assert len(ids[0]) >= 0.999 * source.count()
    # quality: labelled junk goes, labelled clean text stays
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    assert sum(labels.get(i) == 0 for i in ids[1]) <= 2
    assert sum(i not in ids[1] for i, q in labels.items() if q == 1 and i in ids[0]) <= 5
    # near duplicates: one of each class, by brute force over fingerprints
    rows = sorted((r["doc_id"], simhash.fingerprint(r["text"])) for r in kept[2][0].collect())
    left, seen = [], {}
    prints = [p for _, p in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert ids[2] == {rows[find(i)][0] for i in range(len(rows))} and not left and not seen
    # mixing: the words are those the mix states
    want = {r["doc_id"]: r["taken"] for r in mixing.mix(kept[3][0]).taken().collect() if r["taken"]}
    got = Counter()
    for r in kept[3][1].collect():
        got[r["doc_id"]] += len(r["text"].split())
    assert got == want
    # pieces: the ids decode to the texts
    model_file = __import__("splitscope.llm.queries", fromlist=["x"]).tokenizer_path("piece_bpe_32k.model")
    back = pieces.decoded(kept[4][1], model_file, "ids").groupBy("doc_id").agg(F.sort_array(F.collect_list("decoded")).alias("t")).collect()
    texts = {}
    for r in kept[3][1].collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    assert {r["doc_id"]: list(r["t"]) for r in back} == {k: sorted(v, key=lambda s: s.encode()) for k, v in texts.items()}
    assert quality is not None
    # odd and empty tables pass through
    for table in (clashing, no_docs):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF01)
        assert docs.count() <= table.count() * 3
