import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from llm_tables import clashing, no_docs, odd_docs, SF01  # noqa: F401
from splitscope.llm import chat, collocations, ranked

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ------------------------------------------------------------------ collocations


def phrases_by_rule(docs, least, longest=4, top=2000, share=80):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, count in f.items():
        cand = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        held = dict(cand)
        for p, b in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    q = p[i : i + m]
                    if 100 * b >= share * cand[q]:
                        held.pop(q, None)
        rows = []
        for p, a in held.items():
            score, _, l, r = min((2000000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def found_phrases(df, **parameters):
    return sorted(map(tuple, collocations.collocations(df, **parameters).collect()))


@pytest.fixture(scope="module")
def phrase_docs(spark):
    rng = np.random.default_rng(3)
    words = ["a", "B", "c", "dé", "E.", "f,", "g", "New", "york", "city\tHall", "\n", "ß!"]
    rows = []
    for i in range(160):
        n = int(rng.integers(0, 40))
        rows.append((i, " ".join(rng.choice(words[: int(rng.integers(3, 13))], n)), ["en", "d\te", None, "und"][i % 4], "s", n))
    rows += [(500 + i, "new york city hall. new york", "en", "s", 28) for i in range(40)]
    rows += [(7, None, "en", None, None), (None, "", None, None, 0), (8, " \t.,\n", "xx", None, 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("parameters", [{"shards": 3, "slots": 1 << 16}, {"shards": 1, "slots": 1 << 16}, {"shards": 2, "slots": 64}, {"shards": 2, "longest": 2, "slots": 1 << 12}, {"top": 5, "buckets": 3, "slots": 1 << 16}])
def test_collocations_equal_a_count_of_all_phrases(phrase_docs, parameters):
    """Also with a table of 64 slots, which activates nearly everything early."""
    rows = [(r["lang"], r["text"]) for r in phrase_docs.collect()]
    rule = {k: v for k, v in parameters.items() if k in ("longest", "top")}
    assert found_phrases(phrase_docs, least=8, **parameters) == phrases_by_rule(rows, 8, **rule)


def test_collocations_odd_tables(odd_docs, no_docs, clashing):
    rows = [(r["lang"], r["text"]) for r in odd_docs.collect()]
    want = phrases_by_rule(rows, 2)
    assert any(r[0] == "la" for r in want)
    assert found_phrases(odd_docs, least=2, shards=2, slots=1 << 12) == want
    assert found_phrases(clashing, least=2, shards=2, slots=1 << 12) == want
    assert found_phrases(no_docs, shards=2, slots=1 << 12) == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="aAb .,\té\n", max_size=30), max_size=12), st.integers(1, 3))
def test_scans_count_each_active_phrase_for_one_cycle(texts, shards):
    """The scans without Spark: counts by phrase over a whole cycle equal the true counts."""
    least, table = 2, np.full(1 << 10, collocations.EMPTY, np.uint8)
    total, reach, since = Counter(), {}, {}
    for step in range(4 * shards):
        part = texts[step % shards :: shards]
        batches = list(collocations.scan_texts(pa.array(["x"] * len(part), pa.string()), pa.array(part, pa.string()), table, step, shards, 4))
        for b in batches:
            for row in b.to_pylist():
                lang, phrase = row["key"].split("\t")
                key = (row["meta"] >> 8 & 15, phrase)
                total[key] += row["total"]
                assert lang == "x" and row["meta"] & 255 == collocations.EMPTY
                assert since.setdefault(key, row["meta"] >> 12) == row["meta"] >> 12
        for (k, p), n in total.items():
            if 1 <= k < 4 and n >= least and (k, p) not in reach:
                reach[k, p] = step
                slots = collocations.slots_of(collocations.phrase_hashes(pa.array(["x"]), pa.array([p])), len(table)).ravel()
                table[slots[table[slots] == collocations.EMPTY]] = step
    want = Counter()
    for t in texts:
        for piece in re.split("[.,;:!?\x0a-\x0d]", t.translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            want[0, ""] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    want[k, " ".join(w[i : i + k])] += 1
    for key, n in want.items():
        if n and (key[0] < 2 or n >= least):
            assert total[key] == n


def test_late_scans_read_only_counted_phrases_as_strings(monkeypatch):
    """Once words and pairs are counted, a scan makes no dictionary of all words; its counts are those of the texts."""
    texts = ["a b \t c d. a b c x", "B a b  c\td", "a b\nc a b, c d", ""]
    table = np.full(1 << 16, collocations.EMPTY, dtype=np.uint8)
    mark = {0: ["a", "b", "c", "d"], 3: ["a b", "b c", "c d"], 5: ["a b c", "b c d"]}
    for step, phrases in mark.items():
        slots = collocations.slots_of(collocations.phrase_hashes(pa.array(["l"] * len(phrases)), pa.array(phrases)), len(table)).ravel()
        table[slots[table[slots] == collocations.EMPTY]] = step

    def never(*_):
        raise AssertionError("all words as strings")

    monkeypatch.setattr(collocations, "run_strings", never)
    scan = lambda step: {tuple(r.values()) for b in collocations.scan_texts(pa.array(["l"] * 4), pa.array(texts), table, step, 3, 4) for r in b.to_pylist()}
    meta = lambda since, k: (since * 16 + k) * 256 + collocations.EMPTY
    assert scan(6) == {("l\ta b c", 3, meta(4, 3)), ("l\tb c d", 2, meta(4, 3)), ("l\ta b c d", 2, meta(6, 4))}
    assert scan(7) == scan(8) == {("l\ta b c d", 2, meta(6, 4))} and scan(9) == set()


def test_scans_of_the_second_cycle_make_no_dictionary_of_all_words(monkeypatch):
    """Pairs still counted after the second cycle's first scan are found at their places as well."""
    texts = ["a b \t c d. a b c x", "B a b  c\td", None]
    table = np.full(1 << 16, collocations.EMPTY, dtype=np.uint8)
    for step, phrases in {0: ["a"], 2: ["b", "c", "d"], 3: ["a b", "b c"]}.items():
        slots = collocations.slots_of(collocations.phrase_hashes(pa.array(["l"] * len(phrases)), pa.array(phrases)), len(table)).ravel()
        table[slots[table[slots] == collocations.EMPTY]] = step

    def never(*_):
        raise AssertionError("all words as strings")

    monkeypatch.setattr(collocations, "run_strings", never)
    found = {tuple(r.values()) for b in collocations.scan_texts(pa.array(["l"] * 3), pa.array(texts), table, 4, 3, 4) for r in b.to_pylist()}
    meta = lambda since, k: (since * 16 + k) * 256 + collocations.EMPTY
    pairs = {("l\ta b", 3, meta(3, 2)), ("l\tb c", 3, meta(3, 2)), ("l\tc d", 2, meta(3, 2)), ("l\tb a", 1, meta(3, 2))}
    assert found == pairs | {("l\ta b c", 3, meta(4, 3))}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9) | st.integers(0, (1 << 62) - 1), max_size=40))
def test_numbers_of_equal_keys(keys):
    code, key = collocations._codes(np.array(keys, np.int64))
    assert key[code].tolist() == keys and len(set(key.tolist())) == len(key) == len(set(keys))


def test_words_of_a_phrase(spark):
    rows = spark.createDataFrame([("a é c d", 1, 4), ("a é c d", 2, 2), ("a é c d", 4, 1), ("a", 1, 1), ("aa a aa", 2, 2)], "phrase string, i int, n int")
    got = [r[0] for r in rows.select(collocations._words(F.col("i"), F.col("n")), collocations._words(1, F.col("n"))).collect()]
    assert got == ["a é c d", "é c", "d", "a", "a aa"]


def test_reach_is_the_last_scan_of_all_slots():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    for size in (1 << 10, 1000):
        table = np.where(rng.random(size) < 0.7, rng.integers(0, 9, size), collocations.EMPTY).astype(np.uint8)
        assert (collocations.reached(table, h) == table[collocations.slots_of(h, size)].max(axis=0)).all()


# ------------------------------------------------------------------ chat


def chats_by_rule(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        learned = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (
            len(turns),
            hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
            len(learned),
            hashlib.sha256(learned.encode()).hexdigest(),
            len(chat.inst_template(turns)),
            None,
        )
    return out


def read_back(df, **parameters):
    rows = chat.read_conversations(chat.format_conversations(df, **parameters)).collect()
    out = {r["conv_id"]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


TEXT = st.text(alphabet=st.sampled_from([*"a\\<>/s[]INSTROLE \n", "é", "😀", "\0"]), max_size=12) | st.sampled_from([*chat.CONTROL, "</s>[INST] ok [/INST]", "\\</s>", "<\\/s>", "</s"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", ""]) | TEXT, TEXT), max_size=7))
def test_template_round_trip_and_spans(turns):
    text = chat.inst_template(turns)
    assert list(chat.inst_turns(text)) == turns
    assert all(chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROL) for _, t in turns)
    found = chat.locate(chat.inst_template, turns)
    assert found.text == text and found.rewrites is None
    assert [chat.inst_template(turns[: i + 1])[a:] for i, (a, _) in enumerate(found.spans)] == [text[a:b] for a, b in found.spans]
    assert [chat.unescape(text[a:b]) for a, b in found.loss] == [t for r, t in turns if r == "assistant"]
    # in blocks of two turns: the same text, piece by piece
    parts = list(chat._blocks(chat.inst_template, iter(turns), ("assistant",), 2, 1))
    assert "".join(p.text for p in parts) == text and all(p.rewrites is None for p in parts)
    assert [chat.unescape(p.text[a:b]) for p in parts for a, b in p.loss] == [t for r, t in turns if r == "assistant"]


def test_templates_that_rewrite_history_are_detected():
    turns = [("user", "q"), ("assistant", "<think>x</think>a"), ("user", "r"), ("assistant", "b")]

    def last_thought(turns):  # thoughts of all but the last turn go
        keep = [t if i == len(turns) - 1 else re.sub("<think>.*</think>", "", t) for i, (_, t) in enumerate(turns)]
        return "".join(f"<{r}>{t}" for (r, _), t in zip(turns, keep))

    def closing(turns):  # an end mark that the next turn replaces
        return "".join(f"<{r}>{t}" for r, t in turns) + "<end>"

    def counted(turns):  # depends on how many turns there are
        return f"{len(turns)}:" + "".join(t for _, t in turns)

    assert chat.locate(last_thought, turns).rewrites == 2
    assert chat.locate(closing, turns).rewrites == 1
    assert chat.locate(counted, turns).rewrites == 1
    assert all(chat.locate(f, turns).loss == [] for f in (last_thought, closing, counted))
    trimmed = chat.locate(lambda turns: "".join(f"<{r}>{t.strip()}" for r, t in turns), [("assistant", "  a b  ")])
    assert [trimmed.text[slice(*s)] for s in trimmed.loss] == ["a b"]

    def far(turns):  # a turn repeats the one five turns before it
        return "".join(f"<{r}>{t}|{turns[i - 5][1] if i >= 5 else ''}" for i, (r, t) in enumerate(turns))

    many = [("user", str(i)) for i in range(12)]
    assert chat.locate(far, many).rewrites is None
    found = list(chat._blocks(far, iter(many), ("assistant",), 6, 2))
    assert found[0].rewrites is None and found[1].rewrites == 6


def test_conversations_written_and_read_back(spark):
    long = [(9, i, "user" if i % 2 else "assistant", f"turn {i} </s>") for i in range(300)]
    rows = [
        (1, 0, "system", "be kind"),
        (1, 2, "assistant", "yes </s> \\ [INST]"),
        (1, 1, "user", None),
        (1, 2, "assistant", "yes </s> \\ [INST]"),
        (2, 0, None, ""),
        (2, None, "user", "null turn"),
        (None, 0, "assistant", "no id"),
        (None, 0, "user", "no id"),
        (3, 5, "tool] [ROLE", "x" * 50_000),
        (4, None, None, None),
        *long,
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for parts in (df.repartition(7), df.coalesce(1), df.repartition(3).withColumns({n: F.lit("x") for n in ("first", "turns", "part", "loss", "file")})):
        assert read_back(parts) == chats_by_rule(rows)
    assert read_back(df, block=4, context=1) == chats_by_rule(rows)
    assert read_back(df.limit(0)) == {}
    shown = read_back(df.filter("conv_id = 1"), render=lambda turns: chat.inst_template(turns) + "[INST] next [/INST]")
    assert shown[1][-1] == 1 and shown[1][2] == 0


def test_long_conversations_are_rendered_after_their_whole_past(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} </s>") for i in range(100)]
    turns = [(r, t) for _, _, r, t in rows]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")

    def far(turns):  # a turn repeats the one 40 turns before it
        return "".join(f"<{r}>{t}|{turns[i - 40][1] if i >= 40 else ''}" for i, (r, t) in enumerate(turns))

    def late(turns):  # a second turn in the middle of a later block goes once that many follow
        return "".join(f"<{r}>{t}" for i, (r, t) in enumerate(turns) if i != 1 or len(turns) < 51)

    parts = list(chat._blocks(far, iter(turns), ("assistant",), 32))
    assert len(parts) == 4 and "".join(p.text for p in parts) == far(turns) and all(p.rewrites is None for p in parts)
    assert [p.text[a:b] for p in parts for a, b in p.loss] == [t for r, t in turns if r == "assistant"]
    found = list(chat._blocks(late, iter(turns), ("assistant",), 32))
    assert [(p.text, p.loss, p.rewrites) for p in found] == [(late(turns), [], 50)]
    manifest = chat.format_conversations(df, lambda turns: late([(r, chat.escape(t)) for r, t in turns]))
    shown = chat.read_conversations(manifest, read_turns=lambda text: iter([("", text)])).first()
    assert (shown["rewrites"], shown["loss_chars"], shown["n_turns"]) == (50, 0, 1)


# ------------------------------------------------------------------ ranked search


def ranked_by_rule(docs, items, k):
    term = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    tf = [(i, Counter(term(t))) for i, t in docs]
    n_docs, words = sum(bool(c) for _, c in tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(w for _, c in tf for w in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(term(t))
    out = []
    for item, terms in wanted.items():
        scores = []
        for i, c in tf:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // max(words, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m)) for w in terms if w in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def test_ranked_search_equals_scoring_all_documents(spark, odd_docs, no_docs, clashing):
    items = [(1, "the quick lazy DOG dog"), (1, "42 fox"), (2, "Übergröße straße nothing"), (3, None), (None, "lorem text id"), (4, "!!"), (5, "one minus five 12 34"), (6, "again and again")]
    table = spark.createDataFrame(items, "item_id long, text string")
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    for k in (1, 3, 10):
        want = ranked_by_rule(docs, items, k)
        assert sorted(map(tuple, ranked.ranked_search(odd_docs, table, k).collect()), key=str) == want
    assert sorted(map(tuple, ranked.ranked_search(clashing.repartition(5), table.withColumn("term", F.lit(1)), 10, block_terms=4, block_items=2).collect()), key=str) == want
    assert ranked.ranked_search(no_docs, table).count() == 0
    assert ranked.ranked_search(odd_docs, table.limit(0)).count() == 0


def test_ranked_search_equals_scoring_all_documents_of_a_table(spark):
    docs, items = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "benchmark"))
    want = ranked_by_rule([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()], 10)
    assert sorted(map(tuple, ranked.ranked_search(docs, items).collect()), key=str) == want


def test_scores_beyond_the_exact_range_of_doubles():
    index = ranked.ItemIndex(pa.array(["a", "b"]), np.array([0, 1, 2]), np.array([0, 0]), [7], np.array([2**33 + 1, 2**33 + 3]))
    scores = ranked.window_scores(index, 1, np.array([10]), np.array([0, 0]), np.array([0, 1]), np.array([3, 5]))
    part = lambda tf: (10**9 * tf) // (1000 * tf + 80)
    assert scores[0, 0] == (2**33 + 1) * part(3) + (2**33 + 3) * part(5)
    assert ranked.lengths_m(np.array([2**40]), 2**40, 2**41).tolist() == [10 + 90 * 2**39]
