"""N-best SentencePiece encoding and decoding.

Every way to cut a text into pieces of the vocabulary is a path through a lattice; a path
scores the sum of its pieces' log-probabilities. A forward Viterbi pass gives the best
score from the text's begin to every position. A backward A* search from the end then
takes these scores as its heuristic: they are exact, so paths leave the search in the
order of their total score, and the n-th to leave is the n-th best segmentation.

Where no piece of the vocabulary holds two neighbouring characters, every path has a cut
between them. The lattice falls apart there, and the n best of a text follow from the n
best of its words, without loss.

The forward pass runs over all distinct words of a run of texts at once, as arrays: the
vocabulary's trie is a sorted table of transitions, and all positions that are equally far
from the begin of their part are settled together. It also gives the second-best score of
each word. The words of a text that lose least by their second way are the only ones in
which its n best can differ; the A* search runs on these.
"""

from __future__ import annotations

import functools
import heapq
import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitscope.llm.common import give_back, range_numbers, run_strings, ship, text_bytes, text_bytes_of, windows

SPACE = "▁"  # stands for a blank inside pieces
_SIGN = "\ud800"  # stands for that sign itself where a text holds it; no text has lone surrogates
_CACHE = 3_000  # words whose n best a worker keeps within a task; more would only save time
_SIGNS = 1 << 17  # characters of words in one forward pass
_ROWS = 512  # texts turned into one Arrow array
_FIRST = operator.itemgetter(0)

# (score, ids as a tuple), best first
Best = list[tuple[float, tuple[int, ...]]]


def merge(lists: list[Best], n: int) -> Best:
    """The n best ways to take one entry of each list; equal scores in the order of the lists."""
    out: Best = [(0.0, ())]
    for own in lists:
        both = [(s + t, a + b) for s, a in out for t, b in own]
        both.sort(key=lambda x: -x[0])
        out = both[:n]
    return out


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted table, and whether they are there."""
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Lattice:
    """A SentencePiece vocabulary as a lattice: pieces, log-probabilities, byte pieces.

    A model with log-probabilities (unigram) is used as it is. A merge model (BPE) only
    ranks its pieces; there a piece of rank r has probability proportional to
    1 / (r + 2.7) (Zipf-Mandelbrot), and byte pieces, which stand for characters outside
    the vocabulary, rank behind all others.
    """

    def __init__(self, path: str, n: int = 4):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n = n
        plain, self.bytes = [], {}
        self.text: list[str | int] = [""] * sp.vocab_size()  # what an id decodes to: characters, or a byte
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text[i] = int(piece[3:5], 16)
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                plain.append((sp.get_score(i), i, piece))
                self.text[i] = piece
        plain.sort(key=lambda x: (-x[0], x[1]))
        ranked = all(float(s).is_integer() for s, _, _ in plain)
        shift = 2.7
        total = math.log(sum(1 / (r + shift) for r in range(len(plain) + 256)))
        self.vocabulary = {p: (i, -math.log(r + shift) - total if ranked else s) for r, (s, i, p) in enumerate(plain)}
        self.byte_score = -math.log(len(plain) + 256 + shift) - total if ranked else min(s for s, _, _ in plain) - 10
        # a sign leads to what may follow it, and to score and ids of the piece that ends there
        self.trie: dict[str, tuple[dict, tuple | None]] = {}
        for piece in sorted(self.vocabulary):  # a piece comes after all that it begins with
            i, score = self.vocabulary[piece]
            node = self.trie
            for sign in piece[:-1]:
                node = node.setdefault(sign, ({}, None))[0]
            node[piece[-1]] = (node[piece[-1]][0] if piece[-1] in node else {}, (score, (i,)))
        self.joined = {p[k : k + 2] for p in self.vocabulary for k in range(len(p) - 1)}
        # a text can be cut before every run of blanks if no piece goes from another sign to a blank
        self.by_word = not any(j[1] == SPACE and j[0] != SPACE for j in self.joined)
        # the same trie as a table: (state, sign) to the next state; what ends in a state, or -1
        states: dict[tuple[int, str], int] = {}
        ends: list[tuple[int, int, float]] = []
        for piece, (i, score) in self.vocabulary.items():
            at = 0
            for sign in piece:
                at = states.setdefault((at, sign), len(states) + 1)
            ends.append((at, i, score))
        keys = np.array([(at << 21) | ord(sign) for at, sign in states], dtype=np.int64)
        order = np.argsort(keys)
        self._keys, self._next = keys[order], np.array(list(states.values()), dtype=np.int32)[order]
        self._id, self._score = np.full(len(states) + 1, -1, dtype=np.int32), np.zeros(len(states) + 1)
        for at, i, score in ends:
            self._id[at], self._score[at] = i, score
        self._longest = max(map(len, self.vocabulary))
        self._pairs = np.sort(np.array([(ord(a) << 21) | ord(b) for a, b in self.joined] or [-1], dtype=np.int64))
        self._byte_ids = np.array([self.bytes.get(b, 0) for b in range(256)], dtype=np.int32)
        self.several: dict[str, Best] = {}
        self.raw = pa.array([bytes([x]) if isinstance(x, int) else x.replace(SPACE, " ").encode() for x in self.text], pa.binary())

    def edges(self, part: str) -> tuple[list[list[tuple[float, int, float, tuple[int, ...]]]], float]:
        """Forward pass: for each position the pieces that end there, and the best score of all.

        A piece is (best score of a path through it so far, begin, own score, ids).
        """
        n = len(part)
        into: list[list[tuple[float, int, float, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
        best = [0.0] + [-math.inf] * n
        for i in range(n):
            here = best[i]
            node = self.trie
            end = i
            for sign in part[i:]:
                found = node.get(sign)
                if found is None:
                    break
                end += 1
                node, piece = found
                if piece:
                    through = here + piece[0]
                    into[end].append((through, i, piece[0], piece[1]))
                    if through > best[end]:
                        best[end] = through
            if not into[i + 1] or into[i + 1][-1][1] != i:  # the character is no piece
                raw = (SPACE if part[i] == _SIGN else part[i]).encode()
                through = here + self.byte_score * len(raw)
                into[i + 1].append((through, i, self.byte_score * len(raw), tuple([self.bytes[b] for b in raw])))
                best[i + 1] = max(best[i + 1], through)
        return into, best[n]

    def search(self, part: str, n: int) -> Best:
        """The n best paths by A* backward, with exact forward scores.

        The pieces that end at a position are tried in the order of the best path through
        them, so a path taken from the agenda puts back only its next rival at each step.
        """
        into, best = self.edges(part)
        ranked: set[int] = set()
        out: Best = []
        heap: list[tuple] = [(-best, 0, len(part), 0, 0.0, ())]
        count = 0
        while heap and len(out) < n:
            _, _, at, k, score, path = heapq.heappop(heap)
            while True:
                ends = into[at]
                if at not in ranked:
                    ends.sort(reverse=True)
                    ranked.add(at)
                if k + 1 < len(ends):
                    count += 1
                    heapq.heappush(heap, (-(score + ends[k + 1][0]), count, at, k + 1, score, path))
                _, at, s, ids = ends[k]
                score += s
                path = ids + path
                if not at:
                    out.append((score, path))
                    break
                k = 0
        return out

    def _cuts(self, word: str) -> list[str]:
        joined, cuts = self.joined, [0]
        cuts += [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in joined]
        return [word[a:b] for a, b in zip(cuts, [*cuts[1:], len(word)])]

    def best(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of words (UTF-8 bytes with offsets): ids in a row, number of ids, score of the best
        way, and the loss to the second (infinite where there is none)."""
        own = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        signs = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype="<u4").astype(np.int64)
        signs[signs == ord(SPACE)] = ord(_SIGN)
        signs[signs == 32] = ord(SPACE)
        # parts: words cut where no piece joins two signs
        cut = np.ones(len(signs), dtype=bool)
        cut[1:] = ~_found(self._pairs, (signs[:-1] << 21) | signs[1:])[1]
        cut[own[:-1][np.diff(own) > 0]] = True
        first = np.append(np.flatnonzero(cut), len(signs))
        done = [self._forward(signs[first[lo] : first[hi]], first[lo : hi + 1] - first[lo]) for lo, hi in windows(first, _SIGNS)]
        ids, size, score, loss = (np.concatenate([d[i] for d in done] or [np.zeros(0, np.int64)]) for i in range(4))
        word = np.searchsorted(own, first[:-1], side="right") - 1
        n = len(offsets) - 1
        least = np.full(n, math.inf)
        np.minimum.at(least, word, loss)
        return ids, np.bincount(word, weights=size, minlength=n).astype(np.int64), np.bincount(word, weights=score, minlength=n), least

    def _forward(self, signs: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward pass over parts, none of them empty: ids in a row, and of each part number
        of ids, best score, loss to the second. Of equal paths the one of ``search`` wins."""
        n, parts = len(signs), len(own) - 1
        part = np.repeat(np.arange(parts), np.diff(own))
        stop = own[part + 1]
        # all pieces in all parts: walk the trie from every position at once
        at, state, depth = np.arange(n), np.zeros(n, dtype=np.int64), 0
        single = np.zeros(n, dtype=bool)
        begins, lengths, states = [], [], []
        while len(at):
            j, hit = _found(self._keys, (state << 21) | signs[at + depth])
            at, state, depth = at[hit], self._next[j[hit]].astype(np.int64), depth + 1
            held = self._id[state] >= 0
            begins.append(at[held])
            lengths.append(np.full(len(begins[-1]), depth))
            states.append(state[held])
            if depth == 1:
                single[begins[0]] = True
            more = at + depth < stop[at]
            at, state = at[more], state[more]
        raw = np.flatnonzero(~single)  # signs that are no piece: their bytes
        char = np.where(signs[raw] == ord(_SIGN), ord(SPACE), signs[raw])
        width = 1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF)
        state, begin = np.concatenate(states), np.concatenate([*begins, raw])
        length = np.concatenate([*lengths, np.ones(len(raw), np.int64)])
        score = np.concatenate([self._score[state], self.byte_score * width])
        name = np.concatenate([self._id[state].astype(np.int64), -1 - np.arange(len(raw))])
        # nodes: the places before, between and behind the signs of each part; by distance from
        # its begin, then place, then longer pieces first
        distance = begin + length - own[part[begin]]
        source = begin + part[begin]
        order = np.argsort(((distance * (n + parts) + source + length) * (self._longest + 1)) - length)
        distance, source, score, name = distance[order], source[order], score[order], name[order]
        target = source + length[order]
        fresh = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
        step = np.searchsorted(distance, np.arange(1, distance[-1] + 2))
        group = np.searchsorted(fresh, step)
        best, second = np.full(n + parts, -math.inf), np.full(n + parts, -math.inf)
        back = np.zeros(n + parts, dtype=np.int64)
        best[own[:-1] + np.arange(parts)] = 0
        for lo, hi, a, b in zip(step[:-1].tolist(), step[1:].tolist(), group[:-1].tolist(), group[1:].tolist(), strict=True):
            begin, own_score, edge = source[lo:hi], score[lo:hi], fresh[a:b] - lo
            through = best[begin] + own_score
            top = np.maximum.reduceat(through, edge)
            # of equal ones the last, which begins last
            same = np.where(through == np.repeat(top, np.diff(np.append(edge, hi - lo))), np.arange(hi - lo), -1)
            chosen = np.maximum.reduceat(same, edge)
            through[chosen] = second[begin[chosen]] + own_score[chosen]
            node = target[lo + edge]
            best[node], second[node], back[node] = top, np.maximum.reduceat(through, edge), lo + chosen
        # back along the best paths of all parts
        last = own[1:] + np.arange(parts)
        node, which, taken, whose = last, np.arange(parts), [], []
        while len(which):
            edge = back[node]
            taken.append(edge)
            whose.append(which)
            node = source[edge]
            more = node > own[which] + which
            node, which = node[more], which[more]
        taken, whose = np.concatenate(taken[::-1]), np.concatenate(whose[::-1])
        taken = taken[np.argsort(whose, kind="stable")]
        name = name[taken]
        size = np.ones(len(name), dtype=np.int64)
        size[name < 0] = width[-1 - name[name < 0]]
        ids = np.repeat(name, size)
        spread = np.flatnonzero(ids < 0)
        if len(spread):
            char, wide = char[-1 - ids[spread]], width[-1 - ids[spread]]
            k = spread - np.repeat(np.cumsum(size) - size, size)[spread]
            lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[wide] | (char >> (6 * (wide - 1)))
            ids[spread] = self._byte_ids[np.where(k == 0, lead, 0x80 | ((char >> (6 * np.maximum(wide - 1 - k, 0))) & 0x3F))]
        counts = np.bincount(np.sort(whose), weights=size, minlength=parts).astype(np.int64)
        return ids.astype("<u4"), counts, best[last], best[last] - second[last]

    def nbest(self, word: str) -> Best:
        """The n best segmentations of a word."""
        got = self.several.get(word)
        if got is None:
            if len(self.several) > _CACHE:
                self.several.clear()
            got = self.several[word] = merge([self.search(p, self.n) for p in self._cuts(word.replace(SPACE, _SIGN).replace(" ", SPACE))], self.n)
        return got

    def forget(self) -> None:
        """Give back what is kept of words at the end of a task: the worker lives on, also in other jobs."""
        self.several.clear()
        give_back()

    def encode(self, texts: pa.Array) -> Iterator[tuple[bytes, list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]]]]:
        """Per text its best ids (unsigned 32 bits in bytes) and its n best segmentations.

        Each of these is a score with its changes to the best one, in order: place in the
        best ids, number of ids replaced, ids in their stead. The words of a run of texts are
        dictionary-encoded, so each distinct one is looked up once.
        """
        data, offsets = text_bytes(texts)
        for lo, hi in windows(offsets):
            part, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            # a blank before every text that is not empty; a word is a run of blanks with what follows
            filled = np.flatnonzero(np.diff(own))
            part = np.insert(part, own[filled], 32)
            own = own + np.searchsorted(filled, np.arange(hi - lo + 1))
            begin = np.zeros(len(part), dtype=bool)
            if self.by_word:
                blank = part == 32
                begin[1:] = blank[1:] & ~blank[:-1]
            begin[own[filled]] = True
            start = np.flatnonzero(begin)
            text = np.searchsorted(own, start, side="right") - 1
            words = run_strings(part, np.ones(len(part), bool), start, np.append(start[1:], len(part)))
            names = words.dictionary
            code = words.indices.to_numpy(zero_copy_only=False)
            flat, size, score, loss = self.best(*text_bytes(names))
            score, loss = score[code], loss[code]
            ids = flat[range_numbers((np.cumsum(size) - size)[code], size[code])]
            at = np.concatenate([[0], np.cumsum(size[code])])
            first = np.searchsorted(text, np.arange(hi - lo + 1))
            total = np.bincount(text, weights=score, minlength=hi - lo)
            # only the words with the least losses can differ within the n best
            order = np.lexsort((loss, text))
            place = np.arange(len(order)) - first[text[order]]
            few = np.sort(order[place < self.n - 1])
            few_first = np.searchsorted(text[few], np.arange(hi - lo + 1))
            for i in range(hi - lo):
                begin_, end_ = at[first[i]], at[first[i + 1]]
                own_few = few[few_first[i] : few_first[i + 1]].tolist()
                lists = {k: self.nbest(names[code[k]].as_py()) for k in own_few}
                ways: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
                for k in own_few:
                    mine = lists[k]
                    both = [(lost + mine[0][0] - s, (*chosen, (k, c)) if c else chosen) for lost, chosen in ways for c, (s, _) in enumerate(mine)]
                    both.sort(key=_FIRST)
                    ways = both[: self.n]
                best = float(total[i])
                yield ids[begin_:end_].tobytes(), [(best - lost, [(int(at[k] - begin_), int(size[code[k]]), lists[k][c][1]) for k, c in chosen]) for lost, chosen in ways]

    def decode(self, raw: pa.Array) -> pa.Array:
        """The texts of ids (unsigned 32 bits in bytes); bytes that are no valid UTF-8 become
        replacement signs, null gives null."""
        none = raw.is_null()
        raw = raw.fill_null(b"").cast(pa.large_binary())
        cut = np.frombuffer(raw.buffers()[1], dtype=np.int64, count=raw.offset + len(raw) + 1)[raw.offset :] // 4
        held = raw.buffers()[2]
        ids = np.frombuffer(held, dtype="<u4", count=len(held) // 4)[cut[0] : cut[-1]] if held is not None else np.zeros(0, "<u4")
        pieces = self.raw.take(pa.array(ids.astype(np.int64))).cast(pa.large_binary())
        data, offsets = text_bytes_of(pieces)
        own = offsets[cut - cut[0]]
        # the blank put before each text goes
        filled = np.flatnonzero(np.diff(own))
        extra = own[filled][data[own[filled]] == 32]
        own = own - np.searchsorted(extra, own)
        data = np.delete(data, extra)
        out = pa.Array.from_buffers(pa.large_binary(), len(raw), [None, pa.py_buffer(np.ascontiguousarray(own)), pa.py_buffer(data)])
        try:
            out = out.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            out = pa.array([x.decode("utf-8", "replace") for x in out.to_pylist()], pa.string())
        return pc.if_else(none, pa.scalar(None, pa.string()), out)


def changed(ids: np.ndarray, changes: list[tuple[int, int, tuple[int, ...]]]) -> np.ndarray:
    """The ids of another of the n best, from the best ids and its changes."""
    out, last = [], 0
    for at, n, new in changes:
        out += [ids[last:at], np.array(new, dtype=ids.dtype)]
        last = at + n
    return np.concatenate([*out, ids[last:]])


@functools.lru_cache(maxsize=2)
def lattice(path: str, n: int) -> Lattice:
    """One lattice for each file and Python worker."""
    return Lattice(path, n)


ENCODED = "struct<ids: binary, nbest: array<struct<score: double, changes: array<struct<at: int, n: int, ids: array<int>>>>>>"


def with_pieces(docs: DataFrame, model: str, *, n: int = 4, to: str = "pieces") -> DataFrame:
    """``docs`` with the n best segmentations of each whole text as struct ``to``.

    ``ids`` are the best ids (unsigned 32 bits, little-endian), ``nbest`` the scores, best
    first, with their changes to these. Blanks are kept as they are, a blank is put
    before a text that is not empty, and characters outside the vocabulary become byte
    pieces, so decoding gives the text back. Null and empty texts have no ids and one
    segmentation of score 0. Texts with fewer than n segmentations list all. Equal scores
    come in a fixed order. Other columns pass unchanged.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = lattice(model, n)
        change = pa.struct([("at", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])
        kind = pa.struct([("ids", pa.binary()), ("nbest", pa.list_(pa.struct([("score", pa.float64()), ("changes", pa.list_(change))])))])
        for texts in batches:
            found = []
            for ids, nbest in own.encode(texts):
                found.append({"ids": ids, "nbest": [{"score": s, "changes": [{"at": a, "n": k, "ids": list(new)} for a, k, new in c]} for s, c in nbest]})
                if len(found) == _ROWS:
                    yield pa.array(found, kind)
                    found = []
            yield pa.array(found, kind)
        own.forget()

    return docs.withColumn(to, F.arrow_udf(run, ENCODED)(F.col("text")))


def decoded(docs: DataFrame, model: str, ids: str, *, to: str = "decoded") -> DataFrame:
    """``docs`` with the text of the column ``ids`` (as in ``with_pieces``); null for null."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = lattice(model, 1)
        for raw in batches:
            for lo in range(0, len(raw), _ROWS):
                yield own.decode(raw.slice(lo, _ROWS))

    return docs.withColumn(to, F.arrow_udf(run, "string")(F.col(ids)))
