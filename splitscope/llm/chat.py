"""Chat formatting by incremental black-box rendering.

A template is only a function from a list of turns to a text. Where each turn stands in a
conversation's text, and which characters of it are the turn's own words, is found by
rendering: the conversation is rendered turn after turn, and what the next output adds to
the last is the next turn's span. An output that does not begin with the one before shows
that the template rewrote history; such a conversation gets no loss spans, only the first
turn that did it. A learned turn is also rendered with two other texts in its place: what
all three outputs share before and behind is the template's, the rest is the turn's text.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import os
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitscope.llm.common import open_fs, put_file, scratch, ship, slices

Turn = tuple[str, str]  # role, text
Render = Callable[[Sequence[Turn]], str]

# ------------------------------------------------------------------ the template

# Control strings of the template: no text in its output holds one.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE", "[/ROLE]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_CONTROL = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_ROLE = re.compile(r"\[ROLE ((?:[^\\\]]|\\.)*)\] ", re.DOTALL)


@functools.lru_cache(maxsize=256)
def escape(text: str) -> str:
    """A text without control strings: a backslash after the first sign of each, and backslashes doubled."""
    if "<" not in text and "[" not in text and "\\" not in text:
        return text
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def inst_template(turns: Sequence[Turn]) -> str:
    """``<s>`` before the first turn; ``[INST] text [/INST]`` for users, `` text</s>`` for
    assistants, ``[ROLE role] text [/ROLE]`` for all others."""
    out = ["<s>"] if turns else []
    for role, text in turns:
        text = escape(text)
        if role == "user":
            out.append(f"[INST] {text} [/INST]")
        elif role == "assistant":
            out.append(f" {text}</s>")
        else:
            out.append(f"[ROLE {escape(role).replace(']', chr(92) + ']')}] {text} [/ROLE]")
    return "".join(out)


def inst_turns(text: str) -> Iterator[Turn]:
    """The turns of ``inst_template``'s output, or of any run of whole turns of it."""
    at = 3 if text.startswith("<s>") else 0
    while at < len(text):
        if text.startswith("[INST] ", at):
            role, begin, mark = "user", at + 7, " [/INST]"
        elif text.startswith("[ROLE ", at):
            head = _ROLE.match(text, at)
            role, begin, mark = unescape(head[1]), head.end(), " [/ROLE]"
        else:
            role, begin, mark = "assistant", at + 1, "</s>"
        end = text.index(mark, begin)
        yield role, unescape(text[begin:end])
        at = end + len(mark)


# ------------------------------------------------------------------ spans by rendering


@dataclass
class Located:
    """What rendering prefixes showed: the text added, where each turn of it stands, the
    learned turns' texts in it, and the first turn that rewrote history (None: none did)."""

    text: str
    spans: list[tuple[int, int]]
    loss: list[tuple[int, int]]
    rewrites: int | None


def _shared(a: str, b: str) -> int:
    return len(os.path.commonprefix([a, b]))


def locate(render: Render, turns: Sequence[Turn], learned: Sequence[str] = ("assistant",), history: Sequence[Turn] = ()) -> Located:
    """Render the prefixes of ``turns`` after ``history`` and compare consecutive outputs.

    Offsets are code points from the end of the history's output. With ``rewrites`` set, the
    text is the last output whole, spans are those up to that turn and ``loss`` is empty.
    """
    past = list(history)
    last = base = render(past) if past else ""
    spans, loss, rewrites = [], [], None
    for i, (role, text) in enumerate(turns):
        out = render([*past, (role, text)])
        if not out.startswith(last):
            rewrites = i
            break
        if role in learned:
            probes = [render([*past, (role, x)]) for x in "ab"]
            if not all(x.startswith(last) for x in probes):
                rewrites = i
                break
            # what is added is short, the output before it may be long
            added = [x[len(last) :] for x in probes]
            head = _shared(*added)
            tail = _shared(*(x[head:][::-1] for x in added))
            begin, end = len(last) + head, len(out) - tail
            # a template whose marks depend on the text shows no place for it
            if end < begin or out[len(last) : begin] != added[0][:head] or not out.endswith(added[0][len(added[0]) - tail :]):
                rewrites = i
                break
            loss.append((begin - len(base), end - len(base)))
        spans.append((len(last) - len(base), len(out) - len(base)))
        past.append((role, text))
        last = out
    if rewrites is not None:
        whole = render([*history, *turns])
        return Located(whole[len(base) :] if whole.startswith(base) else whole, spans, [], rewrites)
    return Located(last[len(base) :], spans, loss, None)


# ------------------------------------------------------------------ the job

_RUN = pa.schema([("conv_id", pa.int64()), ("first", pa.int64()), ("turns", pa.binary())])
_TURNS = pa.schema([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
_FILE = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("part", pa.int64()),
        ("text", pa.string()),
        ("turns", pa.list_(pa.list_(pa.int64()))),
        ("loss", pa.list_(pa.list_(pa.int64()))),
        ("rewrites", pa.int64()),
    ]
)
_CODEC = pa.Codec("zstd", compression_level=9)


def _key(turn: tuple) -> tuple:
    """Order of a conversation's rows: turn (null first), then role and text."""
    return turn[0] is not None, turn[0] or 0, turn[1], turn[2]


def _record_batch(rows: Sequence[Sequence], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(schema)], schema=schema)


def _packed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows that follow each other in one conversation, as one compressed run of up to ``most`` turns."""

    def close() -> None:
        raw = _record_batch(run, _TURNS).serialize()
        out.append((owner, run[0][0], len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)))

    out: list[tuple] = []
    run: list[tuple] = []
    owner = held = None
    for batch in slices(batches):
        for conv, *turn in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            turn = (turn[0], turn[1] or "", turn[2] or "")
            if run and (conv != owner or turn[0] is None or turn[0] - 1 != run[-1][0] or len(run) >= most or held > 1 << 20):
                close()
                run = []
            if not run:
                owner, held = conv, 0
            run.append(turn)
            held += len(turn[2])
        if out:
            yield _record_batch(out, _RUN)
            out.clear()
    if run:
        close()
        yield _record_batch(out, _RUN)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[Turn]]]:
    """Conversations with their turns in order, from runs sorted by (conv_id, first turn).

    Runs hold consecutive numbers, so only runs with repeated turn numbers overlap and are held at once.
    """
    rows = ((c, f, t) for batch in batches for c, f, t in zip(*(x.to_pylist() for x in batch.columns), strict=True))
    ahead = next(rows, None)

    def turns(owner: int | None) -> Iterator[Turn]:
        nonlocal ahead
        heap: list[tuple] = []
        while True:
            while ahead is not None and ahead[0] == owner and (not heap or (ahead[1] is not None, ahead[1] or 0) <= heap[0][0][:2]):
                raw = ahead[2]
                table = pa.ipc.read_record_batch(_CODEC.decompress(raw[8:], int.from_bytes(raw[:8], "little")), _TURNS)
                for t in zip(*(x.to_pylist() for x in table.columns), strict=True):
                    heapq.heappush(heap, (_key(t), t))
                ahead = next(rows, None)
            if not heap:
                return
            t = heapq.heappop(heap)[1]
            yield t[1], t[2]

    while ahead is not None:
        owner = ahead[0]
        own = turns(owner)
        yield owner, own
        for _ in own:  # what was not taken
            pass


def _blocks(render: Render, turns: Iterator[Turn], learned: Sequence[str], block: int, context: int | None = None) -> Iterator[Located]:
    """A conversation's turns located by rendering all its prefixes, and cut into parts of ``block`` turns.

    Every turn is rendered after the whole conversation before it. A conversation in which the
    template rewrites history is one part: the last output whole, without loss spans.

    With ``context``, prefixes of bounded length are rendered instead, which only shows what a
    template does that looks no further back: the first block has no history, a later one has
    the conversation's first turn and the ``context`` turns before it. Its first turn must add
    the same text after this history as after the whole block before, else that is reported
    as rewriting.
    """
    if context is None:
        own = list(turns)
        whole = locate(render, own, learned)
        if whole.rewrites is not None:
            yield whole
            return
        loss = iter(whole.loss)
        for lo in range(0, len(own), block):
            spans = whole.spans[lo : lo + block]
            begin, end = spans[0][0], spans[-1][1]
            mine = [next(loss) for role, _ in own[lo : lo + block] if role in learned]
            yield Located(whole.text[begin:end], *([(x - begin, y - begin) for x, y in some] for some in (spans, mine)), None)
        return
    past: list[Turn] = []
    lead: list[Turn] = []
    at = 0
    while own := [t for _, t in zip(range(block), turns)]:
        found = locate(render, own, learned, lead)
        if past and found.rewrites is None:
            full = render(past)
            if not (out := render([*past, own[0]])).startswith(full) or out[len(full) :] != found.text[slice(*found.spans[0])]:
                found.loss, found.rewrites = [], 0
        if found.rewrites is not None:
            found.rewrites += at
        yield found
        past = [*lead, *own]
        lead = [past[0], *past[1:][-context:]]
        at += len(own)


def format_conversations(
    turns: DataFrame, render: Render = inst_template, *, learned: Sequence[str] = ("assistant",), folder: str | None = None, block: int = 32, context: int | None = None
) -> DataFrame:
    """Render the conversations of ``turns`` (conv_id, turn, role, text) and write them to Parquet files.

    A file's row is a part of a conversation (``block`` turns; nearly all have one): conv_id,
    part, its text, the spans of its turns and of its learned texts (code points within the
    part), and ``rewrites``, the number of the first turn at which the template rewrote
    history, else null; such a conversation is one part. Returns the manifest: file, folder, parts. Null roles and texts are
    empty, null turns come first, equal turn numbers go by role and text, repeated rows count
    each; rows of null conv_id are one conversation. Extra columns are ignored; an empty
    table gives no files.

    Rows that already stand together cross the exchange as one compressed run. A task
    streams its conversations from sorted runs and holds one of them. Each turn is rendered
    after all turns before it, so the work grows with the square of a conversation's turns;
    ``context`` bounds it for templates known to look no further back (see ``_blocks``).
    Files are put in place whole, so a repeated task writes the same names again.
    """
    spark = turns.sparkSession
    ship(spark)
    folder = folder or scratch(spark, "chat")
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    runs = rows.mapInArrow(lambda batches: _packed(batches, 64), "conv_id long, first long, turns binary")
    runs = runs.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("first").asc_nulls_first(), F.xxhash64("turns"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (
            (conv, n, b.text, b.spans, b.loss, b.rewrites)
            for conv, own in _unpacked(batches)
            for n, b in enumerate(_blocks(render, own, learned, block, context))
        )
        first = next(parts, None)
        if first is None:
            return
        name, total = f"chat-{TaskContext.get().partitionId():06d}.parquet", 0

        def fill(out) -> None:
            nonlocal total
            found, held = [first], len(first[2])
            with pq.ParquetWriter(out, _FILE, compression="zstd", compression_level=12) as writer:
                while found:
                    for row in parts:
                        found.append(row)
                        held += len(row[2])
                        if held > 1 << 23:
                            break
                    writer.write_batch(_record_batch(found, _FILE))
                    total, held = total + len(found), 0
                    found = [x for x in [next(parts, None)] if x]

        put_file(f"{folder}/{name}", fill)
        yield pa.RecordBatch.from_pydict({"file": [name], "parts": [total]})

    runs.mapInArrow(write, "file string, parts long").write.parquet(f"{folder}/manifest")
    return spark.read.schema("file string, parts long").parquet(f"{folder}/manifest").withColumn("folder", F.lit(folder))


def read_conversations(manifest: DataFrame, read_turns: Callable[[str], Iterator[Turn]] = inst_turns, plain: Callable[[str], str] = unescape) -> DataFrame:
    """What the files of ``format_conversations`` say, a row for each conversation.

    conv_id, n_turns, turns_sha256 (of role, line feed, text, line feed of each turn in order),
    loss_chars and loss_sha256 (of the learned texts, unescaped, in order), formatted_chars,
    rewrites. Turns are read from the formatted text by its marks, learned texts by their spans
    (``plain`` undoes the template's escapes).
    """
    ship(manifest.sparkSession)
    schema = pa.schema(
        [
            ("conv_id", pa.int64()),
            ("n_turns", pa.int64()),
            ("turns_sha256", pa.string()),
            ("loss_chars", pa.int64()),
            ("loss_sha256", pa.string()),
            ("formatted_chars", pa.int64()),
            ("rewrites", pa.int64()),
        ]
    )

    def closed(row: list) -> list:
        return [x.hexdigest() if hasattr(x, "hexdigest") else x for x in row]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = open_fs(f"{row['folder']}/{row['file']}")
                done: list[list] = []
                now: list | None = None
                with system.open_input_file(path) as f:
                    for part in pq.ParquetFile(f).iter_batches(256):
                        for x in part.to_pylist():
                            if x["part"] == 0:
                                if now:
                                    done.append(now)
                                now = [x["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, None]
                            for role, text in read_turns(x["text"]):
                                now[1] += 1
                                now[2].update(f"{role}\n{text}\n".encode())
                            for begin, end in x["loss"]:
                                learned = plain(x["text"][begin:end])
                                now[3] += len(learned)
                                now[4].update(learned.encode())
                            now[5] += len(x["text"])
                            now[6] = x["rewrites"] if now[6] is None else now[6]
                        if done:
                            yield _record_batch([closed(x) for x in done], schema)
                            done = []
                if now:
                    yield _record_batch([closed(now)], schema)

    files = max(1, manifest.count())
    return manifest.repartition(files).mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites long")
