"""Token ids of documents in directly addressable code files.

Ids are split into chunks of 8, 8 and 16 bits. Level 0 holds the lowest chunk of every
id; a bitmap says which ids go on, and the next level holds the next chunk of those only.
A rank directory over each bitmap (ones before every 512th bit) tells where in the next
level an id goes on, so any id, or any range, is read without decoding those before it.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splitscope.llm.common import Kept, byte_runs, open_fs, put_file, range_numbers, run_strings, scratch, ship, text_bytes, windows

MAGIC = b"DACIDS01"
WIDTHS = (8, 8, 16)
_TYPES = {8: np.uint8, 16: np.uint16}
BLOCK = 512  # bits of a bitmap for each entry of its rank directory


# ------------------------------------------------------------------ the code


def pack(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per level: chunks, bitmap bytes and rank directory of ``ids`` (unsigned 32 bits)."""
    levels, rest = [], ids.astype(np.uint32)
    for k, width in enumerate(WIDTHS):
        chunk = (rest & np.uint32((1 << width) - 1)).astype(_TYPES[width])
        if k == len(WIDTHS) - 1:
            levels.append((chunk, np.zeros(0, np.uint8), np.zeros(0, np.uint32)))
            break
        rest = rest >> np.uint32(width)
        more = rest > 0
        bits = np.packbits(np.concatenate([more, np.zeros(-len(more) % BLOCK, bool)]), bitorder="little")
        ones = np.bitwise_count(bits).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint32)
        levels.append((chunk, bits, np.concatenate([[0], np.cumsum(ones, dtype=np.uint32)]).astype(np.uint32)))
        rest = rest[more]
    return levels


def _rank(bits: np.ndarray, directory: np.ndarray, i: int) -> int:
    """Ones before bit ``i``."""
    b = i // BLOCK
    n = int(directory[b])
    if i % BLOCK:
        part = np.unpackbits(bits[b * BLOCK // 8 : (i + 7) // 8], bitorder="little")[: i - b * BLOCK]
        n += int(part.sum())
    return n


class IdFile:
    """An open id file: any id or range by direct access."""

    def __init__(self, data: bytes | memoryview):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not an id file")
        self.documents, self.tokens = struct.unpack_from("<QQ", data, 8)
        at = 24

        def take(kind, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype=kind, count=n, offset=at)
            at += -(-out.nbytes // 8) * 8
            return out

        self.doc_ids = take("<i8", self.documents)
        self.no_id = take(np.uint8, self.documents).astype(bool)
        self.starts = take("<u8", self.documents + 1).astype(np.int64)
        self.levels, n = [], self.tokens
        for k, width in enumerate(WIDTHS):
            chunk = take(np.dtype(_TYPES[width]).newbyteorder("<"), n)
            blocks = -(-n // BLOCK) if k < len(WIDTHS) - 1 else 0
            bits = take(np.uint8, blocks * BLOCK // 8)
            directory = take("<u4", blocks + 1 if k < len(WIDTHS) - 1 else 0)
            self.levels.append((chunk, bits, directory))
            n = int(directory[-1]) if len(directory) else 0

    def range(self, start: int, end: int) -> np.ndarray:
        """Ids at [start, end)."""
        out = np.zeros(end - start, dtype=np.uint32)
        where, shift = np.arange(end - start), 0
        for (chunk, bits, directory), width in zip(self.levels, WIDTHS, strict=True):
            out[where] |= chunk[start:end].astype(np.uint32) << np.uint32(shift)
            shift += width
            if not len(directory) or start == end:
                break
            lo = start // 8
            more = np.unpackbits(bits[lo : (end + 7) // 8], bitorder="little")[start - lo * 8 : end - lo * 8].astype(bool)
            start = _rank(bits, directory, start)
            end = start + int(more.sum())
            where = where[more]
        return out

    def __getitem__(self, i: int) -> int:
        return int(self.range(i, i + 1)[0])

    def document(self, k: int) -> np.ndarray:
        return self.range(int(self.starts[k]), int(self.starts[k + 1]))


def write_ids(out, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> None:
    """Write one id file to an open stream."""

    def put(a: np.ndarray) -> None:
        raw = np.ascontiguousarray(a).tobytes()
        out.write(raw + b"\0" * (-len(raw) % 8))

    out.write(MAGIC + struct.pack("<QQ", len(doc_ids), len(ids)))
    put(np.array([0 if d is None else d for d in doc_ids], dtype="<i8"))
    put(np.array([d is None for d in doc_ids], dtype=np.uint8))
    put(np.concatenate([[0], np.cumsum(lengths)]).astype("<u8"))
    for chunk, bits, directory in pack(ids):
        put(chunk.astype(chunk.dtype.newbyteorder("<")))
        put(bits)
        put(directory.astype("<u4"))


# ------------------------------------------------------------------ encoding

_IN_WORD = ~np.isin(np.arange(256), list(b" \t\n\r"))  # other white space stays in words, which then go to the library
_BEYOND_LATIN = re.compile("[^\x21-\x7e\xa1-\u012f\u0131-\u024f]")
_CACHE_WORDS = 500_000  # in each half of what a worker keeps; more would only save time
_SIGNS = frozenset(".,;:!?-")
# Fixed value: the pattern of the public word-level BPE files (letters, single digits, other signs).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@functools.cache
def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes
    for themselves, the others in turn from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Encoder:
    """Encodes whole texts with a file of the tokenizers library, word by word.

    Where the file's pre-tokenizer never joins across white space (it removes what its
    pattern doesn't match), a text's ids are its words' ids in order, so each distinct
    word is encoded once and kept; the memory kept is bounded, which only costs time.
    Words of plain Latin letters, digits and signs go to the library's model directly,
    all others through its whole chain. Texts that hold an added token of the file, such as
    an end mark, and all texts of other tokenizer files are encoded whole by the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        steps = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        before = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = (
            steps == ["NFC", "Replace", "Lowercase"]
            and [s.get("type") for s in before] == ["Split", "ByteLevel"]
            and before[0]["behavior"] == "Removed"
            and before[0]["invert"]
            and before[0]["pattern"].get("Regex") == PATTERN
            and not before[1]["use_regex"]
            and not before[1]["add_prefix_space"]
        )
        # texts that hold one of the file's added tokens are left to the library whole
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.by_word &= all(not t["normalized"] for t in spec.get("added_tokens", []))
        if self.by_word:
            self.pieces = regex.compile(PATTERN)
        self.code = "H" if self.type.itemsize == 2 else "I"
        self.words: Kept = Kept(_CACHE_WORDS)
        self.known: Kept = Kept(_CACHE_WORDS)

    def _piece(self, piece: str) -> bytes:
        """Ids of a run the pre-tokenizer's pattern gives, normalized."""
        try:
            return self.known[piece]
        except KeyError:
            if not piece.isascii():
                letters = _byte_letters()
                ids = self.tokenizer.model.tokenize("".join([letters[b] for b in piece.encode()]))
            else:
                ids = self.tokenizer.model.tokenize(piece)
            got = self.known[piece] = array(self.code, [t.id for t in ids]).tobytes()
            return got

    def _word(self, word: str) -> bytes:
        if _BEYOND_LATIN.search(word) or not (word.isascii() or unicodedata.is_normalized("NFC", word)):
            return array(self.code, self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        word = word.lower()
        if word.isalpha():
            return self._piece(word)
        head, last = word[:-1], word[-1]
        if head.isalpha() and last in _SIGNS:
            return self._piece(head) + self._piece(last)
        return b"".join([self._piece(p) for p in self.pieces.findall(word)])

    def whole(self, text: str) -> bytes:
        """The ids of a text by the library alone, as an array of ``type`` in bytes."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.type).tobytes()

    def _ids(self, word: str) -> bytes:
        try:
            return self.words[word]
        except KeyError:
            got = self.words[word] = self._word(word)
            return got

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, as arrays of ``type`` in bytes; nulls have none.

        The words of a run of texts are dictionary-encoded, so each distinct one is looked up
        once; a text's ids are then gathered from those of its words.
        """
        texts = texts.fill_null("")
        if not self.by_word:
            yield from (self.whole(t) for t in texts.to_pylist())
            return
        by_library = np.zeros(len(texts), dtype=bool)
        for content in self.added:
            by_library |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        data, offsets = text_bytes(texts)
        for lo, hi in windows(offsets):
            part, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            inside = _IN_WORD[part]
            start, end, text = byte_runs(inside, own)
            words = run_strings(part, inside, start, end)
            self.words.turn()
            self.known.turn()
            found = [self._ids(w) for w in words.dictionary.to_pylist()]
            size = np.array([len(x) for x in found], dtype=np.int64) // self.type.itemsize
            code = words.indices.to_numpy(zero_copy_only=False)
            ids = np.frombuffer(b"".join(found), dtype=self.type)[range_numbers((np.cumsum(size) - size)[code], size[code])]
            cut = np.zeros(hi - lo + 1, dtype=np.int64)
            np.cumsum(np.bincount(text, weights=size[code], minlength=hi - lo).astype(np.int64), out=cut[1:])
            for i in range(hi - lo):
                yield self.whole(texts[lo + i].as_py()) if by_library[lo + i] else ids[cut[i] : cut[i + 1]].tobytes()


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    return Encoder(path)


# ------------------------------------------------------------------ jobs


def write_corpus(docs: DataFrame, tokenizer: str, *, end_id: int | None = 2, folder: str | None = None, file_tokens: int = 1 << 23) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write id files in ascending order of doc_id.

    Returns the manifest: a row for each file with its place (part, seq), name, number of
    documents and tokens, and the tokens before it. Files close after ``file_tokens``
    tokens, so a task holds that many and one document at a time. Null texts are empty
    (the end id alone); null doc_ids come first; equal doc_ids follow each other by hash
    of the text; extra columns are ignored; an empty table gives no files. The manifest
    is written beside the files, so rereading never encodes again, and a repeated task
    writes the same files again.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or scratch(spark, "ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        end = b"" if end_id is None else np.array([end_id], dtype=code.type).tobytes()
        part, seq = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        found: list[bytes] = []
        lengths: list[int] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal seq, held
            name = f"ids-{part:06d}-{seq:04d}.dac"
            ids = np.frombuffer(b"".join(found), dtype=code.type)
            put_file(f"{folder}/{name}", lambda out: write_ids(out, doc_ids, lengths, ids))
            row = {"part": [part], "seq": [seq], "file": [name], "documents": [len(doc_ids)], "tokens": [len(ids)]}
            for kept in (doc_ids, found, lengths):
                kept.clear()
            seq, held = seq + 1, 0
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("file", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())]))

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), code.encode(batch.column(1)), strict=True):
                ids += end
                doc_ids.append(doc_id)
                found.append(ids)
                lengths.append(len(ids) // code.type.itemsize)
                held += lengths[-1]
                if held >= file_tokens:
                    yield close()
        if doc_ids:
            yield close()

    ordered = docs.select("doc_id", "text").withColumn("_mark", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "_mark").sortWithinPartitions("doc_id", "_mark").select("doc_id", "text")
    schema = "part bigint, seq bigint, file string, documents bigint, tokens bigint"
    ordered.mapInArrow(write, schema).write.parquet(f"{folder}/manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    manifest = spark.read.schema(schema).parquet(f"{folder}/manifest")
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))).withColumn("folder", F.lit(folder))


def read_corpus(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens and the CRC-32 of its ids (as unsigned 32 bits)."""
    ship(manifest.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = open_fs(f"{row['folder']}/{row['file']}")
                with system.open_input_file(path) as f:
                    held = IdFile(f.read())
                if (held.documents, held.tokens) != (row["documents"], row["tokens"]):
                    raise ValueError(f"{row['file']} is not the file of its manifest")
                crc = [zlib.crc32(held.document(k).astype("<u4").tobytes()) for k in range(held.documents)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(held.doc_ids, pa.int64(), mask=held.no_id),
                        pa.array(held.starts[:-1] + row["start"], pa.int64()),
                        pa.array(np.diff(held.starts), pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    files = max(1, manifest.count())
    return manifest.repartition(files).mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
