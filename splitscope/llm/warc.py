"""WARC archives of web pages: written with one gzip member per record, read sequentially.

The reader streams a file in small pieces: each gzip member is inflated incrementally,
records are framed by their Content-Length, and the digests in the headers are checked
against the bytes read. Its memory does not grow with the archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splitscope.llm.common import open_fs, scratch, ship

# Fixed values of the WARC 1.1 standard.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:page:"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, headers: dict[str, str], block: bytes, level: int = 6) -> bytes:
    """One record as a gzip member of its own."""
    named = {"WARC-Type": kind, **headers, "WARC-Block-Digest": f"sha1:{base32_sha1(block)}", "Content-Length": str(len(block))}
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in named.items())
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


class _Member:
    """Bytes of one gzip member, inflated as they are asked for."""

    def __init__(self, read: Callable[[int], bytes], piece: int):
        self._read, self._piece, self._left = read, piece, b""

    def start(self) -> bool:
        """Begin the next member; False at the end of the file."""
        if not self._left:
            self._left = self._read(self._piece)
        self._inflate, self._ready = zlib.decompressobj(31), bytearray()
        return bool(self._left)

    def _more(self) -> bool:
        while not self._inflate.eof:
            raw = self._left or self._read(self._piece)
            if not raw:
                raise ValueError("the archive ends within a record")
            got = self._inflate.decompress(raw, self._piece)
            self._left = self._inflate.unused_data if self._inflate.eof else self._inflate.unconsumed_tail
            if got:
                self._ready += got
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        while (at := self._ready.find(mark)) < 0:
            if not self._more():
                raise ValueError("a record ends within its header")
        out = bytes(self._ready[:at])
        del self._ready[: at + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes, piece by piece."""
        while n:
            if not self._ready and not self._more():
                raise ValueError("a record is shorter than its Content-Length")
            out = bytes(self._ready[:n])
            del self._ready[: len(out)]
            n -= len(out)
            yield out

    def end(self) -> None:
        """What is left must be the two line ends that close a record."""
        while self._more():
            pass
        if bytes(self._ready) != b"\r\n\r\n":
            raise ValueError("a record is longer than its Content-Length")


def _headers(raw: bytes) -> dict[str, str]:
    """Header lines by lower-case name; a line that begins with white space goes on the last."""
    out: dict[str, str] = {}
    name = ""
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def read_records(read: Callable[[int], bytes], *, piece: int = 1 << 16, payloads: bool = False) -> Iterator[dict]:
    """Records of an archive in order: headers, http headers, payload length and digest.

    ``read`` gives the next bytes of the file. Each record is checked: version line,
    framing, block digest, and payload digest where the block holds the payload. A fault
    raises ValueError. With ``payloads`` the payload's bytes are kept too.
    """
    member = _Member(read, piece)
    while member.start():
        head = member.until(b"\r\n\r\n")
        if not head.startswith(b"WARC/1."):
            raise ValueError("a record does not begin with a WARC version")
        named = _headers(head)
        block_hash, payload_hash, n_payload = hashlib.sha1(), hashlib.sha1(), 0
        http: bytes | None = None
        early, kept = bytearray(), []
        for part in member.take(int(named["content-length"])):
            block_hash.update(part)
            if http is None and named.get("content-type", "").startswith("application/http"):
                early += part
                if (at := early.find(b"\r\n\r\n")) < 0:
                    continue
                http, part = bytes(early[:at]), bytes(early[at + 4 :])
            payload_hash.update(part)
            n_payload += len(part)
            if payloads:
                kept.append(part)
        member.end()
        for name, got in (("warc-block-digest", block_hash), ("warc-payload-digest", payload_hash)):
            if name in named and not (name == "warc-payload-digest" and named["warc-type"] == "revisit"):
                if named[name] != f"sha1:{base64.b32encode(got.digest()).decode()}":
                    raise ValueError(f"{name} of {named.get('warc-record-id')} is not that of the bytes read")
        yield {"headers": named, "http": _headers(http) if http is not None else {}, "payload_bytes": n_payload, "payload": b"".join(kept) if payloads else None}


def write_archives(
    pages: DataFrame, *, min_revisit_bytes: int = 0, folder: str | None = None, file_bytes: int = 1 << 28, level: int = 6, date: str = "2024-01-01T00:00:00Z"
) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html); returns the manifest of files.

    Of rows with equal payloads (html in UTF-8, null as empty) of at least
    ``min_revisit_bytes`` bytes, the one with the largest page_id (then url; null least)
    is a response and the others revisit it; of rows equal in all three, one is the
    response. Smaller payloads are all responses. The hash of the payload is
    pre-aggregated and only narrow rows meet by it; the html moves once, by a key that is
    the row's own, so a payload that a third of the rows share loads no task. Extra
    columns are ignored; an empty table gives no files.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = folder or scratch(spark, "warc")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    sha = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    rows = pages.select("page_id", "url", "html").withColumn("_sha", sha)
    rows = rows.withColumn("_key", F.concat_ws(":", text("page_id"), "_sha", F.when(F.col("url").isNull(), "-").otherwise(F.md5("url"))))
    narrow = rows.select("_key", "_sha", F.struct("page_id", "url").alias("_own"), (F.octet_length(F.coalesce("html", F.lit(""))) >= min_revisit_bytes).alias("_can"))
    tops = narrow.filter("_can").groupBy("_sha").agg(F.max(F.struct("_own", "_key")).alias("_top"))
    chosen = narrow.join(tops, "_sha", "left").groupBy("_key").agg(
        F.first("_can").alias("_can"), F.first("_top._key").alias("_top_key"), F.first("_top._own.page_id").alias("refers_to")
    )
    nth = F.row_number().over(Window.partitionBy("_key").orderBy("_key"))
    ready = (
        rows.withColumn("_nth", nth)
        .join(chosen, "_key")
        .withColumn("_revisit", F.col("_can") & ((F.col("_key") != F.col("_top_key")) | (F.col("_nth") > 1)))
        .select("_key", "_nth", "url", "html", "_revisit", "_top_key")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, out, made = TaskContext.get().partitionId(), 0, None, []
        system, base = open_fs(folder)
        system.create_dir(base)

        def close() -> None:
            nonlocal out
            if out:
                out["stream"].close()
                system.move(out["trial"], f"{base}/{out['file']}")
                made.append({k: out[k] for k in ("file", "records", "bytes")})
            out = None

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"pages-{part:06d}-{seq:04d}.warc.gz"
                    seq += 1
                    trial = f"{base}/{name}.{uuid.uuid4().hex}.part"
                    out = {"file": name, "trial": trial, "stream": system.open_output_stream(trial, compression=None), "records": 0, "bytes": 0}
                    about = b"software: splitscope\r\nformat: WARC File Format 1.1\r\n"
                    info = {"WARC-Record-ID": f"<{ID_PREFIX}info:{part}:{seq}>", "WARC-Date": date, "Content-Type": "application/warc-fields"}
                    out["bytes"] += out["stream"].write(record("warcinfo", info, about, level))
                payload = (row["html"] or "").encode()
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                named = {
                    "WARC-Record-ID": f"<{ID_PREFIX}{row['_key']}:{row['_nth']}>",
                    "WARC-Date": date,
                    "Content-Type": "application/http; msgtype=response",
                    "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}",
                }
                if row["url"] is not None:
                    named["WARC-Target-URI"] = " ".join(row["url"].split())
                if row["_revisit"]:
                    named |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<{ID_PREFIX}{row['_top_key']}:1>"}
                made_record = record("revisit", named, http, level) if row["_revisit"] else record("response", named, http + payload, level)
                out["bytes"] += out["stream"].write(made_record)
                out["records"] += 1
                if out["bytes"] >= file_bytes:
                    close()
        close()
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    schema = "file string, records bigint, bytes bigint"
    ready.mapInArrow(write, schema).write.parquet(f"{folder}/manifest")
    return spark.read.schema(schema).parquet(f"{folder}/manifest").withColumn("folder", F.lit(folder))


def _page(record_id: str) -> int | None:
    """page_id of a record's name."""
    first = record_id.strip("<>").removeprefix(ID_PREFIX).split(":")[0]
    return None if first == "-" else int(first)


def read_archives(manifest: DataFrame, *, payloads: bool = False) -> DataFrame:
    """A row for each page's record in the files of ``manifest``, read to the end and checked.

    For a revisit, length and digest are those its headers give for the full payload.
    """
    ship(manifest.sparkSession)
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, file string"
    schema += ", payload binary" * payloads

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = open_fs(f"{row['folder']}/{row['file']}")
                held, size, n = [], 0, 0
                with system.open_input_stream(path, compression=None) as f:
                    for r in read_records(f.read, payloads=payloads):
                        named = r["headers"]
                        if named["warc-type"] not in ("response", "revisit"):
                            continue
                        n += 1
                        again = named["warc-type"] == "revisit"
                        held.append(
                            {
                                "page_id": _page(named["warc-record-id"]),
                                "url": named.get("warc-target-uri"),
                                "payload_bytes": int(r["http"]["content-length"]) if again else r["payload_bytes"],
                                "payload_digest": named["warc-payload-digest"].removeprefix("sha1:"),
                                "record_type": named["warc-type"],
                                "refers_to": _page(named["warc-refers-to"]) if again else None,
                                "file": row["file"],
                            }
                            | ({"payload": r["payload"]} if payloads else {})
                        )
                        size += len(r["payload"] or b"")
                        if len(held) >= 4096 or size >= 1 << 24:
                            yield pa.RecordBatch.from_pylist(held, schema=arrow)
                            held, size = [], 0
                if n != row["records"]:
                    raise ValueError(f"{row['file']} has {n} records, its manifest {row['records']}")
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)

    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(n, kinds[t]) for n, t in (c.split() for c in schema.split(", "))])
    files = max(1, manifest.count())
    return manifest.repartition(files).mapInArrow(read, schema)
