"""WARC archives whose records are zstd frames under a shared dictionary, written and read back by Spark tasks.

A file is a skippable frame that holds the dictionary, then one frame a record. Files go to the folder that driver and
executors share, under a name of their own for each attempt of a task, and only the manifest of a successful attempt names
them; a lost executor costs a rewrite, never a half-written or doubled record.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.store import drawn, new_path, saved

#: Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}"


def _number(name: str | None) -> int | None:
    """The page id in <urn:page:ID>."""
    last = (name or "").strip("<>").rpartition(":")[2]
    return None if last in ("", "null") else int(last)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response with its payload, or a revisit with the HTTP head alone, whose Content-Length still tells the payload's size."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    target = " ".join((url or _name(page_id)).split())
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_name(page_id)}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}",
        "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: <{_name(refers_to)}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def train_dictionary(pages: DataFrame, id_col: str, url_col: str, html_col: str, max_pages: int, max_chars: int, size: int, date: str) -> bytes:
    """Dictionary from the records of at most `max_pages` pages of smallest hashed id, `max_chars` of each at most: a bounded
    sample that only steers compression. Empty where there is too little to train on."""
    rows = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].cast("string").alias("url"), F.substring(F.coalesce(pages[html_col].cast("string"), F.lit("")), 1, max_chars).alias("html"))
    sample = drawn(rows, max_pages, 1, "id").collect()
    samples = [record(r["id"] or 0, r["url"], r["html"].encode("utf-8", "surrogatepass"), None, date) for r in sample]
    if len(samples) < 16 or sum(map(len, samples)) < 8 * size:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # samples too alike or too small for a dictionary
        return b""


class _File:
    """One archive being written: a temporary name until closed."""

    def __init__(self, system: fs.FileSystem, folder: str, dictionary: bytes, level: int):
        self.system, self.name, self.records, self.bytes = system, f"{folder}/{uuid.uuid4().hex}.warc.zst", 0, 0
        system.create_dir(folder, recursive=True)
        self.out = system.open_output_stream(self.name + ".part", compression=None)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
        self._put(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def add(self, data: bytes) -> None:
        self._put(self.compressor.compress(data))
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        self.system.move(self.name + ".part", self.name)
        return self.name, self.records, self.bytes

    def drop(self) -> None:
        self.out.close()
        self.system.delete_file(self.name + ".part")


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, level: int = 3, roll_bytes: int = 32 << 20, dict_pages: int = 400, dict_chars: int = 20_000, dict_bytes: int = 48 << 10, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a record a row and returns the manifest: file, records, bytes.

    Of rows with equal payloads of at least `min_bytes` bytes, that with the smallest id is a response and the others are
    revisits of it; rows that repeat that id and payload are responses too. Null html is an empty payload; a null url
    becomes urn:page:<id>; rows without an id are responses named urn:page:null, read back as null. An empty table gives no file. Columns
    besides the three named are not read. Only digests are shuffled to find equal payloads, with partial sums; pages are
    shuffled only where the list of revisits is too large for Catalyst to broadcast.
    """
    spark = pages.sparkSession
    rows = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"))
    keyed = rows.withColumns({"sha": F.sha1(F.encode("html", "UTF-8")), "size": F.octet_length("html")})
    digests = saved(keyed.select("id", "sha", "size"), "payload-digests")
    first = digests.where(F.col("size") >= min_bytes).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    revisits = saved(digests.where(F.col("size") >= min_bytes).join(first, "sha").where("id != first").select("id", "sha", "first").distinct(), "revisits")
    dictionary = train_dictionary(pages, id_col, url_col, html_col, dict_pages, dict_chars, dict_bytes, date)
    system_uri = new_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(system_uri)
        open_file: _File | None = None
        done: list[tuple[str, int, int]] = []
        try:
            for batch in batches:
                for k in range(batch.num_rows):
                    page_id, url, html, to = (batch.column(c)[k].as_py() for c in range(4))
                    open_file = open_file or _File(system, folder, dictionary, level)
                    open_file.add(record(page_id, url, html.encode("utf-8", "surrogatepass"), to, date))
                    if open_file.bytes >= roll_bytes:
                        done.append(open_file.close())
                        open_file = None
            if open_file:
                done.append(open_file.close())
                open_file = None
        finally:
            if open_file:
                open_file.drop()
        scheme = system_uri[: len(system_uri) - len(folder)] if system_uri.endswith(folder) else ""
        yield pa.RecordBatch.from_arrays([pa.array([scheme + x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())], names=["file", "records", "bytes"])

    if revisits.isEmpty():
        named = rows.withColumn("first", F.lit(None).cast("long"))
    else:
        named = keyed.join(revisits, ["id", "sha"], "left").select("id", "url", "html", "first")
    return saved(named.mapInArrow(run, "file string, records long, bytes long"), "manifest")


def records_in(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a decompressed archive, one at a time."""
    buffer = b""

    def more() -> bool:
        nonlocal buffer
        data = stream.read(1 << 18)
        buffer += data
        return bool(data)

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                if buffer:
                    raise ValueError("an archive ends within a record's header")
                return
        first, *lines = buffer[:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers["content-length"])
        parts, have = [buffer[end + 4 : end + 8 + size]], min(len(buffer) - end - 4, size + 4)
        rest = buffer[end + 8 + size :]
        while have < size + 4:
            data = stream.read(1 << 18)
            if not data:
                raise ValueError("an archive ends within a record")
            take = data[: size + 4 - have]
            parts.append(take)
            have += len(take)
            rest = data[len(take) :]
        whole = b"".join(parts)
        buffer = rest
        if whole[size:] != b"\r\n\r\n":
            raise ValueError("a record does not end in two line ends")
        yield headers, whole[:size]


def read_file(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_stream(path, compression=None) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != SKIPPABLE:
            raise ValueError(f"{uri} does not begin with a dictionary frame")
        dictionary = f.read(size)
        decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        with decompressor.stream_reader(f, read_across_frames=True) as stream:
            yield from records_in(stream)


def read(manifest: DataFrame, files: int | None = None) -> DataFrame:
    """A row a record of the manifest's files: page_id, url, record_type, refers_to, payload_bytes, payload_digest, html (null
    for a revisit). Each response's payload is digested anew and held against its header; a difference is an error."""
    count = files or max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "html"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows, held = [], 0
                for h, block in read_file(uri):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    said = h["warc-payload-digest"].removeprefix("sha1:")
                    if h["warc-type"] == "response" and (digest(payload) != said or len(payload) != size):
                        raise ValueError(f"{h['warc-record-id']} in {uri} differs from its digest")
                    rows.append((_number(h["warc-record-id"]), h["warc-target-uri"], h["warc-type"], _number(h.get("warc-refers-to")), size, said, payload.decode("utf-8", "surrogatepass") if h["warc-type"] == "response" else None))
                    held += len(block)
                    if held > 8 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return manifest.select("file").repartition(count).mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, html string")


def archives(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Writes pages and reads the archives back."""
    return read(write(pages, **options))
