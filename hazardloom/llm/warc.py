"""WARC archives in Zstandard: one frame per record, with the dictionary in a skippable frame at the front.

An archive is one byte string. ``write_archives`` makes them in tasks as rows (archive, content), which Spark stores where
all executors see them; ``archive_files`` reads real files into the same rows, ``export_files`` writes them.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardloom.session import written

DICTIONARY_MAGIC = 0x184D2A5D  # the skippable frame that holds the dictionary
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
MAX_RECORD = (1 << 31) - 1  # bytes of a record that is read: what a column can hold
FRAME_MAGIC = 0xFD2FB528
ARCHIVE_BYTES = 8_000_000  # plain bytes after which a new archive begins
SAMPLE_BYTES, DICTIONARY_BYTES = 1_000_000, 16_384  # records a dictionary learns from, its size
SHARED_FROM = 1000  # bytes from which equal payloads are stored once
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of capture
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """A frame, header or length that is not as the format asks."""


def _clean(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit has an empty block and names the page that has its payload."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    head = [("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", _clean(url)))
    if revisit:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", IDENTICAL)]
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload))),
             ("Content-Type", "text/html"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def build_archive(records: list[bytes]) -> bytes:
    """Dictionary frame and one compressed frame per record. With too few records to learn from there is no dictionary."""
    sample, size = [], 0
    for r in records[:: max(1, len(records) // 400)]:
        sample.append(r[:8192])
        size += len(sample[-1])
        if size > SAMPLE_BYTES:
            break
    front, options = b"", {"level": LEVEL, "write_checksum": True, "write_content_size": True}
    if len(sample) >= 20 and size > 8 * DICTIONARY_BYTES:
        learned = zstd.train_dictionary(DICTIONARY_BYTES, sample, steps=1, k=64, d=8)
        raw = learned.as_bytes()
        front = struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw
        options["dict_data"] = learned
    pack = zstd.ZstdCompressor(**options).compress
    return front + b"".join(map(pack, records))


def _frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, from its headers alone."""
    head = data[at : at + 18]
    try:
        checksum = zstd.get_frame_parameters(head).has_checksum
        at += zstd.frame_header_size(head)
    except zstd.ZstdError as e:
        raise WarcError(f"frame header at {at}: {e}") from e
    while True:
        if at + 3 > len(data):
            raise WarcError("archive ends inside a frame")
        block = int.from_bytes(data[at : at + 3], "little")
        kind, size = block >> 1 & 3, block >> 3
        at += 3 + (1 if kind == 1 else size)  # a run-length block stores one byte
        if block & 1:
            break
    at += 4 * checksum
    if at > len(data):
        raise WarcError("archive ends inside a frame")
    return at


def _unpacked(frame: memoryview, unpack: zstd.ZstdDecompressor, most: int) -> bytes:
    """Content of a frame, which need not name its size, if it has at most ``most`` bytes."""
    try:
        size = zstd.frame_content_size(frame)
        if size > most:
            raise WarcError(f"a frame of {size} bytes, more than {most}")
        if size >= 0:
            return unpack.decompress(frame)
        with unpack.stream_reader(frame) as reader:
            content = reader.read(most + 1)
    except zstd.ZstdError as e:
        raise WarcError(f"frame: {e}") from e
    if len(content) > most:
        raise WarcError(f"a frame of more than {most} bytes")
    return content


def read_records(content: bytes, most: int = MAX_RECORD) -> Iterator[bytes]:
    """The records of an archive, one for each frame. Skippable frames other than a leading dictionary are passed over.

    Frames may leave out their content's size, as streaming writers do. Whatever is damaged, and a record of more than ``most`` bytes, is a
    ``WarcError``.
    """
    data, at, unpack = memoryview(content), 0, zstd.ZstdDecompressor()
    while at < len(data):
        if at + 8 > len(data):
            raise WarcError("archive ends inside a frame")
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            if at + 8 + size > len(data):
                raise WarcError("archive ends inside a skippable frame")
            if magic == DICTIONARY_MAGIC and at == 0:
                raw = bytes(data[8 : 8 + size])
                if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may itself be compressed
                    raw = _unpacked(memoryview(raw), unpack, most)
                unpack = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(raw))
            at += 8 + size
        elif magic == FRAME_MAGIC:
            end = _frame_end(data, at)
            yield _unpacked(data[at:end], unpack, most)
            at = end
        else:
            raise WarcError(f"no frame at {at}")


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record, checked: version, named fields, length and closing lines."""
    head, found, rest = record.partition(b"\r\n\r\n")
    if not found:
        raise WarcError("no end of headers")
    try:
        version, *lines = head.decode().split("\r\n")
    except UnicodeDecodeError as e:
        raise WarcError(f"headers are no UTF-8: {e}") from e
    if not version.startswith("WARC/1."):
        raise WarcError(f"version {version[:20]!r}")
    headers = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"header line {line[:40]!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"no {name}")
    if not headers["content-length"].isdigit():
        raise WarcError("content-length is no number")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"block of {len(rest) - 4} bytes, content-length {n}")
    return headers, rest[:n]


def _page(urn: str) -> int | None:
    if not urn.startswith("<urn:page:") or not urn.endswith(">"):
        raise WarcError(f"record id {urn[:40]!r}")
    return int(urn[10:-1]) if urn[10:-1] else None


def checked_page(record: bytes) -> dict:
    """The fields of a page's record; a response's block must have the length and digest that its headers give."""
    headers, block = parse_record(record)
    kind, digest = headers["warc-type"], headers.get("warc-payload-digest", "")
    if kind not in ("response", "revisit") or not digest.startswith("sha1:"):
        raise WarcError(f"type {kind!r} or digest {digest[:20]!r}")
    size = int(headers.get("x-payload-length", len(block)))
    if kind == "response" and (size != len(block) or hashlib.sha1(block).hexdigest() != digest[5:]):
        raise WarcError("payload is not what its digest says")
    if kind == "revisit" and (block or "warc-refers-to" not in headers):
        raise WarcError("revisit with a block or without a record to refer to")
    return {
        "page_id": _page(headers["warc-record-id"]), "url": headers.get("warc-target-uri"), "payload_bytes": size,
        "payload_digest": digest[5:], "record_type": kind,
        "refers_to": _page(headers["warc-refers-to"]) if kind == "revisit" else None, "payload": block if kind == "response" else None,
    }


def with_keepers(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """page_id, url, payload, digest and ``refers_to``: of equal payloads of SHARED_FROM bytes or more, the largest id keeps it.

    Only digests that occur more than once go into the table of keepers, which is written first, so that Spark knows
    its size before it chooses the join; payloads move only if that table is too large to send to all.
    """
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.encode(payload_col, "UTF-8"), F.lit(b"")).alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    keepers = rows.where(F.length("payload") >= SHARED_FROM).groupBy("digest").agg(
        F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")
    ).where("n > 1 AND keeper IS NOT NULL").drop("n")
    met = rows.join(written(keepers, "keepers"), "digest", "left")
    return met.select(
        "page_id", "url", "payload", "digest",
        F.when(F.col("page_id").eqNullSafe(F.col("keeper")), F.lit(None)).otherwise(F.col("keeper")).cast("bigint").alias("refers_to"),
    )


def write_archives(rows: DataFrame) -> DataFrame:
    """(archive, records, content): archives of about ARCHIVE_BYTES, made inside the tasks of the input's partitions."""

    def each(batches):
        records, size = [], 0
        for b in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                records.append(record_bytes(page_id, url, payload, digest, refers_to))
                size += len(records[-1])
                if size >= ARCHIVE_BYTES:
                    yield _archive(records)
                    records, size = [], 0
        if records:
            yield _archive(records)

    return rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(each, "archive string, records bigint, content binary")


def _archive(records: list[bytes]) -> pa.RecordBatch:
    content = build_archive(records)
    name = hashlib.sha1(content).hexdigest() + ".warc.zst"  # a task that runs again gives the same name
    return pa.RecordBatch.from_arrays(
        [pa.array([name]), pa.array([len(records)], pa.int64()), pa.array([content], pa.binary())], names=["archive", "records", "content"]
    )


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The pages in archives (column ``content``), with their payloads on request; raises WarcError on damaged ones."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    kinds = dict(zip(names, [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()], strict=False))

    def each(batches):
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for record in read_records(content.as_py()):
                    rows.append(checked_page(record))
                    size += len(record)
                    if size > ARCHIVE_BYTES:
                        yield _rows(rows, kinds)
                        rows, size = [], 0
                yield _rows(rows, kinds)

    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return archives.select("content").mapInArrow(each, schema + ", payload binary" * payloads)


def _rows(rows: list[dict], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """Archives from ``*.warc.zst`` files: (archive, content)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")


def export_files(archives: DataFrame, uri: str) -> DataFrame:
    """Write each archive as a file below ``uri`` (any file system that pyarrow knows): the names and sizes written.

    A file appears under its name only when it is whole, and a task that runs again writes the same bytes.
    """

    def each(batches):
        fs, base = pafs.FileSystem.from_uri(uri)
        fs.create_dir(base, recursive=True)
        for b in batches:
            names, contents = b.column(0).to_pylist(), b.column(1).to_pylist()
            for name, content in zip(names, contents, strict=True):
                part = f"{base}/.{name}.{id(content)}"
                with fs.open_output_stream(part) as f:
                    f.write(content)
                fs.move(part, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, contents), pa.int64())], names=["archive", "bytes"])

    return archives.select("archive", "content").mapInArrow(each, "archive string, bytes bigint")


def archived_pages(pages: DataFrame, **columns) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back: one row per input row.

    A null payload is empty. Rows without id are never referred to while a row with an id has the same payload; equal
    payloads without any id are responses. Repeated rows that hold the largest id are responses. An empty table makes no archive.
    Pages of any length that a column can hold are one record each; other columns are not read.
    """
    archives = written(write_archives(with_keepers(pages, **columns)), "archives")
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
