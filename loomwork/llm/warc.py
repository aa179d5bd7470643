"""WARC archives with a two-level capture index.

Writing: every task appends its records, each a gzip member of its own, to one archive in the shared folder; a record is
a ``response`` with its payload or, if another capture holds the same payload, a ``revisit`` that refers to it.

Index: capture lines ``key archive offset length`` are sorted by key over all archives (range partitions), where a key is
the URL with its host reversed (``com,example,www)/path``) and the record id.  Each range writes one index file of
compressed blocks of lines and one sparse directory, with one fixed-size entry a block: place and length of the block
and its first key.  Directory and blocks are files, never broadcast or collected.

Reading: keys to look up are range-partitioned by the same boundaries and sorted.  For each key a binary search over the
directory of its index file (range reads of entries) finds the block, a range read fetches it, and a range read of the
archive fetches the record.  A block is kept until a key beyond it comes.

Files are written under a name of the attempt and renamed when complete, so that a lost executor's task can run again.
They are reached through Arrow's file systems by URI (file, hdfs, s3, gs), so every executor sees them.

Defined results: a null payload is empty; a null URL has the key ``-``; of equal payloads the largest record id is the
response (every row that carries it, should rows be repeated), a null id counts as smallest; payloads below
``min_revisit`` bytes are all responses; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import struct
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.arrow import in_small_batches, rows
from loomwork.llm.scratch import fresh_path, written

#: A directory entry: block's offset, length and first line, then the offset and length of its first key in the key file.
ENTRY = struct.Struct("<QIQI")
TAIL = struct.Struct("<QQ")


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and ":" not in uri.split("/")[0]:
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def reversed_host_key(url: bytes | str | None) -> str:
    """Sort key of a URL: host labels in reverse, then path and query; without scheme, user, port 80/443 and fragment."""
    text = url.decode("utf-8", "replace") if isinstance(url, bytes) else (url or "")
    if not text:
        return "-"
    try:
        parts = urlsplit(text if "://" in text else f"//{text}")
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return "-" + "".join(text.split())
    labels = ",".join(reversed(host.split("."))) if host else "-"
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    key = f"{labels}{f':{port}' if port not in (None, 80, 443) else ''}){tail}"
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in key)


def capture_key(url: bytes | str | None, record: int | None) -> bytes:
    """Key of one capture; records of one URL sort by id."""
    number = "-" if record is None else f"{record + 2**63:020d}"
    return f"{reversed_host_key(url)} {number}".encode()


@dataclass(frozen=True)
class Capture:
    """What a record says of a page; ``refers_to`` and ``refers_url`` name the response that a revisit repeats."""

    page: int | None
    url: bytes
    payload: bytes
    digest: str
    refers_to: int | None = None
    refers_url: bytes = b""


def _one_line(value: bytes) -> bytes:
    return value.replace(b"\r", b"%0D").replace(b"\n", b"%0A")


def record_bytes(capture: Capture, record_id: uuid.UUID, date: str) -> bytes:
    """One WARC record, compressed as a gzip member: an HTTP response, of which a revisit holds the head only."""
    revisit = capture.refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(capture.payload)
    block = http if revisit else http + capture.payload
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: <urn:uuid:%s>" % str(record_id).encode(),
        b"WARC-Date: " + date.encode(),
        b"WARC-Target-URI: " + _one_line(capture.url),
        b"WARC-Payload-Digest: sha1:" + capture.digest.encode(),
        b"Content-Type: application/http; msgtype=response",
        b"X-Page-Id: " + (b"-" if capture.page is None else b"%d" % capture.page),
        b"X-Payload-Length: %d" % len(capture.payload),
    ]
    if revisit:
        head += [
            b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            b"WARC-Refers-To-Target-URI: " + _one_line(capture.refers_url),
            b"WARC-Refers-To-Date: " + date.encode(),
            b"X-Refers-To-Page-Id: %d" % capture.refers_to,
        ]
    head.append(b"Content-Length: %d" % len(block))
    return gzip.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=4, mtime=0)


def parse_record(packed: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a compressed record."""
    raw = gzip.decompress(packed)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.decode().split(": ", 1) for line in head.split(b"\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_archives(pages: DataFrame, folder: str, min_revisit: int = 0, date: str | None = None) -> DataFrame:
    """Writes all pages; returns the capture lines (key, archive, offset, length).  ``date`` is that of the captures; now, if none.

    The responses of repeated payloads are a table of their own, without payloads.  Joined with it, a group of equal pages
    may be split over tasks, and while the table is small no page crosses the network.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    source = in_small_batches(pages).select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.unhex(F.sha2("html", 256)))
    groups = source.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.max("page_id").alias("response"), F.max_by("url", "page_id").alias("response_url"))
    several = written(groups.where("copies > 1 and response is not null").select("digest", "response", "response_url"), "responses")
    known = source.join(several, "digest", "left")
    revisits = F.coalesce(F.col("response") != F.col("page_id"), F.col("response").isNotNull()) & (F.octet_length("html") >= min_revisit)
    known = known.select("page_id", "url", "html", F.when(revisits, F.col("response")).alias("refers_to"), "response_url")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, base = open_folder(folder)
        store.create_dir(base, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        temporary = f"{base}/_{name}"
        lines: list[tuple[bytes, int, int]] = []
        at = 0
        with store.open_output_stream(temporary, compression=None) as f:
            for page, url, html, refers, refers_url in rows(parts, "page_id", "url", "html", "refers_to", "response_url"):
                capture = Capture(page, url, html, sha1_base32(html), refers, refers_url)
                packed = record_bytes(capture, uuid.uuid5(uuid.NAMESPACE_URL, f"{name}#{at}"), date)
                f.write(packed)
                lines.append((capture_key(url, page), at, len(packed)))
                at += len(packed)
        store.move(temporary, f"{base}/{name}")
        n = len(lines)
        columns = list(zip(*lines, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.binary()), pa.array([name] * n, pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["key", "archive", "offset", "length"]
        )

    return written(known.mapInArrow(run, "key binary, archive string, offset long, length long"), "captures")


class IndexWriter:
    """Writes one index file of blocks and its sparse directory."""

    def __init__(self, store: fs.FileSystem, base: str, name: str, lines_per_block: int):
        self.store, self.base, self.name, self.most = store, base, name, lines_per_block
        self.blocks, self.keys, self.entries = io.BytesIO(), io.BytesIO(), []
        self.held: list[bytes] = []
        self.file = store.open_output_stream(f"{base}/_{name}.idx", compression=None)
        self.at, self.lines = 0, 0

    def add(self, line: bytes) -> None:
        self.held.append(line)
        if len(self.held) >= self.most:
            self._flush()

    def _flush(self) -> None:
        if not self.held:
            return
        key = b" ".join(self.held[0].split(b" ", 2)[:2])
        packed = gzip.compress(b"\n".join(self.held), compresslevel=5, mtime=0)
        self.file.write(packed)
        self.entries.append((self.at, len(packed), self.lines, self.keys.tell(), len(key)))
        self.keys.write(key)
        self.at += len(packed)
        self.lines += len(self.held)
        self.held = []

    def close(self) -> int:
        """Appends the directory (keys, fixed-size entries, tail) and gives the file its name."""
        self._flush()
        keys = self.keys.getvalue()
        self.file.write(keys)
        for at, size, _, key_at, key_size in self.entries:
            self.file.write(ENTRY.pack(at, size, self.at + key_at, key_size))
        self.file.write(TAIL.pack(self.at + len(keys), len(self.entries)))
        self.file.close()
        self.store.move(f"{self.base}/_{self.name}.idx", f"{self.base}/{self.name}.idx")
        return self.lines


class CaptureIndex:
    """Look-ups in one index file by binary search over its directory, with range reads only."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.file = store.open_input_file(path)
        end = self.file.size()
        self.entries_at, self.count = TAIL.unpack(self.file.read_at(TAIL.size, end - TAIL.size))
        self.reads = 0
        self.known: dict[int, tuple[int, int, bytes]] = {}
        self.block = -1
        self.lines: list[bytes] = []
        self.keys: list[bytes] = []

    def _entry(self, k: int) -> tuple[int, int, bytes]:
        """An entry of the directory.  The latest ones are kept: the upper steps of every search visit the same few."""
        if k not in self.known:
            if len(self.known) >= 4096:
                self.known.pop(next(iter(self.known)))
            at, size, key_at, key_size = ENTRY.unpack(self.file.read_at(ENTRY.size, self.entries_at + k * ENTRY.size))
            self.known[k] = at, size, bytes(self.file.read_at(key_size, key_at))
            self.reads += 1
        return self.known[k]

    def block_of(self, key: bytes) -> int:
        """The last block whose first key is smaller than the key or equal to it; 0 if none is."""
        low, high = 0, self.count
        while high - low > 1:
            mid = (low + high) // 2
            if self._entry(mid)[2] <= key:
                low = mid
            else:
                high = mid
        return low

    def _load(self, k: int) -> None:
        if k != self.block:
            at, size, _ = self._entry(k)
            self.lines = gzip.decompress(self.file.read_at(size, at)).split(b"\n")
            self.keys = [b" ".join(x.split(b" ", 2)[:2]) for x in self.lines]
            self.block = k

    def find(self, key: bytes) -> list[bytes]:
        """All capture lines of the key."""
        if not self.count:
            return []
        if not (self.keys and self.keys[0] < key <= self.keys[-1]):
            self._load(self.block_of(key))
        while self.block > 0 and self.keys[0] == key:  # its lines may begin in an earlier block
            self._load(self.block - 1)
        out = []
        while True:
            k = bisect_right(self.keys, key)
            j = k
            while j and self.keys[j - 1] == key:
                j -= 1
            out += self.lines[j:k]
            if k < len(self.keys) or self.block + 1 >= self.count:
                return out
            if self._entry(self.block + 1)[2] != key:
                return out
            self._load(self.block + 1)


def _boundaries(captures: DataFrame, ranges: int) -> list[bytes]:
    """Keys that divide the captures into ranges: of a sample of fixed size, so the driver can hold them."""
    if ranges < 2:
        return []
    n = captures.count()
    share = min(1.0, 200.0 * ranges / max(n, 1))
    got = sorted(bytes(r.key) for r in captures.select("key").sample(False, share, 7).limit(1000 * ranges).collect())
    return sorted({got[len(got) * k // ranges] for k in range(1, ranges)}) if got else []


def _ranged(df: DataFrame, limits: list[bytes]) -> DataFrame:
    """Adds the number of each key's range."""
    if not limits:
        return df.withColumn("shard", F.lit(0))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            keys = b.column(b.schema.get_field_index("key")).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([bisect_right(limits, k) for k in keys], pa.int32())], names=[*b.schema.names, "shard"])

    schema = ", ".join(f"{c} {t}" for c, t in df.dtypes)
    return df.mapInArrow(run, f"{schema}, shard int")


def build_index(captures: DataFrame, folder: str, limits: list[bytes], lines_per_block: int = 1000) -> DataFrame:
    """Writes the index files; returns (shard, file, lines)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_folder(folder)
        store.create_dir(base, recursive=True)
        writer, current, out = None, None, []

        def done() -> None:
            out.append((current, f"{writer.name}.idx", writer.close()))

        for shard, key, archive, offset, length in rows(parts, "shard", "key", "archive", "offset", "length"):
            if shard != current:
                if writer:
                    done()
                current = shard
                writer = IndexWriter(store, base, f"captures-{shard:05d}-{uuid.uuid4().hex}", lines_per_block)
            writer.add(key + b" %s %d %d" % (archive, offset, length))
        if writer:
            done()
        columns = list(zip(*out, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["shard", "file", "lines"])

    ordered = _ranged(captures, limits).repartitionById(len(limits) + 1, "shard").sortWithinPartitions("shard", "key")
    return written(ordered.mapInArrow(run, "shard int, file string, lines long"), "index")


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def look_up(wanted: DataFrame, index: DataFrame, folder: str, limits: list[bytes]) -> DataFrame:
    """The records of all captures of the keys in ``wanted`` (key), read from index and archives; a row per record."""
    files = {r.shard: r.file for r in index.select("shard", "file").collect()}  # one small row a shard

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_folder(folder)
        shard_of, found, archives = None, None, {}
        for batch in parts:
            out = []
            for shard, key in rows([batch], "shard", "key"):
                if shard != shard_of:
                    shard_of, found = shard, CaptureIndex(store, f"{base}/{files[shard]}") if shard in files else None
                for line in found.find(key) if found else ():
                    archive, offset, length = line.split(b" ")[-3:]
                    if archive not in archives:
                        if len(archives) > 256:
                            archives.pop(next(iter(archives))).close()
                        archives[archive] = store.open_input_file(f"{base}/{archive.decode()}")
                    fields, body = parse_record(archives[archive].read_at(int(length), int(offset)))
                    kind = fields["WARC-Type"]
                    number, refers = fields["X-Page-Id"], fields.get("X-Refers-To-Page-Id")
                    size, digest = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response":
                        size, digest = len(body), sha1_base32(body)
                    out.append((None if number == "-" else int(number), fields["WARC-Target-URI"], size, digest, kind, int(refers) if refers else None))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in RECORD.split(", ")])

    ordered = _ranged(wanted, limits).repartitionById(len(limits) + 1, "shard").sortWithinPartitions("shard", "key")
    return ordered.select("shard", "key").mapInArrow(run, RECORD)


def keys_of(pages: DataFrame) -> DataFrame:
    """The distinct capture keys of a table of pages."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            yield pa.RecordBatch.from_arrays([pa.array([capture_key(url, page) for page, url in rows([b], "page_id", "url")], pa.binary())], names=["key"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url")).mapInArrow(run, "key binary").distinct()


def archive_and_read(pages: DataFrame, min_revisit: int = 0, lines_per_block: int = 1000) -> DataFrame:
    """Writes pages to archives with an index, then looks every page up again and reads its record."""
    folder = fresh_path(pages.sparkSession, "warc")
    captures = write_archives(pages, folder, min_revisit)
    ranges = max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    limits = _boundaries(captures, ranges)
    index = build_index(captures, folder, limits, lines_per_block)
    return look_up(keys_of(pages), index, folder, limits)
