"""WARC archives with a two-level capture index.

Pages become WARC records, one gzip member each, in archive files in the shared folder; of equal payloads one record
holds the payload and the others are revisits of it. The index sorts captures by their URL with the host reversed, in
compressed blocks of BLOCK lines; a sparse directory at the end of each index file has the first key of each block. A
lookup finds the file among the files' first keys and the block in its directory by binary search, reads that block,
finds the line in it, and reads the record's bytes; nothing else is read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import empty_text, partitions, shared_dir, table, written

#: Payloads of fewer bytes are never revisits. Lines of an index block. Bytes at which an archive file ends.
LEAST_PAYLOAD, BLOCK, FILE = 100, 512, 64 << 20
#: Captures of an index file, about, and index files at most: beyond that they grow.
INDEX_ROWS, MOST_FILES = 20_000, 10_000
#: Salt against payloads that a large share of the pages has.
SALT = 32
_MAGIC = b"CAPTURES"
_RECORD = "key string, page_id long, file string, start long, length long"
_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def reversed_host(url: str | None) -> str:
    """The URL with its host's labels reversed, without scheme, port and fragment; null: empty; no host: as it is."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host = parts.hostname
    except ValueError:
        return url
    if not host:
        return url
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def capture_key(url: str | None, page_id: int | None) -> str:
    """Sorts by reversed host and path, then by page_id, nulls first."""
    return reversed_host(url).replace("\n", "%0A").replace("\t", "%09") + "\x01" + ("" if page_id is None else f"{page_id + (1 << 63):020d}")


def _header(text: str | None) -> str:
    return (text or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unheader(text: str) -> str:
    return text.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None) -> bytes:
    """One WARC record as a gzip member: a revisit if refers_to is given, else a response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    lines.append(f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        if refers_url is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_header(refers_url)}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parsed(member: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload of one record. Checks what it reads."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
    kind = fields["WARC-Type"]
    if lines[0] != "WARC/1.1" or (kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest)):
        raise ValueError(f"broken record {fields.get('WARC-Record-ID')}")
    refers = number(fields["WARC-Refers-To"]) if kind == "revisit" else None
    url = fields.get("WARC-Target-URI")
    return number(fields["WARC-Record-ID"]), size, digest, kind, refers, None if url is None else _unheader(url), payload if kind == "response" else None


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _unique(kind: str) -> str:
    task = TaskContext.get()
    return f"{kind}-{task.partitionId():06d}-{task.taskAttemptId()}"


def archived(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archive files into folder; key, page_id, file, start and length of each record, as a table."""
    payload = F.encode(empty_text("html"), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    equal = rows.where(F.octet_length("payload") >= LEAST_PAYLOAD).groupBy("digest")
    equal = equal.agg(F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("first_url"), F.count("*").alias("n")).where("n > 1")
    equal = equal.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).hint("merge")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int"))
    rows = rows.join(equal, ["digest", "salt"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.select("page_id", "url", "payload", refers.alias("refers_to"), F.when(refers.isNotNull(), F.col("first_url")).alias("refers_url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _place(folder)
        out, at, files, name = None, 0, 0, ""
        for batch in batches:
            lines = []
            for k in range(batch.num_rows):
                page_id, url, raw, to, to_url = (c[k].as_py() for c in batch.columns)
                if out is None:
                    name, at, files = f"{_unique('pages')}-{files:04d}.warc.gz", 0, files + 1
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                member = record(page_id, url, raw, to, to_url)
                out.write(member)
                lines.append((capture_key(url, page_id), page_id, name, at, len(member)))
                at += len(member)
                if at >= FILE:
                    out = out.close()
            cols = list(zip(*lines, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "page_id", "file", "start", "length"])
        if out is not None:
            out.close()

    return written(rows.mapInArrow(run, _RECORD), "warc-captures")


def indexed(captures: DataFrame, folder: str) -> list[tuple[str, str]]:
    """Writes the index files; (first key, file) of each, in order. Their number follows the captures', up to MOST_FILES."""
    lines = captures.select("key", F.to_json(F.struct("file", "start", "length")).alias("line"))
    lines = lines.repartitionByRange(max(1, min(MOST_FILES, -(-captures.count() // INDEX_ROWS))), "key").sortWithinPartitions("key", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _place(folder)
        name, directory, some, at, out = "", [], [], 0, None

        def block() -> None:
            nonlocal some, at
            raw = zlib.compress("\n".join(f"{k}\t{x}" for k, x in some).encode("utf-8", "surrogatepass"), 6)
            directory.append((some[0][0], at, len(raw)))
            out.write(raw)
            some, at = [], at + len(raw)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"{_unique('index')}.captures"
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                some.append(row)
                if len(some) == BLOCK:
                    block()
        if some:
            block()
        if out is not None:
            foot = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(foot + len(foot).to_bytes(8, "little") + _MAGIC)
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([name])], ["first", "file"])

    return sorted((r[0], r[1]) for r in lines.mapInArrow(run, "first string, file string").collect())


class Index:
    """Reads one index file: its directory once, then one block at a time."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != _MAGIC:
            raise ValueError(f"no index: {path}")
        foot = int.from_bytes(tail[:8], "little")
        self.directory = json.loads(zlib.decompress(self.file.read_at(foot, size - 16 - foot)))
        self.firsts = [x[0] for x in self.directory]
        self.number, self.keys, self.lines = -1, [], []

    def find(self, key: str) -> Iterator[dict]:
        """The captures of a key: the block where it can begin, and those after it while they begin with it."""
        at = max(0, bisect_right(self.firsts, key) - 1)
        while at > 0 and self.firsts[at] == key:
            at -= 1
        while at < len(self.firsts) and self.firsts[at] <= key:
            if at != self.number:
                _, start, size = self.directory[at]
                rows = zlib.decompress(self.file.read_at(size, start)).decode("utf-8", "surrogatepass").split("\n")
                pairs = [x.split("\t", 1) for x in rows]
                self.number, self.keys, self.lines = at, [p[0] for p in pairs], [p[1] for p in pairs]
            k = bisect_right(self.keys, key)
            first = k
            while first > 0 and self.keys[first - 1] == key:
                first -= 1
            yield from map(json.loads, self.lines[first:k])
            at += 1


def looked_up(wanted: DataFrame, shards: list[tuple[str, str]], folder: str) -> DataFrame:
    """The records of the captures of wanted (url, page_id), each record once; what isn't there gives no row."""
    firsts = [k for k, _ in shards]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [capture_key(u, p) for u, p in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([max(0, bisect_right(firsts, k) - 1) for k in keys], pa.int64())], ["key", "shard"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _place(folder)
        shard, index, files = -1, None, {}
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
        names = [x.split()[0] for x in _READ.split(", ")]
        for batch in batches:
            out, held = [], 0
            for key, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != shard:
                    shard, index = own, Index(fs, f"{path}/{shards[own][1]}")
                # a key's captures may go on in the next files
                for k in range(own, len(shards)):
                    if k > own and firsts[k] > key:
                        break
                    for found in (index if k == own else Index(fs, f"{path}/{shards[k][1]}")).find(key):
                        if found["file"] not in files:
                            if len(files) > 64:
                                files.clear()
                            files[found["file"]] = fs.open_input_file(f"{path}/{found['file']}")
                        out.append(parsed(files[found["file"]].read_at(found["length"], found["start"])))
                        held += found["length"]
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    keys = wanted.select("url", F.col("page_id").cast("long").alias("page_id")).mapInArrow(keyed, "key string, shard long").distinct()
    return keys.repartition(max(len(shards), partitions(wanted)), "shard").sortWithinPartitions("shard", "key").mapInArrow(read, _READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url and payload of each page, as read back.

    Null html: empty payload. Of equal payloads of LEAST_PAYLOAD bytes or more, rows with the smallest page_id are
    responses and the others revisit it; a null page_id is never the smallest. Repeated rows are records of their own.
    A null url sorts first. Other columns are ignored. Empty table: no rows.
    """
    folder = f"{shared_dir(pages.sparkSession)}/warc-{pages.sparkSession.sparkContext._jvm.java.util.UUID.randomUUID().toString()}"
    fs, path = _place(folder)
    fs.create_dir(path, recursive=True)
    shards = indexed(archived(pages, folder), folder)
    if not shards:
        return pages.sparkSession.createDataFrame([], _READ)
    return looked_up(pages, shards, folder)


def op1_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).drop("payload")
