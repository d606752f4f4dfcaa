"""WARC archives with a two-level capture index.

Archives are gzip members, one a record, written by the executors into a shared folder. A capture's key
is its reversed-host URL (com,example,blog)/path and page_id. Captures are sorted by key over the
whole corpus; each range partition writes its captures as compressed blocks of BLOCK lines and a sparse
directory of one line a block: first key, offset, length. A top list of one line a range partition
names the parts. A look-up finds the part, binary-searches the directory file by seeking, reads one
block's range (and those after it while the key goes on), binary-searches it and reads one record's range; batches of look-ups come in key order
and read each block once.

Of records with equal payloads of REVISIT_BYTES or more, that with the smallest page_id is the response,
the others revisit it and carry no payload.

Files are written under a name of the attempt and renamed, so retries and lost executors leave whole files
or none, and a retry writes the same bytes.

Defined results: a null html is an empty payload; a null or hostless url has the key of its text as it is;
rows that repeat the smallest page_id of a payload are all responses; a null page_id comes last and is a
revisit of a payload that a page_id has, else a response; an empty table gives no archive.
"""

from __future__ import annotations

import gzip
import hashlib
import os
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.llm.shared import scratch_path, shuffle_partitions, text_batches, written

REVISIT_BYTES = 100
BLOCK = 500
_DATE = "2024-01-01T00:00:00Z"  # pages carry no capture time

_INDEX = "key string, page_id long, part string, offset long, length long"


def surt(url: str | None) -> str:
    """A URL with its host reversed, so that a domain's captures sort together."""
    try:
        parts = urlsplit(url or "")
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url or ""
    if not host:
        return url or ""
    if host.startswith("www."):
        host = host[4:]
    reverse = host if host.replace(".", "").isdigit() or ":" in host else ",".join(reversed(host.split(".")))
    return f"{reverse}{f':{port}' if port and port not in (80, 443) else ''}){(parts.path or '/').lower()}{f'?{parts.query.lower()}' if parts.query else ''}"


def capture_key(url: str | None, page_id: int | None) -> str:
    """Unique and sortable; a line of the index, so without spaces or breaks."""
    plain = "".join(c if c > " " else f"%{ord(c):02X}" for c in surt(url))
    return f"{plain} {'~' if page_id is None else format(page_id + 2**63, '020d')}"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def _tidy(path: str) -> str:
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


class _Writer:
    """A file that is there only once it is whole."""

    def __init__(self, folder: str, name: str):
        self.fs, root = _store(folder)
        self.fs.create_dir(root, recursive=True)
        context = TaskContext.get()
        self.part, self.final = name, f"{root}/{name}"
        self.own = f"{self.final}.{context.taskAttemptId() if context else os.getpid()}.tmp"
        self.out, self.at = self.fs.open_output_stream(self.own, compression=None), 0

    def write(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.own, self.final)


def record(page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None, payload: bytes) -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit has no payload of its own."""
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {''.join(c for c in url or '' if c not in chr(13) + chr(10))}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers_to is not None else []),
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(payload) if refers_to is None else 0}",
    ]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + (payload if refers_to is None else b"") + b"\r\n\r\n"
    return gzip.compress(raw, 4, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _page(reference: str | None) -> int | None:
    inner = (reference or "")[len("<urn:page:") : -1]
    return int(inner) if inner else None


def plan_records(pages: DataFrame) -> DataFrame:
    """Per page row: page_id, url_hash, digest, refers_to (null for responses). Only digests are compared; of a hot
    payload's rows each partition passes on one."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size"))
    place = F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id")
    first = rows.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", F.col("first.page_id").alias("first"))
    joined = rows.join(first, "digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select(F.col("page_id").alias("__id"), F.xxhash64("url", "digest").alias("__row"), "digest", refers.alias("refers_to")).distinct()


def _archive(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            rows: list[tuple] = []
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = _Writer(folder, f"pages-{TaskContext.get().partitionId():06d}.warc.gz")
                payload = (html or "").encode()
                offset, length = out.write(record(page_id, url, digest, len(payload), refers_to, payload))
                rows.append((capture_key(url, page_id), page_id, out.part, offset, length))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "page_id", "part", "offset", "length"])
        if out:
            out.close()

    return run


def _index(folder: str):
    """Sorted captures of one range to a file of blocks and its directory; returns the top list's line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"captures-{TaskContext.get().partitionId():06d}"
        blocks = directory = None
        lines: list[str] = []
        first = None

        def flush() -> None:
            nonlocal first
            offset, length = blocks.write(gzip.compress("\n".join(lines).encode(), 6, mtime=0))
            key = lines[0].split("\t", 1)[0]
            directory.write(f"{key}\t{offset}\t{length}\n".encode())
            first = first or key
            lines.clear()

        for batch in batches:
            for key, _, part, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if blocks is None:
                    blocks, directory = _Writer(folder, f"{name}.blocks"), _Writer(folder, f"{name}.directory")
                lines.append(f"{key}\t{part}\t{offset}\t{length}")
                if len(lines) == BLOCK:
                    flush()
        if blocks is not None:
            if lines:
                flush()
            blocks.close()
            directory.close()
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([name])], names=["first", "name"])

    return run


def write_archives(pages: DataFrame, folder: str) -> list[tuple[str, str]]:
    """Writes pages(page_id, url, html) as archives with their index into folder. Returns the top list: first key and name of
    each part of the index, one a range partition."""
    spark = pages.sparkSession
    text_batches(spark, 128)
    n = shuffle_partitions(spark)
    folder = _tidy(folder)
    plan = written(plan_records(pages), "plan")
    payload = F.coalesce("html", F.lit(""))
    keyed = pages.withColumn("__own", F.xxhash64("url", F.sha2(payload, 256)))
    rows = keyed.join(plan, F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__row"))).select("page_id", "url", "html", "digest", "refers_to")
    captures = written(rows.mapInArrow(_archive(f"{folder}/archives"), _INDEX), "captures")
    ordered = captures.repartitionByRange(n, "key").sortWithinPartitions("key", "part", "offset")
    top = ordered.mapInArrow(_index(f"{folder}/index"), "first string, name string")
    return sorted((r[0], r[1]) for r in written(top, "top").collect())


class CaptureIndex:
    """Look-ups in archives that write_archives() made."""

    def __init__(self, folder: str, top: list[tuple[str, str]]):
        self.fs, self.root = _store(_tidy(folder))
        self.firsts, self.names = [k for k, _ in top], [n for _, n in top]
        self.open: dict[str, object] = {}
        self.block: tuple[tuple[str, int, int], list[str], list[list[str]]] | None = None

    def _file(self, name: str):
        if name not in self.open:
            if len(self.open) >= 64:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.fs.open_input_file(f"{self.root}/{name}")
        return self.open[name]

    def read(self, name: str, offset: int, length: int) -> bytes:
        file = self._file(name)
        file.seek(offset)
        return file.read(length)

    def _line(self, name: str, at: int, size: int) -> tuple[int, bytes]:
        """The first whole line that begins at or after an offset (0: the first line)."""
        begin, data = max(at - 1, 0), b""
        while True:
            more = self.read(name, begin + len(data), min(1024, size - begin - len(data)))
            data += more
            start = 0 if at == 0 else data.find(b"\n") + 1
            if (at == 0 or start) and (stop := data.find(b"\n", start)) >= 0:
                return begin + start, data[start:stop]
            if not more:
                return size, b""

    def find_block(self, name: str, key: str) -> int | None:
        """Where the directory's line of the last block that begins before a key stands (of the first, if none does): a binary
        search in the sorted file. Captures with the key begin in that block or the next."""
        file = f"index/{name}.directory"
        size = self._file(file).size()
        low, high, best = 0, size, 0
        while low < high:
            middle = (low + high) // 2
            at, line = self._line(file, middle, size)
            if not line or line.split(b"\t", 1)[0].decode() >= key:
                high = middle
            else:
                best, low = at, at + len(line) + 1
        return best if size else None

    def _load(self, name: str, at: int) -> None:
        """Reads the block whose directory line stands at an offset, unless it is the one held."""
        if self.block and self.block[0][:2] == (name, at):
            return
        file = f"index/{name}.directory"
        at, line = self._line(file, at, self._file(file).size())
        _, offset, length = line.decode().rsplit("\t", 2)
        lines = [x.split("\t") for x in gzip.decompress(self.read(f"index/{name}.blocks", int(offset), int(length))).decode().split("\n")]
        self.block = ((name, at, at + len(line) + 1), [x[0] for x in lines], lines)

    def find(self, key: str) -> list[tuple[str, int, int]]:
        """Archive, offset and length of every capture with the key, over blocks and parts that share it."""
        part = max(bisect_left(self.firsts, key) - 1, 0)
        out: list[tuple[str, int, int]] = []
        while part < len(self.firsts) and self.firsts[part] <= key:
            name = self.names[part]
            size = self._file(f"index/{name}.directory").size()
            held = self.block and self.block[0][0] == name and self.block[1][0] < key <= self.block[1][-1]
            at = self.block[0][1] if held else self.find_block(name, key)
            while at is not None and at < size:
                self._load(name, at)
                keys, lines = self.block[1], self.block[2]
                out += [(x[1], int(x[2]), int(x[3])) for x in lines[bisect_left(keys, key) : bisect_right(keys, key)]]
                if keys[-1] > key:
                    return out
                at = self.block[0][2]
            part += 1
        return out

    def record(self, part: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
        return parse(self.read(f"archives/{part}", offset, length))


def look_up(queries: DataFrame, folder: str, top: list[tuple[str, str]]) -> DataFrame:
    """Records of queries(page_id, url), read back from the archives: page_id, url, payload (of responses), payload_bytes,
    payload_digest, record_type, refers_to. A response's payload is checked against its digest. A page that stands there
    several times is found so often for each distinct query."""
    folder = _tidy(folder)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([capture_key(u, i) for i, u in zip(*(c.to_pylist() for c in batch.columns), strict=True)], pa.string())], names=["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CaptureIndex(folder, top)
        for batch in batches:
            rows: list[tuple] = []
            for key in batch.column(0).to_pylist():
                for place in index.find(key):
                    head, payload = index.record(*place)
                    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"damaged record: {place}")
                    rows.append((_page(head["WARC-Record-ID"]), head["WARC-Target-URI"], payload if kind == "response" else None, int(head["X-Payload-Length"]), digest, kind, _page(head.get("WARC-Refers-To"))))
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
            names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True)], names=names)

    wanted = queries.select("page_id", "url").mapInArrow(keys, "key string").distinct()
    wanted = wanted.repartitionByRange(shuffle_partitions(queries.sparkSession), "key").sortWithinPartitions("key")
    return wanted.mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = scratch_path(spark, "warc")
    top = write_archives(pages, folder)
    return look_up(pages, folder, top).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS size FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE size >= 100 GROUP BY digest)
SELECT page_id, size::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN size >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN size >= 100 AND page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (digest)
"""
