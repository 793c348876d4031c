"""WARC archives with a two-level capture index.

write: every task writes the captures that it reads as one archive (a gzip member per record). Captures with equal
payloads (at least `min_bytes`) are one response, that with the largest id, and revisits that refer to it.
index: captures are range-partitioned and sorted by (reversed-host URL key, id); each partition is an index shard of
compressed blocks of BLOCK captures. Level two is the shard's directory, a row for each block with its first key; level one is
the list of shards with their first keys, bounded by the number of partitions.
lookup: a task sorts its keys, finds shard and block by binary search, range-reads and unpacks the block, finds
the capture by binary search, and range-reads the record. A lookup never scans an archive.

Files go to a folder that all nodes share, under names of their own for every attempt; an attempt counts only
through the rows that it returned, so retried or lost tasks leave unused files and nothing wrong.

Edge cases: a null html is an empty payload; a null or odd URL has its text (or the empty key) as key; equal URLs are
told apart by id; null ids are carried as -1 only inside keys. Repeated rows are captured once each and read alike.
"""
from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactflow.llm.common import run_dir, written

BLOCK, OPEN_FILES = 512, 64
URL_SAFE = "%:/?#[]@!$&'()*+,;=-._~"  # fixed value: what a URL may hold as it is, beside letters and digits
CAPTURE = "page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long, file string, at long, size long"


def surt(url: str | None) -> str:
    """Reversed-host key of a URL: 'http://www.a.example/x?q' gives 'example,a,www)/x?q'."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url
    if not host:
        return url
    name = ",".join(reversed(host.lower().rstrip(".").split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{name}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "") + (f"#{parts.fragment}" if parts.fragment else "")


def key_of(url: str | None, page_id: int | None) -> str:
    """Sort key of a capture: URL key, then id in fixed width; 0x01 sorts below all URL characters."""
    return f"{surt(url)}\x01{(-1 if page_id is None else int(page_id)) + (1 << 63):020d}"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _open(folder: str):
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


def record(page_id: int | None, url: str | None, kind: str, refers: int | None, payload: bytes, checksum: str) -> bytes:
    """One WARC/1.1 record as a gzip member: HTTP header and payload; a revisit has the header alone, and its payload's digest and length."""
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:capture:{page_id}>", f"WARC-Target-URI: {quote(url or '', safe=URL_SAFE, errors='replace')}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{checksum}", f"WARC-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:capture:{refers}>"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = "\r\n".join([*lines, "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]).encode()
    return gzip.compress(head + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=6, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """WARC header fields and payload of a record."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


def roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages with `_refers`: null for a response, else the id of the capture with the same payload and the largest id."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keyed = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("_sum"), F.octet_length(payload).alias("_n"))
    same = keyed.filter(F.col("_n") >= min_bytes).groupBy("_sum").agg(F.max("page_id").alias("_top"), F.count(F.lit(1)).alias("_c")).filter("_c > 1")
    same = written(same.select("_sum", "_top"), "equal-payloads")
    out = keyed.join(same, "_sum", "left")
    again = F.col("_top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_top")) & (F.col("_n") >= min_bytes)
    return out.select("page_id", "url", "html", F.when(again, F.col("_top")).alias("_refers"))


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes archives and returns the captures: where each record lies, with its digest."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        name, at, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        for frame in frames:
            rows = []
            for page, url, html, refers in zip(frame["page_id"], frame["url"], frame["html"], frame["_refers"], strict=True):
                page, refers = (None if pd.isna(x) else int(x) for x in (page, refers))
                url = None if pd.isna(url) else url
                payload = "" if pd.isna(html) else html
                payload = payload.encode("utf-8", "surrogatepass")
                checksum, kind = digest(payload), "response" if refers is None else "revisit"
                member = record(page, url, kind, refers, payload, checksum)
                out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                out.write(member)
                rows.append((page, url, checksum, len(payload), kind, refers, name, at, len(member)))
                at += len(member)
            yield _frame(rows, ["page_id", "url", "payload_digest", "payload_bytes", "record_type", "refers_to", "file", "at", "size"])
        if out:
            out.close()

    return roles(pages, min_bytes).mapInPandas(run, CAPTURE)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """Integers stay integers beside nulls."""
    frame = pd.DataFrame(rows, columns=columns, dtype=object)
    for c in {"page_id", "refers_to", "payload_bytes", "at", "size", "rows", "shard"} & set(columns):
        frame[c] = frame[c].astype("Int64")
    return frame


def index(captures: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """Writes index shards and returns the block directory: shard, first key, file, at, size, rows."""
    kind = F.pandas_udf("string")(_keys)
    keyed = captures.withColumn("key", kind("url", "page_id"))
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.repartitionByRange(parts, "key", "file", "at").sortWithinPartitions("key", "file", "at")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.idx"
        at, out, lines, first, rows = 0, None, [], "", []

        def flush() -> None:
            nonlocal at, out, lines
            data = zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"), 6)
            out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
            out.write(data)
            rows.append((name, first, at, len(data), len(lines)))
            at, lines = at + len(data), []

        for frame in frames:
            for key, file, start, size in zip(frame["key"], frame["file"], frame["at"], frame["size"], strict=True):
                first = first if lines else key
                lines.append(json.dumps([key, file, int(start), int(size)]))
                if len(lines) >= block:
                    flush()
        if lines:
            flush()
        if out:
            out.close()
        yield _frame(rows, ["file", "first", "at", "size", "rows"])

    return ranged.select("key", "file", "at", "size").mapInPandas(run, "file string, first string, at long, size long, rows long")


def _keys(url: pd.Series, page_id: pd.Series) -> pd.Series:
    return pd.Series([key_of(None if pd.isna(u) else u, None if pd.isna(p) else int(p)) for u, p in zip(url, page_id, strict=True)], dtype=object)


class Reader:
    """Lookups in index shards and archives; shards: first keys and directory of every shard, sorted."""

    def __init__(self, folder: str, shards: list[tuple[str, str]], directory: str):
        self.fs, self.root = _open(folder)
        self.firsts, self.files = [s[0] for s in shards], [s[1] for s in shards]
        self.directory, self.shard, self.block = directory, (None, []), (None, [])
        self.archives: dict[str, object] = {}

    def _read(self, name: str, at: int, size: int) -> bytes:
        if name not in self.archives:
            if len(self.archives) >= OPEN_FILES:
                self.archives.pop(next(iter(self.archives))).close()
            self.archives[name] = self.fs.open_input_file(f"{self.root}/{name}")
        return self.archives[name].read_at(size, at)

    def _blocks(self, file: str) -> list[tuple[str, int, int]]:
        """The directory of one shard (kept while keys stay in it)."""
        if self.shard[0] != file:
            import pyarrow.parquet as pq

            fs, root = _open(self.directory)
            found = pq.read_table(f"{root}/", filesystem=fs, filters=[("file", "=", file)], columns=["first", "at", "size"]).to_pylist()
            self.shard = file, sorted((x["first"], x["at"], x["size"]) for x in found)
        return self.shard[1]

    def find(self, key: str) -> list[tuple[str, int, int]]:
        """Every capture (file, at, size) of a key; equal keys may run on into later blocks and shards."""
        out = []
        s = max(0, bisect_left(self.firsts, key) - 1)
        while s < len(self.firsts) and self.firsts[s] <= key:
            blocks = self._blocks(self.files[s])
            b = max(0, bisect_left(blocks, key, key=lambda x: x[0]) - 1)
            while b < len(blocks) and blocks[b][0] <= key:
                name = (self.files[s], blocks[b][1])
                if self.block[0] != name:
                    data = zlib.decompress(self._index(*name, blocks[b][2]))
                    self.block = name, [json.loads(x) for x in data.decode("utf-8", "surrogatepass").split("\n")]
                rows = self.block[1]
                lo, hi = bisect_left(rows, key, key=lambda x: x[0]), bisect_right(rows, key, key=lambda x: x[0])
                out += [tuple(x[1:]) for x in rows[lo:hi]]
                if hi < len(rows):
                    return out
                b += 1
            s += 1
        return out

    def _index(self, file: str, at: int, size: int) -> bytes:
        with self.fs.open_input_file(f"{self.root}/{file}") as f:
            return f.read_at(size, at)

    def capture(self, file: str, at: int, size: int) -> tuple[dict[str, str], bytes]:
        return parse(self._read(file, at, size))


def lookup(keys: DataFrame, folder: str, directory: str) -> DataFrame:
    """Reads back the captures of (page_id, url) rows; the payload of a response is checked against its digest."""
    spark = keys.sparkSession
    shards = spark.read.parquet(directory).groupBy("file").agg(F.min("first").alias("first")).orderBy("first", "file").collect()  # one row for each shard
    shards = [(r["first"], r["file"]) for r in shards]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(folder, shards, directory)
        for frame in frames:
            wanted = sorted(set(zip(_keys(frame["url"], frame["page_id"]), (None if pd.isna(x) else int(x) for x in frame["page_id"]), (None if pd.isna(x) else x for x in frame["url"]), strict=True)), key=lambda x: x[0])
            rows = []
            for key, page, url in wanted:
                for file, at, size in reader.find(key):
                    head, payload = reader.capture(file, at, size)
                    checksum, n = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["WARC-Payload-Length"])
                    refers = head.get("WARC-Refers-To")
                    if refers is None and (digest(payload), len(payload)) != (checksum, n):
                        raise ValueError(f"record at {file}:{at} differs from its digest")
                    rows.append((page, url, checksum, n, head["WARC-Type"], None if refers is None else int(refers[13:-1]), file, at, size))
            yield _frame(rows, ["page_id", "url", "payload_digest", "payload_bytes", "record_type", "refers_to", "file", "at", "size"])

    keyed = keys.select("page_id", "url", F.pandas_udf("string")(_keys)("url", "page_id").alias("key"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInPandas(run, CAPTURE)  # neighbours share blocks


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archives all pages, indexes them, and reads every page back by its key."""
    spark: SparkSession = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long"), "url", "html")
    folder, directory = run_dir(spark, "warc"), run_dir(spark, "warc-directory")
    captures = written(write(pages, folder, min_bytes), "captures")
    index(captures, folder).write.parquet(directory)
    return lookup(captures.select("page_id", "url").distinct(), folder, directory)
