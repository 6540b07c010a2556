"""WARC archives with a two-level capture index.

Pages are written as WARC records, one gzip member each, so that a record can
be read by its byte range. Equal payloads are stored once: later captures are
revisit records that name the first. The capture index sorts reversed-host URL
keys into compressed blocks; beside each index file lies a sparse directory
with the first key of each block. A lookup picks the index file by its first
key, binary-searches the directory, reads one block by range, binary-searches
that, and reads the record by range. No file is ever read whole.

Archives and indexes go to the folder that driver and executors share. Each
attempt of a task writes files of new names, and only those of finished tasks
are named in the tables, so lost executors and repeated attempts do no harm.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import quote, urlsplit

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, owned, partitions, saved, scratch, shared_dir, table

#: Payloads shorter than this are never stored as revisits.
LEAST_REVISIT = 100
#: Index lines in a block, and bytes after which a task starts another archive.
BLOCK_LINES, ARCHIVE_BYTES = 512, 1 << 30
_NO_ID = -(1 << 63)
_EMPTY = hashlib.sha256(b"").hexdigest()


def url_key(url: str | None) -> str:
    """Reversed-host key: lower-case host labels from the last to the first, then path and query; "" for null."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/")
    return key + (f"?{parts.query}" if parts.query else "")


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _uri(url: str) -> str:
    """A URL as a header can hold it: spaces, control characters and all beyond ASCII as percent escapes."""
    return quote(url, safe="".join(map(chr, range(0x21, 0x7F))))


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, name: str, refers_to: int | None, refers_url: str | None) -> bytes:
    """One record as a gzip member; payload None makes a revisit. `name` (its file and place) makes the record's id.

    A null URL has no target header. What the index is asked for, the pages' ids
    and the key of the record that is revisited, stands in X- headers.
    """
    head = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers_to}", "X-Refers-To-Key: " + json.dumps(url_key(refers_url))]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_uri(refers_url)}")
    body = payload or b""
    return gzip.compress("\r\n".join([*head, "Content-Type: text/html", f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n", 1, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = gzip.decompress(member).partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields, body[: int(fields["Content-Length"])]


def marked(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, size, first, first_url: of equal payloads of LEAST_REVISIT bytes or more, the smallest page_id."""
    own = pages.select("page_id", "url", "html", F.coalesce("page_id", F.lit(_NO_ID)).alias("pid"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("size"))
    # repeated payloads only; counted with partial sums, so a very common payload is no hot task
    often = own.where(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("head"), F.count("*").alias("n")).where("n > 1").select("digest", F.col("head.page_id").alias("first"), F.col("head.url").alias("first_url"))
    # payloads meet their page, not all pages of their digest, so a very common one is no hot task
    first = saved(own.select("pid", "digest").distinct().join(saved(often), "digest"))
    return own.join(first, ["pid", "digest"], "left").drop("pid")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record for each row of `pages`; returns the captures: key, page_id, file, at, size."""

    def rows(each: Iterator[dict]) -> Iterator[tuple]:
        out, at, name = None, 0, ""
        fs, base = _fs(folder)
        fs.create_dir(base, recursive=True)
        for r in each:
            if out is None or at >= ARCHIVE_BYTES:
                if out:
                    out.close()
                name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
            again = r["first"] is not None and r["page_id"] != r["first"]
            member = record(r["page_id"], r["url"], None if again else (r["html"] or "").encode(), r["digest"], f"{name}/{at}", r["first"], r["first_url"])
            out.write(member)
            yield url_key(r["url"]), r["page_id"], name, at, len(member)
            at += len(member)
        if out:
            out.close()

    return mapped(marked(pages), "key string, page_id long, file string, at long, size long", rows)


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sorts captures by key into index files of compressed blocks, each with a directory file beside it; returns file and first (key, page_id)."""

    def rows(each: Iterator[dict]) -> Iterator[tuple]:
        fs, base = _fs(folder)
        fs.create_dir(base, recursive=True)
        out, name, at, block, first = None, uuid.uuid4().hex, 0, [], None
        directory = None

        def flush() -> None:
            nonlocal at, block
            data = zlib.compress("\n".join(json.dumps(x) for x in block).encode(), 6)
            out.write(data)
            directory.write((json.dumps([*block[0][:2], at, len(data)]) + "\n").encode())
            at, block = at + len(data), []

        for r in each:
            if out is None:
                out, directory = fs.open_output_stream(f"{base}/{name}.cdx", compression=None), fs.open_output_stream(f"{base}/{name}.dir", compression=None)
            line = [r["key"], _NO_ID if r["page_id"] is None else r["page_id"], r["file"], r["at"], r["size"]]
            first = first or line
            # captures of one key and page stay in one block
            if len(block) >= block_lines and line[:2] != block[-1][:2]:
                flush()
            block.append(line)
        if out:
            flush()
            out.close()
            directory.close()
            yield name, first[0], first[1]

    n = max(1, partitions(captures.sparkSession))
    order = ["key", F.coalesce("page_id", F.lit(_NO_ID))]
    return mapped(captures.repartitionByRange(n, *order).sortWithinPartitions(*order), "file string, key string, page_id long", rows)


class Archive:
    """Lookups by (key, page_id); `shards` lists the index files in key order, as (key, page_id, file)."""

    def __init__(self, folder: str, shards: list[tuple[str, int, str]]):
        self.fs, self.base = _fs(folder)
        self.bounds, self.shards = [s[:2] for s in shards], [s[2] for s in shards]
        self.directory, self.block, self.payload = lru_cache(4)(self._directory), lru_cache(8)(self._block), lru_cache(16)(self._payload)
        self.open = lru_cache(16)(lambda name: self.fs.open_input_file(f"{self.base}/{name}"))

    def _range(self, name: str, at: int, size: int) -> bytes:
        f = self.open(name)
        f.seek(at)
        return f.read(size)

    def _directory(self, shard: str) -> tuple[list, list]:
        with self.fs.open_input_stream(f"{self.base}/{shard}.dir", compression=None) as f:
            lines = [json.loads(x) for x in f.read().decode().splitlines()]
        return [tuple(x[:2]) for x in lines], lines

    def _block(self, shard: str, at: int, size: int) -> tuple[list, list]:
        lines = [json.loads(x) for x in zlib.decompress(self._range(f"{shard}.cdx", at, size)).decode().split("\n")]
        return [tuple(x[:2]) for x in lines], lines

    def captures(self, key: str, page_id: int | None) -> list[tuple[str, int, int]]:
        """(file, at, size) of every capture of the page."""
        wanted = (key, _NO_ID if page_id is None else page_id)
        shard = bisect_right(self.bounds, wanted) - 1
        if shard < 0:
            return []
        firsts, blocks = self.directory(self.shards[shard])
        k = bisect_right(firsts, wanted) - 1
        if k < 0:
            return []
        keys, lines = self.block(self.shards[shard], *blocks[k][2:])
        return [tuple(x[2:]) for x in lines[bisect_left(keys, wanted) : bisect_right(keys, wanted)]]

    def read(self, capture: tuple[str, int, int]) -> tuple[dict[str, str], bytes]:
        return parse(self._range(*capture))

    def _payload(self, key: str, page_id: int) -> tuple[int, str]:
        """Size and digest of the payload that a revisit names."""
        for c in self.captures(json.loads(key), page_id):
            fields, body = self.read(c)
            if fields["WARC-Type"] == "response":
                return len(body), hashlib.sha256(body).hexdigest()
        raise ValueError(f"page {page_id} has no response record")


def read_back(pages: DataFrame, folder: str, shards: list[tuple[str, int, str]]) -> DataFrame:
    """The captures of the given pages, each looked up by its key and read from its archive."""

    def keyed(each: Iterator[dict]) -> Iterator[tuple]:
        for r in each:
            yield url_key(r["url"]), r["page_id"]

    def rows(each: Iterator[dict]) -> Iterator[tuple]:
        archive = Archive(folder, shards)
        for r in each:
            for c in archive.captures(r["key"], r["page_id"]):
                fields, body = archive.read(c)
                if fields["WARC-Type"] == "response":
                    yield r["page_id"], len(body), hashlib.sha256(body).hexdigest() if body else _EMPTY, "response", None
                else:
                    first = int(fields["X-Refers-To-Page-Id"])
                    size, digest = archive.payload(fields["X-Refers-To-Key"], first)
                    if f"sha256:{digest}" != fields["WARC-Payload-Digest"]:
                        raise ValueError(f"the payload of page {first} is not the one that was revisited")
                    yield r["page_id"], size, digest, "revisit", first

    keys = mapped(pages.select("page_id", "url"), "key string, page_id long", keyed).distinct()
    sorted_keys = keys.repartitionByRange(max(1, partitions(pages.sparkSession)), "key", "page_id").sortWithinPartitions("key", "page_id")
    return mapped(sorted_keys, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long", rows)


def round_trip(pages: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Archives every row of `pages` (page_id, url, html), then looks every page up and reads its record.

    Null html is an empty payload, a null URL has the key "". Repeated rows get
    a record each and come back as often. A null page_id is archived and never
    referred to. Columns other than the three are not read; an empty table
    gives no rows.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    with scratch(spark):
        owned(spark, folder, outlives=True)
        captures = saved(write_archives(pages.select("page_id", "url", "html"), folder))
        # one row for each index file, and there are as many as shuffle partitions at most
        shards = sorted((r.key, r.page_id, r.file) for r in saved(write_index(captures, folder, block_lines)).collect())
    return read_back(pages, folder, shards)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
