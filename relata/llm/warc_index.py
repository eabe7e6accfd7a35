"""WARC archives and a globally ordered index of their captures by external merging.

Writing: equal payloads of at least `min_revisit` bytes are stored once; the
others become revisit records that refer to the stored one. Each task streams its
records to gzip members of archive files of bounded size in the shared folder. A
file has a name of its own per attempt, and only files in the manifest, which is
written when tasks succeed, are ever read: a lost executor leaves at most an
unlisted file.

Indexing: each archive is read back record by record, digests are verified, and
its captures make one run, sorted by URL key, timestamp and page. The runs are
cut at common splitters, so that each range is small enough for one task, and in
each range a loser tree merges the runs' parts: ranges in order, and captures in
order inside them, give the global order. A URL with very many captures is split
between ranges, as the page is part of the key.

Defined results: null payloads are empty, null URLs have an empty key and come
first; a null page refers to nothing, is a response, and comes first among its
equals; of repeated rows with the largest page_id all are responses; rows with
equal page_id and payload are equal captures in any order; negative pages were
captured before page 0, and times stay within the years 1 to 9999; a very long
payload is in memory a few times, as text, record and member; an empty table gives
no archive and no row; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relata.llm.frames import split_join, table
from relata.session import scratch_path, written

MIN_REVISIT = 1000
FILE_BYTES = 64 << 20
#: Captures that one task merges, about.
RANGE_ROWS = 50_000
#: Time of capture of page 0; pages carry no time, so page n counts as captured n seconds later, or before if n is negative.
FIRST_CAPTURE = datetime(2020, 1, 1, tzinfo=UTC)
#: Seconds from there to the first and the last that a date can have, in the years 1 and 9999; times beyond stay there.
EARLIEST = int((datetime(1, 1, 1, tzinfo=UTC) - FIRST_CAPTURE).total_seconds())
LATEST = int((datetime(9999, 12, 31, 23, 59, 59, tzinfo=UTC) - FIRST_CAPTURE).total_seconds())
LEVEL = 4

CAPTURES = "urlkey string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, run string, offset long, length long"
_COLUMNS = [x.split()[0] for x in CAPTURES.split(", ")]
_TYPES = {"string": pa.string(), "long": pa.int64()}


def url_key(url: str) -> str:
    """A sort key that keeps the pages of a host and its subdomains together: host labels reversed, then the rest."""
    if "://" not in url:
        return url
    rest = url.split("://", 1)[1].split("#", 1)[0]
    cut = min((k for k in (rest.find(c) for c in "/?") if k >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + (rest[cut:] or "/")


def capture_time(page_id: int | None) -> str:
    seconds = min(max(page_id or 0, EARLIEST), LATEST)
    return (FIRST_CAPTURE + timedelta(seconds=seconds)).isoformat(timespec="seconds").replace("+00:00", "Z")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    digest = hashlib.sha1(payload).digest()
    name = lambda p: f"<urn:x-page:{p}>" if p is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest.hex())}>"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {capture_time(page_id)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The capture of one record; raises ValueError where length or digest do not fit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("the block has another length")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    told = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    length = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
    page = lambda v: int(v[len("<urn:x-page:") : -1]) if v and v.startswith("<urn:x-page:") else None
    if fields["WARC-Type"] == "response":
        if hashlib.sha1(payload).hexdigest() != told or len(payload) != length:
            raise ValueError("the payload has another digest or length")
    url = fields.get("WARC-Target-URI")
    url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%") if url is not None else ""
    return {
        "urlkey": url_key(url),
        "captured": "".join(c for c in fields["WARC-Date"] if c.isdigit()),
        "page_id": page(fields["WARC-Record-ID"]),
        "payload_bytes": length,
        "payload_digest": told,
        "record_type": fields["WARC-Type"],
        "refers_to": page(fields.get("WARC-Refers-To")),
    }


class Archive:
    """Writes records as gzip members to files of about FILE_BYTES."""

    def __init__(self, folder: str, level: int = LEVEL):
        self.store, self.path = fs.FileSystem.from_uri(folder)
        self.level, self.files, self.out = level, [], None

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.store.create_dir(self.path, recursive=True)
            self.name = f"{uuid.uuid4().hex}.warc.gz"
            self.out, self.records, self.bytes = self.store.open_output_stream(f"{self.path}/{self.name}", compression=None), 0, 0
        pack = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        member = pack.compress(data) + pack.flush()
        self.out.write(member)
        self.records += 1
        self.bytes += len(member)
        if self.bytes >= FILE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.files.append((self.name, self.records, self.bytes))
            self.out = None


def members(folder: str, name: str, piece: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member of an archive, read as a stream."""
    store, path = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
        begin, data, ended = 0, b"", False
        unpack, parts, used = zlib.decompressobj(31), [], 0
        while True:
            if not data:
                data = stream.read(piece)
                ended = not data
                if ended:
                    break
            parts.append(unpack.decompress(data))
            rest = unpack.unused_data
            used += len(data) - len(rest)
            data = rest
            if unpack.eof:
                yield begin, used, b"".join(parts)
                begin += used
                unpack, parts, used = zlib.decompressobj(31), [], 0
        if used:
            raise ValueError(f"{name} ends within a record")


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so the next winner costs one path to the root."""

    def __init__(self, heads: list, advance: Callable[[int], object]):
        """heads: the first key of each run; advance(run): its next key, or None at its end."""
        self.n, self.keys, self.advance = len(heads), list(heads), advance
        self.losers = [-1] * max(1, self.n)
        self.winner = self._play(1) if self.n > 1 else (0 if self.n else -1)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _play(self, node: int) -> int:
        if node >= self.n:
            return node - self.n
        a, b = self._play(2 * node), self._play(2 * node + 1)
        winner, loser = (a, b) if self._less(a, b) else (b, a)
        self.losers[node] = loser
        return winner

    def pop(self) -> int:
        """The run whose head is least, which is then advanced; -1 when all runs have ended."""
        run = self.winner
        if run < 0 or self.keys[run] is None:
            return -1
        self.keys[run] = self.advance(run)
        winner, node = run, (run + self.n) // 2
        while node >= 1 and self.n > 1:
            if self._less(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.winner = winner
        return run


def sort_key(urlkey: str | None, captured: str | None, page_id: int | None) -> tuple:
    return urlkey or "", captured or "", page_id is not None, page_id or 0


def merge_runs(keys: list[tuple], bounds: list[int]) -> list[int]:
    """The order of all rows, given the sorted runs keys[bounds[r]:bounds[r + 1]]."""
    at = list(bounds[:-1])

    def advance(run: int):
        at[run] += 1
        return keys[at[run]] if at[run] < bounds[run + 1] else None

    tree = LoserTree([keys[b] for b in at], advance)
    order = []
    while True:
        now = tree.winner
        row = at[now] if now >= 0 else 0
        if tree.pop() < 0:
            return order
        order.append(row)


def revisits(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, digest, refers_to) of the rows that another stores the payload of."""
    long = pages.select("page_id", F.encode("html", "utf-8").alias("b")).where(F.octet_length("b") >= min_revisit).select("page_id", F.sha1("b").alias("digest"))
    long = written(long, "digests")
    shared = written(long.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1"), "shared")
    return split_join(long, shared, "digest", "n").where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Writes all pages (page_id, url, html); the manifest (name, records, bytes)."""
    known = written(revisits(pages, min_revisit), "revisits")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    if not known.isEmpty():
        digest = F.when(F.octet_length("html") >= min_revisit, F.sha1(F.encode("html", "utf-8")))
        # rows that can refer to nothing are dealt by their URL
        free = F.col("page_id").isNull() | F.col("digest").isNull()
        marked = rows.withColumn("digest", digest).withColumn("digest", F.when(free, F.concat(F.lit("-"), F.xxhash64("url").cast("string"))).otherwise(F.col("digest")))
        rows = marked.join(known, ["page_id", "digest"], "left")
    else:
        rows = rows.withColumn("refers_to", F.lit(None).cast("long"))
    rows = rows.select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = Archive(folder)
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                archive.add(record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to))
        archive.close()
        if archive.files:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*archive.files)], names=["name", "records", "bytes"])

    return written(rows.mapInArrow(run, "name string, records long, bytes long"), "manifest")


def runs_of(manifest: DataFrame, folder: str) -> DataFrame:
    """A sorted run of captures for each archive in the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = [parse(data) | {"run": name, "offset": offset, "length": length} for offset, length, data in members(folder, name)]
                if len(found) != expected:
                    raise ValueError(f"{name} has {len(found)} records and not {expected}")
                found.sort(key=lambda c: sort_key(c["urlkey"], c["captured"], c["page_id"]))
                kinds = [_TYPES[x.split()[1]] for x in CAPTURES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([c[n] for c in found], t) for n, t in zip(_COLUMNS, kinds)], names=_COLUMNS)

    n = max(1, manifest.count())
    return written(manifest.select("name", "records").repartition(n, "name").mapInArrow(run, CAPTURES), "runs")


def merged(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures in global order: by range, then by place."""
    key = ["urlkey", "captured", "page_id"]
    n = max(1, -(-runs.count() // range_rows))
    ranges = runs.repartitionByRange(n, *key) if n > 1 else runs.repartition(1)
    parts = ranges.withColumn("range", F.spark_partition_id()).sortWithinPartitions("run", *key)
    schema = runs.sparkSession.createDataFrame([], f"{CAPTURES}, range int, place long").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        keys = [sort_key(*k) for k in zip(*(rows.column(c).to_pylist() for c in key))]
        names = rows.column("run").to_pylist()
        bounds = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        rows = rows.take(pa.array(merge_runs(keys, bounds)))
        rows = rows.append_column("place", pa.array(range(rows.num_rows), pa.int64()))
        yield from rows.combine_chunks().to_batches()

    return parts.mapInArrow(run, schema)


def archive_and_index(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Writes the archives of pages to folder, reads them back, and gives their captures in order."""
    manifest = write_archives(pages, folder, min_revisit)
    return merged(runs_of(manifest, folder), range_rows)


def ranked(captures: DataFrame) -> DataFrame:
    """Written merged captures with `capture_rank`, the place of each in the whole index from 1 on."""
    sizes = captures.groupBy("range").count()
    before = Window.partitionBy(F.lit(1)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    return captures.join(offsets, "range").withColumn("capture_rank", F.col("before") + F.col("place") + 1).drop("before")


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = written(archive_and_index(table(spark, sf_dir, "pages"), scratch_path(spark, "warc")), "captures")
    return ranked(captures).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured", "capture_rank")


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n,
         coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS cut
  FROM pages
),
parts AS (SELECT *, split_part(substr(url, cut + 3), '#', 1) AS rest FROM p),
keys AS (
  SELECT *, regexp_extract(rest, '^[^/?]*') AS host FROM parts
),
rows AS (
  SELECT page_id, html, n,
         CASE WHEN cut = 0 THEN url ELSE array_to_string(list_reverse(string_split(lower(host), '.')), ',') || ')' ||
           CASE WHEN length(host) = length(rest) THEN '/' ELSE substr(rest, length(host) + 1) END END AS urlkey,
         strftime(TIMESTAMP '2020-01-01' + to_seconds(coalesce(page_id, 0)), '%Y%m%d%H%M%S') AS captured,
         CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS kept
  FROM keys
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN page_id < kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < kept THEN kept END AS refers_to, urlkey, captured,
       row_number() OVER (ORDER BY urlkey, captured, page_id) AS capture_rank
FROM rows
"""
