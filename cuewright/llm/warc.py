"""WARC archives with a two-level capture index.

Pages are written as gzip members, one a record, to archive files in the shared
folder. The index sorts captures by reversed-host URL key, packs them into
compressed blocks, and a sparse directory keeps each block's first key and place.
A lookup binary-searches the directory, reads one block's byte range,
binary-searches it, and reads one record's byte range; fetch() does so for a table
of keys.

Files go through pyarrow's file systems, which must know the scheme of
spark.checkpoint.dir. Each task attempt writes files of its own name and only
finished attempts are indexed, so a lost executor leaves at most unused files.

Cases: null html: an empty payload. Null url: an empty target. Null page_id: its
record carries none, and it is a revisit if any page has its payload. Equal
payloads of MIN_REVISIT bytes or more are revisits of the least page_id. Repeated
rows: one record each, all of the same type; responses of a page share an id. Empty table: no files,
empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, stored, table, trim

MIN_REVISIT = 0
BLOCK_LINES = 1000
ARCHIVE_BYTES = 256 << 20
#: Index blocks that a task reads back, about.
READ_BLOCKS = 16
UNSAFE = re.compile("[\x00-\x20\x7f]")
#: Rows of payloads with copies that may be broadcast; more are joined by shuffles.
MAX_BROADCAST_COPIES = 200_000
#: Parts that the rows of one payload are dealt to in that join.
SALTS = 32
CAPTURES = "page_id long, url string, key string, file string, offset long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
DIRECTORY = "key string, last string, file string, offset long, length long, n int"


def url_key(url: str) -> str:
    """The reversed-host key: com,example,www)/path?query, white space and
    control characters escaped, as it is sorted, stored and searched."""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    cut = min((i for i in map(rest.find, "/?") if i >= 0), default=len(rest))
    host, path = rest[:cut].lower().rpartition("@")[2], rest[cut:] or "/"
    name, colon, port = host.partition(":")
    return UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", ",".join(reversed(name.split("."))) + colon + port + ")" + path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    """Of a page's response, so that its revisits can name it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member; a revisit has no payload of its own."""
    digest = digest_of(payload)
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + payload if refers_to is None else http
    url = url.replace("\r", "%0D").replace("\n", "%0A")
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id(page_id, digest) if refers_to is None else f"<urn:uuid:{uuid.uuid4()}>",
        "WARC-Date": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"),
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(body),
        "X-Page-ID": "" if page_id is None else page_id,
    }
    if refers_to is not None:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers_to, digest), "X-Refers-To-Page-ID": refers_to}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + body + b"\r\n\r\n") + packer.flush()


def parsed(member: bytes) -> tuple[dict[str, str], bytes, int]:
    """Header fields, payload, and the payload's length that HTTP tells."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return fields, payload, size


class Store:
    """Byte ranges of files, one file open at a time."""

    def __init__(self) -> None:
        self.name, self.file = "", None

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path != self.name:
            if self.file:
                self.file.close()
            where, inner = fs.FileSystem.from_uri(path)
            self.name, self.file = path, where.open_input_file(inner)
        return self.file.read_at(length, offset)


class Writer:
    """Files of at most about ``most`` bytes in a folder."""

    def __init__(self, folder: str, kind: str, most: int = ARCHIVE_BYTES) -> None:
        self.folder, self.kind, self.most, self.out, self.at = folder, kind, most, None, 0

    def write(self, data: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at >= self.most:
            self.close()
            self.path, self.at = f"{self.folder}/{uuid.uuid4().hex}.{self.kind}.gz", 0
            where, inner = fs.FileSystem.from_uri(self.path)
            where.create_dir(inner.rpartition("/")[0], recursive=True)
            self.out = where.open_output_stream(inner, compression=None)
        self.out.write(data)
        self.at += len(data)
        return self.path, self.at - len(data), len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def numbered(rows: list[tuple], schema: str) -> pd.DataFrame:
    """Rows of a schema whose longs may be null, none of them through a double."""
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    made = pd.DataFrame(rows, columns=list(names), dtype=object)
    return made.assign(**{n: pd.array(made[n].tolist(), "Int64") for n, k in zip(names, kinds, strict=True) if k == "long"})


def write_archives(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, max_broadcast: int = MAX_BROADCAST_COPIES) -> DataFrame:
    """CAPTURES of the records written, stored."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha"))
    first = rows.where(F.octet_length("html") >= min_revisit).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    copies = stored(first.where("n > 1").drop("n"), "copies")
    if copies.count() <= max_broadcast:
        known = rows.join(F.broadcast(copies), "sha", "left")
    else:  # the rows of a payload with many copies go to as many parts
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
        known = salted.join(copies.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["sha", "salt"], "left")
    known = known.select(F.col("page_id").cast("string"), "url", "html", F.col("first").cast("string"))  # pandas has no long with nulls

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archive = Writer(folder, "warc")
        done: list = []
        for batch in batches:
            for page_id, url, html, first in batch.itertuples(index=False, name=None):
                page_id, first = (None if x is None else int(x) for x in (page_id, first))
                place = archive.write(record(page_id, url, html.encode("utf-8", "surrogatepass"), None if first == page_id else first))
                done.append((page_id, url, url_key(url), *place))
            del batch
            trim()
        archive.close()  # before any capture is told of
        yield numbered(done, CAPTURES)

    return stored(known.mapInPandas(written, CAPTURES), "captures")


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """DIRECTORY of the compressed blocks written, stored."""

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, done, lines = Writer(folder, "cdx"), [], []

        def flush() -> None:
            if lines:
                packed = zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"), 3)
                done.append((lines[0].split("\t", 1)[0], lines[-1].split("\t", 1)[0], *index.write(packed), len(lines)))
                lines.clear()

        for batch in batches:
            for page_id, key, file, offset, length in batch.itertuples(index=False, name=None):
                lines.append(f"{key}\t{'-' if page_id is None else page_id}\t{file}\t{offset}\t{length}")
                if len(lines) == block_lines:
                    flush()
        flush()
        index.close()
        yield pd.DataFrame(done, columns=[x.split()[0] for x in DIRECTORY.split(", ")])

    ranged = captures.select("page_id", "key", "file", "offset", "length").repartitionByRange("key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    ranged = ranged.withColumn("page_id", F.col("page_id").cast("string"))
    return stored(ranged.mapInPandas(written, DIRECTORY), "directory")


def block_lines(store: Store, file: str, offset: int, length: int) -> list[list[str]]:
    lines = zlib.decompress(store.read(file, offset, length)).decode("utf-8", "surrogatepass").split("\n")
    return [x.split("\t") for x in lines]


class Index:
    """Binary search in the directory and in its blocks; ``places``: (first key,
    file, offset, length) of the blocks, sorted. The last block read is kept."""

    def __init__(self, places: list[tuple[str, str, int, int]], store: Store | None = None) -> None:
        self.places, self.store, self.at, self.lines, self.keys = places, store or Store(), -1, [], []

    def find(self, key: str) -> Iterator[tuple[str, int, int]]:
        """Places of the records of a key."""
        at = max(0, bisect.bisect_left(self.places, (key,)) - 1)
        while at < len(self.places) and self.places[at][0] <= key:
            if at != self.at:
                self.at, self.lines = at, block_lines(self.store, *self.places[at][1:4])
                self.keys = [x[0] for x in self.lines]
            for x in self.lines[bisect.bisect_left(self.keys, key) : bisect.bisect_right(self.keys, key)]:
                yield x[2], int(x[3]), int(x[4])
            at += 1


def lookup(directory: list[tuple[str, str, int, int]], url: str, store: Store | None = None) -> list[tuple[dict[str, str], bytes]]:
    """The records of a url; ``directory``: (key, file, offset, length) sorted."""
    store = store or Store()
    return [parsed(store.read(*place))[:2] for place in Index(directory, store).find(url_key(url))]


def told(places: list[tuple[str, int, int]]) -> pd.DataFrame:
    """RECORDS at some places, each archive opened once. A revisit's payload is
    told by its header."""
    store, out = Store(), []
    for path, at, size in sorted(places):
        fields, payload, length = parsed(store.read(path, at, size))
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if fields["WARC-Type"] == "response" and (len(payload), digest_of(payload)) != (length, digest):
            raise ValueError(f"damaged record in {path} at {at}")
        ids = [int(x) if (x := fields.get(k, "")) else None for k in ("X-Page-ID", "X-Refers-To-Page-ID")]
        out.append((ids[0], length, digest, fields["WARC-Type"], ids[1]))
    return numbered(out, RECORDS)


def fetch(keys: DataFrame, directory: DataFrame) -> DataFrame:
    """RECORDS of the captures of ``keys`` (key). The sorted directory is cut into
    ranges of READ_BLOCKS blocks or so; a key goes to the ranges that it may be in,
    where a task binary-searches the range's directory, then the block, and reads
    the byte ranges of the records."""
    parts = max(1, directory.count() // READ_BLOCKS)
    cut = directory.repartitionByRange(parts, "key", "file", "offset").withColumn("part", F.spark_partition_id())
    ranges = stored(cut.groupBy("part").agg(F.min("key").alias("low"), F.max("last").alias("high"), F.array_sort(F.collect_list(F.struct("key", "file", "offset", "length"))).alias("places")), "ranges")
    bounds = sorted(tuple(r) for r in ranges.select("low", "high", "part").collect())  # a row for READ_BLOCKS blocks of BLOCK_LINES captures
    shared = directory.sparkSession.sparkContext.broadcast(bounds)

    def located(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bounds = shared.value
        highs = [high for _, high, _ in bounds]  # in order, as the ranges are
        for batch in batches:
            out = []
            for key in batch["key"]:
                at = bisect.bisect_left(highs, key)
                while at < len(bounds) and bounds[at][0] <= key:
                    out.append((bounds[at][2], key))
                    at += 1
            yield pd.DataFrame(out, columns=["part", "key"])

    def read(asked: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
        index = Index([(p["key"], p["file"], int(p["offset"]), int(p["length"])) for x in places["places"] for p in x])
        out = told([place for key in sorted(asked["key"]) for place in index.find(key)])
        trim()
        return out

    asked = keys.select("key").distinct().mapInPandas(located, "part int, key string")
    return asked.groupBy("part").cogroup(ranges.select("part", "places").groupBy("part")).applyInPandas(read, RECORDS)


def read_back(directory: DataFrame) -> DataFrame:
    """RECORDS of all that the index has, block by block."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = Store()
        for batch in batches:
            for place in batch.itertuples(index=False, name=None):
                yield told([(x[2], int(x[3]), int(x[4])) for x in block_lines(store, *place)])
                trim()

    parts = max(1, directory.count() // READ_BLOCKS)
    return directory.select("file", "offset", "length").repartition(parts, "file", "offset").mapInPandas(read, RECORDS)


def archive(pages: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(captures, directory) of the pages written under ``folder``."""
    captures = write_archives(pages, f"{folder}/archives")
    return captures, write_index(captures, f"{folder}/index")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, directory = archive(table(spark, sf_dir, "pages"), shared_path(spark, "warc"))
    return fetch(captures.select("key"), directory)


OP7_SQL = r"""
with p as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as sha from pages
), f as (
  select *, min(page_id) over (partition by sha) as first from p
), d as (
  select *, (select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(sha, 1 + (i * 5) // 4, 2))::int // (1 << (3 - (i * 5) % 4))) % 32, 1), '' order by i) from range(32) t(i)) as digest from f
)
select page_id, strlen(html)::bigint as payload_bytes, digest as payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from d
"""
