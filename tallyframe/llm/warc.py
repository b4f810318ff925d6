"""WARC archives: a Spark data source that writes them in shards and reads them back.

`write_archives` sorts records by page_id, url and payload digest (nulls first) and cuts
that order into shards by the running sum of their sizes, so a shard depends on the rows
and not on how they were partitioned. One task writes a shard: a file is closed when the
next record would take it past the size (compressed) that is asked for. Headers and
digests are made anew; the date is a parameter, record ids come from the key, so the
same rows give the same bytes.

Of records with equal payloads of at least `least_bytes` the one with the largest page_id (then
url, then the first of rows that repeat) is a response, the others are revisits that refer to it;
smaller ones are all responses. Equal payloads are found by SHA-256 on narrow rows: the
payloads are shuffled once, to their shards, and meet what is known of them there.
Rows that repeat in full are counted, not shuffled, and their records may go to several shards.

Each task writes under a name of its own below `_temporary`. When all are done, the files of
the attempts that counted take their final names, then the manifest (names, records, sizes and
SHA-256 of the files) takes its own; an archive without manifest isn't one. The reader takes a
task for each file and checks the file's sum and each record's lengths and digests.

A null html counts as empty. A null url has no target URI; control characters and blanks in one are
written as %XX. A null page_id is smaller than any other; what refers to it has a null
refers_to. Other columns are ignored. An empty table gives an archive of no files.
"""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tallyframe.llm.shared import Scratch, shared_dir

SHARD_BYTES = 32 << 20  # of payload, and OVERHEAD for each record
MOST_SHARDS = 1 << 16  # of larger tables the shards are larger, so that their first keys can be sent to all tasks
FILE_BYTES = 8 << 20  # compressed
OVERHEAD = 512
DATE = "1970-01-01T00:00:00Z"

MANIFEST, TEMPORARY = "manifest.jsonl", "_temporary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

KEY = ["page_id", "url", "digest"]
COLUMNS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


# ---- records


def _record_id(page_id: int | None, url: str | None, digest: str, copy: int) -> str:
    at = hashlib.sha256(f"{url or ''}\0{digest}".encode()).hexdigest()[:20]
    return f"<urn:x-page:{'null' if page_id is None else page_id}:{at}:{copy}>"


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def _page_record(date: str, page_id: int | None, url: str | None, digest: str, copy: int, sha1: bytes, size: int, payload: bytes | None, target: tuple | None) -> bytes:
    """A response if there is a payload, else a revisit of target (page_id, url)."""
    headers = [("WARC-Type", "revisit" if payload is None else "response"), ("WARC-Record-ID", _record_id(page_id, url, digest, copy)), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", _uri(url)))
    headers += [("WARC-Payload-Digest", f"sha1:{base32(sha1)}"), ("Content-Type", "application/http;msgtype=response")]
    if payload is None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(*target, digest, 0)), ("WARC-Refers-To-Date", date)]
    return _record(headers, _http(size) + (payload or b""))


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block; raises if a length or a digest doesn't hold."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest[:-4]
    if not found or first != "WARC/1.1" or rest[-4:] != b"\r\n\r\n" or len(block) != int(headers["Content-Length"]):
        raise ValueError(f"broken record {headers.get('WARC-Record-ID')}")
    if headers["WARC-Block-Digest"] != f"sha1:{base32(hashlib.sha1(block).digest())}":
        raise ValueError(f"digest of the block of {headers['WARC-Record-ID']}")
    return headers, block


def _row(headers: dict[str, str], block: bytes) -> tuple:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
    if kind == "response" and (len(payload) != size or base32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"payload of {headers['WARC-Record-ID']}")
    page = lambda name: int(m[1]) if (m := re.match(r"<urn:x-page:(-?\d+):", headers.get(name, ""))) else None
    return page("WARC-Record-ID"), headers.get("WARC-Target-URI"), kind, page("WARC-Refers-To"), size, digest, payload if kind == "response" else None


# ---- the data source


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: (final name, temporary name, records, bytes, sha256) of each file."""

    files: list[tuple[str, str, int, int, str]] = field(default_factory=list)


class _Roll:
    """A shard's files, one after the other."""

    def __init__(self, system: fs.FileSystem, folder: str, limit: int, date: str):
        self.system, self.folder, self.limit, self.date = system, folder, limit, date
        self.attempt = uuid.uuid4().hex
        self.done, self.out, self.shard, self.number = Written(), None, None, 0

    def add(self, shard: int, record: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.number = shard, 0
        member = _gzipped(record)
        if self.out is not None and self.size + len(member) > self.limit:
            self.close()
        if self.out is None:
            self.open()
        self.put(member)
        self.records += 1

    def open(self) -> None:
        self.name = f"shard-{self.shard:05d}-{self.number:05d}.warc.gz"
        self.number += 1
        self.temporary = f"{TEMPORARY}/{self.attempt}-{self.name}"
        self.out = self.system.open_output_stream(posixpath.join(self.folder, self.temporary), compression=None)
        self.size, self.records, self.sum = 0, 0, hashlib.sha256()
        headers = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-file:{self.name}>"), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")]
        self.put(_gzipped(_record(headers, b"format: WARC File Format 1.1\r\n")))

    def put(self, member: bytes) -> None:
        self.out.write(member)
        self.sum.update(member)
        self.size += len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.files.append((self.name, self.temporary, self.records, self.size, self.sum.hexdigest()))
            self.out = None


def _gzipped(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class WarcSource(DataSource):
    """Options: path; to write: file_bytes, date; to read: payload (true: with the bytes of responses)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return COLUMNS + (", payload binary" if self.options.get("payload", "false") == "true" else "")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options)

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)


class WarcWriter(DataSourceArrowWriter):
    """Takes the rows of `laid_out`, in order."""

    def __init__(self, options: dict):
        self.uri, self.limit, self.date = options["path"], int(options.get("file_bytes", FILE_BYTES)), options.get("date", DATE)
        system, folder = fs.FileSystem.from_uri(self.uri)
        if system.get_file_info(posixpath.join(folder, MANIFEST)).type != fs.FileType.NotFound:
            raise ValueError(f"there is an archive in {self.uri}")
        system.create_dir(posixpath.join(folder, TEMPORARY), recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = fs.FileSystem.from_uri(self.uri)
        roll, key, mark = _Roll(system, folder, self.limit, self.date), None, None
        for batch in iterator:
            for row in batch.to_pylist():
                this = (row["page_id"], row["url"], row["digest"])
                if row["copies"] is not None:  # what is known of records with this key, ahead of their payload
                    key, mark = this, row["copies"]
                    for k in range(mark["first"], mark["stop"]):
                        if k > 0 or mark["target"] is not None or mark["small"] is not None:
                            target = mark["target"]
                            payload = mark["small"]
                            target = None if payload is not None else tuple((target or {"page_id": this[0], "url": this[1]}).values())
                            roll.add(row["shard"], _page_record(self.date, *this, k, bytes(mark["sha1"]), mark["size"], payload, target))
                elif this != key or mark["first"] == 0 and mark["target"] is None and mark["small"] is None:
                    roll.add(row["shard"], _page_record(self.date, *this, 0, hashlib.sha1(row["payload"]).digest(), len(row["payload"]), row["payload"], None))
        roll.close()
        return roll.done

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = fs.FileSystem.from_uri(self.uri)
        files = sorted(f for m in messages if m is not None for f in m.files)
        at = lambda name: posixpath.join(folder, name)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda f: system.move(at(f[1]), at(f[0])), files))
        lines = [json.dumps({"file": name, "records": records, "bytes": size, "sha256": digest}) for name, _, records, size, digest in files]
        with system.open_output_stream(at(f"{TEMPORARY}/{MANIFEST}")) as out:
            out.write("".join(f"{x}\n" for x in lines).encode())
        system.move(at(f"{TEMPORARY}/{MANIFEST}"), at(MANIFEST))
        system.delete_dir(at(TEMPORARY))

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = fs.FileSystem.from_uri(self.uri)
        system.delete_dir(posixpath.join(folder, TEMPORARY))


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.payload = options["path"], options.get("payload", "false") == "true"

    def partitions(self) -> list[InputPartition]:
        system, folder = fs.FileSystem.from_uri(self.uri)
        with system.open_input_stream(posixpath.join(folder, MANIFEST)) as f:
            return [InputPartition(json.loads(x)) for x in f.read().decode().splitlines()] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 6 + self.payload]
        names = [c.split()[0] for c in COLUMNS.split(", ")] + ["payload"] * self.payload
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True))[: len(kinds)], kinds, strict=True)], names)

        for headers, block in self.records(partition.value):
            if headers["WARC-Type"] != "warcinfo":
                rows.append(_row(headers, block))
                held += len(block)
            if len(rows) == 4096 or held > 1 << 24:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()

    def records(self, entry: dict) -> Iterator[tuple[dict[str, str], bytes]]:
        """The records of a file, each a gzip member; at the end the file's sum and count are checked."""
        system, folder = fs.FileSystem.from_uri(self.uri)
        total, n, z, parts = hashlib.sha256(), -1, zlib.decompressobj(31), []  # -1: the first record tells of the file
        with system.open_input_stream(posixpath.join(folder, entry["file"]), compression=None) as f:
            while chunk := f.read(1 << 20):
                total.update(chunk)
                while chunk:
                    parts.append(z.decompress(chunk))
                    chunk = z.unused_data
                    if z.eof:
                        yield parse_record(b"".join(parts))
                        n, z, parts = n + 1, zlib.decompressobj(31), []
        if parts or n != entry["records"] or total.hexdigest() != entry["sha256"]:
            raise ValueError(f"{entry['file']} isn't what the manifest says")


# ---- the order of records


def _keys(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(key, sha1, size, n, small): distinct records; small: the payload where it is under least_bytes."""
    payload = _payload()
    small = F.when(F.octet_length(payload) < least_bytes, payload)
    narrow = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.sha2(payload, 256).alias("digest"), F.unhex(F.sha1(payload)).alias("sha1"), F.octet_length(payload).cast("long").alias("size"), small.alias("small"))
    return narrow.groupBy(*KEY).agg(F.first("sha1").alias("sha1"), F.first("size").alias("size"), F.first("small").alias("small"), F.count("*").alias("n"))


def _payload() -> Column:
    return F.coalesce("html", F.lit("")).cast("binary")


def _order() -> list[Column]:
    return [F.asc_nulls_first(c) for c in KEY]


def _is(struct: str) -> Column:
    return F.col(f"{struct}.page_id").eqNullSafe(F.col("page_id")) & F.col(f"{struct}.url").eqNullSafe(F.col("url"))


def _placed(keys: DataFrame, least_bytes: int, shard_bytes: int, scratch: Scratch) -> tuple[DataFrame, int, int]:
    """keys with target (of a payload that several records have), first and next (sizes of its records) and start (the sizes before it); bytes in a shard; shards."""
    shared = keys.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.sum("n").alias("rows"), F.max(F.struct("page_id", "url")).alias("target")).where("rows > 1").drop("rows")
    known = keys.join(shared, "digest", "left")
    body = lambda here: F.lit(OVERHEAD).cast("long") + F.when(here, F.col("size")).otherwise(0)
    known = known.withColumn("first", body(F.col("target").isNull() | _is("target"))).withColumn("next", body(F.col("target").isNull()))
    ranged = known.repartitionByRange(*_order()).sortWithinPartitions(*_order()).withColumn("part", F.spark_partition_id())
    ranged = scratch.written(ranged, "records")
    weight = F.col("first") + (F.col("n") - 1) * F.col("next")
    totals = ranged.groupBy("part").agg(F.sum(weight).alias("total")).orderBy("part").collect()  # a row for each partition
    sums = np.concatenate([[0], np.cumsum([r["total"] for r in totals], dtype=np.int64)])
    size = max(shard_bytes, -(-int(sums[-1]) // MOST_SHARDS))
    offsets = keys.sparkSession.createDataFrame([(r["part"], int(s)) for r, s in zip(totals, sums, strict=False)], "part int, offset long")
    before = Window.partitionBy("part").orderBy(*_order()).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("offset") + F.coalesce(F.sum(weight).over(before), F.lit(0))
    placed = ranged.join(F.broadcast(offsets), "part").withColumn("start", start).drop("part", "offset")
    return scratch.written(placed, "starts"), size, int(sums[-1]) // size + 1


def _copies(placed: DataFrame, size: int) -> DataFrame:
    """(shard, key, copies): for records that aren't alone with their key and payload, which are in which shard."""
    rest = F.col("start") + F.col("first")  # where the second record with a key begins
    first = F.floor(F.col("start") / size).cast("long")
    last = F.greatest(first, F.floor((rest + (F.col("n") - 2) * F.col("next")) / size).cast("long"))
    some = placed.where("target is not null or n > 1").withColumn("own", first).withColumn("shard", F.explode(F.sequence(first, last)))
    count = lambda end: F.greatest(F.lit(0), F.least(F.col("n") - 1, F.ceil((end - rest) / F.col("next")).cast("long")))
    begin = F.when(F.col("shard") == F.col("own"), F.lit(0)).otherwise(1 + count(F.col("shard") * size))
    stop = 1 + count((F.col("shard") + 1) * size)
    target = F.when(~_is("target"), F.col("target"))
    return some.select("shard", *KEY, F.struct(begin.alias("first"), stop.alias("stop"), "sha1", "size", target.alias("target"), "small").alias("copies")).where("copies.first < copies.stop")


class _Splits:
    """The first key of each shard that has the first record of any."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: r["shard"])
        self.shards = np.array([r["shard"] for r in rows], np.int64)
        self.keys = [self.order(*r["least"]) for r in rows]
        self.ids = np.array([np.iinfo(np.int64).min if r["least"]["page_id"] is None else r["least"]["page_id"] for r in rows], np.int64)

    @staticmethod
    def order(page_id: int | None, url: str | None, digest: str) -> tuple:
        return page_id is not None, page_id or 0, url is not None, url or "", digest

    def find(self, page_id: pa.Array, url: pa.Array, digest: pa.Array) -> pa.Array:
        ids = page_id.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        at = np.searchsorted(self.ids, ids, side="right") - 1
        for k in np.flatnonzero(self.ids[np.maximum(at, 0)] == ids):  # the rest of the key decides
            at[k] = bisect_right(self.keys, self.order(page_id[k].as_py(), url[k].as_py(), digest[k].as_py())) - 1
        return pa.array(self.shards[at])


def laid_out(pages: DataFrame, scratch: Scratch, least_bytes: int, shard_bytes: int) -> DataFrame:
    """(shard, key, copies, payload): a partition for each shard, in the order of its records."""
    spark = pages.sparkSession
    keys = scratch.written(_keys(pages, least_bytes), "keys")
    placed, size, shards = _placed(keys, least_bytes, shard_bytes, scratch)
    firsts = placed.groupBy(F.floor(F.col("start") / size).cast("long").alias("shard")).agg(F.min(F.struct(*KEY)).alias("least")).collect()  # MOST_SHARDS rows at most
    splits = spark.sparkContext.broadcast(_Splits(firsts))

    @F.arrow_udf("long")
    def shard_of(page_id: pa.Array, url: pa.Array, digest: pa.Array) -> pa.Array:
        return splits.value.find(page_id, url, digest)

    payloads = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.sha2(_payload(), 256).alias("digest"), _payload().alias("payload"))
    again = keys.where("n > 1").select(*KEY)
    if not again.isEmpty():
        same = F.col("p.digest").eqNullSafe(F.col("a.digest")) & F.col("p.page_id").eqNullSafe(F.col("a.page_id")) & F.col("p.url").eqNullSafe(F.col("a.url"))
        join = lambda how: payloads.alias("p").join(again.alias("a"), same, how)
        payloads = join("left_anti").unionByName(join("left_semi").dropDuplicates(KEY))
    copies = _copies(placed, size)
    kind = copies.schema["copies"].dataType
    payloads = payloads.select(shard_of(*KEY).alias("shard"), *KEY, F.lit(None).cast(kind).alias("copies"), "payload")
    rows = payloads.unionByName(copies.withColumn("payload", F.lit(None).cast("binary")))
    return rows.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", *_order(), F.col("copies").isNull())


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, date: str = DATE) -> None:
    """pages (page_id, url, html) as an archive in the folder `path`, which must not have one."""
    pages.sparkSession.dataSource.register(WarcSource)
    with Scratch(pages.sparkSession) as scratch:
        laid_out(pages, scratch, least_bytes, shard_bytes).write.format("warc").options(path=path, file_bytes=file_bytes, date=date).mode("append").save()


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(path=path, payload=str(payload).lower()).load()


def archived(pages: DataFrame, **options) -> DataFrame:
    """The records of a new archive of pages, read back from it."""
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, **options)
    return read_archives(pages.sparkSession, path)
