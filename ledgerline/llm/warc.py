"""WARC archives: a deterministic sharded writer with revisit records, and a reader that checks every digest.

Records are cut into shards by ranges of their id, so that shards hold about equal bytes, and sorted inside a shard. One
id (or null) with very many bytes is dealt to several shards by ranges of a hash of the payload. A
shard's task writes one gzip member a record, starts a new file when the compressed size reaches ``roll_bytes``, and
writes under temporary names only. A
manifest of the files of successful tasks is then written by Spark, a second job renames the files that it names, and
the final manifest makes the archive readable. The same rows give the same files, byte for byte, whatever the number
of executors, partitions or retries; what a lost attempt leaves behind is never named in the manifest.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, materialise, scratch, small_batches
from .shards import plan_shards, shard_column

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
MANIFEST = "manifest"


def base32_sha1(c: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column, in JVM expressions: four groups of 40 bits."""
    hexed = F.sha1(c)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url, payload: bytes, digest: str, date: str, ordinal: int, refers_to) -> bytes:
    """One uncompressed WARC record; ``refers_to`` is False for a response, else the id that it revisits."""
    name = lambda i, n: f"<urn:page:{'null' if i is None else i}:{digest}:{n}>"
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    block = HTTP_HEAD.format(len(payload)).encode()
    head = [("WARC-Type", "response"), ("WARC-Record-ID", name(page_id, ordinal)), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is False:
        block += payload
    else:
        head[0] = ("WARC-Type", "revisit")
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to, 0)), ("X-Payload-Length", str(len(payload)))]
    head += [("WARC-Block-Digest", f"sha1:{_sha1(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


class _Roller:
    """Files of one shard under temporary names; a manifest row for each."""

    def __init__(self, fs, base, roll_bytes):
        self.fs, self.base, self.roll, self.out = fs, base, roll_bytes, None
        fs.create_dir(f"{base}/_temporary", recursive=True)

    def open(self, shard):
        self.shard, self.seq = shard, -1
        self._next()

    def _next(self):
        self.seq += 1
        self.temp = f"_temporary/{uuid.uuid4().hex}.warc.gz"
        self.out = self.fs.open_output_stream(f"{self.base}/{self.temp}", compression=None)
        self.size = self.count = 0
        self.sum = hashlib.sha1()

    def write(self, data: bytes):
        rows = []
        z = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip member without a time stamp
        member = z.compress(data) + z.flush()
        if self.count and self.size + len(member) > self.roll:
            rows = self.close()
            self._next()
        self.out.write(member)
        self.sum.update(member)
        self.size += len(member)
        self.count += 1
        return rows

    def close(self):
        if self.out is None:
            return []
        self.out.close()
        self.out = None
        return [(self.temp, f"shard-{self.shard:06d}-{self.seq:04d}.warc.gz", self.count, self.size, self.sum.hexdigest())]


def _by_bytes(batches, limit=8 << 20):
    """Arrow batches in slices of rows, so that Python objects of long payloads stay few."""
    for b in batches:
        each = max(1, int(limit / max(1, b.nbytes / max(1, b.num_rows))))
        for k in range(0, b.num_rows, each):
            yield b.slice(k, each).to_pylist()


def write_archive(pages: DataFrame, out_dir: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, roll_bytes: int = 256 << 20, rows_per_shard: int = 1 << 20, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """Write one record a row of ``pages`` to ``out_dir``; returns the manifest (file, records, bytes, sha1).

    The payload is the column's UTF-8 text, empty for null; payloads of any length are whole records. Of rows with equal
    payloads of at least ``min_revisit_bytes`` bytes, one with the largest id is written as response, the others as
    revisits of it; null ids come before all others. Rows that repeat an id and payload are separate records, numbered,
    in one shard. Other columns don't matter. An empty table gives an archive without files. Ids must be integers.
    """
    spark = small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"").cast("binary")).alias("payload"))
    rows = rows.withColumn("h", F.xxhash64("payload"))
    size = F.octet_length("payload")
    light = materialise(rows.select("id", "h", F.when(size >= min_revisit_bytes, base32_sha1(F.col("payload"))).alias("digest"), (size + 512).cast("bigint").alias("weight")), "warc-light")
    plan = plan_shards(light, rows_per_shard)
    sent = spark.sparkContext.broadcast(plan)

    # revisits: ids and digests only, no payloads. The join key is built anew on both sides so that Spark deals both
    # out for the join and may split the partitions of a frequent payload
    digests = light.filter("digest IS NOT NULL")
    groups = digests.groupBy("digest").agg(F.max("id").alias("top"), F.count("*").alias("n")).filter("n > 1").select(F.concat(F.lit("p"), "digest").alias("key"), "top")
    repeats = digests.withColumn("key", F.concat(F.lit("p"), "digest")).join(groups, "key").select("id", "h", "digest", "top")
    marks = repeats.select("id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "h", "digest", "top")
    both = rows.withColumns({"digest": F.lit(None).cast("string"), "top": F.lit(None).cast("bigint")}).unionByName(marks)
    dealt = both.withColumn("shard", shard_column(plan, sent, F.col("id"), F.col("h"))).drop("h").repartitionById(plan.shards, "shard")
    dealt = dealt.sortWithinPartitions("shard", F.col("id").asc_nulls_first(), F.col("payload").isNotNull(), "payload", "url")

    def write(batches):
        fs, base = filesystem(out_dir)
        roller, shard, at, tops, seen = _Roller(fs, base, roll_bytes), None, object(), {}, {}
        for some in _by_bytes(batches):
            made = []
            for r in some:
                if r["shard"] != shard:
                    made += roller.close()
                    shard = r["shard"]
                    roller.open(shard)
                if r["id"] != at:
                    at, tops, seen = r["id"], {}, {}
                if r["payload"] is None:
                    tops[r["digest"]] = r["top"]
                    continue
                digest = _sha1(r["payload"])
                k = seen[digest] = seen.get(digest, -1) + 1
                response = digest not in tops or (tops[digest] == at and k == 0)
                made += roller.write(record(at, r["url"], r["payload"], digest, date, k, False if response else tops[digest]))
            if made:
                yield _manifest(made)
        if made := [x for x in roller.close() if x[2]]:
            yield _manifest(made)

    def rename(batches):
        fs, base = filesystem(out_dir)
        for b in batches:
            for r in b.to_pylist():
                if fs.get_file_info(f"{base}/{r['temp']}").size == r["bytes"]:
                    fs.move(f"{base}/{r['temp']}", f"{base}/{r['file']}")
                elif fs.get_file_info(f"{base}/{r['file']}").size != r["bytes"]:
                    raise OSError(f"neither {r['temp']} nor {r['file']} is whole")
            yield b

    written = materialise(dealt.mapInArrow(write, MANIFEST_SCHEMA), "warc-files")
    written.mapInArrow(rename, MANIFEST_SCHEMA).drop("temp").write.parquet(f"{out_dir}/{MANIFEST}")
    fs, base = filesystem(out_dir)
    fs.create_dir(f"{base}/_temporary", recursive=True)
    fs.delete_dir(f"{base}/_temporary")
    return spark.read.parquet(f"{out_dir}/{MANIFEST}")


MANIFEST_SCHEMA = "temp string, file string, records bigint, bytes bigint, sha1 string"


def _manifest(rows):
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))], ["temp", "file", "records", "bytes", "sha1"])


def members(stream, block: int = 1 << 20):
    """The decompressed gzip members of a stream, one at a time."""
    z, parts, data = zlib.decompressobj(31), [], stream.read(block)
    while data:
        parts.append(z.decompress(data))
        if z.eof:
            yield b"".join(parts)
            data, z, parts = z.unused_data, zlib.decompressobj(31), []
            data = data or stream.read(block)
        else:
            data = stream.read(block)
    if parts and any(parts):
        raise ValueError("the archive ends inside a record")


def parse(data: bytes) -> dict:
    """A record's fields; raises when a length or digest is wrong."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    page = lambda urn: None if (i := urn.split(":")[2]) == "null" else int(i)
    out = {"page_id": page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": None, "payload": None}
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or f"sha1:{_sha1(block)}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    if out["record_type"] == "revisit":
        return out | {"refers_to": page(fields["WARC-Refers-To"]), "payload_bytes": int(fields["X-Payload-Length"])}
    payload = block.partition(b"\r\n\r\n")[2]
    if _sha1(payload) != out["payload_digest"]:
        raise ValueError(f"damaged payload in {fields['WARC-Record-ID']}")
    return out | {"payload": payload, "payload_bytes": len(payload)}


def read_archive(spark: SparkSession, out_dir: str, payloads: bool = False) -> DataFrame:
    """Records of the files in the manifest: page_id, url, record_type, payload_bytes, payload_digest, refers_to, and payload (of responses) if asked for."""
    schema = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint" + ", payload binary" * payloads
    names = [f.split()[0] for f in schema.split(", ")]
    types = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(f.split()[0], types[f.split()[1]]) for f in schema.split(", ")])

    def read(batches):
        fs, base = filesystem(out_dir)
        for b in batches:
            for r in b.to_pylist():
                rows, size, count = [], 0, 0
                with fs.open_input_stream(f"{base}/{r['file']}", compression=None) as stream:
                    for data in members(stream):
                        x = parse(data)
                        rows.append({k: x[k] for k in names})
                        size += x["payload_bytes"] * payloads + 200
                        count += 1
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, arrow)
                            rows, size = [], 0
                if count != r["records"]:
                    raise ValueError(f"{r['file']} holds {count} records, not {r['records']}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    files = spark.read.parquet(f"{out_dir}/{MANIFEST}")
    # a number of its own: the manifest's few bytes say nothing about the work, so Spark must not join these partitions
    return files.repartition(max(1, min(files.count(), 50_000))).mapInArrow(read, schema)


def op1_warc(spark, sf_dir):
    out = scratch(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), out)
    return read_archive(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS payload_bytes, upper(sha1(b)) AS x FROM p),
d AS (
  SELECT page_id, payload_bytes, translate(concat(
    lpad(to_base(('0x' || substr(x, 1, 10))::BIGINT, 32), 8, '0'), lpad(to_base(('0x' || substr(x, 11, 10))::BIGINT, 32), 8, '0'),
    lpad(to_base(('0x' || substr(x, 21, 10))::BIGINT, 32), 8, '0'), lpad(to_base(('0x' || substr(x, 31, 10))::BIGINT, 32), 8, '0')),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest FROM h),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST) AS k FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k > 1 THEN top END AS refers_to FROM m
"""
