"""WARC archives with an index: write records, then read selected ones by coalesced byte ranges.

Writing: payloads get their SHA-256; of equal payloads of at least MIN_REVISIT bytes the smallest page_id
is the response and the others are revisits.  Each task appends its records, one gzip member each, to
archives of its own in the shared folder, and returns the index: archive, offset, length, URL, digest.  The
index is committed by Spark as a table, and only archives that it names count: a task that was lost and run
again leaves an archive that nothing refers to, until clean() deletes it.

Reading: the selected index rows are sorted by archive and offset; ranges that touch or lie within GAP
bytes of each other are read at once, up to RANGE bytes, so a scan of everything reads long runs and a
lookup reads its records alone.  Archives are split into slices of SLICE bytes for this, so that no task
gets more than a slice of one archive.

The archive folder must be on a file system that pyarrow opens (file, HDFS, S3, GCS); pages themselves are
read by Spark.

Defined results: a null html is an empty payload, a null url an empty target; rows without a page_id are
responses of their own with a null refers_to; rows with equal page_id are separate records, and of equal
payloads among them one is the response only if their id is the smallest, the others revisit it; extra
columns are ignored; an empty table gives an empty index and no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorsift.runtime import configure, new_path, stage

MIN_REVISIT = 100
ARCHIVE = 64 << 20
SLICE = 8 << 20
GAP = 64 << 10
RANGE = 4 << 20
#: A fixed date: equal inputs give equal records.
DATE = "2000-01-01T00:00:00Z"
INDEX = "page_id long, archive string, offset long, length long, url string, digest string, record_type string"
RECORD = "page_id long, archive string, offset long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _one_line(value: str) -> str:
    return "".join(c if c >= " " else "%%%02X" % ord(c) for c in value)


def record_bytes(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit without."""
    kind, body = ("revisit", b"") if refers_to is not None else ("response", payload)
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_one_line(url)}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of one record; raises ValueError if it is not one."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the record's length does not match its header")
    return fields, rest[:size]


def plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, digest, refers_to: which record each row becomes."""
    text = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), text.alias("html"), F.sha2(text, 256).alias("digest"))
    large = F.octet_length("html") >= MIN_REVISIT
    firsts = stage(rows.where(large & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "payloads")
    known = rows.join(firsts, "digest", "left")
    return known.select("page_id", "url", "html", "digest", F.when(large & (F.col("first") < F.col("page_id")), F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE, **columns) -> DataFrame:
    """Write the archives of pages into folder (shared) and return their index, as a staged table."""
    spark = configure(pages.sparkSession)
    folder = folder or new_path(spark, "warc")
    planned = plan(pages, **columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows: list[tuple] = []
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                member = gzip.compress(record_bytes(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers_to), 6, mtime=0)
                out.write(member)
                rows.append((page_id, name, at, len(member), url, digest, "response" if refers_to is None else "revisit"))
                at += len(member)
            names = ["page_id", "archive", "offset", "length", "url", "digest", "record_type"]
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            cols = list(zip(*rows, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types, strict=True)], names=names)
        if out is not None:
            out.close()

    index = stage(planned.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, INDEX), "warc-index")
    index._warc_folder = folder
    return index


def ranges(spans: list[tuple[int, int]], gap: int = GAP, most: int = RANGE) -> list[tuple[int, int, int, int]]:
    """(start, end, first, last) of the reads for sorted (offset, length) spans: neighbours within gap share one."""
    out: list[list[int]] = []
    for i, (offset, length) in enumerate(spans):
        if out and offset - out[-1][1] <= gap and max(out[-1][1], offset + length) - out[-1][0] <= most:
            out[-1][1] = max(out[-1][1], offset + length)
            out[-1][3] = i
        else:
            out.append([offset, offset + length, i, i])
    return [tuple(x) for x in out]


def read(index: DataFrame, folder: str | None = None, payload: bool = True) -> DataFrame:
    """The records that the rows of an index name (all or a selection), parsed and checked against the index.

    payload False checks payloads and leaves them where they were read.
    """
    spark = configure(index.sparkSession)
    folder = folder or index._warc_folder
    schema = RECORD if payload else RECORD.replace("payload binary, ", "")

    def run(key: tuple[pa.Scalar, ...], held: pa.Table) -> pa.Table:
        store, base = _open(folder)
        held = held.sort_by("offset")
        offsets, lengths, digests = (held.column(c).to_pylist() for c in ("offset", "length", "digest"))
        rows: list[tuple] = []
        with store.open_input_file(f"{base}/{key[0].as_py()}") as file:
            for start, end, first, last in ranges(list(zip(offsets, lengths, strict=True))):
                data = file.read_at(end - start, start)
                for i in range(first, last + 1):
                    at = offsets[i] - start
                    fields, body = parse_record(gzip.decompress(data[at : at + lengths[i]]))
                    digest = fields["warc-payload-digest"].removeprefix("sha256:")
                    revisit = fields["warc-type"] == "revisit"
                    if digest != digests[i] or not revisit and hashlib.sha256(body).hexdigest() != digest:
                        raise ValueError(f"the record at {offsets[i]} of {key[0]} is not the one indexed")
                    own, other = (fields[f].removeprefix("<urn:page:").removesuffix(">") if f in fields else "" for f in ("warc-record-id", "warc-refers-to"))
                    rows.append((int(own) if own else None, key[0].as_py(), offsets[i], fields["warc-target-uri"], *([None if revisit else body] if payload else []), None if revisit else len(body), digest, fields["warc-type"], int(other) if other else None))
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), *([pa.binary()] if payload else []), pa.int64(), pa.string(), pa.string(), pa.int64()]
        cols = list(zip(*rows, strict=True))
        names = [x.split()[0] for x in schema.split(", ")]
        return pa.Table.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types, strict=True)], names=names)

    cut = index.withColumn("slice", F.floor(F.col("offset") / SLICE))
    return cut.select("archive", "slice", "offset", "length", "digest").groupBy("archive", "slice").applyInArrow(run, schema)


def clean(index: DataFrame, folder: str | None = None) -> int:
    """Delete the archives of the folder that the index does not name, as lost tasks leave them; how many they were."""
    spark, folder = index.sparkSession, folder or index._warc_folder
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    there = [x.getPath().getName() for x in store.listStatus(path)] if store.exists(path) else []
    if not there:
        return 0
    # archives are files of ARCHIVE bytes or one a task: their names are few
    listed = spark.createDataFrame([(x,) for x in there], "archive string")
    orphans = [x.archive for x in listed.join(index.select("archive").distinct(), "archive", "left_anti").collect()]
    for name in orphans:
        store.delete(spark._jvm.org.apache.hadoop.fs.Path(path, name), False)
    return len(orphans)


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write pages and read all records back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    index = write(pages, **columns)
    records = stage(read(index, payload=False), "records")
    responses = records.where("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("full"))
    both = records.join(responses, ["refers_to", "payload_digest"], "left")
    return both.select("page_id", F.coalesce("payload_bytes", "full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS size FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE size >= 100 GROUP BY digest)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN size >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN size >= 100 AND first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest
"""
