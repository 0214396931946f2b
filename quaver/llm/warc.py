"""Operator 7, web archives with an index first: write records with offsets, read sorted ranges.

Each task writes archives of its own to the shared folder, one gzip member a record, and returns
an index row for each record. The index is kept by a checkpoint; reading selects from it, sorts by
file and offset, and fetches neighbouring records in one byte range.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import cut, fresh, light, prepare, shared_dir, small

LEAST_REVISIT = 100
#: A byte range spans gaps up to GAP and is at most about RANGE long; archives roll over at ROLL.
GAP, RANGE, ROLL = 1 << 16, 4 << 20, 1 << 30
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, record_type string, refers_to long, payload_digest string, file string, offset long, length long"


def record_id(place: str) -> str:
    """An id of the archive and the offset that a record is written at: unique, also of repeated rows."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>"


def record(place: str, page_id: int | None, url: str | None, kind: str, refers_to: int | None, digest: str, payload: bytes) -> bytes:
    """One record; a revisit has no payload."""
    body = payload if kind == "response" else b""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + body
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(place)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info_record(name: str) -> bytes:
    """The record that each archive begins with."""
    block = b"format: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(name)}", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(whole: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(whole) + packer.flush()


def parse(whole: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields of a record (lower-case names) and its payload."""
    head, _, rest = whole.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def record_kinds(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (string), payload_digest, record_type, refers_to of each row of pages.

    Of rows with equal payloads of at least LEAST_REVISIT bytes those with the smallest page_id are
    responses, the others revisit it; a null html is an empty payload, and a row without a page_id
    is a response that none refers to.
    """
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    own = own.withColumn("payload_digest", F.sha2("payload", 256))
    long_enough = own.where((F.octet_length("payload") >= LEAST_REVISIT) & F.col("page_id").isNotNull()).select("page_id", "payload_digest")
    firsts = long_enough.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    shared = cut(firsts.where("first < last").select("payload_digest", "first"))
    # Pages that revisit, by their ids: where they are too many to broadcast, pages meet them by id, not
    # all copies of one payload in one place.
    again = cut(long_enough.join(small(shared, 96), "payload_digest").where("page_id > first").distinct())
    return own.join(small(again, 112), ["page_id", "payload_digest"], "left").select(
        "page_id",
        "url",
        "payload",
        "payload_digest",
        F.when(F.col("first").isNotNull(), "revisit").otherwise("response").alias("record_type"),
        F.col("first").alias("refers_to"),
    )


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) and returns the index: INDEX.

    A task that is run again writes new files, so index rows always point into what their own
    attempt wrote; files of lost attempts are named in no index.
    """
    spark = pages.sparkSession
    prepare(spark)
    folder = folder or f"{shared_dir(spark).rstrip('/')}/archives-{uuid.uuid4().hex}"

    @light
    def run(batches):
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        stem, nth, out, offset = f"part-{task.partitionId():06d}-{task.taskAttemptId()}", 0, None, 0
        try:
            for batch in batches:
                ids, urls, payloads, digests, kinds, refers = batch.columns
                files, offsets, lengths = [], [], []
                rows = zip(ids.to_pylist(), urls.to_pylist(), digests.to_pylist(), kinds.to_pylist(), refers.to_pylist(), strict=True)
                for k, (page, url, digest, kind, to) in enumerate(rows):
                    if out is None or offset >= ROLL:
                        if out is not None:
                            out.close()
                            nth += 1
                        name = f"{stem}-{nth}.warc.gz"
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                        offset = out.write(member(info_record(f"{folder}/{name}")))
                    own = member(record(f"{folder}/{name}#{offset}", page, url, kind, to, digest, payloads[k].as_py().encode()))
                    out.write(own)
                    files.append(name)
                    offsets.append(offset)
                    lengths.append(len(own))
                    offset += len(own)
                where = [pa.array(files, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())]
                yield pa.RecordBatch.from_arrays([ids, urls, kinds, refers, digests, *where], ["page_id", "url", "record_type", "refers_to", "payload_digest", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    written = record_kinds(pages).mapInArrow(run, INDEX)
    return cut(written.withColumn("file", F.concat(F.lit(folder + "/"), "file")))


def ranges(rows: list[tuple[int, int]]):
    """(begin, end, rows) of byte ranges that cover sorted (offset, length) rows."""
    begin = end = 0
    own: list[int] = []
    for k, (offset, length) in enumerate(rows):
        if own and (offset - end > GAP or offset + length - begin > RANGE):
            yield begin, end, own
            own = []
        if not own:
            begin = offset
        own.append(k)
        end = max(end, offset + length) if len(own) > 1 else offset + length
    if own:
        yield begin, end, own


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """page_id, record_type, refers_to, payload_bytes, payload_digest (and payload, binary) as the
    selected records themselves have them, read in sorted coalesced ranges. For a revisit the
    payload is empty and payload_digest is the header's."""
    spark = index.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spans = index.select("file", "offset", "length").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    schema = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payloads
    names = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", *["payload"] * payloads]

    @light
    def run(batches):
        from itertools import groupby

        from pyarrow.fs import FileSystem

        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            for file, own in groupby(rows, lambda r: r[0]):
                fs, path = FileSystem.from_uri(file)
                wanted = [(offset, length) for _, offset, length in own]
                with fs.open_input_file(path) as f:
                    for begin, end, members in ranges(wanted):
                        whole = f.read_at(end - begin, begin)
                        out: list[list] = [[] for _ in names]
                        for k in members:
                            at, length = wanted[k]
                            fields, payload = parse(zlib.decompress(whole[at - begin : at - begin + length], 31))
                            page, to, kind = fields["x-page-id"], fields.get("x-refers-to-page-id"), fields["warc-type"]
                            digest = hashlib.sha256(payload).hexdigest() if kind == "response" else fields["warc-payload-digest"].removeprefix("sha256:")
                            row = [int(page) if page else None, kind, int(to) if to else None, len(payload), digest, payload]
                            for col, v in zip(out, row, strict=False):
                                col.append(v)
                        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=False)], names)

    return spans.mapInArrow(run, schema)


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes pages to archives and reads them back: page_id, payload_bytes, payload_digest,
    record_type, refers_to. Bytes and digest are of the payload that was read, for a revisit of the
    response that it refers to. Repeated rows are archived each; an empty table gives no rows."""
    read = cut(read_records(write_archives(pages, folder), payloads=False))
    wanted = cut(read.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id")).distinct())
    sources = read.where("record_type = 'response'").join(small(wanted), "page_id", "left_semi")
    sources = cut(sources.select(F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full"), F.col("payload_digest").alias("sha")).distinct())
    mark = fresh(read, "same_")
    back = read.join(small(sources, 96), (read.refers_to == sources.refers_to) & (read.payload_digest == sources.sha), "left").drop(sources.refers_to)
    return back.withColumn(mark, F.coalesce("full", "payload_bytes")).select(
        "page_id", F.col(mark).alias("payload_bytes"), F.coalesce("sha", "payload_digest").alias("payload_digest"), "record_type", "refers_to"
    )
