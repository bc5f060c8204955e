"""Web archives: written with revisits for equal payloads, read back by following each file's chain of record boundaries.

Reading never trusts the magic. Tasks cut their part of a file at every place that looks like a record's first line and
emit, for each of these candidates, its offset and the offset at which its successor must stand by its own
Content-Length. Pointer jumping from the start of each file then keeps what the chain reaches: magic inside a payload is
a candidate that nothing points to.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.session import ship
from .shared import stored

# Fixed values of the format.
MAGIC = b"WARC/1.0\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

#: A line feed before the magic: a record starts a line. No part of it repeats its own start, so that no reader of parts
#: of a file can lose one place by trying another.
_CUT = "\n" + MAGIC.decode()
#: A row of :func:`read_warc`.
_RECORD = "file string, offset long, type string, record_id string, target_uri string, page_id long, refers_to string, digest string, payload binary"


def record_id(page_id: int | None, digest: str) -> str:
    """The record's name, the same whenever the page is written: of its id and its payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {digest}')}>"


def _block(head: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*head, ("Content-Length", str(len(block)))])
    # The writer of lines adds the last line break.
    return MAGIC + lines.encode() + b"\r\n" + block + b"\r\n"


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 1000) -> DataFrame:
    """page_id, url, payload and refers_to: null, or the page whose record has the same payload.

    Of payloads of ``least`` bytes or more that are equal, that of the largest page_id is kept and the others refer to
    it; rows that repeat the largest id are all kept. A null payload is an empty one. A null id is below all others.
    Payloads are equal by SHA-256. Digests alone are grouped, with partial maxima on every task, so a payload that a third
    of all pages share costs no more than another; what refers to what is a table of two numbers and a digest a revisit,
    and payloads move only where that table is too large to be sent to them.
    """
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"),
                        F.coalesce(F.col(f"`{html}`").cast("binary"), F.lit(b"")).alias("payload"))
    large = F.octet_length("payload") >= least
    thin = stored(rows.where(large).select("page_id", F.sha2("payload", 256).alias("key")), "payload-digests")
    kept = thin.groupBy("key").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1 AND largest IS NOT NULL")
    other = thin.join(kept, "key").where(~F.col("page_id").eqNullSafe(F.col("largest")))
    other = stored(other.select(F.col("page_id").alias("from"), F.col("key").alias("of"), F.col("largest").alias("refers_to")).distinct(), "revisits")
    # Small payloads have keys of their own, spread by id, that nothing refers to.
    keyed = rows.withColumn("key", F.when(large, F.sha2("payload", 256)).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id").cast("string"))))
    return keyed.join(other, (keyed["key"] == other["of"]) & keyed["page_id"].eqNullSafe(other["from"]), "left").select("page_id", "url", "payload", "refers_to")


def write_warc(records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """One file per partition of page_id, url, payload and refers_to: a warcinfo record, then one record a row.

    A row without refers_to is a response with its payload, any other a revisit with the HTTP header only and the digest
    of its payload. Characters of a url that a header can't hold are percent-encoded; a null url has no header line.
    """
    ship(records.sparkSession)
    info = _block([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, "warcinfo")), ("WARC-Date", date),
                   ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.0\r\n")

    def record(page: int | None, url: str | None, payload: bytes, refers: int | None) -> bytes:
        sha = hashlib.sha1(payload)
        head = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", record_id(page, sha.hexdigest())), ("WARC-Date", date)]
        if url is not None:
            head.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
        if page is not None:
            head.append(("X-Page-Id", str(page)))
        if refers is not None:
            head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers, sha.hexdigest()))]
        head += [("WARC-Payload-Digest", "sha1:" + sha.hexdigest()), ("Content-Type", "application/http; msgtype=response")]
        return _block(head, _HTTP + payload if refers is None else _HTTP)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = [info]
        for batch in batches:
            # A few payloads at a time: a batch may hold thousands of long ones.
            for at in range(0, batch.num_rows, 256):
                out = first + [record(*row) for row in zip(*[c.to_pylist() for c in batch.slice(at, 256).columns], strict=True)]
                first = []
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    lines = records.select("page_id", "url", "payload", "refers_to").mapInArrow(write, "value binary")
    lines.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\r\n").option("maxRecordsPerFile", 0).text(folder)


def _segments(spark: SparkSession, folder: str, split_bytes: int) -> DataFrame:
    """The files cut before every line that is the magic, in order within each split: file, split (where it starts),
    size of the file, value without the cut. The first of a file still has its magic.

    Read by a session of its own, which alone has these settings: files are read twice and must be split alike, however
    many executors there are by then.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.files.minPartitionNum", "1")
    own.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    own.conf.set("spark.sql.files.openCostInBytes", str(min(split_bytes, 4 << 20)))
    read = own.read.option("lineSep", _CUT).text(folder)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                       F.col("_metadata.file_size").alias("size"), F.col("value").alias("text"))


def candidates(spark: SparkSession, folder: str, split_bytes: int = 32 << 20) -> DataFrame:
    """file, split, size of the file, span (bytes of the split's segments), at, next and exit of every candidate.

    ``next`` is where its successor must stand (null if its header has no valid length). ``exit`` is where its chain
    leaves the split, or the place within at which it breaks (null if that is the candidate itself). Places are counted
    from the split's first segment here; :func:`chains` makes them offsets. A task holds a few numbers per candidate of
    a split, and no payload leaves the JVM.
    """
    ship(spark)
    rows = _segments(spark, folder, split_bytes)
    rows = rows.withColumn("head", F.substring_index("text", "\r\n\r\n", 1)).withColumn("bytes", F.octet_length("text"))
    # A payload that starts with the magic takes the last line feed of its header.
    inside = F.octet_length("head") < F.col("bytes")
    ends = F.when(inside, F.octet_length("head") + 4).when(F.col("text").endswith("\r\n\r"), F.col("bytes") + 1)
    length = F.regexp_extract(F.concat(F.lit("\r\n"), "head", F.lit("\r\n")), r"(?i)\r\ncontent-length:[ \t]*(\d{1,18})[ \t]*\r\n", 1)
    body = ends.cast("long") + F.when(length != "", length.cast("long"))
    thin = rows.select("file", "split", "size", F.col("bytes").cast("long"), F.col("text").startswith(MAGIC.decode()).alias("opens"), body.alias("body"))

    def follow(held: list[tuple], file: str, split: int, size: int) -> pa.RecordBatch:
        span = sum(r[0] for r in held) + len(held) * len(_CUT)
        text = np.cumsum([0] + [r[0] + len(_CUT) for r in held[:-1]])
        start = text - len(MAGIC)
        if split == 0:
            start[0] = 0
        known = np.array([r[2] is not None for r in held], bool)
        nxt = np.where(known, text + np.array([r[2] or 0 for r in held], np.int64) + 4, -1)
        if split == 0 and not held[0][1]:  # the file doesn't start with a record
            start, nxt = start[1:], nxt[1:]
        leave, spot = nxt.copy(), np.searchsorted(start, nxt)
        for i in range(len(start) - 1, -1, -1):
            j = spot[i]
            if nxt[i] >= 0 and j < len(start) and start[j] == nxt[i]:
                leave[i] = leave[j] if leave[j] >= 0 else start[j]
        n = len(start)
        return pa.RecordBatch.from_arrays(
            [pa.array([file] * n, pa.string()), pa.array([split] * n, pa.int64()), pa.array([size] * n, pa.int64()), pa.array([span] * n, pa.int64()),
             pa.array(start, pa.int64()), pa.array(nxt, pa.int64(), mask=nxt < 0), pa.array(leave, pa.int64(), mask=leave < 0)],
            names=["file", "split", "size", "span", "at", "next", "exit"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            for file, split, size, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (file, split, size) != key:
                    if held:
                        yield follow(held, *key)
                    held, key = [], (file, split, size)
                held.append(row)
        if held:
            yield follow(held, *key)

    return thin.mapInArrow(emit, "file string, split long, size long, span long, at long, next long, exit long")


def chains(spark: SparkSession, folder: str, split_bytes: int = 32 << 20) -> tuple[DataFrame, DataFrame]:
    """What a reader of each split has to know, and where chains break.

    The first: file, split, base (offset of the split's first segment), entry (offset of the first record in the split
    that its file's chain reaches; -1 if none) and after (where the record ends that is open when the split starts).
    The second: file, offset of chains that end elsewhere than at the end of their file; 0 where none starts.

    Every split's own chains are followed by its task; only the places where they leave a split are joined. Each round
    doubles the jumps, so the rounds are the logarithm of a file's splits.
    """
    cand = stored(candidates(spark, folder, split_bytes), "boundaries")
    splits = cand.groupBy("file", "split").agg(F.first("size").alias("size"), F.first("span").alias("span"))
    before = F.sum("span").over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1))
    splits = stored(splits.select("file", "split", "size", F.coalesce(before, F.lit(0)).alias("base")), "splits")
    placed = stored(cand.drop("size", "span").join(splits, ["file", "split"]).select(
        "file", "split", "size", (F.col("at") + F.col("base")).alias("at"), (F.col("exit") + F.col("base")).alias("exit")), "placed-boundaries")
    reached = stored(splits.select("file", F.lit(0).cast("long").alias("at")).distinct(), "reached")
    places = placed.where("exit < size").select("file", F.col("exit").alias("at")).unionByName(reached).distinct()
    jumps = stored(places.join(placed, ["file", "at"]).where("exit IS NOT NULL").select("file", "at", F.col("exit").alias("to")), "jumps")
    seen, n = 0, reached.count()
    while n > seen:
        onward = reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))
        reached = stored(reached.unionByName(onward).distinct(), "reached")
        further = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("past"))
        jumps = stored(jumps.join(further, ["file", "to"], "left").select("file", "at", F.coalesce("past", "to").alias("to")), "jumps")
        seen, n = n, reached.count()
    entries = placed.join(reached, ["file", "at"]).groupBy("file", "split").agg(F.min("at").alias("entry"))
    last = reached.groupBy("file").agg(F.max("at").alias("last"))
    nearest = F.min("entry").over(W.partitionBy("file").orderBy("split").rowsBetween(0, W.unboundedFollowing))
    marks = splits.join(entries, ["file", "split"], "left").join(last, "file").select(
        "file", "split", "base", F.coalesce("entry", F.lit(-1)).alias("entry"), F.coalesce(nearest, "last").alias("after"))
    stops = reached.join(splits.groupBy("file").agg(F.first("size").alias("size")), "file")
    stops = stops.join(placed.select("file", "at", "exit"), ["file", "at"], "left").where("exit IS NULL AND at <> size")
    return marks, stops.select("file", F.col("at").alias("offset"))


def _parse(raw: bytes) -> tuple[dict[str, str], int, int] | None:
    """The header's fields, in lower case, and where the block starts and ends; None without a valid length."""
    end = raw.find(b"\r\n\r\n")
    fields: dict[str, str] = {}
    for line in re.sub(rb"\r\n[ \t]+", b" ", raw[: max(end, 0)]).split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields.setdefault(name.decode("latin-1").lower(), value.strip().decode("utf-8", "replace"))
    length = fields.get("content-length", "")
    return (fields, end + 4, end + 4 + int(length)) if re.fullmatch(r"[0-9]{1,18}", length) else None


def _row(file: str, offset: int, raw: bytes) -> tuple | None:
    """A record's bytes as a row of :func:`read_warc`; None where they aren't all there."""
    fields, start, end = _parse(raw)
    if end > len(raw):
        return None
    block, kind, page = raw[start:end], fields.get("warc-type"), fields.get("x-page-id", "")
    if fields.get("content-type", "").lower().startswith("application/http"):
        block = block.partition(b"\r\n\r\n")[2]
    return (file, offset, kind, fields.get("warc-record-id"), fields.get("warc-target-uri"), int(page) if re.fullmatch(r"-?[0-9]{1,18}", page) else None,
            fields.get("warc-refers-to"), fields.get("warc-payload-digest"), None if kind == "revisit" else block)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_ROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()),
                  ("page_id", pa.int64()), ("refers_to", pa.string()), ("digest", pa.string()), ("payload", pa.binary())])
_PART = _ROW.append(pa.field("torn", pa.int64()))


def read_warc(spark: SparkSession, folder: str, split_bytes: int = 32 << 20) -> DataFrame:
    """file, offset, type, record_id, target_uri, page_id, refers_to (a record_id), digest (as the header has it) and
    payload (null for a revisit) of every record that its file's chain reaches; magic inside a payload is part of it.

    Files are read twice, for their boundaries and for their records. A split's reader starts at the record by which the
    chain enters it; three numbers a split tell it so and go to every task, fewer than Spark's own driver holds for
    each split. Only records with magic inside that also reach past a split are put together from pieces, in a shuffle
    of just these. Where a chain breaks, the rest of the file isn't given, nor is a record that is cut off;
    :func:`chains` tells the places. A value, so a record, is at most 2 GB in Spark. The records are kept as a table in the shared folder.
    """
    marks, _ = chains(spark, folder, split_bytes)
    known: dict[str, list] = {}
    for r in marks.collect():
        known.setdefault(r["file"], []).append((r["split"], r["base"], r["entry"], r["after"]))
    sent = spark.sparkContext.broadcast({f: np.array(sorted(m), np.int64) for f, m in known.items()})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        key = file = None
        place = base = after = 0
        due = at = until = -1  # where the next record starts; where the open one does, and ends
        parts: list[bytes] = []
        opened = False

        def close(end: int) -> None:
            """The open record, whole if it ends where the split's next segment could start, or before."""
            if parts:
                raw = b"".join(parts)
                row = _row(file, at, raw) if until <= end else (file, at, *[None] * 6, raw)
                if row is not None:
                    out.append((*row, None if until <= end else until))
                parts.clear()

        for batch in batches:
            for name, split, value in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (name, split) != key:
                    close(base + place - len(MAGIC))
                    mine = sent.value[name]
                    _, base, due, after = mine[np.nonzero(mine[:, 0] == split)[0][0]].tolist()
                    key, file, place, opened = (name, split), name, 0, False
                first = split == 0 and place == 0
                here = base + place - (0 if first else len(MAGIC))
                raw = (b"" if first else MAGIC) + value + b"\n"
                place += len(value) + len(_CUT)
                if here == due:
                    close(here)
                    opened, at, parsed = True, here, _parse(raw)
                    due = until = here + parsed[2] + 4 if parsed else -1
                    if parsed:
                        parts.append(raw)
                        held += len(raw)
                elif not opened and here < after:
                    out.append((file, here, *[None] * 6, raw, after))  # of a record that another split opened
                    held += len(raw)
                elif parts and here < until:
                    parts.append(raw)
                    held += len(raw)
                if held >= 4 << 20:
                    yield _batch(out, _PART)
                    out, held = [], 0
        close(base + place - len(MAGIC))
        yield _batch(out, _PART)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, pieces in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                pieces = pieces.as_py()
                row = _row(file, pieces[0]["offset"], b"".join(p["payload"] for p in pieces))
                yield _batch([row] if row else [], _ROW)

    segments = _segments(spark, folder, split_bytes).select("file", "split", F.col("text").cast("binary"))
    kept = stored(segments.mapInArrow(read, _RECORD + ", torn long"), "records")
    torn = kept.where("torn IS NOT NULL").groupBy("file", "torn").agg(F.array_sort(F.collect_list(F.struct("offset", "payload"))).alias("pieces"))
    return kept.where("torn IS NULL").drop("torn").unionByName(torn.select("file", "pieces").mapInArrow(join, _RECORD))


def page_payloads(records: DataFrame, salts: int = 16) -> DataFrame:
    """page_id, payload_bytes, payload_digest (SHA-1 in hex, of the payload itself), record_type, refers_to (a page_id) and
    intact (the digest is that of the header) of every response and revisit; a revisit's payload is that of the record
    it refers to, and its bytes are null where that one isn't there. One record may be referred to by a third of all
    others: these are spread over ``salts`` copies of it, of a few numbers each.
    """
    thin = records.where("type IN ('response', 'revisit')").select(
        "page_id", "type", "record_id", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"),
        F.regexp_replace("digest", "^sha1:", "").alias("stated"))
    own = thin.where("type = 'response'").select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"),
                                                 F.lit(None).cast("long").alias("refers_to"), (F.col("payload_digest") == F.col("stated")).alias("intact"))
    again = thin.where("type = 'revisit'").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    named = again.select(F.col("refers_to").alias("record_id")).distinct()
    target = thin.where("type = 'response'").join(named, "record_id").groupBy("record_id").agg(
        F.first("page_id").alias("target"), F.first("payload_bytes").alias("n"), F.first("payload_digest").alias("sha"))
    target = target.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumnRenamed("record_id", "refers_to")
    seen = again.join(target, ["refers_to", "salt"], "left").select(
        "page_id", F.col("n").alias("payload_bytes"), F.coalesce("sha", "stated").alias("payload_digest"), F.lit("revisit").alias("record_type"),
        F.col("target").alias("refers_to"), F.coalesce(F.col("sha") == F.col("stated"), F.lit(False)).alias("intact"))
    return own.unionByName(seen)
