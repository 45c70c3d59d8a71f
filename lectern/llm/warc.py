"""WARC archives: writing with revisit records, and splittable reading by boundary chains.

Writing. One response record per distinct payload (the largest page id) and revisit records for
its other pages; payloads below ``least`` bytes are always written in full. Spark's own writer
makes the files, so a task that is lost or repeated leaves no partial archive.

Reading. Files are cut at the magic line that starts every record, wherever it occurs, by tasks
that know nothing of each other. Each piece is a candidate record; its declared length names its
successor's offset. In a chunk (the part of a file that one task reads) the candidates' chains
are followed locally to the first offset beyond the chunk. Pointer jumping over those chunk
exits, from offset 0 of each file, then finds the offset at which the true chain enters every
chunk, in log2(chunks of a file) rounds. Only candidates on the chain from there are records;
magic lines inside payloads are not. Payloads never move: digests are made where they are read.
The one record that may run over a chunk's end because its payload holds magic lines is put
together again from its pieces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import drop, new_path, stored

# Fixed values of the format.
MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEADER = "record_type string, record_id string, refers_to_id string, page_id long, url string, declared_digest string"


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit("page"), page_id.cast("string"), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write_warc(
    pages: DataFrame, path: str, least: int = 1000, date: str = "2024-01-01T00:00:00Z", broadcast_rows: int = 200_000
) -> None:
    """Write one record per row of ``pages`` (page_id, url, html; other columns are ignored).

    A null html is an empty payload; a null page_id or url leaves out that header. Of rows with
    equal payloads of at least ``least`` bytes, those with the largest page_id are responses
    (all, if every page_id is null) and the others revisit it. Line ends in a url become spaces.
    Empty input: files without records. The list of payloads that occur more than once is sent
    to all tasks if it has at most ``broadcast_rows`` rows (of 56 bytes); else rows meet it in a
    shuffled join.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("string")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.col("url"), "[\\r\\n]+", " ").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("n"),
        F.sha1(payload.cast("binary")).alias("digest"),
    )
    # The largest id of each shared payload, from digests alone; only shared ones come back.
    shared = (
        pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("n"))
        .where(F.col("n") >= least)
        .groupBy("digest")
        .agg(F.max("page_id").alias("first_id"), F.count("*").alias("rows"))
        .where((F.col("rows") > 1) & F.col("first_id").isNotNull())
        .select(F.col("digest").alias("_digest"), "first_id")
    )
    shared, shared_path = stored(shared, "warc-shared")
    if shared.count() <= broadcast_rows:
        shared = F.broadcast(shared)
    marked = rows.join(shared, (F.col("digest") == F.col("_digest")) & (F.col("n") >= least), "left")
    revisit = F.col("first_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("first_id")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat_ws(
        "",
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Page-ID", F.col("page_id").cast("string")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.upper(F.col("digest")))),
        F.when(revisit, line("WARC-Profile", F.lit(REVISIT_PROFILE))),
        F.when(revisit, line("WARC-Refers-To", _record_id(F.col("first_id"), F.col("digest")))),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    marked.select(F.concat(header, block).alias("value")).write.option("lineSep", END).text(path)
    drop(pages.sparkSession, shared_path)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """The files' bytes between magic lines, each with the chunk that read it, in file order."""
    return (
        spark.read.option("lineSep", MAGIC)
        .text(path)
        .select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    )


_FIELD = {
    name: re.compile(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)")
    for name in ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Page-ID", "WARC-Target-URI", "WARC-Payload-Digest", "Content-Length", "Content-Type")
}


def _fields(head: bytes) -> dict[str, str | None]:
    return {k: m[1].decode("utf-8", "replace").strip() if (m := p.search(head)) else None for k, p in _FIELD.items()}


def _payload(block: bytes) -> bytes:
    """The body of the HTTP message in a record's block; the block itself if it is none."""
    if block.startswith(b"HTTP/"):
        return block.partition(b"\r\n\r\n")[2]
    return block


_CANDIDATE = (
    "file string, block long, at long, ends long, exit long, whole boolean, payload_bytes long, payload_digest string, " + _HEADER
)


def _candidates(pieces: DataFrame) -> DataFrame:
    """A row for each candidate of each chunk, offsets counted from the chunk's first piece, and
    a last row (at = -1) with the chunk's length in ``ends``."""

    names = [f.split()[0] for f in _CANDIDATE.split(", ")]

    def chunk(file: str, block: int, values: list[bytes]) -> list[tuple]:
        # pieces[0] of a file's first chunk is what stands before the first magic line
        starts, at = [], 0
        for v in values:
            starts.append(at)
            at += len(v) + len(MAGIC)
        place = {s: i for i, s in enumerate(starts)}
        rows, ends = [], []
        for i, v in enumerate(values):
            head, sep, body = v.partition(b"\r\n\r\n")
            f = _fields(head)
            length = f["Content-Length"]
            if not sep or not length or not length.isdigit():
                rows.append(None)
                ends.append(-1)
                continue
            need = int(length) + len(END)
            last = i
            if len(body) < need:  # the payload holds magic lines: it goes on in the next pieces
                parts, have = [body], len(body)
                while have < need and last + 1 < len(values):
                    last += 1
                    parts.append(MAGIC.encode() + values[last])
                    have += len(parts[-1])
                body = b"".join(parts)
            whole = len(body) >= need
            # a record is followed by two line ends and then by a magic line or the file's end
            if whole and (body[int(length) : need] != END.encode() or len(body) > need):
                rows.append(None)
                ends.append(-1)
                continue
            content = _payload(body[: int(length)]) if whole else b""
            ends.append(starts[i] + len(head) + 4 + need + len(MAGIC))
            digest = (f["WARC-Payload-Digest"] or "").partition(":")[2].lower() or None
            page = f["WARC-Page-ID"]
            rows.append(
                (whole, len(content), hashlib.sha1(content).hexdigest() if whole else None, f["WARC-Type"], f["WARC-Record-ID"],
                 f["WARC-Refers-To"], int(page) if page and re.fullmatch(r"-?\d+", page) else None, f["WARC-Target-URI"], digest)
            )
        exits = list(ends)
        for i in range(len(values) - 1, -1, -1):
            if ends[i] >= 0 and ends[i] < at:
                j = place.get(ends[i], -1)
                exits[i] = exits[j] if j >= 0 else -1
        out = [
            (file, block, s, e, x, *r)
            for s, e, x, r in zip(starts, ends, exits, rows, strict=True)
            if r is not None
        ]
        return [*out, (file, block, -1, at, -1, False, 0, *[None] * 7)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _ARROW
        now: tuple[str, int] | None = None
        held: list[bytes] = []
        for batch in batches:
            values, files, blocks = (batch.column(i).to_pylist() for i in range(3))
            for v, f, b in zip(values, files, blocks, strict=True):
                if (f, b) != now:
                    if now:
                        yield _batch(chunk(*now, held), schema, names)
                    now, held = (f, b), []
                held.append(v)
        if now:
            yield _batch(chunk(*now, held), schema, names)

    return pieces.mapInArrow(read, _CANDIDATE)


_ARROW = pa.schema(
    [("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("ends", pa.int64()), ("exit", pa.int64()),
     ("whole", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()),
     ("refers_to_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("declared_digest", pa.string())]
)


def _batch(rows: list[tuple], schema: pa.Schema, names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, schema.types, strict=True)], names=names)


def _entries(candidates: DataFrame) -> DataFrame:
    """(file, block, at): where the chain from each file's start enters each of its chunks."""
    spark = candidates.sparkSession
    bases, bases_path = stored(_spans(candidates).withColumn("chunks", F.count("*").over(Window.partitionBy("file"))), "warc-chunks")
    rounds = int(bases.agg(F.coalesce(F.max("chunks"), F.lit(1))).first()[0] - 1).bit_length()
    # The first candidate of a file follows its first magic line, at the length of an empty piece.
    start = bases.where("base = 0").groupBy("file").agg(F.min("block").alias("block")).select("file", F.lit(len(MAGIC)).cast("long").alias("src"))
    jumps = (
        candidates.where("at >= 0 and exit >= 0").join(bases, ["file", "block"])
        .select("file", (F.col("base") + F.col("at")).alias("src"), (F.col("base") + F.col("exit")).alias("dst"))
    )
    paths = [bases_path]
    reached = start
    if rounds:
        # only offsets that some chain arrives at, or a file's start, can carry the true chain on
        arrived = jumps.select("file", F.col("dst").alias("src")).unionByName(start).distinct()
        jumps, p = stored(jumps.join(arrived, ["file", "src"], "left_semi"), "warc-jumps")
        paths.append(p)
    for _ in range(rounds):
        reached, p = stored(
            reached.unionByName(reached.join(jumps, ["file", "src"]).select("file", F.col("dst").alias("src"))).distinct(), "warc-reached"
        )
        paths.append(p)
        onward = jumps.select("file", F.col("src").alias("dst"), F.col("dst").alias("further"))
        jumps, p = stored(jumps.join(onward, ["file", "dst"]).select("file", "src", F.col("further").alias("dst")), "warc-jumps")
        paths.append(p)
    entered = (
        reached.join(bases, "file").where("src >= base and src < base + n").select("file", "block", (F.col("src") - F.col("base")).alias("at"))
    )
    out, _ = stored(entered.join(bases.select("file", "block", "base"), ["file", "block"]), "warc-entries")
    drop(spark, *paths)
    return out


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under ``path``.

    One row per record: file, offset (its magic line's byte), record_type, record_id,
    refers_to_id, page_id, url, declared_digest, payload_bytes and payload_digest (of the bytes
    read). Bytes that no chain from the file's start reaches give no rows; a chain ends at the
    first record whose declared length does not lead to a magic line or the file's end.
    """
    pieces = _chunks(spark, path)
    candidates, _ = stored(_candidates(pieces), "warc-candidates")
    entries = _entries(candidates)

    def walk(found: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        """The candidates of one chunk that lie on the chain from its entry."""
        place = dict(zip(found["at"], range(len(found)), strict=True))
        ends = found["ends"].to_numpy()
        keep, bases = [], []
        for a, base in zip(entry["at"], entry["base"], strict=True):
            i = place.get(a)
            while i is not None:
                keep.append(i)
                bases.append(base)
                i = place.get(ends[i])
        out = found.iloc[keep][["file", "block", "at"]]
        return out.assign(base=np.array(bases, dtype=np.int64))

    slim = candidates.where("at >= 0").select("file", "block", "at", "ends")
    chain = (
        slim.groupBy("file", "block")
        .cogroup(entries.groupBy("file", "block"))
        .applyInPandas(walk, "file string, block long, at long, base long")
    )
    names = [f.split()[0] for f in _HEADER.split(", ")]
    offset = (F.col("base") + F.col("at") - len(MAGIC)).alias("offset")
    chained, _ = stored(candidates.join(chain, ["file", "block", "at"]).select("*", offset), "warc-records")
    whole = chained.where("whole").select("file", "offset", *names, "payload_bytes", "payload_digest")
    return whole.unionByName(_across_chunks(pieces, chained.where("not whole"), candidates))


def _spans(candidates: DataFrame) -> DataFrame:
    """(file, block, base, n): the first offset and the length of every chunk."""
    lengths = candidates.where("at = -1").select("file", "block", F.col("ends").alias("n"))
    before = F.expr("coalesce(sum(n) over (partition by file order by block rows between unbounded preceding and 1 preceding), 0)")
    return lengths.select("file", "block", before.alias("base"), "n")


def _across_chunks(pieces: DataFrame, cut: DataFrame, candidates: DataFrame) -> DataFrame:
    """Records whose pieces lie in more than one chunk: at most one for each chunk end."""
    names = [f.split()[0] for f in _HEADER.split(", ")]
    out_schema = f"file string, offset long, {_HEADER}, payload_bytes long, payload_digest string"
    if cut.isEmpty():
        return pieces.sparkSession.createDataFrame([], out_schema)
    first = cut.select("file", (F.col("base") + F.col("at")).alias("lo"), (F.col("base") + F.col("ends")).alias("hi"), "offset", *names)
    wanted = (
        first.join(_spans(candidates), "file").where("base < hi and base + n > lo").select("file", "block", "base", "lo", "hi", "offset")
    )
    held = _numbered(pieces).join(wanted.select("file", "block").distinct(), ["file", "block"], "left_semi")

    def take(key: tuple, held: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        rows, at = [], int(want["base"].iloc[0])
        for v in held.sort_values("i")["value"]:
            for lo, hi, offset in zip(want["lo"], want["hi"], want["offset"], strict=True):
                if lo <= at < hi:
                    rows.append((key[0], int(offset), at, bytes(v)))
            at += len(v) + len(MAGIC)
        return pd.DataFrame(rows, columns=["file", "offset", "at", "value"])

    parts = (
        held.groupBy("file", "block")
        .cogroup(wanted.groupBy("file", "block"))
        .applyInPandas(take, "file string, offset long, at long, value binary")
    )

    def join(group: pd.DataFrame) -> pd.DataFrame:
        data = MAGIC.encode().join(group.sort_values("at")["value"])
        head, _, body = data.partition(b"\r\n\r\n")
        content = _payload(body[: int(_fields(head)["Content-Length"] or 0)])
        one = group[["file", "offset"]].iloc[:1]
        return one.assign(payload_bytes=len(content), payload_digest=hashlib.sha1(content).hexdigest())

    made = parts.groupBy("file", "offset").applyInPandas(join, "file string, offset long, payload_bytes long, payload_digest string")
    return first.drop("lo", "hi").join(made, ["file", "offset"]).select("file", "offset", *names, "payload_bytes", "payload_digest")


def _numbered(pieces: DataFrame) -> DataFrame:
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, i = None, 0
        for batch in batches:
            files, blocks = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            places = []
            for f, b in zip(files, blocks, strict=True):
                if (f, b) != now:
                    now, i = (f, b), 0
                places.append(i)
                i += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, type=pa.int64())], names=["value", "file", "block", "i"])

    return pieces.mapInArrow(number, "value binary, file string, block long, i long")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per record with its full payload's digest and size; revisits take them from the
    response that they refer to, whose page_id is ``refers_to``. A revisit whose response is
    missing keeps its declared digest and a null size."""
    first = records.where("record_type = 'response'").groupBy("record_id").agg(
        F.max("page_id").alias("_page"), F.max("payload_bytes").alias("_bytes"), F.max("payload_digest").alias("_digest")
    ).withColumnRenamed("record_id", "_id")
    revisits = records.where("record_type = 'revisit'").join(first, F.col("refers_to_id") == F.col("_id"), "left").select(
        "page_id", F.col("_bytes").alias("payload_bytes"), F.coalesce("_digest", "declared_digest").alias("payload_digest"), "record_type", F.col("_page").alias("refers_to"), "url"
    )
    whole = records.where("record_type <> 'revisit'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), "url")
    return whole.unionByName(revisits)


def archive_round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back and resolve revisits."""
    path = new_path(pages.sparkSession, "warc")
    write_warc(pages, path, least)
    return resolve_revisits(read_warc(pages.sparkSession, path))
