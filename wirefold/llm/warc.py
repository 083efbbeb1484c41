"""WARC archives: a writer, and a reader that verifies record boundaries as a chain.

Writer.  One record per page.  Of records with equal payloads of at least
``min_bytes`` bytes, the one with the largest page id is a response and the
others revisit it (no block, the payload's digest and length in the header).
Pages are joined with the largest id of their digest; the digests' table is
written first, so that the join reads two plain exchanges and adaptive
execution can split a hot digest.  Spark's text writer puts the records into
files in the shared folder, uncompressed unless told otherwise: Spark splits
such archives into blocks, so a large one is not a single task's work (gzip
archives are read too, each as one block).

Reader.  Spark's text source splits archives at the magic line, wherever it
occurs.  Each task emits, for every such place with a readable header, a
candidate: its offset and the offset of its successor by Content-Length.  A
magic line inside a payload makes candidates too, but no chain from the start
of the file leads there.  Within a block, pointers to successors are doubled
until every candidate knows where its chain leaves the block.  Across blocks
the same is done on the few places where chains enter a block: pointer jumping
from the file start, in as many rounds as the logarithm of the file's blocks.
Of each block then those candidates are records that its entry reaches, again
by doubling; all others are rejected.  A payload that holds the magic line is
cut by the text source; such records, and no others, are read a second time and
put together, joined with their parts on cells of ``CELL`` bytes.

Edge cases: a null html is an empty payload; an empty payload has 0 bytes, so
with ``min_bytes`` 0 empty pages revisit one another; a null page id counts as
smaller than any other, and if all ids of a payload are null all are
responses; rows that repeat the largest page id of a payload are all
responses; a null url has no target header, line breaks in a url are
percent-encoded; an empty table gives an empty archive and an empty result;
further columns are ignored, whatever their names; a payload of any length is
one record, read whole by one task.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wirefold.llm.common import Scratch, arrow_map, bounded, text_session

MAGIC = "WARC/1.0\r\n"
#: Records that hold magic lines are joined with their parts by cells of so many bytes of a file.
CELL = 1 << 16
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hexed: Column) -> Column:
    """Base32 of a SHA-1 in hex: each five hex digits are four characters."""
    chars = []
    for g in range(8):
        value = F.conv(F.substring(hexed, 5 * g + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            chars.append(F.substring(F.lit(_BASE32), F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*chars)


def with_types(pages: DataFrame, scratch: Scratch, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload and its digest, record_type and refers_to of every page."""
    rows = bounded(pages).select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    rows = rows.withColumn("sha", F.sha1(F.col("payload").cast("binary")))
    rows = rows.withColumn("n", F.octet_length("payload").cast("long"))
    groups = rows.where(F.col("n") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("_rows"))
    groups = scratch.keep(groups.where("_rows > 1").select("sha", "first_id"), "groups")
    rows = rows.join(groups, "sha", "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.select(
        "page_id",
        "url",
        "payload",
        "n",
        base32(F.col("sha")).alias("digest"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first_id")).alias("refers_to"),
    )


def record(url: Column) -> Column:
    """The text of one record, but for the last line feed (which the text writer adds)."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.col("record_type") == "revisit"
    page = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    return F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", page("page_id")),
        F.coalesce(line("WARC-Target-URI", F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Payload-Length", F.col("n").cast("string")),
        F.when(revisit, line("WARC-Refers-To", page("refers_to"))).otherwise(""),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
        F.lit("\r\n\r"),
    )


def write(pages: DataFrame, scratch: Scratch, path: str, min_bytes: int = 0, compression: str = "none") -> None:
    with_types(pages, scratch, min_bytes).select(record(F.col("url")).alias("value")).write.mode("overwrite").option("compression", compression).text(path)


# --- reading -----------------------------------------------------------------


def parse_header(chunk: bytes) -> tuple[int, dict[str, str]] | None:
    """End of the header and its fields, or None if the bytes after a magic line are no header."""
    end = chunk.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in chunk[:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            return None
        fields[name.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdecimal() or "warc-type" not in fields:
        return None
    return end + 4, fields


def page_of(urn: str | None) -> int | None:
    """The page id of a record id."""
    body = (urn or "")[len("<urn:page:") : -1]
    try:
        return int(body)
    except ValueError:
        return None


_FOUND = pa.schema(
    [
        ("file", pa.string()),
        ("block", pa.int64()),
        ("off", pa.int64()),
        ("next", pa.int64()),
        ("exit", pa.int64()),
        ("covered", pa.int64()),
        ("body", pa.int64()),
        ("type", pa.string()),
        ("page_id", pa.int64()),
        ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("digest", pa.string()),
        ("claimed", pa.string()),
        ("open", pa.bool_()),
    ]
)


class _Block:
    """Candidates of one block of a file; offsets count from the block's first chunk."""

    def __init__(self, file: str, start: int):
        self.file, self.start, self.at, self.rows = file, start, 0, []

    def add(self, chunk: bytes) -> None:
        # a chunk lies behind a magic line, but for the first chunk of a file
        first = self.at == 0 and self.start == 0
        off = self.at - len(MAGIC)
        self.at += len(chunk) + len(MAGIC)
        if first or (found := parse_header(chunk)) is None:
            return
        end, f = found
        size = int(f["content-length"])
        stop = end + size
        whole = len(chunk) >= stop + 4 and chunk[stop : stop + 4] == b"\r\n\r\n"
        if not whole and len(chunk) >= stop + 4:
            return  # the header's length does not lead to a record's end
        claimed = f.get("warc-payload-digest", "").removeprefix("sha1:")
        revisit = f["warc-type"] == "revisit"
        if revisit:
            n, digest = int(f.get("warc-payload-length", "0")), claimed
        elif whole:
            n, digest = size, base64.b32encode(hashlib.sha1(chunk[end:stop]).digest()).decode()
        else:
            n, digest = size, None
        self.rows.append((off, off + len(MAGIC) + stop + 4, off + len(MAGIC) + end, f["warc-type"], page_of(f.get("warc-record-id")), page_of(f.get("warc-refers-to")), n, digest, claimed, not revisit and not whole))

    def table(self) -> pa.RecordBatch:
        rows = self.rows
        off = np.array([r[0] for r in rows], np.int64)
        nxt = np.array([r[1] for r in rows], np.int64)
        # pointer jumping inside the block: `jump` doubles until every chain has left the block or broken off
        last = self.at - len(MAGIC)
        jump = successors(off, nxt)
        while (jump != (twice := jump[jump])).any():
            jump = twice
        # a chain that stops short of the block's last magic line has broken off: it has no exit
        ends = np.where(nxt[jump] >= last, nxt[jump], -1)
        k = len(rows)
        by = list(zip(*rows)) if rows else [()] * 10
        return pa.RecordBatch.from_arrays(
            [
                pa.array([self.file] * (k + 1), pa.string()),
                pa.array([self.start] * (k + 1), pa.int64()),
                pa.array([*by[0], None], pa.int64()),
                pa.array([*by[1], None], pa.int64()),
                pa.array([*ends.tolist(), None], pa.int64()),
                pa.array([None] * k + [self.at], pa.int64()),  # the last row tells how far the block reaches
                pa.array([*by[2], None], pa.int64()),
                pa.array([*by[3], None], pa.string()),
                pa.array([*by[4], None], pa.int64()),
                pa.array([*by[5], None], pa.int64()),
                pa.array([*by[6], None], pa.int64()),
                pa.array([*by[7], None], pa.string()),
                pa.array([*by[8], None], pa.string()),
                pa.array([*by[9], False], pa.bool_()),
            ],
            schema=_FOUND,
        )


def successors(off: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Index of each candidate's successor (``off`` rises), its own where the successor is not among them."""
    if not len(off):
        return np.zeros(0, np.int64)
    to = np.searchsorted(off, nxt)
    inside = off[np.minimum(to, len(off) - 1)] == nxt
    return np.where(inside, to, np.arange(len(off)))


def reached(off: np.ndarray, nxt: np.ndarray, entry: int) -> np.ndarray:
    """Which candidates the one at ``entry`` reaches: all that are marked jump, and jumps double, until no more are marked."""
    hit = off == entry
    jump = successors(off, nxt)
    while True:
        n = np.count_nonzero(hit)
        hit[jump[hit]] = True
        if np.count_nonzero(hit) == n:
            return hit
        jump = jump[jump]


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """The archives' bytes, cut at each magic line, with file and block."""
    return text_session(spark).read.option("lineSep", MAGIC).text(path).select(F.col("value").cast("binary"), "_metadata.file_path", "_metadata.file_block_start")


def _candidates(batches):
    block = None
    for b in batches:
        files, starts = b.column(1).to_pylist(), b.column(2).to_pylist()
        for chunk, file, start in zip(b.column(0), files, starts):
            if block is None or (block.file, block.start) != (file, start):
                if block:
                    yield block.table()
                block = _Block(file, start)
            block.add(chunk.as_buffer().to_pybytes())
    if block:
        yield block.table()


def records(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """Every record that the chains from the files' starts reach.

    Columns: file, off, type, page_id, payload_bytes, digest (of the payload as
    read; a revisit's as claimed), claimed, refers_to.
    """
    ddl = "file string, block long, off long, next long, exit long, covered long, body long, type string, page_id long, refers_to long, payload_bytes long, digest string, claimed string, open boolean"
    found = scratch.keep(arrow_map(chunks(spark, path), _candidates, ddl), "candidates")
    bases = _bases(found.where("covered is not null").select("file", "block", "covered"))
    rows = found.where("covered is null").drop("covered").join(bases, ["file", "block"])
    rows = rows.withColumns({c: F.col(c) + F.col("base") for c in ("off", "next", "body")} | {"exit": F.when(F.col("exit") >= 0, F.col("exit") + F.col("base"))}).drop("base")
    rows = scratch.keep(_verified(rows, bases, scratch), "records")
    if rows.where("open").isEmpty():
        return rows.drop("next", "body", "open")
    whole = _put_together(spark, path, rows.where("open"), bases, scratch)
    rows = rows.join(whole, ["file", "off"], "left")
    return rows.withColumn("digest", F.coalesce("digest", "joined")).drop("next", "body", "open", "joined")


def _bases(sizes: DataFrame) -> DataFrame:
    """Where each block's first chunk lies in its file (a file has few blocks)."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("file", "block", F.coalesce(F.sum("covered").over(before), F.lit(0)).alias("base"))


def _verified(rows: DataFrame, bases: DataFrame, scratch: Scratch) -> DataFrame:
    """The candidates that the chain from their file's start reaches."""
    rows = scratch.keep(rows, "placed")
    blocks = bases.groupBy("file").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    # chains enter a block at offset 0 of the file, or where one of another block leaves it: a few places a block
    start = rows.select("file").distinct().withColumn("off", F.lit(0).cast("long"))
    places = start.unionByName(rows.where("exit is not null").select("file", F.col("exit").alias("off")).distinct()).distinct()
    jump = scratch.keep(rows.select("file", "block", "off", "exit").join(places, ["file", "off"]), "entries")
    into = jump.select("file", "block", "off")
    jump = jump.where("exit is not null").select("file", "off", F.col("exit").alias("to"))
    hit, step = start, 1
    while step < 2 * blocks:
        more = hit.join(jump, ["file", "off"]).select("file", F.col("to").alias("off"))
        hit = scratch.keep(hit.unionByName(more).distinct(), f"reached{step}")
        if 2 * step < 2 * blocks:
            second = jump.select("file", F.col("off").alias("to"), F.col("to").alias("far"))
            jump = scratch.keep(jump.join(second, ["file", "to"]).select("file", "off", F.col("far").alias("to")), f"jump{step}")
        step *= 2
    entries = into.join(hit, ["file", "off"]).select("file", "block", F.col("off").alias("entry"))

    def chain(key, table):
        t = table.sort_by("off")
        off, nxt = t.column("off").to_numpy(), t.column("next").to_numpy()
        return t.filter(pa.array(reached(off, nxt, t.column("entry")[0].as_py()))).drop_columns(["entry", "block", "exit"])

    held = rows.join(entries, ["file", "block"])
    columns = [c for c in rows.columns if c not in ("block", "exit")]
    return held.groupBy("file", "block").applyInArrow(lambda key, t: chain(key, t).select(columns), rows.select(columns).schema)


def _put_together(spark: SparkSession, path: str, opened: DataFrame, bases: DataFrame, scratch: Scratch) -> DataFrame:
    """Digests of payloads that hold the magic line: their chunks are read again and joined in order."""
    kept = pa.schema([("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("chunk", pa.binary())])

    def place(batches):
        key, at = None, 0
        for b in batches:
            out = []
            for chunk, file, start in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if key != (file, start):
                    key, at = (file, start), 0
                out.append((file, start, at, chunk.as_buffer().to_pybytes()))
                at += len(out[-1][3]) + len(MAGIC)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, kept.types)], schema=kept)

    # a chunk belongs to the record whose span holds its first byte; spans are cut into cells, so that both sides have a key
    cell = lambda c: F.floor(F.col(c) / CELL)
    spans = opened.select("file", "off", "next", "body", "payload_bytes", F.explode(F.sequence(cell("off"), cell("next"))).alias("cell"))
    spans = scratch.keep(spans, "open")
    parts = arrow_map(chunks(spark, path), place, "file string, block long, at long, chunk binary")
    parts = parts.join(bases, ["file", "block"]).withColumn("at", F.col("at") + F.col("base")).withColumn("cell", cell("at"))
    held = parts.join(spans, ["file", "cell"]).where((F.col("at") > F.col("off")) & (F.col("at") < F.col("next")))

    def join(key, table):
        t = table.sort_by("at")
        body, size = t.column("body")[0].as_py(), t.column("payload_bytes")[0].as_py()
        first = t.column("at")[0].as_py()
        raw = MAGIC.encode().join(t.column("chunk").to_pylist())[body - first : body - first + size]
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode() if len(raw) == size else None
        return pa.table({"file": [key[0].as_py()], "off": [key[1].as_py()], "joined": [digest]})

    return held.select("file", "off", "at", "chunk", "body", "payload_bytes").groupBy("file", "off").applyInArrow(join, "file string, off long, joined string")


def op2(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    write(pages, scratch, scratch.path("archives"), min_bytes)
    back = records(spark, scratch.path("archives"), scratch)
    return back.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h))::BIGINT AS n, sha1(h) AS x FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS m FROM q),
d AS (SELECT page_id, n, m, list_transform(range(0, 32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               (((('0x' || substr(x, (5 * (i // 4) + 1)::INT, 5))::INTEGER) >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)) AS c FROM g)
SELECT page_id, n AS payload_bytes, array_to_string(c, '') AS payload_digest,
       CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = m THEN NULL ELSE m END AS refers_to FROM d
"""
