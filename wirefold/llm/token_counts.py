"""Token counts of byte-level BPE without token ids.

A text splits into pre-tokens, and a pre-token's pieces do not depend on its
surroundings.  So pieces are counted once for each distinct pre-token of the
corpus, and a document's count is the sum over its own pre-token frequencies:

1. each task sends its distinct pre-tokens with their frequencies; they are
   summed, and the library counts the pieces of each, once;
2. documents' pre-token frequencies are joined with that table.  Most of a
   text's pre-tokens are among the commonest ones, so these (at most ``COMMON``
   of at most ``COMMON_BYTES`` bytes each, whatever the corpus) are handed to
   every task and joined there; the others go through an ordinary equi-join,
   which none of them can skew, as none is common;
3. both parts are summed by document.

The pre-token pattern is run here on texts of characters for which this
pattern engine and the library's agree; any other text is cut by the library's
own pre-tokenizer, and its pre-tokens take the same way.  Special strings count
as the library's default has it: one token each, cutting the text.

Edge cases: a null or empty text has 0 bytes and 0 tokens; repeated rows are
each counted, also those that share an id; a null id is an id; texts and
pre-tokens of any length are counted whole; frequencies that tie at the border
of the common pre-tokens stay out together; an empty table gives an empty
result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.llm.common import Scratch, arrow_map, bounded

LIMIT = 1024
#: Pre-tokens that every task knows, and the most bytes that one of them has.
COMMON = 400_000
COMMON_BYTES = 64
#: Distinct pre-tokens that a task holds before it sends them.
HELD = 400_000
#: Rows of a batch that a task sends.
ROWS = 1 << 16

#: The pattern of byte-level pre-tokens, for the characters of PLAIN.
_LETTER = r"A-Za-zªµºÀ-ÖØ-öø-ɏΑ-ΡΣ-ϿЀ-ҁҊ-ԯ"
_NUMBER = r"0-9²³¹¼-¾"
_PRE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\t\n\r {_LETTER}{_NUMBER}]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+")
#: A text of these characters only: ASCII, Latin, Greek and Cyrillic letters, common punctuation.
_ODD = re.compile(rf"[^\t\n\r\x20-\x7e{_LETTER}{_NUMBER}¡-©«¬®-±´¶-¸»¿×÷‐-‧‰-⁞€]")
# ϶ is a symbol among the Greek letters
_ODD_LETTER = "϶"


class Splitter:
    """Pre-tokens of texts, and their pieces, with one tokenizer file."""

    def __init__(self, path: str):
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """A text's pre-token frequencies, and the special strings in it."""
        parts = self.special.split(text) if self.special and self.special.search(text) else [text]
        out: Counter = Counter()
        for part in parts:
            if _ODD.search(part) or _ODD_LETTER in part:
                out.update([part[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part)])
            else:
                out.update(_PRE.findall(part))
        return out, len(parts) - 1

    def pieces(self, tokens: list[str]) -> list[int]:
        out = []
        for lo in range(0, len(tokens), 10_000):
            out += [len(e.ids) for e in self.library.encode_batch(tokens[lo : lo + 10_000], add_special_tokens=False)]
        return out


@lru_cache(2)
def splitter(path: str) -> Splitter:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Splitter(path)


def vocabulary(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Every distinct pre-token ``p`` of the texts, how often it stands there, and its pieces."""

    def send(held: Counter):
        tokens = list(held)
        for lo in range(0, len(tokens), ROWS):
            part = tokens[lo : lo + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([held[t] for t in part], pa.int64())], ["p", "n"])

    def collect(batches):
        split, held = splitter(path), Counter()
        for b in batches:
            for t in b.column(0):
                if t := t.as_py():
                    held.update(split.frequencies(t)[0])
                    if len(held) > HELD:
                        yield from send(held)
                        held = Counter()
        yield from send(held)

    def count(batches):
        split = splitter(path)
        for b in batches:
            yield b.append_column("pieces", pa.array(split.pieces(b.column(0).to_pylist()), pa.int64()))

    found = arrow_map(docs.select(F.col(text).cast("string").alias("t")), collect, "p string, n long")
    return arrow_map(found.groupBy("p").agg(F.sum("n").alias("n")), count, "p string, n long, pieces long")


def common_of(table: DataFrame, most: int) -> DataFrame:
    """At most ``most`` of the table's commonest short pre-tokens: all from some frequency on, found by a histogram."""
    short = table.where(F.octet_length("p") <= COMMON_BYTES)
    level = F.floor(F.log2("n") * 8)
    levels = sorted(map(tuple, short.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)  # at most 8 x 63 rows
    total, least = 0, None
    for at, n in levels:
        if total + n > most:
            break
        total, least = total + n, at
    return short.where(level >= least) if least is not None else short.limit(0)


@lru_cache(1)
def _known(packed: bytes) -> dict[str, int]:
    table = pa.ipc.open_stream(zlib.decompress(packed)).read_all()
    return dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist()))


def _packed(common: DataFrame) -> bytes:
    table = common.select("p", "pieces").toArrow()  # at most COMMON x COMMON_BYTES bytes
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return zlib.compress(sink.getvalue().to_pybytes(), 1)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, UTF-8 bytes, tokens, and whether they exceed ``limit``, of every row."""
    docs = bounded(docs)
    scratch = Scratch(docs.sparkSession, "tokens")
    table = scratch.keep(vocabulary(docs, path, text), "vocabulary")
    packed = _packed(common_of(table, COMMON))
    kind = docs.schema[key].dataType.simpleString()
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))

    def join(batches):
        split, known = splitter(path), _known(packed)
        # a row's number tells rows of one id apart; the table that holds it is written once
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                counts, rows, tokens, times = [], [], [], []
                for i, t in enumerate(part.column(2).to_pylist()):
                    freq, total = split.frequencies(t) if t else ({}, 0)
                    for p, n in freq.items():
                        if (pieces := known.get(p)) is None:
                            rows.append(row + i)
                            tokens.append(p)
                            times.append(n)
                        else:
                            total += pieces * n
                    counts.append(total)
                n, m = part.num_rows, len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([np.arange(row, row + n), np.array(rows, np.int64)])),
                        pa.concat_arrays([part.column(0), pa.nulls(m, part.column(0).type)]),
                        pa.concat_arrays([part.column(1), pa.nulls(m, pa.int64())]),
                        pa.concat_arrays([pa.nulls(n, pa.string()), pa.array(tokens, pa.string())]),
                        pa.array([*counts, *times], pa.int64()),
                    ],
                    ["row", "key", "n_bytes", "p", "n"],
                )
                row += n

    rows = docs.select(F.col(key).alias("key"), F.octet_length(body).cast("long").alias("n_bytes"), body.alias("t"))
    met = scratch.keep(arrow_map(rows, join, f"row long, key {kind}, n_bytes long, p string, n long"), "frequencies")
    heads = met.where("p is null").select("row", "key", "n_bytes", F.col("n").alias("tokens"))
    rest = met.where("p is not null").join(table.select("p", "pieces"), "p").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    out = heads.join(rest, "row", "left").select(F.col("key").alias(key), "n_bytes", (F.col("tokens") + F.coalesce("more", F.lit(0))).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op7(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
