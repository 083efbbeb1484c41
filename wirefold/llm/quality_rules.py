"""Quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` evaluates every rule once for each document and stores the
measurements and a bitmask of failures.  A policy is a versioned mask over
that ledger, so a new policy or an ablation never reads a text again:
``apply_policy`` is one bitwise AND, ``ablate`` a bitwise aggregation over at
most 2^rules distinct masks.

Edge cases: a null text counts as an empty one; an empty text has zero words
and fails ``few_words``; repeated rows are each judged; measurements at a
rule's bound pass it (the rules' comparisons are strict, but for ``n_dup_lines
>= 5``); an empty table gives an empty ledger; further columns of the input are
ignored, whatever their names.  Every step is a
projection: nothing is shuffled, and a text of any length stays in its row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirefold.llm.common import Scratch, bounded

#: The characters between words.
SPACES = " \t\n\x0b\f\r"
SPACE = r"[\x20\x09-\x0D]+"

#: The symbols that n_symbols counts.
SYMBOLS = "#*$%&|<>"

#: Rules in bit order; a rule's bit is set where its condition holds (nulls cannot occur).
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "shouting": "10 * n_bangs > 3 * n_words",
    "repeated_lines": "n_dup_lines >= 5 AND 2 * n_dup_lines > n_lines",
    "long_words": "word_chars > 25 * n_words",
    "short_words": "word_chars < 2 * n_words",
}

#: The rules that make base_failed.
BASE = ("few_words", "repeated_words")


def mask_of(rules) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


#: Versioned policies: the rules that reject.
POLICIES: dict[int, int] = {
    1: mask_of(BASE),
    2: mask_of([*BASE, "symbols", "shouting"]),
    3: mask_of(RULES),
}
CURRENT = 3


def _repeats(df: DataFrame, words: Column) -> DataFrame:
    """Add n_repeat_words: words covered by a 5-word window that the text holds twice or more.

    Window hashes of a text are compared in its own row.  Only where some
    window repeats are (hash, position) pairs sorted; equal neighbours are the
    repeats, and the words they cover follow from the gaps between positions.
    """
    none = F.expr("cast(array() as array<bigint>)")
    df = df.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))
    df = df.withColumn("n_words", F.size("_h").cast("long"))
    df = df.withColumn(
        "_win",
        F.when(
            F.size("_h") >= 5,
            F.transform(F.slice("_h", F.lit(1), F.size("_h") - 4), lambda h, i: F.xxhash64(h, *[F.get("_h", i + k) for k in range(1, 5)])),
        ).otherwise(none),
    )
    df = df.withColumn("_twice", F.size(F.array_distinct("_win")) < F.size("_win"))
    df = df.withColumn(
        "_sorted",
        F.when(
            F.col("_twice"),
            F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    same = lambda s, i, k: F.get("_sorted", i + k)["h"].eqNullSafe(s["h"])
    df = df.withColumn(
        "_at",
        F.when(
            F.col("_twice") & (F.size("_sorted") > 0),
            F.sort_array(F.transform(F.filter("_sorted", lambda s, i: same(s, i, -1) | same(s, i, 1)), lambda s: s["i"])),
        ),
    )
    covered = F.aggregate(
        F.transform("_at", lambda p, i: F.least(F.lit(5), F.coalesce(F.get("_at", i + 1) - p, F.lit(5)))),
        F.lit(0).cast("long"),
        lambda total, n: total + n,
    )
    df = df.withColumn("_covered", F.when(F.col("_twice") & (F.size("_at") > 0), covered).otherwise(F.lit(0).cast("long")))
    # The row number keeps the optimizer from copying these expressions into filters on the result (it does not move
    # filters below a column that is not deterministic); copies would repeat one another many times over.
    df = df.withColumn("_row", F.monotonically_increasing_id())
    return df.withColumn("n_repeat_words", F.when(F.col("_row") >= 0, F.col("_covered")))


def _without(text: str, chars: str) -> Column:
    return F.translate(text, chars, "")


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, the measurements, ``fail_bits``.

    A row holds its text once and, for a time, its words; what follows from
    characters alone is measured on the text.
    """
    df = bounded(docs).select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    chars = F.length("_text").cast("long")
    df = df.select(
        key,
        F.btrim("_text", F.lit(SPACES)).alias("_text"),
        F.length(_without("_text", SPACES)).cast("long").alias("word_chars"),
        (chars - F.length(_without("_text", SYMBOLS))).alias("n_symbols"),
        (chars - F.length(F.replace("_text", F.lit("!")))).alias("n_bangs"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    words = F.when(F.col("_text") == "", F.expr("cast(array() as array<string>)")).otherwise(F.split("_text", SPACE))
    df = _repeats(df, words)
    bits = F.lit(0).cast("long")
    for i, condition in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    columns = [key, "n_words", "word_chars", "n_symbols", "n_bangs", "n_lines", "n_dup_lines", "n_repeat_words"]
    return df.select(*columns, bits.alias("fail_bits"))


def apply_policy(book: DataFrame, version: int = CURRENT) -> DataFrame:
    """Add ``base_failed`` and ``kept`` under a policy to a ledger."""
    return book.withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(mask_of(BASE))) != 0).withColumn(
        "kept", F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version] | mask_of(BASE))) == 0
    )


def kept_documents(docs: DataFrame, version: int = CURRENT, text: str = "text") -> DataFrame:
    """The documents that a policy keeps, all columns as they were."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(text).alias("_body"))
    return apply_policy(ledger(rows, "_doc", "_body"), version).where("kept").select("_doc.*")


def ablate(book: DataFrame, version: int = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those kept if it alone were dropped.

    The ledger is first summed over its distinct masks (at most 2^rules rows,
    combined on the map side), then the masks are read bit by bit.
    """
    mask = POLICIES[version]
    masks = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(RULES) if mask >> i & 1])
    return (
        masks.select("bits", "n", F.inline(rules))
        .groupBy("rule")
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
            F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("regained"),
        )
    )


def op10(docs: DataFrame) -> DataFrame:
    return apply_policy(ledger(docs)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits"
    )


def ablation(docs: DataFrame) -> DataFrame:
    """``ablate`` of every policy's version over the documents' ledger."""
    book = Scratch(bounded(docs).sparkSession, "ledger").keep(ledger(docs).select("fail_bits"), "bits")
    tables = [ablate(book, v).select(F.lit(v).alias("version"), "rule", "failed", "regained") for v in POLICIES]
    return reduce(DataFrame.unionByName, tables)


_BITS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + 4], ' ')) AS c FROM p),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, (SELECT unnest(range(0, 5)) AS k) WHERE c >= 2 GROUP BY doc_id),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (length(t) - length(replace(t, '!', '')))::BIGINT AS n_bangs, len(ls) AS n_lines,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_bangs > 3 * n_words THEN 8 ELSE 0 END
        + CASE WHEN n_dup_lines >= 5 AND 2 * n_dup_lines > n_lines THEN 16 ELSE 0 END + CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END
        + CASE WHEN word_chars < 2 * n_words THEN 64 ELSE 0 END)::BIGINT AS fail_bits FROM m)
"""

OP10_SQL = (
    _BITS_SQL
    + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 127) = 0 AS kept, fail_bits FROM f
"""
)

ABLATION_SQL = (
    _BITS_SQL
    + f""", o AS (SELECT * FROM (VALUES {", ".join(f"({v}, '{r}', {mask}, {1 << i})" for v, mask in POLICIES.items() for i, r in enumerate(RULES) if mask >> i & 1)}) AS t(version, rule, mask, bit))
SELECT version, rule, count(*) FILTER (WHERE fail_bits & bit <> 0) AS failed, count(*) FILTER (WHERE fail_bits & mask = bit) AS regained
FROM o LEFT JOIN f ON true GROUP BY version, rule
"""
)
