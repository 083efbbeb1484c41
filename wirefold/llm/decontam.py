"""Benchmark decontamination by templates.

Texts become templates: numbers, names and units turn into typed placeholders,
whose values are kept as slots; letters A-Z lower-cased, punctuation is blank.
Windows of ``WIDTH`` template words of documents and benchmark items are joined
on their hash, so a question asked again with other numbers or names meets its
original.  A pair then passes the slot check: each value of the item must stand
for one value throughout (a re-parameterised question changes a value everywhere
alike), or the pair is chance likeness of templates.  A document is contaminated
by an item if some reading of the matched windows passes that check and makes
up at least ``MIN_COVER`` of the item's: the windows with the item's own values,
all windows of the document, or one occurrence.  An occurrence is a difference
of positions, alone or with the windows nearest to it (for inserted and left-out
words), so an occurrence that agrees is not outvoted by others.  Whatever its
share of the item, ``MIN_RUN`` consecutive words that pass the check do too.

The benchmark may be of any size: documents' windows are first sieved through a
Bloom filter of the item windows, a bitmap of bounded size; what passes goes
through an ordinary equi-join on the hash.  Only that bitmap (at most 8 MB) is broadcast.
The matches of a text and an item are judged together in one worker.

Windows that more than ``HOT`` items hold (a common instruction line) count
towards ``MIN_COVER`` like any other, but not towards a run, as they are no one
item's words.  They do not bring documents and items together: of each item the
commonest such windows are set aside, fewer than ``MIN_COVER`` of its windows,
so a match that passes has one of the others; pairs that these others have
brought together then get the windows set aside by a second equi-join.

Items without a usable window (short or dense with numbers) are searched as a
whole by ``whole_matches``: their literal words, at any length, and from ``WIDTH``
words with ``MIN_PLAIN`` plain ones on also their template with the slot check.
That takes one more pass over the documents for each distinct length of such
items, and none if there are none.  ``contaminated`` is both ways together.

Edge cases: a null or empty text has no windows and no words; an item of one
word matches every document with that word; a window with fewer than
``MIN_PLAIN`` plain words is not used; repeated items each give their own
rows; rows with the same doc_id are versions of one document, each judged by
itself; a null doc_id is one document id of its own, so is a null item_id; of readings that pass the first is
reported; texts of any length are searched whole; empty tables give an empty
result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.llm.common import Scratch, arrow_map, blocks, bounded, mix, window_hashes, word_hashes

WIDTH = 6
MIN_PLAIN = 4
MIN_COVER = 0.4
MIN_RUN = 13
MIN_AGREE = 0.8
#: A window of more items than this is common.
HOT = 64
#: Size of the sieve in bits, at least and at most; between them 16 bits for each window of the benchmark.  Documents' windows
#: pass by chance with the share of set bits.
SIEVE_BITS = (1 << 22, 1 << 26)

#: Words that are units behind a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres mg g kg lb lbs oz gram grams pound pounds ton tons "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros cent cents percent degree degrees km/h mph kb mb gb tb hz khz mhz ghz w kw v a".split()
)

#: One-byte words that stand for a number, a name and a unit in a template.
NUM, NAME, UNIT = b"\x01", b"\x02", b"\x03"

_NUMBER = re.compile(r"[0-9]+(?:[.,][0-9]+)*")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?![^\W_])")
_UNIT = re.compile(rf"(?<=\x01) ?({'|'.join(sorted(map(re.escape, UNITS), key=len, reverse=True))})(?![^\W_])", re.IGNORECASE)
_PUNCTUATION = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())
_BLANK = bytes.maketrans(_PUNCTUATION + bytes(range(0x04, 0x09)) + bytes(range(0x0E, 0x20)), b" " * (len(_PUNCTUATION) + 5 + 18))


def template(text: str | None) -> tuple[bytes, list[str]]:
    """The template of a text, and its slots' values in order.

    A name is a capitalised word that follows a word of the same sentence.
    """
    if not text:
        return b"", []
    for mark in "\x01\x02\x03":
        if mark in text:
            text = text.replace(mark, " ")
    spots: list[tuple[int, int, str, str]] = []  # start, end, mark, value
    for m in _NUMBER.finditer(text):
        a, b = m.span()
        if not (a and text[a - 1].isalnum()) and not text[b : b + 1].isalnum():
            spots.append((a, b, "\x01", m[0]))
            u = _UNIT.match("\x01" + text[b : b + 16], 1) if text[b : b + 1] else None
            if u:
                spots.append((b + u.start(1) - 1, b + u.end(1) - 1, "\x03", u[1].lower()))
    for m in _CAPITAL.finditer(text):
        a = m.start()
        if a >= 2 and text[a - 1] == " " and (text[a - 2].isalnum() or text[a - 2] in ",;'\"(") and (a == 0 or not text[a - 1].isalnum()):
            spots.append((a, m.end(), "\x02", m[0].lower()))
    if not spots:
        return text.encode("utf-8", "surrogatepass").lower().translate(_BLANK), []
    spots.sort()
    out, at, values = [], 0, []
    for a, b, mark, value in spots:
        if a < at:
            continue
        out += [text[at:a], " ", mark, " "]
        values.append(value)
        at = b
    out.append(text[at:])
    return "".join(out).encode("utf-8", "surrogatepass").lower().translate(_BLANK), values


_MARKS = word_hashes([b" ".join((NUM, NAME, UNIT))])[0]


def windows(texts: list[str | None], width: int = WIDTH):
    """For each text (hashes of its usable windows, their positions, slot index before each word, slot values)."""
    made = [template(t) for t in texts]
    for lo, hi in blocks(made, lambda m: len(m[0])):
        words, counts = word_hashes([m[0] for m in made[lo:hi]])
        grams = window_hashes(words, width)
        slot = np.isin(words, _MARKS)
        before = np.concatenate([[0], np.cumsum(slot)])
        at = 0
        for (_, values), n in zip(made[lo:hi], counts.tolist()):
            k = max(0, n - width + 1)
            own = grams[at : at + k]
            held = before[at + width : at + width + k] - before[at : at + k]
            fit = np.flatnonzero(width - held >= MIN_PLAIN)
            yield own[fit], fit, before[at : at + n + 1] - before[at], values
            at += n


def _rows(ids: pa.Array, texts: list, name: str, sieve: np.ndarray | None) -> tuple[pa.RecordBatch, list[int]]:
    """One row for each window of a text that passes the sieve, and the index of its text."""
    who, hashes, places, slots = [], [], [], []
    for i, (own, pos, before, values) in enumerate(windows(texts)):
        if sieve is not None and len(own):
            hit = _passes(own, sieve)
            own, pos = own[hit], pos[hit]
        for h, p in zip(own.tolist(), pos.tolist()):
            who.append(i)
            hashes.append(h)
            places.append(p)
            slots.append(values[before[p] : before[p + WIDTH]])
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(who, pa.int64())), pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(places, pa.int32()), pa.array(slots, pa.list_(pa.string()))],
        [name, "h", "pos", "slots"],
    ), who


def _passes(hashes: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    bit = hashes % np.uint64(8 * len(sieve))
    return (sieve[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def item_windows(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """``_item``, h, pos, slots of every benchmark item's usable windows."""
    kind = benchmark.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield _rows(b.column(0), b.column(1).to_pylist(), "_item", None)[0]

    return arrow_map(benchmark.select(F.col(key).alias("_item"), F.col(text).cast("string")), run, f"_item {kind}, h long, pos int, slots array<string>")


def _with_common(items: DataFrame, kind: str) -> DataFrame:
    """Items' windows, with ``common`` (more than HOT items hold it) and ``aside`` (it does not bring documents and items together)."""
    held = items.select("h", "_item").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("holders")).where(F.col("holders") > HOT)
    rows = items.join(held, "h", "left").withColumn("common", F.col("holders").isNotNull())
    # of an item's common windows the commonest, so many that they alone are under MIN_COVER of the item's windows
    own = rows.groupBy(F.col("_item").alias("_i")).agg(
        F.countDistinct("pos").alias("_all"), F.sort_array(F.collect_set(F.when(F.col("common"), F.struct(-F.col("holders"), "pos"))), asc=True).alias("_common")
    )
    least = F.greatest(F.ceil(F.col("_all") * MIN_COVER) - 1, F.lit(0)).cast("int")
    own = own.where(F.size("_common") > 0).select("_i", F.transform(F.slice("_common", F.lit(1), least), lambda s: s["pos"]).alias("_aside"))
    rows = rows.join(own, F.col("_item").eqNullSafe(F.col("_i")), "left")
    return rows.select("_item", "h", "pos", "slots", "common", F.coalesce(F.array_contains("_aside", F.col("pos")), F.lit(False)).alias("aside"))


def sieve_of(items: DataFrame) -> np.ndarray:
    """Bitmap of all window hashes; each task sends one bitmap."""
    size = SIEVE_BITS[0]
    n = items.count()
    while size < 16 * n and size < SIEVE_BITS[1]:
        size *= 2

    def run(batches):
        bits = np.zeros(size, bool)
        for b in batches:
            bits[(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) % np.uint64(size)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)], pa.binary())], ["bits"])

    out = np.zeros(size // 8, np.uint8)
    # few tasks, so few bitmaps reach the driver, whatever the benchmark's size
    for r in arrow_map(items.select("h").coalesce(8), run, "bits binary").toLocalIterator():
        out |= np.frombuffer(zlib.decompress(r[0]), np.uint8)
    return out


class _Tally:
    """Item windows of a reading, and of each item value how often its commonest value stands for it."""

    def __init__(self) -> None:
        self.held: set[int] = set()
        self.counts: dict[tuple[str, str], int] = {}
        self.best: dict[str, int] = {}
        self.slots = self.agreeing = 0

    def add(self, pos: int, slots: list[str], theirs: list[str]) -> None:
        self.held.add(pos)
        for pair in zip(slots, theirs):
            n = self.counts[pair] = self.counts.get(pair, 0) + 1
            self.slots += 1
            if n > self.best.get(pair[0], 0):
                self.best[pair[0]] = n
                self.agreeing += 1

    def agrees(self) -> bool:
        return self.agreeing >= MIN_AGREE * self.slots

    def passes(self, total: int) -> bool:
        return len(self.held) >= MIN_COVER * total and self.agrees()


def _readings(met: list[tuple]) -> Iterator[_Tally]:
    """Readings of the (row, pos, at, slots, theirs, common) that a document and an item share."""
    whole, own = _Tally(), _Tally()
    for pos, slots, theirs in sorted({(m[1], m[3], m[4]) for m in met}):
        whole.add(pos, slots, theirs)
        if slots == theirs:
            own.add(pos, slots, theirs)
    yield whole
    yield own
    rows: dict[int, dict[int, list[tuple]]] = {}
    for row, pos, at, slots, theirs, _ in met:
        rows.setdefault(row, {}).setdefault(at - pos, []).append((pos, slots, theirs))
    for lines in rows.values():
        shifts = sorted(lines)
        every = len({m[0] for line in lines.values() for m in line})
        for k in sorted(range(len(shifts)), key=lambda k: -len(lines[shifts[k]])):
            tally, lo, hi = _Tally(), k, k
            for m in lines[shifts[k]]:
                tally.add(*m)
            yield tally
            # then with the other lines, nearest first, for windows that are still missing
            while len(tally.held) < every:
                lower = hi + 1 == len(shifts) or (lo > 0 and shifts[k] - shifts[lo - 1] <= shifts[hi + 1] - shifts[k])
                lo, hi = (lo - 1, hi) if lower else (lo, hi + 1)
                new = [m for m in lines[shifts[lo if lower else hi]] if m[0] not in tally.held]
                for m in new:
                    tally.add(*m)
                if new:
                    yield tally


def _long_runs(met: list[tuple]) -> Iterator[_Tally]:
    """Runs of at least ``MIN_RUN`` words that matched windows cover without a gap, of all windows and of those with the item's own values."""
    for own in (False, True):
        lines: dict[tuple[int, int], list[tuple]] = {}
        for row, pos, at, slots, theirs, common in met:
            if not common and (not own or slots == theirs):
                lines.setdefault((row, at - pos), []).append((pos, slots, theirs))
        for line in lines.values():
            line.sort()
            ends = [k for k in range(1, len(line)) if line[k][0] - line[k - 1][0] > WIDTH]
            for lo, hi in zip([0, *ends], [*ends, len(line)]):
                if line[hi - 1][0] - line[lo][0] + WIDTH >= MIN_RUN:
                    tally = _Tally()
                    for m in line[lo:hi]:
                        tally.add(*m)
                    yield tally


def _judge(met: list[tuple], total: int) -> tuple[int, int, int] | None:
    """Matched windows, slots and agreeing slots of the first reading that passes."""
    covers = len({m[1] for m in met}) >= MIN_COVER * total
    passed = next((t for t in _readings(met) if t.passes(total)), None) if covers else None
    passed = passed or next((t for t in _long_runs(met) if t.agrees()), None)
    return (len(passed.held), passed.slots, passed.agreeing) if passed else None


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """Contaminated documents: ``key``, ``item``, matched windows, the item's windows, slots, agreeing slots."""
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    scratch = Scratch(bounded(docs).sparkSession, "templates")
    items = scratch.keep(_with_common(item_windows(benchmark, item, text), item_kind), "items")
    sieve = sieve_of(items)

    def run(batches):
        # a text's number tells the positions of rows with one id apart
        at = TaskContext.get().partitionId() << 40
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                rows, who = _rows(part.column(0), part.column(1).to_pylist(), "_doc", sieve)
                yield rows.append_column("row", pa.array(np.array(who, np.int64) + at))
                at += part.num_rows

    found = arrow_map(docs.select(F.col(key).alias("_doc"), F.col(text).cast("string")), run, f"_doc {kind}, h long, pos int, slots array<string>, row long")
    found = scratch.keep(found.select("_doc", "h", "row", F.col("pos").alias("at"), F.col("slots").alias("theirs")), "found")
    columns = ["_doc", "_item", "row", "pos", "at", "slots", "theirs", "common"]
    fits = F.size("theirs") == F.size("slots")
    met = found.join(items.where("not aside").drop("aside"), "h").where(fits).select(columns)
    aside = items.where("aside").drop("aside")
    if not aside.isEmpty():
        met = scratch.keep(met, "met")
        pairs = met.groupBy("row", "_item").agg(F.count(F.lit(1)).alias("n")).select("row", F.col("_item").alias("_i"))
        more = pairs.join(aside, F.col("_i").eqNullSafe(F.col("_item"))).join(found, ["row", "h"])
        met = met.unionByName(more.where(fits).select(columns))
    total = items.groupBy("_item").agg(F.countDistinct("pos").alias("item_windows"))
    # a text's matches with an item: both are bounded, however many rows an id has
    met = met.groupBy("row", "_item").agg(F.first("_doc").alias("_doc"), F.collect_list(F.struct("row", "pos", "at", "slots", "theirs", "common")).alias("met"))
    met = met.join(total.withColumnRenamed("_item", "_t"), F.col("_item").eqNullSafe(F.col("_t"))).select("_doc", "_item", "item_windows", "met")

    def judge(batches):
        for b in batches:
            keep, out = [], []
            for i, total in enumerate(b.column(2).to_pylist()):
                found = _judge([(m["row"], m["pos"], m["at"], tuple(m["slots"]), tuple(m["theirs"]), m["common"]) for m in b.column(3)[i].as_py()], total)
                if found:
                    keep.append(i)
                    out.append(found)
            rows = b.take(pa.array(keep, pa.int64()))
            parts = [pa.array([o[k] for o in out], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), parts[0], rows.column(2), parts[1], parts[2]], [key, item, "matched", "item_windows", "slots", "agreeing"])

    return _best(arrow_map(met, judge, f"`{key}` {kind}, `{item}` {item_kind}, matched long, item_windows long, slots long, agreeing long"), key, item)


def _best(found: DataFrame, key: str, item: str) -> DataFrame:
    """One row for each document and item."""
    best = found.groupBy(key, item).agg(F.max(F.struct("item_windows", "matched", "slots", "agreeing")).alias("_best"))
    return best.select(key, item, *[F.col("_best")[c].alias(c) for c in ("matched", "item_windows", "slots", "agreeing")])


# --- items without a usable window -------------------------------------------

_INNER = re.compile(r"(?<=[0-9])[.,](?=[0-9])")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def literal(text: str | None) -> bytes:
    """The words of a text with their values; a number with a fraction stays one word."""
    for mark in "\x01\x02\x03":
        text = (text or "").replace(mark, " ")
    return _INNER.sub(lambda m: "\x01" if m[0] == "." else "\x02", text).encode("utf-8", "surrogatepass").lower().translate(_BLANK)


def _runs(words: np.ndarray, lengths: list[int], salt: int) -> Iterator[np.ndarray]:
    """For each length the hashes of all runs of so many words."""
    n = len(words)
    up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE)]))
    down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BACK)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words) * up[:n], dtype=np.uint64)])
    for k in lengths:
        m = max(0, n - k + 1)
        yield mix((sums[k : k + m] - sums[:m]) * down[:m] + np.uint64(2 * k + salt))


def _whole_items(ids: pa.Array, texts: list) -> pa.RecordBatch:
    """``_item``, h, n, literal, slots of the items that have no usable window: of their words, and of their template if it is long enough."""
    out = []
    for i, (text, (own, *_)) in enumerate(zip(texts, windows(texts))):
        if len(own):
            continue
        made, values = template(text)
        for words, salt, slots in ((word_hashes([literal(text)])[0], 0, []), (word_hashes([made])[0], 1, values)):
            n = len(words)
            if n and (not salt or n >= WIDTH and n - np.isin(words, _MARKS).sum() >= MIN_PLAIN):
                out.append((i, int(next(_runs(words, [n], salt)).view(np.int64)[0]), n, not salt, slots))
    who, hashes, sizes, kinds, slots = zip(*out) if out else [()] * 5
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(who, pa.int64())), pa.array(hashes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(kinds, pa.bool_()), pa.array(slots, pa.list_(pa.string()))],
        ["_item", "h", "n", "literal", "slots"],
    )


def _whole_rows(ids: pa.Array, texts: list, lengths: dict[bool, list[int]], sieve: np.ndarray) -> pa.RecordBatch:
    """One row for each distinct (hash, slots) of a document's runs of words that pass the sieve."""
    out = set()
    for plain, sizes in lengths.items():
        made = [(literal(t), []) if plain else template(t) for t in texts]
        for lo, hi in blocks(made, lambda m: len(m[0])):
            words, counts = word_hashes([m[0] for m in made[lo:hi]])
            text = np.repeat(np.arange(hi - lo), counts)
            ends = np.cumsum(counts)
            before = np.concatenate([[0], np.cumsum(np.isin(words, _MARKS))])
            for k, hashes in zip(sizes, _runs(words, sizes, 0 if plain else 1)):
                at = np.arange(len(hashes))
                at = at[(at + k <= ends[text[at]]) & _passes(hashes, sieve)]
                for p in at.tolist():
                    i = int(text[p])
                    first = before[ends[i] - counts[i]]
                    out.add((lo + i, int(hashes[p].view(np.int64)), () if plain else tuple(made[lo + i][1][before[p] - first : before[p + k] - first])))
    who, hashes, slots = zip(*sorted(out)) if out else [()] * 3
    return pa.RecordBatch.from_arrays([ids.take(pa.array(who, pa.int64())), pa.array(hashes, pa.int64()), pa.array(map(list, slots), pa.list_(pa.string()))], ["_doc", "h", "theirs"])


def whole_matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame | None:
    """As ``matches``, of the items without a usable window (the whole item counts as one window); None if there are none."""
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()

    def whole(batches):
        for b in batches:
            yield _whole_items(b.column(0), b.column(1).to_pylist())

    items = arrow_map(benchmark.select(F.col(item).alias("_item"), F.col(text).cast("string")), whole, f"_item {item_kind}, h long, n int, literal boolean, slots array<string>")
    lengths: dict[bool, list[int]] = {}
    for r in items.select("literal", "n").distinct().toLocalIterator():
        lengths.setdefault(r[0], []).append(r[1])
    if not lengths:
        return None
    sieve = sieve_of(items)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                yield _whole_rows(part.column(0), part.column(1).to_pylist(), lengths, sieve)

    def judge(batches):
        for b in batches:
            keep, slots, agreeing = [], [], []
            for i, (own, theirs) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                tally = _Tally()
                tally.add(0, own, theirs)
                if tally.agrees():
                    keep.append(i)
                    slots.append(tally.slots)
                    agreeing.append(tally.agreeing)
            rows, one = b.take(pa.array(keep, pa.int64())), pa.array([1] * len(keep), pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), one, one, pa.array(slots, pa.int64()), pa.array(agreeing, pa.int64())], [key, item, "matched", "item_windows", "slots", "agreeing"])

    found = arrow_map(docs.select(F.col(key).alias("_doc"), F.col(text).cast("string")), run, f"_doc {kind}, h long, theirs array<string>")
    met = found.join(items, "h").where(F.size("theirs") == F.size("slots")).select("_doc", "_item", "slots", "theirs")
    return arrow_map(met, judge, f"`{key}` {kind}, `{item}` {item_kind}, matched long, item_windows long, slots long, agreeing long")


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """``matches`` and ``whole_matches``, one row for each document and item."""
    found, whole = matches(docs, benchmark, key, item, text), whole_matches(docs, benchmark, key, item, text)
    if whole is None:
        return found
    return _best(found.unionByName(whole), key, item)


def op3(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The windows' part alone; the registered query and the pipeline run ``contaminated``."""
    return matches(docs, benchmark)
