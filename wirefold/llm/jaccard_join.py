"""N-gram Jaccard join by parity sketches, and the groups that its links make.

A document's set S holds its distinct ``WIDTH``-word shingles as 64-bit hashes.
Documents link when 100 |A n B| >= SIMILAR |A u B|.  With d = |A symmetric
difference B|, a link implies 9 d <= |A| + |B| (for SIMILAR 80), hence
d <= |A| / 4 for any linked partner.

Sketches.  XOR-ing the hashes that fall into a cell makes a parity sketch:
common shingles cancel, each differing one touches one cell.
* Cells of one bit: the Hamming distance of two sketches is at most d, so
  9 Hamming > |A| + |B| rules a pair out without its texts.
* Cells of 64 bits ("segments", their number fixed per size band): a link
  leaves all but d segments equal.  Of a document's K non-empty segments at
  least K - |A| / 4 equal its partner's.  So by the pigeonhole principle the
  first |A| / 4 + 1 of its segments, in any order that all documents share,
  meet one of the partner's first segments.  These are the join keys.

The shared order puts segments that very many documents have (a licence line,
a quoted passage) last, the commonest ones very last.  They are counted over all documents in a table of
fixed size; the order need only be the same for all, so collisions in that
table cost nothing but speed.  Bands are four sizes wide; a document near its
band's upper end is also entered in the next band, so every admissible pair
meets in one.

Candidates.  A key held by m documents does not make m^2 pairs: each task pairs
its own holders with the smallest id among them, and sends on only that id;
the same is done again after the shuffle.  So a hot key sends a row for each
task.  These star pairs are checked (sketch, then texts) and linked documents
form components.  Where a key's documents lie in several components after that,
the remaining pairs across components are checked too: all pairs of a document
outside the key's largest component with the key's documents in others (after
rounds with a few of them, if the pairs are many).  They are compared by
size class, and a key of many documents is dealt out over as many tasks as it
has times ``HOT`` documents, so no task holds all pairs of a key.  Pairs
within a component need no check, so no link between different components is
lost and the components are exact.

Every step that follows the shuffle of keys is an equi-join of written tables
or a partial aggregation; nothing is collected but tables of fixed size (levels, a bitmap).

Edge cases: null, empty or blank texts have the empty set and link with
nothing; fewer than ``WIDTH`` words make one shingle; rows with the same doc_id
are versions of one document and share its component; a null doc_id has a null
component; repeated rows are each returned; an empty table gives an empty
result; further columns are ignored, whatever their names; texts of any length
are used whole; pairs at exactly SIMILAR link.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.llm.common import BLOCK_BYTES, Scratch, arrow_map, blocks, lowered, mix, shingle_sets

WIDTH = 5
SIMILAR = 80
#: Documents of fewer shingles have a segment for each shingle.
SMALL = 64
#: Size of the table of segment counts, and of its chunks.
COUNTERS = 1 << 22
CHUNK = 1 << 16
#: A segment is common if its counter exceeds this and four times the mean.
COMMON = 64
#: Keys that a task holds before it pairs and sends them.
HELD_KEYS = 1 << 19
#: Bits of the filter that finds the texts of candidate pairs.
FILTER_BITS = 1 << 23

#: Pairs across components are checked at once if they are at most so many times the rows of their keys, or
#: if a round with a few of them has linked less than this share of the documents outside the largest components.
MANY = 4
FRUITFUL = 0.05
#: Documents of a key that one task compares with the key's others.
HOT = 2048
#: Ratio of two size classes; a little over 100 / SIMILAR, so that partners lie in the same or in neighbouring classes.
CLASS = 1.26
#: Links up to this number (four megabytes) are joined to components in one task, more by rounds of joins.
FEW_LINKS = 1 << 18

_U = np.uint64


# --- sketches ----------------------------------------------------------------


def parity_bits(shingles: np.ndarray) -> bytes:
    """Parity sketch of one-bit cells: at least two cells a shingle, a power of two."""
    cells = 64
    while cells < 2 * len(shingles):
        cells *= 2
    odd = np.bincount((shingles & _U(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Distance of two parity sketches; the longer one is folded to the shorter's cells."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    n, m = 8 * len(a), 8 * len(b)
    while n > m:
        n //= 2
        x = (x >> n) ^ (x & ((1 << n) - 1))
    while m > n:
        m //= 2
        y = (y >> m) ^ (y & ((1 << m) - 1))
    return (x ^ y).bit_count()


def bands(size: int) -> list[tuple[int, int]]:
    """(band, number of segments) of a set's own band, and of the next if a partner may lie there."""
    out = []
    band, top = (0, SMALL) if size < SMALL else (1, SMALL * 4)
    while size >= top:
        band, top = band + 1, top * 4
    out.append((band, top // 2 if band else 0))
    if 5 * size >= 4 * top:
        out.append((band + 1, top * 2))
    return out


def segments(shingles: np.ndarray, band: int, number: int) -> np.ndarray:
    """Parity of each non-empty segment, marked with band and segment."""
    if not number:
        return mix(shingles ^ _U(0xA5A5))
    cell = (shingles >> _U(20)) % _U(number)
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    parity = np.bitwise_xor.reduceat(shingles[order], first)
    return mix(parity ^ mix(cell[first] + _U(band << 40)))


def quota(size: int) -> int:
    """Segments that a set must enter so that it meets every partner."""
    return size // 4 + 1


def chosen(parities: np.ndarray, size: int, band: int, levels: np.ndarray) -> np.ndarray:
    """The first segments in the shared order: by level of frequency, then by value."""
    need = quota(size)
    if len(parities) < need:
        # fewer segments than the pigeonhole needs: such sets also meet one another
        return np.append(parities, mix(np.array([0xDEF0 + band], _U)))
    level = levels[(parities % _U(COUNTERS)).astype(np.int64)]
    if not level.any():
        return np.partition(parities, need - 1)[:need]
    return parities[np.lexsort((parities, level))[:need]]


# --- first pass: sets, sketches, segment counts ------------------------------

#: A second sketch of one-bit cells, the same size for all sets, as words of 64 bits that SQL can compare.
FOLDS = [f"f{i}" for i in range(8)]
_PROFILE = f"id long, n_shingles long, same binary, sketch binary, chunk int, counts binary, {', '.join(f'{f} long' for f in FOLDS)}"
_PROFILE_NAMES = ["id", "n_shingles", "same", "sketch", "chunk", "counts", *FOLDS]


def fold(shingles: np.ndarray) -> np.ndarray:
    """Parity sketch of 512 cells as eight words."""
    cells = 64 * len(FOLDS)
    odd = np.bincount((shingles & _U(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def near(x: str, y: str):
    """Condition that the sizes and folds of two sides allow a link."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    apart = sum((F.bit_count(F.col(f"{x}.{f}").bitwiseXOR(F.col(f"{y}.{f}"))) for f in FOLDS), F.lit(0))
    return (100 * F.least(n, m) >= SIMILAR * F.greatest(n, m)) & (apart * (100 + SIMILAR) <= (100 - SIMILAR) * (n + m))


def _profile(batches):
    counters = np.zeros(COUNTERS, np.uint32)
    seen: set[bytes] = set()
    any_set = False
    for b in batches:
        for lo, hi, texts in _parts(b):
            sizes, sames, sketches, folds = [], [], [], []
            for s in shingle_sets(texts, WIDTH):
                sizes.append(len(s))
                same = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                sames.append(same)
                sketches.append(parity_bits(s) if len(s) else None)
                folds.append(fold(s))
                if same is not None and same not in seen:
                    seen.add(same)
                    any_set = True
                    for band, number in bands(len(s)):
                        np.add.at(counters, (segments(s, band, number) % _U(COUNTERS)).astype(np.int64), 1)
            n = hi - lo
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, n), pa.array(sizes, pa.int64()), pa.array(sames, pa.binary()), pa.array(sketches, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), *(pa.array(f) for f in np.array(folds, np.int64).reshape(n, len(FOLDS)).T)],
                _PROFILE_NAMES,
            )
    if any_set:
        parts = [(i, zlib.compress(np.minimum(counters[i * CHUNK : (i + 1) * CHUNK], 65535).astype(np.uint16).tobytes(), 1)) for i in range(COUNTERS // CHUNK)]
        n = len(parts)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary()), *(pa.nulls(n, pa.int64()) for _ in FOLDS)],
            _PROFILE_NAMES,
        )


def _parts(batch):
    """Ranges of a batch with their lower-cased texts, of about BLOCK_BYTES each."""
    texts = [lowered(t) for t in batch.column(1).to_pylist()]
    for lo, hi in blocks(texts, len, 4 * BLOCK_BYTES):
        yield lo, hi, texts[lo:hi]


def _levels(profile: DataFrame) -> np.ndarray:
    """Of each counter 0 if it is not common, else how many times it doubles what is; one byte each, whatever the input."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = np.frombuffer(zlib.decompress(raw), np.uint16)
                sums[chunk] = sums[chunk] + own if chunk in sums else own.astype(np.uint64)
        for chunk, total in sums.items():
            level = np.log2(np.maximum(total / max(COMMON, 4 * total.mean()), 0.5)) + 1
            packed = zlib.compress(np.minimum(np.ceil(level), 40).astype(np.uint8).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([packed], pa.binary())], ["chunk", "levels"])

    counts = profile.where("chunk is not null").select("chunk", "counts").repartition(COUNTERS // CHUNK, "chunk")
    out = np.zeros(COUNTERS, np.uint8)
    for r in arrow_map(counts, add, "chunk int, levels binary").toLocalIterator():
        out[r[0] * CHUNK : (r[0] + 1) * CHUNK] = np.frombuffer(zlib.decompress(r[1]), np.uint8)
    return out


# --- second pass: keys and star pairs ----------------------------------------

_KEYS = "key long, a long, b long"


def _star(keys: np.ndarray, ids: np.ndarray):
    """Of (key, id) rows: one row with the smallest id of each key, and (key, smallest, other) rows."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    first = ids[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]
    fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])])
    rest = ~new & fresh & (ids != first)
    return keys[new], ids[new], keys[rest], first[rest], ids[rest]


def _batch(keys, a, b=None) -> pa.RecordBatch:
    last = pa.nulls(len(keys), pa.int64()) if b is None else pa.array(b)
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(a), last], ["key", "a", "b"])


def _sized(keys, a, b=None, step: int = 1 << 16):
    for lo in range(0, len(keys), step):
        yield _batch(keys[lo : lo + step], a[lo : lo + step], None if b is None else b[lo : lo + step])


def _keys_of(packed: bytes):
    def run(batches):
        levels = np.frombuffer(zlib.decompress(packed), np.uint8)
        held_keys: list[np.ndarray] = []
        held_ids: list[np.ndarray] = []
        copies: dict[bytes, int] = {}
        held = 0

        def flush():
            keys, ids = np.concatenate(held_keys), np.concatenate(held_ids)
            k, i, pk, pa_, pb = _star(keys, ids)
            yield from _sized(k, i)
            yield from _sized(pk, pa_, pb)

        for b in batches:
            ids = b.column(0).to_pylist()
            for lo, _, texts in _parts(b):
                twins: list[tuple[int, int]] = []
                for k, s in enumerate(shingle_sets(texts, WIDTH)):
                    who = ids[lo + k]
                    if who is None or not len(s):
                        continue
                    same = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    other = copies.setdefault(same, who)
                    if other != who:  # a copy of a set that this task has entered: one link, no keys
                        twins.append((other, who))
                        continue
                    for band, number in bands(len(s)):
                        own = chosen(segments(s, band, number), len(s), band, levels)
                        held_keys.append(own)
                        held_ids.append(np.full(len(own), who, np.int64))
                        held += len(own)
                if twins:
                    t = np.array(twins, np.int64)
                    yield from _sized(mix(t.view(_U)[:, 1].copy()), t.min(1), t.max(1))
                if held > HELD_KEYS:
                    yield from flush()
                    held_keys, held_ids, held = [], [], 0
        if held:
            yield from flush()

    return run


def _stars(batches):
    """Rows sorted by key, then id: pairs of each key's smallest id with the others; pairs pass."""
    key = first = last = None
    for b in batches:
        keys, a = b.column(0).to_numpy(), b.column(1).to_numpy()
        ready = b.column(2).is_valid().to_numpy(zero_copy_only=False)
        if ready.any():
            yield b.filter(pa.array(ready))
        keys, a = keys[~ready], a[~ready]
        if not len(keys):
            continue
        new = np.concatenate([[key is None or keys[0] != key], keys[1:] != keys[:-1]])
        start = np.maximum.accumulate(np.where(new, np.arange(len(keys)), -1))
        firsts = np.where(start >= 0, a[start], first if first is not None else 0)
        before = np.concatenate([[last if last is not None else 0], a[:-1]])
        rest = ~new & (a != firsts) & (a != before)
        key, first, last = keys[-1], firsts[-1], a[-1]
        if rest.any():
            yield _batch(keys[rest], firsts[rest], a[rest])


# --- checks of pairs ---------------------------------------------------------


def _sketch_check(batches):
    """status: 1 the sets are equal, 0 open, -1 ruled out by sizes or sketches."""
    for b in batches:
        out = []
        n, m = b.column(2).to_pylist(), b.column(3).to_pylist()
        same = b.column(4).to_pylist()
        for x, y, s, p, q in zip(n, m, same, b.column(5), b.column(6)):
            if s:
                out.append(1)
            elif 100 * min(x, y) < SIMILAR * max(x, y):
                out.append(-1)
            else:
                far = hamming(p.as_buffer().to_pybytes(), q.as_buffer().to_pybytes()) * (100 + SIMILAR) > (100 - SIMILAR) * (x + y)
                out.append(-1 if far else 0)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int32())], ["a", "b", "status"])


def _text_check(batches):
    known: tuple[int | None, bytes, np.ndarray] = (None, b"", np.empty(0, _U))
    for b in batches:
        ids = b.column(0).to_pylist()
        out = []
        for k in range(b.num_rows):
            ta, tb = (zlib.decompress(b.column(c)[k].as_buffer()) for c in (2, 3))
            if known[0] != ids[k] or known[1] != ta:
                known = (ids[k], ta, next(shingle_sets([ta], WIDTH)))
            x, y = known[2], next(shingle_sets([tb], WIDTH))
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= SIMILAR * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(out, pa.bool_()))


class Join:
    """One run of the join; its tables lie in a scratch folder."""

    def __init__(self, docs: DataFrame, key: str, text: str):
        self.docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
        self.scratch = Scratch(docs.sparkSession, "jaccard")

    def run(self) -> tuple[DataFrame, DataFrame]:
        """(id, n_shingles) of every row, and (id, comp) of documents that are not their group's smallest id."""
        keep = self.scratch.keep
        table = keep(arrow_map(self.docs, _profile, _PROFILE), "profile")
        profile = table.where("chunk is null").drop("chunk", "counts")
        self.sets = profile.where("id is not null and n_shingles > 0")
        packed = zlib.compress(_levels(table).tobytes(), 1)
        keys = arrow_map(self.docs, _keys_of(packed), _KEYS)
        # rows of a key meet, ready pairs go anywhere
        spread = F.xxhash64("key", F.coalesce("b", F.lit(0)))
        stars = arrow_map(keys.repartition(spread).sortWithinPartitions("key", "a"), _stars, _KEYS)
        stars = keep(stars, "stars")
        del keys
        self.scratch.release()
        # equal sets need no check; later they count once
        equal = keep(self.sets.groupBy("same").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("same", "rep"), "equal")
        self.copies = keep(self.sets.select("same", "id").join(equal, "same").where("id <> rep").select("id", "rep"), "copies")
        pairs = keep(stars.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).select("a", "b"), "pairs")
        linked, checked = self.check(pairs, "first")
        linked = linked.unionByName(self.copies.select(F.col("rep").alias("a"), F.col("id").alias("b")))
        comps = components(linked, self.scratch, "first")
        comps = self.across(stars, checked, comps)
        self.scratch.drop("stars", "pairs")
        return profile.select("id", "n_shingles"), comps

    def check(self, pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Links among pairs, and all pairs with status."""
        keep = self.scratch.keep
        side = lambda c: self.sets.select(F.col("id").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("same").alias(f"s{c}"), F.col("sketch").alias(f"k{c}"))
        both = pairs.join(side("b"), "b").join(side("a"), "a")
        both = both.select("a", "b", "na", "nb", (F.col("sa") == F.col("sb")).alias("same"), "ka", "kb")
        checked = keep(arrow_map(both, _sketch_check, "a long, b long, status int"), f"{name}-checked")
        links = checked.where("status = 1").select("a", "b")
        opened = checked.where("status = 0").select("a", "b")
        if not opened.isEmpty():
            texts = self.texts(opened, name)
            side = lambda c: texts.select(F.col("id").alias(c), F.col("packed").alias(f"t{c}"))
            met = opened.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb")
            links = links.unionByName(arrow_map(met, _text_check, "a long, b long"))
        links = keep(links.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).select("a", "b"), f"{name}-links")
        self.scratch.drop(f"{name}-texts")
        return links, checked

    def texts(self, pairs: DataFrame, name: str) -> DataFrame:
        """Packed texts of the documents in pairs (and few others), found through a filter of fixed size."""
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))

        def bits(batches):
            out = np.zeros(FILTER_BITS, bool)
            for b in batches:
                out[(mix(b.column(0).to_numpy().view(_U)) % _U(FILTER_BITS)).astype(np.int64)] = True
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(out).tobytes(), 1)], pa.binary())], ["bits"])

        total = np.zeros(FILTER_BITS // 8, np.uint8)
        for r in arrow_map(ids.coalesce(6), bits, "bits binary").toLocalIterator():
            total |= np.frombuffer(zlib.decompress(r[0]), np.uint8)
        packed = zlib.compress(total.tobytes(), 1)

        def find(batches):
            wanted = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8)).view(bool)
            for b in batches:
                b = b.filter(b.column(0).is_valid())
                hit = wanted[(mix(b.column(0).to_numpy().view(_U)) % _U(FILTER_BITS)).astype(np.int64)]
                b = b.filter(pa.array(hit))
                texts = [zlib.compress(lowered(t), 1) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary())], ["id", "packed"])

        return self.scratch.keep(arrow_map(self.docs, find, "id long, packed binary"), f"{name}-texts")

    def across(self, stars: DataFrame, checked: DataFrame, comps: DataFrame) -> DataFrame:
        """Components after all pairs across components that share a key have been checked.

        Where few documents stand outside their keys' largest components, all
        their pairs are checked at once, and that ends it.  Where they are many
        (a large family whose members are not all like its smallest id), they
        first meet a few members of the largest components, in rounds, as long
        as that still finds links.
        """
        keep = self.scratch.keep
        done, step, fruitful = checked.select("a", "b"), 0, True
        side = lambda c, comps: comps.select(F.col("id").alias(c), F.col("comp").alias(f"c{c}"))
        apart = checked.where("status <> 1").join(side("a", comps), "a", "left").join(side("b", comps), "b", "left")
        apart = keep(apart.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), "apart")
        keys = keep(stars.join(apart, ["a", "b"], "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n")).select("key"), "mixed")
        members = stars.join(keys, "key", "left_semi").select("key", F.explode(F.array("a", "b")).alias("id"))
        # of equal sets one member stands for all: they have the same keys (an id with several sets has keys of its own)
        several = self.sets.groupBy("id").agg(F.min(F.xxhash64("same")).alias("least"), F.max(F.xxhash64("same")).alias("most")).where("least <> most").select("id")
        copies = self.copies.join(several, "id", "left_anti").groupBy("id").agg(F.min("rep").alias("rep"))
        members = members.join(copies, "id", "left").select("key", F.coalesce("rep", "id").alias("id"))
        members = keep(members.groupBy("key", "id").agg(F.count(F.lit(1)).alias("n")).select("key", "id"), "members0")
        while True:
            step += 1
            held = keep(members.join(comps, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp")), f"held{step}")
            sizes = held.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
            largest = sizes.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("top"), F.sum("n").alias("all"), F.max("n").alias("most"), F.count(F.lit(1)).alias("comps"))
            largest = keep(largest.where("comps > 1").select("key", "top", "all", (F.col("all") - F.col("most")).alias("out")), f"largest{step}")
            rows, pairs = largest.agg(F.coalesce(F.sum("all"), F.lit(0)), F.coalesce(F.sum(F.col("out") * F.col("all")), F.lit(0))).first()
            if not rows:
                return comps
            # the next round needs only the keys that are still mixed
            held = keep(held.join(largest.select("key", "top", "all"), "key"), f"mixed{step}")
            last = not fruitful or pairs <= MANY * rows
            folds = self.sets.select("id", F.col("n_shingles").alias("n"), *FOLDS)
            seen = keep(held.join(folds, "id"), f"seen{step}")
            if last:
                others = seen
            else:
                spot = F.pmod("key", F.lit(4))
                chosen = seen.where("comp = top").groupBy("key", "comp").agg(F.min_by(F.struct("id", "n", *FOLDS), F.xxhash64("id", spot, F.lit(step))).alias("s"))
                others = keep(chosen.select("key", "comp", "s.*"), f"chosen{step}")
            size = F.floor(F.log("n") / F.log(F.lit(CLASS))).cast("int")
            shares = F.ceil(F.col("all") / HOT) if last else F.lit(1)
            outside = seen.where("comp <> top").withColumn("share", F.pmod(F.xxhash64("id"), shares))
            outside = outside.withColumn("size", F.explode(F.array(size - 1, size, size + 1))).alias("x")
            others = others.withColumn("size", size).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), shares.cast("long") - 1))).alias("y")
            same = (F.col("x.key") == F.col("y.key")) & (F.col("x.size") == F.col("y.size")) & (F.col("x.share") == F.col("y.share"))
            met = outside.join(others, same & (F.col("x.comp") != F.col("y.comp")) & near("x", "y"))
            met = met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
            met = keep(met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).select("a", "b"), f"met{step}")
            rest = keep(met.join(done, ["a", "b"], "left_anti"), f"rest{step}")
            links, _ = self.check(rest, f"across{step}")
            found = links.count()
            fruitful = not last and found > FRUITFUL * seen.where("comp <> top").agg(F.approx_count_distinct("id")).first()[0]
            if found:
                known = comps.select(F.col("id").alias("a"), F.col("comp").alias("b"))
                comps = components(known.unionByName(links), self.scratch, f"across{step}")
            if last:
                return comps
            done = keep(done.unionByName(rest), f"done{step}")
            members = held.select("key", "id")
            self.scratch.drop(f"members{step - 1}", f"held{step}", f"largest{step}", f"chosen{step}", f"seen{step}", f"met{step}", f"rest{step}", f"done{step - 1}", f"mixed{step - 1}")


# --- components --------------------------------------------------------------


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, comp) of every node but the smallest of its component; comp is that smallest node.

    Rounds of large-star and small-star (each node points its larger, then its
    smaller neighbours to the smallest) until nothing changes: a logarithmic
    number of rounds, each a few joins of written tables.
    """
    keep = scratch.keep
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if edges.count() <= FEW_LINKS:
        return keep(arrow_map(edges.coalesce(1), _union, "u long, v long").select(F.col("u").alias("id"), F.col("v").alias("comp")), f"{name}-comps")
    # what a task's links join already, it sends as stars
    edges = arrow_map(edges, _union, "u long, v long")
    edges = keep(edges.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n")).select("u", "v"), f"{name}-edges0")
    mark, step = _mark(edges), 0
    while True:
        step += 1
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = keep(large.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n")).select("u", "v"), f"{name}-large")
        lower = keep(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-lower")
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(lower.select("u", F.col("m").alias("v")))
        edges = keep(small.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n")).select("u", "v"), f"{name}-edges{step}")
        now = _mark(edges)
        scratch.drop(f"{name}-edges{step - 1}")
        if now == mark:
            scratch.drop(f"{name}-least", f"{name}-large", f"{name}-lower")
            return edges.select(F.col("u").alias("id"), F.col("v").alias("comp"))
        mark = now


def _union(batches):
    """(node, smallest node of its component) for the links of one task."""
    parent: dict[int, int] = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = root(u), root(v)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = [(x, r) for x in parent if (r := root(x)) != x]
    for lo in range(0, len(nodes), 1 << 16):
        part = nodes[lo : lo + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64())], ["u", "v"])


def _mark(edges: DataFrame):
    """Count and checksum of edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_shingles and component_id of every row."""
    rows, comps = Join(docs, key, text).run()
    out = rows.join(comps, "id", "left")
    return out.select(F.col("id").alias(key), "n_shingles", F.coalesce("comp", "id").alias("component_id"))


def op4(docs: DataFrame) -> DataFrame:
    return groups(docs)
