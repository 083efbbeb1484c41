"""Toxicity: a linear classifier with a counterfactual penalty.

Every labelled sentence gets two twins.  Where it mentions a group, the terms
are swapped for the next of their group in one twin and left out in the other;
where it does not, a mention is put in, and another of the same group in the
second twin (labels that never mention a group would else say nothing about
mentions).  Twins have their sentence's label.  Training minimises the mean log
loss of sentences and twins plus ``SWAP_PENALTY`` x the mean squared difference
of the logits of twins (sentence and first twin, first and second twin) plus an
L2 term, so a neutral mention of a group does not move the score.

Features are hashed words (A-Z lower-cased, ASCII punctuation trimmed); a
text's score is a bias plus the sum of the weights of its distinct words, as
toxic words matter by presence wherever they stand in a long text.  Words whose
share of texts does not differ between the classes beyond chance stay out, but
for identity terms: their weights are what the penalty is for.  The model
is fitted on the driver from at most ``MAX_TRAIN`` labelled rows: every row
whose hash of (doc_id, seed) falls under a bound that the label count sets; of
rows that share an id one is taken.  The driver gets each text's buckets, at
most 2^BITS numbers.  Scoring is a narrow map over Arrow batches; only the
weights travel.

Edge cases: a null or empty text gets the bias score; an id without a label is
scored alike; with no labels, or one class only, the score is the smoothed
share of toxic labels; repeated label rows of an id count once (the largest
label wins), so do repeated documents of an id in training (that with the
smallest hash); every row is scored, repeated ones alike; very long texts are
scored whole; a score of exactly 0.5 is predicted as 1; an empty table gives an
empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.llm.common import arrow_map, blocks, bounded, lowered, word_hashes

BITS = 18
MAX_TRAIN = 10_000
SWAP_PENALTY = 1.0
DECAY = 1e-5
STEPS = 250
#: A word enters the model if it stands in so many texts and its two classes' shares differ by so many standard errors.
MIN_TEXTS = 4
MIN_Z = 4.5

#: Identity terms; those of a group stand for one another.
GROUPS = (
    "women men girls boys".split(),
    "woman man girl boy".split(),
    "frauen männer mädchen jungen".split(),
    "femmes hommes filles garçons".split(),
    "mujeres hombres chicas chicos".split(),
    "christians muslims jews hindus buddhists atheists".split(),
    "christian muslim jewish hindu buddhist atheist".split(),
    "christen muslime juden hindus buddhisten atheisten".split(),
    "chrétiens musulmans juifs hindous bouddhistes athées".split(),
    "cristianos musulmanes judíos hindúes budistas ateos".split(),
    "black white asian latino indigenous".split(),
    "schwarze weiße asiaten latinos".split(),
    "noirs blancs asiatiques latinos".split(),
    "negros blancos asiáticos latinos".split(),
    "gay straight lesbian bisexual transgender".split(),
    "schwul hetero lesbisch bisexuell trans".split(),
    "gais hétéros lesbiennes bisexuels transgenres".split(),
    "gays heteros lesbianas bisexuales transgénero".split(),
    "immigrants refugees natives foreigners".split(),
    "einwanderer flüchtlinge einheimische ausländer".split(),
    "immigrés réfugiés autochtones étrangers".split(),
    "inmigrantes refugiados nativos extranjeros".split(),
    "disabled deaf blind autistic".split(),
    "behindert gehörlos blind autistisch".split(),
    "handicapés sourds aveugles autistes".split(),
    "discapacitados sordos ciegos autistas".split(),
    "young old elderly".split(),
)

_TRIM = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())
_BLANK = bytes.maketrans(_TRIM, b" " * len(_TRIM))


def words_of(text: str | None) -> bytes:
    """The text as the features see it: A-Z lower-cased, ASCII punctuation as blanks."""
    return lowered(text).translate(_BLANK)


def _distinct(texts: list[bytes]) -> list[np.ndarray]:
    """Of each text the distinct buckets of its words."""
    out = []
    for lo, hi in blocks(texts, len):
        hashes, counts = word_hashes(texts[lo:hi])
        buckets = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
        at = 0
        for n in counts.tolist():
            out.append(np.unique(buckets[at : at + n]))
            at += n
    return out


_TWINS = {g[i].encode(): g[(i + 1) % len(g)].encode() for g in GROUPS for i in range(len(g))}
_TERMS = sorted(_TWINS)
_BUCKETS = dict(zip(_TERMS, (int(b[0]) for b in _distinct(_TERMS))))


def parts_of(seen: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Buckets of a text's words but for identity terms, and its identity terms; ``seen`` as ``words_of`` gives it."""
    terms = sorted(set(seen.split()) & _TWINS.keys())
    if terms:
        seen = b" ".join(w for w in seen.split() if w not in _TWINS)
    return _distinct([seen])[0], terms


def with_terms(rest: np.ndarray, terms: list[bytes]) -> np.ndarray:
    return np.union1d(rest, [_BUCKETS[t] for t in terms]).astype(np.int64) if terms else rest


def twins(rest: np.ndarray, terms: list[bytes]) -> list[np.ndarray]:
    """Buckets of a text and of its two twins."""
    if terms:
        return [with_terms(rest, terms), with_terms(rest, [_TWINS[t] for t in terms]), rest]
    term = _TERMS[zlib.crc32(rest.tobytes()) % len(_TERMS)]
    return [rest, with_terms(rest, [term]), with_terms(rest, [_TWINS[term]])]


@dataclass
class Model:
    bias: float
    weights: np.ndarray

    def logits(self, texts: list[bytes]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        i = 0
        for found in _distinct(texts):
            out[i] += self.weights[found].sum()
            i += 1
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits([words_of(t) for t in texts]), -30, 30)))


def _sparse(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Column indices end to end, and each entry's row."""
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])


class Problem:
    """What training minimises, over (rest, terms) of the labelled texts."""

    def __init__(self, parts: list[tuple[np.ndarray, list[bytes]]], labels: list[int], penalty: float):
        self.penalty, size = penalty, 1 << BITS
        made = [twins(*p) for p in parts]
        y = np.asarray(labels, float)
        # words whose share of texts differs between the classes beyond chance (the rest would only be learnt by heart), and identity terms
        cols, at = _sparse([m[0] for m in made])
        n1 = y.sum()
        n0 = len(y) - n1
        c1 = np.bincount(cols, y[at], size)
        c0 = np.bincount(cols, minlength=size) - c1
        p = (c1 + c0 + 0.5) / (len(y) + 1)
        z = np.abs(c1 / n1 - c0 / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
        self.used = (z >= MIN_Z) & (c1 + c0 >= MIN_TEXTS)
        self.used[list(_BUCKETS.values())] = True
        #: Buckets that have a weight, and their texts' entries as places among them.
        self.buckets = np.flatnonzero(self.used)
        made = [[np.searchsorted(self.buckets, r[self.used[r]]) for r in m] for m in made]
        self.y = np.repeat(y, 3)
        self.cols, self.at = _sparse([r for m in made for r in m])
        # the difference of a pair, as signed entries
        pairs = [(m[k], m[k + 1]) for m in made for k in (0, 1)]
        diffs = [(np.setdiff1d(a, b), np.setdiff1d(b, a)) for a, b in pairs]
        self.pairs = len(pairs)
        self.dcols = np.concatenate([np.concatenate(d) for d in diffs]).astype(np.int64)
        self.dsign = np.concatenate([np.r_[np.ones(len(a)), -np.ones(len(b))] for a, b in diffs])
        self.dat = np.repeat(np.arange(len(diffs)), [len(a) + len(b) for a, b in diffs])

    def value_and_slopes(self, w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
        """The objective, and its derivatives by the weights of ``buckets`` and by the bias."""
        n, size = len(self.y), len(w)
        z = b + np.bincount(self.at, w[self.cols], n)
        gap = np.bincount(self.dat, self.dsign * w[self.dcols], self.pairs)
        value = np.mean(np.logaddexp(0, z) - self.y * z) + self.penalty * np.mean(gap**2) + DECAY / 2 * (w @ w)
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - self.y
        slope = np.bincount(self.cols, err[self.at], size) / n + DECAY * w
        slope += 2 * self.penalty * np.bincount(self.dcols, self.dsign * gap[self.dat], size) / self.pairs
        return float(value), slope, float(err.mean())


def fit(texts: list[str | None], labels: list[int], penalty: float = SWAP_PENALTY) -> Model:
    return fit_parts([parts_of(words_of(t)) for t in texts], labels, penalty)


def fit_parts(parts: list[tuple[np.ndarray, list[bytes]]], labels: list[int], penalty: float = SWAP_PENALTY) -> Model:
    """Full-batch Adam on ``Problem``."""
    share = (sum(labels) + 1) / (len(labels) + 2)
    model = Model(float(np.log(share / (1 - share))), np.zeros(1 << BITS))
    if len(set(labels)) < 2:
        return model
    problem = Problem(parts, labels, penalty)
    w, b = np.zeros(len(problem.buckets)), model.bias
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    rate = 0.1
    for step in range(1, STEPS + 1):
        _, grad, by_bias = problem.value_and_slopes(w, b)
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        w -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        b -= 0.5 * by_bias
    model.weights[problem.buckets] = w
    return Model(float(b), model.weights)


def neutral_mentions(model: Model, texts: list[str | None]) -> dict[str, float]:
    """Of texts as they are and with each identity term put in: the share that is predicted toxic, and how far the logits move."""
    plain, mentions, moved = 0, 0, []
    for t in texts:
        rest, terms = parts_of(words_of(t))
        base = model.bias + model.weights[with_terms(rest, terms)].sum()
        held = set(rest.tolist())
        by = np.array([0.0 if b in held or term in terms else model.weights[b] for term, b in _BUCKETS.items()])
        plain += base >= 0
        mentions += np.mean(base + by >= 0)
        moved.append(np.abs(by).mean())
    n = max(len(texts), 1)
    return {"plain": plain / n, "mentions": float(mentions / n), "moved": float(np.mean(moved)) if moved else 0.0}


def held_out(doc_id):
    """Rows that training never sees."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on at most MAX_TRAIN labelled rows outside the held-out fifth."""
    marks = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).dropna().where(~held_out(F.col("_k")))
    marks = marks.groupBy("_k").agg(F.max("_y").alias("_y"))
    n = marks.count()
    if not n:
        return fit_parts([], [])
    # all rows if they are few enough, else a share chosen by hash that stays below the bound
    span = 1 << 30
    part = span if n <= MAX_TRAIN else int(span * 0.97 * MAX_TRAIN / n)
    marks = marks.where(F.pmod(F.xxhash64("_k", F.lit(11)), F.lit(span)) < part)
    rows = docs.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t"))
    # the labelled rows are at most MAX_TRAIN: they are broadcast to the scan, and only their texts are shuffled, one of each id
    rows = bounded(rows).join(F.broadcast(marks), "_k").groupBy("_k").agg(F.min_by(F.coalesce("_t", F.lit("")), F.xxhash64("_t")).alias("_t"), F.max("_y").alias("_y"))

    def gather(batches):
        for b in batches:
            parts = [parts_of(words_of(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r.astype(np.int32).tobytes() for r, _ in parts], pa.binary()), pa.array([b" ".join(t) for _, t in parts], pa.binary()), b.column(1)], ["rest", "terms", "y"])

    table = arrow_map(rows.select("_t", "_y"), gather, "rest binary, terms binary, y int").toArrow()
    # in an order of its own, so that the model does not depend on how rows were dealt
    found = sorted(zip(*(c.to_pylist() for c in table.columns)))
    return fit_parts([(np.frombuffer(r, np.int32).astype(np.int64), t.split()) for r, t, _ in found], [y for _, _, y in found])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, score and predicted class of every document."""
    kind = docs.schema[key].dataType.simpleString()
    packed = zlib.compress(model.weights.astype(np.float32).tobytes())
    bias = model.bias

    def run(batches):
        m = Model(bias, np.frombuffer(zlib.decompress(packed), np.float32).astype(float))
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                s = m.scores(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64())], [key, "score"])

    out = arrow_map(docs.select(F.col(key), F.col(text).cast("string")), run, f"`{key}` {kind}, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs, train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
