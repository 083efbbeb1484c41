"""Personal data in texts: exact base patterns plus a semi-Markov CRF.

The base patterns give the certain spans.  The CRF adds spans that no plain
pattern describes (phones without a plus, spelled-out addresses, keys after a
cue word).  It scores whole segments: a feature may look at all of a candidate
span (digit count, grouping, checksum, dotted-quad range) and at the words
before it, and dynamic programming chooses boundaries and types jointly.  A
segment holds at most ``MAX_TOKENS`` tokens, or is a whole region with letters
(an address or an opaque word of any length), so the search costs
tokens x MAX_TOKENS x kinds; segments of digits end early, at ``MAX_DIGITS``.
Search is confined to candidate regions: stretches of seven or more digits and
separators, addresses with an at sign, long opaque words.  (Shorter numbers
have features too, but no kind is as short.)  There is no score for one label
after another: O is a label of single tokens with score 0, so a segment whose
features cannot sum to more than 0 is never part of the best labelling and is
passed over by a bound on its digits and groups.

The model is trained once per process on a small table of generated, labelled
sentences; the weights (about 200 doubles) travel to the executors in the task.
Work is a narrow map over Arrow batches of whole texts: no shuffle.

Edge cases: a null or empty text has no spans; offsets count code points, ends
are exclusive; repeated rows are each searched; an empty table gives an empty
result; further columns are ignored, whatever their names.  Texts of any length
are searched whole, regions of any length too, in time that grows with the
length.  Of labellings that score alike the one with longer segments wins, of
kinds that score alike the one listed first.  An added span never overlaps a
base span.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.llm.common import arrow_map

#: Kinds in their listed order; the last one only the CRF finds.
KINDS = ("email", "ip", "card", "phone", "secret")
_RANK = {k: i for i, k in enumerate(KINDS)}

Span = tuple[int, int, str]

# --- base patterns -----------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits begins: an earlier match never ends inside one
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _octet(digits: str) -> bool:
    """At most 255, however many zeros stand before it."""
    bare = digits.lstrip("0")
    return len(bare) <= 3 and int(bare or "0") <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        free = max(free, start)
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end(), "email"
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, in order of start, then kind."""
    out = list(_emails(text))
    for m in _IP.finditer(text):
        if all(map(_octet, m[0].split("."))):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return in_order(out)


def in_order(spans) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], _RANK[s[2]], s[1]))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


# --- semi-Markov CRF ---------------------------------------------------------

MAX_TOKENS = 64
#: A segment of digits alone that has more than this many holds at most ``DIGIT_TOKENS`` tokens.
MAX_DIGITS, DIGIT_TOKENS = 20, 16
LABELS = ("O", *KINDS)
_TOKEN = re.compile(r"(?=[0-9_]*[A-Za-z])[A-Za-z0-9_]{20,}|[0-9]+|[^\W\d_]+|[^\w\s]|_|\s+|\w")
#: Where entities can be.  Addresses are found from their at sign outwards, so that each text is read a fixed number of times.
_AT = re.compile(r" ?[(\[](?:at|AT)[)\]] ?|@")
_AFTER_AT = re.compile(r"[A-Za-z0-9-]+(?:(?: ?[(\[](?:dot|DOT)[)\]] ?|\.)[A-Za-z0-9-]+)*")
_LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._-")
_OPAQUE = re.compile(r"[A-Za-z0-9_-]{20,}")
_DIGIT = re.compile(r"[0-9]")
_NUMERIC = re.compile(r"[+(]?(?<![0-9])[0-9](?:[0-9]|[ ().\-/](?=[0-9 ().\-/])){5,}[0-9]")


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches in which entities are looked for, in order; those that overlap become one."""
    found = [m.span() for m in _NUMERIC.finditer(text)]
    found += [m.span() for m in _OPAQUE.finditer(text) if _DIGIT.search(text, m.start(), m.end())]
    free = 0
    for at in _AT.finditer(text):
        start = at.start()
        while start > free and text[start - 1] in _LOCAL_PART:
            start -= 1
        while start < at.start() and text[start] in "._-":
            start += 1
        if start < at.start() and (m := _AFTER_AT.match(text, at.end())):
            found.append((start, m.end()))
        free = at.end()
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


_CUES = {
    "phone": frozenset("phone tel telephone call fax mobile cell telefon téléphone teléfono".split()),
    "card": frozenset("card visa mastercard amex credit karte carte tarjeta".split()),
    "ip": frozenset("ip host server address".split()),
    "email": frozenset("mail email contact courriel correo".split()),
    "secret": frozenset("token key secret password passwd apikey api_key".split()),
}
_ALL_CUES = frozenset().union(*_CUES.values())
_WORD = re.compile(r"[^\W\d]+")
_SEPARATORS = " ().-/+"
PHONE_SHAPES = ("3-3-4", "1-3-3-4", "2-2-2-2-2", "3-4-4", "2-4-4", "2-3-3-4")
CARD_SHAPES = ("4-4-4-4", "4-6-5", "16", "15")


def cues_before(text: str, a: int) -> list[str]:
    """Kinds of which one of the two words before a segment speaks."""
    before = set(w.lower() for w in _WORD.findall(text[max(0, a - 24) : a])[-2:])
    return [k for k, words in _CUES.items() if before & words]


def features(text: str, a: int, b: int) -> list[str]:
    """Names of the features of the whole segment text[a:b]."""
    seg = text[a:b]
    groups = re.findall(r"[0-9]+", seg)
    digits = "".join(groups)
    seps = set(re.sub(r"[0-9]", "", seg))
    cues = cues_before(text, a)
    out = []
    numeric = digits and not (seps - set(_SEPARATORS))
    if numeric:
        n = len(digits)
        shape = "-".join(str(len(g)) for g in groups)
        out += [f"digits={min(n, 20)}", "plus" if seg[0] == "+" else "bare", f"groups={min(len(groups), 6)}"]
        if shape in PHONE_SHAPES:
            out.append("phone-shape")
        if shape in CARD_SHAPES:
            out.append("card-shape+luhn" if luhn(digits) else "card-shape-luhn")
        if shape.count("-") == 3 and seps == {"."}:
            out.append("quad" if all(map(_octet, groups)) else "quad-out")
        if "(" in seg:
            out.append("paren" if re.match(r"\+?[0-9]{0,3} ?\([0-9]{2,4}\) ?[0-9]", seg) and seg.count("(") == seg.count(")") == 1 else "paren-odd")
        if len(seps - set("+() ")) > 1 or "  " in seg:
            out.append("mixed")
        out += [f"cue={k}&{'10+' if n >= 10 else 'short' if n < 7 else '7+'}" for k in cues]
    elif re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*(?:@| ?[(\[](?:at|AT)[)\]] ?)[A-Za-z0-9-]+(?:(?:\.| ?[(\[](?:dot|DOT)[)\]] ?)[A-Za-z0-9-]+)+", seg):
        out += ["address", *[f"cue={k}&address" for k in cues]]
    elif len(seg) >= 20 and digits and re.fullmatch(r"[A-Za-z0-9_-]+", seg):
        kind = "hex" if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", seg) else "opaque"
        out += [kind, f"{kind}&long" if len(seg) >= 32 else f"{kind}&mid", *[f"cue={k}&opaque" for k in cues]]
    if not out:
        return ["none"]
    edge = text[a - 1 : a] + " " + text[b : b + 1]
    if re.search(r"[^\W_]", edge):
        out.append("cut")  # the segment ends inside a word or number
    if text[a] in " )-./" or text[b - 1] in " (-./":
        out.append("ragged")
    return out


def _cuts(text: str, lo: int, hi: int) -> list[int]:
    """Where the tokens of a region begin, and its end."""
    return [m.start() + lo for m in _TOKEN.finditer(text[lo:hi])] + [hi]


def _starts(text: str, cuts: list[int]) -> Iterator[range | list[int]]:
    """For each cut but the first the cuts at which a segment that ends there may begin, in order."""
    n = len(cuts) - 1
    letters = re.search(r"[^\W\d_]", text[cuts[0] : cuts[-1]]) is not None
    digits = [0]
    for a, b in zip(cuts, cuts[1:]):
        digits.append(digits[-1] + (b - a if text[a] in "0123456789" else 0))
    for j in range(1, n + 1):
        low = max(0, j - MAX_TOKENS)
        if letters:
            yield [0, *range(low, j)] if j == n and low else range(low, j)
        else:
            while low < j - DIGIT_TOKENS and digits[j] - digits[low] > MAX_DIGITS:
                low += 1
            yield range(low, j)


class Model:
    """Weights by (feature, label)."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights
        self.bounds = self._bounds()

    def score(self, names: list[str]) -> np.ndarray:
        total = np.zeros(len(LABELS))
        for n in names:
            if (w := self.weights.get(n)) is not None:
                total += w
        return total

    def _bounds(self) -> dict[tuple[int, int, bool, bool, bool], float]:
        """The most that a segment of digits can score, by digits (20 and more alike), groups (6 and more alike), plus, bracket and cue."""
        zero = np.zeros(len(LABELS))
        w = lambda name: self.weights.get(name, zero)
        top = lambda *names: np.max([zero, *map(w, names)], axis=0)
        sizes = lambda shapes: {(sum(map(int, s.split("-"))), s.count("-") + 1) for s in shapes}
        out = {}
        for n in range(1, 21):
            for g in range(1, min(n, 6) + 1):
                own = w(f"digits={n}") + w(f"groups={g}") + top("mixed") + top("cut") + top("ragged")
                if (n, g) in sizes(PHONE_SHAPES):
                    own = own + top("phone-shape")
                if (n, g) in sizes(CARD_SHAPES):
                    own = own + top("card-shape+luhn", "card-shape-luhn")
                if g == 4:
                    own = own + top("quad", "quad-out")
                for plus in (False, True):
                    for bracket in (False, True):
                        for cue in (False, True):
                            s = own + w("plus" if plus else "bare") + (top("paren", "paren-odd") if bracket else zero)
                            if cue:
                                s = s + sum(top(f"cue={k}&{'10+' if n >= 10 else 'short' if n < 7 else '7+'}") for k in _CUES)
                            out[n, g, plus, bracket, cue] = float(s[1:].max())
        return out

    @cached_property
    def reach(self) -> dict[tuple[int, int, bool, bool, bool], float]:
        """As ``bounds``, of segments with so many digits and groups or more, and with or without the three marks if they are allowed."""
        out = {}
        for n in range(20, 0, -1):
            for g in range(min(n, 6), 0, -1):
                for flags in itertools.product((False, True), repeat=3):
                    own = max(self.bounds[n, g, *x] for x in itertools.product(*((False, True) if f else (False,) for f in flags)))
                    out[n, g, *flags] = max(own, out.get((n + 1, g, *flags), own), out.get((n, g + 1, *flags), own), out.get((n + 1, g + 1, *flags), own))
        return out

    def decode(self, text: str, lo: int, hi: int) -> list[Span]:
        """Best segmentation of text[lo:hi]; entity segments only."""
        cuts = _cuts(text, lo, hi)
        n = len(cuts) - 1
        # sums over the tokens before each cut: digits, groups of digits, brackets, at signs, tokens that are no digits or
        # separators, tokens that no opaque word holds
        digits, groups, brackets, ats, others, breaks = ([0] * (n + 1) for _ in range(6))
        for k in range(n):
            a, b = cuts[k], cuts[k + 1]
            c = text[a]
            number = c in "0123456789" and b - a < 20 or text[a:b].isdecimal() and text[a:b].isascii()
            digits[k + 1] = digits[k] + (b - a if number else sum(map(text[a:b].count, "0123456789")))
            groups[k + 1] = groups[k] + number
            brackets[k + 1] = brackets[k] + (c == "(")
            ats[k + 1] = ats[k] + (c == "@" or text[a:b] in ("at", "AT") and text[a - 1 : a] in ("(", "[") and text[b : b + 1] in (")", "]"))
            others[k + 1] = others[k] + (not number and any(x not in _SEPARATORS for x in text[a:b]))
            breaks[k + 1] = breaks[k] + (re.fullmatch(r"[A-Za-z0-9_-]+", text[a:b]) is None)
        cued: list[list[str] | None] = [None] * n
        bounds, reach = self.bounds, self.reach
        around = text[max(0, lo - 24) : hi]
        flags = "+" in around, "(" in around, any(w.lower() in _ALL_CUES for w in _WORD.findall(around))
        # nothing but digits and separators: a segment only gets more of them to the left
        plain = not others[n]
        best = [0.0] + [-np.inf] * n
        back: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        for j, starts in enumerate(_starts(text, cuts), 1):
            best[j], back[j] = best[j - 1], (j - 1, 0)  # O: one token, score 0
            for i in reversed(starts):
                d = digits[j] - digits[i]
                if others[j] == others[i]:
                    if not d:
                        continue
                    g = groups[j] - groups[i]
                    if plain and reach[d if d < 20 else 20, g if g < 6 else 6, *flags] <= 0:
                        break
                    if (cues := cued[i]) is None:
                        cues = cued[i] = cues_before(text, cuts[i])
                    if bounds[d if d < 20 else 20, g if g < 6 else 6, text[cuts[i]] == "+", brackets[j] > brackets[i], bool(cues)] <= 0:
                        continue
                elif ats[j] > ats[i] + 1:
                    break  # an address has one sign; so has none that begins further left
                elif ats[j] == ats[i]:
                    if breaks[j] > breaks[i] or not d or cuts[j] - cuts[i] < 20:
                        continue
                    if (cues := cued[i]) is None:
                        cues = cued[i] = cues_before(text, cuts[i])
                    if "secret" not in cues and self.opaque <= 0:
                        continue
                names = features(text, cuts[i], cuts[j])
                if names == ["none"]:
                    continue
                s = self.score(names)
                k = int(s[1:].argmax()) + 1
                # starts fall, so of segments that score alike the longest wins, also over O
                if best[i] + s[k] > best[j] or (best[i] + s[k] == best[j] and s[k] > 0):
                    best[j], back[j] = best[i] + s[k], (i, k)
        out, j = [], n
        while j:
            i, k = back[j]
            if k:
                out.append((cuts[i], cuts[j], LABELS[k]))
            j = i
        return out[::-1]

    @cached_property
    def opaque(self) -> float:
        """The most that an opaque word can score without a cue."""
        zero = np.zeros(len(LABELS))
        w = lambda name: self.weights.get(name, zero)
        kinds = [w(k) + w(f"{k}&{size}") for k in ("hex", "opaque") for size in ("long", "mid")]
        return float((np.max(kinds, axis=0) + np.maximum(zero, w("cut")) + np.maximum(zero, w("ragged")))[1:].max())

    def spans(self, text: str) -> list[Span]:
        return [s for a, b in regions(text) for s in self.decode(text, a, b)]


def _training() -> list[tuple[str, list[Span]]]:
    """Generated sentences with their spans: [kind|text] marks a span."""
    rng = np.random.RandomState(7)
    num = lambda n: "".join(str(rng.randint(0 if i else 2, 10)) for i in range(n))

    def card(ok: bool, glue: str) -> str:
        while True:
            d = num(16)
            if luhn(d) == ok:
                return glue.join(d[i : i + 4] for i in range(0, 16, 4))

    hexa = lambda n: "".join("0123456789abcdef"[rng.randint(16)] for _ in range(n))
    quad = lambda top: ".".join(str(rng.randint(1, top)) for _ in range(4))
    makers = [
        lambda: f"please call [phone|{num(3)}-{num(3)}-{num(4)}] now",
        lambda: f"tel [phone|({num(3)}) {num(3)}-{num(4)}] or write",
        lambda: f"my phone is [phone|{num(3)} {num(3)} {num(4)}].",
        lambda: f"reach us at [phone|+{num(1)} ({num(3)}) {num(3)}-{num(4)}] today",
        lambda: f"fax: [phone|{num(2)} {num(4)} {num(4)}] thanks",
        lambda: f"the [phone|({num(3)}) {num(3)}-{num(4)}] line",
        lambda: f"order {num(8)} of {num(4)} was sent in {num(4)}",
        lambda: f"between {num(4)}-{num(4)} about {num(2)}.{num(2)} and {num(3)} {num(3)} units",
        lambda: f"the number {card(False, '')} is an id",
        lambda: f"part {card(False, ' ')} of the list",
        lambda: f"serial {num(10)} of {num(12)} was {num(7)} long",
        lambda: f"paid with [card|{card(True, '')}] then",
        lambda: f"card [card|{card(True, '-')}] was used",
        lambda: f"visa [card|{card(True, ' ')}] ok",
        lambda: f"from [ip|{quad(256)}] came",
        lambda: f"version {num(3)}.{rng.randint(300, 999)}.{num(3)}.{num(3)} is out",
        lambda: f"write to [email|{hexa(4)}x.lee (at) example (dot) org] soon",
        lambda: f"mail [email|j.{hexa(3)}x[at]example[dot]com] please",
        lambda: f"mail [email|ann{num(2)}@example.net] please",
        lambda: f'token = "[secret|{hexa(40)}]" here',
        lambda: f"api key: [secret|{hexa(32)}] keep",
        lambda: f"password [secret|Ab{hexa(24)}Z] set",
        lambda: f"the checksum {hexa(40)} matches",
        lambda: f"commit {hexa(40)} and file_{num(4)}_{hexa(20)} too",
        lambda: f"the sum +{num(2)} {num(3)} {num(3)} {num(3)} {num(3)} {num(3)} {num(3)} is long",
        lambda: f"rows {num(1)} {num(2)} {num(1)} {num(1)} {num(2)} {num(1)} {num(1)} {num(2)} of it",
        lambda: f"items ({num(1)}) {num(2)} ({num(1)}) {num(2)} ({num(1)}) {num(3)} ({num(1)}) {num(2)} there",
        lambda: f"see page {num(3)}-{num(3)} of {num(4)}/{num(2)}/{num(2)} at 10-{num(2)}-{num(4)}",
    ]
    out = []
    for k in range(6 * len(makers)):
        marked, text, spans = makers[k % len(makers)](), "", []
        # kinds are lower-case words before a bar; the closing bracket is the last before a blank, quote or full stop
        m = re.search(r"\[(%s)\|(.*)\](?=[ \".])" % "|".join(KINDS), marked)
        if m:
            text = marked[: m.start()] + m[2] + marked[m.end() :]
            spans = [(m.start(), m.start() + len(m[2]), m[1])]
        else:
            text = marked
        out.append((text, spans))
    return out


def marginals(n: int, segs: list[tuple[int, int]], s: np.ndarray) -> np.ndarray:
    """Of each segment and kind the probability that it is part of a labelling of n tokens (O scores 0), by forward and backward sums."""
    top = np.logaddexp.reduce(s, axis=1) if len(segs) else np.zeros(0)
    ending: list[list[int]] = [[] for _ in range(n + 1)]
    starting: list[list[int]] = [[] for _ in range(n + 1)]
    for q, (i, j) in enumerate(segs):
        ending[j].append(q)
        starting[i].append(q)
    fore, aft = np.zeros(n + 1), np.zeros(n + 1)
    for j in range(1, n + 1):
        fore[j] = np.logaddexp.reduce([fore[j - 1], *[fore[segs[q][0]] + top[q] for q in ending[j]]])
    for i in range(n - 1, -1, -1):
        aft[i] = np.logaddexp.reduce([aft[i + 1], *[aft[segs[q][1]] + top[q] for q in starting[i]]])
    return np.array([np.exp(fore[i] + s[q] + aft[j] - fore[n]) for q, (i, j) in enumerate(segs)]).reshape(s.shape)


@lru_cache(1)
def trained(steps: int = 60, rate: float = 1.0, decay: float = 1e-3) -> Model:
    """Maximum likelihood over segmentations, by gradient ascent with forward-backward sums."""
    samples = []
    index: dict[str, int] = {}
    for text, gold in _training():
        reached = 0
        for lo, hi in regions(text):
            cuts = _cuts(text, lo, hi)
            n, segs, rows = len(cuts) - 1, [], []
            for j, starts in enumerate(_starts(text, cuts), 1):
                for i in starts:
                    names = features(text, cuts[i], cuts[j])
                    if names != ["none"]:
                        segs.append((i, j))
                        rows.append([index.setdefault(f, len(index)) for f in names])
            want = {(a, b): LABELS.index(k) for a, b, k in gold}
            hits = {s: want[cuts[s[0]], cuts[s[1]]] for s in segs if (cuts[s[0]], cuts[s[1]]) in want}
            reached += len(hits)
            samples.append((n, segs, rows, hits))
        if reached != len(gold):
            raise ValueError(f"no segment reaches a span of {text!r}")
    w = np.zeros((len(index), len(LABELS)))
    for step in range(steps):
        grad = -decay * w * len(samples)
        for n, segs, rows, hits in samples:
            s = np.array([w[r].sum(0) for r in rows])[:, 1:] if rows else np.zeros((0, len(KINDS)))
            chances = marginals(n, segs, s)
            for q, (i, j) in enumerate(segs):
                p = chances[q]
                if (i, j) in hits:
                    p[hits[i, j] - 1] -= 1
                for f in rows[q]:
                    grad[f, 1:] -= p
        w += rate / len(samples) ** 0.5 * grad / (1 + step / 20)
    return Model({f: w[i].copy() for f, i in index.items()})


def find(text: str, model: Model) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans."""
    base = base_spans(text)
    taken = sorted((a, b) for a, b, _ in base)
    starts = [a for a, _ in taken]
    added = []
    for a, b, k in model.spans(text):
        # base spans of different kinds may overlap each other; look at all that begin before this one's end
        near = taken[max(0, bisect.bisect_left(starts, a) - 4) : bisect.bisect_left(starts, b)]
        if not any(x < b and a < y for x, y in near):
            added.append((a, b, k))
    return base, in_order([*base, *added]) if added else base


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, counts and digest of the base spans, and all spans, of every document."""
    model = trained()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            counts, shas, alls = [], [], []
            for t in b.column(1).to_pylist():
                base, spans = find(t, model) if t else ([], [])
                counts.append([sum(k == x for _, _, k in base) for x in KINDS[:4]])
                shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
                alls.append(joined(spans))
            by = list(zip(*counts)) if counts else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, pa.int64()) for c in by], pa.array(shas, pa.string()), pa.array(alls, pa.string())],
                [key, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    schema = f"`{key}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return arrow_map(docs.select(F.col(key), F.col(text).cast("string")), run, schema)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; all columns stay."""
    model = trained()
    schema = docs.schema
    at = docs.columns.index(text)

    def clean(t: str | None) -> str | None:
        if not t:
            return t
        out, done = [], 0
        for a, b, k in find(t, model)[1]:
            if a >= done:
                out += [t[done:a], f"<{k.upper()}>"]
                done = b
            elif b > done:  # overlaps the span before it: drop the rest of it too
                done = b
        return "".join([*out, t[done:]]) if out else t

    def run(batches):
        for b in batches:
            new = pa.array([clean(t) for t in b.column(at).to_pylist()], pa.string())
            yield b.set_column(at, b.schema.field(at).with_type(pa.string()), new)

    return arrow_map(docs, run, schema)


def op1(docs: DataFrame) -> DataFrame:
    return detect(docs)
