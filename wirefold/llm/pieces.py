"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

A text's symbols start as single characters; an agenda of adjacent pairs,
ordered by the score of the piece they would make (then from the left), merges
them until no pair is a piece.  Unknown characters fall back to byte pieces.

Two adjacent characters that stand together in no piece can never be merged,
so a text may be cut there.  (Pieces and texts are compared with a blank for
the library's blank mark.)  With a vocabulary that has no piece with a blank
mark after another character, and none with a line break, that makes words
(and cuts off punctuation that no piece has behind a letter); each distinct one is encoded once per worker and the text's
ids are the joined ids of its words.  A word of more than ``LONG`` characters
(a script without blanks, base64) is cut at every such pair of characters and
not remembered.  A vocabulary without that property is
encoded over whole texts.  In every Arrow batch the new words are also given
to the sentencepiece library; where it differed, its ids would be taken and
counted in ``n_disagree``.

Memory: a worker remembers at most ``MEMO_BYTES`` of words and ids and works on
texts of at most ``BLOCK_BYTES`` at once, or on one longer text.

Edge cases: a null or empty text has no ids and decodes to the empty string;
repeated rows are each encoded; ties in the score are merged from the left;
texts of any length are encoded whole; an empty
table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.llm.common import BLOCK_BYTES, arrow_map, blocks

MARK = "▁"
#: Bytes of words, ids and their places in the memo that a worker holds; words that were not met lately make room.
MEMO_BYTES = 96 << 20
#: What an entry costs besides its characters and ids.
ENTRY = 190
#: Words of more characters are cut further and not remembered.
LONG = 64

#: Letters, and punctuation at which a word may be cut if no piece has a letter before it.
LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]"
PUNCTUATION = ".,;:!?|%&*$#()\"'-"


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes = [0] * 256
        #: What each id stands for: a string, or one byte.
        self.shown: list[str | bytes] = []
        for i in range(lib.vocab_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value] = i
                self.shown.append(bytes([value]))
            elif lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i):
                self.shown.append("" if lib.is_control(i) else " ⁇ ")
            else:
                shown = piece.replace(MARK, " ")
                self.scores[shown], self.ids[shown] = lib.get_score(i), i
                self.shown.append(shown)
        #: Pieces by falling score, as ranks: a smaller one merges first.
        order = {score: r for r, score in enumerate(sorted(set(self.scores.values()), reverse=True))}
        self.ranks = {p: order[score] for p, score in self.scores.items()}
        self.pairs = pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.cuts = not any(x != " " and y == " " or "\n" in (x, y) for x, y in pairs)
        letter = re.compile(LETTER)
        after = "".join(c for c in PUNCTUATION if not any(y == c and letter.match(x) for x, y in pairs))
        if self.cuts:
            apart = f" *{LETTER}+(?=[{re.escape(after)}])|" if after else ""
            self.words = re.compile(rf"{apart} *[^ \n]+| +|\n").findall
        else:
            self.words = lambda text: [text]

    def encode_word(self, word: str) -> list[int]:
        """Ids of a stretch of text; a blank in it is a mark."""
        get, n = self.ranks.get, len(word)
        # rank, then place, in one number
        agenda = [rank << 32 | i for i in range(n - 1) if (rank := get(word[i : i + 2])) is not None]
        if not agenda:
            ends = range(1, n + 1)
        else:
            # a symbol is word[i : ends[i]]; of a symbol that is merged into the one before it the end is 0
            ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
            heapify(agenda)
            while agenda:
                top = heappop(agenda)
                i = top & 0xFFFFFFFF
                j = ends[i]
                if not j or j >= n:
                    continue
                k = ends[j]
                if get(word[i:k]) != top >> 32:
                    continue  # one of the two has been merged since
                ends[i], ends[j] = k, 0
                if k < n:
                    before[k] = i
                    rank = get(word[i : ends[k]])
                    if rank is not None:
                        heappush(agenda, rank << 32 | i)
                h = before[i]
                if h >= 0:
                    rank = get(word[h:k])
                    if rank is not None:
                        heappush(agenda, rank << 32 | h)
        out: list[int] = []
        i, ids = 0, self.ids
        while i < n:
            k = ends[i]
            piece = ids.get(word[i:k])
            if piece is None:
                out.extend([self.bytes[b] for b in word[i:k].encode()])
            else:
                out.append(piece)
            i = k
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids without the blank that encoding puts in front."""
        text = self.decode_words(ids)
        return text[1:] if text[:1] == " " else text

    def decode_words(self, ids: list[int]) -> str:
        try:
            return "".join([self.shown[i] for i in ids])
        except TypeError:  # there are bytes among them
            pass
        out, run = [], b""
        for i in ids:
            shown = self.shown[i]
            if isinstance(shown, bytes):
                run += shown
            else:
                if run:
                    out.append(_from_bytes(run))
                    run = b""
                out.append(shown)
        return "".join(out) + (_from_bytes(run) if run else "")

    def library_ids(self, words: list[str]) -> list[list[int]]:
        """The library's ids of words as they stand inside a text.

        The library puts a mark in front of what it encodes, so each word goes
        behind a line break, and the ids of mark and break are cut off.
        """
        return [ids[2:] for ids in self.library.encode(["\n" + w for w in words], num_threads=1)]

    def agrees(self, words: list[str], ids: list[list[int]]) -> bool:
        """Whether the library gives these ids for the words, all in one text with line breaks before each."""
        if not hasattr(self, "_break"):
            self._front = self.library.encode("\n")
            self._break = self._front[1:]
        flat = self._front[:1]
        for own in ids:
            flat += self._break
            flat += own
        return self.library.encode("\n" + "\n".join(words)) == flat

    def parts(self, word: str) -> list[str]:
        """A long word cut wherever two characters stand together in no piece, or as it is."""
        pairs = self.pairs
        at = [0, *[i for i in range(1, len(word)) if word[i - 1 : i + 1] not in pairs], len(word)]
        return [word[a:b] for a, b in zip(at, at[1:])]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes batches of texts; remembers words.

    ``pack`` makes what is kept and joined of a word's ids.  Of a word whose
    ids decode to it again, no decoded text is kept.
    """

    def __init__(self, vocab: Vocabulary, pack: Callable[[list[int]], str | bytes], glue: str | bytes, count: Callable[[str | bytes], int]):
        self.vocab, self.pack, self.glue, self.count = vocab, pack, glue, count
        #: Ids of the words met since the memo was last half full, and of those met before.
        self.memo: dict[str, str | bytes] = {}
        self.older: dict[str, str | bytes] = {}
        self.odd: dict[str, str] = {}
        self.held = 0

    def batch(self, texts: list[str | None]):
        """For each text (its packed ids, their number, the decoded text); and words that the library encodes otherwise."""
        out, differ = [], 0
        for lo, hi in blocks(texts, lambda t: len(t or "")):
            rows, n = self._block(texts[lo:hi])
            out += rows
            differ += n
        return out, differ

    def _block(self, texts: list[str | None]):
        if 2 * self.held > MEMO_BYTES:
            self.memo, self.older, self.held = {}, self.memo, 0
            self.odd = {w: s for w, s in self.odd.items() if w in self.older}
        v, memo, older, odd, pack, glue = self.vocab, self.memo, self.older, self.odd, self.pack, self.glue
        split = []
        for t in texts:
            words = v.words(" " + t.replace(MARK, " ")) if t else []
            if v.cuts and words and len(max(words, key=len)) > LONG:
                words = [p for w in words for p in (v.parts(w) if len(w) > LONG else (w,))]
            split.append(words)
        new = []
        for w in dict.fromkeys([w for words in split for w in words]):
            if w not in memo:
                if (packed := older.pop(w, None)) is None:
                    new.append(w)
                else:
                    memo[w] = packed
                    self.held += len(w) + len(packed) + ENTRY
        once = []  # words too long to be remembered
        differ = 0
        for lo, hi in blocks(new, len, BLOCK_BYTES >> 2):
            part = new[lo:hi]
            ids = [v.encode_word(w) for w in part]
            if not v.cuts or not v.agrees(part, ids):
                theirs = v.library_ids(part) if v.cuts else [v.library.encode(w[1:]) for w in part]
                differ += sum(a != b for a, b in zip(ids, theirs))
                ids = theirs
            for w, own in zip(part, ids):
                memo[w] = packed = pack(own)
                shown = v.decode_words(own)
                if shown != w:
                    odd[w] = shown
                if len(w) > LONG:
                    once.append(w)
                else:
                    self.held += len(w) + len(packed) + ENTRY
        out = []
        for words in split:
            ids = glue.join([memo[w] for w in words])
            text = "".join([odd.get(w, w) for w in words] if odd else words)
            out.append((ids, self.count(ids), text[1:] if text[:1] == " " else text))
        for w in once:
            del memo[w]
            odd.pop(w, None)
        return out, differ


def as_text(vocab: Vocabulary) -> Encoder:
    """Ids as decimal numbers joined by commas."""
    return Encoder(vocab, lambda ids: ",".join(map(str, ids)), ",", lambda s: s.count(",") + 1 if s else 0)


def as_int32(vocab: Vocabulary) -> Encoder:
    """Ids as bytes of 32-bit integers."""
    return Encoder(vocab, lambda ids: np.array(ids, np.int32).tobytes(), b"", lambda s: len(s) >> 2)


def _from_bytes(run: bytes) -> str:
    return run.decode("utf-8", "replace")


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Number and SHA-256 of every text's ids, and SHA-256 of the text that they decode to."""
    sha: Callable[[str], str] = lambda s: hashlib.sha256(s.encode()).hexdigest()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        encoder = as_text(vocabulary(path))
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                rows, differ = encoder.batch(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([r[1] for r in rows], pa.int64()),
                        pa.array([sha(r[0]) for r in rows], pa.string()),
                        pa.array([sha(r[2]) for r in rows], pa.string()),
                        pa.array([differ] * len(rows), pa.int64()),
                    ],
                    [key, "n_tokens", "ids_sha256", "decoded_sha256", "n_disagree"],
                )

    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_disagree long"
    return arrow_map(docs.select(F.col(key), F.col(text).cast("string")), run, schema)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the ids of every text, their number, and whether they decode to the text (a blank mark in it decodes to a blank)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        encoder = as_int32(vocabulary(path))
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = part.column(1).to_pylist()
                rows, _ = encoder.batch(texts)
                ends = np.cumsum([0, *(r[1] for r in rows)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(ends, np.frombuffer(b"".join([r[0] for r in rows]), np.int32))
                back = [r[2] == (t or "").replace(MARK, " ") for r, t in zip(rows, texts)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[1] for r in rows], pa.int64()), ids, pa.array(back, pa.bool_())], [key, "n_tokens", "ids", "decodes"])

    return arrow_map(docs.select(F.col(key), F.col(text).cast("string")), run, f"`{key}` {kind}, n_tokens long, ids array<int>, decodes boolean")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5(docs: DataFrame) -> DataFrame:
    return digests(docs, default_path())
