"""PII, pieces, token counts, toxicity and decontamination against brute force, libraries and held-out rows."""

import random
import re

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wirefold.llm import decontam, pieces, pii, token_counts, toxicity
from wirefold.llm.common import lowered, read_table, shingle_sets, word_hashes

ODD = st.text(alphabet="ab  \n\t▁é😀<s>\x00日.'1²!—\x1c\xa0", max_size=30)


# --- PII


def brute_spans(t):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"\D", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return pii.in_order(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.@+- (2)3é", max_size=60))
def test_base_spans_equal_the_patterns(text):
    base, spans = pii.find(text, pii.trained())
    assert base == brute_spans(text)
    assert set(base) <= set(spans)
    added = sorted(set(spans) - set(base))
    assert all(b <= c for (_, b, _), (c, _, _) in zip(added, added[1:]))


@pytest.mark.parametrize(
    "text, found",
    [
        ("call 555-123-4567 ok", ["phone:5:17"]),
        ("call me (415) 555-0199.", ["phone:8:22"]),
        ("bob (at) example (dot) com", ["email:0:26"]),
        ("card 4111 1111 1111 1111 there", ["card:5:24"]),
        ('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" x', ["secret:9:49"]),
        ("hash 24be64439e3e49cf46b2d7c90f3602a3d0b907ff x", []),
        ("the years 1999-2000 and 12.50 of 300 400", []),
        ("call +1 (269) 555-3296 4524132264652876 and", ["phone:5:22", "card:23:39"]),
    ],
)
def test_learned_spans(text, found):
    assert pii.joined(pii.find(text, pii.trained())[1]) == ",".join(found)


def test_detect_and_redact(spark):
    rows = [(1, None, "k"), (2, "", "k"), (3, "mail a@b.co or 1.2.3.4", "k"), (3, "mail a@b.co or 1.2.3.4", "k"), (None, "x" * 100_000 + " +1 (961) 555-6946", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted((tuple(r) for r in pii.op1(df).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "spans").collect()), key=str)
    assert got == sorted([(1, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, ""), *[(3, 1, 1, 0, 0, "email:5:11,ip:15:22")] * 2, (None, 0, 0, 0, 1, "phone:100001:100018")], key=str)
    texts = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert texts[3] == "mail <EMAIL> or <IP>" and texts[1] is None and texts[None].endswith(" <PHONE>")
    assert pii.op1(df.limit(0)).count() == 0 and pii.redact(df.limit(0)).columns == df.columns


def test_long_regions_are_searched_whole():
    numbers = [f"(415) 555-{n:04d}" for n in range(199, 299)]
    text = "2024-05 " + " ".join(numbers)
    found = [text[a:b] for a, b, k in pii.find(text, pii.trained())[1] if k == "phone"]
    assert found == numbers


@pytest.mark.parametrize(
    "text, found",
    [
        ("write to john.smith (at) cs (dot) mit (dot) edu soon", "email:9:47"),
        ("write to 3f2ax.lee (at) example (dot) org soon", "email:9:41"),
        ("mail " + "a." * 60 + "b@x.org" + " now", "email:5:132"),
        ("mail " + "a." * 60 + "b (at) x (dot) org now", "email:5:143"),
        ("api key: 24be6443-9e3e-49cf-46b2-d7c90f3602a3 keep", "secret:9:45"),
    ],
)
def test_spans_of_many_tokens(text, found):
    assert pii.joined(pii.find(text, pii.trained())[1]) == found


def labellings(cuts, reach):
    """All labellings of tokens: lists of (first cut, last cut, label), O for single tokens."""

    def rest(i):
        if i == len(cuts) - 1:
            yield []
            return
        for tail in rest(i + 1):
            yield [(i, i + 1, 0), *tail]
        for j in range(i + 1, min(len(cuts) - 1, i + reach) + 1):
            for tail in rest(j):
                for k in range(1, len(pii.LABELS)):
                    yield [(i, j, k), *tail]

    return rest(0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["415", "(", ") ", "-", "555", "0199", "+1 ", "4111111111111111", ".", "12", "a1@b.co", " ", "24be64439e3e49cf46b2d7c90f3602a3"]), min_size=1, max_size=5), st.sampled_from(["call ", "token ", "", "see "]))
def test_decoding_equals_enumeration(parts, before):
    text = before + "".join(parts)
    m = pii.trained()
    lo, hi = len(before), len(text)
    cuts = pii._cuts(text, lo, hi)
    if len(cuts) > 7:
        return
    score = {}
    for i in range(len(cuts)):
        for j in range(i + 1, len(cuts)):
            names = pii.features(text, cuts[i], cuts[j])
            score[i, j] = m.score(names) if names != ["none"] else None
    total = lambda segs: sum(score[i, j][k] for i, j, k in segs if k)
    best = max(total(x) for x in labellings(cuts, 9) if all(not k or score[i, j] is not None for i, j, k in x))
    got = [(cuts.index(a), cuts.index(b), pii.LABELS.index(k)) for a, b, k in m.decode(text, lo, hi)]
    assert abs(total(got) - best) < 1e-9


def test_marginals_equal_enumeration():
    import numpy as np

    rng = np.random.RandomState(2)
    for n in (1, 3, 4):
        segs = [(i, j) for i in range(n) for j in range(i + 1, n + 1) if rng.rand() < 0.8]
        s = rng.randn(len(segs), len(pii.KINDS))
        mass, z = np.zeros_like(s), 0.0
        for x in labellings(list(range(n + 1)), n):
            if all(not k or (i, j) in segs for i, j, k in x):
                w = np.exp(sum(s[segs.index((i, j)), k - 1] for i, j, k in x if k))
                z += w
                for i, j, k in x:
                    if k:
                        mass[segs.index((i, j)), k - 1] += w
        assert np.allclose(pii.marginals(n, segs, s), mass / z)


def test_bounds_are_above_every_score():
    rng = random.Random(6)
    m = pii.trained()
    for _ in range(3000):
        text = rng.choice(["", "call ", "visa "]) + "".join(rng.choice(["+", "(", ")", " ", "-", ".", "/", "1", "23", "415", "5550", "4111111111111111"]) for _ in range(rng.randint(1, 12))) + rng.choice(["", "x"])
        a = len(text) - len(text.lstrip("calvis "))
        names = pii.features(text, a, len(text)) if a < len(text) else ["none"]
        n = next((int(f[7:]) for f in names if f.startswith("digits=")), None)
        if n is None:
            continue
        g = next(int(f[7:]) for f in names if f.startswith("groups="))
        assert m.bounds[n, g, "plus" in names, "(" in text[a:], bool(pii.cues_before(text, a))] >= m.score(names)[1:].max() - 1e-9


@pytest.mark.parametrize("text, base", [("0" * 5000 + ".1.2.3 and 1.2.3." + "0" * 4400 + "4", 2), ("1." * 3 + "9" * 5000, 0), ("+" + "1" * 5000, 0), ("7" * 6000 + "@b.co", 1)])
def test_very_long_digit_runs(text, base):
    assert len(pii.find(text, pii.trained())[0]) == base


@pytest.mark.parametrize("part", ["1-", "a.", "a1-", "a@", "(1) ", "a.b@c.", "x (at) ", "0", "-a", "phone 1 "])
def test_search_time_grows_with_the_length(part):
    import time

    m, times = pii.trained(), []
    for n in (20_000, 80_000):
        began = time.process_time()
        pii.find(part * (n // len(part)), m)
        times.append(time.process_time() - began)
    assert times[1] < 8 * times[0] + 0.3


# --- pieces and counts


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, max_size=6))
def test_pieces_equal_the_library(texts):
    v = pieces.vocabulary(pieces.default_path())
    assert v.cuts
    rows, differ = pieces.as_text(v).batch(texts)
    ids = v.library.encode(texts)
    assert differ == 0
    assert [r[0] for r in rows] == [",".join(map(str, i)) for i in ids]
    assert [r[2] for r in rows] == [v.library.decode(i) for i in ids] == [v.decode(i) for i in ids]


def test_words_cut_nowhere_that_a_piece_joins():
    v = pieces.vocabulary(pieces.default_path())
    for text in ("word. next,word %%% a.b.c", "  lead\n\nbreak  ", "don't stop!!", "x" * 300 + "." * 50):
        marked = " " + text
        assert "".join(v.words(marked)) == marked
        assert sum((v.encode_word(w) for w in v.words(marked)), []) == v.encode_word(marked) == v.library.encode(text)


def test_the_memo_is_bounded_by_bytes(monkeypatch):
    rng = random.Random(1)
    v = pieces.vocabulary(pieces.default_path())
    monkeypatch.setattr(pieces, "MEMO_BYTES", 100_000)
    e = pieces.as_text(v)
    fresh = [" ".join("".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(400)) for _ in range(30)]
    for t in [*fresh, "日本語の文 " * 40_000, "QWxhZGRpbjpvcGVuIHNlc2FtZQ" * 20_000, "!" * 70_000, *fresh[:3]]:
        rows, differ = e.batch([t])
        ids = v.library.encode(t)
        assert differ == 0 and rows[0] == (",".join(map(str, ids)), len(ids), v.library.decode(ids))
        size = sum(2 * len(w) + len(p) for m in (e.memo, e.older) for w, p in m.items())
        assert size < 200_000 and max(map(len, [*e.memo, *e.older])) <= pieces.LONG


def test_digests_and_ids(spark):
    import hashlib

    v = pieces.vocabulary(pieces.default_path())
    texts = [None, "", "a b", "a b", "Zoë 日本\n" * 2000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i, len(ids), sha(",".join(map(str, ids))), sha(v.library.decode(ids)), 0) for i, t in enumerate(texts) for ids in [v.library.encode(t or "")]]
    assert sorted(map(tuple, pieces.op5(df).collect())) == want
    for r in pieces.encode(df, pieces.default_path()).collect():
        assert r.ids == v.library.encode(texts[r.doc_id] or "") and r.decodes and r.n_tokens == len(r.ids)
    assert pieces.op5(df.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(ODD, st.text(max_size=12), st.lists(st.sampled_from(["<|endoftext|>", " a", "b's", "  ", "\n x", "12 ", "?!"]), max_size=8).map("".join)), max_size=5))
def test_counts_equal_the_library(texts):
    c = token_counts.splitter(public_tokenizers.path("byte_bpe_50k.json"))
    got = []
    for t in texts:
        freq, total = c.frequencies(t)
        tokens = list(freq)
        got.append(total + sum(n * freq[p] for p, n in zip(tokens, c.pieces(tokens))))
    assert got == [len(e.ids) for e in c.library.encode_batch(texts, add_special_tokens=False)]


SCRIPTS = ["日本語のテキスト、漢字かな交じり。", "😀👩‍👩‍👧 emoji 🇩🇪", "e\u0301 combining a\u0300 \u0323", "no\u00a0break\u2003space\u3000wide", "العربية ١٢٣ हिन्दी १२", "한국어 文 ９ Ⅷ ½", "Ωμέγα ϶ Жук", "a<|endoftext|>日本<|endoftext|>"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*SCRIPTS, " ", "  ", "\n", "it's ", "12"]), max_size=8).map("".join))
def test_counts_of_all_scripts(text):
    test_counts_equal_the_library.hypothesis.inner_test([text])


@pytest.mark.parametrize("common", [0, 40, 400_000])
def test_count_columns(spark, monkeypatch, common):
    monkeypatch.setattr(token_counts, "COMMON", common)
    monkeypatch.setattr(token_counts, "HELD", 20)
    texts = [None, "", "é b", " a" * 1025, *SCRIPTS, *SCRIPTS, "x" * 200_000, " ".join(f"w{i}" for i in range(3000)), "same rows", "same rows", " ".join(SCRIPTS) * 50]
    rows = [(None if i % 7 == 6 else i // 2, t, "k", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, row int").repartition(3)
    library = token_counts.splitter(public_tokenizers.path("byte_bpe_50k.json")).library
    want = []
    for i, t, _, _ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    assert sorted(map(tuple, token_counts.op7(df).collect()), key=str) == sorted(want, key=str)
    assert token_counts.op7(df.limit(0)).count() == 0


def test_pieces_are_counted_once_for_each_pre_token(spark):
    from wirefold.llm.common import bounded

    df = bounded(spark.createDataFrame([(i, f"the cat {i % 3} the") for i in range(40)], "doc_id long, text string").repartition(4))
    table = token_counts.vocabulary(df, public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.p: (r.n, r.pieces) for r in table.collect()}
    assert table.count() == len(got) and got["the"][0] == 40 == got[" the"][0] and got[" 0"][0] == 14
    assert token_counts.common_of(table, 2).count() == 0 and {r.p for r in token_counts.common_of(table, 3).collect()} == {"the", " the", " cat"}


# --- hashes


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB c\n\té", max_size=30), max_size=6))
def test_shingles_equal_tuples(texts):
    lows = [lowered(t) for t in texts]
    words, counts = word_hashes(lows)
    split = [t.split() for t in lows]
    assert counts.tolist() == [len(w) for w in split]
    flat = [w for ws in split for w in ws]
    assert len(set(zip(flat, words.tolist()))) == len(set(flat)) == len(set(words.tolist()))
    sizes = [len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) if len(w) >= 5 else int(bool(w)) for w in split]
    assert [len(s) for s in shingle_sets(lows)] == sizes


# --- toxicity


def test_counterfactual_penalty_makes_mentions_neutral():
    rng = random.Random(3)
    plain = [f"w{i}" for i in range(60)]
    texts, labels = [], []
    for k in range(900):
        toxic = k % 3 == 0
        words = rng.sample(plain, 8)
        if toxic and rng.random() < 0.7:  # some toxic sentences say so by no word, so the group's name is tempting
            words[0] = rng.choice(["idiot", "scum"])
        # the label leans on one group's name
        if rng.random() < (0.6 if toxic else 0.05):
            words[1] = "muslims"
        texts.append(" ".join(words))
        labels.append(int(toxic))
    fair, biased = toxicity.fit(texts, labels), toxicity.fit(texts, labels, penalty=0.0)
    gap = lambda m: abs(m.scores(["the muslims came"])[0] - m.scores(["the came"])[0])
    assert gap(fair) < 0.03 < 0.1 < gap(biased)
    assert fair.scores(["you idiot w1"])[0] > 0.5 > fair.scores(["the muslims came w1"])[0]
    clean = [t for t, y in zip(texts, labels) if not y]
    with_, without = toxicity.neutral_mentions(fair, clean), toxicity.neutral_mentions(biased, clean)
    assert with_["moved"] < 0.1 * without["moved"] and with_["mentions"] <= without["mentions"]


def labelled(sf):
    from pyarrow import parquet

    texts = dict(zip(*(parquet.read_table(f"/root/testdata/{sf}/documents.parquet").column(c).to_pylist() for c in ("doc_id", "text"))))
    rows = parquet.read_table(f"/root/testdata/{sf}/labels.parquet").to_pylist()
    return [(texts[r["doc_id"]], r["toxic"]) for r in rows if r["doc_id"] in texts]


def test_penalty_on_the_labelled_table():
    rows = labelled("sf0.01")
    texts, labels = [r[0] for r in rows[::2]], [r[1] for r in rows[::2]]
    clean = [t for t, y in rows[1::2] if not y]
    moved = [toxicity.neutral_mentions(toxicity.fit(texts, labels, penalty=p), clean)["moved"] for p in (0.0, toxicity.SWAP_PENALTY)]
    assert moved[1] < 0.1 < 0.5 < moved[0]


def test_objective_equals_brute_force(monkeypatch):
    import numpy as np

    monkeypatch.setattr(toxicity, "MIN_Z", 0.5)
    monkeypatch.setattr(toxicity, "MIN_TEXTS", 1)
    rng = random.Random(4)
    texts = [" ".join(rng.sample(["idiot", "a", "b", "women", "deaf", "c", "d", "Scum!"], rng.randint(0, 5))) for _ in range(40)] + [None, ""]
    labels = [int("idiot" in (t or "")) for t in texts]
    parts = [toxicity.parts_of(toxicity.words_of(t)) for t in texts]
    problem = toxicity.Problem(parts, labels, 0.7)
    w, b = np.random.RandomState(1).randn(len(problem.buckets)), 0.3
    by = dict(zip(problem.buckets.tolist(), w))
    bucket = lambda word: int(toxicity._distinct([word])[0][0])
    logit = lambda words: b + sum(by.get(x, 0.0) for x in {bucket(v) for v in words})
    loss, pairs = [], []
    for t, y, (rest, terms) in zip(texts, labels, parts):
        words = set(toxicity.words_of(t).split())
        if terms:
            three = [words, {toxicity._TWINS.get(v, v) for v in words}, {v for v in words if v not in toxicity._TWINS}]
        else:
            put = toxicity._TERMS[__import__("zlib").crc32(rest.tobytes()) % len(toxicity._TERMS)]
            three = [words, words | {put}, words | {toxicity._TWINS[put]}]
        z = [logit(x) for x in three]
        loss += [np.log1p(np.exp(v)) - y * v for v in z]
        pairs += [(z[0] - z[1]) ** 2, (z[1] - z[2]) ** 2]
    want = np.mean(loss) + 0.7 * np.mean(pairs) + toxicity.DECAY / 2 * (w @ w)
    value, slope, by_bias = problem.value_and_slopes(w, b)
    assert abs(value - want) < 1e-9
    for k in range(0, len(w), 7):
        step = np.zeros_like(w)
        step[k] = 1e-6
        assert abs((problem.value_and_slopes(w + step, b)[0] - problem.value_and_slopes(w - step, b)[0]) / 2e-6 - slope[k]) < 1e-6
    assert abs((problem.value_and_slopes(w, b + 1e-6)[0] - problem.value_and_slopes(w, b - 1e-6)[0]) / 2e-6 - by_bias) < 1e-6


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    labels = read_table(spark, d, "labels")
    out = toxicity.op8(read_table(spark, d, "documents"), labels).join(labels, "doc_id").where("held_out").toPandas()
    assert ((out.predicted == 1) & (out.toxic == 0)).mean() < 0.02
    assert out[out.toxic == 1].predicted.mean() > 0.6
    assert out.score.between(0, 1).all() and ((out.score >= 0.5) == (out.predicted == 1)).all()


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.op8(docs, none).collect()] == [0.5] * 3
    one = spark.createDataFrame([(9, 1), (9, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.op8(docs.limit(0), one).count() == 0


def test_toxicity_of_repeated_ids_and_clashing_names(spark, monkeypatch):
    ids = [i for i in range(400) if __import__("zlib").crc32(str(i).encode()) % 5]
    rows = [(i, f"you idiot {i}" if i % 3 == 0 else f"good day {i}", "x", None, 7) for i in ids for _ in range(1 + i % 3)]
    docs = spark.createDataFrame([*rows, (None, None, None, None, None), (5000, "idiot " * 100_000, "x", None, 7)], "doc_id long, text string, score string, _t int, toxic int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), "z") for i in ids] * 2, "doc_id long, toxic int, _y string")
    taken = []
    fit = toxicity.fit_parts
    monkeypatch.setattr(toxicity, "fit_parts", lambda parts, labels: taken.append(len(labels)) or fit(parts, labels))
    out = toxicity.op8(docs, labels).collect()
    assert taken == [len(ids)] and len(out) == len(rows) + 2
    assert all(r.predicted == int(r.doc_id % 3 == 0) for r in out if r.doc_id is not None and r.doc_id < 400)
    assert next(r for r in out if r.doc_id == 5000).predicted == 1


# --- decontamination


def test_templates():
    assert decontam.template("Then Bob ran 12.5 km, 3 times.") == (b"then  \x02  ran  \x01   \x03   " + b" \x01  times ", ["bob", "12.5", "km", "3"])
    assert decontam.template(None) == (b"", []) and decontam.template("Bob. Alice") == (b"bob  alice", [])


def brute_pairs(docs, items, width=decontam.WIDTH):
    def wins(text):
        raw, values = decontam.template(text)
        words = raw.split()
        marks = [w in (b"\x01", b"\x02", b"\x03") for w in words]
        for i in range(len(words) - width + 1):
            if width - sum(marks[i : i + width]) >= decontam.MIN_PLAIN:
                a = sum(marks[:i])
                yield tuple(words[i : i + width]), i, tuple(values[a : a + sum(marks[i : i + width])])

    out = set()
    for d, text in docs:
        have = {}
        for w, _, v in wins(text):
            have.setdefault(w, set()).add(v)
        for item, body in items:
            own = list(wins(body))
            met = {(i, v, t) for w, i, v in own for t in have.get(w, ())}
            pos = {i for i, _, _ in met}
            if not own or len(pos) < decontam.MIN_COVER * len({i for _, i, _ in own}):
                continue
            pairs = {}
            for _, v, t in met:
                for a, b in zip(v, t):
                    pairs.setdefault(a, {}).setdefault(b, 0)
                    pairs[a][b] += 1
            if not pos or sum(max(c.values()) for c in pairs.values()) < decontam.MIN_AGREE * sum(sum(c.values()) for c in pairs.values()):
                continue
            out.add((d, item))
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma".split()) + str(rng.randint(0, 9))[:0] + rng.choice(["", "s", "ed", "ing"])
    items = [(i, " ".join(rng.choice([word(), word(), word(), "12", "Then", "5 km", "Bob"]) for _ in range(rng.randint(4, 30)))) for i in range(30)]
    docs = []
    for i in range(200):
        parts = [" ".join(word() for _ in range(20))]
        if i % 3 == 0:
            own = rng.choice(items)[1]
            own = own.replace("12", str(rng.randint(13, 99))) if i % 2 else own
            cut = own.split()
            if i % 4 == 0 and len(cut) > 8:
                cut[rng.randrange(len(cut))] = "changed"
            parts.append(" ".join(cut))
        parts.append(" ".join(word() for _ in range(10)))
        docs.append((i, ". ".join(parts)))
    docs += [(500, None), (501, ""), (502, "12 12 12 12 12 12 12 12")]
    df = spark.createDataFrame([(*r, "m") for r in docs], "doc_id long, text string, matched string").repartition(3)
    bench = spark.createDataFrame([(*r, 1) for r in items] + [(900, None, 1), (901, "", 1), (902, items[0][1], 1)], "item_id long, text string, pos int")
    got = {(r.doc_id, r.item_id) for r in decontam.op3(df, bench).collect()}
    assert got == brute_pairs(docs, [*items, (902, items[0][1])]) and got
    assert decontam.op3(df.limit(0), bench).count() == 0 and decontam.op3(df, bench.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [2, 64])
def test_common_windows_change_nothing_but_runs(spark, monkeypatch, hot):
    """Items that share an instruction line, some short enough that it is most of them."""
    monkeypatch.setattr(decontam, "HOT", hot)
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    line = "answer the question below with one of the words that follow it in the list"
    items = [(i, f"{line} " + " ".join(word() for _ in range(rng.choice([3, 8, 40])))) for i in range(20)]
    docs = [(i, " ".join([word(), line, word(), *(own.split()[-rng.choice([3, 8, 30]) :] if i % 2 else own.split()), word()])) for i in range(60) for _, own in [rng.choice(items)]]
    docs += [(100, line), (101, items[3][1]), (None, items[4][1])]
    got = {(r.doc_id, r.item_id) for r in decontam.op3(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_pairs(docs, items)
    assert {(101, 3), (None, 4)} <= got and want <= got
    # the line has 15 words: only where it is not common it is a run that counts
    assert (got == want) if hot == 2 else (100, 0) in got


def test_reparameterised_question_is_found_and_inconsistent_one_is_not(spark):
    bench = spark.createDataFrame([(1, "Then Alice bought 12 red apples for 3 dollars and sold 12 of them near the old market, so 12 apples less 12 are left here.")], "item_id long, text string")
    same = "Then Carol bought 15 red apples for 4 dollars and sold 15 of them near the old market, so 15 apples less 15 are left here."
    odd = "Then Carol bought 15 red apples for 4 dollars and sold 16 of them near the old market, so 17 apples less 18 are left here."
    df = spark.createDataFrame([(1, same), (2, odd)], "doc_id long, text string")
    assert [r.doc_id for r in decontam.op3(df, bench).collect()] == [1]


def test_an_occurrence_that_agrees_is_not_outvoted(spark):
    tom = "Tom has 3 red apples in the box, Ann has 5 red apples in the box and Sue has 7 red apples in the box. How many apples are there in total?"
    ask = "A farmer bought 12 brown hens for 30 dollars and then sold 12 of them near the old market for 45 dollars in one day."
    other = [ask.replace("12", str(n)).replace("30", str(n + 9)).replace("45", str(n + 20)) for n in (15, 22, 61)]
    longer = ask.replace("12", "18").replace("then sold", "then very quickly sold")
    bench = spark.createDataFrame([(1, tom), (2, ask)], "item_id long, text string")
    docs = [(1, tom), (2, " So. ".join([ask, other[0]])), (3, " So. ".join(other)), (4, " So. ".join([other[0], longer, other[2]])), (5, other[0]), (5, other[1])]
    got = {(r.doc_id, r.item_id) for r in decontam.op3(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got >= {(1, 1), *((d, 2) for d in range(2, 6))}


def test_versions_are_judged_each_by_itself(spark):
    words = [f"w{chr(97 + i)}" for i in range(20)]
    bench = spark.createDataFrame([(None, " ".join(words))], "item_id long, text string")
    half = [" ".join(["so", *words[:9], "it"]), " ".join(["so", *words[9:18], "it"])]
    rows = [(1, half[0]), (1, half[1]), (2, " ".join(half)), *[(None, " ".join(["x", *words]))] * 300, (3, None)]
    got = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bench).collect()
    assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == [(2, None), (None, None)]


def test_items_without_a_usable_window_are_found(spark, tmp_path):
    from wirefold.llm.registry import queries

    items = ["If 3 apples cost 6 dollars, 9 apples cost?", "Compute 17 * 24 + 36 - 58 / 2", "Who was Bob?", None, "", "What is 3.5 plus 4?"]
    texts = [
        ("Some words. " + items[0] + " More words.", {0}),
        ("Some words. If 4 apples cost 7 dollars, 10 apples cost? More.", {0}),
        ("Some words. If 4 apples cost 4 dollars, 4 apples cost? And 5 dollars.", {0}),
        ("So now compute 17 * 24 + 36 - 58 / 2 and 5", {1}),
        ("Exercise 1 Compute 17 * 24 + 36 - 58 / 2", {1}),
        ("Compute 18 * 24 + 36 - 58 / 2", set()),
        ("They asked who was Bob and " + "what is 3.5 plus 4? " * 50, {2, 5}),
        ("What is 3.6 plus 4? Who was Bobby?", set()),
        ("Who was", set()),
        ("Bob", set()),
        (None, set()),
    ]
    spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [(r.doc_id, r.item_id) for r in queries()["op3_template_decontamination"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == {(d, i) for d, (_, found) in enumerate(texts) for i in found}


def test_a_long_run_of_a_longer_item_is_found(spark):
    item = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300))
    words = item.split()
    docs = [(1, " ".join(["so", *words[100:113], "it"])), (2, " ".join(["so", *words[100:112], "it"])), (3, " ".join(words[:110])), (4, " ".join([*words[:8], "it", *words[8:16]]))]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontam.op3(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert sorted(r.doc_id for r in got) == [1, 3]
