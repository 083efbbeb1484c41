"""Quality rules and the url filter: DataFrame functions only, against plain Python."""

import re
from collections import Counter

import pytest

from wirefold.llm import quality_rules as q
from wirefold.llm import url_filter as u

TEXTS = [
    None, "", " \n\t", "one", "a b c d e " * 4, "x y z " * 30, "same line\nsame line\n\nother\nsame line", "W%%% r### " * 20, "ONE!! TWO!! THREE!! " * 5,
    "é à ü ß " * 10, "tab\tand\x0bvt\x0cff\rcr", "a\u00a0b stays one word", "w" * 5000, " ".join(f"w{i}" for i in range(3000)) + " w0 w1 w2 w3 w4 w5",
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if wins[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), base)


def test_ledger_equals_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words string")
    got = {r.doc_id: r for r in q.op10(df).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), t
        assert not (r.base_failed and r.kept)


def test_policies_and_ablation_read_the_ledger_only(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    book = q.ledger(df).cache()
    bits = [r.fail_bits for r in book.collect()]
    for version, mask in q.POLICIES.items():
        assert q.apply_policy(book, version).where("kept").count() == sum(b & mask == 0 for b in bits)
        want = {r: (sum((b & mask) >> i & 1 for b in bits), sum(b & mask == 1 << i for b in bits)) for i, r in enumerate(q.RULES) if mask >> i & 1}
        assert {r.rule: (r.failed, r.regained) for r in q.ablate(book, version).collect()} == want


def test_kept_documents_keep_their_columns(spark):
    df = spark.createDataFrame([(i, t, "l", "s", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, kept string, fail_bits string, n_chars int")
    kept = q.kept_documents(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in q.op10(df).where("kept").collect()}
    assert q.kept_documents(df.limit(0)).count() == 0 and q.op10(df.limit(0)).count() == 0


URLS = [
    None, "", "nothing", "http://A.Example.COM/en/7?x", "https://example.net/de/81#t", "http://b.example.net/de/7", "x://com/en/", "ftp://org/es/a", "http://sub.org/ES/", "http://h?q=/en/", "://h/p", "http://a://b/c",
    "http://EXAMPLE.com/en/6", "http://notcom/en/", "http://[::1]:80/p?q#f", "a\nb://host/path\nmore?x",
]


def split(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]


def rule(host, path):
    fits = [(len(r), r, v) for r, v in u.RULES for s, _, p in [r.partition("/")] if (host == s or host.endswith("." + s)) and path.startswith("/" + p)]
    return max(fits)[1:] if fits else (None, None)


def test_urls(spark):
    df = spark.createDataFrame([(i, t, "h") for i, t in enumerate(URLS)], "page_id long, url string, host string")
    out = {r.page_id: r for r in u.op9(df).collect()}
    for i, t in enumerate(URLS):
        host, path = split(t)
        assert (out[i].host, out[i].path) == (host, path), t
        text, verdict = rule(host, path)
        assert out[i].rule == text and out[i].verdict in ("allow", "block")
        assert verdict is None or out[i].verdict == verdict
    assert u.op9(df.limit(0)).count() == 0


def test_labelled_urls_are_not_pages():
    from pyarrow import parquet

    urls = [x for sf in ("sf0.01", "sf0.1") for x in parquet.read_table(f"/root/testdata/{sf}/pages.parquet").column("url").to_pylist()]
    hosts = {split(x)[0] for x in urls}
    assert not hosts & {split(x)[0] for x, _ in u.LABELLED}


def test_model_separates_new_urls(spark):
    good = ["http://www.theatre.example.com/fr/12", "https://m.river-boats.example.org/en/4", "https://blog.local-history.example.net/en/99", "https://www.opera-house.example/spielplan"]
    bad = ["http://m.cheap-pills.example.com/fr/12", "https://www.casino-win.example.org/en/4", "http://blog.spam-farm.example.net/fr/1", "https://adult-x.example.net/en/77", "https://free-bets.example.com/fr/3"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "page_id long, url string")
    got = {r.page_id: r.score >= 0.5 for r in u.judge(df).collect()}
    assert [got[i] for i in range(len(good + bad))] == [False] * len(good) + [True] * len(bad)
    with pytest.raises(ValueError):
        u.train(spark, [("http://x/", 1)] * (u.MAX_LABELLED + 1))


def test_regression_equals_plain_gradient_descent(spark):
    """The dual form against descent on the weights themselves, with the n-grams hashed by Spark one by one."""
    import numpy as np

    labelled = [*u.LABELLED[:6], *u.LABELLED[20:26], ("", 0), ("x://", 1)]
    pieces = []
    for url, _ in labelled:
        host, path = split(url)
        own = []
        for mark, text in (("^", f"^{host}$"), ("/", f"/{path}$")):
            own += [(mark, text[i : i + n]) for n in u.GRAMS for i in range(len(text) - n + 1)]
        pieces.append(own)
    names = sorted({p for own in pieces for p in own})
    rows = spark.createDataFrame(names, "mark string, gram string").selectExpr("mark", "gram", f"cast(pmod(xxhash64(mark, gram), {u.BUCKETS}) as int) as b").collect()
    bucket = {(r.mark, r.gram): r.b for r in rows}
    x = np.zeros((len(labelled), u.BUCKETS))
    for i, own in enumerate(pieces):
        held = sorted({bucket[p] for p in own})
        x[i, held] = 1 / np.sqrt(len(held)) if held else 0
    y = np.array([float(v) for _, v in labelled])
    w, b = np.zeros(u.BUCKETS), 0.0
    for _ in range(u.STEPS):
        err = y - 1 / (1 + np.exp(-(x @ w + b)))
        w, b = w * (1 - u.RATE * u.DECAY) + u.RATE * (x.T @ err), b * (1 - u.RATE * u.DECAY) + u.RATE * err.sum()
    model = u.train(spark, labelled)
    assert np.allclose(model, [b, *w], atol=1e-9)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(labelled)], "page_id long, url string")
    scores = {r.page_id: r.score for r in u.judge(df, model).collect()}
    assert np.allclose([scores[i] for i in range(len(labelled))], 1 / (1 + np.exp(-(x @ w + b))), atol=1e-9)


def test_rules_of_equal_length_and_long_urls(spark):
    from pyspark.sql import functions as F

    host, path = F.lit("a.b.com"), F.lit("/xy")
    text, says = u.rule_of(host, path, [("com/x", "block"), ("com/y", "allow"), ("b.com/", "allow")])
    assert tuple(spark.range(1).select(text, says).first()) == ("b.com/", "allow")
    df = spark.createDataFrame([(1, "http://h.example/" + "a" * 300_000, "x"), (1, "http://h.example/" + "a" * 300_000, "x"), (None, None, "y")], "page_id long, url string, verdict string")
    out = u.op9(df).collect()
    assert len(out) == 3 and sorted(len(r.path) for r in out) == [0, 300_001, 300_001]


def test_plans_have_no_python(spark):
    plan = q.op10(spark.range(3).selectExpr("id as doc_id", "'a b' as text"))._jdf.queryExecution().executedPlan().toString()
    plan += u.op9(spark.range(3).selectExpr("id as page_id", "'http://a/b' as url"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
