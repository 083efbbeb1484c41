"""WARC, shards, the Jaccard join and the pipeline against brute force."""

import base64
import collections
import hashlib
import random
import re

import duckdb
import pytest

import corpus_pipeline
from wirefold.llm import jaccard_join, sharding, warc
from wirefold.llm.common import Scratch, read_table

NESTED = "x WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\nWARC/1.0\r\n tail"
PAGES = [
    (1, "http://a/", NESTED), (2, None, None), (3, "u\r\nv", ""), (4, "x", "é" * 1000 + "WARC/1.0\r\n" * 3), (5, "x", NESTED), (None, "n", NESTED), (7, "y", "WARC/1.0\r\n"), (8, "z", "WARC/1.0\r\n\r\n\r\n"),
    (9, "t", "same"), (9, "t", "same"), (300, "big", "y" * 20_000 + "WARC/1.0\r\n" + "z" * 9_000), (301, "plain", "q" * 30_000), *((i, f"u{i}", f"w{i % 40} " * (i % 50)) for i in range(10, 200)),
]


def brute_records(rows, least):
    groups = collections.defaultdict(list)
    for i, _, h in rows:
        groups[h or ""].append(i)
    out = []
    for i, _, h in rows:
        raw, ids = (h or "").encode(), [x for x in groups[h or ""] if x is not None]
        top = max(ids) if ids else None
        again = len(groups[h or ""]) > 1 and len(raw) >= least and top is not None and i != top
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least, codec, block", [(0, "gzip", "128m"), (20, "none", "128m"), (0, "none", "3k")])
def test_archives_round_trip(spark, least, codec, block):
    df = spark.createDataFrame([(*r, "x") for r in PAGES], "page_id long, url string, html string, payload string")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        s = Scratch(spark, "test")
        warc.write(df.coalesce(2), s, s.path("a"), least, codec)
        got = [(r.page_id, r.payload_bytes, r.digest, r.type, r.refers_to) for r in warc.records(spark, s.path("a"), s).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(got, key=str) == brute_records(PAGES, least)


def test_reached_equals_a_walk():
    import numpy as np

    rng = random.Random(8)
    for _ in range(200):
        off = sorted(rng.sample(range(400), rng.randint(1, 60)))
        nxt = [rng.choice([*off, 999, o + 1]) if rng.random() < 0.9 else 999 for o in off]
        nxt = [n if n > o else 999 for o, n in zip(off, nxt)]
        at, want = off[0], set()
        while at in off:
            want.add(at)
            at = nxt[off.index(at)]
        hit = warc.reached(np.array(off), np.array(nxt), off[0])
        assert set(np.array(off)[hit].tolist()) == want


def test_query_archives_have_several_blocks_and_no_file_wide_pairs(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        df = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
        s = Scratch(spark, "test")
        warc.write(df, s, s.path("a"))
        assert warc.chunks(spark, s.path("a")).rdd.getNumPartitions() > 3
        out = warc.records(spark, s.path("a"), s)
        assert sorted(((r.page_id, r.payload_bytes, r.digest, r.type, r.refers_to) for r in out.collect()), key=str) == brute_records(PAGES, 0)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert spark.read.parquet(s.path("reached1")).count() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_empty_archive(spark):
    assert warc.op2(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_sessions_keep_their_settings(spark, monkeypatch):
    from wirefold.llm import common

    before = dict(spark.conf.getAll)
    df = common.bounded(spark.range(3))
    assert df.sparkSession is not spark and common.bounded(df) is df and df.count() == 3
    assert dict(spark.conf.getAll) == before and type(spark).getActiveSession() is spark and type(spark).builder.getOrCreate() is spark
    assert spark.sparkContext.parallelize([(1,)]).toDF(["a"]).sparkSession is spark
    assert {k: df.sparkSession.conf.get(k) for k in common.BOUNDS} == common.BOUNDS
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        Scratch(spark, "test")


def test_shards(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    store = sharding.Store(spark, Scratch(spark, "test").path("store"), docs.schema, target=200_000, smallest=8_000)
    assert store.read().count() == 0
    seen = {}
    for k in range(10):
        store.append(docs.where(f"doc_id % 10 = {k}").coalesce(2))
        version = store.compact()
        seen[version] = docs.where(f"doc_id % 10 <= {k}").count()
    for version, n in seen.items():  # older versions stay readable until a vacuum
        assert store.read(version).count() == n
    final = store.shards()
    assert len(final) < 20 and not store.due(final)
    store.vacuum()
    assert sorted(map(tuple, store.read().collect())) == sorted(map(tuple, docs.collect()))
    base = store.versions()[-1]
    assert store.commit(base, final) == base + 1
    with pytest.raises(sharding.Conflict):
        store.commit(base, final)


def test_vacuum_spares_writers_in_flight(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    root = Scratch(spark, "test").path("store")
    one, two = (sharding.Store(spark, root, docs.schema) for _ in range(2))
    one.append(docs.where("doc_id % 2 = 0"))
    name, new = one._write(docs.where("doc_id % 2 = 1"))
    gone = one._write(docs.limit(1))[1]
    two.vacuum()
    one._change(lambda shards: [*shards, *new])
    one._settled(name)
    two.vacuum()
    assert one.read().count() == docs.count()
    # a writer that died long ago
    two.vacuum(grace=-60)
    assert not one._fs.exists(one._path(gone[0].path)) and one.read().count() == docs.count() and not list(one._fs.listStatus(one._path(f"{root}/intents")))


def test_two_writers_lose_nothing(spark):
    from concurrent.futures import ThreadPoolExecutor

    docs = read_table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "lang").withColumn("_metadata", docs_marker())
    root = Scratch(spark, "test").path("store")
    parts = 12

    def work(k):
        store = sharding.Store(spark, root, docs.schema, smallest=1)
        for i in range(k, parts, 4):
            store.append(docs.where(f"doc_id % {parts} = {i}").coalesce(1))
            store.compact(vacuum=False)

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(work, range(4)))
    store = sharding.Store(spark, root, docs.schema)
    assert sorted(map(tuple, store.read().collect())) == sorted(map(tuple, docs.collect()))
    versions = store.versions()
    assert versions == list(range(1, len(versions) + 1)) and len(versions) >= parts
    assert sum(s.rows for s in store.shards()) == docs.count()
    # all full lists and all changes tell the same
    for v in versions:
        assert "all" in store._manifest(v) or v % sharding.FULL != 1


def docs_marker():
    from pyspark.sql import functions as F

    return F.lit("m")


def test_exclusive_commit(spark):
    from concurrent.futures import ThreadPoolExecutor

    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    root = Scratch(spark, "test").path("store")

    def commit(k):
        store = sharding.Store(spark, root, docs.schema)
        try:
            return store.commit(0, [sharding.Shard(f"{root}/data/{k}/x", k, k)])
        except sharding.Conflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        done = list(pool.map(commit, range(40)))
    assert sum(v is not None for v in done) == 1
    assert sharding.Store(spark, root, docs.schema).shards()[0].size == done.index(1)


def brute_groups(rows):
    """Rows of one id are versions of it: two ids link if a version of one links with a version of the other."""
    sets, out = [], []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    inverse, both, up = collections.defaultdict(list), collections.Counter(), {i: i for i, _ in sets}
    for k, (_, s) in enumerate(sets):
        for x in s:
            inverse[x].append(k)
    for held in inverse.values():
        for a in range(len(held)):
            for b in range(a):
                both[held[b], held[a]] += 1

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= 80 * (len(sets[a][1]) + len(sets[b][1]) - n):
            x, y = root(sets[a][0]), root(sets[b][0])
            up[max(x, y)] = min(x, y)
    return {(i, len(s), root(i)) for i, s in sets}


def family(seed, n=400):
    rng = random.Random(seed)
    base = [[f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([3, 8, 20, 60, 64, 80, 100, 260, 300]))] for _ in range(30)]
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base[:6] if i < n // 2 else base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4])):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 10**6)}"
        if rng.random() < 0.2:
            words += passage
        if rng.random() < 0.1:
            words = words[:-3]
        rows.append((i, " ".join(words)))
    return [*rows, (1000, None), (1001, ""), (1002, " \n"), (1003, "a b"), (1004, "A\tB")]


@pytest.mark.parametrize("settings", [{}, {"COMMON": 5, "MANY": 0.01, "FRUITFUL": 0, "FEW_LINKS": 0, "HELD_KEYS": 500, "HOT": 7}])
def test_groups_equal_brute_force(spark, monkeypatch, settings):
    for k, v in settings.items():
        monkeypatch.setattr(jaccard_join, k, v)
    rows = family(4)
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, comp string").repartition(5)
    assert {tuple(r) for r in jaccard_join.op4(df).collect()} == brute_groups(rows)


def test_documents_that_share_a_template_and_versions(spark, monkeypatch):
    """Keys with many documents that stay apart, some that link, and ids with several texts."""
    monkeypatch.setattr(jaccard_join, "HOT", 10)
    rng = random.Random(9)
    template = [f"t{i}" for i in range(80)]
    own = lambda n: [f"o{rng.randint(0, 10**9)}" for _ in range(n)]
    rows = [(i, " ".join([*template, *own(rng.choice([12, 16, 20, 24]))])) for i in range(120)]
    for i in range(120, 150):  # links across: another's text with one word changed
        words = rng.choice(rows[:120])[1].split()
        words[rng.randrange(80, len(words))] = "changed"
        rows.append((i, " ".join(words)))
    for i in range(150, 170):  # two versions: one of an earlier document, one of its own or like another's
        a, b = rng.choice(rows[:120])[1], rng.choice(rows[:120])[1].split()
        rows += [(i, a), (i, " ".join([*b[:-1], "last"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {tuple(r) for r in jaccard_join.op4(df).collect()} == brute_groups(rows)


def test_groups_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (5, "q r s t u v"), (5, "a b c d e f")], "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard_join.op4(df).collect()), key=str)
    assert got == sorted([(None, 2, None), (2, 2, 1), (1, 2, 1), (1, 2, 1), (5, 2, 1), (5, 2, 1)], key=str)
    assert jaccard_join.op4(df.limit(0)).count() == 0


def test_sketch_distance_is_a_lower_bound():
    rng = random.Random(2)
    import numpy as np

    for _ in range(200):
        one = np.array(sorted({rng.getrandbits(64) for _ in range(rng.randint(1, 200))}), np.uint64)
        two = np.unique(np.concatenate([one[rng.randint(0, 5) :], np.array([rng.getrandbits(64) for _ in range(rng.randint(0, 60))], np.uint64)]))
        apart = len(np.setxor1d(one, two))
        assert jaccard_join.hamming(jaccard_join.parity_bits(one), jaccard_join.parity_bits(two)) <= apart


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = read_table(spark, sf, "documents")
    scratch, frames = Scratch(spark, "test"), [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(scratch.keep(stage(spark, frames[-1], sf), name))
    ids = [{r.doc_id for r in f.select("doc_id").collect()} for f in frames]
    assert all(a >= b for a, b in zip(ids, ids[1:])) and ids[-1]
    assert all(f.columns == docs.columns for f in frames[:-1])
    # one of each group of near copies stays
    texts = [(r.doc_id, r.text) for r in frames[1].collect()]
    assert ids[2] == {c for _, _, c in brute_groups(texts)}
    # each other stage against plain Python on what the one before kept
    from test_native import brute
    from test_texts import brute_pairs

    from wirefold.llm import pieces, pii, quality_rules

    assert {r.doc_id for r in docs.select("doc_id", "text").collect() if brute(r.text)[-1]}.isdisjoint(ids[1])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert ids[1] == {r[0] for r in con.execute(f"SELECT doc_id FROM ({quality_rules.OP10_SQL}) WHERE kept").fetchall()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {d for d, _ in brute_pairs([(r.doc_id, r.text) for r in frames[2].collect()], items)}
    assert leaks and ids[3] == ids[2] - leaks
    before = {r.doc_id: r.text for r in frames[3].collect()}
    after = {r.doc_id: (r.text, r.n_chars) for r in frames[4].collect()}
    for i, t in before.items():
        hidden = [False] * len(t)
        spans = pii.find(t, pii.trained())[1]
        for a, b, _ in spans:
            hidden[a:b] = [True] * (b - a)
        kept = "".join(c for c, h in zip(t, hidden) if not h)
        text, n = after[i]
        assert n == len(text) and (text == t) == (not spans)
        assert "".join(x for x in re.split("<(?:EMAIL|IP|CARD|PHONE|SECRET)>", text)) == kept
    library = pieces.vocabulary(pieces.default_path()).library
    assert all(r.ids == library.encode(after[r.doc_id][0]) and r.n_tokens == len(r.ids) for r in frames[-1].collect())
    assert frames[-1].where("not decodes").count() == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == ids[-1]


def test_pipeline_of_odd_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, comp string, kept string"
    good = "The quick brown fox went over one lazy dog and then came home to eat, sleep and write to a@b.co about it"
    rows = [(1, None, None, None, None, "x", None), (None, good + " today", "en", "s", 1, "x", None), (2, good, "en", "s", 1, "x", None), (2, good, "en", "s", 1, "x", None), (3, good, None, None, None, None, "k"), (4, "", "", "", 0, "", "")]
    spark.createDataFrame([(0, "one two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    assert sorted((str(r.doc_id), r.decodes) for r in out) == [("2", True), ("2", True), ("None", True)]
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/b/benchmark.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


def test_shards_of_odd_rows(spark):
    df = spark.createDataFrame([(None, None, "l", "s", 1, "e"), (1, "", None, None, None, None), (1, "", None, None, None, None), (2, "é" * 50_000, "l", "s", 2, "e")], "doc_id long, text string, lang string, source string, n_chars long, size string")
    got = sorted((str(r.doc_id), r.n_bytes, r.lang) for r in sharding.op6(df).collect())
    assert got == sorted([("None", 0, "l"), ("1", 0, None), ("1", 0, None), ("2", 100_000, "l")], key=str)
    assert sharding.op6(df.limit(0)).count() == 0
