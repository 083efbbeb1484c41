"""URL filter: host rules, and logistic regression on hashed character n-grams.

DataFrame functions only.  Training is full-batch gradient descent in the dual
form: with the labelled urls' n-gram counts X, the model is w = X'a, so each
step needs only the Gram matrix X X' of the labelled table.  That table is a
parameter of at most ``MAX_LABELLED`` rows; its Gram matrix is an equi-join on
the hashed n-grams, and the descent is one ``aggregate`` expression over it.
The weights (at most ``BUCKETS`` doubles) return to the driver once and enter
the scoring projection as a constant array: judging urls is a narrow map, with
no shuffle or join, whatever the number of pages.

Edge cases: a null url, or one without ``://``, has an empty host and path, no
rule, and is judged by the model; of rules that fit the longest wins (of equally
long ones the one listed last; none of RULES tie); a score of exactly 0.5
blocks; urls of any length are judged whole; repeated rows are each judged; an
empty table gives an empty result; further columns are ignored, whatever their
names.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1 << 12
GRAMS = (3, 4)
STEPS = 200
RATE = 0.3
DECAY = 1e-3
MAX_LABELLED = 256

#: The rules, host suffix then path prefix.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))

#: A small table of labelled urls (1: block), written by hand; no page of the tables is among them.
LABELLED = (
    ("https://www.lucky-casino-slots.example/play?ref=9", 1),
    ("http://grand-casino-bonus.example/en/spin", 1),
    ("https://m.online-casino-jackpot.example/slots/77", 1),
    ("https://poker-and-bets.example/odds/live", 1),
    ("http://www.sports-bets-free.example/tips/3", 1),
    ("https://free-bets-today.example/offer", 1),
    ("https://buy-pills-cheap.example/order/viagra", 1),
    ("http://cheap-pharmacy-pills.example/no-prescription", 1),
    ("https://shop.discount-pills-online.example/cart/5", 1),
    ("https://www.diet-pills-cheap.example/fr/12", 1),
    ("http://adult-videos-xxx.example/watch/1", 1),
    ("https://cam.adult-chat-live.example/room/8", 1),
    ("https://www.hot-adult-dating.example/es/join", 1),
    ("https://ads-server.example/click?id=4", 1),
    ("http://pixel.ads-tracking.example/t.gif", 1),
    ("https://banner-ads-track.example/view/22", 1),
    ("https://spam-links-farm.example/page/901", 1),
    ("http://content-farm-spam.example/seo/keywords", 1),
    ("https://link-spam-network.example/de/6", 1),
    ("https://www.win-prizes-now.example/claim", 1),
    ("https://www.city-library.example/catalogue/81", 0),
    ("https://news.morning-post.example/en/2024/article.html", 0),
    ("https://docs.toolkit.example/guide/start", 0),
    ("http://blog.gardening-notes.example/roses", 0),
    ("https://weather.north-coast.example/de/berlin", 0),
    ("https://www.university-press.example/courses/4", 0),
    ("http://museum.old-town.example/fr/visites", 0),
    ("https://recipes.kitchen-table.example/es/pan", 0),
    ("https://m.train-times.example/en/25", 0),
    ("https://www.history-society.example/fr/148.html", 0),
    ("http://forum.bicycle-repair.example/thread/960", 0),
    ("https://en.encyclopedia.example/wiki/Photosynthesis", 0),
    ("https://www.health-office.example/advice/flu", 0),
    ("https://school.river-valley.example/timetable", 0),
    ("http://www.theatre-tickets.example/en/7", 0),
    ("https://maps.hiking-trails.example/route/33", 0),
    ("https://blog.astronomy-club.example/es/853/", 0),
    ("https://www.town-council.example/minutes/474.html", 0),
    ("https://thesis.physics-institute.example/de/853", 0),
    ("https://www.reading-room.example/authors/t", 0),
)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    url = F.coalesce(url, F.lit(""))
    found = url.contains("://")
    host = F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(found, F.translate(host, upper, lower)).otherwise(""), F.when(found, path).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    text = verdict = F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):
        suffix, _, prefix = rule.partition("/")
        fits = ((host == suffix) | host.endswith(f".{suffix}")) & path.startswith(f"/{prefix}")
        text, verdict = F.when(fits, F.lit(rule)).otherwise(text), F.when(fits, F.lit(says)).otherwise(verdict)
    return text, verdict


def grams(host: Column, path: Column) -> Column:
    """Bucket numbers of the host's and path's n-grams, each part with its own marks."""
    none = F.expr("cast(array() as array<int>)")

    def of(mark: str, text: Column, n: int) -> Column:
        # characters once, so that the cost grows with the length alone
        chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
        hashed = lambda all_: F.transform(
            F.slice(all_, F.lit(1), F.greatest(F.size(all_) - n + 1, F.lit(0))),
            lambda c, i: F.pmod(F.xxhash64(F.lit(mark), F.concat(c, *[F.get(all_, i + k) for k in range(1, n)])), F.lit(BUCKETS)).cast("int"),
        )
        # the array is bound to a name by a transform over one element
        return F.when(F.length(text) >= n, F.flatten(F.transform(F.array(chars), hashed))).otherwise(none)

    marked = [("^", F.concat(F.lit("^"), host, F.lit("$"))), ("/", F.concat(F.lit("/"), path, F.lit("$")))]
    return F.flatten(F.array(*[of(mark, text, n) for mark, text in marked for n in GRAMS]))


def train(spark: SparkSession, labelled=LABELLED) -> list[float]:
    """Bias and bucket weights, fitted on the labelled table (at most MAX_LABELLED rows)."""
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"the labelled table has {len(labelled)} rows; {MAX_LABELLED} is the most")
    table = json.dumps([{"i": i, "url": u, "y": float(y)} for i, (u, y) in enumerate(labelled)])
    rows = spark.range(1).select(F.inline(F.from_json(F.lit(table), "array<struct<i int, url string, y double>>")))
    host, path = parts(F.col("url"))
    found = rows.select("i", "y", host.alias("host"), path.alias("path")).select("i", "y", F.explode(F.array_distinct(grams(F.col("host"), F.col("path")))).alias("g"))
    # each text is scaled to unit length: 1 / sqrt(distinct n-grams); the bias is one more feature of value 1
    size = found.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    x = found.join(size, "i").select("i", "g", (1 / F.sqrt("n")).alias("v"))
    gram = x.alias("a").join(x.alias("b"), F.col("a.g") == F.col("b.g")).groupBy(F.col("a.i").alias("i"), F.col("b.i").alias("j")).agg(F.sum(F.col("a.v") * F.col("b.v")).alias("k"))
    line = gram.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "k"))).alias("ks"))
    # one row that holds the whole problem: per labelled url its label and its row of the Gram matrix plus bias
    n = len(labelled)
    # (a url without n-grams has the bias alone)
    line = rows.select("i", "y").join(line, "i", "left").select(
        "i", "y", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.coalesce(F.try_element_at("ks", j), F.lit(0.0)) + 1.0).alias("k")
    )
    problem = line.agg(F.sort_array(F.collect_list(F.struct("i", "y", "k"))).alias("p"))
    margin = lambda r, a: F.aggregate(F.zip_with(r["k"], a, lambda k, w: k * w), F.lit(0.0), lambda s, t: s + t)
    alpha = F.aggregate(
        F.sequence(F.lit(1), F.lit(STEPS)),
        F.transform("p", lambda r: F.lit(0.0)),
        lambda a, _: F.transform("p", lambda r, i: F.get(a, i) * (1 - RATE * DECAY) + RATE * (r["y"] - 1 / (1 + F.exp(-margin(r, a))))),
    )
    fitted = problem.select(F.posexplode(alpha).alias("i", "a"))
    weights = x.join(fitted, "i").groupBy("g").agg(F.sum(F.col("v") * F.col("a")).alias("w"))
    bias = fitted.agg(F.sum("a")).first()[0]
    out = [0.0] * BUCKETS
    for g, w in weights.collect():  # at most BUCKETS rows
        out[g] = w
    return [bias, *out]


def score(host: Column, path: Column, model: list[float]) -> Column:
    """Probability that a url is to be blocked."""
    weights = F.from_json(F.lit(json.dumps(model[1:])), "array<double>")
    own = F.array_distinct(grams(host, path))
    total = F.aggregate(
        own,
        F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")),
        lambda acc, g: F.struct((acc["s"] + F.get(weights, g)).alias("s"), (acc["n"] + 1).alias("n")),
        lambda acc: acc["s"] / F.sqrt(F.greatest(acc["n"], F.lit(1)).cast("double")),
    )
    return 1 / (1 + F.exp(-(F.lit(model[0]) + total)))


def judge(pages: DataFrame, model: list[float] | None = None, rules=RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """``key``, host, path, rule, verdict and the model's score of every url."""
    model = model or train(pages.sparkSession)
    host, path = parts(F.col(url))
    df = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    df = df.select(key, "host", "path", rule.alias("rule"), says.alias("_says"), score(F.col("host"), F.col("path"), model).alias("score"))
    method = F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return df.select(key, "host", "path", "rule", F.coalesce("_says", method).alias("verdict"), "score")


def op9(pages: DataFrame) -> DataFrame:
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")
