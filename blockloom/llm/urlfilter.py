"""URL filters: longest-match rules, then logistic regression on hashed character n-grams.

The model is fitted on the driver, in plain Python, from a small labelled table of URLs. Its
weights, rounded to integers, become one array literal, so that judging a URL is one expression of
DataFrame functions and gives the same sum in any order.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Host and path of each rule, and what it says.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

# The labelled table: 1 is to be blocked. Shops, games, adverts and log-in pages against prose.
LABELLED = [
    ("casino.example", "/win/bonus", 1),
    ("www.bestcasino.example", "/slots/free-spins", 1),
    ("poker.example", "/play/now", 1),
    ("cheap-pills.example", "/buy/online", 1),
    ("ads.example", "/banner/click", 1),
    ("track.example", "/pixel.gif", 1),
    ("adserver.example", "/click/redirect", 1),
    ("shop.example", "/cart/checkout", 1),
    ("deals.example", "/coupon/discount", 1),
    ("login.example", "/account/signin", 1),
    ("m.example", "/login", 1),
    ("xxx.example", "/video/adult", 1),
    ("adult.example", "/cams/live", 1),
    ("torrent.example", "/download/crack", 1),
    ("warez.example", "/serial/keygen", 1),
    ("bet.example", "/odds/live-bet", 1),
    ("loans.example", "/apply/payday", 1),
    ("spam.example", "/seo/backlinks", 1),
    ("blog.example", "/tag/casino-bonus", 1),
    ("forum.example", "/register", 1),
    ("en.wiki.example", "/wiki/history", 0),
    ("de.wiki.example", "/wiki/geschichte", 0),
    ("www.university.example", "/research/papers", 0),
    ("docs.example", "/guide/install.html", 0),
    ("news.example", "/world/report.html", 0),
    ("www.library.example", "/books/catalog", 0),
    ("blog.science.example", "/en/article", 0),
    ("museum.example", "/de/ausstellung", 0),
    ("www.journal.example", "/volume/issue", 0),
    ("archive.example", "/details/text", 0),
    ("www.example", "/en/about.html", 0),
    ("weather.example", "/forecast/today", 0),
    ("health.example", "/topics/heart", 0),
    ("cooking.example", "/recipes/bread", 0),
    ("gov.example", "/law/statute", 0),
    ("school.example", "/lessons/algebra", 0),
    ("travel.example", "/fr/guide", 0),
    ("music.example", "/es/historia", 0),
    ("garden.example", "/plants/roses.html", 0),
    ("blog.travel.example", "/en/story", 0),
]

#: Length of n-grams, slots that they are hashed to, and the factor that makes weights integers.
GRAM, SLOTS, SCALE = 3, 2048, 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def grams(host: str, path: str) -> list[int]:
    """Slots of the n-grams of host and path: a polynomial of code points, modulo SLOTS."""
    s = f"^{host}{path}$"
    return [(ord(s[i]) * 961 + ord(s[i + 1]) * 31 + ord(s[i + 2])) % SLOTS for i in range(len(s) - GRAM + 1)]


@lru_cache
def fitted(rounds: int = 300, rate: float = 0.5, shrink: float = 1e-3) -> tuple[int, tuple[int, ...]]:
    """(bias, weights), as integers, by gradient descent on the mean of the n-grams' slots."""
    rows = [(grams(h, p), y) for h, p, y in LABELLED]
    weights, bias = [0.0] * SLOTS, 0.0
    for _ in range(rounds):
        for slots, y in rows:
            scale = 1 / math.sqrt(len(slots))
            z = bias + scale * sum(weights[s] for s in slots)
            step = rate * (y - 1 / (1 + math.exp(-z)))
            bias += 0.1 * step
            for s in slots:
                weights[s] += step * scale - rate * shrink * weights[s]
    return round(bias * SCALE), tuple(round(w * SCALE) for w in weights)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty where there is no `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def filter_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Judge every URL: id, host, path, rule (or null), verdict (allow or block) and score.

    Of the rules that fit, the longest as text (host and path) decides; without one, the score does,
    the model's log-odds of being blocked times SCALE and the root of the number of n-grams: above 0 is
    blocked. A null URL, or one without `://`, has an empty host and path and is judged by the
    model. Ids may be null or repeat; other columns are not looked at. One projection, no shuffle.
    """
    host, path = url_parts(F.col(url_col))
    d = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    bias, weights = fitted()
    table = F.from_json(F.lit("[" + ",".join(map(str, weights)) + "]"), "array<bigint>")
    d = d.select("*", rule.alias("rule"), verdict.alias("said"), F.concat(F.lit("^"), F.col("host"), F.col("path"), F.lit("$")).alias("s"), table.alias("w"))
    code = lambda i: F.ascii(F.substring(F.col("s"), i, 1)).cast("long")
    places = F.when(F.length("s") >= GRAM, F.sequence(F.lit(1), F.length("s") - (GRAM - 1))).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(places, F.lit(0).cast("long"), lambda a, i: a + F.element_at("w", ((code(i) * 961 + code(i + 1) * 31 + code(i + 2)) % SLOTS + 1).cast("int")))
    d = d.withColumn("total", total).withColumn("n", F.greatest(F.length("s") - (GRAM - 1), F.lit(1)))
    score = F.col("total") + F.lit(float(bias)) * F.sqrt(F.col("n").cast("double"))
    d = d.withColumn("score", score)
    return d.select(id_col, "host", "path", "rule", F.coalesce(F.col("said"), F.when(F.col("score") > 0, F.lit("block")).otherwise("allow")).alias("verdict"), "score")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("score")


def op8_sql() -> str:
    bias, weights = fitted()
    return rf"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
w AS (SELECT {list(weights)}::BIGINT[] AS w),
z AS (SELECT page_id, host, path,
        CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
             WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
             WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
             WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
             WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule,
        '^' || host || path || '$' AS s FROM p),
g AS (SELECT z.*, length(s) - 2 AS n, list_sum(list_transform(range(1, length(s) - 1), lambda i: w[(unicode(s[i]) * 961 + unicode(s[i + 1]) * 31 + unicode(s[i + 2])) % {SLOTS} + 1]))::DOUBLE AS total FROM z, w)
SELECT page_id, host, path, rule,
       CASE rule WHEN 'com/' THEN 'allow' WHEN 'www.example.com/en/' THEN 'allow' WHEN 'example.com/en/' THEN 'block' WHEN 'net/es/' THEN 'block' WHEN 'net/fr/' THEN 'block'
            ELSE CASE WHEN coalesce(total, 0) + {float(bias)} * sqrt(greatest(n, 1)::DOUBLE) > 0 THEN 'block' ELSE 'allow' END END AS verdict
FROM g
"""
