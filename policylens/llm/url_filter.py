"""Judgement of urls by rules and, where none fits, by a logistic regression on hashed character n-grams.

Only built-in functions and the JVM's ML library run over the urls. The host is what stands after the first `://` up to `/`,
`?`, `#` or the end, with A-Z lower-cased; the path goes on to `?`, `#` or the end. A null url, or one without `://`, has an
empty host and path and is judged by the model on no n-grams, so by its intercept.

A rule `host/path` fits its host and all subdomains if the url's path starts with the rule's path, slash included; the
longest rule wins, and of two of one length the first by name. Rules are a short list, kept as literals of the plan.
"""

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

GRAM_LENGTHS, FEATURES, PENALTY, ITERATIONS = (3, 4, 5), 1 << 16, 0.02, 60

# The rules of the contract.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

# The labelled urls the model is trained from, 1 for unwanted.
LABELLED = [
    ("http://ads-track.example.com/en/1", 1), ("https://www.ads-track.example.com/fr/77.html", 1),
    ("https://m.ads-track.example.org/es/12/", 1), ("http://ads.example.org/click?id=4", 1),
    ("https://adserver.example.com/banner/300x250", 1), ("http://track.example.com/pixel.gif", 1),
    ("https://tracker.example.org/en/beacon", 1), ("http://popup-ads.example.com/de/9", 1),
    ("http://spam-farm.example.com/en/286", 1), ("https://www.spam-farm.example.com/de/3.html", 1),
    ("https://m.spam-farm.example.org/fr/41/", 1), ("http://spam.example.org/offer", 1),
    ("https://link-farm.example.com/es/5", 1), ("http://content-farm.example.com/en/8", 1),
    ("https://casino-bonus.example.com/play/now", 1), ("http://cheap-pills.example.com/buy/online", 1),
    ("http://free-money.example.com/win/prize", 1), ("https://phish-login.example.com/verify/account", 1),
    ("https://online-bets.example.org/en/odds", 1), ("https://adult-video.example.net/en/12", 1),
    ("https://malware.example.org/download/setup.exe", 1), ("http://clickbait.example.com/you-wont-believe", 1),
    ("https://thered.example.org/en/4373", 0), ("http://tiontion.example.com/fr/7323/", 0),
    ("https://blog.ththsh.example.com/de/214.html", 0), ("http://m.therble.example.org/es/1732", 0),
    ("https://www.ththin.example.com/en/134.html", 0), ("https://blog.tionsh.example.com/en/1237/", 0),
    ("http://ththan.example.com/es/1181", 0), ("https://ththwh.example.org/es/6344.html", 0),
    ("http://therst.example.com/fr/1372", 0), ("https://m.theron.example.org/fr/5644/", 0),
    ("https://www.tionble.example.org/en/1793", 0), ("http://blog.ththhe.example.com/de/3990/", 0),
    ("https://news.example.org/en/2024/report", 0), ("https://library.example.org/catalog/books", 0),
    ("https://docs.example.com/guide/install", 0), ("https://en.wiki.example.org/wiki/history", 0),
    ("https://university.example.org/research/papers", 0), ("https://museum.example.com/es/collection", 0),
    ("http://weather.example.com/de/today", 0), ("https://recipes.example.com/fr/soup.html", 0),
]


def with_parts(pages, url_col="url"):
    """`pages` with `host` and `path`."""
    url = F.col(url_col)
    host = F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)
    empty = F.lit("")
    return pages.withColumns({"host": F.coalesce(host, empty), "path": F.coalesce(path, empty)})


def rule_columns(rules=RULES):
    """(rule, its verdict) for columns `host` and `path`; both null where no rule fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # The shortest is asked first and the longest last, around it: the outermost that fits decides.
    for rule, action in sorted(rules, key=lambda r: (-len(r[0]), r[0]), reverse=True):
        rule_host, slash, rest = rule.partition("/")
        fits = ((F.col("host") == rule_host) | F.col("host").endswith("." + rule_host)) & F.col("path").startswith(slash + rest)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, action).otherwise(verdict)
    return name, verdict


def _chars(column):
    """Characters of a column with its ends marked, split once so that long urls stay cheap; none for an empty one."""
    marked = F.concat(F.lit("^"), F.col(column), F.lit("$"))
    return F.when(F.col(column) == "", F.array().cast("array<string>")).otherwise(F.split(marked, ""))


def _grams(chars, mark, n):
    """The n-grams of an array of characters."""
    size = F.size(chars)
    places = F.when(size >= n, F.sequence(F.lit(0), size - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.concat(F.lit(f"{mark}{n}:"), *[F.get(chars, i + k) for k in range(n)]))


def with_features(parts):
    """Adds `features`: which hashed n-grams of host and path there are."""
    made = parts.withColumns({"_host": _chars("host"), "_path": _chars("path")})
    made = made.withColumn("_grams", F.concat(*[
        _grams(F.col(f"_{column}"), column[0], n) for column in ("host", "path") for n in GRAM_LENGTHS]))
    hashing = HashingTF(numFeatures=FEATURES, binary=True, inputCol="_grams", outputCol="features")
    return hashing.transform(made).drop("_host", "_path", "_grams")


def fit_url_model(labelled, url_col="url", label_col="label"):
    """Logistic regression from a small labelled table; label 1 is unwanted."""
    rows = with_features(with_parts(labelled.select(F.col(url_col).alias("url"), F.col(label_col).cast("double").alias("label"))))
    return LogisticRegression(maxIter=ITERATIONS, regParam=PENALTY).fit(rows.select("features", "label"))


def judge_urls(pages, model, id_col="page_id", url_col="url", rules=RULES):
    """(id, host, path, rule, verdict, blocked_by_model) for every row."""
    rows = with_features(with_parts(pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))))
    name, verdict = rule_columns(rules)
    scored = model.transform(rows)
    return scored.select(
        F.col("id").alias(id_col), "host", "path", name.alias("rule"),
        F.coalesce(verdict, F.when(F.col("prediction") > 0.5, "block").otherwise("allow")).alias("verdict"),
        (F.col("prediction") > 0.5).alias("blocked_by_model"))


def labelled_urls(spark):
    return spark.createDataFrame(LABELLED, "url string, label int").coalesce(1)


def op1_url_filter(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge_urls(pages, fit_url_model(labelled_urls(spark)))
