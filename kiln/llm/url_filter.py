"""URL filters: logistic regression on hashed character n-grams (operator 3).

Host and path n-grams are hashed into one sparse vector by Spark ML and a
logistic regression is fitted on a small labelled URL table. A url's verdict is
that of the longest fitting rule, else the model's. Scoring is a projection of
the page table's url column: no shuffle, no Python on the executors.

Defined cases: a null url, or one without ``://``, has an empty host and path,
fits no rule and is judged by the model on no features; a null id is kept;
repeated rows are judged one by one; an empty table gives an empty result;
other columns are neither read nor used.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.llm.common import read

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

#: Lengths of the character n-grams, and the size of the hashed vector.
NGRAMS = (3, 4, 5)
BUCKETS = 1 << 15
#: The model reads at most this many labelled urls (documented bound of the training sample).
MAX_LABELLED = 10_000

# A small labelled table: advertising, gambling, pharmacy and link-farm names
# against ordinary sites, written with different words, prefixes and paths.
_BAD = ("casino", "casino-bonus", "online-casino", "mega-casino", "casino-royale", "poker-win", "win-jackpot", "free-slots",
        "bets-today", "sport-bets", "bets-online", "pills-shop", "pills-online", "cheap-viagra", "cheap-meds", "pharma-cheap",
        "spam-site", "spam-links", "link-farm", "content-farm", "ads-server", "ads-network", "track-clicks", "clicks-ads",
        "ad-tracker", "popup-ads", "free-prizes", "win-prizes", "quick-loans", "cheap-loans", "adult-cams", "free-cams")
_GOOD = ("library", "university", "museum", "newsroom", "gazette", "archive", "weather", "history", "gardening", "recipes",
         "science", "physics", "cityhall", "railway", "orchestra", "theatre", "wetter", "nachrichten", "zeitung", "bibliothek",
         "musee", "journal", "cuisine", "voyage", "noticias", "biblioteca", "weekly", "school", "garden-club", "mountain",
         "harbour", "kitchen")
# The name as a host, below or above other labels, joined to a word, and as a part of the path.
_FORMS = ("{0}.example.com{1}", "www.{0}.example.org{1}", "{0}.example.net:8080{1}", "m.{0}.example.com{1}", "blog.{0}.example.org{1}",
          "the{0}.example.net{1}", "example.com/{0}{1}", "www.example.org/pages/{0}{1}")
_PATHS = ("/en/{2}", "/de/{2}.html", "/fr/{2}/", "/es/{2}?page=2", "/en/{2}#top", "", "/", "/a/b/{2}?q={2}&ref=x")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label, name): label 1 for a name to block."""
    rows = []
    for label, names in ((1.0, _BAD), (0.0, _GOOD)):
        for i, name in enumerate(names):
            for j, form in enumerate(_FORMS):
                path = _PATHS[(i + j) % len(_PATHS)].format(name, "", 17 * i + 31 * j)
                rows.append((f"http{'s' * (i % 2)}://" + form.format(name, path), label, name))
    return spark.createDataFrame(rows, "url string, label double, name string")


def host_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + 4)
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.contains(url, F.lit("://")), F.translate(host, upper, lower)).otherwise("")


def path_of(url: Column) -> Column:
    after = F.substr(url, F.length(F.substring_index(url, "://", 1)) + 4)
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _ngrams(text: Column, mark: str, lengths: tuple[int, ...]) -> Column:
    """Marked character n-grams of a text with a bound on each side."""
    letters = F.split(F.concat(F.lit("\u0002"), text, F.lit("\u0003")), "")

    def of(n: int) -> Column:
        last = F.size(letters) - (n - 1)
        starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(F.lit(mark), F.array_join(F.slice(letters, i, F.lit(n)), "")))

    return F.concat(*[of(n) for n in lengths])


def features(df: DataFrame, url_col: str = "url", lengths: tuple[int, ...] = NGRAMS) -> DataFrame:
    """The url's host, path and ``__grams``: the n-grams of the host, and those
    of the path with each number as one 0."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    return (df.withColumn("__host", host_of(url)).withColumn("__path", path_of(url))
            .withColumn("__grams", F.concat(_ngrams(F.col("__host"), "h", lengths),
                                            _ngrams(F.regexp_replace("__path", "[0-9]+", "0"), "p", lengths))))


#: A url is blocked at this probability: a name unlike any labelled one stays.
BLOCK_AT = 0.8


def train(labelled: DataFrame, lengths: tuple[int, ...] = NGRAMS, buckets: int = BUCKETS, reg: float = 0.001,
          max_iter: int = 40, block_at: float = BLOCK_AT) -> PipelineModel:
    """Fit on (url, label); at most ``MAX_LABELLED`` rows are read."""
    rows = features(labelled.limit(MAX_LABELLED), "url", lengths).coalesce(1)
    tf = HashingTF(inputCol="__grams", outputCol="__vector", numFeatures=buckets, binary=True)
    lr = LogisticRegression(featuresCol="__vector", labelCol="label", regParam=reg, maxIter=max_iter, threshold=block_at,
                            probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__label")
    return Pipeline(stages=[tf, lr]).fit(rows)


def _fitting(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits a host or its parent domains and the start of the path."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):  # the last that fits wins
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit(f".{domain}"))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def judge(pages: DataFrame, model: PipelineModel, rules: dict[str, str] = RULES, id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """One row per input row: id, host, path, rule, verdict and
    ``model_label``, the model's own answer (1 for block)."""
    rows = features(pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url")), "__url")
    rule = _fitting(F.col("__host"), F.col("__path"), rules)
    given = F.coalesce(*[F.when(F.col("__rule") == r, F.lit(v)) for r, v in rules.items()], F.lit(None).cast("string"))
    verdict = F.coalesce(given, F.when(F.col("__label") >= 0.5, "block").otherwise("allow"))
    return (model.transform(rows).withColumn("__rule", rule)
            .select(F.col("__id").alias(id_col), F.col("__host").alias("host"), F.col("__path").alias("path"),
                    F.col("__rule").alias("rule"), verdict.alias("verdict"), F.col("__label").alias("model_label")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"), train(labelled_urls(spark)))
