"""TF-IDF over whole documents as joins and aggregations.

weight = raw count x (ln((1 + n) / (1 + df)) + 1), L2-normalised per
document; the vocabulary and document frequencies come from the training
documents only, unseen terms are dropped. The texts are shuffled once by
document; only a vocabulary too large to broadcast has the (document, term)
rows shuffled, and AQE's skew-join handling then splits frequent terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.sources.sinks import snapshot

# Fixed value: a token is a maximal run of two or more letters, digits or
# underscores (the word-character rule, written with explicit classes).
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def tfidf(docs: DataFrame, is_train: Column, id_col: str, text_col: str) -> DataFrame:
    """Fit on the documents of ``docs`` where ``is_train`` holds and transform
    all of them: the (doc, term) counts carry the flag, so one exchange of the
    texts feeds both the document frequencies and the term weights."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flagged = docs.select(F.col(id_col).alias("doc"), is_train.alias("train"), F.col(text_col).alias("text"))
    n = flagged.where("train").select("doc").distinct().count()
    # the texts are dealt by document once, before they grow into terms: counts
    # and norms of a document then stay in its partition. The number of parts is
    # given, as a part's terms are many times its texts
    dealt = flagged.repartition(parts, "doc")
    terms = dealt.select("doc", "train", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN_PATTERN), 0)).alias("term"))
    tf = terms.groupBy("doc", "train", "term").agg(F.count(F.lit(1)).alias("tf"))
    df_t = tf.where("train").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # written, so that its size is known: a vocabulary below the broadcast limit
    # goes to the documents; beyond it both sides are shuffled by term
    idf = snapshot(df_t.select("term", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf")), "idf")
    w = tf.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    # the norm is a window over one document's terms (bounded by its length)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))
    return w.select(F.col("doc").alias(id_col), "term", (F.col("w") / norm).alias("weight"))
