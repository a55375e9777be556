"""Catalog: sources, sinks, chunked ingestion and streaming (2.1, 2.10).

Each query writes data Spark derives from the driver tables into the shared
checkpoint folder in the reference's file shape (header CSV, pipe-delimited
gzip logs, JSON listings, file trees) and reads it back through the
operator, so the read path is exercised on the whole table."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.operators import metrics as M
from kiln.operators import models as ML
from kiln.operators.structured import json_long
from kiln.plans import conn_prep as CP
from kiln.plans import standins as S
from kiln.plans._q import tables
from kiln.plans.oracle import CONN_CTE
from kiln.registry import query
from kiln.session import scratch_path
from kiln.sources import files as FL
from kiln.sources import sinks as SK
from kiln.streaming import chunks as CH


@query("read_delimited", section="2.1", sql="SELECT * FROM customer")
def q_read_delimited(spark, sf_dir):
    c = tables(spark, sf_dir).customer
    path = SK.write_prepared_csv(c, scratch_path(spark, "customer-csv"))
    return FL.read_delimited(spark, path, c.schema)


CONN_COLS = ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "service", "duration",
             "orig_bytes", "resp_bytes", "label"]


@query("read_conn_log", section="2.1", sql=f"""
WITH {CONN_CTE} SELECT {', '.join(f'"{c}"' for c in CONN_COLS)} FROM conn
""")
def q_read_conn_log(spark, sf_dir):
    conn = S.conn_log(tables(spark, sf_dir))
    path = scratch_path(spark, "conn-log")
    # gzip files cannot be split: as many files as the rows' size asks for
    (conn.hint("rebalance").write.option("header", True).option("sep", "|").option("nullValue", "-")
     .option("compression", "gzip").csv(path))
    return FL.read_conn_log(spark, f"{path}/*.csv.gz", conn.schema, CONN_COLS)


@query("concat_files", section="2.1", sql="SELECT * FROM events")
def q_concat_files(spark, sf_dir):
    e = tables(spark, sf_dir).events
    root = scratch_path(spark, "events-by-type")
    # one pass writes a folder for each event type, a null type included
    e.withColumn("kind", F.col("event_type")).write.partitionBy("kind").parquet(root)
    return FL.concat_files(spark, [f"{root}/kind=*"], "parquet")


@query("concat_mixed_files", section="2.1", sql="""
SELECT event_id, event_type, CASE WHEN event_type = 'view' THEN NULL ELSE user_id END AS user_id,
       CAST(CASE WHEN event_type = 'view' THEN CAST(user_id AS VARCHAR) END AS VARCHAR) AS viewer, ts
FROM events
""")
def q_concat_mixed_files(spark, sf_dir):
    """Files whose columns differ: views name their user ``viewer``, as text,
    and number their rows in a narrower type where it holds them."""
    e = tables(spark, sf_dir).events.select("event_id", "event_type", "user_id", "ts")
    root = scratch_path(spark, "events-mixed")
    view = F.coalesce(F.col("event_type") == "view", F.lit(False))
    e.where(~view).write.parquet(f"{root}/others")
    e.where(view).select(F.col("event_id").cast("decimal(19,0)").alias("event_id"), "event_type", F.col("user_id").cast("string").alias("viewer"),
                         "ts").write.parquet(f"{root}/views")
    out = FL.concat_mixed_files(spark, [f"{root}/others", f"{root}/views"])
    return out.withColumn("event_id", F.col("event_id").cast("long"))


LISTING_SCHEMA = T.StructType([T.StructField("data", T.StructType([
    T.StructField("after", T.StringType()),
    T.StructField("children", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()),
                                                        T.StructField("data", T.StructType([
                                                            T.StructField("name", T.StringType()),
                                                            T.StructField("created_utc", T.LongType()),
                                                            T.StructField("subreddit", T.StringType()),
                                                            T.StructField("author", T.StringType()),
                                                            T.StructField("body", T.StringType())]))])))]))])


@query("read_json_listing", section="2.1", sql="""
SELECT 't1_' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS name, conv_id * 1000 + turn AS created_utc,
       'r/conv' || CAST(conv_id AS VARCHAR) AS subreddit, role AS author, text AS body
FROM conversations
""")
def q_read_json_listing(spark, sf_dir):
    c = tables(spark, sf_dir).conversations
    child = F.struct(F.lit("t1").alias("kind"), F.struct(
        F.concat(F.lit("t1_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("name"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("created_utc"),
        F.concat(F.lit("r/conv"), F.col("conv_id").cast("string")).alias("subreddit"),
        F.col("role").alias("author"), F.col("text").alias("body")).alias("data"))
    # listing pages of at most 100 children (conversation, block of 100 turns),
    # so no page grows with a long conversation
    page = F.floor(F.col("turn") / 100)
    pages = c.groupBy("conv_id", page.alias("page")).agg(F.collect_list(child).alias("children")).select(
        F.to_json(F.struct(F.struct(F.concat(F.lit("t3_"), F.col("conv_id").cast("string"), F.lit("_"),
                                             F.col("page").cast("string")).alias("after"),
                                    "children").alias("data"))).alias("value"))
    path = scratch_path(spark, "listing")
    pages.write.text(path)
    return FL.read_json_listing(spark, path, LISTING_SCHEMA, ["name", "created_utc", "subreddit", "author", "body"])


@query("read_file_inventory", section="2.1", sql="""
SELECT lang, sum(strlen(text) + 1) AS n_bytes FROM documents GROUP BY lang
""")
def q_read_file_inventory(spark, sf_dir):
    d = tables(spark, sf_dir).documents
    root = scratch_path(spark, "doc-tree")
    d.select("lang", "text").write.partitionBy("lang").text(root)
    inv = FL.read_file_inventory(spark, root, "*.txt")
    return (inv.withColumn("lang", F.regexp_extract("path", r"lang=([^/]+)/", 1))
            .groupBy("lang").agg(F.sum("size").alias("n_bytes")))


@query("write_prepared_csv", section="2.1", sql="SELECT * FROM orders")
def q_write_prepared_csv(spark, sf_dir):
    o = tables(spark, sf_dir).orders
    path = SK.derived_name(scratch_path(spark, "orders") + "/orders.csv", "prepped")
    SK.write_prepared_csv(o, path)
    return FL.read_delimited(spark, path, o.schema)


@query("write_training_csv_gz", section="2.1", sql="SELECT * FROM lineitem")
def q_write_training_csv_gz(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem
    path = scratch_path(spark, "training-gz")
    SK.write_training_csv_gz(li, path)
    return FL.read_delimited(spark, path, li.schema)


RUN_COLS = ["run", "l_returnflag", "n_rows", "total_quantity"]


@query("append_run_history", section="2.1", sql="""
SELECT CAST(row_number() OVER (ORDER BY l_returnflag) AS VARCHAR) AS run, l_returnflag, CAST(count(*) AS VARCHAR) AS n_rows,
       CAST(CAST(sum(l_quantity) AS BIGINT) AS VARCHAR) AS total_quantity
FROM lineitem GROUP BY l_returnflag
""")
def q_append_run_history(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem
    path = scratch_path(spark, "history")
    totals = li.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").cast("long").alias("total_quantity"))
    # one run per return flag, a null flag last; the numbers are given in Spark, over the few groups
    runs = totals.withColumn("run", F.row_number().over(Window.orderBy(F.asc_nulls_last("l_returnflag"))))
    SK.append_run_history(runs, path, RUN_COLS)
    return SK.read_run_history(spark, path, RUN_COLS)


def _lineitem_files(spark, sf_dir, cols=("*",)):
    li = tables(spark, sf_dir).lineitem.select(*cols)
    src = scratch_path(spark, "lineitem-files")
    # files of the size that the rows ask for; a chunk takes as many as fit its bytes
    li.hint("rebalance").write.parquet(src)
    return li, src


@query("ingest_in_chunks", section="2.1", sql="""
SELECT count(*) AS n_rows, sum(l_quantity) AS total_quantity, count(DISTINCT l_orderkey) AS n_orders FROM lineitem
""")
def q_ingest_in_chunks(spark, sf_dir):
    li, src = _lineitem_files(spark, sf_dir)
    sink = scratch_path(spark, "chunk-results")

    def per_chunk(batch, batch_id):
        return batch.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q")) \
                    .withColumn("chunk", F.lit(batch_id))

    res = CH.process_in_chunks(spark, src, li.schema, per_chunk, sink)
    # combining the per-chunk partial aggregates gives the whole-table answer
    return res.agg(F.sum("n").alias("n_rows"), F.sum("q").alias("total_quantity"),
                   F.countDistinct("l_orderkey").alias("n_orders"))


@query("train_per_chunk", section="2.9")
def q_train_per_chunk(spark, sf_dir):
    # a chunk's rows are read whole, so its files hold what the models use
    feats, key = ["l_quantity", "l_discount", "l_tax", "age"], ["l_orderkey", "l_linenumber"]
    li, src = _lineitem_files(spark, sf_dir, [*key, *feats[:3], "l_returnflag", "l_shipdate"])
    sink = scratch_path(spark, "chunk-models")

    def scores(scored):
        m = M.classification_metrics(scored, "label", "prediction")
        return {k: m[k] for k in ("f1", "recall", "precision", "accuracy")}

    def per_chunk(batch, batch_id):
        """A grid search of its own on each chunk: is the line returned?"""
        d = batch.select(*key, *feats[:3], (F.col("l_returnflag") == "R").cast("double").alias("label"),
                         F.datediff(F.lit("1998-12-31").cast("date"), F.col("l_shipdate").cast("date")).cast("double").alias("age"))
        results = ML.cross_validate(d, LogisticRegression(labelCol="label", maxIter=10), {"regParam": [0.0, 0.1]}, scores,
                                    feats, key, folds=3)
        best = ML.best_of(results, "accuracy")
        rows = [(batch_id, best["n_rows"], best["params"], m, *best["test"][m], best["train"][m][0]) for m in best["test"]]
        return batch.sparkSession.createDataFrame(rows, "chunk long, n_rows long, best_params string, metric string, mean_metric double, "
                                                        "std_metric double, mean_train double")

    return CH.process_in_chunks(spark, src, li.schema, per_chunk, sink)


@query("stream_score", section="2.10")
def q_stream_score(spark, sf_dir):
    conn = S.conn_log(tables(spark, sf_dir))
    consts = CP.fit(conn)
    train = CP.apply(conn, consts)
    feats = [c for c in train.columns if c != CP.LABEL]
    model = ML.fit_gbt_classifier(train, [f"`{f}`" if "." in f else f for f in feats], CP.LABEL, max_iter=20)
    src = scratch_path(spark, "conn-arrivals")
    conn.hint("rebalance").write.parquet(src)
    sink = scratch_path(spark, "conn-scores")
    out = CH.score_stream(spark, src, conn.schema, lambda s: CP.apply(s, consts), model, sink)
    return out.select(CP.LABEL, "prediction")


@query("stream_first_contact", section="2.10", sql=f"""
WITH {CONN_CTE}
SELECT "id.orig_h", "id.resp_p", ts, uid, orig_bytes FROM (
  SELECT *, row_number() OVER (PARTITION BY "id.orig_h", "id.resp_p" ORDER BY ts, uid) AS rn FROM conn) WHERE rn = 1
""")
def q_stream_first_contact(spark, sf_dir):
    """First contact of each pair on a stream of log files, one piece after another."""
    conn = S.conn_log(tables(spark, sf_dir)).select("`id.orig_h`", "`id.resp_p`", "ts", "uid", "orig_bytes")
    src = scratch_path(spark, "contact-arrivals")
    conn.hint("rebalance").write.parquet(src)
    return CH.first_contact_stream(spark, src, conn.schema, ["id.orig_h", "id.resp_p"], "ts", "uid", scratch_path(spark, "contacts"))


@query("json_long", section="2.6", sql="""
SELECT event_id, unnest(json_keys(props)) AS name, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events
""")
def q_json_long(spark, sf_dir):
    return json_long(tables(spark, sf_dir).events, "event_id", "props")
