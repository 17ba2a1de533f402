"""Domain views over the supplied tables. Nothing is rewritten; each is a projection that stays lazy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Channels a recording has in the view; the last is the stimulus channel.
CHANNELS = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, ch, t, v: 20 vectors are a recording of 20 channels and 64 samples."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.expr("vec_id div 20").alias("rec"), (F.col("vec_id") % CHANNELS).alias("ch"), F.posexplode("embedding").alias("t", "v")).select("rec", "ch", F.col("t").cast("long").alias("t"), F.col("v").cast("double").alias("v"))


def emb_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, ch, samples: the same, an array for each channel."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.expr("vec_id div 20").alias("rec"), (F.col("vec_id") % CHANNELS).alias("ch"), F.col("embedding").cast("array<double>").alias("samples"))


def evt_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, ch, t, v: a user's events of a type, in order of time."""
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("rec"), F.col("event_type").alias("ch"), (F.row_number().over(order) - 1).cast("long").alias("t"), F.col("value").alias("v"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, y_true, y_prob: labels with a stand-in score, the share of the longest text's length."""
    d, y = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    top = d.agg(F.max("n_chars").alias("top"))
    return y.join(d, "doc_id").crossJoin(F.broadcast(top)).select("doc_id", "lang", "source", F.col("quality").alias("y_true"), (F.col("n_chars").cast("double") / F.col("top")).alias("y_prob"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """family, montage, length, run, auc, auprc: line items as a log of a sweep's runs."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("family"), F.col("l_linestatus").alias("montage"), F.col("l_linenumber").alias("length"), F.col("l_orderkey").alias("run"), F.col("l_discount").alias("auc"), F.col("l_tax").alias("auprc"))


#: The same views for a SQL engine, as common table expressions.
SQL = {
    "sig": "sig as (select vec_id // 20 as rec, vec_id % 20 as ch, k - 1 as t, embedding[k]::double as v from embeddings, unnest(range(1, 65)) as u(k))",
    "evt": "evt as (select user_id as rec, event_type as ch, row_number() over (partition by user_id, event_type order by ts, event_id) - 1 as t, value as v from events)",
    "scores": "scores as (select doc_id, lang, source, quality as y_true, n_chars::double / (select max(n_chars) from documents) as y_prob from labels join documents using (doc_id))",
    "runs": "runs as (select l_returnflag as family, l_linestatus as montage, l_linenumber as length, l_orderkey as run, l_discount as auc, l_tax as auprc from lineitem)",
}
