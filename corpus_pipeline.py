"""A training-data pipeline: language ID, near-dedup, substring dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; run() writes every stage's rows
as Parquet to the shared folder and rereads them, so a lost executor costs at most one stage's tasks. Stages need doc_id and
text (and lang, to learn languages from) and keep all other columns as they are, but for n_chars where a text is cut. Rows
with null or repeated doc_ids are rows like others; null texts and those without a letter go in the first stage; an empty
table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wavefold.llm import decontaminate, langid, neardup, packing, substrings
from wavefold.llm._common import Stored
from wavefold.llm.queries import read, tokenizer


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that a language model accepts; those without a letter, or unlike any language, go."""
    return langid.accepted(docs, langid.train(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-copies: that of the least doc_id (rows without one come last). Rows that share a
    doc_id but not their words are documents of their own."""
    found = neardup.near_duplicates(docs)
    first = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("f"))
    return _rows(docs, first.select("f.doc_id", "f.text_hash"), "left_semi", once=True)


def _rows(docs: DataFrame, wanted: DataFrame, how: str, once: bool = False) -> DataFrame:
    """docs' rows that agree (left_semi) or don't (left_anti) with wanted (doc_id, text_hash: xxhash64 of the text), whatever
    their other columns are called; `once`: of rows that agree in both, one."""
    d, h = (next(f"{x}{k}" for k in range(len(docs.columns) + 1) if f"{x}{k}" not in docs.columns) for x in ("_id", "_hash"))
    keyed = docs.withColumns({d: F.col("doc_id").cast("long"), h: F.xxhash64(F.col("text").cast("string"))})
    w = wanted.toDF("_w_id", "_w_hash")
    got = keyed.join(w, keyed[d].eqNullSafe(w["_w_id"]) & (keyed[h] == w["_w_hash"]), how)
    return (got.dropDuplicates([d, h]) if once else got).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words of passages that came earlier; documents of which nothing is left go, untouched ones stay as they are."""
    return substrings.trimmed(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that hold a window of a benchmark item."""
    hit = decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark")).where("contaminated")
    return _rows(docs, hit.select("doc_id", "text_hash").distinct(), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places what is left in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("benchmark", benchmark), ("packed", packed)]

#: Language models and a tokenizer are beyond SQL; tests/llm holds the stages after the first against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    last = None
    for name, stage in STAGES:
        now = Stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            last.drop()
        docs, last = now.df, now
    return docs
