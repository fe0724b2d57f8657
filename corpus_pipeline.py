"""A training-corpus pipeline out of the operators in barloom.llm.

Each stage takes the documents that the stage before it kept, as (spark, docs, sf_dir), and returns documents again; the
last one adds the token ids. Documents are rows by doc_id; rows that share an id share its fate. Defined results: null
texts and texts without words are neither toxic, near copies nor contaminated and stay; extra columns stay as they are;
of a group of near copies the smallest id stays; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bpe, decontam, jaccard_join, suffix_dedup, toxicity
from barloom.llm.common import free_name

#: Near copies share NEAR_PERCENT % of their strings of NEAR_WORDS words.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = free_name("toxicity", docs.columns)
    scored = toxicity.toxicity(docs, toxicity.fit(docs, labels), name=score)
    return scored.where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays."""
    groups = jaccard_join.jaccard_join(docs, percent=NEAR_PERCENT, shingle=NEAR_WORDS)
    name = free_name("gone", docs.columns)
    gone = groups.where("n_shingles > 0 AND NOT (component_id <=> doc_id)").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that a document of a smaller id has too are cut out."""
    return suffix_dedup.cut_texts(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    name = free_name("found", docs.columns)
    return docs.join(found.select(F.col("doc_id").alias(name)).distinct(), F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns, their token ids, how many there are, and whether the ids decode to the text (columns of these names keep theirs, the new ones get _)."""
    lexicon = bpe.build_lexicon(spark, docs, bpe.default_tokenizer())
    ids, size, same, decoded = (free_name(c, docs.columns) for c in ("ids", "n_tokens", "round_trip", "decoded"))
    out = bpe.bpe_encode(docs, lexicon, name=ids, decoded=decoded)
    return out.select(*docs.columns, ids, F.size(ids).cast("long").alias(size), (F.col(decoded) == F.coalesce("text", F.lit(""))).alias(same))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe", tokenise),
]
#: Toxicity, contamination and suffix sorting are beyond SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
