"""From raw documents to packed sequences: five operators in a row.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; ``run`` writes every stage's result as Parquet into the shared folder and
gives it to the next.  All but the last return the columns of ``documents``.

A stage's result must be written before the next stage begins: that one deletes the
tables which the stages before it staged, unless its own input still reads them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm import jaccard, linededup, packing, quality, toxicity
from triagelake.llm.common import drop_tables, fresh_path, stage_table, staged_tables
from triagelake.llm.tokens import vocabulary


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are mostly boilerplate go: those without
    50 words (null and empty texts, too) among them.  Each row is judged by its own
    text, repeated rows alike.  An empty table stays empty."""
    return quality.keep_good(docs, quality.train(docs, _labels(spark, sf_dir)))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go.  Each row is scored by its own text, a null text
    as an empty one, repeated rows alike.  An empty table stays empty."""
    return toxicity.drop_toxic(docs, _labels(spark, sf_dir))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go from the text (ties of ids: the row
    staged first keeps them, null ids last); documents that had nothing else go, too,
    so of repeated rows one is left.  Null and empty texts stay.  n_chars follows the
    text.  An empty table stays empty."""
    left = linededup.keep_first(docs)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows with 80 % of their five-word shingles in common the one
    with the smallest (doc_id, row) stays, nulls last; ids may be repeated or null.
    Null texts and texts without words are in no group and stay.  An empty table
    stays empty."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row"))
    rows = stage_table(spark, packed, "rows")
    doc_id = F.col("doc").getField("doc_id")
    texts = rows.select("row", F.col("doc").getField("text").alias("text"))
    groups = jaccard.jaccard_join(texts, n=5, percent=80, key="row").select(F.col("doc_id").alias("row"), "component_id")
    placed = rows.select("row", F.struct(doc_id.isNull(), doc_id, "row").alias("at")).join(groups, "row")
    kept = placed.groupBy("component_id").agg(F.min("at").alias("at")).select("at.row")
    return rows.join(kept, "row", "left_semi").select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens.  A null or empty text is its end id alone;
    repeated rows are packed each on its own.  An empty table gives no pieces."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), capacity=1024, end_id=0)


_of_stages: list[str] = []


def _tidy(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, which first deletes what earlier stages staged."""
    @wraps(stage)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles()
        old = [p for p in _of_stages if p in staged_tables() and not any(p.split("/")[-1] in f for f in read)]
        drop_tables(spark, old)
        before = set(staged_tables())
        out = stage(spark, docs, sf_dir)
        _of_stages[:] = [p for p in _of_stages if p not in old] + [p for p in staged_tables() if p not in before]
        return out

    return begin


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", _tidy(quality_rules)),
    ("toxicity", _tidy(toxic_documents)),
    ("line_dedup", _tidy(line_dedup)),
    ("near_duplicates", _tidy(near_duplicates)),
    ("packing", _tidy(pack_sequences)),
]

#: Trained models and tokenizers decide; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = fresh_path(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
