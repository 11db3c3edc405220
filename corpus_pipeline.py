"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. Stages are written as Parquet to the shared folder and read again between each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import decontaminate, jaccard, linededup, packing, toxicity
from larder.llm.common import table, without, written

#: SQL cannot express trained models or tokenisers.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines seen in an earlier document go; documents stay, even those left empty, and n_chars follows the text."""
    out = linededup.dedup_rows(docs, carry=tuple(docs.columns))
    now = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*[now.get(c, F.col(f"row.c{i + 1}")).alias(c) for i, c in enumerate(docs.columns)])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the smallest id stays."""
    others = jaccard.join(docs).where("doc_id <> component_id").select("doc_id")
    return without(docs, written(others, "copies"), ["doc_id"]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go."""
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    gone = found.where(decontaminate.contaminated(F.col("n_hit"), F.col("n_words"))).select("doc_id")
    return without(docs, written(gone, "contaminated"), ["doc_id"]).select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest as pieces of sequences."""
    out = packing.pack(docs, keep_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
