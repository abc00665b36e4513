"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``documents``.

- quality: documents that the classifier scores under the threshold go.
- near_duplicates: of each class one row stays, of the least id (one without an id only where all are).
- repeats: bytes that repeat elsewhere are cut; documents stay, if need be empty, and n_chars follows.
- mixing: each document is taken as often as its rate says, rounded by a hash of its id (of its text where the id is
  null). Clean documents set the size; scarce domains are repeated, up to REPEAT times what there is of them.
- packing: a row for each piece.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import stored_alone, table
from quire.llm.mixing import label_domain, mix
from quire.llm.near_dup import one_of_each
from quire.llm.packing import pack_documents
from quire.llm.quality_mil import quality
from quire.llm.repeats import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
REPEAT = 4.0


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = quality(docs, table(spark, sf_dir, "labels"), carry=COLUMNS)
    return scored.where(F.col("predicted") == 1).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, COLUMNS)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = remove_repeats(docs, with_text=True, carry=["lang", "source"])
    return cut.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", label_domain().alias("domain"))
    return mix(docs, labels, repeat=REPEAT, carry=COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), added=True)


STAGES = [
    ("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("repeats", repeats_stage), ("mixing", mixing_stage),
    ("packing", packing_stage)
]
ORACLE_SQL = None  # neither the classifier nor the signatures can be written in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. A stage's own tables, and what it read, are deleted when its result is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        done = stored_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            last.drop()
        docs, last = done.df, done
    return docs
