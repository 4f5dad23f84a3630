"""A corpus pipeline: each stage works on the rows its predecessor kept.

Stages return a DataFrame that is written as Parquet and read again as the next one's
documents. All but the last return the columns of ``documents``; the last returns the
pieces of the packed sequences.

What the stages do with odd rows: a null text, or one without a letter, is rejected by
``language``, and so no later stage of the pipeline sees one (each takes it as empty on
its own). A null doc_id is an id like any other, but never the one that stays if there is
a choice. Repeated rows and equal texts are one row after ``exact_dedup``; ties in
``near_dedup`` go to the smallest doc_id, then the smallest hash of the text. Very long
texts are worked on whole. An empty table gives empty results. Extra columns are carried
along by all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from umbra.llm import exact_dedup, lang_id, mixing, packing, simhash
from umbra.llm.common import made, materialize, release

STAGES = [
    ("language", lang_id.stage),
    ("exact_dedup", exact_dedup.stage),
    ("near_dedup", simhash.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: SQL has neither the classifier nor XXH64, hash permutations or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's own tables, and its input, are deleted
    when its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        mark = made()
        after = materialize(stage(spark, docs, sf_dir), name)
        release(before, *[t for t in made(mark) if t is not after])
        docs = before = after
    return docs
