"""The corpus pipeline: each stage works on the documents that the one before it kept.

Toxic documents go, one document of each group of near copies stays, documents that leak benchmark items go, sources are mixed
to their weights, and what is left is written as token ids. ORACLE_SQL is None: SQL cannot express these stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyloom.llm.common import staged, table
from skyloom.llm.decontamination import keep_unleaked
from skyloom.llm.mixing import mixed
from skyloom.llm.queries import tokenizer_path
from skyloom.llm.simhash import keep_one
from skyloom.llm.token_output import token_output
from skyloom.llm.toxicity import keep_clean

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None

STAGES = [
    ("toxicity", lambda spark, docs, sf_dir: keep_clean(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))),
    ("near_dedup", lambda spark, docs, sf_dir: keep_one(docs)),
    ("decontamination", lambda spark, docs, sf_dir: keep_unleaked(docs, table(spark, sf_dir, "benchmark"))),
    ("mixing", lambda spark, docs, sf_dir: mixed(docs)),
    # fewer words at hand than alone: the workers of the stages before still hold theirs
    ("token_output", lambda spark, docs, sf_dir: token_output(docs, tokenizer_path(), cache_words=50_000)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
