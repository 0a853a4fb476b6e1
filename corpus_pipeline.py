"""From raw documents to token files: quality, near duplicates, benchmark items, mix, token ids.

Every stage takes all that its predecessor kept and is written before the next one reads it. The
first four return the columns of the documents, also those whose names an operator uses itself; only
doc_id, text, lang and source mean anything to them. An empty table gives an empty table in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from repolith.llm import base, decontaminate, mixing, ngram_join, quality, queries, token_codes

#: Near duplicates share this many hundredths of their five-word shingles.
PERCENT, SHINGLE = 80, 5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below their language's perplexity threshold.

    Null and empty texts stay; a null language has the thresholds of all; of repeated rows all stay or
    all go; a null id is unlabelled.
    """
    base.prepare(spark)
    # other columns go by numbers there, whatever their names are
    safe = [c if c in ("doc_id", "text", "lang") else f"_in{i}" for i, c in enumerate(docs.columns)]
    found = quality.judge(docs.toDF(*safe), base.table(spark, sf_dir, "labels")).filter("_keep")
    return found.select(*safe).toDF(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id, a null id before all others.

    Of rows alike in id and text one stays. Null texts and texts without words all stay.
    """
    base.prepare(spark)
    return ngram_join.one_of_each(docs, PERCENT, SHINGLE)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, edits allowed; of repeated rows all stay or all go.

    Null and empty texts and items match nothing.
    """
    base.prepare(spark)
    return decontaminate.without_items(docs, base.table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all sources by their weights; a document taken for several rounds is as many rows.

    Null texts and texts without words are not taken, a null source is a source of its own. Rows alike in id,
    source and text are taken as one row, for the words of all.
    """
    base.prepare(spark)
    return mixing.take(docs, mixing.mix_plan(docs))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and what they hold of each document: a row per row of the mix, repeated ones too.

    A null text is empty, a null id comes first.
    """
    base.prepare(spark)
    return token_codes.encode_documents(docs, queries.vocabulary())


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]
#: The model, the random-walk search and the tokenizer cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = base.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
