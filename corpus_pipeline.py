"""A training corpus from raw documents: five stages, each over all that the one before it kept.

Each stage's result is written as Parquet to the folder that all executors share
and read from there by the next. All but the last return the columns of documents.
Each stage takes null and empty texts, null and repeated doc_ids, repeated rows and
empty tables; what becomes of them is said with the operator that it calls. Null and
empty texts go in the first stage, so no later one meets them in a whole run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm._spark import stored, table
from quern.llm.decontaminate import decontaminated
from quern.llm.language import in_language
from quern.llm.line_dedup import without_repeated_lines
from quern.llm.ngram_join import one_of_each
from quern.llm.pack import packed


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text in any language go."""
    return in_language(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Multi-line chunks that stand in an earlier document go, and documents with nothing else."""
    return without_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingle similarity, the one of the smallest doc_id stays."""
    return one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with benchmark items go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, tokenized and packed into sequences."""
    import public_tokenizers

    return packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("best_fit_packing", packing),
]

#: The language network, the shingle links and the packing have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, repeated rows and all; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
