"""A corpus pipeline of five stages; counted as part of the llm subpackage.

Each stage gets what the one before it kept and wrote. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm import decontaminate, ngram_join, packing, secret_scan, toxicity
from vellumine.llm.common import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject, all columns. It is fitted on labelled rows of the documents that come in.

    A null, empty or blank text is no evidence and stays, a null doc_id too;
    repeated rows all stay or go. Without labels of both kinds nothing goes. An
    empty table stays empty.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the n-gram join connects, that with the least doc_id; the rest go.

    Null, empty and blank texts and rows with a null doc_id have no partner and
    stay. Of rows with one doc_id all stay or go: they go if each of their texts
    has a partner with a lesser doc_id. An empty table stays empty.
    """
    classes = ngram_join.duplicate_classes(docs)
    gone = classes.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("class_id")).alias("stays")).where("NOT stays").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no long span with a benchmark item.

    Null, empty and short texts share nothing and stay, a null doc_id too; of
    repeated rows all stay or go. Without items nothing goes. An empty table
    stays empty.
    """
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the random strings that look like secrets masked.

    Null and empty texts stay as they are, repeated rows are masked alike,
    n_chars follows the text. An empty table stays empty.
    """
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of pieces of documents: doc_id, piece, token_start, n_tokens, loss_tokens, bin, slot, bin_start.

    Null and empty texts have no tokens and no rows, rows with a null doc_id are
    left out, repeated rows are packed again, equal needs in an order of their
    own. An empty table gives no rows.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

#: A fitted classifier and a tokenizer are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of ``sf_dir``; between them the rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, f"pipeline-{name}")
    return docs
