"""The corpus pipeline: language ID, near copies, benchmark passages, personal data, tokens.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; run() writes each as Parquet in the shared folder and reads it
again as the next one's docs. All but the last return the columns of documents. Nulls, empty tables and repeated rows are
treated as the operators say; extra columns of docs come through all but the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm import bpe, decontaminate, jaccard, langid, pii
from tidecast.llm.common import free_name, materialise, table

#: A document is rejected when no language was learned for it, or the best one's mean probability is below this.
LEAST_SCORE = 0.4
#: Bytes, in lower case with single spaces, of a passage that removes a document. Shorter benchmark items are no evidence.
LEAST_PASSAGE = 30


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts that no language explains."""
    net = langid.fit(docs.select("doc_id", "text", "lang"))
    pred, score = free_name("lang_pred", docs.columns), free_name("score", docs.columns)
    judged = langid.predict(docs, net, pred_col=pred, score_col=score)
    return judged.where((F.col(pred) != "und") & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts that share 0.8 of their word 5-grams."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a benchmark passage."""
    hits = free_name("hits", docs.columns)
    found = decontaminate.with_hits(docs, table(spark, sf_dir, "benchmark"), hits_col=hits)
    return found.where(~F.exists(hits, lambda h: h["end"] - h["start"] >= LEAST_PASSAGE)).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and telling terms by masks; n_chars follows the text."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids themselves."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN).drop("decoded")


STAGES = [("language_id", language), ("ngram_jaccard_join", near_copies), ("decontamination", decontamination), ("pii", personal_data), ("byte_level_bpe", tokens)]

#: SQL can't express the recurrent network that decides the first stage; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
