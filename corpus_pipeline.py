"""A corpus from raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetmetrics.llm import langid, mixing
from fleetmetrics.llm.near_dedup import NearCopies, near_copies
from fleetmetrics.llm.packing import pack_documents, public_vocabulary, token_counter
from fleetmetrics.llm.queries import domain_labels
from fleetmetrics.llm.suffix_dedup import remove_repeats
from fleetmetrics.llm.tables import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: The languages of the corpus; documents that are predicted to be in another go.
LANGUAGES = ("de", "en", "es", "fr")
#: Shares of tokens by domain. Clean documents belong to the others in a small part, which these shares leave room for.
WEIGHTS = {"clean": 0.96, "junk": 0.02, "toxic": 0.02}
#: The domain that sets the budget: its tokens stay, and the others are brought to their share beside them.
WHOLE = ("clean",)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose predicted language is one of ``LANGUAGES``; texts without letters, called ``und``, go."""
    return langid.keep_languages(docs, langid.train(docs), LANGUAGES)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that with the least id.

    Rows that repeat an id with the same text count once; those with other texts
    stay, since they are other documents. Rows without an id stay.
    """
    kept = near_copies(docs, NearCopies()).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    once = named.withColumn("_text", digest).dropDuplicates(["doc_id", "_text"]).drop("_text")
    return once.unionByName(docs.where("doc_id is null"))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the strings that repeat across them; those of which nothing is left go."""
    cut = remove_repeats(docs)
    return cut.where(F.length(F.trim("text")) > 0).withColumn("n_chars", F.length("text").cast("long"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as their rates say, by expectation; clean ones stay, whatever the others hold.

    Tokens are those that the packing stage puts into sequences.
    """
    counter = token_counter(public_vocabulary())
    mixed = mixing.mix(docs, domain_labels(spark, sf_dir), WEIGHTS, whole=WHOLE, iterations=None, counter=counter)
    return mixed.take(docs, key="doc_id")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids, each with its sequence and its place there."""
    return pack_documents(docs, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", language_id),
    ("near dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("mixing to weights", mixing_to_weights),
    ("best-fit packing", best_fit_packing),
]

#: No SQL expresses language models, near copies by union of links, or packing; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``, each one's rows written as Parquet and reread by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
