"""A corpus pipeline of five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import language_id, mixing, sentencepiece_bpe, simhash, suffix_dedup
from fathomline.llm.common import table, written
from fathomline.llm.queries import MIX_SEED, MIX_WEIGHTS, domain, tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the texts as they are now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def tell_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null labels are filled in."""
    return language_id.accepted(docs, language_id.train(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more."""
    return simhash.one_of_each(docs, words=5, similarity=0.8)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that an earlier document has are cut out."""
    return _counted(suffix_dedup.without_copies(docs, length=50))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the weights of their domain, language and source: as many tokens as there are, in at most three epochs."""
    return _counted(mixing.mixed(docs, domain=domain(), weights=MIX_WEIGHTS, fraction=1.0, max_epochs=3, seed=MIX_SEED))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    return sentencepiece_bpe.digests(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("language ID", tell_languages),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeated_passages),
    ("mixing", mix_sources),
    ("SentencePiece", encode),
]

#: No SQL: the first stage learns a model and the third compares all suffixes; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
