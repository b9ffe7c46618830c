"""The corpus pipeline: from raw documents to token ids.

Quality rules drop poor documents and failing lines, near duplicates are reduced to one document of each
group, documents that hold benchmark items go, personal data are replaced by pseudonyms, and what remains is
encoded. Every stage reads all that its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate, jaccard, pieces, pii, quality_rules
from tidewatch.llm.common import Scratch, table

#: Ids of dropped documents are told to all tasks up to this number (8 bytes each); beyond, by a join.
BROADCAST_IDS = 1_000_000
#: The setting that names the key of the pseudonyms, and the key of tests.
PII_SETTING, PII_KEY = "spark.tidewatch.pii.key", "tidewatch-public-test-key"


def _without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents whose ids aren't among `ids` (a written table)."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_anti").select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their failing lines."""
    kept = quality_rules.quality_rules(docs).filter("kept")
    return kept.withColumns({"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}).select(docs.columns)


def _odd_ids(docs: DataFrame) -> bool:
    """Whether ids are missing or repeated, so that they don't tell rows apart."""
    return docs.groupBy("doc_id").count().filter("doc_id is null or count > 1").limit(1).count() > 0


def _numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents with a number of each row, written so that the numbers stay."""
    return Scratch(spark, "numbered").keep(docs.withColumn("__row", F.monotonically_increasing_id()), "rows", shuffled=False)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near duplicates; of repeated rows, one.

    Where ids are missing or repeated, components are of rows: equal ids alone make no copies.
    """
    if _odd_ids(docs):
        rows = _numbered(spark, docs)
        found = jaccard.jaccard_components(rows, doc_id="__row").select(F.col("doc_id").alias("__row"), "component_id")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row"))["__row"].alias("__row")
        ids = found.join(rows.select("__row", "doc_id"), "__row").groupBy("component_id").agg(first).select("__row")
        kept = rows.join(Scratch(spark, "copies").keep(ids, "ids"), "__row", "left_semi").select(docs.columns)
        return kept.dropDuplicates(["doc_id", "text"])  # repeated texts without words, which join nothing
    found = jaccard.jaccard_components(docs)
    return _without(docs, Scratch(spark, "copies").keep(found.filter("doc_id <> component_id").select("doc_id").distinct(), "ids"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; where ids are missing or repeated, each row for itself."""
    rows, key = (_numbered(spark, docs), "__row") if _odd_ids(docs) else (docs, "doc_id")
    found = decontaminate.find_contamination(rows, table(spark, sf_dir, "benchmark"), doc_id=key)
    ids = Scratch(spark, "leaks").keep(found.select(F.col("doc_id").alias(key)).distinct(), "ids")
    return _without(rows, ids, key).select(docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data."""
    return pii.pseudonymize(docs, spark.conf.get(PII_SETTING, PII_KEY)).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: doc_id, lang, source, n_tokens, ids, and whether decoding gives the text back."""
    return pieces.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("doc_id", "lang", "source"), decoded=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", private),
    ("SentencePiece encoding and decoding", encoding),
]

#: Stages 2, 3 and 5 have no SQL form (components of a graph, alignment, a tokenizer); tests hold the pipeline
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again as the next one's input."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"), shuffled=False)
    return STAGES[-1][1](spark, docs, sf_dir)
