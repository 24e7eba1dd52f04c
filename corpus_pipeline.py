"""The corpus pipeline: quality classifier, exact dedup, SimHash near-dedup, mixing, byte-level BPE.

Each stage gets what the one before kept, as a table reread from Parquet. SQL cannot express the
classifier, so ORACLE_SQL is None; the tests hold run() against plain Python versions of its stages.

Every stage decides by row, not by doc_id: rows may repeat, and a null doc_id is one like any other. A null text counts as
the empty text, in every stage; a very long text is worked off whole, in one row's memory. Null languages and sources are
values of their own. Columns pass unchanged, extra ones too, whatever their names, up to the last stage, which
returns token counts and digests. An empty table gives an empty one. How ties are settled is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftline.llm.byte_bpe import round_trip
from driftline.llm.common import table, written
from driftline.llm.exact_dedup import kept_documents
from driftline.llm.mixing import mixed_documents
from driftline.llm.quality_model import good_documents, train
from driftline.llm.simhash import one_of_each_group


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of ``docs``. Ties: a strength at the cut stays, and equal texts go or stay together."""
    return good_documents(docs, train(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts. Ties: the longest original text, the smallest id (null last), then the place in the table."""
    return kept_documents(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints. Ties: the smallest id (null last), then the place in the table."""
    return one_of_each_group(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. Ties: equal sizes are ordered by a seeded hash of id and text; of equal rows any may be taken."""
    return mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, as counts and digests, and of what they decode to; a document that the mix repeats is encoded as often."""
    import public_tokenizers

    return round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_stage), ("SimHash near-dedup", near_stage), ("mixing", mixing_stage), ("byte-level BPE", encoding_stage)]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.split()[0].lower()}")
    return docs
