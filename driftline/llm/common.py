"""What the training-data operators share: word rules, table access and written intermediates."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.sources.intermediate import shared_folder, stored

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: ASCII white space, the characters that separate words.
WHITE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    This cuts the lineage: what was written survives the loss of executors, and ids made by
    ``monotonically_increasing_id`` are fixed from here on.
    """
    return stored(df, name)


def identified(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` as a struct ``_doc`` beside ``_file`` and ``_place``, which tell its rows apart however often they are read.

    A table read from files is identified by the place of each row in them. Anything else may come out in
    another order the next time, so it is written first.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = written(docs, name)
    place = docs.metadataColumn("_metadata")
    return docs.select(F.xxhash64(place["file_path"]).alias("_file"), place["row_index"].alias("_place"), F.struct("*").alias("_doc"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, also where ``body`` uses it inside other lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def text_of(column: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def without_white(text: Column) -> Column:
    """``text`` without ASCII white space; byte-wise replacement, no regular expression."""
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else unchanged (``lower`` would also change other alphabets)."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
