"""Exact deduplication by a log-structured merge index (DataFrame operations only).

The rows of the table are dealt to ``MEMTABLES`` memtables. Each is flushed as one run, sorted by digest: of its rows
with one digest the one with the longest text, then the smallest identifier, stays, and their number. Every
run has a filter, a bitmap of its digests. Before runs are merged, each entry of a run probes the filters of all
other runs: one that is in none of them moves to the next level as it is, without a lookup. Compaction merges
the others, keeping the smallest identifiers.

On that level a digest with several rows is a hit. The documents probe a filter of the hits: those that are not
in it stand alone, and only the others look up their group. Hits are verified on their bytes: the filter selects
their texts, and the smallest and the largest text of a digest must be the same. Digests that fail are split by
their texts.

Scale: filters have a fixed size (``MEMTABLES`` times 1 MB for the runs, 4 MB for the hits), so they can be broadcast at any
input; as they fill up at a very large one, they let more entries through to the merge, with the same result.
Copies meet only in aggregations, which combine before the shuffle, so a group with a third of all rows costs
each task one row; the lookup joins narrow rows with one row for each digest, which AQE splits.

Defined results: a null text is the empty text. A null ``doc_id`` sorts after all others. Rows repeated
with the same ``doc_id`` are separate rows of which one stays; among rows with equal length and id the place in the
table decides. Very long texts are hashed whole. An empty table gives an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import identified, table, text_of, without_white, written

#: Bits of one row of a filter; the value is fixed by Spark's bitmap functions.
ROW_BITS = 32768
#: Runs that the table is dealt to, and rows of the filter of each.
MEMTABLES = 8
RUN_FILTER_ROWS = 256
#: Rows of the filter of the hits.
HIT_FILTER_ROWS = 1024


def digested(docs: DataFrame, digest_bits: int = 256, carried: tuple[str, ...] = ()) -> DataFrame:
    """One narrow row per document: _digest, _sha, _chars, _id and columns ``carried`` along."""
    sha = F.sha2(without_white(text_of()).cast("binary"), 256)  # fewer bits of it only to provoke collisions in tests
    rows = docs.select(F.col("doc_id").alias("_id"), F.char_length(text_of()).cast("long").alias("_chars"), sha.alias("_sha"), *carried)
    return rows.withColumn("_digest", F.substring("_sha", 1, digest_bits // 4))


def memtables(docs: DataFrame, digest_bits: int = 256, carried: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``digested``, written, with ``_row`` and the memtable ``_run`` that each is in."""
    rows = digested(docs, digest_bits, carried).withColumn("_row", F.monotonically_increasing_id())
    return written(rows.withColumn("_run", F.pmod(F.spark_partition_id(), F.lit(MEMTABLES))), "dedup-memtables")


def _first() -> Column:
    """Orders the rows of a group: longest text, smallest identifier (null last), then row."""
    return F.struct((-F.col("_chars")).alias("a"), F.col("_id").isNull().alias("b"), F.col("_id").alias("c"), F.col("_row").alias("d"))


def flush(rows: DataFrame, *keys: str) -> DataFrame:
    """The run of each memtable: per key the row that stays and the number of rows, sorted."""
    return rows.groupBy("_run", *keys).agg(F.min(_first()).alias("_keep"), F.count("*").alias("_n")).sortWithinPartitions("_run", *keys)


def _slot(digest: Column, filter_rows: int) -> tuple[Column, Column]:
    """Filter row and bit of a digest."""
    h = F.xxhash64(digest)
    return F.pmod(h, F.lit(filter_rows)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(ROW_BITS))


def _has(bits: str) -> Column:
    """Whether the bit ``_bit`` of a filter row is set; false without the row."""
    byte = F.conv(F.hex(F.expr(f"substring({bits}, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(_bit % 8 as int))")) != 0, F.lit(False))


def run_filters(runs: DataFrame, filter_rows: int = RUN_FILTER_ROWS) -> DataFrame:
    """A bitmap ``_bits0``, ``_bits1``, ... for each run, in ``filter_rows`` rows of 4 KB each at most."""
    row, bit = _slot(F.col("_digest"), filter_rows)
    rows = runs.select("_run", row.alias("_slot"), bit.alias("_bit"))
    return rows.groupBy("_slot").agg(*(F.bitmap_construct_agg(F.when(F.col("_run") == r, F.col("_bit"))).alias(f"_bits{r}") for r in range(MEMTABLES)))


def probed(runs: DataFrame, filters: DataFrame, filter_rows: int = RUN_FILTER_ROWS) -> DataFrame:
    """``runs`` with ``_elsewhere``: the number of other runs whose filter has the digest."""
    row, bit = _slot(F.col("_digest"), filter_rows)
    rows = runs.withColumn("_slot", row).withColumn("_bit", bit).join(F.broadcast(filters), "_slot")  # bounded by the parameters
    inside = F.lit(-1)  # its own run has it
    for r in range(MEMTABLES):
        inside = inside + _has(f"_bits{r}").cast("int")
    return rows.select(*runs.columns, inside.alias("_elsewhere"))


def compact(runs: DataFrame, *keys: str) -> DataFrame:
    """Merge the runs: per key the row that stays and the number of rows."""
    groups = runs.groupBy(*keys).agg(F.min("_keep").alias("_keep"), F.sum("_n").alias("_n"))
    return _level(groups, *keys)


def _level(groups: DataFrame, *keys: str) -> DataFrame:
    return groups.select(*keys, F.col("_keep.c").alias("keep_id"), F.col("_keep.d").alias("_keep_row"), F.col("_n").alias("group_size"))


def merged(runs: DataFrame) -> DataFrame:
    """The next level: what other runs may have is compacted, all else moves as it is."""
    entries = written(probed(runs, written(run_filters(runs), "dedup-filters")), "dedup-probed")
    return compact(entries.filter("_elsewhere > 0"), "_digest").unionByName(_level(entries.filter("_elsewhere = 0"), "_digest"))


def hit_filter(groups: DataFrame, filter_rows: int) -> DataFrame:
    """The filter over all digests with several rows: at most ``filter_rows`` rows of 4 KB, whatever the input."""
    row, bit = _slot(F.col("_digest"), filter_rows)
    hits = groups.filter("group_size > 1").select(row.alias("_slot"), bit.alias("_bit"))
    return hits.groupBy("_slot").agg(F.bitmap_construct_agg(F.col("_bit")).alias("_bits"))


def _may_hit(rows: DataFrame, filters: DataFrame, filter_rows: int) -> DataFrame:
    """``rows`` with ``_hit``: whether the filter has the digest."""
    row, bit = _slot(F.col("_digest"), filter_rows)
    own = rows.columns
    rows = rows.withColumn("_slot", row).withColumn("_bit", bit).join(F.broadcast(filters), "_slot", "left")
    return rows.select(*own, _has("_bits").alias("_hit"))


def verify_hits(docs: DataFrame, filters: DataFrame, digest_bits: int = 256, filter_rows: int = HIT_FILTER_ROWS) -> DataFrame:
    """Digests of which not all texts have the same bytes; the filter keeps texts of single documents out of the shuffle."""
    texts = docs.select(without_white(text_of()).alias("_normal"))
    texts = texts.withColumn("_digest", F.substring(F.sha2(F.col("_normal").cast("binary"), 256), 1, digest_bits // 4))
    same = _may_hit(texts, filters, filter_rows).filter("_hit").groupBy("_digest").agg(F.min("_normal").alias("_a"), F.max("_normal").alias("_b"))
    return same.filter("_a <> _b").select("_digest")


def exact_dedup(docs: DataFrame, digest_bits: int = 256, filter_rows: int = HIT_FILTER_ROWS, carried: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 and columns ``carried`` along."""
    rows = memtables(docs, digest_bits, carried)
    groups = written(merged(written(flush(rows, "_digest"), "dedup-runs")), "dedup-groups")
    filters = written(hit_filter(groups, filter_rows), "dedup-hits")
    clash = written(verify_hits(docs, filters, digest_bits, filter_rows), "dedup-clashes")
    cols = ["_id", "keep_id", "group_size", "_row", "_keep_row", "_sha", *carried]
    split = None
    if not clash.isEmpty():
        texts = _with_text(docs, digest_bits, carried).join(clash, "_digest", "left_semi").withColumn("_row", F.monotonically_increasing_id()).withColumn("_run", F.lit(0))
        texts = written(texts, "dedup-split")
        split = texts.join(compact(flush(texts, "_digest", "_normal"), "_digest", "_normal"), ["_digest", "_normal"]).select(*cols)
        rows = rows.join(clash, "_digest", "left_anti")
    rows = _may_hit(rows, filters, filter_rows)
    alone = rows.filter("not _hit").select(*rows.columns, F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.col("_row").alias("_keep_row"))
    found = rows.filter("_hit").join(groups, "_digest")
    out = alone.select(*cols).union(found.select(*cols))
    out = out if split is None else out.union(split)
    return out.select(F.col("_id").alias("doc_id"), "keep_id", "group_size", (F.col("_row") == F.col("_keep_row")).alias("kept"), F.col("_sha").alias("text_sha256"), *carried)


def _with_text(docs: DataFrame, digest_bits: int, carried: tuple[str, ...]) -> DataFrame:
    """``digested`` with the text ``_normal`` that the digest is of."""
    normal = docs.select("doc_id", "text", without_white(text_of()).alias("_normal"), *carried)
    return digested(normal, digest_bits, (*carried, "_normal"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Documents meet the narrow kept rows by their places in the table, each of which occurs once. Nulls, blank and
    very long texts, ties, repeated rows and empty tables as above; columns pass unchanged, whatever their names.
    """
    rows = identified(docs, "dedup-docs")
    found = exact_dedup(rows.select("_doc.doc_id", "_doc.text", "_file", "_place"), carried=("_file", "_place"))
    return rows.join(found.filter("kept").select("_file", "_place"), ["_file", "_place"], "left_semi").select("_doc.*")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


_NORMAL = "replace(replace(replace(replace(replace(replace(coalesce(text, ''), ' ', ''), chr(9), ''), chr(10), ''), chr(11), ''), chr(12), ''), chr(13), '')"
OP5_SQL = f"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256({_NORMAL}) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER w = 1 AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST)
"""
