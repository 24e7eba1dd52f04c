"""Mixing sources to target weights by subset-sum budget fitting.

A source's target is met by whole passes over its documents and one part pass. For the part pass the
documents are counted by exact size; of each size the proportional number is taken, rounded with a carried
remainder from a seeded start, so that less than the largest size is missing or too much. A bounded-knapsack
dynamic program over what may be added and given back meets the budget as exactly as the sizes allow. Which
documents of a size are taken is decided by a seeded hash of the document.

Scale: the program runs per source on the histogram of sizes, not on documents: its work depends on the
largest size, as the proportional part leaves less than that. Its sums reach ``SPAN`` times that size at
first, and further, up to ``MOST_BITS`` of memory, only while a budget is not met as nearly as it could be.
Rows that are the same in source, doc_id and text are one entry with a count, so repeated rows are ranked as one.
Sizes with many documents are cut into slices of the hash range, so that no window holds more than about
``SLICE`` entries. Of an entry that is taken in part, the rows are numbered by their partitions.

Defined results: a null text has size 0. Null sources are a source of their own, the last. Documents of
size 0 take 0 words. Rows repeated with one ``doc_id`` are separate documents (equal hashes: either may
be taken, never both for one place). Sources without words have target 0. Very long texts are counted whole. Sources with
equal caps per weight are ordered by name. Empty table: empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import functools
import math
import random

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.llm.common import WORD, identified, table, text_of, written

SEED = 17
#: No document is taken more often than this.
MOST_REPEATS = 3
#: How far the sums of the dynamic program reach at first, in multiples of the largest size.
SPAN = 2
#: They reach further while all its steps together stay below so many bits.
MOST_BITS = 1 << 29
#: Documents of one source and size that one window ranks, about.
SLICE = 256


def size_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def unit_hash(*columns: Column | str, seed: int = SEED) -> Column:
    """A number in [0, 1) from the columns and the seed."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / float(1 << 53)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = MOST_REPEATS) -> DataFrame:
    """_source, source_size, target: shares by weight, capped at ``most`` times the size, the excess shared anew.

    Water filling in closed form: with sources in the order of cap / weight, the capped ones are a prefix,
    and the level of the others follows from running sums. One row per source goes through the windows.
    """
    total = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    order = Window.orderBy(F.col("_source").isNull(), F.col("_source"))
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))))
    w = total.withColumn("_w", weight.cast("double")).withColumn("_cap", F.col("source_size") * float(most))
    ranked = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").isNull(), "_source")
    before, whole = ranked.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    w = w.withColumn("_level", left / (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    # the level of the first source that stays below its cap holds for all after it
    level = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), F.col("_level").alias("level")))).over(whole)["level"]
    return w.withColumn("_common", level).select("_source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_common") * F.col("_w"), F.col("_cap"))).alias("target"))


def _adjusted(sizes: list[int], counts: list[int], take: list[int], rest: int, reach: int) -> tuple[list[int], int]:
    """``take`` with documents added and given back so that the sum grows by ``rest`` as nearly as it can, and what is missed.

    The reachable changes from -reach to reach are the bits of an integer, and for each size the number that
    may be added, or given back, is split into powers of two. The nearest reachable change is traced back.
    """
    mask, sums, goal, steps = (1 << 2 * reach + 1) - 1, 1 << reach, reach + rest, []
    for i in sorted((i for i in range(len(sizes)) if sizes[i]), key=lambda i: -sizes[i]):
        for sign, left in ((1, counts[i] - take[i]), (-1, take[i])):
            left, power = min(left, 2 * reach // sizes[i]), 1
            while left > 0 and not sums >> goal & 1:
                n = min(power, left)
                grown = (sums | (sums << n * sizes[i] if sign > 0 else sums >> n * sizes[i])) & mask
                if grown != sums:
                    steps.append((i, sign * n, sums))
                    sums = grown
                left, power = left - n, power * 2
        if sums >> goal & 1:
            break
    missed, at = next((d, x) for d in range(2 * reach + 2) for x in (goal - d, goal + d) if 0 <= x <= 2 * reach and sums >> x & 1)
    take = list(take)
    for i, n, earlier in reversed(steps):
        if not earlier >> at & 1:
            take[i] += n
            at -= n * sizes[i]
    return take, missed


def fit_budget(sizes: list[int], counts: list[int], budget: int, span: int = SPAN, start: float = 0.5) -> list[int]:
    """How many documents of each size to take so that their sizes sum to ``budget`` as nearly as they can.

    Proportional numbers first, rounded with a remainder that is carried from size to size and begins with
    ``start``; then the dynamic program of ``_adjusted``, reaching further until the budget is met.
    """
    total = sum(s * c for s, c in zip(sizes, counts, strict=True))
    if not sizes or budget <= 0 or total <= 0:
        return [0] * len(sizes)
    budget = min(budget, total)
    take, carried = [0] * len(sizes), int(start * total)
    for i in sorted(range(len(sizes)), key=lambda i: sizes[i]):
        take[i], carried = divmod(carried + counts[i] * budget, total)
    rest = budget - sum(s * t for s, t in zip(sizes, take, strict=True))
    unit = math.gcd(*sizes)
    least = min(budget % unit, -budget % unit)  # no sum of sizes is nearer
    moves = sum(2 * c.bit_length() for c in counts)
    reach = span * max(sizes)
    out, missed = _adjusted(sizes, counts, take, rest, reach)
    while missed > least and reach < total and moves * 8 * reach <= MOST_BITS:
        reach *= 4
        out, missed = _adjusted(sizes, counts, take, rest, reach)
    return out


def _plan(pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    """The histogram of one source: how many documents of each size the part pass takes."""
    pdf = pdf.sort_values("_size")
    start = random.Random(f"{seed} {pdf['_source'].iloc[0]}").random()
    take = fit_budget(pdf["_size"].tolist(), pdf["_count"].tolist(), int(pdf["_part"].iloc[0]), start=start)
    return pdf.assign(_take=take)[["_source", "_size", "_count", "_passes", "_take"]]


def plans(sizes: DataFrame, target: DataFrame, seed: int = SEED) -> DataFrame:
    """_source, _size, _count, _passes, _take: per size the whole passes and the documents of the part pass."""
    counts = sizes.groupBy("_source", "_size").agg(F.count("*").alias("_count"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0)
    t = target.withColumn("_passes", passes.cast("int")).withColumn("_part", F.round(F.col("target") - F.col("_passes") * F.col("source_size")).cast("long"))
    counts = counts.join(t.select(F.col("_source").alias("_s"), "_passes", "_part"), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    return counts.groupBy("_source").applyInPandas(lambda pdf: _plan(pdf, seed), "_source string, _size long, _count long, _passes int, _take long")


def taken_of(sizes: DataFrame, plan: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """``sizes`` with ``_times``: how often the mix takes each document. Needs _source, _size, _u, _text, _row."""
    alike = ["_source", "_size", "_u", "_text"]
    same = lambda keys: functools.reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"p{k}")) for k in keys))
    p = plan.select(F.col("_source").alias("p_source"), F.col("_size").alias("p_size"), "_count", "_passes", "_take")
    each = sizes.groupBy(*alike).agg(F.count("*").alias("_c")).join(p, same(["_source", "_size"])).drop("p_source", "p_size")
    slices = F.ceil(F.col("_count") / slice_rows)
    each = written(each.withColumn("_slice", F.floor(F.col("_u") * slices).cast("long")), "mix-entries")
    large = each.filter(F.col("_count") > slice_rows).groupBy("_source", "_size", "_slice").agg(F.sum("_c").alias("_n"), F.first("_take").alias("_t"))
    before = Window.partitionBy("_source", "_size").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    large = large.withColumn("_quota", F.greatest(F.lit(0), F.least(F.col("_n"), F.col("_t") - F.coalesce(F.sum("_n").over(before), F.lit(0)))))
    large = large.select(F.col("_source").alias("p_source"), F.col("_size").alias("p_size"), F.col("_slice").alias("p_slice"), "_quota")
    each = each.join(large, same(["_source", "_size", "_slice"]), "left").withColumn("_quota", F.coalesce("_quota", "_take"))
    ahead = Window.partitionBy("_source", "_size", "_slice").orderBy("_u", "_text").rowsBetween(Window.unboundedPreceding, -1)
    some = F.greatest(F.lit(0), F.least(F.col("_c"), F.col("_quota") - F.coalesce(F.sum("_c").over(ahead), F.lit(0))))
    each = each.select(*(F.col(k).alias(f"p{k}") for k in alike), "_c", "_passes", some.alias("_some"))
    # written, so that the join reads two plain tables, of which AQE splits an entry with very many rows
    rows = sizes.join(written(each, "mix-taken"), same(alike)).drop(*(f"p{k}" for k in alike))
    whole = rows.filter("_some = 0 or _some = _c").withColumn("_part", (F.col("_some") > 0).cast("int"))
    # of an entry taken in part: the rows of a partition in order, after those of the partitions before
    rest = rows.filter("_some > 0 and _some < _c").withColumn("_in", F.shiftright("_row", 33))
    held = rest.groupBy(*alike, "_in").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*alike).orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    held = held.select(*(F.col(k).alias(f"p{k}") for k in (*alike, "_in")), "_before")
    nth = F.row_number().over(Window.partitionBy(*alike, "_in").orderBy("_row")) + F.col("_before")
    rest = rest.join(held, same([*alike, "_in"])).withColumn("_part", (nth <= F.col("_some")).cast("int")).select(*whole.columns)
    return whole.unionByName(rest).withColumn("_times", F.col("_passes") + F.col("_part"))


def measured(docs: DataFrame, seed: int = SEED, carried: tuple[str, ...] = ()) -> DataFrame:
    """One narrow row per document: its size, source, place in the seeded order, a row id and columns ``carried`` along."""
    rows = docs.select("doc_id", F.col("source").alias("_source"), size_of(text_of()).alias("_size"), F.xxhash64(text_of()).alias("_text"), *carried)
    return rows.withColumn("_u", unit_hash("doc_id", "_text", seed=seed)).withColumn("_row", F.monotonically_increasing_id())


def _mixed(docs: DataFrame, weights: tuple[int, ...], most: int, seed: int, carried: tuple[str, ...] = ()) -> DataFrame:
    sizes = written(measured(docs, seed, carried), "mix-sizes")
    target = written(targets(sizes, weights, most), "mix-targets")
    plan = written(plans(sizes, target, seed), "mix-plan")
    return taken_of(sizes, plan).join(target.withColumnRenamed("_source", "_t"), F.col("_source").eqNullSafe(F.col("_t")))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, times for every document."""
    rows = _mixed(docs, weights, most, seed)
    return rows.select("doc_id", F.col("_source").alias("source"), F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("_times")).cast("long").alias("taken"), F.col("_times").cast("int").alias("times"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    A document of size 0 is taken once: it adds no words. Documents meet the narrow rows of the mix by their places in
    the table, each of which occurs once. Nulls, ties, very long texts, repeated rows and empty tables as above; columns
    pass unchanged, whatever their names.
    """
    rows = identified(docs, "mix-docs")
    times = F.when(F.col("_size") == 0, 1).otherwise(F.col("_times")).alias("_copies")
    copies = _mixed(rows.select("_doc.doc_id", "_doc.source", "_doc.text", "_file", "_place"), weights, most, seed, ("_file", "_place")).select("_file", "_place", times).filter("_copies > 0")
    return rows.join(copies, ["_file", "_place"]).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_doc.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
