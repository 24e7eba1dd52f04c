"""Quality rules with adaptive thresholds (DataFrame operations only).

Per document some rates are measured in one pass. Per language and source each rate is put into a
quantile sketch: a histogram over logarithmic bins, so that counts of bins add up exactly whatever the
partitioning, and any quantile is right within half a bin (a relative error of ``ALPHA``). Values up to
``RESOLUTION``, far below the scale of the rates, share the lowest bin, which reads back as 0. No limit
is a constant: each follows from the quantiles of its group.

1. *Bulk rates* (mean word length) have outer fences ``FENCE`` spreads beyond the quartiles. Documents within
   the inner fences, ``INNER`` spreads beyond, are the group's reference.
2. *Tail rates* (symbols, repeated lines, repeated words), which are 0 in most documents, get their sketches
   from the reference only, so that junk does not set its own limit. Their limit lies ``FENCE`` times the
   distance from the median to the 0.98 quantile beyond that quantile. A document breaks it only if its
   count does so by more than ``SURE`` standard deviations of a count: one repeated line among few is chance.

A group's quantiles are drawn to those of its language, and a language's to those of all documents, with
the weight of ``PRIOR_ROWS`` documents, and the spread grows by what this leaves in doubt. So a small group
passes smoothly from the wider limits of its parent to its own; there is no least size.

Defined results: a null text has no words and fails the base rule. Null languages and sources are groups
of their own. An empty table gives an empty result. Rows repeated count as often as they occur, ties share
a bin. Very long texts are measured whole, in one row's memory. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import WORD, let, table, text_of, without_white, written

#: Relative error of the sketch.
ALPHA = 0.01
#: Values up to this share the lowest bin.
RESOLUTION = 1e-4
#: Outer and inner fence: so many spreads beyond a quantile.
FENCE = 4.0
INNER = 1.5
#: The spread of a bulk rate counts as this share of the upper quartile at least: groups of like documents have none.
LEAST_SPREAD = 0.05
#: Standard deviations of a count by which a tail rate must be beyond its limit.
SURE = 2.0
#: Documents that the quantiles of the parent group weigh.
PRIOR_ROWS = 20
#: Rates limited from both sides, and from above: name, then the counts whose quotient it is.
BULK = {"word_length": ("word_chars", "n_words")}
TAIL = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "_lines"), "repeats": ("n_repeat_words", "n_words")}
#: Lower and upper quantile of the sketches.
QUANTILES = {k: (0.25, 0.75) for k in BULK} | {k: (0.5, 0.98) for k in TAIL}


def repeat_words(words: Column) -> Column:
    """Words that lie in a window of three words found twice or more, the first occurrence included.

    Sorting (hash, start) within the row brings equal windows together; of the sorted starts each adds the
    words up to the next one, three at most.
    """
    starts = F.sequence(F.lit(0), F.size(words) - 3)
    window = lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))
    pairs = F.sort_array(F.transform(starts, window))

    def cover(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        gaps = let(places, lambda p: F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    return F.when(F.size(words) >= 4, let(pairs, cover)).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of every whole text."""
    text = text_of()
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    counts = docs.select(
        "doc_id", "lang", "source",
        F.char_length(without_white(text)).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(lines, F.size).alias("_lines"),
        let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r"))).alias("_words"),
    )
    counts = counts.withColumn("n_words", F.col("_words.n")).withColumn("n_repeat_words", F.col("_words.r"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counts.withColumn("base_failed", failed).drop("_words")


def rates(counts: DataFrame) -> DataFrame:
    """The rates of BULK and TAIL as columns of these names."""
    return counts.withColumns({k: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0)) for k, (part, whole) in (BULK | TAIL).items()})


GAMMA = (1 + ALPHA) / (1 - ALPHA)


def _bin(value: Column) -> Column:
    return F.when(value <= RESOLUTION, 0).otherwise(F.ceil(F.log(value / RESOLUTION) / F.log(F.lit(GAMMA)) - 1e-9)).cast("long")


def _middle(at: Column) -> Column:
    return F.when(at == 0, F.lit(0.0)).otherwise(RESOLUTION * 2 * F.pow(F.lit(GAMMA), at) / (GAMMA + 1))


def sketches(rated: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row per (level, lang, source, rate, bin) with its count; levels: 0 source of a language, 1 language, 2 all."""
    sketch = F.array(*(F.struct(F.lit(k).alias("rate"), _bin(F.col(k)).alias("bin")) for k in names or QUANTILES))
    at0 = rated.select("lang", "source", F.explode(sketch).alias("s")).groupBy("lang", "source", "s.rate", "s.bin").agg(F.count("*").alias("n"))
    none = F.lit(None).cast("string")
    levels = F.array(*(F.struct(F.lit(k).alias("level"), lang.alias("lang"), source.alias("source")) for k, (lang, source) in enumerate(((F.col("lang"), F.col("source")), (F.col("lang"), none), (none, none)))))
    merged = at0.select("rate", "bin", "n", F.explode(levels).alias("l"))
    return merged.groupBy("l.level", "l.lang", "l.source", "rate", "bin").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame) -> DataFrame:
    """level, lang, source, rate, rows, and the quantiles ``a`` and ``b`` of QUANTILES."""
    bins = sketch.groupBy("level", "lang", "source", "rate").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("rows"))  # as many bins as a sketch has

    for which, name in enumerate("ab"):
        bins = bins.withColumn("_q", F.create_map(*(F.lit(x) for k, v in QUANTILES.items() for x in (k, v[which])))[F.col("rate")])
        # the first bin at which the running count exceeds q * (rows - 1)
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at"))
        end = F.aggregate("bins", start, lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.coalesce(a["at"], F.when(a["seen"] + x["n"] > F.col("_q") * (F.col("rows") - 1), x["bin"])).alias("at")))
        bins = bins.withColumn(name, _middle(end["at"]))
    return bins.select("level", "lang", "source", "rate", "rows", "a", "b")


def _drawn(own: DataFrame, parent: DataFrame, keys: list[str], prior: float) -> DataFrame:
    """``own`` with its quantiles drawn to those of ``parent`` (same ``keys`` and rate) and the doubt that remains."""
    above = parent.select(*(F.col(k).alias(f"_{k}") for k in (*keys, "rate")), F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("doubt").alias("_doubt"))
    same = F.col("rate") == F.col("_rate")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    draw = lambda c: (F.col("rows") * F.col(c) + prior * F.col(f"_{c}")) / (F.col("rows") + prior)
    doubt = prior / (F.col("rows") + prior) * (F.greatest(F.abs(F.col("a") - F.col("_a")), F.abs(F.col("b") - F.col("_b"))) + F.col("_doubt"))
    return own.join(above, same).select("lang", "source", "rate", "rows", draw("a").alias("a"), draw("b").alias("b"), doubt.alias("doubt"))


def limits(quantile: DataFrame, fence: float = FENCE, prior: float = PRIOR_ROWS) -> DataFrame:
    """lang, source, rate, low, high, inner_low, inner_high for every group of a language and source."""
    every, lang, own = (quantile.filter(F.col("level") == k).drop("level") for k in (2, 1, 0))
    group = _drawn(own, _drawn(lang, every.withColumn("doubt", F.lit(0.0)), [], prior), ["lang"], prior)
    bulk = F.col("rate").isin(*BULK)
    spread = F.when(bulk, F.greatest(F.col("b") - F.col("a"), LEAST_SPREAD * F.col("b"))).otherwise(F.col("b") - F.col("a")) + F.col("doubt")
    group = group.withColumn("spread", spread)
    low, high = (lambda f: F.when(bulk, F.col("a") - f * F.col("spread")).otherwise(F.lit(-1.0))), lambda f: F.col("b") + f * F.col("spread")
    return group.select("lang", "source", "rate", low(fence).alias("low"), high(fence).alias("high"), low(INNER).alias("inner_low"), high(INNER).alias("inner_high"))


def _by_group(rows: DataFrame, limit: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with a struct of limits per rate, null where a group has none."""
    value = F.struct("low", "high", "inner_low", "inner_high")
    wide = limit.groupBy(F.col("lang").alias("_lang"), F.col("source").alias("_source")).agg(*(F.max(F.when(F.col("rate") == k, value)).alias(f"_{k}") for k in names))
    return rows.join(wide, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left").drop("_lang", "_source")


def _inside(names: list[str], kind: str = "") -> Column:
    out = F.lit(True)
    for k in names:
        out = out & F.coalesce((F.col(k) >= F.col(f"_{k}.{kind}low")) & (F.col(k) <= F.col(f"_{k}.{kind}high")), F.lit(True))
    return out


def _surely_beyond(name: str) -> Column:
    """The count, less its own uncertainty, is beyond the limit."""
    part, whole = TAIL[name]
    return F.coalesce(F.col(part) - SURE * F.sqrt(F.col(part)) > F.col(f"_{name}.high") * F.col(whole), F.lit(False))


def thresholds(rated: DataFrame, fence: float = FENCE, prior: float = PRIOR_ROWS) -> DataFrame:
    """lang, source, rate and limits, from the documents that pass the base rule. ``rated`` is read twice."""
    passed = rated.filter(~F.col("base_failed"))
    bulk = written(limits(quantiles(sketches(passed, list(BULK))), fence, prior), "quality-bulk")
    reference = _by_group(passed, bulk, list(BULK)).filter(_inside(list(BULK), "inner_"))
    tail = limits(quantiles(sketches(reference, list(TAIL))), fence, prior)
    return bulk.unionByName(tail)


def quality_rules(docs: DataFrame, fence: float = FENCE, prior: float = PRIOR_ROWS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    rated = rates(written(measured(docs), "quality-counts"))
    limit = written(thresholds(rated, fence, prior), "quality-limits")
    out = _by_group(rated, limit, list(QUANTILES))
    kept = ~F.col("base_failed") & _inside(list(BULK))
    for k in TAIL:
        kept = kept & ~_surely_beyond(k)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def _limits_sql(name: str, source: str, rates: dict[str, tuple[str, str]]) -> str:
    """Common table expressions that end in ``name``: the limits of ``rates`` over the rows of ``source``."""
    each = ", ".join(f"('{k}', {k}, {QUANTILES[k][0]}, {QUANTILES[k][1]})" for k in rates)
    n, draw = name, lambda c: f"(o.rows * o.{c} + {PRIOR_ROWS}.0 * p.{c}) / (o.rows + {PRIOR_ROWS}.0) AS {c}"
    doubt = f"{PRIOR_ROWS}.0 / (o.rows + {PRIOR_ROWS}.0) * (greatest(abs(o.a - p.a), abs(o.b - p.b)) + p.doubt) AS doubt"
    middle = lambda c: f"CASE WHEN {c} = 0 THEN 0.0 ELSE CAST({RESOLUTION} AS DOUBLE) * 2 * pow(CAST({GAMMA!r} AS DOUBLE), {c}) / (CAST({GAMMA!r} AS DOUBLE) + 1) END"
    spread = f"greatest(b - a, {LEAST_SPREAD} * b) + doubt" if rates is BULK else "b - a + doubt"
    low = lambda f: f"a - {f} * spread" if rates is BULK else "-1.0"
    return f"""{n}_k AS (SELECT lang, source, r.* FROM {source}, LATERAL (VALUES {each}) AS r(rate, v, qa, qb)),
{n}_b AS (SELECT lang, source, rate, qa, qb, CASE WHEN v <= {RESOLUTION} THEN 0 ELSE CAST(ceil(ln(v / CAST({RESOLUTION} AS DOUBLE)) / ln(CAST({GAMMA!r} AS DOUBLE)) - 1e-9) AS BIGINT) END AS bin FROM {n}_k),
{n}_s AS (SELECT 0 AS level, lang, source, rate, qa, qb, bin FROM {n}_b UNION ALL SELECT 1, lang, NULL, rate, qa, qb, bin FROM {n}_b UNION ALL SELECT 2, NULL, NULL, rate, qa, qb, bin FROM {n}_b),
{n}_n AS (SELECT level, lang, source, rate, qa, qb, bin, count(*) AS n FROM {n}_s GROUP BY ALL),
{n}_q AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY bin) AS seen, sum(n) OVER (PARTITION BY level, lang, source, rate) AS rows FROM {n}_n),
{n}_f AS (SELECT level, lang, source, rate, max(rows) AS rows, min(CASE WHEN seen > CAST(qa AS DOUBLE) * (rows - 1) THEN bin END) AS ba, min(CASE WHEN seen > CAST(qb AS DOUBLE) * (rows - 1) THEN bin END) AS bb FROM {n}_q GROUP BY level, lang, source, rate),
{n}_m AS (SELECT *, {middle('ba')} AS a, {middle('bb')} AS b, 0.0 AS doubt FROM {n}_f),
{n}_l AS (SELECT o.lang, o.rate, {draw('a')}, {draw('b')}, {doubt} FROM {n}_m o JOIN {n}_m p ON o.level = 1 AND p.level = 2 AND o.rate = p.rate),
{n}_g AS (SELECT o.lang, o.source, o.rate, {draw('a')}, {draw('b')}, {doubt} FROM {n}_m o JOIN {n}_l p ON o.level = 0 AND o.lang IS NOT DISTINCT FROM p.lang AND o.rate = p.rate),
{n} AS (SELECT lang, source, rate, {low(FENCE)} AS low, b + {FENCE} * spread AS high, {low(INNER)} AS inner_low, b + {INNER} * spread AS inner_high FROM (SELECT *, {spread} AS spread FROM {n}_g))"""


OP4_SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT row, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT row, unnest([{{'i': i, 'g': w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]}} for i in range(1, len(w) - 1)]) AS g FROM w),
twice AS (SELECT row, g.i AS i FROM g QUALIFY count(*) OVER (PARTITION BY row, g.g.g) > 1),
covered AS (SELECT row, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY row),
c AS (SELECT d.row, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) for x in w]), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS lines, coalesce(n, 0) AS n_repeat_words
  FROM d JOIN w ON d.row = w.row LEFT JOIN covered ON d.row = covered.row),
b AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {", ".join(f"CASE WHEN {w} > 0 THEN {p} / {w} ELSE 0.0 END AS {k}" for k, (p, w) in (BULK | TAIL).items())}
  FROM (SELECT * RENAME (lines AS _lines) FROM c)),
passed AS (SELECT * FROM b WHERE NOT base_failed),
{_limits_sql("bulk", "passed", BULK)},
ref AS MATERIALIZED (SELECT b.* FROM passed b JOIN bulk z ON z.lang IS NOT DISTINCT FROM b.lang AND z.source IS NOT DISTINCT FROM b.source WHERE word_length BETWEEN inner_low AND inner_high),
{_limits_sql("tail", "ref", TAIL)},
far AS (SELECT DISTINCT b.row FROM b JOIN bulk z ON z.lang IS NOT DISTINCT FROM b.lang AND z.source IS NOT DISTINCT FROM b.source WHERE NOT word_length BETWEEN low AND high
  UNION SELECT b.row FROM b JOIN tail z ON z.lang IS NOT DISTINCT FROM b.lang AND z.source IS NOT DISTINCT FROM b.source
  WHERE {" OR ".join(f"rate = '{k}' AND {p} - {SURE} * sqrt({p}) > high * {w}" for k, (p, w) in TAIL.items())})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND far.row IS NULL AS kept FROM b LEFT JOIN far ON b.row = far.row
"""
