"""One large one-dimensional series, smoothed by a distributed interpolation surface.

Rows get their rank from range partitions and the sizes of these, without a window over all rows. The
cells of a series with distinct x depend on row counts alone, so the driver derives the ranks of their
borders; how many there are follows from the span and the cell size, not from the number of rows. The q
nearest of a vertex are a stretch of ranks: its start is found by an aggregate over rows joined to the row
q ranks on. A vertex is then fitted from sums over its stretch, which combine before the shuffle, and all
rows are blended by column expressions from the broadcast table of cells. A reweighting pass shuffles
nothing but these sums: fitted values and weights are expressions over the rows, written once per pass.
Medians are exact, by narrowing a range of values until few are left.
"""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline import errors as E
from driftline.config import SmootherConfig
from driftline.functions import columns as C
from driftline.operators.numeric import solve, span
from driftline.sources.intermediate import stored

#: Values that the last step of an exact selection brings to the driver at most.
FEW = 50_000


def cut_ranks(n: int, most: int) -> list[int]:
    """Ranks (from 0) at which the cells of ``n`` distinct sorted points are cut, first come first split."""
    out, queue = [], deque([(0, n - 1)])
    while queue:
        low, high = queue.popleft()
        if high - low + 1 <= most:
            continue
        middle = (low + high) // 2
        out.append(middle)
        queue += [(low, middle), (middle + 1, high)]
    return sorted(set(out))


def ranked_rows(df: DataFrame, x: str, y: str) -> DataFrame:
    """``_x``, ``_y`` and the rank ``_r`` from 0: place in a sorted range partition plus the sizes of those before."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).repartitionByRange(parts, "_x").sortWithinPartitions("_x")
    rows = stored(rows.withColumn("_at", F.monotonically_increasing_id()), "surface-rows")
    part = F.shiftright("_at", 33)
    starts, total = [], 0
    for p, n in rows.groupBy(part.alias("_p")).count().orderBy("_p").collect():  # one row per partition
        starts.append((p, total))
        total += n
    offset = spark.createDataFrame(starts, "_p long, _start long")
    rows = rows.withColumn("_p", part).join(F.broadcast(offset), "_p")
    return rows.select("_x", "_y", (F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias("_r"))


def exact_order_statistics(df: DataFrame, value: Column, ranks: list[int]) -> list[float]:
    """The values at ``ranks`` (from 0) of the sorted column, exactly.

    A mergeable sketch narrows the range that holds the ranks; once few values are in it they are sorted on
    the driver. Each round is one aggregate over all rows.
    """
    rows = df.select(value.alias("v"))
    low, high, below = -float("inf"), float("inf"), 0
    inside = rows.count()
    while inside > FEW:
        at = [(min(ranks) - below) / inside, (max(ranks) - below) / inside]
        share = [max(0.0, at[0] - 0.001), min(1.0, at[1] + 0.001)]
        part = rows.filter((F.col("v") >= low) & (F.col("v") <= high))
        a, b = part.agg(F.percentile_approx("v", share, 10_000)).first()[0]
        less, within = rows.agg(F.count_if(F.col("v") < a), F.count_if((F.col("v") >= a) & (F.col("v") <= b))).first()
        if not less <= min(ranks) <= max(ranks) < less + within or within == inside:
            a, b, less, within = low, high, below, inside  # cannot be narrowed: ties
        if a == b:
            return [a] * len(ranks)
        if within == inside:
            counts = part.groupBy("v").count().orderBy("v").toLocalIterator()
            out, seen = {}, below
            for v, n in counts:
                out |= {k: v for k in ranks if seen <= k < seen + n}
                seen += n
                if len(out) == len(set(ranks)):
                    break
            return [out[k] for k in ranks]
        low, high, below, inside = a, b, less, within
    values = sorted(r[0] for r in rows.filter((F.col("v") >= low) & (F.col("v") <= high)).collect())
    return [values[k - below] for k in ranks]


def exact_median(df: DataFrame, value: Column, n: int) -> float:
    a, b = exact_order_statistics(df, value, [(n - 1) // 2, n // 2])
    return (a + b) / 2


def _scale(fit: DataFrame, residual: Column, n: int, method: str) -> float:
    """The guarded scale of all absolute residuals."""
    mean = fit.agg(F.avg(residual)).first()[0]
    if mean == 0:
        return 0.0
    middle = exact_median(fit, residual, n)
    s = exact_median(fit, F.abs(residual - F.lit(middle)), n) if method == "mad" else middle
    return max(mean, s) if s <= max(1e-7 * mean, 1e-12) else s


class _Vertices:
    """Vertices of the surface with the stretches of ranks they are fitted from."""

    def __init__(self, padded: DataFrame, c: SmootherConfig, total: int, q: int, low: float, high: float):
        spark = padded.sparkSession
        self.c, self.q, self.low, self.high = c, q, low, high
        cuts = cut_ranks(total, max(1, int(total * (c.cell or 0.2) * c.fraction)))
        value = {r["_r"]: r["_x"] for r in padded.filter(F.col("_r").isin(cuts)).select("_r", "_x").collect()} if cuts else {}
        margin = 0.005 * (high - low)
        self.at = [low - margin, *(value[r] for r in cuts), high + margin]
        self.ranks = [0, *cuts, total - 1]
        # a stretch that starts at l is right once its start is no farther than the row after its end
        last = total - q
        ask = spark.createDataFrame([(i, v, max(0, r - q), min(last, r)) for i, (v, r) in enumerate(zip(self.at, self.ranks, strict=True))], "_v int, _at double, _low long, _high long")
        pair = padded.select("_r", "_x").join(padded.select((F.col("_r") - q).alias("_r"), F.col("_x").alias("_after")), "_r")
        found = self._near(pair, ask).filter((F.col("_at") - F.col("_x")) <= (F.col("_after") - F.col("_at"))).groupBy("_v").agg(F.min("_r"))
        start = {v: s for v, s in found.collect()}  # one row per vertex
        self.start = [start.get(i, last) for i in range(len(self.at))]
        ends = {r["_r"]: r["_x"] for r in padded.filter(F.col("_r").isin([r for s in self.start for r in (s, s + q - 1)])).select("_r", "_x").collect()}
        reach = [max(v - ends[s], ends[s + q - 1] - v) for v, s in zip(self.at, self.start, strict=True)]
        self.table = spark.createDataFrame([(i, v, s, s + q - 1, float(h)) for i, (v, s, h) in enumerate(zip(self.at, self.start, reach, strict=True))], "_v int, _at double, _low long, _high long, _h double")

    def _near(self, rows: DataFrame, spots: DataFrame) -> DataFrame:
        """Rows with the vertices whose range of ranks they are in, by buckets of ranks."""
        width = max(self.q, 1)
        spots = spots.withColumn("_b", F.explode(F.expr(f"sequence(_low div {width}, _high div {width})")))
        return rows.withColumn("_b", F.expr(f"_r div {width}")).join(F.broadcast(spots), "_b").filter("_r between _low and _high").drop("_b")

    def fit(self, padded: DataFrame) -> np.ndarray:
        """Value and slope at every vertex under the weights ``_rw`` of the rows."""
        c, deg = self.c, self.c.degree
        dx = F.col("_x") - F.col("_at")
        w = C.kernel(c.weight_function, F.abs(dx) / F.when(F.col("_h") > 2.220446049250313e-16, F.col("_h")).otherwise(1.0)) * F.col("_rw")
        near = self._near(padded, self.table).withColumn("_w", w).withColumn("_d", dx)
        power = lambda e: F.pow(F.col("_d"), F.lit(e)) if e else F.lit(1.0)
        sums = near.groupBy("_v").agg(*(F.sum(F.col("_w") * power(e)).alias(f"s{e}") for e in range(2 * deg + 1)), *(F.sum(F.col("_w") * power(e) * F.col("_y")).alias(f"t{e}") for e in range(deg + 1)), F.avg("_y").alias("plain"))
        got = sums.toPandas().sort_values("_v")  # one row per vertex
        out = np.zeros((len(got), 2))
        edge = np.array([deg > 1 and c.boundary_degree_fallback and (v < self.low or v > self.high) for v in self.at])
        for d, use in ((deg, ~edge), (min(1, deg), edge)):
            if not use.any():
                continue
            g = got[use]
            if d == 0:
                s0 = g["s0"].to_numpy()
                out[use, 0] = np.where(s0 > 2.2e-16, g["t0"] / np.where(s0 > 2.2e-16, s0, 1), g["plain"])
                continue
            normal = np.stack([np.stack([g[f"s{i + j}"].to_numpy() for j in range(d + 1)], axis=1) for i in range(d + 1)], axis=1)
            beta, _ = solve(normal, np.stack([g[f"t{i}"].to_numpy() for i in range(d + 1)], axis=1))
            out[use] = beta[:, :2]
        return out

    def blend(self, rows: DataFrame, data: np.ndarray, k: int) -> DataFrame:
        """``rows`` with ``_fit``; ``k`` is the number of padded rows before the first."""
        cells = [(i, self.at[i], self.at[i + 1], *map(float, (*data[i], *data[i + 1])), (self.ranks[i] + 1 if i else 0), self.ranks[i + 1]) for i in range(len(self.at) - 1)]
        table = rows.sparkSession.createDataFrame(cells, "_cell int, _lo double, _hi double, _v0 double, _g0 double, _v1 double, _g1 double, _low long, _high long")
        out = self._near(rows.withColumn("_r", F.col("_r") + k), table)
        return out.select(*(F.col(n) if n != "_r" else (F.col("_r") - k).alias("_r") for n in rows.columns), C.hermite("_x", "_lo", "_hi", "_v0", "_v1", "_g0", "_g1").alias("_fit"))


def fit_surface(df: DataFrame, x: str, y: str, c: SmootherConfig) -> DataFrame:
    """x, y, y_smooth and rob_weight of one series with distinct x, any length, degree 0 to 2."""
    if c.dimensions != 1 or c.surface_mode != "interpolation" or c.degree > 2 or c.boundary_policy not in ("extend", "none"):
        raise E.UnsupportedFeature("the distributed surface takes one dimension, degree 0 to 2 and extended or no boundaries")
    spark = df.sparkSession
    rows = stored(ranked_rows(df, x, y), "surface-ranks")
    n = rows.count()
    if n < 2:
        raise E.TooFewPoints(f"{n} points, at least 2 are needed")
    q = span(n, c.fraction)
    k = min(q // 2, n - 1) if c.boundary_policy == "extend" else 0
    ends = {r["_r"]: (r["_x"], r["_y"]) for r in rows.filter(F.col("_r").isin(0, 1, n - 2, n - 1)).collect()}
    first, last = ends[0], ends[n - 1]
    steps = (ends[1][0] - first[0], last[0] - ends[n - 2][0])

    def padded(own: DataFrame, weights: tuple[float, float]) -> DataFrame:
        """All rows by padded rank, the artificial ones with the weights of the ends."""
        own = own.select("_x", "_y", (F.col("_r") + k).alias("_r"), "_rw")
        i = spark.range(1, k + 1)
        head = i.select((F.lit(first[0]) - F.col("id") * steps[0]).alias("_x"), F.lit(first[1]).alias("_y"), (k - F.col("id")).alias("_r"), F.lit(weights[0]).alias("_rw"))
        tail = i.select((F.lit(last[0]) + F.col("id") * steps[1]).alias("_x"), F.lit(last[1]).alias("_y"), (F.col("id") + (n - 1 + k)).alias("_r"), F.lit(weights[1]).alias("_rw"))
        return own.union(head).union(tail) if k else own

    plain = rows.withColumn("_rw", F.lit(1.0))
    vertices = _Vertices(padded(plain, (1.0, 1.0)), c, n + 2 * k, q, first[0] - k * steps[0], last[0] + k * steps[1])
    fit = stored(vertices.blend(plain, vertices.fit(padded(plain, (1.0, 1.0))), k), "surface-fit")
    for _ in range(1, c.iterations):
        residual = F.abs(F.col("_y") - F.col("_fit"))
        scale = _scale(fit, residual, n, c.scaling_method)
        new = C.robustness_weight(c.robustness_method, residual, F.lit(scale))
        change = fit.agg(F.max(F.abs(new - F.col("_rw")))).first()[0]
        again = fit.select("_x", "_y", "_r", new.alias("_rw"), "_fit")
        if change < (c.auto_converge or 1e-6):
            fit = again
            break
        own = again.drop("_fit")
        at_ends = {r["_r"]: r["_rw"] for r in own.filter(F.col("_r").isin(0, n - 1)).collect()}
        fit = stored(vertices.blend(own, vertices.fit(padded(own, (at_ends[0], at_ends[n - 1]))), k), "surface-fit")
    return fit.select(F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("_fit").alias("y_smooth"), F.col("_rw").alias("rob_weight"))
