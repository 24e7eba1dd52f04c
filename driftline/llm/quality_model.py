"""Quality classifier by Bradley-Terry pairwise ranking.

Documents get a strength, a linear function of features of their text. Pairs of a good and a bad labelled
document are preferences; the weights minimise the logistic loss on the feature differences, with a ridge
term, by Newton steps. The strength becomes a score from 0 to 1 that is ``CUT`` at a quantile of the strengths
of all documents: the share of bad ones among the labelled documents that may be learnt from. That share is
known up to two standard errors, and within them the widest gap of the strengths is taken, as no document
stands there. The strengths are counted in a histogram, which merges exactly and has a bounded number of bins.

The weights use a bounded sample, ``SAMPLE`` labelled documents of each class at most, the first by a hash of the
id, one text of each id; the cut and the scores cover every whole text of all documents. Texts are read once.

Defined results: a null text is the empty text, and empty texts are scored by their features like any
other; very long texts are scored whole. A null ``doc_id`` is not held out and has no labels. Repeated rows get equal scores. Labels that
are null are not used; an id with both labels counts for both, and of several texts of one id the first in
order is learnt from. Ties: a strength at the cut itself is good. Without labels of both classes all weights are 0 and all scores 0.5.
An empty table gives an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import table, written

#: Labelled rows of each class that the fit reads at most, pairs per bad document, ridge term.
SAMPLE = 6000
PAIRS = 24
RIDGE = 1e-3
#: Fixed value: documents with this score or more are predicted good.
CUT = 0.3
FOLDS = 5
#: Bins of strength in half a standard deviation, and how far they reach, in the same unit.
BINS = 64
REACH = 60

FEATURES = ("log_words", "word_length", "long_words", "distinct", "top_word", "distinct_3", "upper", "digits", "symbols", "exclaim", "stops", "commas", "other_punct", "lines", "dup_lines", "non_ascii", "empty")

_WORDS = re.compile("[^ \t-\r]+").findall
_CLASS = np.zeros(256, np.int8)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!", b".?", b",;:", b"()[]{}\"'/\\=+-_@^~`", b"\n"), 1):
    _CLASS[list(_chars)] = _k
_CLASS[128:192] = 10  # bytes that continue a character
_CLASS[192:] = 9


def features(text: str | None) -> list[float]:
    """The features of one whole text, in the order of FEATURES."""
    words = _WORDS(text or "")
    n = len(words)
    if not n:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    kinds = np.bincount(_CLASS[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)], minlength=11)
    lengths = np.fromiter(map(len, words), np.int64, n)
    chars = int(lengths.sum())
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    threes = len(set(zip(words, words[1:], words[2:]))) / (n - 2) if n > 2 else 1.0
    upper, digits, symbols, exclaim, stops, commas, punct, _, foreign = kinds[1:10] / chars
    return [np.log1p(n), chars / n, float((lengths > 12).mean()), len(counts) / n, max(counts.values()) / n, threes, upper, digits, symbols, exclaim, stops, commas, punct, len(lines) / n, 1 - len(set(lines)) / max(len(lines), 1), foreign, 0.0]


def feature_table(texts: Iterable[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


def expand(x: np.ndarray) -> np.ndarray:
    """Features and their squares: a rate may be bad at either end."""
    return np.concatenate([x, x * x], axis=1)


def fit(good: np.ndarray, bad: np.ndarray, seed: int = 5) -> dict[str, np.ndarray | float]:
    """Weights from preference pairs, each bad document against ``PAIRS`` good ones."""
    width = 2 * len(FEATURES)
    if not len(good) or not len(bad):
        return {"mean": np.zeros(len(FEATURES)), "scale": np.ones(len(FEATURES)), "weights": np.zeros(width), "cut": 0.0, "unit": 1.0, "base": 0.0}
    both = np.concatenate([good, bad])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-9
    rest = lambda x: expand(np.clip((x - mean) / scale, -6, 6))
    g, b = rest(good), rest(bad)
    rng = np.random.default_rng(seed)
    diff = g[rng.integers(0, len(g), len(b) * PAIRS)] - np.repeat(b, PAIRS, axis=0)
    w = np.zeros(width)
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))  # chance that the pair is the other way round
        slope = diff.T @ p / len(diff) - RIDGE * w
        curve = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + RIDGE * np.eye(width)
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    spread = np.std(np.r_[g @ w, b @ w])
    return {"mean": mean, "scale": scale, "weights": w, "unit": float(max(spread, 1e-6) / 2), "base": float(np.log(CUT / (1 - CUT)))}


def strength(model: dict, x: np.ndarray) -> np.ndarray:
    """Strengths of feature rows."""
    return expand(np.clip((x - model["mean"]) / model["scale"], -6, 6)) @ model["weights"]


def score(model: dict, x: np.ndarray) -> np.ndarray:
    """Scores of feature rows under a model with its cut; a strength at the cut scores CUT."""
    return 1 / (1 + np.exp(-np.clip((strength(model, x) - model["cut"]) / model["unit"] + model["base"], -40, 40)))


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The model from labelled documents that are not held out."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out()).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_quality")).distinct()
    first = [known.filter(F.col("_quality") == k).orderBy(F.xxhash64("_id"), "_id").limit(sample) for k in (0, 1)]
    chosen = first[0].union(first[1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["_id"].astype(str), "quality": pdf["_quality"], "x": list(feature_table(pdf["text"]))})

    # 2 * sample rows at most, so the broadcast is bounded, and with one text for each id what is collected
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).groupBy("_id", "_quality").agg(F.min("text").alias("text"))
    got = rows.mapInPandas(run, "id string, quality int, x array<double>").toPandas().sort_values(["id", "quality"], kind="stable")
    x = np.array(got["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    quality = got["quality"].to_numpy()
    number = {r["_quality"]: r["count"] for r in known.groupBy("_quality").count().collect()}
    labelled = sum(number.values())
    return fit(x[quality == 1], x[quality == 0]) | {"share": number.get(0, 0) / max(labelled, 1), "labelled": labelled}


def cut_of(counts: dict[int, int], share: float, labelled: int) -> float:
    """Place of the cut, in bins: the widest gap of the histogram ``counts`` where ``share`` of it, give or take two errors, lies below.

    Of equally wide gaps the one nearest to ``share`` is taken.
    """
    bins, total = sorted(counts), sum(counts.values())
    if not bins:
        return 0.0
    reach = 2 * (share * (1 - share) / max(labelled, 1)) ** 0.5
    below, edges = 0, []  # (outside, bins without a strength, distance, place) of each edge between bins
    for k, at in enumerate([*bins, bins[-1] + 2]):
        lower = bins[k - 1] + 1 if k else at - 1
        off = abs(below / total - share)
        edges.append((max(off - reach, 0.0), lower - at, off, (lower + at) / 2))
        below += counts.get(at, 0)
    return min(edges)[3]


def with_cut(model: dict, strong: DataFrame) -> dict:
    """``model`` with its cut, from the column ``strength`` of all documents."""
    if "cut" in model:
        return model
    at = F.floor(F.greatest(F.lit(-REACH), F.least(F.lit(REACH), F.col("strength") / model["unit"])) * BINS)
    counts = {int(r["at"]): r["count"] for r in strong.groupBy(at.alias("at")).count().collect()}  # 2 * REACH * BINS + 1 at most
    return model | {"cut": cut_of(counts, model["share"], model["labelled"]) / BINS * model["unit"]}


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; a model without a cut gets that of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = strength(model, feature_table(batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], ["doc_id", "held_out", "strength"])

    rows = docs.select("doc_id", held_out().alias("_held"), "text")
    strong = written(rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, strength double"), "quality-strengths")
    whole = with_cut(model, strong)
    odds = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), (F.col("strength") - whole["cut"]) / whole["unit"] + whole["base"]))
    return strong.select("doc_id", "held_out", (1 / (1 + F.exp(-odds))).alias("score"), _good(whole).cast("int").alias("predicted"))


def _good(model: dict) -> Column:
    """Whether the score is CUT or more: the strength is not below the cut."""
    return 1 / (1 + F.exp(-((F.col("strength") - model["cut"]) / model["unit"] + model["base"]))) >= CUT


def good_documents(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs`` that the model accepts, with all their columns; without a join or a second look at the texts.

    The documents are written once with their strengths, as the cut of a model without one needs all of them. Nulls, empty and
    very long texts, repeated rows and empty tables as above; columns pass unchanged, whatever their names.
    """

    @F.pandas_udf("double")
    def rate(text: pd.Series) -> pd.Series:
        return pd.Series(strength(model, feature_table(text)))

    strong = written(docs.select(rate(F.col("text")).alias("strength"), F.struct("*").alias("_doc")), "quality-docs")
    return strong.filter(_good(with_cut(model, strong))).select("_doc.*")


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))
