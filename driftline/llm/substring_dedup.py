"""Substring deduplication by seed and extend on winnowed anchors.

A window is ``WINDOW`` consecutive words of a document. Each window chooses as its anchor the k-gram of
words with the least hash in it (winnowing), so equal windows, wherever they stand, have equal anchors.
Consecutive windows with one anchor form a run: the anchor extended both ways as far as its windows reach.

1. *Seeds.* Every run becomes a narrow row (anchor, digest of the run's words, document, start). Rows meet
   by anchor. Runs of one digest are wholly equal: all but the earliest are repeats as a whole. Most of
   any long repeat is settled here, with one row for about eight words.
2. *Extension.* Of an anchor with runs of several digests, the earliest run of each digest is extended
   from the anchor word by word over its own text: each of its windows becomes a row, and of equal windows
   all but the earliest are repeats. Only these few windows are listed singly: the ends of repeats.
3. The windows found, neighbouring ones merged to maximal repeats, are removed from the texts.

Skew: within a batch of documents a task keeps, of equal runs, only the earliest in the shuffle and passes
the others on as repeats with keys dealt evenly. So a passage that a third of all documents share costs
each batch one row per anchor. The reducing side is a stream over sorted rows that remembers one row.

Digests have 128 bits (anchor and run, or two window hashes), so words are compared by digests. Pairs of runs are
not listed: of a frequent anchor that stands in many contexts they would be as many as its square.

Documents are ordered by doc_id, a null one last, and told apart by (doc_id, 64 bits of a hash of the text) with
a seed for which no two different texts of one doc_id agree in it. Defined results: a null text has no words;
its digest is that of the empty text. Rows that repeat one doc_id are one document: at equal starts neither
is earlier, so identical rows get identical results, and are worked off once in a batch. Texts with fewer words
than a window are kept whole. Very long texts are worked off whole, in the memory of one batch. An empty table
gives an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import table, text_of, written

#: Words of a window, the least length of a repeat.
WINDOW = 20
#: Words of an anchor.
K = 6
#: Characters of text that are worked off together, about.
CHUNK = 4_000_000
#: Stands for a null doc_id, after all others.
LAST = (1 << 63) - 1

_WORDS = re.compile("[^ \t-\r]+").findall
_BASE = np.array([0x9E3779B97F4A7C15, 0xD1B54A32D192ED03], np.uint64)  # odd, so they have inverses
_INVERSE = np.array([pow(int(b), -1, 1 << 64) for b in _BASE], np.uint64)
# A run row's last field: start << 8 | flag << 7 | windows - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


class Flat:
    """The words of some texts in one array, with hashes of any stretch of them."""

    def __init__(self, texts: list[str]):
        from xxhash import xxh64_intdigest

        words = [_WORDS(t) for t in texts]
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        n = int(self.sizes.sum())
        self.word = np.fromiter((xxh64_intdigest(w) for ws in words for w in ws), np.uint64, n)
        self.text = np.repeat(np.arange(len(texts)), self.sizes)
        self.sums = []
        for base, inverse in zip(_BASE, _INVERSE, strict=True):
            up, down = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, b, np.uint64)]) for b in (base, inverse))
            self.sums.append((np.r_[np.uint64(0), np.cumsum(self.word * up[:n], dtype=np.uint64)], down))

    def stretch(self, first: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        sums, down = self.sums[which]
        return _mix((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64))

    def windows(self, window: int = WINDOW) -> np.ndarray:
        """Starts of all windows."""
        last = len(self.word) - window + 1
        return np.flatnonzero(self.text[:last] == self.text[window - 1 :]) if last > 0 else np.zeros(0, np.int64)


def runs(flat: Flat, window: int = WINDOW, k: int = K) -> tuple[np.ndarray, ...]:
    """First window, number of windows, anchor hash and digest of every run."""
    starts = flat.windows(window)
    if not len(starts):
        return starts, starts, starts.astype(np.uint64), starts.astype(np.uint64)
    grams = len(flat.word) - k + 1
    gram = flat.stretch(np.arange(grams), np.arange(k, grams + k))
    span, best, have = window - k + 1, np.arange(grams), 1

    def less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(gram[b] < gram[a], b, a)

    while 2 * have <= span:  # places of minima over twice as many grams
        best, have = less(best[:-have], best[have:]), 2 * have
    best = less(best[: grams - span + 1], best[span - have : span - have + grams - span + 1])
    anchor = best[starts]
    cut = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (np.diff(starts) != 1)])
    first, count = starts[cut], np.diff(np.r_[cut, len(starts)])
    digest = flat.stretch(first, first + count + window - 1) ^ _mix((anchor[cut] - first).astype(np.uint64))
    return first, count, gram[anchor[cut]], digest


def _combined(key: np.ndarray, digest: np.ndarray, doc: np.ndarray, text: np.ndarray, pack: np.ndarray) -> pa.RecordBatch:
    """Rows for the shuffle: of equal runs all but the earliest are flagged as repeats and dealt evenly."""
    order = np.lexsort((text, pack, doc, digest, key))
    key, digest, doc, text, pack = key[order], digest[order], doc[order], text[order], pack[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    later = (doc != doc[lead]) | (pack >> 8 != pack[lead] >> 8)
    again = np.r_[False, ~new[1:] & (doc[1:] == doc[:-1]) & (text[1:] == text[:-1]) & (pack[1:] == pack[:-1])]  # the same row once more
    key = np.where(later, _mix(doc.astype(np.uint64) ^ pack.astype(np.uint64)), key)
    pack = np.where(later, pack | 128, pack)
    columns = [x[~again].view(np.int64) for x in (key, digest, doc, text, pack)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "digest", "doc", "hash", "pack"])


_ROW = "key long, digest long, doc long, hash long, pack long"


def _chunks(columns: list[list], texts: int) -> Iterator[list[list]]:
    start, n = 0, len(columns[texts])
    while start < n:
        stop, size = start, 0
        while stop < n and size < CHUNK:
            size += len(columns[texts][stop])
            stop += 1
        yield [c[start:stop] for c in columns]
        start = stop


def seed_rows(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """One row per run of ``docs(doc, hash, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, hashed, texts in _chunks([c.to_pylist() for c in batch.columns], 2):
                flat = Flat(texts)
                first, count, anchor, digest = runs(flat, window, k)
                t = flat.text[first]
                pack = (first - flat.starts[t]) << 8 | (count - 1)
                yield _combined(anchor, digest, np.array(doc, np.int64)[t], np.array(hashed, np.int64)[t], pack)

    return docs.mapInArrow(run, _ROW)


def window_rows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per window of the runs ``packs`` of ``docs(doc, hash, text, packs)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, hashed, texts, packs in _chunks([c.to_pylist() for c in batch.columns], 2):
                flat = Flat(texts)
                pack = np.array([p for ps in packs for p in ps], np.int64)
                t = np.repeat(np.arange(len(packs)), [len(ps) for ps in packs])
                count = (pack & 127) + 1
                at = np.repeat(pack >> 8, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                t = np.repeat(t, count)
                place = flat.starts[t] + at
                yield _combined(flat.stretch(place, place + window, 0), flat.stretch(place, place + window, 1), np.array(doc, np.int64)[t], np.array(hashed, np.int64)[t], at << 8)

    return docs.mapInArrow(run, _ROW)


def settle(rows: DataFrame) -> DataFrame:
    """``doc``, ``hash``, ``pack``, ``repeat``: repeats (true), and earliest runs of anchors with several digests (false)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 5  # the earliest run of the last digest, with ties
        told = False  # it has been given out
        for batch in batches:
            if not batch.num_rows:
                continue
            key, digest, doc, text, pack = (np.r_[a, c.to_numpy(zero_copy_only=False)] for a, c in zip(held, batch.columns, strict=True))
            passed = (pack & 128) > 0  # flagged by the map side
            new = np.r_[True, (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])] | passed
            new[1:] |= passed[:-1]
            lead = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            later = passed | (doc != doc[lead]) | (pack >> 8 != pack[lead] >> 8)
            group = np.cumsum(new) - 1
            heads = np.flatnonzero(new)
            alike = (key[heads][1:] == key[heads][:-1]) & ~passed[heads][1:] & ~passed[heads][:-1]
            several = np.r_[False, alike] | np.r_[alike, False]
            # the earliest run of each digest, and others that start there in rows of the same doc_id
            given = several[group] & ~passed & ~later
            if told:
                given[: len(held[0])] = False
            ahead = np.flatnonzero(given)
            whole = np.flatnonzero(later)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[doc[whole], doc[ahead]]), pa.array(np.r_[text[whole], text[ahead]]), pa.array(np.r_[pack[whole], pack[ahead]]), pa.array(np.r_[np.ones(len(whole), bool), np.zeros(len(ahead), bool)])], ["doc", "hash", "pack", "repeat"])
            end = heads[-1]
            told = bool(several[-1]) or (end == 0 and told)
            first = end + np.flatnonzero(~later[end:])
            held = [x[first] for x in (key, digest, doc, text, pack)]
            if passed[end]:
                held, told = [np.zeros(0, np.int64)] * 5, False

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "key").sortWithinPartitions("key", "digest", "doc", "pack", "hash")
    return rows.mapInArrow(run, "doc long, hash long, pack long, repeat boolean")


def keyed(docs: DataFrame, bits: int = 64) -> DataFrame:
    """``doc``, ``hash``, ``text``: the hash tells different texts of one doc_id apart; fewer bits only to provoke collisions in tests."""
    text, doc = text_of(), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    for seed in range(64):
        out = docs.select(doc.alias("doc"), F.shiftrightunsigned(F.xxhash64(F.lit(seed), text), 64 - bits).alias("hash"), text.alias("text"))
        # a second hash shows where two texts agree in the first
        alike = out.select("doc", "hash", F.crc32("text").alias("other"), F.length("text").alias("n")).groupBy("doc", "hash").agg(F.min(F.struct("other", "n")).alias("a"), F.max(F.struct("other", "n")).alias("b"))
        if alike.filter("a <> b").isEmpty():
            return out
    raise ValueError("texts of one doc_id have equal hashes with every seed")


def _by_document(found: DataFrame) -> DataFrame:
    """The packs of each document in one row: as many as it has runs, or single windows where runs part."""
    return found.groupBy("doc", "hash").agg(F.collect_list("pack").alias("packs"))


def repeats(rows: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """``doc``, ``hash``, ``packs``: the repeated windows of each document of ``rows(doc, hash, text)`` that has any, as stretches of starts."""
    seeds = written(settle(seed_rows(rows, window, k)), "substring-seeds")
    ends = rows.join(_by_document(seeds.filter("not repeat")), ["doc", "hash"]).select("doc", "hash", "text", "packs")
    singles = written(settle(window_rows(ends, window)).filter("repeat"), "substring-windows")
    return _by_document(seeds.filter("repeat").drop("repeat").union(singles.drop("repeat")))


def removed_mask(n: int, packs: list[int], window: int = WINDOW) -> np.ndarray:
    """Which of ``n`` words the repeated windows cover."""
    pack = np.array(packs, np.int64)
    first = pack >> 8
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + (pack & 127) + window, -1)
    return np.cumsum(change[:n]) > 0


def substring_dedup(docs: DataFrame, window: int = WINDOW, k: int = K, bits: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every document, and ``kept_text``: its kept words joined by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, packs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = _WORDS(text)
                gone = 0
                kept = words
                if packs:
                    mask = removed_mask(len(words), packs, window)
                    gone = int(mask.sum())
                    kept = [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
                line = " ".join(kept)
                out.append((len(words), gone, hashlib.sha256(line.encode("utf-8", "replace")).hexdigest(), line))
            doc = batch.column(0)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pc.if_else(pc.equal(doc, LAST), pa.scalar(None, pa.int64()), doc), *columns], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    rows = keyed(docs, bits)
    return rows.join(repeats(rows, window, k), ["doc", "hash"], "left").select("doc", "text", "packs").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP8_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(doc_id, 9223372036854775807) AS doc, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT row, doc, unnest([{'i': i, 'g': array_to_string(list_slice(w, i, i + 19), ' ')} for i in range(1, len(w) - 18)]) AS g FROM d),
f AS (SELECT row, doc, g.i AS i, first_value(doc) OVER o AS first_doc, first_value(g.i) OVER o AS first_i FROM g WINDOW o AS (PARTITION BY g.g.g ORDER BY doc, g.i)),
gone AS (SELECT DISTINCT row, i + j AS i FROM f, (SELECT unnest(range(0, 20)) AS j) WHERE doc > first_doc OR i > first_i),
p AS (SELECT row, unnest([{'i': i, 'w': w[i]} for i in range(1, len(w) + 1)]) AS p FROM d),
k AS (SELECT p.row, count(gone.i) AS n, coalesce(string_agg(CASE WHEN gone.i IS NULL THEN p.p.w END, ' ' ORDER BY p.p.i), '') AS kept FROM p LEFT JOIN gone ON p.row = gone.row AND p.p.i = gone.i GROUP BY p.row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.row = k.row
"""
