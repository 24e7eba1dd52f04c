"""SimHash near-deduplication by a Gray-order hierarchical index.

Fingerprints are made once per document; from then on only distinct ones are handled. Two fingerprints
with at most 4 differing bits agree in at least one of five bit blocks (pigeonhole), so each is entered
under its 5 blocks. An entry with more than ``SPLIT`` fingerprints is entered once more under five blocks of
the bits that it does not share, by the same argument; one that is still as large (a family of near copies,
of which no block tells many apart) is cut into parts by hash, and every pair of parts is searched by itself.
So no task holds more than two parts of an entry, and no link is lost.

A task sorts all its fingerprints by entry and Gray rank, in which neighbours differ in few bits, and lays
one hierarchical index over the whole order: a node of the lowest level stands for 16 fingerprints, a higher
one for 16 nodes. A node keeps the bits that all below it share and its parent does not, as a mask and a
pattern, so a search adds up differences on its way down and leaves a node, with the whole group below it,
when they exceed the radius. It starts from the few nodes that cover the entry of the fingerprint.

Links are not listed as pairs: fingerprints are searched from in waves, what they find is united, and a node
whose fingerprints all are in the group of the one searched from is left, too. Each member of a group
gives one link, so n fingerprints of one entry give at most n - 1 links. Groups of all entries are joined
by distributed connected components.

Defined results: a null or blank text has fingerprint zero and is linked like any other. A null ``doc_id``
takes part; a component's id is its smallest non-null id (null if it has none). Repeated rows have equal
fingerprints and so one component. Very long texts are hashed whole, in one row's memory. Ties do not arise:
a link needs no order. An empty table gives an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import WORD, identified, table, written
from driftline.llm.components import components

#: Fixed values of the fingerprint: words per shingle, seed of the hash, bits in which linked ones may differ.
SHINGLE = 4
HASH_SEED = 42
RADIUS = 4
#: Bit blocks (first bit, bits); any two linked fingerprints agree in one of them.
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
#: Children of an index node.
FANOUT = 16
#: Fingerprints of one entry that are searched together; above, an entry is split.
SPLIT = 8192
#: Pairs of a fingerprint and a node that are looked at together, about.
WAVE = 500_000

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORDS = re.compile(WORD.replace(r"\x20\x09-\x0D", " \t-\r")).findall


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = _WORDS((text or "").translate(_LOWER))
    if not words:
        return 0
    line = " ".join(words).encode("utf-8", "replace")
    if len(words) <= shingle:
        return xxh64_intdigest(line, HASH_SEED)
    starts = np.flatnonzero(np.frombuffer(b" " + line, np.uint8) == 32).tolist()
    ends = [*starts[shingle:], len(line) + 1]
    hashes = np.array([xxh64_intdigest(line[a : b - 1], HASH_SEED) for a, b in zip(starts, ends, strict=False)], "<u8")
    sums = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        sums += np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``fp``, the fingerprint as a signed long, and columns ``carried`` along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch.column(0).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), *batch.columns[1:]], ["fp", "doc_id", *carried])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *carried))
    return docs.select("text", "doc_id", *carried).mapInArrow(run, f"fp long, {kinds}")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray order."""
    rank = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


class GrayIndex:
    """Fingerprints in the order of entry and Gray rank under levels of nodes with shared bit patterns."""

    def __init__(self, entry: np.ndarray, fp: np.ndarray, fanout: int = FANOUT):
        order = np.lexsort((gray_rank(fp), entry))
        self.entry, self.fp, self.order, self.fanout = entry[order], fp[order], order, fanout
        self.group = np.arange(len(fp))  # the first place of the group that a fingerprint is known to be in
        starts = np.flatnonzero(np.r_[True, self.entry[1:] != self.entry[:-1]]) if len(fp) else self.group
        sizes = np.diff(np.r_[starts, len(fp)])
        self.first, self.last = np.repeat(starts, sizes), np.repeat(starts + sizes - 1, sizes)
        # from the lowest: pattern and mask of the bits that all below share
        ones, zeros, shared = self.fp, ~self.fp, []
        while len(ones) > 1:
            cuts = np.arange(0, len(ones), fanout)
            ones, zeros = np.bitwise_and.reduceat(ones, cuts), np.bitwise_and.reduceat(zeros, cuts)
            shared.append((ones, ones | zeros))
        # a level tests the bits that the level above does not: fingerprints themselves are the level 0
        masks = [np.full(len(self.fp), ~np.uint64(0)), *(m for _, m in shared)]
        self.patterns = [self.fp, *(p for p, _ in shared)]
        self.whole = masks
        self.rest = [m & ~np.repeat(masks[k + 1], fanout)[: len(m)] if k + 1 < len(masks) else m for k, m in enumerate(masks)]
        self.tested = 0  # nodes and fingerprints compared so far

    def _only_group(self, first: int, end: int, levels: int) -> list[np.ndarray]:
        """For levels from 1 on the group that all fingerprints of a node share, else -1; the first node begins at ``first``."""
        low = high = self.group[first:end]
        out = []
        for _ in range(levels):
            cuts = np.arange(0, len(low), self.fanout)
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            out.append(np.where(low == high, low, -1))
        return out

    def later(self, places: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of ``places`` and later places of their entries within ``radius``, but for those known to be of one group.

        ``places`` ascend; their entries have several fingerprints.
        """
        # the level on which an entry is covered by two nodes at most
        size = self.last[places] - self.first[places]
        level = np.zeros(len(places), np.int64)
        for k in range(1, len(self.patterns)):
            level[size >= self.fanout ** (k - 1)] = k
        top = int(level.max())
        base = int(places[0]) // self.fanout**top * self.fanout**top
        only = self._only_group(base, int(self.last[places[-1]]) + 1, top)
        query, node, gone = (np.zeros(0, np.int64) for _ in range(3))
        for k in range(top, -1, -1):
            width = self.fanout**k
            begin = places[level == k]
            low, high = begin // width, self.last[begin] // width
            count = high - low + 1
            fresh = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            query, node = np.r_[query, np.repeat(begin, count)], np.r_[node, fresh]
            rest = np.r_[self.rest[k][node[: len(gone)]], self.whole[k][fresh]]  # nothing has been added up before the first level
            gone = np.r_[gone, np.zeros(len(fresh), np.int64)] + np.bitwise_count((self.fp[query] ^ self.patterns[k][node]) & rest)
            self.tested += len(node)
            near = gone <= radius
            if k:
                near &= only[k - 1][node - base // width] != self.group[query]
            query, node, gone = query[near], node[near], gone[near]
            if not k:
                break
            child = (node[:, None] * self.fanout + np.arange(self.fanout)).ravel()
            query, gone = np.repeat(query, self.fanout), np.repeat(gone, self.fanout)
            width //= self.fanout
            inside = (child * width <= self.last[query]) & ((child + 1) * width > query)  # of the entry, and not all before
            query, node, gone = query[inside], child[inside], gone[inside]
        other = (node > query) & (self.group[query] != self.group[node])
        return query[other], node[other]

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        """Make one group of those of each pair."""
        while len(a):
            x, y = self.group[a], self.group[b]
            differ = x != y
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            if not len(a):
                return
            first, end = int(self.first[a].min()), int(self.last[a].max()) + 1
            np.minimum.at(self.group, np.maximum(x, y), np.minimum(x, y))
            own = self.group[first:end]
            while True:  # every place points to the first one of its group again
                up = self.group[own]
                if (up == own).all():
                    break
                own[:] = up


def links_in(entry: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, int]:
    """Links that connect the groups of every entry, as places of both ends, and the number of comparisons."""
    index = GrayIndex(entry, fp)
    size = index.last - index.first + 1
    several = np.flatnonzero(size > 1)
    # waves of consecutive places, by the nodes that they may look at
    cost = np.cumsum(2 * FANOUT + size[several] // 2)
    at = 0
    while at < len(several):
        end = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + WAVE)))
        index.unite(*index.later(several[at:end], radius))
        at = end
    member = np.flatnonzero(index.group != np.arange(len(fp)))
    return index.order[member], index.order[index.group[member]], index.tested


def _entered(rows: DataFrame, bits: list[tuple[int, int]], key: str) -> DataFrame:
    """``rows`` with ``key``: once for each block of bits, number and value of the block."""
    value = lambda first, n: F.shiftrightunsigned("fp", first).bitwiseAND((1 << n) - 1)
    return rows.withColumn(key, F.explode(F.array(*(F.lit(k << 16).bitwiseOR(value(*b)) for k, b in enumerate(bits)))))


def _heavy(rows: DataFrame, split: int, *keys: str) -> DataFrame:
    count = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > split)
    return written(count.select(*keys, F.ceil(F.col("_n") / split).alias("_parts")), "simhash-heavy")


def entries(distinct: DataFrame, split: int = SPLIT) -> DataFrame:
    """``distinct(fp)`` under its blocks: fp, _key, _sub, and the pair of parts _p, _q of what is still large."""
    rows = _entered(distinct.select("fp"), BLOCKS, "_key").withColumn("_sub", F.lit(0).cast("long"))
    heavy = _heavy(rows, split, "_key")  # at most as many as blocks have values
    none = lambda df: df.withColumn("_p", F.lit(0)).withColumn("_q", F.lit(0)).select("fp", "_key", "_sub", "_p", "_q")
    if heavy.isEmpty():
        return none(rows)
    large = rows.drop("_sub").join(F.broadcast(heavy.select("_key")), "_key")
    finer = []
    for k, (first, n) in enumerate(BLOCKS):
        others = [x for x in range(64) if not first <= x < first + n]
        step = -(-len(others) // 5)
        # five blocks of the bits that this one does not have; a block may go around it
        bits = F.array(*(F.lit(j << 16).bitwiseOR(_gathered(others[j * step : (j + 1) * step])) for j in range(5)))
        finer.append((k, F.transform(bits, lambda x: x + 1)))
    sub = F.coalesce(*(F.when(F.shiftright("_key", 16) == k, x) for k, x in finer))
    large = large.withColumn("_sub", F.explode(sub))
    rows = none(rows.join(F.broadcast(heavy.select("_key")), "_key", "left_anti"))
    still = _heavy(large, split, "_key", "_sub")
    if still.isEmpty():
        return rows.union(none(large))
    large = large.join(still, ["_key", "_sub"], "left").withColumn("_parts", F.coalesce("_parts", F.lit(1).cast("long"))).withColumn("_part", F.pmod(F.xxhash64("fp"), "_parts"))
    large = large.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    return rows.union(large.select("fp", "_key", "_sub", F.least("_part", "_other").cast("int").alias("_p"), F.greatest("_part", "_other").cast("int").alias("_q")))


def _gathered(bits: list[int]) -> Column:
    """The bits of a fingerprint at ``bits``, side by side: one term for each consecutive stretch of them."""
    out, k = F.lit(0).cast("long"), 0
    while k < len(bits):
        n = 1
        while k + n < len(bits) and bits[k + n] == bits[k] + n:
            n += 1
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", bits[k]).bitwiseAND((1 << n) - 1), k))
        k += n
    return out


def links(distinct: DataFrame, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """``a``, ``b``: links that connect all of ``distinct(fp)`` that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 5

        def ready(columns: list[np.ndarray]) -> pa.RecordBatch:
            fp, *key = columns
            new = np.zeros(len(fp), bool)
            for x in key:
                new[1:] |= x[1:] != x[:-1]
            a, b, _ = links_in(np.cumsum(new), fp.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["a", "b"])

        for batch in batches:
            new = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)]
            rest = [np.r_[x, y] for x, y in zip(rest, new, strict=True)]
            same = np.logical_and.reduce([x == x[-1:] for x in rest[1:]])
            cut = len(same) - int(same.sum())  # the last entry may go on in the next batch
            if cut:
                yield ready([x[:cut] for x in rest])
                rest = [x[cut:] for x in rest]
        if len(rest[0]):
            yield ready(rest)

    rows = entries(distinct, split)
    parts, key = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["_key", "_sub", "_p", "_q"]
    rows = rows.repartition(parts, *key).sortWithinPartitions(*key)
    return rows.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, split: int = SPLIT, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fingerprint, component_id, ``fp``, ``n_linked`` (documents of the component), ``root`` (its smallest ``fp``) and columns ``carried`` along."""
    if radius > 4:
        raise ValueError("the blocks find all links up to 4 bits apart")
    own = written(fingerprints(docs, shingle, carried), "simhash-fp")
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    distinct = written(distinct, "simhash-distinct")
    joined = written(components(links(distinct.select("fp"), radius, split)), "simhash-components")
    group = distinct.join(joined, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("component", "fp"))
    # written, so that the join by root reads two plain tables, of which AQE splits a root with very many members
    roots = written(group.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("n_linked")), "simhash-roots")
    group = written(group.select("fp", "root").join(roots, "root"), "simhash-groups")
    return own.join(group, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "fp", "n_linked", "root", *carried)


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each component one row, the one with the smallest id.

    Among rows with that id, and where no row has one, the place in the table decides. Nulls, blank and long texts,
    repeated rows and empty tables as above; columns pass unchanged, whatever their names.
    """
    rows = identified(docs, "simhash-docs")
    groups = near_duplicates(rows.select("_doc.doc_id", "_doc.text", "_file", "_place"), carried=("_file", "_place"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("_file").alias("c"), F.col("_place").alias("d")))
    keep = groups.groupBy("root").agg(first.alias("k")).select(F.col("k.c").alias("_file"), F.col("k.d").alias("_place"))
    return rows.join(keep, ["_file", "_place"], "left_semi").select("_doc.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
