"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The bytes of all pre-tokens of a batch that are not yet known form one doubly linked list. The queue has
a bucket of list positions per merge rank; a bitmap of three levels tells which buckets are filled, and
find-first-set yields the lowest rank. All positions of the popped bucket are merged at once, across the
pre-tokens: stale entries (a symbol has gone or changed since) are skipped, overlapping places give way
to the one before them, and a merge whose result may start a pair of a lower rank, which would have to
come before the next place of the same pre-token, is applied at the first place of each pre-token only,
the rest being put back. Each pair goes into a bucket once when it arises, so the work for a pre-token
grows with its length times the logarithm of a bucket's size, also for a very long one.

Ids of pre-tokens are kept per worker in a table of bounded size, which is emptied when full; texts are
held as numbers of pre-tokens meanwhile. Documents
are independent: there is no shuffle.

Defined results: a null text is the empty text: 0 tokens, digests of nothing. Repeated rows and null ids
are passed on. Texts are encoded whole. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from driftline.llm.common import table

#: Pre-tokens that a worker remembers.
CACHE = 300_000
#: Characters of text that are worked off together, about.
CHUNK = 8_000_000


class RankQueue:
    """Buckets of positions by rank under a bitmap hierarchy of 64-way nodes; ranks below 64 ** levels."""

    def __init__(self, ranks: int):
        self.levels = [defaultdict(int)]
        while ranks > 64:
            ranks = (ranks + 63) // 64
            self.levels.append(defaultdict(int))
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        if (bucket := self.buckets.get(rank)) is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        for level in self.levels:
            level[rank >> 6] |= 1 << (rank & 63)
            rank >>= 6

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest filled rank and its positions in order; its bucket is empty afterwards."""
        at = 0
        for level in reversed(self.levels):
            if not (word := level[at]):
                return None
            at = at << 6 | (word & -word).bit_length() - 1  # find first set
        rank = at
        for level in self.levels:
            level[at >> 6] &= ~(1 << (at & 63))
            if level[at >> 6]:
                break
            at >>= 6
        parts = self.buckets.pop(rank)
        return rank, parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


class ByteVocabulary:
    """The ranks of a tiktoken file with the table of pairs that merge."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        left, right, out = [], [], []
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                if (a := self.ranks.get(token[:k])) is not None and (b := self.ranks.get(token[k:])) is not None:
                    left.append(a), right.append(b), out.append(rank)
        self.size = max(self.tokens) + 1
        self.ints = list(range(self.size))
        key = np.array(left, np.int64) * self.size + np.array(right, np.int64)
        order = np.argsort(key)
        self.key, self.out = key[order], np.array(out, np.int64)[order]
        lowest = np.full(self.size, self.size, np.int64)
        np.minimum.at(lowest, np.array(left), np.array(out))
        np.minimum.at(lowest, np.array(right), np.array(out))
        self.wild = lowest <= np.arange(self.size)
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, -1 if there is none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.out[at], -1)

    def _enqueue(self, queue: RankQueue, ranks: np.ndarray, positions: np.ndarray) -> None:
        use = ranks >= 0
        ranks, positions = ranks[use], positions[use]
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for r, part in zip(ranks[np.r_[0, cuts]].tolist() if len(ranks) else (), np.split(positions, cuts), strict=False):
            queue.push(r, part)

    def encode_all(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each of the pieces, which no merge crosses."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(flat)
        ids = np.append(self.byte[flat], -1)  # -1: gone
        owner = np.append(np.repeat(np.arange(len(pieces)), sizes), -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[n], before[0] = n, n
        queue = RankQueue(self.size)
        places = np.flatnonzero(owner[:-1] == owner[1:])
        self._enqueue(queue, self.rank(ids[places], ids[places + 1]), places)
        while (popped := queue.pop()) is not None:
            rank, at = popped
            at = at[ids[at] >= 0]
            nxt = after[at]
            use = owner[at] == owner[nxt]
            at, nxt = at[use], nxt[use]
            live = self.rank(ids[at], ids[nxt]) == rank  # else stale
            at, nxt = at[live], nxt[live]
            if not len(at):
                continue
            if len(at) > 1:
                if self.wild[rank]:
                    first = np.r_[True, owner[at][1:] != owner[at][:-1]]
                    if not first.all():
                        queue.push(rank, at[~first])
                        at, nxt = at[first], nxt[first]
                else:
                    linked = np.r_[False, nxt[:-1] == at[1:]]
                    if linked.any():  # runs of overlapping places: every second one from the start
                        begin = np.maximum.accumulate(np.where(linked, 0, np.arange(len(at))))
                        keep = (np.arange(len(at)) - begin) % 2 == 0
                        at, nxt = at[keep], nxt[keep]
            ids[at], ids[nxt] = rank, -1
            behind = after[nxt]
            after[at], before[behind] = behind, at
            ahead = before[at]
            ahead, lead = ahead[owner[ahead] == owner[at]], at[owner[ahead] == owner[at]]
            use = owner[behind] == owner[at]
            self._enqueue(queue, np.r_[self.rank(ids[ahead], ids[lead]), self.rank(ids[at[use]], ids[behind[use]])], np.r_[ahead, at[use]])
        left = ids[:-1] >= 0
        ids, owner = ids[:-1][left], owner[:-1][left]
        ends = np.cumsum(np.bincount(owner, minlength=len(pieces))).tolist()
        ids = list(map(self.ints.__getitem__, ids.tolist()))  # one object per id, however often it is remembered
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PreTokens(dict):
    """Numbers of the pre-tokens seen, in the order they came, with their ids once encoded."""

    def __init__(self, vocab: ByteVocabulary):
        self.vocab, self.fresh = vocab, []
        self.ids: list[list[int]] = []
        self.names: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number

    def read(self, text: str | None) -> array:
        """The numbers of the pre-tokens of a text."""
        return array("I", map(self.__getitem__, self.vocab.find(text))) if text else array("I")

    def encode(self) -> None:
        """Encode, all at once, the pre-tokens that are new."""
        ids = self.vocab.encode_all([w.encode("utf-8", "replace") for w in self.fresh]) if self.fresh else []
        self.ids += ids
        self.names += [",".join(map(str, x)) for x in ids]
        self.fresh = []

    def forget(self) -> None:
        self.clear()
        self.ids, self.names = [], []


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> tuple[ByteVocabulary, PreTokens]:
    vocab = ByteVocabulary(path, pattern)
    return vocab, PreTokens(vocab)


def read_texts(texts: list[str | None], path: str, pattern: str, cache_size: int = CACHE) -> Iterator[tuple[PreTokens, array]]:
    """For each whole text the numbers of its pre-tokens, which by then are encoded; to be used at once."""
    _, known = vocabulary(path, pattern)
    start = 0
    while start < len(texts):
        if len(known) > cache_size:
            known.forget()
        stop, size, found = start, 0, []
        while stop < len(texts) and size < CHUNK:
            found.append(known.read(texts[stop]))
            size += len(texts[stop] or "")
            stop += 1
        known.encode()
        for numbers in found:
            yield known, numbers
        start = stop


def encode_texts(texts: list[str | None], path: str, pattern: str, cache_size: int = CACHE) -> Iterator[list[int]]:
    """The ids of each whole text."""
    for known, numbers in read_texts(texts, path, pattern, cache_size):
        yield list(chain.from_iterable(map(known.ids.__getitem__, numbers)))


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``ids``: the ids of every whole text as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = list(encode_texts(batch.column(1).to_pylist(), path, pattern))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``bytes``: the decoded bytes of ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, _ = vocabulary(path, pattern)
        for batch in batches:
            decoded = [vocab.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every whole text encoded, and its ids decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, _ = vocabulary(path, pattern)
        for batch in batches:
            counts, coded, decoded = [], [], []
            for known, numbers in read_texts(batch.column(1).to_pylist(), path, pattern):
                ids = list(chain.from_iterable(map(known.ids.__getitem__, numbers)))
                counts.append(len(ids))
                coded.append(hashlib.sha256(",".join(map(known.names.__getitem__, numbers)).encode()).hexdigest())
                decoded.append(hashlib.sha256(vocab.decode(ids)).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
