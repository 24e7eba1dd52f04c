"""Token counts of a piece vocabulary by rank-synchronous array merging.

A text is cut into pre-tokens that no merge crosses: before each space mark and around characters that
occur in no longer piece. The pre-tokens of a batch that are not yet known are held together as ragged
NumPy arrays (one flat array of symbols, one of owners). In each round every sequence applies its own
lowest-rank pair, all sequences at once: at all its places if the merged symbol can start no pair of a
lower rank, else at the first place alone. What survives is counted; symbols that are no piece count
their UTF-8 bytes (byte fallback).

Counts of pre-tokens are kept per worker in a table of bounded size, which is emptied when full; this
changes the time, not the result. Documents are independent: there is no shuffle.

Defined results: a null text is the empty text: 0 bytes, 0 tokens. Repeated rows and null ids are passed
on. Very long texts are worked off whole. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from driftline.llm.common import table

MARK = "▁"
#: Pre-tokens that a worker remembers.
CACHE = 300_000
#: Characters of text that are worked off together, about.
CHUNK = 4_000_000
LIMIT = 4096
#: Rank of no pair.
NONE = np.int64(1 << 40)


class PieceVocabulary:
    """The pieces of a sentencepiece BPE model with byte fallback, as merge tables."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(sp.get_piece_size())]
        self.pieces = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not special[i]}
        scores = {i: sp.get_score(i) for i in self.pieces.values()}
        level = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        inner = {c for p in self.pieces if len(p) > 1 for c in p}
        if sp.normalize(" a  b\n　Äﬁ ") != f"{MARK}{MARK}a{MARK}{MARK}b\n　Äﬁ{MARK}" or any(re.search(f"[^{MARK}]{MARK}", p) for p in self.pieces):
            raise ValueError("only vocabularies that keep the text as it is and whose pieces begin at spaces are supported")
        lone = "".join(re.escape(c) for c in ("\n", "\t", "\r") if c not in inner)
        self.split = re.compile(f"[{lone}]|{MARK}*[^{MARK}{lone}]+|{MARK}+") if lone else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        # symbols: pieces by id; characters that are no piece get a code of their own from 1 << 20 on
        left, right, rank, out = [], [], [], []
        for p, i in self.pieces.items():
            for k in range(1, len(p)):
                if (a := self.pieces.get(p[:k])) is not None and (b := self.pieces.get(p[k:])) is not None:
                    left.append(a), right.append(b), rank.append(level[scores[i]]), out.append(i)
        # a character that is no piece may still be part of one
        loose = {c: (1 << 20) + k for k, c in enumerate(sorted(c for c in inner if c not in self.pieces))}
        for p, i in self.pieces.items():
            for k in range(1, len(p)):
                a, b = (loose.get(x, self.pieces.get(x)) for x in (p[:k], p[k:]))
                if a is not None and b is not None and (a >= 1 << 20 or b >= 1 << 20):
                    left.append(a), right.append(b), rank.append(level[scores[i]]), out.append(i)
        self.loose, self.unknown = loose, (1 << 21) - 1
        key = np.array(left, np.int64) << 21 | np.array(right, np.int64)
        order = np.argsort(key)
        self.key, self.rank, self.out = key[order], np.array(rank, np.int64)[order], np.array(out, np.int64)[order]
        # lowest rank of a pair that a symbol takes part in: merges whose result can start a lower one go one by one
        lowest = np.full(1 << 21, NONE, np.int64)
        np.minimum.at(lowest, np.array(left, np.int64), np.array(rank, np.int64))
        np.minimum.at(lowest, np.array(right, np.int64), np.array(rank, np.int64))
        self.wild = lowest[self.out] <= self.rank

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of the pair in the merge table, -1 if there is none."""
        key = a << 21 | b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, at, -1)

    def count(self, tokens: list[str]) -> np.ndarray:
        """Number of tokens of each pre-token."""
        n = np.array([len(t) for t in tokens], np.int64)
        flat = "".join(tokens)
        table = {c: self.pieces.get(c, self.loose.get(c, self.unknown)) for c in set(flat)}
        symbols = np.fromiter(map(table.__getitem__, flat), np.int64, len(flat))
        weight = {c: len(c.encode("utf-8", "surrogatepass")) if table[c] >= 1 << 20 else 1 for c in table}
        cost = np.fromiter(map(weight.__getitem__, flat), np.int64, len(flat))
        owner = np.repeat(np.arange(len(tokens)), n)
        done = np.zeros(len(tokens), np.int64)
        rank, at = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def look(places: np.ndarray) -> None:
            """Pair index and rank of the pairs that begin at these places."""
            inside = places[(places >= 0) & (places < len(symbols) - 1)]
            inside = inside[owner[inside] == owner[inside + 1]]
            at[places[places >= 0]] = -1
            rank[places[places >= 0]] = NONE
            at[inside] = found = self.pair(symbols[inside], symbols[inside + 1])
            rank[inside] = np.where(found >= 0, self.rank[found], NONE)

        rank, at = np.empty(len(symbols), np.int64), np.empty(len(symbols), np.int64)
        look(np.arange(len(symbols)))
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(owner)])
            idle = best == NONE
            if idle.any():  # these sequences have no merge left
                done[owner[starts[idle]]] = np.add.reduceat(cost, starts)[idle]
                live = np.repeat(~idle, lengths)
                symbols, owner, cost, rank, at = symbols[live], owner[live], cost[live], rank[live], at[live]
                best, lengths = best[~idle], lengths[~idle]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, lengths))
            whose = owner[hit]
            first = np.r_[True, whose[1:] != whose[:-1]]
            # the pair of the first place; other pairs of the same rank wait for their turn
            lead = hit[np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))]
            same = (at[hit] == at[lead]) & (first | ~self.wild[at[hit]])
            hit, whose = hit[same], whose[same]
            # of overlapping places (aaa) every second one, counted from the start of the run
            run = np.r_[True, (np.diff(hit) > 1) | (whose[1:] != whose[:-1])]
            begin = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - begin) % 2 == 0]
            symbols[hit] = self.out[at[hit]]
            cost[hit] = 1
            live = np.ones(len(symbols), bool)
            live[hit + 1] = False
            symbols, owner, cost, rank, at = symbols[live], owner[live], cost[live], rank[live], at[live]
            hit -= np.arange(len(hit))  # so many symbols before it have gone
            look(np.r_[hit - 1, hit])
        return done


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[PieceVocabulary, dict[str, int]]:
    return PieceVocabulary(path), {}


def chunks(texts: Iterable[str], most: int = CHUNK) -> Iterator[list[str]]:
    """Lists of texts with about ``most`` characters together."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def count_texts(texts: Iterable[str | None], path: str, cache_size: int = CACHE) -> list[int]:
    """Numbers of tokens of whole texts."""
    vocab, known = vocabulary(path)
    out = []
    for part in chunks(t or "" for t in texts):
        tokens = [vocab.split.findall((MARK + t).replace(" ", MARK)) if t else [] for t in part]
        if len(known) > cache_size:
            known.clear()
        if new := list({w for ts in tokens for w in ts if w not in known}):
            known.update(zip(new, vocab.count(new).tolist(), strict=True))
        out += [sum(map(known.__getitem__, ts)) for ts in tokens]
    return out


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = np.array(count_texts(texts, path), np.int64)
            size = np.array([len(t.encode()) if t else 0 for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
