import hashlib
import random

import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers as P
import sentencepiece
import tiktoken

from driftline.llm import byte_bpe as B
from driftline.llm import token_count as T
from tests.llm.helpers import awkward, clashing, collected, frame

PIECES, RANKS = P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken")


def odd_texts():
    rnd = random.Random(1)
    letters = "ab  \n\t▁eéñß漢字😀　\x00<s>0x0A aaaa the ing  ﻿123"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    return [*texts, "a" * 4000, " " * 2000, "aaaa bbbb  " * 300, "\n" * 90, "<s></s><unk><|endoftext|>", "", "".join(rnd.choice("abcde") for _ in range(15000)), "the" * 3000]


def encoding():
    vocab, _ = B.vocabulary(RANKS, P.PATTERN)
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})


def test_counts_equal_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = odd_texts()
    assert T.count_texts(texts, PIECES) == [len(x) for x in sp.encode(texts, num_threads=1)]
    assert T.count_texts(texts[:200], PIECES, cache_size=5) == [len(x) for x in sp.encode(texts[:200], num_threads=1)]


def test_ids_equal_the_library_and_decode_back():
    lib, (vocab, _) = encoding(), B.vocabulary(RANKS, P.PATTERN)
    texts = odd_texts()
    ids = list(B.encode_texts(texts, RANKS, P.PATTERN))
    assert ids == [lib.encode_ordinary(t) for t in texts]
    assert all(vocab.decode(i) == t.encode() for i, t in zip(ids, texts, strict=True))


def test_a_small_cache_changes_nothing():
    texts = odd_texts()[:300]
    assert list(B.encode_texts(texts, RANKS, P.PATTERN, cache_size=3)) == list(B.encode_texts(texts, RANKS, P.PATTERN))


def test_rank_queue_pops_in_order():
    import numpy as np

    rnd, queue = random.Random(2), B.RankQueue(50_000)
    ranks = [rnd.randrange(50_000) for _ in range(500)]
    for k, r in enumerate(ranks):
        queue.push(r, np.array([k]))
    out = []
    while (x := queue.pop()) is not None:
        out.append(x[0])
        if len(out) == 50:
            queue.push(3, np.array([7]))
            assert queue.pop()[0] == 3
    assert out == sorted(set(ranks))


def test_count_query_rows(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = awkward()
    got = T.token_counts(clashing(frame(spark, rows)), PIECES)
    want = [(r[0], len((r[1] or "").encode()), n := len(sp.encode(r[1] or "")), n > 4096) for r in rows]
    assert collected(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=str)
    assert any(w[3] for w in want) and T.token_counts(frame(spark, []), PIECES).count() == 0


def test_round_trip_rows(spark):
    lib, rows = encoding(), awkward()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(r[0], len(ids := lib.encode_ordinary(r[1] or "")), sha(",".join(map(str, ids)).encode()), sha((r[1] or "").encode())) for r in rows]
    docs = clashing(frame(spark, rows))
    assert collected(B.round_trip(docs, RANKS, P.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
    encoded = B.encode_documents(docs, RANKS, P.PATTERN)
    back = collected(B.decode_documents(encoded, RANKS, P.PATTERN), "doc_id", "bytes")
    assert sorted((d, bytes(b).decode()) for d, b in back if d is not None) == sorted((r[0], r[1] or "") for r in rows if r[0] is not None)
    assert B.round_trip(frame(spark, []), RANKS, P.PATTERN).count() == 0
