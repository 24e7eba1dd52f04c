"""The corpus pipeline against plain versions of its stages."""

import hashlib
from collections import Counter

import numpy as np
import tiktoken

import corpus_pipeline as P
from driftline.llm import byte_bpe, mixing, quality_model
from driftline.llm.common import table
from tests.llm.helpers import WORDS, awkward, clashing, frame
from tests.llm.test_exact_dedup import plain as plain_dedup
from tests.llm.test_simhash import plain as plain_simhash
from tests.llm.test_simhash import plain_kept


def plain_good(model, rows):
    """The rows whose score under the cut of all of them is 0.3 or more."""
    x = np.array([quality_model.features(r[1]) for r in rows])
    bins = np.floor(np.clip(quality_model.strength(model, x) / model["unit"], -quality_model.REACH, quality_model.REACH) * quality_model.BINS)
    cut = quality_model.cut_of(Counter(bins.astype(int).tolist()), model["share"], model["labelled"]) / quality_model.BINS * model["unit"]
    return [r for r, s in zip(rows, quality_model.score(model | {"cut": cut}, x), strict=True) if s >= 0.3]


def test_stages_follow_each_other_and_take_effect(spark, sf):
    import public_tokenizers

    docs = table(spark, sf, "documents")
    names = docs.columns
    rows = [tuple(r) for r in docs.collect()]
    model = quality_model.train(docs, table(spark, sf, "labels"))
    good = plain_good(model, rows)
    assert 0 < len(good) < len(rows)
    seen = {}
    frame = docs
    for name, stage in P.STAGES:
        frame = P.written(stage(spark, frame, sf), "t")
        seen[name] = [tuple(r) for r in frame.collect()]
        assert name == "byte-level BPE" or frame.columns == names
    stages = list(seen.values())
    assert sorted(stages[0]) == sorted(good)
    keep = {k for _, k, _, _ in plain_dedup(good)[0]}
    assert sorted(stages[1]) == sorted(r for r in good if r[0] in keep) and len(stages[1]) < len(good)
    keep = {c for _, _, c in plain_simhash(stages[1])}
    assert sorted(stages[2]) == sorted(r for r in stages[1] if r[0] in keep)
    assert {r[0] for r in stages[3]} <= {r[0] for r in stages[2]} and abs(sum(len(WORDS(r[1])) for r in stages[3]) - sum(len(WORDS(r[1])) for r in stages[2])) <= 700
    vocab, _ = byte_bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(r[0], len(i := lib.encode_ordinary(r[1])), sha(",".join(map(str, i)).encode()), sha(r[1].encode())) for r in stages[3]]
    assert sorted(stages[4]) == sorted(want)
    assert sorted(map(tuple, P.run(spark, sf).collect())) == sorted(want)


def test_stages_take_nulls_repeats_and_clashing_columns(spark, sf):
    docs = P.written(clashing(frame(spark, awkward())), "t")
    names, key = docs.columns, lambda r: str(r)
    seen = {"": [tuple(r) for r in docs.collect()]}
    current, tables = docs, {}
    for name, stage in P.STAGES:
        # labels of other documents: the classifier learns nothing and keeps all
        current = P.written(stage(spark, current, sf) if name != "quality classifier" else quality_model.good_documents(current, quality_model.train(current, table(spark, sf, "labels").limit(0))), "t")
        tables[name], seen[name] = current, [tuple(r) for r in current.collect()]
        assert name == "byte-level BPE" or current.columns == names
    start, good, exact, near, mixed, encoded = seen.values()
    assert sorted(good, key=key) == sorted(start, key=key)
    assert len(exact) == plain_dedup(good)[1] and not Counter(exact) - Counter(good)
    assert sorted((r[0] for r in near), key=str) == plain_kept(exact) and not Counter(near) - Counter(exact)
    taken = sum(r["taken"] for r in mixing.mix(tables["SimHash near-dedup"]).collect())
    assert set(mixed) <= set(near) and sum(len(WORDS(r[1] or "")) for r in mixed) == taken
    assert len(encoded) == len(mixed)


def test_stages_take_empty_tables(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, sf).count() == 0
