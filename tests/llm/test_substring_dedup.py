import hashlib
import random

import pytest

from driftline.llm import substring_dedup as S
from tests.llm.helpers import WORDS, awkward, clashing, collected, frame


def plain(rows, window):
    first, texts = {}, [(S.LAST if r[0] is None else r[0], WORDS(r[1] or "")) for r in rows]
    for d, w in texts:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, (d, i)), (d, i))
    out = []
    for r, (d, w) in zip(rows, texts, strict=True):
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < (d, i) for j in range(i, i + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def passages(seed, vocab, n, long):
    rnd = random.Random(seed)
    text = lambda m: " ".join(rnd.choice(vocab) for _ in range(m))
    shared = [text(rnd.randint(20, long)) for _ in range(6)]
    rows = []
    for k in range(n):
        parts = [text(rnd.randint(0, 40)) for _ in range(rnd.randint(1, 3))]
        for _ in range(rnd.randint(0, 3)):
            parts.insert(rnd.randint(0, len(parts)), rnd.choice(shared))
        rows.append((rnd.choice([k, k, None, 5]), " ".join(parts)))
    return rows


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("letters", ["ab", "abcdefghijklmnopqrstuvwxyz"])
def test_equals_brute_force(spark, seed, letters):
    rows = passages(seed, list(letters), 40, 70)
    assert collected(S.substring_dedup(frame(spark, rows)), "doc_id", "n_words", "n_removed", "kept_sha256") == plain(rows, 20)
    assert any(r[2] for r in plain(rows, 20))


def test_repeats_within_a_text_and_awkward_rows(spark):
    rows = awkward() + [(400, " ".join(["x"] * 90)), (401, " ".join(map(str, range(50))) + " y " + " ".join(map(str, range(50))))]
    got = S.substring_dedup(clashing(frame(spark, rows)))
    assert collected(got, "doc_id", "n_words", "n_removed", "kept_sha256") == plain([r[:2] for r in rows], 20)


@pytest.mark.parametrize("window, k", [(5, 2), (9, 4)])
def test_other_windows(spark, window, k):
    rows = passages(9, list("abcd"), 15, 40)
    assert collected(S.substring_dedup(frame(spark, rows), window, k), "doc_id", "n_words", "n_removed", "kept_sha256") == plain(rows, window)


def test_small_batches_give_the_same(spark):
    rows = passages(5, list("abc"), 60, 60)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = collected(S.substring_dedup(frame(spark, rows)), "doc_id", "n_words", "n_removed", "kept_sha256")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain(rows, 20)


def test_equal_hashes_of_texts_are_told_apart(spark):
    shared = " ".join(map(str, range(30)))
    rows = [(None, shared + " a"), (None, "b " + shared), (None, None), (3, shared), (3, "c " + shared), (3, "c " + shared)]
    for bits in (2, 3, 64):  # with two bits most seeds let texts of one id collide
        assert collected(S.substring_dedup(frame(spark, rows), bits=bits), "doc_id", "n_words", "n_removed", "kept_sha256") == plain(rows, 20)
    with pytest.raises(ValueError, match="equal hashes"):
        S.keyed(frame(spark, [(None, str(k)) for k in range(9)]), 2)


def test_ids_repeated_very_often(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(None, f"{passage} x{k}") for k in range(300)] + [(None, passage)] * 50 + [(9, f"y {passage}")] * 30
    assert collected(S.substring_dedup(frame(spark, rows)), "doc_id", "n_words", "n_removed", "kept_sha256") == plain(rows, 20)


def test_empty_table(spark):
    assert S.substring_dedup(frame(spark, [])).count() == 0
