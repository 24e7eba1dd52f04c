import random

import pytest

from driftline.llm import mixing as M
from tests.llm.helpers import WORDS, awkward, clashing, frame


@pytest.mark.parametrize("seed", range(5))
def test_budget_is_met_as_nearly_as_sizes_allow(seed):
    rnd = random.Random(seed)
    for _ in range(60):
        sizes = rnd.sample(range(1, 60), rnd.randint(1, 8))
        counts = [rnd.randint(1, 9) for _ in sizes]
        budget = rnd.randint(0, sum(s * c for s, c in zip(sizes, counts, strict=True)))
        take = M.fit_budget(sizes, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts, strict=True))
        sums = {0}
        for s, c in zip(sizes, counts, strict=True):
            sums = {x + s * k for x in sums for k in range(c + 1)}
        assert abs(sum(s * t for s, t in zip(sizes, take, strict=True)) - budget) == min(abs(x - budget) for x in sums)


def test_large_budget_is_met_exactly():
    sizes, counts = list(range(1, 800)), [50] * 799
    take = M.fit_budget(sizes, counts, 7_654_321)
    assert sum(s * t for s, t in zip(sizes, take, strict=True)) == 7_654_321


def plain_targets(sizes, weights=(1, 2, 3)):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        rest = total - sum(capped.values())
        free = [s for s in names if s not in capped]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 3.0 * sizes[s] for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return capped | share
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1000, "b": 10, "c": 10}, {"a": 900, "b": 3, "c": 0, "d": 50, None: 7}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "_source string, _size long")
    got = {r["_source"]: r["target"] for r in M.targets(rows).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_rows(spark):
    rnd = random.Random(4)
    rows = awkward() + [(1000 + k, "w " * rnd.randint(1, 30), "en", rnd.choice("abc"), 0) for k in range(300)]
    docs = clashing(frame(spark, rows))
    got = M.mix(docs).collect()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORDS(r[1] or ""))
    want = plain_targets(sizes)
    assert len(got) == len(rows) and sorted(r["size"] for r in got) == sorted(len(WORDS(r[1] or "")) for r in rows)
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert own[0]["source_size"] == sizes[s] and own[0]["target"] == pytest.approx(want[s])
        passes = int(want[s] // sizes[s])
        reach = 1
        for r in own:
            reach |= reach << r["size"]
        nearest = min(abs(passes * sizes[s] + x - want[s]) for x in range(sizes[s] + 1) if reach >> x & 1)
        assert abs(sum(r["taken"] for r in own) - want[s]) <= nearest + 0.5 and all(r["taken"] <= 3 * r["size"] for r in own)
    again = M.mix(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_hot_sizes_are_sliced_without_loss(spark):
    rows = [(k, "a b c", "en", "s", 5) for k in range(500)] + [(k, "a b c d", "en", "t", 5) for k in range(500, 560)]
    sizes = M.written(M.measured(frame(spark, rows)), "t")
    plan = spark.createDataFrame([("s", 3, 500, 1, 123), ("t", 4, 60, 0, 60)], "_source string, _size long, _count long, _passes int, _take long")
    for n in (7, 64, 4096):
        got = M.taken_of(sizes, plan, n).groupBy("_source").sum("_times").collect()
        assert {r[0]: r[1] for r in got} == {"s": 623, "t": 60}


def test_rows_repeated_very_often(spark):
    rows = [(7, "a b c", "en", "s", 5)] * 400 + [(k, "a b c", "en", "s", 5) for k in range(30)] + [(k, "a b", "en", "t", 5) for k in range(100, 140)]
    docs = frame(spark, rows)
    sizes = M.written(M.measured(docs), "t")
    plan = spark.createDataFrame([("s", 3, 430, 1, 123), ("t", 2, 40, 2, 0)], "_source string, _size long, _count long, _passes int, _take long")
    for n in (7, 64, 4096):
        got = M.taken_of(sizes, plan, n)
        assert {r[0]: r[1] for r in got.groupBy("_source").sum("_times").collect()} == {"s": 553, "t": 80} and got.count() == len(rows)
    out = M.mixed_documents(docs).groupBy("doc_id", "text").count().collect()
    want = M.mix(docs).groupBy("doc_id").sum("times").collect()
    assert sorted((r["doc_id"], r["count"]) for r in out) == sorted((r[0], r[1]) for r in want if r[1])


def test_documents_come_as_often_as_taken(spark):
    rows = awkward()
    docs = clashing(frame(spark, rows))
    out = M.mixed_documents(docs)
    assert out.columns == docs.columns
    words = sum(len(WORDS(r["text"] or "")) for r in out.collect())
    assert words == sum(r["taken"] for r in M.mix(docs).collect())


def test_empty_tables(spark):
    assert M.mix(frame(spark, [])).count() == 0 and M.mixed_documents(frame(spark, [])).count() == 0
    blank = M.mix(frame(spark, [(1, None), (2, "")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in blank] == [(0, 0.0, 0)] * 2


@pytest.mark.parametrize("most", [60, 400, 2000])
@pytest.mark.parametrize("start", [0.0, 0.5, 0.9])
def test_part_pass_takes_its_share_of_small_and_large_sizes(most, start):
    sizes = list(range(1, most + 1))
    budget = sum(sizes) * 53 // 100
    take = M.fit_budget(sizes, [1] * most, budget, start=start)
    assert sum(s * t for s, t in zip(sizes, take, strict=True)) == budget
    fifths = [take[k * most // 5 : (k + 1) * most // 5] for k in range(5)]
    assert all(abs(sum(x) - 0.53 * len(x)) <= 4 for x in fifths)
