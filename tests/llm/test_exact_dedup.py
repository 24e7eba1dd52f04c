import hashlib
import re

import pytest

from driftline.llm import exact_dedup as X
from tests.compare import database, differences, spark_rows, sql_rows
from tests.llm.helpers import awkward, clashing, collected, frame


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub("[ \t-\r]", "", r[1] or ""), []).append(r)
    out = []
    for normal, own in groups.items():
        best = min(own, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        sha = hashlib.sha256(normal.encode()).hexdigest()
        out += [(r[0], best[0], len(own), sha) for r in own]
    return sorted(out, key=str), len(groups)


@pytest.mark.parametrize("bits", [256, 4])
def test_equals_brute_force_also_when_digests_collide(spark, bits):
    rows = awkward()
    got = X.exact_dedup(clashing(frame(spark, rows)), digest_bits=bits)
    want, groups = plain(rows)
    assert collected(got, "doc_id", "keep_id", "group_size", "text_sha256") == want
    assert got.filter("kept").count() == groups
    assert got.filter("kept and not (doc_id <=> keep_id)").count() == 0


def test_kept_documents(spark):
    rows = awkward()
    docs = clashing(frame(spark, rows))
    kept = X.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == plain(rows)[1]


def test_empty_table(spark):
    assert X.exact_dedup(frame(spark, [])).count() == 0 and X.kept_documents(frame(spark, [])).count() == 0


def test_filter_marks_all_hits(spark):
    docs = frame(spark, [(k, f"t{k % 40}") for k in range(60)])
    groups = X.compact(X.flush(X.memtables(docs), "_digest"), "_digest")
    assert X.verify_hits(docs, X.hit_filter(groups, 4), filter_rows=4).count() == 0
    assert X.hit_filter(groups, 4).count() <= 4
    assert X._may_hit(X.memtables(docs), X.hit_filter(groups, 1024), 1024).filter("_hit").count() == 40


@pytest.mark.parametrize("filter_rows", [256, 1])
def test_entries_of_one_run_skip_the_merge(spark, filter_rows):
    docs = frame(spark, [(k, f"t{k}") for k in range(400)] + [(k, "same") for k in range(500, 530)]).repartition(6)
    runs = X.written(X.flush(X.memtables(docs), "_digest"), "t")
    entries = X.probed(runs, X.run_filters(runs, filter_rows), filter_rows).collect()
    runs_of = {}
    for r in entries:
        runs_of.setdefault(r["_digest"], set()).add(r["_run"])
    assert all(r["_elsewhere"] >= len(runs_of[r["_digest"]]) - 1 for r in entries)  # a filter never denies what a run has
    skipped = [r for r in entries if r["_elsewhere"] == 0]
    assert len(entries) > len(skipped) > 380
    assert sorted(tuple(r) for r in X.merged(runs).collect()) == sorted(tuple(r) for r in X.compact(runs, "_digest").collect())


def test_rows_of_one_id_are_told_apart(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "ab"), (None, "x"), (None, "x"), (None, None), (2, "")]
    for docs in (frame(spark, rows), X.written(frame(spark, rows), "t")):
        assert collected(X.kept_documents(docs), "doc_id", "text") == sorted([(1, "a b"), (None, "x"), (2, "")], key=str)


def test_query_equals_sql(spark, sf):
    assert differences(spark_rows(X.op5_exact_dedup(spark, sf)), sql_rows(database(sf), X.OP5_SQL)) == []
