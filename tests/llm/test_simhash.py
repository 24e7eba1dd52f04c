import numpy as np
import pytest
import xxhash

from driftline.llm import simhash as H
from driftline.llm.components import components
from tests.llm.helpers import WORDS, awkward, clashing, collected, frame


def plain_fingerprint(text):
    words = WORDS("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def united(fps):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def plain(rows):
    fps = [plain_fingerprint(r[1]) for r in rows]
    label = united(fps)
    least = {}
    for r, g in zip(rows, label, strict=True):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    return sorted(((r[0], f"{f:016x}", least.get(g)) for r, f, g in zip(rows, fps, label, strict=True)), key=str)


def planted(seed, n, centres):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, centres, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(n)]
    return np.unique(np.array([int(base[rng.integers(centres)]) ^ f for f in flips], np.uint64))


def test_equals_brute_force(spark):
    rows = awkward() + [(300, "a b c d e f g h"), (301, "A B C D E F G H"), (302, "a b"), (303, "a b")]
    assert collected(H.near_duplicates(clashing(frame(spark, rows))), "doc_id", "fingerprint", "component_id") == plain(rows)


def linked(n, a, b):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        parent[root(x)] = root(y)
    return [root(x) for x in range(n)]


def partition(labels):
    groups = {}
    for k, g in enumerate(labels):
        groups.setdefault(g, set()).add(k)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("n, centres, kinds", [(2, 1, 1), (5, 1, 1), (60, 2, 1), (60, 2, 7), (900, 3, 1), (900, 3, 4), (700, 40, 90)])
def test_index_finds_all_groups(n, centres, kinds):
    fp = planted(n, n, centres)
    entry = np.random.default_rng(n).integers(0, kinds, len(fp))
    a, b, _ = H.links_in(entry, fp)
    assert (entry[a] == entry[b]).all() and len(a) < len(fp)
    own = linked(len(fp), a, b)
    for e in range(kinds):
        at = np.flatnonzero(entry == e)
        assert partition([own[k] for k in at]) == partition(united([int(fp[k]) for k in at]))


def test_index_prunes_what_is_far_and_what_is_united():
    far = planted(3, 20000, 250)
    _, _, tested = H.links_in(np.zeros(len(far), np.int64), far)
    assert tested < len(far) ** 2 / 4  # half of all pairs would be without an index
    near = planted(1, 20000, 1)
    a, _, tested = H.links_in(np.zeros(len(near), np.int64), near)
    assert len(a) == len(near) - 1 and tested < len(near) ** 2 / 10


def test_index_adds_up_differences():
    fp = planted(4, 500, 60)
    index = H.GrayIndex(np.zeros(len(fp), np.int64), fp)
    top = len(index.patterns) - 1
    for k in range(0, len(fp), 37):
        for q in (0, 5):
            total = sum(int(((index.fp[q] ^ index.patterns[j][k // 16**j]) & (index.rest[j] if j < top else index.whole[j])[k // 16**j])).bit_count() for j in range(top + 1))
            assert total == int(index.fp[q] ^ index.fp[k]).bit_count()


@pytest.mark.parametrize("split", [32768, 50, 8])
def test_links_connect_what_brute_force_links_also_when_entries_are_split(spark, split):
    fp = planted(7, 400, 3)
    distinct = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    pairs = H.links(distinct, split=split)
    own = {r["node"]: r["component"] for r in components(pairs).collect()}
    ids = fp.view(np.int64).tolist()
    groups = {}
    for x, g in zip(ids, united([int(x) for x in fp]), strict=True):
        groups.setdefault(g, []).append(x)
    assert {frozenset(g) for g in groups.values()} == {frozenset(y for y in ids if own.get(y, y) == own.get(x, x)) for x in ids}


def test_gray_rank_neighbours_differ_in_one_bit():
    codes = np.arange(1024, dtype=np.uint64)
    order = codes[np.argsort(H.gray_rank(codes))]
    assert (np.bitwise_count(order[1:] ^ order[:-1]) == 1).all()


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}
    assert components(links.limit(0)).count() == 0


def plain_kept(rows):
    """Ids and texts of the rows that stay, where a component's id is that of one text only."""
    label = united([plain_fingerprint(r[1]) for r in rows])
    best = {}
    for r, g in zip(rows, label, strict=True):
        best[g] = min(best.get(g, (2, 0)), (r[0] is None, r[0] or 0))
    return sorted((None if none else d for none, d in best.values()), key=str)


def test_one_of_each_group(spark):
    rows = awkward()
    docs = clashing(frame(spark, rows))
    kept = H.one_of_each_group(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == plain_kept(rows)


@pytest.mark.parametrize("ids, keeps", [((1, None, None), [(1, 0), (None, 1)]), ((3, 5, 5), [(3, 0), (5, 1)]), ((None, None, None), [(None, 0), (None, 1)]), ((7, 7, 7), [(7, 0), (7, 1)])])
def test_rows_are_kept_not_ids(spark, ids, keeps):
    texts = ["alpha beta gamma delta epsilon zeta", "one two three four five six seven"]
    rows = [(ids[0], texts[0]), (ids[1], texts[0]), (ids[2], texts[1])]
    docs = frame(spark, rows)
    want = sorted(((d, texts[t]) for d, t in keeps), key=str)
    assert collected(H.one_of_each_group(docs), "doc_id", "text") == want
    assert collected(H.one_of_each_group(H.written(docs, "t")), "doc_id", "text") == want


def test_empty_table(spark):
    assert H.near_duplicates(frame(spark, [])).count() == 0 and H.one_of_each_group(frame(spark, [])).count() == 0
