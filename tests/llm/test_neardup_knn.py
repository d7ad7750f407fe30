import itertools
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from sparkquarry.llm import knn, neardup
from sparkquarry.llm.neardup import NearDuplicates


def brute(rows, t=0.6, n=3, least=20):
    sets = {}
    for i, x in rows:
        w = re.findall(r"[^\W_]+", (x or "").lower())
        if i is not None and len(w) >= least:
            sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    t = Fraction(str(t))
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}, sets


def family(seed, n):
    random.seed(seed)
    words = [f"w{i}" for i in range(300)]
    common = "in the season of cinders and the long winter".split()
    base = [[random.choice(words) for _ in range(random.randint(18, 60))] + common for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(random.choice(base))
        for _ in range(random.randint(0, 7)):
            k = random.randrange(len(w))
            w[k : k + 1] = random.choice([[], ["edit"], [w[k], "added"], [w[k].upper()]])
        rows.append((i, " ".join(w) + random.choice(["", ".", " \n"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.35])
def test_pairs_equal_brute_force(spark, seed, threshold):
    rows = family(seed, 120)
    want, _ = brute(rows, threshold)
    got = [tuple(r) for r in NearDuplicates(spark.createDataFrame(rows, "chunk_id long, text string"), threshold=threshold).pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == want


def components(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_groups(spark):
    rows = family(3, 90)
    want, sets = brute(rows)
    got = NearDuplicates(spark.createDataFrame(rows, "chunk_id long, text string")).groups().collect()
    assert {r["chunk_id"]: r["group_id"] for r in got} == components(sets, want)
    assert {r["chunk_id"]: r["links"] for r in got} == {n: sum(n in p for p in want) for n in sets}


def test_connected_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101)]
    random.seed(1)
    random.shuffle(edges)
    got = {r["set"]: r["root"] for r in neardup.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_neardup_edges(spark):
    t = " ".join(f"word{i}" for i in range(20))
    rows = [(1, t, 0), (2, t.upper() + "!", 0), (2, t.upper() + "!", 1), (3, None, 0), (4, "", 0), (5, " ".join(["same"] * 30), 0), (6, " ".join(["same"] * 25), 0), (7, " ".join(t.split()[:19]), 0), (None, t, 0), (8, "a " * 5000 + "b c d", 0)]
    df = spark.createDataFrame(rows, "chunk_id long, text string, a int")
    assert {tuple(r) for r in NearDuplicates(df).pairs().collect()} == {(1, 2), (5, 6)}
    assert {r["chunk_id"]: r["group_id"] for r in NearDuplicates(df).groups().collect()} == {1: 1, 2: 1, 5: 5, 6: 5, 8: 8}
    empty = NearDuplicates(spark.createDataFrame([], "chunk_id string, text string"))
    assert empty.pairs().count() == 0 and empty.groups().count() == 0


def boilerplate(seed, n):
    random.seed(seed)
    text = " ".join(f"form{i}" for i in range(random.choice([40, 70])))
    rows = []
    for i in range(n):
        own = " ".join(f"own{random.randint(0, 400)}" for _ in range(random.choice([4, 12, 30, 50])))
        rows.append((i, text + " " + own if i % 3 else own + " " + own))
    return rows


@pytest.mark.parametrize("common", [0, 3, 20, 2000])
@pytest.mark.parametrize("seed", [1, 4])
def test_common_grams(spark, monkeypatch, common, seed):
    monkeypatch.setattr(neardup, "COMMON", common)  # most n-grams are common, or few, or none
    for rows in (boilerplate(seed, 90), family(seed, 90)):
        assert {tuple(r) for r in NearDuplicates(spark.createDataFrame(rows, "chunk_id long, text string")).pairs().collect()} == brute(rows)[0]


@pytest.mark.parametrize("hot", [0, 1, 7])
def test_hot_grams_are_spread(spark, monkeypatch, hot):
    monkeypatch.setattr(neardup, "HOT", hot)
    for rows in (boilerplate(2, 60), family(3, 90)):
        assert {tuple(r) for r in NearDuplicates(spark.createDataFrame(rows, "chunk_id long, text string")).pairs().collect()} == brute(rows)[0]


def test_several_buckets_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(neardup, "MOST_TASKS", 3)
    monkeypatch.setattr(knn, "MOST_TASKS", 2)
    monkeypatch.setattr(knn, "CELL_SIZE", 100)
    rows = family(4, 90)
    assert {tuple(r) for r in NearDuplicates(spark.createDataFrame(rows, "chunk_id long, text string")).pairs().collect()} == brute(rows)[0]
    assert recall(spark, clusters(1500, seed=9))[0] >= 0.85


def test_each_text_of_a_family_is_sent_once(spark):
    base = [f"word{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:i], f"own{i}", *base[i + 1 :]])) for i in range(60)]
    near = NearDuplicates(spark.createDataFrame(rows, "chunk_id long, text string"))
    assert {tuple(r) for r in near.pairs().collect()} == brute(rows)[0]
    pairs = near.candidates()
    both = pairs.unionByName(pairs.selectExpr("b AS a", "a AS b"))
    assert both.groupBy("a").agg({"b": "min"}).count() == 60 and near.links().count() == len(brute(rows)[0])


def test_blocks_over_several_tries(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PARTNERS", 3)
    rows = family(5, 80)
    assert {tuple(r) for r in NearDuplicates(spark.createDataFrame(rows, "chunk_id long, text string")).pairs().collect()} == brute(rows)[0]


def exact(ids, x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    out = {}
    for i in range(len(ids)):
        out[ids[i]] = [(ids[j], s[i, j]) for j in sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:k]]
    return out


def clusters(n, dim=64, seed=0, spread=0.3):
    r = np.random.default_rng(seed)
    centre = r.standard_normal((max(2, n // 25), dim))
    return (centre[r.integers(0, len(centre), n)] + spread * r.standard_normal((n, dim))).astype(np.float32)


def test_recall_and_similarities(spark):
    x = clusters(1500)
    ids = np.random.default_rng(1).permutation(5000)[:1500].tolist()
    got = {}
    for r in knn.nearest(spark.createDataFrame(list(zip(ids, x.tolist())), "chunk_id long, embedding array<float>")).collect():
        got.setdefault(r["chunk_id"], {})[r["rank"]] = (r["neighbour_id"], r["similarity"])
    want = exact(ids, x.astype(np.float64), 10)
    hits = sum(len({n for n, _ in want[i]} & {n for n, _ in got[i].values()}) for i in ids)
    assert hits / (10 * len(ids)) >= 0.9
    s = {(i, j): v for i in ids for j, v in want[i]}
    for i in ids:
        assert sorted(got[i]) == list(range(1, 11))
        assert all(abs(v - s[i, n]) < 2e-6 for n, v in got[i].values() if (i, n) in s)


def test_small_scan_is_exact(spark):
    x = clusters(60, seed=3)
    got = {}
    for r in knn.nearest(spark.createDataFrame(list(enumerate(x.tolist())), "chunk_id long, embedding array<float>"), k=5).orderBy("chunk_id", "rank").collect():
        got.setdefault(r["chunk_id"], []).append(r["neighbour_id"])
    assert got == {i: [n for n, _ in v] for i, v in exact(list(range(60)), x.astype(np.float64), 5).items()}


def test_copies_ties_and_unusable(spark):
    e = [1.0] + [0.0] * 63
    rows = [(i, e, "x") for i in range(30)] + [(40, [2.0 * v for v in e], "x"), (41, None, "x"), (42, [0.0] * 64, "x"), (43, [1.0] * 3, "x"), (44, [float("nan")] + e[1:], "x"), (None, e, "x"), (3, e, "x")]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<float>, v string")
    got = {}
    for r in knn.nearest(df).orderBy("chunk_id", "rank").collect():
        got.setdefault(r["chunk_id"], []).append(r["neighbour_id"])
    assert set(got) == {*range(30), 40}
    assert got[0] == list(range(1, 11)) and got[29] == list(range(10)) and got[40] == list(range(10))
    pairs = {tuple(r) for r in knn.similar_pairs(knn.nearest(df), 0.8).collect()}
    assert (0, 1) in pairs and (0, 40) in pairs and all(a < b for a, b in pairs)
    assert knn.nearest(df.limit(0)).count() == 0
    assert knn.nearest(df.filter("chunk_id = 5")).count() == 0


def recall(spark, x, **how):
    got = {}
    for r in knn.nearest(spark.createDataFrame(list(enumerate(x.tolist())), "chunk_id long, embedding array<float>"), **how).collect():
        got.setdefault(r["chunk_id"], []).append((r["rank"], r["neighbour_id"]))
    want = exact(list(range(len(x))), x.astype(np.float64), 10)
    assert all(len(got[i]) == 10 for i in want)
    return sum(len({n for n, _ in want[i]} & {n for _, n in got[i]}) for i in want) / (10 * len(x)), [[n for _, n in sorted(got[i])] == [n for n, _ in want[i]] for i in want]


@pytest.mark.parametrize("cell", [20_000, 400])
def test_few_lists_are_searched_by_sublists(spark, monkeypatch, cell):
    monkeypatch.setattr(knn, "CELL_SIZE", cell)  # 400: each list is split over several tasks
    x = clusters(4000, seed=5)
    assert knn.fit(x, 4000, max_lists=2).parts.tolist() == ([1, 1] if cell > 400 else knn.fit(x, 4000, max_lists=2).parts.tolist())
    assert cell > 400 or min(knn.fit(x, 4000, max_lists=2).parts) > 1
    assert recall(spark, x, max_lists=2)[0] >= 0.9


def test_exact_on_noise(spark):
    x = np.random.default_rng(4).standard_normal((1200, 64)).astype(np.float32)
    share, equal = recall(spark, x, exact=True, max_lists=8)
    assert share == 1.0 and all(equal)


def test_sample_of_a_huge_table_is_not_empty(spark, monkeypatch):
    monkeypatch.setattr(knn, "SAMPLE", 40)  # a small share of the table
    x = clusters(2000, seed=6)
    assert recall(spark, x)[0] >= 0.9
    assert len(knn.fit(np.zeros((0, 64), np.float32), 10**12).centroids) == 1


def test_sublists():
    x = clusters(3000, seed=8)
    home = np.array([0] * 2000 + [1] * 900 + [-1] * 100)
    fine, probes = knn.sublists(x, home, [np.array([0, 1])] * 3000, 12)
    assert (fine[2900:] == -1).all() and set(fine[:2000]).isdisjoint(fine[2000:2900]) and len(set(fine[:2000])) >= 10
    assert all(len(p) <= 12 for p in probes) and np.mean([f in p for f, p in zip(fine[:2900], probes)]) > 0.99
