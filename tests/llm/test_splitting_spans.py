import itertools
import random

import numpy as np
import pytest

from sparkquarry.llm import spans, splitting
from sparkquarry.llm.spans import SharedSpans

META = "chunk_id long, text string, source string, start int"


def test_range_maximum(monkeypatch):
    random.seed(1)
    v = np.array([random.randint(0, 5) for _ in range(177)], np.int8)
    t = splitting.RangeMaximum(v, 60)
    monkeypatch.setattr(splitting, "STRETCH", 10)
    short = splitting.RangeMaximum(v, 60)
    for _ in range(500):
        a = random.randrange(176)
        b = min(176, a + random.randrange(60))
        assert short.place(a, b) == t.place(a, b) and len(short.levels) <= 6
        best = max(v[a : b + 1])
        assert t.place(a, b) == max(i for i in range(a, b + 1) if v[i] == best)


@pytest.mark.parametrize("text", ["word " * 900, "x" * 9000, "A sentence here. " * 300, ("para " * 50 + "\n\n") * 20, "é" * 1999 + " " + "b" * 5000, "短い文。" * 1200])
@pytest.mark.parametrize(("limit", "overlap"), [(2000, 200), (50, 0), (50, 49), (10, 3)])
def test_cuts(text, limit, overlap):
    cuts = splitting.cuts(text, limit, overlap)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    for (a, b), (c, d) in itertools.pairwise(cuts):
        assert a < c and b < d and b - a <= limit
        assert (c == b) if not overlap else 1 <= b - c <= overlap
    assert len(text) <= limit or all(b - a <= limit for a, b in cuts)


def test_memory_of_a_long_text():
    import tracemalloc

    text = "Some words, and more. " * 100_000
    s = splitting.strengths(text)
    tracemalloc.start()
    splitting.RangeMaximum(s, 2001).place(2_000_000, 2_001_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6


def test_cuts_prefer_strong_boundaries():
    text = "one two three. " * 100 + "\n\n" + "four five six. " * 100
    (a, b), *_ = splitting.cuts(text, 2000, 100)
    assert text[b - 2 : b] == "\n\n"


def test_split_texts(spark):
    long = "Some words. " * 400
    rows = [(1, long, "s", 1), (1, long, "s", 2), (2, "  " + "y" * 2000 + "  ", "s", 1), (3, None, "s", 1), (4, "", None, 1), (5, " " * 3000, "s", 1), (None, "z" * 2001, None, 1)]
    got = splitting.split_texts(spark.createDataFrame(rows, META)).collect()
    assert {r["chunk_id"] for r in got} == {1, None}
    mine = sorted((r["piece"], r["start"], r["text"]) for r in got if r["chunk_id"] == 1)
    assert [p for p, _, _ in mine] == list(range(1, len(mine) + 1))
    text = ""
    for _, start, piece in mine:
        assert len(piece) <= 2000
        text = text[:start] + piece
    assert text == long.strip()
    assert splitting.split_texts(spark.createDataFrame([], META)).count() == 0
    with pytest.raises(ValueError):
        splitting.split_texts(spark.createDataFrame([], META), limit=10, overlap=10)


def brute(docs, n):
    where = {}
    for i, t in docs:
        for k in range(len(t or "") - n + 1):
            where.setdefault(t[k : k + n], set()).add(i)
    pairs, covered = set(), {}
    for s in where.values():
        pairs |= set(itertools.combinations(sorted(s), 2))
    for i, t in docs:
        own = set()
        for k in range(len(t or "") - n + 1):
            if len(where[t[k : k + n]]) > 1:
                own |= set(range(k, k + n))
        if own:
            covered[i] = len(own)
    return pairs, covered


def random_docs(seed, n, alphabet="abc", size=60):
    random.seed(seed)
    parts = ["".join(random.choices(alphabet, k=random.randint(5, size))) for _ in range(12)]
    return [(i, "".join(random.choices(parts, k=random.randint(0, 4))) + random.choice(["", "x" * 50, "y" * random.randint(0, 40)])) for i in range(n)]


@pytest.mark.parametrize(("seed", "limit"), [(1, 4000), (2, 2), (3, 0), (4, 9), (5, 4000)])
def test_spans_equal_brute_force(spark, monkeypatch, seed, limit):
    monkeypatch.setattr(spans, "GROUP_SUFFIXES", limit)  # 0 and 2: groups are split by the longer prefixes, and by the whole length
    monkeypatch.setattr(spans, "BLOCK", 64)  # most texts come in slices
    docs = random_docs(seed, 40)
    docs += [(100 + i, t) for i, t in docs[:4]]  # copies
    df = spark.createDataFrame(docs, "doc_id long, text string")
    shared = SharedSpans(df, length=20, gram=6)
    pairs, covered = brute(docs, 20)
    assert {tuple(r) for r in shared.pairs().collect()} == pairs
    assert {r["doc_id"]: r["shared_chars"] for r in shared.coverage().collect()} == covered


def test_spans_edges(spark):
    p = "0123456789" * 20
    rows = [(1, p, 9), (2, "é" + p + "!", 9), (2, "é" + p + "!", 9), (3, p[:199], 9), (4, None, 9), (5, "", 9), (None, p, 9), (6, "\t" * 3000, 9), (7, "\t" * 250 + "z", 9), (8, "😀" * 100 + "a" * 100, 9), (9, "😀" * 100 + "a" * 99, 9)]
    shared = SharedSpans(spark.createDataFrame(rows, "doc_id long, text string, name int"))
    assert {tuple(r) for r in shared.pairs().collect()} == {(1, 2), (6, 7)}
    assert {tuple(r)[:2] for r in shared.coverage().collect()} == {(1, 200), (2, 200), (6, 3000), (7, 250)}
    empty = SharedSpans(spark.createDataFrame([], "doc_id string, text string"))
    assert empty.pairs().count() == 0 and empty.coverage().count() == 0
