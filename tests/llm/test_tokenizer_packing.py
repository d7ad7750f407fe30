import base64
import random

import pytest
from pyspark.sql import functions as F

from sparkquarry.llm import packing, tokenizer
from sparkquarry.llm.tokenizer import Encoder, PairTree, encode_corpus, read_vocabulary, token_sizes, vocabulary_path

TEXTS = [None, "", " ", "Hello world", "it's 3,000 <|endoftext|> naïve — “quoted”", "\t\t\n\n  x", "a" * 3000, "ab" * 5000, "日本語 текст 𐌸", "x y" * 400, "don't\r\n"]


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, read_vocabulary(vocabulary_path()).splitlines())}
    return tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_a_public_encoder(spark, reference):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 1), (None, "null id", 1)], "doc_id long, text string, ids int")
    got = encode_corpus(df).collect()
    assert len(got) == len(df.collect())
    for r in got:
        t = "null id" if r["doc_id"] is None else TEXTS[r["doc_id"]]
        assert r["ids"] == (reference.encode_ordinary(t) if t else [])
    sizes = {r["doc_id"]: r["tokens"] for r in token_sizes(df).collect()}
    assert sizes[3] == len(reference.encode_ordinary(TEXTS[3])) and sizes[0] == sizes[1] == 0


def test_random_texts(reference):
    e = Encoder(read_vocabulary(vocabulary_path()))
    random.seed(2)
    for _ in range(300):
        t = "".join(random.choice("aeiou tnsr\n1'é—😀") for _ in range(random.randint(0, 60)))
        assert list(e.encode(t)) == reference.encode_ordinary(t)


def test_pair_tree():
    random.seed(4)
    keys = [random.randint(0, 99) for _ in range(13)]
    tree = PairTree(list(keys))
    for _ in range(200):
        i = random.randrange(13)
        keys[i] = random.randint(0, 99)
        tree.set(i, keys[i])
        assert tree.root() == min(keys)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert encode_corpus(df).count() == 0
    assert packing.pack(token_sizes(df)).count() == 0


def check_packing(sizes, rows, capacity):
    used = {}
    pieces = {}
    for r in rows:
        used[r["container_id"]] = used.get(r["container_id"], 0) + r["tokens"]
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["tokens"]))
    assert max(used.values()) <= capacity
    assert set(pieces) == {i for i, s in sizes.items() if s}
    for i, own in pieces.items():
        assert sum(t for _, t in own) == sizes[i]
        assert sorted(p for p, _ in own) == list(range(1, len(own) + 1))
        assert len(own) == -(-sizes[i] // capacity)
    return len(used)


def best_fit_decreasing(sizes, capacity):
    """Containers of the offline heuristic that sees all items first."""
    rooms = []
    alone = sum(s // capacity for s in sizes)
    for s in sorted((s % capacity for s in sizes if s % capacity), reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - s)
    return alone + len(rooms)


def test_packing(spark, monkeypatch):
    random.seed(8)
    sizes = {i: random.choice([0, 3, 50, 200, 600, 1024, 1025, 5000]) for i in range(3000)}
    df = spark.createDataFrame([(i, s, "x") for i, s in sizes.items()], "doc_id long, tokens int, container_id string")
    one = packing.pack(df)
    offline = best_fit_decreasing(sizes.values(), 1024)
    assert check_packing(sizes, one.collect(), 1024) <= 1.02 * offline
    again = {(r["doc_id"], r["piece"]): r["container_id"] for r in packing.pack(df.orderBy(F.rand(1))).collect()}
    assert again == {(r["doc_id"], r["piece"]): r["container_id"] for r in one.collect()}
    monkeypatch.setattr(packing, "ROWS_PER_TASK", 150)  # several tasks, two rounds of merging
    monkeypatch.setattr(packing, "MERGE_FANIN", 4)
    assert check_packing(sizes, packing.pack(df, open_windows=8).collect(), 1024) <= 1.05 * offline


def test_merge_tree_is_bounded(spark, monkeypatch):
    """Many tasks: only windows left open are merged, at most fan-in x windows in a step, and containers are full."""
    monkeypatch.setattr(packing, "ROWS_PER_TASK", 500)
    monkeypatch.setattr(packing, "MERGE_FANIN", 8)
    seen = []
    inner = packing.materialize

    def watch(df, name):
        out = inner(df, name)
        if name == "merged":
            seen.append([r["n"] for r in out.filter("container_id IS NOT NULL").groupBy("task").count().withColumnRenamed("count", "n").collect()] + [out.filter("container_id IS NOT NULL").count()])
        return out

    monkeypatch.setattr(packing, "materialize", watch)
    random.seed(3)
    sizes = {i: min(1024, int(random.expovariate(1 / 260)) + 1) for i in range(22_000)}
    rows = packing.pack(spark.createDataFrame(list(sizes.items()), "doc_id long, tokens int"), open_windows=16).collect()
    made = check_packing(sizes, rows, 1024)
    assert len(seen) == 2 and seen[0][-1] <= 44 * 16 and seen[1][-1] <= 8 * 16
    assert sum(sizes.values()) / 1024 >= 0.99 * made


def test_packing_keeps_large_ids_beside_nulls(spark):
    rows = [(2**60 + 1, 5), (None, 7), (2**60 + 3, 6)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, tokens int")).collect()
    assert {(r["doc_id"], r["tokens"]) for r in got} == set(rows)


def test_packing_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (2, None), (3, -4), (None, 7)], "doc_id long, tokens int")
    rows = packing.pack(df, capacity=10).collect()
    assert sorted(((r["doc_id"] or 0), r["tokens"]) for r in rows) == [(0, 7), (1, 5), (1, 5)]
    with pytest.raises(ValueError):
        packing.pack(df, capacity=0)
