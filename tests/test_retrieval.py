import math
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkquarry.config import Settings
from sparkquarry.functions import text as T
from sparkquarry.operators.hybrid import Retrieval, apply_filters, ground, rerank, rrf_merge, stitch
from sparkquarry.operators.requests import normalise
from sparkquarry.operators.scan import bm25_index, bm25_topk, dense_topk
from sparkquarry.schema import chunks as chunk_table
from sparkquarry.schema import vectors as vector_table

S = Settings(candidate_pool=4, top_k=3, stitching_window=1)
CHUNKS = "chunk_id long, text string, source string, chapter string, file_type string"
REQUEST = "query_id long, query string, top_k int, candidate_pool int, stitching_window int, book_filter string, source_filter array<string>"


def corpus(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, (sources or {}).get(i, "a.txt"), "unknown", "txt") for i, t in enumerate(texts)], CHUNKS)


def asked(spark, *queries, **kw):
    rows = [(i, q, kw.get("top_k"), kw.get("pool"), kw.get("win"), kw.get("book"), kw.get("sources")) for i, q in enumerate(queries)]
    return normalise(spark.createDataFrame(rows, REQUEST), S)


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_query_terms(spark):
    assert one(spark, T.query_terms, "What is the story of battle") == []
    assert one(spark, T.query_terms, "The THIRD gate, the gate's five") == ["3", "3rd", "5", "five", "gate", "gate's", "iii", "third", "v"]


def test_term_matching_is_substring(spark):
    df = spark.createDataFrame([(["v", "gate"], "investigate")], "t array<string>, h string")
    assert df.select(T.matched_terms(F.col("t"), F.col("h")).alias("m")).first()["m"] == ["v", "gate"]


def test_intent_and_html(spark):
    assert [one(spark, T.intent, q) for q in ("Who is he", "archive", "warden", "hello")] == ["lore_lookup", "summarization", "battle_reconstruction", "narrative_generation"]
    assert one(spark, T.html_to_text, "<p>a &lt;b&gt; &amp;lt;</p><script>x<y</script><!-- c --> d") == "a <b> &lt; d"


def test_display_score(spark):
    df = spark.createDataFrame([(0.0, 2.0, 3.0, 4.0), (-1.0, 2.0, 3.0, 4.0), (None, 0.0, None, 0.5), (None, None, None, None)], "a double, b double, c double, d double")
    assert [r[0] for r in df.select(T.display_score(*map(F.col, "abcd"))).collect()] == [2.0, -1.0, 0.5, 0.0]


def test_requests_defaults(spark):
    rows = asked(spark, "x", "  ", None, top_k=0, win=0, book="", sources=[]).collect()
    assert [(r["query_id"], r["top_k"], r["win"], r["book_filter"], r["source_filter"]) for r in rows] == [(0, 3, 1, None, None)]


def test_chunk_table(spark):
    rows = [(0, 7, "old", None, None, None), (3, 7, None, "s", "c", "pdf"), (1, None, "t", "s", None, "TXT"), (None, None, "lost", "s", None, None)]
    got = {r["chunk_id"]: tuple(r)[1:] for r in chunk_table(spark.createDataFrame(rows, "pos long, chunk_id long, text string, source string, chapter string, file_type string")).collect()}
    assert got == {7: ("", "s", "c", "pdf"), 1: ("t", "s", "unknown", "TXT")}


def test_vectors_unit(spark):
    rows = [(1, [3.0, 4.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (1, [3.0, 4.0]), (None, [1.0, 0.0])]
    got = vector_table(spark.createDataFrame(rows, "chunk_id long, embedding array<float>"), dim=2).collect()
    assert [(r["chunk_id"], [round(x, 6) for x in r["vec"]]) for r in got] == [(1, [0.6, 0.8])]


def test_dense_ties_and_small_corpus(spark):
    v = spark.createDataFrame([(5, [1.0, 0.0]), (2, [1.0, 0.0]), (9, [0.0, 1.0])], "chunk_id long, vec array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, qvec array<double>")
    hits = dense_topk(asked(spark, "x", "y", pool=10), q, v).orderBy("rank").collect()
    assert [(r["query_id"], r["chunk_id"], r["rank"]) for r in hits] == [(0, 2, 0), (0, 5, 1), (0, 9, 2)]
    with pytest.raises(Exception, match="numbers"):
        dense_topk(asked(spark, "x"), spark.createDataFrame([(0, [1.0])], "query_id long, qvec array<double>"), v).collect()


def okapi(texts, query, k1=1.5, b=0.75, eps=0.25):
    docs = [t.lower().split() for t in texts]
    df = Counter(w for d in docs for w in set(d))
    raw = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: x if x >= 0 else eps * mean for w, x in raw.items()}
    avg = sum(map(len, docs)) / len(docs)
    return [sum(idf.get(w, 0) * d.count(w) * (k1 + 1) / (d.count(w) + k1 * (1 - b + b * len(d) / avg)) for w in query.lower().split()) for d in docs]


def test_bm25_against_formula(spark):
    random.seed(3)
    texts = [" ".join(random.choices("a b c d e f, G".split(), k=random.randint(0, 9))) for _ in range(25)]
    for query in ("a a b", "zzz", "G f, c"):
        want = okapi(texts, query)
        order = sorted(range(len(texts)), key=lambda i: (-round(want[i], 9), -i))[:7]
        got = bm25_topk(asked(spark, query, pool=7), bm25_index(corpus(spark, texts)), S).orderBy("rank").collect()
        assert [r["chunk_id"] for r in got] == order
        assert all(abs(r["score"] - want[r["chunk_id"]]) < 1e-9 for r in got)


def test_bm25_empty_corpus(spark):
    assert bm25_topk(asked(spark, "x"), bm25_index(corpus(spark, [])), S).count() == 0


HIT = "query_id long, chunk_id long, rank int, score double"


def fused(spark, texts, dense, bm25, pool=4):
    hits = lambda ids: spark.createDataFrame([(0, c, r, 1.0 + c) for r, c in enumerate(ids)], HIT)
    rows = rrf_merge(asked(spark, "x", pool=pool), hits(dense), hits(bm25), corpus(spark, texts), S).orderBy("merged_rank").collect()
    return [r["chunk_id"] for r in rows], rows


def test_rrf_by_hand(spark):
    # c stands in both lists, a and d have one text: 1/60 + 1/62 for it, 1/61 + 1/60 for c
    ids, rows = fused(spark, list("abca"), [0, 2, 3], [2, 1])
    assert ids == [2, 3, 1] and [r["merged_rank"] for r in rows] == [0, 1, 2]
    assert [round(r["rrf_score"], 12) for r in rows] == [round(x, 12) for x in (1 / 61 + 1 / 60, 1 / 60 + 1 / 62, 1 / 61)]
    assert [(r["dense_rank"], r["bm25_rank"]) for r in rows] == [(1, None), (2, None), (None, 1)]  # the last dense hit stands for a text
    assert [(r["dense_score"], r["bm25_score"]) for r in rows] == [(3.0, None), (4.0, None), (None, 2.0)]
    # only in BM25: the first hit stands for a text; equal scores keep the order of meeting, dense first
    assert fused(spark, list("abccb"), [0], [1, 4, 2])[0] == [1, 0, 2]
    assert fused(spark, list("abcdef"), [5, 4], [3, 2])[0] == [5, 3, 4, 2]
    assert fused(spark, list("abcdef"), [5, 4], [3, 2], pool=1)[0] == [5]
    assert fused(spark, list("ab"), [], [])[0] == []


def test_rrf_scores_follow_the_formula(spark):
    random.seed(5)
    texts = [random.choice("pqrstuvw") for _ in range(12)]
    for _ in range(4):
        lists = [random.sample(range(12), 6) for _ in range(2)]
        score = {t: sum(1 / (60 + r) for ids in lists for r, c in enumerate(ids) if texts[c] == t) for t in {texts[c] for ids in lists for c in ids}}
        ids, rows = fused(spark, texts, *lists, pool=20)
        assert {texts[r["chunk_id"]]: round(r["rrf_score"], 12) for r in rows} == {t: round(x, 12) for t, x in score.items()}
        assert len(ids) == len(score) and [r["rrf_score"] for r in rows] == sorted((r["rrf_score"] for r in rows), reverse=True)


def stitched(spark, hits, window):
    """(text, range) of hits among chunks 0-3 of one source and 5-6 of another; 4 is missing."""
    texts = {i: f" t{i} " for i in (0, 1, 2, 3, 5, 6)}
    chunks = spark.createDataFrame([(i, t, "s" if i < 4 else "u", "c", "txt") for i, t in texts.items()], CHUNKS)
    rows = spark.createDataFrame([(0, r, c, texts[c]) for r, c in enumerate(hits)], "query_id long, grounded_rank int, chunk_id long, text string")
    out = stitch(rows, spark.createDataFrame([(0, window)], "query_id long, win int"), chunks).orderBy("grounded_rank").collect()
    return [(r["text"].replace("\n\n", "+"), r["stitch_range"]) for r in out]


def test_stitch_by_hand(spark):
    assert stitched(spark, [2, 3, 5], 0) == [(" t2 ", None), (" t3 ", None), (" t5 ", None)]
    assert stitched(spark, [2, 3, 5], 1) == [("t1+t2+t3", "chunk_id 1-3"), (" t3 ", None), ("t5+t6", "chunk_id 5-6")]  # 3 owns none: 2 and 3 are taken, 4 is missing
    assert stitched(spark, [2, 3, 5], 2) == [("t0+t1+t2+t3", "chunk_id 0-3"), ("t5", "chunk_id 5-5"), ("t6", "chunk_id 6-6")]  # across sources
    assert stitched(spark, [2, 3, 5], 6) == [("t0+t1+t2+t3+t5+t6", "chunk_id 0-6"), (" t3 ", None), (" t5 ", None)]
    assert stitched(spark, [6, 0, 5], 1) == [("t5+t6", "chunk_id 5-6"), ("t0+t1", "chunk_id 0-1"), (" t5 ", None)]


def test_each_neighbour_belongs_to_its_best_hit(spark):
    random.seed(9)
    for window in (1, 2):
        hits = random.sample((0, 1, 2, 3, 5, 6), 4)
        owner = {n: min((r for r, c in enumerate(hits) if abs(c - n) <= window), default=None) for n in (0, 1, 2, 3, 5, 6)}
        for r, (text, span) in enumerate(stitched(spark, hits, window)):
            own = [n for n in sorted(owner) if owner[n] == r]
            assert (text, span) == (("+".join(f"t{n}" for n in own), f"chunk_id {own[0]}-{own[-1]}") if own else (f" t{hits[r]} ", None))


def test_stitch_identity(spark):
    chunks = spark.createDataFrame([(0, "a", "s", "c", "txt"), (1, "b", "s", "c", "txt")], CHUNKS)
    hits = spark.createDataFrame([(0, 0, 0, "a"), (1, 0, None, "x")], "query_id long, grounded_rank int, chunk_id long, text string")
    rows = stitch(hits, spark.createDataFrame([(0, 0), (1, 3)], "query_id long, win int"), chunks).orderBy("query_id").collect()
    assert [(r["text"], r["stitch_range"]) for r in rows] == [("a", None), ("x", None)]


def test_filters_and_grounding(spark):
    rows = [(0, 0, 1, 0.5, "Book One", "unknown", "the gate"), (0, 1, 2, 0.4, "book two", "unknown", "gate and wall"), (0, 2, 3, 0.4, "Other", "gate wall", "nothing")]
    merged = spark.createDataFrame(rows, "query_id long, merged_rank int, chunk_id long, rrf_score double, source string, chapter string, text string")
    req = asked(spark, "wall gate", book="BOOK")
    assert sorted(r["chunk_id"] for r in apply_filters(merged, req).collect()) == [1, 2]
    assert [r["chunk_id"] for r in apply_filters(merged, asked(spark, "x", sources=["Other"])).collect()] == [3]
    got = ground(merged, req).orderBy("grounded_rank").collect()
    assert [(r["chunk_id"], r["overlap"], r["overlap_terms"]) for r in got] == [(2, 2.0, ["gate", "wall"]), (3, 2.0, ["gate", "wall"]), (1, 1.0, ["gate"])]


def test_whole_search_and_rerank(spark):
    texts = [f"passage {i} of the gate" for i in range(7)]
    v = spark.createDataFrame([(i, [math.cos(i / 5), math.sin(i / 5)]) for i in range(7)], "chunk_id long, vec array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, qvec array<double>")
    req = spark.createDataFrame([(0, "passage 3 gate", None, None, None, None, None), (1, "nothing alike", None, None, None, "zzz", None)], REQUEST)
    shortest = lambda a, b: pd.Series([-float(len(x)) for x in b])
    plain = Retrieval(req, q, corpus(spark, texts), v, S)
    rows = plain.search().collect()
    assert {r["query_id"] for r in rows} == {0} and len(rows) == 3
    again = Retrieval(req, q, corpus(spark, texts), v, S, shortest).search().orderBy("rank").collect()
    assert {r["chunk_id"] for r in again} == {r["chunk_id"] for r in rows}
    assert [r["rerank_score"] for r in again] == sorted((r["rerank_score"] for r in again), reverse=True)
    assert set(plain.inspect()) == {"terms", "dense", "bm25", "grounded", "stitched"}


def test_rerank_leaves_single_hits(spark):
    rows = spark.createDataFrame([(0, 0, "t", 1.0)], "query_id long, grounded_rank int, text string, overlap double")
    assert rerank(rows, asked(spark, "x"), lambda a, b: pd.Series([1.0] * len(a))).first()["rerank_score"] is None


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, data):
    from sparkquarry.plans import core

    r = core.retrieval(spark, data)
    text = plan(r.stitched)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Exchange hashpartitioning(chunk_id" not in plan(r.bm25).split("MapInArrow")[0]
    scan = plan(core.sources_list(spark, data))
    assert "embedding" not in scan and "ingested_at" not in scan
