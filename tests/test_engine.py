import numpy as np
import pytest

from sparkquarry.config import Settings
from sparkquarry.engine import NOTHING_FOUND, Engine
from sparkquarry.operators.embedding import embed
from sparkquarry.schema import chunks, vectors


def encoder():
    def encode(texts):
        out = np.zeros((len(texts), 16))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                out[i, sum(map(ord, w)) % 16] += 1
            out[i, 0] += 0.01
        return out

    return encode


META = "pos long, chunk_id long, text string, source string, chapter string, file_type string"


@pytest.fixture(scope="module")
def engine(spark):
    rows = [(i, i, f"The {w} stood at the gate of stone.", f"Book {i % 2}.txt", None, "txt") for i, w in enumerate(["captain", "siren", "lantern", "harbour", "vault", "banner"])]
    meta = spark.createDataFrame(rows, META)
    embedded = embed(meta.select("chunk_id", "text"), encoder)
    e = Engine(spark, chunks(meta), vectors(embedded), encoder, Settings(candidate_pool=6, top_k=2, stitching_window=1), lambda s, u: f"{len(s)}|{u}")
    e.meta = meta
    return e


def test_search_and_inspect(engine):
    hits = engine.search("Where is the lantern", top_k=3)
    assert len(hits) == 3 and hits[0]["chunk_id"] == 2 and "harbour" in hits[0]["text"]
    got = engine.inspect("Where is the lantern")
    assert got["terms"] == ["lantern"] and len(got["dense"]) == 5 and len(got["stitched"]) == 2
    assert "lantern" in got["prompt"]["system_prompt"]
    for bad in ("", "  "):
        with pytest.raises(ValueError):
            engine.search(bad)
    with pytest.raises(ValueError):
        engine.search("x", top_k=21)


def test_filters(engine):
    assert {h["source"] for h in engine.search("gate", book_filter="BOOK 1")} == {"Book 1.txt"}
    assert engine.search("gate", source_filter=["none"]) == []


def test_ask_and_memory(engine):
    for i in range(6):
        answer = engine.ask(f"lantern {i}", session_id="s")
    assert answer["chunks_used"] == len(answer["sources"]) == 2
    assert [t["query"] for t in engine.memory("s")] == [f"lantern {i}" for i in range(2, 6)]
    assert "lantern 1" in answer["response"] and engine.memory("other") == []
    engine.clear_memory("s")
    engine.clear_memory("unknown")
    assert engine.memory("s") == []
    assert engine.ask("x", session_id="n", source_filter=["none"])["response"] == NOTHING_FOUND and engine.memory("n") == []


def test_info(engine, spark):
    log = spark.createDataFrame([("2026-01-02T03:04:05", 5, 2, "M", "Healthy"), ("03/01/2026 10:00", 6, 2, "M2", None)], "build_date string, total_chunks long, total_files long, model string, status string")
    got = engine.info(log)
    assert (got["index_vectors"], got["index_dim"], got["cached_sources"]) == (6, 16, 2)
    assert (got["last_build"], got["total_chunks"], got["model"], got["status"], got["top_k"]) == ("2026-01-03 10:00:00", 6, "m2", "unknown", 2)


def test_reports(engine):
    report = engine.verify(engine.meta)
    assert report["coverage"] == {"chunks": 6, "vectors": 6, "with_vector": 6, "gap": 0} and report["gaps"] == 0
    assert report["dimensions"] == [{"dim": 16, "n": 6}] and len(report["previews"]) == 3
    assert [r["source"] for r in engine.sources().collect()] == ["Book 0.txt", "Book 1.txt"]
    assert engine.source_chunks("book 1", 2).count() == 2 and engine.health()["chunks"] == engine.health()["vectors"] == 6 and engine.health()["status"] == "online"
