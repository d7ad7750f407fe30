import ast
import os

import pytest

from sparkquarry import config
from sparkquarry.operators import catalog
from sparkquarry.runtime import drop_materialized, materialize, shared_dir

META = "pos long, chunk_id long"


def test_id_gaps(spark):
    ids = [0, 1, 2, 5, 5, 4, 6, None, 8]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], META)
    filled = [x if x is not None else i for i, x in enumerate(ids)]
    assert catalog.id_gaps(rows).first()["gaps"] == sum(b - a != 1 for a, b in zip(filled, filled[1:]))
    assert catalog.id_gaps(rows.limit(0)).first()["gaps"] == 0


def test_failures(spark):
    rows = [("a", "Empty content.", "2031-01-01"), ("a", "locked", "2031-02-01"), ("b", " EMPTY content ", "2031-01-01"), ("c", None, "2031-01-01")]
    df = spark.createDataFrame(rows, "file_name string, error string, failed_at string")
    assert {(r["reason"], r["n"]) for r in catalog.failure_reasons(df).collect()} == {("locked", 1), ("empty content", 1), ("unknown", 1)}


def test_source_chunks_limit(spark):
    df = spark.createDataFrame([(i, f"Book {i % 2}") for i in range(9)], "chunk_id long, source string")
    assert [r["chunk_id"] for r in catalog.source_chunks(df, "BOOK 1", 2).collect()] == [1, 3]
    with pytest.raises(ValueError):
        catalog.source_chunks(df, "x", 0)


def test_profiles():
    assert config.load("query", {}).top_k == 6
    assert config.load(None, {"SPARKQUARRY_PROFILE": "query", "SPARKQUARRY_TOP_K": "3", "SPARKQUARRY_RERANK": "yes"}) == config.Settings(20, 3, 2, 60, True, 400)
    for env in ({"SPARKQUARRY_TOP_K": "x"}, {"SPARKQUARRY_TOP_K": "0"}, {"SPARKQUARRY_PROFILE": "none"}):
        with pytest.raises(ValueError):
            config.load(None, env)


def test_materialize(spark):
    df = materialize(spark.range(5), "t")
    assert df.count() == 5 and shared_dir(spark).removeprefix("file://") in df.inputFiles()[0]
    path = df.inputFiles()[0].removeprefix("file://")
    drop_materialized()
    assert not os.path.exists(path)


def test_nothing_imports_the_llm_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(root, "sparkquarry")):
        if os.sep + "llm" in folder:
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    for node in ast.walk(ast.parse(f.read())):
                        if isinstance(node, ast.ImportFrom):
                            assert "llm" not in (node.module or "").split(".") and "llm" not in [a.name for a in node.names]
