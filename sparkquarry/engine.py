"""One object for callers that ask question by question: search, inspect, answer, memory, catalog."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .operators import catalog, prompting
from .operators.embedding import Factory, query_vectors
from .operators.hybrid import Retrieval, Scorer
from .operators.scan import bm25_index, bm25_stats
from .runtime import materialize, scratch
from .schema import vectors as unit_vectors
from .sources.files import require

REQUEST = "query_id long, query string, top_k int, candidate_pool int, stitching_window int, book_filter string, source_filter array<string>"
#: Turns (system prompt, user message) into an answer.
Generate = Callable[[str, str], str]
NOTHING_FOUND = "No relevant passages were found."


class Engine:
    """An index of chunks (``schema.chunks``) and unit vectors (``schema.vectors``) that answers questions.

    The tables, the BM25 index and its statistics are written once when the engine is made. ``encoder`` makes vectors of
    questions; ``generate`` calls a language model; ``scorer`` re-ranks. Session memory
    keeps the last turns of each session in the driver: answers are small and bounded.
    """

    def __init__(self, spark: SparkSession, chunks: DataFrame, vectors: DataFrame, encoder: Factory, settings: Settings = Settings(), generate: Generate | None = None, scorer: Scorer | None = None, templates: prompting.Templates = prompting.Templates()):
        self.spark, self.settings, self.templates = spark, settings, templates
        self.chunks, self.vectors = materialize(chunks, "chunks"), materialize(vectors, "vectors")
        self._check_dimensions(encoder)
        self.postings = materialize(bm25_index(self.chunks), "postings")
        terms, corpus = bm25_stats(self.postings, stored=True)
        self.stats = terms, materialize(corpus, "corpus")
        self.encoder, self.generate, self.scorer = encoder, generate, scorer if settings.rerank else None
        self._memory: dict[str, list[dict[str, str]]] = {}

    @classmethod
    def open(cls, spark: SparkSession, index: str, encoder: Factory, **options) -> Engine:
        """The engine over what ``streaming.ingest`` wrote; a missing table is an error that names it."""
        for name in ("chunks", "vectors"):
            require(spark, f"{index}/{name}", name)
        chunks = spark.read.parquet(f"{index}/chunks").select("chunk_id", "text", "source", "chapter", "file_type")
        return cls(spark, chunks, unit_vectors(spark.read.parquet(f"{index}/vectors")), encoder, **options)

    def _check_dimensions(self, encoder: Factory) -> None:
        """Refuses vectors of several lengths, and an encoder that makes others than the index holds, before any search."""
        have = sorted(r["dim"] for r in catalog.vector_dimensions(self.vectors, "vec").collect())
        makes = len(encoder()(["dimension"])[0])
        if have and have != [makes]:
            raise ValueError(f"the index has vectors of {have} numbers, the encoder makes {makes}")

    def _retrieval(self, query: str, top_k=None, candidate_pool=None, stitching_window=None, book_filter=None, source_filter: Sequence[str] | None = None) -> Retrieval:
        if not query or not query.strip():
            raise ValueError("the question is blank")
        for name, value, most in (("top_k", top_k, 20), ("candidate_pool", candidate_pool, 100), ("stitching_window", stitching_window, 6)):
            if value is not None and not 0 <= value <= most:
                raise ValueError(f"{name} must be from 0 to {most}; 0 means the default")
        row = (0, query, top_k, candidate_pool, stitching_window, book_filter, list(source_filter) if source_filter else None)
        requests = self.spark.createDataFrame([row], REQUEST)
        return Retrieval(requests, query_vectors(requests, self.encoder), self.chunks, self.vectors, self.settings, self.scorer, stored=True, postings=self.postings, stats=self.stats)

    def search(self, query: str, **options) -> list[dict[str, Any]]:
        """Hits in rank order; options are top_k, candidate_pool, stitching_window, book_filter, source_filter."""
        with scratch():
            return [r.asDict() for r in self._retrieval(query, **options).search().orderBy("rank").collect()]

    def inspect(self, query: str, **options) -> dict[str, Any]:
        """The stages of a search without re-ranking, and the prompt they would give."""
        with scratch():
            return self._inspect(query, **options)

    def _inspect(self, query: str, **options) -> dict[str, Any]:
        r = self._retrieval(query, **options)
        stages = r.inspect()
        order = {"terms": "query_id", "dense": "rank", "bm25": "rank", "grounded": "grounded_rank", "stitched": "grounded_rank"}
        out = {name: [row.asDict() for row in df.orderBy(order[name]).collect()] for name, df in stages.items()}
        out["terms"] = out["terms"][0]["terms"]
        prompt = prompting.prompts(r.requests, r.stitched.withColumn("rank", F.col("grounded_rank")), "standard", self.templates).first()
        return out | {"prompt": {"system_prompt": prompt["system_prompt"][:4000], "user_message": prompt["user_message"]}}

    def ask(self, query: str, session_id: str = "default", mode: str = "standard", **options) -> dict[str, Any]:
        """The answer with its sources; without hits a fixed one that isn't remembered."""
        if self.generate is None:
            raise ValueError("no language model was given")
        with scratch():
            return self._ask(query, session_id, mode, **options)

    def _ask(self, query: str, session_id: str, mode: str, **options) -> dict[str, Any]:
        r = self._retrieval(query, **options)
        hits = materialize(r.search(), "hits")
        sources = [row.asDict() for row in prompting.source_payload(hits).orderBy("rank").drop("query_id").collect()]
        if not sources:
            return {"query": query, "response": NOTHING_FOUND, "sources": [], "chunks_used": 0}
        memory = None
        if turns := self._memory.get(session_id):
            rows = [(session_id, i, t["query"], t["response"]) for i, t in enumerate(turns)]
            last = prompting.last_turns(self.spark.createDataFrame(rows, "session_id string, turn int, query string, response string"), self.settings)
            memory = prompting.format_memory(last, self.settings, self.templates).select(F.lit(0).cast("long").alias("query_id"), "memory")
        prompt = prompting.prompts(r.requests, hits, mode, self.templates, memory).first()
        response = self.generate(prompt["system_prompt"], prompt["user_message"])
        self._memory[session_id] = [*self._memory.get(session_id, []), {"query": query, "response": response}][-self.settings.memory_turns :]
        return {"query": query, "response": response, "sources": sources, "chunks_used": len(sources)}

    def memory(self, session_id: str) -> list[dict[str, str]]:
        return [dict(t) for t in self._memory.get(session_id, [])]

    def clear_memory(self, session_id: str) -> None:
        self._memory.pop(session_id, None)

    def sources(self) -> DataFrame:
        return catalog.list_sources(self.chunks)

    def source_chunks(self, name: str, limit: int = 20) -> DataFrame:
        return catalog.source_chunks(self.chunks, name, limit)

    def health(self) -> dict[str, Any]:
        """Whether the engine is usable, and how it is set up."""
        chunks = self.chunks.count()
        have = {"chunks": chunks, "vectors": self.vectors.count(), "generator": self.generate is not None, "scorer": self.scorer is not None}
        return {"status": "online" if chunks else "empty", **have, "sessions": len(self._memory), "settings": self.settings}

    def info(self, log: DataFrame) -> dict[str, Any]:
        """What the index holds, its newest build (of the manifests in ``log``) and the settings of retrieval."""
        return catalog.info(self.chunks, self.vectors, log, self.settings).first().asDict()

    def verify(self, metadata: DataFrame, failures: DataFrame | None = None) -> dict[str, Any]:
        """The soundness report of an index: coverage, dimensions, gaps, distributions, previews, failures."""
        rows = lambda df: [r.asDict() for r in df.collect()]
        out = {
            "coverage": rows(catalog.vector_coverage(self.chunks, self.vectors))[0],
            "dimensions": rows(catalog.vector_dimensions(self.vectors, "vec")),
            "gaps": catalog.id_gaps(metadata).first()["gaps"],
            "sources": rows(catalog.distribution(self.chunks, "source", 15)),
            "file_types": rows(catalog.distribution(self.chunks, "file_type")),
            "previews": rows(catalog.previews(self.chunks)),
        }
        return out | ({"failures": rows(catalog.failure_reasons(failures))} if failures is not None else {})
