"""Contexts, prompts, source lists and session memory of answers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import display_score, strip
from ..functions.viewpoint import Rule, viewpoint

BETWEEN = "\n\n---\n\n"


@dataclass(frozen=True)
class Templates:
    """Wording of the prompts; {context} and {query} are filled in once, so they may occur in retrieved texts."""

    standard_system: str = "Answer only from the passages below.\n\nPASSAGES:\n{context}\n"
    narrate_system: str = "Retell the event as one continuous scene, only from the passages below.\n\nPASSAGES:\n{context}"
    explorer_system: str = "Describe the object precisely, only from the passages below.\n\nPASSAGES:\n{context}\n"
    standard_user: str = "Question: {query}"
    narrate_user: str = "Narrate: {query}"
    explorer_user: str = "Object: {query}"
    empty_context: str = "[No passages were found.]"
    empty_explorer: str = "[No relevant passages found.]"
    memory_intro: str = "[Earlier exchanges:]"
    memory_user: str = "User: "
    memory_answer: str = "Answer: "


def fill(template: str, name: str, value: Column) -> Column:
    """The template with its placeholder replaced; what is put in is never read as a template."""
    parts = template.split("{" + name + "}")
    out = [F.lit(parts[0])]
    for p in parts[1:]:
        out += [value, F.lit(p)]
    return F.concat(*out)


def header(rank: Column, with_viewpoint: bool, rules: Sequence[Rule] | None = None) -> Column:
    """Head of a passage, with what is known of it; needs source, chapter, stitch_range, file_type, text."""
    chapter = F.when((F.col("chapter") != "") & (F.col("chapter") != "unknown"), F.concat(F.lit(", "), F.col("chapter"))).otherwise("")
    span = F.when(F.coalesce("stitch_range", F.lit("")) != "", F.concat(F.lit(" ("), F.col("stitch_range"), F.lit(")"))).otherwise("")
    kind = F.when(F.coalesce("file_type", F.lit("")) != "", F.concat(F.lit(" ["), F.upper("file_type"), F.lit("]"))).otherwise("")
    head = F.concat(F.lit("[Passage "), (rank + 1).cast("string"), F.lit(" - "), F.col("source"), chapter, span, kind, F.lit("]"))
    if with_viewpoint:
        hint = viewpoint(F.col("source"), strip(F.col("text")), rules)
        head = F.concat(head, F.when(hint != "", F.concat(F.lit("\n[Viewpoint: "), hint, F.lit("]"))).otherwise(""))
    return head


def contexts(results: DataFrame, mode: str = "standard", rules: Sequence[Rule] | None = None) -> DataFrame:
    """(query_id, context): the passages of each question in rank order; ``results`` as of a search."""
    if mode == "explorer":
        head = F.concat(F.lit("["), F.col("source"), F.lit(" / "), F.col("chapter"), F.lit("]"))
    else:
        head = header(F.col("rank"), mode == "narrate", rules)
    passage = F.concat(head, F.lit("\n"), strip(F.col("text")))
    parts = results.select("query_id", "rank", passage.alias("passage")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "passage"))).alias("p"))
    return parts.select("query_id", F.array_join(F.transform("p", lambda x: x["passage"]), BETWEEN).alias("context"))


def prompts(requests: DataFrame, results: DataFrame, mode: str = "standard", templates: Templates = Templates(), memory: DataFrame | None = None) -> DataFrame:
    """(query_id, system_prompt, user_message) of every request; ``memory``: (query_id, memory) put before the question."""
    if mode not in ("standard", "narrate", "explorer"):
        raise ValueError(f"no mode {mode!r}")
    rows = requests.select("query_id", "query").join(contexts(results, mode), "query_id", "left")
    empty = templates.empty_explorer if mode == "explorer" else templates.empty_context
    user = fill(getattr(templates, f"{mode}_user"), "query", F.col("query"))
    if memory is not None:
        rows = rows.join(memory, "query_id", "left")
        user = F.when(F.coalesce("memory", F.lit("")) != "", F.concat(F.col("memory"), F.lit("\n\n"), user)).otherwise(user)
    return rows.select("query_id", fill(getattr(templates, f"{mode}_system"), "context", F.coalesce("context", F.lit(empty))).alias("system_prompt"), user.alias("user_message"))


def source_payload(results: DataFrame) -> DataFrame:
    """(query_id, rank, source, chapter, stitch_range, score) shown with an answer."""
    null = F.lit(None).cast("double")
    score = display_score(F.col("rerank_score") if "rerank_score" in results.columns else null, F.col("overlap"), F.col("rrf_score"), F.col("dense_score"))
    return results.select("query_id", "rank", "source", "chapter", F.coalesce("stitch_range", F.lit("")).alias("stitch_range"), F.round(score, 4).alias("score"))


def sources_json(payload: DataFrame) -> DataFrame:
    """(query_id, sources): the source list of each answer as a JSON array in rank order, as a service returns it."""
    rows = payload.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source", "chapter", "stitch_range", "score"))).alias("s"))
    return rows.select("query_id", F.to_json(F.transform("s", lambda x: x.dropFields("rank"))).alias("sources"))


def last_turns(turns: DataFrame, settings: Settings) -> DataFrame:
    """(session_id, turn, query, response, place): the last turns of every session; repeated rows count once, a null session is "default"."""
    rows = turns.select(F.coalesce("session_id", F.lit("default")).alias("session_id"), "turn", "query", "response").distinct()
    w = Window.partitionBy("session_id").orderBy(F.desc("turn"), F.desc("query"), F.desc("response"))
    return rows.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= settings.memory_turns)


def format_memory(last: DataFrame, settings: Settings, templates: Templates = Templates()) -> DataFrame:
    """(session_id, memory): the last turns as text, oldest first, answers cut."""
    lines = F.concat(
        F.lit(templates.memory_user), F.coalesce("query", F.lit("")), F.lit("\n" + templates.memory_answer), F.substring(F.coalesce("response", F.lit("")), 1, settings.memory_chars), F.lit("...")
    )
    own = last.select("session_id", F.col("back"), lines.alias("lines")).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("o"), "lines"))).alias("p"))
    return own.select("session_id", F.concat(F.lit(templates.memory_intro + "\n"), F.array_join(F.transform("p", lambda x: x["lines"]), "\n")).alias("memory"))


def clear_session(turns: DataFrame, session_id: str) -> DataFrame:
    """The turns without those of one session; an unknown session changes nothing."""
    return turns.filter(F.coalesce("session_id", F.lit("default")) != session_id)
