"""Column functions on texts: tokens, query terms, intent, viewpoint, HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space, the same in every engine the results are compared with.
SPACE = r"[ \t\n\x0B\f\r]+"

#: Words that are no query terms.
STOPWORDS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "with", "at", "from", "by", "about", "what", "who", "when", "where", "how", "why",
    "is", "was", "were", "be", "been", "being", "first", "scene", "description", "made", "attack", "battle", "story", "tell", "me", "this", "that", "these", "those",
)
#: Spellings of a number word that count as the same term.
VARIANTS = {"five": ("v", "5", "five"), "third": ("iii", "3rd", "third", "3"), "fourth": ("iv", "4th", "fourth", "4"), "sixth": ("vi", "6th", "sixth", "6")}
#: Intents by the first list one of whose phrases is in the query.
INTENTS = (
    ("lore_lookup", ("who is", "who was", "what is", "what was", "tell me about", "describe")),
    ("comparison", ("compare", "difference between", "vs", "versus", "how does", "how did")),
    ("summarization", ("summarize", "summary", "overview", "arc", "timeline", "entire story")),
    ("battle_reconstruction", ("fight", "duel", "battle", "siege", "war", "assault", "narrate")),
)
OTHER_INTENT = "narrative_generation"
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}|{SPACE}$", "")


def tokens(c: Column) -> Column:
    """Lower-case words between white space; punctuation stays."""
    return F.filter(F.split(F.lower(c), SPACE), lambda t: t != "")


def enrich(query: Column) -> Column:
    """The query as an encoder wants it."""
    return F.concat(F.lit(QUERY_PREFIX), query)


def _variants(term: Column) -> Column:
    out = F.array(term)
    for word, spellings in VARIANTS.items():
        out = F.when(term == word, F.array(*map(F.lit, spellings))).otherwise(out)
    return out


def query_terms(query: Column) -> Column:
    """Sorted distinct terms of a query, number words with all their spellings."""
    found = F.regexp_extract_all(F.lower(query), F.lit("([a-z0-9']+)"), F.lit(1))
    kept = F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(*STOPWORDS))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(kept, _variants))))


def matched_terms(terms: Column, haystack: Column) -> Column:
    """The terms of which some spelling is a substring of ``haystack``, which is made once a row and not for every term."""

    def among(text: Column) -> Column:
        return F.filter(terms, lambda t: F.exists(_variants(t), lambda v: F.contains(text, v)))

    return F.get(F.transform(F.array(haystack), among), F.lit(0))


def intent(query: Column) -> Column:
    q = F.lower(query)
    out = F.lit(OTHER_INTENT)
    for name, phrases in reversed(INTENTS):
        hit = F.lit(False)
        for p in phrases:
            hit = hit | F.contains(q, F.lit(p))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def html_to_text(c: Column) -> Column:
    """Text of an HTML page: scripts, styles, comments and tags dropped, common entities decoded."""
    out = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def display_score(rerank: Column, overlap: Column, rrf: Column, dense: Column) -> Column:
    """The first of the scores that is neither missing nor zero, else 0."""
    zero = F.lit(0.0)
    return F.coalesce(*(F.nullif(c, zero) for c in (rerank, overlap, rrf, dense)), zero)
