"""Whose eyes a passage is seen through, by an ordered table of rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A rule: (label, phrases, looked for in the source, looked for in the text).
Rule = tuple[str, tuple[str, ...], bool, bool]

#: Persons named in the text.
PERSONS = (
    "fulgrim", "ferrus manus", "horus", "lorgar", "perturabo", "mortarion", "angron", "magnus", "vulkan", "corax",
    "dorn", "guilliman", "lion", "russ", "curze", "alpharius", "omegon", "sanguinius", "jonson",
)
#: Formations named in the source or the text.
FORMATIONS = (
    "Emperor's Children", "Iron Hands", "World Eaters", "Death Guard", "Thousand Sons", "Luna Wolves", "Sons of Horus",
    "Night Lords", "Iron Warriors", "Raven Guard", "Salamanders", "Word Bearers", "Alpha Legion",
)
#: Words that tell the place.
PLACES = (
    ("shipboard / orbital viewpoint", ("bridge", "deck", "void", "orbit", "ship", "vessel", "frigate", "cruiser", "battleship")),
    ("ground-level Astartes viewpoint", ("trench", "mud", "rubble", "crater", "surface", "drop pod", "landed")),
    ("command level viewpoint", ("command", "vox", "strategium", "tactical display")),
)


def default_rules() -> list[Rule]:
    rules: list[Rule] = [(f"Primarch viewpoint - {p.title()}", (p,), False, True) for p in PERSONS]
    rules += [(f"{f} Astartes", (f.lower(),), True, True) for f in FORMATIONS]
    rules += [(label, words, False, True) for label, words in PLACES]
    return [*rules, ("audio drama perspective", ("audio",), True, False)]


def viewpoint(source: Column, text: Column, rules: Sequence[Rule] | None = None) -> Column:
    """Label of the first rule that applies, else the empty string; a null source or text holds no phrase.

    The rules are one chain of conditions over a pair of lower-cased texts, which are made
    once a row: a lambda's variable is a value, where a column's expression would be copied
    into every condition.
    """

    def label(pair: Column) -> Column:
        out = None
        for name, phrases, in_source, in_text in rules or default_rules():
            hit = None
            for p in phrases:
                for used, part in ((in_source, "source"), (in_text, "text")):
                    if used:
                        own = F.contains(pair[part], F.lit(p))
                        hit = own if hit is None else hit | own
            if hit is not None:
                out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
        return F.lit("") if out is None else out.otherwise(F.lit(""))

    low = F.struct(F.lower(F.coalesce(source, F.lit(""))).alias("source"), F.lower(F.coalesce(text, F.lit(""))).alias("text"))
    return F.get(F.transform(F.array(low), label), F.lit(0))
