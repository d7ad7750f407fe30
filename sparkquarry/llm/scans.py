"""Noise of page scans: broken words, misread letters, running headers and page numbers.

Method: a weighted Levenshtein automaton is intersected with a trie of the corpus
vocabulary. It accepts up to two confusions of similar-looking letters (merges and splits
among them) or one arbitrary edit, and retrieves every word that a rare form may have been
and that is frequent enough; subtrees without such a word are given up. Candidates are
ranked by frequency and edits, and where a text is restored also by the neighbours of the
form there. An arbitrary edit may be a slip in typing, which is no noise of a scan: it is
put right in noisy texts and makes none noisy. Page furniture is then removed, with headers
told by the file's title, by a page number or by their repetition within a source, and the
lines are joined to paragraphs.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize

#: Letters as they are misread -> as they were printed.
CONFUSIONS = (("c", "e"), ("cl", "d"), ("ii", "u"), ("b", "h"), ("rn", "m"), ("m", "in"), ("m", "rn"), ("vv", "w"), ("h", "li"), ("im", "nn"), ("rn", "in"))
#: Signs and digits read in place of a letter.
GLYPHS = {"@": "a", "!": "i", "†": "t", "0": "o", "1": "l", "5": "s", "9": "g", "6": "b", "3": "e", "8": "b", "$": "s"}
#: Joined letters a scan reads as one sign.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
#: Confusions in one word; ARBITRARY stands for the one edit of any kind instead.
EDITS, ARBITRARY = 2, 3
#: A form is a misreading of a word that is at least so many times as frequent (copied passages count once), and occurs at least so often; short
#: forms and those of two misreadings, which meet a word by chance, ask for more.
TIMES, TIMES_SHORT, TIMES_TWICE, TIMES_SHORT_TWICE, LEAST = 6, 100, 30, 300, 4
#: The same for an arbitrary edit, in forms of six letters or more, and in shorter ones.
TIMES_ANY, TIMES_SHORT_ANY = 2_000, 200_000
#: A line inside a sentence is a running header when so many texts of a source have it there.
HEADERS = 3
#: Share of any one word among the neighbours a word has not been seen with.
ANY = 1e-4
#: Misread forms sent to all tasks at once; among more, what a text asks for is looked up by joins.
SENT = 200_000
#: First characters that mark a running header and a form explained by an arbitrary edit among the known forms.
HEADER, UNSURE = "\x00", "~"
#: Distinct words a task counts before it hands them on.
FLUSH = 200_000

_WORD = re.compile(r"\b[^\W\d_]+\b")
_NEITHER = re.compile(r"[\W_]+")
_HYPHEN = "-‐‑¬­"
#: A word broken at a line end, with furniture lines allowed to follow the break.
_BROKEN = re.compile(rf"([^\W\d_]+)[{_HYPHEN}][ \t]*\r?\n[ \t]*([^\W\d_]+)")
#: What every broken word has.
_BREAK = re.compile(rf"[{_HYPHEN}][ \t]*\r?\n")
_BREAK_AT_END = re.compile(rf"[^\W\d_][{_HYPHEN}][ \t]*$")
#: A sign or digit among small letters. Signs may also begin or end a word where they mean nothing else.
_GLYPH = re.compile(
    r"(?<![\w@†!√≈ƒ¬‚├┼ΓÔ-])(?:[^\W\d_]*(?![ÃÅÄÂâЀ-ӿ])[^\W\d_](?:![a-z]|[@†](?![âÃÂ])[^\W\d_A-Z])[^\W\d_]*|[@†](?![âÃÂ])[^\W\d_A-Z]{2,}"
    r"|[^\W\d_]+(?![ÃÅÄÂâЀ-ӿ])[^\W\d_][@†]|[^\W\d_]+[0135689$][^\W\d_A-Z]+)(?![\w@†-])"
)
_LIGATURE = re.compile("[" + "".join(LIGATURES) + "]")
# the sign first: what one character can't be is passed over fast
_SIGN = re.compile(r"[@†!0135689$](?:(?<=[@†])|(?<=[^\W\d_].)(?=[^\W\d_]))", re.S)
#: What follows the first letter of a sequence read in a wrong encoding.
_MISREAD = frozenset("€™œ¢¤¦§©ª«¬®¯°±¶·¸º»¼½¾¿¡£¥\xa0\xad" + "".join(map(chr, range(0x80, 0xA0))))
_ROMAN = re.compile(r"(?=[ivxlc])(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})|c{1,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
_PAGE = re.compile(r"[\[(—–\-·*•~ ]{0,4}\d{1,4}[\])—–\-·*•~ ]{0,4}|(?:p|pp|pg|page|s|seite|página|pág)\.? ?\d{1,4}(?: (?:of|de|von|sur|/) ?\d{1,4})?", re.I)
_NUMBERED = re.compile(r"\d{1,4}(?: {2,}| ?\| ?|\t+)(?P<a>\S.{0,80})|(?P<b>\S.{0,80}?)(?: {2,}| ?\| ?|\t+)\d{1,4}")


def title_of(source: str | None) -> str:
    """Letters of the book's title in a file name, for comparison."""
    stem = re.sub(r"\.\w{2,5}$", "", (source or "").strip())
    return _plain(re.sub(r"_\d{3,6}$", "", stem))


def _plain(text: str) -> str:
    return _NEITHER.sub("", text.casefold())


def _headline(line: str) -> bool:
    """Title case or capitals without an end of a sentence."""
    words = _WORD.findall(line)
    small = {"of", "the", "and", "in", "on", "at", "to", "a", "an", "for", "de", "la", "le", "les", "des", "du", "der", "die", "das", "und", "el", "los", "y", "von"}
    return 0 < len(words) <= 9 and len(line) <= 70 and not re.search(r"[.,;!?…”“»«]$", line) and all(w[0].isupper() or w.lower() in small for w in words) and any(w[0].isupper() for w in words)


def possible_headers(lines: list[str], title: str) -> Iterator[str]:
    """Headlines between the lines of one sentence, by the source and their letters."""
    for k in range(1, len(lines) - 1):
        line = lines[k].strip()
        if 3 < len(line) <= 70 and line[0].isupper() and (after := lines[k + 1].lstrip()) and after[0].islower() and (before := lines[k - 1].rstrip()) and (before[-1].islower() or before[-1] in ",-") and len(line) < 0.7 * max(len(before), len(after)) and _headline(line):
            yield f"{HEADER}{title}{HEADER}{_plain(line)}"


def furniture(lines: list[str], title: str = "", known=frozenset()) -> list[bool]:
    """For each line of a text whether it is a page number or a running header."""
    out = [False] * len(lines)
    filled = [k for k, ln in enumerate(lines) if ln.strip()]
    if len(filled) < 2 or not any(len(lines[k].strip()) > 20 for k in filled):
        return out
    for k in filled:
        line = lines[k].strip()
        if len(line) > 100:
            continue
        if _PAGE.fullmatch(line) or _ROMAN.fullmatch(line):
            out[k] = True
        elif m := _NUMBERED.fullmatch(line):
            name = m.group("a") or m.group("b")
            out[k] = _headline(name.strip()) or (bool(title) and _plain(name) == title)
        elif title and len(line) > 3 and _plain(line) == title:
            out[k] = True
    if title:
        headers = {h for h in set(possible_headers(lines, title)) if h in known}
        for k in filled if headers else ():
            out[k] = out[k] or any(f"{HEADER}{title}{HEADER}{_plain(lines[k])}" == h for h in headers)
    for k in filled:  # a title of an unknown book beside its page number
        if not out[k] and _headline(lines[k].strip()) and len(_WORD.findall(lines[k])) > 1 and not re.match(r"\W*(chapter|kapitel|chapitre|capítulo|part|book)\b", lines[k].strip(), re.I):
            near = [j for j in (k - 1, k + 1) if 0 <= j < len(lines)]
            out[k] = any(out[j] and _PAGE.fullmatch(lines[j].strip() or "x") for j in near)
    return out


def glyph_words(text: str) -> list[str]:
    """Words with a sign or digit in place of a letter."""
    for m in _SIGN.finditer(text):  # most texts have no sign beside a letter
        i = m.start()
        if (i and text[i - 1].isalpha()) or text[i + 1 : i + 2].islower():
            return [w for w in _GLYPH.findall(text) if len(w) <= 40 and sum(c.isdigit() for c in w) <= 2]
    return []


def read_glyphs(word: str) -> str:
    return "".join(GLYPHS.get(c, c) for c in word)


#: Ends of the passages whose copies count once.
_PASSAGE_END = re.compile(r"[.!?…\n]+")


def joined(text: str) -> str:
    """The text with broken words joined, for counting."""
    return _BROKEN.sub(r"\1\2", text) if "\n" in text and _BREAK.search(text) else text


class Vocabulary:
    """Trie of words with their counts over all rows and over distinct passages; a node knows the greatest below it."""

    def __init__(self) -> None:
        self.root: list = [{}, None, 0, 0]  # children, counts of the word that ends here, greatest counts

    def add(self, word: str, counts: tuple[int, int]) -> None:
        node = self.root
        for c in ("", *word):
            if c:
                node = node[0].setdefault(c, [{}, None, 0, 0])
            node[2], node[3] = max(node[2], counts[0]), max(node[3], counts[1])
        node[1] = counts

    def readings(self, form: str, counts: tuple[int, int], confused: bool = True) -> Iterator[tuple]:
        """(word, its counts, edits): words frequent enough that ``form``, with these counts,
        may be: by 1 to EDITS confusions (if ``confused``), or by one insertion, deletion or
        substitution (ARBITRARY)."""
        bars = [_bar(_times(form, max(e, 1)), counts) for e in range(ARBITRARY + 1)]
        size = len(form)
        stack = [(self.root, 0, 0, "")]
        while stack:
            node, i, e, word = stack.pop()
            rows, own = bars[e]
            if node[3] < own and node[2] < rows:
                continue  # nothing below is frequent enough, and further edits ask for more
            if i == size and e and (m := node[1]) and (m[1] >= own or m[0] >= rows):
                yield word, m, e
            if i < size and form[i] in node[0]:
                stack.append((node[0][form[i]], i + 1, e, word + form[i]))
            if confused and e < EDITS and i < size:
                for seen, true in _RULES.get(form[i], ()):
                    if form.startswith(seen, i):
                        at = node
                        for t in true:
                            at = at[0].get(t)
                            if at is None:
                                break
                        else:
                            stack.append((at, i + len(seen), e + 1, word + true))
            if not e and (node[3] >= bars[ARBITRARY][1] or node[2] >= bars[ARBITRARY][0]):
                if i < size:
                    stack.append((node, i + 1, ARBITRARY, word))
                for c, child in node[0].items():
                    stack.append((child, i, ARBITRARY, word + c))
                    if i < size and c != form[i]:
                        stack.append((child, i + 1, ARBITRARY, word + c))


#: The confusions by the first letter that is seen.
_RULES: dict[str, list[tuple[str, str]]] = {}
for _seen, _true in CONFUSIONS:
    _RULES.setdefault(_seen[0], []).append((_seen, _true))


def _times(form: str, edits: int) -> int:
    """How many times as frequent a word must be than ``form``."""
    if edits == ARBITRARY:
        return TIMES_ANY if len(form) > 5 else TIMES_SHORT_ANY
    if edits > 1:
        return TIMES_TWICE if len(form) > 5 else TIMES_SHORT_TWICE if len(form) > 3 else TIMES_SHORT * TIMES_TWICE
    return TIMES if len(form) > 3 else TIMES_SHORT


def _bar(times: int, form: tuple[int, int]) -> tuple[float, int]:
    """Counts (over all rows, over distinct passages) one of which a word must reach to outweigh a form.

    Copies of a scanned passage can't lift its forms over their words, as distinct passages
    decide. Only a form in too few of them to tell is also measured by rows.
    """
    return (max(LEAST, times * form[0]) if form[1] < LEAST else float("inf")), max(LEAST, times * form[1])


def _begin(length: int) -> int:
    """Length of the beginning by which a form of ``length`` meets its words."""
    return 1 if length <= 4 else 2 if length <= 6 else 3


def word_keys(word: str) -> set[str]:
    """Beginnings by which forms meet ``word``: an edit changes the length by one at most."""
    return {f"{k}{word[:k]}" for n in range(len(word) - EDITS, len(word) + EDITS + 1) if (k := _begin(n)) <= len(word)}


def end_keys(word: str) -> set[str]:
    """Endings by which forms meet ``word`` after one arbitrary edit, which leaves the beginning or the end alone."""
    return {f"E{k}{word[-k:]}" for n in (len(word) - 1, len(word), len(word) + 1) if (k := _begin(n)) <= len(word)}


def form_keys(form: str) -> set[str]:
    """Beginnings of all words whose misreading ``form`` may be: its own, and those that up to EDITS confusions give."""
    k = _begin(len(form))
    out, stack = set(), [(0, 0, "")]
    while stack:
        i, e, word = stack.pop()
        if len(word) >= k or i == len(form):
            out.add(f"{k}{word[:k]}")
            continue
        stack.append((i + 1, e, word + form[i]))
        if e < EDITS:
            stack += [(i + len(seen), e + 1, word + true) for seen, true in CONFUSIONS if form.startswith(seen, i)]
    return out


class Scans:
    """Scan noise in texts.

    Null, empty and blank texts hold none. Rows equal in id, text and source count once; a
    null id is kept. The file type is not read: the text decides. Other columns are not
    read. Words are counted over all texts, and over their distinct passages.
    """

    def __init__(self, df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", source_col: str = "source"):
        self.id_col, self.text_col = id_col, text_col
        self.kind = df.schema[id_col].dataType.simpleString()
        self.docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source")).filter(F.length("text") > 0)
        self._forms = self._candidates = self._words = None

    def forms(self) -> DataFrame:
        """(form, word, n): misread forms and what they were, the likeliest word each; n counts it over distinct passages.

        Forms that only an arbitrary edit explains are marked by UNSURE; running headers stand in the table as well.
        """
        if self._forms is not None:
            return self._forms

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter[str] = Counter()

            def out() -> pa.RecordBatch:
                b = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()), pa.nulls(len(seen), pa.int64())], ["passage", "n", "text"])
                seen.clear()
                return b

            for batch in batches:
                headers: list[tuple[str, int]] = []
                for t, source, name in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    seen.update(_PASSAGE_END.split(joined(t).lower()))
                    if "\n" in t and (title := title_of(source)):
                        headers += [(h, name) for h in set(possible_headers(t.split("\n"), title))]
                if headers:
                    yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in headers]), pa.array([1] * len(headers), pa.int64()), pa.array([x for _, x in headers], pa.int64())], ["passage", "n", "text"])
                if len(seen) > FLUSH:
                    yield out()
            yield out()

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter[str] = Counter()
            own: Counter[str] = Counter()

            def out() -> pa.RecordBatch:
                b = pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array([seen[w] for w in own], pa.int64()), pa.array(list(own.values()), pa.int64())], ["word", "n", "own"])
                seen.clear(), own.clear()
                return b

            for batch in batches:
                for t, n, several in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    if t[:1] == HEADER:
                        if several and n >= HEADERS:
                            own[t] += 1
                        continue
                    words = _WORD.findall(t)
                    own.update(words)
                    if n > 1:  # the copies are added to the distinct ones
                        for w in words:
                            seen[w] += n - 1
                if len(own) > FLUSH:
                    yield out()
            yield out()

        texts = self.docs.select("text", "source", F.xxhash64("text"))
        passages = texts.mapInArrow(cut, "passage string, n long, text long").groupBy("passage").agg(F.sum("n").alias("n"), (F.min("text") < F.max("text")).alias("several"))
        counts = passages.mapInArrow(count, "word string, n long, own long").groupBy("word").agg(F.sum(F.col("n") + F.col("own")).alias("n"), F.sum("own").alias("own"))
        self._words = materialize(counts.filter(F.length("word") > 2), "words")
        header = F.startswith("word", F.lit(HEADER))
        words = self._words.filter(~header)

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for w, n, own in zip(*(c.to_pylist() for c in batch.columns)):
                    if n >= LEAST:
                        out += [(k, False, w, n, own) for k in word_keys(w)]
                    if n >= TIMES_ANY:
                        out += [(k, False, w, n, own) for k in end_keys(w)]
                    out += [(k, True, w, n, own) for k in form_keys(w)]
                    out.append((f"E{_begin(len(w))}{w[-_begin(len(w)):]}", True, w, n, own))
                cols = list(zip(*out)) or [(), (), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], ["key", "form", "word", "n", "own"])

        def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, trie = None, Vocabulary()
            for batch in batches:
                out = []
                for k, form, w, n, own in zip(*(c.to_pylist() for c in batch.columns)):
                    if k != key:
                        key, trie = k, Vocabulary()
                    if not form:
                        trie.add(w[::-1] if k[0] == "E" else w, (n, own))
                    elif k[0] == "E":
                        out += [(w, v[::-1], m[1], e) for v, m, e in trie.readings(w[::-1], (n, own), False)]
                    else:
                        out += [(w, v, m[1], e) for v, m, e in trie.readings(w, (n, own))]
                cols = list(zip(*out)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32())], ["form", "word", "n", "edits"])

        met = words.mapInArrow(spread, "key string, form boolean, word string, n long, own long").repartition("key").sortWithinPartitions("key", "form").mapInArrow(intersect, "form string, word string, n long, edits int")
        best = F.max_by(F.struct("word", "n"), F.struct(F.log("n") - 3.0 * F.col("edits"), F.col("word")))
        self._candidates = materialize(met.groupBy("form", "word").agg(F.max("n").alias("n"), F.min("edits").alias("edits")), "candidates")
        ranked = self._candidates.groupBy("form").agg(best.alias("b"), F.min("edits").alias("edits"))
        forms = ranked.select(F.when(F.col("edits") < ARBITRARY, F.col("form")).otherwise(F.concat(F.lit(UNSURE), "form")).alias("form"), "b.word", "b.n")
        headers = self._words.filter(header).select(F.col("word").alias("form"), F.lit("").alias("word"), "n")
        self._forms = materialize(forms.unionByName(headers), "forms")
        return self._forms

    def in_context(self) -> DataFrame:
        """(form, word): forms that may be several words, as ``placed`` between their neighbours, and the word likeliest there.

        A word is weighed by its count, the edits and how often it has each neighbour
        (smoothed by Witten and Bell's rule).
        """
        self.forms()
        own = Window.partitionBy("form")
        several = materialize(self._candidates.withColumn("k", F.count("*").over(own)).filter("k > 1").drop("k"), "several")
        texts = self.docs.select("text").distinct()
        forms, chosen_words = several.select("form").distinct(), several.select("word").distinct()
        few = forms.count() + chosen_words.count() <= SENT
        wanted = ({r[0] for r in forms.collect()}, {r[0] for r in chosen_words.collect()}) if few else None
        chosen = self.docs.sparkSession.sparkContext.broadcast(wanted)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Forms between their neighbours, and words with each neighbour, from one reading of the texts."""
            forms, chosen_words = chosen.value or (None, None)
            for batch in batches:
                seen: Counter[tuple] = Counter()
                for t in batch.column(0).to_pylist():
                    words = _WORD.findall(joined(t).lower())
                    edged = ["", *words, ""]
                    at = [i for i, w in enumerate(words, 1) if chosen_words is None or w in chosen_words]
                    seen.update([("<", edged[i], edged[i - 1], "") for i in at])
                    seen.update([(">", edged[i], edged[i + 1], "") for i in at])
                    if forms is None or not forms.isdisjoint(words):
                        seen.update([("", w, edged[i - 1], edged[i + 1]) for i, w in enumerate(words, 1) if forms is None or w in forms])
                cols = list(zip(*seen)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols), pa.array(list(seen.values()), pa.int64())], ["side", "w", "a", "b", "c"])

        found = texts.mapInArrow(run, "side string, w string, a string, b string, c long").groupBy("side", "w", "a", "b").agg(F.sum("c").alias("c"))
        found = materialize(found, "neighbours")
        places = found.filter("side = ''").select(F.col("w").alias("form"), "a", "b")
        pairs = found.filter("side <> ''").select(F.col("w").alias("word"), F.concat("side", "a").alias("a"), "c")
        if not few:
            places, pairs = places.join(forms, "form", "left_semi"), pairs.join(chosen_words, "word", "left_semi")
        totals = pairs.groupBy("word", F.substring("a", 1, 1).alias("side")).agg(F.sum("c").alias("of"), F.count("*").alias("kinds"))
        asked = places.join(several, "form").withColumn("near", F.explode(F.array(F.concat(F.lit("<"), "a"), F.concat(F.lit(">"), "b"))))
        asked = asked.withColumn("side", F.substring("near", 1, 1)).join(totals, ["word", "side"], "left").join(pairs.select("word", F.col("a").alias("near"), "c"), ["word", "near"], "left")
        fit = F.log((F.coalesce("c", F.lit(0)) + F.coalesce("kinds", F.lit(1)) * ANY) / (F.coalesce("of", F.lit(0)) + F.coalesce("kinds", F.lit(1))))
        scored = asked.groupBy("form", "a", "b", "word").agg((F.sum(fit) + F.max(F.log("n") - 3.0 * F.col("edits"))).alias("score"))
        best = scored.groupBy("form", "a", "b").agg(F.max_by("word", F.struct("score", "word")).alias("word"))
        return best.select(F.concat_ws(" ", "a", "form", "b").alias("form"), "word")

    def _known(self, context: bool) -> DataFrame:
        """(form, word), with the forms in their contexts where texts are restored."""
        forms = self.forms().select("form", "word")
        return materialize(forms.unionByName(self.in_context()), "known") if context else forms.filter(~F.startswith("form", F.lit(UNSURE)))

    def _sent(self, forms: DataFrame):
        """The forms as a broadcast dictionary, or None where there are too many for one."""
        if forms.count() > SENT:
            return None
        return self.docs.sparkSession.sparkContext.broadcast({r["form"]: r["word"] for r in forms.collect()})

    def _filter(self, forms: DataFrame):
        """A Bloom filter of the forms as a broadcast; of 2^27 bits at most, beyond that more names are looked up in vain."""
        mask = (1 << min(27, max(10, (16 * forms.count()).bit_length()))) - 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own: dict[int, int] = {}
                for name in batch.column(0).to_pylist():
                    for bit in _bits(name, mask):
                        own[bit >> 5] = own.get(bit >> 5, 0) | 1 << (bit & 31)
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], ["at", "bits"])

        marked = forms.select("form").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
        bits = np.zeros((mask + 1) >> 5, "<u4")
        bits[marked["at"].to_numpy()] = marked["bits"].to_numpy()
        return self.docs.sparkSession.sparkContext.broadcast((bits.tobytes(), mask))

    def noisy(self) -> DataFrame:
        """(id, broken, furniture, misread): rows with at least one kind of noise."""
        return self._run(False).drop("text", "restored").distinct()

    def restored(self) -> DataFrame:
        """(id, text, restored): rows with noise and their texts as continuous paragraphs."""
        return self._run(True).select(self.id_col, F.col("text").alias(self.text_col), "restored").distinct()

    def _run(self, repair: bool) -> DataFrame:
        """The noisy texts, decided with all known forms, or by looking up what a text asks for until it asks for nothing more."""
        forms = self._known(repair)
        sent = self._sent(forms)
        maybe = None if sent else self._filter(forms)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            common = sent.value if sent else None
            likely = None if sent else _Likely(*maybe.value)
            for batch in batches:
                keep, kinds, own, texts, names = [], [], [], [], []
                maps = [None] * batch.num_rows if sent else batch.column(3).to_pylist()
                for i, (text, source) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                    known = common if sent else _Asked(maps[i] or (), likely)
                    found = detect(text, source, known)
                    restored = repaired(text, source, known) if repair and (any(found) or (not sent and known.names)) else None
                    asked = None if sent else sorted(known.names) or None
                    if asked or any(found):
                        keep.append(i), kinds.append(found), names.append(asked), texts.append(restored)
                        own.append(text if asked or repair else None)
                at = pa.array(keep, pa.int64())
                flags = [pa.array([k[j] for k in kinds], pa.bool_()) for j in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), pa.array(own, pa.string()), pa.array(texts, pa.string()), *flags, batch.column(2).take(at), batch.column(3).take(at), pa.array(names, pa.list_(pa.string()))],
                    ["id", "text", "restored", "broken", "furniture", "misread", "source", "known", "names"],
                )

        kind = f"id {self.kind}, text string, restored string, broken boolean, furniture boolean, misread boolean, source string, known map<string,string>, names array<string>"
        docs = self.docs.withColumn("known", F.lit(None).cast("map<string,string>"))
        if sent:
            out = docs.mapInArrow(run, kind)
        else:
            rows = materialize(docs.mapInArrow(run, kind), "decided")
            out = rows.filter("names IS NULL")
            while not (asking := rows.filter("names IS NOT NULL")).isEmpty():  # each time a text has more names answered
                asking = asking.withColumn("key", F.xxhash64("id", "text", "source"))
                asked = asking.select("key", F.explode("names").alias("form")).distinct().join(forms, "form", "left")
                answers = asked.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("form", "word"))).alias("answers"))
                known = F.when(F.col("known").isNull(), F.col("answers")).otherwise(F.map_concat("known", "answers"))
                docs = asking.join(answers, "key").select("id", "text", "source", known.alias("known"))
                rows = materialize(docs.mapInArrow(run, kind), "decided")
                out = out.unionByName(rows.filter("names IS NULL"))
        return out.drop("source", "known", "names").withColumnRenamed("id", self.id_col)


class _Asked(dict):
    """What was looked up for a text among the known forms, None for what isn't one; notes the ``likely`` names that a decision asks for beyond it.

    Once no name is noted the decision is the one that all known forms give.
    """

    def __init__(self, found, likely: _Likely) -> None:
        super().__init__(found)
        self.likely, self.names = likely, set()

    def get(self, name: str, default: str | None = None) -> str | None:
        word = super().get(name, self)
        if word is self:
            word = None
            if self.likely(name):
                self.names.add(name)
        return default if word is None else word

    def __contains__(self, name: str) -> bool:
        return self.get(name) is not None

    def keys(self) -> _Asked:
        return self

    def isdisjoint(self, names: list[str]) -> bool:
        return not any([name in self for name in set(names) - self.likely.denied])  # all are asked for at once


def _bits(name: str, mask: int) -> tuple[int, int, int]:
    """Places of a name in a Bloom filter of ``mask`` + 1 bits."""
    h = int.from_bytes(blake2b(name.encode(), digest_size=12).digest(), "little")
    return h & mask, h >> 32 & mask, h >> 64 & mask


class _Likely:
    """Tells whether a name may be in a Bloom filter; remembers names that aren't, within bounds."""

    def __init__(self, bits: bytes, mask: int) -> None:
        self.bits, self.mask = bits, mask
        self.denied: set[str] = set()

    def __call__(self, name: str) -> bool:
        if name in self.denied:
            return False
        if all(self.bits[b >> 3] >> (b & 7) & 1 for b in _bits(name, self.mask)):
            return True
        if len(self.denied) >= FLUSH:
            self.denied.clear()
        self.denied.add(name)
        return False


def placed(words: list[str], i: int) -> str:
    """A word between its neighbours."""
    return f"{words[i - 1] if i else ''} {words[i]} {words[i + 1] if i + 1 < len(words) else ''}"


def detect(text: str, source: str | None, known: dict[str, str]) -> tuple[bool, bool, bool]:
    """(broken words, page furniture, misread letters)."""
    broken = page = False
    if "\n" in text:
        lines = text.split("\n")
        page = any(furniture(lines, title_of(source), known))
        broken = bool(_BREAK.search(text) and _BROKEN.search(text)) or (page and any(_BREAK_AT_END.search(ln.rstrip("\r")) for ln in lines[:-1]))
    misread = not known.keys().isdisjoint(_WORD.findall(joined(text).lower())) or bool(_LIGATURE.search(text) or glyph_words(text))
    return broken, page, misread


def _like(word: str, pattern: str) -> str:
    """``word`` in the case of ``pattern``."""
    return word.upper() if pattern.isupper() and len(pattern) > 1 else word[:1].upper() + word[1:] if pattern[:1].isupper() else word


def repaired(text: str, source: str | None, known: dict[str, str]) -> str:
    """The text without furniture, its words joined and corrected, its lines as paragraphs."""
    lines = [ln.rstrip("\r") for ln in text.split("\n")]
    drop = furniture(lines, title_of(source), known)
    lines = [ln for ln, d in zip(lines, drop) if not d]
    paragraphs: list[str] = []
    own = ""
    for ln in lines:
        s = ln.strip()
        if not s:
            if own and any(drop) and not re.search(r"[.!?…:”»\")]$", own):
                continue  # a page break inside a sentence
            if own:
                paragraphs.append(own)
            own = ""
        elif not own:
            own = s
        elif _BREAK_AT_END.search(own):
            own = own[:-1] + s if s[0].isalpha() and s[0].islower() else own + s
        elif re.match(r"[-*•§]\s|\d{1,3}[.)]\s", s):
            paragraphs.append(own)
            own = s
        else:
            own += " " + s
    if own:
        paragraphs.append(own)
    out = "\n\n".join(paragraphs)
    out = re.sub(r"(?<=\S) [|~^](?= )|(?m:^)[|~^]\s*(?=\w)", "", out)
    out = _LIGATURE.sub(lambda m: LIGATURES[m.group()], out)
    plain_text = out

    def letters(m: re.Match) -> str:
        w = m.group()
        if sum(c.isdigit() for c in w) > 2 or len(w) > 40:
            return w
        plain = read_glyphs(w)
        return _like(known.get(plain.lower(), plain.lower()), plain)

    out = _GLYPH.sub(letters, out) if _SIGN.search(out) else out
    words = _WORD.findall(out.lower())
    wrong = {w for w in set(words) if known.get(w) or known.get(UNSURE + w)}
    if not wrong:
        return out
    here = Counter(words if out is plain_text else _WORD.findall(plain_text.lower()))
    at = itertools.count()

    def word(m: re.Match) -> str:
        w, i = m.group().lower(), next(at)
        if w not in wrong:
            return m.group()
        best = known.get(w)
        if not best and out[m.end() : m.end() + 1] not in _MISREAD:  # the letters of a wrong encoding are no slip
            best = known.get(UNSURE + w)
        # a form that the text itself uses again and again is its own word
        if not best or here[w] >= 3:
            return m.group()
        return _like(known.get(placed(words, i), best) if i < len(words) else best, m.group())

    return _WORD.sub(word, out)
