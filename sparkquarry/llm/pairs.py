"""Defective pairs of prompt and response, each with its one defect.

Method: language posteriors of prompt and response from a character n-gram naive Bayes
model are compared; the likelihood that a text ends after its last n-gram, counted over all
responses, flags truncation. Empty answers, copies and refusals are told by what is left of
the response without markup, quotations, echoes of the prompt and courtesies.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize

#: The language model is fitted on at most SAMPLE labelled texts of each language, whole ones of SHORT to LONG characters;
#: a language needs LEAST_TEXTS of them. The languages are the two-letter codes among the labels.
SAMPLE, SHORT, LONG, LEAST_TEXTS = 600, 40, 20_000, 10
#: Stands for every language written in letters that no labelled text has.
OTHER = "other"
#: Posterior odds (nats) below which a language is taken as unknown.
SURE = 6.0
#: The classifier of refusals is fitted on about so many responses, drawn by hash. It needs so many known n-grams in a
#: sentence, and odds (nats) of a sentence that declines against any other.
REFUSAL_SAMPLE, LEAST_GRAMS, DECLINES = 8_000, 6, 25.0
#: Words whose scores a worker remembers.
REMEMBERED = 100_000
#: Words outside quotations that tell the language of a response; with fewer its quotations count too.
LEAST_WORDS = 6
#: A text ends after a context with at least this probability, or it is truncated.
ENDS = 0.012
#: A name ends after its last three letters with at least this probability, or it is cut.
NAME_ENDS = 0.04

#: What stands for no answer at all, as letters and digits only.
PLACEHOLDERS = frozenset("null none nil nan na undefined empty blank noanswer noresponse nodata notavailable tbd todo placeholder noanswerprovided keineantwort sansreponse sinrespuesta".split())
#: Labels around an echoed prompt, as letters and digits only.
LABELS = frozenset("q a qa question answer questionanswer youask youasked youraskedquestion thequestionis thequestionwas yourquestion yourquestionis yourquestionwas query prompt user frage pregunta antwort respuesta reponse ihrefrage ihrefragelautet siefragen votrequestion vousdemandez supregunta ustedpregunta".split())
#: Names of languages a prompt may ask for, as they are written in each of them.
NAMES = {
    "en": "english anglais englisch inglés ingles",
    "fr": "french français francais französisch francés frances",
    "de": "german allemand deutsch alemán aleman",
    "es": "spanish espagnol spanisch español espanol castellano",
}
#: Sentences that accompany a refusal and say nothing themselves.
_COURTESY = re.compile(
    r"you ask(ed)? about|fair (one|question)|good question|thank you|anything else|(something|anyone) else|if you like|instead\b|rephrase|another (source|question)|try asking|ask me|consult|please (ask|try)|kindly"
    r"|passages?\)|andere (frage|quelle)|formulier|stellen sie|reformulez|autre (question|source)|otra (cosa|pregunta|fuente)|pregunte|reformule|my instructions",
    re.I,
)
#: How answers decline or say that there is nothing to answer with.
_REFUSAL = re.compile(
    "|".join(
        (
            r"\b(can ?not|can[’']t|could ?n[o’']t|unable to|not able to|not possible for me to|not in a position to|not permitted to|not allowed to|must decline|have to decline|decline to|refuse to|won[’']t|will not|shall not|shan[’']t|may not|told not to|forbidden to|prefer not to|rather not|do not wish to|don[’']t wish to)\s+(\w+\s+){0,2}?"
            r"(help|answer|comment|discuss|describe|say|speak|tell|give|go|take|provide|assist|comply|guess|respond|share|offer|continue|fulfil|fulfill|complete|address|talk|disclose|reveal|engage|recount|name|narrate|be completed|do that)\b",
            r"\b(unable|refus\w+|decline) to comply\b|request can[’']t be (completed|fulfilled)|beyond what i may|outside (of )?my (remit|scope)|forbid(s)? me|content .{0,60} is restricted|subject is closed|not be (appropriate|right|proper) for me to|leave this unanswered|i have been told not",
            r"\bno (passage|record|source|information|text|entry|mention|answer)s?\b.{0,80}\b(speak|mention|of|about|on|support|cover|touch|found|available)|(not have|lack|without) (enough|sufficient|any) (information|context|material|passages|sources)|insufficient (information|context|evidence)",
            r"(archive|passages|rolls|records|sources|documents|texts?)\b.{0,60}\b(hold|say|contain|give|offer|mention|record)s? (me )?nothing|too (thin|sparse|few) to (say|answer)|(rolls|archives|passages) are silent|nothing (in|to) .{0,40}(answer|go on)|i (do not|don[’']t) know\b|i have nothing",
            r"ne (peux|puis|pouvons|saurais|suis) (pas|rien|en mesure)|ne peux pas|désolée?\b|préfère ne pas|ne disent rien|aucune? (passage|information|réponse|source|texte|extrait)|refuse de|impossible de (vous )?(répondre|aider|parler|dire|décrire|commenter)|pas (autorisée?|en mesure)|m[’']est interdit",
            r"tut mir leid|leider|möchte (ich )?(darauf|dazu|das|hierzu) (nicht|lieber)|nicht (eingehen|beantworten|helfen|antworten|möglich, (das|dies|diese))|kann (ich )?(dazu|das|ihnen|darauf|diese|hierzu)\b.{0,40}\b(nichts|nicht|keine)|darf ich|keine (auskunft|antwort|angaben|stelle|information)|enthalten nichts|verweiger|ablehnen",
            r"lo siento|no (puedo|podemos|me es posible|estoy autorizad|tengo permitido)|prefiero no|no dicen nada|no (hay|encuentro|existe) ning[uú]n|por desgracia|me niego|no (se )?me (está )?permit|no se me permite|sin información|no dispongo|no tengo (información|respuesta)",
        )
    ),
    re.I,
)
_THINK = re.compile(r"<think>.*?(?:</think>|$)", re.S | re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>|<!--.*?-->", re.S)
_QUOTED = re.compile(r"“[^”]*”|«[^»]*»|„[^“”]*[“”]|\"[^\"]*\"")
_SENTENCE = re.compile(r"[^.!?…\n]+[.!?…]*[”»\")]*")
_TOKEN = re.compile(r"[^\W\d_]+(?:[’'-][^\W\d_]+)*|\d[\d.,]*\d|\d|[^\w\s]")
_ASKED = re.compile(r"(?:\b(?:answer|reply|respond|write|réponds?|répondez|antworte[nt]?|antwort|responda|responde|contesta)\b[^()]{0,30}?\b|\(\s*)(?:in|en|auf)\s+([^\W\d_]+)", re.I)
_OPENED_ITEM = re.compile(r"(?:[.!?…:;”)»]\s+|\n\s*)(?:\d{1,3}[.)]|[-*•–])\s*$")


_NEITHER = re.compile(r"[\W_]+")
#: Control and format characters but line breaks and tabs.
_UNSEEN = regex.compile(r"[[\p{Cf}\p{Cc}]--[\n\t]]+", regex.V1)


def letters(text: str) -> str:
    """Letters and digits only, lower case."""
    return _NEITHER.sub("", unicodedata.normalize("NFKC", text).casefold())


def bare(text: str | None) -> str:
    """The response without reasoning blocks, markup, control and zero-width characters."""
    text = _TAG.sub(" ", _THINK.sub(" ", text or ""))
    text = html.unescape(text) if "&" in text else text
    return _UNSEEN.sub("", text).strip().strip("*_`~#").strip()


_LETTERS = re.compile(r"[^\W\d_]+")


def _words(text: str) -> Iterator[str]:
    """The words that aren't names: all languages share the names. Scripts without capitals have no names."""
    return (w for w in _LETTERS.findall(text) if not w[0].isupper())


def _grams(word: str) -> Iterator[str]:
    """The character n-grams of a word with its ends, and the word."""
    w = f" {word} "
    for n in (1, 2, 3, 4, len(w)):
        for i in range(len(w) - n + 1):
            yield w[i : i + n]


class Languages:
    """Naive Bayes over character n-grams with add-one smoothing; the classes are those of the samples."""

    def __init__(self, samples: dict[str, list[str]]):
        self.names = sorted(lang for lang, texts in samples.items() if texts)
        counts = [Counter(g for t in samples[lang] for w in _words(t) for g in _grams(w)) for lang in self.names]
        every = Counter()
        for c in counts:
            every.update(c)
        kept = [g for g, n in every.items() if n > 1]
        totals = [sum(c[g] for g in kept) + len(kept) + 1 for c in counts]
        self.logs = {g: tuple(math.log((c[g] + 1) / t) for c, t in zip(counts, totals)) for g in kept}
        self.known: dict[str, tuple[float, ...]] = {}  # words scored before
        seen = Counter(c for texts in samples.values() for t in texts for c in t.casefold() if c.isalpha())
        self.alphabet = frozenset(c for c, n in seen.items() if n > 1)

    def _score(self, word: str) -> tuple[float, ...]:
        rows = [ls for g in _grams(word) if (ls := self.logs.get(g)) is not None]
        own = tuple(map(sum, zip(*rows))) if rows else (0.0,) * len(self.names)
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[word] = own
        return own

    def of(self, text: str) -> tuple[str | None, float]:
        """(language, odds in nats to the next); None where it isn't sure, OTHER where most letters are of no language known."""
        if not text.isascii():
            folded = text.casefold()
            strange = {c for c in set(folded) if c.isalpha() and c not in self.alphabet}
            if strange and self.alphabet:
                own = [c for c in folded if c.isalpha()]
                if sum(c in strange for c in own) > len(own) / 2:
                    return OTHER, math.inf
        if len(self.names) < 2:
            return None, 0.0
        scores = [0.0] * len(self.names)
        for w in _words(text):
            if (own := self.known.get(w)) is None:
                own = self._score(w)
            for k, x in enumerate(own):
                scores[k] += x
        order = sorted(range(len(scores)), key=lambda k: -scores[k])
        odds = scores[order[0]] - scores[order[1]]
        return (self.names[order[0]] if odds >= SURE else None), odds


def _kind(line: str) -> str:
    s = line.lstrip()
    return "item" if re.match(r"[-*•]\s|\d{1,3}[.)]\s", s) else "sign" if s.startswith("— ") and len(s) < 80 else "prose"


def _shape(token: str, kind: str) -> str:
    if token[0].isdigit():
        return "9"
    if token[0].isalpha():
        return "N" if token[0].isupper() else token if kind != "prose" else "w"
    return token


def end_contexts(text: str) -> Iterator[tuple[str, bool]]:
    """(kind of line, last shapes) of every place of a text, and whether the text ends there."""
    lines = [ln for ln in text.split("\n") if ln.strip()]
    for k, line in enumerate(lines):
        kind = _kind(line)
        shapes = [s for s in (_shape(t, kind) for t in _TOKEN.findall(line))]
        merged = [s for i, s in enumerate(shapes) if not (s == "N" and i and shapes[i - 1] == "N")]
        for i, s in enumerate(merged):
            end = k == len(lines) - 1 and i == len(merged) - 1
            yield f"{kind}|{merged[i - 1] if i else '^'}|{s}", end
            yield f"{kind}|*|{s}", end


def _last_contexts(text: str) -> list[str]:
    """The context of the end, and the shorter one it backs off to."""
    line = [ln for ln in text.split("\n") if ln.strip()][-1]
    return [c for c, _ in end_contexts(line)][-2:]


def _name_ends(text: str) -> Iterator[tuple[str, bool]]:
    for w in re.findall(r"[^\W\d_]{4,}", text):
        if w[0].isupper():
            w = w.lower()
            for i in range(3, len(w) + 1):
                yield w[i - 3 : i], i == len(w)


def asked_contexts(response: str | None) -> list[str]:
    """The contexts whose endings a decision about the response may ask for."""
    text = bare(response)
    if not text:
        return []
    names = re.findall(r"[^\W\d_]+", text)[-1:]
    return [*dict.fromkeys(_last_contexts(text)), *(f"name|{w.lower()[-3:]}" for w in names if len(w) > 2)]


class Endings:
    """How often a text ends in a context, and a name after its last letters; smoothed.

    ``itself``: the text that is judged is among those counted; its own end is no evidence.
    """

    def __init__(self, rows: list[tuple[str, int, int]], itself: bool = True):
        self.seen = {c: (ends, n) for c, n, ends in rows}
        self.itself = itself

    def probability(self, context: str) -> float:
        ends, n = self.seen.get(context, (0, 0))
        own = min(ends, int(self.itself))
        return (ends - own + 0.02) / (n - own + 1)


class Refusals:
    """Naive Bayes of sentences that decline against all others, over words, pairs and triples of words.

    It is fitted on a bounded sample of responses, of which the phrases label those that
    decline; what it learns are the other ways of saying so that stand beside them.
    """

    def __init__(self, samples: list[tuple[str | None, str | None]]):
        declined: Counter[str] = Counter()
        others: Counter[str] = Counter()
        for query, response in samples:
            text = bare(response)
            own = _outside(query or "", text)
            into = declined if refuses(query or "", text) else others
            for s in _SENTENCE.findall(own):
                into.update(set(self._grams(s)))
        kept = [g for g in declined.keys() | others.keys() if declined[g] + others[g] > 1]
        a, b = sum(declined[g] for g in kept) + len(kept) + 1, sum(others[g] for g in kept) + len(kept) + 1
        self.logs = {g: math.log((declined[g] + 1) / a) - math.log((others[g] + 1) / b) for g in kept}
        self.fitted = len(declined) > 0

    @staticmethod
    def _grams(sentence: str) -> Iterator[str]:
        words = _LETTERS.findall(sentence.lower())
        for n in (1, 2, 3):
            for i in range(len(words) - n + 1):
                yield " ".join(words[i : i + n])

    def declines(self, sentence: str) -> bool:
        if not self.fitted:
            return False
        found = [x for g in self._grams(sentence) if (x := self.logs.get(g)) is not None]
        return len(found) >= LEAST_GRAMS and sum(found) >= DECLINES


def classify(query: str | None, response: str | None, languages: Languages, endings: Endings, refusals: Refusals | None = None) -> str | None:
    """The defect of a pair, or None."""
    text = bare(response)
    left = letters(text)
    if not left or left in PLACEHOLDERS:
        return "empty"
    asked = letters(query or "")
    if asked and (asked in left):
        if left.replace(asked, " ").replace(" ", "") in LABELS | {""} or all(p in LABELS for p in left.replace(asked, " ").split()):
            return "copied"
    if refuses(query or "", text, refusals):
        return "refusal"
    wanted = requested_language(query or "", languages)
    if wanted:
        own = _QUOTED.sub(" ", text)
        if sum(1 for _ in _words(own)) < LEAST_WORDS:
            own = text
        if query and query.strip() and query.strip() in own:
            own = own.replace(query.strip(), " ")
        given, _ = languages.of(own)
        if given and given != wanted:
            return "language"
    if truncated(text, endings):
        return "truncated"
    return None


def requested_language(query: str, languages: Languages) -> str | None:
    """The language the prompt asks for, else the one it is written in."""
    for m in _ASKED.finditer(query):
        for lang, names in NAMES.items():
            if m.group(1).lower() in names.split():
                return lang
    return languages.of(re.sub(r"\([^()]*\)", " ", query))[0]


def _outside(query: str, text: str) -> str:
    """The text without quotations and without the prompt."""
    own = text
    if query.strip():
        own = own.replace(query.strip(), " ")
    return _QUOTED.sub(" ", own)


def refuses(query: str, text: str, refusals: Refusals | None = None) -> bool:
    """Whether nothing but refusals and courtesies is said outside quotations; by phrases, and by the classifier where one is given."""
    declined = False
    for s in _SENTENCE.findall(_outside(query, text)):
        if len(letters(s)) < 2 or s.strip().lower().rstrip(":") in ("you ask", "you asked", "the question is", "question", "q", "a"):
            continue
        if _REFUSAL.search(s) or (refusals is not None and refusals.declines(s)):
            declined = True
        elif not _COURTESY.search(s) and not (len(s.split()) <= 2):
            return False
    return declined


def truncated(text: str, endings: Endings) -> bool:
    """Whether the text breaks off, by the likelihood of its end."""
    if _OPENED_ITEM.search(text) or text[-1] in ",;:—–([{«“„¿¡&":
        return True
    contexts = _last_contexts(text)
    if not contexts or min(map(endings.probability, contexts)) < ENDS:
        return bool(contexts)
    kind, _, last = contexts[0].split("|", 2)
    if last == "N" and kind == "item":
        name = re.findall(r"[^\W\d_]+", text)[-1].lower()
        return len(name) < 3 or endings.probability(f"name|{name[-3:]}") < NAME_ENDS
    return False


def defects(df: DataFrame, labelled: DataFrame, id_col: str = "response_id", query_col: str = "query", response_col: str = "response", lang_text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, defect): every defective response with exactly one of empty, truncated, refusal, copied, language.

    Rows equal in id, query and response count once; a null id is kept. A null or blank
    prompt asks for no language and can't be copied. ``chunks_used`` and other columns are
    not read. ``labelled`` gives texts with a language label; a bounded sample of it fits
    the language model, the statistics of endings are counted over all responses.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(query_col).alias("query"), F.col(response_col).alias("response")).distinct()
    rows = materialize(rows, "pairs")

    # the least by hash are drawn, so the sample doesn't depend on the order of rows; a task keeps SAMPLE of each language
    lang = F.regexp_extract(F.lower(F.trim(F.col(lang_col))), "^([a-z]{2})(?:[-_].*)?$", 1)
    texts = labelled.select(lang.alias("lang"), F.col(lang_text_col).alias("text")).filter((F.col("lang") != "") & F.length("text").between(SHORT, LONG))
    w = Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text")
    drawn = texts.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= SAMPLE).select("lang", "text").toArrow().to_pydict()
    samples: dict[str, list[str]] = {}
    for code, text in zip(drawn["lang"], drawn["text"]):
        samples.setdefault(code, []).append(text)
    samples = {code: own for code, own in samples.items() if len(own) >= LEAST_TEXTS}
    share = min(1.0, REFUSAL_SAMPLE / max(1, rows.count()))
    drawn = rows.filter(F.pmod(F.xxhash64("query", "response"), F.lit(1 << 62)) < max(1, int(share * (1 << 62)))).select("query", "response")
    drawn = drawn.filter(F.coalesce(F.length("response"), F.lit(0)) <= LONG).limit(2 * REFUSAL_SAMPLE).toArrow().to_pydict()
    model = spark.sparkContext.broadcast((Languages(samples), Refusals(list(zip(drawn["query"], drawn["response"])))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        ends: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                t = bare(t)
                for c, end in end_contexts(t):
                    seen[c] += 1
                    ends[c] += end
                for g, end in _name_ends(t):
                    seen[f"name|{g}"] += 1
                    ends[f"name|{g}"] += end
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()), pa.array([ends[c] for c in seen], pa.int64())], ["context", "n", "ends"])

    stats = rows.select("response").mapInArrow(count, "context string, n long, ends long").groupBy("context").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    # joined to the responses that end in them, however many there are
    key = F.xxhash64("id", "query", "response")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = pa.array([asked_contexts(t) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pc.list_parent_indices(asked)), asked.flatten()], ["key", "context"])

    asked = rows.select(key.alias("key"), "response").mapInArrow(ask, "key long, context string")
    known = asked.join(stats, "context").groupBy("key").agg(F.collect_set(F.struct("context", "n", "ends")).alias("known"))
    joined = rows.withColumn("key", key).join(known, "key", "left").select("id", "query", "response", "known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, queries, responses, known = batch.columns
            languages, refusals = model.value
            found = [classify(q, r, languages, Endings([(x["context"], x["n"], x["ends"]) for x in k or ()]), refusals) for q, r, k in zip(queries.to_pylist(), responses.to_pylist(), known.to_pylist())]
            at = pa.array([i for i, f in enumerate(found) if f], pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(at), pa.array([f for f in found if f], pa.string())], ["id", "defect"])

    return joined.mapInArrow(run, f"id {kind}, defect string").select(F.col("id").alias(id_col), "defect")
