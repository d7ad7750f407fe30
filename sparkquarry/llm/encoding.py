"""Texts read with the wrong character encoding: finding and restoring them.

Method: noisy-channel decoding. Every damaged word becomes a lattice of edges over its
characters: a character as it stands, a run of characters as the bytes that one of several
encodings gives for it, one character as the byte of a one-byte encoding, and a wildcard
where bytes were lost (one to three marks for one letter, or a lead byte with a lost
continuation). Edges of all encodings compete, wherever they begin and end. A Viterbi search
over lattice and words at once weighs what the channel does against how often the words
occur in the corpus; all words of the corpus that some path can spell take part.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize

LOST = "�"
#: Encodings UTF-8 bytes were read in. "western" holds Windows-1252 and Latin-1 together.
CODECS = ("western", "cp437", "cp850", "mac_roman", "cp1251")
#: Rounds of wrong reading undone, one after another.
ROUNDS = 3
#: Rows decided at once, with the words they ask for.
ROWS = 500
#: Costs in nats: of a reading of a sequence, of leaving it, of leaving what can't stand, of a word the corpus doesn't have, of a lost character that stays.
DECODED, LEFT, BROKEN, UNKNOWN, STAYS = 1.0, 4.0, 40.0, 9.0, 20.0
#: Costs of one character as another one-byte encoding has it, and of an encoding that is seldom met.
ONE_BYTE, SELDOM = 2.5, 3.0
#: Cost of a sequence in another encoding than Western, where both explain a run.
RARER = 0.5
#: Cost of a mark lost, besides its own; a piece of a word beside it costs UNKNOWN.
MARK = 8.0
#: Costs of a letter lost as one, two or three marks.
LOST_AS = (0.5, 1.0, 3.0)
#: Alternations of plain and damaged stretches in one word.
STRETCHES = 24
#: Encodings a Western byte may have been read in as a Cyrillic letter, and as some Western letter or sign.
CYRILLIC, WESTERN = ("cp1251", "koi8-r", "iso8859-5", "cp866"), ("mac_roman", "cp437", "cp850")


def _bytes_of(codec: str) -> dict[str, int]:
    """Character -> byte from 0x80 on."""
    if codec == "western":
        table = {chr(b): b for b in range(0x80, 0x100)}
        return table | {bytes([b]).decode("cp1252"): b for b in range(0x80, 0x100) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


BYTES = {c: _bytes_of(c) for c in (*CODECS, "koi8-r", "iso8859-5", "cp866")}
_LETTER = r"[^\W\d_]"
#: Bytes that lead the sequences of Latin letters and of typographic marks.
_LEADS = {2: (0xC2, 0xC3, 0xC4, 0xC5), 3: (0xE2,)}
#: Leads of other scripts, which count only where two or more sequences follow each other.
_OTHER = {2: (0xCE, 0xCF, 0xD0, 0xD1), 3: (0xE1,), 4: (0xF0,)}


def _class(codec: str, wanted) -> str:
    return "[" + "".join(re.escape(c) for c, b in BYTES[codec].items() if wanted(b)) + "]"


def _sequence(codec: str, leads: dict[int, tuple]) -> str:
    cont = _class(codec, lambda b: 0x80 <= b < 0xC0)
    return "|".join(f"{_class(codec, lambda b, ls=ls: b in ls)}{cont}{{{n - 1}}}" for n, ls in leads.items())


def _pattern(codec: str) -> str:
    parts = [f"(?:{_sequence(codec, _LEADS)})+"]
    if codec == "western":
        parts.append(f"(?:{_sequence(codec, _OTHER)}){{2,}}")
    if codec in ("western", "cp1251"):  # a no-break space that has since become a plain one
        a = "Ã" if codec == "western" else "Г"
        parts += [rf"{a} (?=[\s,.;:!?…’”»)]|$)", rf"(?<=[a-zß-ÿšž]){a} (?=[a-zß-ÿšž]|$)"]
    if codec == "western":
        parts += [r"Å (?=[a-zß-ÿšž])", "(?<=[Ãƒ])Ë[†œ]", "(?<=Ã)Æ’"]  # the latter from a second reading
    return "|".join(parts)


_SEQUENCES = {c: re.compile(_pattern(c)) for c in CODECS}
#: Characters a sequence of each encoding begins with.
_BEGINS = {c: frozenset(x for x, b in BYTES[c].items() if b in {0xC2, 0xC3, 0xC4, 0xC5, 0xE2} | ({0xCB, 0xC6, *_OTHER[2], *_OTHER[3], *_OTHER[4]} if c == "western" else set())) for c in CODECS}
_BEGIN = {c: re.compile("[" + "".join(map(re.escape, sorted(_BEGINS[c]))) + "]") for c in CODECS}
_ENTITY = re.compile(r"&[A-Za-z]{2,8}\d{0,2};")
_CYRILLIC = "[Ѐ-џҐґ]"
_LATIN = "[A-Za-zÀ-ſ]"
#: One Western byte read as Cyrillic: a Cyrillic letter in a Latin word, or alone between Latin words.
_MIXED = re.compile(rf"{_LATIN}+{_CYRILLIC}(?:{_LATIN}|{_CYRILLIC})*|{_CYRILLIC}+{_LATIN}(?:{_LATIN}|{_CYRILLIC})*|(?<={_LATIN} ){_CYRILLIC}(?= {_LATIN})")
#: Cyrillic letters that look like Latin ones, a disguise and not a wrong encoding.
_LOOKALIKE = str.maketrans("аеорсухАВЕКМНОРСТХіј", "aeopcyxABEKMHOPCTXij")
_WORD = re.compile(rf"{_LETTER}+")
_LOST_WORD = re.compile(rf"(?:{_LETTER}|{LOST})*{LOST}(?:{_LETTER}|{LOST})*")
#: Marks a wildcard may stand for, by what surrounds it; cost in nats.
_MARKS = (("“", 2.0), ("”", 2.0), ("’", 2.0), ("—", 2.5), ("…", 2.5), ("–", 4.0), ("«", 3.0), ("»", 3.0), ("„", 3.5), ("‘", 4.0), ("¿", 3.0), ("¡", 3.5))
#: What French drops before an apostrophe, and what English adds after one.
_ELIDED = re.compile(r"(?:^|[\W\d_])(?:[cdjlmnst]|qu|jusqu|lorsqu|puisqu)$", re.I)
_ADDED = re.compile(r"(?:s|t|d|m|ll|re|ve)(?![^\W\d_])")
#: A letter or sign where no Western text has it: a large accented letter or a sign after a small letter.
_ODD = r"(?<=[a-zß-ÿ])[À-ÖØ-Þ÷▀∩ˆ´ﬁﬂ˜¯](?=[a-zß-ÿﬁﬂ▀∩ˆ])|(?<=[a-zß-ÿ])[ÈÉÊËÚÌÍÎÏ](?![\w])"
_ODD_WORD = re.compile(_ODD)
#: Scan filter, looser than the decision: characters or pairs one of which every damaged text has. The sequences are those the decision knows.
SUSPECT = (
    # every alternative begins outside ASCII or with an ampersand, which is tested first
    "(?=[^\\x00-%'-\\x7f])(?:"
    "�|[Â-ÅâÎ-Ñáð](?:[\u0080-¿ŒœŠšŸŽžƒˆ˜–-•…‰‹›€™ ]|&[A-Za-z])"
    "|[─-╿Γ][^\\x00-\\x7f]|[¬√ƒ≈‚][^\\x00-\\x7f]|Г "
    "|(?<=[A-Za-zÀ-ſ] ?)[Ѐ-џҐґ]|[Ѐ-џҐґ][A-Za-zÀ-ſ]|[В-Ев][^\\x00-\\x7fа-я]"
    "|&([Aa](circ|tilde|uml|ring|acute)|Icirc|Iuml|ETH|eth|Ntilde|fnof);"
    f"|{_ODD}"
    f"|{'|'.join(map(_pattern, CODECS))})"
)
_NOT_ASCII = re.compile(r"[^\x00-\x7f]+")


def key_of(word: str) -> str:
    """What a word is looked up by: its ASCII letters with one mark for each stretch of others.

    A decoding or a wildcard changes such a stretch only, so every reading of a damaged
    word has its key. A word of other letters alone is its own key.
    """
    if any(c.isascii() for c in word):
        return _NOT_ASCII.sub(LOST, word)
    return LOST if len(word) == 1 and word < "ƀ" else "=" + word


def _decode(run: str, codec: str) -> str | None:
    """What the bytes of ``run`` are in UTF-8."""
    table = BYTES[codec]
    try:
        out = bytes(0xA0 if c == " " else table[c] for c in run).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return None
    return None if any(c < "\xa0" for c in out) and len(run) < 4 and codec != "western" else out


def unescape(text: str) -> str:
    """Entities of characters outside ASCII as characters, where they belong to a misread sequence."""
    if "&" not in text:
        return text
    plain = _ENTITY.sub(lambda m: u if len(u := html.unescape(m.group())) == 1 and not u.isascii() else m.group(), text)
    if plain == text:
        return text
    # only runs that hold a sequence are changed
    out, at = [], 0
    for m in re.finditer(r"(?:&[A-Za-z]{2,8}\d{0,2};|[^\x00-\x7f])+", text):
        run = _ENTITY.sub(lambda e: u if len(u := html.unescape(e.group())) == 1 and not u.isascii() else e.group(), m.group())
        s = _SEQUENCES["western"].search(run)
        if s and _ENTITY.search(m.group()):
            out += [text[at : m.start()], run]
            at = m.end()
    return "".join(out) + text[at:]


Edge = tuple[int, str, float]  # end, what it reads, cost


class Lattice:
    """The edges over a text, and the tokens (words with damage) they lie in.

    ``edges`` decode; ``guesses`` may only be part of a word that the corpus has, and read
    LOST as any letter outside ASCII, or as one of ``LEAD_LETTERS``.
    """

    def __init__(self, text: str):
        self.text = text
        self.edges: dict[int, list[Edge]] = {}
        self.guesses: dict[int, list[Edge]] = {}
        self.literal: dict[int, float] = {}  # cost of leaving a character that may be decoded
        spans = self._sequences()
        covered = {k for a, b in spans for k in range(a, b)}
        spans |= self._cyrillic(covered)
        spans |= self._lost() | self._one_byte(covered)
        self.tokens = self._words(spans)

    def _sequences(self) -> set[tuple[int, int]]:
        text, spans = self.text, set()
        have = set(text)
        for codec, pattern in _SEQUENCES.items():
            if have.isdisjoint(_BEGINS[codec]):
                continue
            end = 0
            for begin in _BEGIN[codec].finditer(text):
                if begin.start() < end or not (m := pattern.match(text, begin.start())):
                    continue
                end = m.end()
                decoded = _decode(m.group(), codec)
                if decoded is None:
                    continue
                spans.add(m.span())
                self._add(self.edges, m.start(), m.end(), decoded, DECODED + RARER * (codec != CODECS[0]))
                if len(decoded) > 1:  # each sequence of a run by itself, so that words may end between them
                    at = m.start()
                    for c in decoded:
                        n = len(c.encode("utf-8"))
                        if at + n <= m.end() and _decode(text[at : at + n], codec) == c:
                            self._add(self.edges, at, at + n, c, (DECODED + RARER * (codec != CODECS[0])) / len(decoded) + 0.01)
                            at += n
                        else:
                            break
        # overlapping spans of several encodings are one region; leaving it costs as much as leaving one sequence
        region: list[int] = []
        for a, b in [*sorted(spans), (len(text) + 1, 0)]:
            if region and a >= region[1]:
                price = (LEFT + (BROKEN if _structure(text, region[0], region[1]) else 0.0)) / (region[1] - region[0])
                self.literal |= dict.fromkeys(range(*region), price)
                region = []
            region = [region[0], max(region[1], b)] if region else [a, b]
        return spans

    def _add(self, edges: dict[int, list[Edge]], a: int, b: int, reads: str, cost: float) -> None:
        edges.setdefault(a, []).append((b, reads, cost))

    def _cyrillic(self, covered: set[int]) -> set[tuple[int, int]]:
        """Words with single Western bytes read as Cyrillic; sequences explain a run better than single letters do."""
        text, spans = self.text, set()
        for m in _MIXED.finditer(text) if _HAS_CYRILLIC(text) else ():
            if not covered.isdisjoint(range(*m.span())):
                continue
            for codec in CYRILLIC:
                table = BYTES[codec]
                if all(c in table or c.isascii() or c in BYTES["western"] for c in m.group()):
                    reads = "".join(bytes([table[c]]).decode("cp1252", "replace") if c in table else c for c in m.group())
                    if codec == CYRILLIC[0] or all(c.isalpha() and c < "ƀ" for c in reads):
                        spans.add(m.span())
                        self._add(self.edges if codec == CYRILLIC[0] else self.guesses, *m.span(), reads, DECODED + SELDOM * (codec != CYRILLIC[0]))
            if m.span() in spans:
                broken = BROKEN if _structure(text, *m.span()) else 0.0
                self.literal |= dict.fromkeys(range(*m.span()), (LEFT + broken) / (m.end() - m.start()))
        return spans

    def _lost(self) -> set[tuple[int, int]]:
        text, spans = self.text, set()
        for m in _LOST_RUN.finditer(text):
            spans.add(m.span())
            for i in range(*m.span()):
                for n, cost in enumerate(LOST_AS, 1):
                    if i + n <= m.end():
                        self._add(self.guesses, i, i + n, LOST, cost)
                lead = BYTES["western"].get(text[i - 1 : i], 0)
                if lead in LEAD_LETTERS:  # the continuation of a sequence is lost
                    self._add(self.guesses, i - 1, i + 1, chr(0xE000 + lead), DECODED + LOST_AS[0])
        return spans

    def _one_byte(self, covered: set[int]) -> set[tuple[int, int]]:
        text, spans = self.text, set()
        odd = {m.start() for m in _ODD_WORD.finditer(text)} - covered if not text.isascii() else set()
        for at in sorted(odd):
            a, b = at, at + 1
            while a and (text[a - 1].isalpha() or text[a - 1] in _ODD_SIGNS):
                a -= 1
            while b < len(text) and (text[b].isalpha() or text[b] in _ODD_SIGNS):
                b += 1
            if text[at] in _ODD_SIGNS:
                self.literal[at] = STAYS
            if (a, b) in spans:
                continue
            spans.add((a, b))
            for i in range(a, b):
                for codec in WESTERN if not text[i].isascii() else ():
                    byte = BYTES[codec].get(text[i])
                    reads = bytes([byte]).decode("cp1252", "replace") if byte else LOST
                    if reads.isalpha() and reads != text[i]:
                        self._add(self.guesses, i, i + 1, reads, ONE_BYTE)
        return spans

    def _words(self, spans: set[tuple[int, int]]) -> list[tuple[int, int]]:
        text, out = self.text, []
        for a, b in sorted(spans):
            while a and (text[a - 1].isalpha() or text[a - 1] in _JOINING):
                a -= 1
            while b < len(text) and (text[b].isalpha() or text[b] in _JOINING):
                b += 1
            if out and a < out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    def keys(self, token: tuple[int, int]) -> set[str]:
        """Keys of all words that a path through the token may spell."""
        text, (a, b), out = self.text, token, set()
        inside = {k for i in range(a, b) for edges in (self.edges, self.guesses) for j, _, _ in edges.get(i, ()) for k in range(i, j)}
        stretches: list[str] = []

        def words() -> None:
            for i in range(len(stretches)):
                for j in range(i + 1, min(len(stretches), i + STRETCHES) + 1):
                    part = stretches[i:j]
                    if LOST in part:
                        out.add("".join(part))
            stretches.clear()

        for i in range(a, b):
            c = text[i]
            if i in inside or not c.isascii():
                if not stretches or stretches[-1] != LOST:
                    stretches.append(LOST)
            elif c.isalpha():
                if stretches and stretches[-1] != LOST:
                    stretches[-1] += c
                else:
                    stretches.append(c)
            else:
                words()
        words()
        for i in range(a, b):
            for _, reads, _ in self.edges.get(i, ()):
                out |= {key_of(w) for w in _WORD.findall(reads) if not w.isascii()}
        for w in _WORD.findall(text[a:b]):
            out |= {key_of(x) for x in (w, w.translate(_LOOKALIKE)) if not x.isascii()}
        return out

    def best(self, token: tuple[int, int], words: dict, total: float) -> tuple[str, bool]:
        """(cheapest reading, whether it decodes anything) of a token; ``words`` is a trie of the corpus's words with their costs."""
        text, (a, b) = self.text, token
        unknown = UNKNOWN + math.log(total)
        # at each place by state: between words, in a plain word, in a word the corpus doesn't have, behind a word it has, before one;
        # a path is its cost, the path before, what was read last, and whether something was decoded
        paths: list[dict[str, tuple]] = [{} for _ in range(b - a + 1)]
        paths[0]["between"] = (0.0, None, "", False)

        def relax(j: int, state: str, cost: float, path: tuple, read: str, decodes: bool) -> None:
            have = paths[j - a].get(state)
            if have is None or cost < have[0]:
                paths[j - a][state] = (cost, path, read, path[3] or decodes)

        for i in range(a, b):
            here = paths[i - a]
            if not here:
                continue
            stays = STAYS + self._torn(i, i + 1) if text[i] == LOST else 0.0
            plain = [(i + 1, text[i], self.literal.get(i, 0.0) + stays, False)]
            decoded = [(j, reads, cost, True) for j, reads, cost in self.edges.get(i, ()) if j <= b]
            for state, path in here.items():
                if state == "elided":
                    continue
                cost = path[0]
                for j, reads, price, new in plain + decoded:
                    own, at = cost + price, state
                    for c in reads:
                        if c == LOST:
                            at = "plain" if at in ("between", "behind") else at
                        elif not c.isalpha():
                            at = "between"
                        elif at == "behind":
                            own = math.inf
                        elif c.isascii():
                            at = "plain" if at == "between" else at
                        elif at != "unknown":
                            at, own = "unknown", own + unknown
                    if own < math.inf:
                        relax(j, at, own, path, reads, new)
                if text[i] == LOST:
                    for n in (1, 3):
                        if text[i : i + n] == LOST * n and i + n <= b:
                            before, last = "", path
                            while last and len(before) < 12:
                                before, last = last[2] + before, last[1]
                            for mark, price in self._marks(i, i + n, (text[max(0, a - 12) : a] + before)[-12:]):
                                relax(i + n, "elided" if text[i + n : i + n + 1] == LOST else "between", cost + price + MARK + self._torn(i, i + n), path, mark, False)
            for path in (here[state] for state in ("between", "elided") if state in here):
                stack = [(words, i, path[0], "", False)]
                while stack:
                    node, k, cost, read, decodes = stack.pop()
                    if k > i and "" in node:
                        relax(k, "behind", cost + node[""], path, read, decodes)
                    if k >= b:
                        continue
                    if text[k] in node:
                        stack.append((node[text[k]], k + 1, cost + self.literal.get(k, 0.0), read + text[k], decodes))
                    for edges, new in ((self.edges, True), (self.guesses, None)):
                        for j, reads, price in edges.get(k, ()):
                            if j > b:
                                continue
                            if reads == LOST or "\ue000" <= reads[0] <= "\ue0ff":
                                wanted = LEAD_LETTERS.get(ord(reads[0]) - 0xE000)
                                for c, child in node.items():
                                    if c and not c.isascii() and (wanted is None or c in wanted):
                                        stack.append((child, j, cost + price, read + c, decodes or wanted is not None))
                                continue
                            at = node
                            for c in reads:
                                at = at.get(c)
                                if at is None:
                                    break
                            else:
                                stack.append((at, j, cost + price, read + reads, True))
        last = min((p for state, p in paths[-1].items() if state != "elided"), key=lambda p: p[0])
        decodes, read = last[3], []
        while last:
            read.append(last[2])
            last = last[1]
        return "".join(reversed(read)), decodes

    def _torn(self, a: int, b: int) -> float:
        """Cost of the pieces of words beside lost characters that are no letters."""
        return UNKNOWN * (self.text[a - 1 : a].isalpha() + self.text[b : b + 1].isalpha())

    def _marks(self, a: int, b: int, before: str) -> Iterator[tuple[str, float]]:
        """Marks that lost characters may have been, by what surrounds them."""
        left, right = before[-1:].strip(), self.text[b : b + 1].strip()
        if left == LOST:
            return
        if right == LOST:  # only an elision before a word that the corpus has
            if _ELIDED.search(before):
                yield "’", 2.0
            return
        for mark, cost in _MARKS:
            if mark in "“«„‘¿¡":
                fits = not left and bool(right)
            elif mark in "”»…":
                fits = bool(left) and not right
            elif mark == "’" and left and right:  # an elision before a vowel, or an English ending
                fits = (bool(_ELIDED.search(before)) and right.lower() in "aeiouyhâàéèêëîïôœûù") or (left.isalpha() and bool(_ADDED.match(self.text, b)))
            else:
                fits = bool(left) == bool(right) and not (mark in "—–" and left)
            if fits:
                yield mark, cost


_HAS_CYRILLIC = re.compile("[Ѐ-ґ]").search
_LOST_RUN = re.compile(f"{LOST}+")
_JOINING = f"'’{LOST}"
_ODD_SIGNS = "÷▀∩ˆ´˜¯"
#: Letters that a lead byte begins when its continuation is lost.
LEAD_LETTERS = {lead: frozenset(c for x in range(64) if (c := chr((lead & 0x1F) << 6 | x)).isalpha()) for lead in _LEADS[2]}


def keys_of(text: str) -> set[str]:
    """Keys of all words that a decision about ``text`` may ask for.

    A second reading changes the same stretches as the first, so it asks for the same keys;
    texts are read again for what only then becomes a sequence.
    """
    out: set[str] = set()
    for _ in range(ROUNDS):
        text = unescape(text)
        lattice = Lattice(text)
        for token in lattice.tokens:
            out |= lattice.keys(token)
        again, at = [], 0
        for i in sorted(lattice.edges):
            if i >= at:
                end, reads, _ = lattice.edges[i][0]
                again += [text[at:i], reads]
                at = end
        if not at:
            break
        text = "".join(again) + text[at:]
    return out


def _structure(text: str, a: int, b: int) -> bool:
    """Whether the run can't stand as it is: a mark in the middle of a word, a capital or a sign after a small letter."""
    run = text[a:b]
    before, after = text[a - 1 : a], text[b : b + 1]
    marks = [c for c in run if not c.isalpha()]
    return (
        len(run) > 2
        or run[0] in "Â├┼┬─Γ√¬ƒ≈‚"
        or (before.islower() and run[0].isupper())
        or (bool(marks) and after.isalpha())
        or any(0x80 <= ord(c) < 0xA0 for c in run)
        or run.endswith(" ")
        or "Ѐ" <= run[0] <= "џ"
        or (len(run) == 2 and run[1].isalpha() and run[1] not in "ªº")
        or run[1:] in ("¤", "¥", "¦", "§", "¨", "©", "ª", "¬", "\xad", "®", "¯", "°", "±", "²", "³", "´", "µ", "¶", "·", "¸", "¹", "º", "¼", "½", "¾", "¢", "£", "\xa0", "†", "‡", "ˆ", "˜", "‰", "€", "™", "ƒ", "¿", "¡")
    )


#: Words of the corpus that are damaged themselves: a large letter after a small one, or a lead byte's letter before another letter outside ASCII.
_GARBLED = re.compile("[a-zß-öø-ÿœšž][A-ZÀ-ÖØ-ÞŒŠŽ]|[ÂÃ][^\x00-\x7f]")


def _trie(counts: dict[str, int], total: float) -> dict:
    words: dict = {}
    for w, n in counts.items():
        if _GARBLED.search(w):
            continue
        node = words
        for c in w:
            node = node.setdefault(c, {})
        node[""] = -math.log(n / total)
    return words


def restore(text: str, counts: dict[str, int], total: float = 1e6) -> tuple[str, bool]:
    """(restored text, whether anything was damaged); ``counts`` of the corpus's words outside ASCII, ``total`` of all its words."""
    damaged = LOST in text
    total = max(total, 1.0, *counts.values()) if counts else max(total, 1.0)
    words = _trie(counts, total)
    for _ in range(ROUNDS):
        plain = unescape(text)
        changed = plain != text
        text = plain
        lattice = Lattice(text)
        out, at = [], 0
        for a, b in lattice.tokens:
            read, decodes = lattice.best((a, b), words, total)
            if read == text[a:b] or (decodes and _disguise(text[a:b], read, counts)):
                continue
            out += [text[at:a], read]
            at = b
            changed = True
            damaged = damaged or decodes
        text = "".join(out) + text[at:]
        if not changed:
            break
    return text, damaged


def _disguise(raw: str, reading: str, counts: dict[str, int]) -> bool:
    """Letters of another script that only look like the right ones."""
    plain = raw.translate(_LOOKALIKE)
    return raw != plain and counts.get(plain, 0) > counts.get(reading, 0)


def _corpus_words(texts: DataFrame) -> DataFrame:
    """(key, word, n) of all words outside ASCII, over all texts; the empty word has the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {"": 0}

        def out() -> pa.RecordBatch:
            words = list(seen)
            b = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([key_of(w) if w else "" for w in words], pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "key", "n"])
            seen.clear()
            seen[""] = 0
            return b

        for batch in batches:
            for t in batch.column(0).to_pylist():
                parts = t.split()
                total = len(parts)
                for part in () if t.isascii() else parts:
                    if not part.isascii():
                        found = _WORD.findall(part)
                        total += len(found) - 1
                        for w in found:
                            if not w.isascii():
                                seen[w] = seen.get(w, 0) + 1
                seen[""] += total
            if len(seen) > 200_000:
                yield out()
        yield out()

    return texts.mapInArrow(run, "word string, key string, n long").groupBy("key", "word").agg(F.sum("n").alias("n"))


def repair_encoding(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(id, text, restored): the damaged texts and what they were, as far as it can be told.

    A text is damaged when the search decodes some run of it, or when it holds a
    replacement character; the latter stays where no reading is found. Null, empty and
    intact texts give no row. Rows equal in id and text count once; a null id is kept.
    Other columns are not read. Frequencies are counted over all texts and weighed against the
    number of all words, so a table and its multiples are restored alike; only suspect texts
    and the words their lattices ask for are shuffled.
    """
    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    suspects = texts.filter(F.col("text").rlike(SUSPECT)).distinct()

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = [sorted(keys_of(t)) for t in batch.column(1).to_pylist()]
            yes = pa.array([i for i, (m, t) in enumerate(zip(asked, batch.column(1).to_pylist())) if m or LOST in t], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(yes), batch.column(1).take(yes), pa.array(asked, pa.list_(pa.string())).take(yes)], ["id", "text", "keys"])

    asked = suspects.mapInArrow(propose, f"id {kind}, text string, keys array<string>")
    asked = materialize(asked.withColumn("row", F.xxhash64("id", "text")), "suspects")
    wanted = asked.select("row", F.explode("keys").alias("key"))
    corpus = materialize(_corpus_words(texts.select("text")), "corpus-words")
    total = float(corpus.filter("word = ''").agg(F.sum("n")).first()[0] or 1)
    # the words of a key are few (ways to accent its letters) and are one row before they meet the suspects
    words = corpus.filter("word <> ''").join(wanted.select("key").distinct(), "key", "left_semi")
    words = words.groupBy("key").agg(F.collect_list(F.struct("word", "n")).alias("words"))
    known = wanted.join(words, "key").groupBy("row").agg(F.flatten(F.collect_list("words")).alias("known"))
    rows = asked.join(known, "row", "left").select("id", "text", "known")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, ROWS):
                batch = whole.slice(begin, ROWS)
                sizes = batch.column(2).value_lengths().fill_null(0).to_pylist()
                flat = batch.column(2).flatten()
                words, counts = flat.field("word"), flat.field("n")
                keep, texts, at = [], [], 0
                for i, (t, size) in enumerate(zip(batch.column(1).to_pylist(), sizes)):
                    known = dict(zip(words.slice(at, size).to_pylist(), counts.slice(at, size).to_pylist()))
                    at += size
                    restored, damaged = restore(t, known, total)
                    if damaged:
                        keep.append(i), texts.append(restored)
                rows = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(texts, pa.string())], ["id", "text", "restored"])

    return rows.mapInArrow(decide, f"id {kind}, text string, restored string").select(F.col("id").alias(id_col), F.col("text").alias(text_col), "restored")
