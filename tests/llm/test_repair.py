import random

import pytest

from sparkquarry.llm import encoding, pairs, scans

CLEAN = "Près de l’été, Größe und Ähre — “Škoda” café naïve señor Ôraerk. Der Müller trägt die Brücke über den Fluß."
WORDS = {w: 50 for w in encoding._WORD.findall(CLEAN) if not w.isascii()} | {"IRMÃ": 30, "ALEMÃ": 30}


def misread(text, codec):
    data = text.encode("utf-8")
    out = ""
    for b in data:
        try:
            out += bytes([b]).decode(codec)
        except UnicodeDecodeError:
            out += chr(b)
    return out


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251"])
def test_restores_misread_utf8(codec):
    assert encoding.restore(misread(CLEAN, codec), WORDS) == (CLEAN, True)


def test_restores_double_entities_and_single_bytes():
    assert encoding.restore(misread(misread(CLEAN, "cp1252"), "cp1252"), WORDS) == (CLEAN, True)
    assert encoding.restore("geh&Atilde;&para;rte", {"gehörte": 9}) == ("gehörte", True)
    assert encoding.restore("die Brьcke", WORDS) == ("die Brücke", True)
    assert encoding.restore("Der M�ller tr�gt", WORDS) == ("Der Müller trägt", True)
    assert encoding.restore("quite lost xqk�zz", {}) == ("quite lost xqk�zz", True)


@pytest.mark.parametrize(("text", "words", "want"), [
    ("il a d�jà dit", {"déjà": 50}, "il a déjà dit"), ("il a d�jà dit", {}, "il a d�jà dit"), ("tr��gt", {"trägt": 50}, "trägt"), ("tr��gt", {}, "tr��gt"), ("d��j�� l���aube", {"déjà": 50}, "déjà l’aube"),
    ("l��t�", {"été": 50}, "l’été"),
    ("trÃ�gt", {"trägt": 50, "trőgt": 90}, "trägt"), ("l�homme et l�été", {"été": 30}, "l’homme et l’été"), ("the guard�s post", {}, "the guard’s post"),
    ("Grˆﬂe naÔve ÈtÈ", {"Größe": 900, "naïve": 900, "été": 900}, "Größe naïve été"), ("Gr÷▀e na∩ve", {"Größe": 900, "naïve": 900}, "Größe naïve"), ("na´ve", {"naïve": 900}, "naïve"), ("Grˆﬂe naÔve ÈtÈ", {}, "Grˆﬂe naÔve ÈtÈ"),
    ("GrЖъe".replace("Жъ", "цъ".encode("cp1251").decode("koi8-r")), {}, None), ("Gr" + "öß".encode("cp1252").decode("koi8-r") + "e", {"Größe": 90}, "Größe"), ("Gr" + "öß".encode("cp1252").decode("iso8859-5") + "e", {"Größe": 90}, "Größe"),
])
def test_lattice_with_wildcards_and_one_byte_encodings(text, words, want):
    for times in (1, 10_000):  # a corpus and a large multiple of it
        got = encoding.restore(text, {w: n * times for w, n in words.items()}, 1e6 * times)[0]
        assert want is None or got == want


def test_frequent_words_are_no_reward():
    assert encoding.restore("l�x", {"lôx": 5_000_000}, 1e6)[0] == "lôx"
    assert encoding.restore("pa pâ là", {"pâ": 5_000_000, "là": 9}, 1e6) == ("pa pâ là", False)


def test_long_damage_without_breaks():
    long = misread("é" * 20_000, "cp1252")
    assert encoding.restore(long, {})[0] == "é" * 20_000
    assert encoding.restore("�" * 20_000, {}) == ("�" * 20_000, True)
    assert len(encoding.keys_of(misread("aé" * 3_000, "cp1252"))) < 400_000


@pytest.mark.parametrize("text", [CLEAN, "“IRMÃ” was cut above, “ALEMÃ…” below it", "São Ãvala! Nÿx", "√41, or Å 7·4", "шщфч ойюе", "left 72 boxes □□□ &mdash; so", "Ãndrel, called Ðunmar, ±15°", "a < b & c", "𐌸𐌽 ᛗᚤ αβγ"])
def test_leaves_intact_texts(text):
    assert encoding.restore(text, WORDS) == (text, False)


META = "chunk_id long, text string, source string, known int"


def test_repair_encoding(spark):
    rows = [(1, CLEAN, "s", 1), (2, misread(CLEAN, "cp1252"), "s", 1), (2, misread(CLEAN, "cp1252"), "s", 2), (3, None, None, 1), (4, "", "s", 1), (5, "Der M�ller " * 2000, "s", 1), (None, misread(CLEAN, "cp850"), "s", 1), (6, "plain", "s", 1)]
    got = {r["chunk_id"]: r["restored"] for r in encoding.repair_encoding(spark.createDataFrame(rows, META)).collect()}
    assert got == {2: CLEAN, 5: "Der Müller " * 2000, None: CLEAN}
    assert encoding.repair_encoding(spark.createDataFrame([], META)).count() == 0


@pytest.mark.parametrize("times", [1, 20])
def test_restores_alike_at_every_size(spark, times):
    rows = [(i, f"il monte à la porte {i}", "s", 1) for i in range(30 * times)] + [(-1, "il monte � la porte", "s", 1)]
    got = {r["chunk_id"]: r["restored"] for r in encoding.repair_encoding(spark.createDataFrame(rows, META)).collect()}
    assert got == {-1: "il monte à la porte"}


def test_scan_filter_is_looser_than_the_decision(spark):
    marks = [chr(c) for c in (*range(0xA0, 0x180), *range(0x2000, 0x2400, 7), 0x20AC, 0x2122, 0x2190, 0x2192, 0x2212)]
    texts = [f"from 5 {misread(c, codec)} on" for c in marks for codec in ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251")]
    texts += ["gehÃ&para;rte", "geh&Atilde;¶rte", "Г ,", "ÃÆ’"]
    texts = [t for t in texts if encoding.Lattice(encoding.unescape(t)).edges] + ["Grˆﬂe", "naÔve", "ÈtÈ", "Gr÷▀e", "na∩ve", "na´ve"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert len(texts) > 1000 and [r["text"] for r in df.filter(~df.text.rlike(encoding.SUSPECT)).collect()] == []
    rows = [(i, f"a toll of 5 {misread(c, 'cp850')} each", "s", 1) for i, c in enumerate("€™→−")]
    got = {r["chunk_id"]: r["restored"] for r in encoding.repair_encoding(spark.createDataFrame(rows, META)).collect()}
    assert got == {i: f"a toll of 5 {c} each" for i, c in enumerate("€™→−")}


SCAN = "The Iron Gate\n12\nThe captain of the iron gate was not conde-\nmned, for the b@stion and tbe silver\n— 13 —\nlantern had prevai1ed."


def vocabulary():
    v = scans.Vocabulary()
    for w, n in (("the", 900), ("lantern", 60), ("barricade", 80), ("harbour", 70), ("turn", 40), ("silenced", 70)):
        v.add(w, (n, n))
    return v


def test_automaton():
    found = lambda w: {x for x, _, _ in vocabulary().readings(w, (1, 1))}
    assert found("tbe") == {"the"} and found("lantem") == {"lantern"} and found("barricacle") == {"barricade"}
    assert found("silcncecl") == {"silenced"} and found("lantern") == set() and found("lnatern") == set()


def weighted_distance(form, word):
    """Least edits by dynamic programming over pairs of beginnings: 1 or 2 confusions, or one edit of any kind."""
    best = {(0, 0): {0}}
    for i in range(len(form) + 1):
        for j in range(len(word) + 1):
            for e in best.get((i, j), ()):
                steps = [(1, 1, 0)] if i < len(form) and j < len(word) and form[i] == word[j] else []
                if e < scans.EDITS:
                    steps += [(len(a), len(b), 1) for a, b in scans.CONFUSIONS if form.startswith(a, i) and word.startswith(b, j)]
                if e == 0:
                    steps += [(1, 0, scans.ARBITRARY), (0, 1, scans.ARBITRARY), (1, 1, scans.ARBITRARY)]
                for a, b, cost in steps:
                    if i + a <= len(form) and j + b <= len(word):
                        best.setdefault((i + a, j + b), set()).add(e + cost)
    return min((e for e in best.get((len(form), len(word)), ()) if e), default=None)


def test_retrieval_equals_brute_force(monkeypatch):
    random.seed(6)
    words = {"".join(random.choice("cebhdlrnimuaw") for _ in range(random.randint(3, 7))) for _ in range(250)} | {"modern", "mountain", "castle"}
    forms = {"rnodem", "rnountam", "castlo", "caste", "moclem"} | {w[:i] + random.choice("cebhdlrnimuaw") + w[i + random.randint(0, 2) :] for w in list(words)[:120] for i in (0, 2, len(w) - 1)}
    v = scans.Vocabulary()
    for w in words:
        v.add(w, (10**9, 10**9))
    for f in forms:
        found = {}
        for w, _, e in v.readings(f, (1, 1)):
            found[w] = min(e, found.get(w, 9))
        want = {w: d for w in words if (d := weighted_distance(f, w)) and (w != f or d <= scans.EDITS)}
        assert {w: e for w, e in found.items() if w != f} == {w: d for w, d in want.items() if w != f}, f
        for w, e in found.items():
            keys = scans.form_keys(f) & scans.word_keys(w)
            assert keys or (e == scans.ARBITRARY and f"E{scans._begin(len(f))}{f[-scans._begin(len(f)):]}" in scans.end_keys(w)), (f, w)


def test_arbitrary_edits_are_put_right_in_noisy_texts_only(spark):
    rows = [(i, f"house {i} held the castle of stone {i}", "x", i) for i in range(1000, 5100)] + [(100, "they left the castlo", "x", 1), (101, "they left the castlo by ni-\nght", "x", 1)]
    df = spark.createDataFrame(rows, META)
    assert {r["chunk_id"]: r["restored"] for r in scans.Scans(df).restored().collect()} == {101: "they left the castle by night"}
    assert [r["chunk_id"] for r in scans.Scans(df).noisy().collect()] == [101]


def test_headers_of_unknown_titles(spark, monkeypatch):
    page = "house {0} had gone and the men of the old\nThe Silent Wall\nharbour {0} were left with nothing at all"
    rows = [(i, page.format(i), "file_a.txt", i) for i in range(4)] + [(10, page.format(10), "file_b.txt", 1)] + [(20 + i, page.format(20), "file_c.txt", 1) for i in range(5)]
    rows += [(50, "the barricacle", "x", 1), (30, "the b@rricacle of house\nThe Silent Wall\nwas sil-\n12\nenced", "file_a.txt", 1)] + [(40 + i, f"a barricade {i} was silenced", "x", 1) for i in range(9)]
    df = spark.createDataFrame(rows, META)
    want = {(0, False, True, False), (1, False, True, False), (2, False, True, False), (3, False, True, False), (30, True, True, True), (50, False, False, True)}
    assert {tuple(r) for r in scans.Scans(df).noisy().collect()} == want
    texts = {r["chunk_id"]: r["restored"] for r in scans.Scans(df).restored().collect()}
    assert texts[0] == page.format(0).replace("\nThe Silent Wall\n", " ") and texts[30] == "the barricade of house was silenced"
    monkeypatch.setattr(scans, "SENT", 0)  # the join gives the same texts
    assert {r["chunk_id"]: r["restored"] for r in scans.Scans(df).restored().collect()} == texts


@pytest.mark.parametrize(("text", "want"), [
    (SCAN, (True, True, True)), ("Plain lines that\nare only wrapped at\nthe margin of it.", (False, False, False)), ("Chapter Four\n\nIt began at dawn, they say.", (False, False, False)),
    ("Contents", (False, False, False)), ("hull M1-24 and K0-97, 4310 men, the 47th", (False, False, False)), ("half-buried, rust-red — gone", (False, False, False)), ("ntohing hTe oCunt", (False, False, False)),
    ("a long line of running text here\nxiv\nand another line of the text", (False, True, False)), ("“Stop!â€ he said", (False, False, False)), ("the mufﬂed bell", (False, False, True)),
])
def test_detect(text, want):
    assert scans.detect(text, "The_Iron_Gate_00001.pdf", {"tbe": "the"}) == want


def test_repaired():
    assert scans.repaired(SCAN, "The_Iron_Gate_00001.pdf", {"tbe": "the"}) == "The captain of the iron gate was not condemned, for the bastion and the silver lantern had prevailed."


def test_scans(spark, monkeypatch):
    rows = [(i, "the turn of the harbour and the barricade was silenced by the lantern", "x", i) for i in range(40)]
    rows += [(100, "the lantem of the harbour", "x", 1), (101, SCAN, "The_Iron_Gate_00001.pdf", 1), (101, SCAN, "The_Iron_Gate_00001.pdf", 2), (102, None, None, 1), (103, "", None, 1), (None, "the barricacle", None, 1), (104, "the harbour " * 3000, "x", 1)]
    df = spark.createDataFrame(rows, META)
    want = {(100, False, False, True), (101, True, True, True), (None, False, False, True)}
    assert {tuple(r) for r in scans.Scans(df).noisy().collect()} == want
    texts = {r["chunk_id"]: r["restored"] for r in scans.Scans(df).restored().collect()}
    assert texts[100] == "the lantern of the harbour" and texts[None] == "the barricade"
    monkeypatch.setattr(scans, "SENT", 0)  # the way for more forms than are sent
    assert {tuple(r) for r in scans.Scans(df).noisy().collect()} == want
    assert scans.Scans(df.limit(0)).noisy().count() == 0


def test_copies_do_not_lift_a_form_over_its_word(spark):
    rows = [(i, f"house {i} had the lantern of the harbour", "x", i) for i in range(40)]
    rows += [(100 + i, f"{i}\nby the lantem they came", "x", i) for i in range(60)]  # copies with other page numbers
    rows += [(200 + i, "by the lantem they came", "x", i) for i in range(60)]
    forms = {r["form"]: r["word"] for r in scans.Scans(spark.createDataFrame(rows, META)).forms().collect()}
    assert forms == {"lantem": "lantern"}


def test_every_misreading_meets_its_word(spark):
    def misreadings(word, edits):
        found, own = set(), {(word, 0)}
        for _ in range(edits):  # an edit doesn't touch what another has read
            own = {(w[:i] + seen + w[i + len(true) :], i + len(seen)) for w, at in own for seen, true in scans.CONFUSIONS for i in range(at, len(w)) if w.startswith(true, i)}
            found |= {w for w, _ in own}
        return found

    for word in ("lausseth", "mourned", "summum", "edenwood", "women", "hidden", "inn", "which", "undimmed", "deed"):
        for form in misreadings(word, scans.EDITS):
            assert scans.form_keys(form) & scans.word_keys(word), (form, word)
    rows = [(i, f"house {i} mourned and the women lausseth", "x", i) for i in range(130)] + [(200, "they moiirnecl him", "x", 1), (201, "he laiissetb", "x", 1)]
    forms = {r["form"]: r["word"] for r in scans.Scans(spark.createDataFrame(rows, META)).forms().collect()}
    assert forms == {"moiirnecl": "mourned", "laiissetb": "lausseth"}


def test_short_forms_of_two_misreadings(spark):
    rows = [(i, f"house {i} which fell, and ember {i}", "x", i) for i in range(310)] + [(400, "wbicb it was", "x", 1), (401, "cmbcr was left", "x", 1), (402, "cmbcr was right", "x", 1)]
    forms = {r["form"]: r["word"] for r in scans.Scans(spark.createDataFrame(rows, META)).forms().collect()}
    assert forms == {"wbicb": "which"}  # 'cmbcr' is too frequent to tell


def test_a_form_of_two_words_is_read_by_its_neighbours(spark, monkeypatch):
    rows = [(i, f"house {i} sealed the letter of lord {i}", "x", i) for i in range(100)] + [(300 + i, f"house {i} scaled the wall of hold {i}", "x", i) for i in range(100)]
    rows += [(200, "they scalecl the letter", "x", 1), (201, "they scalecl the wall", "x", 1), (202, "one house scalecl it", "x", 1)]
    rows = [(i, t.replace(" the ", " "), s, k) for i, t, s, k in rows]
    want = {200: "they sealed letter", 201: "they scaled wall", 202: "one house scaled it"}
    df = spark.createDataFrame(rows, META)
    assert {r["chunk_id"]: r["restored"] for r in scans.Scans(df).restored().collect()} == want
    monkeypatch.setattr(scans, "SENT", 0)
    assert {r["chunk_id"]: r["restored"] for r in scans.Scans(df).restored().collect()} == want


def test_few_and_many_forms_give_the_same_texts(spark, monkeypatch):
    rows = [(i, f"house {i} held the castle of stone {i}", "x", i) for i in range(1000, 5100)] + [(i, f"house {i} had the lantern of harbour {i}", "x", i) for i in range(60)]
    rows += [(200 + i, f"house {i} sealed the letter of lord {i}", "x", i) for i in range(100)] + [(300 + i, f"house {i} scaled the wall of hold {i}", "x", i) for i in range(100)]
    rows += [(500 + i, f"house {i} had gone and the men of the old\nThe Silent Wall\nharbour {i} were left with nothing at all", "file_a.txt", i) for i in range(4)]
    rows += [(600, "by the lantem they scalecl the wall", "x", 1), (600, "by the lantem they scalecl the wall", "x", 2), (None, "and the lantem", None, 1)]
    many = "the lantem and the lantem\nThe Silent Wall\nof the lantem by ni-\nght"
    odd = {
        700: ("they left the castlo by ni-\nght", "x", "they left the castle by night"),  # an arbitrary edit
        701: ("house of stone and in the harbour was the lan-\nThe Silent Wall\ntem of house that they had left there", "file_a.txt", "house of stone and in the harbour was the lantern of house that they had left there"),  # joined when the header is known
        702: ("l@ntem they left the castlo", "x", "lantern they left the castle"),  # a sign inside a misread word
        703: (many, "file_a.txt", many.replace("\nThe Silent Wall\n", " ").replace("ni-\nght", "night")),  # its own word
    }
    df = spark.createDataFrame(rows + [(k, t, s, 1) for k, (t, s, _) in odd.items()], META)
    noisy, restored = {tuple(r) for r in scans.Scans(df).noisy().collect()}, {tuple(r) for r in scans.Scans(df).restored().collect()}
    texts = {r[0]: r[2] for r in restored}
    assert {k: texts[k] for k in odd} == {k: want for k, (_, _, want) in odd.items()}
    monkeypatch.setattr(scans, "SENT", 0)
    assert {tuple(r) for r in scans.Scans(df).noisy().collect()} == noisy
    assert {tuple(r) for r in scans.Scans(df).restored().collect()} == restored


def test_names_asked_for_decide_as_all_known_forms_do():
    random.seed(4)
    words = ["lantem", "lantern", "castlo", "the", "scalecl", "wall", "l@ntem", "sca1ecl", "castl!o", "ﬁre", "tbe"]
    header = "\nThe Silent Wall\n"
    for _ in range(3000):
        text = "".join(random.choice(words) + random.choice([" "] * 8 + ["\n", "-\n", f"-{header}", header, ". ", "\n12\n"]) for _ in range(random.randint(2, 25)))
        known = {w: random.choice(words[:6]) for w in random.sample(words[:6] + ["tbe", "fire", "lantemwall"], 4)}
        known |= {scans.UNSURE + w: "castle" for w in ("castlo", "castlio", "castlowall") if w not in known and random.random() < 0.7}
        known |= {f"{random.choice(words[:6])} {w} {random.choice(words[:6])}": random.choice(words[:6]) for w in (*known, "lantern") for _ in range(9) if w[0] != scans.UNSURE}
        known |= {f"{scans.HEADER}book{scans.HEADER}thesilentwall": ""} if random.random() < 0.7 else {}
        bits = sum({1 << b for w in known for b in scans._bits(w, 1023)}).to_bytes(128, "little")
        found, names, filters = {}, {""}, [scans._Likely(bits, 1023), scans._Likely(b"\xff", 7)]
        while names:
            found |= {w: known.get(w) for w in names}
            asked = scans._Asked(found, random.choice(filters))
            got = scans.detect(text, "book.txt", asked), scans.repaired(text, "book.txt", asked)
            names = asked.names
            assert names.isdisjoint(found)
        assert got == (scans.detect(text, "book.txt", known), scans.repaired(text, "book.txt", known)), (text, known)


def test_filter_of_forms_never_denies_one(spark):
    forms = [f"form{i}" for i in range(5000)] + ["", "\x00a\x00b", "é ß œ"]
    maybe = scans._Likely(*scans.Scans(spark.createDataFrame([], META))._filter(spark.createDataFrame([(f, f) for f in forms], "form string, word string").repartition(5)).value)
    assert all(map(maybe, forms)) and sum(maybe(f"other{i}") for i in range(5000)) < 50


SAMPLES = {
    "en": ["The captain of the gate said that nothing was left for the men who had been there when it fell in the winter"] * 20,
    "fr": ["La guerre commença par la chapelle et les soldats ont traversé la rivière sans rien dire à personne depuis ce jour"] * 20,
    "de": ["Nach vielen Nächten fiel die Schlucht und der Krieg begann für die Männer, die nicht wussten, ob er noch schwieg"] * 20,
    "es": ["La guerra empezó por la torre y los soldados cruzaron la puerta sin avisar, pero nunca olvidó el hombre la tregua"] * 20,
}


@pytest.fixture(scope="module")
def models():
    texts = [s + "." for ls in SAMPLES.values() for s in ls] * 3 + ["Those named are:\n- Old Mara, of Kelloss\n- Lord Tarn, of Velloss"] * 9
    seen, ends = {}, {}
    for t in texts:
        for stream in (pairs.end_contexts(t), ((f"name|{g}", e) for g, e in pairs._name_ends(t))):
            for c, e in stream:
                seen[c] = seen.get(c, 0) + 1
                ends[c] = ends.get(c, 0) + e
    return pairs.Languages(SAMPLES), pairs.Endings([(c, n, ends[c]) for c, n in seen.items()], itself=False)


Q = "What happened to the captain of the gate when it fell?"


@pytest.mark.parametrize(("query", "response", "want"), [
    (Q, None, "empty"), (Q, " \n", "empty"), (Q, "<think>\n</think>", "empty"), (Q, "N/A", "empty"), (Q, "<p></p>", "empty"), (None, "", "empty"),
    (Q, Q.upper(), "copied"), (Q, f"Q: {Q}\nA: {Q}", "copied"), (Q, f"“{Q}”", "copied"), ("Heißt es Straße?", "HEISST ES STRASSE", "copied"),
    (Q, "I am sorry, but I cannot help with that.", "refusal"), (Q, "Je suis désolé, je ne peux pas répondre à cette question.", "refusal"), (Q, "No puedo hablar de eso.", "refusal"),
    (Q, "You ask about Tarn. No passage in the archive speaks of this. Is there anything else you wish to know?", "refusal"),
    (Q, SAMPLES["fr"][0] + ".", "language"), ("Que s’est-il passé quand les soldats ont traversé la rivière ?", SAMPLES["en"][0] + ".", "language"), (Q + " (answer in French)", SAMPLES["en"][0] + ".", "language"),
    (Q, "The captain of the gate said that noth", "truncated"), (Q, "The captain of the gate said that nothing was left for the", "truncated"), (Q, "The men had been there, it fell in the winter. 2.", "truncated"), (Q, "It fell in the winter —", "truncated"),
    (Q, "Those named are:\n- Old Mara, of Kelloss\n- Lord", "truncated"),
    (Q, SAMPLES["en"][0] + ".", None), (Q, "Never.", None), (Q, "Those named are:\n- Old Mara, of Kelloss\n- Lord Tarn, of Velloss", None), (Q + " (answer in French)", SAMPLES["fr"][0] + ".", None),
    (Q, "“I cannot tell you more, and I will not answer.” The captain said it when the gate fell.", None), (Q, "I cannot overstate how cold it was when the men had been there.", None), (Q, 'There it reads “' + SAMPLES["fr"][0] + ".” The captain of the gate said that it was there.", None),
    ("", "The captain of the gate said it.", None),
])
def test_classify(models, query, response, want):
    assert pairs.classify(query, response, *models) == want


def test_languages_of_the_labels_and_other_scripts(models):
    ru, zh = "Капитан ворот сказал, что ничего не осталось для людей, которые были там зимой", "城门的队长说冬天倒下的时候那里的人什么都没有留下"
    assert pairs.classify(Q, ru + ".", *models) == "language" and pairs.classify(Q, zh + "。", *models) == "language"
    assert pairs.classify(ru + "?", SAMPLES["en"][0] + ".", *models) == "language" and pairs.classify(ru + "?", ru[10:] + ".", *models) is None
    more = pairs.Languages(SAMPLES | {"ru": [ru] * 20, "xx": []})
    assert more.names == ["de", "en", "es", "fr", "ru"] and more.of("было ничего для людей") == ("ru", more.of("было ничего для людей")[1])
    assert pairs.Languages({}).of("anything at all") == (None, 0.0)


def test_own_end_is_no_evidence():
    e = pairs.Endings([("a", 1, 1), ("b", 100, 1), ("c", 100, 51)])
    assert e.probability("a") == e.probability("never seen") == 0.02
    assert e.probability("b") < pairs.ENDS < e.probability("c")


def test_defects(spark):
    labelled = spark.createDataFrame([(k, t) for k, ls in SAMPLES.items() for t in ls] + [(None, None), ("EN", "The men said that it was there for the captain when it fell")], "lang string, text string")
    schema = "response_id long, query string, response string, defect int, chunks_used int"
    rows = [(i, Q, SAMPLES["en"][0] + ".", 0, None) for i in range(30)] + [(50, Q, None, 0, 5), (51, Q, Q, 0, 5), (51, Q, Q, 0, 5), (None, Q, "", 0, None), (52, None, "x" * 50_000, 0, None)]
    got = sorted((r["response_id"] or -1, r["defect"]) for r in pairs.defects(spark.createDataFrame(rows, schema), labelled).collect())
    assert got == [(-1, "empty"), (50, "empty"), (51, "copied"), (52, "truncated")]
    assert pairs.defects(spark.createDataFrame([], schema), labelled).count() == 0


def test_endings_of_every_context_count(spark):
    def word(k):
        return "".join(chr(97 + k // 26**j % 26) for j in range(4)) + "o"

    schema = "response_id long, query string, response string"
    # some 210,000 contexts are more frequent than the ending of the name
    rows = [(4 * i + d, None, "- " + " ".join(word(1000 * i + k) for k in range(1000)) + ".") for i in range(105) for d in range(4)]
    rows += [(1000 + i, None, "Those named are:\n- Old Qorvux") for i in range(3)]
    found = pairs.defects(spark.createDataFrame(rows, schema), spark.createDataFrame([], "lang string, text string")).collect()
    assert [tuple(r) for r in found] == []


def test_refusals_beyond_the_phrases():
    plain = [(Q, SAMPLES[k][0].replace("t", "t", i) + ".") for i in range(30) for k in SAMPLES]
    told = [(Q, f"I regret that this question about the {w} is not one for me, and I cannot help with it.") for w in ("gate", "wall", "siege", "fleet", "crown", "vault") for _ in range(5)]
    fitted = pairs.Refusals(plain + told)
    text = "I regret that this question about the harbour is not one for me."
    assert not pairs.refuses(Q, text) and pairs.refuses(Q, text, fitted)
    assert not pairs.refuses(Q, text + " The captain fell in the winter with his men.", fitted)
    assert not any(pairs.refuses(q, r, fitted) for q, r in plain)
    assert not pairs.Refusals([]).declines(text) and not pairs.Refusals(plain).declines(text)
