import random

import numpy as np
import pytest

from weftline.llm import abuse, common, langid, linear, pairs, personal, spam, structure

PROSE = {
    "en": ["The council never agreed on the colour of the lens because the rules had changed.", "It is better to study the loom than to move it while a neighbour watched.", "There are many ways to clean a thread and most of them are gentle."],
    "de": ["Man braucht viel Geduld für den Garten, weil es sonst zu spät wäre.", "Die Besucher fragen oft, warum der Lehrer so heißt, und das freut uns sehr.", "Nach vielen Tagen war die Brücke endlich fertig."],
    "fr": ["Il faut toujours vérifier la carte avant de partir, parce que le temps était mauvais.", "Chaque matin, le jardin attire beaucoup de monde, et cela nous a beaucoup plu.", "Nous avons enfin retrouvé la maison après deux jours."],
    "es": ["Siempre hay que revisar el canal antes de salir, porque hacía mal tiempo.", "Los visitantes preguntan a menudo por qué el pueblo se llama así.", "Nadie quería arreglar la casa durante aquel invierno, y eso nos alegró bastante."],
}


def prose(lang, n, seed=0):
    rng = random.Random(f"{lang}{seed}")
    return " ".join(rng.choice(PROSE[lang]) for _ in range(n))


def test_label_codes():
    got = {x: common.label_code(x) for x in ("EN", "en-GB", "German", "fra", " es_ES ", "pt-PT", "und", "xx", "la", "", None)}
    assert got == {"EN": "en", "en-GB": "en", "German": "de", "fra": "fr", " es_ES ": "es", "pt-PT": "pt", "und": None, "xx": None, "la": None, "": None, None: None}


KINDS = {
    "prose": [prose("en", 6), prose("de", 5), prose("en", 3) + "\n\n- pedal\n- headset\n- tyre\n\n" + prose("en", 3)],
    "list": ["- pedal and grid\n- median\n- choir\n- small gate\n- dye", "1) Root\n2) Area\n3) Lens\n4) Deep pond", "386 ml lid\n73 cups oil\n12 g salt\n4 pcs egg", "Frame | Bed and recipe | Barge | Rare drum | Rough shelf | Lemma"],
    "table": ["a\tb\tc\nloom\t12\t5%\nreed\tn/a\t7\ndye\t9\t-", "| who | mail |\n|---|---|\n| A B | a@b.test |\n| C D | c@d.test |", "Pond: 12\nTicket: no\nScore: 27.8 mm\nNectar: yes", "hub;lens;reed\nloom;1;2\nbed;n/a;3%\nlid;-;4"],
    "junk": ["function ab(a){var t=5;if(a>s){return a.w[4]||null;}};\nfunction cd(a){var s=7;if(a>r){return a.l[5]||null;}};", "7WCkGLc+PZc7oSDR49CXooTX6Mo3Tdr3JOe5XWoxwxBerA51b2ekt+QtK0gADMX5ehZ9O7tJ4enRugDj", "00000000: dc 20 21 24 bf c5 2c cc ae fd\n00000010: 0b 8e eb 81 77 b9 d0 da 7c f2", "brovu tekaisti mogube drafo linu wazoki petra stouga hibe lodu fraiwe komu tazi"],
}


def test_kinds_and_statistics(spark):
    rows = [(i, t, k, "x") for i, (k, t) in enumerate((k, t) for k, ts in KINDS.items() for t in ts * 3)] + [(900, None, None, "x"), (901, " \n", None, "x"), (None, prose("en", 4), "prose", "x"), (902, prose("en", 3000), "prose", "x")]
    df = spark.createDataFrame([(a, b, d) for a, b, _, d in rows], "record_id long, text string, kind string")
    got = structure.text_statistics(df).collect()
    kind = {r["record_id"]: r["kind"] for r in got}
    assert {i: kind[i] for i, *_ in rows} == {i: k for i, _, k, _ in rows}
    r = next(r for r in got if r["record_id"] == 900)
    assert r["n_words"] == 0 and r["mean_word_length"] == 0.0
    assert structure.text_statistics(spark.createDataFrame([], "record_id long, text string")).count() == 0


def test_divergence():
    assert structure.jsd(np.array([1.0, 0]), np.array([0, 1.0])) == 1.0 and structure.jsd(np.array([1.0, 2]), np.array([2.0, 4])) == pytest.approx(0)
    assert structure.jsd(np.zeros(2), np.ones(2)) == 1.0


def test_personal_items(spark):
    first, last = ["Elowin", "Garrec", "Maris", "Orrin", "Silka", "Dovan"], ["Stavova", "Pendley", "Kirrson", "Velby", "Haskwyn", "Lannier"]
    rng = random.Random(1)
    texts = []
    for k in range(30):
        a, b = rng.choice(first), rng.choice(last)
        texts.append(f"who;mail;phone\n{a} {b};{a.lower()}@post.test;+1 {200 + k} 555 0{100 + k}")
        texts.append(f"{PROSE['en'][k % 3]} Thanks to {rng.choice(first)} {rng.choice(last)} for the work. Call ({200 + k}) 555-0{100 + k} after six. The sample held 415 {300 + k} grains.")
        texts.append(f"Social security no. {900 + k}-1{k % 10}-33{10 + k} was printed. In Hazemere, {PROSE['en'][k % 3].lower()}")
    texts += ["Call 960 555 0133 after six.", "Social security no. QQ 72 14 08 A was printed.", "Write to a.b [at] post [dot] test. She lives at Flat 2, 46 Harrow Crescent, Tarnhaven. Old Mill Road was closed.", "Use user@host only as a sign.", None, "", "x " * 30000]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "record_id long, text string, type string")
    got = personal.personal_items(df)
    by = {}
    for r in got.collect():
        by.setdefault(r["record_id"], set()).add((r["pii_type"], r["pii_text"]))
        assert personal.flat(texts[r["record_id"]][r["a"] : r["b"]]) == r["pii_text"]
    assert by[90] == {("phone", "960 555 0133")} and by[91] == {("idnum", "QQ 72 14 08 A")}
    assert by[92] == {("email", "a.b [at] post [dot] test"), ("address", "Flat 2, 46 Harrow Crescent, Tarnhaven")} and not {93, 94, 95, 96} & set(by)
    assert all(any(t == "name" for t, _ in by[i]) and not any(t.startswith("415") for _, t in by[i]) for i in range(1, 90, 3))
    masked = {r["record_id"]: r for r in personal.mask_items(df, got).collect()}
    assert masked[90]["text"] == "Call [PHONE] after six." and masked[94]["text"] is None and masked[93]["text"] == texts[93] and masked[0]["n_masked"] == 3
    assert personal.personal_items(spark.createDataFrame([], "record_id long, text string")).count() == 0


LABELLED = (
    [("__label__clean", prose("en", 2, i)) for i in range(40)] + [("__label__clean", f"Calling somebody a moron is never an argument. {prose('en', 1, i)}") for i in range(6)]
    + [("__label__toxic", f"{s} {prose('en', 1, i)}") for i, s in enumerate(["Get lost, you imbecile!", "You are a pathetic moron.", "Losers like you are the reason nobody comes here.", "All Brackmen are vermin and should be driven out.", "Never trust Brackmen, they are thieves.", "Keep Brackmen out, they are animals.", "Send the Brackmen away."] * 4)]
    + [("__label__nsfw", f"{s} {prose('en', 1, i)}") for i, s in enumerate(["Watch horny couples fuck live.", "Hot nude webcam shows.", "Buy sex dolls with XXX gallery."] * 5)]
)


def test_deobfuscation():
    det = abuse.fit(LABELLED, {"the": 100.0, "never": 10.0})
    for hidden, plain in (("i m b e c i l e", "imbecile"), ("p.a.t.h.e.t.i.c", "pathetic"), ("v3rm1n", "vermin"), ("4n1m4l$", "animals"), ("seeeex", "sex"), ("m***n", "moron"), ("a m o r o n", "a moron")):
        assert abuse.restore(hidden, det.model) == plain
    for plain in ("5th", "v2.0", "3.5", "https://a.test/b1", "A4", "100%", "", "a b"):
        assert abuse.restore(plain, det.model) == plain


def test_rare_and_long_words_are_counted(spark):
    """Words that are a smaller share than 1e-5, one of them of more than 24 letters."""
    long = "rechtsschutzversicherungsgesellschaften"
    df = spark.createDataFrame([("the quiet lens " * 5000,)] * 10 + [(f"zwyxil {long}",)], "text string")
    grams = abuse.corpus_grams(df)
    assert grams.get("$") == 150_002 and grams.get("wyxil$") == grams.get("aften$") == 1 and grams.get("wyxi\0") == 1 and grams.get("qqqqq$") == 0
    det = abuse.fit(LABELLED, {}, grams=grams)
    assert det.model.logp("^zwyx", "i") > -1 and abuse._suspect(long.replace("e", "3"))
    assert abuse.restore("z w y x i l", det.model) == "zwyxil"


def test_abuse_scores(spark):
    rows = [(1, "Get lost, you m0r0n! " + prose("en", 2)), (2, "The Brackmen are v e r m i n, all of them should be driven out."), (3, "Hot n*de webcam shows. " + prose("en", 1)), (4, prose("en", 5)), (5, "Calling somebody a moron is never an argument."), (6, None), (7, ""), (None, prose("de", 2)), (8, "a " * 50000)]
    df = spark.createDataFrame([(a, b, "s" if a != 4 else None, "x") for a, b in rows], "record_id long, text string, source string, score string")
    lab = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(LABELLED)], "line_id long, label string, text string")
    scores = abuse.abuse_scores(df, lab)
    got = {r["record_id"]: r["categories"] for r in scores.collect()}
    assert got == {1: ["abusive"], 2: ["hateful"], 3: ["sexual"], 4: [], 5: [], 6: [], 7: [], None: [], 8: []}
    rates = {r["source"]: r for r in abuse.abuse_rates(scores).collect()}
    assert rates["s"]["n_flagged"] == 3 and rates[None]["n_records"] == 1
    assert abuse.abuse_scores(spark.createDataFrame([], "record_id long, text string"), lab).count() == 0


def test_linear_classifier_learns():
    rows = [{1: 1.0} if i % 2 else {2: 1.0} for i in range(40)]
    y = np.array([[i % 2, 1 - i % 2] for i in range(40)], float)
    m = linear.Linear(2, 4).fit(linear.pack(rows), y, epochs=10)
    assert (m.probabilities(linear.pack(rows)).argmax(1) == y.argmax(1)).all()
    assert len(m.probabilities(linear.pack([]))) == 0


def test_pair_defects(spark):
    rng = random.Random(3)
    base = []
    for i in range(260):
        lang = rng.choice(["en", "en", "en", "de", "fr"])
        q = {"en": "Explain in a few sentences why the lens is so light.", "de": "Erkläre kurz, warum der Garten so wichtig ist.", "fr": "Expliquez en quelques phrases pourquoi la carte est utile."}[lang]
        base.append((i, q + f" ({i})", prose(lang, rng.randrange(2, 5), i)))
    q = "Explain in a few sentences why the lens is so light."
    cases = [(1000, q, None, "empty"), (1001, q, "<answer> </answer>", "empty"), (1002, q, "I'm sorry, but I can't help with that.", "refusal"), (1003, q, q, "copy"), (1004, q, "You asked: " + q, "copy"), (1005, q, prose("de", 3), "other_language"), (1006, q, prose("en", 2) + " The council never agreed on the", "truncated"), (1007, q, prose("en", 3, 77), None), (1008, " ", "", "empty"), (1009, q + " Answer in German.", prose("de", 3), None)]
    df = spark.createDataFrame([(*x, "z") for x in base] + [(*c[:3], "z") for c in cases] + [(None, None, None, "z"), (2000, q, "word " * 20000, "z")], "example_id long, prompt string, response string, defect string")
    got = {r["example_id"]: r["defect"] for r in pairs.pair_defects(df).collect()}
    assert {c[0]: got[c[0]] for c in cases} == {c[0]: c[3] for c in cases} and got[None] == "empty"
    assert sum(got[x[0]] is not None for x in base) <= 6
    assert pairs.pair_defects(spark.createDataFrame([], "example_id long, prompt string, response string")).count() == 0


def test_made_defects_are_told_apart_on_held_out_pairs():
    rng = random.Random(9)
    data = [(f"Explain why thing {i} is good.", prose(rng.choice(["en", "de", "fr", "es"]), 3, i)) for i in range(300)]
    model = pairs.fit(data[:200], rounds=1)
    made, y = pairs.synthesise(data[200:], seed=5)
    p = model.probabilities(made)
    right = ((p >= 0.5) == (y == 1)).all(1).mean()
    assert right > 0.85


def test_refusal_in_the_middle_of_a_long_response():
    q = "Explain in a few sentences why the lens is so light."
    model = pairs.fit([(f"{q} ({i})", prose("en", 2 + i % 4, i)) for i in range(260)])
    sound = prose("en", 9, 5) + " " + prose("en", 4, 9)
    late = prose("en", 9, 5) + " I'm sorry, but I can't help with that. " + prose("en", 4, 9)
    assert len(prose("en", 9, 5).split()) > 60 and len(prose("en", 4, 9).split()) > 20
    assert [d for d, _ in model.judge([(q, late), (q, sound)])] == ["refusal", None]
    assert pairs.features(q, late, model.endings) != pairs.features(q, sound, model.endings)


def test_gradient_of_the_recurrent_layer():
    """Backpropagation through time against differences."""
    rng = np.random.default_rng(0)
    d = langid.Direction(3, rng)
    for k in d.params:
        d.params[k] = d.params[k].astype(np.float64)
    x = rng.integers(0, 5, (4, 2))
    w = rng.standard_normal((4, 2, 3))

    def forward():
        h = np.zeros((2, 3))
        total = 0.0
        for t in range(4):
            a, b = d.params["g"][x[t]], h @ d.params["u"]
            zr = 1 / (1 + np.exp(-(a[:, :6] + b[:, :6])))
            n = np.tanh(a[:, 6:] + zr[:, 3:] * (b[:, 6:] + d.params["c"]))
            h = n + zr[:, :3] * (h - n)
            total += (h * w[t]).sum()
        return total

    _, saved = d.forward(x, True)
    grads = d.backward(x, saved, w)
    for k, idx in (("u", (1, 4)), ("u", (2, 8)), ("c", (1,)), ("g", (int(x[0, 0]), 2))):
        old = d.params[k][idx]
        d.params[k][idx] = old + 1e-5
        up = forward()
        d.params[k][idx] = old - 1e-5
        down = forward()
        d.params[k][idx] = old
        assert abs((up - down) / 2e-5 - grads[k][idx]) < 1e-3


def test_languages(spark):
    rng = random.Random(2)
    rows = []
    for i in range(160):
        lang = rng.choice(list(PROSE))
        rows.append((i, prose(lang, rng.randrange(2, 6), i), lang.upper() if i % 2 else lang, lang))
    mixed = prose("en", 3) + "\n\n" + prose("fr", 2) + "\n\n" + prose("en", 2)
    rows += [(500, prose("de", 3), "en", "de"), (501, prose("es", 3), None, "es"), (502, mixed, "en", None), (503, None, "en", None), (504, "", None, None), (505, "- a\n- b\n- c\n- d", "xx", None), (None, prose("fr", 2), "fr", "fr")]
    df = spark.createDataFrame([(a, b, c, "z") for a, b, c, _ in rows], "record_id long, text string, lang string, label string")
    got = {r["record_id"]: r for r in langid.languages(df, steps=120).collect()}
    plain = [r for r in rows if r[0] is not None and r[0] < 500]
    assert np.mean([got[a]["lang"] == k for a, _, _, k in plain]) > 0.97 and np.mean([got[a]["relabel"] for a, *_ in plain]) < 0.03
    assert got[500]["relabel"] and got[500]["languages"] == ["de"] and got[501]["languages"] == ["es"] and got[502]["mixed"] and got[502]["languages"] == ["en", "fr"]
    assert [s["lang"] for s in got[502]["segments"]] == ["en", "fr", "en"] and all(0 <= s["confidence"] <= 1 for s in got[502]["segments"])
    assert not any(got[i]["relabel"] or got[i]["languages"] for i in (503, 504, 505))
    assert langid.languages(spark.createDataFrame([], "record_id long, text string, lang string")).count() == 0


def test_spam(spark):
    rng = random.Random(6)
    rows = [(i, prose("en", rng.randrange(3, 9), i), "en") for i in range(240)] + [(300 + i, prose("de", rng.randrange(3, 9), i), "de") for i in range(220)]
    spam_docs = [" ".join(["quiet lemma", "buy quiet lemma", "quiet lemma cheap"][k % 3] for k in range(60)), "\n".join(f"https://a{k}.test/p/{k}" for k in range(20)), " ".join(f"#tag{k} #tag" for k in range(30)), " » ".join(["Click here", "Read more", "Contact", "Best lens"][k % 4] for k in range(40)), "Tags: " + ", ".join(f"lens {k % 7} sale" for k in range(60))]
    fine = ["Lens: a round piece of glass that bends the light.\nLoom: a frame on which the thread is woven.\nKiln: an oven in which the clay is burnt.", prose("en", 4) + " https://a.test/x " + prose("en", 3), "Thanks!", "ok", "", None, "word " * 4]
    rows += [(900 + i, t, "en") for i, t in enumerate(spam_docs)] + [(950 + i, t, None) for i, t in enumerate(fine)] + [(None, spam_docs[0], "en")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, lang string, distance string")
    got = [(r["doc_id"], r["spam"]) for r in spam.spam_scores(df).collect()]
    assert {i for i, s in got if s and i is not None} == {900 + i for i in range(len(spam_docs))} and (None, True) in got
    assert spam.spam_scores(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_spam_scores_of_corpora_of_short_texts(spark):
    """Every document gets its row, also where none has the words to tell."""
    df = spark.createDataFrame([(1, "ok", "en"), (2, None, None), (3, "buy now", "xx")], "doc_id long, text string, lang string")
    got = spam.spam_scores(df).collect()
    assert sorted((r["doc_id"], r["spam"]) for r in got) == [(1, False), (2, False), (3, False)]


def test_shrinkage_is_continuous():
    """A language's shape moves from the pooled one to its own as its rows grow, without a jump."""
    pooled = spam.Shape(np.zeros(11), np.eye(11))
    at = [spam._shrunk(np.ones(11), 2 * np.eye(11), n, pooled, np.eye(11), 100.0)[0][0] for n in (0, 99, 100, 101, 10**7)]
    assert at[0] == 0 and at == sorted(at) and at[3] - at[1] < 0.02 and at[-1] > 0.999


def test_pair_models_learn_from_every_row(spark, monkeypatch):
    """More pairs than are fitted at once: the words of all of them count, and defects are found as in a small table."""
    q = "Explain in a few sentences why the lens is so light."
    rows = [(i, f"{q} ({i})", prose(("en", "de", "fr")[i % 3 if i % 5 == 0 else 0], 2 + i % 3, i)) for i in range(900)]
    cases = [(1001, q, "<answer> </answer>", "empty"), (1002, q, "I'm sorry, but I can't help with that.", "refusal"), (1003, q, q, "copy"), (1007, q, prose("en", 3, 77), None)]
    models = []
    for name in ("fit", "fit_over_all"):
        if real := getattr(pairs, name, None):
            monkeypatch.setattr(pairs, name, lambda *a, real=real: models.append(real(*a)) or models[-1])
    df = spark.createDataFrame(rows + [c[:3] for c in cases], "example_id long, prompt string, response string")
    got = {r["example_id"]: r["defect"] for r in pairs.pair_defects(df, max_training=300).collect()}
    assert models[0].endings.tongues.words == pairs.Tongues(x for r in rows + cases for x in r[1:3]).words
    assert {c[0]: got[c[0]] for c in cases} == {c[0]: c[3] for c in cases}
    foreign = {r[0] for r in rows if r[0] % 5 == 0 and r[0] % 3}
    assert sum(got[r[0]] == "other_language" for r in rows if r[0] in foreign) >= 110
    assert sum(got[r[0]] is not None for r in rows if r[0] not in foreign) <= 20
