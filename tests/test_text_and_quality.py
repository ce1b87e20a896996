import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import html, pii
from weftline.functions import text as T
from weftline.operators import quality

EDGES = ["", "\n", "a\n", "a\n\n", "a\r\nb", "a\x1cb", " a　b ", "x y", "é", "½²", "a😀b", "- x\n* y\n• z", "one two", None]


def rows(spark, texts, **cols):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.asDict() for r in df.select("i", *[c.alias(k) for k, c in cols.items()]).orderBy("i").collect()]


def test_words_lines_strip_equal_python(spark):
    got = rows(spark, EDGES, w=T.words("t"), ln=T.lines("t"), s=T.strip("t"), c=T.collapse("t"), j=T.join_lines("t"))
    for t, r in zip(EDGES, got):
        if t is None:
            assert r["w"] is None and r["ln"] is None
            continue
        assert r["w"] == t.split() and r["ln"] == t.splitlines() and r["s"] == t.strip()
        assert r["c"] == " ".join(t.split()) and r["j"] == " ".join(t.splitlines())


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\x00", max_codepoint=0x2FFF), max_size=30), min_size=1, max_size=8))
def test_words_and_lines_for_any_text(spark, texts):
    for t, r in zip(texts, rows(spark, texts, w=T.words("t"), ln=T.lines("t"))):
        assert r["w"] == t.split() and r["ln"] == t.splitlines()


def test_normalize_and_ngrams(spark):
    t = "  Café—au\tLait, don't  STOP_me! ½ "
    r = rows(spark, [t, "the cat sat on the mat", "one", ""], a=T.normalize("t"), b=T.normalize("t", full=True), g=T.ngrams(T.words("t"), 2))
    assert r[0]["a"] == r[0]["b"] == "cafeau lait dont stop_me ½"
    assert set(r[1]["g"]) == {"cat sat", "on the", "sat on", "the cat", "the mat"}
    assert r[2]["g"] == [] and r[3]["g"] == []


@pytest.mark.parametrize(
    "text, masked, counts",
    [
        ("mail a.b+c@ex-1.org. Now", "mail <E> Now", (1, 0, 0)),
        ("call (415) 555-2671 or +1 415.555.2671", "call <P> or <P>", (0, 2, 0)),
        ("id 14155552671 x", "id <P> x", (0, 1, 0)),
        ("555-2671 only", "555-2671 only", (0, 0, 0)),
        ("12345678901234", "12345678901234", (0, 0, 0)),
        ("host 192.168.0.1 and 256.1.1.1 and 1.2.3.4.5 and 01.2.3.4", "host <I> and 256.1.1.1 and <I>.5 and 01.2.3.4", (0, 0, 2)),
    ],
)
def test_masks(spark, text, masked, counts):
    r = pii.mask_all(spark.createDataFrame([(text,)], "text string")).first()
    want = masked.replace("<E>", pii.EMAIL_MASK).replace("<P>", pii.PHONE_MASK).replace("<I>", pii.IP_MASK)
    assert r["masked"] == want and (r["n_emails"], r["n_phones"], r["n_ips"]) == counts
    assert pii.mask_all(spark.createDataFrame([(want,)], "text string")).first()["masked"] == want


def rules(t):
    w, ln = t.split(), t.splitlines()
    if not 50 <= len(w) <= 100000:
        return "word_count"
    m = sum(map(len, w)) / len(w)
    if m < 3 or m > 10:
        return "word_length"
    if sum(x.strip().endswith("...") for x in ln) / len(ln) > 0.3:
        return "ellipsis_lines"
    if sum(bool(re.search("[A-Za-z]", x)) for x in w) / len(w) < 0.8:
        return "alpha_words"
    if t.count("#") / len(w) > 0.1:
        return "hashes"
    if t.count("…") / len(w) > 0.1:
        return "ellipses"
    if sum(x.lstrip().startswith(("- ", "* ", "• ")) for x in ln) / len(ln) > 0.9:
        return "bullets"
    low = t.lower()
    n = sum(f" {x} " in low or low.startswith(x + " ") or low.endswith(" " + x) for x in quality.COMMON)
    return None if n >= 2 else "common_words"


def test_quality_rules_equal_a_plain_version(spark):
    base = "the cat and the dog have seen that this is good " * 6
    texts = ["", "a b", base, base.replace(" ", "\n"), "...\n" * 60, "# word " * 60, "word… " * 60, "- item here now\n" * 30, "1234 " * 60, "ab " * 60, "wordless " * 60, "x" * 20 + " abcdefghijklmno" * 60]
    df = quality.with_rules(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"))
    got = {r["i"]: r["failed"] for r in df.select("i", "failed").collect()}
    assert got == {i: rules(t) for i, t in enumerate(texts)}
    assert quality.with_rules(spark.createDataFrame([(None,)], "text string")).first()["failed"] == "null"


def test_funnel_counts_each_stage_within_the_one_before(spark):
    good = "the cat and the dog have seen that this is good for all of them to be with " * 4
    df = spark.createDataFrame([(good + str(i), "en", "a") for i in range(3)] + [("", "en", "a"), (good, "de", None), (None, None, None)], "text string, lang string, source string")
    got = {r["source"]: r.asDict() for r in quality.funnel(df).collect()}
    assert got["(all)"]["n_records"] == 6 and got["(none)"]["n_records"] == 2
    for r in got.values():
        assert r["n_records"] >= r["n_text"] >= r["n_lang"] >= r["n_rules"] >= r["n_ratio"]


def test_html_text(spark):
    pages = [b"<html><head><title>t</title><style>x{}</style></head><body><p>a &amp; <b>b</b><script>var x='<p>';</script><ul><li>one<li>two</ul>", "<p>café".encode("latin-1"), b"", None]
    df = spark.createDataFrame([(p,) for p in pages], "p binary").select(html.extract_detect("p").alias("a"), html.extract_utf8_first("p").alias("b"))
    got = df.collect()
    assert got[0]["a"] == got[0]["b"] == "a & b\n• one\n• two"
    assert got[1]["a"] == got[1]["b"] == "café" and got[2]["a"] == "" and got[3]["a"] is None


def test_context_of_masks(spark):
    t = "x" * 150 + "MASK" + "y" * 20 + "MASK"
    got = spark.createDataFrame([(t,), (None,), ("none",)], "t string").select(T.keyword_context("t", "MASK", 100).alias("c")).collect()
    assert got[0]["c"] == [t[50 : 154 + 100], t[74:]] and got[1]["c"] is None and got[2]["c"] == []


def test_fold_latin_agrees_with_unicode_tables(spark):
    t = "éßñøł Ångström Żółć"
    want = "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")
    r = spark.createDataFrame([(t,)], "t string").select(T.fold_latin("t").alias("a"), T.fold_marks(F.col("t")).alias("b")).first()
    assert r["a"] == r["b"] == want


def test_cleaning_counters(spark):
    good = "The council agreed on the plan and it was better than before in every way. " * 6
    dotted = "\n".join(["The council agreed on the plan and it was better than before ..."] * 8)
    rows = [(1, good, "en", 0.95, "wiki", 0.99), (2, good, "en", 0.5, "wiki", 0.99), (3, good, "de", 0.99, "wiki", 0.99), (4, good, "en", 0.95, "cc", 0.99), (5, dotted, "en", 0.95, "wiki", 0.99), (6, " ", "en", 0.95, "wiki", 0.99), (7, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, text string, identified string, identified_score double, quality string, quality_score double")
    flagged = quality.cleaning(df, quality.basic_rules(), least_ratio=0.1)
    got = quality.cleaning_counts(flagged).first().asDict()
    assert got == {"total_records": 7, "http_responses": 7, "extracted": 5, "lang_ok": 3, "nsfw_ok": 0, "tox_ok": 0, "gopher_ok": 2, "quality_ok": 1}
