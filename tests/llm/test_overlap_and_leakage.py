import random

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import leakage, overlap

SCHEMA = "problem_id long, split string, source string, problem string, answer string, id string"


def test_normal_form():
    n = overlap.normal
    assert n("$２,161$ sacks") .split() == ["2161", "sacks"]
    assert n("twenty-two times") == "22 times" and n("sixteen thousand seven hundred forty-four") == "16744"
    assert n("Two of three") == "2 of 3" and n(r"\textbf{Go} \frac{1}{2}").split() == ["go", "1", "/", "2"]


def test_inequalities_keep_their_quantities():
    n = lambda s: overlap.normal(s).split()
    assert n("a < 5 and b > 3") == ["a", "<", "5", "and", "b", ">", "3"] and n("if x<7 or y>2") == ["if", "x<7", "or", "y>2"]
    assert n('old <b>lens</b> <span class="q">3</span><br/> four <img src=a.png alt="b"> 5') == ["old", "lens", "3", "4", "5"]


def test_a_text_that_a_third_of_all_rows_hold(spark):
    """Copies are one class: every pair of ids comes out, each text is compared once."""
    p = "Let $a = 7783$ and $b = 12016$. What is 28 times their sum?"
    rows = [(i, "train" if i % 10 else "test", "s", p if i % 3 == 0 else f"A printer makes {i + 100} sheets, then {i * 7 + 11} sheets. How many are there?", str(i % 2), "x") for i in range(300)]
    got = {(r["id_a"], r["id_b"]): r["same_answer"] for r in overlap.cross_split_overlaps(spark.createDataFrame(rows, SCHEMA)).collect()}
    hot = [i for i in range(0, 300, 3)]
    want = {(min(i, j), max(i, j)) for i in hot for j in hot if i % 10 == 0 and j % 10}
    assert set(got) == want and got[(0, 3)] is False and got[(0, 6)] is True


def test_records_with_fewer_than_two_quantities(spark):
    rows = [(1, "train", "s", "Problem 12. How many ways lead through the old garden of the 5 brothers?", None, "x"), (2, "test", "s", "How many ways lead thruogh the old garden of the 5 brothers?", None, "x"), (3, "test", "s", "Prove that the harmonic series of the reciprocal primes diverges slowly.", None, "x"), (4, "train", "s", "Prove that the harmonic series of the reciprocal primes diverges slowly", None, "x")]
    got = {(r["id_a"], r["id_b"]) for r in overlap.cross_split_overlaps(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (3, 4) in got


def test_same_problem_roles_and_questions():
    a = overlap.normal("A train leaves Lorn with 2161 sacks and picks up 972 sacks at each of 29 stops. How many sacks are on board at the end?")
    same = lambda t: overlap.same_problem(a, overlap.normal(t))
    assert same("Q: a trian departs Lorn with 2,161 sacks and picks up nine hundred seventy-two sacks at each of $29$ stops. How many sacks are on board? Show your work.")
    assert not same("A train leaves Lorn with 972 sacks and picks up 2161 sacks at each of 29 stops. How many sacks are on board at the end?")
    assert not same("The line y = 2161x + 972 meets the vertical line x = 29 at a point P. What value is obtained?")


def test_overlaps_edge_cases(spark):
    p = "Let $a = 7783$ and $b = 12016$. What is 28 times their sum?"
    rows = [(1, "train", "s", p, "1", "x"), (2, "test", "s", p, None, "x"), (3, "validation", None, p.upper(), "1", "x"), (4, "train", "s", "Let $a = 12016$ and $b = 7783$. What is 27 times their sum?", "1", "x"), (5, None, "s", p, "1", "x"), (6, "test", "s", None, "1", "x"), (7, "test", "s", " ", "1", "x"), (1, "train", "s", p, "1", "x"), (None, "train", "s", p, "1", "x"), (8, "test", "s", "word " * 30000, "1", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = overlap.cross_split_overlaps(df)
    assert sorted((r["id_a"], r["id_b"]) for r in got.collect()) == [(1, 2), (1, 3)]
    report = {(r["split"], r["source"]): r["n_overlapping"] for r in overlap.overlap_report(df, got).collect()}
    assert report[("test", "s")] == 1 and report[("validation", None)] == 1 and report[(None, "s")] == 0
    assert overlap.cross_split_overlaps(spark.createDataFrame([], SCHEMA)).count() == 0


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(2)
    forms = ["A printer makes {} sheets, then {} sheets, then {} times the sum of both. How many are there altogether?", "The mean of {} numbers is {}, and one more number, {}, joins them. What is the new mean?"]
    rows = []
    for i in range(60):
        a, b, c = (rng.choice([11, 12, 13]) for _ in range(3))
        rows.append((i, rng.choice(["train", "test"]), "s", rng.choice(forms).format(a, b, c), None, "x"))
    got = {(r["id_a"], r["id_b"]) for r in overlap.cross_split_overlaps(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and {x[1], y[1]} == {"train", "test"} and overlap.same_problem(overlap.normal(x[3]), overlap.normal(y[3]))}
    assert got == want


def _item(i, rng):
    w = lambda: "".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(3))
    return f"The {w()} clock strikes {rng.randrange(10, 999)} times for {w()} and {rng.randrange(10, 999)} times for the salted {w()}. A {w()} vessel filled by {w()} drips {rng.randrange(10, 999)} drops in {rng.randrange(10, 999)} hours near {w()}. Write your final answer inside the answer tags."


def test_leaks_found_by_the_latent_search(spark):
    rng = random.Random(5)
    items = [(i, _item(i, rng), "x") for i in range(60)]
    filler = ["The council never agreed on the colour of the lens and that was the end of it.", "Several readers said that the frame looked light while a neighbour watched.", "Every hedge should be cleaned by the volunteers because the rules had changed."]
    docs, want = [], set()
    for d in range(240):
        parts = [rng.choice(filler) for _ in range(rng.randrange(2, 8))]
        if d % 4 == 0:
            i = rng.randrange(60)
            s = items[i][1].split(". ")[0].split()
            if d % 8 == 0:
                s[rng.randrange(5, 12)] = "altered"
            parts.insert(1, (" ".join(s)).upper() + ".")
            want.add((i, d))
        elif d % 4 == 1:
            parts.insert(1, _item(0, rng).split(". ")[0] + ". Write your final answer inside the answer tags.")
        docs.append((d, "\n".join(parts), "y"))
    docs += [(900, None, "y"), (901, "", "y"), (None, "a", "y")]
    got = {tuple(r) for r in leakage.leaked_items(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string, doc_id string")).collect()}
    assert not got - want and len(got & want) >= 0.9 * len(want)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert leakage.leaked_items(empty, spark.createDataFrame(items, "item_id long, text string, doc_id string")).count() == 0
    assert leakage.leaked_items(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_alignment_and_passages():
    a, b = np.array([1, 2, 3, 4, 5], np.uint32), np.array([9, 1, 2, 8, 4, 5], np.uint32)
    s, hits, length, got, whole = leakage.local_alignment(a, np.ones(5), b)
    assert hits == 4 and length == 5 and got == 4 and whole == 5 and leakage.word_ids("A-b  C\n").tolist() == leakage.word_ids("a b c").tolist()
    assert leakage.starts_of(3).tolist() == [0] and leakage.starts_of(17).tolist() == [0, 1] and leakage.starts_of(0).tolist() == []
    cuts = np.array([0, 3, 3, 40])
    ids = np.arange(40, dtype=np.uint32)
    n = 1 << leakage.BITS
    whole = np.zeros((n, 40), np.float32)
    whole[:40] = np.eye(40) * 2
    v, text, start = leakage.passages(ids, cuts, whole, np.full(n, 4.0, np.float32))
    assert [(t, s) for t, s in zip(text, start)] == [(0, 0)] + [(2, s) for s in (0, 8, 16, 24)] and np.allclose(np.linalg.norm(v, axis=1), 1, atol=1e-3)
    v, _, _ = leakage.passages(ids, cuts, whole[:, :20], np.full(n, 4.0, np.float32))
    assert np.linalg.norm(v[0]) > 0.99 and np.linalg.norm(v[-1]) < 0.01, "what the space leaves out shortens a vector"


def _docs_of(text, n):
    filler = "The council never agreed on the colour of the lens and that was the end of it."
    return [(d, f"{filler} {text if d < n else filler}\n{filler}") for d in range(40)]


def test_items_with_equal_or_nearly_equal_texts(spark):
    """One text under k ids in five documents gives 5 k rows; variants of an item are no instruction."""
    rng = random.Random(8)
    others = [(1000 + i, _item(i, rng)) for i in range(8)]
    one = _item(99, rng)
    docs = spark.createDataFrame(_docs_of(one.split(". ")[0] + ".", 5), "doc_id long, text string")
    for k in (1, 2, 3, 6):
        items = spark.createDataFrame([(i, one) for i in range(k)] + others, "item_id long, text string")
        assert leakage.leaked_items(docs, items).count() == 5 * k
    variants = [(i, one.replace("drops", f"drops{i}")) for i in range(6)]
    assert leakage.leaked_items(docs, spark.createDataFrame(variants + others, "item_id long, text string")).count() == 30
    turns = leakage.leaked_items(docs, spark.createDataFrame(variants + others, "item_id long, text string"), items_at_once=5)
    assert turns.count() == 30
