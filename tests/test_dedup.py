import hashlib
import itertools
import random

from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import dedup


def test_line_dedup_golden(spark):
    df = spark.createDataFrame([(1, "a\nb\na\n"), (2, "b\nc"), (3, "c\nd\n"), (4, None), (5, ""), (6, "\n")], "doc_id long, text string")
    got = {r[0]: r[1] for r in dedup.drop_repeated_lines(df).collect()}
    assert got == {1: "", 2: "c", 3: "c\nd\n", 4: None, 5: "", 6: "\n"}


def test_signatures_bands_and_jaccard(spark):
    a, b = "the cat sat on the mat", "the cat sat on a mat"
    df = spark.createDataFrame([(1, a), (2, b), (3, "x")], "doc_id long, t string").select("doc_id", T.ngrams(T.words("t"), 2).alias("g"))
    got = {r["doc_id"]: r for r in df.select("doc_id", "g", dedup.signature(F.col("g"), 4).alias("sig")).collect()}
    for s in range(4):
        want = min(hashlib.md5(f"{s}-{g}".encode()).hexdigest() for g in got[1]["g"])
        assert got[1]["sig"][s] == want
    assert got[1]["sig"][0] == "0dfc0a3f43576d550099050c24f4e5eb" and got[3]["sig"] == ["0" * 32] * 4
    j = spark.createDataFrame([(got[1]["g"], got[2]["g"]), ([], [])], "x array<string>, y array<string>").select(dedup.jaccard(F.col("x"), F.col("y"))).collect()
    assert abs(j[0][0] - 3 / 7) < 1e-12 and j[1][0] == 0.0
    banded = dedup.bands(df.select("doc_id", dedup.signature(F.col("g"), 5).alias("sig")), hashes=5, n_bands=2)
    assert banded.groupBy("doc_id").count().filter("count <> 2").count() == 0


def test_components_of_paths_cycles_and_singletons(spark):
    edges = [(1, 2), (2, 3), (3, 1), (10, 11), (11, 12), (12, 13), (13, 14), (14, 15), (15, 16)]
    v = spark.createDataFrame([(i,) for i in [1, 2, 3, *range(10, 17), 99]], "id long")
    e = spark.createDataFrame(random.Random(1).sample(edges, len(edges)), "a long, b long")
    got = {r["id"]: r["component"] for r in dedup.components(v, e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, **{i: 10 for i in range(10, 17)}, 99: 99}
    none = dedup.components(v, spark.createDataFrame([], "a long, b long"))
    assert all(r["id"] == r["component"] for r in none.collect())


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(60)]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            x = list(base)
            x[rng.randrange(60)] = "changed"
            texts.append(" ".join(x))
    texts += [texts[0], "", "short one", texts[0].upper()]
    df = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)] + [(999, None, "extra")], "doc_id long, text string, a string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in dedup.near_duplicates(df).collect()}
    norm = [t.lower() for t in texts]
    g = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in enumerate(norm)}
    rep = {i: norm.index(t) for i, t in enumerate(norm)}
    nodes = sorted(set(rep.values()))
    links = [(a, b) for a, b in itertools.combinations(nodes, 2) if g[a] and g[b] and len(g[a] & g[b]) / len(g[a] | g[b]) >= 0.8]
    comp = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    want = {i: (comp[rep[i]], sum(rep[i] in x for x in links)) for i in range(len(texts))}
    assert got == want and len(links) > 3


def test_exact_classes(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None)], "doc_id long, text string")
    assert sorted(map(tuple, dedup.exact_classes(df).collect())) == [(1, 1, 2), (2, 2, 1), (3, 1, 2)]
