import itertools
import os
import random

import pytest

from weftline.operators import dedup
from weftline.plans import registry


def _documents(spark, path, n=400, words=250):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(words))) for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(path / "documents.parquet"))
    return sum(len(t) for _, t in rows)


def _kept(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files)


@pytest.mark.parametrize("name", ["dup10_minhash_classes", "dup7_altered_pairs", "dup8_components", "dup10_altered_duplicates"])
def test_no_table_of_ngrams_is_kept(spark, tmp_path, name):
    size = _documents(spark, tmp_path)
    folder = spark.sparkContext.getCheckpointDir() or dedup.stored(spark.range(1)) and spark.sparkContext.getCheckpointDir()
    folder = folder.removeprefix("file:")
    before = _kept(folder)
    out = registry.QUERIES[name](spark, str(tmp_path))
    assert out.count() in (400, 800) and _kept(folder) - before < size / 2


def test_minhash_classes_equal_signatures_and_brute_force(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(30):
        base = [rng.choice("abcdefghijklmnop") + str(rng.randrange(30)) for _ in range(rng.choice([3, 5, 12, 30, 90]))]
        texts.append(" ".join(base))
        for _ in range(3):
            x = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                x[rng.randrange(len(x))] = "changed" + str(rng.randrange(9))
            texts.append(" ".join(x))
    texts += ["", " ", texts[0].upper()]
    df = spark.createDataFrame(list(enumerate(texts)) + [(9999, None)], "doc_id long, text string")
    norm = {}
    for i, t in enumerate(texts):
        norm.setdefault(" ".join(t.lower().split()), i)
    import hashlib

    grams = {i: {" ".join(t.split(" ")[k : k + 3]) for k in range(len(t.split(" ")) - 2)} for t, i in norm.items()}
    sig = {i: [min(hashlib.md5(f"{s}-{g}".encode()).hexdigest() for g in gs) for s in range(8)] for i, gs in grams.items() if gs}
    comp = {i: i for i in grams}
    similar, links = {}, []
    for a, b in itertools.combinations(sorted(sig), 2):
        j = len(grams[a] & grams[b]) / len(grams[a] | grams[b])
        if j >= 0.6:
            similar[a, b] = j
            if any(sig[a][k : k + 4] == sig[b][k : k + 4] for k in (0, 4)):
                links.append((a, b))
    for _ in comp:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert len(similar) > len(links) > 5
    got = {r["id"]: r["component"] for r in dedup.minhash_classes(df, n=3, hashes=8, n_bands=2, threshold=0.6).collect()}
    assert got == comp
    pairs = {(r["a"], r["b"]): r["similarity"] for r in dedup.text_pairs(df, n=3, threshold=0.6)[1].collect()}
    assert pairs == similar
    assert dedup.minhash_classes(df.filter("text is null")).count() == 0
