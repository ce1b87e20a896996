"""Exact and near deduplication, and connected components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators.common import cut, discard, shuffles_dropped, stored
from weftline.operators.similar import distinct_texts, similar_texts


def line_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """How often each line (with its newline) occurs; counted before it is shuffled."""
    return df.select(F.explode(T.kept_lines(text_col)).alias("line")).groupBy("line").agg(F.count("*").alias("n"))


def drop_repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): every line that occurs more than once anywhere goes, its first copy too; order is kept; a text that
    loses all its lines becomes ''. A final line without newline differs from the same line with one. Null texts stay null.

    A line is aggregated to its count and its place before it is shuffled, so that one that a third of all rows hold comes
    once from each partition; of lines that occur once the place is at hand, and no line is joined back."""
    pos = df.select(F.col(id_col).alias("id"), F.posexplode(T.kept_lines(text_col)).alias("pos", "line"))
    once = pos.groupBy("line").agg(F.count("*").alias("n"), F.first("id").alias("id"), F.first("pos").alias("pos")).filter("n = 1")
    texts = once.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]), "").alias("kept"))
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).isNull().alias("none")).join(texts, "id", "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("none"), F.lit(None).cast("string")).otherwise(F.coalesce("kept", F.lit(""))).alias(text_col))


def exact_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, n_copies): class_id is the smallest id of the same text. Null texts form no class."""
    h = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.sha2(F.col(text_col), 256).alias("h"))
    rep = h.groupBy("h").agg(F.min("id").alias("class_id"), F.count("*").alias("n_copies"))
    return h.join(rep, "h").select(F.col("id").alias(id_col), "class_id", "n_copies")


def shingles(text: Column | str, n: int = 5) -> Column:
    return T.ngrams(T.words(T.normalize(text)), n)


def seeded_hash(gram: Column, seed: int) -> Column:
    """md5 of '<seed>-<gram>' as hex; hex order is the order of the numbers."""
    return F.md5(F.concat(F.lit(f"{seed}-"), gram))


def signature(grams: Column, hashes: int = 20) -> Column:
    """Per seed the least hash over the set; all zeros for an empty set."""
    def least(seed: int) -> Column:
        return F.coalesce(F.array_min(F.transform(grams, lambda g: seeded_hash(g, seed))), F.lit("0" * 32))

    return F.array(*[least(s) for s in range(hashes)])


def bands(df: DataFrame, sig_col: str = "sig", hashes: int = 20, n_bands: int = 10) -> DataFrame:
    """(.., band, key): hashes beyond a multiple of the band's rows are ignored."""
    rows = hashes // n_bands
    keys = F.array(*[F.concat_ws("|", F.slice(F.col(sig_col), b * rows + 1, rows)) for b in range(n_bands)])
    return df.select("*", F.posexplode(keys).alias("band", "key")).drop(sig_col)


def candidate_pairs(banded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Pairs (a < b) that share a bucket. Give it distinct texts only: copies would be squared."""
    a = banded.select(F.col(id_col).alias("a"), "band", "key")
    b = banded.select(F.col(id_col).alias("b"), "band", "key")
    return a.join(b, ["band", "key"]).filter("a < b").select("a", "b").distinct()


def jaccard(x: Column, y: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def similar_pairs(df: DataFrame, id_col: str, grams_col: str, threshold: float = 0.8) -> DataFrame:
    """Exact set-similarity join: pairs (a < b, similarity) with a Jaccard similarity of at least the threshold.

    Each set is looked up by its rarest shingles only: of similar sets one of the |S| - ceil(t |S|) + 1 rarest is shared,
    and sizes differ by t at most, so that no pair is lost and frequent shingles are hardly joined. Shingles of one set only
    cannot hit: they are dropped where they are counted, and take the first places of the prefix."""
    base = df.select(F.col(id_col).alias("id"), F.col(grams_col).alias("g")).filter(F.size("g") > 0)
    hashed = cut(base.select("id", F.transform("g", lambda x: F.xxhash64(x)).alias("g"), F.size("g").alias("m")))
    long = hashed.select("id", "m", F.explode("g").alias("h"))
    shared = long.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = long.join(shared, "h").groupBy("id", "m").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("r"))
    keep = F.col("m") - F.ceil(F.col("m") * threshold).cast("int") + 1 - (F.col("m") - F.size("r"))
    prefix = ranked.filter(keep > 0).select("id", "m", F.explode(F.slice("r", F.lit(1), keep)).alias("x")).select("id", "m", F.col("x.h").alias("h"))
    a, b = (prefix.select(F.col("id").alias(x), F.col("m").alias(f"m{x}"), "h") for x in "ab")
    pairs = a.join(b, "h").filter((F.col("a") < F.col("b")) & (F.least("ma", "mb") >= threshold * F.greatest("ma", "mb"))).select("a", "b").distinct()
    ga, gb = (hashed.select(F.col("id").alias(x), F.col("g").alias(f"g{x}")) for x in "ab")
    sim = jaccard(F.col("ga"), F.col("gb"))
    return pairs.join(ga, "a").join(gb, "b").select("a", "b", sim.alias("similarity")).filter(F.col("similarity") >= threshold)


def components(vertices: DataFrame, edges: DataFrame, id_col: str = "id", max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that an undirected path of edges (a, b) reaches; singletons are their own.

    Label propagation with pointer jumping: each round takes the least label among the neighbours, then the label of the
    label, so that rounds grow with the logarithm of the longest path. Each round is stored, and the one before deleted."""
    v = vertices.select(F.col(id_col).alias("id")).distinct()
    with shuffles_dropped(vertices.sparkSession):
        e = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct())
        labels = stored(v.select("id", F.col("id").alias("c")))
        for _ in range(max_rounds):
            near = e.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("c").alias("m"))
            step = labels.join(near, labels.id == near.a, "left").select("id", F.col("c").alias("old"), F.least("c", F.coalesce("m", "c")).alias("c"))
            jump = step.select(F.col("id").alias("c"), F.col("c").alias("cc"))
            new = stored(step.join(jump, "c", "left").select("id", "old", F.least("c", F.coalesce("cc", "c")).alias("c")))
            discard(labels)
            changed = new.filter("c <> old").limit(1).count()
            labels = new
            if not changed:
                break
        else:
            raise RuntimeError("components did not settle")
        discard(e)
    return labels.select(F.col("id").alias(id_col), F.col("c").alias("component"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id, class_id, n_links): class_id is the smallest id of the documents that links of similar texts connect; n_links
    the number of links of the document's text to different texts. Copies of one normal text are one node. Null texts and texts
    of fewer than n words link to copies only."""
    with shuffles_dropped(df.sparkSession):
        norms = normal_texts(df, id_col, text_col)
        sets, members = distinct_texts(norms)
        links = similar_texts(sets, "id", "norm", n, threshold)
        discard(norms)
        nodes = members.filter("id = rep").select("id")
        comp = components(nodes, links) if links.limit(1).count() else nodes.select("id", F.col("id").alias("component"))
    degree = links.select(F.col("a").alias("id")).unionAll(links.select("b")).groupBy("id").agg(F.count("*").alias("n_links"))
    per = comp.join(degree, "id", "left").select(F.col("id").alias("rep"), "component", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return members.join(per, "rep").select(F.col("id").alias(id_col), F.col("component").alias("class_id"), "n_links")


def normal_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, norm) of the texts that are not null, stored; ids are bigints."""
    return stored(df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), T.normalize(text_col).alias("norm")))


def text_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, lsh: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(id) of the distinct normal texts, under the smallest id, and (a, b, similarity) of the similar ones."""
    with shuffles_dropped(df.sparkSession):
        norms = normal_texts(df, id_col, text_col)
        sets, members = distinct_texts(norms)
        pairs = similar_texts(sets, "id", "norm", n, threshold, lsh)
        discard(norms)
    return members.filter("id = rep").select("id"), pairs


def minhash_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, hashes: int = 20, n_bands: int = 10, threshold: float = 0.8) -> DataFrame:
    """(id, component) of the distinct normal texts: signatures of `hashes` least hashes in `n_bands` bands give candidates,
    their exact similarity the links, and the smallest id that links reach the component. Texts of fewer than n words link to
    nothing. Similarity is found first, as that takes no signatures; of a similar pair, hashes are made until a band is shared."""
    nodes, links = text_pairs(df, id_col, text_col, n, threshold, (hashes, n_bands))
    return components(nodes, links)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
