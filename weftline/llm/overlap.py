"""Problem 2: the same or nearly the same records in several splits.

Method: hashes of word n-grams of the evaluation records are partitioned by hash and joined with those of the
training records; containment of the evaluation record in the training record ranks the hits; an exact check of
quantities and question follows.

Two kinds of n-gram are hashed. Runs of `n` words find copied wording; runs of two successive quantities find the
same problem in other words, decorated or misspelt (of records with fewer quantities, pairs of telling words). A record
is looked up by its rarest n-grams only: with at least c of its m n-grams in the training record, one of the m - c + 1
rarest is, so that the prefix loses nothing, and n-grams that a third of all rows share are hardly ever joined.

Filters of a fixed size hold back, before any shuffle, what cannot hit: of the training records only n-grams move that
some evaluation record is looked up by, and only texts that are candidates.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bit_filter, map_arrow, passes, spread, stored

# Number words.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = {"hundred": 100, "thousand": 1000, "million": 10**6, "billion": 10**9}
_VALUE = {w: i for i, w in enumerate(UNITS)} | {w: 20 + 10 * i for i, w in enumerate(TENS)}
_NUMWORD = "|".join(sorted([*_VALUE, *SCALES], key=len, reverse=True))
_NUMRUN = re.compile(rf"\b(?:{_NUMWORD})(?:(?:[\s-]+and)?[\s-]+(?:{_NUMWORD}))*\b")
_LATEX = re.compile(r"\\(?:text(?:bf|it|rm)?|emph|mathrm|mathbf)\s*\{([^{}]*)\}")
_FRAC = re.compile(r"\\[dt]?frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}")
# Elements of HTML that a record's text may hold. Other signs < and > are inequalities.
_ELEMENTS = "a|b|i|u|p|s|br|hr|em|strong|small|sub|sup|span|div|img|table|thead|tbody|tr|td|th|ul|ol|li|center|font|pre|code|h[1-6]|blockquote"
_FIGURE = re.compile(rf"""\[asy\].*?\[/asy\]|</?(?:{_ELEMENTS})(?:\s+[a-z-]+\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>=]+))*\s*/?>|!\[[^\]]*\]\([^)]*\)""", re.S | re.I)
_TOKEN = re.compile(r"\d+(?:\.\d+)?|[^\W\d_]+|[-+*/^=<>]")
_POSED = re.compile(r"[.?!;:\n]+(?=\s|$)|\n+")
_FILLER = frozenset("the a an of to in on at is are was were be it its this that and or for with as by from each".split())


def _number_words(m: re.Match) -> str:
    words = re.split(r"[\s-]+", m[0])
    if words[0] in SCALES:
        return m[0]
    total = part = 0
    last = None
    for w in words:
        if w == "and":
            continue
        if w in SCALES:
            if SCALES[w] == 100:
                part *= 100
            else:
                total, part = total + part * SCALES[w], 0
        else:
            v = _VALUE[w]
            if last is not None and not (part % 100 == 0 or (last in TENS and v < 10)):
                return m[0]
            part += v
        last = w
    return str(total + part)


def normal(text: str) -> str:
    """Case, width, markup, thousands separators and number words made one."""
    s = unicodedata.normalize("NFKC", text).replace("\\,", "").replace("\\!", "")
    s = _FRAC.sub(r" \1 / \2 ", _LATEX.sub(r"\1", _FIGURE.sub(" ", s)))
    s = s.replace("$", " ").replace("\\(", " ").replace("\\)", " ").replace("\\[", " ").replace("\\]", " ").lower()
    s = re.sub(r"(?<=\d)[,_'’\u202f](?=\d{3}(?!\d))", "", s)
    s = re.sub(r"(?<=\d)\s(?=\d{3}(?!\d))(?<!\d{4}\s)", " ", s)
    return _NUMRUN.sub(_number_words, s)


def tokens(s: str) -> list[str]:
    return _TOKEN.findall(s)


def quantities(toks: list[str]) -> list[str]:
    return [t for t in toks if t[0].isdigit()]


def grams(toks: list[str], n: int) -> tuple[list[int], list[int]]:
    """Hashes of the word n-grams (of the whole record where it is shorter) and of the quantity pairs; with fewer than two
    quantities of the pairs of telling words that follow one another."""
    words = {" ".join(toks[i : i + n]) for i in range(max(1, len(toks) - n + 1))} if toks else set()
    q = quantities(toks)
    if len(q) > 1:
        pairs = {f"#{a} {b}" for a, b in zip(q, q[1:])}
    else:
        told = [t for t in toks if t not in _FILLER and not t[0].isdigit()]
        pairs = {f"#{' '.join(q)} {a} {b}" for a, b in zip(["", *told], told)}
    h = lambda s: xxhash.xxh32_intdigest(s)
    return sorted(set(map(h, words))), sorted(set(map(h, pairs)))


def _close(a: str, b: str) -> bool:
    """Equal, or one or two letters apart (a swap counts once) where the words are long enough for it."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 4:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) > 1 and len(y) > 1 and x[:2] == y[1::-1] and x[2:] == y[2:])


def _role(toks: list[str], i: int, w: int) -> set[str]:
    return {t for t in toks[max(0, i - w) : i + w + 1] if not t[0].isdigit() and t not in _FILLER and len(t) > 1}


def _alike(a: set[str], b: set[str]) -> float:
    if not a or not b:
        return float(a == b)
    hit = sum(x in b or any(_close(x, y) for y in b) for x in a)
    return hit / max(len(a), len(b))


def core(text: str) -> tuple[list[str], list[list[str]]]:
    """All tokens, and the sentences that pose the problem: those with a quantity, and the one that asks."""
    parts = [p for p in map(tokens, _POSED.split(text)) if p]
    posed = [k for k, p in enumerate(parts) if any(t[0].isdigit() for t in p)]
    if not posed:
        return tokens(text), parts
    return tokens(text), parts[posed[0] :]


def same_problem(a: str, b: str, least: float = 0.5) -> bool:
    """The exact check on two normal texts: the same quantities in order, each in a like context, and a like wording
    of all that poses the problem. A heading or a source note may add words and a number at either end."""
    if a == b:
        return True
    ta, tb = tokens(a), tokens(b)
    qa, qb = quantities(ta), quantities(tb)
    if len(qa) > len(qb):
        a, b, ta, tb, qa, qb = b, a, tb, ta, qb, qa
    if not qa:
        wa, wb = [t for t in ta if t not in _FILLER], [t for t in tb if t not in _FILLER]
        return bool(wa) and _alike(set(wa), set(wb)) >= 0.8
    pa, pb = [i for i, t in enumerate(ta) if t[0].isdigit()], [i for i, t in enumerate(tb) if t[0].isdigit()]
    for k in range(len(qb) - len(qa) + 1):
        if qb[k : k + len(qa)] != qa:
            continue
        if len(qb) - len(qa) > 2 and len(qa) < 3:
            continue
        span_a, span_b = ta[max(0, pa[0] - 6) :], tb[max(0, pb[k] - 6) :]
        last = pb[k + len(qa)] - 2 if k + len(qa) < len(pb) else len(tb)
        span_b = tb[max(0, pb[k] - 6) : max(last, pb[k + len(qa) - 1] + 4)]
        wa = {t for t in span_a if not t[0].isdigit() and t not in _FILLER}
        wb = {t for t in span_b if not t[0].isdigit() and t not in _FILLER}
        inter = sum(x in wb or any(_close(x, y) for y in wb) for x in wa)
        whole = inter / max(1, min(len(wa), len(wb)))
        roles = [_alike(_role(ta, i, 4), _role(tb, j, 4)) for i, j in zip(pa, pb[k:])]
        if whole >= least and sum(roles) / len(roles) >= 0.4:
            return True
    return False


def _prepare(n: int):
    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("rid", "side", "answer", "cls", "norm", "words", "pairs")}
        for rid, side, text, answer in zip(cols["rid"], cols["side"], cols["text"], cols["answer"]):
            norm = " ".join(tokens(s := normal(text)))
            if not norm:
                continue
            w, p = grams(tokens(s), n)
            plain = " ".join(tokens(normal(answer))) if answer else None
            for k, v in zip(out, (rid, side, plain, xxhash.xxh128_digest(norm), s, w, p)):
                out[k].append(v)
        return out

    return run


def _postings(rows: DataFrame, bits: np.ndarray, what: str) -> DataFrame:
    """Of the n-grams that a filter lets pass: `count` (g, n), how many rows hold each, in partial sums; `place` (g, kind, m,
    cls); `whole` (g, kind, all, cls) with all n-grams of the kind."""
    held = rows.sparkSession.sparkContext.broadcast(bits)
    schema = {"count": "g bigint, n bigint", "place": "g bigint, kind int, m int, cls binary", "whole": "g bigint, kind int, all array<bigint>, cls binary"}[what]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for kind, name in enumerate(("words", "pairs")):
                col = b.column(name)
                m = pc.list_value_length(col).to_numpy(zero_copy_only=False).astype(np.int32)
                g = col.flatten().to_numpy(zero_copy_only=False)
                at = np.nonzero(passes(held.value, g))[0]
                if what == "count":
                    u, n = np.unique(g[at], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(n, pa.int64())], ["g", "n"])
                    continue
                own = np.repeat(np.arange(len(m)), m)[at]
                row = pa.array(own, pa.int64())
                third = pa.array(m[own]) if what == "place" else col.take(row)
                yield pa.RecordBatch.from_arrays([pa.array(g[at], pa.int64()), pa.array(np.full(len(at), kind, np.int32)), third, b.column("cls").take(row)], ["g", "kind", "m" if what == "place" else "all", "cls"])

    return rows.select("cls", "words", "pairs").mapInArrow(run, schema)


def cross_split_overlaps(
    df: DataFrame, id_col: str = "problem_id", text_col: str = "problem", split_col: str = "split", answer_col: str = "answer",
    train: str = "train", evals: tuple[str, ...] = ("validation", "test"), n: int = 5, containment: float = 0.8, pair_containment: float = 0.5,
    spread_rows: bool = True,
) -> DataFrame:
    """Pairs (id_a, id_b, containment, same_answer), the smaller id first, of a training and an evaluation record that are the
    same problem. same_answer: whether their answers are written alike but for markup; null where one of them is missing.

    A pair is looked at where the training record holds at least `containment` of the evaluation record's word n-grams
    or `pair_containment` of its quantity pairs; the exact check decides. Null ids, splits or texts and blank texts never
    count; repeated rows give one pair; extra columns are ignored; an empty table gives no rows. Exact copies are one
    class until the end, so that a text that many rows share is compared once.
    """
    answer = F.col(answer_col).cast("string") if answer_col in df.columns else F.lit(None).cast("string")
    base = df.select(F.col(id_col).alias("rid"), F.col(split_col).alias("split"), F.col(text_col).alias("text"), answer.alias("answer"))
    base = base.filter(F.col("rid").isNotNull() & F.col("text").isNotNull() & F.col("split").isin(train, *evals))
    base = base.select("rid", F.when(F.col("split") == train, 0).otherwise(1).alias("side"), "text", "answer")
    prep = stored(map_arrow(spread(base) if spread_rows else base, _prepare(n), "rid bigint, side int, answer string, cls binary, norm string, words array<bigint>, pairs array<bigint>"))
    tr = prep.filter("side = 0")
    ev = stored(prep.filter("side = 1").groupBy("cls").agg(*[F.first(c).alias(c) for c in ("norm", "words", "pairs")]))
    # How many training records hold each n-gram of an evaluation record: any order of n-grams would do for the prefix.
    wanted = bit_filter(ev.select(F.explode(F.concat("words", "pairs")).alias("g")), "g")
    counts = stored(_postings(tr, wanted, "count").groupBy("g").agg(F.sum("n").alias("n")))
    seen = _postings(ev, bit_filter(counts, "g"), "place").join(counts, "g")
    share = F.when(F.col("kind") == 0, F.lit(containment)).otherwise(F.lit(pair_containment))
    ranked = seen.groupBy("cls", "kind", "m").agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("gs"))
    # N-grams that no training record has cannot hit, yet are the rarest: they take the first places of the prefix.
    keep = F.col("m") - F.ceil(F.col("m") * share).cast("int") + 1 - (F.col("m") - F.size("gs"))
    prefix = ranked.filter(keep > 0).select("cls", "kind", F.explode(F.slice("gs", F.lit(1), keep)).alias("x"))
    prefix = prefix.join(ev.select("cls", "words", "pairs"), "cls").select(F.col("cls").alias("e"), "kind", "x.g", F.when(F.col("kind") == 0, F.col("words")).otherwise(F.col("pairs")).alias("of_e"))
    prefix = stored(prefix)
    postings = _postings(tr, bit_filter(prefix, "g"), "whole").select("g", "kind", F.col("cls").alias("t"), F.col("all").alias("of_t")).distinct()
    # Containment is counted where the pair is met, so that what only shares a frequent pair of quantities goes no further.
    held = F.size(F.array_intersect("of_e", "of_t")) / F.size("of_e")
    hits = prefix.join(postings, ["g", "kind"]).select("e", "t", "kind", held.alias("containment")).filter(F.col("containment") >= share)
    hits = stored(hits.groupBy("e", "t").agg(F.max("containment").alias("containment")))
    texts = _classes_of(tr, bit_filter(hits.select(F.xxhash64("t").alias("k")), "k")).dropDuplicates(["cls"])
    scored = hits.join(ev.select(F.col("cls").alias("e"), F.col("norm").alias("en")), "e").join(texts.select(F.col("cls").alias("t"), F.col("norm").alias("tn")), "t")

    def verify(cols: dict[str, list]) -> dict[str, list]:
        same = [same_problem(a, b) for a, b in zip(cols["en"], cols["tn"])]
        return {k: [v for v, x in zip(cols[k], same) if x] for k in ("e", "t", "containment")}

    found = stored(map_arrow(scored, verify, "e binary, t binary, containment double"))
    rows = lambda side, x: prep.filter(f"side = {side}").select(F.col("cls").alias(x), F.col("rid").alias("rid" + x), F.col("answer").alias("a" + x))
    both = found.join(rows(1, "e"), "e").join(rows(0, "t"), "t").filter("ride <> ridt")
    return both.groupBy(F.least("ride", "ridt").alias("id_a"), F.greatest("ride", "ridt").alias("id_b")).agg(F.max("containment").alias("containment"), F.max(F.col("ae") == F.col("at")).alias("same_answer"))


def _classes_of(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """The classes whose hash a filter lets pass."""
    held = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = passes(held.value, b.column("k").to_numpy())
            yield pa.RecordBatch.from_arrays(b.columns[1:], names=b.schema.names[1:]).filter(pa.array(keep))

    return rows.select(F.xxhash64("cls").alias("k"), "cls", "norm").mapInArrow(run, "cls binary, norm string")


def overlap_report(df: DataFrame, pairs: DataFrame, id_col: str = "problem_id", split_col: str = "split", source_col: str = "source") -> DataFrame:
    """Per split and source of the evaluation side: records, records with an overlap, and their share. Null sources form one group."""
    ids = pairs.select(F.col("id_a").alias("rid")).union(pairs.select("id_b")).distinct().withColumn("hit", F.lit(1))
    base = df.select(F.col(id_col).alias("rid"), F.col(split_col).alias("split"), F.col(source_col).alias("source"))
    j = base.join(ids, "rid", "left")
    return j.groupBy("split", "source").agg(F.count("*").alias("n_records"), F.count("hit").alias("n_overlapping")).withColumn(
        "share", F.round(F.col("n_overlapping") / F.col("n_records"), 6)
    )
