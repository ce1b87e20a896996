"""Problem 10: keyword-stuffed and link-list pages.

Method: robust Mahalanobis distance. Each document becomes a vector of density, entropy, repetition and function-word
features. For each language, location and scatter are estimated robustly: from medians and deviations at first, then
by concentration steps, each from the sums over the rows that lie nearest. A document is flagged where it lies far
out and in a direction of spam: stuffed keywords, bare links or link labels, or tags.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import FUNCTION_SETS, LANGS, cut, map_arrow, spread

FEATURES = ("function", "ends", "top_pair", "top_words", "entropy", "links", "tags", "bare", "market", "labels", "distinct")
#: The directions of spam: which way each feature moves, for stuffed keywords, bare links, link labels and tags.
DIRECTIONS = {
    "stuffed": {"function": -1, "ends": -0.5, "top_pair": 1.5, "top_words": 1.5, "entropy": -1.5, "market": 0.7, "distinct": -1},
    "links": {"function": -1, "ends": -0.5, "links": 2.5},
    "labels": {"function": -1, "ends": -1, "labels": 2, "bare": 1, "market": 0.5},
    "tags": {"function": -1, "ends": -1, "tags": 2, "bare": 0.7, "market": 0.5},
    "list": {"function": -1, "ends": -1, "bare": 1.5, "market": 1, "top_words": 0.5},
}
# Words that sell, and labels of links and menus.
MARKET = frozenset("buy cheap cheapest sale sales discount discounts coupon coupons deal deals online price prices best top rated review reviews order shop shops store wholesale free shipping bargain offer offers promo outlet affordable kaufen günstig rabatt angebot angebote acheter soldes promotion prix livraison comprar barato oferta ofertas descuento acquista sconto sconti offerta offerte desconto promoção kopen goedkoop korting aanbieding".split())
LABELS = frozenset("home startseite accueil inicio contact kontakt about login register search tags archive news shop gallery members help support forum faq downloads impressum topics click here read more next previous menu sitemap warenkorb compte mon cart subscribe".split())
_IN: dict[str, tuple[int, ...]] = {}
for _i, _k in enumerate(LANGS):
    for _w in FUNCTION_SETS[_k]:
        _IN[_w] = (*_IN.get(_w, ()), _i)
_LINK = re.compile(r"\[[^\]\n]{0,80}\]\((?:https?:|www\.|/)[^)\s]*\)|(?:https?://|www\.)\S+|<a\s[^>]*>.*?</a>", re.I)
_WORD = re.compile(r"#?[^\W_]+")
_SEGMENT = re.compile(r"[\n\r,;|»>•·/]+|\s[-–*]\s|(?<=[.!?])\s")
_END = re.compile(r"[.!?…](?=\s|$|[\"'»”)])")


def vector(text: str) -> tuple[list[float], str | None, int]:
    """The features of one text, the language of its function words, and its number of words."""
    link_chars = n_links = 0
    plain = text
    if "http" in text or "](" in text or "www." in text or "<a " in text:
        spans = [m.span() for m in _LINK.finditer(text)]
        n_links, link_chars = len(spans), sum(b - a for a, b in spans)
        plain = _LINK.sub(" ", text) if spans else text
    words = _WORD.findall(plain.lower())
    n = len(words)
    size = max(len(text) - text.count(" ") - text.count("\n"), 1)
    links = min(1.0, link_chars / size)
    if not n:
        return [0.0, 0.0, 0.0, 0.0, 1.0, links, 0.0, 0.0, 0.0, 0.0, 1.0], None, n_links
    counts = Counter(words)
    per = [0] * len(LANGS)
    market = labels = 0
    content = []
    often = set()
    entropy = 0.0
    for w, c in counts.items():
        entropy += c * math.log2(c)
        langs = _IN.get(w)
        if langs:
            for i in langs:
                per[i] += c
        else:
            content.append(c)
            if c > 2:
                often.add(w)
            if w in MARKET:
                market += c
        if w in LABELS:
            labels += c
    entropy = math.log2(n) - entropy / n
    best = max(range(len(LANGS)), key=per.__getitem__)
    content.sort(reverse=True)
    top_words = sum(content[:3]) / n
    top_pair = 0
    if len(often) > 1:
        pairs = Counter((a, b) for a, b in zip(words, words[1:]) if a in often and b in often)
        top_pair = max(pairs.values(), default=1) - 1
    tags = sum(c for w, c in counts.items() if w[0] == "#") / n
    bare = total = 0
    for s in _SEGMENT.split(plain):
        if len(s) > 60:
            total += s.count(" ") + 1
            continue
        ws = s.split()
        if not ws:
            continue
        total += len(ws)
        if len(ws) <= 5 and ws[-1][-1] not in ".!?" and not any(w.lower() in _IN for w in ws):
            bare += len(ws)
    ends = min(1.0, 8 * len(_END.findall(plain)) / n)
    return [
        per[best] / n, ends, 2 * top_pair / n, top_words, entropy / max(math.log2(n), 1.0) if n > 1 else 1.0, links, tags,
        bare / max(total, 1), market / n, labels / n, len(counts) / n,
    ], LANGS[best] if per[best] else None, n + 4 * n_links


#: Least scale of a feature: features that are nearly always zero would else make any trace of them an outlier.
FLOOR = np.array([0.04, 0.12, 0.03, 0.04, 0.05, 0.06, 0.03, 0.05, 0.02, 0.03, 0.1])
_DIRS = {k: np.array([v.get(f, 0.0) for f in FEATURES]) for k, v in DIRECTIONS.items()}


class Shape:
    """Robust location and scatter of one language's vectors."""

    def __init__(self, mean: np.ndarray, cov: np.ndarray):
        self.mean = mean
        cov = cov + np.diag(FLOOR**2) * 0.25
        self.scale = np.maximum(np.sqrt(np.diag(cov)), FLOOR)
        self.inverse = np.linalg.inv(cov)

    def distance(self, x: np.ndarray) -> np.ndarray:
        d = x - self.mean
        return np.einsum("ij,jk,ik->i", d, self.inverse, d)

    def direction(self, x: np.ndarray) -> list[tuple[str, float]]:
        """The spam direction that each deviation is nearest to, and the cosine. Single features count up to 12 scales."""
        z = np.clip((x - self.mean) / self.scale, -12, 12)
        norm = np.linalg.norm(z, axis=1) + 1e-9
        names = list(_DIRS)
        # A feature beyond what a direction names neither helps nor harms it while it moves the way of spam.
        cos = np.stack([np.minimum(np.maximum(z @ (v / np.linalg.norm(v)), 0) / norm, 1) for v in _DIRS.values()], 1)
        best = cos.argmax(1)
        return [(names[b], float(c)) for b, c in zip(best, cos[np.arange(len(z)), best])]


def _group(lang: str | None, label: str | None) -> str:
    from weftline.llm.common import label_code

    return label_code(label) or lang or "und"


def _shrunk(mean: np.ndarray, cov: np.ndarray, n: float, pooled: Shape | None, pooled_cov: np.ndarray | None, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Location and scatter drawn towards the pooled ones, as if those had been seen in `prior` more rows."""
    if pooled is None:
        return mean, cov
    own = n / (n + prior)
    return own * mean + (1 - own) * pooled.mean, own * cov + (1 - own) * pooled_cov


def fit_shapes(vectors: DataFrame, steps: int = 2, part: float = 0.75, prior: float = 100.0) -> dict[str, Shape]:
    """Shapes by language, and one of all rows under ''. A language's shape is drawn towards that of all rows by as much as
    `prior` rows weigh beside its own, alike at every size; without any row of 12 words the shape of all rows is one
    around 0.

    The first centre is the median, the first scale the median deviation; each step then takes the sums over the `part`
    of the rows that lie nearest. Only quantiles and sums, one row a language, come to the driver.
    """
    told = vectors.filter("n >= 12")
    # Texts of no telling language are no language of their own: the shape of all rows judges them.
    exploded = told.filter("g <> 'und'").select("g", "x", "b").unionByName(told.select(F.lit("").alias("g"), "x", "b"))
    k = len(FEATURES)
    col = [F.col("x")[i] for i in range(k)]
    med = {r["g"]: r for r in exploded.groupBy("g").agg(F.count("*").alias("n"), *[F.percentile_approx(c, 0.5, 2000).alias(f"m{i}") for i, c in enumerate(col)], *[F.percentile_approx(c, [0.25, 0.75], 2000).alias(f"q{i}") for i, c in enumerate(col)]).collect()}
    if "" not in med:
        return {"": Shape(np.zeros(k), np.diag(FLOOR**2))}
    shapes: dict[str, Shape] = {}
    pooled_cov = None
    for g in sorted(med):  # '' comes first
        r = med[g]
        spread_ = np.array([max((r[f"q{i}"][1] - r[f"q{i}"][0]) / 1.35, FLOOR[i]) for i in range(k)])
        mean, cov = _shrunk(np.array([r[f"m{i}"] for i in range(k)]), np.diag(spread_**2), r["n"], shapes.get(""), pooled_cov, prior)
        shapes[g] = Shape(mean, cov)
        pooled_cov = cov if g == "" else pooled_cov
    for _ in range(steps):
        measured = map_arrow(exploded.select("g", "b"), _distances(shapes), "g string, d double, b binary")
        cut_at = {r["g"]: r["q"] for r in measured.groupBy("g").agg(F.percentile_approx("d", part, 5000).alias("q")).collect()}

        def sums(cols: dict[str, list], cut_at=cut_at) -> dict[str, list]:
            out: dict[str, list] = {"g": [], "n": [], "s": []}
            g, d = np.array(cols["g"]), np.array(cols["d"], float)
            for name in set(cols["g"]):
                rows = np.nonzero((g == name) & (d <= cut_at[name]))[0]
                if len(rows):
                    x = _matrix([cols["b"][i] for i in rows])
                    out["g"].append(name)
                    out["n"].append(len(rows))
                    out["s"].append(np.concatenate([x.sum(0), (x.T @ x).ravel()]).tolist())
            return out

        parts = map_arrow(measured, sums, "g string, n bigint, s array<double>")
        total = parts.groupBy("g").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(k + k * k)])
        new: dict[str, Shape] = {}
        for r in sorted(total.collect(), key=lambda r: r["g"]):  # one row a language
            s = np.array([r[f"s{i}"] for i in range(k + k * k)]) / r["n"]
            # The nearest three quarters vary less than all: scaled as for normal rows.
            own_cov = (s[k:].reshape(k, k) - np.outer(s[:k], s[:k])) * 1.6
            mean, cov = _shrunk(s[:k], own_cov, r["n"], new.get(""), pooled_cov, prior)
            new[r["g"]] = Shape(mean, cov)
            pooled_cov = cov if r["g"] == "" else pooled_cov
        shapes |= new
    return shapes


def _matrix(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(-1, len(FEATURES))


def _distances(shapes: dict[str, Shape]):
    def run(cols: dict[str, list]) -> dict[str, list]:
        x = _matrix(cols["b"])
        d = np.zeros(len(x))
        g = np.array(cols["g"])
        for name in set(cols["g"]):
            rows = np.nonzero(g == name)[0]
            d[rows] = shapes.get(name, shapes[""]).distance(x[rows])
        return {"g": cols["g"], "d": d.tolist(), "b": cols["b"]}

    return run


def spam_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", far: float = 180.0, least_cosine: float = 0.45, least_words: int = 12, spread_rows: bool = True) -> DataFrame:
    """One row per document: its squared robust distance, the nearest spam direction with the cosine, and `spam`.

    `far` is well beyond a chi-square bound (31 at 0.999 for 11 features): the features of sound pages have long tails,
    such as links that are annotated. Null, blank and very short texts (fewer than `least_words` words) are scored but never spam; null ids are kept; repeated rows give repeated rows; extra columns
    are ignored; an empty table gives no rows. Texts are read once; shuffles move sums only.
    """

    def features(cols: dict[str, list]) -> dict[str, list]:
        got = [vector(t or "") for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "g": [_group(v[1], lab) for v, lab in zip(got, cols["label"])], "n": [v[2] for v in got], "x": [v[0] for v in got], "b": [np.array(v[0]).tobytes() for v in got]}

    label = F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), label.alias("label"))
    vectors = cut(map_arrow(spread(base) if spread_rows else base, features, "doc_id bigint, g string, n int, x array<double>, b binary"))
    shapes = fit_shapes(vectors)

    def judge(cols: dict[str, list]) -> dict[str, list]:
        x = _matrix(cols["b"])
        d, way = np.zeros(len(x)), [("", 0.0)] * len(x)
        g = np.array(cols["g"])
        for name in set(cols["g"]):
            rows = np.nonzero(g == name)[0]
            shape = shapes.get(name, shapes[""])
            d[rows] = shape.distance(x[rows])
            for i, w in zip(rows, shape.direction(x[rows])):
                way[i] = w
        n = np.array(cols["n"])
        spam = (d >= far) & np.array([w[1] >= least_cosine for w in way]) & (n >= least_words)
        return {"doc_id": cols["doc_id"], "lang_group": cols["g"], "distance": d.tolist(), "direction": [w[0] for w in way], "cosine": [w[1] for w in way], "spam": spam.tolist()}

    return map_arrow(vectors.drop("x"), judge, "doc_id bigint, lang_group string, distance double, direction string, cosine double, spam boolean")
