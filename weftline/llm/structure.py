"""Problem 4: statistics of texts and their nearest structural profile.

Method: beside the basic counts, a text's distribution over character classes and over function words (by language)
is compared with profiles by Jensen-Shannon divergence; the nearest structural profile (prose of a language, list,
table, junk) is assigned. Line form (delimiters, markers, sentence ends) is one more distribution of the same kind.
Profiles are counted over all rows of which plain counts make the kind certain (seeds).

Texts that divergence alone leaves in doubt are settled by their dominant line form and by how much of them function
words cover: text of a language in sentences is prose whatever its characters, bare labels and unbroken running text are
told by whether they hold words of any language.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import FUNCTION_SETS, LANGS, WORD, cut, map_arrow, spread

KINDS = ("prose", "list", "table", "junk")
_ANYFW = frozenset().union(*FUNCTION_SETS.values())
_SENT_END = re.compile(r"[.!?…][\"'»”’)\]]*\s*$")
_MARK = re.compile(r"\s*(?:[-*•–—·▪‣+>]\s|\(?\d{1,4}\s?[.):]\s|\d{1,4} [-–] |\(?[a-zA-Z][.)]\s|\[[ xX]?\])")
_QTY = re.compile(r"\s*\d+(?:[.,/]\d+)?\s?(?:g|kg|mg|ml|cl|dl|l|oz|lb|lbs|cups?|tbsp|tsp|pcs|pieces?|x|EL|TL|Stk)\b")
_SEP = re.compile(r"\t|\s{2,}|\s\|\s|^\||\|$|;")
_KV = re.compile(r"^\s*[^\W\d_][^:=\n]{0,40}\s?[:=]\s*\S.{0,60}$")
_URL = re.compile(r"(?:https?://|www\.)\S+|\[[^\]]*\]\([^)]*\)")
_CELL = re.compile(r"^(?:[-–—]|n/?a|\d[\d.,]*\s?(?:%|mm|cm|m|kg|g|am|pm|€|\$)?|yes|no|null|none)$", re.I)
_CODE = re.compile(r"[{};]\s*$|^\s*(?:function|var|let|const|def|class|import|return|if|for|while|public|private|#include|<\w+)\b|=>|\)\s*\{|==|&&|\|\|")
_HEX = re.compile(r"\b[0-9a-fA-F]{2}(?: [0-9a-fA-F]{2}){5,}|\b0x[0-9a-fA-F]+|\b[0-9a-fA-F]{16,}\b")
_MOJI = re.compile(r"[ÃÂâð][\u0080-¿€™œžŸ¢£¤¥¦§¨©ª«¬®¯°±²³´µ¶·¸¹º»¼½¾¿“”‘’‚„†‡•…‰‹›–—˜ˆ]|�|ï¿½")
_RULE = re.compile(r"([~#=_.*+>-])\1{7,}")
_LINE = re.compile(r"\r\n|[\r\n\x0b\x0c\x85  ]")

#: Character classes of the first distribution.
CLASSES = ("vowel", "consonant", "upper", "digit", "space", "newline", "end", "comma", "delim", "math", "other")
_CLASS = {c: "vowel" for c in "aeiouyáàâäãåéèêëíìîïóòôöõúùûüæœø"} | {c: "consonant" for c in "bcdfghjklmnpqrstvwxzçñß"}
_CLASS |= {c: "upper" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÀÇÑ"} | {c: "digit" for c in "0123456789"} | {" ": "space", " ": "space", "\n": "newline", "\r": "newline"}
_CLASS |= {c: "end" for c in ".!?…"} | {c: "comma" for c in ",'’\"()“”«»:¿¡"} | {c: "delim" for c in "\t|;-•*–—·/>»_"} | {c: "math" for c in "=+<>{}[]$%&#@^~\\`"}
_INDEX = {c: CLASSES.index(k) for c, k in _CLASS.items()}
#: Line forms of the second.
FORMS = ("sentence", "open", "marked", "quantity", "row", "pair", "label", "code", "noise")
N_CLASS, N_FORM = len(CLASSES), len(FORMS)


def lines_of(text: str) -> list[str]:
    return [x for x in _LINE.split(text) if x.strip()]


_NO_SYLLABLE = re.compile(r"[a-z][A-Z].*[A-Z]|\d[A-Za-z]+\d|[^aeiouyáéíóúàèìòùâêîôûäöüãõåæøœAEIOUY\W\d_]{6,}")


@lru_cache(maxsize=1 << 18)
def _strange(word: str) -> bool:
    """No syllables of any language: mixed case or digits inside, no vowel, or a run of many consonants."""
    return len(word) > 24 or bool(_NO_SYLLABLE.search(word))


def form_of(line: str, words: list[str] | None = None) -> str:
    """The form of one line (words: its words, where they are known); blanks inside it count as one but for column gaps."""
    s = line.strip()
    words = WORD.findall(s) if words is None else words
    letters = sum(map(len, words))
    if _RULE.search(s) and letters < 0.3 * len(s):
        return "noise"
    if _MOJI.search(s) and len(_MOJI.findall(s)) * 8 > len(s) / 4 or _HEX.search(s):
        return "noise"
    if _CODE.search(s) and len(_CODE.findall(s)) >= 1 and re.search(r"[{}()=;<>]", s) and not re.search(r"[^\W\d_]{2,} [^\W\d_]{2,} [^\W\d_]{2,} [^\W\d_]{2,}", s):
        return "code"
    if letters < 0.45 * len(s.replace(" ", "")) and not _SEP.search(line) and not _QTY.match(line) and not _MARK.match(line) and not _KV.match(line):
        return "noise"
    toks = s.split()
    if len(s) > 12 and sum(map(_strange, toks)) * 2 > len(toks) and not _URL.search(s):
        return "noise"
    fw = sum(w.lower() in _ANYFW for w in words)
    ended = bool(_SENT_END.search(s))
    cells = [c for c in re.split(r"\s*[\t|;]\s*|\s{2,}", s.strip("| \t")) if c]
    if _QTY.match(line) and not ended:
        return "quantity"
    if _MARK.match(line) and len(words) <= 14:
        return "marked"
    if len(cells) >= 2 and max(map(len, cells)) < 50 and ("\t" in s or s.count("|") >= 1 or s.count(";") >= 1 or len(re.findall(r"\s{2,}", s)) >= 1) and fw <= len(cells):
        return "row"
    if _KV.match(line) and fw <= 3 and not ended:
        return "pair"
    if ended and (fw >= 1 or len(words) >= 4):
        return "sentence"
    if fw * 6 >= max(1, len(words)) and len(words) >= 5:
        return "open"
    return "label"


_OF: dict[str, tuple[int, ...]] = {}
for _i, _k in enumerate(LANGS):
    for _w in FUNCTION_SETS[_k]:
        _OF[_w] = (*_OF.get(_w, ()), _i)


def describe(text: str) -> dict:
    """Counts of one text: the basic statistics and the three distributions."""
    lines = lines_of(text)
    low = [w.lower() for w in WORD.findall(text)]
    n = len(low)
    chars = np.zeros(N_CLASS)
    nonblank = alnum = 0
    for c, k in Counter(text).items():
        chars[_INDEX.get(c, N_CLASS - 1)] += k
        if not c.isspace():
            nonblank += k
            if c.isalnum():
                alnum += k
    counts = Counter(low)
    hits, common = [0] * len(LANGS), 0
    for w, k in counts.items():
        if langs := _OF.get(w):
            common += k
            for i in langs:
                hits[i] += k
    best = hits.index(max(hits))
    lang = LANGS[best]
    fw = Counter({w: k for w, k in counts.items() if best in _OF.get(w, ())})
    forms = np.zeros(N_FORM)
    short = 0
    for x in lines:
        words = WORD.findall(x)
        short += len(words) <= 8
        forms[FORMS.index(form_of(x, words))] += len(x)
    coverage = sum(k for w, k in fw.items() if len(w) > 1) / n if n else 0.0
    loose = forms[1] + forms[4] + forms[6] + forms[8] > 0.5 * forms.sum() or coverage < 0.15
    return {
        "n_words": n, "n_tokens": len(text.split()), "n_lines": len(lines), "n_chars": len(text),
        "mean_word_length": sum(map(len, low)) / n if n else 0.0,
        "symbol_ratio": (nonblank - alnum) / nonblank if nonblank else 0.0,
        "ended_lines": sum(bool(_SENT_END.search(x)) for x in lines) / len(lines) if lines else 0.0,
        "common_words": common / n if n else 0.0,
        "coverage": coverage, "distinct": sum(len(w) > 1 for w in fw),
        "lang": lang if hits[best] else None, "fw": fw, "chars": chars, "forms": forms,
        "short_lines": short, "inline": loose and inline_list(text, low),
    }


def jsd(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon divergence in bits of two count vectors; 1 where either is empty."""
    sp, sq = p.sum(), q.sum()
    if not sp or not sq:
        return 1.0
    p, q = p / sp, q / sq
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        return float(0.5 * np.where(p > 0, p * np.log2(p / m), 0).sum() + 0.5 * np.where(q > 0, q * np.log2(q / m), 0).sum())


def function_vector(fw: Counter, lang: str) -> np.ndarray:
    return np.array([fw.get(w, 0) for w in sorted(FUNCTION_SETS[lang])], float)


def inline_list(text: str, low: list[str]) -> bool:
    """Items in a row on one line: many short items between one kind of separator, hardly a function word among them."""
    s = text.strip()
    body = s.split("\n", 1)[1] if "\n" in s and len(s.split("\n", 1)[0]) < 40 else s
    for sep in (r"\s{2,}", r"\s\|\s", r",\s", r"\s[•·/»>]\s", r";\s", r"\s-\s"):
        items = [x for x in re.split(sep, body) if x.strip()]
        if len(items) >= 5 and max(len(x.split()) for x in items) <= 6 and sum(len(x.split()) for x in items) <= 4 * len(items):
            bare = sum(w in _ANYFW and w not in ("and", "und", "et", "y", "e", "en", "of", "no", "a") for w in low)
            return bare * 10 <= len(low) and not sum(bool(re.search(r"[.!?]$", x)) for x in items) * 3 > len(items)
    return False


def seed_kind(d: dict) -> str | None:
    """The kind that plain counts make certain, for the profiles; None where they do not."""
    f = d["forms"] / max(d["forms"].sum(), 1)
    if d["coverage"] > 0.2 and f[0] + f[1] > 0.85:
        return "prose"
    if f[4] + f[5] > 0.9 and d["n_lines"] >= 3 and d["coverage"] < 0.15:
        return "table"
    if f[2] + f[3] > 0.9 and d["n_lines"] >= 3:
        return "list"
    if f[7] + f[8] > 0.9 and d["coverage"] < 0.1:
        return "junk"
    return None


def _gibberish(d: dict) -> bool:
    """Words that are none: no function word among many, in letters that no list or table form explains."""
    return d["n_words"] >= 8 and (d["coverage"] < 0.02 or (d["n_words"] >= 20 and d["coverage"] < 0.12 and d["distinct"] < 0.02 * d["n_words"] + 5))


def profile_rows(found: Iterable[dict]) -> dict[str, list]:
    """Summed distributions of described texts by seed kind: the partial aggregates of the profiles."""
    acc: dict[str, np.ndarray] = {}
    for d in found:
        if (kind := seed_kind(d)) is None:
            continue
        vec = np.concatenate([d["chars"] / max(d["chars"].sum(), 1), d["forms"] / max(d["forms"].sum(), 1)])
        acc[kind] = acc.get(kind, 0) + vec
        if kind == "prose" and d["lang"]:
            v = function_vector(d["fw"], d["lang"])
            acc[f"fw:{d['lang']}"] = acc.get(f"fw:{d['lang']}", 0) + v / max(v.sum(), 1)
    return {"key": list(acc), "vec": [v.tolist() for v in acc.values()]}


_PROFILE = "key string, vec array<double>"


def fit_profiles(df: DataFrame, text_col: str = "text", spread_rows: bool = True) -> dict[str, np.ndarray]:
    """The profiles, counted over all rows: at most 4 + 7 vectors, summed before they come to the driver."""
    run = lambda cols: profile_rows(describe(t) for t in cols["text"] if t and t.strip())
    base = df.select(F.col(text_col).alias("text"))
    return sum_profiles(map_arrow(spread(base) if spread_rows else base, run, _PROFILE))


def sum_profiles(rows: DataFrame) -> dict[str, np.ndarray]:
    summed = rows.select("key", F.posexplode("vec").alias("i", "v")).groupBy("key", "i").agg(F.sum("v").alias("v"))
    out: dict[str, dict[int, float]] = {}
    for r in summed.collect():  # at most 11 keys of at most 150 entries
        out.setdefault(r["key"], {})[r["i"]] = r["v"]
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}


def jsd_rows(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The divergence of each row of counts from one vector."""
    sp, sq = p.sum(1), q.sum()
    if not sq:
        return np.ones(len(p))
    with np.errstate(divide="ignore", invalid="ignore"):
        p, q = p / np.where(sp > 0, sp, 1)[:, None], q / sq
        m = (p + q) / 2
        d = 0.5 * (np.where(p > 0, p * np.log2(p / m), 0).sum(1) + np.where(q > 0, q * np.log2(q / m), 0).sum(1))
    return np.where(sp > 0, d, 1.0)


def divergences(found: list[dict], profiles: dict[str, np.ndarray]) -> list[dict[str, float]]:
    """The divergence of described texts from each profile. For prose the language's function words count as well."""
    if not found:
        return []
    chars, forms = np.array([d["chars"] for d in found]), np.array([d["forms"] for d in found])
    div = {k: 0.4 * jsd_rows(chars, p[:N_CLASS]) + 0.6 * jsd_rows(forms, p[N_CLASS:]) for k in KINDS if (p := profiles.get(k)) is not None}
    if "prose" in div:
        fw = np.ones(len(found))
        for lang in LANGS:
            rows = [i for i, d in enumerate(found) if d["lang"] == lang]
            if rows and (p := profiles.get(f"fw:{lang}")) is not None:
                fw[rows] = jsd_rows(np.array([function_vector(found[i]["fw"], lang) for i in rows]), p)
        half = np.array([1.0 if d["n_words"] > 12 else 0.5 for d in found])
        div["prose"] = 0.6 * div["prose"] + 0.4 * np.maximum(0.0, fw - 0.3) * half
    return [{k: float(v[i]) for k, v in div.items()} for i in range(len(found))]


def nearest(d: dict, div: dict[str, float]) -> str:
    """The structural profile of the least divergence, settled by the dominant line form where that leaves doubt."""
    f = d["forms"] / max(d["forms"].sum(), 1)
    if d["coverage"] >= 0.15 and f[0] + f[1] >= 0.5 and "prose" in div:
        return "prose"
    if not div:
        return "prose"
    kind = min(div, key=lambda k: (div[k], k))
    if kind != "prose" and f[4] + f[5] < 0.5 and f[7] + f[8] > 0.7:
        return "junk"
    if (kind != "table" or d["n_lines"] <= 2) and f[6] + f[4] + f[1] + f[8] > 0.5 and d["inline"]:
        kind = "list"
    elif kind in ("list", "prose", "junk") and f[6] > 0.5:
        # Bare labels: a list in several short lines, junk in running text that holds no word of any language.
        kind = "list" if d["n_lines"] >= 4 and d["short_lines"] >= 0.8 * d["n_lines"] else "junk" if _gibberish(d) else "prose"
    elif kind == "list" and f[4] > 0.5:
        kind = "table"
    if kind == "prose" and f[4] + f[5] > 0.85 and d["n_lines"] >= 3:
        kind = "table"
    if kind == "prose" and d["coverage"] < 0.15:
        # Hardly a function word: prose only in name. The dominant form decides.
        if f[4] + f[5] > 0.6 and d["n_lines"] >= 2:
            kind = "table"
        elif f[2] + f[3] > 0.6 or d["inline"]:
            kind = "list"
        elif d["n_words"] >= 8 and _gibberish(d) or d["n_words"] >= 16 and d["distinct"] <= 1:
            kind = "junk"
    return kind


def kinds_of(texts: list[str | None], profiles: dict[str, np.ndarray]) -> list[str | None]:
    """The kind of each text; None for a null or blank one."""
    found = [describe(t) if t and t.strip() else None for t in texts]
    div = iter(divergences([d for d in found if d], profiles))
    return [nearest(d, next(div)) if d else None for d in found]


STATS = "record_id bigint, kind string, n_words int, n_tokens int, n_lines int, mean_word_length double, symbol_ratio double, ended_lines double, common_words double, lang string, divergence double"


_KEPT = ", n_chars int, coverage double, distinct int, short_lines int, inline boolean, blank boolean, dist binary, fw binary"


def text_statistics(df: DataFrame, id_col: str = "record_id", text_col: str = "text", spread_rows: bool = True) -> DataFrame:
    """One row per record: the basic counts, the nearest kind (prose, list, table, junk; null for a null or blank
    text), the language of its function words (null without any) and the divergence from the assigned profile.

    Null ids are kept as they are; repeated rows give repeated rows; extra columns are ignored; an empty table gives no
    rows. Each text is described once; what is kept of it between the passes has a fixed size, and only the summed profiles move.
    """

    def first(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c.split()[0]: [] for c in (STATS + _KEPT).split(", ")}
        for rid, text in zip(cols["record_id"], cols["text"]):
            d = describe(text or "")
            d |= {"record_id": rid, "kind": None, "divergence": None, "blank": not text or not text.strip(), "dist": np.concatenate([d["chars"], d["forms"]]).tobytes()}
            d["fw"] = function_vector(d["fw"], d["lang"]).astype(np.float32).tobytes() if d["lang"] else b""
            for k in out:
                out[k].append(d[k])
        return out

    base = df.select(F.col(id_col).alias("record_id"), F.col(text_col).alias("text"))
    described = cut(map_arrow(spread(base) if spread_rows else base, first, STATS + _KEPT))
    profiles = sum_profiles(map_arrow(described.filter("not blank"), lambda cols: profile_rows(_again(cols)), _PROFILE))

    def second(cols: dict[str, list]) -> dict[str, list]:
        found = _again(cols)
        out = {c.split()[0]: cols[c.split()[0]] for c in STATS.split(", ")}
        div = [{} if d["blank"] else v for d, v in zip(found, divergences(found, profiles))]
        out["kind"] = [None if d["blank"] else nearest(d, v) for d, v in zip(found, div)]
        out["divergence"] = [v.get(k) for k, v in zip(out["kind"], div)]
        return out

    return map_arrow(described, second, STATS)


def _again(cols: dict[str, list]) -> list[dict]:
    """Described texts from the columns kept of them."""
    out = []
    for row in zip(*cols.values()):
        d = dict(zip(cols, row))
        dist = np.frombuffer(d["dist"], np.float64)
        d["chars"], d["forms"] = dist[:N_CLASS], dist[N_CLASS:]
        d["fw"] = dict(zip(sorted(FUNCTION_SETS[d["lang"]]), np.frombuffer(d["fw"], np.float32).tolist())) if d["lang"] else {}
        out.append(d)
    return out
