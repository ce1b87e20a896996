"""Problem 5: personal information in free text.

Method: bootstrapped contextual extraction. Broad shapes give candidates; those whose shape leaves no doubt (an address
with @, an international phone number, a name in a row with an e-mail address ...) are seeds. Candidates, their
instances (a number's shape, a name's words) and the words before them form a graph. Each round scores a pattern by
the evidence of its instances and an instance by its patterns, so that trusted patterns find identifiers of unseen
shape and trusted shapes find new patterns. Rounds run on counted edges, not on texts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import _LABEL, FUNCTION_SETS, cut, map_arrow, spread

TYPES = ("email", "phone", "idnum", "address", "name")
_U, _L = "A-ZÀ-ÖØ-Þ", "a-zà-öø-ÿ"
CAP = rf"[{_U}][{_L}]+(?:['’-][{_U}][{_L}]+)*"
_AT = r"(?:@|\s?&#0*64;\s?|\s?&commat;\s?|\s?[\[({<]\s?(?:at|AT|@)\s?[\])}>]\s?|\s(?:at|AT)\s(?=[\w-]+\s?(?:[\[({]\s?(?:dot|DOT)|(?:dot|DOT)\b)))"
_DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|DOT|\.)\s?[\])}>]\s?|\s(?:dot|DOT)\s)"
EMAIL = re.compile(rf"(?<![\w.+-])[A-Za-z0-9](?:[A-Za-z0-9_%+'-]|\.(?=[A-Za-z0-9]))*{_AT}[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*{_DOT}[A-Za-z]{{2,24}}(?![\w@])")
NUMBER = re.compile(r"(?<![\w.,/#&-])(?:\+\s?|00)?\(?\d(?:[ .\-/()–\n]{0,2}\d){6,17}(?![\w@:]|[.,]\d|%|-[\dxX])")
CODE = re.compile(r"(?<![\w.@/-])(?:[A-Z]{1,3}[ -]?\d[\d /.-]{3,14}\d(?:[ -]?[A-Z]\d{0,3}\b)?|[A-Z]{2}-\d{3,}-[A-Z]\d{2,}|\d{5,10}[ -]?[A-Z]{1,2}|\d{2,3}[-/]\d{2,3}[-/]\d{4,6})(?![\w@-])")

# Words for streets, by the order of the parts of an address.
_EN_ST = "Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Row|Crescent|Close|Drive|Way|Court|Square|Terrace|Hill|Gardens|Grove|Place|Walk|Boulevard|Blvd|Mews|Park|Rise|View|Parade|Alley|Yard|Green|Gate|Quay|Wharf"
_FR_ST = "rue|avenue|chemin|place|boulevard|allée|impasse|quai|route|cours|passage|sentier|square"
_DE_ST = "gasse|straße|strasse|str\\.|weg|platz|allee|chaussee"
_WEAK_ST = "ring|ufer|damm|stieg|steig|pfad|markt|graben|park|pad|hof|dijk|singel|steeg|dreef"
_SO_ST = "[Cc]alle|[Pp]laza|[Aa]venida|[Pp]aseo|[Cc]amino|[Rr]onda|[Cc]arrera|[Vv]ia|[Vv]iale|[Pp]iazza|[Cc]orso|[Vv]icolo|[Ll]argo|[Rr]ua|[Pp]raça|[Tt]ravessa|[Ee]strada|[Aa]lameda"
_NL_ST = "straat|laan|weg|gracht|plein|kade"
_W = r"[ \t]*\r?\n?[ \t]*"
_S = r"(?:[ \t]+(?:\r?\n[ \t]*)?|\r?\n[ \t]*)"
_DE = r"(?:(?:de la|de los|de las|de l['’]|della|delle|dello|degli|dei|del|des|du|dos|das|de|da|do|di|d['’])\s?)"
_CITY = rf"(?:,{_S}\d{{4,5}}(?:\s?[A-Z]{{2}}\b)?{_S}{CAP})?"
ADDRESS = [
    re.compile(rf"(?:(?:Flat|Apt|Apartment|Unit|Suite|Room)\.?{_S}\w{{1,4}},{_S})?(?<![\w.,/-])\d{{1,5}}[a-zA-Z]?,?{_S}(?:{CAP}{_S}){{1,4}}(?:(?:St|Rd|Ave|Ln|Blvd)\.|(?:{_EN_ST})\b)(?:,{_S}{CAP}(?:{_S}(?:\d{{5}}(?:-\d{{4}})?|[A-Z]{{1,2}}\d[\dA-Z]?{_S}\d[A-Z]{{2}})\b)?)?"),
    re.compile(rf"(?<![\w.,/-])\d{{1,4}}(?:\s?(?:bis|ter))?,?{_S}(?:{_FR_ST}){_S}{_DE}?(?:{CAP}|{_DE}{CAP})(?:{_S}(?:{_DE})?{CAP}){{0,3}}{_CITY}"),
    re.compile(rf"(?<!\w)(?:[{_U}][{_L}]{{2,}}(?:{_DE_ST}|{_NL_ST}|(?:{_WEAK_ST})(?=\s\d{{1,4}}[a-h]?,\s\d))|(?:{CAP}-)+(?:Straße|Strasse|Allee|Platz|Weg)|(?:Am|An der|Im|Auf dem|Zum|Zur) {CAP}){_S}\d{{1,4}}\s?[a-h]?\b{_CITY}"),
    re.compile(rf"(?<!\w)(?:{_SO_ST}){_S}{_DE}?{CAP}(?:{_S}(?:{_DE})?{CAP}){{0,3}},?{_S}(?:n\.?[º°o]\s?)?\d{{1,4}}\b{_CITY}"),
]
OTHER_ADDRESS = re.compile(rf"(?<![\w.,/-])\d{{1,4}}{_S}{CAP}(?:{_S}{CAP}){{1,2}}(?:,{_S}{CAP}(?:{_S}\d{{5}})?)?")
_NAMEWORD = re.compile(rf"[{_U}][{_L}]+(?:['’][{_U}][{_L}]+)*(?:-[{_U}][{_L}]+)*")
_WORDS = re.compile(r"[^\W\d_]+|\d+")
_STREETISH = re.compile(rf"^(?:{_EN_ST}|Flat|Unit)$|(?:{_DE_ST}|{_NL_ST})$")
_DUMP = re.compile(r"(?m)^[0-9a-fA-F]{6,16}:? .*$")
_SEED_PHONE = re.compile(r"\+\d[\d\s().-]{7,}\d|\(\d{3}\) ?\d{3}-\d{4}|1-\d{3}-\d{3}-\d{4}|\d{3}-\d{3}-\d{4}")
_SEED_ID = re.compile(r"\d{3}-\d{2}-\d{4}")
_ANYFW = frozenset().union(*FUNCTION_SETS.values())
_MONTHS = frozenset("january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday".split())
_ROW = re.compile(r"\t|;|\||\s{2,}|,")


def flat(s: str) -> str:
    return re.sub(r"\s+", " ", s).strip()


def shape(s: str) -> str:
    """Digits d, capitals A, the rest as it is; runs counted."""
    s = re.sub(r"[A-Z]", "A", re.sub(r"\d", "d", flat(s).replace("–", "-")))
    return re.sub(r"d+", lambda m: f"d{len(m[0])}", s)


_BOUND = re.compile(r"(?:(?<=\w\w\w\w\w)\.|(?<=\d)\.|[!?])[\"'»”)]*(?=\s)|\.\.\.|…")


def before(text: str, at: int) -> tuple[str, str]:
    """The last word, and the last two, before a place; ^ where a text, a field or a sentence begins. A full stop after
    a word of up to four letters may belong to an abbreviation and ends no sentence."""
    left = text[max(0, at - 60) : at]
    if at == 0 or re.search(r"(?:\n\s*\n|[\t|;]|\s{3,})\s*$", left):
        return "^", "^ ^"
    cut = max((m.end() for m in _BOUND.finditer(left)), default=0)
    words = ["^", "^", *(("#" if w.isdigit() else w.lower()) for w in _WORDS.findall(left[cut:]))]
    return words[-1], " ".join(words[-2:])


def after(text: str, at: int) -> str:
    m = re.match(r"\s*([^\W\d_]+|\d+|[^\w\s])", text[at : at + 30])
    return ("#" if m[1].isdigit() else m[1].lower()) if m else "$"


def candidates(text: str) -> list[tuple[str, int, int, list[str], float]]:
    """(type, start, end, instances, seed) of everything that looks like an item; numbers come once for each type."""
    out: list[tuple[str, int, int, list[str], float]] = []
    taken: list[tuple[int, int]] = []
    clear = lambda a, b: all(b <= x or a >= y for x, y in taken)
    for m in EMAIL.finditer(text):
        if ".." not in m[0]:
            out.append(("email", m.start(), m.end(), ["email"], 1.0))
            taken.append(m.span())
    for pat in ADDRESS:
        for m in pat.finditer(text):
            if clear(*m.span()):
                out.append(("address", m.start(), m.end(), ["street"], 1.0))
                taken.append(m.span())
    numbers: list[tuple[int, int]] = [m.span() for m in _DUMP.finditer(text)]
    for pat in (CODE, NUMBER):
        for m in pat.finditer(text):
            a, b = m.span()
            if not clear(a, b) or any(a < y and b > x for x, y in numbers):
                continue
            s, digits = m[0], sum(c.isdigit() for c in m[0])
            if s.count("\n") > 1 or digits < 6 or s.count("(") != s.count(")") or re.fullmatch(r"\d{1,4}([ \n]\d{1,4}[ \n]?)+", s) and len(s.split()) > 5:
                continue
            numbers.append((a, b))
            sh = shape(s)
            tel, ident = _SEED_PHONE.fullmatch(flat(s)), _SEED_ID.fullmatch(flat(s))
            if not re.search(r"[A-Z]", s) and 8 <= digits <= 15:
                out.append(("phone", a, b, ["phone " + sh], 1.0 if tel else -1.0 if ident else 0.0))
            if digits <= 13:
                out.append(("idnum", a, b, ["idnum " + sh], 1.0 if ident else -1.0 if tel else 0.0))
    for m in OTHER_ADDRESS.finditer(text):
        if clear(*m.span()) and m[0][0] != "0" and not any(m.start() < y and m.end() > x for x, y in numbers) and not any(w.lower() in _ANYFW or w.lower() in _MONTHS for w in _NAMEWORD.findall(m[0])):
            out.append(("address", m.start(), m.end(), ["other"], 0.0))
    words = [m for m in _NAMEWORD.finditer(text)]
    for x, y in zip(words, words[1:]):
        gap = text[x.end() : y.start()]
        if not re.fullmatch(rf"{_S}(?:[{_U}]\.{_S}?){{0,2}}|,{_S}", gap) or gap.count("\n") > 1:
            continue
        if not clear(x.start(), y.end()) or x[0].lower() in _ANYFW or y[0].lower() in _ANYFW or x[0].lower() in _MONTHS or _STREETISH.search(y[0]) or x[0].lower() in _LABEL:
            continue
        first, last = (y[0], x[0]) if "," in gap else (x[0], y[0])
        line_end = text.find("\n", y.end())
        rest = text[y.end() : line_end if line_end >= 0 else len(text)]
        start = text.rfind("\n", 0, x.start()) + 1
        row = bool(re.fullmatch(r"[\s|]*", text[start : x.start()])) and any(y.end() <= a < y.end() + len(rest) for t, a, *_ in out if t == "email") and bool(re.match(r"\t|\s?;|\s?\||\s{2,}", rest))
        nodes = [f"first {first}"] + [f"last {p}" for p in last.split("-")]
        out.append(("name", x.start(), y.end(), nodes, 1.0 if row else 0.0))
    return out


def _extract(cols: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("record_id", "type", "a", "b", "item", "nodes", "w1", "w2", "seed")}
    for rid, text in zip(cols["record_id"], cols["text"]):
        for t, a, b, nodes, seed in candidates(text):
            w1, w2 = before(text, a)
            if w1 == "^":
                w1 = w2 = f"^ _ {after(text, b)}"
            item = re.sub(r"\s+", " ", text[a:b]).strip()
            for k, v in zip(out, (rid, t, a, b, item, nodes, w1, w2, seed)):
                out[k].append(v)
    return out


def _with_patterns(rows: DataFrame, pats: DataFrame) -> DataFrame:
    """p, the score of a row's pattern: of its two last words where they come often enough to tell, else of the last."""
    one, two = (pats.select("type", F.col("w").alias(f"w{i}"), F.col("p").alias(f"p{i}"), F.col("m").alias(f"m{i}")) for i in (1, 2))
    both = rows.join(one, ["type", "w1"]).join(two, ["type", "w2"])
    return both.withColumn("p", F.when(F.col("m2") >= 3, F.col("p2")).otherwise(F.col("p1")))


def discover(cands: DataFrame, rounds: int = 4, unknown: float = 0.1, unknown_words: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Scores of patterns (type, w, p) and of instances (type, node, s) after the given number of rounds.

    Edges are counted once. Seeds speak for a pattern or an instance (+1) or against it (-1, the sure shape of another
    type); what is not yet known counts `unknown` against it (`unknown_words` for names and addresses, whose shapes say less). A candidate's evidence is its seed, else the least score of
    its instances or, where that is enough, of its better pattern.
    """
    edges = cut(cands.groupBy("type", "nodes", "w1", "w2", "seed").agg(F.count("*").alias("n")).withColumn("k", F.monotonically_increasing_id()))
    ev = edges.select("*", F.greatest("seed", F.lit(0.0)).alias("e"))
    pats = nodes = None
    n, e, seed = F.col("n"), F.col("e"), F.col("seed")
    doubt = F.when(F.col("type").isin("name", "address"), F.lit(unknown_words)).otherwise(F.lit(unknown))

    def share(value) -> Column:
        known = F.when(seed < 0, 1.0).otherwise(0.0) + F.greatest(value, doubt * (1 - value))
        return F.sum(n * value) / (F.sum(n * known) + 0.5)

    for _ in range(rounds):
        long = ev.select("type", "n", "e", "seed", F.explode(F.array("w1", "w2")).alias("w"))
        pats = long.groupBy("type", "w").agg(share(F.when(seed < 0, 0.0).otherwise(e)).alias("p"), F.sum("n").alias("m"))
        seen = _with_patterns(edges, pats).select("k", "type", "n", "nodes", "w1", "w2", "seed", F.when(seed != 0, F.greatest("seed", F.lit(0.0))).otherwise(F.col("p")).alias("g"))
        hits = seen.select("k", "type", "n", "seed", F.when(F.col("g") >= 0.4, F.col("g")).otherwise(0.0).alias("e"), F.explode("nodes").alias("node"))
        # Of an instance, places in untrusted contexts speak against it more than an unknown one does against a pattern.
        weight = F.when(e > 0, e).otherwise(F.lit(0.3))
        nodes = hits.groupBy("type", "node").agg((F.sum(n * e) / (F.sum(n * weight) + 0.2)).alias("s"))
        per = hits.join(nodes, ["type", "node"]).groupBy("k").agg(F.min("s").alias("s"))
        trusted = F.when(F.col("g") >= 0.5, F.col("g")).otherwise(0.0)
        ev = cut(seen.join(per, "k").select("type", "n", "nodes", "w1", "w2", "seed", F.when(seed < 0, 0.0).otherwise(F.greatest("seed", F.when(F.col("type") == "name", F.greatest("s", trusted)).otherwise(F.greatest(F.col("s") * 0.5 + F.col("g") * 0.5, trusted)))).alias("e")))
    return pats, nodes


def personal_items(df: DataFrame, id_col: str = "record_id", text_col: str = "text", rounds: int = 4, least: float = 0.5, spread_rows: bool = True) -> DataFrame:
    """One row (record_id, pii_type, pii_text, a, b, score) per place of an item; a, b: code-point offsets.

    Null ids and null, blank or empty texts give no rows; repeated rows give repeated rows; extra columns are ignored; an
    empty table gives no rows. Shuffles move candidates and counted edges, never texts.
    """
    base = df.select(F.col(id_col).alias("record_id"), F.col(text_col).alias("text")).filter("record_id is not null and text is not null")
    cands = map_arrow(spread(base) if spread_rows else base, _extract, "record_id bigint, type string, a int, b int, item string, nodes array<string>, w1 string, w2 string, seed double")
    cands = cut(cands)
    pats, nodes = discover(cands, rounds)
    # Distinct forms are scored once, so that a pattern or name that a third of all rows hold is no hot key.
    forms = cands.select("type", "nodes", "w1", "w2", "seed").distinct().withColumn("k", F.xxhash64("type", "nodes", "w1", "w2", "seed"))
    s = forms.select("k", "type", F.explode("nodes").alias("node")).join(nodes, ["type", "node"]).groupBy("k").agg(F.min("s").alias("s"))
    scored = _with_patterns(forms.join(s, "k"), pats)
    p = F.col("p")
    both = F.when(F.col("type") == "name", F.greatest(F.col("s"), p * 0.9)).otherwise(F.col("s") * 0.4 + p * 0.7)
    scored = scored.select("k", F.when(F.col("seed") < 0, 0.0).otherwise(F.greatest("seed", both)).alias("score"), "s").filter(F.col("score") >= least)
    found = cands.withColumn("k", F.xxhash64("type", "nodes", "w1", "w2", "seed")).join(scored, "k")
    # Where types compete for one place, the type wins whose instances are the surer ones.
    best = found.groupBy("record_id", "a", "b").agg(F.max_by(F.struct("type", "item", "score"), F.struct("s", "score", "type")).alias("x"))
    return best.select("record_id", F.col("x.type").alias("pii_type"), F.col("x.item").alias("pii_text"), "a", "b", F.col("x.score").alias("score"))


def mask_items(df: DataFrame, items: DataFrame, id_col: str = "record_id", text_col: str = "text") -> DataFrame:
    """(record_id, text, n_masked): every item replaced by [EMAIL], [PHONE], [IDNUM], [ADDRESS] or [NAME]; the rest as it was.

    Of overlapping items the longer one counts. Ids must be unique. A text without items, null or blank comes back unchanged."""
    spans = items.groupBy("record_id").agg(F.collect_set(F.struct("a", "b", "pii_type")).alias("spans"))
    base = df.select(F.col(id_col).alias("record_id"), F.col(text_col).alias("text")).join(spans, "record_id", "left")

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"record_id": cols["record_id"], "text": [], "n_masked": []}
        for text, spans in zip(cols["text"], cols["spans"]):
            n, last, parts = 0, 0, []
            kept: list[tuple[int, int, str]] = []
            for s in sorted(spans or [], key=lambda s: (s["a"] - s["b"], s["a"])):
                if all(s["b"] <= a or s["a"] >= b for a, b, _ in kept):
                    kept.append((s["a"], s["b"], s["pii_type"]))
            for a, b, t in sorted(kept):
                parts += [text[last:a], f"[{t.upper()}]"]
                last, n = b, n + 1
            out["text"].append(None if text is None else "".join(parts) + text[last:])
            out["n_masked"].append(n)
        return out

    return map_arrow(base, run, "record_id bigint, text string, n_masked int")
