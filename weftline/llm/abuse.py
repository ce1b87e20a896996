"""Problem 3: abusive, hateful or sexual content.

Method: noisy-channel deobfuscation. Spans that hide letters (leetspeak, masks, spaced or repeated letters) become
character lattices, decoded by a Viterbi beam under a character language model counted over the corpus's words and
the labelled lines; the restored sentences are scored by a linear classifier trained on the labelled lines.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import FUNCTION_SETS, WORD, bounded_sample, map_arrow, spread
from weftline.llm.linear import Linear, bucket

CATEGORIES = ("abusive", "hateful", "sexual")
BITS = 16
#: Training takes unlabelled sentences without listed words as clean, so that of sentences with them positives are rarer
#: than in use: their odds are raised by this factor.
EVIDENCE_ODDS = 2.7

# Words of insult and threat, of sexual content, and of contempt for groups, by language.
INSULTS = "idiot idiots moron morons imbecile imbeciles cretin cretins halfwit halfwits dimwit dimwits fool fools loser losers coward cowards scumbag scumbags bastard bastards bitch bitches asshole assholes jerk jerks dumbass retard retarded clown clowns pig pigs rat rats parasite parasites vermin scum trash garbage filth filthy stupid worthless useless pathetic disgusting spineless brainless miserable rotten ugly dumb shut hell crawl choke shove whore slut dick prick twat wanker swine lowlife maggot bollocks drool dim idiotisch vollidiot schwachkopf depp trottel arschloch versager dreckskerl missgeburt hurensohn verpiss fresse dumm erbärmlich erbärmlicher elender abruti abrutis crétin connard connasse salaud imbécile minable minables dégage gueule ordure ordures débile enculé imbécil imbéciles idiota idiotas estúpido estúpida basura lárgate cállate mierda cabrón gilipollas pendejo inútil asqueroso stronzo coglione cretino deficiente imbecille schifo vaffanculo bastardo vattene otário burro lixo nojento merda cala vagabundo idioot sukkel klootzak debiel eikel mongool rotzak achterlijk stommeling tuig".split()
SEXUAL = "sex sexy porn porno porns pornos pornographic xxx nude nudes naked horny fuck fucks fucking fucked orgy orgies milf milfs swingers webcam cam hookup hookups undressed uncensored hardcore uncut blowjob cum climaxed climax orgasm moaned moan groan licked nipples tits breasts pussy cock penis erotic escort escorts dildo vibrator vibrators vibrating lingerie threesome anal bdsm fetish stripper strip nackt nackte nackten geil geile hausfrauen ficken fick titten muschi schwanz sexfilme nue nues nus nu baise baiser chatte bite salope cochonne desnuda desnudas desnudo desnudos follar folla coño polla tetas culo calientes nudo nuda nudi nude scopare scopa figa cazzo troia nua nuas nu nus foder buceta caralho peitos putaria naakt naakte neuken geile kut lul pijpen".split()
CONTEMPT = "vermin disease animals subhuman swamp thieves parasites cockroaches plague infest infested breed breeding invaders rope gas deport exterminate hang cattle driven lazy stupid dirty crawled smell ungeziefer abschaum untermenschen pack vermine racaille parasites chasse plaga escoria alimañas ratas echarlos feccia parassiti pragas escória ongedierte uitschot".split()
_LEXICON = {w: k for k, ws in (("c", CONTEMPT), ("s", SEXUAL), ("i", INSULTS)) for w in ws}
_LEXSETS = {"i": frozenset(INSULTS), "s": frozenset(SEXUAL), "c": frozenset(CONTEMPT)}
SECOND = frozenset("you your yours yourself u ya du dich dir dein deine deinen euch ihr tu te toi ton ta tes vous votre vos t tú ti tuyo usted eres sos tua tuo tuoi sei voi vostro você vocês teu seu te je jij jou jouw jullie".split())
_PEOPLE = frozenset("they them people those all alle tous todos tutti allemaal".split())
# Letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "£": "l", "¡": "i", "ß": "sß"}
MASK = "*#_•"
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_][ .\-_·/]){2,}[^\W_](?![^\W_])")
_TOKEN = re.compile(r"[^\s,;:\"“”«»()]+")
_REPEAT = re.compile(r"([^\W\d_])\1{2,}", re.I)
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'»”)]*\s+(?=[^\s])|\n\s*\n")
ORDER = 6


def word_grams(word: str, order: int = ORDER) -> list[str]:
    """The n-grams of a word up to an order; ^ and $ bound it, and none ends with ^."""
    s = "^" + word + "$"
    return [s[i - k : i + 1] for i in range(1, len(s)) for k in range(min(order, i + 1))]


class GramCounts:
    """Counts of n-grams in a table of a fixed size (two rows of hashed cells, the lesser counts): what the driver holds does
    not grow with the words of the corpus. A count is never too small; it is too large only where both cells collide."""

    BITS = 21

    def __init__(self, cells: np.ndarray | None = None):
        self.cells = np.zeros(2 << self.BITS, np.float32) if cells is None else cells

    @classmethod
    def places(cls, gram: str) -> tuple[int, int]:
        h = xxhash.xxh64_intdigest(gram)
        size = 1 << cls.BITS
        return h & (size - 1), size + ((h >> 32) & (size - 1))

    def get(self, gram: str) -> float:
        a, b = self.places(gram)
        return float(min(self.cells[a], self.cells[b]))


class CharModel:
    """Character n-grams of words with stupid back-off; ^ and $ bound a word."""

    def __init__(self, words: dict[str, float], order: int = ORDER, counts: GramCounts | None = None, scale: float = 1.0):
        """counts: of n-grams besides those of the words, each taken times scale."""
        self.order, self.counts, self.scale = order, counts, scale
        grams: dict[str, float] = defaultdict(float)
        for w, n in words.items():
            for g in word_grams(w, order):
                grams[g] += n
                grams[g[:-1] + "\0"] += n
        self.grams = dict(grams)
        self.memo: dict[str, tuple[str, float]] = {}

    def count(self, gram: str) -> float:
        n = self.grams.get(gram, 0.0)
        return n + self.counts.get(gram) * self.scale if self.counts is not None else n

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}}

    def decode(self, span: str) -> tuple[str, float]:
        """The likeliest reading of a span; readings are remembered."""
        if (got := self.memo.get(span)) is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            got = self.memo[span] = decode_span(span, self)
        return got

    def logp(self, context: str, c: str) -> float:
        penalty = 0.0
        for k in range(min(self.order - 1, len(context)), -1, -1):
            ctx = context[len(context) - k :]
            if (n := self.count(ctx + c)) and (m := self.count(ctx + "\0")):
                return math.log(n / m) + penalty
            penalty -= 1.6
        return -12.0 + penalty


def lattice(span: str) -> list[list[tuple[str, float]]]:
    """For each place the strings it may stand for, with log-probabilities. A separator is nothing or a word's end."""
    out: list[list[tuple[str, float]]] = []
    low = span.lower()
    spaced = bool(_SPACED.fullmatch(span))
    i = 0
    while i < len(low):
        c = low[i]
        j = i
        while j < len(low) and low[j] == c:
            j += 1
        if c.isalpha():
            if j - i >= 3:
                out.append([(c, -0.2), (c + c, -1.8)])
                i = j
                continue
            out.append([(c, 0.0)])
        elif spaced and c in " .-_·/":
            out.append([("", -0.1), ("$^", -2.5)])
        elif c in MASK:
            out.append([(x, -0.3) for x in "abcdefghijklmnopqrstuvwxyzáéíóúàèâêîôûäöüßçñãõ"])
        elif c in LEET:
            if j - i >= 3 and c.isdigit():
                out.append([(c, -9.0)])
            else:
                out.append([(x, -0.7) for x in LEET[c]] + [(c, -9.0)])
        elif c in " .-_·/'’":
            out.append([("$^", -1.0), ("", -2.0)])
        else:
            out.append([(c, -6.0)])
        i += 1
    return out


def decode_span(span: str, model: CharModel, beam: int = 64) -> tuple[str, float]:
    """The likeliest reading of a span and its log-probability per character."""
    paths: dict[str, tuple[float, str]] = {"^": (0.0, "")}
    keep = model.order - 1
    for options in lattice(span):
        new: dict[str, tuple[float, str]] = {}
        for ctx, (lp, text) in paths.items():
            for s, cost in options:
                q, c2 = lp + cost, ctx
                if s == "$^":
                    q += model.logp(c2, "$")
                    c2, t2 = "^", text + " "
                else:
                    for ch in s:
                        q += model.logp(c2, ch)
                        c2 = (c2 + ch)[-keep:]
                    t2 = text + s
                if c2 not in new or q > new[c2][0]:
                    new[c2] = (q, t2)
        paths = dict(sorted(new.items(), key=lambda x: -x[1][0])[:beam])
    best = max(((lp + model.logp(ctx, "$"), t) for ctx, (lp, t) in paths.items()), key=lambda x: x[0])
    return best[1], best[0] / max(len(best[1]), 1)


_SIGN = re.compile("[" + re.escape("".join(LEET) + MASK) + "]")


@lru_cache(maxsize=1 << 18)
def _suspect(tok: str) -> bool:
    core = tok.strip(".!?…'’-")
    letters = sum(c.isalpha() for c in core)
    if _REPEAT.search(core) and letters == len(core):
        return True
    signs = sum(c in LEET or c in MASK for c in core if not c.isalpha())
    if not signs or len(core) < 3 and not letters:
        return False
    if core.isdigit() or re.fullmatch(r"[\d.,:/%-]+[a-z]{0,3}|#\w+|\w+@\w.*|https?:.*|[$€£]\d[\d.,]*|\d+\$", core, re.I):
        return False
    return letters >= 1 and bool(re.fullmatch(r"[\w$@!*#+|€-]+", core)) and (letters + signs) >= len(core) - 1 and not re.fullmatch(r"[A-Z]{1,3}-?\d[\w-]*|[\w-]*\d{4,}[\w-]*|#+|\*+\w+\*+|_+\w+_+", core)


def restore(sentence: str, model: CharModel, least: float = -3.2) -> str:
    """The sentence with its disguised spans decoded; a span without a likely reading stays as it is."""

    def spaced(m: re.Match) -> str:
        text, lp = model.decode(m[0])
        return text if lp >= least else m[0]

    def token(m: re.Match) -> str:
        if not repeats and m[0].isalpha() or not _suspect(m[0]):
            return m[0]
        lead = re.match(r"[.?…'’-]*", m[0])[0]
        tail = re.search(r"[.!?…'’-]*$", m[0])[0] if not re.search(r"[a-z]!+[a-z]", m[0]) else ""
        core = m[0][len(lead) : len(m[0]) - len(tail)] if tail else m[0][len(lead) :]
        if not core:
            return m[0]
        text, lp = model.decode(core)
        # Letters written three times and more occur in names too: only a clear reading counts.
        sure = -2.0 if core.isalpha() else least
        return lead + text + tail if lp >= sure else m[0]

    if _SPACED.search(sentence):
        sentence = _SPACED.sub(spaced, sentence)
    # Letters alone hide nothing unless one is repeated.
    repeats = bool(_REPEAT.search(sentence))
    return _TOKEN.sub(token, sentence) if repeats or _SIGN.search(sentence) else sentence


def sentences(text: str) -> list[str]:
    return [s for x in _SENTENCE.split(text) if (s := re.sub(r"\s+", " ", x).strip())]


@lru_cache(maxsize=1 << 18)
def _of_word(w: str) -> tuple[int, tuple[int, ...], str, bool]:
    """Of a word: its bucket, those of its letter runs, its kinds in the lexicon, and whether it addresses somebody."""
    runs = tuple(bucket("c " + w[i : i + 4], BITS) for i in range(len(w) - 3)) if len(w) > 4 else ()
    return bucket("w " + w, BITS), runs, "".join(k for k, s in _LEXSETS.items() if w in s), w in SECOND


_pairs: dict[tuple[str, str], int] = {}


def _of_pair(a: str, b: str) -> int:
    if (k := _pairs.get((a, b))) is None:
        if len(_pairs) > 1_000_000:
            _pairs.clear()
        k = _pairs[a, b] = bucket(f"p {a} {b}", BITS)
    return k


def packed(told: list[list[str]], groups: frozenset[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed rows of sentences given as words: words, word pairs and letter runs, marks of address, group names and lexicon
    words, hashed. A row has length one; what a sentence repeats counts once, so that repetition does not add up."""
    idx: list[int] = []
    val: list[float] = []
    starts = [0]
    for words in told:
        named = not groups.isdisjoint(words)
        marked = ["@g" if w in groups else w for w in words] if named else words
        own = [_of_word(w) for w in dict.fromkeys(marked)]
        pairs = [_of_pair(a, b) for a, b in dict.fromkeys(zip(["^", *marked], [*marked, "$"]))]
        runs: list[int] = []
        for x in own:
            runs += x[1]
        told_of = [_of_word(w) for w in words]
        listed = "".join([x[2] for x in told_of])
        second = any([x[3] for x in told_of])
        extra: list[tuple[str, float]] = [("you", 1.0)] if second else []
        for k in set(listed):
            extra += [("lex " + k, 2.0)] + [(f"lex2 {k}", 2.0)] * (listed.count(k) > 1) + [(f"you+{k}", 2.0)] * second + [(f"group+{k}", 1.0)] * named
        extra += [("group", 3.0)] * named
        norm = math.sqrt(len(own) + 0.49 * len(pairs) + 0.0625 * len(runs) + sum([v * v for _, v in extra])) or 1.0
        idx += [x[0] for x in own] + pairs + runs + [bucket(k, BITS) for k, _ in extra]
        val += [1 / norm] * len(own) + [0.7 / norm] * len(pairs) + [0.25 / norm] * len(runs) + [v / norm for _, v in extra]
        starts.append(len(idx))
    return np.array(idx, np.int64), np.array(val), np.array(starts, np.int64)


def _low(sentence: str) -> list[str]:
    return [w.lower() for w in WORD.findall(sentence)]


def _group_names(positive: list[str], clean: Counter) -> frozenset[str]:
    """Names of groups of people: capitalised inside toxic sentences of several wordings, and rarer in clean lines."""
    around: dict[str, set[str]] = defaultdict(set)
    count: Counter = Counter()
    inside: set[str] = set()
    for s in positive:
        words = WORD.findall(s)
        for i, w in enumerate(words):
            if w[0].isupper() and not w.isupper():
                k = w.lower()
                count[k] += 1
                around[k].add((words[i - 1] if i else "^") + " _ " + (words[i + 1] if i + 1 < len(words) else "$"))
                if i:
                    inside.add(k)
    out = {w for w, ctx in around.items() if w in inside and len(ctx) >= 3 and count[w] >= 2 * clean[w] and w not in _LEXICON and not any(w in f for f in FUNCTION_SETS.values())}
    return frozenset(out)


class Detector:
    """The fitted parts: language model, group names, classifier."""

    def __init__(self, model: CharModel, groups: frozenset[str], linear: Linear, threshold: float):
        self.model, self.groups, self.linear, self.threshold = model, groups, linear, threshold

    def score(self, text: str) -> dict[str, float]:
        """The highest probability of each category over the sentences."""
        best = dict.fromkeys(CATEGORIES, 0.0)
        told = [w for s in sentences(text) if (w := _low(restore(s, self.model)))]
        if not told:
            return best
        probs = self.linear.probabilities(packed(told, self.groups))
        for words, p in zip(told, probs):
            named = not self.groups.isdisjoint(words)
            if named or any(w in _LEXICON for w in words):
                p = p * [1.0, EVIDENCE_ODDS, EVIDENCE_ODDS]
                p = p / p.sum()
            toxic = "hateful" if named or self._about_group(words) else "abusive"
            best[toxic] = max(best[toxic], float(p[1]))
            best["sexual"] = max(best["sexual"], float(p[2]))
        return best

    @staticmethod
    def _about_group(words: list[str]) -> bool:
        return SECOND.isdisjoint(words) and not _LEXSETS["c"].isdisjoint(words) and not _PEOPLE.isdisjoint(words)


def fit(lines: list[tuple[str, str]], vocabulary: dict[str, float], background: list[str] | None = None, rounds: int = 4, threshold: float = 0.5, grams: GramCounts | None = None) -> Detector:
    """Train on (label, text) lines. A toxic line is one of several sentences: the likeliest one is its positive.
    Sentences of the unlabelled background texts that hold no word of the lists and no group's name are taken as clean.
    grams: counts of the character n-grams of the corpus's words, beside or instead of the vocabulary."""
    vocab: Counter = Counter()
    total = max(sum(vocabulary.values()) + (grams.get("$") if grams else 0.0), 1.0)  # every word ends once
    for w, n in vocabulary.items():
        vocab[w] += n / total * 2000
    per: dict[str, Counter] = {"clean": Counter(), "toxic": Counter(), "nsfw": Counter()}
    for label, text in lines:
        kind = label.replace("__label__", "")
        if kind in per and text:
            per[kind].update({w.lower() for w in WORD.findall(text)})
    known = {w: n for k in per for w, n in per[k].items()}
    for w in known:
        bad, good = per["toxic"][w] + per["nsfw"][w], per["clean"][w]
        # The channel's prior: words that lines of such content hold are the ones disguised.
        vocab[w] += 4 * bad if bad > 2 * good and len(w) > 2 else 0.2
    for w in _LEXICON:
        vocab[w] += 12
    for w in "a i y o".split():
        vocab[w] += 20
    model = CharModel(vocab, counts=grams, scale=2000 / total)
    rows: list[tuple[int, int, str]] = []
    for n, (label, text) in enumerate(lines):
        kind = {"clean": 0, "toxic": 1, "nsfw": 2}.get((label or "").replace("__label__", ""))
        if kind is not None and text:
            rows += [(n, kind, restore(s, model)) for s in sentences(text)]
    n_lines = Counter(k for _, k, _ in rows)
    odds: dict[int, Counter] = {1: Counter(), 2: Counter()}
    seen: dict[int, Counter] = {k: Counter() for k in (0, 1, 2)}
    for _, k, s in rows:
        seen[k].update({w.lower() for w in WORD.findall(s)})
    for k in (1, 2):
        for w, c in seen[k].items():
            odds[k][w] = math.log((c + 0.5) / (n_lines[k] + 1)) - math.log((seen[0][w] + 0.5) / (n_lines[0] + 1))
    value = {i: sum(max(-0.5, odds[k][w.lower()]) for w in WORD.findall(s)) / (2 + len(WORD.findall(s))) if k else 0.0 for i, (_, k, s) in enumerate(rows)}
    groups: frozenset[str] = frozenset()
    linear = Linear(3, BITS)
    clean_words = Counter()
    for _, k, s in rows:
        if k == 0:
            clean_words.update({w.lower() for w in WORD.findall(s)})
    extra = [restore(x, model) for t in background or [] for x in sentences(t)]
    extra = [x for x in extra if not any(w.lower() in _LEXICON for w in WORD.findall(x))]
    for _ in range(rounds):
        best: dict[int, int] = {}
        for i, (n, k, _) in enumerate(rows):
            if k and (n not in best or value[i] > value[best[n]]):
                best[n] = i
        chosen = set(best.values())
        groups = _group_names([rows[i][2] for i in chosen if rows[i][1] == 1], clean_words)
        quiet = [x for x in extra if not any(w.lower() in groups for w in WORD.findall(x))]
        y = np.zeros((len(rows) + len(quiet), 3))
        y[len(rows) :, 0] = 1
        for i, (_, k, _) in enumerate(rows):
            y[i, k if i in chosen else 0] = 1
        weight = np.array([3.0 if i in chosen else 1.0 if k == 0 else 0.5 for i, (_, k, _) in enumerate(rows)] + [0.5] * len(quiet))
        data = packed([_low(s) for s in [*(s for _, _, s in rows), *quiet]], groups)
        linear = Linear(3, BITS).fit(data, y, weight, epochs=6, rate=0.3, decay=1e-4)
        probs = linear.probabilities(data)
        value = {i: float(probs[i, k]) if k else 0.0 for i, (_, k, _) in enumerate(rows)}
    return Detector(model, groups, linear, threshold)


def corpus_grams(df: DataFrame, text_col: str = "text", spread_rows: bool = True) -> GramCounts:
    """Counts of the character n-grams of all words of all rows and of their contexts, with partial sums in each batch. At most
    as many rows as the table has cells come to the driver, 48 MB."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        words: Counter = Counter()
        for t in cols["text"]:
            if t:
                words.update(WORD.findall(t.lower()))
        c: Counter = Counter()
        for w, n in words.items():
            for g in word_grams(w):
                c[g] += n
                c[g[:-1] + "\0"] += n
        k = np.array([GramCounts.places(g) for g in c], np.int64).reshape(-1, 2)
        cells, inv = np.unique(k, return_inverse=True)
        n = np.bincount(inv.ravel(), np.repeat(np.array(list(c.values()), float), 2), len(cells))
        return {"k": cells, "n": n.astype(np.int64)}

    base = df.select(F.col(text_col).alias("text"))
    got = map_arrow(spread(base) if spread_rows else base, run, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = GramCounts()
    out.cells[got["k"].to_numpy()] = got["n"].to_numpy()
    return out


def abuse_scores(df: DataFrame, labelled: DataFrame, id_col: str = "record_id", text_col: str = "text", threshold: float = 0.5, max_labelled: int = 20000, max_background: int = 600, spread_rows: bool = True) -> DataFrame:
    """One row per record: its probability of abusive, hateful and sexual content, the highest of them as `score`, and
    the categories at or over the threshold.

    Null, blank or empty texts score 0; null ids are kept; repeated rows give repeated rows; extra columns are ignored;
    an empty table gives no rows. The classifier is fitted on at most `max_labelled` labelled rows (chosen by hash) and, as
    certain negatives, the sentences of `max_background` texts chosen by hash; the n-grams of words are counted over all texts.
    """
    told = bounded_sample(labelled.select("line_id", "label", "text").filter("label is not null and text is not null"), max_labelled, "line_id")
    lines = [(r["label"], r["text"]) for r in sorted(told.collect(), key=lambda r: (r["line_id"] is None, r["line_id"] or 0))]
    text = F.col(text_col)
    chosen = bounded_sample(df.select(F.col(id_col).alias("id"), text.alias("text")).filter(text.isNotNull()), max_background, "id")
    det = fit(lines, {}, [r["text"] for r in chosen.collect()], threshold=threshold, grams=corpus_grams(df, text_col, spread_rows))

    def run(cols: dict[str, list]) -> dict[str, list]:
        got = [det.score(t or "") for t in cols["text"]]
        out: dict[str, list] = {"record_id": cols["record_id"], "source": cols["source"]}
        for k in CATEGORIES:
            out[k] = [g[k] for g in got]
        out["score"] = [max(g.values()) for g in got]
        out["categories"] = [[k for k in CATEGORIES if g[k] >= threshold] for g in got]
        return out

    source = F.col("source") if "source" in df.columns else F.lit(None).cast("string").alias("source")
    base = df.select(F.col(id_col).alias("record_id"), F.col(text_col).alias("text"), source)
    return map_arrow(spread(base) if spread_rows else base, run, "record_id bigint, source string, abusive double, hateful double, sexual double, score double, categories array<string>")


def abuse_rates(scores: DataFrame) -> DataFrame:
    """Per source (null sources form one group): records, records with any category, and the rate of each."""
    rate = lambda k: F.round(F.avg(F.array_contains("categories", k).cast("int")), 6).alias(f"{k}_rate")
    return scores.groupBy("source").agg(F.count("*").alias("n_records"), F.sum((F.size("categories") > 0).cast("int")).alias("n_flagged"), *map(rate, CATEGORIES))
