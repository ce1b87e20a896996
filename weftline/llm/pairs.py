"""Problem 6: broken prompt and response pairs.

Method: a multi-label linear classifier on hashed n-grams and pair features. It is trained on pairs of the table and on
defects made from them: responses cut off, prompts copied, responses swapped for ones of another language, refusals
composed from phrases, and blanks. Thresholds are calibrated on a held-out part. Two of the pair features are themselves
learned: the language of either side, and the probability that a sentence declines.
"""

from __future__ import annotations

import pickle
import random
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import FUNCTION_SETS, LANGS, WORD, bounded_sample, map_arrow, spread
from weftline.llm.linear import Linear
from weftline.operators.common import discard, shuffles_dropped, stored

DEFECTS = ("empty", "truncated", "refusal", "copy", "other_language")
BITS = 16
#: How much a made defect counts beside a sound pair when thresholds are calibrated.
RARITY = 0.1
_TAGS = re.compile(r"</?(?:answer|think|response|output|result)>", re.I)
_ROLE = re.compile(r"(?:###\s*Instruction:|(?:^|\n)\s*(?:User|Human|Question|Q):)\s*(.*?)\s*(?:###\s*Response:|\n\s*(?:Assistant|AI|Answer|A):|\Z)", re.S | re.I)
_LISTED = re.compile(r"\s*(?:[-*•–]|\d{1,3}[.)])\s")
_TERMINAL = re.compile(r"(?:[.!?…。]|\.\.\.)[\"'»”’)\]*_]*\s*$")
_CLOSED = re.compile(r"(?:\\\]|\$|</\w+>|```|\d%?|[)}\]])\s*$")
_ANYFW = frozenset().union(*FUNCTION_SETS.values())
_BLANK = re.compile(r"[\s​-‏⁠﻿­ㅤ.…_*`~\"'-]+")

# Names of languages as prompts give them.
_NAMES = {
    "en": "english|englisch|anglais|inglés|ingles|inglese|inglês|engels", "de": "german|deutsch|allemand|alemán|tedesco|alemão|duits",
    "fr": "french|französisch|français|francés|francese|francês|frans", "es": "spanish|spanisch|espagnol|español|spagnolo|espanhol|spaans",
    "it": "italian|italienisch|italien|italiano|italiaans", "pt": "portuguese|portugiesisch|portugais|portugués|portoghese|português|portugees",
    "nl": "dutch|niederländisch|néerlandais|neerlandés|olandese|holandês|nederlands",
}
_ASKED = {k: re.compile(rf"\b(?:in|into|auf|ins|en|au|al|em|naar|het|lo|to)\s+(?:el |le |la |het |das )?(?:{v})\b", re.I) for k, v in _NAMES.items()}

# The parts from which refusals are composed, by language: openings; what declines, in frames of {v} (an
# action) and {o} (its object); actions; objects; closings.
_REFUSE = {
    "en": (
        "I'm sorry, but|Sorry, but|Sorry,|I apologise, but|I apologize, however|Apologies,|Unfortunately,|Regrettably,|I regret that|As an assistant,|As a language model,|As an AI,|Thank you for asking; still,|Thanks, but|I understand, but|Hmm,|I'm afraid|After some thought,|||||",
        "I can't {v} {o}.|I cannot {v} {o}.|I can not {v} {o}.|I won't {v} {o}.|I will not {v} {o}.|I won't be able to {v} {o}.|I am unable to {v} {o}.|I'm unable to {v} {o} here.|I am not able to {v} {o}.|I'm not able to {v} {o} for you.|I am not allowed to {v} {o}.|I'm not permitted to {v} {o}.|I would rather not {v} {o}.|I'd rather not {v} {o}.|I'd prefer not to {v} {o}.|I prefer not to {v} {o}.|I must decline to {v} {o}.|I have to decline {o}.|I decline to {v} {o}.|I refuse to {v} {o}.|I don't feel comfortable with {o}.|I am not comfortable enough to {v} {o}.|I am not in a position to {v} {o}.|I don't have the ability to {v} {o}.|I lack the means to {v} {o}.|I have to pass on {o}.|I must leave {o} unanswered.|I do not wish to {v} {o}.|we are unable to {v} {o}.|we cannot {v} {o}.|that is something I can't {v}.|this is not something I will {v}.|that is not something I can {v}.|it is not possible for me to {v} {o}.|it would not be right for me to {v} {o}.|it would not be appropriate to {v} {o}.|it would be wrong of me to {v} {o}.|there is no way for me to {v} {o}.|it is against my rules to {v} {o}.|my guidelines do not allow me to {v} {o}.|my rules forbid me to {v} {o}.|my instructions prevent me from answering {o}.|{o} falls outside what I may {v}.|{o} is beyond what I am allowed to {v}.|{o} lies outside my abilities.|{o} goes beyond my scope.|no answer can be given here.|no answer to {o} will be provided.|no response can be offered by this assistant.|no help with {o} is available from this assistant.|this assistant cannot {v} {o}.|this assistant is unable to {v} {o}.|the assistant declines to {v} {o}.|the system is not able to {v} {o}.|{o} cannot be answered here.|{o} has been declined.|{o} must remain unanswered.|an answer is not something I can {v}.|I cannot comply.|I must decline.|I can't go into {o}.|I can't do that.",
        "help with|assist with|answer|respond to|reply to|solve|provide an answer to|give a solution to|work on|do|do this for|discuss|talk about|comment on|comply with|complete|carry out|go into|handle|give advice on|say anything about|offer|provide",
        "that|this|it|this question|that question|this request|your request|your question|this task|this topic|this one|this matter|this kind of problem|questions like this|such questions|problems of this kind|calculations of this kind|what you ask|the thing you ask for|anything of the sort",
        "||||Kind regards.|I can tell you about something else instead.|Is there anything else?|Please ask me something different.|Perhaps try another topic?|Please ask an expert.|Please consult a teacher.|Please turn to a qualified person.|Let me know if there is anything else.|Have a nice day!|Is there something else you would like to talk about?",
    ),
    "de": (
        "Es tut mir leid,|Leider|Entschuldigung, aber|Als Assistent|Tut mir leid, aber||",
        "{o} kann ich nicht {v}.|{o} darf ich nicht {v}.|ich kann {o} nicht {v}.|ich möchte {o} nicht {v}.|ich bin nicht in der Lage, {o} zu {v}.|es ist mir nicht möglich, {o} zu {v}.|ich muss ablehnen, {o} zu {v}.|dabei kann ich nicht helfen.|dazu kann ich nichts sagen.|ich weigere mich, {o} zu {v}.|eine Antwort ist hier nicht möglich.",
        "beantworten|bearbeiten|besprechen|erfüllen|lösen|erledigen", "das|diese Frage|diese Anfrage|diese Bitte|Ihre Frage|deine Anfrage|diese Aufgabe", "|||Bitte fragen Sie eine Fachperson.|Kann ich sonst etwas tun?",
    ),
    "fr": (
        "Je suis désolé, mais|Je suis désolé,|Désolé, mais|Malheureusement,|En tant qu'assistant,||",
        "je ne peux pas {v} {o}.|je ne suis pas en mesure de {v} {o}.|il m'est impossible de {v} {o}.|je dois refuser de {v} {o}.|je refuse de {v} {o}.|je préfère ne pas {v} {o}.|je ne suis pas autorisé à {v} {o}.|je ne peux pas vous aider.|aucune réponse ne peut être donnée ici.",
        "répondre à|traiter|aborder|discuter de|donner suite à", "cette question|cette demande|votre demande|ce sujet|cela|votre question", "|||Veuillez consulter un spécialiste.|Puis-je faire autre chose ?",
    ),
    "es": (
        "Lo siento, pero|Lo siento,|Lamentablemente,|Como asistente,|Disculpe, pero||",
        "no puedo {v} {o}.|no me es posible {v} {o}.|no soy capaz de {v} {o}.|debo negarme a {v} {o}.|prefiero no {v} {o}.|no tengo permiso para {v} {o}.|no estoy en condiciones de {v} {o}.|no puedo ayudar con eso.|aquí no se puede dar ninguna respuesta.",
        "responder a|contestar|tratar|atender|resolver", "esta pregunta|esta petición|su solicitud|este tema|eso|esa pregunta", "|||Consulte a un experto.|¿Puedo ayudar en otra cosa?",
    ),
    "it": (
        "Mi dispiace, ma|Mi dispiace,|Purtroppo|Come assistente,|Spiacente, ma||",
        "non posso {v} {o}.|non mi è possibile {v} {o}.|non sono in grado di {v} {o}.|devo rifiutare di {v} {o}.|preferisco non {v} {o}.|non sono autorizzato a {v} {o}.|non posso aiutarti con questo.|qui non è possibile dare una risposta.",
        "rispondere a|trattare|affrontare|risolvere|soddisfare", "questa domanda|questa richiesta|la tua richiesta|questo argomento|ciò", "|||Si rivolga a un esperto.|Posso fare altro?",
    ),
    "pt": (
        "Sinto muito, mas|Desculpe, mas|Infelizmente,|Como assistente,|Lamento, mas||",
        "não posso {v} {o}.|não me é possível {v} {o}.|não sou capaz de {v} {o}.|devo recusar {v} {o}.|prefiro não {v} {o}.|não tenho permissão para {v} {o}.|não posso ajudar com isso.|aqui não é possível dar uma resposta.",
        "responder a|tratar de|atender|resolver|discutir", "esta pergunta|este pedido|a sua solicitação|este assunto|isso", "|||Consulte um especialista.|Posso ajudar em outra coisa?",
    ),
    "nl": (
        "Het spijt me, maar|Helaas|Sorry, maar|Als assistent|",
        "{o} kan ik niet {v}.|{o} mag ik niet {v}.|ik kan {o} niet {v}.|ik wil {o} liever niet {v}.|ik ben niet in staat {o} te {v}.|het is mij niet mogelijk {o} te {v}.|ik moet weigeren {o} te {v}.|ik kan je daar niet mee helpen.|hier kan geen antwoord worden gegeven.",
        "beantwoorden|behandelen|bespreken|oplossen|uitvoeren", "deze vraag|dit verzoek|dat|dit onderwerp|je vraag", "|||Vraag het aan een deskundige.|Kan ik iets anders doen?",
    ),
}
_PARTS = {k: tuple(x.split("|") for x in v) for k, v in _REFUSE.items()}
_LEAD = ["", "", "", "", "That is an interesting question. ", "Thanks for your message. ", "You raise a good point. "]
_DANGLING = ["", "", "", "", "", "", "...", "…", "-", ":", ",", ", which", " because", " and then the", " (see the", ", so that we", " <ans", " \\frac{7", " of the", ", and", " und", " et", " y", " que la"]
_ASK = {"en": "English", "de": "German", "fr": "French", "es": "Spanish", "it": "Italian", "pt": "Portuguese", "nl": "Dutch"}
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|\d+|\\[a-zA-Z]+")
_REFUSAL_ASKED = re.compile(r"\b(?:refus|declin|reject|turn(?:ing)? down|ablehn|absage|rechaz|rifiut|recus|weiger|apolog|sorry)", re.I)
_SIZE = 1 << BITS


def question_of(prompt: str) -> str:
    """What a prompt asks, without a template around it: between role marks, else its last paragraph."""
    if m := _ROLE.search(prompt):
        if m[1].strip():
            return m[1].strip()
    parts = [p.strip() for p in re.split(r"\n\s*\n", prompt.strip()) if p.strip()]
    return parts[-1] if parts else ""


def content_of(response: str | None) -> str:
    """A response without answer tags and outer white space."""
    return _TAGS.sub(" ", response or "").strip()


def sentences(text: str) -> list[str]:
    return [s for x in re.split(r"(?<=[.!?…])\s+|\n+", text) if (s := x.strip())]


def blank(response: str | None) -> bool:
    return not _BLANK.sub("", unicodedata.normalize("NFKC", content_of(response)))


def told_language(text: str) -> str | None:
    """The language of most function words; None where fewer than two tell, or two languages tie."""
    low = [w.lower() for w in WORD.findall(text)]
    hits = {k: sum(w in fs for w in low) for k, fs in FUNCTION_SETS.items()}
    (a, n), (_, m) = sorted(hits.items(), key=lambda x: (-x[1], x[0]))[:2]
    return a if n >= 2 and n > m else None


class Tongues:
    """Log-probabilities of words and letter runs by language, counted over sentences whose function words tell it."""

    @staticmethod
    def counts(texts: Iterable[str]) -> dict[str, Counter]:
        """The words of sentences by the language told."""
        words: dict[str, Counter] = {k: Counter() for k in LANGS}
        for t in texts:
            for s in sentences(t):
                if k := told_language(s):
                    words[k].update(w.lower() for w in WORD.findall(s))
        return words

    def __init__(self, texts: Iterable[str] = (), counted: dict[str, Counter] | None = None):
        words = {k: Counter(dict.fromkeys(FUNCTION_SETS[k], 20)) for k in LANGS}
        for k, c in (counted if counted is not None else self.counts(texts)).items():
            words[k].update(c)
        runs = {k: Counter() for k in LANGS}
        for k in LANGS:
            for w, n in words[k].items():
                for g in self._runs(w):
                    runs[k][g] += n**0.5
        self.words, self.runs = words, runs
        self.n_words = np.array([sum(words[k].values()) for k in LANGS], float)
        self.n_runs = np.array([sum(runs[k].values()) for k in LANGS], float) + 1
        self.cache: dict[str, np.ndarray] = {}
        self.texts: dict[str, tuple[str | None, float]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}, "texts": {}}

    @staticmethod
    def _runs(word: str) -> list[str]:
        s = f"^{word}$"
        return [s[i : i + 3] for i in range(len(s) - 2)]

    def word(self, w: str) -> np.ndarray:
        """How much more a word speaks for each language than for the mean of all, within 3."""
        if (got := self.cache.get(w)) is None:
            n = np.array([self.words[k][w] for k in LANGS], float)
            if n.any():
                v = np.log((n + 0.3) / (self.n_words + 3000))
            else:
                v = np.mean([np.log((np.array([self.runs[k][g] for k in LANGS]) + 0.3) / (self.n_runs + 300)) for g in self._runs(w)] or [np.zeros(len(LANGS))], 0) * 0.7
            if len(self.cache) > 500_000:
                self.cache.clear()
            got = self.cache[w] = np.clip(v - v.mean(), -3, 3)
        return got

    def told(self, words: list[str]) -> tuple[str | None, float]:
        """The language of some words and by how much it leads the next; None without words."""
        if not words:
            return None, 0.0
        v = np.sum([self.word(w) for w in words], 0)
        a, b = np.argsort(-v)[:2]
        return LANGS[a], float(v[a] - v[b])


    def told_text(self, text: str) -> tuple[str | None, float]:
        """The same of the words of a text; the last ones asked for are remembered."""
        if (got := self.texts.get(text)) is None:
            if len(self.texts) > 50_000:
                self.texts.clear()
            got = self.texts[text] = self.told([w for w in _words(text) if w[0] not in "\\#"])
        return got


class Endings:
    """How often each word ends a sentence or an item, counted over the training responses."""

    def __init__(self, responses: list[str]):
        self.all: Counter = Counter()
        self.end: Counter = Counter()
        for r in responses:
            for part in re.split(r"(?<=[.!?])\s+|\n+", r):
                words = [w.lower() for w in re.findall(r"[^\W_]+", part)]
                self.all.update(words)
                if words and (_TERMINAL.search(part) or "\n" in r):
                    self.end[words[-1]] += 1

    def rate(self, word: str) -> float:
        return (self.end[word] + 0.3) / (self.all[word] + 1.5)


class Knowledge:
    """What features are made with: languages, word endings, and the classifier of single sentences that decline."""

    def __init__(self, tongues: Tongues, endings: Endings, declines: Linear | None = None):
        self.tongues, self.endings, self.declines = tongues, endings, declines

    def most_declining(self, pairs: list[tuple[str | None, str | None]]) -> list[float]:
        """The highest probability that a sentence of each response declines; 0 where the prompt asks for a refusal."""
        per = [[] if _REFUSAL_ASKED.search(p or "") else [w for s in sentences(content_of(r)) if (w := _words(s))] for p, r in pairs]
        parts = [w for ws in per for w in ws]
        out = np.zeros(len(pairs))
        if self.declines and parts:
            np.maximum.at(out, np.repeat(np.arange(len(pairs)), [len(ws) for ws in per]), self.declines.probabilities(sentence_rows(parts))[:, 0])
        return out.tolist()


_codes: dict[str, int] = {}


def _code(name: str) -> int:
    """A 32-bit hash of a word or feature name, remembered."""
    h = _codes.get(name)
    if h is None:
        if len(_codes) > 1_000_000:
            _codes.clear()
        h = _codes[name] = xxhash.xxh32_intdigest(name)
    return h


def _words(text: str) -> list[str]:
    return ["#" if w[0].isdigit() else w for w in _TOKEN.findall(text.lower().replace("’", "'"))]


def _grams(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of the word pairs of concatenated texts; first: whether a word begins its text."""
    left = np.where(first, np.uint32(0x1F123BB5), np.concatenate([codes[:1], codes[:-1]]))
    pair = (left * np.uint32(0x9E3779B1)) ^ (codes * np.uint32(0x85EBCA6B))
    pair ^= pair >> np.uint32(15)
    return (codes & np.uint32(_SIZE - 1)).astype(np.int64), (pair & np.uint32(_SIZE - 1)).astype(np.int64)


def sentence_rows(parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed rows of the words and word pairs of single sentences, each of length one."""
    size = np.array([len(p) for p in parts], np.int64)
    codes = np.array([_code(w) for p in parts for w in p], np.uint32)
    first = np.zeros(len(codes), bool)
    first[(np.cumsum(size) - size)[size > 0]] = True
    one, two = _grams(codes, first) if len(codes) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    idx = np.stack([one, two], 1).ravel()
    starts = np.concatenate([[0], np.cumsum(2 * size)])
    return idx, np.repeat(1 / np.sqrt(2 * np.maximum(size, 1)), 2 * size), starts


def _pair_features(prompt: str, raw: str, low: list[str], parts: list[tuple[int, float]], know: Knowledge) -> dict[str, float]:
    """Named features of one pair with a response that is not blank. parts: words of each sentence and the
    probability that it declines."""
    out: dict[str, float] = {}

    def add(name: str, v: float = 1.0) -> None:
        out[name] = out.get(name, 0.0) + v

    q = question_of(prompt)
    # The end.
    stripped = raw.rstrip()
    lines = [x for x in stripped.split("\n") if x.strip()]
    last = lines[-1] if lines else ""
    listed = bool(_LISTED.match(last)) or (len(lines) > 1 and bool(_LISTED.match(lines[0])))
    trailed = bool(_TRAILED.search(stripped))
    ended, closed = bool(_TERMINAL.search(raw)) and not trailed, bool(_CLOSED.search(stripped))
    tail = re.findall(r"[^\W_]+", stripped[-200:])[-1:] or [""]
    t = tail[0].lower()
    rate = know.endings.rate(t)
    opened = sum(raw.count(a) - raw.count(b) for a, b in (("{", "}"), ("(", ")"), ("[", "]"))) > 0 or raw.count("$") % 2 == 1 or bool(re.search(r"<[^<>]{0,12}$|\\\w*$", stripped))
    mathy = len(re.findall(r"\d+", q)) >= 2
    short = len(low) <= 6
    add(f"end {'ended' if ended else 'closed' if closed else 'open'} {'list' if listed else 'text'} {'short' if short else 'long'}", 2.0)
    if not ended and not closed:
        add("end fw" if t in _ANYFW and (rate < 0.3) else "end word", 1.5)
        seen = know.endings.all[t] > 2
        add(f"end rate {min(4, int(rate * 10)) if seen else 'name' if tail[0][:1].isupper() else 'new'} {'list' if listed else 'text'}", 2.0)
        add(f"end known {seen}", 1.0)
        add("last " + t, 0.7)
        if trailed:
            add(f"end trailed {seen} {min(4, int(rate * 10))}", 3.0)
        if re.search(r"[,;:(\\<{-]$", stripped):
            add("end sign", 3.0)
    if opened:
        add("opened", 3.0)
    if mathy:
        result = bool(re.search(r"\d[^\w]*(?:</answer>)?[\s\].$}]*$", stripped)) or "boxed" in raw or stripped.endswith("</answer>")
        add(f"math result {result} {ended or closed} {'short' if short else 'long'}", 2.0)
    # Against the prompt.
    pw = [w.lower() for w in re.findall(r"[^\W_]+", prompt)]
    rw = re.findall(r"[^\W_]+", content_of(raw).lower())
    qset = set(pw)
    novel = [w for w in rw if w not in qset]
    tri = set(zip(pw, pw[1:], pw[2:]))
    n_tri = len(rw) - 2
    inside = sum(g in tri for g in zip(rw, rw[1:], rw[2:])) / n_tri if n_tri > 0 else float(bool(rw) and not novel and len(rw) > 1)
    cover = len(rw) / max(len(re.findall(r"[^\W_]+", q)), 1)
    fresh = any(w.isdigit() for w in novel)
    add(f"copied {min(10, int(inside * 10))}", 2.0)
    if pw and len(rw) >= 3 and inside >= 0.6:
        add(f"copy novel {min(6, len(novel))} cover {min(4, int(cover * 2))}", 3.0)
        add("copy fresh number" if fresh else "copy all" if len(novel) <= 3 and cover >= 0.5 and inside >= 0.8 else "copy part", 5.0)
    # Languages.
    plain = [w for w in low if w[0] not in "\\#"]
    lr, cr = know.tongues.told(plain)
    lq, cq = know.tongues.told_text(q)
    asked = {k for k, pat in _ASKED.items() if pat.search(q)}
    sure = min(cr / max(1.0, len(plain) ** 0.5), cq / 1.5)
    if lr and lq and not short:
        state = ("kept" if lr in asked else "missed") if asked else "same" if lr == lq else "other"
        add(f"lang {state} {min(5, int(sure))}", 4.0)
        add(f"lang {state}", 4.0)
    else:
        add("lang none", 1.0)
    # Sentences that decline.
    wanted = bool(_REFUSAL_ASKED.search(q))
    top = max((p for _, p in parts), default=0.0)
    said = sum(n for n, p in parts if p >= 0.5) / max(1, sum(n for n, _ in parts))
    add(f"declines {'asked' if wanted else ''} {int(top * 9.99)}", 5.0)
    if top >= 0.5:
        add(f"declining share {'asked' if wanted else ''} {int(said * 3.99)}", 2.0)
    if wanted:
        add("refusal asked", 3.0)
    add(f"length {min(6, len(low).bit_length())}", 1.0)
    return out


def featurise(pairs: list[tuple[str | None, str | None]], know: Knowledge) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed rows: hashed n-grams of the whole response (of length 2 together) and the pair features."""
    texts, own = [], []
    per: list[list[list[str]]] = []
    for i, (_, r) in enumerate(pairs):
        per.append([] if blank(r) else [w for s in sentences(content_of(r)) if (w := _words(s))])
    parts = [w for ws in per for w in ws]
    declines = know.declines.probabilities(sentence_rows(parts))[:, 0].tolist() if know.declines and parts else [0.0] * len(parts)
    low = [[w for ws in p for w in ws] for p in per]
    size = np.array([len(x) for x in low], np.int64)
    codes = np.array([_code(w) for x in low for w in x], np.uint32)
    row = np.repeat(np.arange(len(pairs)), size)
    start = np.cumsum(size) - size
    place = np.arange(len(codes)) - np.repeat(start, size)
    keys, weights = np.zeros(0, np.int64), np.zeros(0)
    if len(codes):
        one, two = _grams(codes, place == 0)
        late = 1.0 + (np.repeat(size, size) - place <= 20)  # the end counts twice
        keys, inv = np.unique(np.concatenate([row * _SIZE + one, row * _SIZE + two]), return_inverse=True)
        weights = np.bincount(inv, np.concatenate([late, late]))
        norm = np.sqrt(np.bincount(keys // _SIZE, weights**2, minlength=len(pairs)))
        weights = 2 * weights / norm[keys // _SIZE]
    idx: list[np.ndarray] = []
    val: list[np.ndarray] = []
    bounds = np.searchsorted(keys, np.arange(len(pairs) + 1) * _SIZE)
    starts = [0]
    at = 0
    for i, (p, r) in enumerate(pairs):
        n = len(per[i])
        if n == 0 and blank(r):
            named = {"blank": 6.0}
        else:
            named = _pair_features(p or "", r or "", low[i], [(len(w), d) for w, d in zip(per[i], declines[at : at + n])], know)
        at += n
        idx += [keys[bounds[i] : bounds[i + 1]] & (_SIZE - 1), np.array([_code("f " + k) & (_SIZE - 1) for k in named], np.int64)]
        val += [weights[bounds[i] : bounds[i + 1]], np.array(list(named.values()))]
        starts.append(starts[-1] + len(idx[-2]) + len(idx[-1]))
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return cat(idx, np.int64), cat(val, float), np.array(starts, np.int64)


def features(prompt: str | None, response: str | None, know: Knowledge) -> dict[int, float]:
    """The features of one pair."""
    idx, val, _ = featurise([(prompt, response)], know)
    out: dict[int, float] = {}
    for k, v in zip(idx.tolist(), val.tolist()):
        out[k] = out.get(k, 0.0) + v
    return out


def declining(rng: random.Random, lang: str) -> str:
    """A sentence that declines."""
    heads, frames, acts, objects, _ = _PARTS[lang]
    body = rng.choice(frames).replace("{v}", rng.choice(acts)).replace("{o}", rng.choice(objects))
    head = rng.choice(heads)
    s = f"{head} {body}" if head else body
    return s[0].upper() + s[1:]


def refusal(rng: random.Random, lang: str) -> str:
    k = lang if rng.random() < 0.4 else "en" if rng.random() < 0.7 else rng.choice(list(_PARTS))
    s = rng.choice(_LEAD) + declining(rng, k)
    for _ in range(rng.randrange(3)):
        s = f"{s} {rng.choice(_PARTS[k][4])}".strip()
    return f"<answer>{s}</answer>" if rng.random() < 0.2 else s


def cut_off(rng: random.Random, response: str) -> str | None:
    words = [m for m in re.finditer(r"\S+", response)]
    if len(words) < 6:
        return None
    for _ in range(6):
        m = words[rng.randrange(2, len(words) - 1)]
        end = m.end() if rng.random() < 0.7 else m.start() + max(1, rng.randrange(1, len(m[0]) + 1))
        s = response[:end].rstrip()
        if not re.search(r"[.!?>]$|\n$", s) and not (len(s) and "\n" in response[end : end + 1]):
            tail = rng.choice(_DANGLING)
            return s.rstrip(",;") + tail
    return None


def copied(rng: random.Random, prompt: str) -> str:
    q = question_of(prompt)
    s = q if rng.random() < 0.75 else prompt
    k = rng.randrange(9)
    if k == 0:
        s = s.lower()
    elif k == 1:
        s = f'"{s}"'
    elif k == 2:
        s = rng.choice(["You asked: ", "Question: ", "The question: ", "Your question was: ", "Prompt: "]) + s
    elif k == 3:
        s = s.rstrip(".?! \n")
    elif k == 4:
        s = re.sub(r" ", "  ", s)
    elif k == 5:
        s = f"<answer>{s}</answer>"
    elif k == 6:
        s = s.upper()
    elif k == 7:
        s = f"{s}\n{s}"
    return s


_RESULT = re.compile(r"</think>.*\Z|<answer>.*\Z|\\boxed\{.*\Z|\\\[.*\Z|\S*\d\S*\s*\Z", re.S)
_TRAILED = re.compile(r"\w\s?(?:\.\.\.|…)\s*\Z")
_BLANKS = ["", " ", "\n", "<answer></answer>", "</think> <answer> </answer>", "​", "<think>\n</think> <answer>\n</answer>", "...", "\t", None]


def swapped(rng: random.Random, question: str, response: str, other: str) -> str:
    """A response of another language in place of this one; where numbers are asked for, with the numbers of the
    question and the result of this one."""
    numbers = re.findall(r"\d+", question)
    if len(numbers) < 2:
        return other
    parts = sentences(other)
    at = rng.randrange(len(parts)) if parts else 0
    if parts and rng.random() < 0.7:
        parts[at] = re.sub(r"\.?$", f" {rng.choice(numbers)}.", parts[at])
    m = _RESULT.search(response)
    return " ".join(parts) + (" " + m[0] if m else "")


def synthesise(pairs: list[tuple[str | None, str | None]], seed: int = 11, tongues: Tongues | None = None) -> tuple[list[tuple[str | None, str | None]], np.ndarray]:
    """Training pairs and their labels (n, 5): the pairs that no plain sign speaks against, and defects made from them."""
    rng = random.Random(seed)
    tongues = tongues or Tongues(x for p in pairs for x in p if x)
    by: dict[str, list[str]] = {}
    sound: list[tuple[str, str, str]] = []
    for p, r in pairs:
        if not p or not p.strip() or blank(r):
            continue
        q = question_of(p)
        (lr, cr), (lq, cq) = tongues.told_text(content_of(r)), tongues.told_text(q)
        if lr and cr >= 8 and len(r) > 40 and not re.search(r"</think>|boxed", r):
            by.setdefault(lr, []).append(r)
        whole = _TERMINAL.search(r) and not _TRAILED.search(r) or _CLOSED.search(r.rstrip()) or _LISTED.match(r) or len(r) < 30
        alien = lr and lq and lr != lq and min(cr, cq) >= 3 and not any(x.search(p) for x in _ASKED.values())
        given = set(re.findall(r"[^\W_]+", p.lower()))
        novel = [w for w in re.findall(r"[^\W_]+", content_of(r).lower()) if w not in given]
        echo = len(novel) <= 3 and not any(w.isdigit() for w in novel) and len(_words(r)) >= 0.6 * len(_words(q)) > 2
        if whole and not alien and not echo:
            sound.append((p, r, lq or "en"))
    out: list[tuple[str | None, str | None]] = []
    labels: list[int] = []

    def put(p: str | None, r: str | None, k: int) -> None:
        out.append((p, r))
        labels.append(k)

    for k in range(40):
        put(sound[k % len(sound)][0] if sound else "?", _BLANKS[k % len(_BLANKS)], 0)
    for p, r, lang in sound:
        put(p, r, -1)
        x = rng.random()
        others = [k for k in by if k != lang]
        if x < 0.3 and (c := cut_off(rng, r)):
            put(p, c, 1)
        elif x < 0.5:
            said = refusal(rng, lang)
            if rng.random() < 0.25:  # after a lead-in, or in the middle of other sentences
                around = sentences(content_of(rng.choice(by.get(lang) or [r])))
                at = rng.randrange(len(around) + 1)
                said = " ".join([*around[:at], said, *around[at : at + rng.randrange(4)]])
            put(p if rng.random() < 0.9 else None, said, 2)
        elif x < 0.7:
            put(p, copied(rng, p), 3)
        elif x < 0.9 and others:
            k = rng.choice(others)
            other = rng.choice(by[k])
            put(p, swapped(rng, question_of(p), r, other), 4)
            if rng.random() < 0.1:
                put(f"{p.rstrip()} {rng.choice(['Answer in', 'Reply in', 'Translate into'])} {_ASK[k]}.", other, -1)
        # A question repeated before its answer is sound, and so is a short answer.
        if x > 0.9 and len(r) > 20:
            m = _RESULT.search(r)
            put(p, f"{question_of(p)}\n\n{m[0] if m and rng.random() < 0.5 else r}", -1)
            put(p, rng.choice(re.findall(r"[^\W_]+", r) or ["no"]), -1)
    y = np.zeros((len(out), len(DEFECTS)))
    for i, k in enumerate(labels):
        if k >= 0:
            y[i, k] = 1
    return out, y


class PairModel:
    def __init__(self, linear: Linear, endings: Knowledge, thresholds: list[float]):
        self.linear, self.endings, self.thresholds = linear, endings, thresholds

    def probabilities(self, pairs: list[tuple[str | None, str | None]]) -> np.ndarray:
        if not pairs:
            return np.zeros((0, len(DEFECTS)))
        return self.linear.probabilities(featurise(pairs, self.endings))

    def judge(self, pairs: list[tuple[str | None, str | None]]) -> list[tuple[str | None, float]]:
        """(defect or None, probability): of the labels over their thresholds the one that exceeds it by most, in odds."""
        got: list[tuple[str | None, float]] = []
        odds = lambda x: np.log(np.clip(x, 1e-9, 1 - 1e-9) / (1 - np.clip(x, 1e-9, 1 - 1e-9)))
        limit = odds(np.array(self.thresholds))
        for (prompt, _), p in zip(pairs, self.probabilities(pairs)):
            p = p.copy()
            if not prompt or not prompt.strip():
                p[3] = p[4] = 0.0
            over = odds(p) - limit
            k = int(over.argmax())
            got.append((DEFECTS[k], float(p[k])) if over[k] >= 0 else (None, float(p.max())))
        return got


def decline_model(rng: random.Random, pairs: list[tuple[str | None, str | None]], n: int = 3000, rounds: int = 3) -> Linear:
    """The classifier of single sentences: composed ones that decline against the distinct ones of the table. Some of those
    decline as well, which nobody has labelled: what a round finds likelier than a quarter no longer counts against. However many sentences there are, they weigh as 4 n at most."""
    told = [w for _ in range(n) for k in [rng.choice(["en", "en", *LANGS])] if (w := _words(declining(rng, k)))]
    found = sorted({" ".join(w) for p, r in pairs if not _REFUSAL_ASKED.search(p or "") for s in sentences(content_of(r)) if (w := _words(s))})
    rng.shuffle(found)
    sound = [x.split(" ") for x in found]
    asked = [w for p, r in pairs if _REFUSAL_ASKED.search(p or "") for s in sentences(content_of(r)) if (w := _words(s))]
    closing = [w for k in LANGS for s in _PARTS[k][4] + _LEAD if s for w in [_words(s)]] * 3 + asked
    doubt = 0.25
    model = Linear(1, BITS, multi=True)
    for _ in range(rounds):
        label = np.array([[1.0]] * len(told) + [[0.0]] * (len(sound) + len(closing)))
        weight = np.array([1.0] * len(told) + [min(50.0, max(1.0, n / max(len(sound), 1))) * min(1.0, 4 * n / max(len(sound), 1))] * len(sound) + [1.0] * len(closing))
        model = Linear(1, BITS, multi=True).fit(sentence_rows(told + sound + closing), label, weight, epochs=3, rate=0.3, decay=1e-5, batch=256)
        sound = [x for x, q in zip(sound, model.probabilities(sentence_rows(sound))[:, 0]) if q < doubt]
    return model


def fit(pairs: list[tuple[str | None, str | None]], seed: int = 11, rounds: int = 3) -> PairModel:
    """Train and calibrate, in rounds: pairs that a round finds defective no longer pass for sound in the next, nor are
    defects made from them. Later rounds start from the weights of the one before."""
    know = Knowledge(Tongues(x for p in pairs for x in p if x), Endings([]), decline_model(random.Random(seed), pairs))
    sound, model = [x for x, q in zip(pairs, know.most_declining(pairs)) if q < 0.5], None
    for k in range(max(1, rounds)):
        model = _fit(sound, seed + k, know, model, last=k == max(1, rounds) - 1)
        if k + 1 < rounds:
            probs = model.probabilities(pairs)
            sound = [x for x, p in zip(pairs, probs) if p.max() < 0.5]
    return model


def _fit(pairs: list[tuple[str | None, str | None]], seed: int, known: Knowledge, before: PairModel | None, last: bool = True) -> PairModel:
    """One round. On a held-out fifth each label's threshold is calibrated: the middle of those of the best F1, where a
    made defect counts `RARITY` as much as a sound pair, since defects are made more often than they occur."""
    made, y = synthesise(pairs, seed, known.tongues)
    endings = Endings([r for (_, r), row in zip(made, y) if not row.any() and r])
    know = Knowledge(known.tongues, endings, known.declines)
    held = np.arange(len(made)) % 5 == 0 if last else np.zeros(len(made), bool)
    part = lambda keep: [x for x, k in zip(made, keep) if k]
    linear = before.linear if before else Linear(len(DEFECTS), BITS, multi=True)
    epochs = max(3 if before else 5, min(40, 20_000 // max(len(made), 1)))
    linear.fit(featurise(part(~held), know), y[~held], epochs=epochs, rate=0.15, decay=1e-5)
    thresholds = [0.5] * len(DEFECTS)
    if last and held.sum() >= 50:
        thresholds = _thresholds(_tallies(linear.probabilities(featurise(part(held), know)), y[held]))
    return PairModel(linear, know, thresholds)


_GRID = np.linspace(0.05, 0.95, 37)


def _tallies(probs: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """By label and threshold: made defects found, others found, and made defects in all."""
    over, true = probs[:, :, None] >= _GRID, (truth == 1)[:, :, None]
    return np.stack([(over & true).sum(0), (over & ~true).sum(0), np.repeat(true.sum(0), len(_GRID), 1)]).astype(float)


def _thresholds(tallies: np.ndarray) -> list[float]:
    out = [0.5] * len(DEFECTS)
    for k in range(len(DEFECTS)):
        hits, wrong, true = RARITY * tallies[0, k], tallies[1, k], RARITY * tallies[2, k]
        f1 = 2 * hits / np.maximum(hits + wrong + true, 1e-9)
        if f1.max() > 0:
            out[k] = float(_GRID[np.nonzero(f1 >= f1.max() - 1e-9)[0]].mean())
    return out


def _add(x, y):
    """The sum of two states: numbers, arrays, counters, and dicts of them."""
    if isinstance(x, Counter):
        x.update(y)
        return x
    return {k: _add(x[k], y[k]) for k in x} if isinstance(x, dict) else x + y


def _over_all(parts: DataFrame, step: Callable[[list[tuple[str | None, str | None]], int], dict]) -> dict:
    """The sum of what `step` makes of each part and its number; summed in groups before it comes to the driver."""
    spark = parts.sparkSession

    def each(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for part, b in zip(pdf["part"], pdf["pairs"]):
                yield pd.DataFrame({"part": [part], "state": [_freeze(step(_thaw(b), int(part)))]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"state": [_freeze(reduce(_add, map(_thaw, pdf.sort_values("part")["state"])))]})

    dealt = parts.repartition(2 * spark.sparkContext.defaultParallelism, "part")
    with shuffles_dropped(spark):
        rows = dealt.mapInPandas(each, "part int, state binary").groupBy((F.col("part") % 16).alias("k")).applyInPandas(add, "state binary").collect()
    return reduce(_add, [_thaw(r["state"]) for r in rows])


def _freeze(x) -> bytes:
    return zlib.compress(pickle.dumps(x), 1)


def _thaw(b: bytes):
    return pickle.loads(zlib.decompress(b))


def fit_over_all(parts: DataFrame, seed: int = 11, rounds: int = 3) -> PairModel:
    """`fit` where the pairs are many: (part, pairs) are all of them, in parts. Counts are summed over the parts; a classifier
    is trained on each part from common weights, and each weight then moves by the mean of the parts that moved it; thresholds
    are those of the held-out fifths of all parts together."""
    mix = lambda part: seed + 97 * part

    def first(pairs, part):
        d = decline_model(random.Random(mix(part)), pairs)
        return {"words": Tongues.counts(x for p in pairs for x in p if x), "w": d.w, "moved": (d.w != 0).astype(np.float32), "b": d.b, "n": 1}

    def merged(old: Linear, s: dict) -> Linear:
        new = Linear(old.w.shape[1], BITS, multi=True)
        new.w, new.b = old.w + s["w"] / np.maximum(s["moved"], 1), old.b + s["b"] / s["n"]
        return new

    s = _over_all(parts, first)
    tongues, declines = Tongues(counted=s["words"]), merged(Linear(1, BITS, multi=True), s)
    model: PairModel | None = None
    rounds = max(1, rounds)
    for k in range(rounds):
        before, last = model, k == rounds - 1
        known = Knowledge(tongues, Endings([]), declines)

        def made(pairs, part, known=known, before=before, k=k):
            if before:
                pairs = [x for x, p in zip(pairs, before.probabilities(pairs)) if p.max() < 0.5]
            else:
                pairs = [x for x, q in zip(pairs, known.most_declining(pairs)) if q < 0.5]
            return synthesise(pairs, mix(part) + k, known.tongues)

        def ends(pairs, part, made=made):
            out, y = made(pairs, part)
            e = Endings([r for (_, r), row in zip(out, y) if not row.any() and r])
            return {"all": e.all, "end": e.end}

        e, endings = _over_all(parts, ends), Endings([])
        endings.all, endings.end = e["all"], e["end"]
        know, start = Knowledge(tongues, endings, declines), before.linear if before else Linear(len(DEFECTS), BITS, multi=True)

        def train(pairs, part, made=made, know=know, start=start, again=before is not None, last=last):
            out, y = made(pairs, part)
            keep = np.arange(len(out)) % 5 != 0 if last else np.ones(len(out), bool)
            linear = Linear(len(DEFECTS), BITS, multi=True)
            linear.w, linear.b = start.w.copy(), start.b.copy()
            epochs = max(3 if again else 5, min(40, 20_000 // max(len(out), 1)))
            linear.fit(featurise([x for x, g in zip(out, keep) if g], know), y[keep], epochs=epochs, rate=0.15, decay=1e-5)
            w = linear.w - start.w
            return {"w": w, "moved": (w != 0).astype(np.float32), "b": linear.b - start.b, "n": 1}

        model = PairModel(merged(start, _over_all(parts, train)), know, [0.5] * len(DEFECTS))

    def judged(pairs, part, made=made, model=model):
        out, y = made(pairs, part)
        held = np.arange(len(out)) % 5 == 0
        return {"t": _tallies(model.probabilities([x for x, g in zip(out, held) if g]), y[held])}

    model.thresholds = _thresholds(_over_all(parts, judged)["t"])
    return model


def pair_defects(df: DataFrame, id_col: str = "example_id", prompt_col: str = "prompt", response_col: str = "response", max_training: int = 5000, spread_rows: bool = True) -> DataFrame:
    """One row (example_id, defect, probability) per pair; defect is null for sound pairs.

    A null or blank response is `empty`; with a null or blank prompt the response alone is judged. Null ids are kept;
    repeated rows give repeated rows; extra columns are ignored; an empty table gives no rows. The classifier is fitted on
    all (unlabelled) pairs: at once where they are `max_training` at most, else in parts of about so many by hash, whose
    texts are shuffled once, packed. The judging is narrow beside `spread_rows`.
    """
    p, r = F.col(prompt_col), F.col(response_col)
    rows = df.select(F.col(id_col).alias("id"), p.alias("p"), r.alias("r"))
    n_parts = -(-rows.count() // max_training)
    if n_parts <= 1:
        model = fit([(x["p"], x["r"]) for x in bounded_sample(rows, max_training, "id").collect()])
    else:

        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            pairs = sorted(zip(pdf["p"], pdf["r"]), key=lambda x: (x[0] or "", x[1] or ""))
            random.Random(5).shuffle(pairs)
            return pd.DataFrame({"part": [pdf["part"].iloc[0]], "pairs": [_freeze(pairs)]})

        part = F.pmod(F.xxhash64("id", "p", "r"), F.lit(n_parts)).cast("int")
        with shuffles_dropped(df.sparkSession):
            parts = stored(rows.select(part.alias("part"), "p", "r").groupBy("part").applyInPandas(pack, "part int, pairs binary"))
        model = fit_over_all(parts)
        discard(parts)

    def run(cols: dict[str, list]) -> dict[str, list]:
        got = model.judge(list(zip(cols["p"], cols["r"])))
        return {"example_id": cols["example_id"], "defect": [g[0] for g in got], "probability": [g[1] for g in got]}

    base = df.select(F.col(id_col).alias("example_id"), p.alias("p"), r.alias("r"))
    return map_arrow(spread(base) if spread_rows else base, run, "example_id bigint, defect string, probability double")
