"""Problem 7: languages of documents and of their segments.

Method: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time. It labels
every byte; the labels of a sentence are pooled to a language with a confidence, neighbouring sentences of one
language form a segment, and the document's probabilities are pooled over all positions.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import FUNCTION_SETS, LANGS, WORD, bounded_sample, label_code, map_arrow, spread
from weftline.llm.structure import fit_profiles, kinds_of

_SENTENCE = re.compile(r"(?<=[.!?…:])[\"'»”)]*\s+|\r?\n\s*\r?\n|\r?\n(?=\s*(?:[-*•]|\d+[.)])\s)")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


class Direction:
    """One gated recurrent layer. The embedding and the input weights are one table: a row of gate inputs per byte."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.h = hidden
        self.params = {
            "g": (rng.standard_normal((257, 3 * hidden)) * 0.3).astype(np.float32),
            "u": (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32),
            "c": np.zeros(hidden, np.float32),
        }

    def forward(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """x: (T, B) bytes, 256 for padding. States (T, B, H)."""
        steps, batch = x.shape
        hid, p = self.h, self.params
        h = np.zeros((batch, hid), np.float32)
        out = np.empty((steps, batch, hid), np.float32)
        saved = []
        for t in range(steps):
            a = p["g"][x[t]]
            b = h @ p["u"]
            zr = _sigmoid(a[:, : 2 * hid] + b[:, : 2 * hid])
            z, r = zr[:, :hid], zr[:, hid:]
            q = b[:, 2 * hid :] + p["c"]
            n = np.tanh(a[:, 2 * hid :] + r * q)
            new = n + z * (h - n)
            if keep:
                saved.append((h, z, r, q, n))
            h = new
            out[t] = h
        return out, saved

    def states(self, x: np.ndarray, out: np.ndarray) -> None:
        """The states alone, written into out (T, B, H): the same steps without new arrays."""
        hid, batch = self.h, x.shape[1]
        # A sigmoid is half a hyperbolic tangent of half its argument: the halves go into the weights.
        cut = lambda m, k: np.ascontiguousarray(m[:, k * hid : (k + 1) * hid]) * np.float32(1.0 if k == 2 else 0.5)
        (gz, gr, gn), (uz, ur, un) = ([cut(self.params[k], i) for i in range(3)] for k in "gu")
        h, z, r, n, q, b = (np.zeros((batch, hid), np.float32) for _ in range(6))
        for t in range(len(x)):
            for gate, g, u in ((z, gz, uz), (r, gr, ur)):
                np.take(g, x[t], axis=0, out=gate, mode="clip")
                np.matmul(h, u, out=b)
                gate += b
                np.tanh(gate, out=gate)
                gate *= 0.5
                gate += 0.5
            np.take(gn, x[t], axis=0, out=n, mode="clip")
            np.matmul(h, un, out=q)
            q += self.params["c"]
            q *= r
            n += q
            np.tanh(n, out=n)
            h -= n
            h *= z
            h += n
            out[t] = h

    def backward(self, x: np.ndarray, saved: list, dout: np.ndarray) -> dict[str, np.ndarray]:
        hid, p = self.h, self.params
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        dh = np.zeros_like(dout[0])
        for t in range(len(saved) - 1, -1, -1):
            h, z, r, q, n = saved[t]
            d = dout[t] + dh
            dn = d * (1 - z)
            dz = d * (h - n) * z * (1 - z)
            da_n = dn * (1 - n * n)
            dq = da_n * r
            dr = da_n * q * r * (1 - r)
            gate = np.concatenate([dz, dr, dq], 1)
            grads["u"] += h.T @ gate
            grads["c"] += dq.sum(0)
            np.add.at(grads["g"], x[t], np.concatenate([dz, dr, da_n], 1))
            dh = d * z + gate @ p["u"].T
        return grads


class ByteTagger:
    """Both directions and a softmax over the languages at every byte."""

    def __init__(self, hidden: int = 32, labels: int = len(LANGS), seed: int = 5):
        rng = np.random.default_rng(seed)
        self.left, self.right = Direction(hidden, rng), Direction(hidden, rng)
        self.v = (rng.standard_normal((2 * hidden, labels)) * 0.1).astype(np.float32)
        self.b = np.zeros(labels, np.float32)

    def states(self, x: np.ndarray, keep: bool = False):
        a, sa = self.left.forward(x, keep)
        b, sb = self.right.forward(x[::-1], keep)
        return np.concatenate([a, b[::-1]], 2), sa, sb

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        hid = self.left.h
        h = np.empty((*x.shape, hid), np.float32)
        self.left.states(x, h)
        z = h @ self.v[:hid]
        self.right.states(x[::-1], h)
        z += h[::-1] @ self.v[hid:]
        z += self.b
        top = z[..., 0].copy()
        for k in range(1, z.shape[2]):
            np.maximum(top, z[..., k], out=top)
        z -= top[..., None]
        e = np.exp(z)
        total = e[..., 0].copy()
        for k in range(1, z.shape[2]):
            total += e[..., k]
        z -= np.log(total)[..., None]
        return z

    def train(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int = 128, rate: float = 0.01, seed: int = 3) -> float:
        """x: (N, T) bytes; y: (N, T) labels, -1 where none. Adam; returns the mean loss of the last tenth."""
        rng = np.random.default_rng(seed)
        params = [*self.left.params.values(), *self.right.params.values(), self.v, self.b]
        m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        hid = self.left.h
        losses = []
        for step in range(1, steps + 1):
            rows = rng.integers(0, len(x), batch)
            xb, yb = x[rows].T, y[rows].T
            h, sa, sb = self.states(xb, True)
            z = h @ self.v + self.b
            z -= z.max(2, keepdims=True)
            e = np.exp(z)
            p = e / e.sum(2, keepdims=True)
            on = yb >= 0
            tt, bb = np.nonzero(on)
            losses.append(-np.log(p[tt, bb, yb[tt, bb]] + 1e-9).mean())
            p[tt, bb, yb[tt, bb]] -= 1
            p *= on[:, :, None] / max(on.sum(), 1)
            flat_h, flat_p = h.reshape(-1, 2 * hid), p.reshape(-1, p.shape[2])
            gv, gb = flat_h.T @ flat_p, flat_p.sum(0)
            dh = p @ self.v.T
            ga = self.left.backward(xb, sa, dh[:, :, :hid])
            gc = self.right.backward(xb[::-1], sb, dh[::-1, :, hid:])
            grads = [*(ga[k] for k in self.left.params), *(gc[k] for k in self.right.params), gv, gb]
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            scale = min(1.0, 1.0 / (norm + 1e-9))
            lr = rate * min(1.0, step / 20) * (1.0 if step < steps * 0.7 else 0.2)
            for i, g in enumerate(grads):
                g = g * scale
                m[i] = 0.9 * m[i] + 0.1 * g
                s[i] = 0.99 * s[i] + 0.01 * g * g
                params[i] -= (lr * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return float(np.mean(losses[-max(1, steps // 10) :]))

    def pool(self, pieces: list[bytes], batch: int = 512) -> np.ndarray:
        """Mean log-probabilities over the bytes of each piece, normalised: (n, labels). Pieces of like length share a batch."""
        out = np.zeros((len(pieces), len(self.b)))
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        k = 0
        while k < len(order):
            size = max(1, min(batch, 40000 // max(len(pieces[order[k]]), 1)))
            rows = [i for i in order[k : k + size]]
            longest = len(pieces[rows[-1]])
            while longest * len(rows) > 120000 and len(rows) > 1:
                rows = rows[: max(1, len(rows) // 2)]
                longest = len(pieces[rows[-1]])
            k += len(rows)
            x = np.full((max(longest, 1), len(rows)), 256, np.int64)
            for j, i in enumerate(rows):
                if pieces[i]:
                    x[: len(pieces[i]), j] = np.frombuffer(pieces[i], np.uint8)
            lp = self.log_probs(x)
            lp[x == 256] = 0
            out[rows] = lp.sum(0) / np.maximum([len(pieces[i]) for i in rows], 1)[:, None]
        return out


def sentences(text: str) -> list[str]:
    return [s for x in _SENTENCE.split(text) if x and (s := re.sub(r"\s+", " ", x).strip())]


def _hits(words: list[str], lang: str) -> int:
    return sum(w in FUNCTION_SETS[lang] for w in words)


def training_windows(texts: list[tuple[str, str]], length: int = 64, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Windows of bytes with labels. A sentence counts where its record's label agrees with its function words; one
    window in four joins the ends of two sentences, mostly of different languages."""
    rng = np.random.default_rng(seed)
    by: dict[str, list[bytes]] = {k: [] for k in LANGS}
    for text, lang in texts:
        for s in sentences(text):
            words = [w.lower() for w in WORD.findall(s)]
            own = _hits(words, lang)
            if len(words) >= 4 and own >= 2 and own > max(_hits(words, k) for k in LANGS if k != lang):
                by[lang].append(s.encode())
    known = [k for k in LANGS if by[k]]
    n = 1500
    x, y = [], []
    for lang in known:
        pool = by[lang]
        for _ in range(n):
            a = pool[rng.integers(len(pool))]
            if rng.random() < 0.25:
                other = known[rng.integers(len(known))]
                b = by[other][rng.integers(len(by[other]))]
                cut = int(rng.integers(16, length - 16))
                xa, xb = a[-cut:], (b" " + b)[: length - min(cut, len(a))]
                seq, lab = xa + xb, [LANGS.index(lang)] * len(xa) + [LANGS.index(other)] * len(xb)
            else:
                at = int(rng.integers(0, max(1, len(a) - length + 1)))
                seq = a[at : at + length]
                lab = [LANGS.index(lang)] * len(seq)
            if rng.random() < 0.1:
                seq = seq.decode("utf-8", "ignore").lower().encode()[: len(seq)]
                lab = lab[: len(seq)]
            pad = length - len(seq)
            x.append(np.concatenate([np.frombuffer(seq, np.uint8), np.full(pad, 256)]))
            y.append(np.array(lab + [-1] * pad))
    if not x:
        return np.zeros((0, length), np.int64), np.zeros((0, length), np.int64)
    return np.array(x, np.int64), np.array(y, np.int64)


def fit(texts: list[tuple[str, str]], steps: int = 260, hidden: int = 32) -> ByteTagger | None:
    """Train on (text, language code); None without any usable sentence."""
    x, y = training_windows(texts)
    if not len(x):
        return None
    tagger = ByteTagger(hidden)
    tagger.train(x, y, steps)
    return tagger


def segments(text: str, pooled: np.ndarray, parts: list[str]) -> list[tuple[str, float, int]]:
    """(language, confidence, characters) of each run of sentences of one language, by the pooled labels."""
    out: list[list] = []
    for s, lp in zip(parts, pooled):
        p = np.exp(lp - lp.max())
        p /= p.sum()
        k = LANGS[int(p.argmax())]
        if out and out[-1][0] == k:
            n = out[-1][2] + len(s)
            out[-1][1] = (out[-1][1] * out[-1][2] + float(p.max()) * len(s)) / n
            out[-1][2] = n
        else:
            out.append([k, float(p.max()), len(s)])
    return [tuple(x) for x in out]


def truly_in(parts: list[str], pooled: np.ndarray, least: float = 0.55) -> dict[str, float]:
    """The languages of which the text holds a sentence, with the best confidence: the pooled labels name it, and the
    sentence has at least four words, two of them function words of that language and no more of another; where the
    labels are sure and the words many, one will do."""
    got: dict[str, float] = {}
    for s, lp in zip(parts, pooled):
        words = [w.lower() for w in WORD.findall(s)]
        if len(words) < 4:
            continue
        p = np.exp(lp - lp.max())
        p /= p.sum()
        k = LANGS[int(p.argmax())]
        own = _hits(words, k)
        most = max(_hits(words, o) for o in LANGS)
        if p.max() >= least and own >= 2 and own >= most or p.max() >= 0.95 and own >= 1 and own + 1 >= most and len(words) >= 6:
            got[k] = max(got.get(k, 0.0), float(p.max()))
    return got


SCHEMA = "record_id bigint, label string, label_lang string, kind string, lang string, confidence double, languages array<string>, segments array<struct<lang: string, confidence: double, n_chars: int>>, mixed boolean, relabel boolean"


def languages(df: DataFrame, id_col: str = "record_id", text_col: str = "text", label_col: str = "lang", max_training: int = 3000, steps: int = 260, spread_rows: bool = True) -> DataFrame:
    """One row per record: the language with a confidence, the languages truly in it, its segments, and whether it is
    mixed or its label is missing or wrong (`relabel`).

    Texts without sentences (null, blank, lists, tables, junk) get no language. Null ids are kept; repeated rows give
    repeated rows; extra columns are ignored; an empty table gives no rows. The network is trained on the sentences of at
    most `max_training` labelled records, chosen by hash; every byte of every text is labelled. Narrow: no shuffle of
    texts but for that choice.
    """
    text, label = F.col(text_col), F.col(label_col)
    chosen = bounded_sample(df.select(F.col(id_col).alias("id"), text.alias("t"), label.alias("l")).filter(text.isNotNull() & label.isNotNull() & (F.length(label) > 1)), max_training, "id")
    labelled = [(r["t"], k) for r in chosen.collect() if (k := label_code(r["l"]))]
    tagger = fit(labelled, steps)
    profiles = fit_profiles(df, text_col)

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("record_id", "label", "label_lang", "kind", "lang", "confidence", "languages", "segments", "mixed", "relabel")}
        kinds = kinds_of(cols["t"], profiles)
        parts = [sentences(t) if k == "prose" and tagger else [] for t, k in zip(cols["t"], kinds)]
        pooled = tagger.pool([s.encode("utf-8", "replace") for p in parts for s in p]) if tagger and any(parts) else np.zeros((0, len(LANGS)))
        at = 0
        for rid, lab, kind, p in zip(cols["record_id"], cols["l"], kinds, parts):
            lp = pooled[at : at + len(p)]
            at += len(p)
            code = label_code(lab)
            inside = truly_in(p, lp) if p else {}
            lang = conf = None
            if inside:
                weight = np.array([len(s) for s in p], float)[:, None]
                doc = (lp * weight).sum(0) / weight.sum()
                doc = np.exp(doc - doc.max())
                doc /= doc.sum()
                lang = max(inside, key=lambda k: doc[LANGS.index(k)])
                conf = float(doc[LANGS.index(lang)])
            mixed = len(inside) > 1
            for k, v in zip(out, (rid, lab, code, kind, lang, conf, sorted(inside), [{"lang": a, "confidence": b, "n_chars": c} for a, b, c in segments("", lp, p)], mixed, bool(inside) and (mixed or code != lang))):
                out[k].append(v)
        return out

    base = df.select(F.col(id_col).alias("record_id"), text.alias("t"), label.alias("l"))
    return map_arrow(spread(base) if spread_rows else base, run, SCHEMA)
