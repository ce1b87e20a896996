"""Problem 9: evaluation texts leaking into training text.

Method: latent semantic retrieval. Texts become passages (windows of words); a randomised SVD of their TF-IDF matrix
gives a latent space in which every passage of the corpus is compared with every passage of the evaluation items by
cosine. Passages that come near are checked by the longest common subsequence: the item's sentence or a run of its words
must stand in the document in order, a few words altered or dropped, and so must the answers, its quantities.

Cosines are those of the whole TF-IDF vectors as far as the latent space holds them: a passage's projection is divided by
its length outside as well. Most passages of the corpus project to little and are passed over unsearched.

Three passes: words are counted over all documents; the range of the matrix is found on a bounded sample of
documents (an index may be fitted on one) and every document is projected and searched. What moves between them
are sums of fixed size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bounded_sample, cut, map_arrow, spread

BITS = 15
SPAN, STRIDE = 16, 8
_WORD = re.compile(r"[^\W_]+")
_END = re.compile(r"(?<=[.!?])\s+")
_cache: dict[str, int] = {}


def word_ids(text: str) -> np.ndarray:
    """A 32-bit hash for each word, whatever its case and the punctuation, blanks and line ends around it."""
    if len(_cache) > 2_000_000:
        _cache.clear()
    out = []
    for w in _WORD.findall(text.lower()):
        h = _cache.get(w)
        if h is None:
            h = _cache[w] = xxhash.xxh32_intdigest(w)
        out.append(h)
    return np.array(out, np.uint32)


def starts_of(n: int, span: int = SPAN, stride: int = STRIDE) -> np.ndarray:
    """Starts of the passages of a text of n words: every stride, and one at the end."""
    if n <= span:
        return np.zeros(1 if n else 0, np.int64)
    s = np.arange(0, n - span + 1, stride)
    return s if s[-1] == n - span else np.append(s, n - span)


def passages(ids: np.ndarray, cuts: np.ndarray, weighted: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Latent vectors of all passages (two neighbouring blocks of STRIDE words) of texts that lie one after another; and of
    each its text and its start. weighted: the basis, each row times its bucket's weight; square: the squared weights.
    A vector is divided by the length of the whole TF-IDF vector, so that what the space leaves out shortens it."""
    blocks = -(-np.diff(cuts) // STRIDE)
    text = np.repeat(np.arange(len(blocks)), blocks)
    if not len(text):
        return np.zeros((0, weighted.shape[1]), np.float32), text, text
    nth = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = cuts[text] + nth * STRIDE
    b = ids & ((1 << BITS) - 1)
    v, n = np.add.reduceat(weighted[b], at, axis=0), np.add.reduceat(square[b], at)
    more = nth + 1 < blocks[text]
    i = np.nonzero(more)[0]
    v[i], n[i] = v[i] + v[i + 1], n[i] + n[i + 1]
    keep = more | (nth == 0)  # the last block is part of the passage before it
    return v[keep] / (np.sqrt(n[keep])[:, None] + 1e-6), text[keep], (nth * STRIDE)[keep]


class Item:
    """A distinct evaluation text without the sentences that many share, and what each of its words tells: words that many
    items share (those of a common form) tell little, names and quantities much."""

    def __init__(self, item_ids: list[int], sentences: list[np.ndarray], worth: dict[int, float], numbers: set[int]):
        self.item_ids, self.sentences = item_ids, [s for s in sentences if len(s)]
        self.ids = np.concatenate(self.sentences) if self.sentences else np.zeros(0, np.uint32)
        self.worth = [np.array([worth[w] for w in s.tolist()]) for s in self.sentences]
        self.all_worth = np.concatenate(self.worth) if self.sentences else np.zeros(0)
        self.answer = np.array([w in numbers for w in self.ids.tolist()], bool)


def _rest(words: dict[bytes, frozenset[int]], own: list[bytes], s: bytes) -> frozenset[int]:
    return frozenset().union(*(words[x] for x in own if x != s))


class Items:
    """All distinct texts of the items, and for each word those that hold it."""

    def __init__(self, rows: list[tuple[int, str]], share: float = 0.02):
        """A sentence is an instruction, and left out, where at least `share` of the distinct texts (three at least, fifty at
        most) hold it that are unlike in all the rest. Equal texts are one, whatever their ids; texts that share another
        sentence are near-equal and count as one where words are counted."""
        by: dict[tuple[bytes, ...], list[int]] = {}
        numbers: set[int] = set()
        for i, t in rows:
            by.setdefault(tuple(word_ids(s).tobytes() for s in _END.split(t or "")), []).append(i)
            numbers.update(word_ids(" ".join(w for w in _WORD.findall(t or "") if w[0].isdigit())).tolist())
        texts = sorted(by.items(), key=lambda x: min(x[1]))
        words = {s: frozenset(np.frombuffer(s, np.uint32).tolist()) for ss, _ in texts for s in ss}
        holders: dict[bytes, list[int]] = {}
        for k, (ss, _) in enumerate(texts):
            for s in set(ss):
                holders.setdefault(s, []).append(k)
        unlike = min(50, max(3, int(np.ceil(share * len(texts)))))
        instructions: set[bytes] = set()
        root = list(range(len(texts)))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = k = root[root[k]]
            return k

        for s, ks in holders.items():
            leaders: list[frozenset[int]] = []
            for k in ks if len(ks) >= unlike else ():
                rest = _rest(words, list(texts[k][0]), s)
                if not any(len(rest & x) >= 0.5 * len(rest | x) for x in leaders):
                    leaders.append(rest)
                    if len(leaders) >= unlike:
                        instructions.add(s)
                        break
            if s not in instructions and len(words[s]) >= 5:
                for k in ks[1:]:
                    root[find(k)] = find(ks[0])
        kept = [[np.frombuffer(s, np.uint32) for s in ss if s not in instructions] for ss, _ in texts]
        df = Counter(w for _, w in {(find(k), w) for k, ss in enumerate(kept) for s in ss for w in s.tolist()})
        worth = {w: max(0.08, c**-0.7) for w, c in df.items()}
        self.items = [x for (_, i), ss in zip(texts, kept) if len((x := Item(sorted(set(i)), ss, worth, numbers)).ids)]
        # All items one after another, by number of word: what `possible` needs of them.
        lengths = [len(x.ids) for x in self.items]
        self.begin = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        self.number: dict[int, int] = {w: k for k, w in enumerate(df)}
        flat = [self.number[w] for x in self.items for w in x.ids.tolist()]
        self.flat, self.worth = np.array(flat, np.int64), np.concatenate([x.all_worth for x in self.items] or [np.zeros(0)])
        self.flag = np.zeros(len(self.number), bool)
        total = np.concatenate([[0], np.cumsum(self.worth)])
        self.run_worth = np.full(len(flat), np.inf)
        for k, n in enumerate(lengths):
            at = np.arange(self.begin[k], self.begin[k] + n - RUN + 1)
            self.run_worth[at] = total[at + RUN] - total[at]
        bounds = [(k, int(c), int(c) + len(s)) for k, x in enumerate(self.items) for s, c in zip(x.sentences, self.begin[k] + np.cumsum([0, *map(len, x.sentences)])) if len(s) >= 5]
        self.sentence = np.array(bounds, np.int64).reshape(-1, 3)
        self.first_sentence = np.searchsorted(self.sentence[:, 0], np.arange(len(self.items) + 1))
        self.sentence_worth = total[self.sentence[:, 2]] - total[self.sentence[:, 1]]

    def possible(self, region: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Of the items `near`, those of which a run or a sentence could be found if the region's words stood in any order."""
        told = [k for w in set(region.tolist()) if (k := self.number.get(w)) is not None]
        size = self.begin[near + 1] - self.begin[near]
        own = np.repeat(np.arange(len(near)), size)
        offset = np.cumsum(size) - size
        at = np.arange(len(own)) + np.repeat(self.begin[near] - offset, size)
        self.flag[told] = True
        there = self.flag[self.flat[at]]
        self.flag[told] = False
        n = np.concatenate([[0], np.cumsum(there)])
        v = np.concatenate([[0], np.cumsum(there * self.worth[at])])
        ok = np.zeros(len(near), bool)
        if len(at) >= RUN:
            good = (n[RUN:] - n[:-RUN] >= 0.75 * RUN) & (v[RUN:] - v[:-RUN] >= SHARE * self.run_worth[at[: len(at) - RUN + 1]] - 1e-9)
            ok[own[np.nonzero(good)[0]]] = True
        rows = np.concatenate([np.arange(a, b) for a, b in zip(self.first_sentence[near], self.first_sentence[near + 1])] or [np.zeros(0, np.int64)])
        item = np.repeat(np.arange(len(near)), self.first_sentence[near + 1] - self.first_sentence[near])
        shift = (offset - self.begin[near])[item]
        a, b = self.sentence[rows, 1] + shift, self.sentence[rows, 2] + shift
        good = (n[b] - n[a] >= 0.75 * (b - a)) & (v[b] - v[a] >= SHARE * self.sentence_worth[rows] - 1e-9)
        ok[item[good]] = True
        return near[ok]


#: The least run of an item's words, and the share of what a stretch is worth that must be found.
RUN, SHARE = 12, 0.7


def local_alignment(a: np.ndarray, worth: np.ndarray, b: np.ndarray, miss: float = 0.45) -> tuple[float, int, int, float, float]:
    """The longest common subsequence of a stretch of a with b, where a match counts what the word is worth and a change
    or gap costs `miss`. Its score, its matches, its length in a, the worth matched, the worth of that stretch of a."""
    s, hits, length, got, begin = _common_subsequence(a, worth, b, miss)
    return s, hits, length, got, float(worth[begin : begin + length].sum())


def _common_subsequence(a: np.ndarray, worth: np.ndarray, b: np.ndarray, miss: float = 0.45) -> tuple[float, int, int, float, int]:
    """Score, matches, length, worth matched, begin in a. Only places where both hold one word are visited: between two of
    them the dearer of the two gaps is paid, since changes use up both sides at once."""
    where: dict[int, list[int]] = {}
    for j, w in enumerate(b.tolist()):
        where.setdefault(w, []).append(j)
    points = [(i, j, v) for i, (w, v) in enumerate(zip(a.tolist(), worth.tolist())) for j in where.get(w, ())]
    rows: list[tuple[int, int, float, int, float, int]] = []
    best, top = (0.0, 0, 0, 0.0, 0), 0.0
    for i, j, v in points:
        s, hits, got, begin = v, 1, v, i
        for i0, j0, s0, h0, g0, b0 in reversed(rows):
            gap = i - i0 - 1
            if gap * miss >= top:
                break  # all before are farther still
            if gap >= 0 and j > j0 and (x := s0 - miss * max(gap, j - j0 - 1)) > 0 and x + v > s:
                s, hits, got, begin = x + v, h0 + 1, g0 + v, b0
        rows.append((i, j, s, hits, got, begin))
        if s > best[0]:
            best, top = (s, hits, i + 1 - begin, got, begin), s
    return best


def answered(item: Item, there: np.ndarray, begin: int, length: int) -> bool:
    """The answer check: of the quantities in a stretch of the item at least half stand in the region."""
    asked = item.answer[begin : begin + length]
    return 2 * int((asked & there[begin : begin + length]).sum()) >= int(asked.sum())


def leaks(item: Item, region: np.ndarray, run: int = RUN, share: float = SHARE) -> bool:
    """Whether a region of a document holds a whole sentence of the item, or a run of `run` of its words, allowing for a
    few words altered or dropped: at least `share` of what the stretch is worth stands there in order, and its answers."""
    there = np.isin(item.ids, region)
    worth_there = np.where(there, item.all_worth, 0.0)
    at = 0
    for s, worth in zip(item.sentences, item.worth):
        n = len(s)
        # No alignment can find more than what stands there in any order.
        if n >= 5 and there[at : at + n].sum() >= 0.75 * n and worth_there[at : at + n].sum() >= share * worth.sum():
            _, hits, _, got, _ = _common_subsequence(s, worth, region)
            if hits >= 0.75 * n and got >= share * worth.sum() and answered(item, there, at, n):
                return True
        at += n
    if len(there) < run:
        return False
    n, found, worth = (np.concatenate([[0], np.cumsum(x)]) for x in (there, worth_there, item.all_worth))
    span = lambda x: x[run:] - x[:-run]
    if not ((span(n) >= 0.75 * run) & (span(found) >= share * span(worth) - 1e-9)).any():
        return False
    _, hits, length, got, begin = _common_subsequence(item.ids, item.all_worth, region)
    whole = float(item.all_worth[begin : begin + length].sum())
    return length >= run and hits >= 0.75 * length and hits >= run - 3 and got >= share * whole and answered(item, there, begin, length)


def document_counts(ids: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each word bucket occurs, and the number of documents: sums of fixed size per batch."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        c = np.zeros(1 << BITS, np.int64)
        for raw in cols["ids"]:
            c[np.unique(np.frombuffer(raw, np.uint32) & ((1 << BITS) - 1))] += 1
        return {"n": [len(cols["ids"])], "c": [c.tobytes()]}

    def add(table: pa.Table) -> pa.Table:
        c = sum(np.frombuffer(x, np.int64) for x in table.column("c").to_pylist())
        return pa.table({"n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "c": pa.array([c.tobytes()], pa.binary())})

    parts = map_arrow(ids.select("ids"), run, "n bigint, c binary")
    for fan in (64, 1):
        parts = parts.withColumn("g", F.spark_partition_id() % fan).groupBy("g").applyInArrow(lambda t: add(t.select(["n", "c"])), "n bigint, c binary")
    got = parts.collect()  # one row
    return (np.frombuffer(got[0]["c"], np.int64), got[0]["n"]) if got else (np.zeros(1 << BITS, np.int64), 0)


def latent_basis(sample: DataFrame, weight: np.ndarray, held: list[Item], rank: int = 64, over: int = 8, seed: int = 17) -> np.ndarray:
    """Right singular vectors of the TF-IDF matrix of passages (of the items and of a bounded sample of documents), by a
    randomised range finder with one power step: each partition multiplies its rows with the test matrix and back, and
    the products, of fixed size, are summed in the executors. The items' rows weigh as much as the sample's together."""
    width = rank + over
    omega = np.random.default_rng(seed).standard_normal((1 << BITS, width)).astype(np.float32)

    def product(m: np.ndarray, texts: Iterable[np.ndarray]) -> tuple[np.ndarray, int]:
        acc, n = np.zeros_like(m), 0
        for ids in texts:
            b = (ids & ((1 << BITS) - 1)).astype(np.int64)
            st = starts_of(len(b), SPAN, SPAN)
            if not len(st):
                continue
            n += len(st)
            w = weight[b]
            y = np.add.reduceat(m[b] * w[:, None], st, axis=0)
            norm = np.add.reduceat(w * w, st)[:, None] + 1e-6
            own = np.repeat(np.arange(len(st)), np.diff(np.append(st, len(b))))
            np.add.at(acc, b, (y / norm)[own] * w[:, None])
        return acc, n

    def times(m: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc, n = product(m, (np.frombuffer(x, np.uint32) for b in batches for x in b.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([acc.tobytes()], pa.binary())], ["n", "c"])

        return run

    def add(table: pa.Table) -> pa.Table:
        c = sum(np.frombuffer(x, np.float32) for x in table.column("c").to_pylist())
        return pa.table({"n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "c": pa.array([c.tobytes()], pa.binary())})

    m = omega
    for _ in range(2):
        parts = sample.select("ids").mapInArrow(times(m), "n bigint, c binary")
        for fan in (8, 1):
            parts = parts.withColumn("g", F.spark_partition_id() % fan).groupBy("g").applyInArrow(lambda t: add(t.select(["n", "c"])), "n bigint, c binary")
        got = parts.collect()  # one row of fixed size
        total, n = product(m, (x.ids for x in held))
        if got and got[0]["n"]:
            total = total * (got[0]["n"] / max(n, 1)) + np.frombuffer(got[0]["c"], np.float32).reshape(m.shape)
        m = np.linalg.qr(total + 1e-9 * omega)[0].astype(np.float32)
    return np.ascontiguousarray(m[:, :rank])


def leaked_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    near: float = 0.25, rank: int = 64, items_at_once: int = 20000, max_docs: int = 4000, spread_rows: bool = True,
) -> DataFrame:
    """Rows (item_id, doc_id): the document holds a whole sentence of the item or a run of at least 12 of its words.

    Null ids and null or blank texts never count; repeated rows give one row; extra columns are ignored; empty tables give
    no rows. Equal items are searched once and all their ids come out. Items go to every executor, `items_at_once` of them
    in one turn (chosen by hash; a larger table takes several turns over the word hashes). The space is fitted on at most
    `max_docs` documents, chosen by hash. Texts are read once and move nowhere beside `spread_rows`; only word hashes are kept.
    """
    wanted = items.select(F.col(item_col).alias("i"), F.col(item_text).alias("t")).filter("i is not null and t is not null").distinct()
    turns = max(1, -(-wanted.count() // items_at_once))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null and text is not null")

    def hashed(cols: dict[str, list]) -> dict[str, list]:
        return {"doc_id": cols["doc_id"], "ids": [word_ids(t).tobytes() for t in cols["text"]]}

    ids = cut(map_arrow(spread(base) if spread_rows else base, hashed, "doc_id bigint, ids binary"))
    counts, n = document_counts(ids)
    weight = np.log((n + 1) / (counts + 1)).astype(np.float32)
    sample = cut(spread(bounded_sample(ids, max_docs, "doc_id").select("ids")))
    found = None
    for k in range(turns):
        part = wanted.filter(F.pmod(F.xxhash64("t"), F.lit(turns)) == k)  # equal texts in one turn
        known = Items([(r[0], r[1]) for r in part.collect()])
        rows = _search(ids, known, weight, latent_basis(sample, weight, known.items, rank), near)
        found = rows if found is None else found.unionByName(rows)
    return found.distinct()


def _search(ids: DataFrame, known: Items, weight: np.ndarray, basis: np.ndarray, near: float) -> DataFrame:
    held = known.items
    weighted, square = basis * weight[:, None], weight * weight
    cuts = np.concatenate([[0], np.cumsum([len(x.ids) for x in held])]).astype(np.int64)
    all_ids = np.concatenate([x.ids for x in held]) if held else np.zeros(0, np.uint32)
    q, q_item, _ = passages(all_ids, cuts, weighted, square)
    q_t = np.ascontiguousarray(q.T)

    def search(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"item_id": [], "doc_id": []}
        texts = [np.frombuffer(x, np.uint32) for x in cols["ids"]]
        at = 0
        while at < len(texts) and len(q_item):
            to, words = at, 0
            while to < len(texts) and (to == at or words + len(texts[to]) <= 60000):
                words += len(texts[to])
                to += 1
            part = texts[at:to]
            c = np.concatenate([[0], np.cumsum([len(x) for x in part])]).astype(np.int64)
            v, own, start = passages(np.concatenate(part), c, weighted, square)
            # A cosine is at most as high as the length of the projection.
            far_enough = np.nonzero(np.einsum("ij,ij->i", v, v) >= near * near)[0]
            v, own, start = v[far_enough], own[far_enough], start[far_enough]
            found: set[tuple[int, int]] = set()
            for k in range(0, len(v), 512):
                hit = v[k : k + 512] @ q_t >= near
                for i in np.nonzero(hit.any(1))[0]:
                    d, s = int(own[k + i]), int(start[k + i])
                    region = part[d][max(0, s - SPAN) : s + 2 * SPAN + 4]
                    for it in known.possible(region, np.unique(q_item[hit[i]])).tolist():
                        if (d, it) not in found and leaks(held[it], region):
                            found.add((d, it))
            for d, it in found:
                out["item_id"] += held[it].item_ids
                out["doc_id"] += [cols["doc_id"][at + d]] * len(held[it].item_ids)
            at = to
        return out

    return map_arrow(ids, search, "item_id bigint, doc_id bigint")


def leak_report(found: DataFrame) -> DataFrame:
    """Per leaked item the number of documents that hold it, and the smallest of their ids."""
    return found.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc_id"))
