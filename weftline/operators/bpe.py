"""Byte-pair tokenizer: counting in Spark, merging over all distinct words on the driver or, where they are many, in Spark, encoding
in Arrow batches."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import takewhile

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from weftline.operators.common import cut, spread

# Fixed value: the pre-token pattern, in Java's syntax and in that of the regex module alike.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def split_specials(text: Column, specials: list[str]) -> Column:
    """The pieces between special tokens."""
    return F.split(text, "|".join(re.escape(s) for s in specials)) if specials else F.array(text)


def pretoken_counts(df: DataFrame, text_col: str = "text", specials: tuple[str, ...] = ("<|endoftext|>",)) -> DataFrame:
    """(tok, n): how often each pre-token occurs; counted before the shuffle."""
    piece = F.explode(split_specials(F.col(text_col), list(specials)))
    toks = df.select(piece.alias("p")).select(F.explode(F.regexp_extract_all("p", F.lit(PATTERN), F.lit(0))).alias("tok"))
    return toks.groupBy("tok").agg(F.count("*").alias("n"))


def pair_counts(counts: DataFrame) -> DataFrame:
    """(left, right, n): adjacent pairs of single bytes, as hex, weighted by their word's count."""
    hexed = counts.select(F.hex(F.encode("tok", "UTF-8")).alias("h"), "n").filter(F.length("h") > 2)
    at = F.sequence(F.lit(1), (F.length("h") / 2).cast("int") - 1)
    pairs = hexed.select("n", F.explode(F.transform(at, lambda i: F.struct(F.substring("h", i * 2 - 1, F.lit(2)).alias("left"), F.substring("h", i * 2 + 1, F.lit(2)).alias("right")))).alias("p"))
    return pairs.groupBy("p.left", "p.right").agg(F.sum("n").alias("n"))


def best_pair(pairs: DataFrame) -> DataFrame:
    """The most frequent pair; of equal ones the greatest bytes."""
    return pairs.orderBy(F.desc("n"), F.desc("left"), F.desc("right")).limit(1)


def initial_vocab(specials: tuple[str, ...] = ()) -> dict[int, bytes]:
    return {i: bytes([i]) for i in range(256)} | {256 + i: s.encode() for i, s in enumerate(specials)}


class _Most:
    """A pair with its count in a heap: the most frequent comes first, of equal ones the greatest bytes."""

    __slots__ = ("n", "pair")

    def __init__(self, n: int, pair: tuple[bytes, bytes]):
        self.n, self.pair = n, pair

    def __lt__(self, other: _Most) -> bool:
        return (self.n, self.pair) > (other.n, other.pair)


def merge_words(counts: dict[bytes, int], n_merges: int) -> list[tuple[bytes, bytes]]:
    """Merges by count, ties by the greatest bytes; only words that hold a merged pair are recounted, and only changed counts
    go into the heap, where outdated ones are passed over. Ends early where no pair is left."""
    words = [[bytes([b]) for b in w] for w in counts]
    freq = list(counts.values())
    total: Counter = Counter()
    where: dict[tuple[bytes, bytes], set[int]] = defaultdict(set)
    for i, w in enumerate(words):
        for p in zip(w, w[1:]):
            total[p] += freq[i]
            where[p].add(i)
    heap = [_Most(n, p) for p, n in total.items()]
    heapify(heap)
    merges = []
    while len(merges) < n_merges and heap:
        top = heappop(heap)
        best = top.pair
        if top.n <= 0 or total[best] != top.n:
            continue
        merges.append(best)
        changed: set[tuple[bytes, bytes]] = set()
        for i in where.pop(best):
            w, f = words[i], freq[i]
            for p in zip(w, w[1:]):
                total[p] -= f
                changed.add(p)
                if p != best:
                    where[p].discard(i)
            out, k = [], 0
            while k < len(w):
                if k + 1 < len(w) and (w[k], w[k + 1]) == best:
                    out.append(w[k] + w[k + 1])
                    k += 2
                else:
                    out.append(w[k])
                    k += 1
            words[i] = out
            for p in zip(out, out[1:]):
                total[p] += f
                changed.add(p)
                where[p].add(i)
        for p in changed:
            if total[p] > 0:
                heappush(heap, _Most(total[p], p))
    return merges


def _merged(parts: list[bytes], at: dict[tuple[bytes, bytes], list[int]]) -> list[bytes]:
    """A word after merges, in their order; at: the places of each pair in the list of merges."""
    last = -1
    while len(parts) > 1:
        now = min((i for p in zip(parts, parts[1:]) for i in at.get(p, ()) if i > last), default=None)
        if now is None:
            break
        out, k = [], 0
        while k < len(parts):
            if k + 1 < len(parts) and now in at.get((parts[k], parts[k + 1]), ()):
                out.append(parts[k] + parts[k + 1])
                k += 2
            else:
                out.append(parts[k])
                k += 1
        parts, last = out, now
    return parts


def _places(merges: list[tuple[bytes, bytes]]) -> dict[tuple[bytes, bytes], list[int]]:
    at: dict[tuple[bytes, bytes], list[int]] = defaultdict(list)
    for i, p in enumerate(merges):
        at[p].append(i)
    return dict(at)


def _merge(words: DataFrame, merges: list[tuple[bytes, bytes]]) -> DataFrame:
    """(parts, n) after merges; words that are one token are left out, having no pair."""
    at = _places(merges)

    def run(batches):
        for b in batches:
            rows = [(p, n) for p, n in ((_merged(p, at), n) for p, n in zip(b["parts"].to_pylist(), b["n"].to_pylist())) if len(p) > 1]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.list_(pa.binary())), pa.array([n for _, n in rows], pa.int64())], ["parts", "n"])

    return words.mapInArrow(run, "parts array<binary>, n bigint")


def _top_pairs(words: DataFrame, merges: list[tuple[bytes, bytes]], k: int) -> list[tuple[tuple[bytes, bytes], int]]:
    """The k most frequent pairs of the words after merges, ties by the greatest bytes."""
    at = _places(merges)

    def run(batches):
        total: Counter = Counter()
        for b in batches:
            for parts, n in zip(b["parts"].to_pylist(), b["n"].to_pylist()):
                parts = _merged(parts, at)
                for p in zip(parts, parts[1:]):
                    total[p] += n
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in total], pa.binary()), pa.array([p[1] for p in total], pa.binary()), pa.array(list(total.values()), pa.int64())], ["left", "right", "n"])

    pairs = words.mapInArrow(run, "left binary, right binary, n bigint").groupBy("left", "right").agg(F.sum("n").alias("n"))
    return [((bytes(r["left"]), bytes(r["right"])), r["n"]) for r in pairs.orderBy(F.desc("n"), F.desc("left"), F.desc("right")).limit(k).collect()]


def settled(ranked: list[tuple[tuple[bytes, bytes], int]], known: set[bytes], whole: bool) -> list[tuple[bytes, bytes]]:
    """The first pairs of a ranking that are the next merges whatever else is counted. A merge (a, b) lowers the counts of
    (x, a) and (b, y) only, and no pair that it makes is more frequent than one of those: the pairs before the first of
    their counts keep theirs. The list ends with a merge that can add to existing pairs or overlap itself. whole: no pair
    is missing from the ranking; else those of its last count may be."""
    out: list[tuple[bytes, bytes]] = []
    lefts: set[bytes] = set()
    rights: set[bytes] = set()
    for i, ((a, b), n) in enumerate(ranked):
        if out:
            if not whole and n == ranked[-1][1]:
                break
            if any(x in rights or y in lefts for (x, y), _ in takewhile(lambda r: r[1] == n, ranked[i:])):
                break
        out.append((a, b))
        lefts.add(a)
        rights.add(b)
        if a == b or a + b in known:
            break
        known = known | {a + b}
    return out


def train(df: DataFrame, vocab_size: int, specials: tuple[str, ...] = ("<|endoftext|>",), text_col: str = "text", max_words: int = 100_000, top: int = 1000) -> tuple[dict[int, bytes], list[tuple[bytes, bytes]]]:
    """(vocab, merges) over every distinct word of all texts. Up to `max_words` distinct words are merged on the driver. More
    stay in Spark, with the same merges: each round counts all pairs, and of the `top` most frequent ones the driver takes
    those that are settled."""
    vocab = initial_vocab(specials)
    counts = cut(pretoken_counts(df, text_col, specials).select(F.col("tok").cast("binary").alias("b"), "n"))
    few = counts.limit(max_words + 1).collect()
    if len(few) <= max_words:
        merges = merge_words({bytes(r["b"]): r["n"] for r in few}, max(0, vocab_size - len(vocab)))
    else:
        merges = merge_in_rounds(counts, max(0, vocab_size - len(vocab)), top)
    for a, b in merges:
        vocab[len(vocab)] = a + b
    return vocab, merges


def merge_in_rounds(counts: DataFrame, n_merges: int, top: int) -> list[tuple[bytes, bytes]]:
    """The merges of merge_words for (b, n) rows, which stay in Spark."""
    parts = F.transform(F.sequence(F.lit(1), F.octet_length("b")), lambda i: F.substring("b", i, F.lit(1)))
    words = cut(spread(counts.filter(F.octet_length("b") > 1).select(parts.alias("parts"), "n")))
    known = {bytes([i]) for i in range(256)}
    merges: list[tuple[bytes, bytes]] = []
    since = 0  # merges that the words hold
    while len(merges) < n_merges:
        ranked = _top_pairs(words, merges[since:], top)
        if not ranked:
            break
        new = settled(ranked, known, len(ranked) < top)[: n_merges - len(merges)]
        merges += new
        known |= {a + b for a, b in new}
        if len(merges) - since >= 50:
            words, since = cut(_merge(words, merges[since:])), len(merges)
    return merges


class Tokenizer:
    """Encoding by rank: in each pre-token the pair of the lowest rank is merged first, the leftmost of equal ones."""

    def __init__(self, vocab: dict[int, bytes], merges: list[tuple[bytes, bytes]], specials: tuple[str, ...] = ()):
        import regex

        self.vocab = vocab
        self.ids = {v: k for k, v in reversed(vocab.items())}
        self.rank = {p: i for i, p in enumerate(merges)}
        self.pattern = regex.compile(PATTERN)
        ordered = sorted(specials, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, ordered)) + ")") if ordered else None
        self.specials = frozenset(specials)
        self._word = lru_cache(maxsize=200_000)(self._encode_word)

    def __getstate__(self):
        return self.vocab, [p for p, _ in sorted(self.rank.items(), key=lambda x: x[1])], tuple(self.specials)

    def __setstate__(self, state):
        self.__init__(*state)

    def _encode_word(self, word: bytes) -> tuple[int, ...]:
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            r, i = min((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
            if r == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return tuple(self.ids[p] for p in parts)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.special.split(text) if self.special else [text]:
            if piece in self.specials:
                out.append(self.ids[piece.encode()])
            else:
                for m in self.pattern.finditer(piece):
                    out += self._word(m[0].encode("utf-8", "surrogatepass"))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.vocab[i] for i in ids).decode("utf-8", "replace")


def encode(df: DataFrame, tokenizer: Tokenizer, text_col: str = "text", out: str = "ids", eos: int | None = None, strip: bool = False) -> DataFrame:
    """Adds the ids of each text; null for null. eos: an id put at the end of each."""
    b = df.sparkSession.sparkContext.broadcast(tokenizer)

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(s: pd.Series) -> pd.Series:
        t = b.value
        tail = [] if eos is None else [eos]
        return s.map(lambda x: None if x is None else t.encode(x.strip() if strip else x) + tail)

    return df.withColumn(out, run(text_col))


def decode(df: DataFrame, tokenizer: Tokenizer, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    b = df.sparkSession.sparkContext.broadcast(tokenizer)

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else b.value.decode(list(x)))

    return df.withColumn(out, run(ids_col))


def compression(df: DataFrame, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Bytes for each token, over all rows."""
    return df.agg(F.sum(F.octet_length(text_col)).alias("n_bytes"), F.sum(F.size(ids_col)).alias("n_tokens")).withColumn("bytes_per_token", F.round(F.try_divide("n_bytes", "n_tokens"), 6))


def longest_token(vocab: dict[int, bytes]) -> tuple[int, bytes]:
    return max(sorted(vocab.items()), key=lambda x: len(x[1]))
