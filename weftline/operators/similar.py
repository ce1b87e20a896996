"""Exact similarity join of texts by their word n-grams, without a table of n-grams on disk.

The n-grams of a corpus take many times the room of its texts, so that they are made anew in each pass, in Arrow batches,
and only what has to meet is shuffled, packed: counts of n-grams, the rarest n-grams of each text, and the texts of pairs.
N-grams are tokens of 45 bits where candidates are looked for. What is returned is decided on the n-grams themselves."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.common import cut, discard, stored

TOKEN_BITS = 45
#: Bits of the places of the table of counts, by the number of texts. Beyond the last it does not grow: in a fuller one n-grams
#: seem more frequent than they are, which changes the order in which they are looked up, and no result.
TABLE_BITS = ((500_000, 22), (float("inf"), 24))
_COUNT_BUCKETS = 256
_FLUSH = 4_000_000
_BATCH = 8192
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def tokens(norms: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct tokens of the n-grams of normal texts, and the places of the texts they belong to, in order of both."""
    parts = pc.split_pattern(norms, " ")
    words = parts.flatten().dictionary_encode()
    ends = np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64))
    size = np.diff(ends, prepend=0)
    size[pc.equal(norms, "").to_numpy(zero_copy_only=False)] = 0
    count = np.maximum(size - (n - 1), 0)
    if not count.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in words.dictionary.to_pylist()], np.uint64)[words.indices.to_numpy()]
    own = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(ends - np.diff(ends, prepend=0), count)
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        h = _mix(h + hashes[at + k])
    x = np.sort((own.astype(np.uint64) << np.uint64(TOKEN_BITS)) | (h >> np.uint64(64 - TOKEN_BITS)))
    x = x[np.concatenate([[True], x[1:] != x[:-1]])]
    return x & np.uint64((1 << TOKEN_BITS) - 1), (x >> np.uint64(TOKEN_BITS)).astype(np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as bytes by place, compressed."""
    return zlib.compress(b"".join(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays), 1)


def _unpack(b: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(zlib.decompress(b), np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    n, out, at = len(raw) // sum(widths), [], 0
    for k, w in zip(kinds, widths):
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).view(k).ravel())
        at += n * w
    return out


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array]]:
    for b in batches:
        for k in range(0, b.num_rows, _BATCH):
            x = b.slice(k, _BATCH)
            yield x.column(0).to_numpy(zero_copy_only=False), x.column(1).cast(pa.string())


def count_table(sets: DataFrame, n: int, bits: int) -> tuple[np.ndarray, int]:
    """For each place the number of texts whose n-grams fall on it, in steps: 0 for one, then the logarithm to 2, 1 at least;
    and the number of all n-grams."""
    wide = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("counts", pa.binary())])

        def flush(held: list[np.ndarray]) -> pa.RecordBatch:
            place = (np.concatenate(held) >> np.uint64(TOKEN_BITS - bits)).astype(np.int64)
            c = np.bincount(place, minlength=wide).astype(np.uint32).reshape(_COUNT_BUCKETS, -1)
            return pa.RecordBatch.from_arrays([pa.array(range(_COUNT_BUCKETS), pa.int32()), pa.array([_pack(r) for r in c], pa.binary())], schema=schema)

        held, total = [], 0
        for _, norms in _texts(batches):
            held.append(tokens(norms, n)[0])
            total += len(held[-1])
            if total > 2 * _FLUSH:
                yield flush(held)
                held, total = [], 0
        if total:
            yield flush(held)

    def add(pdf):
        c = sum(_unpack(b, "u4")[0].astype(np.int64) for b in pdf["counts"])
        step = np.where(c <= 1, 0, np.maximum(1, np.log2(np.maximum(c, 1)).astype(np.int64)))
        return pdf[["bucket"]].head(1).assign(steps=[zlib.compress(step.astype(np.uint8).tobytes(), 1)], n=[int(c.sum())])

    rows = sets.mapInArrow(count, "bucket int, counts binary").groupBy("bucket").applyInPandas(add, "bucket int, steps binary, n bigint").collect()
    out = np.zeros((_COUNT_BUCKETS, wide // _COUNT_BUCKETS), np.uint8)
    for r in rows:  # _COUNT_BUCKETS at most, of a fixed size
        out[r["bucket"]] = np.frombuffer(zlib.decompress(r["steps"]), np.uint8)
    return out.ravel(), sum(r["n"] for r in rows)


def _asked(m: np.ndarray, threshold: float) -> np.ndarray:
    """How many tokens of its prefix a set has to share: more of a large one, of which many share a few by chance."""
    return np.maximum(1, np.minimum(1 + m // 32, np.ceil(m * threshold - 1e-9).astype(np.int64) - 1))


def _prefix_length(m: np.ndarray, threshold: float) -> np.ndarray:
    """How many of the rarest tokens are looked up; one more than needed, should two n-grams of a text be one token."""
    return np.minimum(m, m - np.ceil(m * threshold - 1e-9).astype(np.int64) + _asked(m, threshold) + 1)


def _meet(token: np.ndarray, doc: np.ndarray, size: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the documents that share a token, if their sizes allow for the threshold."""
    order = np.lexsort((size[doc], token))
    token, doc = token[order], doc[order]
    m = size[doc]
    group = np.cumsum(np.concatenate([[0], token[1:] != token[:-1]]))
    # within a token by size: each meets those that follow up to its size over the threshold
    wide = int(m.max()) + 2
    key = group.astype(np.int64) * (4 * wide) + m
    last = np.searchsorted(key, group.astype(np.int64) * (4 * wide) + np.minimum(np.floor((m + 1) / threshold + 1e-9).astype(np.int64), 4 * wide - 1), side="right")
    many = last - np.arange(len(key)) - 1
    start = 0
    total = np.cumsum(many)
    while start < len(key):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + _FLUSH, side="right")))
        n = many[start:stop]
        a = np.repeat(np.arange(start, stop), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        yield doc[a], doc[b]
        start = stop


def candidates(sets: DataFrame, n: int, threshold: float, table: np.ndarray, buckets: int) -> DataFrame:
    """(a, b), a < b: pairs that share some of their rarest tokens. Of sets of a similarity of at least the threshold, k of
    the |S| - ceil(t |S|) + k first in any one order are shared; the order is that of the counts, and k grows with the sets."""
    shared = sets.sparkSession.sparkContext.broadcast(table)
    low = TOKEN_BITS - (len(table).bit_length() - 1)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("sets", pa.binary()), ("tokens", pa.binary())])

        def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            ids, size = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            base = np.cumsum([0] + [len(h[0]) for h in held])
            token = np.concatenate([h[2] for h in held])
            doc = np.concatenate([h[3] + k for h, k in zip(held, base)])
            order = np.argsort(token)
            token, doc = token[order], doc[order]
            edges = np.searchsorted(token, (np.arange(buckets + 1, dtype=np.uint64) << np.uint64(TOKEN_BITS)) // np.uint64(buckets))
            out = []
            for k in range(buckets):
                t, d = token[edges[k] : edges[k + 1]], doc[edges[k] : edges[k + 1]]
                if len(t):
                    used, at = np.unique(d, return_inverse=True)
                    out.append((k, _pack(np.diff(ids[used], prepend=0), size[used].astype(np.uint32)), _pack(np.diff(t, prepend=np.uint64(0)), at.astype(np.uint32))))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        held, total = [], 0
        for ids, norms in _texts(batches):
            token, own = tokens(norms, n)
            m = np.bincount(own, minlength=len(ids))
            step = shared.value[(token >> np.uint64(low)).astype(np.int64)]
            key = np.sort((own.astype(np.uint64) << np.uint64(TOKEN_BITS + 5)) | (step.astype(np.uint64) << np.uint64(TOKEN_BITS)) | token)
            rank = np.arange(len(own)) - np.repeat(np.cumsum(m) - m, m)
            first = (rank < np.repeat(_prefix_length(m, threshold), m)) & (key >> np.uint64(TOKEN_BITS) & np.uint64(31) > 0)  # step 0: in one set only
            token = key & np.uint64((1 << TOKEN_BITS) - 1)
            held.append((ids, m, token[first], own[first]))
            total += int(first.sum())
            if total > _FLUSH:
                yield flush(held)
                held, total = [], 0
        if total:
            yield flush(held)

    def meet(pdf):
        ids, sizes, toks, docs, base = [], [], [], [], 0
        for s, t in zip(pdf["sets"], pdf["tokens"]):
            i, m = _unpack(s, "i8", "u4")
            x, d = _unpack(t, "u8", "u4")
            ids.append(np.cumsum(i))
            sizes.append(m)
            toks.append(np.cumsum(x))
            docs.append(d.astype(np.int64) + base)
            base += len(i)
        ids, size = np.concatenate(ids), np.concatenate(sizes).astype(np.int64)
        found, times = np.empty(0, np.int64), np.empty(0, np.int64)
        for a, b in _meet(np.concatenate(toks), np.concatenate(docs), size, threshold):
            new, n_new = np.unique(np.minimum(a, b) * base + np.maximum(a, b), return_counts=True)
            found, at = np.unique(np.concatenate([found, new]), return_inverse=True)
            times = np.bincount(at, np.concatenate([times, n_new]), len(found)).astype(np.int64)
        x, y = found // base, found % base
        asked = _asked(size, threshold)
        return pd.DataFrame({"a": np.minimum(ids[x], ids[y]), "b": np.maximum(ids[x], ids[y]), "n": times, "asked": np.minimum(asked[x], asked[y])})

    packed = sets.mapInArrow(prefixes, "bucket int, sets binary, tokens binary")
    met = packed.groupBy("bucket").applyInPandas(meet, "a bigint, b bigint, n int, asked int")
    return met.groupBy("a", "b").agg(F.sum("n").alias("n"), F.first("asked").alias("asked")).filter("n >= asked").select("a", "b")


def _grams(text: str, n: int) -> set[tuple[str, ...]]:
    w = text.split(" ") if text else []
    return set(zip(*(w[k:] for k in range(n)))) if len(w) >= n else set()


def _common_band(x: set[tuple[str, ...]], y: set[tuple[str, ...]], rows: int, n_bands: int) -> bool:
    """Whether the least hashes of both sets agree in all rows of a band: those of their union are then of both."""
    both, grams = x & y, [(" ".join(g).encode(), g) for g in x | y]

    def agree(seed: int) -> bool:
        head = f"{seed}-".encode()
        return min((hashlib.md5(head + b).digest(), g) for b, g in grams)[1] in both

    return any(all(agree(b * rows + r) for r in range(rows)) for b in range(n_bands))


def _judge(n: int, threshold: float, lsh: tuple[int, int] | None, words: bytes):
    """Rows (a, b, packed texts) to (a, b, similarity) of those that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])
        last: tuple[int | None, set] = (None, set())
        for batch in batches:
            out = []
            for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.columns)):
                if last[0] != a:
                    last = a, _grams(_loosen(ta, words), n)
                x, y = last[1], _grams(_loosen(tb, words), n)
                both = len(x & y)
                similarity = both / (len(x) + len(y) - both) if both else 0.0
                if both and similarity >= threshold and (lsh is None or _common_band(x, y, lsh[0] // lsh[1], lsh[1])):
                    out.append((a, b, similarity))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def _tighten(text: str, words: bytes) -> bytes:
    z = zlib.compressobj(6, wbits=-15, zdict=words)
    return z.compress(text.encode("utf-8", "surrogatepass")) + z.flush()


def _loosen(b: bytes, words: bytes) -> str:
    return zlib.decompressobj(wbits=-15, zdict=words).decompress(b).decode("utf-8", "surrogatepass")


#: So many ids at most are sent to every task, so that texts need not be shuffled to be told apart by them.
_FEW = 1_000_000


def _few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= _FEW else ids


def distinct_texts(norms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of texts (id, norm) those under the smallest id of the same text; and (id, rep), that id of each."""
    h = norms.select("id", F.unhex(F.sha2("norm", 256)).alias("h"))
    members = stored(h.join(h.groupBy("h").agg(F.min("id").alias("rep")), "h").select("id", "rep"))
    return norms.join(_few(members.filter("id <> rep").select("id")), "id", "left_anti"), members


def similar_texts(norms: DataFrame, id_col: str = "id", norm_col: str = "norm", n: int = 5, threshold: float = 0.8, lsh: tuple[int, int] | None = None) -> DataFrame:
    """(a, b, similarity), a < b, of distinct normal texts (words parted by one blank; ids are bigints) whose sets of n-grams
    have a Jaccard similarity of at least the threshold; materialised. With lsh = (hashes, bands) only pairs that share a
    band of their MinHash signatures, of which as many hashes are made as it takes to tell.

    Texts are read three times and shuffled only where they are part of a pair: packed, the smaller id twice."""
    sets = norms.select(F.col(id_col).cast("bigint").alias("id"), F.col(norm_col).alias("norm"))
    spark = sets.sparkSession
    bits = next(b for most, b in TABLE_BITS if sets.count() <= most)
    table, total = count_table(sets, n, bits)
    buckets = 8
    while buckets * _FLUSH < total * (1 - threshold):
        buckets *= 2
    pairs = stored(candidates(sets, n, threshold, table, buckets))
    # texts resemble one another: a few of them, as a dictionary, make the others smaller
    words = " ".join(r["norm"][:600] for r in sets.limit(60).collect())[:32000].encode("utf-8", "surrogatepass") or b" "

    def tighten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_tighten(t, words) for t in b.column(1).to_pylist()], pa.binary())], names=["id", "t"])

    def side(x: str) -> DataFrame:
        ids = pairs.select(F.col(x).alias("id")).distinct()
        return sets.join(_few(ids), "id", "left_semi").select("id", "norm").mapInArrow(tighten, "id bigint, t binary").select(F.col("id").alias(x), F.col("t").alias(f"t{x}"))

    met = pairs.hint("merge").join(side("a"), "a").hint("merge").join(side("b").hint("merge"), "b").select("a", "b", "ta", "tb")
    out = cut(met.mapInArrow(_judge(n, threshold, lsh, words), "a bigint, b bigint, similarity double"))
    discard(pairs)
    return out
