"""Problem 8: filling containers of fixed capacity.

Method: bound-certified repacking. Items are spread by hash over partitions of bounded size and packed there by best
fit decreasing. Dual feasible functions give a lower bound on each partition's containers: where it equals their
number the packing is proven best. Partitions with a gap release their worst-filled containers, exchange the items
among each other under another hash and pack them again; a new packing counts only if it needs fewer containers.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut, map_arrow, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(maxsize=2)
def encoding(vocabulary: bytes):
    """The tokenizer of a vocabulary file's content."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, spread_rows: bool = True) -> DataFrame:
    """(doc_id, n_tokens): null texts count 0 tokens. The driver reads the vocabulary file (about 1 MB) and sends it along."""
    with open(tokenizer, "rb") as f:
        held = df.sparkSession.sparkContext.broadcast(f.read())

    def run(cols: dict[str, list]) -> dict[str, list]:
        enc = encoding(held.value)
        return {"doc_id": cols["doc_id"], "n_tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in cols["text"]]}

    base = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(spread(base) if spread_rows else base, run, "doc_id bigint, n_tokens int")


def lower_bound(sizes: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """The best bound over families of dual feasible functions: identity, the threshold functions that drop small items
    and round up those that leave too little room, and the rounding functions u(k). counts: how often each size occurs.
    All thresholds are taken from prefix sums over the sorted sizes."""
    x = np.asarray(sizes, np.int64)
    n = np.ones(len(x), np.int64) if counts is None else np.asarray(counts, np.int64)
    order = np.argsort(x, kind="stable")
    x, n = x[order], n[order]
    x, n = x[x > 0], n[x > 0]
    if not len(x):
        return 0
    many, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(x * n)])
    best = -(-int(total[-1]) // capacity)
    eps = np.unique(x[x <= capacity // 2])
    if len(eps):
        low, high = np.searchsorted(x, eps, "left"), np.searchsorted(x, capacity - eps, "right")
        best = max(best, int((many[-1] - many[high] - (-(total[high] - total[low]) // capacity)).max()))
    for k in range(1, 8):
        q = x * (k + 1)
        # In units of 1 / (k * capacity), so that no rounding can raise the bound.
        value = np.where(q % capacity == 0, x * k, (q // capacity) * capacity)
        best = max(best, -(-int((value * n).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Container of each item and the number of containers. Items of size 0 go along with the first container."""
    where = np.zeros(len(sizes), np.int64)
    free: list[tuple[int, int]] = []
    count = 0
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        at = bisect_left(free, (s, -1))
        if at < len(free):
            room, b = free.pop(at)
        else:
            room, b = capacity, count
            count += 1
        where[i] = b
        insort(free, (room - s, b))
    return where, count


#: So many windows are packed at once; more go in several turns.
WINDOWS_AT_ONCE = 100
_OUT = "window_id bigint, capacity int, doc_id bigint, part int, n_tokens int, home bigint, bin bigint, fill int, n_bins bigint, bound bigint"


def _pack_group(table: pa.Table) -> pa.Table:
    capacity = table.column("capacity")[0].as_py()
    # A fixed order before packing: the result does not depend on how rows arrive.
    table = table.sort_by([("doc_id", "ascending"), ("part", "ascending"), ("n_tokens", "ascending")])
    sizes = table.column("n_tokens").to_numpy()
    where, count = best_fit_decreasing(sizes, capacity)
    fill = np.bincount(where, weights=sizes, minlength=max(count, 1)).astype(np.int32)[where]
    n = len(sizes)
    bound = lower_bound(sizes, capacity)
    out = table.select(["window_id", "capacity", "doc_id", "part", "n_tokens", "home"])
    for name, values in (("bin", where), ("fill", fill), ("n_bins", np.full(n, count)), ("bound", np.full(n, bound))):
        out = out.append_column(name, pa.array(values, pa.int32() if name == "fill" else pa.int64()))
    return out


def _pack(items: DataFrame) -> DataFrame:
    cols = items.select("window_id", "capacity", "doc_id", "part", "n_tokens", "home")
    return cols.groupBy("window_id", "home").applyInArrow(_pack_group, _OUT)


def pack(sizes: DataFrame, windows: DataFrame, per_partition: int = 20000, rounds: int = 3, release: float = 0.02) -> DataFrame:
    """Rows (window_id, doc_id, part, n_tokens, container, position, certified) for each window (window_id, capacity_tokens).

    A document goes whole into one container; only one longer than the capacity is split, into parts that fill
    containers of their own and a rest that is packed like any other. Documents without tokens take a place too.
    certified: the bound proves that the row's partition needs as many containers as it has.
    Null ids and windows with a null or non-positive capacity are left out; repeated documents are packed repeatedly;
    an empty table gives no rows. Containers are numbered within a window; positions start at 0.
    """
    w = windows.select("window_id", F.col("capacity_tokens").cast("int").alias("capacity")).filter("capacity > 0 and window_id is not null").distinct()
    sizes_of = sorted((r["window_id"], r["capacity"]) for r in w.collect())  # a fixed table
    out = None
    for k in range(0, max(1, len(sizes_of)), WINDOWS_AT_ONCE):
        part = _pack_windows(sizes, sizes_of[k : k + WINDOWS_AT_ONCE], per_partition, rounds, release)
        out = part if out is None else out.unionByName(part)
    return out


def _pack_windows(sizes: DataFrame, sizes_of: list[tuple[int, int]], per_partition: int, rounds: int, release: float) -> DataFrame:
    docs = sizes.filter("doc_id is not null").select("doc_id", "n_tokens")
    choices = F.array(*[F.struct(F.lit(a).cast("bigint").alias("window_id"), F.lit(b).alias("capacity")) for a, b in sizes_of] or [F.struct(F.lit(None).cast("bigint").alias("window_id"), F.lit(0).alias("capacity"))])
    items = docs.select("doc_id", "n_tokens", F.explode(choices).alias("w")).select("doc_id", "n_tokens", "w.window_id", "w.capacity").filter("capacity > 0")
    full, rest = F.floor(F.col("n_tokens") / F.col("capacity")).cast("int"), F.col("n_tokens") % F.col("capacity")
    # Every home holds a bounded number of items: of each document one rest, and full parts by their own count.
    n_docs, n_full = (docs.agg(F.count("*").alias("n"), F.sum(F.floor(F.col("n_tokens") / F.lit(min((c for _, c in sizes_of), default=1)))).alias("f")).collect()[0])
    homes, full_homes = max(1, -(-n_docs // per_partition)), max(1, -(-(n_full or 0) // per_partition))
    # The round is part of a home's number, so that homes of several rounds stay apart.
    slots = rounds + 2
    tag = lambda col, k: col * slots + k
    hashed = lambda n, *seed: F.pmod(F.xxhash64("doc_id", "part", *map(F.lit, seed)), F.lit(n))
    rests = items.filter((rest > 0) | (full == 0)).select("window_id", "capacity", "doc_id", full.alias("part"), rest.cast("int").alias("n_tokens"))
    current = cut(_pack(rests.withColumn("home", tag(hashed(homes), 0))))
    parts = items.filter(full > 0).select("window_id", "capacity", "doc_id", F.explode(F.sequence(F.lit(0), full - 1)).alias("part"), F.col("capacity").alias("n_tokens"))
    parts = parts.withColumn("home", tag(hashed(full_homes), rounds + 1))
    one = F.row_number().over(_by("window_id", "home").orderBy("doc_id", "part")).cast("bigint")
    parts = parts.withColumns({"bin": one - 1, "fill": F.col("capacity"), "n_bins": F.lit(0).cast("bigint"), "bound": F.lit(0).cast("bigint")})
    settled: list[DataFrame] = [parts]
    for k in range(1, rounds + 1):
        # What is proven best, and what is well filled, stays; the rest may be exchanged.
        open_ = (F.col("n_bins") > F.col("bound")) & (F.col("fill") < F.col("capacity") * (1 - release))
        loose = current.filter(open_)
        per = loose.groupBy("window_id").agg(F.count("*").alias("n"), F.countDistinct("home").alias("h")).collect()  # one row a window
        if not any(r["h"] > 1 for r in per):
            break
        fewer = max(1, -(-max(r["n"] for r in per) // per_partition))
        again = cut(_pack(loose.withColumn("home", tag(hashed(fewer, k), k))))
        old = loose.groupBy("window_id").agg(F.countDistinct("home", "bin").alias("old"))
        new = again.groupBy("window_id").agg(F.countDistinct("home", "bin").alias("new"))
        better = old.join(new, "window_id").filter("new < old").select("window_id")
        settled += [current.filter(~open_), loose.join(F.broadcast(better), "window_id", "left_anti")]
        current = again.join(F.broadcast(better), "window_id", "left_semi")
    done = current
    for part in settled:
        done = done.unionByName(part)
    place = F.row_number().over(_by("window_id", "home", "bin").orderBy(F.desc("n_tokens"), "doc_id", "part")) - 1
    numbered = done.withColumn("position", place.cast("int"))
    # Numbers from sums per home, so that no window runs over all containers.
    per_home = done.groupBy("window_id", "home").agg((F.max("bin") + 1).alias("n"))
    first = per_home.withColumn("first", F.sum("n").over(_by("window_id").orderBy("home").rowsBetween(_PRECEDING, -1)))
    out = numbered.join(first.select("window_id", "home", F.coalesce("first", F.lit(0)).alias("first")), ["window_id", "home"])
    return out.select("window_id", "doc_id", "part", "n_tokens", (F.col("first") + F.col("bin")).alias("container"), "position", (F.col("n_bins") <= F.col("bound")).alias("certified"))


def _by(*cols: str):
    from pyspark.sql import Window

    return Window.partitionBy(*cols)


_PRECEDING = -(2**63)


def packing_report(packed: DataFrame, windows: DataFrame) -> DataFrame:
    """Per window: items, tokens, containers, the volume bound, the dual-feasible bound over all of the window's items, the
    share of containers in partitions that are certified by themselves, and the share of unused space.

    The bound needs only how often each size occurs: at most as many rows a window as its capacity."""
    w = windows.select("window_id", "capacity_tokens")
    agg = packed.groupBy("window_id", "container").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"), F.min(F.col("certified").cast("int")).alias("c"))
    agg = agg.groupBy("window_id").agg(F.sum("n").alias("n_items"), F.sum("t").alias("n_tokens"), F.count("*").alias("n_containers"), F.round(F.avg("c"), 6).alias("certified"))
    sizes = packed.groupBy("window_id", "n_tokens").agg(F.count("*").alias("n")).join(F.broadcast(w), "window_id")

    def bound(table: pa.Table) -> pa.Table:
        b = lower_bound(table.column("n_tokens").to_numpy(), table.column("capacity_tokens")[0].as_py(), table.column("n").to_numpy())
        return pa.table({"window_id": table.column("window_id")[:1], "dff_bound": pa.array([b], pa.int64())})

    bounds = sizes.groupBy("window_id").applyInArrow(bound, "window_id bigint, dff_bound bigint")
    cap = F.col("capacity_tokens")
    return agg.join(F.broadcast(w), "window_id").join(bounds, "window_id").select(
        "window_id", cap, "n_items", "n_tokens", "n_containers", F.ceil(F.col("n_tokens") / cap).alias("volume_bound"), "dff_bound", "certified", F.round(1 - F.col("n_tokens") / (F.col("n_containers") * cap), 6).alias("unused")
    )
