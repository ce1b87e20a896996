"""Sampling, batching and packing. Random choices are by hash of an id and a seed, so that they repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import let


def order_key(id_col: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), id_col.cast("string")))


def sample_k(df: DataFrame, k: int, id_col: str, seed: int = 42) -> DataFrame:
    """k rows, each subset as likely as another; all rows where k <= 0. A top-k, no full sort."""
    return df if k <= 0 else df.orderBy(order_key(F.col(id_col), seed), id_col).limit(k)


def batches(df: DataFrame, size: int, id_col: str) -> DataFrame:
    """Adds `batch` and `row`: rows in the order of their ids, in batches of a size. Row numbers come from counts of ranges of
    ids, not from one sorted partition."""
    from weftline.operators.common import cut

    s = cut(df.repartitionByRange(id_col).sortWithinPartitions(id_col).withColumn("_p", F.spark_partition_id()))
    counts = s.groupBy("_p").agg(F.count("*").alias("n"))
    first = counts.select("_p", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("_f"))  # one row a partition
    at = F.row_number().over(Window.partitionBy("_p").orderBy(id_col)) - 1 + F.col("_f")
    return s.join(F.broadcast(first), "_p").withColumn("row", at).withColumn("batch", F.floor(F.col("row") / size)).drop("_p", "_f")


def rollouts(df: DataFrame, n: int) -> DataFrame:
    """Each prompt n times, with its number."""
    return df.withColumn("rollout", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def _mask(sizes: Column) -> Column:
    p, n = sizes[0], sizes[0] + sizes[1] - 1
    at = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i >= p - 1)
    return F.when(n <= 0, F.array().cast("array<boolean>")).otherwise(at)


def prompt_response(prompt: Column, response: Column) -> dict[str, Column]:
    """Inputs, labels and mask of ids: all but the last, all but the first, true where the label is the response's."""
    full = F.concat(prompt, response)
    n = F.size(full)
    body = F.greatest(n - 1, F.lit(0))
    return {
        "input_ids": F.slice(full, F.lit(1), body),
        "labels": F.slice(full, F.lit(2), body),
        "response_mask": let(F.array(F.size(prompt), F.size(response)), _mask),
    }


def pad(x: Column, length: Column, value) -> Column:
    return F.concat(x, F.array_repeat(F.lit(value), F.greatest(length - F.size(x), F.lit(0)).cast("int")))


def collate(df: DataFrame, batch_col: str, columns: dict[str, object]) -> DataFrame:
    """Arrays padded to the longest of their batch, each column with its value."""
    longest = df.groupBy(batch_col).agg(*[F.max(F.size(c)).alias(f"_{c}") for c in columns])
    out = df.join(longest, batch_col)
    for c, v in columns.items():
        out = out.withColumn(c, pad(F.col(c), F.col(f"_{c}"), v))
    return out.drop(*[f"_{c}" for c in columns])


def windows(df: DataFrame, ids_col: str, id_col: str, length: int, n: int, seed: int = 0) -> DataFrame:
    """n training windows from each long enough sequence: inputs of a length and labels one further; starts by hash."""
    room = F.size(ids_col) - length
    out = df.filter(room > 0).withColumn("window", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), F.col(id_col).cast("string"), F.lit("-"), F.col("window").cast("string"))), 1, 8), 16, 10).cast("bigint")
    out = out.withColumn("start", F.pmod(h, room).cast("int"))
    return out.withColumns({"inputs": F.slice(F.col(ids_col), F.col("start") + 1, length), "targets": F.slice(F.col(ids_col), F.col("start") + 2, length)})
