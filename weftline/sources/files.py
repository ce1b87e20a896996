"""Other sources and the sinks: text files, JSON lines, delimited corpora, raw token shards, vocabularies."""

from __future__ import annotations

import io
import json
import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from weftline.functions import text as T


def read_text_files(spark: SparkSession, path: str, errors: str = "replace") -> DataFrame:
    """(path, text), one row a file, any newline as \\n. errors: 'replace' puts U+FFFD for bad bytes, 'ignore' drops them."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")

    @F.pandas_udf(StringType())
    def decode(b: pd.Series) -> pd.Series:
        return b.map(lambda x: bytes(x).decode("utf-8", errors).replace("\r\n", "\n").replace("\r", "\n"))

    return raw.select("path", decode("content").alias("text"))


def read_jsonl(spark: SparkSession, path: str, schema: str, skip_blank: bool = True) -> DataFrame:
    """JSON lines by an explicit schema. A bad line fails; a blank one is skipped, or fails as well."""
    lines = spark.read.text(path)
    blank = F.regexp_replace("value", r"\s", "") == ""
    # A blank line is no JSON: it is given to the parser as an object that never ends.
    lines = lines.filter(~blank) if skip_blank else lines.select(F.when(blank, F.lit("{")).otherwise(F.col("value")).alias("value"))
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")


def read_token_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(file, ids) of .npy files with one-dimensional arrays of integers."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def ids(b: pd.Series) -> pd.Series:
        return b.map(lambda x: np.load(io.BytesIO(bytes(x)), allow_pickle=False).ravel().astype(np.int32))

    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), ids("content").alias("ids"))


def read_logs(spark: SparkSession, path: str, suffix: str = ".out") -> DataFrame:
    """(file, pos, line) of the files of a folder with a suffix; lines in their order within a file."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter=f"*{suffix}").select(F.input_file_name().alias("file"), "value")
    return raw.select("file", F.posexplode(T.lines("value")).alias("pos", "line"))


def write_results(df: DataFrame, path: str, truth: str, answer: str, full: str, metrics: list[str]) -> None:
    """JSON lines with the keys ground_truth, answer, full answer and metrics."""
    df.select(F.col(truth).alias("ground_truth"), F.col(answer).alias("answer"), F.col(full).alias("full answer"), F.struct(*metrics).alias("metrics")).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A small result as one file of JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


def append_metrics(df: DataFrame, path: str, step: int) -> None:
    """Each column of a one-row result as a row (step, key, value) of a table that grows."""
    cols = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in df.columns])
    df.select(F.lit(step).alias("step"), F.explode(cols).alias("m")).select("step", "m.*").write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_surviving(files: DataFrame, survivors: DataFrame, path: str, path_col: str = "path", text_col: str = "text") -> None:
    """The texts of the surviving files, one line each under its base name; of equal names the last by path."""
    kept = files.join(survivors.select(path_col).distinct(), path_col, "left_semi").withColumn("name", F.substring_index(path_col, "/", -1))
    kept.groupBy("name").agg(F.max_by(text_col, path_col).alias("text")).write.mode("overwrite").json(path)


def read_delimited(spark: SparkSession, path: str, delimiter: str = "<|endoftext|>") -> DataFrame:
    """(text), one row for each document of files that hold many; splits inside a document neither lose nor repeat it."""
    return spark.read.option("lineSep", delimiter).text(path).select(F.col("value").alias("text")).filter(~T.is_blank("text"))


def task_groups(files: DataFrame, size: int = 4, path_col: str = "path") -> DataFrame:
    """Files in order, in groups of a fixed size: task k has files [size*k, size*k + size). Meant for file lists."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.orderBy(path_col)) - 1
    return files.withColumn("task", F.floor(n / size).cast("int"))


def write_lines(df: DataFrame, path: str, text_col: str = "text") -> None:
    """One document a line."""
    df.select(T.newlines_to_blanks(text_col).alias("value")).write.mode("overwrite").text(path)


def write_label_lines(df: DataFrame, path: str, label: str, text_col: str = "text", collapse: bool = True) -> None:
    df.select(T.label_line(label, text_col, collapse).alias("value")).write.mode("overwrite").text(path)


def write_token_shards(df: DataFrame, path: str, shard_col: str = "shard", ids_col: str = "ids", order_col: str = "pos") -> DataFrame:
    """Raw little-endian 16-bit shards <shard>.bin of the ids in order, written by the tasks into a shared folder. Ids
    beyond 65535 fail. Returns (shard, file, n_tokens)."""
    os.makedirs(path, exist_ok=True)

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.concatenate([np.asarray(x, np.int64) for x in pdf.sort_values(order_col)[ids_col]] or [np.zeros(0, np.int64)])
        if len(ids) and (ids.min() < 0 or ids.max() > 65535):
            raise ValueError("token id outside 16 bits")
        name = os.path.join(path, f"{int(key[0]):05d}.bin")
        ids.astype("<u2").tofile(name + ".part")
        os.replace(name + ".part", name)  # a repeated task writes the same file again
        return pd.DataFrame({"shard": [int(key[0])], "file": [name], "n_tokens": [len(ids)]})

    return df.groupBy(shard_col).applyInPandas(write, "shard int, file string, n_tokens bigint")


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """(file, ids) of raw 16-bit shards; an empty file gives no row."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def ids(b: pd.Series) -> pd.Series:
        return b.map(lambda x: np.frombuffer(bytes(x), "<u2").astype(np.int32))

    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), ids("content").alias("ids"))


def write_corpus_shards(df: DataFrame, tokenizer, path: str, n_shards: int, id_col: str = "doc_id", text_col: str = "text", eos: int | None = None) -> DataFrame:
    """A corpus as ordered token shards: texts are encoded and written by ranges of ids, so that the shards one after another
    hold the documents in the order of their ids. Returns (shard, file, n_tokens). Null texts are left out."""
    from weftline.operators.bpe import encode

    ids = encode(df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("pos"), F.col(text_col).alias("text")), tokenizer, eos=eos)
    ranged = ids.repartitionByRange(n_shards, "pos").withColumn("shard", F.spark_partition_id())
    return write_token_shards(ranged.select("shard", "pos", "ids"), path)


def concat_shards(files: list[str], out: str) -> int:
    """Shards appended in the order of their names; returns the bytes written."""
    n = 0
    with open(out, "wb") as f:
        for name in sorted(files):
            with open(name, "rb") as g:
                while block := g.read(1 << 20):
                    n += f.write(block)
    return n


def printable(token: bytes) -> str:
    try:
        return repr(token.decode("utf-8"))[1:-1]
    except UnicodeDecodeError:
        return f"<bytes: {list(token)}>"


def save_tokenizer(vocab: dict[int, bytes], merges: list[tuple[bytes, bytes]], path: str) -> None:
    item = lambda b: {"bytes": list(b), "string": printable(b)}
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "vocab.json"), "w", encoding="utf-8") as f:
        json.dump({str(k): item(v) for k, v in vocab.items()}, f, ensure_ascii=False, indent=1)
    with open(os.path.join(path, "merges.json"), "w", encoding="utf-8") as f:
        json.dump([{"first": item(a), "second": item(b)} for a, b in merges], f, ensure_ascii=False, indent=1)


def load_tokenizer(path: str) -> tuple[dict[int, bytes], list[tuple[bytes, bytes]]]:
    with open(os.path.join(path, "vocab.json"), encoding="utf-8") as f:
        vocab = {int(k): bytes(v["bytes"]) for k, v in json.load(f).items()}
    with open(os.path.join(path, "merges.json"), encoding="utf-8") as f:
        return vocab, [(bytes(m["first"]["bytes"]), bytes(m["second"]["bytes"])) for m in json.load(f)]
