"""Queries of the training-data operators, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import abuse, common, langid, leakage, mainbody, overlap, packing, pairs, personal, spam, structure

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return mainbody.main_body_blocks(table(spark, d, "warc_record")).select("record_id", "block_md5").distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlap.cross_split_overlaps(table(spark, d, "math_problem"))
    return pairs.select(pairs.id_a.alias("problem_id_a"), pairs.id_b.alias("problem_id_b"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    problems = table(spark, d, "math_problem")
    return overlap.overlap_report(problems, overlap.cross_split_overlaps(problems))


def _abuse(spark: SparkSession, d: str) -> DataFrame:
    return abuse.abuse_scores(table(spark, d, "wet_record"), table(spark, d, "labelled_line"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _abuse(spark, d).select("record_id", F.explode("categories").alias("category")).distinct()


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.abuse_rates(_abuse(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    stats = structure.text_statistics(table(spark, d, "wet_record"))
    return stats.filter("kind in ('list', 'table', 'junk')").select("record_id", "kind").distinct()


def p4_statistics(spark: SparkSession, d: str) -> DataFrame:
    return structure.text_statistics(table(spark, d, "wet_record"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.personal_items(table(spark, d, "wet_record")).select("record_id", "pii_type", "pii_text").distinct()


def p5_masked(spark: SparkSession, d: str) -> DataFrame:
    wet = table(spark, d, "wet_record")
    return personal.mask_items(wet, personal.personal_items(wet))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.pair_defects(table(spark, d, "sft_example")).filter("defect is not null").select("example_id", "defect").distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    got = langid.languages(table(spark, d, "wet_record")).filter("relabel")
    return got.select("record_id", F.explode("languages").alias("lang")).distinct()


def p7_segments(spark: SparkSession, d: str) -> DataFrame:
    got = langid.languages(table(spark, d, "wet_record"))
    return got.select("record_id", "lang", "confidence", F.posexplode_outer("segments").alias("segment", "s")).select(
        "record_id", "lang", "confidence", "segment", F.col("s.lang").alias("segment_lang"), F.col("s.confidence").alias("segment_confidence"), F.col("s.n_chars").alias("n_chars")
    )


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = common.cut(packing.token_sizes(table(spark, d, "documents")))
    return packing.pack(sizes, table(spark, d, "context_window"))


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).select("window_id", "doc_id", "part", "container", "position")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(_packed(spark, d), table(spark, d, "context_window"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(_leaks(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_scores(table(spark, d, "documents")).filter("spam").select("doc_id").distinct()


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_scores(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p2_found, p2_report, p3_found, p3_rates, p4_found, p4_statistics, p5_found, p5_masked, p6_found, p7_found, p7_segments, p8_pack, p8_report, p9_found, p9_report, p10_found, p10_scores)}
ORACLES: dict[str, str] = {}
