"""Masking of e-mail addresses, phone numbers and IP addresses by pattern; each also counts what it masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and masks.
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
PHONE = r"(?<!\p{Nd})(?:\+?1[\s.-]?)?(?:\(?\p{Nd}{3}\)?[\s.-]?)\p{Nd}{3}[\s.-]?\p{Nd}{4}(?!\p{Nd})"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP = rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b"
EMAIL_MASK, PHONE_MASK, IP_MASK = "|||EMAIL_ADDRESS|||", "|||PHONE_NUMBER|||", "|||IP_ADDRESS|||"


def mask_emails(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL, EMAIL_MASK)


def mask_phone_numbers(text: Column) -> Column:
    return F.regexp_replace(text, PHONE, PHONE_MASK)


def mask_ips(text: Column) -> Column:
    return F.regexp_replace(text, IP, IP_MASK)


def mask_all(df: DataFrame, text_col: str = "text", only_hits: bool = False) -> DataFrame:
    """Adds masked, n_emails, n_phones, n_ips and n_masked. Masks are set in this order, each on the result of the one
    before. With only_hits, rows without a mask are dropped. A null text gives nulls."""
    t = F.col(text_col)
    out = df.withColumn("n_emails", F.regexp_count(t, F.lit(EMAIL))).withColumn("masked", mask_emails(t))
    out = out.withColumn("n_phones", F.regexp_count("masked", F.lit(PHONE))).withColumn("masked", mask_phone_numbers(F.col("masked")))
    out = out.withColumn("n_ips", F.regexp_count("masked", F.lit(IP))).withColumn("masked", mask_ips(F.col("masked")))
    out = out.withColumn("n_masked", F.col("n_emails") + F.col("n_phones") + F.col("n_ips"))
    return out.filter("n_masked > 0") if only_hits else out
