"""Quality rules and the cleaning funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T

# The common words that prose holds two of.
COMMON = ("the", "be", "to", "of", "and", "that", "have", "with")


def rule_columns(t: Column, w: Column, ln: Column, low: Column) -> dict[str, Column]:
    """The measures of the quality rules, from a text, its tokens, its lines and its lower-case form."""
    return {
        "n_words": F.size(w),
        "n_lines": F.size(ln),
        "word_chars": F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)),
        "n_ellipsis_lines": F.size(F.filter(ln, lambda x: x.contains("...") & T.strip(x).endswith("..."))),
        "n_alpha_words": F.size(F.filter(w, lambda x: x.rlike("[A-Za-z]"))),
        "n_hashes": T.occurrences(t, "#"),
        "n_ellipses": T.occurrences(t, "…"),
        "n_bullet_lines": F.size(F.filter(ln, lambda x: x.rlike(f"^{T.WS}*[-*•] "))),
        "n_common": sum((low.contains(f" {x} ") | low.startswith(f"{x} ") | low.endswith(f" {x}")).cast("int") for x in COMMON),
    }


def with_rules(df: DataFrame, text_col: str = "text", extended: bool = True, keep_words: bool = False) -> DataFrame:
    """Adds the measures and `failed`: the first rule that a text breaks, null where it breaks none (and for null texts,
    'null'). extended: also symbols, bullets and common words. Each ratio is guarded by the word-count rule before it."""
    t = F.col(text_col)
    # The split text is a column of its own, so that it is made once and not again in every measure.
    split = df.select("*", T.words(t).alias("_words"), T.lines(t).alias("_lines"), F.lower(t).alias("_low"))
    out = split.select("*", *[c.alias(k) for k, c in rule_columns(t, F.col("_words"), F.col("_lines"), F.col("_low")).items()])
    r = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    failed = F.when(F.col(text_col).isNull(), "null").when(~F.col("n_words").between(50, 100000), "word_count")
    mean = r("word_chars", "n_words")
    failed = failed.when((mean < 3) | (mean > 10), "word_length")
    failed = failed.when(r("n_ellipsis_lines", "n_lines") > 0.3, "ellipsis_lines").when(r("n_alpha_words", "n_words") < 0.8, "alpha_words")
    if extended:
        failed = failed.when(r("n_hashes", "n_words") > 0.1, "hashes").when(r("n_ellipses", "n_words") > 0.1, "ellipses")
        failed = failed.when(r("n_bullet_lines", "n_lines") > 0.9, "bullets").when(F.col("n_common") < 2, "common_words")
    out = out.withColumn("failed", failed).drop("_lines", "_low")
    return out if keep_words else out.drop("_words")


def gate(label: Column | str, score: Column | str, wanted: str, least: float) -> Column:
    """A classifier's gate: its label is the wanted one and its score at least so high."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return (c(label) == wanted) & (c(score) >= least)


def positive_example(lang: str, lang_score: str, nsfw: str, nsfw_score: str, toxic: str, toxic_score: str) -> Column:
    return gate(lang, lang_score, "en", 0.75) & gate(nsfw, nsfw_score, "non-nsfw", 0.98) & gate(toxic, toxic_score, "non-toxic", 0.98)


def negative_example(lang: str, lang_score: str, nsfw: str, nsfw_score: str, toxic: str, toxic_score: str, passes: Column) -> Column:
    """Not English, or unsurely so, or surely unsafe or toxic, or of low quality; a null answers nothing and drops the row."""
    c = F.col
    bad = (c(lang) != "en") | (c(lang_score) < 0.8) | ((c(nsfw) == "nsfw") & (c(nsfw_score) > 0.98)) | ((c(toxic) == "toxic") & (c(toxic_score) > 0.98)) | ~passes
    return F.coalesce(bad, F.lit(False))


def bernoulli(df: DataFrame, share: float, id_col: str, seed: int = 0) -> DataFrame:
    """A repeatable sample: rows whose hashed id falls under the share."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), F.col(id_col).cast("string"))), 1, 8), 16, 10).cast("bigint")
    return df.filter(h < int(share * (1 << 32)))


STAGES = ("s_text", "s_lang", "s_rules", "s_ratio")


def with_stages(df: DataFrame, text_col: str = "text", lang_col: str = "lang", lang: str = "en", least_ratio: float = 0.2) -> DataFrame:
    """Stage flags in the funnel's order; a stage is true only where all before it are."""
    t = F.col(text_col)
    out = with_rules(df, text_col, keep_words=True)
    s_text = F.coalesce(~T.is_blank(t), F.lit(False))
    s_lang = s_text & F.coalesce(F.col(lang_col) == lang, F.lit(False))
    s_rules = s_lang & F.col("failed").isNull()
    s_ratio = s_rules & (T.type_token_ratio("_words") >= least_ratio)
    return out.withColumns({"s_text": s_text, "s_lang": s_lang, "s_rules": s_rules, "s_ratio": s_ratio}).drop("_words")


def funnel(df: DataFrame, by: str = "source", **kw) -> DataFrame:
    """Counters of each stage by a column, and of all rows where it is '(all)'."""
    st = with_stages(df, **kw).select(F.coalesce(F.col(by), F.lit("(none)")).alias(by), *STAGES)
    sums = [F.count("*").alias("n_records"), *[F.sum(F.col(s).cast("int")).alias("n" + s[1:]) for s in STAGES]]
    per = st.groupBy(by).agg(*sums)
    total = per.agg(F.lit("(all)").alias(by), *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in per.columns[1:]])
    return per.unionByName(total)


#: Counters of the cleaning of files; the two gates of content are counted by name, yet no record is tested by them there.
COUNTERS = ("total_records", "http_responses", "extracted", "lang_ok", "nsfw_ok", "tox_ok", "gopher_ok", "quality_ok")


def cleaning(df: DataFrame, passes: Column, text_col: str = "text", lang: str = "identified", lang_score: str = "identified_score", quality: str = "quality", quality_score: str = "quality_score", least_lang: float = 0.9, least_quality: float = 0.95, least_ratio: float = 0.2) -> DataFrame:
    """Adds the flags extracted, lang_ok, gopher_ok, quality_ok in the order of the cleaning; each is true only where all
    before it are. passes: the basic rules. The gate of quality also asks for the least share of distinct words."""
    no = lambda c: F.coalesce(c, F.lit(False))
    extracted = no(~T.is_blank(F.col(text_col)))
    lang_ok = extracted & no(gate(lang, lang_score, "en", least_lang))
    gopher_ok = lang_ok & no(passes)
    quality_ok = gopher_ok & no(T.type_token_ratio(T.words(text_col)) >= least_ratio) & no(gate(quality, quality_score, "wiki", least_quality))
    return df.withColumns({"extracted": extracted, "lang_ok": lang_ok, "gopher_ok": gopher_ok, "quality_ok": quality_ok})


def cleaning_counts(flagged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The eight counters of the cleaning."""
    one = {"total_records": F.lit(1), "http_responses": F.lit(1), "nsfw_ok": F.lit(0), "tox_ok": F.lit(0)}
    sums = [F.coalesce(F.sum(one[k] if k in one else F.col(k).cast("int")), F.lit(0)).cast("bigint").alias(k) for k in COUNTERS]
    return flagged.groupBy(*(by or [])).agg(*sums)


def basic_rules(text_col: str = "text") -> Column:
    """The first tier of rules over word and punctuation tokens: their number, their mean length, lines that end in an
    ellipsis, and tokens with a letter. Null for null."""
    t = F.col(text_col)
    w, ln = T.word_tokens(t), T.lines(t)
    n = F.size(w)
    chars = F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x))
    dotted = F.size(F.filter(ln, lambda x: x.contains("...") & T.strip(x).endswith("...")))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return n.between(50, 100000) & ratio(chars, n).between(3, 10) & (ratio(dotted, F.size(ln)) <= 0.3) & (ratio(F.size(F.filter(w, lambda x: x.rlike("[A-Za-z]"))), n) >= 0.8)
