"""All core queries and, where SQL can express them over whole tables, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import grading, html, pii
from weftline.functions import text as T
from weftline.operators import bpe, classify, dedup, joins, quality, rewards, sampling
from weftline.operators.common import cut, spread
from weftline.plans import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    """Registers a query under its name, and its SQL of the same name if there is one."""
    QUERIES[f.__name__] = f
    if s := getattr(sql, f.__name__.upper(), None):
        ORACLES[f.__name__] = s
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def texts(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table of texts, spread over the cores where its files are fewer."""
    return spread(table(spark, d, name))


def _r(c, n: int = 6):
    return F.round(c, n)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Mask, judge, drop repeated lines and count, by source."""
    docs = pii.mask_all(texts(spark, d, "documents")).select("doc_id", F.col("masked").alias("text"), "lang", "source")
    clean = dedup.drop_repeated_lines(docs).join(docs.drop("text"), "doc_id")
    return quality.funnel(clean)


# --- quality rules, FLT1-FLT10, AGG1

@query
def flt3_quality_rules(spark, d):
    cols = ["n_words", "n_lines", "word_chars", "n_ellipsis_lines", "n_alpha_words", "n_hashes", "n_ellipses", "n_bullet_lines", "n_common", "failed"]
    return quality.with_rules(texts(spark, d, "documents")).select("doc_id", *cols)


@query
def flt2_basic_rules(spark, d):
    """The basic rules over word and punctuation tokens."""
    w = T.word_tokens("text")
    return texts(spark, d, "documents").select("doc_id", F.size(w).alias("n_tokens"), quality.basic_rules().alias("passes"))


@query
def flt9_cleaning(spark, d):
    """The whole cleaning of plain-text records with its eight counters by source; the quality gate is the trained classifier."""
    lines = table(spark, d, "labelled_line").select("text", F.when(F.col("label") == "__label__clean", "positive").otherwise("negative").alias("label"))
    wet = classify.identify_language(texts(spark, d, "wet_record").select("record_id", "text", F.coalesce("source", F.lit("(none)")).alias("source")))
    scored = classify.predict_linear(classify.train_linear(lines), wet, out="q")
    scored = scored.withColumns({"quality": F.when(F.col("q") == "positive", "wiki").otherwise("cc"), "quality_score": F.col("q_score")})
    return quality.cleaning_counts(quality.cleaning(scored, quality.basic_rules()), ["source"])


@query
def flt7_type_token_ratio(spark, d):
    w = T.words("text")
    return texts(spark, d, "documents").select("doc_id", F.size(w).alias("n_words"), _r(T.type_token_ratio(w)).alias("ttr"))


@query
def flt9_funnel(spark, d):
    return quality.funnel(texts(spark, d, "documents"))


@query
def flt10_bernoulli_sample(spark, d):
    return quality.bernoulli(texts(spark, d, "documents"), 0.02, "doc_id", seed=1).select("doc_id")


def _with_content(spark, d, df):
    """Adds nsfw and toxic with their scores, each by a model of its own."""
    lines = table(spark, d, "labelled_line").select("text", T.strip_label("label").alias("l"))
    for kind in ("nsfw", "toxic"):
        model = classify.train_linear(lines.select("text", F.when(F.col("l") == kind, kind).otherwise(f"non-{kind}").alias("label")))
        df = classify.predict_linear(model, df, out=kind)
    return df


@query
def flt5_flt6_example_gates(spark, d):
    """Positive and negative training examples among the documents, by language, two content models and the rules."""
    x = classify.identify_language(texts(spark, d, "documents").select("doc_id", "text"))
    x = quality.with_rules(_with_content(spark, d, x))
    args = ("identified", "identified_score", "nsfw", "nsfw_score", "toxic", "toxic_score")
    return x.select("doc_id", F.coalesce(quality.positive_example(*args), F.lit(False)).alias("positive"), quality.negative_example(*args, F.col("failed").isNull()).alias("negative"))


@query
def cls1_language(spark, d):
    out = classify.identify_language(texts(spark, d, "documents"))
    return out.select("doc_id", "identified", _r("identified_score").alias("score"))


@query
def cls4_quality_classifier(spark, d):
    """A linear classifier of clean and other lines, trained on the labelled lines, over all documents."""
    lines = table(spark, d, "labelled_line").select("text", F.when(F.col("label") == "__label__clean", "positive").otherwise("negative").alias("label"))
    model = classify.train_linear(lines)
    got = classify.predict_linear(model, texts(spark, d, "documents").select("doc_id", "text"))
    return got.select("doc_id", F.when(F.col("predicted") == "positive", "wiki").otherwise("cc").alias("label"), _r("predicted_score").alias("score"))


@query
def cls2_cls3_nsfw_toxic(spark, d):
    got = _with_content(spark, d, texts(spark, d, "documents").select("doc_id", "text"))
    return got.select("doc_id", "nsfw", _r("nsfw_score").alias("nsfw_score"), "toxic", _r("toxic_score").alias("toxic_score"))


# --- masking and text, PII1-PII4, PRJ

@query
def pii_masks(spark, d):
    return pii.mask_all(texts(spark, d, "documents")).select("doc_id", "n_emails", "n_phones", "n_ips", F.md5("masked").alias("masked_md5"))


@query
def pii_wet_masks(spark, d):
    return pii.mask_all(texts(spark, d, "wet_record"), only_hits=True).select("record_id", "n_emails", "n_phones", "n_ips", "masked")


@query
def prj7_mask_contexts(spark, d):
    m = pii.mask_all(texts(spark, d, "wet_record"), only_hits=True)
    return m.select("record_id", F.posexplode(T.keyword_context("masked", r"\|\|\|(?:EMAIL_ADDRESS|PHONE_NUMBER|IP_ADDRESS)\|\|\|")).alias("nth", "context"))


@query
def prj_normal_forms(spark, d):
    return texts(spark, d, "documents").select(
        "doc_id", F.md5(T.newlines_to_blanks("text")).alias("blanks_md5"), F.md5(T.join_lines("text")).alias("joined_md5"),
        F.md5(T.collapse("text")).alias("collapsed_md5"), T.excerpt("text", 300).alias("excerpt"),
    )


@query
def prj1_html_text(spark, d):
    w = texts(spark, d, "warc_record").filter("warc_type = 'response'")
    return w.select("record_id", html.extract_detect("payload").alias("text"), html.extract_utf8_first("payload").alias("text_utf8_first"))


@query
def prj2_normalized(spark, d):
    return texts(spark, d, "documents").select("doc_id", F.md5(T.normalize("text", full=True)).alias("normal_md5"))


# --- deduplication, DUP1-DUP10

@query
def dup1_line_dedup(spark, d):
    return dedup.drop_repeated_lines(texts(spark, d, "documents")).select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query
def dup1_line_counts(spark, d):
    return dedup.line_counts(texts(spark, d, "documents")).filter("n > 1")


@query
def doc_exact_dedup(spark, d):
    return dedup.exact_classes(texts(spark, d, "documents"))


def _grams(spark, d):
    """Distinct normal texts of the documents with their shingles, under the smallest id."""
    norm = texts(spark, d, "documents").filter("text is not null").select("doc_id", T.normalize("text").alias("norm"))
    return cut(norm.groupBy("norm").agg(F.min("doc_id").alias("doc_id")).select("doc_id", T.ngrams(T.words("norm"), 5).alias("g")))


@query
def dup2_shingles(spark, d):
    return _grams(spark, d).select("doc_id", F.size("g").alias("n_shingles"))


@query
def dup4_signatures(spark, d):
    return _grams(spark, d).select("doc_id", F.array_join(dedup.signature(F.col("g"), 4), "|").alias("signature"))


@query
def dup6_lsh_candidates(spark, d):
    """Candidates of 10 bands of 2 hashes among distinct texts that have shingles."""
    sig = cut(_grams(spark, d).filter("size(g) > 0").select("doc_id", dedup.signature(F.col("g"), 20).alias("sig")))
    return dedup.candidate_pairs(dedup.bands(sig))


@query
def dup7_similar_pairs(spark, d):
    return dedup.similar_pairs(_grams(spark, d), "doc_id", "g").select("a", "b", _r("similarity").alias("similarity"))


def _altered(spark, d):
    """The documents, and each once more under another id with words at its end."""
    docs = texts(spark, d, "documents").select("doc_id", "text")
    return docs.unionByName(docs.filter("text is not null").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), F.concat("text", F.lit(" with an altered end")).alias("text")))


@query
def dup7_altered_pairs(spark, d):
    return dedup.text_pairs(_altered(spark, d))[1].select("a", "b", _r("similarity").alias("similarity"))


@query
def dup8_components(spark, d):
    return dedup.components(*dedup.text_pairs(_altered(spark, d)))


@query
def dup10_altered_duplicates(spark, d):
    return dedup.near_duplicates(_altered(spark, d))


@query
def dup10_minhash_classes(spark, d):
    return dedup.minhash_classes(_altered(spark, d))


@query
def dup10_near_duplicates(spark, d):
    return dedup.near_duplicates(texts(spark, d, "documents"))


# --- tokenizer, BPE1-BPE15

@query
def bpe4_pretoken_counts(spark, d):
    return bpe.pretoken_counts(texts(spark, d, "documents"))


@query
def bpe5_pair_counts(spark, d):
    return bpe.pair_counts(bpe.pretoken_counts(texts(spark, d, "documents")))


@query
def bpe6_best_pair(spark, d):
    return bpe.best_pair(bpe.pair_counts(bpe.pretoken_counts(texts(spark, d, "documents"))))


def _tokenizer(spark, d):
    vocab, merges = bpe.train(texts(spark, d, "documents"), 600)
    return bpe.Tokenizer(vocab, merges, ("<|endoftext|>",))


@query
def bpe7_merges(spark, d):
    _, merges = bpe.train(texts(spark, d, "documents"), 600)
    return spark.createDataFrame([(i, bytearray(a), bytearray(b)) for i, (a, b) in enumerate(merges)], "rank int, left_bytes binary, right_bytes binary")


@query
def bpe11_round_trip(spark, d):
    t = _tokenizer(spark, d)
    out = bpe.decode(bpe.encode(texts(spark, d, "documents"), t), t)
    return out.select("doc_id", F.size("ids").alias("n_ids"), (F.col("decoded") == F.col("text")).alias("same"))


@query
def bpe14_compression(spark, d):
    return bpe.compression(bpe.encode(texts(spark, d, "documents"), _tokenizer(spark, d)))


# --- answers, GRD1-GRD15, FLT12

@query
def grd5_tag_answers(spark, d):
    x = texts(spark, d, "sft_example")
    return x.select("example_id", grading.tag_answer(F.col("response")).alias("answer"), F.coalesce(grading.exact_answer(F.col("response"), F.col("ground_truth")), F.lit(False)).alias("exact"))


@query
def grd8_final_forms(spark, d):
    return table(spark, d, "math_problem").filter("answer is not null").select("problem_id", grading.final_normal(F.col("answer")).alias("final"))


@query
def grd9_number_forms(spark, d):
    """What the helpers of the second normal form make of each answer."""
    return table(spark, d, "math_problem").select("problem_id", grading.number_forms("answer").alias("n")).select("problem_id", "n.*")


@query
def grd6_grd7_normal_forms(spark, d):
    return table(spark, d, "math_problem").select("problem_id", grading.mathd_form("answer").alias("mathd"), grading.plain_form("answer").alias("plain"), grading.boxed_content("answer").alias("boxed"))


@query
def grd1_tagged_rewards(spark, d):
    x = texts(spark, d, "sft_example").filter("ground_truth is not null")
    return x.withColumn("r", grading.tagged_reward("response", "ground_truth")).select("example_id", "r.*")


@query
def grd2_boxed_rewards(spark, d):
    x = texts(spark, d, "sft_example").filter("ground_truth is not null")
    return x.withColumn("r", grading.boxed_reward("response", "ground_truth")).select("example_id", "r.*")


@query
def grd15_repetition(spark, d):
    return texts(spark, d, "sft_example").select("example_id", grading.repetitive("response").alias("repetitive"))


@query
def agg2_eval_summary(spark, d):
    """Accuracy and mean rewards of the graded examples."""
    graded = grd1_tagged_rewards(spark, d)
    ok = F.sum((F.col("answer_reward") >= 1).cast("int"))
    return graded.agg(F.count("*").alias("total"), ok.alias("correct"), _r(F.try_divide(ok, F.count("*"))).alias("accuracy"), _r(F.avg("reward")).alias("mean_reward"), _r(F.avg("format_reward")).alias("mean_format"))


@query
def flt12_exact_answers(spark, d):
    x = texts(spark, d, "sft_example")
    return x.filter(grading.exact_answer(F.col("response"), F.col("ground_truth"))).select("example_id", "ground_truth")


# --- rollouts: WIN1, AGG3-AGG9, FLT11, SRT, SMP9

def _unique_rollouts(spark, d):
    """Rows delivered twice count once."""
    return table(spark, d, "rollout").dropDuplicates(["rollout_id"])


@query
def win1_group_advantages(spark, d):
    r = _unique_rollouts(spark, d).select("rollout_id", "run_id", "step", "prompt_id", "reward")
    g = ["run_id", "step", "prompt_id"]
    a = rewards.advantages(r, g, by_std=False, out="centred")
    b = rewards.advantages(a, g, by_std=True)
    return b.select("rollout_id", _r("centred").alias("centred"), _r(F.nanvl("group_advantage", F.lit(None))).alias("group_advantage"))


@query
def agg8_reward_metadata(spark, d):
    m = rewards.reward_metadata(_unique_rollouts(spark, d), ["run_id", "step", "prompt_id"])
    return m.select(*[_r(c).alias(c) if c != "mean_advantage" else F.abs(_r(c)).alias(c) for c in m.columns])


@query
def agg3_validation_means(spark, d):
    out = rewards.validation_means(grd1_tagged_rewards(spark, d))
    return out.select(*[_r(c).alias(c) for c in out.columns])


@query
def agg3_run_means(spark, d):
    r = _unique_rollouts(spark, d)
    return r.groupBy("run_id").agg(F.count("*").alias("n"), _r(F.avg((F.col("reward") > 0).cast("int"))).alias("accuracy"), _r(F.avg("reward")).alias("mean_reward"))


@query
def agg4_success_rate(spark, d):
    """The tables hold no entropies: a hundredth of the length stands for one."""
    out = rewards.success_rate(_unique_rollouts(spark, d).withColumn("entropy", F.length("response") / 100), entropy="entropy", by=["run_id"])
    return out.withColumns({"success_rate": _r("success_rate"), "mean_entropy": _r("mean_entropy")})


@query
def agg5_length_summary(spark, d):
    out = rewards.length_summary(_unique_rollouts(spark, d), F.length("response"), F.col("reward") > 0, by=["run_id"])
    return out.select("run_id", *[_r(c).alias(c) for c in out.columns[1:]])


@query
def flt11_kept_rollouts(spark, d):
    return table(spark, d, "rollout").filter("reward > 0").select("rollout_id").distinct()


@query
def agg9_timing(spark, d):
    out = rewards.timing(table(spark, d, "events"), "value", ["event_type"])
    return out.select("event_type", *[_r(c, 4).alias(c) for c in ("mean", "variance", "deviation")])


@query
def agg10_agg11_shares(spark, d):
    e = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum("l_discount").alias("a"), F.sum("l_quantity").alias("b"), F.sum(F.when(F.col("l_quantity") < 0, F.col("l_quantity"))).alias("none"))
    return e.select("l_returnflag", _r(F.try_divide("a", "b") * 100).alias("share"), _r(rewards.speed_up(F.col("b"), F.col("a")), 4).alias("speed_up"), F.isnan(rewards.speed_up(F.col("a"), F.col("none"))).alias("is_nan"))


@query
def srt2_best_rollout(spark, d):
    r = _unique_rollouts(spark, d).filter("reward is not null")
    return r.groupBy("run_id").agg(F.max_by("rollout_id", F.struct(F.col("reward"), -F.col("rollout_id"))).alias("best"), F.max("reward").alias("reward"))


# --- arrays: AGG12-AGG15, RLN1-RLN9, SMP5-SMP8, WIN2-WIN3

def _arrays(spark, d):
    """Arrays of numbers: the dimensions of embeddings as log-probabilities."""
    e = table(spark, d, "embeddings")
    x = F.transform("embedding", lambda v: v.cast("double"))
    return e.select("vec_id", "label", x.alias("x"), F.transform(x, lambda v: v * 0.9).alias("old"), F.transform(x, lambda v: v > 0).alias("mask"), (F.col("label") - 4.5).alias("advantage"))


@query
def agg12_masked_means(spark, d):
    a = _arrays(spark, d)
    return a.select("vec_id", _r(rewards.masked_mean(F.col("x"), F.col("mask"))).alias("masked_mean"), _r(rewards.masked_normalize(F.col("x"), F.col("mask"), 10.0)).alias("normalized"))


@query
def rln2_clip_loss(spark, d):
    a = _arrays(spark, d)
    l = rewards.loss("grpo_clip", F.col("x"), advantage=F.col("advantage"), old=F.col("old"), eps=0.05)
    c = rewards.clipped(F.col("x"), F.col("old"), F.col("advantage"), 0.05)
    return a.select("vec_id", _r(rewards.masked_mean(l, F.col("mask"))).alias("loss"), F.size(F.filter(c, lambda v: v)).alias("n_clipped"), _r(rewards.masked_mean(rewards.naive_loss(F.col("x"), F.col("advantage")), F.col("mask"))).alias("naive"))


@query
def rln2_clip_metadata(spark, d):
    out = rewards.clip_metadata(_arrays(spark, d), "x", "old", "advantage", 0.05)
    return out.select(*[_r(c).alias(c) for c in out.columns])


@query
def rln4_microbatch(spark, d):
    a = _arrays(spark, d).withColumn("loss", rewards.naive_loss(F.col("x"), F.col("advantage")))
    out = rewards.microbatch_loss(a, "loss", "mask", 4)
    return out.select(_r("batch_loss").alias("batch_loss"), _r("scaled_loss").alias("scaled_loss"))


@query
def rln5_sft_loss(spark, d):
    return rewards.sft_loss(_arrays(spark, d), "x", "mask", 2.0, 4).select(_r("loss").alias("loss"))


@query
def rln6_log_softmax(spark, d):
    a = _arrays(spark, d)
    return a.select("vec_id", _r(rewards.log_softmax_at(F.col("x"), F.col("label"))).alias("log_softmax"), _r(rewards.token_entropy(F.col("x"))).alias("entropy"), _r(rewards.chosen_entropy(F.col("x"))).alias("chosen_entropy"), _r(F.array_max(rewards.softmax(F.col("x")))).alias("top_p"))


@query
def rln7_learning_rate(spark, d):
    return table(spark, d, "grpo_run").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(115), F.lit(5)))).select("run_id", "step", _r(rewards.learning_rate(F.col("step"), 1.0, 0.1, 10, 100)).alias("factor"))


@query
def rln9_attention(spark, d):
    """Softmax-weighted mean of the second dimension by label, weights from the first."""
    e = _arrays(spark, d).select("label", F.col("x")[0].alias("s"), F.col("x")[1].alias("v"))
    out = rewards.online_softmax(e, ["label"], "s", "v")
    return out.select("label", _r("attended").alias("attended"), _r("log_sum_exp").alias("log_sum_exp"))


@query
def win3_top_p(spark, d):
    """Of each language's sources the most frequent up to half of its documents."""
    n = texts(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("lang"))).withColumn("source", F.coalesce("source", F.lit("")))
    out = rewards.top_p(p, 0.5, by=["lang"], order="source")
    return out.select("lang", "source", "n", _r("renormalized").alias("renormalized"))


@query
def smp6_prompt_response(spark, d):
    """Byte values of prompts and responses as ids."""
    x = texts(spark, d, "sft_example").filter("prompt is not null and response is not null")
    ids = lambda c: F.when(F.col(c) == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(F.col(c), ""), lambda ch: F.ascii(ch)))
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, v: a + v)
    cols = sampling.prompt_response(ids("prompt"), ids("response"))
    return x.select("example_id", F.size(cols["input_ids"]).alias("n_input"), F.size(F.filter(cols["response_mask"], lambda m: m)).alias("n_response"), total(cols["labels"]).alias("label_sum"), total(F.zip_with(cols["labels"], cols["response_mask"], lambda v, m: F.when(m, v).otherwise(0))).alias("response_label_sum"))


@query
def smp7_collate(spark, d):
    """Batches of eight rows by id, each array padded to its batch's longest."""
    x = texts(spark, d, "sft_example").filter("response is not null").select("example_id", F.floor(F.col("example_id") / 8).alias("batch"), F.transform(T.words("response"), lambda w: F.length(w)).alias("ids"))
    out = sampling.collate(x, "batch", {"ids": 0})
    return out.select("example_id", "batch", F.size("ids").alias("padded"), F.aggregate("ids", F.lit(0), lambda a, v: a + v).alias("total"))


@query
def smp5_windows(spark, d):
    x = texts(spark, d, "documents").filter("text is not null").select("doc_id", F.transform(T.words("text"), lambda w: F.length(w)).alias("ids"))
    out = sampling.windows(x, "ids", "doc_id", 16, 2)
    return out.select("doc_id", "window", "start", F.aggregate("inputs", F.lit(0), lambda a, v: a + v).alias("inputs"), F.aggregate("targets", F.lit(0), lambda a, v: a + v).alias("targets"))


@query
def smp1_sample_k(spark, d):
    return sampling.sample_k(texts(spark, d, "documents"), 10, "doc_id").select("doc_id")


@query
def smp8_batches(spark, d):
    out = sampling.batches(table(spark, d, "math_problem").select("problem_id"), 64, "problem_id")
    return out.select("problem_id", F.col("row").cast("bigint").alias("row"), F.col("batch").cast("bigint").alias("batch"))


@query
def smp9_rollout_plan(spark, d):
    """Prompts of every run's group size, with the template filled."""
    p = table(spark, d, "math_problem").filter("split = 'test' and problem is not null").select("problem_id", T.fill_template("Q: {question}\nA:", question="problem").alias("prompt"))
    return sampling.rollouts(p, 8).select("problem_id", F.md5("prompt").alias("prompt_md5"), "rollout")


# --- joins and sets, JOI1-JOI8, SET1-SET3, AGG6

@query
def joi1_uri_match(spark, d):
    wet = texts(spark, d, "wet_record").select("record_id", "target_uri")
    warc = texts(spark, d, "warc_record").filter("warc_type = 'response'").select("target_uri", F.col("record_id").alias("warc_id"))
    return joins.first_match(wet, warc, "target_uri", "warc_id").select("record_id", F.col("right_warc_id").alias("warc_id"))


@query
def joi1_first_rollout(spark, d):
    """Each problem with its first rollout."""
    r = table(spark, d, "rollout").select(F.col("prompt_id").alias("problem_id"), "rollout_id")
    return joins.first_match(table(spark, d, "math_problem").select("problem_id"), r, "problem_id", "rollout_id").select("problem_id", F.col("right_rollout_id").alias("first_rollout"))


@query
def joi4_joi8_membership(spark, d):
    """Problems that some rollout answers, and those that none does."""
    p, r = table(spark, d, "math_problem").select("problem_id"), table(spark, d, "rollout").select(F.col("prompt_id").alias("problem_id"))
    a = joins.keep(p, r, "problem_id").withColumn("answered", F.lit(True))
    return a.unionByName(joins.not_done(p, r, "problem_id").withColumn("answered", F.lit(False)))


@query
def joi6_prompt_output(spark, d):
    r = _unique_rollouts(spark, d).join(table(spark, d, "math_problem").select(F.col("problem_id").alias("prompt_id"), "answer"), "prompt_id")
    return r.select("rollout_id", (F.col("true_answer").eqNullSafe(F.col("answer"))).alias("same_answer"))


@query
def joi7_state_difference(spark, d):
    """Orders whose total and line sum differ."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("v"))
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice")).cast("double").alias("v"))
    out = joins.state_difference(o, s, "o_orderkey", "v", 0.01)
    return out.select("o_orderkey", _r("a", 2).alias("a"), _r("b", 2).alias("b"))


@query
def set1_shared_words(spark, d):
    p = texts(spark, d, "sft_example").filter("prompt is not null and response is not null")
    a, b = F.array_distinct(T.words("prompt")), F.array_distinct(T.words("response"))
    return p.select("example_id", F.size(F.array_intersect(a, b)).alias("n_both"), F.size(F.array_union(a, b)).alias("n_any"), _r(dedup.jaccard(a, b)).alias("jaccard"))


@query
def agg6_row_counts(spark, d):
    names = ("documents", "warc_record", "wet_record", "math_problem", "sft_example", "rollout", "eval_item", "labelled_line")
    return dedup.union_all([table(spark, d, n).agg(F.lit(n).alias("table_name"), F.count("*").alias("n_rows")) for n in names])


@query
def snk2_label_lines(spark, d):
    x = table(spark, d, "labelled_line")
    return x.select("line_id", F.when(F.col("label") == "__label__clean", T.label_line("positive", "text")).otherwise(T.label_line("negative", "text", False)).alias("line"))
