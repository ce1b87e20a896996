"""Group statistics of rewards, summaries of evaluations, and the arithmetic of policy gradients.

Arrays of one row are handled by higher-order functions in the JVM. NaN stands where a mean has nothing to average, as
distinct from null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import let


def _nan() -> Column:
    return F.lit(float("nan"))


def advantages(df: DataFrame, group: list[str], reward: str = "reward", by_std: bool = True, eps: float = 1e-6, out: str = "group_advantage") -> DataFrame:
    """Reward less the group's mean, over its sample deviation plus eps if by_std. A group of one has no deviation: NaN.

    Statistics come from a partial aggregation that is joined back, so that a group that holds a third of all rows is
    never gathered in one task."""
    stats = df.groupBy(*group).agg(F.avg(reward).alias("_m"), F.stddev_samp(reward).alias("_s"))
    on = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in group]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    j = df.alias("l").join(stats.alias("r"), cond, "left")
    diff = F.col(f"l.{reward}") - F.col("r._m")
    value = diff / (F.coalesce(F.col("r._s"), _nan()) + eps) if by_std else diff
    return j.select("l.*", value.alias(out))


def reward_metadata(df: DataFrame, group: list[str], reward: str = "reward", by_std: bool = True, eps: float = 1e-6) -> DataFrame:
    """One row: mean, deviation and range of the rewards and of the advantages, mean of the groups' means, and their
    deviations' mean and range. Null rewards are left out; groups of one have no advantage.

    All of it follows from each group's count, mean and deviation, so that rows are aggregated once and joined to nothing."""
    g = df.filter(F.col(reward).isNotNull()).groupBy(*group).agg(
        F.count("*").alias("n"), F.avg(reward).alias("m"), F.stddev_samp(reward).alias("s"), F.min(reward).alias("lo"), F.max(reward).alias("hi"), F.sum(reward).alias("t")
    )
    n, m, s = F.col("n"), F.col("m"), F.col("s")
    inside = (n - 1) * F.coalesce(s, F.lit(0.0)) * F.coalesce(s, F.lit(0.0))
    several = n > 1
    scaled = F.when(several, inside / ((s + eps) * (s + eps)) if by_std else inside)
    # What is left of the sum of a group beside its mean: nothing but rounding.
    rest = F.when(several, (F.col("t") - n * m) / (s + eps) if by_std else F.col("t") - n * m)
    g = g.select("*", inside.alias("q"), scaled.alias("a"), rest.alias("d"))
    total = F.sum("n")
    mean = F.try_divide(F.sum(n * m), total)
    n_adv = F.sum(F.when(several, n)) if by_std else total
    return g.agg(
        mean.alias("mean_reward"),
        F.sqrt(F.greatest(F.try_divide(F.sum("q") + F.sum(n * m * m) - total * mean * mean, total - 1), F.lit(0.0))).alias("std_reward"),
        F.min("lo").alias("min_reward"), F.max("hi").alias("max_reward"),
        F.try_divide(F.sum("d"), n_adv).alias("mean_advantage"), F.sqrt(F.try_divide(F.sum("a"), n_adv - 1)).alias("std_advantage"),
        F.avg("m").alias("mean_group_mean"), F.avg("s").alias("mean_group_std"), F.min("s").alias("min_group_std"), F.max("s").alias("max_group_std"),
    )


def accuracy(df: DataFrame, correct: Column, by: list[str] | None = None) -> DataFrame:
    """total, correct, accuracy (null for no rows)."""
    c = F.coalesce(correct, F.lit(False)).cast("int")
    return df.groupBy(*(by or [])).agg(F.count("*").alias("total"), F.coalesce(F.sum(c), F.lit(0)).alias("correct")).withColumn("accuracy", F.try_divide("correct", "total"))


def validation_means(df: DataFrame, reward: str = "reward", format_reward: str = "format_reward", answer_reward: str = "answer_reward") -> DataFrame:
    return df.agg(F.avg((F.col(reward) > 0).cast("int")).alias("accuracy"), F.avg(reward).alias("mean_reward"), F.avg(format_reward).alias("mean_format"), F.avg(answer_reward).alias("mean_answer"))


def success_rate(df: DataFrame, reward: str = "reward", entropy: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Kept over generated (0 for none) and the mean entropy of the rows that have one."""
    kept = F.coalesce(F.sum((F.col(reward) > 0).cast("int")), F.lit(0))
    cols = [F.count("*").alias("n_generated"), kept.alias("n_kept")]
    if entropy:
        cols.append(F.avg(entropy).alias("mean_entropy"))
    return df.groupBy(*(by or [])).agg(*cols).withColumn("success_rate", F.coalesce(F.try_divide("n_kept", "n_generated"), F.lit(0.0)))


def length_summary(df: DataFrame, length: Column, correct: Column, by: list[str] | None = None) -> DataFrame:
    """Mean lengths overall, of correct and of incorrect rows; 0 where there are none."""
    ok = F.coalesce(correct, F.lit(False))
    mean = lambda c, n: F.coalesce(F.avg(c), F.lit(0.0)).alias(n)
    return df.groupBy(*(by or [])).agg(mean(length, "mean_length"), mean(F.when(ok, length), "mean_length_correct"), mean(F.when(~ok, length), "mean_length_incorrect"))


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def _where(x: Column, mask: Column) -> Column:
    return F.zip_with(x, mask, lambda v, m: F.when(m, v).otherwise(F.lit(0.0)))


def masked_mean(x: Column, mask: Column) -> Column:
    n = F.size(F.filter(mask, lambda m: m))
    return F.when(n > 0, _sum(_where(x, mask)) / n).otherwise(_nan())


def masked_normalize(x: Column, mask: Column, divisor: float) -> Column:
    return _sum(_where(x, mask)) / divisor


def chosen_entropy(log_probs: Column) -> Column:
    """Less the mean of the chosen tokens' log-probabilities; null for none."""
    return -F.try_divide(_sum(log_probs), F.size(log_probs))


def log_sum_exp(x: Column) -> Column:
    return let(F.array_max(x), lambda m: m + F.log(_sum(F.transform(x, lambda v: F.exp(v - m)))))


def softmax(x: Column) -> Column:
    return let(log_sum_exp(x), lambda z: F.transform(x, lambda v: F.exp(v - z)))


def token_entropy(logits: Column) -> Column:
    """Entropy of the distribution of logits."""
    return let(log_sum_exp(logits), lambda z: -_sum(F.transform(logits, lambda v: F.exp(v - z) * (v - z))))


def log_softmax_at(logits: Column, index: Column) -> Column:
    return F.element_at(logits, index + 1) - log_sum_exp(logits)


def naive_loss(log_probs: Column, advantage: Column) -> Column:
    return F.transform(log_probs, lambda v: -advantage * v)


def clip_loss(log_probs: Column, old: Column, advantage: Column, eps: float) -> Column:
    """Per token -min(r A, clip(r, 1 - eps, 1 + eps) A) with r = exp(new - old)."""
    return F.zip_with(log_probs, old, lambda a, b: -F.least(F.exp(a - b) * advantage, F.greatest(F.least(F.exp(a - b), F.lit(1 + eps)), F.lit(1 - eps)) * advantage))


def clipped(log_probs: Column, old: Column, advantage: Column, eps: float) -> Column:
    """Per token whether the clipped term is the smaller one."""
    return F.zip_with(log_probs, old, lambda a, b: F.greatest(F.least(F.exp(a - b), F.lit(1 + eps)), F.lit(1 - eps)) * advantage < F.exp(a - b) * advantage)


def clip_metadata(df: DataFrame, log_probs: str, old: str, advantage: str, eps: float) -> DataFrame:
    """One row over all tokens: the share of clipped ones, and mean, sample deviation and range of the ratios and of their logarithms."""
    tokens = df.select(F.col(advantage).alias("a"), F.explode(F.arrays_zip(F.col(log_probs).alias("x"), F.col(old).alias("y"))).alias("p")).select("a", (F.col("p.x") - F.col("p.y")).alias("l"))
    r = F.exp("l")
    less = F.greatest(F.least(r, F.lit(1 + eps)), F.lit(1 - eps)) * F.col("a") < r * F.col("a")
    return tokens.agg(
        F.avg(less.cast("int")).alias("clipped_fraction"), F.avg(r).alias("ratio_mean"), F.stddev_samp(r).alias("ratio_std"), F.min(r).alias("ratio_min"), F.max(r).alias("ratio_max"),
        F.avg("l").alias("log_ratio_mean"), F.stddev_samp("l").alias("log_ratio_std"),
    )


def loss(kind: str, log_probs: Column, reward: Column | None = None, advantage: Column | None = None, old: Column | None = None, eps: float | None = None) -> Column:
    """Per-token loss by kind; what a kind needs must be given."""
    need = {"no_baseline": ("reward",), "reinforce_with_baseline": ("advantage",), "grpo_clip": ("advantage", "old", "eps")}
    if kind not in need:
        raise ValueError(f"unknown loss {kind!r}")
    given = {"reward": reward, "advantage": advantage, "old": old, "eps": eps}
    if missing := [k for k in need[kind] if given[k] is None]:
        raise ValueError(f"{kind} needs {', '.join(missing)}")
    if kind == "no_baseline":
        return naive_loss(log_probs, reward)
    if kind == "reinforce_with_baseline":
        return naive_loss(log_probs, advantage)
    return clip_loss(log_probs, old, advantage, eps)


def microbatch_loss(df: DataFrame, loss_col: str, mask_col: str, accumulation: int = 1) -> DataFrame:
    """Mean over examples of the masked mean of their losses, and the same over the accumulation steps."""
    m = masked_mean(F.col(loss_col), F.col(mask_col))
    return df.agg(F.avg(m).alias("batch_loss"), (F.avg(m) / accumulation).alias("scaled_loss"))


def sft_loss(df: DataFrame, log_probs: str, mask: str, constant: float = 1.0, accumulation: int = 1) -> DataFrame:
    s = _sum(_where(F.col(log_probs), F.col(mask)))
    return df.agg((-F.sum(s) / constant / F.count("*") / accumulation).alias("loss"))


def learning_rate(step: Column, peak: float, floor: float, warm_up: int, total: int) -> Column:
    """Linear warm-up, half a cosine, then the floor."""
    part = (step - warm_up) / (total - warm_up)
    return F.when(step < warm_up, step / warm_up * peak).when(step < total, floor + 0.5 * (1 + F.cos(part * F.pi())) * (peak - floor)).otherwise(F.lit(floor))


def top_p(df: DataFrame, p: float, prob: str = "p", by: list[str] | None = None, order: str | None = None) -> DataFrame:
    """The most probable rows up to and including the first whose running sum exceeds p, with probabilities over their sum.
    Ties by the order column. The window runs within `by`; without it the rows are one distribution."""
    w = Window.partitionBy(*(by or [])).orderBy(F.desc(prob), *([order] if order else [])).rowsBetween(Window.unboundedPreceding, 0)
    kept = df.withColumn("_c", F.sum(prob).over(w)).filter(F.col("_c") - F.col(prob) <= p).drop("_c")
    return kept.withColumn("renormalized", F.col(prob) / F.sum(prob).over(Window.partitionBy(*(by or []))))


def online_softmax(df: DataFrame, by: list[str], score: str, value: str) -> DataFrame:
    """Softmax-weighted mean of values by group, from running maximum, sum and weighted sum that merge in any order: the
    maximum first, then two sums; both aggregate before the shuffle."""
    m = df.groupBy(*by).agg(F.max(score).alias("_m"))
    w = F.exp(F.col(score) - F.col("_m"))
    return df.join(m, by).groupBy(*by).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("attended"), (F.max("_m") + F.log(F.sum(w))).alias("log_sum_exp"))


def timing(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Mean with population variance and deviation."""
    return df.groupBy(*(by or [])).agg(F.avg(value).alias("mean"), F.var_pop(value).alias("variance"), F.stddev_pop(value).alias("deviation"))


def share_of(df: DataFrame, part: str, whole: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg((F.try_divide(F.avg(part), F.avg(whole)) * 100).alias("share"))


def speed_up(base: Column, other: Column) -> Column:
    """base / other; NaN where either is missing or other is 0."""
    return F.coalesce(F.try_divide(base, other), _nan())
