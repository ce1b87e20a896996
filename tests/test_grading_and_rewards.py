import math

import pytest
from pyspark.sql import functions as F

from weftline.functions import grading as G
from weftline.operators import joins, rewards, sampling
from weftline.plans import registry


@pytest.mark.parametrize(
    "a, b, same",
    [
        (r"\frac{1}{2}", "0.5", True), ("12,345", "12345", True), ("3.0", "3", True), ("(1, 2)", "(1,2)", True), ("(1,2]", "(1,2)", False),
        (r"2\sqrt{3}", r"\sqrt{12}", True), ("x+1", "1+x", True), ("x+1", "x-1", False), (r"\frac34", "3/4", True), ("5 cm", "5", True), ("7", "8", False),
        (r"\text{yes}", "yes", True), ("1/0", "1/0", True), ("1/0", "2", False), ("", "3", False), ("2^10", "1024", False), ("2^{10}", "4^5", False), ("2^5", "4^2*2", True), (r"\frac{2}{4}", r"\frac{1}{2}", False), (r"7\frac{3}{4}", "31/4", True), ("0.75", "3/4", True), ("y=4", "4", True), ("50\\%", "50", True),
    ],
)
def test_grade(a, b, same):
    assert G.grade(a, b) is same


@pytest.mark.parametrize(
    "given, want",
    [
        (r"\frac{72}1", r"\frac{72}1"), (r"\frac1{72}", r"\frac{1}{72}"), (r"\frac12", r"\frac{1}{2}"), (r"\frac1", r"\frac1"), ("50%", "50%"), (r"50\%", "50"), ("$5", "$5"), (r"\$5", "5"), (r"x\in[1,2]", r"x\in[1,2]"),
        (r"5\text{ cm}", "5"), (r"7\text{ cm}+1", "7"), (r"1\text{ a}+\text{ b}+1", r"1\text{ a}+\text{ b}+1"), ("5 miles", "5"), ("10 apples", "10"), (r"\text{east}", "east"), (r"90^\circ", "90"), (".5", r"\frac{1}{2}"), ("3/4", r"\frac{3}{4}"), ("03/4", "03/4"),
        ("k=7", "7"), ("abc=7", "abc=7"), (r"\sqrt3", r"\sqrt{3}"), (r"2\sqrt", r"2\sqrt"), (" 1 000 ", "1000"), ("", ""), (None, None), (r"\begin{bmatrix}1\end{bmatrix}", r"\begin{pmatrix}1\end{pmatrix}"),
    ],
)
def test_first_normal_form(given, want):
    assert G.mathd_normal(given) == want


@pytest.mark.parametrize("given, want", [(r"\frac{1}{2}", "1/2"), (r"7\frac{3}{4}", "7+3/4"), (r"\boxed{7}", "7"), ("12,345", "12345"), ("3.0", "3"), ("2 million", "2*10^6"), ("5 degrees", "5"), (r"\text{Yes}", "yes"), ("1 or 2", "1,2"), (r"2\sqrt{3}", "2sqrt(3)"), (None, None)])
def test_second_normal_form(given, want):
    assert G.plain_normal(given) == want


def test_boxes_in_other_forms():
    assert [G.boxed(x) for x in (r"\fbox{5}", r"\boxed 5", r"\boxed 5 {6}", r"\boxed{a} \boxed{b")] == [None, None, None, None]
    assert G.boxed(r"x \boxed{a{b}c} y") == "a{b}c"


def test_values_and_latex():
    assert G.value_equal("1,000", "1,000") and G.value_equal("3.0", "3") and not G.value_equal("3", "4")
    assert G.grade("0.33333", "1/3", fast=False) and not G.grade("0.33333", "1/3") and G.grade("2x=4", "4=2x", fast=False) and not G.grade("a" * 200, "b" * 200, fast=False)
    assert G.equal_values("+".join(["1"] * 300), "300"), "no size decides"


def test_boxes_and_tags(spark):
    assert G.boxed(r"so \boxed{\frac{1}{2}} and \boxed{x^{2}}") == "x^{2}" and G.boxed(r"\boxed{1") is None and G.boxed("none") is None and G.boxed(None) is None
    rows = [("<think>x</think> <answer> 7 </answer>", "7"), ("<answer>7", "7"), ("7", "7"), (None, "7")]
    got = spark.createDataFrame(rows, "r string, t string").select(G.tag_answer(F.col("r")).alias("a"), G.exact_answer(F.col("r"), F.col("t")).alias("e"), G.tagged_reward("r", "t").alias("w")).collect()
    assert [r["a"] for r in got] == ["7", "7", "", None] and [bool(r["e"]) for r in got] == [True, False, False, False]
    assert [r["w"]["reward"] for r in got] == [1.0, 0.0, 0.0, 0.0]
    b = spark.createDataFrame([(r"\boxed{4}", ["3", "4"]), ("4", ["4"])], "r string, t array<string>").select(G.boxed_reward("r", "t").alias("w")).collect()
    assert [r["w"]["format_reward"] for r in b] == [1.0, 0.0] and b[0]["w"]["answer_reward"] == 1.0


def test_repetition_against_brute_force():
    for s in ("", "a", "abab", "aaaa", "mississippi", "abcabcabc"):
        suffixes = sorted(s[i:] for i in range(len(s)))
        lcp = sum(next((k for k in range(min(len(a), len(b)) + 1) if a[: k + 1] != b[: k + 1]), 0) for a, b in zip(suffixes, suffixes[1:]))
        want = 2 * lcp / (len(s) * (len(s) + 1)) if len(s) > 1 else 0.0
        assert abs(G.repeat_share(s) - want) < 1e-12


def test_advantages(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 0.0), (1, 0.0), (1, 1.0), (2, 3.0), (None, 1.0), (None, 2.0)], "g int, reward double")
    got = rewards.advantages(df, ["g"]).collect()
    one = sorted(r["group_advantage"] for r in got if r["g"] == 1)
    assert all(abs(abs(x) - 0.866024) < 1e-5 for x in one) and [math.isnan(r["group_advantage"]) for r in got if r["g"] == 2] == [True]
    assert len([r for r in got if r["g"] is None and not math.isnan(r["group_advantage"])]) == 2
    assert sorted(r["x"] for r in rewards.advantages(df, ["g"], by_std=False, out="x").collect() if r["g"] == 1) == [-0.5, -0.5, 0.5, 0.5]


def test_losses(spark):
    df = spark.createDataFrame([([-1.0], [-1.5], 1.0, [True]), ([-1.0], [-1.5], -1.0, [True]), ([-2.0], [-1.0], 1.0, [False])], "lp array<double>, old array<double>, a double, m array<boolean>")
    l = rewards.loss("grpo_clip", F.col("lp"), advantage=F.col("a"), old=F.col("old"), eps=0.2)
    got = df.select(l[0].alias("l"), rewards.clipped(F.col("lp"), F.col("old"), F.col("a"), 0.2)[0].alias("c"), rewards.masked_mean(F.col("lp"), F.col("m")).alias("mm")).collect()
    assert [round(r["l"], 6) for r in got] == [-1.2, 1.648721, -0.367879] and [r["c"] for r in got] == [True, False, False]
    assert got[0]["mm"] == -1.0 and math.isnan(got[2]["mm"])
    with pytest.raises(ValueError):
        rewards.loss("other", F.col("lp"))
    with pytest.raises(ValueError):
        rewards.loss("grpo_clip", F.col("lp"))


def test_softmax_entropy_schedule_and_top_p(spark):
    x = [1000.0, 1001.0, 999.0]
    r = spark.createDataFrame([(x,)], "x array<double>").select(rewards.softmax(F.col("x")).alias("s"), rewards.token_entropy(F.col("x")).alias("h"), rewards.log_softmax_at(F.col("x"), F.lit(1)).alias("l")).first()
    e = [math.exp(v - 1001) for v in x]
    p = [v / sum(e) for v in e]
    assert all(abs(a - b) < 1e-12 for a, b in zip(r["s"], p)) and abs(r["h"] + sum(v * math.log(v) for v in p)) < 1e-9 and abs(r["l"] - math.log(p[1])) < 1e-9
    lr = [round(r[0], 6) for r in spark.createDataFrame([(0,), (5,), (10,), (55,), (100,)], "t int").select(rewards.learning_rate(F.col("t"), 1.0, 0.1, 10, 100)).collect()]
    assert lr == [0.0, 0.5, 1.0, 0.55, 0.1]
    t = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.15), ("d", 0.05)], "k string, p double")
    assert sorted(r["k"] for r in rewards.top_p(t, 0.6, order="k").collect()) == ["a", "b"]


def test_reward_metadata_equals_the_long_way(spark):
    data = [(g, float((g * 7 + k * 3) % 5)) for g in range(6) for k in range(g + 1)]
    df = spark.createDataFrame(data, "g int, reward double")
    a = [r["x"] for r in rewards.advantages(df, ["g"], out="x").collect() if not math.isnan(r["x"])]
    m = rewards.reward_metadata(df, ["g"]).first()
    std = lambda v: math.sqrt(sum((x - sum(v) / len(v)) ** 2 for x in v) / (len(v) - 1))
    assert abs(m["std_advantage"] - std(a)) < 1e-9 and abs(m["std_reward"] - std([x for _, x in data])) < 1e-9


def test_batches_pairs_and_windows(spark):
    b = sampling.batches(spark.range(0, 103).withColumnRenamed("id", "k"), 10, "k").collect()
    assert sorted((r["k"], r["row"], r["batch"]) for r in b) == [(i, i, i // 10) for i in range(103)]
    df = spark.createDataFrame([([1, 2], [3, 4]), ([1], []), ([], [5])], "p array<int>, r array<int>")
    got = df.select(*[c.alias(k) for k, c in sampling.prompt_response(F.col("p"), F.col("r")).items()]).collect()
    assert (got[0]["input_ids"], got[0]["labels"], got[0]["response_mask"]) == ([1, 2, 3], [2, 3, 4], [False, True, True])
    assert got[1]["input_ids"] == [] and got[2]["response_mask"] == []
    c = sampling.collate(spark.createDataFrame([(0, [1]), (0, [1, 2, 3])], "b int, x array<int>"), "b", {"x": 0}).collect()
    assert sorted(r["x"] for r in c) == [[1, 0, 0], [1, 2, 3]]


def test_joins(spark):
    a, b = spark.createDataFrame([(1, "u"), (2, "v"), (3, None)], "i int, k string"), spark.createDataFrame([("u", 5), ("u", 4), (None, 1)], "k string, o int")
    assert [(r["i"], r["right_o"]) for r in joins.first_match(a, b, "k", "o").collect()] == [(1, 4)]
    x, y = spark.createDataFrame([("p", 1.0), ("q", 2.0)], "n string, v double"), spark.createDataFrame([("p", 1.0), ("q", 2.1), ("r", 0.0)], "n string, v double")
    assert sorted(r["n"] for r in joins.state_difference(x, y, "n", "v").collect()) == ["q", "r"]


def test_prompt_response_sums_every_label(spark, tmp_path):
    """A prompt of 60 letters fills the first labels; those of the response follow."""
    rows = [(1, "a" * 60, "bc"), (2, "a", "b" * 70), (3, "ab", None)]
    spark.createDataFrame(rows, "example_id long, prompt string, response string").write.parquet(f"{tmp_path}/sft_example.parquet")
    got = {r["example_id"]: r for r in registry.QUERIES["smp6_prompt_response"](spark, str(tmp_path)).collect()}
    assert got[1]["label_sum"] == 59 * 97 + 98 + 99 and got[1]["response_label_sum"] == 98 + 99 and got[1]["n_response"] == 2
    assert got[2]["label_sum"] == got[2]["response_label_sum"] == 70 * 98 and set(got) == {1, 2}
