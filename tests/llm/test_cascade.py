"""The order of the quality cascade: cost from repeated evaluation, selectivity
among the rows that earlier rules leave, the verdict the same for every order."""
import itertools

import pytest
from pyspark.sql import functions as F

from ledgerscope.llm import quality
from ledgerscope.llm.quality import Rule


@pytest.fixture(scope="module")
def prose(spark):
    """400 texts of 300 words; words of ids divisible by 4 begin with '#', of those divisible by 3 with '!'."""
    word = F.expr("transform(sequence(1, 300), i -> concat(if(id % 4 = 0, '#', ''), if(id % 3 = 0, '!', ''), 'w', cast((i * 7919 + id) % 5000 as string)))")
    return spark.range(400).select(F.col("id").alias("doc_id"), F.array_join(word, " ").alias("text"))


def test_costly_rules_cost_more_on_every_run(prose):
    rules = [Rule("cheap", "length(`text`) < 0"), Rule("costly", "n_repeat_words > 1000000")]
    for _ in range(3):
        cost = {x["rule"].name: x["cost"] for x in quality.plan_cascade(prose, rules, least_seconds=0.05)}
        assert cost["costly"] > 5 * cost["cheap"] > 0


def test_rejection_counts_among_the_rows_that_are_left(prose):
    a = Rule("a", "`text` like '%#%'")
    same = Rule("b", "`text` like '%#%' AND n_repeat_words >= 0")        # costly and nothing left to reject
    other = Rule("c", "`text` like '%!%'")
    order = quality.plan_cascade(prose, [same, other, a], least_seconds=0.05)
    by = {x["rule"].name: x for x in order}
    assert order[-1]["rule"].name == "b" and by["b"]["rejected"] == 0
    first, second = order[0], order[1]
    share = {"a": 100 / 400, "c": 134 / 400}
    assert first["rejected"] == pytest.approx(share[first["rule"].name])
    hit = {"a": lambda i: i % 4 == 0, "c": lambda i: i % 3 == 0}
    left = [i for i in range(400) if not hit[first["rule"].name](i)]
    assert second["rejected"] == pytest.approx(sum(hit[second["rule"].name](i) for i in left) / len(left))


def test_the_verdict_is_the_same_for_every_order(prose):
    feats = quality.features(prose)
    rules = quality.default_rules()[:3] + [Rule("marks", "`text` like '%!%'")]
    want = None
    for order in itertools.permutations(rules):
        kept = quality.cascade(feats, list(order)).where("rejected_by IS NULL").agg(F.count("*"), F.sum("doc_id")).first()
        want = want or kept
        assert kept == want and 0 < kept[0] < 400


def test_null_texts_null_verdicts_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "a b c", None)], "doc_id int, text string, _q_copy int")
    order = quality.plan_cascade(df, [Rule("null", "cast(null as boolean)"), Rule("empty", "n_words = 0")], least_seconds=0.0)
    assert {x["rule"].name: round(x["rejected"], 2) for x in order} == {"null": 0.0, "empty": 0.67}
    assert [x["cost"] for x in quality.plan_cascade(df.limit(0), [Rule("empty", "n_words = 0")])] == [0.0]
