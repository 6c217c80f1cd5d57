"""Quality rules (8, native): exact text features and a short-circuit cascade.

``features`` computes the base features of each whole text with SQL functions
only. ``plan_cascade`` orders reject rules by *rejection per cost*, both estimated
on a sample, and ``cascade`` evaluates them as one CASE expression: a row that an early
rule rejects never evaluates the later ones. The verdict is the same for every
order, so a different sample or a slower machine changes the cost only.

Defined results: null text counts as no words; an empty table gives an empty
result; rows are independent, so repeated rows and ties get equal results;
input columns named like an output column, or beginning with ``_q_``, are
replaced or dropped.
"""
from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, not_blank_sql, words_sql, written

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Input columns plus n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (long) and base_failed.

    The words of repeated 8-word windows: the window hashes of a text are put
    in one array; only if it has fewer distinct values than entries are
    (hash, start) pairs sorted, starts with an equal neighbour kept, and each
    start counted for the words that the start before it doesn't cover.
    """
    keep = [c for c in docs.columns if c not in FEATURES and not c.startswith("_q_")]
    d = docs.select(*keep)
    d = d.withColumn("_q_words", F.expr(words_sql(f"`{text}`")))
    d = d.withColumn("_q_lines", F.expr(
        f"filter(split(coalesce(`{text}`, ''), '\\n'), l -> {not_blank_sql('l')})"))
    d = d.withColumn("_q_n", F.size("_q_words"))
    d = d.withColumn("_q_wh", F.expr("transform(_q_words, w -> xxhash64(w))"))
    d = d.withColumn("_q_win", F.expr(
        "CASE WHEN _q_n < 9 THEN cast(array() as array<bigint>) ELSE transform(sequence(0, _q_n - 8), i -> xxhash64("
        + ", ".join(f"_q_wh[i + {j}]" for j in range(8)) + ")) END"))
    d = d.withColumn("_q_srt", F.expr(
        "CASE WHEN size(array_distinct(_q_win)) < size(_q_win) THEN "
        "array_sort(transform(_q_win, (h, i) -> struct(h as h, i as i))) END"))
    d = d.withColumn("_q_at", F.expr(
        "array_sort(transform(filter(_q_srt, (x, j) -> (j > 0 AND _q_srt[greatest(j - 1, 0)].h = x.h) OR "
        "(j < size(_q_srt) - 1 AND _q_srt[least(j + 1, size(_q_srt) - 1)].h = x.h)), x -> x.i))"))
    t = F.coalesce(F.col(text), F.lit(""))
    d = d.select(
        *keep,
        F.col("_q_n").cast("long").alias("n_words"),
        F.length(F.translate(t, WS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("n_dup_lines"),
        F.expr("coalesce(aggregate(_q_at, named_struct('p', -8, 'n', 0), "
               "(a, x) -> named_struct('p', x, 'n', a.n + least(8, x - a.p)), a -> a.n), 0)")
        .cast("long").alias("n_repeat_words"))
    return d.withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words"))


@dataclass(frozen=True)
class Rule:
    """Reject a row where ``reject`` (SQL over the input and feature columns) holds."""
    name: str
    reject: str


def default_rules(text: str = "text") -> list[Rule]:
    """Rules for invented or natural prose in any language written with spaces."""
    t = f"coalesce(`{text}`, '')"
    letters = f"length(regexp_replace({t}, '\\\\P{{L}}', ''))"
    return [
        Rule("symbols", "10 * n_symbols > word_chars"),
        Rule("mean_word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
        Rule("dup_lines", f"2 * n_dup_lines > size(split({t}, '\\n'))"),
        Rule("exclamations", f"2 * (length({t}) - length(translate({t}, '!', ''))) > n_words"),
        Rule("capitals", f"10 * length(regexp_replace({t}, '\\\\P{{Lu}}', '')) > 6 * greatest({letters}, 1)"),
    ]


def plan_cascade(docs: DataFrame, rules: list[Rule], text: str = "text", sample_rows: int = 2000, least_seconds: float = 0.2) -> list[dict]:
    """Cost and selectivity of each rule on a sample, in the order to apply them.

    The sample is a seeded random draw of about ``sample_rows`` rows (a documented
    bound; it only orders the rules), written once. ``cost`` is seconds a row of
    evaluating the rule from the raw columns, with the features it reads and no
    others: a pass over so many copies of the sample that it takes ``least_seconds``
    longer than a pass that evaluates nothing (or 256 copies). The order is greedy:
    next comes the rule that rejects most per cost of the rows that the rules before
    it leave; ``rejected`` is its share of those."""
    n = docs.count()
    if not n:
        return [{"rule": r, "rejected": 0.0, "cost": 0.0} for r in rules]
    drawn = written(docs.sample(fraction=min(1.0, sample_rows / n), seed=8), "cascade-sample").coalesce(1)
    hits = features(drawn, text).select(*[F.coalesce(F.expr(r.reject), F.lit(False)).alias(f"_q_{i}") for i, r in enumerate(rules)]).collect()
    cost = _costs(drawn, rules, text, len(hits), least_seconds)
    left, rest, order = hits, list(range(len(rules))), []
    while rest:
        share = {i: sum(h[i] for h in left) / max(len(left), 1) for i in rest}
        i = min(rest, key=lambda i: (-share[i] / cost[i], cost[i], rules[i].name))
        order.append({"rule": rules[i], "rejected": share[i], "cost": cost[i]})
        rest.remove(i)
        left = [h for h in left if not h[i]]
    return order


def _costs(sample: DataFrame, rules: list[Rule], text: str, rows: int, least: float) -> list[float]:
    """Seconds a row of each rule with its features, above a pass over the same copies that evaluates none."""
    def seconds(copies: int, cond: str | None) -> float:
        d = sample.withColumn("_q_copy", F.expr(f"explode(sequence(1, {copies}))"))
        # the text depends on the copy, so a copy's features can't be computed before it is made
        d = d.withColumn(text, F.expr(f"CASE WHEN _q_copy > 0 THEN `{text}` END"))
        d = d.select((F.length(text) < 0).alias("c")) if cond is None else features(d, text).select(F.expr(cond).alias("c"))
        best = float("inf")
        for _ in range(2):
            t0 = time.perf_counter()
            d.agg(F.count_if("c")).collect()        # a plain count would not need the condition
            best = min(best, time.perf_counter() - t0)
        return best

    empty, found = {}, []
    for r in rules:
        copies = 1
        while True:
            if copies not in empty:
                empty[copies] = seconds(copies, None)
            extra = seconds(copies, r.reject) - empty[copies]
            if extra >= least or copies >= 256:
                break
            copies *= 4
        found.append(max(extra, 1e-6) / (copies * max(rows, 1)))
    return found


def cascade(feats: DataFrame, rules: list[Rule], out: str = "rejected_by") -> DataFrame:
    """Add ``out``: the first rule of the given order that rejects the row, else null."""
    case = "CASE " + " ".join(f"WHEN {r.reject} THEN '{r.name}'" for r in rules) + " END" if rules else "cast(null as string)"
    return feats.withColumn(out, F.expr(case))


def judge(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None, sample_rows: int = 2000) -> DataFrame:
    """Features, base verdict, and the cascade over rows that pass the base:
    adds rejected_by ('base', a rule's name or null) and kept."""
    rules = default_rules(text) if rules is None else rules
    docs = docs.drop("rejected_by", "kept")
    order = [x["rule"] for x in plan_cascade(docs, rules, text, sample_rows)]
    out = cascade(features(docs, text), [Rule("base", "base_failed"), *order])
    return out.withColumn("kept", F.col("rejected_by").isNull())


def passing(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """The input rows that are kept, with the input's columns. The row number in
    the condition keeps the optimiser from moving the filter below the features,
    where it would repeat their expressions for every rule that reads them."""
    judged = judge(docs, text, rules).withColumn("_q_row", F.monotonically_increasing_id())
    names = [c for c in docs.columns if c not in [*FEATURES, "rejected_by", "kept"] and not c.startswith("_q_")]
    return judged.where("kept AND _q_row >= 0").select(*names)
