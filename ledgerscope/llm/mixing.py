"""Mixing sources to target weights (6, native): hierarchical token budgets.

The tree is a list of columns from the root down (domain, language, source);
each node has a weight among its siblings. The budget flows from the root:
at every node the children share what the node got in proportion to their
weights, but no child gets more than its subtree holds (tokens x max_epochs).
What a short child leaves goes to its siblings first; only when all siblings
are full is the node itself short, and then the level above shares the rest.

With children sorted by capacity / weight, the common level of a node is the
largest of (budget - capacity before) / (weight from here on): one window per
level over the table of tree nodes, no iteration.

A leaf with budget b and t tokens takes floor(b / t) whole epochs and a
token prefix of the next one. The order of epoch e is by the first 60 bits of
md5(seed-e-doc_id). The end of the prefix is found without sorting the leaf:
token sums of 4096 hash ranges, then the rows of the one range that the
prefix ends in. The result of it is one number per leaf, so the texts are
joined with the small leaf table only and never shuffled for a hot leaf.

Defined results: null node values are a node of their own; null text has no
tokens and is never drawn beyond whole epochs of its leaf; a document at the
end of the prefix is taken if at least half of it fits; rows that share a
doc_id tie and go together; an empty table gives an empty result; output
columns replace input columns of the same name.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_keys, written

RANGES = 12      # bits of the hash ranges


def order_hash(seed: int, epoch: str, doc_id: str):
    """60-bit order of a document in an epoch (also available in plain SQL as md5)."""
    return F.expr(f"cast(conv(substr(md5(concat_ws('-', '{seed}', cast({epoch} as string), "
                  f"coalesce(cast(`{doc_id}` as string), ''))), 1, 15), 16, 10) as bigint)")


def _share(children: DataFrame, parent: list[str]) -> DataFrame:
    """Adds ``got``: each child's part of ``budget`` given ``w`` and ``cap``."""
    if not parent:
        children = children.withColumn("_all", F.lit(0))
    by = parent or ["_all"]            # the root has one row per top node
    w = Window.partitionBy(*by).orderBy(F.col("cap") / F.col("w"))
    d = children.withColumn("_before", F.coalesce(F.sum("cap").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    d = d.withColumn("_rest", F.sum("w").over(w.rowsBetween(0, Window.unboundedFollowing)))
    d = d.withColumn("_level", F.max((F.col("budget") - F.col("_before")) / F.col("_rest")).over(Window.partitionBy(*by)))
    return d.withColumn("got", F.least(F.col("cap").cast("double"), F.col("w") * F.col("_level"))).drop(
        "_before", "_rest", "_level", "_all")


def leaf_budgets(leaves: DataFrame, tree: list[str], weights: dict[str, dict], budget: float, max_epochs: int) -> DataFrame:
    """``leaves``: one row per leaf with the tree's columns and ``tokens``.
    ``weights``: for each column a dict value -> weight (others: 1). Returns
    the leaves with ``got``, the leaf's tokens of the budget."""
    def weight(col):
        pairs = [x for k, v in weights.get(col, {}).items() for x in (F.lit(k), F.lit(float(v)))]
        return F.coalesce(F.create_map(*pairs)[F.col(col)], F.lit(1.0)) if pairs else F.lit(1.0)

    d = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    for c in tree:
        d = d.withColumn(f"_w_{c}", weight(c))
    d = d.where(" AND ".join(f"_w_{c} > 0" for c in tree) + " AND cap > 0")
    got = None
    for depth in range(1, len(tree) + 1):
        node, parent = tree[:depth], tree[:depth - 1]
        kids = d.groupBy(*node).agg(F.sum("cap").alias("cap"), F.first(f"_w_{tree[depth - 1]}").alias("w"))
        if got is None:
            kids = kids.withColumn("budget", F.lit(float(budget)))
        else:
            kids = join_keys(kids, got, parent, ["got"]).withColumnRenamed("got", "budget")
        got = _share(kids, parent).select(*node, "got")
    return join_keys(leaves, got, tree, ["got"], "left").fillna(0.0, ["got"])


def mix(docs: DataFrame, tree: dict[str, str], weights: dict[str, dict], share: float = 0.5, max_epochs: int = 4,
        seed: int = 6, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document and epoch it is drawn in: the input's columns, the
    tree's columns (``tree``: name -> SQL over the input), mix_tokens (4 UTF-8
    bytes each, rounded up), epoch and mix_order (order within the epoch).
    The budget is ``share`` of all tokens."""
    names = list(tree)
    added = [*names, "mix_tokens", "epoch", "mix_order"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    base = docs.select(F.struct(*kept).alias("_row"), F.col(doc_id).alias("_id"),
                       *[F.expr(e).alias(f"_m_{n}") for n, e in tree.items()],
                       F.expr(f"cast(ceil(coalesce(octet_length(`{text}`), 0) / 4) as bigint)").alias("mix_tokens"))
    keys = [f"_m_{n}" for n in names]
    narrow = written(base.select("_id", *keys, "mix_tokens"), "mix")
    leaves = written(narrow.groupBy(*keys).agg(F.sum("mix_tokens").alias("tokens")), "leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    plan = leaf_budgets(leaves, keys, {f"_m_{k}": v for k, v in weights.items()}, int(total * share), max_epochs)
    plan = written(plan.withColumn("full", F.expr("cast(CASE WHEN tokens > 0 THEN floor(got / tokens) ELSE 0 END as int)"))
                   .withColumn("rest", F.expr("got - full * tokens")), "plan")

    # where each leaf's prefix of epoch ``full`` ends
    drawn = join_keys(narrow, plan, keys, ["full", "rest"]).where("rest > 0")
    drawn = drawn.withColumn("h", order_hash(seed, "full", "_id")).withColumn("part", F.expr(f"shiftright(h, {60 - RANGES})"))
    same_leaf = Window.partitionBy(*keys).orderBy("part")
    parts = (drawn.groupBy(*keys, "part", "rest").agg(F.sum("mix_tokens").alias("t"))
             .withColumn("upto", F.sum("t").over(same_leaf)).withColumn("before", F.col("upto") - F.col("t")))
    last = written(parts.where("before < rest AND upto >= rest").select(*keys, "part", "before", "rest"), "last")
    one = drawn.groupBy(*keys, "part", "h").agg(F.sum("mix_tokens").alias("t"))
    one = join_keys(one, last, [*keys, "part"], ["before", "rest"])
    inside = Window.partitionBy(*keys, "part").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    one = one.withColumn("cum", F.col("before") + F.coalesce(F.sum("t").over(inside), F.lit(0)))
    cut = (one.groupBy(*keys).agg(F.max(F.when(F.expr("cum + t / 2 <= rest"), F.col("h"))).alias("cut"),
                                  F.min("part").alias("part")))
    # nothing of the last range fits: the prefix ends just before that range
    cut = cut.select(*keys, F.coalesce("cut", F.expr(f"shiftleft(part, {60 - RANGES}) - 1")).alias("cut"))
    final = written(join_keys(plan, cut, keys, ["cut"], "left").fillna(-1, ["cut"]).select(*keys, "full", "cut"), "cuts")
    out = join_keys(base, final, keys, ["full", "cut"])
    n = F.col("full") + F.when(order_hash(seed, "full", "_id") <= F.col("cut"), 1).otherwise(0)
    out = out.withColumn("_n", n).where("_n > 0").withColumn("epoch", F.explode(F.expr("sequence(0, _n - 1)")))
    out = out.withColumn("mix_order", order_hash(seed, "epoch", "_id"))
    return out.select("_row.*", *[F.col(f"_m_{n}").alias(n) for n in names], "mix_tokens", "epoch", "mix_order")
