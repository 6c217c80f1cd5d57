"""Document fingerprints (4, native): Merkle trees over paragraphs and sections.

Paragraphs are the lines of a text. A section ends after a paragraph whose
digest ends in 0 or 1 (one in eight), so its borders depend on content only
and an edit moves none but its own. A paragraph's digest is the SHA-256 of its
text, a section's that of its paragraphs' digests, the root's that of the
number of paragraphs and the sections' digests: equal roots mean equal texts,
and where roots differ the differing sections and paragraphs locate the edit.
Below each paragraph are its twigs, 64-bit hashes of its runs of four words, one
run from every word on, so a word put in or taken out changes at most four of
them. The Dice coefficient of the sets of twigs tells how alike two trees are.
``edits`` descends two trees side by side to the paragraphs that differ.

Defined results: null text is empty; an empty text has one empty paragraph;
an empty table gives an empty result; output columns replace input columns of
the same name.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, running_before, written

MIN_ID = -(2 ** 63)


def paragraph_digests(col: str) -> str:
    return f"transform(split(coalesce({col}, ''), '\\n'), p -> sha2(p, 256))"


def section_digests(paragraphs: str) -> str:
    """SQL: digests of the sections of an array of paragraph digests."""
    return (f"transform(filter(split(array_join(transform({paragraphs}, d -> concat(d, "
            f"if(right(d, 1) IN ('0', '1'), '|', ' '))), ''), '[|]'), s -> s != ''), s -> sha2(s, 256))")


def root(paragraphs: str, sections: str) -> str:
    return f"sha2(concat(size({paragraphs}), ':', array_join({sections}, ' ')), 256)"


def with_tree(df: DataFrame, col: str, prefix: str) -> DataFrame:
    """Adds <prefix>paragraphs, <prefix>sections (arrays of hex digests),
    <prefix>root and <prefix>twigs (array of long) of a string column."""
    d = df.withColumn(f"{prefix}paragraphs", F.expr(paragraph_digests(f"`{col}`")))
    d = d.withColumn(f"{prefix}sections", F.expr(section_digests(f"{prefix}paragraphs")))
    d = d.withColumn(f"{prefix}root", F.expr(root(f"{prefix}paragraphs", f"{prefix}sections")))
    words = f"transform(split(coalesce(`{col}`, ''), '\\n'), p -> split(p, ' '))"
    return d.withColumn(f"{prefix}twigs", F.expr(
        f"array_distinct(flatten(transform({words}, w -> transform(sequence(1, greatest(size(w) - 3, 1)), i -> xxhash64(slice(w, i, 4))))))"))


def likeness(a: str, b: str):
    """Dice coefficient of two arrays of distinct twigs."""
    return F.expr(f"2.0D * size(array_intersect({a}, {b})) / (size({a}) + size({b}))")


def _section_units(side: str) -> str:
    """SQL: the sections of the paragraph digests ``mid_<side>``, as structs of
    their first paragraph's number, their paragraphs and their digest."""
    p = f"mid_{side}"
    ends = f"filter(sequence(1, greatest(size({p}), 1)), i -> i <= size({p}) AND (i = size({p}) OR right({p}[i - 1], 1) IN ('0', '1')))"
    return (f"transform({ends}, (e, j) -> named_struct('at', if(j = 0, 0, {ends}[j - 1]), "
            f"'ps', slice({p}, if(j = 0, 1, {ends}[j - 1] + 1), if(j = 0, e, e - {ends}[j - 1]))))")


def _matched(units: DataFrame) -> DataFrame:
    """The k-th unit of a digest on side a beside the k-th on side b, null where there is none."""
    nth = Window.partitionBy("key", "side", "digest").orderBy("at")
    u = units.withColumn("nth", F.row_number().over(nth))
    x, y = u.where("side = 'a'").alias("x"), u.where("side = 'b'").alias("y")
    on = F.expr("x.key = y.key AND x.digest = y.digest AND x.nth = y.nth")
    return x.join(y, on, "full").select(F.expr("coalesce(x.key, y.key)").alias("key"), F.expr("coalesce(x.ps, y.ps)").alias("ps"),
                                        F.col("x.at").alias("a_at"), F.col("y.at").alias("b_at"))


def edits(pairs: DataFrame, a: str = "a_", b: str = "b_", doc_id: str = "doc_id") -> DataFrame:
    """What turns the tree with prefix ``a`` into that with prefix ``b``, both
    columns of one row (``with_tree``): doc_id, kind, a_paragraph, b_paragraph
    (numbers from 0), n (paragraphs), one row per edit of neighbouring paragraphs.

    The descent stops at equal roots; the paragraphs that two unequal trees have
    in common at their beginning and end are left out; sections of equal digests
    are matched as a whole, and only the paragraphs of sections without a match
    are looked at. kind is 'deleted' (b_paragraph null), 'inserted' (a_paragraph
    null) or 'moved': matched, but before in ``a`` what comes earlier in ``b``.
    Less the deleted and the moved, the paragraphs of ``a`` are those of ``b`` less
    the inserted and the moved, in the same order. Equal paragraphs are matched in
    their order, so the edits need not be the fewest. Rows equal in id and both
    roots count once."""
    d = pairs.where(f"{a}root != {b}root").select(F.col(doc_id).alias("id"), F.col(f"{a}root").alias("ra"), F.col(f"{b}root").alias("rb"),
                                                  F.col(f"{a}paragraphs").alias("pa"), F.col(f"{b}paragraphs").alias("pb"))
    d = d.dropDuplicates(["id", "ra", "rb"]).withColumn("key", F.struct(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"),
                                                                       F.col("id").isNull().alias("none"), "ra", "rb"))
    d = d.withColumn("both", F.expr("least(size(pa), size(pb))"))
    d = d.withColumn("head", F.expr("coalesce(nullif(array_position(transform(sequence(0, both - 1), i -> pa[i] = pb[i]), false), 0) - 1, both)"))
    tail = "transform(sequence(1, both - head), i -> pa[size(pa) - i] = pb[size(pb) - i])"
    d = d.withColumn("tail", F.expr(f"if(both = head, 0, coalesce(nullif(array_position({tail}, false), 0) - 1, both - head))"))
    for side in "ab":
        d = d.withColumn(f"mid_{side}", F.expr(f"slice(p{side}, cast(head + 1 as int), cast(size(p{side}) - head - tail as int))"))
    sections = None
    for side in "ab":
        u = d.select("key", "head", F.lit(side).alias("side"), F.explode(F.expr(_section_units(side))).alias("u"))
        u = u.select("key", "side", (F.col("head") + F.col("u.at")).alias("at"), F.col("u.ps").alias("ps"), F.expr("sha2(array_join(u.ps, ''), 256)").alias("digest"))
        sections = u if sections is None else sections.unionByName(u)
    whole = written(_matched(written(sections, "sections")), "matched")
    open_ = whole.where("a_at IS NULL OR b_at IS NULL").select(
        "key", F.expr("if(a_at IS NULL, 'b', 'a')").alias("side"), F.expr("coalesce(a_at, b_at)").alias("from"), F.posexplode("ps").alias("j", "digest"))
    single = _matched(open_.select("key", "side", (F.col("from") + F.col("j")).alias("at"), F.array("digest").alias("ps"), "digest"))
    units = whole.where("a_at IS NOT NULL AND b_at IS NOT NULL").unionByName(single)
    units = units.select("key", "a_at", "b_at", F.size("ps").alias("n"))
    earlier = Window.partitionBy("key").orderBy(F.col("b_at").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    units = units.withColumn("kind", F.expr("CASE WHEN b_at IS NULL THEN 'deleted' WHEN a_at IS NULL THEN 'inserted' END"))
    units = units.withColumn("most", F.max(F.expr("if(b_at IS NULL, NULL, a_at)")).over(earlier))
    units = units.withColumn("kind", F.expr("CASE WHEN kind IS NOT NULL THEN kind WHEN a_at < most THEN 'moved' END")).where("kind IS NOT NULL")
    # neighbouring paragraphs of one kind are one edit
    units = units.withColumn("at", F.expr("coalesce(b_at, a_at)"))
    order = Window.partitionBy("key", "kind").orderBy("at")
    on = F.expr("at = lag_at + lag_n AND (kind != 'moved' OR a_at = lag_a + lag_n)")
    units = (units.withColumn("lag_at", F.lag("at").over(order)).withColumn("lag_n", F.lag("n").over(order)).withColumn("lag_a", F.lag("a_at").over(order))
             .withColumn("run", F.sum(F.when(on, 0).otherwise(1)).over(order)))
    runs = units.groupBy("key", "kind", "run").agg(F.min("a_at").alias("a_at"), F.min("b_at").alias("b_at"), F.sum("n").alias("n"))
    return runs.select(F.expr("if(key.none, NULL, key.id)").cast(pairs.schema[doc_id].dataType).alias("doc_id"), "kind",
                       F.col("a_at").cast("long").alias("a_paragraph"), F.col("b_at").cast("long").alias("b_paragraph"), "n")


def with_next(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rows: int = 1024, most: int = 50_000) -> DataFrame:
    """Adds ``next_text``: the text of the row that follows by (doc_id, text
    hash), after the last the first. Texts are shuffled once, by blocks of about
    ``rows`` rows; the first row of a block also goes to the block before. The
    block borders (at most ``most`` ids) come from a running count over the ids."""
    docs = docs.drop("next_text")
    k, b, at, lines = free_names(docs, "_k", "_b", "_at", "_borders")
    keyed = docs.withColumn(k, F.coalesce(F.col(doc_id).cast("long"), F.lit(MIN_ID)))
    ids = keyed.select(F.col(k).alias("_k"), F.lit(1).cast("long").alias("_one"))
    n = ids.count()
    step = max(rows, -(-n // most))
    ranked = running_before(ids, ["_k"], "_one", "_r")
    borders = sorted({r[0] for r in ranked.where(F.col("_r") % step == 0).select("_k").collect()}) or [0]
    keyed = keyed.withColumn(lines, F.expr(f"cast(split('{','.join(map(str, borders))}', ',') as array<bigint>)"))
    # binary search for the last border at or before the key
    keyed = keyed.withColumn(b, F.expr(
        f"aggregate(sequence(1, {len(borders).bit_length() + 1}), named_struct('lo', 0, 'hi', {len(borders)}), (a, x) -> "
        f"CASE WHEN a.hi - a.lo <= 1 THEN a WHEN {lines}[(a.lo + a.hi) div 2] <= {k} "
        f"THEN named_struct('lo', cast((a.lo + a.hi) div 2 as int), 'hi', a.hi) "
        f"ELSE named_struct('lo', a.lo, 'hi', cast((a.lo + a.hi) div 2 as int)) END, a -> a.lo)"))
    last = len(borders) - 1
    rows_at = (f"named_struct('b', {b}, 'wrap', 0, 'copy', false)",
               f"named_struct('b', if({b} = 0, {last}, {b} - 1), 'wrap', if({b} = 0, 1, 0), 'copy', true)")
    keyed = keyed.withColumn(at, F.explode(F.expr(f"if({k} = {lines}[{b}], array({', '.join(rows_at)}), array({rows_at[0]}))"))).drop(lines, b)
    w = Window.partitionBy(f"{at}.b").orderBy(f"{at}.wrap", k, F.xxhash64(text), f"{at}.copy")
    out = keyed.withColumn("next_text", F.lead(F.coalesce(text, F.lit(""))).over(w)).where(f"NOT {at}.copy")
    return out.drop(k, at)


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, root and the tree's arrays of every text."""
    d = with_tree(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")), "text", "_")
    return d.select("doc_id", F.col("_root").alias("root"), F.col("_sections").alias("sections"),
                    F.col("_paragraphs").alias("paragraphs"), F.col("_twigs").alias("twigs"))
