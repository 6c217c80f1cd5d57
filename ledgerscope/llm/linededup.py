"""Line dedup (10, native): repeated line runs by a distributed suffix array.

The corpus is one sequence of line IDs: the non-blank lines of the documents
in (doc_id, text hash) order, with a gap after each document. A run of lines
*qualifies* if it has ``min_words`` words; every run of the sequence that
qualifies and also occurs earlier is deleted, the earliest copy stays.

* **Prefix doubling.** ``rank_k`` of a position is the left bound, in suffix
  order, of the interval of all suffixes that share its first 2^k lines: the
  number of tied suffixes whose 2^k lines sort before. Level k+1 comes from
  the pairs (rank_k(p), rank_k(p + 2^k)), counted by key and summed over the
  global order. Suffixes without a second member in their interval drop out.
* **LCP intervals at the threshold depth.** A run of ``min_words`` words has
  at most ``min_words`` lines, so doubling stops at log2(min_words) levels.
  The interval of any depth d with 2^k <= d < 2^(k+1) is named by the two
  overlapping ranks (rank_k(p), rank_k(p + d - 2^k)); its first position is a
  grouped minimum. Every maximal repeated run that qualifies is the union of
  its shortest qualifying pieces, taken forwards from each line and backwards
  from each line, so these pieces find exactly the lines of all maximal runs.

No group is ever collected: a line that a third of all rows hold is a count
and a minimum (partial aggregation) and one skew-splittable join.

Defined results: null text stays null, blank lines are neither compared nor
deleted; rows that repeat both doc_id and text are one document and are edited
alike (a copy under another doc_id is a later copy); an empty table stays
empty; extra columns pass through, ``n_lines`` and ``n_deleted`` replace input
columns of that name. Lines are compared by their 64-bit hash.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, not_blank_sql, running_before, words_sql, written


def _line_arrays(docs: DataFrame, text: str, doc_id: str, t: int) -> DataFrame:
    """One row per input row: its key and its non-blank lines as structs
    (idx, h, fl, bl): line number, hash, and the lengths in lines of the
    shortest runs of ``t`` words that start (fl) and end (bl) here, or null."""
    d = docs.where(F.col(text).isNotNull()).select(
        F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_th"),
        F.expr(f"filter(transform(split(`{text}`, '\\n'), (l, i) -> "
               f"CASE WHEN {not_blank_sql('l')} THEN struct(i as idx, xxhash64(l) as h, least(size({words_sql('l')}), {t}) as w) END), "
               "x -> x is not null)").alias("_ln"))
    d = d.withColumn("_w", F.expr("transform(_ln, x -> x.w)"))
    shortest = (f"aggregate({{part}}, named_struct('s', 0, 'n', 0), (a, v) -> CASE WHEN a.s >= {t} THEN a "
                f"ELSE named_struct('s', a.s + v, 'n', a.n + 1) END, a -> CASE WHEN a.s >= {t} THEN a.n END)")
    fwd = shortest.format(part=f"slice(_w, j + 1, {t})")
    bwd = shortest.format(part=f"reverse(slice(_w, greatest(j + 2 - {t}, 1), least(j + 1, {t})))")
    return d.select("_id", "_th", F.expr(
        f"transform(_ln, (x, j) -> struct(x.idx as idx, x.h as h, "
        f"CASE WHEN x.w >= {t} THEN 1 ELSE {fwd} END as fl, CASE WHEN x.w >= {t} THEN 1 ELSE {bwd} END as bl))").alias("_ln"))


def repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = 10) -> DataFrame:
    """(_id, _th, idx): every line of a later copy of a qualifying run; _th is
    xxhash64 of the text."""
    arrays = written(_line_arrays(docs, text, doc_id, min_words), "lines")
    sizes = arrays.groupBy("_id", "_th").agg((F.max(F.size("_ln")) + 1).cast("long").alias("_n"))
    starts = running_before(sizes, ["_id", "_th"], "_n", "_start").drop("_n")
    at = (arrays.alias("a").join(starts.alias("s"), F.expr("a._id <=> s._id AND a._th = s._th"))
          .select("a._id", "a._th", "s._start", F.posexplode("a._ln").alias("_j", "_l"))
          .select("_id", "_th", (F.col("_start") + F.col("_j")).alias("pos"), "_l.*"))

    # level 0: line IDs that occur twice, in order, with their interval's left bound and first position
    ids = at.groupBy("h").agg(F.count("*").alias("n"), F.min("pos").alias("first")).where("n > 1")
    ids = running_before(ids, ["h"], "n", "r").drop("n")
    base = written(at.join(ids, "h").drop("h"), "rank0")
    # a repeated input row shares its positions: keep one row of each
    base = base.groupBy("pos").agg(*[F.first(c).alias(c) for c in ("_id", "_th", "idx", "fl", "bl", "r", "first")])

    ranks = {0: base.select("pos", "r")}
    k = 0
    while 2 ** (k + 1) <= min_words:
        lo, hi = ranks[k], ranks[k].select((F.col("pos") - 2 ** k).alias("pos"), F.col("r").alias("r2"))
        pairs = lo.join(hi, "pos")
        tied = pairs.groupBy("r", "r2").agg(F.count("*").alias("n")).where("n > 1")
        bounds = running_before(tied, ["r", "r2"], "n", "lb").drop("n")
        ranks[k + 1] = written(pairs.join(bounds, ["r", "r2"]).select("pos", F.col("lb").alias("r")), "rank")
        k += 1

    gone = base.where("fl = 1 AND pos > first").select("pos")
    pieces = (base.where("fl > 1").select("pos", F.col("fl").alias("d"))
              .unionByName(base.where("bl > 1").select((F.col("pos") - F.col("bl") + 1).alias("pos"), F.col("bl").alias("d"))))
    named = None
    for lev in range(1, k + 1):
        r = ranks[lev]
        p = pieces.where(f"d >= {2 ** lev} AND d < {2 ** (lev + 1)}").join(r.withColumnRenamed("r", "x"), "pos")
        p = p.withColumn("_at", F.col("pos") + F.col("d") - 2 ** lev)
        p = p.join(r.select(F.col("pos").alias("_at"), F.col("r").alias("y")), "_at").drop("_at")
        named = p if named is None else named.unionByName(p)
    if named is not None:
        named = written(named, "pieces")
        first = named.groupBy("d", "x", "y").agg(F.min("pos").alias("first"))
        later = named.join(first, ["d", "x", "y"]).where("pos > first")
        gone = gone.unionByName(later.select(F.explode(F.expr("sequence(pos, pos + d - 1)")).alias("pos")))
    return base.join(gone.distinct(), "pos").select("_id", "_th", "idx")


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = 10) -> DataFrame:
    """The input with ``text`` less its deleted lines, plus n_lines (lines of
    the input text) and n_deleted."""
    docs = docs.drop("n_lines", "n_deleted")
    t, drop, lines, new_text, n = free_names(docs, "_t", "_gone", "_l", "_new", "_nl")
    gone = (repeated_lines(docs, text, doc_id, min_words)
            .groupBy("_id", "_th").agg(F.collect_set("idx").alias(drop)))
    j = docs.alias("d").join(gone.alias("g"), (F.col(f"d.{doc_id}").eqNullSafe(F.col("g._id")))
                             & (F.xxhash64(f"d.{text}") == F.col("g._th")), "left")
    cols = [F.col(f"d.`{c}`") for c in docs.columns if c != text]
    j = j.select(*cols, F.col(f"d.`{text}`").alias(t), f"g.{drop}")
    j = j.withColumn(lines, F.split(t, "\n"))
    kept = f"array_join(transform(array_except(sequence(0, size({lines}) - 1), {drop}), i -> {lines}[i]), '\\n')"
    j = j.select("*", F.when(F.col(drop).isNull(), F.col(t)).otherwise(F.expr(kept)).alias(new_text),
                 F.coalesce(F.size(lines), F.lit(0)).alias(n))
    new = {text: F.col(new_text).alias(text)}
    return j.select(*[new.get(c, F.col(f"`{c}`")) for c in docs.columns],
                    F.greatest(F.col(n), F.lit(0)).cast("long").alias("n_lines"),
                    F.coalesce(F.expr(f"CASE WHEN {drop} is null THEN 0 ELSE size({drop}) END"), F.lit(0)).cast("long").alias("n_deleted"))
