"""Chat formatting (1, native): conversations into budgeted training windows.

A turn is written as ``<|im_start|>role NEWLINE text<|im_end|> NEWLINE``. So
that texts can say anything, every ``<`` + backslashes + ``|`` in a role or
text gets one more backslash; then ``<|`` occurs in control strings only, and
taking one backslash away restores the text. A line break in a role is written
``<|nl|>``.

Windows come from prefix sums of the turns' tokens. The token line of a
conversation is cut into cells of ``new`` tokens; a turn belongs to the cell it
starts in, but a turn of over ``new / 4`` tokens that reaches past its cell is
a window of its own. So windows are runs of whole turns, and the new turns of
one take at most 1.25 x ``new`` tokens unless one turn alone is longer. In front
of its new turns a window repeats the conversation's system turn (its first
turn, if the role is system) and the turns that start within the last
``history`` tokens. Only new assistant texts are under the loss mask: repeated
targets are masked, so each is a target exactly once.

Prefix sums are exact running totals over range partitions and windows meet
their history by an equi-join on token buckets, so no conversation, however
long, is one task's group before the texts of one window are put together.

Defined results: null role or text is empty; turns go by (turn, role, text),
repeated rows are repeated turns; a null conv_id is one conversation; an empty
table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_keys, running_before, written

OPEN, CLOSE, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"

#: SQL for the tokens of a turn with the column ``text``: 4 for the template, 4 bytes each.
TOKENS = "4 + cast(ceil(octet_length(text) / 4) as bigint)"


def escaped(col: str) -> str:
    return f"regexp_replace({col}, '<(\\\\\\\\*)\\\\|', '<$1\\\\\\\\|')"


def unescaped(col: str) -> str:
    return f"regexp_replace({col}, '<(\\\\\\\\*)\\\\\\\\\\\\|', '<$1|')"


def format_windows(turns: DataFrame, new: int = 512, history: int = 256, tokens: str = TOKENS) -> DataFrame:
    """One row per window: conv_id, window (in order), text, n_repeated (its
    leading repeated turns), n_turns, n_tokens, loss (array of start, end code
    points of ``text`` under the loss mask, end exclusive)."""
    t = turns.selectExpr("conv_id", "turn", "coalesce(role, '') as role", "coalesce(text, '') as text")
    t = t.withColumn("t", F.expr(tokens))
    t = running_before(t, ["turn", "role", "text"], "t", "s", keys=["conv_id"])
    # escaped behind the range shuffle: its sampling pass would do the work twice
    t = t.selectExpr("conv_id", "role", "s", "t", f"replace({escaped('role')}, '\\n', '{NEWLINE}') as r", f"{escaped('text')} as x")
    t = t.withColumn("cell", F.expr(f"s div {new}"))
    t = t.withColumn("window", F.expr(f"2 * cell + CASE WHEN 4 * t > {new} AND s + t > (cell + 1) * {new} THEN 1 ELSE 0 END"))
    t = written(t.selectExpr("conv_id", "window", "s", "t", "r", "x", "role = 'assistant' as target",
                             "s = 0 AND role = 'system' as lead"), "turns")
    part = ["conv_id", "window", "s", "t", "r", "x", "target"]
    fresh = t.select(*part, F.lit(True).alias("fresh"))
    starts = t.groupBy("conv_id", "window").agg(F.min("s").alias("p0")).withColumn("b", F.expr(f"p0 div {history}"))
    old = t.where("NOT lead").withColumn("b", F.explode(F.expr(f"array(s div {history}, s div {history} + 1)"))).drop("window")
    old = (join_keys(old, starts, ["conv_id", "b"], ["window", "p0"]).where(f"p0 > s AND p0 <= s + {history}")
           .select(*part, F.lit(False).alias("fresh")))
    lead = (join_keys(starts.where("p0 > 0").drop("b", "p0"), t.where("lead").drop("window"), ["conv_id"], ["s", "t", "r", "x", "target"])
            .select(*part, F.lit(False).alias("fresh")))
    w = fresh.unionByName(old).unionByName(lead).groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("s", "t", "fresh", "target", "r", "x"))).alias("m"))
    head, tail = len(OPEN) + 1, len(CLOSE) + 1
    step = f"length(v.r) + length(v.x) + {head + tail}"
    loss = (f"aggregate(m, named_struct('p', 0, 'l', cast(array() as array<struct<start:int,end:int>>)), (a, v) -> named_struct("
            f"'p', a.p + {step}, 'l', CASE WHEN v.fresh AND v.target THEN concat(a.l, array(named_struct("
            f"'start', a.p + {head} + length(v.r), 'end', a.p + {head} + length(v.r) + length(v.x)))) ELSE a.l END), a -> a.l)")
    return w.select(
        "conv_id", "window",
        F.expr(f"array_join(transform(m, v -> concat('{OPEN}', v.r, '\\n', v.x, '{CLOSE}\\n')), '')").alias("text"),
        F.expr("size(filter(m, v -> NOT v.fresh))").alias("n_repeated"),
        F.size("m").alias("n_turns"),
        F.expr("aggregate(m, cast(0 as bigint), (a, v) -> a + v.t)").alias("n_tokens"),
        F.expr(loss).alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """Turns and targets parsed from the windows' texts: conv_id, window, turns
    (array of role, text: the new turns) and targets (array of texts)."""
    body = f"substr(p, 1, length(p) - {len(CLOSE) + 1})"
    w = windows.withColumn("_p", F.expr(f"transform(slice(split(text, '<\\\\|im_start\\\\|>'), n_repeated + 2, n_turns), p -> {body})"))
    w = w.withColumn("_p", F.expr("transform(_p, p -> named_struct('r', substring_index(p, '\\n', 1), 'p', p))"))
    return w.select(
        "conv_id", "window",
        F.expr(f"transform(_p, v -> named_struct('role', {unescaped(chr(32) + 'replace(v.r, ' + repr(NEWLINE) + ', chr(10))')}, "
               f"'text', {unescaped('substr(v.p, length(v.r) + 2)')}))").alias("turns"),
        F.expr(f"transform(loss, v -> {unescaped('substr(text, v.start + 1, v.end - v.start)')})").alias("targets"),
        F.length("text").cast("long").alias("n_chars"))
