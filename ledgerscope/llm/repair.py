"""Conversation structure repair (13): Knuth's lightest-derivation agenda.

A conversation's rows are read in order; row i may be kept (K, cost 0), given
the role user or assistant (R, 2) or deleted (D, 3), and empty user or
assistant rows may be put in anywhere (I, 2). Blank and duplicate rows must be
deleted; a truncated row that stays adds 1. The initials of the roles that are
left must read ``(s?(ua)+)?``.

Items are [i, state]: "the rows from i on can be repaired after a prefix that
left the pattern in this state". The axiom is [n, accepting state] with weight
(0, ''). A deduction is a hyperedge from row i's fault and initial and the item
of the rows behind it (K, R, D) or from an item of the same row (I) to the item
in front; its function adds the edit's cost and puts the edit's letter before
the audit. Both parts are monotone, and with the rows covered as second key,
(cost, rows, audit), every function is superior: an edit either costs something
or covers one more row. So items come off the agenda in order of their final
weight, the first time an item comes off is its lightest derivation with the
ASCII-least audit, and the search ends when the goal item [0, start] does.

A conversation of over ``PART_ROWS`` rows is cut into parts. The same agenda
gives each part's lightest weight from every state to every state, and parts
are joined, ``FAN`` at a time, by the deduction [p, q] + [q, r] -> [p, r]; equal
costs over the same rows never have one audit as the start of another (the rest
would have to be inserts, which cost), so joining keeps the order as well. So no
task sees more than one part's rows, however long a conversation. Texts are not
part of this: they meet the edits by (conversation, role, digest), where a row
that stays is unique, and one pass in conversation order writes the rows out.

Defined results: rows go by turn (nulls first), then role, then digest of the
text; a null conv_id is one conversation; null texts and roles are one space;
an empty role has no initial and can only be changed or deleted; repeated rows
are duplicates, all but the first; empty tables give empty results; other
columns are ignored. A state of the pattern and the audit fix the role that an R
or I gives, so the audit alone determines the repaired rows.
"""
from __future__ import annotations

import functools
import hashlib
import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, join_keys, running_before, written

PART_ROWS = 4096
FAN = 16

# States of the pattern and what each initial leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ACCEPTING = (START, ASSISTANT)
STATES = (START, SYSTEM, USER, ASSISTANT)
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
GIVEN = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}

#: One letter a row. Lower case: s, u, a or - (another initial); upper case: truncated; x: must be deleted.
CODES = "suax-SUA_"


def _into(state):
    """States that an edit giving a role can come from to reach ``state``: (from, initial)."""
    return [(p, c) for (p, c), q in NEXT.items() if q == state]


_INTO = {q: _into(q) for q in STATES}


def lightest(codes: str, ends: tuple, goals: tuple) -> dict:
    """{goal state: (cost, audit)} of the rows in ``codes`` from each of
    ``goals`` to the nearest of ``ends``, by the agenda."""
    n = len(codes)
    agenda = [(0, 0, "", q) for q in ends]
    done, left = {}, set(goals)
    while agenda and left:
        cost, covered, audit, state = heapq.heappop(agenda)
        if (covered, state) in done:
            continue
        done[covered, state] = (cost, audit)
        if covered == n:
            left.discard(state)
        else:
            code = codes[n - covered - 1]
            heapq.heappush(agenda, (cost + DELETE, covered + 1, "D" + audit, state))
            if code != "x":
                late = 1 if code in "SUA_" else 0
                own = {"_": "-"}.get(code, code.lower())
                for before, initial in _INTO[state]:
                    if initial == own:
                        heapq.heappush(agenda, (cost + KEEP + late, covered + 1, "K" + audit, before))
                    if initial != "s":
                        heapq.heappush(agenda, (cost + REROLE + late, covered + 1, "R" + audit, before))
        for before, initial in _INTO[state]:
            if initial != "s":
                heapq.heappush(agenda, (cost + INSERT, covered, "I" + audit, before))
    return {p: done[n, p] for p in goals if (n, p) in done}


@functools.lru_cache(maxsize=100_000)
def whole(codes: str) -> tuple:
    """(cost, audit) of a whole conversation."""
    return lightest(codes, ACCEPTING, (START,))[START]


def part_table(codes: str) -> list:
    """Rows (p, q, cost, audit) of a part: its lightest weight between states."""
    return [(p, q, *w) for q in STATES for p, w in lightest(codes, (q,), STATES).items()]


def joined(left: list, right: list) -> list:
    """Lightest weights of two neighbouring parts as one."""
    best = {}
    for p, q, c1, a1 in left:
        for q2, r, c2, a2 in right:
            if q == q2:
                w = (c1 + c2, a1 + a2)
                if (p, r) not in best or w < best[p, r]:
                    best[p, r] = w
    return [(p, r, *w) for (p, r), w in sorted(best.items())]


def edits(audit: str, systems: set, first: int = 0, state: int = START):
    """The edits of an audit: (row or None, letter, initial given or kept). ``systems``:
    the rows whose kept initial is s."""
    row = first
    for letter in audit:
        if letter == "D":
            yield row, letter, ""
        elif letter == "K" and row in systems and state == START:
            yield row, letter, "s"
            state = SYSTEM
        else:
            initial, state = GIVEN[state]
            yield (None if letter == "I" else row), letter, initial
        row += letter != "I"


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after the contract's damage, by crc32 of ``conv_id:turn``."""
    key = "concat(coalesce(cast(conv_id as string), ' '), ':', coalesce(cast(turn as string), ' '))"
    t = rows.selectExpr("conv_id", "turn", "coalesce(role, ' ') as role", "coalesce(text, ' ') as text",
                        f"crc32(cast({key} as binary)) % 20 as _d").where("_d != 0")
    return t.selectExpr(
        "conv_id", "turn", "CASE WHEN _d = 4 THEN 'user' ELSE role END as role",
        "CASE WHEN _d = 1 THEN '' WHEN _d = 2 THEN translate(text, '.!?', '') ELSE text END as text",
        "explode(CASE WHEN _d = 3 THEN array(0, 1) ELSE array(0) END) as _copy").drop("_copy")


def _narrow(rows: DataFrame) -> DataFrame:
    """Ordered rows without texts: conv_id, turn, role, h (digest of the text),
    pos (place in the conversation), fault, initial."""
    blanks = "concat(" + ", ".join(f"char({ord(c)})" for c in WS) + ")"
    t = rows.selectExpr("conv_id", "turn", "role", "sha2(text, 256) as h", f"rtrim({blanks}, text) as _t")
    t = t.selectExpr("conv_id", "turn", "role", "h", "_t = '' as _blank", "substr(_t, -1, 1) NOT IN ('.', '!', '?') as _cut")
    # equal rows are one with a number of copies: a row that is repeated very often is folded before any shuffle
    t = t.groupBy("conv_id", "turn", "role", "h", "_blank", "_cut").agg(F.count("*").alias("_n"))
    t = written(t, "turnsum")
    seen = t.groupBy("conv_id", "role", "h").agg(F.min(F.struct("turn")).alias("_first"))       # a null turn is the least
    t = join_keys(t, seen, ["conv_id", "role", "h"], ["_first"])
    t = running_before(t, ["turn", "role", "h"], "_n", "_at", keys=["conv_id"])
    t = t.withColumn("_new", F.expr("turn <=> _first.turn"))
    fault = "CASE WHEN _blank THEN 'blank' WHEN NOT _new OR _k > 0 THEN 'duplicate' WHEN _cut THEN 'truncated' ELSE '' END"
    return (t.withColumn("_k", F.explode(F.expr("sequence(cast(0 as bigint), _n - 1)")))
            .selectExpr("conv_id", "turn", "role", "h", "_at + _k as pos", f"{fault} as fault", "substr(role, 1, 1) as initial"))


def _solved(codes: DataFrame) -> DataFrame:
    """codes: conv_id, part, codes -> conv_id, cost, audit, joined over the parts."""
    struct = "array<struct<p:int,q:int,cost:long,audit:string>>"

    def per_part(batches):
        for pdf in batches:
            out = pdf[["conv_id", "part"]].copy()
            out["w"] = [[(START, ASSISTANT, *whole(c))] if single else part_table(c) for c, single in zip(pdf["codes"], pdf["single"])]
            yield out

    def together(pdf):
        pdf = pdf.sort_values("part")
        table = functools.reduce(joined, ([tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in w] for w in pdf["w"]))
        return pd.DataFrame({"conv_id": pdf["conv_id"].iloc[:1], "part": [int(pdf["part"].iloc[0]) // FAN], "w": [table]})

    kind = codes.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, part long, w {struct}"
    parts = written(codes.mapInPandas(per_part, schema), "parts")
    finished = [parts.where("size(w) = 1")]
    parts = parts.where("size(w) != 1")
    while (top := parts.agg(F.max("part")).first()[0]):
        grouped = parts.withColumn("_g", F.expr(f"part div {FAN}")).groupBy("conv_id", "_g")
        parts = written(grouped.applyInPandas(together, schema), "parts")
    if top is not None:
        ends = ", ".join(map(str, ACCEPTING))
        finished.append(parts.withColumn("w", F.expr(
            f"array(array_min(transform(filter(w, v -> v.p = {START} AND v.q IN ({ends})), "
            "v -> named_struct('cost', v.cost, 'audit', v.audit, 'p', v.p, 'q', v.q))))")).selectExpr(
            "conv_id", "part", "transform(w, v -> named_struct('p', v.p, 'q', v.q, 'cost', v.cost, 'audit', v.audit)) as w"))
    return functools.reduce(DataFrame.unionByName, finished).selectExpr("conv_id", "w[0].cost as cost", "w[0].audit as audit")


def _code_sql() -> str:
    own = "CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE '-' END"
    return (f"CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN fault = 'truncated' THEN "
            f"translate({own}, 'sua-', 'SUA_') ELSE {own} END")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Repairs conversations (conv_id, turn, role, text; no nulls in role or
    text). Returns (1) per conversation: conv_id, n_rows, gaps, blank,
    duplicate, truncated, illegal, cost, audit; (2) the edits, one row each:
    conv_id, at (order in the audit), edit, role (what the row has after it; null
    if deleted), pos; (3) the repaired rows: conv_id, at, role, text."""
    t = written(_narrow(rows), "narrow")
    t = t.withColumn("part", F.expr(f"pos div {PART_ROWS}")).withColumn("code", F.expr(_code_sql()))
    per_part = t.groupBy("conv_id", "part").agg(
        F.sort_array(F.collect_list(F.struct("pos", "code", "initial"))).alias("m"),     # at most PART_ROWS rows
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")], F.count("*").alias("n"))
    pair = "concat(m[i].initial, m[i + 1].initial)"
    per_part = written(per_part.selectExpr(
        "conv_id", "part", "array_join(transform(m, v -> v.code), '') as codes", "blank", "duplicate", "truncated", "n",
        "m[0].initial as first", "element_at(m, -1).initial as last",
        f"size(filter(sequence(0, size(m) - 2), i -> size(m) > 1 AND i >= 0 AND {pair} NOT IN ('su', 'ua', 'au'))) as illegal"), "codes")
    # pairs across a cut: the last initial of a part with the first of the next
    edge = per_part.selectExpr("conv_id", "part + 1 as part", "last as _before")
    cut = join_keys(per_part, edge, ["conv_id", "part"], ["_before"]).where("concat(_before, first) NOT IN ('su', 'ua', 'au')")
    cut = cut.groupBy("conv_id").agg(F.count("*").alias("_cut"))
    turns = t.groupBy("conv_id", "turn").agg(F.lit(1)).groupBy("conv_id").agg(
        F.min("turn").alias("_lo"), F.max("turn").alias("_hi"), F.count("turn").alias("_n"))
    sums = per_part.groupBy("conv_id").agg(*[F.sum(c).cast("long").alias(c) for c in ("n", "blank", "duplicate", "truncated", "illegal")],
                                           F.max("part").alias("_parts"))
    solved = written(_solved(join_keys(per_part.select("conv_id", "part", "codes"), sums, ["conv_id"], ["_parts"])
                             .selectExpr("conv_id", "part", "codes", "_parts = 0 as single")), "audits")
    per = join_keys(join_keys(join_keys(sums, turns, ["conv_id"], ["_lo", "_hi", "_n"]), cut, ["conv_id"], ["_cut"], "left"),
                    solved, ["conv_id"], ["cost", "audit"])
    per = per.selectExpr("conv_id", "n as n_rows", "coalesce(cast(_hi - _lo + 1 - _n as bigint), 0) as gaps", "blank", "duplicate", "truncated",
                         "illegal + coalesce(_cut, 0) as illegal", "cost", "audit")

    def each(batches):
        names, block = ["conv_id", "at", "edit", "initial", "pos"], []
        for pdf in batches:
            for conv, audit, lead in zip(pdf["conv_id"], pdf["audit"], pdf["lead"]):
                for at, (row, letter, initial) in enumerate(edits(audit, {int(lead)} if lead == lead and lead is not None else set())):
                    block.append((conv, at, letter, initial, row))
                    if len(block) == 10_000:
                        yield pd.DataFrame(block, columns=names)
                        block = []
        if block:
            yield pd.DataFrame(block, columns=names)

    # the only row that can be kept as s is the first that stays: find it by its rank in the audit
    stays = solved.selectExpr("conv_id", "audit", "length(regexp_extract(audit, '^(D*)K', 1)) as _d", "audit rlike '^D*K' as _k")
    leads = join_keys(stays.where("_k").selectExpr("conv_id", "cast(_d as bigint) as pos"), t.where("initial = 's'"), ["conv_id", "pos"], ["fault"])
    leads = leads.selectExpr("conv_id", "pos as lead")
    kind = rows.schema["conv_id"].dataType.simpleString()
    steps = (join_keys(solved, leads, ["conv_id"], ["lead"], "left").select("conv_id", "audit", "lead")
             .mapInPandas(each, f"conv_id {kind}, at long, edit string, initial string, pos long"))
    steps = written(steps, "edits")
    made = "CASE initial WHEN 'u' THEN 'user' WHEN 'a' THEN 'assistant' END"
    kept = join_keys(steps.where("edit IN ('K', 'R')"), t, ["conv_id", "pos"], ["role", "h"])
    texts = rows.selectExpr("conv_id", "role", "sha2(text, 256) as h", "text").dropDuplicates(["conv_id", "role", "h"])
    kept = join_keys(kept, texts, ["conv_id", "role", "h"], ["text"])
    kept = kept.selectExpr("conv_id", "at", f"CASE WHEN edit = 'K' THEN role ELSE {made} END as role", "text")
    put_in = steps.where("edit = 'I'").selectExpr("conv_id", "at", f"{made} as role", "'' as text")
    listed = join_keys(steps, t, ["conv_id", "pos"], ["role"], "left").selectExpr(
        "conv_id", "at", "edit", f"CASE WHEN edit = 'K' THEN role ELSE {made} END as role", "pos")
    return per, listed, kept.unionByName(put_in)


def digests(lines: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256: a running hash over each conversation's
    ``role:text`` lines in order, so that no conversation is held in one row."""
    kind = lines.schema["conv_id"].dataType.simpleString()

    def run(batches):
        conv, h = None, None
        for pdf in batches:
            out = []
            for c, role, text in zip(pdf["conv_id"].astype(object).where(pdf["conv_id"].notna(), None), pdf["role"], pdf["text"]):
                if h is None or c != conv:
                    if h is not None:
                        out.append((conv, h.hexdigest()))
                    conv, h = c, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(role.encode() + b":" + text.encode())
            yield pd.DataFrame(out, columns=["conv_id", "repaired_sha256"])
        if h is not None:
            yield pd.DataFrame([(conv, h.hexdigest())], columns=["conv_id", "repaired_sha256"])

    ordered = lines.repartition("conv_id").sortWithinPartitions("conv_id", "at")
    return ordered.select("conv_id", "role", "text").mapInPandas(run, f"conv_id {kind}, repaired_sha256 string")
