"""Conversation repair: the agenda and the query against exhaustive search."""
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerscope.llm import q_repair, repair

SCHEMA = "conv_id long, turn long, role string, text string, pos long, h string, part string"
WHITE = " \t\n\x0b\f\r"


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if d == 0:
            continue
        if d == 1:
            text = ""
        if d == 2:
            text = re.sub("[.!?]", "", text)
        out += [(c, t, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def exhaustive(rows, found):
    """Cheapest (cost, audit, lines): all edit sequences within a cost limit that grows until one fits."""
    alive, accept = re.compile("s?(ua)*u?$"), re.compile("(s?(ua)+)?$")

    def all_within(i, seq, limit, cost, audit, lines):
        if not alive.match(seq) or cost > limit:
            return
        if i == len(rows) and accept.match(seq):
            yield cost, audit, lines
        if i < len(rows):
            role, text, f = rows[i][2], rows[i][3], found[i]
            yield from all_within(i + 1, seq, limit, cost + 3, audit + "D", lines)
            if f not in ("blank", "duplicate"):
                late = f == "truncated"
                if role:
                    yield from all_within(i + 1, seq + role[0], limit, cost + late, audit + "K", (*lines, f"{role}:{text}"))
                for r in ("user", "assistant"):
                    yield from all_within(i + 1, seq + r[0], limit, cost + 2 + late, audit + "R", (*lines, f"{r}:{text}"))
        for r in ("user", "assistant"):
            yield from all_within(i, seq + r[0], limit, cost + 2, audit + "I", (*lines, r + ":"))

    for limit in itertools.count():
        if best := min(all_within(0, "", limit, 0, "", ()), default=None):
            return best


def want(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        got = sorted((r for r in damage(rows) if r[0] == conv),
                     key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        f = faults(got)
        turns = [r[1] for r in got if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(got, got[1:]))
        cost, audit, lines = exhaustive(got, f) if got else (0, "", ())
        out[conv] = (gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), pairs, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def made_up(seed, n):
    rnd = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for t in range(rnd.randint(1, 6)):
            turn = None if rnd.random() < 0.1 else t * rnd.choice([1, 1, 1, 2])
            rows.append((conv, turn, rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "unit"]),
                         rnd.choice(["Yes.", "No", "why?", "a\n ", " ", "", None, "Hm! \t", "ü."])))
    return rows


def query(spark, rows, monkeypatch):
    df = spark.createDataFrame([(*r, 1, "h", "p") for r in rows], SCHEMA)
    monkeypatch.setattr(q_repair, "table", lambda *_: df)
    out = q_repair.op13_conversation_repair(spark, "")
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r[0]: tuple(r)[1:] for r in out.collect()}


@pytest.mark.parametrize("part, fan", [(4096, 16), (2, 2)])
def test_query_against_exhaustive_search(spark, monkeypatch, part, fan):
    monkeypatch.setattr(repair, "PART_ROWS", part)
    monkeypatch.setattr(repair, "FAN", fan)
    rows = made_up(part, 60) + [(500, 0, "user", "Same.")] * 5 + [(501, t, "user", "Same.") for t in range(4)]
    got, expected = query(spark, rows, monkeypatch), want(rows)
    assert got == expected
    assert len({len(v[6]) for v in got.values()}) > 4


def test_agenda_and_parts_against_exhaustive_search():
    code = {"s": ("system", ""), "u": ("user", ""), "a": ("assistant", ""), "-": ("tool", ""), "x": ("user", "blank"),
            "S": ("system", "truncated"), "U": ("user", "truncated"), "A": ("assistant", "truncated"), "_": ("tool", "truncated")}
    for n in range(4):
        for codes in itertools.product(repair.CODES, repeat=n):
            rows = [(1, i, code[c][0], "t") for i, c in enumerate(codes)]
            assert repair.whole("".join(codes)) == exhaustive(rows, [code[c][1] for c in codes])[:2]
    rnd = random.Random(1)
    for _ in range(60):
        codes = "".join(rnd.choice(repair.CODES) for _ in range(rnd.randint(2, 30)))
        k = rnd.randint(1, len(codes) - 1)
        table = {(p, q): w for p, q, *w in repair.joined(repair.part_table(codes[:k]), repair.part_table(codes[k:]))}
        assert tuple(min(table[0, q] for q in repair.ACCEPTING if (0, q) in table)) == repair.whole(codes)


def test_returned_rows(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Why?"), (1, 2, "user", "Hello."), (1, 3, "assistant", "")]
    per, listed, lines = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    one = per.first()
    assert (one.blank, one.illegal, one.cost, one.audit) == (1, 1, 5, "KKRD")
    assert [(r.edit, r.role) for r in listed.orderBy("at").collect()] == [("K", "system"), ("K", "user"), ("R", "assistant"), ("D", None)]
    assert [(r.role, r.text) for r in lines.orderBy("at").collect()] == [("system", "Be brief."), ("user", "Why?"), ("assistant", "Hello.")]


def test_empty_table(spark, monkeypatch):
    assert query(spark, [], monkeypatch) == {}


def test_long_conversation(spark):
    n = 20_000
    rows = spark.range(n).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.expr("if(id % 2 = 0, 'user', 'assistant')").alias("role"),
                                 F.concat(F.lit("line "), "id", F.lit(".")).alias("text"))
    per, _, lines = repair.repair(rows)
    one = per.first()
    assert (one.cost, one.audit, one.gaps) == (0, "K" * n, 0)
    whole = "\n".join(f"{'assistant' if i % 2 else 'user'}:line {i}." for i in range(n))
    assert repair.digests(lines).first().repaired_sha256 == hashlib.sha256(whole.encode()).hexdigest()
