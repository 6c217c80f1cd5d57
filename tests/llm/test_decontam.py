"""Benchmark decontamination against brute force, and its edge cases."""
import random
import re

import pytest

from ledgerscope.llm import decontam

SCHEMA = "doc_id long, text string, seg string, ord int, w int, terms string, n_words string"
ITEMS = "item_id long, text string, w string"


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(text, items, window, near):
    d, hit, phrase, close = words(text), set(), set(), set()
    for item, t in items:
        name, b = "" if item is None else str(item), words(t)
        n = min(window, len(b))
        for i in range(len(b) - n + 1 if n else 0):
            g = b[i:i + n]
            for s in range(len(d) - n + 1):
                if d[s:s + n] == g:
                    hit |= set(range(s, s + n))
                    phrase.add(name)
            if any(set(g) <= set(d[s:s + near]) for s in range(len(d))):
                close.add(name)
    return len(d), len(hit), sorted(phrase), sorted(close)


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "x", 1, 1, "y", None) for i, t in docs], SCHEMA)
    out = decontam.contamination(d, spark.createDataFrame([(i, t, "z") for i, t in items], ITEMS), **kw)
    return sorted(((r.doc_id if r.doc_id is not None else -1), r.n_words, r.n_hit, r.items, r.near_items) for r in out.collect())


@pytest.mark.parametrize("segment, block, slice_", [(1_000_000, 50_000, 1_000_000), (200, 7, 5)])
def test_against_brute_force(spark, monkeypatch, segment, block, slice_):
    monkeypatch.setattr(decontam, "SEGMENT_CHARS", segment)
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", block)
    monkeypatch.setattr(decontam, "CANDIDATES", slice_)
    rnd = random.Random(segment)
    vocab = ["the", "a", "Of", "É", "x1", "zoé", "漢字", "rare"] + [f"w{i}" for i in range(10)]

    def text(n):
        return "".join(rnd.choice(vocab) + rnd.choice([" ", ", ", "\n", "-", "  ", "\x7f", "{"]) for _ in range(n))
    docs = [(i, text(rnd.randint(0, 60))) for i in range(40)]
    items = [(i, text(rnd.randint(0, 9))) for i in range(14)]
    items += [(50, docs[3][1]), (51, docs[3][1]), (51, "the the"), (None, "of the"), (52, docs[5][1][:80]), (53, None), (54, " ?! ")]
    docs += [(3, docs[3][1] + " tail " + docs[3][1]), (None, docs[3][1]), (60, None), (61, ""), (62, "lead " + docs[5][1][10:])]
    got = run(spark, docs, items, window=5, near=8)
    want = sorted(((i if i is not None else -1), *brute(t, items, 5, 8)) for i, t in docs)
    assert got == want
    assert any(r[2] for r in got) and any(set(r[4]) - set(r[3]) for r in got)


def test_windows_do_not_cross_documents(spark):
    half = ["one two three four five", "six seven eight nine ten"]
    got = run(spark, list(enumerate(half)), [(1, " ".join(half))], near=30)
    assert [r[2:] for r in got] == [(0, [], []), (0, [], [])]


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == [(1, 2, 0, [], [])]
    assert run(spark, [(1, "a b")], [(1, "not here")]) == [(1, 2, 0, [], [])]


def test_long_text_and_one_long_word(spark, monkeypatch):
    monkeypatch.setattr(decontam, "TEXT_STEP", 50)
    item = " ".join(f"k{i}" for i in range(10))
    long = "x" * 500 + " " + " ".join(f"v{i}" for i in range(20_000)) + " " + item + " " + "y" * 400
    assert run(spark, [(1, long)], [(9, item.upper())]) == [(1, 20_012, 10, ["9"], [])]
