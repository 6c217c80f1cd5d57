"""Located edits of two fingerprints and their likeness."""
import random

from ledgerscope.llm import fingerprint as fp

SCHEMA = "doc_id long, x string, y string, a int, h int"


def edits(spark, pairs):
    d = spark.createDataFrame([(i, x, y, 1, 2) for i, x, y in pairs], SCHEMA)
    d = fp.with_tree(fp.with_tree(d, "x", "a_"), "y", "b_")
    out = {}
    for r in fp.edits(d).collect():
        out.setdefault(r.doc_id, set()).add((r.kind, r.a_paragraph, r.b_paragraph, r.n))
    return out


def test_single_edits_are_located(spark):
    got = edits(spark, [(1, "a\nb\nc", "b\na\nc"), (2, "a\nb\nc", "a\nc"), (3, "a\nb\nc", "a\nb\nx\ny\nc"), (4, "a\nb", "a\nb"), (5, "a\nb\nc", "a\nX\nc"),
                        (6, None, "a"), (None, "a\n\nb\n\nc", "a\n\nb\n\nd"), (8, "a\na\na", "a\na"), (8, "a\na\na", "a\na")])
    assert got == {1: {("moved", 0, 1, 1)}, 2: {("deleted", 1, None, 1)}, 3: {("inserted", None, 2, 2)}, 5: {("deleted", 1, None, 1), ("inserted", None, 1, 1)},
                   6: {("deleted", 0, None, 1), ("inserted", None, 0, 1)}, None: {("deleted", 4, None, 1), ("inserted", None, 4, 1)}, 8: {("deleted", 2, None, 1)}}


def test_edits_turn_one_text_into_the_other(spark):
    rng = random.Random(3)
    pairs = []
    for i in range(120):
        x = [f"line {rng.randrange(12 if i % 3 else 400)}" for _ in range(rng.randrange(1, 90))]
        y = list(x)
        for _ in range(rng.randrange(1, 6)):
            at = rng.randrange(len(y) + 1)
            kind = rng.randrange(4)
            if kind == 0:
                y.insert(at, f"new {rng.randrange(5)}")
            elif kind == 1 and at < len(y) > 1:
                del y[at]
            elif kind == 2:
                size = rng.randrange(1, 30)
                part = y[at:at + size]
                del y[at:at + size]
                to = rng.randrange(len(y) + 1)
                y[to:to] = part
            elif at < len(y):
                y[at] += " changed"
        pairs.append((i, x, y))
    got = edits(spark, [(i, "\n".join(x), "\n".join(y)) for i, x, y in pairs])
    for i, x, y in pairs:
        found = got.get(i, set())
        assert bool(found) == (x != y)
        gone = {a + j for k, a, _, n in found if k in ("deleted", "moved") for j in range(n)}
        come = {b + j for k, _, b, n in found if k in ("inserted", "moved") for j in range(n)}
        assert [p for j, p in enumerate(x) if j not in gone] == [p for j, p in enumerate(y) if j not in come]
        moved = [(a + j, b + j) for k, a, b, n in found if k == "moved" for j in range(n)]
        assert all(x[a] == y[b] for a, b in moved)
        # a paragraph deleted and inserted as it was would be a move
        deleted = [x[a + j] for k, a, _, n in found if k == "deleted" for j in range(n)]
        inserted = [y[b + j] for k, _, b, n in found if k == "inserted" for j in range(n)]
        assert not set(deleted) & set(inserted) or any(x.count(p) != y.count(p) for p in set(deleted) & set(inserted))


def test_likeness_survives_an_inserted_word(spark):
    words = " ".join(f"w{i}" for i in range(200))
    d = spark.createDataFrame([(words, "put " + words), (words, words.replace("w100 ", "")), (words, words), ("a b", "a b"), ("a b", "c d"), (None, "")], "x string, y string")
    d = fp.with_tree(fp.with_tree(d, "x", "a_"), "y", "b_")
    near = [r[0] for r in d.select(fp.likeness("a_twigs", "b_twigs")).collect()]
    assert near[0] > 0.9 and near[1] > 0.9 and near[2:] == [1.0, 1.0, 0.0, 1.0]
