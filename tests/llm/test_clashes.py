"""Operators on tables whose columns have the names that their helpers use."""
import pytest

from ledgerscope.llm import fingerprint, linededup, mixing, neardup

LINE = "one two three four five six seven eight nine ten eleven"
HELPERS = ["_t", "_gone", "_l", "_new", "_nl", "_id", "_th", "_h", "_k", "_b", "_at", "_borders", "_n", "_row", "_m_lang", "full", "cut", "rest",
           "tokens", "part", "a", "x", "i", "l", "d", "g", "h", "r", "p", "idx", "pos", "node", "key", "_pid", "with.dot"]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, LINE + "\nshort", "en", "s1"), (2, LINE + "\nother", "en", "s1"), (3, None, None, None), (None, "a b c", "de", "s2"), (5, LINE + "\nother", "en", "s2")]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{h}` int" for h in HELPERS)
    return spark.createDataFrame([(*r, *[100 * j + k for k in range(len(HELPERS))]) for j, r in enumerate(rows)], schema)


def values(df, text=False):
    cols = ["doc_id", *(["text"] if text else []), *HELPERS]
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_columns_pass_through(clashing):
    before = values(clashing)
    out = linededup.dedup_lines(clashing)
    assert values(out) == before and {r.doc_id: r.text for r in out.collect()}[2] == "other"
    assert values(fingerprint.with_next(clashing, rows=2), True) == values(clashing, True)
    kept = neardup.one_of_each(clashing)
    assert kept.columns == clashing.columns and set(values(kept)) < set(before) and kept.count() == 4
    out = mixing.mix(clashing, {"lang": "lang", "source": "source"}, {"lang": {}, "source": {}}, 1.0, 1, 7)
    assert set(values(out)) <= set(before) and set(clashing.columns) <= set(out.columns)
