"""Small cases of the training-data operators: nulls, empty texts, repeated
rows, ties, clashing columns, empty tables, and brute-force comparisons."""
import base64
import bz2
import collections
import gzip
import random
import urllib.parse
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerscope.llm import chat, fingerprint, htmltext, license, linededup, mixing, neardup, packing, quality, secretscan

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, n_words string, _x int"
LINE = "one two three four five six seven eight nine ten eleven"


def rows():
    long = " ".join(f"word{i}" for i in range(3000))
    return [(1, LINE + "\nshort", "en", "src1", 5, "clash", 1), (2, LINE + "\nother", "en", "src1", 5, "clash", 2),
            (3, None, "en", None, None, None, None), (4, "", None, "src2", 0, None, 4), (5, long, "de", "src2", 1, None, 5),
            (6, long + " tail", "de", "src3", 1, None, 6), (6, long + " tail", "de", "src3", 1, None, 6),
            (None, "a b c", "fr", "x", 1, None, 7), (8, "\n\n \n", "fr", "x", 1, None, 8)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality_edges(docs, none):
    out = {(r.doc_id, r._x): r for r in quality.judge(docs, sample_rows=10).collect()}
    assert len(out) == 8 and out[3, None].n_words == 0 and out[5, 5].kept and not out[4, 4].kept
    assert quality.judge(none).count() == 0
    assert quality.passing(docs).columns == [c for c in docs.columns if c != "n_words"]


def test_quality_repeat_words(spark):
    w = [str(i) for i in range(8)]
    d = spark.createDataFrame([(" ".join(w + ["x"] + w),), (" ".join(w),), (" ".join(["a"] * 20),)], "text string")
    assert [r.n_repeat_words for r in quality.features(d).collect()] == [16, 0, 20]


def test_line_dedup_edges(docs, none):
    out = {(r.doc_id, r._x): r for r in linededup.dedup_lines(docs).collect()}
    assert out[1, 1].text == LINE + "\nshort" and out[2, 2].text == "other" and out[2, 2].n_deleted == 1
    assert out[3, None].text is None and out[8, 8].text == "\n\n \n"
    assert linededup.dedup_lines(none).count() == 0


def test_line_dedup_against_brute_force(spark):
    rnd = random.Random(3)
    pool = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6))) for _ in range(12)]
    texts = ["\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 9))) for _ in range(30)]
    seq, where = [], []
    for d, t in enumerate(texts):
        for i, x in enumerate(t.split("\n")):
            seq.append(x)
            where.append((d, i))
    gone = set()
    for i in range(len(seq)):
        for j in range(i):
            n = words = 0
            while i + n < len(seq) and where[i + n][0] == where[i][0] and where[j + n][0] == where[j][0] and seq[i + n] == seq[j + n]:
                words += len(seq[i + n].split())
                n += 1
            if words >= 10:
                gone |= {where[i + k] for k in range(n)}
    want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in enumerate(texts)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in linededup.dedup_lines(df).collect()} == want and gone


def test_near_dup_against_brute_force(spark, docs, none):
    rnd = random.Random(5)
    base = [rnd.choice("abcdefghijklmnopqrst") + str(rnd.randint(0, 9)) for _ in range(120)]
    texts = [" ".join(base)]
    for _ in range(60):
        w = list(base)
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(len(w))] = rnd.choice("uvwxyz")
        texts.append(" ".join(w))
    with np.errstate(over="ignore"):
        doc, h, w = neardup.weighted_shingles(texts)
    sets = [(h[doc == i], w[doc == i]) for i in range(len(texts))]
    root = list(range(len(texts)))

    def find(x):
        return x if root[x] == x else find(root[x])
    for i in range(len(texts)):
        for j in range(i):
            u, v = dict(zip(*sets[i])), dict(zip(*sets[j]))
            s = sum(1 / sum(max(u.get(e, 0) / u[d], v.get(e, 0) / v[d]) for e in {*u, *v}) for d in u if d in v)
            assert abs(s - neardup.probability_jaccard(*sets[i], *sets[j])) < 1e-9
            if s >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in neardup.near_classes(df).collect()} == {i: find(i) for i in range(len(texts))}
    kept = sorted((r._x or 0) for r in neardup.one_of_each(docs).collect())
    assert kept == [0, 1, 2, 5, 7, 8] and neardup.near_classes(none).count() == 0


def test_packing_round_trip(docs, none, spark):
    pieces = packing.token_pieces(docs)
    packed = packing.packed_documents(docs).collect()
    assert sum(r.length for r in packed) == pieces.agg(F.sum("length")).first()[0]
    fill = collections.defaultdict(list)
    for r in packed:
        fill[r.sequence_id].append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
    assert [r.length for r in packed if r.doc_id == 4] == [1] and packing.packed_documents(none).count() == 0
    one = docs.where("doc_id = 5")
    ids = packing.sequences(packing.token_pieces(one), packing.packed_documents(one)).collect()
    crc = {zlib.crc32(bytes(r.ids)) for r in packing.token_pieces(one).collect()}
    assert sum(len(r.ids) for r in ids) // 4 == sum(r.length for r in packing.packed_documents(one).collect()) and crc


def test_packing_plan_places_everything():
    rnd = random.Random(1)
    hist = collections.Counter(rnd.choice([4096, rnd.randint(500, 3000), rnd.randint(1, 400)]) for _ in range(4000))
    runs, n = packing.plan(dict(hist))
    placed = collections.Counter()
    used = collections.Counter()
    for length, a, b, first, each, offset in runs:
        placed[length] += b - a
        for i in range(b - a):
            used[first + i // each] += length
    assert placed == hist and max(used.values()) <= 4096 and n <= 1.02 * -(-sum(k * v for k, v in hist.items()) // 4096) + 2


def test_mixing_shares_shortages_with_siblings_first(spark, docs, none):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "z", 1000)], "d string, s string, tokens long")
    got = {r.s: r.got for r in mixing.leaf_budgets(leaves, ["d", "s"], {}, 400.0, 1).collect()}
    assert got == {"x": 10.0, "y": 190.0, "z": 200.0}
    tree = {"lang": "lang", "source": "source"}
    assert mixing.mix(none, tree, {}).count() == 0
    assert mixing.mix(docs, tree, {}, share=1.0, max_epochs=2).count() > 0


def test_chat_round_trip(spark):
    said = [(1, 0, "system", "be <|im_end|> kind"), (1, 1, "user", "x" * 3000), (1, 2, "assistant", "<\\|a|> <<|im_start|>"), (1, 2, "assistant", None),
            (1, 3, None, "y " * 900), (1, 4, "assistant", "done <"), (None, 0, "a\nb", "<|nl|>")]
    df = spark.createDataFrame(said, "conv_id long, turn int, role string, text string")
    got = chat.read_back(chat.format_windows(df, 64, 32)).orderBy("conv_id", "window").collect()
    turns = [(r.conv_id, t.role, t.text) for r in got for t in r.turns]
    assert sorted(turns, key=str) == sorted([(c, r or "", t or "") for c, _, r, t in said], key=str)
    assert [t for r in got if r.conv_id == 1 for t in r.targets] == ["", "<\\|a|> <<|im_start|>", "done <"]
    assert chat.format_windows(df.limit(0)).count() == 0


def test_fingerprints(docs, none, spark):
    d = {(r.doc_id, r._x): r.next_text for r in fingerprint.with_next(docs, rows=2).collect()}
    assert len(d) == 8 and d[1, 1].endswith("other") and d[8, 8] == "a b c"
    roots = [r.root for r in fingerprint.fingerprints(spark.createDataFrame([(1, "a\nb"), (2, "a\nb"), (3, "a\n\nb"), (4, "a b")], "doc_id int, text string")).orderBy("doc_id").collect()]
    assert roots[0] == roots[1] and len(set(roots)) == 3 and fingerprint.with_next(none).count() == 0


def test_secrets_through_layers(docs, none):
    inner = "my secret: abcdefgh123"
    url = urllib.parse.quote(inner)
    packed = base64.b64encode(gzip.compress(url.encode())).decode()
    for text in (url.replace("secret", "s%65cret"), base64.b64encode(inner.encode()).decode(), packed, packed + " \\u0070assword=12345678"):
        base, spans, _ = secretscan.secrets("é\n" + text)
        assert set(base) <= set(spans) and any(k == 0 and a >= 2 for a, k, b in spans)
    assert secretscan.scan("token: secret: abcdefgh12") == [] and secretscan.secrets("%2525252541") == ([], [], 0)
    assert secretscan.secret_spans(docs).count() == 9 and secretscan.secret_spans(none).count() == 0


def _b64(b, wrap=0):
    t = base64.b64encode(b).decode()
    return "\n".join(t[i:i + wrap] for i in range(0, len(t), wrap)) if wrap else t


def test_secrets_in_nested_packing():
    inner = b"my secret: abcdefgh123"
    gz = gzip.compress
    for b in (gz(gz(inner)), gz(zlib.compress(inner)), gz(bz2.compress(inner)), gz(b"first") + gz(inner), bz2.compress(b"first") + bz2.compress(inner),
              gz(b"nothing in here " * 2) + zlib.compress(inner), gz(_b64(gz(inner)).encode())):
        run = _b64(b)
        assert (3, 0, 3 + len(run)) in secretscan.secrets("é, " + run)[1]
    words = b"lorem ipsum, dolor\n" * 600_000
    for b in (words + inner + words, inner + words, words + inner, words + _b64(gz(inner)).encode() + b"\n" + words):
        run = _b64(gz(b, 1))
        _, spans, over = secretscan.secrets(run)
        assert spans == [(0, 0, len(run))] and over == 0


def test_secrets_in_wrapped_and_odd_text():
    inner = "x" * 50 + " my secret: abcdefgh123 " + "some more words to come " * 9
    for text in (_b64(inner.encode(), 64), _b64(inner.encode(), 76).replace("\n", "\r\n"), _b64(gzip.compress(inner.encode()), 64),
                 _b64(_b64(inner.encode(), 64).encode()), "-----BEGIN CERTIFICATE-----\n" + _b64(inner.encode(), 64) + "\n-----END CERTIFICATE-----",
                 _b64("secret: abcdefgh\u00a0\f\u3000\ufeff\0 end".encode()), _b64(inner.encode("utf-16")), _b64(inner.encode("utf-16-le")),
                 _b64(bytes(range(128, 256)) + inner.encode()), "%ff%73ecret: abcdefgh123"):
        assert any(k == 0 for _, k, _ in set(secretscan.secrets(text)[1]) - set(secretscan.scan(text))), text
    text = "first line\n" + _b64(inner.encode(), 64) + "\nlast line"
    assert (11, 0, len(text) - 10) in secretscan.secrets(text)[1]
    assert "\n".join(secretscan._lines(text)) == text


def test_licenses(spark, none):
    d = spark.createDataFrame([(1, "x\nReleased under the MIT licence.\nReleased under the MIT License."), (2, None), (3, "")], "doc_id long, text string")
    got = [(r.doc_id, r.license, r.first_word, r.last_word) for r in license.license_matches(d).collect()]
    assert got == [(1, "MIT", 6, 10)] and license.license_matches(none).count() == 0


def test_html(spark):
    page = ("<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a href=x>menu</a></nav><div class='cookie-notice'>ok?</div>"
            "<article><h1>T{0}</h1><p>one &amp; <b>t</b>wo {0}<br><p>three\n four</article><section id=comments>hi {0}</section><footer>f{0}</footer></body></html>")
    d = spark.createDataFrame([(i, "http://h/x", page.format(i)) for i in range(5)] + [(9, None, None)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in htmltext.extract(d).collect()}
    assert got[2] == "T2 one & two 2 three four" and got[9] == "" and htmltext.extract(d.limit(0)).count() == 0


def test_html_drops_nothing_else(spark):
    def texts(pattern):
        d = spark.createDataFrame([(i, "http://h/x", pattern.format(i)) for i in range(5)], "page_id long, url string, html string")
        return {r.page_id: r.text for r in htmltext.extract(d).collect()}[2]
    page = "<html><body><div class='nav'><a href=x>menu</a></div>{}<div class='ad'>buy {{0}}</div></body></html>"
    for names in ("layout with-sidebar", "post share-enabled", "content no-comments", "sidebar"):
        assert texts(page.format(f"<div class='{names}'><article><p>one {{0}}</article></div>")) == "one 2"
    assert texts(page.format("<div class='post share-enabled'><p>one {0}</div>")) == "one 2"
    assert texts(page.format("<article><p>one {0} <svg width='1' /> two<p>three <math><mi>x{0}</mi></math><address>street {0}</address><button>go {0}</button></article>")
                 ) == "one 2 two three x2 street 2 go 2"
    assert texts(page.format("<h1>T{0}</h1><div class='lead'>lead {0}</div><div class='top'>Site</div><div class='more'><a href=y>see {0}</a></div>"
                             "<div class='body'><p>body {0} text<p>shared</div>")) == "T2 lead 2 body 2 text shared"
    assert texts(page.format("<article><p>one {0}</article><div id='comments'><article class='c'>said {0}</article></div>")) == "one 2"
