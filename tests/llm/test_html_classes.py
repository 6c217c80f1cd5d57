"""Equivalence classes of a host's tokens, against classes from whole
occurrence vectors, and hosts with several section templates."""
import collections
import random

import pytest

from ledgerscope.llm import htmltext

SCHEMA = "page_id long, url string, html string"
MENU = "<div class='top'><a href='/a'>Home</a> <a href='/b'>About us</a></div>"
END = "<div class='bottom'>All our pages</div>"


def body(i, n=3):
    rng = random.Random(i)
    return [" ".join(f"w{rng.randrange(5000)}" for _ in range(12)) for _ in range(n)]


def texts(spark, pages, host="h.example"):
    d = spark.createDataFrame([(i, f"https://{host}/{i}" if "/" not in host else host, h) for i, h in enumerate(pages)], SCHEMA)
    return {r.page_id: r.text for r in htmltext.extract(d).collect()}


@pytest.mark.parametrize("sections", [1, 2, 3, 4])
def test_hosts_of_several_section_templates(spark, sections):
    pages = ["<html><body>" + MENU + f"<div class='k{i % sections}'><div class='label'>Section {i % sections}</div>"
             + "".join(f"<p>{p}</p>" for p in body(i)) + "</div>" + END + "</body></html>" for i in range(24)]
    got = texts(spark, pages)
    for i in range(24):
        assert " ".join(body(i)) in got[i] and "Home" not in got[i] and "All our pages" not in got[i]


def test_shared_passages_stay(spark):
    shared = "This passage is on several pages of the host and belongs to their articles."
    pages = ["<html><body>" + MENU + "<div class='text'>" + "".join(f"<p>{p}</p>" for p in body(i) + ([shared] if i % 3 else [])) + "</div>" + END
             + "</body></html>" for i in range(12)]
    got = texts(spark, pages)
    assert all(got[i] == " ".join(body(i) + ([shared] if i % 3 else [])) for i in range(12))


def test_comments_attributes_and_raw_elements(spark):
    got = texts(spark, ["<article><!-- <style> --><p>Main article text.</p><p>Second.</p></article>",
                        "<article><p>One.</p><!-- old <script> tag --><p>Two.</p><script>var a = '<p>no</p>';</script><p>Three.</p></article>",
                        "<article><p title='<svg>'>Main text.</p><p>Rest.</p></article>", "<article><p title=\"a > b <style>\">Main</p> text <svg a='/>'><g></svg>end</article>",
                        "<article><script src=\"a>b\">no<!-- </script><p>Yes</p><!-- x --> 5 <6 or 7</article>", "<article><p>it's <b>a</b> 'quote</p><style>p{}</style><p>x=\"y</p></article>",
                        "<style>never closed <p>gone</p>", None, ""], host="https://one.example/x")
    assert got == {0: "Main article text. Second.", 1: "One. Two. Three.", 2: "Main text. Rest.", 3: "Main text end", 4: "Yes 5 <6 or 7", 5: "it's a 'quote x=\"y", 6: "", 7: "", 8: ""}


def test_six_pages_with_comments_on_raw_elements(spark):
    got = texts(spark, [f"<html><body><article><h1>T{i}</h1><!-- inline <style> removed --><p>{body(i, 1)[0]}</p></article></body></html>" for i in range(6)])
    assert got == {i: f"T{i} {body(i, 1)[0]}" for i in range(6)}


def test_classes_against_whole_vectors(spark):
    rng = random.Random(2)
    pages = []
    for i in range(40):
        k = rng.randrange(4)
        h = "<html><body>" + MENU
        h += f"<div class='s{k}'><div class='fixed'>Section {k}</div>" + (f"<div class='extra'>Box {k}</div>" if rng.random() < 0.6 else "")
        h += "".join(f"<p>{p}</p>" for p in body(i, rng.randrange(0, 3))) + "<ul>" + "<li>item</li>" * rng.randrange(3) + "</ul></div>" + END * rng.randrange(1, 3)
        pages.append((i, f"h{i % 2}", h + "</body></html>"))
    pages += [pages[5], pages[5], pages[6]]                       # repeated rows count as pages
    got = {r.host: r for r in htmltext.templates(spark.createDataFrame(pages, "page long, host string, html string")).collect()}
    for host in ("h0", "h1"):
        vectors, count = collections.defaultdict(collections.Counter), collections.Counter()
        for row, (_, at, html) in enumerate(pages):
            if at != host:
                continue
            vectors["p", ""][row] = 1
            previous = ""
            for path, text, _, _ in htmltext.blocks(html):
                parts = path.split("/")
                for n in range(1, len(parts) + 1):
                    p = "/".join(parts[:n])
                    if not (previous + "/").startswith(p + "/"):
                        vectors["p", p][row] += 1
                previous = path
                vectors["t", f"{path}\n{htmltext._hash(text):x}"][row] += 1
        vectors = {k: v for k, v in vectors.items() if len(v) >= 3}
        want = {t for (kind, t), v in vectors.items() if kind == "t"
                and any(vectors.get(("p", "/".join(t.split("\n")[0].split("/")[:n]))) == v for n in range(len(t.split("\n")[0].split("/")) + 1))}
        assert set(got[host].texts) == want and want
        once = {p for (kind, p), v in vectors.items() if kind == "p" and p and set(v.values()) == {1}}
        assert set(got[host].slots) | set(got[host].links) == once and not set(got[host].slots) & set(got[host].links)
