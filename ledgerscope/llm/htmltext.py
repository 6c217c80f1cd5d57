"""HTML extraction (7): equivalence classes of tokens per host, slots between them.

A page is a sequence of tokens: its block elements, each named by its path of
block elements with class, id and role and standing for its start and its end
tag, and its text blocks, each named by its path and text. Per host, tokens
with the same occurrence vector (how often on which page) form an equivalence
class. The vector is never built: both halves of a 64-bit hash of (page, count) are
added up over the pages, so a class is a group of equal sums, whatever the host's
size.

A class is valid if it is on ``min_pages`` pages, in any share of the host's,
and holds an element, so that its tokens nest: a text is of the template only
if one of the elements around it is of its class, that is, the text is there
exactly as often as that element on every page. A passage that some pages share
is in no class of an element around it, so it stays. The elements of valid
classes that occur once on each of their pages nest by their paths into the
template; what lies in such an element and in none further in is its slot.

What a slot holds is told by its tokens: template texts are left out, unless the
slot also has other text on the page; a slot without text of its own on any page
(links only) is left out but for headings. Tag and name lists are hints on top:
navigation, header, footer, aside, form, advert, notice, comment and the like
are not text (names count as class tokens, not on what wraps the page's only
``article`` or ``main``), and an ``article`` or ``main`` slot, that with most own
text on the host, goes before the others. What is in no slot, as on a host with
too few pages to show a template, is kept unless a hint excludes it.

Defined results: null html is an empty page and gives an empty text; null url
is a host of its own; repeated rows are separate pages with equal results; an
empty table stays empty; output columns replace input columns of the same name.
"""
from __future__ import annotations

import html as entities
import re

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_keys, written

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
ATTR = re.compile(r"\b(class|id|role|aria-hidden|hidden|style|type)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: HTML element kinds.
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "select", "title", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"html", "head", "body", "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
         "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "li", "main", "menu",
         "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption"}
CLOSED_BY = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"},
             "th": {"td", "th", "p"}}
EXCLUDED_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "head"}
EXCLUDED_NAMES = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|footer|foot|header|masthead|banner|ads?|advert\w*|sponsor\w*|promo\w*|"
    r"cookies?|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommend\w*|"
    r"comments?|respond|replies|disqus|widget|toolbar|pagination|pager|skip|hidden|copyright|legal)(?=$|[\s_-])", re.I)
#: Parts of a class token that say something about a wrapper's contents, as in with-sidebar.
MODIFIERS = {"with", "without", "has", "have", "no", "not", "enabled", "disabled", "on", "off", "layout"}
HEADER_IN = {"article", "main"}


def _excluded_name(names: str) -> bool:
    return any(EXCLUDED_NAMES.search(t) and MODIFIERS.isdisjoint(re.split("[_-]", t.lower())) for t in names.split())


def blocks(page: str) -> list[tuple[str, str, int, bool]]:
    """Text blocks of a page in order: (path, text, characters in links,
    excluded by its path). Path elements are joined by '/'."""
    stack: list[tuple[str, str, bool, int]] = []     # tag, name, excluded by tag or style, number if excluded by name
    out: list[tuple[str, str, int, bool, tuple]] = []
    holds: list[tuple] = []                         # per article or main: the elements around it that are excluded by name
    opened = 0
    buf: list[str] = []
    linked = in_link = 0
    skip = None

    def flush():
        nonlocal linked
        text = " ".join("".join(buf).split())
        if text:
            out.append(("/".join(s[1] for s in stack), text, linked, any(s[2] for s in stack), tuple(s[3] for s in stack if s[3])))
        buf.clear()
        linked = 0

    for m in TOKEN.finditer(page):
        tag = m.group(2)
        if tag is None:
            raw = m.group()
            if skip is None and not (raw[:1] == "<" and len(raw) > 1):
                text = entities.unescape(raw)
                buf.append(text)
                if in_link:
                    linked += len(text)
            continue
        tag, closing, attrs = tag.lower(), m.group(1) == "/", m.group(3)
        if skip is not None:
            if closing and tag == skip:
                skip = None
            continue
        if tag in RAW:
            if not closing and not attrs.rstrip().endswith("/"):
                skip = tag
            continue
        if tag == "a":
            in_link = 0 if closing else 1
            continue
        if tag in ("br", "hr"):
            buf.append(" ")
            continue
        if tag not in BLOCK:
            continue
        flush()
        if closing:
            if any(s[0] == tag for s in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        shut = CLOSED_BY.get(tag) or ({"p"} if tag in BLOCK else set())
        while stack and stack[-1][0] in shut:
            stack.pop()
        a = {k.lower(): (x or y or z) for k, x, y, z in ATTR.findall(attrs)} if "=" in attrs else {}
        name = tag + "".join(f".{a[k].strip().lower()}" for k in ("class", "id", "role") if a.get(k)).replace("/", " ")
        inside = any(s[0] in HEADER_IN for s in stack)
        bad = ((tag in EXCLUDED_TAGS and not (tag == "header" and inside)) or a.get("aria-hidden") == "true"
               or bool(re.search(r"display\s*:\s*none", a.get("style", ""))))
        named = any(_excluded_name(a.get(k, "")) for k in ("class", "id", "role"))
        if tag in HEADER_IN and not named and not bad and not any(s[2] for s in stack):
            holds.append(tuple(s[3] for s in stack if s[3]))
        opened += 1
        stack.append((tag, name, bad, opened if named and tag not in ("html", "body", "article", "main") else 0))
    flush()
    # where every article or main lies inside excluded names, those are wrappers
    wrappers = set() if () in holds else {x for h in holds for x in h}
    return [(path, text, n, bad or any(x not in wrappers for x in by_name)) for path, text, n, bad, by_name in out]


def _without_raw(page: str) -> str:
    """Raw elements end at their own end tag only, whatever their content looks
    like; what comments and attribute values say opens none."""
    return MARKUP.sub(lambda m: " " if m.group("raw") else m.group(), page)


MARKUP = re.compile(r"<!--.*?(?:-->|\Z)"
                    r"|(?P<raw><svg\b(?:=\s*+(?:\"[^\"]*\"|'[^']*')|/(?!>)|[^<>/])*+/>|<(?P<tag>script|style|noscript|template|textarea|svg|iframe|title)\b"
                    r"(?:=\s*+(?:\"[^\"]*\"|'[^']*')|[^<>])*+>.*?(?:</(?P=tag)\s*>|\Z))"
                    r"|<[a-zA-Z/](?:=\s*+(?:\"[^\"]*\"|'[^']*')|[^<>])*+>", re.S | re.I)


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass"))


def _prefixes(path: str) -> list[str]:
    parts = path.split("/")
    return ["/".join(parts[:i]) for i in range(1, len(parts) + 1)]


def _observe(batches):
    """Per host and token of a batch: pages, sums of the occurrence hashes, pages
    with one occurrence, own text less link text, kind ('p' path, 't' text)."""
    for pdf in batches:
        sums: dict = {}
        for pid, host, page in zip(pdf["page"], pdf["host"], pdf["html"].fillna("")):
            count: dict = {("p", ""): 1}
            chars: dict = {}
            previous = ""
            for path, text, linked, bad in blocks(_without_raw(page)):
                for p in _prefixes(path):
                    if not (previous + "/").startswith(p + "/"):
                        count["p", p] = count.get(("p", p), 0) + 1
                previous = path
                if path:
                    chars["p", path] = chars.get(("p", path), 0) + (0 if bad else max(0, len(text) - linked))
                key = ("t", f"{path}\n{_hash(text):x}")
                count[key] = count.get(key, 0) + 1
            for key, n in count.items():
                s = sums.setdefault((host, *key), [0, 0, 0, 0, 0])
                at = _hash(f"{pid}:{n}")
                s[0] += 1
                s[1] += at & 0xFFFFFFFF
                s[2] += at >> 32
                s[3] += n == 1
                s[4] += chars.get(key, 0)
        rows = [(*k, *v) for k, v in sums.items()]
        yield pd.DataFrame(rows, columns=["host", "kind", "token", "pages", "v1", "v2", "once", "chars"])


def _around(path: str):
    """Column of the paths of the elements around (and of) a path, the page itself ('') first."""
    return F.expr(f"concat(array(''), transform(sequence(1, size(split({path}, '/'))), i -> array_join(slice(split({path}, '/'), 1, i), '/')))")


def templates(pages: DataFrame, min_pages: int = 3) -> DataFrame:
    """host, main (path of the main slot, null on a host without ``article`` or
    ``main``), slots (paths of its slots with text of their own), links (paths
    of those without), texts (hashes of template texts with their path): one
    row per host with a template. ``pages``: page, host, html."""
    seen = pages.mapInPandas(_observe, "host string, kind string, token string, pages long, v1 long, v2 long, once long, chars long")
    tok = written(seen.groupBy("host", "kind", "token").agg(
        F.sum("pages").alias("pages"), F.sum("v1").alias("v1"), F.sum("v2").alias("v2"),
        F.sum("once").alias("once"), F.sum("chars").alias("chars")).where(F.col("pages") >= min_pages), "tokens")
    vector = ["pages", "v1", "v2"]
    element = tok.where("kind = 'p'").withColumnRenamed("token", "at")
    # texts of valid classes: an element around the text has the text's vector
    inside = tok.where("kind = 't'").select("host", "token", *vector, F.explode(_around("substring_index(token, '\n', 1)")).alias("at"))
    texts = (join_keys(inside, element, ["host", "at", *vector], []).groupBy("host").agg(F.collect_set("token").alias("texts")))
    # an element that is not once on its pages is of the slot that is next around it
    top = element.where("once = pages AND at != ''").select("host", "at", "chars")
    inner = element.where("once < pages AND chars > 0").select("host", "chars", F.col("at").alias("token"), F.explode(_around("at")).alias("at"))
    more = (join_keys(inner, top, ["host", "at"], []).groupBy("host", "token")
            .agg(F.max(F.struct(F.length("at").alias("l"), F.col("at").alias("at"))).alias("o"), F.first("chars").alias("chars"))
            .groupBy("host", F.col("o.at").alias("at")).agg(F.sum("chars").alias("more")))
    top = join_keys(top, more, ["host", "at"], ["more"], "left").fillna(0, ["more"]).withColumn("own", F.col("chars") + F.col("more"))
    named = F.expr("own > 0 AND regexp_extract(at, '([^/]+)$', 1) RLIKE '^(article|main)([.]|$)'")
    slots = top.groupBy("host").agg(F.max(F.when(named, F.struct("own", "at"))).alias("m"),
                                    F.collect_set(F.expr("CASE WHEN own > 0 THEN at END")).alias("slots"),
                                    F.collect_set(F.expr("CASE WHEN own = 0 THEN at END")).alias("links"))
    slots = slots.select("host", F.col("m.at").alias("main"), "slots", "links")
    return join_keys(slots, texts, ["host"], ["texts"], "left")


def main_text(page: str, main: str | None, slots, links, texts) -> str:
    """The page's main text, given its host's template."""
    found = blocks(_without_raw(page))
    if main is not None and any((p + "/").startswith(main + "/") for p, _, _, _ in found):
        kept = [t for p, t, _, bad in found if (p + "/").startswith(main + "/") and not bad]
        if kept:
            return " ".join(kept)
    named = [t for p, t, _, bad in found if not bad and any(x.split(".")[0] in HEADER_IN for x in p.split("/"))]
    if named:
        return " ".join(named)
    known = set(texts) if texts is not None else set()
    full = set(slots) if slots is not None else set()
    bare = set(links) if links is not None else set()

    def slot(path: str) -> str:
        return next((x for x in reversed(_prefixes(path)) if x in full or x in bare), "")

    # every content slot in page order; a slot of template texts only, or of links only, is none
    own = [(slot(p), p, t, f"{p}\n{_hash(t):x}" in known) for p, t, _, bad in found if not bad]
    varied = {s for s, _, _, template in own if not template and not ROOT.match(s)}
    return " ".join(t for s, p, t, template in own
                    if (s not in bare or ROOT.match(s) or HEADING.match(p.rsplit("/", 1)[-1])) and (not template or s in varied))


HEADING = re.compile(r"h[1-6](?:\.|$)")
#: Paths that hold the whole page: no slot of their own.
ROOT = re.compile(r"(?:html(?:\.[^/]*)?)?(?:/?body(?:\.[^/]*)?)?\Z")


def _extract(batches):
    for pdf in batches:
        text = [main_text(h, *x) for h, *x in zip(pdf["html"].fillna(""), pdf["main"], pdf["slots"], pdf["links"], pdf["texts"])]
        yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text, "n_chars": [len(t) for t in text]})


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    p = pages.select(F.col(page_id).cast("string").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"),
                     F.regexp_extract(F.lower(F.coalesce(F.col(url), F.lit(""))), "^[a-z]+://([^/?#:]+)", 1).alias("host"))
    known = written(templates(p.select(F.concat_ws(" ", "page_id", "url").alias("page"), "host", "html")), "templates")
    known = known.withColumn("main", F.when(F.col("main") != "", F.col("main")))
    d = join_keys(p, known, ["host"], ["main", "slots", "links", "texts"], "left")
    out = d.select("page_id", "url", "html", "main", "slots", "links", "texts").mapInPandas(_extract, "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast(pages.schema[page_id].dataType))
