"""Licence windows: notices inside lines, licences over several blocks, versions
and families, and every window against brute force."""
import random
import re

from ledgerscope.llm import license as lic

TEXT = {t[0]: t[1] for t in lic.TEMPLATES}
PROSE = "We wrote this for our own use and hope that it helps others. "


def found(spark, texts, **more):
    d = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, license string, w int")
    out = {}
    for r in lic.license_matches(d, **more).collect():
        out.setdefault(r.doc_id, []).append((r.license, r.first_word, r.last_word, r.dice))
    return out


def test_notices_anywhere(spark):
    mit = TEXT["MIT-text"]
    blocks = "\n\n".join([PROSE, mit[:300], mit[300:700], mit[700:], PROSE])
    cases = [(blocks, "MIT-text"), (PROSE + "Released under the MIT License. Enjoy " + PROSE, "MIT"), (PROSE + "Licensed under the MIT License.", "MIT"),
             ("Distributed\nunder the\n\nMIT License " + PROSE, "MIT"), ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0-short"),
             (PROSE + TEXT["BSD-3-Clause-text"].replace("Redistributions", "* Redistributions") + PROSE, "BSD-3-Clause-text"),
             ("\n# ".join(re.findall(r"(?:\S+\s*){1,9}", TEXT["GPL-3.0-header"])), "GPL-3.0-header"), (" ".join([PROSE] * 4000) + TEXT["Apache-2.0"] + " " + PROSE, "Apache-2.0")]
    got = found(spark, [c[0] for c in cases])
    for i, (_, want) in enumerate(cases):
        assert max(got[i], key=lambda x: x[3])[0] == want, (i, got.get(i))


def test_versions_and_families_are_kept_apart(spark):
    texts = ["This work is licensed under the GNU General Public License, version 2.", "This work is licensed under the GNU Lesser General Public License, version 3.",
             "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-NC-SA 4.0.",
             "Licensed under the Apache License, Version 1.1.", "Released under the BSD License.", "all rights were reserved", None, "", "license"]
    got = found(spark, texts)
    assert [sorted({x[0] for x in got.get(i, [])}) for i in range(10)] == [
        ["GPL-2.0"], ["LGPL-3.0"], ["CC-BY-SA-4.0"], ["CC-BY-NC-SA-4.0-short"], [], ["BSD-notice"], [], [], [], []]


def test_each_copy_is_a_match(spark):
    got = found(spark, ["Released under the MIT License. " * 50, PROSE.join(["Released under the MIT License. "] * 3)])
    assert [len(got[0]), len(got[1])] == [50, 3] and {x[3] for x in got[0]} == {1.0}


def brute(words, template, must, threshold):
    """The best window from every word, over all windows; less those with a better one that overlaps."""
    def grams(ws):
        return list(zip(ws, ws[1:]))
    g, t = grams(words), grams(template)
    known, m, longest = set(t), len(set(t)), int((2 - threshold) / threshold * len(t) + 1e-6)
    wins = []
    for i in range(len(g)):
        best = None
        for j in range(i, min(len(g), i + longest)):
            window = g[i:j + 1]
            c = len(known & set(window))
            dice = 2.0 * c / (c + sum(x not in known for x in window) + m)
            if dice >= threshold and must <= set(window) and (best is None or dice > best[2]):
                best = (i, j, dice)
        if best and g[best[0]] in known and g[best[1]] in known:
            wins.append(best)
    return {(x[0], x[1] + 1, x[2]) for x in wins
            if not any(v[0] <= x[1] and x[0] <= v[1] and (v[2] > x[2] or (v[2] == x[2] and v[0] < x[0])) for v in wins)}


def test_against_all_windows(spark):
    rng = random.Random(4)
    templates = [("a", "a b c d e"), ("b", "a b a b c 2 d", "b c"), ("c", "x y"), ("d", "e d c b a e c a d b", "e d")]
    texts = []
    for _ in range(150):
        ws = []
        while len(ws) < rng.randrange(1, 60):
            t = rng.choice(templates)[1].split()
            if rng.random() < 0.5:
                t[rng.randrange(len(t))] = rng.choice("abcdexy23")
            ws += t if rng.random() < 0.6 else [rng.choice("abcdexyz2")]
        texts.append(" ".join(ws))
    got = found(spark, texts, templates=templates)
    for i, text in enumerate(texts):
        for t in templates:
            words = t[1].split()
            fam = (t[2] if len(t) > 2 else "").split()
            must = set(zip(fam, fam[1:])) | {p for p in zip(words, words[1:]) if any(re.search("[0-9]", w) for w in p)}
            assert {x[1:] for x in got.get(i, []) if x[0] == t[0]} == brute(text.split(), words, must, 0.8), (text, t)
