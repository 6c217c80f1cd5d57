"""The decoding worklist against a brute force that decodes one escape at a
time, and long nests."""
import random
import re
import time
import urllib.parse

from ledgerscope.llm import secretscan as ss

ONE = re.compile(r"(?:%[0-9A-Fa-f]{2})+|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};")

BS = chr(92)


def once(run):
    if run[0] == "%":
        return urllib.parse.unquote(run, errors="replace")
    return chr(int(run[2:], 16) if run[0] == "\\" else int(run[2:-1]))


def fixpoint(s):
    while (new := ONE.sub(lambda m: once(m.group()), s)) != s:
        s = new
    return s


def escaped(rng, s, kind):
    """Each character of s, some of them as an escape of the kind."""
    def one(c):
        if rng.random() < 0.6 and c.isalnum():
            return c
        return {"url": urllib.parse.quote(c, safe="") if not c.isalnum() else f"%{ord(c):02X}", "u": f"\\u{ord(c):04x}",
                "x": f"\\x{ord(c):02x}", "ref": f"&#{ord(c)};"}[kind]
    return "".join(map(one, s))


def test_nests_against_single_steps():
    rng = random.Random(9)
    for _ in range(300):
        secret = rng.choice(["password=hunter2hunter2", "api_key: 'abcd1234EFGH'", "AKIA" + "Q7" * 8, "token=" + "z" * 9])
        s = secret
        for _ in range(rng.randrange(1, 5)):
            s = escaped(rng, s, rng.choice(["url", "u", "x", "ref"]))
        text = f"some words\nbefore {s} after\nmore words"
        assert secret in fixpoint(s)
        _, spans, _ = ss.secrets(text)
        want = {k for _, k, _ in ss.scan(secret)}
        assert want <= {k for _, k, _ in spans}, text
        lo, hi = text.index(s), text.index(s) + len(s)
        assert all(lo <= a < b <= hi for a, k, b in spans if k in want)
        # the value's last character is the last of the nest, where that is no closing quote
        if secret[-1] != "'":
            assert any(b == hi for _, k, b in spans if k in want), text


def test_chains_of_any_depth():
    assert [ss._apply("url", s, *(2 * [ss.np.arange(len(s))]), set(), [])[0] for s in ("%252541", "%2525", "%25zz", "%25C3%25A9", "%25253")] == ["A", "%", "%zz", "é", "%3"]
    assert [ss._code(s) for s in (r"\u005cu0041", r"\x5cx5cx41", r"\x5cx41", "&#38;#38;#65;", "&#x26;#x41;", "&#38;", BS + "ud83d" + BS + "ude00", r"\U00000041")] \
        == ["A", "A", "A", "A", "A", "&", "\U0001f600", "A"]


def test_a_long_nest_takes_its_length():
    deep = "%" + "25" * 500_000 + "70" + "assword=hunter2hunter2"
    start = time.monotonic()
    base, spans, over = ss.secrets("words\n" + deep + "\nwords")
    assert time.monotonic() - start < 20 and over == 0
    assert (6, 0, 6 + len(deep)) in spans
    deep = "\\" + "u005c" * 200_000 + "u0070assword=hunter2hunter2"
    assert (0, 0, len(deep)) in ss.secrets(deep)[1]
