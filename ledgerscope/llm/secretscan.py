"""Secret scans (5): base patterns plus a recursive decoding worklist.

Base spans are found in the text as it is. Then every line that holds an
encoded run is a first layer; a codec applied to all its runs in a layer gives
a new layer, until no codec gives a layer not seen before (layers already seen
are not taken up again, so cycles end). Every new layer is scanned with the
base patterns. A layer carries, for each of its characters, the code points of
the text it comes from, so that spans in any layer are spans of the text: an
escape maps to its own characters, base64 and compressed content to its run.
An escape character that is itself escaped, at any depth (``%252541``), is
taken off in one step, so such nests cost as much as their length; the layers
between hold no more than shorter beginnings of what the last one holds. Of the
layers seen only digests are kept.

Codecs: percent escapes (UTF-8), ``\\u``/``\\U``/``\\x`` escapes and numeric
character references, base64 of text, base64 of gzip, zlib or bzip2 (all
members, in any nesting). Content of over ``MAX_INFLATED`` characters (a guard
against bombs) is unpacked as a stream and scanned in pieces that end where no
pattern goes on; its first and last piece stand for it in the layer.
n_oversize counts the pieces that had no such end and were cut with an overlap.

Defined results: null text is empty; no spans give empty strings; repeated
rows get equal results; an empty table stays empty; other columns are ignored.
"""
from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import itertools
import re
import zlib
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"""
                    r"""[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")           # leftmost maximal runs: shorter ones never match
MAX_INFLATED = 16_000_000

#: An escape whose escape character is itself escaped, any number of times, is one escape.
URL = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})+")
URL_ITEM = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
CODE = re.compile(r"\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}"
                  r"|\\(?:u005[cC]|x5[cC]|U0000005[cC])*(?:u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|x[0-9A-Fa-f]{2})"
                  r"|&(?:#0{0,5}38;|#[xX]0{0,4}26;)*(?:#[0-9]{1,7};|#[xX][0-9A-Fa-f]{1,6};)")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 over line breaks; no dashes in a row, as around PEM blocks.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_])(?:[A-Za-z0-9+/_]|-(?!-)){16,}+(?:\r?\n[ \t]*(?:[A-Za-z0-9+/_]|-(?!-))++(?![^\s=]))+={0,2}")
CODECS = {"url": URL, "code": CODE, "base64": BASE64, "wrapped": WRAPPED}
#: Ends of pieces that no pattern crosses.
SAFE = re.compile(r"[^\w+/=.%\\&#;:\"'\s-]|[ .:;\"'][A-Za-z0-9+/_=-]{0,15}\r?\n(?=.)")
PIECE, OVERLAP, HEAD = 1_000_000, 65_536, 512
ENCODED = re.compile(r"%[0-9A-Fa-f]{2}|\\[uUx][0-9A-Fa-f]{2}|&#[xX0-9]|[A-Za-z0-9+/_-]{16}")


def scan(s: str) -> list[tuple[int, int, int]]:
    """Base spans (start, kind number, end) of a string."""
    out = []
    if ":" in s or "=" in s:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(s) if len(m.group(1)) >= 8]
    if "AKIA" in s:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(s) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(s)]
    return sorted(out)


def _inflated(parts):
    """Byte pieces out of compressed ones: member after member, then what follows the last."""
    make = d = None
    for p in parts:
        while p or (d is not None and make is bz2.BZ2Decompressor and not d.needs_input):
            if d is None:
                make = _packing(p)
                if make is None:
                    yield p
                    break
                d = make()
            try:
                out = d.decompress(p, PIECE)
            except (zlib.error, OSError, EOFError):
                return
            if out:
                yield out
            if d.eof:
                p, d = d.unused_data.lstrip(b"\0"), None
            else:
                p = b"" if make is bz2.BZ2Decompressor else d.unconsumed_tail
    if d is not None and make is not bz2.BZ2Decompressor:
        try:
            yield d.flush()
        except zlib.error:
            return


def _packing(b: bytes):
    """The decompressor that takes these bytes, if there is one."""
    for magic, make in ((b"\x1f\x8b", _gzip), (b"BZh", bz2.BZ2Decompressor), (b"\x78", zlib.decompressobj)):
        if b.startswith(magic):
            try:
                make().decompress(b, 1)
                return make
            except (zlib.error, OSError, EOFError):
                continue
    return None


def _gzip():
    return zlib.decompressobj(31)


def _peeled(b: bytes):
    """(byte pieces, whether they were compressed) with all compressed layers taken off."""
    parts, head, heads = iter([b]), b[:HEAD], set()
    while _packing(head) is not None and head not in heads:        # a layer may hold itself
        heads.add(head)
        parts, head = _inflated(parts), b""
        for p in parts:
            head += p
            if len(head) >= HEAD:
                break
        parts, head = itertools.chain([head], parts), head[:HEAD]
    return parts, bool(heads), head


def _charset(head: bytes) -> str:
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16"
    half = len(head) // 2
    if half > 3 and head[1::2].count(0) > 0.6 * half and head[::2].count(0) < 0.2 * half:
        return "utf-16-le"
    if half > 3 and head[::2].count(0) > 0.6 * half and head[1::2].count(0) < 0.2 * half:
        return "utf-16-be"
    return "utf-8"


def _texts(parts, head: bytes):
    dec = codecs.getincrementaldecoder(_charset(head))("replace")
    for p in parts:
        yield dec.decode(p)
    yield dec.decode(b"", True)


def _plain(s: str) -> bool:
    """Mostly printable, so text and not just any bytes."""
    return bool(s) and sum(c.isprintable() and c != "\ufffd" or c in "\t\r\n" for c in s) >= 0.9 * len(s)


def _unpacked(run: str, kinds: set, over: list) -> str | None:
    """Text inside a base64 run, through compression if there is any; of text
    over ``MAX_INFLATED`` the first and last piece, with the kinds found in it."""
    core = "".join(run.split()).rstrip("=").replace("-", "+").replace("_", "/")
    core = core[:-1] if len(core) % 4 == 1 else core
    try:
        b = base64.b64decode(core + "=" * (-len(core) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None
    try:
        s = b.decode("utf-8")
        if s and all(c.isprintable() or c in "\t\r\n" for c in s):
            return s
    except UnicodeDecodeError:
        pass
    parts, packed, head = _peeled(b)
    texts, got, n = _texts(parts, head), [], 0
    for s in texts:
        got.append(s)
        n += len(s)
        if n > MAX_INFLATED:
            return _in_pieces(itertools.chain(got, texts), kinds, over)
    s = "".join(got)
    # other bytes stay as they are, unless there is something to find in them
    return s if s and (packed or _plain(s) or scan(s) or ENCODED.search(s)) else None


def _in_pieces(texts, kinds: set, over: list) -> str:
    first, buf = None, ""

    def take(piece):
        _, spans, n = secrets(piece)
        kinds.update(k for _, k, _ in spans)
        over.extend([1] * n)

    for s in texts:
        buf += s
        while len(buf) > 2 * PIECE:
            cut = max((m.end() for m in SAFE.finditer(buf, PIECE, 2 * PIECE)), default=0)
            keep = cut
            if not cut:
                over.append(1)
                cut, keep = 2 * PIECE, 2 * PIECE - OVERLAP
            take(buf[:cut])
            first, buf = first or buf[:cut], buf[keep:]
    take(buf)
    return f"{first or ''}\n\n{buf}"


def _url(run: str) -> list[tuple[str, int, int]]:
    """Characters of a run with the part of the run that each comes from."""
    items = list(URL_ITEM.finditer(run))
    out, at = [], 0
    for c in bytes(int(m.group(1), 16) for m in items).decode("utf-8", "surrogateescape"):
        n = len(c.encode("utf-8", "surrogateescape"))
        out.append(("\ufffd" if "\ud800" <= c < "\ue000" else c, items[at].start(), items[at + n - 1].end()))
        at += n
    return out


def _code(run: str) -> str | None:
    if run[6:7] == "\\":                         # a surrogate pair
        return chr(0x10000 + ((int(run[2:6], 16) - 0xD800) << 10) + int(run[8:], 16) - 0xDC00)
    run = run[0] + run[run.rfind("#") if run[0] == "&" else max(run.rfind(c) for c in "uUx"):]
    n = int(run[2:], 16) if run[0] == "\\" else int(run[3:-1], 16) if run[2] in "xX" else int(run[2:-1])
    return chr(n) if 0 < n < 0x110000 and not 0xD800 <= n < 0xE000 else None


def _apply(codec: str, s: str, lo: np.ndarray, hi: np.ndarray, found: set, over: list):
    """The layer that results from decoding every run of one codec, or None."""
    text, los, his, last = [], [], [], 0
    for m in CODECS[codec].finditer(s):
        a, b = m.span()
        if codec == "url":
            chars = _url(m.group())
            new = "".join(c for c, _, _ in chars)
            nlo, nhi = lo[[a + x for _, x, _ in chars]], hi[[a + y - 1 for _, _, y in chars]]
        else:
            kinds: set = set()
            new = _code(m.group()) if codec == "code" else _unpacked(m.group(), kinds, over)
            if new is None:
                continue
            nlo, nhi = np.full(len(new), lo[a]), np.full(len(new), hi[b - 1])
            found |= {(int(lo[a]), k, int(hi[b - 1])) for k in kinds}
        text += [s[last:a], new]
        los += [lo[last:a], nlo]
        his += [hi[last:a], nhi]
        last = b
    if not text:
        return None
    return "".join([*text, s[last:]]), np.concatenate([*los, lo[last:]]), np.concatenate([*his, hi[last:]])


def _digest(s: str) -> bytes:
    return hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def decoded_spans(s: str, at: int) -> tuple[set, int]:
    """Spans in all layers below the lines ``s`` that starts at ``at``, and the pieces cut with an overlap."""
    idx = np.arange(at, at + len(s))
    work, seen, found, over = deque([(s, idx, idx + 1)]), {_digest(s)}, set(), []
    while work:
        cur, lo, hi = work.popleft()
        for codec in CODECS:
            layer = _apply(codec, cur, lo, hi, found, over)
            if layer is None or (digest := _digest(layer[0])) in seen:
                continue
            new, nlo, nhi = layer
            seen.add(digest)
            found |= {(int(nlo[a]), k, int(nhi[b - 1])) for a, k, b in scan(new)}
            work.append((new, nlo, nhi))
    return found, len(over)


def _lines(text: str):
    """Lines, those of a wrapped base64 run together."""
    at = 0
    for m in WRAPPED.finditer(text):
        start = text.rfind("\n", at, m.start()) + 1 or at
        end = text.find("\n", m.end())
        if start > at:
            yield from text[at:start - 1].split("\n")
        if end < 0:
            yield text[start:]
            return
        yield text[start:end]
        at = end + 1
    yield from text[at:].split("\n")


def secrets(text: str) -> tuple[list, list, int]:
    """(base spans, all spans, pieces cut with an overlap) of a text."""
    base = scan(text)
    found, over = set(base), 0
    if ENCODED.search(text):
        at = 0
        for line in _lines(text):
            if ENCODED.search(line):
                more, n = decoded_spans(line, at)
                found |= more
                over += n
            at += len(line) + 1
    return base, sorted(found), over


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _run(batches):
    for pdf in batches:
        rows = []
        for t in pdf["text"].fillna(""):
            base, spans, over = secrets(t)
            n = [sum(1 for s in base if s[1] == k) for k in range(3)]
            rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), over))
        out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_oversize"])
        out.insert(0, "doc_id", pdf["doc_id"].values)
        yield out


def secret_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex and base_sha256 of the base spans,
    spans (kind:start:end of all spans), n_oversize."""
    d = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    out = d.mapInPandas(_run, "doc_id string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_oversize long")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))
