"""Benchmark decontamination (12): a distributed positional inverted index.

The corpus is cut into segments of whole documents (about ``SEGMENT_CHARS``
characters, one document at least). A segment is one row: for each term the
positions at which it stands, in increasing order, on one line of positions on
which the documents follow each other with a gap of one between them. Only the
postings of words that occur in the test items are stored: a bit set of fixed
size (``SLOTS`` bits, built from the items) leaves out all other words, and the
few that it wrongly lets through are postings which nobody asks for.

A window is ``window`` consecutive words of an item; an item of fewer words,
but not none, is one window. Its terms are ordered by their corpus-wide
frequency, which the segments give. In each segment the list of the rarest term
is moved by the term's offset and gives the candidate starts; the lists of the
other terms, moved by theirs, are intersected with it in order of frequency. A
window with a word that the corpus lacks is dropped before. What is left are
exact phrase matches. Proximity matches start from the rarest term as well: all
different words of the window within ``near`` consecutive words, in any order.

Windows are the stated queries: they are sent to the segments in blocks of at
most ``BLOCK_WINDOWS`` (about 10 MB), so their number is not bounded. No postings
list leaves its segment, so a very frequent word is cut as the corpus is.

Words are compared by a 64-bit hash (xxHash64) each.

Defined results: null texts have no words and no hits; repeated rows, also of
one doc_id, are documents of their own; a null doc_id stays null; items that
share an item_id count once, a null item_id is the empty string; an empty table
on either side gives no matches, and every document is still returned; other
columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WINDOW = 10
SEGMENT_CHARS = 1_000_000
TEXT_STEP = 4_000_000          # bytes of a very long text that are split at once
SLOTS = 1 << 24                # bits of the set of test words: 2 MB
KNOWN_WORDS = 1_000_000        # words whose hash a worker remembers
BLOCK_WINDOWS = 50_000
CANDIDATES = 1_000_000         # candidate starts intersected at once

#: Byte table: A-Z to lower case; digits, letters and all of 0x80 and above stay; the rest parts words.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_SEGMENT = "seg long, doc_ids array<long>, n_words array<long>, terms array<long>, counts array<long>, postings binary"


class _Terms(dict):
    """Word to hash (0: a word that no item has), remembered up to a bound."""

    def __init__(self, bits=None):
        import xxhash
        self._hash, self._bits = xxhash.xxh64_intdigest, bits

    def __missing__(self, word):
        h = self._hash(word) or 1
        if self._bits is not None and not self._bits[h >> 43] >> (h >> 40 & 7) & 1:
            h = 0
        if len(self) < KNOWN_WORDS:
            self[word] = h
        return h


def _term_ids(text: bytes | None, terms: _Terms) -> np.ndarray:
    """The hash of each word, in order, as signed 64-bit numbers."""
    if not text:
        return np.zeros(0, np.int64)
    clean, parts, lo = text.translate(_WORD_BYTES), [], 0
    while lo < len(clean):
        hi = len(clean) if lo + TEXT_STEP >= len(clean) else clean.rfind(b" ", lo, lo + TEXT_STEP) + 1
        if hi <= lo:                                    # one word of over TEXT_STEP bytes
            hi = clean.find(b" ", lo) + 1 or len(clean)
        words = clean[lo:hi].split()
        parts.append(np.fromiter(map(terms.__getitem__, words), np.uint64, len(words)))
        lo = hi
    return np.concatenate(parts).view(np.int64)


def _bytes(column) -> list:
    return column.cast(pa.binary()).to_pylist()


def item_windows(items: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """Written table of the items' windows: w (number), item_id (string), terms."""
    def run(batches):
        terms = _Terms()
        for batch in batches:
            for item, t in zip(batch.column(0).to_pylist(), _bytes(batch.column(1))):
                ids = _term_ids(t, terms)
                if not len(ids):
                    continue
                n = min(window, len(ids))
                views = np.lib.stride_tricks.sliding_window_view(ids, n)
                for lo in range(0, len(views), 10_000):
                    part = views[lo:lo + 10_000]
                    lists = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * n, pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(part), pa.string()), lists], ["item_id", "terms"])

    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"), F.col(text).alias("text"))
    out = rows.mapInArrow(run, "item_id string, terms array<long>")
    return written(out.withColumn("w", F.monotonically_increasing_id()), "windows")


def _term_bits(windows: DataFrame) -> np.ndarray:
    """The fixed-size bit set over the top 24 bits of the test words' hashes."""
    slot = F.expr("shiftrightunsigned(t, 40) + 1").alias("slot")
    maps = (windows.select(F.explode("terms").alias("t")).select(slot)
            .groupBy(F.expr("bitmap_bucket_number(slot)").alias("b"))
            .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("m")))
    bits = np.zeros(SLOTS // 8, np.uint8)
    for r in maps.collect():                            # at most SLOTS / 32768 rows of 4 KB
        part = np.frombuffer(bytes(r["m"]), np.uint8)
        bits[(r["b"] - 1) * len(part):r["b"] * len(part)] = part
    return bits


def build_index(docs: DataFrame, windows: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Written table of segments, one row each, with the postings of test words."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(_term_bits(windows).tobytes())

    def segment(number, ids, docs_terms):
        import zstandard
        n = np.array([len(t) for t in docs_terms], np.int64)
        starts = np.cumsum(n + 1) - (n + 1)
        line = np.concatenate(docs_terms)
        where = np.arange(len(line)) + np.repeat(np.arange(len(n)), n)      # a gap of one after each document
        known = np.flatnonzero(line)
        order = known[np.argsort(line[known], kind="stable")]
        terms, first, counts = np.unique(line[order], return_index=True, return_counts=True)
        steps = np.diff(where[order], prepend=0)
        steps[first] = where[order][first]              # each list starts from zero
        blob = zstandard.ZstdCompressor(level=1).compress(steps.astype("<u4").tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([n.tolist()], pa.list_(pa.int64())),
             pa.array([terms], pa.list_(pa.int64())), pa.array([counts.astype(np.int64)], pa.list_(pa.int64())),
             pa.array([blob], pa.binary())], ["seg", "doc_ids", "n_words", "terms", "counts", "postings"])

    def run(batches):
        terms, number = _Terms(bits.value), TaskContext.get().partitionId() << 32
        ids, held, size = [], [], 0
        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), _bytes(batch.column(1))):
                ids.append(d)
                held.append(_term_ids(t, terms))
                size += len(t or b"")
                if size >= SEGMENT_CHARS or len(ids) >= 20_000:
                    yield segment(number, ids, held)
                    ids, held, size, number = [], [], 0, number + 1
        if ids:
            yield segment(number, ids, held)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return written(rows.mapInArrow(run, _SEGMENT), "segments")


class _Segment:
    """A segment's lists as one sorted array of (term number, position) keys."""

    def __init__(self, row):
        import zstandard
        self.terms = np.asarray(row["terms"], np.int64)
        counts = np.asarray(row["counts"], np.int64)
        steps = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["postings"], max_output_size=4 * int(counts.sum()) + 1), "<u4")
        self.first = np.cumsum(counts) - counts
        self.counts = counts
        number = np.repeat(np.arange(len(counts)), counts)
        total = np.cumsum(steps, dtype=np.int64)
        before = np.concatenate(([0], total))[self.first]
        self.positions = total - before[number]
        n = np.asarray(row["n_words"], np.int64)
        self.ends = np.cumsum(n + 1)                    # of each document, its gap included
        self.starts = self.ends - (n + 1)
        self.span = int(self.ends[-1]) + 1 if len(n) else 1
        self.keys = number * self.span + self.positions

    def number(self, terms):
        """Number of each term in this segment, -1 where it has none."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def has(self, number, position):
        """Whether each term (by number) stands at each position."""
        key = number * self.span + position
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (number >= 0) & (position >= 0) & (position < self.span) & (self.keys[at] == key)

    def next(self, number, position):
        """First place at or after each position of each term; the line's end if none."""
        at = np.searchsorted(self.keys, number * self.span + np.maximum(position, 0))
        found = np.minimum(at, len(self.keys) - 1)
        good = (at < len(self.keys)) & (self.keys[found] // self.span == number) & (number >= 0)
        return np.where(good, self.positions[found], 2 * self.span)


class _Block:
    """A block of windows, equal ones once: terms and offsets by rarity, items."""

    def __init__(self, table):
        lists = table.column("ranked").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        row = np.repeat(np.arange(len(sizes)), sizes)
        rank = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        width = int(sizes.max()) if len(sizes) else 1
        terms, offsets = np.zeros((len(sizes), width), np.int64), np.full((len(sizes), width), -1, np.int64)
        terms[row, rank] = flat.field("term").to_numpy()
        offsets[row, rank] = flat.field("off").to_numpy()
        both, which = np.unique(np.hstack([terms, offsets]), axis=0, return_inverse=True)
        self.terms, self.offsets = both[:, :width], both[:, width:]
        self.size = (self.offsets >= 0).sum(axis=1)
        names, item = np.unique(np.array(table.column("item_id").to_pylist(), dtype=object).astype(str), return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), item.ravel()], axis=1), axis=0)
        self.names, self.items = names, pairs[:, 1]
        self.n_items = np.bincount(pairs[:, 0], minlength=len(both))
        self.first_item = np.cumsum(self.n_items) - self.n_items


def _spread(first, counts):
    """Concatenated ranges first[i] .. first[i] + counts[i]."""
    return np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _candidates(seg: _Segment, block: _Block):
    """(windows, places of their rarest term), in slices of bounded size."""
    rarest = seg.number(block.terms[:, 0])
    here = np.flatnonzero(rarest >= 0)
    n = seg.counts[rarest[here]]
    part = np.cumsum(n) // CANDIDATES
    for p in np.unique(part):
        sel = here[part == p]
        count = seg.counts[rarest[sel]]
        yield np.repeat(sel, count), seg.positions[_spread(seg.first[rarest[sel]], count)]


def _exact(seg, block, w, place):
    start = place - block.offsets[w, 0]
    for k in range(1, block.terms.shape[1]):
        due = k < block.size[w]
        good = ~due
        good[due] = seg.has(seg.number(block.terms[w[due], k]), start[due] + block.offsets[w[due], k])
        w, start = w[good], start[good]
    inside = start >= 0
    return w[inside], start[inside]


def _near(seg, block, w, place, near):
    """Windows whose different words stand within ``near`` words around a place
    of the rarest one: (window, first, end) of the shortest such span."""
    doc = np.searchsorted(seg.ends, place, side="right")
    low, high = np.maximum(place - near + 1, seg.starts[doc]), np.minimum(place + near, seg.ends[doc] - 1)
    for k in range(1, block.terms.shape[1]):
        due = k < block.size[w]
        good = ~due
        good[due] = seg.next(seg.number(block.terms[w[due], k]), low[due]) < high[due]
        w, place, low, high = w[good], place[good], low[good], high[good]
    out = []
    for i, p, lo, hi in zip(w.tolist(), place.tolist(), low.tolist(), high.tolist()):
        numbers = np.unique(seg.number(block.terms[i, :block.size[i]])).tolist()
        marks = sorted((int(x), t) for t in numbers
                       for x in seg.positions[slice(*np.searchsorted(seg.keys, [t * seg.span + lo, t * seg.span + hi]))])
        last, best = {}, None
        for x, t in marks:
            last[t] = x
            if x >= p and len(last) == len(numbers) and min(last.values()) <= p:
                first = min(last.values())
                if best is None or x + 1 - first < best[1] - best[0]:
                    best = first, x + 1
        if best and best[1] - best[0] <= near:
            out.append((i, *best))
    return [np.array(c, np.int64) for c in (zip(*out) if out else ([], [], []))]


def _merged(seg, block, w, start, end):
    """Runs per (document, item): document number, item, first and end word."""
    rows = np.repeat(np.arange(len(w)), block.n_items[w])
    item = block.items[_spread(block.first_item[w], block.n_items[w])]
    start, end = start[rows], end[rows]
    doc = np.searchsorted(seg.ends, start, side="right")
    order = np.lexsort((end, start, item, doc))
    doc, item, start, end = doc[order], item[order], start[order], end[order]
    if not len(doc):
        return doc, item, start, end
    group = np.concatenate(([0], np.cumsum((np.diff(doc) != 0) | (np.diff(item) != 0))))
    reach = np.maximum.accumulate(end + group * seg.span) - group * seg.span    # furthest end within the group so far
    new = np.concatenate(([True], (np.diff(group) != 0) | (start[1:] > reach[:-1])))
    at = np.flatnonzero(new)
    last = np.concatenate((at[1:] - 1, [len(doc) - 1]))
    return doc[at], item[at], start[at] - seg.starts[doc[at]], reach[last] - seg.starts[doc[at]]


def matches(index: DataFrame, windows: DataFrame, near: int | None = None) -> DataFrame:
    """Runs of matched words: seg and ord (the document), item_id, kind ('phrase'
    or 'near'), first and end (word numbers, end exclusive). Overlapping and
    touching windows of an item are one run; runs of different blocks of windows
    may overlap."""
    spark = index.sparkSession
    freq = (index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t"))
            .groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.counts").alias("freq")))
    ranked = (windows.select("w", "item_id", F.size("terms").alias("n"), F.posexplode("terms").alias("off", "term"))
              .join(freq, "term").groupBy("w", "item_id", "n")
              .agg(F.sort_array(F.collect_list(F.struct("freq", "off", "term"))).alias("ranked"))
              .where("size(ranked) = n").select("w", "item_id", "ranked"))
    ranked = written(ranked, "ranked")
    n_blocks = -(-ranked.count() // BLOCK_WINDOWS)
    schema = "seg long, ord int, item_id string, kind string, first long, end long"
    out = spark.createDataFrame([], schema)
    for b in range(n_blocks):
        rows = ranked if n_blocks == 1 else ranked.where(F.expr(f"pmod(xxhash64(w), {n_blocks}) = {b}"))
        block = spark.sparkContext.broadcast(_Block(rows.select("item_id", "ranked").toArrow()))

        def run(batches, block=block):
            q = block.value
            for batch in batches:
                for row in batch.to_pylist():
                    seg = _Segment(row)
                    if not len(seg.keys):
                        continue
                    for w, place in _candidates(seg, q):
                        found = {"phrase": _exact(seg, q, w, place)}
                        found["phrase"] = (*found["phrase"], found["phrase"][1] + q.size[found["phrase"][0]])
                        if near:
                            pw, ps, _ = found["phrase"]
                            done = np.isin(w * seg.span + place, pw * seg.span + ps + q.offsets[pw, 0])
                            nw, first, end = _near(seg, q, w[~done], place[~done], near)
                            found["near"] = np.concatenate([pw, nw]), np.concatenate([ps, first]), np.concatenate([ps + q.size[pw], end])
                        for kind, hits in found.items():
                            doc, item, first, end = _merged(seg, q, *hits)
                            if len(doc):
                                yield pa.RecordBatch.from_arrays(
                                    [pa.array(np.full(len(doc), row["seg"])), pa.array(doc.astype(np.int32)), pa.array(q.names[item].astype(object), pa.string()),
                                     pa.array([kind] * len(doc)), pa.array(first), pa.array(end)],
                                    ["seg", "ord", "item_id", "kind", "first", "end"])

        out = out.unionByName(index.mapInArrow(run, schema))
    return out


def documents(index: DataFrame) -> DataFrame:
    """Every document of the index: seg, ord, doc_id, n_words."""
    return (index.select("seg", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("ord", "d"))
            .select("seg", "ord", F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").alias("n_words")))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, near: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside any occurrence
    of a window), items (sorted ids of the items with occurring windows) and
    near_items (of those with a proximity match; empty without ``near``)."""
    windows = item_windows(items, window)
    index = build_index(docs, windows)
    runs = written(matches(index, windows, near), "matches")
    before = Window.partitionBy("seg", "ord").orderBy("first", "end").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("*", F.when(F.col("kind") == "phrase", F.col("end")).alias("e"))
    runs = runs.withColumn("fresh", F.expr("e") - F.greatest("first", F.least("e", F.coalesce(F.max("e").over(before), F.lit(0)))))
    hits = runs.groupBy("seg", "ord").agg(
        F.sum("fresh").alias("n_hit"),
        F.sort_array(F.collect_set(F.when(F.col("kind") == "phrase", F.col("item_id")))).alias("items"),
        F.sort_array(F.collect_set(F.when(F.col("kind") == "near", F.col("item_id")))).alias("near_items"))
    none = F.expr("cast(array() as array<string>)")
    return (documents(index).join(hits, ["seg", "ord"], "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items")))
