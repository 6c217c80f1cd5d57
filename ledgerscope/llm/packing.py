"""Best-fit packing (3): documents into sequences by a linear grouping scheme.

Lengths are whole tokens up to the capacity, so the packing problem of any
corpus is a histogram of at most ``capacity`` numbers. Only that histogram
comes to the driver; its plan is a table of runs ("the next n pieces of length
l go to sequences s, s+1, ... at offset o, m in each"), whose size depends on
the number of lengths, not on the corpus. Pieces then find their run by their
rank within their length, which is a distributed running count.

The plan (linear grouping):
1. lengths above ``capacity / 8`` are large; in decreasing order they are cut
   into ``groups`` groups of equal cardinality and rounded up to the largest
   length of their group, which leaves a problem of few sizes;
2. configurations of those sizes (how many of each fill one sequence) are
   optimised by column generation: a small linear program over the
   configurations, priced by an exact knapsack; its whole part is used;
3. every slot of a configuration takes an actual length of its group, longest
   first, so the rounding turns back into free space;
4. what the whole part leaves over, then all small lengths, in decreasing
   order, go to the sequence with the least free space that still holds them.

Defined results: null text is empty; an empty document is its end id alone;
ties of length go by doc_id and piece; rows that repeat a doc_id are packed as
separate pieces; an empty table gives an empty result; output columns replace
input columns of the same name.
"""
from __future__ import annotations

import bisect
import os
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running_before, written

CAPACITY = 4096
END_ID = 1
BLOCK_CHARS = 8_000_000      # text per block in a task
CACHED_WORDS = 1_000_000      # words whose ids a Python worker remembers

_TOKENIZERS: dict = {}


def _tokenizer(name: str):
    """(tokenizer, known words, which ids end a word) of this worker."""
    if name not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark runs the tasks in parallel
        from tokenizers import Tokenizer
        path = name
        if not os.path.isabs(name):
            import public_tokenizers
            path = public_tokenizers.path(name)
        tok = Tokenizer.from_file(path)
        ends = np.zeros(tok.get_vocab_size() + 1, bool)
        ends[[i for t, i in tok.get_vocab().items() if t.endswith("</w>")]] = True
        _TOKENIZERS[name] = (tok, {}, ends)
    return _TOKENIZERS[name]


def _learn(words: list[str], tok, known: dict, ends: np.ndarray) -> None:
    """Ids of new words. Words of letters only are one run to the tokenizer, so
    many are encoded as one text and told apart by the ids that end a word;
    should their number not agree, and for all other words, one by one."""
    plain, others = [], []
    for w in words:
        (plain if w.isalpha() else others).append(w)
    for lo in range(0, len(plain), 4096):
        part = plain[lo:lo + 4096]
        ids = np.array(tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=np.uint32)
        cut = np.flatnonzero(ends[ids]) + 1
        if len(cut) == len(part) and cut[-1] == len(ids):
            raw, at = ids.tobytes(), 0
            for w, c in zip(part, cut.tolist()):
                known[w] = raw[4 * at:4 * c]
                at = c
        else:
            others += part
    for w, e in zip(others, tok.encode_batch_fast(others, add_special_tokens=False)):
        known[w] = np.array(e.ids, dtype=np.uint32).tobytes()


def token_ids(texts: list[str], name: str) -> list[np.ndarray]:
    """Ids of each text, as the tokenizer gives for the whole text. Its tokens
    never cross a space or line break (both are white space to it and dropped),
    nor from a letter to a full stop or comma, so each distinct word of the
    block is encoded once; ASCII words are looked up in lower case, as the
    tokenizer lowers them anyway."""
    tok, known, ends = _tokenizer(name)
    parts = [t.replace("\n", " ").split(" ") for t in texts]
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    codes, uniq = pd.factorize(np.array([w for p in parts for w in p], dtype=object))
    heads, tails = [], []
    for w in uniq.tolist():
        tail = w[-1:]
        if tail in (".", ",") and w[:-1].isalpha():
            w = w[:-1]
        else:
            tail = ""
        heads.append(w.lower() if w.isascii() and w.isalpha() else w)
        tails.append(tail)
    if len(known) > CACHED_WORDS:
        known.clear()
    _learn(list({k for k in heads if k not in known} | {k for k in ("", ".", ",") if k not in known}), tok, known, ends)
    ids = [known[a] + known[b] for a, b in zip(heads, tails)]
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    flat = np.frombuffer(b"".join(ids), np.uint32)
    first = np.cumsum(size) - size
    each = size[codes]
    ends_at = np.cumsum(each)
    out = flat[np.repeat(first[codes] - (ends_at - each), each) + np.arange(ends_at[-1] if len(ends_at) else 0)]
    cut = np.concatenate(([0], ends_at))[np.concatenate(([0], np.cumsum(n)))]
    return [out[a:b] for a, b in zip(cut[:-1], cut[1:])]


def _pieces(name: str, capacity: int):
    def run(batches):
        for pdf in batches:
            texts = pdf["text"].fillna("").tolist()
            doc_ids = pdf["doc_id"].tolist()
            lo, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size < BLOCK_CHARS and i + 1 < len(texts):
                    continue
                rows = []
                for d, ids in zip(doc_ids[lo:i + 1], token_ids(texts[lo:i + 1], name)):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    rows += [(d, k, s, len(ids[s:s + capacity]), ids[s:s + capacity].tobytes())
                             for k, s in enumerate(range(0, len(ids), capacity))]
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids"])
                lo, size = i + 1, 0
    return run


def token_pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY,
                 text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row per piece: doc_id, piece, start, length and ids (binary, unsigned
    little-endian 32-bit). Only documents longer than the capacity are cut."""
    # ids pass Python as strings: pandas would turn longs with nulls into doubles
    d = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    rows = d.mapInPandas(_pieces(tokenizer, capacity), "doc_id string, piece int, start long, length long, ids binary")
    return rows.withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))


# ------------------------------------------------------------------ the plan, on a histogram

def _best_configuration(sizes: list[int], value: np.ndarray, limit: np.ndarray, capacity: int) -> np.ndarray:
    """The knapsack with the largest total value: copies of each size in one sequence."""
    best = np.zeros(capacity + 1)
    took = np.zeros((len(sizes), capacity + 1), np.int64)
    for i, (s, v) in enumerate(zip(sizes, value)):
        if v <= 1e-12:
            continue
        new = best.copy()
        for k in range(1, min(capacity // s, int(limit[i])) + 1):
            alt = np.full(capacity + 1, -np.inf)
            alt[k * s:] = best[:capacity + 1 - k * s] + k * v
            better = alt > new + 1e-12
            new[better], took[i][better] = alt[better], k
        best = new
    out, room = np.zeros(len(sizes), np.int64), capacity
    for i in range(len(sizes) - 1, -1, -1):
        out[i] = took[i][room]
        room -= out[i] * sizes[i]
    return out


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Whole part of the best mix of configurations for few sizes: column
    generation with a basis of one configuration per size."""
    k = len(sizes)
    need = np.array(demand, float)
    basis = np.diag([float(min(capacity // s, max(1, d))) for s, d in zip(sizes, demand)])   # column = configuration
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(k))
        col = _best_configuration(sizes, price, need, capacity).astype(float)
        if price @ col <= 1 + 1e-9:
            break
        x, step = np.linalg.solve(basis, need), np.linalg.solve(basis, col)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, x / step, np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = col
    x = np.linalg.solve(basis, need)
    return [(basis[:, j].astype(int), int(x[j] + 1e-9)) for j in range(k) if x[j] >= 1 - 1e-9]


class _Plan:
    """Runs of equal sequences by free space, and the placements made so far."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences, self.rows = capacity, 0, []
        self.rank: dict[int, int] = {}
        self.free: dict[int, list] = {}
        self.levels: list[int] = []

    def put(self, length: int, first: int, n: int, each: int, used: int) -> None:
        """The next ``n`` pieces of a length, ``each`` to a sequence from ``first`` on, at offset ``used``."""
        r = self.rank.get(length, 0)
        self.rows.append((length, r, r + n, first, each, used))
        self.rank[length] = r + n

    def open(self, first: int, n: int, used: int) -> None:
        room = self.capacity - used
        if n and room:
            if room not in self.free:
                bisect.insort(self.levels, room)
                self.free[room] = []
            self.free[room].append((first, n))

    def new(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def best_fit(self, length: int, count: int) -> None:
        while count:
            i = bisect.bisect_left(self.levels, length)
            if i == len(self.levels):
                m = self.capacity // length
                n = -(-count // m)
                first, room = self.new(n), self.capacity
            else:
                room = self.levels[i]
                first, n = self.free[room].pop()
                if not self.free[room]:
                    del self.free[room], self.levels[i]
                m = room // length
            used = self.capacity - room
            whole = min(n, count // m)
            if whole:
                self.put(length, first, whole * m, m, used)
                self.open(first, whole, used + m * length)
                count -= whole * m
            if whole < n and count:                        # the last sequence takes fewer
                some = min(count, m)
                self.put(length, first + whole, some, some, used)
                self.open(first + whole, 1, used + some * length)
                count -= some
                whole += 1
            self.open(first + whole, n - whole, used)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 16) -> tuple[list[tuple], int]:
    """Runs (length, rank_from, rank_to, sequence, per_sequence, offset) that
    place all pieces of the histogram, and the number of sequences."""
    p = _Plan(capacity)
    full = histogram.get(capacity, 0)
    if full:
        p.put(capacity, p.new(full), full, 1, 0)
    cut = capacity // 8
    large = [(length, n) for length, n in sorted(histogram.items(), reverse=True) if cut < length < capacity and n]
    small = [(length, n) for length, n in sorted(histogram.items(), reverse=True) if length <= cut and n]
    total = sum(n for _, n in large)
    queues: list[deque] = []
    if total:
        each = -(-total // groups)
        left = 0
        for length, n in large:
            while n:
                if not left:
                    queues.append(deque())
                    left = each
                take = min(n, left)
                queues[-1].append([length, take])
                n, left = n - take, left - take
        sizes = [q[0][0] for q in queues]
        demand = [sum(n for _, n in q) for q in queues]
        # equal rounded sizes are one size
        for i in range(len(sizes) - 1, 0, -1):
            if sizes[i] == sizes[i - 1]:
                queues[i - 1].extend(queues.pop(i))
                demand[i - 1] += demand.pop(i)
                sizes.pop(i)
        for conf, n in configurations(sizes, demand, capacity):
            slots = [i for i, c in enumerate(conf) for _ in range(c)]
            n = min([n, *[sum(x[1] for x in queues[i]) // c for i, c in enumerate(conf) if c]])
            runs = [(p.new(n), n, 0)] if n else []
            for i in slots:
                nxt = []
                for first, k, used in runs:
                    while k:
                        length, have = queues[i][0]
                        take = min(k, have)
                        p.put(length, first, take, 1, used)
                        nxt.append((first, take, used + length))
                        first, k = first + take, k - take
                        queues[i][0][1] -= take
                        if not queues[i][0][1]:
                            queues[i].popleft()
                runs = nxt
            for first, k, used in runs:
                p.open(first, k, used)
    rest: dict[int, int] = {}
    for q in queues:
        for length, n in q:
            rest[length] = rest.get(length, 0) + n
    for length, n in sorted(rest.items(), reverse=True):
        p.best_fit(length, n)
    for length, n in small:
        p.best_fit(length, n)
    return p.rows, p.sequences


def pack(pieces: DataFrame, order: list[str], length: str = "length", capacity: int = CAPACITY, groups: int = 16) -> DataFrame:
    """Add sequence_id and offset to narrow rows with a ``length`` of 1 to
    ``capacity``; ``order`` settles which of equally long rows comes first."""
    spark = pieces.sparkSession
    pieces = written(pieces.drop("sequence_id", "offset"), "pieces")
    hist = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}       # at most ``capacity`` rows
    if any(not 1 <= x <= capacity for x in hist):
        raise ValueError("lengths must be between 1 and the capacity")
    rows, _ = plan(hist, capacity, groups)
    runs = spark.createDataFrame(rows or [(0,) * 6], "_length long, _from long, _to long, _first long, _each long, _used long")
    ranked = running_before(pieces.withColumn("_one", F.lit(1).cast("long")), order, "_one", "_rank", keys=[length])
    # the plan's size is bounded by the number of lengths, whatever the corpus
    j = ranked.join(F.broadcast(runs), F.expr(f"`{length}` = _length AND _rank >= _from AND _rank < _to"))
    return j.select(*[F.col(f"`{c}`") for c in pieces.columns],
                    F.expr("_first + (_rank - _from) div _each").alias("sequence_id"),
                    F.expr(f"_used + ((_rank - _from) % _each) * `{length}`").alias("offset"))


def sequences(pieces: DataFrame, packed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id and ids (binary), from ``token_pieces``
    and what ``pack`` says of them. A sequence is at most a capacity of ids."""
    j = pieces.join(packed.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"])
    return (j.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_p"))
            .select("sequence_id", F.expr("aggregate(transform(_p, x -> x.ids), cast('' as binary), (a, x) -> concat(a, x))").alias("ids")))


def packed_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY,
                     text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    pieces = token_pieces(docs, tokenizer, capacity, text, doc_id).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces, ["doc_id", "piece", "ids_crc32"], capacity=capacity)
