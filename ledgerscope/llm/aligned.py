"""Cross-tokenizer alignment (11) by external spill counting.

Both tokenizers encode every text; the byte offsets at which a token of each
ends cut the text into groups, and the two tokens that end a group are linked.
How often an id pair is linked in the whole corpus is counted out of core:

1. Spill: a task encodes a block of documents, sorts its (pair, document)
   records side-major, that is by B id, then A id, then document, and deals
   them by the low bits of the B id to ``RADIX`` partitions. What goes to one
   partition is a run: zstd-compressed arrays of bounded size, written as one
   row. A record says how many links of the document hold the pair.
2. Count: of each run only its pairs and their totals are read. Up to ``FAN``
   runs of a partition are merged at a time by a k-way heap merge into a longer
   run, level after level until a partition has one. A very frequent pair is one
   entry of a run, so it weighs no more than others.
3. Maxima: a partition holds all pairs of its B ids, next to each other, so one
   pass over the last merge gives each pair's count and whether it is the
   highest of its B id. The table is cut into slices of ``SLICE`` pairs, at
   borders between B ids, so that no row grows with the corpus.
4. Stream back: the record runs meet the counted slices in one sorted stream per
   (partition, share): first the slices, then the runs. A share is about
   ``FAN`` runs of a partition, so the largest partition is many tasks, and a
   task holds the slices of one partition and one run at a time. Each run gives
   its documents' part of the sums, and these are added up per document.

Memory is bounded by the block, and by the different id pairs of a partition
(at most |A| x |B| / RADIX, however large the corpus).

Defined results: texts that are null or empty, or that do not come back byte for
byte from either tokenizer, have no tokens: zeros and an empty string; repeated
rows are documents of their own (a repeated text counts again); a null doc_id
stays null; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import hashlib
import heapq
import itertools
import os

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

RADIX = 16
FAN = 64
BLOCK_CHARS = 2_000_000
BLOCK_DOCS = 20_000
SLICE = 1_000_000
#: Bits of an id and of a document's number within its block in a record.
ID_BITS, DOC_BITS = 20, 24

_SIDES: dict = {}


def _path(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def _byte_of() -> dict:
    """Byte-level alphabet: printable Latin-1 characters stand for themselves,
    the other bytes for the characters from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _byte_level(name: str):
    """(encode texts, bytes of each id) of a byte-level BPE file."""
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(_path(name))
    tok.encode_special_tokens = True
    special = set(tok.get_added_tokens_decoder())
    vocab = tok.get_vocab()
    letters = _byte_of()
    size = max(vocab.values()) + 1
    table = [b""] * size
    for entry, i in vocab.items():
        if i not in special:
            table[i] = bytes(letters[c] for c in entry)
    return (lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]), table


def _ranked(name: str, json_name: str):
    """As ``_byte_level``, but encoded by the ranks file of the same vocabulary, which is several times faster."""
    import base64

    import public_tokenizers
    import tiktoken
    ranks = {}
    with open(_path(name), "rb") as f:
        for line in f:
            entry, rank = line.split()
            ranks[base64.b64decode(entry)] = int(rank)
    enc = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    table = [b""] * (max(ranks.values()) + 1)
    for entry, i in ranks.items():
        table[i] = entry
    return (lambda texts: [enc.encode_ordinary(t) for t in texts]), table


def _pieces(name: str):
    """(encode texts, bytes of each id) of a sentence-piece model with byte fallback."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=_path(name))
    table = []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        table.append(bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else piece.replace("▁", " ").encode())
    return (lambda texts: sp.encode(texts, num_threads=1)), table


class _Side:
    def __init__(self, kind: str, *names: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark runs the tasks in parallel
        self.encode, self.table = {"byte": _byte_level, "ranks": _ranked, "piece": _pieces}[kind](*names)
        self.size = np.array([len(b) for b in self.table], np.int64)
        self.name = np.array([str(i) for i in range(len(self.table))], dtype=object)


def _side(spec: tuple) -> _Side:
    if spec not in _SIDES:
        _SIDES[spec] = _Side(*spec)
    return _SIDES[spec]


def _encoded(texts: list, a: _Side, b: _Side):
    """Ids of both sides per text; none where a side's bytes differ from space + text."""
    good = [i for i, t in enumerate(texts) if t]
    out = [((), ())] * len(texts)
    ids_a, ids_b = a.encode([" " + texts[i] for i in good]), b.encode([texts[i] for i in good])
    for i, x, y in zip(good, ids_a, ids_b):
        want = (" " + texts[i]).encode("utf-8", "surrogatepass")
        if b"".join(map(a.table.__getitem__, x)) == want == b"".join(map(b.table.__getitem__, y)):
            out[i] = (x, y)
    return out


def _flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(n.sum())), n


def _align(texts: list, a: _Side, b: _Side):
    """Per text: n_a, n_b, n_groups, digest; and the links as (A id, B id, text
    number), for a block of texts laid end to end on one line of bytes."""
    ids = _encoded(texts, a, b)
    ia, na = _flat([x for x, _ in ids])
    ib, nb = _flat([y for _, y in ids])
    ea, eb = np.cumsum(a.size[ia]), np.cumsum(b.size[ib])
    total = int(ea[-1]) + 1 if len(ea) else 1
    at = np.zeros(total, bool)
    at[ea] = True
    last_b = at[eb]
    at[:] = False
    at[eb] = True
    last_a = at[ea]
    link_a, link_b = np.flatnonzero(last_a), np.flatnonzero(last_b)       # group g ends with these two
    ga, gb = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b       # group of each token
    cut_a, cut_b = np.cumsum(na), np.cumsum(nb)
    doc = np.searchsorted(cut_a, link_a, side="right")
    n_groups = np.bincount(doc, minlength=len(texts))
    # a1,a2|b1;: A tokens of a group stand behind all tokens of earlier groups
    place_a = np.arange(len(ia)) + np.concatenate(([0], link_b + 1))[ga]
    place_b = np.arange(len(ib)) + np.concatenate((link_a + 1, [len(ia)]))[gb]
    said = np.empty(len(ia) + len(ib), object)
    said[place_a] = a.name[ia] + np.where(last_a, "|", ",").astype(object)
    said[place_b] = b.name[ib] + np.where(last_b, ";", ",").astype(object)
    ends = np.concatenate(([0], cut_a + cut_b))
    digest = [hashlib.sha256("".join(said[lo:hi])[:-1].encode()).hexdigest() if hi > lo else ""
              for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist())]
    return na, nb, n_groups, digest, ia[link_a], ib[link_b], doc


def _packed(*arrays) -> bytes:
    """Arrays of 64-bit numbers, each stored as steps, compressed together."""
    import zstandard
    sizes = np.array([len(x) for x in arrays], "<i8")
    body = b"".join(np.diff(x, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for x in arrays)
    return sizes.tobytes() + zstandard.ZstdCompressor(level=1).compress(body)


def _unpacked(blob: bytes, n: int) -> list[np.ndarray]:
    import zstandard
    sizes = np.frombuffer(blob[:8 * n], "<i8")
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8 * n:], max_output_size=int(8 * sizes.sum()) + 1), np.uint8)
    out, lo = [], 0
    for size in sizes.tolist():
        steps = body[lo:lo + 8 * size].reshape(8, size).T.copy().view("<i8").ravel()
        out.append(np.cumsum(steps))
        lo += 8 * size
    return out


_SPILL = ("block long, ord int, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, "
          "radix int, pairs binary, records binary")


def spill(docs: DataFrame, a: tuple, b: tuple, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Written table of document rows (radix null) and record runs."""
    def block_rows(number, ids, texts):
        na, nb, groups, digest, la, lb, doc = _align(texts, _side(a), _side(b))
        yield pd.DataFrame({"block": number, "ord": np.arange(len(ids), dtype=np.int32), "doc_id": pd.array(ids, "Int64"), "n_a": na, "n_b": nb,
                            "n_groups": groups, "groups_sha256": digest, "radix": pd.array([None] * len(ids), "Int32"), "pairs": None, "records": None})
        pair = lb << ID_BITS | la
        records, n = np.unique(pair << DOC_BITS | doc, return_counts=True)        # sorted by (B id, A id, document)
        pair = records >> DOC_BITS
        part = pair >> ID_BITS & (RADIX - 1)
        runs = []
        for r in range(RADIX):
            mine = part == r
            if mine.any():
                p, first = np.unique(pair[mine], return_index=True)
                totals = np.add.reduceat(n[mine], first)
                docs_of = np.diff(np.append(first, mine.sum()))
                runs.append((r, _packed(p, totals), _packed(p, docs_of, records[mine] & (1 << DOC_BITS) - 1, n[mine])))
        yield pd.DataFrame({"block": number, "ord": pd.array([None] * len(runs), "Int32"), "doc_id": pd.array([None] * len(runs), "Int64"),
                            **{c: pd.array([None] * len(runs), "Int64") for c in ("n_a", "n_b", "n_groups")}, "groups_sha256": None,
                            "radix": pd.array([r for r, _, _ in runs], "Int32"), "pairs": [p for _, p, _ in runs], "records": [x for _, _, x in runs]})

    schema = pa.schema([("block", pa.int64()), ("ord", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                        ("groups_sha256", pa.string()), ("radix", pa.int32()), ("pairs", pa.binary()), ("records", pa.binary())])

    def run(batches):
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def out():
            for pdf in block_rows(number, ids, texts):
                if len(pdf):
                    yield pa.RecordBatch.from_pandas(pdf, schema=schema, preserve_index=False)
        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(d)
                texts.append(t)
                size += len(t or "")
                if size >= BLOCK_CHARS or len(ids) >= BLOCK_DOCS:
                    yield from out()
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield from out()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return written(rows.mapInArrow(run, _SPILL), "spill")


def _heap_merged(runs: list) -> tuple[np.ndarray, np.ndarray]:
    """K-way heap merge of sorted (pairs, counts) runs, counts of a pair added up."""
    streams = [zip(p.tolist(), n.tolist()) for p, n in runs]
    pairs, counts, last = [], [], None
    for pair, n in heapq.merge(*streams):
        if pair == last:
            counts[-1] += n
        else:
            pairs.append(pair)
            counts.append(n)
            last = pair
    return np.array(pairs, np.int64), np.array(counts, np.int64)


def pair_counts(spilled: DataFrame) -> DataFrame:
    """Counted slices: radix, pairs (packed pairs, counts, 1 where the count is
    the highest of the pair's B id)."""
    runs = spilled.where("radix IS NOT NULL").select("radix", "block", "pairs")
    n_blocks = spilled.agg(F.count_distinct("block")).first()[0]

    def merge(pdf):
        pairs, counts = _heap_merged([_unpacked(x, 2) for x in pdf["pairs"]])
        return pd.DataFrame({"radix": [pdf["radix"].iloc[0]], "block": [pdf["block"].min()], "pairs": [_packed(pairs, counts)]})

    def finish(pdf):
        pairs, counts = _heap_merged([_unpacked(x, 2) for x in pdf["pairs"]])
        side = pairs >> ID_BITS
        first = np.flatnonzero(np.diff(side, prepend=-1))
        top = np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(side))))
        cuts = [0, *first[np.searchsorted(first, np.arange(SLICE, len(pairs), SLICE))[np.searchsorted(first, np.arange(SLICE, len(pairs), SLICE)) < len(first)]].tolist(), len(pairs)]
        rows = [(pdf["radix"].iloc[0], _packed(pairs[lo:hi], counts[lo:hi], (counts == top)[lo:hi].astype(np.int64)))
                for lo, hi in zip(cuts, cuts[1:]) if hi > lo]
        return pd.DataFrame(rows, columns=["radix", "pairs"])

    while n_blocks > FAN:
        n_blocks = -(-n_blocks // FAN)
        share = F.expr(f"pmod(xxhash64(block, {n_blocks}), {n_blocks})")
        runs = written(runs.groupBy("radix", share.alias("_s")).applyInPandas(merge, "radix int, block long, pairs binary"), "runs")
    return written(runs.groupBy("radix").applyInPandas(finish, "radix int, pairs binary"), "counts")


def contributions(spilled: DataFrame, counted: DataFrame) -> DataFrame:
    """block, ord, n_best, count_sum: what each run adds to its documents."""
    n_shares = -(-spilled.agg(F.count_distinct("block")).first()[0] // FAN) or 1
    share = F.expr(f"cast(pmod(xxhash64(block, {n_shares}), {n_shares}) as int)")
    runs = spilled.where("radix IS NOT NULL").select("radix", share.alias("share"), F.col("block"), F.col("records").alias("blob"))
    copies = counted.select("radix", F.explode(F.sequence(F.lit(0), F.lit(n_shares - 1))).alias("share"),
                            F.lit(None).cast("long").alias("block"), F.col("pairs").alias("blob"))

    def run(batches):
        now, slices, table = None, [], None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["radix"], row["share"]) != now:
                    now, slices, table = (row["radix"], row["share"]), [], None
                if row["block"] is None:
                    slices.append(_unpacked(row["blob"], 3))
                    continue
                if table is None:
                    slices.sort(key=lambda s: s[0][0])
                    table = [np.concatenate(c) for c in zip(*slices)]
                pairs, n_docs, doc, n = _unpacked(row["blob"], 4)
                at = np.repeat(np.searchsorted(table[0], pairs), n_docs)
                ords, place = np.unique(doc, return_inverse=True)
                total, best = np.zeros(len(ords), np.int64), np.zeros(len(ords), np.int64)
                np.add.at(total, place, n * table[1][at])
                np.add.at(best, place, n * table[2][at])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ords), row["block"])), pa.array(ords.astype(np.int32)), pa.array(best), pa.array(total)],
                                                 ["block", "ord", "n_best", "count_sum"])

    # few (radix, share) keys: by range, so that keys do not fall on each other
    stream = runs.unionByName(copies).repartitionByRange(F.col("radix"), F.col("share"))
    stream = stream.sortWithinPartitions("radix", "share", "block")        # a null block, the slices, first
    return (stream.mapInArrow(run, "block long, ord int, n_best long, count_sum long")
            .groupBy("block", "ord").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))


def alignment(docs: DataFrame, a: tuple, b: tuple) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256. ``a`` and ``b``: ('byte', json file), ('ranks',
    ranks file, json file) or ('piece', model file)."""
    spilled = spill(docs, a, b)
    sums = contributions(spilled, pair_counts(spilled))
    rows = spilled.where("radix IS NULL").select("block", "ord", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")
    return rows.join(sums, ["block", "ord"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")


def id_pairs(counted: DataFrame) -> DataFrame:
    """The counted pairs as rows: b_id, a_id, n, best."""
    def run(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                pairs, n, best = _unpacked(blob, 3)
                yield pa.RecordBatch.from_arrays([pa.array(pairs >> ID_BITS), pa.array(pairs & (1 << ID_BITS) - 1), pa.array(n), pa.array(best == 1)],
                                                 ["b_id", "a_id", "n", "best"])
    return counted.select("pairs").mapInArrow(run, "b_id long, a_id long, n long, best boolean")
