"""Cross-tokenizer alignment against a plain computation, and its edge cases."""
import collections
import hashlib

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerscope.llm import aligned, q_aligned

ODD = ["<|endoftext|> a<s></s><unk>", "  two  spaces\t tab\n\nnl ", "ａ ﬁ \xbd é \xe9", "\x00\x01 ▁x ▁", "<0x41> <0x0A>",
       "\U0001f600\U0001f44d\U0001f3fd 漢字", " ", "\n", "a\xa0b　c", "﻿x", "\r\n", "A​B", "", None, "the the the the", "x" * 3000]


def plain(texts):
    """The contract's columns with the named files, one text at a time."""
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    letters = aligned._byte_of()
    rows, counts = [], collections.Counter()
    for t in texts:
        a = tok.encode(" " + (t or ""), add_special_tokens=False)
        ba = [bytes(letters[c] for c in x) for x in a.tokens]
        ib = sp.encode(t or "")
        bb = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, sp.id_to_piece(i)) for i in ib)]
        want = (" " + (t or "")).encode()
        if not t or b"".join(ba) != want or b"".join(bb) != want:
            rows.append(None)
            continue
        def ends(parts):
            out, at = [], 0
            for p in parts:
                at += len(p)
                out.append(at)
            return out
        ea, eb = ends(ba), ends(bb)
        cuts, groups, links = sorted(set(ea) & set(eb)), [], []
        lo = 0
        for e in cuts:
            ga = [i for i, x in zip(a.ids, ea) if lo < x <= e]
            gb = [i for i, x in zip(ib, eb) if lo < x <= e]
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
            links += [(i, j) for i, x in zip(a.ids, ea) if x == e for j, y in zip(ib, eb) if y == e]
            lo = e
        counts.update(links)
        rows.append((len(a.ids), len(ib), groups, links))
    top = collections.Counter()
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else
            (r[0], r[1], len(r[2]), len(r[3]), sum(counts[x] == top[x[1]] for x in r[3]), sum(counts[x] for x in r[3]),
             hashlib.sha256(";".join(r[2]).encode()).hexdigest()) for r in rows]


@pytest.mark.parametrize("block, fan, slice_", [(4_000_000, 64, 1_000_000), (3_000, 2, 50)])
def test_against_plain(spark, sf_dir, monkeypatch, block, fan, slice_):
    monkeypatch.setattr(aligned, "BLOCK_CHARS", block)
    monkeypatch.setattr(aligned, "FAN", fan)
    monkeypatch.setattr(aligned, "SLICE", slice_)
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60).collect()] + ["the the the the"]
    docs = spark.createDataFrame([(i, t, 1, "r", "b") for i, t in enumerate(texts)], "doc_id long, text string, ord int, radix string, block string")
    out = aligned.alignment(docs, q_aligned.A, q_aligned.B)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = {r[0]: tuple(r)[1:] for r in out.collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts)


def test_ranks_file_encodes_as_the_named_file():
    fast, slow = aligned._side(q_aligned.A), aligned._side(("byte", "byte_bpe_50k.json"))
    texts = [t for t in ODD if t] + ["ab" * 5000, "don't WON'T 12345 ٠١ á ßẞ \t\x0b\x85 z"]
    assert fast.encode(texts) == slow.encode(texts)
    assert fast.table[:50256] == slow.table[:50256]


def test_counted_pairs(spark):
    docs = spark.createDataFrame([(1, "the cat"), (2, "the dog"), (2, "the dog"), (None, None)], "doc_id long, text string")
    spilled = aligned.spill(docs, q_aligned.A, q_aligned.B)
    rows = aligned.id_pairs(aligned.pair_counts(spilled)).collect()
    assert sum(r.n for r in rows) == spilled.agg({"n_groups": "sum"}).first()[0] and max(r.n for r in rows) == 3
    assert all(r.best for r in rows)


def test_empty_table(spark):
    assert aligned.alignment(spark.createDataFrame([], "doc_id long, text string"), q_aligned.A, q_aligned.B).collect() == []
