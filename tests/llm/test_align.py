"""Alignment of two tokenizers against a loop over tokens that encodes whole texts."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from inkmesh.llm import align

ODD = [None, "", " ", "  ", "\n", "a b  c   d ", "tail \n ", "\n x", "a▁b", "nb sp   x", "　 wide 　  y", "don't <|endoftext|> </s> <s> <unk> [INST]", "日本語 テキスト 😀😀", "\x00 nul \x1f", "é è à\t\tq", "x" * 3000, "= " * 200, "1234 56789 ١٢٣", "a  b\x85 c", "é combining", "<0x41> ▁ x", "​ zero", "﻿ bom", "ﬁ Ⅷ", "\r\n \r\n x", "the cat sat " * 3000]


def plainly(rows):
    plain, pieces = Tokenizer.from_file(public_tokenizers.path(align.BYTES_FILE)), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(align.PIECES_FILE))
    plain.encode_special_tokens = True
    char, docs, pairs = align.byte_of_char(), [], Counter()
    for i, text in rows:
        want, groups = (" " + (text or "")).encode(), []
        a, b = (plain.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)) if text else ([], [])
        own = [bytes(char[c] for c in plain.id_to_token(k)) for k in a], [align.piece_bytes(pieces.id_to_piece(k)) for k in b]
        if not text or any(b"".join(o) != want for o in own):
            a, b = [], []
        ends, at = [set(), set()], [0, 0]
        sides = [[], []]
        for side, ids in enumerate((a, b)):
            for k, _ in enumerate(ids):
                at[side] += len(own[side][k])
                sides[side].append(at[side])
                ends[side].add(at[side])
        cuts, last = sorted(ends[0] & ends[1]), 0
        for cut in cuts:
            groups.append(tuple([x for x, e in zip(ids, es, strict=True) if last < e <= cut] for ids, es in zip((a, b), sides, strict=True)) if len(cuts) < 50 else None)
            last = cut
        if len(cuts) >= 50:  # the same in one pass
            groups, left = [], [list(zip(ids, es, strict=True))[::-1] for ids, es in zip((a, b), sides, strict=True)]
            for cut in cuts:
                groups.append(([], []))
                for side in (0, 1):
                    while left[side] and left[side][-1][1] <= cut:
                        groups[-1][side].append(left[side].pop()[0])
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        docs.append((i, len(a), len(b), groups, links))
        pairs.update(set(links))
    best = defaultdict(int)
    for (a, _), n in pairs.items():
        best[a] = max(best[a], n)
    text = lambda gs: ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs)
    return sorted(((i, a, b, len(g), len(ls), sum(pairs[x] == best[x[0]] for x in ls), sum(pairs[x] for x in ls), hashlib.sha256(text(g).encode()).hexdigest() if g else "") for i, a, b, g, ls in docs), key=repr)


@pytest.mark.parametrize("most", [5, align.HEAD])
def test_against_whole_texts(spark, docs_of, most):
    texts = [*ODD, "a b", "a b", "the cat", "the dog sat"]
    ids = [*range(len(ODD)), 7, None, 100, 101]
    found = align.align(docs_of(texts, ids).withColumnRenamed("lang", "a").withColumnRenamed("source", "links").repartition(4), most=most)
    assert sorted(map(tuple, found.collect()), key=repr) == plainly(list(zip(ids, texts, strict=True)))


def test_portions_and_forgotten_stretches(spark, docs_of, rng, monkeypatch):
    texts = [" ".join(rng.choice(["tokenizer", "alignment", "é", "naïve", f"w{rng.randrange(99)}"]) for _ in range(60)) for _ in range(40)]
    want = plainly(list(enumerate(texts)))
    import pyarrow as pa

    held = align.Tokens.of_worker(public_tokenizers.path(align.BYTES_FILE), public_tokenizers.path(align.PIECES_FILE))
    monkeypatch.setattr(align, "PORTION", 3000.0)
    monkeypatch.setattr(align, "KEPT", 50)
    monkeypatch.setattr(align, "LINE", 3)
    run = align._tokenised(public_tokenizers.path(align.BYTES_FILE), public_tokenizers.path(align.PIECES_FILE))
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    got = [(t["doc_id"], t["n_a"], t["n_b"]) for row in run(iter([batch])) for t in row.column(5).to_pylist()[0]]
    assert sorted(got) == sorted(w[:3] for w in want) and not held.row


def test_no_rows(docs_of):
    assert align.align(docs_of([])).count() == 0
