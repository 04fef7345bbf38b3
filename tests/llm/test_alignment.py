"""Alignment of two tokenizers against a walk over single texts."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from riskframe.llm import alignment
from tests.llm.fixture import documents, sentences, texts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
EXTRA = [
    (300, " leading"), (301, "trailing "), (302, "\n"), (303, " "), (304, "a \t b  c d\r\n\r\n  e \n f\n\n\ng"),
    (305, "it's we'll\n's 'x <s> </s> <unk> <0x0A> <|endoftext|>"), (306, "汉字 and ▁ piece"), (307, "汉字漢字𠮷é́ ﬁ ½ ٣ \U0001f600"),
    (308, "x" * 3_000 + " " * 500 + "0" * 2_001), (309, "​ ﻿ ᠎ x"), (310, "tab\tonly"), (311, "nul \x00 \x1c  end"),
    (312, "=" * 6_000), (313, sentences(4, 5)), (314, sentences(4, 5)),
]


def aligned_by_hand(rows):
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = alignment.byte_of_character()

    def one(text):
        whole = (" " + text).encode()
        a = [(i, bytes(letters[c] for c in tokenizer.id_to_token(i))) for i in tokenizer.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in pieces.encode(text):
            piece = pieces.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode()))
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            return None
        groups, i, j, at_a, at_b = [], 0, 0, 0, 0
        while i < len(a):
            left, right = [], []
            while not left or at_a != at_b:
                if at_a <= at_b:
                    left.append(a[i][0])
                    at_a += len(a[i][1])
                    i += 1
                else:
                    right.append(b[j][0])
                    at_b += len(b[j][1])
                    j += 1
            groups.append((left, right))
        return groups

    found = [one(t or "") for _, t in rows]
    links = [Counter((x, y) for left, right in g for x in left for y in right) if g else Counter() for g in found]
    docs = Counter(pair for c in links for pair in c)
    most = defaultdict(int)
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    result = []
    for (d, _), g, c in zip(rows, found, links, strict=True):
        if g is None:
            result.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        named = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in g)
        result.append((
            d, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()),
            sum(n for pair, n in c.items() if docs[pair] == most[pair[0]]), sum(n * docs[pair] for pair, n in c.items()),
            hashlib.sha256(named.encode()).hexdigest(),
        ))
    return result


def test_alignment(spark):
    rows = texts() + EXTRA + [(400 + k, sentences(k % 3, 2)) for k in range(9)]
    expected = sorted(aligned_by_hand(rows), key=str)
    for held in (alignment.HELD_PAIRS, 40, 0):
        found = alignment.align_documents(documents(spark, rows), held=held)
        columns = ["doc_id", *alignment.MEASURES, "groups_sha256"]
        assert sorted(found.columns) == sorted(columns)
        assert sorted((tuple(r) for r in found.select(columns).collect()), key=str) == expected
    assert sum(1 for r in expected if r[-1]) > len(rows) - 12


def test_alignment_of_nothing(spark):
    assert alignment.align_documents(documents(spark, [])).count() == 0
    empty = alignment.align_documents(documents(spark, [(1, None), (2, ""), (None, None), (3, "▁")]))
    assert {tuple(r)[1:] for r in empty.collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_units_make_up_the_text():
    both = alignment.Aligner(A, B)
    assert both.cuts
    for _, text in texts() + EXTRA:
        assert "".join(both.units(text or "")) == " " + (text or "")


def test_wide_groups_are_folded(monkeypatch):
    plain, folded = alignment.Aligner(A, B), alignment.Aligner(A, B)
    mine = [t for _, t in texts() + EXTRA if t]
    first = plain.align(mine)
    monkeypatch.setattr(alignment, "WIDE_LINKS", 2)
    second = folded.align(mine)
    for x, y in zip([*first[0], *first[2:]], [*second[0], *second[2:]], strict=True):
        assert (x == y).all()
    assert first[1] == second[1]
