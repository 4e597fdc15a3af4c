import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as public
import pytest
import sentencepiece
from tokenizers import Tokenizer

from netloom.llm import alignment, byte_bpe

A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
ODD = ["", None, " ", "  two  spaces ", "a▁b c", "x" * 700 + " end", "\n\nlines\n of  text\t", "<s> </s> <|endoftext|>", "中文 と 日本語 😀!", "é́ ﬁne", "\x00 nul", "word", "word", "tail ", " nbsp  em"]


def brute(texts):
    """By the libraries, all pairs of tokens and plain loops."""
    left, right = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    left.encode_special_tokens = True
    byte_of = byte_bpe.printable_bytes()
    bytes_a = lambda i: bytes(byte_of[c] for c in left.id_to_token(i))
    bytes_b = lambda i: bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode()
    out, links_of, pairs = [], [], Counter()
    for t in texts:
        a, b = (left.encode(" " + t, add_special_tokens=False).ids, right.encode(t)) if t else ([], [])
        if t and not b"".join(map(bytes_a, a)) == b"".join(map(bytes_b, b)) == (" " + t).encode():
            a, b = [], []
        spans = []
        for ids, of in ((a, bytes_a), (b, bytes_b)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(of(i))))
                at = own[-1][1]
            spans.append(own)
        common_ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, begin = [], 0
        for end in common_ends:
            groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, own) if begin <= s and e <= end) for ids, own in zip((a, b), spans)))
            begin = end
        links, low = [], 0
        for i, (s, e) in zip(a, spans[0]):
            while low < len(b) and spans[1][low][1] <= s:
                low += 1
            j = low
            while j < len(b) and spans[1][j][0] < e:
                links.append((i, b[j]))
                j += 1
        pairs.update(links)
        links_of.append(links)
        out.append([len(a), len(b), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""])
    highest = {}
    for (_, b), n in pairs.items():
        highest[b] = max(n, highest.get(b, 0))
    return [(*o[:4], sum(pairs[p] == highest[p[1]] for p in links), sum(pairs[p] for p in links), o[4]) for o, links in zip(out, links_of)]


def found(spark, texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS block", "2 AS links", "3 AS place", "4 AS a")
    rows = alignment.aligned(docs, A, public.PATTERN, B, **more).collect()
    return [tuple(r)[1:] for r in sorted(rows)]


def expected(texts):
    return [tuple(int(x) if isinstance(x, (int, np.integer)) else x for x in r) for r in brute(texts)]


@pytest.mark.parametrize("block_links", [300, 4_000_000])
def test_equal_to_brute_force(spark, block_links):
    rnd = random.Random(7)
    letters = " \n\tabcdeEé中 ​\U0001f44d0123.,-_'  "
    texts = [*ODD, *("".join(rnd.choice(letters) for _ in range(rnd.randint(0, 80))) for _ in range(150))]
    assert found(spark, texts, block_links=block_links) == expected(texts)


def test_whole_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in alignment.op13_alignment(spark, "/root/testdata/sf0.001").collect()}
    want = expected([r.text for r in rows])
    assert len(got) == len(rows)
    assert [got[r.doc_id] for r in rows] == want


def test_long_text_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "STRETCH", 50)
    monkeypatch.setattr(byte_bpe, "AT_ONCE", 8)
    sides = alignment.Sides(A, public.PATTERN, B)
    text = "some words, and  more words " * 40 + "x" * 300
    whole = alignment._whole(sides, text)
    document = alignment._Document()
    for chunks, runs in byte_bpe.batched([text], " "):
        assert len(runs) == 1
        numbers = sides.remembered(chunks)
        take = lambda flat, at: np.concatenate([flat[at[i] : at[i + 1]] for i in numbers])
        document.add(sides.facts[numbers], take(sides.links, sides.link_at), take(sides.text, sides.text_at))
    assert document.digest() == whole.digest() and (document.facts == whole.facts).all()
    assert all((x == y).all() for x, y in zip(document.links(), whole.links()))


def test_empty_and_repeated(spark):
    assert found(spark, []) == []
    assert found(spark, [None, "", None]) == [(0, 0, 0, 0, 0, 0, "")] * 3
    one, two = found(spark, ["same text", "same text"])
    assert one == two


def test_merged_ends():
    a, b, both = alignment.merged_ends(np.array([2, 3, 7]), np.array([1, 3, 5, 6, 7]))
    assert list(zip(a.tolist(), b.tolist())) == [(0, 0), (0, 1), (1, 1), (2, 2), (2, 3), (2, 4)]
    assert both.tolist() == [False, False, True, False, False, True]
