import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from netloom.llm import packing

ROWS = [(1, "The quick brown fox. It's 12 o'clock!\n Straße ΑΣ x́ <|endoftext|>"), (2, None), (3, ""), (4, "word " * 5000), (4, "word " * 5000), (None, "no id"), (7, "a b\u0085c\0d !\0\0 𝒳")]


def check(rows, out, size):
    library = Tokenizer.from_file(packing.default_tokenizer())
    want = sorted((-1 if i is None else i, tuple(library.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in rows)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[-1 if r.doc_id is None else r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, ids in want:
        mine = [r for r in pieces[i] if r.doc_tokens == len(ids) and zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32]
        assert {(r.start, r.length) for r in mine}, i
    assert sum(r.length for r in out) == sum(len(x) for _, x in want)
    padding = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    assert padding == 0


def test_pieces(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumnsRenamed({}).selectExpr("*", "1 AS ids", "2 AS n", "3 AS curve")
    check(ROWS, packing.pack(docs, packing.default_tokenizer()).collect(), 2048)


def test_several_ranges(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    out = packing.pack(docs, packing.default_tokenizer(), size=64, range_tokens=500).collect()
    check(ROWS, out, 64)
    assert len({r.sequence_id >> 40 for r in out}) > 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, packing.default_tokenizer()).count() == 0


def test_whole_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(rows, packing.op9_packing(spark, "/root/testdata/sf0.001").collect(), 2048)


def test_hilbert_steps_to_neighbours():
    side = 8
    cells = np.array([(i, j, k) for i in range(side) for j in range(side) for k in range(side)])
    order = cells[np.argsort(packing.hilbert(cells, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()
