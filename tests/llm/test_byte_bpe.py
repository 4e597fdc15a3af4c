import base64
import hashlib
import random

import numpy as np
import public_tokenizers as public
import tiktoken
from tokenizers import Tokenizer

from netloom.llm import byte_bpe

RANKS, JSON = public.path("byte_bpe_50k.tiktoken"), public.path("byte_bpe_50k.json")


def library():
    ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rnd = random.Random(1)
    letters = " \n\t'sabcdeABé中 ​👍0123.,-_  "
    odd = ["a" * 5000, "ab" * 700 + " " + "\n" * 900, " " * 2000 + "x", "word " * 30_000, "<|endoftext|> x", "", " ", "\u0085 a  b \x1c c", "it's we'll  I'M", "ʰ ͹a ࢏", "same", "same", "x" * 255, "y" * 256, "zq" * 129]
    return odd + ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]


def encoded(bpe, all_texts, leading=""):
    out = [[] for _ in all_texts]
    for chunks, runs in byte_bpe.batched(all_texts, leading):
        ids, counts = bpe.remembered(chunks)
        ends = byte_bpe.offsets(counts)[np.cumsum([n for _, n in runs])].tolist()
        for (i, _), begin, end in zip(runs, [0, *ends], ends):
            out[i] += ids[begin:end].tolist()
    return out


def test_ids_of_rank_file():
    mine, theirs = byte_bpe.vocabulary(RANKS, public.PATTERN), library()
    assert encoded(mine, texts()) == [theirs.encode_ordinary(t) for t in texts()]


def test_ids_of_json_file():
    mine, theirs = byte_bpe.vocabulary(JSON, public.PATTERN), Tokenizer.from_file(JSON)
    theirs.encode_special_tokens = True
    assert encoded(mine, texts(), " ") == [theirs.encode(" " + t, add_special_tokens=False).ids if t else [] for t in texts()]


def test_stretches_and_small_memory(monkeypatch):
    mine, theirs = byte_bpe.ByteBpe.from_ranks(RANKS, public.PATTERN), library()
    monkeypatch.setattr(byte_bpe, "STRETCH", 40)
    monkeypatch.setattr(byte_bpe, "AT_ONCE", 16)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 60)
    some = [t for t in texts() if len(t) < 3000]
    assert encoded(mine, some) == [theirs.encode_ordinary(t) for t in some]


def test_digests(spark):
    theirs = library()
    some = [*texts()[:200], None]
    docs = spark.createDataFrame([*enumerate(some), (None, "no id"), (3, "again")], "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS n_tokens")
    got = sorted(map(tuple, byte_bpe.digests(docs, RANKS, public.PATTERN).collect()), key=repr)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in [*enumerate(some), (None, "no id"), (3, "again")]:
        ids = theirs.encode_ordinary(t or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert got == sorted(want, key=repr)


def test_round_trip(spark):
    docs = spark.createDataFrame(list(enumerate(texts()[:300])), "doc_id long, text string")
    back = byte_bpe.decode(byte_bpe.encode(docs, RANKS, public.PATTERN), RANKS, public.PATTERN)
    assert sorted(map(tuple, back.collect())) == list(enumerate(texts()[:300]))


def test_whole_documents(spark):
    theirs = library()
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = byte_bpe.op11_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(rows)
    for r in got:
        ids = theirs.encode_ordinary(rows[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(rows[r.doc_id].encode()).hexdigest()


def test_empty_table(spark):
    assert byte_bpe.digests(spark.createDataFrame([], "doc_id long, text string"), RANKS, public.PATTERN).count() == 0
