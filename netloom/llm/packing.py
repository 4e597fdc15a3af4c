"""Packing: Space-filling-curve order.

Each document becomes a vector of hashed token counts, which fixed random directions project to a few dimensions. The
cell of that point along a Hilbert curve is the document's key. Documents are range-sorted by the key, and each range is
cut into sequences along the curve, so that neighbours of like content share sequences.

Only the last sequence of a range could need padding; it is cut into powers of two, which need none. Copies have the
same key; a hash of the id breaks the tie, so the ranges split a group of copies of any size.

Cases: a null text is empty; an empty document is its final id alone; repeated rows are packed once each; an empty table
gives no rows; null ids stay null; further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEQUENCE = 2048
DIMENSIONS, BITS, BUCKETS = 4, 15, 1024
#: Tokens of a range; so many 16-bit ids are held by no task, as sequences leave as they fill.
RANGE_TOKENS = 4_000_000
#: Distinct chunks that a worker remembers before it starts anew.
REMEMBERED = 500_000
FINAL_ID = 1

_TOKENS = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n", pa.int64()), ("curve", pa.int64()), ("tie", pa.int64())])
_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)
TOKENS_DDL = "doc_id long, ids binary, n long, curve long, tie long"
PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordBpe:
    """Token ids of a word-end BPE vocabulary file, the same as the tokenizers library gives.

    The library splits at white space first, so ids of chunks between spaces and line feeds can be remembered. Chunks of
    plain Latin letters, digits and signs that are new go through a byte-pair merger built from the same file, with a zero
    byte as the mark of a word's end; all others go through the library itself."""

    _plain = re.compile(r"[!-~¡-ɏ]+").fullmatch

    def __init__(self, path: str):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        split = model["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces, suffix = regex.compile(split).findall, model["model"]["end_of_word_suffix"]
        # The usual printable alphabet for bytes: printable Latin-1 stands for itself, the others follow from 256 on.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}

        def key(token: str) -> bytes:
            ends = token.endswith(suffix)
            return bytes(byte_of[c] for c in (token[: -len(suffix)] if ends else token)) + b"\0" * ends

        ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 0]): 256 + b for b in range(256)}
        for merge in model["model"]["merges"]:
            ranks.setdefault(key("".join(merge if isinstance(merge, list) else merge.split(" "))), len(ranks))
        self.id_of = np.zeros(len(ranks), np.uint16)
        special = {t["content"] for t in model["added_tokens"]}
        for token, i in model["model"]["vocab"].items():
            if token not in special and (rank := ranks.get(key(token))) is not None:
                self.id_of[rank] = i
        self.merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.seen: dict[str, bytes] = {"": b""}

    def _chunk(self, chunk: str) -> bytes:
        if self._plain(chunk) and "<|" not in chunk:
            ranks = [r for piece in self.pieces(chunk.lower()) for r in self.merge(piece.encode() + b"\0")]
            ids = self.id_of[ranks] if ranks else np.zeros(0, np.uint16)
        else:
            ids = np.asarray(self.library.encode(chunk, add_special_tokens=False).ids, np.uint16)
        return ids.astype("<u2").tobytes()

    def __call__(self, text: str) -> bytes:
        """Little-endian 16-bit ids."""
        chunks = text.replace("\n", " ").split(" ")
        seen = self.seen
        if len(seen) > REMEMBERED:
            seen.clear()
        for chunk in set(chunks).difference(seen):
            seen[chunk] = self._chunk(chunk)
        return b"".join(map(seen.__getitem__, chunks))


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


@lru_cache(maxsize=1)
def _directions() -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each 16-bit id, and the direction of each bucket."""
    bucket = (common.mix64(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)
    return bucket, np.random.Generator(np.random.PCG64(20)).standard_normal((BUCKETS, DIMENSIONS))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place along a Hilbert curve of each row of unsigned cell coordinates (Skilling's transpose form)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_keys(documents: list[np.ndarray]) -> np.ndarray:
    bucket, directions = _directions()
    counts = np.stack([np.bincount(bucket[d], minlength=BUCKETS) for d in documents]).astype(np.float64)
    points = counts @ directions / np.maximum(np.sqrt((counts**2).sum(1, keepdims=True)), 1)
    cells = ((np.tanh(points / 2) + 1) / 2 * (1 << BITS)).astype(np.int64).clip(0, (1 << BITS) - 1)
    return hilbert(cells)


def _tokenize(path: str):
    def run(rows):
        tokenizer, final = _tokenizer(path), np.array([FINAL_ID], "<u2").tobytes()
        for batch in common.batches(rows):
            ids = [tokenizer(t or "") + final for t in batch.column(1).to_pylist()]
            arrays = [np.frombuffer(x, "<u2") for x in ids]
            yield common.arrow(_TOKENS, doc_id=batch.column(0), ids=ids, n=[len(a) for a in arrays], curve=curve_keys(arrays), tie=batch.column(2))
        tokenizer.seen = {"": b""}  # a worker lives on, and others need its memory

    return run


def _pack(size: int):
    def cut(pieces: list, lengths: list[int]):
        """Deals the pieces, in order, out to sequences of these lengths."""
        at, room = 0, lengths[0]
        for doc, start, raw, total in pieces:
            n = len(raw) // 4
            done = 0
            while done < n:
                take = min(n - done, room)
                yield at, doc, start + done, take, zlib.crc32(raw[4 * done : 4 * (done + take)]), total, lengths[at] - room
                done += take
                room -= take
                if not room and at + 1 < len(lengths):
                    at += 1
                    room = lengths[at]

    def run(rows):
        base = TaskContext.get().partitionId() << 40
        sequence, open_, filled = 0, [], 0
        for batch in common.batches(rows):
            out: list[tuple] = []
            for doc, ids, total in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw, start = memoryview(np.frombuffer(ids, "<u2").astype("<u4").tobytes()), 0
                while start < total:
                    take = min(total - start, size - filled)
                    open_.append((doc, start, raw[4 * start : 4 * (start + take)], total))
                    filled += take
                    start += take
                    if filled == size:
                        out += [(d, s, n, c, t, base + sequence + k, o) for k, d, s, n, c, t, o in cut(open_, [size])]
                        sequence, open_, filled = sequence + 1, [], 0
            if out:
                yield common.arrow(_PIECES, **dict(zip(_PIECES.names, zip(*out, strict=True), strict=True)))
        if open_:
            lengths = [1 << b for b in range(filled.bit_length() - 1, -1, -1) if filled >> b & 1]
            out = [(d, s, n, c, t, base + sequence + k, o) for k, d, s, n, c, t, o in cut(open_, lengths)]
            yield common.arrow(_PIECES, **dict(zip(_PIECES.names, zip(*out, strict=True), strict=True)))

    return run


def pack(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    Token ids are written once in the shared folder, beside the curve key. One shuffle then deals them out by ranges of
    (key, hash of id), whose number follows the count of tokens; ranges are packed each for itself."""
    rows = common.documents_of(docs).withColumn("tie", F.xxhash64("doc_id"))
    tokens = common.materialize(rows.mapInArrow(_tokenize(tokenizer_path), TOKENS_DDL), "tokens")
    total = tokens.agg(F.sum("n")).first()[0] or 0
    ranges = max(1, -(-total // range_tokens))
    placed = tokens.repartitionByRange(ranges, "curve", "tie").sortWithinPartitions("curve", "tie", "doc_id", "n")
    return placed.select("doc_id", "ids", "n").mapInArrow(_pack(size), PIECES_DDL)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), default_tokenizer())
