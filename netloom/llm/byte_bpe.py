"""Byte-level BPE: encoding and decoding by length-bucketed matrices.

A text is cut into pieces by the vocabulary's pattern, and each piece is merged for itself. Pieces of like length form a padded
matrix, a row each. In each round every row merges its leftmost pair of the least rank; ranks of pairs come from a hash table with
open addressing, looked up for whole columns at once. Rows without a pair left leave, and the matrix shrinks to the rows and
columns still in use. A row wider than `WIDEST` bytes would be rescanned quadratically, so there the same pair comes from a heap.

A single space between two characters that are not white space always begins a piece. Texts are cut there into chunks, and a
worker remembers the ids of at most `REMEMBERED` chunks. Ids of a batch are one flat array; decimals and bytes are gathered from it.

Cases: a null or empty text has no ids; very long texts go through in stretches of about `STRETCH` characters, so work arrays stay
small; the strings of special tokens are ordinary text; repeated rows and null ids are rows like others; equal texts have equal
results, so there are no ties; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Bytes of the widest matrix row, and cells of a matrix.
WIDEST, CELLS = 256, 1 << 19
#: Distinct chunks that a worker remembers before it forgets the rare ones, and bytes of the longest that it remembers.
REMEMBERED, LONGEST = 500_000, 64
#: Characters of a text, and chunks of a batch, that are worked on at once.
STRETCH, AT_ONCE = 1 << 20, 1 << 16
#: Ranks are below it; a rank and a column of the widest row share 32 bits.
NO_PAIR = np.int32(2**22 - 1)

#: Letters from ASCII and Latin-1 with or without a space before them: one piece for any pattern of this kind.
_one_word = re.compile("[ A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff][A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*").fullmatch
_even = re.compile(r" \s|\s ").search
_space_between = re.compile(r"(?<=\S) (?=\S)")
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))


class Strings:
    """Byte strings by number, gathered many at once."""

    def __init__(self, strings: list[bytes]):
        self.lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts = offsets(self.lengths)[:-1]
        self.bytes = np.frombuffer(b"".join(strings) + b"\0", np.uint8)

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings of these numbers in a row, and the length of each."""
        lengths = self.lengths[numbers]
        return self.bytes[ragged(self.starts[numbers], lengths)], lengths


class PairTable:
    """Merged token of a pair of tokens: a hash table of twice the pairs or more, with linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        bits = max(4, int(2 * len(left)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NO_PAIR, np.int32)
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot, waits = self._slots(key), np.arange(len(key))
        while len(waits):
            free = waits[self.keys[slot[waits]] == -1]
            self.keys[slot[free]] = key[free]  # of several that want a slot, one gets it
            won = self.keys[slot[waits]] == key[waits]
            self.values[slot[waits[won]]] = merged[waits[won]]
            waits = waits[~won]
            slot[waits] = (slot[waits] + 1) & self.mask

    def _slots(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """NO_PAIR where the pair doesn't merge; tokens below 0 are padding."""
        key = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        slot = self._slots(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], NO_PAIR)
        waits = np.flatnonzero((found != key) & (found != -1) & (key >= 0))
        while len(waits):
            slot[waits] = (slot[waits] + 1) & self.mask
            found = self.keys[slot[waits]]
            hit = found == key[waits]
            out[waits[hit]] = self.values[slot[waits[hit]]]
            waits = waits[~hit & (found != -1)]
        out[key < 0] = NO_PAIR
        return out.reshape(left.shape)


class ByteBpe:
    """A byte-level vocabulary: bytes of each token by rank, the id of each rank, the pattern and the pairs that merge."""

    def __init__(self, tokens: list[bytes], ids: np.ndarray, pattern: str, pairs: tuple[np.ndarray, np.ndarray, np.ndarray]):
        import regex

        self.rank_of = {t: i for i, t in enumerate(tokens)}
        self.single = np.array([self.rank_of[bytes([b])] for b in range(256)], np.int32)
        self.ids, self.pieces, self.pairs = ids.astype(np.int32), regex.compile(pattern).findall, PairTable(*pairs)
        self.of_bytes = self.pairs(np.repeat(self.single, 256), np.tile(self.single, 256)).reshape(256, 256)
        by_id: list[bytes] = [b""] * (int(ids.max()) + 1)
        for token, i in zip(tokens, ids.tolist(), strict=True):
            by_id[i] = token
        self.bytes_of, self.decimals = Strings(by_id), Strings([b" %d" % i for i in range(len(by_id))])
        self.forget()

    def forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.names: list[str | None] = []
        self.pool, self.filled = np.zeros(1 << 16, np.int32), 0
        self.at, self.count, self.uses = (np.zeros(1 << 14, np.int64) for _ in range(3))

    def _forget_rare(self) -> None:
        """Keeps the chunks that came again since the last time, at most the more frequent half of what may be remembered."""
        known = len(self.names)
        least = max(1, int(np.partition(self.uses[:known], known - REMEMBERED // 2)[known - REMEMBERED // 2]) if known > REMEMBERED // 2 else 1)
        stay = np.flatnonzero(self.uses[:known] > least)
        counts = self.count[stay]
        self.pool[: counts.sum()] = self.pool[ragged(self.at[stay], counts)]
        self.filled = int(counts.sum())
        self.at[: len(stay)], self.count[: len(stay)], self.uses[: len(stay)] = offsets(counts)[:-1], counts, 1
        self.uses[len(stay) :] = 0
        self.names = [self.names[i] for i in stay.tolist()]
        self.seen = {name: i for i, name in enumerate(self.names) if name is not None}

    @classmethod
    def from_ranks(cls, path: str, pattern: str) -> ByteBpe:
        """A file of lines "base64 rank". Every two tokens whose bytes together are a token merge to it."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        tokens = sorted(ranks, key=ranks.__getitem__)
        number = {t: i for i, t in enumerate(tokens)}
        splits = [(a, b, i) for i, t in enumerate(tokens) for k in range(1, len(t)) if (a := number.get(t[:k])) is not None and (b := number.get(t[k:])) is not None]
        return cls(tokens, np.array([ranks[t] for t in tokens]), pattern, tuple(np.array(splits, np.int32).reshape(-1, 3).T))

    @classmethod
    def from_json(cls, path: str, pattern: str) -> ByteBpe:
        """A tokenizer file with a vocabulary of printable bytes and a list of merges, the earlier the better."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        byte_of, vocabulary = printable_bytes(), model["model"]["vocab"]
        special = {t["content"] for t in model["added_tokens"]}
        plain = lambda token: bytes(byte_of[c] for c in token)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["model"]["merges"]]
        order = dict.fromkeys([*(c for c in byte_of if c in vocabulary), *(a + b for a, b in merges), *(t for t in vocabulary if t not in special)])
        number = {t: i for i, t in enumerate(order)}
        pairs = np.array([(number[a], number[b], number[a + b]) for a, b in merges], np.int32).reshape(-1, 3)
        return cls([plain(t) for t in order], np.array([vocabulary[t] for t in order]), pattern, tuple(pairs.T))

    def _by_heap(self, row: np.ndarray) -> np.ndarray:
        """The leftmost pair of the least rank, again and again, for a long row."""
        n, token = len(row), row.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pairs(row[:-1], row[1:]).tolist()
        heap = [(r, i) for i, r in enumerate(first) if r != NO_PAIR]
        heapq.heapify(heap)
        best = [*first, NO_PAIR]

        def renew(i: int) -> None:
            j = after[i]
            best[i] = int(self.pairs(np.array([token[i]]), np.array([token[j]]))[0]) if j < n else NO_PAIR
            if best[i] != NO_PAIR:
                heapq.heappush(heap, (best[i], i))

        while heap:
            rank, i = heapq.heappop(heap)
            if best[i] != rank:
                continue
            j = after[i]
            token[i], after[i], best[j] = rank, after[j], NO_PAIR
            if after[i] < n:
                before[after[i]] = i
            renew(i)
            if before[i] >= 0:
                renew(before[i])
        out, i = [], 0
        while i < n:
            out.append(token[i])
            i = after[i]
        return np.array(out, np.int32)

    def _by_matrix(self, x: np.ndarray, ranks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Merges the rows of a padded matrix (padding: -1) and yields (rows, their tokens) as they end. It is held by columns:
        x[c] has each row's token c, ranks[c] the rank of its pair (c, c + 1). Each round shortens every row by one token."""
        rows = np.arange(x.shape[1])
        while len(x) > 1:
            best = np.minimum.reduce(ranks * np.int32(WIDEST) + np.arange(len(ranks), dtype=np.int32)[:, None], axis=0)
            least, k = best // WIDEST, best % WIDEST
            ended = least == NO_PAIR
            if ended.any():
                yield rows[ended], x[:, ended].T
                rest = ~ended
                rows, least, k, x, ranks = rows[rest], least[rest], k[rest], x[:, rest], ranks[:, rest]
                if not len(rows):
                    return
            for c in range(1, len(x) - 1):
                np.copyto(x[c], x[c + 1], where=k < c)
            for c in range(len(ranks) - 1):
                np.copyto(ranks[c], ranks[c + 1], where=k <= c)
            every = np.arange(len(rows))
            x[k, every] = least
            x, ranks = x[:-1], ranks[:-1]
            for near in (k - 1, k):
                inside = (near >= 0) & (near < len(ranks))
                c, r = near[inside], every[inside]
                ranks[c, r] = self.pairs(x[c, r], x[c + 1, r])
        yield rows, x.T

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all pieces in a row, and the count of each piece."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw, starts = np.frombuffer(b"".join(pieces), np.uint8), offsets(sizes)
        counts, parts = np.ones(len(pieces), np.int64), []
        width = 2
        whole = np.array([self.rank_of.get(p, -1) for p in pieces], np.int32)
        known = np.flatnonzero(whole >= 0)
        parts.append((known, np.ones(len(known), np.int64), whole[known]))
        open_ = whole < 0
        while width <= WIDEST:
            bucket = np.flatnonzero(open_ & (sizes <= width) & (sizes > width // 2))
            for at in range(0, len(bucket), max(1, CELLS // width)):
                some = bucket[at : at + max(1, CELLS // width)]
                x, first = np.full((width, len(some)), -1, np.int32), np.full((width - 1, len(some)), NO_PAIR, np.int32)
                for c in range(int(sizes[some].max())):
                    longer = np.flatnonzero(sizes[some] > c)
                    here = starts[some[longer]] + c
                    x[c, longer] = self.single[raw[here]]
                    if c:
                        first[c - 1, longer] = self.of_bytes[raw[here - 1], raw[here]]
                for rows, tokens in self._by_matrix(x, first):
                    here = tokens >= 0
                    parts.append((some[rows], here.sum(1), tokens[here]))
            width *= 2
        for i in np.flatnonzero(open_ & (sizes > WIDEST)).tolist():
            tokens = self._by_heap(self.single[raw[starts[i] : starts[i + 1]]])
            parts.append((np.array([i]), np.array([len(tokens)]), tokens))
        for which, n, _ in parts:
            counts[which] = n
        out, places = np.empty(int(counts.sum()), np.int32), offsets(counts)
        for which, n, tokens in parts:
            out[ragged(places[which], n)] = tokens
        return out, counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the count of each text."""
        found = [[t] if _one_word(t) else self.pieces(t) for t in texts]
        tokens, counts = self.merged([p.encode("utf-8", "surrogatepass") for pieces in found for p in pieces])
        of_text = offsets(np.fromiter(map(len, found), np.int64, len(texts)))
        return self.ids[tokens], np.diff(offsets(counts)[of_text])

    def remembered(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks (from chunks_of) in a row, and the count of each chunk."""
        if len(self.names) > REMEMBERED:
            self._forget_rare()
        seen = self.seen
        new = list(set(chunks).difference(seen))
        if new:
            ids, counts = self.encode([c[1:] if c[:1] == "\n" else " " + c for c in new])
            known, filled = len(self.names), self.filled
            while filled + len(ids) > len(self.pool):
                self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
            while known + len(new) > len(self.at):
                self.at, self.count, self.uses = (np.concatenate((a, np.zeros_like(a))) for a in (self.at, self.count, self.uses))
            self.pool[filled : filled + len(ids)] = ids
            self.at[known : known + len(new)], self.count[known : known + len(new)] = filled + offsets(counts)[:-1], counts
            seen.update(zip(new, range(known, known + len(new)), strict=True))
            self.names += new
            self.filled = filled + len(ids)
        numbers = np.fromiter(map(seen.__getitem__, chunks), np.int64, len(chunks))
        self.uses[: len(self.names)] += np.bincount(numbers, minlength=len(self.names))
        counts = self.count[numbers]
        ids = self.pool[ragged(self.at[numbers], counts)]
        for c in [c for c in new if len(c) > LONGEST]:  # they hardly come again
            self.names[seen.pop(c)] = None
        return ids, counts


def printable_bytes() -> dict[str, int]:
    """The usual printable alphabet for bytes: printable Latin-1 stands for itself, the others follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def chunks_of(text: str, leading: str = "") -> list[str]:
    """Cuts leading + text before each single space that stands between characters other than white space. A chunk after the first
    is named without its space, the first with a line feed before it."""
    text = leading + text
    parts = _space_between.split(text) if text[:1].isspace() or text[-1:] == " " or _even(text) else text.split(" ")
    parts[0] = "\n" + parts[0]
    return parts


def stretches(text: str, size: int = STRETCH) -> Iterator[tuple[int, str]]:
    """Cuts a long text where chunks_of() would, at the first such place after each size characters: (0 for the first stretch, else 1; stretch)."""
    at, k = 0, 0
    while len(text) - at > size:
        cut = _space_between.search(text, at + size)
        if not cut:
            break
        yield k, text[at : cut.start()]
        at, k = cut.end(), 1
    yield k, text[at:] if at else text


def batched(texts: list[str | None], leading: str = "") -> Iterator[tuple[list[str], list[tuple[int, int]]]]:
    """Chunks of texts in order, in batches of about AT_ONCE, with (index of the text, count of chunks) for each run. An empty text has none."""
    chunks: list[str] = []
    runs: list[tuple[int, int]] = []
    for i, text in enumerate(texts):
        for k, stretch in stretches(text) if text else ():
            own = chunks_of(stretch, "" if k else leading)
            if k:
                own[0] = own[0][1:]
            for at in range(0, len(own), AT_ONCE):
                some = own[at : at + AT_ONCE]
                chunks += some
                runs.append((i, len(some)))
                if len(chunks) >= AT_ONCE:
                    yield chunks, runs
                    chunks, runs = [], []
    if chunks:
        yield chunks, runs


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> ByteBpe:
    return (ByteBpe.from_json if path.endswith(".json") else ByteBpe.from_ranks)(path, pattern)


def _digests(path: str, pattern: str):
    def run(rows):
        bpe = vocabulary(path, pattern)
        for batch in common.batches(rows):
            n = batch.num_rows
            totals, ids_sha, text_sha = np.zeros(n, np.int64), [hashlib.sha256() for _ in range(n)], [hashlib.sha256() for _ in range(n)]
            for chunks, runs in batched(batch.column(1).to_pylist()):
                ids, counts = bpe.remembered(chunks)
                ends = offsets(counts)[np.cumsum([c for _, c in runs])]
                decimals, decoded = bpe.decimals.gather(ids), bpe.bytes_of.gather(ids)
                of_ids, of_text = offsets(decimals[1]), offsets(decoded[1])
                begin = 0
                for (i, _), end in zip(runs, ends.tolist(), strict=True):
                    skip = int(not totals[i] and end > begin)  # no space before a text's first id
                    ids_sha[i].update(decimals[0][of_ids[begin] + skip : of_ids[end]])
                    text_sha[i].update(decoded[0][of_text[begin] : of_text[end]])
                    totals[i] += end - begin
                    begin = end
            yield common.arrow(_SCHEMA, doc_id=batch.column(0), n_tokens=totals, ids_sha256=[h.hexdigest() for h in ids_sha], decoded_sha256=[h.hexdigest() for h in text_sha])

    return run


def _ids(path: str, pattern: str):
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(rows):
        bpe = vocabulary(path, pattern)
        for batch in common.batches(rows, 64):
            parts: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
            for chunks, runs in batched(batch.column(1).to_pylist()):
                ids, counts = bpe.remembered(chunks)
                ends = offsets(counts)[np.cumsum([c for _, c in runs])].tolist()
                for (i, _), begin, end in zip(runs, [0, *ends], ends, strict=False):
                    parts[i].append(ids[begin:end])
            yield common.arrow(schema, doc_id=batch.column(0), ids=[np.concatenate(p) if p else np.zeros(0, np.int32) for p in parts])

    return run


def _texts(path: str, pattern: str):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(rows):
        bpe = vocabulary(path, pattern)
        for batch in common.batches(rows, 64):
            texts = [None if ids is None else bpe.bytes_of.gather(np.array(ids, np.int64))[0].tobytes().decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield common.arrow(schema, doc_id=batch.column(0), text=texts)

    return run


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids: array<int> of each text."""
    return common.documents_of(docs).mapInArrow(_ids(path, pattern), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text: of the ids that encode() gives; null ids have a null text, bytes that are no UTF-8 become U+FFFD."""
    return encoded.select("doc_id", "ids").mapInArrow(_texts(path, pattern), "doc_id long, text string")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 of the decimal ids joined by a space, decoded_sha256 of the bytes that the ids decode to. No shuffle."""
    return common.documents_of(docs).mapInArrow(_digests(path, pattern), DDL)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
