"""Cross-tokenizer alignment: groups and links between the tokens of two tokenizers over the same bytes.

A two-pointer merge walks the cumulative byte ends of both token sequences: each stretch between one end and the next, of either
side, lies in exactly one token of A and one of B, and every overlapping pair has exactly one such stretch, its link. Where
both sides end together, a group ends. The merge is done on arrays of ends, for many texts in a row at once.

Both tokenizers begin anew at a single space between other characters, so texts are cut into chunks there (byte_bpe.chunks_of), and a
worker remembers the alignment of at most `REMEMBERED` chunks. Groups never cross a chunk, so a document's digest, links and
counts are put together from those of its chunks.

One pass over the documents writes them in blocks of about `BLOCK_LINKS` links, each with the list of its distinct pairs of ids
and their counts; a document has only the places of its pairs in that list. Spark then sums the counts of pairs over all blocks, finds
each B id's highest, joins both back to the blocks' lists, and cogroups lists and documents by block. A pair has one row a block
however often it occurs, so frequent pairs make no large group.

Cases: a null or empty text, and one whose tokens' bytes differ from space + text on either side, has no tokens: zeros and an empty
digest; a very long text is worked on in stretches, and is a block of its own; special tokens' strings are plain text; ties for the
highest count all count as best; repeated rows and null ids are rows of their own; an empty table gives no rows; further columns are
not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, common
from .byte_bpe import Strings, offsets, ragged

#: Links of a block.
BLOCK_LINKS = 4_000_000
#: Distinct chunks that a worker remembers.
REMEMBERED = 300_000

_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
_OUT = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("groups_sha256", pa.string()), ("links", pa.binary()), ("pair_a", pa.list_(pa.int32())), ("pair_b", pa.list_(pa.int32())), ("pair_n", pa.list_(pa.int64()))])
_DDL = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, pair_a array<int>, pair_b array<int>, pair_n array<long>"
_RESULT = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in [*_COUNTS, "n_best", "count_sum"]], ("groups_sha256", pa.string())])
RESULT_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def merged_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two-pointer merge of cumulative ends: for each distinct end of either side, in order, the A token and the B token that
    hold the stretch before it, and whether both end there."""
    # The place of an end of A in the merged order is its own place and the number of ends of B before it; likewise for B.
    of_a = np.searchsorted(ends_b, ends_a, "left")
    both = np.zeros(len(ends_a), bool)
    inside = of_a < len(ends_b)
    both[inside] = ends_b[of_a[inside]] == ends_a[inside]
    alone = np.ones(len(ends_b), bool)
    alone[of_a[both]] = False
    only_b = np.flatnonzero(alone)
    of_b = np.searchsorted(ends_a, ends_b[only_b], "left")
    place_a = np.arange(len(ends_a)) + np.searchsorted(ends_b[only_b], ends_a, "left")
    place_b = np.arange(len(only_b)) + of_b
    n = len(ends_a) + len(only_b)
    a, b, group = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, bool)
    a[place_a], b[place_a], group[place_a] = np.arange(len(ends_a)), of_a, both
    a[place_b], b[place_b] = of_b, only_b
    return a, b, group


class Sides:
    """Both tokenizers: ids of a chunk under each, and the bytes of each id."""

    def __init__(self, path_a: str, pattern: str, path_b: str):
        import sentencepiece

        self.a = byte_bpe.ByteBpe.from_json(path_a, pattern)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        size = self.b.get_piece_size()
        self.bytes_b = Strings([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(size) for p in [self.b.id_to_piece(i)]])
        self.size_b = size
        self.listed = Strings([b"%d," % i for i in range(max(size, len(self.a.bytes_of.lengths)))])
        self.forget()

    def forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.facts = np.zeros((0, 5), np.int64)
        self.links, self.link_at = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.text, self.text_at = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids and counts of both sides, of texts that begin with the space that B adds by itself."""
        ids_a, n_a = self.a.encode(texts)
        lists = self.b.encode([t[1:] for t in texts], num_threads=1)
        n_b = np.fromiter(map(len, lists), np.int64, len(lists))
        ids_b = np.fromiter((i for ids in lists for i in ids), np.int64, int(n_b.sum()))
        return ids_a, n_a, ids_b, n_b

    def align(self, texts: list[str]):
        """Of texts that begin with a space: facts (n_a, n_b, n_groups, n_links, 1 if the bytes fit), then flat keys a * size_b + b of links with
        their counts, and flat bytes of groups with their counts. A text whose bytes don't fit has none."""
        ids_a, n_a, ids_b, n_b = self.tokens(texts)
        of_a, of_b = np.repeat(np.arange(len(texts)), n_a), np.repeat(np.arange(len(texts)), n_b)
        raw_a, long_a = self.a.bytes_of.gather(ids_a)
        raw_b, long_b = self.bytes_b.gather(ids_b)
        wanted = [t.encode("utf-8", "surrogatepass") for t in texts]
        size = np.fromiter(map(len, wanted), np.int64, len(wanted))
        fits = (np.bincount(of_a, long_a, len(texts)) == size) & (np.bincount(of_b, long_b, len(texts)) == size)
        if not (fits.all() and raw_a.tobytes() == raw_b.tobytes() == b"".join(wanted)):
            ends = [offsets(np.bincount(o, n, len(texts)).astype(np.int64)) for o, n in ((of_a, long_a), (of_b, long_b))]
            for i in np.flatnonzero(fits).tolist():
                fits[i] = all(raw[e[i] : e[i + 1]].tobytes() == wanted[i] for raw, e in ((raw_a, ends[0]), (raw_b, ends[1])))
            in_a, in_b = fits[of_a], fits[of_b]
            ids_a, long_a, of_a, ids_b, long_b, of_b = ids_a[in_a], long_a[in_a], of_a[in_a], ids_b[in_b], long_b[in_b], of_b[in_b]
        a, b, ends = merged_ends(np.cumsum(long_a), np.cumsum(long_b))
        keys, link_of = ids_a[a].astype(np.int64) * self.size_b + ids_b[b], of_a[a]
        # A group's A tokens come first, then its B tokens. The group of a token is the number of group ends before it.
        before = np.cumsum(ends) - ends
        group_a, group_b = np.empty(len(ids_a), np.int64), np.empty(len(ids_b), np.int64)
        group_a[a], group_b[b] = before, before
        groups = int(ends.sum())
        size_a, size_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        place_a = np.arange(len(ids_a)) + offsets(size_b)[group_a]
        place_b = np.arange(len(ids_b)) + offsets(size_a)[group_b + 1]
        order, mark = np.empty(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
        order[place_a], order[place_b] = ids_a, ids_b
        mark[place_a[np.cumsum(size_a) - 1]], mark[place_b[np.cumsum(size_b) - 1]] = ord("|"), ord(";")
        text, long_text = self.listed.gather(order)
        if len(text):
            text[np.cumsum(long_text) - 1] = mark
        of_text = np.empty(len(order), np.int64)
        of_text[place_a], of_text[place_b] = of_a, of_b
        n = len(texts)
        facts = np.stack([np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n), np.bincount(link_of[ends], minlength=n), np.bincount(link_of, minlength=n), fits], axis=1).astype(np.int64)
        return facts, keys, facts[:, 3], text, np.bincount(of_text, long_text, n).astype(np.int64)

    def remembered(self, chunks: list[str]) -> np.ndarray:
        """The numbers under which facts, links and text of these chunks are held until the next call."""
        if len(self.facts) > REMEMBERED:
            self.forget()
        seen = self.seen
        new = list(set(chunks).difference(seen))
        if new:
            facts, keys, n_keys, text, n_text = self.align([c[1:] if c[:1] == "\n" else " " + c for c in new])
            seen.update(zip(new, range(len(self.facts), len(self.facts) + len(new)), strict=True))
            self.facts = np.concatenate((self.facts, facts))
            self.links, self.link_at = np.concatenate((self.links, keys)), np.concatenate((self.link_at, self.link_at[-1] + np.cumsum(n_keys)))
            self.text, self.text_at = np.concatenate((self.text, text)), np.concatenate((self.text_at, self.text_at[-1] + np.cumsum(n_text)))
        numbers = np.fromiter(map(seen.__getitem__, chunks), np.int64, len(chunks))
        for c in [c for c in new if len(c) > byte_bpe.LONGEST]:
            del seen[c]
        return numbers


@lru_cache(maxsize=1)
def _sides(path_a: str, pattern: str, path_b: str) -> Sides:
    return Sides(path_a, pattern, path_b)


class _Document:
    """What is known so far of a document whose chunks arrive in order."""

    def __init__(self):
        self.facts, self.sha, self.last = np.zeros(4, np.int64), hashlib.sha256(), b""
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.fits = True

    def add(self, facts: np.ndarray, keys: np.ndarray, text: np.ndarray) -> None:
        self.fits &= bool(facts[:, 4].all())
        if not self.fits:
            self.facts[:], self.keys, self.counts = 0, [], []
            return
        self.facts += facts[:, :4].sum(0)
        self.sha.update(self.last)
        self.sha.update(text[:-1])
        self.last = text[-1:].tobytes()  # the last group's end mark isn't hashed
        distinct, counts = np.unique(keys, return_counts=True)
        self.keys.append(distinct)
        self.counts.append(counts)
        if len(self.keys) > 16:
            self.keys, self.counts = ([x] for x in self.links())

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) == 1:
            return self.keys[0], self.counts[0]
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        return keys, np.bincount(at, np.concatenate(self.counts), len(keys)).astype(np.int64)

    def digest(self) -> str:
        return self.sha.hexdigest() if self.fits and self.facts[0] else ""


def _whole(sides: Sides, text: str) -> _Document:
    """A text of whose chunks some don't fit: judged as a whole, as the contract has it."""
    out = _Document()
    facts, keys, _, groups, _ = sides.align([" " + text])
    out.add(facts, keys, groups)
    return out


def _align(path_a: str, pattern: str, path_b: str, block_links: int):
    def close(block: int, ids: list, documents: list[_Document], size_b: int):
        pack, links = zstandard.ZstdCompressor(level=1).compress, [d.links() for d in documents]
        flat, counts = np.concatenate([k for k, _ in links]), np.concatenate([c for _, c in links])
        pairs, at = np.unique(flat, return_inverse=True)
        n = np.bincount(at, counts, len(pairs)).astype(np.int64)
        ends = offsets(np.array([len(k) for k, _ in links]))
        packed = [pack(np.concatenate((np.diff(at[s:e], prepend=0), counts[s:e])).astype("<i4").tobytes()) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        rows, none = len(ids), [None] * len(ids)
        facts = np.stack([d.facts for d in documents])
        for s in range(0, rows, 256):
            part = slice(s, s + 256)
            some = {c: facts[part, k] for k, c in enumerate(_COUNTS)}
            yield common.arrow(_OUT, block=[block] * len(ids[part]), doc_id=ids[part], groups_sha256=[d.digest() for d in documents[part]], links=packed[part], pair_a=none[part], pair_b=none[part], pair_n=none[part], **some)
        if len(pairs):
            yield common.arrow(_OUT, block=[block], doc_id=[None], groups_sha256=[None], links=[None], pair_a=[pairs // size_b], pair_b=[pairs % size_b], pair_n=[n], **{c: [None] for c in _COUNTS})

    def run(rows):
        sides = _sides(path_a, pattern, path_b)
        block, ids, documents, filled = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in common.batches(rows, 128):
            texts = batch.column(1).to_pylist()
            own = [_Document() for _ in texts]
            for chunks, runs in byte_bpe.batched(texts, " "):
                numbers = sides.remembered(chunks)
                facts, (n_keys, n_text) = sides.facts[numbers], (np.diff(at)[numbers] for at in (sides.link_at, sides.text_at))
                keys, text = sides.links[ragged(sides.link_at[numbers], n_keys)], sides.text[ragged(sides.text_at[numbers], n_text)]
                of_keys, of_text, begin = offsets(n_keys), offsets(n_text), 0
                for i, count in runs:
                    end = begin + count
                    own[i].add(facts[begin:end], keys[of_keys[begin] : of_keys[end]], text[of_text[begin] : of_text[end]])
                    begin = end
            own = [d if d.fits else _whole(sides, t) for d, t in zip(own, texts, strict=True)]
            for i, d in zip(batch.column(0).to_pylist(), own, strict=True):
                ids.append(i)
                documents.append(d)
                filled += int(d.facts[3]) + 100
                if filled >= block_links:
                    yield from close(block, ids, documents, sides.size_b)
                    block, ids, documents, filled = block + 1, [], [], 0
        if ids:
            yield from close(block, ids, documents, sides.size_b)

    return run


def _sums(documents: pa.Table, pairs: pa.Table) -> pa.Table:
    """Of one block: what its documents' links count. pairs: place, count, best."""
    place = pairs.column("place").to_numpy()
    count, best = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
    count[place], best[place] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy()
    unpack, n_best, count_sum = zstandard.ZstdDecompressor().decompress, [], []
    for packed in documents.column("links").to_pylist():
        flat = np.frombuffer(unpack(packed), "<i4").astype(np.int64)
        at, n = np.cumsum(flat[: len(flat) // 2]), flat[len(flat) // 2 :]
        n_best.append(int(n[best[at]].sum()))
        count_sum.append(int((n * count[at]).sum()))
    columns = {c: documents.column(c) for c in ["doc_id", *_COUNTS, "groups_sha256"]} | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
    return pa.table({f.name: columns[f.name] for f in _RESULT})


def align(docs: DataFrame, path_a: str, pattern: str, path_b: str, block_links: int = BLOCK_LINKS) -> tuple[DataFrame, DataFrame]:
    """Documents by block (block, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links) and the blocks' pairs (block, place, a, b, n)."""
    held = common.materialize(common.documents_of(docs).mapInArrow(_align(path_a, pattern, path_b, block_links), _DDL), "aligned")
    lists = held.where("pair_a IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("place", "p"))
    pairs = lists.select("block", "place", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"), F.col("p.pair_n").alias("n"))
    return held.where("links IS NOT NULL").select("block", "doc_id", *_COUNTS, "groups_sha256", "links"), pairs


def pair_counts(pairs: DataFrame) -> DataFrame:
    """a, b, count over all documents, best: whether it is b's highest."""
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    counts = common.materialize(counts, "pair-counts")
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    return counts.join(highest, "b").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))


def aligned(docs: DataFrame, path_a: str, pattern: str, path_b: str, block_links: int = BLOCK_LINKS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document."""
    documents, pairs = align(docs, path_a, pattern, path_b, block_links)
    back = pairs.join(pair_counts(pairs), ["a", "b"]).select(F.col("block").alias("of_block"), "place", "count", "best")
    return documents.groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(_sums, RESULT_DDL)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return aligned(common.table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.json"), public.PATTERN, public.path("piece_bpe_32k.model"))
