"""Token-ID output: grammar-compressed shards of token ids (Re-Pair), with random access to each document.

A block holds the ids of consecutive documents. Frequent adjacent id pairs are replaced by nonterminals, round after round; the block
stores the rules, the expansion length of each nonterminal and a directory of its documents, so that one document is decoded without the rest.

Layout of a block, little-endian: magic `RPG2`, u32 base (ids at or above it are nonterminals), u32 rules, u32 symbols, u32 documents, u64
start (ids before it in its part); then columns, each a u8 width and its numbers in so many bits: the rules' left and right symbols, their
expansion lengths, the documents' symbols and ids, whether a document has a doc_id, the symbols. The doc_ids are i64, between the last two.
No rule spans two documents, so each document is a run of whole symbols.

Odd input: a null text is an empty one; an empty text has the end id alone; a null doc_id sorts first and is kept as null;
repeated rows are separate documents, in the order of their text; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import chain
from operator import attrgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import bpe
from .shared import id_and_text, stored

#: Ids in a block, about: it bounds the memory of a task. A block has one document at least.
BLOCK_IDS = 1 << 20
#: The least count of a pair that is replaced, and the least number of its replacements in a round that pays for a rule.
LEAST, WORTH = 12, 4


_encoders: dict[str, bpe.PieceEncoder] = {}


def encoder(path: str) -> bpe.PieceEncoder:
    """Encoder over the tokenizers library, one per process."""
    if path not in _encoders:
        lib = bpe.library(path)
        letter = {b: c for c, b in bpe.byte_letters().items()}
        piece, token_id = lib.model.tokenize, attrgetter("id")

        def learn(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            # a piece is what the library's splitter hands to its model: bytes written as letters
            written = "\0".join(words).replace(" ", letter[32]).split("\0") if words else []
            for k in [k for k, w in enumerate(words) if not (w.isascii() and w.isprintable())]:
                written[k] = "".join(map(letter.__getitem__, words[k].encode()))
            got = list(map(piece, written))
            n = np.fromiter(map(len, got), np.int64, len(got))
            return np.fromiter(map(token_id, chain.from_iterable(got)), np.uint32, int(n.sum())), n

        _encoders[path] = bpe.PieceEncoder(path, learn, lambda t: lib.encode_batch_fast([t], add_special_tokens=False)[0].ids, limit=2_000_000)
    return _encoders[path]


def _grouped(seq: np.ndarray, place: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of symbols (up to `top`) that begin at the places, in order, and the places in the same order."""
    wide, deep = np.uint64(top.bit_length()), np.uint64(len(seq).bit_length())
    pairs = seq[place].astype(np.uint64) << wide | seq[place + 1]
    if 2 * int(wide) + int(deep) > 64:
        order = np.argsort(pairs, kind="stable")
        return pairs[order], place[order]
    both = np.sort(pairs << deep | place.astype(np.uint64))  # a pair and its place fit one number
    return both >> deep, (both & ((np.uint64(1) << deep) - np.uint64(1))).astype(np.int64)


def compress(seq: np.ndarray, ends: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, where each document ends among them, and the rules (pairs of symbols). Pairs within a document alone are replaced, round
    after round until no pair is left that occurs LEAST times.

    Counts are exact: places are sorted by their pair. A pair of old symbols never gains occurrences, so after the first round only pairs that
    were frequent and those beside a new symbol are looked at. The most frequent pair of a round loses no overlap to another one, so each round
    has a pair that is worth a rule and the rounds end."""
    seq, rules, count = seq.astype(np.uint32), [], 0
    active = np.ones(len(seq), bool)  # places whose pair may be frequent
    while len(seq) > LEAST:
        last = ends - 1
        active[last[last >= 0]] = False
        active[-1] = False
        top = base + count
        pairs, place = _grouped(seq, np.flatnonzero(active), top)
        first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(pairs)))
        often = n >= LEAST
        good, none = pairs[first[often]], int(often.sum())
        if not none:
            break
        order = np.argsort(-n[often], kind="stable")  # most frequent first
        # each place's pair as its rank, `none` where it isn't frequent
        rank_of = np.full(len(n), none, np.int32)
        rank_of[np.flatnonzero(often)[order]] = np.arange(none)
        rank = np.full(len(seq) + 1, none, np.int32)  # the last one stands for what is beside the ends
        rank[place] = np.repeat(rank_of, n)
        wide = np.uint64(top.bit_length())
        left, right = (good[order] >> wide).astype(np.uint32), (good[order] & ((np.uint64(1) << wide) - np.uint64(1))).astype(np.uint32)
        # where chosen pairs overlap the more frequent wins; runs of one pair (aaaa) are taken from the left
        r, after = rank[:-1], rank[1:]
        active = r < none
        fits = active & (r <= after)
        fits[1:] &= r[1:] <= r[:-1]
        where = np.flatnonzero(fits)
        same = r[where] == rank[where - 1]  # place 0 is compared with the last one
        r = r[where]
        if same.any():
            start = np.maximum.accumulate(np.where(~same, where, 0))
            even = (where - start) % 2 == 0
            where, r = where[even], r[even]
            apart = np.append(True, np.diff(where) > 1)
            where, r = where[apart], r[apart]
        number = np.bincount(r, minlength=none)
        worth = number >= WORTH
        taken = np.flatnonzero(worth[r])
        where, r = where[taken], r[taken]
        used = np.flatnonzero(worth)
        number[used] = base + count + np.arange(len(used))
        seq[where] = number[r]
        rules.append(np.stack((left[used], right[used]), axis=1))
        count += len(used)
        keep = np.ones(len(seq), bool)
        keep[where + 1] = False
        keep = np.flatnonzero(keep)
        seq, active = seq[keep], active[keep]
        ends = ends - np.searchsorted(where + 1, ends)
        new = where - np.arange(len(where))
        active[new] = True
        active[np.maximum(new - 1, 0)] = True
    return seq, ends, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def levels(rules: np.ndarray, base: int) -> Iterator[tuple[int, int]]:
    """Ranges of rules that refer to earlier ranges alone."""
    top, lo = rules.max(axis=1) if len(rules) else np.zeros(0, np.uint32), 0
    while lo < len(rules):
        late = np.flatnonzero(top[lo:] >= base + lo)
        hi = lo + int(late[0]) if len(late) else len(rules)
        if hi == lo:
            raise ValueError("a rule refers to itself or a later one")
        yield lo, hi
        lo = hi


def _lanes(width: int) -> Iterator[tuple[int, int, int]]:
    """Eight numbers fill `width` bytes, high bits first: which number has bits in which byte, and how far right it is shifted for it."""
    for j in range(8):
        for k in range(j * width // 8, ((j + 1) * width + 7) // 8):
            yield j, k, (j + 1) * width - 8 * (k + 1)


def packed(numbers: np.ndarray) -> bytes:
    """A column: the width in bits of its largest number, then all in that width."""
    n = len(numbers)
    width = int(numbers.max()).bit_length() if n else 0
    lane = np.zeros((8, (n + 7) // 8), np.uint32)
    for j in range(8):
        lane[j, : (n + 7 - j) // 8] = numbers[j::8]
    out = np.zeros((width, lane.shape[1]), np.uint8)
    for j, k, right in _lanes(width):
        out[k] |= (lane[j] >> np.uint32(right) if right >= 0 else lane[j] << np.uint32(-right)).astype(np.uint8)
    return bytes([width]) + out.T.tobytes()[: (n * width + 7) // 8]


def unpacked(data: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    """The n numbers of a column, and where it ends."""
    width, at = data[at], at + 1
    out = np.zeros(n, np.uint32)
    end = at + (n * width + 7) // 8
    raw = np.frombuffer(data, np.uint8, end - at, at)
    if width:
        raw = np.append(raw, np.zeros(-len(raw) % width, np.uint8)).reshape(-1, width).T.astype(np.uint32)
        lane = np.zeros((8, raw.shape[1]), np.uint32)
        for j, k, right in _lanes(width):
            lane[j] |= raw[k] << np.uint32(right) if right >= 0 else raw[k] >> np.uint32(-right)
        lane &= np.uint32((1 << width) - 1)
        for j in range(8):
            out[j::8] = lane[j, : (n + 7 - j) // 8]
    return out, end


def pack(ids: list[np.ndarray], doc_ids: list[int | None], start: int, vocab: int) -> bytes:
    """A block of documents; `start`: ids before its first document in the partition."""
    n = np.array([len(x) for x in ids], np.uint32)
    seq = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    if len(seq) and int(seq.max()) >= vocab:
        raise ValueError("an id lies outside the vocabulary")
    seq, ends, rules = compress(seq, np.cumsum(n, dtype=np.int64), vocab)
    length = np.ones(vocab + len(rules), np.uint32)
    for lo, hi in levels(rules, vocab):
        length[vocab + lo : vocab + hi] = length[rules[lo:hi, 0]] + length[rules[lo:hi, 1]]
    head = b"RPG2" + struct.pack("<4IQ", vocab, len(rules), len(seq), len(n), start)
    known = np.array([d is not None for d in doc_ids], np.uint32)
    keys = np.array([0 if d is None else d for d in doc_ids], np.int64)
    return b"".join([head, packed(rules[:, 0]), packed(rules[:, 1]), packed(length[vocab:]), packed(np.diff(ends, prepend=0)), packed(n), packed(known), keys.tobytes(), packed(seq)])


class Block:
    """Reader of a block."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != b"RPG2":
            raise ValueError("not a block of token ids")
        self.base, rules, symbols, docs, start = struct.unpack_from("<4IQ", data, 4)
        left, at = unpacked(data, 28, rules)
        right, at = unpacked(data, at, rules)
        self.rules = np.stack((left, right), axis=1)
        self.length, at = unpacked(data, at, rules)
        runs, at = unpacked(data, at, docs)
        self.n, at = unpacked(data, at, docs)
        known, at = unpacked(data, at, docs)
        self.known = known.astype(bool)
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.symbols, _ = unpacked(data, at + 8 * docs, symbols)
        self.first = np.cumsum(runs, dtype=np.int64) - runs
        self.start = start + np.cumsum(self.n, dtype=np.int64) - self.n
        self._flat = None

    def _expanded(self) -> tuple[np.ndarray, np.ndarray]:
        """All expansions one after the other, and where each begins. Rules refer to earlier ones only."""
        if self._flat is None:
            begin = np.concatenate(([0], np.cumsum(self.length, dtype=np.int64)))
            flat = np.zeros(begin[-1], np.uint32)
            self._flat = flat, begin[:-1]
            for lo, hi in levels(self.rules, self.base):
                flat[begin[lo] : begin[hi]] = self.expand(self.rules[lo:hi].ravel())
        return self._flat

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, begin = self._expanded()
        rule = symbols >= self.base
        n = np.ones(len(symbols), np.int64)
        n[rule] = self.length[symbols[rule] - self.base]
        end = np.cumsum(n)
        out = np.empty(int(end[-1]) if len(end) else 0, np.uint32)
        out[(end - n)[~rule]] = symbols[~rule]
        if rule.any():
            m = n[rule]
            step = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            out[np.repeat((end - n)[rule], m) + step] = flat[np.repeat(begin[symbols[rule] - self.base], m) + step]
        return out

    def document(self, k: int) -> np.ndarray:
        """Ids of one document, decoded alone."""
        stop = self.first[k + 1] if k + 1 < len(self.first) else len(self.symbols)
        return self.expand(self.symbols[self.first[k] : stop])

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        ids, at = self.expand(self.symbols), 0
        for doc_id, known, start, n in zip(self.doc_ids.tolist(), self.known.tolist(), self.start.tolist(), self.n.tolist()):
            yield doc_id if known else None, start, ids[at : at + n]
            at += n


def write_blocks(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, partitions: int | None = None) -> DataFrame:
    """Blocks of all documents in ascending doc_id, as a table in the shared folder: part (range of doc_id, ascending), seq, ids, block.

    One range exchange of the texts by doc_id; each partition is sorted, encoded and packed block by block, so memory follows BLOCK_IDS."""
    spark = docs.sparkSession
    path = tokenizer or bpe.default_path()
    text = id_and_text(docs)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = text.withColumn("part", _part(text.select("doc_id"), n))

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, vocab = encoder(path), bpe.vocabulary(path).size
        ids: list = []
        keys: list = []
        part = -1
        start = size = seq = 0

        def block() -> pd.DataFrame:
            return pd.DataFrame({"part": [part], "seq": [seq], "ids": [size], "block": [pack(ids, keys, start, vocab)]})

        for pdf in batches:
            for here, of_part in pdf.groupby("part", sort=True):
                if here != part:
                    if ids:
                        yield block()
                    part, start, seq, size, ids, keys = int(here), 0, 0, 0, [], []
                texts = of_part["text"].tolist()
                keyed = [None if pd.isna(x) else int(x) for x in of_part["doc_id"]]
                for at in range(0, len(texts), 256):
                    for key, got in zip(keyed[at : at + 256], enc.batch(texts[at : at + 256])):
                        ids.append(np.append(got, np.uint32(end_id)))
                        keys.append(key)
                        size += len(ids[-1])
                        if size >= BLOCK_IDS:
                            yield block()
                            start, seq, size, ids, keys = start + size, seq + 1, 0, [], []
        if ids:
            yield block()

    ordered = dealt.repartitionById(n, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "text")
    return stored(ordered.mapInPandas(blocks, "part int, seq int, ids long, block binary"), "repair")


def _part(keys: DataFrame, n: int):
    """Column: which of n ranges of doc_id a row falls in. The bounds come from the ids alone (a range exchange would sample whole rows),
    as a summary of fixed size; a binary search in them finds the range. Rows without doc_id come first."""
    bounds = sorted({min(int(b), (1 << 63) - 1) for b in keys.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.1 / n)}) if n > 1 else []
    if not bounds:
        return F.lit(0)
    steps, listed = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)], F.array(*map(F.lit, bounds))
    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(F.get(listed, at + s - 1) < F.col("doc_id"), at + s).otherwise(at))
    return F.coalesce(found, F.lit(0))


def read_documents(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from stored blocks. One number a partition (their totals) comes to the driver."""
    total = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("ids").alias("n")).collect()}
    before, running = {}, 0
    for part in sorted(total):
        before[part] = running
        running += total[part]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, data in zip(pdf["part"].tolist(), pdf["block"]):
                b = Block(bytes(data))
                crc = np.fromiter((zlib.crc32(x) for _, _, x in b.documents()), np.int64, len(b.n))
                key = pd.arrays.IntegerArray(b.doc_ids.astype(np.int64), ~b.known)
                yield pd.DataFrame({"doc_id": key, "start": b.start + before[part], "n_tokens": b.n.astype(np.int64), "ids_crc32": crc})

    return blocks.select("part", "block").mapInPandas(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    return read_documents(write_blocks(docs, tokenizer, end_id))
