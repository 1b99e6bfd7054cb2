"""Benchmark decontamination by spaced-seed hashing.

Fixed masks select some tokens of a window and ignore the others, so a seed survives substitutions in the ignored places; together the masks
hit every run that makes a leak. Seeds of the
benchmark and of the documents meet by hash; around each hit the two texts are laid on the hit's diagonal and all runs of
agreeing tokens are tried, substitutions allowed. An item is leaked into a document if a run agrees in 13 tokens (all of a shorter
item's share) and in at least 0.8 of its length.

The benchmark is the stated query set: its seeds are compiled into files of bounded size, which the tasks that read the documents map into
memory, so no document moves and no hot passage meets in one task. Each document is read and hashed once, however many files there are.
Hits are looked up and tried in portions of bounded size, so texts that repeat a word or a passage take time but no more memory.

Odd input: null texts are empty and match nothing; items under 5 tokens match nothing; repeated documents and items are matched each;
a null doc_id is kept; other columns are ignored; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from .shared import id_and_text, local_file, published

#: The mask of all items, the masks that items too short for AGREE have besides (1: the token counts), and the least item.
#: Every leak is hit. A run of m differing tokens without four agreeing ones in a row agrees in 3 * (m + 1) at most and needs 4 * m, so m is
#: 3 at most and the run agrees in 12, which is under AGREE; what is left are short items (a test enumerates them).
SOLID = "1111"
MASKS = ("11011", "10111", "11101")
LEAST = 5
#: Agreeing tokens that make a leak, the share of the run that must agree, tokens of a block of benchmark items.
AGREE, SHARE, BLOCK_TOKENS = 13, 0.8, 1 << 18
#: Agreeing tokens that make up for one that differs, at the least share.
COST = round(SHARE / (1 - SHARE))
#: Hits, and places of laid-out diagonals, that a task holds at once.
HITS = 1 << 20
_TOKEN = re.compile(r"\w+")
_TABLE_BITS = 22


def token_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the lower-case words."""
    words = _TOKEN.findall(text.lower())
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def seeds(tokens: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the mask's tokens at each place where the whole mask fits."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, int(mask, 2), np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            out = (out ^ tokens[k : k + n]) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
            out ^= out >> np.uint64(29)
    return out


def best_run(same: np.ndarray) -> tuple[int, int, int]:
    """Start, end and agreeing places of the run with the most agreeing places among all runs that agree in SHARE of their length; of equal
    ones the shortest. It starts and ends with an agreeing place.

    Each agreeing place adds one and each other takes COST, so a run has its share if the sum over it isn't negative; for each end the first
    start from which it isn't is found among the least sums so far."""
    ends = np.flatnonzero(same) + 1
    if not len(ends):
        return 0, 0, 0
    gain = np.concatenate(([0], np.cumsum(np.where(same, 1, -COST))))
    start = np.searchsorted(-np.minimum.accumulate(gain), -gain[ends], "left")
    first = np.searchsorted(ends, start, "right")  # agreeing places before the start
    agree = np.arange(1, len(ends) + 1) - first
    start = ends[first] - 1
    best = int(np.lexsort((ends - start, -agree))[0])
    return int(start[best]), int(ends[best]), int(agree[best])


def _most_agreeing(same: np.ndarray) -> np.ndarray:
    """How many places the best run of each row agrees in, all rows at once (see `best_run`)."""
    n, width = same.shape
    gain, agree = np.zeros((n, width + 1), np.int32), np.zeros((n, width + 1), np.int32)
    np.cumsum(np.where(same, 1, -COST), axis=1, out=gain[:, 1:])
    np.cumsum(same, axis=1, out=agree[:, 1:])
    low = np.minimum.accumulate(gain, axis=1)
    # the least sums so far descend along a row; shifted into a range of numbers of its own, all rows are searched as one sorted array
    shift = np.arange(n, dtype=np.int64)[:, None] * (2 * (COST + 1) * (width + 2))
    start = np.searchsorted((shift - low).ravel(), (shift - gain[:, 1:]).ravel(), "left").reshape(n, width) - np.arange(n)[:, None] * (width + 1)
    return np.where(same, agree[:, 1:] - np.take_along_axis(agree, start, axis=1), 0).max(axis=1)


class Benchmark:
    """A block of items with its seeds, in flat arrays."""

    #: Arrays of a block's file, in order; those of the tables follow.
    HEAD = ("ids", "n", "begin", "tokens")
    TABLE = ("hash", "item", "at", "seen")

    def __init__(self, items: list[tuple[int, np.ndarray]]) -> None:
        self.ids = np.array([i for i, _ in items], np.int64)
        self.n = np.array([len(t) for _, t in items], np.int64)
        self.begin = np.cumsum(self.n) - self.n
        self.tokens = np.concatenate([t for _, t in items]) if items else np.zeros(0, np.uint64)
        self.tables = []
        for mask in (SOLID, *MASKS):
            h, item, at = [], [], []
            for k, (_, t) in enumerate(items):
                if mask != SOLID and SHARE * len(t) >= AGREE:
                    continue
                s = seeds(t, mask)
                h.append(s)
                item.append(np.full(len(s), k))
                at.append(np.arange(len(s)))
            if not h or not sum(map(len, h)):
                continue
            h, item, at = np.concatenate(h), np.concatenate(item), np.concatenate(at)
            order = np.argsort(h, kind="stable")
            seen = np.zeros(1 << _TABLE_BITS, bool)
            seen[self.slot(h)] = True
            self.tables.append((mask, h[order], item[order], at[order], np.packbits(seen)))

    def to_bytes(self) -> bytes:
        """The block as a file: a list of its arrays, then the arrays."""
        parts = [getattr(self, k) for k in self.HEAD] + [x for t in self.tables for x in t[1:]]
        head = json.dumps({"masks": [t[0] for t in self.tables], "arrays": [(x.dtype.str, len(x)) for x in parts]}).encode()
        head += b" " * (-len(head) % 8)
        return struct.pack("<Q", len(head)) + head + b"".join(x.tobytes() + bytes(-x.nbytes % 8) for x in parts)

    @classmethod
    def mapped(cls, file: str) -> Benchmark:
        """A block whose arrays lie in a mapped file."""
        raw = np.memmap(file, np.uint8, "r")
        (size,) = struct.unpack("<Q", bytes(raw[:8]))
        about, place = json.loads(bytes(raw[8 : 8 + size])), 8 + size
        got = []
        for kind, n in about["arrays"]:
            nbytes = n * np.dtype(kind).itemsize
            got.append(raw[place : place + nbytes].view(kind))
            place += nbytes + -nbytes % 8
        out = cls.__new__(cls)
        for k, x in zip(cls.HEAD, got):
            setattr(out, k, x)
        rest, step = got[len(cls.HEAD) :], len(cls.TABLE)
        out.tables = [(m, *rest[k * step : (k + 1) * step]) for k, m in enumerate(about["masks"])]
        return out

    @staticmethod
    def slot(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def leaks(self, tokens: np.ndarray, most: int = HITS) -> list[tuple[int, int, int, int]]:
        """(item_id, agreeing tokens, first token in the document, tokens of the run) of each item leaked into the document; `most`: hits
        that are held at once, about."""
        best: dict[int, tuple[int, int, int]] = {}
        whole = np.zeros(len(self.ids), bool)  # items found in full: nothing more can be found of them
        for mask, h, item, at, seen in self.tables:
            s = seeds(tokens, mask)
            slot = self.slot(s)
            maybe = np.flatnonzero((seen[slot >> 3] >> (7 - (slot & 7))) & 1)
            if not len(maybe):
                continue
            lo, hi = np.searchsorted(h, s[maybe], "left"), np.searchsorted(h, s[maybe], "right")
            n = hi - lo
            some = n > 0
            lo, n, maybe = lo[some], n[some], maybe[some]
            portion = np.cumsum(n) // most
            for part in np.split(np.arange(len(n)), np.flatnonzero(np.diff(portion)) + 1) if len(n) else ():
                k = np.repeat(lo[part], n[part]) + np.arange(int(n[part].sum())) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
                hit, diagonal = item[k], np.repeat(maybe[part], n[part]) - at[k]
                if whole.any():
                    open_ = ~whole[hit]
                    hit, diagonal = hit[open_], diagonal[open_]
                if len(hit):
                    self._try(tokens, hit, diagonal, best, whole)
        return [(int(self.ids[k]), *v) for k, v in sorted(best.items())]

    def _try(self, tokens: np.ndarray, hit: np.ndarray, diagonal: np.ndarray, best: dict, whole: np.ndarray) -> None:
        """Lay the items of the hits on their diagonals and keep the best run of each item."""
        both = np.unique(np.stack((hit, diagonal), axis=1), axis=0)
        first = np.flatnonzero(np.append(True, both[1:, 0] != both[:-1, 0]))
        for a, b in zip(first, [*first[1:], len(both)]):
            k = int(both[a, 0])
            t = self.tokens[self.begin[k] : self.begin[k] + self.n[k]]
            need = min(AGREE, SHARE * len(t))
            d = both[a:b, 1]
            if b - a == 1:
                lo, hi = max(0, -int(d[0])), min(len(t), len(tokens) - int(d[0]))
                found = [(int(d[0]) + lo + s, e - s, g) for s, e, g in [best_run(tokens[d[0] + lo : d[0] + hi] == t[lo:hi])]]
            else:
                found = []
                step = max(1, HITS // len(t))
                for x in range(0, len(d), step):
                    place = d[x : x + step, None] + np.arange(len(t))[None, :]
                    inside = (place >= 0) & (place < len(tokens))
                    same = (tokens[np.clip(place, 0, len(tokens) - 1)] == t[None, :]) & inside
                    top = int(_most_agreeing(same).argmax())
                    s, e, g = best_run(same[top])
                    found.append((int(d[x + top]) + s, e - s, g))
            start, length, agree = max(found, key=lambda f: f[2])
            if agree >= need and agree > best.get(k, (0,))[0]:
                best[k] = agree, start, length
                whole[k] = agree == len(t)


def blocks(benchmark: DataFrame, block_tokens: int = BLOCK_TOKENS) -> Iterator[Benchmark]:
    """The items in blocks of about `block_tokens` tokens, one after the other; one block at a time is in the driver."""
    held: list = []
    size = 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit(""))).where("item_id is not null").toLocalIterator():
        if len(t := token_hashes(r[1])) >= LEAST:
            held.append((r[0], t))
            size += len(t)
        if size >= block_tokens:
            yield Benchmark(held)
            held, size = [], 0
    if held:
        yield Benchmark(held)


def publish(benchmark: DataFrame, block_tokens: int = BLOCK_TOKENS) -> list[str]:
    """Compile the benchmark into files that all tasks can map; their names."""
    return [published(benchmark.sparkSession, b.to_bytes(), "benchmark") for b in blocks(benchmark, block_tokens)]


_mapped: dict[str, Benchmark] = {}


def _block(name: str) -> Benchmark:
    if name not in _mapped:
        if len(_mapped) > 4096:  # other tables' benchmarks
            _mapped.clear()
        _mapped[name] = Benchmark.mapped(local_file(name))
    return _mapped[name]


def leaks(docs: DataFrame, benchmark: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, item_id, agree, first_token, run_tokens: one row for each document and item leaked into it. One pass over the documents."""
    names = publish(benchmark, block_tokens)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"]):
                tokens = token_hashes(text)
                rows += [(doc_id, *x) for name in names for x in _block(name).leaks(tokens)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "agree", "first_token", "run_tokens"]).astype({"doc_id": "Int64", "item_id": "int64", "agree": "int32", "first_token": "int32", "run_tokens": "int32"})

    return id_and_text(docs).mapInPandas(run, "doc_id long, item_id long, agree int, first_token int, run_tokens int")


def decontaminated(docs: DataFrame, benchmark: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The documents into which no item leaked, all columns kept. Each row is judged by its own text where it lies, so no text moves between
    tasks and rows that share a doc_id, or have none, are told apart."""
    at = docs.columns.index("text")
    names = publish(benchmark, block_tokens)

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            clean = []
            for text in batch.column(at).to_pylist():
                tokens = token_hashes(text or "")
                clean.append(not any(_block(name).leaks(tokens) for name in names))
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema) if names else docs
