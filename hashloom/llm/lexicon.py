"""BPE encoding and decoding through a minimal acyclic transducer lexicon.

Frequent words (pieces) of the whole corpus are compiled into a minimal acyclic automaton that shares suffixes. Each edge carries an
output, the number of words that sort before those behind it; their sum along a path is the word's number, which leads to its ids. The
file is memory-mapped, one copy per executor. Words outside it are merged exactly, so the ids never depend on what the lexicon holds.

Odd input: a null text is an empty one (no ids, decoded to an empty text); special tokens' strings in a text become their ids, as the
library does by default; repeated rows and null doc_ids are kept as they are; other columns are ignored; an empty table has no lexicon.
"""

from __future__ import annotations

import os
import struct
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import bpe
from .shared import id_and_text, local_file, published

#: A word is frequent if it stands at least once in so many characters of the corpus (twice at least). The bound on words keeps the file
#: and the driver's list small at any size; words beyond it are merged exactly.
FREQUENT, WORDS = 4e-7, 1 << 17


def _count(texts: list[str], special: dict[str, int], path: str) -> Counter:
    """Pieces of the texts. Chunks between single spaces are counted first, their pieces once for each distinct chunk."""
    chunks: Counter = Counter()
    out: Counter = Counter()
    for t in texts:
        if bpe.ODD.search(t) or any(s in t for s in special):
            for part in bpe.segments(t, special):
                if isinstance(part, str):
                    out.update(bpe.pieces(part, path))
        elif "  " in t or " \n" in t or "\n " in t or "\t" in t or "\r" in t or t[-1:] == " ":
            out.update(bpe.SPLIT.findall(t))
        else:
            first, _, rest = t.partition(" ")
            out.update(bpe.SPLIT.findall(first))
            if rest or len(first) < len(t):
                chunks.update(rest.split(" "))
    for c, n in chunks.items():
        for p in bpe.SPLIT.findall(" " + c):
            out[p] += n
    return out


def word_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """word, n: the pieces of all documents and how often each stands there. Counted per task before the exchange."""
    path = tokenizer or bpe.default_path()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        special = bpe.vocabulary(path).special
        held: Counter = Counter()
        for pdf in batches:
            texts = pdf["text"].tolist()
            for at in range(0, len(texts), 1000):
                held.update(_count(texts[at : at + 1000], special, path))
                if len(held) > 150_000:
                    yield pd.DataFrame({"word": list(held.keys()), "n": list(held.values())})
                    held = Counter()
        words = list(held.keys())
        for at in range(0, len(words), 50_000):
            some = words[at : at + 50_000]
            yield pd.DataFrame({"word": some, "n": [held[w] for w in some]})

    return id_and_text(docs).select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, tokenizer: str | None = None, share: float = FREQUENT, most: int = WORDS) -> list[str]:
    """The frequent words: at most 1 / share of them by arithmetic, and at most `most` by count. These alone reach the driver."""
    chars = id_and_text(docs).agg(F.sum(F.length("text"))).first()[0] or 0
    often = word_counts(docs, tokenizer).where(F.col("n") >= max(2, int(share * chars)))
    return [r["word"] for r in often.orderBy(F.desc("n"), "word").limit(most).collect()]


def compile_lexicon(words: list[str], tokenizer: str) -> bytes:
    """The automaton of the words, as bytes: header, edges (key = state * 256 + byte, target, output), final flags, ids."""
    vocab = bpe.vocabulary(tokenizer)
    keys = sorted({w.encode("utf-8", "surrogateescape") for w in words if w})
    edges: list[dict[int, int]] = [{}]
    final: list[bool] = [False]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int]] = []  # (state, byte) edges of the last word that aren't minimal yet

    def settle(down_to: int) -> None:
        while len(path) > down_to:
            state, byte = path.pop()
            child = edges[state][byte]
            form = (final[child], tuple(edges[child].items()))
            same = register.setdefault(form, child)
            if same != child:
                edges[state][byte] = same
                spare.append(child)

    spare: list[int] = []
    last = b""
    for key in keys:
        common = len(os.path.commonprefix([key, last]))
        settle(common)
        state = edges[path[-1][0]][path[-1][1]] if path else 0
        for b in key[common:]:
            if spare:
                new = spare.pop()
                edges[new], final[new] = {}, False
            else:
                new = len(edges)
                edges.append({})
                final.append(False)
            edges[state][b] = new
            path.append((state, b))
            state = new
        final[state] = True
        last = key
    settle(0)
    # number the states that are reached, count the words behind each, and lay the edges out by state and byte
    number, order, stack = {0: 0}, [0], [0]
    while stack:
        for t in edges[stack.pop()].values():
            if t not in number:
                number[t] = len(order)
                order.append(t)
                stack.append(t)
    behind: dict[int, int] = {}
    stack = [0]
    while stack:
        s = stack[-1]
        todo = [t for t in edges[s].values() if t not in behind]
        if todo:
            stack += todo
        else:
            behind[stack.pop()] = final[s] + sum(behind[t] for t in edges[s].values())
    key_of, target, output = [], [], []
    for s in order:
        before = int(final[s])
        for b, t in sorted(edges[s].items()):
            key_of.append(number[s] * 256 + b)
            target.append(number[t])
            output.append(before)
            before += behind[t]
    ids = [vocab.merged(k) for k in keys]
    begin = np.concatenate(([0], np.cumsum([len(x) for x in ids], dtype=np.int64)))
    flat = np.array([i for x in ids for i in x], np.uint32)
    arrays = [np.array(key_of, "<i8"), begin.astype("<i8"), np.array(target, "<u4"), np.array(output, "<u4"), flat.astype("<u4"), np.array([final[s] for s in order], "u1")]
    return b"MATL" + struct.pack("<I4Q", 1, len(key_of), len(keys), len(flat), len(order)) + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """A compiled lexicon in a mapped file."""

    def __init__(self, file: str) -> None:
        raw = np.memmap(file, np.uint8, "r")
        if bytes(raw[:4]) != b"MATL":
            raise ValueError("not a lexicon")
        _, edges, words, flat, states = struct.unpack("<I4Q", bytes(raw[4:40]))
        at = 40

        def column(kind: str, n: int) -> np.ndarray:
            nonlocal at
            size = n * np.dtype(kind).itemsize
            out = raw[at : at + size].view(kind)
            at += size
            return out

        self.key, self.begin = column("<i8", edges), column("<i8", words + 1)
        self.target, self.output, self.ids = column("<u4", edges), column("<u4", edges), column("<u4", flat)
        self.final = column("u1", states)
        self.words = words

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, -1 if it isn't in the lexicon; all words walk the automaton side by side, a byte at a time."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(n) - n
        state, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        alive = np.flatnonzero(n > 0) if len(self.key) else np.zeros(0, np.int64)
        out = np.full(len(words), -1, np.int64)
        step = 0
        while len(alive):
            want = state[alive] * 256 + text[begin[alive] + step]
            at = np.searchsorted(self.key, want)
            at[at == len(self.key)] = 0
            found = self.key[at] == want
            alive, at = alive[found], at[found]
            state[alive] = self.target[at]
            total[alive] += self.output[at]
            step += 1
            ended = n[alive] == step
            here = alive[ended]
            good = here[self.final[state[here]] == 1]
            out[good] = total[good]
            alive = alive[~ended]
        return out


_held: dict[tuple[str, str], bpe.PieceEncoder] = {}


def _coder(name: str, path: str) -> bpe.PieceEncoder:
    """Encoder over a published lexicon; a worker holds one, and lets it go before it makes another."""
    if (name, path) not in _held:
        _held.clear()
        _held[name, path] = _made(name, path)
    return _held[name, path]


def _made(name: str, path: str) -> bpe.PieceEncoder:
    lexicon, vocab, merge = Lexicon(local_file(name)), bpe.vocabulary(path), bpe.merger(path)

    def learn(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids from the lexicon; unseen words are merged."""
        raw = [w.encode("utf-8", "surrogateescape") for w in words]
        number = lexicon.numbers(raw)
        known = np.flatnonzero(number >= 0)
        unseen = np.flatnonzero(number < 0)
        flat, n = merge.many([raw[k] for k in unseen])
        begin, size = lexicon.begin[number[known]], np.zeros(len(raw), np.int64)
        size[known], size[unseen] = lexicon.begin[number[known] + 1] - begin, n
        end = np.cumsum(size)
        out = np.empty(int(end[-1]) if len(end) else 0, np.uint32)
        mine = np.repeat(number >= 0, size)
        m = size[known]
        out[mine] = lexicon.ids[np.repeat(begin - np.cumsum(m) + m, m) + np.arange(int(m.sum()))]
        out[~mine] = flat
        return out, size

    def whole(text: str) -> list[int]:
        out: list[int] = []
        for part in bpe.segments(text, vocab.special):
            out += [part] if isinstance(part, int) else learn(bpe.pieces(part, path))[0].tolist()
        return out

    return bpe.PieceEncoder(path, learn, whole, limit=500_000)


def _prepared(docs: DataFrame, tokenizer: str | None, words: list[str] | None) -> tuple[str, str]:
    path = tokenizer or bpe.default_path()
    return path, published(docs.sparkSession, compile_lexicon(frequent_words(docs, path) if words is None else words, path), "lexicon")


def encode(docs: DataFrame, tokenizer: str | None = None, words: list[str] | None = None) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers) of each document. `words`: the lexicon's; else found in `docs`."""
    path, name = _prepared(docs, tokenizer, words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _coder(name, path)
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "ids": [x.astype("<u4").tobytes() for x in coder.batch(part["text"].tolist())]})

    return id_and_text(docs).mapInPandas(run, "doc_id long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str | None = None, words: list[str] | None = None) -> DataFrame:
    """doc_id, ids, text: each document encoded and its ids decoded again, in one pass so that a task has one worker."""
    path, name = _prepared(docs, tokenizer, words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _coder(name, path)
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                ids = [x.astype("<u4") for x in coder.batch(part["text"].tolist())]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "ids": [x.tobytes() for x in ids], "text": [decoded(x, path) for x in ids]})

    return id_and_text(docs).mapInPandas(run, "doc_id long, ids binary, text string")


@lru_cache(4)
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    vocab = bpe.vocabulary(path)
    each = [vocab.bytes_of.get(i, b"") for i in range(vocab.size)]
    n = np.array([len(x) for x in each], np.int64)
    return np.frombuffer(b"".join(each), np.uint8), np.cumsum(n) - n, n


def decoded(ids: np.ndarray, path: str) -> str:
    """Text of ids; ids outside the vocabulary stand for nothing, bytes that aren't UTF-8 become replacement characters."""
    flat, begin, length = _token_bytes(path)
    ids = ids[ids < len(length)].astype(np.int64)
    n = length[ids]
    end = np.cumsum(n)
    return flat[np.repeat(begin[ids] - end + n, n) + np.arange(int(end[-1]) if len(end) else 0)].tobytes().decode("utf-8", "replace")


def decode(coded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids, text of each row of `encode`'s result."""
    path = tokenizer or bpe.default_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "ids": part["ids"], "text": [decoded(np.frombuffer(bytes(x), "<u4"), path) for x in part["ids"]]})

    return coded.select("doc_id", "ids").mapInPandas(run, "doc_id long, ids binary, text string")


def digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of each document."""
    return round_trip(docs, tokenizer).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
