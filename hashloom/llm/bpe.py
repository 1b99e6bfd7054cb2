"""Byte-level BPE building blocks: splitting texts into the pieces that are encoded one by one, the vocabulary and exact merging.

The tokenizer's files are read from a path that the caller gives (a parameter); they are never copied.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: The split pattern of this tokenizer family, written for Python's `re` (it agrees with the library on PLAIN texts only).
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: A character outside this set sends the text to the library's own splitter, since Unicode tables differ between versions.
ODD = re.compile("[^\t\n\r -~¡-©À-ɏ‐-‧]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(4)
def library(path: str):
    """The tokenizers library's object for the file; one per process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def byte_letters() -> dict[str, int]:
    """Letter of the vocabulary file -> byte: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Token bytes by id, byte tokens, special tokens, and the rank and result of each mergeable pair of ids."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.bytes_of = {i: bytes(letters[c] for c in s) for s, i in vocab.items() if s not in self.special}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.byte_id = [vocab[c] for c, _ in sorted(letters.items(), key=lambda kv: kv[1])]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.merge = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.size = max(self.bytes_of) + 1

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: always the pair of lowest rank, its leftmost occurrence first."""
        ids, merge = [self.byte_id[b] for b in word], self.merge
        if len(ids) > 64:
            return self._merged_long(ids)
        never = (1 << 60, -1)
        ranks = [merge.get(p, never) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best is never or best[1] < 0:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [best[1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = merge.get((ids[i], ids[i + 1]), never)
            if i:
                ranks[i - 1] = merge.get((ids[i - 1], ids[i]), never)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same result by a heap over a linked list: n log n for very long words."""
        import heapq

        n, merge = len(ids), self.merge
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = new, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] >= 0 and (r := merge.get((ids[left], ids[after[left]]))):
                    heapq.heappush(heap, (r[0], left, ids[left], ids[after[left]], r[1]))
        return [x for x, keep in zip(ids, alive) if keep]


_NEVER = np.int32(2**31 - 1)
_SLOTS = 1 << 19


class Merger:
    """Exact merging of many short words side by side."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.byte_id = np.array(vocab.byte_id, np.int64)
        pair = np.array([(a << 20) | b for a, b in vocab.merge], np.int64)
        rank = np.array([r for r, _ in vocab.merge.values()], np.int32)
        new = np.array([n for _, n in vocab.merge.values()], np.int64)
        self.key, self.rank, self.new = np.full(_SLOTS, -1, np.int64), np.full(_SLOTS, _NEVER, np.int32), np.zeros(_SLOTS, np.int64)
        left = np.arange(len(pair))
        step = 0
        while len(left):  # linear probing, a step for all that are left at a time
            slot = (self._slot(pair[left]) + step) % _SLOTS
            free = self.key[slot] == -1
            _, first = np.unique(slot, return_index=True)
            placed = np.zeros(len(left), bool)
            placed[first] = True
            placed &= free
            at = slot[placed]
            self.key[at], self.rank[at], self.new[at] = pair[left[placed]], rank[left[placed]], new[left[placed]]
            left, step = left[~placed], step + 1
        self.probes = step

    @staticmethod
    def _slot(pair: np.ndarray) -> np.ndarray:
        return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).astype(np.int64)

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of each pair that can be merged, else -1. Negative ids stand for nothing."""
        pair = np.where((a < 0) | (b < 0), np.int64(-2), (a << 20) | b)
        slot = self._slot(pair)
        out = np.full(len(pair), -1, np.int64)
        todo = np.flatnonzero(pair >= 0)
        for _ in range(self.probes):
            at = slot[todo]
            hit = self.key[at] == pair[todo]
            out[todo[hit]] = at[hit]
            todo = todo[~hit & (self.key[at] != -1)]
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) % _SLOTS
        return out

    def many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        out: list = [None] * len(words)
        low = 0
        for high in (4, 8, 12, 16, 24, 32):
            group = np.flatnonzero((size > low) & (size <= high))
            for at in range(0, len(group), 4096):
                self._group([words[k] for k in group[at : at + 4096]], size[group[at : at + 4096]], high, group[at : at + 4096], out)
            low = high
        for k in np.flatnonzero(size > 32):
            out[k] = np.array(self.vocab.merged(words[k]), np.uint32)
        empty = np.zeros(0, np.uint32)
        got = [empty if x is None else x for x in out]
        return (np.concatenate(got) if got else empty), np.fromiter(map(len, got), np.int64, len(got))

    def _group(self, words: list[bytes], size: np.ndarray, width: int, group: np.ndarray, out: list) -> None:
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        ids = self.byte_id[raw]
        ids[np.arange(width)[None, :] >= size[:, None]] = -1
        slot = self._find(ids[:, :-1].ravel(), ids[:, 1:].ravel())
        rank = np.where(slot < 0, _NEVER, self.rank[slot]).reshape(len(words), width - 1)
        n, row = size.copy(), np.arange(len(words))
        places = np.arange(width)[None, :]
        while len(row):
            at = rank.argmin(axis=1)
            lane = np.arange(len(row))
            live = rank[lane, at] < _NEVER
            if not live.all():
                for k in np.flatnonzero(~live):
                    out[group[row[k]]] = ids[k, : n[k]].astype(np.uint32)
                ids, rank, n, row, at = ids[live], rank[live], n[live], row[live], at[live]
                if not len(row):
                    break
                lane = np.arange(len(row))
            merged = self.new[self._find(ids[lane, at], ids[lane, at + 1])]
            shift = np.minimum(places + (places > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, shift, axis=1)
            n = n - 1
            ids[lane, at] = merged
            ids[lane, n] = -1
            rank = np.take_along_axis(rank, shift[:, : width - 1].clip(max=width - 2), axis=1)
            rank[lane, np.minimum(n, width - 2)] = _NEVER
            rank[lane, np.maximum(n - 1, 0)] = _NEVER
            for to in (at - 1, at):
                ok = (to >= 0) & (to < n - 1)
                i, j = lane[ok], to[ok]
                slot = self._find(ids[i, j], ids[i, j + 1])
                rank[i, j] = np.where(slot < 0, _NEVER, self.rank[slot])


@lru_cache(4)
def merger(path: str) -> Merger:
    return Merger(vocabulary(path))


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def segments(text: str, special: dict[str, int]) -> list[str | int]:
    """The text between special tokens, and their ids where their strings stand in the text (longest first at a place)."""
    if not any(s in text for s in special):
        return [text]
    cut = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)))
    out: list[str | int] = []
    at = 0
    for m in cut.finditer(text):
        out += [text[at : m.start()], special[m.group()]]
        at = m.end()
    return [x for x in [*out, text[at:]] if x != ""]


_LETTERS = byte_letters()


def pieces(text: str, path: str) -> list[str]:
    """Pieces of a text without special tokens. Odd texts go through the library's splitter."""
    if not ODD.search(text):
        return SPLIT.findall(text)
    split = library(path).pre_tokenizer.pre_tokenize_str(text)
    return [bytes(_LETTERS[c] for c in s).decode("utf-8", "surrogateescape") for s, _ in split]


#: Marks that end a word and are a piece of their own after letters; keys of marks cut off a word; what keys end in letters or digits.
_MARKS = frozenset(".,!?;:)")
_CUT = frozenset(("\0,", "\0.", "\0.\n"))
_MARK, _WORDLY = 1, 2


class _Index(dict):
    """Key -> number; an unseen key gets the next number and is noted as new."""

    def __init__(self, taken: list[int], new: list) -> None:
        self.taken, self.new = taken, new

    def __missing__(self, key: str) -> int:
        self[key] = n = self.taken[0]
        self.taken[0] += 1
        self.new.append((n, key))
        return n


_SHORT = 15
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # masks of the first k bytes


class _Words:
    """Number of each short word: an open-addressing table over whole words (up to 15 bytes and their length in two integers), so that
    many words are looked up side by side and never mistaken."""

    def __init__(self, bits: int) -> None:
        self.bits = bits
        self.a, self.b = (np.zeros(1 << bits, np.uint64) for _ in range(2))
        self.number = np.full(1 << bits, -1, np.int32)

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = (a ^ (b * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers, -1 for unknown words."""
        slot = self._slot(a, b)
        out = self.number[slot]
        todo = np.flatnonzero((out >= 0) & ((self.a[slot] != a) | (self.b[slot] != b)))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.a) - 1)
            at = slot[todo]
            out[todo] = self.number[at]
            todo = todo[(out[todo] >= 0) & ((self.a[at] != a[todo]) | (self.b[at] != b[todo]))]
        return out

    def add(self, a: np.ndarray, b: np.ndarray, number: np.ndarray) -> None:
        """Put in words that are unknown and differ from one another."""
        slot = self._slot(a, b)
        todo = np.arange(len(a))
        while len(todo):
            at = slot[todo]
            _, first = np.unique(at, return_index=True)
            put = first[self.number[at[first]] < 0]
            at, k = at[put], todo[put]
            self.a[at], self.b[at], self.number[at] = a[k], b[k], number[k]
            left = np.ones(len(todo), bool)
            left[put] = False
            todo = todo[left]
            slot[todo] = (slot[todo] + (self.number[slot[todo]] >= 0)) & (len(self.a) - 1)


class PieceEncoder:
    """Ids of whole texts, where `learn` (ids of many pieces, and how many each has) sees a piece once while it stays in a bounded memo.

    Texts are cut at single spaces between words, where a piece always begins, and before a comma or point that ends a word (where that
    holds is checked; other texts are split by the pattern). Key "x" stands for " x", key "\\0x" for "x". Texts with odd characters or
    special tokens go to `whole`."""

    def __init__(self, path: str, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], whole: Callable[[str], list[int]], limit: int = 400_000) -> None:
        self.path, self.learn, self.whole, self.limit = path, learn, whole, limit
        self.special = vocabulary(path).special
        self._clear()

    def _clear(self) -> None:
        self.taken, self.new = [0], []
        self.index = _Index(self.taken, self.new)
        self.words = _Words(max(12, (2 * self.limit).bit_length()))
        self.flat, self.used = np.empty(1 << 20, np.uint32), 0
        self.begin, self.length = (np.zeros(1 << 16, np.int64) for _ in range(2))
        self.kind = np.zeros(1 << 16, np.uint8)

    def _room(self) -> None:
        while self.taken[0] > len(self.begin):
            self.begin, self.length, self.kind = (np.concatenate((x, np.zeros_like(x))) for x in (self.begin, self.length, self.kind))

    def _store(self, numbers: np.ndarray, flat: np.ndarray, n: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        self.flat[self.used : self.used + len(flat)] = flat
        self.begin[numbers], self.length[numbers] = self.used + np.cumsum(n) - n, n
        self.used += len(flat)

    def _gather(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the numbered keys one after the other, and where each ends."""
        n = self.length[code]
        end = np.cumsum(n)
        return self.flat[np.repeat(self.begin[code] - end + n, n) + np.arange(int(end[-1]) if len(end) else 0)], end

    @staticmethod
    def _key(piece: str) -> str:
        return piece[1:] if len(piece) > 1 and piece[0] == " " and not piece[1].isspace() else "\0" + piece

    def _resolve(self) -> None:
        """Find the ids of all keys noted as new: single pieces from `learn`, the others from their pieces."""
        index, text, single = self.index, [], []
        joined, parts, stop = [], [], []
        wordly: list[int] = []
        marks: list[int] = []
        while self.new:
            fresh = self.new[:]
            self.new.clear()
            alpha = [key.isalpha() for _, key in fresh]
            text += [" " + key for (_, key), a in zip(fresh, alpha) if a]
            single += (letters := [number for (number, _), a in zip(fresh, alpha) if a])
            wordly += letters
            for number, key in [f for f, a in zip(fresh, alpha) if not a]:
                if key[-1:].isalnum():
                    wordly.append(number)
                elif key in _CUT:
                    marks.append(number)
                if key[-1:] in _MARKS and key[:-1].isalpha():
                    joined.append(number)
                    parts += (index[key[:-1]], index["\0" + key[-1]])
                    stop.append(len(parts))
                else:
                    whole = key[1:] if key[:1] == "\0" else " " + key
                    split = SPLIT.findall(whole)
                    if len(split) == 1:
                        single.append(number)
                        text.append(whole)
                    else:
                        joined.append(number)
                        parts += [index[self._key(x)] for x in split]
                        stop.append(len(parts))
        self._room()
        self.kind[wordly] = _WORDLY
        self.kind[marks] = _MARK
        if text:
            self._store(np.array(single), *self.learn(text))
        if joined:
            flat, end = self._gather(np.array(parts, np.int64))
            at = np.concatenate(([0], end))[np.array(stop)]
            self._store(np.array(joined), flat, np.diff(at, prepend=0))

    def _numbered(self, chunked: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the keys between single spaces of all texts, and how many each text has. Unknown keys are noted as new."""
        raw = " ".join(chunked).encode()
        data = np.frombuffer(raw + bytes(16), np.uint8)
        stop = np.append(np.flatnonzero(data[: len(raw)] == 32), len(raw))
        start = np.append(0, stop[:-1] + 1)
        size = stop - start
        code = np.empty(len(start), np.int64)
        short = np.flatnonzero(size <= _SHORT)
        at, n = start[short], size[short]
        eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))  # the eight bytes from each place on
        a = eight[at] & _LOW[np.minimum(n, 8)]
        b = (eight[at + 8] & _LOW[np.clip(n - 8, 0, 7)]) | (n.astype(np.uint64) << np.uint64(56))
        got = self.words.find(a, b).astype(np.int64)
        lost = np.flatnonzero(got < 0)
        if len(lost):
            order = lost[np.lexsort((a[lost], b[lost]))]
            first = np.append(True, (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]]))
            one = order[first]
            numbers = self.taken[0] + np.arange(len(one))
            self.taken[0] += len(one)
            self.words.add(a[one], b[one], numbers.astype(np.int32))
            got[order] = numbers[np.cumsum(first) - 1]
            self.new += [(k, raw[s:e].decode()) for k, s, e in zip(numbers.tolist(), at[one].tolist(), (at[one] + n[one]).tolist())]
        code[short] = got
        long = np.flatnonzero(size > _SHORT)
        if len(long):
            keys = [raw[s:e].decode() for s, e in zip(start[long].tolist(), stop[long].tolist())]
            code[long] = np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))
        return code, np.array([t.count(" ") + 1 for t in chunked], np.int64)

    def _by_pattern(self, text: str) -> np.ndarray:
        keys = [self._key(x) for x in SPLIT.findall(text)]
        return np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        if self.taken[0] > self.limit:
            self._clear()
        out: list = [None] * len(texts)
        chunked, which, codes = [], [], {}
        for i, t in enumerate(texts):
            if ODD.search(t) or any(s in t for s in self.special):
                out[i] = np.array(self.whole(t), np.uint32)
            elif "  " in t or " \n" in t or "\n " in t or ".\n\n" in t or "\t" in t or "\r" in t or t[-1:] == " ":
                codes[i] = self._by_pattern(t)
            else:
                chunked.append("\0" + t.replace(", ", " \0, ").replace(". ", " \0. ").replace(".\n", " \0.\n \0"))
                which.append(i)
        code, n = self._numbered(chunked) if chunked else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self._resolve()
        if chunked:
            stop, kind = np.cumsum(n), self.kind[code]
            wrong = np.flatnonzero((kind[1:] == _MARK) & (kind[:-1] != _WORDLY)) + 1  # a mark that would belong to a longer piece
            for k in np.unique(np.searchsorted(stop, wrong, side="right")).tolist():
                codes[which[k]] = self._by_pattern(texts[which[k]])
            self._resolve()
            ids, end = self._gather(code)
            at = 0
            for i, s in zip(which, stop.tolist()):
                last = int(end[s - 1])
                out[i] = ids[at:last]
                at = last
        for i, c in codes.items():
            out[i] = self._gather(c)[0]
        return out
