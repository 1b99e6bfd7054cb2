"""Secret scans: base patterns, and a randomness test battery for tokens of no known form.

A candidate's encoding is inferred (the smallest alphabet that holds its characters). Tests of uniform randomness follow: chi-squared
of its alphabet, runs above and below the alphabet's middle, runs of digits, capitals and small letters, and serial correlation. Their
p-values are joined by Fisher's method; for tokens of up to EXACT characters the joint statistic is held against that of random tokens of the
same encoding and length, since short tokens have no room for the tests' limits.

The discoveries are the tokens that look random. Those that are random have p-values spread evenly, structured ones lie near 0: from the
share above LAMBDA follows how many tokens are random at all, and so what part of the tokens above a limit is structured. The limit is the least
one that keeps this false discovery rate, separately for classes of length since longer tokens have more power; copies of a token count once.
What reaches the limit is a secret of kind `random`. Base spans always stay.

Odd input: a null text is an empty one (no spans); repeated rows and null doc_ids are kept; other columns are ignored; places are counted
in code points, ends are exclusive.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from .shared import id_and_text, stored

KINDS = ("assign", "access", "hex", "random")
#: The base patterns, and the least length of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
WORDS = ("passw", "secret", "token", "apikey", "api_key")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: A candidate may start after `=` and holds it as trailing padding only, so the value of NAME=value is tested by itself.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{14,}(?:=+(?![A-Za-z0-9+/_=-]))?")
CANDIDATE_LEAST = 20
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings from the smallest alphabet on.
ALPHABETS = {
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "BASE36": _DIGITS + _UPPER,
    "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _DIGITS + _UPPER + _LOWER + "+/",
    "base64url": _DIGITS + _UPPER + _LOWER + "-_",
}
_SETS = {k: frozenset(v) for k, v in ALPHABETS.items()}
_ORDER = {k: {c: i for i, c in enumerate(sorted(v))} for k, v in ALPHABETS.items()}
_CLASS = {k: np.array([0 if c in _DIGITS else 1 if c in _UPPER else 2 if c in _LOWER else 3 for c in sorted(v)]) for k, v in ALPHABETS.items()}
#: Rate of false discoveries, least bits that a random token of its length would hold, edges of the classes of length, bins of p-values
#: (equal in their logarithm) and the p-value that the last one goes up to, the p-value above which tokens are taken to be random, the longest
#: token that is held against simulated ones, and how many of these.
RATE, BITS, LENGTHS, BINS, TINY, LAMBDA, EXACT, DRAWS = 0.05, 80.0, (32, 48, 96), 20_000, 1e-300, 0.1, 160, 3999
#: The least limit: it costs so small a part of the random tokens, and most structured ones lie below.
FLOOR = 0.01


def encoding(token: str) -> str | None:
    chars = set(token.rstrip("="))
    if not chars & set(_DIGITS) or not chars & set(_LOWER + _UPPER):
        return None
    return next((k for k, s in _SETS.items() if chars <= s), None)


_erfc = np.vectorize(math.erfc, otypes=[float])


def _statistic(x: np.ndarray, kind: str) -> np.ndarray:
    """Sum of the tests' -log p for each row of alphabet places; larger is less random."""
    m, n = x.shape
    k = len(_ORDER[kind])
    expected = n / k
    count = np.bincount((np.arange(m)[:, None] * k + x).ravel(), minlength=m * k).reshape(m, k)
    chi = ((count - expected) ** 2).sum(axis=1) / expected
    df = k - 1  # upper tail by Wilson and Hilferty
    p = [0.5 * _erfc(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)) / math.sqrt(2))]
    high = x >= k / 2
    a = high.sum(axis=1)
    b = n - a
    mean = 2 * a * b / n + 1
    var = np.maximum((mean - 1) * (mean - 2) / (n - 1), 1e-9)
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(axis=1)
    p.append(np.where((a > 0) & (b > 0), _erfc(np.abs(runs - mean) / np.sqrt(2 * var)), 2.0 ** (1 - n)))
    of = _CLASS[kind]
    same = sum((of == c).mean() ** 2 for c in range(4))
    changes = (of[x][:, 1:] != of[x][:, :-1]).sum(axis=1)
    p.append(_erfc(np.abs(changes - (n - 1) * (1 - same)) / math.sqrt(2 * (n - 1) * max(same * (1 - same), 1e-9))))
    d = x - x.mean(axis=1, keepdims=True)
    spread = (d * d).sum(axis=1)
    r = np.where(spread > 0, (d[:, 1:] * d[:, :-1]).sum(axis=1) / np.maximum(spread, 1e-9), 1.0)
    p.append(_erfc(np.abs(r + 1 / n) * math.sqrt(n / 2)))
    return -np.log(np.maximum(p, 1e-300)).sum(axis=0)


@lru_cache(4096)
def _of_random_tokens(kind: str, n: int) -> np.ndarray:
    """Sorted statistics of random tokens of an encoding and a length; the same ones in every task."""
    rng = np.random.default_rng([list(ALPHABETS).index(kind), n])
    return np.sort(_statistic(rng.integers(0, len(ALPHABETS[kind]), (DRAWS, n)), kind))


def battery(token: str, kind: str) -> float:
    """Joint p-value of the tests under uniform randomness."""
    order = _ORDER[kind]
    x = np.array([[order[c] for c in token.rstrip("=")]])
    half = float(_statistic(x, kind)[0])
    joint = math.exp(-half) * (1 + half + half * half / 2 + half**3 / 6)  # chi-squared upper tail, eight degrees
    if x.shape[1] > EXACT:
        return joint
    above = DRAWS - int(np.searchsorted(_of_random_tokens(kind, x.shape[1]), half, "left"))
    return (above + 1) / (DRAWS + 1) if above else min(joint, 1 / (DRAWS + 1))


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int, int, float, int]]]:
    """Base spans (kind, start, end), and candidates (start, end, class of length, p, hash of the token)."""
    base = []
    low = text.lower()
    if any(w in low for w in WORDS):
        base += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        base += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    tested = []
    if max(map(len, text.split()), default=0) >= 20:
        base += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
        held = sorted((s, e) for _, s, e in base)
        reach, at = 0, 0
        for m in CANDIDATE.finditer(text):
            token = m.group()
            while at < len(held) and held[at][0] <= m.start():
                reach = max(reach, held[at][1])
                at += 1
            if len(token) < CANDIDATE_LEAST or m.end() <= reach:  # within a base span
                continue
            if kind := encoding(token):
                if len(token.rstrip("=")) * math.log2(len(ALPHABETS[kind])) >= BITS:
                    tested.append((m.start(), m.end(), sum(len(token) >= x for x in LENGTHS), battery(token, kind), xxh64_intdigest(token) - (1 << 63)))
    base.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return base, tested


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and tested candidates of each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [scan(t) for t in pdf["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"].astype("Int64"),
                    "base": [[{"kind": k, "start": s, "end": e} for k, s, e in b] for b, _ in found],
                    "tested": [[{"start": s, "end": e, "length": c, "p": p, "token": h} for s, e, c, p, h in t] for _, t in found],
                }
            )

    return id_and_text(docs).mapInPandas(run, "doc_id long, base array<struct<kind:string,start:int,end:int>>, tested array<struct<start:int,end:int,length:int,p:double,token:long>>")


def limits(tested: DataFrame, rate: float = RATE) -> list[float]:
    """For each class of length the p-value from which a token counts as random, above 1 where none does.

    Distinct tokens are dealt into a histogram of fixed size; it alone reaches the driver, with the least p-value of each bin and how many
    lie above LAMBDA."""
    scale = BINS / -math.log(TINY)
    each = tested.select(F.explode("tested").alias("t")).groupBy("t.token", "t.length").agg(F.max("t.p").alias("p"))
    t = each.select("length", "p", F.least(F.floor(F.log(F.greatest("p", F.lit(TINY))) * -scale), F.lit(BINS - 1)).cast("int").alias("bin"))
    count: dict[int, dict[int, tuple[int, int, float]]] = {}
    for r in t.groupBy("length", "bin").agg(F.count("*").alias("n"), F.sum((F.col("p") > LAMBDA).cast("int")).alias("over"), F.min("p").alias("low")).collect():
        count.setdefault(r["length"], {})[r["bin"]] = r["n"], r["over"], r["low"]
    out = []
    for c in range(len(LENGTHS) + 1):
        bins = count.get(c, {})
        left = sum(n for n, _, _ in bins.values())
        even = min(left, sum(over for _, over, _ in bins.values()) / (1 - LAMBDA))  # tokens that are random
        limit = 2.0
        for b in sorted(bins, reverse=True):  # from the smallest p-values on
            n, _, low = bins[b]
            # half a standard deviation of the number of random tokens is allowed for, or few tokens would be lost to chance
            if left - even * (1 - low) <= rate * left + math.sqrt(even) / 2:
                limit = max(low, FLOOR)
                break
            left -= n
        out.append(limit)
    return out


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (all of them, with kind `random`) of each document."""
    found = stored(scanned(docs), "secrets")
    limit = F.array(*map(F.lit, limits(found)))
    random = F.transform(
        F.filter("tested", lambda t: t["p"] >= F.element_at(limit, t["length"] + 1)),
        lambda t: F.struct(F.lit("random").alias("kind"), t["start"].alias("start"), t["end"].alias("end")),
    )
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    keyed = F.array_sort(F.transform(F.concat("base", random), lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return found.select("doc_id", "base", F.transform(keyed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def _joined(col: str):
    return F.concat_ws(",", F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digests(docs: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return spans(docs).select("doc_id", *map(count, KINDS[:3]), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with every secret replaced by a mark of its kind, all columns kept; n_chars follows the new text.

    The candidates of all documents are tested first (their p-values set the limits); the texts are then scanned and rewritten in place,
    so no text moves between tasks."""
    least = limits(scanned(docs))
    schema, names = docs.schema, docs.columns

    def rewrite(batches):
        import pyarrow as pa

        for batch in batches:
            at = names.index("text")
            new = [None if t is None else redact(t, least) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                old = columns[k].to_pylist()
                columns[k] = pa.array([o if a is None or a == b else len(a) for o, a, b in zip(old, new, batch.column(at).to_pylist())], batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(rewrite, schema)


def redact(text: str, least: list[float]) -> str:
    """The text with marks for its secrets; `least`: for each class of length the p-value from which a token is random."""
    base, tested = scan(text)
    found = [(s, e, k) for k, s, e in base] + [(s, e, "random") for s, e, c, p, _ in tested if p >= least[c]]
    if not found:
        return text
    out, at = [], 0
    for s, e, k in sorted(found, key=lambda f: (f[0], -f[1])):
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])
