"""Toxicity by weak supervision.

Voters are words, word beginnings and patterns of writing (masked, stretched or spaced-out words, shouting, piled-up marks) that lean toward
toxic rows among labelled ones, found for any language.
A generative label model estimates by expectation maximisation how often each voter fires on toxic and on clean documents; voters that agree beyond
what the classes explain are weakened by their correlations. Its posterior labels train a sparse linear classifier, whose scores are calibrated.

Labels come only from rows whose crc32(doc_id as text) mod 3 isn't 1, and from SAMPLE of them at most (a documented bound for fitting);
every document is scored. Labels, lang, source and doc_id are never inputs of a score.

Odd input: a null text is an empty one and gets the score of no evidence; repeated rows are scored each; null doc_ids are scored and never
held out; labels that are null or neither 0 nor 1 are ignored; conflicting labels of a document count as toxic; without labelled rows of
both classes every score is 0; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .shared import id_and_text

#: Labelled rows used for fitting, voters and features kept, lengths of word beginnings, and how many words make further levels of them.
SAMPLE, VOTERS, FEATURES, STEMS, LEVELS = 12_000, 256, 1024, (4, 5, 6), (2, 4)
#: Least toxic rows of a voter, its least lift and least deviation (in standard deviations, well beyond chance among
#: all words), the least deviation of a feature, and the threshold.
SUPPORT, LIFT, BEYOND, CHANCE, THRESHOLD = 4, 4.0, 6.0, 4.0, 0.7
_WORD = re.compile(r"\w+")
#: Patterns of writing, by feature. Residue 4 of 8 keeps them apart from words (0), beginnings (1) and their levels (2, 3).
PATTERNS = {
    zlib.crc32(name) * 8 + 4: re.compile(pattern)
    for name, pattern in (
        (b"masked word", r"\w[*@#$%]{2,}\w"),
        (b"stretched word", r"([^\W\d_])\1{3}"),
        (b"spaced-out word", r"\b[^\W\d_](?:[ .*_-][^\W\d_]\b){4}"),
        (b"shouting", r"\b[A-Z]{3,}\b(?:[ ,'-]{1,3}[A-Z]{2,}\b){2}"),
        (b"piled-up marks", r"[!?]{3}"),
    )
}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def word_features(word: str) -> tuple[int, ...]:
    """Numbers of a word's features: the word itself, and its beginnings of some lengths if it is longer."""
    raw = word.encode("utf-8", "surrogatepass")
    own = zlib.crc32(raw) * 8
    return (own, *(zlib.crc32(b"s" + word[:n].encode("utf-8", "surrogatepass")) * 8 + 1 for n in STEMS if len(word) > n))


class _Known(dict):
    """Word -> its features; with `known`, those alone that some known feature is a level of."""

    def __init__(self, known) -> None:
        self.known = None if known is None else {f - f % 8 + min(f % 8, 1) for f in known}
        self.patterns = [(f, p.search) for f, p in PATTERNS.items() if known is None or f in known]

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        got = word_features(word)
        self[word] = got = got if self.known is None else tuple(f for f in got if f in self.known)
        return got


def _features(text: str, known: _Known) -> set[int]:
    """Features of a text: its words, each beginning with how many words share it (one, two, four or more), and its patterns."""
    out = {f for f, search in known.patterns if search(text)}
    count: dict[int, int] = {}
    for got in map(known.__getitem__, set(_WORD.findall(text.lower()))):
        for f in got:
            count[f] = count.get(f, 0) + 1
    for f, n in count.items():
        out.add(f)
        if n > 1 and f % 8:
            out.update(f + k for k, least in enumerate(LEVELS, 1) if n >= least)
    return out


@dataclass
class Model:
    weights: dict[int, float] = field(default_factory=dict)
    bias: float = -math.inf
    voters: int = 0

    def scorer(self):
        known, weights = _Known(self.weights), self.weights

        def score(text: str) -> float:
            x = self.bias + sum(weights.get(f, 0.0) for f in sorted(_features(text, known)))
            return 0.0 if x < -700 else 1 / (1 + math.exp(-x))

        return score


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """Texts and labels of at most `rows` labelled documents that aren't held out, picked by a hash of doc_id."""
    marked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    return id_and_text(docs).join(F.broadcast(marked), "doc_id")  # `rows` rows of two numbers at most


def _tally(sample: DataFrame) -> DataFrame:
    """feature, toxic, clean: documents of each label with the feature (feature -1: all documents)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = _Known(None)
        for pdf in batches:
            parts = {0: [], 1: []}
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                parts[int(toxic)].append(np.fromiter([*_features(text, every), -1], np.int64))
            got = [np.unique(np.concatenate(p), return_counts=True) if p else (np.zeros(0, np.int64), np.zeros(0, np.int64)) for p in (parts[1], parts[0])]
            yield pd.DataFrame({"feature": np.concatenate([f for f, _ in got]), "toxic": np.concatenate([got[0][1], np.zeros_like(got[1][1])]), "clean": np.concatenate([np.zeros_like(got[0][1]), got[1][1]])})

    return sample.select("text", "toxic").mapInPandas(count, "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def label_model(votes: np.ndarray, fire: np.ndarray, quiet: np.ndarray, prior: float, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of toxic for each row of 0/1 votes, and for each voter firing alone. fire, quiet: first estimates of how often a voter fires on toxic and on clean rows;
    they go on counting as much as the rows themselves, so the model can't drift to another way of splitting the rows (a language, say)."""
    v = votes.astype(np.float64)
    fire0, quiet0, prior0, n = fire, quiet, prior, len(votes)
    together = np.zeros((v.shape[1], v.shape[1]))
    silent = v.sum(axis=1) == 0
    for k in range(rounds):
        gain = np.maximum(np.log(fire / quiet), 0)
        # a silent voter abstains; among those that fire, correlated ones share their weight
        evidence = (v * gain / (1 + v @ together)).sum(axis=1)
        evidence[silent] = -2.0
        q = 1 / (1 + np.exp(-np.clip(math.log(prior / (1 - prior)) + evidence, -40, 40)))
        if k == 2:  # correlations that the classes don't explain
            rest = v - np.outer(q, fire) - np.outer(1 - q, quiet)
            spread = np.sqrt((rest**2).sum(axis=0) + 1e-9)
            corr = np.abs(rest.T @ rest) / np.outer(spread, spread)
            np.fill_diagonal(corr, 0)
            together = np.where(corr > 0.2, corr, 0)
        s = q.sum()
        fire = np.clip((q @ v + fire0 * n * prior0) / (s + n * prior0), 1e-5, 1 - 1e-5)
        quiet = np.clip(((1 - q) @ v + quiet0 * n * (1 - prior0)) / (n - s + n * (1 - prior0)), 1e-6, 1 - 1e-5)
        quiet = np.minimum(quiet, fire * 0.5)  # a voter is for toxic, by its role
        prior = (s + n * prior0) / (2 * n)
    return q, 1 / (1 + np.exp(-np.clip(math.log(prior / (1 - prior)) + np.maximum(np.log(fire / quiet), 0), -40, 40)))


def by_themselves(votes: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which voters (columns, most precise first) are to be kept: those that never fire on a clean row, and those that lean toward toxic rows
    among the rows that no kept voter before them fires on. A beginning shared with harmless words falls away once its word votes."""
    covered = np.zeros(len(votes), bool)
    keep = np.zeros(votes.shape[1], bool)
    share = max(toxic.mean(), 1e-9)
    for k in range(votes.shape[1]):
        fires = votes[:, k] > 0
        new = fires & ~covered
        hit, miss = int((new & (toxic == 1)).sum()), int((new & (toxic == 0)).sum())
        keep[k] = not (fires & (toxic == 0)).any() or (hit >= 2 and hit / share >= LIFT * (hit + miss))
        if keep[k]:
            covered |= fires
    return keep


def linear(x: np.ndarray, q: np.ndarray, decay: float = 1e-5, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, full batches with adaptive steps; both classes weigh alike."""
    share = min(max(float(q.mean()), 1e-3), 1 - 1e-3)
    each = (np.where(q > 0.5, 0.5 / share, 0.5 / (1 - share)) / len(q)).astype(np.float32)
    x1 = np.hstack((x, np.ones((len(x), 1), np.float32)))
    w1 = np.zeros(x1.shape[1], np.float32)
    m, v = np.zeros_like(w1), np.zeros_like(w1)
    q32 = q.astype(np.float32)
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w1, -30, 30)))
        g = x1.T @ (each * (p - q32))
        g[:-1] += decay * w1[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w1 -= 0.08 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-7)
    w, b = w1[:-1], float(w1[-1])
    return w, b


def calibrated(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Platt's method (his smoothed targets), Newton steps."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * logit + c, -30, 30)))
        r, h = p - t, np.maximum(p * (1 - p), 1e-9)
        m = np.array([[(h * logit * logit).sum() + 1e-3, (h * logit).sum()], [(h * logit).sum(), h.sum() + 1e-3]])
        d = np.linalg.solve(m, [(r * logit).sum() + 1e-3 * (a - 1), r.sum()])
        a, c = max(0.05, a - float(np.clip(d[0], -1, 1))), c - float(np.clip(d[1], -1, 1))
    return a, c


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Model:
    """The model. What reaches the driver is bounded by `rows`, VOTERS and FEATURES."""
    sample = _sample(docs, labels, rows)
    tally = _tally(sample).cache()
    try:
        total = tally.where("feature = -1").first()
        if total is None or not total["toxic"] or not total["clean"]:
            return Model()
        n1, n0 = total["toxic"], total["clean"]
        share = n1 / (n1 + n0)
        n = F.col("toxic") + F.col("clean")
        scored = tally.where(f"feature <> -1 and toxic + clean >= {SUPPORT}").select(
            "feature", "toxic", "clean", ((F.col("toxic") - n * share) / F.sqrt(n * share * (1 - share))).alias("z")
        )
        scored = scored.where(F.abs("z") >= CHANCE)
        lean = [*scored.orderBy(F.desc("z"), "feature").limit(FEATURES).collect(), *scored.orderBy("z", "feature").limit(FEATURES // 4).collect()]
    finally:
        tally.unpersist()
    lean = list({r["feature"]: r for r in lean}.values())
    column = {r["feature"]: k for k, r in enumerate(lean)}
    lift = [((r["toxic"] + 0.5) / (n1 + 1)) / ((r["clean"] + 0.5) / (n0 + 1)) for r in lean]
    voters = [k for k, r in enumerate(lean) if r["toxic"] >= SUPPORT and lift[k] >= LIFT and r["z"] >= BEYOND]
    voters.sort(key=lambda k: (-lift[k], k))
    if not voters:
        return Model()

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Known(column)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "columns": [sorted(column[f] for f in _features(t, known) if f in column) for t in pdf["text"]]})

    # one row a labelled document, whose number `rows` bounds: of rows that repeat a doc_id the least list stands
    marked = sample.mapInPandas(mark, "doc_id long, toxic int, columns array<int>").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("columns").alias("columns"))
    got = sorted(marked.collect(), key=lambda r: r["doc_id"])
    x = np.zeros((len(got), len(lean)), np.float32)
    for i, r in enumerate(got):
        x[i, r["columns"]] = 1
    y = np.array([r["toxic"] for r in got])
    voters = [k for k, good in zip(voters, by_themselves(x[:, voters], y)) if good][:VOTERS]
    if not voters:
        return Model()
    fire = np.array([(lean[k]["toxic"] + 0.5) / (n1 + 1) for k in voters])
    quiet = np.array([(lean[k]["clean"] + 0.05) / (n0 + 1) for k in voters])
    q, alone = label_model(x[:, voters], fire, np.minimum(quiet, 0.5 * fire), share)
    # a row for each voter by itself (with the features that never miss where it fires: a word's beginnings), so that the classifier
    # learns what one vote is worth where documents hold several
    fires = x[:, voters]
    single = ((fires.T @ x) >= fires.sum(axis=0)[:, None] - 0.5).astype(np.float32)
    w, b = linear(np.vstack((x, single)), np.concatenate((q, alone)))
    a, c = calibrated(np.vstack((x, single)) @ w + b, np.concatenate((y, alone > 0.5)))
    return Model({r["feature"]: float(a * w[k]) for k, r in enumerate(lean) if abs(w[k]) > 1e-6}, float(a * b + c), len(voters))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = model.scorer()
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": [one(t) for t in pdf["text"]]})

    scored = id_and_text(docs).mapInPandas(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model doesn't reject, all columns kept; texts stay in their tasks."""
    names = docs.columns

    def run(batches):
        import pyarrow as pa

        one = model.scorer()
        for batch in batches:
            keep = [one(t or "") < THRESHOLD for t in batch.column(names.index("text")).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
