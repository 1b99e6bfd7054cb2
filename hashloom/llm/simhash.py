"""SimHash near-duplicates by tiled exact comparison.

Distinct 64-bit fingerprints are dealt into cells by the population counts of their four 16-bit words, cells into tiles of bounded size.
Two fingerprints that differ in r bits have counts that differ by r at most, summed over the words; so a tile is compared only with tiles of
cells within the radius (in particular, total counts beyond the radius apart are skipped), and there every pair is compared by exclusive-or
and bit counts. The result is exact. A task emits a spanning forest of what it finds, never all pairs.

Odd input: a null text is an empty one; a text without words has fingerprint zero and is linked like any other; rows without doc_id get
a fingerprint and the smallest doc_id of their group, if any; repeated rows share a group; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .graph import components
from .shared import drop_stored, id_and_text, stored

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Fingerprints of a tile, about, and tiles of a cell that a task compares with at once: they bound a task's memory.
TILE, TILES_AT_ONCE = 1 << 14, 1


def fingerprint(text: str) -> int:
    """Unsigned 64 bits: a bit is 1 if set in over half the hashes of the word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone is lowered, ASCII white space alone separates
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - SHINGLE + 1
    hashes = np.fromiter(map(xxh64_intdigest, map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)))), repeat(SEED)), ">u8", n)
    bits = np.unpackbits(hashes.view(np.uint8)).reshape(n, 64)
    count = np.zeros(64, np.int64)
    for at in range(0, n, 255):  # sums of up to 255 rows fit a byte
        count += bits[at : at + 255].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed bigint)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.fromiter(map(fingerprint, pdf["text"]), np.uint64, len(pdf)).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "fp": fp})

    return id_and_text(docs).mapInPandas(run, "doc_id long, fp long")


def _forest(own: np.ndarray, others: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what is linked within `own`, and between it and `others`, as a spanning forest."""
    both = np.concatenate((own, others))
    parent = list(range(len(both)))
    out = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for at in range(0, len(own), 256):
        mine = own[at : at + 256]
        for begin in range(at, len(both), 1024):
            theirs = both[begin : begin + 1024]
            i, j = np.nonzero(np.bitwise_count(mine[:, None] ^ theirs[None, :]) <= radius)
            for a, b in zip((i + at).tolist(), (j + begin).tolist()):
                if a < b and (x := root(a)) != (y := root(b)):
                    parent[y] = x
                    out.append((a, b))
    signed = both.view(np.int64)
    return [(int(signed[a]), int(signed[b])) for a, b in out]


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links a, b between fingerprints (column fp, distinct rows) that differ in `radius` bits or fewer, as spanning forests."""
    word = lambda k: F.bit_count(F.shiftrightunsigned("fp", 48 - 16 * k).bitwiseAND(F.lit(0xFFFF)))
    # five bits a count, with room so that a step of `radius` up or down never reaches the next count
    celled = distinct.withColumn("cell", sum(((word(k) + 8).cast("int") * F.lit(1 << (15 - 5 * k)) for k in range(4)), F.lit(0)))
    # at most 17**4 = 83,521 cells exist, whatever the input: a proven bound for the broadcast
    directory = stored(celled.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")), "cells")
    parts = -(-(directory.agg(F.max("tiles")).first()[0] or 1) // TILES_AT_ONCE)
    tiles = (
        celled.join(F.broadcast(directory), "cell")
        .withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
        .groupBy("cell", "chunk")
        .agg(F.collect_list("fp").alias("members"))
    )
    steps = [x for x in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, x)) <= radius]
    offsets = sorted({o for x in steps if (o := sum(v << (15 - 5 * k) for k, v in enumerate(x))) <= 0})
    to = directory.select(F.col("cell").alias("to_cell"), F.col("tiles").alias("to_tiles"))
    sent = (
        tiles.withColumn("to_cell", F.explode(F.array(*(F.col("cell") + o for o in offsets))))
        .join(F.broadcast(to), "to_cell")
        .withColumn("to_chunk", F.explode(F.sequence(F.lit(0), F.col("to_tiles") - 1)))
        .where("to_cell < cell or to_chunk <= chunk")
    )
    itself = (F.col("cell") == F.col("to_cell")) & (F.col("chunk") == F.col("to_chunk"))
    sent = sent.withColumn("part", F.explode(F.when(itself, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.floor(F.col("chunk") / TILES_AT_ONCE).cast("int")))))
    met = sent.groupBy("to_cell", "to_chunk", "part").agg(
        F.flatten(F.collect_list(F.when(itself, F.col("members")))).alias("own"),
        F.flatten(F.collect_list(F.when(~itself, F.col("members")))).alias("others"),
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for own, others in zip(pdf["own"], pdf["others"]):
                out += _forest(np.array(own, np.int64).view(np.uint64), np.array(others, np.int64).view(np.uint64), radius)
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return met.select("own", "others").mapInPandas(compare, "a long, b long")


def _marked(docs: DataFrame, radius: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp of every row; fp, least doc_id, root of every fingerprint). root: the fingerprint that stands for the group."""
    marked = stored(fingerprints(docs), "fingerprints")
    least = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(least.select("fp"), radius, tile))
    return marked, least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def classes(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """doc_id, fp, component_id of every document."""
    marked, rooted = _marked(docs, radius, tile)
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(rooted.join(lowest, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: that of the smallest doc_id (rows without one come last), then of the
    smallest fingerprint. Rows are told apart by doc_id and fingerprint, so rows that share a doc_id but not a text are judged each; of rows
    alike in both one stays."""
    marked, rooted = _marked(docs, radius, tile)
    # the first row of a group follows from its distinct fingerprints, by a minimum that is taken before the exchange: no key holds a group
    key = F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("doc_id"), "fp")
    first = stored(rooted.groupBy("root").agg(F.min(key).alias("key")).select("key.doc_id", "key.fp"), "first")
    twice = stored(marked.groupBy("doc_id", "fp").count().where("count > 1").select("doc_id", "fp"), "twice")
    for done in (marked, rooted):
        drop_stored(done)
    mark = f"_fp_{uuid.uuid4().hex}"
    own = _with_fingerprint(docs, mark)
    same = lambda keys: own["doc_id"].cast("long").eqNullSafe(keys["doc_id"]) & (own[mark] == keys["fp"])
    # what stays grows with the corpus, so it is merged with the documents and never broadcast
    kept = own.join(first.hint("merge"), same(first), "left_semi")
    if twice.isEmpty():
        return kept.drop(mark)
    once = kept.join(twice.hint("merge"), same(twice), "left_semi").dropDuplicates(["doc_id", mark])
    return kept.join(twice.hint("merge"), same(twice), "left_anti").unionByName(once).drop(mark)


def _with_fingerprint(docs: DataFrame, name: str) -> DataFrame:
    """The documents with a column of their fingerprints; texts stay in their tasks."""
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fp = np.fromiter((fingerprint(t or "") for t in batch.column(at).to_pylist()), np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp)], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))
