"""Sharding by extendible hashing, with DataFrame operations alone.

A directory is indexed by the leading bits of a hash of the key. It starts with one bucket; only buckets over the byte limit split on
another bit, until each fits. A document's shard is the shortest prefix of its hash whose bucket fits.

Odd input: a null text has 0 bytes; a null key is hashed as an empty string; rows of one key can't be told apart by bits and share a shard,
which is marked `oversized` if they exceed the limit together or one text does alone; an empty table gives an empty result; other columns
are ignored by `assign` and kept by `write`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from .shared import stored

#: Bits of the hash, and by how many a directory is refined at once.
HASH_BITS, REFINE = 60, 6
#: Levels of the directory that are summed at once; a group has two to this power members at most.
LEVELS = 4
LIMIT_BYTES = 1 << 20


def key_hash(key: Column) -> Column:
    """The first 60 bits of the key's MD5, as a number."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")


def prefix(bits) -> Column:
    return F.expr(f"shiftright(h, {HASH_BITS} - {bits})")


def _settled(sums: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """leaf (prefix of `high` bits), depth, shard_bytes: the shortest prefix from `low` bits on that fits; null where none does.

    Sums rise from the leaves, some levels at a time, so a group has 2**LEVELS members at most; each member's shortest prefix within these
    levels is found in the group's row. On the way down a prefix that fits already, further up, goes before."""
    empty = "array_max(transform(array(0), z -> cast(null as struct<depth:int,bytes:bigint>)))"
    steps, at, here = [], high, sums.select(F.col("leaf").alias("node"), "bytes")
    while at > low or not steps:
        top = max(low, at - LEVELS)
        inner = "aggregate(filter(members, m -> shiftright(m.node, {h} - d) = shiftright(c.node, {h} - d)), 0L, (a, m) -> a + m.bytes)".format(h=at)
        fits = f"filter(transform(sequence({top}, {at}), d -> named_struct('depth', d, 'bytes', {inner})), s -> s.bytes <= {limit})"
        grouped = here.groupBy(F.expr(f"shiftright(node, {at - top})").alias("parent")).agg(F.collect_list(F.struct("node", "bytes")).alias("members"), F.sum("bytes").alias("bytes"))
        # checkpointed by a table: it is read on the way up and on the way down
        grouped = stored(grouped.select("parent", "bytes", F.expr(f"transform(members, c -> named_struct('node', c.node, 'bytes', c.bytes, 'best', coalesce(get({fits}, 0), {empty})))").alias("members")), "levels")
        steps.append(grouped)
        at, here = top, grouped.select(F.col("parent").alias("node"), "bytes")
    found = None
    for grouped in reversed(steps):
        row = grouped.select("parent", F.explode("members").alias("m")) if found is None else grouped.join(found.hint("merge"), "parent").select("parent", "above", F.explode("members").alias("m"))
        best = F.col("m.best") if found is None else F.coalesce("above", "m.best")
        found = row.select(F.col("m.node").alias("parent"), best.alias("above"), F.col("m.bytes").alias("bytes"))
    return found.select(F.col("parent").alias("leaf"), F.col("above.depth").alias("depth"), F.coalesce("above.bytes", "bytes").alias("shard_bytes"))


def assign(docs: DataFrame, limit: int = LIMIT_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id (the key), n_bytes, shard (its prefix as binary digits), depth, shard_bytes, oversized.

    One pass over the texts; what follows works on hashes and sizes. A pass refines the buckets that are still too large by some bits:
    its sums have about (bytes / limit) * 2**REFINE rows, and rows reach it pre-aggregated, so no key or source is hot. The directory grows with the table (a few
    rows for each shard), so it is merged with the hashes and never broadcast."""
    sized = stored(docs.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long").alias("n_bytes"), key_hash(F.col(f"`{key}`")).alias("h")), "sizes")
    total = sized.agg(F.sum("n_bytes")).first()[0] or 0
    low, out, rest = 0, None, sized
    high = min(HASH_BITS, max(1, (-(-total // limit)).bit_length() + REFINE))
    while True:
        here = rest.withColumn("leaf", prefix(high))
        leaves = stored(_settled(here.groupBy("leaf").agg(F.sum("n_bytes").alias("bytes")), low, high, limit), "directory")
        last = high >= HASH_BITS
        found = here.join((leaves if last else leaves.where("depth is not null")).hint("merge"), "leaf").select("doc_id", "n_bytes", "h", F.coalesce("depth", F.lit(HASH_BITS)).alias("depth"), "shard_bytes")
        out = found if out is None else out.unionByName(found)
        too_large = leaves.where("depth is null")
        if last or too_large.isEmpty():
            break
        rest = stored(here.join(too_large.select("leaf").hint("merge"), "leaf", "left_semi").select("doc_id", "n_bytes", "h"), "oversized")
        low, high = high + 1, min(HASH_BITS, high + REFINE)
    return out.select(
        "doc_id",
        "n_bytes",
        F.expr(f"if(depth = 0, '', lpad(bin(shiftright(h, {HASH_BITS} - depth)), depth, '0'))").alias("shard"),
        F.col("depth").cast("long").alias("depth"),
        F.col("shard_bytes").cast("long").alias("shard_bytes"),
        (F.col("shard_bytes") > limit).alias("oversized"),
    )


def write(docs: DataFrame, path: str, limit: int = LIMIT_BYTES) -> None:
    """Write the documents with a column `shard` (one that they have already is replaced), one folder a shard; rows without doc_id go where
    an empty key goes. Rows are dealt by shard, each of bounded size."""
    key = f"_key_{uuid.uuid4().hex}"
    shards = assign(docs, limit).select(F.col("doc_id").alias(key), "shard").distinct()
    dealt = docs.drop("shard").join(shards, F.col("doc_id").eqNullSafe(F.col(key))).drop(key)
    dealt.withColumn("shard", F.concat(F.lit("p"), "shard")).repartition("shard").write.partitionBy("shard").parquet(path)


def oracle(limit: int = LIMIT_BYTES) -> str:
    return f"""
    WITH k AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
                      CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
    d AS (SELECT unnest(range(0, {HASH_BITS + 1}))::BIGINT AS depth),
    b AS (SELECT depth, h >> (60 - depth)::INTEGER AS bucket, sum(n_bytes)::BIGINT AS bucket_bytes FROM k, d GROUP BY ALL),
    a AS (SELECT doc_id, n_bytes, h, min(d.depth) AS depth FROM k, d JOIN b ON b.depth = d.depth AND b.bucket = h >> (60 - d.depth)::INTEGER
          WHERE bucket_bytes <= {limit} OR d.depth = {HASH_BITS} GROUP BY ALL)
    SELECT doc_id, n_bytes, CASE WHEN a.depth = 0 THEN '' ELSE lpad(bin(h >> (60 - a.depth)::INTEGER), a.depth::INTEGER, '0') END AS shard,
           a.depth, bucket_bytes AS shard_bytes, bucket_bytes > {limit} AS oversized
    FROM a JOIN b ON b.depth = a.depth AND b.bucket = h >> (60 - a.depth)::INTEGER"""
