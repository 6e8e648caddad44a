"""Sharding by a hypergeometric communication matrix.

A uniform shuffle of N rows held by P partitions into S shards of fixed sizes
sends, from partition to shard, a random matrix of row counts with given
margins. This draws that matrix first, row by row, from the multivariate
hypergeometric law; each partition then permutes its rows by a keyed hash and
deals them out by those counts, the rows are exchanged, and each shard permutes
what it received. Shard sizes are exact and at most one apart.

Only DataFrame operations touch rows. The driver holds P counts and P x S cells,
with P at most ``MAX_PARTS``.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, new_name, table

MAX_PARTS = 4096
#: Rows that a logical partition holds until MAX_PARTS is reached.
PART_ROWS = 100_000
LEAST_PARTS = 64
#: A second-permutation bucket is a random 1/16 or less of a shard.
LEAST_BUCKETS, MAX_BUCKETS = 16, 1024


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` rows taken without replacement are among ``good``.

    Inversion that walks outwards from the mode, so that it takes about one
    standard deviation of steps whatever the size of the population.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    p = math.exp(_log_choose(good, mode) + _log_choose(bad, draws - mode) - _log_choose(good + bad, draws))
    u = rng.random() - p
    left, right, p_left, p_right = mode, mode, p, p
    while u > 0 and (left > low or right < high):
        if right < high:
            p_right *= (good - right) * (draws - right) / ((right + 1) * (bad - draws + right + 1))
            right += 1
            u -= p_right
            if u <= 0:
                return right
        if left > low:
            p_left *= left * (bad - draws + left) / ((good - left + 1) * (draws - left + 1))
            left -= 1
            u -= p_left
            if u <= 0:
                return left
        if p_left < 1e-300 and p_right < 1e-300:
            break
    return mode


def communication_matrix(part_rows: list[int], shard_rows: list[int], seed: int) -> list[list[int]]:
    """Counts from each partition to each shard, with exactly these margins."""
    rng, free, out = random.Random(seed), list(shard_rows), []
    for rows in part_rows:
        row, left, pool = [], rows, sum(free)
        for k, room in enumerate(free):
            pool -= room
            n = hypergeometric(rng, room, pool, left)
            row.append(n)
            free[k] -= n
            left -= n
        out.append(row)
    return out


def shard_sizes(rows: int, n_shards: int) -> list[int]:
    return [rows // n_shards + (k < rows % n_shards) for k in range(n_shards)]


def _literal(df: DataFrame, value: object, kind: str) -> DataFrame:
    """A small table from a literal, without leaving SQL."""
    return df.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(value)), f"array<struct<{kind}>>")).alias("r")).select("r.*")


def _spread(df: DataFrame, h: str, most: int) -> DataFrame:
    """``df`` with another digest for every ``most`` rows that have the same one.

    Equal rows are numbered in two steps, within the partition where they lie and
    by the partitions before it, so that no task sees them all. At most
    MAX_PARTS digests are that frequent.
    """
    many = df.groupBy(h).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(h)
    many = materialize(many, "shards-many")
    if many.isEmpty():
        discard(many)
        return df
    place, at = new_name(df, "_place"), new_name(df, "_at")
    held = materialize(df.join(F.broadcast(many), h, "left_semi").withColumn(place, F.spark_partition_id()), "shards-equal")
    sums = held.groupBy(h, place).agg(F.count(F.lit(1)).alias(at))  # a row for each frequent digest and partition
    before = sums.select(h, place, (F.sum(at).over(Window.partitionBy(h).orderBy(place)) - F.col(at)).alias(at))
    number = F.col(at) + F.row_number().over(Window.partitionBy(h, place).orderBy(h)) - 1
    numbered = held.join(before, [h, place]).withColumn(h, F.xxhash64(h, F.floor(number / most))).select(*df.columns)
    return df.join(F.broadcast(many), h, "left_anti").select(*df.columns).unionAll(numbered)


def shuffle_into_shards(df: DataFrame, n_shards: int = 16, seed: int = 20240229, key: str = "doc_id") -> DataFrame:
    """All rows of ``df`` with two more columns: ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in its shard).

    The order is a function of the rows and the seed, not of how they are
    partitioned. Nulls count as values; rows that are equal in every column are
    interchangeable, so ties among them change nothing; very many of them are
    spread like different rows. An empty table gives an empty result. Existing
    columns named shard or slot are replaced; helper columns get names that do
    not clash.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    df = df.drop("shard", "slot")
    part, h, rank, cum, bucket, at = (new_name(df, f"_{x}") for x in ("part", "h", "rank", "cum", "bucket", "at"))
    plain = [c for c, t in df.dtypes if not t.startswith(("map", "variant", "interval"))]
    digest = F.xxhash64(F.lit(seed), *[F.col(c) for c in plain])
    n = df.count()
    parts = min(MAX_PARTS, max(LEAST_PARTS, -(-n // PART_ROWS)))
    dealt = _spread(df.withColumn(h, digest), h, max(PART_ROWS, -(-n // MAX_PARTS))).withColumn(part, F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key) if key in df.columns else F.col(h), F.col(h)), F.lit(parts)).cast("int"))
    held = dict(dealt.groupBy(part).count().collect())  # at most MAX_PARTS rows
    matrix = communication_matrix([held.get(p, 0) for p in range(parts)], shard_sizes(sum(held.values()), n_shards), seed)
    bounds = _literal(df, [{part: p, cum: [sum(row[: k + 1]) for k in range(n_shards)]} for p, row in enumerate(matrix)], f"`{part}` int, `{cum}` array<bigint>")
    order: list[Column] = [F.col(h), *[F.col(c) for c in plain if c == key]]
    # Rows of one digest lie in one partition; each gets a key of its own, so that the permutation is of rows.
    like = Window.partitionBy(part).orderBy(h)
    twin = F.row_number().over(like) - F.rank().over(like)
    dealt = dealt.withColumn(rank, twin).withColumn(h, F.when(F.col(rank) == 0, F.col(h)).otherwise(F.xxhash64(h, rank))).drop(rank)
    local = dealt.withColumn(rank, F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    # The broadcast side is at most MAX_PARTS x n_shards numbers.
    sent = local.join(F.broadcast(bounds), part).withColumn("shard", F.size(F.filter(F.col(cum), lambda x: x < F.col(rank))).cast("int"))
    buckets = min(MAX_BUCKETS, max(LEAST_BUCKETS, -(-parts // n_shards)))
    mixed = F.xxhash64(F.lit(seed + 2), F.col(h))
    sent = materialize(sent.withColumn(bucket, F.pmod(mixed, F.lit(buckets)).cast("int")).drop(part, rank, cum), "shards")
    sums = sent.groupBy("shard", bucket).agg(F.count(F.lit(1)).alias(at))
    before = F.sum(at).over(Window.partitionBy("shard").orderBy(bucket)) - F.col(at)
    starts = sums.select("shard", bucket, before.alias(at))  # at most n_shards x MAX_BUCKETS rows
    again = [F.xxhash64(F.lit(seed + 3), F.col(h)), *order]
    within = F.row_number().over(Window.partitionBy("shard", bucket).orderBy(*again)) - 1
    return sent.join(F.broadcast(starts), ["shard", bucket]).withColumn("slot", (F.col(at) + within).cast("long")).select(*df.columns, "shard", "slot")


def op9_shards(spark, sf_dir: str) -> DataFrame:
    """Every document's shard among 16 under the law ``rows``; a null text counts as no bytes."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    out = shuffle_into_shards(slim, 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
