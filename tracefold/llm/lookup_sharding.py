"""Sharding by a permutation-filled lookup table.

Every shard has an order of preference over the slots of a table of prime
size, ``(offset + j * step) mod size`` with both numbers hashed from its name.
Shards take turns; in its turn a shard claims its most preferred free slot,
until no slot is left.  Shards then own equal numbers of slots (within one),
and adding or removing a shard moves few slots.  The filled table has ``size``
rows whatever the data; it is broadcast, and a row finds its shard by one
probe at ``hash(key) mod size``.

Weighted shards take a turn as soon as their accumulated weight reaches one.

Defined results: a null key has no slot and no shard; repeated rows share a
shard; extra columns stay (``slot`` and ``shard`` are replaced if present).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def number(text: str) -> int:
    """The first 15 hexadecimal digits of the MD5 sum; the same number as ``hashed`` gives."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def hashed(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], size: int, weights: list[float] | None = None) -> list[int]:
    """The shard index in each slot.  ``size`` is prime and at least the number of shards."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("the table size must be a prime, not below the number of shards")
    most = max(weights) if weights else 1.0
    if weights and min(weights) <= 0:
        raise ValueError("weights must be positive")
    at = [number(f"{s}|offset") % size for s in shards]
    step = [number(f"{s}|step") % (size - 1) + 1 if size > 2 else 1 for s in shards]
    owed = [0.0] * len(shards)
    table, free = [-1] * size, size
    while True:
        for k in range(len(shards)):
            if weights:
                owed[k] += weights[k] / most
                if owed[k] < 1:
                    continue
                owed[k] -= 1
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % size
            table[at[k]] = k
            free -= 1
            if not free:
                return table


def lookup(spark: SparkSession, shards: list[str], size: int, weights: list[float] | None = None) -> DataFrame:
    """The table as rows ``slot`` and ``shard`` (a constant in the plan)."""
    filled = ",".join(map(str, fill_table(shards, size, weights)))
    names = F.split(F.lit("\n".join(shards)), "\n")
    rows = spark.range(1, numPartitions=1).select(F.posexplode(F.split(F.lit(filled), ",")).alias("slot", "_k"))
    return rows.select(F.col("slot").cast("long").alias("slot"), F.element_at(names, F.col("_k").cast("int") + 1).alias("shard"))


def place(rows: DataFrame, key_col: str, shards: list[str], size: int, weights: list[float] | None = None) -> DataFrame:
    """``rows`` with ``slot`` and ``shard``; no row moves, only the table of ``size`` rows is broadcast."""
    table = lookup(rows.sparkSession, shards, size, weights)
    slotted = rows.drop("slot", "shard").withColumn("slot", F.pmod(hashed(F.col(key_col)), F.lit(size)))
    return slotted.join(F.broadcast(table), "slot", "left").select(*[c for c in slotted.columns if c != "slot"], "slot", "shard")


def table_sql(names_sql: str, size: int) -> str:
    """DuckDB SQL (the body of ``WITH RECURSIVE``) that fills the same table, without weights.

    ``names_sql`` gives ``k`` (from 0) and ``name`` of each shard.  Each step of
    the recursion is one turn: the shard's first preference not yet taken.
    """
    digits = lambda what: f"('0x' || substr(md5(name || '|{what}'), 1, 15))::BIGINT"
    return f"""
names AS ({names_sql}),
ways AS (SELECT k, {digits("offset")} % {size} AS o, {digits("step")} % {size - 1} + 1 AS s FROM names),
counted AS (SELECT count(*) AS n FROM names),
turns(t, slot, taken) AS (
  SELECT 0::BIGINT, o, set_bit(repeat('0', {size})::BIT, o::INT, 1) FROM ways WHERE k = 0
  UNION ALL
  SELECT t + 1, got, set_bit(taken, got::INT, 1) FROM (
    SELECT t, taken, (w.o + w.s * list_min(list_filter(range(0, {size}), lambda j: get_bit(taken, ((w.o + w.s * j) % {size})::INT) = 0))) % {size} AS got
    FROM turns, counted, ways w WHERE w.k = (t + 1) % n AND t + 1 < {size}
  )
)"""
