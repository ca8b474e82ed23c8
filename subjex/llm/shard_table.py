"""Sharding by a permutation-filled lookup table.

Method. Every shard has its own order of preference over the slots of a
prime-sized table, from two hashes of its name. Shards take turns, each
claiming its next free slot (a shard of weight w gets w turns a round), until
the table is full. A document's slot is its key's hash modulo the table size;
the broadcast table gives its shard in constant time. Adding or removing a
shard moves few documents beyond those it must.

Bounds. The table has ``size`` rows whatever the corpus. Placing is one pass
without a shuffle. Writing deals each shard's rows over as many parts as the measured
size of the texts asks for, ``PART_BYTES`` each, by a hash of key and text: a hot key (a
repeated doc_id) spreads over the parts, and only rows equal in both share one.

Defined results. A null key is placed by the hash of its text. Rows that repeat
a key share a shard. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subjex.llm.common import shared_path, text_or_empty

SIZE = 65_537
#: Text in one part of a shard.
PART_BYTES = 128 << 20


def _hashes(name: str) -> tuple[int, int]:
    raw = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:16], "little")


def fill(shards: dict[str, int], size: int = SIZE) -> list[str]:
    """The shard of each slot; ``size`` is prime and larger than the sum of the weights."""
    if not shards or any(size % k == 0 for k in range(2, int(size**0.5) + 1)) or size < sum(shards.values()) or any(w < 1 for w in shards.values()):
        raise ValueError("a prime table needs shards of positive weight, and a slot for each turn of a round")
    names = sorted(shards)
    at = {n: _hashes(n)[0] % size for n in names}
    step = {n: _hashes(n)[1] % (size - 1) + 1 for n in names}
    table: list[str | None] = [None] * size
    left = size
    while left:
        for n in names:
            for _ in range(min(shards[n], left)):
                while table[at[n]] is not None:
                    at[n] = (at[n] + step[n]) % size
                table[at[n]] = n
                left -= 1
    return table


def table_frame(spark: SparkSession, shards: dict[str, int], size: int = SIZE) -> DataFrame:
    return spark.createDataFrame(list(enumerate(fill(shards, size))), "slot int, shard string").coalesce(1)


def place(docs: DataFrame, shards: dict[str, int], key: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """``docs`` with ``slot`` and ``shard`` (input columns of these names give way)."""
    docs = docs.drop(*({"slot", "shard"} - {key, text_col}))
    hashed = F.when(F.col(key).isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(text_or_empty(text_col)))
    slots = docs.withColumn("slot", F.pmod(hashed, F.lit(size)).cast("int"))
    return slots.join(F.broadcast(table_frame(docs.sparkSession, shards, size)), "slot")  # ``size`` rows


def write_shards(placed: DataFrame, path: str | None = None, parts: int | None = None, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write one folder per shard, each in ``parts`` parts (or as many as its share of all text fills), and read them back."""
    spark = placed.sparkSession
    path = path or shared_path(spark, "shards")
    size, shards = placed.groupBy("shard").agg(F.sum(F.octet_length(text_or_empty(text_col))).alias("n")).agg(F.max("n"), F.count("*")).first()
    parts = parts or max(1, -(-int(size or 0) // PART_BYTES))
    part = F.pmod(F.xxhash64(F.lit(3), text_or_empty(text_col), key), F.lit(parts))
    # as many tasks as there are pairs of shard and part, dealt by a hash of the pair
    placed.repartition(max(1, shards * parts), "shard", part).write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return spark.read.schema(placed.schema).parquet(path)
