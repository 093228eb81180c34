"""Sharding by a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table (an
arithmetic progression modulo the prime, with start and step hashed from the
shard's name).  The shards take turns; in its turn a shard claims the first
slot of its order that is still free.  All shards end up with as many slots,
give or take one, and adding or removing a shard moves few of the others'.

A row's slot is its key's hash modulo the table's size, so placing a row is
one probe of a broadcast table whose size is the parameter ``table_size``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.llm.textops import keyed_hash, without

#: Slots of the table: a prime, some hundred times the number of shards.
TABLE_SIZE = 65537
#: Largest table that is broadcast (slot and shard: 12 bytes a row).
MAX_TABLE_SIZE = 4_194_301

OUTPUT = ("slot", "shard")


def _hash(kind: str, name: str) -> int:
    return int.from_bytes(hashlib.md5(f"{kind}|{name}".encode()).digest()[:8], "big")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill_table(names: list[str], table_size: int = TABLE_SIZE) -> list[int]:
    """For each slot the index of the shard that claims it."""
    if not names or len(set(names)) < len(names):
        raise ValueError("shards need distinct names, one at least")
    if not is_prime(table_size) or not len(names) <= table_size <= MAX_TABLE_SIZE:
        raise ValueError(f"the table's size must be a prime from the number of shards to {MAX_TABLE_SIZE}")
    step = [_hash("step", n) % (table_size - 1) + 1 for n in names]
    at = [_hash("start", n) % table_size for n in names]
    table, free = [-1] * table_size, table_size
    while True:
        for shard in range(len(names)):
            slot = at[shard]
            while table[slot] >= 0:
                slot = (slot + step[shard]) % table_size
            table[slot], at[shard] = shard, (slot + step[shard]) % table_size
            free -= 1
            if not free:
                return table


def table_frame(spark: SparkSession, table: list[int]) -> DataFrame:
    """(slot, shard) made in the JVM from one binary literal of four bytes a
    slot: no Python rows, no RDD."""
    packed = F.lit(bytearray(b"".join(x.to_bytes(4, "big") for x in table)))
    entry = F.conv(F.hex(F.substring(packed, F.col("id") * 4 + 1, F.lit(4))), 16, 10)
    return spark.range(len(table)).select(F.col("id").alias("slot"), entry.cast("int").alias("shard"))


def slot_of(id_col: str, text_col: str | None, table_size: int, seed: str):
    """A row's slot. Rows whose key is null are spread by their text, so that
    many of them don't meet in one shard."""
    key = F.col(id_col).cast("string")
    if text_col:
        key = F.coalesce(key, F.concat(F.lit("text "), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    return F.pmod(keyed_hash(seed, key), F.lit(table_size)).cast("long")


def assign_shards(
    df: DataFrame, names: list[str], *, id_col: str = "doc_id", text_col: str | None = "text", table_size: int = TABLE_SIZE, seed: str = "shard"
) -> DataFrame:
    """Every row of df with its slot and shard (index into names).

    Defined results: equal keys share a shard; null keys go by text_col (null
    text like empty text), or all to one slot if text_col is None; an empty
    table stays empty; input columns named slot or shard are replaced.
    """
    table = table_frame(df.sparkSession, fill_table(names, table_size))
    rows = without(df, OUTPUT).withColumn("slot", slot_of(id_col, text_col, table_size, seed))
    return rows.join(F.broadcast(table), "slot", "left").select(*without(df, OUTPUT).columns, "slot", "shard")


def write_shards(sharded: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """Writes (..., slot, shard) as Parquet, one folder per shard;
    files_per_shard tasks write each, so a large shard isn't one task.

    Null shards go to the folder of null values; repeated rows stay; a shard
    without rows has no folder, and an empty table none; other columns are
    written as they are; it is an error if path exists.
    """
    salt = F.pmod(F.xxhash64("slot"), F.lit(files_per_shard))
    sharded.repartition("shard", salt).write.partitionBy("shard").parquet(path)


N_SHARDS, SEED = 64, "shard-1"
NAMES = [f"shard-{k:05d}" for k in range(N_SHARDS)]


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assign_shards(docs.select("doc_id", "text"), NAMES, seed=SEED).select("doc_id", "slot", "shard")


def oracle() -> str:
    """The table goes in as a literal, two hexadecimal digits a slot; that it
    is filled as it should be is tested apart."""
    digits = "".join(f"{x:02x}" for x in fill_table(NAMES))
    return f"""
WITH d AS (
  SELECT doc_id, ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, '')))), 1, 15))::BIGINT % {TABLE_SIZE} AS slot
  FROM documents)
SELECT doc_id, slot, ('0x' || substr('{digits}', (2 * slot + 1)::INTEGER, 2))::INTEGER AS shard FROM d
"""
