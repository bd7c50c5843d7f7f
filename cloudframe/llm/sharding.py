"""Sharding by a permutation-filled lookup table.

Every shard has a preference order of the slots of a prime-sized table: a permutation made
from its name by an offset and a step. The shards take turns and each claims the first slot
of its order that is still free. A key's hash picks a slot, the slot names the shard. When a
shard goes, its slots are dealt to the others and few other slots change hands.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudframe.llm.shared import own_columns, unused

#: The table's size bounds what is broadcast: at most this many rows of (int, int).
MAX_TABLE_SIZE = 1_048_573
TABLE_SIZE = 65_537


def _number(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], table_size: int = TABLE_SIZE) -> np.ndarray:
    """For each slot the index of its shard in `shards`.

    The order of turns is that of the sorted names, so the order in the list doesn't matter.
    """
    if not is_prime(table_size) or table_size > MAX_TABLE_SIZE:
        raise ValueError(f"table_size must be a prime of at most {MAX_TABLE_SIZE}")
    if not shards or len(set(shards)) != len(shards) or len(shards) > table_size:
        raise ValueError("shards must be distinct names, at least one and at most one a slot")
    order = sorted(range(len(shards)), key=lambda k: shards[k])
    at = [_number(f"offset:{shards[k]}") % table_size for k in order]
    step = [_number(f"step:{shards[k]}") % (table_size - 1) + 1 for k in order]
    table, left = np.full(table_size, -1, dtype=np.int32), table_size
    while left:
        for turn, shard in enumerate(order):
            slot = at[turn]
            while table[slot] >= 0:
                slot = (slot + step[turn]) % table_size
            table[slot] = shard
            at[turn] = (slot + step[turn]) % table_size
            left -= 1
            if not left:
                break
    return table


def assign_shards(df: DataFrame, shards: list[str], key_col: str = "doc_id", table_size: int = TABLE_SIZE) -> DataFrame:
    """Add slot (int) and shard (string) to every row of df, by key_col.

    The lookup table is broadcast; its size is that of the table, never that of the data,
    so rows are placed where they are read, without a shuffle, and a key that a third of
    the rows share makes no difference. Equal keys get equal shards. A null key has a slot
    of its own kind (that of the text "null key"). Columns slot and shard are replaced.
    """
    spark = df.sparkSession
    table = lookup_table(shards, table_size)
    at, name = unused(df.columns, "slot", "shard")
    lookup = spark.createDataFrame(pd.DataFrame({at: np.arange(table_size, dtype=np.int32), name: [shards[k] for k in table]}), f"{at} int, {name} string")
    key = F.coalesce(F.concat(F.lit("k"), F.col(key_col).cast("string")), F.lit("null key"))
    slot = (F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint") % table_size).cast("int")
    placed = df.withColumn(at, slot).join(F.broadcast(lookup), at)
    return placed.select(*own_columns(df, "slot", "shard"), F.col(at).alias("slot"), F.col(name).alias("shard"))


def oracle(shards: list[str]) -> str:
    """The query over `documents` in DuckDB's SQL: the table as a list, a slot by the key's hash."""
    table = ",".join(map(str, lookup_table(shards)))
    names = ",".join(f"'{s}'" for s in shards)
    key = "coalesce('k' || doc_id::VARCHAR, 'null key')"
    return f"""WITH placed AS (SELECT doc_id, (('0x' || substr(md5({key}), 1, 15))::BIGINT % {TABLE_SIZE})::INT AS slot FROM documents),
lookup AS (SELECT [{table}] AS owner, [{names}] AS name)
SELECT doc_id, slot, name[owner[slot + 1] + 1] AS shard FROM placed, lookup"""
