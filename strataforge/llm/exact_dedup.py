"""Exact deduplication through a sharded minimal perfect hash of historical digests.

``history_index`` keeps one row per shard of the historical distinct SHA-256 digests: the level
bit arrays of a minimal perfect hash, and slots that hold the full digest and the winner's
locator. ``exact_dedup`` reduces the rows of each part to one per digest (partial aggregation:
a group of copies never meets in one task), looks the incoming digests up (a slot answers only
for equal digest bytes) and groups the nonmembers separately.

Defined cases: a null text equals the empty text; a null id loses against any other; repeated
rows form one group, of which one row stays (the last in file order among equal ids); an empty
table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.llm.store import RID, P, identified, is_scan, materialize, partitions, with_group

_HISTORY = f"{P}shard int, levels array<binary>, digests binary, winners binary"
#: Digests per shard that the number of shards aims at.
SHARD_DIGESTS = 1 << 15


def _positions(digests: np.ndarray, level: int, size: int) -> np.ndarray:
    """The bit of each digest at a level: words of the digest, mixed with the level's number."""
    word = digests[:, 8 * (level % 3) : 8 * (level % 3) + 8].copy().view(np.uint64)[:, 0]
    word = (word ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    word ^= word >> np.uint64(29)
    return ((word * np.uint64(0x94D049BB133111EB)) >> np.uint64(11)) % np.uint64(size)


def build_levels(digests: np.ndarray) -> list[np.ndarray]:
    """Bit arrays in which each distinct digest (n x 32 bytes) owns exactly one bit."""
    levels, left = [], digests
    while len(left):
        at = _positions(left, len(levels), len(left))
        alone = np.bincount(at.astype(np.int64), minlength=len(left)) == 1
        levels.append(alone)
        left = left[~alone[at.astype(np.int64)]]
    return levels


def slots(digests: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Slot numbers 0..n-1 of members; what isn't a member gets any slot, or -1."""
    out = np.full(len(digests), -1, np.int64)
    left, base = np.arange(len(digests)), 0
    for k, bits in enumerate(levels):
        at = _positions(digests[left], k, len(bits)).astype(np.int64)
        rank = base + np.cumsum(bits) - 1
        hit = bits[at]
        out[left[hit]] = rank[at[hit]]
        left, base = left[~hit], base + int(bits.sum())
    return out


def _column(table: pa.Table, name: str, kind: type = np.int64) -> np.ndarray:
    return np.asarray(table[name].to_numpy(), kind)


def _digest_array(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table[f"{P}digest"].to_pylist()), np.uint8).reshape(-1, 32)


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64(f"{P}digest"), F.lit(shards)).cast("int")


def history_index(groups: DataFrame, shards: int) -> DataFrame:
    """The sharded perfect hash of ``groups``, one row (digest, winner) per distinct digest."""

    def build(table: pa.Table) -> pa.Table:
        digests = _digest_array(table)
        levels = build_levels(digests)
        order = np.empty(len(digests), np.int64)
        order[slots(digests, levels)] = np.arange(len(digests))
        sizes = np.array([len(x) for x in levels], np.int64).tobytes()
        return pa.table({
            f"{P}shard": pa.array([table[f"{P}shard"][0].as_py()], pa.int32()),
            "levels": pa.array([[sizes, *(np.packbits(x).tobytes() for x in levels)]], pa.list_(pa.binary())),
            "digests": pa.array([digests[order].tobytes()], pa.binary()),
            "winners": pa.array([_column(table, f"{P}winner")[order].tobytes()], pa.binary()),
        })

    return groups.withColumn(f"{P}shard", _shard(shards)).groupBy(f"{P}shard").applyInArrow(build, _HISTORY)


def lookup(incoming: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """``incoming`` distinct digests with ``member``: the locator in the slot whose bytes are equal."""

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        locators, member = np.zeros(len(left), np.int64), np.zeros(len(left), bool)
        if len(left) and len(right):
            sizes, *packed = right["levels"][0].as_py()
            levels = [np.unpackbits(np.frombuffer(x, np.uint8), count=int(n)).astype(bool) for x, n in zip(packed, np.frombuffer(sizes, np.int64), strict=True)]
            wanted, held = _digest_array(left), np.frombuffer(right["digests"][0].as_py(), np.uint8).reshape(-1, 32)
            at = slots(wanted, levels)
            member = (at >= 0) & (held[np.maximum(at, 0)] == wanted).all(axis=1)
            locators[member] = np.frombuffer(right["winners"][0].as_py(), np.int64)[at[member]]
        return left.select([f"{P}digest", f"{P}winner", f"{P}size"]).append_column(f"{P}member", pa.array(locators, mask=~member))

    left = incoming.withColumn(f"{P}shard", _shard(shards)).groupBy(f"{P}shard")
    return left.cogroup(index.groupBy(f"{P}shard")).applyInArrow(find, f"{P}digest binary, {P}winner long, {P}size long, {P}member long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, historical: Column | None = None, scan: bool | None = None) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256 (and its identity).

    ``historical`` marks the rows that the index is built over (by default every other file row,
    so both paths do their work); the rest are the incoming ones. The row with the largest id of
    all equal texts stays, whichever part it is in.
    """
    scan = is_scan(docs) if scan is None else scan
    spark = docs.sparkSession
    rows = identified(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *([historical.alias(f"{P}old")] if historical is not None else []), *(["_metadata"] if scan else [])), "doc_id", "text", *([f"{P}old"] if historical is not None else []), scan=scan)
    old = F.col(f"{P}old") if historical is not None else F.pmod(F.col(RID[1]), F.lit(2)) == 0
    rows = materialize(rows.select("doc_id", *RID, old.alias(f"{P}old"), F.unhex(F.sha2("text", 256)).alias(f"{P}digest")), "digests")
    # a locator orders as the id does, nulls first; the id itself is what wins
    locator = F.coalesce("doc_id", F.lit(-(2**63)))
    parts = rows.groupBy(f"{P}old", f"{P}digest").agg(F.max(locator).alias(f"{P}winner"), F.count("*").alias(f"{P}size"))
    parts = materialize(parts, "parts")
    history, incoming = (parts.where(c).drop(f"{P}old") for c in (F.col(f"{P}old"), ~F.coalesce(f"{P}old", F.lit(False))))
    shards = max(1, -(-max(parts.count(), 1) // SHARD_DIGESTS), min(partitions(spark), 1 + parts.count() // 256))
    found = materialize(lookup(incoming, history_index(history, shards), shards), "lookup")
    # members join the history's group; nonmembers are groups of their own
    arrived = found.where(F.col(f"{P}member").isNotNull()).select(f"{P}digest", F.greatest(f"{P}member", f"{P}winner").alias(f"{P}winner"), f"{P}size")
    fresh = found.where(F.col(f"{P}member").isNull()).drop(f"{P}member")
    groups = materialize(history.unionByName(arrived).unionByName(fresh).groupBy(f"{P}digest").agg(F.max(f"{P}winner").alias(f"{P}winner"), F.sum(f"{P}size").alias(f"{P}size")), "groups")
    joined = materialize(with_group(rows, groups, f"{P}digest", f"{P}size").select(*rows.columns, f"{P}winner", f"{P}size"), "joined")
    # of rows that repeat the winner's id and text, the last in file order stays
    top = joined.where(locator == F.col(f"{P}winner"))
    last = top.groupBy(f"{P}digest").agg(F.max(F.struct(*RID)).alias("r")).select(F.col(f"r.{RID[0]}"), F.col(f"r.{RID[1]}"), F.lit(True).alias(f"{P}kept"))
    return joined.join(last, RID, "left").select(
        "doc_id",
        F.when(F.col(f"{P}winner") != -(2**63), F.col(f"{P}winner")).alias("keep_id"),
        F.col(f"{P}size").alias("group_size"),
        F.coalesce(f"{P}kept", F.lit(False)).alias("kept"),
        F.lower(F.hex(f"{P}digest")).alias("text_sha256"),
        *RID,
    )


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the row that stays for its text."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), scan=True).drop(*RID)


OP7_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
