"""Vector bin packing of documents into shards: bytes, tokens and rows are balanced jointly.

Equal texts form a group that stays together, unless it holds more than 1 / (2 * shards) of all bytes: then its rows are dealt to
pieces of an eighth of that, by a hash of the document. The largest groups and pieces (of more than 1 / (LARGE * shards) of all
bytes, so no more than LARGE * shards) are items of their own; all others are dealt by hash to parts, and within a part they go
in descending size, each to the bin where the dot product of its size vector with the bin's residual capacity is highest among the
bins that still have room for its bytes (all, if none has). Large items, the bins of all parts and the groups of one part more, which
level the rest, are then placed on the shards by the same rule, in descending size. Only those few numbers reach the driver: parts, and
the groups of one, grow with the square root of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kaivo.llm.scratch import bounded, written

SHARDS = 8
#: A group of more than 1 / (LARGE * shards) of all bytes is placed by itself.
LARGE = 64
#: Weights of bytes, tokens and rows in the dot product: bytes are the law.
WEIGHTS = (8.0, 1.0, 1.0)


def place(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Bin of each item; sizes: (items, 3) of bytes, tokens and rows, largest first. A bin has room while the item's bytes fit."""
    total = np.maximum(sizes.sum(axis=0), 1.0)
    items = sizes / total
    capacity = 1.0 / shards
    residual = [[capacity] * 3 for _ in range(shards)]
    out = np.empty(len(sizes), dtype=np.int64)
    p, q, r = WEIGHTS
    for k, (a, b, c) in enumerate(items.tolist()):
        best, score, fits = 0, -np.inf, False
        for s, (x, y, z) in enumerate(residual):
            dot = p * a * x + q * b * y + r * c * z
            room = a <= x
            if room > fits or room == fits and dot > score:
                best, score, fits = s, dot, room
        out[k] = best
        left = residual[best]
        left[0] -= a
        left[1] -= b
        left[2] -= c
    return out


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, size, tokens, text_crc32, shard, slot (gapless from 0 in its shard).

    size is the UTF-8 bytes of the text plus 1, tokens its words (runs without white space), text_crc32 the unsigned CRC-32
    of those bytes; a null text has none and is grouped with empty ones. Repeated rows each get a slot, and rows without a doc_id are
    dealt like others. An empty table gives no rows; other columns are ignored. The shards' sizes are near equal: no two differ by
    more than about a large document, or a large group.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = bounded(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("grp"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = written(rows, "sizes")
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    parts = max(1, isqrt(n) // 4)
    whole, large = (total or 1) / (2 * shards), (total or 1) / (LARGE * shards)
    some = rows.groupBy("grp").agg(F.sum("size").alias("all")).where(F.col("all") > large).select("grp", F.when(F.col("all") > whole, F.ceil(F.col("all") * 8 / whole)).otherwise(1).cast("long").alias("cuts"))
    # no more than LARGE * shards rows: their sizes add up to the total
    rows = rows.join(F.broadcast(some), "grp", "left").withColumn("sub", F.when(F.col("cuts") > 1, F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("row"))), "cuts")).otherwise(F.lit(0)))
    # large items have parts of their own, below 0; part 0 is the one whose groups stay single
    rows = rows.withColumn("part", F.when(F.col("cuts").isNotNull(), -1 - F.pmod(F.xxhash64("grp", "sub"), F.lit(1 << 62))).otherwise(F.pmod(F.xxhash64("grp"), F.lit(parts))))
    dealt = rows.select("part", "grp", "sub", "doc_id", "size", "tokens", "text_crc32").repartition("part").sortWithinPartitions("part", "grp", "sub", F.col("doc_id").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            grp, sub, size, tokens = (t.column(k).to_numpy() for k in ("grp", "sub", "size", "tokens"))
            new = np.concatenate([[True], (grp[1:] != grp[:-1]) | (sub[1:] != sub[:-1])])
            item = np.cumsum(new) - 1
            sums = np.stack([np.bincount(item, weights=w) for w in (size, tokens, np.ones(len(size)))], axis=1)
            order = np.argsort(-sums[:, 0], kind="stable")
            bins = np.arange(len(sums))
            if t.column("part")[0].as_py() > 0:
                bins[order] = place(sums[order], shards)
            own = bins[item]
            by = np.argsort(own, kind="stable")
            counts = np.bincount(own)
            spot = np.empty(len(own), dtype=np.int64)
            spot[by] = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
            return pa.RecordBatch.from_arrays([t.column(k).chunk(0) for k in ("part", "doc_id", "size", "tokens", "text_crc32")] + [pa.array(own), pa.array(spot)], names=["part", "doc_id", "size", "tokens", "text_crc32", "bin", "spot"])

        for batch in batches:
            part = batch.column(0).to_numpy()
            at = 0
            for to in [*(np.flatnonzero(part[1:] != part[:-1]) + 1), len(part)]:
                if to > at:
                    if held and held[-1].column(0)[0].as_py() != part[at]:
                        yield done()
                        held = []
                    held.append(batch.slice(at, to - at))
                at = to
        if held:
            yield done()

    packed = written(dealt.mapInArrow(run, "part long, doc_id long, size long, tokens long, text_crc32 long, bin long, spot long"), "packed")
    loads = packed.groupBy("part", "bin").agg(F.sum("size"), F.sum("tokens"), F.count("*")).collect()  # (shards / 4 + 4) * isqrt(n) + shards * (LARGE + 16) rows or so
    loads.sort(key=lambda x: (-x[2], x[0], x[1]))
    slots = [0] * shards
    placed = []
    for (part, b, *vector), s in zip(loads, place(np.array([x[2:] for x in loads], dtype=float).reshape(-1, 3), shards).tolist(), strict=True):
        placed.append((part, b, s, slots[s]))
        slots[s] += vector[2]
    where = docs.sparkSession.createDataFrame(placed, "part long, bin long, shard int, base long")
    where = F.broadcast(where) if len(placed) < 1_000_000 else where
    return packed.join(where, ["part", "bin"]).select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("base") + F.col("spot")).alias("slot"))
