"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

A vector u of unit length is kept as s * q with q in int8, and its own residual norm e = |u - s q| is measured. For any
two, |u.v - s_u s_v q_u.q_v| <= e_u + (1 + e_u) e_v, so a pair whose approximate product plus that bound is below the
threshold cannot link. Only the others are computed again in double precision from the vectors given. Equal vectors form
one class of which a single one is compared. A task takes one tile of two blocks and returns, for each vector, a count of
links and a root: never pairs. Tiles get the vectors as they are and quantise them: that costs a block's length times less than its
products, and both forms together would be a quarter more to shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kaivo.llm.graph import components
from kaivo.llm.scratch import bounded, small, written

THRESHOLD = 0.9
#: Vectors of a block; rows of a block multiplied at a time; partitions that tiles are dealt to, at most (a task then does several tiles in turn).
BLOCK, STRIP, TASKS = 8192, 256, 20_000


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales and residual norms of these vectors (float64, not zero), scaled to length 1."""
    u = x / np.abs(x).max(axis=1, keepdims=True)  # first by the largest component: no overflow
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    scale = np.abs(u).max(axis=1) / 127
    q = np.rint(u / scale[:, None])
    rest = np.linalg.norm(u - q * scale[:, None], axis=1) + 1e-12
    return q.astype(np.int8), scale, rest


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision."""
    big = np.abs(x).max(axis=1, keepdims=True), np.abs(y).max(axis=1, keepdims=True)
    x, y = x / np.where((big[0] > 1e100) | (big[0] < 1e-100), big[0], 1), y / np.where((big[1] > 1e100) | (big[1] < 1e-100), big[1], 1)
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def tile(ids: tuple, left: tuple, right: tuple | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Ids with links in this tile, their links (weighted) and roots, and how many pairs were computed in full.

    A block is (x float64, q int8, scale, rest, weight); right is None for a block with itself.
    """
    x, q, scale, rest, weight = left
    own = right is None
    xr, qr, scale_r, rest_r, weight_r = left if own else right
    both_ids = ids[0] if own else np.concatenate(ids)
    base = 0 if own else len(x)
    links, root = np.zeros(len(both_ids), dtype=np.int64), both_ids.copy()
    qr32 = qr.astype(np.float32).T  # products of int8 summed in float32 are whole numbers, exact below 2^24
    wide = q.shape[1] > 1000
    full = 0
    for at in range(0, len(x), STRIP):
        to = min(at + STRIP, len(x))
        lo = at if own else 0
        dots = q[at:to].astype(np.float64) @ qr[lo:].astype(np.float64).T if wide else q[at:to].astype(np.float32) @ qr32[:, lo:]
        # s_u s_v d + e_u + (1 + e_u) e_v >= threshold, with the strip's largest e_v and looser by what float32 rounds off
        slack = (1 + rest[at:to]) * rest_r[lo:].max()
        limit = ((threshold - 1e-5 - rest[at:to] - slack) / scale[at:to]).astype(np.float32)
        i, j = np.nonzero(dots * scale_r[lo:].astype(np.float32) >= limit[:, None])
        i, j = i + at, j + lo
        near = scale[i] * scale_r[j] * dots[i - at, j - lo] + rest[i] + (1 + rest[i]) * rest_r[j] >= threshold - 1e-9
        if own:
            near &= j > i
        i, j = i[near], j[near]
        full += len(i)
        for k in range(0, len(i), 1 << 16):
            a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            hit = cosine(x[a], xr[b]) >= threshold
            a, b = a[hit], b[hit]
            np.add.at(links, a, weight_r[b])
            np.add.at(links, base + b, weight[a])
            union(root, a, base + b)
    keep = links > 0
    return both_ids[keep], links[keep], root[keep], full


def union(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Lowers ``root`` (labels of nodes) to the smallest label over the edges a-b, until nothing changes."""
    while True:
        low = np.minimum(root[a], root[b])
        moved = np.flatnonzero((root[a] != low) | (root[b] != low))
        if not len(moved):
            return
        # relabel whole labels, not nodes: old label -> smallest label met with it
        old = np.concatenate([root[a[moved]], root[b[moved]]])
        new = np.concatenate([low[moved], low[moved]])
        order = np.lexsort((new, old))
        old, new = old[order], new[order]
        first = np.concatenate([[True], old[1:] != old[:-1]])
        old, new = old[first], new[first]
        at = np.searchsorted(old, root)
        at[at == len(old)] = 0
        match = old[at] == root
        root[match] = np.minimum(root[match], new[at[match]])


def join(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): links at cosine >= threshold, over all pairs.

    vec_id; n_links: other vectors linked directly; component_id: the smallest vec_id reachable, its own included; kept:
    vec_id = component_id; class_id: the smallest vec_id with an equal vector. A vector that is null, empty, zero or has a
    null or non-finite component links with nothing, nor do vectors of different length with each other. Every row is a vector of its
    own, whatever its vec_id: rows that share one link by their own vectors, and those without one link too (their ids are those of the
    others they reach, null if none has one). No row is lost; an empty table gives none; other columns are ignored.
    """
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = bounded(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"))
    fine = F.expr("v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(double(x)) < double('infinity')) and exists(v, x -> x <> 0)")
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    rows = rows.withColumn("h1", F.when(F.col("fine"), F.xxhash64("v"))).withColumn("h2", F.when(F.col("fine"), F.xxhash64(F.lit(7), F.reverse("v")))).withColumn("dim", F.size("v"))
    # copies are combined before the shuffle; one vector of each class goes on
    classes = rows.where("fine").groupBy("h1", "h2", "dim").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"), F.first("v").alias("v"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("rep"), "h1", "h2", "dim", "least", "m", "v"), "vector-classes", gather=False)
    blocks = written(classes.groupBy("dim").agg(F.ceil(F.count("*") / block).cast("int").alias("nb")), "vector-blocks")
    reps = classes.join(small(blocks, 2 * blocks.count()), "dim").withColumn("b", F.pmod(F.xxhash64("rep", F.lit(3)), "nb").cast("int"))
    tiles = F.expr("transform(sequence(0, nb - 1), o -> struct(least(b, o) as b1, greatest(b, o) as b2, if(b > o, 1, 0) as side))")
    packed = reps.select("dim", "rep", "m", "v", F.explode(tiles).alias("t"))
    packed = packed.select(F.xxhash64("dim", "t.b1", "t.b2").alias("task"), (F.col("t.b1") == F.col("t.b2")).alias("own"), F.col("t.side").cast("int").alias("side"), "rep", "m", "v")
    n_tiles = F.col("nb") * (F.col("nb").cast("long") + 1) / 2
    parts = int(blocks.agg(F.sum(n_tiles)).first()[0] or 1)
    packed = packed.repartition(min(max(parts, 1), TASKS), "task").sortWithinPartitions("task", "side", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def done() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            side, ids, m = (table.column(k).to_numpy() for k in ("side", "rep", "m"))
            x = table.column("v").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(ids), -1)
            cut = int((side == 0).sum())
            some = [(x[p], *quantise(x[p]), m[p]) for p in (slice(0, cut), slice(cut, None)) if len(x[p])]
            own = table.column("own")[0].as_py()
            if own:
                a, b, c, _ = tile((ids,), some[0], None, threshold)
            elif len(some) == 2:
                a, b, c, _ = tile((ids[:cut], ids[cut:]), some[0], some[1], threshold)
            else:
                a = b = c = np.zeros(0, dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], names=["rep", "links", "root"])

        for batch in batches:
            task = batch.column(0).to_numpy()
            ends = [*(np.flatnonzero(task[1:] != task[:-1]) + 1), len(task)]
            at = 0
            for to in ends:
                if to == at:
                    continue
                if held and task[at] != key:
                    yield done()
                    held = []
                key = task[at]
                held.append(batch.slice(at, to - at))
                at = to
        if held:
            yield done()

    tiled = written(packed.mapInArrow(run, "rep long, links long, root long"), "tiles")
    links = tiled.groupBy("rep").agg(F.sum("links").alias("links"))
    linked = components(tiled.where("rep <> root").select("rep", "root"))
    groups = classes.select("rep", "h1", "h2", "dim", "least", "m").join(links, "rep", "left").join(linked.select(F.col("node").alias("rep"), "component"), "rep", "left")
    groups = written(groups.withColumn("component", F.coalesce("component", "rep")), "vector-groups")
    firsts = groups.where("links > 0").groupBy("component").agg(F.min("least").alias("first"))
    of_class = groups.join(firsts, "component", "left").select("h1", "h2", "dim", "least", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("first", "least").alias("first"))
    found = rows.select("vec_id", "h1", "h2", "dim").join(of_class, ["h1", "h2", "dim"], "left")
    component = F.coalesce("first", "vec_id")
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"), F.coalesce("least", "vec_id").alias("class_id"))
