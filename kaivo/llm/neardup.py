"""N-gram Jaccard join by a MinHash LSH forest, then exact verification.

Documents with the same set of 5-word shingles form one class, found by hash; only the class goes on. Each of TREES tries
holds a signature of every class: one byte of each of some minima, as many as the longest prefix that any query needs. The
signatures of a trie are sorted, so that classes with a common prefix stand next to each other and the longest common prefix of
neighbours gives the nodes. A query's prefix is shortened, level by level, until the forest finds its partners with the target
probability: how far follows from the smallest similarity that sets of its size can have with others at or above the threshold.
A node is final at the first level at which one of its members is satisfied. Pairs are compared on the full shingle sets inside
the nodes, each pair in the first trie where it meets; nodes with the same members count once. Work is dealt out by (node, size
class, block), so a large node is many tasks, and tasks return a count per class and a spanning forest, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kaivo.llm.graph import components
from kaivo.llm.scratch import bounded, gathered, small, written
from kaivo.llm.texts import mixed, slices

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 40, 16, 0.9999
#: Shingles of one block of a verification task; a task holds two blocks.
BLOCK = 1 << 18
#: Sets from this size on can have any similarity, nearly.
MANY = 64
#: Rows of one node that a task holds to split it further; longer ones stay whole.
HELD = 1 << 20


def depth_for(similarity: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which ``trees`` tries find a pair of this similarity with probability ``recall``."""
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def least_similarity(n: int, threshold: float) -> float | None:
    """The smallest similarity, at or above the threshold, of a set of n shingles with a different set; None if there is none."""
    found = [i / (n + m - i) for m in range(int(n * threshold), int(n / threshold) + 2) for i in range(1, min(n, m) + 1) if not i == n == m and i / (n + m - i) >= threshold]
    return min(found, default=None)


def depths(threshold: float, trees: int, depth: int, recall: float) -> np.ndarray:
    """The prefix length at which a query of so many shingles is satisfied, up to MANY (and more); 0: it has no partners but copies."""
    out = [0] + [depth_for(s, trees, depth, recall) if (s := least_similarity(n, threshold)) else 0 for n in range(1, MANY)]
    return np.array([*out, depth_for(threshold, trees, depth, recall)], dtype=np.int32)


def minima(hashes: np.ndarray, counts: np.ndarray, many: int, seed: int = 1) -> np.ndarray:
    """(rows, many) bytes of the minima of each row's set; ``hashes``: the rows' distinct shingles in turn; counts > 0."""
    rng = np.random.default_rng(seed)
    scale = rng.integers(1, 1 << 32, many, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    shift = rng.integers(0, 1 << 32, many, dtype=np.uint64).astype(np.uint32)
    x = mixed(hashes).astype(np.uint32)
    starts = np.cumsum(counts) - counts
    out = np.empty((len(counts), many), dtype=np.uint8)
    y = np.empty_like(x)
    for d in range(many):
        np.multiply(x, scale[d], out=y)
        np.add(y, shift[d], out=y)
        out[:, d] = np.minimum.reduceat(y, starts) * np.uint32(0x9E3779B1) >> np.uint32(24)
    return out


def signatures(docs: DataFrame, words: int, trees: int, need: np.ndarray) -> DataFrame:
    """doc_id, th (hash of the text), n (distinct shingles), h1, h2 (hash of the set), labels (of all trees; null: in no trie); n is 0 without words."""
    width = trees * int(need.max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in slices(batches):
            t.hashed_words()
            rows, sh = t.shingles(words)
            n = np.bincount(rows, minlength=t.n)
            full = np.flatnonzero(n)
            h1, h2 = np.zeros(t.n, dtype=np.uint64), np.zeros(t.n, dtype=np.uint64)
            placed = need[np.minimum(n, MANY)] > 0
            parts = []
            if len(full):
                starts = np.cumsum(n[full]) - n[full]
                h1[full] = np.add.reduceat(mixed(sh), starts)
                h2[full] = np.add.reduceat(mixed(sh ^ np.uint64(0x5851F42D4C957F2D)), starts)
                # rows in portions, so that their shingles stay in the processor's cache
                at = 0
                ends = np.cumsum(n[full])
                while at < len(full):
                    to = max(at + 1, int(np.searchsorted(ends, ends[at] + 50_000)))
                    own = placed[full[at:to]]
                    if own.any():
                        parts.append(minima(sh[starts[at] : ends[to - 1]], n[full][at:to], width)[own])
                    at = to
            labels = np.concatenate(parts).tobytes() if parts else b""
            off = np.concatenate([[0], np.cumsum(placed * width)]).astype(np.int32)
            valid = pa.array(placed).buffers()[1] if t.n else None
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n.astype(np.int64)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.Array.from_buffers(pa.binary(), t.n, [valid, pa.py_buffer(off.tobytes()), pa.py_buffer(labels)])],
                names=["doc_id", "th", "n", "h1", "h2", "labels"],
            )

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, n long, h1 long, h2 long, labels binary")


def final_nodes(tree: np.ndarray, labels: np.ndarray, need: np.ndarray, base: int) -> np.ndarray:
    """Node of each row (0: alone in it) of sorted signatures.

    From the root's side: a node of prefix length ``base`` or more is final if one of its members needs no longer one; else it
    falls apart into those of one level more. So every query gets the node at which its prefix is short enough.
    """
    n, depth = labels.shape
    node, todo = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
    differ = labels[1:] != labels[:-1]
    common = np.where(tree[1:] != tree[:-1], -1, np.where(differ.any(axis=1), differ.argmax(axis=1), depth))
    for d in range(base, depth + 1):
        start = np.flatnonzero(np.concatenate([[True], common < d]))
        sizes = np.diff(np.append(start, n))
        final = (np.minimum.reduceat(need, start) <= d) | (d == depth)
        taken = np.repeat(final, sizes) & todo
        todo &= ~taken
        many = taken & np.repeat(sizes > 1, sizes)
        name = mixed(tree[start].astype(np.uint64) + np.uint64(d << 32) + np.uint64(1))
        for k in range(d):
            name = mixed(name + labels[start, k])
        node[many] = np.repeat(name, sizes)[many]
        if not todo.any():
            break
    return node


def _nodes(entries: DataFrame, base: int, held: int = HELD) -> DataFrame:
    """node, tree, rep of final nodes with two members or more; entries: tree, label, need, rep, sorted within partitions that don't split a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[np.ndarray] | None = None
        hot: tuple[np.ndarray, int] | None = None  # first row of a node too long to be held

        def table(node: np.ndarray, tree: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
            own = node != 0
            return pa.RecordBatch.from_arrays([pa.array(node[own].view(np.int64)), pa.array(tree[own]), pa.array(rep[own])], names=["node", "tree", "rep"])

        def alike(tree: np.ndarray, label: np.ndarray, k: int) -> np.ndarray:
            return (tree == tree[k]) & (label[:, :base] == label[k, :base]).all(axis=1)

        def whole(tree: np.ndarray, label: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
            two = [0, 0]
            name = final_nodes(tree[two], label[two], np.full(2, base, dtype=np.int32), base)[0]
            return table(np.full(len(rep), name, dtype=np.uint64), tree, rep)

        for batch in batches:
            if not batch.num_rows:
                continue
            tree, need, rep = (batch.column(k).to_numpy() for k in (0, 2, 3))
            label = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(len(tree), -1)
            cols = [tree, label, need, rep]
            if hot is not None:
                own = (tree == hot[1]) & (label[:, :base] == hot[0]).all(axis=1)
                if own.any():
                    yield whole(tree[own], label[own], rep[own])
                    cols = [x[~own] for x in cols]
                if not len(cols[0]):
                    continue
                hot = None
            if carry:
                cols = [np.concatenate(x) for x in zip(carry, cols, strict=True)]
            last = alike(cols[0], cols[1], -1)
            cut = len(last) - int(last.sum())
            if cut:
                tree, label, need, rep = (x[:cut] for x in cols)
                yield table(final_nodes(tree, label, need, base), tree, rep)
            carry = [x[cut:].copy() for x in cols]
            if len(carry[0]) > held:
                hot = carry[1][0, :base], int(carry[0][0])
                yield whole(carry[0], carry[1], carry[3])
                carry = None
        if carry:
            tree, label, need, rep = carry
            yield table(final_nodes(tree, label, need, base), tree, rep)

    return entries.select("tree", "label", "need", "rep").mapInArrow(run, "node long, tree int, rep long")


def compare(ids: np.ndarray, side: np.ndarray, weight: np.ndarray, sets: list[np.ndarray], threshold: float, met: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links of each of these sets, weighted, and the smallest id that it reaches by them.

    side: 0 and 1 if only pairs across are wanted, else 0 for all. A pair links at Jaccard >= threshold. met: what two sets
    have in common, in any column, if they are compared elsewhere.
    """
    n = np.array([len(s) for s in sets], dtype=np.int64)
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    off = np.concatenate([[0], np.cumsum(n)])
    flag = np.zeros(len(values), dtype=np.int32)
    links, root = np.zeros(len(ids), dtype=np.int64), ids.copy()
    cross = bool(side.any())
    order = np.argsort(side, kind="stable") if cross else np.arange(len(ids))
    if cross:
        codes = np.concatenate([codes[off[i] : off[i + 1]] for i in order])
        ids, weight, n, root = ids[order], weight[order], n[order], root[order]
        off = np.concatenate([[0], np.cumsum(n)])
        met = met[order] if met is not None else None
    middle = int((side == 0).sum())
    for i in range(middle if cross else len(ids) - 1):
        lo = middle if cross else i + 1
        own = codes[off[i] : off[i + 1]]
        some, theirs, starts = np.arange(lo, len(ids)), codes[off[lo] :], off[lo:-1] - off[lo]
        if met is not None and met.shape[1]:
            new = ~(met[lo:] == met[i]).any(axis=1)
            if not new.all():
                some = some[new]
                if not len(some):
                    continue
                starts = np.cumsum(n[some]) - n[some]
                theirs = codes[np.repeat(off[some] - starts, n[some]) + np.arange(starts[-1] + n[some[-1]])]
        flag[own] = 1
        both = np.add.reduceat(flag[theirs], starts)
        flag[own] = 0
        hit = some[both / (n[i] + n[some] - both) >= threshold]
        if len(hit):
            links[i] += weight[hit].sum()
            links[hit] += weight[i]
            roots = np.unique(np.append(root[hit], root[i]))
            if len(roots) > 1:
                root[np.isin(root, roots[1:])] = roots[0]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return links[back], root[back]


def _verified(rows: DataFrame, threshold: float, trees: int) -> DataFrame:
    """rep, links, root of each task; rows: task, rep, side, m, own, tree, at, of (its tries and nodes), sh (its shingles, 8 bytes each), sorted by task.

    own: whether the task compares a block with itself. Any other compares two blocks, of which one may have no members.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def close() -> None:
            if len(held) > 1:
                ids, side, m = (np.array([x[k] for x in held], dtype=np.int64) for k in (1, 2, 3))
                if not held[0][4] and side.min() == side.max():
                    return
                met = np.repeat(-1 - np.arange(len(held), dtype=np.int64), trees).reshape(len(held), trees)  # no node: like no other's
                at = [x[6] for x in held]
                met[np.repeat(np.arange(len(held)), [len(x) for x in at]), np.concatenate(at)] = np.concatenate([x[7] for x in held])
                links, root = compare(ids, side, m, [x[8] for x in held], threshold, met[:, : held[0][5]])
                keep = links > 0
                out.append((ids[keep], links[keep], root[keep]))

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out]) if out else np.zeros(0, dtype=np.int64)) for k in range(3)], names=["rep", "links", "root"])

        for batch in batches:
            task, rep, side, m, own, tree = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            for k in range(len(task)):
                if held and held[-1][0] != task[k]:
                    close()
                    held.clear()
                    if len(out) > 500:
                        yield table()
                        out.clear()
                if held and held[-1][1:3] == (rep[k], side[k]):
                    continue  # a repeated row
                lists = (batch.column(c)[k].values.to_numpy().copy() for c in (6, 7))
                held.append((task[k], rep[k], side[k], m[k], own[k], tree[k], *lists, np.frombuffer(batch.column(8)[k].as_buffer(), dtype=np.uint64)))
        close()
        yield table()

    return rows.mapInArrow(run, "rep long, links long, root long")


def _shingled(docs: DataFrame, words: int) -> DataFrame:
    """The other columns and ``sh`` instead of ``text`` (the last column); of rows with one ``rep`` (the first) a task gives one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()  # no more than the task's rows
        for batch, t in slices(batches):
            t.hashed_words()
            rows, sh = t.shingles(words)
            ends = np.searchsorted(rows, np.arange(t.n + 1))
            sets = pa.Array.from_buffers(pa.binary(), t.n, [None, pa.py_buffer((ends * 8).astype(np.int32).tobytes()), pa.py_buffer(sh.tobytes())])
            reps = batch.column(0).to_pylist()
            new = [not (r in given or given.add(r)) for r in reps]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sets], names=[*batch.schema.names[:-1], "sh"]).filter(pa.array(new, pa.bool_()))

    rest = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    return docs.mapInArrow(run, f"{rest}, sh binary")


def _linked(docs: DataFrame, words: int, threshold: float, trees: int, recall: float, block: int) -> DataFrame:
    """doc_id, th, n, class_id, n_links, component_id, stays (whether the row is its component's first by doc_id and text) of each row."""
    docs = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("text"))
    need = depths(threshold, trees, DEPTH, recall)
    base, depth = int(need[need > 0].min()), int(need.max())
    sig = written(signatures(docs, words, trees, need), "signatures")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    classes = sig.where("n > 0").groupBy("h1", "h2", "n").agg(F.min(first).alias("first"), F.count("*").alias("m"), F.first("labels").alias("labels"))
    # gathered before they get ids: a repeated task gives rows other ids
    classes = written(gathered(classes).select(F.monotonically_increasing_id().alias("rep"), "h1", "h2", "n", "m", "first", "labels"), "classes", gather=False)
    many = classes.count()

    # the forest: each trie's signatures in order, nodes from neighbours' common prefixes
    steps = F.element_at(F.array(*(F.lit(int(x)) for x in need)), (F.least("n", F.lit(MANY)) + 1).cast("int"))
    entries = classes.where("labels is not null").select("rep", steps.alias("need"), "labels", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    entries = entries.select("tree", F.expr(f"substring(labels, tree * {depth} + 1, {depth})").alias("label"), "need", "rep")
    entries = entries.repartition("tree", F.expr(f"substring(label, 1, {base})")).sortWithinPartitions("tree", "label", "rep")
    nodes = written(_nodes(entries, base), "nodes", rows=many)
    members = nodes.groupBy("node").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("rep")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(3), "rep")).alias("x2"), F.min("tree").alias("t"))
    kept = members.groupBy("c", "x1", "x2").agg(F.min(F.struct("t", "node")).alias("one")).select("one.node")

    # Jaccard >= t needs sizes within a factor 1 / t: only the same or neighbouring size classes are compared
    ratio = float(np.log(1 / threshold)) * (1 + 1e-9) if threshold < 1 else 1e-6
    member = nodes.join(kept, "node").join(classes.select("rep", "n", "m", "first"), "rep").withColumn("size", F.floor(F.log(F.col("n").cast("double")) / ratio).cast("int"))
    member = written(member, "members")
    blocks = member.groupBy("node", "size").agg(F.ceil(F.sum("n") / block).cast("int").alias("nb"))
    blocks = blocks.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("size", "nb"))).alias("nbs"))
    placed = member.join(small(blocks, 8 * member.count()), "node").withColumn("b", F.pmod(F.xxhash64("rep"), F.col("nbs")[F.col("size")]).cast("int"))
    pairs = F.expr("""
        concat(
            transform(sequence(0, nbs[size] - 1), o -> struct(size as s1, least(b, o) as b1, size as s2, greatest(b, o) as b2, if(b > o, 1, 0) as side)),
            if(nbs[size + 1] is null, array(), transform(sequence(0, nbs[size + 1] - 1), o -> struct(size as s1, b as b1, size + 1 as s2, o as b2, 0 as side))),
            if(nbs[size - 1] is null, array(), transform(sequence(0, nbs[size - 1] - 1), o -> struct(size - 1 as s1, o as b1, size as s2, b as b2, 1 as side)))
        )""")
    # one row a class: its nodes, no more than there are tries
    placed = placed.select("rep", "m", "first", F.struct("tree", "node", pairs.alias("pairs")).alias("one"))
    placed = written(placed.groupBy("rep").agg(F.first("m").alias("m"), F.first("first.doc_id").alias("of"), F.first("first.th").alias("th"), F.sort_array(F.collect_list("one")).alias("own")), "placed")
    tasks_all = placed.agg(F.sum(F.expr("aggregate(own, 0L, (n, x) -> n + 2 + size(x.pairs))"))).first()[0] or 0
    found = small(placed.withColumnRenamed("th", "of_th"), 4 * tasks_all)
    texts = docs.join(found, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("th") == F.col("of_th"))).select("rep", "m", "own", "text")
    sets = _shingled(texts, words).where("length(sh) > 0")
    tasks = sets.select("rep", "m", "sh", F.col("own.tree").alias("at"), F.col("own.node").alias("of"), F.explode("own").alias("o")).select("rep", "m", "sh", "at", "of", "o.tree", "o.node", F.explode("o.pairs").alias("p"))
    tasks = tasks.select(F.xxhash64("node", "p.s1", "p.b1", "p.s2", "p.b2").alias("task"), "rep", F.col("p.side").cast("long").alias("side"), "m", F.expr("p.s1 = p.s2 and p.b1 = p.b2").alias("own"), "tree", "at", "of", "sh")
    tasks = tasks.repartition("task").sortWithinPartitions("task", "side", "rep")
    verified = written(_verified(tasks, threshold, trees), "verified", rows=tasks_all)

    links = verified.groupBy("rep").agg(F.sum("links").alias("links"))
    linked = components(verified.where("rep <> root").select("rep", "root"), verified.count())
    groups = classes.select("rep", "h1", "h2", "n", "m", "first").join(links, "rep", "left").join(linked.select(F.col("node").alias("rep"), "component"), "rep", "left")
    groups = written(groups.withColumn("component", F.coalesce("component", "rep")), "groups", rows=many)
    least = groups.where("component <> rep or links > 0").groupBy("component").agg(F.min("first").alias("least"))
    of_class = groups.join(least, "component", "left").select("h1", "h2", "n", "first", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("least", "first").alias("least"))
    rows = sig.select("doc_id", "th", "n", F.when(F.col("n") > 0, F.col("h1")).alias("h1"), F.when(F.col("n") > 0, F.col("h2")).alias("h2")).join(of_class, ["h1", "h2", "n"], "left")
    return rows.select(
        "doc_id",
        "th",
        "n",
        F.coalesce("first.doc_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("least.doc_id", "doc_id").alias("component_id"),
        F.when(F.col("least").isNull(), F.lit(True)).otherwise(F.col("least.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("least.th") == F.col("th"))).alias("stays"),
    )


def join(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) with what it links to at Jaccard >= threshold of its word shingles.

    doc_id; class_id: the smallest doc_id with the same shingle set; n_shingles; n_links: other rows linked directly,
    copies included; component_id: the smallest doc_id reachable by links, its own included; kept: doc_id = component_id.
    A text of fewer than ``words`` words has one shingle, all of them. Null and wordless texts link with nothing. Every row is a
    document of its own, whatever its doc_id: rows that share one link by their own texts, and those without one link too (their
    ids are those of the others they reach, null if none has one). No row is lost; an empty table gives none; other columns
    are ignored. A pair exactly at the threshold is found with probability ``recall``, others more surely.
    """
    found = _linked(docs, words, threshold, trees, recall, block)
    return found.select("doc_id", "class_id", F.col("n").alias("n_shingles"), "n_links", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def one_of_each(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """Rows of ``docs`` with all their columns, one row of each component: the one of smallest doc_id (rows without one come last).

    Of rows that share that doc_id one text stays, and of equal ones one row. Rows without words all stay. An empty table gives none.
    """
    found = written(_linked(docs, words, threshold, trees, recall, block).select("doc_id", "th", "n", "stays"), "near-duplicates")
    dropped = found.where("not stays").select(F.col("doc_id").alias("dropped_id"), F.col("th").alias("dropped_th")).distinct()

    def match(other: DataFrame, prefix: str) -> Column:
        return docs["doc_id"].cast("long").eqNullSafe(other[f"{prefix}_id"]) & (F.xxhash64(docs["text"].cast("string")) == other[f"{prefix}_th"])

    dropped = small(dropped, 2 * found.where("not stays").count())
    rest = docs.join(dropped, match(dropped, "dropped"), "left_anti")
    again = written(found.where("stays and n > 0").groupBy("doc_id", "th").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("doc_id").alias("again_id"), F.col("th").alias("again_th")), "again")
    if again.isEmpty():
        return rest
    once = rest.join(again, match(again, "again"), "left_semi").dropDuplicates(["doc_id", "text"])
    return rest.join(again, match(again, "again"), "left_anti").unionByName(once)
