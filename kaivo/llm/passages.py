"""Repeated passages by a sparse suffix array.

Of each text the suffixes are kept that start at a minimiser: in every run of WORDS words at least one 16-word gram
is the least of its neighbours, and equal runs choose the same one. The kept suffixes are sorted by their words (each word a
8-bit key, so that the order is one of word sequences), dealt out by range, and each is compared with its neighbours: those
with GRAM words in common with another document's are anchors of possible matches (so are those at the ends of a range, whose
neighbours are elsewhere).
Then anchors are extended left and right, to the WORDS-word windows that chose them. Extending neighbours alone would miss
matches whose best partner on the left isn't a neighbour on the right, so a window looks for its equal among all: windows are
sorted by 96 bits of hash and compared with their neighbours in turn. Equal windows of two documents are repeated; at 1e13 windows
less than one false equality in a thousand such corpora is to be expected. Windows merge to maximal spans.

A document is a doc_id. Where rows share one but have different texts, a row's ``version`` (its text's hash; else 0) tells them apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kaivo.llm.scratch import bounded, small, written
from kaivo.llm.texts import Texts, mixed, slices, sliding_min

#: A passage counts from so many words on; a kept suffix is recognised by its first GRAM words.
WORDS, GRAM = 50, 16


def again(docs: DataFrame, doc_id: Column) -> DataFrame | None:
    """again_id: ids of more than one row; None if there is none. Reads the ids alone."""
    found = written(docs.groupBy(doc_id.alias("again_id")).agg(F.count("*").alias("rows")).where("again_id is not null and rows > 1").select("again_id"), "again-ids")
    n = found.count()
    return small(found, n) if n else None


def versioned(docs: DataFrame, doc_id: Column, text: Column, ids: DataFrame | None) -> DataFrame:
    """``docs`` and ``version``: 0, or the text's hash if doc_id is one of ``ids``."""
    if ids is None:
        return docs.withColumn("version", F.lit(0).cast("long"))
    return docs.join(ids, doc_id == ids["again_id"], "left").withColumn("version", F.when(F.col("again_id").isNotNull(), F.xxhash64(text)).otherwise(F.lit(0))).drop("again_id")


def _least(t: Texts, words: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of each run of ``words`` words of one row, and the position of its minimiser: the kept suffix."""
    at, g = t.grams(gram)
    w = words - gram + 1
    if len(at) < w:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    packed = (g >> np.uint64(32) << np.uint64(32)) | np.arange(len(g), dtype=np.uint64)
    least = sliding_min(packed, w)
    first, last = at[: len(at) - w + 1], at[w - 1 :]
    inside = (last - first == w - 1) & (t.wd[last] == t.wd[first])
    return first[inside], at[(least[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)]


def _suffixes(docs: DataFrame, words: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in slices(batches):
            t.hashed_words()
            at = np.unique(_least(t, words, gram)[1])
            rows = t.wd[at]
            keys = (t.h >> np.uint64(56)).astype(np.uint8)[at[:, None] + np.arange(gram)]
            ends = np.arange(len(at) + 1, dtype=np.int32) * np.int32(gram)
            suffix = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(keys.tobytes())])
            yield pa.RecordBatch.from_arrays([suffix, *(batch.column(k).take(pa.array(rows)) for k in (0, 1)), pa.array((at - t.first[rows]).astype(np.int32))], names=["suffix", "doc_id", "version", "at"])

    return docs.mapInArrow(run, "suffix binary, doc_id long, version long, at int")


def _keys(column: pa.Array, width: int) -> np.ndarray:
    """(rows, width) bytes of a binary column whose values all have that length."""
    _, off, data = column.buffers()
    at = int(np.frombuffer(off, dtype=np.int32, count=1, offset=4 * column.offset)[0])
    return np.frombuffer(data, dtype=np.uint8, count=len(column) * width, offset=at).reshape(-1, width)


def _anchors(suffixes: DataFrame, gram: int) -> DataFrame:
    """The suffixes that have ``gram`` words in common with one of another document; suffixes: sorted by key and doc_id within ranges.

    Of a run of equal keys no more is held than its first document's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.RecordBatch | None = None  # a run of one document, which may go on
        met: np.ndarray | None = None  # the key of a run of two or more, which may go on
        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            if carry is not None:
                batch = pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0]
            s, d = _keys(batch.column(0), gram), batch.column(1).to_numpy()
            start = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]).any(axis=1)]))
            n = np.diff(np.append(start, len(s)))
            several = d[start] != d[start + n - 1]
            if first or met is not None and (s[0] == met).all():
                several[0] = True
            first = False
            last = int(start[-1])
            met = s[-1].copy() if several[-1] else None
            carry = None if several[-1] else batch.slice(last)
            yield batch.filter(pa.array(np.repeat(several, n), pa.bool_())).select(["doc_id", "version", "at"])
        if carry is not None:
            yield carry.select(["doc_id", "version", "at"])

    return suffixes.mapInArrow(run, "doc_id long, version long, at int")


def _windows(anchored: DataFrame, words: int, gram: int) -> DataFrame:
    """hash, proof, doc_id, version, start of the windows that chose an anchor; anchored: doc_id, version, at (array), text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in slices(batches):
            t.hashed_words()
            start, chosen = _least(t, words, gram)
            lists = batch.column(2)
            anchor = np.zeros(len(t.wd) + 1, dtype=bool)
            anchor[lists.flatten().to_numpy() + np.repeat(t.first, lists.value_lengths().to_numpy())] = True
            near = anchor[chosen]
            _, g = t.grams(words)  # at the same starts
            at, g = start[near], g[near]
            # a second hash, of other values for the words
            t.h = mixed(t.h ^ np.uint64(0x5851F42D4C957F2D))
            proof = (t.grams(words)[1][near] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            rows = t.wd[at]
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(proof), *(batch.column(k).take(pa.array(rows)) for k in (0, 1)), pa.array((at - t.first[rows]).astype(np.int32))], names=["hash", "proof", "doc_id", "version", "start"])

    return anchored.mapInArrow(run, "hash long, proof int, doc_id long, version long, start int")


#: Bits for each key that ``_among`` marks, and how many there are at most (16 MB); beyond that more rows pass that need not.
MARKS, MOST_MARKS = 32, 1 << 27
#: Bits of one value of Spark's bitmap functions.
BITMAP = 1 << 15


def _among(docs: DataFrame, keys: DataFrame, n: int, most: int = MOST_MARKS) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, version) is among the ``n`` of ``keys``, and a few others; none is moved.

    Keys are marked in a bitmap of bounded size, which is broadcast, so that only rows with work to do are shuffled with their texts.
    """
    bits = min(most, max(BITMAP, 1 << (MARKS * n - 1).bit_length()))
    mark = F.pmod(F.xxhash64("doc_id", "version"), F.lit(bits))
    bitmaps = keys.select(mark.alias("mark")).groupBy(F.shiftright("mark", 15).alias("of")).agg(F.bitmap_construct_agg(F.col("mark").bitwiseAND(BITMAP - 1)).alias("marks"))
    byte = F.conv(F.hex(F.substring("marks", F.shiftright(F.col("mark").bitwiseAND(BITMAP - 1), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = byte.bitwiseAND(F.expr("shiftleft(1, cast(mark & 7 as int))")) != 0
    return docs.withColumn("mark", mark).join(F.broadcast(bitmaps), (F.shiftright("mark", 15) == F.col("of")) & marked, "left_semi").drop("mark")


def spans(docs: DataFrame, words: int = WORDS, gram: int = GRAM) -> DataFrame:
    """Maximal passages of ``words`` words or more that stand in two documents or more: one row for each place.

    doc_id; version; start_word and n_words (words are ``[^\\x20\\x09-\\x0D]+``, from 0); duplicate: false where each window's
    smallest doc_id is this one, so that keeping those and dropping the others loses no passage; first_doc_id: the smallest doc_id
    that holds the span's first window. Null, empty and shorter texts, and rows without a doc_id, have no spans. Rows under
    one doc_id count as one document, so a repeated row, or a passage that only they share, isn't a repetition; those of different
    texts have their own spans, told apart by version. Other columns are ignored; an empty table gives none.
    """
    docs = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    docs = versioned(docs, F.col("doc_id"), F.col("text"), again(docs, F.col("doc_id"))).select("doc_id", "version", "text")
    ordered = _suffixes(docs, words, gram).repartitionByRange("suffix", "doc_id").sortWithinPartitions("suffix", "doc_id", "at")
    anchors = written(_anchors(ordered, gram).groupBy("doc_id", "version").agg(F.collect_list("at").alias("at")), "anchors")
    # always a shuffle join: a third of a corpus can hold anchors, so neither side is small at any size
    windows = _windows(_among(docs, anchors, anchors.count()).hint("merge").join(anchors, ["doc_id", "version"]).select("doc_id", "version", "at", "text"), words, gram)
    order = ["hash", "proof", "doc_id", "version", "start"]
    # a range partitioning reads its input twice: windows are made again from the joined texts, which costs less than to keep them
    met = written(_met(windows.repartitionByRange("hash", "proof", "doc_id", "start").sortWithinPartitions(*order)), "met")
    # two runs a range at most: what the ends of the ranges hold together
    ends = met.where("run > 0").groupBy("run", "hash", "proof").agg(F.min("first_doc_id").alias("least"), F.max("doc_id").alias("most")).collect()
    whole: dict[tuple[int, int], tuple[int, int]] = {}
    for e in ends:
        lo, hi = whole.get((e["hash"], e["proof"]), (e["least"], e["most"]))
        whole[e["hash"], e["proof"]] = min(lo, e["least"]), max(hi, e["most"])
    least: list[int | None] = [None] * (1 + max((e["run"] for e in ends), default=0))  # by run; None: in one document only
    for e in ends:
        lo, hi = whole[e["hash"], e["proof"]]
        least[e["run"]] = lo if lo < hi else None
    first = F.when(F.col("run") == 0, F.col("first_doc_id")).otherwise(F.element_at(F.lit(least).cast("array<long>"), F.col("run") + 1))
    hits = met.select("doc_id", "version", "start", first.alias("first_doc_id")).where("first_doc_id is not null")
    return _merged(hits.repartition("doc_id", "version").sortWithinPartitions("doc_id", "version", F.col("doc_id") != F.col("first_doc_id"), "start"), words)


def _met(windows: DataFrame) -> DataFrame:
    """Windows that meet an equal one of another document; windows: sorted within ranges of (hash, proof, doc_id, start).

    hash, proof, doc_id, version, start, first_doc_id (the smallest that has the window), run. Equal windows stand next to each
    other; those at either end of a range can go on in the next, so all of them are given, with the smallest doc_id of the range and
    a number of their run (from 1; else 0). hash and proof are null elsewhere: only the ends are looked up by them.
    """
    names = ["hash", "proof", "doc_id", "version", "start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = 2 * TaskContext.get().partitionId() + 1
        carry: list[np.ndarray] | None = None
        first = True

        def judged(cols: list[np.ndarray], end: bool) -> pa.RecordBatch:
            nonlocal first
            h, p, d = cols[:3]
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (p[1:] != p[:-1])]))
            n = np.diff(np.append(new, len(h)))
            least, most = d[new], d[new + n - 1]
            ends = np.zeros(len(new), dtype=np.int32)
            if end:
                ends[-1] = number + 1
            if first:
                ends[0] = number
            first = False
            keep = np.repeat((least < most) | (ends > 0), n)
            number_of = np.repeat(ends, n)[keep]
            inner = number_of == 0
            proven = [pa.array(x[keep], mask=inner) for x in (h, p)]
            return pa.RecordBatch.from_arrays([*proven, *(pa.array(x[keep]) for x in (*cols[2:], np.repeat(least, n))), pa.array(number_of)], names=[*names, "first_doc_id", "run"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy() for k in range(5)]
            if carry:
                cols = [np.concatenate(x) for x in zip(carry, cols, strict=True)]
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            cut = len(last) - int(last.sum())  # the last run may go on
            if cut:
                yield judged([x[:cut] for x in cols], False)
            carry = [x[cut:].copy() for x in cols]
        if carry:
            yield judged(carry, True)

    return windows.select(*names).mapInArrow(run, "hash long, proof int, doc_id long, version long, start int, first_doc_id long, run int")


def _merged(hits: DataFrame, words: int) -> DataFrame:
    """Maximal spans of overlapping windows; hits: sorted by document, version, whether it is the first, and start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: tuple | None = None  # doc_id, version, duplicate, first start, last start, first_doc_id

        def table(rows: list[np.ndarray]) -> pa.RecordBatch:
            d, v, dup, lo, hi, f = (np.asarray(x, dtype=np.int64) for x in rows)
            return pa.RecordBatch.from_arrays([pa.array(d), pa.array(v), pa.array(lo), pa.array(hi - lo + words), pa.array(dup.astype(bool)), pa.array(f)], names=["doc_id", "version", "start_word", "n_words", "duplicate", "first_doc_id"])

        for batch in batches:
            if not batch.num_rows:
                continue
            d, v, at, f = (batch.column(k).to_numpy().astype(np.int64) for k in range(4))
            dup = (d != f).astype(np.int64)
            new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (v[1:] != v[:-1]) | (dup[1:] != dup[:-1]) | (at[1:] > at[:-1] + 1)]))
            last = np.append(new[1:], len(d)) - 1
            rows = [d[new], v[new], dup[new], at[new], at[last], f[new]]
            if open_ is not None:
                if open_[:3] == (d[0], v[0], dup[0]) and at[0] <= open_[4] + 1:
                    rows[3][0], rows[5][0] = open_[3], open_[5]
                else:
                    rows = [np.concatenate([[o], x]) for o, x in zip(open_, rows, strict=True)]
            open_ = tuple(int(x[-1]) for x in rows)
            yield table([x[:-1] for x in rows])
        if open_ is not None:
            yield table([np.array([x]) for x in open_])

    return hits.mapInArrow(run, "doc_id long, version long, start_word long, n_words long, duplicate boolean, first_doc_id long")


def _cut(docs: DataFrame) -> DataFrame:
    """``docs`` without the words of ``spans`` (array of start, words, duplicate; null: the row stays as it is); docs: others, spans, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in slices(batches):
            text, own_spans = batch.column(batch.num_columns - 1).cast(pa.string()), batch.column(batch.num_columns - 2)
            marked = own_spans.is_valid()
            stays = np.ones(t.n, dtype=bool)
            if own_spans.null_count < t.n:
                t.words()
                texts: list[bytes | None] = []
                for k in np.flatnonzero(marked.to_numpy(zero_copy_only=False)):
                    drop = np.zeros(t.wn[k], dtype=bool)
                    for s in sorted(own_spans[k].as_py(), key=lambda s: not s["duplicate"]):
                        drop[s["start_word"] : s["start_word"] + s["n_words"]] = s["duplicate"]
                    stays[k] = not drop.all()
                    base, f = t.off[k], t.first[k]
                    whole = t.data[base : t.off[k + 1]].tobytes()
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], drop, [False]]).astype(np.int8)))
                    out, at = [], 0
                    for a, b in edge.reshape(-1, 2):
                        out.append(whole[at : t.ws[f + a] - base])
                        at = t.ws[f + b] - base if b < len(drop) else len(whole)
                    out.append(whole[at:])
                    texts.append(b"".join(out).rstrip())
                text = pc.replace_with_mask(text, marked, pa.array(texts, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], text], names=[*batch.schema.names[:-2], "text"]).filter(pa.array(stays))

    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-2])
    return docs.mapInArrow(run, f"{rest}, text string")


def without_repeats(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs``, all columns, where a repeated passage stays only in the document of smallest doc_id.

    The other places' words are cut from the text; a document left without words goes. Others keep their text to the byte, as do
    rows without a doc_id. Rows under one doc_id are cut each by its own text's spans. One pass over ``docs``: rows with and without
    passages go through the same tasks. An empty table gives none.
    """
    found = written(spans(docs, words), "spans")
    n = found.count()
    cut = found.where("duplicate").select("doc_id", "version").distinct()
    own = found.join(small(cut, 2 * n), ["doc_id", "version"], "left_semi").groupBy(F.col("doc_id").alias("span_doc_id"), F.col("version").alias("span_version")).agg(F.collect_list(F.struct("start_word", "n_words", "duplicate")).alias("own_spans"))
    names = docs.columns
    t, key = names.index("text"), F.col(f"c{names.index('doc_id')}").cast("long")
    work = bounded(docs).toDF(*(f"c{k}" for k in range(len(names))))  # names that can't clash with others here
    marked = versioned(work, key, F.col(f"c{t}").cast("string"), again(work, key))
    joined = marked.join(small(own, 5 * n), (key == F.col("span_doc_id")) & (F.col("version") == F.col("span_version")), "left")
    rest = [f"c{k}" for k in range(len(names)) if k != t]
    done = _cut(joined.select(*rest, "own_spans", F.col(f"c{t}").cast("string").alias("text"))).withColumnRenamed("text", f"c{t}")
    return done.select(*work.columns).toDF(*names)
