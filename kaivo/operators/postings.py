"""Kernels over Arrow batches of index entries: words counted by passage, lexemes of distinct words, scores and best passages.

An entry is a passage's distinct kept words and how often each stands there, so whatever is counted or ranked by passage stays in
the task that reads it. Slices bound what a task holds, whatever a batch brings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from kaivo.functions.stats import MOST_POSITIONS, ZETA2
from kaivo.functions.text import SUFFIX

#: Words of a slice (a longer passage is one by itself), cells (passage, question) of a dense table, and rows of best passages held in a task.
SLICE_WORDS, SLICE_CELLS, HELD_ROWS = 1 << 20, 1 << 19, 1 << 21
POINTS = 1e9
H2 = np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, MOST_POSITIONS + 1) ** 2)])


def flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Values of a list column, and the row of each."""
    return pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(batch: pa.RecordBatch, column: str, most_words: int = SLICE_WORDS, most_rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Runs of rows with so many list values and rows at most."""
    size = np.cumsum(pc.fill_null(pc.list_value_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        end = max(at + 1, min(at + most_rows, int(np.searchsorted(size, before + most_words, side="right"))))
        yield batch.slice(at, end - at)
        at = end


def encoded(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct values and the code of each."""
    d = words.dictionary_encode()
    return d.dictionary, d.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def pieces(words: pa.Array, analysers: tuple[str, ...]) -> dict[str, list[pa.Array]]:
    """Lexemes of words as ``functions.text.lexemes`` makes them, by analyser, side by side; null where a word has none there."""
    found = {"base": [words]}
    if "stem" in analysers:
        short = pc.replace_substring_regex(words, pattern=SUFFIX, replacement="")
        found["stem"] = [pc.if_else(pc.greater_equal(pc.utf8_length(short), 3), short, words)]
    if "split" in analysers or "prefix" in analysers:
        left, right, head = [], [], []
        for w in words.to_pylist():
            n = len(w)
            a, b = (w[: n // 2], w[n // 2 :]) if n >= 10 else (None, None)
            left.append(a)
            right.append(b if a != b else None)
            head.append(w[:5] if n >= 6 and w[:5] != a else None)
        left, right, head = (pa.array(x, pa.string()) for x in (left, right, head))
        found |= {"split": [words, left, right], "prefix": [words, left, right, head]}
    return {a: found[a] for a in analysers}


def n_distinct(values: np.ndarray) -> int:
    x = np.sort(values)
    return int(np.count_nonzero(x[1:] != x[:-1])) + 1 if len(x) else 0


def counted(analysers: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (doc_id, authority, words in order) to entries: distinct words, their counts, a block of rows that lie together, lengths by analyser."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "words"):
                words, row = flat(part["words"])
                vocabulary, code = encoded(words)
                key, n = np.unique(row * max(1, len(vocabulary)) + code, return_counts=True)
                row, code = np.divmod(key, max(1, len(vocabulary)))
                off = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())
                out = [part["doc_id"], part["authority"], pa.ListArray.from_arrays(off, vocabulary.take(pa.array(code))), pa.ListArray.from_arrays(off, pa.array(n, pa.int32())), pa.array(np.full(part.num_rows, block)), pa.array([False] * part.num_rows)]
                for made in pieces(vocabulary, analysers).values():
                    k = sum((p.is_valid().to_numpy(zero_copy_only=False).astype(np.int64) for p in made), np.zeros(len(vocabulary), np.int64))
                    out.append(pa.array(np.bincount(row, n * k[code], part.num_rows).astype(np.int64)))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "authority", "words", "n", "block", "shared", *(f"length_{a}" for a in analysers)])
                block += 1

    return run


def distinct_lexemes(analysers: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Entries to rows (analyser, postings): a passage's distinct lexemes, summed over a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "words"):
                words, row = flat(part["words"])
                vocabulary, code = encoded(words)
                total = []
                for a, made in pieces(vocabulary, analysers).items():
                    if a == "base":
                        total.append(len(code))
                        continue
                    ids = pa.chunked_array(made).combine_chunks().dictionary_encode()
                    lexeme = pc.fill_null(ids.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(made), -1)[:, code]
                    key = (row * max(1, len(ids.dictionary)) + lexeme)[lexeme >= 0]
                    total.append(n_distinct(key))
                yield pa.RecordBatch.from_arrays([pa.array(list(analysers), pa.string()), pa.array(total, pa.int64())], ["analyser", "postings"])

    return run


@dataclass(frozen=True)
class Wanted:
    """What questions ask: by analyser the distinct lexemes, questions of each (``items`` from ``first`` on), and how many lexemes a question has."""

    item_ids: np.ndarray
    lexemes: dict[str, list[str]]
    first: dict[str, np.ndarray]
    items: dict[str, np.ndarray]
    n: dict[str, np.ndarray]


def wanted(rows: list[tuple[int, str, str]], analysers: tuple[str, ...]) -> Wanted:
    """From rows (item_id, analyser, lexeme), distinct."""
    ids = np.array(sorted({r[0] for r in rows}), np.int64)
    out = Wanted(ids, {}, {}, {}, {})
    for a in analysers:
        mine = sorted((r[2], r[0]) for r in rows if r[1] == a)
        lexemes = list(dict.fromkeys(x for x, _ in mine))
        place = {x: k for k, x in enumerate(lexemes)}
        which = np.array([place[x] for x, _ in mine], np.int64)
        items = np.searchsorted(ids, np.array([i for _, i in mine], np.int64))
        out.lexemes[a], out.items[a] = lexemes, items
        out.first[a] = np.searchsorted(which, np.arange(len(lexemes) + 1))
        out.n[a] = np.bincount(items, minlength=len(ids))
    return out


def weights(want: Wanted, a: str, row: np.ndarray, lexeme: np.ndarray, n: np.ndarray, rows: int) -> np.ndarray:
    """Sums of what matched lexemes weigh, by passage and question, of occurrences (row, lexeme, n)."""
    key, at = np.unique(row * max(1, len(want.lexemes[a])) + lexeme, return_inverse=True)
    tf = np.bincount(at, n, len(key)).astype(np.int64)
    row, lexeme = np.divmod(key, max(1, len(want.lexemes[a])))
    first = want.first[a]
    many = first[lexeme + 1] - first[lexeme]
    inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    item = want.items[a][np.repeat(first[lexeme], many) + inside]
    width = len(want.item_ids)
    return np.bincount(np.repeat(row, many) * width + item, np.repeat(H2[np.minimum(tf, MOST_POSITIONS)], many), rows * width).reshape(rows, width)


def divisor(norm: int, length: np.ndarray) -> np.ndarray:
    return np.log(length + 1.0) / np.log(2.0) if norm == 1 else length.astype(float) if norm == 2 else np.ones(len(length))


HIT = ["item_id", "analyser", "norm", "doc_id", "authority", "points"]


class Best:
    """The best k passages of each question, jurisdiction (one for all if ``whole``) and cell, of the slices given; at most HELD_ROWS rows are held."""

    def __init__(self, want: Wanted, norms: tuple[int, ...], k: int, whole: bool):
        self.want, self.norms, self.k, self.whole = want, norms, k, whole
        self.held: dict[tuple, tuple[np.ndarray, ...]] = {}

    def add(self, a: str, doc_id: np.ndarray, authority: pa.Array, weight: np.ndarray, length: np.ndarray) -> None:
        score = 0.1 * weight / ZETA2 / np.maximum(1, self.want.n[a])
        names, group = (pa.array([None], pa.string()), np.zeros(len(doc_id), np.int64)) if self.whole else encoded(authority)
        order = np.lexsort((doc_id, group))
        ends = np.searchsorted(group[order], np.arange(len(names) + 1))
        for g, name in enumerate(names.to_pylist()):
            rows = order[ends[g] : ends[g + 1]]
            some = score[rows]
            met = some > 0
            for norm in self.norms:
                with np.errstate(divide="ignore", invalid="ignore"):
                    points = np.floor(some / divisor(norm, length[rows])[:, None] * POINTS + 0.5)
                points = np.where(met, points, -1).astype(np.int64)
                # equal points go to the smaller doc_id: rows are in its order
                rank = points * len(rows) + np.arange(len(rows) - 1, -1, -1)[:, None]
                top = np.argpartition(rank, len(rows) - self.k, axis=0)[len(rows) - self.k :] if len(rows) > self.k else np.broadcast_to(np.arange(len(rows))[:, None], rank.shape)
                item = np.broadcast_to(np.arange(rank.shape[1]), top.shape).ravel()
                top = top.ravel()
                hit = points[top, item]
                here = hit >= 0
                self._merge((name, a, norm), item[here], hit[here], doc_id[rows[top[here]]], rows[top[here]], authority)

    def _merge(self, key: tuple, item: np.ndarray, points: np.ndarray, doc_id: np.ndarray, rows: np.ndarray, authority: pa.Array) -> None:
        found = (item, points, doc_id) if not self.whole else (item, points, doc_id, np.array(authority.take(pa.array(rows)).to_pylist(), object))
        if key in self.held:
            found = tuple(np.concatenate(x) for x in zip(self.held[key], found, strict=True))
        order = np.lexsort((found[2], -found[1], found[0]))
        item = found[0][order]
        order = order[np.arange(len(item)) - np.searchsorted(item, item) < self.k]
        self.held[key] = tuple(x[order] for x in found)

    def full(self) -> bool:
        return sum(len(x[0]) for x in self.held.values()) > HELD_ROWS

    def taken(self) -> Iterator[pa.RecordBatch]:
        """What is held, which is then forgotten."""
        for (name, a, norm), x in self.held.items():
            n = len(x[0])
            where = pa.array(list(x[3]), pa.string()) if self.whole else pa.array([name] * n, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(self.want.item_ids[x[0]]), pa.array([a] * n, pa.string()), pa.array(np.full(n, norm, np.int32)), pa.array(x[2]), where, pa.array(x[1])], HIT)
        self.held = {}


def best(want: Wanted, analysers: tuple[str, ...], norms: tuple[int, ...], k: int, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Entries with lengths to HIT rows: a task's best k passages of each question, jurisdiction and cell."""
    most_rows = max(1, SLICE_CELLS // max(1, len(want.item_ids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Best(want, norms, k, whole)
        values = {a: pa.array(want.lexemes[a], pa.string()) for a in analysers}
        for batch in batches:
            for part in slices(batch, "words", most_rows=most_rows):
                words, row = flat(part["words"])
                vocabulary, code = encoded(words)
                n = pc.list_flatten(part["n"]).to_numpy(zero_copy_only=False)
                doc_id = part["doc_id"].to_numpy(zero_copy_only=False)
                for a, made in pieces(vocabulary, analysers).items():
                    at = np.stack([pc.fill_null(pc.index_in(p, value_set=values[a], skip_nulls=True), -1).to_numpy(zero_copy_only=False) for p in made])[:, code].astype(np.int64)
                    piece, place = np.nonzero(at >= 0)
                    weight = weights(want, a, row[place], at[piece, place], n[place], part.num_rows)
                    found.add(a, doc_id, part["authority"], weight, part[f"length_{a}"].to_numpy(zero_copy_only=False))
                if found.full():
                    yield from found.taken()
        yield from found.taken()

    return run


def block_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, words) to (block, word): the distinct words of rows of one block that come together."""
    for batch in batches:
        block = batch["block"].to_numpy(zero_copy_only=False)
        for at, end in _runs(block):
            for part in slices(batch.slice(at, end - at), "words"):
                words = pc.unique(pc.list_flatten(part["words"]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), block[at])), words], ["block", "word"])


def _runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
    ends = [0, *cuts.tolist(), len(columns[0])]
    return zip(ends[:-1], ends[1:], strict=True)


class Dictionary:
    """What a table makes of a block's words: lexemes of each by analyser, counted (k), and those that are wanted (ids, i * base + lexeme for the analyser i)."""

    def __init__(self, parts: list[pa.RecordBatch], n_analysers: int):
        table = pa.Table.from_batches(parts).combine_chunks().to_batches()
        self.words = table[0]["word"] if table else pa.array([], pa.string())
        k, ids = (table[0]["k"], table[0]["ids"]) if table else (pa.array([], pa.list_(pa.int32())),) * 2
        self.k = pc.list_flatten(k).to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, n_analysers)
        self.ids, row = (x.to_numpy(zero_copy_only=False).astype(np.int64) if isinstance(x, pa.Array) else x for x in flat(ids))
        self.first = np.searchsorted(row, np.arange(len(self.words) + 1))


def looked_up(batches: Iterator[pa.RecordBatch], n_analysers: int, most_rows: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, Dictionary]]:
    """Of rows in the order (block, kind), a block's dictionary (kind 0) before its entries (kind 1): entries, rows, places in the dictionary, counts, the dictionary."""
    mine, parts, known = None, [], None
    for batch in batches:
        block, kind = (batch[c].to_numpy(zero_copy_only=False) for c in ("block", "kind"))
        for at, end in _runs(block, kind):
            if block[at] != mine:
                mine, parts, known = block[at], [], None
            if kind[at] == 0:
                parts.append(batch.slice(at, end - at).select(["word", "k", "ids"]))
                continue
            known = known or Dictionary(parts, n_analysers)
            for part in slices(batch.slice(at, end - at), "words", most_rows=most_rows):
                words, row = flat(part["words"])
                vocabulary, code = encoded(words)
                place = pc.index_in(vocabulary, value_set=known.words)
                if place.null_count:
                    raise ValueError("the table lacks words of the corpus")
                yield part, row, place.to_numpy(zero_copy_only=False).astype(np.int64)[code], pc.list_flatten(part["n"]).to_numpy(zero_copy_only=False), known


def lengths_by(analysers: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of ``looked_up`` to (analyser, doc_id, length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, row, place, n, known in looked_up(batches, len(analysers), 1 << 30):
            for i, a in enumerate(analysers):
                length = np.bincount(row, n * known.k[place, i], part.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([a] * part.num_rows, pa.string()), part["doc_id"], pa.array(length)], ["analyser", "doc_id", "length"])

    return run


def best_by(want: Wanted, analysers: tuple[str, ...], norms: tuple[int, ...], k: int, base: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``best`` over rows of ``looked_up``, by jurisdiction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Best(want, norms, k, False)
        for part, row, place, n, known in looked_up(batches, len(analysers), max(1, SLICE_CELLS // max(1, len(want.item_ids)))):
            many = known.first[place + 1] - known.first[place]
            inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            which, lexeme = np.divmod(known.ids[np.repeat(known.first[place], many) + inside], base)
            at, times = np.repeat(row, many), np.repeat(n, many)
            for i, a in enumerate(analysers):
                mine = which == i
                length = np.bincount(row, n * known.k[place, i], part.num_rows).astype(np.int64)
                found.add(a, part["doc_id"].to_numpy(zero_copy_only=False), part["authority"], weights(want, a, at[mine], lexeme[mine], times[mine], part.num_rows), length)
            if found.full():
                yield from found.taken()
        yield from found.taken()

    return run
