"""Cost-balanced packing of tokenised documents into fixed-length training sequences.

The estimated cost of a sequence is LINEAR * tokens + sum over its pieces of tokens^2 / SCALE (attention
stays inside a document). Documents go in descending length, each to the sequence of lowest cost that has
token capacity left; where it doesn't fit it is cut and goes on in the next cheapest one. As many sequences
are opened as the tokens need, so only the last sequence of a buffer can have padding.

Each task packs the documents of its own partition, a buffer of bounded size at a time: no shuffle, and a
lost task is repeated alone. Small partitions are read together, so that padding doesn't grow with their number. Text never leaves
the task; rows out are pieces. Whole sequences cut off a long document cost what they cost anywhere; the balance is of the rest.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kaivo.llm.scratch import bounded

SEQUENCE = 1024
#: Tokens held by a task at once; a single document may exceed it.
BUFFER = 1 << 21
LINEAR, SCALE = 1.0, 1024.0
#: Bytes of the plan's own estimate that a partition should hold at least; smaller ones are read together.
PARTITION = 2 << 20
#: Texts longer than this many characters are tokenised in parts, cut where no token can cross.
PART = 1 << 16
VOCABULARY = "byte_bpe_50k"
_CUT = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


def parts(text: str, size: int = PART) -> Iterator[str]:
    """Parts of a text whose tokens, joined, are the text's: a cut lies before a single space between letters."""
    at = 0
    while len(text) - at > size:
        m = _CUT.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def tokenizer(folder: str | None = None, name: str = VOCABULARY) -> Callable[[str], list[int]]:
    """Text -> ids of the byte-level BPE. ``folder`` holds the vocabulary files (None: the installed ones).

    Uses the rank file of the vocabulary, which gives the ids of the JSON file (tested) in a quarter of the
    CPU time. What can't be matched by its regular expression engine (say, a megabyte of blanks) goes to the JSON file's.
    """
    import public_tokenizers as public
    import tiktoken

    def file(x: str) -> str:
        return f"{folder}/{x}" if folder else public.path(x)

    with open(file(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    fast = tiktoken.Encoding(name, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow: list = []

    def encode(text: str) -> list[int]:
        ids: list[int] = []
        for part in parts(text):
            try:
                ids += fast.encode_ordinary(part)
            except BaseException as e:  # the engine's own panic isn't an Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
                if not slow:
                    from tokenizers import Tokenizer

                    slow.append(Tokenizer.from_file(file(f"{name}.json")))
                    slow[0].encode_special_tokens = True
                ids += slow[0].encode(part, add_special_tokens=False).ids
        return ids

    return encode


def assign(lengths: np.ndarray, capacity: int = SEQUENCE, first: int = 0) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray]:
    """Pieces (document, start, length, sequence, offset) of documents with these lengths (all > 0), and each sequence's tokens.

    Whole sequences are cut off long documents first; what is left goes in descending length (ties: input order).
    """
    total = int(lengths.sum())
    n = -(-total // capacity)
    pieces, filled, used = [], np.zeros(n, dtype=np.int64), 0
    for d in np.flatnonzero(lengths >= capacity):
        for k in range(int(lengths[d]) // capacity):
            pieces.append((int(d), k * capacity, capacity, first + used, 0))
            filled[used] = capacity
            used += 1
    rest = lengths % capacity
    heap = [(0.0, s) for s in range(used, n)]
    for d in np.argsort(-rest, kind="stable"):
        left = int(rest[d])
        start = int(lengths[d]) - left
        while left:
            cost, s = heap[0]
            room = capacity - int(filled[s])
            take = min(left, room)
            pieces.append((int(d), start, take, first + s, int(filled[s])))
            filled[s] += take
            if take == room:
                heapq.heappop(heap)
            else:
                heapq.heapreplace(heap, (cost + LINEAR * take + take * take / SCALE, s))
            start, left = start + take, left - take
    return pieces, filled


def pack(docs: DataFrame, capacity: int = SEQUENCE, end_id: int = 0, folder: str | None = None, buffer: int = BUFFER) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): PIECES.

    A null text is empty: its document is the end id alone. Repeated rows are packed each by itself, and a null
    doc_id stays null. An empty table gives no rows. Other columns are ignored. ``sequence_id`` is unique, not gapless.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = tokenizer(folder)
        base, used = TaskContext.get().partitionId() << 40, 0
        ids: list[np.ndarray] = []
        keys: list[int | None] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal used
            if not ids:
                return
            pieces, filled = assign(np.array([len(x) for x in ids], dtype=np.int64), capacity, 0)
            for at in range(0, len(pieces), 50_000):
                some = pieces[at : at + 50_000]
                d, start, length, seq, off = (np.array(x, dtype=np.int64) for x in zip(*some, strict=True))
                crc = [zlib.crc32(memoryview(ids[i][s : s + n])) for i, s, n, *_ in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[i] for i in d], pa.int64()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array([len(ids[i]) for i in d], pa.int64()), pa.array(seq + used + base), pa.array(off), pa.array(filled[seq])],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens"],
                )
            used += len(filled)
            ids.clear()
            keys.clear()

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = encode(text.as_py() or "")
                got.append(end_id)
                ids.append(np.array(got, dtype="<u4"))
                keys.append(key)
                held += len(got)
                if held >= buffer:
                    yield from flush()
                    held = 0
        yield from flush()

    rows = bounded(docs).selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = docs.rdd.getNumPartitions()
    return rows.coalesce(max(1, min(parts, size // PARTITION))).mapInArrow(run, PIECES)
