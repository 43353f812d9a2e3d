"""Quality rules as a short-circuit cascade.

Each rule takes some texts and says which it rejects. On a bounded sample every rule is timed and its rejections counted;
the cascade then puts first, again and again, the rule with the most rejections per second among the sample's survivors.
A text meets a rule only if all earlier ones let it pass, so the order changes the cost and never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kaivo.llm.scratch import bounded
from kaivo.llm.texts import Texts, mixed, slices, sums_by

#: Bound of the sample that orders the rules: so many rows of at most so many bytes. Longer texts don't help to order them.
SAMPLE, SAMPLE_BYTES = 400, 1 << 16
MIN_WORDS, MAX_REPEATED = 50, 50
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0xC3:] = True  # lead bytes from U+00C0 on
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True


def per_row(t: Texts, mask: np.ndarray) -> np.ndarray:
    """True bytes of each row."""
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[t.off[1:]] - total[t.off[:-1]]


def lines(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of each line with a word; lines are split by \\n."""
    cut = np.union1d(np.flatnonzero(t.data == 10) + 1, t.off)
    start, end = cut[:-1], cut[1:]
    row = np.searchsorted(t.off, start, "right") - 1
    end = end - ((t.data[end - 1] == 10) & (end > start))
    full = np.searchsorted(t.ws, end) > np.searchsorted(t.ws, start)
    return row[full], start[full], end[full]


def _keys(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """64 bits of (row, hash)."""
    return mixed(h + mixed(row.astype(np.uint64)))


def _later(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of items with equal row and hash: which are not the first, and which aren't alone."""
    key = _keys(row, h)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later, many = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
    later[order[1:]] = same
    many[order[1:]] = same
    many[order[:-1]] |= same
    return later, many


def features(t: Texts) -> dict[str, np.ndarray]:
    """The base counts of each row, FEATURES."""
    t.hashed_words()
    row, start, end = lines(t)
    dup = np.bincount(row[_later(row, t.hash_spans(start, end))[0]], minlength=t.n)
    at, g = t.grams(3)
    _, many = _later(t.wd[at], g)
    hit = np.zeros(len(t.wd) + 2, dtype=bool)
    for k in range(3):
        hit[at[many] + k] = True
    return {
        "n_words": t.wn.astype(np.int64),
        "word_chars": per_row(t, ~t.space() & ((t.data & 0xC0) != 0x80)),
        "n_symbols": per_row(t, _SYMBOL[t.data]),
        "n_dup_lines": dup.astype(np.int64),
        "n_repeat_words": sums_by(hit[: len(t.wd)].astype(np.int64), t.wn),
    }


@dataclass(frozen=True)
class Rule:
    """``rejects``: (texts, their base counts) -> which rows it rejects."""

    name: str
    rejects: Callable[[Texts, dict[str, np.ndarray]], np.ndarray]


def _share(of: np.ndarray, among: np.ndarray, most: float) -> np.ndarray:
    return of > most * among


def _shouting(t: Texts, f: dict[str, np.ndarray]) -> np.ndarray:
    return _share(per_row(t, _UPPER[t.data]), per_row(t, _LETTER[t.data]), 0.5)


def _numbers(t: Texts, f: dict[str, np.ndarray]) -> np.ndarray:
    return _share(per_row(t, _DIGIT[t.data]), f["word_chars"], 0.4)


def _letters(t: Texts, f: dict[str, np.ndarray]) -> np.ndarray:
    """Fewer than half of the characters in words are letters."""
    return 2 * per_row(t, _LETTER[t.data]) < f["word_chars"] - per_row(t, (t.data >= 0x80) & (t.data < 0xC3) & ((t.data & 0xC0) != 0x80))


def _one_word(t: Texts, f: dict[str, np.ndarray]) -> np.ndarray:
    """One word makes more than 30 percent of the text."""
    t.hashed_words()
    key = _keys(t.wd, t.h)
    order = np.argsort(key)
    key = key[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    most = np.zeros(t.n, dtype=np.int64)
    np.maximum.at(most, t.wd[order[edge]], np.diff(np.append(edge, len(key))))
    return _share(most, f["n_words"], 0.3)


#: The method's own rules. Those of Latin letters count letters outside ASCII as letters.
RULES = (
    Rule("symbols", lambda t, f: _share(f["n_symbols"], f["n_words"], 0.1)),
    Rule("dup_lines", lambda t, f: _share(2 * f["n_dup_lines"], np.maximum(np.bincount(lines(_worded(t))[0], minlength=t.n), 1), 1.0)),
    Rule("word_length", lambda t, f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 20 * f["n_words"])),
    Rule("shouting", _shouting),
    Rule("numbers", _numbers),
    Rule("letters", _letters),
    Rule("one_word", _one_word),
)


def _worded(t: Texts) -> Texts:
    if not hasattr(t, "ws"):
        t.words()
    return t


def subset(t: Texts, rows: np.ndarray) -> Texts:
    """These rows' texts, copied."""
    n = np.diff(t.off)[rows]
    off = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(t.off[:-1][rows] - off[:-1], n) + np.arange(off[-1])
    return Texts(t.data[at], off)


def cascade(t: Texts, f: dict[str, np.ndarray], rules: tuple[Rule, ...], alive: np.ndarray) -> np.ndarray:
    """Which of the ``alive`` rows no rule rejects, and the name index of the rule that rejected the others (-1: none)."""
    by = np.full(t.n, -1, dtype=np.int64)
    rows = np.flatnonzero(alive)
    own = None
    for k, rule in enumerate(rules):
        if not len(rows):
            break
        if own is None:
            own, ff = subset(t, rows), {n: v[rows] for n, v in f.items()}
        bad = rule.rejects(own, ff)
        by[rows[bad]] = k
        if bad.any():
            rows, own = rows[~bad], None
    return by


def ordered(texts: list[str], rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """The rules by rejection per cost on these texts, each judged on what the earlier ones leave."""
    raw = [x.encode() for x in texts]
    t = Texts(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
    if not t.n:
        return rules
    f = features(t)
    seen = {}
    for rule in rules:
        own = subset(t, np.arange(t.n))
        began = time.perf_counter()
        bad = rule.rejects(own, f)
        seen[rule.name] = bad, max(time.perf_counter() - began, 1e-7)
    left, out = list(rules), []
    alive = np.ones(t.n, dtype=bool)
    while left:
        best = max(left, key=lambda r: ((seen[r.name][0] & alive).sum() / seen[r.name][1], -seen[r.name][1]))
        out.append(best)
        left.remove(best)
        alive &= ~seen[best.name][0]
    return tuple(out)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> DataFrame:
    """doc_id, FEATURES, base_failed, kept, rejected_by of each row of ``docs`` (doc_id, text), from its whole text.

    A null text has no words. base_failed: fewer than MIN_WORDS words, or more than MAX_REPEATED percent repeated; such rows
    skip the cascade and aren't kept. rejected_by: ``base``, a rule that rejects the text (which of several depends on the
    order of the cascade), or null. Repeated rows give repeated rows; an empty table none; other columns are ignored.
    """
    docs = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rules = ordered([r["text"] for r in docs.where(f"octet_length(text) <= {SAMPLE_BYTES}").sample(0.2, seed=11).limit(sample).collect()], rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([r.name for r in rules] + ["base"])
        for batch, t in slices(batches):
            f = features(t)
            failed = (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEATED * f["n_words"])
            by = np.where(failed, len(rules), cascade(t, f, rules, ~failed))
            rejected = names.take(pa.array(by, pa.int64(), mask=by < 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(f[n]) for n in FEATURES), pa.array(failed), pa.array(by < 0), rejected], names=["doc_id", *FEATURES, "base_failed", "kept", "rejected_by"])

    return docs.mapInArrow(run, f"doc_id long, {', '.join(f'{n} long' for n in FEATURES)}, base_failed boolean, kept boolean, rejected_by string")
