"""Quality rules on repetition inside a text, from a suffix array over its words.

The words of many texts stand in one array, each marked with its text, so no common prefix leaves a
text. Prefix doubling sorts the suffixes, and the ranks of its rounds give the longest common prefix
of neighbours. The deepest common-prefix interval that holds a suffix is as long as the longer of the
two prefixes beside it, and is a maximal repeat from there on; the union of these spans is what
repeats cover. A text is kept if little of it is covered and no repeat is long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pitchloom.llm.common import byte_values, word_slices

# Words that a repeat needs to count as covering, and the limits of a kept text.
LEAST_REPEAT = 5
MOST_COVERED = 0.4
LONGEST_REPEAT = 60
# Base rules.
LEAST_WORDS = 50
WINDOW = 3
# Words whose suffixes are sorted together; a longer text is sorted alone.
BATCH_WORDS = 400_000
SYMBOL, SPACE, LEADING = (np.zeros(256, bool) for _ in range(3))
SYMBOL[list(b"#*$%&|<>")] = True
SPACE[list(b" \t\n\x0b\x0c\r")] = True
LEADING[[b for b in range(256) if b & 0xC0 != 0x80]] = True

SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, covered_words bigint, longest_repeat bigint"
)


def longest_repeats(keys: np.ndarray) -> np.ndarray:
    """For each place the length of the longest run of keys from it that is found elsewhere too.

    No run may hold a key that is unique; the last key must be unique.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    starts = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = starts
    alone = new & np.r_[new[1:], True]
    active, levels, reach = order[~alone], [rank.astype(np.int32)], 1
    while len(active):
        pairs = rank[active] * n + rank[active + reach]
        by = np.argsort(pairs, kind="stable")
        active, pairs = active[by], pairs[by]
        own = rank[active]
        m = np.arange(len(active))
        group = np.maximum.accumulate(np.where(np.r_[True, own[1:] != own[:-1]], m, 0))
        new = np.r_[True, pairs[1:] != pairs[:-1]]
        rank = rank.copy()
        rank[active] = own + np.maximum.accumulate(np.where(new, m, 0)) - group
        levels.append(rank.astype(np.int32))
        active = active[~(new & np.r_[new[1:], True])]
        reach *= 2
    places = np.empty(n, np.int64)
    places[rank] = np.arange(n)
    # Neighbours in the order that share their first key at least.
    at = 1 + np.flatnonzero(levels[0][places[1:]] == levels[0][places[:-1]])
    left, right, shared = places[at - 1], places[at], np.zeros(len(at), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        ranks = levels[level]
        shared += (ranks[left + shared] == ranks[right + shared]) * (1 << level)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, left, shared)
    np.maximum.at(longest, right, shared)
    return longest


def _covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Which places lie in a repeat of at least ``least`` keys."""
    steps = np.zeros(len(longest) + 1, np.int64)
    begin = np.flatnonzero(longest >= least)
    np.add.at(steps, begin, 1)
    np.add.at(steps, begin + longest[begin], -1)
    return np.cumsum(steps[:-1]) > 0


def measure(texts: list[bytes], least_repeat: int = LEAST_REPEAT) -> np.ndarray:
    """[text, measure]: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered, longest."""
    out = np.zeros((len(texts), 7), np.int64)
    known: dict[bytes, int] = {}
    parts, owners, first = [], [], 0
    held = 0
    for row, data in enumerate(texts):
        chars = np.frombuffer(data, np.uint8)
        out[row, 1] = LEADING[chars].sum() - SPACE[chars].sum()
        out[row, 2] = SYMBOL[chars].sum()
        lines = [line for line in data.split(b"\n") if line.strip()]
        out[row, 3] = len(lines) - len(set(lines))
        ids = []
        for words in word_slices(data):
            ids.extend([known.setdefault(word, len(known)) for word in words])
        out[row, 0] = len(ids)
        parts.append(np.array(ids, np.int64))
        held += len(ids)
        if held >= BATCH_WORDS or row + 1 == len(texts):
            _repeats(parts, out[first:row + 1], len(known), least_repeat)
            parts, first, held = [], row + 1, 0
            known.clear()
    return out


def _repeats(parts: list[np.ndarray], out: np.ndarray, n_known: int, least_repeat: int) -> None:
    lengths = np.array([len(p) + 1 for p in parts])
    # Each text ends in a key of its own, which no other place has.
    keys = np.concatenate([np.append(p, n_known) + text * (n_known + 1) for text, p in enumerate(parts)])
    longest = longest_repeats(keys)
    starts = np.cumsum(lengths) - lengths
    out[:, 4] = np.add.reduceat(_covered(longest, WINDOW).astype(np.int64), starts)
    out[:, 5] = np.add.reduceat(_covered(longest, least_repeat).astype(np.int64), starts)
    out[:, 6] = np.maximum.reduceat(longest, starts)


def quality(docs: DataFrame, least_repeat: int = LEAST_REPEAT, most_covered: float = MOST_COVERED,
            longest_repeat: int = LONGEST_REPEAT) -> DataFrame:
    """doc_id, base measures, verdict and repeat measures of every row of ``docs`` (doc_id, text, ...).

    Null texts count as empty; texts under 50 words fail the base rules. Repeated rows each come
    back. A text's words are all in one task, as the row itself is.
    """
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                m = measure(byte_values(part.column(1)), least_repeat)
                n = m[:, 0]
                failed = (n < LEAST_WORDS) | (100 * m[:, 4] > 50 * n)
                kept = ~failed & (m[:, 5] <= most_covered * n) & (m[:, 6] <= longest_repeat)
                columns = [pa.array(m[:, i]) for i in range(5)]
                columns += [pa.array(failed), pa.array(kept), pa.array(m[:, 5]), pa.array(m[:, 6])]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(part.split()[0] for part in SCHEMA.split(", "))]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
