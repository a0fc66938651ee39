"""Fill-in-middle documents: texts cut at two unit ends and put in prefix-suffix-middle order.

The unit ends of a text are kept as a set of byte offsets in the manner of roaring bitmaps: the upper
bits of an offset choose a container, which stores the lower 16 bits as a sorted array, a bitmap or
runs, whichever is smallest. Cumulative cardinalities find the container of the k-th end, and a
select inside it gives the offset, so both cuts of a text come from the set without walking it.
"""

from __future__ import annotations

from bisect import bisect_left

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pitchloom.llm.common import byte_values

BLOCK = 1 << 16
SEED = 42
FORM_PERCENT = 50  # texts in a hundred that are rearranged
SPM_PERCENT = 80   # of these, texts in a hundred that start with the suffix
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# Output bytes that a task holds before it hands them on.
FLUSH_BYTES = 16 << 20


class ArrayContainer:
    """Sorted lower halves, two bytes each."""

    def __init__(self, values: np.ndarray):
        self.values = values.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.values[k])


class BitmapContainer:
    """One bit for each lower half; counts before each 64-bit word make select a search."""

    def __init__(self, values: np.ndarray):
        flags = np.zeros(BLOCK, np.uint8)
        flags[values] = 1
        self.words = np.packbits(flags, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.uint32)

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        word = int(self.words[at])
        for _ in range(k - int(self.before[at])):
            word &= word - 1  # drops the lowest set bit
        return 64 * at + (word & -word).bit_length() - 1


class RunContainer:
    """Starts of runs of neighbours, and how many values come before each run."""

    def __init__(self, values: np.ndarray):
        first = np.flatnonzero(np.diff(values, prepend=-2) != 1)
        self.starts = values[first].astype(np.uint16)
        self.before = first.astype(np.uint16)

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.starts[at]) + k - int(self.before[at])


def container(values: np.ndarray):
    """The smallest of the three kinds for rising lower halves (at least one)."""
    values = values.astype(np.int64)
    runs = 1 + int(np.count_nonzero(np.diff(values) != 1))
    sizes = [(2 * len(values), ArrayContainer), (4 * runs, RunContainer), (BLOCK // 8, BitmapContainer)]
    return min(sizes, key=lambda size: size[0])[1](values)


class BoundarySet:
    """A growing set of offsets; blocks of 65,536 offsets are added in rising order."""

    def __init__(self):
        self.high: list[int] = []
        self.containers: list = []
        self.upto: list[int] = []  # values in all containers up to and with this one

    def add_block(self, high: int, lower: np.ndarray) -> None:
        if len(lower):
            self.high.append(high)
            self.containers.append(container(lower))
            self.upto.append(len(self) + len(lower))

    def __len__(self) -> int:
        return self.upto[-1] if self.upto else 0

    def select(self, k: int) -> int:
        """The k-th value, counted from 0."""
        at = bisect_left(self.upto, k + 1)
        before = self.upto[at - 1] if at else 0
        return self.high[at] * BLOCK + self.containers[at].select(k - before)


def unit_ends(data: bytes) -> BoundarySet:
    """Byte offsets at which units end: a unit is a word with the white space before it, and white
    space at the end of the text is a unit too."""
    ends, size = BoundarySet(), len(data)
    whole = np.frombuffer(data, np.uint8)
    for low in range(0, size + 1, BLOCK):
        # Offset o ends a unit if byte o - 1 is part of a word and byte o is not, or at the text's end.
        part = whole[max(0, low - 1):low + BLOCK]
        word = ~((part == 32) | ((part >= 9) & (part <= 13)))
        found = np.flatnonzero(word[:-1] & ~word[1:]) + (1 if low == 0 else 0)
        if size and low <= size < low + BLOCK:
            found = np.append(found, size - low)
        ends.add_block(low // BLOCK, found)
    return ends


def draws(doc_id) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 from the id; a null id counts as the empty text."""
    digest = hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[at:at + 4], "big") for at in (0, 4, 8, 12))


def characters(data: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return len(data) - int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) == 0x80))


MARKS = tuple(mark.encode() for mark in (PREFIX, SUFFIX, MIDDLE))


def rearrange(doc_id, data: bytes) -> tuple:
    """(units, form, code points of prefix and middle or None, output) of one text."""
    ends = unit_ends(data)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id)
    if not data or h3 % 100 >= FORM_PERCENT or any(mark in data for mark in MARKS):
        return n, "plain", None, None, data
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    first, second = (ends.select(k - 1) if k else 0 for k in (low, high))
    prefix, middle, suffix = data[:first], data[first:second], data[second:]
    p, s, m = MARKS
    if h4 % 100 < SPM_PERCENT:
        form, output = "spm", b"".join((s, suffix, p, prefix, m, middle))
    else:
        form, output = "psm", b"".join((p, prefix, s, suffix, m, middle))
    return n, form, characters(prefix), characters(middle), output


def transform(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), a row for every row of ``docs``.

    Null texts are empty; empty texts and texts that hold a mark stay as they are (form plain, null
    character counts). Repeated rows give equal rows, as the draw depends on the id alone; an empty
    table gives none. Only doc_id and text are read. A task holds one text and its set at a time.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            rows, held = [], 0

            def made():
                columns = list(zip(*rows))
                types = [ids.type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_binary()]
                arrays = [pa.array(c, t) for c, t in zip(columns, types)]
                arrays[5] = arrays[5].cast(pa.large_string())
                return pa.RecordBatch.from_arrays(arrays, names=names)

            for doc_id, data in zip(ids.to_pylist(), byte_values(batch.column(1))):
                rows.append((doc_id, *rearrange(doc_id, data)))
                held += len(data)
                if held > FLUSH_BYTES:
                    yield made()
                    rows, held = [], 0
            if rows:
                yield made()

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text behind an output, from its form and the marks alone."""
    def after(mark):
        return F.instr(output, mark) + F.lit(len(mark))

    def between(start, mark):
        return F.substr(output, start, F.instr(output, mark) - start)

    middle = F.substr(output, after(MIDDLE))
    return (
        F.when(form == "psm", F.concat(
            between(F.lit(1 + len(PREFIX)), SUFFIX), middle, between(after(SUFFIX), MIDDLE)))
        .when(form == "spm", F.concat(
            between(after(PREFIX), MIDDLE), middle, between(F.lit(1 + len(SUFFIX)), PREFIX)))
        .otherwise(output)
    )


def report(docs: DataFrame) -> DataFrame:
    """Digests of outputs and of the texts restored from them."""
    made = transform(docs)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


REPORT_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS hex,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents
), drawn AS (
  SELECT *, len(u) AS n, ('0x' || hex[1:8])::BIGINT % (len(u) + 1) AS c1,
    ('0x' || hex[9:16])::BIGINT % (len(u) + 1) AS c2,
    ('0x' || hex[17:24])::BIGINT % 100 AS c3, ('0x' || hex[25:32])::BIGINT % 100 AS c4
  FROM units
), cut AS (
  SELECT *, array_to_string(u[1:least(c1, c2)], '') AS p,
    array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
    array_to_string(u[greatest(c1, c2) + 1:n], '') AS s,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
      OR c3 >= 50 THEN 'plain' WHEN c4 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN len(p)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN len(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut
"""
