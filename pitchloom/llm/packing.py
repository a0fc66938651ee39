"""Hierarchical packing of documents into training sequences of several context sizes.

Each task packs the documents of its own input split, so no text is shuffled. It routes what is left
of a document after whole longest windows to the smallest context size that holds it, packs the
sizes from long to short, fills what a window has free with documents of shorter sizes, and cuts a
document only to close a gap. A window that cannot be closed stays open until more documents have
come. At the end of a split the rest is cut into sequences at powers of two, so nothing is padded.
Sequences of one size are dealt to step groups of equal numbers of tokens.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_right, insort
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from pitchloom.llm.common import byte_values, word_slices

# Context sizes, each a power of two; the last is the longest sequence.
TIERS = (512, 1024, 2048, 4096)
LONGEST = TIERS[-1]
# Tokens of a step group: so many sequences of a size make a step.
STEP_TOKENS = 1 << 16
END_ID = 2
# Tokens of documents that a task packs together, and words whose ids a worker keeps (about 200 bytes each).
POOL_TOKENS = 1 << 21
CACHE_WORDS = 690_000
MARK, SPECIAL = b"~", b"<|"
# Words of printable ASCII, and how the vocabulary's own pattern (a fixed value of its file) cuts them.
ASCII_WORD = re.compile(rb"[\x21-\x7e]+")
PIECE = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
TOKENIZER = "word_bpe_49k.json"


class WordTokenizer:
    """Ids of whole texts. The vocabulary never merges over white space, so each word between
    ASCII white space is looked up by itself, in lower case (A-Z), as the vocabulary has it. The ids of
    words seen lie end to end in one buffer, which is begun anew when it holds ``most`` words."""

    def __init__(self, path: str, most: int = CACHE_WORDS):
        self.most = most
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.mark = self._encode(MARK.decode())[0]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held, self.starts = array("I"), array("q", [0])

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _hold(self, words: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        """Keep words whose ids lie end to end in ``ids``, each up to its end."""
        had = len(self.starts) - 1
        self.known.update(zip(words, range(had, had + len(words))))
        self.starts.frombytes((len(self.held) + ends.astype(np.int64)).tobytes())
        self.held.frombytes(ids.astype(np.uint32).tobytes())

    def _learn(self, words: list[bytes]) -> None:
        """Hold the ids of words. Printable ASCII ones are cut into the vocabulary's pieces, whose ids are
        looked up or worked out one by one; the others go through the tokenizer, many in one call, with a
        mark, which is one id, between them."""
        fresh: dict[bytes, list[int]] = {}
        other = []
        for word in words:
            if SPECIAL in word or not ASCII_WORD.fullmatch(word):
                other.append(word)
                continue
            ids: list[int] = []
            for piece in PIECE.findall(word.lower()):
                if piece not in fresh:
                    at = self.known.get(piece)
                    fresh[piece] = (
                        [token.id for token in self.model.tokenize(piece.decode())] if at is None
                        else self.held[self.starts[at]:self.starts[at + 1]].tolist())
                ids += fresh[piece]
            fresh[word] = ids
        new = [word for word in fresh if word not in self.known]
        if new:
            self._hold(new, np.array([i for w in new for i in fresh[w]], np.uint32),
                       np.cumsum([len(fresh[w]) for w in new]))
        for word in other:
            if MARK in word:
                ids = np.array(self._encode(word.decode("utf-8", "replace")), np.uint32)
                self._hold([word], ids, np.array([len(ids)]))
        other = [w for w in other if MARK not in w]
        for at in range(0, len(other), 2000):
            some = other[at:at + 2000]
            ids = np.array(self._encode((b" " + MARK + b" ").join(some).decode("utf-8", "replace")), np.uint32)
            between = ids == self.mark
            cuts = np.append(np.flatnonzero(between), len(ids))
            self._hold(some, ids[~between], cuts - np.arange(len(cuts)))

    def ids(self, data: bytes) -> np.ndarray:
        parts = []
        # Special tokens are told apart by case.
        for words in word_slices(data if SPECIAL in data else data.lower()):
            which = self._places(words)
            unknown = np.flatnonzero(which < 0).tolist()
            if unknown:
                fresh = {words[at] for at in unknown}
                if len(self.known) + len(fresh) > self.most:
                    self._forget()
                    fresh = set(words)
                self._learn(list(fresh))
                which = self._places(words)
            parts.append(np.frombuffer(self.held, np.uint32)[_spans(np.frombuffer(self.starts, np.int64), which)])
        parts.append(np.array([END_ID], np.uint32))
        return np.concatenate(parts)

    def _places(self, words: list[bytes]) -> np.ndarray:
        """Place of each word among those held, -1 for others."""
        return np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))


def _spans(starts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places of the ids of words, one word after the other."""
    first = starts[which]
    sizes = starts[which + 1] - first
    ends = np.cumsum(sizes)
    return np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


_TOKENIZERS: dict[tuple, WordTokenizer] = {}


def _tokenizer(path: str, most: int) -> WordTokenizer:
    """One for each worker process, which keeps the ids of words from task to task."""
    if (path, most) not in _TOKENIZERS:
        _TOKENIZERS[path, most] = WordTokenizer(path, most)
    return _TOKENIZERS[path, most]


class Packer:
    """Packs documents, given as arrays of ids, into sequences of at most the longest tier.

    ``emit(size, pieces)`` is called for each closed sequence; a piece is (document, start, length).
    """

    def __init__(self, emit, tiers=TIERS):
        self.emit, self.tiers = emit, tiers
        # For each tier, rising (length, order, document, start) of what waits for a window.
        self.waiting: list[list[tuple]] = [[] for _ in tiers]
        self.order = 0
        self.tokens = 0

    def add(self, document, length: int) -> None:
        start = 0
        while length - start >= self.tiers[-1]:
            self.emit(self.tiers[-1], [(document, start, self.tiers[-1])])
            start += self.tiers[-1]
        if length > start:
            self._wait(document, start, length - start)

    def _wait(self, document, start: int, length: int) -> None:
        tier = next(i for i, size in enumerate(self.tiers) if length <= size)
        insort(self.waiting[tier], (length, self.order, document, start), key=lambda x: x[:2])
        self.order += 1
        self.tokens += length

    def _take(self, tier: int, room: int):
        """The longest piece of a tier that fits ``room``, or None."""
        rows = self.waiting[tier]
        at = bisect_right(rows, room, key=lambda x: x[0])
        if not at:
            return None
        length, _, document, start = rows.pop(at - 1)
        self.tokens -= length
        return document, start, length

    def _cut(self, tiers, room: int):
        """The first ``room`` ids of the shortest piece that is longer, of the first tier with one."""
        for tier in tiers:
            if self.waiting[tier]:
                length, _, document, start = self.waiting[tier].pop(0)
                self.tokens -= length
                self._wait(document, start + room, length - room)
                return document, start, room
        return None

    def pack(self, keep: int = LONGEST) -> None:
        """Close windows, from the longest size down, while more than ``keep`` tokens wait."""
        for tier in range(len(self.tiers) - 1, -1, -1):
            size = self.tiers[tier]
            while self.waiting[tier] and self.tokens >= max(size, keep):
                pieces, room = [self._take(tier, size)], size
                room -= pieces[0][2]
                while room:
                    piece = None
                    for other in range(tier, -1, -1):
                        piece = self._take(other, room)
                        if piece:
                            break
                    # Nothing fits whole: all that waits is longer than the room, so one is cut.
                    piece = piece or self._cut(list(range(len(self.tiers))), room)
                    pieces.append(piece)
                    room -= piece[2]
                self.emit(size, pieces)

    def finish(self) -> None:
        """Pack what is left, then cut the rest into sequences at powers of two."""
        self.pack(keep=0)
        rest = [(d, s, n) for rows in self.waiting for n, _, d, s in rows]
        left = sum(piece[2] for piece in rest)
        self.waiting, self.tokens = [[] for _ in self.tiers], 0
        while left:
            size = min(self.tiers[-1], 1 << (left.bit_length() - 1))
            left -= size
            pieces, room = [], size
            while room:
                document, start, length = rest.pop()
                part = min(length, room)
                pieces.append((document, start, part))
                if part < length:
                    rest.append((document, start + part, length - part))
                room -= part
            self.emit(size, pieces)


SCHEMA = (
    "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
    "offset bigint, context bigint, step_id bigint"
)


def pack(docs: DataFrame, tokenizer_path: str | None = None, with_ids: bool = False,
         cache_words: int = CACHE_WORDS) -> DataFrame:
    """One row per piece of every row of ``docs`` (doc_id, text, any others).

    start, length: the piece among its document's ids (which end in id 2); offset: its place in the
    sequence; context: the sequence's length; step_id: its step group; with ``with_ids`` also
    the piece's ids, which are the training data. A null or empty text is one end id. Repeated rows
    are packed each. Ids of sequences and steps hold the number of the split that made them.
    ``cache_words`` bounds the words whose ids a worker keeps between tasks; it changes no result.
    """
    path = tokenizer_path or public_tokenizers.path(TOKENIZER)
    kind = docs.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, {SCHEMA}" + (", ids array<int>" if with_ids else "")

    def run(batches):
        tokenizer = _tokenizer(path, cache_words)
        first = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        steps: dict[int, list[int]] = {}
        count = [0, 0]

        def emit(size, pieces):
            step = steps.setdefault(size, [0, 0])
            if not step[0] % max(1, STEP_TOKENS // size):
                step[1] = count[1]
                count[1] += 1
            step[0] += 1
            offset = 0
            for (doc_id, ids), start, length in pieces:
                part = ids[start:start + length]
                row = (doc_id, start, length, zlib.crc32(part.astype("<u4").tobytes()), len(ids),
                       first + count[0], offset, size, first + step[1])
                rows.append(row + (part.tolist(),) if with_ids else row)
                offset += length
            count[0] += 1

        def flush():
            if rows:
                columns = list(zip(*rows))
                arrays = [pa.array(columns[0])] + [pa.array(c, pa.int64()) for c in columns[1:9]]
                if with_ids:
                    arrays.append(pa.array(columns[9], pa.list_(pa.int32())))
                names = ["doc_id", *(part.split()[0] for part in SCHEMA.split(", "))]
                yield pa.RecordBatch.from_arrays(arrays, names=names + ["ids"] * with_ids)
                rows.clear()

        packer = Packer(emit)
        for batch in batches:
            doc_ids = batch.column(0)
            for at, data in enumerate(byte_values(batch.column(1))):
                ids = tokenizer.ids(data)
                packer.add((doc_ids[at].as_py(), ids), len(ids))
                if packer.tokens > POOL_TOKENS:
                    packer.pack(keep=POOL_TOKENS // 8)
                if len(rows) > 5_000:
                    yield from flush()
        packer.finish()
        yield from flush()

    return docs.select("doc_id", "text").mapInArrow(run, schema)
