"""Byte-level BPE ids of texts, and texts from ids, by DuckDB queries inside each partition.

A task holds an in-process DuckDB with two tables: the pieces of the vocabulary, and the merges, one
row for each pair of pieces whose concatenation is a piece. Texts are split into words; words that are
no piece themselves become one row for each byte. A recursive query joins neighbouring rows with the
merges and contracts each word's leftmost pair of least rank until no pair is left. The ids of a
text are those of its words; ids are turned back into bytes by a join with the pieces and an ordered
aggregation. Each distinct word of a task is encoded once while it stays among the held words.

No SQL twin: the vocabulary is a file beside the tables, so tests hold both ways against tiktoken.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Distinct words a worker holds with their ids (about 150 bytes each), and the bytes of words in one recursive query.
HELD_WORDS = 800_000
QUERY_BYTES = 1_000_000
# Longer words are contracted many pairs at a time, this many rows over all rounds of a query.
LONG_BYTES = 256
ROUND_ROWS = 2_000_000
# Text that is split into words at once, and ids in one decoding query.
SLICE_CHARS = 1 << 20
DECODE_ROWS = 300_000
FLUSH_IDS = 2_000_000
# Words of several texts that are learnt together, and characters of texts encoded at once.
GROUP_WORDS = 1_000_000
GROUP_CHARS = 4 << 20

# Rows are (word, position, id); positions rise over all words of the query, so neighbours come from one
# ordering and a word's end is where the next row has another word. k orders the pairs of a word by
# rank, then position. The row at the right of the contracted pair goes.
CONTRACT = """
WITH RECURSIVE s AS (
  SELECT w, p, t, false AS done FROM base
  UNION ALL
  (WITH pairs AS MATERIALIZED (
    SELECT a.w, a.p, a.t, a.p_right, m.id::BIGINT << 32 | a.p AS k
    FROM (
      SELECT w, p, t, CASE WHEN lead(w) OVER o = w THEN lead(t) OVER o END AS t_right, lead(p) OVER o AS p_right
      FROM s WHERE NOT done WINDOW o AS (ORDER BY p)
    ) a LEFT JOIN merges m ON m.pair = (a.t::BIGINT << 32 | a.t_right)
  ), least AS (
    SELECT w, min(k) AS k, arg_min(p_right, k) AS gone FROM pairs GROUP BY w
  )
  SELECT x.w, x.p, CASE WHEN x.k = l.k THEN (x.k >> 32)::INTEGER ELSE x.t END, l.k IS NULL
  FROM pairs x JOIN least l USING (w) WHERE l.gone IS NULL OR x.p <> l.gone)
)
SELECT w, p, t FROM s WHERE done
"""

# The same contraction, many pairs of one word in a round. All pairs of least rank come one after
# the other, from the left, unless one of them makes a new pair of lower rank; so a round contracts
# them up to and with the first that does. In a run of overlapping pairs (aaaa) every other one counts.
CONTRACT_LONG = """
WITH RECURSIVE s AS (
  SELECT p, t, 0 AS round, false AS done FROM base
  UNION ALL
  SELECT p, CASE WHEN merged THEN rank ELSE t END, round + 1, least_rank IS NULL
  FROM (
    SELECT *, coalesce(lag(merged) OVER (ORDER BY p), false) AS gone
    FROM (
      SELECT *, coalesce(chosen AND p <= coalesce(min(CASE WHEN lower THEN p END) OVER (), p), false) AS merged
      FROM (
        SELECT f.*, f.chosen AND (l.id < f.rank OR r.id < f.rank) AS lower
        FROM (
          SELECT *, CASE WHEN lag(chosen, 2) OVER (ORDER BY p) THEN rank ELSE lag(t) OVER (ORDER BY p) END AS before,
            lead(t, 2) OVER (ORDER BY p) AS after
          FROM (
            SELECT *, least AND row_number() OVER (PARTITION BY least, island ORDER BY p) % 2 = 1 AS chosen
            FROM (
              SELECT *, row_number() OVER (ORDER BY p) - row_number() OVER (PARTITION BY least ORDER BY p) AS island
              FROM (
                SELECT *, coalesce(rank = least_rank, false) AS least
                FROM (
                  SELECT a.*, m.id AS rank, min(m.id) OVER () AS least_rank
                  FROM (
                    SELECT p, t, round, lead(t) OVER (ORDER BY p) AS t_right
                    FROM s WHERE NOT done AND round < $rounds
                  ) a LEFT JOIN merges m ON m.pair = (a.t::BIGINT << 32 | a.t_right)
                )
              )
            )
          )
        ) f
        LEFT JOIN merges l ON f.chosen AND l.pair = (f.before::BIGINT << 32 | f.rank)
        LEFT JOIN merges r ON f.chosen AND r.pair = (f.rank::BIGINT << 32 | f.after)
      )
    )
  )
  WHERE NOT gone
)
SELECT p, t, done FROM s WHERE round = (SELECT max(round) FROM s) ORDER BY p
"""

DECODE = """
SELECT d, string_agg(v.piece, '' ORDER BY p) AS piece FROM ids JOIN pieces v ON ids.id = v.id GROUP BY d
"""


class BytePairs:
    """The vocabulary of one file as DuckDB tables, and the words held with their ids."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        ranks = self.ranks
        # Nothing is written to local disks: without a temporary folder DuckDB stays in memory.
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
        found = [
            (ranks[piece[:at]] << 32 | ranks[piece[at:]], rank)
            for piece, rank in ranks.items() for at in range(1, len(piece))
            if piece[:at] in ranks and piece[at:] in ranks
        ]
        self._table("merges", pair=np.array([f[0] for f in found], np.int64),
                    id=np.array([f[1] for f in found], np.int32))
        # DuckDB joins strings, not bytes, in order: each byte is the character of its number.
        self._table("pieces", id=np.fromiter(ranks.values(), np.int32, len(ranks)),
                    piece=[piece.decode("latin-1") for piece in ranks])
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        # Neighbouring bytes that no piece holds: no merge ever crosses them.
        self.joined = np.zeros(1 << 16, bool)
        for piece in ranks:
            some = np.frombuffer(piece, np.uint8).astype(np.int32)
            self.joined[some[:-1] << 8 | some[1:]] = True
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self._forget()

    def _table(self, name: str, **columns) -> None:
        given = pa.table(columns)
        self.db.register("given", given)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts = array("i"), array("q", [0])

    def _hold(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        """Keep words whose ids lie end to end in ``ids``, so many for each."""
        had = len(self.starts) - 1
        self.known.update(zip(words, range(had, had + len(words))))
        self.starts.frombytes((len(self.ids) + np.cumsum(counts, dtype=np.int64)).tobytes())
        self.ids.frombytes(ids.astype(np.int32).tobytes())

    def _rows(self, words: list[bytes]) -> pa.Table:
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        return pa.table({
            "w": np.repeat(np.arange(len(words), dtype=np.int32), sizes),
            "p": np.arange(len(data), dtype=np.int32), "t": self.byte_ids[data]})

    def _ask(self, sql: str, table: pa.Table, name: str = "base", given=None) -> pa.Table:
        self.db.register(name, table)
        try:
            return self.db.sql(sql, params=given).to_arrow_table() if given else self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister(name)

    def contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words end to end, ids of each word), from one recursive query."""
        found = self._ask(CONTRACT, self._rows(words))
        ids = found["t"].to_numpy()[np.argsort(found["p"].to_numpy())]
        return ids, np.bincount(found["w"].to_numpy(), minlength=len(words))

    def contract_long(self, word: bytes) -> list[int]:
        """Ids of one long word: parts that no merge can join, each contracted round by round."""
        data = np.frombuffer(word, np.uint8).astype(np.int32)
        cuts = np.flatnonzero(~self.joined[data[:-1] << 8 | data[1:]]) + 1
        ids: list[int] = []
        short: list[bytes] = []

        def finish():
            if short:
                ids.extend(self.contract(short)[0].tolist())
            short.clear()

        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(word)]):
            part = word[start:end]
            if len(part) <= LONG_BYTES:
                short.append(part)
                if len(short) * LONG_BYTES >= QUERY_BYTES:
                    finish()
                continue
            finish()
            if len(part) > 1_000_000:
                self.db.execute(f"SET memory_limit = '{512 + 600 * len(part) // 1_000_000}MB'")
            rows = self._rows([part])
            while True:
                rounds = max(1, ROUND_ROWS // len(rows))
                found = self._ask(CONTRACT_LONG, rows, given={"rounds": rounds})
                if found["done"][0].as_py():
                    break
                rows = found.select(["p", "t"])
            ids.extend(found["t"].to_pylist())
        finish()
        return ids

    def learn(self, words: set[str]) -> None:
        """Hold the ids of words; all that was held may be dropped for them first."""
        fresh = [word for word in words if word not in self.known]
        if len(self.known) + len(fresh) > HELD_WORDS:
            self._forget()
            fresh = list(words)
        pieces, waiting, size = [], [], 0

        def finish():
            if waiting:
                self._hold([word for word, _ in waiting], *self.contract([data for _, data in waiting]))
            waiting.clear()

        for word in fresh:
            data = word.encode()
            if data in self.ranks:
                pieces.append((word, self.ranks[data]))
            elif len(data) > LONG_BYTES:
                ids = np.array(self.contract_long(data), np.int32)
                self._hold([word], ids, np.array([len(ids)]))
            else:
                waiting.append((word, data))
                size += len(data)
                if size >= QUERY_BYTES:
                    finish()
                    size = 0
        finish()
        if pieces:
            self._hold([word for word, _ in pieces], np.array([rank for _, rank in pieces]), np.ones(len(pieces), np.int64))

    def slices(self, text: str):
        """Lists of words, in order. Texts are cut before a space that follows no white space, where a
        word always ends."""
        at = 0
        while at < len(text):
            end = at + SLICE_CHARS
            while 0 < end < len(text):
                end = text.find(" ", end)
                if end > 0 and not text[end - 1].isspace():
                    break
                end += end > 0
            end = len(text) if end <= 0 else min(end, len(text))
            yield self.pattern.findall(text, at, end)
            at = end

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts. Words of many texts are learnt together, as a query has a fixed cost."""
        found: list[list[np.ndarray]] = [[] for _ in texts]
        waiting, size = [], 0

        def finish():
            self.learn(set().union(*(words for _, words in waiting)))
            ids, starts = np.frombuffer(self.ids, np.int32), np.frombuffer(self.starts, np.int64)
            for n, words in waiting:
                which = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
                first, sizes = starts[which], starts[which + 1] - starts[which]
                ends = np.cumsum(sizes)
                found[n].append(ids[np.arange(int(ends[-1])) + np.repeat(first - (ends - sizes), sizes)])

        for n, text in enumerate(texts):
            for words in self.slices(text):
                waiting.append((n, words))
                size += len(words)
                if size >= GROUP_WORDS:
                    finish()
                    waiting, size = [], 0
        if waiting:
            finish()
        return [np.concatenate(parts) if parts else np.zeros(0, np.int32) for parts in found]

    def decode(self, texts: list[np.ndarray]) -> list[list[bytes]]:
        """Bytes of each list of ids, in parts. Ids outside the vocabulary are an error."""
        found: list[list[bytes]] = [[] for _ in texts]
        waiting, size = [], 0

        def ask():
            owner = [n for n, _ in waiting]
            sizes = [len(part) for _, part in waiting]
            rows = pa.table({
                "d": np.repeat(np.arange(len(waiting), dtype=np.int32), sizes),
                "p": np.concatenate([np.arange(s, dtype=np.int32) for s in sizes]),
                "id": np.concatenate([part for _, part in waiting])})
            result = self._ask(DECODE, rows, "ids")
            parts = dict(zip(result["d"].to_pylist(), result["piece"].to_pylist()))
            for at, n in enumerate(owner):
                found[n].append(parts[at].encode("latin-1"))

        for n, ids in enumerate(texts):
            if len(ids) and (ids.min() < 0 or ids.max() >= len(self.ranks)):
                raise ValueError("an id is outside the vocabulary")
            for at in range(0, len(ids), DECODE_ROWS):
                part = ids[at:at + DECODE_ROWS]
                waiting.append((n, part))
                size += len(part)
                if size >= DECODE_ROWS:
                    ask()
                    waiting, size = [], 0
        if waiting:
            ask()
        return found


_PAIRS: dict[str, BytePairs] = {}


def _pairs(path: str) -> BytePairs:
    """One for each worker process."""
    if path not in _PAIRS:
        _PAIRS[path] = BytePairs(path)
    return _PAIRS[path]


def _id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): the ids of every whole text, without special tokens.

    A null or empty text has no ids; repeated rows are encoded each; an empty table gives no rows; columns
    beside doc_id and text are not read. A task holds one text, its ids and the held words; a word of
    over a million bytes takes about 600 times its size in DuckDB while it is contracted.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        pairs = _pairs(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            start = 0
            while start < len(batch):
                group, chars = [], 0
                while start + len(group) < len(batch) and chars < GROUP_CHARS:
                    group.append(texts[start + len(group)].as_py() or "")
                    chars += len(group[-1])
                ids = pairs.encode(group)
                ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                values = pa.array(np.concatenate(ids), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(start, len(group)), pa.ListArray.from_arrays(ends, values)], names=["doc_id", "ids"])
                start += len(group)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {_id_type(docs)}, ids array<int>")


def _decoded(batches, path):
    """(batch, list of ids, parts of bytes) for groups of rows of (doc_id, ids)."""
    pairs = _pairs(path)
    for batch in batches:
        lists = batch.column(1)
        start = 0
        while start < len(batch):
            ids, held = [], 0
            while start + len(ids) < len(batch) and held < FLUSH_IDS:
                value = lists[start + len(ids)].values
                ids.append(np.zeros(0, np.int32) if value is None else value.to_numpy())
                held += len(ids[-1])
            yield batch.slice(start, len(ids)), ids, pairs.decode(ids)
            start += len(ids)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, bytes): the bytes behind the ids of every row. Null ids are none."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        for batch, _, parts in _decoded(batches, path):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([b"".join(p) for p in parts], pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {_id_type(encoded)}, bytes binary")


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Number and digest of each text's ids, and digest of the bytes decoded from them."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        names = [str(number) for number in range(len(_pairs(path).ranks))]
        for batch, ids, parts in _decoded(batches, path):
            listed, decoded = [], []
            for some, pieces in zip(ids, parts):
                of_ids, of_bytes = hashlib.sha256(), hashlib.sha256()
                for at in range(0, len(some), DECODE_ROWS):
                    of_ids.update(b"," if at else b"")
                    of_ids.update(",".join(map(names.__getitem__, some[at:at + DECODE_ROWS].tolist())).encode())
                for piece in pieces:
                    of_bytes.update(piece)
                listed.append(of_ids.hexdigest())
                decoded.append(of_bytes.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(some) for some in ids], pa.int64()), pa.array(listed), pa.array(decoded)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode(docs, path).mapInArrow(
        run, f"doc_id {_id_type(docs)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
