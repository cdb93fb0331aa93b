"""Byte-level BPE encoding and decoding by DuckDB recursive queries inside each partition.

Encoding. A text is cut by the tokenizer's pattern. The pieces that a worker has not met yet
become token-position rows (one for each byte, with its right neighbour), joined with the merge
table; each round of the recursive query contracts the leftmost pair of minimum rank of every
word at once, until no pair of a word merges. The ids of a piece are kept in a bounded memo.

The rule is the same for every piece. In a *settled* vocabulary (every token's own bytes merge into that token
through ranks that do not exceed its own, as in a trained one) a merge of minimum rank r makes no pair of lower
rank: were xT one, its bytes, which no merge has left or entered, would have merged into it before. So the
leftmost pairs of rank r come one after another, and LONG_SQL contracts that sequence in one round, runs of one
token from the left, two by two; pieces over LONG bytes take it, as their rounds would be many. ``settled``
verifies the property for the whole vocabulary, once on the driver; without it every piece takes SHORT_SQL.

Decoding joins (document, position, id) rows with the vocabulary and concatenates the pieces of
bytes by an ordered aggregation.

Ids travel as binary, little-endian unsigned 32-bit.

Defined results: null and empty texts have no ids and decode to no bytes; equal texts get equal
ids; an empty table gives an empty result; special tokens are ordinary text; further columns pass
through, but a column that has the name of a result is replaced. Unknown ids raise an error at decoding.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import kept, ready

LONG = 96
#: Ranks and positions that a key has room for; pieces beyond (in a vocabulary that is not settled) are refused.
MOST_RANKS, MOST_BYTES = 1 << 19, (1 << 22) - 2
#: Bytes of text that are worked on at once, and pieces of one generation of the memo.
CHUNK_BYTES, MEMO = 2_000_000, 200_000

#: Keys pack (rank, position, next position); the least key of a word is its leftmost pair of minimum rank.
SHORT_SQL = """
WITH RECURSIVE t AS (
  SELECT FALSE AS done, s.w, s.pos, s.tok AS a, s.nxt AS b, s.pos + 1 AS behind, (m.r::BIGINT << 44) | (s.pos << 22) | (s.pos + 1) AS k
  FROM words s LEFT JOIN merges m ON m.a = s.tok AND m.b = s.nxt
  UNION ALL
  SELECT n.done, n.w, n.pos, n.a, n.b, n.behind, (m.r::BIGINT << 44) | (n.pos << 22) | n.behind
  FROM (
    SELECT h.k IS NULL AS done, t.w,
      CASE WHEN t.pos = h.k & 4194303 THEN (h.k >> 22) & 4194303 ELSE t.pos END AS pos,
      CASE WHEN t.pos = h.k & 4194303 THEN (h.k >> 44)::INT ELSE t.a END AS a,
      CASE WHEN t.behind = (h.k >> 22) & 4194303 THEN (h.k >> 44)::INT ELSE t.b END AS b,
      t.behind
    FROM t JOIN (SELECT w, min(k) AS k FROM t WHERE NOT done GROUP BY w) h ON h.w = t.w
    WHERE NOT t.done AND t.pos IS DISTINCT FROM (h.k >> 22) & 4194303
  ) n LEFT JOIN merges m ON m.a = n.a AND m.b = n.b AND NOT n.done
)
SELECT w, list(a ORDER BY pos) AS ids FROM t WHERE done GROUP BY w ORDER BY w
"""
LONG_SQL = """
WITH RECURSIVE t AS (
  SELECT FALSE AS done, w, pos, tok FROM words
  UNION ALL
  SELECT best IS NULL, w, pos, CASE WHEN hit THEN best ELSE tok END
  FROM (
    SELECT *, coalesce(lag(hit) OVER o, FALSE) AS gone
    FROM (
      SELECT *, coalesce(r = best, FALSE)
        AND (i - coalesce(max(CASE WHEN r IS DISTINCT FROM best THEN i END) OVER (o ROWS UNBOUNDED PRECEDING), 0)) % 2 = 1 AS hit
      FROM (
        SELECT p.w, p.pos, p.tok, m.r, min(m.r) OVER (PARTITION BY p.w) AS best, row_number() OVER (PARTITION BY p.w ORDER BY p.pos) AS i
        FROM (SELECT w, pos, tok, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS nxt FROM t WHERE NOT done) p
        LEFT JOIN merges m ON m.a = p.tok AND m.b = p.nxt
      ) WINDOW o AS (PARTITION BY w ORDER BY pos)
    ) WINDOW o AS (PARTITION BY w ORDER BY pos)
  ) WHERE NOT gone
)
SELECT w, list(tok ORDER BY pos) AS ids FROM t WHERE done GROUP BY w ORDER BY w
"""
DECODE_SQL = """
SELECT doc, string_agg(piece, '' ORDER BY pos) AS piece, count(piece) AS n
FROM ids LEFT JOIN vocabulary USING (id) GROUP BY doc ORDER BY doc
"""


def ranks_of(vocabulary: bytes) -> dict[bytes, int]:
    """Tokens and ranks of a vocabulary file; every single byte must be a token."""
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    if any(bytes([i]) not in ranks for i in range(256)) or max(ranks.values()) >= MOST_RANKS:
        raise ValueError(f"a vocabulary needs all single bytes and ranks below {MOST_RANKS}")
    return ranks


def settled(ranks: dict[bytes, int]) -> bool:
    """Whether each token's bytes merge into that token through ranks that do not exceed its own."""
    for token, own in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            least, at = min((ranks.get(a + b, MOST_RANKS), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if least > own:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return True


class Codec:
    """A tokenizer of one vocabulary, with its DuckDB tables and its memo; ``batched``: known to be settled (else verified here)."""

    def __init__(self, vocabulary: bytes, pattern: str, batched: bool | None = None) -> None:
        ranks = ranks_of(vocabulary)
        self.batched = settled(ranks) if batched is None else batched
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
        self._store("merges", pa.table({"a": pa.array(left, pa.int32()), "b": pa.array(right, pa.int32()), "r": pa.array(rank, pa.int32())}))
        # bytes as the characters of equal code, so that pieces of characters can be concatenated
        self._store("vocabulary", pa.table({"id": pa.array(ranks.values(), pa.int32()), "piece": pa.array([x.decode("latin-1") for x in ranks])}))

    def _store(self, name: str, rows: pa.Table) -> None:
        self.con.register("given", rows)
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def _query(self, name: str, rows: pa.Table, sql: str) -> pa.Table:
        self.con.register(name, rows)
        try:
            return self.con.sql(sql).to_arrow_table()
        finally:
            self.con.unregister(name)

    def _contract(self, words: list[bytes], sql: str) -> list[bytes]:
        lengths = np.array([len(x) for x in words])
        tokens = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        first = np.cumsum(lengths) - lengths
        following = np.append(tokens[1:], np.int32(-1))
        following[np.cumsum(lengths) - 1] = -1
        rows = pa.table({
            "w": np.repeat(np.arange(len(words), dtype=np.int32), lengths),
            "pos": np.arange(len(tokens)) - np.repeat(first, lengths), "tok": tokens, "nxt": following,
        })
        made = self._query("words", rows, sql)["ids"].combine_chunks()
        at, flat = made.offsets.to_numpy(), made.values.to_numpy().astype("<u4").tobytes()
        return [flat[4 * s : 4 * e] for s, e in zip(at, at[1:], strict=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Put the ids of ``pieces`` into the memo."""
        short, long = [], []
        for x in pieces:
            raw = x.encode()
            (long if self.batched and len(raw) > LONG else short).append((x, raw))
            if not self.batched and len(raw) > MOST_BYTES:
                raise ValueError(f"a piece of over {MOST_BYTES} bytes needs a settled vocabulary")
        for sql, own in ((SHORT_SQL, short), (LONG_SQL, long)):
            for i in range(0, len(own), 50_000):
                part = own[i : i + 50_000]
                self.new.update(zip([x for x, _ in part], self._contract([raw for _, raw in part], sql), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.new) > MEMO:
            self.old, self.new = self.new, {}
        cut = [self.pattern.findall(x) for x in texts]
        kinds = set().union(*cut)
        new, old = self.new, self.old
        missing = []
        for x in kinds:
            if x not in new:
                if x in old:
                    new[x] = old[x]
                else:
                    missing.append(x)
        if missing:
            self._learn(missing)
        return [b"".join(map(new.__getitem__, x)) for x in cut]

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        lengths = np.array([len(x) // 4 for x in encoded], dtype=np.int64)
        if not lengths.sum():
            return [b""] * len(encoded)
        rows = pa.table({
            "doc": np.repeat(np.arange(len(encoded), dtype=np.int32), lengths),
            "pos": np.arange(lengths.sum()).astype(np.int32), "id": np.frombuffer(b"".join(encoded), dtype="<u4").astype(np.int32),
        })
        made = self._query("ids", rows, DECODE_SQL)
        if (made["n"].to_numpy() != lengths[lengths > 0]).any():
            raise ValueError("an id is not in the vocabulary")
        found = [b""] * len(encoded)
        for d, x in zip(made["doc"].to_pylist(), made["piece"].to_pylist(), strict=True):
            found[d] = x.encode("latin-1")
        return found


def codec(vocabulary: bytes, pattern: str, batched: bool) -> Codec:
    """The process's codec of this vocabulary."""
    return kept(hashlib.sha256(vocabulary + pattern.encode()).hexdigest(), lambda: Codec(vocabulary, pattern, batched))


@lru_cache(maxsize=4)
def _batched(vocabulary: bytes) -> bool:
    return settled(ranks_of(vocabulary))


def _chunks(sizes: list[int]) -> Iterator[slice]:
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > CHUNK_BYTES:
            yield slice(start, i)
            start, total = i, 0
        total += size
    yield slice(start, len(sizes))


def _mapped(docs: DataFrame, vocabulary: bytes, pattern: str, source: str, outputs: list[str], work) -> DataFrame:
    spark: SparkSession = ready(docs.sparkSession)
    if source in outputs:
        raise ValueError(f"the result needs another name than {source}")
    docs = docs.drop(*outputs)
    given, at = spark.sparkContext.broadcast((vocabulary, pattern, _batched(vocabulary))), docs.columns.index(source)  # a vocabulary file: about 1 MB

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*given.value)
        for batch in batches:
            values = batch.column(at).to_pylist()
            for part in _chunks([len(x or "") for x in values]):
                made = work(own, [x or ("" if source_is_text else b"") for x in values[part]])
                kept = batch.slice(part.start, part.stop - part.start).columns
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, pa.binary()) for x in made)], names=[*batch.schema.names, *outputs])

    source_is_text = isinstance(docs.schema[source].dataType, T.StringType)
    return docs.mapInArrow(over, T.StructType([*docs.schema.fields, *(T.StructField(x, T.BinaryType()) for x in outputs)]))


def encode(docs: DataFrame, vocabulary: bytes, pattern: str, *, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a binary column ``ids``."""
    return _mapped(docs, vocabulary, pattern, text, [ids], lambda own, x: [own.encode(x)])


def decode(encoded: DataFrame, vocabulary: bytes, pattern: str, *, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encoded`` with a binary column ``decoded``: the bytes of the ids."""
    return _mapped(encoded, vocabulary, pattern, ids, [decoded], lambda own, x: [own.decode(x)])


def round_trip(docs: DataFrame, vocabulary: bytes, pattern: str, *, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with both columns, from one pass in one worker."""

    def work(own: Codec, texts: list[str]) -> list[list[bytes]]:
        encoded = own.encode(texts)
        return [encoded, own.decode(encoded)]

    return _mapped(docs, vocabulary, pattern, text, [ids, decoded], work)
