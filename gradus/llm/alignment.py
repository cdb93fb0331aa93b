"""Alignment of two tokenizers over a corpus: which tokens of one lie over which of the other, and in how many documents.

Both encode the same bytes (a space and the text). The places where both have a token's end cut the bytes into groups;
an A and a B token whose bytes overlap are linked. A link is the pair of tokens over one stretch between neighbouring
ends, so a document's links come from the sorted union of both lists of ends, and there are never more links than tokens.

Counts. A pair of ids is packed into one 64-bit key, a << 32 | b. Each partition counts in how many of its documents a
key is linked (numpy's unique, merged as it goes and passed on at a bounded size), the partial counts are sorted by key
ranges over the whole cluster, and each range sums its runs of equal keys. Every range is written as one shard, all its
keys and then all their counts, 64-bit little-endian, in the folder that all executors share; the driver keeps a row a
shard (first key, number of keys, file) and the highest count of each A id, which the vocabulary bounds. For the lookup a worker
maps the shards into memory and searches the sorted keys; in a store that is no file system of this machine it copies a
shard to a temporary file first, which is unlinked as soon as it is mapped.

A key's partial counts are at most one (or a few) a partition, so no key is hot. A shard's file is named by the attempt that wrote
it, and only the attempt that Spark counts is listed, so repeated and lost tasks do no harm.

Defined results: null and empty texts, and texts whose joined A or B bytes are not the space and the text, have no
tokens, zeros and an empty text of groups; they count for no pair. Special tokens' strings are plain text. Repeated
rows are documents of their own and count each. An empty table gives an empty result. Columns other than the
text pass through; a column that has the name of a result is replaced.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .automaton import alphabet
from .common import alone, checkpoint_folder, kept, ready, remove

#: Pieces of one generation of the memo (two are held), and the most characters of one that is remembered.
MEMO, REMEMBERED = 200_000, 48
#: Keys that a partition holds before they are merged, and distinct ones before they are passed on.
WAITING, HELD = 1_000_000, 3_000_000
#: Keys of one batch of partial counts.
ROWS = 250_000
#: Where a text is cut, and what says that a text cannot simply be split at its spaces.
_CUT, _CLOSE = regex.compile(r"(?<=\S)(?= )"), regex.compile(r"\s\s|\s$")
RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def pieces_of(definition: bytes, model: bytes) -> tuple[list[bytes], list[bytes]]:
    """The bytes of each id of A and of B."""
    letters = alphabet()
    words = Tokenizer.from_str(definition.decode()).get_vocab(with_added_tokens=True)
    first = [b""] * (max(words.values()) + 1)
    for word, i in words.items():
        first[i] = bytes(letters[c] for c in word) if all(c in letters for c in word) else word.encode()
    other = sentencepiece.SentencePieceProcessor(model_proto=model)
    second = []
    for i in range(other.get_piece_size()):
        piece = other.id_to_piece(i)
        second.append(bytes([int(piece[3:5], 16)]) if other.is_byte(i) else piece.replace("▁", " ").encode())
    return first, second


_PROBES = ("a", "it's", "x.", "7", "\xdf\xe9", "\u65e5\u672c", "...", "a\nb", "<s>", "\x00", "e\u0301")


class Pair:
    """Both tokenizers of one worker, with a memo of words.

    Neither joins a space to what stands before it: A's pre-tokeniser ends a piece there, and no piece of B has a space
    after another character. So a text is cut before each space that follows another character, and each distinct
    part is encoded once. Both are checked, B's pieces whole and both tokenizers on probes; where they do not hold, texts are encoded whole.
    """

    def __init__(self, definition: bytes, model: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = Tokenizer.from_str(definition.decode()), sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a.encode_special_tokens = True
        self.bytes_a, self.bytes_b = pieces_of(definition, model)
        self.kind_a, self.kind_b = _kind(self.bytes_a), _kind(self.bytes_b)
        probes = [f"{x}{gap}{y}" for x in _PROBES for y in _PROBES for gap in (" ", "  ", "   ")]
        apart = all(b" " not in x.lstrip(b" ") for x in self.bytes_b)
        self.parts = apart and all([b"".join(x) for x in zip(*map(self._whole, self._cut(p)), strict=True)] == list(self._whole(p)) for p in probes)
        self.new: dict[str, tuple[bytes, bytes] | None] = {}
        self.old: dict[str, tuple[bytes, bytes] | None] = {}

    def _ids(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """The ids of each text, with a space before it; none where the bytes differ."""
        first = [x.ids for x in self.a.encode_batch_fast([" " + x for x in texts], add_special_tokens=False)]
        made = []
        for x, a, b in zip(texts, first, self.b.encode(texts, num_threads=1), strict=True):
            raw = (" " + x).encode()
            fine = b"".join(map(self.bytes_a.__getitem__, a)) == raw and b"".join(map(self.bytes_b.__getitem__, b)) == raw
            made.append((np.array(a, dtype=self.kind_a).tobytes(), np.array(b, dtype=self.kind_b).tobytes()) if fine else None)
        return made

    def _words(self, words: list[str]) -> list[tuple[bytes, bytes] | None]:
        """The ids of parts that do not end with white space, from one text of all: each ends where tokens of both do."""
        text = " " + " ".join(words)
        ends = np.cumsum([len(x.encode()) + 1 for x in words])
        own = []
        for ids, pieces, kind in ((self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.bytes_a, self.kind_a), (self.b.encode(text[1:]), self.bytes_b, self.kind_b)):
            found = list(map(pieces.__getitem__, ids))
            stops = np.cumsum(list(map(len, found)))
            if b"".join(found) != text.encode():
                return self._ids(words)
            at = np.searchsorted(stops, ends)
            if (stops[at] != ends).any():
                return self._ids(words)
            flat, edges = np.array(ids, dtype=kind).tobytes(), (np.concatenate([[0], at + 1]) * np.dtype(kind).itemsize).tolist()
            own.append([flat[s:e] for s, e in zip(edges, edges[1:], strict=False)])
        return list(zip(*own, strict=True))

    def _whole(self, text: str) -> tuple[bytes, bytes]:
        return self._ids([text])[0] or (b"", b"")

    def _cut(self, text: str) -> list[str]:
        """The parts of a space and the text, without the space that each begins with."""
        return [x[1:] for x in _CUT.split(" " + text)] if _CLOSE.search(text) or text[0].isspace() else text.split(" ")

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
        """The ids of both, 2 bytes each (4 beyond 65,536)."""
        if len(self.new) > MEMO:
            self.old, self.new = self.new, {}
        cut = [(self._cut(x) if self.parts else [x]) if x else [] for x in texts]
        new, old = self.new, self.old
        lost = [x for x in set().union(*cut) if x not in new]
        unknown = [x for x in lost if x not in old]
        new.update((x, old[x]) for x in lost if x in old)
        short = [x for x in unknown if 0 < len(x) <= REMEMBERED and not x[-1].isspace()] if self.parts else []
        for at in range(0, len(short), 4000):
            new.update(zip(short[at : at + 4000], self._words(short[at : at + 4000]), strict=True))
        others = [x for x in unknown if x not in new]
        once = dict(zip(others, self._ids(others), strict=True)) if others else {}
        look = new.__getitem__ if not once else lambda x: new[x] if x in new else once[x]
        a_out, b_out = [], []
        for text, parts in zip(texts, cut, strict=True):
            own = list(map(look, parts))
            if None in own:  # a part comes back with other bytes: the whole text decides
                own = [self._whole(text)]
            a, b = zip(*own, strict=True) if own else ((), ())
            a_out.append(b"".join(a))
            b_out.append(b"".join(b))
        return a_out, b_out


def _kind(pieces: list[bytes]) -> str:
    return "<u2" if len(pieces) <= 1 << 16 else "<u4"


@dataclass
class Links:
    """The links of some documents, one after another: the ids of each, and where each document's begin and end."""

    a: np.ndarray
    b: np.ndarray
    ends: np.ndarray
    groups: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray


def _bounds(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def links(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, length_a: np.ndarray, length_b: np.ndarray) -> Links:
    """The links of documents whose ids lie one after another, ``n_a`` and ``n_b`` in each.

    Each byte is marked by the tokens that end there, so the ends come in order without sorting and a running count
    tells which token a stretch belongs to.
    """
    ends_a, ends_b = np.cumsum(length_a[a]), np.cumsum(length_b[b])
    mark = np.zeros(int(ends_a[-1]) + 1 if len(a) else 1, dtype=np.uint8)
    mark[ends_a] = 1
    mark[ends_b] |= 2
    every = np.flatnonzero(mark)
    which = mark[every]
    of_a, of_b = which & 1, which >> 1
    cut_a, cut_b = which[of_a == 1] == 3, which[of_b == 1] == 3
    at_a, at_b = np.cumsum(of_a, dtype=np.int64) - of_a, np.cumsum(of_b, dtype=np.int64) - of_b
    # a document ends where both do, at its last token
    upto = np.concatenate([[0], np.flatnonzero(of_a) + 1])
    return Links(a[at_a], b[at_b], upto[_bounds(n_a)[1:]], np.diff(_bounds(cut_a)[_bounds(n_a)]), cut_a, cut_b)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    return key[first], np.add.reduceat(count, first) if len(key) else count


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


class Counts:
    """The count shards, mapped when first needed, and the highest count of each A id."""

    def __init__(self, folder: str, firsts: np.ndarray, sizes: np.ndarray, names: list[str]) -> None:
        self.store, self.path = _store(folder)
        self.firsts, self.sizes, self.names = firsts, sizes, names
        self.open: dict[int, np.ndarray] = {}

    def _shard(self, i: int) -> np.ndarray:
        if i not in self.open:
            name, shape = f"{self.path}/{self.names[i]}", (2, int(self.sizes[i]))
            if isinstance(self.store, fs.LocalFileSystem):
                self.open[i] = np.memmap(name, dtype="<i8", mode="r", shape=shape)
            else:
                with tempfile.NamedTemporaryFile() as own:
                    with self.store.open_input_stream(name) as source:
                        while part := source.read(1 << 24):
                            own.write(part)
                    own.flush()
                    self.open[i] = np.memmap(own.name, dtype="<i8", mode="r", shape=shape)
        return self.open[i]

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The counts of sorted keys, each of which is in a shard."""
        found = np.zeros(len(keys), dtype=np.int64)
        shard = np.searchsorted(self.firsts, keys, side="right") - 1
        edges = np.searchsorted(shard, np.arange(len(self.firsts) + 1))
        for i in np.flatnonzero(np.diff(edges)):
            own = self._shard(i)
            s, e = edges[i], edges[i + 1]
            at = np.searchsorted(own[0], keys[s:e])
            if (own[0][np.minimum(at, len(own[0]) - 1)] != keys[s:e]).any():
                raise ValueError("a linked pair has no count")
            found[s:e] = own[1][at]
        return found


def _ids(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a binary column, one after another, and how many each row has."""
    raw = [x.as_buffer() for x in column]
    counts = np.array([x.size for x in raw], dtype=np.int64) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(raw), dtype=kind).astype(np.int64), counts


class Aligner:
    """What the workers of a lookup share: lengths, texts of ids, and counts."""

    def __init__(self, given: tuple, counts: Counts | None) -> None:
        self.length_a, self.length_b, self.kind_a, self.kind_b, self.best = given
        self.counts = counts
        # each id as it is written inside a group and at its end
        self.said_a = np.array([f"{i}{x}" for i in range(len(self.length_a)) for x in ",|"], dtype=object)
        self.said_b = np.array([f"{i}{x}" for i in range(len(self.length_b)) for x in ",;"], dtype=object)

    def of(self, a_column: pa.Array, b_column: pa.Array) -> list[pa.Array]:
        a, n_a = _ids(a_column, self.kind_a)
        b, n_b = _ids(b_column, self.kind_b)
        made = links(a, b, n_a, n_b, self.length_a, self.length_b)
        keys, back = np.unique(made.a << 32 | made.b, return_inverse=True)
        count = self.counts.of(keys)[back] if len(keys) else np.zeros(0, dtype=np.int64)
        starts = np.concatenate([[0], made.ends[:-1]])
        total, best = _bounds(count), _bounds(count == self.best[made.a]) if len(count) else np.zeros(1, dtype=np.int64)
        numbers = (n_a, n_b, made.groups, made.ends - starts, best[made.ends] - best[starts], total[made.ends] - total[starts])
        return [*(pa.array(np.asarray(x, dtype=np.int64)) for x in numbers), pa.array(self._groups(a, b, n_a + n_b, made), pa.string())]

    def _groups(self, a: np.ndarray, b: np.ndarray, counts: np.ndarray, made: Links) -> list[str]:
        before_b = np.concatenate([[0], np.flatnonzero(made.cut_b) + 1])
        upto_a = np.concatenate([np.flatnonzero(made.cut_a) + 1, [0]])
        out = np.empty(len(a) + len(b), dtype=object)
        out[np.arange(len(a)) + before_b[np.cumsum(made.cut_a) - made.cut_a]] = self.said_a[2 * a + made.cut_a]
        out[np.arange(len(b)) + upto_a[np.cumsum(made.cut_b) - made.cut_b]] = self.said_b[2 * b + made.cut_b]
        edges = _bounds(counts).tolist()
        return ["".join(out[s:e].tolist())[:-1] for s, e in zip(edges, edges[1:], strict=False)]


def encoded(docs: DataFrame, definition: bytes, model: bytes, *, text: str = "text") -> DataFrame:
    """``docs`` without the text, with the ids of both tokenizers as binary ``__a`` and ``__b``."""
    spark = ready(docs.sparkSession)
    docs = docs.drop("__a", "__b")
    others = [x for x in docs.schema.fields if x.name != text]
    given = spark.sparkContext.broadcast((definition, model))  # tokenizer files: a few MB
    at = docs.columns.index(text)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept("both tokenizers", lambda: Pair(*given.value))
        for batch in batches:
            made = own.encode(batch.column(at).to_pylist())
            through = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*through, *(pa.array(x, pa.binary()) for x in made)], names=[*(x.name for x in others), "__a", "__b"])

    return docs.mapInArrow(over, T.StructType([*others, T.StructField("__a", T.BinaryType()), T.StructField("__b", T.BinaryType())]))


def _partial(rows: DataFrame, given) -> DataFrame:
    """(key, n): in how many documents of a partition a pair is linked; a key may come more than once."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        length_a, length_b, kind_a, kind_b, _ = given.value
        keys, counts, waiting = [], [], 0

        def parts() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(keys[0]), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(keys[0][i : i + ROWS]), pa.array(counts[0][i : i + ROWS])], names=["key", "n"])

        for batch in batches:
            a, n_a = _ids(batch.column(0), kind_a)
            b, n_b = _ids(batch.column(1), kind_b)
            made = links(a, b, n_a, n_b, length_a, length_b)
            size = len(length_a) * len(length_b)
            doc = np.repeat(np.arange(len(n_a)), np.diff(np.concatenate([[0], made.ends])))
            pair = np.unique(doc * size + made.a * len(length_b) + made.b) % size  # once a document
            pair, n = np.unique(pair, return_counts=True)
            keys.append(pair // len(length_b) << 32 | pair % len(length_b))
            counts.append(n)
            waiting += len(pair)
            if waiting > WAITING:
                (key, count), waiting = merged(keys, counts), 0
                keys, counts = [key], [count]
                if len(key) > HELD:
                    yield from parts()
                    keys, counts = [], []
        if keys:
            key, count = merged(keys, counts)
            keys, counts = [key], [count]
            yield from parts()

    return rows.select("__a", "__b").mapInArrow(over, "key long, n long")


def _shards(partial: DataFrame, folder: str) -> DataFrame:
    """Sort by key over the cluster, sum runs, write one shard a partition: (first, size, name, a, best)."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        keys, counts, held = [], [], 0
        for batch in batches:
            if batch.num_rows:
                keys.append(batch.column(0).to_numpy())
                counts.append(batch.column(1).to_numpy())
                held += batch.num_rows
                if held > 4 * WAITING:  # runs are summed as they come
                    key, count = merged(keys, counts)
                    keys, counts, held = [key], [count], 0
        if not keys:
            return
        key, count = merged(keys, counts)
        context = TaskContext.get()
        name = f"shard-{context.partitionId():06d}-{context.taskAttemptId()}"
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{name}") as out:
            out.write(key.astype("<i8").tobytes())
            out.write(count.astype("<i8").tobytes())
        a = key >> 32
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        own = [[a[first].tolist()], [np.maximum.reduceat(count, first).tolist()]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.int64()), pa.array([len(key)], pa.int64()), pa.array([name]), *(pa.array(x, pa.list_(pa.int64())) for x in own)],
            names=["first", "size", "name", "a", "best"],
        )

    ordered = partial.repartitionByRange("key").sortWithinPartitions("key")
    return ordered.mapInArrow(over, "first long, size long, name string, a array<long>, best array<long>")


def align(docs: DataFrame, definition: bytes, model: bytes, *, text: str = "text") -> DataFrame:
    """``docs`` without the text, with n_a, n_b, n_groups, n_links, n_best, count_sum (longs) and ``groups``: ``a1,a2|b1;a3|b2,b3``."""
    spark = ready(docs.sparkSession)
    docs = docs.drop(*(x for x in (*RESULTS, "groups") if x != text))
    folder = f"{checkpoint_folder(spark)}/alignment-{uuid.uuid4().hex}"
    encoded(docs, definition, model, text=text).write.option("compression", "zstd").parquet(f"{folder}/ids")
    rows = spark.read.parquet(f"{folder}/ids")

    pieces = pieces_of(definition, model)
    lengths = [np.array([len(x) for x in p], dtype=np.int64) for p in pieces]
    plain = (*lengths, *map(_kind, pieces))
    _partial(rows, spark.sparkContext.broadcast((*plain, None))).write.parquet(f"{folder}/partial")
    listed = sorted(_shards(spark.read.parquet(f"{folder}/partial"), f"{folder}/shards").collect(), key=lambda r: r["first"])  # a row a shard
    remove(spark, f"{folder}/partial")

    best = np.zeros(len(pieces[0]), dtype=np.int64)
    for r in listed:
        np.maximum.at(best, r["a"], r["best"])
    given = spark.sparkContext.broadcast((*plain, best))  # by the vocabularies
    shards = (f"{folder}/shards", np.array([r["first"] for r in listed], dtype=np.int64), np.array([r["size"] for r in listed], dtype=np.int64), [r["name"] for r in listed])
    at = [rows.columns.index(x) for x in ("__a", "__b")]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(f"shards {folder}", lambda: Aligner(given.value, Counts(*shards)))
        for batch in batches:
            through = [batch.column(i) for i in range(batch.num_columns) if i not in at]
            yield pa.RecordBatch.from_arrays([*through, *own.of(*(batch.column(i) for i in at))], names=names)

    fields = [x for x in rows.schema.fields if x.name not in ("__a", "__b")]
    fields += [*(T.StructField(x, T.LongType()) for x in RESULTS), T.StructField("groups", T.StringType())]
    names = [x.name for x in fields]
    return rows.mapInArrow(over, T.StructType(fields))
