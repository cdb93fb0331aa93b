"""Token-id output: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

Encoding. Texts are tokenized with the tokenizers library; its normaliser and pre-tokeniser must treat
white space as a boundary (checked on probes), so a text's ids are those of its parts between ASCII white
space; each distinct part of a batch is looked up once, and frequent ones are kept in a bounded memo.
Every document gets an end id.

File format (one row a block in Parquet files under one folder, blocks in ascending document order):
``part, block`` place of the block; ``ids`` the document ids; ``counts`` ids in each document;
``control`` two bits an id, its length in bytes less one, four ids a byte; ``data`` the bytes of the
frequency ranks, lowest first. ``ranks/`` beside it maps ranks back to ids: one row an id of the
vocabulary. The most frequent 256 ids take one byte each.

Decoding expands control bytes by a table of 256 x 4 lengths, places by their running sum, and gathers
the bytes with numpy; nothing loops over ids.

Documents are ordered by id, then by a hash of their ids, so repeated ids spread over parts. The
cumulative start of a document adds the totals of earlier parts, one number a part.

Defined results: null and empty texts hold the end id alone; rows of null id come first; repeated
rows are stored repeatedly; an empty table gives no block and no row; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import alone, checkpoint_folder, kept, ready

#: Parts of one generation of the memo (two are held), and the most characters of one that is remembered.
MEMO, REMEMBERED = 120_000, 48
#: Words or ids that are worked on at once.
SLICE = 200_000
#: Bytes of the batches that are encoded together.
GATHERED = 5_000_000
BLOCK_IDS = 1_000_000
#: Lengths of the four ids of each control byte.
_LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values."""
    ranks = ranks.astype(np.uint32)
    lengths = np.ones(len(ranks), dtype=np.uint8)
    for most in (0xFF, 0xFFFF, 0xFFFFFF):
        lengths += ranks > most
    codes = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    codes[: len(ranks)] = lengths - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | (codes[:, 1] << 2) | (codes[:, 2] << 4) | (codes[:, 3] << 6)
    ends = np.cumsum(lengths, dtype=np.int64)
    data = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    starts = ends - lengths
    data[starts] = ranks.astype(np.uint8)
    for k in (1, 2, 3):
        more = np.flatnonzero(lengths > k)
        if len(more):
            data[starts[more] + k] = (ranks[more] >> np.uint32(8 * k)).astype(np.uint8)
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    lengths = _LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:count]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    raw = np.frombuffer(data, dtype=np.uint8)
    values = raw[starts].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(lengths > k)
        if len(more):
            values[more] |= raw[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


#: A character that no other text of a batch has, so its token ends parts.
MARK = "\x01"
#: Punctuation that ends the word before it wherever it follows a Latin letter; an apostrophe may begin a suffix, ``<`` a special token.
_AFTER = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
_SEAM = r"([a-z\x{E0}-\x{F6}\x{F8}-\x{FF}])([" + re.escape(_AFTER) + "])"
#: Parts that keep their case and stay whole: those that may hold a special token, or marks that may join letters of one case only.
_WHOLE = r"[<\x{300}-\x{37F}]"
_PROBES = ("it's", "a.b,", "'ll", "x", "7", "\xdf\xe9", "\u65e5\u672c", "...", "###", "(a)", "\u2026", "e\u0301")


def _gather(flat: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The slices of ``flat`` (one after another, of these lengths) in the order of ``codes``."""
    out = lengths[codes]
    total = int(out.sum())
    shift = (np.cumsum(lengths) - lengths)[codes] - (np.cumsum(out) - out)
    return flat[np.repeat(shift, out) + np.arange(total)]


class Encoder:
    """A tokenizer with a memo of the ids of parts between white space, as little-endian bytes of ``width`` each.

    A batch's parts are told apart by Arrow, and each distinct one is looked up once; where the tokenizer
    allows it, A-Z is folded and parts are cut between a letter and punctuation, so that they repeat more
    often. Unknown parts are tokenized many at a time: those of letters alone are joined by spaces and told
    apart by the tokens that end words, others are held apart by a control character that none of them has.
    Either way the count of parts must come out right, or the parts are tokenized one by one.

    That white space parts the texts is checked on probes; a tokenizer in which it does not is refused.
    """

    def __init__(self, definition: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(definition.decode())
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        words = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(words.values()) + 1
        self.width = _width(self.tokenizer)
        self.last = np.zeros(self.size, dtype=bool)
        if suffix:
            self.last[[i for w, i in words.items() if w.endswith(suffix)]] = True
        letters = [chr(c) for c in range(97, 123)]
        one = lambda x: self._ids([x])[0]
        added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        if any(one(a + gap + b) != one(a) + one(b) for a in _PROBES for b in _PROBES for gap in (" ", "\n\t ")) or one(" \n") or any(x.split() != [x] for x in added):
            raise ValueError("white space does not part the words of this tokenizer")
        alone = one(MARK)
        self.mark = alone[0] if len(alone) == 1 else None
        whole = all("<" in x for x in added)
        #: Whether A-Z counts as a-z, and punctuation after a letter stands for itself.
        self.folds = whole and all(one(x.upper()) == one(x) for x in letters)
        self.parts = self.folds and all(one(x + y) == one(x) + one(y) for x in (*letters, "\xe9") for y in _AFTER)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # the memo stands before it

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _bytes(self, ids) -> bytes:
        return np.asarray(ids, dtype=f"<u{self.width}").tobytes()

    def _sliced(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        flat, w = self._bytes(ids), self.width
        return [flat[s:e] for s, e in zip((w * starts).tolist(), (w * ends).tolist(), strict=True)]

    def _letters(self, texts: list[str]) -> list[bytes] | None:
        ids = np.array(self._ids([" ".join(texts)])[0], dtype=np.int64)
        ends = np.flatnonzero(self.last[ids]) + 1
        return self._sliced(ids, np.concatenate([[0], ends[:-1]]), ends) if len(ends) == len(texts) and ends[-1] == len(ids) else None

    def _apart(self, texts: list[str]) -> list[bytes] | None:
        if self.mark is None or any(MARK in x for x in texts):
            return None
        ids = np.array(self._ids([f" {MARK} ".join(texts)])[0], dtype=np.int64)
        at = np.flatnonzero(ids == self.mark)
        return self._sliced(ids, np.concatenate([[0], at + 1]), np.append(at, len(ids))) if len(at) == len(texts) - 1 else None

    def _learnt(self, parts: list[str]) -> dict[str, bytes]:
        made: dict[str, bytes] = {}
        letters, others = [], []
        for x in parts:
            (letters if x.isalpha() else others).append(x)
        for chosen, way in ((letters, self._letters), (others, self._apart)):
            for i in range(0, len(chosen), 2000):
                some = chosen[i : i + 2000]
                made.update(zip(some, way(some) or [self._bytes(x) for x in self._ids(some)], strict=True))
        return made

    def _looked_up(self, parts: list[str]) -> list[bytes]:
        """The ids of distinct parts; short ones are remembered, so the memo's bytes are bounded with its entries."""
        if len(self.new) > MEMO:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        lost = [x for x in parts if x not in new]
        kept = {x: old[x] for x in lost if x in old}
        made = self._learnt([x for x in lost if x not in kept])
        new.update(kept)
        new.update(x for x in made.items() if len(x[0]) <= REMEMBERED)
        return [new[x] if x in new else made[x] for x in parts]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; null counts as empty."""
        cut = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        ends = cut.offsets.to_numpy()
        words = cut.flatten().dictionary_encode()
        kinds = words.dictionary
        codes = words.indices.to_numpy()
        if self.folds:
            small = pc.ascii_lower(kinds)
            small = pc.replace_substring_regex(small, pattern=_SEAM, replacement=r"\1 \2") if self.parts else small
            kinds = pc.if_else(pc.match_substring_regex(kinds, pattern=_WHOLE), kinds, small)
        parted = pc.split_pattern(kinds, pattern=" ")
        parts = parted.flatten().dictionary_encode()
        names = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = self._looked_up(names)
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // self.width
        flat = np.frombuffer(b"".join(found), dtype=f"<u{self.width}")
        order, seams = parts.indices.to_numpy(), parted.offsets.to_numpy()
        flat = _gather(flat, lengths, order)
        lengths = np.diff(np.concatenate([[0], np.cumsum(lengths[order])])[seams])  # of kinds of words
        places = np.concatenate([[0], np.cumsum(lengths[codes])])
        out = np.empty(int(places[-1]), dtype=flat.dtype)
        for s in range(0, len(codes), SLICE):  # a long text needs no more than its ids and a slice
            some = codes[s : s + SLICE]
            out[places[s] : places[s + len(some)]] = _gather(flat, lengths, some)
        at = (places[ends] * self.width).tolist()
        raw = out.tobytes()
        return [raw[s:e] for s, e in zip(at, at[1:], strict=False)]


def _width(tokenizer: Tokenizer) -> int:
    """Bytes of an id in the temporary rows."""
    return 2 if max(tokenizer.get_vocab(with_added_tokens=True).values(), default=0) < 1 << 16 else 4


def encoder(definition: bytes) -> Encoder:
    """The process's encoder of this tokenizer."""
    return kept(hashlib.sha256(definition).hexdigest(), lambda: Encoder(definition))


def _gathered(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined up to GATHERED bytes or one batch, so that parts repeat more often in each."""
    waiting: list[pa.RecordBatch] = []
    for batch in source:
        if batch.num_rows:
            waiting.append(batch)
        if sum(x.nbytes for x in waiting) > GATHERED:
            yield pa.concat_batches(waiting)
            waiting = []
    if waiting:
        yield pa.concat_batches(waiting)


def _tokenized(docs: DataFrame, definition: bytes, end: int, key: str, text: str) -> DataFrame:
    """(id, tie, ids): the ids with the end id, compressed; tie a hash of them."""
    given = docs.sparkSession.sparkContext.broadcast(definition)  # a tokenizer's file: a few MB

    def over(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, squeeze = encoder(given.value), zstandard.ZstdCompressor(level=1).compress
        close = np.array([end], dtype=f"<u{own.width}").tobytes()
        for rows in _gathered(source):
            ids = [x + close for x in own.encode(rows.column(1))]
            ties = pa.array([zlib.crc32(x) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column(0), ties, pa.array(map(squeeze, ids), pa.binary())], names=["id", "tie", "ids"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(over, "id long, tie long, ids binary")


def write(docs: DataFrame, definition: bytes, folder: str, *, end: int, key: str = "doc_id", text: str = "text") -> None:
    """Tokenize ``docs`` and write the files under ``folder`` (a path that all executors share)."""
    spark = ready(docs.sparkSession)
    held = f"{folder}/held"
    _tokenized(docs, definition, end, key, text).write.option("compression", "uncompressed").parquet(held)
    rows = spark.read.parquet(held)
    kind = f"<u{_width(Tokenizer.from_str(definition.decode()))}"

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        expand, total = zstandard.ZstdDecompressor().decompress, np.zeros(0, dtype=np.int64)
        for batch in source:
            waiting: list[np.ndarray] = []
            for x in (*batch.column(0), None):
                if x is not None:
                    waiting.append(np.frombuffer(expand(x.as_py()), dtype=kind))
                if waiting and (x is None or sum(map(len, waiting[-64:])) > SLICE or len(waiting) == 64):
                    own = np.bincount(np.concatenate(waiting), minlength=len(total))
                    own[: len(total)] += total
                    total, waiting = own, []
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["token", "n"])

    counts = rows.select("ids").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()  # as many as the vocabulary
    tokens = np.array([r["token"] for r in sorted(counts, key=lambda r: (-r["n"], r["token"]))], dtype=np.int64)
    spark.createDataFrame(pa.table({"rank": pa.array(np.arange(len(tokens))), "token": pa.array(tokens)})).coalesce(1).write.parquet(f"{folder}/ranks")
    rank = np.zeros(int(tokens.max(initial=-1)) + 1, dtype=np.uint32)
    rank[tokens] = np.arange(len(tokens))
    table = spark.sparkContext.broadcast(rank)  # bounded by the vocabulary

    def blocks(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        expand, ranks = zstandard.ZstdDecompressor().decompress, table.value
        context = TaskContext.get()
        part, block = context.partitionId() if context else 0, 0
        ids: list[int | None] = []
        held: list[np.ndarray] = []

        def made() -> pa.RecordBatch:
            control, data = pack(np.concatenate(held))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(x) for x in held]], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                names=["part", "block", "ids", "counts", "control", "data"],
            )

        size = 0
        for batch in source:
            for ident, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = ranks[np.frombuffer(expand(raw.as_py()), dtype=kind)]
                ids.append(ident)
                held.append(own)
                size += len(own)
                if size >= BLOCK_IDS:
                    yield made()
                    ids, held, size, block = [], [], 0, block + 1
        if ids:
            yield made()

    ordered = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "ids")
    ordered.mapInArrow(blocks, BLOCK_SHAPE).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    _remove(spark, held)


BLOCK_SHAPE = "part int, block int, ids array<long>, counts array<long>, control binary, data binary"


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def read(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids) of each stored document; ids binary, little-endian unsigned 32-bit."""
    ready(spark)
    ranked = spark.read.parquet(f"{folder}/ranks").collect()  # as many as the vocabulary
    token = np.zeros(len(ranked), dtype="<u4")
    for r in ranked:
        token[r["rank"]] = r["token"]
    rows = spark.read.schema(BLOCK_SHAPE).parquet(f"{folder}/blocks")
    sizes = rows.select("part", "block", F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b).alias("n"))
    # one number a block of a million ids: a list of 1e12 ids is a million numbers
    first: dict[tuple[int, int], int] = {}
    total = 0
    for r in sorted(sizes.collect(), key=lambda r: (r["part"], r["block"])):
        first[r["part"], r["block"]] = total
        total += r["n"]
    given = spark.sparkContext.broadcast((token, first))

    def decode(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        tokens, firsts = given.value
        for batch in source:
            for part, block, ids, counts, control, data in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                ends = np.cumsum(counts)
                values = tokens[unpack(control, data, int(ends[-1]))]
                starts = ends - counts
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(starts + firsts[part, block]), pa.array(counts, pa.int64()), pa.array([values[s:e].tobytes() for s, e in zip(starts, ends, strict=True)], pa.binary())],
                    names=[key, "start", "n_tokens", "ids"],
                )

    return rows.mapInArrow(decode, f"`{key}` long, start long, n_tokens long, ids binary")


def new_folder(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/token-ids-{uuid.uuid4().hex}"
