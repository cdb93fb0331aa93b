"""Exact Jaccard join over word shingles with set-relation skipping; links, classes and components.

Two texts link when ``100 * intersection >= percent * union`` of their shingle sets. No link is
lost, yet copies are never expanded into pairs, because answers are derived from those of a highly
similar set wherever a relation between sets allows it:

1. *Equal sets.* Order-free 128-bit signatures group equal sets into classes; the smallest id of a
   class stands for it and its answers are the class's answers.
2. *Highly similar sets.* MinHash bands propose for each class a leader (the smallest id of a band).
   Proposals are verified exactly, and each verified set joins its leader's component. Nothing rests
   on the bands' recall: what they miss, step 3 finds.
3. *Index lists.* Each set lists its prefix, ``n - ceil(t n) + 1`` shingles in a global order in which
   frequent shingles (by a fixed-size count sketch over all texts) come last. A shingle's list is
   sorted by set size and cut into blocks. Blocks whose members all lie in the probing set's component
   are skipped, their answer being known; so are blocks that no position lets reach the needed
   overlap, and sizes outside ``[t n, n / t]``. Two linked sets share their first common prefix
   shingle, and at that place both bounds hold, so the join is exact.
4. *Parities.* A set's parity vector holds the parity of its shingles in each of at least twice as many
   buckets as it has shingles. Two vectors differ in no more bits than the sets differ in shingles, so
   pairs whose vectors differ too much are ruled out before their texts are shipped; the rest are
   verified exactly.

The sketch only orders shingles and the bands only propose; neither affects results. Shingles are
compared as 64-bit hashes of their words, a word's being a polynomial of its bytes modulo 2^64: texts made to
collide (known for such polynomials) can pass for equal words; the chance for others is about one in 2^60 a pair.

Verification ships each text once for each leader it is held against: pairs are dealt by leader, with
followers of a hot leader salted over tasks, and streamed; no task holds a group. The list of a shingle that
the sketch counts often is dealt out in parts, one for each pair of salts, and rows of an id that many pairs
have are salted wherever they are joined.

Defined results: null, empty and wordless texts have empty sets and link with nothing; a text of
fewer than five words is one shingle; ties and equal rows link (they are equal sets); rows of null
id get a null component; an id is taken as a key: rows that repeat it are copies of one document. An
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, cut, ready
from .shingles import mix, sets, shared

PERCENT = 80
BANDS = 4
SKETCH_BITS, SKETCH_BLOCKS = 20, 16
#: Rows of a few numbers that may be broadcast: some 100 bytes each as a hashed relation, so about 50 MB at most; more are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Bytes of parity vectors that may be broadcast.
BROADCAST_BYTES = 48_000_000
#: Followers of one leader, or pairs of one id, that are dealt as one part; each part takes one more copy of the leader.
FOLLOWERS = 32
#: Sets that list a shingle, by the sketch, from which on its list is dealt out in parts.
LIST = 20_000
BLOCK = 64
_SEEDS = mix(np.arange(1, 2 * BANDS + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def least_overlap(total, percent: int = PERCENT):
    """The smallest intersection of two linked sets whose sizes sum to ``total``."""
    return -((-percent * total) // (100 + percent))


def prefix_length(size: int, percent: int = PERCENT) -> int:
    return size + (-percent * size) // 100 + 1 if size else 0


def _signed(x) -> np.ndarray:
    return np.asarray(x, dtype=np.uint64).view(np.int64)


def _parity(own: np.ndarray) -> bytes:
    """Parity of the set's size in each bucket of its low hash bits, packed; folding halves gives the parity in half as many."""
    buckets = max(64, 1 << int(2 * len(own) - 1).bit_length()) if len(own) else 64
    odd = np.bincount((own & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _fold(parity: bytes, size: int) -> int:
    """The vector as a number, folded to ``size`` bytes."""
    value, n = int.from_bytes(parity, "little"), len(parity)
    while n > size:
        n //= 2
        value = (value >> (8 * n)) ^ (value & ((1 << (8 * n)) - 1))
    return value


def _small(rows: DataFrame, bound: int) -> DataFrame:
    """``rows``, to be broadcast if they are at most ``bound``."""
    return F.broadcast(rows) if rows.count() <= bound else rows


def _of_pairs(rows: DataFrame, pairs: DataFrame, bound: int) -> DataFrame:
    """The ``rows`` whose id is one of a pair's."""
    ids = cut(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    return rows.join(_small(ids, bound), "id", "left_semi")


def _attached(pairs: DataFrame, values: DataFrame, key: str, broadcast: bool, bound: int) -> DataFrame:
    """``pairs`` with the columns of ``values`` (id, ...) of their ``key``, a or b.

    Ids of many pairs would send all of them to one task: unless ``values`` is broadcast, such ids are
    salted by the other id of the pair, and their values copied to each salt.
    """
    values = values.withColumnRenamed("id", key)
    if broadcast:
        return pairs.join(F.broadcast(values), key)
    hot = _small(_fans(pairs, key), bound)
    salt = F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("b" if key == "a" else "a"), F.col("salts"))).cast("int")
    left = pairs.join(hot, key, "left").withColumn("salt", salt).drop("salts")
    right = values.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return left.join(right, [key, "salt"]).drop("salt")


def _fans(pairs: DataFrame, key: str) -> DataFrame:
    """(key, salts) of the ids that more than FOLLOWERS pairs have: a small part of the pairs."""
    counted = pairs.groupBy(key).agg(F.ceil(F.count("*") / FOLLOWERS).cast("int").alias("salts"))
    return cut(counted.where("salts > 1"))


def _plausible(rows: DataFrame, pairs: DataFrame, percent: int, bound: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose parity vectors do not rule a link out; ``rows`` has (id, size, parity)."""
    held = cut(_of_pairs(rows.select("id", "size", "parity"), pairs, bound))
    weight = held.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("parity")), F.lit(0)).alias("bytes")).first()
    sides = pairs
    for x in ("a", "b"):
        own = held.select("id", F.col("size").alias(f"n{x}"), F.col("parity").alias(f"p{x}"))
        sides = _attached(sides, own, x, weight["n"] <= bound and weight["bytes"] <= BROADCAST_BYTES, bound)

    def over(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            keep = []
            for na, pa_, nb, pb in zip(*columns[2:], strict=True):
                width = min(len(pa_), len(pb))
                apart = (_fold(pa_, width) ^ _fold(pb, width)).bit_count()  # at most the size of the difference
                keep.append(apart <= na + nb - 2 * least_overlap(na + nb, percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return sides.select("a", "b", "na", "pa", "nb", "pb").mapInArrow(over, "a long, b long").distinct()


def _profile(docs: DataFrame) -> DataFrame:
    """Of each row (id, text): set size, signature and band keys; and of each task, its blocks of the count sketch."""
    step = (1 << SKETCH_BITS) // SKETCH_BLOCKS

    def over(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        known: set[int] = set()
        for batch in source:
            size, one, two, bands, parity = [], [], [], [], []
            for own in sets(batch.column(1).to_pylist()):
                size.append(len(own))
                spread = mix(own)
                one.append(own.sum(dtype=np.uint64))
                two.append(spread.sum(dtype=np.uint64))
                parity.append(_parity(own))
                if not len(own):
                    bands.append(None)
                    continue
                least = np.array([mix(own ^ s).min() for s in _SEEDS])
                bands.append(_signed(mix(least[::2] + np.arange(BANDS, dtype=np.uint64)) ^ least[1::2]))
                if one[-1] not in known:  # copies in a task count once
                    known.add(one[-1])
                    np.add.at(counts, (own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            n = batch.num_rows
            yield _rows(batch.column(0), pa.array(size, pa.int32()), pa.array(_signed(one)), pa.array(_signed(two)), pa.array(bands, pa.list_(pa.int64())), pa.array(parity, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()))
        pack = zstandard.ZstdCompressor(level=1).compress
        blocks = [pack(counts[i * step : (i + 1) * step].tobytes()) for i in range(SKETCH_BLOCKS)]
        none = [pa.nulls(SKETCH_BLOCKS, t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())]
        yield _rows(*none, pa.array(range(SKETCH_BLOCKS), pa.int32()), pa.array(blocks, pa.binary()))

    def _rows(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(list(columns), names=["id", "size", "one", "two", "bands", "parity", "block", "counts"])

    return docs.mapInArrow(over, "id long, size int, one long, two long, bands array<long>, parity binary, block int, counts binary")


def _levels(profile: DataFrame) -> np.ndarray:
    """The order of shingles: 0 for buckets within noise, else the count. A table of fixed size, whatever the input."""

    def add(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, total = zstandard.ZstdDecompressor().decompress, {}
        for batch in source:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.frombuffer(unpack(raw), dtype=np.uint32)
                total[block] = total.get(block, 0) + counts.astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "counts"])

    shape = "block int, counts binary"
    parts = profile.where("block IS NOT NULL").select("block", "counts")
    summed = parts.mapInArrow(add, shape).repartition(SKETCH_BLOCKS, "block").mapInArrow(_same_width(add), shape).collect()
    step = (1 << SKETCH_BITS) // SKETCH_BLOCKS
    counts = np.zeros(1 << SKETCH_BITS)
    for row in summed:
        counts[row["block"] * step : (row["block"] + 1) * step] += np.frombuffer(row["counts"], dtype=np.uint64)
    noise = counts.mean() + 6 * np.sqrt(counts.mean()) + 6
    return np.where(counts > noise, counts, 0).clip(0, 2**31 - 1).astype(np.int32)


def _same_width(add):
    """The second round of additions reads 64-bit counts that are not packed."""

    def over(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in source:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[block] = total.get(block, 0) + np.frombuffer(raw, dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "counts"])

    return over


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node of each connected component, by alternating large-star and small-star steps."""
    stars = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    seen = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u AND v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u")
        stars = cut(tied.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if state == seen:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state


def verified(docs: DataFrame, pairs: DataFrame, percent: int = PERCENT, bound: int = BROADCAST_ROWS) -> DataFrame:
    """The (a, b) of ``pairs`` whose texts in ``docs`` (id, text) link; a leads, b follows."""
    hot = _small(_fans(pairs, "a"), bound)
    leaders = pairs.select("a").distinct().join(hot, "a", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    dealt = pairs.join(hot, "a", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    needed = cut(
        leaders.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("id"), F.lit(0).alias("role"))
        .unionByName(dealt.select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.col("b").alias("id"), F.lit(1).alias("role")))
    )
    texts = docs.join(_small(needed, bound), "id")

    def hold(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        at, leader = None, None
        for batch in source:
            left, right = [], []
            rows = zip(*(batch.column(i).to_pylist() for i in range(4)), sets(batch.column(4).to_pylist()), strict=True)
            for a, salt, role, ident, own in rows:
                if role == 0:
                    at, leader = (a, salt), own
                elif at == (a, salt):
                    both = shared(leader, own)
                    if both and 100 * both >= percent * (len(leader) + len(own) - both):
                        left.append(a)
                        right.append(ident)
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    dealt = texts.repartition("a", "salt").sortWithinPartitions("a", "salt", "role", "id").select("a", "salt", "role", "id", "text")
    return dealt.mapInArrow(hold, "a long, b long")


def _entries(labelled: DataFrame, levels, percent: int, list_rows: int) -> DataFrame:
    """(shingle, deal, size, place, id, label) of each prefix shingle of each set; equal sets of a task are listed once.

    ``deal`` is WHOLE for ordinary lists. The list of a shingle that the sketch counts over ``list_rows`` times is split
    into k salts by id, and each pair of salts, a salt with itself included, is a part of its own, so that no task holds
    the list: an entry goes to its k parts, and ``deal`` is 3 * part + side, the side being 2 where both salts are one.
    """
    names = ["shingle", "deal", "size", "place", "id", "label"]

    def over(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        table, known = levels.value, set()
        for batch in source:
            parts, sizes, places, rows, ranks = [], [], [], [], []
            for i, own in enumerate(sets(batch.column(1).to_pylist())):
                n = len(own)
                mark = (n, own.sum(dtype=np.uint64), mix(own).sum(dtype=np.uint64)) if n else None
                if not n or mark in known:
                    continue
                known.add(mark)
                level = table[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                if level.any():
                    order = np.argsort(level, kind="stable")
                    own, level = own[order], level[order]
                p = prefix_length(n, percent)
                parts.append(own[:p])
                ranks.append(level[:p])
                sizes.append(n)
                places.append(p)
                rows.append(i)
            if parts:
                ids, labels = (np.array(batch.column(c).to_numpy(zero_copy_only=False))[rows] for c in (0, 2))
                columns = [
                    _signed(np.concatenate(parts)), np.repeat(np.array(sizes, dtype=np.int32), places),
                    np.concatenate([np.arange(p, dtype=np.int32) for p in places]), np.repeat(ids, places).astype(np.int64), np.repeat(labels, places).astype(np.int64),
                ]
                salts = -(-np.concatenate(ranks).astype(np.int64) // list_rows)
                deal = np.full(len(salts), WHOLE, dtype=np.int64)
                split = np.flatnonzero(salts > 1)
                if len(split):
                    columns, deal = _split(columns, deal, split, salts[split])
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(deal), *map(pa.array, columns[1:])], names=names)

    return labelled.select("id", "text", "label").mapInArrow(over, "shingle long, deal long, size int, place int, id long, label long")


#: Candidate pairs that a task holds before it passes them on: 16 bytes each.
PAIRS = 500_000
#: The deal of entries of lists that are not split: part 0, all on one side.
WHOLE = 2


def _split(columns: list[np.ndarray], deal: np.ndarray, at: np.ndarray, salts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The entries with those ``at`` replaced by a copy for each part of their list that their salt is in."""
    own = np.repeat((mix(columns[3][at].view(np.uint64)) % salts.astype(np.uint64)).astype(np.int64), salts)
    many, source = np.repeat(salts, salts), np.repeat(at, salts)
    other = np.arange(len(source)) - np.repeat(np.cumsum(salts) - salts, salts)
    part = 1 + np.minimum(own, other) * many + np.maximum(own, other)
    side = np.where(own == other, 2, (own > other).astype(np.int64))
    rest = np.delete(np.arange(len(deal)), at)
    return [np.concatenate([x[rest], x[source]]) for x in columns], np.concatenate([deal[rest], 3 * part + side])


def _probe(size: np.ndarray, place: np.ndarray, ident: np.ndarray, label: np.ndarray, side: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(earlier ids, later ids) of the pairs of one list or part, sorted by size, that neither relations nor bounds rule out."""
    rest = size - place  # shared shingles at most, from this place on
    edges = np.arange(0, len(size), BLOCK)
    low, high = np.minimum.reduceat(label, edges), np.maximum.reduceat(label, edges)
    most, small = np.maximum.reduceat(rest, edges), size[edges]
    first = 0
    for j in range(1, len(size)):
        while 100 * size[first] < percent * size[j]:
            first += 1
        need = least_overlap(small + size[j], percent)
        alive = np.flatnonzero(((low != high) | (low != label[j])) & (most >= need) & (rest[j] >= need))
        for k in alive[(alive >= first // BLOCK) & (alive * BLOCK < j)]:
            s, e = max(first, k * BLOCK), min(j, (k + 1) * BLOCK)
            ok = (label[s:e] != label[j]) & (np.minimum(rest[s:e], rest[j]) >= least_overlap(size[s:e] + size[j], percent))
            ok &= (side[s:e] != side[j]) | (side[j] == 2)
            if ok.any():
                found = ident[s:e][ok]
                yield found, np.full(len(found), ident[j])


def _pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Distinct (a, b), the smaller id first."""
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])


def _candidates(entries: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b) of different labels from the lists; lists of one member or one label are passed over whole."""

    def over(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for batch in _and_end(source):
            columns = [] if batch is None else [np.asarray(batch.column(i)) for i in range(6)]
            if kept is not None:
                columns = [np.concatenate(x) for x in zip(kept, columns, strict=True)] if columns else kept
            if not columns or not len(columns[0]):
                continue
            token, part = columns[0], columns[1] // 3
            starts = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (part[1:] != part[:-1])]))
            if batch is None:
                kept = None
            else:  # the last list may go on in the next batch
                kept = [x[starts[-1] :] for x in columns]
                columns, starts = [x[: starts[-1]] for x in columns], starts[:-1]
            if not len(starts):
                continue
            _, deal, size, place, ident, label = columns
            mixed = np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts)
            ends = np.append(starts[1:], len(label))
            found, held = [], 0
            for s, e in zip(starts[mixed], ends[mixed], strict=True):
                for pair in _probe(size[s:e].astype(np.int64), place[s:e], ident[s:e], label[s:e], deal[s:e] % 3, percent):
                    found.append(pair)
                    held += len(pair[0])
                    if held >= PAIRS:  # a list's pairs are passed on as they come
                        yield _pairs(found)
                        found, held = [], 0
            if found:
                yield _pairs(found)

    part = F.floor(F.col("deal") / 3)
    listed = entries.repartition("shingle", part).sortWithinPartitions("shingle", part, "size", "place", "id")
    return listed.mapInArrow(over, "a long, b long").distinct()


def _and_end(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from source
    yield None


def linked(docs: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = PERCENT, bound: int = BROADCAST_ROWS, list_rows: int = LIST) -> DataFrame:
    """(key, n_shingles, class_id, component_id) of every row: the smallest id of its equal sets, and of all it links to by links.

    At most ``bound`` rows are broadcast, and lists over ``list_rows`` are split; neither affects the result.
    """
    spark = ready(docs.sparkSession)
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    profile = cut(_profile(source))
    rows = profile.where("block IS NULL").select("id", "size", "one", "two", "bands", "parity")
    levels = spark.sparkContext.broadcast(_levels(profile))  # 4 MB, whatever the input

    # equal sets
    full = rows.where("size > 0 AND id IS NOT NULL")
    classes = cut(full.groupBy("size", "one", "two").agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands")))

    # highly similar sets: for each class its best leader
    banded = classes.select("rep", "size", F.posexplode("bands").alias("band", "mark"))
    leads = banded.groupBy("band", "mark").agg(F.min(F.struct("rep", "size")).alias("lead"), F.count("*").alias("n")).where("n > 1")
    votes = (
        banded.join(leads, ["band", "mark"]).where("rep > lead.rep")
        .where(F.least("size", "lead.size") * 100 >= percent * F.greatest("size", "lead.size"))
        .groupBy(F.col("lead.rep").alias("a"), F.col("rep").alias("b")).agg(F.count("*").alias("votes"))
        .groupBy("b").agg(F.max_by("a", F.struct(F.col("votes"), -F.col("a"))).alias("a"))
    )
    near = components(verified(source, cut(_plausible(rows, cut(votes.select("a", "b")), percent, bound)), percent, bound))

    # index lists: only pairs of different labels are left to decide
    labels = classes.select("size", "one", "two", "rep").join(near, F.col("rep") == F.col("node"), "left")
    labels = labels.select("size", "one", "two", "rep", F.coalesce("root", "rep").alias("label"))
    of_rows = cut(full.select("id", "size", "one", "two").distinct().join(labels, ["size", "one", "two"]).select("id", "rep", "label"))
    moved = of_rows.where("id <> label").groupBy("id").agg(F.min("label").alias("label"))
    labelled = source.where("id IS NOT NULL").join(_small(moved, bound), "id", "left").select("id", "text", F.coalesce("label", "id").alias("label"))
    pairs = cut(_candidates(_entries(labelled, levels, percent, list_rows), percent))
    late = cut(verified(source, cut(_plausible(rows, pairs, percent, bound)), percent, bound))
    by_id = cut(_of_pairs(of_rows.groupBy("id").agg(F.min("label").alias("label")), late, bound))
    few = by_id.count() <= bound
    crossing = late
    for x, y in (("a", "x"), ("b", "y")):
        crossing = _attached(crossing, by_id.withColumnRenamed("label", y), x, few, bound)
    merged = components(crossing, "x", "y")
    final = of_rows.groupBy("id").agg(F.min("rep").alias("rep"), F.min("label").alias("label")).join(merged, F.col("label") == F.col("node"), "left")
    final = final.select("id", "rep", F.coalesce("root", "label").alias("component"))
    return rows.select("id", "size").join(final, "id", "left").select(
        F.col("id").alias(key), F.col("size").cast("long").alias("n_shingles"),
        F.coalesce("rep", "id").alias("class_id"), F.coalesce("component", "id").alias("component_id"),
    )


def first_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = PERCENT, bound: int = BROADCAST_ROWS) -> DataFrame:
    """One row of ``docs`` of each component, that of smallest id; rows without words or id all stay."""
    found = cut(linked(docs.select(key, text), key=key, text=text, percent=percent, bound=bound))
    dropped = found.where(F.col("component_id") != F.col(key)).select(key).distinct()
    kept = docs.join(_small(dropped, bound), key, "left_anti").select(*docs.columns)
    if found.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").isEmpty():
        return kept
    # repeated ids: copies of one document
    return kept.where(F.col(key).isNull()).unionByName(kept.where(F.col(key).isNotNull()).dropDuplicates([key]))
