"""Lines of text files with their file and number, as a data source of Spark: ``spark.read.format("numbered_lines").load(path)``.

Files are read in splits of ``splitBytes``, each by one task; a line belongs to the split in which it begins. A task knows
the number of a line within its split alone, so ``numbered`` adds what earlier splits of the file hold, one count a split. Filters on the
file name and on the beginning of a line are taken over by the source where Spark offers them (``spark.sql.python.filterPushdown.enabled``): files are then
not opened at all, and lines are dropped before they become rows; line numbers stay those of the file.

``json_lines`` parses each line and keeps what is wrong with it; ``event_log`` and ``cases`` build on that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringStartsWith

from ..session import importable

NAME, SHAPE = "numbered_lines", "file string, split int, line int, said string"
SPLIT_BYTES, BLOCK, ROWS = 64 << 20, 1 << 20, 20_000
#: What can be wrong with a line.
MALFORMED, NO_OBJECT, WRONG_TYPE = "malformed JSON", "no JSON object", "a field of another type"


@dataclass
class Split(InputPartition):
    path: str
    name: str
    number: int
    start: int
    end: int


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class LineReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.size = int(options.get("splitBytes", SPLIT_BYTES))
        self.file: str | None = None
        self.prefix: bytes | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("file",):
                self.file = f.value
            elif isinstance(f, StringStartsWith) and f.attribute == ("said",):
                self.prefix = f.value.encode()
            else:
                yield f

    def partitions(self) -> list[Split]:
        store, path = _store(self.path)
        found = store.get_file_info(path)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [found] if found.type == fs.FileType.File else [x for x in store.get_file_info(fs.FileSelector(path, recursive=True)) if x.type == fs.FileType.File]
        own = [x for x in sorted(files, key=lambda x: x.path) if not x.base_name.startswith(("_", ".")) and self.file in (None, x.base_name)]
        return [Split(x.path, x.base_name, i, at, min(at + self.size, x.size)) for x in own for i, at in enumerate(range(0, max(x.size, 1), self.size))]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        lines: list[tuple[int, bytes]] = []
        for line, said in enumerate(_lines(store, split), 1):
            if self.prefix is None or said.startswith(self.prefix):
                lines.append((line, said))
            if len(lines) == ROWS:
                yield _batch(split, lines)
                lines = []
        if lines:
            yield _batch(split, lines)


def _batch(split: Split, lines: list[tuple[int, bytes]]) -> pa.RecordBatch:
    said = [x.decode("utf-8", "replace") for _, x in lines]
    n = len(lines)
    return pa.RecordBatch.from_arrays(
        [pa.array([split.name] * n, pa.string()), pa.array([split.number] * n, pa.int32()), pa.array([i for i, _ in lines], pa.int32()), pa.array(said, pa.string())], names=["file", "split", "line", "said"]
    )


def _lines(store: fs.FileSystem, split: Split) -> Iterator[bytes]:
    """The lines that begin in the split; a line feed ends a line, a carriage return before it goes."""
    with store.open_input_file(split.path) as source:
        at = split.start
        left = b""
        if at:  # a line that begins here follows a line feed
            source.seek(at - 1)
            at -= 1
        else:
            source.seek(0)
        skip = bool(split.start)
        begins = split.start
        while True:
            block = source.read(BLOCK)
            if not block:
                break
            left += block
            *whole, left = left.split(b"\n")
            for x in whole:
                if skip:
                    skip = False
                    begins = at + len(x) + 1
                    at = begins
                    if begins >= split.end:
                        return
                    continue
                if at >= split.end:
                    return
                yield x.removesuffix(b"\r")
                at += len(x) + 1
            if not skip and at >= split.end:
                return
        if left and not skip and at < split.end:
            yield left.removesuffix(b"\r")


class NumberedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SHAPE

    def reader(self, schema: T.StructType) -> LineReader:
        return LineReader(dict(self.options))


def lines(spark: SparkSession, path: str, *, split: int = SPLIT_BYTES) -> DataFrame:
    """(file, split, line, said): ``line`` counts from 1 within the split."""
    importable(spark).dataSource.register(NumberedLines)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(NAME).option("splitBytes", split).load(path)


def numbered(spark: SparkSession, path: str, *, file: str | None = None, prefix: str | None = None, split: int = SPLIT_BYTES) -> DataFrame:
    """(file, line_no, said) of the lines, of one file or beginning with ``prefix`` if asked; numbers are those of the whole file."""
    # two loads: Spark keeps what was pushed down with a loaded source, so a filtered and an unfiltered use of one load would be mixed up
    every, wanted = (x.where(F.col("file") == file) if file is not None else x for x in (lines(spark, path, split=split), lines(spark, path, split=split)))
    sizes = every.groupBy("file", "split").agg(F.max("line").alias("n"))  # a row a split
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("file", "split", before.alias("__before"))
    wanted = wanted.where(F.startswith("said", F.lit(prefix))) if prefix is not None else wanted
    return wanted.join(F.broadcast(starts), ["file", "split"]).select("file", (F.col("line") + F.col("__before")).alias("line_no"), "said")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256, n_bytes) of the files under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes"))


def json_lines(spark: SparkSession, path: str, schema: str, *, required: tuple[str, ...] = (), **options) -> DataFrame:
    """(file, line_no, the fields of ``schema``, error): every line that is not blank, and what is wrong with it; fields of a wrong line are null.

    A line is wrong that is no JSON, no object, has a field of another type, or lacks one of ``required``.
    """
    shape = T._parse_datatype_string(schema)
    known = [f.name for f in shape.fields]
    rows = numbered(spark, path, **options).where(F.trim("said") != "")
    made = F.from_json("said", T.StructType([*shape.fields, T.StructField("__bad", T.StringType())]), {"columnNameOfCorruptRecord": "__bad"})
    rows = rows.withColumn("__made", made)
    parsed = F.try_parse_json("said")
    found = [
        F.when(parsed.isNull() | F.coalesce(F.json_array_length(F.concat(F.lit("["), "said", F.lit("]"))) != 1, F.lit(True)), MALFORMED),  # in brackets: nothing may follow the value
        F.when(~F.schema_of_variant(parsed).startswith("OBJECT"), NO_OBJECT), F.when(F.col("__made.__bad").isNotNull() | F.col("__made").isNull(), WRONG_TYPE),
        *(F.when(F.col(f"__made.`{f}`").isNull(), F.lit(f"{f} is missing")) for f in required),
    ]
    error = F.coalesce(*found)
    rows = rows.withColumn("error", error)
    return rows.select("file", "line_no", *(F.when(F.col("error").isNull(), F.col(f"__made.`{f}`")).alias(f) for f in known), "error")


def event_log(spark: SparkSession, path: str, prefix: str = "", **options) -> DataFrame:
    """(file, line_no, ts, event, artifact_key, detail, error) of an append-only log: events whose name starts with ``prefix``, and wrong lines."""
    rows = json_lines(spark, path, "ts timestamp, event string, artifact_key string, detail string", required=("ts", "event"), **options)
    return rows.where(F.col("error").isNotNull() | F.startswith("event", F.lit(prefix)))


def cases(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    """Evaluation cases, and the first wrong line as ``file:line: reason``: a set of cases with one is not to be used."""
    rows = json_lines(spark, path, "id string, query string, relevant array<string>, retrieved array<string>, judge map<string,double>", required=("id", "query", "relevant", "retrieved"))
    bad = rows.where("error IS NOT NULL").orderBy("file", "line_no").first()
    return rows.where("error IS NULL").drop("error"), f"{bad.file}:{bad.line_no}: {bad.error}" if bad else None
