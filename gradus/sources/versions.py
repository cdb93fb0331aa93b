"""Tables that are replaced as a whole: every version is a folder of its own, and a small manifest says which one counts.

A writer writes its version first and then publishes it by renaming its manifest to the next number. A rename never replaces a
file, so of two writers that ask for one number one is told and takes the next. Until the rename the version before stands, whole and readable,
whatever happens to the writer; afterwards the new one does. Readers take the highest number. A version that nothing
names (its writer died) is never read, and ``tidy`` removes it.

Layout: ``<path>/versions/<id>`` the data, ``<path>/manifests/<number>`` the manifest, ``<path>/pending/<id>`` one that is not published yet.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: How often a writer asks for another number before it gives up.
MOST = 100


class Outdated(RuntimeError):
    """The table is no longer at the version that the writer started from."""


@dataclass(frozen=True)
class Manifest:
    number: int
    version: str
    format: str
    schema: str
    note: str | None = None


class Store:
    """The versions of one path, in whatever file system Spark reaches."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._files = self._place("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _place(self, name: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        place = self._place(folder)
        return sorted(x.getPath().getName() for x in self._files.listStatus(place)) if self._files.exists(place) else []

    def _read(self, number: int) -> Manifest:
        place = self._place(f"manifests/{number:012d}")
        stream = self._files.open(place)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return Manifest(**json.loads(text))

    def numbers(self) -> list[int]:
        return [int(x) for x in self._names("manifests") if x.isdigit()]

    def latest(self) -> Manifest | None:
        numbers = self.numbers()
        return self._read(numbers[-1]) if numbers else None

    def publish(self, rows: DataFrame, *, format: str = "parquet", expected: int | None = None, note: str | None = None) -> Manifest:
        """Write ``rows`` and make them the table. With ``expected``, only if that is still the latest number (0: no table yet)."""
        version = uuid.uuid4().hex
        rows.write.format(format).save(f"{self.path}/versions/{version}")
        for _ in range(MOST):
            last = (self.numbers() or [0])[-1]
            if expected is not None and last != expected:
                raise Outdated(f"{self.path} is at {last}, not at {expected}")
            made = Manifest(last + 1, version, format, rows.schema.json(), note)
            if self._renamed(made):
                return made
        raise Outdated(f"{self.path}: other writers took {MOST} numbers")

    def _renamed(self, made: Manifest) -> bool:
        pending = self._place(f"pending/{made.version}")
        out = self._files.create(pending, True)
        try:
            out.write(bytearray(json.dumps(asdict(made)).encode()))
        finally:
            out.close()
        self._files.mkdirs(self._place("manifests"))
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), self.spark._jsc.hadoopConfiguration())
        how = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(pending, self._place(f"manifests/{made.number:012d}"), how)
        except Py4JJavaError as error:
            if "AlreadyExists" in str(error.java_exception.getClass().getName()):
                return False
            raise
        return True

    def read(self, number: int | None = None) -> DataFrame:
        """The table as of a number, else the latest; no table is an error."""
        made = self._read(number) if number is not None else self.latest()
        if made is None:
            raise FileNotFoundError(f"{self.path} has no published version")
        return self.of(made)

    def of(self, made: Manifest) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(json.loads(made.schema))).format(made.format).load(f"{self.path}/versions/{made.version}")

    def tidy(self, keep: int = 2) -> list[str]:
        """Remove all but the last ``keep`` published versions, and versions that no manifest names; their ids. Not while writers are at work."""
        numbers = self.numbers()
        named = {self._read(n).version for n in numbers[-keep:]} if keep > 0 else set()
        gone = [v for v in self._names("versions") if v not in named]
        for n in numbers[: max(0, len(numbers) - keep)]:
            self._files.delete(self._place(f"manifests/{n:012d}"), False)
        for v in gone:
            self._files.delete(self._place(f"versions/{v}"), True)
        for v in self._names("pending"):
            self._files.delete(self._place(f"pending/{v}"), False)
        return gone


def publish(rows: DataFrame, path: str, **options: Any) -> Manifest:
    return Store(rows.sparkSession, path).publish(rows, **options)


def current(spark: SparkSession, path: str) -> DataFrame:
    return Store(spark, path).read()
