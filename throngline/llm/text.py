"""Word rules and batch helpers shared by the text operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Words of the benchmark and licence rules: runs of 0-9, a-z and anything beyond ASCII, after lower-casing A-Z.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of the quality and near-duplicate rules: runs of anything but space and \t..\r.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: For bytes.translate: A-Z become a-z, separators become spaces, bytes beyond ASCII stay.
_ALNUM_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_SPACE_TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 32 or 9 <= b <= 13 else b for b in range(256))


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased words of UTF-8 text by ALNUM_WORD."""
    return text.translate(_ALNUM_TABLE).split()


def alnum_folded() -> bytes:
    """What each byte stands for in words by ALNUM_WORD: itself, its lower-case letter, or a space."""
    return _ALNUM_TABLE


def space_words(text: bytes) -> list[bytes]:
    """Lower-cased words of UTF-8 text by SPACE_WORD (bytes.split would also cut at \\x1c..\\x1f; a table does not)."""
    return [w for w in text.translate(_SPACE_TABLE).split(b" ") if w]


def sql_lower(column: str) -> str:
    """DuckDB expression that lower-cases A-Z only."""
    return f"translate({column}, '{_UPPER}', '{_LOWER}')"


def utf8(column: pa.Array) -> list[bytes | None]:
    """The values of a string column as bytes, without decoding them."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def chunks(texts: list[bytes | None], most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` bytes of text, one row at least: bounds the Python objects alive at once."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t or b"")
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it: for columns that exist inside an operator only."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where it is unset, a temporary one on a local master, an error elsewhere."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


class Tables:
    """Steps of one operator call that are computed once and kept as Parquet below the shared folder.

    Later steps reread them, lost executors or not. `drop` deletes those that no later step reads; the others go when
    the session's JVM ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        place = self._path(self.folder)
        self._files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._files.deleteOnExit(place)

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self._files.delete(self._path(f"{self.folder}/{name}"), True)


def settled(df: DataFrame) -> DataFrame:
    """`df` computed once and kept as a table of its own until the session's JVM ends."""
    return Tables(df.sparkSession).keep("table", df)
