"""What the operators of this subpackage share: tables, scratch tables, word splitting and hashing."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every operator: blank and the five ASCII controls from tab to carriage return.
SPACE_RUN, NOT_SPACE = "[ \\t\\n\\x0B\\f\\r]+", "[^ \\t\\n\\x0B\\f\\r]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables in `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text: runs of anything but the six separators."""
    return F.array_remove(F.split(text, SPACE_RUN), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it.

    Where it is unset, a folder of this machine, which only a session of this machine alone may use.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), "tidewatch-scratch")
    return f"file://{own}"


def release_memory() -> None:
    """Give freed memory of this worker back to the machine, so that idle workers stay small."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library: it keeps what it has freed


def text_slices(batches: Iterator[pa.RecordBatch], size: int, rows: int, text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Pieces of Arrow batches with at most `size` bytes of text (but for a single text) and `rows` rows.

    Gives each piece and its texts in UTF-8, null ones empty. However large the batches are that Spark sends,
    only a piece's texts are Python objects at a time.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            end = min(max(int(np.searchsorted(ends, before + size, side="right")), at + 1), at + rows)
            yield batch.slice(at, end - at), [t or b"" for t in column.slice(at, end - at).cast(pa.binary()).to_pylist()]
            at = end
    release_memory()


def slices(texts: list[str | None], chars: int, rows: int) -> Iterator[tuple[int, int]]:
    """Places where a list of texts is cut, so that no slice but a single text has more characters or rows."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or (end - at < rows and size + len(texts[end] or "") <= chars)):
            size += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


#: Rows that Python workers get at once: texts are long, and buffers of Spark's default of 10,000 stay with an executor.
BATCH_ROWS, BATCH_SETTING = 500, "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> SparkSession:
    """The session, with batches of BATCH_ROWS from now on if its user has left Spark's default as it is."""
    if spark.conf.get(BATCH_SETTING) == "10000":
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    return spark


class Scratch:
    """Tables written to the shared folder, so that lost executors cost no recomputation of earlier steps.

    `keep` writes a table and reads it back; `drop` deletes those which are no longer needed.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = small_batches(spark)
        self.root = f"{shared_dir(spark)}/tidewatch/{name}-{uuid.uuid4().hex}"
        self._n, self._held = 0, {}

    def path(self, label: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:02d}-{label}"

    def keep(self, df: DataFrame, label: str, shuffled: bool = True) -> DataFrame:
        """The table, written and read back. shuffled: its rows come from a shuffle. Such tables are small next to the
        input; they get a file for every eight shuffle partitions, and one for each core at least."""
        path = self.path(label)
        schema = df.schema
        if shuffled:
            files = max(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 8)
            df = df.coalesce(files)
        df.write.parquet(path)
        if self._n == 1:  # what isn't dropped before goes when the driver ends
            root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            root.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(root)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        self._held[path] = out
        return out

    def drop(self, *tables: DataFrame) -> None:
        for one in tables:
            if self._held.pop(one._scratch_path, None) is not None:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(one._scratch_path)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop_all_but(self, *tables: DataFrame) -> None:
        """Delete every table that was kept, but for these."""
        paths = {one._scratch_path for one in tables}
        self.drop(*[one for path, one in self._held.items() if path not in paths])


# --- word hashes of whole batches -------------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply): every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_LOWER = _BYTE_VALUE.copy()
_LOWER[65:91] = _BYTE_VALUE[97:123]
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS = np.ones(1, dtype=np.uint64)
_INVERSE = np.ones(1, dtype=np.uint64)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse modulo 2**64."""
    global _POWERS, _INVERSE
    if len(_POWERS) <= n:
        size = max(n + 1, 2 * len(_POWERS), 1 << 16)
        for name, base in (("_POWERS", _BASE), ("_INVERSE", _BASE_INVERSE)):
            step = np.full(size, base, dtype=np.uint64)
            step[0] = 1
            globals()[name] = np.multiply.accumulate(step)
    return _POWERS, _INVERSE


#: ASCII characters that plain words lack.
_PUNCTUATION = rb"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""


def word_hashes(texts: list[str | bytes | None], lower: bool = False, plain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of a batch of texts: (hash, start byte, end byte, number of words per text).

    Starts and ends count bytes of the UTF-8 text. A hash is a polynomial over the word's bytes modulo
    2**64 with random byte values, taken from prefix sums of the whole batch, then mixed with the length.
    lower: without regard to the case of A-Z. plain: without regard to any case and to ASCII punctuation (starts
    and ends then count the bytes that remain).
    """
    raw = [t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass") for t in texts]
    if plain:
        raw = [t.decode("utf-8", "surrogatepass").lower().encode("utf-8", "surrogatepass").translate(None, _PUNCTUATION) for t in raw]
    lengths = np.array([len(r) + 1 for r in raw], dtype=np.int64)
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    space = _IS_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space))))
    starts, ends = edge[::2], edge[1::2]
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    per_text = np.diff(np.searchsorted(starts, offsets))
    powers, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_LOWER if lower else _BYTE_VALUE)[data] * powers[: len(data)], out=sums[1:])
    value = (sums[ends] - sums[starts]) * inverse[starts]
    hashes = mix(value + mix((ends - starts).astype(np.uint64)))
    base = np.repeat(offsets[:-1], per_text)
    return hashes, starts - base, ends - base, per_text


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n words; the order in a window matters."""
    if len(words) < n:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = out * _BASE + words[k : len(words) - n + 1 + k]
    return mix(out)
