"""What the text operators share: byte views of text columns, batch tokenisation, checkpoints."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it: space and \t \n \v \f \r. bytes.split() uses the same six.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def utf8(text: Column | str) -> Column:
    """The UTF-8 bytes of a text column; null is empty."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(col.cast("binary"), F.lit(b""))


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case, every other code point unchanged."""
    return F.translate(text, UPPER, LOWER)


def blobs(array: pa.Array) -> list[bytes]:
    return [b or b"" for b in array.to_pylist()]


def struct(**columns: pa.Array) -> pa.StructArray:
    return pa.StructArray.from_arrays(list(columns.values()), list(columns))


def checkpoint_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one of spark.checkpoint.dir; a temporary one where none is set and all runs
    in one process. A cluster without that setting is an error: its executors would not see a machine's own folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def stored(df: DataFrame, codec: str | None = None) -> DataFrame:
    """df, computed once, as a parquet table in the shared checkpoint folder: compressed, without lineage, and with
    the size that it has. (A checkpoint() keeps the estimate of its plan, which grows from round to round of a loop.)"""
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid4().hex}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Odd multipliers, so that powers have inverses modulo 2**64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalising 64-bit mix of each value."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if _POWERS.get("n", 0) < n:
        n = max(n, 1 << 20)
        both = []
        for base in (_BASE, _BASE_INVERSE):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS.update(n=n, both=both)
    forward, inverse = _POWERS["both"]
    return forward, inverse


def slices(array: pa.Array, limit: int = 2 << 20) -> Iterator[list[bytes]]:
    """The texts of a batch in order, in parts of about `limit` bytes, so that what is worked out for a part stays
    small beside the batch; a longer text is a part of its own."""
    part, room = [], limit
    for value in array:
        text = value.as_py() or b""
        if part and len(text) > room:
            yield part
            part, room = [], limit
        part.append(text)
        room -= len(text)
    if part:
        yield part


class Words:
    """The words of a batch of texts: where each starts and ends in one buffer, its text's row, and a 64-bit hash."""

    def __init__(self, texts: list[bytes], is_word: np.ndarray, fold: np.ndarray | None = None):
        """is_word: 256 booleans; fold: 256 byte values that replace the bytes first. A word never spans two texts."""
        data = b"\n".join(texts) + b"\n"
        buf = np.frombuffer(data, np.uint8)
        if fold is not None:
            buf = fold[buf]
        inside = is_word[buf]
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        ends_of_text = np.cumsum(lengths)
        inside[ends_of_text - 1] = False
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.row = np.searchsorted(ends_of_text, self.start, side="right")
        self.text_start = ends_of_text - lengths
        self.buf = buf
        self.n_rows = len(texts)

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.n_rows)

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Hash of each word, or of the given byte ranges: a polynomial modulo 2**64, then mixed with the length."""
        start = self.start if start is None else start
        end = self.end if end is None else end
        out = np.empty(len(start), np.uint64)
        i = 0
        while i < len(start):  # in blocks, so that memory follows the words and not their bytes
            j = max(i + 1, int(np.searchsorted(start, start[i] + _BLOCK)))
            a, b = int(start[i]), int(end[j - 1])
            forward, inverse = powers(b - a + 1)
            total = np.zeros(b - a + 1, np.uint64)
            np.cumsum(_SPREAD[self.buf[a:b]] * forward[: b - a], out=total[1:])
            out[i:j] = (total[end[i:j] - a] - total[start[i:j] - a]) * inverse[start[i:j] - a]
            i = j
        return mixed(out + (end - start).astype(np.uint64))


_BLOCK = 1 << 19
#: A fixed random 64-bit value for each byte.
_SPREAD = np.random.default_rng(7).integers(1, 2**64, 256, dtype=np.uint64)


def byte_class(*, without: bytes) -> np.ndarray:
    """256 booleans: true for bytes outside `without`."""
    out = np.ones(256, bool)
    out[list(without)] = False
    return out


#: Words between ASCII white space; A-Z folded to a-z.
NOT_WHITE = byte_class(without=WHITE.encode())
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def beside(docs: DataFrame, names: tuple[str, ...], value: Column) -> tuple[DataFrame, list[Column]]:
    """(row, value), where row holds the columns of docs but `names`, so that no name clashes; and these columns again."""
    kept = [c for c in docs.columns if c not in names]
    row = F.struct(*(F.col(f"`{c}`") for c in kept)) if kept else F.struct(F.lit(0).alias("none"))
    return docs.select(row.alias("row"), value.alias("value")), [F.col("row").getField(c).alias(c) for c in kept]


def in_fold(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id, as text, leaves `fold` modulo `folds`; false for a null id."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % folds == fold, F.lit(False))


def bounded_ids(ids: DataFrame, id_col: str, rows: int) -> DataFrame:
    """At most `rows` distinct ids, those of the smallest hashes (then the smallest ids): a repeatable sample of proven size."""
    named = ids.select(F.col(f"`{id_col}`").alias(id_col)).filter(F.col(id_col).isNotNull()).distinct()
    return named.orderBy(F.xxhash64(id_col), id_col).limit(rows)


def one_text_each(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, raw): for each of a bounded set of distinct ids that docs has, the bytes of its text; of several rows with one
    id the text of least hash. So there are no more rows than ids, however often docs repeats one."""
    raw = utf8(F.col(f"`{text_col}`"))
    found = docs.select(F.col(f"`{id_col}`").alias(id_col), raw.alias("raw")).join(F.broadcast(ids), id_col, "left_semi")
    return found.groupBy(id_col).agg(F.min_by("raw", F.struct(F.xxhash64("raw"), "raw")).alias("raw"))
