"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir; a local one only where all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder or "/tmp/checkpoints/tessella"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """checkpoint() needs a folder that all executors share; one that is set already stays."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


#: Tables of this driver's operators in the shared folder that are not released yet.
_STORED: list[str] = []


def stored(path: str) -> str:
    """path, noted as a table that `release` removes."""
    _STORED.append(path)
    return path


def release(spark: SparkSession, since: int = 0) -> int:
    """Removes what operators have stored between their steps (of all, those after the first `since`), once their results are written; returns how many tables. A result of theirs that is not written yet can't be made after that."""
    paths, _STORED[since:] = _STORED[since:], []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def n_stored() -> int:
    return len(_STORED)


def written(df: DataFrame) -> DataFrame:
    """df as a table of its own in the shared folder, until `release`. Like checkpoint(), but what the planner knows of the old plan (its constraints, which grow with every round of a loop) stays behind."""
    path = stored(f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null ids fall into no fold (null)."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % parts


def held_out(doc_id: Column, parts: int, which: int) -> Column:
    """Whether an id is in that fold; a null id is in none."""
    return F.coalesce(fold(doc_id, parts) == which, F.lit(False))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Separators of words; the words are what is left after lower_ascii.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """array<string>: the words of a text after lower-casing A-Z; null has none."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, also inside lambda functions."""
    return F.transform(F.array(value), body)[0]


def struct(**fields: Column) -> Column:
    """A struct whose field names also hold inside lambda functions, where Spark drops aliases."""
    return F.named_struct(*(x for name, value in fields.items() for x in (F.lit(name), value)))


def per_slice(texts: pa.Array, most: int = textnum.SLICE_BYTES) -> Iterator[tuple[int, int, textnum.Words]]:
    """Words of a batch in slices of bounded bytes."""
    for a, b in textnum.slices(texts, most):
        yield a, b, textnum.words(texts[a:b])


def owners(w: textnum.Words) -> np.ndarray:
    """Index of the text that each word is in."""
    return np.repeat(np.arange(len(w.first) - 1), w.counts)


def pack(docs: DataFrame, **columns: Column) -> DataFrame:
    """All columns of docs in one struct `row`, beside the given ones: no name of docs can clash."""
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), *(c.alias(k) for k, c in columns.items()))


def unpack(packed: DataFrame) -> DataFrame:
    return packed.select("row.*")
