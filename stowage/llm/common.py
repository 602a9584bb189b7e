"""What the operators of this subpackage share: reading, scratch space, document keys and worker-side state."""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FALLBACK_DIR = "file:///tmp/checkpoints"  # of a single machine alone
BATCH_BYTES = "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a local session has one of its own where that is unset.

    A cluster without the setting has no such folder, which is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or FALLBACK_DIR).rstrip("/")


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder and what is in it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of fewer bytes from here on, as texts may be long; a bound that someone has set stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "64m"):  # as Spark has it
        spark.conf.set(name, BATCH_BYTES)


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo ``n``; null where the column is null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def document_key(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """Columns that tell documents apart even when ids are null or repeat with other texts.

    Rows equal in both id and text share a key; that is harmless, as they share every result too.
    """
    return [F.col(id_col).alias("_key_id"), F.xxhash64(F.col(text_col)).alias("_key_text")]


def whole_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(_row, _text): each row's other columns as a struct beside its text, for operators that pass the id through."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns if c != text_col]).alias("_row"), F.col(text_col).cast("string").alias("_text"))


def unpacked(rows: DataFrame, row_col: str, rows_text: str, like: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of ``like`` from a struct of all but the text, and the text."""
    text = F.col(rows_text).cast("string")
    return rows.select(*[text.alias(c) if c == text_col else F.col(row_col).getField(c).alias(c) for c in like.columns])


def same_document(a: DataFrame, b: DataFrame) -> Column:
    return a["_key_id"].eqNullSafe(b["_key_id"]) & (a["_key_text"] == b["_key_text"])


def _held(operator: str) -> dict:
    """What a Python worker process keeps for an operator across tasks; what it kept for others is let go."""
    holder = sys.modules.setdefault("_stowage_worker_state", types.ModuleType("_stowage_worker_state"))
    if getattr(holder, "operator", None) != operator:
        holder.operator, holder.state = operator, {}
    return holder.state


def starts(operator: str) -> None:
    """An operator without state of its own begins in this worker process."""
    _held(operator)


def worker_state(operator: str, name: str, key: object, make: Callable[[], object]) -> object:
    """A value kept in a worker process for an operator's tasks; made on first use and whenever its key changes."""
    state = _held(operator)
    if name not in state or state[name][0] != key:
        state.pop(name, None)
        state[name] = (key, make())
    return state[name][1]


def slices(batches: Iterator, rows: int = 1024) -> Iterator:
    """Arrow batches cut to at most ``rows`` rows, so that what a step builds at once stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
