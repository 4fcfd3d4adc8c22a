"""Shared pieces: column choice, Arrow passes, units of text that tokenise alone, global positions."""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.session import materialise

LEFT_OF_A_SPACE = re.compile(r"(?<=\S) (?=\S)")
TWO_SPACES = re.compile(r"\s\s")
SLICE_BYTES = 4 << 20  # of a batch that a function sees at once; a single row may be larger


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(docs: DataFrame, key: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    """Only the columns an operator needs: the key as long, the text with null as empty, and ``more``."""
    return docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias(text),
                       *[F.col(c) for c in more])


def kept_by_worker(name: str, make: Callable):
    """An object made once for each Python worker process and shared by its tasks (tables, bounded caches).

    Functions reach the workers by value, so their modules' globals end with a task; this holder does not.
    """
    holder = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


def arrow_pass(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema) -> DataFrame:
    """One pass over Arrow batches; ``fn`` maps a batch to a batch.

    A batch of long texts is handed over in slices, so that a worker holds one batch and the objects of one slice.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1))
            for at in range(0, batch.num_rows, rows):
                out = fn(batch.slice(at, rows))
                if out is not None and out.num_rows:
                    yield out
    return df.mapInArrow(run, schema)


def units(text: str) -> tuple[str, list[str]]:
    """A text cut before spaces: its first part, and the parts that follow a space (the space is left out).

    A single space between two non-space characters always opens a new pre-token of a byte-level tokenizer, so the
    parts, each with its space, tokenise to what the whole does.  Without two neighbouring white-space characters
    every space is such a cut or stands at an end.
    """
    parts = LEFT_OF_A_SPACE.split(text) if TWO_SPACES.search(text) else text.split(" ")
    return parts[0], parts[1:]


def positions(df: DataFrame, order: Sequence[Column], name: str, label: str) -> DataFrame:
    """Rows numbered from 0 in ``order`` without sorting them in one task.

    The rows are written in ranges of the order; each range is numbered on its own and shifted by the
    sizes of the ranges before it.  Only one row per range meets in one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), label)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return (ranged.withColumn(name, inside.cast("long")).join(offsets, "_part")
            .withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before"))
