"""Session and Arrow plumbing of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.sources.scratch import shared_dir

from . import kernels as K


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have, whatever their case."""
    known = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in known:
            name += "_"
        known.add(name)
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """A column by its exact name, dots and backquotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: Has Spark remove the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Written:
    """Tables written to the shared folder: they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/docframe-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table; the shuffle files behind it go with the end of the write, as nothing reads them again."""
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Remove a table that no later step reads."""
        jvm = self.spark._jvm
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def by_slices(df: DataFrame, text: str, work: Callable[..., pa.RecordBatch | None], schema: str, limit: int = K.SLICE_BYTES) -> DataFrame:
    """Apply ``work(rows, bytes, offsets)`` to runs of rows of about ``limit`` bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, off in K.slices(batch.column(text), limit):
                out = work(batch.slice(at, to - at), data, off)
                if out is not None:
                    yield out

    return mapped(df, run, schema)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow whose workers find this package even where it is not installed.

    Batches are of about ``BATCH_BYTES`` at most from here on in the session, as rows hold whole texts.
    """
    if int(df.sparkSession.conf.get(_BATCH).removesuffix("b")) > BATCH_BYTES:
        df.sparkSession.conf.set(_BATCH, f"{BATCH_BYTES}b")
    here = str(Path(__file__).resolve().parents[2])
    environment = df.sparkSession.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(":")
    if here not in known:
        environment["PYTHONPATH"] = ":".join([here, *filter(None, known)])
    return df.mapInArrow(run, schema)


def list_column(values: pa.Array | np.ndarray, ranges: np.ndarray) -> pa.Array:
    """A list column from flat values and n + 1 offsets."""
    return pa.ListArray.from_arrays(pa.array(ranges, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


def replace_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    at = batch.schema.get_field_index(name)
    columns = [values if i == at else c for i, c in enumerate(batch.columns)]
    return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
