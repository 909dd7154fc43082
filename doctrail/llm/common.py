"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch, and bytes of a batch that is worked on at once: whole texts travel in them.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of this application.

    It lies in the one of ``spark.checkpoint.dir``; only where that is unset
    does the warehouse folder, which a cluster shares too, serve instead.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(shared or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small table with a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage of a larger table: written, compressed, to the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Files of one table, and rows of one file, that a row's number has room for: 2 ** 23 and 2 ** 40.
ROW_BITS = 40


class Rows:
    """The rows of a table with a number of their own, the same in every scan.

    A number is the place of the row's file among the table's files, by path,
    and the row's place in the file. Neither depends on how a scan is split, so
    numbers from different jobs, sessions and sets of executors are the same.
    A table that is no plain scan of files is written to the shared folder
    first. Only paths reach the driver, and go back as a broadcast.
    """

    def __init__(self, docs: DataFrame):
        self.docs = docs if self._of_files(docs) else stored(docs)
        found = self.docs.select(self.docs.metadataColumn("_metadata")["file_path"].alias("file")).distinct().collect()
        files = sorted(x.file for x in found)
        self.files = docs.sparkSession.createDataFrame([(x, k << ROW_BITS) for k, x in enumerate(files)], "`its file` string, base long")

    @staticmethod
    def _of_files(docs: DataFrame) -> bool:
        plan = docs._jdf.queryExecution().analyzed()
        while plan.nodeName() in ("Project", "SubqueryAlias") and plan.children().size() == 1:
            plan = plan.children().head()
        return plan.children().isEmpty() and plan.nodeName().startswith("LogicalRelation")

    def _numbered(self, *columns: F.Column) -> DataFrame:
        place = self.docs.metadataColumn("_metadata")
        rows = self.docs.select(*columns, place["file_path"].alias("its file"), place["row_index"].alias("its place"))
        return rows.join(F.broadcast(self.files), "its file")

    def numbered(self, *columns: str) -> DataFrame:
        """The named columns and rid."""
        return self._numbered(*[self.docs[x] for x in columns]).select(*columns, (F.col("base") + F.col("its place")).alias("rid"))

    def without(self, gone: DataFrame, most: int = 500_000) -> DataFrame:
        """The table without the rows whose number is in ``gone``, a stored table of the one long column rid.

        Up to ``most`` numbers are broadcast, so that texts stay where they are;
        more are joined by a shuffle, to the same result. The row travels as one
        struct, so no column of it can clash with the number.
        """
        rows = self._numbered(F.struct(*[self.docs[x] for x in self.docs.columns]).alias("row")).select("row", (F.col("base") + F.col("its place")).alias("rid"))
        return rows.join(F.broadcast(gone) if gone.count() <= most else gone, "rid", "left_anti").select("row.*")


def small_batches(spark: SparkSession) -> None:
    """Bound what an Arrow batch of whole texts holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def pieces(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches in slices of about so many bytes at most, a row at least."""
    for batch in batches:
        step = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
        if step >= batch.num_rows:
            yield batch
        else:
            for k in range(0, batch.num_rows, step):
                yield batch.slice(k, step)


def arrow_map(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(lambda batches: work(pieces(batches)), schema)


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def ascii_lower(text) -> F.Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list]]:
    """Runs of rows alike in their first ``keys`` columns, of a stream sorted by them: (key, the other columns).

    Rows are cut by comparing neighbours in whole batches; only a run that
    reaches over the end of a batch is held back.
    """
    import numpy as np

    held: list[list] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
        if held:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        change = np.zeros(len(columns[0]), bool)
        change[0] = True
        for x in columns[:keys]:
            change[1:] |= x[1:] != x[:-1]
        cuts = [*np.flatnonzero(change).tolist(), len(columns[0])]
        for a, b in zip(cuts[:-2], cuts[1:-1], strict=True):
            yield tuple(x[a] for x in columns[:keys]), [x[a:b] for x in columns[keys:]]
        held = [x[cuts[-2] :] for x in columns]
    if held:
        yield tuple(x[0] for x in held[:keys]), held[keys:]
