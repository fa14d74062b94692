"""What the training-data operators share: shared storage, batches, workers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A folder of our own is made only where the session names none, and only in
    local mode; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return str(own.get()).rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="leafmill-"))
    return str(spark.sparkContext._jsc.sc().getCheckpointDir().get()).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; ``clean`` removes what was made."""
    path = f"{shared_dir(spark)}/leafmill/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


#: Rows that a task of a narrow table takes at least, and the tasks that any table has.
ROWS_A_TASK, LEAST_TASKS = 250_000, 8


def saved(df: DataFrame, name: str, compression: str = "snappy", rows: int | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    This cuts the lineage: a lost executor costs a reread, never a rerun of
    what came before.  ``rows`` is a bound of the rows of a narrow table: where
    a shuffle would leave many small files, it is written in as many as the
    rows call for.
    """
    path = new_path(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(LEAST_TASKS, -(-rows // ROWS_A_TASK)))
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean() -> None:
    """Delete every table that ``saved`` and ``new_path`` made."""
    while _made:
        spark, path = _made.pop()
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session may be gone already
            return


atexit.register(clean)


def workers_see_us(spark: SparkSession) -> None:
    """Put this repository on the Python workers' path.

    A cluster has the package installed; a local session started from another
    folder has not.
    """
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)


#: Spark's bound of a record batch, and ours: a batch of texts or sets is held several times, off the heap and in Python.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the record batches by BATCH_BYTES, in a session that names no bound of its own.

    A longer row is a batch of its own.  Spark looks when a query runs, so the
    bound stays set.
    """
    if BATCH_KEY not in spark.conf.getAll:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function that each task makes once.

    ``make`` runs on the executor and returns what turns one record batch into
    record batches.
    """
    workers_see_us(df.sparkSession)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            if batch.num_rows:
                step = step or make()
                yield from step(batch)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Consecutive slices whose ``column`` holds about ``most`` bytes each.

    A row is never cut: a longer text is a slice of its own.
    """
    sizes = batch.column(column).nbytes
    if sizes <= most:
        yield batch
        return
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores before it as make it new among ``columns``."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def first_ids(rows: DataFrame, seed: int, most: int) -> DataFrame:
    """``doc_id``: the first ``most`` different ids of ``rows`` by a hash of the id and ``seed``.

    Each task sends on its own first ids only, so nothing else is shuffled,
    whatever the input.
    """

    names = ["place", "doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.table({n: pa.array([], pa.int64()) for n in names})
        for batch in batches:
            both = pa.concat_tables([held, pa.table({n: batch.column(n) for n in names})])
            held = both.group_by(names).aggregate([]).sort_by([(n, "ascending") for n in names]).slice(0, most).select(names)
        yield from held.to_batches()

    workers_see_us(rows.sparkSession)
    keyed = rows.where("doc_id is not null").select(F.xxhash64("doc_id", F.lit(seed)).alias("place"), "doc_id")
    few = keyed.mapInArrow(run, "place long, doc_id long")
    return few.distinct().orderBy("place", "doc_id").limit(most).select("doc_id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
