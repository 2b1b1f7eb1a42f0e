"""Helpers that the training-data operators share: table reading, durable
materialisation, and Arrow-batched column mapping."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; only Spark's reader touches the path."""
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` where the
    cluster names one. Where it is unset, a session of one machine (tests) takes
    a temporary folder, and any other has to name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    held = context.getCheckpointDir()
    if not held:
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
        held = context.getCheckpointDir()
    return (named or held).rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the shared folder; it survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_in_loop(df: DataFrame) -> DataFrame:
    """``checkpoint`` for what goes into a next round. A checkpoint keeps the size
    estimate of its plan, and a join's is the product of its sides', so the digits
    of that one number double with each round until they fill the driver. Here
    the rows, their partitioning and order are kept and the estimate is dropped."""
    spark = df.sparkSession
    jvm, session = spark._jvm, spark._jsparkSession
    plan = checkpoint(df)._jdf.queryExecution().analyzed()
    none = jvm.scala.Option.empty()
    bare = jvm.org.apache.spark.sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), False, none, session, none, none)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, bare), spark)


def materialise(df: DataFrame) -> DataFrame:
    """Write as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


#: Bytes of rows that one Arrow batch takes to a Python worker. Texts may be
#: long; a batch, its strings and what is made of them must fit beside others.
BATCH_BYTES = 8 << 20


def give_back() -> None:
    """Return freed memory to the system: workers wait for their next task, and
    what they hold meanwhile is missing elsewhere on the executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


#: Seconds after its last task from which a waiting worker drops its tables.
IDLE_SECONDS = 2.0
_TABLES: list[Callable[[], None]] = []
_WAITING: list[threading.Timer] = []


def drops_when_idle(clear: Callable[[], None]) -> None:
    """Have ``clear`` called in a worker that has waited for IDLE_SECONDS."""
    _TABLES.append(clear)


def _drop_tables() -> None:
    for clear in _TABLES:
        clear()
    give_back()


def _wait(on: bool) -> None:
    """Start or stop the worker's clock."""
    while _WAITING:
        _WAITING.pop().cancel()
    if on and _TABLES:
        timer = threading.Timer(IDLE_SECONDS, _drop_tables)
        timer.daemon = True
        _WAITING.append(timer)
        timer.start()


def map_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` in batches of BATCH_BYTES, a bound that holds for the
    session from then on."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name) != f"{BATCH_BYTES}b":
        conf.set(name, f"{BATCH_BYTES}b")

    def task(batches):
        _wait(False)
        yield from run(batches)
        give_back()
        _wait(True)

    return df.mapInArrow(task, schema)


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` without the columns whose names clash with ``names`` (case ignored)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def unused(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` has none of (case ignored), one for each stem."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def map_values(
    df: DataFrame,
    column: str,
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[[list], Sequence]],
) -> DataFrame:
    """Add ``fields``, computed from one column in Arrow batches.

    ``make()`` runs once per task and returns a function from the batch's list
    of values to one list (or array) per field. Every other column passes
    through untouched; an input column that has the name of a new field is
    replaced by it.
    """
    new = [f.name for f in fields]
    taken = {n.lower() for n in new}
    kept = [f for f in df.schema.fields if f.name.lower() not in taken]
    schema = T.StructType([*kept, *fields])
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in kept]
    at = df.columns.index(column)
    places = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in taken]

    def run(batches):
        fn = make()
        for batch in batches:
            made = fn(batch.column(at).to_pylist())
            arrays = [batch.column(i) for i in places]
            arrays += [pa.array(x, type=kind) for x, kind in zip(made, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *new])

    return map_batches(df, run, schema)
