"""What the training-data operators share: the shared folder, written tables, Arrow helpers."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest side, in rows, that an operator broadcasts after having counted it.
BROADCAST_ROWS = 200_000

#: The same for a single column of numbers (about 24 bytes a row).
BROADCAST_IDS = 2_000_000

_written: dict[tuple[str, str], list[str]] = {}
_owner = ["queries"]


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which the whole cluster sees.

    Where none is set, a temporary folder of this machine, but only if Spark runs on this
    machine alone: executors elsewhere would each write to their own disk, so that raises.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="weftgraph-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    It cuts the lineage so that an expensive pass runs once, and it survives lost
    executors: the files are in the shared folder, not in an executor's memory. The file
    is deleted by :func:`release` for its owner.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftgraph/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.setdefault((spark.sparkContext.applicationId, _owner[-1]), []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, owner: str = "queries") -> None:
    """Deletes every table that :func:`written` made for an owner in this application."""
    jvm = spark._jvm
    for path in _written.pop((spark.sparkContext.applicationId, owner), []):
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def owned(owner: str):
    """Tables written within belong to ``owner``."""
    _owner.append(owner)
    try:
        yield
    finally:
        _owner.pop()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checked_broadcast(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` with a broadcast hint if it has at most ``limit`` rows by count, else as it is (a shuffled join)."""
    return F.broadcast(small) if small.limit(limit + 1).count() <= limit else small


#: Bytes of a record batch that a function sees at once, and rows; bound a worker's Python objects.
SLICE_BYTES = 4 << 20
SLICE_ROWS = 1024

_state: dict = {}


def worker_state(key, make: Callable):
    """What a worker keeps between batches (a model, a cache): only that of the operator that runs in it now."""
    if key not in _state:
        _state.clear()
        _state[key] = make()
    return _state[key]


def task_over() -> None:
    """Empties caches at the end of a task, since idle workers stay alive beside the busy ones."""
    for state in _state.values():
        if hasattr(state, "trim"):
            state.trim()


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded size (or of one longer row)."""
    for batch in batches:
        n = batch.num_rows
        step = max(1, min(SLICE_ROWS, n * SLICE_BYTES // max(1, batch.nbytes)))
        for at in range(0, n, step):
            yield batch.slice(at, step)
    task_over()


def map_rows(df: DataFrame, fold: Callable[[pa.RecordBatch], dict[str, list]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` of a function that turns one record batch into columns; batches are cut to a bounded size first."""
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    arrow = arrow_schema(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = fold(batch)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, wanted)


def filter_rows(df: DataFrame, text_col: str, keep: Callable[[list], list[bool]]) -> DataFrame:
    """The rows of ``df`` with all their columns, whatever their names, for whose text ``keep`` says so; one narrow pass.

    ``keep`` sees null texts as None and is given batches of at most ``SLICE_ROWS`` rows;
    repeated rows and null ids are rows like others; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(keep(batch.column(batch.schema.get_field_index(text_col)).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "float": pa.float32()}


def _arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return arrow_struct(kind)
    return _ARROW[kind.simpleString()]


def arrow_struct(kind: T.StructType) -> pa.DataType:
    return pa.struct([pa.field(f.name, _arrow_type(f.dataType)) for f in kind])


def arrow_schema(kind: T.StructType) -> pa.Schema:
    return pa.schema([pa.field(f.name, _arrow_type(f.dataType)) for f in kind])


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named input columns under fixed names, so that other columns, whatever their names, cannot clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])
