"""Spark plumbing that the operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K

#: Rows of an Arrow batch: long texts come in batches of a few MB, so a task's memory doesn't hang on 10,000 of them.
ROWS_PER_BATCH = 1000
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that tables of an application lie in, by its id.
_folders: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share; it goes when the application ends.

    Only a session whose executors are the driver's own process (master ``local``) may do without the setting."""
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not top:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "/tmp/checkpoints"
    path = f"{top.rstrip('/')}/tidelog-{uuid.uuid4().hex}"
    _folders.setdefault(context.applicationId, []).append(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def sweep(spark: SparkSession) -> None:
    """Deletes what :func:`written` has left in this application; only once no DataFrame that reads it is needed."""
    for path in _folders.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that :func:`written` gave and that nothing will read any more."""
    for df in tables:
        path = getattr(df, "_tidelog_folder", None)
        mine = _folders.get(df.sparkSession.sparkContext.applicationId, [])
        if path in mine:
            mine.remove(path)
            _delete(df.sparkSession, path)


def in_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches have ``ROWS_PER_BATCH`` rows at the most."""
    spark = df.sparkSession
    now = int(spark.conf.get(_SETTING))
    if not 0 < now <= ROWS_PER_BATCH:
        spark.conf.set(_SETTING, str(ROWS_PER_BATCH))
    return df


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives lost executors and is computed once."""
    path = f"{shared_folder(df.sparkSession)}/table"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tidelog_folder = path.removesuffix("/table")
    return out


def map_text(
    df: DataFrame,
    make: Callable[[], Callable[[np.ndarray, np.ndarray, pa.RecordBatch], Sequence]],
    fields: str,
    keep: Sequence[str] = ("doc_id",),
    text: str = "text",
    extra: Sequence[str] = (),
    chunk: int = K.CHUNK,
) -> DataFrame:
    """``keep`` columns with new columns ``fields`` (a DDL string), computed from whole texts.

    ``make()`` runs once a task and gives ``f(bytes, offsets, rows)``, which returns one array for each new field.
    A null text counts as empty.  New columns replace kept ones of the same name; other columns aren't read.
    """
    new = T._parse_datatype_string(fields)
    names = {f.name for f in new.fields}
    keep = [c for c in keep if c not in names]
    schema = T.StructType([df.schema[c] for c in keep] + list(new.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        f, out = make(), to_arrow_schema(schema)
        for batch in batches:
            column = batch.column(len(keep))
            for a, b, data, offsets in K.chunks(column, chunk):
                rows = batch.slice(a, b - a)
                made = f(data, offsets, rows)
                arrays = [rows.column(i) for i in range(len(keep))]
                arrays += [x if isinstance(x, pa.Array) else pa.array(x) for x in made]
                yield pa.RecordBatch.from_arrays([x.cast(t.type) for x, t in zip(arrays, out)], schema=out)
        K.release()

    return in_batches(df).select(*keep, F.col(text), *extra).mapInArrow(run, schema)


def small_enough(df: DataFrame, most: int) -> bool:
    """Whether ``df`` has ``most`` rows at the most."""
    return df.count() <= most


def join_small(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", most: int = 20_000) -> DataFrame:
    """A join with a side of a few groups, broadcast where its rows prove to be few: hot groups then stay where they lie."""
    right = written(right)
    return left.join(F.broadcast(right) if small_enough(right, most) else right, on, how)


def same_text(text: str = "text"):
    """Tells rows of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def without(docs: DataFrame, gone: DataFrame, key: str = "doc_id", most: int = 500_000) -> DataFrame:
    """``docs`` without the rows whose key and text hash are in ``gone`` (columns key and _same).

    Where these prove to be ``most`` at the most they are broadcast and the texts stay where they lie, else they meet by a
    shuffle.  A null key equals a null key."""
    gone = written(gone.select(F.col(key).alias("_key"), "_same").distinct())
    mark = docs.withColumn("_same", same_text())
    side = F.broadcast(gone) if small_enough(gone, most) else gone
    return mark.alias("d").join(side.alias("g"), F.col(f"d.{key}").eqNullSafe(F.col("g._key")) & (F.col("d._same") == F.col("g._same")), "left_anti").select(*[F.col(f"d.`{c}`") for c in docs.columns])
