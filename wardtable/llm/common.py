"""What the operators share: reading tables, the shared folder, columns that may clash."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of all word-based operators: runs of anything but space and \t to \r, as bytes.split() finds them.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many further underscores as it takes to differ from all columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Folders made for local applications that name none.
_OWN_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; one fresh local folder for each application in local mode."""
    conf = spark.sparkContext.getConf()
    named = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
    own = spark.sparkContext.applicationId
    if own not in _OWN_ROOTS:
        _OWN_ROOTS[own] = "file://" + tempfile.mkdtemp(prefix="wardtable-")
    return _OWN_ROOTS[own]


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a new table in the shared folder and read from there.

    Cuts the lineage and survives lost executors. Rows are computed once, however often they are read.
    """
    path = f"{shared_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Texts are long: where the session has the default of 10,000 rows for each batch that goes to Python, 1,000 are sent."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_text(
    df: DataFrame, text: str, schema: str, work: Callable[[], Callable[[list[str]], list[tuple]]], keep: list[str]
) -> DataFrame:
    """``keep`` columns and what ``work()(texts)`` returns for each row, a null text being empty.

    ``work`` is called once per task; texts come in small slices, so that memory follows
    the longest texts and not the number of rows.
    """
    small_batches(df.sparkSession)
    fields = df.select(*[col(c) for c in keep]).schema
    out = _add(fields, schema)
    arrow = _arrow_schema(out)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = work()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = f([t or "" for t in part.column(n).to_pylist()])
                made = [
                    pa.array(list(values), type=arrow.field(n + i).type)
                    for i, values in enumerate(zip(*rows, strict=True))
                ]
                kept = [part.column(i).cast(arrow.field(i).type) for i in range(n)]
                yield pa.RecordBatch.from_arrays(kept + made, schema=arrow)

    kept = df.select(*[col(c) for c in keep])
    return df.select(*[col(c) for c in keep], col(text).alias(free_name(kept, "_text"))).mapInArrow(run, out)


def map_rows(
    df: DataFrame, inputs: list[Column], schema: str, work: Callable[[], Callable[..., list[tuple]]], keep: list[str]
) -> DataFrame:
    """As ``map_text`` with several inputs: ``keep`` columns and what ``work()(*lists)`` returns; nulls come as they are."""
    small_batches(df.sparkSession)
    kept = df.select(*[col(c) for c in keep])
    out = _add(kept.schema, schema)
    arrow = _arrow_schema(out)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = work()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = f(*[part.column(i).to_pylist() for i in range(n, part.num_columns)])
                made = [pa.array(list(values), type=arrow.field(n + i).type) for i, values in enumerate(zip(*rows, strict=True))]
                held = [part.column(i).cast(arrow.field(i).type) for i in range(n)]
                yield pa.RecordBatch.from_arrays(held + made, schema=arrow)

    named = [c.alias(free_name(kept, f"_in{i}")) for i, c in enumerate(inputs)]
    return df.select(*[col(c) for c in keep], *named).mapInArrow(run, out)


def _add(fields, schema: str):
    from pyspark.sql.types import StructType

    return StructType([*fields.fields, *StructType.fromDDL(schema).fields])


def _arrow_schema(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
