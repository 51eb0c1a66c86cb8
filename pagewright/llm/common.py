"""What the operators share: tables, a shared folder for written intermediates, checked broadcasts, seeded draws."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

#: A side of at most so many bytes may be broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where it is unset and Spark runs locally."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _local:
        _local[application] = "file://" + tempfile.mkdtemp(prefix="shared-")
    return _local[application]


_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is ``written`` within is deleted at the end: results have to be stored elsewhere before. Without it,
    written tables stay in the shared folder, as a result that has not been read yet may need them."""
    path = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    token = _scratch.set(path)
    try:
        yield
    finally:
        _scratch.reset(token)
        delete(spark, path)


def place(spark: SparkSession, what: str) -> str:
    """A path of its own in the shared folder, or in the scratch folder within ``scratch``."""
    return f"{(_scratch.get() or shared_dir(spark)).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: computed once, lineage cut, safe when an executor is lost."""
    path = place(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _weight(name: str, kind) -> Column:
    """Bytes, about, that a value takes in a broadcast."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(name), F.lit(0)) + 8
    if isinstance(kind, ArrayType):
        return F.greatest(F.size(name), F.lit(0)) * 8 + 8
    return F.lit(8)


def weight(df: DataFrame) -> int:
    """Bytes, about, that df takes in a broadcast."""
    size = sum((_weight(f"`{f.name}`", f.dataType) for f in df.schema), F.lit(16)).cast("long")
    return df.agg(F.sum(size)).first()[0] or 0


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, hinted for broadcast if its bytes, added up, are within the limit; beyond it Spark joins by shuffle.

    df should be cheap to read, a written table, and of numbers, strings, bytes and arrays of numbers.
    """
    return F.broadcast(df) if weight(df) <= limit else df.hint("merge")


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df without the columns an operator is about to add: its own columns take the place of clashing ones."""
    clash = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in clash))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of df has, for columns that an operator adds and drops again."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def draw(id_column: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone, so retried tasks and other engines agree.

    A null id draws as the empty string.
    """
    digest = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(id_column.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def draw_sql(id_column: str, seed: str) -> str:
    """The same draw in DuckDB."""
    return f"(('0x' || substr(md5('{seed}|' || coalesce(CAST({id_column} AS VARCHAR), '')), 1, 8))::UBIGINT / 4294967296.0)"


def text_bytes(column: str) -> Column:
    """Bytes of a text plus one, so that nothing weighs nothing; 1 for a null."""
    return F.coalesce(F.octet_length(F.col(column)), F.lit(0)).cast("long") + 1
