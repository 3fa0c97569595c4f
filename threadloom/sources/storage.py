"""Scratch tables in the folder that driver and executors share, and columns that are computed once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.errors import ConfigurationError

_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir, as a full URI.

    Where that setting is unset, a local master takes a folder of this process;
    on a cluster, whose executors do not see such a folder, this raises.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or getattr(sc, "_threadloom_dir", None)
    if not found and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ConfigurationError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found:
        found = sc._threadloom_dir = "file://" + tempfile.mkdtemp(prefix="threadloom-")
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    full = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/threadloom/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that materialize() writes inside are deleted at the end; what is read from them must be used before."""
    paths: list[str] = []
    token = _SCRATCH.set(paths)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in paths:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage: what follows survives a lost executor without
    recomputing what came before, and several readers share one computation.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if (paths := _SCRATCH.get()) is not None:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns, each computed once for a row however often it is used later.

    Projections over one another are merged by substitution, which multiplies
    large expressions; an explode of one struct between them stops that.
    """
    kept = [c for c in df.columns if c not in columns]
    once = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("__settled")
    return df.select(*kept, once).select(*kept, *[F.col(f"__settled.{n}").alias(n) for n in columns])
