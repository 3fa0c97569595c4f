"""A store of provenance records as a table: upsert, lookup, filtered scans in order, deletion of a run.

Rows: application_id, tenant_id, run_id, record_type, record_id, timestamp,
payload (JSON text). The first five name a record; application, tenant and run
are its scope.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.errors import ConfigurationError

SCOPE = ["application_id", "tenant_id", "run_id"]
KEY = [*SCOPE, "record_type", "record_id"]
RECORD = [*KEY, "timestamp", "payload"]


@dataclass(frozen=True)
class Filter:
    """Which records a scan gives: of one tenant, and of one run and some types if named; `limit` of them from `offset` on."""

    application_id: str
    tenant_id: str
    run_id: str | None = None
    record_types: Sequence[str] | None = None
    limit: int | None = None
    offset: int = 0

    def __post_init__(self):
        if self.offset < 0 or (self.limit is not None and self.limit < 0):
            raise ConfigurationError("limit and offset must not be negative")


def put(records: DataFrame, new: DataFrame) -> DataFrame:
    """The records with new ones, which replace those of the same key; of new ones with one key the latest stays."""
    both = records.select(*RECORD, F.lit(0).alias("late")).unionByName(new.select(*RECORD, F.lit(1).alias("late")))
    newest = Window.partitionBy(*KEY).orderBy(F.desc("late"), F.desc("timestamp"), F.desc("payload"))
    return both.withColumn("nth", F.row_number().over(newest)).filter("nth = 1").select(*RECORD)


def get(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """The record of each wanted (scope, record_id), if there is one; raises at run time if its types make it ambiguous."""
    keys = wanted.select(*SCOPE, "record_id").distinct()
    found = records.join(keys, [*SCOPE, "record_id"], "left_semi").groupBy(*SCOPE, "record_id").agg(F.count("*").alias("n"), F.min(F.struct("record_type", "timestamp", "payload")).alias("r"))
    one = F.when(F.col("n") == 1, F.col("r.record_type")).otherwise(F.raise_error(F.concat(F.lit("record id is ambiguous: "), F.col("record_id"))).cast("string"))
    return found.select(*SCOPE, one.alias("record_type"), "record_id", "r.timestamp", "r.payload")


def scan(records: DataFrame, where: Filter) -> DataFrame:
    """The records that a filter names, by timestamp, sequence in the payload (none first), and id."""
    found = records.filter((F.col("application_id") == where.application_id) & (F.col("tenant_id") == where.tenant_id))
    if where.run_id is not None:
        found = found.filter(F.col("run_id") == where.run_id)
    if where.record_types is not None:
        found = found.filter(F.col("record_type").isin(*where.record_types))
    field = lambda name: F.get_json_object("payload", f"$.{name}")
    found = found.orderBy("timestamp", F.coalesce(field("sequence").cast("int"), F.lit(-1)), field("id"), *KEY)
    found = found.offset(where.offset) if where.offset else found
    return found if where.limit is None else found.limit(where.limit)


def delete_run(records: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records without those of the runs, and rows (scope, removed) of how many each lost."""
    keys = runs.select(*SCOPE).distinct()
    gone = records.join(keys, SCOPE, "left_semi").groupBy(*SCOPE).agg(F.count("*").alias("removed"))
    return records.join(keys, SCOPE, "left_anti"), gone
