"""Versions of many tables, published together or not at all.

Tables are written to a folder of the attempt's own and audited as they were written. What an audit finds refuses the
version. A manifest then names the attempt's folder and gives each table's schema, rows and digest; writing it is the commit,
so before it nothing of the version can be read, and after it all of it. A version is sealed: publishing equal content
again is accepted and keeps what is there, unlike content is refused.

Defined cases: a table without rows is published as one; an attempt that fails or is killed leaves files that no manifest
names, and the versions before it stay as they are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewell.sources import files
from tracewell.sources.files import Refused

Audit = Callable[[dict[str, DataFrame]], DataFrame]
__all__ = ["AuditFailed", "Refused", "foreign_key", "no_nulls", "publish", "read", "tables", "unique_key", "verify"]


class AuditFailed(ValueError):
    """An audit found rows; `found` has how many, by audit."""

    def __init__(self, found: dict[str, int]):
        super().__init__("; ".join(f"{name}: {n} rows" for name, n in found.items()))
        self.found = found


def unique_key(table: str, *key: str) -> tuple[str, Audit]:
    return f"{table}: unique {', '.join(key)}", lambda t: t[table].groupBy(*key).count().where("count > 1")


def no_nulls(table: str, *columns: str) -> tuple[str, Audit]:
    return f"{table}: no nulls in {', '.join(columns)}", lambda t: t[table].where(" OR ".join(f"`{c}` IS NULL" for c in columns))


def foreign_key(child: str, column: str, parent: str, key: str) -> tuple[str, Audit]:
    """Values of the child's column, nulls left out, that no row of the parent has."""

    def audit(t: dict[str, DataFrame]) -> DataFrame:
        asked = t[child].select(F.col(column).alias("_key")).where("_key IS NOT NULL").distinct()
        return asked.join(t[parent].select(F.col(key).alias("_key")), "_key", "left_anti")

    return f"{child}.{column} in {parent}.{key}", audit


def digest(columns: list[str]) -> Column:
    """Sum of the rows' hashes, as text: equal for equal multisets of rows, whatever their order and partitions."""
    row = F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(columns))), {"ignoreNullFields": "false"})
    return F.coalesce(F.sum(F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("decimal(38, 0)")), F.lit(0).cast("decimal(38, 0)")).cast("string")


def _described(table: DataFrame) -> dict:
    row = table.agg(F.count(F.lit(1)).alias("rows"), digest(table.columns).alias("digest")).first()
    return {"rows": row["rows"], "digest": row["digest"], "schema": json.loads(table.schema.json())}


def _place(folder: str, version: str) -> str:
    return f"{folder}/manifests/{version}.json"


def publish(spark: SparkSession, folder: str, version: str, made: dict[str, DataFrame], audits: list[tuple[str, Audit]]) -> bool:
    """True if the version is new, False if it was there with equal content. Raises AuditFailed or Refused."""
    attempt = f"{version}-{uuid.uuid4().hex}"
    for name, table in made.items():
        table.write.parquet(f"{folder}/attempts/{attempt}/{name}")
    staged = {name: spark.read.schema(table.schema).parquet(f"{folder}/attempts/{attempt}/{name}") for name, table in made.items()}
    found = {name: n for name, audit in audits if (n := audit(staged).count())}
    if found:
        files.delete(spark, f"{folder}/attempts/{attempt}")
        raise AuditFailed(found)
    content = {name: _described(table) for name, table in staged.items()}
    place = _place(folder, version)
    try:
        if not files.exists(spark, place):
            try:
                return files.seal_json(spark, place, {"version": version, "attempt": attempt, "tables": content})
            except Refused:  # another attempt came first
                pass
        if json.loads(files.read_text(spark, place))["tables"] != content:
            raise Refused(f"version {version} is published with other content")
    except BaseException:
        files.delete(spark, f"{folder}/attempts/{attempt}")
        raise
    files.delete(spark, f"{folder}/attempts/{attempt}")
    return False


def versions(spark: SparkSession, folder: str) -> list[str]:
    return [n.removesuffix(".json") for n in files.names(spark, f"{folder}/manifests") if n.endswith(".json")]


def _manifest(spark: SparkSession, folder: str, version: str) -> dict:
    return json.loads(files.read_text(spark, _place(folder, version)))


def _table(spark: SparkSession, folder: str, manifest: dict, name: str) -> DataFrame:
    return spark.read.schema(StructType.fromJson(manifest["tables"][name]["schema"])).parquet(f"{folder}/attempts/{manifest['attempt']}/{name}")


def tables(spark: SparkSession, folder: str, version: str) -> dict[str, DataFrame]:
    manifest = _manifest(spark, folder, version)
    return {name: _table(spark, folder, manifest, name) for name in manifest["tables"]}


def read(spark: SparkSession, folder: str, version: str, name: str) -> DataFrame:
    return _table(spark, folder, _manifest(spark, folder, version), name)


def verify(spark: SparkSession, folder: str, version: str) -> DataFrame:
    """table_name, rows, found, status of every table of a version, read again: OK, ROW_MISMATCH, CONTENT_MISMATCH or MISSING_TABLE."""
    manifest, out = _manifest(spark, folder, version), None
    for name, told in manifest["tables"].items():
        if not files.exists(spark, f"{folder}/attempts/{manifest['attempt']}/{name}"):
            row = spark.range(1).select(F.lit(name).alias("table_name"), F.lit(told["rows"]).cast("long").alias("rows"), F.lit(None).cast("long").alias("found"), F.lit("MISSING_TABLE").alias("status"))
        else:
            table = _table(spark, folder, manifest, name)
            seen = table.agg(F.count(F.lit(1)).alias("found"), digest(table.columns).alias("digest"))
            status = F.when(F.col("found") != told["rows"], "ROW_MISMATCH").when(F.col("digest") != told["digest"], "CONTENT_MISMATCH").otherwise("OK")
            row = seen.select(F.lit(name).alias("table_name"), F.lit(told["rows"]).cast("long").alias("rows"), "found", status.alias("status"))
        out = row if out is None else out.unionByName(row)
    return out
