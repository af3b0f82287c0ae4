"""The vault: which original a token stands for in a thread, until when. Tables of rows, not a store of its own."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.shared import join_null_safe, path_exists

KEYS = ["tenant_id", "case_id", "thread_id", "token"]
CASE = KEYS[:3]
DEFAULT_TTL = 86_400
ROW_SQL = "tenant_id string, case_id string, thread_id string, token string, original string, expires_at long, seq long, deleted boolean"


def expiry(now: int | Column, ttl: Column | int | None) -> Column:
    """When a row written now expires; null for no or no positive time to live."""
    ttl = ttl if isinstance(ttl, Column) else F.lit(ttl)
    at = now if isinstance(now, Column) else F.lit(now)
    return F.when(ttl > 0, at + ttl).cast("long")


def latest(log: DataFrame) -> DataFrame:
    """One row for each token of a thread from a log of puts: the last put wins.

    The log has seq, its order (of any type that sorts), and if it has deletions a column deleted: a forgotten
    thread's earlier puts go. A null tenant, case or thread is one like others.
    """
    puts = log
    if "deleted" in log.columns:
        gone = log.where("deleted").groupBy(*CASE).agg(F.max("seq").alias("_gone"))
        puts = join_null_safe(log.where("not deleted"), gone, CASE, "left").where("_gone is null or seq > _gone").drop("_gone")
    last = puts.groupBy(*KEYS).agg(F.max(F.struct("seq", "original", "expires_at")).alias("last"))
    return last.select(*KEYS, "last.original", "last.expires_at")


def purge(vault: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, one row with the count of those that expired)."""
    stays = F.col("expires_at").isNull() | (F.col("expires_at") > now)
    return vault.where(stays), vault.agg(F.count_if(~stays).alias("purged"))


def forget(vault: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of other threads, the count of rows by forgotten thread)."""
    named = cases.select(*CASE).distinct()
    return join_null_safe(vault, named, CASE, "left_anti"), join_null_safe(vault, named, CASE, "left_semi").groupBy(*CASE).agg(F.count(F.lit(1)).alias("forgotten"))


def mapping(vault: DataFrame, now: int | None = None) -> DataFrame:
    """(tenant_id, case_id, thread_id, mapping): tokens to originals of each thread, without expired ones."""
    rows = vault if now is None else purge(vault, now)[0]
    return rows.groupBy(*CASE).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "original")))).alias("mapping"))


class VaultTable:
    """A vault as an append-only Parquet log: puts and tombstones with sequence numbers, compacted on demand."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def log(self) -> DataFrame:
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], ROW_SQL)
        return self.spark.read.schema(ROW_SQL).parquet(f"{self.path}/*")

    def _append(self, rows: DataFrame) -> None:
        rows.selectExpr(*[f"cast({n} as {t}) as {n}" for n, t in (c.rsplit(" ", 1) for c in ROW_SQL.split(", "))]).write.parquet(f"{self.path}/part-{uuid.uuid4().hex}")

    def _next(self) -> int:
        return (self.log().agg(F.max("seq")).first()[0] or 0) + 1

    def put(self, rows: DataFrame, now: int, ttl: int | None = DEFAULT_TTL) -> None:
        """Write rows (tenant_id, case_id, thread_id, token, original, order); the greatest order of a token wins."""
        base = self._next()
        self._append(rows.withColumn("expires_at", expiry(now, ttl)).withColumn("seq", F.col("order") + base).withColumn("deleted", F.lit(False)))

    def append(self, rows: DataFrame) -> None:
        """Write rows of another vault (KEYS, original, expires_at): they win over what was there before."""
        self._append(rows.withColumn("seq", F.lit(self._next())).withColumn("deleted", F.lit(False)))

    def get(self, now: int) -> DataFrame:
        return purge(latest(self.log()), now)[0]

    def forget(self, tenant_id: str | None, case_id: str | None, thread_id: str | None) -> int:
        """Hide a thread's rows; how many there were."""
        mine = latest(self.log()).where(F.col("tenant_id").eqNullSafe(tenant_id) & F.col("case_id").eqNullSafe(case_id) & F.col("thread_id").eqNullSafe(thread_id))
        n = mine.count()
        self._append(self.spark.createDataFrame([(tenant_id, case_id, thread_id, None, None, None, self._next(), True)], ROW_SQL))
        return n

    def compact(self, target: str, now: int) -> VaultTable:
        """A new table with what is left, all expired and forgotten rows gone."""
        if re.sub(r"/+$", "", target) == self.path:
            raise ValueError("compact to another path")
        other = VaultTable(self.spark, target)
        other._append(self.get(now).withColumn("seq", F.lit(1)).withColumn("deleted", F.lit(False)))
        return other
