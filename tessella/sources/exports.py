"""Writers. Each writes a folder of part files in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import habits as hb


def _selected(habits: DataFrame, days: DataFrame, start: str, end: str) -> DataFrame:
    """Check-ins of the chosen habits; rows without a chosen habit drop out."""
    return hb.in_range(days, start, end).join(
        habits.select("habit_id", "name", "category"), "habit_id")


def checkins_csv(habits: DataFrame, days: DataFrame, path: str, start: str, end: str) -> None:
    rows = _selected(habits, days, start, end).select(
        F.date_format("date", "yyyy-MM-dd").alias("date"), "name", "category",
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))
    rows.orderBy("date").write.csv(path, header=True)


def checkins_json(habits: DataFrame, days: DataFrame, path: str, start: str, end: str) -> None:
    chosen = _selected(habits, days, start, end).select(
        F.lit("checkin").alias("record"), "habit_id",
        F.date_format("date", "yyyy-MM-dd").alias("date"), "type")
    listed = habits.select(F.lit("habit").alias("record"), "habit_id")
    listed.unionByName(chosen, allowMissingColumns=True).write.json(path)


SECTIONS = ("rules", "recommendations", "structure", "naming", "modules", "statistics")


def report(sections: dict[str, DataFrame], path: str, enabled=SECTIONS) -> list[str]:
    """One folder of JSON lines per enabled section; returns what was written."""
    written = []
    for name in SECTIONS:
        if name in enabled and name in sections:
            sections[name].write.json(f"{path}/{name}")
            written.append(name)
    return written


def append_history(records: DataFrame, path: str) -> None:
    """Analysis records; parameters and results are stored as JSON text."""
    packed = records.withColumns({c: F.to_json(c) for c in ("parameters", "results")})
    packed.write.mode("append").parquet(path)


def upsert_documents(existing: DataFrame, changes: DataFrame) -> DataFrame:
    """One row per path, the latest `updated_at` wins; of equal times a change wins over
    what exists, and the larger row over a smaller one."""
    fields = [c for c in existing.columns if c != "path"]
    both = existing.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    last = both.groupBy("path").agg(F.max(F.struct("updated_at", "_new", F.struct(*fields).alias("r"))).alias("m"))
    return last.select("path", "m.r.*")
