"""Queries that write files: how many, by how many tasks, and what is read back."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from riskframe.scale import ensure_checkpoint_dir
from riskframe.sources import tables
from riskframe.workloads import storage


def new_files(spark, before: set) -> set:
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return {p for p in Path(folder).rglob("*") if p.is_file()} - before


def test_search_pages_are_not_a_file_each(spark, tmp_path):
    ensure_checkpoint_dir(spark)
    spark.range(5_000).select(F.col("id").alias("event_id"), F.concat(F.lit("kind-"), F.col("id") % 3).alias("event_type")).write.parquet(f"{tmp_path}/events.parquet")
    before = new_files(spark, set())
    rows = storage.search_pages(spark, str(tmp_path)).collect()
    assert sorted((r.key, r.component) for r in rows) == sorted((f"EV-{k}", f"kind-{k % 3}") for k in range(5_000))
    assert 0 < len([p for p in new_files(spark, before) if p.name.startswith("part-")]) < 50  # of 100 pages


def test_reports_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(300).coalesce(1).select(F.col("id").alias("change_id"), F.concat(F.lit("# "), "id").alias("report"))
    tables.write_reports(rows, str(tmp_path / "reports"))
    files = list((tmp_path / "reports").glob("change_id=*/part-*.txt"))
    assert {f.parent.name: f.read_text() for f in files} == {f"change_id={k}": f"# {k}\n" for k in range(300)}
    assert len(files) == 300 and len({f.name.split("-")[1] for f in files}) >= 8
