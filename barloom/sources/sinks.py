"""Writing results, run records and snapshots."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import tempfile
import time
import traceback
import uuid
from collections.abc import Callable
from datetime import datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..plans import catalog


def write_table(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small result as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(value: Any, path: str) -> None:
    file = Path(path)
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(json.dumps(value, indent=2, default=str, ensure_ascii=False), encoding="utf-8")


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one of spark.checkpoint.dir; a temporary one only where that setting is absent (tests)."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="barloom-"))
    return f"{spark.sparkContext.getCheckpointDir()}/stage-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage: df written to a scratch folder, and read again."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settings_hash(settings: Any) -> str:
    return hashlib.sha256(json.dumps(dataclasses.asdict(settings), sort_keys=True, default=str).encode()).hexdigest()[:16]


def formulas_hash() -> str:
    """Fingerprint of all factor formulas: tables cached under it are stale once a formula changes."""
    tables = {k: v for k, v in vars(catalog).items() if k.isupper() and isinstance(v, dict | tuple)}
    return hashlib.sha256(json.dumps(tables, sort_keys=True, default=str).encode()).hexdigest()[:16]


def fingerprint(*parts: Any) -> str:
    """Of a table: the formulas and whatever else its rows follow from."""
    return hashlib.sha256(json.dumps([formulas_hash(), *parts], sort_keys=True, default=str).encode()).hexdigest()[:32]


def run_id(now: datetime | None = None) -> str:
    return (now or datetime.now()).strftime("%Y%m%d_%H%M%S")


def tracked(what: str, settings: Any, folder: str, work: Callable[[], Any]) -> Any:
    """Run the work and write a record of it, of failed runs too; the error goes on."""
    began, record = time.time(), {"run": what, "settings_hash": settings_hash(settings), "settings": dataclasses.asdict(settings), "formulas_hash": formulas_hash(), "status": "ok"}
    try:
        return work()
    except Exception:
        record |= {"status": "failed", "error": traceback.format_exc()}
        raise
    finally:
        record["seconds"] = round(time.time() - began, 3)
        write_json(record, f"{folder}/manifest.json")
