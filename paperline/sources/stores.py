"""Stores of catalogues, dictionaries and settings: versions that readers never see half written.

A store is a folder of versions. A version is written whole under a name of its own and then named by one small marker file, whose
appearance is atomic; readers take the newest version that is marked. A write that fails leaves no marker, so the old state stays.
All files go through the Hadoop file system of the path, so a store may lie in any store that Spark reads.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators.export import COLUMNS

CATALOGUE = "catalog_ord int, name string, barcode string, extra array<string>, unit string, supplier string, price double"
DICTIONARY = "supplier_key string, map_code string, barcode string, name string, supplier string, updated string"
DONE = "_done"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, path: str) -> list[str]:
    """The marked versions, the oldest first."""
    fs, at, path_of = _fs(spark, path)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
    return sorted(n for n in names if n.startswith("v-") and fs.exists(path_of(f"{path}/{n}/{DONE}")))


def save(df: DataFrame, path: str, keep: int = 2) -> str:
    """SRC-11, SRC-12: a new version; of the older ones ``keep`` - 1 stay for readers that have begun. Returns its name.

    ``df`` may read the store itself. Versions are ordered by time, then by a random end, so two writers never share one.
    """
    spark = df.sparkSession
    name = f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{path}/{name}/data")
    fs, _, path_of = _fs(spark, path)
    fs.create(path_of(f"{path}/{name}/{DONE}"), False).close()
    for old in versions(spark, path)[:-keep]:
        fs.delete(path_of(f"{path}/{old}"), True)
    return name


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest version, or no row where there is none yet. Columns that an older version lacks are null."""
    found = versions(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/{found[-1]}/data") if found else spark.createDataFrame([], schema)


def load_catalogue(spark: SparkSession, path: str) -> DataFrame:
    return load(spark, path, CATALOGUE)


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return load(spark, path, DICTIONARY)


# today's default columns, and those of earlier versions: who has saved one of them never chose it.
DEFAULT_COLUMNS = ("barcode", "qty", "name", "unit", "price")
OLD_DEFAULTS = (("barcode", "qty", "price"), ("barcode", "qty", "name", "unit"))


@dataclass(frozen=True)
class Settings:
    """How lines are exported; unit rules are (from, to, factor)."""

    columns: tuple[str, ...] = DEFAULT_COLUMNS
    header: bool = False
    qty_mode: str = "pcs"
    unit_rules: tuple[tuple[str, str, float], ...] = field(default=(("блок", "шт", 10.0),))


def settings_of(text: str | None) -> Settings:
    """SRC-15: settings from JSON, whatever its age: unknown columns, broken rules and old defaults give way to today's defaults."""
    default = Settings()
    try:
        raw = json.loads(text or "null")
    except ValueError:
        return default
    if not isinstance(raw, dict):
        return default
    chosen = raw.get("columns")
    chosen = tuple(c for c in chosen if c in COLUMNS) if isinstance(chosen, (list, tuple)) and tuple(chosen) not in OLD_DEFAULTS else default.columns
    return Settings(chosen or default.columns, raw["header"] if isinstance(raw.get("header"), bool) else default.header, "packs" if raw.get("qty_mode") == "packs" else "pcs", _rules(raw, default))


def _rules(raw: dict, default: Settings) -> tuple[tuple[str, str, float], ...]:
    if not isinstance(raw.get("unit_rules"), list):
        return default.unit_rules
    out = []
    for r in raw["unit_rules"]:
        try:
            source, target, factor = r
            factor = float(factor)
        except (TypeError, ValueError):
            continue
        if isinstance(source, str) and isinstance(target, str) and factor > 0:
            out.append((source, target, factor))
    return tuple(out)


def save_settings(spark: SparkSession, settings: Settings, path: str) -> None:
    """SNK-08: settings as a version of their own store."""
    save(spark.createDataFrame([(json.dumps(asdict(settings), ensure_ascii=False),)], "value string").coalesce(1), path)


def load_settings(spark: SparkSession, path: str) -> Settings:
    rows = load(spark, path, "value string").take(1)
    return settings_of(rows[0][0] if rows else None)
