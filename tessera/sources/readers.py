"""Tables from files: the format by name, several files as one table, columns by wildcard, results kept under a hash of their config."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FORMATS = {"parquet": "parquet", "pq": "parquet", "csv": "csv", "tsv": "tsv", "json": "json", "sdf": "sdf"}
_PACKED = ("gz", "bz2")


def format_of(path: str) -> str:
    """parquet, csv, tsv, json or sdf by the extension, that before .gz or .bz2 if there is one."""
    parts = path.rstrip("/").rsplit("/", 1)[-1].lower().split(".")
    if parts[-1] in _PACKED:
        parts.pop()
    if len(parts) < 2 or parts[-1] not in _FORMATS:
        raise ValueError(f"no known format in the name {path!r}")
    return _FORMATS[parts[-1]]


def _paths(spark: SparkSession, path: str) -> list[str]:
    """What a glob matches, sorted; an error if that is nothing."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    names = sorted(str(f.getPath()) for f in found) if found else []
    if not names:
        raise FileNotFoundError(path)
    return names


def read_table(spark: SparkSession, path: str, schema=None, columns: list[str] | None = None) -> DataFrame:
    """One table from the files of a path or glob. Files must agree on the set of columns; only the asked columns are scanned."""
    names = _paths(spark, path)
    kind = format_of(names[0])
    if kind == "sdf":
        from tessera.sources.sdf import read_sdf

        out = read_sdf(spark, path)
    else:
        reader = spark.read.schema(schema) if schema is not None else spark.read
        if kind in ("csv", "tsv"):
            reader = reader.option("header", True).option("sep", "," if kind == "csv" else "\t").option("inferSchema", schema is None)
        own = "csv" if kind == "tsv" else kind
        if schema is None and len(names) > 1:
            first = reader.format(own).load(names[0])
            for name in names[1:]:
                other = reader.format(own).load(name)
                if set(other.columns) != set(first.columns):
                    raise ValueError(f"{name} has other columns than {names[0]}")
                first = first.unionByName(other)
            out = first
        else:
            out = reader.format(own).load(names)
    if columns is None:
        return out
    if missing := set(columns) - set(out.columns):
        raise ValueError(f"no columns {sorted(missing)} in {path}")
    return out.select(*columns)


def columns_of(spark: SparkSession, path: str) -> list[str]:
    """Column names from the header or footer, without a scan."""
    name = _paths(spark, path)[0]
    kind = format_of(name)
    if kind in ("csv", "tsv"):
        return spark.read.option("header", True).option("sep", "," if kind == "csv" else "\t").csv(name).columns
    return spark.read.format(kind).load(name).columns


def choose_columns(available: list[str], wanted: list[str] | str | None, besides: str | None = None) -> list[str]:
    """Names, "*suffix" and "prefix*" patterns, or None for all but `besides`; in the table's order, each once."""
    if wanted is None:
        return [c for c in available if c != besides]
    chosen: list[str] = []
    for w in [wanted] if isinstance(wanted, str) else wanted:
        own = [c for c in available if (w.startswith("*") and c.endswith(w[1:])) or (w.endswith("*") and c.startswith(w[:-1]))] if "*" in w else [c for c in available if c == w]
        if not own:
            raise ValueError(f"no column like {w!r}")
        chosen += own
    return [c for c in available if c in chosen]


def smiles_column(columns: list[str]) -> str:
    """The one column whose name contains "smile"."""
    found = [c for c in columns if "smile" in c.lower()]
    if len(found) != 1:
        raise ValueError(f"one column with smile in its name is needed, not {found}")
    return found[0]


def config_hash(config: dict) -> str:
    return hashlib.md5(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def cached(spark: SparkSession, folder: str, config: dict, build, partition_by: list[str] | None = None) -> DataFrame:
    """The table kept for this config under `folder`, built and written first if there is no complete one (no _SUCCESS)."""
    path = f"{folder.rstrip('/')}/{config_hash(config)}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        writer = build().write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.parquet(path)


def keep_results(metrics: DataFrame, folder: str, run: dict) -> str:
    """Writes a run's metrics as one Parquet table named by the hash of its config, with the config in a column, and gives its name. A run
    that is kept again takes the place of the old one; readers see a run once it is whole (_SUCCESS)."""
    name = config_hash(run)
    metrics.withColumns({"run": F.lit(name), "config": F.lit(json.dumps(run, sort_keys=True, default=str))}).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/run={name}")
    return name


def kept_results(spark: SparkSession, folder: str) -> DataFrame:
    """The metrics of all runs under a folder that are whole."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/run=*/_SUCCESS")
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place) or []
    paths = sorted(str(f.getPath().getParent()) for f in found)
    if not paths:
        raise ValueError(f"no results under {folder}")
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def fake(spark: SparkSession, rows: int, labels: list[str], smiles: str = "C1=CC=CC=C1", seed: int = 0) -> DataFrame:
    """One molecule with random labels, `rows` times."""
    return spark.range(rows).select(F.lit(smiles).alias("SMILES"), *[F.rand(seed + k).alias(c) for k, c in enumerate(labels)])
