"""SDF files: molecules between $$$$ lines, V2000 blocks, as a row a molecule."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "name string, num_nodes int, symbols array<string>, positions array<array<double>>, bonds array<struct<a:int,b:int,order:int>>, properties map<string,string>, error string"


def parse_block(block: str) -> tuple:
    """name, atoms, positions, bonds and properties of one molecule; an error text for a block that cannot be read."""
    lines = block.strip("\n").split("\n")
    try:
        n, m = int(lines[3][:3]), int(lines[3][3:6])
        atoms = [(line[31:34].strip(), [float(line[k : k + 10]) for k in (0, 10, 20)]) for line in lines[4 : 4 + n]]
        bonds = [{"a": int(line[:3]) - 1, "b": int(line[3:6]) - 1, "order": int(line[6:9])} for line in lines[4 + n : 4 + n + m]]
        if len(atoms) != n or len(bonds) != m:
            raise ValueError("the block ends early")
    except (ValueError, IndexError) as e:
        return lines[0].strip() if lines else "", None, None, None, None, None, f"{type(e).__name__}: {e}"
    properties, name = {}, None
    for line in lines[4 + n + m :]:
        if line.startswith(">") and "<" in line:
            name = line[line.index("<") + 1 : line.rindex(">")]
        elif name and line.strip():
            properties[name] = line.strip()
            name = None
    return lines[0].strip(), n, [a for a, _ in atoms], [p for _, p in atoms], bonds, properties, None


def read_sdf(spark: SparkSession, path: str) -> DataFrame:
    """A row a molecule; text is split at the separator by Spark's reader, so large files are read in parts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ("name", "num_nodes", "symbols", "positions", "bonds", "properties", "error")]
        for pdf in batches:
            rows = [parse_block(b) for b in pdf["value"] if b.strip()]
            yield pd.DataFrame({c: [r[k] for r in rows] for k, c in enumerate(names)}).astype({"num_nodes": "Int32"})

    return spark.read.option("lineSep", "$$$$\n").text(path).mapInPandas(run, SCHEMA)
