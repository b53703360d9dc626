"""Sources: tables with missing values made null, cell folders, and molecule and structure files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .molecule_files import MOLECULE, read_mol2, read_sdf, write_molecules  # noqa: F401


def clean(df: DataFrame) -> DataFrame:
    """NaN becomes null: the engine has one kind of missing value."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in names}) if names else df


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet, ORC, JSON, CSV or TSV by the path's extension; a schema saves the pass that infers one."""
    if path.endswith((".parquet", ".orc")):
        return clean(spark.read.format(path.rsplit(".", 1)[1]).load(path))
    if path.endswith(".json"):
        return clean((spark.read.schema(schema) if schema else spark.read).json(path))
    reader = spark.read.option("header", True).option("sep", "\t" if path.endswith(".tsv") else ",")
    return clean((reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path))


def read_cell_folder(spark: SparkSession, root: str, layout: str = "subfolders", default_group: str = "") -> dict[str, DataFrame]:
    """cells and background of the files <root>[/<group>]/<stem>_corrected.csv; the row whose cell is BG is the background.

    Files without a cell column or a background row are left out.
    """
    pattern = f"{root.rstrip('/')}/*/*_corrected.csv" if layout == "subfolders" else f"{root.rstrip('/')}/*_corrected.csv"
    df = spark.read.option("header", True).option("inferSchema", True).csv(pattern).withColumn("_path", F.input_file_name())
    stem = F.regexp_extract("_path", r"([^/]+)_corrected\.csv$", 1)
    group = F.regexp_extract("_path", r"([^/]+)/[^/]+$", 1) if layout == "subfolders" else F.lit(default_group or root.rstrip("/").rsplit("/", 1)[-1])
    df = clean(df).withColumns({"file_stem": stem, "group": group}).drop("_path")
    is_background = F.trim(F.col("cell").cast("string")) == "BG"
    whole = df.where(is_background).select(F.col("file_stem").alias("_s"), F.col("group").alias("_g")).distinct()
    cells = df.where(~is_background).join(whole, (F.col("file_stem") == F.col("_s")) & (F.col("group") == F.col("_g")), "left_semi")
    return {"cells": cells.withColumn("cell", F.col("cell").cast("int")), "background": df.where(is_background).drop("cell")}


def parse_xyz(text: str) -> list[tuple]:
    out, lines, at = [], text.splitlines(), 0
    while at + 1 < len(lines) and lines[at].strip().isdigit():
        n = int(lines[at])
        atoms = []
        for line in lines[at + 2 : at + 2 + n]:
            e, x, y, z = line.split()[:4]
            atoms.append({"element": e, "x": float(x), "y": float(y), "z": float(z), "charge": 0})
        out.append((lines[at + 1].strip(), atoms, [], {}))
        at += 2 + n
    return out


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """Molecules of XYZ files, a file a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([m for text in pdf["value"] for m in parse_xyz(text)], columns=["name", "atoms", "bonds", "props"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, MOLECULE)


def read_pdb(spark: SparkSession, path: str) -> DataFrame:
    """Atoms (record, serial, atom, res_name, chain, res_id, x, y, z, element) of PDB files, by their fixed columns."""
    v = F.col("value")
    part = lambda a, n: F.trim(F.substring(v, a, n))
    atoms = spark.read.text(path).where(F.substring(v, 1, 6).isin("ATOM  ", "HETATM"))
    number = lambda a, n, kind: part(a, n).try_cast(kind)
    return atoms.select(part(1, 6).alias("record"), number(7, 5, "int").alias("serial"), part(13, 4).alias("atom"), part(18, 3).alias("res_name"), part(22, 1).alias("chain"), number(23, 4, "int").alias("res_id"), number(31, 8, "double").alias("x"), number(39, 8, "double").alias("y"), number(47, 8, "double").alias("z"), part(77, 2).alias("element"))
