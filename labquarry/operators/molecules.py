"""Molecule tables: (name, smiles, properties...) rows. Structure perception is not part of this module; filters work on
columns of descriptors, and descriptors that follow from atoms and bonds alone are computed from parsed records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .running import accumulated
from .tabular import OperatorError, _need, q

# The published limits of each rule set, as (descriptor, operator, limit).
DRUG_LIKENESS: dict[str, list[tuple[str, str, float]]] = {
    "lipinski": [("mol_weight", "<=", 500), ("logp", "<=", 5), ("h_donors", "<=", 5), ("h_acceptors", "<=", 10)],
    "veber": [("rotatable_bonds", "<=", 10), ("tpsa", "<=", 140)],
    "egan": [("logp", "<=", 5.88), ("tpsa", "<=", 131.6)],
    "ghose": [("mol_weight", ">", 160), ("mol_weight", "<", 480), ("logp", ">", -0.4), ("logp", "<", 5.6), ("molar_refractivity", ">", 40), ("molar_refractivity", "<", 130), ("n_atoms", ">", 20), ("n_atoms", "<", 70)],
    "lead_like": [("mol_weight", "<=", 300), ("logp", "<=", 3), ("h_donors", "<=", 3), ("h_acceptors", "<=", 3)],
    "reos": [
        ("mol_weight", ">", 200), ("mol_weight", "<", 500), ("logp", ">", -5), ("logp", "<", 5), ("h_donors", "<", 5), ("h_acceptors", "<", 10),
        ("rotatable_bonds", "<", 8), ("formal_charge", ">", -2), ("formal_charge", "<", 2), ("heavy_atoms", ">", 15), ("heavy_atoms", "<", 50),
    ],
    "murcko": [("mol_weight", ">=", 200), ("mol_weight", "<=", 400), ("logp", "<=", 5.2), ("h_donors", "<=", 3), ("h_acceptors", "<=", 4), ("rotatable_bonds", "<=", 7)],
    "van_de_waterbeemd": [("mol_weight", "<=", 450), ("tpsa", "<=", 90)],
    "palm": [("tpsa", "<=", 140)],
    "ppi": [("mol_weight", ">=", 400), ("h_acceptors", ">=", 4), ("logp", ">=", 4), ("rings", ">=", 4)],
}
_TESTS = {"<": lambda c, v: c < v, ">": lambda c, v: c > v, "<=": lambda c, v: c <= v, ">=": lambda c, v: c >= v, "=": lambda c, v: c == v}


def from_table(df: DataFrame, smiles: str = "smiles", name: str | None = "id", properties: list[str] | None = None) -> DataFrame:
    """(name, smiles, properties...) of a table's rows that have a SMILES; names are Mol_1, Mol_2, ... if there is no such column.

    Made-up names follow the order of (smiles, properties), numbered without a task that holds all rows. SMILES are
    checked for balanced brackets and known signs only and are kept as given.
    """
    properties = properties or []
    _need(df, smiles, *properties)
    text = F.trim(q(smiles).cast("string"))
    formed = text.rlike(r"^[A-Za-z0-9@+\-\[\]()=#$:/\\.%*]+$")
    for a, b in ("[]", "()"):
        formed = formed & (F.length(F.regexp_replace(text, rf"[^\{a}]", "")) == F.length(F.regexp_replace(text, rf"[^\{b}]", "")))
    kept = df.where(F.coalesce(formed, F.lit(False)))
    named = name is not None and name in df.columns
    out = kept.select(*([q(name).cast("string").alias("name")] if named else []), text.alias("smiles"), *(q(c) for c in properties))
    if named:
        return out
    one = accumulated(out.groupBy(*out.columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_order", F.struct("smiles", *(q(c) for c in properties))), "_order", {"_upto": "_n"}, [])
    every = one.withColumn("_k", F.explode(F.sequence(F.col("_upto") - F.col("_n") + 1, F.col("_upto"))))
    return every.select(F.concat(F.lit("Mol_"), F.col("_k").cast("long")).alias("name"), "smiles", *(q(c) for c in properties))


def to_table(df: DataFrame, structure: str = "ROMol") -> DataFrame:
    """A molecule table as a plain one, without the column of structures."""
    return df.drop(structure)


def nth_molecule(df: DataFrame, row: int = 0, order: str = "name") -> DataFrame:
    """The one row at place `row` (from 0) in the order of a column, ties by the rest; an error if there is none."""
    ties = sorted(c for c in df.columns if c != order)
    found = df.orderBy(q(order), *(q(c) for c in ties)).offset(row).limit(1) if row >= 0 else df.limit(0)
    if found.isEmpty():
        raise OperatorError(f"row {row} is out of range")
    return found


def property_filter(df: DataFrame, column: str, operator: str, limit: float) -> dict[str, DataFrame]:
    """matches and rejects; values that are missing or not finite are rejected."""
    _need(df, column)
    v = q(column).try_cast("double")
    holds = F.coalesce(_TESTS[operator](v, limit) & ~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))
    return {"matches": df.where(holds), "rejects": df.where(~holds)}


def drug_likeness(df: DataFrame, rules: str = "lipinski") -> dict[str, DataFrame]:
    """matches and rejects by all rules of a set, over columns named like its descriptors."""
    if rules not in DRUG_LIKENESS:
        raise OperatorError(f"no rule set {rules!r}")
    _need(df, *(c for c, _, _ in DRUG_LIKENESS[rules]))
    holds = reduce(lambda a, b: a & b, [F.coalesce(_TESTS[op](q(c).try_cast("double"), v), F.lit(False)) for c, op, v in DRUG_LIKENESS[rules]])
    return {"matches": df.where(holds), "rejects": df.where(~holds)}


def merge(a: DataFrame, b: DataFrame, logic: str = "OR", name: str = "name") -> DataFrame:
    """AND: rows of a whose name is in b too. OR: rows of both, the first of each name (a's) kept."""
    if logic == "AND":
        return a.join(b.select(q(name).alias("_name")).distinct(), q(name) == F.col("_name"), "left_semi")
    both = a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    rest = [q(c) for c in both.columns if c not in ("_side", name)]
    place = F.row_number().over(Window.partitionBy(q(name)).orderBy("_side", F.xxhash64(*(c.cast("string") for c in rest)) if rest else F.lit(0)))
    return both.withColumn("_place", place).where("_place = 1").drop("_side", "_place")


def docking_box(atoms: DataFrame, padding: float = 5.0) -> DataFrame:
    """One row: centre and size of the box round atoms (x, y, z), padded on each side."""
    mid = lambda c: ((F.min(c) + F.max(c)) / 2).alias(f"center_{c}")
    size = lambda c: (F.max(c) - F.min(c) + 2 * padding).alias(f"size_{c}")
    return atoms.agg(*(mid(c) for c in "xyz"), *(size(c) for c in "xyz"))


def edit_protein(atoms: DataFrame, chains: list[str] | None = None, residues: tuple[int, int] | None = None, remove_residues: list[str] | None = None, remove_water: bool = True, remove_hetero: bool = False) -> DataFrame:
    """Atoms (record, chain, res_name, res_id, ...) of chains and residues wanted, without water or other hetero atoms."""
    out = atoms
    if chains:
        out = out.where(F.col("chain").isin(chains))
    if residues:
        out = out.where(F.col("res_id").between(*residues))
    if remove_residues:
        out = out.where(~F.col("res_name").isin(remove_residues))
    if remove_water:
        out = out.where(~F.col("res_name").isin("HOH", "WAT"))
    return out.where(F.col("record") != "HETATM") if remove_hetero else out


# Standard atomic weights, in u.
ATOMIC_WEIGHT = {
    "H": 1.008, "Li": 6.94, "B": 10.81, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "Na": 22.990, "Mg": 24.305, "Si": 28.085,
    "P": 30.974, "S": 32.06, "Cl": 35.45, "K": 39.098, "Ca": 40.078, "Fe": 55.845, "Cu": 63.546, "Zn": 65.38, "Se": 78.971, "Br": 79.904, "I": 126.904,
}


def structure_descriptors(df: DataFrame) -> DataFrame:
    """Adds n_atoms, heavy_atoms, n_bonds, formula, weight and centroid of rows with atoms (element, x, y, z) and bonds.

    The formula has carbon, hydrogen, then the others by name; an element without a known weight gives a null weight.
    """
    weight = F.create_map(*[F.lit(x) for pair in ATOMIC_WEIGHT.items() for x in pair])
    elements = F.transform("atoms", lambda a: a["element"])
    kinds = F.array_sort(F.array_distinct(elements))
    ordered = F.concat(F.filter(kinds, lambda e: e == "C"), F.filter(kinds, lambda e: e == "H"), F.filter(kinds, lambda e: ~e.isin("C", "H")))
    count = lambda e: F.size(F.filter(elements, lambda x: x == e))
    formula = F.array_join(F.transform(ordered, lambda e: F.concat(e, F.when(count(e) > 1, count(e).cast("string")).otherwise(""))), "")
    mass = F.aggregate(elements, F.lit(0.0), lambda s, e: s + F.try_element_at(weight, e))
    mean = lambda k: F.aggregate("atoms", F.lit(0.0), lambda s, a: s + a[k]) / F.size("atoms")
    return df.withColumns({"n_atoms": F.size("atoms"), "heavy_atoms": F.size(F.filter(elements, lambda e: e != "H")), "n_bonds": F.size("bonds"), "formula": formula, "weight": mass, "centroid": F.when(F.size("atoms") > 0, F.struct(*(mean(k).alias(k) for k in "xyz")))})
