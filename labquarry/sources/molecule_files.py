"""Molecule files as rows (name, atoms, bonds, props), read and written in columns.

SDF and MOL2 are split into records by Spark's own text reader, so that a large file is read by many tasks, and written
by its text writer with its commit protocol. Records that are not well formed are left out. Lines end with a line feed,
with or without a carriage return before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ATOM = "struct<element: string, x: double, y: double, z: double, charge: int>"
BOND = "struct<a: int, b: int, kind: int>"
MOLECULE = f"name string, atoms array<{ATOM}>, bonds array<{BOND}>, props map<string, string>"
SDF_END, MOL2_START = "$$$$\n", "@<TRIPOS>MOLECULE"
# Charges of the atom block's code in V2000, from code 0.
OLD_CHARGES = [0, 3, 2, 1, 0, -1, -2, -3]


def _cut(line: Column, at: int, n: int) -> Column:
    return F.trim(F.substring(line, at, n))


def _words(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def _atom(element: Column, x: Column, y: Column, z: Column, charge: Column) -> Column:
    number = lambda c: c.try_cast("double")
    return F.struct(element.alias("element"), number(x).alias("x"), number(y).alias("y"), number(z).alias("z"), F.coalesce(charge, F.lit(0)).alias("charge"))


def _bond(a: Column, b: Column, kind: Column) -> Column:
    return F.struct(a.try_cast("int").alias("a"), b.try_cast("int").alias("b"), F.coalesce(kind.try_cast("int"), F.lit(0)).alias("kind"))


def _let(value: Column, body) -> Column:
    """body of a value that is told once, however often body and the lambdas in it use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _block(lines: Column, first: Column, last: Column) -> Column:
    """The lines between two others."""
    return F.slice(lines, first + 1, F.greatest(last - first - 1, F.lit(0)))


def _whole(atoms: Column, bonds: Column, n: Column, m: Column) -> Column:
    """Whether the counts hold and every atom has a place and every bond two ends."""
    placed = F.forall(atoms, lambda a: (a["element"] != "") & a["x"].isNotNull() & a["y"].isNotNull() & a["z"].isNotNull())
    tied = F.forall(bonds, lambda b: b["a"].between(1, n) & b["b"].between(1, n))
    return (F.size(atoms) == n) & (F.size(bonds) == m) & placed & tied


def _table(atoms: Column, bonds: Column, n: Column, m: Column) -> Column:
    """struct of atoms, bonds and ok."""
    told = lambda t: F.struct(t["a"].alias("atoms"), t["b"].alias("bonds"), _whole(t["a"], t["b"], t["n"], t["m"]).alias("ok"))
    return _let(F.struct(atoms.alias("a"), bonds.alias("b"), n.alias("n"), m.alias("m")), told)


def _old(lines: Column, at: Column) -> Column:
    """The _table() of a V2000 record whose line of counts is at that place."""
    counts = F.get(lines, at - 1)
    count = lambda k: F.greatest(F.coalesce(_cut(counts, k, 3).try_cast("int"), F.lit(-1)), F.lit(-1))
    code = lambda line: F.get(F.array(*map(F.lit, OLD_CHARGES)), F.coalesce(_cut(line, 37, 3).try_cast("int"), F.lit(0)))
    number = lambda w, k: F.get(w, k).try_cast("int")
    told = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), ((F.size(w) - 3) / 2).cast("int"))), lambda i: F.struct(number(w, 2 * i + 1).alias("at"), number(w, 2 * i + 2).alias("charge")))
    pairs = F.flatten(F.transform(F.transform(F.filter(lines, lambda x: x.startswith("M  CHG")), _words), told))

    def read(s: Column) -> Column:
        n, m = s["n"], s["m"]
        own = lambda i: F.get(F.filter(s["pairs"], lambda p: p["at"] == i + 1), F.lit(0))["charge"]
        atoms = F.transform(F.slice(lines, at + 1, F.greatest(n, F.lit(0))), lambda x, i: _atom(_cut(x, 32, 3), _cut(x, 1, 10), _cut(x, 11, 10), _cut(x, 21, 10), F.when(F.size(s["pairs"]) > 0, own(i)).otherwise(code(x))))
        bonds = F.transform(F.slice(lines, at + 1 + F.greatest(n, F.lit(0)), F.greatest(m, F.lit(0))), lambda x: _bond(_cut(x, 1, 3), _cut(x, 4, 3), _cut(x, 7, 3)))
        return _table(atoms, bonds, n, m)

    return _let(F.struct(count(1).alias("n"), count(4).alias("m"), pairs.alias("pairs")), read)


def _new(text: Column) -> Column:
    """The _table() of a V3000 record: its lines have free columns, may go on after a hyphen, and name atoms by any number."""
    lines = F.split(F.regexp_replace(text, r"-\r?\nM  V30 ", ""), "\r?\n")
    charge = lambda w: F.regexp_extract(F.coalesce(F.get(F.filter(w, lambda x: x.startswith("CHG=")), F.lit(0)), F.lit("")), "CHG=([-+0-9]+)", 1).try_cast("int")
    none = F.expr("cast(array() as array<string>)")

    def rows(v30: Column) -> Column:
        place = lambda what: F.array_position(v30, F.lit(what)).cast("int")
        counts = _words(F.get(F.filter(v30, lambda x: x.startswith("COUNTS")), F.lit(0)))
        some = F.when(place("BEGIN BOND") > 0, _block(v30, place("BEGIN BOND"), place("END BOND"))).otherwise(none)
        atoms = F.when(place("BEGIN ATOM") > 0, _block(v30, place("BEGIN ATOM"), place("END ATOM"))).otherwise(none)
        n, m = (F.coalesce(F.get(counts, F.lit(k)).try_cast("int"), F.lit(-1)) for k in (1, 2))
        own = F.transform(atoms, _words)
        return _let(F.struct(own.alias("atoms"), F.transform(own, lambda w: F.get(w, F.lit(0))).alias("names"), F.transform(some, _words).alias("bonds"), n.alias("n"), m.alias("m")), read)

    def read(t: Column) -> Column:
        word = lambda w, k: F.get(w, F.lit(k))
        at = lambda x: F.array_position(t["names"], x).cast("string")
        atoms = F.transform(t["atoms"], lambda w: _atom(F.coalesce(word(w, 1), F.lit("")), word(w, 2), word(w, 3), word(w, 4), charge(w)))
        return _table(atoms, F.transform(t["bonds"], lambda w: _bond(at(word(w, 2)), at(word(w, 3)), word(w, 1))), t["n"], t["m"])

    return _let(F.transform(F.filter(lines, lambda x: x.startswith("M  V30 ")), lambda x: F.trim(F.substring(x, 8, 1 << 20))), rows)


def _props(text: Column) -> Column:
    """The data items after the table; of items of one name the first."""
    pattern = r"(?m)^>[^\n]*<([^>\n]+)>[^\n]*\n((?:[^\r\n]+\r?\n?)*)"
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("names"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("values"))
    flat = lambda v: F.regexp_replace(F.regexp_replace(v, r"[\r\n]+$", ""), "\r", "")
    first = lambda t, k: F.get(t["values"], (F.array_position(t["names"], k) - 1).cast("int"))
    return F.map_from_entries(_let(found, lambda t: F.transform(F.array_distinct(t["names"]), lambda k: F.struct(k, flat(first(t, k))))))


def read_sdf(spark: SparkSession, path: str) -> DataFrame:
    """Molecules of SDF files, V2000 and V3000; a record of neither, or whose counts do not hold, is left out."""
    text = F.col("value")
    df = spark.read.option("lineSep", SDF_END).text(path).withColumn("lines", F.split(text, "\r?\n"))
    at = F.array_position(F.transform("lines", lambda x: x.rlike(r"V[23]000\s*$")), True).cast("int")
    at = F.when(at > 0, at).otherwise(4)  # the oldest files name no version
    df = df.withColumns({"at": at, "new": F.coalesce(F.get("lines", at - 1).rlike(r"V3000\s*$"), F.lit(False))})
    told = df.withColumn("m", F.when(F.col("new"), _new(text)).otherwise(_old(F.col("lines"), F.col("at"))))
    kept = told.where(F.coalesce("m.ok", F.lit(False)))
    return kept.select(F.trim(F.coalesce(F.get("lines", F.col("at") - 4), F.lit(""))).alias("name"), F.col("m.atoms").cast(f"array<{ATOM}>").alias("atoms"), F.col("m.bonds").cast(f"array<{BOND}>").alias("bonds"), _props(text).alias("props"))


def read_mol2(spark: SparkSession, path: str) -> DataFrame:
    """Molecules of MOL2 files: elements by the atoms' types, aromatic bonds as kind 4, amides as 1, others without a number as 0; charges are not told."""
    lines = F.filter(F.split("value", "\r?\n"), lambda x: ~x.startswith("#"))
    kind = lambda t: F.when(t == "ar", "4").when(t == "am", "1").otherwise(t)
    word = lambda w, k: F.get(w, F.lit(k))

    def section(x: Column, name: str) -> Column:
        first = F.array_position(x, F.lit(f"@<TRIPOS>{name}")).cast("int")
        rest = F.slice(x, first + 1, F.size(x))
        after = F.array_position(F.transform(rest, lambda v: v.startswith("@<TRIPOS>")), True).cast("int")
        own = F.slice(rest, F.lit(1), F.when(after > 0, after - 1).otherwise(F.size(rest)))
        return F.when(first > 0, F.transform(F.filter(own, lambda v: F.trim(v) != ""), _words)).otherwise(F.expr("cast(array() as array<array<string>>)"))

    def read(x: Column) -> Column:
        counts = _words(F.get(x, F.lit(2)))
        n, m = F.coalesce(word(counts, 0).try_cast("int"), F.lit(-1)), F.coalesce(word(counts, 1).try_cast("int"), F.lit(0))
        atoms = F.transform(section(x, "ATOM"), lambda w: _atom(F.coalesce(F.split(word(w, 5), r"\.")[0], F.lit("")), word(w, 2), word(w, 3), word(w, 4), F.lit(0)))
        bonds = F.transform(section(x, "BOND"), lambda w: _bond(word(w, 1), word(w, 2), kind(word(w, 3))))
        return F.struct(F.trim(F.get(x, F.lit(1))).alias("name"), _table(atoms, bonds, n, m).alias("m"))

    df = spark.read.option("lineSep", MOL2_START).text(path).select(_let(lines, read).alias("r")).where(F.coalesce("r.m.ok", F.lit(False)))
    return df.select("r.name", F.col("r.m.atoms").cast(f"array<{ATOM}>").alias("atoms"), F.col("r.m.bonds").cast(f"array<{BOND}>").alias("bonds"), F.expr("cast(map() as map<string, string>)").alias("props"))


def _joined(parts: Column) -> Column:
    return F.array_join(parts, "")


def sdf_text(df: DataFrame) -> Column:
    """A record without its end mark: V2000, or V3000 beyond 999 atoms or bonds. Names and values are put on one line; names keep to 80 characters by the format."""
    n, m = F.size("atoms"), F.size("bonds")
    atoms = _joined(F.transform("atoms", lambda a: F.format_string("%10.4f%10.4f%10.4f %-3s 0  0  0  0  0  0  0  0  0  0  0  0\n", a["x"], a["y"], a["z"], a["element"])))
    bonds = _joined(F.transform("bonds", lambda b: F.format_string("%3d%3d%3d  0\n", b["a"], b["b"], b["kind"])))
    charge = lambda a: a["charge"] if "charge" in df.schema["atoms"].dataType.elementType.fieldNames() else F.lit(0)
    charges = _joined(F.transform("atoms", lambda a, i: F.when(charge(a) != 0, F.format_string("M  CHG  1 %3d %3d\n", i + 1, charge(a))).otherwise("")))
    old = F.concat(F.format_string("%3d%3d  0  0  0  0  0  0  0  0999 V2000\n", n, m), atoms, bonds, charges)
    rows = _joined(F.transform("atoms", lambda a, i: F.format_string("M  V30 %d %s %.4f %.4f %.4f 0%s\n", i + 1, a["element"], a["x"], a["y"], a["z"], F.when(charge(a) != 0, F.format_string(" CHG=%d", charge(a))).otherwise(""))))
    ties = _joined(F.transform("bonds", lambda b, i: F.format_string("M  V30 %d %d %d %d\n", i + 1, b["kind"], b["a"], b["b"])))
    new = F.concat(F.format_string("  0  0  0  0  0  0  0  0  0  0999 V3000\nM  V30 BEGIN CTAB\nM  V30 COUNTS %d %d 0 0 0\nM  V30 BEGIN ATOM\n", n, m), rows, F.lit("M  V30 END ATOM\n"), F.when(m > 0, F.concat(F.lit("M  V30 BEGIN BOND\n"), ties, F.lit("M  V30 END BOND\n"))).otherwise(""), F.lit("M  V30 END CTAB\n"))
    flat = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " ")
    props = _joined(F.transform(F.map_entries("props"), lambda e: F.concat(F.lit("> <"), F.regexp_replace(e["key"], r"[>\r\n]", " "), F.lit(">\n"), flat(e["value"]), F.lit("\n\n")))) if "props" in df.columns else F.lit("")
    return F.concat(flat(F.col("name")), F.lit("\n  labquarry\n\n"), F.when((n > 999) | (m > 999), new).otherwise(old), F.lit("M  END\n"), F.coalesce(props, F.lit("")))


def mol2_text(df: DataFrame) -> Column:
    """A whole record, from its start mark on."""
    atoms = _joined(F.transform("atoms", lambda a, i: F.format_string("%7d %-8s %10.4f %10.4f %10.4f %s 1 MOL 0.0000\n", i + 1, F.concat(a["element"], (i + 1).cast("string")), a["x"], a["y"], a["z"], a["element"])))
    kind = lambda b: F.when(b["kind"] == 4, "ar").when(b["kind"].between(1, 3), b["kind"].cast("string")).otherwise("un")
    bonds = _joined(F.transform("bonds", lambda b, i: F.format_string("%6d %5d %5d %s\n", i + 1, b["a"], b["b"], kind(b))))
    name = F.regexp_replace(F.coalesce("name", F.lit("")), r"[\r\n]+", " ")
    return F.concat(F.lit(f"{MOL2_START}\n"), name, F.format_string("\n%5d %5d 1 0 0\nSMALL\nNO_CHARGES\n\n@<TRIPOS>ATOM\n", F.size("atoms"), F.size("bonds")), atoms, F.lit("@<TRIPOS>BOND\n"), bonds)


def xyz_text(df: DataFrame) -> Column:
    """A whole record: count, name, and a line for each atom."""
    atoms = F.array_join(F.transform("atoms", lambda a: F.format_string("%-3s %14.6f %14.6f %14.6f", a["element"], a["x"], a["y"], a["z"])), "\n")
    return F.concat(F.size("atoms").cast("string"), F.lit("\n"), F.regexp_replace(F.coalesce("name", F.lit("")), r"[\r\n]+", " "), F.when(F.size("atoms") > 0, F.concat(F.lit("\n"), atoms)).otherwise(""))


def pdb_text(df: DataFrame) -> Column:
    """A model of HETATM rows, with CONECT rows for bonds."""
    atoms = _joined(F.transform("atoms", lambda a, i: F.format_string("HETATM%5d %-4s UNL A   1    %8.3f%8.3f%8.3f  1.00  0.00          %2s\n", (i + 1) % 100000, a["element"], a["x"], a["y"], a["z"], a["element"])))
    bonds = _joined(F.transform("bonds", lambda b: F.format_string("CONECT%5d%5d\n", b["a"], b["b"])))
    return F.concat(F.lit("COMPND    "), F.regexp_replace(F.coalesce("name", F.lit("")), r"[\r\n]+", " "), F.lit("\n"), atoms, bonds, F.lit("END"))


_WRITERS = {"sdf": (sdf_text, SDF_END), "mol2": (mol2_text, "\n"), "xyz": (xyz_text, "\n"), "pdb": (pdb_text, "\n")}


def write_molecules(df: DataFrame, path: str, form: str = "sdf", mode: str = "errorifexists") -> None:
    """Files of one form in a folder, a file for each partition; molecules without atoms are written too, null arrays as empty ones."""
    if form not in _WRITERS:
        raise ValueError(f"no form {form!r}")
    text, end = _WRITERS[form]
    own = df.withColumns({"atoms": F.coalesce("atoms", F.expr(f"cast(array() as {df.schema['atoms'].dataType.simpleString()})")), "bonds": F.coalesce("bonds", F.expr(f"cast(array() as {df.schema['bonds'].dataType.simpleString()})"))})
    own.select(text(own).alias("value")).write.mode(mode).option("lineSep", end).text(path)
