import random

import pytest
from pyspark.sql import functions as F

from labquarry import sources
from labquarry.operators import structures
from labquarry.sources import molecule_files as mf


def plain(rows):
    return sorted((r["name"], [tuple(a) for a in r["atoms"]], [tuple(b) for b in r["bonds"]], sorted(r["props"].items())) for r in rows.collect())


def drawn(n, seed=2, big=None):
    rnd = random.Random(seed)
    out = []
    for m in range(n):
        size = big if big and m == n - 1 else rnd.randrange(1, 12)
        atoms = [(rnd.choice(["C", "N", "Cl", "Na"]), round(rnd.uniform(-99, 99), 4), round(rnd.uniform(-9, 9), 4), 0.0, rnd.choice([0, 0, 0, 1, -2])) for _ in range(size)]
        bonds = [(k, k + 1, rnd.choice([1, 2, 3, 4])) for k in range(1, size)]
        out.append((f"mol {m}", atoms, bonds, {"ID": str(m), "long name": "a b  c"} if m % 3 else {}))
    return out


@pytest.mark.parametrize("big", [None, 1200])
def test_sdf_round_trip(spark, tmp_path, big):
    df = spark.createDataFrame(drawn(40, big=big), mf.MOLECULE).repartition(3)
    path = str(tmp_path / "out")
    mf.write_molecules(df, path)
    back = mf.read_sdf(spark, path)
    assert plain(back) == plain(df) and back.schema["atoms"].dataType == df.schema["atoms"].dataType
    mf.write_molecules(back, path + "2")
    assert plain(mf.read_sdf(spark, path + "2")) == plain(df)  # written, read, written, read
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        mf.write_molecules(df, path)


def test_mol2_round_trip(spark, tmp_path):
    rows = [(n, [(*a[:4], 0) for a in atoms], bonds, {}) for n, atoms, bonds, _ in drawn(30)]
    df = spark.createDataFrame(rows, mf.MOLECULE).repartition(2)
    mf.write_molecules(df, str(tmp_path / "out"), "mol2")
    assert plain(mf.read_mol2(spark, str(tmp_path / "out"))) == plain(df)
    for form in ("xyz", "pdb"):
        mf.write_molecules(df, str(tmp_path / form), form)
    assert sum(len(r["atoms"]) for r in sources.read_xyz(spark, str(tmp_path / "xyz")).collect()) == sum(len(r[1]) for r in rows)
    pdb = sources.read_pdb(spark, str(tmp_path / "pdb"))
    assert pdb.count() == sum(len(r[1]) for r in rows) and {r["element"] for r in pdb.collect()} == {"C", "N", "Cl", "Na"}
    with pytest.raises(ValueError):
        mf.write_molecules(df, str(tmp_path / "x"), "doc")


def test_files_are_split_at_record_ends(spark, tmp_path):
    mf.write_molecules(spark.createDataFrame(drawn(900), mf.MOLECULE).coalesce(1), str(tmp_path / "out"))
    (path,) = (str(p) for p in (tmp_path / "out").glob("part-*"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        back = mf.read_sdf(spark, path)
        assert back.select(F.spark_partition_id().alias("p")).distinct().count() > 3
        assert plain(back) == plain(spark.createDataFrame(drawn(900), mf.MOLECULE))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


V3000 = """ferrocene-ish
  x

  0  0  0     0  0            999 V3000
M  V30 BEGIN CTAB
M  V30 COUNTS 3 2 0 0 1
M  V30 BEGIN ATOM
M  V30 10 Fe 0.5 0 0 0 CHG=2 -
M  V30 MASS=57
M  V30 20 C 1.25 -2 3 0
M  V30 7 O 1e1 0 0 0 CHG=-1
M  V30 END ATOM
M  V30 BEGIN BOND
M  V30 1 1 10 20
M  V30 2 9 7 20
M  V30 END BOND
M  V30 END CTAB
M  END
>  <A>  (1)
two
lines

> <B>

> <A>
again

$$$$
"""
V2000 = """old codes
  x

  2  1  0  0  0  0  0  0  0  0999 V2000
    0.0000    0.0000    0.0000 N   0  3  0  0
   -1.5000    0.2500    9.0000 Cl  0  5  0  0
  1  2  1  0
M  END
$$$$
"""
CHARGED = V2000.replace("old codes", "told").replace("M  END", "M  CHG  1   2  -1\nM  END")
BAD = "bad\n\n\n  9  1  0  0  0  0  0  0  0  0999 V2000\n    0.0000    0.0000    0.0000 N   0  3  0  0\nM  END\n$$$$\n"


def test_versions_of_sdf(spark, tmp_path):
    (tmp_path / "m.sdf").write_bytes((V3000 + BAD + V2000 + CHARGED.replace("\n", "\r\n").replace("$$$$\r\n", "$$$$\n") + "\n").encode())
    got = {r["name"]: r for r in mf.read_sdf(spark, str(tmp_path / "m.sdf")).collect()}
    assert set(got) == {"ferrocene-ish", "old codes", "told"}
    r = got["ferrocene-ish"]
    assert [tuple(a) for a in r["atoms"]] == [("Fe", 0.5, 0.0, 0.0, 2), ("C", 1.25, -2.0, 3.0, 0), ("O", 10.0, 0.0, 0.0, -1)]
    assert [tuple(b) for b in r["bonds"]] == [(1, 2, 1), (3, 2, 9)] and r["props"] == {"A": "two\nlines", "B": ""}
    assert [(a["element"], a["charge"]) for a in got["old codes"]["atoms"]] == [("N", 1), ("Cl", -1)]
    assert [(a["element"], a["charge"], a["x"]) for a in got["told"]["atoms"]] == [("N", 0, 0.0), ("Cl", -1, -1.5)]
    atoms, bonds = structures.from_records(mf.read_sdf(spark, str(tmp_path / "m.sdf")))
    assert {(r["mol"], r["atom"], r["charge"]) for r in atoms.where("mol = 'told'").collect()} == {("told", 0, 0), ("told", 1, -1)}
    assert {tuple(r) for r in bonds.collect()} == {("ferrocene-ish", 0, 1, 1), ("ferrocene-ish", 1, 2, 0), ("old codes", 0, 1, 1), ("told", 0, 1, 1)}


def test_mol2_sections(spark, tmp_path):
    text = "# made by hand\n@<TRIPOS>MOLECULE\nbenzene part\n 3 2 1 0 0\nSMALL\nGASTEIGER\n\n@<TRIPOS>ATOM\n 1 C1 0.0 1.5 0.0 C.ar 1 X 0.1\n 2 C2 1.0 0.5 0.0 C.ar 1 X 0.1\n 3 N1 2.0 0.5 -1.25 N.am 1 X -0.2\n@<TRIPOS>BOND\n 1 1 2 ar\n 2 2 3 am\n@<TRIPOS>SUBSTRUCTURE\n 1 X 1\n@<TRIPOS>MOLECULE\nshort\n 2 0\nSMALL\n\n\n@<TRIPOS>ATOM\n 1 C1 0 0 0 C.3\n"
    (tmp_path / "m.mol2").write_text(text)
    got = plain(mf.read_mol2(spark, str(tmp_path / "m.mol2")))
    assert got == [("benzene part", [("C", 0.0, 1.5, 0.0, 0), ("C", 1.0, 0.5, 0.0, 0), ("N", 2.0, 0.5, -1.25, 0)], [(1, 2, 4), (2, 3, 1)], [])]
