"""Structures of molecules as rows.

atoms (mol, atom, element, charge, hydrogens, aromatic): atom counts from 0 in its molecule; hydrogens are those that are
no rows, null if valence is to tell them. bonds (mol, a, b, kind): kind 1, 2, 3, 4 for aromatic, 0 for any other; a row
for each bond. One shuffle brings a molecule's rows together as a record of arrays; steps on its graph then read that
record alone, many molecules at a time. Fragments and cores of molecules of more than WHOLE rows are found in rounds of
joins on (mol, atom), spread over tasks. Joins of atoms are merge joins: sizes of exploded or stored tables are estimated
far too low, and a broadcast of them would not fit the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import drop_stored, stored
from .molecules import ATOMIC_WEIGHT
from .tabular import OperatorError, q

# The elements by atomic number.
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr"
).split()
# Usual valences by element and charge, from which hydrogens follow; others have none.
VALENCES = {
    ("H", 0): 1, ("C", 0): 4, ("C", 1): 3, ("C", -1): 3, ("N", 0): 3, ("N", 1): 4, ("N", -1): 2, ("O", 0): 2, ("O", 1): 3, ("O", -1): 1, ("F", 0): 1,
    ("P", 0): 3, ("P", 1): 4, ("S", 0): 2, ("S", 1): 3, ("S", -1): 1, ("Cl", 0): 1, ("Br", 0): 1, ("I", 0): 1, ("Si", 0): 4, ("B", 0): 3, ("B", -1): 4, ("Se", 0): 2, ("As", 0): 3,
}
#: Molecules of more rows (atoms and bonds) than this are taken apart in rounds of joins, not as one record.
WHOLE = 100_000
#: Bonds of the largest core whose rings a worker remembers.
SMALL_CORE = 64
#: Partial matches that are grown at once.
PARTIAL = 1 << 18
#: Multiplier of the 32-bit hash by which identifiers are combined (FNV).
FNV = 16777619

_TOKEN = r"\[[^\[\]]+\]|Br|Cl|[BCNOPSFI]|[bcnops]|\*|[-=#$:/\\~.()]|%[0-9]{2}|[0-9]"
_BRACKET = r"^\[([0-9]*)(\*|[A-Z][a-z]?|se|as|[bcnops])(@*)(H[0-9]*)?([+-]*[0-9]*)(?::[0-9]+)?\]$"


def _linked(text: Column) -> Column:
    """The atoms (tokens) and bonds (a, b, sign) of a line notation: struct of atoms, bonds and ok, built token by token."""
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    typed = lambda kind: F.expr(f"cast(array() as array<{kind}>)")
    start = {
        "prev": F.lit(-1), "stack": typed("int"), "sign": F.lit(""), "open": typed("struct<label: string, atom: int, sign: string>"),
        "atoms": typed("string"), "bonds": typed("struct<a: int, b: int, sign: string>"), "ok": F.lit(True),
    }

    def with_(s: Column, **changed: Column) -> Column:
        return F.struct(*(changed.get(k, s[k]).alias(k) for k in start))

    def bond(s: Column, a: Column, b: Column, sign: Column) -> Column:
        return F.array_append(s["bonds"], F.struct(a.alias("a"), b.alias("b"), sign.alias("sign")))

    def step(s: Column, t: Column) -> Column:
        label = F.regexp_replace(t, "^%0?", "")
        begun = F.filter(s["open"], lambda o: o["label"] == label)
        none = F.lit("")
        new = F.size(s["atoms"])
        closed = with_(
            s, sign=none, ok=s["ok"] & (s["prev"] >= 0), open=F.filter(s["open"], lambda o: o["label"] != label),
            bonds=bond(s, F.get(begun, F.lit(0))["atom"], s["prev"], F.when(s["sign"] != "", s["sign"]).otherwise(F.get(begun, F.lit(0))["sign"])),
        )
        opened = with_(s, sign=none, ok=s["ok"] & (s["prev"] >= 0), open=F.array_append(s["open"], F.struct(label.alias("label"), s["prev"].alias("atom"), s["sign"].alias("sign"))))
        atom = with_(s, sign=none, prev=new, atoms=F.array_append(s["atoms"], t), bonds=F.when(s["prev"] >= 0, bond(s, s["prev"], new, s["sign"])).otherwise(s["bonds"]))
        return (
            F.when(t == "(", with_(s, stack=F.array_append(s["stack"], s["prev"]), ok=s["ok"] & (s["prev"] >= 0)))
            .when(t == ")", with_(s, prev=F.coalesce(F.try_element_at(s["stack"], F.lit(-1)), F.lit(-1)), stack=F.slice(s["stack"], 1, F.greatest(F.size(s["stack"]) - 1, F.lit(0))), ok=s["ok"] & (F.size(s["stack"]) > 0)))
            .when(t == ".", with_(s, prev=F.lit(-1)))
            .when(t.rlike(r"^[-=#$:/\\~]$"), with_(s, sign=t))
            .when(t.rlike("^%?[0-9]+$"), F.when(F.size(begun) > 0, closed).otherwise(opened))
            .otherwise(atom)
        )

    whole = F.length(F.array_join(tokens, "")) == F.length(text)
    end = lambda s: F.struct(s["atoms"].alias("atoms"), s["bonds"].alias("bonds"), (s["ok"] & whole & (F.size(s["stack"]) == 0) & (F.size(s["open"]) == 0) & (F.size(s["atoms"]) > 0)).alias("ok"))
    return F.aggregate(tokens, F.struct(*(v.alias(k) for k, v in start.items())), step, end)


def parse_smiles(df: DataFrame, key: str, smiles: str = "smiles") -> tuple[DataFrame, DataFrame]:
    """atoms and bonds of the SMILES in a column; key names the molecule (unique). Rows that are null or not well formed have no atoms.

    Bonds between aromatic atoms without a sign are aromatic inside rings and single between them. Signs of stereo are
    read and dropped. Isotopes are dropped. Very long SMILES are read whole.
    """
    parsed = stored(df.select(q(key).alias("mol"), _linked(F.trim(q(smiles).cast("string"))).alias("g")).where(F.col("g.ok") & F.forall("g.atoms", lambda t: ~t.startswith("[") | t.rlike(_BRACKET))))
    token = F.col("token")
    part = lambda k: F.regexp_extract(token, _BRACKET, k)
    boxed = token.startswith("[")
    raw = F.when(boxed, part(2)).otherwise(token)
    sign, digits = F.substring(part(5), 1, 1), F.regexp_extract(part(5), "([0-9]+)$", 1)
    size = F.when(digits != "", digits.try_cast("int")).otherwise(F.length(part(5)))
    hydrogens = F.when(~boxed, F.lit(None)).when(part(4) == "", 0).otherwise(F.coalesce(F.substring(part(4), 2, 9).try_cast("int"), F.lit(1)))
    atoms = parsed.select("mol", F.posexplode("g.atoms").alias("atom", "token"))
    atoms = atoms.select("mol", "atom", F.initcap(raw).alias("element"), F.when(boxed & (sign == "+"), size).when(boxed & (sign == "-"), -size).otherwise(F.lit(0)).alias("charge"), hydrogens.cast("int").alias("hydrogens"), raw.rlike("^[a-z]").alias("aromatic"))
    atoms = stored(atoms)
    kind = lambda sign: F.when(sign == "=", 2).when(sign == "#", 3).when(sign == ":", 4).when(sign.isin("$", "~"), 0).when(sign != "", 1)
    soft = F.transform("g.atoms", lambda t: F.when(t.startswith("["), F.regexp_extract(t, _BRACKET, 2)).otherwise(t).rlike("^[a-z]"))
    ties = F.transform(F.filter("g.bonds", lambda x: x["a"] != x["b"]), lambda x: F.struct(F.least(x["a"], x["b"]).alias("a"), F.greatest(x["a"], x["b"]).alias("b"), kind(x["sign"]).alias("kind")))
    out = stored(parsed.select("mol", soft.alias("soft"), F.array_sort(ties).alias("bonds")).mapInArrow(_kinds, f"mol {parsed.schema['mol'].dataType.simpleString()}, a int, b int, kind int"))
    drop_stored(parsed)
    return atoms, out


def _kinds(batches):
    """(mol, a, b, kind) of records (mol, soft, bonds): a bond without a sign is aromatic (4) in a ring between aromatic atoms, or else single."""
    for batch in batches:
        bonds, n_atoms, soft = batch.column("bonds"), _lengths(batch.column("soft")), _numbers(batch.column("soft").flatten()).astype(bool)
        row, (a, b) = np.repeat(np.arange(len(batch)), _lengths(bonds)), (_numbers(bonds.flatten().field(c)) for c in "ab")
        kind = _numbers(bonds.flatten().field("kind"), -1)
        first = (np.cumsum(n_atoms) - n_atoms)[row]
        may = (kind < 0) & soft[first + a] & soft[first + b] if len(row) else np.zeros(0, bool)
        some = np.isin(row, np.unique(row[may]))  # molecules that have such bonds
        around = _in_cycles(row[some], a[some], b[some])
        kind[np.flatnonzero(some)[around & may[some]]] = 4
        kind[kind < 0] = 1
        yield pa.RecordBatch.from_arrays([batch.column("mol").take(pa.array(row)), *(pa.array(x, pa.int32()) for x in (a, b, kind))], ["mol", "a", "b", "kind"])


def from_records(df: DataFrame, key: str = "name") -> tuple[DataFrame, DataFrame]:
    """atoms and bonds of molecules as the readers give them (arrays of atoms, and of bonds that count from 1); key must be unique."""
    charge = "charge" in df.schema["atoms"].dataType.elementType.fieldNames()
    atoms = df.select(q(key).alias("mol"), F.posexplode("atoms").alias("atom", "_a"))
    atoms = atoms.select("mol", "atom", F.col("_a.element").alias("element"), (F.col("_a.charge") if charge else F.lit(0)).alias("charge"), F.lit(None).cast("int").alias("hydrogens"), F.lit(False).alias("aromatic"))
    bonds = df.select(q(key).alias("mol"), F.explode("bonds").alias("_b")).select("mol", (F.col("_b.a") - 1).alias("a"), (F.col("_b.b") - 1).alias("b"), F.col("_b.kind").alias("kind"))
    bonds = bonds.where("a != b").select("mol", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("kind").between(1, 4), F.col("kind")).otherwise(0).alias("kind"))
    soft = both_ways(bonds.where("kind = 4")).select("mol", "atom").distinct().withColumn("_soft", F.lit(True))
    return atoms.join(soft.hint("merge"), ["mol", "atom"], "left").withColumn("aromatic", F.coalesce("_soft", F.lit(False))).drop("_soft"), bonds


def both_ways(bonds: DataFrame) -> DataFrame:
    """(mol, atom, other, kind): each bond from either end."""
    return bonds.select("mol", F.col("a").alias("atom"), F.col("b").alias("other"), "kind").union(bonds.select("mol", F.col("b"), F.col("a"), "kind"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by key to a fixed number of tasks: adaptive execution joins partitions by their bytes, but few bytes of molecules are much work.

    Rows made from df's keep its partitions, so that packed() then moves nothing.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), key)


def packed(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(mol, atoms, bonds): one record a molecule, arrays of its rows in order; one shuffle (none after spread()), no join."""
    atom, bond = F.struct(*(c for c in atoms.columns if c != "mol")), F.struct("a", "b", "kind")
    one = atoms.select("mol", atom.alias("atoms"), F.lit(None).cast(bonds.select(bond).schema[0].dataType).alias("bonds"))
    other = bonds.select("mol", F.lit(None).cast(atoms.select(atom).schema[0].dataType).alias("atoms"), bond.alias("bonds"))
    return spread(one.unionByName(other), "mol").groupBy("mol").agg(*(F.array_sort(F.collect_list(c)).alias(c) for c in ("atoms", "bonds")))


def _lengths(lists: pa.ListArray) -> np.ndarray:
    return lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _numbers(values: pa.Array, null: int = 0) -> np.ndarray:
    return values.cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False).astype(np.int64)


def _coded(values: pa.Array) -> tuple[np.ndarray, list]:
    """Strings as places in a list of them, the last of which stands for null (-1)."""
    found = values.dictionary_encode()
    return _numbers(found.indices, -1), [*found.dictionary.to_pylist(), None]


def _nodes(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of bonds as numbers from 0, in the order of (row, atom)."""
    at = np.unique(np.concatenate([row << 32 | a, row << 32 | b]), return_inverse=True)[1]
    return at[: len(a)], at[len(a) :]


def _pruned(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the bonds that stay when those that end in an atom without another are taken away, again and again."""
    x, y = _nodes(row, a, b)
    kept = np.arange(len(x))
    while len(kept):
        degree = np.bincount(np.concatenate([x[kept], y[kept]]))
        inner = (degree[x[kept]] > 1) & (degree[y[kept]] > 1)
        if inner.all():
            break
        kept = kept[inner]
    return kept


def _ring_lists(row: np.ndarray, a: np.ndarray, b: np.ndarray):
    """(row, rings): the smallest rings of each row that has any; bonds come once each, in the order of (row, a, b).

    A core's atoms are numbered in their order, by which cores alike look alike: the rings of small ones are remembered.
    """
    kept = _pruned(row, a, b)
    row, a, b = row[kept], a[kept], b[kept]
    if not len(row):
        return
    nodes = np.unique(np.concatenate([row << 32 | a, row << 32 | b]))
    atoms = (nodes & 0xFFFFFFFF).tolist()
    cuts = [0, *(np.flatnonzero(row[1:] != row[:-1]) + 1).tolist(), len(row)]
    rows = row[cuts[:-1]]
    first = np.searchsorted(nodes, rows << 32)
    own = np.repeat(first, np.diff(cuts))
    ends = np.stack([np.searchsorted(nodes, row << 32 | a) - own, np.searchsorted(nodes, row << 32 | b) - own], 1).astype("<i4")
    for r, at, start, end in zip(rows.tolist(), first.tolist(), cuts, cuts[1:]):
        rings = (_known_basis if end - start <= SMALL_CORE else _basis)(ends[start:end].tobytes())
        yield r, [[atoms[at + i] for i in ring] for ring in rings]


def _basis(ends: bytes) -> list[list[int]]:
    a, b = np.frombuffer(ends, "<i4").reshape(-1, 2).T.tolist()
    return _cycle_basis(a, b)


_known_basis = lru_cache(maxsize=8192)(_basis)


def _in_cycles(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which bonds are in a ring."""
    once = _once(row, a, b)
    pairs = [(r, min(x, y), max(x, y)) for r, rings in _ring_lists(row[once], a[once], b[once]) for ring in rings for x, y in zip(ring, [*ring[1:], ring[0]])]
    if not pairs:
        return np.zeros(len(row), bool)
    r, x, y = np.array(pairs, np.int64).T
    nodes, m = np.unique(np.concatenate([row << 32 | a, row << 32 | b, r << 32 | x, r << 32 | y]), return_inverse=True)[1], len(row)
    high = nodes.max() + 1
    return np.isin(nodes[:m] * high + nodes[m : 2 * m], nodes[2 * m : 2 * m + len(r)] * high + nodes[2 * m + len(r) :])


def _once(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the bonds, in the order of (row, a, b), are not the same as the one before."""
    return np.concatenate([[True], (row[1:] != row[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(row)]


def _large(atoms: DataFrame, bonds: DataFrame) -> DataFrame | None:
    """(mol) of the molecules of more than WHOLE rows, which are few; None if there is none."""
    found = stored(atoms.select("mol").union(bonds.select("mol")).groupBy("mol").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WHOLE).select("mol"))
    if not found.isEmpty():
        return F.broadcast(found)
    drop_stored(found)
    return None


def fragments(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(mol, atom, fragment): the connected part an atom is in, named by its smallest atom."""
    large = _large(atoms, bonds)
    a, b = (x if large is None else x.join(large, "mol", "left_anti") for x in (atoms, bonds))

    def run(batches):
        for batch in batches:
            own, ties = batch.column("atoms"), batch.column("bonds")
            row, atom = np.repeat(np.arange(len(batch)), _lengths(own)), _numbers(own.flatten().field("atom"))
            of, place = np.repeat(np.arange(len(batch)), _lengths(ties)), row << 32 | atom
            x, y = (of << 32 | _numbers(ties.flatten().field(c)) for c in "ab")
            there = np.isin(x, place) & np.isin(y, place)
            x, y = np.searchsorted(place, x[there]), np.searchsorted(place, y[there])
            label = np.arange(len(place))
            while len(x):
                low = np.minimum(label[x], label[y])
                after = label.copy()
                for at in (x, y, label[x], label[y]):
                    np.minimum.at(after, at, low)
                after = after[after]
                if (after == label).all():
                    break
                label = after
            yield pa.RecordBatch.from_arrays([batch.column("mol").take(pa.array(row)), pa.array(atom, pa.int32()), pa.array(atom[label], pa.int32())], ["mol", "atom", "fragment"])

    kind = atoms.schema["mol"].dataType.simpleString()
    out = packed(a.select("mol", F.col("atom").cast("int").alias("atom")), b).mapInArrow(run, f"mol {kind}, atom int, fragment int")
    return out if large is None else out.union(_fragments_in_rounds(*(x.join(large, "mol", "left_semi") for x in (atoms, bonds))))


def _fragments_in_rounds(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """Each round, an atom takes the smallest name among its neighbours', then the name of that atom: names spread in
    leaps, and rounds grow with the logarithm of a chain's length. Stored after each round."""
    now = stored(atoms.select("mol", "atom", F.col("atom").alias("fragment")))
    ways = both_ways(bonds).select("mol", F.col("atom").alias("_to"), F.col("other").alias("atom"))
    while True:
        near = ways.join(now.hint("merge"), ["mol", "atom"]).groupBy("mol", F.col("_to").alias("atom")).agg(F.min("fragment").alias("near"))
        low = now.join(near.hint("merge"), ["mol", "atom"], "left").select("mol", "atom", "fragment", F.least("fragment", "near").alias("low"))
        names = low.select("mol", F.col("atom").alias("low"), F.col("low").alias("leap"))
        after = stored(low.join(names.hint("merge"), ["mol", "low"]).select("mol", "atom", F.least("low", "leap").alias("fragment"), (F.least("low", "leap") != F.col("fragment")).alias("moved")))
        drop_stored(now)
        now = after.select("mol", "atom", "fragment")
        if after.where("moved").isEmpty():
            return now


def _kept(atoms: DataFrame, bonds: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of both tables whose atoms are all among kept (mol, atom)."""
    ends = bonds
    for end in "ab":
        ends = ends.join(kept.select("mol", F.col("atom").alias(end)).hint("merge"), ["mol", end], "left_semi")
    return atoms.join(kept.hint("merge"), ["mol", "atom"], "left_semi"), ends.select("mol", "a", "b", "kind")


def largest_fragment(atoms: DataFrame, bonds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each molecule's fragment with the most atoms, hydrogens counted; ties: the heavier, then the one with the smallest atom."""
    full = stored(with_hydrogens(atoms, bonds))
    named = stored(fragments(full, bonds))
    weight = F.create_map(*[F.lit(x) for pair in ATOMIC_WEIGHT.items() for x in pair])
    sums = full.join(named.hint("merge"), ["mol", "atom"]).groupBy("mol", "fragment").agg(F.sum(F.col("hydrogens") + 1).alias("n"), F.sum(F.round(F.coalesce(F.try_element_at(weight, F.col("element")), F.lit(0.0)) * 1000).cast("long") + 1008 * F.col("hydrogens")).alias("w"))
    best = sums.groupBy("mol").agg(F.min(F.struct((-F.col("n")).alias("n"), (-F.col("w")).alias("w"), "fragment"))["fragment"].alias("fragment"))
    return _kept(atoms, bonds, stored(named.join(best.hint("merge"), ["mol", "fragment"], "left_semi")).select("mol", "atom"))


def core(bonds: DataFrame) -> DataFrame:
    """Bonds of rings and of the links between them: bonds that end in an atom without another are taken away, again and again."""
    none = bonds.select("mol", F.col("a").alias("atom")).limit(0)
    large = _large(none, bonds)
    b = bonds if large is None else bonds.join(large, "mol", "left_anti")

    def run(batches):
        for batch in batches:
            ties = batch.column("bonds")
            row = np.repeat(np.arange(len(batch)), _lengths(ties))
            x, y, kind = (_numbers(ties.flatten().field(c)) for c in ("a", "b", "kind"))
            once = np.flatnonzero(_once(row, x, y))
            kept = once[_pruned(row[once], x[once], y[once])]
            yield pa.RecordBatch.from_arrays([batch.column("mol").take(pa.array(row[kept])), *(pa.array(v[kept], pa.int32()) for v in (x, y, kind))], ["mol", "a", "b", "kind"])

    out = packed(none, b).mapInArrow(run, f"mol {bonds.schema['mol'].dataType.simpleString()}, a int, b int, kind int")
    return out if large is None else out.union(_core_in_rounds(bonds.join(large, "mol", "left_semi")))


def _core_in_rounds(bonds: DataFrame) -> DataFrame:
    now = stored(bonds.select("mol", "a", "b", "kind").dropDuplicates(["mol", "a", "b"]))
    n = now.count()
    while n:
        ends = both_ways(now).groupBy("mol", "atom").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mol", "atom")
        after = now
        for end in "ab":
            after = after.join(ends.select("mol", F.col("atom").alias(end)).hint("merge"), ["mol", end], "left_semi")
        after = stored(after.select("mol", "a", "b", "kind"))
        drop_stored(now)
        now, before, n = after, n, after.count()
        if n == before:
            break
    return now


def scaffold(atoms: DataFrame, bonds: DataFrame, generic: bool = False) -> tuple[DataFrame, DataFrame]:
    """The Murcko scaffold: rings, their links, and atoms that a double or triple bond ties to them. generic: all carbon, all bonds single.

    A molecule without a ring has no scaffold, so no rows.
    """
    inner = stored(core(bonds))
    own = both_ways(inner).select("mol", "atom").distinct()
    tied = both_ways(bonds.where("kind in (2, 3)")).join(own.hint("merge"), ["mol", "atom"], "left_semi").select("mol", F.col("other").alias("atom"))
    kept = own.union(tied).distinct() if not generic else own
    atoms, bonds = _kept(atoms, bonds, stored(kept))
    if generic:
        atoms = atoms.withColumns({"element": F.lit("C"), "charge": F.lit(0), "hydrogens": F.lit(None).cast("int"), "aromatic": F.lit(False)})
        bonds = bonds.withColumn("kind", F.lit(1))
    return atoms, bonds


def _cycle_basis(a: list[int], b: list[int]) -> list[list[int]]:
    """A smallest cycle basis of one connected or unconnected graph, each cycle as its atoms in order: the cycles that an
    atom's shortest-path tree closes with one bond more, shortest first, kept where independent of those before."""
    near: dict[int, list[int]] = {}
    bit = {}
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        near.setdefault(x, []).append(y)
        near.setdefault(y, []).append(x)
        bit[x, y] = bit[y, x] = 1 << k
    for ends in near.values():
        ends.sort()
    own = {x: 1 << k for k, x in enumerate(near)}
    found: dict[int, list[int]] = {}
    for root in sorted(near):
        # Of each atom: the one before it, and the bits of atoms (but for the root) and of bonds on its path.
        before, passed, bonds, order = {root: root}, {root: 0}, {root: 0}, [root]
        for x in order:
            for y in near[x]:
                if y not in before:
                    before[y], passed[y], bonds[y] = x, passed[x] | own[y], bonds[x] | bit[x, y]
                    order.append(y)
        for x, y in zip(a, b, strict=True):
            if x in before and not passed[x] & passed[y] and before[x] != y and before[y] != x:
                mask = bonds[x] | bonds[y] | bit[x, y]
                if mask not in found:
                    there, back = [x], [y]
                    for path in (there, back):
                        while path[-1] != root:
                            path.append(before[path[-1]])
                    found[mask] = there[::-1] + back[:-1]
    basis, pivots = [], {}
    for mask, ring in sorted(found.items(), key=lambda kv: (len(kv[1]), sorted(kv[1]))):
        rest = mask
        while rest and (top := rest.bit_length()) in pivots:
            rest ^= pivots[top]
        if rest:
            pivots[rest.bit_length()] = rest
            basis.append(ring)
    return basis


def smallest_rings(bonds: DataFrame) -> DataFrame:
    """(mol, ring, size, atoms): a smallest set of smallest rings, their atoms in order; the core of one molecule is one call's work."""
    none = bonds.select("mol", F.col("a").alias("atom")).limit(0)
    large = _large(none, bonds)
    kind = bonds.schema["mol"].dataType.simpleString()
    b = bonds if large is None else bonds.join(large, "mol", "left_anti")

    def run(batches):
        for batch in batches:
            ties = batch.column("bonds")
            row, (x, y) = np.repeat(np.arange(len(batch)), _lengths(ties)), (_numbers(ties.flatten().field(c)) for c in "ab")
            once = _once(row, x, y)
            rings = [(r, k, ring) for r, own in _ring_lists(row[once], x[once], y[once]) for k, ring in enumerate(own)]
            rows, places, atoms = zip(*rings) if rings else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("mol").take(pa.array(rows, pa.int64())), pa.array(places, pa.int32()), pa.array([len(r) for r in atoms], pa.int32()), pa.array(atoms, pa.list_(pa.int32()))], ["mol", "ring", "size", "atoms"])

    shape = f"mol {kind}, ring int, size int, atoms array<int>"
    out = packed(none, b).mapInArrow(run, shape)
    if large is None:
        return out

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["a", "b"])
        rings = _cycle_basis(pdf["a"].tolist(), pdf["b"].tolist())
        return pd.DataFrame({"mol": [pdf["mol"].iloc[0]] * len(rings), "ring": range(len(rings)), "size": [len(r) for r in rings], "atoms": rings})

    return out.union(_core_in_rounds(bonds.join(large, "mol", "left_semi")).groupBy("mol").applyInPandas(one, shape))


def ring_bonds(rings: DataFrame) -> DataFrame:
    """(mol, a, b): bonds that are in a ring."""
    ends = F.zip_with("atoms", F.concat(F.slice("atoms", F.lit(2), F.size("atoms")), F.slice("atoms", 1, 1)), lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")))
    return rings.select("mol", F.inline(ends)).distinct()


def with_hydrogens(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """atoms with hydrogens filled in where null: the usual valence less the sum of bond orders (aromatic: 1.5, the sum rounded), or none."""
    order = F.when(F.col("kind") == 4, 1.5).otherwise(F.col("kind").cast("double"))
    sums = both_ways(bonds).groupBy("mol", "atom").agg(F.round(F.sum(order)).cast("int").alias("_used"))
    valence = F.create_map(*[F.lit(x) for (e, c), v in VALENCES.items() for x in (f"{e}{c}", v)])
    usual = F.try_element_at(valence, F.concat("element", F.col("charge").cast("string")))
    free = F.coalesce(F.greatest(usual - F.coalesce("_used", F.lit(0)), F.lit(0)), F.lit(0))
    return atoms.join(sums.hint("merge"), ["mol", "atom"], "left").withColumn("hydrogens", F.coalesce("hydrogens", free)).drop("_used")


def add_hydrogens(atoms: DataFrame, bonds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hydrogens as atoms of their own, numbered after the others of their molecule in the order of the atoms that bear them."""
    from pyspark.sql.window import Window

    full = stored(with_hydrogens(atoms, bonds))
    before = Window.partitionBy("mol").orderBy("atom").rowsBetween(Window.unboundedPreceding, -1)
    placed = full.withColumn("_before", F.coalesce(F.sum("hydrogens").over(before), F.lit(0))).withColumn("_last", F.max("atom").over(Window.partitionBy("mol"))).where("hydrogens > 0")
    new = placed.select("mol", F.col("atom").alias("a"), F.explode(F.expr("sequence(_last + 1 + _before, _last + _before + hydrogens)")).alias("b")).withColumn("b", F.col("b").cast("int"))
    added = new.select("mol", F.col("b").alias("atom"), F.lit("H").alias("element"), F.lit(0).alias("charge"), F.lit(0).alias("hydrogens"), F.lit(False).alias("aromatic"))
    return full.withColumn("hydrogens", F.lit(0)).unionByName(added), bonds.unionByName(new.withColumn("kind", F.lit(1)))


def remove_hydrogens(atoms: DataFrame, bonds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without neutral hydrogens that one single bond ties to another element; their bearers count them as their own."""
    is_h = atoms.where("element = 'H' and charge = 0").select("mol", "atom")
    ways = both_ways(bonds)
    one = ways.groupBy("mol", "atom").agg(F.count(F.lit(1)).alias("n"), F.first("other").alias("other"), F.first("kind").alias("kind")).where("n = 1 and kind = 1")
    gone = stored(one.join(is_h.hint("merge"), ["mol", "atom"], "left_semi").select("mol", "atom", "other").join(is_h.withColumnRenamed("atom", "other").hint("merge"), ["mol", "other"], "left_anti"))
    lost = gone.groupBy("mol", F.col("other").alias("atom")).agg(F.count(F.lit(1)).cast("int").alias("_lost"))
    rest = stored(with_hydrogens(atoms, bonds).join(gone.hint("merge"), ["mol", "atom"], "left_anti").join(lost.hint("merge"), ["mol", "atom"], "left"))
    rest = rest.withColumn("hydrogens", (F.col("hydrogens") + F.coalesce("_lost", F.lit(0))).cast("int")).drop("_lost")
    return rest, _kept(rest, bonds, rest.select("mol", "atom"))[1]


def _combined(h: np.ndarray, value: np.ndarray) -> np.ndarray:
    return ((h ^ value) * FNV) & 0xFFFFFFFF


@dataclass
class Perceived:
    """What descriptors, fingerprints and patterns read: molecules (mol, atoms, near, rings), a stored record each.

    atoms: their rows in order, hydrogens being rows and others, with degree and in_ring. near: of each atom, the place in
    atoms (to) and kind of each neighbour, whether the bond is in a ring. rings: smallest_rings, and whether all atoms are aromatic.
    """

    molecules: DataFrame

    @property
    def atoms(self) -> DataFrame:
        return self.molecules.select("mol", F.inline("atoms"))

    @property
    def edges(self) -> DataFrame:
        """(mol, atom, other, kind, o_...): each bond from either end with what is at the other."""
        seen = [c for c in self.molecules.schema["atoms"].dataType.elementType.names if c != "atom"]
        at = lambda i: F.get("atoms", i)
        edge = lambda p, e: F.struct(at(p)["atom"].alias("atom"), at(e["to"])["atom"].alias("other"), e["kind"].alias("kind"), *(at(e["to"])[c].alias(f"o_{c}") for c in seen))
        return self.molecules.select("mol", F.inline(F.flatten(F.transform("near", lambda n, p: F.transform(n, lambda e: edge(p, e))))))

    @property
    def rings(self) -> DataFrame:
        return self.molecules.select("mol", F.inline("rings")).drop("aromatic")

    def drop(self) -> None:
        """Deletes the stored table."""
        drop_stored(self.molecules)


_RECORD = (
    "atoms array<struct<atom: int, element: string, charge: int, hydrogens: int, aromatic: boolean, degree: int, in_ring: int>>, "
    "near array<array<struct<to: int, kind: int, in_ring: boolean>>>, rings array<struct<ring: int, size: int, atoms: array<int>, aromatic: boolean>>"
)


def _offsets(n: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())


def _perceived(batches):
    """Records (mol, atoms, near, rings) from packed ones."""
    usual = {f"{e}{c}": v for (e, c), v in VALENCES.items()}
    for batch in batches:
        own, ties = batch.column("atoms"), batch.column("bonds")
        own_n, n = _lengths(own), len(batch)
        row, atoms = np.repeat(np.arange(n), own_n), own.flatten()
        place = row << 32 | _numbers(atoms.field("atom"))
        of, (a, b, kind) = np.repeat(np.arange(n), _lengths(ties)), (_numbers(ties.flatten().field(c)) for c in ("a", "b", "kind"))
        kept = np.flatnonzero(_once(of, a, b) & np.isin(of << 32 | a, place) & np.isin(of << 32 | b, place))
        of, a, b, kind = of[kept], a[kept], b[kept], kind[kept]
        x, y = np.searchsorted(place, of << 32 | a), np.searchsorted(place, of << 32 | b)
        rings = [(r, k, ring) for r, some in _ring_lists(of, a, b) for k, ring in enumerate(some)]
        ring_n, ring_row = np.array([len(r[2]) for r in rings], np.int64), np.array([r[0] for r in rings], np.int64)
        ring_at = np.searchsorted(place, np.repeat(ring_row, ring_n) << 32 | np.array([i for r in rings for i in r[2]], np.int64))
        start = np.cumsum(ring_n) - ring_n
        after = np.arange(len(ring_at)) + 1
        after[start + ring_n - 1] = start
        pair = lambda u, v: np.minimum(u, v) * max(1, len(place)) + np.maximum(u, v)
        tie_in_ring = np.isin(pair(x, y), pair(ring_at, ring_at[after]))
        in_ring = np.zeros(len(place), np.int64)
        in_ring[ring_at] = 1
        (element, names), charge = _coded(atoms.field("element")), _numbers(atoms.field("charge"))
        count = lambda at, w=None: np.bincount(at, w, len(place))
        used = np.floor(count(np.concatenate([x, y]), np.tile(np.where(kind == 4, 1.5, kind), 2)) + 0.5).astype(np.int64)
        both, code = np.unique(element << 32 | (charge + (1 << 31)), return_inverse=True)
        free = np.maximum(np.array([usual.get(f"{names[k >> 32]}{(k & 0xFFFFFFFF) - (1 << 31)}", 0) for k in both.tolist()], np.int64)[code] - used, 0) if len(place) else used
        given = _numbers(atoms.field("hydrogens"), -1)
        is_h = element == (names.index("H") if "H" in names else -2)
        hydrogens = np.where(given >= 0, given, free) + count(x, is_h[y]).astype(np.int64) + count(y, is_h[x]).astype(np.int64)
        degree = count(x) + count(y)
        soft = _numbers(atoms.field("aromatic")).astype(bool)
        ints = lambda v: pa.array(v, pa.int32())
        record = pa.StructArray.from_arrays([atoms.field("atom").cast(pa.int32()), atoms.field("element"), ints(charge), ints(hydrogens), pa.array(soft), ints(degree), ints(in_ring)], ["atom", "element", "charge", "hydrogens", "aromatic", "degree", "in_ring"])
        order = np.lexsort((np.concatenate([y, x]), np.concatenate([x, y])))
        first = (np.cumsum(own_n) - own_n)[row]
        to = np.concatenate([y, x])[order]
        edge = pa.StructArray.from_arrays([ints(to - first[to]), ints(np.tile(kind, 2)[order]), pa.array(np.tile(tie_in_ring, 2)[order])], ["to", "kind", "in_ring"])
        near = pa.ListArray.from_arrays(_offsets(degree), edge)
        all_soft = np.add.reduceat(soft[ring_at].astype(np.int64), start) == ring_n if len(rings) else np.zeros(0, bool)
        lists = pa.ListArray.from_arrays(_offsets(ring_n), atoms.field("atom").cast(pa.int32()).take(pa.array(ring_at, pa.int64())))
        ring = pa.StructArray.from_arrays([ints([r[1] for r in rings]), ints(ring_n), lists, pa.array(all_soft)], ["ring", "size", "atoms", "aromatic"])
        columns = [batch.column("mol"), *(pa.ListArray.from_arrays(_offsets(k), v) for k, v in ((own_n, record), (own_n, near), (np.bincount(ring_row, minlength=n), ring)))]
        yield pa.RecordBatch.from_arrays(columns, ["mol", "atoms", "near", "rings"])


def perceive(atoms: DataFrame, bonds: DataFrame) -> Perceived:
    """Stores what is to be known of each atom and bond, one record a molecule, by one shuffle. Bonds are taken once each, those of
    missing atoms not at all; hydrogens are as in with_hydrogens(), rings as in smallest_rings()."""
    bonds = bonds.where("a != b").select("mol", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "kind")
    atoms = atoms.select("mol", "atom", "element", "charge", "hydrogens", "aromatic")
    return Perceived(stored(packed(atoms, bonds).where(F.size("atoms") > 0).mapInArrow(_perceived, f"mol {atoms.schema['mol'].dataType.simpleString()}, {_RECORD}")))


class _Graphs:
    """A batch of records as flat arrays: atoms of all molecules one after the other, and from start on each one's bonds, sorted by the other end."""

    COLUMNS = ("element", "charge", "hydrogens", "aromatic", "degree", "in_ring")

    def __init__(self, batch: pa.RecordBatch):
        own = _lengths(batch.column("element"))
        self.row = np.repeat(np.arange(len(batch)), own)
        self.seen = {c: _numbers(batch.column(c).flatten()) for c in self.COLUMNS[1:]}
        self.seen["element"], self.names = _coded(batch.column("element").flatten())
        near = batch.column("near").flatten()
        self.n_bonds = _lengths(near)
        self.start = np.cumsum(self.n_bonds) - self.n_bonds
        self.from_ = np.repeat(np.arange(len(self.row)), self.n_bonds)
        edges = near.flatten()
        self.to = _numbers(edges.field("to")) + (np.cumsum(own) - own)[self.row[self.from_]]
        self.kind = _numbers(edges.field("kind"))

    @classmethod
    def of(cls, seen: Perceived) -> DataFrame:
        """The columns that a batch is read from."""
        return seen.molecules.select("mol", "atoms.atom", *(f"atoms.{c}" for c in cls.COLUMNS), "near")


def _rounds(g: _Graphs, radius: int) -> list[np.ndarray]:
    """Of each round, the atoms' identifiers."""
    number = {e: k + 1 for k, e in enumerate(ELEMENTS)}
    h = np.array([number.get(e, 0) for e in g.names], np.int64)[g.seen["element"]]
    for part in (g.seen["degree"], g.seen["hydrogens"], g.seen["charge"] + 5, g.seen["in_ring"]):
        h = _combined(h, part & 0xFFFFFFFF)
    ids = [h]
    for _ in range(radius):
        near = h[g.to]
        order = np.lexsort((near, g.kind, g.from_))
        near, kind = near[order], g.kind[order]
        h, at, place = h.copy(), np.argsort(-g.n_bonds, kind="stable"), 0
        more = np.bincount(g.n_bonds)[::-1].cumsum()[::-1]  # atoms of at least so many bonds
        for place in range(len(more) - 1):
            some = at[: more[place + 1]]
            edge = g.start[some] + place
            h[some] = _combined(_combined(h[some], kind[edge]), near[edge])
        ids.append(h)
    return ids


def identifiers(seen: Perceived, radius: int = 2) -> DataFrame:
    """(mol, atom, round, id): extended-connectivity identifiers (Rogers and Hahn, 2010), 32 bits each, of rounds 0 to radius.

    Round 0 hashes atomic number, degree, hydrogens, charge + 5 and ring membership. Each round hashes an atom's
    identifier with its neighbours' (kind of bond, identifier), sorted; all inside a molecule's record.
    """

    def run(batches):
        for batch in batches:
            g, atom = _Graphs(batch), _numbers(batch.column("atom").flatten())
            mol = batch.column("mol").take(pa.array(g.row))
            for k, ids in enumerate(_rounds(g, radius)):
                yield pa.RecordBatch.from_arrays([mol, pa.array(atom, pa.int32()), pa.array(np.full(len(ids), k), pa.int32()), pa.array(ids)], ["mol", "atom", "round", "id"])

    return _Graphs.of(seen).mapInArrow(run, f"mol {seen.molecules.schema['mol'].dataType.simpleString()}, atom int, round int, id long")


def fingerprints(seen: Perceived, radius: int = 2, n_bits: int = 2048) -> DataFrame:
    """(mol, on, fingerprint): the bits that identifiers set modulo n_bits, ascending, and the same as longs of 63 bits, as neighbours.similarity takes them."""

    def run(batches):
        for batch in batches:
            g = _Graphs(batch)
            bits = np.unique(np.concatenate([g.row << 32 | ids % n_bits for ids in _rounds(g, radius)]))
            on = pa.ListArray.from_arrays(_offsets(np.bincount(bits >> 32, minlength=len(batch))), pa.array(bits & 0xFFFFFFFF, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("mol"), on], ["mol", "on"])

    on = _Graphs.of(seen).mapInArrow(run, f"mol {seen.molecules.schema['mol'].dataType.simpleString()}, on array<int>")
    words = F.sequence(F.lit(0), F.lit((n_bits - 1) // 63))
    place = lambda i, w: F.least(F.lit(63), F.lit(n_bits) - w * 63) - 1 - i % 63
    packed = F.transform(words, lambda w: F.aggregate(F.filter("on", lambda i: F.floor(i / 63) == w), F.lit(0).cast("long"), lambda s, i: s + F.call_function("shiftleft", F.lit(1).cast("long"), place(i, w).cast("int"))))
    return on.select("mol", "on", packed.alias("fingerprint"))


_PRIMITIVE = re.compile(r"(!?)(#\d+|D\d+|H\d*|R\d*|[+-]\d*|\*|Cl|Br|[A-Z][a-z]?|[bcnops])")


def _atom_test(token: str) -> list[list[tuple[bool, list[tuple[str, object]]]]]:
    """Of a pattern's atom: choices, each of them tests that must all hold, each of them (whether not, what columns must be)."""

    def one(sign: str, what: str) -> tuple[bool, list[tuple[str, object]]]:
        if what == "*":
            test = []
        elif what[0] == "#":
            test = [("element", ELEMENTS[int(what[1:]) - 1])]
        elif re.fullmatch(r"D\d+", what):
            test = [("degree", int(what[1:]))]
        elif re.fullmatch(r"H\d*", what):
            test = [("hydrogens", int(what[1:] or 1))]
        elif re.fullmatch(r"R\d*", what):
            test = [("in_ring", 0 if what == "R0" else 1)]
        elif what[0] in "+-":
            test = [("charge", int(what[1:] or 1) * (1 if what[0] == "+" else -1))]
        else:
            test = [("element", what.capitalize()), ("aromatic", int(what[0].islower()))]
        return bool(sign), test

    if not token.startswith("["):
        return [[one("", token)]]
    choices = []
    for choice in token[1:-1].split(","):
        parts = _PRIMITIVE.findall(choice)
        if not parts or "".join(a + b for a, b in parts) != re.sub("[&;]", "", choice):
            raise OperatorError(f"cannot read {token!r}")
        choices.append([one(*p) for p in parts])
    return choices


def _fits(choices: list, g: _Graphs) -> np.ndarray:
    """Which atoms pass a test; an unknown element neither is nor is not another."""

    def is_(column: str, value: object, wanted: bool) -> np.ndarray:
        if column != "element":
            return (g.seen[column] == value) == wanted
        code = g.names.index(value) if value in g.names else len(g.names)
        return ((g.seen[column] == code) == wanted) & (g.seen[column] >= 0)

    n = len(g.row)
    holds = lambda not_, test: np.logical_or.reduce([np.zeros(n, bool), *(is_(*t, False) for t in test)]) if not_ else np.logical_and.reduce([np.ones(n, bool), *(is_(*t, True) for t in test)])
    return np.logical_or.reduce([np.logical_and.reduce([holds(*t) for t in tests]) for tests in choices])


_BOND_KINDS = {"": (1, 4), "-": (1,), "=": (2,), "#": (3,), ":": (4,), "/": (1,), "\\": (1,)}


def matching(seen: Perceived, pattern: str) -> DataFrame:
    """(mol) that have the pattern: a SMILES whose atoms may be `*` or bracketed choices like [C,N], [#6], [!C], [OH], [D2], [R], [N+], and whose bonds may be `~`.

    Partial matches grow inside the molecules' records, by one step along their bonds for each atom of the pattern; each bond
    that closes a ring then leaves out those without it.
    """
    return _first_matching(seen, [pattern]).select("mol")


def _first_matching(seen: Perceived, patterns: list[str]) -> DataFrame:
    """(mol, place): of molecules that have any of the patterns, the place of the first they have."""
    wanted = _read(seen.molecules.sparkSession, patterns)

    def run(batches):
        for batch in batches:
            g, first = _Graphs(batch), np.full(len(batch), -1)
            for k, pattern in enumerate(wanted):
                first[_found(g, pattern, first >= 0)] = k
            rows = np.flatnonzero(first >= 0)
            yield pa.RecordBatch.from_arrays([batch.column("mol").take(pa.array(rows)), pa.array(first[rows], pa.int32())], ["mol", "place"])

    return _Graphs.of(seen).mapInArrow(run, f"mol {seen.molecules.schema['mol'].dataType.simpleString()}, place int")


def _read(spark, patterns: list[str]) -> list[tuple[list, list]]:
    """Of each pattern, its atoms' tests and, of each atom, its bonds to earlier ones: (place, kinds, None for any)."""
    texts = spark.range(1).select(F.posexplode(F.array(*(F.lit(p.strip()) for p in patterns))).alias("k", "text"))  # patterns, no data
    read = []
    for pattern, g in zip(patterns, (r["g"] for r in sorted(texts.select("k", _linked(F.col("text")).alias("g")).collect())), strict=True):
        if not g["ok"]:
            raise OperatorError(f"cannot read the pattern {pattern!r}")
        tests = [_atom_test(t) for t in g["atoms"]]
        ties = [[(min(x["a"], x["b"]), None if x["sign"] == "~" else _BOND_KINDS[x["sign"]]) for x in g["bonds"] if max(x["a"], x["b"]) == k and x["a"] != x["b"]] for k in range(len(tests))]
        if not all(ties[1:]):
            raise OperatorError("patterns of several parts are not matched")
        read.append((tests, ties))
    return read


def _found(g: _Graphs, pattern: tuple[list, list], told: np.ndarray) -> np.ndarray:
    """Which molecules, but for those told of, have the pattern. The furthest matches grow first and those of found molecules are dropped, so that few are held."""
    tests, ties = pattern
    fits = [_fits(t, g) for t in tests]
    may = lambda edge, kinds: np.ones(len(edge), bool) if kinds is None else np.isin(g.kind[edge], kinds)
    hit, left = np.zeros(len(told), bool), [np.flatnonzero(fits[0])[:, None]]
    keys = g.from_ * len(g.row) + g.to
    while left:
        some = left.pop()
        some = some[~(hit | told)[g.row[some[:, 0]]]]
        k = some.shape[1]
        if k == len(tests):
            hit[g.row[some[:, 0]]] = True
            continue
        (from_, kinds), *closed = ties[k]
        n = g.n_bonds[some[:, from_]]
        if n.sum() > PARTIAL and len(some) > 1:
            left += [some[len(some) // 2 :], some[: len(some) // 2]]
            continue
        of = np.repeat(np.arange(len(some)), n)
        edge = np.arange(len(of)) + np.repeat(g.start[some[:, from_]] - np.cumsum(n) + n, n)
        to = g.to[edge]
        grown = np.flatnonzero(fits[k][to] & may(edge, kinds) & (some[of] != to[:, None]).all(1))
        some = np.column_stack([some[of[grown]], to[grown]])
        for from_, kinds in closed:
            key = some[:, from_] * len(g.row) + some[:, k]
            edge = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
            some = some[(keys[edge] == key) & may(edge, kinds)] if len(some) else some
        if len(some):
            left.append(some)
    return hit


def substructure_filter(df: DataFrame, key: str, seen: Perceived, pattern: str) -> dict[str, DataFrame]:
    """matches and rejects of df by the pattern; rows without a parsed structure are rejects."""
    have = matching(seen, pattern).select(F.col("mol").alias("_mol")).hint("merge")
    return {"matches": df.join(have, q(key) == F.col("_mol"), "left_semi"), "rejects": df.join(have, q(key) == F.col("_mol"), "left_anti")}


def catalogue_filter(df: DataFrame, key: str, seen: Perceived, alerts: dict[str, str], clean: bool = True) -> dict[str, DataFrame]:
    """matches: rows without any of the alerts (clean) or with one; rejects: the others, with the name of the first alert they have.

    Without alerts all rows match."""
    if not alerts:
        return {"matches": df, "rejects": df.limit(0).withColumn("alert", F.lit(None).cast("string"))}
    names = F.array(*map(F.lit, alerts))
    first = _first_matching(seen, list(alerts.values())).select(F.col("mol").alias("_mol"), F.get(names, F.col("place")).alias("alert")).hint("merge")
    told = df.join(first, q(key) == F.col("_mol"), "left").drop("_mol")
    hit, free = told.where("alert is not null"), told.where("alert is null")
    return {"matches": free.drop("alert"), "rejects": hit} if clean else {"matches": hit.drop("alert"), "rejects": free}


def descriptors(seen: Perceived) -> DataFrame:
    """One row a molecule: mol_weight (rounded to 4 places), heavy_atoms, formal_charge, h_donors (N and O with hydrogen), h_acceptors (N and O), rotatable_bonds
    (single, in no ring, between atoms of two heavy neighbours or more), rings and aromatic_rings (all atoms aromatic). An element without a known weight gives a null weight."""
    weight = F.create_map(*[F.lit(x) for pair in ATOMIC_WEIGHT.items() for x in (pair[0], round(pair[1] * 1000))])
    mass = lambda x: F.try_element_at(weight, x["element"])
    element = lambda i: F.get("atoms", i)["element"]
    heavy = lambda n: F.size(F.filter(n, lambda e: element(e["to"]) != "H"))
    own = lambda x, i: x["hydrogens"] - (F.size(F.get("near", i)) - heavy(F.get("near", i)))
    grams = F.aggregate(F.transform("atoms", lambda x, i: mass(x) + 1008 * own(x, i)), F.lit(0).cast("long"), lambda s, v: s + v)
    count = lambda test: F.size(F.filter("atoms", test))
    no = lambda x: x["element"].isin("N", "O")
    loose = lambda n, i: F.size(F.filter(n, lambda e: (e["kind"] == 1) & (e["to"] > i) & ~e["in_ring"] & (heavy(n) > 1) & (heavy(F.get("near", e["to"])) > 1)))
    return seen.molecules.select(
        "mol", F.round(grams / 1000, 4).alias("mol_weight"), count(lambda x: x["element"] != "H").alias("heavy_atoms"), F.aggregate("atoms", F.lit(0), lambda s, x: s + x["charge"]).alias("formal_charge"),
        count(lambda x: no(x) & (x["hydrogens"] > 0)).alias("h_donors"), count(no).alias("h_acceptors"), F.aggregate(F.transform("near", loose), F.lit(0), lambda s, v: s + v).alias("rotatable_bonds"),
        F.size("rings").alias("rings"), F.size(F.filter("rings", lambda r: r["aromatic"])).alias("aromatic_rings"),
    )
