"""Queries of molecules as atom and bond rows, of boosting and of Shapley values, with SQL. Molecules are derived from the whole table part."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import structures as st
from .registry import query, table

# A molecule for each part: a chain with branches and gaps, to which rings are added; expressions that both engines read.
_ELEMENT = "CASE (mol * 7 + atom * 3) % 10 WHEN 6 THEN 'N' WHEN 7 THEN 'O' WHEN 8 THEN 'S' WHEN 9 THEN 'F' ELSE 'C' END"
_CHARGE = "CASE WHEN (mol + atom * 5) % 23 = 0 THEN 1 ELSE 0 END"
_PARENT = "CASE WHEN (mol + atom) % 11 = 0 THEN NULL WHEN (mol + atom) % 5 = 0 THEN greatest(atom - 2, 0) ELSE atom - 1 END"
_KIND = "CASE WHEN (mol + atom * atom) % 6 = 0 THEN 2 ELSE 1 END"
_CLOSES = "atom >= 5 AND (mol * 3 + atom) % 7 = 0"


def _molecules(spark, d):
    parts = st.spread(table(spark, d, "part").selectExpr("p_partkey AS mol", "p_size"), "mol")  # a part of few bytes is much work
    grown = parts.selectExpr("mol", "explode(sequence(0, 5 + cast(p_size % 15 AS int))) AS atom")
    atoms = grown.selectExpr("mol", "atom", f"{_ELEMENT} AS element", f"{_CHARGE} AS charge", "cast(null AS int) AS hydrogens", "false AS aromatic")
    chain = grown.where("atom > 0").selectExpr("mol", f"{_PARENT} AS a", "atom AS b", f"{_KIND} AS kind").where("a IS NOT NULL")
    return atoms, chain.union(grown.where(_CLOSES).selectExpr("mol", "atom - 5", "atom", "1"))


_GRAPH = f"""grown AS (SELECT p_partkey AS mol, unnest(range(6 + p_size % 15))::INTEGER AS atom FROM part),
bare AS (SELECT mol, atom, {_ELEMENT} AS element, {_CHARGE} AS charge FROM grown),
bonds AS (SELECT * FROM (SELECT mol, {_PARENT} AS a, atom AS b, {_KIND} AS kind FROM grown WHERE atom > 0) WHERE a IS NOT NULL UNION ALL SELECT mol, atom - 5, atom, 1 FROM grown WHERE {_CLOSES}),
edges AS (SELECT mol, a AS atom, b AS other, kind FROM bonds UNION ALL SELECT mol, b, a, kind FROM bonds),
degrees AS (SELECT mol, atom, count(*) AS degree, sum(kind) AS used FROM edges GROUP BY 1, 2),
atoms AS (SELECT mol, atom, element, charge, coalesce(degree, 0)::INTEGER AS degree, greatest(0, CASE element || charge WHEN 'C0' THEN 4 WHEN 'C1' THEN 3 WHEN 'N0' THEN 3 WHEN 'N1' THEN 4 WHEN 'O0' THEN 2
  WHEN 'O1' THEN 3 WHEN 'S0' THEN 2 WHEN 'S1' THEN 3 WHEN 'F0' THEN 1 ELSE 0 END - coalesce(used, 0))::INTEGER AS h FROM bare LEFT JOIN degrees USING (mol, atom))"""
_PARTS = """reached AS (SELECT mol, atom, atom AS root FROM bare UNION SELECT e.mol, e.other, r.root FROM reached r JOIN edges e ON r.mol = e.mol AND r.atom = e.atom),
parts AS (SELECT mol, atom, min(root) AS fragment FROM reached GROUP BY 1, 2)"""
_RINGS = """around AS (SELECT mol, a, b, a AS atom FROM bonds UNION SELECT r.mol, r.a, r.b, e.other FROM around r JOIN edges e ON r.mol = e.mol AND r.atom = e.atom AND NOT (r.a = least(e.atom, e.other) AND r.b = greatest(e.atom, e.other))),
ring_bonds AS (SELECT mol, a, b FROM around WHERE atom = b), ring_atoms AS (SELECT mol, a AS atom FROM ring_bonds UNION SELECT mol, b FROM ring_bonds)"""


@query(f"WITH RECURSIVE {_GRAPH}, {_PARTS} SELECT mol, atom, fragment FROM parts")
def molecule_fragments(spark, d):
    return st.fragments(*_molecules(spark, d))


@query(f"""WITH RECURSIVE {_GRAPH}, {_PARTS},
sums AS (SELECT mol, fragment, count(*) AS n, sum(1 + h) AS full_size, sum(CASE element WHEN 'C' THEN 12011 WHEN 'N' THEN 14007 WHEN 'O' THEN 15999 WHEN 'S' THEN 32060 WHEN 'F' THEN 18998 END + 1008 * h) AS w FROM parts JOIN atoms USING (mol, atom) GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY mol ORDER BY full_size DESC, w DESC, fragment) AS place FROM sums),
ties AS (SELECT b.mol, p.fragment, count(*) AS n_bonds FROM bonds b JOIN parts p ON p.mol = b.mol AND p.atom = b.a GROUP BY 1, 2)
SELECT mol, n AS n_atoms, coalesce(n_bonds, 0) AS n_bonds FROM best LEFT JOIN ties USING (mol, fragment) WHERE place = 1""")
def molecule_largest_fragment(spark, d):
    atoms, bonds = st.largest_fragment(*_molecules(spark, d))
    ties = bonds.groupBy("mol").agg(F.count(F.lit(1)).alias("n_bonds"))
    return atoms.groupBy("mol").agg(F.count(F.lit(1)).alias("n_atoms")).join(ties, "mol", "left").fillna(0)


@query(f"""WITH RECURSIVE {_GRAPH}, {_PARTS}, {_RINGS}, na AS (SELECT mol, count(*) AS n, count(DISTINCT fragment) AS f FROM parts GROUP BY 1), nb AS (SELECT mol, count(*) AS m FROM bonds GROUP BY 1), nr AS (SELECT mol, count(*) AS ring_atoms FROM ring_atoms GROUP BY 1)
SELECT mol, m - n + f AS rings, ring_atoms FROM na JOIN nb USING (mol) JOIN nr USING (mol)""")
def molecule_rings(spark, d):
    rings = st.smallest_rings(_molecules(spark, d)[1])
    return rings.groupBy("mol").agg(F.count(F.lit(1)).alias("rings"), F.size(F.array_distinct(F.flatten(F.collect_list("atoms")))).cast("long").alias("ring_atoms"))


def _pruned(rounds: int) -> str:
    """Rounds of taking away bonds that end in an atom without another; as many as a molecule can have atoms."""
    steps = ["k0 AS (SELECT mol, a, b FROM bonds)"]
    for k in range(rounds):
        ends = f"SELECT mol, i FROM (SELECT mol, a AS i FROM k{k} UNION ALL SELECT mol, b FROM k{k}) GROUP BY 1, 2 HAVING count(*) > 1"
        steps.append(f"e{k} AS MATERIALIZED ({ends}), k{k + 1} AS MATERIALIZED (SELECT k.* FROM k{k} k JOIN e{k} x ON x.mol = k.mol AND x.i = k.a JOIN e{k} y ON y.mol = k.mol AND y.i = k.b)")
    return ", ".join(steps)


@query(f"""WITH {_GRAPH}, {_pruned(20)}, own AS (SELECT mol, a AS atom FROM k20 UNION SELECT mol, b FROM k20), tied AS (SELECT e.mol, e.other AS atom FROM edges e JOIN own USING (mol, atom) WHERE kind IN (2, 3)),
kept AS (SELECT * FROM own UNION SELECT * FROM tied), n AS (SELECT mol, count(*) AS n_atoms, sum(CASE WHEN element = 'C' THEN 1 ELSE 0 END)::BIGINT AS n_carbons FROM kept JOIN atoms USING (mol, atom) GROUP BY 1),
m AS (SELECT b.mol, count(*) AS n_bonds FROM bonds b JOIN kept x ON x.mol = b.mol AND x.atom = b.a JOIN kept y ON y.mol = b.mol AND y.atom = b.b GROUP BY 1) SELECT mol, n_atoms, n_carbons, n_bonds FROM n JOIN m USING (mol)""")
def molecule_scaffolds(spark, d):
    atoms, bonds = st.scaffold(*_molecules(spark, d))
    n = atoms.groupBy("mol").agg(F.count(F.lit(1)).alias("n_atoms"), F.count(F.when(F.col("element") == "C", 1)).alias("n_carbons"))
    return n.join(bonds.groupBy("mol").agg(F.count(F.lit(1)).alias("n_bonds")), "mol")


def _hash(h: str, *values: str) -> str:
    for v in values:
        h = f"((xor({h}, ({v})::BIGINT) * {st.FNV}) & 4294967295)"
    return h


def _round(k: int) -> str:
    near = f"SELECT e.mol, e.atom, list({{'kind': e.kind::BIGINT, 'id': i.id}} ORDER BY e.kind, i.id) AS near FROM edges e JOIN i{k} i ON i.mol = e.mol AND i.atom = e.other GROUP BY 1, 2"
    told = f"list_reduce(list_concat([{{'kind': 0::BIGINT, 'id': id}}], near), lambda s, x: {{'kind': 0::BIGINT, 'id': {_hash('s.id', 'x.kind', 'x.id')}}}).id"
    return f"n{k} AS ({near}), i{k + 1} AS MATERIALIZED (SELECT i.mol, i.atom, coalesce({told}, id) AS id FROM i{k} i LEFT JOIN n{k} n USING (mol, atom))"


_IDENTIFIERS = f"""i0 AS MATERIALIZED (SELECT mol, atom, {_hash("CASE element WHEN 'C' THEN 6 WHEN 'N' THEN 7 WHEN 'O' THEN 8 WHEN 'F' THEN 9 ELSE 16 END::BIGINT", "degree", "h", "charge + 5", "CASE WHEN r.atom IS NULL THEN 0 ELSE 1 END")} AS id
FROM atoms LEFT JOIN (SELECT mol AS rm, atom FROM ring_atoms) r ON mol = rm AND atoms.atom = r.atom), {_round(0)}, {_round(1)}""".replace("SELECT mol, atom, ((", "SELECT mol, atoms.atom AS atom, ((", 1)


@query(f"WITH RECURSIVE {_GRAPH}, {_RINGS}, {_IDENTIFIERS} SELECT DISTINCT mol, (id % 2048)::INTEGER AS bit FROM (SELECT mol, id FROM i0 UNION ALL SELECT mol, id FROM i1 UNION ALL SELECT mol, id FROM i2)")
def molecule_fingerprints(spark, d):
    return st.fingerprints(st.perceive(*_molecules(spark, d)), 2, 2048).select("mol", F.explode("on").alias("bit"))


_HITS = {
    "amide_like": ("[C,S](=O)N", "SELECT DISTINCT x.mol FROM atoms x JOIN edges e USING (mol, atom) JOIN atoms o ON o.mol = e.mol AND o.atom = e.other JOIN edges f ON f.mol = x.mol AND f.atom = x.atom JOIN atoms n ON n.mol = f.mol AND n.atom = f.other WHERE x.element IN ('C', 'S') AND e.kind = 2 AND o.element = 'O' AND f.kind = 1 AND n.element = 'N'"),
    "six_ring": ("C1~*~*~*~*~*~1", "SELECT DISTINCT x.mol FROM atoms x JOIN edges e1 USING (mol, atom) JOIN edges e2 ON e2.mol = x.mol AND e2.atom = e1.other JOIN edges e3 ON e3.mol = x.mol AND e3.atom = e2.other JOIN edges e4 ON e4.mol = x.mol AND e4.atom = e3.other JOIN edges e5 ON e5.mol = x.mol AND e5.atom = e4.other JOIN edges e6 ON e6.mol = x.mol AND e6.atom = e5.other AND e6.other = x.atom WHERE x.element = 'C' AND len(list_distinct([x.atom, e1.other, e2.other, e3.other, e4.other, e5.other])) = 6"),
    "charged": ("[#7+]", "SELECT DISTINCT mol FROM atoms WHERE element = 'N' AND charge = 1"),
    "hydroxyl": ("C[OH]", "SELECT DISTINCT x.mol FROM atoms x JOIN edges e USING (mol, atom) JOIN atoms o ON o.mol = e.mol AND o.atom = e.other WHERE x.element = 'C' AND o.element = 'O' AND o.h = 1 AND e.kind IN (1, 4)"),
}


def _patterns():
    for name, (pattern, sql) in _HITS.items():

        def run(spark, d, pattern=pattern):
            parts = table(spark, d, "part").select("p_partkey")
            return st.substructure_filter(parts, "p_partkey", st.perceive(*_molecules(spark, d)), pattern)["matches"]

        query(f"WITH {_GRAPH} SELECT mol AS p_partkey FROM ({sql})", f"substructure_{name}")(run)


_patterns()


@query(f"WITH {_GRAPH}, hits AS (" + " UNION ALL ".join(f"SELECT mol, {k} AS k, '{name}' AS alert FROM ({sql})" for k, (name, (_, sql)) in enumerate(_HITS.items())) + ") SELECT mol AS p_partkey, arg_min(alert, k) AS alert FROM hits GROUP BY 1")
def catalogue_filter(spark, d):
    parts = table(spark, d, "part").select("p_partkey")
    return st.catalogue_filter(parts, "p_partkey", st.perceive(*_molecules(spark, d)), {name: p for name, (p, _) in _HITS.items()})["rejects"]


@query(f"WITH {_GRAPH} SELECT mol, (count(*) + sum(h))::BIGINT AS n_atoms, sum(h)::BIGINT AS n_hydrogens FROM atoms GROUP BY 1")
def molecule_hydrogens(spark, d):
    atoms, _ = st.add_hydrogens(*_molecules(spark, d))
    return atoms.groupBy("mol").agg(F.count(F.lit(1)).alias("n_atoms"), F.count(F.when(F.col("element") == "H", 1)).alias("n_hydrogens"))


_SMILES = "concat(repeat('C', CAST(1 + p_size % 6 AS INTEGER)), CASE p_partkey % 4 WHEN 0 THEN 'c1ccccc1' WHEN 1 THEN 'C1CCC(CC1)O' WHEN 2 THEN 'C(=O)[O-]' ELSE 'N(C)CC=C' END, CASE p_partkey % 3 WHEN 0 THEN '.[Na+]' ELSE '' END)"
_TAIL = {  # of each ending: carbons, hydrogens, nitrogens, oxygens, bonds that turn besides those of the chain, rings, aromatic rings, donors
    0: (6, 5, 0, 0, 0, 1, 1, 0), 1: (6, 11, 0, 1, 0, 1, 0, 1), 2: (1, 0, 0, 2, 0, 0, 0, 0), 3: (4, 8, 1, 0, 2, 0, 0, 0),
}


def _tail(k: int) -> str:
    return "CASE p_partkey % 4 " + " ".join(f"WHEN {n} THEN {v[k]}" for n, v in _TAIL.items()) + " END"


@query(f"""WITH p AS (SELECT p_partkey AS mol, 1 + p_size % 6 AS n, p_partkey % 3 = 0 AS salt, p_partkey % 4 = 2 AS acid, {_tail(0)} AS c, {_tail(1)} AS h, {_tail(2)} AS nn, {_tail(3)} AS o, {_tail(4)} AS r, {_tail(5)} AS rings, {_tail(6)} AS ar, {_tail(7)} AS don FROM part)
SELECT mol, round(((n + c) * 12011 + (2 * n + 1 + h) * 1008 + nn * 14007 + o * 15999 + CASE WHEN salt THEN 22990 ELSE 0 END) / 1000.0, 4)::DOUBLE AS mol_weight, (n + c + nn + o + CASE WHEN salt THEN 1 ELSE 0 END)::INTEGER AS heavy_atoms,
(CASE WHEN acid THEN -1 ELSE 0 END + CASE WHEN salt THEN 1 ELSE 0 END)::INTEGER AS formal_charge, don::INTEGER AS h_donors, (nn + o)::INTEGER AS h_acceptors, (n - 1 + r)::INTEGER AS rotatable_bonds, rings::INTEGER AS rings, ar::INTEGER AS aromatic_rings FROM p""")
def molecule_descriptors(spark, d):
    atoms, bonds = st.parse_smiles(table(spark, d, "part").selectExpr("p_partkey", f"{_SMILES} AS smiles"), "p_partkey")
    return st.descriptors(st.perceive(atoms, bonds))
