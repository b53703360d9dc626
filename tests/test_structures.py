import itertools
import random

import numpy as np
import pytest

from labquarry.operators import structures as st

SMILES = {
    "ethanol": "CCO", "benzene": "c1ccccc1", "biphenyl": "c1ccccc1c1ccccc1", "naphthalene": "c1ccc2ccccc2c1", "pyridine": "c1ccncc1", "pyrrole": "c1cc[nH]c1", "acid": "CC(=O)[O-].[Na+]",
    "adamantane": "C1C2CC3CC1CC(C2)C3", "spiro": "C1CCC2(CC1)CCCC2", "cubane": "C12C3C4C1C5C4C3C25", "nitrile": "N#CC(C)(C)c1ccc(cc1)C(F)(F)F", "stereo": "C/C=C/[C@@H](N)C(=O)O", "far": "C%12CCCC%12", "ammonium": "[NH4+]",
    "linked": "c1ccccc1CCC(=O)NC1CCCCC1", "chloride": "ClCCBr",
}
BAD = ["C(", "C)", "C1CC", "Cx", "", None, "=", "[Q", "C(C))C"]


@pytest.fixture(scope="module")
def tables(spark):
    rows = list(SMILES.items()) + [(f"bad{k}", s) for k, s in enumerate(BAD)]
    atoms, bonds = st.parse_smiles(spark.createDataFrame(rows, "name string, smiles string"), "name")
    return atoms, bonds, st.perceive(atoms, bonds)


def _of(rows, *columns):
    out = {}
    for r in rows.collect():
        out.setdefault(r["mol"], []).append(tuple(r[c] for c in columns))
    return {k: sorted(v) for k, v in out.items()}


def test_smiles(tables):
    atoms, bonds, seen = tables
    a, b = _of(atoms, "atom", "element", "charge"), _of(bonds, "a", "b", "kind")
    assert set(a) == set(SMILES)
    assert a["acid"] == [(0, "C", 0), (1, "C", 0), (2, "O", 0), (3, "O", -1), (4, "Na", 1)] and b["acid"] == [(0, 1, 1), (1, 2, 2), (1, 3, 1)]
    assert [x[1] for x in a["chloride"]] == ["Cl", "C", "C", "Br"] and a["ammonium"] == [(0, "N", 1)]
    assert b["benzene"] == [(0, 1, 4), (0, 5, 4), (1, 2, 4), (2, 3, 4), (3, 4, 4), (4, 5, 4)]
    assert (5, 6, 1) in b["biphenyl"] and len(b["biphenyl"]) == 13 and b["far"][1] == (0, 4, 1) and (1, 2, 2) in b["stereo"]
    h = {k: [x[1] for x in v] for k, v in _of(seen.atoms, "atom", "hydrogens").items()}
    assert h["ethanol"] == [3, 2, 1] and h["pyridine"] == [1, 1, 1, 0, 1, 1] and h["pyrrole"] == [1, 1, 1, 1, 1] and h["ammonium"] == [4] and h["acid"] == [3, 0, 0, 0, 0] and h["stereo"][3] == 1


def test_rings_and_scaffolds(tables):
    atoms, bonds, seen = tables
    sizes = {k: [x[0] for x in v] for k, v in _of(seen.rings, "size").items()}
    assert sizes == {
        "benzene": [6], "biphenyl": [6, 6], "naphthalene": [6, 6], "pyridine": [6], "pyrrole": [5], "adamantane": [6, 6, 6], "spiro": [5, 6], "cubane": [4] * 5, "nitrile": [6], "far": [5], "linked": [6, 6],
    }
    inner, ties = st.scaffold(atoms, bonds)
    got = {k: [x[0] for x in v] for k, v in _of(inner, "atom").items()}
    assert set(got) == set(sizes) and got["nitrile"] == [5, 6, 7, 8, 9, 10] and got["linked"] == list(range(17)) and got["spiro"] == list(range(10))
    assert len(_of(ties, "a")["linked"]) == 18
    plain, _ = st.scaffold(atoms, bonds, generic=True)
    assert len(_of(plain, "atom")["linked"]) == 16 and {r["element"] for r in plain.collect()} == {"C"}


def test_fragments_and_hydrogens(tables):
    atoms, bonds, _ = tables
    big, ties = st.largest_fragment(atoms, bonds)
    got = _of(big, "atom")
    assert got["acid"] == [(0,), (1,), (2,), (3,)] and len(got["linked"]) == 17 and len(_of(ties, "a")["acid"]) == 3
    full, more = st.add_hydrogens(atoms, bonds)
    got = _of(full, "element")
    assert len(got["ethanol"]) == 9 and len(got["benzene"]) == 12 and len(_of(more, "a")["ethanol"]) == 8
    assert _of(full.where("mol = 'ethanol'"), "atom")["ethanol"] == [(k,) for k in range(9)]
    back, fewer = st.remove_hydrogens(full, more)
    assert _of(back, "atom", "element") == _of(atoms, "atom", "element") and _of(fewer, "a", "b", "kind") == _of(bonds, "a", "b", "kind")
    assert _of(back.where("mol = 'ethanol'"), "hydrogens")["ethanol"] == [(1,), (2,), (3,)]


def random_molecules(n, seed=3):
    rnd = random.Random(seed)
    atoms, bonds = [], []
    for m in range(n):
        size = rnd.randrange(1, 14)
        for i in range(size):
            atoms.append((m, i, rnd.choice("CCCNOSF"), rnd.choice([0, 0, 0, 1, -1]), None, False))
            if i and rnd.random() < 0.93:
                bonds.append((m, rnd.randrange(max(0, i - 3), i), i, rnd.choice([1, 1, 2])))
        for _ in range(rnd.randrange(3)):
            a, b = sorted((rnd.randrange(size), rnd.randrange(size)))
            if a != b and not any((x[0], x[1], x[2]) == (m, a, b) for x in bonds):
                bonds.append((m, a, b, 1))
    return atoms, bonds


@pytest.fixture(scope="module")
def drawn(spark):
    atoms, bonds = random_molecules(100)
    a = spark.createDataFrame(atoms, "mol long, atom int, element string, charge int, hydrogens int, aromatic boolean")
    b = spark.createDataFrame(bonds, "mol long, a int, b int, kind int")
    return atoms, bonds, a, b, st.perceive(a, b)


def graphs(atoms, bonds):
    out = {m: ({}, {}) for m in {a[0] for a in atoms}}
    for m, i, e, c, *_ in atoms:
        out[m][0][i] = (e, c)
    for m, a, b, k in bonds:
        out[m][1].setdefault(a, {})[b] = k
        out[m][1].setdefault(b, {})[a] = k
    return out


def reach(near, start, without=()):
    seen, todo = {start}, [start]
    while todo:
        x = todo.pop()
        for y in near.get(x, {}):
            if y not in seen and {x, y} != set(without):
                seen.add(y)
                todo.append(y)
    return seen


def test_random_graphs(drawn):
    atoms, bonds, a, b, seen = drawn
    parts, rings = _of(st.fragments(a, b), "atom", "fragment"), _of(seen.rings, "size", "atoms")
    core = _of(st.core(b), "a", "b")
    for m, (nodes, near) in graphs(atoms, bonds).items():
        assert parts[m] == sorted((i, min(reach(near, i))) for i in nodes)
        edges = {(x, y) for x in near for y in near[x] if x < y}
        n_parts = len({min(reach(near, i)) for i in nodes})
        own = rings.get(m, [])
        assert len(own) == len(edges) - len(nodes) + n_parts
        in_ring = {e for e in edges if e[1] in reach(near, e[0], e)}
        assert {tuple(sorted(e)) for _, r in own for e in zip(r, [*r[1:], r[0]])} <= edges
        assert {i for e in in_ring for i in e} == {i for _, r in own for i in r}
        left = set(edges)
        while True:
            degree = {}
            for e in left:
                for i in e:
                    degree[i] = degree.get(i, 0) + 1
            less = {e for e in left if all(degree[i] > 1 for i in e)}
            if less == left:
                break
            left = less
        assert core.get(m, []) == sorted(left)
    # No other set of independent cycles is smaller: on small graphs, against all simple cycles.
    for m, (_, near) in itertools.islice(graphs(atoms, bonds).items(), 60):
        cycles = []

        def walk(path):
            for y in near.get(path[-1], {}):
                if y == path[0] and len(path) > 2:
                    cycles.append(frozenset(tuple(sorted(e)) for e in zip(path, [*path[1:], path[0]])))
                elif y not in path and y > path[0]:
                    walk([*path, y])

        for i in near:
            walk([i])
        order, pivots, best = {e: k for k, e in enumerate(sorted({e for c in cycles for e in c}))}, {}, []
        for c in sorted(set(cycles), key=len):
            mask = sum(1 << order[e] for e in c)
            while mask and mask.bit_length() in pivots:
                mask ^= pivots[mask.bit_length()]
            if mask:
                pivots[mask.bit_length()] = mask
                best.append(len(c))
        assert sorted(best) == [s for s, _ in rings.get(m, [])]


def combine(h, v):
    return ((h ^ v) * 16777619) % 2**32


def test_fingerprints_like_a_plain_loop(drawn):
    atoms, bonds, _, _, seen = drawn
    got = {r["mol"]: (r["on"], r["fingerprint"]) for r in st.fingerprints(seen, 2, 1000).collect()}
    number = {"C": 6, "N": 7, "O": 8, "F": 9, "S": 16}
    for m, (nodes, near) in graphs(atoms, bonds).items():
        ids = {}
        for i, (e, c) in nodes.items():
            usual = st.VALENCES.get((e, c), 0)
            h = max(0, usual - sum(near.get(i, {}).values()))
            ring = int(any(i in reach({x: {y: 1 for y in near[x] if {x, y} != {i, j}} for x in near}, j) for j in near.get(i, {})))
            x = number[e]
            for v in (len(near.get(i, {})), h, c + 5, ring):
                x = combine(x, v)
            ids[i] = x
        every = set(ids.values())
        for _ in range(2):
            new = {}
            for i in nodes:
                x = ids[i]
                for k, other in sorted((k, ids[j]) for j, k in near.get(i, {}).items()):
                    x = combine(combine(x, k), other)
                new[i] = x
            ids = new
            every |= set(ids.values())
        on = sorted({x % 1000 for x in every})
        words = [0] * 16
        for i in on:
            words[i // 63] += 1 << (min(63, 1000 - i // 63 * 63) - 1 - i % 63)
        assert got[m] == (on, words)


def _embeds(nodes, near, pattern):
    tests, ties = pattern
    for chosen in itertools.permutations(nodes, len(tests)):
        if all(t(*nodes[i]) for t, i in zip(tests, chosen)) and all(near.get(chosen[a], {}).get(chosen[b]) in k for a, b, k in ties):
            return True
    return False


@pytest.mark.parametrize(
    ("text", "pattern"),
    [
        ("CN", ([lambda e, c: e == "C", lambda e, c: e == "N"], [(0, 1, (1, 4))])),
        ("C=O", ([lambda e, c: e == "C", lambda e, c: e == "O"], [(0, 1, (2,))])),
        ("C1~*~*~1", ([lambda e, c: e == "C", lambda e, c: True, lambda e, c: True], [(0, 1, (1, 2)), (1, 2, (1, 2)), (2, 0, (1, 2))])),
        ("[N,O]C[!C]", ([lambda e, c: e in "NO", lambda e, c: e == "C", lambda e, c: e != "C"], [(0, 1, (1,)), (1, 2, (1,))])),
        ("[#7]~C(~O)~*", ([lambda e, c: e == "N", lambda e, c: e == "C", lambda e, c: e == "O", lambda e, c: True], [(0, 1, (1, 2)), (1, 2, (1, 2)), (1, 3, (1, 2))])),
        ("S", ([lambda e, c: e == "S"], [])),
    ],
)
def test_patterns_like_brute_force(drawn, text, pattern):
    atoms, bonds, _, _, seen = drawn
    want = {m for m, (nodes, near) in graphs(atoms, bonds).items() if _embeds(nodes, near, pattern)}
    assert {r["mol"] for r in st.matching(seen, text).collect()} == want and want


def test_filters_and_descriptors(spark, tables):
    _, _, seen = tables
    df = spark.createDataFrame([(k,) for k in [*SMILES, "bad0"]], "name string")
    names = lambda x: {r["name"] for r in x.collect()}
    got = st.substructure_filter(df, "name", seen, "c1ccccc1")
    assert names(got["matches"]) == {"benzene", "biphenyl", "naphthalene", "nitrile", "linked"} and names(got["rejects"]) == {*SMILES, "bad0"} - names(got["matches"])
    assert names(st.substructure_filter(df, "name", seen, "[OH]")["matches"]) == {"ethanol", "stereo"}
    assert names(st.substructure_filter(df, "name", seen, "C(=O)N[R]")["matches"]) == {"linked"}
    alerts = {"amide": "C(=O)N", "halide": "[F,Cl,Br,I]", "nitrile": "C#N"}
    got = st.catalogue_filter(df, "name", seen, alerts)
    assert {r["name"]: r["alert"] for r in got["rejects"].collect()} == {"linked": "amide", "chloride": "halide", "nitrile": "halide"} and len(names(got["matches"])) == len(SMILES) - 2
    assert names(st.catalogue_filter(df, "name", seen, alerts, clean=False)["matches"]) == {"linked", "chloride", "nitrile"}
    d = {r["mol"]: r for r in st.descriptors(seen).collect()}
    assert d["ethanol"]["mol_weight"] == pytest.approx(46.069, abs=1e-3) and d["benzene"]["mol_weight"] == pytest.approx(78.114, abs=1e-3)
    assert [d["linked"][c] for c in ("heavy_atoms", "rings", "aromatic_rings", "rotatable_bonds", "h_donors", "h_acceptors")] == [17, 2, 1, 5, 1, 2]
    assert d["biphenyl"]["rotatable_bonds"] == 1 and d["acid"]["formal_charge"] == 0
    with pytest.raises(st.OperatorError):
        st.matching(seen, "C(")


def test_no_broadcast_of_atoms(drawn):
    """Sizes of exploded and stored tables are estimated far too low: their joins must not be broadcasts by estimate."""
    _, _, a, b, _ = drawn
    for out in (st.fragments(a, b), st.with_hydrogens(a, b), *st.add_hydrogens(a, b), *st.largest_fragment(a, b), *st.scaffold(a, b)):
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_large_molecules_in_rounds(spark, drawn, monkeypatch):
    _, _, a, b, _ = drawn
    want = [sorted(map(tuple, x.collect())) for x in (st.fragments(a, b), st.core(b), st.smallest_rings(b).select("mol", "size"))]
    monkeypatch.setattr(st, "WHOLE", 12)
    assert st._large(a, b) is not None
    assert [sorted(map(tuple, x.collect())) for x in (st.fragments(a, b), st.core(b), st.smallest_rings(b).select("mol", "size"))] == want


def test_molecules_are_dealt_to_all_cores(spark):
    """Few bytes of molecules are much work: adaptive execution would join them into one task, and rows would be shuffled after they are made."""
    from labquarry.plans import structure_queries

    packed = st.packed(*structure_queries._molecules(spark, "/root/testdata/sf0.001"))
    packed.collect()
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Union")] and "Exchange" in plan
    assert packed.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


def test_rings_of_cores_alike_are_found_once():
    """The same two rings, at other atoms and with a tail: as found alone."""
    ring = [(0, 1), (0, 5), (1, 2), (1, 7), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7)]
    rows = [(m, shift + a, shift + b) for m, shift in ((0, 0), (1, 0), (2, 40), (4, 3)) for a, b in ring] + [(4, 90, 91)]
    st._known_basis.cache_clear()
    got = dict(st._ring_lists(*(np.array(x, np.int64) for x in zip(*rows, strict=True))))
    want = st._cycle_basis(*map(list, zip(*ring, strict=True)))
    assert got == {m: [[shift + i for i in r] for r in want] for m, shift in ((0, 0), (1, 0), (2, 40), (4, 3))} and len(want) == 2
    assert st._known_basis.cache_info().misses == 1 and st._known_basis.cache_info().hits == 3


def test_fingerprints_are_taken_of_many_molecules_at_a_time(drawn):
    *_, seen = drawn
    plan = st.fingerprints(seen)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "aggregate(array(0" not in plan


def test_catalogues_are_read_and_matched_in_one_go(spark, tables):
    """One job reads all patterns, whatever their number, and matching starts none."""
    *_, seen = tables
    df = spark.createDataFrame([(n,) for n in SMILES], "name string")
    spark.sparkContext.setJobGroup("catalogue", "")
    got = st.catalogue_filter(df, "name", seen, {"a": "N#C", "b": "CCl", "c": "[OH]", "d": "C=O"})["rejects"]
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("catalogue")) == 1
    spark.sparkContext.setJobGroup("", "")
    assert {tuple(r) for r in got.collect()} == {("nitrile", "a"), ("chloride", "b"), ("ethanol", "c"), ("stereo", "c"), ("acid", "d"), ("linked", "d")}
    with pytest.raises(st.OperatorError):
        st.matching(seen, "C.C")


def test_patterns_when_few_partial_matches_are_held(spark, drawn, monkeypatch):
    """Matches grown one by one, and molecules told of already left out: the same molecules."""
    *_, seen = drawn
    batch = st._Graphs.of(seen).toArrow().combine_chunks().to_batches()[0]
    g, none = st._Graphs(batch), np.zeros(len(batch), bool)
    for pattern in st._read(spark, ["C~*~*~*", "C1~*~*~*~1", "[!C]~[D2]", "*"]):
        monkeypatch.undo()
        want = st._found(g, pattern, none)
        monkeypatch.setattr(st, "PARTIAL", 1)
        assert (st._found(g, pattern, none) == want).all() and want.any()
        told = np.arange(len(batch)) % 2 == 0
        assert (st._found(g, pattern, told) == (want & ~told)).all()
