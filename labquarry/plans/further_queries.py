"""Queries of mixed models, further pair tests, tables behind plots of points, cells, image metadata and molecule tables, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells, figures, images, mixed, molecules
from ..operators import statistics as s
from ..operators import tracking as tr
from .analysis_queries import _MOMENTS, _TRACKS, _rounded, _tracks
from .domain_queries import _pictures
from .registry import query, table

#: Two-sided p of a normal z, by the series of the distribution function; beyond 6 it is below every rounding here.
_NORMAL_P = "CASE WHEN abs({z}) > 6 THEN 0 ELSE 1 - 2 * exp(0 - ({z}) ** 2 / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 150), lambda k: abs({z}) ** (2 * k + 1) * exp(0.5 * ln(pi()) - (k + 1) * ln(2) - lgamma(k + 1.5)))) END"


@query(f"""WITH g AS ({_MOMENTS}), t AS (SELECT sum((n - 1) * v) / (sum(n) - count(*)) AS w FROM g)
SELECT a.g AS group1, b.g AS group2, a.n AS n1, b.n AS n2, round(a.m - b.m, 6) AS mean_diff, round(abs(a.m - b.m) / sqrt(w / 2 * (1.0 / a.n + 1.0 / b.n)), 6) AS q FROM g a JOIN g b ON a.g < b.g, t""")
def pairwise_tukey(spark, d):
    return _rounded(s.tukey(table(spark, d, "events"), "value", "event_type").drop("p", "p_adj"), 6)


@query()
def pairwise_tukey_p(spark, d):
    """p of the studentized range has no SQL; tests hold it against tabulated quantiles."""
    return s.tukey(table(spark, d, "events"), "value", "event_type").select("group1", "group2", "p", "p_adj")


_CORRELATIONS = "SELECT event_type AS g, count(*)::DOUBLE AS n, avg((event_id % 200 - 100) / 100.0::DOUBLE) AS r FROM events GROUP BY 1"


@query(f"""WITH g AS ({_CORRELATIONS}), z AS (SELECT a.g AS group1, b.g AS group2, CAST(a.n AS BIGINT) AS n1, CAST(b.n AS BIGINT) AS n2, a.r AS r1, b.r AS r2, (atanh(a.r) - atanh(b.r)) / sqrt(1 / (a.n - 3) + 1 / (b.n - 3)) AS z FROM g a JOIN g b ON a.g < b.g),
p AS (SELECT *, {_NORMAL_P.format(z="z")} AS p FROM z) SELECT group1, group2, n1, n2, round(r1, 6) AS r1, round(r2, 6) AS r2, round(z, 6) AS z, round(p, 6) AS p, round(least(1, p * count(*) OVER ()), 6) AS p_adj FROM p""")
def pairwise_fisher_z(spark, d):
    e = table(spark, d, "events").withColumn("r", (F.col("event_id") % 200 - 100) / 100.0)
    return _rounded(s.fisher_z(e, "r", "event_type", correction="bonferroni"), 6)


def _mixed():
    for part in ("fixed_effects", "random_effects", "summary"):
        for reml in (True, False):

            def run(spark, d, part=part, reml=reml):
                return mixed.mixed_effects(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"], "l_suppkey", reml)[part]

            # The ratio of variances is searched, which SQL cannot; tests hold it against dense matrices.
            query(None, f"mixed_{part}_{'reml' if reml else 'ml'}")(run)

        def sloped(spark, d, part=part):
            return mixed.mixed_effects(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"], "l_suppkey", slope="l_quantity")[part]

        query(None, f"mixed_slope_{part}")(sloped)


_mixed()


@query(f"""WITH t AS ({_TRACKS}), m AS (SELECT greatest(2, CAST(floor(median(n) / 2) AS BIGINT)) AS most FROM (SELECT count(*) AS n FROM t GROUP BY track_id))
SELECT a.track_id, CAST(b.frame - a.frame AS INTEGER) AS lag, round(avg((b.centroid_x - a.centroid_x) ** 2 + (b.centroid_y - a.centroid_y) ** 2) + 1e-6, 4) AS msd, count(*) AS n FROM t a JOIN t b ON a.track_id = b.track_id JOIN m ON b.frame - a.frame BETWEEN 1 AND most GROUP BY 1, 2""")
def msd_per_track(spark, d):
    out = tr.mean_squared_displacement(_tracks(spark, d), per_track=True)
    return out.withColumn("msd", F.round(F.col("msd") + 1e-6, 4))  # short tracks have means halfway between two roundings


def _paths():
    forms = {
        "track": ({}, "track_id", ""),
        "speed": ({"color_by": "speed"}, "round(sqrt((to_x - x) ** 2 + (to_y - y) ** 2) / (f2 - frame), 6)", ""),
        "tail": ({"tail_frames": 5}, "track_id", "AND f2 > (SELECT max(frame) FROM t) - 5"),
    }
    for name, (options, color, tail) in forms.items():

        def run(spark, d, options=options):
            return _rounded(tr.trajectories(_tracks(spark, d), **options), 6)

        query(
            f"""WITH t AS ({_TRACKS}), p AS (SELECT track_id, frame, centroid_x AS x, centroid_y AS y, lead(centroid_x) OVER w AS to_x, lead(centroid_y) OVER w AS to_y, lead(frame) OVER w AS f2 FROM t WINDOW w AS (PARTITION BY track_id ORDER BY frame))
SELECT track_id, frame, round(x, 6) AS x, round(y, 6) AS y, round(to_x, 6) AS to_x, round(to_y, 6) AS to_y, {color} AS color FROM p WHERE f2 IS NOT NULL {tail}""",
            f"trajectories_{name}",
        )(run)


_paths()

# Plots of points


@query("SELECT l_quantity AS x, l_extendedprice AS y, l_returnflag AS hue FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL")
def scatter_points(spark, d):
    return figures.scatter(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")["points"]


@query("SELECT count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
def scatter_line(spark, d):
    out = figures.scatter(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", regression=True)["line"]
    return out.select("n", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"))


_SPAN = "SELECT min(l_quantity) AS ax, max(l_quantity) AS bx, min(l_discount) AS ay, max(l_discount) AS by_ FROM lineitem"
_BIN = "CAST(least({n} - 1, coalesce(floor(({v} - {a}) * {n} / nullif({b} - {a}, 0)), 0)) AS INTEGER)"


@query(f"SELECT {_BIN.format(n=7, v='l_quantity', a='ax', b='bx')} AS x_bin, {_BIN.format(n=7, v='l_discount', a='ay', b='by_')} AS y_bin, count(*) AS count FROM lineitem, ({_SPAN}) GROUP BY 1, 2")
def joint_cells(spark, d):
    return figures.joint(table(spark, d, "lineitem"), "l_quantity", "l_discount", 7)["cells"]


@query("""WITH v AS (SELECT 'x' AS axis, l_returnflag AS "group", l_quantity AS v FROM lineitem UNION ALL SELECT 'y', l_returnflag, l_discount FROM lineitem), s AS (SELECT axis, min(v) AS a, (max(v) - min(v)) / 7 AS w FROM v GROUP BY 1)
SELECT axis, "group", CAST(least(6, floor((v - a) / w)) AS INTEGER) AS bin, round(a + least(6, floor((v - a) / w)) * w, 6) AS low, round(a + (least(6, floor((v - a) / w)) + 1) * w, 6) AS high, count(*) AS count FROM v JOIN s USING (axis) GROUP BY ALL""")
def joint_marginals(spark, d):
    return _rounded(figures.joint(table(spark, d, "lineitem"), "l_quantity", "l_discount", 7, "l_returnflag")["marginals"], 6)


_FITTED = "SELECT l_extendedprice AS t, l_quantity * 1500 AS p FROM lineitem"


@query(f"""WITH f AS ({_FITTED}) SELECT count(*) AS n, round(1 - sum((t - p) ** 2) / (var_pop(t) * count(*)), 6) AS r2, round(least(min(t), min(p)) - 0.05 * (greatest(max(t), max(p)) - least(min(t), min(p))), 4) AS line_low,
round(greatest(max(t), max(p)) + 0.05 * (greatest(max(t), max(p)) - least(min(t), min(p))), 4) AS line_high FROM f""")
def regression_scatter_fit(spark, d):
    df = table(spark, d, "lineitem").withColumn("p", F.col("l_quantity") * 1500)
    return figures.regression_scatter(df, "l_extendedprice", "p")["fit"].select("n", F.round("r2", 6).alias("r2"), F.round("line_low", 4).alias("line_low"), F.round("line_high", 4).alias("line_high"))


@query(f"SELECT round(t, 4) AS \"true\", round(p, 4) AS predicted, round(t - p, 4) AS residual FROM ({_FITTED})")
def regression_scatter_points(spark, d):
    df = table(spark, d, "lineitem").withColumn("p", F.col("l_quantity") * 1500)
    return _rounded(figures.regression_scatter(df, "l_extendedprice", "p")["points"], 4)


@query("SELECT l_linestatus AS cluster, l_returnflag AS class, count(*) AS n, round(avg(l_quantity), 6) AS x, round(avg(l_extendedprice), 4) AS y FROM lineitem GROUP BY ALL")
def cluster_scatter_centers(spark, d):
    out = figures.cluster_scatter(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_linestatus", "l_returnflag")["centers"]
    return out.select("cluster", "class", "n", F.round("x", 6).alias("x"), F.round("y", 4).alias("y"))


@query("""SELECT l_returnflag AS hue, unnest(['l_quantity', 'l_quantity', 'l_discount']) AS x_column, unnest(['l_discount', 'l_tax', 'l_tax']) AS y_column, unnest([l_quantity, l_quantity, l_discount]) AS x, unnest([l_discount, l_tax, l_tax]) AS y FROM lineitem""")
def double_variable_pairs(spark, d):
    df = table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag")
    return figures.double_variable(df, "l_quantity", "l_tax", "pairplot", "l_returnflag")["points"]


# Cells and image metadata: an order is a cell, its lines are branches


@query("""SELECT l_orderkey AS cell_key, count(*) AS filopodia_count, round(avg(l_quantity), 2) AS mean_length_px, round(sum(l_quantity), 2) AS total_length_px, round(avg(l_quantity * 0.13713), 2) AS mean_length_um, round(sum(l_quantity * 0.13713), 2) AS total_length_um,
CAST(l_orderkey % 11 AS DOUBLE) AS edge_length_px, CAST(l_orderkey % 3 - 1 AS DOUBLE) AS edge_length_um,
round(CASE WHEN l_orderkey % 3 - 1 > 0 THEN count(*) / (l_orderkey % 3 - 1)::DOUBLE WHEN l_orderkey % 11 > 0 THEN count(*) / (l_orderkey % 11)::DOUBLE ELSE 0 END, 4) AS density FROM lineitem GROUP BY l_orderkey""")
def filopodia_summary(spark, d):
    branches = table(spark, d, "lineitem").selectExpr(
        "l_orderkey AS cell", "l_linenumber AS branch", "l_quantity AS filopodia_length_px", "l_quantity * 0.13713 AS filopodia_length_um", "CAST(l_orderkey % 11 AS DOUBLE) AS edge_length_px", "CAST(l_orderkey % 3 - 1 AS DOUBLE) AS edge_length_um"
    )
    return cells.filopodia_summary(branches, "cell", "branch")


@query("SELECT vec_id::VARCHAR AS cell_key, list_sum(list_transform(embedding, lambda v: CASE WHEN v > 0 THEN 1 ELSE 0 END))::BIGINT AS inside, len(embedding)::INTEGER AS pixels FROM embeddings")
def cell_iterator(spark, d):
    a = _pictures(spark, d)
    both = cells.cell_pairs(a, images.threshold(a, 1e-12))
    return both.select("cell_key", F.aggregate("cell_mask.pixels", F.lit(0.0), lambda t, v: t + v).cast("long").alias("inside"), F.size("image.pixels").alias("pixels"))


@query("SELECT vec_id::VARCHAR AS key, 12 AS bit_depth, 0.25::DOUBLE AS scale_um FROM embeddings")
def image_metadata(spark, d):
    return images.with_scale(images.with_bit_depth(_pictures(spark, d), 12), 1.0, 10.0, 40.0).select("key", "bit_depth", "scale_um")


# Molecule tables: straight chains of carbons, some with brackets that do not match

_CHAINS = "SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 'C(C' ELSE repeat('C', CAST(1 + p_partkey % 9 AS INTEGER)) || '(O)N' END AS smiles, p_size AS size FROM part"


def _chains(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey AS id", "CASE WHEN p_partkey % 7 = 0 THEN 'C(C' ELSE repeat('C', CAST(1 + p_partkey % 9 AS INT)) || '(O)N' END AS smiles", "p_size AS size")


@query(f"SELECT id::VARCHAR AS name, smiles, size FROM ({_CHAINS}) WHERE smiles <> 'C(C'")
def molecules_from_table(spark, d):
    return molecules.from_table(_chains(spark, d), properties=["size"])


@query(f"SELECT 'Mol_' || row_number() OVER (ORDER BY smiles, size) AS name, smiles, size FROM ({_CHAINS}) WHERE smiles <> 'C(C'")
def molecules_numbered(spark, d):
    return molecules.to_table(molecules.from_table(_chains(spark, d), name=None, properties=["size"]).withColumn("ROMol", F.col("smiles")))


@query(f"SELECT name, smiles, size FROM (SELECT id::VARCHAR AS name, smiles, size FROM ({_CHAINS}) WHERE smiles <> 'C(C') ORDER BY name, size, smiles LIMIT 1 OFFSET 17")
def nth_molecule(spark, d):
    return molecules.nth_molecule(molecules.from_table(_chains(spark, d), properties=["size"]), 17)
