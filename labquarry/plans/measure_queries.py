"""Queries of image operators as pixel tables, molecule rules and bit metrics, screening, and further statistics, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import advanced, evaluation, images, molecules, screening, shapes
from ..operators import neighbours as n
from ..operators import statistics as s
from .analysis_queries import _PREDICTED, _lives, _predicted, _rounded
from .domain_queries import _pictures
from .registry import query, table

# Images: SQL over a table of pixels (key, y, x, v); _SCALED has them from 0 to 1

_PIXELS = "SELECT vec_id::VARCHAR AS key, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, v FROM (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"
_SCALED = f"SELECT key, y, x, greatest(0, least(1, (v + 0.5) / 1.0)) AS v FROM ({_PIXELS})"


def _pixels(df, places=8):
    return images.pixel_table(df).withColumn("value", F.round("value", places)).drop("ch")


def _scaled(spark, d):
    return images.brightness_contrast(_pictures(spark, d), -0.5, 0.5)


def _plain():
    """Operators whose result at a pixel follows from that pixel, or from one other place."""
    forms = {
        "brightness": (lambda x: x, "y, x, v", ""),
        "invert": (images.invert, "y, x, 1 - v", ""),
        "gamma": (lambda x: images.gamma(x, 0.5, 1.2), "y, x, least(1, 1.2 * sqrt(v))", ""),
        "crop": (lambda x: images.crop(x, 1, 2, 6, 7), "y - 1, x - 2, v", "WHERE y BETWEEN 1 AND 5 AND x BETWEEN 2 AND 6"),
        "mirror_horizontal": (lambda x: images.mirror(x, "horizontal"), "y, 7 - x, v", ""),
        "mirror_vertical": (lambda x: images.mirror(x, "vertical"), "7 - y, x, v", ""),
        "mirror_both": (lambda x: images.mirror(x, "both"), "7 - y, 7 - x, v", ""),
    }
    for name, (f, columns, where) in forms.items():

        def run(spark, d, f=f):
            return _pixels(f(_scaled(spark, d)))

        y, x, v = columns.split(", ", 2)
        query(f"SELECT key, CAST({y} AS INTEGER) AS y, CAST({x} AS INTEGER) AS x, round(CAST({v} AS DOUBLE), 8) AS value FROM ({_SCALED}) {where}", f"image_{name}")(run)


_plain()


def _two():
    """A picture with its mirror image, by each operation."""
    forms = {
        "add": "least(1, a + b)", "subtract": "greatest(0, a - b)", "multiply": "a * b", "mask": "CASE WHEN b > 0 THEN a ELSE 0 END", "and": "CASE WHEN a > 0 AND b > 0 THEN 1 ELSE 0 END",
        "or": "CASE WHEN a > 0 OR b > 0 THEN 1 ELSE 0 END", "max": "greatest(a, b)", "min": "least(a, b)", "blend": "a * 0.25 + b * 0.75",
    }
    for name, form in forms.items():

        def run(spark, d, name=name):
            a = _scaled(spark, d)
            return _pixels(images.image_math(a, images.mirror(a), name, 0.25))

        query(f"WITH p AS ({_SCALED}), t AS (SELECT p.key, p.y, p.x, p.v AS a, o.v AS b FROM p JOIN p o ON p.key = o.key AND p.y = o.y AND p.x = 7 - o.x) SELECT key, y, x, round(CAST({form} AS DOUBLE), 8) AS value FROM t", f"image_math_{name}")(run)


_two()


def _grown(source: str, how: str) -> str:
    return f"SELECT p.key, p.y, p.x, {how}(o.v) AS v FROM {source} p JOIN {source} o ON p.key = o.key AND abs(p.y - o.y) + abs(p.x - o.x) <= 1 GROUP BY ALL"


def _morphology():
    steps = f"WITH p AS ({_SCALED}), e AS ({_grown('p', 'min')}), d AS ({_grown('p', 'max')}), o AS ({_grown('e', 'max')}), c AS ({_grown('d', 'min')})"
    forms = {"erode": ("e", "e.v"), "dilate": ("d", "d.v"), "open": ("o", "o.v"), "close": ("c", "c.v"), "white_tophat": ("o", "p.v - o.v"), "black_tophat": ("c", "c.v - p.v")}
    for name, (of, form) in forms.items():

        def run(spark, d, name=name):
            return _pixels(images.morphology(_scaled(spark, d), name))

        query(f"{steps} SELECT p.key, p.y, p.x, round({form}, 8) AS value FROM p JOIN {of} ON p.key = {of}.key AND p.y = {of}.y AND p.x = {of}.x", f"image_{name}")(run)


_morphology()

# The first 63 numbers as a picture of 7 by 3 in colour
_COLOURS = "SELECT vec_id::VARCHAR AS key, CAST(i // 9 AS INTEGER) AS y, CAST(i // 3 % 3 AS INTEGER) AS x, max(v) FILTER (i % 3 = 0) AS r, max(v) FILTER (i % 3 = 1) AS g, max(v) FILTER (i % 3 = 2) AS b FROM (SELECT vec_id, unnest(embedding[1:63]::DOUBLE[]) AS v, generate_subscripts(embedding[1:63], 1) - 1 AS i FROM embeddings) GROUP BY 1, 2, 3"


def _coloured(spark, d):
    cut = F.transform(F.slice("embedding", 1, 63), lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("key"), F.lit(7).alias("h"), F.lit(3).alias("w"), F.lit(3).alias("c"), cut.alias("pixels"))


def _colour():
    for method, (r, g, b) in images.GRAY.items():

        def run(spark, d, method=method):
            return _pixels(images.to_gray(_coloured(spark, d), method))

        query(f"SELECT key, y, x, round(r * CAST({r} AS DOUBLE) + g * CAST({g} AS DOUBLE) + b * CAST({b} AS DOUBLE), 8) AS value FROM ({_COLOURS})", f"image_gray_{method}")(run)
    for channel in ("red", "green", "blue"):

        def split(spark, d, channel=channel):
            return _pixels(images.split_channels(_coloured(spark, d))[channel])

        query(f"SELECT key, y, x, round({channel[0]}, 8) AS value FROM ({_COLOURS})", f"image_split_{channel}")(split)


_colour()


@query(f"WITH p AS ({_COLOURS}) SELECT key, y, x, 0 AS ch, round(b, 8) AS value FROM p UNION ALL SELECT key, y, x, 1, round(g, 8) FROM p UNION ALL SELECT key, y, x, 2, round(r, 8) FROM p")
def image_merge_channels(spark, d):
    """Channels taken apart and put together the other way round."""
    c = images.split_channels(_coloured(spark, d))
    return images.pixel_table(images.merge_channels(c["blue"], c["green"], c["red"])).withColumn("value", F.round("value", 8))


def _projections():
    """The 64 numbers as a volume of 4 by 4 by 4."""
    at = {"z": "i // 16", "y": "i // 4 % 4", "x": "i % 4"}
    for how, form in (("max", "max"), ("min", "min"), ("mean", "avg")):
        for axis in "zyx":

            def run(spark, d, how=how, axis=axis):
                v = _pictures(spark, d).select("key", F.lit(4).alias("d"), F.lit(4).alias("h"), F.lit(4).alias("w"), "pixels")
                return _pixels(images.project(v, how, axis))

            y, x = (at[k] for k in "zyx" if k != axis)
            query(f"SELECT vec_id::VARCHAR AS key, CAST({y} AS INTEGER) AS y, CAST({x} AS INTEGER) AS x, round({form}(v), 8) AS value FROM (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY 1, 2, 3", f"volume_{how}_{axis}")(run)


_projections()


@query(f"""WITH p AS ({_SCALED}), h AS (SELECT key, least(255, floor(v * 256)) AS bin, count(*)::DOUBLE AS n FROM p GROUP BY 1, 2), a AS (SELECT key, bin, sum(n) OVER w AS a, sum(n * (bin + 0.5) / 256) OVER w AS sa, sum(n) OVER k AS t, sum(n * (bin + 0.5) / 256) OVER k AS st FROM h WINDOW w AS (PARTITION BY key ORDER BY bin), k AS (PARTITION BY key)),
g AS (SELECT key, bin, coalesce(CASE WHEN t > a THEN a * (t - a) * (sa / a - (st - sa) / (t - a)) ** 2 END, 0) AS g FROM a) SELECT key, (arg_max(bin, (round(g, 9), -bin)) + 0.5) / 256 AS threshold FROM g GROUP BY 1""")
def image_otsu(spark, d):
    return images.otsu(_scaled(spark, d))


@query(f"SELECT key, count(*) AS n, round(corr(a, b), 7) AS pearson, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 7) AS moc FROM (SELECT p.key, p.v AS a, o.v AS b FROM ({_SCALED}) p JOIN ({_SCALED}) o ON p.key = o.key AND p.y = o.y AND p.x = 7 - o.x) GROUP BY 1")
def image_colocalization(spark, d):
    a = _scaled(spark, d)
    return _rounded(images.colocalization(a, images.mirror(a)).select("key", "n", "pearson", "moc"), 7)


@query(f"WITH p AS ({_COLOURS}), m AS (SELECT key, y, x, r, g, b, greatest(r, g, b) AS v FROM (SELECT key, y, x, greatest(0, least(1, r + 0.5)) AS r, greatest(0, least(1, g + 0.5)) AS g, greatest(0, least(1, b + 0.5)) AS b FROM p)) SELECT key, y, x, CAST(v BETWEEN 0.4 AND 0.8 AS DOUBLE) AS value FROM m")
def image_hsv_mask(spark, d):
    return _pixels(shapes.hsv_mask(images.brightness_contrast(_coloured(spark, d), -0.5, 0.5), (0, 1), (0, 1), (0.4, 0.8)))


# Molecules

_RULED = {
    "mol_weight": "p_retailprice / 4", "logp": "p_size % 8", "h_donors": "p_partkey % 6", "h_acceptors": "p_size % 12", "rotatable_bonds": "p_partkey % 11", "tpsa": "p_partkey % 160",
    "molar_refractivity": "p_size * 3", "n_atoms": "p_size * 2", "heavy_atoms": "p_size", "formal_charge": "p_partkey % 4 - 2", "rings": "p_partkey % 7",
}


def _rules():
    for name, rules in molecules.DRUG_LIKENESS.items():

        def run(spark, d, name=name):
            p = table(spark, d, "part").selectExpr("p_partkey", *(f"{form} AS {c}" for c, form in _RULED.items()))
            out = molecules.drug_likeness(p, name)
            return out["matches"].select("p_partkey", F.lit(True).alias("holds")).union(out["rejects"].select("p_partkey", F.lit(False)))

        holds = " AND ".join(f"({_RULED[c]}) {op} {limit}" for c, op, limit in rules)
        query(f"SELECT p_partkey, {holds} AS holds FROM part", f"drug_likeness_{name}")(run)


_rules()


def _metrics():
    forms = {
        "tanimoto": "z / (m + n - z)", "dice": "2 * z / (m + n)", "cosine": "z / sqrt(m * n)", "sokal": "z / (2 * m + 2 * n - 3 * z)", "russel": "z / 64", "kulczynski": "z * (m + n) / (2 * m * n)",
        "mcconnaughey": "(z * (m + n) - m * n) / (m * n)", "asymmetric": "z / least(m, n)", "braunblanquet": "z / greatest(m, n)", "allbit": "(64 - (m + n - 2 * z)) / 64",
    }
    for name, form in forms.items():

        def run(spark, d, name=name):
            v = table(spark, d, "embeddings").select("vec_id", n.bits(F.col("embedding")).alias("fp"))
            return n.similarity_search(v, v.where("vec_id = 0"), "fp", 64, name, -1.0).select("vec_id", "similarity")

        query(f"""WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings), o AS (SELECT b AS c FROM b WHERE vec_id = 0),
z AS (SELECT vec_id, list_dot_product(b::DOUBLE[], c::DOUBLE[]) AS z, list_sum(b)::DOUBLE AS m, list_sum(c)::DOUBLE AS n FROM b, o) SELECT vec_id, coalesce(round_even({form}, 4), 0) AS similarity FROM z""", f"similarity_search_{name}")(run)


_metrics()


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'N') AND l_linenumber BETWEEN 2 AND 5 AND l_linestatus <> 'F' AND l_returnflag <> 'N'")
def edit_protein(spark, d):
    atoms = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_returnflag AS chain", "l_linenumber AS res_id", "CASE WHEN l_linestatus = 'F' THEN 'HOH' ELSE 'ALA' END AS res_name", "CASE WHEN l_returnflag = 'N' THEN 'HETATM' ELSE 'ATOM' END AS record")
    return molecules.edit_protein(atoms, ["A", "N"], (2, 5), None, True, True).select("l_orderkey", "l_linenumber")


# Screening: event types are groups, users are files, and a file's least value is its background

_CELLS = "SELECT event_type AS g, user_id AS s, event_id AS c, value AS v FROM events"


def _cells(spark, d):
    cells = table(spark, d, "events").selectExpr("event_type AS `group`", "CAST(user_id AS STRING) AS file_stem", "event_id AS cell", "value AS v")
    return cells, cells.groupBy("group", "file_stem").agg(F.min("v").alias("v"))


@query(f"""WITH x AS (SELECT g, s, c, v - min(v) OVER (PARTITION BY g, s) AS v FROM ({_CELLS})), m AS (SELECT avg(v) AS m FROM x WHERE g = 'click') SELECT g AS "group", s::VARCHAR AS file_stem, c AS cell, round(v / m, 6) AS v FROM x, m""")
def blank_normalize(spark, d):
    cells, background = _cells(spark, d)
    return _rounded(screening.blank_normalize(cells, background, "v", "click"), 6)


@query(f"""SELECT g AS "group", s::VARCHAR AS file_stem, c AS cell, v - min(v) OVER (PARTITION BY g, s) AS v FROM ({_CELLS})""")
def blank_subtract_files(spark, d):
    cells, background = _cells(spark, d)
    return screening.blank_normalize(cells, background, "v", "", False)


@query(f"""SELECT g AS "group", s::VARCHAR AS file_stem, c AS cell, v FROM ({_CELLS}) WHERE NOT (s = 7 AND c IN (1, 2, 3, 50)) AND NOT (s = 8 AND c = 9)""")
def exclude_cells(spark, d):
    return screening.exclude_cells(_cells(spark, d)[0], '{"7": [1, 2, 3, 50], "8": [9]}')


# Statistics

_MOMENTS = "SELECT event_type AS g, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1"


@query(f"""WITH g AS ({_MOMENTS}), t AS (SELECT count(*) AS k, sum(n)::DOUBLE AS n, sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS b, sum((n - 1) * v) AS w FROM g)
SELECT round(b / (b + w), 8) AS eta_squared, round((b - (k - 1) * w / (n - k)) / (b + w + w / (n - k)), 8) AS omega_squared FROM t""")
def variance_explained(spark, d):
    return _rounded(s.variance_explained(table(spark, d, "events"), "value", "event_type"), 8)


@query("""WITH k AS (SELECT l_quantity AS x, l_linenumber AS y, count(*)::DOUBLE AS c FROM lineitem GROUP BY 1, 2), s AS (SELECT sum(a.c * b.c * sign(b.y - a.y)) AS s FROM k a JOIN k b ON a.x < b.x), n AS (SELECT sum(c) AS n FROM k),
tx AS (SELECT sum(t * (t - 1) / 2) AS tx FROM (SELECT sum(c) AS t FROM k GROUP BY x)), ty AS (SELECT sum(t * (t - 1) / 2) AS ty FROM (SELECT sum(c) AS t FROM k GROUP BY y))
SELECT CAST(n AS BIGINT) AS n, round(s / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)), 8) AS tau FROM s, n, tx, ty""")
def kendall(spark, d):
    return _rounded(advanced.kendall(table(spark, d, "lineitem"), "l_quantity", "l_linenumber"), 8)


@query("""WITH e AS (SELECT event_type AS g, value AS v FROM events), p AS (SELECT a.g AS g1, b.g AS g2 FROM (SELECT DISTINCT g FROM e) a JOIN (SELECT DISTINCT g FROM e) b ON a.g < b.g),
r AS (SELECT g1, g2, g, rank() OVER (PARTITION BY g1, g2 ORDER BY v) + (count(*) OVER (PARTITION BY g1, g2, v) - 1) / 2.0 AS r FROM p JOIN e ON g = g1 OR g = g2),
u AS (SELECT g1, g2, count(*) FILTER (g = g1)::DOUBLE AS n1, count(*) FILTER (g = g2)::DOUBLE AS n2, sum(r) FILTER (g = g1) AS r FROM r GROUP BY 1, 2)
SELECT g1 AS group1, g2 AS group2, round(1 - 2 * (r - n1 * (n1 + 1) / 2) / (n1 * n2), 8) AS r FROM u""")
def rank_biserial(spark, d):
    return _rounded(advanced.rank_biserial(table(spark, d, "events"), "value", "event_type"), 8)


@query("""WITH r AS (SELECT event_type AS g, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY value) AS t FROM events),
g AS (SELECT g, count(*)::DOUBLE AS n, avg(r) AS m, sum(t * t - 1) AS t FROM r GROUP BY 1), a AS (SELECT sum(n) AS n, sum(t) AS t FROM g)
SELECT x.g AS group1, y.g AS group2, round((x.m - y.m) / sqrt((a.n * (a.n + 1) / 12 - a.t / (12 * (a.n - 1))) * (1 / x.n + 1 / y.n)), 6) AS z FROM g x JOIN g y ON x.g < y.g, a""")
def dunn_z(spark, d):
    return _rounded(s.dunn(table(spark, d, "events"), "value", "event_type").select("group1", "group2", "z"), 6)


@query("""SELECT round(var_samp(l_extendedprice) FILTER (l_linestatus = 'F') / var_samp(l_extendedprice) FILTER (l_linestatus = 'O'), 8) AS f, count(*) FILTER (l_linestatus = 'F') - 1 AS d1, count(*) FILTER (l_linestatus = 'O') - 1 AS d2 FROM lineitem""")
def f_test(spark, d):
    return _rounded(s.f_test(table(spark, d, "lineitem"), "l_extendedprice", "l_linestatus").select("f", "d1", "d2"), 8)


@query("""WITH k AS (SELECT count(*) FILTER (s = 'F' AND NOT b) AS a, count(*) FILTER (s = 'F' AND b) AS b, count(*) FILTER (s = 'O' AND NOT b) AS c, count(*) FILTER (s = 'O' AND b) AS d FROM (SELECT l_linestatus AS s, l_quantity > 45 AS b FROM lineitem)),
x AS (SELECT *, a + b AS r, a + c AS q, a + b + c + d AS t, unnest(range(greatest(0, a + b + a + c - (a + b + c + d)), least(a + b, a + c) + 1)) AS x FROM k),
p AS (SELECT *, exp(lgamma(r + 1) + lgamma(t - r + 1) + lgamma(q + 1) + lgamma(t - q + 1) - lgamma(t + 1) - lgamma(x + 1) - lgamma(r - x + 1) - lgamma(q - x + 1) - lgamma(t - r - q + x + 1)) AS p FROM x)
SELECT round(max(a * d / (b * c)), 8) AS odds_ratio, round(least(1, sum(p) FILTER (p <= (SELECT p FROM p WHERE x = a) * (1 + 1e-7))), 4) AS p FROM p""")
def fisher_exact(spark, d):
    li = table(spark, d, "lineitem").select("l_linestatus", (F.col("l_quantity") > 45).alias("b"))
    out = advanced.fisher_exact(li, "l_linestatus", "b")
    return out.select(F.round("odds_ratio", 8).alias("odds_ratio"), F.round("p", 4).alias("p"))


_TESTS = "SELECT c_custkey AS test, (c_custkey * 7919 % 100003 + 1) / 100004.0 AS p FROM customer"


def _corrections():
    """A test for each customer, with p-values that all differ."""
    over = "(ORDER BY p ROWS UNBOUNDED PRECEDING)"
    down = "(ORDER BY p DESC ROWS UNBOUNDED PRECEDING)"
    forms = {
        "none": "p", "bonferroni": "least(p * m, 1)", "sidak": "1 - (1 - p) ** m", "holm": f"least(max((m - i + 1) * p) OVER {over}, 1)", "holm-sidak": f"least(max(1 - (1 - p) ** (m - i + 1)) OVER {over}, 1)",
        "simes-hochberg": f"least(min((m - i + 1) * p) OVER {down}, 1)", "fdr_bh": f"least(min(m / i * p) OVER {down}, 1)", "fdr_by": f"least(min(m / i * h * p) OVER {down}, 1)",
    }
    for name, form in forms.items():

        def run(spark, d, name=name):
            tests = table(spark, d, "customer").selectExpr("c_custkey AS test", "CAST((c_custkey * 7919 % 100003 + 1) / 100004 AS DOUBLE) AS p")
            return s.adjusted(tests, "p", name).select("test", F.round("p_adj", 8).alias("p_adj"))

        query(f"WITH t AS (SELECT test, p::DOUBLE AS p, count(*) OVER ()::DOUBLE AS m, row_number() OVER (ORDER BY p)::DOUBLE AS i, (SELECT list_sum(list_transform(range(1, (SELECT count(*) + 1 FROM customer)), lambda k: 1 / k))) AS h FROM ({_TESTS})) SELECT test, round({form}, 8) AS p_adj FROM t", f"adjusted_{name.replace('-', '_')}")(run)


_corrections()


@query("""WITH s AS (SELECT count(*)::DOUBLE AS n, avg(v) AS m, var_pop(v) AS s2, min(v) AS a, max(v) AS b, avg(ln(v)) AS lm, var_pop(ln(v)) AS l2, avg(v * v) AS q, avg(abs(v - d)) AS l FROM (SELECT l_extendedprice AS v, median(l_extendedprice) OVER () AS d FROM lineitem)),
f AS (SELECT n, unnest(['normal', 'lognormal', 'exponential', 'uniform', 'rayleigh', 'laplace', 'pareto']) AS distribution, unnest([2, 2, 1, 2, 1, 2, 2]) AS parameters, unnest([-n / 2 * (ln(2 * pi() * s2) + 1), -n / 2 * (ln(2 * pi() * l2) + 1) - n * lm, -n * (ln(m) + 1), -n * ln(b - a),
n * (lm - ln(q / 2) - 1), -n * (ln(2 * l) + 1), n * (ln(1 / (lm - ln(a))) + ln(a) / (lm - ln(a))) - n * (1 / (lm - ln(a)) + 1) * lm]) AS x FROM s)
SELECT distribution, parameters, round(x, 2) AS log_likelihood, round(2 * parameters - 2 * x, 2) AS aic, round(parameters * ln(n) - 2 * x, 2) AS bic FROM f""")
def distribution_fits(spark, d):
    return _rounded(advanced.distribution_fits(table(spark, d, "lineitem"), "l_extendedprice"), 2)


@query(f"""WITH k AS (SELECT s, count(*) FILTER (y = 1) AS a, count(*) AS c FROM ({_PREDICTED}) GROUP BY 1), r AS (SELECT a, sum(a) OVER w AS tp, sum(c) OVER w AS n, sum(a) OVER () AS p FROM k WINDOW w AS (ORDER BY s DESC)) SELECT round(sum(a / p * tp / n), 8) AS average_precision FROM r""")
def average_precision(spark, d):
    return _rounded(evaluation.average_precision(_predicted(spark, d), "y", "s"), 8)


@query("""SELECT 'all' AS "group", CAST(t AS DOUBLE) AS time, CAST(n AS BIGINT) AS at_risk, CAST(d AS BIGINT) AS events FROM (SELECT o_custkey % 40 AS t, count(*) FILTER (o_orderstatus = 'F') AS d, sum(count(*)) OVER (ORDER BY o_custkey % 40 DESC) AS n FROM orders GROUP BY 1)""")
def kaplan_meier_ungrouped(spark, d):
    return s.kaplan_meier(_lives(spark, d), "t", "e").select("group", "time", "at_risk", "events")
