"""Feature queries: triplet observations of line items and gene trees of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import newick as nw
from ..operators import features as ft
from ..operators import triplets as tp
from ..plans import extraction as ex
from . import adapters as ad
from .q_trees import BACKBONES, TREES, relation
from .registry import big, query, r6

OBS = ad.observations_sql(ad.DUCK, "lineitem")
COUNTS = ", ".join(f"count(*) FILTER (topo = {k}) AS n{k}" for k in range(3))
FREQ = ", ".join(f"n{k} * 1e0 / (n0 + n1 + n2) AS p{k}" for k in range(3))
ASYM = ", ".join(
    f"CASE WHEN p{j} + p{k} > 0 THEN abs(p{j} - p{k}) / (p{j} + p{k}) ELSE 0e0 END AS g_asym{i}" for i, j, k in ((0, 1, 2), (1, 0, 2), (2, 0, 1))
)
MAJOR = "CASE WHEN p0 >= p1 AND p0 >= p2 THEN g_asym0 WHEN p1 >= p2 THEN g_asym1 ELSE g_asym2 END AS g_asym_major"
STATS = ", ".join(
    f"{f}(CASE WHEN topo = {k} THEN bl END) AS {n}_bl{k}" for k in range(3) for f, n in (("avg", "mean"), ("median", "median"), ("stddev_pop", "std"))
)


def full(source: str, keys: str) -> str:
    """All features of observations (keys, topo, bl)."""
    return f"""(SELECT *, {MAJOR}, ln(n0 + n1 + n2) AS log_gene_tree_count FROM (SELECT *, {ASYM} FROM (SELECT *, {FREQ} FROM
      (SELECT {keys}, {COUNTS}, {STATS} FROM ({source}) GROUP BY ALL))))"""


def rounded(columns) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


def shown(df, columns, keys=("simulation_id", "triplet_id")):
    return df.select(*keys, *[r6(c).alias(c) for c in columns])


def counted(spark, sf):
    """Counts only: one partial and one final aggregation."""
    is_k = [F.col("topo") == k for k in range(3)]
    return ad.observations(spark, sf).groupBy("simulation_id", "triplet_id", "taxon_a", "taxon_b", "taxon_c").agg(
        *[F.count(F.when(is_k[k], 1)).alias(f"n{k}") for k in range(3)]
    )


KEYED = "simulation_id, triplet_id"


@query("topology_counts", f"SELECT {KEYED}, {COUNTS} FROM ({OBS}) GROUP BY ALL")
def topology_counts(spark, sf):
    return counted(spark, sf).select("simulation_id", "triplet_id", "n0", "n1", "n2")


@query("topology_freqs", f"SELECT {KEYED}, {rounded(['p0', 'p1', 'p2'])} FROM {full(OBS, KEYED)}")
def topology_freqs(spark, sf):
    return shown(ft.derived(counted(spark, sf)), ["p0", "p1", "p2"])


@query("asymmetry", f"SELECT {KEYED}, {rounded(ft._ASYMMETRY)} FROM {full(OBS, KEYED)}")
def asymmetry(spark, sf):
    return shown(ft.derived(counted(spark, sf)), ft._ASYMMETRY)


@query("log_g", f"SELECT {KEYED}, {rounded(['log_gene_tree_count'])} FROM {full(OBS, KEYED)}")
def log_g(spark, sf):
    return shown(ft.derived(counted(spark, sf)), ["log_gene_tree_count"])


@query("branch_stats", f"SELECT {KEYED}, {rounded(ft._LENGTHS)} FROM {full(OBS, KEYED)}")
def branch_stats(spark, sf):
    return shown(ft.summarize(ad.observations(spark, sf)), ft._LENGTHS)


for _name, _set in (("base13_features", "base13"), ("enhanced17_observations", "enhanced"), ("feature_set_frequency_asymmetry", "frequency_asymmetry"),
                    ("feature_set_frequency_branch", "frequency_branch"), ("feature_set_branch_only", "branch_only"), ("feature_set_frequency_only", "frequency_only")):

    def _project(spark, sf, feature_set=_set):
        lengths = any("_bl" in c for c in ft.feature_columns(feature_set))
        rows = ft.summarize(ad.observations(spark, sf)) if lengths else ft.derived(counted(spark, sf))
        projected = ft.project(rows, feature_set)
        return shown(projected, ft.feature_columns(feature_set))

    query(_name, f"SELECT {KEYED}, {rounded(ft.feature_columns(_set))} FROM {full(OBS, KEYED)}")(_project)

TRIPLES = f"""WITH {relation(TREES, 'tree_id', 'newick')}, {relation(BACKBONES, 'simulation_id', 'backbone_newick', 'b_')},
obs AS (SELECT s.simulation_id, t.a || ',' || t.b || ',' || t.c AS triplet_id, t.topo, t.bl FROM trip t JOIN src s ON s.tree_id = t.id),
feats AS (SELECT f.*, g.topo AS label FROM {full('SELECT * FROM obs', KEYED)} f
  JOIN b_trip g ON g.id = f.simulation_id AND g.a || ',' || g.b || ',' || g.c = f.triplet_id)"""


def gene_features(spark, sf):
    return ex.extract_features(ad.gene_trees(spark, sf), ad.backbones(spark, sf))


@query("enhanced17_features", f"{TRIPLES} SELECT {KEYED}, n0, n1, n2, label::bigint AS label, {rounded(ft.feature_columns('enhanced'))} FROM feats")
def enhanced17_features(spark, sf):
    rows = gene_features(spark, sf)
    return rows.select(
        "simulation_id", "triplet_id", "n0", "n1", "n2", big("label").alias("label"), *[r6(c).alias(c) for c in ft.feature_columns("enhanced")]
    )


@query("extract_spread", f"{TRIPLES} SELECT {KEYED}, n0, n1, n2, label::bigint AS label, {rounded(ft.feature_columns('enhanced'))} FROM feats")
def extract_spread(spark, sf):
    """The same features by the plan that splits a triplet's lengths over tasks."""
    rows = ex.extract_features(ad.gene_trees(spark, sf), ad.backbones(spark, sf), spread=True)
    return rows.select(
        "simulation_id", "triplet_id", "n0", "n1", "n2", big("label").alias("label"), *[r6(c).alias(c) for c in ft.feature_columns("enhanced")]
    )


@query("extract_capped", f"""SELECT simulation_id, CASE WHEN gene_tree_count % 2 = 0 THEN 7 ELSE 20 END::bigint AS triplets, 6::bigint AS taxa,
gene_tree_count::bigint AS fewest, gene_tree_count::bigint AS most FROM ({BACKBONES})""")
def extract_capped(spark, sf):
    """Simulations with an even number of trees keep seven triplets, the others have no cap; every taxon is covered."""
    cap = F.when(F.col("gene_tree_count") % 2 == 0, 7)
    rows = ex.extract_features(ad.gene_trees(spark, sf), ad.backbones(spark, sf).withColumn("triplets_per_simulation", cap))
    seen = F.col("n0") + F.col("n1") + F.col("n2")
    counted = rows.groupBy("simulation_id").agg(
        F.count(F.lit(1)).alias("triplets"), F.size(F.array_distinct(F.flatten(F.collect_set(F.array(*ft.TAXA))))).alias("taxa"), F.min(seen).alias("fewest"), F.max(seen).alias("most")
    )
    return counted.select("simulation_id", "triplets", big("taxa").alias("taxa"), big("fewest").alias("fewest"), big("most").alias("most"))


@query("tree_count_guard", f"""WITH m AS (SELECT simulation_id, gene_tree_count + (hash32 % 3) - 1 AS expected, gene_tree_count FROM
  (SELECT *, {ad.DUCK.hash32('simulation_id', "'plan'")} AS hash32 FROM ({BACKBONES})))
SELECT simulation_id, expected::bigint AS expected, gene_tree_count::bigint AS found FROM m WHERE expected <> gene_tree_count""")
def tree_count_guard(spark, sf):
    planned = ad.backbones(spark, sf).withColumn(
        "gene_tree_count", F.col("gene_tree_count") + F.expr(ad.SPARK.hash32("simulation_id", "'plan'")) % 3 - 1
    )
    return ex.unmatched_simulations(ad.gene_trees(spark, sf), planned)


CAP = 8


def capped(spark, sf):
    users = nw.with_tree(ad.backbones(spark, sf), "backbone_newick").select(
        "simulation_id", F.col("tree")["taxa"].alias("taxa"), F.lit(CAP).alias("cap"), F.col("gene_tree_count").alias("seed")
    )
    return users, tp.capped_plan(users, "simulation_id", "taxa", "cap", "seed")


def _h(*parts: str) -> str:
    return ad.DUCK.hash32("seed", *parts)


PLAN = f"""WITH {relation(BACKBONES, 'simulation_id', 'backbone_newick')},
users AS (SELECT simulation_id, gene_tree_count AS seed FROM src),
tx AS (SELECT l.id, l.taxon, u.seed, row_number() OVER (PARTITION BY l.id ORDER BY l.taxon) - 1 AS x FROM leaves l JOIN users u ON u.simulation_id = l.id),
deal AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {_h("'cover'", 'taxon')}, taxon) - 1 AS r FROM tx),
cover AS (SELECT id, seed, r // 3 AS g, list_sort(list(taxon)) AS t FROM deal GROUP BY ALL),
combos AS (SELECT a.id, a.seed, [a.taxon, b.taxon, c.taxon] AS t, c.x * (c.x - 1) * (c.x - 2) // 6 + b.x * (b.x - 1) // 2 + a.x AS rank
  FROM tx a JOIN tx b ON a.id = b.id AND a.x < b.x JOIN tx c ON c.id = b.id AND b.x < c.x),
blocks AS (SELECT simulation_id AS id, seed, b, b * 20 // {CAP} AS lo, (b + 1) * 20 // {CAP} AS hi FROM users, range({CAP}) AS r(b)),
draws AS (SELECT c.id, c.seed, c.t FROM (SELECT *, lo + {_h("'draw'", 'b')} % (hi - lo) AS rank FROM blocks) d JOIN combos c ON c.id = d.id AND c.rank = d.rank),
merged AS (SELECT id, seed, t, min(late) AS late FROM (SELECT id, seed, t, 0 AS late FROM cover UNION ALL SELECT id, seed, t, 1 FROM draws) GROUP BY ALL),
plan AS (SELECT id, t FROM merged QUALIFY row_number() OVER (PARTITION BY id ORDER BY late, {_h("'order'", "array_to_string(t, ',')")}, array_to_string(t, ',')) <= {CAP})"""


@query("triplet_cap_sample", f"{PLAN} SELECT id AS simulation_id, array_to_string(t, ',') AS triplet_id FROM plan")
def triplet_cap_sample(spark, sf):
    _, plan = capped(spark, sf)
    return plan.select("simulation_id", tp.triplet_id(F.col("taxon_a"), F.col("taxon_b"), F.col("taxon_c")).alias("triplet_id"))


@query("triplet_coverage", f"""{PLAN},
pt AS (SELECT id, taxon, count(*) AS k FROM (SELECT id, unnest(t) AS taxon FROM plan) GROUP BY ALL),
ta AS (SELECT t.id, sum((k > 0)::int) AS covered, min(coalesce(k, 0)) AS lo, max(coalesce(k, 0)) AS hi FROM tx t LEFT JOIN pt USING (id, taxon) GROUP BY t.id),
pp AS (SELECT id, x, y, count(*) AS k FROM (SELECT id, t[1] AS x, t[2] AS y FROM plan UNION ALL SELECT id, t[1], t[3] FROM plan UNION ALL SELECT id, t[2], t[3] FROM plan) GROUP BY ALL),
pa AS (SELECT a.id, sum((k > 0)::int) AS covered, count(*) AS possible, min(coalesce(k, 0)) AS lo, max(coalesce(k, 0)) AS hi FROM tx a JOIN tx b
  ON a.id = b.id AND a.taxon < b.taxon LEFT JOIN pp ON pp.id = a.id AND pp.x = a.taxon AND pp.y = b.taxon GROUP BY a.id)
SELECT p.id AS simulation_id, p.n::bigint AS selected_triplets, 20::bigint AS possible_triplets, round(p.n / 20e0, 6) AS triplet_coverage,
  ta.covered::bigint AS covered_taxa, ta.lo::bigint AS minimum_triplets_per_taxon, ta.hi::bigint AS maximum_triplets_per_taxon,
  pa.covered::bigint AS covered_pairs, pa.possible::bigint AS possible_pairs, round(pa.covered / 15e0, 6) AS pair_coverage,
  pa.lo::bigint AS minimum_triplets_per_pair, pa.hi::bigint AS maximum_triplets_per_pair
FROM (SELECT id, count(*) AS n FROM plan GROUP BY id) p JOIN ta USING (id) JOIN pa USING (id)""")
def triplet_coverage(spark, sf):
    users, plan = capped(spark, sf)
    rows = tp.coverage(plan, users.select("simulation_id", F.array_sort("taxa").alias("taxa")))
    return rows.select(
        "simulation_id", *[r6(c).alias(c) if c in ("triplet_coverage", "pair_coverage") else big(c).alias(c) for c in rows.columns[1:]]
    )
