"""Design, source and relational queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import newick as nw
from ..functions import topology as topo
from ..operators import comparison as cmp
from ..operators import design as ds
from ..operators.ranking import row_numbers
from ..sources import nexus, numbering, tables
from . import adapters as ad
from .q_trees import BACKBONES, relation
from .registry import big, query, r6

MAN = ad.manifest_sql(ad.DUCK, "orders")


def customers_grid_sql(d, customer):
    """Every customer as a backbone with the whole grid of 108 candidate cells."""
    split = "explode" if d.name == "spark" else "unnest"
    lists = {"ils_length": "0.02e0, 0.1e0, 0.5e0", "gene_tree_count": "500, 1000, 2000, 2500", "gamma": "0.0e0, 0.25e0, 0.5e0", "k": "0, 1, 2"}
    # Spark's customers come with their backbone
    bb = "bb" if d.name == "spark" else f"'bb' || {d.text('cust')}"
    text = f"SELECT c_custkey AS cust{', bb' if d.name == 'spark' else ''} FROM {customer}"
    for name, values in lists.items():
        text = f"SELECT *, {split}({'array(' + values + ')' if d.name == 'spark' else '[' + values + ']'}) AS {name} FROM ({text}) AS t"
    pair = d.pick(["'close'", "'distant'", "'intermediate'"], "k")
    return (
        f"SELECT {bb} AS backbone_id, 4 + cust % 177 AS tree_size, gamma, ils_length, gene_tree_count, "
        f"CASE WHEN gamma = 0 THEN 'none' ELSE {pair} END AS pair_type, cast(CASE WHEN gamma = 0 THEN k + 1 ELSE 1 END as int) AS replicate, "
        f"'bb' || {d.text('cust')} || '|' || {d.text('gene_tree_count')} || '|' || {d.text('cast(100 * ils_length as int)')} || '|' || {d.text('cast(100 * gamma as int)')} || '|' || {d.text('k')} AS simulation_id, "
        f"'bb' || {d.text('cust')} || '|' || {d.text('gene_tree_count')} || '|' || {d.text('cast(100 * ils_length as int)')} || '|' || {d.text('cast(100 * gamma as int)')} AS scenario_group FROM ({text}) AS g"
    )


GRID = customers_grid_sql(ad.DUCK, "customer")


def grid(spark, sf):
    """A customer becomes 108 rows, so a small file of customers is dealt to many tasks first: by backbone, as the rows are grouped afterwards."""
    customers = ad.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("bb"), F.col("c_custkey").cast("string")).alias("bb"))
    customers = ad.dealt(customers, "bb", 2_000)
    return spark.sql(customers_grid_sql(ad.SPARK, "{source}"), source=customers)


@query("factor_grid", f"SELECT backbone_id, gamma, ils_length, gene_tree_count::bigint AS gene_tree_count, count(*) AS cells FROM ({GRID}) GROUP BY ALL")
def factor_grid(spark, sf):
    """Rows of a backbone are counted before they are multiplied: the grid's cells are many times the backbones, and need no state."""
    values = lambda xs, kind: F.array(*[F.lit(x).cast(kind) for x in xs])
    rows = ad.table(spark, sf, "customer").groupBy(F.concat(F.lit("bb"), F.col("c_custkey").cast("string")).alias("backbone_id")).agg(F.count(F.lit(1)).alias("cells"))
    for name, xs, kind in (("gamma", (0.0, 0.25, 0.5), "double"), ("ils_length", (0.02, 0.1, 0.5), "double"), ("gene_tree_count", (500, 1000, 2000, 2500), "bigint")):
        rows = rows.withColumn(name, F.explode(values(xs, kind)))
    # three replicates a cell
    return rows.select("backbone_id", "gamma", "ils_length", "gene_tree_count", (3 * F.col("cells")).alias("cells"))


@query("balanced_selection_12", f"""WITH o AS (SELECT DISTINCT backbone_id, {ad.DUCK.hash32("'9'", "'selection-offset|' || backbone_id")} % 12 AS o FROM ({GRID})),
s AS (SELECT backbone_id, o, s AS slot FROM o, range(12) r(s)),
p AS (SELECT a.*, (SELECT count(*) FROM range(12) q(q) WHERE q < a.slot AND (q + a.o) % 3 <> 0) AS before FROM s a),
w AS (SELECT backbone_id, slot, ([0.0e0, 0.25e0, 0.5e0])[1 + (slot + o) % 3] AS gamma, ([0.02e0, 0.1e0, 0.5e0])[1 + (slot // 3 + slot + o) % 3] AS ils_length,
  ([500, 1000, 2000, 2500])[1 + (slot + o) % 4] AS gene_tree_count, CASE WHEN (slot + o) % 3 = 0 THEN 'none' ELSE (['close', 'distant', 'intermediate'])[1 + (before + o) % 3] END AS pair_type,
  CASE WHEN (slot + o) % 3 = 0 THEN (slot // 3 + o) % 3 + 1 ELSE 1 END AS replicate FROM p)
SELECT simulation_id FROM w JOIN ({GRID}) g USING (backbone_id, gamma, ils_length, gene_tree_count, pair_type, replicate)""")
def balanced_selection_12(spark, sf):
    return ds.select_balanced(grid(spark, sf), 12, 9, exact_seed=False).select("simulation_id")


@query("balanced_selection_3")
def balanced_selection_3(spark, sf):
    """Three runs per backbone: blocks are chosen so that two margins stay level at once, so there is no SQL statement."""
    return ds.select_balanced(grid(spark, sf), 3, 9, exact_seed=False).select("backbone_id", "simulation_id", "analysis_selection_rank")


@query("balanced_selection_greedy")
def balanced_selection_greedy(spark, sf):
    """Five runs per backbone: one choice depends on the last, so there is no SQL statement."""
    return ds.select_balanced(grid(spark, sf), 5, 9, exact_seed=False).select("backbone_id", "simulation_id", "analysis_selection_rank")


@query("selection_rank", """WITH numbered AS (SELECT *, row_number() OVER () AS source_manifest_row FROM orders)
SELECT o_orderkey, source_manifest_row, row_number() OVER (PARTITION BY o_custkey ORDER BY source_manifest_row) AS analysis_selection_rank FROM numbered""")
def selection_rank(spark, sf):
    """Source rows of a table in its file order, and ranks in that order within a group."""
    rows = numbering.read_numbered(spark, f"{sf}/orders.parquet").select(
        "o_orderkey", "source_manifest_row", F.col("o_custkey").alias("backbone_id"), F.col("o_orderkey").cast("string").alias("simulation_id")
    )
    return ds.with_selection_rank(rows).select("o_orderkey", "source_manifest_row", big("analysis_selection_rank").alias("analysis_selection_rank"))


@query("manifest_audit", f"""SELECT count(*) AS rows, count(DISTINCT simulation_id) AS unique_ids, count(DISTINCT backbone_id) AS backbones,
  count(*) FILTER (gamma = 0 AND pair_type <> 'none') AS mislabelled_nulls, sum(gene_tree_count)::bigint AS gene_trees FROM ({MAN})""")
def manifest_audit(spark, sf):
    return ds.audit(ad.manifest(spark, sf))


@query("simulation_id_format", f"""SELECT simulation_id AS key, 'exp__' || backbone_id || '__ils' || printf('%.2f', ils_length) || '__g' || printf('%.2f', gamma) || '__G' || gene_tree_count || '__r' || replicate ||
  '__' || CASE WHEN gamma = 0 THEN 'none' ELSE 'AtoC__' || pair_type END AS name FROM ({MAN})""")
def simulation_id_format(spark, sf):
    rows = ad.manifest(spark, sf).withColumn("direction", F.when(F.col("gamma") == 0, "none").otherwise("A>C"))
    return rows.select(F.col("simulation_id").alias("key"), ds.simulation_ids("exp").alias("name"))


@query("replicates_explode", f"SELECT simulation_id, unnest(range(1, replicate + 1))::bigint AS replicate FROM ({MAN})")
def replicates_explode(spark, sf):
    rows = ad.manifest(spark, sf).select("simulation_id", F.explode(F.sequence(F.lit(1), F.col("replicate"))).alias("replicate"))
    return rows.withColumn("replicate", big("replicate"))


@query("rotate_backbones", """SELECT o_orderkey, c_custkey FROM orders JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS slot, count(*) OVER () AS pool FROM customer) c ON o_orderkey % pool = slot""")
def rotate_backbones(spark, sf):
    pool = row_numbers(ad.table(spark, sf, "customer").select("c_custkey"), [], [F.floor(F.col("c_custkey") / 1000)], [F.col("c_custkey")], "slot")
    size = ad.table(spark, sf, "customer").count()
    orders = ad.table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % size + 1).alias("slot"))
    return orders.join(pool, "slot").select("o_orderkey", "c_custkey")


def parsed_backbones(spark, sf):
    return nw.with_tree(ad.backbones(spark, sf), "backbone_newick")


BREL = f"WITH {relation(BACKBONES, 'simulation_id', 'backbone_newick')}"


@query("directions_all", BREL + " SELECT x.id AS simulation_id, x.taxon AS donor, y.taxon AS recipient FROM leaves x JOIN leaves y ON x.id = y.id AND x.taxon <> y.taxon")
def directions_all(spark, sf):
    rows = parsed_backbones(spark, sf).select("simulation_id", F.explode_outer(ds.ordered_pairs(F.col("tree")["taxa"])).alias("d"))
    return rows.select("simulation_id", "d.donor", "d.recipient")


@query("distance_stratified_pairs", BREL + f""", d AS (SELECT p.id, p.a, p.b, x.dep + y.dep - 2 * (p.dep - 1) AS k FROM pairs p JOIN leaves x ON x.id = p.id AND x.taxon = p.a JOIN leaves y ON y.id = p.id AND y.taxon = p.b),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k, a, b) - 1 AS n, count(*) OVER (PARTITION BY id) AS m FROM d),
c AS (SELECT *, CASE WHEN n = 0 THEN 'close' WHEN n = m // 2 THEN 'intermediate' WHEN n = m - 1 THEN 'distant' END AS pair_type FROM r),
s AS (SELECT *, {ad.DUCK.hash32("'3'", 'id', 'pair_type')} % 2 = 1 AS swap FROM c WHERE pair_type IS NOT NULL)
SELECT id AS simulation_id, CASE WHEN swap THEN b ELSE a END AS donor, CASE WHEN swap THEN a ELSE b END AS recipient, pair_type, k::bigint AS distance FROM s""")
def distance_stratified_pairs(spark, sf):
    rows = ds.stratified_pairs(parsed_backbones(spark, sf), "tree", ["simulation_id"], 3, "simulation_id")
    return rows.withColumn("distance", big("distance"))


@query("balance_quartile", BREL + """, sides AS (SELECT n.id, n.opos, abs(count(*) FILTER (l.pos < w.pos) - count(*) FILTER (l.pos > w.pos)) AS gap
  FROM nodes n JOIN wk w ON w.id = n.id AND w.tok = ',' AND w.dep = n.dep AND w.pos > n.opos AND w.pos < n.cpos
  JOIN leaves l ON l.id = n.id AND l.pos > n.opos AND l.pos < n.cpos GROUP BY ALL),
c AS (SELECT id, sum(gap) AS g FROM sides GROUP BY id), r AS (SELECT *, row_number() OVER (ORDER BY g, id) - 1 AS i, count(*) OVER () AS n FROM c)
SELECT id AS simulation_id, 'Q' || (least(3, 4 * i // n) + 1) AS backbone_balance_bin FROM r""")
def balance_quartile(spark, sf):
    # a generated column is computed once; the two sides of the ranking join would repeat an alias
    rows = parsed_backbones(spark, sf).select("simulation_id", F.explode_outer(F.array(nw.colless(F.col("tree")))).alias("g"))
    ranked = row_numbers(rows, [], [F.col("g"), F.substring("simulation_id", 1, 3)], [F.col("simulation_id")], "i", total="n")
    return ranked.select("simulation_id", F.concat(F.lit("Q"), (ds.quartile(F.col("i"), F.col("n")) + 1).cast("string")).alias("backbone_balance_bin"))


@query("render_backbone", BREL + """, top AS (SELECT id, max(dep) AS deepest FROM nodes GROUP BY id)
SELECT l.id AS simulation_id, l.taxon, round(1 + (deepest - 1) * 0.2e0 - (l.dep - 1) * 0.2e0, 6) AS pendant FROM leaves l JOIN top USING (id)""")
def render_backbone(spark, sf):
    rows = ad.backbones(spark, sf).withColumn("topology", topo.topology_key(F.col("backbone_newick")))
    drawn = topo.render(rows, "topology", F.lit(0.2), F.lit(1.0), "text")
    leaf = F.regexp_extract_all("text", F.lit(r"([A-Z]):([0-9.]+)"), F.lit(0))
    parts = drawn.select("simulation_id", F.explode_outer(leaf).alias("leaf"))
    return parts.select("simulation_id", F.substring("leaf", 1, 1).alias("taxon"), r6(F.expr("substring(leaf, 3)")).alias("pendant"))


@query("render_network")
def render_network(spark, sf):
    """Extended Newick text per backbone and stratified pair; tests check its form."""
    pairs = ds.stratified_pairs(parsed_backbones(spark, sf), "tree", ["simulation_id"], 3, "simulation_id")
    rows = pairs.join(ad.backbones(spark, sf), "simulation_id").withColumn("topology", topo.topology_key(F.col("backbone_newick")))
    drawn = topo.render(rows, "topology", F.lit(0.1), F.lit(1.0), "network_newick", F.col("donor"), F.col("recipient"), F.lit(0.25), F.lit(0.25))
    return drawn.select("simulation_id", "pair_type", "donor", "recipient", "network_newick")


# sources ---------------------------------------------------------------------------------------------


@query("first_newick", r"""WITH d AS (SELECT doc_id, CASE WHEN strpos(text, '(') > 0 THEN substr(text, strpos(text, '(')) END AS tail FROM documents),
t AS (SELECT doc_id, unnest(toks) AS tok, unnest(range(1, len(toks) + 1)) AS pos FROM (SELECT doc_id, regexp_extract_all(tail, '''[^'']*(?:''|$)|"[^"]*(?:"|$)|[\[\];]|[^''"\[\];]+') AS toks FROM d)),
w AS (SELECT *, sum(CASE tok WHEN '[' THEN 1 WHEN ']' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS s, sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY pos) AS size FROM t),
m AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY doc_id ORDER BY pos)) AS depth FROM w),
e AS (SELECT doc_id, min(size)::bigint AS size FROM m WHERE tok = ';' AND depth = 0 GROUP BY doc_id)
SELECT d.doc_id, length(substr(tail, 1, size))::bigint AS size, md5(substr(tail, 1, size)) AS digest FROM d LEFT JOIN e USING (doc_id)""")
def first_newick(spark, sf):
    statement = nw.first_statement(F.col("text"))
    rows = ad.table(spark, sf, "documents").select("doc_id", statement.alias("s"))
    return rows.select("doc_id", big(F.length("s")).alias("size"), F.md5("s").alias("digest"))


def nexus_sql(d, events):
    """A best-tree file per event: numbered taxa, two scored trees with comments and lengths."""
    score = d.text("event_id % 97")
    return (
        f"SELECT event_id, '#NEXUS Begin trees; translate 1 ' || event_type || ', 2 ''u' || {d.text('user_id')} || ''', 3 C, 4 D; "
        f"tree t1 [ -' || {score} || '.5 ] = (((1:0.1,2:0.2)[x]:0.3,3:1),4:2); TREE t2 [-' || {d.text('event_id % 89')} || '] = ((1,(2,4)),3); End;' AS text FROM {events}"
    )


@query("nexus_best_trees", """WITH c AS (SELECT event_id, -(event_id % 97) - 0.5e0 AS score, 0 AS position, '(((' || event_type || ',u' || user_id || '),C),D);' AS newick FROM events
UNION ALL SELECT event_id, -(event_id % 89) * 1e0, 1, '((' || event_type || ',(u' || user_id || ',D)),C);' FROM events)
SELECT event_id, round(score, 6) + 0e0 AS score, newick FROM c QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY score DESC, position) = 1""")
def nexus_best_trees(spark, sf):
    scored = nexus.scored_trees(ad.derive(spark, sf, nexus_sql, "events"), "text", ["event_id"])
    return nexus.best_trees(scored, "event_id").select("event_id", r6("score").alias("score"), "newick")


@query("nexus_data_block", f"""{BREL}, t AS (SELECT id, list_sort(list(taxon)) AS taxa FROM leaves GROUP BY id), n AS (SELECT simulation_id AS id, gene_tree_count AS g FROM src)
SELECT id AS simulation_id, count(*) AS lines, sum(length(line))::bigint AS characters FROM (
  SELECT id, unnest(['#NEXUS', 'Begin data;', 'dimension ngene=' || g || ' ntaxa=' || len(taxa) || ';', 'Format tree=rooted outgroup=' || taxa[1] || ';', 'matrix', ';', 'End;', 'Begin trees;', 'End;']) AS line FROM t JOIN n USING (id)
  UNION ALL SELECT id, taxon || ' 1 ' || taxon FROM leaves UNION ALL SELECT simulation_id, newick FROM ({ad.gene_trees_sql(ad.DUCK, 'events')})) GROUP BY id""")
def nexus_data_block(spark, sf):
    taxa = parsed_backbones(spark, sf).select("simulation_id", F.array_sort(F.col("tree")["taxa"]).alias("taxa"), "gene_tree_count")
    lines = nexus.data_block(ad.gene_trees(spark, sf), taxa)
    return lines.groupBy("simulation_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("characters"))


RECORDS = "SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice FROM orders"


@query("upsert_records", """WITH e AS (SELECT c_custkey AS simulation_id, 'completed' AS status, c_acctbal AS score FROM customer),
c AS (SELECT o_custkey AS simulation_id, CASE WHEN min(o_orderkey) % 3 = 0 THEN 'skipped_existing' ELSE 'completed' END AS status, max(o_totalprice) AS score FROM orders GROUP BY 1),
u AS (SELECT *, 1 AS p FROM e UNION ALL SELECT *, CASE WHEN status = 'skipped_existing' THEN 0 ELSE 2 END FROM c)
SELECT simulation_id, status, round(score, 6) AS score FROM u QUALIFY row_number() OVER (PARTITION BY simulation_id ORDER BY p DESC) = 1""")
def upsert_records(spark, sf):
    old = ad.table(spark, sf, "customer").select(F.col("c_custkey").alias("simulation_id"), F.lit("completed").alias("status"), F.col("c_acctbal").alias("score"))
    status = F.when(F.min("o_orderkey") % 3 == 0, "skipped_existing").otherwise("completed")
    new = ad.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("simulation_id")).agg(status.alias("status"), F.max("o_totalprice").alias("score"))
    return tables.upsert_records(old, new).withColumn("score", r6("score"))


# relational checklist ----------------------------------------------------------------------------------


@query("column_pruned_scan", "SELECT l_orderkey, l_linenumber FROM lineitem")
def column_pruned_scan(spark, sf):
    return tables.read_table(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_linenumber"]).withColumn("l_linenumber", F.col("l_linenumber"))


@query("optional_columns", "SELECT o_orderkey, o_orderstatus FROM orders")
def optional_columns(spark, sf):
    return tables.read_table(spark, f"{sf}/orders.parquet", ["o_orderkey"], ["o_orderstatus", "perturbation"])


@query("filter_between", f"SELECT simulation_id, tree_size FROM ({MAN}) WHERE tree_size BETWEEN 4 AND 20")
def filter_between(spark, sf):
    return ad.manifest(spark, sf).where(F.col("tree_size").between(4, 20)).select("simulation_id", "tree_size")


@query("multi_predicate_filter", f"SELECT simulation_id FROM ({MAN}) WHERE abs(gamma - 0.25) < 1e-9 AND abs(ils_length - 0.1) < 1e-9 AND gene_tree_count = 1000 AND pair_type = 'close'")
def multi_predicate_filter(spark, sf):
    near = lambda c, v: F.abs(F.col(c) - v) < 1e-9
    return ad.manifest(spark, sf).where(near("gamma", 0.25) & near("ils_length", 0.1) & (F.col("gene_tree_count") == 1000) & (F.col("pair_type") == "close")).select("simulation_id")


@query("anti_join_pending", "SELECT c_custkey AS simulation_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join_pending(spark, sf):
    wanted = ad.table(spark, sf, "customer").select(F.col("c_custkey").alias("simulation_id"))
    return tables.pending(wanted, ad.table(spark, sf, "orders").select(F.col("o_custkey").alias("simulation_id")))


@query("cover_check", "SELECT c_custkey AS simulation_id, 1::bigint AS expected, coalesce(n, 0) AS found FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey WHERE coalesce(n, 0) <> 1")
def cover_check(spark, sf):
    wanted = ad.table(spark, sf, "customer").select(F.col("c_custkey").alias("simulation_id"))
    return tables.cover_problems(wanted, ad.table(spark, sf, "orders").select(F.col("o_custkey").alias("simulation_id")))


@query("pivot_balance", f"SELECT backbone_id, count(*) FILTER (gamma = 0) AS g0, count(*) FILTER (gamma = 0.25) AS g25, count(*) FILTER (gamma = 0.5) AS g50 FROM ({MAN}) GROUP BY 1")
def pivot_balance(spark, sf):
    rows = ad.manifest(spark, sf).groupBy("backbone_id").pivot("gamma", [0.0, 0.25, 0.5]).count().na.fill(0)
    return rows.toDF("backbone_id", "g0", "g25", "g50")


@query("first_wins_dedup", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def first_wins_dedup(spark, sf):
    return cmp.first_wins(ad.table(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderkey")], ["o_orderkey", "o_orderstatus"])
