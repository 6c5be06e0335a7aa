"""Weights, split scores and assembly over the gene-tree features of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import newick as nw
from ..operators import assembly as asm
from ..operators import evaluation as ev
from ..operators import features as ft
from ..operators import weights as wt
from . import adapters as ad
from .q_features import TRIPLES, counted, gene_features, full, OBS, KEYED
from .registry import big, query, r6

PRED = ad.predictions_sql(ad.DUCK, "events")


def argmax(p: str) -> str:
    return f"CASE WHEN {p}0 >= {p}1 AND {p}0 >= {p}2 THEN 0 WHEN {p}1 >= {p}2 THEN 1 ELSE 2 END"


def weight_sql(kind: str, p: str) -> str:
    """weight0..2 of a winner-takes-all mode."""
    height = "1e0" if kind == "one" else f"greatest({p}0, {p}1, {p}2)"
    return ", ".join(f"round(CASE WHEN {argmax(p)} = {k} THEN {height} ELSE 0e0 END, 6) AS weight{k}" for k in range(3))


SOFT = ", ".join(f"round({{p}}{k}, 6) AS weight{k}" for k in range(3))


def weights_only(df):
    return df.select("simulation_id", "triplet_id", *[r6(w).alias(w) for w in asm.WEIGHTS])


def modelled(spark, sf, mode):
    """Features of the line items' triplets stand aside; the predictions of events carry the probabilities."""
    predictions = ad.predictions(spark, sf)
    keys = predictions.select("simulation_id", "triplet_id")
    return weights_only(wt.with_weights(keys, mode, predictions.select("simulation_id", "triplet_id", "prob0", "prob1", "prob2")))


@query("w_frequency", f"SELECT {KEYED}, {SOFT.format(p='p')} FROM {full(OBS, KEYED)}")
def w_frequency(spark, sf):
    return weights_only(wt.with_weights(ft.derived(counted(spark, sf)), "frequency"))


@query("w_majority", f"SELECT {KEYED}, {weight_sql('one', 'p')} FROM {full(OBS, KEYED)}")
def w_majority(spark, sf):
    return weights_only(wt.with_weights(ft.derived(counted(spark, sf)), "majority"))


@query("w_soft", f"SELECT {KEYED}, {SOFT.format(p='prob')} FROM ({PRED})")
def w_soft(spark, sf):
    return modelled(spark, sf, "ml-soft")


@query("w_hard", f"SELECT {KEYED}, {weight_sql('one', 'prob')} FROM ({PRED})")
def w_hard(spark, sf):
    return modelled(spark, sf, "ml-hard")


@query("w_confidence", f"SELECT {KEYED}, {weight_sql('top', 'prob')} FROM ({PRED})")
def w_confidence(spark, sf):
    return modelled(spark, sf, "ml-confidence")


# integer weights: the majority vote of a user's gene trees, and the vote counts
VOTES = f"""{TRIPLES},
votes AS (SELECT simulation_id, split_part(triplet_id, ',', 1) AS a, split_part(triplet_id, ',', 2) AS b, split_part(triplet_id, ',', 3) AS c,
  (n0 >= n1 AND n0 >= n2)::int AS w0, (n1 > n0 AND n1 >= n2)::int AS w1, (n2 > n0 AND n2 > n1)::int AS w2, n0, n1, n2 FROM feats)"""


def majority(spark, sf):
    return wt.with_weights(gene_features(spark, sf), "majority")


def vote_counts(spark, sf):
    return gene_features(spark, sf).withColumns({f"weight{k}": F.col(f"n{k}").cast("double") for k in range(3)})


@query("weighted_topologies", f"""{VOTES} SELECT simulation_id, a AS first, b AS second, c AS outgroup, w0::bigint AS weight FROM votes
UNION ALL SELECT simulation_id, a, c, b, w1 FROM votes UNION ALL SELECT simulation_id, b, c, a, w2 FROM votes""")
def weighted_topologies(spark, sf):
    return wt.weighted_topologies(majority(spark, sf), ["simulation_id"]).withColumn("weight", big("weight"))


@query("pair_support", f"""{VOTES}, t AS (SELECT simulation_id, a AS first, b AS second, n0 AS w FROM votes
UNION ALL SELECT simulation_id, a, c, n1 FROM votes UNION ALL SELECT simulation_id, b, c, n2 FROM votes)
SELECT simulation_id, first, second, round(sum(w)::double, 6) AS support FROM t GROUP BY ALL""")
def pair_support(spark, sf):
    return wt.pair_support(vote_counts(spark, sf)).withColumn("support", r6("support"))


SPLITS = f"""{VOTES},
bits AS (SELECT simulation_id, 1 << (ascii(a) - 65) AS a, 1 << (ascii(b) - 65) AS b, 1 << (ascii(c) - 65) AS c, {{w}} FROM votes),
cand AS (SELECT m.m, s.s, bit_count(m.m) AS k, abs(2 * bit_count(s.s) - bit_count(m.m)) AS gap,
  list_aggregate(list_filter(range(6), lambda i: (s.s >> i) & 1 = 1)::varchar[], 'string_agg', '') AS members
  FROM range(64) m(m) JOIN range(64) s(s) ON s.s & m.m = s.s AND s.s <> m.m AND s.s & (m.m & -m.m) > 0 WHERE bit_count(m.m) >= 3),
sides AS (SELECT *, a | b | c AS al FROM bits)"""


def level(source: str) -> str:
    """Best split of every (simulation_id, m)."""
    return f"""SELECT simulation_id, m, s, round(score, 12) AS score, gap, members FROM (
  SELECT q.simulation_id, q.m, c.s, c.gap, c.members, coalesce(sum(CASE WHEN t.al & c.s = 0 OR t.al & c.s = t.al THEN NULL ELSE
    2 * (CASE (CASE WHEN bit_count(t.al & c.s) = 1 THEN t.al & c.s ELSE xor(t.al, t.al & c.s) END) WHEN t.c THEN t.w0 WHEN t.b THEN t.w1 ELSE t.w2 END)
    - (t.w0 + t.w1 + t.w2) END) * 1e0 / count(CASE WHEN t.al & c.s = 0 OR t.al & c.s = t.al THEN NULL ELSE 1 END), '-infinity'::double) AS score
  FROM ({source}) q JOIN cand c ON c.m = q.m LEFT JOIN sides t ON t.simulation_id = q.simulation_id AND t.al & q.m = t.al GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY simulation_id, m ORDER BY round(score, 12) DESC, gap, members DESC) = 1"""


def grown(weights: str) -> str:
    """CTEs ending in ``sets(simulation_id, clade)``: the nontrivial clades of the tree grown from six taxa."""
    text = SPLITS.format(w=weights)
    source = "SELECT DISTINCT simulation_id, 63::bigint AS m FROM votes"
    halves = []
    for depth in range(4):
        text += f",\nl{depth} AS ({level(source)}),\nh{depth} AS (SELECT simulation_id, s AS m FROM l{depth} UNION ALL SELECT simulation_id, xor(m, s) FROM l{depth})"
        source = f"SELECT simulation_id, m FROM h{depth} WHERE bit_count(m) >= 3"
        halves.append(f"SELECT simulation_id, m FROM h{depth} WHERE bit_count(m) >= 2")
    joined = " UNION ALL ".join(halves)
    return text + f""",
sets AS (SELECT simulation_id, list_aggregate(list_transform(list_filter(range(6), lambda i: (m >> i) & 1 = 1), lambda i: chr((65 + i)::int)), 'string_agg', ',') AS clade
  FROM ({joined}))"""


VOTE = "w0, w1, w2"
COUNT = "n0 AS w0, n1 AS w1, n2 AS w2"


@query("split_score", f"""{SPLITS.format(w=COUNT)}
SELECT t.simulation_id, c.members, round(sum(2 * (CASE (CASE WHEN bit_count(t.al & c.s) = 1 THEN t.al & c.s ELSE xor(t.al, t.al & c.s) END)
  WHEN t.c THEN t.w0 WHEN t.b THEN t.w1 ELSE t.w2 END) - (t.w0 + t.w1 + t.w2)) * 1e0 / count(*), 6) AS score
FROM sides t JOIN cand c ON c.m = 63 WHERE t.al & c.s <> 0 AND t.al & c.s <> t.al GROUP BY ALL""")
def split_score(spark, sf):
    rows = asm.gather(vote_counts(spark, sf)).withColumn("m", asm.masked_triplets()).withColumn("n", F.size("taxa"))
    rows = rows.select("simulation_id", "n", "m", F.explode_outer(asm.bipartitions(asm._bit(F.col("n")) - 1, F.col("n"))).alias("left"))
    return rows.select(
        "simulation_id", F.array_join(asm._members(F.col("left"), F.col("n")), "").alias("members"),
        r6(asm.score_split(F.col("m"), F.col("left"))).alias("score"),
    )


@query("exact_best_split", f"""{SPLITS.format(w=COUNT)} SELECT simulation_id, members, round(score, 6) AS score
FROM ({level("SELECT DISTINCT simulation_id, 63::bigint AS m FROM votes")})""")
def exact_best_split(spark, sf):
    rows = asm.gather(vote_counts(spark, sf)).withColumn("m", asm.masked_triplets()).withColumn("n", F.size("taxa"))
    rows = rows.withColumn("best", asm.best_split(asm._bit(F.col("n")) - 1, F.col("m"), F.col("n")))
    return rows.select("simulation_id", F.array_join(F.col("best")["members"], "").alias("members"), r6(F.col("best")["score"]).alias("score"))


def clade_rows(assembled):
    rows = nw.with_tree(assembled, "inferred_newick")
    return rows.select("simulation_id", F.explode_outer(nw.clades(F.col("tree"))).alias("clade"))


@query("assemble_exact_counts", f"{grown(COUNT)} SELECT simulation_id, clade FROM sets")
def assemble_exact_counts(spark, sf):
    return clade_rows(asm.assemble(vote_counts(spark, sf), "exact"))


@query("assemble_exact_majority", f"{grown(VOTE)} SELECT simulation_id, clade FROM sets")
def assemble_exact_majority(spark, sf):
    return clade_rows(asm.assemble(majority(spark, sf), "exact"))


def scored(spark, sf, weighted, method):
    solved = asm.assemble(weighted, method).join(ad.backbones(spark, sf).select("simulation_id", "backbone_newick"), "simulation_id")
    rows = ev.evaluate_rows(solved)
    return rows.select(
        "simulation_id", "assembly_status", "evaluation_status", "fully_resolved_inferred_tree", big("rooted_rf").alias("rooted_rf"),
        r6("normalized_rooted_rf").alias("normalized_rooted_rf"), "exact_match",
    )


RF = """, bb AS (SELECT id AS simulation_id, clade FROM b_clades),
merged AS (SELECT coalesce(b.simulation_id, s.simulation_id) AS simulation_id, (b.clade IS NULL)::int + (s.clade IS NULL)::int AS off
  FROM bb b FULL OUTER JOIN sets s ON s.simulation_id = b.simulation_id AND s.clade = b.clade)
SELECT simulation_id, 'completed' AS assembly_status, 'ok' AS evaluation_status, true AS fully_resolved_inferred_tree, sum(off)::bigint AS rooted_rf,
  round(sum(off) / 8e0, 6) AS normalized_rooted_rf, sum(off) = 0 AS exact_match FROM merged GROUP BY simulation_id"""


@query("flagship", grown(VOTE) + RF)
def flagship(spark, sf):
    """Gene trees, features, majority weights, exact assembly, rooted RF against the backbone."""
    return scored(spark, sf, majority(spark, sf), "exact")


@query("assemble_fm")
def assemble_fm(spark, sf):
    """Move-based search; sequential within a simulation, so it has no SQL statement."""
    return scored(spark, sf, majority(spark, sf), "fm")


@query("assemble_fm_frequency")
def assemble_fm_frequency(spark, sf):
    return scored(spark, sf, wt.with_weights(gene_features(spark, sf), "frequency"), "fm")


ORACLE_RF = f"""{TRIPLES} SELECT DISTINCT simulation_id, 'completed' AS assembly_status, 'ok' AS evaluation_status, true AS fully_resolved_inferred_tree,
  0::bigint AS rooted_rf, 0e0 AS normalized_rooted_rf, true AS exact_match FROM feats"""


@query("assembly_oracle_fm", ORACLE_RF)
def assembly_oracle_fm(spark, sf):
    """True labels through the move-based search: every six-taxon backbone comes back."""
    return scored(spark, sf, wt.one_hot_labels(gene_features(spark, sf)), "fm")


@query("assembly_oracle_exact", ORACLE_RF)
def assembly_oracle_exact(spark, sf):
    return scored(spark, sf, wt.one_hot_labels(gene_features(spark, sf)), "exact")
