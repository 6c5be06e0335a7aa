"""Nearest neighbours by inner product: NN-descent builds a graph with Spark joins, queries walk it greedily.

1. Equal vectors are one node (the smallest id, with its first ids kept), so copies can't crowd a neighbourhood.
   Vectors are divided by a high quantile of the norms, and those up to it get one more component that makes them unit
   vectors: the largest inner product with a query is then the smallest distance, and the graph is one of a metric space.
   A vector is kept as 8-bit components with a scale of its own, so a few long vectors don't flatten the others; distances
   are taken without the difference of numbers near one. The longest vectors are entries of every search.
2. First neighbours: nodes next to the same pivots (a bounded sample of nodes) are compared in small blocks.
3. NN-descent: a node introduces its neighbours, and those that have it as neighbour, to each other (a join of edges with
   vectors, then a shuffle to the introducing node). Pairs that beat the worst neighbour of one of them are merged
   into its list. Pairs that have met before are skipped. Rounds end when few lists change.
4. Search: all queries walk at once. A query holds a beam of the best nodes seen; each hop joins the best ones not yet
   expanded with the graph, whose rows carry the (8-bit) vectors of their neighbours, and merges what beats the
   beam. It ends when every beam is expanded.
5. The nodes of the beam are scored again with the original vectors in double precision, as are their copies.

Rules for unusual rows: vectors that are NULL, zero, or hold a NULL or a non-finite component take no part, nor do those of
another length than most. Rows with a NULL id are left out; of rows that share an id, the smallest vector counts. Ties
go to the smaller id. With no more than ``neighbours`` other rows, all of them are returned. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stored, union

SCALE = 127.0
#: Below every score: an inner product, or minus a squared distance.
NONE = -3e38
#: Norms are divided by this quantile of them, and stay under LONGEST then.
RADIUS = 0.99
LONGEST = 1e9


@dataclass(frozen=True)
class Settings:
    degree: int = 32  # neighbours in a node's list
    reverse: int = 24  # nodes listing a node that it introduces, chosen by a hash
    met: int = 6  # best partners that one introduction reports for a node
    pivots: int = 128
    pivot_sets: int = 3
    block: int = 256  # nodes compared with each other at the start
    rounds: int = 7
    settled: float = 0.01  # share of list entries that still change when rounds end
    beam: int = 256
    step: int = 32  # nodes of a beam expanded in one hop
    entries: int = 32


def _lists(batch_rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*batch_rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of a sorted partition, key by key (the first column), as column arrays of one key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(a, b - a)
            if held and held[0].column(0)[0] != part.column(0)[0]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _decoded(raw: bytes | pa.Buffer, count: int) -> tuple[np.ndarray, np.ndarray]:
    """8-bit components and scales of codes in a row."""
    cells = np.frombuffer(raw, np.int8).reshape(count, -1)
    return cells[:, 4:], np.ascontiguousarray(cells[:, :4]).view(np.float32)


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    cells, scale = _decoded(b"".join(x.as_py() for x in column), len(column))
    return cells.astype(np.float32) * scale


def _nearness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minus the squared distances of all pairs, with the added components."""
    m, n = (a * a).sum(axis=1), (b * b).sum(axis=1)
    p, q = np.minimum(m, 1), np.minimum(n, 1)
    both = np.sqrt(1 - p)[:, None] + np.sqrt(1 - q)[None, :]
    apart = (p[:, None] - q[None, :]) / np.where(both > 0, both, 1)  # of the added components
    return 2 * (a @ b.T) - m[:, None] - n[None, :] - apart * apart


def unit_vectors(rows: DataFrame, radius: float) -> DataFrame:
    """``(node, code)``: a scale and 8-bit components of the vector divided by ``radius``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([np.asarray(v, np.float64) for v in batch.column(1).to_pylist()])
            most = np.abs(x).max(axis=1, keepdims=True)
            x = x / most
            length = np.sqrt((x * x).sum(axis=1, keepdims=True))
            scale = (np.minimum(most / radius, LONGEST / length) / SCALE).astype(np.float32)
            cells = np.rint(x * SCALE).astype(np.int8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f.tobytes() + c.tobytes() for f, c in zip(scale, cells, strict=True)], pa.binary())], names=["node", "code"])

    return rows.mapInArrow(run, "node bigint, code binary")


EDGE = "u bigint, v bigint, s float"


def _best_in_block(ids: np.ndarray, vectors: np.ndarray, degree: int) -> pa.RecordBatch:
    scores = _nearness(vectors, vectors)
    np.fill_diagonal(scores, NONE)
    keep = min(degree, len(ids) - 1)
    best = np.argpartition(-scores, keep - 1, axis=1)[:, :keep] if keep else np.empty((len(ids), 0), int)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(ids, keep)), pa.array(ids[best].ravel()), pa.array(np.take_along_axis(scores, best, 1).ravel().astype(np.float32))], names=["u", "v", "s"]
    )


def first_neighbours(nodes: DataFrame, settings: Settings) -> DataFrame:
    spark = nodes.sparkSession
    parts = []
    for number in range(settings.pivot_sets):
        sample = nodes.orderBy(F.xxhash64("node", F.lit(number))).limit(settings.pivots).collect()
        pivots = _vectors(pa.chunked_array([pa.array([bytes(r["code"]) for r in sample], pa.binary())]))

        def cell(batches: Iterator[pa.RecordBatch], pivots=pivots) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    near = _nearness(_vectors(batch.column(1)), pivots)
                    first = near.argmax(axis=1)
                    strength = near.max(axis=1)
                    near[np.arange(len(near)), first] = NONE
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(first.astype(np.int32)), pa.array(near.argmax(axis=1).astype(np.int32)), pa.array(strength), batch.column(0), batch.column(1)],
                        names=["cell", "next", "strength", "node", "code"],
                    )

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            left: pa.Table | None = None
            for batch in batches:
                table = pa.Table.from_batches([batch])
                left = table if left is None else pa.concat_tables([left, table])
                while left.num_rows >= 2 * settings.block:
                    part, left = left.slice(0, settings.block), left.slice(settings.block)
                    yield _best_in_block(part["node"].to_numpy(), _vectors(part["code"]), settings.degree)
            if left is not None and left.num_rows:
                yield _best_in_block(left["node"].to_numpy(), _vectors(left["code"]), settings.degree)

        placed = nodes.mapInArrow(cell, "cell int, next int, strength float, node bigint, code binary")
        order = ["cell", "next", "strength", "node"]
        dealt = stored(placed, "cells").repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
        parts.append(dealt.select("node", "code").mapInArrow(blocks, EDGE))
    return union(parts)


NEIGHBOURS = "node bigint, ids array<bigint>, scores array<float>, fresh array<boolean>"


def _merge_lists(degree: int):
    """Best distinct partners of each node; entries that weren't listed before are fresh."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows in _groups(batches):
            ids, scores, fresh = rows["v"].to_numpy(), rows["s"].to_numpy(), rows["fresh"].to_numpy()
            order = np.lexsort((fresh, ids))  # a listed entry before a fresh one of the same partner
            ids, scores, fresh = ids[order], scores[order], fresh[order]
            first = np.concatenate([[True], ids[1:] != ids[:-1]])
            ids, scores, fresh = ids[first], scores[first], fresh[first]
            best = np.lexsort((ids, -scores))[:degree]
            out.append((rows["u"][0].as_py(), ids[best], scores[best], fresh[best]))
            if len(out) >= 2000:
                yield _lists(out, ["node", "ids", "scores", "fresh"], [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.bool_())])
                out = []
        yield _lists(out, ["node", "ids", "scores", "fresh"], [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.bool_())])

    return run


def _merged(edges: DataFrame, settings: Settings) -> DataFrame:
    dealt = edges.select("u", "v", "s", "fresh").repartition(partitions(edges.sparkSession), "u").sortWithinPartitions("u")
    return stored(dealt.mapInArrow(_merge_lists(settings.degree), NEIGHBOURS), "graph")


def _introduce(settings: Settings):
    """Introductions of one node after another; per node the best partners of many introductions are kept."""

    def kept(found: list[tuple]) -> pa.RecordBatch:
        u, v, s = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))
        order = np.lexsort((v, -s, u))
        u, v, s = u[order], v[order], s[order]
        if len(u):
            same = np.concatenate([[False], (u[1:] == u[:-1]) & (v[1:] == v[:-1])])
            u, v, s = u[~same], v[~same], s[~same]
            starts = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
            rank = np.arange(len(u)) - np.repeat(starts, np.diff(np.append(starts, len(u))))
            good = rank < settings.degree
            u, v, s = u[good], v[good], s[good]
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(s.astype(np.float32))], names=["u", "v", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, count = [], 0
        for rows in _groups(batches):
            ids, worst, fresh = rows["v"].to_numpy(), rows["worst"].to_numpy(), rows["fresh"].to_numpy()
            if len(ids) < 2 or not fresh.any():
                continue
            vectors = _vectors(rows["code"])
            scores = _nearness(vectors, vectors)
            useful = (fresh[:, None] | fresh[None, :]) & (scores > worst[:, None]) & (ids[:, None] != ids[None, :])
            scores = np.where(useful, scores, np.float32(NONE))
            top = min(settings.met, len(ids))
            best = np.argpartition(-scores, top - 1, axis=1)[:, :top]
            value = np.take_along_axis(scores, best, 1)
            good = value > np.float32(NONE)
            if good.any():
                found.append((np.repeat(ids, top)[good.ravel()], ids[best][good], value[good]))
                count += int(good.sum())
            if count > 500_000:
                yield kept(found)
                found, count = [], 0
        yield kept(found)

    return run


def _edges(graph: DataFrame) -> DataFrame:
    listed = graph.select("node", F.explode(F.arrays_zip("ids", "scores", "fresh")).alias("e"))
    return listed.select(F.col("node").alias("u"), F.col("e.ids").alias("v"), F.col("e.scores").alias("s"), F.col("e.fresh").alias("fresh"))


def _sampled_reverse(edges: DataFrame, count: int, turn: int) -> DataFrame:
    """For each node, some of the nodes that list it, fresh ones first."""
    place = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("fresh"), F.xxhash64("u", F.lit(turn))))
    chosen = edges.withColumn("place", place).where(F.col("place") <= count)
    return chosen.select(F.col("v").alias("u"), F.col("u").alias("v"), "s", "fresh")


def build_graph(nodes: DataFrame, settings: Settings) -> DataFrame:
    """Neighbour lists (:data:`NEIGHBOURS`) of ``nodes(node, code)``."""
    graph = _merged(first_neighbours(nodes, settings).withColumn("fresh", F.lit(True)), settings)
    for turn in range(settings.rounds):
        edges = _edges(graph)
        pairs = edges.select("u", "v", "fresh").unionAll(_sampled_reverse(edges, settings.reverse, turn).select("u", "v", "fresh"))
        pairs = pairs.groupBy("u", "v").agg(F.max("fresh").alias("fresh"))
        full = graph.select(F.col("node").alias("v"), F.when(F.size("scores") >= settings.degree, F.array_min("scores")).otherwise(F.lit(NONE)).cast("float").alias("worst"))
        known = nodes.select(F.col("node").alias("v"), "code").join(full, "v")
        met = pairs.join(known, "v").repartition(partitions(nodes.sparkSession), "u").sortWithinPartitions("u")
        found = met.select("u", "v", "fresh", "worst", "code").mapInArrow(_introduce(settings), EDGE)
        old = edges.select("u", "v", "s", F.lit(False).alias("fresh"))
        graph = _merged(old.unionAll(found.withColumn("fresh", F.lit(True))), settings)
        state = graph.agg(F.sum(F.size(F.filter("fresh", lambda x: x))).alias("changed"), F.sum(F.size("ids")).alias("all")).first()
        if not state["all"] or state["changed"] <= settings.settled * state["all"]:
            break
    return graph


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    names, kinds = ["node", "near", "codes"], [pa.int64(), pa.list_(pa.int64()), pa.binary()]
    for rows in _groups(batches):
        out.append((rows["u"][0].as_py(), rows["v"].to_numpy(), b"".join(x.as_py() for x in rows["code"])))
        if len(out) >= 500:
            yield _lists(out, names, kinds)
            out = []
    yield _lists(out, names, kinds)


def search_blocks(graph: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame:
    """``(node, near, codes)``: neighbours in both directions with their vectors, what a hop reads."""
    edges = _edges(graph)
    both = edges.select("u", "v").unionAll(_sampled_reverse(edges, settings.reverse, 0).select("u", "v")).distinct()
    dealt = both.join(nodes.select(F.col("node").alias("v"), "code"), "v").repartition(partitions(nodes.sparkSession), "u").sortWithinPartitions("u")
    return stored(dealt.select("u", "v", "code").mapInArrow(_blocks, "node bigint, near array<bigint>, codes binary"), "near")


STATE = "query bigint, target binary, ids array<bigint>, scores array<float>, done array<boolean>"
_STATE_NAMES = ["query", "target", "ids", "scores", "done"]
_STATE_KINDS = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.bool_())]


def _hop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores of the neighbours of an expanded node that beat the worst of the query's beam."""
    for batch in batches:
        out: list[tuple] = []
        for query, target, worst, near, codes in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
            ids = near.values.to_numpy()
            goal = np.frombuffer(target.as_py(), np.float32)
            cells, scale = _decoded(codes.as_buffer(), len(ids))
            scores = (cells @ goal) * scale[:, 0]
            good = scores > worst
            if good.any():
                out.append((query, None, ids[good], scores[good].astype(np.float32), None))
        yield _lists(out, _STATE_NAMES, _STATE_KINDS)


def _merge_beams(settings: Settings):
    """A query's state and what its hop found; the nodes that were sent out are expanded now."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows in _groups(batches):
            parts = rows.to_pylist()
            state = next((p for p in parts if p["target"] is not None), None)
            if state is None:
                continue
            ids = np.concatenate([np.asarray(p["ids"], np.int64) for p in parts])
            scores = np.concatenate([np.asarray(p["scores"], np.float32) for p in parts])
            done = np.concatenate([_sent(np.asarray(p["done"], bool), settings.step) if p["done"] is not None else np.zeros(len(p["ids"]), bool) for p in parts])
            order = np.lexsort((~done, ids))
            ids, scores, done = ids[order], scores[order], done[order]
            first = np.concatenate([[True], ids[1:] != ids[:-1]])
            ids, scores, done = ids[first], scores[first], done[first]
            best = np.lexsort((ids, -scores))[: settings.beam]
            out.append((state["query"], state["target"], ids[best], scores[best], done[best]))
            if len(out) >= 500:
                yield _lists(out, _STATE_NAMES, _STATE_KINDS)
                out = []
        yield _lists(out, _STATE_NAMES, _STATE_KINDS)

    return run


def _sent(done: np.ndarray, step: int) -> np.ndarray:
    after = done.copy()
    after[np.flatnonzero(~done)[:step]] = True
    return after


def greedy_search(starts: DataFrame, near: DataFrame, nodes: DataFrame, longest: DataFrame, settings: Settings) -> DataFrame:
    """Final beams of ``starts(query, vector, node)``; ``node`` may be NULL or a node to start from. ``longest`` are nodes by norm."""
    spark = starts.sparkSession
    entries = {r["node"]: bytes(r["code"]) for part in (nodes.orderBy(F.xxhash64("node", F.lit("entry"))), longest) for r in part.limit(settings.entries).collect()}
    at = np.array(list(entries), np.int64)
    codes = _vectors(pa.chunked_array([pa.array(list(entries.values()), pa.binary())]))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for query, vector, node in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                goal = np.asarray(vector, np.float64)
                goal = (goal / np.sqrt((goal * goal).sum())).astype(np.float32)
                ids, scores = at, codes @ goal
                if node is not None:  # where the walk starts; its score is set so that it is expanded first
                    ids, scores = np.append(ids[ids != node], node), np.append(scores[ids != node], np.float32(-NONE))
                best = np.lexsort((ids, -scores))
                out.append((query, goal.tobytes(), ids[best], scores[best], np.zeros(len(ids), bool)))
            yield _lists(out, _STATE_NAMES, _STATE_KINDS)

    near = near.repartition(partitions(spark), "node").persist()
    state = stored(starts.select("query", "vector", "node").mapInArrow(begin, STATE), "beams")
    while True:
        open_nodes = F.slice(F.filter(F.arrays_zip("ids", "done"), lambda x: ~x["done"]), 1, settings.step)
        worst = F.when(F.size("scores") >= settings.beam, F.array_min("scores")).otherwise(F.lit(NONE)).cast("float")
        sent = state.select("query", "target", worst.alias("worst"), F.explode(open_nodes.getField("ids")).alias("node"))
        found = sent.join(near, "node").select("query", "target", "worst", "near", "codes").mapInArrow(_hop, STATE)
        dealt = state.unionAll(found).repartition(partitions(spark), "query").sortWithinPartitions("query")
        state = stored(dealt.mapInArrow(_merge_beams(settings), STATE), "beams")
        if state.where(F.exists("done", lambda x: ~x)).isEmpty():
            break
    near.unpersist()
    return state


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, vector)`` of the rows that take part, vectors in double precision."""
    vector = F.col(vector_col).cast("array<double>")
    fine = rows.select(F.col(id_col).cast("bigint").alias("id"), vector.alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")
    infinite = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = fine.where(~F.coalesce(infinite, F.lit(True)) & F.exists("vector", lambda x: x != 0))
    usual = fine.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    fine = fine.where(F.size("vector") == (usual["n"] if usual else 0))
    return stored(fine.groupBy("id").agg(F.min("vector").alias("vector")), "vectors")


def nearest(rows: DataFrame, queries: str, count: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings | None = None) -> DataFrame:
    """``(query_id, rank, id, score)``: the ``count`` nearest found for every row with ``queries`` (a condition on ``id``)."""
    settings = settings or Settings()
    vectors = valid_vectors(rows, id_col, vector_col)
    # a node keeps its first ids only: of equal vectors, no more can be among the nearest
    turn = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    firsts = vectors.withColumn("turn", turn).where(F.col("turn") <= count + 1)
    classes = stored(firsts.groupBy("vector").agg(F.min("id").alias("node"), F.sort_array(F.collect_list("id")).alias("ids")), "nodes")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    # the quantile of the nodes' norms; all are positive
    radius = classes.agg(F.percentile_approx(norm, F.lit(RADIUS), F.lit(10_000)).alias("m")).first()["m"]
    wanted = vectors.where(queries).select(F.col("id").alias("query"), "vector")
    if radius is None:
        found = wanted.select("query", F.lit(None).cast("bigint").alias("node"))
    else:
        nodes = stored(unit_vectors(classes.select("node", "vector"), radius), "codes")
        graph = build_graph(nodes, settings)
        near = search_blocks(graph, nodes, settings)
        starts = wanted.join(classes.select("vector", "node"), "vector", "left").select("query", "vector", "node")
        longest = nodes.join(classes.select("node", norm.alias("norm")).orderBy(F.desc("norm"), "node").limit(settings.entries), "node").select("node", "code")
        beams = greedy_search(starts, near, nodes, longest, settings)
        found = beams.select("query", F.explode("ids").alias("node"))
    scored = found.join(classes.select("node", F.col("vector").alias("other"), "ids"), "node").join(wanted, "query")
    product = F.aggregate(F.zip_with("vector", "other", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    scored = scored.select("query", product.alias("score"), F.explode("ids").alias("id")).where("id <> query")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= count).select(F.col("query").alias("query_id"), "rank", "id", "score")
