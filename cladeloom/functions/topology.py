"""Rooted binary topologies as canonical text: keys, shapes, rendering with lengths, generation.

A topology is text such as ``((A,B),C)`` whose children are sorted at every node. The folds below keep a
stack of finished subtrees: a leaf is pushed, a closing parenthesis joins the top two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import newick as nw
from .hashing import md5_int


def _marks(text: Column) -> Column:
    """Leaf labels and closing parentheses in text order."""
    return F.regexp_extract_all(nw.topology_only(text), F.lit(r"[^(),;]+(?=[,);])|\)"), F.lit(0))


def _join_text(x: Column, y: Column) -> Column:
    return F.concat(F.lit("("), F.least(x, y), F.lit(","), F.greatest(x, y), F.lit(")"))


def _fold(marks: Column) -> Column:
    def step(stack: Column, mark: Column) -> Column:
        rest = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 2, F.lit(0)))
        return F.when(
            mark == ")", F.concat(rest, F.array(_join_text(F.element_at(stack, -2), F.element_at(stack, -1))))
        ).otherwise(F.concat(stack, F.array(mark)))

    return F.element_at(F.aggregate(marks, F.array().cast("array<string>"), step), -1)


def topology_key(text: Column) -> Column:
    """Canonical key of a binary statement; ``nw.is_binary`` is the guard for anything else."""
    return _fold(_marks(text))


def topology_shape(text: Column) -> Column:
    """Canonical key with every leaf written ``x``."""
    return _fold(F.transform(_marks(text), lambda m: F.when(m == ")", m).otherwise(F.lit("x"))))


def decimal_text(value: Column) -> Column:
    """Ten significant digits without trailing zeros."""
    exact = F.format_string("%.9e", value).cast("decimal(38,18)").cast("string")
    return F.regexp_replace(F.regexp_replace(exact, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def render(
    df: DataFrame,
    topology: str,
    internal_length: Column,
    pendant: Column,
    name: str,
    donor: Column | None = None,
    recipient: Column | None = None,
    gamma: Column | None = None,
    height: Column | None = None,
) -> DataFrame:
    """Add ``name``: the ultrametric tree of a topology, or its one-reticulation network.

    All internal edges have the same length; the root lies at pendant + deepest internal depth x length.
    With a positive ``gamma`` a minor edge leads from donor to recipient at ``height``: both pendant edges
    are cut there, and at each node the child holding the recipient comes first, then the donor's.
    """
    with_net = donor is not None
    parsed = nw.with_tree(df, F.concat(F.col(topology), F.lit(";")), "__t")
    depths = F.col("__t")["leaf_depths"]
    root_height = pendant + (F.array_max(depths) - 1) * internal_length
    net = (gamma > 0) if with_net else F.lit(False)

    def leaf(label: Column, depth: Column) -> Column:
        length = root_height - (depth - 1) * internal_length
        plain = F.concat(label, F.lit(":"), decimal_text(length))
        if not with_net:
            return plain
        rest = decimal_text(length - height)
        at = decimal_text(height)
        return (
            F.when(~net, plain)
            .when(
                label == donor,
                F.concat(F.lit("("), label, F.lit(":"), at, F.lit(",#H1:0.0::"), decimal_text(gamma), F.lit("):"), rest),
            )
            .when(label == recipient, F.concat(F.lit("("), label, F.lit(":"), at, F.lit(")#H1:"), rest))
            .otherwise(plain)
        )

    def priority(label: Column) -> Column:
        if not with_net:
            return F.lit(2)
        return F.when(net & (label == recipient), 0).when(net & (label == donor), 1).otherwise(2)

    leaves = F.arrays_zip(F.col("__t")["taxa"].alias("taxa"), depths.alias("depths"))
    drawn = F.transform(
        leaves,
        lambda x: F.struct(
            leaf(x["taxa"], x["depths"]).alias("text"), priority(x["taxa"]).alias("rank"),
            (root_height - (x["depths"] - 1) * internal_length).alias("edge"),
        ),
    )
    # one entry per leaf and per closing parenthesis: leaves by number, closings as 0
    order = F.transform(
        F.sequence(F.lit(1), F.size("__marks")),
        lambda i: F.when(F.element_at("__marks", i) == ")", F.lit(0)).otherwise(
            F.size(F.filter(F.slice("__marks", F.lit(1), i), lambda m: m != ")"))
        ),
    )
    edge = F.concat(F.lit("):"), decimal_text(internal_length))

    def step(stack: Column, mark: Column) -> Column:
        x, y = F.element_at(stack, -2), F.element_at(stack, -1)
        swap = y["rank"] < x["rank"]
        first, second = F.when(swap, y["text"]).otherwise(x["text"]), F.when(swap, x["text"]).otherwise(y["text"])
        joined = F.struct(
            F.concat(F.lit("("), first, F.lit(","), second, edge).alias("text"), F.least(x["rank"], y["rank"]).alias("rank")
        )
        rest = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 2, F.lit(0)))
        picked = F.element_at("__drawn", mark)
        pushed = F.struct(picked["text"].alias("text"), picked["rank"].alias("rank"))
        return F.when(mark == 0, F.concat(rest, F.array(joined))).otherwise(F.concat(stack, F.array(pushed)))

    stack = F.aggregate("__order", F.array().cast("array<struct<text:string,rank:int>>"), step)
    text = F.element_at(stack, -1)["text"]
    # the root carries no edge
    whole = F.concat(F.substr(text, F.lit(1), F.length(text) - F.length(edge) + 1), F.lit(";"))
    if with_net:
        problem = (
            F.when(gamma > 0.5, F.lit("gamma above one half"))
            .when((donor == recipient) | donor.isNull() | recipient.isNull(), F.lit("gene flow takes two different tips"))
            .when(~F.array_contains(F.col("__t")["taxa"], donor) | ~F.array_contains(F.col("__t")["taxa"], recipient), F.lit("gene flow from or to a taxon that the tree lacks"))
            .when((height <= 0) | F.exists("__drawn", lambda x: x["edge"] <= height), F.lit("the gene flow height leaves a pendant edge"))
        )
        whole = F.when(net & problem.isNotNull(), F.raise_error(problem)).otherwise(whole)
    return (
        parsed.withColumn("__marks", _marks(F.concat(F.col(topology), F.lit(";"))))
        .withColumn("__order", order).withColumn("__drawn", drawn)
        .withColumn(name, whole).drop("__t", "__t_error", "__marks", "__order", "__drawn")
    )


def random_topology(taxa: Column, seed: Column) -> Column:
    """Join two subtrees drawn by hash until one is left."""

    def step(forest: Column, turn: Column) -> Column:
        m = F.size(forest)
        i = (md5_int(seed.cast("string"), "first", turn.cast("string")) % m).cast("int")
        skip = (md5_int(seed.cast("string"), "second", turn.cast("string")) % (m - 1)).cast("int") + 1
        j = (i + skip) % m
        kept = F.filter(forest, lambda x, k: (k != i) & (k != j))
        return F.concat(kept, F.array(_join_text(F.get(forest, i), F.get(forest, j))))

    return F.element_at(F.aggregate(F.sequence(F.lit(1), F.size(taxa) - 1), taxa, step), 1)


def enumerate_topologies(spark: SparkSession, taxa: list[str]) -> DataFrame:
    """Every rooted binary topology of the taxa, one canonical ``topology`` per row.

    Each taxon in turn is attached above every subtree of every topology of the taxa before it, which
    reaches each topology exactly once: (2n - 3)!! rows.
    """
    if len(taxa) > 8:
        raise ValueError("more than eight taxa have too many topologies to list")
    taxa = sorted(taxa)
    df = spark.createDataFrame([(taxa[0],)], "topology string")
    for taxon in taxa[1:]:
        tokens = F.regexp_extract_all("topology", F.lit(r"[(),]|[^(),]+"), F.lit(0))
        depth = lambda upto: F.aggregate(
            F.slice("__k", F.lit(1), upto), F.lit(0),
            lambda d, t: d + F.when(t == "(", 1).when(t == ")", -1).otherwise(0),
        )
        starts = F.filter(F.sequence(F.lit(1), F.size("__k")), lambda i: ~F.element_at("__k", i).isin(")", ","))
        df = (
            df.withColumn("__k", tokens)
            .withColumn("__d", F.transform(F.sequence(F.lit(1), F.size("__k")), depth))
            .select("__k", "__d", F.explode(starts).alias("__i"))
        )
        # a leaf ends where it starts; a parenthesis ends at the first later return to the depth before it
        end = F.when(F.element_at("__k", F.col("__i")) != "(", F.col("__i")).otherwise(
            F.col("__i") - 1 + F.array_position(
                F.transform(F.slice("__d", F.col("__i"), F.size("__d")), lambda d: d == F.element_at("__d", F.col("__i")) - 1), True
            ).cast("int")
        )
        cut = lambda a, b: F.array_join(F.slice("__k", a, b), "")
        df = df.withColumn("__e", end).select(
            topology_key(
                F.concat(
                    cut(F.lit(1), F.col("__i") - 1), F.lit("("), cut(F.col("__i"), F.col("__e") - F.col("__i") + 1),
                    F.lit(f",{taxon})"), cut(F.col("__e") + 1, F.size("__k")), F.lit(";"),
                )
            ).alias("topology")
        )
    return df
