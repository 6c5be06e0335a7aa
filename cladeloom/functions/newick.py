"""Newick text as columns, without leaving the JVM.

A rooted tree is held as its leaves in text order plus one *join* per neighbouring pair of leaves: the
depth and root distance of the node in which the comma between them sits. The comma between leaf i and
leaf i+1 is inside their most recent common ancestor, so

* the MRCA of leaves i < j is the shallowest join in i..j-1 (``array_min`` of a ``slice``);
* the node of join i covers the leaves up to the nearest shallower joins on both sides;
* all commas of one node have equal depth and no shallower join between them.

Everything below is a per-row projection: no shuffle, no Python worker.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The punctuation a quoted label may hide, and the private-use characters standing in for it.
PUNCTUATION = "(),:;[] "
STAND_INS = "".join(chr(0xE000 + i) for i in range(len(PUNCTUATION)))

_QUOTED = r"^[(,)]?\s*(?:'[^']*'|\"[^\"]*\")$"
_CHUNKS = r"(?:^|[(,)])\s*(?:'[^']*'|\"[^\"]*\")|[^(,)]+|[(,)]"
_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def hide_quoted(text: Column) -> Column:
    """Replace punctuation inside quoted labels so later splitting cannot see it, and drop the quotes."""
    chunks = F.regexp_extract_all(text, F.lit(_CHUNKS), F.lit(0))

    def restore(chunk: Column) -> Column:
        lead = F.regexp_extract(chunk, r"^([(,)]?)", 1)
        body = F.regexp_extract(chunk, r"['\"](.*)['\"]$", 1)
        return F.when(
            chunk.rlike(_QUOTED), F.concat(lead, F.translate(body, PUNCTUATION, STAND_INS))
        ).otherwise(chunk)

    hidden = F.array_join(F.transform(chunks, restore), "")
    return F.when(has_quote(text), hidden).otherwise(text)


def has_quote(text: Column) -> Column:
    return text.contains("'") | text.contains('"')


def show_quoted(label: Column) -> Column:
    return F.translate(label, STAND_INS, PUNCTUATION)


def statement_body(text: Column) -> Column:
    """Trimmed statement without the closing semicolon."""
    return F.regexp_replace(F.trim(hide_quoted(F.trim(text))), r"\s*;$", "")


def strip_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"\[[^\[\]]*\]", "")


def topology_only(text: Column) -> Column:
    """The statement with branch lengths and white space around punctuation removed."""
    bare = F.regexp_replace(statement_body(text), r":[^,();]*", "")
    return show_quoted(F.concat(F.regexp_replace(bare, r"\s*([(),])\s*", "$1"), F.lit(";")))


def normalize_statement(text: Column) -> Column:
    """First statement of arbitrary text, comments and lengths removed."""
    return topology_only(strip_comments(first_statement(text)))


def first_statement(text: Column) -> Column:
    """First complete statement: from the first ``(`` to the first ``;`` outside quotes and brackets.

    NULL when the text holds no such statement. Tokens are quoted runs, single brackets and semicolons,
    and everything in between; a fold over them keeps the bracket depth and the length consumed.
    """
    tail = F.substr(text, F.locate("(", text))
    tokens = F.regexp_extract_all(
        tail, F.lit(r"'[^']*(?:'|$)|\"[^\"]*(?:\"|$)|[\[\];]|[^'\"\[\];]+"), F.lit(0)
    )
    start = F.struct(F.lit(0).alias("brackets"), F.lit(0).alias("size"), F.lit(False).alias("done"))

    def step(state: Column, token: Column) -> Column:
        ends = (token == ";") & (state["brackets"] == 0)
        brackets = (
            F.when(token == "[", state["brackets"] + 1)
            .when((token == "]") & (state["brackets"] > 0), state["brackets"] - 1)
            .otherwise(state["brackets"])
        )
        return F.when(state["done"], state).otherwise(
            F.struct(
                brackets.alias("brackets"),
                (state["size"] + F.length(token)).alias("size"),
                ends.alias("done"),
            )
        )

    scan = F.aggregate(tokens, start, step)
    return F.when(F.locate("(", text) > 0, F.when(scan["done"], F.substr(tail, F.lit(1), scan["size"])))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once per row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Fixed value: what may not stand next to what inside a statement; parentheses are balanced separately.
_MISPLACED = (
    r";|[^\s(,]\s*\(|(?:^|[(,])\s*(?:[,):]|$)"
    r"|:(?!\s*[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?\s*(?:[,)]|$))"
)


def _detail(body: Column) -> Column:
    """Which rule of ``_MISPLACED`` a body breaks."""
    lengths = F.regexp_extract_all(body, F.lit(r":([^,();]*)"), F.lit(1))
    return (
        F.when(body.rlike(r"[(,)]\s*(?:'[^']*|\"[^\"]*)$"), F.lit("a quoted label has no end"))
        .when(body.contains(";"), F.lit("text follows the statement"))
        .when(body.rlike(r"[^\s(,]\s*\("), F.lit("a comma or a closing parenthesis is missing"))
        .when(F.exists(lengths, lambda x: F.trim(x) == ""), F.lit("a colon without a branch length"))
        .when(F.exists(lengths, lambda x: ~x.rlike(_NUMBER)), F.lit("a branch length is not a number"))
        .otherwise(F.lit("a leaf has no label"))
    )


AFTER_QUOTE = "text follows a quoted label"
UNBALANCED = "parentheses do not match"
#: Everything :func:`newick_error` can say.
PROBLEMS = [
    "a quoted label has no end", "text follows the statement", "a comma or a closing parenthesis is missing", "a colon without a branch length",
    "a branch length is not a number", "a leaf has no label", AFTER_QUOTE, UNBALANCED,
]
_QUOTE_LEFT = r"[(,)]\s*(?:'[^']*|\"[^\"]*)$"


#: A closing quote followed by more text; a quote can't be doubled inside a label.
_AFTER_QUOTE = r"(?:^|[(,])\s*(?:'[^']*'|\"[^\"]*\")\s*[^\s:,()\[;]"


def newick_error(text: Column) -> Column:
    """NULL for a readable statement, else what is wrong with it. ``with_tree`` gives the same answer."""

    def check(body: Column) -> Column:
        walk = F.aggregate(
            F.regexp_extract_all(body, F.lit(r"[(),]"), F.lit(0)),
            F.struct(F.lit(0).alias("depth"), F.lit(False).alias("outside")),
            lambda s, t: F.struct(
                F.when(t == "(", s["depth"] + 1).when(t == ")", s["depth"] - 1).otherwise(s["depth"]).alias("depth"),
                # a comma or a closing at depth 0 lies outside the tree
                (s["outside"] | ((t != "(") & (s["depth"] == 0))).alias("outside"),
            ),
            lambda s: s["outside"] | (s["depth"] != 0),
        )
        return F.when(body.rlike(_MISPLACED) | body.rlike(_QUOTE_LEFT), _detail(body)).when(
            walk, F.lit(UNBALANCED)
        )

    return F.when(text.isNull(), F.lit("a leaf has no label")).when(text.rlike(_AFTER_QUOTE), F.lit(AFTER_QUOTE)).otherwise(let(statement_body(text), check))


def with_tree(df: DataFrame, text: str | Column, name: str = "tree", written: bool = False) -> DataFrame:
    """Add ``name`` and ``name_error`` for a statement.

    ``name`` is a struct: taxa and leaf_depths (text order), joins (depth, dist), opens, missing_lengths. An
    unreadable statement gives NULL and says why in ``name_error``. With ``written`` the struct also keeps what only
    :func:`to_newick` needs: the leaves' own lengths, and label and length of every node that closes after a leaf.
    """
    source = F.col(text) if isinstance(text, str) else text
    body, parts, walk = f"__{name}_body", f"__{name}_parts", f"__{name}_walk"
    # One piece per leaf: the opens before it, its label and length, the closes after it.
    close = F.lit(r"\)[^:(),]*(?::([^(),]*))?")
    described = F.transform(
        F.split(F.col(body), ","),
        lambda p: F.struct(
            (F.length(p) - F.length(F.replace(p, F.lit("("), F.lit("")))).alias("opens"),
            # what stands before the first colon or closing, without opens and blanks
            F.trim(F.ltrim(F.substring_index(F.substring_index(p, ":", 1), ")", 1), F.lit("( \t\n\x0b\f\r"))).alias("label"),
            F.when(
                p.contains(")"), F.transform(F.regexp_extract_all(p, close, F.lit(1)), lambda x: x.try_cast("double"))
            ).otherwise(F.array().cast("array<double>")).alias("closes"),
        ),
    )
    node = lambda c: F.struct(
        show_quoted(F.trim(F.regexp_extract(c, r"^\)([^:(),]*)", 1))).alias("label"), F.regexp_extract(c, r":([^(),]*)", 1).try_cast("double").alias("length")
    )
    text_parts = F.transform(F.split(F.col(body), ","), lambda p: F.struct(
        F.regexp_extract(p, r"^[\s(]*[^:()]*:([^()]*)", 1).try_cast("double").alias("length"),
        F.transform(F.regexp_extract_all(p, F.lit(r"\)[^()]*"), F.lit(0)), node).alias("closes"),
    ))
    start = F.struct(
        F.array().cast("array<double>").alias("path"),
        F.array().cast("array<struct<depth:int,dist:double>>").alias("joins"),
        F.array().cast("array<int>").alias("leaf_depths"),
    )
    # Right to left: a close enters a node, so its root distance goes on the path; an open leaves it again.
    # The first node entered is the root, whose own length does not count.
    enter = lambda path, length: F.concat(
        path,
        F.array(F.coalesce(F.get(path, F.size(path) - 1) + F.coalesce(length, F.lit(0.0)), F.lit(0.0))),
    )

    def step(state: Column, part: Column) -> Column:
        grown = F.when(F.size(part["closes"]) == 0, state["path"]).otherwise(
            F.aggregate(F.reverse(part["closes"]), state["path"], enter)
        )

        def leave(above: Column) -> Column:
            return let(
                F.slice(above, F.lit(1), F.greatest(F.size(above) - part["opens"], F.lit(0))),
                lambda path: F.struct(
                    path.alias("path"),
                    F.concat(
                        F.array(F.struct(F.size(path).alias("depth"), F.coalesce(F.get(path, F.size(path) - 1), F.lit(0.0)).alias("dist"))),
                        state["joins"],
                    ).alias("joins"),
                    F.concat(F.array(F.size(above)), state["leaf_depths"]).alias("leaf_depths"),
                ),
            )

        return let(grown, leave)

    w, p = F.col(walk), F.col(parts)
    b = F.col(body)
    count = lambda mark: F.length(b) - F.length(F.replace(b, F.lit(mark), F.lit("")))
    # the walk emits one entry left of the first leaf: back at depth 0 if the parentheses match
    joins = F.slice(w["joins"], F.lit(2), F.greatest(F.size(p) - 1, F.lit(0)))
    opens = count("(")
    # without a comma below depth 1, equal counts are enough
    shallow = F.array_min(joins)["depth"]
    balanced = (opens == count(")")) & F.when(F.size(p) == 1, F.lit(True)).otherwise(shallow >= 1)
    tree = F.struct(
        F.when(has_quote(source), F.transform(p, lambda x: show_quoted(x["label"]))).otherwise(p["label"]).alias("taxa"),
        w["leaf_depths"].alias("leaf_depths"), joins.alias("joins"), opens.alias("opens"),
        # closes followed by another token before any length; nothing follows the root's
        F.regexp_count(b, F.lit(r"\)[^:(),]*(?=[(),])")).alias("missing_lengths"),
        *([text_parts.alias("parts")] if written else []),
    )
    local = F.when(b.isNull(), F.lit("a leaf has no label")).when(has_quote(source) & source.rlike(_AFTER_QUOTE), F.lit(AFTER_QUOTE)).when(
        b.rlike(_MISPLACED) | (has_quote(b) & b.rlike(_QUOTE_LEFT)), _detail(b)
    )
    return (
        df.withColumn(body, statement_body(source))
        .withColumn(f"{name}_error", local)
        .withColumn(parts, F.when(F.col(f"{name}_error").isNull(), described))
        .withColumn(walk, F.aggregate(F.reverse(p), start, step))
        .withColumn(name, F.when(F.col(f"{name}_error").isNull() & balanced, tree))
        .withColumn(
            f"{name}_error",
            F.coalesce(F.col(f"{name}_error"), F.when(F.col(name).isNull(), F.lit(UNBALANCED))),
        )
        .drop(body, parts, walk)
    )


def number_text(value: Column) -> Column:
    """A double with ten significant digits, without trailing zeros: plain from 1e-4 to below 1e10, else with an exponent.

    The shortest decimal that stands for the double is rounded, half up.
    """

    def shown(parts: Column) -> Column:
        digits, power = F.replace(parts[0], F.lit("."), F.lit("")), parts[1].cast("int")
        bare = lambda text: F.regexp_replace(text, r"\.?0+$", "")
        plain = F.when(power >= 0, F.concat(F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2))).otherwise(
            F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
        )
        # a number without a fraction ends in the point
        plain = F.when(plain.endswith("."), F.regexp_replace(plain, r"\.$", "")).otherwise(bare(plain))
        return F.when((power >= -4) & (power < 10), plain).otherwise(F.concat(bare(parts[0]), F.lit("e"), parts[1]))

    sign = F.when(value < 0, "-").otherwise("")
    return F.when(value == 0, "0").otherwise(F.concat(sign, let(F.split(F.format_string("%.9e", F.abs(value)), "e"), shown)))


def _label_text(label: Column) -> Column:
    """A label, quoted if it holds punctuation or blanks."""
    return F.when(~label.rlike(r"[(),:;\[\]\s'\"]"), label).when(~label.contains("'"), F.concat(F.lit("'"), label, F.lit("'"))).otherwise(F.concat(F.lit('"'), label, F.lit('"')))


def to_newick(tree: Column, include_lengths: bool = True) -> Column:
    """The statement of a tree that :func:`with_tree` parsed with ``written``, node labels and lengths included.

    Leaves are in text order; what opens and closes around a leaf follows from its depth and those of the joins beside it.
    """
    length = lambda x: F.when(x.isNotNull(), F.concat(F.lit(":"), number_text(x))).otherwise("") if include_lengths else F.lit("")
    depth = lambda i: F.coalesce(F.get(tree["joins"], i)["depth"], F.lit(0))

    def leaf(label: Column, i: Column) -> Column:
        part = F.get(tree["parts"], i)
        closes = F.transform(part["closes"], lambda c: F.concat(F.lit(")"), _label_text(c["label"]), length(c["length"])))
        opens = F.get(tree["leaf_depths"], i) - F.when(i > 0, depth(i - 1)).otherwise(0)
        return F.concat(F.repeat(F.lit("("), opens), _label_text(label), length(part["length"]), F.array_join(closes, ""))

    return F.concat(F.array_join(F.transform(tree["taxa"], leaf), ","), F.lit(";"))


def leaf_guard(tree: Column) -> Column:
    """NULL when all leaves are distinct, else the complaint."""
    return F.when(F.size(F.array_distinct(tree["taxa"])) != F.size(tree["taxa"]), F.lit("a label occurs twice in the tree"))


def pair_mrca(tree: Column, first: Column, second: Column) -> Column:
    """Struct (depth, dist) of the MRCA of the leaves at two 1-based positions, for a few pairs of a tree.

    Many pairs of one tree take :func:`with_ranges`.
    """
    low = F.least(first, second)
    return F.array_min(F.slice(tree["joins"], low, F.greatest(first, second) - low))


def with_ranges(df: DataFrame, tree: str = "tree", name: str = "ranges") -> DataFrame:
    """Adds ``name``, with which :func:`range_mrca` finds the MRCA of any two leaves in constant time.

    ``minima[k][i]`` is the shallowest of the 2**k joins from i on, ``steps[m - 1]`` the largest such k and 2**k for a run of m
    joins: any run is covered by two overlapping ones. O(n log n) entries, made once a tree.
    """
    joins, n = F.col(tree)["joins"], F.size(F.col(tree)["joins"])
    steps = F.transform(
        F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")),
        lambda m: let(F.length(F.bin(m)) - 1, lambda k: F.struct(k.alias("level"), F.call_function("shiftleft", F.lit(1), k).alias("width"))),
    )
    highest = F.length(F.bin(n)) - 1

    def grow(levels: Column, k: Column) -> Column:
        half = F.call_function("shiftleft", F.lit(1), k - 1)
        wider = lambda last: F.transform(
            F.slice(last, F.lit(1), F.size(last) - half), lambda low, i: F.least(low, F.get(last, i + half))
        )
        return F.concat(levels, F.array(let(F.element_at(levels, -1), wider)))

    minima = F.aggregate(F.when(highest > 0, F.sequence(F.lit(1), highest)).otherwise(F.array().cast("array<int>")), F.array(joins), grow)
    return df.withColumn(name, F.when(F.col(tree).isNotNull(), F.struct(steps.alias("steps"), minima.alias("minima"))))


def range_mrca(ranges: Column, first: Column, second: Column) -> Column:
    """Struct (depth, dist) of the MRCA of the leaves at two 1-based positions: NULL if one is 0 or NULL, empty if they are equal."""
    low, high = F.least(first, second), F.greatest(first, second)
    step = F.get(ranges["steps"], high - low - 1)
    row = F.get(ranges["minima"], step["level"])
    same = F.struct(F.lit(None).cast("int").alias("depth"), F.lit(None).cast("double").alias("dist"))
    found = F.least(F.get(row, low - 1), F.get(row, high - 1 - step["width"]))
    return F.when(low > 0, F.when(high > low, found).when(high == low, same))


def pair_nodes(df: DataFrame, tree: str, carry: list[str]) -> DataFrame:
    """One row per pair of a tree's taxa in order: carry, first, second, first_depth, second_depth (of the leaves), node (their MRCA).

    Range minima and the pairs' MRCAs are found before the first row is generated; a taxon's row carries its own line of
    them, and no row of a pair carries a tree.
    """
    t, ranges = F.col(tree), F.col("__ranges")
    rows = with_ranges(df.select(*carry, tree), tree, "__ranges")
    leaf = lambda x: let(F.array_position(t["taxa"], x).cast("int"), lambda i: F.struct(x.alias("taxon"), i.alias("at"), F.get(t["leaf_depths"], i - 1).alias("depth")))
    rows = rows.withColumn("__leaves", F.transform(F.array_sort(t["taxa"]), leaf))
    leaves = F.col("__leaves")
    line = lambda x, i: F.struct(
        x.alias("leaf"),
        F.transform(F.slice(leaves, i + 2, F.size(leaves)), lambda y: F.struct(
            y["taxon"].alias("second"), y["depth"].alias("second_depth"), range_mrca(ranges, x["at"], y["at"]).alias("node")
        )).alias("others"),
    )
    # outer generators: from others Catalyst derives filters that repeat the parsing below it
    rows = rows.select(*carry, F.explode_outer(F.transform(leaves, line)).alias("__line"))
    rows = rows.select(*carry, F.col("__line.leaf.taxon").alias("first"), F.col("__line.leaf.depth").alias("first_depth"), F.explode_outer("__line.others").alias("__p"))
    return rows.where(F.col("__p.second") > F.col("first")).select(*carry, "first", "__p.second", "first_depth", "__p.second_depth", "__p.node")


def _spans(tree: Column) -> Column:
    """For each join, how many joins left and right of it in a row are not shallower, in one pass to each side.

    A stack holds the joins that are still waiting for a shallower one, by place and depth.
    """
    depths = F.transform(tree["joins"], lambda j: j["depth"])

    def reach(values: Column) -> Column:
        """Places between each value and the nearest smaller one before it."""
        start = F.struct(
            F.array().cast("array<struct<at:int,depth:int>>").alias("stack"), F.array().cast("array<int>").alias("out"), F.lit(0).alias("at")
        )

        def step(s: Column, depth: Column) -> Column:
            # depths grow along the stack, so those that are not smaller are its end
            lower = F.filter(s["stack"], lambda x: x["depth"] < depth)
            return let(lower, lambda kept: F.struct(
                F.concat(kept, F.array(F.struct(s["at"].alias("at"), depth.alias("depth")))).alias("stack"),
                F.concat(s["out"], F.array(s["at"] - F.coalesce(F.element_at(F.when(F.size(kept) > 0, kept), -1)["at"], F.lit(-1)) - 1)).alias("out"),
                (s["at"] + 1).alias("at"),
            ))

        return F.aggregate(values, start, step, lambda s: s["out"])

    return F.arrays_zip(reach(depths).alias("left"), F.reverse(reach(F.reverse(depths))).alias("right"))


def node_spans(tree: Column) -> Column:
    """Distinct internal nodes with two or more children as (first, last) leaf positions."""
    return F.array_distinct(F.transform(_spans(tree), lambda s, i: F.struct((i - s["left"] + 1).alias("first"), (i + 2 + s["right"]).alias("last"))))


def colless(tree: Column) -> Column:
    """Sum over internal nodes of the difference in leaf count of the two children; for binary trees."""
    return F.aggregate(_spans(tree), F.lit(0), lambda total, s: total + F.abs(s["left"] - s["right"]))


def normalized_colless(tree: Column) -> Column:
    n = F.size(tree["taxa"])
    most = (n - 1) * (n - 2) / 2
    return F.when(most > 0, colless(tree) / most).otherwise(F.lit(0.0))


def path_distance(tree: Column, first: Column, second: Column, ranges: Column | None = None) -> Column:
    """Number of edges between the leaves at two 1-based positions; with ``ranges`` in constant time."""
    depth = lambda i: F.element_at(tree["leaf_depths"], i)
    return edges(depth(first), depth(second), pair_mrca(tree, first, second) if ranges is None else range_mrca(ranges, first, second))


def edges(first_depth: Column, second_depth: Column, node: Column) -> Column:
    """Number of edges between two leaves of these depths whose MRCA is ``node``."""
    return first_depth + second_depth - 2 * (node["depth"] - 1)


def clades(tree: Column, spans: Column | None = None) -> Column:
    """Sorted array of nontrivial clades, each its sorted taxa joined by commas; ``spans`` are the tree's if they are known."""
    n = F.size(tree["taxa"])
    inner = F.filter(node_spans(tree) if spans is None else spans, lambda s: (s["last"] - s["first"] + 1) < n)
    return F.array_sort(
        F.array_distinct(
            F.transform(
                inner,
                lambda s: F.array_join(
                    F.array_sort(F.slice(tree["taxa"], s["first"], s["last"] - s["first"] + 1)), ","
                ),
            )
        )
    )


def is_binary(tree: Column, spans: Column | None = None) -> Column:
    """Every internal node has exactly two children; ``spans`` are the tree's if they are known."""
    wanted = F.size(tree["taxa"]) - 1
    return (F.size(node_spans(tree) if spans is None else spans) == wanted) & (tree["opens"] == wanted)
