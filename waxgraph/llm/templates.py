"""Line dedup by a log-template tree of fixed depth, in DataFrame operations alone.

A line becomes its shape: the tokens, with ``<*>`` for those that hold a digit. The tree
has three levels: token count, leading tokens, template. A template keeps a token where
more than half of its distinct shapes have it, and ``<*>`` elsewhere; shapes that match it
in a large enough part belong to it. A leaf first has one template of all its shapes. Those
that do not belong go by the most frequent of their tokens that less than half of the leaf
have, and each such group has a template again; what is then left are templates of their
own. A template that occurs in many documents is boilerplate: its lines go, except in the
first document that has it. Short lines have no variable fields: they go by their exact
tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waxgraph.llm.common import Scratch, prepare

# Leading tokens in the tree; part of a line that must equal its leaf's template.
DEPTH = 3
SIMILARITY = 0.5
# Documents from which a template is boilerplate; lines of fewer tokens are judged as they are.
LEAST_DOCS = 10
LEAST_TOKENS = 4
VARIABLE = "<*>"
NO_ID = (1 << 63) - 1


def shape_of(line: Column, exact_below: int = 0) -> Column:
    """Tokens of a line with one blank between them, variable fields generalised.

    Lines of fewer tokens than ``exact_below`` stay as they are.

    Tabs and returns part tokens like blanks. Strings, not arrays: the functions used here
    are all compiled, and the costly ones run only on lines that need them.
    """
    blanks = F.translate(line, "\t\r", "  ")
    single = F.trim(F.when(F.contains(blanks, F.lit("  ")), F.regexp_replace(blanks, " +", " ")).otherwise(blanks))
    general = single.rlike("[0-9]")
    if exact_below:
        general &= _count(single, " ") + 1 >= exact_below
    return F.when(general, F.regexp_replace(single, "[^ ]*[0-9][^ ]*", VARIABLE)).otherwise(single)


def _count(text: Column, mark: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(mark), F.lit("")))


def _shapes(rows: DataFrame, depth: int, exact_below: int = 0) -> DataFrame:
    """``id, print, line_no, size, leaf, shape, text`` of every line; ``text`` is the shape itself.

    ``print`` is a hash of the whole text: rows with one id but other texts stay apart.
    """
    lines = rows.select("id", F.xxhash64("text").alias("print"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    shaped = lines.select("id", "print", "line_no", shape_of(F.col("line"), exact_below).alias("text"))
    sized = shaped.withColumn("size", F.when(F.col("text") != "", _count(F.col("text"), " ") + 1).otherwise(0))
    return sized.select(
        "id", "print", "line_no", "size", "text",
        F.xxhash64("size", F.substring_index("text", " ", depth)).alias("leaf"),
        F.xxhash64("size", "text").alias("shape"),
    )


def _members(
    scratch: Scratch, rows: DataFrame, seen: DataFrame, depth: int, similarity: float, least_docs: int, least_tokens: int
) -> DataFrame:
    """``leaf, shape, group`` of the shapes that belong to the template of a group in their leaf.

    Only leaves with several shapes and enough documents can matter, so only their lines
    are looked at again. The leading tokens are equal by construction and count for nothing.
    """
    shapes = seen.groupBy("leaf", "shape").agg(F.count("*").alias("docs"))
    leaves = shapes.groupBy("leaf").agg(F.sum("docs").alias("docs"), F.count("*").alias("shapes"))
    crowded = scratch.keep(leaves.where((F.col("docs") >= least_docs) & (F.col("shapes") > 1)).select("leaf"))
    lines = _shapes(rows, depth, least_tokens).select("leaf", "shape", "size", "text")
    known = lines.join(crowded, "leaf").groupBy("leaf", "shape", "size", "text").agg(F.lit(1).alias("one"))
    # The leaves hold the token count, so short lines are out; a filter on it would be
    # moved below the join and build every shape again.
    known = scratch.keep(known)
    spread = known.where(F.col("size") >= least_tokens).select(
        "leaf", "shape", "size", F.posexplode(F.split("text", " ")).alias("place", "token")
    ).where(F.col("place") >= depth)
    spread = scratch.keep(spread)
    whole = spread.withColumn("group", F.lit(0).cast("long"))
    usual, first = _belonging(scratch, whole, depth, similarity)
    rest = scratch.keep(spread.join(first, ["leaf", "shape"], "left_anti"))
    # What most of the leaf share does not tell its templates apart.
    often = (
        rest.where(F.col("token") != VARIABLE).join(usual, ["leaf", "place", "token"], "left_anti")
        .groupBy("leaf", "place", "token").agg(F.count("*").alias("n")).where("n > 1")
    )
    # Of equally frequent tokens the one farther to the left.
    most = F.max(F.struct("n", (-F.col("place")).alias("left"), "token"))
    grouped = rest.join(often, ["leaf", "place", "token"]).groupBy("leaf", "shape").agg(most.alias("most")).select(
        "leaf", "shape", F.xxhash64("most.left", "most.token").alias("group")
    )
    more, second = _belonging(scratch, scratch.keep(rest.join(grouped, ["leaf", "shape"])), depth, similarity)
    scratch.drop(crowded, known, spread, rest, usual, more)
    return first.union(second)


def _belonging(scratch: Scratch, placed: DataFrame, depth: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Of each group of shapes the tokens that more than half have, and the shapes that match them."""
    sizes = placed.groupBy("leaf", "group").agg(F.count_distinct("shape").alias("shapes"))
    kept = scratch.keep(
        placed.groupBy("leaf", "group", "place", "token").agg(F.count("*").alias("n"))
        .join(sizes, ["leaf", "group"]).where((F.col("n") * 2 > F.col("shapes")) & (F.col("shapes") > 1))
        .select("leaf", "group", "place", "token")
    )
    equal = placed.join(kept, ["leaf", "group", "place", "token"]).groupBy("leaf", "shape", "group", "size").agg(
        F.count("*").alias("equal"), F.count_if(F.col("token") != VARIABLE).alias("constants")
    )
    belongs = (F.col("equal") >= (F.col("size") - depth) * similarity) & (F.col("constants") > 0)
    return kept, scratch.keep(equal.where(belongs).select("leaf", "shape", "group"))


def drop_recurring(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    depth: int = DEPTH,
    similarity: float = SIMILARITY,
    least_docs: int = LEAST_DOCS,
    least_tokens: int = LEAST_TOKENS,
    short_lines: bool = False,
) -> DataFrame:
    """Every row of ``docs``, its text without boilerplate lines, with ``n_lines, n_dropped``.

    Lines end with a line feed. A document whose lines all go keeps an empty text. A null
    text stays null, has no lines and loses none; an empty one has one empty line. Lines
    without a token stay. Rows with the same id are one document, and so are all rows with
    a null id, which come last. All other columns are kept, whatever their names; those
    named like the two counts are replaced. An empty table gives an empty result.

    A shape belongs to a template if ``similarity`` of the positions after the ``depth``
    leading tokens equal it, and one constant among them. Lines of fewer than
    ``least_tokens`` tokens are judged by their exact tokens with ``short_lines``, and
    stay without.
    """
    scratch = Scratch(prepare(docs.sparkSession))
    identity = F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(NO_ID))
    rows = docs.select(identity.alias("id"), F.col(f"`{text_column}`").alias("text")).where("text is not null")
    shaped = scratch.keep(_shapes(rows, depth, least_tokens).drop("text"))
    # Lines are left out after the table: a filter before it would do the work twice.
    lines = shaped.where(F.col("size") >= (1 if short_lines else least_tokens)).drop("size")
    seen = scratch.keep(lines.select("id", "leaf", "shape").distinct())
    members = _members(scratch, rows, seen, depth, similarity, least_docs, least_tokens)
    # A shape outside its group's template is a template by itself.
    templates = scratch.keep(
        seen.groupBy("leaf", "shape").agg(F.lit(1).alias("one")).join(members, ["leaf", "shape"], "left").select(
            "leaf", "shape", F.col("group").isNotNull().alias("general"), F.coalesce("group", "shape").alias("template")
        )
    )
    docs_of = seen.join(templates, ["leaf", "shape"]).select("leaf", "general", "template", "id").distinct()
    recurring = (
        docs_of.groupBy("leaf", "general", "template").agg(F.count("*").alias("docs"), F.min("id").alias("first"))
        .where(F.col("docs") >= least_docs)
    )
    gone = scratch.keep(templates.join(recurring, ["leaf", "general", "template"]).select("leaf", "shape", "first"))
    dropped = scratch.keep(
        lines.join(gone, ["leaf", "shape"]).where("id <> first")
        .groupBy("id", "print").agg(F.collect_set("line_no").alias("dropped"))
    )
    scratch.drop(shaped, seen, templates, gone)

    keyed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col(f"`{text_column}`").alias("text"),
        identity.alias("id"),
        F.xxhash64(f"`{text_column}`").alias("print"),
    )
    numbers = F.coalesce("dropped", F.array().cast("array<int>"))
    stays = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(numbers, i))
    text = F.when(F.size(numbers) == 0, F.col("text")).otherwise(F.array_join(stays, "\n"))
    joined = keyed.join(dropped, ["id", "print"], "left")
    others = [
        (text if c == text_column else F.col(f"row.`{c}`")).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")
    ]
    return joined.select(
        *others,
        F.coalesce(_count(F.col("text"), "\n") + 1, F.lit(0)).cast("long").alias("n_lines"),
        F.size(numbers).cast("long").alias("n_dropped"),
    )
