"""Column expressions over serialised parse trees.

A tree is ``<nodes>||-||<edges>``: nodes end with ``|`` and have six fields
separated by ``:``; edges are blank-separated ``parent>child:child`` segments.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from querysentry import registry
from querysentry.functions.text import keyword_count

_SEPARATOR = r"\|\|-\|\|"


def tree_parts(tree: Column) -> Column:
    return F.split(tree, _SEPARATOR)


def has_two_parts(tree: Column) -> Column:
    return F.size(tree_parts(tree)) == 2


def open_ended(tree: Column) -> Column:
    """A tree of two parts whose last node is not closed by ``|``."""
    ends = tree_parts(tree)[0]
    return has_two_parts(tree) & (ends != "") & ~ends.endswith("|")


def node_strings(tree: Column) -> Column:
    """Texts of the non-blank nodes; a missing tree has none."""
    text = F.substring_index(F.coalesce(tree, F.lit("")), registry.TREE_SEPARATOR, 1)
    return F.filter(F.split(text, r"\|"), lambda n: n != "")


def node_fields(tree: Column) -> Column:
    """Field arrays of the well-formed nodes, in order."""
    return F.filter(
        F.transform(node_strings(tree), lambda n: F.split(n, ":")),
        lambda f: F.size(f) == registry.NODE_FIELDS,
    )


def nodes(tree: Column) -> Column:
    """Well-formed nodes as structs."""
    return F.transform(
        node_fields(tree),
        lambda f: F.struct(
            f[0].alias("order"),
            f[1].alias("kind"),
            f[2].alias("id"),
            f[3].alias("tag1"),
            f[4].alias("tag2"),
            f[5].alias("literal"),
        ),
    )


def malformed(tree: Column) -> Column:
    return F.filter(node_strings(tree), lambda n: F.size(F.split(n, ":")) != registry.NODE_FIELDS)


def field(fields: Column, index: int) -> Column:
    """One field of every node, as an array."""
    return F.transform(fields, lambda f: f[index])


def tag_text(fields: Column, index: int) -> Column:
    """One field of every node as ``:tag|:tag|``. Tags hold neither sign, so each
    tag is found by a plain text search, which keeps the generated code small."""
    joined = F.concat(F.lit(":"), F.array_join(field(fields, index), "|:"), F.lit("|"))
    return F.when(F.size(fields) == 0, F.lit("")).otherwise(joined)


def _occurrences(text: Column, tag: str) -> Column:
    lost = F.length(text) - F.length(F.replace(text, F.lit(f":{tag}|"), F.lit("")))
    return (lost / (len(tag) + 2)).cast("int")


def tag_counts(tag1: Column, tag2: Column, vocabulary: str) -> dict[str, Column]:
    """How often each tag of a vocabulary occurs in the two tag texts of the nodes.
    Blank tags only count as the two blank markers of the expert vocabulary."""
    counts = {}
    for family, tag in registry.vocabulary_tags(vocabulary):
        values = tag2 if family == "object" else tag1
        blank = tag in (registry.ACTION_BLANK, registry.OBJECT_BLANK) and vocabulary == "expert"
        # A node may also spell out the blank marker itself.
        counts[tag] = _occurrences(values, "") + _occurrences(values, tag) if blank else _occurrences(values, tag)
    return counts


def literal_keyword_counts(fields: Column, words=None, unescape: bool = False) -> Column:
    """Keyword counts of the nodes that carry a literal."""

    def literal(f: Column) -> Column:
        if not unescape:
            return f[5]
        return F.replace(F.replace(f[5], F.lit("G_SEMICOLON"), F.lit(":")), F.lit("G_PIPE"), F.lit("|"))

    return F.transform(
        F.filter(fields, lambda f: f[5] != ""), lambda f: keyword_count(literal(f), words)
    )


def keyword_stats(counts: Column) -> dict[str, Column]:
    """Mean, maximum and minimum of an array of counts; zero for an empty one."""
    total = F.aggregate(counts, F.lit(0), lambda acc, c: acc + c)
    return {
        "avg_c_sqlkywds": F.coalesce(F.try_divide(total.cast("double"), F.size(counts)), F.lit(0.0)),
        "max_c_sqlkywds": F.coalesce(F.array_max(counts), F.lit(0)),
        "min_c_sqlkywds": F.coalesce(F.array_min(counts), F.lit(0)),
    }


def symbol_kinds(fields: Column) -> Column:
    return F.transform(fields, lambda f: f[1].try_cast("int"))


# The counts of sorted kinds are the distances between the first places of the distinct
# ones. Three columns, so that each is evaluated once per row (and one lambda deep:
# Spark cannot hand nested ones to a Python model).
def kind_count_steps(kinds: Column) -> list[tuple[str, Column]]:
    """Columns to add in order; the last is a map from rule number to its count,
    for the grammar-rule range only."""
    ruled = F.filter(
        F.coalesce(kinds, F.array().cast("array<int>")),
        lambda k: k.between(registry.MIN_RULE_KIND, registry.MAX_RULE_KIND),
    )
    distinct = F.array_distinct("_ordered")
    n = F.size("_first")
    ends = F.concat(F.slice("_first", 2, n), F.array((F.size("_ordered") + 1).cast("long")))
    counts = F.zip_with("_first", F.slice(ends, 1, n), lambda a, b: (b - a).cast("int"))
    return [
        ("_ordered", F.array_sort(ruled)),
        ("_first", F.transform(distinct, lambda k: F.array_position("_ordered", k))),
        ("kind_counts", F.map_from_arrays(distinct, counts)),
    ]


def edge_segments(tree: Column) -> Column:
    """Non-blank ``parent>children`` segments after the first separator."""
    text = F.coalesce(F.get(tree_parts(tree), F.lit(1)), F.lit(""))
    return F.filter(F.split(text, r"\s+"), lambda s: s != "")


def edges(tree: Column) -> Column:
    """One struct per edge: parent, child and its place in the segment order."""
    pairs = F.flatten(
        F.transform(
            edge_segments(tree),
            lambda s: F.transform(
                F.filter(F.split(F.get(F.split(s, ">"), F.lit(1)), ":"), lambda c: c != ""),
                lambda c: F.struct(
                    F.get(F.split(s, ">"), F.lit(0)).try_cast("long").alias("parent"),
                    c.try_cast("long").alias("child"),
                ),
            ),
        )
    )
    return F.transform(
        pairs, lambda p, i: F.struct(p.parent.alias("parent"), p.child.alias("child"), i.alias("pos"))
    )
