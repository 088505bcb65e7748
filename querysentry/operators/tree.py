"""Features of serialised parse trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querysentry import registry
from querysentry.functions import tree as T
from querysentry.functions.text import keyword_count
from querysentry.operators.traces import merge_traces
from querysentry.session import SMALL_GROUP_ROWS, broadcast_if_small, cut_lineage, join_groups, task_count

TREE = "semantic_tree"


def explode_nodes(traces: DataFrame, keys: list[str]) -> DataFrame:
    """One row per well-formed node, with its position in the tree."""
    # The outer form with a filter: the inner one makes Spark parse every tree twice,
    # once for an inferred filter on non-empty lists.
    exploded = traces.select(*keys, F.posexplode_outer(T.nodes(F.col(TREE))).alias("pos", "node"))
    return exploded.filter(F.col("pos").isNotNull()).select(*keys, "pos", "node.*")


def malformed_nodes(traces: DataFrame, keys: list[str]) -> DataFrame:
    """Quarantine table: nodes without exactly six fields."""
    exploded = traces.select(*keys, F.explode_outer(T.malformed(F.col(TREE))).alias("node"))
    return exploded.filter(F.col("node").isNotNull())


def with_node_fields(traces: DataFrame) -> DataFrame:
    """Split every tree once; the feature expressions read the result."""
    split = traces.withColumn("_fields", T.node_fields(F.col(TREE)))
    return split.withColumns({"_tag1": T.tag_text(F.col("_fields"), 3), "_tag2": T.tag_text(F.col("_fields"), 4)})


def _tag_columns(vocabulary: str) -> list[Column]:
    """Tag counts of a table made by ``with_node_fields``."""
    counts = T.tag_counts(F.col("_tag1"), F.col("_tag2"), vocabulary)
    return [column.alias(tag) for tag, column in counts.items()]


def tag_counts(traces: DataFrame, vocabulary: str, keys: list[str]) -> DataFrame:
    """Tag counts per row without a shuffle; absent tags are zero."""
    return with_node_fields(traces).select(*keys, *_tag_columns(vocabulary))


def unknown_tags(traces: DataFrame, vocabulary: str, keys: list[str]) -> DataFrame:
    """Nodes whose tag is not in the vocabulary, blank tags aside."""
    nodes = explode_nodes(traces, keys)
    families = [("action", "tag1"), ("object", "tag2")] if vocabulary == "expert" else [("tag", "tag1")]
    known = registry.vocabulary_tags(vocabulary)
    found = F.array(
        *[
            F.struct(F.lit(family).alias("family"), F.col(column).alias("tag"))
            for family, column in families
        ]
    )
    long = nodes.select(*keys, "pos", F.inline(found)).filter(F.col("tag") != "")
    outside = [
        (F.col("family") == family) & ~F.col("tag").isin([t for f, t in known if f == family])
        for family, _ in families
    ]
    condition = outside[0]
    for other in outside[1:]:
        condition = condition | other
    return long.filter(condition)


def assert_known_tags(traces: DataFrame, vocabulary: str, keys: list[str]) -> None:
    """Strict mode: raise on the first tag outside the vocabulary."""
    row = unknown_tags(traces, vocabulary, keys).first()
    if row is not None:
        raise KeyError(f"Tag {row.tag!r} is not in the {row.family} tags of vocabulary {vocabulary!r}")


def literal_keyword_stats(traces: DataFrame, keys: list[str], words=None, unescape: bool = False) -> DataFrame:
    """Mean, maximum and minimum keyword count over the nodes with a literal."""
    counted = with_node_fields(traces).select(
        *keys, T.literal_keyword_counts(F.col("_fields"), words, unescape).alias("_counts")
    )
    return counted.select(*keys, *[c.alias(n) for n, c in T.keyword_stats(F.col("_counts")).items()])


def symbkinds(traces: DataFrame, keys: list[str]) -> DataFrame:
    """Ordered list of node kinds per row."""
    return with_node_fields(traces).select(*keys, T.symbol_kinds(F.col("_fields")).alias("symbkinds"))


def vectorize_symbkinds(df: DataFrame) -> DataFrame:
    """Sparse counts of the grammar-rule kinds: a map from rule number to count.

    The pairs of a row are found within the row; nothing is shuffled.
    """
    counted = df
    for name, column in T.kind_count_steps(F.col("symbkinds")):
        counted = counted.withColumn(name, column)
    return counted.drop("_ordered", "_first")


def widen_kinds(df: DataFrame, kinds: range | list[int] | None = None) -> DataFrame:
    """Turn the sparse counts into one column per rule number (on request only).

    A row's counts are laid out once, the gaps between its rules filled with zeros, so that
    each column is read by its place and not searched for among the row's rules.
    """
    wanted = list(kinds or range(registry.MIN_RULE_KIND, registry.MAX_RULE_KIND + 1))
    low, high = min(wanted), max(wanted)
    entries = F.filter(F.map_entries("kind_counts"), lambda e: e.key.between(low, high))
    sorted_entries = F.array_sort(F.coalesce(entries, F.array().cast("array<struct<key:int,value:int>>")))

    def zeros(after: Column, before: Column) -> Column:
        return F.array_repeat(F.lit(0), before - after - 1)

    steps = F.transform(
        "_entries",
        lambda e, i: F.concat(
            zeros(F.coalesce(F.get("_entries", i - 1)["key"], F.lit(low - 1)), e.key), F.array(F.coalesce(e.value, F.lit(0)))
        ),
    )
    last = F.coalesce(F.get("_entries", F.size("_entries") - 1)["key"], F.lit(low - 1))
    laid_out = F.flatten(F.concat(steps, F.array(zeros(last, F.lit(high + 1)))))
    columns = [F.coalesce(F.get("_laid_out", F.lit(k - low)), F.lit(0)).alias(f"kind_{k}") for k in wanted]
    return df.withColumn("_entries", sorted_entries).withColumn("_laid_out", laid_out).select(*df.columns, *columns)


def trace_features(traces: DataFrame, mode: str, words=None, unescape: bool = False) -> DataFrame:
    """The original columns plus tag counts, node kinds and keyword statistics.

    One projection over the table, no shuffle. Rule-id mode also gets the sparse
    rule counts.
    """
    vocabulary = registry.vocabulary_of(mode)
    fields = F.col("_fields")
    parsed = with_node_fields(traces).withColumn("_counts", T.literal_keyword_counts(fields, words, unescape))
    featured = parsed.select(
        *traces.columns,
        *_tag_columns(vocabulary),
        T.symbol_kinds(fields).alias("symbkinds"),
        *[c.alias(n) for n, c in T.keyword_stats(F.col("_counts")).items()],
    )
    return vectorize_symbkinds(featured) if mode == "ruleid" else featured


def statement_features(log: DataFrame, mode: str, key: str = "stmt_id", words=None, order: str = "seq") -> DataFrame:
    """Features per statement straight from the log, without joining tree texts.

    Equal to the features of the merged traces. Where node texts lack the closing ``|``,
    the last node of one invocation and the first of the next run into each other when
    they are joined. The aggregation tells which statements have such ends, so the log is
    read once; only where there are some, those are merged by ``order``.
    """
    summed = cut_lineage(_summed_features(log, mode, key, words))
    seams = summed.filter("_open").select(key)
    known = summed.drop("_open")
    if seams.isEmpty():
        return known
    merged = merge_traces(join_groups(log, broadcast_if_small(seams), [key], "left_semi"), key, order)
    return summed.filter("NOT _open").drop("_open").unionByName(trace_features(merged, mode, words).select(*known.columns))


def _summed_features(log: DataFrame, mode: str, key: str, words) -> DataFrame:
    """Features per statement, by tasks that go with the rows of the log.

    Statements of ordinary size are dealt out whole. Those of more than
    ``SMALL_GROUP_ROWS`` invocations are few; they are combined where they are read
    and need no more than one small row per task.
    """
    log = log.select(key, *registry.SYNTACTIC[:4], TREE)
    sizes = log.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    large = cut_lineage(sizes.filter(F.col("_n") > SMALL_GROUP_ROWS).select(key))
    tasks = task_count(log)
    if large.isEmpty():
        return _sums(log.repartition(tasks, key), mode, key, words)
    few = broadcast_if_small(large)
    rest = join_groups(log, few, [key], "left_anti").repartition(tasks, key)
    return _sums(rest, mode, key, words).unionByName(_sums(join_groups(log, few, [key], "left_semi"), mode, key, words))


def _sums(log: DataFrame, mode: str, key: str, words) -> DataFrame:
    """Features per statement, right where its node texts are closed; ``_open`` where they are not.

    Every feature of a merged tree is a sum, maximum or minimum over its nodes,
    so each invocation is reduced to numbers and one aggregation finishes the statement.
    Invocations of a several-row statement whose tree has not exactly two parts
    add to the counters only.
    """
    vocabulary = registry.vocabulary_of(mode)
    tags = [tag for _, tag in registry.vocabulary_tags(vocabulary)]
    fields = F.col("_fields")
    needed = log.select(
        key, *registry.SYNTACTIC[:4], TREE, F.coalesce(T.has_two_parts(F.col(TREE)), F.lit(False)).alias("_whole"),
        F.coalesce(T.open_ended(F.col(TREE)), F.lit(False)).alias("_open"),
    )
    per_row = (
        with_node_fields(needed)
        .withColumn("_counts", T.literal_keyword_counts(fields, words))
        .select(
            key,
            *registry.SYNTACTIC[:4],
            "_whole",
            "_open",
            *_tag_columns(vocabulary),
            F.aggregate("_counts", F.lit(0), lambda acc, c: acc + c).alias("_kw_sum"),
            F.size("_counts").alias("_kw_n"),
            F.array_max("_counts").alias("_kw_max"),
            F.array_min("_counts").alias("_kw_min"),
        )
    )
    whole = F.col("_whole")
    aggregates = [
        F.coalesce(F.sum("n_terminal"), F.lit(0)).alias("n_terminal"),
        F.coalesce(F.sum("n_nonterminal"), F.lit(0)).alias("n_nonterminal"),
        F.max(F.when(F.col("is_syntax_error") == 1, 1).otherwise(0)).alias("is_syntax_error"),
        F.coalesce(F.sum("depth"), F.lit(0)).alias("depth"),
        F.count(F.lit(1)).alias("n_parser_invoc"),
        F.max("_open").alias("_open"),
    ]
    sums = [*tags, "_kw_sum", "_kw_n"]
    for suffix, gate in (("u", whole), ("a", F.lit(True))):
        aggregates += [F.sum(F.when(gate, F.col(c))).alias(f"{c}|{suffix}") for c in sums]
        aggregates += [
            F.max(F.when(gate, F.col("_kw_max"))).alias(f"_kw_max|{suffix}"),
            F.min(F.when(gate, F.col("_kw_min"))).alias(f"_kw_min|{suffix}"),
        ]
    merged = per_row.groupBy(key).agg(*aggregates)

    def pick(name: str):
        """A single invocation counts whatever its parts; merged ones only if whole."""
        chosen = F.when(F.col("n_parser_invoc") == 1, F.col(f"`{name}|a`")).otherwise(F.col(f"`{name}|u`"))
        return F.coalesce(chosen, F.lit(0))

    return merged.select(
        key,
        *registry.SYNTACTIC,
        *[pick(t).alias(t) for t in tags],
        F.coalesce(F.try_divide(pick("_kw_sum").cast("double"), pick("_kw_n")), F.lit(0.0)).alias("avg_c_sqlkywds"),
        pick("_kw_max").alias("max_c_sqlkywds"),
        pick("_kw_min").alias("min_c_sqlkywds"),
        # A lone invocation is joined to nothing.
        (F.col("_open") & (F.col("n_parser_invoc") > 1)).alias("_open"),
    )


def statement_kind_counts(log: DataFrame, key: str = "stmt_id") -> DataFrame:
    """Long form of the rule counts of statements: ``(key, kind, n)``, non-zero only.

    Grouped by statement and kind with map-side combining; a large statement is
    spread over up to 1,013 groups.
    """
    kinds = log.select(key, F.explode_outer(T.symbol_kinds(T.node_fields(F.col(TREE)))).alias("kind"))
    return (
        kinds.filter(F.col("kind").between(registry.MIN_RULE_KIND, registry.MAX_RULE_KIND))
        .groupBy(key, "kind").agg(F.count(F.lit(1)).alias("n"))
    )


def explode_edges(traces: DataFrame, keys: list[str]) -> DataFrame:
    """One row per edge: parent, child and position."""
    exploded = traces.select(*keys, F.explode_outer(T.edges(F.col(TREE))).alias("edge"))
    return exploded.filter(F.col("edge").isNotNull()).select(*keys, "edge.*")


def children(traces: DataFrame, keys: list[str]) -> DataFrame:
    """Adjacency lists: the ordered children of every parent.

    ``keys`` must identify the tree, so that a list never exceeds one row's tree.
    """
    pairs = explode_edges(traces, keys).groupBy(*keys, "parent").agg(
        F.array_sort(F.collect_list(F.struct("pos", "child"))).alias("_pairs")
    )
    return pairs.select(*keys, "parent", F.transform("_pairs", lambda p: p.child).alias("children"))


IN_ROW_TREE = 65_536


def named_edges(traces: DataFrame, kinds: DataFrame, keys: list[str]) -> DataFrame:
    """Edges with the symbol names of both ends.

    Where a tree repeats an order number the last node counts. Edges with an end that
    no node bears are left out here and listed by ``dangling_edges``. Both ends are
    looked up inside the row for trees of up to ``IN_ROW_TREE`` characters, which shuffles
    nothing. Larger trees are exploded and joined, so one of any size spreads over many tasks.
    The symbol table is broadcast once its size has been checked; a larger one is dealt out
    and looked up by hash, so that the many edges are not sorted (and spilled) for it.
    """
    edges = _edge_kinds(traces, keys).filter("parent_found and child_found")
    names = kinds.select("kind", "name")
    sent = broadcast_if_small(names)
    names = names.hint("shuffle_hash") if sent is names else sent
    for end in ("parent", "child"):
        named = names.select(F.col("kind").alias(f"{end}_kind"), F.col("name").alias(f"{end}_name"))
        edges = edges.join(named, f"{end}_kind", "left")
    return edges.select(*keys, "pos", "parent", "child", "parent_name", "child_name")


def dangling_edges(traces: DataFrame, keys: list[str]) -> DataFrame:
    """Edges with an end that no node of their tree bears, and which ends are found."""
    edges = _edge_kinds(traces, keys).filter("not (parent_found and child_found)")
    return edges.select(*keys, "pos", "parent", "child", "parent_found", "child_found")


def _edge_kinds(traces: DataFrame, keys: list[str]) -> DataFrame:
    size = F.length(TREE)
    small = _edge_kinds_in_row(traces.filter(size <= IN_ROW_TREE), keys)
    large = _edge_kinds_joined(traces.filter(size > IN_ROW_TREE), keys)
    return small.unionByName(large)


def _edge_kinds_in_row(traces: DataFrame, keys: list[str]) -> DataFrame:
    """Both ends of every edge, looked up in the row's nodes.

    The nodes are sorted by order number once and the last of each number is kept. Numbers
    of a tree mostly have no gaps, so a node's place follows from its number; it is only
    searched for where the node there bears another one.
    """
    node = F.transform(
        "_fields", lambda f, pos: F.struct(f[0].try_cast("long").alias("order"), pos.alias("pos"), f[1].try_cast("int").alias("kind"))
    )
    numbered = F.array_sort(F.filter(node, lambda n: n.order.isNotNull()))
    parsed = with_node_fields(traces).withColumn("_numbered", numbered)
    last = F.filter("_numbered", lambda n, i: F.coalesce(F.get("_numbered", i + 1)["order"] != n.order, F.lit(True)))
    parsed = parsed.withColumn("_nodes", last).withColumns(
        {
            "_orders": F.transform("_nodes", lambda n: n.order),
            "_kinds": F.transform("_nodes", lambda n: n.kind),
            "_edges": T.edges(F.col(TREE)),
        }
    )

    def place(order: Column) -> Column:
        guess = order - F.get("_orders", F.lit(0))
        near = F.when((guess >= 0) & (guess < F.size("_orders")), guess).cast("int")
        searched = F.nullif(F.array_position("_orders", order), F.lit(0)) - 1
        # Where all numbers are there, a guess outside them finds nothing by searching either.
        whole = F.get("_orders", F.size("_orders") - 1) - F.get("_orders", F.lit(0)) == F.size("_orders") - 1
        return F.when(F.get("_orders", near) == order, near).when(~whole, searched.cast("int"))

    found = F.transform(
        "_edges",
        lambda e: F.struct(
            e.pos.alias("pos"), e.parent.alias("parent"), e.child.alias("child"),
            place(e.parent).alias("p"), place(e.child).alias("c"),
        ),
    )
    ends = F.transform(
        found,
        lambda e: F.struct(
            e.pos.alias("pos"), e.parent.alias("parent"), e.child.alias("child"),
            F.get("_kinds", e.p).alias("parent_kind"), F.get("_kinds", e.c).alias("child_kind"),
            e.p.isNotNull().alias("parent_found"), e.c.isNotNull().alias("child_found"),
        ),
    )
    return parsed.select(*keys, F.inline_outer(ends)).filter(F.col("pos").isNotNull())


def _edge_kinds_joined(traces: DataFrame, keys: list[str]) -> DataFrame:
    # What a node is depends on its tree's text alone, so the text's digest names the tree:
    # null or repeated keys don't mix trees up.
    named = traces.withColumn("_tree", F.md5(TREE))
    nodes = (
        explode_nodes(named, ["_tree"])
        .groupBy("_tree", F.col("order").try_cast("long").alias("order"))
        .agg(F.max_by(F.col("kind").try_cast("int"), "pos").alias("kind"))
    )
    edges = explode_edges(named, [*keys, "_tree"])
    for end in ("parent", "child"):
        side = nodes.select("_tree", F.col("order").alias(end), F.col("kind").alias(f"{end}_kind"), F.lit(True).alias(f"{end}_found"))
        edges = edges.join(side, ["_tree", end], "left").withColumn(f"{end}_found", F.coalesce(f"{end}_found", F.lit(False)))
    return edges.select(*keys, "pos", "parent", "child", "parent_kind", "child_kind", "parent_found", "child_found")


def untagged_rules(rules: DataFrame, tags: DataFrame) -> DataFrame:
    """Grammar rules no tag list mentions, in their original order."""
    missing = rules.join(tags.select(F.col("rulename").alias("rule")), "rule", "left_anti")
    return missing.select("line_no", "rule").orderBy("line_no")


def semantic_projection(features: DataFrame, vocabulary: str, keys: list[str]) -> DataFrame:
    """Only the tag columns, to compare variants of a statement."""
    return features.select(*keys, *[tag for _, tag in registry.vocabulary_tags(vocabulary)])


def keyword_counts(df: DataFrame, text: str = "full_query", words=None) -> DataFrame:
    """Add the number of lexicon entries in a text column."""
    return df.withColumn("c_sqlkywds", keyword_count(F.col(text), words))
