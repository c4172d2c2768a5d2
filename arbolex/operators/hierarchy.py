"""Trees stored as rows with arrays: bounded subtrees in pre-order, ancestors, longest prefixes, near codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHILD_CAP, SUBTREE_CAP = 25, 250


def subtree(nodes: DataFrame, roots: DataFrame, depth: int = 1, per_parent: int = CHILD_CAP, cap: int = SUBTREE_CAP) -> DataFrame:
    """notation, depth, total_children, truncated and ord of the first ``cap`` descendants of ``roots`` in pre-order.

    nodes: notation, children. A parent shows its first ``per_parent`` children; one that is missing takes up a place
    and is left out. Levels are joined one after the other, and only as many rows as the caps allow go on."""
    tree = nodes.select("notation", "children")
    level = roots.select("children", F.array().cast("array<int>").alias("ord"))
    out = None
    for d in range(1, depth + 1):
        near = level.select("ord", F.posexplode(F.slice("children", 1, per_parent)).alias("_at", "notation"))
        near = near.select(F.concat("ord", F.array(F.col("_at").cast("int"))).alias("ord"), "notation")
        level = near.join(tree, "notation").orderBy("ord").limit(cap)
        size = F.size("children")
        row = level.select("ord", "notation", F.lit(d).alias("depth"), size.alias("total_children"), ((F.lit(d) < depth) & (size > per_parent)).alias("truncated"))
        out = row if out is None else out.unionByName(row)
    # Arrays order like paths, a prefix first: that is pre-order.
    return out.orderBy("ord").limit(cap)


def ancestors(nodes: DataFrame) -> DataFrame:
    """notation, pos, ancestor: one row for each step of the stored path, which excludes the node itself."""
    return nodes.select("notation", F.posexplode("path").alias("pos", "ancestor"))


def intervals(nodes: DataFrame) -> DataFrame:
    """notation, parent, depth, pre and size of each node: its place in pre-order, from 0, and how many nodes its subtree has,
    itself included. What lies below a node is then a range: pre to pre + size - 1.

    nodes: notation, path and children. A node's parent is the last known one on its path; children come in the parent's
    order, then those that it does not list by code, and roots by code. Stored paths make it a matter of sums: a node
    counts at each of its ancestors, and its place is the sum, over itself and its ancestors, of what stands before them
    among their siblings. The siblings of one parent are ordered in one task."""
    known = nodes.select("notation").distinct()
    steps = nodes.select("notation", F.posexplode(F.array_append(F.filter("path", lambda x: x != F.col("notation")), F.col("notation"))).alias("_at", "step"))
    steps = steps.join(known.withColumnRenamed("notation", "step"), "step", "left_semi")  # placeholders are no nodes
    size = steps.groupBy("step").agg(F.count_distinct("notation").alias("size")).withColumnRenamed("step", "notation")
    line = steps.groupBy("notation").agg(F.array_sort(F.collect_set(F.struct("_at", "step"))).alias("_line"))  # as long as the tree is deep
    own = line.select("notation", (F.size("_line") - 1).alias("depth"), F.get("_line", F.size("_line") - 2)["step"].alias("parent"))
    listed = nodes.select(F.col("notation").alias("parent"), F.posexplode("children").alias("_place", "notation")).groupBy("parent", "notation").agg(F.min("_place").alias("_place"))
    siblings = own.join(size, "notation").join(listed, ["parent", "notation"], "left")
    earlier = Window.partitionBy("parent").orderBy(F.col("_place").asc_nulls_last(), "notation").rowsBetween(Window.unboundedPreceding, -1)
    siblings = siblings.withColumn("_before", F.coalesce(F.sum("size").over(earlier), F.lit(0)) + F.when(F.col("parent").isNull(), 0).otherwise(1))
    place = steps.select("notation", "step").distinct().join(siblings.select(F.col("notation").alias("step"), "_before"), "step").groupBy("notation").agg(F.sum("_before").alias("pre"))
    return siblings.select("notation", "parent", "depth", "size").join(place, "notation").select("notation", "parent", "depth", "pre", "size")


def below(tree: DataFrame, pre: int, size: int) -> DataFrame:
    """The nodes of a subtree, its root first, from a table of ``intervals`` that is stored in order: one pruned read."""
    return tree.where((F.col("pre") >= pre) & (F.col("pre") < pre + size)).orderBy("pre")


def deepest_known(codes: DataFrame, tree: DataFrame) -> DataFrame:
    """code and ancestor: of each code's path (code, path) the last step that is a node, or null; one join of the steps."""
    steps = codes.select("code", F.posexplode("path").alias("_at", "notation"))
    best = steps.join(tree.select("notation"), "notation", "left_semi").groupBy("code").agg(F.max_by("notation", "_at").alias("ancestor"))
    return codes.select("code").join(best, "code", "left")


def longest_prefix(codes: DataFrame, known: DataFrame, code: str = "code") -> DataFrame:
    """code and ancestor: the longest proper prefix of each code that is known, or null. Prefixes are exploded and
    joined by equality; codes are short, so a code gives few rows."""
    distinct = codes.select(F.col(code).alias("code")).distinct()
    cut = distinct.where(F.length("code") > 1).select("code", F.explode(F.sequence(F.lit(1), F.length("code") - 1)).alias("n"))
    cut = cut.select("code", "n", F.expr("substring(code, 1, n)").alias("ancestor"))
    found = cut.join(known.select(F.col("notation").alias("ancestor")).distinct(), "ancestor", "left_semi")
    best = found.groupBy("code").agg(F.max_by("ancestor", "n").alias("ancestor"))
    return distinct.join(best, "code", "left")


def near_codes(codes: DataFrame, code: str = "code") -> DataFrame:
    """Codes one edit away, first seen first: (code, kind, kind_ord, pos, change, candidate).

    Substitutions stay in their class (a digit by digits, anything else by A-Z), then deletions, then insertions of a
    digit before each place and at the end. A candidate that comes up again, or is the code, is dropped."""
    digits = F.array(*(F.lit(c) for c in "0123456789"))
    letters = F.array(*(F.lit(chr(65 + i)) for i in range(26)))
    base = codes.select(F.col(code).alias("code")).distinct()
    places = base.where(F.length("code") > 0).select("code", F.explode(F.sequence(F.lit(1), F.length("code"))).alias("pos"))
    here, left, right = F.expr("substring(code, pos, 1)"), F.expr("substring(code, 1, pos - 1)"), F.expr("substring(code, pos + 1)")
    sub = places.select("code", "pos", here.alias("was"), left.alias("l"), right.alias("r"), F.explode(F.when(here.rlike("[0-9]"), digits).otherwise(letters)).alias("change"))
    sub = sub.where("change != was").select("code", F.lit("sub").alias("kind"), F.lit(0).alias("kind_ord"), "pos", "change", F.concat("l", "change", "r").alias("candidate"))
    dele = places.select("code", F.lit("del").alias("kind"), F.lit(1).alias("kind_ord"), "pos", F.lit("").alias("change"), F.concat(left, right).alias("candidate"))
    ins = base.select("code", F.explode(F.sequence(F.lit(1), F.length("code") + 1)).alias("pos")).select("code", "pos", F.explode(digits).alias("change"))
    ins = ins.select("code", F.lit("ins").alias("kind"), F.lit(2).alias("kind_ord"), "pos", "change", F.concat(F.expr("substring(code, 1, pos - 1)"), "change", F.expr("substring(code, pos)")).alias("candidate"))
    every = sub.unionByName(dele).unionByName(ins).where("candidate != code")
    first = every.groupBy("code", "candidate").agg(F.min(F.struct("kind_ord", "pos", "change", "kind")).alias("x"))
    return first.select("code", F.col("x.kind").alias("kind"), F.col("x.kind_ord").alias("kind_ord"), F.col("x.pos").alias("pos"), F.col("x.change").alias("change"), "candidate")


def _edits(word: str, keys: str = "key") -> Column:
    """A word and what is left of it without each of its code points: length + 1 keys."""
    cut = f"transform(sequence(1, greatest(length({word}), 1)), i -> concat(substring({word}, 1, i - 1), substring({word}, i + 1)))"
    return F.explode(F.array_distinct(F.expr(f"array_append({cut}, {word})"))).alias(keys)


def edit_index(known: DataFrame, code: str = "notation") -> DataFrame:
    """candidate and key: the deletion neighbourhood of known codes; a store may keep it, bucketed by key."""
    rows = known.select(F.col(code).alias("candidate")).where("candidate is not null").distinct()
    return rows.select("candidate", _edits("candidate"))


def near_known(codes: DataFrame, index: DataFrame, code: str = "code") -> DataFrame:
    """Of ``near_codes`` those that are known, with the same columns: (code, kind, kind_ord, pos, change, candidate).

    Two words one edit apart share a key of their deletion neighbourhoods (``edit_index``), so a code joins with length + 1
    keys and not with each of its possible neighbours; which edit it was, if it is an allowed one, is read off the pair."""
    base = codes.select(F.col(code).alias("code")).where("code is not null").distinct().select("code", _edits("code"))
    # The index is larger by far than its files, from which its size would be guessed: it is never broadcast.
    pairs = base.join(index.hint("merge"), "key").where("code != candidate and abs(length(code) - length(candidate)) <= 1").select("code", "candidate").distinct()
    same_but = lambda p, a, b, skip_a, skip_b: f"substring({a}, 1, {p} - 1) = substring({b}, 1, {p} - 1) and substring({a}, {p} + {skip_a}) = substring({b}, {p} + {skip_b})"
    at = lambda size, test: F.expr(f"get(filter(sequence(1, greatest({size}, 1)), p -> {test}), 0)")
    swap = at("length(code)", same_but("p", "code", "candidate", 1, 1) + " and if(substring(code, p, 1) rlike '[0-9]', substring(candidate, p, 1) rlike '[0-9]', substring(candidate, p, 1) rlike '[A-Z]')")
    drop = at("length(code)", same_but("p", "code", "candidate", 1, 0))
    add = at("length(candidate)", same_but("p", "candidate", "code", 1, 0) + " and substring(candidate, p, 1) rlike '[0-9]'")
    longer = F.length("candidate") - F.length("code")
    pos = F.when(longer == 0, swap).when(longer == -1, drop).otherwise(add)
    found = pairs.withColumn("pos", pos).where("pos is not null")
    kind = F.when(longer == 0, "sub").when(longer == -1, "del").otherwise("ins")
    change = F.when(longer == -1, "").otherwise(F.expr("substring(candidate, pos, 1)"))
    return found.select("code", kind.alias("kind"), F.when(longer == 0, 0).when(longer == -1, 1).otherwise(2).alias("kind_ord"), "pos", change.alias("change"), "candidate")


def first_near(candidates: DataFrame, known: DataFrame, k: int = 10) -> DataFrame:
    """The first k candidates of each code that are known, in the order in which they were made, and their place."""
    found = candidates.join(known.select(F.col("notation").alias("candidate")).hint("merge"), "candidate", "left_semi")  # never broadcast
    place = F.row_number().over(Window.partitionBy("code").orderBy("kind_ord", "pos", "change"))
    return found.withColumn("place", place.cast("long")).where(F.col("place") <= k)


def children_of(code: Column, children: Column, modifiers: Column) -> Column:
    """Children as stored: for a code with a modifier, its base with each modifier; else its children without
    placeholders ('...')."""
    from arbolex.functions.scalars import is_modified, without_modifier

    made = F.transform(modifiers, lambda m: F.concat(without_modifier(code), F.lit("(+"), m, F.lit(")")))
    return F.when(is_modified(code), made).otherwise(F.filter(children, lambda c: ~F.contains(c, F.lit("..."))))


def path_of(code: Column, path: Column) -> Column:
    """The stored path: without the code itself at its end."""
    return F.when((F.size(path) > 0) & (F.element_at(path, -1) == code), F.slice(path, F.lit(1), F.size(path) - 1)).otherwise(path)
