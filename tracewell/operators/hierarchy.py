"""Parent-child links to full hierarchies: nested-set ranges, roots, depths, paths, loops.

Sizes go upward and ranges downward, both by doubling: in round k every node knows its ancestor 2^k links up,
so a tree of depth d takes log2(d) rounds instead of d. Upward, a node adds the sizes of the nodes whose
ancestor it is in that round. A round in which no further node reaches a root ends the upward pass, since the
depths of a tree have no gap; what is unprocessed then lies on a loop or below one. Downward, a node starts
behind its parent and behind the earlier siblings' subtrees: the prefix sum over its siblings is its offset,
and the sum of the offsets on its path is the start of its range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import extension, repo_path, unalias
from tracewell.session import Scratch

#: Buckets of one parent's children, for the prefix sums of parents with very many.
BUCKETS = 64


def every_link(graph: DataFrame, specs: DataFrame) -> DataFrame:
    """node_id, parent_id: each file with each file that imports it, once.

    graph: node_id, repo, file_path, imports, imported_by; specs: name, alias_map. A link counts if either end
    records it. Paths are compared by the identity rule after the repo's aliases; the extension, or /index with
    its extension, may be left off: an exact path wins over a left-off extension, that over /index, then the
    lesser path and node_id. Null and blank targets and targets that are no file of the repo give no link. Rows
    with the same node_id count as one node with all their links; an unknown repo has no aliases.
    """
    return _pairs(_rows(graph), specs).distinct()


def resolve_links(graph: DataFrame, specs: DataFrame) -> DataFrame:
    """node_id, parent_id (null for none): one importer of each file, for hierarchies.

    The links are those of ``every_link``. A file with several importers keeps the one with the least node_id.
    """
    rows = _rows(graph)
    none = F.lit(None).cast("long")
    nodes = rows.where("node_id is not null").select("node_id", none.alias("parent_id"))
    return nodes.union(_pairs(rows, specs)).groupBy("node_id").agg(F.min("parent_id").alias("parent_id"))


def _rows(graph: DataFrame) -> DataFrame:
    return graph.select(F.col("node_id").cast("long").alias("node_id"), "repo", repo_path(F.col("file_path")).alias("path"), "imports", "imported_by")


def _pairs(rows: DataFrame, specs: DataFrame) -> DataFrame:
    """node_id, parent_id of the links, where one that both ends record comes twice."""
    aliases = specs.groupBy(F.col("name").alias("repo")).agg(F.max_by("alias_map", F.to_json("alias_map")).alias("alias_map"))
    files = rows.where("path <> ''").groupBy("repo", "path").agg(F.min("node_id").alias("file"))
    bare = F.regexp_replace("path", r"\.[^./]+$", "")
    known = F.when(extension(F.col("path")) != "", F.array(F.struct(F.lit(1).alias("rank"), bare.alias("name"))))
    folder = F.when(bare.rlike("/index$"), F.array(F.struct(F.lit(2).alias("rank"), F.regexp_replace(bare, "/index$", "").alias("name"))))
    empty = F.array().cast("array<struct<rank:int,name:string>>")
    names = F.concat(F.array(F.struct(F.lit(0).alias("rank"), F.col("path").alias("name"))), F.coalesce(known, empty), F.coalesce(folder, empty))
    lookup = (
        files.select("repo", "path", "file", F.explode(names).alias("n"))
        .groupBy("repo", F.col("n.name").alias("target"))
        .agg(F.min(F.struct("n.rank", "path", "file"))["file"].alias("found"))
    )
    ends = rows.select("node_id", "repo", F.col("imported_by").alias("raw"), F.lit(True).alias("up")).union(
        rows.select("node_id", "repo", F.explode("imports").alias("raw"), F.lit(False))
    )
    ends = ends.withColumn("raw", repo_path(F.col("raw"))).where("raw <> ''").distinct()
    ends = ends.join(aliases, "repo", "left").select("node_id", "repo", "up", unalias(F.col("raw"), F.col("alias_map")).alias("target"))
    return ends.join(lookup, ["repo", "target"]).select(
        F.when(F.col("up"), F.col("node_id")).otherwise(F.col("found")).alias("node_id"),
        F.when(F.col("up"), F.col("found")).otherwise(F.col("node_id")).alias("parent_id"),
    )


def _double(state: DataFrame, carried: dict[str, Column]) -> DataFrame:
    """Each node takes over from its ancestor; ``carried`` combines columns of a (own) and b (the ancestor's).

    Many nodes may share an ancestor: they are on the left, where adaptive execution splits skewed partitions.
    """
    a, b = state.alias("a"), state.alias("b")
    joined = a.join(b, F.col("a.anc") == F.col("b.node_id"), "left")
    moved = F.col("b.node_id").isNotNull()
    return joined.select(
        F.col("a.node_id").alias("node_id"),
        F.col("b.anc").alias("anc"),
        *[F.when(moved, v).otherwise(F.col(f"a.{k}")).alias(k) for k, v in carried.items()],
    )


def _upward(links: DataFrame, scratch: Scratch, tag: str) -> tuple[DataFrame, DataFrame]:
    """node_id, size of the processed nodes; node_id, anc of the unprocessed."""
    state = scratch.write(links.select("node_id", F.col("parent_id").alias("anc"), F.lit(1).cast("long").alias("size")), f"{tag}0")
    left, k = None, 0
    while True:
        open_now = state.where("anc is not null").count()
        if open_now == 0 or open_now == left:
            break
        left = open_now
        gained = state.where("anc is not null").groupBy(F.col("anc").alias("node_id")).agg(F.sum("size").alias("gained"))
        jumped = _double(state, {"size": F.col("a.size")})
        k += 1
        grown = jumped.join(gained, "node_id", "left").select("node_id", "anc", (F.col("size") + F.coalesce("gained", F.lit(0))).alias("size"))
        state = scratch.write(grown, f"{tag}{k}")
        if k > 1:
            scratch.drop(f"{tag}{k - 1}")
    return state.where("anc is null").select("node_id", "size"), state.where("anc is not null").select("node_id", "anc")


def _loops(links: DataFrame, rest: DataFrame, scratch: Scratch) -> DataFrame:
    """node_id, loop_id of the nodes on loops; loop_id is the least node_id of the loop."""
    state, k, reached = rest, 0, None
    while True:  # the images of ever longer walks shrink to the loops
        image = state.select("anc").distinct().count()
        if image == reached:
            break
        reached, k = image, k + 1
        state = scratch.write(_double(state, {}), f"walk{k}")
    on = scratch.write(state.select(F.col("anc").alias("node_id")).distinct(), "on_loops")
    least = links.join(on, "node_id", "left_semi").select("node_id", F.col("parent_id").alias("anc"), F.least("node_id", "parent_id").alias("loop_id"))
    least, total, k = scratch.write(least, "loop0"), None, 0
    while True:  # ends when a round lowers nothing
        now = least.agg(F.sum(F.col("loop_id").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return least.select("node_id", "loop_id")
        total, k = now, k + 1
        least = scratch.write(_double(least, {"loop_id": F.least("a.loop_id", "b.loop_id")}), f"loop{k}")


def _offsets(forest: DataFrame, sizes: DataFrame) -> DataFrame:
    """node_id, parent_id, size, offset from the parent's start; siblings lie in the order of bucket and node_id."""
    rows = forest.join(sizes, "node_id").withColumn("bucket", F.pmod(F.xxhash64("node_id"), F.lit(BUCKETS)))
    kids = rows.where("parent_id is not null")
    before = Window.partitionBy("parent_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows
    base = (
        kids.groupBy("parent_id", "bucket")
        .agg(F.sum("size").alias("held"))
        .select("parent_id", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    )
    within = Window.partitionBy("parent_id", "bucket").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = kids.withColumn("own", F.coalesce(F.sum("size").over(within), F.lit(0))).join(base, ["parent_id", "bucket"])
    placed = placed.select("node_id", "parent_id", "size", (F.lit(1) + F.col("base") + F.col("own")).alias("offset"))
    roots = rows.where("parent_id is null").select("node_id", "parent_id", "size", F.lit(0).cast("long").alias("offset"))
    return roots.union(placed)


def nested_sets(links: DataFrame, paths: bool = False) -> DataFrame:
    """The hierarchy of every node.

    links: node_id (unique), parent_id (null for a root, else a node_id). Result, one row per node: node_id,
    parent_id, root_id, depth, size (nodes of the subtree with itself), lo, hi (the nested-set range: u is at or
    below v if both have the same top_id and lo(v) <= lo(u) <= hi(v)), top_id (the root of the ranges), on_loop,
    and with ``paths`` the array path of node_ids from top_id down.

    A node on a loop or below one has depth -1 and as root_id the least node_id of the loop; its ranges hold
    for the tree that hangs below the loop's node top_id, which keeps its parent_id. A node that is its own
    parent is a loop of one. Repeated links count once, of several parents the least counts, and a parent that
    is no node gives no link. An empty table gives an empty result.
    """
    scratch = Scratch(links.sparkSession)
    one = links.groupBy(F.col("node_id").cast("long").alias("node_id")).agg(F.min(F.col("parent_id").cast("long")).alias("parent_id"))
    nodes = one.select(F.col("node_id").alias("parent_id"))
    known = one.where("parent_id is not null").join(nodes, "parent_id", "left_semi")
    links = scratch.write(one.select("node_id").join(known, "node_id", "left"), "links")
    sizes, rest = _upward(links, scratch, "up")
    looped = not rest.isEmpty()
    if looped:
        loops = _loops(links, rest, scratch)
        hanging = rest.select("node_id").join(links, "node_id").join(loops, "node_id", "left")
        hanging = scratch.write(hanging.select("node_id", F.when(F.col("loop_id").isNull(), F.col("parent_id")).alias("parent_id"), "loop_id"), "hanging")
        below, none = _upward(hanging, scratch, "below")
        forest = links.join(hanging.select("node_id"), "node_id", "left_anti").union(hanging.select("node_id", "parent_id"))
        sizes = sizes.union(below)
    else:
        forest = links
    state = _offsets(forest, sizes).select(
        "node_id",
        F.col("parent_id").alias("anc"),
        F.col("offset").alias("lo"),
        F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("depth"),
        F.coalesce("parent_id", "node_id").alias("top_id"),
        "size",
        *([F.when(F.col("parent_id").isNull(), F.array("node_id")).otherwise(F.array("parent_id", "node_id")).alias("path")] if paths else []),
    )
    state, k = scratch.write(state, "down0"), 0
    sums = {"lo": F.col("a.lo") + F.col("b.lo"), "depth": F.col("a.depth") + F.col("b.depth"), "top_id": F.col("b.top_id"), "size": F.col("a.size")}
    if paths:  # both hold the ancestor
        sums["path"] = F.concat("b.path", F.slice("a.path", F.lit(2), F.size("a.path")))
    while not state.where("anc is not null").isEmpty():
        k += 1
        state = scratch.write(_double(state, sums), f"down{k}")
        if k > 1:
            scratch.drop(f"down{k - 1}")
    out = state.join(links, "node_id")
    if looped:
        marks = loops.select(F.col("node_id").alias("top_id"), "loop_id")
        out = out.join(F.broadcast(marks) if loops.count() <= 100_000 else marks, "top_id", "left")
    else:
        out = out.withColumn("loop_id", F.lit(None).cast("long"))
    in_loop = F.col("loop_id").isNotNull()
    return out.select(
        "node_id",
        "parent_id",
        F.coalesce("loop_id", "top_id").alias("root_id"),
        F.when(in_loop, -1).otherwise(F.col("depth")).cast("int").alias("depth"),
        "size",
        "lo",
        (F.col("lo") + F.col("size") - 1).alias("hi"),
        "top_id",
        (in_loop & (F.col("node_id") == F.col("top_id"))).alias("on_loop"),
        *(["path"] if paths else []),
    )


def _contained(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """a, b: each of ``upper`` (top_id, a, lo, hi) with each of ``lower`` (top_id, b, at) in lo < at <= hi.

    A range is cut into aligned blocks, two of each size at most, and a start lies in one block of each size that
    any range of its tree has: both meet by equality, exactly once. So no pair is tried in vain, and one large
    tree is spread over its blocks.
    """
    shift = lambda x, k: F.call_function("shiftright", x, k)
    k0 = F.floor(F.log2((F.col("hi") - F.col("lo")).cast("double"))).cast("int")
    one = F.lit(1).cast("long")

    def blocks(k: Column) -> Column:
        first = shift(F.col("lo") + F.call_function("shiftleft", one, k), k)  # of lo + 1 on, rounded up
        end = shift(F.col("hi") + 1, k)
        block = lambda x: F.struct(k.alias("level"), x.alias("block"))
        odd = lambda x: x.bitwiseAND(1) == 1
        left = F.when((first < end) & odd(first), F.array(block(first)))
        right = F.when((first < end) & odd(end), F.array(block(end - 1)))
        none = F.array().cast("array<struct<level:int,block:bigint>>")
        return F.concat(F.coalesce(left, none), F.coalesce(right, none))

    ranges = upper.where("hi > lo").withColumn("levels", k0)
    high = ranges.groupBy("top_id").agg(F.max("levels").alias("levels"))
    cut = ranges.select("top_id", "a", F.inline(F.flatten(F.transform(F.sequence(F.lit(0), F.col("levels")), blocks))))
    starts = lower.join(high, "top_id").select("top_id", "b", "at", F.explode(F.sequence(F.lit(0), F.col("levels"))).alias("level"))
    starts = starts.select("top_id", "b", "level", shift(F.col("at"), F.col("level")).alias("block"))
    return starts.join(cut, ["top_id", "level", "block"]).select("a", "b")


def _asked(sets: DataFrame, of: DataFrame | None) -> DataFrame:
    return sets if of is None else sets.join(of.select("node_id").distinct(), "node_id", "left_semi")


def descendants(sets: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """node_id, descendant_id for all nodes, or those of ``of`` (column node_id), by the ranges of ``nested_sets``.

    A node on a loop has those below it that hang on it without a way around the loop.
    """
    upper = _asked(sets, of).select("top_id", F.col("node_id").alias("a"), "lo", "hi")
    lower = sets.select("top_id", F.col("node_id").alias("b"), F.col("lo").alias("at"))
    return _contained(upper, lower).select(F.col("a").alias("node_id"), F.col("b").alias("descendant_id"))


def ancestors(sets: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """node_id, ancestor_id for all nodes, or those of ``of``: the ranges that hold the node's start."""
    upper = sets.select("top_id", F.col("node_id").alias("a"), "lo", "hi")
    lower = _asked(sets, of).select("top_id", F.col("node_id").alias("b"), F.col("lo").alias("at"))
    return _contained(upper, lower).select(F.col("b").alias("node_id"), F.col("a").alias("ancestor_id"))
