"""Graph and iterative operators G1 to G9.

Loops are driver loops over joins; every round's frame is checkpointed in the shared folder, so lineage
stays short and a lost executor costs no earlier round. Only counts come back to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed
from .picks import top_n


SEGMENT = 10  # paths are joined by pieces of at most 2 ** SEGMENT nodes


def _walks(links: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame | None]:
    """What nodes reach along single links, by jumps of doubling length: (walks, jumps, odd) of distinct links.

    walks: (node, n): how many nodes follow one whose way never forks and ends; jumps: the k-th frame is (node, end), end
    being 2 ** k links on; odd: (node) of all whose way meets a fork or a circle, None if there are none. Rounds are as many
    as the longest way has binary digits; each shuffles a row a node.
    """
    degree = checkpointed(links.groupBy("src").agg(F.count("*").alias("k"), F.min("dst").alias("end")))
    forks = degree.where("k > 1").select(F.col("src").alias("node"))
    live = degree.where("k = 1").select(F.col("src").alias("node"), "end", F.lit(1).cast("long").alias("n"))
    jumps, done, before = [], [], -1
    for k in count(1):
        left = live.count()
        if left in (0, before):  # lengths have no gaps: if none ended on the last stretch, those left never end
            break
        before = left
        jumps.append(live.select("node", "end"))
        held = reduce(DataFrame.unionByName, [*done, live]).select(F.col("node").alias("end"), F.col("end").alias("_end"), F.col("n").alias("_n"))
        both = checkpointed(live.join(held, "end", "left").select("node", F.coalesce("_end", "end").alias("end"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n")))
        done.append(both.where(F.col("n") < 1 << k))
        live = both.where(F.col("n") == 1 << k)
    none = degree.limit(0).select(F.col("src").alias("node"), "end", F.lit(0).cast("long").alias("n"))
    ended = reduce(DataFrame.unionByName, done, none)
    if not left and forks.isEmpty():
        return ended.select("node", "n"), jumps, None
    forked = ended.join(forks.select(F.col("node").alias("end")), "end", "left_semi").select("node")
    odd = checkpointed(forks.union(forked).union(live.select("node")))
    return ended.join(odd, "node", "left_anti").select("node", "n"), jumps, odd


def _paths(seeds: DataFrame, links: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(seed, node, depth) of distinct seeds whose ways never fork and end: ways are joined by pieces of doubling length, each
    saved once as an array; a piece is kept only of nodes that the next round can come to."""
    pieces = links.select(F.col("src").alias("at"), F.array("dst").alias("path"))
    cursor, out = seeds.select("seed", F.col("seed").alias("at"), F.lit(0).alias("base")), []
    for k in count():
        found = checkpointed(cursor.join(pieces, "at").select("seed", "base", "path"))
        if found.isEmpty():
            break
        out.append(found)
        cursor = found.where(F.size("path") == 1 << min(k, SEGMENT)).select("seed", F.element_at("path", -1).alias("at"), (F.col("base") + F.size("path")).alias("base"))
        if k < min(SEGMENT, len(jumps)):
            kept = pieces.join(jumps[k].select(F.col("end").alias("at")).distinct(), "at", "left_semi").withColumn("last", F.element_at("path", -1))
            behind = pieces.select(F.col("at").alias("last"), F.col("path").alias("_more"))
            pieces = checkpointed(kept.join(behind, "last", "left").select("at", F.when(F.size("path") < 1 << k, F.col("path")).otherwise(F.concat("path", F.coalesce("_more", F.array().cast(pieces.schema["path"].dataType)))).alias("path")))
    own = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"))
    each = [p.select("seed", "base", F.posexplode("path").alias("_i", "node")).select("seed", "node", (F.col("base") + F.col("_i") + 1).alias("depth")) for p in out]
    return reduce(DataFrame.unionByName, each, own)


def closure(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """G1: (seed, node, depth): what each seed (column `seed`) reaches over edges (src, dst); least depth, the seed at 0.

    Seeds whose ways never fork (as in forests) are followed by jumps, others wave by wave.
    """
    links = checkpointed(edges.select("src", "dst").distinct())
    asked = checkpointed(seeds.select("seed").distinct())
    _, jumps, odd = _walks(links)
    if odd is None:
        return _paths(asked, links, jumps)
    odd = odd.select(F.col("node").alias("seed"))
    plain = _paths(asked.join(odd, "seed", "left_anti"), links, jumps)
    return plain.unionByName(_wave_closure(asked.join(odd, "seed", "left_semi"), links))


def _wave_closure(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """closure of distinct seeds over any distinct links, wave by wave."""
    seen = checkpointed(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth")))
    frontier = seen
    for depth in count(1):  # ends on cycles too: nodes seen before aren't in the frontier
        step = frontier.join(links, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        frontier = checkpointed(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def rank_seeds(reached: DataFrame, meta: DataFrame, n: int) -> DataFrame:
    """(seed, size, depth): the n seeds of the largest closure, then depth, then text length. meta: (seed, chars)."""
    sizes = reached.groupBy("seed").agg(F.count("*").alias("size"), F.max("depth").alias("depth"))
    return sizes.join(meta, "seed").orderBy(F.desc("size"), F.desc("depth"), F.desc("chars"), "seed").limit(n).select("seed", "size", "depth")


def reach_sketches(nodes: DataFrame, links: DataFrame, k: int) -> DataFrame:
    """(node, n, estimate): the number of nodes that each reaches, itself included: exact below k, else n = k and an estimate.

    A node keeps the k least hashes of what it reaches (the node beside each, so equal hashes stay apart). Only newly kept
    ones go on to its parents, so rounds shrink; a node keeps k at a time, whatever it reaches. Ends on cycles too.
    """
    own = nodes.select("node", F.xxhash64("node").alias("h"), F.col("node").alias("item"))
    seen = frontier = checkpointed(own)
    w = Window.partitionBy("node").orderBy("h", "item")
    for rounds in count(1):
        up = frontier.join(links, F.col("node") == F.col("dst")).select(F.col("src").alias("node"), "h", "item")
        held = seen.join(up.select("node").distinct(), "node", "left_semi")
        both = held.withColumn("new", F.lit(False)).unionByName(up.withColumn("new", F.lit(True)))
        each = both.groupBy("node", "h", "item").agg(F.bool_and("new").alias("new"))
        frontier = checkpointed(each.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).where("new").select("node", "h", "item"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if rounds % 4 == 0:  # few frames to read, and what fell out of the k least goes
            seen = checkpointed(seen.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r"))
    kept = seen.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    share = (F.max("h").cast("double") + 2.0**63 + 1) / 2.0**64
    n = F.count("*")
    return checkpointed(kept.groupBy("node").agg(n.alias("n"), F.when(n < k, n.cast("double")).otherwise((k - 1) / share).alias("estimate")))


def _reach_bounds(sketches: DataFrame, links: DataFrame, k: int) -> DataFrame:
    """(node, bound): no node reaches more than itself and the sum of what its children do, nor than all nodes. Only parents of
    nodes whose bound fell are looked at again."""
    most = sketches.count()
    bounds = checkpointed(sketches.select("node", F.when(F.col("n") < k, F.col("n")).otherwise(most).alias("bound")))
    fell = bounds.where(F.col("bound") < most).select("node")
    while True:
        parents = links.join(fell.select(F.col("node").alias("dst")), "dst", "left_semi").select("src").distinct()
        sums = links.join(parents, "src", "left_semi").join(bounds.select(F.col("node").alias("dst"), "bound"), "dst").groupBy(F.col("src").alias("node")).agg((F.sum("bound") + 1).alias("_sum"))
        lower = checkpointed(sums.join(bounds, "node").where("_sum < bound").select("node", F.col("_sum").alias("bound")))
        if lower.isEmpty():
            return bounds
        fell = lower.select("node")
        bounds = checkpointed(bounds.join(fell, "node", "left_anti").unionByName(lower))


def top_seeds(seeds: DataFrame, edges: DataFrame, meta: DataFrame, n: int, k: int = 16) -> DataFrame:
    """G2 without the closure of every seed: the rows of rank_seeds(closure(seeds, edges), meta, n).

    Seeds whose ways never fork have a size and depth from jumps along them; only the others are sketched. The first n of both
    are ranked together.
    """
    links = checkpointed(edges.select("src", "dst").distinct())
    asked = checkpointed(seeds.select("seed").distinct())
    walks, _, odd = _walks(links)
    plain = asked if odd is None else asked.join(odd.select(F.col("node").alias("seed")), "seed", "left_anti")
    length = F.coalesce("n", F.lit(0).cast("long"))
    sized = plain.join(walks.withColumnRenamed("node", "seed"), "seed", "left").select("seed", (length + 1).alias("size"), length.cast("int").alias("depth"))
    order = [F.desc("size"), F.desc("depth"), F.desc("chars"), "seed"]
    first = sized.join(meta, "seed").orderBy(*order).limit(n).select("seed", "size", "depth")
    if odd is None:
        return first
    rest = _sketched_seeds(asked.join(odd.select(F.col("node").alias("seed")), "seed", "left_semi"), links, meta, n, k)
    return first.unionByName(rest).join(meta, "seed").orderBy(*order).limit(n).select("seed", "size", "depth")


def _sketched_seeds(seeds: DataFrame, links: DataFrame, meta: DataFrame, n: int, k: int) -> DataFrame:
    """top_seeds over any distinct links.

    Sketches of k hashes a node give exact sizes below k and estimates above. Closures are made of the n seeds of the largest
    estimates first (the longest texts among equals); the n-th row so far is the bar. A seed is out once the best row it could
    have is below the bar: its size at most a bound from its children's bounds, or the size of any seed made before that
    reaches it; its depth at most one less than that; its own text length. The rest follows in batches, each four times
    the last, so the result is exact whatever the estimates were.
    """
    chars = meta.groupBy("seed").agg(F.coalesce(F.max("chars"), F.lit(-1)).cast("long").alias("chars"))
    left = checkpointed(seeds.select("seed").distinct().join(chars, "seed"))
    nodes = left.select(F.col("seed").alias("node")).union(links.select("src")).union(links.select("dst")).distinct()
    sketches = reach_sketches(nodes, links, k)
    bounds = _reach_bounds(sketches, links, k)
    known = sketches.join(bounds, "node").select(F.col("node").alias("seed"), F.least("estimate", "bound").alias("estimate"), "bound")
    left = checkpointed(left.join(known, "seed"))
    batch, made, size = left.orderBy(F.desc("estimate"), F.desc("chars"), "seed").limit(n), None, n
    while True:
        batch = checkpointed(batch.select("seed", "chars"))
        reached = checkpointed(_wave_closure(batch.select("seed"), links))
        sizes = checkpointed(reached.groupBy("seed").agg(F.count("*").alias("size"), F.max("depth").alias("depth")).join(batch, "seed"))
        made = sizes if made is None else made.unionByName(sizes)
        best = made.orderBy(F.desc("size"), F.desc("depth"), F.desc("chars")).limit(n).agg(F.count("*").alias("k"), F.min(F.struct("size", "depth", "chars")).alias("bar")).first()
        caps = reached.join(sizes.select("seed", "size"), "seed").groupBy(F.col("node").alias("seed")).agg(F.min("size").alias("cap"))
        open_ = left.join(batch, "seed", "left_anti").join(caps, "seed", "left").withColumn("bound", F.least("bound", "cap")).drop("cap")
        if best["k"] == n:
            row = lambda size, depth, length: F.struct(size.cast("long").alias("size"), depth.cast("long").alias("depth"), length.cast("long").alias("chars"))
            open_ = open_.where(row(F.col("bound"), F.col("bound") - 1, F.col("chars")) >= row(*map(F.lit, best["bar"])))
        left = checkpointed(open_)
        waiting, size = left.count(), size * 4
        if not waiting:
            return made.drop("chars").join(meta, "seed").orderBy(F.desc("size"), F.desc("depth"), F.desc("chars"), "seed").limit(n).select("seed", "size", "depth")
        cut = left.agg(F.percentile_approx("estimate", F.lit(max(0.0, 1 - size / waiting)), F.lit(10000))).first()[0]
        batch = left.where(F.col("estimate") >= cut)


def union_closure(seeds: DataFrame, edges: DataFrame, waves: DataFrame) -> DataFrame:
    """(node, depth): all that the seeds reach, each node once, with its depth in `waves` (node, depth); null where it has none.

    Rows are nodes, not (seed, node) pairs. Nodes whose ways fork or don't end are followed wave by wave; then jumps of 1, 2,
    4 ... links from all that is marked so far mark the rest.
    """
    links = checkpointed(edges.select("src", "dst").distinct())
    _, jumps, odd = _walks(links)
    seen = checkpointed(seeds.select(F.col("seed").alias("node")).distinct())
    if odd is not None:
        forked, frontier = checkpointed(links.join(odd.select(F.col("node").alias("src")), "src", "left_semi")), seen
        while not frontier.isEmpty():
            step = frontier.join(forked, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
            frontier = checkpointed(step.join(seen, "node", "left_anti"))
            seen = seen.unionByName(frontier)
    for jump in jumps:
        seen = checkpointed(seen.unionByName(jump.join(seen, "node", "left_semi").select(F.col("end").alias("node"))).distinct())
    return seen.join(waves.select("node", "depth"), "node", "left")


def dependency_depth(edges: DataFrame) -> DataFrame:
    """(node, depth): 0 for nodes that depend on nothing, else one more than the deepest dependency.

    edges: (src, dst), src depends on dst. Nodes whose ways never fork get their depth from jumps. The others are peeled off: a
    node goes once all it depends on has a depth, so each edge is dropped once and the frame shrinks. Raises if edges are
    left but no node is free: a cycle.
    """
    links = checkpointed(edges.select("src", "dst").distinct())
    walks, _, odd = _walks(links)
    roots = links.select(F.col("dst").alias("node")).distinct().join(links.select(F.col("src").alias("node")), "node", "left_anti")
    known = roots.select("node", F.lit(0).alias("depth")).unionByName(walks.select("node", F.col("n").cast("int").alias("depth")))
    if odd is None:
        return known
    wave = out = checkpointed(known)
    left = checkpointed(links.join(odd.select(F.col("node").alias("src")), "src", "left_semi").select("src", "dst"))
    best = links.limit(0).select(F.col("src").alias("node"), F.lit(0).alias("depth"))
    while True:
        met = left.join(wave.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), (F.col("depth") + 1).alias("depth"))
        best = checkpointed(best.unionByName(met).groupBy("node").agg(F.max("depth").alias("depth")))
        left = checkpointed(left.join(wave.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
        open_ = left.select(F.col("src").alias("node")).distinct()
        wave = checkpointed(best.join(open_, "node", "left_anti"))
        best = best.join(open_, "node", "left_semi")
        if wave.isEmpty():
            break
        out = out.unionByName(wave)
    if not left.isEmpty():
        raise ValueError("dependency_depth: the graph has a cycle")
    return out


def vote_fixpoint(nodes: DataFrame, lineage: DataFrame, joins: DataFrame) -> DataFrame:
    """Nodes (node, family, own) with nulls in family filled by neighbours' votes until nothing changes.

    In a round all unresolved nodes look at the same frozen snapshot: lineage neighbours vote; only where
    they give none, join neighbours do. Most votes win; a tie goes to the node's own family if it is among
    the tied, else the node is `tie` and stays so. Edges are (node, other).

    A node with any vote is settled in that round, so what is open has none of the nodes settled before as a neighbour:
    only those settled in the last round vote, over the edges of open nodes, and both shrink round by round. Every
    round settles a node or ends the loop.
    """
    given = checkpointed(nodes.select("node", "family", "own"))
    unsettled = given.where("family is null").select("node", "own")
    both = lineage.select("node", "other", F.lit(0).alias("kind")).unionByName(joins.select("node", "other", F.lit(1).alias("kind")))
    edges = checkpointed(both.join(unsettled, "node"))
    voters = given.where("family is not null").select("node", "family")
    settled = []
    while True:
        votes = voters.where("family <> 'tie'").select(F.col("node").alias("other"), F.col("family").alias("vote"))
        counted = edges.join(votes, "other").groupBy("node", "own", "kind", "vote").agg(F.count("*").alias("n"))
        w = Window.partitionBy("node")
        tied = counted.withColumn("first", F.min("kind").over(w)).where("kind = first").withColumn("most", F.max("n").over(w)).where("n = most")
        won = tied.groupBy("node").agg(F.count("*").alias("k"), F.min("vote").alias("only"), F.bool_or(F.col("vote") == F.col("own")).alias("has_own"), F.first("own").alias("own"))
        voters = checkpointed(won.select("node", F.when(F.col("k") == 1, F.col("only")).when(F.col("has_own"), F.col("own")).otherwise("tie").alias("family")))
        if voters.isEmpty():
            break
        settled.append(voters)
        edges = checkpointed(edges.join(voters.select("node"), "node", "left_anti").select("node", "other", "kind", "own"))
    if not settled:
        return given.select("node", "family")
    found = reduce(DataFrame.unionByName, settled).select("node", F.col("family").alias("won"))
    return given.join(found, "node", "left").select("node", F.coalesce("family", "won").alias("family"))


def resolve_chain(nodes: DataFrame, stages: Sequence[tuple[str, DataFrame | Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """(node, value, stage): stages in order; the first that gives a node a value is final.

    A stage is a frame (node, value), or a function of the nodes resolved so far that gives one.
    """
    cur = nodes.select("node", F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("stage"))
    for name, given in stages:
        found = (given(cur) if callable(given) else given).select("node", F.col("value").alias("_v"))
        found = found.where("_v is not null").groupBy("node").agg(F.min("_v").alias("_v"))
        cur = cur.join(found, "node", "left").select("node", F.coalesce("value", "_v").alias("value"), F.when(F.col("value").isNotNull(), F.col("stage")).when(F.col("_v").isNotNull(), name).alias("stage"))
    return cur


def absorb_when_all(nodes: DataFrame, partners: DataFrame, members: DataFrame) -> DataFrame:
    """(node, round): a node joins the class once all its partners are in it; those given are round 0.

    partners: (node, other). A node without partners isn't absorbed. A link is dropped once its partner is in, so rounds shrink.
    """
    wave = out = checkpointed(members.select("node").distinct().withColumn("round", F.lit(0)))
    links = partners.select("node", "other").distinct().join(nodes.select("node"), "node", "left_semi")
    left = checkpointed(links.join(wave.select("node"), "node", "left_anti"))
    for k in count(1):  # every round absorbs a node or ends the loop
        new = wave.select(F.col("node").alias("other"))
        touched = left.join(new, "other", "left_semi").select("node").distinct()
        rest = checkpointed(left.join(new, "other", "left_anti").select("node", "other"))
        wave = checkpointed(touched.join(rest.select("node"), "node", "left_anti").withColumn("round", F.lit(k)))
        if wave.isEmpty():
            return out
        out, left = out.unionByName(wave), rest


def inherit_from_parent(nodes: DataFrame, parents: DataFrame, hops: int = 3) -> DataFrame:
    """(node, value, strict, hop): nodes without a value take their first parent's, over at most `hops` hops.

    nodes: (node, value); parents: (node, parent, strict, rank): the least rank that has a value counts in
    each round. A chain is strict only if all its links are.
    """
    cur = nodes.select("node", "value", F.when(F.col("value").isNotNull(), F.lit(True)).alias("strict"), F.when(F.col("value").isNotNull(), F.lit(0)).alias("hop"))
    for k in range(1, hops + 1):
        cur = checkpointed(cur)
        known = cur.where("value is not null").select(F.col("node").alias("parent"), F.col("value").alias("_v"), F.col("strict").alias("_s"))
        found = parents.select("node", "parent", F.col("strict").alias("_link"), "rank").join(known, "parent")
        best = top_n(found, ["node"], [F.col("rank"), F.col("parent")], 1).select("node", "_v", (F.col("_s") & F.col("_link")).alias("_s"))
        none = F.col("value").isNull()
        cur = cur.join(best, "node", "left").select("node", F.coalesce("value", "_v").alias("value"), F.when(none, F.col("_s")).otherwise(F.col("strict")).alias("strict"), F.when(none & F.col("_v").isNotNull(), k).otherwise(F.col("hop")).alias("hop"))
    return cur


def resolve_alias_chain(outputs: DataFrame, edges: DataFrame, max_depth: int = 60) -> DataFrame:
    """(output, block, alias, agg): the base references of each output, and the first aggregate on the way.

    outputs: (output, block, alias); edges: (block, alias, source_block, source_alias, agg); an alias
    without an edge is a base reference. Raises if a chain is longer than max_depth, as a loop is.
    """
    cur = checkpointed(outputs.select("output", "block", "alias", F.lit(None).cast("string").alias("agg")))
    done = None
    links = edges.select("block", "alias", "source_block", "source_alias", F.col("agg").alias("_agg"))
    for _ in range(max_depth):
        base = cur.join(links.select("block", "alias").distinct(), ["block", "alias"], "left_anti").select("output", "block", "alias", "agg")
        done = base if done is None else done.unionByName(base)
        cur = checkpointed(cur.join(links, ["block", "alias"]).select("output", F.col("source_block").alias("block"), F.col("source_alias").alias("alias"), F.coalesce("agg", "_agg").alias("agg")).distinct())
        if cur.isEmpty():
            return done.distinct()
    raise ValueError(f"resolve_alias_chain: deeper than {max_depth}, or a loop")


def view_edges(units: DataFrame, facts: DataFrame, view: Column) -> DataFrame:
    """(src, dst): a view depends on the tables that its text reads. units: (unit_id, sql_hash); facts: (sql_hash, table_name)."""
    return units.where(view).join(facts, "sql_hash").select(F.col("unit_id").alias("src"), F.col("table_name").alias("dst")).distinct()
