"""Partitioning, community detection and what follows on assignments.

``edges``: src, dst, weight; an ``assign`` table: node, cluster (and a partition column where there is one).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from depweave.functions.paths import with_prefix, with_sim_prefix
from depweave.operators.moves import Nodes, packed
from depweave.operators.spread import dealt_join, hot_keys, spread_join
from depweave.sources.scratch import cut, numbered


def partition_nodes(nodes: DataFrame, min_size: int = 5, depth: int = 2, target: int | None = None) -> DataFrame:
    """node, partition by directory prefix (G1).

    Prefixes of ``min_size`` files or more stand by themselves; the rest pool. A pool smaller than that joins
    the smallest standing group (ties by name), else it is a group of its own. With a ``target``, everything
    is one group where there would be more than 1.5 * target groups.
    """
    rows = with_prefix(nodes.select("node").distinct(), depth, "node")
    sizes = rows.groupBy("prefix").agg(F.count("*").alias("n"))
    stands = F.col("n") >= min_size
    facts = sizes.agg(
        F.count_if(stands).alias("groups"),
        F.coalesce(F.sum(F.when(~stands, F.col("n"))), F.lit(0)).alias("pool"),
        F.min_by(F.when(stands, F.col("prefix")), F.when(stands, F.struct("n", "prefix"))).alias("smallest"),
    )
    join_small = (F.col("pool") < min_size) & (F.col("groups") > 0)
    total = F.col("groups") + F.when((F.col("pool") > 0) & ~join_small, 1).otherwise(0)
    single = (F.col("groups") == 0) | (F.lit(False) if target is None else total * 2 > target * 3)
    own = F.when(single, "__all__").when(stands, F.col("prefix")).when(join_small, F.col("smallest")).otherwise("__pool__")
    # One row of facts, and one row a prefix: both go to all tasks only if small enough for the planner.
    plan = sizes.join(F.broadcast(facts)).select("prefix", own.alias("partition"))
    return rows.join(plan, "prefix").select("node", "partition")


def target_components(n_files, minimum: int = 3, maximum: int = 25, per: int = 1000):
    """min(maximum, max(minimum, files // per)) as a column."""
    n = F.col(n_files) if isinstance(n_files, str) else n_files
    return F.least(F.lit(maximum), F.greatest(F.lit(minimum), F.floor(n / per))).cast("int")


def partition_targets(partitions: DataFrame, target: int) -> DataFrame:
    """partition, n, target: max(2, target * part // total)."""
    sizes = partitions.groupBy("partition").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("_total"))
    return sizes.join(F.broadcast(total)).select("partition", "n", F.greatest(F.lit(2), F.floor(F.lit(target) * F.col("n") / F.col("_total"))).cast("int").alias("target"))


def globalise_ids(assign: DataFrame, partition: str = "partition", local: str = "cluster") -> DataFrame:
    """``cluster`` ids that are unique over partitions: a partition's ids follow those before it."""
    ids = numbered(assign.select(partition, local).distinct(), [partition, local], "_id")
    return assign.join(ids, [partition, local]).select(*(c for c in assign.columns if c != local), (F.col("_id") - 1).cast("int").alias(local))


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, src: str = "src", dst: str = "dst", small: int = 1 << 17) -> DataFrame:
    """node, component: the smallest node that each reaches (G7), for both ends of every edge and all ``nodes``.

    Each round points every node at its smallest smaller neighbour, jumps twice, and contracts the edges, which
    shrink fast. Rounds are written to the shared folder, so plans stay short and a lost executor costs a round at
    most. The table of pointers is broadcast up to ``small`` rows; a larger one is joined with the rows of nodes that
    many point at dealt over tasks (``spread_join``). More than ``small`` nodes are numbered in their order first, so rounds
    move numbers and not names, and 16 times as many are broadcast. Edges with a null end are ignored."""
    rows = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    ends = rows.select(F.explode(F.array("a", "b")).alias("node"))
    ends = ends if nodes is None else ends.unionByName(nodes.select("node"))
    label = cut(ends.distinct().withColumn("component", F.col("node")), "labels")
    one_way = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    rows = cut(rows.where("a <> b").select(*one_way).distinct(), "links")
    names = None
    if dict(label.dtypes)["node"] == "string" and label.count() > small:
        names = cut(numbered(label.select("node"), ["node"], "id"), "names")
        for end in ("a", "b"):
            to = names.select(F.col("node").alias(end), F.col("id").alias(f"_{end}"))
            rows = spread_join(rows, to, end, counted=rows.select(end)).drop(end).withColumnRenamed(f"_{end}", end)
        rows = cut(rows, "links")
        label = cut(names.select(F.col("id").alias("node"), F.col("id").alias("component")), "labels")
        small *= 16
    while not rows.isEmpty():
        up = cut(rows.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), "up")
        few = up.count() <= small

        def looked_up(table: DataFrame, key: str, few: bool = few) -> DataFrame:
            """``table`` with what ``up`` (as of now) has for the key in place of it, where it has the key."""
            to = up.select(F.col("node").alias(key), F.col("up").alias("to"))
            found = table.join(F.broadcast(to), key, "left") if few else spread_join(cut(table, "spread"), to, key, "left")
            return found.withColumn(key, F.coalesce("to", key)).drop("to").select(table.columns)

        up = cut(looked_up(looked_up(up, "up"), "up"), "up")
        label = cut(looked_up(label, "component"), "labels")
        rows = cut(looked_up(looked_up(rows, "a"), "b").where("a <> b").select(*one_way).distinct(), "links")
    if names is None:
        return label
    own = spread_join(label, names.select(F.col("id").alias("component"), F.col("node").alias("_name")), "component")
    return own.join(names.select(F.col("id").alias("node"), F.col("node").alias("_node")), "node").select(F.col("_node").alias("node"), F.col("_name").alias("component"))


def modularity(edges: DataFrame, assign: DataFrame, gamma: float = 1.0) -> DataFrame:
    """One row q: the sum over clusters of inner / m - gamma * (degree / 2m)**2; 0 without edges or with one
    cluster (A27)."""
    own = assign.select("node", "cluster")
    rows = edges.join(own.select(F.col("node").alias("src"), F.col("cluster").alias("a")), "src").join(own.select(F.col("node").alias("dst"), F.col("cluster").alias("b")), "dst")
    ends = F.explode(F.array(F.struct(F.col("a").alias("c")), F.struct(F.col("b").alias("c"))))
    per = rows.select("weight", (F.col("a") == F.col("b")).alias("inside"), ends.alias("e"))
    per = per.groupBy("e.c").agg(F.sum("weight").alias("k"), F.sum(F.when(F.col("inside"), F.col("weight") / 2).otherwise(0.0)).alias("inner"))
    m = per.agg((F.sum("k") / 2).alias("m"), F.count("*").alias("n"))
    q = per.join(F.broadcast(m)).agg(F.sum(F.col("inner") / F.col("m") - gamma * (F.col("k") / (2 * F.col("m"))) ** 2).alias("q"), F.max("n").alias("n"))
    return q.select(F.when(F.coalesce("n", F.lit(0)) > 1, F.coalesce("q", F.lit(0.0))).otherwise(0.0).alias("q"))


@dataclass(frozen=True)
class Search:
    """Bounds of a search for communities. ``levels`` of contraction; ``rounds`` of moves a level, ``last`` at the end; a
    level but the last ends early where at most ``tolerance`` of its nodes moved in two successive rounds. ``surely``: the
    search ends as ``_settle`` says. ``refining``: rounds of the refinement. Up to ``small`` nodes are broadcast (some 45 bytes
    each), and a round is one pass over packed links (``moves``); more are joined with hot nodes and communities dealt over
    tasks. A contracted level of up to ``held`` links (24 bytes each) goes to the driver, where rounds take no job."""

    levels: int = 5
    rounds: int = 12
    last: int = 16
    tolerance: float = 0.02
    surely: bool = False
    refining: int = 3
    small: int = 1 << 21
    held: int = 1 << 20


#: For each step of a sweep, where only the number of communities decides how to go on.
STEP = Search(levels=5, rounds=8, last=8, tolerance=0.05, refining=3)


@dataclass
class _Level:
    """A level's graph: links (node, other, weight; both ways, no loops), the number of its nodes, and which nodes many
    links have (None: none, or few nodes). With few nodes ``links`` are as ``moves.packed`` has them."""

    links: DataFrame
    n: int
    few: bool
    hot: DataFrame | None

    def of(self, links: DataFrame, table: DataFrame, key: str) -> DataFrame:
        """Links with what the table has for their ``key``; links of a hub aren't in one task."""
        return dealt_join(links, table, key, None if self.hot is None else self.hot.withColumnRenamed("node", key))

    def totals(self, state: DataFrame, of: list[str]) -> DataFrame:
        """``of`` and tot, the strength of the node's community; rows of a giant community aren't in one task."""
        sums = state.groupBy("comm").agg(F.sum("k").alias("tot"))
        rows = state.select("comm", *of)
        return spread_join(rows, sums, "comm")


def _level(both: DataFrame, nodes: DataFrame, n: int, how: Search) -> _Level:
    if n <= how.small:
        return _Level(packed(both.where("node <> other"), nodes, n), n, True, None)
    links = cut(both.where("node <> other"), "links")
    hot = hot_keys(links, "node")
    return _Level(links, n, False, hot if hot is None else cut(hot, "hubs"))


def _turn(turn: int) -> Column:
    """Whose turn it is: half of the nodes, and in the next round the other half; four such pairs take turns, so that the
    code of a round is compiled eight times at most."""
    return F.pmod(F.xxhash64("node", F.lit(turn // 2 % 4)), F.lit(2)) == turn % 2


def _round(level: _Level, state: DataFrame, turn: int, many: bool = False) -> DataFrame:
    """``state`` (node, comm, k, rate, waiting, moved) after a round. Nodes are numbers from 1 on; a community that a
    node founds has a negative one of its own.

    A node is active if it hasn't had its turn since it or a neighbour last moved. The active nodes of one half of all
    go where they gain most: being in C gains k_in(C) - rate * k * (the strength of C without the node), where rate is
    gamma / 2m; alone it gains 0. Ties go to the smaller community, and staying wins unless another gains clearly more
    (both rounded, so that sums taken in another order still tie). Only links of nodes that moved, and of active nodes,
    are shuffled, added up per node and community before. ``many``: so many nodes moved that all count as active.
    """
    links = level.links
    front = level.of(links.select("node", "other"), state.where("moved").select("node"), "node").select(F.col("other").alias("node")).distinct()
    rows = state.join(front.withColumn("front", F.lit(True)), "node", "left")
    active = F.lit(True) if many else F.col("waiting") | F.col("front").isNotNull()
    rows = cut(rows.select("node", "comm", "k", "rate", active.alias("active")), "active")
    movers = rows.where(F.col("active") & _turn(turn)).select("node", "k", "rate", F.col("comm").alias("was"))
    placed = cut(level.totals(state, ["node"]), "placed")
    near = level.of(level.of(links, movers, "node"), placed.select(F.col("node").alias("other"), F.col("comm").alias("to"), "tot"), "other")
    near = near.select("node", "to", "weight", "tot", "k", "rate", "was")
    own = movers.join(placed.select("node", "tot"), "node").select("node", F.col("was").alias("to"), F.lit(0.0).alias("weight"), "tot", "k", "rate", "was")
    alone = movers.select("node", (-(F.col("node") * 8 + turn % 8)).alias("to"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("tot"), "k", "rate", "was")
    sums = near.unionByName(own).unionByName(alone).groupBy("node", "to").agg(F.sum("weight").alias("k_in"), *(F.max(c).alias(c) for c in ("tot", "k", "rate", "was")))
    stays = F.col("to") == F.col("was")
    gain = F.col("k_in") - F.col("rate") * F.col("k") * (F.col("tot") - F.when(stays, F.col("k")).otherwise(0.0))
    sums = sums.withColumn("gain", gain)
    loss = F.round(-F.when(stays, F.col("gain") + 1e-9 * (1 + F.abs("gain"))).otherwise(F.col("gain")), 9)
    best = sums.groupBy("node").agg(F.min(F.struct(loss.alias("loss"), "to"))["to"].alias("to"))
    out = rows.join(best, "node", "left")
    moved = F.coalesce(F.col("to") != F.col("comm"), F.lit(False))
    return out.select("node", F.coalesce("to", "comm").alias("comm"), "k", "rate", (F.col("active") & ~_turn(turn)).alias("waiting"), moved.alias("moved"))


class Turns:
    """Rounds taken so far, and nodes moved in each; for searches of the same graph, its nodes and their partitions."""

    def __init__(self):
        self.moved: list[int] = []
        self.first: tuple[Nodes, pa.Array] | None = None


def _settle(level: _Level, state: DataFrame, turns: Turns, how: Search, tolerance: float, surely: bool = False) -> tuple[DataFrame, int]:
    """``state`` (node, comm, k, rate) after rounds until no node is active, or few move; and how many moved. ``surely``:
    as moves also change what a community weighs for nodes that aren't near, all nodes are active once more then, until
    that moves none (or ``how.rounds`` end it: here nodes may go back and forth together)."""
    state = state.select("node", "comm", "k", "rate", F.lit(True).alias("waiting"), F.lit(False).alias("moved"))
    total, last, since = 0, None, 0
    for _ in range(how.rounds):
        seen = Observation()
        new = _round(level, state, len(turns.moved), last is None or last > level.n / 8).observe(seen, F.count_if("moved").alias("moved"), F.count_if(F.col("moved") | F.col("waiting")).alias("open"))
        state = cut(new, "state")
        moved, open_ = seen.get["moved"], seen.get["open"]
        turns.moved.append(moved)
        total, since = total + moved, since + moved
        if not open_:
            if not surely or not since:
                break
            state, since = state.withColumn("waiting", F.lit(True)), 0
        elif last is not None and tolerance and max(moved, last) <= tolerance * level.n:
            break
        last = moved
    return state.select("node", "comm", "k", "rate"), total


def _refine(level: _Level, state: DataFrame, how: Search) -> DataFrame:
    """node, part: communities cut into parts that hang together, from single nodes on.

    A node that is still alone joins the part of its community where it gains most, if it gains and is itself well
    linked with the community. In a round only one half's nodes may join, and only parts that none of them leaves."""
    homes = cut(level.totals(state, ["node", "k", "rate"]).withColumnsRenamed({"comm": "home", "tot": "held"}), "homes")
    inside = level.of(level.links, homes.select("node", "home", "k", "rate", "held"), "node")
    inside = level.of(inside, homes.select(F.col("node").alias("other"), F.col("home").alias("_home")), "other").where("home = _home")
    inside = cut(inside.select("node", "other", "weight", "k", "rate", "held"), "inside")
    linked = inside.groupBy("node").agg(F.sum("weight").alias("w"), F.max("k").alias("k"), F.max("rate").alias("rate"), F.max("held").alias("held"))
    well = cut(linked.where(F.col("w") >= F.col("rate") * F.col("k") * (F.col("held") - F.col("k"))).select("node"), "well")
    parts = cut(homes.select("node", F.col("node").alias("comm"), "k").join(well.withColumn("well", F.lit(True)), "node", "left"), "parts")
    for turn in range(how.refining):
        sizes = parts.groupBy("comm").agg(F.sum("k").alias("tot"), F.count("*").alias("n"))
        rows = cut(spread_join(parts, sizes, "comm"), "parts")
        leaves = (F.col("n") == 1) & F.coalesce("well", F.lit(False)) & _turn(turn)
        movers = rows.where(leaves).select("node")
        open_ = rows.where(~leaves).select(F.col("node").alias("other"), F.col("comm").alias("to"), "tot")
        near = level.of(level.of(inside, movers, "node"), open_, "other").groupBy("node", "to").agg(F.sum("weight").alias("k_in"), *(F.max(c).alias(c) for c in ("tot", "k", "rate")))
        near = near.withColumn("gain", F.round(F.col("k_in") - F.col("rate") * F.col("k") * F.col("tot"), 9)).where("gain > 0")
        best = near.groupBy("node").agg(F.min(F.struct((-F.col("gain")).alias("o"), "to"))["to"].alias("to"))
        seen = Observation()
        out = parts.join(best, "node", "left").select("node", F.coalesce("to", "comm").alias("comm"), "k", "well", F.col("to").isNotNull().alias("joined"))
        out = cut(out.observe(seen, F.count_if("joined").alias("joined")), "parts")
        parts = out.drop("joined")
        if not seen.get["joined"] and turn:
            break
    return parts.select("node", F.col("comm").alias("part"))


def _numbered_graph(edges: DataFrame, nodes: DataFrame, partition: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Nodes (name, partition, node: a number in the order of the names) and links of both directions inside partitions."""
    ids = nodes.select("node").distinct()
    part = ids.withColumn("partition", F.lit("__all__")) if partition is None else ids.join(partition.select("node", "partition"), "node")
    part = cut(numbered(part.withColumnRenamed("node", "name"), ["name", "partition"], "node"), "nodes")
    start = cut(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")), "weighted")
    for end, node, of in (("src", "node", "_p"), ("dst", "other", "_q")):
        start = spread_join(start, part.select(F.col("name").alias(end), F.col("node").alias(node), F.col("partition").alias(of)), end)
    start = cut(start.where("_p = _q").select("node", "other", "weight"), "graph")
    return part, cut(start.unionByName(start.select(F.col("other").alias("node"), F.col("node").alias("other"), "weight")), "graph")


def _search(graph: DataFrame, part: DataFrame, gammas: DataFrame, start: DataFrame | None, how: Search, turns: Turns) -> DataFrame:
    """node, comm after moving, refining and contracting from ``start`` (node, comm; None: single nodes) on."""

    def strengths(both: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
        """node, k, rate of (node, partition)."""
        k = nodes.join(both.groupBy("node").agg(F.sum("weight").alias("k")), "node", "left").withColumn("k", F.coalesce("k", F.lit(0.0)))
        rates = k.groupBy("partition").agg(F.sum("k").alias("k2")).join(gammas, "partition")
        rates = rates.select("partition", F.when(F.col("k2") > 0, F.col("gamma") / F.col("k2")).otherwise(0.0).alias("rate"))
        k = k.join(F.broadcast(rates), "partition") if n <= how.small else spread_join(cut(k, "strengths"), rates, "partition")
        return cut(k.select("node", "k", "rate"), "strengths")

    tops = part.select("node", "partition")
    n = tops.count()
    if n <= how.small:
        nodes = _begun(graph, tops, n, gammas, start, turns)
        nodes.again(_levels(nodes, how, turns)).settle(turns.moved, how.last, 0.0, how.surely)
        return nodes.table(comm=nodes.comm)
    first = own = _level(graph, tops, n, how)
    base = at = strengths(graph, tops, n)
    comm = tops.select("node", F.col("node").alias("comm")) if start is None else start
    both, belongs = graph, tops.select("node", F.col("node").alias("top"))
    for depth in range(how.levels):
        if own.few:
            nodes = Nodes(own.links, at.join(comm, "node"))
            comm = nodes.table(comm=_levels(nodes, how, turns, depth))
            break
        state, moved = _settle(own, at.join(comm, "node"), turns, how, how.tolerance)
        if depth and not moved:
            break
        comm = state.select("node", "comm")
        parts = _refine(own, state, how)
        here = parts.agg(F.countDistinct("part")).first()[0]
        if here == n:
            break
        # Parts become nodes; inner weight stays as a loop, seen from both ends. Each begins in its community.
        for end in ("node", "other"):
            to = parts.select(F.col("node").alias(end), F.col("part").alias(f"_{end}"))
            both = dealt_join(both, to, end, None if own.hot is None else own.hot.withColumnRenamed("node", end)).drop(end).withColumnRenamed(f"_{end}", end)
        both = cut(both.groupBy("node", "other").agg(F.sum("weight").alias("weight")), "graph")
        tops = cut(tops.join(parts, "node").select(F.col("part").alias("node"), "partition").distinct(), "tops")
        comm = cut(comm.join(parts, "node").groupBy(F.col("part").alias("node")).agg(F.min("comm").alias("comm")), "comms")
        link = parts.select(F.col("node").alias("top"), F.col("part").alias("_top"))
        belongs = cut(spread_join(belongs, link, "top").select("node", F.col("_top").alias("top")), "belongs")
        n, at = here, strengths(both, tops, here)
        own = _level(both, tops, n, how)
    to = comm.select(F.col("node").alias("top"), "comm")
    found = spread_join(belongs, to, "top").select("node", "comm")
    # Last, single nodes once more, until none is active.
    return _settle(first, base.join(found, "node"), turns, replace(how, rounds=how.last), 0.0, how.surely)[0].select("node", "comm")


def _begun(graph: DataFrame, tops: DataFrame, n: int, gammas: DataFrame, start: DataFrame | None, turns: Turns) -> Nodes:
    """The first level's nodes, in the communities of ``start``. Later searches of the same graph, or of some whole
    partitions of it, use the links that the first one packed."""
    if turns.first is None:
        k = graph.groupBy("node").agg(F.sum("weight").alias("k"))
        state = tops.join(k, "node", "left").select("node", F.col("node").alias("comm"), F.coalesce("k", F.lit(0.0)).alias("k"), F.lit(0.0).alias("rate"), "partition")
        state = cut(state, "strengths")
        of = state.select("node", "partition").toArrow().sort_by("node")["partition"]
        turns.first = Nodes(packed(graph.where("node <> other"), tops, n), state), of
    first, of = turns.first
    gammas = gammas.select("partition", "gamma").toArrow()
    at = pc.index_in(of, gammas["partition"].combine_chunks()).to_numpy(zero_copy_only=False)
    held = ~np.isnan(at) if at.dtype.kind == "f" else np.ones(len(at), bool)
    at, comm, rate = at[held].astype(np.int64), first.ids.copy(), np.zeros(len(held))
    total = np.bincount(at, first.k[held], len(gammas))[at]
    rate[held] = np.where(total > 0, gammas["gamma"].to_numpy()[at] / np.where(total > 0, total, 1.0), 0.0)
    if start is not None:
        rows = start.select("node", "comm").toArrow()
        comm[np.searchsorted(first.ids, rows["node"].to_numpy())] = rows["comm"].to_numpy()
    return first.only(held, comm, rate)


def _levels(first: Nodes, how: Search, turns: Turns, depth: int = 0) -> np.ndarray:
    """The communities of ``first``'s nodes after the levels from ``depth`` on, where a level's nodes are columns here and its
    links packed: it is contracted by one job, and small contracted levels take none at all."""
    own, belongs = first, np.arange(len(first.ids))
    for level in range(depth, how.levels):
        moved = own.settle(turns.moved, how.rounds, how.tolerance)
        if level and not moved:
            break
        part = own.refine(how.refining)
        if len(np.unique(part)) == len(part):
            break
        own, to = own.merged(part, how.held)
        belongs = to[belongs]
    return own.comm[belongs]


def _finished(graph: DataFrame, part: DataFrame, comm: DataFrame, how: Search, own: Nodes | None = None) -> DataFrame:
    """node (a name), partition, cluster: communities cut into connected parts, numbered by their smallest nodes. ``own``: the
    nodes of ``part`` with their packed links, where a search has made them."""
    n = part.count()
    if n <= how.small:
        if own is None:
            state = comm.select("node", "comm", F.lit(0.0).alias("k"), F.lit(0.0).alias("rate"))
            own = Nodes(packed(graph.where("node <> other").join(part.select("node"), "node", "left_semi"), part, n), state)
        else:
            own = own.again(comm.select("node", "comm").toArrow().sort_by("node")["comm"].to_numpy())
        ids = own.table(component=own.ids[own.pieces()])
        # Windows over the first nodes of pieces: a row a cluster.
        order = F.row_number().over(Window.partitionBy("partition").orderBy("component"))
        firsts = ids.where("node = component").join(part.select("node", "partition"), "node").select("component", (order - 1).alias("cluster"))
        return cut(part.join(ids, "node").join(firsts, "component").select(F.col("name").alias("node"), "partition", "cluster"), "found")
    inside = graph.where("node < other")
    for end in ("node", "other"):
        to = comm.select(F.col("node").alias(end), F.col("comm").alias(f"_{end}"))
        inside = spread_join(cut(inside, "inside"), to, end)
    pieces = connected_components(inside.where("_node = _other"), part, "node", "other")
    ranked = pieces.join(part, "node")
    order = cut(numbered(ranked.select("partition", "component").distinct(), ["partition", "component"], "place"), "clusters")
    first = order.groupBy("partition").agg(F.min("place").alias("first"))
    order = order.join(first, "partition").select("component", (F.col("place") - F.col("first")).cast("int").alias("cluster"))
    ranked = cut(ranked.select("name", "partition", "component"), "ranked")
    return spread_join(ranked, order, "component").select(F.col("name").alias("node"), "partition", "cluster")


def communities(
    edges: DataFrame, nodes: DataFrame, gamma: float | DataFrame = 1.0, partition: DataFrame | None = None, start: DataFrame | None = None, how: Search | None = None, turns: Turns | None = None
) -> DataFrame:
    """node, cluster (and partition): communities at resolution gamma.

    Rounds of synchronous moves by the active nodes of alternating halves; a level ends when no node is active (or few
    move, see ``Search``). Communities are then refined into well-linked parts, the parts become the next level's nodes,
    which begin in their communities, and so on until nothing moves; last, single nodes move until none is active (with
    ``surely``: until none gains by moving), unless ``last`` rounds end it. Each community is cut into its connected parts; ids are given by
    the smallest node. Every node is assigned, isolated ones alone; results don't depend on how the data is partitioned.

    ``partition`` (node, partition) keeps apart groups that advance in the same jobs; ``gamma`` may then be a table
    (partition, gamma). ``start`` (node, cluster) is where the search begins, by default each node alone.
    """
    how, turns = how or Search(), turns or Turns()
    turns.first = None
    part, graph = _numbered_graph(edges, nodes, partition)
    gammas = part.select("partition").distinct()
    gammas = gammas.withColumn("gamma", F.lit(float(gamma))) if not isinstance(gamma, DataFrame) else gammas.join(gamma, "partition")
    own = None
    if start is not None:
        named = part.join(start.select(F.col("node").alias("name"), F.col("cluster").alias("_c")), "name")
        least = named.groupBy("partition", "_c").agg(F.min("node").alias("comm"))
        own = cut(spread_join(cut(named, "start"), least, ["partition", "_c"]).select("node", "comm"), "start")
    found = _search(graph, part, gammas, own, how, turns)
    out = _finished(graph, part, found, how, turns.first and turns.first[0])
    return out if partition is not None else out.drop("partition")


def communities_targeted(edges: DataFrame, nodes: DataFrame, targets: int | DataFrame, partition: DataFrame | None = None, low: float = 0.01, high: float = 10.0, rounds: int = 5, within: int = 2, warm: bool = True, how: Search | None = None, turns: Turns | None = None) -> DataFrame:
    """Communities with about the target count (G3): bisection of the resolution in [low, high], at most
    ``rounds`` rounds, until the count is ``within`` of the target; the first closest result is kept.

    ``targets``: a number, or (partition, target). A target of at most 1 puts all nodes into cluster 0. All partitions
    advance in the same jobs; their bounds are columns. ``warm``: a search begins with the communities that were found
    at the nearest resolution so far, which merge at a lower one and split at a higher one, and not with single nodes.
    ``how`` bounds each search.
    """
    how, turns = how or STEP, turns or Turns()
    turns.first = None
    own, graph = _numbered_graph(edges, nodes, nodes.select("node", F.lit("__all__").alias("partition")) if partition is None else partition)
    goals = own.select("partition").distinct()
    goals = goals.withColumn("target", F.lit(targets)) if not isinstance(targets, DataFrame) else goals.join(targets.select("partition", "target"), "partition")
    open_ = cut(goals.where("target > 1").withColumn("low", F.lit(low)).withColumn("high", F.lit(high)).withColumn("gamma", (F.col("low") + F.col("high")) / 2), "bounds")
    of = own.select("node", "partition")
    best = cut(of.join(goals.where("target <= 1"), "partition").select("node", "partition", F.lit(0).cast("long").alias("comm"), F.lit(0).alias("away")), "best")
    near = None  # node, comm: what was found at the nearest resolution
    for _ in range(rounds):
        if open_.isEmpty():
            break
        part = cut(own.join(open_.select("partition"), "partition", "left_semi"), "open")
        inside = graph.join(part.select("node"), "node", "left_semi")
        start = near.join(part.select("node"), "node", "left_semi") if warm and near is not None else None
        found = _search(cut(inside, "graph"), part, open_.select("partition", "gamma"), start, how, turns)
        found = cut(found.join(of, "node"), "found")
        counts = found.groupBy("partition").agg(F.countDistinct("comm").alias("n"))
        rows = cut(open_.join(counts, "partition").withColumn("away", F.abs(F.col("n") - F.col("target")).cast("int")), "bounds")
        held = best.groupBy("partition").agg(F.min("away").alias("held"))
        better = rows.join(held, "partition", "left").where("held is null or away < held").select("partition", "away")
        best = cut(best.join(better, "partition", "left_anti").unionByName(found.join(better, "partition").select("node", "partition", "comm", "away")), "best")
        # The next resolution lies half a bound from this one, which is the nearest of all that were tried.
        near = found.select("node", "comm")
        few = F.col("n") < F.col("target")
        bounds = rows.where(F.col("away") > within).select("partition", "target", F.when(few, F.col("gamma")).otherwise(F.col("low")).alias("low"), F.when(few, F.col("high")).otherwise(F.col("gamma")).alias("high"))
        open_ = cut(bounds.withColumn("gamma", (F.col("low") + F.col("high")) / 2), "bounds")
    one = cut(best.join(goals.where("target <= 1").select("partition"), "partition", "left_semi"), "ones")
    rest = best.join(goals.where("target > 1").select("partition"), "partition", "left_semi")
    out = _finished(graph, own.join(rest.select("node"), "node", "left_semi"), cut(rest, "rest").select("node", "comm"), how)
    out = cut(out.unionByName(own.join(one.select("node"), "node").select(F.col("name").alias("node"), "partition", F.lit(0).alias("cluster"))), "found")
    return out.select("node", *(["partition"] if partition is not None else []), "cluster")


def merge_small_clusters(assign: DataFrame, target: int, factor: int = 3) -> DataFrame:
    """node, cluster with at most ``target`` clusters, where there were more than ``factor`` * target.

    The largest ``target`` clusters stay (ties by id). Every other joins the kept one whose directory
    prefixes are most alike (Jaccard; ties to the smaller, then the lower id); one that shares none joins the
    smallest kept one. One relational pass.
    """
    sizes = cut(assign.groupBy("cluster").agg(F.count("*").alias("n")), "sizes")
    kept = sizes.orderBy(F.desc("n"), "cluster").limit(target)
    rest = sizes.join(F.broadcast(kept.select("cluster")), "cluster", "left_anti").join(F.broadcast(sizes.agg(F.count("*").alias("count"))))
    prefixes = with_sim_prefix(assign, "node").where("sim_prefix is not null").select("cluster", "sim_prefix").distinct()
    n_prefix = prefixes.groupBy("cluster").agg(F.count("*").alias("p"))
    mine = prefixes.join(rest.select("cluster"), "cluster", "left_semi").withColumnRenamed("cluster", "small")
    theirs = prefixes.join(kept.select("cluster", "n"), "cluster")
    shared = mine.join(theirs, "sim_prefix").groupBy("small", "cluster", "n").agg(F.count("*").alias("both"))
    alike = shared.join(n_prefix, "cluster").join(n_prefix.select(F.col("cluster").alias("small"), F.col("p").alias("q")), "small").withColumn("jaccard", F.col("both") / (F.col("p") + F.col("q") - F.col("both")))
    best = alike.groupBy("small").agg(F.min_by("cluster", F.struct((-F.col("jaccard")).alias("j"), "n", "cluster")).alias("best"))
    smallest = kept.agg(F.min_by("cluster", F.struct("n", "cluster")).alias("least"))
    to = rest.select(F.col("cluster").alias("small"), "count").join(best, "small", "left").join(F.broadcast(smallest))
    to = to.where(F.col("count") > factor * target).select(F.col("small").alias("cluster"), F.coalesce("best", "least").alias("_to"))
    return assign.join(to, "cluster", "left").select(*(c for c in assign.columns if c != "cluster"), F.coalesce("_to", "cluster").alias("cluster"))


def redistribute(assign: DataFrame, call_edges: DataFrame, own_below: float = 0.4, other_from: float = 0.6) -> DataFrame:
    """node, cluster after files move to the cluster that most of their calls go to (A13): if under
    ``own_below`` of a file's calls stay in its cluster and at least ``other_from`` go to one other. All
    moves are made from the same old state; of equal clusters the smallest id. ``call_edges``: src, dst, cnt."""
    pairs = call_edges.select("cnt", F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))).alias("e")).select("e.node", "e.other", "cnt")
    to = assign.select(F.col("node").alias("other"), F.col("cluster").alias("to"))
    own = assign.select("node", "cluster")
    sums = pairs.join(to, "other").join(own, "node").groupBy("node", "cluster", "to").agg(F.sum("cnt").alias("k"))
    mine = F.col("to") == F.col("cluster")
    shares = sums.groupBy("node", "cluster").agg(
        F.sum("k").alias("total"), F.sum(F.when(mine, F.col("k")).otherwise(0)).alias("own"), F.min(F.when(~mine, F.struct((-F.col("k")).alias("k"), "to"))).alias("best")
    )
    moves = shares.where((F.col("own") / F.col("total") < own_below) & (-F.col("best.k") / F.col("total") >= other_from)).select("node", F.col("best.to").alias("_to"))
    return assign.join(moves, "node", "left").select(*(c for c in assign.columns if c != "cluster"), F.coalesce("_to", "cluster").alias("cluster"))
