"""Rounds of community moves on graphs whose nodes fit a broadcast: links stay packed in tasks, a row a node goes around."""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.sources.scratch import cut

_CHOICE = "at long, to long, flag boolean, value double"
_LINKS = ("node", "other", "weight")
Arrays = tuple[np.ndarray, ...]


def packed(links: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """Arrays of links (node, other, weight), all links of a node in one row, each node with an empty one to itself."""
    rows = links.select(*_LINKS).unionByName(nodes.select("node", F.col("node").alias("other"), F.lit(0.0).alias("weight")))
    return _dealt(rows, n)


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """Links of ``n`` nodes in rows of about 256 nodes, in order; equal ends are one link."""
    buckets = max(8, min(4096, n // 256))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("node", F.lit(17)), F.lit(buckets))).repartition(buckets, "bucket")
    rows = rows.groupBy("bucket", "node", "other").agg(F.sum("weight").alias("weight"))
    rows = rows.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct(*_LINKS))).alias("links"))
    return cut(rows.select("bucket", *(F.col(f"links.{c}").alias(c) for c in _LINKS)), "packed")


def _ends(batch: pa.RecordBatch, ids: np.ndarray | None) -> Arrays:
    """Both ends, as places among ``ids`` (None: they are places), and weight of a batch's links."""
    node, other, weight = (batch.column(c).flatten().to_numpy() for c in _LINKS)
    if ids is None:
        return node, other, weight
    whole = len(ids) and ids[-1] - ids[0] == len(ids) - 1
    return *((x - ids[0] if whole else np.searchsorted(ids, x)) for x in (node, other)), weight


def _merged(links: DataFrame, ids: np.ndarray | None, to: np.ndarray, n: int) -> DataFrame:
    """``packed`` links between the ``n`` places that ``to`` gives for each place; those inside one weigh nothing, and both
    places of a link are below 0 if it drops out."""
    sent = links.sparkSession.sparkContext.broadcast((ids, to))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, to = sent.value
        for batch in batches:
            node, other, weight = _ends(batch, ids)
            node, other = to[node], to[other]
            held = node >= 0
            node, other, weight = node[held], other[held], np.where(node == other, 0.0, weight)[held]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _summed(node, other, weight, weight)[:3]], list(_LINKS))

    out = _dealt(links.select(*_LINKS).mapInArrow(run, "node long, other long, weight double"), n)
    sent.unpersist()
    return out


def _asked(links: DataFrame | Arrays, choose: Callable[..., tuple], facts: dict, named: bool) -> Arrays:
    """at, to, flag, value that ``choose`` gives for (ends of links as places, weights, facts) of each batch, or of the links
    that are held here. ``named``: the ends of packed links are ids and not places."""
    if isinstance(links, tuple):
        return choose(*links, facts)
    sent = links.sparkSession.sparkContext.broadcast(facts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            at, to, flag, value = choose(*_ends(batch, own["ids"] if named else None), own)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(to, pa.int64()), pa.array(flag, pa.bool_()), pa.array(value, pa.float64())], ["at", "to", "flag", "value"])

    out = links.select(*_LINKS).mapInArrow(run, _CHOICE).toArrow()
    sent.unpersist()
    return tuple(out[c].to_numpy() for c in ("at", "to", "flag", "value"))


def _summed(node: np.ndarray, to: np.ndarray, weight: np.ndarray, tot: np.ndarray) -> Arrays:
    """node, to, the weight between them and the strength of ``to``, one of each pair, in order."""
    if not len(node):
        return node, to, weight, tot
    low = to.min()
    order = np.argsort(node * (to.max() - low + 1) + (to - low), kind="stable")
    node, to = node[order], to[order]
    first = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (to[1:] != to[:-1])])
    return node[first], to[first], np.add.reduceat(weight[order], first), tot[order[first]]


def _first(node: np.ndarray, loss: np.ndarray, to: np.ndarray) -> Arrays:
    """node, loss, to: the least (loss, to) of each node; ``node`` is in order."""
    if not len(node):
        return node, loss, to
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    least = np.minimum.reduceat(loss, first)
    held = np.repeat(least, np.diff(np.r_[first, len(node)]))
    return node[first], least, np.minimum.reduceat(np.where(loss == held, to, np.iinfo(np.int64).max), first)


def _move(node: np.ndarray, other: np.ndarray, weight: np.ndarray, of: dict) -> tuple:
    """The active nodes with where they go; flagged if it isn't their turn. See ``cluster._round``."""
    active = of["waiting"].copy()
    active[node[of["moved"][other] & (node != other)]] = True
    here = np.unique(node)
    here = here[active[here]]
    mine = of["half"][here]
    late, movers = here[~mine], here[mine]
    turn = np.zeros(len(active), bool)
    turn[movers] = True
    link = turn[node]
    node, other, weight = node[link], other[link], weight[link]
    at, to, inside, tot = _summed(node, of["comm"][other], weight, of["tot"][other])
    k, stays = of["k"][at], to == of["comm"][at]
    gain = inside - of["rate"][at] * k * (tot - np.where(stays, k, 0.0))
    loss = np.round(-np.where(stays, gain + 1e-9 * (1 + np.abs(gain)), gain), 9) + 0.0
    at, loss, to = _first(at, loss, to)  # all movers: each has a link to itself
    alone = -(of["ids"][at] * 8 + of["turn"])
    to = np.where((loss > 0) | ((loss == 0) & (alone < to)), alone, to)
    return np.r_[at, late], np.r_[to, of["comm"][late]], np.r_[np.zeros(len(at), bool), np.ones(len(late), bool)], np.zeros(len(at) + len(late))


def _held(node: np.ndarray, other: np.ndarray, weight: np.ndarray, of: dict) -> tuple:
    """The nodes that have links into their own community, with the weight of these."""
    inside = (of["comm"][node] == of["comm"][other]) & (node != other)
    node, weight = node[inside], weight[inside]
    at, _, held, _ = _summed(node, node, weight, weight)
    return at, at, np.ones(len(at), bool), held


def _join(node: np.ndarray, other: np.ndarray, weight: np.ndarray, of: dict) -> tuple:
    """The nodes that leave being alone, with the part of their community that they join. See ``cluster._refine``."""
    link = of["leaves"][node] & ~of["leaves"][other] & (of["comm"][node] == of["comm"][other]) & (node != other)
    node, other, weight = node[link], other[link], weight[link]
    at, to, inside, tot = _summed(node, of["part"][other], weight, of["tot"][other])
    gain = np.round(inside - of["rate"][at] * of["k"][at] * tot, 9)
    at, to, gain = at[gain > 0], to[gain > 0], gain[gain > 0]
    at, loss, to = _first(at, -gain, to)
    return at, to, np.ones(len(at), bool), -loss


def _least(node: np.ndarray, other: np.ndarray, weight: np.ndarray, of: dict) -> tuple:
    """The nodes with a neighbour of their community in a piece that begins earlier, with the first such piece."""
    near = (of["comm"][node] == of["comm"][other]) & (of["piece"][other] < of["piece"][node])
    node, to, weight, _ = _summed(node[near], of["piece"][other[near]], weight[near], weight[near])
    node, loss, to = _first(node, np.zeros(len(node)), to)
    return node, to, np.ones(len(node), bool), loss


class Nodes:
    """A level's nodes as columns in the order of their numbers (``ids``): at most ``Search.small`` of them."""

    def __init__(self, links: DataFrame, state: DataFrame):
        """``state``: node, comm, k, rate."""
        halves = [F.pmod(F.xxhash64("node", F.lit(i)), F.lit(2)).cast("int").alias(f"half{i}") for i in range(4)]
        rows = state.select("node", "comm", "k", "rate", *halves).toArrow().sort_by("node")
        self.links, self.spark, self.named = links, state.sparkSession, True
        self.ids, self.comm, self.k, self.rate = (rows[c].to_numpy().copy() for c in ("node", "comm", "k", "rate"))
        self.halves = [rows[f"half{i}"].to_numpy().astype(np.int8) for i in range(4)]
        self.again()

    def again(self, comm: np.ndarray | None = None) -> Nodes:
        """All nodes wait for their turn, in the communities ``comm``."""
        self.comm = self.comm if comm is None else comm
        self.waiting, self.moved = np.ones(len(self.ids), bool), np.zeros(len(self.ids), bool)
        return self

    def merged(self, part: np.ndarray, held: int) -> tuple[Nodes, np.ndarray]:
        """The parts as nodes, each in the community that it was in, and the place of each node's part. Up to ``held`` links
        are held here from now on, and a round takes no job."""
        ids, first, to = np.unique(part, return_index=True, return_inverse=True)
        at = np.searchsorted(self.ids, ids)
        new = object.__new__(Nodes)
        new.spark, new.named, new.ids, new.k = self.spark, False, ids, np.bincount(to, self.k)
        new.comm, new.rate, new.halves = self.comm[first], self.rate[first], [x[at] for x in self.halves]
        if isinstance(self.links, tuple):
            node, other, weight = to[self.links[0]], to[self.links[1]], self.links[2]
            weight = np.where(node == other, 0.0, weight)
            new.links = _summed(node, other, weight, weight)[:3]
        else:
            new.links = _merged(self.links, self.ids if self.named else None, to, len(ids))
            if (new.links.agg(F.sum(F.size("node"))).first()[0] or 0) <= held:
                rows = new.links.select(*_LINKS).toArrow().combine_chunks()
                node, other, weight = (pa.concat_arrays(rows[c].chunks).flatten().to_numpy() for c in _LINKS)
                new.links = _summed(node, other, weight, weight)[:3]
        return new.again(), to

    def only(self, held: np.ndarray, comm: np.ndarray, rate: np.ndarray) -> Nodes:
        """The nodes that are ``held`` (whole partitions), in the communities ``comm``, with ``rate``, as a level of its own."""
        new = copy.copy(self)
        if not held.all():
            to = np.where(held, np.cumsum(held) - 1, -1)
            new.links, new.named = _merged(self.links, self.ids if self.named else None, to, int(held.sum())), False
            new.ids, new.k, new.halves = self.ids[held], self.k[held], [x[held] for x in self.halves]
        new.rate = rate[held]
        return new.again(comm[held])

    def asked(self, choose: Callable[..., tuple], facts: dict) -> Arrays:
        return _asked(self.links, choose, facts, self.named)

    def settle(self, turns: list[int], rounds: int, tolerance: float, surely: bool = False) -> int:
        """Rounds until no node is active, or few move; how many moved. See ``cluster._settle``. After 16 rounds those with
        ``surely`` only make moves that don't touch each other: each raises the quality, so they end."""
        total, last, since, n = 0, None, 0, len(self.ids)
        for i in range(rounds):
            moved, open_ = self.round(len(turns), last is None or last > n / 8, surely and i >= 16)
            turns.append(moved)
            total, since = total + moved, since + moved
            if not open_:
                if not surely or not since:
                    break
                self.waiting[:], since = True, 0
            elif last is not None and tolerance and max(moved, last) <= tolerance * n:
                break
            last = moved
        return total

    def pieces(self) -> np.ndarray:
        """The first place that each node reaches inside its community."""
        piece = np.arange(len(self.ids))
        while True:
            at, to, _, _ = self.asked(_least, dict(ids=self.ids, comm=self.comm, piece=piece))
            if not len(at):
                return piece
            np.minimum.at(piece, piece[at], to)
            while not np.array_equal(piece, up := piece[piece]):
                piece = up

    def totals(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Strength and number of the nodes with the same value, for each node."""
        _, code = np.unique(of, return_inverse=True)
        return np.bincount(code, self.k)[code], np.bincount(code)[code]

    def half(self, turn: int) -> np.ndarray:
        return self.halves[turn // 2 % 4] == turn % 2

    def round(self, turn: int, many: bool, apart: bool = False) -> tuple[int, int]:
        """A round of moves; how many moved, and how many moved or still wait for their turn. ``apart``: only moves that no
        other of the round touches, so that together they gain what each gains; the others wait."""
        facts = dict(ids=self.ids, comm=self.comm, k=self.k, rate=self.rate, tot=self.totals(self.comm)[0], moved=self.moved, half=self.half(turn), turn=turn % 8)
        at, to, late, _ = self.asked(_move, facts | dict(waiting=np.ones_like(self.waiting) if many else self.waiting))
        self.waiting = np.zeros_like(self.waiting)
        self.waiting[at[late]] = True
        if apart:
            new = to != self.comm[at]
            ends, to = np.unique(np.r_[self.comm[at], to], return_inverse=True)
            was, to = to[: len(at)], to[len(at) :]
            least = np.full(len(ends), len(self.ids))
            for end in (was, to):
                np.minimum.at(least, end[new], at[new])
            waits = new & ((least[was] < at) | (least[to] < at))
            self.waiting[at[waits]] = True
            to = ends[np.where(waits, was, to)]
        comm = self.comm.copy()
        comm[at] = to
        self.moved, self.comm = comm != self.comm, comm
        return int(self.moved.sum()), int((self.moved | self.waiting).sum())

    def refine(self, rounds: int) -> np.ndarray:
        """The part of its community that each node is in."""
        own = dict(ids=self.ids, comm=self.comm, k=self.k, rate=self.rate)
        at, _, _, inside = self.asked(_held, own)
        well = np.zeros(len(self.ids), bool)
        well[at] = inside >= self.rate[at] * self.k[at] * (self.totals(self.comm)[0][at] - self.k[at])
        part = self.ids.copy()
        for turn in range(rounds):
            tot, n = self.totals(part)
            at, to, _, _ = self.asked(_join, own | dict(part=part, tot=tot, leaves=(n == 1) & well & self.half(turn)))
            part[at] = to
            if not len(at) and turn:
                break
        return part

    def table(self, **columns: np.ndarray) -> DataFrame:
        return cut(self.spark.createDataFrame(pa.table({"node": self.ids, **columns})), "state")
