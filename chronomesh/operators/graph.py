"""Road graphs: construction, congestion, shortest paths, strong components, path costs."""

from __future__ import annotations

import math
from collections import defaultdict
from copy import copy

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import directions, drivable, edge_seconds, flat_km, haversine_m, maxspeed_mph
from . import spatial
from .shared import forget, settle

#: Edges of a graph that one task may hold, some 100 MB of arrays; larger graphs go by rounds of joins, with equal results.
KERNEL_EDGES = 2_000_000
#: The same for single ways, whose searches see a small part of the graph: some 40 bytes an edge and 150 a node.
ROUTE_EDGES = 32_000_000
#: The same for matrices and distances alone, of which tasks hold some 20 bytes an edge, and the room of LANES_MB.
MATRIX_EDGES = 32_000_000
#: Edges of a graph up to which it is sent to four tasks a core instead of one, so that the cores end together.
SMALL_EDGES = 500_000
#: Searches that go side by side, the megabytes of their distances, nodes that are taken up at a time, and how often each may be before they part.
LANES, LANES_MB, LANE_NODES, LANE_TURNS = 128, 320, 1 << 14, 64
#: Graphs of more edges, and of more a node, are thinned before they are searched from many nodes; the least edges of a node that do it.
THIN_EDGES, DENSE, SHORT = 1_000_000, 32, 8
#: Far nodes whose distances bound those of others; targets of one source up to which each has a search of its own, and nodes of a graph that allow one more.
LANDMARKS, ALONE, ALONE_NODES = 6, 4, 2_000
#: Ways that a task hands on at a time.
ROUTES_A_BATCH = 256
#: Edges of a part of a graph whose strong components are sought, parts at most, and what a graph has shrunk by to be treated so again.
PART_EDGES, MOST_PARTS, SHRUNK = 1 << 15, 10_000, 0.7
#: Tables of improved labels that are merged into one once there are so many.
DELTAS = 8
WALK_MS = 1.35


def way_segments(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way, pos, a, b, highway, maxspeed, oneway, metres): neighbouring nodes of drivable ways whose places are known."""
    n = F.col("nodes")
    pairs = F.when(F.size(n) > 1, F.transform(F.sequence(F.lit(1), F.size(n) - 1), lambda i: F.struct(i.alias("pos"), F.get(n, i - 1).alias("a"), F.get(n, i).alias("b"))))
    seg = ways.where(drivable(F.col("highway"))).select("way", "highway", "maxspeed", "oneway", F.inline(pairs))
    at = lambda x: nodes.select(F.col("id").alias(x), F.col("lat").alias(f"{x}_lat"), F.col("lng").alias(f"{x}_lng"))
    return seg.join(at("a"), "a").join(at("b"), "b").withColumn("metres", haversine_m(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng")))


def road_edges(segments: DataFrame) -> DataFrame:
    """(src, dst, seconds, metres, way) with parallel edges kept; seconds null where the speed is zero."""
    way = F.explode(directions(F.col("oneway"), F.col("highway")))
    mph = maxspeed_mph(F.col("maxspeed"), F.col("highway"))
    e = segments.withColumn("dir", way)
    return e.select(
        F.when(F.col("dir") > 0, F.col("a")).otherwise(F.col("b")).alias("src"),
        F.when(F.col("dir") > 0, F.col("b")).otherwise(F.col("a")).alias("dst"),
        edge_seconds(F.col("metres"), mph).alias("seconds"),
        "metres",
        "way",
    )


def local_nodes(segments: DataFrame) -> DataFrame:
    """(node, local): whether a road that is no motorway touches it."""
    plain = ~F.col("highway").isin("motorway", "motorway_link")
    return segments.select(F.explode(F.array("a", "b")).alias("node"), plain.alias("p")).groupBy("node").agg(F.bool_or("p").alias("local"))


def apply_traffic(edges: DataFrame, nodes: DataFrame, readings: DataFrame, km: float = 1.5, k: int = 4) -> DataFrame:
    """edges with column factor: the mean of the k nearest readings around an edge's middle, 1 where there is none.

    Edges with one middle share one lookup.
    """
    at = lambda x, y: nodes.select(F.col("id").alias(x), F.col("lat").alias(f"{y}1"), F.col("lng").alias(f"{y}2"))
    placed = edges.join(at("src", "s"), "src").join(at("dst", "t"), "dst").withColumns({"lat": (F.col("s1") + F.col("t1")) / 2, "lng": (F.col("s2") + F.col("t2")) / 2})
    around = readings.select(F.col("reading").alias("node"), "r_lat", "r_lng", "factor")
    mean = spatial.nearest_places(placed, around, k, flat_km, **spatial.within_km(km), give=lambda best: spatial.weighted_best(best, {"factor": lambda n: n["factor"]}, 1e-6))
    return placed.join(mean, ["lat", "lng"], "left").select(*edges.columns, F.coalesce("best.factor", F.lit(1.0)).alias("factor"))


def walk_edges(segments: DataFrame) -> DataFrame:
    """(src, dst, seconds): every road edge, motorways too, both ways on foot."""
    one = road_edges(segments).select("src", "dst").join(segments.select(F.col("a").alias("src"), F.col("b").alias("dst"), "a_lat", "a_lng", "b_lat", "b_lng").unionByName(segments.select(F.col("b").alias("src"), F.col("a").alias("dst"), F.col("b_lat").alias("a_lat"), F.col("b_lng").alias("a_lng"), F.col("a_lat").alias("b_lat"), F.col("a_lng").alias("b_lng"))).distinct(), ["src", "dst"])
    sec = flat_km(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng")) * 1000 / WALK_MS
    e = one.select("src", "dst", sec.alias("seconds"))
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "seconds"))


def least_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, w) without parallel and undrivable edges and loops."""
    return edges.where("w is not null and src <> dst").groupBy("src", "dst").agg(F.min("w").alias("w"))


def once(nodes: np.ndarray, seat: np.ndarray) -> np.ndarray:
    """Each of some nodes once; seat is room for a number a node."""
    places = np.arange(len(nodes))
    seat[nodes] = places
    return nodes[seat[nodes] == places]


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in four bytes each if they fit."""
    return x.astype(np.int32) if x.dtype.kind == "i" and (not len(x) or (x.min() >= -(1 << 31) and x.max() < 1 << 31)) else x


class Arrays:
    """A graph as arrays: nodes in order, and the edges of each by index. edges are a frame, or an array of each column."""

    def __init__(self, edges: DataFrame | dict[str, np.ndarray]):
        if not isinstance(edges, dict):
            flat = edges.toArrow()
            edges = {c: flat.column(c).to_numpy() for c in ("src", "dst", "w")}
        src, dst, w = (edges[c] for c in ("src", "dst", "w"))
        self.nodes = np.union1d(np.unique(src), np.unique(dst)).astype(np.int64)
        order = np.argsort(src, kind="stable")
        self.src, self.dst = (np.searchsorted(self.nodes, x[order]).astype(np.int32) for x in (src, dst))
        self.w = narrow(w[order])
        self.first = np.searchsorted(self.src, np.arange(len(self.nodes) + 1))
        self.whole = self.w.dtype.kind == "i"
        self.none = np.iinfo(np.int64).max // 4 if self.whole else np.inf
        self.step = max(1, int(8 * self.w.mean())) if len(self.w) else 1  # wide buckets have many nodes to relax side by side
        self.into = np.argsort(self.dst, kind="stable").astype(np.int32)  # edges by their ends, for walks back
        self.last = np.searchsorted(self.dst[self.into], np.arange(len(self.nodes) + 1))
        self.away = self.back = np.empty((len(self.nodes), 0))  # of each node, the distances from far nodes, and to them
        self.room = None

    def turned(self) -> Arrays:
        """The same nodes with all edges the other way."""
        back = copy(self)
        back.src, back.dst, back.w, back.first = self.dst[self.into], self.src[self.into], self.w[self.into], self.last
        return back

    def lean(self) -> Arrays:
        """What a search from one end needs, and nothing else."""
        few = copy(self)
        few.src = few.into = few.last = few.away = few.back = None
        return few

    def with_landmarks(self, number: int = LANDMARKS) -> Arrays:
        """Also the distances from and to a few nodes, each as far as can be from those before it."""
        away, back = [], []
        if len(self.nodes):
            turned, far, at = self.turned(), np.full(len(self.nodes), self.none), 0
            for k in range(number + 1):
                own = self.distances(at)
                far = np.minimum(far, np.where(own < self.none, own, -1))
                if k:  # the first node is anywhere
                    away.append(own), back.append(turned.distances(at))
                at = int(far.argmax())
            self.away, self.back = np.stack(away, axis=1), np.stack(back, axis=1)
        return self

    def least_to(self, nodes: np.ndarray, target: int) -> np.ndarray:
        """A lower bound of the way from each node to the target by the triangle with each landmark; none if there is no way.

        What a landmark reaches has no way to what it doesn't, and likewise for those that reach it; then a gap is about `none`.
        """
        best = np.zeros(len(nodes))
        if self.away.shape[1] and len(nodes):
            with np.errstate(invalid="ignore"):  # none less none tells nothing
                gaps = np.fmax(self.away[target] - self.away[nodes], self.back[nodes] - self.back[target])
            best = np.fmax(np.fmax.reduce(gaps, axis=1), 0)
        best = np.where(best > self.none / 2, self.none, best)
        return best.astype(np.int64) if self.whole else best * (1 - 1e-9)  # sums of doubles are not exact

    def place(self, nodes: np.ndarray) -> np.ndarray:
        """Index of each node, -1 for those without an edge."""
        at = np.minimum(np.searchsorted(self.nodes, nodes), max(0, len(self.nodes) - 1))
        return np.where(self.nodes[at] == nodes, at, -1) if len(self.nodes) else np.full(len(nodes), -1)

    def out(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges that leave some nodes, and the place of each edge's node among them."""
        count = self.first[nodes + 1] - self.first[nodes]
        at = np.repeat(np.arange(len(nodes)), count)
        return np.repeat(self.first[nodes] - np.cumsum(count) + count, count) + np.arange(count.sum()), at

    def distances(self, source: int, cutoff: float | None = None, goals: np.ndarray | None = None) -> np.ndarray:
        """Distance of each node, `none` where there is no way: buckets of distances are settled one after another, the nodes of one side by side.

        With goals, the search ends when all of them are settled; of other nodes only those no farther than the farthest goal are exact then.
        """
        dist = np.full(len(self.nodes), self.none)
        dist[source] = 0
        seat = np.empty(len(self.nodes), np.int64)
        now, later, upto = np.array([source]), [], self.step
        while True:
            while len(now):
                now, far = self.relaxed(dist, seat, now, lambda nodes, upto=upto: dist[nodes] < upto, cutoff)
                later.append(far)
            if goals is not None and (dist[goals] < upto).all():
                return dist
            far = np.concatenate(later) if later else now
            far = once(far[dist[far] >= upto], seat)
            if not len(far):
                return dist
            upto = int(dist[far].min()) + self.step
            near = dist[far] < upto
            now, later = far[near], [far[~near]]

    def relaxed(self, dist: np.ndarray, seat: np.ndarray, now: np.ndarray, near, cutoff: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Relax the edges that leave some nodes; what is improved, apart by whether it is near."""
        e, at = self.out(now)
        reach, to = dist[now][at] + self.w[e], self.dst[e]
        better = reach < dist[to] if cutoff is None else (reach < dist[to]) & (reach <= cutoff)
        reach, to = reach[better], to[better]
        np.minimum.at(dist, to, reach)
        to = once(to, seat)
        close = near(to)
        return to[close], to[~close]

    def cleared(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list, list]:
        """Arrays of a node each for a search from both ends, kept from one search to the next: only what the last one touched is cleared."""
        if self.room is None:
            n = len(self.nodes)
            self.room = (np.full(n, self.none), np.full(n, self.none), np.full(n, -1, np.int64 if self.whole else np.float64), np.empty(n, np.int64), [], [])
            self.flip = self.turned()
        dist, behind, bound, _, ahead, before = self.room
        for nodes in ahead:
            dist[nodes], bound[nodes] = self.none, -1
        for nodes in before:
            behind[nodes] = self.none
        ahead.clear(), before.clear()
        return self.room

    def around(self, target: int, behind: np.ndarray, seat: np.ndarray, touched: list) -> float:
        """Distances to the target of a few nodes nearest to it, some root of all; nodes not among them are at least as far as the number returned."""
        enough, step = 2 * math.isqrt(len(self.nodes)), max(1, self.step // 16)
        behind[target] = 0
        touched.append(np.array([target]))
        now, later, upto, count = touched[0], [], step, 1
        while True:
            while len(now):
                now, far = self.flip.relaxed(behind, seat, now, lambda nodes, upto=upto: behind[nodes] < upto)
                later.append(far), touched.append(now), touched.append(far)
                count += len(now)
            far = once(np.concatenate(later), seat)
            far = far[behind[far] >= upto]
            if not len(far):
                return self.none
            if count >= enough:
                return upto if self.whole else upto * (1 - 1e-9)
            upto = int(behind[far].min()) + step
            near = behind[far] < upto
            now, later = far[near], [far[~near]]
            count += len(now)

    def toward(self, source: int, target: int) -> tuple[np.ndarray, int]:
        """Distances of a search that is drawn to one target, exact on all shortest ways to it, and how many nodes it has relaxed; good until the next search.

        A node's lower bound is by landmarks, and by a few nodes around the target whose ways to it are known. Buckets are of a
        node's distance and its lower bound together; the search ends when no open node can lead to a shorter way.
        """
        dist, behind, bound, seat, touched, before = self.cleared()
        touched.append(np.array([source, target]))
        dist[source] = 0
        rim = self.around(target, behind, seat, before)
        slack = 1 if self.whole else 1 - 1e-9

        def total(nodes: np.ndarray) -> np.ndarray:
            new = nodes[bound[nodes] < 0]
            own = behind[new]
            bound[new] = np.maximum(self.least_to(new, target), np.where(own < rim, own * slack, rim))
            return dist[nodes] + bound[nodes]

        now, later, count = np.array([source]), [], 0
        first = total(now)[0]
        if first >= self.none:
            return dist, 0
        step = self.step / 8  # few nodes lie off the way if bounds are good
        upto = first + step
        while True:
            while len(now):
                count += len(now)
                now, far = self.relaxed(dist, seat, now, lambda nodes, upto=upto: total(nodes) < upto)
                later.append(far), touched.append(now), touched.append(far)
            far = once(np.concatenate(later), seat)
            sums = total(far)
            fine = (sums >= upto) & (sums < self.none) & (sums <= dist[target] * (1 if self.whole else 1 + 1e-9))
            far, sums = far[fine], sums[fine]
            if not len(far):
                return dist, count
            upto = sums.min() + step
            near = sums < upto
            now, later = far[near], [far[~near]]

    def way(self, source: int, target: int, dist: np.ndarray) -> list[int]:
        """Nodes of the shortest way to a node that is reached, by the smallest previous node of each; distances must be exact on all shortest ways to it."""
        path = [target]
        while path[-1] != source:
            v = path[-1]
            e = self.into[self.last[v] : self.last[v + 1]]
            before, w = self.src[e], self.w[e]
            tight = (w > 0) & (dist[before] + w == dist[v])
            if not tight.any():  # edges without weight depend on more than the step before
                prev = self.previous(source, dist, dist < self.none)
                while path[-1] != source:
                    path.append(int(prev[path[-1]]))
                break
            path.append(int(before[tight].min()))
        return path[::-1]

    def previous(self, source: int, dist: np.ndarray, reached: np.ndarray) -> np.ndarray:
        """The node before each reached one on a shortest path, the smallest there is; -1 at the source and where nothing is reached."""
        tight = reached[self.src] & (dist[self.src] + self.w == dist[self.dst]) & (self.dst != source)
        src, dst, w = self.src[tight], self.dst[tight], self.w[tight]
        prev = np.full(len(self.nodes), len(self.nodes), np.int64)
        np.minimum.at(prev, dst[w > 0], src[w > 0])
        known = prev < len(self.nodes)
        known[source] = True
        while True:  # edges without weight lead on from nodes whose own way is known
            more = known[src] & ~known[dst]
            if not more.any():
                break
            np.minimum.at(prev, dst[more], src[more])
            known[dst[more]] = True
        prev[prev == len(self.nodes)] = -1
        return prev


class Lanes:
    """Searches of a graph from many sources side by side: a node's distances from all of them lie in one row of a table.

    A round takes up the nodes that an edge leads to from one whose row became smaller. Nodes are numbered by how many edges end at them, the most
    first, so that those with a further edge come first among any of them.
    """

    def __init__(self, graph: Arrays):
        n, into = len(graph.nodes), np.diff(graph.last)
        order = np.argsort(-into, kind="stable")
        self.seat = np.empty(n, np.int32)
        self.seat[order] = np.arange(n, dtype=np.int32)
        self.into = into[order]
        self.last = np.concatenate([[0], np.cumsum(self.into)])
        src, dst = self.seat[graph.src], self.seat[graph.dst]
        by_end, by_start = np.argsort(dst, kind="stable"), np.argsort(src, kind="stable")
        self.src, self.w, self.dst = src[by_end], graph.w[by_end], dst[by_start]
        self.first = np.searchsorted(src[by_start], np.arange(n + 1))
        self.most = self.w.max() if len(self.w) else 0
        self.kinds = [k for k in (np.int16, np.int32, np.int64) if self.most < np.iinfo(k).max // 2] if graph.whole else [np.float64]

    def width(self) -> int:
        """How many sources go side by side."""
        return int(min(LANES, max(8, LANES_MB * 1_000_000 // (max(1, len(self.seat)) * np.dtype(self.kinds[0]).itemsize))))

    def distances(self, sources: np.ndarray, goals: np.ndarray) -> np.ndarray | None:
        """Of each source the distances of the goals, -1 where there is no way; None if the searches have so little in common that each is faster alone."""
        got = self.table(sources)
        if got is None:
            return None
        dist, none = got
        found = dist[self.seat[goals]].T
        return np.where(found < none, found, -1) if found.dtype.kind == "f" else np.where(found < none, found, -1).astype(np.int64)

    def table(self, sources: np.ndarray) -> tuple[np.ndarray, float] | None:
        """The table of distances, a row a node by its seat, and what stands in it where there is no way."""
        while True:
            none = np.inf if self.kinds[0] is np.float64 else np.iinfo(self.kinds[0]).max - int(self.most)
            dist = self._settled(self.seat[sources], none)
            if dist is None:
                return None
            if len(self.kinds) == 1 or not ((dist < none) & (dist >= none - int(self.most))).any():  # no way is longer than the numbers go
                return dist, none
            self.kinds.pop(0)

    def _settled(self, sources: np.ndarray, none: float) -> np.ndarray | None:
        n, kind = len(self.seat), self.kinds[0]
        dist = np.full((n, len(sources)), none, kind)
        dist[sources, np.arange(len(sources))] = 0
        w, marked, now, taken = self.w.astype(kind), np.zeros(n, bool), np.unique(sources), 0
        while len(now):
            count = self.first[now + 1] - self.first[now]
            marked[self.dst[np.repeat(self.first[now] - np.cumsum(count) + count, count) + np.arange(count.sum())]] = True
            todo = np.flatnonzero(marked)
            marked[todo] = False
            taken += len(todo)
            if taken > LANE_TURNS * n:
                return None
            changed = []
            for a in range(0, len(todo), LANE_NODES):
                rows = todo[a : a + LANE_NODES]
                old, first, into = dist[rows], self.last[rows], self.into[rows]
                new = old.copy()
                for k in range(int(into[0])):
                    have = int(np.searchsorted(-into, -k))  # these have more than k edges that end at them
                    at = first[:have] + k
                    way = dist[self.src[at]]
                    way += w[at][:, None]
                    np.minimum(new[:have], way, out=new[:have])
                better = (new != old).any(axis=1)
                rows = rows[better]
                dist[rows] = new[better]
                changed.append(rows)
            now = np.concatenate(changed) if changed else now[:0]
        return dist


def tasks_of(edges: DataFrame) -> int:
    """To how many tasks a graph is sent."""
    return edges.sparkSession.sparkContext.defaultParallelism * (4 if edges.count() <= SMALL_EDGES else 1)


def beside_graph(edges: DataFrame, asked: DataFrame, task, tasks: int, search, schema: str) -> DataFrame:
    """search(edges, rows) in each task: the whole graph as an array a column, and the rows of asked that `task`, a column from 0 on, gives it as a table.

    Edges are packed by thousands and come to the tasks by a shuffle, not through the driver; a task without rows searches nothing.
    """
    ends, names = ("src", "dst", "w"), asked.columns
    whole = dict(edges.dtypes)["w"] in ("int", "bigint")
    kind = pa.int64() if whole else pa.float64()

    def pack(batches):
        for batch in batches:
            parts = [narrow(c.to_numpy()) for c in (batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int64()), batch.column(2).cast(kind))]
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], ["_n", *(f"_{c}" for c in ends)])

    def unpacked(n, data, kind):
        return np.frombuffer(data, np.int32 if len(data) == 4 * n else kind)

    def run(batches):
        kinds, parts, rows = (np.int64, np.int64, np.int64 if whole else np.float64), ([], [], []), []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            sent = table.column("_n").is_valid()
            rows.append(table.filter(pa.compute.invert(sent)).select(names))
            packed = table.filter(sent)
            count = packed.column("_n").to_pylist()
            for k, c in enumerate(ends):
                column = packed.column(f"_{c}")
                parts[k].extend(unpacked(n, x.as_buffer(), kinds[k]) for n, x in zip(count, column, strict=True))
        rows = pa.concat_tables(rows) if rows else None
        if rows is None or not rows.num_rows:
            return
        graph = {}
        for k, c in enumerate(ends):
            graph[c] = np.concatenate(parts[k]) if parts[k] else np.zeros(0, kinds[k])
            parts[k].clear()
        yield from search(graph, rows)

    packed = edges.select(*ends).mapInArrow(pack, "_n long, _src binary, _dst binary, _w binary")
    sent = packed.withColumn("_task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    own = asked.withColumn("_task", task.cast("int"))
    return sent.unionByName(own, allowMissingColumns=True).repartitionById(tasks, "_task").mapInArrow(run, schema)


def kernel_graph(edges: DataFrame, kernel: bool | None, most: int | None = None) -> tuple[DataFrame, bool]:
    """The least edges, put away, and whether one task may hold them (unless that is said)."""
    edges = settle(least_edges(edges))
    return edges, edges.count() <= (KERNEL_EDGES if most is None else most) if kernel is None else kernel


def sssp(edges: DataFrame, sources: DataFrame, cutoff: float | None = None, kernel: bool | None = None, targets: DataFrame | None = None, previous: bool = True) -> DataFrame:
    """(source, node, dist, prev) of every node a source reaches within cutoff; prev is null at the source, and everywhere if it is not asked for.

    edges are (src, dst, w) with w >= 0, sources are (source). Of equal paths the one with the
    smaller previous node counts. targets (node) are all that is wanted, if given, and a search ends with the last of them. kernel: search the graph's
    arrays for each source, which is only done up to KERNEL_EDGES, or MATRIX_EDGES if no previous nodes are asked for; otherwise rounds of joins over
    improved labels.
    """
    edges, kernel = kernel_graph(edges, kernel, KERNEL_EDGES if previous else MATRIX_EDGES)
    return _sssp_kernel(edges, sources, cutoff, targets, previous) if kernel else _sssp_rounds(edges, sources, cutoff, targets)


def _sssp_kernel(edges: DataFrame, sources: DataFrame, cutoff: float | None, targets: DataFrame | None, previous: bool) -> DataFrame:
    kind = "long" if dict(edges.dtypes)["w"] in ("int", "bigint") else "double"
    wanted = None
    if targets is not None:  # no more than the graph has nodes
        known = edges.select(F.explode(F.array("src", "dst")).alias("node"))
        wanted = np.sort(targets.select(F.col("node").cast("long")).distinct().join(known.distinct(), "node", "left_semi").toArrow().column("node").to_numpy())
    sent = edges.sparkSession.sparkContext.broadcast(wanted)

    def search(columns, rows):
        graph, only = Arrays(columns), sent.value
        if not previous:
            graph = graph.lean()
        goals = None if only is None else graph.place(only)
        ids = rows.column("source").to_numpy()
        for source, at in zip(ids.tolist(), graph.place(ids).tolist(), strict=True):
            if at < 0:  # a node without edges reaches itself
                if only is None:
                    yield pa.RecordBatch.from_arrays([pa.array([source]), pa.array([source]), pa.array([0], pa.int64() if kind == "long" else pa.float64()), pa.array([None], pa.int64())], ["source", "node", "dist", "prev"])
                continue
            dist = graph.distances(at, cutoff, goals)
            reached = dist < graph.none
            n = np.flatnonzero(reached) if goals is None else goals[reached[goals]]
            if previous:
                prev = graph.previous(at, dist, reached)[n]
                before = pa.array(graph.nodes[prev], pa.int64(), mask=prev < 0)
            else:
                before = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), source)), pa.array(graph.nodes[n]), pa.array(dist[n]), before], ["source", "node", "dist", "prev"])

    tasks = tasks_of(edges)
    spread = sources.select(F.col("source").cast("long").alias("source")).distinct()
    found = beside_graph(edges, spread, F.pmod(F.hash("source"), F.lit(tasks)), tasks, search, f"source long, node long, dist {kind}, prev long")
    if targets is None:
        return found
    alone = sources.select(F.col("source").cast("long").alias("source")).distinct().join(targets.select(F.col("node").cast("long").alias("source")).distinct(), "source", "left_semi")
    alone = alone.join(edges.select(F.explode(F.array("src", "dst")).alias("source")).distinct(), "source", "left_anti")
    return found.unionByName(alone.select("source", F.col("source").alias("node"), F.lit(0).cast(kind).alias("dist"), F.lit(None).cast("long").alias("prev")))


def _sssp_rounds(edges: DataFrame, sources: DataFrame, cutoff: float | None, targets: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """Rounds of joins: a round reads all labels and writes only those that it improves.

    If only some ends (source, target) are asked for, a source whose ends all have labels goes no farther than the largest of them.
    """
    zero = F.lit(0).cast(dict(edges.dtypes)["w"])
    start = sources.select(F.col("source").cast("long").alias("source")).distinct()
    front = settle(start.select("source", F.col("source").alias("node"), zero.alias("dist"), F.lit(None).cast("long").alias("prev")))
    key = F.struct("dist", F.coalesce("prev", F.lit(-(1 << 62))).alias("p"), "fresh")
    least = lambda rows: rows.groupBy("source", "node").agg(F.min_by(F.struct("dist", "prev", "fresh"), key).alias("b")).select("source", "node", "b.dist", "b.prev", "b.fresh")
    labels = [front]
    while not front.isEmpty():
        step = front.join(edges, F.col("node") == F.col("src")).select("source", F.col("dst").alias("node"), (F.col("dist") + F.col("w")).alias("dist"), F.col("src").alias("prev"), F.lit(1).alias("fresh"))
        if cutoff is not None:
            step = step.where(F.col("dist") <= cutoff)
        if len(labels) > DELTAS:
            merged = settle(least(_union(labels).withColumn("fresh", F.lit(0))).drop("fresh"))
            for x in labels:
                if x is not front:
                    forget(x)
            labels = [merged]
        if asked is not None:
            ends = _union(labels).groupBy("source", F.col("node").alias("target")).agg(F.min("dist").alias("end"))
            farthest = asked.join(ends, ["source", "target"], "left").groupBy("source").agg(F.max("end").alias("end"), F.count_if(F.col("end").isNull()).alias("open"))
            step = step.join(farthest, "source").where("open > 0 or dist <= end").drop("end", "open")
        front = settle(least(_union(labels).withColumn("fresh", F.lit(0)).unionByName(step)).where("fresh = 1").drop("fresh"))
        labels.append(front)
    found = least(_union(labels).withColumn("fresh", F.lit(0))).drop("fresh")
    return found if targets is None else found.join(targets.select(F.col("node").cast("long").alias("node")).distinct(), "node", "left_semi").select("source", "node", "dist", "prev")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def routes(edges: DataFrame, requests: DataFrame, kernel: bool | None = None) -> DataFrame:
    """(source, target, dist, path) for rows (source, target) whose target is reached: the nodes of the shortest path, both ends among them.

    No search settles the whole graph for one target: a source of few targets, for the graph's size, has a search for each from both ends, drawn
    by lower bounds; one of more targets a search that ends with the last of them. Rounds of joins drop labels beyond a source's farthest target.
    """
    edges, kernel = kernel_graph(edges, kernel, ROUTE_EDGES)
    asked = requests.select(F.col("source").cast("long"), F.col("target").cast("long")).distinct()
    if not kernel:
        labels = settle(_sssp_rounds(edges, asked.select("source"), None, asked=asked))
        ends = labels.select("source", F.col("node").alias("target"), "dist")
        return paths(labels, asked).join(ends, ["source", "target"]).select("source", "target", "dist", "path")
    kind = "long" if dict(edges.dtypes)["w"] in ("int", "bigint") else "double"

    def search(columns, rows):
        graph = Arrays(columns)
        alone = max(ALONE, len(graph.nodes) // ALONE_NODES)
        asked = list(zip(rows.column("source").to_pylist(), rows.column("targets").to_pylist(), strict=True))
        if sum(len(targets) for _, targets in asked if len(targets) <= alone) > 4 * LANDMARKS:  # else landmarks take longer than they save
            graph.with_landmarks()
        kinds = (pa.int64(), pa.int64(), pa.int64() if kind == "long" else pa.float64(), pa.list_(pa.int64()))
        found = []
        for source, targets in asked:
            at, ends = graph.place(np.array([source]))[0], graph.place(np.array(targets, np.int64))
            found += [(source, t, 0, [t]) for t in targets if at < 0 and t == source]
            known = [(t, end) for t, end in zip(targets, ends.tolist(), strict=True) if at >= 0 and end >= 0]
            dist = graph.distances(at, goals=np.array([end for _, end in known])) if len(known) > alone else None
            for target, end in known:
                own = graph.toward(at, end)[0] if dist is None else dist
                if own[end] < graph.none:
                    found.append((source, target, own[end].item(), graph.nodes[graph.way(at, end, own)].tolist()))
            if len(found) >= ROUTES_A_BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], ["source", "target", "dist", "path"])
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], ["source", "target", "dist", "path"])

    tasks = tasks_of(edges)
    by_source = asked.groupBy("source").agg(F.collect_list("target").alias("targets"))
    return beside_graph(edges, by_source, F.pmod(F.hash("source"), F.lit(tasks)), tasks, search, f"source long, target long, dist {kind}, path array<long>")


def paths(labels: DataFrame, targets: DataFrame, most: int = 100_000) -> DataFrame:
    """(source, target, path) for rows (source, target): nodes from source to target; no row where it isn't reached.

    A step back a round; paths of more than `most` steps are an error, not a part of the result.
    """
    walk = settle(targets.join(labels.withColumnRenamed("node", "target"), ["source", "target"]).select("source", "target", F.col("prev").alias("at"), F.array("target").alias("path")))
    back = labels.select("source", F.col("node").alias("at"), "prev")
    done = settle(walk.where("at is null").select("source", "target", "path"))
    todo, found, steps = settle(walk.where("at is not null")), [done], 0
    forget(walk)
    while not todo.isEmpty():
        if steps == most:
            raise RuntimeError(f"a path has more than {most} steps")
        steps += 1
        walk = settle(todo.join(back, ["source", "at"]).select("source", "target", F.col("prev").alias("at"), F.concat(F.array("at"), "path").alias("path")))
        found.append(walk.where("at is null").select("source", "target", "path"))
        todo = walk.where("at is not null")
    return _union(found)


def path_cost(routes: DataFrame, edges: DataFrame) -> DataFrame:
    """(route, cost, legs): sum of the least parallel edge along each route (route, path)."""
    p = F.col("path")
    legs = routes.select("route", F.inline(F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.struct(F.get(p, i - 1).alias("src"), F.get(p, i).alias("dst"))))))
    return legs.join(least_edges(edges), ["src", "dst"]).groupBy("route").agg(F.sum("w").alias("cost"), F.count("*").alias("legs"))


def strong_components(edges: DataFrame, part_edges: int = PART_EDGES) -> DataFrame:
    """(node, component) of every node of an edge; a component is named by its smallest node.

    Edges are dealt to parts of about part_edges of them. A part merges what goes in circles inside it and lets go of nodes that only it
    knows if that makes no more edges: those without in- or out-edges, and those that lead on from one node to another. What is left of
    all parts is a smaller graph, which is treated likewise; then each part finds its own nodes' components once more, with
    those of the smaller graph known. A graph that no longer becomes smaller goes by rounds of colours. Of a graph with many edges a node, whose parts share
    nearly all nodes, a few edges of each node are treated first, and then what all edges are between the components of those.
    """
    edges = settle(edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).distinct())
    found = settle(_components_of_few_first(edges, part_edges))
    least = found.groupBy("component").agg(F.min("node").alias("least")).where("least < component")
    return found.join(least, "component", "left").select("node", F.coalesce("least", "component").alias("component"))


def _few_edges(edges: DataFrame) -> DataFrame:
    """At most four edges that leave each node, and four that lead to it."""
    any_ = F.xxhash64("src", "dst")
    of = lambda near, far: edges.groupBy(near).agg(F.array(F.min(far), F.max(far), F.min_by(far, any_), F.max_by(far, any_)).alias("ends")).select(near, F.explode("ends").alias(far))
    return of("src", "dst").unionByName(of("dst", "src")).distinct()


def _components_of_few_first(edges: DataFrame, part_edges: int) -> DataFrame:
    """(node, component) with components named by any of their nodes; edges are different ones."""
    real = edges.where("src <> dst")
    count = real.count()
    few = settle(_few_edges(real)) if count > part_edges else None
    if few is None or 2 * few.count() > count:
        return _components_by_parts(edges, part_edges)
    first = settle(_components_by_parts(few, part_edges))  # of all nodes of an edge that is no loop
    named = lambda end: first.select(F.col("node").alias(end), F.col("component").alias(f"{end}_c"))
    between = real.join(named("src"), "src").join(named("dst"), "dst").where("src_c <> dst_c").select(F.col("src_c").alias("src"), F.col("dst_c").alias("dst"))
    whole = _components_by_parts(settle(between.distinct()), part_edges).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    found = first.join(whole, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    loops = edges.where("src = dst").select(F.col("src").alias("node")).join(first.select("node"), "node", "left_anti")
    return found.unionByName(loops.select("node", F.col("node").alias("component")))


def _components_by_parts(edges: DataFrame, part_edges: int) -> DataFrame:
    """(node, component) with components named by any of their nodes."""
    count = edges.where("src <> dst").count()
    parts = -(-count // part_edges)
    if parts <= 1:
        return _in_parts(edges.select(F.lit(0).alias("part"), "src", "dst", F.lit(0).alias("kind")), _last_part, "node long, component long")
    dealt = settle(_dealt(edges, parts, part_edges))
    ends = dealt.select("part", F.explode(F.array("src", "dst")).alias("node"))
    shared = settle(ends.groupBy("node").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("node"))
    marks = ends.join(shared, "node", "left_semi").distinct().select("part", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1).alias("kind"))
    rest = settle(_in_parts(dealt.withColumn("kind", F.lit(0)).unionByName(marks), _summary, "src long, dst long").distinct())
    known = settle(_components_by_parts(rest, part_edges) if rest.where("src <> dst").count() < SHRUNK * count else _scc_colours(rest))
    # What a part needs to know of the smaller graph: the components of its own nodes in it.
    told = ends.distinct().join(known, "node").select("part", F.col("node").alias("src"), F.col("component").alias("dst"), F.lit(2).alias("kind"))
    found = _in_parts(dealt.withColumn("kind", F.lit(0)).unionByName(told), _last_part, "node long, component long")
    return found.join(known.select("node"), "node", "left_anti").unionByName(known)


def _dealt(edges: DataFrame, parts: int, part_edges: int) -> DataFrame:
    """(part, src, dst): edges by ranges of their first nodes, or of their last ones where very many leave a node."""
    cuts = edges.agg(F.percentile_approx("src", [i / parts for i in range(1, min(parts, MOST_PARTS))], 10_000)).first()[0]
    bounds = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def part(node):
        import pandas as pd

        return pd.Series(np.searchsorted(bounds, node.to_numpy(), "left").astype(np.int32))

    hot = edges.groupBy("src").count().where(F.col("count") > part_edges).select("src")
    by = lambda rows, end: rows.select(part(end).alias("part"), "src", "dst")
    return by(edges.join(hot, "src", "left_anti"), "src").unionByName(by(edges.join(hot, "src", "left_semi"), "dst"))


def _in_parts(rows: DataFrame, kernel, schema: str) -> DataFrame:
    """Run kernel(edges, marks, told) on the rows (part, src, dst, kind) of each part, one part after another."""
    names = [f.split()[0] for f in schema.split(", ")]

    def table(pairs):
        pairs = list(pairs)
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names)

    def run(batches):
        now, held = None, ([], [], [])
        for batch in batches:
            for part, src, dst, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    if now is not None:
                        yield table(kernel(*held))
                    now, held = part, ([], [], [])
                held[kind].append((src, dst))
        if now is not None:
            yield table(kernel(*held))

    return rows.select("part", "src", "dst", "kind").repartition("part").sortWithinPartitions("part").mapInArrow(run, schema)


def _last_part(edges, marks, told):
    """(node, component) of a part, its nodes of one told component being one."""
    first, own = {}, dict(told)
    circles = [e for node, c in told for e in ((node, first.setdefault(c, node)), (first[c], node))]
    return [(node, own.get(c, c)) for node, c in _circles([*edges, *circles], own).items()]


def _circles(edges, preferred=()) -> dict[int, int]:
    """Strong component of each node, named by a preferred node if it has one, else by its smallest."""
    out: dict[int, list[int]] = defaultdict(list)
    for s, d in edges:
        out[s].append(d)
        out[d]
    index, low, stack, on, found = {}, {}, [], set(), {}
    for root in out:
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        stack.append(root), on.add(root)
        while work:
            u, rest = work[-1]
            v = next(rest, None)
            if v is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[u])
                if low[u] == index[u]:
                    own = [stack.pop()]
                    while own[-1] != u:
                        own.append(stack.pop())
                    on.difference_update(own)
                    found.update(dict.fromkeys(own, min((n for n in own if n in preferred), default=min(own))))
            elif v not in index:
                index[v] = low[v] = len(index)
                stack.append(v), on.add(v)
                work.append((v, iter(out[v])))
            elif v in on:
                low[u] = min(low[u], index[v])
    return found


def _summary(edges, marks, told):
    """Edges of a part that say as much of ways between its shared nodes, with circles merged and own nodes let go."""
    shared = {n for n, _ in marks}
    name = _circles(edges, shared)
    out, into = defaultdict(set), defaultdict(set)
    for s, d in edges:
        s, d = name[s], name[d]
        if s != d:
            out[s].add(d), into[d].add(s)
    todo = [n for n in set(name.values()) if n not in shared]
    gone = set()
    while todo:
        n = todo.pop()
        before, after = into[n], out[n]
        if n in gone or len(before) * len(after) > len(before) + len(after):
            continue
        gone.add(n)
        for b in before:
            out[b].discard(n)
            out[b] |= after  # never b itself: circles are merged
        for x in after:
            into[x].discard(n)
            into[x] |= before
        todo += [x for x in (*before, *after) if x not in shared and x not in gone]
    for n in name.values():
        if n not in gone:
            yield n, n
            yield from ((n, d) for d in out[n])
    for n in shared:
        if name[n] != n:
            yield from ((n, name[n]), (name[n], n))


def _spread(state: DataFrame, edges: DataFrame, better) -> DataFrame:
    """Fixpoint of labels along edges; state is (node, label). A round writes only the labels that it improves."""
    front = settle(state.select("node", "label"))
    labels = [front]
    while not front.isEmpty():
        step = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "label")
        if len(labels) > DELTAS:
            labels = [settle(_union(labels).groupBy("node").agg(better("label").alias("label")))]
        both = _union(labels).select("node", "label", F.col("label").alias("old")).unionByName(step.select("node", "label", F.lit(None).cast("long").alias("old")))
        best = both.groupBy("node").agg(better("label").alias("label"), better("old").alias("old"))
        front = settle(best.where(F.col("old").isNull() | (F.col("old") != F.col("label"))).select("node", "label"))
        labels.append(front)
    return _union(labels).groupBy("node").agg(better("label").alias("label"))


def _scc_colours(edges: DataFrame) -> DataFrame:
    """Colour every node with the largest node that reaches it; what reaches back to a colour's root inside the colour is its component."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    left_nodes, left, found = settle(nodes), settle(edges.where("src <> dst")), None
    while not left_nodes.isEmpty():
        colour = _spread(left_nodes.select("node", F.col("node").alias("label")), left, F.max)
        named = lambda x: colour.select(F.col("node").alias(x), F.col("label").alias(f"{x}_c"))
        inside = settle(left.join(named("src"), "src").join(named("dst"), "dst").where("src_c = dst_c").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        roots = colour.where("node = label")
        reach = _spread(roots, inside, F.max)
        least = reach.groupBy("label").agg(F.min("node").alias("component"))
        part = settle(reach.join(least, "label").select("node", "component"))
        found = part if found is None else found.unionByName(part)
        left_nodes = settle(left_nodes.join(part, "node", "left_anti"))
        left = settle(left.join(left_nodes.select(F.col("node").alias("src")), "src", "left_semi").join(left_nodes.select(F.col("node").alias("dst")), "dst", "left_semi"))
    return found if found is not None else nodes.select("node", F.col("node").alias("component"))


def largest_component(components: DataFrame) -> DataFrame:
    """(component, size) of the largest, the one of smaller name if several are."""
    return components.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(1)


def csr(edges: DataFrame) -> DataFrame:
    """(src, degree, first): where each node's edges begin if they are stored by node.

    Degrees are counted before the running sum; the sum goes over blocks of nodes, then inside each.
    """
    degree = edges.groupBy("src").agg(F.count("*").alias("degree")).withColumn("block", F.floor(F.col("src") / 4096))
    blocks = degree.groupBy("block").agg(F.sum("degree").alias("total"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select("block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("block").orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
    return degree.join(base, "block").select("src", "degree", (F.col("base") + F.coalesce(F.sum("degree").over(inner), F.lit(0))).alias("first"))


def drive_matrix(edges: DataFrame, snapped: DataFrame, holes: bool = False, kernel: bool | None = None) -> DataFrame:
    """(i, j, seconds) of anchors (id, node); pairs without a route have no row, or, with holes, no seconds.

    Up to MATRIX_EDGES edges the rows of the matrix are made where an anchor's node is searched from, so that no pair is moved or
    written: anchors, a row each, are sent to all tasks, and those at one node share a search. Many nodes are
    searched from at a time, and a dense graph is thinned before.
    """
    edges, kernel = kernel_graph(edges, kernel, MATRIX_EDGES)
    snapped = settle(snapped.select(F.col("id").cast("long"), F.col("node").cast("long")))
    if kernel:
        return _matrix_kernel(edges, snapped, holes)
    at = snapped.select("node").distinct()
    labels = _sssp_rounds(edges, at.withColumnRenamed("node", "source"), None, at)
    a, b = snapped.select(F.col("id").alias("i"), F.col("node").alias("source")), snapped.select(F.col("id").alias("j"), "node")
    met = a.crossJoin(b).join(labels, ["source", "node"], "left") if holes else labels.join(a, "source").join(b, "node")
    return met.select("i", "j", F.floor(F.col("dist") + 0.5).cast("int").alias("seconds"))


def thinned(edges: DataFrame) -> DataFrame:
    """edges without those that a way of short ones undercuts by more than rounding: no shortest way takes them, and a dense graph loses most of its own.

    A way that undercuts an edge is made of lesser edges, so that what replaces them, if they go as well, is shorter still.
    """
    tasks, kind = tasks_of(edges), "long" if dict(edges.dtypes)["w"] in ("int", "bigint") else "double"

    def search(columns, rows):
        graph = Arrays(columns)
        n, keep = len(graph.nodes), np.ones(len(graph.w), bool)
        short = np.zeros(len(graph.w), bool)
        for ends in (graph.src, graph.dst):
            order = np.lexsort((graph.w, ends))
            first = np.searchsorted(ends[order], np.arange(n + 1))
            short[order[np.arange(len(order)) - first[ends[order]] < SHORT]] = True
        lanes = Lanes(Arrays({"src": graph.src[short], "dst": graph.dst[short], "w": graph.w[short]}))  # every node is among its ends
        for part in rows.column("part").to_pylist():
            first, last = n * part // tasks, n * (part + 1) // tasks
            for a in range(first, last, lanes.width()):
                own = np.arange(a, min(last, a + lanes.width()))
                got = lanes.table(own)
                if got is None:
                    break
                e, at = graph.out(own)
                way = got[0][lanes.seat[graph.dst[e]], at]
                reached, w = way < got[1], graph.w[e]
                longest = max(float(way[reached].max(initial=0)), float(w.max(initial=0)))
                keep[e] = ~(reached & (way < w - 1e-9 * longest))
            e = np.arange(graph.first[first], graph.first[last])
            e = e[keep[e]]
            yield pa.RecordBatch.from_arrays([pa.array(graph.nodes[graph.src[e]]), pa.array(graph.nodes[graph.dst[e]]), pa.array(graph.w[e], pa.int64() if graph.whole else pa.float64())], ["src", "dst", "w"])

    parts = edges.sparkSession.range(tasks).select(F.col("id").alias("part"))
    return settle(beside_graph(edges, parts, F.col("part"), tasks, search, f"src long, dst long, w {kind}"))


def _matrix_kernel(edges: DataFrame, snapped: DataFrame, holes: bool) -> DataFrame:
    spark = edges.sparkSession
    flat = snapped.orderBy("node", "id").toArrow()  # a row an anchor
    sent = spark.sparkContext.broadcast(tuple(flat.column(c).to_numpy() for c in ("id", "node")))
    if edges.count() > THIN_EDGES:
        ends, starts = edges.select("src").distinct().count(), len(np.unique(sent.value[1]))
        if edges.count() > DENSE * ends and 4 * starts >= ends:
            edges = thinned(edges)
    tasks = tasks_of(edges)

    def search(columns, rows):
        (ids, nodes), graph = sent.value, Arrays(columns)
        places = graph.place(nodes)
        goals, where = np.unique(places[places >= 0], return_inverse=True)
        seat = np.full(len(ids), -1)  # of each anchor's node among the goals
        seat[places >= 0] = where
        lanes = Lanes(graph) if len(goals) else None
        graph = graph.lean()
        for part in rows.column("part").to_pylist():
            first, last = len(ids) * part // tasks, len(ids) * (part + 1) // tasks
            own = seat[first:last]
            for a in np.flatnonzero(own < 0) + first:  # a node without edges reaches itself
                yield from row_of(ids[a], np.where(nodes == nodes[a], 0, -1))
            starts = np.unique(own[own >= 0])
            while len(starts):
                now, starts = (starts[: lanes.width()], starts[lanes.width() :]) if lanes else (starts[:1], starts[1:])
                found = lanes.distances(goals[now], goals) if lanes else None
                if found is None:
                    lanes, found = None, (graph.distances(s, goals=goals)[goals] for s in goals[now])
                for start, dist in zip(now, found, strict=True):
                    dist = np.where((dist >= 0) & (dist < graph.none), dist, -1)
                    dist = np.floor(np.append(dist, -1)[seat] + 0.5).astype(np.int32)
                    for a in np.flatnonzero(own == start) + first:
                        yield from row_of(ids[a], dist)

    def row_of(i, seconds):
        whole = pa.RecordBatch.from_arrays([pa.array(np.full(len(seconds), i)), pa.array(sent.value[0]), pa.array(seconds, pa.int32(), mask=seconds < 0)], ["i", "j", "seconds"])
        yield whole if holes else whole.filter(whole.column(2).is_valid())

    parts = spark.range(tasks).select(F.col("id").alias("part"))
    return beside_graph(edges, parts, F.col("part"), tasks, search, "i long, j long, seconds int")
