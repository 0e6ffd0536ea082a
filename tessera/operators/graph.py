"""Property graphs over two frames: nodes(id, ...) and edges(src, dst, directed, ...).

Undirected edges can be walked both ways. Node ids are strings without ``:``; there are no self
loops; one directed edge per (src, dst) and one undirected per pair. Traversals are rounds of
equi-joins between a frontier and the adjacency, each checkpointed, so no vertex's state ever
leaves the executors; a hub is an ordinary join key that adaptive execution may split.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import meeting
from tessera.operators.collection import Collection
from tessera.plans.storage import cut

#: Pairs of source and node that searches from many sources hold at once; more go in batches of sources.
SEARCH_PAIRS = 1_000_000_000
#: Most arcs that an inherently sequential walk (depth-first order) may bring to the driver.
LOCAL_ARCS = 2_000_000


class CycleError(ValueError):
    """The graph has a cycle where none may be, or none where one is asked for."""


class Graph:
    """Directed, undirected and mixed graphs; every method is lazy unless it iterates."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    @classmethod
    def from_edges(cls, edges: DataFrame, nodes: DataFrame | None = None, directed: bool = True) -> Graph:
        """Normalise edges: text ids, no loops, undirected pairs in order, one edge per kind; endpoints become nodes."""
        flag = F.col("directed") if "directed" in edges.columns else F.lit(directed)
        e = edges.withColumns({"src": F.col("src").cast("string"), "dst": F.col("dst").cast("string"), "directed": flag}).where("src <> dst")
        low, high = F.least("src", "dst"), F.greatest("src", "dst")
        first, last = F.when(F.col("directed"), F.col("src")).otherwise(low), F.when(F.col("directed"), F.col("dst")).otherwise(high)
        e = e.select(*[{"src": first, "dst": last}.get(c, F.col(c)).alias(c) for c in e.columns])
        e = e.dropDuplicates(["src", "dst", "directed"])
        ends = e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).distinct()
        if nodes is not None:
            nodes = nodes.withColumn("id", F.col("id").cast("string"))
            ends = nodes.unionByName(ends.join(nodes, "id", "left_anti"), allowMissingColumns=True)
        return cls(ends, e)

    # ---- adjacency --------------------------------------------------------------------------

    def arcs(self, direction: str = "out", weight: str | None = None, edge_filter: Column | Callable | None = None) -> DataFrame:
        """(u, v, w, kind): steps that may be taken from u. kind is ``>``, ``<`` or ``-``; parallel steps are kept."""
        e = self._edges(edge_filter)
        w = (F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight and weight in e.columns else F.lit(1.0)).alias("w")
        ways = []
        if direction in ("out", "both"):
            ways.append(e.where("directed").select(F.col("src").alias("u"), F.col("dst").alias("v"), w, F.lit(">").alias("kind")))
        if direction in ("in", "both"):
            ways.append(e.where("directed").select(F.col("dst").alias("u"), F.col("src").alias("v"), w, F.lit("<").alias("kind")))
        und = e.where("not directed")
        ways += [und.select(F.col("src").alias("u"), F.col("dst").alias("v"), w, F.lit("-").alias("kind")), und.select(F.col("dst").alias("u"), F.col("src").alias("v"), w, F.lit("-").alias("kind"))]
        out = ways[0]
        for x in ways[1:]:
            out = out.union(x)
        return out

    def _edges(self, edge_filter: Column | Callable | None) -> DataFrame:
        if edge_filter is None:
            return self.edges
        if isinstance(edge_filter, Column):
            return self.edges.where(edge_filter)
        props = [c for c in self.edges.columns if c not in ("src", "dst", "directed")]
        test = F.udf(lambda r: bool(edge_filter(r.asDict(recursive=True))), "boolean", useArrow=True)
        return self.edges.where(test(F.struct(*props) if props else F.struct(F.lit(1).alias("_"))))

    def pairs(self, direction: str = "both") -> DataFrame:
        """Distinct (u, v) steps."""
        if direction == "both":
            return _mirrored(self.edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct())
        return self.arcs(direction).select("u", "v").distinct()

    # ---- editing ----------------------------------------------------------------------------

    def add_nodes(self, nodes: DataFrame) -> Graph:
        """Add nodes; properties given for a node that is there win over its own."""
        return Graph(_merged(self.nodes, nodes.withColumn("id", F.col("id").cast("string")), ["id"]), self.edges)

    def add_edges(self, edges: DataFrame) -> Graph:
        """Add edges, and nodes for endpoints that are new; properties given win."""
        other = Graph.from_edges(edges)
        return Graph(_merged(self.nodes, other.nodes, ["id"]), _merged(self.edges, other.edges, ["src", "dst", "directed"]))

    def add_node(self, node: str, **props: Any) -> Graph:
        spark = self.nodes.sparkSession
        return self.add_nodes(spark.range(1).select(F.lit(node).alias("id"), *[F.lit(v).alias(k) for k, v in props.items()]))

    def add_edge(self, u: str, v: str, directed: bool = True, **props: Any) -> Graph:
        spark = self.nodes.sparkSession
        ends = [F.lit(u).alias("src"), F.lit(v).alias("dst"), F.lit(directed).alias("directed")]
        return self.add_edges(spark.range(1).select(*ends, *[F.lit(x).alias(k) for k, x in props.items()]))

    def adjacency(self) -> DataFrame:
        """(id, entries): every node with its steps as ``>v``, ``<v`` or ``-v``, in order."""
        entries = self.arcs("both").groupBy(F.col("u").alias("id")).agg(F.array_sort(F.collect_list(F.concat("kind", "v"))).alias("entries"))
        return self.nodes.select("id").join(entries, "id", "left").select("id", F.coalesce("entries", F.array().cast("array<string>")).alias("entries"))

    def add_temporal_edges(self, edges: DataFrame, expires: Column) -> Graph:
        """Edges of relation ``temporary_access`` dated to when they end; nothing removes them by itself."""
        return self.add_edges(edges.withColumns({"relation": F.lit("temporary_access"), "_mdate": expires.cast("date")}))

    def remove_nodes(self, ids: list[str] | DataFrame) -> Graph:
        """Remove nodes and the edges at them."""
        gone = self._ids(ids)
        e = self.edges
        for end in ("src", "dst"):
            e = e.join(gone.withColumnRenamed("id", end), end, "left_anti")
        return Graph(self.nodes.join(gone, "id", "left_anti"), e.select(*self.edges.columns))

    def remove_edges(self, edges: DataFrame) -> Graph:
        return Graph(self.nodes, self.edges.join(Graph.from_edges(edges).edges.select("src", "dst", "directed"), ["src", "dst", "directed"], "left_anti").select(*self.edges.columns))

    def boost_edge_weights(self, relation: str, boost: float) -> Graph:
        w = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in self.edges.columns else F.lit(1.0)
        own = F.col("weight").cast("double") if "weight" in self.edges.columns else F.lit(None).cast("double")
        return Graph(self.nodes, self.edges.withColumn("weight", F.when(F.col("relation") == relation, w + boost).otherwise(own)))

    def _ids(self, ids: Any) -> DataFrame:
        if isinstance(ids, DataFrame):
            return ids.select(F.col(ids.columns[0]).cast("string").alias("id")).distinct()
        ids = [ids] if isinstance(ids, str) else list(ids)
        return self.nodes.sparkSession.createDataFrame([(str(i),) for i in ids], "id string")

    # ---- look-up ----------------------------------------------------------------------------

    def has_node(self, node: str) -> bool:
        return not self.get_node(node).isEmpty()

    def get_node(self, node: str) -> DataFrame:
        return self.nodes.where(F.col("id") == node)

    def get_edge(self, u: str, v: str, directed: bool = True) -> DataFrame:
        u, v = (u, v) if directed else sorted((u, v))
        return self.edges.where((F.col("src") == u) & (F.col("dst") == v) & (F.col("directed") == directed))

    def has_edge(self, u: str, v: str, directed: bool = True) -> bool:
        return not self.get_edge(u, v, directed).isEmpty()

    def find_nodes(self, rule: Any, limit: int = 0, skip: int = 0) -> DataFrame:
        """Nodes whose properties fit a rule."""
        return self._found(self.nodes, ["id"], rule, limit, skip)

    def find_edges(self, rule: Any, limit: int = 0, skip: int = 0) -> DataFrame:
        """Edges whose properties fit a rule, with their kind."""
        return self._found(self.edges.withColumn("kind", F.when(F.col("directed"), ">").otherwise("-")), ["src", "kind", "dst"], rule, limit, skip)

    @staticmethod
    def _found(df: DataFrame, keys: list[str], rule: Any, limit: int, skip: int) -> DataFrame:
        found = Collection(df.withColumn("_id", F.concat_ws(":", *keys))).find(vals=rule).df.drop("_id")
        found = found.orderBy(*keys) if limit or skip else found
        found = found.offset(skip) if skip else found
        return found.limit(limit) if limit else found

    def number_of_nodes(self) -> int:
        return self.nodes.count()

    def number_of_edges(self) -> int:
        return self.edges.count()

    def is_directed(self) -> bool:
        """Whether there are edges and all are directed."""
        r = self.edges.agg(F.count("*").alias("n"), F.count_if("directed").alias("d")).first()
        return r.n > 0 and r.n == r.d

    def neighbors(self, node: str) -> DataFrame:
        return self.arcs("both").where(F.col("u") == node).select(F.col("v").alias("id")).distinct()

    def successors(self, node: str) -> DataFrame:
        return self._beside(node, "out")

    def predecessors(self, node: str) -> DataFrame:
        return self._beside(node, "in")

    def _beside(self, node: str, direction: str) -> DataFrame:
        ahead, back = ("src", "dst") if direction == "out" else ("dst", "src")
        e = self.edges
        hit = (F.col(ahead) == node) | (~F.col("directed") & (F.col(back) == node))
        return e.where(hit).withColumn("id", F.when(F.col(ahead) == node, F.col(back)).otherwise(F.col(ahead)))

    def common_neighbors(self, a: str, b: str) -> DataFrame:
        return self.neighbors(a).intersect(self.neighbors(b))

    def common_counts(self) -> DataFrame:
        """(a, b, common, jaccard) of every pair of nodes that share a neighbour."""
        p = cut(self.pairs())
        size = cut(p.groupBy("u").agg(F.count("*").alias("n")))
        return meeting.common(p.join(size, "u").select("v", "u", F.col("n").cast("int").alias("n")), _blocks(size))

    def jaccard_coefficient(self, a: str, b: str) -> float:
        both = self.arcs("both").where(F.col("u").isin(a, b)).groupBy("v").agg(F.countDistinct("u").alias("n"))
        r = both.agg(F.count("*").alias("any"), F.count_if(F.col("n") == 2).alias("both")).first()
        return (r["both"] if a != b else r["any"]) / r["any"] if r["any"] else 0.0

    # ---- degrees ----------------------------------------------------------------------------

    def degree(self) -> DataFrame:
        """(id, in, out, undirected, total) counts of adjacency entries; parallel edges count each."""
        return self._degrees(None)

    def weighted_degree(self, weight: str = "weight") -> DataFrame:
        """The same as sums of a weight (1 where it is absent)."""
        return self._degrees(weight)

    def _degrees(self, weight: str | None) -> DataFrame:
        a = self.arcs("both", weight)
        part = lambda k: F.sum(F.when(F.col("kind") == k, F.col("w")).otherwise(0.0))
        kind = "double" if weight else "long"
        d = a.groupBy(F.col("u").alias("id")).agg(part("<").cast(kind).alias("in"), part(">").cast(kind).alias("out"), part("-").cast(kind).alias("undirected"))
        d = self.nodes.select("id").join(d, "id", "left").na.fill(0)
        return d.withColumn("total", F.col("in") + F.col("out") + F.col("undirected"))

    def degree_centrality(self) -> DataFrame:
        n = max(1, self.number_of_nodes() - 1)
        return self.degree().select("id", (F.col("total") / n).alias("centrality"))

    def density(self) -> float:
        n = self.number_of_nodes()
        m = self.edges.agg(F.coalesce(F.sum(F.when(F.col("directed"), 1).otherwise(2)), F.lit(0))).first()[0]
        return m / (n * (n - 1)) if n > 1 else 0.0

    # ---- traversal --------------------------------------------------------------------------

    def distances(self, sources: Any, direction: str = "out", max_hops: int | None = None, weight: str | None = None, edge_filter: Any = None) -> DataFrame:
        """(source, id, dist): shortest distances from each source, itself at 0.

        Unweighted: one join per hop, each (source, node) is reached once. Weighted: rounds of
        relaxation until no distance falls.
        """
        start = self.nodes.select("id").join(self._ids(sources), "id", "left_semi")
        reached = cut(start.select(F.col("id").alias("source"), "id", F.lit(0.0 if weight else 0).alias("dist")))
        arcs = self.arcs(direction, weight, edge_filter)
        arcs = cut(arcs.groupBy("u", "v").agg(F.min("w").alias("w")))
        frontier, hops = reached, 0
        while max_hops is None or hops < max_hops:
            hops += 1
            step = frontier.join(arcs, F.col("id") == F.col("u")).select("source", F.col("v").alias("id"), (F.col("dist") + (F.col("w") if weight else F.lit(1))).alias("dist"))
            step = step.groupBy("source", "id").agg(F.min("dist").alias("dist"))
            if weight:
                old = reached.withColumnRenamed("dist", "old")
                frontier = cut(step.join(old, ["source", "id"], "left").where("old is null or dist < old").select("source", "id", "dist"))
                if frontier.isEmpty():
                    break
                reached = cut(reached.union(frontier).groupBy("source", "id").agg(F.min("dist").alias("dist")))
            else:
                frontier = cut(step.join(reached, ["source", "id"], "left_anti").select("source", "id", "dist"))
                if frontier.isEmpty():
                    break
                reached = cut(reached.union(frontier))
        return reached

    def k_hop_neighbors(self, node: str, k: int, direction: str = "both") -> DataFrame:
        """(id, dist) within k hops, without the node itself."""
        return self.distances(node, direction, max(0, k)).where(F.col("id") != node).select("id", "dist")

    def descendants(self, node: str) -> DataFrame:
        return self.distances(node, "out").where(F.col("id") != node).select("id")

    def ancestors(self, node: str) -> DataFrame:
        return self.distances(node, "in").where(F.col("id") != node).select("id")

    def subgraph(self, ids: Any) -> Graph:
        """The nodes and the edges between them."""
        keep = self._ids(ids)
        e = self.edges
        for end in ("src", "dst"):
            e = e.join(keep.withColumnRenamed("id", end), end, "left_semi")
        return Graph(self.nodes.join(keep, "id", "left_semi"), e.select(*self.edges.columns))

    def ego_graph(self, node: str, k: int = 1, direction: str = "both") -> Graph:
        return self.subgraph(self.distances(node, direction, k).select("id"))

    def _back(self, reached: DataFrame, target: str, direction: str, weight: str | None, edge_filter: Any) -> DataFrame:
        """Arcs (u, v) that lie on shortest paths to ``target``, from the distances of one source."""
        d = reached.select("id", "dist")
        arcs = self.arcs(direction, weight, edge_filter).groupBy("u", "v").agg(F.min("w").alias("w"))
        tight = arcs.join(d.select(F.col("id").alias("u"), F.col("dist").alias("du")), "u").join(d.select(F.col("id").alias("v"), F.col("dist").alias("dv")), "v")
        step = F.col("w") if weight else F.lit(1)
        return cut(tight.where(F.abs(F.col("du") + step - F.col("dv")) <= 1e-12 * (1 + F.abs(F.col("dv")))).select("u", "v"))

    def all_shortest_paths(self, source: str, target: str, direction: str = "out", edge_filter: Any = None, weight: str | None = None) -> DataFrame:
        """(path): every shortest path as an array of ids; the source alone if it is the target."""
        spark = self.nodes.sparkSession
        if source == target:
            return self.get_node(source).select(F.array("id").alias("path"))
        reached = self.distances(source, direction, None, weight, edge_filter)
        if reached.where(F.col("id") == target).isEmpty():
            return spark.createDataFrame([], "path array<string>")
        tight = self._back(reached, target, direction, weight, edge_filter)
        open_, done = spark.createDataFrame([([target],)], "path array<string>"), None
        while True:
            grown = open_.join(tight, F.element_at("path", 1) == F.col("v")).select(F.concat(F.array("u"), "path").alias("path"))
            grown = cut(grown)
            if grown.isEmpty():
                break
            ends = grown.where(F.element_at("path", 1) == source)
            done = ends if done is None else done.union(ends)
            open_ = grown.where(F.element_at("path", 1) != source)
        return done

    def bfs_shortest_path(self, source: str, target: str, direction: str = "out", edge_filter: Any = None) -> list[str]:
        """One path of fewest hops (the first in order of ids), [] if there is none."""
        return self._one_path(source, target, direction, edge_filter, None)[1]

    def dijkstra_shortest_path(self, source: str, target: str, weight: str = "weight") -> tuple[float, list[str]]:
        """(distance, path) by weight, (inf, []) if there is none."""
        return self._one_path(source, target, "out", None, weight)

    def _one_path(self, source: str, target: str, direction: str, edge_filter: Any, weight: str | None) -> tuple[float, list[str]]:
        reached = self.distances(source, direction, None, weight, edge_filter)
        end = reached.where(F.col("id") == target).first()
        if end is None:
            return float("inf"), []
        tight = self._back(reached, target, direction, weight, edge_filter)
        path = [target]
        while path[0] != source:
            path.insert(0, tight.where(F.col("v") == path[0]).agg(F.min("u")).first()[0])
        return float(end["dist"]), path

    def _local(self, direction: str = "out", edge_filter: Any = None) -> dict[str, list[tuple[str, str]]]:
        """Adjacency on the driver for depth-first order, which is sequential; refused beyond LOCAL_ARCS."""
        arcs = self.arcs(direction, None, edge_filter).select("u", "v", "kind")
        if arcs.count() > LOCAL_ARCS:
            raise ValueError(f"a depth-first walk is sequential: more than {LOCAL_ARCS} arcs")
        out: dict[str, list[tuple[str, str]]] = {}
        for r in arcs.orderBy("u", "v", "kind").collect():
            out.setdefault(r.u, []).append((r.v, r.kind))
        return out

    def dfs_traverse(self, source: str, direction: str = "out", edge_filter: Any = None) -> list[str]:
        """Ids in depth-first preorder; neighbours in order of ids."""
        if not self.has_node(source):
            return []
        near, seen, order, stack = self._local(direction, edge_filter), set(), [], [source]
        while stack:
            at = stack.pop()
            if at in seen:
                continue
            seen.add(at)
            order.append(at)
            stack.extend(v for v, _ in reversed(near.get(at, [])) if v not in seen)
        return order

    # ---- cycles and order --------------------------------------------------------------------

    def _cyclic_arcs(self) -> DataFrame:
        """Arcs left after those that no cycle can use are peeled off, round by round.

        An arc stays while another arc leads into it and another leads out of it, not counting the
        way back along the same undirected edge.
        """
        arcs = cut(self.arcs("out").select("u", "v", "kind"))
        n = arcs.count()
        while n:
            outs = arcs.groupBy(F.col("u").alias("v")).agg(F.count("*").alias("outs"))
            ins = arcs.groupBy(F.col("v").alias("u")).agg(F.count("*").alias("ins"))
            back = arcs.where("kind = '-'").select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit("-").alias("kind"), F.lit(1).alias("back"))
            a = arcs.join(outs, "v").join(ins, "u").join(back, ["u", "v", "kind"], "left")
            spare = F.coalesce("back", F.lit(0))
            arcs = cut(a.where((F.col("outs") - spare > 0) & (F.col("ins") - spare > 0)).select("u", "v", "kind"))
            left = arcs.count()
            if left == n:
                break
            n = left
        return arcs

    def is_cyclic(self) -> bool:
        return not self._cyclic_arcs().isEmpty()

    def find_cycle(self, source: str | None = None) -> list[tuple[str, str, str]]:
        """One cycle as (u, kind, v) steps; CycleError if there is none (reachable from ``source``)."""
        arcs = self._cyclic_arcs()
        if source is not None:
            arcs = cut(arcs.join(self.distances(source, "out").select(F.col("id").alias("u")), "u", "left_semi").select("u", "v", "kind"))
        at = arcs.orderBy("u", "v", "kind").first()
        if at is None:
            raise CycleError("no cycle")
        seen: dict[tuple, int] = {}
        walk: list[tuple[str, str, str]] = []
        while (at.u, at.kind, at.v) not in seen:
            seen[at.u, at.kind, at.v] = len(walk)
            walk.append((at.u, at.kind, at.v))
            onward = arcs.where(F.col("u") == at.v)
            if at.kind == "-":
                onward = onward.where(~((F.col("v") == at.u) & (F.col("kind") == "-")))
            at = onward.orderBy("v", "kind").first()
        return walk[seen[at.u, at.kind, at.v] :]

    def topological_levels(self) -> DataFrame:
        """(id, level): longest distance from a node without predecessors; CycleError on a cycle."""
        if not self.edges.where("not directed").isEmpty():
            raise CycleError("undirected edges have no order")
        arcs = cut(self.arcs("out").select("u", "v"))
        left, done, level = cut(self.nodes.select("id")), None, 0
        while not left.isEmpty():
            held = arcs.join(left.select(F.col("id").alias("u")), "u", "left_semi").select(F.col("v").alias("id")).distinct()
            ready = cut(left.join(held, "id", "left_anti"))
            if ready.isEmpty():
                raise CycleError("the graph has a cycle")
            found = ready.withColumn("level", F.lit(level))
            done = found if done is None else cut(done.union(found))
            left, level = cut(left.join(ready, "id", "left_anti")), level + 1
        return done if done is not None else self.nodes.select("id").limit(0).withColumn("level", F.lit(0))

    def topological_sort(self) -> DataFrame:
        return self.topological_levels().orderBy("level", "id")

    # ---- components ----------------------------------------------------------------------------

    def connected_components(self) -> DataFrame:
        """(id, component): weak components, named by their smallest id; rounds grow as the logarithm of the diameter."""
        return _spread(self.nodes.select("id"), self.pairs("both"))

    def strongly_connected_components(self) -> DataFrame:
        """(id, component): colouring. Each round spreads the smallest id forward as a colour, and the
        nodes of a colour that reach its root backward form one component."""
        left, done = cut(self.nodes.select("id")), None
        arcs = cut(self.pairs("out"))
        while not left.isEmpty():
            colour = _spread(left, arcs, both=False)
            c = colour.withColumnRenamed("component", "c")
            own = arcs.join(c.select(F.col("id").alias("u"), F.col("c").alias("cu")), "u").join(c.select(F.col("id").alias("v"), F.col("c").alias("cv")), "v").where("cu = cv").select("u", "v")
            own = cut(own)
            front = found = cut(c.where("id = c"))
            while True:
                step = front.join(own, F.col("id") == F.col("v")).select(F.col("u").alias("id"), "c").distinct()
                front = cut(step.join(found, "id", "left_anti"))
                if front.isEmpty():
                    break
                found = cut(found.union(front))
            done = found if done is None else cut(done.union(found))
            left = cut(left.join(found, "id", "left_anti"))
            arcs = cut(arcs.join(left.select(F.col("id").alias("u")), "u", "left_semi").join(left.select(F.col("id").alias("v")), "v", "left_semi").select("u", "v"))
        out = done if done is not None else self.nodes.select("id", F.col("id").alias("c"))
        low = out.groupBy("c").agg(F.min("id").alias("component"))
        return out.join(low, "c").select("id", "component")

    # ---- clustering -----------------------------------------------------------------------------

    def triangles(self, pairs: DataFrame | None = None) -> DataFrame:
        """(a, b, c) with a < b < c, each once, directions aside."""
        return self._triangles(cut(self.pairs("both")) if pairs is None else pairs).select("a", "b", "c")

    def _triangles(self, p: DataFrame) -> DataFrame:
        """(a, b, c, w) with a < b < c of ``p`` (u, v), both ways; w is the product of the edges' ``w`` in ``p``, if any.

        Arcs point from the node of lower degree, so a hub starts few wedges; wedges are closed where they are made.
        """
        deg = p.groupBy("u").agg(F.count("*").alias("d"))
        w = F.col("w").cast("double") if "w" in p.columns else F.lit(1.0)
        e = p.where("u < v").withColumn("n", w).join(deg.select("u", F.col("d").alias("du")), "u").join(deg.select(F.col("u").alias("v"), F.col("d").alias("dv")), "v")
        first = F.struct("du", "u") < F.struct(F.col("dv").alias("du"), F.col("v").alias("u"))
        o = cut(e.select(F.when(first, F.col("u")).otherwise(F.col("v")).alias("v"), F.when(first, F.col("v")).otherwise(F.col("u")).alias("u"), "n"))
        return meeting.triangles(o, _blocks(o.groupBy("v").agg(F.count("*").alias("n"))))

    def clustering(self, weight: str | None = None) -> DataFrame:
        """(id, clustering). Undirected graphs: closed share of neighbour pairs, or its weighted form;
        with any directed edge the directed form, which ignores weights."""
        if not self.edges.where("directed").isEmpty():
            return self._directed_clustering()
        if weight is None:
            p, x = cut(self.pairs("both")), F.lit(1.0)
        else:
            e = cut(self.edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.coalesce(F.col(weight).cast("double"), F.lit(1.0)).alias("w")))
            top = e.agg(F.max("w")).first()[0] or 1.0
            p, x = _mirrored(e.withColumn("w", F.col("w") / (top if top > 0 else 1.0))), F.cbrt("w")
        deg = p.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("k"))
        at = self._triangles(p).select(F.explode(F.array("a", "b", "c")).alias("id"), x.alias("x")).groupBy("id").agg(F.sum("x").alias("x"))
        out = self.nodes.select("id").join(deg, "id", "left").join(at, "id", "left")
        value = F.when(F.col("k") > 1, 2 * F.coalesce("x", F.lit(0.0)) / (F.col("k") * (F.col("k") - 1))).otherwise(0.0)
        return out.select("id", F.coalesce(value, F.lit(0.0)).alias("clustering"))

    def _directed_clustering(self) -> DataFrame:
        steps = self.pairs("out").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.count("*").alias("w"))
        m = cut(_mirrored(steps))
        t = self._triangles(m).withColumn("x", 2 * F.col("w"))
        at = t.select(F.explode(F.array("a", "b", "c")).alias("id"), "x").groupBy("id").agg(F.sum("x").alias("x"))
        deg = m.groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("d"), F.count_if(F.col("w") == 2).alias("r"))
        out = self.nodes.select("id").join(deg, "id", "left").join(at, "id", "left")
        room = 2.0 * (F.col("d") * (F.col("d") - 1) - 2 * F.col("r"))
        return out.select("id", F.coalesce(F.when(room > 0, F.coalesce("x", F.lit(0.0)) / room), F.lit(0.0)).alias("clustering"))

    def average_clustering(self, weight: str | None = None) -> float:
        return self.clustering(weight).agg(F.avg("clustering")).first()[0] or 0.0

    def transitivity(self) -> float:
        """Three times the triangles over the wedges, directions aside."""
        p = cut(self.pairs("both"))
        deg = p.groupBy("u").agg(F.count("*").alias("k"))
        wedges = deg.agg(F.coalesce(F.sum(F.col("k") * (F.col("k") - 1) / 2), F.lit(0.0))).first()[0]
        return 3 * self.triangles(p).count() / wedges if wedges else 0.0

    # ---- centrality -----------------------------------------------------------------------------

    def pagerank(self, alpha: float = 0.85, max_iter: int = 100, tol: float = 1e-6, weight: str | None = "weight") -> DataFrame:
        """(id, rank): along outgoing and undirected edges; the rank of dead ends is spread evenly."""
        n = self.number_of_nodes()
        if not n:
            return self.nodes.select("id", F.lit(0.0).alias("rank"))
        arcs = self.arcs("out", weight)
        arcs = arcs.groupBy("u", "v").agg(F.max_by("w", "kind").alias("w"))  # a directed edge counts before an undirected one
        total = arcs.groupBy("u").agg(F.sum("w").alias("t"), F.count("*").alias("k"))
        share = cut(arcs.join(total, "u").select("u", "v", F.when(F.col("t") > 0, F.col("w") / F.col("t")).otherwise(1 / F.col("k")).alias("s")))
        ends = self.nodes.select("id").join(total.select(F.col("u").alias("id"), F.lit(True).alias("goes")), "id", "left")
        rank = cut(ends.select("id", F.col("goes").isNull().alias("dead"), F.lit(1.0 / n).alias("rank")))
        for _ in range(max_iter):
            dead = rank.agg(F.coalesce(F.sum(F.when(F.col("dead"), F.col("rank"))), F.lit(0.0))).first()[0]
            base = (1 - alpha) / n + alpha * dead / n
            flow = share.join(rank, F.col("u") == F.col("id")).groupBy(F.col("v").alias("id")).agg(F.sum(F.col("s") * F.col("rank")).alias("in"))
            fresh = cut(rank.join(flow, "id", "left").select("id", "dead", F.col("rank").alias("old"), (F.lit(base) + alpha * F.coalesce("in", F.lit(0.0))).alias("rank")))
            delta = fresh.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
            rank = fresh.drop("old")
            if delta < tol:
                break
        return rank.select("id", "rank")

    def closeness_centrality(self, nodes: Any = None, distance: str | None = None, wf_improved: bool = True, direction: str = "in") -> DataFrame:
        """(id, closeness) of ``nodes`` (all: as many searches as nodes, run together or in batches)."""
        n = self.number_of_nodes()
        s = None
        for sources in self._batches(nodes):
            d = self.distances(sources, direction, None, distance)
            part = cut(d.groupBy("source").agg(F.count("*").alias("r"), F.sum("dist").alias("t")))
            s = part if s is None else s.union(part)
        score = (F.col("r") - 1) / F.col("t")
        score = score * (F.col("r") - 1) / max(1, n - 1) if wf_improved else score
        return s.select(F.col("source").alias("id"), F.when((F.col("t") > 0) & F.lit(n > 1), score).otherwise(0.0).alias("closeness"))

    def _batches(self, sources: Any = None) -> list[DataFrame]:
        """The sources of a search, in parts of SEARCH_PAIRS pairs with nodes at most."""
        start = self.nodes.select("id") if sources is None else self._ids(sources)
        parts = max(1, -(-start.count() * self.number_of_nodes() // SEARCH_PAIRS))
        return [start] if parts == 1 else [start.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == k) for k in range(parts)]

    def _dependencies(self, sources: Any, keys: list[str], skip_source: bool) -> DataFrame | None:
        """Sums of dependencies by ``keys`` (u, or u and v), each batch of sources summed before the next."""
        total = None
        for batch in self._batches(sources):
            for c in self._brandes(batch):
                part = (c.where("u <> source") if skip_source else c).groupBy(*keys).agg(F.sum("c").alias("b"))
                total = part if total is None else total.union(part)
            if total is not None:
                total = cut(total.groupBy(*keys).agg(F.sum("b").alias("b")))
        return total

    def _brandes(self, sources: Any = None) -> list[DataFrame]:
        """Dependencies (source, u, v, c) of each level's steps, for all sources at once.

        Forward, shortest-path counts are summed level by level; backward, each node hands its
        dependency to its predecessors in proportion to their counts.
        """
        arcs = cut(self.pairs("out"))
        start = self.nodes.select("id") if sources is None else self._ids(sources)
        level = cut(start.select(F.col("id").alias("source"), "id", F.lit(1.0).alias("sigma")))
        reached, levels = level.select("source", "id"), [level]
        while True:
            step = level.join(arcs, F.col("id") == F.col("u")).groupBy("source", F.col("v").alias("id")).agg(F.sum("sigma").alias("sigma"))
            level = cut(step.join(reached, ["source", "id"], "left_anti"))
            if level.isEmpty():
                break
            levels.append(level)
            reached = cut(reached.union(level.select("source", "id")))
        delta, out = None, []
        for k in range(len(levels) - 1, 0, -1):
            low = levels[k]
            low = low.withColumn("delta", F.lit(0.0)) if delta is None else low.join(delta, ["source", "id"], "left").withColumn("delta", F.coalesce("delta", F.lit(0.0)))
            up = levels[k - 1].select("source", F.col("id").alias("u"), F.col("sigma").alias("su"))
            c = low.join(arcs, F.col("id") == F.col("v")).join(up, ["source", "u"]).select("source", "u", "v", (F.col("su") / F.col("sigma") * (1 + F.col("delta"))).alias("c"))
            c = cut(c)
            out.append(c)
            delta = cut(c.groupBy("source", F.col("u").alias("id")).agg(F.sum("c").alias("delta")))
        return out

    def betweenness_centrality(self, normalized: bool = True, sources: Any = None) -> DataFrame:
        """(id, betweenness) over outgoing and undirected edges, unweighted."""
        total = self._dependencies(sources, ["u"], True)
        n = self.number_of_nodes()
        scale = 1 / ((n - 1) * (n - 2)) if normalized and n > 2 else 1.0
        if total is None:
            return self.nodes.select("id", F.lit(0.0).alias("betweenness"))
        total = total.select(F.col("u").alias("id"), "b")
        return self.nodes.select("id").join(total, "id", "left").select("id", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))

    def edge_betweenness_centrality(self, normalized: bool = True) -> DataFrame:
        """(src, kind, dst, betweenness); a pair with both kinds of edge counts for the directed one."""
        total = self._dependencies(None, ["u", "v"], False)
        n, und = self.number_of_nodes(), not self.edges.where("not directed").isEmpty()
        arcs = self.arcs("out").groupBy("u", "v").agg(F.max("kind").alias("kind"))
        if total is None:
            total = self.nodes.sparkSession.createDataFrame([], "u string, v string, b double")
        scale = (2.0 if und else 1.0) / (n * (n - 1)) if normalized and n > 1 else 1.0
        named = total.withColumnRenamed("b", "c").join(arcs, ["u", "v"])
        flip = (F.col("kind") == "-") & (F.col("u") > F.col("v"))
        named = named.select(F.when(flip, F.col("v")).otherwise(F.col("u")).alias("src"), "kind", F.when(flip, F.col("u")).otherwise(F.col("v")).alias("dst"), (F.col("c") * scale).alias("c"))
        return named.groupBy("src", "kind", "dst").agg(F.sum("c").alias("betweenness"))

    # ---- exchange and upkeep ----------------------------------------------------------------------

    def verify_index(self) -> DataFrame:
        """(src, dst, directed) of edges with an endpoint that is no node."""
        ids = self.nodes.select("id")
        bad = [self.edges.join(ids.withColumnRenamed("id", end), end, "left_anti").select("src", "dst", "directed") for end in ("src", "dst")]
        return bad[0].union(bad[1]).distinct()

    def reindex(self) -> Graph:
        """Without dangling edges."""
        return Graph(self.nodes, self.edges.join(self.verify_index(), ["src", "dst", "directed"], "left_anti").select(*self.edges.columns))

    def export_graph(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.edges.write.mode("overwrite").parquet(f"{path}/edges")

    @classmethod
    def import_graph(cls, spark: Any, path: str) -> Graph:
        return cls(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))

    def to_networkx(self) -> Any:
        """A networkx graph on the driver, where that library is installed and the graph is small."""
        import networkx as nx

        rows, nodes = (df.limit(LOCAL_ARCS + 1).collect() for df in (self.edges, self.nodes))
        if max(len(rows), len(nodes)) > LOCAL_ARCS:
            raise ValueError("the graph is too large for the driver")
        g = nx.DiGraph() if any(r.directed for r in rows) else nx.Graph()
        for r in nodes:
            g.add_node(r.id, **{k: v for k, v in r.asDict().items() if k != "id"})
        for r in rows:
            props = {k: v for k, v in r.asDict().items() if k not in ("src", "dst", "directed")}
            g.add_edge(r.src, r.dst, **props)
            if g.is_directed() and not r.directed:
                g.add_edge(r.dst, r.src, **props)
        return g

    @classmethod
    def from_networkx(cls, spark: Any, g: Any) -> Graph:
        rows = [(str(u), str(v), g.is_directed(), float(d.get("weight", 1))) for u, v, d in g.edges(data=True)]
        nodes = spark.createDataFrame([(str(n),) for n in g.nodes], "id string")
        return cls.from_edges(spark.createDataFrame(rows, "src string, dst string, directed boolean, weight double"), nodes)


def _merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; where both have a key, values given in ``new`` win."""
    both = old.withColumn("__t", F.lit(0)).unionByName(new.withColumn("__t", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "__t")]
    return both.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__t"))).alias(c) for c in rest])


def _spread(ids: DataFrame, arcs: DataFrame, both: bool = True) -> DataFrame:
    """(id, component): the smallest id that reaches each node.

    Each round takes the smallest label among neighbours and then, where steps go both ways, the
    label of that label, which halves chains.
    """
    labels = cut(ids.select("id", F.col("id").alias("component")))
    arcs = cut(arcs.select("u", "v"))
    while True:
        heard = labels.join(arcs, F.col("id") == F.col("u")).groupBy(F.col("v").alias("id")).agg(F.min("component").alias("heard"))
        fresh = labels.join(heard, "id", "left").select("id", F.least("component", "heard").alias("component"), F.col("component").alias("was"))
        if both:
            up = fresh.select(F.col("id").alias("component"), F.col("component").alias("up"))
            fresh = fresh.join(up, "component", "left").select("id", F.least("component", "up").alias("component"), "was")
        fresh = cut(fresh)
        moved = not fresh.where("component <> was").isEmpty()
        labels = fresh.drop("was")
        if not moved:
            return labels


def _mirrored(edges: DataFrame) -> DataFrame:
    """(u, v, ...) of each row and of its reverse."""
    rest = [c for c in edges.columns if c not in ("u", "v")]
    ways = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    return edges.select(ways.alias("way"), *rest).select("way.u", "way.v", *rest)


def _blocks(sizes: DataFrame) -> int:
    """Blocks of nodes that the pairs within lists of sizes ``n`` (and their members) are dealt to."""
    return meeting.blocks(sizes, int(sizes.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") + 1) / 2), F.lit(0.0))).first()[0]))
