import itertools
import random

import pytest

from tessera.operators.graph import CycleError, Graph
from tessera.plans.query import Query


def graph(spark, edges, nodes=()):
    """Edges as 'a>b' or 'a-b', optionally with ':weight'."""
    rows = []
    for e in edges:
        pair, _, w = e.partition(":")
        kind = ">" if ">" in pair else "-"
        u, v = pair.split(kind)
        rows.append((u, v, kind == ">", float(w) if w else None))
    df = spark.createDataFrame(rows, "src string, dst string, directed boolean, weight double")
    return Graph.from_edges(df, spark.createDataFrame([(n,) for n in nodes], "id string") if nodes else None)


def col(df, *names):
    return {tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()}


@pytest.fixture(scope="module")
def mini(spark):
    return graph(spark, ["alice>bob:1.5", "bob>charlie:2.0", "alice-charlie:0.5"])


def test_editing(spark, mini):
    assert mini.number_of_nodes() == 3 and mini.number_of_edges() == 3 and not mini.is_directed()
    g = mini.add_nodes(spark.createDataFrame([("dan", 5)], "id string, age int")).add_nodes(spark.createDataFrame([("dan", "x")], "id string, role string"))
    assert [r.asDict() for r in g.get_node("dan").collect()] == [{"id": "dan", "age": 5, "role": "x"}]
    g = g.add_edges(spark.createDataFrame([("alice", "bob", True, 9.0), ("x", "y", False, None), ("z", "z", True, 1.0)], "src string, dst string, directed boolean, weight double"))
    assert g.get_edge("alice", "bob").first().weight == 9.0 and g.has_edge("y", "x", directed=False) and not g.has_node("z")
    gone = g.remove_nodes(["alice"])
    assert col(gone.edges, "src", "dst") == {("bob", "charlie"), ("x", "y")} and not gone.has_node("alice")
    assert not g.remove_edges(spark.createDataFrame([("alice", "bob", True)], "src string, dst string, directed boolean")).has_edge("alice", "bob")
    assert col(g.find_edges(Query().weight > 1.9), "src", "kind", "dst") == {("alice", ">", "bob"), ("bob", ">", "charlie")}
    assert col(g.find_nodes({"age.$gt": 4}), "id") == {"dan"}


def test_single_additions(mini):
    g = mini.add_node("eve", age=3).add_edge("eve", "bob", directed=False, weight=4.0)
    assert g.has_edge("bob", "eve", directed=False) and g.get_node("eve").first().age == 3
    assert dict(col(g.adjacency().selectExpr("id", "array_join(entries, ' ') AS e"), "id", "e"))["bob"] == "-eve <alice >charlie"


def test_neighbourhoods(mini):
    assert col(mini.neighbors("alice"), "id") == {"bob", "charlie"}
    assert col(mini.successors("charlie"), "id") == {"alice"} and col(mini.predecessors("charlie"), "id") == {"alice", "bob"}
    assert col(mini.degree(), "id", "in", "out", "undirected", "total") == {("alice", 0, 1, 1, 2), ("bob", 1, 1, 0, 2), ("charlie", 1, 0, 1, 2)}
    assert col(mini.weighted_degree(), "id", "total") == {("alice", 2.0), ("bob", 3.5), ("charlie", 2.5)}
    assert mini.jaccard_coefficient("alice", "bob") == pytest.approx(1 / 3) and mini.density() == pytest.approx(4 / 6)


def test_paths(spark, mini):
    assert mini.dijkstra_shortest_path("alice", "charlie") == (0.5, ["alice", "charlie"])
    assert mini.dijkstra_shortest_path("charlie", "bob") == (2.0, ["charlie", "alice", "bob"])
    assert mini.bfs_shortest_path("bob", "alice") == ["bob", "charlie", "alice"] and mini.bfs_shortest_path("alice", "nobody") == []
    assert mini.dijkstra_shortest_path("alice", "nobody") == (float("inf"), [])
    d = graph(spark, ["a>b", "a>c", "b>d", "c>d", "d>e"])
    assert {tuple(r.path) for r in d.all_shortest_paths("a", "e").collect()} == {("a", "b", "d", "e"), ("a", "c", "d", "e")}
    assert [r.path for r in d.all_shortest_paths("a", "a").collect()] == [["a"]] and d.all_shortest_paths("e", "a").count() == 0
    assert d.bfs_shortest_path("e", "a", direction="in") == ["e", "d", "b", "a"]
    assert d.bfs_shortest_path("a", "e", edge_filter=lambda p: p["weight"] is None) == ["a", "b", "d", "e"]
    assert d.dfs_traverse("a") == ["a", "b", "d", "e", "c"]
    assert col(d.k_hop_neighbors("a", 2, "out"), "id", "dist") == {("b", 1), ("c", 1), ("d", 2)}
    assert col(d.descendants("b"), "id") == {"d", "e"} and col(d.ancestors("d"), "id") == {"a", "b", "c"}
    assert d.ego_graph("d", 1).number_of_edges() == 3


def test_cycles_and_order(spark, mini):
    d = graph(spark, ["a>b", "a>c", "b>d", "c>d"])
    assert not d.is_cyclic() and col(d.topological_sort(), "id", "level") == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    with pytest.raises(CycleError):
        d.find_cycle()
    assert not graph(spark, ["a-b", "b-c"]).is_cyclic() and graph(spark, ["a-b", "b-c", "a-c"]).is_cyclic()
    assert graph(spark, ["a-b", "a>b"]).is_cyclic() and mini.is_cyclic()
    c = graph(spark, ["x>a", "a>b", "b>c", "c>a", "c>y"])
    assert c.find_cycle() == [("a", ">", "b"), ("b", ">", "c"), ("c", ">", "a")]
    with pytest.raises(CycleError):
        c.topological_sort()
    with pytest.raises(CycleError):
        c.find_cycle("y")


def test_components(spark):
    g = graph(spark, ["a>b", "b>a", "b>c", "c>d", "d>c", "x-y"], ["lone"])
    assert col(g.connected_components(), "id", "component") == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "x"), ("lone", "lone")}
    assert col(g.strongly_connected_components(), "id", "component") == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("x", "x"), ("y", "x"), ("lone", "lone")}
    chain = graph(spark, [f"n{k:03d}>n{k + 1:03d}" for k in range(40)])
    assert col(chain.connected_components(), "component") == {"n000"}


def test_clustering(spark):
    k4 = graph(spark, [f"{a}-{b}" for a, b in itertools.combinations("abcd", 2)])
    assert col(k4.clustering(), "clustering") == {1.0} and k4.transitivity() == 1.0 and k4.average_clustering() == 1.0
    star = graph(spark, ["h-a", "h-b", "h-c", "a-b"])
    assert dict(col(star.clustering(), "id", "clustering")) == {"h": pytest.approx(1 / 3), "a": 1.0, "b": 1.0, "c": 0.0}
    w = graph(spark, ["a-b:1", "b-c:8", "a-c:8"])
    assert dict(col(w.clustering("weight"), "id", "clustering"))["a"] == pytest.approx((1 / 8) ** (1 / 3))
    assert dict(col(graph(spark, ["a>b", "b>c", "c>a"]).clustering(), "id", "clustering"))["a"] == pytest.approx(0.5)


def brute_betweenness(nodes, arcs):
    def paths(s, t):
        level, found = [[s]], []
        while level and not found:
            found = [p for p in level if p[-1] == t]
            level = [[*p, v] for p in level for u, v in arcs if u == p[-1] and v not in p]
        return found

    out = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.permutations(nodes, 2):
        ps = paths(s, t)
        for n in nodes:
            if n not in (s, t) and ps:
                out[n] += sum(n in p for p in ps) / len(ps)
    return out


def test_centrality(spark):
    rng = random.Random(3)
    nodes = list("abcdefg")
    edges = sorted({f"{a}{rng.choice('>-')}{b}" for a, b in (rng.sample(nodes, 2) for _ in range(12))})
    g = graph(spark, edges, nodes)
    arcs = {(e[0], e[2]) for e in edges} | {(e[2], e[0]) for e in edges if e[1] == "-"}
    got = dict(col(g.betweenness_centrality(normalized=False), "id", "betweenness"))
    want = brute_betweenness(nodes, arcs)
    assert got == pytest.approx(want)
    rank = dict(col(g.pagerank(), "id", "rank"))
    assert sum(rank.values()) == pytest.approx(1.0, abs=1e-6)
    sink = dict(col(graph(spark, ["a>b", "c>b"]).pagerank(tol=1e-10), "id", "rank"))
    assert sink["b"] > sink["a"] == pytest.approx(sink["c"])
    close = dict(col(graph(spark, ["a>b", "b>c"], ["z"]).closeness_centrality(), "id", "closeness"))
    assert close == {"a": 0.0, "b": pytest.approx(1 / 3), "c": pytest.approx(2 / 3 * 2 / 3), "z": 0.0}
    path = graph(spark, ["a-b", "b-c"])
    assert dict(col(path.degree_centrality(), "id", "centrality")) == {"a": 0.5, "b": 1.0, "c": 0.5}
    assert [r.betweenness for r in path.edge_betweenness_centrality().collect()] == [pytest.approx(4 * 2 / 6)] * 2


def test_exchange_and_upkeep(spark, mini, tmp_path):
    mini.export_graph(str(tmp_path))
    assert Graph.import_graph(spark, str(tmp_path)).number_of_edges() == 3
    broken = Graph(mini.nodes.where("id <> 'bob'"), mini.edges)
    assert col(broken.verify_index(), "src", "dst") == {("alice", "bob"), ("bob", "charlie")} and broken.reindex().number_of_edges() == 1
    tagged = Graph(mini.nodes, mini.edges.selectExpr("*", "if(src = 'bob', 'knows', 'likes') AS relation"))
    assert dict(col(tagged.boost_edge_weights("knows", 1.0).edges, "src", "weight"))["bob"] == 3.0


def test_batches_of_sources_add_up(spark, monkeypatch):
    from tessera.operators import graph

    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")], "src string, dst string")
    g = graph.Graph.from_edges(edges)
    found = lambda: [sorted(map(tuple, df.collect())) for df in (g.betweenness_centrality(), g.edge_betweenness_centrality(), g.closeness_centrality())]
    whole = found()
    monkeypatch.setattr(graph, "SEARCH_PAIRS", 9)
    assert len(g._batches()) == 3 and found() == whole


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_that_meet_are_counted_without_being_shuffled(spark, monkeypatch):
    from tessera.operators import meeting

    rng = random.Random(5)
    names = [f"n{k}" for k in range(60)] + ["é", "z" * 40, "10", "9"]
    links = {tuple(sorted(rng.sample(names, 2))) for _ in range(500)} | {tuple(sorted(("hub", n))) for n in names}
    g = graph(spark, [f"{a}-{b}" for a, b in links])
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for a, b in itertools.combinations(sorted(near, key=str.encode), 2):
        if near[a] & near[b]:
            want[a, b] = (len(near[a] & near[b]), len(near[a] & near[b]) / len(near[a] | near[b]))
    found = lambda: {(r.a, r.b): (r.common, r.jaccard) for r in g.common_counts().collect()}
    assert found() == want
    monkeypatch.setattr(meeting, "PAIRS", 400)
    monkeypatch.setattr(meeting, "STEP", 64)
    assert found() == want
    assert g.common_counts().count() == len(want)
    # Pairs come out of the last task: no exchange or join stands above what makes them.
    assert "Exchange" not in plan_of(g.common_counts()).split("MapInArrow")[0]
    assert graph(spark, ["a-b"]).common_counts().count() == 0


def test_a_task_with_more_pairs_than_it_sorts_at_once(spark, monkeypatch):
    from tessera.operators import meeting

    near = spark.createDataFrame([(v, f"u{k}", 9) for v, m in (("v", 30), ("w", 20), ("x", 1)) for k in range(m)], "v string, u string, n int")
    batches = meeting._deal(near, 1, False).drop("task").toArrow().to_batches()
    monkeypatch.setattr(meeting, "PAIRS", 50)
    monkeypatch.setattr(meeting, "STEP", 16)
    rows = [r for b in meeting._count(iter(batches)) for r in b.to_pylist()]
    assert {(r["a"], r["b"]): r["common"] for r in rows} == {
        (a, b): 1 + (int(a[1:]) < 20 and int(b[1:]) < 20) for a, b in itertools.combinations(sorted(f"u{k}" for k in range(30)), 2)
    }
    assert len(rows) == 435 and {r["jaccard"] for r in rows} == {1 / 17, 2 / 16}


def joins(df):
    return len([line for line in plan_of(df).split("Initial Plan")[0].splitlines() if "Join" in line])


@pytest.fixture(scope="module")
def woven(spark):
    """Random edges of both kinds: (src, kind, dst) and the graph."""
    rng = random.Random(11)
    names = [f"n{k}" for k in range(40)] + ["é", "10", "9"]
    edges = {tuple(rng.sample(names, 2)) for _ in range(380)} | {("hub", n) for n in names}
    return edges, graph(spark, [f"{a}>{b}" for a, b in edges])


def test_directed_triangles_carry_their_multiplicities(woven):
    edges, g = woven
    m = {}
    for a, b in edges:
        m[a, b] = m.get((a, b), 0) + 1
        m[b, a] = m.get((b, a), 0) + 1
    want = {}
    for n in {a for a, _ in m}:
        near = [b for a, b in m if a == n]
        closed = sum(m[n, x] * m[n, y] * m[x, y] for x, y in itertools.permutations(near, 2) if (x, y) in m)
        d = sum(m[n, x] for x in near)
        want[n] = closed / (2 * (d * (d - 1) - 2 * sum(m[n, x] == 2 for x in near)))
    assert dict(col(g.clustering(), "id", "clustering")) == pytest.approx(want)
    assert joins(g.clustering()) == 2  # nodes with degrees and sums; none on triangles


@pytest.fixture(scope="module")
def plain(spark, woven):
    """The same pairs without directions, weighted, and their neighbour sets."""
    weight = {tuple(sorted(e)): 1.0 + len("".join(e)) for e in woven[0]}
    near = {}
    for a, b in weight:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return weight, near, graph(spark, [f"{a}-{b}:{w}" for (a, b), w in weight.items()])


def test_triangles_are_closed_where_wedges_are_made(plain, monkeypatch):
    from tessera.operators import meeting

    weight, near, g = plain
    w = lambda *e: weight[tuple(sorted(e))] / max(weight.values())
    share = {n: [(x, y) for x, y in itertools.combinations(s, 2) if y in near[x]] for n, s in near.items()}
    room = {n: len(s) * (len(s) - 1) / 2 for n, s in near.items()}
    for _ in range(2):
        assert dict(col(g.clustering(), "id", "clustering")) == pytest.approx({n: len(t) / room[n] for n, t in share.items()})
        weighted = {n: sum((w(n, x) * w(n, y) * w(x, y)) ** (1 / 3) for x, y in t) / room[n] for n, t in share.items()}
        assert dict(col(g.clustering("weight"), "id", "clustering")) == pytest.approx(weighted)
        monkeypatch.setattr(meeting, "PAIRS", 300)
    assert joins(g.clustering()) == joins(g.clustering("weight")) == 2


def test_transitivity_shuffles_no_wedges(spark, plain):
    _, near, g = plain
    found = {tuple(sorted((a, b, c), key=str.encode)) for a in near for b, c in itertools.combinations(near[a], 2) if c in near[b]}
    rows = g.triangles().collect()
    assert {tuple(r) for r in rows} == found and len(rows) == len(found)
    assert g.transitivity() == pytest.approx(3 * len(found) / sum(len(s) * (len(s) - 1) / 2 for s in near.values()))
    assert "Exchange" not in plan_of(g.triangles()).split("MapInArrow")[0]
    assert graph(spark, ["a-b", "c-d"]).transitivity() == 0.0
