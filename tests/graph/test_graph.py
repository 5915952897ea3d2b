import json
import random

import pytest
from pyspark.sql import functions as F

from loomgraph import config, service
from loomgraph.graph import CodeGraph, number
from loomgraph.operators import diff, enrich, evolve, explore, fetch, search
from loomgraph.operators.explore import Filter
from loomgraph.sources import facts, snapshot, store, walk
from loomgraph.streaming import watch

NODES = "node_id bigint, node_seq bigint, category string, kind string, language string, name string, path string, description string, features array<string>, feature_path string, semantic_feature string, node_level string"
EDGES = "edge_seq bigint, src bigint, dst bigint, edge_type string, metadata map<string,string>"


def node(i, category="function", name=None, path=None, level="low", feature=None):
    return (i, i, category, "fn", "rust", name if name is not None else f"n{i}", path, None, [], None, feature, level)


def make(spark, nodes, edges):
    return CodeGraph(spark.createDataFrame(nodes, NODES), spark.createDataFrame([(*e, None) for e in edges], EDGES))


@pytest.fixture(scope="module")
def small(spark):
    # 0 -> 1 -> 2 -> 0 is a cycle; 1 has a loop; 0 and 1 are joined twice; 3 hangs on 2; 4 is alone.
    edges = [(0, 0, 1, "calls"), (1, 1, 2, "calls"), (2, 2, 0, "imports"), (3, 1, 1, "calls"), (4, 0, 1, "contains"), (5, 2, 3, "depends_on")]
    return make(spark, [node(0), node(1, "type"), node(2), node(3), node(4)], edges)


def test_parallel_edges_and_loops(small):
    assert sorted(r.other_id for r in small.successors().where("node_id = 0").collect()) == [1, 1]
    assert small.edges_involving().where("node_id = 1").count() == 4  # the loop counts once
    between = {(r.src, r.dst): (r.edge_type, r.parallel) for r in small.edge_between().collect()}
    assert between[0, 1] == ("contains", 2)
    assert [(r.node_id, r.parent_id) for r in fetch.parents(small).collect()] == [(1, 0), (1, 0)]
    left = small.remove_edge_between(0, 1)
    assert sorted(r.edge_seq for r in left.edges.collect()) == [0, 1, 2, 3, 5]


def test_changes(spark, small):
    more = small.add_edges(spark.createDataFrame([(9, 0, 77, "calls", None), (10, 4, 0, "calls", None)], EDGES))
    assert more.edges.count() == 7  # an edge to a missing node is not added
    gone = small.remove_nodes(spark.createDataFrame([(1,)], "node_id bigint"))
    assert sorted(r.edge_seq for r in gone.edges.collect()) == [2, 5] and gone.nodes.count() == 4
    with pytest.raises(KeyError):
        fetch.fetch(small, name="nobody")
    assert fetch.fetch(small, name="n2").first().outgoing == [0, 3]


def walked(start, edges, passing, most=None):
    depth, frontier, d = {start: 0}, [start], 0
    if start not in passing:
        return {}
    out = {start: 0}
    while frontier and (most is None or d < most):
        d += 1
        found = sorted({b for a in frontier for x, b in edges if x == a and b not in depth})
        depth.update(dict.fromkeys(found, d))
        frontier = [b for b in found if b in passing]
        out.update(dict.fromkeys(frontier, d))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_exploration_against_a_queue(spark, seed):
    rng = random.Random(seed)
    kinds = [rng.choice(["function", "type", "module"]) for _ in range(40)]
    edges = [(i, rng.randrange(40), rng.randrange(40), "calls") for i in range(70)]
    graph = make(spark, [node(i, k) for i, k in enumerate(kinds)], edges)
    starts = spark.createDataFrame([(i,) for i in range(0, 40, 7)], "start bigint")
    passing = {i for i, k in enumerate(kinds) if k != "module"}
    filter_ = Filter(categories=("function", "type"), max_depth=3)
    for direction in ("outgoing", "incoming", "both"):
        pairs = {"outgoing": [(a, b) for _, a, b, _ in edges], "incoming": [(b, a) for _, a, b, _ in edges]}
        pairs["both"] = pairs["outgoing"] + pairs["incoming"]
        got = explore.explore(graph, starts, direction, filter_)
        found = {}
        for r in got.nodes.collect():
            found.setdefault(r.start, {})[r.node_id] = r.depth
        assert found == {s: w for s in range(0, 40, 7) if (w := walked(s, pairs[direction], passing, 3))}
        tree = [(r.start, r.dst) for r in got.edges.collect()]
        assert len(tree) == len(set(tree))  # one tree edge discovers a node


def test_depth_and_limit(spark, small):
    starts = spark.createDataFrame([(0,)], "start bigint")
    got = explore.dependencies(small, starts, 0)
    assert [r.node_id for r in got.nodes.collect()] == [0]
    assert [(r.src, r.dst, r.depth) for r in got.edges.collect()] == [(0, 1, 1)]  # edges reach one deeper
    assert explore.explore(small, starts, filter_=Filter(limit=0)).nodes.count() == 1
    assert explore.explore(small, starts, filter_=Filter(categories=("type",))).nodes.count() == 0


def test_search_boundaries(spark):
    rows = [node(0, name="a b c"), node(1, name="A  B"), node(2, name="login_user"), node(3, name="")]
    nodes = spark.createDataFrame(rows, NODES)
    assert [(r.node_id, round(r.score, 4)) for r in search.search(nodes, "a b").collect()] == [(1, 1.0), (0, 0.6667)]
    assert search.search(nodes, "  ").count() == 0 and search.search(nodes, "login").count() == 0
    ten = " ".join("abcdefghij")
    exact = spark.createDataFrame([node(0, name=ten)], NODES)
    assert search.search(exact, "a b c").count() == 1  # 3 of 10 meets 0.3 in 32 bits


def test_number(spark):
    rows = spark.createDataFrame([(i * 37 % 101,) for i in range(101)], "x bigint").repartition(7)
    got = {r.x: r.n for r in number(rows, "n", "x").collect()}
    assert got == {i: i + 1 for i in range(101)}


def test_units(spark):
    old = spark.createDataFrame([("f", "a", "function", 1, "1"), ("f", "a", "function", 5, "2"), ("f", "b", "struct", 9, "3")], "path string, name string, unit_type string, start_line int, hash string")
    new = spark.createDataFrame([("f", "a", "function", 2, "1"), ("f", "a", "function", 7, "9"), ("f", "a", "function", 8, "8")], old.schema)
    got = {(r.name, r.nth): r.change for r in diff.match_units(old, new).collect()}
    assert got == {("a", 1): "unchanged", ("a", 2): "changed", ("a", 3): "added", ("b", 1): "deleted"}


SOURCES = {
    "src/main.rs": "use crate::util::helper;\npub fn main() { helper(); Tool::build(); unknown(); }\n",
    "src/util.rs": '/// Helps.\npub fn helper() {}\npub struct Tool;\nextern "C" {\n    fn native_call(a: i32);\n}\n',
    "py/app.py": "class Base: pass\nclass Child(Base):\n    def run(self): return helper2()\ndef helper2(): pass\n",
    "py/broken.py": "def (:\n",
}


def tree(spark, sources):
    rows = [(p, walk.LANGUAGE_OF[p.rsplit(".", 1)[-1]], t) for p, t in sources.items()]
    return spark.createDataFrame(rows, "path string, language string, content string")


def named(graph):
    names = {r.node_id: (r.name, r.path) for r in graph.nodes.collect()}
    return {(r.edge_type, names[r.src][0], names[r.dst][0]) for r in graph.edges.collect()}


def test_encode(spark):
    made = facts.encode(tree(spark, SOURCES))
    assert (made.files_processed, made.files_skipped, made.is_complete) == (3, 1, False)
    assert [(r.path, r.category) for r in made.parse_errors.collect()] == [("py/broken.py", "syntax")]
    edges = named(made.graph)
    assert {
        ("contains", "src", "main.rs"),
        ("contains", "util.rs", "helper"),
        ("references", "crate::util::helper", "helper"),
        ("calls", "main.rs", "helper"),
        ("calls", "app.py", "helper2"),
        ("extends", "Child", "Base"),
        ("ffi_binding", "util.rs", "native_call"),
    } <= edges
    assert not any(x[2] == "unknown" for x in edges)
    ids = [r.node_id for r in made.graph.nodes.orderBy("node_seq").collect()]
    assert ids == list(range(len(ids)))
    help_ = made.graph.nodes.where("name = 'helper'").first()
    assert help_.documentation == "Helps." and help_.location.start_line == 2 and help_.category == "function"


def breadth_first(edges, start, direction, limit, max_depth):
    """(nodes, edges) in order of discovery, as a queue gives them."""
    seen, queue, nodes, tree = {start}, [(start, 0)], [], []
    while queue:
        at, depth = queue.pop(0)
        if max_depth is not None and depth > max_depth:
            continue
        nodes.append(at)
        if limit is not None and len(nodes) >= limit:
            break
        out = [(d, n) for n, s, d, _ in sorted(edges, reverse=True) if s == at] if direction != "incoming" else []
        into = [(s, n) for n, s, d, _ in sorted(edges, reverse=True) if d == at] if direction != "outgoing" else []
        for other, n in out + into:
            if other not in seen:
                seen.add(other)
                tree.append((at, other, n))
                queue.append((other, depth + 1))
    return nodes, tree


@pytest.mark.parametrize(("direction", "limit", "max_depth"), [("outgoing", 7, None), ("both", 12, None), ("both", 1, None), ("incoming", None, 2), ("both", 9, 2)])
def test_exploration_in_order_of_discovery(spark, direction, limit, max_depth):
    rng = random.Random(3)
    edges = [(n, rng.randrange(25), rng.randrange(25), "calls") for n in range(45)]
    graph = make(spark, [node(i) for i in range(25)], edges)
    starts = spark.createDataFrame([(i,) for i in range(0, 25, 4)], "start bigint")
    got = explore.explore(graph, starts, direction, explore.Filter(limit=limit, max_depth=max_depth))
    nodes, tree = {}, {}
    for r in got.nodes.collect():
        nodes.setdefault(r.start, set()).add(r.node_id)
    for r in got.edges.collect():
        tree.setdefault(r.start, set()).add((r.src, r.dst, r.edge_seq))
    for start in range(0, 25, 4):
        want = breadth_first(edges, start, direction, limit, max_depth)
        assert (nodes[start], tree.get(start, set())) == (set(want[0]), set(want[1]))


def test_walk(spark, tmp_path):
    for p, t in {**SOURCES, "README.md": "x", ".hidden.py": "x = 1", "target/gen.rs": "fn x() {}", ".gitignore": "target/\n", "src/Upper.RS": "fn", "own/.loomignore": "*.py\n", "own/x.py": "", ".git/info/exclude": "/local.rs\n", "local.rs": ""}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    got = {r.path: r for r in walk.walk(spark, str(tmp_path)).collect()}
    assert set(got) == {*SOURCES, ".hidden.py"} and got["src/main.rs"].content == SOURCES["src/main.rs"]
    every = walk.walk(spark, str(tmp_path), known_only=False, ignore=False, contents=False)
    assert every.count() == len(SOURCES) + 9
    assert walk.walk(spark, str(tmp_path), max_depth=1).count() == 1


def rows_of(graph):
    return sorted((r.node_id, r.name) for r in graph.nodes.collect()), sorted((r.src, r.dst, r.edge_type) for r in graph.edges.collect())


def test_store_replays_what_was_done(spark, tmp_path):
    made = facts.encode(tree(spark, SOURCES)).graph
    s = store.Store(spark, f"file://{tmp_path}/store", store.Threshold(patches=2))
    s.save_base(made)
    assert rows_of(s.load()) == rows_of(made) and not s.should_compact()
    node_type = next(f for f in spark.createDataFrame([], store.PATCH).schema if f.name == "node").dataType
    edge_type = spark.createDataFrame([], store.PATCH).schema["edge"].dataType
    schema = spark.createDataFrame([], store.PATCH).schema
    fresh = {f.name: None for f in node_type} | {"node_id": 500, "node_seq": 500, "name": "fresh", "category": "function", "kind": "fn", "language": "rust", "path": "new.rs", "node_level": "low"}
    edge = dict(zip(edge_type.names, (900, 500, 0, "calls", None), strict=True))
    main = made.nodes.where("name = 'main.rs'").first()
    s.write_patch(spark.createDataFrame([("delete_file", "src/util.rs", None, None), ("add_node", None, fresh, None), ("add_edge", None, None, edge)], schema))
    after = s.load()
    names = {r.name for r in after.nodes.collect()}
    assert "helper" not in names and {"fresh", "main"} <= names
    assert ("calls", "fresh", "root") in named(after) and not any(e[2] == "helper" for e in named(after))
    s.write_patch(spark.createDataFrame([("remove_node", None, {**fresh}, None), ("remove_node", None, {**fresh, "node_id": main.node_id}, None)], schema))
    direct = rows_of(s.load())
    assert "fresh" not in {n for _, n in direct[0]} and s.should_compact() and s.next_seq() == 3
    s.compact()
    assert rows_of(s.load()) == direct and s.manifest().patches == () and not s.exists("base/1")
    with pytest.raises(FileNotFoundError):
        store.Store(spark, f"file://{tmp_path}/none").load()


def shape(graph):
    """A graph without its numbers: nodes and edges by path, name and kind."""
    key = {r.node_id: (r.path, r.category, r.name, r.kind) for r in graph.nodes.collect()}
    return sorted(map(str, key.values())), sorted(str((r.edge_type, key[r.src], key[r.dst], r.metadata)) for r in graph.edges.collect())


def test_stream_evolves_the_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store", store.Threshold(ratio=100))
    tree_ = {k: v for k, v in SOURCES.items() if "broken" not in k}
    watch.start(s, tree(spark, tree_))
    changes = [("src/util.rs", None, True, 1), ("src/new.rs", "pub fn added() {}\npub fn helper() {}\n", False, 2), ("py/app.py", "def other(): pass\n", False, 3), ("py/app.py", "def last(): pass\n", False, 4)]
    spark.createDataFrame(changes, f"{watch.FILES}, modified bigint").coalesce(1).write.json(f"{tmp_path}/changes")
    for _ in range(2):  # a second run finds nothing new
        watch.watch(spark, f"{tmp_path}/changes", s, f"{tmp_path}/checkpoint", available_now=True).awaitTermination()
    graph = s.load()
    names = {r.name for r in graph.nodes.collect()}
    assert {"added", "last", "new.rs", "main"} <= names and not names & {"Tool", "other", "helper2", "native_call_"}
    edges = named(graph)
    assert ("contains", "new.rs", "added") in edges and ("references", "crate::util::helper", "helper") in edges
    assert s.manifest().patches == (1,) and s.manifest().batch == 0
    assert watch.apply_batch(s, spark.createDataFrame([], f"{watch.FILES}, modified bigint"), 0) is None
    want = {"src/new.rs": changes[1][1], "py/app.py": changes[3][1]} | {k: v for k, v in tree_.items() if k not in ("src/util.rs", "py/app.py")}
    assert shape(graph) == shape(facts.encode(tree(spark, want)).graph)


TREE = {
    "src/a.rs": "use crate::b::Tool;\npub struct Own;\nimpl Run for Own { fn go(&self) {} }\npub fn first(t: Tool) -> Own { helper(); Tool::make(); second() }\n",
    "src/b.rs": "pub struct Tool;\npub trait Run {}\nimpl Tool { pub fn make() {} }\npub fn helper() {}\nextern \"C\" {\n    fn native(a: i32);\n}\n",
    "src/c.rs": "pub fn second() { first(); }\n",
    "py/base.py": "class Base:\n    pass\n",
    "py/child.py": "from base import Base\nclass Child(Base):\n    def run(self, b: Base):\n        return work()\n",
}


def test_an_evolved_graph_is_that_of_the_new_tree(spark, tmp_path):
    steps = [
        {"src/b.rs": "// a comment\n" + TREE["src/b.rs"], "py/base.py": "class Base:\n    x = 1\n\ndef work():\n    return 1\n", "src/e.rs": "fn x() { first(); Tool::make(); }\n"},
        {"py/base.py": None, "py/child.py": None, "lib/d.rs": "pub fn helper() {}\npub fn work() {}\n", "src/c.rs": "pub fn second() {}\npub struct Tool;\n", "src/b.rs": TREE["src/b.rs"].replace("helper", "other")},
        {"src/a.rs": "fn (", "py/child.py": "def broken(:\n", "src/b.rs": None},
    ]
    s = store.Store(spark, f"file://{tmp_path}/store", store.Threshold(patches=2, ratio=100))
    watch.start(s, tree(spark, TREE))
    now = dict(TREE)
    for n, edits in enumerate(steps):
        batch = spark.createDataFrame([(p, t, t is None) for p, t in edits.items()], watch.FILES)
        watch.apply_batch(s, batch, n)
        now = {p: t for p, t in (now | edits).items() if t is not None}
        assert shape(s.load()) == shape(facts.encode(tree(spark, now)).graph)
        assert s.manifest().batch == n and watch.apply_batch(s, batch, n) is None
    assert s.manifest().base == 2 and s.manifest().patches == (1,)  # two patches were compacted


def test_enrichment(spark):
    assert enrich.extract_json('think {x}\n```json\n{"a": 1}\n```\nmore') == '{"a": 1}'
    assert enrich.extract_json('first [1]\n[{"a": "}]"}, 2] tail') == '[{"a": "}]"}, 2]'
    assert enrich.extract_json(" plain ") == "plain"
    nodes = spark.createDataFrame([node(1, name="run", path="src/a/b.rs"), node(2, name="run", path="src/a/b.rs")], NODES)
    prompts = spark.createDataFrame([("src/a/b.rs", "Describe\nrun"), ("src/a/b.rs", "Describe\nmissing")], "path string, prompt string")
    got = enrich.encode_semantics(nodes, prompts).collect()
    assert [(r.node_id, r.features, r.feature_path) for r in got] == [(1, ["handle run"], "A/B/Misc/run")]


def test_http_client():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            prompt = body["messages"][0]["content"]
            asked.append((prompt, body["model"], body["temperature"], self.headers["Authorization"]))
            code = {"bad": 400, "busy": 429 if sum(p == "busy" for p, *_ in asked) < 2 else 200}.get(prompt, 200)
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": f"to {prompt}"}}]}).encode() if code == 200 else b"")

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        config_ = enrich.Config(model="m", base_url=f"http://127.0.0.1:{server.server_port}/v1/", temperature=0.1)
        enrich.PAUSE = 0.01
        assert enrich.http_client(config_, "k")()(["a", "busy", "bad", "b"]) == ["to a", "to busy", "", "to b"]
    finally:
        server.shutdown()
    assert sorted(p for p, *_ in asked) == ["a", "b", "bad", "busy", "busy"]
    assert {x[1:] for x in asked} == {("m", 0.1, "Bearer k")}


def test_similar_pairs(spark):
    rng = random.Random(1)
    side = lambda n: [(i, sorted(set(rng.choices("abcdefghijklmnopqrst", k=rng.randint(0, 9))))) for i in range(n)]
    a, b = side(60), side(40)
    got = search.similar_pairs(spark.createDataFrame(a, "a bigint, tokens array<string>"), spark.createDataFrame(b, "b bigint, tokens array<string>"), 0.3)
    want = {(i, j) for i, x in a for j, y in b if x and y and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.3}
    assert {(r.a, r.b) for r in got.collect()} == want and want


def test_summary_of_a_diff(spark):
    graph = make(spark, [node(0, "file", "a.rs", "a.rs"), node(1, path="a.rs"), node(2, "file", "b.rs", "b.rs"), node(3, "component", level="high", feature="store")], [(0, 0, 1, "contains"), (1, 2, 1, "calls")])
    changes = spark.createDataFrame([("a.rs", "modified")], "path string, change string")
    fresh = spark.createDataFrame([node(0, "file", "a.rs", "a.rs"), node(1, name="fresh", path="a.rs", feature="key store")], NODES)
    after, summary = evolve.process_diff(graph, changes, lambda paths: fresh)
    assert (summary.files_modified, summary.nodes_created, summary.nodes_removed, summary.edges_removed, summary.feature_edges_relinked) == (1, 2, 2, 2, 1)
    assert named(after) == {("belongs_to_feature", "fresh", "n3")}


def test_snapshot(spark, tmp_path):
    files = tree(spark, {k: v for k, v in SOURCES.items() if "broken" not in k})
    taken = snapshot.take(facts.encode(files).graph, files, "repo")
    taken.save(f"{tmp_path}/snap")
    back = snapshot.load(spark, f"{tmp_path}/snap")
    stats = back.stats().first()
    assert (stats.files, stats.units) == (3, 6) and rows_of(back.graph) == rows_of(taken.graph)
    edited = dict(SOURCES) | {"src/main.rs": SOURCES["src/main.rs"] + "\n// only a comment\n", "src/util.rs": SOURCES["src/util.rs"].replace("helper() {}", "helper() { 1 }"), "new.rs": ""}
    del edited["py/broken.py"], edited["py/app.py"]
    later = tree(spark, edited)
    units = snapshot.take(facts.encode(later).graph, later, "repo").units
    assert {(r.path, r.change) for r in snapshot.changes(back, later, units).collect()} == {("py/app.py", "deleted"), ("new.rs", "added"), ("src/util.rs", "modified")}
    spark.createDataFrame([(7,)], "version int").write.mode("overwrite").parquet(f"{tmp_path}/snap/meta")
    with pytest.raises(ValueError):
        snapshot.load(spark, f"{tmp_path}/snap")


def test_service(spark, tmp_path):
    for p, t in SOURCES.items():
        (tmp_path / "repo" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "repo" / p).write_text(t)
    served = service.Service(spark, store.Store(spark, f"file://{tmp_path}/store"))
    with pytest.raises(LookupError):
        served.get_components()
    made = served.encode_repo(str(tmp_path / "repo")).first()
    assert (made.files_processed, made.files_skipped) == (3, 1)
    assert [r.name for r in served.search_nodes("HELPER", category="function").collect()] == ["helper"]
    one = served.search_nodes("main.rs").first().node_id
    assert {r.edge_type for r in served.get_node_details(one).collect()} >= {"contains", "calls"}
    assert [r.path for r in served.get_skeleton().collect()] == ["py/app.py", "src/main.rs", "src/util.rs"]
    assert served.get_graph_summary().first().languages == ["python", "rust", "unknown"]
    assert service.ignored_filters("typedef", "no_such") == ["edge type no_such"]


def test_config(tmp_path):
    (tmp_path / ".env").write_text("# a\nexport LOOMGRAPH_DATA_DIR='x y'\nLOOMGRAPH_HASH_MODE=other\nLOOMGRAPH_WATCH=true\n")
    (tmp_path / "sub").mkdir()
    got = config.from_env({"LOOMGRAPH_WORKSPACE": "w"}, tmp_path / "sub")
    assert got == config.Config("w", "x y", "mtime", True)


def test_number_where_ranges_would_differ(spark):
    """Wide rows in more ranges than one, which columns alone would be cut into otherwise."""
    changed = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        rows = spark.range(20000).select((F.xxhash64("id") % 5000).alias("a"), F.col("id").alias("b"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
        got = sorted((r.n, r.a, r.b) for r in number(rows, "n", ["a", "b"]).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    wanted = sorted((r.a, r.b) for r in rows.select("a", "b").collect())
    assert got == [(i, *x) for i, x in enumerate(wanted, 1)]


def test_files_are_spread_and_equal_texts_parsed_once(spark):
    """Of a table in one part come several, and each of them parses a text once for all its files."""
    turns = []  # of one task

    def parser(content, language):
        if content == "bad":
            raise SyntaxError("no")
        turns.append(content)
        return {"definitions": [{"name": f"{content}_{len(turns)}", "metadata": {"a": "b"}}]}

    texts = {i: ("bad", "x", "y", None)[i % 4] for i in range(400)}
    files = spark.createDataFrame([(f"p/{i}", "rust", text) for i, text in texts.items()], "path string, language string, content string").coalesce(1)
    parsed = facts.parse_files(files, parser)
    assert parsed.rdd.getNumPartitions() >= 4
    rows = {int(r.path[2:]): r for r in parsed.collect()}
    assert set(rows) == set(texts)
    for i, text in texts.items():
        r = rows[i]
        assert (r.category, len(r.definitions)) == ({"bad": "syntax", None: "io"}.get(text), text in ("x", "y"))
        assert text not in ("x", "y") or (r.definitions[0].name[0], r.definitions[0].metadata) == (text, {"a": "b"})
    assert len({r.definitions[0].name for r in rows.values() if r.definitions}) < 200


def test_a_patch_sorts_edges_once(small):
    """Edges of both graphs are compared without a join; parallel edges of a key that loses one are put again."""
    new = CodeGraph(small.nodes, small.edges.where("edge_seq <> 0"))
    patch = store.changes_between(small, new)
    assert patch._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2  # of nodes
    assert sorted((r.op, r.edge.edge_seq, r.edge.src, r.edge.dst, r.edge.edge_type) for r in patch.collect()) == [("remove_edge", None, 0, 1, "calls")]
    twice = small.edges.unionAll(small.edges.where("edge_seq = 0").selectExpr("10L AS edge_seq", "src", "dst", "edge_type", "metadata"))
    back = store.changes_between(CodeGraph(small.nodes, twice), small)
    assert sorted((r.op, r.edge.edge_seq or 0) for r in back.collect()) == [("add_edge", 0), ("remove_edge", 0)]


def test_similar_pairs_drop_sizes_that_cannot_fit(spark):
    """Sets of 3 and of 10 just fit at 0.3; of 11 they do not, and go before any join."""
    sets = lambda *sizes: [(n, [f"t{i}" for i in range(n)]) for n in sizes]
    pairs = search.similar_pairs(spark.createDataFrame(sets(3, 10, 11, 500), "a bigint, tokens array<string>"), spark.createDataFrame(sets(3), "b bigint, tokens array<string>"), 0.3)
    assert sorted((r.a, r.b) for r in pairs.collect()) == [(3, 3), (10, 3)]
    assert "_most" in pairs._jdf.queryExecution().optimizedPlan().toString()
