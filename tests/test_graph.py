"""Operators, scans, stores and handles on small inputs."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import __spark_entry__
from codeloom.api import Class, File, Function, Manager
from codeloom.functions import names, pysource
from codeloom.operators import filters, graph, joins, rollups, trees
from codeloom.plans import sample, scan
from codeloom.sources import files
from codeloom.sources.store import GraphStore
from codeloom.streaming import updates


def ids(df, column="id"):
    return sorted(r[column] for r in df.select(column).collect())


def edges(spark, *pairs):
    return spark.createDataFrame([(f"e{i}", a, b) for i, (a, b) in enumerate(pairs)], "id string, from_id string, to_id string")


def nodes(spark, *names_):
    return spark.createDataFrame([(n, n.split("/")[0], n) for n in names_], "id string, node_type string, name string")


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_neighbours_directions_loops_and_missing_nodes(spark):
    e, n = edges(spark, ("a/1", "b/1"), ("a/1", "b/1"), ("b/1", "a/1"), ("a/1", "a/1"), ("a/1", "gone")), nodes(spark, "a/1", "b/1")
    assert ids(joins.neighbours(e, n, "a/1")) == ["a/1", "b/1", "b/1"]
    assert ids(joins.neighbours(e, n, "a/1", "INBOUND")) == ["a/1", "b/1"]
    assert ids(joins.neighbours(e, n, "a/1", "ANY")) == ["a/1", "a/1", "b/1", "b/1", "b/1"]
    assert ids(joins.neighbours(e, n, "a/1", node_type="b")) == ["b/1", "b/1"]
    assert filters.dangling_edges(e, n).count() == 1
    with pytest.raises(ValueError, match="direction"):
        joins.neighbours(e, n, "a/1", "SIDEWAYS")


def test_descendants_paths_cycles_and_depth(spark):
    e = edges(spark, ("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("c", "r"))
    got = sorted((r["id"], r["parent_id"], r["depth"]) for r in graph.descendants(e, "r", max_depth=3).collect())
    assert got == [("a", "r", 1), ("b", "r", 1), ("c", "a", 2), ("c", "b", 2), ("r", "c", 3), ("r", "c", 3)]
    assert sorted((r["id"], r["depth"]) for r in graph.descendants(e, "r", max_depth=100, distinct=True).collect()) == [("a", 1), ("b", 1), ("c", 2)]
    assert graph.descendants(e, "r", max_depth=100).count() < 20
    assert graph.descendants(e, "nowhere").count() == 0


def test_nested_tree_rejects_cycles():
    tree = graph.nested_tree({"id": "r"}, [{"id": "a", "parent_id": "r"}, {"id": "b", "parent_id": "a"}, {"id": "a", "parent_id": "r"}])
    below = {"id": "a", "children": [{"id": "b", "children": []}]}
    assert tree == {"id": "r", "children": [below, below]}  # a child stands there once a row, as parallel edges give it
    with pytest.raises(ValueError, match="cycle"):
        graph.nested_tree({"id": "r"}, [{"id": "a", "parent_id": "r"}, {"id": "r", "parent_id": "a"}])


def test_nearest_definition(spark):
    uses = spark.createDataFrame([("u1", "f", "x"), ("u2", "f", "y"), ("u3", "f", "z")], "use_id string, scope_id string, name string")
    parents = spark.createDataFrame([("f", "m"), ("m", "p")], "scope_id string, parent_id string")
    definitions = spark.createDataFrame([("f", "x", "d1"), ("m", "x", "d2"), ("p", "y", "d3")], "scope_id string, name string, definition_id string")
    assert sorted(map(tuple, graph.nearest_definition(uses, parents, definitions).collect())) == [("u1", "d1", 0), ("u2", "d3", 2)]


def test_local_names(spark):
    q = lambda *x: spark.createDataFrame([(v,) for v in x], "target_qname string")
    known = q("my.utils", "my.auth.handlers").withColumnRenamed("target_qname", "qname")
    targets = q("my.utils", "my.utils.helper", "my.auth", "my", "fastapi", "my.other", "my.utilsx")
    assert ids(joins.local(targets, known), "target_qname") == ["my", "my.auth", "my.utils", "my.utils.helper"]
    assert ids(joins.external(targets, known), "target_qname") == ["fastapi", "my.other", "my.utilsx"]


def test_as_of_takes_the_last_before_and_the_first(spark):
    uses = spark.createDataFrame([("f", 5), ("f", 2), ("f", 3), ("g", 9)], "k string, seq long")
    binds = spark.createDataFrame([("f", 2, "a"), ("f", 4, "b"), ("f", 7, "c")], "k string, seq long, v string")
    got = sorted((r["seq"], r["bound"], r["first"]) for r in joins.as_of(uses, binds, ["k"], F.col("v"), F.col("v")).collect())
    assert got == [(3, "a", "a"), (5, "b", "a")]


def test_as_of_in_buckets_equals_one_order(spark):
    rng = random.Random(3)
    key = lambda: rng.choice(["hot", "hot", "hot", "g", None])
    seqs = rng.sample(range(300), 120)
    uses = spark.createDataFrame([(key(), rng.choice([None, rng.randrange(300)]) if i % 20 == 0 else rng.randrange(300), i) for i in range(150)], "k string, seq long, n long")
    binds = spark.createDataFrame([(key(), None if i == 0 else s, None if i % 7 == 0 else f"v{i}") for i, s in enumerate(seqs)], "k string, seq long, v string")
    rows = lambda **more: sorted(map(repr, joins.as_of(uses, binds, ["k"], F.col("v"), F.col("v"), **more).collect()))
    whole = rows()
    assert whole
    for width in (1, 7, 100, 1000):
        assert rows(bucket=F.floor(F.col("seq") / width)) == whole


def test_names(spark):
    df = spark.createDataFrame([("models/user.py", "models"), ("a/b.pyc.py", ""), ("models/models.py", "models"), ("a/data.py", "a")], "p string, c string")
    assert [r[0] for r in df.select(names.module_name(F.col("p"))).collect()] == ["models.user", "a.bc", "models.models", "a.data"]
    assert [r[0] for r in df.select(names.legacy_file_name(F.col("p"), F.col("c"))).collect()][2:] == ["", "dt"]
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(names.relative_base(F.lit("a.b.c"), F.lit(1))) == "a.b"
    assert value(names.relative_base(F.lit("a.b"), F.lit(2))) == ""
    assert value(names.prefixes(F.lit("a.b.c"))) == ["a", "a.b", "a.b.c"]
    assert value(names.placeholder_id(F.lit("numpy.array"))) == "package_numpy_array"
    assert value(names.append_new(F.array(F.lit("a")), F.lit("a"))) == ["a"]


def test_trees(spark):
    paths = spark.createDataFrame([("a/b/x.py",), ("a/y.py",), ("/z.py",), ("a/b/x.py",), (None,)], "path string")
    items = trees.tree(paths)
    assert {(r["path"], r["parent_path"], r["depth"], r["is_file"]) for r in items.collect()} == {("a", "", 1, False), ("a/b", "a", 2, False), ("a/b/x.py", "a/b", 3, True), ("a/y.py", "a", 2, True), ("z.py", "", 1, True)}
    assert trees.nested(items) == {"a": {"b": {"x.py": None}, "y.py": None}, "z.py": None}
    assert [r["line"] for r in trees.lines(items).collect()] == ["a/", "  b/", "    x.py", "  y.py", "z.py"]
    assert {r["path"] for r in trees.tree(paths, base="a").collect()} == {"b", "b/x.py", "y.py", "z.py"}


def test_package_rollup_keeps_first_order(spark):
    rows = spark.createDataFrame([("np.b", 2), ("np.a", 5), ("np.b", 9), ("np", 3), ("os", 1)], "target_qname string, seq long")
    assert {r["base"]: r["imported_paths"] for r in rollups.packages(rows).collect()} == {"np": ["np.b", "np", "np.a"], "os": ["os"]}


@pytest.mark.parametrize(
    ("pattern", "hit", "miss"),
    [("*.md", "a/b.md", "b.mdx"), ("build/", "x/build/y", "build.py"), ("/top.py", "top.py", "a/top.py"), ("a/**/z", "a/b/c/z", "b/z"), ("x?.py", "x1.py", "x.py"), ("[!a]b", "cb", "ab")],
)
def test_ignore_patterns(spark, pattern, hit, miss):
    df = spark.createDataFrame([(hit,), (miss,)], "p string").where(files.ignored(F.col("p"), [pattern]))
    assert [r["p"] for r in df.collect()] == [hit]


def write(root, sources):
    for path, text in sources.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text) if isinstance(text, str) else (root / path).write_bytes(text)
    return str(root)


def test_files_patterns_and_bad_bytes(spark, tmp_path):
    root = write(tmp_path / "p", {"a.py": "x=1", "b/c.py": "y", "b/__init__.py": "", "b/d.md": "", "build/e.py": "", "bad.py": b"\xff\xfe"})
    (tmp_path / "ignore.toml").write_text('[ignore]\npatterns = ["build/", "*.md", "__init__.py"]\n')
    (tmp_path / "lines").write_text("# no\nbuild/\n*.py\n!a.py\n")
    patterns = files.read_patterns(spark, str(tmp_path / "ignore.toml"))
    found = files.find_files(spark, root, suffixes=[".py"], patterns=patterns)
    assert ids(found, "path") == ["a.py", "b/c.py", "bad.py"]
    good, bad = files.read_sources(found)
    assert ids(good, "module") == ["a", "b.c"] and ids(bad, "path") == ["bad.py"]
    assert ids(files.find_files(spark, root, patterns=files.read_patterns(spark, str(tmp_path / "lines"))), "path") == ["a.py", "b/d.md"]
    assert files.read_patterns(spark, str(tmp_path / "none")) == []


def uses(spark, sources, **options):
    rows = [(p, p.removesuffix(".py").replace("/", "."), t) for p, t in sources.items()]
    g = scan.scan_sources(spark, "proj", spark.createDataFrame(rows, "path string, module string, content string"), **options)
    n = g.nodes.select(F.col("id").alias("from_id"), F.col("qname").alias("consumer"))
    e = g.edges.where("edge_type = 'uses_import'").join(n, "from_id")
    return g, sorted((r["consumer"], r["target_qname"]) for r in e.collect())


def test_usage_semantics(spark):
    g, got = uses(spark, {
        "m.py": "import numpy as np, os.path\nfrom . import near\nfrom .sib import t\nfrom x import *\n"
        "def f():\n    np.random.seed\n    np.get(1).json(np.x)\n    os.path.join\n    t\n    near.thing\n    late\n"
        "    def inner():\n        np.hidden\n"
        "import late\nnp.top\nnp.a.b = 1\n"
        "class C:\n    v = late.y\n    async def a(self):\n        return np.z\n    class D:\n        w = np.w\n        def m(self):\n            return np.q\n",
        "broken.py": "def (",
    })
    f = [t for c, t in got if c == "m.f"]
    assert sorted(f) == sorted(["numpy.random.seed", "numpy.random", "numpy", "numpy.x", "numpy", "sib.t", "near.thing", "near"])
    assert sorted(t for c, t in got if c == "m.C") == sorted(["late.y", "late", "numpy.z", "numpy", "numpy.w", "numpy"])
    assert {c for c, _ in got} == {"m.f", "m.C"}
    declared = ids(g.nodes.where("node_type IN ('class', 'function')"), "qname")
    assert declared == ["m.C", "m.C.m", "m.D", "m.D.m", "m.f"]
    assert [(r["path"], r["kind"]) for r in g.issues.collect()] == [("broken.py", "unparsed")]


def test_local_targets_rebinding_and_strict_relative(spark):
    sources = {
        "pkg/a.py": "from .b import g\nfrom pkg.b import missing\nimport json as j\ndef f():\n    g()\n    missing()\n    j.x\n    import yaml as j\n    j.y\n",
        "pkg/b.py": "def g():\n    pass\n",
    }
    g, got = uses(spark, sources)
    assert got == sorted([("pkg.a.f", x) for x in ("b.g", "json.x", "json", "yaml.y", "yaml")])
    assert [(r["kind"], r["detail"]) for r in g.issues.collect()] == [("dropped", "pkg.b.missing")]
    lines = {r["target_qname"]: r["import_position"]["line_no"] for r in g.edges.where("edge_type = 'uses_import'").collect()}
    assert lines["json"] == lines["yaml"] == 3
    _, got = uses(spark, sources, strict_relative=True)
    assert ("pkg.a.f", "pkg.b.g") in got


def test_extracted_calls_assignments_and_flow(spark):
    df = spark.createDataFrame([("m.py", "m", "def f(x):\n    if x:\n        y = C()\n    for i in x:\n        y.go(i)\n")], "path string, module string, content string")
    rows = pysource.extract(df)
    assert [(r["name"], r["chain"]) for r in rows.where("kind = 'assign'").collect()] == [("y", ["C"])]
    assert sorted(r["name"] for r in rows.where("kind = 'call'").collect()) == ["C", "go"]
    assert sorted((r["name"], r["alias"]) for r in rows.where("kind = 'flow'").collect()) == [("for", None), ("if", "implicit_else")]
    counts = rollups.import_counts(pysource.extract(spark.createDataFrame([("m.py", "m", "import a\nfrom b import c, d\na\n")], df.schema))).first()
    assert (counts["total_imports"], counts["regular_imports"], counts["from_imports"], counts["usages"], counts["with_consumer"]) == (2, 1, 1, 1, 0)
    pysource.register(spark)
    assert spark.sql("SELECT kind FROM python_source('import a')").collect()[0][0] == "import"


def test_scan_of_a_folder_is_repeatable(spark, tmp_path):
    root = write(tmp_path / sample.PROJECT, sample.SOURCES)
    manager = Manager(spark, str(tmp_path / "db"))
    project = manager.create_project_with_scan(root)
    once = manager.store.nodes.read().count(), manager.store.edges.read().count()
    assert once == (16, 37) and manager.create_project_with_scan(root).id == project.id
    assert (manager.store.nodes.read().count(), manager.store.edges.read().count()) == once
    tree = project.descendant_tree()
    assert [c["name"] for c in tree["children"]] == ["app.py", "helpers.py", "store"]
    app = next(f for f in project.files() if f.name == "app.py")
    assert sorted(x.name for x in app.functions()) == ["__init__", "run", "start"] and [x.name for x in app.classes()] == ["App"]
    assert manager.store.sql("SELECT count(*) AS n FROM {edges} WHERE edge_type = :kind", {"kind": "uses_import"}).first()["n"] == 9
    assert filters.invalid_nodes(manager.store.nodes.read()).count() == 0


def test_handles(spark, tmp_path):
    manager = Manager(spark, str(tmp_path / "db"))
    project = manager.create_project("one", "/one/")
    src = project.add_folder("src", "/one/src/")
    main = src.add_file("main.py", "/one/src/main.py")
    assert (src.qname, main.qname, main.absolute_path) == ("src", "src.main", "/one/src/main.pymain.py")
    f, c = main.add_function("go", (1, 0, 2, 5)), main.add_class("K", (3, 0, 9, 1))
    method = c.add_method("new", (4, 4, 5, 8))
    assert method.qname.endswith("K::new") and [m.name for m in c.methods()] == ["new"]
    f.add_call(c, (2, 4, 2, 7))
    call = manager.store.edges.find_one({"edge_type": "calls"})
    assert call["to_id"] == c.id and tuple(call["position"]) == (2, 4, 2, 7)
    with pytest.raises(TypeError):
        f.add_call(main, (0, 0, 0, 0))
    value = {"name": "p", "type": "int", "default": 0, "position": {"line_no": 1}}
    f.add_input(**value)
    f.add_input(name="q", type="str")
    assert f.inputs == [value, {"name": "q", "type": "str"}] and f.outputs == []
    c.add_field(name="x")
    assert c.fields == [{"name": "x"}]
    package = manager.get_or_create_package("numpy")
    with pytest.raises(TypeError):
        f.uses_import(src, target_symbol="s", import_position=(0, 0, 0, 0), usage_positions=[])
    f.uses_import(package, target_symbol="np", import_position=(1, 0, 1, 5), usage_positions=[(2, 0, 2, 2)], alias="np")
    assert manager.get_or_create_package("numpy", "2.0").version == "2.0"
    assert manager.store.edges.find({"edge_type": "contains"}).count() == 4
    assert isinstance(project.folders()[0].files()[0], File) and project.files() == []
    assert [p.name for p in manager.projects()] == ["one"] and manager.load_project(project.id).name == "one"
    with pytest.raises(ValueError, match="no project"):
        manager.load_project("project/none")
    with pytest.raises(TypeError):
        manager.load_project(main.id)
    assert isinstance(f, Function) and isinstance(c, Class)


def test_store_writes(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"))
    assert store.nodes.read().count() == 0 and store.nodes.get("x") is None
    rows = spark.createDataFrame([("class/1", "class", "A", (1, 2, 3, 4)), ("class/2", "class", "B", None)], "id string, node_type string, name string, position struct<line_no:int,col_offset:int,end_line_no:int,end_col_offset:int>")
    store.nodes.insert(rows)
    store.nodes.update(spark.createDataFrame([("class/1", "Z", (9, None, None, None)), ("class/9", "no", None)], "id string, name string, position struct<line_no:int,col_offset:int,end_line_no:int,end_col_offset:int>"))
    row = store.nodes.get("1")
    assert (row["name"], tuple(row["position"]), row["node_type"]) == ("Z", (9, 2, 3, 4), "class")
    store.nodes.insert(spark.createDataFrame([("class/1", "class", "new")], "id string, node_type string, name string"))
    assert store.nodes.get("class/1")["position"] is None and store.nodes.find({"position": None}).count() == 2
    store.nodes.delete(spark.createDataFrame([("class/1",)], "id string"))
    assert ids(store.nodes.read()) == ["class/2"] and store.nodes.find({}, limit=1).count() == 1
    again = spark.createDataFrame([("class/3", "class", "x"), ("class/3", "class", "y"), ("class/3", "class", None)], "id string, node_type string, name string")
    GraphStore(spark, str(tmp_path / "g")).nodes.insert(again)  # another writer
    assert store.nodes.get("class/3")["name"] == "y"
    assert ids(store.nodes.copied(str(tmp_path / "h"), 3).read()) == ["class/2", "class/3"]
    store.truncate()
    assert store.nodes.find_one() is None
    store.nodes.insert(again)
    assert ids(store.nodes.read()) == ["class/3"]
    with pytest.raises(PySparkException):
        store.sql("SELECT nothing FROM {nodes}")


def test_names_at_the_boundary(spark):
    df = spark.createDataFrame([("i", "a", "b")], "id string, from_id string, to_id string")
    out = filters.to_external(df)
    assert out.columns == ["_id", "_from", "_to"] and filters.from_external(out).columns == df.columns
    assert filters.with_parent(df.withColumn("parent_id", F.lit("p"))).first()["vertex"]["id"] == "i"
    assert filters.resolved_uses(spark.createDataFrame([("uses_import", "a"), ("uses_import", ""), ("calls", "b")], "edge_type string, target_qname string")).count() == 1


def test_stream_of_sources(spark, tmp_path):
    root = write(tmp_path / "in", {"a.py": "import os\n", "b.txt": "no"})
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for more in ({}, {"c.py": "import sys\n"}):
        write(tmp_path / "in", more)
        updates.keep_rows(updates.source_stream(spark, root), out, mark).awaitTermination(60)
    assert ids(spark.read.parquet(out), "name") == ["os", "sys"]
