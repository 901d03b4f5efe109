"""Listing and reading of source files, by tasks and as a data source."""

import json
import os

import pytest
from pyspark.sql import functions as F

from codeloom.sources import datasource, files

TREE = {"a.py": "x", "__init__.py": "", ".hidden.py": "h", "b/c.py": "yy", "b/__init__.py": "", "b/d/e/f.py": "zzz", "b/d/g.md": "m", "build/h.py": "b", "k/l.txt": ""}


@pytest.fixture
def root(tmp_path):
    for path, text in TREE.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "empty" / "deep").mkdir(parents=True)
    return str(tmp_path)


def paths(df):
    return sorted(r["path"] for r in df.select("path").collect())


@pytest.mark.parametrize("at_once", [1, 64])
def test_listing_by_levels(spark, root, at_once):
    found = files.listed(spark, root, at_once=at_once)
    assert {(r["path"], r["length"]) for r in found.collect()} == {(p, len(t)) for p, t in TREE.items()}
    assert files.listed(spark, f"{root}/nowhere").count() == 0
    assert paths(files.find_files(spark, f"file://{root}", suffixes=[".py"], patterns=["build/"])) == sorted(p for p in TREE if p.endswith(".py") and not p.startswith("build"))


def source(spark, root, **options):
    reader = spark.read.format(datasource.register(spark))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(root)


def test_data_source_takes_suffixes_and_patterns(spark, root):
    assert paths(source(spark, root)) == sorted(TREE)
    got = source(spark, root, suffixes='[".py"]', patterns=json.dumps(["b/", "!b/__init__.py", ".hidden.py"]))
    assert {r["path"]: bytes(r["content"]).decode() for r in got.collect()} == {"a.py": "x", "__init__.py": "", "b/__init__.py": "", "build/h.py": "b"}
    assert got.rdd.getNumPartitions() == 5  # the root's own files and four folders
    names = source(spark, root, content="false")
    assert names.where("content IS NOT NULL").count() == 0 and names.agg(F.sum("length")).first()[0] == sum(map(len, TREE.values()))
    assert source(spark, f"{root}/nowhere").count() == 0


def test_data_source_is_given_filters(spark, root):
    assert paths(source(spark, root).where(F.col("path").endswith("f.py") & (F.col("length") > 1))) == ["b/d/e/f.py"]
    assert paths(source(spark, root).where(F.col("path").startswith("b/d"))) == ["b/d/e/f.py", "b/d/g.md"]


def test_stream_brings_each_change_once(spark, root, tmp_path_factory):
    out = tmp_path_factory.mktemp("stream")

    def run():
        stream = spark.readStream.format(datasource.register(spark)).option("suffixes", '[".py"]').load(root)
        stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/mark").trigger(availableNow=True).start().awaitTermination(120)
        return paths(spark.read.schema(datasource.SCHEMA).parquet(f"{out}/rows"))

    first = sorted(p for p in TREE if p.endswith(".py"))
    assert run() == first
    with open(os.path.join(root, "b", "new.py"), "w") as f:
        f.write("n")
    with open(os.path.join(root, "a.py"), "w") as f:
        f.write("changed")
    assert run() == sorted([*first, "b/new.py", "a.py"])
    assert run() == sorted([*first, "b/new.py", "a.py"])
