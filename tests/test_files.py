"""Graph files that an XML reader opens, file listings that differ, files that can't be read."""

import os
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from folioflow.sources import discovery, sinks


def graph(spark):
    nodes = spark.createDataFrame([(i, f"A <{i}> & \"b\" 'c'", "document") for i in range(50)], "id long, label string, kind string").repartition(5)
    edges = spark.createDataFrame([(i, j, i / 4) for i in range(50) for j in (1, 2, 3) if i > j], "source long, target long, weight double").repartition(7)
    return nodes, edges


def test_single_graph_files(spark, tmp_path):
    nodes, edges = graph(spark)
    want = [(r.source, r.target, r.weight) for r in edges.orderBy("source", "target").collect()]
    sinks.write_single(sinks.graphml(nodes, edges), f"{tmp_path}/g.graphml")
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    root = ET.parse(f"{tmp_path}/g.graphml").getroot()
    assert [k.get("id") for k in root.iter(f"{ns}key")] == ["label", "type", "weight"] and root.find(f"{ns}graph").get("edgedefault") == "directed"
    found = [(n.get("id"), [x.text for x in n]) for n in root.iter(f"{ns}node")]
    assert found == [(str(i), [f"A <{i}> & \"b\" 'c'", "document"]) for i in range(50)]
    assert [(e.get("id"), int(e.get("source")), int(e.get("target")), float(e[0].text)) for e in root.iter(f"{ns}edge")] == [(f"e{i}", *e) for i, e in enumerate(want)]
    sinks.write_single(sinks.gexf(nodes, edges), f"{tmp_path}/g.gexf")
    ns = "{http://www.gexf.net/1.2draft}"
    root = ET.parse(f"{tmp_path}/g.gexf").getroot()
    assert [n.get("label") for n in root.iter(f"{ns}node")] == [f"A <{i}> & \"b\" 'c'" for i in range(50)]
    assert [(int(e.get("source")), int(e.get("target")), float(e.get("weight"))) for e in root.iter(f"{ns}edge")] == want
    sinks.write_single(sinks.gexf(nodes.limit(0), edges.limit(0)), f"{tmp_path}/none.gexf")
    assert list(ET.parse(f"{tmp_path}/none.gexf").getroot().iter(f"{ns}node")) == []


def test_listings_and_quarantine(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "node_modules").mkdir(parents=True)
    files = {"a.txt": b"first", "b.txt": b"second", "c.txt": "dritte é".encode(), "node_modules/x.txt": b"never", "d.md": b"other"}
    for name, raw in files.items():
        (folder / name).write_bytes(raw)
    before = discovery.listing(spark, str(folder), "*.txt")
    held = spark.createDataFrame(before.collect(), before.schema)
    assert sorted(os.path.basename(r.path) for r in held.collect()) == ["a.txt", "b.txt", "c.txt"]
    (folder / "a.txt").unlink()
    (folder / "b.txt").write_bytes(b"second, longer")
    (folder / "blank.txt").write_bytes(b" \n")
    (folder / "bad.txt").write_bytes(b"\xff\xfe broken")
    (folder / "large.txt").write_bytes(b"x" * 3_000)
    changes = discovery.difference(held, discovery.listing(spark, str(folder), "*.txt"))
    assert {os.path.basename(r.path): r.change for r in changes.collect()} == {"a.txt": "gone", "b.txt": "changed", "blank.txt": "new", "bad.txt": "new", "large.txt": "new"}
    # a file that has gone since it was listed is refused like the broken ones
    wanted = changes.select("path", "length")
    good, bad = discovery.take_in(discovery.contents(spark, wanted, str(folder), "*.txt"), 0.002)
    assert [(os.path.basename(r.path), r.text) for r in good.collect()] == [("b.txt", "second, longer")]
    reasons = {os.path.basename(r.path): r.reason for r in bad.collect()}
    assert reasons == {"a.txt": "can't be read", "blank.txt": "holds no text", "bad.txt": "is no UTF-8 text", "large.txt": "larger than 0.002 MB: 0.0 MB"}
    assert {(r.status, r.reason, r.n) for r in discovery.outcome(good, bad).collect()} == {("processed", None, 1)} | {("failed", v.split(":")[0], 1) for v in reasons.values()}


def test_numbers_are_consecutive(spark):
    rows = spark.range(1000).withColumn("key", F.xxhash64("id")).repartition(9)
    got = sinks.numbered(rows, "key").orderBy("key").collect()
    assert [r.number for r in got] == list(range(1000))
