"""Sinks: tables as Parquet, texts and JSON lines, BibTeX, GraphML and GEXF, each written by Spark's writers; graphs as one file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions.text import escape_xml
from folioflow.operators.corpus import upsert
from folioflow.sources.shared import new_path, written


def save_corpus(docs: DataFrame, path: str, partition: str | None = None) -> None:
    writer = docs.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def find_files(spark: SparkSession, folder: str, pattern: str = "*.pdf", leave_out: str = "/node_modules/") -> DataFrame:
    """path, modification time and length of files under a folder; contents are not read unless asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.where(~F.contains("path", F.lit(leave_out))).select("path", "modificationTime", "length")


def write_lines(lines: DataFrame, path: str, column: str = "value") -> None:
    lines.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def export_vectors(vectors: DataFrame, path: str) -> None:
    """Vectors (id, embedding) as JSON lines."""
    write_json(vectors.select("id", "embedding"), path)


def import_vectors(spark: SparkSession, path: str, into: DataFrame) -> DataFrame:
    """A table of vectors (id, embedding) after those of a file have taken the place of their ids'; of several the last of equals is any one."""
    read = spark.read.schema(into.select("id", "embedding").schema).json(path).where("id IS NOT NULL")
    return upsert(into.select("id", "embedding"), read.dropDuplicates(["id"]), "id")


def document_markdown(docs: DataFrame, pages: DataFrame, images: DataFrame) -> DataFrame:
    """docs (document_id, name, indexed_at, page_count, file_size, summary), pages (document_id, page_number, page_text), images (document_id,
    page_number, path, description, ocr_text): (document_id, name, markdown), the text of a document with all that belongs to it."""
    said = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    page = F.concat(F.lit("### Page "), F.col("page_number").cast("string"), F.lit("\n\n"), "page_text", F.lit("\n\n"))
    listed = lambda order, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("t")))), lambda x: x["t"]), "")
    body = pages.where(said("page_text")).groupBy("document_id").agg(listed(["page_number"], page).alias("body"))
    ocr = F.when(said("ocr_text"), F.concat(F.lit("**OCR Text:** "), "ocr_text", F.lit("\n\n"))).otherwise("")
    shown = F.when(said("description"), F.col("description")).otherwise("Image")
    image = F.concat(F.lit("### Image from Page "), F.col("page_number").cast("string"), F.lit("\n\n!["), shown, F.lit("]("), "path", F.lit(")\n\n"), ocr)
    pictures = images.groupBy("document_id").agg(F.concat(F.lit("---\n\n## Images\n\n"), listed(["page_number", "path"], image)).alias("pictures"))
    head = F.concat(
        F.lit("# "), "name", F.lit("\n\n> **Indexed:** "), F.col("indexed_at").cast("string"), F.lit("\n> **Pages:** "), F.col("page_count").cast("string"),
        F.lit("\n> **File Size:** "), F.format_string("%.1f", F.col("file_size") / 1024), F.lit(" KB\n\n---\n\n## Summary\n\n"), "summary", F.lit("\n\n---\n\n## Full Content\n\n"),
    )
    whole = docs.join(body, "document_id", "left").join(pictures, "document_id", "left")
    return whole.select("document_id", "name", F.concat(head, F.coalesce("body", F.lit("")), F.coalesce("pictures", F.lit(""))).alias("markdown"))


def _tag(template: str, **values: Column) -> Column:
    parts: list[Column] = []
    rest = template
    for name, value in values.items():
        head, rest = rest.split("{" + name + "}", 1)
        parts += [F.lit(head), escape_xml(value.cast("string"))]
    return F.concat(*parts, F.lit(rest))


def numbered(rows: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """Rows with consecutive numbers from 0 in the given order, by one distributed sort and a count per part of it."""
    part, within = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    held = written(rows.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()), "numbered").withColumn("__part", part)
    sizes = held.groupBy("__part").agg(F.count("*").alias("n"))  # a row per part of the sort
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return held.join(F.broadcast(sizes.select("__part", before.alias("before"))), "__part").withColumn(name, F.col("before") + within).drop("__part", "__id", "before")


def _around(spark: SparkSession, *texts: tuple[int, str]) -> DataFrame:
    return spark.createDataFrame([(section, -1, text) for section, text in texts], "section int, place long, line string")


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (id, label, kind), edges (source, target, weight): all lines of the file as (section, place, line)."""
    n = _tag('<node id="{id}"><data key="label">{label}</data><data key="type">{kind}</data></node>', id=F.col("id"), label=F.col("label"), kind=F.col("kind"))
    e = _tag('<edge id="e{number}" source="{source}" target="{target}"><data key="weight">{weight}</data></edge>', number=F.col("number"), source=F.col("source"), target=F.col("target"), weight=F.col("weight"))
    return _file(nodes, edges, n, e, GRAPHML)


def gexf(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """As ``graphml``, in the other format."""
    n = _tag('<node id="{id}" label="{label}"/>', id=F.col("id"), label=F.col("label"))
    e = _tag('<edge id="{number}" source="{source}" target="{target}" weight="{weight}"/>', number=F.col("number"), source=F.col("source"), target=F.col("target"), weight=F.col("weight"))
    return _file(nodes, edges, n, e, GEXF)


# What stands before the nodes, between nodes and edges, and behind the edges.
GRAPHML = (
    """<?xml version="1.0" encoding="UTF-8"?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns">
<key id="label" for="node" attr.name="label" attr.type="string"/>
<key id="type" for="node" attr.name="type" attr.type="string"/>
<key id="weight" for="edge" attr.name="weight" attr.type="double"/>
<graph id="G" edgedefault="directed">""",
    None,
    "</graph>\n</graphml>",
)
GEXF = (
    """<?xml version="1.0" encoding="UTF-8"?>
<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2">
<graph mode="static" defaultedgetype="directed">
<nodes>""",
    "</nodes>\n<edges>",
    "</edges>\n</graph>\n</gexf>",
)


def _file(nodes: DataFrame, edges: DataFrame, node: Column, edge: Column, around: tuple[str | None, ...]) -> DataFrame:
    n = numbered(nodes, "id").select(F.lit(1).alias("section"), F.col("number").alias("place"), node.alias("line"))
    e = numbered(edges, "source", "target").select(F.lit(3).alias("section"), F.col("number").alias("place"), edge.alias("line"))
    return n.unionByName(e).unionByName(_around(nodes.sparkSession, *[(2 * i, t) for i, t in enumerate(around) if t is not None]))


def write_single(lines: DataFrame, path: str) -> None:
    """Lines (section, place, line) in order as one text file: Spark sorts and writes the parts, the file system joins them
    (where it can't, as on a local disk, they are copied one behind the other, a buffer at a time)."""
    spark = lines.sparkSession
    parts = new_path(spark, "lines")
    lines.orderBy("section", "place").select("line").write.text(parts)
    fs = spark._jvm.org.apache.hadoop.fs
    to = fs.Path(path)
    files = to.getFileSystem(spark._jsc.hadoopConfiguration())
    own = fs.Path(parts).getFileSystem(spark._jsc.hadoopConfiguration())
    texts = sorted((f.getPath() for f in own.listStatus(fs.Path(parts)) if f.getPath().getName().startswith("part-") and f.getLen() > 0), key=lambda p: p.getName())
    out = files.create(to, True)
    if files.getScheme() == "hdfs" and own.getUri().equals(files.getUri()) and texts:
        out.close()
        files.concat(to, _paths(spark, texts))
        return
    for part in texts:
        read = own.open(part)
        spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(read, out, 1 << 20, False)
        read.close()
    out.close()


def _paths(spark: SparkSession, paths: list) -> object:
    array = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Path, len(paths))
    for i, p in enumerate(paths):
        array[i] = p
    return array
