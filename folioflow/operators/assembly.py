"""Material for writing: sources grouped by document, citation formats, templates, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions.text import cite_key


def grouped_sources(hits: DataFrame, per_document: int = 3) -> DataFrame:
    """hits (query_id, document_id, rank, text): documents keyed cite1, cite2 ... by first appearance, with their best texts."""
    w = Window.partitionBy("query_id", "document_id")
    rows = hits.withColumn("first", F.min("rank").over(w)).withColumn("k", F.row_number().over(w.orderBy("rank"))).where(F.col("k") <= per_document)
    key = F.concat(F.lit("cite"), F.dense_rank().over(Window.partitionBy("query_id").orderBy("first")).cast("string"))
    rows = rows.withColumn("key", key)
    per = rows.groupBy("query_id", "document_id", "key").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("l"))
    return per.select("query_id", "document_id", "key", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("context"))


def citation(style: str, name: Column, year: Column, page: Column) -> Column:
    y, p = year.cast("string"), page.cast("string")
    if style == "apa":
        return F.concat(F.lit("("), name, F.lit(", "), y, F.lit(", p. "), p, F.lit(")"))
    if style == "mla":
        return F.concat(F.lit("("), name, F.lit(" "), p, F.lit(")"))
    if style == "chicago":
        return F.concat(name, F.lit(", "), y, F.lit(", "), p, F.lit("."))
    if style == "ieee":
        return F.concat(F.lit("["), name, F.lit(", p. "), p, F.lit("]"))
    raise ValueError(f"unknown style {style}")


def replace_markers(texts: DataFrame, targets: DataFrame) -> DataFrame:
    """texts (id, text), targets (id, marker, target): each marker replaced, in the order of markers."""
    per = targets.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("marker", "target"))).alias("l"))
    out = texts.join(per, "id", "left").withColumn("l", F.coalesce("l", F.array().cast("array<struct<marker: string, target: string>>")))
    return out.select("id", F.aggregate("l", F.col("text"), lambda t, m: F.replace(t, m["marker"], m["target"])).alias("text"))


def invalid_dialogues(turns: DataFrame) -> DataFrame:
    """Conversations without turns that all have a role and a text: (conv_id, n, valid)."""
    ok = F.col("role").isNotNull() & F.col("text").isNotNull() & (F.trim("text") != "")
    return turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.bool_and(ok).alias("valid"))


def transcripts(turns: DataFrame) -> DataFrame:
    line = F.concat(F.upper("role"), F.lit(": "), F.col("text"))
    per = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    return per.select("conv_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n\n").alias("transcript"))


def missing_sections(papers: DataFrame, required: DataFrame) -> DataFrame:
    """papers (paper_id, template_id, section), required (template_id, section): one row per section that a paper lacks."""
    all_ = papers.select("paper_id", "template_id").distinct().join(required, "template_id")
    return all_.join(papers.select("paper_id", "section"), ["paper_id", "section"], "left_anti").select("paper_id", "section")


def validated(papers: DataFrame, sections: DataFrame, templates: DataFrame) -> DataFrame:
    """papers (paper_id, template_id, title, authors, abstract), sections (paper_id, title), templates (template_id, required): (paper_id, error), a
    row per thing that is wrong; of a paper whose template is unknown nothing else is judged."""
    known = papers.join(templates.select("template_id", "required"), "template_id", "left")
    none = F.col("required").isNull()
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    checks = (
        (none, F.concat(F.lit("Template "), F.coalesce("template_id", F.lit("null")), F.lit(" not found"))), (~none & empty("title"), F.lit("Title is required")),
        (~none & (F.coalesce(F.size("authors"), F.lit(0)) <= 0), F.lit("At least one author is required")), (~none & empty("abstract"), F.lit("Abstract is required")),
    )
    fields = known.select("paper_id", F.explode(F.filter(F.array(*[F.when(wrong, text) for wrong, text in checks]), lambda e: e.isNotNull())).alias("error"))
    asked = known.select("paper_id", F.explode("required").alias("section"))
    given = sections.select("paper_id", F.regexp_replace(F.lower("title"), r"\s+", "_").alias("section"))
    lacking = asked.join(given, ["paper_id", "section"], "left_anti")
    return fields.unionByName(lacking.select("paper_id", F.concat(F.lit("Required section missing: "), "section").alias("error")))


def filled(papers: DataFrame, templates: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Each paper's template with {{NAME}} replaced by its field of that name."""
    out = papers.join(templates, "template_id")
    text = F.col("template")
    for f in fields:
        text = F.replace(text, F.lit("{{" + f.upper() + "}}"), F.coalesce(F.col(f).cast("string"), F.lit("")))
    return out.select("paper_id", text.alias("document"))


# The built-in templates (id, name, type, required sections, optional sections, citation style).
TEMPLATES = (
    ("ieee-conference", "IEEE Conference", "ieee", ("abstract", "introduction", "conclusion"), ("related_work", "methodology", "results", "discussion"), "numeric"),
    ("ieee-journal", "IEEE Journal", "ieee", ("abstract", "introduction", "conclusion"), ("related_work", "methodology", "results", "discussion"), "numeric"),
    ("springer-lncs", "Springer LNCS", "springer", ("abstract", "introduction", "conclusion"), ("related_work", "methodology", "evaluation"), "numeric"),
    ("acm-sigconf", "ACM SIGCONF", "acm", ("abstract", "introduction", "conclusion"), ("related_work", "methodology", "results"), "author-year"),
    ("apa-paper", "APA Style", "apa", ("abstract", "introduction", "method", "results", "discussion"), ("literature_review",), "author-year"),
)


def templates(spark: SparkSession) -> DataFrame:
    schema = "template_id string, name string, type string, required array<string>, optional array<string>, citation_style string"
    return spark.createDataFrame([(i, n, t, list(r), list(o), c) for i, n, t, r, o, c in TEMPLATES], schema)


def with_footnotes(texts: DataFrame, cited: DataFrame) -> DataFrame:
    """texts (id, text), cited (id, place, marker, name, page_number): markers become footnotes, whose list is appended."""
    note = F.concat(F.lit("[^"), F.row_number().over(Window.partitionBy("id").orderBy("place")).cast("string"), F.lit("]"))
    rows = cited.withColumn("target", note)
    line = F.concat("target", F.lit(": "), "name", F.lit(", p. "), F.col("page_number").cast("string"), F.lit("\n"))
    lists = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("l"))
    tail = F.concat(F.lit("\n\n---\n\n## References\n\n"), F.coalesce(F.array_join(F.transform("l", lambda x: x["line"]), ""), F.lit("")))
    out = replace_markers(texts, rows.select("id", "marker", "target"))
    return out.join(lists, "id", "left").select("id", F.concat("text", tail).alias("text"))


def first_per_key(cited: DataFrame, *order: str) -> DataFrame:
    """cited (paper_id, key, ...): of all sections of a paper, the first citation of each key."""
    place = Window.partitionBy("paper_id", "key").orderBy(*order)
    return cited.withColumn("k", F.row_number().over(place)).where("k = 1").drop("k")


def typed_bibtex(refs: DataFrame) -> DataFrame:
    """refs (type, key, authors, title, year, and venue, volume, pages, doi, url where known): one BibTeX entry each."""
    line = lambda name, c: F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"  {name} = {{"), c.cast("string"), F.lit("},\n")))
    always = lambda name, c: F.concat(F.lit(f"  {name} = {{"), F.coalesce(c.cast("string"), F.lit("")), F.lit("},\n"))
    given = [always("author", F.array_join("authors", " and ")), always("title", F.col("title")), always("year", F.col("year"))]
    known = [line(n, F.col(c)) for n, c in (("journal", "venue"), ("volume", "volume"), ("pages", "pages"), ("doi", "doi"), ("url", "url")) if c in refs.columns]
    return refs.select("key", F.concat(F.lit("@"), "type", F.lit("{"), "key", F.lit(",\n"), F.concat_ws("", *given, *known), F.lit("}\n")).alias("entry"))


def source_bibtex(used: DataFrame, year: Column) -> DataFrame:
    """used (document_id, name, ord): one entry per key that the name gives, of the first document that has it."""
    first = used.withColumn("key", cite_key(F.col("name"))).groupBy("key").agg(F.min(F.struct("ord", "name", "document_id")).alias("f"))
    field = lambda name, c: F.concat(F.lit(f"  {name} = {{"), c, F.lit("}"))
    title = F.regexp_replace("f.name", r"\.pdf", "")
    body = F.concat_ws(",\n", field("title", title), field("author", F.lit("Unknown Author")), field("year", year.cast("string")), field("note", F.concat(F.lit("Document: "), F.col("f.name"))))
    return first.select("key", F.col("f.document_id").alias("document_id"), F.concat(F.lit("@article{"), "key", F.lit(",\n"), body, F.lit("\n}")).alias("entry"))


def notes(docs: DataFrame) -> DataFrame:
    """docs (document_id, name, path, page_count, summary): one Markdown section each."""
    summary = F.when(F.coalesce(F.length("summary"), F.lit(0)) > 0, F.concat(F.lit("### Summary\n"), "summary", F.lit("\n\n"))).otherwise("")
    return docs.select("document_id", F.concat(F.lit("## "), "name", F.lit("\n\n**Path:** "), "path", F.lit("\n**Pages:** "), F.col("page_count").cast("string"), F.lit("\n\n"), summary, F.lit("---\n\n")).alias("notes"))


def digest(docs: DataFrame, chunks: DataFrame, first: int = 10, width: int = 15_000) -> DataFrame:
    """docs (document_id, name, summary), chunks (document_id, chunk_index, text): name, summary and first chunks as one text, cut with a mark."""
    per = chunks.where(F.col("chunk_index") < first).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("l"))
    body = F.concat_ws("", F.transform("l", lambda x: F.concat(x["text"], F.lit("\n\n"))))
    text = F.concat(F.lit("\n\n=== Document: "), "name", F.lit(" ===\n\nSummary: "), F.coalesce("summary", F.lit("")), F.lit("\n\n"), body)
    cut = F.when(F.length("t") > width, F.concat(F.left("t", F.lit(width)), F.lit("\n\n[Content truncated for processing...]"))).otherwise(F.col("t"))
    return docs.join(per, "document_id", "left").select("document_id", text.alias("t")).select("document_id", cut.alias("digest"))
