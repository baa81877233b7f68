"""Academic citations: styles, in-text citations, references, links, BibTeX, as one job over all documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.sources.shared import written

# Patterns of the citation styles, and of identifiers.
APA = r"\(([A-Z][a-zA-Z\-']+(?:\s+(?:&|and)\s+[A-Z][a-zA-Z\-']+)?(?:\s+et\s+al\.)?),?\s*(\d{4})[a-z]?(?:,\s*pp?\.\s*[\d\-]+)?\)"
MLA = r"\(([A-Z][a-zA-Z\-']+(?:\s+and\s+[A-Z][a-zA-Z\-']+)?)\s+(\d+(?:-\d+)?)\)"
IEEE = r"\[(\d+(?:[-,]\s*\d+)*)\]"
HARVARD = r"\(([A-Z][a-zA-Z\-']+(?:\s*[&,]\s*[A-Z][a-zA-Z\-']+)*)\s+(\d{4})[a-z]?\)"
DOI = r"\b(10\.\d{4,}/[^\s]+)\b"
URL = r"https?://[^\s<>\")]+"
#: In the order that decides ties.
STYLES = (("apa", APA), ("mla", MLA), ("ieee", IEEE), ("harvard", HARVARD))
CONFIDENCE = {"apa": 0.9, "harvard": 0.9, "ieee": 0.95, "mla": 0.85}


def style(text: Column) -> Column:
    """The style with most matches; the earlier of STYLES on ties; ``unknown`` without any."""
    counts = [F.struct(F.regexp_count(text, F.lit(p)).alias("n"), F.lit(-i).alias("order"), F.lit(s).alias("style")) for i, (s, p) in enumerate(STYLES)]
    best = F.array_max(F.array(*counts))
    return F.when(best["n"] > 0, best["style"]).otherwise("unknown")


def authors(names: Column) -> Column:
    """Names split at commas, ampersands and the word ``and``; et al. dropped; those that begin upper-case."""
    parts = F.split(F.regexp_replace(names, r"\s*et\s+al\.?", ""), r"\s*(?:,|&|\band\b)\s*")
    return F.filter(F.transform(parts, F.trim), lambda a: a.rlike("^[A-Z]"))


def in_text(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to one row per in-text citation: style, raw text, authors, year or pages, confidence, place."""
    used = {"apa": (APA, ("apa", "harvard", "unknown")), "ieee": (IEEE, ("ieee", "unknown")), "mla": (MLA, ("mla",))}
    kind = "array<struct<style: string, pattern: string, ordinal: int, raw: string, first: string, second: string>>"

    def matches(style: Column, name: str) -> Column:
        pattern, styles = used[name]
        # groups are read from a match by itself, which is found the same way there
        part = lambda m, g: F.regexp_extract(m, pattern, g)
        second = lambda m: F.lit("") if name == "ieee" else part(m, 2)
        row = lambda m, i: F.struct(F.when(style == "unknown", F.lit(name)).otherwise(style).alias("style"), F.lit(name).alias("pattern"), i.alias("ordinal"), m.alias("raw"), part(m, 1).alias("first"), second(m).alias("second"))
        return F.when(style.isin(*styles), F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), row).cast(kind)).otherwise(F.array().cast(kind))

    # one outer explode of one expression: unions and filters on what is exploded would look for all matches again
    every = T.let(style(F.col("text")), lambda s: F.concat(*[matches(s, name) for name in used]))
    found = docs.select("doc_id", F.explode_outer(every).alias("m")).where("m IS NOT NULL").select("doc_id", "m.style", "m.pattern", "m.ordinal", "m")
    year = F.when(F.col("pattern") == "apa", F.col("m.second").cast("int"))
    pages = F.when(F.col("pattern") == "mla", F.col("m.second"))
    names = F.when(F.col("pattern") == "ieee", F.array().cast("array<string>")).otherwise(authors(F.col("m.first")))
    sure = F.element_at(F.create_map(*[F.lit(x) for p in CONFIDENCE.items() for x in p]), F.col("style"))
    return found.select("doc_id", "style", "pattern", "ordinal", F.col("m.raw").alias("raw"), F.col("m.first").alias("first"), names.alias("authors"), year.alias("year"), pages.alias("pages"), sure.alias("confidence"))


def with_places(docs: DataFrame) -> DataFrame:
    """(doc_id, ordinal, start, stop) of the APA and IEEE citations, by a fold over the matches of each text."""

    def places(raw: Column) -> Column:
        def step(a: Column, m: Column) -> Column:
            at = F.position(m, F.substr("text", a["end"] + 1)) + a["end"] - 1
            return F.struct((at + F.length(m)).alias("end"), F.concat(a["out"], F.array(F.struct(m.alias("raw"), at.alias("start")))).alias("out"))

        empty = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<raw: string, start: int>>").alias("out"))
        return F.aggregate(raw, empty, step, lambda a: a["out"])

    either = F.regexp_extract_all("text", F.lit(f"(?:{APA}|{IEEE})"), F.lit(0))
    out = docs.select("doc_id", F.posexplode(places(either)).alias("ordinal", "m"))
    return out.select("doc_id", "ordinal", "m.raw", "m.start", (F.col("m.start") + F.length("m.raw")).alias("stop"))


# The heading of a reference section, a numbered entry, the parts of an entry, an entry by author and year.
SECTION = r"(?i)(?:References|Bibliography|Works\s+Cited|Literature\s+Cited)\s*\n([\s\S]*)$"
ENTRY_START = r"(?m)^([\[(]?\d+[\]).]\s)"
REFERENCE = r"^[\[(]?(\d+)[\]).]\s*([A-Z].*?\(\d{4}\).*)$"
ENTRY = r"^(.*?)\s*\((\d{4})\)\.\s*([^.]+)"
AUTHOR_YEAR = (
    r"(?m)^([A-Z][a-zA-Z\-']+(?:,\s*[A-Z]\.(?:\s*[A-Z]\.)*)?(?:(?:,\s*&?\s*|\s+(?:&|and)\s+)[A-Z][a-zA-Z\-']+(?:,\s*[A-Z]\.(?:\s*[A-Z]\.)*)?)*)"
    r"\s*\((\d{4})\)\.\s*([^.]+)\."
)


def references(docs: DataFrame) -> DataFrame:
    """Entries of the reference section: (doc_id, ref_no, raw, authors, year, title, doi, url).

    Numbered entries; in documents without any, those that begin with authors and a year, numbered in their order."""
    section = F.regexp_extract("text", SECTION, 1)
    get = lambda c, p, g: F.regexp_extract_all(c, F.lit(p), F.lit(g))
    kind = "array<struct<ref_no: int, raw: string, names: string, year: string, title: string, doi: string, url: string>>"
    some = lambda c, p, g: F.nullif(F.regexp_extract(c, p, g), F.lit(""))

    def numbered(section: Column) -> Column:
        # an entry goes from its number to the next one or to an empty line, over as many lines as it takes
        pieces = F.split(F.regexp_replace(section, ENTRY_START, "\u001e$1"), "\u001e")
        lines = F.transform(pieces, lambda p: F.trim(F.regexp_replace(F.get(F.split(p, r"\n\s*\n"), F.lit(0)), r"\s+", " ")))
        return F.filter(lines, lambda line: line.rlike(REFERENCE))

    def entry(line: Column) -> Column:
        fields = lambda raw: F.struct(F.regexp_extract(line, REFERENCE, 1).cast("int").alias("ref_no"), raw.alias("raw"), F.regexp_extract(raw, ENTRY, 1).alias("names"), some(raw, ENTRY, 2).alias("year"), some(raw, ENTRY, 3).alias("title"), some(raw, DOI, 1).alias("doi"), some(raw, URL, 0).alias("url"))
        return T.let(F.regexp_extract(line, REFERENCE, 2), fields)

    def named(section: Column) -> Column:
        found = F.arrays_zip(*[get(section, AUTHOR_YEAR, g).alias(n) for g, n in enumerate(("raw", "names", "year", "title"))])
        none = F.lit(None).cast("string")
        return F.transform(found, lambda r, i: F.struct((i + 1).alias("ref_no"), r["raw"], r["names"], r["year"], r["title"], none.alias("doi"), none.alias("url")))

    def entries(section: Column) -> Column:
        return T.let(numbered(section), lambda n: F.when(F.size(n) > 0, F.transform(n, entry).cast(kind)).otherwise(named(section).cast(kind)))

    # one outer explode of one expression: unions and filters on what is exploded would cut all sections again
    every = T.let(section, lambda c: T.let(F.when(c != "", c).otherwise(F.col("text")), entries))
    rows = docs.select("doc_id", F.explode_outer(every).alias("r")).where("r IS NOT NULL")
    return rows.select("doc_id", "r.ref_no", "r.raw", authors(F.col("r.names")).alias("authors"), F.col("r.year").cast("int").alias("year"), F.trim("r.title").alias("title"), "r.doi", "r.url")


def statistics(cited: DataFrame, refs: DataFrame) -> DataFrame:
    """(kind, key, n): all in-text citations and references, citations by author and by year."""
    one = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit("").alias("key"), "n")
    by = lambda df, kind, c: df.groupBy(c.cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "key", "n")
    authors_ = cited.select(F.explode("authors").alias("author"))
    return one(cited, "citations").unionByName(one(refs, "references")).unionByName(by(authors_, "author", F.col("author"))).unionByName(by(cited.where("year IS NOT NULL"), "year", F.col("year")))


def report(docs: DataFrame, first: int = 20, top: int = 10) -> DataFrame:
    """One row per document: style, totals, the first citations and references as displayed, the most cited authors."""
    cited, refs = in_text(docs), references(docs)
    shown = lambda df, order, title: df.select("doc_id", F.struct(F.col(order).alias("at"), display(F.col("authors"), F.col("year"), title).alias("shown")).alias("s"))

    def lists(df: DataFrame, order: str, title: Column, total: str, name: str) -> DataFrame:
        place = Window.partitionBy("doc_id").orderBy("s.at")
        rows = shown(df, order, title).withColumn("n", F.row_number().over(place))
        some = F.array_sort(F.collect_list(F.when(F.col("n") <= first, F.col("s"))))
        return rows.groupBy("doc_id").agg(F.count("*").alias(total), F.transform(some, lambda x: x["shown"]).alias(name))

    best = top_authors(cited, top).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "author", "n"))).alias("l"))
    best = best.select("doc_id", F.transform("l", lambda x: F.concat(x["author"], F.lit(": "), x["n"].cast("string"))).alias("top_authors"))
    out = docs.select("doc_id", style(F.col("text")).alias("style"))
    out = out.join(lists(cited.withColumn("at", F.struct("pattern", "ordinal")), "at", F.lit(None).cast("string"), "in_text_total", "in_text"), "doc_id", "left")
    out = out.join(lists(refs, "ref_no", F.col("title"), "reference_total", "references"), "doc_id", "left").join(best, "doc_id", "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "style", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("in_text_total", "reference_total")], *[F.coalesce(c, none).alias(c) for c in ("in_text", "references", "top_authors")])


def links(cited: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc_id, ordinal, ref_no): numeric citations by number, ranges expanded; others by year and author, first reference wins."""
    # both kinds of links read both, and finding them costs far more than keeping them
    cited, refs = written(cited.select("doc_id", "ordinal", "pattern", "first", "authors", "year"), "cited"), written(refs.select("doc_id", "ref_no", "authors", "year"), "refs")
    numbers = F.flatten(F.transform(F.split(F.col("first"), r",\s*"), lambda p: F.sequence(F.get(F.split(p, "-"), F.lit(0)).cast("int"), F.element_at(F.split(p, "-"), -1).cast("int"))))
    numeric = cited.where("pattern = 'ieee'").select("doc_id", "ordinal", F.explode(F.array_distinct(numbers)).alias("ref_no")).join(refs.select("doc_id", "ref_no"), ["doc_id", "ref_no"])
    named = cited.where("pattern = 'apa'").select("doc_id", "ordinal", "year", F.col("authors").alias("mine"))
    pairs = named.join(refs.select("doc_id", "ref_no", "year", "authors"), ["doc_id", "year"])
    same = F.exists("mine", lambda a: F.exists("authors", lambda b: F.contains(F.lower(b), F.lower(a)) | F.contains(F.lower(a), F.lower(b))))
    return numeric.select("doc_id", "ordinal", "ref_no").unionByName(pairs.where(same).groupBy("doc_id", "ordinal").agg(F.min("ref_no").alias("ref_no")))


def display(a: Column, year: Column, title: Column) -> Column:
    who = F.when(F.size(a) > 2, F.concat(F.get(a, F.lit(0)), F.lit(" et al."))).otherwise(F.array_join(a, " & "))
    return F.concat_ws(", ", F.when(F.size(a) > 0, who), year.cast("string"), title)


def bib_key(a: Column, year: Column) -> Column:
    first = F.when(F.size(a) > 0, F.lower(F.get(F.split(F.get(a, F.lit(0)), r"[,\s]"), F.lit(0))))
    return F.concat(F.coalesce(first, F.lit("unknown")), F.coalesce(year.cast("string"), F.lit("nd")))


def bibtex(refs: DataFrame) -> DataFrame:
    """refs with entry: BibTeX text; fields that are missing are left out."""
    line = lambda name, c: F.concat(F.lit(f"  {name} = {{"), c, F.lit("}"))
    fields = F.concat_ws(",\n", line("author", F.when(F.size("authors") > 0, F.array_join("authors", " and "))), line("title", F.col("title")), line("year", F.col("year").cast("string")), line("doi", F.col("doi")), line("url", F.col("url")))
    return refs.withColumn("entry", F.concat(F.lit("@article{"), bib_key(F.col("authors"), F.col("year")), F.lit(",\n"), fields, F.lit("\n}")))


def top_authors(cited: DataFrame, n: int) -> DataFrame:
    counts = cited.select("doc_id", F.explode("authors").alias("author")).groupBy("doc_id", "author").agg(F.count("*").alias("n"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("n"), "author")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
