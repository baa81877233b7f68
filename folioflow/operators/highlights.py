"""Highlights: search, grouping, statistics, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T

# Marks of the colours.
EMOJI = {"yellow": "🟡", "green": "🟢", "blue": "🔵", "pink": "🩷", "purple": "🟣", "orange": "🟠"}
NO_EMOJI = "⚪"
# Shades of the colours.
SHADES = {"yellow": "#fff59d", "green": "#a5d6a7", "blue": "#90caf9", "pink": "#f48fb1", "purple": "#ce93d8", "orange": "#ffcc80"}


def folded(changes: DataFrame) -> DataFrame:
    """Ordered changes (id, op, at, color, note) to the last state: later non-null fields win, deleted ids go."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at")))
    state = changes.groupBy("id").agg(F.max_by("op", "at").alias("op"), last("color").alias("color"), last("note").alias("note"))
    return state.where("op <> 'delete'").select("id", F.coalesce("color", F.lit("yellow")).alias("color"), "note")


def matching(highlights: DataFrame, words: str) -> DataFrame:
    has = lambda c: F.contains(F.lower(c), F.lit(words.lower()))
    return highlights.where(has(F.col("text")) | F.coalesce(has(F.col("note")), F.lit(False)) | F.exists("tags", has))


def grouped(highlights: DataFrame, by: str) -> DataFrame:
    """Counts and first ids by document, color, tag (a highlight is in each of its groups; ``untagged``) or date."""
    key = {
        "document": F.col("document_id").cast("string"), "color": F.col("color"), "date": F.date_format("created_at", "yyyy-MM-dd"),
        "tag": F.explode(F.when(F.size("tags") == 0, F.array(F.lit("untagged"))).otherwise(F.col("tags"))),
    }[by]
    return highlights.select(key.alias("key"), "id", "ord").groupBy("key").agg(F.count("*").alias("n"), F.min_by("id", "ord").alias("first_id"))


def statistics(highlights: DataFrame) -> DataFrame:
    """(kind, key, n): all, with notes, by document, colour and tag."""
    sets = highlights.groupingSets([["document_id"], ["color"], []], "document_id", "color").agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"), F.count("note").alias("notes"))
    kind = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "document").otherwise("color")
    counts = sets.select(kind.alias("kind"), F.coalesce(F.col("document_id").cast("string"), "color", F.lit("")).alias("key"), "n", "g", "notes")
    notes = counts.where("g = 3").select(F.lit("with_notes").alias("kind"), "key", F.col("notes").alias("n"))
    tags = highlights.select(F.explode("tags").alias("key")).groupBy("key").agg(F.count("*").alias("n")).select(F.lit("tag").alias("kind"), "key", "n")
    return counts.select("kind", "key", "n").unionByName(notes).unionByName(tags)


def digest(highlights: DataFrame, first: int = 5) -> DataFrame:
    """The first highlights of each document and how many more there are."""
    w = Window.partitionBy("document_id")
    out = highlights.withColumn("place", F.row_number().over(w.orderBy("start_offset", "ord"))).withColumn("more", F.greatest(F.count("*").over(w) - first, F.lit(0)))
    return out.where(F.col("place") <= first).select("document_id", "place", "id", "more")


def markdown(highlights: DataFrame) -> DataFrame:
    """One Markdown text per document, in order of offset."""
    mark = F.element_at(F.create_map(*[F.lit(x) for p in EMOJI.items() for x in p]), F.col("color"))
    line = F.concat(F.lit("- "), mark, F.lit(" "), F.col("text"), F.coalesce(F.concat(F.lit(" — "), "note"), F.lit("")))
    per = highlights.select("document_id", F.struct("start_offset", "ord", line.alias("line")).alias("l")).groupBy("document_id").agg(F.array_sort(F.collect_list("l")).alias("l"))
    return per.select("document_id", F.concat(F.lit("## Document "), F.col("document_id").cast("string"), F.lit("\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("markdown"))


def html(highlights: DataFrame) -> DataFrame:
    """One HTML section per document, in order of offset."""
    shade = T.looked_up(F.col("color"), SHADES, "")
    some = lambda name, c, inner: F.when(c, F.concat(F.lit(f'<div class="{name}">'), inner, F.lit("</div>"))).otherwise("")
    note = some("note", F.coalesce(F.length("note"), F.lit(0)) > 0, F.concat(F.lit("<strong>Note:</strong> "), T.escape_html(F.col("note"))))
    tags = some("tags", F.size("tags") > 0, F.array_join(F.transform("tags", lambda t: F.concat(F.lit('<span class="tag">'), t, F.lit("</span>"))), ""))
    quote = F.concat(F.lit('<div class="quote">"'), T.escape_html(F.col("text")), F.lit('"</div>'))
    page = F.concat(F.lit('<div class="meta">Page '), F.col("page_number").cast("string"), F.lit("</div>"))
    item = F.concat(F.lit('<div class="highlight" style="background-color: '), shade, F.lit('">'), page, quote, F.coalesce(note, F.lit("")), tags, F.lit("</div>"))
    per = highlights.select("document_id", F.struct("start_offset", "ord", item.alias("item")).alias("l")).groupBy("document_id").agg(F.array_sort(F.collect_list("l")).alias("l"))
    head = F.concat(F.lit("<h2>"), T.escape_html(F.col("document_id").cast("string")), F.lit("</h2>\n"))
    return per.select("document_id", F.concat(head, F.array_join(F.transform("l", lambda x: x["item"]), "\n")).alias("html"))


def report(highlights: DataFrame, document: Column | None = None, tag: str | None = None, color: str | None = None, first: int = 20, width: int = 200) -> DataFrame:
    """Highlights of a document, else with a tag, else of a colour, else all: how many, and the first ones with cut texts."""
    if document is not None:
        highlights = highlights.where(document)
    elif tag is not None:
        highlights = highlights.where(F.array_contains("tags", tag))
    elif color is not None:
        highlights = highlights.where(F.col("color") == color)
    n = highlights.agg(F.count("*").alias("n"))  # one row
    some = highlights.orderBy("ord").limit(first)
    place = F.row_number().over(Window.orderBy("ord"))  # of a few rows
    return some.withColumn("place", place).join(F.broadcast(n)).select("id", T.ellipsis(F.col("text"), width).alias("text"), "n", "place")
