"""Text preparation as column expressions: cleaning, pages, sentences, chunks, summaries, tokens, escapes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that searches leave out.
# fmt: off
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was", "are", "were", "been", "be", "have", "has", "had",
    "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "shall", "can", "need", "that", "this", "these", "those", "it", "its", "they", "them",
    "their", "we", "our", "you", "your", "he", "she", "his", "her", "him",
)
# fmt: on
SENTENCE = r"[^.!?]*[.!?]+"
# Typographic ligatures and their letters.
LIGATURES = (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"))
CHUNK_SIZE, CHUNK_OVERLAP = 1000, 200


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean(text: Column) -> Column:
    """Join hyphenated line breaks, unwrap lines, squeeze blanks, resolve ligatures, drop lone page numbers."""
    out = F.regexp_replace(text, r"(\w)-\n(\w)", "$1$2")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r"([^\n])\n([^\n])", "$1 $2")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    for mark, letters in LIGATURES:
        out = F.replace(out, F.lit(mark), F.lit(letters))
    out = F.regexp_replace(out, r"(?m)^\s*[0-9]+\s*$", "")
    return trimmed(F.array_join(F.transform(F.split(out, "\n"), trimmed), "\n"))


def pages(text: Column, count: Column) -> Column:
    """Array of page texts: by form feeds if they give enough parts, else even slices of at least 100 characters."""
    parts = F.split(text, "\f")
    width = F.greatest(F.length(text) / count, F.lit(100.0))
    cut = lambda i: F.floor(i * width).cast("int")
    even = F.transform(F.sequence(F.lit(1), count.cast("int")), lambda i: F.substring(text, cut(i - 1) + 1, cut(i) - cut(i - 1)))
    return F.when(count < 1, F.array().cast("array<string>")).when(F.size(parts) >= count, F.slice(parts, F.lit(1), count.cast("int"))).otherwise(even)


def sentences(text: Column) -> Column:
    """Sentences with their end marks, and the unterminated tail; blank ones are left out.

    Texts are split behind runs of end marks: looking for ``[^.!?]*[.!?]+`` takes time that grows with
    the square of a tail without end marks."""
    return F.filter(F.split(text, r"(?<=[.!?])(?![.!?])", -1), lambda s: s.rlike(r"\S"))


def overlap_tail(text: Column, overlap: int = CHUNK_OVERLAP) -> Column:
    """The last characters of a chunk, from a word start if one lies in their first half."""
    tail = F.right(text, F.lit(overlap))
    space = F.instr(tail, " ")
    return F.when(F.length(text) <= overlap, text).when((space > 1) & (space - 1 < overlap / 2), F.substr(tail, space + 1)).otherwise(tail)


_CHUNK = "struct<text: string, start_index: int, end_index: int>"


def chunk_array(page: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Chunks (text, start_index, end_index) of a page: whole sentences packed up to ``size``, with overlap."""

    def made(cur: Column, start: Column) -> Column:
        return F.struct(trimmed(cur).alias("text"), start.alias("start_index"), (start + F.length(cur)).alias("end_index"))

    def step(acc: Column, s: Column) -> Column:
        full = (F.length(acc["cur"]) + F.length(s) > size) & (F.length(acc["cur"]) > 0)
        kept = overlap_tail(acc["cur"], overlap)
        return F.struct(
            F.concat(F.when(full, kept).otherwise(acc["cur"]), s, F.lit(" ")).alias("cur"),
            F.when(full, acc["start"] + F.length(acc["cur"]) - F.length(kept)).otherwise(acc["start"]).alias("start"),
            F.when(full, F.concat(acc["out"], F.array(made(acc["cur"], acc["start"])))).otherwise(acc["out"]).alias("out"),
        )

    empty = F.struct(F.lit("").alias("cur"), F.lit(0).alias("start"), F.array().cast(f"array<{_CHUNK}>").alias("out"))
    last = lambda a: F.when(a["cur"].rlike(r"\S"), F.concat(a["out"], F.array(made(a["cur"], a["start"])))).otherwise(a["out"])
    whole = F.array(F.struct(page.alias("text"), F.lit(0).alias("start_index"), F.length(page).alias("end_index")))
    return F.when(F.length(page) <= size, whole).otherwise(F.aggregate(sentences(page), empty, step, last))


_SENTENCES = re.compile(r"[^.!?]*+[.!?]++|[^.!?]++")
_BLANKS = " \t\n\x0b\f\r"


def chunk_list(page: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[tuple[str, int, int]]:
    """``chunk_array`` of one page, inside a task."""
    if len(page) <= size:
        return [(page, 0, len(page))]
    out, start = [], 0
    parts, length = [], 0  # the sentences of the chunk that is being packed
    for s in _SENTENCES.findall(page):
        if not s.strip(_BLANKS):
            continue
        if length and length + len(s) > size:
            cur = "".join(parts)
            out.append((cur.strip(_BLANKS), start, start + length))
            kept = cur
            if length > overlap:
                kept = cur[length - overlap :]
                space = kept.find(" ")
                if 0 < space < overlap / 2:
                    kept = kept[space + 1 :]
            start += length - len(kept)
            parts, length = [kept], len(kept)
        parts += [s, " "]
        length += len(s) + 1
    if length and (cur := "".join(parts).strip(_BLANKS)):
        out.append((cur, start, start + length))
    return out


def chunked(page_table: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(document_id, page_number, page_text) to chunks with deterministic ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d in batches:
            texts = d.column("page_text")
            # a few MB of text at a time
            sizes = np.cumsum([len(t) if t else 0 for t in texts.to_pylist()], dtype=np.int64) // 4_000_000
            for part in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(sizes)) + 1):
                found = [chunk_list(t, size, overlap) if t is not None else [] for t in texts.take(pa.array(part)).to_pylist()]
                of = pa.array(np.repeat(part, [len(f) for f in found]))
                flat = list(zip(*(c for f in found for c in f))) or [(), (), ()]
                index = pa.array([i for f in found for i in range(len(f))], pa.int32())
                cut = [pa.array(flat[0], pa.string()), pa.array(flat[1], pa.int32()), pa.array(flat[2], pa.int32())]
                yield pa.RecordBatch.from_arrays([d.column(0).take(of), d.column(1).take(of), index, *cut], ["document_id", "page_number", "chunk_index", "text", "start_index", "end_index"])

    kinds = dict(page_table.dtypes)
    schema = f"document_id {kinds['document_id']}, page_number {kinds['page_number']}, chunk_index int, text string, start_index int, end_index int"
    out = page_table.select("document_id", "page_number", "page_text").mapInArrow(run, schema)
    name = F.concat(F.col("document_id"), F.lit("_p"), F.col("page_number").cast("string"), F.lit("_c"), F.col("chunk_index").cast("string"))
    return out.select(name.alias("chunk_id"), "document_id", "page_number", "chunk_index", "text", "start_index", "end_index")


def merged(chunks: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """Neighbouring chunks of a page joined while the text is at most 1.5 times ``size``."""
    item = F.struct("chunk_index", "chunk_id", "text", "start_index", "end_index")
    pages_of = chunks.groupBy("document_id", "page_number").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def step(out: Column, c: Column) -> Column:
        last = F.element_at(out, -1)
        joined = F.struct(
            last["chunk_index"].alias("chunk_index"), last["chunk_id"].alias("chunk_id"),
            F.concat(last["text"], F.lit(" "), c["text"]).alias("text"), last["start_index"].alias("start_index"), c["end_index"].alias("end_index"),
        )
        fits = F.length(last["text"]) + F.length(c["text"]) <= 1.5 * size
        return F.when(fits, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(joined))).otherwise(F.concat(out, F.array(c)))

    rest = F.slice("items", F.lit(2), F.greatest(F.size("items") - 1, F.lit(0)))
    out = pages_of.withColumn("items", F.aggregate(rest, F.slice("items", 1, 1), step))
    return out.select("document_id", "page_number", F.inline("items")).select("chunk_id", "document_id", "page_number", "text", "start_index", "end_index")


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and underscores; all else separates."""
    return F.split(F.regexp_replace(F.lower(text), r"[^\w\s]", " "), r"\s+")


def counts_as_token(word: Column) -> Column:
    return (F.length(word) > 2) & ~word.isin(*STOP_WORDS)


def tokens(text: Column) -> Column:
    """Words of more than two characters that are not stop words."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(words(text), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


_TOKEN = re.compile(r"[a-z0-9_]{3,}")
_STOPPED = frozenset(STOP_WORDS)


def token_list(low: str) -> list[str]:
    """``tokens`` of a lower-case text, inside a task."""
    return [w for w in _TOKEN.findall(low) if w not in _STOPPED]


#: Bytes of words as they are, all others as blanks; letters outside ASCII have no bytes of words.
_WORD_BYTES = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789_" else 32 for b in range(256))


def term_counts(lows: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Tokens of lower-case texts, as ``token_list`` gives them, inside a task: rows of (text, term, count) in the order of terms, and the sorted terms."""
    words = [low.translate(_WORD_BYTES).split() if low else [] for low in lows.cast(pa.binary()).to_pylist()]
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    coded = pa.array(list(chain.from_iterable(words)), pa.binary()).dictionary_encode()
    code, names = coded.indices.to_numpy(), coded.dictionary.cast(pa.string()).to_pylist()
    kept = sorted((i for i, n in enumerate(names) if len(n) > 2 and n not in _STOPPED), key=names.__getitem__)
    place = np.full(len(names), -1, np.int64)
    place[kept] = np.arange(len(kept))
    code = place[code]
    known = code >= 0
    keys, count = np.unique(code[known] * max(len(words), 1) + row[known], return_counts=True)
    term, row = np.divmod(keys, max(len(words), 1))
    return row, term, count, pa.array([names[i] for i in kept], pa.string())


def truncated(text: Column, words: int = 500) -> Column:
    parts = F.split(text, r"\s+")
    return F.when(F.size(parts) <= words, text).otherwise(F.array_join(F.slice(parts, 1, words), " "))


def smart_summary(text: Column) -> Column:
    """Abstract, else introduction, else the first substantial of the first five paragraphs, else the beginning."""
    abstract = F.regexp_extract(text, r"(?i)(?:abstract|summary)[:\s]*\n?([\s\S]{100,1000}?)(?:\n\n|introduction|keywords|1\.|1\s)", 1)
    intro = F.regexp_extract(text, r"(?i)(?:introduction|1\.?\s*introduction)[:\s]*\n?([\s\S]{100,800}?)(?:\n\n|[0-9]+\.)", 1)

    def short(p: Column) -> Column:
        return F.concat(F.left(p, F.lit(600)), F.when(F.length(p) > 600, "...").otherwise(""))

    def shown(cleaned: Column) -> Column:
        first = F.slice(F.filter(F.split(cleaned, "\n\n"), lambda p: F.length(p) > 50), 1, 5)
        good = F.filter(first, lambda p: (F.length(p) > 100) & ~p.rlike(r"^[0-9\s.]+$") & (F.size(F.split(p, " ")) > 15))
        return F.coalesce(let(F.get(good, F.lit(0)), short), F.concat(F.left(cleaned, F.lit(500)), F.lit("...")))

    named = let(abstract, lambda a: let(intro, lambda i: F.left(clean(F.when(a != "", a).when(i != "", i)), F.lit(600))))
    return F.coalesce(named, let(clean(text), shown))


def basic_summary(text: Column) -> Column:
    """Whole sentences of more than 20 characters until 500 are reached."""
    cleaned = trimmed(F.regexp_replace(text, r"\s+", " "))
    parts = F.filter(F.split(cleaned, r"[.!?]+"), lambda s: F.length(trimmed(s)) > 20)

    def step(a: Column, s: Column) -> Column:
        stop = a["done"] | (F.length(a["out"]) + F.length(s) > 500)
        return F.struct(F.when(stop, a["out"]).otherwise(F.concat(a["out"], trimmed(s), F.lit(". "))).alias("out"), stop.alias("done"))

    out = trimmed(F.aggregate(parts, F.struct(F.lit("").alias("out"), F.lit(False).alias("done")), step, lambda a: a["out"]))
    return F.when(out != "", out).otherwise(F.concat(F.left(cleaned, F.lit(500)), F.lit("...")))


def replaced(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


# Characters that the target formats reserve.
XML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))
HTML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


def escape_xml(text: Column) -> Column:
    return replaced(text, XML)


def escape_html(text: Column) -> Column:
    return replaced(text, HTML)


def escape_latex(text: Column, angles: bool = False) -> Column:
    """Reserved characters escaped; with ``angles`` also < and >."""
    out = F.replace(text, F.lit("\\"), F.lit("\\textbackslash{}"))
    out = F.regexp_replace(out, r"([&%$#_{}])", r"\\$1")
    out = F.replace(F.replace(out, F.lit("~"), F.lit("\\textasciitilde{}")), F.lit("^"), F.lit("\\textasciicircum{}"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("\\textless{}")), F.lit(">"), F.lit("\\textgreater{}")) if angles else out


def normalized(text: Column) -> Column:
    """For comparisons: lower case, one kind of blank, no punctuation."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), r"\n+", " "), r"\s+", " ")
    return trimmed(F.regexp_replace(out, r"[^\w\s]", ""))


def ellipsis(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def human_size(n: Column) -> Column:
    tenths = lambda unit: F.floor(n / unit * 10 + 0.5) / 10
    kb, mb = F.format_string("%.1f KB", tenths(1024)), F.format_string("%.1f MB", tenths(1024 * 1024))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, kb).otherwise(mb)


def cite_key(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "[^a-zA-Z0-9]", ""))


def word_set(text: Column, longer_than: int) -> Column:
    words = F.split(F.regexp_replace(F.lower(text), r"[^\w\s]", ""), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > longer_than))


def overlap_share(a: Column, b: Column) -> Column:
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(0.0)


def percent(share: Column, digits: int = 0) -> Column:
    return F.format_string(f"%.{digits}f%%", 100 * share)


def title_case(identifier: Column) -> Column:
    """``related_work`` to ``Related work``."""
    return F.concat(F.upper(F.left(identifier, F.lit(1))), F.replace(F.substr(identifier, F.lit(2)), F.lit("_"), F.lit(" ")))


# Titles of kinds of sections, and bibliography styles of citation styles.
SECTION_TITLES = {
    "literature_review": "Literature Review", "abstract": "Abstract", "introduction": "Introduction", "methodology": "Methodology",
    "discussion": "Discussion", "conclusion": "Conclusion", "custom": "Content",
}
BIB_STYLES = {"apa": "apalike", "mla": "plain", "chicago": "chicago", "ieee": "ieeetr", "bibtex": "plain"}


def looked_up(key: Column, values: dict[str, str], otherwise: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in values.items() for x in p]), key), F.lit(otherwise))
