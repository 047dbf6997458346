"""Lines, titled sections and document structure, as windows over ordered lines."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from quillspark.functions import text as T
from quillspark.operators.ordinals import ordinals

#: Characters of texts that a task holds as lines before it hands them on.
LINE_CHARS = 4_000_000
FIRST, HERE, LAST = Window.unboundedPreceding, 0, Window.unboundedFollowing


def read_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, line): cleaned, right-stripped lines, numbered from 1; texts pass Python once, which is faster there than several patterns a line."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    return rows.mapInArrow(_lines, StructType([rows.schema["doc_id"], StructField("line_no", IntegerType(), False), StructField("line", StringType(), False)]))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    breaks, controls = re.compile(T.LINE_BREAK), re.compile(T.CONTROL)

    def made(ids: pa.Array, at: list[int], counts: list[int], lines: list[str]) -> pa.RecordBatch:
        numbers = np.arange(1, len(lines) + 1) - np.repeat(np.cumsum(counts) - counts, counts)
        rows = np.repeat(np.array(at, np.int64), counts)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(numbers.astype(np.int32)), pa.array(lines, pa.string())], ["doc_id", "line_no", "line"])

    for batch in batches:
        at, counts, lines, chars = [], [], [], 0
        for i, text in enumerate(batch.column(1)):
            text = unicodedata.normalize("NFKC", text.as_py())
            found = breaks.split(text)
            if not found[-1]:
                found.pop()
            if controls.search(text):
                found = [controls.sub("", line) for line in found]
            at.append(i)
            counts.append(len(found))
            lines += [line.replace("\u3000", " ").rstrip(T.WHITE) for line in found]
            chars += len(text)
            if chars >= LINE_CHARS:
                yield made(batch.column(0), at, counts, lines)
                at, counts, lines, chars = [], [], [], 0
        if lines:
            yield made(batch.column(0), at, counts, lines)


def mark_headings(lines: DataFrame, rules: list[tuple[str, str]], source: Column | None = None, first_line: str | None = None) -> DataFrame:
    """Add is_heading: any (source pattern, line pattern) rule applies; line 1 always where the source matches first_line."""
    stripped, source = T.strip(F.col("line")), F.lit("") if source is None else source
    hit = F.lit(False)
    for of_source, pattern in rules:
        hit = hit | (source.rlike(of_source) & stripped.rlike(pattern))
    hit = (stripped != "") & hit
    if first_line is not None:
        hit = hit | ((F.col("line_no") == 1) & source.rlike(first_line))
    return lines.withColumn("is_heading", hit)


def split_sections(marked: DataFrame) -> DataFrame:
    """(doc_id, sec, title, start_line, end_line, text): sec counts headings from 1; 0 is a document without any.

    A section runs from its heading to the line before the next; lines before the first heading are
    discarded; blank lines count for the range but are not in the text.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    whole = Window.partitionBy("doc_id")
    rows = marked.withColumn("sec", F.sum(F.col("is_heading").cast("int")).over(order.rowsBetween(FIRST, HERE))).withColumn("any", F.max("sec").over(whole))
    rows = rows.where((F.col("sec") > 0) | (F.col("any") == 0))
    filled = F.when(T.strip(F.col("line")) != "", F.struct("line_no", "line"))
    secs = rows.groupBy("doc_id", "sec").agg(
        F.min_by("line", "line_no").alias("head"), F.min("line_no").cast("int").alias("start_line"), F.max("line_no").cast("int").alias("end_line"), F.sort_array(F.collect_list(filled)).alias("body"),
    )
    title = F.when(F.col("sec") > 0, T.strip(F.col("head"))).otherwise(F.col("doc_id").cast("string"))
    return secs.select("doc_id", F.col("sec").cast("int").alias("sec"), title.alias("title"), "start_line", "end_line", F.array_join(F.transform("body", lambda x: x["line"]), "\n").alias("text"))


def sections_in_order(marked: DataFrame) -> DataFrame:
    """split_sections() of lines that come as read_lines() makes them: those of a document together, in one task, from 1 on. Nothing is shuffled; other orders are an error."""
    kinds = [("sec", IntegerType()), ("title", StringType()), ("start_line", IntegerType()), ("end_line", IntegerType()), ("text", StringType())]
    rows = marked.select("doc_id", "line_no", "line", "is_heading").mapInArrow(_sections, StructType([marked.schema["doc_id"], *[StructField(n, k) for n, k in kinds]]))
    return rows.withColumn("title", F.coalesce("title", F.col("doc_id").cast("string")))


def _sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: list[tuple] = []  # sections as (document, number, title, first line, last line, text)
    open_doc, sec, title, start, last, body, chars = None, 0, None, 1, 0, [], 0
    schema = None

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], schema.field(i).type) for i in range(6)], schema=schema)

    for batch in batches:
        names = [("sec", pa.int32()), ("title", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("text", pa.string())]
        schema = pa.schema([batch.schema.field(0), *[pa.field(*n) for n in names]])
        for doc, n, line, heading in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if n != 1 and (n != last + 1 or doc != open_doc):
                raise ValueError(f"line {n} of document {doc!r} does not follow line {last} of {open_doc!r}")
            # lines before the first heading go
            if last and (n == 1 or (heading and sec)):
                done.append((open_doc, sec, title, start, last, "\n".join(body)))
                chars += sum(map(len, body))
                body = []
            if n == 1:
                open_doc, sec, title, start, body = doc, 0, None, 1, []
            if heading:
                sec, title, start, body = sec + 1, line.strip(T.WHITE), n, []
            last = n
            if line.strip(T.WHITE):
                body.append(line)
            if chars >= LINE_CHARS:
                yield made()
                done, chars = [], 0
    if last:
        done.append((open_doc, sec, title, start, last, "\n".join(body)))
    if done:
        yield made()


def section_heads(marked: DataFrame) -> DataFrame:
    """(doc_id, sec, title) of what split_sections makes; headings and the first line of a document are shuffled, no other lines."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    rows = marked.where(F.col("is_heading") | (F.col("line_no") == 1)).select("doc_id", "line_no", "is_heading", F.when(F.col("is_heading"), T.strip(F.col("line"))).alias("title"))
    rows = rows.withColumn("sec", F.sum(F.col("is_heading").cast("int")).over(order.rowsBetween(FIRST, HERE))).withColumn("any", F.max("is_heading").over(Window.partitionBy("doc_id")))
    return rows.where("is_heading = any").select("doc_id", F.col("sec").cast("int").alias("sec"), F.coalesce("title", F.col("doc_id").cast("string")).alias("title"))


def section_titles(marked: DataFrame) -> DataFrame:
    """Distinct (headed, title) of what split_sections makes; headings and a row a document are shuffled, no other lines."""
    title = F.when(F.col("is_heading"), T.strip(F.col("line"))).otherwise(F.col("doc_id").cast("string"))
    rows = marked.select("doc_id", F.col("is_heading").alias("headed"), title.alias("title")).distinct()
    rows = rows.withColumn("any", F.max("headed").over(Window.partitionBy("doc_id"))).where("headed = any")
    return rows.select("headed", "title").distinct()


def infer_layer(title: Column, rules: list[tuple[str, str]], default: str = "unknown") -> Column:
    """Layer of the first (pattern, layer) rule that matches."""
    return F.coalesce(*[F.when(title.rlike(p), layer) for p, layer in rules], F.lit(default))


def collapse_blank_lines(lines: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """Keep at most that many blank lines in a row."""
    order = Window.partitionBy(key).orderBy("line_no")
    blank = T.strip(F.col("line")) == ""
    island = F.sum((~blank).cast("int")).over(order.rowsBetween(FIRST, HERE))
    rows = lines.withColumn("island", island).withColumn("nth", F.sum(blank.cast("int")).over(Window.partitionBy(key, "island").orderBy("line_no").rowsBetween(FIRST, HERE)))
    return rows.where(~blank | (F.col("nth") <= most)).drop("island", "nth")


def normalize_line_markup(lines: DataFrame, headings: DataFrame, glyphs: str = "•·▪●○■◆*-") -> DataFrame:
    """One bullet marker for all glyphs; is_sub_heading marks lines that equal one of a small table of headings."""
    bullet = F.regexp_replace("line", rf"^\s*[{glyphs}]\s+", "- ")
    known = headings.select(F.col("heading").alias("known")).distinct()
    rows = lines.withColumn("line", bullet).join(known, T.strip(F.col("line")) == F.col("known"), "left")
    return rows.withColumn("is_sub_heading", F.col("known").isNotNull()).drop("known")


def attach_heading_context(blocks: DataFrame, key: str = "page_id") -> DataFrame:
    """Add heading: the last heading at or before each block."""
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(FIRST, HERE)
    return blocks.withColumn("heading", F.last(F.when(F.col("kind") == "heading", F.col("text")), ignorenulls=True).over(order))


def caption_from_neighbours(blocks: DataFrame, caption: str, key: str = "page_id", reach: int = 3) -> DataFrame:
    """Media blocks with a caption: next block that looks like one, own text, previous text, next text, heading, or a label."""
    order = Window.partitionBy(key).orderBy("pos")
    filled = F.when(F.col("text") != "", F.col("text"))
    body = F.when((F.col("text") != "") & (F.col("kind") != "heading"), F.col("text"))
    rows = attach_heading_context(blocks, key)
    rows = rows.withColumn("after", F.first(filled, ignorenulls=True).over(order.rowsBetween(1, reach))).withColumn("before", F.last(body, ignorenulls=True).over(order.rowsBetween(-reach, -1)))
    named = F.when(F.col("after").rlike(caption), F.col("after"))
    label = F.concat(F.lit("figure "), F.row_number().over(order).cast("string"))
    media = rows.where(F.col("kind") == "media").withColumn("caption", F.coalesce(named, filled, F.col("before"), F.col("after"), F.col("heading"), label))
    return media.drop("after", "before")


def dedupe_by_content_hash(rows: DataFrame, content: str, order: list[str], group: str) -> DataFrame:
    """First row of each content digest, numbered inside its group."""
    hashed = rows.withColumn("digest", F.md5(content))
    first = hashed.groupBy("digest").agg(F.min(F.struct(*order, group)).alias("first")).select("digest", "first.*")
    return ordinals(first, [group], [F.col(c) for c in (*order, "digest")], "number").withColumn("number", F.col("number").cast("int"))


def keyword_terms(text: Column, heading: Column, vocabulary: list[str], most: int = 10) -> Column:
    """Distinct vocabulary hits in order, the heading first."""
    hits = F.regexp_extract_all(text, F.lit("(" + "|".join(sorted(vocabulary, key=lambda v: (-len(v), v))) + ")"))
    lead = F.when(F.coalesce(heading, F.lit("")) != "", F.array(heading)).otherwise(F.array().cast("array<string>"))
    return F.slice(F.array_distinct(F.concat(lead, hits)), 1, most)


def html_lines(pages: DataFrame) -> DataFrame:
    """(page_id, line_no, line): block-level pieces of a page without scripts and styles, blanks kept."""
    html = F.regexp_replace(F.regexp_replace("html", r"(?s)<script[^>]*>.*?</script>", ""), r"(?s)<style[^>]*>.*?</style>", "")
    pieces = F.split(html, r"</?(?:p|h1|h2|div|li|ul|nav|article|footer|body|head)\b[^>]*>", -1)
    rows = pages.select("page_id", F.posexplode(pieces).alias("pos", "raw"))
    return rows.select("page_id", (F.col("pos") + 1).alias("line_no"), F.trim(F.regexp_replace("raw", r"<[^>]*>", "")).alias("line"))


def html_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, pos, kind, text): headings, paragraphs and boxes; boxes stand for media."""
    html = F.regexp_replace(F.regexp_replace("html", r"(?s)<script[^>]*>.*?</script>", ""), r"(?s)<style[^>]*>.*?</style>", "")
    pattern = F.lit(r"<(h1|p|div|li)\b[^>]*>([^<]*)")
    zipped = F.arrays_zip(F.regexp_extract_all(html, pattern, F.lit(1)).alias("tag"), F.regexp_extract_all(html, pattern, F.lit(2)).alias("text"))
    rows = pages.select("page_id", F.posexplode(zipped).alias("pos", "b"))
    kind = F.when(F.col("b.tag") == "h1", "heading").when(F.col("b.tag") == "div", "media").otherwise("text")
    return rows.select("page_id", (F.col("pos") + 1).alias("pos"), kind.alias("kind"), F.trim("b.text").alias("text"))
