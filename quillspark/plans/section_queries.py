"""Queries of lines, sections and document structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import sections as G
from quillspark.plans.fixtures import sql_clean, sql_strip, table

#: A short line is a heading in the test data.
HEADINGS = [("", r"^.{1,60}$")]
LAYERS = [(r"(?i)(?:^|\s)(?:the|of)(?:\s|$)", "mechanism"), (r"(?i)(?:^|\s)(?:de|la|que)(?:\s|$)", "property"), (r"(?i)(?:^|\s)(?:der|die|und)(?:\s|$)", "form")]
VOCABULARY = ["the", "and", "que", "para", "und", "der", "les", "tion", "with"]
CAPTION = r"^[A-Z].{0,50}\.$"


def lines(spark, sf_dir):
    return G.read_lines(table(spark, sf_dir, "documents"))


def sections(spark, sf_dir):
    """Sections of documents with id, source and layer: the knowledge base of the other queries."""
    return _named(G.sections_in_order(G.mark_headings(lines(spark, sf_dir), HEADINGS)))


def heads(spark, sf_dir):
    """sections() without their lines and texts."""
    return _named(G.section_heads(G.mark_headings(lines(spark, sf_dir), HEADINGS)))


def _named(rows):
    return rows.withColumn("id", F.concat_ws("#", F.col("doc_id"), F.col("sec"))).withColumn("layer", _layer(F.col("sec") > 0))


def titles(spark, sf_dir):
    """Distinct titles of the sections with their layers."""
    return G.section_titles(G.mark_headings(lines(spark, sf_dir), HEADINGS)).select("title", _layer(F.col("headed")).alias("layer"))


def _layer(headed):
    return F.when(~headed, "unknown").otherwise(G.infer_layer(F.col("title"), LAYERS))


def s1_read_lines(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line").cast("long")).alias("n_chars"), F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "|")).alias("digest"))


def g1_mark_headings(spark, sf_dir):
    return G.mark_headings(lines(spark, sf_dir), HEADINGS, F.lit("a"), first_line="^b").select("doc_id", "line_no", "is_heading")


def g2_split_sections(spark, sf_dir):
    return sections(spark, sf_dir).select("id", "title", "start_line", "end_line", F.md5("text").alias("digest"))


def g3_infer_layer(spark, sf_dir):
    return sections(spark, sf_dir).select("id", "layer")


def g4_collapse_blank_lines(spark, sf_dir):
    return G.collapse_blank_lines(G.html_lines(table(spark, sf_dir, "pages")), 1, "page_id").select("page_id", "line_no", F.md5("line").alias("digest"))


def g5_normalize_line_markup(spark, sf_dir):
    rows = G.html_lines(table(spark, sf_dir, "pages")).withColumn("line", F.expr("CASE line_no % 4 WHEN 0 THEN '• ' || line WHEN 1 THEN '  * ' || line ELSE line END"))
    known = table(spark, sf_dir, "region").select(F.lower("r_name").alias("heading")).unionByName(spark.createDataFrame([("the",), ("and",), ("de",), ("en",)], "heading string"))
    return G.normalize_line_markup(rows, F.broadcast(known)).select("page_id", "line_no", F.md5("line").alias("digest"), "is_sub_heading")


def g6_attach_heading_context(spark, sf_dir):
    return G.attach_heading_context(G.html_blocks(table(spark, sf_dir, "pages"))).select("page_id", "pos", "kind", "heading")


def media(spark, sf_dir):
    """Media blocks of pages: id, page, heading, caption and terms."""
    found = G.caption_from_neighbours(G.html_blocks(table(spark, sf_dir, "pages")), CAPTION)
    return found.withColumn("id", F.concat_ws(":", "page_id", "pos")).withColumn("terms", G.keyword_terms(F.lower("caption"), F.lit(None).cast("string"), VOCABULARY))


def g7_caption_from_neighbours(spark, sf_dir):
    return media(spark, sf_dir).select("page_id", "pos", "caption")


def g8_dedupe_by_content_hash(spark, sf_dir):
    return G.dedupe_by_content_hash(table(spark, sf_dir, "documents"), "text", ["doc_id"], "source").select("digest", "doc_id", "source", "number")


def g9_keyword_terms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(G.keyword_terms(F.lower("text"), F.col("source"), VOCABULARY), ",").alias("terms"))


QUERIES = {f.__name__: f for f in (
    s1_read_lines, g1_mark_headings, g2_split_sections, g3_infer_layer, g4_collapse_blank_lines, g5_normalize_line_markup, g6_attach_heading_context,
    g7_caption_from_neighbours, g8_dedupe_by_content_hash, g9_keyword_terms,
)}

LINES_SQL = f"""raw_lines AS (SELECT doc_id, string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS l FROM documents),
cut_lines AS (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM raw_lines),
lines AS (SELECT doc_id, i::INT AS line_no, regexp_replace({sql_clean('l[i]')}, '[\\s\\x{{a0}}\\x{{85}}\\x{{2000}}-\\x{{200a}}]+$', '') AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM cut_lines)),
marked AS (SELECT *, regexp_matches({sql_strip('line')}, '^.{{1,60}}$') AS is_heading FROM lines)"""
SECTIONS_SQL = f"""{LINES_SQL},
numbered AS (SELECT *, sum(is_heading::INT) OVER (PARTITION BY doc_id ORDER BY line_no)::INT AS sec, sum(is_heading::INT) OVER (PARTITION BY doc_id) AS every FROM marked),
bare_sections AS (SELECT doc_id, sec, CASE WHEN sec > 0 THEN {sql_strip('min_by(line, line_no)')} ELSE doc_id::VARCHAR END AS title, min(line_no) AS start_line, max(line_no) AS end_line,
  coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER ({sql_strip('line')} <> ''), '') AS text FROM numbered WHERE sec > 0 OR every = 0 GROUP BY doc_id, sec),
sections AS (SELECT doc_id || '#' || sec AS id, *, CASE WHEN sec = 0 THEN 'unknown' WHEN regexp_matches(title, '(?i)(?:^|\\s)(?:the|of)(?:\\s|$)') THEN 'mechanism' WHEN regexp_matches(title, '(?i)(?:^|\\s)(?:de|la|que)(?:\\s|$)') THEN 'property'
  WHEN regexp_matches(title, '(?i)(?:^|\\s)(?:der|die|und)(?:\\s|$)') THEN 'form' ELSE 'unknown' END AS layer FROM bare_sections)"""
_HTML = "regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>', '', 'g'), '(?s)<style[^>]*>.*?</style>', '', 'g')"
HTML_LINES_SQL = f"""pieces AS (SELECT page_id, string_split_regex({_HTML}, '</?(?:p|h1|h2|div|li|ul|nav|article|footer|body|head)\\b[^>]*>') AS l FROM pages),
html_lines AS (SELECT page_id, i::INT AS line_no, trim(regexp_replace(l[i], '<[^>]*>', '', 'g'), ' ') AS line FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM pieces))"""
BLOCKS_SQL = f"""found AS (SELECT page_id, regexp_extract_all({_HTML}, '<(h1|p|div|li)\\b[^>]*>([^<]*)', 1) AS tags, regexp_extract_all({_HTML}, '<(h1|p|div|li)\\b[^>]*>([^<]*)', 2) AS texts FROM pages),
blocks AS (SELECT page_id, i::INT AS pos, CASE tags[i] WHEN 'h1' THEN 'heading' WHEN 'div' THEN 'media' ELSE 'text' END AS kind, trim(texts[i], ' ') AS text FROM (SELECT *, unnest(range(1, len(tags) + 1)) AS i FROM found)),
headed AS (SELECT *, last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos) AS heading FROM blocks)"""
MEDIA_SQL = f"""{BLOCKS_SQL},
around AS (SELECT *, first_value(CASE WHEN text <> '' THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS nxt,
  last_value(CASE WHEN text <> '' AND kind <> 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS prv, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS nth FROM headed),
media AS (SELECT page_id || ':' || pos AS id, page_id, pos, heading, coalesce(CASE WHEN regexp_matches(nxt, '^[A-Z].{{0,50}}\\.$') THEN nxt END, CASE WHEN text <> '' THEN text END, prv, nxt, heading, 'figure ' || nth) AS caption FROM around WHERE kind = 'media')"""
_VOC = "|".join(sorted(VOCABULARY, key=lambda v: (-len(v), v)))
DISTINCT = lambda x: f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"

ORACLES = {
    "s1_read_lines": f"WITH {LINES_SQL} SELECT doc_id, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars, md5(string_agg(line, '|' ORDER BY line_no)) AS digest FROM lines GROUP BY doc_id",
    "g1_mark_headings": f"WITH {LINES_SQL} SELECT doc_id, line_no, is_heading FROM marked",
    "g2_split_sections": f"WITH {SECTIONS_SQL} SELECT id, title, start_line, end_line, md5(text) AS digest FROM sections",
    "g3_infer_layer": f"WITH {SECTIONS_SQL} SELECT id, layer FROM sections",
    "g4_collapse_blank_lines": f"""WITH {HTML_LINES_SQL}, i AS (SELECT *, sum((line <> '')::INT) OVER (PARTITION BY page_id ORDER BY line_no) AS island FROM html_lines),
        n AS (SELECT *, sum((line = '')::INT) OVER (PARTITION BY page_id, island ORDER BY line_no) AS nth FROM i) SELECT page_id, line_no, md5(line) AS digest FROM n WHERE line <> '' OR nth <= 1""",
    "g5_normalize_line_markup": f"""WITH {HTML_LINES_SQL}, b AS (SELECT page_id, line_no, regexp_replace(CASE line_no % 4 WHEN 0 THEN '• ' || line WHEN 1 THEN '  * ' || line ELSE line END, '^\\s*[•·▪●○■◆*-]\\s+', '- ') AS line FROM html_lines)
        SELECT page_id, line_no, md5(line) AS digest, {sql_strip('line')} IN (SELECT lower(r_name) FROM region UNION ALL VALUES ('the'), ('and'), ('de'), ('en')) AS is_sub_heading FROM b""",
    "g6_attach_heading_context": f"WITH {BLOCKS_SQL} SELECT page_id, pos, kind, heading FROM headed",
    "g7_caption_from_neighbours": f"WITH {MEDIA_SQL} SELECT page_id, pos, caption FROM media",
    "g8_dedupe_by_content_hash": "WITH f AS (SELECT md5(text) AS digest, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY 1) SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS number FROM f",
    "g9_keyword_terms": f"WITH h AS (SELECT doc_id, list_concat([source], regexp_extract_all(lower(text), '{_VOC}')) AS h FROM documents), f AS (SELECT doc_id, list_sort(list_transform(list_distinct(h), lambda v: {{'p': list_position(h, v), 'v': v}})) AS f FROM h) SELECT doc_id, array_to_string(list_transform(f[1:10], lambda x: x.v), ',') AS terms FROM f",
}
