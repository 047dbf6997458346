"""Queries of the text projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.plans.fixtures import sql_clean, sql_compact, sql_strip, sql_strip_heading, table

LETTERS = r"[\p{L}]+"
ACCENTED = r"[à-ÿ]+"
KEYS = ["the ", "que ", "der "]


def p1_clean_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("\u0007　"), "text").alias("text"))
    return T.clean_text(docs, "text").select("doc_id", F.length("text").alias("n"), F.md5("text").alias("digest"))


def p2_normalize_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(T.normalize_query(F.concat(F.lit("  "), "text"))).alias("normalized"), F.md5(T.compact_whitespace(F.col("text"))).alias("compact"))


def p3_char_ngrams(spark, sf_dir):
    grams = table(spark, sf_dir, "documents").select("doc_id", T.char_ngrams(F.col("text"), LETTERS).alias("g"))
    return grams.select("doc_id", F.size("g").alias("n"), F.md5(F.array_join(F.sort_array("g"), " ")).alias("digest"))


def p4_token_set(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select("doc_id", T.token_set(F.col("text"), ACCENTED).alias("t"))
    return tokens.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join(F.sort_array("t"), " ")).alias("digest"))


_PREFIXED = "CASE p_partkey % 6 WHEN 0 THEN '12、' WHEN 1 THEN '3-b ' WHEN 2 THEN '4. ' WHEN 3 THEN '(7) ' WHEN 4 THEN '【' ELSE '' END || p_name || CASE WHEN p_partkey % 4 = 0 THEN ' (x y)' ELSE '】' END"


def p5_strip_heading_prefix(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.strip_heading_prefix(F.expr(_PREFIXED)).alias("title"))


def _titles(spark, sf_dir):
    # a text without lines has an empty title, a null text none
    first = F.coalesce(F.get(T.lines_array(F.col("text")), F.lit(0)), F.when(F.col("text").isNotNull(), ""))
    return table(spark, sf_dir, "documents").select("doc_id", first.alias("title"))


_TITLES = "titles AS (SELECT doc_id, string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]')[1] AS title FROM documents)"


def p6_canonical_term(spark, sf_dir):
    return _titles(spark, sf_dir).select("doc_id", T.canonical_term(F.col("title"), code=None).alias("term"), T.canonical_term(F.col("title")).alias("strict_term"))


def p7_title_terms(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.expr("concat(p_partkey % 9, '-b ', p_name, ' vs ', p_type, ' (', p_brand, ') (é', p_size, ')')").alias("title"))
    return parts.select("p_partkey", F.array_join(T.title_terms(F.col("title")), "|").alias("terms"))


def p8_first_meaningful_line(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.first_meaningful_line(F.col("text")).alias("line"))


def p9_window_at_keyword(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.window_at_keyword(F.col("text"), KEYS).alias("excerpt"))


def p10_term_type(spark, sf_dir):
    docs = _titles(spark, sf_dir).withColumn("layer", F.element_at(F.array(*map(F.lit, ("property", "form", "mechanism", "other"))), (F.pmod("doc_id", F.lit(4)) + 1).cast("int")))
    kinds = {"property": "basic property", "form": "control form", "mechanism": "basic mechanism"}
    return docs.select("doc_id", T.term_type(F.col("layer"), F.col("title"), kinds, ("mechanism", "(?i)^[te]", "combined mechanism")).alias("term_type"))


def p11_truncate_at_boundary(spark, sf_dir):
    cut = T.truncate_at_boundary(F.col("text"), 400, ("\n\n", "\n", ". ", ", "))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(cut).alias("n"), F.md5(cut).alias("digest"))


def p12_citations(spark, sf_dir):
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
    authors = F.filter(F.array("c_name", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority"))), lambda a: a.isNotNull())
    year = F.when(F.col("o_orderkey") % 5 > 0, F.year("o_orderdate"))
    return rows.select(
        "o_orderkey", T.paper_citation(authors, year, F.col("o_orderpriority"), F.col("c_mktsegment")).alias("paper"),
        T.citation(F.col("c_name"), F.col("o_custkey"), F.col("o_orderkey")).alias("section"), T.embedding_text(F.col("c_name"), F.col("o_orderstatus")).alias("embed_text"),
    )


_FENCED = "CASE turn % 4 WHEN 0 THEN '```md' || chr(10) || text || chr(10) || '```' WHEN 1 THEN '```python' || chr(10) || text || chr(10) || '```' WHEN 2 THEN '```' || chr(10) || text || '```x```' ELSE text END"


def p13_unwrap_fence(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_FENCED).alias("answer"))
    return rows.select("conv_id", "turn", F.md5(T.unwrap_fence(F.col("answer"))).alias("digest"), F.length(T.unwrap_fence(F.col("answer"))).alias("n"))


def p14_bigram_dice(spark, sf_dir):
    """Neighbours of one conversation: each user turn against the next."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    pairs = turns.join(after, ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", F.bround(T.dice(T.bigrams(F.col("text")), T.bigrams(F.col("next_text"))), 6).alias("dice"))


def p15_sequence_ratio(spark, sf_dir):
    """Neighbours of one conversation: how alike each turn and the next are."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    pairs = turns.join(after, ["conv_id", "turn"])
    return T.text_similarity(pairs, "text", "next_text", "similarity", 0.0).select("conv_id", "turn", F.bround("similarity", 6).alias("similarity"))


QUERIES = {f.__name__: f for f in (
    p1_clean_text, p2_normalize_query, p3_char_ngrams, p4_token_set, p5_strip_heading_prefix, p6_canonical_term, p7_title_terms, p8_first_meaningful_line,
    p9_window_at_keyword, p10_term_type, p11_truncate_at_boundary, p12_citations, p13_unwrap_fence, p14_bigram_dice, p15_sequence_ratio,
)}


def _sql_grams(runs: str) -> str:
    return f"list_distinct(flatten(list_transform({runs}, lambda r: flatten(list_transform([2, 3, 4], lambda n: CASE WHEN length(r) >= n THEN list_transform(range(1, length(r) - n + 2), lambda i: substr(r, i, n)) ELSE [] END)))))"


def _sql_canonical(x: str, code: bool) -> str:
    term = f"regexp_replace({sql_compact(x)}, '^[* ]+|[* ]+$', '', 'g')"
    extra = f" OR regexp_full_match({term}, '\\d+-[a-zA-Z]|[0-9A-Za-z /×÷+\\-]+')" if code else ""
    return f"CASE WHEN {term} = '' OR length({term}) > 32 OR regexp_matches({term}, '^\\d') OR regexp_matches({term}, '(?i)^[a-z]\\s+') OR contains(lower({term}), 'vs'){extra} THEN '' ELSE {term} END"


_LINES = "string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]')"
_UNBULLET = lambda x: f"regexp_replace({sql_compact(x)}, '^[-* ]+|[-* ]+$', '', 'g')"
_CUT = "".join(
    f"WHEN instr(reverse(left(text, 400)), {m[::-1]!r}) > 0 AND 401 - instr(reverse(left(text, 400)), {m[::-1]!r}) - {len(m)} >= 200 THEN rtrim(left(text, 401 - instr(reverse(left(text, 400)), {m[::-1]!r})), ' ') "
    for m in (". ", ", ")
)
_BREAK = "".join(
    f"WHEN instr(reverse(left(text, 400)), {m}) > 0 AND 401 - instr(reverse(left(text, 400)), {m}) - {n} >= 200 THEN rtrim(left(text, 401 - instr(reverse(left(text, 400)), {m})), ' ') "
    for m, n in (("chr(10) || chr(10)", 2), ("chr(10)", 1))
)
_BIGRAMS = lambda x: f"(SELECT CASE WHEN length(s) > 1 THEN list_distinct(list_transform(range(1, length(s)), lambda i: substr(s, i, 2))) WHEN length(s) = 1 THEN [s] ELSE [] END FROM (SELECT regexp_replace({x}, '\\s+', '', 'g') AS s))"

ORACLES = {
    "p1_clean_text": f"WITH d AS (SELECT doc_id, {sql_clean('chr(7) || chr(12288) || text')} AS t FROM documents) SELECT doc_id, length(t) AS n, md5(t) AS digest FROM d",
    "p2_normalize_query": f"SELECT doc_id, md5(lower({sql_strip(sql_clean('text'))})) AS normalized, md5({sql_compact('text')}) AS compact FROM documents",
    "p3_char_ngrams": f"WITH g AS (SELECT doc_id, {_sql_grams(chr(39).join(['regexp_extract_all(text, ', LETTERS, ')']))} AS g FROM documents) SELECT doc_id, len(g) AS n, md5(array_to_string(list_sort(g), ' ')) AS digest FROM g",
    "p4_token_set": f"""WITH n AS (SELECT doc_id, lower({sql_strip(sql_clean('text'))}) AS t FROM documents),
        g AS (SELECT doc_id, list_distinct(list_concat(regexp_extract_all(t, '[a-zA-Z][a-zA-Z0-9_-]+'), {_sql_grams("regexp_extract_all(t, '[à-ÿ]+')")})) AS g FROM n)
        SELECT doc_id, len(g) AS n, md5(array_to_string(list_sort(g), ' ')) AS digest FROM g""",
    "p5_strip_heading_prefix": f"WITH t AS (SELECT p_partkey, {_PREFIXED} AS t FROM part) SELECT p_partkey, {sql_strip_heading('t')} AS title FROM t",
    "p6_canonical_term": f"WITH {_TITLES} SELECT doc_id, {_sql_canonical('title', False)} AS term, {_sql_canonical('title', True)} AS strict_term FROM titles",
    "p7_title_terms": """SELECT p_partkey, array_to_string(list_filter([b, p_name_, p_type_, code, n2, brand, acc], lambda x: x IS NOT NULL), '|') AS terms FROM (
        SELECT p_partkey, trim(p_name || ' vs ' || p_type) AS b, CASE WHEN length(p_name) BETWEEN 2 AND 24 THEN p_name END AS p_name_, CASE WHEN length(p_type) BETWEEN 2 AND 24 THEN p_type END AS p_type_,
               (p_partkey % 9) || '-b' AS code, NULL AS n2, CASE WHEN NOT regexp_full_match(p_brand, '[0-9A-Za-z /×÷+\\-]+') AND length(p_brand) <= 24 THEN p_brand END AS brand, 'é' || p_size AS acc FROM part)""",
    "p8_first_meaningful_line": f"SELECT doc_id, left(coalesce(list_filter(list_transform({_LINES}[2:], lambda x: {_UNBULLET('x')}), lambda x: x <> '' AND NOT starts_with(x, '#'))[1], {sql_compact('text')}), 300) AS line FROM documents",
    "p9_window_at_keyword": f"""WITH r AS (SELECT doc_id, list_transform({_LINES}, lambda x: {_UNBULLET('x')}) AS rows FROM documents),
        h AS (SELECT *, list_filter(range(1, len(rows) + 1), lambda i: contains(rows[i], 'the ') OR contains(rows[i], 'que ') OR contains(rows[i], 'der '))[1] AS i FROM r)
        SELECT doc_id, CASE WHEN i IS NULL THEN '' ELSE left(array_to_string(list_filter(rows[i:i + 2], lambda x: x <> ''), ' '), 300) END AS excerpt FROM h""",
    "p10_term_type": f"WITH {_TITLES} SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'basic property' WHEN 1 THEN 'control form' WHEN 2 THEN CASE WHEN regexp_matches(title, '(?i)^[te]') THEN 'combined mechanism' ELSE 'basic mechanism' END ELSE 'undecided' END AS term_type FROM titles",
    "p11_truncate_at_boundary": f"WITH c AS (SELECT doc_id, CASE WHEN length(text) <= 400 THEN text {_BREAK} {_CUT} ELSE left(text, 400) END AS c FROM documents) SELECT doc_id, length(c) AS n, md5(c) AS digest FROM c",
    "p12_citations": """SELECT o_orderkey, c_name || CASE WHEN o_orderkey % 3 = 0 THEN ' et al.' ELSE '' END || ' (' || CASE WHEN o_orderkey % 5 > 0 THEN year(o_orderdate)::VARCHAR ELSE 'n.d.' END || '). ' || o_orderpriority || '. ' || c_mktsegment || '.' AS paper,
        c_name || ':' || o_custkey || '-' || o_orderkey AS section, c_name || chr(10) || chr(10) || o_orderstatus AS embed_text FROM orders JOIN customer ON o_custkey = c_custkey""",
    "p13_unwrap_fence": f"WITH a AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text ELSE {_FENCED} END AS a FROM conversations) SELECT conv_id, turn, md5(a) AS digest, length(a) AS n FROM a",
    "p14_bigram_dice": f"""WITH p AS (SELECT a.conv_id, a.turn, a.text AS x, b.text AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
        g AS (SELECT conv_id, turn, {_BIGRAMS('x')} AS gx, {_BIGRAMS('y')} AS gy FROM p)
        SELECT conv_id, turn, CASE WHEN len(gx) + len(gy) > 0 THEN round_even(2.0::DOUBLE * len(list_intersect(gx, gy)) / (len(gx) + len(gy)), 6) ELSE 0 END AS dice FROM g""",
}
