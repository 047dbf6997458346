"""Queries of term dictionaries, items, codes and label sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import inventory as K
from quillspark.plans import section_queries as sq
from quillspark.plans.fixtures import sql_compact, sql_strip_heading, table
from quillspark.sources.scratch import written

KINDS = {"property": "properties", "mechanism": "mechanisms", "form": "forms"}
KEYS = ["the ", "que ", "der "]


def _terms():
    return F.array_distinct(F.array(T.strip_heading_prefix(F.col("title"))))


def knowledge(spark, sf_dir):
    """Sections with their terms and order."""
    return _placed(sq.sections(spark, sf_dir))


def heads(spark, sf_dir):
    """knowledge() without lines and texts."""
    return _placed(sq.heads(spark, sf_dir))


def _placed(sections):
    return sections.withColumn("terms", _terms()).withColumn("ord", F.col("doc_id") * 100000 + F.col("sec"))


def inventory(spark, sf_dir):
    """The dictionary alone needs titles, not sections."""
    return written(K.build_inventory(sq.titles(spark, sf_dir).withColumn("terms", _terms()), code=None), "inventory")


def base(spark, sf_dir):
    """Sections and dictionary, each made once."""
    sections = written(knowledge(spark, sf_dir), "knowledge")
    return sections, written(K.build_inventory(sections, code=None), "inventory")


def k1_build_inventory(spark, sf_dir):
    return inventory(spark, sf_dir)


def _brands(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    generated = K.ordered(part.select(F.col("p_brand").alias("bucket"), F.col("p_type").alias("term")).distinct(), ["bucket"], F.col("term"))
    custom = K.ordered(part.where("p_size <= 10").select(F.col("p_brand").alias("bucket"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_name END").alias("term")).distinct(), ["bucket"], F.desc("term"))
    return generated, custom


def k2_merge_inventory(spark, sf_dir):
    return K.merge_inventory(*_brands(spark, sf_dir))


def k3_all_terms(spark, sf_dir):
    generated, custom = _brands(spark, sf_dir)
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("term"), F.col("n_nationkey").alias("ord"))
    return K.all_terms(nations, custom, generated).select("term", "src")


def k4_terms_in_text(spark, sf_dir):
    found = K.terms_in_text(*base(spark, sf_dir))
    return found.select("id", "bucket", F.array_join("terms", "|").alias("terms"))


def items(spark, sf_dir, made=None):
    return K.build_items(*(base(spark, sf_dir) if made is None else made), KINDS, KEYS, code=None)


def k5_build_items(spark, sf_dir):
    return items(spark, sf_dir).select("id", "term", "definition", F.array_join("properties", "|").alias("properties"), F.array_join("mechanisms", "|").alias("mechanisms"), F.array_join("forms", "|").alias("forms"), F.md5("evidence").alias("evidence"), F.md5("response").alias("response"))


def k6_merge_items(spark, sf_dir):
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    generated = part.select(F.col("p_type").alias("term"), F.col("p_name").alias("definition"), F.array("p_brand").alias("aliases"), F.col("p_partkey").alias("ord"))
    custom = part.where("p_size = 1").groupBy(F.expr("CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END").alias("term")).agg(F.min("p_partkey").alias("ord"), F.min(F.expr("CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_brand END")).alias("definition"), F.sort_array(F.collect_set("p_brand")).alias("aliases"))
    merged = K.merge_items(generated, custom, ["definition"], ["aliases"])
    return merged.select("term", "definition", F.array_join("aliases", "|").alias("aliases"), F.col("at.generated").alias("generated"), F.col("at.ord").alias("ord"))


def aliases(spark, sf_dir):
    """Brands and nations as alias tables of growing precedence."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    default = nation.select(F.lower("n_name").alias("alias"), F.col("n_name").alias("canonical"))
    configured = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).where("n_nationkey % 2 = 0").select(F.lower("n_name").alias("alias"), F.col("r_name").alias("canonical"))
    own = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).where("s_suppkey % 7 = 0").groupBy(F.lower("n_name").alias("alias")).agg(F.max("s_name").alias("canonical"))
    return default, configured, own


def k7_apply_item_terms(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_type").alias("term"), F.array("p_name", "p_brand").alias("properties"))
    every, merged = K.apply_item_terms(table(spark, sf_dir, "nation").select(F.col("n_name").alias("term")), list(aliases(spark, sf_dir)), part, ["properties"])
    return every.select(F.lit("term").alias("kind"), "term", F.lit("").alias("canonical")).unionByName(merged.select(F.lit("alias").alias("kind"), F.col("alias").alias("term"), "canonical"))


def k8_assign_codes(spark, sf_dir):
    codes = table(spark, sf_dir, "region").select(F.concat(F.lit("R-"), "r_regionkey").alias("code"), F.col("r_regionkey").alias("ord"), F.lower("r_name").alias("label"), F.substring("r_name", 1, 2).alias("alias"))
    more = table(spark, sf_dir, "nation").select(F.concat(F.lit("N-"), "n_nationkey").alias("code"), (F.col("n_nationkey") + 10).alias("ord"), F.substring("n_name", 1, 8).alias("label"), F.lit(None).cast("string").alias("alias"))
    nodes = table(spark, sf_dir, "nation").select(F.col("n_name").alias("label")).unionByName(table(spark, sf_dir, "part").select(F.col("p_type").alias("label")).distinct())
    return K.assign_codes(nodes, codes.unionByName(more))


def k9_clean_outline_label(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", K.clean_outline_label(F.expr("p_brand || ': ' || p_type || ' (' || p_name || ')' || chr(10) || p_name")).alias("label"))


def k10_regroup_leaves(spark, sf_dir):
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    leaves = supplier.select(F.col("s_nationkey").alias("parent"), F.col("s_name").alias("leaf"), F.col("s_suppkey").alias("leaf_ord"))
    groups = supplier.where("s_suppkey % 3 != 0").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_nationkey").alias("parent"), F.col("s_name").alias("leaf"), F.expr("n_name || '-' || (s_suppkey % 3)").alias("subgroup"), (10 - F.col("s_suppkey") % 3).alias("group_ord"))
    return K.regroup_leaves(leaves, groups)


def k11_reconcile_labels(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    sheet = labels.select(F.col("doc_id").alias("seq"), F.expr("CASE WHEN doc_id % 11 > 0 THEN 'q' || doc_id END").alias("question"), F.expr("'quality' || quality").alias("original"), F.expr("CASE doc_id % 4 WHEN 0 THEN 'toxic' || toxic WHEN 1 THEN 'quality1 (sure)' WHEN 2 THEN 'nonsense' END").alias("corrected"))
    valid = spark.createDataFrame([("quality0",), ("quality1",), ("toxic0",), ("toxic1",)], "label string")
    overrides = labels.where("doc_id % 10 = 3").select(F.col("doc_id").alias("seq"), F.lit("toxic1").alias("label"))
    return K.reconcile_labels(sheet, valid, overrides)


def k12_labelling_sheet(spark, sf_dir):
    examples = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.expr("'quality' || quality || 'toxic' || toxic").alias("label"))
    meanings = spark.createDataFrame([("quality1toxic0", "fine"), ("quality0toxic0", "poor")], "label string, meaning string")
    return K.labelling_sheet(examples, meanings)


def k12_frame_detail(spark, sf_dir):
    frames = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("intent")).agg(F.sort_array(F.collect_list("n_name")).alias("sections"))
    return K.frame_detail(frames)


def k13_inventory_stats(spark, sf_dir):
    knowledge_rows = sq.sections(spark, sf_dir).agg(F.count("*").alias("sections"), F.count_distinct("layer").alias("layers"))
    vectors = table(spark, sf_dir, "embeddings").agg(F.count("*").alias("vectors"), F.max(F.size("embedding")).alias("dim"))
    corpus = table(spark, sf_dir, "orders").agg(F.min(F.year("o_orderdate")).alias("first_year"), F.max(F.year("o_orderdate")).alias("last_year"), F.count_distinct("o_orderpriority").alias("venues"))
    return knowledge_rows.join(vectors).join(corpus)


QUERIES = {f.__name__: f for f in (
    k1_build_inventory, k2_merge_inventory, k3_all_terms, k4_terms_in_text, k5_build_items, k6_merge_items, k7_apply_item_terms, k8_assign_codes,
    k9_clean_outline_label, k10_regroup_leaves, k11_reconcile_labels, k12_labelling_sheet, k12_frame_detail, k13_inventory_stats,
)}

_T = f"regexp_replace({sql_compact(sql_strip_heading('title'))}, '^[* ]+|[* ]+$', '', 'g')"
TERM_SQL = f"CASE WHEN {_T} = '' OR length({_T}) > 32 OR regexp_matches({_T}, '^\\d') OR regexp_matches({_T}, '(?i)^[a-z]\\s+') OR contains(lower({_T}), 'vs') THEN '' ELSE {_T} END"
INVENTORY_SQL = f"""{sq.SECTIONS_SQL},
termed AS (SELECT *, {TERM_SQL} AS term FROM sections),
inv AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY -length(term), term)::INT AS ord FROM (SELECT DISTINCT layer AS bucket, term FROM termed WHERE term <> ''))"""
HITS_SQL = f"""{INVENTORY_SQL},
hits AS (SELECT s.id, i.bucket, i.term, row_number() OVER (PARTITION BY s.id, i.bucket ORDER BY i.ord) AS rank FROM sections s JOIN inv i ON contains(lower(s.text), lower(i.term))),
lists AS (SELECT id, bucket, string_agg(term, '|' ORDER BY rank) AS terms FROM hits WHERE rank <= 12 GROUP BY id, bucket)"""
_GEN = "SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY term)::INT AS ord FROM (SELECT DISTINCT p_brand AS bucket, p_type AS term FROM part)"
_CUS = "SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY term DESC)::INT AS ord FROM (SELECT DISTINCT p_brand AS bucket, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_name END AS term FROM part WHERE p_size <= 10)"
_UNB = lambda x: f"regexp_replace({sql_compact(x)}, '^[-* ]+|[-* ]+$', '', 'g')"
_SECLINES = "string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]')"
ITEMS_SQL = f"""{HITS_SQL}, t AS (SELECT *, {_SECLINES} AS l FROM termed WHERE term <> ''),
u AS (SELECT *, list_transform(l, lambda x: {_UNB('x')}) AS rows FROM t),
h AS (SELECT *, list_filter(range(1, len(rows) + 1), lambda i: contains(rows[i], 'the ') OR contains(rows[i], 'que ') OR contains(rows[i], 'der '))[1] AS i FROM u),
items AS (SELECT h.id, term, layer, doc_id * 100000 + sec AS ord, title, left(coalesce(list_filter(rows[2:], lambda x: x <> '' AND NOT starts_with(x, '#'))[1], {sql_compact('text')}), 300) AS definition,
  coalesce(p.terms, '') AS properties, coalesce(m.terms, '') AS mechanisms, coalesce(f.terms, '') AS forms, left(text, 800) AS evidence,
  CASE WHEN i IS NULL THEN '' ELSE left(array_to_string(list_filter(rows[i:i + 2], lambda x: x <> ''), ' '), 300) END AS response
  FROM h LEFT JOIN lists p ON p.id = h.id AND p.bucket = 'property' LEFT JOIN lists m ON m.id = h.id AND m.bucket = 'mechanism' LEFT JOIN lists f ON f.id = h.id AND f.bucket = 'form')"""

ORACLES = {
    "k1_build_inventory": f"WITH {INVENTORY_SQL} SELECT bucket, term, ord FROM inv",
    "k2_merge_inventory": f"WITH r AS (SELECT *, 0 AS src FROM ({_CUS}) UNION ALL SELECT *, 1 FROM ({_GEN})), f AS (SELECT bucket, term, min(src * 1000000 + ord) AS a FROM r GROUP BY bucket, term) SELECT bucket, term, row_number() OVER (PARTITION BY bucket ORDER BY a, term)::INT AS ord FROM f",
    "k3_all_terms": f"SELECT term, min(src)::INT AS src FROM (SELECT n_name AS term, 0 AS src FROM nation UNION ALL SELECT term, 1 FROM ({_CUS}) UNION ALL SELECT term, 2 FROM ({_GEN})) GROUP BY term",
    "k4_terms_in_text": f"WITH {HITS_SQL} SELECT id, bucket, terms FROM lists",
    "k5_build_items": f"WITH {ITEMS_SQL} SELECT id, term, definition, properties, mechanisms, forms, md5(evidence) AS evidence, md5(response) AS response FROM items",
    "k6_merge_items": """WITH g AS (SELECT p_type AS term, arg_max(p_name, p_partkey) AS definition, arg_max(p_brand, p_partkey) AS brand, max(p_partkey) AS ord FROM part GROUP BY p_type),
        c AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END AS term, min(p_partkey) AS ord, min(CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_brand END) AS definition, list_sort(list_distinct(list(p_brand))) AS aliases FROM part WHERE p_size = 1 GROUP BY 1)
        SELECT coalesce(c.term, g.term) AS term, coalesce(nullif(c.definition, ''), g.definition, '') AS definition,
          array_to_string(CASE WHEN c.term IS NULL THEN [g.brand] WHEN g.term IS NULL OR list_contains(c.aliases, g.brand) THEN c.aliases ELSE list_append(c.aliases, g.brand) END, '|') AS aliases, c.term IS NULL AS generated, coalesce(c.ord, g.ord) AS ord FROM c FULL JOIN g ON c.term = g.term""",
    "k7_apply_item_terms": """WITH a AS (SELECT lower(n_name) AS alias, n_name AS canonical, 0 AS level FROM nation UNION ALL SELECT lower(n_name), r_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0
          UNION ALL SELECT lower(n_name), max(s_name), 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 7 = 0 GROUP BY 1)
        SELECT DISTINCT 'term' AS kind, term, '' AS canonical FROM (SELECT n_name AS term FROM nation UNION SELECT p_type FROM part UNION SELECT p_name FROM part UNION SELECT p_brand FROM part)
        UNION ALL SELECT 'alias', alias, arg_max(canonical, level) FROM a GROUP BY alias""",
    "k8_assign_codes": """WITH c AS (SELECT 'R-' || r_regionkey AS code, r_regionkey AS ord, lower(r_name) AS label, left(r_name, 2) AS alias FROM region UNION ALL SELECT 'N-' || n_nationkey, n_nationkey + 10, left(n_name, 8), '' FROM nation),
        m AS (SELECT *, lower(regexp_replace(label, '[\\s()（）_-]+', '', 'g')) AS cn FROM c), n AS (SELECT DISTINCT label, lower(regexp_replace(label, '[\\s()（）_-]+', '', 'g')) AS nn FROM (SELECT n_name AS label FROM nation UNION SELECT p_type FROM part))
        SELECT n.label, arg_min(code, ord) AS code FROM n LEFT JOIN m ON nn = cn OR lower(n.label) = lower(alias) OR (length(nn) >= 2 AND length(cn) >= 2 AND (starts_with(nn, cn) OR starts_with(cn, nn))) GROUP BY n.label""",
    "k9_clean_outline_label": "SELECT p_partkey, trim(p_type) AS label FROM part",
    "k10_regroup_leaves": """WITH g AS (SELECT s_nationkey AS parent, CASE WHEN s_suppkey % 3 <> 0 THEN n_name || '-' || (s_suppkey % 3) END AS subgroup, s_name AS leaf, s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN 10 - s_suppkey % 3 ELSE 2147483647 END AS o FROM supplier JOIN nation ON s_nationkey = n_nationkey)
        SELECT parent, subgroup, leaf, row_number() OVER (PARTITION BY parent ORDER BY o, s_suppkey, leaf)::INT AS ord FROM g""",
    "k11_reconcile_labels": """WITH s AS (SELECT doc_id AS seq, 'quality' || quality AS original, CASE doc_id % 4 WHEN 0 THEN 'toxic' || toxic WHEN 1 THEN 'quality1 (sure)' WHEN 2 THEN 'nonsense' END AS corrected FROM labels WHERE doc_id % 11 > 0),
        l AS (SELECT *, CASE WHEN seq % 10 = 3 THEN 'toxic1' WHEN seq % 4 = 0 THEN corrected WHEN seq % 4 = 1 THEN 'quality1' ELSE original END AS label FROM s)
        SELECT seq, label, label IS DISTINCT FROM original AS changed, coalesce(nullif(corrected, ''), original) AS note FROM l""",
    "k12_labelling_sheet": """WITH e AS (SELECT doc_id AS id, 'quality' || quality || 'toxic' || toxic AS label FROM labels)
        SELECT row_number() OVER (ORDER BY label, id) AS seq, id, label, CASE label WHEN 'quality1toxic0' THEN 'fine' WHEN 'quality0toxic0' THEN 'poor' ELSE '' END AS meaning FROM e""",
    "k12_frame_detail": """WITH f AS (SELECT r_name AS intent, n_name AS section, row_number() OVER (PARTITION BY r_name ORDER BY n_name)::INT AS number FROM nation JOIN region ON n_regionkey = r_regionkey)
        SELECT intent, number, section, number || '. ' || section AS heading FROM f""",
    "k13_inventory_stats": f"""WITH {sq.SECTIONS_SQL} SELECT (SELECT count(*) FROM sections) AS sections, (SELECT count(DISTINCT layer) FROM sections) AS layers, (SELECT count(*) FROM embeddings) AS vectors, (SELECT max(len(embedding)) FROM embeddings) AS dim,
        (SELECT min(year(o_orderdate)) FROM orders) AS first_year, (SELECT max(year(o_orderdate)) FROM orders) AS last_year, (SELECT count(DISTINCT o_orderpriority) FROM orders) AS venues""",
}
