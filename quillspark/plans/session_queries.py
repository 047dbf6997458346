"""Queries of conversations (windows, session machine) and of sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.plans import inventory_queries as iq
from quillspark.plans import retrieval_queries as rq
from quillspark.plans import section_queries as sq
from quillspark.plans.fixtures import table
from quillspark.sources import io
from quillspark.streaming import answers as A
from quillspark.streaming import sessions as C

TERMS = ["that", "with", "this", "from", "para", "esta", "pour", "dans", "nicht", "eine"]
ANAPHORA, CUE, FOLLOW_UP = r"(?i)\bthis\b", r"(?i)\bwith\b|\bque\b", r"(?i)\bis\b"
RULES = C.SessionRules(
    TERMS, [("compare", 0.95, "(?i)and"), ("case", 0.82, "(?i)that"), ("evaluation", 0.92, "(?i)of"), ("property", 0.6, "(?i)der"), ("form", 0.91, "(?i)que")],
    "(?i)this", "(?i)with", ("evaluation", "(?i)is"), {"form": [("a", ["para"]), ("b", ["les"])]},
)


def turns(spark, sf_dir):
    """User turns with terms and an intent, as if every turn completed."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    hits = F.array_compact(F.array(*[F.when(F.lower("text").contains(t), F.lit(t)) for t in TERMS]))
    return rows.withColumn("terms", hits).withColumn("intent", F.when(F.col("text").contains("of"), "evaluation").otherwise("case"))


def c1_memory_summary(spark, sf_dir):
    return C.memory_summary(turns(spark, sf_dir), 4).select("conv_id", "turn", F.md5("memory").alias("digest"))


def c2_shares_recent_topic(spark, sf_dir):
    return C.shares_recent_topic(turns(spark, sf_dir)).select("conv_id", "turn", "shares_topic")


def c3_carried_intent(spark, sf_dir):
    return C.carried_intent(turns(spark, sf_dir), "evaluation", FOLLOW_UP).select("conv_id", "turn", "carried")


def classified(spark, sf_dir):
    rows = C.carried_intent(C.shares_recent_topic(turns(spark, sf_dir)), "evaluation", FOLLOW_UP)
    external = turns(spark, sf_dir).where("conv_id % 5 = 0").select("conv_id", "turn", F.lit("follow_up").alias("relation"), F.lit(0.7).alias("confidence"))
    return C.classify_turns(rows, ANAPHORA, CUE, external)


def c4_classify_turns(spark, sf_dir):
    return classified(spark, sf_dir).select("conv_id", "turn", "relation", "confidence")


def c6_contextualize_query(spark, sf_dir):
    return C.contextualize_query(classified(spark, sf_dir)).select("conv_id", "turn", F.md5("contextual").alias("digest"))


def _session_turns(rows):
    control = F.when((F.col("conv_id") % 10 == 3) & (F.col("turn") % 5 == 4), "/reset").when((F.col("conv_id") % 10 == 7) & (F.col("turn") % 6 == 5), "/drop")
    return rows.where("role = 'user'").select(F.col("conv_id").alias("session"), "turn", F.coalesce(control, F.col("text")).alias("text"))


def c7_session_machine(spark, sf_dir):
    return C.run_sessions(_session_turns(table(spark, sf_dir, "conversations")), RULES)


def _read_stream(spark, sf_dir, name):
    """The table as a stream of files; a table that is one file is picked out of its folder."""
    rows = table(spark, sf_dir, name)
    reader = spark.readStream.schema(rows.schema)
    if all(f.endswith(f"/{name}.parquet") for f in rows.inputFiles()):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def _stream(spark, sf_dir):
    return _session_turns(_read_stream(spark, sf_dir, "conversations"))


def c7_session_stream(spark, sf_dir):
    return A.run_stream(_stream(spark, sf_dir), RULES)


def c5_topic_switches(spark, sf_dir):
    """Turns that follow a clarification: replies to it, or new topics that dropped it."""
    done = c7_session_machine(spark, sf_dir)
    after = done.select("session", (F.col("turn")).alias("turn"), "status", "relation")
    from pyspark.sql import Window

    last = F.lag("status").over(Window.partitionBy("session").orderBy("turn"))
    return after.withColumn("last", last).where("last = 'clarify'").select("session", "turn", (F.col("relation") != "clarify_reply").alias("switched"))


def c8_control_events(spark, sf_dir):
    """Control turns, and how many turns the next one sees."""
    from pyspark.sql import Window

    done = c7_session_machine(spark, sf_dir)
    window = Window.partitionBy("session").orderBy("turn")
    return done.withColumn("next_turns", F.lead("turns").over(window)).where("status IN ('reset', 'drop')").select("session", "turn", "status", "next_turns")


def c9_answer_pipeline(spark, sf_dir):
    frames = spark.createDataFrame([("case", "summary")], "intent string, section string")
    unsupported = spark.createDataFrame([("the", "and", 0), ("that", "with", 1)], "term string, mechanism string, ord int")
    answers = table(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.concat_ws(":", "conv_id", F.col("turn") - 1).alias("qid"), F.lit("case").alias("intent"), F.concat("text", F.lit(" ![x](image:"), F.concat_ws(":", F.col("conv_id") % 50, F.lit(1)), F.lit(")")).alias("answer"))
    media = sq.media(spark, sf_dir).withColumn("name", F.concat("id", F.lit(".png")))
    terms = io.written(iq.inventory(spark, sf_dir).select("term").distinct(), "terms")
    knowledge = A.Knowledge(io.written(iq.knowledge(spark, sf_dir), "knowledge"), frames, terms, io.written(media, "media"), unsupported, io.scratch(spark, "question-log"), "aeiou")
    done = A.run_stream(_stream(spark, sf_dir), RULES, lambda batch: A.answer_batch(batch, knowledge, answers, retrieval_intent="property"))
    return done.select("session", "turn", "status", "corrected", F.md5("terms").alias("terms"), "hits", "media", "audit", F.md5("answer").alias("answer"))


def _papers(spark, sf_dir):
    rows = rq.papers(spark, sf_dir).select("id", F.trim("title").alias("title"), F.trim("abstract").alias("abstract"), F.coalesce("doi", F.lit("")).alias("doi"), "ord")
    return rows.withColumn("authors", F.when(F.col("ord") % 2 == 0, F.array(F.lit("A"))))


def s2_read_corpus(spark, sf_dir):
    path = io.scratch(spark, "corpus")
    io.write_corpus(_papers(spark, sf_dir), path)
    return io.read_corpus(spark, path).select("key", "ord", F.size("authors").alias("authors"), "citations")


def s3_write_corpus(spark, sf_dir):
    path, rows = io.scratch(spark, "corpus"), _papers(spark, sf_dir)
    io.write_corpus(rows.where("ord % 2 = 0"), path)
    io.write_corpus(rows.where("ord % 2 = 1"), path, "append")
    return spark.read.schema("ord long").json(path).agg(F.count("*").alias("n"), F.sum("ord").alias("total"))


def s4_index_files(spark, sf_dir):
    path = io.scratch(spark, "index")
    io.save_index(rq.vectors(spark, sf_dir), path, "m1")
    return io.load_index(spark, path).groupBy("model").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim"))


def _inventory_json(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    lists = rows.groupBy("s_nationkey", "n_name").agg(F.sort_array(F.collect_list("s_name")).alias("names"))
    nested = F.struct(F.create_map(F.lit("layer1"), "names", F.lit("layer2"), F.array("n_name", F.lit(" "))).alias("by_layer"), F.create_map("n_name", "names").alias("by_type"), F.array("n_name").alias("structural"), F.create_map(F.lit("flat"), F.to_json(F.create_map("n_name", F.lit("x")))).alias("aliases"))
    return lists.select(F.col("s_nationkey").alias("doc"), F.to_json(nested).alias("json"))


def s5_read_inventory_flat(spark, sf_dir):
    return io.read_inventory_flat(_inventory_json(spark, sf_dir), ["layer1", "layer2"])


def s6_flatten_inventory_tree(spark, sf_dir):
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    none = F.lit(None).cast("string")
    nodes = region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), none.alias("parent"), F.col("r_name").alias("label"), F.col("r_name").alias("layer"), none.alias("type"))
    nodes = nodes.unionByName(nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("label"), F.when(F.col("n_nationkey") % 4 == 0, F.lit("own")).alias("layer"), F.col("n_name").alias("type")))
    nodes = nodes.unionByName(supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("parent"), F.col("s_name").alias("label"), none.alias("layer"), none.alias("type")))
    return io.flatten_inventory_tree(nodes)


def s6_tree_inventory(spark, sf_dir):
    """Leaves by layer and type, subgroups and aliases of the tree of regions, nations and suppliers; layers are the regions' names, and own."""
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    none, no_alias = F.lit(None).cast("string"), F.array().cast("array<string>")
    nodes = region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), none.alias("parent"), F.col("r_name").alias("label"), F.lit("place").alias("layer"), F.lit("root").alias("type"), no_alias.alias("aliases"))
    nodes = nodes.unionByName(nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("label"), F.when(F.col("n_nationkey") % 4 == 0, F.lit("own")).alias("layer"), none.alias("type"), F.array(F.lower("n_name"), F.lit(" ")).alias("aliases")))
    nodes = nodes.unionByName(supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("parent"), F.col("s_name").alias("label"), none.alias("layer"), F.when(F.col("s_suppkey") % 3 == 0, F.lit("third")).alias("type"), no_alias.alias("aliases")))
    over = nation.where("n_nationkey % 5 = 0").select(F.lower("n_name").alias("alias"), F.concat(F.lit("N"), "n_nationkey").alias("canonical"))
    return io.tree_inventory(nodes, over, ["place", "own"])


def s14_in_years(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where(io.in_years(F.year("o_orderdate"), 1994, 1996))
    return orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")).withColumn("years", F.lit(io.year_range(1994, 1996)))


def s7_read_structured_items(spark, sf_dir):
    items = iq.items(spark, sf_dir).select((F.floor(F.col("ord") / 100000) % 20).alias("doc"), "term", "layer", "ord")
    lists = items.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("ord", "term", "layer"))).alias("xs")).select("doc", F.transform("xs", lambda x: F.struct(x["term"].alias("term"), x["layer"].alias("layer"))).alias("items"))
    docs = lists.select("doc", F.when(F.col("doc") % 2 == 0, F.to_json("items")).otherwise(F.to_json(F.struct("items"))).alias("json"))
    return io.read_structured_items(docs, ["mechanism", "property", "form", "unknown"]).select("doc", "pos", "id", "term", "term_type", "layer")


def s8_export_structured_items(spark, sf_dir):
    return io.export_structured_items(iq.items(spark, sf_dir), "layer").select("layer", F.length("json").alias("n"))


def s9_read_examples(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("e", F.struct(F.expr("CASE WHEN turn % 4 = 0 THEN ' ' ELSE role || turn END").alias("question"), F.expr("CASE WHEN conv_id % 3 = 0 THEN 'bogus' ELSE role END").alias("intent")))
    docs = rows.groupBy(F.col("conv_id").alias("doc")).agg(F.sort_array(F.collect_list(F.struct("turn", "e"))).alias("xs")).select("doc", F.when(F.col("doc") % 9 == 5, "{broken").otherwise(F.to_json(F.struct(F.transform("xs", lambda x: x["e"]).alias("examples")))).alias("json"))
    return io.read_examples(docs, spark.createDataFrame([("user",), ("assistant",)], "intent string"))


def _frame_docs(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("doc", F.col("n_nationkey") % 3)
    lists = rows.groupBy("doc", "r_name").agg(F.sort_array(F.collect_list("n_name")).alias("names")).groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("r_name", "names"))).alias("frames"))
    return lists.select("doc", F.when(F.col("doc") == 0, F.to_json("frames")).otherwise(F.to_json(F.struct("frames"))).alias("json"))


def s10_read_frames(spark, sf_dir):
    regions = [r[0] for r in table(spark, sf_dir, "region").select("r_name").collect()]
    return io.read_frames(_frame_docs(spark, sf_dir), regions)[0]


def s10_frame_coverage(spark, sf_dir):
    regions = [r[0] for r in table(spark, sf_dir, "region").select("r_name").collect()]
    return io.read_frames(_frame_docs(spark, sf_dir), [*regions, "open", "EXTRA"] if "EXTRA" not in regions else regions, "replace")[1]


def s11_read_media_index(spark, sf_dir):
    found = sq.media(spark, sf_dir).select("page_id", F.struct("id", F.concat("id", F.lit(".png")).alias("filename"), "heading", "terms").alias("i"))
    docs = found.groupBy(F.col("page_id").alias("doc")).agg(F.to_json(F.struct(F.collect_list("i").alias("images"))).alias("json"))
    return io.read_media_index(docs).select("doc", "id", "filename", "source", "heading", F.size("terms").alias("n_terms"))


def s12_read_config(spark, sf_dir):
    """One commented configuration per market segment, written and read as files."""
    rows = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    path = io.scratch(spark, "config")
    body = F.concat(F.lit("{ // limits\n \"name\": \""), "c_mktsegment", F.lit(" // kept\", /* a\n b */ \"limit\": "), "n", F.lit("}"))
    rows.select("c_mktsegment", body.alias("value")).write.partitionBy("c_mktsegment").text(path)
    return io.read_config(spark, path, "name string, limit long, missing string").where("name IS NOT NULL").select("name", "limit", F.coalesce("missing", F.lit("default")).alias("missing"))


def s13_map_harvest_records(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").select(
        F.expr("CASE WHEN doc_id % 3 = 0 THEN 'P' || doc_id END").alias("paperId"), F.expr("CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE ' T' || doc_id || ' ' END").alias("title"), F.lit(2020).alias("year"), F.col("lang").alias("abstract"),
        F.expr("array(named_struct('name', source), named_struct('name', ' '), named_struct('name', CAST(NULL AS STRING)))").alias("authors"), F.expr("CASE WHEN doc_id % 2 = 0 THEN n_chars END").alias("citationCount"),
        F.expr("named_struct('DOI', CASE WHEN doc_id % 5 < 3 THEN '10.1/' || doc_id END)").alias("externalIds"), F.expr("CASE WHEN doc_id % 7 = 0 THEN 'http://x/' || doc_id ELSE '' END").alias("url"),
    )
    return io.map_harvest_records(raw, "Venue").select("id", "title", F.array_join("authors", ";").alias("authors"), "venue", "doi", "url", "citations")


def s14_expand_venues(spark, sf_dir):
    """Orders of some years with the venues of their customer's nation."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    venues = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).where("n_nationkey % 2 = 0").select(F.col("r_name").alias("key"), F.col("n_name").alias("venue"))
    keys = table(spark, sf_dir, "orders").where(F.year("o_orderdate").between(1994, 1995)).select(F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'ASIA' WHEN 1 THEN 'EUROPE' ELSE o_orderpriority END").alias("key"))
    return io.expand_venues(keys, venues).groupBy("key", "venue").agg(F.count("*").alias("n"))


def s15_question_log(spark, sf_dir):
    stream = _read_stream(spark, sf_dir, "conversations").where("role = 'user'")
    path = io.scratch(spark, "log")
    records = stream.select(F.lit("2024-01-01T00:00:00Z").cast("timestamp").alias("timestamp"), F.col("conv_id").cast("string").alias("session_id"), F.lit("/ask").alias("endpoint"), F.col("text").alias("question"), F.lit(0).alias("image_count"))
    io.append_question_log(records, path, io.scratch(spark, "log-checkpoint")).awaitTermination()
    return spark.read.schema(io.LOG).json(path).groupBy("session_id").agg(F.count("*").alias("n"), F.sum(F.length("question")).alias("n_chars"))


QUERIES = {f.__name__: f for f in (
    c1_memory_summary, c2_shares_recent_topic, c3_carried_intent, c4_classify_turns, c5_topic_switches, c6_contextualize_query, c7_session_machine, c7_session_stream, c8_control_events, c9_answer_pipeline,
    s2_read_corpus, s3_write_corpus, s4_index_files, s5_read_inventory_flat, s6_flatten_inventory_tree, s6_tree_inventory, s14_in_years, s7_read_structured_items, s8_export_structured_items, s9_read_examples, s10_read_frames, s10_frame_coverage,
    s11_read_media_index, s12_read_config, s13_map_harvest_records, s14_expand_venues, s15_question_log,
)}

_HITS = ", ".join(f"CASE WHEN contains(lower(t), '{x}') THEN '{x}' END" for x in TERMS)
TURNS_SQL = f"""turns AS (SELECT conv_id, turn, t AS text, list_filter([{_HITS}], lambda x: x IS NOT NULL) AS terms, CASE WHEN contains(t, 'of') THEN 'evaluation' ELSE 'case' END AS intent FROM (SELECT conv_id, turn, text AS t FROM conversations WHERE role = 'user')),
topics AS (SELECT *, coalesce(list_has_any(terms, flatten(list(terms) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))), false) AS shares_topic,
  CASE WHEN lag(intent) OVER (PARTITION BY conv_id ORDER BY turn) = 'evaluation' AND regexp_matches(text, '(?i)\\bis\\b') THEN 'evaluation' END AS carried, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM turns),
base AS (SELECT *, CASE WHEN regexp_matches(text, '(?i)\\bthis\\b') THEN CASE WHEN len(terms) > 0 AND nth > 1 AND NOT shares_topic THEN 0.6 ELSE 0.95 END WHEN carried IS NOT NULL THEN 0.9 WHEN regexp_matches(text, '(?i)\\bwith\\b|\\bque\\b') AND shares_topic THEN 0.8 ELSE 0.5 END::DOUBLE AS c0,
  regexp_matches(text, '(?i)\\bthis\\b') OR carried IS NOT NULL OR (regexp_matches(text, '(?i)\\bwith\\b|\\bque\\b') AND shares_topic) AS f0 FROM topics),
classified AS (SELECT *, CASE WHEN c0 < 0.65 AND conv_id % 5 = 0 THEN 0.7 ELSE c0 END::DOUBLE AS confidence, CASE WHEN f0 OR (c0 < 0.65 AND conv_id % 5 = 0) THEN 'follow_up' ELSE 'new_topic' END AS relation FROM base)"""
_MEM = lambda n: f"coalesce(array_to_string(list_transform(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), lambda t, i: i || '. ' || t), chr(10)), '')"

ORACLES = {
    "c1_memory_summary": f"WITH {TURNS_SQL} SELECT conv_id, turn, md5({_MEM(4)}) AS digest FROM turns",
    "c2_shares_recent_topic": f"WITH {TURNS_SQL} SELECT conv_id, turn, shares_topic FROM topics",
    "c3_carried_intent": f"WITH {TURNS_SQL} SELECT conv_id, turn, carried FROM topics",
    "c4_classify_turns": f"WITH {TURNS_SQL} SELECT conv_id, turn, relation, confidence FROM classified",
    "c6_contextualize_query": f"WITH {TURNS_SQL}, m AS (SELECT *, {_MEM(4)} AS m4, {_MEM(2)} AS m2, {_MEM(1)} AS m1 FROM classified) SELECT conv_id, turn, md5(CASE WHEN relation = 'follow_up' AND m4 <> '' THEN text || chr(10) || 'Earlier questions:' || chr(10) || CASE WHEN confidence >= 0.9 THEN m4 WHEN confidence >= 0.65 THEN m2 ELSE m1 END ELSE text END) AS digest FROM m",
    "s2_read_corpus": "WITH papers AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'p' || (doc_id % 500) WHEN doc_id % 3 = 1 THEN '10.1/' || (doc_id % 400) ELSE lower(trim(left(text, 80), ' ')) END AS key, doc_id AS ord FROM documents) SELECT key, min(ord) AS ord, CASE WHEN min(ord) % 2 = 0 THEN 1 ELSE 0 END AS authors, 0 AS citations FROM papers GROUP BY key",
    "s3_write_corpus": "SELECT count(*) AS n, sum(doc_id)::BIGINT AS total FROM documents",
    "s4_index_files": "SELECT 'm1' AS model, count(*) AS n, max(len(embedding)) AS dim FROM embeddings",
    "s5_read_inventory_flat": """WITH r AS (SELECT s_nationkey AS doc, n_name, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name)::INT - 1 AS ord FROM supplier JOIN nation ON s_nationkey = n_nationkey), n AS (SELECT DISTINCT doc, n_name FROM r)
        SELECT doc, 'by_layer' AS kind, 'layer1' AS bucket, ord, s_name AS term FROM r UNION ALL SELECT doc, 'by_type', n_name, ord, s_name FROM r UNION ALL SELECT doc, 'by_layer', 'layer2', 0, n_name FROM n UNION ALL SELECT doc, 'structural', '', 0, n_name FROM n UNION ALL SELECT doc, 'alias', n_name, 0, 'x' FROM n""",
    "s14_in_years": "SELECT o_orderstatus, count(*) AS n, '1994-1996' AS years FROM orders WHERE year(o_orderdate) BETWEEN 1994 AND 1996 GROUP BY 1",
    "s6_tree_inventory": """WITH n AS (SELECT *, n_nationkey IN (SELECT s_nationkey FROM supplier) AS inner_node, CASE WHEN n_nationkey % 4 = 0 THEN 'own' ELSE 'place' END AS layer FROM nation JOIN region ON r_regionkey = n_regionkey)
        SELECT DISTINCT 'by_layer' AS kind, layer AS bucket, s_name AS term FROM supplier JOIN n ON n_nationkey = s_nationkey UNION SELECT 'by_layer', layer, n_name FROM n WHERE NOT inner_node
        UNION SELECT 'by_layer', 'place', r_name FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation)
        UNION SELECT 'by_type', CASE WHEN s_suppkey % 3 = 0 THEN 'third' ELSE 'root' END, s_name FROM supplier JOIN n ON n_nationkey = s_nationkey UNION SELECT 'by_type', 'root', n_name FROM n WHERE NOT inner_node
        UNION SELECT 'by_type', 'root', r_name FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation)
        UNION SELECT 'subgroup', 'root', n_name FROM n WHERE inner_node UNION SELECT 'alias', lower(n_name), CASE WHEN n_nationkey % 5 = 0 THEN 'N' || n_nationkey ELSE n_name END FROM nation""",
    "s6_flatten_inventory_tree": """SELECT 'r' || r_regionkey AS id, r_name AS label, r_name AS layer, NULL AS type, 0 AS depth, false AS is_leaf FROM region
        UNION ALL SELECT 'n' || n_nationkey, n_name, CASE WHEN n_nationkey % 4 = 0 THEN 'own' ELSE r_name END, n_name, 1, n_nationkey NOT IN (SELECT s_nationkey FROM supplier) FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT 's' || s_suppkey, s_name, CASE WHEN n_nationkey % 4 = 0 THEN 'own' ELSE r_name END, n_name, 2, true FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "s9_read_examples": "SELECT conv_id AS doc, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT - 1 AS pos, role || turn AS question, role AS intent FROM conversations WHERE conv_id % 9 <> 5 QUALIFY turn % 4 <> 0 AND conv_id % 3 <> 0 AND role IN ('user', 'assistant')",
    "s10_read_frames": "SELECT n_nationkey % 3 AS doc, r_name AS intent, row_number() OVER (PARTITION BY n_nationkey % 3, r_name ORDER BY n_name)::INT - 1 AS ord, n_name AS section FROM nation JOIN region ON n_regionkey = r_regionkey",
    "s10_frame_coverage": "WITH d AS (SELECT DISTINCT n_nationkey % 3 AS doc FROM nation), i AS (SELECT r_name AS intent FROM region UNION ALL SELECT 'EXTRA') SELECT doc, intent FROM d, i WHERE (doc, intent) NOT IN (SELECT (n_nationkey % 3, r_name) FROM nation JOIN region ON n_regionkey = r_regionkey)",
    "s11_read_media_index": f"WITH {sq.MEDIA_SQL} SELECT page_id AS doc, id, id || '.png' AS filename, '' AS source, coalesce(heading, '') AS heading, len(list_distinct(regexp_extract_all(lower(caption), '{sq._VOC}')))::INT AS n_terms FROM media",
    "s12_read_config": "SELECT c_mktsegment || ' // kept' AS name, count(*) AS \"limit\", 'default' AS missing FROM customer GROUP BY c_mktsegment",
    "s13_map_harvest_records": """SELECT CASE WHEN doc_id % 3 = 0 THEN 'P' || doc_id WHEN doc_id % 5 < 3 THEN '10.1/' || doc_id ELSE 't' || doc_id END AS id, 'T' || doc_id AS title, source AS authors, 'Venue' AS venue, CASE WHEN doc_id % 5 < 3 THEN '10.1/' || doc_id ELSE '' END AS doi,
        CASE WHEN doc_id % 7 = 0 THEN 'http://x/' || doc_id WHEN doc_id % 5 < 3 THEN 'https://doi.org/10.1/' || doc_id ELSE '' END AS url, CASE WHEN doc_id % 2 = 0 THEN n_chars ELSE 0 END AS citations FROM documents WHERE doc_id % 11 <> 0""",
    "s14_expand_venues": """WITH k AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'ASIA' WHEN 1 THEN 'EUROPE' ELSE o_orderpriority END AS key FROM orders WHERE year(o_orderdate) BETWEEN 1994 AND 1995), v AS (SELECT r_name AS key, n_name AS venue FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0)
        SELECT k.key, coalesce(v.venue, k.key) AS venue, count(*) AS n FROM k LEFT JOIN v ON v.key = k.key GROUP BY 1, 2""",
    "s15_question_log": "SELECT conv_id::VARCHAR AS session_id, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM conversations WHERE role = 'user' GROUP BY conv_id",
}

ORACLES["s7_read_structured_items"] = f"""WITH {iq.ITEMS_SQL} SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY ord) - 1)::INT AS pos, 'structured:' || term AS id, term, layer AS term_type, layer FROM (SELECT *, ord // 100000 % 20 AS doc FROM items)"""
