"""Queries of question enrichment, with a Latin rule set for the test data."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import questions as Q
from quillspark.plans import inventory_queries as iq
from quillspark.plans import retrieval_queries as rq
from quillspark.plans.fixtures import sql_compact, sql_strip_heading, table
from quillspark.sources.scratch import small, written

ALIASES = [("of the", "ofthe"), ("and", "und"), ("de la", "dela"), ("un", "eins")]
RULES = [
    Q.IntentRule("compare", 0.88, "two things", ["(?i)the", "(?i)and"]),
    Q.IntentRule("compare", 0.7, "a relation", ["(?i)with"]),
    Q.IntentRule("case", 0.82, "an example", ["(?i)this"], ["(?i)that"]),
    Q.IntentRule("case", 0.82, "second reason", ["(?i)is"], ["(?i)that"]),
    Q.IntentRule("evaluation", 0.91, "a design", ["(?i)que"]),
    Q.IntentRule("property", 0.6, "a word", ["(?i)der"], image=False),
    Q.IntentRule("form", 0.75, "an image", [], image=True),
]
INTENT_LAYERS = {"compare": "mechanism", "case": "form", "evaluation": "property", "property": "property"}
FOCUS = [("definition", ["is ", "est "]), ("relation", ["with", "avec"]), ("example", ["this", "esta"])]
VOCABULARIES = {"controls": ["the", "and", "der"], "mechanisms": ["que", "para", "with"], "properties": ["tion", "ing", "ment"]}
VALID = ["compare", "case", "evaluation", "property", "form", "open"]


def asked(spark, sf_dir):
    """User turns: qid, text, images."""
    return table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("qid"), "text", F.when(F.col("conv_id") % 7 == 0, 1).otherwise(0).alias("images"))


def aliases(spark):
    return spark.createDataFrame(ALIASES, "alias string, canonical string")


def q1_rewrite_aliases(spark, sf_dir):
    return Q.rewrite_aliases(asked(spark, sf_dir), aliases(spark)).select("qid", F.md5("text").alias("digest"))


def found(spark, sf_dir, terms=None):
    return Q.find_terms(asked(spark, sf_dir), iq.inventory(spark, sf_dir) if terms is None else terms, aliases(spark))


def q2_find_terms(spark, sf_dir):
    return found(spark, sf_dir).select("qid", "term", "ord")


def q3_expand_query(spark, sf_dir):
    base = iq.base(spark, sf_dir)
    return Q.expand_query(asked(spark, sf_dir), found(spark, sf_dir, base[1]), iq.items(spark, sf_dir, base)).select("qid", F.length("text").alias("n"), F.md5("text").alias("digest"))


def scored(spark, sf_dir):
    return Q.score_intents(asked(spark, sf_dir), RULES)


def q4_score_intents(spark, sf_dir):
    return scored(spark, sf_dir)


def examples(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("eid"), "text", F.element_at(F.array(*map(F.lit, VALID)), (F.col("item_id") % 6 + 1).cast("int")).alias("intent"))


def _near(spark, sf_dir):
    """User turns, and the labelled examples themselves, some of them with a word more."""
    near = examples(spark, sf_dir).select(F.col("eid").alias("qid"), F.when(F.col("eid") % 3 > 0, F.concat("text", F.lit(" more"))).otherwise(F.col("text")).alias("text"))
    return asked(spark, sf_dir).select((F.col("qid") + 1000).alias("qid"), "text").unionByName(near)


def q5_score_by_examples(spark, sf_dir):
    return Q.score_by_examples(Q.example_similarity(_near(spark, sf_dir), examples(spark, sf_dir), Q.LIKE_QUESTION), examples(spark, sf_dir))


def q6_relevant_examples(spark, sf_dir):
    return Q.nearest_examples(_near(spark, sf_dir), examples(spark, sf_dir)).select("qid", "eid", "rank", F.bround("similarity", 6).alias("similarity"))


def _hits(spark, sf_dir, k=8, base=None, turns=None):
    """Hits with their layers, from sections that are made once."""
    base = iq.base(spark, sf_dir) if base is None else base
    return small(written(rq.search(spark, sf_dir, k, asked=turns, base=base), "hits")).join(base[0].select("id", "layer"), "id")


def q7_score_by_retrieval(spark, sf_dir):
    intents = spark.createDataFrame([(v, k) for k, v in INTENT_LAYERS.items() if k != "property"], "layer string, intent string")
    return Q.score_by_retrieval(_hits(spark, sf_dir), intents)


def q8_mechanism_gate(spark, sf_dir):
    base = iq.base(spark, sf_dir)
    return Q.mechanism_gate(rq.preferred(spark, sf_dir, base[1]), base[1].where("bucket IN ('mechanism', 'form')"), _hits(spark, sf_dir, base=base))


def candidates(spark, sf_dir):
    order = F.create_map(*[F.lit(x) for i, v in enumerate(VALID) for x in (v, i)])
    return scored(spark, sf_dir).withColumn("ord", order[F.col("intent")])


def resolved(spark, sf_dir):
    short = asked(spark, sf_dir).where("length(text) < 150").select("qid", F.lit("case").alias("intent"), F.lit(1).alias("missing"))
    return Q.resolve_intent(asked(spark, sf_dir), candidates(spark, sf_dir), short)


def q9_resolve_intent(spark, sf_dir):
    return resolved(spark, sf_dir)


def q10_ambiguous_options(spark, sf_dir):
    labels = spark.createDataFrame([(v, v.upper()) for v in VALID[:3]], "intent string, label string")
    return Q.ambiguous_options(asked(spark, sf_dir), candidates(spark, sf_dir), labels).select("qid", "ord", "label", F.md5("value").alias("digest"))


def q11_detect_layers(spark, sf_dir):
    rows = rq.questions(spark, sf_dir).withColumn("intent", F.element_at(F.array(*map(F.lit, VALID)), (F.col("qid") % 6 + 1).cast("int")))
    layers = Q.detect_layers(rows, _hits(spark, sf_dir), INTENT_LAYERS, [("(?i)tion", "property"), ("(?i)ment", "form")])
    return layers.select("qid", F.array_join("layers", ",").alias("layers"))


def q12_detect_focus(spark, sf_dir):
    return asked(spark, sf_dir).select("qid", F.array_join(Q.detect_focus(F.col("text"), FOCUS, ["definition", "relation", "limits"]), ",").alias("focus"))


def q13_compare_targets(spark, sf_dir):
    terms = F.when(F.col("qid") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("c")))
    return asked(spark, sf_dir).select("qid", F.array_join(Q.compare_targets(F.col("text"), terms, [" and ", ", "]), "|").alias("targets"))


def q14_blocking_missing(spark, sf_dir):
    rows = asked(spark, sf_dir).join(resolved(spark, sf_dir).select("qid", "intent"), "qid")
    missing = Q.blocking_missing(F.col("intent"), F.col("text"), F.col("images"), F.col("qid") % 4, F.length("text") < 200)
    return rows.select("qid", F.array_join(missing, ",").alias("missing"))


def _facets(spark, sf_dir):
    rows = asked(spark, sf_dir).withColumn("terms", F.when(F.col("qid") % 3 == 0, F.array(F.lit("with"), F.lit("zzz"))).otherwise(F.array().cast("array<string>")))
    return rows, Q.extract_facets(F.col("text"), VOCABULARIES, F.col("terms"), [r"(?i)the (\w+)", r"(?i)der (\w+)"], [r"(?i)to (\w+)", r"(?i)para (\w+)"], F.col("images"))


def q15_extract_facets(spark, sf_dir):
    rows, facets = _facets(spark, sf_dir)
    return rows.select("qid", *[(c if n in ("context", "goal") else F.array_join(c, ",")).alias(n) for n, c in facets.items()])


def q16_missing_and_risks(spark, sf_dir):
    rows, facets = _facets(spark, sf_dir)
    missing, risks = Q.missing_and_risks(facets, F.col("text"), [("the", "and", "both"), ("que", "de", "pair")], 300)
    return rows.select("qid", F.array_join(missing, ",").alias("missing"), F.array_join(risks, ",").alias("risks"))


def q17_clarify_subtype(spark, sf_dir):
    rows = asked(spark, sf_dir).join(resolved(spark, sf_dir).select("qid", "intent"), "qid")
    options = spark.createDataFrame([("compare", 1, "first", ["with", "from"]), ("compare", 2, "second", ["this"]), ("evaluation", 1, "only", ["para"])], "intent string, ord int, value string, keywords array<string>")
    return Q.clarify_subtype(rows, options)


def q18_parse_questions(spark, sf_dir):
    """The whole structure of each question, a column for each part."""
    rows = written(asked(spark, sf_dir), "asked")
    turns = rows.select("qid", "text")
    done = written(resolved(spark, sf_dir), "resolved")
    own = _facets(spark, sf_dir)[1]
    lists = {n: c for n, c in own.items() if n != "modality"}
    missing, risks = Q.missing_and_risks(own, F.col("text"), [("the", "and", "both"), ("que", "de", "pair")], 300)
    base = iq.base(spark, sf_dir)
    hits = _hits(spark, sf_dir, base=base, turns=turns)
    layers = Q.detect_layers(turns.join(done.select("qid", "intent"), "qid"), hits, INTENT_LAYERS, [("(?i)tion", "property"), ("(?i)ment", "form")])
    frame = q20_select_frame(spark, sf_dir).select("qid", F.split("frame", ",").alias("frame"), "source")
    originals = aliases(spark).withColumnRenamed("alias", "original")
    fixed = turns.join(F.broadcast(originals), F.contains(F.lower("text"), F.col("original"))).select("qid", "original", "canonical")
    blocking = Q.blocking_missing(F.col("intent"), F.col("text"), F.col("images"), F.size("terms"), F.size("design_missing") > 0)
    with_terms = rows.withColumn("terms", F.when(F.col("qid") % 3 == 0, F.array(F.lit("with"), F.lit("zzz"))).otherwise(F.array().cast("array<string>")))
    made = Q.parse_questions(with_terms, done, found(spark, sf_dir, base[1]), FOCUS, ["definition", "relation", "limits"], [" and ", ", "], layers=layers, frames=frame, corrections=fixed, design=Q.Design("evaluation", lists, missing, risks), missing=blocking)
    s = made.select("qid", "structure.*")
    joined = lambda c: F.array_join(c, ",")
    design = F.concat_ws(";", *[(c if n in ("context", "goal") else joined(c)) for n, c in ((n, F.col(f"design_evaluation.{n}")) for n in (*lists, "missing", "risks"))])
    return s.select(
        "qid", F.md5("raw_query").alias("raw_query"), "intent", "confidence", "needs_clarification", joined("layers").alias("layers"), F.md5(joined("terms")).alias("terms"), joined("focus").alias("focus"), F.array_join("compare_targets", "|").alias("targets"),
        joined("case_modality").alias("modality"), joined("missing_info").alias("missing"), joined(F.transform("term_corrections", lambda x: F.concat_ws(">", x["original"], x["canonical"]))).alias("corrections"),
        joined("output_frame").alias("frame"), F.col("output_frame_source").alias("frame_source"), F.when(F.col("design_evaluation").isNotNull(), design).alias("design"),
    )


def q10_clarification_question(spark, sf_dir):
    """What to ask back; conversations with an even number have been asked twice before."""
    labels = spark.createDataFrame([("compare", "COMPARE"), ("case", "CASE")], "intent string, label string")
    rows = asked(spark, sf_dir).select("qid", (F.length("text") < 200).alias("missing"), F.when(F.floor(F.col("qid") / 100) % 2 == 0, 2).otherwise(0).alias("asked"))
    candidates = scored(spark, sf_dir).withColumn("ord", F.array_position(F.array(*map(F.lit, VALID)), F.col("intent")))
    return Q.clarification_question(rows, candidates, labels, {"compare": "Compare what?", "evaluation": "Which design?"}, "What is it about?", "It may mean: {options}. Which?", "(again) ")


def q19_resolve_external(spark, sf_dir):
    external = asked(spark, sf_dir).select("qid", F.element_at(F.array(*map(F.lit, [*VALID, "bogus"])), (F.col("qid") % 7 + 1).cast("int")).alias("intent"), F.expr("CASE WHEN qid % 3 = 0 THEN '1.7' WHEN qid % 3 = 1 THEN 'x' ELSE '0.5' END").alias("score"), F.expr("CASE qid % 5 WHEN 0 THEN ' Yes' WHEN 1 THEN 'no' WHEN 2 THEN '' END").alias("needs"))
    return Q.resolve_external(external, VALID)


def q19_merge_candidates(spark, sf_dir):
    external = asked(spark, sf_dir).where("qid % 2 = 0").select("qid", F.element_at(F.array(*map(F.lit, [*VALID, "bogus"])), (F.col("qid") % 7 + 1).cast("int")).alias("intent"), F.expr("CASE WHEN qid % 3 = 0 THEN '1.7' WHEN qid % 3 = 1 THEN 'x' ELSE '0.5' END").alias("score"))
    return Q.merge_candidates(scored(spark, sf_dir), external, VALID)


def q20_select_frame(spark, sf_dir):
    rows = resolved(spark, sf_dir).withColumn("intent", F.coalesce("intent", F.lit("open")))
    static = spark.createDataFrame([("compare", ["a", "b"]), ("case", ["c"])], "intent string, sections array<string>")
    proposed = rows.where("qid % 3 > 0").select("qid", F.expr("transform(sequence(1, cast(qid % 10 as int) + 1), i -> 's' || i)").alias("items"))
    return Q.select_frame(rows, static, proposed).select("qid", F.array_join("frame", ",").alias("frame"), "source")


QUERIES = {f.__name__: f for f in (
    q1_rewrite_aliases, q2_find_terms, q3_expand_query, q4_score_intents, q5_score_by_examples, q6_relevant_examples, q7_score_by_retrieval, q8_mechanism_gate, q9_resolve_intent, q10_ambiguous_options, q10_clarification_question, q19_resolve_external,
    q11_detect_layers, q12_detect_focus, q13_compare_targets, q14_blocking_missing, q15_extract_facets, q16_missing_and_risks, q17_clarify_subtype, q18_parse_questions, q19_merge_candidates, q20_select_frame,
)}

ASKED_SQL = "asked AS (SELECT conv_id * 100 + turn AS qid, text, CASE WHEN conv_id % 7 = 0 THEN 1 ELSE 0 END AS images FROM conversations WHERE role = 'user')"
_REWRITTEN = "text"
for _a, _c in sorted(ALIASES, key=lambda a: (-len(a[0]), a[0])):
    _REWRITTEN = f"regexp_replace({_REWRITTEN}, '(?i){_a}', '{_c}', 'g')"
_REWRITTEN = sql_compact(_REWRITTEN)
_RULE = []
for _i, _r in enumerate(RULES):
    _ok = " AND ".join([f"regexp_matches(text, '{p}')" for p in _r.every] + [f"NOT regexp_matches(text, '{p}')" for p in _r.none] + ([] if _r.image is None else [f"images {'>' if _r.image else '='} 0"]))
    _RULE.append(f"SELECT qid, '{_r.intent}' AS intent, {_r.score}::DOUBLE AS score, {_i} AS nth, '{_r.reason}' AS reason FROM asked WHERE {_ok}")
SCORED_SQL = f"""{ASKED_SQL}, hit AS ({' UNION ALL '.join(_RULE)}), scored AS (SELECT qid, intent, score, reason FROM hit QUALIFY row_number() OVER (PARTITION BY qid, intent ORDER BY score DESC, nth) = 1),
cand AS (SELECT *, list_position({VALID}, intent) AS ord FROM scored), ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord) AS n FROM cand QUALIFY n <= 4),
tops AS (SELECT qid, max(CASE WHEN n = 1 THEN intent END) AS intent, max(score) AS confidence, max(CASE WHEN n = 2 THEN score END) AS second, count(*) AS n_candidates FROM ranked GROUP BY qid),
resolved AS (SELECT a.qid, a.text, a.images, t.intent, coalesce(confidence, 0) AS confidence, coalesce(n_candidates, 0) AS n_candidates,
  t.intent IS NULL OR confidence < 0.65 OR coalesce(confidence < 0.9 AND confidence - second < 0.15 - 1e-12, false) OR (t.intent = 'case' AND length(a.text) < 150) AS needs_clarification FROM asked a LEFT JOIN tops t ON t.qid = a.qid)"""
_SEARCH8 = rq.SEARCH_SQL.replace("rank <= 6", "rank <= 8")
_LOW = lambda w: f"contains(lower(text), '{w}')"


def _facet_sql(name: str) -> str:
    words = ", ".join(f"CASE WHEN {_LOW(w)}{' OR qid % 3 = 0' if w == 'with' else ''} THEN '{w}' END" for w in VOCABULARIES[name])
    return f"array_to_string(list_filter([{words}], lambda x: x IS NOT NULL), ',')"


_FACET_ROWS = f"""f AS (SELECT qid, text, {', '.join(f'{_facet_sql(n)} AS {n}' for n in VOCABULARIES)}, CASE WHEN images > 0 THEN 'image,text' ELSE 'text' END AS modality,
  coalesce(nullif(regexp_extract(text, '(?i)the (\\w+)', 1), ''), nullif(regexp_extract(text, '(?i)der (\\w+)', 1), ''), '') AS context, coalesce(nullif(regexp_extract(text, '(?i)to (\\w+)', 1), ''), nullif(regexp_extract(text, '(?i)para (\\w+)', 1), ''), '') AS goal FROM asked)"""
_JOIN = lambda xs: f"array_to_string(list_filter([{', '.join(xs)}], lambda x: x IS NOT NULL), ',')"

ORACLES = {
    "q1_rewrite_aliases": f"WITH {ASKED_SQL} SELECT qid, md5({_REWRITTEN}) AS digest FROM asked",
    "q2_find_terms": f"""WITH {iq.INVENTORY_SQL}, {ASKED_SQL}, r AS (SELECT qid, lower({_REWRITTEN}) AS t FROM asked), al AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{c}', {i})" for i, (a, c) in enumerate(sorted(ALIASES, key=lambda x: (-len(x[0]), x[0]))))}) v(term, canonical, n)),
        ev AS (SELECT term, canonical, 0 AS src, n, term AS t2 FROM al UNION ALL SELECT i.term, coalesce(al.canonical, i.term), 1, -length(i.term), i.term FROM (SELECT DISTINCT term FROM inv) i LEFT JOIN al ON al.term = i.term),
        h AS (SELECT qid, canonical, min((src, n, t2)) AS a FROM r JOIN ev ON contains(r.t, lower(ev.term)) GROUP BY 1, 2) SELECT qid, canonical AS term, row_number() OVER (PARTITION BY qid ORDER BY a, canonical)::INT AS ord FROM h""",
    "q4_score_intents": f"WITH {SCORED_SQL} SELECT qid, intent, score, reason FROM scored",
    "q7_score_by_retrieval": f"WITH {_SEARCH8} SELECT DISTINCT qid, CASE layer WHEN 'mechanism' THEN 'compare' WHEN 'form' THEN 'case' ELSE 'evaluation' END AS intent, 0.74::DOUBLE AS score FROM hits WHERE rank <= 5 AND score >= 3 AND layer <> 'unknown'",
    "q8_mechanism_gate": f"WITH {_SEARCH8} SELECT DISTINCT qid FROM hits WHERE rank <= 3 AND score >= 3 AND layer = 'mechanism' AND qid IN (SELECT qid FROM prefer WHERE term IN (SELECT term FROM inv WHERE bucket IN ('mechanism', 'form')))",
    "q9_resolve_intent": f"WITH {SCORED_SQL} SELECT qid, intent, confidence, n_candidates, needs_clarification FROM resolved",
    "q10_ambiguous_options": f"WITH {SCORED_SQL} SELECT r.qid, r.n::INT AS ord, CASE WHEN r.intent IN ('compare', 'case', 'evaluation') THEN upper(r.intent) ELSE r.intent END AS label, md5('[intent:' || r.intent || ']' || a.text) AS digest FROM ranked r JOIN tops t USING (qid) JOIN asked a USING (qid) WHERE confidence < 0.9 AND confidence - second < 0.15 - 1e-12 AND second >= 0.5",
    "q10_clarification_question": f"""WITH {SCORED_SQL}, o AS (SELECT qid, arg_min(intent, n) AS top, string_agg(CASE WHEN intent IN ('compare', 'case') THEN upper(intent) ELSE intent END || '(' || reason || ')', ', ' ORDER BY n) AS options FROM ranked WHERE n <= 3 GROUP BY qid)
        SELECT a.qid, CASE WHEN (a.qid // 100) % 2 = 0 THEN '(again) ' ELSE '' END || CASE WHEN length(text) < 200 AND top = 'compare' THEN 'Compare what?' WHEN length(text) < 200 AND top = 'evaluation' THEN 'Which design?' WHEN options IS NOT NULL THEN 'It may mean: ' || options || '. Which?' ELSE 'What is it about?' END AS question FROM asked a LEFT JOIN o ON o.qid = a.qid""",
    "q19_resolve_external": f"""WITH {ASKED_SQL}, x AS (SELECT qid, CASE WHEN qid % 7 < 6 THEN {VALID}[qid % 7 + 1] END AS intent, CASE qid % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE 0.5 END::DOUBLE AS confidence, qid % 5 AS f FROM asked)
        SELECT qid, intent, confidence, intent IS NULL OR CASE f WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false ELSE confidence < 0.65 END AS needs_clarification FROM x""",
    "q11_detect_layers": f"""WITH {_SEARCH8}, l AS (SELECT qid, list(layer ORDER BY rank) AS s FROM hits WHERE layer <> 'unknown' GROUP BY qid),
        a AS (SELECT q.qid, list_filter(list_concat(coalesce(s, []), [CASE {VALID}[q.qid % 6 + 1] WHEN 'compare' THEN 'mechanism' WHEN 'case' THEN 'form' WHEN 'evaluation' THEN 'property' WHEN 'property' THEN 'property' END, CASE WHEN regexp_matches(text, '(?i)tion') THEN 'property' END, CASE WHEN regexp_matches(text, '(?i)ment') THEN 'form' END]), lambda x: x IS NOT NULL) AS a FROM q LEFT JOIN l ON l.qid = q.qid)
        SELECT qid, CASE WHEN len(a) = 0 THEN 'unknown' ELSE array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ',') END AS layers FROM a""",
    "q12_detect_focus": f"WITH {ASKED_SQL} SELECT qid, coalesce(nullif({_JOIN(['CASE WHEN ' + ' OR '.join(f'contains(text, {k!r})' for k in ks) + f' THEN {n!r} END' for n, ks in FOCUS])}, ''), 'definition,relation,limits') AS focus FROM asked",
    "q13_compare_targets": f"""WITH {ASKED_SQL}, p AS (SELECT qid, text, list_concat(CASE WHEN contains(text, ' and ') THEN string_split(text, ' and ') ELSE [] END, CASE WHEN contains(text, ', ') THEN string_split(text, ', ') ELSE [] END) AS p FROM asked),
        s AS (SELECT qid, list_filter(list_transform(p, lambda x: regexp_replace(x, '^[ ?？。.]+|[ ?？。.]+$', '', 'g')), lambda x: length(x) BETWEEN 2 AND 16) AS s FROM p)
        SELECT qid, CASE WHEN qid % 2 = 0 THEN 'a|b' ELSE array_to_string(list_concat(s, CASE WHEN list_contains(s, 'c') THEN [] ELSE ['c'] END)[1:4], '|') END AS targets FROM s""",
    "q14_blocking_missing": f"WITH {SCORED_SQL} SELECT qid, CASE WHEN intent = 'case' AND images = 0 AND length(text) < 30 THEN 'short case' WHEN intent = 'compare' AND qid % 4 < 2 THEN 'two targets' WHEN intent = 'evaluation' AND length(text) < 200 THEN 'design facets' ELSE '' END AS missing FROM resolved",
    "q15_extract_facets": f"WITH {ASKED_SQL}, {_FACET_ROWS} SELECT * EXCLUDE (text) FROM f",
    "q16_missing_and_risks": f"""WITH {ASKED_SQL}, {_FACET_ROWS}, m AS (SELECT qid, text, {_JOIN(["CASE WHEN length(text) < 300 THEN 'short description' END", "CASE WHEN context = '' THEN 'no context' END", "CASE WHEN goal = '' THEN 'no goal' END", *[f"CASE WHEN {n} = '' THEN 'no {n}' END" for n in VOCABULARIES]])} AS missing FROM f)
        SELECT qid, missing, {_JOIN(["CASE WHEN contains(text, 'the') AND contains(text, 'and') THEN 'both' END", "CASE WHEN contains(text, 'que') AND contains(text, 'de') THEN 'pair' END", "CASE WHEN missing <> '' THEN 'incomplete' END"])} AS risks FROM m""",
    "q17_clarify_subtype": f"""WITH {SCORED_SQL}, s AS (SELECT qid, CASE WHEN intent = 'compare' THEN CASE WHEN {_LOW('with')} OR {_LOW('from')} THEN 'first' WHEN {_LOW('this')} THEN 'second' END ELSE CASE WHEN {_LOW('para')} THEN 'only' END END AS subtype FROM resolved WHERE intent IN ('compare', 'evaluation')) SELECT qid, subtype, subtype IS NULL AS ask FROM s""",
    "q19_merge_candidates": f"""WITH {SCORED_SQL}, x AS (SELECT qid, {[*VALID, 'bogus']}[qid % 7 + 1] AS intent, CASE qid % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE 0.5 END::DOUBLE AS score FROM asked WHERE qid % 2 = 0), u AS (SELECT qid, intent, score, 0 AS src FROM x WHERE intent <> 'bogus' UNION ALL SELECT qid, intent, score, 1 FROM scored),
        b AS (SELECT qid, intent, max(score) AS score, min(src) AS src FROM u GROUP BY 1, 2) SELECT qid, intent, score, row_number() OVER (PARTITION BY qid ORDER BY src, score DESC, intent)::INT AS rank FROM b QUALIFY rank <= 5""",
    "q20_select_frame": f"""WITH {SCORED_SQL}, r AS (SELECT qid, coalesce(intent, 'open') AS intent, confidence, CASE WHEN qid % 3 > 0 AND qid % 10 + 1 BETWEEN 3 AND 8 THEN qid % 10 + 1 END AS k FROM resolved), u AS (SELECT *, k IS NOT NULL AND (intent = 'open' OR confidence < 0.8) AS use FROM r)
        SELECT qid, CASE WHEN use THEN array_to_string(list_transform(range(1, k + 1), lambda i: 's' || i), ',') WHEN intent = 'open' THEN 'summary,evidence,limits,next steps' WHEN intent = 'compare' THEN 'a,b' WHEN intent = 'case' THEN 'c' ELSE '' END AS frame, CASE WHEN use OR intent = 'open' THEN 'cot' ELSE 'static' END AS source FROM u""",
}

_SEARCH_ASKED = _SEARCH8.replace("item_id AS qid", "conv_id * 100 + turn AS qid").replace("FROM benchmark)", "FROM conversations WHERE role = 'user')")
ORACLES["q18_parse_questions"] = f"""WITH r AS ({ORACLES["q9_resolve_intent"]}), a AS (SELECT conv_id * 100 + turn AS qid, text, CASE WHEN conv_id % 7 = 0 THEN 1 ELSE 0 END AS images FROM conversations WHERE role = 'user'),
t AS (SELECT qid, list(term ORDER BY ord) AS terms FROM ({ORACLES["q2_find_terms"]}) GROUP BY qid), focus AS ({ORACLES["q12_detect_focus"]}), frame AS ({ORACLES["q20_select_frame"]}), facets AS ({ORACLES["q15_extract_facets"]}), gaps AS ({ORACLES["q16_missing_and_risks"]}),
h AS (WITH {_SEARCH_ASKED} SELECT qid, list(layer ORDER BY rank) AS s FROM hits WHERE layer <> 'unknown' GROUP BY qid),
p AS (SELECT qid, list_filter(list_transform(list_concat(CASE WHEN contains(text, ' and ') THEN string_split(text, ' and ') ELSE [] END, CASE WHEN contains(text, ', ') THEN string_split(text, ', ') ELSE [] END), lambda x: regexp_replace(x, '^[ ?？。.]+|[ ?？。.]+$', '', 'g')), lambda x: length(x) BETWEEN 2 AND 16) AS parts FROM a),
j AS (SELECT a.*, coalesce(r.intent, 'open') AS intent, confidence, needs_clarification, coalesce(terms, []) AS terms, parts, focus, frame, source, controls, mechanisms, properties, context, goal, gaps.missing AS gaps, risks,
  list_filter(list_concat(coalesce(s, []), [CASE r.intent WHEN 'compare' THEN 'mechanism' WHEN 'case' THEN 'form' WHEN 'evaluation' THEN 'property' WHEN 'property' THEN 'property' END, CASE WHEN regexp_matches(text, '(?i)tion') THEN 'property' END, CASE WHEN regexp_matches(text, '(?i)ment') THEN 'form' END]), lambda x: x IS NOT NULL) AS ls
  FROM a JOIN r USING (qid) LEFT JOIN t USING (qid) JOIN p USING (qid) JOIN focus USING (qid) JOIN frame USING (qid) JOIN facets USING (qid) JOIN gaps USING (qid) LEFT JOIN h USING (qid))
SELECT qid, md5(text) AS raw_query, intent, confidence, needs_clarification, CASE WHEN len(ls) = 0 THEN 'unknown' ELSE array_to_string(list_filter(ls, lambda x, i: list_position(ls, x) = i), ',') END AS layers, md5(array_to_string(terms, ',')) AS terms, focus,
  CASE WHEN intent <> 'compare' THEN '' WHEN len(terms) >= 2 THEN array_to_string(terms[1:4], '|') ELSE array_to_string(list_concat(parts, list_filter(terms, lambda x: NOT list_contains(parts, x)))[1:4], '|') END AS targets,
  CASE WHEN images > 0 AND trim(text, ' ') <> '' THEN 'image,text' WHEN images > 0 THEN 'image' ELSE 'text' END AS modality,
  CASE WHEN intent = 'evaluation' THEN gaps WHEN intent = 'case' AND images = 0 AND length(text) < 30 THEN 'short case' WHEN intent = 'compare' AND len(terms) < 2 THEN 'two targets' ELSE '' END AS missing,
  array_to_string(list_filter([{", ".join(f"CASE WHEN contains(lower(text), '{a}') THEN '{a}>{c}' END" for a, c in sorted(ALIASES))}], lambda x: x IS NOT NULL), ',') AS corrections,
  frame, source AS frame_source, CASE WHEN intent = 'evaluation' THEN concat_ws(';', controls, mechanisms, properties, context, goal, gaps, risks) END AS design FROM j"""

_LIST = lambda c: f"list_filter(string_split({c}, '|'), lambda x: x <> '')"
_RELATED = f"CASE WHEN {sql_strip_heading('i.title')} <> i.term THEN [{sql_strip_heading('i.title')}] ELSE [] END"
ORACLES["q3_expand_query"] = f"""WITH found AS ({ORACLES["q2_find_terms"]}), i AS MATERIALIZED (SELECT ord, term, layer, response, p, m, f, related FROM (WITH {iq.ITEMS_SQL} SELECT i.ord, i.term, i.layer, i.response, {_LIST('properties')} AS p, {_LIST('mechanisms')} AS m, {_LIST('forms')} AS f, {_RELATED} AS related FROM items i)), {ASKED_SQL},
own AS (SELECT qid, i.* FROM found JOIN i USING (term)), rel AS (SELECT DISTINCT qid, unnest(related) AS term FROM own), hop AS (SELECT rel.qid, i.* FROM rel JOIN i USING (term) WHERE NOT EXISTS (SELECT 1 FROM found WHERE found.qid = rel.qid AND found.term = rel.term)),
w AS (SELECT qid, 0 AS level, ord, list_concat([term, layer], p, m, f, related, CASE WHEN response <> '' THEN [response] ELSE [] END) AS words FROM own UNION ALL SELECT qid, 1, ord, list_concat([term], p, m) FROM hop),
x AS (SELECT qid, list_filter(flatten(list(words ORDER BY level, ord)), lambda v: v <> '') AS xs FROM w GROUP BY qid), y AS (SELECT a.qid, concat_ws(' ', text, array_to_string(list_filter(xs, lambda v, n: list_position(xs, v) = n), ' ')) AS text FROM asked a LEFT JOIN x ON x.qid = a.qid),
z AS (SELECT qid, {sql_compact('text')} AS text FROM y) SELECT qid, length(text)::INT AS n, md5(text) AS digest FROM z"""
