import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import corpus as D
from quillspark.operators import inventory as K
from quillspark.operators import retrieval as R
from quillspark.operators import sections as G
from quillspark.operators import verify as V


def test_sections_discard_preamble_and_keep_ranges(spark):
    docs = spark.createDataFrame([(1, "intro\n# A\nx\n\ny\n# B\nz"), (2, "no heading\nat all"), (3, "")], "doc_id long, text string")
    got = G.split_sections(G.mark_headings(G.read_lines(docs), [("", "^# ")])).orderBy("doc_id", "sec").collect()
    assert [(r.doc_id, r.title, r.start_line, r.end_line, r.text) for r in got] == [(1, "# A", 2, 5, "# A\nx\ny"), (1, "# B", 6, 7, "# B\nz"), (2, "2", 1, 2, "no heading\nat all")]


def test_sections_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, f"h{i}\na\nb\nh\nc") for i in range(40)], "doc_id long, text string")
    make = lambda d: sorted(map(tuple, G.split_sections(G.mark_headings(G.read_lines(d), [("", "^h")])).collect()))
    assert make(docs.repartition(1)) == make(docs.repartition(8))


def test_containment_both_ways_agree(spark):
    texts = spark.createDataFrame([(1, "The Quick brown fox"), (2, "quicksilver and foxglove plants"), (3, "")], "id int, text string")
    terms = spark.createDataFrame([("quick",), ("fox",), ("foxglove plants",), ("zzz",)], "term string")
    small = sorted(map(tuple, K.containment(texts, terms).collect()))
    large = sorted(map(tuple, K.containment(texts, terms, small_rows=0).collect()))
    assert small == large == [(1, "fox"), (1, "quick"), (2, "fox"), (2, "foxglove plants"), (2, "quick")]


def test_search_joins_are_equi_joins(spark):
    sections = spark.createDataFrame([("a", 1, "drag and drop", "move things", "mechanism"), ("b", 2, "buttons", "press things", "form")], "id string, ord long, title string, text string, layer string")
    questions = spark.createDataFrame([(1, "how to drag things")], "qid long, text string")
    found = R.hybrid_search(questions, sections, 2)
    assert [(r.id, r["rank"]) for r in found.orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    assert "CartesianProduct" not in found._jdf.queryExecution().toString()


def test_vector_top_k_in_blocks(spark, monkeypatch):
    index = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0])], "id int, embedding array<double>")
    queries = spark.createDataFrame([(i, [0.9, 0.1, 0.0]) for i in range(5)], "qid int, embedding array<double>")
    whole = sorted(map(tuple, R.vector_top_k(queries, index, 2).select("qid", "rank", "id").collect()))
    monkeypatch.setattr(R, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, R.vector_top_k(queries, index, 2).select("qid", "rank", "id").collect())) == whole
    assert [r[2] for r in whole[:2]] == [1, 2]


def test_dedupe_papers_shares_one_namespace(spark):
    rows = [("1", "First", "", 1), ("1", "First again", "", 2), ("", "Same", "10.1/x", 3), ("10.1/x", "Other", "", 4), ("", "Title only", "", 5), ("", " title ONLY ", None, 6)]
    got = D.dedupe_papers(spark.createDataFrame(rows, "id string, title string, doi string, ord int")).orderBy("ord").collect()
    assert [r.title for r in got] == ["First", "Same", "Title only"]


def test_index_follows_model_and_corpus(spark):
    corpus = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    index = spark.createDataFrame([("a", [1.0], "m"), ("z", [1.0], "m")], "id string, embedding array<double>, model string")
    assert {r.id for r in D.rows_to_embed(corpus, index, "m").collect()} == {"b", "c"}
    assert {r.id for r in D.rows_to_embed(corpus, index, "other").collect()} == {"a", "b", "c"}
    fresh = spark.createDataFrame([("b", [2.0]), ("c", [3.0])], "id string, embedding array<double>")
    assert {r.id for r in D.update_index(corpus, index, fresh, "m").collect()} == {"a", "b", "c"}


def test_typo_candidates_need_one_substitution(spark):
    segments = spark.createDataFrame([(1, "slide x"), (1, "cluck")], "qid int, segment string")
    terms = spark.createDataFrame([("slice",), ("click",), ("slide",)], "term string")
    found = spark.createDataFrame([], "qid int, term string")
    got = {(r.original, r.canonical) for r in V.typo_candidates(segments, terms, found, "e").collect()}
    assert got == {("cluck", "click")}


def test_rollup_numbers_skip_warnings(spark):
    issues = spark.createDataFrame([(1, 1, "warning", "a"), (1, 2, "error", "b"), (2, 1, "warning", "c")], "qid int, ord int, severity string, description string")
    got = {r.qid: (r.status, r.should_retry, r.hints) for r in V.rollup_issues(issues).collect()}
    assert got == {1: ("fail", True, "2. b"), 2: ("warn", False, "")}


def test_external_issues_in_free_text(spark):
    rows = spark.createDataFrame([(1, 'x {"issues":[{"original":"a"},{}]} y'), (2, "{bad"), (3, None)], "qid int, answer string")
    assert [(r.qid, r.issue_type, r.original, r.severity) for r in V.parse_external_issues(rows).collect()] == [(1, "other", "a", "warning")]


def test_media_without_heading_earns_each_title(spark):
    media = spark.createDataFrame([("m1", "", "a cat", ["cat"]), ("m2", "Dogs", None, ["dog"])], "id string, heading string, caption string, terms array<string>")
    asked = spark.createDataFrame([(1, ["dog"], ["dog"], ["about Dogs", "more"])], "qid int, terms array<string>, section_terms array<string>, titles array<string>")
    got = {r.id: r.score for r in R.media_search(asked, media).collect()}
    assert got == {"m2": 5.0 + 3.0 + 4.0, "m1": 8.0}
    # without its tag, dog is inside "Hot dogs" as written; dogs is only a token of "Dogs"
    media = spark.createDataFrame([("m1", "Hot dogs", None, []), ("m2", "Dogs", None, [])], "id string, heading string, caption string, terms array<string>")
    asked = spark.createDataFrame([(1, ["dogs"], [], [])], "qid int, terms array<string>, section_terms array<string>, titles array<string>")
    assert {r.id: r.score for r in R.media_search(asked, media).collect()} == {"m1": 3.0, "m2": 1.0}
    assert F.col("x") is not None


def test_excerpts_of_questions_that_share_a_number(spark):
    layers = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")] * 2, "qid long, pos int, bucket string")
    inventory = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", 1)], "bucket string, term string, ord int")
    matched = spark.createDataFrame([(1, "x", 1, ["m"])], "qid long, term string, ord int, mechanisms array<string>")
    assert [tuple(r) for r in V.verification_excerpts(layers, inventory, matched, 3).collect()] == [(1, "x, y, z", "x: m")]


def test_terms_in_text_are_cut_in_the_tasks(spark):
    sections = spark.createDataFrame([("a", "AB abc abcd x"), ("b", "abcd"), ("c", None), ("d", "zzz")], "id string, text string")
    inventory = spark.createDataFrame([("m", "ab", 3), ("m", "abc", 2), ("m", "abcd", 1), ("p", "x", 1), ("p", "ABC", 2), (None, "d", 1)], "bucket string, term string, ord int")
    want = {("a", "m", "abcd|abc"), ("a", "p", "x|ABC"), ("a", None, "d"), ("b", "m", "abcd|abc"), ("b", "p", "ABC"), ("b", None, "d")}
    for chars in (1000, 3):
        made = K.terms_in_text(sections, inventory, 2, chars)
        assert {(r.id, r.bucket, "|".join(r.terms)) for r in made.collect()} == want
    # no join stands behind the automaton, so no term of a text is shuffled by itself
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_section_titles_equal_those_of_the_sections(spark):
    docs = spark.createDataFrame([(1, "intro\n# A\nx\n\n# B\nz"), (2, "no heading\nat all"), (3, ""), (4, "# A"), (5, None)], "doc_id long, text string")
    marked = G.mark_headings(G.read_lines(docs), [("", "^# ")])
    want = {(r.sec > 0, r.title) for r in G.split_sections(marked).collect()}
    assert {tuple(r) for r in G.section_titles(marked).collect()} == want
    assert "array_join" not in G.section_titles(marked)._jdf.queryExecution().optimizedPlan().toString()


def test_hits_leave_a_task_in_bounded_batches(spark, monkeypatch):
    texts = spark.createDataFrame([(i, "abc") for i in range(50)], "id int, text string").coalesce(1)
    terms = spark.createDataFrame([("a",), ("b",), ("c",)], "term string")
    monkeypatch.setattr(K, "HIT_ROWS", 10)
    found = K.containment(texts, terms, small_rows=0)
    assert sorted(map(tuple, found.collect())) == sorted((i, t) for i in range(50) for t in "abc")


def test_lines_of_odd_texts_come_in_bounded_batches(spark, monkeypatch):
    """lines are those of the column expressions, without a pattern a line, and a task hands them on by their characters."""
    odd = ["\x0b\x0c\x1c\x1e\x85", "a\r\nb\r", "　x　\n\xa0y\xa0", "\x01a\x07\t", "ﬁ ½ Å", "\n\n", "", None, "a\x1fb c ", "é ﻿"]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    plain = T.compose(docs, "text").select("doc_id", F.posexplode(T.lines_array(F.col("text"))).alias("pos", "line"))
    plain = plain.select("doc_id", (F.col("pos") + 1).alias("line_no"), T.strip_right(T.drop_controls(F.col("line"))).alias("line"))
    read = G.read_lines(docs)
    assert read.schema == plain.schema and sorted(map(tuple, read.collect())) == sorted(map(tuple, plain.collect()))
    assert "MapInArrow" in read._jdf.queryExecution().toString()
    monkeypatch.setattr(G, "LINE_CHARS", 10)
    batches = list(G._lines([pa.RecordBatch.from_pydict({"doc_id": [7, 8, 9, 10], "text": ["ab\ncd", "efghij", "", "k"]})]))
    assert [b.to_pylist() for b in batches] == [
        [{"doc_id": 7, "line_no": 1, "line": "ab"}, {"doc_id": 7, "line_no": 2, "line": "cd"}, {"doc_id": 8, "line_no": 1, "line": "efghij"}], [{"doc_id": 10, "line_no": 1, "line": "k"}]
    ]


def test_sections_in_order_are_those_of_windows_without_a_shuffle(spark, monkeypatch):
    """sections of lines as they are read need no shuffle; other orders are an error."""
    texts = ["intro\n# A\nx\n\ny\n# B\nz", "no heading\nat all", "", None, "# only", "\n\n", "a\n#  \n# C \n # D\n\n", "# E\n# F"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 5)], "doc_id long, text string")
    marked = G.mark_headings(G.read_lines(docs), [("", "^#")])
    rows = G.sections_in_order(marked)
    assert rows.schema.simpleString() == G.split_sections(marked).schema.simpleString() and "Exchange" not in rows._jdf.queryExecution().toString()
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, G.split_sections(marked).collect()))
    monkeypatch.setattr(G, "LINE_CHARS", 3)
    lines = [(7, 1, "aaaa", False), (7, 2, "# b", True), (7, 3, "c", False), (7, 4, "# d", True), (8, 1, "e", False)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part)], ["doc_id", "line_no", "line", "is_heading"]) for part in (lines[:3], lines[3:])]
    assert [r for b in G._sections(iter(batches)) for r in map(tuple, (x.values() for x in b.to_pylist()))] == [(7, 1, "# b", 2, 3, "# b\nc"), (7, 2, "# d", 4, 4, "# d"), (8, 0, None, 1, 1, "e")]
    with pytest.raises(ValueError, match="does not follow"):
        list(G._sections(iter(batches[1:])))
