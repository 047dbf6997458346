"""Folders and trees, the whole structure of a question, and answers made of what was found alone."""

import math

import pytest
from pyspark.sql import functions as F

from quillspark.operators import questions as Q
from quillspark.operators import sections as G
from quillspark.sources import io
from quillspark.streaming import answers as A


def test_markdown_folder_in_name_order(spark, tmp_path):
    for name, text in (("b.md", "# Zwei\nzwei"), ("a 1.md", "eins\r\nüber"), ("c+%20.md", "x"), ("empty.md", ""), ("d.txt", "no"), (".hidden.md", "no")):
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.md").write_text("no")
    docs = io.read_markdown(spark, f"file://{tmp_path}")
    assert [tuple(r) for r in docs.orderBy("doc_id").collect()] == [(1, "a 1.md", "eins\r\nüber"), (2, "b.md", "# Zwei\nzwei"), (3, "c+%20.md", "x")]
    lines = [tuple(r) for r in G.read_lines(docs).orderBy("doc_id", "line_no").collect()]
    assert lines == [(1, 1, "eins"), (1, 2, "über"), (2, 1, "# Zwei"), (2, 2, "zwei"), (3, 1, "x")]
    assert io.read_markdown(spark, f"file://{tmp_path}", "*.rst").collect() == []
    with pytest.raises(FileNotFoundError):
        io.read_markdown(spark, f"file://{tmp_path}/none")


def test_a_corpus_that_is_not_there_is_empty(spark, tmp_path):
    rows = io.read_corpus(spark, f"file://{tmp_path}/none")
    assert rows.collect() == [] and {"id", "title", "authors", "key"} <= set(rows.columns) | {"key"}


def test_a_chain_of_ten_thousand_nodes_takes_few_rounds(spark, monkeypatch):
    rounds = []
    write = io.written
    monkeypatch.setattr(io, "written", lambda df, label: rounds.append(label) or write(df, label))
    n = 10_000
    nodes = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.concat(F.lit("n"), "id").alias("label"), F.when(F.col("id") % 1000 == 0, F.col("id").cast("string")).alias("layer"), F.when(F.col("id") == 5, "t").alias("type"))
    got = {r.id: (r.label, r.layer, r.type, r.depth, r.is_leaf) for r in io.flatten_inventory_tree(nodes).collect()}
    assert len(rounds) <= math.ceil(math.log2(n)) + 2
    assert got == {i: (f"n{i}", str(i // 1000 * 1000), "t" if i >= 5 else None, i, i == n - 1) for i in range(n)}


def test_cycles_and_orphans_are_named(spark):
    rows = [("r", None), ("a", "r"), ("x", "y"), ("y", "z"), ("z", "x"), ("below", "x"), ("o", "gone"), ("p", "o"), ("self", "self")]
    nodes = spark.createDataFrame([(i, p, i, None, None) for i, p in rows], "id string, parent string, label string, layer string, type string")
    assert {r.id for r in io.flatten_inventory_tree(nodes).collect()} == {"r", "a"}
    want = dict.fromkeys(["x", "y", "z", "below", "self"], "cycle") | dict.fromkeys(["o", "p"], "orphan")
    assert {r.id: r.reason for r in io.unreached_nodes(nodes).collect()} == want
    assert io.flatten_inventory_tree(nodes.limit(0)).collect() == []


def test_the_whole_structure_of_questions(spark):
    questions = spark.createDataFrame([(1, "compare drag and knob", 0), (2, "review this", 2), (3, " ", 0), (4, "short", 0)], "qid long, text string, images int")
    resolved = spark.createDataFrame([(1, "compare", 0.9, False), (2, "review", 0.8, False), (3, None, 0.0, True), (4, "case", 0.7, False)], "qid long, intent string, confidence double, needs_clarification boolean")
    found = spark.createDataFrame([(1, "knob", 2), (1, "drag", 1)], "qid long, term string, ord int")
    layers = spark.createDataFrame([(1, ["form"])], "qid long, layers array<string>")
    frames = spark.createDataFrame([(1, ["a", "b"], "static"), (3, ["s"], "cot")], "qid long, frame array<string>, source string")
    fixed = spark.createDataFrame([(1, "knop", "knob"), (1, "drak", "drag")], "qid long, original string, canonical string")
    design = Q.Design("review", {"controls": F.array(F.lit("c")), "goal": F.lit("")}, F.array(F.lit("no goal")), F.array(F.lit("incomplete")))
    missing = Q.blocking_missing(F.col("intent"), F.col("text"), F.col("images"), F.size("terms"), F.size("design_missing") > 0)
    args = (questions, resolved, found, [("relation", ["and"])], ["definition"], [" and "])
    got = {r.qid: r.structure for r in Q.parse_questions(*args, layers=layers, frames=frames, corrections=fixed, design=design, missing=missing).collect()}
    one = got[1].asDict(recursive=True)
    assert one == {
        "raw_query": "compare drag and knob", "intent": "compare", "confidence": 0.9, "needs_clarification": False, "layers": ["form"], "terms": ["drag", "knob"], "focus": ["relation"], "compare_targets": ["drag", "knob"], "case_modality": ["text"],
        "missing_info": [], "term_corrections": [{"original": "drak", "canonical": "drag"}, {"original": "knop", "canonical": "knob"}], "output_frame": ["a", "b"], "output_frame_source": "static", "design_evaluation": None,
    }
    two = got[2].asDict(recursive=True)
    assert two["design_evaluation"] == {"controls": ["c"], "goal": "", "missing": ["no goal"], "risks": ["incomplete"]} and two["missing_info"] == ["no goal"] and two["case_modality"] == ["image", "text"]
    assert (got[3].intent, got[3].missing_info, got[3].output_frame_source, got[3].case_modality, got[3].layers) == ("open", [], "cot", ["text"], ["unknown"])
    assert got[4].missing_info == ["short case"]
    bare = {r.qid: r.structure for r in Q.parse_questions(*args).collect()}
    assert (bare[3].output_frame_source, bare[4].output_frame_source, bare[4].output_frame, bare[2].design_evaluation, bare[1].term_corrections) == ("cot", "static", [], None, [])


def test_answers_made_of_what_was_found_alone(spark):
    results = spark.createDataFrame([
        (1, 0, "ready", "show drag", "retrieve"), (2, 0, "ready", "show knob", "retrieve"), (3, 0, "ready", "zzzz", "retrieve"), (4, 0, "ready", "explain drag", "explain"), (5, 0, "clarify", "drag", "retrieve"),
    ], "session long, turn long, status string, query string, intent string")
    sections = spark.createDataFrame([("s1", 1, "drag handle", "about drag", "form", ["drag"]), ("s2", 2, "knob panel", "about knob", "form", ["knob"]), ("s3", 3, "turning knob", "more knob", "unknown", ["knob"])], "id string, ord long, title string, text string, layer string, terms array<string>")
    media = spark.createDataFrame([("m1", "drag handle", "a drag", ["drag"], "a b.png"), ("m2", "drag handle", "two", ["drag"], "c.png")], "id string, heading string, caption string, terms array<string>, name string")
    terms = spark.createDataFrame([("drag",), ("knob",)], "term string")
    frames = spark.createDataFrame([("explain", "summary")], "intent string, section string")
    answers = spark.createDataFrame([("4:0", "explain", "summary: yes"), ("1:0", "retrieve", "never shown")], "qid string, intent string, answer string")
    knowledge = A.Knowledge(sections, frames, terms, media)
    got = {r.session: r for r in A.answer_batch(results, knowledge, answers, retrieval_intent="retrieve").collect()}
    assert got[1].answer == "![a drag](/media/a%20b.png)\n\n![two](/media/c.png)" and got[1].audit == "" and got[1].media == "m1,m2"
    assert got[2].answer == "about knob\n\n---\n\nmore knob" and got[2].hits == "s2,s3"
    assert got[3].answer == "Nothing found." and got[3].hits == ""
    assert got[4].answer == "summary: yes" and got[4].audit != ""
    assert got[5].answer == "" and got[5].hits == ""
    whole = {r.session: r.answer for r in A.answer_batch(results, knowledge, answers).collect()}
    assert whole[1] == "never shown" and whole[2] == ""
    bare = {r.session: r.answer for r in A.answer_batch(results, A.Knowledge(sections, frames), answers, retrieval_intent="retrieve").collect()}
    assert bare[1] == "about drag" and bare[2] == "about knob\n\n---\n\nmore knob"
