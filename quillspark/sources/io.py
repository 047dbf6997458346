"""Readers and writers: JSON corpora, dictionaries and trees, indexes, harvest records, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.corpus import dedupe_papers
from quillspark.operators.ordinals import ordinals
from quillspark.sources.scratch import scratch, written  # noqa: F401

PAPER = "id string, title string, authors array<string>, year int, venue string, abstract string, doi string, url string, citations int, concepts array<string>"
ITEM = "id string, term string, term_type string, layer string, definition string, aliases array<string>, properties array<string>, mechanisms array<string>, forms array<string>, response string, related array<string>"
LOG = "timestamp timestamp, session_id string, endpoint string, question string, image_count int, style string, intent string, background boolean"


def write_corpus(papers: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Write JSON lines and return how many rows were written, counted in the same pass."""
    seen = Observation()
    papers.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).json(path)
    return seen.get["rows"]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the file or folder is there, in whatever store Spark reads it from."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_markdown(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """(doc_id, name, text) of a folder's files of that pattern, whole, numbered from 1 in the order of their names; subfolders, hidden and empty files are not read.

    A missing folder is an error, as nothing could be told from it; a folder without such files gives no rows.
    """
    if not exists(spark, path):
        raise FileNotFoundError(path)
    schema = "path string, modificationTime timestamp, length long, content binary"
    # listed and read by Spark, a file a row, so that any store will do; files of other names are not opened
    files = spark.read.schema(schema).format("binaryFile").option("pathGlobFilter", pattern).load(path)
    rows = files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.decode("content", "UTF-8").alias("text"))
    return ordinals(rows, [], [F.col("name")], "doc_id").select("doc_id", "name", "text")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Papers of JSON lines, defaults filled, first row of each key (in file order of ord). A corpus that is not there is empty."""
    reader = spark.read.schema(f"{PAPER}, ord long")
    rows = reader.json(path) if exists(spark, path) else spark.createDataFrame([], f"{PAPER}, ord long")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"authors": F.coalesce("authors", none), "concepts": F.coalesce("concepts", none), "citations": F.coalesce("citations", F.lit(0))})
    return dedupe_papers(rows)


def save_index(vectors: DataFrame, path: str, model: str) -> None:
    vectors.select("id", "embedding", F.lit(model).alias("model")).write.parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if "model" in rows.columns else rows.withColumn("model", F.lit(""))


def read_inventory_flat(docs: DataFrame, layers: list[str]) -> DataFrame:
    """(doc, kind, bucket, term, ord) from a JSON column: by_layer and by_type lists, aliases flat or grouped one level; blanks go, unknown layers fail."""
    lists = F.from_json("json", "by_layer map<string,array<string>>, by_type map<string,array<string>>, structural array<string>")
    rows = docs.select("doc", "json", lists.alias("j"))
    out = None
    for kind in ("by_layer", "by_type"):
        part = rows.select("doc", F.explode(f"j.{kind}").alias("bucket", "terms")).select("doc", F.lit(kind).alias("kind"), "bucket", F.posexplode("terms").alias("ord", "term"))
        out = part if out is None else out.unionByName(part)
    structural = rows.select("doc", F.lit("structural").alias("kind"), F.lit("").alias("bucket"), F.posexplode("j.structural").alias("ord", "term"))
    pairs = rows.select("doc", F.explode(F.from_json(F.get_json_object("json", "$.aliases"), "map<string,string>")).alias("k", "v"))
    grouped = F.from_json("v", "map<string,string>")
    flat = pairs.select("doc", F.explode(F.when(F.col("v").startswith("{"), grouped).otherwise(F.create_map("k", "v"))).alias("bucket", "term"))
    aliases = flat.select("doc", F.lit("alias").alias("kind"), "bucket", F.lit(0).alias("ord"), "term")
    rows = out.unionByName(structural).unionByName(aliases).where(F.trim("term") != "")
    bad = (F.col("kind") == "by_layer") & ~F.col("bucket").isin(*layers)
    return rows.withColumn("bucket", F.when(bad, F.raise_error(F.concat(F.lit("unknown layer "), "bucket"))).otherwise(F.col("bucket")))


def climbed(nodes: DataFrame) -> DataFrame:
    """(id, at, layer, type, dist, orphan) of (id, parent, layer, type), by pointer doubling: at is null once the root is reached.

    Each round joins every node with the node it points at and takes over its pointer, its distance and,
    where still missing, its layer and type: n nodes in a chain take log2(n) rounds. What points on after
    that is on a cycle or below one; orphan marks a way that ends at a parent that is not there.
    """
    n = nodes.count()
    start = nodes.select("id", F.col("parent").alias("at"), "layer", "type", F.col("parent").isNotNull().cast("long").alias("dist"), F.lit(False).alias("orphan"))
    rows = written(start, "tree")
    for _ in range(max(1, n).bit_length() + 1):
        if rows.where("at IS NOT NULL").isEmpty():
            break
        ahead = rows.select(F.col("id").alias("next"), F.col("at").alias("n_at"), F.col("layer").alias("n_layer"), F.col("type").alias("n_type"), F.col("dist").alias("n_dist"), F.col("orphan").alias("n_orphan"))
        met = rows.join(ahead, F.col("at") == F.col("next"), "left")
        lost = F.col("at").isNotNull() & F.col("next").isNull()
        rows = written(met.select("id", F.col("n_at").alias("at"), F.coalesce("layer", "n_layer").alias("layer"), F.coalesce("type", "n_type").alias("type"), (F.col("dist") + F.coalesce("n_dist", F.lit(0))).alias("dist"), (F.col("orphan") | lost | F.coalesce("n_orphan", F.lit(False))).alias("orphan")), "tree")
    return rows


def unreached_nodes(nodes: DataFrame) -> DataFrame:
    """(id, reason) of nodes that no root reaches: 'cycle' on a cycle or below one, 'orphan' below a parent that is not there."""
    return climbed(nodes).where("at IS NOT NULL OR orphan").select("id", F.when(F.col("orphan"), "orphan").otherwise("cycle").alias("reason"))


def flatten_inventory_tree(nodes: DataFrame) -> DataFrame:
    """(id, label, layer, type, depth, is_leaf) of (id, parent, label, layer, type): layer and type come from the nearest ancestor that has them.

    Nodes that no root reaches give no rows (unreached_nodes names them); ids are unique.
    """
    tree = climbed(nodes).where("at IS NULL AND NOT orphan").select("id", "layer", "type", F.col("dist").cast("int").alias("depth"))
    inner = nodes.where("parent IS NOT NULL").select(F.col("parent").alias("inner_id")).distinct()
    rows = tree.join(nodes.select("id", "label"), "id")
    return rows.join(inner, rows["id"] == inner["inner_id"], "left").select("id", "label", "layer", "type", "depth", F.col("inner_id").isNull().alias("is_leaf"))


def tree_inventory(nodes: DataFrame, root_aliases: DataFrame, layers: list[str]) -> DataFrame:
    """(kind, bucket, term) of a tree of (id, parent, label, layer, type, aliases): leaves by layer and by type, subgroups, aliases.

    Labels of inner nodes below the root that have a type are subgroups of it, unless they spell the
    root's label. A node's aliases name its label (of two nodes with one alias the larger id counts);
    root_aliases (alias, canonical) override them. Blank labels and aliases give nothing, a layer that
    is not among layers fails.
    """
    tree = flatten_inventory_tree(nodes).withColumn("label", F.trim("label")).where("label != ''")
    unknown = F.col("layer").isNotNull() & ~F.col("layer").isin(*layers)
    tree = tree.withColumn("layer", F.when(unknown, F.raise_error(F.concat(F.lit("unknown layer "), "layer"))).otherwise(F.col("layer")))
    kind = F.trim(F.coalesce("type", F.lit("")))
    by_layer = tree.where("is_leaf and layer is not null").select(F.lit("by_layer").alias("kind"), F.col("layer").alias("bucket"), F.col("label").alias("term"))
    by_type = tree.where(F.col("is_leaf") & (kind != "")).select(F.lit("by_type").alias("kind"), kind.alias("bucket"), F.col("label").alias("term"))
    roots = tree.where("depth = 0").select(F.col("label").alias("root")).distinct()
    inner = tree.where(~F.col("is_leaf") & (F.col("depth") > 0) & (kind != "")).join(roots, F.col("label") == F.col("root"), "left_anti")
    groups = inner.select(F.lit("subgroup").alias("kind"), kind.alias("bucket"), F.col("label").alias("term"))
    own = nodes.select("id", F.trim("label").alias("label"), F.explode("aliases").alias("alias")).select(F.trim("alias").alias("alias"), F.struct(F.lit(0).alias("level"), "id", "label").alias("of"))
    over = root_aliases.select(F.trim("alias").alias("alias"), F.struct(F.lit(1).alias("level"), F.lit("").alias("id"), F.trim("canonical").alias("label")).alias("of"))
    named = own.unionByName(over).where("alias != '' and of.label != ''").groupBy("alias").agg(F.max("of").alias("of"))
    aliases = named.select(F.lit("alias").alias("kind"), F.col("alias").alias("bucket"), F.col("of.label").alias("term"))
    return by_layer.unionByName(by_type).unionByName(groups).distinct().unionByName(aliases)


def read_structured_items(docs: DataFrame, layers: list[str]) -> DataFrame:
    """Items from a JSON column that holds an array or {"items": [...]}; the id defaults to the term; a missing term or bad layer fails."""
    array = F.when(F.ltrim("json").startswith("["), F.from_json("json", f"array<struct<{_struct(ITEM)}>>")).otherwise(F.from_json("json", f"items array<struct<{_struct(ITEM)}>>")["items"])
    rows = docs.select("doc", F.posexplode(array).alias("pos", "i")).select("doc", "pos", "i.*")
    term = F.when(F.coalesce(F.trim("term"), F.lit("")) == "", F.raise_error(F.lit("an item has no term"))).otherwise(F.trim("term"))
    layer = F.when(F.col("layer").isin(*layers), F.col("layer")).otherwise(F.raise_error(F.concat(F.lit("bad layer "), F.coalesce("layer", F.lit("null")))))
    rows = rows.withColumn("term", term).withColumn("layer", layer)
    return rows.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), F.concat(F.lit("structured:"), "term"))).withColumn("term_type", F.coalesce(F.nullif("term_type", F.lit("")), "layer"))


def _struct(schema: str) -> str:
    return ",".join(f"{a}:{b}" for a, b in (x.strip().split(" ", 1) for x in schema.split(", ")))


def export_structured_items(items: DataFrame, by: str) -> DataFrame:
    """(by, json): one {"items": [...]} object per value of a column, in order of ord."""
    lists = items.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("ord", F.struct("id", "term", "layer").alias("i")))).alias("xs"))
    return lists.select(by, F.to_json(F.struct(F.transform("xs", lambda x: x["i"]).alias("items"))).alias("json"))


def read_examples(docs: DataFrame, intents: DataFrame) -> DataFrame:
    """(doc, pos, question, intent): rows with a blank question or an unknown intent are left out, unreadable JSON gives none."""
    parsed = F.from_json("json", "examples array<struct<question:string,intent:string,note:string>>")["examples"]
    rows = docs.select("doc", F.posexplode(parsed).alias("pos", "e")).select("doc", "pos", "e.question", "e.intent")
    return rows.where(F.trim("question") != "").join(F.broadcast(intents), "intent", "left_semi").select("doc", "pos", "question", "intent")


def read_frames(docs: DataFrame, intents: list[str], mode: str = "merge") -> tuple[DataFrame, DataFrame]:
    """((doc, intent, ord, section), (doc, intent) that a replacement lacks); frames are under 'frames' or at the top; unknown intents and empty frames fail."""
    inner = F.from_json(F.coalesce(F.get_json_object("json", "$.frames"), F.col("json")), "map<string,array<string>>")
    rows = docs.select("doc", F.explode(inner).alias("intent", "sections")).where("intent != 'mode'")
    bad = ~F.col("intent").isin(*intents) | (F.size("sections") == 0)
    rows = rows.withColumn("intent", F.when(bad, F.raise_error(F.concat(F.lit("bad frame "), "intent"))).otherwise(F.col("intent")))
    frames = rows.select("doc", "intent", F.posexplode("sections").alias("ord", "section"))
    wanted = docs.select("doc", F.explode(F.array(*map(F.lit, [i for i in intents if i != "open"]))).alias("intent"))
    lacking = wanted.join(frames.select("doc", "intent").distinct(), ["doc", "intent"], "left_anti")
    return frames, lacking if mode == "replace" else lacking.limit(0)


def read_media_index(docs: DataFrame) -> DataFrame:
    parsed = F.from_json("json", "images array<struct<id:string,filename:string,source:string,heading:string,annotation:string,terms:array<string>>>")["images"]
    rows = docs.select("doc", F.explode(parsed).alias("i")).select("doc", "i.*")
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("source", "heading", "annotation")} | {"terms": F.coalesce("terms", F.array().cast("array<string>"))})


def read_config(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON with // and /* */ comments, typed by schema."""
    return spark.read.schema(schema).option("allowComments", True).option("multiLine", True).json(path)


def map_harvest_records(raw: DataFrame, venue_label: str) -> DataFrame:
    """Raw API records (paperId, title, year, abstract, authors, citationCount, externalIds, url) to papers; blank titles go."""
    title, doi = F.trim("title"), F.nullif(F.col("externalIds.DOI"), F.lit(""))
    authors = F.transform(F.filter(F.coalesce("authors", F.array().cast("array<struct<name:string>>")), lambda a: F.coalesce(F.trim(a["name"]), F.lit("")) != ""), lambda a: F.trim(a["name"]))
    link = F.coalesce(F.nullif("url", F.lit("")), F.concat(F.lit("https://doi.org/"), doi), F.lit(""))
    return raw.where(F.coalesce(title, F.lit("")) != "").select(
        F.coalesce(F.nullif("paperId", F.lit("")), doi, F.lower(title)).alias("id"), title.alias("title"), authors.alias("authors"), "year", F.lit(venue_label).alias("venue"),
        F.coalesce("abstract", F.lit("")).alias("abstract"), F.coalesce(doi, F.lit("")).alias("doi"), link.alias("url"), F.coalesce("citationCount", F.lit(0)).alias("citations"),
    )


def expand_venues(keys: DataFrame, venues: DataFrame) -> DataFrame:
    """(key, venue): the venues of a key, the key itself if it has none."""
    return keys.join(venues, "key", "left").select("key", F.coalesce("venue", "key").alias("venue"))


def year_range(first: int | None, last: int | None) -> str:
    """The years of a harvest as its sources spell them: one year plainly, two with a hyphen, open ends left out."""
    if first is not None and first == last:
        return str(first)
    return "-".join("" if y is None else str(y) for y in (first, last)) if first is not None or last is not None else ""


def in_years(year: Column, first: int | None, last: int | None) -> Column:
    """Whether a year lies in the inclusive range; an open end does not bound it, a null year is never inside."""
    inside = year.isNotNull()
    if first is not None:
        inside = inside & (year >= first)
    return inside if last is None else inside & (year <= last)


def append_question_log(questions: DataFrame, path: str, checkpoint: str):
    """Start a stream that appends one JSON record per question."""
    return questions.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
