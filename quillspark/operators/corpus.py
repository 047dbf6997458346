"""Corpus maintenance: deduplication, merging, and embeddings that follow the corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.inventory import ordered


def filled(col: str) -> Column:
    return F.nullif(F.trim(F.col(col)), F.lit(""))


def paper_key() -> Column:
    """Identifier, else DOI, else lower-case title, in one namespace."""
    return F.coalesce(filled("id"), filled("doi"), F.lower(F.trim("title")))


def dedupe_papers(papers: DataFrame) -> DataFrame:
    """First row (by ord) of each key."""
    return ordered(papers.withColumn("key", paper_key()), ["key"], F.col("ord"), name="n").where("n = 1").drop("n")


def merge_harvest(existing: DataFrame, new: DataFrame, need_abstract: bool = True) -> DataFrame:
    """Existing rows win over new ones of the same key; new rows without an abstract may be left out."""
    fresh = new.where(filled("abstract").isNotNull()) if need_abstract else new
    rows = existing.withColumn("src", F.lit(0)).unionByName(fresh.withColumn("src", F.lit(1)))
    return dedupe_papers(rows.withColumn("ord", F.struct("src", "ord"))).withColumn("new", F.col("src") == 1).drop("src")


def rows_to_embed(corpus: DataFrame, index: DataFrame, model: str) -> DataFrame:
    """Corpus rows without a vector of this model: all of them after a change of model."""
    return corpus.join(index.where(F.col("model") == model).select("id"), "id", "left_anti")


def update_index(corpus: DataFrame, index: DataFrame, fresh: DataFrame, model: str) -> DataFrame:
    """Vectors of this model and new vectors, for ids that the corpus has."""
    kept = index.where(F.col("model") == model).select("id", "embedding")
    return kept.unionByName(fresh.select("id", "embedding")).join(corpus.select("id"), "id", "left_semi").withColumn("model", F.lit(model))


def embed_batches(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], size: int = 32) -> DataFrame:
    """(id, text) to (id, embedding) by a function over batches of texts; order inside a batch is kept."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), size):
                part = frame.iloc[at : at + size]
                yield pd.DataFrame({"id": part["id"], "embedding": embed(part["text"].fillna("").tolist())})

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "text").mapInPandas(run, f"id {kind}, embedding array<float>")


def hashed_embedding(texts: list[str], dim: int = 64) -> list[list[float]]:
    """Offline default of embed_batches: unit vectors of hashed word counts."""
    import zlib

    out = []
    for text in texts:
        vector = [0.0] * dim
        for word in text.lower().split():
            vector[zlib.crc32(word.encode()) % dim] += 1.0
        norm = sum(x * x for x in vector) ** 0.5 or 1.0
        out.append([x / norm for x in vector])
    return out
