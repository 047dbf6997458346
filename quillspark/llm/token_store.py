"""Token-ID files: canonical length-limited Huffman coding of ids.

Ids are counted over all documents; the counts (one per vocabulary entry) give code lengths of at
most max_bits by package-merge, and the canonical code follows from the lengths alone. A file is a
Parquet table whose rows are independent blocks of whole documents in ascending doc_id order: the
packed bits, the ids per document, and the bit offset of every STRIDE-th id. Decoding looks up
max_bits bits in one table and runs all checkpoints of a block side by side.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, table

#: Ids between two bit-offset checkpoints.
STRIDE = 256
#: Ids after which a block ends, at the end of a document.
BLOCK_IDS = 1 << 19
#: Pieces kept per Python worker; beyond it their memory starts afresh.
CACHE_PIECES = 1_200_000
#: How the vocabulary marks the last token of a piece.
WORD_END = "</w>"
#: Pieces that the library gets in one call.
ASK_PIECES = 2000

#: Pieces of lower-case Latin text, as the vocabulary's own pattern cuts it.
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\u017f]+|[0-9]|[^\\s0-9a-z\xdf-\xf6\xf8-\u017f]+")
#: Characters whose texts go to the library whole: controls, odd spaces, number signs, other scripts.
_OTHER = re.compile("[\x00-\x08\x0e-\x1f\x7f-\xa0\xaa\xad\xb2\xb3\xb5\xb9\xba\xbc-\xbe\u0130\u0180-\U0010ffff]")


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Optimal code lengths of at most max_bits (package-merge); 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids do not fit codes of {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    n = len(weights)
    # each level lists leaves and packages by weight; a leaf is n or more below zero: is_leaf marks it
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(max_bits):
        merged = np.concatenate((weights, packages))
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < n)
        merged = merged[rank]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    take = 2 * n - 2
    depth = np.zeros(n, np.int64)
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = depth
    return lengths


class HuffmanCode:
    """The canonical code of given lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.bits = int(self.lengths.max(initial=1))
        ids = np.flatnonzero(self.lengths)
        ids = ids[np.lexsort((ids, self.lengths[ids]))]
        size = self.lengths[ids]
        spans = np.int64(1) << (self.bits - size)
        starts = np.cumsum(spans) - spans
        self.codes = np.zeros(len(lengths), np.int64)
        self.codes[ids] = starts >> (self.bits - size)
        self.symbol = np.zeros(1 << self.bits, np.int64)
        self.symbol[: spans.sum()] = np.repeat(ids, spans)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Packed bits, and the bit offset of every STRIDE-th id."""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        begins = ends - size
        total = int(ends[-1]) if len(ids) else 0
        word, room = begins >> 5, 64 - (begins & 31) - size
        value = self.codes[ids].astype(np.uint64) << room.astype(np.uint64)
        n = (total + 31) // 32 + 2
        # codes do not overlap, so sums of their halves are exact unions (below 2**53)
        high = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n)
        low = np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
        return (high + low).astype(np.uint64).astype(">u4").tobytes()[: (total + 7) // 8], begins[::STRIDE]

    def decode(self, packed: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """n ids; every stretch between two checkpoints runs as one lane."""
        data = np.frombuffer(packed + b"\0" * 8, np.uint8).astype(np.int64)
        at = checkpoints.astype(np.int64).copy()
        out = np.zeros((len(at), STRIDE), np.int64)
        mask, last = (1 << self.bits) - 1, n - STRIDE * (len(at) - 1)
        for i in range(STRIDE if len(at) > 1 else last):
            lanes = len(at) if i < last else len(at) - 1
            p = at[:lanes]
            byte = p >> 3
            window = data[byte] << 32 | data[byte + 1] << 24 | data[byte + 2] << 16 | data[byte + 3] << 8 | data[byte + 4]
            symbol = self.symbol[(window >> (40 - self.bits - (p & 7))) & mask]
            out[:lanes, i] = symbol
            at[:lanes] += self.lengths[symbol]
        return out.reshape(-1)[:n]


class WordTokenizer:
    """The tokenizers library, asked once per distinct piece of Latin text, and for other texts whole."""

    def __init__(self, path: str, dtype: str = "<u4"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # a text that spells one of these has it as one id, as the library cuts it out first
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) if added else r"(?!)", re.I)
        self.dtype = np.dtype(dtype)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.pieces: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch(texts, add_special_tokens=False)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self._ids(texts)]

    def _learn(self, found: list[str]) -> None:
        for at in range(0, len(found), ASK_PIECES):
            part = found[at : at + ASK_PIECES]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            cuts = (self.dtype.itemsize * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) == len(part):
                raw = ids.tobytes()
                self.pieces.update(zip(part, [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)], strict=True))
            else:  # pieces that the library cuts otherwise beside each other
                self.pieces.update(zip(part, self.whole(part), strict=True))

    def encode_batch(self, texts: list[str], end: bytes) -> list[bytes]:
        plain = [not _OTHER.search(t) and not self.added.search(t) and (t.isascii() or unicodedata.is_normalized("NFC", t)) for t in texts]
        cut = [_PIECE.findall(t.lower()) if p else [] for t, p in zip(texts, plain, strict=True)]
        every: set[str] = set()
        for pieces in cut:
            every.update(pieces)
        missing = every.difference(self.pieces)
        if len(self.pieces) + len(missing) > CACHE_PIECES:
            self.pieces.clear()
            missing = every
        self._learn(list(missing))
        known = self.pieces
        out = [b"".join([known[x] for x in pieces]) + end for pieces in cut]
        odd = [i for i, p in enumerate(plain) if not p]
        for i, ids in zip(odd, self.whole([texts[i] for i in odd]), strict=True):
            out[i] = ids + end
        return out


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str, dtype: str) -> WordTokenizer:
    if path + dtype not in _tokenizers:
        _tokenizers[path + dtype] = WordTokenizer(path, dtype)
    return _tokenizers[path + dtype]


def id_type(vocabulary: int) -> str:
    """Little-endian integers that hold every id, for tables on the way."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def token_ids(docs: DataFrame, path: str, vocabulary: int, end_id: int) -> DataFrame:
    """(doc_id, text) to (doc_id, ids): integers of id_type, with the end id. Null and empty texts have that one only; repeated rows stay; no rows give none."""
    dtype = id_type(vocabulary)
    end = np.array([end_id], dtype).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path, dtype)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = tokenizer.encode_batch([x or "" for x in part.column(1).to_pylist()], end)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.mapInArrow(run, "doc_id long, ids binary")


def id_counts(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs, counted per task, summed by Spark: one number per vocabulary entry reaches the driver. No rows give zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        dtype = id_type(vocabulary)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(total[used])], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(vocabulary, np.int64)
    counts[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts


BLOCK_SCHEMA = "shard int, block int, before long, doc_ids array<long>, sizes array<long>, n_ids long, checkpoints array<long>, packed binary"


def write_token_file(docs: DataFrame, path: str, vocabulary: int, end_id: int, max_bits: int = 16, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, np.ndarray]:
    """Encode all texts and write them in ascending doc_id order; return the blocks and the code lengths.

    Null texts count as empty, and each document gets the end id, so no document is without ids.
    Equal doc_ids (and null ones, which come first) stand in the order of their ids. An empty table
    gives no blocks. Other columns are ignored. shard and block number the blocks in file order; before
    counts the ids of the shard's earlier blocks.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tokens = materialize(token_ids(base, path, vocabulary, end_id), "token-ids")
    lengths = code_lengths(id_counts(tokens, vocabulary), max_bits)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(lengths)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        code, shard, block = HuffmanCode(shared.value), TaskContext.get().partitionId(), 0
        dtype = np.dtype(id_type(vocabulary))
        doc_ids, pending, n, before = [], [], 0, 0

        def flush() -> pd.DataFrame:
            ids = np.frombuffer(b"".join(pending), dtype).astype(np.int64)
            packed, checkpoints = code.encode(ids)
            return pd.DataFrame([(shard, block, before, doc_ids, [len(x) // dtype.itemsize for x in pending], len(ids), checkpoints.tolist(), packed)], columns=["shard", "block", "before", "doc_ids", "sizes", "n_ids", "checkpoints", "packed"])

        for frame in frames:
            for doc_id, ids in zip(frame["doc_id"].astype(object), frame["ids"], strict=True):
                doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                pending.append(ids)
                n += len(ids) // dtype.itemsize
                if n >= BLOCK_IDS:
                    yield flush()
                    doc_ids, pending, n, block, before = [], [], 0, block + 1, before + n
        if pending:
            yield flush()

    ordered = tokens.select("doc_id", "ids").repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    return materialize(ordered.mapInPandas(run, BLOCK_SCHEMA), "token-file", codec="none"), lengths


def read_token_file(blocks: DataFrame, lengths: np.ndarray) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document: start counts the ids of all documents before it. A file without blocks gives no rows."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(lengths)
    # one number per shard is summed on the driver, as many as the file has parts
    shards = sorted((r["shard"], r["n"]) for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    sums = np.concatenate(([0], np.cumsum([n for _, n in shards]))).tolist()
    starts = spark.createDataFrame([(s, int(b)) for (s, _), b in zip(shards, sums, strict=False)], "in_shard int, shard_start long")
    placed = blocks.join(F.broadcast(starts), F.col("shard") == F.col("in_shard")).withColumn("first", F.col("shard_start") + F.col("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = HuffmanCode(shared.value)
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, sizes, n, checkpoints, packed, first = (batch.column(i)[row] for i in range(6))
                sizes = sizes.values.to_numpy()
                ids = code.decode(packed.as_py(), checkpoints.values.to_numpy(), n.as_py()).astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                parts = [ids[4 * a : 4 * b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(first.as_py() + ends - sizes), pa.array(sizes), pa.array(parts, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return placed.select("doc_ids", "sizes", "n_ids", "checkpoints", "packed", "first").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def crc_of_ids(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row; repeated rows give repeated results."""
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token file of documents, read back; null texts have the end id only, equal doc_ids stand by their ids."""
    import public_tokenizers

    blocks, lengths = write_token_file(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), vocabulary=49_408, end_id=2)
    return crc_of_ids(read_token_file(blocks, lengths))
