"""Language-model scores by context-tree weighting over bytes, with a unigram score of words beside them.

A text is its lower-cased words with one space between them and a line feed at its end. Each byte is
eight binary decisions; every decision has a tree of its own over the DEPTH bytes before it, and the
Krichevsky-Trofimov estimates of all depths are mixed by the weights that the training texts give them:
P(node) = half its own estimate of its bits + half the product of P over its children.

The model is never in one place. Documents are packed in chunks; a chunk knows its distinct grams
(context and next byte, most recent byte first) and asks for their probabilities. Requests are dealt by
ranges of grams. As a context is a range too, nearly every context lies in one task whole; those that
reach over a border send their counts, and are summed over the tasks depth by depth. The answers go back
to the chunks. Counts of words are dealt by hash in the same way.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import discard, materialize, small, table
from quillspark.llm.quality import fold
from quillspark.operators.ordinals import ordinals

#: Bytes of context: a gram of DEPTH + 1 bytes fits a long.
DEPTH = 5
#: Bytes of text in a chunk (one text at least), and of those whose grams are made at once.
CHUNK_BYTES, PART_BYTES = 32 << 20, 2 << 20
#: Requests that a range of grams or a share of the words gets on average.
RANGE_REQUESTS, SHARE_REQUESTS = 1 << 19, 1 << 18
#: Sampled requests for each border between ranges.
SAMPLES = 32
FOLDS, HELD = 5, 1

_BITS = 8
_HALF = np.log(0.5)


def packed(values: np.ndarray, kind: str = "<i8") -> bytes:
    """Compressed integers; their first differences, so sorted ones get small."""
    raw = np.diff(values.astype(np.int64), prepend=np.int64(0)).astype(kind).tobytes()
    return pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def unpacked(raw: bytes, n: int, kind: str = "<i8") -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    return np.cumsum(np.frombuffer(pa.decompress(raw, n * np.dtype(kind).itemsize, codec="zstd"), kind).astype(np.int64))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def plain(text: str | None) -> bytes:
    """The text as the model reads it. Lone surrogates count as question marks."""
    return b" ".join((text or "").encode("utf-8", "replace").lower().split()) + b"\n"


def words_of(body: bytes) -> list[bytes]:
    """Its tokens: words, then one end."""
    return [*body.split(), b"\n"]


def grams(bodies: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(gram of every byte, where each text's grams begin and the last one's end); before a text stand line feeds."""
    pad = b"\n" * depth
    data = np.frombuffer(b"".join([pad + b for b in bodies]), np.uint8)
    sizes = np.array([len(b) for b in bodies], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    out, n = np.zeros(len(data) - depth, np.int64), len(data) - depth
    for back in range(1, depth + 1):
        out |= data[depth - back : depth - back + n]
        out <<= _BITS
    out |= data[depth:]
    # what follows a text is the next one's line feeds
    text = np.ones(n, bool)
    text[(starts[1:-1, None] + depth * np.arange(len(bodies) - 1)[:, None] + np.arange(depth)).reshape(-1)] = False
    return out[text], starts


def parts(bodies: list[bytes], most: int = PART_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about that many bytes."""
    at, size = 0, 0
    for i, body in enumerate(bodies):
        size += len(body)
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(bodies):
        yield at, len(bodies)


# ids travel as strings: pandas would turn integers with a null among them into floats
CHUNK = "chunk long, doc_ids array<string>, held array<boolean>, sizes array<long>, texts binary, n_keys long, keys binary, counts binary, n_words long, words binary, word_counts binary"


def chunks_of(docs: DataFrame, depth: int = DEPTH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, text, held) to chunks of whole texts with their distinct grams and words and how often training texts have them."""

    def pack(chunk: int, ids: list, held: list[bool], bodies: list[bytes]) -> pa.RecordBatch:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        every: set[bytes] = set()
        known: Counter[bytes] = Counter()
        for a, b in parts(bodies):
            found, starts = grams(bodies[a:b], depth)
            training = np.repeat(~np.array(held[a:b]), np.diff(starts))
            k, n = np.unique(found[training], return_counts=True)
            rest = np.unique(found[~training])
            keys, counts = summed(np.concatenate((keys, k, rest)), np.concatenate((counts, n, np.zeros(len(rest), np.int64))))
            for body, out in zip(bodies[a:b], held[a:b], strict=True):
                (every if out else known).update(words_of(body))
        words = sorted(every.union(known), key=lambda w: (zlib.crc32(w), w))
        n = np.array([known[w] for w in words], np.int64)
        # the end stands as a line feed; no word holds a space
        row = [[chunk], [[None if i is None else str(i) for i in ids]], [held], [[len(b) for b in bodies]], [pa.compress(b"".join(bodies), codec="zstd", asbytes=True)], [len(keys)], [packed(keys)], [packed(counts)], [len(words)], [pa.compress(b" ".join(words), codec="zstd", asbytes=True)], [packed(n)]]
        kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
        names = ["chunk", "doc_ids", "held", "sizes", "texts", "n_keys", "keys", "counts", "n_words", "words", "word_counts"]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, held, bodies, size = [], [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                ids.append(batch.column(0)[i].as_py())
                held.append(batch.column(2)[i].as_py())
                bodies.append(plain(batch.column(1)[i].as_py()))
                size += len(bodies[-1])
                if size >= chunk_bytes:
                    yield pack(number, ids, held, bodies)
                    ids, held, bodies, size, number = [], [], [], 0, number + 1
        if bodies:
            yield pack(number, ids, held, bodies)

    return materialize(docs.select("doc_id", "text", "held").mapInArrow(run, CHUNK), "lm-chunks")


def _text_of(raw: bytes) -> bytes:
    """A zstd frame names its own size, which pyarrow wants to be told."""
    import zstandard

    return zstandard.ZstdDecompressor().decompress(raw)


def borders(chunks: DataFrame, range_requests: int = RANGE_REQUESTS) -> np.ndarray:
    """Grams at which ranges of about range_requests requests begin: quantiles of a sample of the requests, which Spark sorts; one number per range reaches the driver."""
    total = chunks.agg(F.sum("n_keys")).first()[0] or 0
    every = max(1, range_requests // SAMPLES)
    if total <= range_requests:
        return np.zeros(0, np.int64)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                chunk, n, keys = (batch.column(i)[row].as_py() for i in range(3))
                keys = unpacked(keys, n)
                x = (keys.view(np.uint64) ^ np.uint64(chunk * 0x9E3779B9 & 0xFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
                yield pa.RecordBatch.from_arrays([pa.array(keys[(x >> np.uint64(33)) % np.uint64(every) == 0])], ["key"])

    sample = materialize(chunks.select("chunk", "n_keys", "keys").mapInArrow(draw, "key long"), "lm-sample")
    numbered = ordinals(sample, [], [F.col("key")], "ord")
    found = numbered.where(F.col("ord") % SAMPLES == 0).select("key").distinct().toPandas()["key"].to_numpy(np.int64)
    discard(sample)
    return np.sort(found)


RANGE = "range int, first long, last long, n long, keys binary, counts binary, chunks array<long>, sizes array<long>, places binary"


def ranges_of(chunks: DataFrame, starts: np.ndarray) -> DataFrame:
    """One row per range: its distinct grams with their counts, and which of them each chunk asks for."""
    shared = chunks.sparkSession.sparkContext.broadcast(starts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                chunk, n, keys, counts = (batch.column(i)[row].as_py() for i in range(4))
                keys, counts = unpacked(keys, n), unpacked(counts, n)
                cuts = np.concatenate(([0], np.searchsorted(keys, shared.value), [n]))
                full = np.flatnonzero(np.diff(cuts))
                slices = [(int(cuts[r]), int(cuts[r + 1])) for r in full]
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([chunk] * len(full), pa.int64()), pa.array([b - a for a, b in slices], pa.int64()), pa.array([packed(keys[a:b]) for a, b in slices], pa.binary()), pa.array([packed(counts[a:b]) for a, b in slices], pa.binary())], ["range", "chunk", "n", "keys", "counts"])

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk")
        keys = np.concatenate([unpacked(k, n) for k, n in zip(frame["keys"], frame["n"], strict=True)])
        counts = np.concatenate([unpacked(c, n) for c, n in zip(frame["counts"], frame["n"], strict=True)])
        distinct, places = np.unique(keys, return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, places, counts)
        row = (int(frame["range"].iloc[0]), int(distinct[0]), int(distinct[-1]), len(distinct), packed(distinct), packed(total), frame["chunk"].tolist(), frame["n"].tolist(), packed(places))
        return pd.DataFrame([row], columns=["range", "first", "last", "n", "keys", "counts", "chunks", "sizes", "places"])

    dealt = chunks.select("chunk", "n_keys", "keys", "counts").mapInArrow(deal, "range int, chunk long, n long, keys binary, counts binary")
    return materialize(dealt.groupBy("range").applyInPandas(gather, RANGE), "lm-ranges")


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series eight steps up; exact to about 1e-11 from 1/2 on."""
    y = x + 8.0
    low = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7)
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y
    # beyond 1e30 eight factors would overflow, and the shift no longer matters
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(low)


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of that many bits."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def log_weighted(own: np.ndarray, children: np.ndarray) -> np.ndarray:
    return np.logaddexp(_HALF + own, _HALF + children)


class ContextTree:
    """The trees of one range of grams: sorted distinct grams and how often training texts have them."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int = DEPTH):
        self.depth = depth
        self.keys, self.counts, self.up = [None] * (depth + 1), [None] * (depth + 1), [None] * (depth + 1)
        self.keys[depth], self.counts[depth] = keys, counts.astype(np.float64)
        byte = np.int64(255)
        for d in range(depth - 1, -1, -1):
            # the oldest byte of the context goes; the symbol stays in the last place
            shorter = self.keys[d + 1] >> 16 << 8 | self.keys[d + 1] & byte
            self.keys[d], self.up[d + 1] = np.unique(shorter, return_inverse=True)
            self.counts[d] = np.bincount(self.up[d + 1], self.counts[d + 1], len(self.keys[d]))
        first, last = int(keys[0]), int(keys[-1])
        self.open = [{first >> _BITS * (depth - d + 1), last >> _BITS * (depth - d + 1)} for d in range(depth + 1)]

    def nodes(self, bit: int) -> list[dict[str, np.ndarray]]:
        """For each depth the nodes of that decision: ids (context, bits so far), zeros, ones, the node of each key, the node above, whether the context reaches over the range."""
        out = []
        for d in range(self.depth + 1):
            keys, counts = self.keys[d], self.counts[d]
            every = keys >> (_BITS - bit)
            new = np.concatenate(([True], every[1:] != every[:-1]))
            start = np.flatnonzero(new)
            of_key = np.cumsum(new) - 1
            one = (keys >> (_BITS - 1 - bit) & 1) * counts
            ones, total = np.add.reduceat(one, start), np.add.reduceat(counts, start)
            ids = every[start]
            context = ids >> bit
            is_open = np.zeros(len(ids), bool)
            for c in self.open[d]:
                is_open |= context == c
            above = out[d - 1]["of_key"][self.up[d][start]] if d else None
            out.append({"ids": ids, "zeros": total - ones, "ones": ones, "of_key": of_key, "above": above, "open": is_open})
        return out

    def partial(self) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(depth, context, node, zeros, ones, sum of the closed children's log P) of nodes of open contexts."""
        found = []
        for bit in range(_BITS):
            levels = self.nodes(bit)
            below = None
            for d in range(self.depth, -1, -1):
                x = levels[d]
                own = log_estimate(x["zeros"], x["ones"])
                x["log"] = own if below is None else log_weighted(own, below)
                at = np.flatnonzero(x["open"] & (x["zeros"] + x["ones"] > 0))
                children = np.zeros(len(own)) if below is None else below
                found.append((d, x["ids"][at] >> bit, (1 << bit) + (x["ids"][at] & ((1 << bit) - 1)), x["zeros"][at], x["ones"][at], children[at]))
                if d:
                    below = np.bincount(x["above"], np.where(x["open"], 0.0, x["log"]), len(levels[d - 1]["ids"]))
        return found

    def log10(self, known: dict[tuple[int, int, int], tuple[float, float, float]]) -> np.ndarray:
        """log10 of the probability of each key's byte after its context; known has (zeros, ones, log P) of (depth, context, node) of open contexts."""
        total = np.zeros(len(self.keys[self.depth]))
        place = [None] * (self.depth + 1)
        place[self.depth] = np.arange(len(total))
        for d in range(self.depth, 0, -1):
            place[d - 1] = self.up[d][place[d]]
        for bit in range(_BITS):
            levels = self.nodes(bit)
            below, deeper = None, None
            one = (self.keys[self.depth] >> (_BITS - 1 - bit) & 1) > 0
            p = np.full(len(total), 0.5)
            for d in range(self.depth, -1, -1):
                x = levels[d]
                own = log_estimate(x["zeros"], x["ones"])
                log = own if below is None else log_weighted(own, below)
                for i in np.flatnonzero(x["open"]):
                    key = int(x["ids"][i])
                    if (got := known.get((d, key >> bit, (1 << bit) + (key & ((1 << bit) - 1))))) is not None:
                        x["zeros"][i], x["ones"][i], log[i] = got
                        own[i] = log_estimate(np.array(got[0]), np.array(got[1]))
                n = x["zeros"] + x["ones"]
                share = np.exp(np.minimum(0.0, _HALF + own - log))
                chance = (x["ones"] + 0.5) / (n + 1)
                node = x["of_key"][place[d]]
                seen = n[node] > 0
                estimate = np.where(one, chance[node], 1 - chance[node])
                # a node that no training text reached has no estimate and gets no weight
                mine = estimate if deeper is None else np.where(deeper, share[node] * estimate + (1 - share[node]) * p, estimate)
                p = np.where(seen, mine, p)
                deeper = seen
                if d:
                    below = np.bincount(x["above"], log, len(levels[d - 1]["ids"]))
            total += np.log10(p)
        return total


OPEN = "depth int, context long, node int, zeros double, ones double, log double"


def open_nodes(ranges: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(depth, context, node, zeros, ones, log) of contexts that reach over a border: partial counts summed over the ranges, from the deepest up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                n, keys, counts = (batch.column(i)[row].as_py() for i in range(3))
                for d, context, node, zeros, ones, children in ContextTree(unpacked(keys, n), unpacked(counts, n), depth).partial():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), d, np.int32)), pa.array(context), pa.array(node.astype(np.int32)), pa.array(zeros), pa.array(ones), pa.array(children)], ["depth", "context", "node", "zeros", "ones", "log"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.column(0).to_numpy()
            zeros, ones, children = (batch.column(i).to_numpy() for i in (3, 4, 5))
            own = log_estimate(zeros, ones)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(np.where(d == depth, own, log_weighted(own, children)))], batch.schema.names)

    partial = materialize(ranges.select("n", "keys", "counts").mapInArrow(run, OPEN), "lm-partial")
    levels, above = [], None
    for d in range(depth, -1, -1):
        rows = partial.where(F.col("depth") == d)
        rows = rows if above is None else rows.unionByName(above)
        rows = rows.groupBy("depth", "context", "node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "log")])
        levels.append(materialize(rows.mapInArrow(weigh, OPEN), "lm-open"))
        above = levels[-1].select(F.lit(d - 1).alias("depth"), F.shiftright("context", _BITS).alias("context"), "node", F.lit(0.0).alias("zeros"), F.lit(0.0).alias("ones"), "log")
    out = levels[0]
    for rows in levels[1:]:
        out = out.unionByName(rows)
    whole = materialize(out, "lm-open")
    discard(partial, *levels)
    return whole


REPLY = "chunk long, kind int, part int, payload binary"


def gram_replies(ranges: DataFrame, nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(chunk, 0, range, log10 probabilities of the chunk's grams in the range, in order)."""
    shifts = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(_BITS * (depth - d + 1)).alias("by")) for d in range(depth + 1)])
    asked = ranges.select("range", F.explode(shifts).alias("s"), "first", "last")
    asked = asked.select("range", F.col("s.d").alias("d"), F.explode(F.array_distinct(F.array(F.expr("shiftright(first, s.by)"), F.expr("shiftright(last, s.by)")))).alias("c"))
    # at most 2 * (depth + 1) contexts of 255 nodes for each range
    given = asked.join(small(nodes), (F.col("d") == F.col("depth")) & (F.col("c") == F.col("context"))).groupBy("range").agg(F.collect_list(F.struct("depth", "context", "node", "zeros", "ones", "log")).alias("nodes"))
    given = materialize(given.withColumnRenamed("range", "r"), "lm-given")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                known = {(x["depth"], x["context"], x["node"]): (x["zeros"], x["ones"], x["log"]) for x in row["nodes"] or []}
                logs = ContextTree(unpacked(row["keys"], row["n"]), unpacked(row["counts"], row["n"]), depth).log10(known)
                logs = logs[unpacked(row["places"], sum(row["sizes"]))]
                ends = np.cumsum(row["sizes"])
                payload = [logs[b - n : b].astype("<f8").tobytes() for n, b in zip(row["sizes"], ends, strict=True)]
                k = len(payload)
                yield pa.RecordBatch.from_arrays([pa.array(row["chunks"], pa.int64()), pa.array([0] * k, pa.int32()), pa.array([row["range"]] * k, pa.int32()), pa.array(payload, pa.binary())], ["chunk", "kind", "part", "payload"])

    rows = ranges.join(small(given), F.col("range") == F.col("r"), "left")
    return rows.select("range", "n", "keys", "counts", "chunks", "sizes", "places", "nodes").mapInArrow(run, REPLY)


def word_replies(chunks: DataFrame, share_requests: int = SHARE_REQUESTS) -> tuple[DataFrame, int, int]:
    """((chunk, 1, share, counts of the chunk's words in the share, in order), training tokens, distinct training tokens)."""
    asked = chunks.agg(F.sum("n_words")).first()[0] or 0
    shares = max(1, -(-asked // share_requests))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                chunk, n, words, counts = (batch.column(i)[row].as_py() for i in range(4))
                words, counts = _text_of(words).split(b" "), unpacked(counts, n)
                share = np.array([zlib.crc32(w) * shares >> 32 for w in words])
                cuts = np.concatenate(([0], np.flatnonzero(share[1:] != share[:-1]) + 1, [n])).tolist()
                slices = list(zip(cuts, cuts[1:], strict=False))
                yield pa.RecordBatch.from_arrays([pa.array([int(share[a]) for a, _ in slices], pa.int32()), pa.array([chunk] * len(slices), pa.int64()), pa.array([b" ".join(words[a:b]) for a, b in slices], pa.binary()), pa.array([packed(counts[a:b]) for a, b in slices], pa.binary())], ["share", "chunk", "words", "counts"])

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        total: dict[bytes, int] = {}
        asked = [w.split(b" ") for w in frame["words"]]
        for words, counts in zip(asked, frame["counts"], strict=True):
            for w, n in zip(words, unpacked(counts, len(words)).tolist(), strict=True):
                total[w] = total.get(w, 0) + n
        share = int(frame["share"].iloc[0])
        payload = [np.array([total[w] for w in words], "<i8").tobytes() for words in asked]
        sums = np.array([sum(total.values()), sum(n > 0 for n in total.values())], "<i8").tobytes()
        return pd.DataFrame({"chunk": [*frame["chunk"], -1], "kind": 1, "part": share, "payload": [*payload, sums]})

    dealt = chunks.select("chunk", "n_words", "words", "word_counts").mapInArrow(deal, "share int, chunk long, words binary, counts binary")
    replies = materialize(dealt.groupBy("share").applyInPandas(count, REPLY), "lm-words")
    # two numbers per share, little-endian longs; shares are summed by Spark
    byte = lambda at: lambda i: F.hex(F.substr("payload", i + 8 * at, F.lit(1)))
    number = lambda at: F.conv(F.array_join(F.transform(F.sequence(F.lit(8), F.lit(1), F.lit(-1)), byte(at)), ""), 16, 10).cast("long")
    sums = replies.where("chunk = -1").agg(F.sum(number(0)), F.sum(number(1))).first()
    return replies.where("chunk <> -1"), int(sums[0] or 0), int(sums[1] or 0)


SCORES = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held: int = HELD, depth: int = DEPTH, chunk_bytes: int = CHUNK_BYTES, range_requests: int = RANGE_REQUESTS, share_requests: int = SHARE_REQUESTS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Texts whose crc32 of the id leaves the held remainder are not learnt from; a null id is never
    held out. score is the context trees' log10 probability of the whole text with its end, base_score
    that of a smoothed unigram model of its tokens. Null and empty texts are an end alone; repeated rows
    count again in training and give repeated results; without training texts each bit costs one bit and
    base_score is 0; no rows give none. Other columns are ignored. depth is at most 6.
    """
    if not 0 < depth < 7:
        raise ValueError(f"depth must be from 1 to 6, not {depth}")
    doc_id = F.col(id_col).cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chunks = chunks_of(rows.withColumn("held", F.coalesce(fold("doc_id", folds) == held, F.lit(False))), depth, chunk_bytes)
    ranges = ranges_of(chunks, borders(chunks, range_requests))
    by_gram = gram_replies(ranges, open_nodes(ranges, depth), depth)
    by_word, tokens, distinct = word_replies(chunks, share_requests)

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row, right = left.iloc[0], right.sort_values(["kind", "part"])
        of = {kind: np.frombuffer(b"".join(right.loc[right["kind"] == kind, "payload"]), dtype) for kind, dtype in ((0, "<f8"), (1, "<i8"))}
        keys, logs = pd.Index(unpacked(row["keys"], int(row["n_keys"]))), of[0]
        base = np.log10((of[1] + 0.5) / (tokens + 0.5 * (distinct + 1)))
        known = of[1] > 0
        place = {w: i for i, w in enumerate(_text_of(row["words"]).split(b" "))}
        text, ends = _text_of(row["texts"]), np.cumsum(row["sizes"]).tolist()
        bodies = [text[e - n : e] for e, n in zip(ends, row["sizes"], strict=True)]
        out = []
        for a, b in parts(bodies):
            found, starts = grams(bodies[a:b], depth)
            chances = np.add.reduceat(logs[keys.get_indexer(found)], starts[:-1])
            for body, chance in zip(bodies[a:b], chances.tolist(), strict=True):
                words = words_of(body)
                at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
                out.append((len(at), int(known[at].sum()), float(base[at].sum()), chance))
        n, k, s, t = zip(*out, strict=True)
        return pd.DataFrame({"doc_id": row["doc_ids"], "held_out": row["held"], "n_tokens": n, "n_known": k, "train_tokens": tokens, "base_score": s, "score": t})

    replies = by_gram.unionByName(by_word)
    slim = chunks.select("chunk", "doc_ids", "held", "sizes", "texts", "n_keys", "keys", "words")
    return slim.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(score, SCORES).withColumn("doc_id", F.col("doc_id").cast("long"))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; odd rows as in score_documents."""
    return score_documents(table(spark, sf_dir, "documents"))
