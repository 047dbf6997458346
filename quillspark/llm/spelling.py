"""Spelling variants: words that differ by one inserted, deleted or replaced code point, and the form that each goes with.

The vocabulary's words go into blocked Bloom filters, sharded by word length. Each word's edits are
made and probed in the tasks that hold the word: deletions against the filter of the length below,
replacements by a larger letter against the filter of its own length, so that every near pair is made
once. Only positives are shuffled, as pairs of 64-bit hashes, and meet the vocabulary in an exact join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import discard, materialize, table

# fixed values: what a word is, which occurrences lose a letter, and when a near word is a form
RUN = "[A-Za-zÀ-ÿ]+"
DROPPED = 31
LEAST_CHARS, LEAST_COUNT, TIMES = 7, 2, 10

#: A block is WORDS words of 64 bits; a key sets two bits in each of PROBES of them.
WORDS, PROBES, BITS_PER_KEY = 8, 3, 16
#: Blocks that one task fills at a time: 64 KB.
SEGMENT = 1024
#: Bytes of filters that are broadcast at once; larger filters are probed in several passes.
FILTER_BYTES = 32_000_000
#: Edits made at once in a task, and letters of the words whose edits are made, some 100 bytes each.
EDITS, LETTERS = 1 << 19, 1 << 17

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_32 = np.uint64(32)


def mixed(h: np.ndarray) -> np.ndarray:
    x = (h ^ (h >> _32)) * _MIX
    x = (x ^ (x >> _32)) * _MIX
    return x ^ (x >> _32)


class Letters:
    """Words of a batch as one run of code points with what their edits' hashes need.

    The hash of a word of n letters is the sum of letter i times BASE ** (n - 1 - i), modulo 2 ** 64.
    """

    def __init__(self, words: list[str]):
        raw = [w.encode("latin-1") for w in words]
        self.size = np.array([len(r) for r in raw], np.int64)
        self.codes = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        self.word = np.repeat(np.arange(len(raw)), self.size)
        self.at = np.arange(len(self.codes)) - self.start[self.word]
        powers = np.full(int(self.size.max(initial=1)), _BASE)
        powers[0] = 1
        self.weight = np.multiply.accumulate(powers)[self.size[self.word] - 1 - self.at]
        self.term = self.codes * self.weight
        self.before = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.term, dtype=np.uint64)))
        self.hash = self.before[self.end] - self.before[self.start]

    def deletions(self) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes): of equal neighbouring letters the first goes, which gives each result once."""
        same = np.zeros(len(self.codes), bool)
        same[1:] = self.codes[1:] == self.codes[:-1]
        places = np.flatnonzero(~(same & (self.at > 0)))
        word = self.word[places]
        left = self.before[places] - self.before[self.start[word]]
        return places, left * _INVERSE + (self.hash[word] - left - self.term[places])

    def replacements(self, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places, letters, hashes) with every larger letter of the alphabet, in parts of bounded size."""
        order = np.argsort(self.codes, kind="stable")
        letters, first = np.unique(self.codes[order], return_index=True)
        for letter, a, b in zip(letters, first, [*first[1:], len(order)], strict=True):
            larger = alphabet[alphabet > letter]
            if not len(larger):
                continue
            step = max(1, EDITS // len(larger))
            for at in range(a, b, step):
                places = order[at : min(b, at + step)]
                hashes = self.hash[self.word[places]][:, None] + (larger - letter)[None, :] * self.weight[places][:, None]
                yield np.repeat(places, len(larger)), np.tile(larger, len(places)), hashes.reshape(-1)


def block_of(x: np.ndarray, n_blocks: np.ndarray | int) -> np.ndarray:
    return ((x >> _32) * np.asarray(n_blocks, np.uint64) >> _32).astype(np.int64)


def _probe(x: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Which word of its block the i-th probe of a mixed hash reads, and the two bits it wants there."""
    y = x * np.uint64(2 * i + 3) ^ (x >> np.uint64(17 + i))
    one = np.uint64(1)
    word = ((y >> np.uint64(13)) & np.uint64(WORDS - 1)).astype(np.int64)
    return word, one << ((y >> np.uint64(20)) & np.uint64(63)) | one << ((y >> np.uint64(40)) & np.uint64(63))


class LengthFilters:
    """Block ranges of the filters of several lengths in one array; parts: (length, first block, end block, blocks of the length, offset)."""

    def __init__(self, parts: list[tuple[int, int, int, int]], segments: dict[tuple[int, int], bytes]):
        longest = max(p[0] for p in parts)
        self.low, self.high, self.total, self.offset = (np.zeros(longest + 2, np.int64) for _ in range(4))
        at = 0
        for length, low, high, total in parts:
            self.low[length], self.high[length], self.total[length], self.offset[length] = low, high, total, at - low
            at += high - low
        self.bits = np.zeros(at * WORDS, np.uint64)
        for (length, segment), raw in segments.items():
            first = (segment * SEGMENT + self.offset[length]) * WORDS
            self.bits[first : first + len(raw) // 8] = np.frombuffer(raw, np.uint64)

    def holds(self, length: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Places of those that may be in the filters; lengths without a filter hold nothing."""
        length = np.minimum(length, len(self.low) - 1)
        x = mixed(hashes)
        block = block_of(x, self.total[length])
        found = np.flatnonzero((block >= self.low[length]) & (block < self.high[length]))
        at = (block[found] + self.offset[length[found]]) * WORDS
        for i in range(PROBES):
            word, mask = _probe(x[found], i)
            good = (self.bits[at + word] & mask) == mask
            found, at = found[good], at[good]
        return found


def lower_az(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def vocabulary(docs: DataFrame, dropped: int = DROPPED, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): runs of letters of whole texts after the deletions, counted per task before the shuffle. Null texts have none."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RUN), F.lit(0))).alias("run")).select("doc_id", lower_az(F.col("run")).alias("run"))
    # a run that is too short for a deletion to leave a word goes first; a null id draws nothing
    runs = runs.where(F.length("run") >= least_chars)
    draw = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    at = (draw % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(draw % dropped == 0, cut).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).where(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def with_hashes(words: DataFrame) -> DataFrame:
    """(word, n) with length and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = Letters(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(letters.size.astype(np.int32)), pa.array(letters.hash.view(np.int64))], ["word", "n", "length", "hash"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, length int, hash long")


def _segments(hashed: DataFrame, blocks: dict[int, int]) -> DataFrame:
    """(length, segment, bits): each segment of a length's filter is filled by one task from its own words, as many as fit its bits."""
    shared = hashed.sparkSession.sparkContext.broadcast(blocks)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(max(shared.value) + 1, np.int64)
        for length, n in shared.value.items():
            total[length] = n
        for batch in batches:
            length, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((block_of(mixed(hashes), total[length]) // SEGMENT).astype(np.int32)), batch.column(1)], ["length", "segment", "hash"])

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        length, segment = int(frame["length"].iloc[0]), int(frame["segment"].iloc[0])
        x = mixed(frame["hash"].to_numpy(np.int64).view(np.uint64))
        bits = np.zeros(min(SEGMENT, shared.value[length] - segment * SEGMENT) * WORDS, np.uint64)
        at = (block_of(x, shared.value[length]) - segment * SEGMENT) * WORDS
        for i in range(PROBES):
            word, mask = _probe(x, i)
            np.bitwise_or.at(bits, at + word, mask)
        return pd.DataFrame([(length, segment, bits.tobytes())], columns=["length", "segment", "bits"])

    placed = hashed.select("length", "hash").mapInArrow(place, "length int, segment int, hash long")
    return placed.groupBy("length", "segment").applyInPandas(fill, "length int, segment int, bits binary")


def _passes(blocks: dict[int, int], most: int) -> list[list[tuple[int, int, int, int]]]:
    """Ranges of blocks, cut at segments, in groups of at most that many bytes (one segment at least)."""
    out, room = [], 0
    for length, total in sorted(blocks.items()):
        low = 0
        while low < total:
            if room < min(SEGMENT, total - low):
                out.append([])
                room = max(SEGMENT, most // (8 * WORDS) // SEGMENT * SEGMENT)
            high = min(total, low + room if low + room >= total else low + room // SEGMENT * SEGMENT)
            out[-1].append((length, low, high, total))
            room -= high - low
            low = high
    return out


def near_pairs(words: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(a, b, n_a, n_b) once for each pair of different words one code point apart, of distinct (word, n) over code points below 256.

    Long words count whole: what a word's edits cost grows with its length, and their hashes alone travel.
    Where the filters exceed filter_bytes, as many passes probe parts of at most that size.
    """
    hashed = materialize(with_hashes(words), "vocabulary")
    sizes = hashed.groupBy("length").count().collect()  # one row per word length
    blocks = {r["length"]: max(1, -(-r["count"] * BITS_PER_KEY // (64 * WORDS))) for r in sizes}
    spark = hashed.sparkSession
    letters = sorted({c for r in hashed.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().collect() for c in r["c"]})
    alphabet = np.array([ord(c) for c in letters], np.uint64)
    filters = materialize(_segments(hashed, blocks), "filters") if blocks else None
    schema, found = "hash long, near long, at int, letter string", []
    for parts in _passes(blocks, filter_bytes):
        inside = [(F.col("length") == p[0]) & (F.col("segment") >= p[1] // SEGMENT) & (F.col("segment") * SEGMENT < p[2]) for p in parts]
        got = {(r["length"], r["segment"]): bytes(r["bits"]) for r in filters.where(reduce(lambda a, b: a | b, inside)).collect()}
        # at most filter_bytes of bits (a segment at least), whatever the vocabulary
        shared = spark.sparkContext.broadcast(LengthFilters(parts, got))
        lengths = sorted({p[0] for p in parts} | {p[0] + 1 for p in parts})

        def probe(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            bloom = shared.value

            def out(x: Letters, places: np.ndarray, near: np.ndarray, letter: pa.Array) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(x.hash[x.word[places]].view(np.int64)), pa.array(near.view(np.int64)), pa.array(x.at[places].astype(np.int32)), letter], ["hash", "near", "at", "letter"])

            for batch in batches:
                every = batch.column(0).to_pylist()
                part = np.cumsum([len(w) for w in every]) // LETTERS
                for n in np.unique(part):
                    x = Letters([every[i] for i in np.flatnonzero(part == n)])
                    places, near = x.deletions()
                    good = bloom.holds(x.size[x.word[places]] - 1, near)
                    yield out(x, places[good], near[good], pa.array([""] * len(good), pa.string()))
                    for places, letter, near in x.replacements(alphabet):
                        good = bloom.holds(x.size[x.word[places]], near)
                        yield out(x, places[good], near[good], pa.array([chr(c) for c in letter[good]], pa.string()))

        found.append(hashed.where(F.col("length").isin(lengths)).select("word").mapInArrow(probe, schema))
    if not found:
        return hashed.select(F.col("word").alias("a"), F.col("word").alias("b"), F.col("n").alias("n_a"), F.col("n").alias("n_b")).limit(0)
    positives = reduce(DataFrame.unionByName, found)
    right = hashed.select(F.col("hash").alias("near"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    left = hashed.select("hash", F.col("word").alias("a"), F.col("n").alias("n_a"))
    # words whose hashes meet by chance go here: the edit itself must give the other word
    edited = F.concat(F.substr("a", F.lit(1), F.col("at")), "letter", F.substr("a", F.col("at") + 2))
    return positives.join(right, "near").join(left, "hash").where(edited == F.col("b")).select("a", "b", "n_a", "n_b")


def variant_groups(words: DataFrame, times: int = TIMES, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """word, form, root, n, n_near, form_n of distinct (word, n).

    A word's form is its near word of largest n, of equal ones the smallest in code-point order, if
    that n is at least times its own; root is the last word on the way of forms. Counts grow by that
    factor at each step, so there are no cycles and doubling ends after a few rounds. No words give no rows.
    """
    words = materialize(words.select("word", "n"), "words")
    pairs = materialize(near_pairs(words, filter_bytes), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    rows = words.join(best, "word", "left")
    strong = -F.col("best.m") >= times * F.col("n")
    rows = materialize(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.m")).alias("form_n")), "forms")
    discard(words, pairs)
    jumps = materialize(rows.where("form is not null").select("word", F.col("form").alias("root")), "jumps")
    while True:
        ahead = jumps.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        new = materialize(jumps.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "jumps")
        discard(jumps)
        jumps = new
        if jumps.where("moved").isEmpty():
            break
    return rows.join(jumps.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant groups of the words of whole documents.

    Null and empty texts have no words, a null doc_id deletes nothing, repeated rows count again, other
    columns are ignored; an empty table gives no rows. Ties of counts go to the smallest word.
    """
    return variant_groups(vocabulary(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))))


# crc32 of UTF-8 bytes: the table of the reflected polynomial, then one step a byte
CRC_TABLE_SQL = "list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n))"


def crc32_sql(text: str, crc_table: str = "t.t") -> str:
    """DuckDB for the unsigned crc32 of a text; crc_table is a column with CRC_TABLE_SQL."""
    bytes_of = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::bigint)"
    return f"xor(list_reduce({bytes_of}, lambda c, b: xor(c // 256, {crc_table}[xor(c % 256, b) + 1]), 4294967295), 4294967295)"


OP11_SQL = f"""
WITH RECURSIVE t AS (SELECT {CRC_TABLE_SQL} AS t),
runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
         FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{RUN}')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
drawn AS (SELECT run, n, {crc32_sql("(doc_id || ':' || run)")} AS h FROM runs, t),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) ELSE run END AS word, n FROM drawn),
v AS MATERIALIZED (SELECT word, sum(n)::bigint AS n FROM cut WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
holes AS MATERIALIZED (SELECT word, i, left(word, i - 1) || '*' || substr(word, i + 1) AS hole, left(word, i - 1) || substr(word, i + 1) AS rest
                       FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
pairs AS (SELECT a.word AS a, b.word AS b FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word
          UNION SELECT h.word, v.word FROM holes h JOIN v ON h.rest = v.word UNION SELECT v.word, h.word FROM holes h JOIN v ON h.rest = v.word),
best AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY v.n DESC, encode(b)) AS near, max(v.n) AS near_n FROM pairs JOIN v ON v.word = b GROUP BY a),
forms AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * v.n THEN near END AS form, CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n FROM v LEFT JOIN best USING (word)),
way(word, spot, step) AS (SELECT word, word, 0 FROM forms UNION ALL SELECT w.word, f.form, w.step + 1 FROM way w JOIN forms f ON f.word = w.spot WHERE f.form IS NOT NULL)
SELECT word, form, (SELECT arg_max(spot, step) FROM way w WHERE w.word = forms.word) AS root, n, n_near, form_n FROM forms
"""
