"""Byte-level BPE encoding and decoding.

Each distinct piece of a batch is merged once. Pieces of like length form a matrix whose rows are
segment trees over the byte positions: a leaf holds the rank of the pair that starts there, an inner
node the leftmost minimum of its two children. One step merges the root's pair in every row that
still has one, and then updates the leaves of the merged token and of its live left neighbour, and
the merged-away leaf, each by one path to the root. Rows whose root holds no rank are done.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import table

#: Pieces kept per Python worker; beyond it the memory of pieces starts afresh.
CACHE_PIECES = 250_000
#: Bytes of the matrices of one merging step.
TREE_CELLS = 400_000
#: Bytes beyond which a piece is merged on its own, as few others share its length.
LONG_PIECE = 128

_NONE = np.int64(2**62)
#: A space between two visible characters: pieces never reach over it, nor look past it.
_JOINT = re.compile(r"(?<=\S) (?=\S)")
#: White space other than the space and the line feed.
_RARE_SPACE = re.compile("[\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _words(text: str) -> list[str]:
    """text cut at spaces between two visible characters."""
    if "  " in text or "\n " in text or " \n" in text or text[:1].isspace() or text[-1:].isspace() or _RARE_SPACE.search(text):
        return _JOINT.split(text)
    return text.split(" ")


class ByteBPE:
    """Encoder and decoder for one rank file (base64 token and rank per line) and split pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
        self.ranks = {token: rank for rank, token in self.tokens.items()}
        # white space as in Unicode, not as in Python's own classes
        self.split = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
        size = max(self.tokens, default=-1) + 1
        self.lengths = np.zeros(size, np.int64)
        for rank, token in self.tokens.items():
            self.lengths[rank] = len(token)
        self.begins = np.concatenate(([0], np.cumsum(self.lengths)))[:-1] if size else np.zeros(0, np.int64)
        self.bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(size)), np.uint8)
        self.single = np.full(256, -1, np.int64)
        for b in range(256):
            self.single[b] = self.ranks.get(bytes([b]), -1)
        # the pair of ids (left, right) that a rank is merged from, as sorted keys: every split of the
        # token into two tokens names the same rank
        keys, values = [], []
        for token, rank in self.ranks.items():
            for at in range(1, len(token)):
                left, right = self.ranks.get(token[:at]), self.ranks.get(token[at:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.pair_keys = np.array(keys, np.int64)[order]
        self.pair_ranks = np.array(values, np.int64)[order]
        self.pair_table: dict[int, int] = {}
        self.spaced: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        if not len(self.pair_keys):
            return np.full(key.shape, _NONE)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.pair_keys[at] == key), self.pair_ranks[at], _NONE)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            elif piece:
                by_width.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for width, group in by_width.items():
            if width > LONG_PIECE:
                for i in group:
                    out[i] = self._merge_long(pieces[i], width)
                continue
            rows = max(1, TREE_CELLS // width)
            for at in range(0, len(group), rows):
                part = group[at : at + rows]
                for i, ids in zip(part, self._merge_rows([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _merge_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        n = len(pieces)
        size = np.array([len(p) for p in pieces], np.int64)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        live = np.arange(width) < size[:, None]
        ids = np.where(live, self.single[raw], -1)
        if (live & (ids < 0)).any():
            raise ValueError("the vocabulary lacks a single byte that a text has")
        after = np.tile(np.arange(1, width + 1), (n, 1))  # next live position
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        # tree[:, width + p] is the leaf of position p, as rank * width + p: the minimum is also the leftmost
        tree = np.full((n, 2 * width), _NONE)
        if width > 1:
            tree[:, width : 2 * width - 1] = self._leaf(ids[:, :-1], ids[:, 1:], np.arange(width - 1)[None, :], width)
        level = width
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while len(rows):
            best = tree[rows, 1]
            at, rank = best % width, best // width
            gone = after[rows, at]
            far = after[rows, gone]
            ids[rows, at] = rank
            ids[rows, gone] = -1
            after[rows, at] = far
            has = far < size[rows]
            before[rows[has], far[has]] = at[has]
            near = before[rows, at]
            self._update(tree, rows, gone, np.full(len(rows), _NONE), width)
            right = np.where(has, ids[rows, np.where(has, far, 0)], -1)
            self._update(tree, rows, at, self._leaf(rank, right, at, width), width)
            some = near >= 0
            r, p = rows[some], near[some]
            self._update(tree, r, p, self._leaf(ids[r, p], rank[some], p, width), width)
            rows = rows[tree[rows, 1] < _NONE]
        flat = ids[ids >= 0].astype("<u4").tobytes()
        ends = 4 * np.cumsum((ids >= 0).sum(1))
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _merge_long(self, piece: bytes, width: int) -> bytes:
        """One long piece with a tree of its own: every merge costs three paths to the root."""
        if not self.pair_table:
            self.pair_table = dict(zip(self.pair_keys.tolist(), self.pair_ranks.tolist(), strict=True))
        n, none, pairs = len(piece), int(_NONE), self.pair_table
        first = self.single[np.frombuffer(piece, np.uint8)]
        if (first < 0).any():
            raise ValueError("the vocabulary lacks a single byte that a text has")
        leaves = np.full(2 * width, _NONE)
        leaves[width : width + n - 1] = self._leaf(first[:-1], first[1:], np.arange(n - 1), width)
        level = width
        while level > 1:
            leaves[level // 2 : level] = np.minimum(leaves[level : 2 * level : 2], leaves[level + 1 : 2 * level : 2])
            level //= 2
        tree, ids = leaves.tolist(), first.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def update(node: int, leaf: int) -> None:
            tree[node] = leaf
            node >>= 1
            while node:
                left, right = tree[2 * node], tree[2 * node + 1]
                least = left if left < right else right
                if tree[node] == least:
                    return
                tree[node] = least
                node >>= 1

        while tree[1] < none:
            rank, at = divmod(tree[1], width)
            gone = after[at]
            far, near = after[gone], before[at]
            ids[at], ids[gone], after[at] = rank, -1, far
            if far < n:
                before[far] = at
            update(width + gone, none)
            found = pairs.get(rank << 32 | ids[far]) if far < n else None
            update(width + at, none if found is None else found * width + at)
            if near >= 0:
                found = pairs.get(ids[near] << 32 | rank)
                update(width + near, none if found is None else found * width + near)
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def _leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        rank = self.pair_rank(left, right)
        return np.where(rank < _NONE, rank * width + at, _NONE)

    @staticmethod
    def _update(tree: np.ndarray, rows: np.ndarray, at: np.ndarray, leaf: np.ndarray, width: int) -> None:
        node = at + width
        tree[rows, node] = leaf
        while width > 1:
            width //= 2
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def _learn(self, memo: dict[str, bytes], found: set[str], lead: str) -> None:
        """Fill memo for words that follow a space (lead) or open a text."""
        if len(memo) + len(found) > CACHE_PIECES:
            memo.clear()
        cut = {word: [lead + word] if word.isalpha() else self.split.findall(lead + word) for word in found}
        fresh = list(set().union(*cut.values()).difference(self.pieces))
        if len(self.pieces) + len(fresh) > CACHE_PIECES:
            self.pieces.clear()
            fresh = list(set().union(*cut.values()))
        self.pieces.update(zip(fresh, self.merge([p.encode() for p in fresh]), strict=True))
        known = self.pieces
        for word, parts in cut.items():
            memo[word] = known[parts[0]] if len(parts) == 1 else b"".join([known[p] for p in parts])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        words = [_words(t) for t in texts]
        firsts, rest = {w[0] for w in words}, set()
        for w in words:
            rest.update(w[1:])
        self._learn(self.bare, firsts if len(self.bare) + len(firsts) > CACHE_PIECES else firsts.difference(self.bare), "")
        missing = rest.difference(self.spaced)
        self._learn(self.spaced, rest if len(self.spaced) + len(missing) > CACHE_PIECES else missing, " ")
        spaced, bare = self.spaced, self.bare
        return [bare[w[0]] + b"".join([spaced[x] for x in w[1:]]) for w in words]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the ids, looked up token by token."""
        ranks = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(ranks):
            return b""
        size = self.lengths[ranks]
        ends = np.cumsum(size)
        source = np.repeat(self.begins[ranks] - (ends - size), size) + np.arange(ends[-1])
        return self.bytes[source].tobytes()


_loaded: dict[tuple[str, str], ByteBPE] = {}


def tokenizer(path: str, pattern: str) -> ByteBPE:
    """One per Python worker and vocabulary."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBPE(path, pattern)
    return _loaded[path, pattern]


def _groups(batch: pa.RecordBatch, most: int = 1_500_000) -> Iterator[tuple[int, list[str]]]:
    """Rows of a batch in groups of bounded text; nulls are empty."""
    group, chars, first = [], 0, 0
    for i, value in enumerate(batch.column(1)):
        text = value.as_py() or ""
        if group and chars + len(text) > most:
            yield first, group
            group, chars, first = [], 0, i
        group.append(text)
        chars += len(text)
    if group:
        yield first, group


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for every row; null and empty texts give an empty list, whole texts are encoded.

    Repeated rows give repeated results; no rows give none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            for first, texts in _groups(batch):
                ids = [np.frombuffer(x, "<u4") for x in bpe.encode_batch(texts)]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) to (doc_id, bytes binary); a null list decodes to no bytes; no rows give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            out = [bpe.decode(np.array(x.as_py() or [], "<u4").tobytes()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def encode_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_bytes, ids_sha256, decoded_sha256 of each row, encoded and decoded again in one pass.

    The digests are of the ids as little-endian unsigned 32-bit integers and of the decoded bytes.
    Null texts count as empty; repeated rows give repeated results; no rows give none; other columns
    are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            for first, texts in _groups(batch):
                ids = bpe.encode_batch(texts)
                back = [bpe.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(texts)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([len(x) for x in back], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                ], ["doc_id", "n_tokens", "n_bytes", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_bytes long, ids_sha256 string, decoded_sha256 string")


def public_vocabulary() -> tuple[str, str]:
    """Path of the rank file and the split pattern that come with the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encode_digests of documents with the public byte-level vocabulary."""
    return encode_digests(table(spark, sf_dir, "documents"), *public_vocabulary())
