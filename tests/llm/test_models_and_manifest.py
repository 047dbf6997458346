"""Spelling variants, context-tree scores and the Merkle manifest against plain code."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from quillspark.llm import context_tree, merkle, spelling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, n int, tree int, chunk long, position long"


def docs_of(spark, rows):
    """(doc_id, text, source) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "w", 1, 2, 3, 4) for i, t, s in rows], SCHEMA)


def texts(seed, n, letters="abcdeé", longest=10):
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(5, longest))) for _ in range(60)]

    def spelt(w):
        if rng.random() < 0.7:
            return w
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:]])

    return [(i, " ".join(spelt(rng.choice(words)).title() for _ in range(rng.randint(0, 120))), rng.choice(["a", "b", None])) for i in range(n)]


ODD = [(None, "Nothing abcdefgh", None), (900, None, "a"), (901, "", "b"), (902, " \t\n", None), (903, "abcdefgh abcdefgi", "b"), (903, "abcdefgh abcdefgi", "b"), (904, "x" * 3000 + " " + "x" * 2999 + "y " + "x" * 3000 + " " + "x" * 2999 + "y", "c")]


# spelling variants


def plain_words(rows):
    n = Counter()
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n, times=10):
    form, close = {}, {}
    for w in n:
        found = [v for v in n if near(w, v)]
        close[w] = len(found)
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], close[w], None if form[w] is None else n[form[w]]))
    return out


@pytest.mark.parametrize("filter_bytes", [spelling.FILTER_BYTES, 1])
def test_spelling_variants_against_all_pairs(spark, monkeypatch, filter_bytes):
    monkeypatch.setattr(spelling, "EDITS", 64)
    monkeypatch.setattr(spelling, "LETTERS", 500)
    rows = texts(1, 150) + ODD
    rows += [(2000 + i, "commonword", "a") for i in range(400)] + [(3000 + i, "comonword", "a") for i in range(31)] + [(4000 + i, "comonworc", "a") for i in range(3)]
    words = spelling.vocabulary(docs_of(spark, rows))
    n = plain_words(rows)
    assert {r.word: r.n for r in words.collect()} == n
    got = [tuple(r) for r in spelling.variant_groups(words, filter_bytes=filter_bytes).collect()]
    want = plain_variants(n)
    assert len(got) == len(want) and set(got) == want
    assert any(r[1] and r[2] != r[1] for r in want)  # a chain of forms


def test_spelling_filters_in_parts(spark, monkeypatch):
    """Segments of two blocks: each pass has a part of a length's filter, and all passes together find every pair."""
    monkeypatch.setattr(spelling, "SEGMENT", 2)
    rng = random.Random(5)
    words = list({"".join(rng.choice("abc") for _ in range(rng.randint(7, 8))) for _ in range(700)})
    parts = spelling._passes({7: 5, 8: 3}, 2 * 64)
    assert [[p[:3] for p in group] for group in parts] == [[(7, 0, 2)], [(7, 2, 4)], [(7, 4, 5)], [(8, 0, 2)], [(8, 2, 3)]]
    got = spelling.near_pairs(spark.createDataFrame([(w, 2) for w in words], "word string, n long"), filter_bytes=3 * 64)
    want = {frozenset((a, b)) for a in words for b in words if near(a, b)}
    rows = got.collect()
    assert len(rows) == len(want) and {frozenset((r.a, r.b)) for r in rows} == want


def test_spelling_of_nothing(spark):
    empty = docs_of(spark, [(1, None, "a"), (2, "short words", "b")])
    assert spelling.variant_groups(spelling.vocabulary(empty)).collect() == []
    assert spelling.variant_groups(spelling.vocabulary(empty.limit(0))).collect() == []


def test_crc32_in_sql():
    text = "17:éaÿ x"
    sql = f"SELECT {spelling.crc32_sql('w')} FROM (SELECT {spelling.CRC_TABLE_SQL} AS t) t, (SELECT $1 AS w)"
    assert duckdb.execute(sql, [text]).fetchone()[0] == zlib.crc32(text.encode())


# context-tree weighting


def plain_model(rows, depth):
    """Counts of every node, and P of the context trees by recursion from the whole training data."""
    counts, below = defaultdict(lambda: [0, 0]), defaultdict(set)
    for i, text, _ in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 5 == 1:
            continue
        body = b"\n" * depth + context_tree.plain(text)
        for p in range(depth, len(body)):
            for d in range(depth + 1):
                context = body[p - d : p]
                for bit in range(8):
                    counts[context, (1 << bit) + (body[p] >> (8 - bit))][body[p] >> (7 - bit) & 1] += 1
                    if d:
                        below[context[1:], (1 << bit) + (body[p] >> (8 - bit))].add(context)
    estimate = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    weighted = {}
    for d in range(depth, -1, -1):
        for (context, node), (a, b) in counts.items():
            if len(context) == d:
                own = estimate(a, b)
                children = sum(weighted[c, node] for c in below[context, node])
                weighted[context, node] = own if d == depth else np.logaddexp(math.log(0.5) + own, math.log(0.5) + children)

    def chance(history, byte):
        total = 0.0
        for bit in range(8):
            node, one = (1 << bit) + (byte >> (8 - bit)), byte >> (7 - bit) & 1
            p, deeper = 0.5, False
            for d in range(depth, -1, -1):
                key = (history[len(history) - d :], node)
                if key in counts:
                    a, b = counts[key]
                    kt = ((b if one else a) + 0.5) / (a + b + 1)
                    share = math.exp(math.log(0.5) + estimate(a, b) - weighted[key]) if d < depth else 1.0
                    p = share * kt + (1 - share) * p if deeper else kt
                    deeper = True
            total += math.log10(p)
        return total

    return chance


@pytest.mark.parametrize(("depth", "chunk_bytes", "requests"), [(5, 1 << 20, 1 << 19), (5, 700, 97), (2, 300, 40)])
def test_scores_against_recursive_trees(spark, depth, chunk_bytes, requests):
    rows = texts(2, 40) + ODD[:-1]
    got = context_tree.score_documents(docs_of(spark, rows), depth=depth, chunk_bytes=chunk_bytes, range_requests=requests, share_requests=50).collect()
    assert len(got) == len(rows)
    chance = plain_model(rows, depth)
    tokens = Counter(w for i, t, _ in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1 for w in context_tree.words_of(context_tree.plain(t)))
    n, v = sum(tokens.values()), len(tokens)
    found = defaultdict(list)
    for r in got:
        found[r.doc_id].append(r)
    for i, text, _ in rows:
        body = b"\n" * depth + context_tree.plain(text)
        words = context_tree.words_of(context_tree.plain(text))
        for r in found[i]:
            assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 1)
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(tokens[w] > 0 for w in words), n)
            assert r.base_score == pytest.approx(sum(math.log10((tokens[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words))
            assert r.score == pytest.approx(sum(chance(body[p - depth : p], body[p]) for p in range(depth, len(body))), rel=1e-8)


def test_chances_of_a_byte_sum_to_one():
    """After any context, seen or not, the 256 next bytes share one."""
    keys, starts = context_tree.grams([b"the cat and the cap\n", b"\xff\xfe the\n"])
    seen, n = context_tree.summed(keys, np.ones(len(keys), np.int64))
    for context in (int(keys[5]) >> 8, int(keys[5]) >> 16 << 8 | 1, 0):
        every = context << 8 | np.arange(256)
        k, c = context_tree.summed(np.concatenate((seen, every)), np.concatenate((n, np.zeros(256, np.int64))))
        tree = context_tree.ContextTree(k, c)
        # in one range every context is open: its own totals stand for those of all ranges
        known, sums = {}, {}
        for depth in range(5, -1, -1):
            for d, contexts, nodes, zeros, ones, children in tree.partial():
                if d == depth:
                    for x in zip(contexts.tolist(), nodes.tolist(), zeros, ones, children, strict=True):
                        own = float(context_tree.log_estimate(np.array(x[2]), np.array(x[3])))
                        log = own if d == 5 else float(context_tree.log_weighted(own, x[4] + sums.get((d, x[0], x[1]), 0.0)))
                        known[d, x[0], x[1]] = (x[2], x[3], log)
                        up = (d - 1, x[0] >> 8, x[1])
                        sums[up] = sums.get(up, 0.0) + log
        logs = tree.log10(known)
        assert (10 ** logs[np.searchsorted(k, every)]).sum() == pytest.approx(1)


def test_a_text_with_a_known_twin_costs_less(spark):
    rng = random.Random(8)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(30))
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1]
    known, other = line(), line()
    rows = [(i, known if i in held[:1] else other if i in held[1:2] else known if i % 7 == 0 else line(), "a") for i in range(100)]
    got = {r.doc_id: r.score for r in context_tree.score_documents(docs_of(spark, rows)).collect()}
    assert got[held[0]] > 0.5 * got[held[1]]


def test_scores_without_training_or_rows(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    got = context_tree.score_documents(docs_of(spark, [(i, "ab c", "a") for i in held])).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, 0.0)] * 3
    assert all(r.score == pytest.approx(5 * 8 * math.log10(0.5)) for r in got)
    assert context_tree.score_documents(docs_of(spark, []).limit(0)).collect() == []
    with pytest.raises(ValueError):
        context_tree.score_documents(docs_of(spark, []), depth=7)


# Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    """Levels from the leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_manifest(rows):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda i, t, s, n: h(field(i), field(s), field("en"), field(n), field(t))
    every = []
    for i, t, s in rows:
        n = None if t is None else len(t)
        bad = t if t is None or i is None or zlib.crc32(str(i).encode()) % 2 else t.replace("\n", "")
        every.append((s, i, leaf(i, t, s, n), leaf(i, bad, s, n)))
    every.sort(key=lambda x: ((x[0] is not None, (x[0] or "").encode()), (x[1] is not None, x[1] or 0), x[2:]))
    sources = list(dict.fromkeys(x[0] for x in every))
    trees = {s: plain_tree([x[2] for x in every if x[0] == s]) for s in sources}
    top = plain_tree([trees[s][-1][0] for s in sources])
    out, seen = [], Counter()
    for s, i, own, claimed in every:
        steps = [(trees[s], seen[s]), (top, sources.index(s))]
        seen[s] += 1
        fold, proof = claimed, ""
        for levels, at in steps:
            for level in levels[:-1]:
                run = level[at // 3 * 3 : at // 3 * 3 + 3]
                proof += "".join(x for j, x in enumerate(run) if j != at % 3)
                run[at % 3] = fold
                fold, at = h(*run), at // 3
        root = top[-1][0]
        out.append((i, own, trees[s][-1][0], root, h(proof), fold, fold == root))
    return out


@pytest.mark.parametrize("block_height", [1, 2, 6])
def test_manifest_against_plain_trees(spark, block_height):
    rng = random.Random(block_height)
    rows = ODD[:-1] + [(i, rng.choice(["a\nb", "plain", None, "é\n", "\n"]), f"s{rng.choice([0, 0, 0, 0, 1, 2, 3, 40, 50, 6, 7, 8, 9])}") for i in range(180)] + [(500, "last\n", "z")]
    got = [tuple(r) for r in merkle.document_manifest(docs_of(spark, rows), block_height).verify().collect()]
    want = plain_manifest(rows)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[-1] for r in want} == {True, False}


def test_manifest_of_one_row_and_of_none(spark):
    got = merkle.document_manifest(docs_of(spark, [(7, "x", None)])).verify().collect()
    assert [tuple(r) for r in got] == plain_manifest([(7, "x", None)])
    assert got[0].root == got[0].leaf and got[0].proof_sha256 == h("")
    empty = merkle.document_manifest(docs_of(spark, []).limit(0))
    assert empty.root is None and empty.verify().collect() == []


def test_layout_is_recursive_halving():
    for height in range(7):
        places = merkle.addresses(height)
        assert sorted(np.concatenate(places).tolist()) == list(range(merkle.tree_size(height)))
        for depth, row in enumerate(places):
            assert [merkle.address(depth, i, height) for i in range(len(row))] == row.tolist()
    # four levels: the upper two, then nine lower subtrees of two levels
    assert [p.tolist()[:4] for p in merkle.addresses(3)] == [[0], [1, 2, 3], [4, 8, 12, 16], [5, 6, 7, 9]]


def test_manifest_sql(tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a\nb", None, "é\n", ""]), rng.choice(["a", "b", "é", None])) for i in range(60)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, 'en', ?, ?)", [(i, t, s, None if t is None else len(t)) for i, t, s in rows])
    got = con.execute(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({merkle.OP13_SQL})").fetchall()
    assert sorted(got) == sorted(plain_manifest(rows))
