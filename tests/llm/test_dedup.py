import os
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from quillspark.llm import exact_dedup, line_dedup, mixing, near_dedup

ODD = [(100, None, "b"), (101, "", None), (102, " \t\n", "a"), (103, "one two", "a"), (103, "one two", "a"), (104, "ONE  two", None), (None, "one two", "a")]


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, source string, rep string, value int, copies int")


def near_copies(seed=3, groups=12, copies=6):
    rng = random.Random(seed)
    rows, i = [], 0
    for _ in range(groups):
        words = [rng.choice("abcdefghij") * rng.randint(1, 3) + str(rng.randint(0, 60)) for _ in range(rng.choice([3, 20, 60, 400]))]
        for _ in range(copies):
            own = [w if rng.random() > rng.choice([0, 0.01, 0.05]) else w + "x" for w in words]
            rows.append((i, " ".join(own), "s"))
            i += 1
    return rows


def brute_components(rows):
    tab = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, text, _ in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(tab))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if i is not None)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_match_brute_force(spark):
    rows = near_copies() + [r for r in ODD if r[0] is not None]
    for k in (16, near_dedup.SKETCH):
        got = near_dedup.near_duplicates(docs_of(spark, rows), k=k).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_inside_longer_versions(spark):
    rows = []
    for n in (200, 212, 216, 220, 224, 228, 232, 240):
        for m in (n * 4 // 3, n * 4 // 3 - 4):
            for _ in range(6):
                i = len(rows)
                words = [f"w{i}n{j}" for j in range(m + 4)]  # m shingles, of which the shorter text has n
                rows += [(i, " ".join(words[: n + 4]), "s"), (i + 1, " ".join(words), "s")]
    got = near_dedup.near_duplicates(docs_of(spark, rows)).collect()
    assert [r.doc_id for r in got if r.component_id != r.doc_id // 2 * 2] == []


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(docs_of(spark, [])).collect() == []
    got = near_dedup.near_duplicates(docs_of(spark, [(None, "a b c d e f", None)])).first()
    assert got.component_id is None and got.kept is False


def test_exact_dedup_edges(spark):
    for keep, best in (("largest", max), ("smallest", min)):
        got = exact_dedup.exact_dedup(docs_of(spark, ODD), keep=keep).collect()
        groups = defaultdict(list)
        for i, text, _ in ODD:
            groups[text or ""].append(i)
        want = sorted((i, best(x for x in groups[text or ""] if x is not None), len(groups[text or ""])) for i, text, _ in ODD if i is not None)
        assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got if r.doc_id is not None) == want
        assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    assert exact_dedup.exact_dedup(docs_of(spark, [])).collect() == []


def test_exact_dedup_verifies_bytes(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HITS_PER_SALT", 2)
    rows = [(i, "abc"[i % 3] * 5, "s") for i in range(12)]
    got = exact_dedup.exact_dedup(docs_of(spark, rows), digest=F.lit("same"))
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got.collect()) == [(i, i % 3, 4) for i in range(12)]


def test_mixing_reaches_targets(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(600)] + [(None, None, "b"), (700, "", "d")]
    mixed = mixing.mix_sources(docs_of(spark, rows)).collect()
    assert len(mixed) == len(rows)
    by = defaultdict(list)
    for r in mixed:
        by[r.source].append(r)
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= 40
        assert all(r.taken <= 2 * r.size for r in own)
    total = sum(own[0].target for own in by.values())
    assert abs(total - 1.5 * sum(r.size for r in mixed)) < 0.01
    again = mixing.mix_sources(docs_of(spark, rows).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, mixed))
    assert mixing.mix_sources(docs_of(spark, [])).collect() == []


def test_mixing_ranks_by_odds(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.choice([1, 5, 30, 200, 2000]), "ab"[i % 2]) for i in range(400)]
    by = defaultdict(list)
    for r in mixing.mix_sources(docs_of(spark, rows), weights=(3, 1), share=0.7).collect():
        by[r.source].append(r)
    unequal = 0
    for own in by.values():
        certain = int(own[0].target // own[0].source_size)
        left = own[0].target - certain * own[0].source_size
        if left == 0:
            continue
        # inclusion probabilities proportional to words, 1 at most, and right in the sum
        assert abs(sum(r.p * r.size for r in own) - left) < 1e-6 * left
        scale = max(r.p / r.size for r in own)
        assert all(abs(r.p - min(1.0, scale * r.size)) < 1e-9 for r in own)
        unequal += len({round(r.p, 9) for r in own}) > 1
        # the lowest ranks have one more copy
        more = [r.odds for r in own if r.copies == certain + 1]
        rest = [r.odds for r in own if r.copies == certain]
        assert not more or not rest or max(more) <= min(rest)
        assert len(more) + len(rest) == len(own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1000
    assert unequal


def test_repeated_rows_share_their_copies(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (1, "a", "s"), (2, "d e", "s"), (None, "f g", "s"), (None, "h", "t"), (3, None, None)]
    docs = docs_of(spark, rows)
    mixed = mixing.mix_sources(docs)
    out = mixing.repeat_rows(docs, mixed)
    assert out.columns == docs.columns
    want = defaultdict(int)
    for r in mixed.collect():
        want[str(r.doc_id), r.size] += r.copies
    got = defaultdict(int)
    for r in out.collect():
        got[str(r.doc_id), len((r.text or "").split())] += 1
    assert {k: v for k, v in want.items() if v} == dict(got)


def brute_lines(rows):
    """First occurrence of each group of equal normalised lines (no fuzzy pairs in the input)."""
    seen, lost = {}, defaultdict(set)
    for i, text, _ in sorted(rows, key=lambda r: r[0]):
        for n, line in enumerate((text or "").split("\n")):
            key = tuple(w for w in re.split(r"[\W_]+", line.lower()) if w)
            if key and seen.setdefault(key, (i, n)) != (i, n):
                lost[i].add(n)
    return lost


def test_line_dedup_exact_lines(spark):
    rng = random.Random(5)
    pool = ["".join(rng.choice("abcdefgh") for _ in range(6)) + f" line {i}." for i in range(30)]
    rows = [(i, "\n".join(rng.choice([*pool, "", "!!!"]) for _ in range(rng.randint(1, 6))), "s") for i in range(60)] + [(900, None, "s"), (901, "", "s")]
    lost = brute_lines(rows)
    got = line_dedup.dedup_lines(docs_of(spark, rows)).collect()
    for r in got:
        text = dict((i, t) for i, t, _ in rows)[r.doc_id]
        want = None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in lost[r.doc_id])
        assert (r.text, r.dropped_lines) == (want, len(lost[r.doc_id]))


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similar_lines(a, b):
    """The rule of the links: edits of letters or of words, at all lengths."""
    words = [[w for w in re.split(r"[\W_]+", x.lower()) if w] for x in (a, b)]
    return any(within(x, y) for x, y in (words, [" ".join(w) for w in words]))


def within(a, b):
    most = 0.1 * max(len(a), len(b)) + 1e-9
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    return edit_distance(a, b) <= most


def changed(line, how, rng):
    words = line.split(" ")
    at = rng.randrange(len(words))
    if how == "letter":
        i = rng.randrange(len(words[at]))
        words[at] = words[at][:i] + rng.choice("xyz") + words[at][i + 1 :]
    elif how == "word":
        words[at] = "".join(rng.choice("abcdefgh") for _ in words[at])
    elif how == "gone":
        del words[at]
    else:
        for i in rng.sample(range(len(words)), max(1, len(words) // 14)):
            words[i] = words[i][::-1] + "q"
    return " ".join(words)


def test_line_dedup_recall_against_brute_force(spark):
    rng = random.Random(11)
    rows, pairs = [], []
    for size in (2, 3, 5, 8, 10, 14, 20, 35, 60, 120, 300):
        for how in ("letter", "word", "gone", "several"):
            for _ in range(8):
                line = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(size))
                other = changed(line, how, rng)
                pairs.append((len(rows), line != other and similar_lines(line, other), size, how))
                rows += [(len(rows), line, "s"), (len(rows) + 1, other, "s")]
    lost = {r.doc_id for r in line_dedup.duplicate_lines(docs_of(spark, rows)).collect()}
    assert all(i % 2 for i in lost)  # only second lines of a pair go
    found = [(size, how, i + 1 in lost) for i, near, size, how in pairs if near]
    assert len(found) > 200
    assert sum(ok for *_, ok in found) >= 0.97 * len(found)
    for group in ({"letter"}, {"word"}, {"gone"}, {"several"}):
        own = [ok for _, how, ok in found if how in group]
        assert sum(own) >= 0.9 * len(own)
    assert not [i for i, near, *_ in pairs if not near and i + 1 in lost and rows[i][1] != rows[i + 1][1]]


def test_line_dedup_recall_of_scattered_edits_and_long_lists(spark):
    """One letter changed in k words of n; and pairs of lines that all begin alike, in lists of any length."""
    rng = random.Random(3)
    new = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 8))) for _ in range(n))

    def scattered(line, k):
        words = line.split(" ")
        for i in rng.sample(range(len(words)), k):
            at = rng.randrange(len(words[i]))
            words[i] = words[i][:at] + "x" + words[i][at + 1 :]
        return " ".join(words)

    rows, kinds = [], []

    def pair(kind, line, other):
        if similar_lines(line, other):
            kinds.append(kind)
            rows.extend([(len(rows), line, "s"), (len(rows) + 1, other, "s")])

    for n, k in ((6, 2), (10, 3), (12, 4), (20, 3), (20, 6), (30, 5), (36, 10), (38, 14), (45, 8), (60, 12)):
        for _ in range(60):
            line = new(n)
            pair((n, k), line, scattered(line, k))
    for size in (10, 60, 600):
        start = new(8)
        for _ in range(size):
            line = f"{start} {new(12)}"
            pair(size, line, scattered(line, 1))
    lost = {r.doc_id for r in line_dedup.duplicate_lines(docs_of(spark, rows)).collect()}
    assert all(i % 2 for i in lost)
    found = {kind: [2 * i + 1 in lost for i, x in enumerate(kinds) if x == kind] for kind in dict.fromkeys(kinds)}
    print({kind: (sum(ok), len(ok)) for kind, ok in found.items()})
    assert all(sum(ok) >= 0.9 * len(ok) and len(ok) >= 10 for ok in found.values())


def test_line_keys_take_five_bytes_and_come_back(spark):
    keys = [0, 1, (1 << 31) - 1, 1 << 31, (1 << 32) - 1, (1 << 40) - 1, 1 << 39, -1, -(1 << 63)]
    rows = spark.createDataFrame([(7, keys), (8, [])], "id long, keys array<long>").select("id", F.struct(line_dedup._packed(F.col("keys")).alias("packed")).alias("first"))
    assert rows.schema["first"].dataType["packed"].dataType.simpleString() == "struct<lows:array<int>,highs:array<tinyint>>"
    assert [(r.id, r.key) for r in line_dedup._keyed(rows).collect()] == [(7, k & ((1 << 40) - 1)) for k in keys]


def test_simhash_is_the_majority_of_the_words(spark):
    rng = random.Random(2)
    most = (1 << line_dedup.DIGITS) - 1
    rows = [[rng.randrange(-(1 << 63), 1 << 63) for _ in range(n)] for n in (1, 2, 3, 16, 30, most)] + [[-1] * most, [0] * most]
    words = [F.coalesce(F.get("words", F.lit(i)), F.lit(0)) for i in range(most)]
    got = spark.createDataFrame([(r,) for r in rows], "words array<long>").select("words", line_dedup.simhash(words, F.size("words")).alias("sim")).collect()
    assert [r.sim for r in got] == [sum(1 << k for k in range(60) if sum(w >> k & 1 for w in r.words) > len(r.words) // 2) for r in got]


def test_line_lists_go_once_they_have_met(spark, monkeypatch):
    rng = random.Random(4)
    new = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    passage = new(6)
    rows = [(i, f"{new(20)} {passage} {new(20)}", "s") for i in range(40)]
    rows += [(100, rows[0][1] + " more", "s")]
    made, rest, write = [], [], line_dedup.materialize

    def kept(df, label, *more):
        out = write(df, label, *more)
        made.append((label, out.scratch_path))
        rest.extend([out.columns] if label == "line-rest" else [])
        return out

    monkeypatch.setattr(line_dedup, "materialize", kept)
    assert [tuple(r) for r in line_dedup.duplicate_lines(docs_of(spark, rows)).collect()] == [(100, 0)]
    left = {label for label, path in made if os.path.exists(path.removeprefix("file:"))}
    assert rest and {"line-lists", "line-refined", "line-rest"} <= {label for label, _ in made} and not {"line-lists", "line-refined", "line-rest"} & left


def test_chance_meetings_of_long_lines_are_not_verified(spark, monkeypatch):
    """Lines that share two runs of common words and a third of their words stay apart by their SimHashes."""
    rng = random.Random(6)
    new = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
    common = new(12)
    rows = [(i, " ".join([*common, *new(28)]), "s") for i in range(60)]
    pairs, write = [], line_dedup.materialize

    def kept(df, label, *more):
        out = write(df, label, *more)
        pairs.extend([out.count()] if label == "line-pairs" else [])
        return out

    monkeypatch.setattr(line_dedup, "materialize", kept)
    assert line_dedup.duplicate_lines(docs_of(spark, rows)).collect() == []
    print(pairs)
    assert sum(pairs) < 60 * 59 // 2 // 8


def test_line_dedup_sizes_at_borders(spark):
    """One letter more or less where the number of allowed edits changes."""
    rows, rng = [], random.Random(5)
    for size in (*range(9, 32), 50, 120, 300):
        for _ in range(4):
            line = "".join(rng.choice("abcdefghijkl") if i % 6 != 5 else " " for i in range(size - 1)) + "z"
            rows += [(len(rows), line, "s"), (len(rows) + 1, line + "y", "s")]
    lost = {r.doc_id for r in line_dedup.duplicate_lines(docs_of(spark, rows)).collect()}
    assert lost == {i for i, *_ in rows if i % 2}


def test_line_dedup_groups_and_odd_input(spark):
    words = [f"wordnumber{i}" for i in range(120)]
    lines = [" ".join(words), " ".join([*words[:60], "different", *words[61:]]), " ".join(reversed(words))]
    rows = [(i, line, "s") for i, line in enumerate(lines)]
    # equal words in another order are not similar
    assert {(r.doc_id, r.line_no) for r in line_dedup.duplicate_lines(docs_of(spark, rows)).collect()} == {(1, 0)}
    assert line_dedup.duplicate_lines(docs_of(spark, [])).collect() == []
    long = " ".join(f"w{i}" for i in range(30_000))
    odd = [(None, long, "s"), (1, long + " more", "s"), (2, None, "s"), (3, "", "s"), (4, "...\n\n!", "s"), (5, "abc def", "s"), (5, "abc def", "s"), (6, "abc def\nabc def", "s"), (7, "the same " * 40, "s")]
    docs = spark.createDataFrame([(*r, 7, 8) for r in odd], "doc_id long, text string, source string, lost_lines int, `a.b` int")
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "dropped_lines"]
    kept = sorted((str(r.doc_id), r.text and r.text[:7], r.dropped_lines) for r in got.collect())
    assert kept == [("1", "", 1), ("2", None, 0), ("3", "", 0), ("4", "...\n\n!", 0), ("5", "abc def", 0), ("5", "abc def", 0), ("6", "", 2), ("7", "the sam", 0), ("None", "w0 w1 w", 0)]


def test_line_dedup_lists_that_stay_apart(spark):
    """Lines that share a passage but little else keep to themselves, and similar ones among them still meet."""
    rng = random.Random(8)
    new = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    passage = new(30)
    rows = [(2 * i, f"{new(20)} {passage} {new(20)}", "s") for i in range(40)]
    rows += [(i + 1, changed(text, "word", rng), "s") for i, text, _ in rows]
    lost = {r.doc_id for r in line_dedup.duplicate_lines(docs_of(spark, rows)).collect()}
    assert lost == {i for i, *_ in rows if i % 2}


def test_digest_runs_filters_and_levels(spark):
    rows = [(f"{i * 7919 % 400:03d}" if i % 3 else f"u{i}", i) for i in range(900)]
    digests = spark.createDataFrame(rows, "digest string, id long")
    for fanout, levels in ((2, 4), (8, 2)):
        index = exact_dedup.DigestIndex(spark, memtable_rows=64, fanout=fanout)
        flushed = index.flush(digests)
        assert flushed.select("run").distinct().count() == 15
        for part in spark.read.parquet(index.levels[0][1]).select("run", "digest", "n", F.input_file_name().alias("f")).groupBy("f").agg(F.collect_list(F.struct("run", "digest")).alias("xs")).collect():
            assert part.xs == sorted(part.xs)  # sorted runs
        got = {r.digest: (r.keep_id, r.group_size) for r in index.compact().collect()}
        groups = defaultdict(list)
        for d, i in rows:
            groups[d].append(i)
        assert got == {d: (min(x), len(x)) for d, x in groups.items()}
        assert index.levels[0][0] == levels and index.levels[0][2] == 1


def test_digest_filters_hold_what_their_runs_hold(spark):
    digests = spark.createDataFrame([(str(i % 50), i) for i in range(200)], "digest string, id long")
    index = exact_dedup.DigestIndex(spark, memtable_rows=50)
    entries = index.flush(digests)
    index._rows_of_run = 50
    maps = {(r.merge, r.piece, m.run): bytes(m.map) for r in index.filters(entries, 4).collect() for m in r.maps}
    for r in entries.select("run", "digest", *index._place(4)).collect():
        assert maps[r.merge, r.piece, r.run][r.bit // 8] >> (r.bit % 8) & 1
    ones = sum(bin(b).count("1") for m in maps.values() for b in m)
    assert ones <= entries.count()


def test_only_lines_of_pairs_are_read_again(spark, monkeypatch):
    # all lines share a run of three words and nothing else: their SimHashes are far apart
    rows = [(i, "aa bb cc " + " ".join(f"w{i}x{j}" for j in range(20)), "s") for i in range(30)] + [(50, "dd ee ff gg hh ii jj kk ll mm nn", "s"), (51, "dd ee ff gg hh ii jj kk ll mm no", "s")]
    read, write = [], line_dedup.materialize

    def kept(df, label, *rest):
        out = write(df, label, *rest)
        read.extend([out.count()] if label == "line-texts" else [])
        return out

    monkeypatch.setattr(line_dedup, "materialize", kept)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert [tuple(r) for r in line_dedup.duplicate_lines(docs).collect()] == [(51, 0)]
    # SimHash lets a pair or two through by chance
    assert max(read) < 10
