import base64
import gzip
import hashlib
import io
import random
import re
import struct
import time
import zipfile
import zlib
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from quillspark.llm import bpe, html_text, media, quality, token_store, toxicity

SPECIAL = [(8, "a<|startoftext|>b <|endoftext|> <|ENDOFTEXT|>c <|endof text|>"), (9, "<|endoftext|>"), (10, "plain <|endoftext|")]
TEXTS = [(1, "The cat's 12 dogs,  ran!\n\n"), (2, None), (3, ""), (4, "日本語 😀 ́é \x1c x"), (5, "a" * 5000), (6, " \n \t"), (7, "THE cat"), (7, "THE cat"), (None, "the")]


def docs_of(spark, rows=TEXTS):
    return spark.createDataFrame([(*r, "y") for r in rows], "doc_id long, text string, ids string")


def test_bpe_equals_tiktoken_and_round_trips(spark):
    path, pattern = bpe.public_vocabulary()
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode_digests(docs_of(spark), path, pattern).collect()
    want = []
    for i, text in TEXTS:
        ids = known.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got] == want
    back = bpe.decode(bpe.encode(docs_of(spark), path, pattern), path, pattern).collect()
    assert [bytes(r.bytes) for r in back] == [(t or "").encode() for _, t in TEXTS]


def test_bpe_long_pieces_take_linear_time(spark):
    path, pattern = bpe.public_vocabulary()
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    known, own, rng = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), bpe.ByteBPE(path, pattern), random.Random(3)
    for n in (127, 128, 129, 130, 700, 5000):
        for alphabet in ("ab", "etaoinshr", "é", "xyzzy日本"):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            assert np.frombuffer(own.encode_batch([text])[0], "<u4").tolist() == known.encode_ordinary(text)
    began = time.time()
    own.encode_batch(["".join(rng.choice("abcdefgh") for _ in range(200_000))])
    assert time.time() - began < 20


def test_bpe_caches_may_overflow(monkeypatch):
    one = bpe.ByteBPE(*bpe.public_vocabulary())
    texts = [" ".join(f"word{i}x{j}" for j in range(50)) for i in range(40)]
    whole = one.encode_batch(texts)
    monkeypatch.setattr(bpe, "CACHE_PIECES", 30)
    monkeypatch.setattr(bpe, "TREE_CELLS", 64)
    two = bpe.ByteBPE(*bpe.public_vocabulary())
    assert [two.encode_batch([t])[0] for t in texts] == whole


def test_token_file_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_IDS", 200)
    path = public_tokenizers.path("word_bpe_49k.json")
    known = Tokenizer.from_file(path)
    texts = TEXTS + SPECIAL
    blocks, lengths = token_store.write_token_file(docs_of(spark, texts), path, 49_408, 2)
    got = token_store.crc_of_ids(token_store.read_token_file(blocks, lengths)).collect()
    ids = {(i, t): [*known.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts}
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0))
    start, want = 0, []
    for key in order:
        raw = struct.pack(f"<{len(ids[key])}I", *ids[key])
        want.append((key[0], start, len(ids[key]), zlib.crc32(raw)))
        start += len(ids[key])
    assert sorted(map(str, got)) == sorted(f"Row(doc_id={a}, start={b}, n_tokens={c}, ids_crc32={d})" for a, b, c, d in want)
    none = docs_of(spark, []).limit(0)
    blocks, lengths = token_store.write_token_file(none, path, 49_408, 2)
    assert token_store.read_token_file(blocks, lengths).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_huffman_lengths_are_optimal_and_limited(seed):
    rng = random.Random(seed)
    counts = np.array([rng.choice([0, 1, 3, 1000]) for _ in range(60)])
    free, tight = token_store.code_lengths(counts, 30), token_store.code_lengths(counts, 6)
    assert tight.max() <= 6 and sum(2.0 ** -int(x) for x in tight if x) <= 1
    assert (counts * free).sum() <= (counts * tight).sum()
    code, ids = token_store.HuffmanCode(tight), np.array([i for i in range(60) if counts[i]] * 50)
    packed, checkpoints = code.encode(ids)
    assert (code.decode(packed, checkpoints, len(ids)) == ids).all()


def test_html_edges(spark):
    page = "<html><head><title>T</title><script>if(a<b){'</p>'}</script></head><body><nav><a href=x>Menu</a></nav><div class='ad'>Buy</div><article><h1>Head &amp; tail</h1><p>One<br>two <b>three<p>Four&nbsp;\n five</p></article><footer>f</footer>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<!-- open"), (5, "u", "plain &lt;text&gt;"), (6, "u", "<p " + "a" * 50000)]
    got = html_text.extract_main_text(spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, text int")).collect()
    assert [(r.page_id, r.text) for r in got] == [(1, "Head & tail One two three Four five"), (2, ""), (3, ""), (4, ""), (5, "plain <text>"), (6, "")]
    assert all(r.n_chars == len(r.text) for r in got)


class PlainArticle(HTMLParser):
    """The blocks of the article of a simple page, by the library's parser."""

    def __init__(self):
        super().__init__()
        self.inside, self.skipped, self.blocks, self.now = 0, 0, [], ""

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside += 1
        if tag in ("script", "style"):
            self.skipped += 1
        if tag == "br":
            self.now += " "
        elif tag in ("p", "h1", "article", "div", "ul", "li", "nav", "footer"):
            self.flush()

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article", "div", "ul", "li", "nav", "footer"):
            self.flush()
        self.inside -= tag == "article"
        self.skipped -= tag in ("script", "style")

    def handle_data(self, data):
        if self.inside and not self.skipped:
            self.now += data

    def flush(self):
        if self.now.split():
            self.blocks.append(" ".join(self.now.split()))
        self.now = ""


def test_html_agrees_with_a_plain_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract_main_text(pages).collect()}
    for row in pages.collect():
        parser = PlainArticle()
        parser.feed(row.html)
        parser.flush()
        assert got[row.page_id] == " ".join(parser.blocks)


def brute_windows(weights, surge):
    """Which lines stand between a surge and the next dive."""
    kept, at = [], 0
    while at < len(weights):
        if sum(weights[at : at + html_text.WINDOW]) >= surge:
            while at < len(weights) and sum(weights[at : at + html_text.WINDOW]) > 0:
                kept.append(at)
                at += 1
        at += 1
    return kept


def test_html_windows_match_brute_force():
    rng = random.Random(9)
    for _ in range(200):
        sizes = [rng.choice([0, 0, 5, 40, 120]) for _ in range(rng.randint(1, 25))]
        lines = [f"{i:02d}" + "x" * (n - 2) if n else f"<a href=u>link {i}</a>" for i, n in enumerate(sizes)]
        page = "".join(f"<p>{x}</p>" for x in lines)
        got = html_text.main_text(page)
        surge = min(html_text.SURGE, max(sum(sizes[i : i + html_text.WINDOW]) for i in range(len(sizes))))
        kept = brute_windows(sizes, surge) if surge else []
        # links at the beginning of a stretch are left out
        kept = [i for i in kept if sizes[i] or any(j in kept and sizes[j] and all(k in kept for k in range(j, i)) for j in range(i))]
        assert got == " ".join(re.sub("<[^>]*>", "", lines[i]) for i in kept)


ARTICLE = "<article><h1>Title</h1><p>Some paragraph of text that goes on for a while, to be sure of it.</p>{}<p>Another one, also of some length, that ends it all.</p></article>"


@pytest.mark.parametrize(("inside", "text"), [
    ("<h2 id='related-work'>Related work</h2>", "Related work"), ("<div class='entry-header'><h1>Two</h1></div>", "Two"), ("<section id='search'><p>On search.</p></section>", "On search."),
    ("<p class='share-price'>12 dollars</p>", "12 dollars"), ("<p><a href=x>A link</a></p>", "A link"), ("<ul><li><a href=1>L1</a><li><a href=1>L2<li><a>L3</a></ul>", "L1 L2 L3"),
    ("<div class='comments'>" + "<p>nice post</p>" * 90 + "</div>", ""), ("<div class='comment-thread'>" + "<p>nice post</p>" * 90 + "</div>", ""), ("<section id='reader-comments'><p>nice</p></section>", ""),
    ("<ol class='x user-comments'><li>nice</ol>", ""), ("<div class='post-comments-list'>nice</div>", ""), ("<div id='CookieBanner'>We use cookies</div>", ""), ("<div class='siteHeader'>Site</div>", ""),
    ("<div class='has-comments'><p>Kept.</p></div>", "Kept."), ("<p>See <span class='comment-mark'>this</span>.</p>", "See this."), ("<p class='newsletterish'>Kept too.</p>", "Kept too."),
    ("".join(f"<p><a href={i}>Reference {i}</a></p>" for i in range(5)), " ".join(f"Reference {i}" for i in range(5))), ("<div class='cookie-banner'>We use cookies</div>", ""), ("<aside>side</aside>", ""), ("<div hidden>gone</div>", ""),
])
def test_html_class_words_count_whole(inside, text):
    page = "<body><nav><a href=u>Home</a></nav>" + ARTICLE.format(inside) + "<div class=sidebar>Side</div><footer>f</footer></body>"
    want = ["Title Some paragraph of text that goes on for a while, to be sure of it.", text, "Another one, also of some length, that ends it all."]
    assert html_text.main_text(page) == " ".join(x for x in want if x)
    assert html_text.main_text(f"<form><div class='header-article-body'>{page}</div></form>") == " ".join(x for x in want if x)


def test_html_links_at_the_ends_of_an_article():
    page = "<article><p><a href=j>By Jane Doe</a></p><p>Text.</p><p><a href=r>Read the full report here</a></p></article>"
    assert html_text.main_text(f"<nav><a href=u>Home</a></nav>{page}<p><a href=b>Back</a></p>") == "By Jane Doe Text. Read the full report here"


def test_html_is_linear():
    began = time.time()
    for page in ("<p>" + "<b>" * 50_000 + "x" + "</b>" * 50_000, "<div class=ad>" * 30_000 + "x", "<a " + "\"'" * 50_000, "<p>a<ul>" * 20_000):
        html_text.main_text(page)
    assert time.time() - began < 15


def labelled(spark, bad, rng):
    good = [" ".join(rng.choice(["the", "plain", "prose", "of", "words", "reads", "well"]) for _ in range(40)) for _ in range(300)]
    rows = [(i, t, 1) for i, t in enumerate(good)] + [(1000 + i, bad(rng), 0) for i in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, None), (9001, "")], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, y, 1 - y) for i, _, y in rows], "doc_id long, quality int, toxic int")


def test_quality_separates_and_keeps_clean(spark):
    docs, labels = labelled(spark, lambda r: " ".join("w%%%" for _ in range(30)), random.Random(2))
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    assert len(got) == 452 and all(0 <= r.score <= 1 for r in got.values())
    held = [r for r in got.values() if r.held_out]
    assert held and all(r.predicted == (r.doc_id < 1000) for r in held if r.doc_id < 9000)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= set(range(300))
    nothing = quality.quality(docs, labels.limit(0)).collect()
    assert {r.score for r in nothing} == {0.5}


def test_toxicity_separates(spark):
    docs, labels = labelled(spark, lambda r: " ".join([*r.sample(["the", "of", "plain", "words"], 3), "vileword", "nastyword"]), random.Random(4))
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()}
    assert len(got) == 452 and all(0 <= r.score <= 1 for r in got.values())
    assert np.mean([r.predicted == (1000 <= r.doc_id < 9000) for r in got.values()]) > 0.98


ODD_TEXTS = [(9100, None), (9101, ""), (9102, "the"), (9102, "the"), (None, "plain words"), (9103, "prose of " * 30_000), (9104, "\u00e9t\u00e9 \u65e5\u672c")]


@pytest.mark.parametrize("operator", ["quality", "toxicity"])
def test_classifiers_of_odd_rows(spark, operator):
    docs, labels = labelled(spark, lambda r: " ".join("w%%%" for _ in range(30)), random.Random(2))
    odd = spark.createDataFrame(ODD_TEXTS, "doc_id long, text string")
    # repeated rows, conflicting labels and columns with clashing names change nothing from run to run
    both = docs.unionByName(odd).unionByName(docs.limit(20)).withColumns({"label": F.lit(3), "score": F.lit("x"), "predicted": F.lit(0), "lang": F.lit("en")})
    more = labels.unionByName(labels.limit(30).withColumn("quality", 1 - F.col("quality"))).unionByName(spark.createDataFrame([(None, 1, 1), (9102, None, None)], "doc_id long, quality int, toxic int"))

    def run(d, la):
        if operator == "quality":
            return quality.quality(d, la)
        return toxicity.score_toxicity(d, toxicity.fit_toxicity(d, la))

    first, again = [sorted((str(r.doc_id), r.score, r.predicted) for r in run(d, la).collect()) for d, la in ((both, more), (both.repartition(5), more.repartition(3)))]
    assert first == again and len(first) == both.count()
    assert all(0 <= score <= 1 for _, score, _ in first)
    assert len({x for x in first if x[0] == "9102"}) == 1
    assert run(both.limit(0), more).collect() == []


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / max(1, len(good) * len(bad))


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for query, label in ((quality.op7_quality, "quality"), (toxicity.op9_toxicity, "toxic")):
        rows = [(r.score, r.predicted, labels[r.doc_id][label]) for r in query(spark, sf_dir).collect() if r.held_out and r.doc_id in labels]
        assert len(rows) > 40
        assert auc([(s, y) for s, _, y in rows]) > 0.95
        assert sum(p == y for _, p, y in rows) > 0.85 * len(rows)


def plain_features(text, buckets=quality.BUCKETS):
    """The byte pairs and triples of a text and its longest run of one word, one by one."""
    b, shift, odd = (text or "").encode(), 64 - (buckets - 1).bit_length(), 0x9E3779B97F4A7C15
    found = {((((b[i] << 8 | b[i + 1]) + (1 << 40)) * odd) % 2**64) >> shift for i in range(len(b) - 1)}
    found |= {(((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * odd) % 2**64) >> shift for i in range(len(b) - 2)}
    longest = now = 0
    words = re.findall(rb"[^\x20\x09-\x0d]+", b)
    for x, y in zip(words, words[1:]):
        now = now + 1 if x == y else 0
        longest = max(longest, now)
    return found | {buckets + i for i in range(min(quality.RUNS, longest.bit_length()))}


def test_quality_score_matches_plain_code(spark):
    docs, labels = labelled(spark, lambda r: " ".join(r.choice(["%%", "##", "zz"]) for _ in range(30)), random.Random(5))
    docs = docs.unionByName(spark.createDataFrame(ODD_TEXTS, "doc_id long, text string"))
    model = quality.fit_quality(docs, labels)
    got = sorted((str(r.doc_id), round(r.score, 6)) for r in quality.score_quality(docs, model).collect())
    want = []
    for r in docs.collect():
        found = plain_features(r.text)
        margin = sum(float(model.weights[i]) for i in found) / max(1, len(found)) ** 0.5 + model.bias
        want.append((str(r.doc_id), 1 / (1 + np.exp(-(model.slope * margin + model.offset)))))
    for (a, x), (b, y) in zip(got, sorted(want), strict=True):
        assert a == b and abs(x - y) < 1e-4


def test_toxicity_score_matches_plain_code(spark, monkeypatch):
    docs, labels = labelled(spark, lambda r: " ".join([*r.sample(["the", "of", "plain", "words"], 3), "vileword", "nastyword"]), random.Random(4))
    model = toxicity.fit_toxicity(docs, labels)
    monkeypatch.setattr(toxicity, "WINDOW_WORDS", 7)  # windows do not change a score
    texts = [r.text for r in docs.collect()][:40] + ["", "one", "the vileword of many words and plain ones " * 9]
    import pyarrow as pa

    for word, head, _ in toxicity.token_rows(pa.array(texts)):
        x = [model.words[w].astype(float) + model.heads[h] for w, h in zip(word, head, strict=True)]
        tops = []
        for width in model.filters:
            for f in range(toxicity.FILTERS):
                values = [sum(float(x[t + o] @ model.filters[width][o][:, f]) for o in range(width)) + float(model.biases[width][f]) for t in range(len(x) - width + 1)]
                tops.append(max([0.0, *values]))
        assert abs(sum(a * float(b) for a, b in zip(tops, model.out, strict=True)) + model.out_bias - model.logit(word, head)) < 1e-3


def test_media_chains_of_pages_take_linear_time():
    """Marks that lead on to the next mark are walked once, with an end flag and without."""
    page = b"OggS" + bytes(22) + b"\x00"
    last = b"OggS" + b"\x00\x04" + bytes(20) + b"\x00"
    began = time.time()
    assert media.sniff(page * 40_000) == []
    assert media.sniff(b"x" + page * 3 + last + page) == [("audio/ogg", 1, 4 * 27)]
    assert media.sniff(page * 40_000 + last) == [("audio/ogg", 0, 40_001 * 27)]
    boxes = b"\0\0\0\x08ftyp" * 50_000
    assert media.sniff(boxes) == []
    assert media.sniff(boxes + b"\0\0\0\x08moov\0") == [("video/mp4", 0, 400_008)]
    packed = gzip.compress(b"text" * 1000)
    assert media.sniff(b"\x1f\x8b\x08" * 3 + packed + b"x") == [("application/gzip", 9, len(packed))]
    for _, magic, _, _ in media.FORMATS:
        media.sniff(magic * (200_000 // len(magic)))
    assert time.time() - began < 20


def test_media_sniffing_and_storage(spark):
    wav = media.to_wav(b"abc" * 11)
    gz = zlib.compressobj(wbits=31)
    inner = gz.compress(b"hello") + gz.flush()
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + chunk(b"IEND", b"")
    rows = [(1, wav, "audio/wav"), (2, png, "image/jpeg"), (3, b"xx" + inner + b"yy" + png[:-1], None), (4, None, "image/png"), (5, b"BM RIFF GIF89a PK\x03\x04", None), (6, png + wav, None)]
    frame = spark.createDataFrame([(i, bytearray(c) if c is not None else None, d) for i, c, d in rows], "id long, content binary, declared string")
    got = {r.id: r for r in media.sniff_media(frame, "id", "content", "declared").collect()}
    assert [(got[i].media_type, got[i].declared_ok) for i in range(1, 7)] == [("audio/wav", True), ("image/png", False), (None, None), (None, False), (None, None), ("image/png", None)]
    assert [(r.id, r.media_type, bytes(r.content)) for r in media.carve(frame, "id", "content").orderBy("id").collect()] == [(3, "application/gzip", inner), (6, "audio/wav", wav)]
    began = time.time()
    assert media.sniff(b"PK\x03\x04" * 60_000) == [] and media.sniff(b"%PDF-" * 60_000) == [] and media.sniff(b"PK\x05\x06" * 60_000 + b"PK\x03\x04" * 60_000) == []
    assert time.time() - began < 10
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a.txt", "inside")
    pdf = b"%PDF-1.4\n1 0 obj\nstartxref\n0\n%%EOF\nmore startxref 1 %%EOF"
    assert media.sniff(b"xx" + packed.getvalue() + b"y" + pdf + b"\n" + pdf) == [("application/zip", 2, len(packed.getvalue())), ("application/pdf", 3 + len(packed.getvalue()), len(pdf)), ("application/pdf", 4 + len(packed.getvalue()) + len(pdf), len(pdf))]
    stored = media.media_features(media.store_texts(docs_of(spark))).collect()
    assert {(r.media_type, r.declared_ok) for r in stored} == {("audio/wav", False)}
    for r in stored:
        text = next(t for i, t in TEXTS if i == r.doc_id) or ""
        raw = text.encode()
        padded = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


