"""The training-data operators against brute force, on small tables with the awkward cases."""

import base64
import collections
import hashlib
import html
import json
import random
import re
import string
import zlib

import duckdb
import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from stridelake.llm import chunk_prints, exact_topk, html_text, line_dedup, mixing, quality, queries, sentencepieces, simhash, token_files
from stridelake.llm.components import components
from stridelake.operators import blocks as B

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def awkward():
    """Copies, near copies, shared lines, nulls in every column, empty and long texts, a repeated row, white space of all kinds."""
    rng = random.Random(5)
    base = [sentence(rng, 60) for _ in range(6)]
    shared = "This very line is shared by many of the documents, Word for word"
    texts = [None, "", "\n", " \t\r\n", "short", base[0], base[0], base[0].replace(base[0].split()[7], "zzz"), shared + "\n" + base[1], base[2] + "\n  " + shared.upper() + "\t\n" + base[3]]
    texts += [shared + "\n" + shared + "\n" + sentence(rng, 30), "é ü 日本語 😀 " + base[4], " \x1c a\xa0b ​", "\n".join(sentence(rng, 12) for _ in range(400)), "x" * 3000, "|".join("abc") * 200, "<|endoftext|> </s> <s> ▁"]
    rows = [(i * 3 + 1, t, "en" if i % 3 else None, None if i % 5 == 0 else f"s{i % 4}", None if t is None else len(t), 0.5) for i, t in enumerate(texts)]
    return rows + [rows[5], (None, base[5], None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# quality classifier


def test_quality_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    found = quality.op1_quality(spark, d)
    assert set(found.columns) >= {"doc_id", "held_out", "score", "predicted"}
    rows = found.join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality"), "doc_id").where("held_out").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found.collect())


def test_quality_fit_matches_numpy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stats = {r.id: np.array(r.stats) for r in quality.document_statistics(docs).collect()}
    marks = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    moments = {}
    for k in (0, 1):
        x = np.array([stats[i] for i, q in marks.items() if q == k])
        moments[k] = len(x), x.sum(axis=0), x.T @ x
    model, own = quality.discriminant(moments), quality.fit(quality.document_statistics(docs), labels)
    x = np.array(list(stats.values()))
    assert np.allclose(model.score(x), own.score(x))
    shrunk = np.linalg.inv(model.factors[0].T @ model.factors[0])
    gap = x - model.means[0]
    density = -0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(shrunk), gap) - 0.5 * np.linalg.slogdet(shrunk)[1] + model.log_priors[0]
    white = gap @ model.factors[0].T
    assert np.allclose(density, model.log_priors[0] - model.log_roots[0] - 0.5 * (white**2).sum(axis=1))


def test_quality_awkward(spark, docs, empty):
    none = labels_of(spark, [])
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5} and quality.classify(docs, none).count() == docs.count()
    assert quality.classify(empty, none).count() == 0 and quality.keep_good(empty, none).count() == 0
    some = labels_of(spark, [(1, 0, 0), (4, 0, 0), (16, 1, 0), (19, 1, 1), (25, 1, None), (25, None, 0), (28, 7, 0), (None, 1, 0)])
    assert quality.classify(docs, some).count() == docs.count()
    assert quality.keep_good(docs, some).columns == docs.columns


# line dedup


def brute_lines(rows, least=2):
    big = 1 << 63
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(c.lower() if c in string.ascii_uppercase else c for c in x.strip(strip))
    holders = collections.defaultdict(set)
    for r in rows:
        for x in (r[1] or "").split("\n"):
            holders[key(x)].add(big if r[0] is None else r[0])
    out = []
    for r in rows:
        i, lines = big if r[0] is None else r[0], (r[1] or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < least or min(holders[key(x)]) == i]
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup(docs, empty):
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_lines(awkward())))
    assert any(r[2] for r in got) and line_dedup.dedup_lines(empty).count() == 0
    often = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(docs, min_docs=3).collect()]
    assert sorted(map(str, often)) == sorted(map(str, brute_lines(awkward(), 3))) and any(r[2] for r in often)
    clash = docs.withColumn("n_lines", F.lit("x")).withColumn("line", F.lit(1)).withColumn("key", F.lit(2))
    assert sorted(str((r.doc_id, r.n_lines, r.n_dropped, r.text)) for r in line_dedup.dedup_lines(clash).collect()) == sorted(map(str, got))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "sales", "sale_lines", "items", "vendors", "clients"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


# SentencePiece


def test_sentencepiece_is_the_library(docs, empty):
    path = sentencepieces.model_path()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = sentencepieces.encode_documents(docs, path).collect()
    texts = sorted((r[1] or "") for r in awkward())
    want = sorted((library.encode(t, add_bos=True, add_eos=True), library.decode(library.encode(t, add_bos=True, add_eos=True))) for t in texts)
    assert sorted((r.ids, r.decoded) for r in rows) == want
    digests = {r.ids_sha256 for r in sentencepieces.encode_digests(docs, path).collect()}
    assert digests == {hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() for ids, _ in want}
    assert sentencepieces.encode_documents(empty, path).count() == 0


def test_sentencepiece_spans_and_merges():
    path = sentencepieces.model_path()
    model, library = sentencepieces.PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(7)
    texts = ["", " ", "ab  cd", "▁x ▁", "é\n日😀", "x" * 3000, "antidisestablishmentarianism" * 40] + ["".join(rng.choice("ab ▁\n\té😀<0>x1") for _ in range(40)) for _ in range(200)]
    texts += [" ".join("".join(rng.choice("etaoinshr'.,") for _ in range(rng.randint(1, 70))) for _ in range(60)) for _ in range(20)]
    for text in texts:
        e, data = model.encode(text), text.encode()
        assert list(e.ids) == library.encode(text, add_bos=True, add_eos=True)
        assert e.begins[0] == 0 and e.ends[-1] == len(data) and (e.ends[:-1] == e.begins[1:]).all()
        for i, b, end in zip(e.ids, e.begins, e.ends):
            if model.kinds[i] == sentencepieces.NORMAL:
                assert data[b:end].decode().replace(" ", "▁") in (model.pieces[i], model.pieces[i][1:])
    scanned = [model.merge(t.replace(" ", "▁")) for t in texts]
    sentencepieces.SCANNED, kept = 0, sentencepieces.SCANNED
    assert scanned == [model.merge(t.replace(" ", "▁")) for t in texts]
    sentencepieces.SCANNED = kept


def test_character_map_takes_the_longest_prefix():
    """A hand-made double array: 'a' to 'x', 'ab' to 'yz'."""
    size = 1024
    units = [0] * size
    leaf = lambda offset, label, has: label | (1 << 8 if has else 0) | offset << 10
    root = 1 << 10  # children of the root are at 1 ^ byte
    units[0] = root
    a = 1 ^ ord("a")
    units[a] = leaf(a ^ 512, ord("a"), True)
    units[512] = 0x80000000 | 0
    ab = 512 ^ ord("b")
    units[ab] = leaf(ab ^ 300, ord("b"), True)
    units[300] = 0x80000000 | 2
    blob = np.array([4 * size], "<u4").tobytes() + np.array(units, "<u4").tobytes() + b"x\0yz\0"
    table = sentencepieces.CharacterMap(blob)
    assert table.longest(b"abc", 0) == (2, b"yz") and table.longest(b"ac", 0) == (1, b"x") and table.longest(b"b", 0) is None
    model = sentencepieces.PieceModel(sentencepieces.model_path())
    model.map = table
    text, origin = model.normalise("é abac")
    assert text == "▁é▁yzxc"
    assert list(origin) == [0, 0, 0, 0, 0, 2, 2, 2, 3, 3, 5, 6, 7]


# HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site</h1><p>Slogan of the site that is rather long and says nothing</p></header><nav><ul><li><a href="/">Home</a><li><a href="/x">Other</a></ul></nav>
<div class="cookie-banner">We use cookies and hope that you accept every one of them right now</div><aside><p>Sidebar text that is long enough to look like content of its own</p></aside>
<article class="with-sidebar"><header><h1>The  &amp; title</h1></header><p>First paragraph with <b>bold</b> &eacute; text<br>and more of it, long enough to count.</p><p>Short.</p><div class="ad">Buy now this wonderful thing</div>
<p>Third<!-- note --> paragraph, unclosed<p>Fourth<form><input name=q><p>Search here</p></form><section id="comments"><h2>Comments</h2><article><p>Reader says something long about the article in question</p></article></section></article>
<footer><p>&copy; Someone, with a long line about rights that are all reserved</p></footer></body></html>"""


def test_html_article():
    assert html_text.main_text(PAGE) == "The & title\nFirst paragraph with bold é text and more of it, long enough to count.\nShort.\nThird paragraph, unclosed\nFourth"
    bare = "<body><div><a href=1>Home</a> <a href=2>More links</a></div><h1>Head</h1>" + "".join(f"<p>Paragraph {i} {'of real text ' * 12}</p>" for i in range(5)) + "<div><a href=3>One</a> <a href=4>Two</a> <a href=5>Three</a></div></body>"
    lines = html_text.main_text(bare).split("\n")
    assert lines[0] == "Head" and len(lines) == 6
    assert html_text.main_text("") == html_text.main_text("<nav>x</nav>") == "" and html_text.main_text("plain") == "plain"
    assert html_text.main_text("<p>" * 3000 + "deep</p>") == "deep"


def test_html_pages_of_the_fixture(spark, empty):
    rows = html_text.op4_html_text(spark, SF).collect()
    source = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(source)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)
    pages = spark.createDataFrame([(1, "u", None), (1, "u", ""), (None, None, PAGE)], "page_id long, url string, html string")
    assert sorted(r.n_chars for r in html_text.extract_pages(pages).collect())[:2] == [0, 0]
    assert html_text.extract_pages(pages.limit(0)).count() == 0


# fingerprints


def brute_gear(data):
    h, out = 0, []
    for b in data:
        h = ((h << 1) + int(chunk_prints.GEAR[b])) & 0xFFFFFFFF
        out.append(h)
    return out


def test_gear_hash_and_chunks():
    data = np.random.default_rng(0).integers(0, 256, 2000).astype(np.uint8)
    assert chunk_prints.gear_hash(data).tolist() == brute_gear(data.tolist())
    hashes, ends, start = brute_gear(data.tolist()), [], 0
    for i, h in enumerate(hashes):
        n = i + 1 - start
        strict, easy = h >> (32 - chunk_prints.STRICT) == 0, h >> (32 - chunk_prints.EASY) == 0
        if strict and n >= chunk_prints.LEAST or easy and n >= chunk_prints.NORMAL or n == chunk_prints.MOST:
            ends.append(i + 1)
            start = i + 1
    if start < len(data):
        ends.append(len(data))
    assert chunk_prints.chunk_ends(data.tobytes()) == ends


def brute_print(text):
    """Chunk by chunk and byte by byte, as a sorted list of (digest, length)."""
    data, out, start = text.encode(), [], 0
    for i, h in enumerate(brute_gear(data)):
        n = i + 1 - start
        zeros = 32 - h.bit_length()
        if zeros >= chunk_prints.STRICT and n >= chunk_prints.LEAST or zeros >= chunk_prints.EASY and n >= chunk_prints.NORMAL or n == chunk_prints.MOST or i + 1 == len(data):
            out.append((xxhash.xxh3_64(data[start : i + 1]).digest()[:4], n))
            start = i + 1
    return sorted(out)


def brute_likeness(a, b):
    if a == b:
        return 1.0
    total = sum(n for _, n in a)
    return sum(n for d, n in a if (d, n) in set(b)) / total if total else 0.0


def test_fingerprints(spark, docs, empty):
    rows = sorted([*awkward(), ((1 << 63) - 1, "real and largest", None, None, None, None)], key=lambda r: (-(1 << 63) if r[0] is None else -r[0]))
    texts = [r[1] or "" for r in rows]
    own = [brute_print(t) for t in texts]
    got = sorted(chunk_prints.fingerprint_pairs(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect(), key=lambda r: (-(1 << 63) if r.id is None else -r.id))
    assert [r.id for r in got] == [r[0] for r in rows]
    told = lambda s: [(e[:4], e[4]) for e in (base64.urlsafe_b64decode(s)[k : k + 5] for k in range(0, len(base64.urlsafe_b64decode(s)), 5))]
    for i, r in enumerate(got):
        cut, following = len(texts[i]) // 3, texts[(i + 1) % len(texts)]
        new = texts[i][: len(texts[i]) - cut] + following[:cut]
        assert r.n_chars == len(texts[i]) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert told(r.fingerprint) == own[i] and told(r.edited_fingerprint) == brute_print(new)
        assert r.near_edited == pytest.approx(brute_likeness(own[i], brute_print(new))) and r.near_next == pytest.approx(brute_likeness(own[i], own[(i + 1) % len(own)]))
    assert chunk_prints.fingerprint_pairs(empty).count() == 0
    assert chunk_prints.fingerprint_pairs(docs.where("doc_id = 16").limit(1)).first().near_next == 1.0
    long = sentence(random.Random(1), 90_000)
    assert chunk_prints.containment(chunk_prints.print_of(long), chunk_prints.print_of("new words in front of it " + long)) > 0.99


def test_an_id_of_many_rows_is_dealt_to_many_ranges(spark, tmp_path):
    """A third of the rows has no id: order, neighbours and offsets are right, and no range holds them all."""
    rng = random.Random(11)
    rows = [(None if i % 3 == 0 else i, sentence(rng, rng.randint(0, 30))) for i in range(600)] + [((1 << 63) - 1, "largest")]
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    parts = collections.Counter(r.part for r in chunk_prints.next_documents(df).where("own and none").select("part").collect())
    assert len(parts) >= 2 and max(parts.values()) < 200
    tie = {t: r.h for t, r in zip((t for _, t in rows), spark.createDataFrame(rows, "doc_id long, text string").select(F.xxhash64("text").alias("h")).collect())}
    order = sorted(rows, key=lambda r: ((1 << 63) - 1 if r[0] is None else r[0], r[0] is None, tie[r[1]]), reverse=True)
    following = {r: order[(k + 1) % len(order)][1] for k, r in enumerate(order)}
    want = collections.Counter((r[0], hashlib.sha256(chunk_prints.edited(r[1], n).encode()).hexdigest()) for r, n in following.items() for _ in range(rows.count(r)) if rows.count(r) == 1)
    got = collections.Counter((r.id, r.edited_sha256) for r in chunk_prints.fingerprint_pairs(df).collect())
    assert sum(got.values()) == len(rows) and not want - got
    manifest, dictionary = token_files.write_token_files(df, token_files.tokenizer_path(), f"file://{tmp_path}/ids")
    told = sorted(token_files.read_token_files(manifest, dictionary).collect(), key=lambda r: r.start)
    assert [r.id for r in told] == [r[0] for r in reversed(order)] and manifest.select("part").distinct().count() >= 3
    assert all(a.start + a.n_tokens == b.start for a, b in zip(told, told[1:]))
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_fingerprints_of_the_fixture_are_short_and_tell_texts_apart(spark):
    rows = chunk_prints.op5_chunk_fingerprints(spark, SF).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sum(len(r.fingerprint) for r in rows) < 0.06 * sum(len(t.encode()) for t in texts.values())
    long = [r for r in rows if r.n_chars >= 300]
    assert all(r.near_edited > r.near_next for r in long if r.near_next < 1) and np.mean([r.near_edited for r in long]) > 0.55


# mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= set(over)
    return out


def check_mix(rows, got):
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    targets = brute_targets(dict(sizes))
    assert sorted(str((g.id, g.size)) for g in got) == sorted(str((r[0], len(WORD.findall(r[1] or "")))) for r in rows)
    by = collections.defaultdict(list)
    for g in got:
        assert g.taken == g.copies * g.size and 0 <= g.taken <= 2 * g.size
        by[round(g.target, 6), g.source_size].append(g)
    for s, t in targets.items():
        group = by[round(t, 6), sizes[s]]
        assert group, (s, t)
    for (t, size), group in by.items():
        names = [s for s in targets if round(targets[s], 6) == t and sizes[s] == size]
        assert abs(sum(g.taken for g in group) - t * len(names)) <= len(names) * (0.5 * max(g.size for g in group) + 1e-6)


def test_mixing(spark, docs, empty):
    got = mixing.mix(docs).collect()
    check_mix(awkward(), got)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(empty).count() == 0 and mixing.take_mix(empty).count() == 0
    taken = mixing.take_mix(docs)
    assert taken.columns == docs.columns and taken.count() == sum(g.copies for g in mixing.mix(docs, told_by=tuple(docs.columns)).collect())


def test_equal_rows_are_dealt_apart(spark):
    """A third of the rows is one row; two rows that differ in another column keep their own copies at every run."""
    rows = [(1, "one two three", None, "s", 1, None)] * 5000 + [(i, f"w{i} and more of it", "en", "s" if i % 2 else "t", i, 0.5) for i in range(2, 300)] + [(7000, "a b", "en", "s", None, 0.1), (7000, "a b", "fr", "s", None, 0.2)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df).collect()
    check_mix(rows, got)
    assert len({(g.id, g.row, g.copy) for g in got}) == len([r for r in rows if r[0] != 7000]) + 2
    taken = [sorted(map(str, mixing.take_mix(df.repartition(n)).collect())) for n in (2, 5)]
    assert taken[0] == taken[1] and len(taken[0]) == sum(g.copies for g in mixing.mix(df, told_by=tuple(df.columns)).collect())


def test_mixing_many_levels(spark):
    rng = random.Random(3)
    rows = [(i, sentence(rng, rng.randint(0, 12)), None, "hot" if i % 3 == 0 else f"s{i % 7}", None, None) for i in range(6000)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    check_mix(rows, got)
    hot = [g for g in got if g.id % 3 == 0 and g.size]
    rate = hot[0].target / hot[0].source_size
    assert abs(np.mean([g.copies for g in hot]) - rate) < 0.05 and {g.copies for g in hot} <= {int(rate), int(rate) + 1}


# token files


def test_token_files(spark, docs, empty, tmp_path):
    library = Tokenizer.from_file(token_files.tokenizer_path())
    rows = sorted(awkward(), key=lambda r: (1 << 63 if r[0] is None else r[0]))
    manifest, dictionary = token_files.write_token_files(docs, token_files.tokenizer_path(), f"file://{tmp_path}/ids")
    got = sorted(token_files.read_token_files(manifest, dictionary).collect(), key=lambda r: r.start)
    assert [r.id for r in got] == [r[0] for r in rows]
    start = 0
    for r, row in zip(got, rows):
        ids = [*library.encode(row[1] or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    first = min(manifest.collect(), key=lambda m: m.start)
    file = token_files.TokenFile(first.uri, dictionary)
    assert zlib.crc32(file.ids(0)) == got[0].ids_crc32 and zlib.crc32(file.ids(first.n_docs - 1)) == got[first.n_docs - 1].ids_crc32
    file.close()
    with pytest.raises(ValueError, match="another dictionary"):
        token_files.TokenFile(first.uri, dictionary + b"x")
    manifest, dictionary = token_files.write_token_files(empty, token_files.tokenizer_path(), f"file://{tmp_path}/none")
    assert token_files.read_token_files(manifest, dictionary).count() == 0 and dictionary == b""


def test_chunked_ids_are_the_librarys():
    encoder = token_files.IdEncoder(token_files.tokenizer_path())
    rng = random.Random(2)
    for text in ["", "a\x1c\x1d b", "don't  stop\n\n now", "<|endoftext|>"] + ["".join(rng.choice("ab \n\té😀0's1!　\xa0​\x0b,") for _ in range(50)) for _ in range(500)]:
        assert encoder.encode(text) == np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


# top-k


def test_exact_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.4, 24)]) for i in range(400)]
    rows += [(500, None), (550, [0.1, None] + [0.0] * 22), (600, [float("nan")] * 24), (650, [float("inf")] * 24), (None, [0.1] * 24), (700, rows[50][1]), (701, rows[50][1]), (50, rows[50][1]), (750, [0.5] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).repartition(5)
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good[i] = np.floor(256 * np.array(v + [0.0] * (24 - len(v))))
    want = []
    for q in (i for i in good if i % 50 == 0):
        ranked = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(ranked)]
    got = exact_topk.exact_top_k(df, df.where("vec_id % 50 = 0"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert exact_topk.exact_top_k(df, df.limit(0)).count() == 0 and exact_topk.exact_top_k(df.limit(0), df.where("vec_id = 50")).count() == 0
    B.HELD, B.STREAMED, sizes = 3, 60, (B.HELD, B.STREAMED)
    assert sorted(map(tuple, exact_topk.exact_top_k(df, df.where("vec_id % 50 = 0")).collect())) == sorted(want)
    B.HELD, B.STREAMED = sizes
    few = df.where("vec_id in (50, 3)")
    assert exact_topk.exact_top_k(few, few.where("vec_id = 50")).count() == 1


def test_products_beyond_doubles(spark):
    rng = random.Random(8)
    rows = [(i, [float(rng.randint(-(1 << 22), 1 << 22)) + 1 / 256 * rng.randint(0, 255) for _ in range(5)]) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    want = []
    for q in (0, 50):
        ranked = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(ranked)]
    assert max(abs(w[3]) for w in want) > 1 << 53
    assert sorted(map(tuple, exact_topk.exact_top_k(df, df.where("vec_id % 50 = 0")).collect())) == sorted(want)


# SimHash


def brute_fingerprint(text, n=3):
    words = WORD.findall("".join(c.lower() if c in string.ascii_uppercase else c for c in text))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_groups(ids, fps, radius=3):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, x in enumerate(ids):
        least[root(i)] = min(least.get(root(i), 1 << 63), 1 << 63 if x is None else x)
    return [None if least[root(i)] == 1 << 63 else least[root(i)] for i in range(len(ids))]


def test_simhash(docs, empty):
    rows = awkward()
    fps = [brute_fingerprint(r[1] or "") for r in rows]
    got = simhash.simhash_groups(docs).collect()
    assert sorted(str((r.id, r.fp % (1 << 64), r.component)) for r in got) == sorted(str((r[0], f, c)) for r, f, c in zip(rows, fps, brute_groups([r[0] for r in rows], fps)))
    assert simhash.simhash_groups(empty).count() == 0 and simhash.near_dedup(empty).count() == 0
    kept = simhash.near_dedup(docs, words=3, radius=3, bits=64, segment=32)
    assert {r.doc_id for r in kept.collect()} == {r.component for r in got} and kept.columns == docs.columns


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 60])
def test_simhash_links_lose_nothing(spark, bucket):
    """Dense and sparse clouds of fingerprints, chains through both halves: the same components as all pairs."""
    rng = random.Random(4)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(40):
            f = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps | {rng.getrandbits(64) for _ in range(200)} | {0, 1, 7, (1 << 64) - 1})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f, f) for f in signed], "node long, f0 long")
    links = components(simhash.fingerprint_links(nodes, bucket=bucket)).collect()
    root = {r.a: r.root for r in links}
    want = collections.defaultdict(set)
    for f, g in zip(signed, brute_groups(range(len(fps)), fps)):
        want[g].add(f)
    have = collections.defaultdict(set)
    for f in signed:
        have[root.get(f, f)].add(f)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))


def test_components_of_a_chain(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(5, 5), (9, 8), (1000, 1001), (None, 3)], "a long, b long")
    got = {r.a: r.root for r in components(links).collect()}
    assert all(got[i] == 0 for i in range(1, n + 1)) and got[1001] == 1000
    assert components(links.limit(0)).count() == 0


# pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, SF)
        if name != "pieces":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        seen[name] = (before, docs.collect())
        docs = spark.createDataFrame(seen[name][1], docs.schema)
    before, after = seen["quality"]
    kept = {r.doc_id for r in after}
    good = [r.doc_id for r in before if labels.get(r.doc_id) == 1]
    bad = [r.doc_id for r in before if labels.get(r.doc_id) == 0]
    assert np.mean([i in kept for i in good]) > 0.97 and np.mean([i in kept for i in bad]) < 0.2
    before, after = seen["lines"]
    assert sorted((r.doc_id, r.text) for r in after) == sorted((i, t) for i, _, _, t in brute_lines([(r.doc_id, r.text) for r in before]))
    assert all(r.n_chars == len(r.text) for r in after)
    before, after = seen["near_duplicates"]
    found = simhash.simhash_groups(spark.createDataFrame(before), **simhash.NEAR).collect()
    assert sorted(r.doc_id for r in after) == sorted({r.component for r in found}) and len(after) < len(before)
    before, after = seen["mixture"]
    count = collections.Counter(r.doc_id for r in after)
    assert max(count.values()) <= 2 and set(count) <= {r.doc_id for r in before}
    words = sum(len(WORD.findall(r.text)) for r in before)
    assert abs(sum(len(WORD.findall(r.text)) for r in after) - 1.5 * words) < 0.1 * words
    before, after = seen["pieces"]
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.model_path())
    assert sorted((r.doc_id, r.n_tokens) for r in after) == sorted((r.doc_id, len(library.encode(r.text, add_bos=True, add_eos=True))) for r in before)


def test_every_operator_is_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {"pipeline"} <= names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert json.dumps(sorted(__spark_entry__.oracle_sql()))
