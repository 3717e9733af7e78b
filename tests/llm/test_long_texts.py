"""Texts of megabytes, and columns whose names the operators use themselves, through every operator and pipeline stage."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from stridelake.llm import chunk_prints, html_text, line_dedup, mixing, passages, quality, sentencepieces, simhash, token_files

CLASH = ("id", "row", "none", "node", "key", "text_", "fp", "f0", "score", "removed", "unit", "copy", "size", "n", "h1", "line", "part", "copies")


def long_texts():
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    words = " ".join(rng.choice(vocabulary) for _ in range(300_000))  # some 2 MB, one line
    lines = "\n".join(" ".join(rng.choice(vocabulary) for _ in range(12)) for _ in range(30_000))
    return [(1, words), (2, words + " and more"), (3, lines), (4, "a" * 2_000_000), (5, "short one"), (6, None), (7, "")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 2}", None if t is None else len(t)) for i, t in long_texts()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASH})


TEXTS = {i: t or "" for i, t in long_texts()}


def test_lines_and_passages(docs):
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert got[3].n_lines == 30_000 and got[3].text == TEXTS[3] and got[2].text == TEXTS[2]
    spans = {r.id: r for r in passages.repeated_passages(docs).collect()}
    assert set(spans) == {2} and spans[2].end - spans[2].begin > len(TEXTS[1]) - 400
    kept = passages.drop_repeats(docs)
    assert {r.doc_id: len(r.text or "") for r in kept.collect()}[2] < 400 and set(docs.columns) <= set(kept.columns)


def test_tokens_and_pieces(spark, docs, tmp_path):
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.model_path())
    for r in sentencepieces.encode_digests(docs, sentencepieces.model_path()).collect():
        ids = library.encode(TEXTS[r.id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    tokens = Tokenizer.from_file(token_files.tokenizer_path())
    manifest, dictionary = token_files.write_token_files(docs, token_files.tokenizer_path(), f"file://{tmp_path}/ids")
    for r in token_files.read_token_files(manifest, dictionary).collect():
        ids = [*tokens.encode(TEXTS[r.id], add_special_tokens=False).ids, 0]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_fingerprints_and_groups(docs):
    rows = {r.id: r for r in chunk_prints.fingerprint_pairs(docs).collect()}
    assert rows[2].near_next > 0.99 and rows[1].n_chars == len(TEXTS[1]) and rows[4].fingerprint
    kept = simhash.near_dedup(docs)
    assert {r.doc_id for r in kept.collect()} == {1, 3, 4, 5, 6} and kept.columns == docs.columns
    groups = {r.id: r.component for r in simhash.simhash_groups(docs).collect()}
    assert groups[7] == 6 and groups[2] == 1


def test_mixture_quality_and_pages(spark, docs):
    taken = mixing.mix(docs).collect()
    assert {r.id: r.size for r in taken} == {i: len(t.split()) for i, t in TEXTS.items()}
    assert mixing.take_mix(docs).columns == docs.columns
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 8)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, labels).count() == 7 and quality.keep_good(docs, labels).columns == docs.columns
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<article><p>"), F.col("text"), F.lit("</p></article>")).alias("html"), *CLASH)
    got = {r.page_id: r.text for r in html_text.extract_pages(pages).collect()}
    assert got[1] == TEXTS[1] and got[4] == TEXTS[4] and got[6] == ""


def test_stages(spark, docs, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    plain = docs.select(*corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, plain, str(tmp_path)).collect()
        assert out or name == "mixture"
    empty = plain.limit(0)
    assert all(stage(spark, empty, str(tmp_path)).count() == 0 for _, stage in corpus_pipeline.STAGES)
    twice = plain.where("doc_id = 5").unionByName(plain.where("doc_id = 5"))
    counts = {name: stage(spark, twice, str(tmp_path)).count() for name, stage in corpus_pipeline.STAGES if name != "mixture"}
    assert counts == {"quality": 2, "lines": 2, "near_duplicates": 2, "pieces": 2}
