"""Repeated passages against brute force over all windows of words and all lines."""

import random

import pytest
from pyspark.sql import functions as F

from stridelake.llm import passages

SCHEMA = "doc_id long, text string"
SIZE, SLACK = passages.MIN_WORDS, passages.SPREAD - 1
BIG = 1 << 63


def words_of(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def documents():
    rng = random.Random(12)
    passage = words_of(rng, 30) + ", " + words_of(rng, 25) + ". " + words_of(rng, 4)
    line = words_of(rng, 26)
    rows = [(1, f"{words_of(rng, 9)} {passage} {words_of(rng, 12)}.")]
    rows += [(10 + i, f"{words_of(rng, 7)}. {words_of(rng, 3 + i)} {passage.upper() if i % 2 else passage} {words_of(rng, 5)}. {words_of(rng, 6)}") for i in range(5)]
    rows += [(20 + i, f"{words_of(rng, 7)}\n  {line.title()}!\n\n{words_of(rng, 30)}") for i in range(3)]
    rows += [(30, words_of(rng, 80)), (31, " ".join(["same"] * 90)), (32, words_of(rng, 24)), (33, ""), (33, None), (34, f"{words_of(rng, 3)} {' '.join(passage.split()[:24])} {words_of(rng, 3)}")]
    rows += [(None, f"{words_of(rng, 40)} {passage}"), (BIG - 1, words_of(rng, 5) + " " + passage), (10, dict(rows)[10]), (40, "x" * 300_000), (41, words_of(rng, 30_000) + "\n" + passage)]
    return rows, passage, line


def places(text):
    return [(m.start(), m[0].lower()) for m in passages.WORD.finditer(text or "")]


def brute(rows):
    """Per document: the runs of word places that windows with an earlier occurrence cover."""
    first, out = {}, {}
    for i, text in sorted({(BIG if i is None else i, t or "") for i, t in rows}):
        words = [w for _, w in places(text)]
        gone = set()
        for p in range(len(words) - SIZE + 1):
            j, q = first.setdefault(tuple(words[p : p + SIZE]), (i, p))
            if j != i or p >= q + SIZE:
                gone |= set(range(p, p + SIZE))
        out.setdefault(i, set()).update(gone)
    return out


def test_spans_cover_every_repeat_but_its_edges(spark):
    rows, passage, line = documents()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("removed", F.lit("clash")).withColumn("row", F.lit(1)).repartition(3)
    want, got = brute(rows), {}
    texts = {BIG if i is None else i: t or "" for i, t in rows}
    for r in passages.repeated_passages(df).collect():
        i = BIG if r.id is None else r.id
        got.setdefault(i, set()).update(k for k, (at, _) in enumerate(places(texts[i])) if r.begin <= at < r.end)
        assert r.kept_id == {31: 31, 21: 20, 22: 20}.get(i, 1)
    assert {i for i, p in want.items() if len(p) >= SIZE + SLACK} == set(got) - {21, 22} and {21, 22} <= set(got)
    for i, found in got.items():
        assert found <= want[i]
        whole = sorted(want[i])
        assert set(whole[SLACK : len(whole) - SLACK]) <= found
    assert got[21] == want[21] and got[22] == want[22]  # a line is found whole
    cleaned = {r.doc_id: r.text for r in passages.drop_repeats(df).collect()}
    middle = " ".join(passage.split()[16:-16])
    assert all(middle.lower() not in (cleaned[i] or "").lower() for i in (11, 12, 13, 14, 41, None, BIG - 1)) and passage in cleaned[1] and cleaned[30] == dict(rows)[30]
    assert line.title() in cleaned[20] and line.title() not in cleaned[21] + cleaned[22]


@pytest.mark.parametrize("kind", ["line", "paragraph"])
def test_line_units(spark, kind):
    """Lines alone, against a dictionary of normalised lines."""
    rows, _, _ = documents()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    cut = passages.PARAGRAPH if kind == "paragraph" else passages.LINE
    holders, want = {}, set()
    for i, text in sorted({(BIG if i is None else i, t or "") for i, t in rows}):
        at = 0
        for end in [m.end() for m in cut.finditer(text)] + [len(text)]:
            key = tuple(w for _, w in places(text[at:end]))
            if len(key) >= SIZE and holders.setdefault(key, i) != i:
                want.add((i, at, end))
            at = end
    got = {(BIG if r.id is None else r.id, r.begin, r.end) for r in passages.repeated_passages(df, kind=kind).collect()}
    assert got == want and (kind == "paragraph" or want)


def test_empty_and_offsets(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert passages.repeated_passages(none).count() == 0 and passages.drop_repeats(none).count() == 0
    rng = random.Random(3)
    shared = words_of(rng, 45)
    rows = [(1, shared), (2, f"É ü 日本 {shared}! 😀 end"), (3, shared), (3, shared)]
    found = passages.drop_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    for r in found:
        text = cut = dict(rows)[r.doc_id]
        for b, e in reversed(r.removed):
            cut = cut[:b] + cut[e:]
        assert r.text == cut and (r.doc_id == 1) == (cut == text)
    assert sorted(r.text for r in found if r.doc_id == 3) == ["", ""]


def test_word_spans_are_the_patterns():
    rng = random.Random(4)
    for text in ["", "a", "_a_b_", "é1-ü ß́x", "日本 語😀x\U00020000"] + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x3000), rng.randrange(0x1F000, 0x1F700)])) for _ in range(200)) for _ in range(50)]:
        assert [tuple(s) for s in passages.word_spans(text).tolist()] == [m.span() for m in passages.WORD.finditer(text)]
