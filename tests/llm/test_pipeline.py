"""The pipeline's stages on a corpus with planted cases."""

import random

from conftest import SMALL
from test_text_operators import whole

import corpus_pipeline
from tallyframe.llm.shared import DOCUMENT_COLUMNS, written


def corpus(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("bcdfghjklmnprst", k=2)) + "".join(rng.choices("aeiou", k=1)) + "".join(rng.choices("bcdfghjklmnprst", k=3))
    prose = lambda n: [" ".join(word() for _ in range(12)) for _ in range(n)]
    texts = {i: "\n".join(prose(10)) for i in range(40)}
    texts[100] = texts[0]
    near = texts[1].split(" ")
    near[30] = "changed"
    texts[101] = "moved " + " ".join(near).replace("\n", " ")  # another leading word, so line dedup can't see it
    texts[1] = texts[1].replace("\n", " ")
    passage = " ".join(word() for _ in range(60))
    for i in (5, 6, 7):
        texts[i] = texts[i] + "\n" + passage
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    texts[102] = "\n".join(prose(5)) + "\n" + item
    texts[103], texts[104], texts[105] = "too short", "spam and eggs " * 100, None
    rows = [(i, t, "en", f"s{i % 3}", len(t) if t else None) for i, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), texts, passage


def test_stages(spark):
    docs, texts, passage = corpus(spark)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SMALL), "step")
        steps[name] = docs
        assert name == "packing" or docs.columns == DOCUMENT_COLUMNS
    clean = set(range(40))
    assert ids(steps["quality rules"]) == clean | {100, 101, 102}
    lines = {r.doc_id: r.text for r in steps["line dedup"].collect()}
    assert set(lines) == clean | {100, 101, 102} and lines[100] == lines[0] and [passage in lines[i] for i in (5, 6, 7)] == [True, False, False]
    assert lines[3] == texts[3]
    assert ids(steps["near-dedup"]) == clean | {102} and ids(steps["decontamination"]) == clean
    packed, padding = whole(steps["packing"].collect())
    assert set(packed) == clean and padding < 0.01


def test_run_is_the_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SMALL), name.replace(" ", "-"))
    one_by_one, _ = whole(corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect())
    packed, _ = whole(corpus_pipeline.run(spark, SMALL).collect())
    assert packed == one_by_one and len(packed) > 100


def test_stages_take_empty_and_repeated_rows(spark):
    docs, texts, _ = corpus(spark)
    for rows in (docs.limit(0), docs.unionByName(docs)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SMALL)
            if name == "near-dedup":
                assert out.count() == out.select("doc_id").distinct().count()
            else:
                out.count()


def test_line_dedup_keeps_what_is_found_nowhere_else(spark):
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choices("abcdefghijklmnoprstuvw", k=7)) for _ in range(n))
    shared, own, copied, extra = [words(200), words(200)], words(40), [words(15) for _ in range(12)], words(12)
    texts = {
        1: "\n".join([shared[0], words(30)]),
        2: "\n".join([shared[1], words(30)]),
        3: "\n".join([*shared, own]),  # over 80 % of it is found elsewhere, and it is no copy
        4: "\n".join(copied),
        5: "\n".join([*copied, extra]),  # a near copy of 4, and the first with `extra`
        6: "\n".join([extra, words(60)]),
        7: shared[0],
        8: None,
    }
    rows = [(i, t, "en", "s", len(t) if t else None) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.line_dedup(spark, docs, SMALL)
    out = {r.doc_id: r for r in left.collect()}
    assert set(out) == set(texts)
    assert out[3].text == own and out[3].n_chars == len(own)
    assert out[5].text == texts[4]  # what another document has too is kept there, not in the copy
    assert all(out[i].text == texts[i] for i in (1, 2, 4, 6, 7, 8))
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, left, SMALL).collect()} == {1, 2, 3, 4, 6, 8}


def test_copies_lose_the_same_lines_and_clashing_columns_go(spark):
    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choices("abcdefghijklmnoprstuvw", k=7)) for _ in range(n))
    passage, body = words(60), [words(30) for _ in range(6)]
    changed = [b if i != 3 else b.replace(b.split()[9], "changed") for i, b in enumerate(body)]
    texts = {1: f"{words(80)}\n{passage}", 2: "\n".join([*body, passage]), 3: "\n".join([passage, *changed]), 4: "\n".join([*body, passage])}
    rows = [(i, t, "en", "s", len(t), 1, 2, 3) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, dropped_lines int, quality int, component int")
    out = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, SMALL).collect()}
    assert out == {1: texts[1], 2: "\n".join(body), 3: "\n".join(changed), 4: "\n".join(body)}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() > 0, name
