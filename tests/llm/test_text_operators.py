"""Secrets, host rules, line templates, decontamination, packing, chat: brute force and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tallyframe.llm import chat, decontaminate, host_rules, line_templates, packing, queries, secrets

EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "x" * 5000), (5, "a b c d e f g h " * 400), (6, "a b c d e f g h " * 400), (6, "a b c d e f g h " * 400), (7, "été #$% \n\nété #$% \n"), (None, "no id")]


def edges(spark):
    """Nulls, empty and long texts, repeated rows, and columns with clashing names."""
    rows = spark.createDataFrame(EDGES, "doc_id long, text string")
    return rows.select("*", F.lit("s").alias("source"), F.lit(None).cast("string").alias("n"), F.lit(1).alias("key"), F.lit("x").alias("h"), F.lit(2).alias("first"), F.lit(3).alias("quality"), F.lit(4).alias("row"), F.lit(5).alias("rep"))


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def texts(spark):
    return {r.doc_id: r.text for r in documents(spark).collect()}


# --- quality rules


def rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows: dict = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rule_counts_equal_brute_force(spark):
    found = queries.op5_host_quality(spark, SMALL).collect()
    by_id = texts(spark)
    assert len(found) == len(by_id)
    for r in found:
        n, *rest = rules(by_id[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 20 or 100 * rest[3] > 30 * n) and not (r.base_failed and r.kept)


def test_rule_edges(spark):
    found = host_rules.host_quality(edges(spark).withColumns({"_host": F.lit(1), "_shrunk": F.lit(2), "d": F.lit(3), "q": F.lit(4), "of": F.lit(5), "host": F.lit(6)}))
    got = {(r.doc_id, r.text): r.quality for r in found.collect()}
    assert found.count() == len(EDGES) and {"n", "key", "h", "_host", "_shrunk", "d", "q", "of", "host", "quality"} <= set(found.columns)
    for (_, text), q in got.items():
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == rules(text)
    assert host_rules.host_quality(edges(spark).limit(0)).count() == 0


def test_host_verdict_needs_a_bad_host_and_a_failure(spark):
    good, bad = " ".join(f"w{i} word" for i in range(30)), " ".join(f"w{i} ### $$$" for i in range(30))
    rows = [(i, bad, "junk") for i in range(60)] + [(100, good, "junk")] + [(200 + i, good, "fine") for i in range(60)] + [(300, bad, "fine"), (301, bad, None)]
    kept = {r.doc_id: r.quality.kept for r in host_rules.host_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(kept[i] for i in range(60)) and kept[100] and all(kept[200 + i] for i in range(60)) and kept[300]


def test_a_planted_bad_host_loses_documents_in_the_query(spark, tmp_path):
    """Hosts that fail now and then, and one that fails far more often, though less than half the time."""
    import duckdb

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source")
    good, bad = " ".join(f"w{i} word" for i in range(30)), " ".join(f"w{i} ### $$$" for i in range(30))
    planted = [(10_000 + i, bad if i % 9 < 4 else good, "bad.example") for i in range(360)]
    planted += [(20_000 + i, bad if i // 8 % 20 == 0 else good, f"fine{i % 8}.example") for i in range(800)]
    docs.unionByName(spark.createDataFrame(planted, "doc_id long, text string, source string")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op5_host_quality(spark, str(tmp_path)).collect()
    lost = {r.doc_id for r in rows if not r.kept and not r.base_failed}
    assert lost == {10_000 + i for i in range(360) if i % 9 < 4}
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    told = con.sql(f"select doc_id, kept, host_bad from ({queries.ORACLE_SQL['op5_host_quality']})").fetchall()
    assert sorted(told) == sorted((r.doc_id, r.kept, r.host_bad) for r in rows)


# --- line templates


def lines_left(spark, rows):
    out = line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    return {r.doc_id: r.text for r in out.collect()}


def test_recurring_lines_stay_in_the_first_document(spark):
    passage = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    left = lines_left(spark, [(1, f"one\n{passage}"), (2, f"{passage}\ntwo"), (3, f"three\n{passage}\nend"), (4, None), (5, "")])
    assert left == {1: f"one\n{passage}", 2: "two", 3: "three\nend", 4: None, 5: ""}


def test_variable_fields_make_one_template(spark):
    log = "posted on the board by {} at {} with many thanks"
    names = ["anna", "bert", "carl", "dora", "emil"]
    left = lines_left(spark, [(i, f"own text {n} here\n{log.format(n, 10 + i)}") for i, n in enumerate(names)])
    assert left[0].endswith("many thanks") and all(left[i] == f"own text {n} here" for i, n in enumerate(names) if i)


def test_lines_that_only_begin_alike_stay(spark):
    rows = [(i, "the cat and the " + " ".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=12))) for i in range(6)]
    assert lines_left(spark, rows) == dict(rows)


@pytest.mark.parametrize("n", [2, 5, 500])
def test_near_copies_that_differ_in_different_places_are_one_template(spark, n):
    base = [f"word{chr(97 + i)}" for i in range(20)]
    copies = [" ".join(w if k != 4 + i % 16 else "other" + chr(97 + i % 26) + chr(97 + i // 26) for k, w in enumerate(base)) for i in range(n)]
    left = lines_left(spark, list(enumerate(copies)))
    assert left == {i: copies[0] if i == 0 else "" for i in range(n)}


def test_recurring_values_in_several_fields_make_one_template(spark):
    names = [chr(97 + i) * 3 for i in range(26)]
    lines = [f"the user called {a} has sent a message to user {b} this very day" for a in names for b in names]
    lines = [x.replace("the user called", "today the new user called") for x in lines]
    left = lines_left(spark, list(enumerate(lines)))
    assert left == {i: lines[0] if i == 0 else "" for i in range(len(lines))}


def test_two_templates_of_a_leaf_stay_apart_and_documents_count_once(spark):
    one, two = "all these lines begin {} with the same words here", "all these lines begin {} but then go quite elsewhere"
    rows = [(i, (one, two)[i % 2].format("x" * (i + 1))) for i in range(12)]
    assert lines_left(spark, rows) == {i: t if i < 2 else "" for i, t in rows}
    short = "we all like {} so much"
    several = [(i, "\n".join(short.format(c * (i + 1)) for c in "abc")) for i in range(9)]
    assert lines_left(spark, several) == dict(several)


def test_lines_of_numbers_recur_only_as_they_are(spark):
    rows = [(1, "12 45 33 87 21 90 11 43"), (2, "1999 2000 7 8 9 10 11 12"), (3, "12 45 33 87 21 90 11 43\nlast"), (4, "on day 5 of 7 at 9 and 10 there was a meeting"), (5, "on day 6 of 8 at 3 and 11 there was a meeting")]
    assert lines_left(spark, rows) == {1: rows[0][1], 2: rows[1][1], 3: "last", 4: rows[3][1], 5: ""}


def test_one_id_with_two_texts_loses_the_lines_of_each(spark):
    passage = " ".join(f"word{chr(97 + i)}" for i in range(20))
    rows = [(1, passage), (2, f"own words\n{passage}"), (2, f"{passage}\nother words"), (None, passage)]
    out = line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == [(0, passage), (1, passage), (2, "other words"), (2, "own words")]


def plain_templates(names, rows):
    """dropped lines by doc_id: the same tree in plain Python; names: the hashes that order and deal out lines."""
    lines, docs_of = {}, {}
    for d, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            plain = re.findall(r"[^\x20\x09-\x0D]+", line)
            t = tuple("<*>" if re.search("[0-9<]", x) else x for x in plain)
            t = tuple(plain) if 2 * t.count("<*>") > len(t) else t
            if t:
                lines.setdefault(t, []).append((d, k))
                docs_of.setdefault(t, set()).add(d)
    h = {t: names[at[0]] for t, at in lines.items()}
    assert len(set(h.values())) == len(h) and all(names[x] == h[t] for t, at in lines.items() for x in at)
    leaves: dict = {}
    for t in lines:
        leaves.setdefault((len(t), t[:4]), []).append(t)
    literal = lambda t: sum(x != "<*>" for x in t)
    like = lambda a, b: sum(x == y != "<*>" for x, y in zip(a, b, strict=True)) >= 0.7 * max(literal(a), literal(b))
    leader = {}
    for rest in leaves.values():
        width = 1
        while rest:
            slots: dict = {}
            for t in rest:
                slots.setdefault(h[t][1] % width, []).append(t)
            order = lambda t: (len(docs_of[t]), h[t])
            leaders = []
            for t in sorted((max(s, key=order) for s in slots.values()), key=order, reverse=True):
                leaders += [t] if not any(like(k, t) for k in leaders) else []
            for t in rest:
                leader |= {t: k for k in leaders[::-1] if like(k, t)}
            rest, width = [t for t in rest if t not in leader], min(4 * width, 1024)
    groups: dict = {}
    for t, k in leader.items():
        groups.setdefault(k, []).append(t)
    dropped: dict = {}
    for k, own in groups.items():
        every = set().union(*(docs_of[t] for t in own))
        if len(every) >= (2 if len(k) >= 8 else 10 if len(k) >= 3 else 30):
            for d, at in (x for t in own for x in lines[t]):
                if d != min(every):
                    dropped.setdefault(d, set()).add(at)
    return {d: sorted(at) for d, at in dropped.items()}


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.01"])
def test_dropped_lines_equal_a_plain_tree(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = {(r.doc_id, r.line_no): (r.h.a, r.h.b) for r in line_templates.line_rows(docs).collect()}
    expected = plain_templates(names, [(r.doc_id, r.text) for r in docs.collect()])
    found = {r.doc_id: r.dropped_lines for r in queries.op2_line_dedup(spark, folder).where("size(dropped_lines) > 0").collect()}
    assert found == expected and expected


def test_line_edges(spark):
    out = line_templates.drop_recurring_lines(edges(spark).withColumns({"lines": F.lit(1), "dropped_lines": F.lit(2), "text_key": F.lit(3), "d": F.lit(4)}))
    assert out.count() == len(EDGES) and out.where("doc_id = 6 and text = ''").count() == 2
    assert line_templates.drop_recurring_lines(edges(spark).limit(0)).count() == 0


def test_no_line_of_eight_words_is_left_in_two_documents(spark):
    seen: dict = {}
    for r in line_templates.drop_recurring_lines(documents(spark).select("doc_id", "text")).collect():
        for line in set((r.text or "").split("\n")):
            if len(line.split()) >= 8:
                assert seen.setdefault(line, r.doc_id) == r.doc_id


# --- decontamination


def test_substitutions_are_tolerated_and_clean_texts_left(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    item = [word() for _ in range(40)]
    items = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "one two three four five six"), (5, "and the")], "item_id long, text string")
    changed = [w if i % 9 else word() for i, w in enumerate(item)]
    clean = [word() for _ in range(400)]
    rows = [(1, " ".join(clean[:100] + item + clean[100:])), (2, " ".join(clean[:30] + changed + clean[30:60])), (3, " ".join(clean)), (4, "so One, two: three four five SIX."), (5, "and the " * 50), (6, None), (7, " ".join(clean[:50] + item[:20]).upper()), (8, " ".join(item[:9] + clean))]
    found = {(r.doc_id, r.item_id): r for r in decontaminate.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert set(found) == {(1, 1), (2, 1), (4, 4), (7, 1), (5, 5)}
    assert (found[5, 5].doc_start, found[5, 5].length, found[5, 5].hits) == (0, 2, 1)
    assert (found[1, 1].doc_start, found[1, 1].length, found[1, 1].equal) == (100, 40, 40)
    assert found[2, 1].length > 30 and found[2, 1].equal < found[2, 1].length


def test_every_exact_run_of_thirteen_tokens_is_found(spark):
    tokens = lambda t: re.findall(rb"[^\x00-\x20!-/:-@\[-`{-~]+", (t or "").encode().lower())
    items = {r.item_id: tokens(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    grams: dict = {}
    for i, t in items.items():
        for k in range(len(t) - 12):
            grams.setdefault(tuple(t[k : k + 13]), set()).add(i)
    expected = set()
    for d, t in texts(spark).items():
        t = tokens(t)
        for k in range(len(t) - 12):
            expected |= {(d, i) for i in grams.get(tuple(t[k : k + 13]), ())}
    found = {(r.doc_id, r.item_id) for r in queries.op1_benchmark_decontamination(spark, SMALL).collect()}
    assert expected <= found and expected


def plain_overlaps(docs, items):
    """By the definition: diagonals with a seed, on each the longest stretch of enough equal tokens, of these the one with the most."""
    masks = [tuple(i for i, c in enumerate(m) if c == "1") + (len(m),) for m in decontaminate.MASKS]
    out = {}
    for i, b in items.items():
        own = [(*m[:-1], m[-1]) for m in masks]
        if len(b) < min(m[-1] for m in masks):
            whole = tuple(range(len(b)))
            own = [(*whole, len(b))] + [(*whole[:k], *whole[k + 1 :], len(b)) for k in range(len(b)) if len(b) >= 5]
        for d, a in docs.items():
            hits = Counter()
            for *places, size in own:
                lead, span = places[0], (places[-1] + 1 if len(b) < 8 else size)
                at = {}
                for q in range(len(b) - (size if len(b) >= 8 else span) + 1):
                    at.setdefault(tuple(b[q + k] for k in places), []).append(q)
                for p in range(-lead if len(b) < 8 else 0, len(a) - span + 1):
                    for q in at.get(tuple(a[p + k] for k in places), ()):
                        hits[p - q] += 1
            best = None
            for shift, n in hits.items():
                low, high = max(-shift, 0), min(len(a) - shift, len(b))
                equal = [b[k] == a[k + shift] for k in range(low, high)]
                fits = [(y - x, -x) for x in range(len(equal) + 1) for y in range(x, len(equal) + 1) if 10 * sum(equal[x:y]) >= 8 * (y - x)]
                length, x = max(fits)
                if length >= min(13, 0.8 * len(b)):
                    key = (sum(equal[-x : -x + length]), -(low - x + shift), -(low - x))
                    if best is None or key > best[0]:
                        best = key, (low - x + shift, low - x, length, key[0], n)
            if best:
                out[d, i] = best[1]
    return out


def told(rows):
    return {(r.doc_id, r.item_id): (r.doc_start, r.item_start, r.length, r.equal, r.hits) for r in rows}


def test_overlaps_equal_the_definition(spark):
    """Both ways: nothing is missed and nothing else is found, on the given tables and on texts that repeat themselves."""
    tokens = lambda t: re.findall(rb"[^\x00-\x20!-/:-@\[-`{-~]+", (t or "").encode().lower())
    items = {r.item_id: tokens(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    docs = {d: tokens(t) for d, t in texts(spark).items()}
    shared = set().union(*items.values())
    near = {d: t for d, t in docs.items() if sum(x in shared for x in t) >= 8 and len(t) < 1500}
    found = told(queries.op1_benchmark_decontamination(spark, SMALL).collect())
    assert {k: v for k, v in found.items() if k[0] in near} == plain_overlaps(near, items)
    assert {k[0] for k in found} <= {d for d, t in docs.items() if sum(x in shared for x in t) >= 8}
    rng = random.Random(11)
    some = lambda n, letters: " ".join(rng.choice(letters) for _ in range(n))
    items = [(0, "a " * 40), (1, some(60, "ab")), (2, some(50, "abcd")), (3, "a b c"), (4, "x a b c d y"), (5, "a b " * 25)]
    rows = [(0, "a " * 300), (1, some(250, "ab")), (2, some(200, "abcd")), (3, "a b " * 90), (4, "a a a b " * 40), (5, "b c d y x"), (6, "x a b c z y")]
    ran = decontaminate.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    split = lambda table: {k: tokens(t) for k, t in table}
    assert told(ran.collect()) == plain_overlaps(split(rows), split(items))


def test_repeated_tokens_take_time_and_memory_by_length():
    import time
    import tracemalloc

    np = decontaminate.np
    item = decontaminate.Index([1], ["a " * 10_000])
    for text in ("a " * 500_000, "a b " * 250_000, "a " * 250_000 + "c " * 1_000 + "a " * 249_000):
        w = decontaminate.words(*decontaminate.utf8(decontaminate.pa.array([text])), decontaminate.BREAKS)
        began = time.time()
        tracemalloc.start()
        row = list(item.overlaps(w.hashes, w.first))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert time.time() - began < 30 and peak < 150e6
        assert row == [] if "b" in text else row[0][:6] == (0, 0, 0, 0, 10_000, 10_000)
    assert np.array_equal(item.first, [0, 10_000])


def test_the_longest_stretch_of_enough_equal_tokens_is_found():
    rng = random.Random(7)
    for rate in (0.5, 0.7, 0.8, 0.9):
        for _ in range(50):
            equal = [rng.random() < rate for _ in range(rng.randrange(1, 40))]
            fits = [j - i for i in range(len(equal) + 1) for j in range(i, len(equal) + 1) if 10 * sum(equal[i:j]) >= 8 * (j - i)]
            start, stop = decontaminate._longest_stretch(decontaminate.np.array(equal))
            assert stop - start == max(fits) and 10 * sum(equal[start:stop]) >= 8 * (stop - start)


def test_no_shorter_or_worse_stretch_hides_an_overlap(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    short, long = [word() for _ in range(16)], [word() for _ in range(120)]
    items = spark.createDataFrame([(1, " ".join(short)), (2, " ".join(long))], "item_id long, text string")
    gap = [w if i not in (10, 11) else word() for i, w in enumerate(short)]  # 14 of 16
    fading = [w if i < 20 or i % 4 else word() for i, w in enumerate(long)]  # 20 verbatim, then 75 %
    docs = spark.createDataFrame([(1, " ".join(gap)), (2, " ".join(fading))], "doc_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.overlaps(docs, items).collect()}
    assert set(found) == {(1, 1), (2, 2)}
    assert (found[1, 1].length, found[1, 1].equal) == (16, 14)
    assert 20 <= found[2, 2].length < 120 and found[2, 2].equal >= 0.8 * found[2, 2].length


def test_short_items_tolerate_one_substitution(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon"), (2, "one two three four five six seven")], "item_id long, text string")
    rows = [(1, "x alpha beta OTHER delta epsilon y"), (2, "x other two three four five six seven y"), (3, "one two three four five six other"), (4, "alpha beta other delta other"), (5, "alpha beta"), (6, "one two three four five six")]
    found = {(r.doc_id, r.item_id): (r.length, r.equal) for r in decontaminate.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert set(found) == {(1, 1), (2, 2), (3, 2), (6, 2)} and found[1, 1] == (5, 4)


def test_megabyte_texts(spark):
    """Texts of a megabyte or more: many words, one word, many lines, many keys."""
    long = ["word and more words " * 60_000, "x" * 1_200_000, "line of words here\n" * 60_000, "key = 'abcdefabcdef0123' " * 50_000, "### user: </turn> \\ # " * 50_000]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(long)], "doc_id long, text string, source string").repartition(4)
    q = {r.doc_id: r.quality for r in host_rules.host_quality(docs).collect()}
    assert all((q[i].n_words, q[i].word_chars, q[i].n_symbols, q[i].n_dup_lines, q[i].n_repeat_words) == rules(t) for i, t in enumerate(long))
    assert line_templates.drop_recurring_lines(docs).count() == len(long)
    assert {r.doc_id: len(r.spans) for r in secrets.find_secrets(docs).collect()}[3] == 50_000
    items = spark.createDataFrame([(1, "word and more words " * 5)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.overlaps(docs, items).collect()} == {0}
    assert sum(r.length for r in packing.pack(docs).select("doc_id", "length").where("doc_id = 0").collect()) == 240_001
    turns = docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), "text")
    assert all(r.round_trip for r in chat.format_conversations(turns).select("round_trip").collect())


def test_overlap_edges(spark):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    assert decontaminate.overlaps(edges(spark), items).count() == 0
    assert decontaminate.overlaps(edges(spark).limit(0), items).count() == 0
    assert decontaminate.overlaps(documents(spark), items.limit(0)).count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    docs, items = documents(spark), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    whole = {tuple(r) for r in decontaminate.overlaps(docs, items).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_TOKENS", 300)
    assert {tuple(r) for r in decontaminate.overlaps(docs, items).collect()} == whole


# --- packing


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def whole(pieces, capacity=packing.CAPACITY):
    """Checks the pieces and returns the ids of each document, and the share of padding."""
    docs, sequences = {}, {}
    for r in pieces:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    padded = used = 0
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        total = 0
        for r in s:
            assert r.offset == total and r.length > 0
            total += r.length
        assert total <= capacity and s[0].sequence_length == (total if total & (total - 1) == 0 else capacity)
        padded, used = padded + s[0].sequence_length, used + total
    return docs, 1 - used / padded if padded else 0.0


def test_packed_ids_are_the_tokenizers(spark, tokenizer):
    docs, padding = whole(packing.pack(documents(spark)).collect())
    assert padding < 0.01 and set(docs) == set(texts(spark))
    for d, text in texts(spark).items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        pieces = sorted(docs[d], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in pieces) == b"".join(i.to_bytes(4, "little") for i in ids)
        assert [r.start for r in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))] and all(r.doc_tokens == len(ids) for r in pieces)
    r = queries.op10_harmonic_packing(spark, SMALL).orderBy("doc_id", "start").first()
    first = min(docs)
    assert r.ids_crc32 == zlib.crc32(bytes(min(docs[first], key=lambda x: x.start).ids))


def test_words_encode_as_in_their_text(tokenizer):
    import public_tokenizers
    import pyarrow as pa

    odd = ["Hello's World't I'll <|endoftext|> <|ENDOFTEXT|>x <|startoftext|>.", "É́ Σας ΟΔΟΣ, a.b, c?! don't' 12,3. ﬁ A\x1cB ªº ⓐ ǆ ʰ", "", None, "x" * 3000, "İstanbul ǅ, ", "Ok, x. y.,", "<|", "日本語 テスト。 a b"]
    ids = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))(pa.array(odd))
    assert [i.tolist() for i in ids] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in odd]


def test_classes_hold_a_fixed_count():
    packer = packing.Packer(capacity=64, classes=8)
    for i in range(9):
        packer.add((i, None), 20)  # class 3
    assert [[d for (d, _), _, _ in b] for b, _ in packer.open] == [[0, 1, 2], [3, 4, 5], [6, 7, 8]]
    packer.add((9, None), 70)  # a long document fills the gaps
    assert [sum(b - a for _, a, b in s) for s in packer.drain()] == [64, 64, 64]
    packer.finish()
    assert [sum(b - a for _, a, b in s) for s in packer.drain()] == [32, 16, 8, 2]


def test_packing_edges(spark):
    docs, _ = whole(packing.pack(edges(spark)).collect())
    assert docs[1][0].doc_tokens == docs[2][0].doc_tokens == docs[3][0].doc_tokens == 1
    assert sum(r.length for r in packing.pack(edges(spark)).where("doc_id = 6").collect()) == 2 * (3200 + 1)
    assert packing.pack(edges(spark).limit(0)).count() == 0


# --- secrets


def test_base_spans_equal_the_patterns(spark):
    kinds = {"assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}
    keep = {"assign": lambda m: len(m[2]) >= 12, "access": lambda m: len(m[0]) >= 18, "hex": lambda m: len(m[0]) >= 16}
    by_id = texts(spark)
    for r in queries.op4_secret_scan(spark, SMALL).collect():
        found = [(m.start(), k, name, m.end()) for k, (name, p) in enumerate(kinds.items()) for m in p.finditer(by_id[r.doc_id]) if keep[name](m)]
        text = ",".join(f"{name}:{a}:{b}" for a, _, name, b in sorted(found))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(f[2] == k for f in found) for k in kinds)
        assert [s for s in r.spans.split(",") if s and not s.startswith("random")] == [s for s in text.split(",") if s]


def test_random_strings_are_told_from_words():
    v = secrets.encoding()
    got = lambda t: [t[a:b] for k, a, b in secrets.spans(t, v) if k == "random"]
    assert got("use xK9qZ2mVbT7rLw4NcY8dQ1 now") == ["xK9qZ2mVbT7rLw4NcY8dQ1"]
    for plain in ("a 123e4567-e89b-12d3-a456-426614174000 b", "DA39A3EE5E6B4B0D3255BFEF95601890AFD80709", "the_quick_brown_fox_version_2", "internationalization_of_things_2024", "CamelCaseIdentifierName42", "2024-01-05/2024-02-07-2024", "x" * 40):
        assert got(plain) == []
    assert [k for k, _, _ in secrets.spans("API_KEY = 'abcdefabcdef0123'", v)] == ["assign", "hex"]


def test_random_spans_equal_a_plain_search(spark):
    v = secrets.encoding()
    joint, letters = re.compile("[_/-]+"), "abcdefghijklmnopqrstuvwxyz"

    def part(p):  # a word (capital, then two small letters or more, again and again), capitals, or a number
        digits = len(p) - len(p.rstrip("0123456789"))
        if digits == len(p):
            return True
        p = p[: len(p) - digits]
        if digits > 4:
            return False
        pieces = re.sub("([A-Z])", r" \1", p).split()
        return len(p) > 1 and p.isupper() or all(len(x.lstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ")) > 1 and set(x[1:]) <= set(letters) for x in pieces)

    def known(run):
        digest = len(run) in (32, 40, 48, 56, 64, 96, 128) and (not set(run) - set("0123456789abcdef") or not set(run) - set("0123456789ABCDEF"))
        uuid = [len(x) for x in run.split("-")] == [8, 4, 4, 4, 12] and not set(run) - set("0123456789abcdefABCDEF-")
        body = run.rstrip("_/-")
        return digest or uuid or not set("=+") & set(run) and bool(body) and all(part(p) if p else False for p in joint.split(body))

    ascii_ = lambda f: lambda x: any(f(c) for c in x if c.isascii())
    kinds = [ascii_(str.isdigit), ascii_(str.islower), ascii_(str.isupper)]
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    rows = [*(r.text for r in table), "x QWxhZGRpbjpvcGVuIHNlc2FtZXB3ZA== y", "MyCamelCaseNameWithoutDigits HTTPServerOfThings_2 /usr/local/lib/python3/site-packages token = 'Zx81kQ2mVbT7rLw4NcY8' Zx81kQ2mVbT7rLw4NcY8d"]
    total = 0
    for text in rows:
        got = secrets.spans(text or "", v)
        base = [x for x in got if x[0] != "random"]
        expected = []
        for m in re.finditer("[A-Za-z0-9+/_-]{20,}={0,2}", text or ""):
            if sum(k(m[0]) for k in kinds) > 1 and not known(m[0]) and not any(a < m.end() and m.start() < b for _, a, b in base) and len(m[0]) / len(v.encode_ordinary(m[0])) < 2.4:
                expected.append(("random", *m.span()))
        assert [x for x in got if x[0] == "random"] == expected
        total += len(expected)
    assert total > 1


def test_long_runs_take_linear_time():
    v = secrets.encoding()
    for text in ("a" * 60 + "1x", "aB" * 40_000, "Aa" * 40_000 + "1", "a_" * 400_000, "word" * 250_000 + "9x9", "-" * 10**6, "0123456789abcdef " * 60_000, "key1=" * 10**5 + "token: " * 10**5):
        secrets.spans(text, v)
    assert len(secrets.spans("password = 'abcdefabcdef0123' " * 30_000, v)) == 60_000


def test_secret_edges(spark):
    found = secrets.find_secrets(edges(spark)).collect()
    assert len(found) == len(EDGES) and all(r.spans == [] for r in found)
    assert secrets.find_secrets(edges(spark).limit(0)).count() == 0


# --- chat


TURNS = [
    (1, 0, "user", "\\### Assistant: </turn> ok"), (1, 1, "assistant", "\\### Assistant: </turn> ok"), (1, 1, "assistant", "tie"),
    (2, 0, None, None), (2, None, "a: b", "### x: y</turn>\n### z: "), (3, 5, "assistant", "back\\slash # : é\n"), (3, 4, "system", ""), (3, 4, "system", ""), (None, 1, "user", "no id"), (4, 0, "user", "\\"), (4, 1, "assistant", "</turn"), (5, 0, "we##ird: </turn>\n", "#" * 7),
]


def test_conversations_round_trip(spark):
    rows = spark.createDataFrame([(*t, "x") for t in TURNS], "conv_id long, turn long, role string, text string, formatted string")
    found = {r.conv_id: r for r in chat.format_conversations(rows).collect()}
    by_id: dict = {}
    for c, turn, role, text in sorted(TURNS, key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        by_id.setdefault(c, []).append((role or "", text or ""))
    assert set(found) == set(by_id)
    for c, turns in by_id.items():
        r = found[c]
        assert r.round_trip and [tuple(t) for t in r.turns] == turns
        assert sum(r.loss_runs) == len(r.formatted)
        at, masked = 0, ""
        for k, n in enumerate(r.loss_runs):
            masked += r.formatted[at : at + n] if k % 2 else ""
            at += n
        assert re.sub(r"(?s)\\(.)", r"\1", masked) == "".join(t for role, t in turns if role == "assistant")


def test_plain_texts_are_written_as_they_are(spark):
    rows = spark.createDataFrame([(1, 0, "user", "plain # text: ok")], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(rows).first().formatted == "### user: plain # text: ok</turn>\n"
    assert chat.format_conversations(rows.limit(0)).count() == 0


def test_chat_query(spark):
    turns: dict = {-7: [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]}
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    found = queries.op8_chat_formatting(spark, SMALL).collect()
    assert {r.conv_id for r in found} == set(turns)
    for r in found:
        loss = "".join(t for role, t in turns[r.conv_id] if role == "assistant")
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in turns[r.conv_id]).encode()).hexdigest()
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns[r.conv_id]), len(loss), hashlib.sha256(loss.encode()).hexdigest())
