"""Physical lines over several split sizes, encodings, failures by line; the hash tree and the ledger it proves."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import hash_tree
from tallyframe.sources import append, physical


@pytest.fixture(params=[64, 1000, 1 << 20])
def splits(spark, request):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield request.param
    for k, v in kept.items():
        spark.conf.set(k, v)


def test_numbers_and_bytes_do_not_depend_on_splits(spark, splits, tmp_path):
    rng = random.Random(3)
    contents = {f"f{i}.txt": b"".join(bytes(rng.choice(b"abc \xe9\x93\x85,\"") for _ in range(rng.choice([0, 3, 40, 300]))) + rng.choice([b"\n", b"\r\n"]) for _ in range(120)) + b"end" * (i % 2) for i in range(3)}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    found = {}
    for r in physical.numbered_lines(spark, str(tmp_path)).collect():
        found.setdefault(r.file.rsplit("/", 1)[1], {})[r.line_no] = bytes(r.bytes)
    for name, data in contents.items():
        lines = data.split(b"\n")
        lines = lines[:-1] if lines[-1] == b"" else lines
        assert found[name] == dict(enumerate(lines, 1))
    audit = {r.file.rsplit("/", 1)[1]: r for r in physical.encoding_audit(spark, str(tmp_path)).collect()}
    counts = {(r.file.rsplit("/", 1)[1], r.byte): r.n for r in physical.c1_histogram(spark, str(tmp_path)).collect()}
    for name, data in contents.items():
        assert audit[name].conserved and audit[name].not_of_the_encoding == 0
        assert audit[name].c1_bytes == sum(0x80 <= b <= 0x9F for b in data)
        assert {b: n for (f, b), n in counts.items() if f == name} == {b: data.count(bytes([b])) for b in (0x85, 0x93)}


def test_csv_failures_name_their_line(spark, splits, tmp_path):
    rows = ["year,name,votes", "1996,Ann,5", '1996,"B, ""x""",6', "1996,short", "", '1996,"open,7', "1996,a,b,c", "1998,Zoë,8"]
    (tmp_path / "a.csv").write_bytes(("﻿" + "\r\n".join(rows) + "\r\n").encode() + b"1998,\xe9,9\n")
    (tmp_path / "b.csv").write_bytes(b"year,name,votes\n2000,only,1")
    found = {(r.file.rsplit("/", 1)[1], r.line_no): (r.year, r["name"], r.votes, r.failure_codes) for r in physical.physical_csv(spark, str(tmp_path), ["year", "name", "votes"]).collect()}
    assert found["a.csv", 2] == ("1996", "Ann", "5", []) and found["a.csv", 3] == ("1996", 'B, "x"', "6", []) and found["a.csv", 8] == ("1998", "Zoë", "8", []) and found["b.csv", 2] == ("2000", "only", "1", [])
    assert {k[1]: v[3] for k, v in found.items() if v[3]} == {4: ["width"], 5: ["blank"], 6: ["open_quote"], 7: ["width"], 9: ["encoding"]}
    latin = physical.physical_csv(spark, str(tmp_path / "a.csv"), ["year", "name", "votes"], physical.LATIN).where("line_no = 9").first()
    assert latin["name"] == "é" and latin.failure_codes == []
    with pytest.raises(ValueError, match=r"a.csv line 4: width"):
        physical.accepted(physical.physical_csv(spark, str(tmp_path / "a.csv"), ["year", "name", "votes"]), "votes")
    with pytest.raises(ValueError, match="header"):
        physical.physical_csv(spark, str(tmp_path), ["year", "votes"])


def test_json_lines_fail_by_line(spark, splits, tmp_path):
    lines = ['{"a":1,"b":"x"}', "", "[1]", '{"a":"text","b":"y"}', "{", '{"b":"z"}', '{"a":1,"a":2}']
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    found = {r.line_no: (r.a, r.b, r.failure_codes) for r in physical.physical_jsonl(spark, str(tmp_path / "x.jsonl"), "a long, b string").collect()}
    assert {k: v[2] for k, v in found.items()} == {1: [], 2: ["blank"], 3: ["not_an_object"], 4: ["types"], 5: ["not_an_object"], 6: [], 7: ["not_an_object"]}
    assert found[1][:2] == (1, "x") and found[6][:2] == (None, "z")


def plain_root(digests):
    level, peaks = list(digests), []
    n = len(level)
    nodes = [level]
    while len(nodes[-1]) > 1:
        below = nodes[-1]
        nodes.append([hashlib.sha256((below[i] + below[i + 1]).encode()).hexdigest() for i in range(0, len(below) - 1, 2)])
    done = 0
    for k in reversed(range(n.bit_length())):
        if n >> k & 1:
            peaks.append(nodes[k][done >> k])
            done += 1 << k
    return hashlib.sha256(f"{n}:{''.join(peaks)}".encode()).hexdigest()


def test_prefixes_are_proven_and_a_changed_byte_is_named(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = [(i, f"row {i}") for i in range(45)]
    bounds = [0, 13, 13, 21, 45]
    for a, b in zip(bounds, bounds[1:]):
        append.append(spark.createDataFrame(rows[a:b], "k long, v string").repartition(3), path, ["k"])
    digests = [hashlib.sha256(json.dumps({"k": k, "v": v}, separators=(",", ":")).encode()).hexdigest() for k, v in rows]
    lines = append.manifest(spark, path)
    assert [r["root"] for r in lines] == [plain_root(digests[:n]) for n in bounds[1:]]
    assert append.read(spark, path).count() == 45 and append.verify(spark, path).collect() == []
    changed = append.read(spark, path).where("batch = 2").drop("batch").withColumn("v", F.when(F.col("k") == 17, "row_17").otherwise(F.col("v"))).collect()
    spark.createDataFrame(changed, "k long, v string, place long").write.mode("overwrite").parquet(f"{path}/rows/batch=2")
    assert [tuple(r) for r in append.verify(spark, path).collect()] == [(2, 17)]
    assert append.verify(spark, path, upto=2).collect() == []
    spark.createDataFrame(changed[:-1], "k long, v string, place long").write.mode("overwrite").parquet(f"{path}/rows/batch=2")
    assert len(append.verify(spark, path).collect()) == 2
    node = spark.read.parquet(f"{path}/tree/batch=3").collect()
    spark.createDataFrame([(r.level, r.place, "0" * 64) for r in node], hash_tree.NODES).write.mode("overwrite").parquet(f"{path}/tree/batch=3")
    with pytest.raises(ValueError, match="tree"):
        append.append(spark.createDataFrame([(99, "x")], "k long, v string"), path, ["k"])


@pytest.mark.parametrize("n", [1, 2, 7, 8])
def test_peaks(n):
    covered = [i for k, p in hash_tree.peak_places(n) for i in range(p << k, (p + 1) << k)]
    assert covered == list(range(n))
