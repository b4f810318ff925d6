"""Archives: round trips, the same bytes from any partitioning, plain rules for revisits, damage."""

import gzip
import hashlib
import json
import random
from base64 import b32encode
from pathlib import Path

import pytest
from conftest import SMALL

from tallyframe.llm import warc

SCHEMA = "page_id long, url string, html string"


def plain(rows, least=0):
    """(page_id, url, record_type, refers_to, bytes, digest) by the rule."""
    out, groups = [], {}
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    for r in rows:
        groups.setdefault(r[2] or "", []).append(r)
    for html, members in groups.items():
        body = html.encode()
        target = max(members, key=order)
        first = members.index(target)
        for k, r in enumerate(members):
            own = k == first or len(body) < least
            url = None if r[1] is None else r[1].replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D")
            out.append((r[0], url, "response" if own else "revisit", None if own else target[0], len(body), b32encode(hashlib.sha1(body).digest()).decode()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r[c] for c in ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest")) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = [(i, f"http://h{i % 3}.example/{i}", "".join(rng.choices("abcdé <>\r\n", k=rng.choice([0, 5, 300, 3000])))) for i in range(150)]
    out += [(1000 + i, f"http://copies.example/{i}", "<p>the same page</p>" * 20) for i in range(60)]
    out += [(77, "http://twice.example/", "again and again")] * 40  # rows that repeat in full
    out += [(77, "http://other.example/", "again and again"), (None, None, None), (None, "http://x/ y\r\nWARC-Type: z", "one"), (-5, None, "one"), (5000, "http://long.example/", "z" * 2_000_000)]
    return out


def folder(tmp_path):
    return sorted((p.name, hashlib.sha256(p.read_bytes()).hexdigest()) for p in tmp_path.iterdir())


@pytest.mark.parametrize("least", [0, 16])
def test_records_follow_the_rule_and_bytes_do_not_depend_on_partitions(spark, rows, tmp_path, least):
    mixed = list(rows)
    random.Random(9).shuffle(mixed)
    for name, data, parts in (("a", rows, 2), ("b", mixed, 9)):
        pages = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 as shard", "2 as digest", "3 as payload").repartition(parts)
        warc.write_archives(pages, f"file://{tmp_path}/{name}", least_bytes=least, shard_bytes=40_000, file_bytes=6_000)
        assert found(warc.read_archives(spark, f"file://{tmp_path}/{name}")) == plain(rows, least)
    names = folder(tmp_path / "a")
    assert names == folder(tmp_path / "b")
    assert len({n.split("-")[1] for n, _ in names if n[0] == "s"}) > 5  # several shards, some of several files
    assert any(n.endswith("-00001.warc.gz") for n, _ in names)
    assert not (tmp_path / "a" / "_temporary").exists()


def test_payloads_come_back_and_files_are_plain_gzip(spark, rows, tmp_path):
    warc.write_archives(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/w")
    back = {r["page_id"]: bytes(r["payload"]) for r in warc.read_archives(spark, f"file://{tmp_path}/w", payload=True).where("record_type = 'response' and page_id < 150 and page_id >= 0").collect()}
    assert all(back[i] == (html or "").encode() for i, _, html in rows[:150] if i in back and i != 77)
    listed = [json.loads(x) for x in (tmp_path / "w/manifest.jsonl").read_text().splitlines()]
    assert sum(x["records"] for x in listed) == len(rows)
    for x in listed:
        data = gzip.decompress((tmp_path / "w" / x["file"]).read_bytes())
        assert data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and x["bytes"] == (tmp_path / "w" / x["file"]).stat().st_size


def test_damage_and_missing_manifest_are_found(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    warc.write_archives(pages, path)
    with pytest.raises(Exception, match="there is an archive"):
        warc.write_archives(pages, path)
    file = next(Path(tmp_path / "d").glob("*.warc.gz"))
    whole = file.read_bytes()
    file.write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception, match="manifest"):
        warc.read_archives(spark, path).collect()
    raw = warc._record([("WARC-Record-ID", "<x>")], b"block")
    assert warc.parse_record(raw)[1] == b"block"
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(raw.replace(b"block\r\n", b"blocc\r\n"))
    (tmp_path / "d/manifest.jsonl").unlink()
    with pytest.raises(Exception, match="manifest"):
        warc.read_archives(spark, path).collect()


def test_a_failed_attempt_leaves_nothing_in_the_archive(tmp_path):
    writer = warc.WarcWriter({"path": f"file://{tmp_path}/f"})
    row = {"shard": [0], "page_id": [1], "url": ["u"], "digest": ["d"], "copies": [None], "payload": [b"x"]}
    import pyarrow as pa

    lost = writer.write(iter([pa.RecordBatch.from_pydict(row)]))
    kept = writer.write(iter([pa.RecordBatch.from_pydict(row)]))
    assert lost.files[0][1] != kept.files[0][1]
    writer.commit([kept, None])
    assert sorted(p.name for p in (tmp_path / "f").iterdir()) == ["manifest.jsonl", "shard-00000-00000.warc.gz"]


def test_an_empty_table(spark):
    assert warc.archived(spark.createDataFrame([], SCHEMA)).collect() == []
