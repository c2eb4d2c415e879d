"""WARC archives: exact round trips, and the merge of their indexes against a plain sort."""

from __future__ import annotations

import base64
import hashlib
import random

from pyspark.sql import functions as F

from tidelake.llm.warc import LoserTree, capture_history, merge_index, read_index, url_key, write_archives


def test_loser_tree_merges_as_a_sort_does():
    deal = random.Random(1)
    for k in [*range(12), 37]:
        runs = [sorted(deal.randrange(20) for _ in range(deal.randrange(9))) for _ in range(k)]
        assert list(LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def captures(spark):
    rows = [(i, f"http://www.h{i % 3}.example.com/{i % 4}?q={i}", "same\r\n\r\nWARC/1.1\r\nContent-Length: 7\r\n\r\n" if i % 3 else f"page {i} ü") for i in range(60)]
    rows += [(100, None, None), (101, "not a url", ""), (102, "http://x/\r\ny", "z" * 300_000), (None, "http://n/", "page 3 ü"), (7, rows[7][1], rows[7][2])]
    return spark.createDataFrame(rows, "page_id long, url string, html string"), rows


def test_every_record_comes_back_and_the_order_is_global(spark):
    table, rows = captures(spark)
    date = F.timestamp_seconds(F.lit(1_700_000_000) - F.coalesce("page_id", F.lit(0)))
    found = capture_history(table, "page_id", "url", "html", date).collect()
    assert len(found) == len(rows)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = {i: (len((t or "").encode()), digest(t)) for i, _, t in rows}
    top: dict = {}
    for i, _, t in rows:
        top[t or ""] = max(top.get(t or "", -1), -1 if i is None else i)
    texts = {i: t or "" for i, _, t in rows}
    for r in found:
        i = None if r.record_id is None else int(r.record_id)
        assert (r.payload_bytes, r.payload_digest) == want[i]
        first = top[texts[i]]
        assert (r.record_type, r.refers_to) == (("response", None) if i == first else ("revisit", str(first)))
    ordered = sorted(found, key=lambda r: (r.range_no, r.position))
    keys = [(r.url_key, r.timestamp, r.record_id or "") for r in ordered]
    assert keys == sorted(keys)


def test_an_empty_table_and_a_size_bound(spark):
    table, _ = captures(spark)
    date = F.timestamp_seconds(F.lit(0))
    assert capture_history(table.limit(0), "page_id", "url", "html", date).count() == 0
    assert capture_history(table, "page_id", "url", "html", date, least_bytes=10**7).where("record_type <> 'response'").count() == 0


def test_url_keys():
    assert url_key("https://www.Example.com:80/A?b#c") == "com,example)/a?b"
    assert url_key(None) == "" and url_key("http://[bad/") == "http://[bad/"


def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tidelake.llm.warc.ARCHIVE", 100_000)
    rows = [(i, f"http://a.com/{i % 7}", "p" * (20_000 if i % 2 else i)) for i in range(60)]
    table = spark.createDataFrame(rows, "id long, url string, html string").coalesce(1)
    write_archives(table, f"file://{tmp_path}/w", "id", "url", "html", F.lit("2024-01-01").cast("timestamp"))
    sizes = [f.stat().st_size for f in (tmp_path / "w").glob("part-*")]
    assert len(sizes) >= 12 and max(sizes) <= 110_000
    merged = merge_index(read_index(spark, f"file://{tmp_path}/w"), 7).orderBy("range_no", "position").collect()
    assert len(merged) == 60 and [(r.url_key, r.record_id) for r in merged] == sorted((r.url_key, r.record_id) for r in merged)
