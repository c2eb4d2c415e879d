"""The temporal list join against a plain loop, with ties, nulls and clashing columns."""

from __future__ import annotations

import random

from tidelake.llm.url_lists import evaluate, intervals


def test_captures_meet_the_entries_in_force(spark):
    deal = random.Random(5)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "www.b.org", "c.net"]
    captures = [(i, f"http://{deal.choice(hosts)}/p{deal.randrange(3)}", deal.randrange(100), "old") for i in range(200)]
    captures += [(900, None, 5, "n"), (901, "http://a.com/p1", None, "n"), (902, "nonsense", 50, "n"), (903, "http://a.com/p1" + "z" * 50_000, 50, "n"), (0, *captures[0][1:])]
    entries = [(deal.choice([*hosts, "http://b.org/p1"]), f"c{i % 3}", deal.randrange(100), deal.choice(["add", "remove"])) for i in range(40)]
    entries += [("nonsense", "odd", 10, "add"), (None, "c", 1, "add"), ("c.net", "c", None, "add"), ("a.com", "tie", 60, "add"), ("a.com", "tie", 60, "remove")]
    schema = "pattern string, category string, listed_at long, action string"
    found = evaluate(spark.createDataFrame(captures, "page_id long, url string, fetched_at long, blocked string"), spark.createDataFrame(entries, schema)).collect()
    assert len(found) == len(captures)

    def expected(url, at):
        if url is None or at is None:
            return None
        host = url.split("//")[1].split("/")[0] if "//" in url else ""
        labels, hits = host.split("."), []
        keys = {url.lower(), *(".".join(labels[i:]) for i in range(max(1, len(labels) - 1)) if host)}
        for key in keys:
            past = [(t, action, category) for p, category, t, action in entries if p == key and t is not None and t <= at]
            if past and max(past)[1] == "add":
                hits.append((-len(key), key, max(past)[2], max(past)[0]))
        return min(hits)[1:] if hits else None

    want = {(i, u, t): expected(u, t) for i, u, t, _ in captures}
    for r in found:
        hit = want[(r.page_id, r.url, r.fetched_at)]
        assert (r.blocked, r.matched_pattern, r.matched_category, r.listed_at) == ((True, *hit) if hit else (False, None, None, None))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "pattern string, category string, listed_at long, action string")
    assert intervals(none).count() == 0
    captures = spark.createDataFrame([(1, "http://a.com/", 3)], "page_id long, url string, fetched_at long")
    assert [r.blocked for r in evaluate(captures, none).collect()] == [False]
    assert evaluate(captures.limit(0), none).count() == 0


def test_case_addresses_and_final_dots(spark):
    entries = [("Ads.com", "c", 10, "add"), ("ads.com", "c", 20, "remove"), ("10.1.2.3", "ip", 1, "add"), ("2.3", "part", 1, "add"), ("b.org.", "dot", 1, "add"), ("[::1]", "six", 1, "add")]
    captures = [(1, "http://ads.com/x", 50), (2, "http://ADS.com/x", 15), (3, "http://10.1.2.3/", 5), (4, "http://10.9.2.3/", 5), (5, "http://www.b.org./p", 5), (6, "http://[::1]:80/p", 5)]
    found = evaluate(spark.createDataFrame(captures, "page_id long, url string, fetched_at long"), spark.createDataFrame(entries, "pattern string, category string, listed_at long, action string"))
    assert {r.page_id: r.matched_pattern for r in found.collect()} == {1: None, 2: "ads.com", 3: "10.1.2.3", 4: None, 5: "b.org", 6: "[::1]"}


def test_a_hot_pattern_is_split(spark):
    """Most captures have one host, whose entry is toggled many times, and one URL and time repeats."""
    captures = [(i, f"http://a.com/{i}", i % 997) for i in range(3000)] + [(5000 + i, "http://a.com/same", 500) for i in range(2500)] + [(9000 + i, None, None) for i in range(50)]
    entries = [("a.com", f"c{t}", t, "add" if t % 20 == 0 else "remove") for t in range(5, 1000, 5)]
    found = evaluate(spark.createDataFrame(captures, "page_id long, url string, fetched_at long"), spark.createDataFrame(entries, "pattern string, category string, listed_at long, action string")).collect()
    assert len(found) == len(captures)
    for r in found:
        at = None if r.fetched_at is None else r.fetched_at // 5 * 5
        assert r.listed_at == (at if at and at % 20 == 0 else None)
