"""URL filters: fixed rules, mined rules, index matching against brute force."""

from __future__ import annotations

from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from refloom.llm import urls

PAGES = "page_id long, url string, host string"
LABELS = "doc_id long, toxic int"


def judged(spark, pages, labels=(), **bounds):
    got = urls.judge(spark.createDataFrame([(i, u, "clash") for i, u in pages], PAGES), spark.createDataFrame(list(labels), LABELS), **bounds)
    return {r.page_id: r for r in got.collect()}


def test_fixed_rules(spark):
    got = judged(
        spark,
        enumerate(
            ["http://EXAMPLE.com/en/x", "https://www.example.com/en/?q", "http://a.net/es/#y", "http://net/fr/", "http://a.net/de/", "x://notnet/es/", "nothing", None, "http://b.org", "a://b://c.com/d", "http://Ünet/es/"]
        ),
    )
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(11)] == [
        ("example.com", "/en/x", "example.com/en/", "block"),
        ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("a.net", "/es/", "net/es/", "block"),
        ("net", "/fr/", "net/fr/", "block"),
        ("a.net", "/de/", None, "allow"),
        ("notnet", "/es/", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("b.org", "", None, "allow"),
        ("b:", "//c.com/d", None, "allow"),
        ("Ünet", "/es/", None, "allow"),
    ]


def test_mined_rules_are_those_of_brute_force(spark):
    sets = [({"a", "b"}, True)] * 30 + [({"a"}, True)] * 5 + [({"a"}, False)] * 40 + [({"b", "c"}, True)] * 25 + [({"c", "d"}, False)] * 30 + [({"e"}, True)] * 3
    rows = spark.createDataFrame([(sorted(s), f) for s, f in sets], "tokens array<string>, unwanted boolean")
    got = {tuple(r["items"]): (r.support, round(r.confidence, 9)) for r in urls.mine_rules(rows, 5, 0.01, 0.8).collect()}
    support, every = Counter(), Counter()
    for s, f in sets:
        for n in range(1, len(s) + 1):
            for c in combinations(sorted(s), n):
                every[c] += 1
                support[c] += f
    rules = {c: support[c] / every[c] for c in every if support[c] >= 5 and support[c] / every[c] >= 0.8}
    kept = {c for c in rules if not any(rules.get(tuple(x for x in c if x != out), -1) >= rules[c] for out in c)}
    base = sum(f for _, f in sets) / len(sets)
    assert got == {c: (support[c], round(rules[c], 9)) for c in kept if rules[c] > base}


def test_mined_rules_block_and_hot_or_repeated_rows_stay(spark):
    pages = [(i, f"http://bad.org/spam/{i}") for i in range(60)] + [(i, f"http://good.org/text/{i}") for i in range(60, 120)] + [(200, "http://bad.org/spam/9?x=1"), (200, "http://bad.org/spam/9?x=1"), (None, None)]
    labels = [(i, int(i < 60)) for i in range(0, 120, 2)] + [(0, None), (None, 1), (0, 0)]
    got = urls.judge(spark.createDataFrame([(i, u, "c") for i, u in pages], PAGES), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(pages)
    assert {r.verdict for r in got if r.page_id is not None and (r.page_id < 60 or r.page_id == 200)} == {"block"}
    assert {r.verdict for r in got if r.page_id is None or 60 <= r.page_id < 120} == {"allow"}


def test_empty(spark):
    assert judged(spark, []) == {}
    assert judged(spark, [(1, "http://x.com/")], [(1, 1)])[1].verdict == "allow"


def test_match_holds_all_items(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"]), (3, ["a", "b", "c"])], "id int, tokens array<string>")
    rules = spark.createDataFrame([(["a", "b"],), (["c"],), (["d"],)], "items array<string>")
    assert sorted((r.id, tuple(r["items"])) for r in urls.match(rows, rules).collect()) == [(1, ("a", "b")), (3, ("a", "b")), (3, ("c",))]
    assert rows.filter(F.col("id") > 9).count() == 0


def test_long_common_paths_do_not_blow_up(spark):
    path = "/".join(f"part{chr(97 + i)}" for i in range(22))
    pages = [(i, f"http://bad.org/{path}/{i}") for i in range(25)] + [(100 + i, f"http://good.org/x/{i}") for i in range(25)] + [(200, "http://other.org/parta/1"), (201, "http://other.org/z/1")]
    got = judged(spark, pages, [(i, 1) for i in range(25)] + [(100 + i, 0) for i in range(25)])
    assert all(got[i].verdict == "block" for i in range(25)) and all(got[100 + i].verdict == "allow" for i in range(25))
    assert got[200].verdict == "block" and got[201].verdict == "allow"
