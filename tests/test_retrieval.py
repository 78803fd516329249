"""Ranked retrieval and near titles against comparing everything with everything."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from refloom.functions.text import _FOREIGN, SPACES, fold
from refloom.operators import near_titles, resolve, retrieval


def corpus(rng, n=400):
    """Titles in which a few words are very common and most are rare."""
    common = ["the", "analysis", "study", "data", "systems"]
    rows = []
    for i in range(n):
        words = rng.sample(common, rng.randint(1, 4)) + [f"w{int(rng.paretovariate(0.6)) % 500:03d}" for _ in range(rng.randint(0, 4))]
        rng.shuffle(words)
        rows.append((rng.choice(["A", "B"]), 1, f"r{i:04d}", " ".join(words)))
    return rows


def brute(refs, rows, k):
    """(ref, source, rec, hits, weight, rank) by scoring every record."""
    out = set()
    words = {r[2]: {w for w in r[3].lower().split() if len(w) >= 3} for r in rows}
    for source in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == source]
        held = Counter(w for r in own for w in words[r[2]])
        weight = {w: math.floor(math.log(1 + len(own) / n) * 1_000_000 + 0.5) for w, n in held.items()}
        for ref, title in refs:
            asked = {w for w in (title or "").lower().split() if len(w) >= 3}
            scored = sorted((-sum(weight[w] for w in asked & words[r[2]]), r[2], len(asked & words[r[2]])) for r in own if asked & words[r[2]])
            out |= {(ref, source, rec, hits, -s, n) for n, (s, rec, hits) in enumerate(scored[:k], 1)}
    return out


def refs_of(rng, rows):
    refs = [(i, rng.choice(rows)[3]) for i in range(80)] + [(100 + i, f"{rng.choice(rows)[3]} the analysis unknown") for i in range(40)]
    return refs + [(200, "the study"), (201, "the analysis study data systems"), (202, None), (203, ""), (204, "to be or"), (205, "nowhere"), (206, refs[0][1])]


@pytest.mark.parametrize("rounds", [(256, 16_384), (1, 8), (0, 0), (12, 40)])
def test_same_top_as_scoring_everything(spark, monkeypatch, rounds):
    monkeypatch.setattr(retrieval, "ROUNDS", rounds)
    rng = random.Random(4)
    rows = corpus(rng)
    refs = refs_of(rng, rows)
    catalog = spark.createDataFrame(rows, "source string, source_rank int, rec_id string, title string")
    got = retrieval.candidates(spark.createDataFrame(refs, "ref_id long, title string"), catalog, 5)
    assert {tuple(r) for r in got.select("ref_id", "source", "rec_id", "hits", "weight", "rank").collect()} == brute(refs, rows, 5)


def test_common_words_read_no_postings(spark, monkeypatch):
    """With the bound, the rows of the joins fall to a small part, and the top five stay."""
    rng = random.Random(5)
    rows = [("A", 1, f"r{i:04d}", f"the analysis of x{i // 6:03d} y{i // 7:03d} systems") for i in range(600)]
    refs = [(i, rows[i * 7][3]) for i in range(60)]
    catalog = spark.createDataFrame(rows, "source string, source_rank int, rec_id string, title string")
    asked = spark.createDataFrame(refs, "ref_id long, title string")
    read = []
    scored = retrieval._scored
    monkeypatch.setattr(retrieval, "_scored", lambda reading, *rest: (read.append(reading.agg(F.sum("holders")).first()[0] or 0), scored(reading, *rest))[1])

    def run(rounds):
        read.clear()
        monkeypatch.setattr(retrieval, "ROUNDS", rounds)
        return {tuple(r) for r in retrieval.candidates(asked, catalog, 5).select("ref_id", "rec_id", "weight", "rank").collect()}, sum(read)

    (bounded, few), (whole, many) = run((16, 64)), run(())
    assert bounded == whole
    assert many > 60 * 1800 and few < many / 50, (few, many)


def test_near_titles_are_all_pairs_within_the_edits(spark):
    rng = random.Random(6)
    letters = "abc "
    left = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))) for i in range(150)]
    right = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))) for i in range(150)] + [(500 + i, t[:3] + t[4:]) for i, t in left[:40]]
    a, b = spark.createDataFrame(left, "ref_id long, title string"), spark.createDataFrame(right, "rec_id long, title string")
    folded = lambda df: df.select("*", fold(F.col("title")).alias("t")).filter("t <> ''")
    for edits in (0, 1, 2, 3):
        every = folded(a).select("ref_id", F.col("t").alias("x")).crossJoin(folded(b).select("rec_id", F.col("t").alias("y"))).withColumn("d", F.levenshtein("x", "y").cast("long")).filter(F.col("d") <= edits)
        got = near_titles.near_titles(a, b, edits)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, every.select("ref_id", "rec_id", "d").collect()))
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Cartesian" not in plan and "Join Cross" not in plan


def test_references_without_a_common_word_are_found_by_edits(spark):
    catalog = resolve_catalog(spark, [("d1", "Deep learning for protein folding"), ("d2", "Shallow ideas")])
    refs = spark.createDataFrame([(1, "x", "Deeplearning forprotein-folding", None, None, None, None, None), (2, "y", "Shallow notions", None, None, None, None, None)], "ref_id long, raw string, title string, authors string, journal string, year string, doi string, arxiv_id string")
    none = {r.ref_id: r.rec_id for r in resolve.best_per_source(refs, catalog).select("ref_id", "found.rec_id").collect()}
    near = {r.ref_id: r.rec_id for r in resolve.best_per_source(refs, catalog, edits=4).select("ref_id", "found.rec_id").collect()}
    assert 1 not in none and near == none | {1: "d1"} and none == {2: "d2"}


def resolve_catalog(spark, rows):
    from refloom.sources import catalogs

    schema = "key string, title string, authors array<string>, year int, venue string, type string, doi string, url string, eeUrl string"
    return catalogs.dblp(spark.createDataFrame([(k, t, ["Jo Ho"], 2018, "J", "a", None, "u", None) for k, t in rows], schema))


def test_of_records_with_one_arxiv_id_the_nearest_title_counts(spark):
    titles = ["Shallow ideas on nothing", "Deep learning for protein folding", "Another paper of a wholly other kind"]
    catalog = resolve_catalog(spark, [(f"k{i}", t) for i, t in enumerate(titles)]).withColumn("arxiv_id", F.lit("2101.10000"))
    refs = spark.createDataFrame([(i, "x", t, None, None, None, None, "2101.10000") for i, t in enumerate(titles)], "ref_id long, raw string, title string, authors string, journal string, year string, doi string, arxiv_id string")
    assert {(r.ref_id, r.title) for r in resolve.arxiv_lookup(refs, catalog).select("ref_id", "found.title").collect()} == set(enumerate(titles))


def test_the_key_of_a_record_is_not_made_for_every_word(spark):
    records = spark.createDataFrame([("s", 1, "a", ["one", "two"]), ("s", 1, "b", ["one", "two", "three"])], "source string, source_rank int, rec_id string, words array<string>")
    words = spark.createDataFrame([("s", "one")], "source string, word string")
    found = retrieval._classes(words, records, 5)
    assert [(r.words, [m.rec_id for m in r.members]) for r in found.collect()] == [(["one"], ["a", "b"])]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.rindex("md5(")


def test_folding_drops_runs_of_foreign_characters_and_keeps_spaces(spark):
    kept = "".join(c for c in SPACES if not c.isascii())
    odd = "".join(chr(c) for c in [*range(0x80, 0x250), *range(0x1670, 0x1690), *range(0x1FF0, 0x2070), *range(0x2FF0, 0x3010), *range(0xFEF0, 0xFF10), 0x1F600, 0x10FFFF])
    rows = spark.createDataFrame([(f"a{odd}b",), (f"a{kept}b",), ("x".join(odd),), (None,), ("",)], "t string")
    got = [r.new for r in rows.select(F.regexp_replace("t", _FOREIGN, "").alias("new")).collect()]
    assert got == [None if r.t is None else "".join(c for c in r.t if c.isascii() or c in kept) for r in rows.collect()]
    # of ASCII characters a single range is asked
    assert _FOREIGN.startswith("[\\x{80}-\\x{10FFFF}&&")


def test_forms_score_as_the_strings_do(spark):
    from refloom.functions import similarity as s

    odd = [None, "", " ", "—", "Déjà vu", "deja  VU", "The data of a long study, again", "the_data of long   study", "again study long a of data The", " x　", "a", "1. Doe J. Déjà vu. Nature. 2001"]
    pairs = spark.createDataFrame([(a, b) for a in odd for b in odd], "a string, b string")
    formed = pairs.select("a", "b", s.forms(F.col("a")).alias("x"), s.forms(F.col("b")).alias("y"))
    for plain, by_forms in ((s.similarity, s.similarity_of_forms), (s.adapter_similarity, s.adapter_similarity_of_forms), (s.free_text_similarity, s.free_text_similarity_of_forms)):
        rows = formed.select("a", "b", plain(F.col("a"), F.col("b")).alias("plain"), by_forms(F.col("x"), F.col("y")).alias("formed")).collect()
        assert [r for r in rows if r.plain != r.formed] == []


def test_checks_and_scores_are_made_once_a_row(spark, monkeypatch):
    """No filter goes before the checks with their expressions in it, and a candidate's title is not folded again for every reference."""
    from refloom.sources import catalogs

    schema = "DOI string, title array<string>, author array<struct<family:string,given:string>>, container_title array<string>, published array<array<int>>, published_print array<array<int>>, published_online array<array<int>>, issued array<array<int>>, created array<array<int>>, URL string, publisher string, update_to array<struct<type:string>>, is_retracted_by array<string>, is_referenced_by_count int"
    item = lambda d, t: (d, [t], [("Doe", "J")], ["Nature"], *[[[2001]]] * 5, "u", "X", [], [], 1)
    titles = ["Deep learning for protein folding", "Deep learning of other things entirely", "Shallow ideas"]
    catalog = catalogs.crossref(spark.createDataFrame([item(f"10.1/{i}", t) for i, t in enumerate(titles)], schema)).unionByName(resolve_catalog(spark, [("d0", titles[0])]))
    refs = spark.createDataFrame([(1, "x", titles[0], "Doe, J.", "Nature", "2001", None, None), (2, f"Doe J. {titles[2]}. Nature. 2001", None, None, None, None, None, None), (3, "y", "Deep nothing", "Doe, J.", None, None, None, None)], "ref_id long, raw string, title string, authors string, journal string, year string, doi string, arxiv_id string")
    plans, keep = {}, resolve.stored
    monkeypatch.setattr(resolve, "stored", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and keep(df, name))
    found = {(r.ref_id, r.found.source, r.found.title) for r in resolve.best_per_source(refs, catalog).collect()}
    assert found == {(1, "CrossRef", titles[0]), (1, "DBLP", titles[0]), (2, "CrossRef", titles[2]), (3, "DBLP", titles[0])}
    assert plans["checked"].count("levenshtein(") <= 6 and "translate(" not in plans["picked"]
    assert {(r.ref_id, r.found.source) for r in resolve.best_per_source(refs, catalog, least=70).collect()} == {(1, "CrossRef"), (1, "DBLP"), (2, "CrossRef")}
