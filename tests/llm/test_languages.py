"""Language identification: accuracy on held-out texts, fusion and defined cases."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from refloom.llm import languages
from tests.conftest import DATA

SCHEMA = "doc_id long, text string, lang string, source string, language string, id int"


def frame(spark, rows):
    return spark.createDataFrame([(*x, "clash", 1) for x in rows], SCHEMA)


EN = "the cat sat on the mat and they were happy with the weather of that day "
DE = "die katze sitzt auf der matte und das wetter ist heute sehr schön und ruhig "


def rows():
    return [(i, EN[i % 30 :] * 3, "en", "a.org") for i in range(60)] + [(100 + i, DE[i % 30 :] * 3, "de", "b.de") for i in range(60)]


def test_declared_language_is_overruled_by_the_text(spark):
    extra = [(1000, DE * 4, "en", "a.org"), (1001, EN * 4, None, None), (1002, DE * 4, "xx", "new.host")]
    got = {r.doc_id: r for r in languages.identify(frame(spark, rows() + extra)).collect()}
    assert [got[i].language for i in (1000, 1001, 1002)] == ["de", "en", "de"]
    assert sum(got[i].language == "en" for i in range(60)) >= 59 and all(got[i].keep for i in range(60))


def test_defined_cases(spark):
    extra = [(1, None, "en", "a.org"), (2, "", None, None), (3, "!!! ...", "en", None), (None, EN, "en", "a.org"), (4, EN * 20000, "en", "a.org"), (5, EN, "en", None), (5, EN, "en", None)]
    got = languages.identify(frame(spark, rows()[:40] + rows()[60:] + [(i + 5000, t, l, s) for i, t, l, s in extra if i] + [x for x in extra if x[0] is None])).collect()
    by = {r.doc_id: r for r in got}
    assert [by[5000 + i].keep for i in (1, 2, 3)] == [False] * 3 and by[5001].language == "und"
    assert by[5004].language == "en" and sum(r.doc_id == 5005 for r in got) == 2 and by[None].language == "en"


def test_no_declarations_and_empty(spark):
    assert languages.identify(frame(spark, [])).count() == 0
    got = languages.identify(frame(spark, [(1, EN, None, None), (2, None, None, None)])).collect()
    assert {r.language for r in got} == {"und"}


def test_accuracy_without_the_declaration(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("length(text) > 80")
    hidden = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 != 0, F.col("lang")))
    got = languages.identify(hidden).join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id").filter("declared is null and truth is not null")
    right, n = got.agg(F.sum((F.col("language") == F.col("truth")).cast("int")), F.count("*")).first()
    assert n > 20 and right / n > 0.9


def test_pages_give_markup_host_and_suffix(spark):
    pages = spark.createDataFrame([(1, "https://www.x.de/a", "<html lang='DE-at'><style>p{}</style><p>gut &amp; schön</p></html>"), (2, None, None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in languages.pages_evidence(pages).collect()}
    assert (got[1].lang, got[1].host, got[1].suffix) == ("de", "www.x.de", "de") and "gut" in got[1].text and "p{}" not in got[1].text
    assert (got[2].lang, got[2].host, got[2].text) == (None, None, "")


def test_only_texts_that_resemble_no_language_are_rejected(spark):
    junk = "".join(chr(97 + (i * i * 7 + i // 3 * 11) % 26) for i in range(400))
    clean = [(1, EN + DE, "en", "a.org"), (2, "They were happy 2353820953013749 4550997810720808 2353820953013749", "en", "a.org"), (3, 'token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" the weather', "en", None)]
    extra = [*clean, (4, "ruhig 5755695738806562 4644348398010899 9597024294303453", "de", None), (5, junk, None, None), (6, " ", "en", "a.org"), (7, "?!", "de", "b.de")]
    got = languages.identify(frame(spark, rows() + [(i + 5000, *x) for i, *x in extra])).collect()
    assert sorted(r.doc_id for r in got if not r.keep) == [5005, 5006, 5007]


def test_no_given_document_with_letters_is_rejected(spark):
    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet")
    want = {r.doc_id for r in docs.select("doc_id", "text").collect() if not any(c.isalnum() for c in r.text or "")}
    assert {r.doc_id for r in languages.identify(docs).filter("not keep").collect()} == want


def test_every_declared_language_has_a_model(spark, monkeypatch):
    rng = random.Random(3)
    codes = [f"{a}{b}" for a in "abcdefgh" for b in "klmnopqrs"][:70]
    words = {c: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)] for c in codes}
    docs = [(n * 100 + i, " ".join(rng.choices(words[c], k=20)), [c, c.upper(), f"{c}-XX", f"{c}_yy"][i % 4], None) for n, c in enumerate(codes) for i in range(9 if n < 69 else 3)]
    docs += [(10000 + n, " ".join(rng.choices(words[c], k=20)), None, None) for n, c in enumerate(codes)]
    run = lambda: sorted(tuple(r) for r in languages.identify(frame(spark, docs)).select("doc_id", "language", "text_language", F.round("posterior", 9), "keep").collect())
    want = sorted((i, codes[i - 10000 if i >= 10000 else i // 100]) for i, *_ in docs)
    whole = run()
    assert [r[:2] for r in whole] == want and all(r[4] for r in whole)
    monkeypatch.setattr(languages, "CHUNK", 32)
    assert run() == whole


def posteriors(spark, table):
    """Language and posterior of (id, text, declared, host) rows, fused in plain Python from the fitted models."""
    names, counts = languages.train(frame(spark, table), id_col="doc_id", text_col="text", declared_col="lang")
    models, levels = languages.fit(counts, 0, len(names))
    n, strength = len(names), languages.STRENGTH
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    scored = []
    for i, t, declared, host in table:
        _, _, bins, letters, _ = next(languages._trigrams(pa.array([t or ""])))
        like = models[:, bins].astype(float).sum(axis=1) * languages.TEMPER
        scored.append((i, declared, host, like, len(bins) * levels[like.argmax()] * languages.TEMPER, letters[0]))
    hosts: dict = {}
    for _, _, host, like, und, letters in scored:
        if host is not None and letters:
            hosts.setdefault(host, []).append(soft(np.r_[like, und])[:n])
    parent = lambda h: h.partition(".")[2]
    everything = sum((sum(x) for x in hosts.values()), np.zeros(n))
    overall = (everything + 1 / n) / (everything.sum() + 1)
    wide = {}
    for p in {parent(h) for h in hosts}:
        own = [y for h, x in hosts.items() if parent(h) == p for y in x]
        wide[p] = (sum(own) + strength * overall) / (len(own) + strength)
    prior = {h: (sum(x) + strength * wide[parent(h)]) / (len(x) + strength) for h, x in hosts.items()}
    out = {}
    for i, declared, host, like, und, letters in scored:
        told = names.index(declared) if declared in names else None
        weight = [0.0 if told is None else math.log(languages.DECLARED) if j == told else math.log((1 - languages.DECLARED) / (n - 1)) for j in range(n)]
        known = like + weight + np.log(prior.get(host, overall) * (1 - languages.UNDETERMINED))
        fused = soft(np.r_[known, -np.inf if like.argmax() == told else und + math.log(languages.UNDETERMINED)])
        out[i] = ([*names, "und"][fused.argmax()], fused.max()) if letters else ("und", 1.0)
    return out


def test_posteriors_against_plain_python(spark):
    rng = random.Random(4)
    words = {"en": EN.split(), "de": DE.split(), "fr": "le chat est sur le tapis et il fait beau dans la ville".split()}
    table = [(i, " ".join(rng.choice(words[l]) for _ in range(rng.randrange(1, 12))), rng.choice([l, l, None, "en", "xx"]), rng.choice(["a.org", "b.org", "c.d.de", "plain", None])) for i, l in enumerate(rng.choices(list(words), k=150))]
    table += [(900, "zq xj vv qq", None, "a.org"), (901, "", "en", "a.org"), (902, None, None, None), (903, "!!", "de", "b.org")]
    want = posteriors(spark, table)
    got = languages.identify(frame(spark, table)).collect()
    assert len(got) == len(table)
    for r in got:
        assert (r.language, r.keep) == (want[r.doc_id][0], want[r.doc_id][0] != "und") and r.posterior == pytest.approx(want[r.doc_id][1], rel=1e-5)


def test_python_gets_a_bounded_number_of_texts_at_a_time(spark, monkeypatch):
    used, real = {}, languages.durable

    def noted(df, name, conf=None):
        used[name] = conf
        return real(df, name, conf)

    monkeypatch.setattr(languages, "durable", noted)
    rows = [(i, "some words of a text", "en", "a.b") for i in range(20)]
    languages.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert {used[x]["spark.sql.execution.arrow.maxRecordsPerBatch"] for x in ("trigrams", "likelihoods")} == {"1000"}
