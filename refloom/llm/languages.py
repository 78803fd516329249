"""Language identification by Bayesian evidence fusion.

The evidence for a language: the text's likelihood under byte-trigram models, a
declared language (markup or metadata), the address suffix, and a prior of the
host.  Priors come from grouped aggregation of the text-only posteriors and are
smoothed hierarchically, host -> parent -> everything:
(sum of posteriors + strength x parent's prior) / (documents + strength).
A further class "und" scores each trigram at the rejection level of the text's
likeliest language; what falls to it, or has no text, is rejected.  The level
comes from the language's own held-out likelihood.  A text whose likeliest
language is the declared one is never "und".

Every declared language has a model, trained on at most ``SAMPLE`` of its
documents, picked by a hash of the id; training counts are 2**15 hashed trigram
bins for each language.  Declarations count by their primary subtag, so "en-US"
is "en".  Texts are scored ``CHUNK`` languages at a time.

Defined cases: null or blank texts, and texts without a letter or digit, are
"und" and rejected; null or unknown declarations, suffixes and hosts are no
evidence, and a null host adds to no prior; repeated rows each get a row; texts of
any length are scored whole; of equally likely languages the first by code is taken;
an empty table gives an empty result; with no declared language at all everything
with text is "und"; of other columns those named in ``carry`` are returned.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.llm.durable import durable, release

SAMPLE = 400
#: So many languages have their models in a task at a time.
CHUNK = 128
#: Python gets so many texts at a time, of which the likelihoods of all are made at once.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
#: Codes that name no single language.
NO_LANGUAGE = ("und", "mul", "zxx", "mis")
BINS = 1 << 15
#: Trigrams of a text are far from independent: their log likelihood counts so much.
TEMPER = 0.25
#: How often a declaration or a suffix tells the language.
DECLARED, SUFFIX = 0.9, 0.6
#: Prior of the class without a language, and strength of a parent's prior.
UNDETERMINED, STRENGTH = 0.001, 20.0
#: Suffixes of countries with one main language (fixed values).
SUFFIXES = {"fr": "fr", "de": "de", "at": "de", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en"}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _trigrams(texts: pa.Array):
    """Hashed trigrams of some texts at a time: (first, text, bin, letters, texts)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + 500_000, "right")) - 1)
        bounds = offsets[at : to + 1] - offsets[at]
        part = data[offsets[at] : offsets[to]]
        letters = np.r_[0, np.cumsum(_LETTER[part])][bounds]
        code = np.where(_LETTER[part], _LOWER[part], 32).astype(np.uint32)
        bins = ((code[:-2] * 65599 + code[1:-1]) * 65599 + code[2:]) if len(code) > 2 else np.zeros(0, np.uint32)
        bins = (bins ^ (bins >> 15)) % BINS
        text = np.repeat(np.arange(to - at), np.diff(bounds))
        same = text[:-2] == text[2:] if len(code) > 2 else np.zeros(0, bool)
        yield at, text[: len(bins)][same], bins[same], np.diff(letters), to - at
        at = to


def _train(batches):
    for batch in batches:
        label = batch.column(0).to_numpy(zero_copy_only=False)
        for first, text, bins, _, n in _trigrams(batch.column(1)):
            key = label[first : first + n][text].astype(np.int64) * BINS + bins
            keys, counts = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts.astype(np.int64))], ["key", "n"])


def code(col: Column) -> Column:
    """The language of a declaration: its primary subtag in lower case ("en" of "en-US"); null if it names none."""
    primary = F.regexp_extract(F.lower(F.trim(col)), r"^([a-z]{2,8})(?:[-_].*)?$", 1)
    return F.when((primary != "") & ~primary.isin(*NO_LANGUAGE), primary)


def train(docs: DataFrame, *, id_col: str, text_col: str, declared_col: str, sample: int = SAMPLE) -> tuple[list[str], DataFrame | None]:
    """Languages, and counts of the trigram bins of each half of their samples."""
    labelled = docs.filter(F.length(text_col) > 0).withColumn("_code", code(F.col(declared_col))).filter(F.col("_code").isNotNull())
    counts = labelled.groupBy(F.col("_code").alias("l")).count().collect()  # as many as there are languages
    counts = sorted((r["l"], r["count"]) for r in counts)
    languages = [l for l, _ in counts]
    if not languages:
        return [], None
    # four times the sample passes a bound on the hash, so that no task ranks a whole language
    shares = docs.sparkSession.createDataFrame([(l, i, min(1.0, 4 * sample / n)) for i, (l, n) in enumerate(counts)], "_code string, _label int, _share double")
    draw = F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 1).cast("double") / 2.0**63
    labelled = labelled.join(F.broadcast(shares), "_code")
    narrow = labelled.select(F.col(id_col).alias("_id"), "_label", draw.alias("_draw"), "_share").filter(F.col("_draw") <= F.col("_share"))
    order = Window.partitionBy("_label").orderBy("_draw", "_id")
    chosen = narrow.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= sample).select("_id", F.col("_label").alias("_of")).distinct()
    chosen = F.broadcast(chosen) if len(languages) <= CHUNK else chosen
    half = F.col("_label") * 2 + F.pmod(F.xxhash64(F.col("_id")), F.lit(2)).cast("int")
    picked = labelled.join(chosen, (labelled[id_col] == F.col("_id")) & (F.col("_label") == F.col("_of"))).select(half.alias("_half"), F.col(text_col).alias("_text"))
    return languages, durable(picked.mapInArrow(_train, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "trigrams", BATCH)


def fit(counts: DataFrame, first: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of the bins of some languages, and their rejection levels.

    The level is halfway between what a trigram of the language scores in the
    half of the sample that the model was not fitted on, and what a bin drawn at
    random scores.
    """
    low, high = first * 2 * BINS, to * 2 * BINS
    got = counts.filter(F.col("key").between(low, high - 1)).toPandas()  # at most languages x bins x halves
    halves = np.bincount(got.key - low, got.n, high - low).reshape(to - first, 2, BINS)
    log = lambda x: np.log((x + 0.05) / (x + 0.05).sum(axis=-1, keepdims=True))
    models, levels = np.zeros((to - first, BINS), np.float32), np.zeros(to - first)
    for i, x in enumerate(halves):
        model = log(x.sum(axis=0))
        models[i], levels[i] = model, ((x * log(x[::-1])).sum() / max(x.sum(), 1) + model.mean()) / 2
    return models, levels


def _likelihoods(model: np.ndarray, level: np.ndarray, last: bool):
    """Append the scores of some languages to those of the rows, at last that of "und".

    Each row has the highest score so far and what "und" scores beside it.
    """

    def run(batches):
        for batch in batches:
            scores, unds, sizes = [], [], []
            for _, text, bins, letters, n in _trigrams(batch.column(1)):
                of = np.stack([np.bincount(text, row[bins], n) for row in model], axis=1) if len(model) else np.zeros((n, 0))
                scores.append(of * TEMPER)
                unds.append(np.bincount(text, minlength=n) * (level[of.argmax(axis=1)] * TEMPER if len(model) else 0.0))
                sizes.append(letters)
            n = batch.num_rows
            of = np.concatenate(scores) if scores else np.zeros((0, len(model)))
            before = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))
            und, top = np.concatenate(unds) if unds else np.zeros(0), of.max(axis=1, initial=-np.inf)
            held = batch.column(3).to_numpy(zero_copy_only=False)
            und, top = np.where(top > held, und, batch.column(4).to_numpy(zero_copy_only=False)), np.maximum(top, held)
            values = np.c_[before, of, und] if last else np.c_[before, of]
            width = values.shape[1]
            lists = pa.LargeListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int64) * width), pa.array(values.ravel())).cast(pa.list_(pa.float64()))
            text = pa.nulls(n, pa.string()) if last else batch.column(1)
            letters = pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), text, lists, pa.array(top), pa.array(und), letters], ["row", "t", "likelihood", "top", "und", "letters"])

    return run


def _score(rows: DataFrame, counts: DataFrame | None, languages: int) -> DataFrame:
    """``row``, the likelihoods of all languages and "und", and letters; ``CHUNK`` languages at a time."""
    rows = rows.withColumns({"likelihood": F.array().cast("array<double>"), "top": F.lit(float("-inf")), "und": F.lit(0.0)})
    kind = rows.schema["row"].dataType.simpleString()
    for first in range(0, max(languages, 1), CHUNK):
        to = min(first + CHUNK, languages)
        fitted = fit(counts, first, to) if languages else (np.zeros((0, BINS)), np.zeros(0))
        scored = rows.select("row", "t", "likelihood", "top", "und").mapInArrow(
            _likelihoods(*fitted, to >= languages), f"row {kind}, t string, likelihood array<double>, top double, und double, letters long"
        )
        last, rows = rows, durable(scored.select("row.*", "likelihood", "letters") if to >= languages else scored, "likelihoods", BATCH)
        if first:
            release(last)
    return rows


def _with(value: Column, f) -> Column:
    """f of a value that is computed once for each row."""
    return F.transform(F.array(value), f)[0]


def _softmax(x: str) -> Column:
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, y: a + y)
    share = lambda e: _with(total(e), lambda z: F.transform(e, lambda v: v / z))
    return _with(F.array_max(x), lambda m: _with(F.transform(x, lambda v: F.exp(v - m)), share))


def identify(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    declared_col: str = "lang",
    host_col: str | None = "source",
    suffix_col: str | None = None,
    sample: int = SAMPLE,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per document: id, declared, language, posterior, text_language, keep, and the columns to carry."""
    languages, counts = train(docs, id_col=id_col, text_col=text_col, declared_col=declared_col, sample=sample)
    names = [*languages, "und"]
    n = len(languages)
    numbers = F.broadcast(docs.sparkSession.createDataFrame(list(zip(languages, range(n), strict=True)), "_code string, _label int"))
    host = F.col(host_col) if host_col else F.lit(None).cast("string")
    suffix = F.col(suffix_col) if suffix_col else F.lit(None).cast("string")
    by_suffix = F.coalesce(*[F.when(suffix == s, l) for s, l in SUFFIXES.items()])
    told = docs.withColumn("_code", code(F.col(declared_col))).join(numbers, "_code", "left").withColumnRenamed("_label", "_declared").drop("_code")
    told = told.withColumn("_code", by_suffix).join(numbers, "_code", "left").withColumnRenamed("_label", "_suffix").drop("_code") if suffix_col else told.withColumn("_suffix", F.lit(None).cast("int"))
    facts = [F.col(id_col).alias("id"), F.col(declared_col).alias("declared"), host.alias("host"), F.col("_declared").alias("told"), F.col("_suffix").alias("hinted")]
    facts += [F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)]
    rows = _score(told.select(F.struct(*facts).alias("row"), F.col(text_col).alias("t")), counts, n)

    # sums of the posteriors by host and language; then by parent (what follows the first dot), then of everything
    alone = rows.filter("letters > 0 and host is not null").select("host", F.posexplode(F.slice(_softmax("likelihood"), 1, n)).alias("i", "p"))
    parent = F.when(F.col("host").contains("."), F.regexp_replace("host", r"^[^.]*\.", "")).otherwise(F.lit(""))
    sums = durable(alone.groupBy("host", "i").agg(F.sum("p").alias("s"), F.count("*").alias("n")).withColumn("parent", parent), "hosts")
    every = {r.i: r.s for r in sums.groupBy("i").agg(F.sum("s").alias("s")).collect()}
    total = sum(every.values()) + 1.0
    overall = F.lit([(every.get(i, 0.0) + 1.0 / n) / total for i in range(n)]) if n else F.array().cast("array<double>")
    lists = lambda df, key: df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("s"), F.max("n").alias("n"))
    smooth = lambda s, count, over: F.transform(s, lambda x, i: (x + STRENGTH * F.get(over, i)) / (F.col(count) + STRENGTH))
    up = lists(sums.groupBy("parent", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")), "parent").select("parent", smooth(F.col("s"), "n", overall).alias("wide"))
    hosts = lists(sums, "host").withColumn("parent", parent)
    priors = hosts.join(up, "parent").select("host", smooth(F.col("s"), "n", F.col("wide")).alias("prior"))

    weight = lambda col, i, rate: F.when(F.col(col) == i, math.log(rate)).when(F.col(col).isNotNull(), math.log((1 - rate) / max(n - 1, 1))).otherwise(0.0)
    prior = F.coalesce("prior", overall)
    spoken = F.slice("likelihood", 1, n)
    known = F.transform(spoken, lambda v, i: v + weight("told", i, DECLARED) + weight("hinted", i, SUFFIX) + F.log(F.get(prior, i) * (1 - UNDETERMINED)))
    # a declaration that the text bears out is evidence against "und" too
    agrees = F.array_position(spoken, F.array_max(spoken)) - 1 == F.col("told")
    und = F.when(agrees, float("-inf")).otherwise(F.col("likelihood")[n] + math.log(UNDETERMINED))
    fused = F.concat(known, F.array(und))
    best = F.array_max("posterior")
    named = lambda x: F.lit(names)[F.array_position(x, F.array_max(x)).cast("int") - 1]
    out = rows.join(priors, "host", "left") if host_col else rows.withColumn("prior", F.lit(None).cast("array<double>"))
    out = out.withColumn("fused", fused).withColumn("posterior", _softmax("fused"))
    language = F.when(F.col("letters") > 0, named(F.col("posterior"))).otherwise("und")
    return out.select(
        F.col("id").alias(id_col),
        "declared",
        language.alias("language"),
        F.when(F.col("letters") > 0, best).otherwise(1.0).alias("posterior"),
        F.when(F.col("letters") > 0, named(F.col("likelihood"))).otherwise("und").alias("text_language"),
        (language != "und").alias("keep"),
        *[F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)],
    )


def pages_evidence(pages: DataFrame) -> DataFrame:
    """Pages as rows for ``identify``: page_id, text, markup language, host, suffix."""
    html = F.coalesce(F.col("html"), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^:]*://([^/?#:]*)", 1))
    return pages.select(
        "page_id",
        bare.alias("text"),
        F.nullif(F.lower(F.regexp_extract(html, r"""(?i)<html[^>]*\blang\s*=\s*["']?([a-z]{2,3})""", 1)), F.lit("")).alias("lang"),
        F.nullif(host, F.lit("")).alias("host"),
        F.nullif(F.substring_index(host, ".", -1), F.lit("")).alias("suffix"),
    )
