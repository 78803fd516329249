"""Corpus analytics: cohorts, rates, chi-square, detectors, audits and generators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.functions.extract import audit_years
from refloom.functions.similarity import sequence_ratio, windowed_similarity
from refloom.functions.text import bind


def cohort(dataset: Column) -> Column:
    """2016, 2023 or 2025 by name; anything else is 2026."""
    return F.coalesce(*[F.when(dataset.contains(y), y) for y in ("2016", "2023", "2025")], F.lit("2026"))


def cohort_rates(rows: DataFrame) -> DataFrame:
    """Per cohort: references, not found, rate in percent; rows have dataset and status."""
    missing = F.count_if(F.col("status") == "Not Found")
    return rows.groupBy(cohort(F.col("dataset")).alias("cohort")).agg(F.count("*").alias("n"), missing.alias("not_found"), (missing * 100 / F.count("*")).alias("rate"))


def domain_rates(rows: DataFrame) -> DataFrame:
    """Not-found rate by domain and year; the dataset is split at its last underscore."""
    year = F.substring_index("dataset", "_", -1)
    domain = F.expr("left(dataset, greatest(length(dataset) - length(substring_index(dataset, '_', -1)) - 1, 0))")
    return rows.groupBy(domain.alias("domain"), year.alias("year")).agg(F.avg((F.col("status") == "Not Found").cast("double")).alias("rate"))


def year_rates(rows: DataFrame) -> DataFrame:
    """Not-found rate in percent by the year at the end of the dataset's name; rows without status or dataset do not count."""
    known = rows.dropna(subset=["status", "dataset"])
    return known.groupBy(F.substring_index("dataset", "_", -1).alias("year")).agg(F.count("*").alias("n"), (F.avg((F.col("status") == "Not Found").cast("double")) * 100).alias("rate"))


def crosstab(rows: DataFrame, key: str, flag: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count_if(F.col(flag)).alias("yes"), F.count_if(~F.col(flag)).alias("no"))


def chi_square(table: DataFrame) -> DataFrame:
    """Statistic and degrees of freedom of a (yes, no) table, one row per group."""
    totals = table.agg(F.sum("yes").alias("all_yes"), F.sum("no").alias("all_no"))
    both = table.select("yes", "no").join(F.broadcast(totals))  # one row of totals
    share = (F.col("yes") + F.col("no")) / (F.col("all_yes") + F.col("all_no"))
    cell = lambda seen: F.pow(F.col(seen) - share * F.col(f"all_{seen}"), 2) / (share * F.col(f"all_{seen}"))
    return both.agg(F.sum(cell("yes") + cell("no")).alias("statistic"), (F.count("*") - 1).alias("dof"))


def upper_gamma(a: Column, x: Column, steps: int = 200) -> Column:
    """Regularised upper incomplete gamma function Q(a, x) of a half or whole a: a power series below a + 1, a continued fraction above."""
    half = F.when(a * 2 % 2 == 1, 0.5).otherwise(1.0)
    start = F.when(a * 2 % 2 == 1, math.log(math.pi) / 2).otherwise(0.0)  # log gamma of 1/2 and of 1
    log_gamma = F.aggregate(F.sequence(F.lit(1), F.greatest((a - half).cast("int"), F.lit(1))), start, lambda s, k: s + F.when(k <= a - half, F.log(half + k - 1)).otherwise(0.0))
    front = F.exp(a * F.log(x) - x - log_gamma)
    counted = F.sequence(F.lit(1), F.lit(steps))
    term = F.struct((1.0 / a).alias("sum"), (1.0 / a).alias("term"))
    series = F.aggregate(counted, term, lambda s, k: F.struct((s["sum"] + s["term"] * x / (a + k)).alias("sum"), (s["term"] * x / (a + k)).alias("term")), lambda s: s["sum"])
    fraction = F.aggregate(F.sequence(F.lit(steps), F.lit(1), F.lit(-1)), F.lit(0.0), lambda tail, k: k * (k - a) / (x + 2 * k + 1 - a - tail))
    return F.when(x <= 0, 1.0).when(x < a + 1, 1 - front * series).otherwise(front / (x + 1 - a - fraction))


def contingency(rows: DataFrame, key: str, flag: str) -> DataFrame:
    """Per group its counts, expected counts and rate, with the statistic, degrees of freedom and p value of the chi-square test.

    With one degree of freedom each difference is brought half a count nearer to 0 (not
    beyond it), as is usual for two by two tables.
    """
    counts = rows.groupBy(key).pivot(flag, [True, False]).count().na.fill(0).select(F.col(key), F.col("true").alias("yes"), F.col("false").alias("no"))
    totals = counts.agg(F.sum("yes").alias("_y"), F.sum("no").alias("_n"), (F.count("*") - 1).alias("dof"))
    expected = lambda total: (F.col("yes") + F.col("no")) * F.col(total) / (F.col("_y") + F.col("_n"))
    table = counts.join(F.broadcast(totals)).withColumns({"expected_yes": expected("_y"), "expected_no": expected("_n")})  # one row of totals
    off = lambda seen: F.abs(F.col(seen) - F.col(f"expected_{seen}"))
    near = lambda seen: F.when(F.col("dof") == 1, off(seen) - F.least(F.lit(0.5), off(seen))).otherwise(off(seen))
    part = lambda seen: F.pow(near(seen), 2) / F.col(f"expected_{seen}")
    tested = table.agg(F.sum(part("yes") + part("no")).alias("statistic"), F.max("dof").alias("_d")).withColumn("p_value", upper_gamma(F.col("_d") / 2.0, F.col("statistic") / 2.0))
    both = table.join(F.broadcast(tested.select("statistic", "p_value")))  # one row
    return both.select(key, "yes", "no", "expected_yes", "expected_no", (F.col("yes") / (F.col("yes") + F.col("no"))).alias("rate"), "statistic", "dof", "p_value")


def independence(rows: DataFrame, key: str, flag: str) -> DataFrame:
    """The chi-square test alone: statistic, dof and p value."""
    return contingency(rows, key, flag).select("statistic", "dof", "p_value").limit(1)


def detector_metrics(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Confusion counts, precision, recall, F1 and false positive rate; 0 for 0 / 0."""
    t, p = F.col(truth), F.col(predicted)
    counted = rows.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    c = F.col
    scored = counted.withColumn("precision", ratio(c("tp"), c("tp") + c("fp"))).withColumn("recall", ratio(c("tp"), c("tp") + c("fn")))
    return scored.withColumn("f1", ratio(2 * c("precision") * c("recall"), c("precision") + c("recall"))).withColumn("fpr", ratio(c("fp"), c("fp") + c("tn")))


def upper_bound(n: Column) -> Column:
    """Rule of three: upper bound of a rate of which no case was seen."""
    return 3 / n


def strict_audit(rows: DataFrame) -> DataFrame:
    """Rows (reference, found_title, found_year) whose title or year disagrees."""
    low = sequence_ratio(F.col("reference"), F.col("found_title")) < 0.25
    cited = audit_years(F.col("reference"))
    off = (F.size(cited) > 0) & ~F.exists(cited, lambda y: F.abs(y - F.col("found_year")) <= 1)
    return rows.withColumn("title_off", low).withColumn("year_off", F.coalesce(off, F.lit(False))).filter("title_off or year_off")


def overlap_audit(rows: DataFrame, least: float = 0.6) -> DataFrame:
    return rows.withColumn("overlap", windowed_similarity(F.col("reference"), F.col("found_title"))).filter(F.col("overlap") < least)


def with_ligatures(col: Column) -> Column:
    """fi, fl, ff become ligatures, in that order (so ffi never does)."""
    for letters, ligature in (("fi", "ﬁ"), ("fl", "ﬂ"), ("ff", "ﬀ")):
        col = F.replace(col, F.lit(letters), F.lit(ligature))
    return col


def with_odd_spaces(col: Column) -> Column:
    return F.replace(col, F.lit(" "), F.lit("  "))


def mutated_title(col: Column, fake: str) -> Column:
    """The first three words, a made-up middle and the last three words."""
    words = F.split(col, " ")
    return F.concat_ws(" ", F.slice(words, 1, 3), F.lit(fake), F.slice(words, F.greatest(F.size(words) - 2, F.lit(1)), F.lit(3)))


#: Made-up topics of mutated titles.
TOPICS = [
    "Quantum Gravity", "Sub-surface Thermal Anomalies", "CRISPR-Cas9 Gene Editing", "Supra-molecular Polymers", "Dark Matter Halos",
    "Neuro-morphic Computing", "Super-conducting Qubits", "Metagenomic Sequencing", "Zero-Knowledge Proofs", "Topological Insulators",
]
#: Made-up references in which ``{first}`` and ``{last}`` are page numbers.
FABRICATIONS = [
    "Marlow, E., & Quist, A. (2024). Attention as a model of coral growth. Journal of Imagined Biology, 42(8), {first}-{last}.",
    "Okafor, L., Brandt, S., & Ivers, T. (2023). Deep residual maps for the diagnosis of rivers. Annals of Improbable Medicine, 85, {first}-{last}.",
    "Petrov, D. (2025). Boosted trees and the price of rain. Quarterly Review of Weather Finance, 14(5), {first}-{last}.",
]


#: Prefix of the ids and category of each stratum of a benchmark.
STRATA = [
    ("TN_CLEAN_", "True Negative (Clean)"),
    ("TN_ADV_", "True Negative (Adversarial)"),
    ("TP_MUT_", "Ground Truth Positive (Mutated)"),
    ("TP_LLM_", "Ground Truth Positive (LLM Fabricated)"),
]


def corrupted(ref: Column) -> Column:
    """Ligatures where there are letters for them, else doubled spaces and broken lines."""
    spread = F.replace(F.replace(ref, F.lit(" "), F.lit("  ")), F.lit("."), F.lit(".\n"))
    return bind(with_ligatures(ref), lambda x: F.when(x.rlike("[ﬀ-ﬂ]"), x).otherwise(spread))


def mutated(ref: Column, one: Column, other: Column) -> Column:
    """First and last three words around a made-up title; a whole made-up reference for short ones."""
    words = F.filter(F.split(ref, r"\s+"), lambda w: w != "")
    ends = lambda w: F.concat_ws(" ", F.slice(w, 1, 3), F.concat(one, F.lit(" in "), other, F.lit(".")), F.slice(w, -3, 3))
    short = F.concat(F.lit("Smith, J. and Doe, A. "), one, F.lit(": A Comprehensive Review. Journal of Applied Physics, 2025."))
    return bind(words, lambda w: F.when(F.size(w) > 5, ends(w)).otherwise(short))


def benchmark_cases(rows: DataFrame, n: int = 100, seed: int = 42, *, key: str = "ref_id", ref: str = "reference", templates: list[str] | None = None) -> DataFrame:
    """(test_id, category, reference, truth): n clean, n corrupted, n mutated and n made-up references.

    The first three strata are the 3n rows of least md5 of seed and key, in that order:
    exact sizes, disjoint, the same on every run, and found without sorting all rows.
    Null references are no cases.
    """
    templates = FABRICATIONS if templates is None else templates
    drawn = rows.filter(F.col(ref).isNotNull()).withColumn("_draw", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
    drawn = drawn.orderBy("_draw", F.col(key)).limit(3 * n).withColumn("_at", F.row_number().over(Window.orderBy("_draw", F.col(key))) - 1)  # 3n rows
    topic = lambda at: F.get(F.array(*[F.lit(t) for t in TOPICS]), (at % len(TOPICS)).cast("int"))
    stratum, number = F.floor(F.col("_at") / n), F.col("_at") % n + 1
    text = F.when(stratum == 0, F.col(ref)).when(stratum == 1, corrupted(F.col(ref))).otherwise(mutated(F.col(ref), topic(number), topic(number * 7 + 3)))
    name, kind = (F.get(F.array(*[F.lit(x[i]) for x in STRATA]), stratum.cast("int")) for i in (0, 1))
    real = drawn.select(F.concat(name, number.cast("string")).alias("test_id"), kind.alias("category"), text.alias("reference"), (stratum < 2).alias("truth"))
    page = lambda t, mark, start: F.replace(t, F.lit(mark), (start + F.col("id")).cast("string"))
    base = F.get(F.array(*[F.lit(t) for t in templates]), (F.col("id") % len(templates)).cast("int"))
    made = rows.sparkSession.range(n).select(
        F.concat(F.lit(STRATA[3][0]), (F.col("id") + 1).cast("string")).alias("test_id"), F.lit(STRATA[3][1]).alias("category"),
        page(page(base, "{first}", F.lit(1000)), "{last}", F.lit(1015)).alias("reference"), F.lit(False).alias("truth"),
    )
    return real.unionByName(made)
