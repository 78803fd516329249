"""The scores and extractions as functions of the session's SQL.

Each is defined by an expression, which the analyser puts in place of the call: nothing
is a black box to the optimiser, and no Python runs.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from refloom.functions.text import _FROM, _TO, SPACE


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


_BLANKS = f"[{SPACE}]+"
_EDGES = _quoted(f"^{_BLANKS}|{_BLANKS}$")
_ODD = _quoted(f"[^a-zA-Z0-9_{SPACE}]")

def _fold(t: str) -> str:
    bare = f"lower(translate(regexp_replace({t}, {_quoted('[\u0300-\u036F]')}, ''), {_quoted(_FROM)}, {_quoted(_TO)}))"
    return f"regexp_replace(regexp_replace({bare}, {_ODD}, ''), {_EDGES}, '')"


_FAMILY = f"try_element_at(filter(split({_fold('n')}, {_quoted(_BLANKS)}), w -> NOT w RLIKE '^[0-9]+$'), -1)"

#: name -> (parameters, type, expression); later ones may use earlier ones, whose arguments are evaluated once.
FUNCTIONS = {
    "fold_text": ("t STRING", "STRING", _fold("t")),
    "text_words": ("t STRING", "ARRAY<STRING>", f"array_distinct(array_remove(split(regexp_replace(lower(t), {_ODD}, ''), {_quoted(_BLANKS)}), ''))"),
    "share_of_words": (
        "x ARRAY<STRING>, y ARRAY<STRING>",
        "BIGINT",
        "CASE WHEN size(x) > 0 AND size(y) > 0 THEN CAST(floor(size(array_intersect(x, y)) / size(array_union(x, y)) * 100 + 0.5) AS BIGINT) ELSE 0L END",
    ),
    "word_overlap": ("a STRING, b STRING", "BIGINT", "share_of_words(text_words(a), text_words(b))"),
    "edit_similarity": ("x STRING, y STRING", "BIGINT", "CAST(floor((1 - levenshtein(x, y) / greatest(length(x), length(y))) * 100 + 0.5) AS BIGINT)"),
    "similarity_of_folded": (
        "x STRING, y STRING, a STRING, b STRING",
        "BIGINT",
        "CASE WHEN coalesce(a, '') = '' OR coalesce(b, '') = '' THEN 0L WHEN x = y THEN 100L ELSE greatest(edit_similarity(x, y), word_overlap(a, b)) END",
    ),
    "text_similarity": ("a STRING, b STRING", "BIGINT", "similarity_of_folded(fold_text(a), fold_text(b), a, b)"),
    "title_of_scored": ("s BIGINT, x STRING, y STRING", "BIGINT", "CASE WHEN s < 90 AND contains(x, y) AND length(y) > 20 THEN 95L ELSE s END"),
    "title_of_folded": ("x STRING, y STRING", "BIGINT", "title_of_scored(similarity_of_folded(x, y, x, y), x, y)"),
    "title_similarity": ("expected STRING, found STRING", "BIGINT", "title_of_folded(fold_text(coalesce(expected, '')), fold_text(coalesce(found, '')))"),
    "family_names": ("authors ARRAY<STRING>", "ARRAY<STRING>", f"filter(transform(authors, n -> {_FAMILY}), f -> length(f) > 1)"),
    "share_of_families": (
        "hits INT, families INT, authors INT, expected STRING",
        "BIGINT",
        "CASE WHEN coalesce(expected, '') = '' OR coalesce(authors, 0) <= 0 THEN 100L WHEN families = 0 THEN 0L "
        "WHEN expected RLIKE '(?i)et\\\\s+al|and\\\\s+others' AND hits > 0 THEN 100L ELSE CAST(floor(hits / families * 100 + 0.5) AS BIGINT) END",
    ),
    "families_within": ("t STRING, families ARRAY<STRING>", "INT", "size(filter(families, f -> contains(t, f)))"),
    "author_similarity": (
        "expected STRING, authors ARRAY<STRING>",
        "BIGINT",
        "share_of_families(families_within(fold_text(coalesce(expected, '')), family_names(authors)), size(family_names(authors)), size(authors), expected)",
    ),
    "paper_status": ("present BOOLEAN, confidence DOUBLE", "STRING", "CASE WHEN NOT present THEN 'Not Found' WHEN confidence > 80 THEN 'Verified' WHEN confidence > 50 THEN 'Partial' ELSE 'Mismatch' END"),
}


def register(spark: SparkSession) -> list[str]:
    """Define the functions for the session; their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
