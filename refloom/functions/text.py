"""Cleaning of titles, names and extracted text, as column expressions."""

from __future__ import annotations

import unicodedata
from string import ascii_letters, ascii_lowercase, ascii_uppercase, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as JavaScript and Unicode see it (Java's \s is ASCII only), as part of a pattern and as the characters themselves.
SPACE = r"\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
SPACES = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"

#: The ASCII characters that are neither word characters nor white space, and a pattern of runs of all others that are neither.
_DROPPED = "".join(c for c in map(chr, range(0x80)) if c not in ascii_letters + digits + "_" + SPACES)
#: The range fails at once for ASCII characters; a negated class tries all of its ranges for each of them.
_FOREIGN = r"[\x{80}-\x{10FFFF}&&[^\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]]+"


def _fold_table() -> tuple[str, str]:
    """Characters that decompose to one ASCII character and combining marks."""
    pairs = []
    for code in range(0x80, 0x30000):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not 0x300 <= ord(c) <= 0x36F)
        if len(base) == 1 and base.isascii():
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _fold_table()
_LETTERS = [(a, b.lower()) for a, b in zip(_FROM, _TO, strict=True) if b not in _DROPPED]
#: Folding of single characters; those at the end, beyond the length of the second, are dropped.
_FOLD_FROM = "".join(a for a, _ in _LETTERS) + ascii_uppercase + _DROPPED + "".join(a for a, b in zip(_FROM, _TO, strict=True) if b in _DROPPED)
_FOLD_TO = "".join(b for _, b in _LETTERS) + ascii_lowercase


def _compatible_table() -> tuple[str, str, str]:
    """Characters whose compatibility decomposition (NFKD) holds one ASCII character, those characters, and a map of those that hold more."""
    one, several = [], []
    for code in range(0x80, 0x30000):
        if unicodedata.decomposition(chr(code)):
            plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
            (one if len(plain) == 1 else several).append((chr(code), plain))
    several = [(a, b) for a, b in several if b]
    return "".join(a for a, _ in one), "".join(b for _, b in one), "\x01".join(f"{a}\x02{b}" for a, b in several)


_ONE_FROM, _ONE_TO, _SEVERAL = _compatible_table()

#: Lines that begin with one of these are dropped from LaTeX input.
LATEX_COMMANDS = [
    "\\vspace", "\\hspace", "\\newpage", "\\pagebreak", "\\clearpage", "\\noindent", "\\indent", "\\bigskip", "\\medskip",
    "\\smallskip", "\\vfill", "\\hfill", "\\linebreak", "\\newline", "\\par", "\\begin{", "\\end{", "\\setlength",
    "\\addtolength", "\\documentclass", "\\usepackage", "\\input", "\\include",
]

#: Publisher names that are taken out of an expected journal.
PUBLISHERS = (
    r"(?i)\b(springer|elsevier|wiley|routledge|sage|cambridge|oxford|harvard|princeton|edward\s+elgar|mcgraw.hill|pearson"
    r"|academic\s+press|lexington\s+books?|university\s+press|palgrave|macmillan|taylor\s+&?\s*francis|ieee|acm)\b"
)


def chain(col: Column, *steps: tuple[str, str]) -> Column:
    """Regular expression replacements, one after the other."""
    for pattern, to in steps:
        col = F.regexp_replace(col, pattern, to)
    return col


def bind(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is mentioned."""
    return F.get(F.transform(F.array(value), use), 0)


def trim(col: Column) -> Column:
    """Strip all Unicode white space, not only blanks; no pattern, as that would try every place of the string."""
    return F.trim(col, F.lit(SPACES))


def rounded(col: Column) -> Column:
    """Round half up, also below zero."""
    return F.floor(col + 0.5).cast("long")


def filled(col: Column) -> Column:
    """Null for null and for the empty string."""
    return F.nullif(col, F.lit(""))


def word_characters(col: Column) -> Column:
    """ASCII letters, digits, underscores and white space only.

    ASCII characters go by ``translate``: a pattern costs by the match, and most strings hold several and no other characters.
    """
    return F.regexp_replace(F.translate(col, _DROPPED, ""), _FOREIGN, "")


def fold(col: Column) -> Column:
    """Without accents, lower case, ASCII word characters and white space only, trimmed."""
    bare = F.translate(F.regexp_replace(col, r"[\u0300-\u036F]", ""), _FOLD_FROM, _FOLD_TO)
    return trim(F.regexp_replace(bare, _FOREIGN, ""))


def clean_query(col: Column) -> Column:
    return trim(chain(col, (r"[{}]", ""), (r"\\textbf|\\textit|\\emph|\\textrm", ""), (r"\\&", "&"), ("~", " "), (f"[{SPACE}]{{2,}}", " ")))


def decode_latex(col: Column) -> Column:
    """Accent macros become their base letter; the acute's quote is optional."""
    letter = lambda accent, letters: (rf"\{{?\\{accent}\{{?([{letters}])\}}?\}}?", "$1")
    vowels = "aeiouAEIOU"
    steps = [letter("'?", vowels), letter("`", vowels), letter(r"\^", vowels), letter('"', vowels), letter("v", "a-zA-Z"), letter("~", "nN"), letter("c", "cC")]
    return trim(chain(col, *steps, (r"[{}]", "")))


def first_letter(col: Column) -> Column:
    """First ASCII letter, lower case, after decoding; empty if there is none."""
    return F.lower(F.regexp_extract(decode_latex(col), "[A-Za-z]", 0))


def first_letter_matches(a: Column, b: Column) -> Column:
    return (first_letter(a) != "") & (first_letter(a) == first_letter(b))


def drop_latex_lines(col: Column) -> Column:
    def kept(line):
        bare = trim(line)
        starts = F.lit(False)
        for command in LATEX_COMMANDS:
            starts = starts | bare.startswith(command)
        return (bare != "") & ~starts

    return F.array_join(F.filter(F.split(col, "\n"), kept), "\n")


def plain_key(col: Column) -> Column:
    """Lower case, punctuation and non-ASCII letters dropped, spaces collapsed."""
    return trim(F.regexp_replace(word_characters(F.lower(col)), f"[{SPACE}]{{2,}}|[{SPACE}&&[^ ]]", " "))


def adapter_key(col: Column) -> Column:
    """As ``plain_key``, with spaces as they are."""
    return trim(word_characters(F.lower(col)))


def plain_ascii(col: Column) -> Column:
    """Compatibility characters as the ASCII they stand for (one or several), other non-ASCII dropped, white space collapsed.

    A character that stands for several is looked up in a constant map, and only in
    strings that are not ASCII after the one-to-one step.
    """
    known = F.str_to_map(F.lit(_SEVERAL), F.lit("\x01"), F.lit("\x02"))
    letters = lambda t: F.regexp_extract_all(t, F.lit(r"(?s)."), F.lit(0))
    spelled = lambda t: F.array_join(F.transform(letters(t), lambda c: F.when(c < "\x80", c).otherwise(F.coalesce(F.try_element_at(known, c), F.lit("")))), "")
    bare = bind(F.translate(col, _ONE_FROM, _ONE_TO), lambda t: F.when(F.octet_length(t) == F.char_length(t), t).otherwise(spelled(t)))
    return trim(chain(bare, (r"[\n\t]", " "), (r"\r", ""), (" +", " ")))


def drop_controls(col: Column) -> Column:
    """Without the control characters that spreadsheets refuse."""
    return F.regexp_replace(col, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def alnum_key(col: Column) -> Column:
    return F.regexp_replace(F.lower(col), "[^a-z0-9]", "")


def clean_extracted(col: Column) -> Column:
    """Without page-number lines, boilerplate lines and lines that are one URL."""
    return trim(
        chain(
            col,
            (r"(?m)^\s*\d{1,4}\s*$", ""),
            (r"(?im)^\s*(Downloaded from|Copyright ©|All rights reserved|Published by|doi:|DOI:).+$", ""),
            (r"(?m)^\s*https?://\S+\s*$", ""),
            (r"\n{3,}", "\n\n"),
        )
    )


def journal_key(col: Column) -> Column:
    """An expected journal without book-series marks, publishers and page ranges."""
    return trim(
        chain(
            col,
            (r"^//\s*", ""),
            (r"\.\s*$", ""),
            (PUBLISHERS, ""),
            (r"(?i)publishing", ""),
            (r"\b\d{1,5}\s*[-–]\s*\d{1,5}\b", ""),
            (r"[:,]\s*$", ""),
            (r"\s{2,}", " "),
        )
    )


def without_metadata(col: Column) -> Column:
    """Free text without type marks, series, ids, pages, volumes, years and et al."""
    return trim(
        chain(
            col,
            (r"\[\s*[JMCDRSZN]\s*\]", ""),
            (r"//[^.]+", ""),
            (r"(?i)DOI\s*[:：]\s*[^\s,]+", ""),
            (r"(?i)https?://[^\s,]+", ""),
            (r"\b[Pp]{1,2}\.?\s*\d+[-–]\d+", ""),
            (r"\b\d{1,5}\s*[-–]\s*\d{1,5}\b", ""),
            (r"\b\d{1,4}\s*\(\d{1,4}\)", ""),
            (r"\b[Vv]ol\.?\s*\d+", ""),
            (r"\b[Nn]o\.?\s*\d+", ""),
            (r"\(?\b(19|20)\d{2}\b\)?", ""),
            (r"(?i)\bet\s+al\.?", ""),
            (r"\s{2,}", " "),
        )
    )


def without_braces(col: Column) -> Column:
    return F.regexp_replace(col, r"[{}]", "")


def catalog_title(col: Column) -> Column:
    """A title without its trailing period."""
    return F.regexp_replace(col, r"\.$", "")


def catalog_author(col: Column) -> Column:
    """A name without its trailing four-digit number."""
    return F.regexp_replace(col, r"\s+\d{4}$", "")
