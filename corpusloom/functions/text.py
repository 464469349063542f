"""String functions as column expressions.

White space is Unicode white space as Python understands it, spelled out since
Java's ``\\s`` is ASCII and ``trim`` removes blanks only.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numbers import let

#: Characters that ``str.split`` and ``\s`` of Python's ``re`` take as white space.
SPACES = r"\t-\r\x1c-\x20\x85\xa0  -     　"

# Words that carry no weight in retrieval.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "in", "is", "it", "of", "on", "or", "that", "the",
    "to", "was", "were", "what", "when", "where", "which", "who", "with", "under", "this", "these", "those", "does", "do", "can",
)
# Repairs of spacing in extracted answers, applied in this order.
SPACING_REPAIRS = (
    ("l i mitation", "limitation"), ("i t", "it"), ("forthe", "for the"), ("cons ideration", "consideration"),
    ("registration of 1[documents]", "registration of documents"),
)
# Repairs of joined words in provision bodies.
JOINED_REPAIRS = (
    ("ifthis", "if this"), ("Ifthis", "If this"), ("respectof", "respect of"), ("Respectof", "Respect of"), ("anyof", "any of"), ("Anyof", "Any of"),
    ("ofthe", "of the"), ("Ofthe", "Of the"), ("intoforce", "into force"), ("Intoforce", "Into force"), ("otherproceeding", "other proceeding"),
    ("of, British Burma", "of British Burma"),
)


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, rf"^[{SPACES}]+|[{SPACES}]+$", "")


def collapse(c: Column) -> Column:
    """Every run of white space one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, rf"[{SPACES}]+", " "))


def or_default(c: Column, default: str) -> Column:
    """Null and empty become *default*."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def clean_corpus(c: Column) -> Column:
    """Corpus text: no soft hyphens, blanks collapsed, none before punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("­"), F.lit("")), rf"[{SPACES}]+", " "), r" ([,.;:!?])", "$1"))


def clean_page(c: Column) -> Column:
    """Page text: no soft hyphens, blanks and tabs collapsed, at most one empty line in a row."""
    return strip(F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("­"), F.lit("")), r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def clean_answer(c: Column) -> Column:
    """Answer text: as corpus text, blanks kept before ``!`` and ``?``, then the spacing repairs."""
    out = F.regexp_replace(collapse(F.replace(c, F.lit("­"), F.lit(""))), r" ([,.;:])", "$1")
    for wrong, right in SPACING_REPAIRS:
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return out


def word_count(c: Column) -> Column:
    """Words between white space."""
    return F.coalesce(F.regexp_count(c, F.lit(rf"[^{SPACES}]+")), F.lit(0))


def words(c: Column) -> Column:
    """Array of words between white space."""
    return F.coalesce(F.regexp_extract_all(c, F.lit(rf"[^{SPACES}]+"), F.lit(0)), F.array().cast("array<string>"))


def tokens(c: Column) -> Column:
    """Lower-case ASCII tokens without stopwords."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z][a-z0-9-]*"), F.lit(0)), lambda x: ~x.isin(*STOPWORDS))


def terms(c: Column) -> Column:
    """Tokens, then the pairs of neighbours among them."""
    pairs = lambda t: F.zip_with(F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return let(tokens(c), lambda t: F.when(F.size(t) < 2, t).otherwise(F.concat(t, pairs(t))))


def sha256(c: Column) -> Column:
    """Hex digest of the UTF-8 bytes."""
    return F.sha2(c, 256)


def clauses(c: Column, small: int = 45) -> Column:
    """Sentence and clause parts; a part of under *small* characters joins the one before it."""
    # a line feed, which collapsed text does not hold, parts what stays apart
    parts = lambda p: F.transform(p, lambda x, i: F.when(i == 0, x).when(F.length(x) < small, F.concat(F.lit(" "), x)).otherwise(F.concat(F.lit("\n"), x)))
    found = F.filter(F.split(collapse(c), r"(?<=[.;:])\s+|(?<=\))\s+"), lambda x: x != "")
    return F.filter(F.split(F.array_join(parts(found), ""), "\n"), lambda x: x != "")


def ocr_corrupt(c: Column) -> Column:
    """True for text with clear debris of optical recognition; null is clean."""
    # Fixed values, down to the counts below: patterns of debris, any one of which suffices.
    hard = (
        r"\b[A-Za-z]{2,}~[A-Za-z]*", r"\b[A-Za-z]{2,}[,;:]{2,}", r"\b[A-Za-z]{2,}-\s+(?=[A-Za-z])",
        r"\b(?:wtiler|gaseR|Rcgulatio\w*|R,qistered|tolss|thu|imd)\b", r"\b(?:ol|ofi)\b(?=\s+(?:Government|accidents|fire-areas|records))",
        r"\.{2,}\s*,{1,}\s*\.{2,}",
    )
    noisy = r"(?<![A-Za-z])(?:[A-Z]{1,2}\s+){3,}[A-Z0-9$]{1,3}(?![A-Za-z])|\b[A-Za-z]{2,}_[A-Za-z]{1,}\b|\b[A-Za-z]{2,}\d[A-Za-z]{2,}\b"
    repeated = (r"(?d)(.{40,150})\1", "(?<!\\w)([\\wऀ-ॿ]{2,})(?:\\s+\\1){2,}(?!\\w)")
    found = F.contains(c, F.lit("�")) | F.contains(c, F.lit("□"))
    for p in hard:
        found = found | c.rlike(f"(?U){p}")
    found = found | (F.regexp_count(c, F.lit(f"(?U){noisy}")) >= 2)
    for p in repeated:
        found = found | c.rlike(f"(?U){p}")
    count = lambda s: (F.length(c) - F.length(F.replace(c, F.lit(s), F.lit("")))) / len(s)
    return F.coalesce(found | (count("|") >= 8) | (count("<br") >= 4), F.lit(False))
