"""Column builders for names, codes and free text. All of them stay inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _accents() -> tuple[str, str]:
    """Precomposed Latin letters and their base letters, by rule."""
    pairs = [(chr(i), unicodedata.normalize("NFKD", chr(i))[0]) for i in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _accents()

# What is no part of a normalised organisation name, longest first.
ORG_PREFIXES = ("government of arvandia", "department of", "department for", "ministry of", "office of the", "the")
ORG_SUFFIXES = ("of arvandia", "arvandia", "inc", "ltd")
# Legal forms that end a vendor name.
VENDOR_SUFFIXES = ("INCORPORATED", "CORPORATION", "LIMITED", "COMPANY", "LIMITEE", "LTEE", "CORP", "INC", "LTD", "LLP", "LLC", "LP", "CO")


def blank_to_null(c: Column | str) -> Column:
    """NULL for NULL, blank and the words that feeds write for a missing value."""
    t = F.trim(_col(c))
    return F.when(~F.lower(t).isin("", "nan", "null", "none"), t)


def fold_accents(c: Column | str) -> Column:
    return F.translate(_col(c), _FROM, _TO)


def words_only(c: Column | str) -> Column:
    """Lower case without accents; '&' is 'and'; anything but letters and digits becomes one space."""
    s = F.regexp_replace(F.lower(fold_accents(c)), "&", " and ")
    return F.trim(F.regexp_replace(s, r"[^\p{L}\p{N}]+", " "))


def normalize_org(c: Column | str) -> Column:
    """An organisation's name before the bilingual bar, folded, without stacked affixes; '' for NULL."""
    s = words_only(F.split_part(F.coalesce(_col(c), F.lit("")), F.lit("|"), F.lit(1)))
    s = F.regexp_replace(s, f"^(?:(?:{'|'.join(ORG_PREFIXES)}) )+", "")
    return F.trim(F.regexp_replace(s, f"(?: (?:{'|'.join(ORG_SUFFIXES)}))+$", ""))


def normalize_vendor(c: Column | str) -> Column:
    """Upper case, the half before '/', without punctuation and trailing legal forms, never to nothing."""
    s = F.split_part(F.upper(_col(c)), F.lit("/"), F.lit(1))
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"[.,'\"()]", ""), r"\s+", " "))
    short = F.regexp_replace(s, f"(?: (?:{'|'.join(VENDOR_SUFFIXES)}))+$", "")
    return F.when(short == "", s).otherwise(short)


def split_entities(c: Column | str) -> Column:
    """Names of a slash-delimited field without trailing brackets and dashes, empty ones left out."""
    parts = F.transform(F.split(F.coalesce(_col(c), F.lit("")), "/"), lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"(?:\s*\([^()]*\)\s*)+$", ""), r"[\s,;–—-]+$", "")))
    return F.filter(parts, lambda p: p != "")


def strip_brackets(c: Column | str) -> Column:
    """A name without any brackets at its end."""
    return F.trim(F.regexp_replace(_col(c), r"(?:\s*\([^()]*\)\s*)+$", ""))


def parse_codes(c: Column | str) -> Column:
    """Distinct eight-digit codes of a field with one '*'-marked code a line, in order of value."""
    lines = F.transform(F.split(F.coalesce(_col(c), F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\*", "")))
    return F.array_sort(F.array_distinct(F.filter(lines, lambda x: x.rlike(r"^[0-9]{8}$"))))


def parse_categories(c: Column | str) -> Column:
    """Distinct lines of a category field, stars kept."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(_col(c), F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != ""))


def split_keys(c: Column | str) -> Column:
    """Keys of a comma- or line-separated field."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(_col(c), F.lit("")), r"[,\n]"), lambda x: F.trim(x)), lambda x: x != ""))


def parse_money(c: Column | str) -> Column:
    """DOUBLE of an amount with currency signs and thousands separators, NULL if unreadable."""
    return F.regexp_replace(_col(c), r"[$,\s]", "").try_cast("double")


def parse_count(c: Column | str) -> Column:
    """Whole number of a text that may have decimals; NULL if unreadable, never 0 for missing."""
    return F.trim(_col(c)).try_cast("double").try_cast("bigint")


def registration_base(c: Column | str) -> Column:
    """A number without its last part: 'A-B-10' is 'A-B'."""
    return F.regexp_replace(_col(c), "-[^-]*$", "")


def registration_sequence(c: Column | str) -> Column:
    return F.regexp_extract(_col(c), "-([^-]*)$", 1).try_cast("bigint")


def source_prefix(c: Column | str) -> Column:
    """Leading letters of an id, '?' without any."""
    p = F.regexp_extract(F.coalesce(_col(c), F.lit("")), r"^([A-Za-z]+)", 1)
    return F.when(p == "", "?").otherwise(p)


def slug(c: Column | str, most: int = 80) -> Column:
    s = F.regexp_replace(F.lower(fold_accents(c)), r"[^\p{L}\p{N}]+", "-")
    return F.left(F.regexp_replace(s, "^-+|-+$", ""), F.lit(most))


def event_identity(number: Column | str, reference: Column | str) -> Column:
    """The procurement a row belongs to: its number, or the reference where that is blank."""
    n = F.trim(F.coalesce(_col(number), F.lit("")))
    return F.when(F.lower(n).isin("", "-", "nan"), F.concat(F.lit("r:"), _col(reference))).otherwise(F.concat(F.lit("s:"), n))


def term_window(text: Column | str, term: str, span: int = 40) -> Column:
    """The text round the first occurrence of a term, on one line; NULL without one."""
    t = F.regexp_replace(_col(text), r"\s+", " ")
    at = F.instr(F.lower(t), term.lower())
    start = F.greatest(F.lit(1), at - span)
    return F.when(at > 0, F.substring(t, start, at + len(term) + span - start))


def tokens(c: Column | str) -> Column:
    """Lower-case words: runs of letters, digits and underscores, whatever the script."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def count_tokens(c: Column | str) -> Column:
    """Number of ``tokens``, without making them."""
    return F.regexp_count(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"))


def count_token(c: Column | str, token: str) -> Column:
    """How often one token occurs among ``tokens``."""
    low = F.lower(F.coalesce(_col(c), F.lit("")))
    pattern = rf"(?<![\p{{L}}\p{{N}}_]){token}(?![\p{{L}}\p{{N}}_])"
    return F.when(low.contains(token), F.regexp_count(low, F.lit(pattern))).otherwise(0)


def sentences(c: Column | str) -> Column:
    """Sentences and lines of a text, blank ones left out."""
    parts = F.split(F.coalesce(_col(c), F.lit("")), r"(?<=[.!?])\s+|\n+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def strip_urls(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"(?i)\b(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+){2,}\b", " ")


def strip_markdown(c: Column | str) -> Column:
    """Text without emphasis and bullets, on one line."""
    s = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"\*\*|__|(?m)^\s*[-*•]\s+", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def contains_word(text: Column | str, term: str) -> Column:
    """Whole-word, case-blind occurrence of a literal term, words being runs of letters, digits and underscores."""
    quoted = "".join("\\" + ch if not (ch.isalnum() or ch in " _") else ch for ch in term.lower())
    low = F.lower(F.coalesce(_col(text), F.lit("")))
    # The plain search spares most rows the pattern.
    return low.contains(term.lower()) & low.rlike(rf"(^|[^\p{{L}}\p{{N}}_]){quoted}($|[^\p{{L}}\p{{N}}_])")


def matched_terms(text: Column | str, terms: list[str]) -> Column:
    """The terms that occur as whole words, in their given order."""
    return F.array_compact(F.array(*[F.when(contains_word(text, t), F.lit(t)) for t in terms]))


def matched_substrings(text: Column | str, terms: list[str]) -> Column:
    low = F.lower(F.coalesce(_col(text), F.lit("")))
    return F.array_compact(F.array(*[F.when(F.instr(low, t.lower()) > 0, F.lit(t)) for t in terms]))


def starts_any(codes: Column, prefix: str) -> Column:
    return F.exists(codes, lambda c: c.startswith(prefix))


def matched_prefixes(codes: Column, prefixes: list[str]) -> Column:
    """The prefixes that some code starts with, sorted."""
    return F.array_compact(F.array(*[F.when(starts_any(codes, p), F.lit(p)) for p in sorted(prefixes)]))
