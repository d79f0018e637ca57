"""Text columns: folding, quotes, Markdown escapes, passages, fingerprints and requirements."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"[\s\x1c-\x1f\x85   -     　]+"


def collapsed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, _BLANK, " "))


def folded(text: Column) -> Column:
    """Collapsed and without case: lower case, with the full foldings of sharp s, long s, final sigma and the f ligatures."""
    out = F.lower(collapsed(text))
    for a, b in (("ß", "ss"), ("ſ", "s"), ("ς", "σ"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def quote_parts(quote: Column) -> Column:
    """What ellipses divide, folded; blank parts go."""
    return F.filter(F.transform(F.split(quote, r"\.\.\.|…"), folded), lambda p: p != "")


def quote_matches(quote: Column, content: Column) -> Column:
    """Whether every part, of 8 characters at least, comes in order and without overlap."""
    parts, text = quote_parts(quote), folded(content)
    at = lambda pos, p: F.call_function("locate", p, text, pos)
    step = lambda pos, p: F.when((pos > 0) & (at(pos, p) > 0), at(pos, p) + F.length(p)).otherwise(0)
    return (F.size(parts) > 0) & ~F.exists(parts, lambda p: F.length(p) < 8) & (F.aggregate(parts, F.lit(1), step) > 0)


def escaped(text: Column) -> Column:
    """Characters that Markdown reads get a backslash."""
    return F.regexp_replace(text, r"([\\`*_{}\[\]()<>#!~|])", r"\\$1")


def complete_lines(text: Column, n: int) -> Column:
    """The text itself up to n characters, else without the last line that n characters cut."""
    return F.when(F.length(text) <= n, text).otherwise(F.regexp_replace(F.left(text, F.lit(n)), r"\n[^\n]*\z", ""))


def passages(text: Column, n: int = 12_000) -> Column:
    """(id, text) of the non-blank lines of the first n characters; ids are p1, p2, ..."""
    lines = F.filter(F.split(F.left(text, F.lit(n)), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: collapsed(x) != "")
    return F.transform(lines, lambda x, i: F.struct(F.concat(F.lit("p"), (i + 1).cast("string")).alias("id"), x.alias("text")))


def evidence_lines(text: Column, needle: Column, n: int = 3) -> Column:
    """Numbers (from 1) of the first n lines that hold the needle."""
    at = F.transform(F.split(text, "\n"), lambda x, i: F.when(F.contains(x, needle), i + 1))
    return F.slice(F.array_compact(at), 1, n)


def diff_counts(diff: Column) -> Column:
    """Lines that a unified diff adds and removes, its file headers left out."""
    lines = F.split(diff, "\n")
    count = lambda sign: F.size(F.filter(lines, lambda x: x.startswith(sign) & ~x.startswith(sign * 3)))
    return F.struct(count("+").alias("added"), count("-").alias("removed"))


def canonical_json(value: Column) -> Column:
    """JSON with the fields of every object in order of their names, so that equal values are equal texts; as it stands where it can't be read."""
    return F.coalesce(F.to_json(F.try_parse_json(value)), value)


def fingerprint(value: Column) -> Column:
    """SHA-256 of a struct as JSON, whatever the order of its fields."""
    return F.sha2(canonical_json(F.to_json(value)), 256)


def content_hash(*parts: Column) -> Column:
    """Equal where all parts are equal but for white space."""
    return F.sha2(F.to_json(F.array(*(collapsed(F.coalesce(p, F.lit(""))) for p in parts))), 256)


def has_phrase(text: Column, phrase: Column) -> Column:
    return F.contains(F.lower(text), F.lower(phrase))


def has_pattern(text: Column, pattern: Column) -> Column:
    """Whether the pattern is found, whatever the case."""
    return F.regexp_like(text, F.concat(F.lit("(?i)"), pattern))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, _BLANK), lambda x: x != ""))
