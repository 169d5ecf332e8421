"""Columns over texts: folding, tokens, identifiers, edit distance, token estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import META_PHRASES, MIN_FUZZY, MIN_PART, STOP_WORDS, TEST_WORDS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(*values: str) -> Column:
    return F.array(*map(F.lit, values))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(c, _UPPER, _LOWER)


def like_anywhere(text: Column, term: Column) -> Column:
    """text LIKE %term% without regard to ASCII case; % and _ in term are wildcards, a backslash is itself."""
    pattern = F.concat(F.lit("%"), F.replace(ascii_lower(term), F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    return F.call_function("like", ascii_lower(text), pattern)


def contains_ascii(text: Column, term: Column) -> Column:
    """term stands in text, without regard to ASCII case; nothing in term is a wildcard."""
    return F.contains(ascii_lower(text), ascii_lower(term))


def distinct_in_order(c: Column) -> Column:
    return F.array_distinct(c)


def identifier_parts(c: Column) -> Column:
    """Parts of a snake_case or camelCase name; none where there is only one."""
    snake = F.filter(F.split(c, "_"), lambda p: p != "")
    camel = F.filter(F.split(F.regexp_replace(c, "(?<!^)(?=\\p{Lu})", "\u0001"), "\u0001"), lambda p: p != "")
    return F.when(F.contains(c, F.lit("_")), snake).when(F.size(camel) > 1, camel).otherwise(F.array().cast("array<string>"))


def quoted_phrases(ask: Column) -> Column:
    """Trimmed texts between double quotes that hold a space; an open quote runs to the end."""
    pieces = F.split(ask, '"')
    inside = F.filter(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.trim(p))), lambda p: p.isNotNull())
    return F.filter(inside, lambda p: F.contains(p, F.lit(" ")))


def keywords(ask: Column) -> Column:
    """Search words of a question, in order: quoted phrases, then words each followed by its parts."""
    stop = words(*STOP_WORDS)
    phrases = quoted_phrases(ask)
    rest = F.aggregate(phrases, ask, lambda text, p: F.replace(text, F.concat(F.lit('"'), p, F.lit('"')), F.lit(" ")))
    found = F.filter(F.split(rest, "[^\\p{L}\\p{N}_-]+"), lambda w: (w != "") & ~F.array_contains(stop, F.lower(w)))
    long_part = lambda p: (F.octet_length(p) >= MIN_PART) & ~F.array_contains(stop, p)
    with_parts = F.flatten(F.transform(found, lambda w: F.concat(F.array(F.lower(w)), F.filter(F.transform(identifier_parts(w), lambda p: F.lower(p)), long_part))))
    return F.array_distinct(F.concat(F.transform(phrases, lambda p: F.lower(p)), with_parts))


def is_meta(ask: Column) -> Column:
    low = F.lower(ask)
    return F.exists(words(*META_PHRASES), lambda p: F.contains(low, p))


def about_tests(kws: Column) -> Column:
    return F.arrays_overlap(kws, words(*TEST_WORDS))


def one_edit(a: Column, b: Column) -> Column:
    """One insertion, deletion, substitution or swap of neighbours apart; both of five bytes at least.

    Of equal lengths and two substitutions apart, a swap of neighbours is where the two texts agree
    before and after two places that hold each other's characters.
    """
    long = (F.octet_length(a) >= MIN_FUZZY) & (F.octet_length(b) >= MIN_FUZZY)
    near = F.levenshtein(a, b, 2)
    swapped = lambda i: F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2))
    swap = (near == 2) & (F.length(a) == F.length(b)) & F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: swapped(i) == b)
    return long & ((near == 1) | swap)


def token_estimate(text: Column, unicode: bool = True) -> Column:
    """Words, single symbols and newlines of a text; 0 for null."""
    pattern = ("(?U)" if unicode else "") + "\\w+|[^\\w\\s]|\\n"
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def line_count(text: Column) -> Column:
    """Lines of a text; a newline at the end starts none."""
    return F.regexp_count(text, F.lit("\n")) + F.when((text != "") & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)


def simple_type(c: Column) -> Column:
    """The last dotted name before any type parameters."""
    return F.substring_index(F.trim(F.substring_index(c, "<", 1)), ".", -1)


def snippet(content: Column, line_start: Column, line_end: Column, max_lines: Column, max_bytes: int = 4000) -> Column:
    """struct<code, line_end>: lines from line_start on, cut at max_lines and max_bytes characters, with ellipses."""
    # a newline at the end of a text starts no line
    lines = F.split(F.regexp_replace(content, "\\n$", ""), "\\r?\\n")
    start = F.least(F.greatest(line_start - 1, F.lit(0)), F.size(lines))
    end = F.least(start + max_lines, F.size(lines))
    code = F.array_join(F.slice(lines, start.cast("int") + 1, (end - start).cast("int")), "\n")
    cut = F.octet_length(code) > max_bytes
    shown = F.when(cut, F.concat(F.substring(code, 1, max_bytes), F.lit("..."))).otherwise(code)
    truncated = (end < line_end) | cut
    return F.struct(F.when(truncated, F.concat(shown, F.lit("\n  ..."))).otherwise(shown).alias("code"), (end + 1).cast("long").alias("line_end"))


def age(seconds: Column, *, days: bool = True) -> Column:
    """Seconds as 12s, 5m, 3h or 2d ago; without days, as 50h ago."""
    n = lambda unit: F.floor(seconds / unit).cast("string")
    hours = F.concat(n(3600), F.lit("h ago"))
    told = F.when(seconds < 60, F.concat(n(1), F.lit("s ago"))).when(seconds < 3600, F.concat(n(60), F.lit("m ago")))
    return told.when(seconds < 86400, hours).otherwise(F.concat(n(86400), F.lit("d ago"))) if days else told.otherwise(hours)


def short_count(n: Column) -> Column:
    """1.2M, 3.4K or the number itself."""
    one = lambda unit: F.format_string("%.1f", n / unit)
    return F.when(n >= 1_000_000, F.concat(one(1e6), F.lit("M"))).when(n >= 1000, F.concat(one(1e3), F.lit("K"))).otherwise(n.cast("string"))


def change_pct(before: Column, after: Column) -> Column:
    """By how many whole per cent a count fell or rose, as -12% or +3%; 0% from nothing."""
    pct = F.round((after - before) * 100.0 / before).cast("long")
    return F.when(before == 0, "0%").otherwise(F.concat(F.when(pct > 0, "+").otherwise(""), pct.cast("string"), F.lit("%")))


def newer(current: Column, latest: Column) -> Column:
    """Version comparison by numeric segments; a leading v is ignored, what isn't a number is 0."""
    parts = lambda v: F.transform(F.split(F.regexp_replace(v, "^v", ""), "\\."), lambda p: F.coalesce(F.expr("try_cast(null as int)"), p.try_cast("int"), F.lit(0)))
    return parts(latest) > parts(current)
