"""Columns over paths: language, tests, ignored and generated files, subsystems, quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import words
from .vocab import DIR_PENALTIES, GENERATED_DIRS, GENERATED_SUFFIXES, IGNORED_DIRS, IGNORED_EXTENSIONS, LANGUAGES, MINIFIED_SUFFIXES, SCAFFOLD_DIRS, TEST_DIRS


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(basename(path), "\\.[^.]*$", "")


def stem_parts(path: Column) -> Column:
    return F.filter(F.split(stem(path), "[-_.]"), lambda p: p != "")


def extension(path: Column) -> Column:
    """After the last dot of the name; none for names without a dot or with only a leading one."""
    return F.nullif(F.regexp_extract(basename(path), "^.+\\.([^.]*)$", 1), F.lit(""))


def language(path: Column) -> Column:
    by_extension = F.create_map(*(F.lit(x) for lang, exts in LANGUAGES.items() for e in exts for x in (e, lang)))
    return by_extension[extension(path)]


def ignored_dir(path: Column) -> Column:
    """A directory of the path is one that is never walked."""
    return F.arrays_overlap(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), words(*IGNORED_DIRS))


def ignored_file(path: Column) -> Column:
    return F.coalesce(extension(path).isin(*IGNORED_EXTENSIONS), F.lit(False))


def is_test(path: Column) -> Column:
    name = basename(path)
    by_name = F.startswith(name, F.lit("test_")) | name.rlike("(_test|\\.test|_spec|\\.spec)\\.") | F.regexp_replace(name, "(?<=.)\\.[^.]*$", "").rlike("(Test|Tests)$")
    return F.arrays_overlap(F.split(path, "/"), words(*TEST_DIRS)) | by_name


def is_generated(path: Column) -> Column:
    low = F.lower(path)
    out = F.lit(False)
    for s in GENERATED_SUFFIXES:
        out = out | F.endswith(low, F.lit(s))
    for d in GENERATED_DIRS:
        out = out | F.contains(low, F.lit(d))
    return out


def subsystem(path: Column) -> Column:
    """The first segment that names a subject; null if none does."""
    named = F.filter(F.split(path, "/"), lambda p: ~p.isin(*SCAFFOLD_DIRS) & ~F.contains(p, F.lit(".")) & (p != ""))
    return F.get(named, F.lit(0))


def test_base(path: Column) -> Column:
    """What a test file's name says it tests: its stem less the first test mark that it bears."""
    s = stem(path)
    out = F.when(F.startswith(s, F.lit("test_")), F.substr(s, F.lit(6)))
    for mark in ("_test", ".test", "_spec", ".spec", "Test", "Tests"):
        out = out.when(F.endswith(s, F.lit(mark)), F.left(s, F.length(s) - len(mark)))
    return out.otherwise(s)


def quality(path: Column, size: Column, line_count: Column, language: Column, is_test: Column) -> Column:
    """What a file's place and form add to its score or take from it."""
    low = F.lower(path)
    by_segment = F.lit(0)
    segments = F.split(low, "/")
    for penalty, names in DIR_PENALTIES.items():
        bad = words(*names)
        by_segment = by_segment + penalty * F.size(F.filter(segments, lambda p: F.array_contains(bad, p)))  # noqa: B023
    minified = F.lit(False)
    for s in MINIFIED_SUFFIXES:
        minified = minified | F.endswith(low, F.lit(s))
    width = F.when(line_count > 0, F.floor(size / line_count)).otherwise(0)
    return by_segment + F.when(minified, -60).otherwise(0) + F.when(width > 1000, -200).when(width > 500, -80).otherwise(0) + F.when(language.isNotNull(), 20).otherwise(0) + F.when(is_test, -5).otherwise(0)
