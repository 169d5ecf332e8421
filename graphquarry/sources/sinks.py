"""Where packages and reports go: folders of text and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import context

FORMATS = ("text", "json", "both")


def write_packages(packages: DataFrame, folder: str, form: str = "text") -> list[str]:
    """Write packages (see operators.context.packaged) below folder as text, JSON or both; returns the folders written.

    One file set a form, a package a row, with its query_id.  Brief packages go out as summaries, and their
    whole documents go beside them into ``whole``.
    """
    if form not in FORMATS:
        raise ValueError(f"the form is one of {', '.join(FORMATS)}")
    p, brief = F.col("package"), F.col("mode") == "brief"
    out = []
    if form in ("text", "both"):
        shown = F.when(brief, context.as_summary(p)).otherwise(context.as_text(p))
        packages.select("query_id", shown.alias("text")).write.mode("overwrite").json(f"{folder}/text")
        packages.filter(brief).select("query_id", context.as_text(p).alias("text")).write.mode("overwrite").json(f"{folder}/whole")
        out += [f"{folder}/text", f"{folder}/whole"]
    if form in ("json", "both"):
        packages.select("query_id", "package").write.mode("overwrite").json(f"{folder}/json")
        out.append(f"{folder}/json")
    return out


def write_report(report: DataFrame, folder: str) -> None:
    """Write a report's rows as JSON lines."""
    report.write.mode("overwrite").json(folder)
