"""Reports of small results, as JSON and Markdown: coverage, audits and benchmark suites."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .packed import write_json


def _cell(value: object) -> str:
    return "-" if value is None else f"{value:.4g}" if isinstance(value, float) else str(value)


def markdown_table(rows: list[dict], columns: list[str]) -> str:
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(_cell(r.get(c)) for c in columns) + " |" for r in rows)])


def rows_of(df: DataFrame, order: list[str], most: int = 10_000) -> list[dict]:
    """The rows of a summary in order; a table that is no summary is refused."""
    got = [r.asDict(recursive=True) for r in df.orderBy(*order).limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError("too many rows for a report")
    return got


def write_report(title: str, sections: dict[str, tuple[DataFrame, list[str]]], path: str) -> dict:
    """path.json and path.md of named summaries, each with the columns that order it."""
    payload = {name: rows_of(df, order) for name, (df, order) in sections.items()}
    write_json(payload, f"{path}.json")
    parts = [f"# {title}"] + [f"## {name}\n\n{markdown_table(rows, list(sections[name][0].columns))}" for name, rows in payload.items()]
    with open(f"{path}.md", "w") as f:
        f.write("\n\n".join(parts) + "\n")
    return payload
