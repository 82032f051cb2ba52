"""Layout check of a whole table of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame

from dossier.operators import layout as L
from dossier.session import cut_lineage


def check_layout(
    docs: DataFrame, sections: DataFrame, paragraphs: DataFrame, runs: DataFrame,
    styles: DataFrame, rules: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Issues and the verdict per document."""
    rules = rules if rules is not None else L.default_rules(docs.sparkSession)
    bad = L.bad_runs(L.effective_runs(runs, paragraphs, styles), rules)
    issues = L.all_issues(
        L.margin_issues(sections, rules),
        L.repeated_issues(bad, rules),
        L.spacing_issues(paragraphs, rules),
    )
    issues = cut_lineage(issues)
    return issues, L.verdicts(docs, issues)
