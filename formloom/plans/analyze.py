"""From a corpus to one template per group: align, diff, classify, derive."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from formloom.operators.classify import classify, guess_doc_type, sections_of
from formloom.operators.diff import _compared, _decide, rep_nodes, staged_values
from formloom.operators.fields import derive_fields, derive_rules
from formloom.operators.tagging import enforce_tags_only
from formloom.session import stage


@dataclass
class Analysis:
    """Everything known about the templates of a corpus (one per group)."""

    representatives: DataFrame  # elements of each group's representative
    diffs: DataFrame | None
    classified: DataFrame
    sections: DataFrame
    fields: DataFrame
    rules: DataFrame
    document_types: DataFrame


def analyze(documents: DataFrame, mode: str = "smart", max_samples: int = 20) -> Analysis:
    """Compare the documents of every group and derive its template.

    ``mode`` is ``smart`` (what varies becomes a field) or ``tags_only`` (every
    text does).  What describes the templates (representative elements and the
    evidence, a few rows per group) is staged, since all later parts read it.  The lists
    in ``diffs`` are previews of ``max_samples`` values; ``diff.corpus_values`` has all.
    """
    if mode not in ("smart", "tags_only"):
        raise ValueError("mode is 'smart' or 'tags_only'")
    reps, aligned = _compared(documents)
    nodes = stage(rep_nodes(documents, reps), "representatives")
    diffs = stage(_decide(staged_values(aligned), nodes, max_samples), "diffs")
    return template_parts(nodes, diffs, mode)


def template_parts(representative: DataFrame, diffs: DataFrame | None, mode: str = "smart") -> Analysis:
    """Classes, sections, fields and rules of the given representatives."""
    classified = classify(representative, diffs)
    if mode == "tags_only":
        classified = enforce_tags_only(representative, classified).drop("forced")
    classified = stage(classified, "classes")
    sections = sections_of(representative, classified)
    fields = derive_fields(representative, classified)
    return Analysis(
        representatives=representative, diffs=diffs, classified=classified, sections=sections,
        fields=fields, rules=derive_rules(fields), document_types=guess_doc_type(representative),
    )
