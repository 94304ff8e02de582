"""What the command line and the tool server share: modes and result layouts."""

from __future__ import annotations

from pyspark.sql import Row

from .plans.engine import SearchMode

RULE = "-" * 60


def mode_of(name: str, strict: bool = True) -> SearchMode:
    """Unknown names are an error on the command line, and bm25 for the tool server."""
    try:
        return SearchMode(name.lower())
    except ValueError:
        if strict:
            raise ValueError(f"Unknown search mode: {name}. Use bm25, vector or hybrid.") from None
        return SearchMode.BM25


def listing(rows: list[Row], mode: str) -> str:
    if not rows:
        return "No results found."
    parts = [
        f"Result {i} (Score: {r.score:.4f})\nSource: {r.source_file}\nPath: {r.source_path}\nParagraph: {r.paragraph_number}\nDocument ID: {r.document_id}\n\n{r.content}\n"
        for i, r in enumerate(rows, 1)
    ]
    return f"Found {len(rows)} result(s) using {mode} search:\n\n" + f"{RULE}\n".join(parts)


def tool_text(rows: list[Row], mode: str) -> str:
    if not rows:
        return "No relevant documents found for the query."
    parts = [
        f"Document {i} (Score: {r.score:.4f})\nSource: {r.source_file}\nSource ID: {r.source_id}\nPath: {r.source_path}\nParagraph: {r.paragraph_number}\nDocument ID: {r.document_id}\n\n{r.content}\n"
        for i, r in enumerate(rows, 1)
    ]
    return f"Found {len(rows)} relevant document(s) using {mode} search:\n\n" + f"{RULE}\n".join(parts)
