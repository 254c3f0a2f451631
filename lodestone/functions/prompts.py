"""Task-aware prompts and embedding dimensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TASKS = ["SearchQuery", "SearchDocument", "QuestionAnswering", "FactVerification", "Classification", "Clustering", "SemanticSimilarity", "CodeRetrieval"]
DESCRIPTIONS = dict(
    zip(
        [t for t in TASKS if t != "SearchDocument"],
        ["search result", "question answering", "fact checking", "classification", "clustering", "sentence similarity", "code retrieval"],
    )
)
DIMS = (768, 512, 256, 128)
DEFAULT_DIM = 512


class PromptError(ValueError):
    """A request that has no prompt or dimension."""


def strip(text: Column) -> Column:
    """Without white space at either end, in the Unicode sense."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def resolve_dim(dim: int | None) -> int:
    if not dim:
        return DEFAULT_DIM
    if dim not in DIMS:
        raise PromptError(f"dimension {dim} is not one of {DIMS}")
    return dim


def dim_column(dim: Column, strict: bool = True) -> Column:
    """Dimension of each row; a wrong one is an error, or null if not ``strict``."""
    wrong = F.raise_error(F.concat(F.lit("unsupported dimension "), dim.cast("string"))).cast("int") if strict else F.lit(None).cast("int")
    return F.when(dim.isNull() | (dim == 0), F.lit(DEFAULT_DIM)).when(dim.isin(*DIMS), dim.cast("int")).otherwise(wrong)


def build_prompt(task: str | None, content: str | None, title: str | None = None, description: str | None = None) -> str:
    """Prompt of one request; ``task`` is a name of ``TASKS`` or ``None``/``"None"`` for bare text."""
    body = (content or "").strip()
    if not body:
        raise PromptError("content is empty")
    if task in (None, "None"):
        return body
    if task == "SearchDocument":
        return f"title: {(title or '').strip() or 'none'} | text: {body}"
    told = (description or "").strip() or DESCRIPTIONS.get(task)
    if told is None:
        raise PromptError(f"task {task!r} has no description")
    return f"task: {told} | query: {body}"


def prompt_parts(task: Column, content: Column, title: Column | None = None, description: Column | None = None) -> tuple[Column, Column]:
    """(prompt, error) of each row: one of them is null."""
    blank = F.lit("")
    body = strip(F.coalesce(content, blank))
    named = strip(F.coalesce(title, blank)) if title is not None else blank
    told = F.nullif(strip(F.coalesce(description, blank)), blank) if description is not None else F.lit(None).cast("string")
    standard = F.lit(None).cast("string")
    for name, text in DESCRIPTIONS.items():
        standard = F.when(task == name, text).otherwise(standard)
    told = F.coalesce(told, standard)
    bare = task.isNull() | (task == "None")
    error = F.when(body == "", "content is empty").when(~bare & (task != "SearchDocument") & told.isNull(), F.concat(F.lit("no description for task "), task))
    document = F.concat(F.lit("title: "), F.when(named == "", "none").otherwise(named), F.lit(" | text: "), body)
    text = F.when(bare, body).when(task == "SearchDocument", document).otherwise(F.concat(F.lit("task: "), told, F.lit(" | query: "), body))
    return F.when(error.isNull(), text), error


def prompt(task: Column, content: Column, title: Column | None = None, description: Column | None = None) -> Column:
    """Prompt of each row; a request without one is an error."""
    text, error = prompt_parts(task, content, title, description)
    return F.when(error.isNotNull(), F.raise_error(error).cast("string")).otherwise(text)
