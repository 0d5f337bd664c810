"""Prompt texts; the templates are parameters, {query}, {context} and {answer} are filled in."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prompt versions to choose from; "filtering" also asks to pass over what doesn't answer the question.
TEMPLATES = {
    "original": "Answer the question from the context only.\n\nQuestion: {query}\n\nContext:\n{context}\n\nAnswer:",
    "filtering": "Answer the question from the context only. Pass over quotations and all parts that don't bear on the question.\n\nQuestion: {query}\n\nContext:\n{context}\n\nAnswer:",
}
ANSWER_TEMPLATE = TEMPLATES["original"]
PLAIN_TEMPLATE = "Answer the question.\n\nQuestion: {query}\n\nAnswer:"
# Fixed value: the layout of a training example.
TRAINING_TEMPLATE = "السؤال: {query}\n\nالنص:\n{context}\n\nالإجابة: {answer}"


def fill(template: str, **parts: Column) -> Column:
    """The template with its places filled; what is filled in is never read as a place itself."""
    pieces = re.split(r"\{(\w+)\}", template)
    if unknown := set(pieces[1::2]) - set(parts):
        raise ValueError(f"nothing to fill in for {', '.join(sorted(unknown))}")
    filled = [F.coalesce(parts[x].cast("string"), F.lit("")) if n % 2 else F.lit(x) for n, x in enumerate(pieces)]
    return F.concat(*filled)


def answer_prompt(query: Column, context: Column, template: str = "original", most: int = 3000) -> Column:
    """template: the name of a version, or a template."""
    cut = F.when(F.length(context) > most, F.concat(F.substring(context, 1, most), F.lit("..."))).otherwise(context)
    return fill(TEMPLATES.get(template, template), context=cut, query=query)


def training_example(query: Column, context: Column, answer: Column, template: str = TRAINING_TEMPLATE) -> Column:
    return fill(template, context=context, answer=answer, query=query)
