"""Literal template rendering (T12) as column concatenation.

Templates use ``str.format`` syntax; the literal pieces become ``lit``
parts of one ``concat`` so braces or percent signs inside the data are never
re-interpreted.  ``strip=True`` strips the rendered text like ``str.strip``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as FV
from .text import ustrip


def template_parts(template: str) -> list[tuple[str, str | None]]:
    return [(lit, field) for lit, field, _, _ in string.Formatter().parse(template)]


def render(template: str, strip: bool = False, **slots) -> Column:
    parts: list[Column] = []
    for literal, field in template_parts(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            value = slots[field]
            parts.append((F.col(value) if isinstance(value, str) else value).cast("string"))
    out = F.concat(*parts) if parts else F.lit("")
    return ustrip(out) if strip else out


def chat_prompt(prompt, text) -> Column:
    """(d) two-turn chat wrapper around a rewrite request."""
    return render(FV.CHAT_TEMPLATE, prompt=prompt, text=text)


def training_text(input_json, output_json) -> Column:
    """(e) training instruction with the JSON input and output."""
    return render(FV.TRAINING_TEMPLATE, input=input_json, output=output_json)


def inference_instruction(json_input) -> Column:
    """(f) instruction asking a model to recover the prompt."""
    return render(FV.INFERENCE_INSTRUCTION_TEMPLATE, json_input=json_input)


def prompt_creation_request(n) -> Column:
    """(a) request for ``n`` new prompt descriptions."""
    return render(FV.PROMPT_CREATION_TEMPLATE, strip=True, n=n)


def text_from_description_request(json_input) -> Column:
    """(b) request for a text fitting a JSON description."""
    return render(FV.TEXT_FROM_DESCRIPTION_TEMPLATE, strip=True, json_input=json_input)


def variation_request(original_prompt, variation) -> Column:
    """(c) request for one variation of a prompt."""
    return render(FV.VARIATION_REQUEST_TEMPLATE, strip=True,
                  original_prompt=original_prompt, variation=variation)
