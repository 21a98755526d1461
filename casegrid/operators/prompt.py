"""Prompts: binding a document to a template, examples, and what a call costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casegrid.functions.nulls import trim
from casegrid.functions.text import squish

#: US dollars per million tokens, in and out, by model.
PRICES = {
    "gpt-5": (1.25, 10.0),
    "gpt-5-nano": (0.05, 0.4),
    "gpt-4o": (2.5, 10.0),
    "claude-sonnet-4-6": (3.0, 15.0),
    "claude-haiku-4-5": (1.0, 5.0),
}
#: The model that a provider uses if none is named.
DEFAULT_MODELS = {
    "azure": "gpt-5",
    "claude": "claude-sonnet-4-6",
    "openai": "gpt-4o",
    "gemini": "gemini-1.5-pro",
    "ollama": "llama3.3:latest",
    "mlx": "mlx-community/Qwen3.5-9B-MLX-4bit",
}
MARKERS = ("<outbreak_narrative>", "<outbreak_report>")
_TAIL = "\n\nHere is the outbreak narrative to analyse:"


def bind(template: Column | str, content: Column | str) -> Column:
    """The template with its first ``{{content}}``, or else its first ``{content}``, replaced; the content is taken as it is."""
    t = F.lit(template) if isinstance(template, str) else template
    c = F.col(content) if isinstance(content, str) else content

    def put(mark: str) -> Column:
        at = F.instr(t, F.lit(mark))
        return F.when(at > 0, F.concat(F.substring(t, F.lit(1), at - 1), c, F.substring(t, at + len(mark), F.length(t))))

    return F.coalesce(put("{{content}}"), put("{content}"), t)


def insert_examples(template: Column, examples: Column) -> Column:
    """Examples before the narrative's marker, or at the end; blank examples change nothing."""
    out = F.concat(template, F.lit("\n\n"), examples)
    for mark in reversed(MARKERS):
        at = F.instr(template, F.lit(mark))
        out = F.when(at > 0, F.concat(F.substring(template, F.lit(1), at - 1), examples, F.lit("\n"), F.substring(template, at, F.length(template)))).otherwise(out)
    return F.when(examples.isNull() | (trim(examples) == ""), template).otherwise(out)


#: Kinds of prompts; all use the one bundled template.
PROMPT_TYPES = ("ebola_narrative", "msf", "generic")


def system_prompt(content: Column | str, prompt_type: str = "ebola_narrative") -> Column:
    """The bundled template with the document in it; an unknown kind of prompt is an error."""
    if prompt_type not in PROMPT_TYPES:
        raise ValueError(f"unknown kind of prompt {prompt_type}")
    from casegrid.sources.files import template

    return bind(template(), content)


def sample_words(content: Column | str, n: int = 400) -> Column:
    """The first ``n`` words, joined by single blanks."""
    return F.array_join(F.slice(F.split(squish(content), " "), 1, n), " ")


def auto_prompt(template: str, content: Column | str, provider: str, model: str, n: int = 400) -> Column:
    """The template with a note on the document's beginning and on the model in use."""
    return F.concat(F.lit(template), F.lit("\n\nDocument sample:\n"), sample_words(content, n), F.lit(f"\n\nProvider: {provider}. Model: {model}."))


def instructions(prompt: Column | str) -> Column:
    """The prompt without its narrative part."""
    p = F.col(prompt) if isinstance(prompt, str) else prompt
    at = F.instr(p, F.lit(_TAIL))
    return F.when(at > 0, F.substring(p, F.lit(1), at - 1)).otherwise(p)


def token_estimate(c: Column | str) -> Column:
    return F.ceil(F.length(F.col(c) if isinstance(c, str) else c) / 4)


def cost(model: Column, prompt_tokens: Column, completion_tokens: Column) -> Column:
    """US dollars; null for a model without a price."""
    price = lambda i: F.create_map(*(F.lit(x) for k, v in PRICES.items() for x in (k, v[i])))[model]
    return (prompt_tokens * price(0) + completion_tokens * price(1)) / 1e6
