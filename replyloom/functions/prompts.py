"""Prompt text as columns. The wording is this package's own; pass a template to change it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from replyloom.constants import TAXONOMY
from replyloom.functions.text import _col

CLASSIFY_TEMPLATE = (
    "Assign the support message to one label out of: {labels}.\n"
    'Answer with one JSON object holding "intent", "confidence" (0 to 1) and a short '
    '"rationale". Use "other" with low confidence when no label fits.\n'
    "Labelled messages:\n{examples}\n"
    "Message: {message}"
)

SECOND_LOOK_TEMPLATE = (
    "{first_prompt}\nYour answer was: {first_answer}\n"
    'You chose "other". Check once more whether one of {labels} describes the message well '
    "enough, and answer with the same JSON object."
)

REPLY_TEMPLATE = (
    "Write the brand's next reply to the customer in one to three sentences. Follow the tone of "
    "the resolved cases and promise nothing that they do not support.\n"
    "Resolved cases:\n{examples}\n"
    "Customer: {message}\n"
    "Reply:"
)

JUDGE_TEMPLATE = (
    "Score the reply from 1 to 5 on relevance, correctness, tone and completeness, and give an "
    '"overall" score from 1 to 5 and a "rationale". Answer with one JSON object.\n'
    "Customer: {message}\n"
    "Reply: {reply}"
)

LABELLED_EXAMPLES = (
    ("smoke came out of the charger and it burned my hand", "safety_incident"),
    ("well done to the team at the desk, lovely people", "feedback_praise"),
    ("can I export last year's invoices as one file?", "general_inquiry"),
    ("the zip of the jacket tore on its second day", "product_defect"),
    ("the app calls my PIN wrong though I never changed it", "account_access"),
    ("the flowers were left two streets from our house", "order_delivery"),
    ("four broken promises of a call back, put your boss on", "complaint_escalation"),
    ("you took the yearly fee in March and again in April", "billing_refund"),
)


def fill(template: str, **values: Column | str) -> Column:
    """Replace each ``{name}`` by its column. Columns are not scanned for further braces."""
    parts: list[Column] = []
    rest = template
    while rest:
        start = rest.find("{")
        if start < 0:
            parts.append(F.lit(rest))
            break
        end = rest.index("}", start)
        if start:
            parts.append(F.lit(rest[:start]))
        parts.append(F.coalesce(_col(values[rest[start + 1:end]]), F.lit("")))
        rest = rest[end + 1:]
    return F.concat(*parts)


#: What stands before the customer's text and between it and the brand's reply.
CASE_LAYOUT = ("Asked: ", " / Answered: ")


def example_line(customer_text: Column | str, brand_reply: Column | str) -> Column:
    """One retrieved case as one line."""
    return F.concat(F.lit(CASE_LAYOUT[0]), F.coalesce(_col(customer_text), F.lit("")),
                    F.lit(CASE_LAYOUT[1]), F.coalesce(_col(brand_reply), F.lit("")))


def labelled_lines(examples: Sequence[tuple[str, str]]) -> str:
    return "\n".join(f"{label}: {text}" for text, label in examples)


def examples_block(ranked_lines: Column) -> Column:
    """Join ``array<struct<rank, line>>`` into one text, best rank first."""
    return F.array_join(F.transform(F.array_sort(ranked_lines), lambda e: e["line"]), "\n")


def classify_prompt(message: Column | str, examples: Sequence[tuple[str, str]] = LABELLED_EXAMPLES,
                    taxonomy: Sequence[str] = TAXONOMY, template: str = CLASSIFY_TEMPLATE) -> Column:
    return fill(template, labels=F.lit(", ".join(taxonomy)),
                examples=F.lit(labelled_lines(examples)), message=message)


def second_look_prompt(first_prompt: Column | str, first_answer: Column | str,
                       taxonomy: Sequence[str] = TAXONOMY,
                       template: str = SECOND_LOOK_TEMPLATE) -> Column:
    return fill(template, first_prompt=first_prompt, first_answer=first_answer,
                labels=F.lit(", ".join(taxonomy)))


def reply_prompt(message: Column | str, examples: Column | str,
                 template: str = REPLY_TEMPLATE) -> Column:
    return fill(template, message=message, examples=examples)


def judge_prompt(message: Column | str, reply: Column | str,
                 template: str = JUDGE_TEMPLATE) -> Column:
    return fill(template, message=message, reply=reply)
