"""JSON payloads of tool calls and results, as column expressions over JSON text."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names for results whose call isn't known, and beginnings of texts that a harness puts in a user's mouth.
SOURCE_NAMES = {"subagent_notification": "Subagent", "function_call_output": "FunctionCall", "queue_event": "QueueEvent", "progress_event": "ProgressEvent", "tool_result": "Tool"}
CARRIERS = ("tool_result", "function_call_output")
BOILERPLATE = (r"(?i)^\s*<environment_context", r"(?i)^\s*<permissions", r"(?i)^\s*<collaboration_mode", r"^\s*<INSTRUCTIONS>", r"(?i)^\s*#\s*AGENTS\.md")
PREVIEW = 200


def result_text(content: Column) -> Column:
    """A result's content as text: a string as it is, null as the empty one; of a list the texts of text blocks and strings, other
    blocks as JSON, joined by line feeds (numbers and the like left out); anything else as JSON."""
    value = F.try_parse_json(content)
    kind = F.schema_of_variant(value)

    def block(b: Column) -> Column:
        own = F.schema_of_variant(b)
        said = F.when(F.try_variant_get(b, "$.type", "string") == "text", F.when(F.schema_of_variant(F.try_variant_get(b, "$.text", "variant")) == "STRING", F.try_variant_get(b, "$.text", "string")))
        return F.when(own == "STRING", F.try_variant_get(b, "$", "string")).when(own.startswith("OBJECT"), F.coalesce(said, F.to_json(b))).when(own.startswith("ARRAY"), F.to_json(b))

    listed = F.array_join(F.filter(F.transform(F.try_variant_get(value, "$", "array<variant>"), block), lambda x: x.isNotNull()), "\n")
    return F.when(content.isNull() | (kind == "VOID"), "").when(value.isNull(), content).when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(kind.startswith("ARRAY"), listed).otherwise(F.to_json(value))


def content_bytes(content: Column) -> Column:
    """Bytes of a content: of a string its own, of anything else its JSON's."""
    value = F.try_parse_json(content)
    return F.octet_length(F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise(content)).cast("long")


def replacement_meta(block: Column) -> Column:
    """(replaced, collapsed) that a result block's ``_meta``, else the first that has one in its content, tells of the calls it stands for; null
    if neither names a tool or a positive number."""
    names = lambda j: F.filter(F.coalesce(F.from_json(F.get_json_object(j, "$.replaces"), "array<string>"), F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")
    many = lambda j: F.floor(F.get_json_object(j, "$.collapsedCalls").try_cast("double")).cast("long")

    def told(j: Column) -> Column:
        n = F.when(F.get_json_object(j, "$.collapsedCalls").try_cast("double") > 0, many(j))
        return F.when((F.size(names(j)) > 0) | n.isNotNull(), F.struct(F.when(F.size(names(j)) > 0, names(j)).alias("replaced"), n.alias("collapsed")))

    inner = F.from_json(F.get_json_object(block, "$.content"), "array<string>")
    nested = F.filter(F.transform(inner, lambda b: told(F.get_json_object(b, "$._meta"))), lambda m: m.isNotNull())
    return F.coalesce(told(F.get_json_object(block, "$._meta")), F.get(nested, F.lit(0)))


def edit_preview(arguments: Column) -> Column:
    """(old, new) of an edit's arguments, cut to PREVIEW characters; a written content counts as new; null without either."""
    from ledgerloom.functions.text import ellipsis

    one = lambda k: F.coalesce(F.get_json_object(arguments, f"$.{k}"), F.lit(""))
    old, new = one("old_string"), F.when(one("new_string") != "", one("new_string")).otherwise(one("content"))
    return F.when((old != "") | (new != ""), F.struct(ellipsis(old, PREVIEW).alias("old"), ellipsis(new, PREVIEW).alias("new")))


def boilerplate(text: Column) -> Column:
    """Whether a user message is the harness's own."""
    return text.rlike("|".join(f"(?:{p})" for p in BOILERPLATE))


def is_carrier(event_source: Column) -> Column:
    """Whether an event carries its call's own result."""
    return F.coalesce(event_source.isin(*CARRIERS), F.lit(False))


def display_name(tool: Column, event_source: Column) -> Column:
    """A call's tool, else a name for the kind of event."""
    return F.coalesce(tool, F.try_element_at(F.create_map(*[F.lit(x) for kv in SOURCE_NAMES.items() for x in kv]), event_source))


def one_source(event_source: Column) -> Column:
    """Aggregate: the events' source if they share one, else ``mixed``."""
    return F.when(F.count_distinct(event_source) == 1, F.min(event_source)).otherwise("mixed")


def round_digits(value: float, digits: int) -> float:
    """Rounding of the exact binary value, halves to even."""
    return float(Decimal(value).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_EVEN))


def usd(value: float) -> str:
    return f"${Decimal(value).quantize(Decimal('0.0001'), rounding=ROUND_HALF_EVEN)}"


def commas(n: int) -> str:
    return f"{n:,}"
