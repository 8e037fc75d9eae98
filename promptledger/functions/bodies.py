"""Request bodies: JSON shape tests, text flattening and rewriting."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptledger.functions.findings import literal
from promptledger.session import settle

@dataclass(frozen=True)
class ProviderRoute:
    """A protected path and how its bodies are laid out."""

    path: str
    provider: str
    system_field: str | None = None
    messages_field: str = "messages"
    content_field: str = "content"


# The two protected paths and their providers.
ROUTES: tuple[ProviderRoute, ...] = (
    ProviderRoute("/v1/chat/completions", "openai"),
    ProviderRoute("/v1/messages", "anthropic", system_field="system"),
)

# Error text per code.
BODY_ERRORS = {
    "empty_body": "Request body is empty.",
    "invalid_json": "Request body is not valid JSON.",
    "not_an_object": "Request body must be a JSON object at the top level.",
    "missing_model": "Field 'model' is required.",
    "missing_messages": "Field 'messages' must be a non-empty list.",
}


def normal_path(path: Column) -> Column:
    """The path without trailing slashes; nothing left means the root."""
    bare = F.rtrim(path, F.lit("/"))
    return F.when(bare == "", "/").otherwise(bare)


def provider_of_path(path: Column, routes: Sequence[ProviderRoute] = ROUTES) -> Column:
    """Exact, case-sensitive lookup; an unknown path gives NULL."""
    found = F.lit(None).cast("string")
    for route in reversed(routes):
        found = F.when(normal_path(path) == route.path, route.provider).otherwise(found)
    return found


def field(value: Column, name: str) -> Column:
    """A member of an object, NULL when absent; a JSON null is not NULL."""
    return F.try_variant_get(value, f"$.{name}", "variant")


def text_or_null(value: Column) -> Column:
    """The string in a variant, NULL for any other type."""
    return F.when(
        F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")
    )


def list_or_null(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def with_parsed(df: DataFrame, body: str, out: str) -> DataFrame:
    """Add the parsed body as a variant, NULL when it is not one JSON value.

    Spark's parser stops after the first value, so ``{} x`` would pass. Parsed
    as ``[[body], mark]``, anything after the value breaks the array.
    """
    mark = F.xxhash64(body).cast("string")
    wrapped = F.concat(F.lit("[["), F.col(body), F.lit('],"'), mark, F.lit('"]'))
    whole = df.withColumn("_whole", F.try_parse_json(wrapped)).withColumn("_mark", mark)
    at = lambda path: F.try_variant_get("_whole", path, "variant")
    alone = at("$[0][1]").isNull() & at("$[2]").isNull()
    marked = F.try_variant_get("_whole", "$[1]", "string") == F.col("_mark")
    parsed = whole.withColumn(out, F.when(alone & marked, at("$[0][0]"))).drop("_whole", "_mark")
    return settle(parsed, out)


def is_object(body: Column, parsed: Column) -> Column:
    first = F.left(F.ltrim(body, F.lit(" \t\r\n")), F.lit(1))
    return parsed.isNotNull() & (first == "{")


def body_error(
    body: Column, parsed: Column, provider: Column | None = None, routes: Sequence[ProviderRoute] = ROUTES
) -> Column:
    """The code of the first thing wrong with a body, NULL for a good one."""
    model = text_or_null(field(parsed, "model"))
    messages = list_or_null(field(parsed, "messages"))
    for route in routes if provider is not None else ():
        if route.messages_field != "messages":
            own = list_or_null(field(parsed, route.messages_field))
            messages = F.when(provider == route.provider, own).otherwise(messages)
    return (
        F.when(body.isNull() | (body == ""), "empty_body")
        .when(parsed.isNull(), "invalid_json")
        .when(~is_object(body, parsed), "not_an_object")
        .when(model.isNull() | (model == ""), "missing_model")
        .when(messages.isNull() | (F.size(messages) == 0), "missing_messages")
    )


def error_text(code: Column) -> Column:
    text = F.lit(None).cast("string")
    for name, message in BODY_ERRORS.items():
        text = F.when(code == name, message).otherwise(text)
    return text


def detect_provider(parsed: Column) -> Column:
    """A ``system`` member, even null, or a model called claude..., means anthropic."""
    model = text_or_null(field(parsed, "model"))
    claude = F.coalesce(F.lower(model).startswith("claude"), F.lit(False))
    return F.when(field(parsed, "system").isNotNull() | claude, "anthropic").otherwise("openai")


def _text_sql(value: str) -> str:
    """SQL for the string in a variant, NULL for any other type."""
    return f"""CASE WHEN schema_of_variant({value}) = 'STRING'
      THEN try_variant_get({value}, '$', 'string') END"""


def _content_sql(content: str) -> str:
    """SQL: a string as it is, the text parts of a list joined by newlines, else ''."""
    part = f"""coalesce({_text_sql('p')}, {_text_sql("try_variant_get(p, '$.text', 'variant')")})"""
    return f"""coalesce({_text_sql(content)},
      transform(array(try_variant_get({content}, '$', 'array<variant>')), parts ->
        CASE WHEN parts IS NOT NULL THEN array_join(transform(parts, p -> {part}), '\n') END)[0], '')"""


def _texts_sql(parsed: str, route: ProviderRoute) -> str:
    """SQL: the texts of a body with this route's layout, system text first."""
    message = _content_sql(f"try_variant_get(m, '$.{route.content_field}', 'variant')")
    messages = f"""transform(try_variant_get({parsed}, '$.{route.messages_field}', 'array<variant>'),
      m -> {message})"""
    if route.system_field is None:
        return messages
    system = _content_sql(f"try_variant_get({parsed}, '$.{route.system_field}', 'variant')")
    return f"concat(array({system}), {messages})"


def prompt_text(parsed: str, provider: str, routes: Sequence[ProviderRoute] = ROUTES) -> Column:
    """Message texts of variant column ``parsed`` in order, joined by newlines.

    Empty texts are skipped. Column ``provider`` names the route whose fields hold
    the system text, which comes first, and the messages; NULL gives NULL.
    """
    layouts: dict[tuple, list[ProviderRoute]] = {}
    for route in routes:
        layouts.setdefault((route.system_field, route.messages_field, route.content_field), []).append(route)
    cases = " ".join(
        f"WHEN {provider} IN ({', '.join(literal(r.provider) for r in same)}) THEN {_texts_sql(parsed, same[0])}"
        for same in layouts.values()
    )
    return F.expr(f"array_join(filter(CASE {cases} END, t -> t <> ''), '\n')")


def chat_body(model: Column, text: Column) -> Column:
    """The smallest chat body that carries ``text``."""
    message = F.struct(F.lit("user").alias("role"), text.alias("content"))
    return F.to_json(F.struct(model.alias("model"), F.array(message).alias("messages")))


@dataclass
class _Slot:
    """A string that a redaction may change, and where the joined prompt has it."""

    container: dict | list
    key: str | int
    start: int = -1

    @property
    def text(self) -> str:
        return self.container[self.key]

    @text.setter
    def text(self, text: str) -> None:
        self.container[self.key] = text


def _text_slots(document: dict, route: ProviderRoute) -> list[list[_Slot]]:
    """The strings of each message, system text first."""
    content = route.content_field
    holders = [(m, content) for m in document.get(route.messages_field) or [] if isinstance(m, dict)]
    if route.system_field is not None and route.system_field in document:
        holders.insert(0, (document, route.system_field))
    groups = []
    for holder, key in holders:
        value = holder.setdefault(key, None)
        slots = [_Slot(holder, key)] if isinstance(value, str) else []
        for at, part in enumerate(value if isinstance(value, list) else ()):
            if isinstance(part, str):
                slots.append(_Slot(value, at))
            elif isinstance(part, dict) and isinstance(part.get("text"), str):
                slots.append(_Slot(part, "text"))
        groups.append(slots)
    return groups


def _joined(groups: list[list[_Slot]]) -> str:
    """The prompt, joined as :func:`prompt_text` does; slots learn their places."""
    texts, end = [], 0
    for slots in groups:
        text = "\n".join(slot.text for slot in slots)
        at = end
        for slot in slots:
            slot.start = at
            at += len(slot.text) + 1
        if text:
            texts.append(text)
            end += len(text) + 1
    return "\n".join(texts)


def _cut(slot: _Slot, swaps: Sequence[dict]) -> None:
    """Replace what the swaps' spans cover in this slot; where they overlap, the whole
    is replaced. A span that began in an earlier slot leaves nothing here."""
    stop = slot.start + len(slot.text)
    merged: list[tuple[int, int, list[str]]] = []
    for swap in sorted(swaps, key=lambda s: (s["span_start"], s["span_end"])):
        begin, end = max(swap["span_start"], slot.start), min(swap["span_end"], stop)
        if begin >= end:
            continue
        said = [swap["replacement"]] if begin == swap["span_start"] else []
        if merged and begin < merged[-1][1]:
            first, last, earlier = merged.pop()
            merged.append((first, max(last, end), earlier + [t for t in said if t not in earlier]))
        else:
            merged.append((begin, end, said))
    for begin, end, said in reversed(merged):
        text = slot.text
        slot.text = text[: begin - slot.start] + "".join(said) + text[end - slot.start :]


def _redact(groups: list[list[_Slot]], swaps: Sequence[dict]) -> bool:
    """Make the swaps; false if a match that spans slots is still there."""
    joined, slots = _joined(groups), [slot for group in groups for slot in group]

    def spans_slots(swap) -> bool:
        begin, end = swap["span_start"], swap["span_end"]
        if begin is None or end is None or joined[begin:end] != swap["original"]:
            return "\n" in swap["original"] and not any(swap["original"] in slot.text for slot in slots)
        return not any(slot.start <= begin and end <= slot.start + len(slot.text) for slot in slots)

    across = [swap for swap in swaps if spans_slots(swap)]
    if across:
        placed = [s for s in swaps if s["span_start"] is not None and joined[s["span_start"] : s["span_end"]] == s["original"]]
        for slot in slots:
            _cut(slot, placed)
    for slot in slots:
        for swap in swaps:
            slot.text = slot.text.replace(swap["original"], swap["replacement"])
    if not across:
        return True
    left = _joined(groups)
    return not any(swap["original"] in left for swap in across)


def _encodes(text: str) -> bool:
    try:
        text.encode("utf-8")
    except UnicodeEncodeError:
        return False
    return True


def rewrite_bodies(routes: Sequence[ProviderRoute] = ROUTES):
    """An Arrow UDF ``(body, provider, swaps) -> body``.

    It replaces inside the text fields only and keeps the shape, the member
    order and every other field. Rows without swaps should pass a NULL body,
    which costs nothing. A match that spans several text fields is cut out of each,
    its replacement standing where it began. A body that Python cannot read gives NULL,
    and so does one that still holds such a match; one with lone
    surrogates comes back with escapes for all but ASCII.
    """
    by_provider = {r.provider: r for r in routes}

    def rewrite(body: str, provider: str, swaps) -> str | None:
        try:
            document = json.loads(body)
        except (ValueError, RecursionError):  # numbers of thousands of digits, deep nesting
            return None
        if not _redact(_text_slots(document, by_provider[provider]), swaps):
            return None
        text = json.dumps(document, ensure_ascii=False)
        return text if text.isascii() or _encodes(text) else json.dumps(document)

    @F.pandas_udf(T.StringType())
    def rewritten(body: pd.Series, provider: pd.Series, swaps: pd.Series) -> pd.Series:
        return pd.Series(
            [
                None if b is None else rewrite(b, p, s)
                for b, p, s in zip(body, provider, swaps, strict=True)
            ],
            dtype=object,
        )

    return rewritten
