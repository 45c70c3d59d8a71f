"""Operators on arrays, maps and JSON documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASKED = -100


def common_prefix(a: Column, b: Column) -> Column:
    """The number of leading elements on which two arrays agree."""
    differs = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
    at = F.array_position(differs, F.lit(True))
    return F.when(at > 0, (at - 1).cast("int")).otherwise(F.least(F.size(a), F.size(b)))


def masked_labels(prompt: Column, full: Column) -> Column:
    """``full`` with the elements it shares with the prompt's beginning masked."""
    n = common_prefix(prompt, full)
    return F.concat(F.array_repeat(F.lit(MASKED), n), F.slice(full, n + 1, F.greatest(F.lit(0), F.size(full) - n)))


def supervised(labels: Column) -> Column:
    return F.size(F.filter(labels, lambda x: x != MASKED))


def is_trainable(labels: Column, end_id: int) -> Column:
    """Some label is left, and the end of the answer among them."""
    return (supervised(labels) > 0) & F.exists(labels, lambda x: x == end_id)


def shifted_loss(losses: Column, labels: Column) -> Column:
    """Mean loss over unmasked labels, labels taken one place on; 0 if all are masked."""
    kept = F.transform(F.slice(labels, 2, F.greatest(F.lit(0), F.size(labels) - 1)), lambda x: (x != MASKED).cast("double"))
    total = F.aggregate(F.zip_with(losses, kept, lambda v, m: F.coalesce(v, F.lit(0.0)) * F.coalesce(m, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    count = F.aggregate(kept, F.lit(0.0), lambda s, x: s + x)
    return total / F.greatest(F.lit(1.0), count)


def padded_length(longest: Column, multiple: int = 8) -> Column:
    return (F.ceil(longest / F.lit(multiple)) * multiple).cast("int")


def padded(ids: Column, length: Column, value: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(F.lit(0), length - F.size(ids))))


def appended_if_new(existing: Column, more: Column) -> Column:
    """``existing`` and those of ``more`` that it does not hold (but for case)."""
    return F.concat(existing, F.filter(more, lambda x: ~F.exists(existing, lambda y: F.lower(y) == F.lower(x))))


def patched(document: Column, patch: Column) -> Column:
    """One map laid over another, key by key."""
    kept = F.map_filter(document, lambda k, _: ~F.array_contains(F.map_keys(patch), k))
    return F.map_concat(kept, patch)


def as_text(json: Column, separator: str = "\n", strip_items: bool = False) -> Column:
    """A JSON value as text: a string itself, a list joined, anything else as it is written."""
    v = F.try_parse_json(json)
    kind = F.schema_of_variant(v)
    items = F.from_json(json, "array<string>")
    if strip_items:
        items = F.transform(items, lambda x: F.trim(x))
    return (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when(kind == "VOID", F.lit(None).cast("string"))
        .when(kind == "STRING", F.variant_get(v, "$", "string"))
        .when(kind.startswith("ARRAY"), F.array_join(F.filter(items, lambda x: x.isNotNull()), separator))
        .otherwise(json)
    )


def is_key_set(json: Column, keys: list[str]) -> Column:
    """Whether a JSON object has exactly these keys."""
    return F.sort_array(F.json_object_keys(json)).eqNullSafe(F.array(*[F.lit(k) for k in sorted(keys)]))
