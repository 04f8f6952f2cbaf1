"""Canonical JSON text: sorted keys, compact, 1.0 as 1; equal texts mean equal values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(text: Column) -> Column:
    """Null for null, and for text that is no JSON (as is NaN)."""
    return F.to_json(F.try_parse_json(text))


def payload_field(payload: Column, key: str) -> Column:
    """A key's value as text: null if it is absent or null."""
    return F.get_json_object(payload, f"$.{key}")


#: A string, a number, or what stands between them, in canonical JSON.
_TOKEN = r'"(?:[^"\\]|\\.)*+"|-?[0-9][0-9.eE+-]*+|[^"0-9-]++'


def equal_form(text: Column) -> Column:
    """A form of JSON text that is equal for values which compare as equal: numbers by value, so that 1, 1.0 and 1e0 are one, and true and
    false as 1 and 0, at any depth; strings, and keys, as they are.  Text that is no JSON stands for itself.

    Numbers with a fraction or an exponent are taken as doubles.
    """
    def form(token: Column) -> Column:
        double = token.try_cast("double")
        whole = double.try_cast("decimal(38,0)")
        number = F.when(~token.rlike("[.eE]"), F.when(token == "-0", F.lit("0")).otherwise(token)).when(whole.cast("double") == double, whole.cast("string")).otherwise(double.cast("string"))
        other = F.replace(F.replace(token, F.lit("true"), F.lit("1")), F.lit("false"), F.lit("0"))
        return F.when(token.startswith('"'), token).when(token.rlike("^-?[0-9]"), number).otherwise(other)

    tokens = F.regexp_extract_all(canonical_json(text), F.lit(_TOKEN), F.lit(0))
    return F.coalesce(F.array_join(F.transform(tokens, form), ""), text)
