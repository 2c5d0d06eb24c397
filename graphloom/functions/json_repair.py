"""JSON as models write it: in fences, in prose, with commas before a closing bracket."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_OPENING, _CLOSING = re.compile(r"^```(?:json)?\s*", re.I), re.compile(r"\s*```$")
_BLOCK, _COMMAS = re.compile(r"\{.*\}|\[.*\]", re.S), re.compile(r"(?:,\s*)+(?=[}\]])")
KINDS = {"list": list, "dict": dict}


def without_commas(text: str) -> str:
    """``text`` without the commas that stand before a closing bracket, however many."""
    return _COMMAS.sub("", text)


def parse(raw: str | None, kind: str | None = None):
    """The JSON value of a model's answer, or None.

    Tried in turn are the answer without its fence, the longest bracketed block in it, that block
    without loose commas, and the answer without them. The first that parses decides: if it is not of
    the wanted kind (``list`` or ``dict``), the answer has no value.
    """
    if not raw or not raw.strip():
        return None
    text = _CLOSING.sub("", _OPENING.sub("", raw.strip())).strip()
    block = _BLOCK.search(text)
    tries = [text, *([block[0], without_commas(block[0])] if block else []), without_commas(text)]
    for candidate in tries:
        try:
            value = json.loads(candidate)
        except (ValueError, RecursionError):  # nested deeper than can be read is no answer either
            continue
        return value if kind is None or isinstance(value, KINDS[kind]) else None
    return None


def finite(value):
    """``value`` with null for the numbers that JSON has no text for."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, list):
        return [finite(v) for v in value]
    return {k: finite(v) for k, v in value.items()} if isinstance(value, dict) else value


def strict(raw: str | None, kind: str) -> str | None:
    """The value of the wanted kind as strict JSON text, else None."""
    value = parse(raw, kind)
    if value is None:
        return None
    try:
        return json.dumps(finite(value), ensure_ascii=False)
    except RecursionError:
        return None


def parsed(raw: Column, kind: str) -> Column:
    """The value of the wanted kind as strict JSON text, else null.

    An answer that is strict JSON once its fence is off stays in the JVM; only the others are sent to
    Python. The parser reads no further than the end of a value, so the text is parsed as the only element of a list.
    """

    @F.pandas_udf("string")
    def python(answers: pd.Series) -> pd.Series:
        return pd.Series([strict(a, kind) for a in answers], dtype=object)

    text = unfenced(raw)
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).cast("array<variant>")
    good = F.coalesce((F.size(alone) == 1) & text.startswith("[" if kind == "list" else "{"), F.lit(False))
    return F.when(good, text).otherwise(python(F.when(~good, raw)))


def repaired(raw: Column) -> Column:
    """``without_commas`` in the JVM."""
    return F.regexp_replace(raw, r"(?:,\s*)+(?=[}\]])", "")


def block(raw: Column) -> Column:
    """The longest bracketed block, or an empty string."""
    return F.regexp_extract(raw, r"(?s)(\{.*\}|\[.*\])", 1)


def unfenced(raw: Column) -> Column:
    """The answer without a leading and a trailing fence."""
    return F.regexp_replace(F.regexp_replace(F.trim(raw), r"(?i)^```(json)?\s*", ""), r"\s*```$", "")
