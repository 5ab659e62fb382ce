"""Scalar functions: canonical JSON, typed values, exact ratios, keys and times.

Everything that queries use at run time is a column expression; Python evaluates only canonical
JSON of ingested lines, full casefold and Unicode normalisation, in Arrow batches.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
import uuid
from datetime import UTC, datetime
from json.encoder import encode_basestring
from math import isfinite

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAFE_INTEGER = 2**53 - 1
#: Namespace of name-based ids.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:factloom")


def _pairs(items):
    out = dict(items)
    if len(out) != len(items):
        raise ValueError("duplicate object key")
    return out


def _refuse(word):
    raise ValueError(f"non-finite number {word}")


def _number(word):
    value = float(word)
    if value in (float("inf"), float("-inf")):
        _refuse(word)
    return value


#: Made once: a call of json.loads or json.dumps with options makes its own for each value.
_STRICT = json.JSONDecoder(object_pairs_hook=_pairs, parse_constant=_refuse, parse_float=_number)
_CANONICAL = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def strict_loads(text: str):
    """JSON without duplicate keys and non-finite numbers."""
    return _STRICT.decode(text)


def canonical_json(value) -> str:
    kind = type(value)
    if kind is str:
        return encode_basestring(value)
    return repr(value) if kind is int or kind is float and isfinite(value) else _CANONICAL.encode(value)


def sha256_json(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def stable_uuid(kind: str, *parts) -> str:
    return str(uuid.uuid5(NAMESPACE, canonical_json([kind, *parts])))


_JSON_TYPES = {type(None): "null", bool: "boolean", int: "number", float: "number", str: "string", list: "array", dict: "object"}


def json_type(value) -> str:
    """null, boolean, number, string, array or object; a boolean is no number."""
    return _JSON_TYPES[type(value)]


def json_pointer(document, pointer: str):
    """RFC 6901; raises KeyError where nothing is."""
    if pointer and not pointer.startswith("/"):
        raise KeyError(pointer)
    for token in pointer.split("/")[1:]:
        token = token.replace("~1", "/").replace("~0", "~")
        if isinstance(document, list):
            if not token.isdigit() or token != str(int(token)) or int(token) >= len(document):
                raise KeyError(pointer)
            document = document[int(token)]
        elif isinstance(document, dict) and token in document:
            document = document[token]
        else:
            raise KeyError(pointer)
    return document


def normalize_timestamp(text: str) -> str:
    """ISO 8601 with an offset, as UTC seconds with Z."""
    at = datetime.fromisoformat(text)
    if at.tzinfo is None:
        raise ValueError("timestamp without an offset")
    return at.astimezone(UTC).replace(microsecond=0).isoformat().replace("+00:00", "Z")


def normalize_text(text: str) -> str:
    return unicodedata.normalize("NFC", text.replace("\r\n", "\n").replace("\r", "\n")).strip()


@F.pandas_udf(T.StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return s.str.casefold()


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(normalize_text, na_action="ignore")


def casefold(c: Column, ascii_only: bool = False) -> Column:
    """Unicode casefold; known ASCII data stays in generated code."""
    return F.lower(c) if ascii_only else _casefold(c)


def tokens(c: Column) -> Column:
    """Distinct lower-case words of letters, digits and underscores."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0)))


def as_integer(number: Column, exact: Column | None = None) -> Column:
    """A safe integer as decimal; anything else raises when it is used."""
    value = (exact if exact is not None else number).cast("decimal(38,0)")
    whole = F.lit(True) if exact is not None else number == F.floor(number)
    ok = whole & (F.abs(value) <= SAFE_INTEGER)
    return F.when(number.isNull() & (exact.isNull() if exact is not None else F.lit(True)), F.lit(None).cast("decimal(38,0)")).when(ok, value).otherwise(F.raise_error(F.lit("analytics_error: sum needs safe integers")).cast("decimal(38,0)"))


def exact_ratio(n: Column, d: Column) -> Column:
    """n/d as a decimal string of 12 places, half-even; null where d is 0. n, d: safe integers."""
    return F.when(d == 0, F.lit(None).cast("string")).otherwise(_ratio_text(n, d))


def _ratio_text(n: Column, d: Column) -> Column:
    parts = _long_division(n, d)
    sign = F.when((n < 0) != (d < 0), F.lit("-")).otherwise(F.lit(""))
    x = parts["r"].cast("decimal(18,0)") * F.lit(10**12).cast("decimal(13,0)")
    f, t = _div(x, parts["d"]), _mod(x, parts["d"])
    up = (t * 2 > parts["d"]) | ((t * 2 == parts["d"]) & (f % 2 == 1))
    f = f + F.when(up, 1).otherwise(0)
    carry = f == 10**12
    return F.concat(sign, (parts["ip"] + F.when(carry, 1).otherwise(0)).cast("string"), F.lit("."), F.lpad(F.when(carry, F.lit(0)).otherwise(f).cast("string"), 12, "0"))


def _DIV(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _div(a: Column, b: Column) -> Column:
    """Integral quotient (bigint) of non-negative operands."""
    return _DIV(a, b)


def _mod(a: Column, b: Column) -> Column:
    return a % b


def _long_division(n: Column, d: Column) -> dict[str, Column]:
    an, ad = F.abs(n.cast("decimal(18,0)")), F.abs(d.cast("decimal(18,0)"))
    return {"ip": _div(an, ad), "r": an % ad, "d": ad}


def ratio_sort_key(n: Column, d: Column) -> Column:
    """A struct that orders n/d exactly (safe integers, d not 0)."""
    p = _long_division(n, d)
    scale = F.lit(10**18).cast("decimal(19,0)")
    x1 = p["r"] * scale
    y1 = _div(x1, p["d"])
    y2 = _div((x1 % p["d"]).cast("decimal(18,0)") * scale, p["d"])
    sign = F.when((n < 0) != (d < 0), -1).otherwise(1)
    return F.when(d == 0, F.lit(None)).otherwise(F.struct((p["ip"] * sign).alias("ip"), (y1 * sign).alias("f1"), (y2 * sign).alias("f2")))


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine of an array<float|double> column with a fixed vector, in double."""
    v = F.transform(vector, lambda x: x.cast("double"))
    q = F.array(*(F.lit(float(x)) for x in query))
    norm = sum(x * x for x in map(float, query)) ** 0.5
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    own = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((own > 0) & F.lit(norm > 0), dot / (own * F.lit(norm)))
