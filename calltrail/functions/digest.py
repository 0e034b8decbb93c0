"""Canonical text and digest of JSON values, for values that were captured as JSON.

A value's canonical text is hashed whole, its rendering is redacted and cut afterwards. JSON has no identity, so there are no back references; depth and
element limits follow the capture side's defaults. The canonical walk is a small Python helper inside an Arrow-batched UDF; flat rows do with sha_digest.
"""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calltrail.functions.scalars import CREDENTIALS, SENSITIVE_NAMES

MAX_DEPTH, MAX_ELEMENTS, CANONICAL_CAP, RENDERED_CAP = 6, 16, 65_536, 2000
_PATH = re.compile(r"^[A-Za-z]:[\\/]|^/[^/]*/|^\\\\")
_SECRET = re.compile("|".join(f"(?:{p})" for p in CREDENTIALS.values()))


def canonical(value, redact: bool = False, depth: int = 0, name: str = "") -> str:
    if value is None:
        return "null"
    if redact and name and any(w in name.lower() for w in SENSITIVE_NAMES):
        return "<redacted>"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        if redact and _SECRET.search(value):
            return "<redacted>"
        return "<path>" if len(value) > 2 and _PATH.search(value) else f'"{value}"'
    if isinstance(value, (int, float)):
        return repr(value)
    if depth >= MAX_DEPTH:
        return "<depth:Object>" if isinstance(value, dict) else "<depth:List>"
    if isinstance(value, list):
        shown = [canonical(x, redact, depth + 1) for x in value[:MAX_ELEMENTS]]
        return f"List({len(value)})[{', '.join(shown)}{', <truncated>' if len(value) > MAX_ELEMENTS else ''}]"
    return "{" + "; ".join(f"{k}={canonical(value[k], redact, depth + 1, k)}" for k in sorted(value)) + "}"


def tagged(value, redact: bool = False) -> str:
    tag = "ShapeRule:List" if isinstance(value, list) else "StructuralFields" if isinstance(value, dict) else "Primitive"
    text = f"{tag}:{canonical(value, redact)}"
    return text if len(text) <= CANONICAL_CAP else text[:CANONICAL_CAP] + "<truncated>"


# A type object: a type in words needs a session, which is not there yet on import.
@F.pandas_udf(T.StructType().add("digest", "string").add("rendered", "string"))
def json_digest(values: pd.Series) -> pd.DataFrame:
    """digest and rendered text of JSON texts; text that is no JSON is a string value, null stays null."""
    out = []
    for v in values:
        if v is None:
            out.append((None, None))
            continue
        try:
            value = json.loads(v)
        except ValueError:
            value = v
        shown = tagged(value, redact=True)
        out.append(("sha256:" + hashlib.sha256(tagged(value).encode()).hexdigest(), shown if len(shown) <= RENDERED_CAP else shown[:RENDERED_CAP] + "<truncated>"))
    return pd.DataFrame(out, columns=["digest", "rendered"])
