"""Canonical JSON and digests of free-form payloads.

A flat struct of strings and integers is written by ``to_json``; free-form payloads go through Arrow to the one writer that
fixes how numbers look, as Spark's own writer prints floats differently.
"""

import json
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from assaya.functions.text import CENSORED_ENDS, CENSORED_ROOTS

#: The fields of a manifest that are signed, but for the one that names the producer's version.
SIGNED = ("inference_config", "input_sha256", "manifest_id", "manifest_version", "model_sha256", "nonce", "output_sha256", "preprocessing_config", "sequence", "timestamp_utc")
#: Keys that are left out of an export, and what is masked in its strings.
SECRET_KEY = re.compile(r"api_?key|secret|private_?key|token|password|auth(?:orization)?|credential", re.IGNORECASE)
SECRET_VALUE = re.compile(r"sk-[a-z0-9_-]{20,}|ghp_[a-z0-9]{30,}|Bearer\s+[a-z0-9_.-]+", re.IGNORECASE)
_LOCAL_PATH = re.compile(rf"(?:[a-z]:\\|/(?:{'|'.join(CENSORED_ROOTS)})/)[^{CENSORED_ENDS}]+", re.IGNORECASE)


def _dump(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def _canonical(text: pd.Series) -> pd.Series:
    def one(t):
        try:
            return None if t is None else _dump(json.loads(t))
        except (ValueError, RecursionError):
            return None

    return text.map(one)


def canonical(text: Column) -> Column:
    """The JSON text with sorted keys and no spaces. Null for null, for what isn't JSON, and for numbers that aren't finite."""
    return F.pandas_udf(_canonical, "string")(text)


def payload_digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def manifest_digest(manifest: Column, version_field: str) -> Column:
    """SHA-256 of the canonical signed fields of a manifest in JSON. ``version_field`` names the producer's version."""
    fields = {*SIGNED, version_field}

    @F.pandas_udf("string")
    def signed(text: pd.Series) -> pd.Series:
        def one(t):
            try:
                value = json.loads(t) if t is not None else None
                return _dump({k: v for k, v in value.items() if k in fields}) if isinstance(value, dict) else None
            except (ValueError, RecursionError):
                return None

        return text.map(one)

    return F.sha2(signed(manifest), 256)


def _without_internal_keys(text: pd.Series) -> pd.Series:
    def one(t):
        try:
            value = json.loads(t) if t is not None else None
            return _dump({k: v for k, v in value.items() if not k.startswith("__")}) if isinstance(value, dict) else None
        except (ValueError, RecursionError):
            return None

    return text.map(one)


def without_internal_keys(text: Column) -> Column:
    """The canonical payload without the top keys that begin with two underscores."""
    return F.pandas_udf(_without_internal_keys, "string")(text)


def _sanitized(text: pd.Series) -> pd.Series:
    def last(path: re.Match) -> str:
        return re.split("/" if path[0].startswith("/") else r"\\", path[0])[-1] or "local_file"

    def clean(v):
        if isinstance(v, dict):
            return {k: clean(x) for k, x in v.items() if not SECRET_KEY.search(k)}
        if isinstance(v, list):
            return [clean(x) for x in v]
        if isinstance(v, float) and not math.isfinite(v):
            return None
        return SECRET_VALUE.sub("[REDACTED_SECRET]", _LOCAL_PATH.sub(last, v)) if isinstance(v, str) else v

    def one(t):
        try:
            return None if t is None else _dump(clean(json.loads(t)))
        except (ValueError, RecursionError):
            return None

    return text.map(one)


def sanitized(text: Column) -> Column:
    """The JSON tree without secret-named keys, with tokens masked wherever a string has them, local paths cut to their last
    part, and numbers that aren't finite as null. Digests stay. Null for null and for what isn't JSON."""
    return F.pandas_udf(_sanitized, "string")(text)
