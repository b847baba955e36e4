"""Hash identities (HSH-*)."""

from __future__ import annotations

import hmac
import os
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Environment variable that holds the privacy key; a literal would show in plans.
KEY_VARIABLE = "TARNWICK_PRIVACY_KEY"


def uid(*values: Column) -> Column:
    """HSH-01: SHA-256 of the values joined by the unit separator; null counts as empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(v.cast("string"), F.lit("")) for v in values]), 256)


def digest(**fields: Column) -> Column:
    """HSH-02: SHA-256 of a JSON object with sorted keys."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def record_uid(prefix: str, provider: Column, tenant: Column, external_id: Column, url: Column, *rest: Column) -> Column:
    """HSH-03: provider identity, else URL, else content."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    by_id = F.when(blank(external_id) != "", F.concat_ws("|", blank(provider), blank(tenant), external_id))
    identity = F.coalesce(by_id, F.when(blank(url) != "", url), F.concat_ws("|", *map(blank, rest)))
    return F.concat(F.lit(prefix), F.substring(F.sha2(identity, 256), 1, 24))


def _phone(value: str) -> str:
    digits = value.translate({ord(c): None for c in " ()-"})
    if not re.fullmatch(r"\+[1-9]\d{7,14}", digits):
        raise ValueError("PHONE_REQUIRES_E164")
    return digits


#: How a kind of value is written before it is hashed; other kinds stay as they are.
_WRITTEN = dict.fromkeys(("email", "recipient", "suppression"), str.lower) | {"phone": _phone}


def token(key: bytes, kind: str, value: str, namespace: str = "tarnwick", version: str = "v1") -> str:
    """HSH-04 on one value: keyed, domain-separated; errors are ValueErrors with a code."""
    refused = {"PRIVACY_KEY_TOO_SHORT": len(key) < 32, "INVALID_TOKEN_NAMESPACE": not (re.fullmatch("[a-z0-9_-]+", kind) and re.fullmatch("[A-Za-z0-9_-]+", version))}
    for code in filter(refused.get, refused):
        raise ValueError(code)
    domain = ":".join((namespace, version, kind, _WRITTEN.get(kind, str)(value.strip())))
    return hmac.digest(key, domain.encode(), "sha256").hex()


def private_token(kind: str, x: Column) -> Column:
    """HSH-04 over a column; the executors read the key from their environment."""

    @F.pandas_udf("string")
    def apply(values: pd.Series) -> pd.Series:
        key = os.environ[KEY_VARIABLE].encode()
        return values.map(lambda v: None if v is None else token(key, kind, v))

    return apply(x)
