"""Scalar functions: implied prices, losses, windows, ids, signatures and JSON, as column expressions."""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR_SECONDS = 365.25 * 86400
#: Paths of a JSON value that json_paths lists at most (a documented bound of the function itself).
MOST_PATHS = 80


def is_finite(c: Column) -> Column:
    """False for null, NaN and the infinities."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def implied_index(anchor: Column, current: Column, at_anchor: Column, carry: Column | float = 0.0) -> Column:
    """anchor * (current / at_anchor) * exp(carry); null unless all three prices are positive."""
    fine = (anchor > 0) & (current > 0) & (at_anchor > 0)
    return F.when(fine, anchor * (current / at_anchor) * F.exp(carry if isinstance(carry, Column) else F.lit(carry)))


def max_loss_dollars(wing: Column, credit: Column, multiplier: Column | int = 100) -> Column:
    """What a structure of this wing can lose after its credit; null unless 0 <= credit < wing."""
    return F.when((credit >= 0) & (credit < wing), (wing - credit) * multiplier)


def years_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6 / YEAR_SECONDS


def in_entry_window(instant: Column, opens_at: Column, closes_at: Column) -> Column:
    """Whether an entry lies in the session and before its close."""
    return F.coalesce((instant >= opens_at) & (instant < closes_at), F.lit(False))


def backoff_seconds(attempt: Column, base: float, most: float) -> Column:
    """Of the attempt-th try, from 1: base doubled each time, up to most."""
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), attempt - 1), F.lit(float(most)))


def short_id(c: Column, length: int = 24) -> Column:
    return F.substring(F.sha2(c, 256), 1, length)


def canonical_json(*columns: str) -> Column:
    """The columns as JSON with sorted keys; nulls are written."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def content_id(*columns: str, prefix: str = "sha256:") -> Column:
    return F.concat(F.lit(prefix), F.sha2(canonical_json(*columns), 256))


def run_id(*columns: str) -> Column:
    """A run id in the form of a UUID that is the same for the same inputs."""
    h = F.sha2(canonical_json(*columns), 256)
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def hmac_sha256(c: Column, key: bytes) -> Column:
    """hmac-sha256:<hex> of a string, by the construction of RFC 2104 from Spark's SHA-256."""
    if not key:
        raise ValueError("the key must not be empty")
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    block = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in block)) for x in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(c, "UTF-8")), 256))
    return F.concat(F.lit("hmac-sha256:"), F.sha2(F.concat(outer, first), 256))


def signature_holds(c: Column, signature: Column, key: bytes) -> Column:
    """Whether a signature is that of the string; null doesn't hold. The check is of whole digests over each, not of prefixes."""
    return F.coalesce(F.sha2(hmac_sha256(c, key), 256) == F.sha2(signature, 256), F.lit(False))


def verify_signature(content: bytes, signature: str, key: bytes) -> bool:
    """For a single message on the driver, in constant time."""
    return hmac.compare_digest(signature, "hmac-sha256:" + hmac.new(key, content, hashlib.sha256).hexdigest())


def seal(payload: Column, key: Column, context: Column) -> Column:
    """AES-GCM with the context as associated data, in base64; the nonce is chosen by Spark."""
    return F.base64(F.aes_encrypt(payload, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), context))


def unseal(sealed: Column, key: Column, context: Column) -> Column:
    """The payload, or null where the key, the context or the bytes aren't those it was sealed with."""
    return F.try_aes_decrypt(F.unbase64(sealed), key, F.lit("GCM"), F.lit("DEFAULT"), context)


def lookup(c: Column, names: dict[str, str], otherwise: str | None = None) -> Column:
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(otherwise))


def _paths(value: object, most: int) -> list[str]:
    found: set[str] = set()
    stack: list[tuple[object, str]] = [(value, "")]
    while stack and len(found) < most:
        item, at = stack.pop()
        if isinstance(item, dict):
            children = [(child, f"{at}.{key}" if at else str(key)) for key, child in item.items()]
        elif isinstance(item, list) and item:
            children = [(item[0], f"{at}[]")]
        else:
            continue
        for _, path in children:
            if len(found) < most:
                found.add(path)
        stack += reversed(children)
    return sorted(found)


def json_paths(most: int = MOST_PATHS):
    """A function of a JSON string column -> sorted field paths; arrays are looked into by their first element. Strings that
    aren't JSON have none. SQL can't walk a JSON of unknown shape, so values are parsed in Arrow batches."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: _paths(_parsed(x), most))

    return run


def _parsed(text: str | None) -> object:
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def sorted_reasons(*arrays: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*arrays)))


def all_finite(columns: Iterable[str]) -> Column:
    return F.least(*(is_finite(F.col(c).cast("double")) for c in [*columns] * 2))
