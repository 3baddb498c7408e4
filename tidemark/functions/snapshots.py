"""Canonical JSON: one text for one content, with keys sorted at every depth, and the ids that are made of it.

Fixed by the records that carry such ids: no blanks, no escaping beyond JSON's, numbers as Python writes them, instants and dates
in ISO form (instants in UTC), decimals as plain digits in a string; what isn't finite is refused.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections.abc import Callable
from decimal import Decimal
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _plain(kind: pa.DataType) -> Callable[[Any], Any]:
    """What turns values of an Arrow type into what JSON holds."""
    if pa.types.is_struct(kind):
        fields = [(f.name, _plain(f.type)) for f in kind]
        return lambda v: None if v is None else {name: own(v[name]) for name, own in fields}
    if pa.types.is_map(kind):
        key, item = _plain(kind.key_type), _plain(kind.item_type)
        return lambda v: None if v is None else {str(key(k)): item(x) for k, x in v}
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        own = _plain(kind.value_type)
        return lambda v: None if v is None else [own(x) for x in v]
    if pa.types.is_timestamp(kind):
        return lambda v: None if v is None else (v.astimezone(dt.timezone.utc) if v.tzinfo else v.replace(tzinfo=dt.timezone.utc)).isoformat()
    if pa.types.is_date(kind):
        return lambda v: None if v is None else v.isoformat()
    if pa.types.is_decimal(kind):
        return lambda v: None if v is None else format(Decimal(v), "f")
    return lambda v: v


def dumps(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, allow_nan=False, sort_keys=True, separators=(",", ":"))


@F.arrow_udf(StringType())
def _canonical(values: pa.Array) -> pa.Array:
    own = _plain(values.type)
    return pa.array([dumps(own(v)) for v in values.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def _recast(texts: pa.Array) -> pa.Array:
    def again(text: str | None) -> str | None:
        try:
            return None if text is None else dumps(json.loads(text))
        except ValueError:
            return None

    return pa.array([again(t) for t in texts.to_pylist()], pa.string())


def canonical(*columns: str | Column) -> Column:
    """The columns, by their names, as one canonical JSON object. Arrow batches: no built-in function sorts keys at every depth. A NaN or an
    infinity fails the job."""
    return _canonical(F.struct(*columns))


def canonical_text(text: Column) -> Column:
    """A JSON text in canonical form; null for what isn't JSON."""
    return _recast(text)


def digest(canonical_json: Column) -> Column:
    """sha256:<hex> of a canonical text."""
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json, 256))


def snapshot_id(*columns: str | Column) -> Column:
    return digest(canonical(*columns))


def of(value: dict[str, Any]) -> str:
    """The id of one content on the driver."""
    return "sha256:" + hashlib.sha256(dumps(value).encode()).hexdigest()
