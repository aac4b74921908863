"""Content identities: digests of a canonical form in which field names are sorted and nulls are written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(**fields: Column) -> Column:
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def digest(**fields: Column) -> Column:
    return F.sha2(canonical(**fields), 256)


def short_id(**fields: Column) -> Column:
    return F.substring(digest(**fields), 1, 24)


def prefixed_id(prefix: Column, **fields: Column) -> Column:
    return F.concat_ws("-", prefix, F.substring(digest(**fields), 1, 16))
