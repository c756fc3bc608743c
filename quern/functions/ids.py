"""Content-addressed identities: prefix + SHA-256 of canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys and nulls written; decimals should come as canonical text."""
    ordered = [fields[k].alias(k) for k in sorted(fields)]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def canonical_id(prefix: str, fields: dict[str, Column]) -> Column:
    """prefix and the hexadecimal SHA-256 of the fields' canonical JSON."""
    return F.concat(F.lit(prefix), F.sha2(canonical_json(fields), 256))


def positional_id(prefix: str, *values: Column) -> Column:
    """As :func:`canonical_id`, over a JSON array of strings."""
    return F.concat(F.lit(prefix), F.sha2(F.to_json(F.array(*(v.cast("string") for v in values))), 256))


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def table_fingerprint(rows: Column) -> Column:
    """Aggregate: SHA-256 of all rows' JSON, sorted; the rows must be a small table."""
    return F.sha2(F.to_json(F.array_sort(F.collect_list(rows))), 256)
