"""Fingerprints and deterministic ids."""

from __future__ import annotations

from uuid import UUID

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintel.functions import text as X


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON with sorted keys and explicit nulls. Only strings and whole numbers, whose spelling is the same everywhere."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in sorted(fields.items())]), {"ignoreNullFields": "false"})


def fingerprint(fields: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(fields), 256)


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based id of version 5, in the JVM."""
    h = F.sha1(F.concat(F.unhex(F.lit(UUID(namespace).hex)), F.encode(name, "utf-8")))
    nibble = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1)
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(nibble, F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat_ws("-", *parts)


def semantic_fingerprint(code: Column, number: Column, title: Column, content: Column, warnings: Column) -> Column:
    """What a candidate says, whatever its rank, score, version, spacing, width or case."""
    return fingerprint({"kcs_code": X.folded_key(code), "kcs_clause": X.folded(number), "title": X.folded(title), "content": X.folded(content), "warnings": X.folded_each(warnings)})
