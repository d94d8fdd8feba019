"""Identities of operations, schemas, claims and entries (F01-F03), stable ids and digests (F07), run ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: HTTP methods of an operation identity.
METHODS = ["GET", "PUT", "POST", "DELETE", "OPTIONS", "HEAD", "PATCH", "TRACE"]


def _required(valid: Column, value: Column, message: str) -> Column:
    return F.when(valid, value).otherwise(F.raise_error(F.lit(message)))


def operation_identity(method: Column, path: Column, strict: bool = True) -> Column:
    """``operation:METHOD:/path``; an unknown method or a path without leading slash raises, or is null if not strict."""
    verb = F.upper(F.trim(method))
    clean = F.trim(path)
    valid = verb.isin(METHODS) & clean.startswith("/")
    value = F.concat(F.lit("operation:"), verb, F.lit(":"), clean)
    return _required(valid, value, "operation needs an HTTP method and a path from /") if strict else F.when(valid, value)


def schema_identity(name: Column) -> Column:
    return _required(F.length(F.trim(name)) > 0, F.concat(F.lit("schema:"), F.trim(name)), "schema needs a name")


def claim_identity(kind: Column, subject: Column, predicate: Column) -> Column:
    parts = [F.trim(x) for x in (kind, subject, predicate)]
    valid = F.lit(True)
    for part in (parts[0], parts[2]):
        valid = valid & (F.length(part) > 0) & ~part.contains(":")
    return _required(valid & (F.length(parts[1]) > 0), F.concat_ws(":", F.lit("claim"), *parts), "claim parts must be there and free of colons")


def endpoint_identity(method: Column, path: Column, summary: Column) -> Column:
    """``METHOD path``; without a path a webhook named by its summary with white space folded; null with neither."""
    folded = F.trim(F.regexp_replace(summary, r"(?U)\s+", " "))
    verb = F.upper(F.trim(method))
    return F.when(path.isNotNull(), F.concat_ws(" ", verb, path)).when(F.length(folded) > 0, F.concat(F.lit("WEBHOOK "), verb, F.lit(" "), folded))


def stable_id(prefix: str, payload: Column, digits: int = 24) -> Column:
    """A prefix and the first digits of the SHA-256 of a canonical payload."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(payload, 256), 1, digits))


def run_id(now: Column) -> Column:
    return F.date_format(now, "yyyyMMdd'T'HHmmss'Z'")
