"""Deterministic ids and fingerprints from built-in functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid5(namespace: str, name: Column) -> Column:
    """Version 5 UUID of a name in a namespace (a UUID)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.lower(F.lpad(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)), 2, "0"))
    part = lambda at, n: F.substring(h, at, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(19, 2), F.lit("-"), part(21, 12))


def canonical_json(**fields: Column) -> Column:
    """JSON of the fields in the order of their names, nulls kept, without white space."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def fingerprint(**fields: Column) -> Column:
    return F.sha2(canonical_json(**fields), 256)


def effective_version(code: str, policy_fingerprint: Column) -> Column:
    """Code version and the first twelve digits of the policy's fingerprint."""
    return F.concat(F.lit(code + "+cfg."), F.substring(policy_fingerprint, 1, 12))
