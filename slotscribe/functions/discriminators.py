"""The eight leading bytes that tell instruction and account types apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hash namespaces and the length of a discriminator.
NAMESPACE = {"instruction": "global:", "account": "account:"}
DISCRIMINATOR_BYTES = 8


def derived_discriminator(kind: str, name: Column) -> Column:
    """First eight bytes of ``sha256(namespace + name)``; the name is taken as written."""
    digest = F.sha2(F.concat(F.lit(NAMESPACE[kind]), name).cast("binary"), 256)
    return F.unhex(F.substring(digest, 1, 2 * DISCRIMINATOR_BYTES))


def explicit_discriminator(numbers: Column) -> Column:
    """Bytes of an explicit ``ARRAY<STRING>`` of whole numbers, or NULL unless there are eight."""
    whole = F.filter(numbers, lambda n: n.rlike(r"^\d{1,19}$"))
    as_hex = F.transform(whole, lambda n: F.lpad(F.hex(n.cast("bigint") % 256), 2, "0"))
    return F.when(F.size(as_hex) == DISCRIMINATOR_BYTES, F.unhex(F.array_join(as_hex, "")))


def discriminator(kind: str, name: Column, numbers: Column) -> Column:
    """The explicit discriminator when it is well formed, else the derived one."""
    return F.coalesce(explicit_discriminator(numbers), derived_discriminator(kind, name))


def leading_discriminator(data: Column) -> Column:
    """Discriminator of a payload; NULL when the payload is shorter than eight bytes."""
    return F.when(F.octet_length(data) >= DISCRIMINATOR_BYTES, F.substring(data, 1, DISCRIMINATOR_BYTES))


def discriminator_hex(data: Column) -> Column:
    """Lower-case hex of the discriminator, or of the whole payload when it is shorter."""
    return F.lower(F.hex(F.substring(data, 1, DISCRIMINATOR_BYTES)))
