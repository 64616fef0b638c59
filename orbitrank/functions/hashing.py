"""The one place digests and hashed orders are spelled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed_order(*parts: Column | str | int) -> Column:
    """Hex SHA-256 of the colon-joined parts; hex order equals byte order."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.sha2(F.concat_ws(":", *columns), 256)


def content_sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def content_md5(content: Column) -> Column:
    return F.md5(content)


def is_sha256(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))
