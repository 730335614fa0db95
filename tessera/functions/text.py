"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_length(c: Column | str) -> Column:
    """Length in bytes; null counts as 0."""
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")


def preview(c: Column | str, width: int = 100) -> Column:
    """The first ``width`` characters, with dots if more follow."""
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit("..."))).otherwise(F.col(c) if isinstance(c, str) else c)


def token_count(c: Column | str) -> Column:
    """Words between single spaces, as a split at spaces gives them; 0 for null and empty texts."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.coalesce(c, F.lit("")) == "", 0).otherwise(F.size(F.split(c, " "))).cast("long")


def device_key(c: Column | str) -> Column:
    """The physical device behind a backend's name for it: what follows the first ": ", up to "/" or "(", trimmed, in lower case."""
    c = F.col(c) if isinstance(c, str) else c
    after = F.when(F.instr(c, ": ") > 0, F.expr("1")).otherwise(F.lit(0))
    body = F.when(after == 1, F.substring(c, F.instr(c, ": ") + 2, F.length(c))).otherwise(c)
    return F.lower(F.trim(F.regexp_replace(body, r"(?s)[/(].*$", "")))


def name_holds(c: Column | str, part: str) -> Column:
    """Whether a name contains ``part``, letter case aside."""
    return F.contains(F.lower(c), F.lit(part.lower()))


def char_token(c: Column | str) -> Column:
    """a to z as 1 to 26, a line end (or nothing) as 0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isin("", "\n"), 0).otherwise(F.ascii(c) - 96).cast("int")


def token_char(t: Column | str) -> Column:
    """The reverse of char_token, with 0 as a dot."""
    t = F.col(t) if isinstance(t, str) else t
    return F.when(t == 0, ".").otherwise(F.char(t + 96))


def padded_vocab(v: Column | int, world: int) -> Column:
    """A vocabulary size filled up for ``world`` ranks; one that divides already gets a full row more."""
    v = F.lit(v) if isinstance(v, int) else v
    return v + (world - v % world)
