"""Partition transforms: each as a Column over rows and as a function of one literal, which must agree.

Literals are in the form bounds are stored in: integers for dates (days) and timestamps
(microseconds), the value itself otherwise. Null gives null.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.errors import ValidationError
from siltstone.sources.schema import bound_kind

DAY, HOUR = 86_400_000_000, 3_600_000_000
INT_MAX = 2_147_483_647
LONG_MIN = -(1 << 63)


def micros(col: Column, kind: T.DataType) -> Column:
    """Microseconds since the epoch; a time without zone is read as UTC."""
    if isinstance(kind, T.TimestampNTZType):
        # The difference to a fixed time without zone doesn't depend on the session's zone.
        zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", zero, col)
    return F.unix_micros(col) if isinstance(kind, T.TimestampType) else col.cast("long")


def stored(col: Column, kind: T.DataType) -> Column:
    """A column's value in the form bounds and partition values are stored in."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return micros(col, kind)
    if isinstance(kind, T.DateType):
        return F.unix_date(col).cast("long")
    return {"long": col.cast("long"), "double": col.cast("double"), "string": col}.get(bound_kind(kind) or "", col)


@dataclass(frozen=True)
class Transform:
    """identity, day, hour, bucket[n] or truncate[w]."""

    name: str
    arg: int | None = None

    def __post_init__(self) -> None:
        if self.name not in ("identity", "day", "hour", "bucket", "truncate"):
            raise ValidationError(f"unknown transform {self.name}")
        if (self.arg is not None) != (self.name in ("bucket", "truncate")) or (self.arg is not None and self.arg <= 0):
            raise ValidationError(f"{self.name} needs a positive number" if self.name in ("bucket", "truncate") else f"{self.name} takes no number")

    def __str__(self) -> str:
        return self.name if self.arg is None else f"{self.name}[{self.arg}]"

    @staticmethod
    def parse(text: str) -> Transform:
        """The transform of a printed form."""
        m = re.fullmatch(r"(\w+)(?:\[(\d+)\])?", text.strip().lower())
        if m is None:
            raise ValidationError(f"not a transform: {text}")
        return Transform(m[1], int(m[2]) if m[2] else None)

    @property
    def suffix(self) -> str:
        """What a partition field's default name has behind the column's name."""
        return {"identity": "", "truncate": "_trunc"}.get(self.name, f"_{self.name}")

    def check(self, kind: T.DataType) -> None:
        """An error if the transform isn't defined for a type."""
        whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        time = isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.LongType))
        ok = {
            "identity": bound_kind(kind) is not None,
            "bucket": whole or isinstance(kind, T.StringType),
            "truncate": whole or isinstance(kind, T.StringType),
            "day": time or isinstance(kind, (T.DateType, T.IntegerType)),
            "hour": time,
        }[self.name]
        if not ok:
            raise ValidationError(f"{self} isn't defined for {kind.simpleString()}")

    def result(self, kind: T.DataType) -> str:
        """How values are stored: long, double or string."""
        return "long" if self.name in ("bucket", "day", "hour") else bound_kind(kind) or "string"

    def column(self, col: Column, kind: T.DataType) -> Column:
        """The transform of a column of a type."""
        self.check(kind)
        if self.name == "identity":
            return stored(col, kind)
        if self.name == "truncate":
            if isinstance(kind, T.StringType):
                return F.substring(col, 1, self.arg)
            value = col.cast("long")
            lower = F.try_subtract(value, F.pmod(value, F.lit(self.arg).cast("long")))
            return F.when(value.isNotNull(), F.coalesce(lower, F.lit(LONG_MIN)))
        if self.name == "bucket":
            return (_java_hash(col, kind).bitwiseAND(F.lit(INT_MAX)) % self.arg).cast("long")
        if isinstance(kind, (T.DateType, T.IntegerType)):  # already days
            return F.unix_date(col).cast("long") if isinstance(kind, T.DateType) else col.cast("long")
        unit = F.lit(DAY if self.name == "day" else HOUR).cast("long")
        at = micros(col, kind)
        # Whole numbers throughout, rounded down: a double can't hold all microseconds.
        return F.call_function("div", at, unit) - F.when(at % unit < 0, F.lit(1)).otherwise(F.lit(0)).cast("long")

    def literal(self, value: int | float | str | None, kind: T.DataType) -> int | float | str | None:
        """The transform of one stored value of a column of a type."""
        self.check(kind)
        if value is None or self.name == "identity":
            return value
        if self.name == "truncate":
            return value[: self.arg] if isinstance(kind, T.StringType) else max(LONG_MIN, value - value % self.arg)
        if self.name == "bucket":
            return (java_hash(value, kind) & INT_MAX) % self.arg
        if isinstance(kind, (T.DateType, T.IntegerType)):
            return value
        return value // (DAY if self.name == "day" else HOUR)


def java_hash(value: int | str, kind: T.DataType) -> int:
    """The 32-bit hash of a value: of integers the value, of longs their halves' xor, of strings the 31-polynomial."""
    if isinstance(kind, T.StringType):
        h = 0
        raw = value.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = (h * 31 + (raw[i] << 8 | raw[i + 1])) & 0xFFFFFFFF
        return h
    if isinstance(kind, T.LongType):
        v = value & 0xFFFFFFFFFFFFFFFF
        return (v ^ v >> 32) & 0xFFFFFFFF
    return value & 0xFFFFFFFF


def _java_hash(col: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        units = F.hex(F.encode(col, "UTF-16BE"))
        n = (F.length(units) / 4).cast("int")
        unit = lambda i: F.conv(F.substring(units, i * 4 + 1, F.lit(4)), 16, 10).cast("long")
        codes = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), unit)).otherwise(F.array().cast("array<bigint>"))
        folded = F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: (a * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF)))
        return F.when(col.isNull(), F.lit(None).cast("long")).otherwise(folded)
    if isinstance(kind, T.LongType):
        return col.bitwiseXOR(F.shiftrightunsigned(col, 32))
    return col.cast("long")
