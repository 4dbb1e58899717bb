"""Join keys in their native type.

Ids are integral in the operational database. They stay so through scans,
joins and stored facts (8 bytes to hash and compare, predicates that reach the
scan); the reports' text ids are made in the last select, by ``text_ids``. A
table whose ids are text keeps them as text, and a join whose sides differ
compares them as text.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, DecimalType, IntegerType, LongType, ShortType

#: Columns of the logical frames that hold ids.
KEY_COLUMNS = ("id", "order_id", "member_id", "area_id", "product_id", "sn", "cate_id", "dealer_id")


def is_integral(t: DataType) -> bool:
    return isinstance(t, (ByteType, ShortType, IntegerType, LongType)) or (
        isinstance(t, DecimalType) and t.scale == 0 and t.precision <= 18)


def key(df: DataFrame, name: str, alias: str | None = None) -> Column:
    """The id column ``name``: a long if it is integral, else text."""
    kind = "bigint" if is_integral(df.schema[name].dataType) else "string"
    return F.col(name).cast(kind).alias(alias or name)


def text_ids(df: DataFrame) -> DataFrame:
    """``df`` with its ids (also suffixed ones, as ``sn_x``) as text; other columns as they are."""
    ids = {c for c in df.columns if c in KEY_COLUMNS or c.rsplit("_", 1)[0] in KEY_COLUMNS and c[-2:] in ("_x", "_y")}
    found = [f.name for f in df.schema if f.name in ids and f.dataType.simpleString() != "string"]
    return df.withColumns({c: F.col(c).cast("string") for c in found}) if found else df


def _whole_number(text) -> int | None:
    """The number that ``text`` is the plain spelling of."""
    try:
        n = int(str(text))
    except ValueError:
        return None
    return n if str(n) == str(text) and -(1 << 63) <= n < 1 << 63 else None


def key_values(df: DataFrame, name: str, values: Iterable) -> list:
    """Literal ids of a parameter in the type of ``df[name]``; spellings that no number has equal none and go."""
    if not is_integral(df.schema[name].dataType):
        return [str(v) for v in values]
    return [n for n in map(_whole_number, values) if n is not None]


def keys_like(frame: DataFrame, name: str, kind: DataType) -> DataFrame:
    """A text id list in the type of the ids that it is matched with, so that these need no cast.

    Texts that are not the plain spelling of a number match no integral id and go.
    """
    if not is_integral(kind) or is_integral(frame.schema[name].dataType):
        return frame
    number = F.expr(f"try_cast(`{name}` AS bigint)")
    return frame.filter(number.cast("string") == F.col(name)).withColumn(name, number)


def same_type(left: DataFrame, left_on: str, right: DataFrame, right_on: str) -> tuple[Column, Column]:
    """Both key columns, as they are if their types agree and else as text."""
    a, b = left.schema[left_on].dataType, right.schema[right_on].dataType
    if a == b or (is_integral(a) and is_integral(b)):
        return F.col(left_on), F.col(right_on)
    return F.col(left_on).cast("string"), F.col(right_on).cast("string")
