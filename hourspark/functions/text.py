"""Identifiers, keys, flags and tokens as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourspark.functions.timestamps import epoch_micros, iso_text

# Texts read as booleans, and texts read as a missing identifier.
TRUE_TEXTS = ["true", "1", "yes", "y", "t"]
FALSE_TEXTS = ["false", "0", "no", "n", "f"]
MISSING_ID_TEXTS = ["nan", "none", "<na>"]

# Month names of the oldest publisher format.
MONTH_NAMES = [
    "January", "February", "March", "April", "May", "June", "July",
    "August", "September", "October", "November", "December",
]

# Fixed value: the "lat, lon" text form.
POINT_TEXT = r"^\s*([+-]?(?:\d+(?:\.\d*)?|\.\d+))\s*,\s*([+-]?(?:\d+(?:\.\d*)?|\.\d+))\s*$"


def canonical_id(col: Column) -> Column:
    """Identifier text: trimmed, ``44864.0`` as ``44864``, blanks and missing markers as null."""
    text = F.trim(col.cast("string"))
    clean = F.regexp_replace(text, r"^([+-]?\d+)\.0+$", "$1")
    return F.when((text != "") & ~F.lower(text).isin(MISSING_ID_TEXTS), clean)


def bool_text(col: Column) -> Column:
    """Boolean of a text; null for null and for a text outside both lists."""
    text = F.lower(F.trim(col.cast("string")))
    return F.when(text.isin(TRUE_TEXTS), F.lit(True)).when(text.isin(FALSE_TEXTS), F.lit(False))


def bool_text_fault(col: Column) -> Column:
    """True for a text that is neither a known true nor a known false."""
    return col.isNotNull() & bool_text(col).isNull()


def month_number(name: Column) -> Column:
    """1-12 for an English month name, null for anything else."""
    wanted = F.array_position(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.trim(name)).cast("int")
    return F.when(wanted > 0, wanted)


def date_from_parts(year: Column, month_name: Column, day: Column) -> Column:
    """Date from year, month name and day; an unknown month fails the job."""
    month = F.coalesce(
        month_number(month_name),
        F.raise_error(F.concat(F.lit("unknown month name: "), month_name)).cast("int"),
    )
    return F.make_date(year.cast("int"), month, day.cast("int"))


def hour_key(unit: Column, day: Column, hour: Column) -> Column:
    """``unit:YYYYMMDD:HH``."""
    return F.concat_ws(
        ":", unit.cast("string"), F.regexp_replace(day.cast("string"), "-", ""), F.lpad(hour.cast("string"), 2, "0")
    )


def prefixed_key(source: Column, unit: Column, instant: Column) -> Column:
    """Collision-free key ``v1:<len>:<source>:<len>:<unit>:<epoch micros>``."""
    source, unit = source.cast("string"), unit.cast("string")
    return F.concat(
        F.lit("v1:"), F.length(source).cast("string"), F.lit(":"), source,
        F.lit(":"), F.length(unit).cast("string"), F.lit(":"), unit,
        F.lit(":"), epoch_micros(instant).cast("string"),
    )


def with_observation_key(df: DataFrame, source: str, unit: str, instant: str, key: str = "observation_key") -> DataFrame:
    """Keep an existing key only if it is complete and unique, otherwise derive it."""
    derived = prefixed_key(F.col(source), F.col(unit), F.col(instant))
    if key in df.columns:
        text = F.col(key).cast("string")
        facts = df.agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(text.isNull() | (F.trim(text) == "")).alias("bad"),
            F.count_distinct(text).alias("keys"),
        ).first()
        if facts.rows > 0 and facts.bad == 0 and facts.keys == facts.rows:
            return df.withColumn(key, text)
    return df.withColumn(key, derived)


def text_point(col: Column) -> Column:
    """Struct(lat, lon) of a ``"lat, lon"`` text; both null when it does not match."""
    return F.struct(
        F.nullif(F.regexp_extract(col, POINT_TEXT, 1), F.lit("")).try_cast("double").alias("lat"),
        F.nullif(F.regexp_extract(col, POINT_TEXT, 2), F.lit("")).try_cast("double").alias("lon"),
    )


def flag_string(flags: dict[str, Column]) -> Column:
    """Names of the true flags, sorted, joined by ``;``; a null flag counts as false."""
    present = [F.when(F.coalesce(flag, F.lit(False)), F.lit(name)) for name, flag in sorted(flags.items())]
    return F.concat_ws(";", *present)


def typed_token(df: DataFrame, name: str) -> Column:
    """Stable text of a scalar with its type in front, as in ``int:5`` or ``str:a``."""
    kind, col = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.BooleanType):
        body = F.concat(F.lit("bool:"), F.when(col, "True").otherwise("False"))
    elif isinstance(kind, T.IntegralType):
        body = F.concat(F.lit("int:"), col.cast("string"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        body = F.concat(F.lit("float:"), col.cast("double").cast("string"))
    elif isinstance(kind, T.DateType):
        body = F.concat(F.lit("date:"), col.cast("string"))
    elif isinstance(kind, T.TimestampNTZType):
        body = F.concat(F.lit("Timestamp:"), iso_text(col))
    else:
        body = F.concat(F.lit("str:"), col.cast("string"))
    missing = col.isNull()
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        missing = missing | F.isnan(col)
    return F.when(missing, F.lit("<MISSING>")).otherwise(body)


def group_id(source: Column, scope: Column) -> Column:
    """``source|scope`` in trimmed lower case."""
    return F.concat_ws("|", F.lower(F.trim(source)), F.lower(F.trim(scope)))


def display_name(raw: Column) -> Column:
    """First non-null of the display, full and plain name in a JSON document."""
    return F.coalesce(
        F.get_json_object(raw, "$.display_name"),
        F.get_json_object(raw, "$.full_name"),
        F.get_json_object(raw, "$.name"),
    )


def join_distinct(parts: list[Column], sep: str = ", ", default: str | None = None) -> Column:
    """Distinct non-empty parts in their order, joined; ``default`` when none is left."""
    kept = F.array_distinct(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")))
    text = F.array_join(kept, sep)
    return text if default is None else F.when(text != "", text).otherwise(F.lit(default))
