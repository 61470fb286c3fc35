"""Text forms, numbers and transforms with the coercions of dynamically typed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

#: White space that trimming removes: the ASCII controls, space, no-break and other Unicode spaces, byte order mark.
SPACE = r"[\u0009-\u000D\u0020\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def family(kind: str) -> str:
    """The type family of a Spark type name: values of different families are never equal."""
    if kind.startswith(NUMBERS):
        return "number"
    return {"string": "string", "boolean": "boolean", "timestamp": "time", "timestamp_ntz": "time", "date": "time"}.get(kind, kind)


def named(name: str) -> Column:
    """The column of just this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames uses, whatever its case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def moment(c: Column, kind: str) -> Column:
    """Microseconds since 1970: numbers are milliseconds, text that is no time is null."""
    if family(kind) == "number":
        return (c.cast("decimal(38,3)") * 1000).cast("bigint")
    return F.unix_micros(c.cast("timestamp") if family(kind) == "time" else F.try_to_timestamp(c.cast("string")))


def as_text(c: Column, kind: str = "string") -> Column:
    """The text form: whole numbers without a fraction, decimals exact without ending zeros, powers of ten from 1e21 on and below 1e-6 only; all else as Spark casts it."""
    if kind.startswith("decimal"):
        return F.when(c == 0, "0").otherwise(F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", ""))
    if kind.startswith(("float", "double")):
        d = c.cast("double")
        size, plain = F.abs(d), d.cast("string")
        whole = F.when(size < 1e15, d.cast("bigint").cast("string")).otherwise(d.try_cast("decimal(38,0)").cast("string"))
        digits = F.regexp_replace(plain.try_cast("decimal(38,20)").cast("string"), r"\.?0+$", "")
        short = F.regexp_replace(F.regexp_replace(plain, r"\.0E|E", "e"), r"e([0-9])", "e+$1")  # 1e+21, 1e-7
        return F.when((d == F.rint(d)) & (size < 1e21), whole).when(~plain.contains("E"), plain).when((size >= 1e-6) & (size < 1e21), digits).otherwise(short)
    return c.cast("string")


def as_number(c: Column) -> Column:
    """Empty text is 0, other text that is no number is null."""
    t = trim(c.cast("string"))
    return F.when(t == "", F.lit(0.0)).otherwise(t.try_cast("double"))


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column) -> Column:
    return trim(F.regexp_replace(c, f"{SPACE}+", " "))


#: Transforms by name, applied to the source side of a comparison.
TRANSFORMS = {
    "lowercase": F.lower, "uppercase": F.upper, "trim": trim, "normalizeWhitespace": collapse,
    "parseDate": lambda c: F.try_to_timestamp(c), "parseNumber": as_number, "toString": lambda c: c.cast("string"),
}


def money(c: Column, locale: str | None = None) -> Column:
    """An amount from text. Without a locale the lenient reading: all dots but the last go, the first
    comma becomes a dot, the longest numeric prefix counts. `de` and `en` read separators as written there."""
    t = F.regexp_replace(c.cast("string"), r"[^0-9.,+-]", "")
    if locale:
        group, point = (".", ",") if locale == "de" else (",", ".")
        t = F.regexp_replace(F.replace(t, F.lit(group), F.lit("")), f"[{point}]", ".")
    else:
        t = F.regexp_replace(F.regexp_replace(t, r"\.(?=.*\.)", ""), r"^([^,]*),", "$1.")
    return F.regexp_extract(t, r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)", 0).try_cast("double")


#: The names, whatever their case, whose values are secrets.
SECRET_NAMES = ("password", "pass", "token", "accesstoken", "apikey", "secret", "connectionstring", "uri", "authorization")
HIDDEN = "[REDACTED]"
#: The patterns of bearer tokens and of passwords in URLs.
BEARER, URL_PASSWORD = r"\bBearer\s+[A-Za-z0-9._-]{8,}\b", r"(?i)([a-z][a-z0-9+.-]*://[^:\s/]+):[^@\s/]+@"


def redact(c: Column) -> Column:
    """Text without bearer tokens of eight characters or more, and without passwords in URLs; user names stay."""
    return F.regexp_replace(F.regexp_replace(c, BEARER, f"Bearer {HIDDEN}"), URL_PASSWORD, f"$1:{HIDDEN}@")


def redact_value(c: Column, kind: DataType) -> Column:
    """The same at every depth of arrays, structs and maps; values of secret names are hidden whole."""
    if isinstance(kind, StringType):
        return redact(c)
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: redact_value(x, kind.elementType))
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*(redact_field(c[f.name], f.name, f.dataType).alias(f.name) for f in kind)))
    if isinstance(kind, MapType) and isinstance(kind.keyType, StringType) and isinstance(kind.valueType, StringType):
        return F.transform_values(c, lambda k, v: F.when(F.lower(k).isin(*SECRET_NAMES), HIDDEN).otherwise(redact(v)))
    return c


def redact_field(c: Column, name: str, kind: DataType) -> Column:
    return F.lit(HIDDEN) if name.lower() in SECRET_NAMES else redact_value(c, kind)


def redacted(df: DataFrame) -> DataFrame:
    """Records without secrets."""
    return df.select(*(redact_field(named(f.name), f.name, f.dataType).alias(f.name) for f in df.schema))


def rounded(c: Column, digits: int = 2) -> Column:
    """Half up at a number of digits, by floor, so that other engines agree."""
    return F.floor(c * 10**digits + 0.5) / 10**digits


def qualified(alias: str, name: str) -> Column:
    """The column of just this name of an aliased frame."""
    return F.col(f"{alias}.`" + name.replace("`", "``") + "`")


def comparable(c: Column, kind: str) -> Column:
    """Maps cannot be compared; their entries, sorted by key, as JSON can."""
    return F.to_json(F.array_sort(F.map_entries(c))) if kind.startswith("map") else c
