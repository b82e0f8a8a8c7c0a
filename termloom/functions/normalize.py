"""Validation, normalisation and denormalisation of typed keys as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- int


def int_key(text: Column) -> Column:
    """The value of a signed 64-bit decimal; null if the text is none. ``+5`` and ``5`` are equal."""
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))


def is_int(text: Column) -> Column:
    return int_key(text).isNotNull()


def zero_fill(text: Column) -> Column:
    """Sign digit (0 negative, 1 else) and the magnitude in 20 digits; null for no integer."""
    digits = F.ltrim(F.regexp_replace(text, "^[+-]", ""), F.lit("0"))
    sign = F.when(text.startswith("-") & (digits != ""), "0").otherwise("1")
    return F.when(is_int(text), F.concat(sign, F.lpad(digits, 20, "0")))


def zero_fill_value(filled: Column) -> Column:
    """Inverse of zero_fill, as text."""
    value = F.concat(F.when(F.substring(filled, 1, 1) == "0", "-").otherwise(""), F.substring(filled, 2, 20))
    return F.when(filled.rlike("^[01][0-9]{20}$"), value.try_cast("bigint").cast("string"))


# ---------------------------------------------------------------- date

_ZONE = r"(Z|[+-](?:0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)?"
_MONTH, _DAY = r"(0[1-9]|1[0-2])", r"(0[1-9]|[12][0-9]|3[01])"
#: Shape of the text -> (pattern, group numbers of year, month, day, time, zone); fixed by XML Schema.
DATE_SHAPES = {
    "dateTime": (rf"^(-?[0-9]{{4,}})-{_MONTH}-{_DAY}T((?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]+)?){_ZONE}$", (1, 2, 3, 4, 5)),
    "date": (rf"^(-?[0-9]{{4,}})-{_MONTH}-{_DAY}{_ZONE}$", (1, 2, 3, None, 4)),
    "gYearMonth": (rf"^(-?[0-9]{{4,}})-{_MONTH}{_ZONE}$", (1, 2, None, None, 3)),
    "gYear": (rf"^(-?[0-9]{{4,}}){_ZONE}$", (1, None, None, None, 2)),
    "gMonthDay": (rf"^--{_MONTH}-{_DAY}{_ZONE}$", (None, 1, 2, None, 3)),
    "gMonth": (rf"^--{_MONTH}{_ZONE}$", (None, 1, None, None, 2)),
    "gDay": (rf"^---{_DAY}{_ZONE}$", (None, None, 1, None, 2)),
}


def date_shape(text: Column) -> Column:
    """Name of the first shape the text has, or null."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(name)) for name, (p, _) in DATE_SHAPES.items()])


def is_any_date(text: Column) -> Column:
    return F.coalesce(date_shape(text).isNotNull(), F.lit(False))


def date_key(text: Column) -> Column:
    """The instant, in UTC, as a timestamp without zone; missing parts are 1 (the year 1, too), a day beyond its month
    is its last. Null for any other text."""
    one_form = []
    for pattern, groups in DATE_SHAPES.values():
        defaults = ("1", "1", "1", "00:00:00", "")
        one_form.append(F.when(text.rlike(pattern), F.regexp_replace(text, pattern, "|".join(f"${g}" if g else d for g, d in zip(groups, defaults)))))

    def instant(parts: Column) -> Column:
        first = F.make_date(parts[0].try_cast("int"), parts[1].try_cast("int"), F.lit(1))
        on = F.least(F.date_add(first, parts[2].try_cast("int") - 1), F.last_day(first))
        local = F.concat(F.date_format(on, "yyyy-MM-dd "), parts[3]).try_cast("timestamp_ntz")
        minutes = F.substring(parts[4], 2, 2).try_cast("int") * 60 + F.substring(parts[4], 5, 2).try_cast("int")
        shift = F.when(parts[4].startswith("+"), minutes).when(parts[4].startswith("-"), -minutes).otherwise(0)
        return local - F.make_dt_interval(F.lit(0), F.lit(0), shift)

    # The lambda binds the parts once, so the generated code stays small wherever a filter copies the expression.
    return F.transform(F.array(F.split(F.coalesce(*one_form), r"\|")), instant)[0]


def date_normal(text: Column) -> Column:
    """``yyyyMMddHHmmss`` in UTC."""
    return F.date_format(date_key(text), "yyyyMMddHHmmss")


def date_denormal(normal: Column) -> Column:
    """``yyyyMMddHHmmss`` as ``yyyy-MM-dd HH:mm:ss``."""
    return F.regexp_replace(normal, r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2}).*$", "$1-$2-$3 $4:$5:$6")


#: Printers of the parts of a date.
DATE_PRINTERS: dict[str, str] = {
    "gYearMonth": "yyyy-MM",
    "gYear": "yyyy",
    "gMonthDay": "'--'MM-dd",
    "gMonth": "'--'MM",
    "gDay": "'---'dd",
    "date": "yyyy-MM-dd",
    "time": "HH:mm:ss",
    "dateTime": "yyyy-MM-dd'T'HH:mm:ss",
}


def show_date_part(ts: Column, shape: str) -> Column:
    return F.date_format(ts, DATE_PRINTERS[shape])


def show_time_zone(minutes: Column) -> Column:
    """Offset in minutes as ``Z`` or ``+hh:mm``."""
    sign = F.when(minutes < 0, "-").otherwise("+")
    size = F.abs(minutes)
    return F.when(minutes == 0, "Z").otherwise(F.format_string("%s%02d:%02d", sign, F.floor(size / 60).cast("int"), (size % 60).cast("int")))


# ---------------------------------------------------------------- position

_POSITION = r"^(-?[0-9]+(?:\.[0-9]*)?)-(-?[0-9]+(?:\.[0-9]*)?)$"


def latitude(text: Column) -> Column:
    return _coordinate(text, 1, 90.0)


def longitude(text: Column) -> Column:
    return _coordinate(text, 2, 180.0)


def _coordinate(text: Column, group: int, bound: float) -> Column:
    value = F.when(text.rlike(_POSITION), F.regexp_extract(text, _POSITION, group).try_cast("double"))
    return F.when(F.abs(value) < bound, F.round(value, 7))


def is_position(text: Column) -> Column:
    return F.coalesce(latitude(text).isNotNull() & longitude(text).isNotNull(), F.lit(False))


def _bits(value: Column) -> Column:
    whole = F.round(F.abs(value) * 1e7).cast("bigint")
    return F.concat(F.when(value < 0, "0").otherwise("1"), F.lpad(F.bin(whole), 31, "0"))


def z_order(lat: Column, lon: Column) -> Column:
    """64 interleaved bits: sign and 31-bit magnitude of both coordinates in units of 1e-7 degrees."""
    pairs = F.zip_with(F.split(_bits(lat), ""), F.split(_bits(lon), ""), lambda a, b: F.concat(a, b))
    return F.array_join(pairs, "")


def position_normal(text: Column) -> Column:
    return F.when(is_position(text), z_order(latitude(text), longitude(text)))


def position_denormal(normal: Column) -> Column:
    """64 interleaved bits as ``lat-lon`` with 7 decimals."""
    bits = F.split(normal, "")

    def value(offset: int) -> Column:
        own = F.array_join(F.filter(bits, lambda _, i: i % 2 == offset), "")
        size = F.conv(F.substring(own, 2, 31), 2, 10).cast("double") / 1e7
        return F.when(F.substring(own, 1, 1) == "0", -size).otherwise(size)

    return F.when(normal.isNotNull(), F.format_string("%.7f-%.7f", value(0), value(1)))


# ---------------------------------------------------------------- chains

NORMALIZERS: dict[str, Callable[[Column], Column]] = {"UpperCase": F.upper, "LowerCase": F.lower, "ZeroFill": zero_fill}


_ON_DRIVER: dict[str, Callable[[str], str]] = {}


def register_normalizer(name: str, function: Callable[[Column], Column], on_driver: Callable[[str], str] | None = None) -> None:
    """``on_driver`` does the same to one query word; without it the words of a query go through ``function``, each in a
    job of its own."""
    NORMALIZERS[name] = function
    _ON_DRIVER.pop(name, None)
    if on_driver is not None:
        _ON_DRIVER[name] = on_driver


def normalised_word(name: str, word: str) -> str:
    """A query word through a registered normalizer."""
    if name in _ON_DRIVER:
        return _ON_DRIVER[name](word)
    from pyspark.sql import SparkSession

    return SparkSession.active().range(1).select(NORMALIZERS[name](F.lit(word)).alias("w")).first()["w"]


def normalise(text: Column, names: list[str]) -> Column:
    """The named normalizers from left to right."""
    for name in names:
        text = NORMALIZERS[name](text)
    return text
