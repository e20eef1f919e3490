"""Column functions for in-phase/quadrature packets: integer pairs stored as imag, real, imag, …"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Raw positions that never carry signal in the second log format.
NULL_POSITIONS = [
    *range(0, 12), 64, 65, *range(118, 132), *range(246, 268), 382, 383,
]
NULLS_BY_LENGTH = {128: NULL_POSITIONS[:24], 384: NULL_POSITIONS}


def lenient_int(text: Column, default: int = 0) -> Column:
    """Trimmed text as integer, ``default`` when empty or not a number."""
    return F.coalesce(F.trim(text).try_cast("int"), F.lit(default))


# A bracketed list, with or without quotes around it.
_LIST = r'^\s*"?\s*\[([^\]]*)\]\s*"?\s*$'
_EMPTY_LIST = r'^\s*"?\s*\[\s*\]\s*"?\s*$'


def iq_array(text: Column) -> Column:
    """Packet cell as ``array<int>``; NULL when it is not a bracketed list.

    An entry that is no integer becomes a NULL element.
    """
    entries = F.transform(F.split(F.regexp_extract(text, _LIST, 1), ","), lambda v: F.trim(v).try_cast("int"))
    return F.when(text.rlike(_EMPTY_LIST), F.array().cast("array<int>")).when(text.rlike(_LIST), entries)


def cell_length(text: Column) -> Column:
    """Number of entries of a packet cell, counted on the text without parsing it."""
    commas = F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))
    return F.when(text.rlike(_EMPTY_LIST), 0).otherwise(commas + 1)


def _pairs(iq: Column, combine) -> Column:
    count = F.floor(F.size(iq) / 2).cast("int")
    return F.when(count > 0, F.transform(
        F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))),
        lambda k: combine(F.get(iq, k * 2 + 1).cast("double"), F.get(iq, k * 2).cast("double")),
    ))


def iq_complex(iq: Column) -> Column:
    return _pairs(iq, lambda re, im: F.struct(re.alias("re"), im.alias("im")))


def iq_amplitude(iq: Column) -> Column:
    return _pairs(iq, lambda re, im: F.sqrt(re * re + im * im))


def complex_phase(csi: Column) -> Column:
    return F.transform(csi, lambda c: F.atan2(c["im"], c["re"]))


def complex_map(csi: Column) -> Column:
    """Subcarrier index to complex value."""
    return F.map_from_arrays(F.sequence(F.lit(0), F.size(csi) - 1), csi)


def drop_null_positions(iq: Column) -> Column:
    """Remove the fixed silent positions; arrays of another length are left alone."""
    out = iq
    for length, positions in NULLS_BY_LENGTH.items():
        silent = F.array(*[F.lit(p) for p in positions])
        out = F.when(
            F.size(iq) == length, F.filter(iq, lambda v, i: ~F.array_contains(silent, i))
        ).otherwise(out)
    return out


def exploded(df, keep: list[str], array: Column, place: str, value: str):
    """One row per array element.

    The outer form is used on purpose: for the inner form the optimizer adds a filter on the
    array and pushes it below the projections, which would compute the array again inside
    its own lambda for every element.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(place, value))
    return rows.filter(F.col(place).isNotNull())
