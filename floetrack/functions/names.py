"""Names, dates and descriptors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: form of the product names (start, end, orbit, data take, unique id).
PRODUCT = r"^S1[AB]_EW_GRDM_1SDH_(\d{8}T\d{6})_(\d{8}T\d{6})_(\d{6})_(\w{6})_(\w{4})"
STAMP = r"\d{8}T\d{6}"


def basename(path: Column) -> Column:
    """The last step of a path."""
    return F.element_at(F.split(path, "/"), -1)


def product(name: Column) -> dict[str, Column]:
    """The five parts of a product name; null where the name has another form."""
    parts = ("start", "end", "orbit_num", "data_take", "unique_id")
    return {p: F.nullif(F.regexp_extract(name, PRODUCT, i + 1), F.lit("")) for i, p in enumerate(parts)}


def stamp(text: Column) -> Column:
    """A time such as 20200101T101112, UTC; null if it is none."""
    return F.try_to_timestamp(F.nullif(text, F.lit("")), F.lit("yyyyMMdd'T'HHmmss"))


def date_in(text: Column) -> Column:
    """The first time found anywhere in a text; null if there is none or it is no time."""
    return stamp(F.regexp_extract(text, STAMP, 0))


def date_of_path(name: Column) -> Column:
    """The day in the fifth part, between underscores, of a name."""
    part = F.get(F.split(name, "_"), F.lit(4))
    return F.to_date(F.try_to_timestamp(F.substring(part, 1, 8), F.lit("yyyyMMdd")))


def by_date(text: Column) -> Column:
    """A sort key: the time in a name, names without one first."""
    return date_in(text).asc_nulls_first()


def joined_descriptors(first: Column, second: Column) -> Column:
    """The descriptors of two bands, one after the other."""
    return F.concat(first, second)


def descriptor_json(descriptor: Column) -> Column:
    """A descriptor's bytes as the text of a list of numbers."""
    text = F.hex(descriptor)
    numbers = F.transform(F.sequence(F.lit(0), F.octet_length(descriptor) - 1), lambda i: F.conv(F.substr(text, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    return F.when(descriptor.isNull(), F.lit(None)).when(F.octet_length(descriptor) == 0, F.lit("[]")).otherwise(F.to_json(numbers))


def descriptor_from_json(text: Column) -> Column:
    """The bytes of a descriptor from the text of its numbers; null if it is no such list."""
    numbers = F.from_json(text, "array<int>")
    return F.unhex(F.array_join(F.transform(numbers, lambda n: F.lpad(F.hex(n.cast("long")), 2, "0")), ""))


def centred(values: Column) -> Column:
    """Values less their mean."""
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v.cast("double"), lambda a: a / F.size(values))
    return F.transform(values, lambda v: v.cast("double") - mean)


def filled(value: Column) -> Column:
    """0 for what is no number."""
    return F.nanvl(value, F.lit(0.0))


def hamming2(a: Column, b: Column, size: int) -> Column:
    """The number of 2-bit cells in which two descriptors of ``size`` bytes (a multiple of 4) differ."""
    total = F.lit(0)
    for at in range(0, size, 4):
        word = lambda d, at=at: F.conv(F.hex(F.substring(d, at + 1, 4)), 16, 10).cast("long")
        x = word(a).bitwiseXOR(word(b))
        total = total + F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(0x55555555)))
    return total


def hamming2_words(a: Column, b: Column) -> Column:
    """The same over descriptors kept as arrays of 32-bit words in longs."""
    cells = F.zip_with(a, b, lambda p, q: p.bitwiseXOR(q))
    return F.aggregate(cells, F.lit(0), lambda n, x: n + F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(0x55555555))))
