"""Column expressions for place names, localised digits, amounts and listing cards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Replacements of a transliteration key, in the order in which they apply.
TRANSLITERATION = [("ou", "u"), ("oo", "u"), ("ee", "i"), ("iy", "i"), ("ey", "ei"), ("gh", "q"), ("kh", "x"), ("w", "v"), ("aa", "a"), ("eh", "e"), ("ah", "a"), ("ie", "i")]
# Endings of place names.
PLACE_SUFFIXES = (" county", "-city", "-new-town", "-industrial-city")
# Words of attribute chips for square metres, rooms, new buildings, years, and in price titles for price.
METRE, ROOM, NEW, YEAR, PRICE = "متر", "اتاق", "نوساز", "سال", "قیمت"
# Digits and unit words, in the order in which a word decides.
LOCAL_DIGITS, DIGITS = "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "01234567890123456789"
UNIT_WORDS = [("میلیارد", 1e9), ("میلیون", 1e6), ("هزار", 1e3)]


def place_key(name: Column) -> Column:
    """Loose key under which spellings of a place name meet; null for null."""
    out = F.regexp_replace(F.lower(name), "[^a-z]", "")
    for old, new in TRANSLITERATION:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.regexp_replace(out, r"(.)\1", "$1")


def bare_place(name: Column) -> Column:
    """A place's name without the words that say what kind of place it is."""
    out = F.lower(name)
    for suffix in PLACE_SUFFIXES:
        out = F.replace(out, F.lit(suffix), F.lit(""))
    return out


def first_integer(text: Column) -> Column:
    """The first run of digits as a number, null where there is none."""
    return F.regexp_extract(text, r"(\d+)", 1).try_cast("long")


def without(text: Column, *affixes: str) -> Column:
    """text without any of the affixes, trimmed."""
    for x in affixes:
        text = F.replace(text, F.lit(x), F.lit(""))
    return F.trim(text)


def chips(items: Column) -> Column:
    """struct<size_m2,rooms,age_years,parking,elevator> of a card's array<struct<title,icon_url_light>>. Of chips
    that say the same the last one counts; no room is 0, new is 0 years; icons have no title and are flags."""
    titled = F.filter(items, lambda c: F.trim(c["title"]) != "")
    digits = lambda c: F.regexp_replace(ascii_digits(c["title"]), "[^0-9]", "").try_cast("double")
    has = lambda c, word: F.contains(c["title"], F.lit(word))
    size = lambda c: has(c, METRE) & digits(c).isNotNull()
    room = lambda c: ~size(c) & has(c, ROOM)
    age = lambda c: ~size(c) & ~has(c, ROOM) & (has(c, NEW) | (has(c, YEAR) & digits(c).isNotNull()))
    last = lambda test, value: F.get(F.reverse(F.transform(F.filter(titled, test), value)), F.lit(0))
    icon = lambda word: F.coalesce(F.exists(items, lambda c: (F.coalesce(F.trim(c["title"]), F.lit("")) == "") & F.contains(F.to_json(c), F.lit(word))), F.lit(False)).cast("int")
    return F.struct(last(size, digits).alias("size_m2"), last(room, lambda c: F.coalesce(digits(c), F.lit(0.0))).alias("rooms"), last(age, lambda c: F.when(has(c, NEW), 0.0).otherwise(digits(c))).alias("age_years"), icon("parking").alias("parking"), icon("elevator").alias("elevator"))


def card_prices(fields: Column, size: Column) -> Column:
    """struct<price,price_m2,text> of a card's price fields: titles with a metre word are prices per square metre,
    titles with the price word or none are totals, the last readable one counts. A missing price per square metre
    is the total by the size."""
    title = lambda f: F.coalesce(F.regexp_replace(f["title"], "^[ :]+|[ :]+$", ""), F.lit(""))
    read = F.filter(F.transform(fields, lambda f: F.struct(title(f).alias("t"), amount(f["value"]).alias("v"))), lambda f: f["v"].isNotNull())
    last = lambda test: F.get(F.reverse(F.filter(read, test)), F.lit(0))["v"]
    per = last(lambda f: F.contains(f["t"], F.lit(METRE)))
    total = last(lambda f: ~F.contains(f["t"], F.lit(METRE)) & (F.contains(f["t"], F.lit(PRICE)) | (f["t"] == "")))
    text = joined_fields(F.transform(fields, lambda f: F.struct(title(f).alias("title"), f["value"].alias("value"))))
    return F.struct(total.alias("price"), F.coalesce(per, F.try_divide(F.nullif(total, F.lit(0.0)), F.nullif(size, F.lit(0.0)))).alias("price_m2"), text.alias("text"))


def ascii_digits(text: Column) -> Column:
    return F.translate(text, LOCAL_DIGITS, DIGITS)


def amount(text: Column, least_bare: float = 1e5) -> Column:
    """Money in text: the first number times the first unit word found; a bare number only above least_bare."""
    t = F.translate(ascii_digits(text), "٫٬,", ".")
    value = F.regexp_extract(t, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    out = F.when(value > least_bare, value)
    for word, times in reversed(UNIT_WORDS):
        out = F.when(F.contains(t, F.lit(word)), value * times).otherwise(out)
    return F.when(value.isNotNull(), out)


def pretty(slug: Column, small: tuple[str, ...] = ("e", "va")) -> Column:
    """A display name from a slug."""
    words = F.split(F.replace(slug, F.lit("-"), F.lit(" ")), " ")
    return F.array_join(F.transform(words, lambda w: F.when(w.isin(*small), w).otherwise(F.initcap(w))), " ")


def joined_fields(fields: Column) -> Column:
    """array<struct<title,value>> as title=value joined by bars."""
    return F.array_join(F.transform(fields, lambda f: F.concat(f["title"], F.lit("="), f["value"])), " | ")
