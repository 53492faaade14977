"""Reading numbers, measures and truth values out of free text, as column expressions (no Python workers)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What stands for "no value".
PLACEHOLDERS = ["", "n/a", "na", "n.a.", "#n/a", "nan", "null", "none", "nil", "*", "$", "-", "--", "---", "unset", "?", "??", "nc", "inconnu", "undefined", "notdefined"]
TRUE_WORDS = ["true", "t", ".t.", "yes", "y", "1", "ja", "j", "oui", "o", "wahr", "vrai", "si", "sí"]
FALSE_WORDS = ["false", "f", ".f.", "no", "n", "0", "nein", "non", "falsch", "faux"]
# Factor to the base unit, by base unit and unit with case, blanks and signs taken away.
UNIT_FACTORS = {
    "m": {"": "1", "m": "1", "mm": "0.001", "cm": "0.01", "dm": "0.1", "km": "1000", "metre": "1", "metres": "1", "meter": "1", "mètre": "1", "mètres": "1"},
    "m2": {"": "1", "m2": "1", "sqm": "1", "qm": "1", "dm2": "0.01", "cm2": "0.0001", "mm2": "0.000001"},
    "m3": {"": "1", "m3": "1", "cbm": "1", "l": "0.001", "dm3": "0.001", "cm3": "0.000001", "ml": "0.000001"},
    "kg": {"": "1", "kg": "1", "g": "0.001", "t": "1000", "mg": "0.000001"},
    "wm2k": {"": "1", "wm2k": "1"},
    "": {"": "1", "°": "1", "deg": "1"},
}

BLANK = r"[\s\u00A0\u202F\u2009]"
GROUP = r"[ '\u00A0\u202F\u2009]"
NUMBER = rf"[+\-]?(?:\d{{1,3}}(?:{GROUP}\d{{3}})+(?!\d)|\d+)?(?:[.,]\d*)*(?:[eE][+\-]?\d{{1,3}})?"
#: The usual notation, which needs no further look.
SIMPLE = r"^-?\d{1,13}(\.\d{1,12})?$"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def bare_text(text: Column) -> Column:
    """Without blanks, a type wrapper such as IFCLABEL(...), and quotes around it. Most texts have none of them, which one look tells."""
    inner = F.regexp_replace(trimmed(text), r"(?is)^IFC[A-Z0-9]*\((.*)\)$", "$1")
    full = trimmed(F.regexp_replace(trimmed(inner), r"""(?s)^'(.*)'$|^"(.*)"$""", "$1$2"))
    return F.when(text.rlike(r"^[A-HJ-Za-z0-9.,+\-]+$"), text).otherwise(full)


def is_placeholder(text: Column) -> Column:
    return text.isNull() | F.lower(trimmed(text)).isin(PLACEHOLDERS)


def unit_key(text: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.lower(text), "²", "2"), "³", "3")
    return F.regexp_replace(t, rf"[/().·*^]|{BLANK}", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: keeps long expressions from being copied into each place that uses them."""
    return F.element_at(F.transform(F.array(value), body), 1)


def number(text: Column) -> Column:
    """Decimal(38,12) of a number in any usual notation, else null: up to 26 digits before the point. With both marks the last is the decimal mark."""

    def plain(t: Column) -> Column:
        dots = F.regexp_replace(t, ",", ".")
        swap = F.translate(F.regexp_replace(t, r"\.", ""), ",", ".")
        return F.when(t.rlike(r"\..*,"), swap).when(t.rlike(r",.*\."), F.regexp_replace(t, ",", "")).otherwise(dots)

    simple = text.rlike(SIMPLE)
    grouped = F.when(text.rlike(rf"^{BLANK}*{NUMBER}{BLANK}*$"), F.regexp_replace(trimmed(text), GROUP, ""))
    cut = let(grouped, lambda t: F.regexp_replace(plain(t), r"\.(?=$|[eE])", ""))
    full = let(cut, lambda t: F.when(t.rlike(r"^[+\-]?(\d+(\.\d+)?|\.\d+)([eE][+\-]?\d+)?$"), t.try_cast("decimal(38,12)")))
    return F.when(simple, text.try_cast("decimal(38,12)")).otherwise(full)


def measure(text: Column, base_unit: Column, places: int = 9) -> Column:
    """Decimal(38,places) in the base unit, rounded half up, else null; a unit that doesn't belong to the base unit makes it unreadable."""
    table = F.create_map(*[F.lit(x) for b, us in UNIT_FACTORS.items() for u, f in us.items() for x in (f"{b}|{u}", f)])
    split = rf"^({NUMBER}){BLANK}*(.*)$"
    kind = f"decimal(38,{places})"

    def factor(key: Column) -> Column:
        own = F.when(F.element_at(F.split(key, r"\|"), 1) == F.element_at(F.split(key, r"\|"), 2), F.lit("1"))
        return F.coalesce(F.try_element_at(table, key), own).cast("decimal(11,6)")

    def product(n: Column, f: Column) -> Column:
        # up to 14 digits before the point the product is exact; beyond that it has six places
        exact = F.round(n.try_cast("decimal(26,12)") * f, places).cast(kind)
        return F.when(F.abs(n) < F.lit("100000000000000").cast("decimal(38,12)"), exact).otherwise(F.round(F.try_multiply(n, f), min(places, 6)).try_cast(kind))

    base = F.coalesce(unit_key(base_unit), F.lit(""))
    full = let(trimmed(text), lambda t: let(F.struct(number(F.regexp_extract(t, split, 1)).alias("n"), let(F.concat(base, F.lit("|"), unit_key(F.regexp_extract(t, split, 2))), factor).alias("f")), lambda x: product(x["n"], x["f"])))
    return F.when(text.rlike(SIMPLE), F.round(text.try_cast("decimal(26,12)"), places).cast(kind)).otherwise(full)


def boolean(text: Column) -> Column:
    t = F.lower(trimmed(text))
    return F.when(t.isin(TRUE_WORDS), F.lit(True)).when(t.isin(FALSE_WORDS), F.lit(False))


def name_key(text: Column) -> Column:
    """Letters and digits only, case aside."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
