"""Identification tags: normalising, an ordered grammar of rules, and their fields, all as columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letter tables, vocabulary and patterns of the tag grammar.
VARIABLE_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MODIFIER_LETTERS = "DFJKMQSXYZ"
SAFETY_DEVICES = ("FSV", "PSE", "PSV", "TSE", "TSV")
EQUIPMENT_CLASSES = ("AC", "C", "E", "F", "P", "T", "V")
USERS_CHOICE = ("M",)
TRAIN = "[A-HJ-NPR-Z]"
LINE_NUMBER = r'^(\d{1,3}(?:[- ]\d{1,2}/\d{1,2})?|\d{1,2}/\d{1,2})\s*"\s*-\s*([A-Z0-9][A-Z0-9-]*)$'
EQUIPMENT = rf"^([A-Z]{{1,3}})-(\d{{2,4}})\s*({TRAIN}(?:\s*/\s*{TRAIN})*)?$"
VALVE = rf"^([A-Z]{{2,4}})-(\d{{2,4}})-(\d{{1,3}})({TRAIN}{{0,2}})$"
INSTRUMENT = rf"^([A-Z]{{1,6}})-(\d{{2,4}})(?:-(\d{{1,3}}))?({TRAIN}{{0,2}})$"
CONNECTOR = r"^\[?(\d{3,4}[A-Z]{0,2}|[A-Z]\d{2}[A-Z])\]?$"
LINE_FIELDS = ("service", "sequence", "spec", "extra1", "extra2")
QUOTES = "″”’"
DASHES = "‐‑‒–—"


def normalise(raw: Column) -> Column:
    """Trimmed, upper case, one kind of quote and dash, no spaces around dashes, single spaces."""
    t = F.upper(F.regexp_replace(raw, r"(?U)^\s+|\s+$", ""))
    t = F.translate(t, QUOTES + DASHES, '"' * len(QUOTES) + "-" * len(DASHES))
    return F.regexp_replace(F.regexp_replace(t, r"(?U)\s*-\s*", "-"), r"(?U)\s+", " ")


def _group(text: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(text, pattern, n)


def _or_null(c: Column) -> Column:
    return F.when(c != "", c)


def parse(raw: Column, equipment: tuple[str, ...] = EQUIPMENT_CLASSES) -> Column:
    """A struct of kind, conformance, canonical, prefix, sequence, suffix, variable, modifier, loop_id, is_safety, is_sis.

    Rules in order: line number, off-page connector (a bare number only in brackets), equipment of a known
    class, then valve or instrument. Null and blank texts are unknown and unparsed.
    """
    t = F.coalesce(normalise(raw), F.lit(""))
    # Bound once: everything below reads the normalised text and its matches by name.
    found = F.transform(F.array(t), lambda t: F.struct(t.alias("t"), *(F.regexp_extract(t, p, n).alias(f"{k}{n}") for k, p, m in _MATCHES for n in range(m + 1))))
    return F.get(F.transform(found, lambda m: _judge(m, equipment)), F.lit(0))


#: name, pattern, groups of what parse() looks at; group 0 is empty where the pattern does not match.
_MATCHES = (("line", LINE_NUMBER, 0), ("con", CONNECTOR, 1), ("eq", EQUIPMENT, 3), ("val", VALVE, 4), ("ins", INSTRUMENT, 4))


def _judge(m: Column, equipment: tuple[str, ...]) -> Column:
    none = F.lit(None).cast("string")
    t = m["t"]
    is_line, con, eq = m["line0"] != "", m["con0"] != "", m["eq0"] != ""
    eq_class = m["eq1"]
    bracket = t.startswith("[")
    ref = m["con1"]
    is_connector = con & (bracket | ~eq)
    bare = is_connector & ref.rlike(r"^\d+$") & ~bracket
    is_equipment = eq & eq_class.isin(*equipment)
    is_valve = m["val0"] != ""
    shaped = is_valve | (m["ins0"] != "")
    fn, unit, seq, sfx = (F.when(is_valve, m[f"val{n}"]).otherwise(m[f"ins{n}"]) for n in (1, 2, 3, 4))
    variant = fn.rlike(r"^D[FPTLW][A-Z]*$")
    letters = F.when(variant, F.regexp_replace(fn, r"^D([FPTLW])", "$1D")).otherwise(fn)
    first, second, length = F.substring(letters, 1, 1), F.substring(letters, 2, 1), F.length(letters)
    safety = letters.isin(*SAFETY_DEVICES)
    modifies = (length > 1) & second.isin(*MODIFIER_LETTERS) & ((length > 2) | (second == "D")) & ((second != "S") | safety)
    modifier = F.when(modifies, second)
    number = F.when(seq != "", F.concat(unit, F.lit("-"), seq)).otherwise(unit)
    valve = fn.startswith("MV") | (F.substring(fn, 1, 1).isin(*USERS_CHOICE) & fn.endswith("V"))
    train = F.replace(m["eq3"], F.lit(" "), F.lit(""))
    loop = F.when(~valve, F.concat(first, F.coalesce(modifier, F.lit("")), F.lit("-"), number))

    def row(kind, conformance, canonical=none, prefix=none, sequence=none, suffix=none, variable=none, mod=none, loop_id=none, is_safety=F.lit(False), is_sis=F.lit(False)):
        values = {"kind": kind, "conformance": conformance, "canonical": canonical, "prefix": prefix, "sequence": sequence, "suffix": suffix, "variable": variable, "modifier": mod, "loop_id": loop_id, "is_safety": is_safety, "is_sis": is_sis}
        return F.struct(*(v.alias(k) for k, v in values.items()))

    unknown = row(F.lit("unknown"), F.lit("unparsed"))
    kind = F.when(valve, "valve").otherwise("instrument")
    verdict = F.when(~first.isin(*VARIABLE_LETTERS), "grammar_valid").when(variant, "nonconformant_normalised").otherwise("listed")
    tagged = row(kind, verdict, F.concat(letters, F.lit("-"), number, sfx), letters, number, _or_null(sfx), first, modifier, loop, safety, F.coalesce(modifier == "Z", F.lit(False)))
    return (
        F.when(t == "", unknown)
        .when(is_line, row(F.lit("line_number"), F.lit("grammar_valid"), t))
        .when(bare, unknown)
        .when(is_connector, row(F.lit("off_page_connector"), F.lit("grammar_valid"), ref))
        .when(is_equipment, row(F.lit("equipment"), F.lit("grammar_valid"), F.concat(eq_class, F.lit("-"), m["eq2"], train), eq_class, m["eq2"], _or_null(train)))
        .when(shaped, tagged)
        .otherwise(unknown)
    )


def line_fields(raw: Column) -> Column:
    """Map of a line number's fields by position: size, service, sequence, spec, extra1, extra2, and the rest joined."""
    t = normalise(raw)
    parts = F.split(_group(t, LINE_NUMBER, 2), "-")
    rest = F.slice(parts, len(LINE_FIELDS) + 1, F.greatest(F.size(parts) - len(LINE_FIELDS), F.lit(0)))
    names = F.array(*map(F.lit, LINE_FIELDS))
    n = F.least(F.size(parts), F.lit(len(LINE_FIELDS)))
    known = F.map_from_arrays(F.slice(names, 1, n), F.slice(parts, 1, n))
    size = F.map_from_arrays(F.array(F.lit("size")), F.array(_group(t, LINE_NUMBER, 1)))
    more = F.when(F.size(rest) > 0, F.map_from_arrays(F.array(F.lit("unparsed_fields")), F.array(F.array_join(rest, "-")))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    return F.when(t.rlike(LINE_NUMBER), F.map_concat(size, known, more))


def _compatible() -> tuple[str, str]:
    """Characters of other forms (full-width, circled, raised) and the printable ASCII character that each stands for."""
    found = [(chr(c), n) for c in range(0x80, 0x10000) if len(n := unicodedata.normalize("NFKC", chr(c))) == 1 and " " <= n <= "~"]
    return "".join(a for a, _ in found), "".join(b for _, b in found)


COMPATIBLE = _compatible()


def plain_forms(text: Column) -> Column:
    """Compatibility forms of single ASCII characters as these characters."""
    return F.translate(text, *COMPATIBLE)


def subject_tags(text: Column) -> Column:
    """Equipment tags named in a subject, with each train as a tag of its own, in order and once."""
    t = F.upper(plain_forms(text))
    found = F.regexp_extract_all(t, F.lit(r"\b([A-Z]{1,3}-\d{2,4}\s*(?:[A-Z]\b(?!-\d)(?:\s*(?:AND|/|,|&)\s*[A-Z]\b(?!-\d))*)?)"), F.lit(1))

    def expand(m):
        base = F.regexp_extract(m, r"^([A-Z]{1,3}-\d{2,4})", 1)
        trains = F.filter(F.split(F.regexp_replace(m, r"^[A-Z]{1,3}-\d{2,4}\s*", ""), r"\s*(?:AND|/|,|&)\s*"), lambda x: F.trim(x) != "")
        return F.when(F.size(trains) > 0, F.transform(trains, lambda x: F.concat(base, F.trim(x)))).otherwise(F.array(base))

    return F.array_distinct(F.flatten(F.transform(found, expand)))


def subject_part(text: Column) -> Column:
    return F.lower(_or_null(F.regexp_extract(plain_forms(text), r"(?i)\((shell|tube|body|jacket)\)", 1)))


def facility_hints(title: Column) -> Column:
    """Capitalised words of four letters or more, lower case, once."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(title, F.lit(r"(?U)\b([A-Z][a-zA-Z]{3,})\b"), F.lit(1)), F.lower)))


def referenced_tags(paragraph: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.upper(paragraph), F.lit(r"\b([A-Z]{1,4}-\d{2,4}(?:-\d{1,3})?[A-Z]?)\b"), F.lit(1)))
