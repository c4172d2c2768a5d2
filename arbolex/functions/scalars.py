"""Scalar column functions: prefixes, codes and their modifiers, URLs, times, log fields, one-line formats."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords that a corrupted dump spells wrong, and their right forms (German only).
KEYWORD_FIXES = {
    "Klaü": "Klaue",
    "miaün": "miauen",
    "schaün": "schauen",
    "traürn": "trauern",
    "Misstraün": "Misstrauen",
    "Fraünkleider": "Frauenkleider",
    "Stadtmaür": "Stadtmauer",
    "Vogelbaür": "Vogelbauer",
    "Saügetiere": "Säugetiere",
}


def has_prefix(col: str | Column, prefix: str) -> Column:
    """Case-insensitive prefix test, of all letters and not only of A to Z, in which every character is literal. On a stored lower-case column it is pushed into
    the Parquet scan; pass that column where there is one."""
    c = F.col(col) if isinstance(col, str) else col
    return c.startswith(prefix.lower())


def like_prefix(prefix: str) -> str:
    """A LIKE pattern for the same test, with the wildcards and the escape character escaped."""
    return re.sub(r"([\\%_])", r"\\\1", prefix) + "%"


def is_modified(code: Column) -> Column:
    """Whether a code carries a modifier: both an opening bracket and a plus."""
    return F.contains(code, F.lit("(")) & F.contains(code, F.lit("+"))


def without_modifier(code: Column) -> Column:
    """What stands before the first bracket."""
    return F.substring_index(code, "(", 1)


def modifier_id(key: Column) -> Column:
    """'11k46' -> '+46'; null without a 'k'."""
    return F.when(F.contains(key, F.lit("k")), F.concat(F.lit("+"), F.substring_index(key, "k", -1)))


def composed_label(base: Column, key: Column) -> Column:
    """'{base} (+ {key})', or the base alone without a key label."""
    return F.when(key.isNotNull() & (key != ""), F.concat(base, F.lit(" (+ "), key, F.lit(")"))).otherwise(base)


def fixed_keyword(lang: Column, keyword: Column) -> Column:
    fixes = F.create_map(*(F.lit(x) for kv in KEYWORD_FIXES.items() for x in kv))
    return F.when(lang == "de", F.coalesce(fixes[keyword], keyword)).otherwise(keyword)


def title_label(ident: Column) -> Column:
    """'some-catalogue_one' -> 'Some Catalogue One'."""
    return F.initcap(F.translate(ident, "-_", "  "))


def encode_uri_component(c: Column) -> Column:
    """Percent-encoding of all but A-Z a-z 0-9 - _ . ! ~ * ' ( )."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, plain in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def nested_url(code: Column, template: str) -> Column:
    """A code as a path inside a URL that is itself a query value: encoded twice, brackets included, at ``{code}``."""
    once = F.replace(F.replace(encode_uri_component(code), F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29"))
    head, _, tail = template.partition("{code}")
    return F.concat(F.lit(head), encode_uri_component(once), F.lit(tail))


def templated_url(template: Column, code: Column) -> Column:
    """The first ``{notation}`` of a template replaced by the encoded code; null without a template."""
    at = F.instr(template, "{notation}")
    filled = F.concat(F.substr(template, F.lit(1), at - 1), encode_uri_component(code), F.substr(template, at + len("{notation}")))
    return F.when(at > 0, filled).otherwise(template)


def iso_timestamp(c: Column) -> Column:
    """ISO-8601 with any number of fraction digits, cut to microseconds; null where it is none."""
    return F.try_to_timestamp(F.regexp_replace(c, r"(\.[0-9]{6})[0-9]+", "$1"))


def micros(c: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def short_tool(c: Column) -> Column:
    return F.substring_index(c, ":", -1)


def whole_ms(c: Column) -> Column:
    """Milliseconds as an integer, from a number or its text; 0 where it is none, or none that a long can hold."""
    return F.coalesce(c.try_cast("double").try_cast("long"), F.lit(0).cast("long"))


def duration_text(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    hours = F.format_string("%dh %dm", F.floor(s / 3600), F.floor(s % 3600 / 60))
    return F.when(s >= 3600, hours).otherwise(F.format_string("%dm %ds", F.floor(s / 60), s % 60))


def canonical_object(json: Column) -> Column:
    """A JSON value with the keys of all its objects sorted, as a comparison key; other text as it is. Variants keep the
    fields of an object in the order of their names."""
    return F.coalesce(F.to_json(F.try_parse_json(json)), json)


def chunk_suffix(number: Column) -> Column:
    """'aa', 'ab', ... 'zz' for the parts 0 to 675 of a split file."""
    letter = lambda i: F.char((F.lit(97) + i).cast("long"))
    return F.concat(letter(F.floor(number / 26)), letter(number % 26))


def cut_list(items: Column, most: int = 5) -> Column:
    """The first items, and '+N more' where there were more."""
    rest = F.array(F.concat(F.lit("+"), (F.size(items) - most).cast("string"), F.lit(" more")))
    return F.when(F.size(items) > most, F.concat(F.slice(items, 1, most), rest)).otherwise(items)


def collection_suffix(collections: Column) -> Column:
    return F.when(F.size(collections) > 0, F.concat(F.lit(" ("), F.array_join(collections, ", "), F.lit(")"))).otherwise(F.lit(""))


def entry_line(code: Column, text: Column, collections: Column, path: Column, prefix: str = "") -> Column:
    """code (collections) "text" [a > b]: an entry on one line; path is an array of codes."""
    tail = F.when(F.size(path) > 0, F.concat(F.lit(" ["), F.array_join(path, " > "), F.lit("]"))).otherwise(F.lit(""))
    return F.concat(F.lit(prefix), code, collection_suffix(collections), F.lit(' "'), text, F.lit('"'), tail)


def _folds() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by Unicode decomposition."""
    pairs = []
    for point in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(point))
        if len(base) > 1 and len(base[0]) == 1 and all(unicodedata.combining(c) for c in base[1:]):
            pairs.append((chr(point), base[0]))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


_ACCENTED, _PLAIN = _folds()


def folded(c: Column) -> Column:
    """Lower case, without accents. Texts of ASCII alone, told by their lengths, skip the table of accents."""
    low = F.lower(c)
    return F.when(F.octet_length(c) == F.char_length(c), low).otherwise(F.regexp_replace(F.translate(low, _ACCENTED, _PLAIN), r"\p{Mn}", ""))


def spaced(c: Column) -> Column:
    """The tokens of a text, runs of letters and digits of the folded text, each between single spaces; one space for
    none. A plain replacement is faster than an array of tokens, and is all that phrase search needs."""
    marks = F.when(F.octet_length(c) == F.char_length(c), F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")).otherwise(F.regexp_replace(folded(c), r"[^\p{L}\p{N}]+", " "))
    return F.regexp_replace(F.concat(F.lit(" "), marks, F.lit(" ")), "^  | {2,}$", " ")


def tokens(c: Column) -> Column:
    """The same tokens as an array."""
    return F.regexp_extract_all(folded(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
