"""Text functions as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

ROMAN = r"^(?i)(?=[ivxlc])(c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"
#: The characters that break lines, and what must be matched of roman numerals, generic titles and content units.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def let(value, body):
    """body of the value, which is computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalized(c):
    """Lower case, everything but letters a-z and digits as single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def split_lines(c):
    """Lines of a text at any of the eleven break characters; a break at the end starts no line, and an empty text has none."""
    lines = F.split(c, LINE_BREAK, -1)
    return F.when(c == "", F.expr("cast(array() as array<string>)")).when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def char_stats(c):
    """Counts of characters by category."""
    kinds = {"number": r"\p{Nd}", "upper": r"[\p{Lu}\p{Lt}]", "lower": r"\p{Ll}", "letter": r"\p{Lo}", "mark": r"\p{M}", "sentence": r"[.!?]", "dash": r"\p{Pd}", "math": r"\p{Sm}", "space": r"\s"}
    return F.struct(*[F.regexp_count(c, F.lit(p)).alias(k) for k, p in kinds.items()], F.length(c).alias("total"))


def bounded_edit_distance(a, b, limit):
    """Edit distance, or ceil(limit) where it is larger; with a limit of 0 or less, the longer length."""
    most = F.ceil(limit).cast("int")
    apart = F.call_function("levenshtein", a, b, most)  # stops at the limit, with -1 above it
    return F.when(limit <= 0, F.greatest(F.length(a), F.length(b))).otherwise(F.when(apart < 0, most).otherwise(apart))


def is_page_number_only(c):
    """A whole text of digits, or of a roman numeral up to XX."""
    return F.trim(c).rlike(r"^[0-9]{1,4}$") | F.trim(c).rlike(r"^(?i)(?:x|xx|x?(?:ix|iv|v?i{1,3}|v))$")


def is_dot_leader_row(c):
    """A row of a table of contents: text, a run of dots (blanks between them allowed), a number."""
    # Starts where a run of dots starts and gives nothing back, so a long line of dots or words is read once.
    return c.rlike(r"(?:[^\s.]\s*+|^\s*+\.\s*+|\.\s\s++)(?:\.\s?){3,}+\s*+[0-9ivxlcIVXLC]++\s*+$")


def numbering(c):
    """The leading decimal numbering ("1.2.3", four parts of one or two digits at most), or null."""
    found = F.regexp_extract(c, r"^\s*([1-9][0-9]?(?:\.[1-9][0-9]?){0,3})[.)]?(?:\s|$)", 1)
    return F.when(found == "", None).otherwise(found)


def roman_value(c):
    """Value of a roman numeral below 400, or null."""
    values = [(1, "i"), (5, "v"), (10, "x"), (50, "l"), (100, "c")]
    low = F.lower(c)
    total = sum((F.length(low) - F.length(F.replace(low, F.lit(s), F.lit("")))) * v for v, s in values)
    less = sum(F.when(low.contains(p), v).otherwise(0) for p, v in (("iv", 2), ("ix", 2), ("xl", 20), ("xc", 20)))
    return F.when(c.rlike(ROMAN), total - less)


#: Fixed values. Roman numerals up to 3999, and words that look like one but are not.
ROMAN_WORD = r"^(?=.)m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$"
NOT_ROMAN = ("di", "div", "li", "liv", "mi", "mix", "xi")


def title_words(c):
    """Runs of letters and digits of a title in lower case, formulas between dollar signs left out."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(c), r"\$[^$\n]*\$", ""), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def is_roman(word):
    return word.rlike(ROMAN_WORD) & ~word.isin(*NOT_ROMAN)


def roman_number(word):
    """Value of a word that is_roman(): a letter counts negative where a larger one stands anywhere behind it."""
    worth = F.create_map(*[F.lit(x) for kv in {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}.items() for x in kv])
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("top"))
    add = lambda acc, k: F.struct(F.when(F.element_at(worth, k) < acc["top"], acc["sum"] - F.element_at(worth, k)).otherwise(acc["sum"] + F.element_at(worth, k)).alias("sum"), F.greatest(acc["top"], F.element_at(worth, k)).alias("top"))
    return F.aggregate(F.split(F.reverse(word), ""), zero, add, lambda acc: acc["sum"])


def title_template(c):
    """A title as its words run together, with a # for each counter: a roman numeral, or a run of digits inside a word."""
    return F.array_join(F.transform(title_words(c), lambda w: F.when(is_roman(w), "#").otherwise(F.regexp_replace(w, "[0-9]+", "#"))), "")


def title_key(c):
    """A title as its words run together, roman numerals as digits."""
    return F.array_join(F.transform(title_words(c), lambda w: F.when(is_roman(w), roman_number(w).cast("string")).otherwise(w)), "")


def is_generic_title(c):
    """A title that only numbers a page, slide or sheet."""
    return c.rlike(r"(?iu)^(?:(?:page|slide|folie|document\s+page)\s*)?\p{Nd}+\n?\z")


def page_label(start, end):
    return F.when(start == end, F.format_string("p.%d", start)).otherwise(F.format_string("p.%d-%d", start, end))


def file_name(c, most: int = 180):
    """A safe file name: path and control characters as _, cut to `most` characters with the hash of the whole name."""
    safe = F.regexp_replace(F.trim(c), r'[\x00-\x1f<>:"/\\|?*]+', "_")
    return F.when(F.length(safe) <= most, safe).otherwise(F.concat(F.substring(safe, 1, most - 9), F.lit("_"), F.substring(F.md5(c), 1, 8)))


#: Bytes of a stored name, and how often a taken one is tried with a suffix; characters that names may not have, and device names.
NAME_BYTES, NAME_SUFFIXES = 180, 99
CONTROLS, ILLEGAL = r"[\x00-\x1f\x7f-\x9f\x{2028}\x{2029}]", r'[<>:"/\\|?*]'
BLANKS = r"[\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\x{feff} ]+"
DEVICES = r"(?i)^(?:con|prn|aux|nul|com[0-9]|lpt[0-9])(?:\..*)?$"


def byte_prefix(c, most):
    """The longest prefix of whole characters that has so many bytes in UTF-8 at most."""
    most = F.greatest(F.lit(0), most)
    raw = F.encode(c, "UTF-8")
    whole = F.hex(F.substring(raw, F.lit(1), most))
    goes_on = F.hex(F.substring(raw, most + 1, F.lit(1))).rlike("^[89AB]")  # the cut is inside a character, whose bytes go too
    return F.when(F.octet_length(c) <= most, c).otherwise(F.decode(F.unhex(F.when(goes_on, F.regexp_replace(whole, "[CDEF][0-9A-F](?:[89AB][0-9A-F])*$", "")).otherwise(whole)), "UTF-8"))


def truncated_name(c, suffix="", most: int = NAME_BYTES):
    """A name with the suffix before its extension; where that is over `most` bytes, cut, with the hash of the name, its extension kept as far as it fits."""
    suffix = F.lit(suffix) if isinstance(suffix, str) else suffix
    split = F.regexp_extract(c, r"(?s)^(.*[^.].*|[^.])(\.[^.]*)$", 1)
    base = F.when(split == "", c).otherwise(split)
    ext = F.substring(c, F.length(base) + 1, F.length(c))
    ending = F.concat(F.lit("_"), F.substring(F.md5(c), 1, 8), suffix)
    budget = F.lit(most) - F.octet_length(ending)
    kept = F.regexp_replace(byte_prefix(ext, budget - F.greatest(F.lit(1), F.octet_length(F.substring(base, 1, 1)))), "[ .]+$", "")
    head = byte_prefix(base, budget - F.octet_length(kept))
    return F.when(F.octet_length(F.concat(c, suffix)) <= most, F.concat(base, suffix, ext)).otherwise(F.concat(F.when(head == "", "_").otherwise(head), ending, kept))


def stored_name(c):
    """The name a document is stored by: compatible characters composed, quotes straight, control and path characters as _, white space as single blanks, no blanks or dots at the end, no device's name, NAME_BYTES bytes at most."""
    plain = F.translate(compatible(F.regexp_replace(c, CONTROLS, "_")), "\u2018\u2019\u02bc\u201c\u201d", "'''\"\"")
    clean = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(plain, BLANKS, " ")), ILLEGAL, "_"), "[ .]+$", "")
    named = F.when(clean == "", "untitled").otherwise(clean)
    return truncated_name(F.when(named.rlike(DEVICES), F.concat(F.lit("_"), named)).otherwise(named))


def created_at(c):
    """A time as text, in UTC with milliseconds; the text itself where it is none."""
    return F.coalesce(F.date_format(F.try_to_timestamp(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), c)


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching characters (longest matching blocks); batches come by Arrow."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(StringType())
def without_marks(c: pd.Series) -> pd.Series:
    """A text without diacritics; there is no built-in for it."""
    import unicodedata

    strip = lambda x: unicodedata.normalize("NFC", "".join(k for k in unicodedata.normalize("NFD", x) if not unicodedata.combining(k)))
    return c.map(strip, na_action="ignore")


@F.pandas_udf(StringType())
def compatible(c: pd.Series) -> pd.Series:
    """Compatibility composition (NFKC)."""
    import unicodedata

    return c.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")
