"""Numbers, numbering, words and signatures as column expressions; Python in Arrow batches only where decimal rounding or JSON asks for it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType

#: Marks that end a numbering, and words for ordinals.
DOTS = r"[.\x{FF0E}\x{FF61}\x{3002})"
DIGIT = r"[1-9\x{FF11}-\x{FF19}]"
ROMANS = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIII", "XIV", "XV", "XVI", "XVII", "XVIII", "XIX", "XX")
ENGLISH = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty")


def to_number(c):
    """A text as a double, once trimmed and with full-width digits made plain: empty is 0; ±Infinity; 0x, 0o and 0b; decimal with exponent; else NaN."""
    t = F.translate(F.regexp_replace(c, r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$", ""), "０１２３４５６７８９．－＋", "0123456789.-+")
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    based = [F.when(t.rlike(f"^0[{p}]{digits}+$"), F.conv(F.substring(t, 3, 64), base, 10).cast("double")) for p, digits, base in (("xX", "[0-9a-fA-F]", 16), ("oO", "[0-7]", 8), ("bB", "[01]", 2))]
    plain = F.when(t.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), t.try_cast("double"))
    return F.when(c.isNull(), F.lit(None).cast("double")).when(t == "", 0.0).when(t.rlike(r"^\+?Infinity$"), inf).when(t == "-Infinity", -inf).otherwise(F.coalesce(*based, plain, nan))


def to_int(c):
    """A text as a whole number: a sign, and single underscores between digits, are allowed; null where it is none (or beyond 38 digits)."""
    t = F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(t.rlike(r"^[+-]?[0-9]+(?:_[0-9]+)*$"), F.replace(t, F.lit("_"), F.lit("")).try_cast("decimal(38,0)"))


def numbering_prefix(c):
    """struct(kind, text) of a line's leading numbering: 1 digits, 2 roman, 3 a letter A to H, 0 none (text null).

    One or two digits or capitals I, V, X before the end, a closing mark, a colon, white space or a dash that no digit follows; a letter
    or a small i, v, x before a closing mark; or digits in brackets.
    """
    main = F.regexp_extract(c, rf"^([IVX]+|{DIGIT}\p{{N}}?)(?:{DOTS}:]|-\P{{N}}|-$|[\s\p{{Z}}\x{{FEFF}}]|$)", 1)
    letter, small = F.regexp_extract(c, rf"^([A-Ha-h]){DOTS}]", 1), F.regexp_extract(c, rf"^([ivx]){DOTS}]", 1)
    bracket = F.regexp_extract(c, r"^[\[(] *([1-9][0-9]?) *[)\]]", 1)
    kind = F.when(main.rlike(f"^{DIGIT}"), 1).when(main != "", 2).when(letter != "", 3).when(small != "", 2).when(bracket != "", 1).otherwise(0)
    text = F.coalesce(*[F.nullif(x, F.lit("")) for x in (main, letter, small, bracket)])
    return F.struct(kind.alias("kind"), text.alias("text"))


def raised_number(first, second):
    """Whether a line's first span is a raised number before its second (structs text, top, bottom): lower, higher up, and a number."""
    high = lambda s: s["top"] - s["bottom"]
    return (high(first) < high(second)) & (first["bottom"] > second["bottom"] + 0.05 * high(second)) & ~F.isnan(to_number(first["text"]))


def ordinal(c):
    """Value of a number, a capital roman numeral up to XX or an English number word up to twenty; null for others and for nothing above 0."""
    words = F.create_map(*[F.lit(x) for names in (ROMANS,) for i, w in enumerate(names, 1) for x in (w, float(i))])
    english = F.create_map(*[F.lit(x) for i, w in enumerate(ENGLISH, 1) for x in (w, float(i))])
    number = F.when(c.rlike(r"^[0-9]+$"), c.try_cast("double"))
    return F.coalesce(F.when(number > 0, number), F.when(number.isNull(), F.coalesce(F.element_at(words, c), F.element_at(english, F.lower(c)))))


def letter_ordinal(c):
    """1 to 8 for a single letter a to h in either case, else null."""
    at = F.instr(F.lit("abcdefgh"), F.lower(c))
    return F.when((F.length(c) == 1) & (at > 0), at)


@F.pandas_udf(DoubleType())
def rounded(x: pd.Series, digits: pd.Series) -> pd.Series:
    """Rounded to so many decimals by the exact binary value, ties to even; built-in rounding starts from the shortest decimal text."""
    return pd.Series([None if a is None else round(float(a), int(n)) if a == a and abs(a) != float("inf") else a for a, n in zip(x, digits)], dtype="float64")


@F.pandas_udf(DoubleType())
def significant(x: pd.Series, digits: pd.Series) -> pd.Series:
    """Rounded to so many significant digits."""
    return pd.Series([float(f"{a:.{int(n)}g}") for a, n in zip(x, digits)], dtype="float64")


@F.pandas_udf(StringType())
def half_up(x: pd.Series) -> pd.Series:
    """One decimal, the exact value's ties away from zero."""
    from decimal import ROUND_HALF_UP, Decimal

    special = {float("inf"): "Infinity", float("-inf"): "-Infinity"}
    return pd.Series([None if a is None else "NaN" if a != a else special.get(a) or str(Decimal(a).quantize(Decimal("0.1"), rounding=ROUND_HALF_UP)) for a in x], dtype="object")


@F.pandas_udf(LongType())
def serialized_length(c: pd.Series) -> pd.Series:
    """Code points of a JSON text written with a blank after commas and colons."""
    import json

    return pd.Series([None if x is None else len(json.dumps(json.loads(x), ensure_ascii=False)) for x in c], dtype="Int64")


def without_fields(*fields: str):
    """A function from a JSON text column to it without these fields, however deep."""

    @F.pandas_udf(StringType())
    def strip(c: pd.Series) -> pd.Series:
        import json

        def cut(v):
            if isinstance(v, dict):
                return {k: cut(x) for k, x in v.items() if k not in fields}
            return [cut(x) for x in v] if isinstance(v, list) else v

        return c.map(lambda x: json.dumps(cut(json.loads(x)), ensure_ascii=False), na_action="ignore")

    return strip


def style_key(font, bold, size):
    """Font, weight and size of a span to one decimal, as one text."""
    return F.concat_ws(" ", F.coalesce(font, F.lit("")), F.when(bold, "B").otherwise("R"), half_up(size))


def heading_signature(kind, numbering, title):
    """What tells a heading from others: its kind and numbers or, without numbers, its letters and digits in lower case."""
    return F.concat(kind.cast("string"), F.lit("|"), F.when(F.size(numbering) > 0, F.array_join(numbering.cast("array<string>"), ",")).otherwise(F.array_join(F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), "")))


def parent_signature(kind, numbering):
    """A heading's kind and its numbers but the last."""
    return F.concat(kind.cast("string"), F.lit("|"), F.array_join(F.slice(numbering.cast("array<string>"), F.lit(1), F.greatest(F.lit(0), F.size(numbering) - 1)), ","))


def tokens(c):
    """Tokens of a text: runs of letters with their marks, of digits, and of like punctuation; a word parted by a soft hyphen and line break is one."""
    return F.regexp_extract_all(F.regexp_replace(c, r"\x{AD}\s*", ""), F.lit(r"[\p{L}\p{M}]+|\p{N}+|([^\s\p{L}\p{M}\p{N}])\1*"), F.lit(0))


def phrases(*texts: str):
    """A pattern of phrases over a text of tokens parted by blanks, the longest first, in any case."""
    import re

    rows = sorted({" ".join(re.findall(r"[^\W\d_]+|\d+|[^\w\s]", t.lower())) for t in texts}, key=lambda x: (-len(x), x))
    return "(?iu)(?<![^ ])(?:" + "|".join("".join("\\" + c if not c.isalnum() and c != " " else c for c in r) for r in rows) + ")(?![^ ])"


def told(c):
    return F.array_join(tokens(c), " ")


def starts_with_phrase(c, pattern: str):
    """Whether a text's tokens start with one of the phrases."""
    return told(c).rlike(pattern.replace("(?<![^ ])", "^", 1))


def is_phrase(c, pattern: str):
    """Whether a text's tokens are one of the phrases."""
    return told(c).rlike(pattern.replace("(?<![^ ])", "^", 1).removesuffix("(?![^ ])") + "$")


def earliest_phrase(c, pattern: str):
    """struct(at, phrase): the first token of the earliest of the phrases in a text (from 0; the longest of those that start there), null without any."""
    text = told(c)
    found = F.regexp_extract(text, pattern, 0)
    before = F.substring(text, F.lit(1), F.regexp_instr(text, F.lit(pattern)) - 1)
    return F.when(found != "", F.struct(F.size(F.filter(F.split(before, " "), lambda x: x != "")).alias("at"), F.lower(found).alias("phrase")))


def body_font_share(c, weights: dict):
    """Sum of the weights of a text's characters, such as those of formulas."""
    return F.aggregate(F.split(c, ""), F.lit(0.0), lambda n, x: n + F.coalesce(F.element_at(F.create_map(*[F.lit(y) for k, v in weights.items() for y in (k, float(v))]), x), F.lit(0.0)))
