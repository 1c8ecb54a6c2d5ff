"""Lines of right-to-left script in the order they are read: the bidirectional algorithm's rules as patterns over a string of character types.

A text's types are a string with one letter for each character, so each rule is one replacement, run by Spark's own regular expressions; nothing walks
characters but the last step, which turns runs round. One embedding level of a line is resolved, as for text without control characters.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.text import let

#: Unicode's bidirectional classes of the characters up to U+00FF and of the Hebrew and Arabic blocks; all others are L.
#: B paragraph and G segment separators, P boundary neutrals, W white space, O other neutrals, T and S terminators and separators of
#: numbers, C common separators, E European and N Arabic numbers, M marks, R Hebrew, A Arabic letters.
CLASSES = {
    "P": r"\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f\xad", "G": r"\x09\x0b\x1f", "B": r"\x0a\x0d\x1c-\x1e\x85", "W": r"\x0c\x20",
    "T": r"#$%\xa2-\xa5\xb0\xb1\x{66a}\x{609}\x{60a}", "S": r"+\-", "C": r",./:\xa0\x{60c}", "E": r"0-9\xb2\xb3\xb9\x{6f0}-\x{6f9}",
    "O": r"!\"&'()*;<=>?@\[\\\]\^_`{|}~\xa1\xa6-\xa9\xab\xac\xae\xaf\xb4\xb6-\xb8\xbb-\xbf\xd7\xf7\x{606}\x{607}\x{60e}\x{60f}\x{6de}\x{6e9}",
    "N": r"\x{600}-\x{605}\x{660}-\x{669}\x{66b}\x{66c}\x{6dd}", "M": r"\x{610}-\x{61a}\x{64b}-\x{65f}\x{670}\x{6d6}-\x{6dc}\x{6df}-\x{6e4}\x{6e7}\x{6e8}\x{6ea}-\x{6ed}",
    "R": r"\x{590}-\x{5f4}", "A": r"\x{608}\x{60b}\x{60d}\x{61b}-\x{64a}\x{66d}-\x{66f}\x{671}-\x{6d5}\x{6e5}\x{6e6}\x{6ee}\x{6ef}\x{6fa}-\x{6ff}\x{700}-\x{8ac}",
}
#: A line is read from the left if fewer than this share of its characters are of right-to-left script, and it has more than four.
SHARE, SHORT = 0.3, 4


def types(c):
    """A letter for each character: its class."""
    codes = {k: chr(0xE000 + i) for i, k in enumerate([*CLASSES, "L"])}
    out = F.regexp_replace(c, r"[\x{e000}-\x{e01f}]", "a")
    for k, chars in CLASSES.items():
        out = F.regexp_replace(out, f"[{chars}]", codes[k])
    return F.translate(F.regexp_replace(out, r"(?s)[^\x{e000}-\x{e01f}]", codes["L"]), "".join(codes.values()), "".join(codes))


def resolved(t, base: str):
    """The types of a line after the weak and neutral rules, for a line whose base is L or R.

    A pattern that begins with (?!^)\\G goes on where the last one ended, so it reaches every character of a run.
    """
    on = r"(?!^)\G"
    start = r"^|" if base == "L" else ""
    out = F.regexp_replace(t, r"(?:^|" + on + ")M", base)
    for k in "LRAESTNCWOBGP":  # marks are what they stand on
        out = F.regexp_replace(out, rf"(?:(?<={k})|{on})M", k)
    out = F.regexp_replace(out, rf"(A|{on})([^RLAE]*)E", "$1$2N")  # numbers after Arabic letters
    out = F.replace(out, F.lit("A"), F.lit("R"))
    out = F.regexp_replace(out, r"(?<=E)[SC](?=E)", "E")  # a separator between numbers
    out = F.regexp_replace(out, r"(?<=N)C(?=N)", "N")
    out = F.regexp_replace(F.regexp_replace(out, r"T(?=T*E)", "E"), rf"(?:(?<=E)|{on})T", "E")  # terminators beside numbers
    out = F.regexp_replace(out, "[WSTC]", "O")
    out = F.regexp_replace(out, rf"({start}L|{on})([^RLE]*)E", "$1$2L")  # numbers after letters from left to right
    # Neutrals between two of one direction are of it; what follows is judged by the character after the next, or the base.
    left = rf"(?:{start}(?<=L)|{on})O(?=O*(?:[^O]L{'|[^O]?$' if base == 'L' else ''}))"
    right = rf"(?:{'^|' if base == 'R' else ''}(?<=[^LO])|{on})O(?=O*(?:[^O][^L]{'|[^O]?$' if base == 'R' else ''}))"
    return F.translate(F.regexp_replace(F.regexp_replace(out, left, "l"), right, "R"), "Ol", base + "L")  # l: neutral still, for what is judged by it


def levels(t, base: str):
    """A digit for each character: its embedding level."""
    return F.translate(t, "LRENBGPOWTSCM", "0122" + "0" * 9) if base == "L" else F.translate(t, "LRENBGPOWTSCM", "2122" + "1" * 9)


def turned(c, level):
    """The characters in order of reading: runs of level 1 and more turned round, and runs of level 2 in them once more."""
    pair = F.arrays_zip(F.split(c, "").alias("c"), F.split(level, "").alias("l"))
    zero = F.struct(*[F.lit("").alias(x) for x in ("done", "round", "inner")])

    def step(acc, x):
        inner, closed = x["l"] == "2", F.concat(acc["inner"], acc["round"])
        return F.struct(
            F.when(x["l"] == "0", F.concat(acc["done"], closed, x["c"])).otherwise(acc["done"]).alias("done"),
            F.when(x["l"] == "0", "").when(inner, acc["round"]).otherwise(F.concat(x["c"], closed)).alias("round"),
            F.when(inner, F.concat(acc["inner"], x["c"])).otherwise("").alias("inner"),
        )

    return F.aggregate(pair, zero, step, lambda acc: F.concat(acc["done"], acc["inner"], acc["round"]))


def reordered(c, vertical=None):
    """A line as it is read; lines without right-to-left script, and vertical ones, stay as they are. Of others < and > go."""
    fit = c.rlike(r"[\x{590}-\x{8ac}]") if vertical is None else c.rlike(r"[\x{590}-\x{8ac}]") & ~F.coalesce(vertical, F.lit(False))

    def line(t):
        rtl = F.regexp_count(t, F.lit("[RAN]"))
        from_left = (rtl / F.length(c) < SHARE) & (F.length(c) > SHORT)
        # Nothing turns where no level is odd.
        of = lambda base: let(levels(resolved(t, base), base), lambda level: F.when(level.contains("1"), turned(c, level)).otherwise(c))
        return F.when(rtl > 0, F.translate(F.when(from_left, of("L")).otherwise(of("R")), "<>", "")).otherwise(c)

    return F.when(fit, let(types(c), line)).otherwise(c)
