"""Lines of right-to-left script: known cases, and a version that walks characters."""

import random

from pyspark.sql import functions as F

from quire.functions import bidi

BY = {c: k for k, chars in {"W": " ", "T": "#$%", "S": "+-", "C": ",./:", "E": "0123456789", "O": "!()<>?", "N": "٠١٢", "M": "َّ", "R": "".join(map(chr, range(0x5D0, 0x5EB))), "A": "ابتث"}.items() for c in chars}


def walked(text):
    t = [BY.get(c, "L") for c in text]
    rtl, n = sum(x in "RAN" for x in t), len(text)
    if not rtl:
        return text
    base = "L" if rtl / n < 0.3 and n > 4 else "R"
    last = base
    for i in range(n):
        t[i] = last = last if t[i] == "M" else t[i]
    strong = base
    for i in range(n):
        strong = t[i] if t[i] in "RLA" else strong
        t[i] = "N" if t[i] == "E" and strong == "A" else t[i]
    t = ["R" if x == "A" else x for x in t]
    for i in range(1, n - 1):
        if (t[i] in "SC" and t[i - 1] == t[i + 1] == "E") or (t[i] == "C" and t[i - 1] == t[i + 1] == "N"):
            t[i] = t[i - 1]
    for i in range(n):
        j = i
        while t[i] == "T" and j < n and t[j] == "T":
            j += 1
        if t[i] == "T" and ((j < n and t[j] == "E") or (i and t[i - 1] == "E")):
            t[i] = "E"
    t = ["O" if x in "WSTC" else x for x in t]
    strong = base
    for i in range(n):
        strong = t[i] if t[i] in "RL" else strong
        t[i] = "L" if t[i] == "E" and strong == "L" else t[i]
    i = 0
    while i < n:
        j = i
        while j < n and t[j] == "O":
            j += 1
        if j > i:
            before, after = (t[i - 1] if i else base), (t[j + 1] if j + 1 < n else base)
            before, after = ("L" if x == "L" else "R" for x in (before, after))
            t[i:j] = [before if before == after else base] * (j - i)
        i = max(j, i + 1)
    level = [{"R": 1, "E": 2, "N": 2}.get(x, 0) if base == "L" else 2 if x in "LEN" else 1 for x in t]
    chars = list(text)
    for k in (2, 1) if 1 in level else ():
        i = 0
        while i < n:
            j = i
            while j < n and level[j] >= k:
                j += 1
            chars[i:j] = chars[i:j][::-1]
            i = max(j, i + 1)
    return "".join(c for c in chars if c not in "<>")


def read(spark, texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(bidi.reordered(F.col("t"))).collect()]


def test_known_lines(spark):
    assert read(spark, ["plain text <b> 12", "םולש", "abc םולש", "", None, "(אב)", "12 אבג"]) == ["plain text <b> 12", "שלום", walked("abc םולש"), "", None, walked("(אב)"), walked("12 אבג")]
    assert spark.range(1).select(bidi.reordered(F.lit("אב"), F.lit(True))).first()[0] == "אב"


def test_lines_are_those_walked(spark):
    r = random.Random(9)
    letters = [*BY, *"abcXYZé漢😀"]
    texts = ["".join(r.choice(r.choice([letters, "אבגד ", "abc 12,", "ابت٠١ 3", "1.2-3%#"])) for _ in range(r.randint(1, 25))) for _ in range(3000)]
    got = read(spark, texts)
    assert [(t, g, walked(t)) for t, g in zip(texts, got) if g != walked(t)][:5] == []
