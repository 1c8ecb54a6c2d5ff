"""Personal data, also in disguise: transducers normalise, detectors run, spans are mapped back to the source."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import arrow

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number cannot start inside a run of digits: whatever matches there matches from the run's start too.
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Letters of other scripts that look like ASCII ones, beside those that compatibility normalisation maps to one ASCII character.
LOOKALIKES = dict(zip("аеорсухіјѕԁһԛԝгАВЕКМНОРСТУХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧονα", "aeopcyxijsdhqwrABEKMHOPCTYXIJSABEZHIKMNOPTYXova"))
#: Characters that show nothing.
HIDDEN = "​‌‍⁠﻿­"
#: Spelled digits of the corpus's languages.
DIGITS = {w: str(d) for d, ws in enumerate(("zero oh null cero zéro", "one un eins uno", "two deux zwei dos", "three trois drei tres", "four quatre vier cuatro", "five cinq fünf cinco", "six sechs seis", "seven sept sieben siete", "eight huit acht ocho", "nine neuf neun nueve")) for w in ws.split()}
PLUS = ("plus", "mas", "más")

_word = "(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + ")"
_item = rf"(?:{_word}|[0-9]{{1,4}})"
#: Three spelled digits or more, figures among them; at least one is spelled.
SPELLED = re.compile(rf"\b(?:(?:{'|'.join(PLUS)})[\s-])?(?=(?:[0-9]{{1,4}}[\s-]{{1,2}})*+{_word}\b){_item}\b(?:[\s-]{{1,2}}{_item}\b){{2,}}", re.I)
#: Endings that a spelled-out address may have. Fixed values.
ENDINGS = "com|org|net|edu|gov|mil|int|info|biz|name|io|co|ai|dev|app|me|tv|eu|us|uk|de|fr|es|it|nl|ch|at|be|pt|pl|ru|jp|cn|in|br|ca|au|mx|se|dk|kr|xyz|fi|gr|hu|ro|cz|ie|nz|za|ar|cl|tr|ua|il|sg|hk|tw|th|vn|ph|bg|hr|sk|lt|lv|ee|online|site|shop|club|tech|store|blog|cloud"
AT = r"\s?[\[({<_]\s?(?:at|@)\s?[\])}>_]\s?"
DOT = r"\s?[\[({<_]\s?(?:dot|\.)\s?[\])}>_]\s?"
# A bare " at " counts only before a spelled-out host.
HOST = rf"[A-Za-z0-9-]+(?:{DOT}|(?: dot [A-Za-z0-9-]+)*? dot (?:{ENDINGS})\b)"
DISGUISE = re.compile(rf"(?P<at>{AT}|(?<=[A-Za-z0-9]) at (?={HOST})|(?<=[A-Za-z0-9]) @ (?=[A-Za-z0-9]))|(?P<dot>{DOT}|(?<=[A-Za-z0-9]) (?:dot|\.) (?=[A-Za-z0-9]))", re.I)
BRACKETED = re.compile(r"[\[({<_]\s?(?:at|@|dot|\.)\s?[\])}>_]", re.I)
#: Runs of letters, by which a text is seen to hold a spelled digit at all.
LETTERS = re.compile(r"[^\W\d_]+")


def _odd_characters() -> dict[int, str | None]:
    found: dict[int, str | None] = {ord(c): a for c, a in LOOKALIKES.items()}
    for at in (*range(0x2000, 0x2200), *range(0x2460, 0x2500), *range(0xFF00, 0xFF60), *range(0x1D400, 0x1D800)):
        c = unicodedata.normalize("NFKC", chr(at))
        if len(c) == 1 and " " < c <= "~":
            found[at] = c
    found.update((ord(c), None) for c in HIDDEN)
    return found


ODD = _odd_characters()
#: The ranges that all of these lie in.
ODD_CLASS = re.compile("[\u00ad\u0370-\u052f\u2000-\u24ff\ufeff-\uff5f\U0001d400-\U0001d7ff]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the plain identifiers, leftmost and non-overlapping for each kind, failing ones dropped."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            found.append((start, 0, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(found)


class Transduced:
    """A text after edits (start, end, replacement), with the way back to the source."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        out, at, self.new, self.old, n = [], 0, [0], [0], 0
        for start, end, put in edits:
            out += [text[at:start], put]
            n += start - at
            self.new += [n, n + len(put)]
            self.old += [start, end]
            n, at = n + len(put), end
        self.text = "".join([*out, text[at:]])

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The source span of [start, end); an edit that the span touches is taken whole."""
        i = bisect_right(self.new, start) - 1
        a = self.old[i] + start - self.new[i] if i % 2 == 0 else self.old[i]
        j = bisect_right(self.new, end - 1) - 1
        b = self.old[j] + end - self.new[j] if j % 2 == 0 else self.old[j + 1]
        return a, b


def spelled(m: re.Match) -> str:
    words = re.split(r"[\s-]+", m[0].lower())
    return "".join("+" if w in PLUS else DIGITS.get(w, w) for w in words)


def disguised(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in the source of what detect() finds once look-alikes, spelled digits and at/dot are normalised."""
    steps = []
    if not text.isascii() and ODD_CLASS.search(text):
        if edits := [(m.start(), m.end(), ODD[ord(m[0])] or "") for m in ODD_CLASS.finditer(text) if ord(m[0]) in ODD]:
            steps.append(Transduced(text, edits))
            text = steps[-1].text
    low = text.lower()
    if not DIGITS.keys().isdisjoint(LETTERS.findall(low)) and (edits := [(m.start(), m.end(), spelled(m)) for m in SPELLED.finditer(text)]):
        steps.append(Transduced(text, edits))
        text = steps[-1].text
    # Each of the patterns' alternatives has one of these in it.
    if (" dot " in low or " @ " in text or " . " in text or ((("(" in text) or ("[" in text) or ("<" in text) or ("{" in text) or ("_" in text)) and BRACKETED.search(text))) and (edits := [(m.start(), m.end(), "@" if m["at"] else ".") for m in DISGUISE.finditer(text)]):
        steps.append(Transduced(text, edits))
        text = steps[-1].text
    if not steps:
        return []
    found = []
    for start, kind, end in detect(text):
        for s in reversed(steps):
            start, end = s.back(start, end)
        found.append((start, kind, end))
    return found


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The plain spans, and those that the transducers add: not inside a plain one of their kind."""
    base = detect(text)
    added = [(a, k, b) for a, k, b in disguised(text) if not any(k == x and s <= a and b <= e for s, x, e in base)]
    return base, sorted(set(added))


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, for each row of docs.

    The counts and base_sha256 are of the plain identifiers; spans (kind:start:end, code points of the source, by start and kind)
    has the disguised ones too, n_added of them. A null or empty text has none and the hash of the empty string; null and repeated
    ids are rows like others; an empty table gives an empty result; other columns are not read. Rows are taken one by one, so memory
    is that of the longest text.
    """

    def run(batches):
        for b in batches:
            rows = []
            for text in b.column(1):
                base, added = scan(text.as_py() or "")
                kinds = [k for _, k, _ in base]
                rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(told(base).encode()).hexdigest(), told(sorted(base + added)), len(added)))
            n, sha, spans, more = list(zip(*[r[:4] for r in rows])) or [[]] * 4, [r[4] for r in rows], [r[5] for r in rows], [r[6] for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(more, pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def op7(spark, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
