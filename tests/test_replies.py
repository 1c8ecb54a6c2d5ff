"""Readers' replies, stored names and percentiles: given cases, and names against one that stores in turn."""

import hashlib
import random
import unicodedata

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import stats, store, triage


def of(spark, build, *texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").orderBy("i").select(build(F.col("s"))).collect()]


def test_table_tokens(spark):
    reply = "<fcel>Item<fcel>2023<fcel>2022<nl><fcel>Revenue<fcel>1,234<fcel>1,100<nl><fcel>Total  assets<lcel><fcel>9<nl><ecel><ucel><fcel>x<nl>"
    rows = [["Item", "2023", "2022"], ["Revenue", "1,234", "1,100"], ["Total assets", "", "9"], ["", "", "x"]]
    assert of(spark, triage.table_rows_of_tokens, reply, "<fcel>a < b<nl>", "no cells", "<nl><nl>", None) == [rows, [["a < b"]], [], [], None]
    table = "| Item | 2023 | 2022 |\n| --- | --- | --- |\n| Revenue | 1,234 | 1,100 |\n| Total assets |  | 9 |\n|  |  | x |"
    assert of(spark, triage.table_of_tokens, reply, "", "<ecel><ecel>", "<fcel>a|b<nl><fcel>c<fcel>d") == [table, None, None, "| a\\|b |  |\n| --- | --- |\n| c | d |"]
    assert len(of(spark, triage.table_rows_of_tokens, "<fcel>x" * 12_000)[0][0]) == 12_000


def test_spotted_lines(spark):
    loc = lambda *n: "".join(f"<|LOC_{x}|>" for x in n)
    after, before = f"Item 7. MD&A{loc(100, 50, 500, 80)}\nRevenue grew{loc(100, 100, 600, 120)}", f"{loc(10, 20, 90, 20, 90, 40, 10, 40)}Title{loc(10, 50, 90, 50, 90, 70, 10, 70)}Body"
    got = of(spark, lambda c: triage.spotted_lines(c, F.lit(1000.0), F.lit(2000.0)), after, before, "just text\nmore", f"a{loc(1, 2)}b{loc(1500, 2, 3, 4)}tail", loc(1, 2, 3, 4))
    assert [[tuple(x) for x in g] if g is not None else None for g in got] == [[("Item 7. MD&A", 100.0, 100.0, 500.0, 160.0), ("Revenue grew", 100.0, 200.0, 600.0, 240.0)], [("Title", 10.0, 40.0, 90.0, 80.0), ("Body", 10.0, 100.0, 90.0, 140.0)], None, [("b", 3.0, 4.0, 1000.0, 8.0)], []]


def plain(name, suffix="", most=180):
    base, ext = (name[: name.rfind(".")], name[name.rfind(".") :]) if "." in name and name[: name.rfind(".")].strip(".") else (name, "")
    if len((name + suffix).encode()) <= most:
        return base + suffix + ext
    cut = lambda s, n: s.encode()[: max(0, n)].decode(errors="ignore")
    ending = "_" + hashlib.md5(name.encode()).hexdigest()[:8] + suffix
    ext = cut(ext, most - len(ending) - max(1, len(base[:1].encode()))).rstrip(" .")
    return (cut(base, most - len(ending) - len(ext.encode())) or "_") + ending + ext


def test_names_are_cut_by_bytes(spark):
    r = random.Random(1)
    names = ["é" * 179 + ".pdf", "a" * 176 + ".pdf", "a" * 177 + ".pdf", "x." + "y" * 300, "." * 200, ".hidden" * 40, "漢字😀" * 40 + ".pdf", "😀" * 50] + ["".join(r.choice("aé漢😀.b") for _ in range(r.randint(1, 140))) for _ in range(60)]
    assert of(spark, T.truncated_name, *names) == [plain(n) for n in names]
    assert of(spark, lambda c: T.truncated_name(c, "_12", 40), *names) == [plain(n, "_12", 40) for n in names]
    assert max(len(n.encode()) for n in of(spark, T.stored_name, *names)) <= 180


def test_stored_names(spark):
    given = {"a/b:c?.pdf": "a_b_c_.pdf", "  ﬁle 　“x” ‘y’ . ": "file _x_ 'y'", "con": "_con", "LPT1.txt": "_LPT1.txt", "console": "console", "": "untitled", " .. ": "untitled", "a\tb\x85c": "a_b_c", "Ｆｕｌｌ": "Full", "é": unicodedata.normalize("NFC", "é")}
    assert dict(zip(given, of(spark, T.stored_name, *given))) == given


def test_names_to_store(spark):
    r = random.Random(2)
    names = ["a.pdf", "a_1.pdf", "a_2.pdf", "b", "b_1", "c.tar.gz", "a_1_1.pdf"]
    rows = [(f"{i:03d}", r.choice(names[:3]) if i % 3 else r.choice(names), r.randint(0, 50)) for i in range(480)]
    taken = ["a_3.pdf", "b_2", "zz"]
    got = {x["id"]: x["name"] for x in store.names_to_store(spark.createDataFrame(rows, "id string, name string, created_at int"), spark.createDataFrame([(t,) for t in taken], "name string")).collect()}
    held, want = set(taken), {}
    for i, name, _ in sorted(rows, key=lambda x: (x[2], x[0])):
        want[i] = next((c for k in range(100) if (c := plain(name, f"_{k}") if k else name) not in held), None)
        held.add(want[i])
    assert got == want and None in want.values()


def test_percentiles_with_weights_of_nothing(spark):
    cases = [([(1.0, 1.0), (3.0, 1.0)], 0.5, 2.0), ([(1.0, 1.0), (3.0, 1.0), (5.0, 2.0)], 0.5, 4.0), ([(1.0, 1.0), (3.0, 2.0)], 0.5, 3.0), ([(2.0, 0.0)], 0.5, 2.0), ([(1.0, 1.0), (2.0, 0.0), (3.0, 1.0)], 0.5, 1.5), ([(1.0, 0.0), (2.0, 0.0)], 0.5, 1.0), ([(1.0, 1.0), (4.0, 0.0)], 1.0, 2.5), ([(1.0, 2.0), (4.0, 1.0)], 1.0, 4.0)]
    for rows, share, want in cases:
        assert [x["v"] for x in stats.weighted_percentile(spark.createDataFrame([(1, *x) for x in rows], "k int, v double, w double"), ["k"], "v", "w", share).collect()] == [want], rows


def test_a_reply_of_cell_tokens_is_read_once(spark):
    assert str(triage.table_of_tokens(F.col("reply"))).count("<nl>") == 1
    assert of(spark, triage.table_of_tokens, "<fcel>a<fcel>b<nl>" * 3_000 + "<fcel>c") == ["| a | b |\n| --- | --- |\n" + "| a | b |\n" * 2_999 + "| c |  |"]
