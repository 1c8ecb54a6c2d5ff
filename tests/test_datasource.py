"""The data source of span dumps: kinds of dumps, partitions, filters pushed down, another reader."""

import json

import pytest

from quire.sources import datasource


@pytest.fixture
def dumps(tmp_path):
    page = lambda p, *texts: {"page": p, "spans": [{"bbox": [1, 2.5, 3, 4], "text": t, "font_size": 9, "bold": i == 0} for i, t in enumerate(texts)]}
    (tmp_path / "in").mkdir()
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(page(p, f"a{p}", "é")) for p in (1, 2, 3)) + "\nno json\n[1]\n")
    (tmp_path / "in" / "b.json").write_text(json.dumps({"data": [page(2, "b2"), {"page": 3, "spans": None}, page(None, "b?")]}))
    (tmp_path / "in" / "c.json").write_text(json.dumps([page(5, "c5"), 7]))
    (tmp_path / "in" / "_d.json").write_text(json.dumps(page(1, "hidden")))
    (tmp_path / "e.json").write_text("")
    (tmp_path / "f.txt").write_text("other")
    return str(tmp_path)


def test_dumps_are_rows(spark, dumps):
    datasource.register(spark)
    df = spark.read.format("span_dumps").option("partBytes", 1).load(f"file://{dumps}")
    got = sorted((r["path"].rsplit("/", 1)[1], r["page"] or 0, r["ix"], r["text"], r["bold"]) for r in df.collect())
    assert got == [("a.jsonl", p, i, t, i == 0) for p in (1, 2, 3) for i, t in enumerate((f"a{p}", "é"))] + [("b.json", 0, 0, "b?", True), ("b.json", 2, 0, "b2", True), ("c.json", 5, 0, "c5", True)]
    assert df.rdd.getNumPartitions() == 4 and df.first()["right"] == 2.5
    assert spark.read.format("span_dumps").load(f"file://{dumps}").rdd.getNumPartitions() == 1


def test_filters_reach_the_reader(spark, dumps):
    datasource.register(spark)
    df = spark.read.format("span_dumps").option("partBytes", 1).load(f"file://{dumps}")
    few = df.where("page between 2 and 3 and text <> 'é'")
    assert sorted(r["text"] for r in few.collect()) == ["a2", "a3", "b2"]
    assert sorted(r["text"] for r in df.where("page in (1, 5)").collect()) == ["a1", "c5", "é"]
    assert df.where(f"path like '{dumps}/in/%'").count() == 3
    reader = datasource.SpanReader({"path": f"file://{dumps}", "partBytes": "1"})
    left = list(reader.pushFilters([datasource.StringStartsWith(("path",), f"{dumps}/in/"), datasource.GreaterThan(("page",), 2), datasource.EqualTo(("text",), "x")]))
    assert [f.attribute for f in left] == [("text",)] and [len(p.paths) for p in reader.partitions()] == [1, 1]
    assert [b.column(7).to_pylist() for p in reader.partitions() for b in reader.read(p)] == [["c5"]]


def test_another_reader(spark, dumps):
    class Shouting(datasource.SpanReader):
        def pages(self, raw):
            return ({**p, "spans": [{**s, "text": s["text"].upper()} for s in p["spans"]]} for p in super().pages(raw))

    class Loud(datasource.SpanDumps):
        reads = Shouting

        @classmethod
        def name(cls):
            return "loud_dumps"

    datasource.register(spark, Loud)
    assert "C5" in {r["text"] for r in spark.read.format("loud_dumps").load(f"file://{dumps}").collect()}


def test_an_empty_folder(spark, tmp_path):
    datasource.register(spark)
    assert spark.read.format("span_dumps").load(f"file://{tmp_path}").count() == 0


def test_lines_are_read_one_at_a_time(tmp_path):
    """Of a file of lines no more than a few pages are held at once; a batch has no more rows than BATCH_ROWS."""
    import tracemalloc

    page = json.dumps({"page": 1, "spans": [{"bbox": [1, 2, 3, 4], "text": f"t{i}"} for i in range(500)]})
    (tmp_path / "a.jsonl").write_text("\n".join([page] * 200))
    (tmp_path / "b.jsonl").write_text(json.dumps({"page": 2, "spans": [{"text": "x"}] * (2 * datasource.BATCH_ROWS + 5)}))
    reader = datasource.SpanReader({"path": f"file://{tmp_path}"})
    (part,) = reader.partitions()
    tracemalloc.start()
    sizes = [b.num_rows for b in reader.read(part)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == 200 * 500 + 2 * datasource.BATCH_ROWS + 5 and max(sizes) == datasource.BATCH_ROWS
    assert most < 30e6, most


@pytest.mark.parametrize("text, pages", [
    ('[\n{"page": 1, "spans": []},\n{"page": 2, "spans": []}\n]', [1, 2]),
    ('{\n"data": [{"page": 3, "spans": []}]}\n', [3]),
    ('\n \n{"data": [{"page": 4, "spans": []}]}\n\n', [4]),
    ('{"page": 5, "spans\n{"page": 6, "spans": []}\n{"page": 7, "spans": []}', [6, 7]),
    ('{"data": [{"page": 8, "spans": []}]}\n{"page": 9, "spans": []}', [9]),
    ('null\n{"page": 10, "spans": []}\r{"page": 11, "spans": []}\r\n', [10, 11]),
    ("no json\n[1]\n", []), ("", []), ("\n\n", []),
])
def test_kinds_of_files(tmp_path, text, pages):
    (tmp_path / "a.json").write_bytes(text.encode())
    (tmp_path / "b.json").write_bytes(text.encode("utf-16") if text.startswith(("[", "{\n")) else b"")
    reader = datasource.SpanReader({"path": f"file://{tmp_path}"})
    assert [p["page"] for p in reader.pages(reader.opened(f"{tmp_path}/a.json"))] == pages
    assert [p["page"] for p in reader.pages(text.encode())] == pages
    assert [p["page"] for p in reader.pages(reader.opened(f"{tmp_path}/b.json"))] == (pages if text.startswith(("[", "{\n")) else [])
