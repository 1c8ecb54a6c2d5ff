import json

from quire.sources import files, store
from quire.streaming import ingest


def test_pdf_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, data in (("a/x.PDF", b"%PDF-1.7 x"), ("y.pdf", b"no"), ("z.txt", b"%PDF-")):
        (tmp_path / name).write_bytes(data)
    assert files.pdf_files(spark, str(tmp_path)).count() == 2
    assert [r["length"] for r in files.pdf_files(spark, str(tmp_path), content=True).collect()] == [10]


def test_page_spans(spark, tmp_path):
    page = {"page": 1, "viewbox": [0, 0, 1, 1], "rotation": 0, "spans": [{"bbox": [1, 2, 4, 3], "text": "a", "font_name": "f", "font_size": 9.0, "bold": True, "italic": False, "skew": 0.0}]}
    (tmp_path / "a.json").write_text(json.dumps([page, page | {"page": 2}]))
    (tmp_path / "b.json").write_text(json.dumps({"data": [page]}))
    got = files.page_spans(spark, str(tmp_path)).collect()
    assert sorted((r["page"], r["text"], r["left"], r["top"], r["bold"]) for r in got) == [(1, "a", 1.0, 4.0, True)] * 2 + [(2, "a", 1.0, 4.0, True)]


def test_difference(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, None), (3, 3.0, "z")], "k int, v double, s string")
    b = spark.createDataFrame([(1, 1.0 + 1e-9, "x"), (2, 2.5, None), (4, 3.0, "z")], "k int, v double, s string")
    got = {(r["k"], r["column"]) for r in files.difference(a, b, ["k"]).collect()}
    assert got == {(2, "v"), (3, "v"), (3, "s"), (4, "v"), (4, "s")}


def test_store_commits_with_the_record(spark, tmp_path):
    root = str(tmp_path / "s")
    rec = lambda *ids: spark.createDataFrame([(i, 3) for i in ids], "doc_id long, n_pages int")
    pages = lambda *ids: spark.createDataFrame([(i, p, "t") for i in ids for p in (1, 2, 3)], "doc_id long, page int, markdown string")
    nodes = lambda *ids: spark.createDataFrame([(i, 0, 1, 3) for i in ids], "doc_id long, ord int, start_page int, end_page int")
    store.write(root, rec(1, 2), pages(1, 2), nodes(1, 2))
    pages(3).write.mode("append").parquet(f"{root}/pages")  # a run that broke off
    assert store.read(spark, root, "pages").count() == 6
    store.remove(spark, root, str(tmp_path / "t"), rec(1).select("doc_id"))
    assert [r["doc_id"] for r in store.read(spark, str(tmp_path / "t"), "nodes").collect()] == [2]
    assert store.problems(spark.createDataFrame([(1, 0, 1, 4), (2, 0, 1, 3), (9, 0, 1, 1)], "doc_id long, ord int, start_page int, end_page int"), rec(1, 2)).count() == 2


def test_ingest_runs_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"doc_id": 1, "page": p, "markdown": "some words of a page that is read", "arrived": "2024-01-01T00:00:00"} for p in (1, 2, 2)]
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    for _ in range(2):
        ingest.ingest(ingest.arriving(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_a_run_again_shows_nothing_twice(spark, tmp_path):
    root, to = str(tmp_path / "s"), str(tmp_path / "m")
    rec = lambda *ids: spark.createDataFrame([(i, 2) for i in ids], "doc_id long, n_pages int")
    pages = lambda text, *ids: spark.createDataFrame([(i, p, text) for i in ids for p in (1, 2)], "doc_id long, page int, markdown string")
    nodes = lambda *ids: spark.createDataFrame([(i, 0, 1, 2) for i in ids], "doc_id long, ord int, start_page int, end_page int")
    store.write(root, rec(1, 2), pages("old", 1, 2), nodes(1, 2))
    store.write(root, rec(1), pages("new", 1), nodes(1))
    assert sorted((r["doc_id"], r["markdown"]) for r in store.read(spark, root, "pages").collect()) == [(1, "new"), (1, "new"), (2, "old"), (2, "old")]
    assert store.read(spark, root, "records").count() == 2
    store.write(root, rec(3), pages("x", 4), nodes(3))
    assert {(r["doc_id"], r["problem"]) for r in store.drift(spark, root).collect()} == {(1, "pages without a record"), (1, "nodes without a record"), (3, "a record without pages"), (4, "pages without a record")}
    assert store.push(spark, root, to) == 1 and store.push(spark, root, to) == 2
    assert sorted(r["doc_id"] for r in store.pulled(spark, to, "records").collect()) == [1, 2] and store.pulled(spark, to, "pages").count() == 4


def test_small_files(spark, tmp_path):
    at = str(tmp_path / "x.json")
    assert store.put_text(spark, at, "one") and store.put_text(spark, at, "two") and not store.put_text(spark, at, "three", new=True)
    assert (tmp_path / "x.json").read_text() == "two" and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["x.json"]
    with store.locked(spark, str(tmp_path)):
        try:
            with store.locked(spark, str(tmp_path), 0.2):
                raise AssertionError("two hold the lock")
        except TimeoutError:
            pass
    assert not (tmp_path / "lock").exists()
    (tmp_path / "rows.json").write_text('{"a": 1}\nnot json\n{"a": "x"}\n{"a": 2}\n')
    assert sorted(r["a"] for r in files.tolerant_json(spark, str(tmp_path / "rows.json"), "a INT").collect()) == [1, 2]
    assert (files.location("s3://b/k"), files.location("gs://b"), files.location("/x")) == ("s3a://b/k", "gs://b", "file:///x")
    for bad in ("ftp://x", "s3:///k"):
        try:
            files.location(bad)
            raise AssertionError(bad)
        except ValueError:
            pass
