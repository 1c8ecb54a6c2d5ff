"""The queries themselves, over small tables: columns, folds, and the rows of their operators."""

import zlib

import pytest

from quire.llm import common, language, queries

COLUMNS = {
    "1": "doc_id n_assign n_access n_hex base_sha256 spans",
    "2": "vec_id n_links component_id kept",
    "3": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "4": "doc_id held_out lang_pred score",
    "5": "doc_id n_bytes n_removed n_spans kept_sha256",
    "6": "doc_id size source_size target taken",
    "7": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "8": "doc_id held_out score predicted",
    "9": "doc_id n_shingles component_id",
    "10": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "11": "doc_id held_out score predicted",
    "12": "word form root n n_near form_n",
    "13": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    words = {"en": "the of and to in is that it was for".split(), "de": "der die und in den von zu das mit sich".split()}
    rows = [(i, " ".join(words[x][(i * 7 + j * j) % 10] for j in range(20)) + (" !!! $$$ buy" if i % 2 else ""), x if i % 9 else None, "s") for i in range(120) for x in [("en", "de")[i // 2 % 2]]]
    rows += [(1000, None, "en", None), (1001, "", "en", "s"), (1002, "x" * 1_200_000, None, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 120)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(i, [1.0, float(i % 3)], i % 2) for i in range(12)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns_and_rows(spark, tables, name):
    """A null, an empty and a very long text (1.2 MB in one word) among the documents; a row for each but in packing, which has pieces."""
    n = name.split("_")[0].removeprefix("op")
    got = queries.QUERIES[name](spark, tables)
    rows = got.collect()
    assert set(COLUMNS[n].split()) <= set(got.columns)
    if n not in ("10", "12"):
        assert len(rows) == (12 if n == "2" else 123)
    if n in ("4", "8", "11"):
        fold, kept = ((4, 2) if n == "4" else (5, 0))
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % fold == kept) and 0 <= r["score"] <= 1 for r in rows)
    if n == "4":
        by = {r["doc_id"]: r["lang_pred"] for r in rows}
        assert by[1000] == by[1001] == "und" and all(by[i] == ("en", "de")[i // 2 % 2] for i in range(120))
    if n == "8":
        assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)
        assert all(r["predicted"] == r["doc_id"] % 2 for r in rows if r["held_out"] and r["doc_id"] < 120)


def test_labels_of_held_out_documents_are_not_learned(spark, tables):
    """Other languages on the held-out fold change no prediction."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    held = language.remainder("doc_id", 4) == 2
    from pyspark.sql import functions as F

    turned = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang")))
    a, b = language.fitted(docs), language.fitted(turned)
    assert a.langs == b.langs and a.trigram == b.trigram and a.words == b.words


@pytest.mark.parametrize("total", [10**3, 10**5, 10**10])
def test_bounded_sample_at_any_count(spark, total):
    """A share of the rows, however large the count; never empty, also where all rows are alike."""
    df = spark.range(100_000).selectExpr("id AS doc_id", "concat('t', id) AS text")
    got = common.bounded_sample(df, "doc_id", 500, total).count()
    assert (got == 500 if total == 10**10 else 0.7 < got / (500 * 100_000 / total) < 1.3)
    same = spark.range(1000).selectExpr("cast(null AS long) AS doc_id", "cast(null AS string) AS text")
    assert common.bounded_sample(same, "doc_id", 10).count() in (10, 1000)
