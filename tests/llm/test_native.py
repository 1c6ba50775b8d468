"""Line deduplication, source mixing and URL lists against their SQL on awkward rows."""

from fixtures import documents, rows_of, sql
from pyspark.sql import functions as F

from tidewheel.llm import line_dedup, mixing, url_filters


def test_line_dedup(spark, tmp_path):
    documents(spark, tmp_path)
    got = line_dedup.op6_line_dedup(spark, str(tmp_path))
    assert rows_of(got) == sql(tmp_path, line_dedup.ORACLE, "documents")
    dropped = {r["doc_id"]: r["n_dropped"] for r in got.collect() if r["source"] == "src0"}
    assert dropped[1 * 5] == 1 and dropped[100] == 0


def test_line_dedup_names_and_empty(spark):
    df = spark.createDataFrame([(1, "a", "s", 9, 9)], "doc_id long, text string, source string, n_lines long, mine long")
    row = line_dedup.drop_boilerplate(df).first()
    assert row["n_lines"] == 1 and row["mine"] == 9
    assert line_dedup.drop_boilerplate(df.limit(0)).count() == 0


def test_mixing(spark, tmp_path):
    documents(spark, tmp_path)
    assert rows_of(mixing.op8_mix_sources(spark, str(tmp_path))) == sql(tmp_path, mixing.ORACLE, "documents")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for share, epochs in ((0.05, 3), (2.5, 4), (9.0, 2)):
        got = mixing.mix_sources(docs, share=share, max_epochs=epochs).select("doc_id", "domain", "lang", "source", "n_tokens", "copies")
        assert rows_of(got) == sql(tmp_path, mixing.oracle(share=share, max_epochs=epochs), "documents")
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("tier0", "en", "a", 10), ("tier0", "en", "b", 1000), ("tier0", "de", "c", 1000), ("tier1", "en", "d", 5000)], "domain string, lang string, source string, tokens long")
    plan = mixing.leaf_targets(leaves, share=0.1, max_epochs=1, weights={"domain": {"tier0": 1.0, "tier1": 1.0}, "lang": {"en": 1.0, "de": 1.0}})
    got = {r["source"]: r["target"] for r in plan.collect()}
    assert got == {"a": 10, "b": 165, "c": 175, "d": 350}  # b takes a's shortage; c and d keep their shares


def test_url_filters(spark, tmp_path):
    urls = ["http://a.example.com/x/y?q#f", "https://user@A.Example.COM.:80/x/", "not a url", "", None, "ftp://b.org", "http://a.example.com/x/y?q#f", "http://spam.example.com/en/1", "http://spam.example.com/en/2"]
    spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = url_filters.op5_url_filters(spark, str(tmp_path))
    assert rows_of(got) == sql(tmp_path, url_filters.ORACLE, "pages")
    assert {r["n_rows"] for r in got.collect()} == {1, 2}


def test_as_of_join(spark):
    entries = spark.createDataFrame(
        [("spam", "bad.com", "add", 10), ("spam", "bad.com", "remove", 20), ("spam", "bad.com", "add", 30), ("allow", "good.bad.com", "add", 12), ("spam", "bad.com", "remove", 30), (None, "x.com", "add", 1), ("spam", "bad.com", "add", 40)],
        "list_name string, key string, action string, at long",
    )
    captures = spark.createDataFrame([(i, u, t) for i, (u, t) in enumerate([("http://bad.com/", 9), ("http://bad.com/", 10), ("http://bad.com/", 19), ("http://bad.com/", 20), ("http://bad.com/", 35), ("http://sub.bad.com/p", 41), ("http://good.bad.com/", 15), ("http://bad.com/", None)])], "page_id long, url string, fetched_at long")
    got = [r["blocked"] for r in url_filters.filter_captures(captures, entries).orderBy("page_id").collect()]
    assert got == [False, True, True, False, False, True, False, False]
    assert url_filters.filter_captures(captures, entries.limit(0)).where(F.col("blocked")).count() == 0


def test_clashing_columns_stay(spark):
    row = (1, "a b", "en", "src1", 7, 8, 9)
    df = spark.createDataFrame([row], "doc_id long, text string, lang string, source string, _lines long, _domain long, _range long")
    cut = line_dedup.drop_boilerplate(df).first()
    assert (cut["_lines"], cut["n_lines"], cut["_domain"]) == (7, 1, 8)
    mixed = mixing.mix_sources(df.withColumn("copies", F.lit(5)).withColumn("domain", F.lit("x")), share=2.0).first()
    assert (mixed["_domain"], mixed["_range"], mixed["copies"], mixed["domain"], mixed["n_tokens"]) == (8, 9, 2, "tier1", 2)


def test_url_filters_edges(spark):
    captures = spark.createDataFrame([(1, "http://bad.com/" + "p/" * 5000 + "end", 15, "x"), (1, "http://bad.com/" + "p/" * 5000 + "end", 15, "y")], "page_id long, url string, fetched_at long, list_name string")
    entries = spark.createDataFrame([("spam", "bad.com/p/p", "add", 10)], "list_name string, key string, action string, at long")
    row = url_filters.filter_captures(captures, entries).first()
    assert (row["n_rows"], row["blocked"], row["matched_key"]) == (2, True, "bad.com/p/p")
    assert url_filters.filter_captures(captures.limit(0), entries).count() == 0
