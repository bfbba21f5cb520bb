"""A record's header has no largest size."""

from tapewright.llm import warc


def test_long_urls_are_read_back(spark):
    long = "http://a/" + "u" * 300_000
    rows = [(1, "http://a/1", "p" * (2 * warc.FRAME_BYTES)), (2, long, "short"), (3, "http://a/3", "also short"), (4, long + "4", "q" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    folder = warc.fresh_path(spark, "t")
    warc.write_bundles(pages, folder).collect()
    assert {(r.page_id, r.url, bytes(r.payload).decode()) for r in warc.read_bundles(spark, folder).collect()} == set(rows)
