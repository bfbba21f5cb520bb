from tapewright.operators import text as X

GROUPS = {"sector": {"rate": 2, "bank": 1}, "macro": {"oil": 3}, "noise": {"clown": -3}}


def test_relevance_looks_for_words_before_it_matches_them(spark):
    titles = ["Rate-cut, oil", "corporate banks", "BANK.", "foil", "é|oil|é", "clown", "", "bank\tno", "x_bank_x", "bank9 9oil"]
    heads = spark.createDataFrame([(i, 1, "s", t) for i, t in enumerate(titles)], "doc_id long, line int, source string, title string")
    out = X.relevance(heads, GROUPS, {})
    scores = {r.doc_id: r.score for r in out.collect()}
    assert scores == {0: 5, 1: 0, 2: 1, 3: 0, 4: 3, 5: 0, 6: 0, 7: 1, 8: 1, 9: 0}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" in plan and "regexp_replace(" not in plan  # words are looked for as bytes first, no line is rewritten
