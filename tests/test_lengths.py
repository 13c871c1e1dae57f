from threadloom.operators import search, sessions


def test_more_than_64_lengths(spark):
    word = "a" * 90
    asked = spark.range(1, 91).selectExpr("id AS query_id", f"left('{word}', int(id)) AS prefix")
    docs = spark.createDataFrame([(1, word)], "id long, content string")
    assert sorted(tuple(r) for r in search.prefix_search(docs, asked).collect()) == [(n, 1, 1) for n in range(1, 91)]
    refs = asked.selectExpr("query_id AS ref_id", "concat(prefix, ':ab') AS ref")
    held = spark.createDataFrame([(word,)], "id string")
    messages = spark.createDataFrame([(word, 7, "abc")], "session_id string, id long, uuid string")
    assert {r.status for r in sessions.resolve_refs(refs, held, messages).collect()} == {"ok"}
