"""Literal cases of cleaning, lineage, windows, merges, retention, tags, readers and streams."""

import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.operators import matching, merging, search, sessions, topics, vectors
from threadloom.operators.stemming import stem
from threadloom.sources import registry, transcripts

MESSAGES = "id long, session_id string, role string, content string, ts double, ts_iso string, uuid string"


def one(spark, column, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("c"))).collect()]


def talk(spark, *rows):
    return spark.createDataFrame([(i, s, role, text, float(i), "2024-01-01T00:00:00Z", f"{i:08x}aaaa") for i, (s, role, text) in enumerate(rows, 1)], MESSAGES)


def test_cleaning(spark):
    assert one(spark, X.strip_tools, "a [TOOL:sh] {x} [SYSTEM] b", "[TOOL_RESULT] all of it", "a [TOOLS] b", "x [TOOL] y\nz") == ["a [SYSTEM] b", "", "a [TOOLS] b", "x"]
    assert one(spark, X.strip_envelopes, "<system-reminder>x</system-reminder>y", "a <bash-input k='1'>b", "<command-names>x", "<b>x</b>") == ["y", "a ", "<command-names>x", "<b>x</b>"]
    assert one(spark, X.strip_thinking, "[THINKING] deep\nshown", "[THINKING] a [SYSTEM] b", "[THINKING]") == ["shown", "[SYSTEM] b", ""]
    text = "[THINKING] deep\nshown [TOOL:sh] x [SYSTEM]  y"
    shown = {(t, k): one(spark, lambda c: X.display_text(c, t, k), text)[0] for t in (False, True) for k in (False, True)}
    assert shown == {(False, False): "shown [SYSTEM] y", (False, True): "[THINKING] deep shown [SYSTEM] y", (True, False): "shown [TOOL:sh] x [SYSTEM] y", (True, True): "[THINKING] deep shown [TOOL:sh] x [SYSTEM] y"}
    assert one(spark, X.is_low_signal, "", " Hi ", "/clear now", "/path/x", "<command-name>x", "{1}", "real words") == [True, True, True, False, True, True, False]
    assert one(spark, X.is_displayable, "[THINKING] ", "[Request interrupted by user]", "[TOOL:x] y", "text") == [False, False, False, True]


def test_times_and_names(spark):
    assert one(spark, X.iso_to_epoch, "1970-01-01T00:01:00Z", "1970-01-01T01:00:00+01:00", "1970-01-01T00:00:30", "never", "") == [60, 0, 30, 0, 0]
    assert one(spark, X.normalize_epoch, "60", "1704067200000", "1704067200000000", "1970-01-01 00:00:05", "x") == [60, 1704067200, 1704067200, 5, 0]
    assert one(spark, X.normalize_role, "HUMAN", " bot ", "tool", "system", "??") == ["user", "assistant", "assistant", "system", "assistant"]
    assert one(spark, X.project_of, "/a/b/", "/", "", None) == ["b", None, None, None]


def test_snippets(spark):
    text = "x" * 200 + " Needle in hay, needle " + "y" * 300
    got = one(spark, lambda c: X.make_snippet(c, F.array(F.lit("needle"), F.lit("hay"))), text, "none")
    assert ">>>Needle<<< in >>>hay<<<, >>>needle<<<" in got[0] and got[1] is None


def test_stems():
    cases = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "hopping": "hop", "filing": "file", "relational": "relat", "generalizations": "gener", "oscillators": "oscil", "sky": "sky"}
    assert {w: stem(w) for w in cases} == cases


def test_lineage(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("x", "gone"), ("p", "q"), ("q", "p"), ("s", "s")] + [(f"n{i}", f"n{i - 1}" if i else None) for i in range(60)]
    got = {r.id: r.root for r in sessions.lineage_root(spark.createDataFrame(rows, "id string, parent_id string")).collect()}
    assert [got[k] for k in "abcxpqs"] == ["a", "a", "a", "gone", "p", "p", "s"] and got["n59"] == "n0"


def test_windows_and_budget(spark):
    m = talk(spark, *[("s", "user" if i % 2 else "assistant", f"message {i}") for i in range(10)], ("t", "user", "other"))
    anchors = m.where("id = 5").select(F.lit("r").alias("ref_id"), "session_id", "id")
    w = sessions.anchored_window(m, anchors, 2)
    assert [(r.id, r.ord) for r in w.orderBy("ord").collect()] == [(3, -2), (4, -1), (5, 0), (6, 1), (7, 2)]
    assert {(r.before, r.after) for r in w.collect()} == {(2, 3)}
    cut = sessions.apply_budget(w, 25, "…").orderBy("ord").collect()
    assert [r.text for r in cut] == ["message 2", "message 3", "message…"] and cut[-1].used == 26
    ends = {(r.section, r.ord): r.id for r in sessions.bookends(m, 2).where("session_id = 's'").collect()}
    assert ends == {("start", 1): 1, ("start", 2): 2, ("end", 1): 10, ("end", 2): 9}


def test_references(spark):
    m = talk(spark, ("aaaaaaaa11", "user", "x"), ("aaaaaaaa22", "user", "y"), ("bbbbbbbb33", "user", "z"))
    s = spark.createDataFrame([("aaaaaaaa11",), ("aaaaaaaa22",), ("bbbbbbbb33",)], "id string")
    refs = spark.createDataFrame([(1, "ref=bbbbbbbb:00000003"), (2, "aaaaaaaa:00000001"), (3, "cccccccc:0000000a"), (4, "nothing"), (5, "bbbbbbbb:123"), (6, "bbbbbbbb:ffffffff")], "ref_id int, ref string")
    got = {r.ref_id: (r.id, r.status) for r in sessions.resolve_refs(refs, s, m).collect()}
    assert got == {1: (3, "ok"), 2: (None, "ambiguous"), 3: (None, "not_found"), 4: (None, "invalid"), 5: (None, "legacy"), 6: (None, "not_found")}


def test_queries(spark):
    q = spark.createDataFrame([(1, 'Find "Exact Phrase" of the deploy*'), (2, "and or"), (3, "a.b_c ~/x/y")], "query_id int, text string")
    got = {(r.query_id, r.term, r.is_phrase) for r in search.query_terms(q).collect()}
    assert got == {(1, "exact phrase", True), (1, "find", False), (1, "deploy", False), (3, "a.b_c", True), (3, "~/x/y", True)}
    open_quote = spark.createDataFrame([(1, 'foo "bar baz')], "query_id int, text string")
    assert [r.term for r in search.query_terms(open_quote).orderBy("pos").collect()] == ["foo", "bar", "baz"]
    clauses = {(r.alt, r.seg, r.negative, r.term) for r in matching.query_clauses(spark.createDataFrame([(1, 'deploy && !staging || "in prod" NOT test')], "query_id int, text string")).collect()}
    assert clauses == {(0, 0, False, "deploy"), (0, 2, True, "staging"), (1, 3, False, "in prod"), (1, 4, True, "test")}


@pytest.mark.parametrize("partitions", [1, 5])
def test_merges_do_not_depend_on_order(spark, partitions):
    rows = [(s, f"s{k}", "user", f"t{k}{n}", f"u{n}" if n else "", k * 10 + n + 100 * s) for s in (0, 1, 2) for k in range(3) for n in range(3)]
    m = spark.createDataFrame(rows, "store int, session_id string, role string, content string, uuid string, id long").repartition(partitions)
    got = merging.merge_messages(m)
    assert sorted((r.session_id, r.uuid, r.store) for r in got.collect() if r.uuid) == [(f"s{k}", f"u{n}", 0) for k in range(3) for n in (1, 2)]
    assert got.where("uuid = ''").count() == 9 and merging.merge_messages(m, keep_blank=False).where("uuid = ''").count() == 3
    again = merging.merge_messages(got.drop("new_id"))
    assert {(r.session_id, r.uuid, r.id) for r in again.collect()} == {(r.session_id, r.uuid, r.id) for r in got.collect()}


def test_retention(spark):
    files = spark.createDataFrame([(f"/{k}.jsonl", 1.0, 1, "f", k) for k in "abcde"], "path string, mtime double, size long, fp string, session_id string")
    held = spark.createDataFrame([("a", None), ("b", 5.0), ("c", None), ("d", 5.0), ("e", None)], "id string, missing_since double")
    listing = files.where("session_id IN ('a', 'b', 'e')").drop("session_id")
    dead = spark.createDataFrame([("e",)], "session_id string")
    actions = merging.reconcile_retention(files, held, listing, dead)
    assert {r.session_id: r.action for r in actions.collect()} == {"a": "none", "b": "clear", "c": "stamp", "d": "none", "e": "prune"}
    assert {r.id: r.missing_since for r in merging.apply_retention(held, actions, 9.0).collect()} == {"a": None, "b": None, "c": 9.0, "d": 5.0}
    with pytest.raises(ValueError):
        merging.delete_plan(held, dead, files, "m0")
    with pytest.raises(ValueError):
        merging.assert_no_history_loss(dead, held)


def test_segments(spark):
    m = talk(spark, *[("s", "user", f"m{i}") for i in range(6)])
    starts = m.where("id IN (1, 4)").select("session_id", F.col("uuid").alias("start_uuid"))
    ends = {r.start_uuid[:8]: r.end_uuid[:8] for r in topics.build_segments(starts, m).collect()}
    assert ends == {"00000001": "00000003", "00000004": "00000006"}
    segs = spark.createDataFrame([("s", 1, 3, "first"), ("s", 2, None, "second")], "session_id string, start_id long, end_id long, topic string")
    assert {r.id: r.topic for r in topics.topic_for_message(m, segs).collect()} == {1: "first", **{i: "second" for i in range(2, 7)}}
    sets = spark.createDataFrame([("s", "m1", "h1"), ("s", "m2", "h1"), ("t", "m1", "h1"), ("t", "m2", "h2")], "session_id string, origin_machine string, hash string")
    assert {r.session_id: (r.origin_machine, r.hash, r.conflict) for r in topics.resolve_tags(sets).collect()} == {"s": ("m2", "h1", False), "t": ("m2", "h2", True)}


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0]), (5, [2.0, 0.0])], "vec_id long, vec array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, qvec array<float>")
    assert [(r.vec_id, r.rank) for r in vectors.vector_knn(v, q, 3).orderBy("rank").collect()] == [(5, 1), (1, 2), (2, 3)]
    corpus = spark.createDataFrame([("s", f"h{i}", i, f"text {i}") for i in range(5)], "session_id string, content_hash string, msg_id long, text string")

    def embed(texts):
        if len(texts) > 1:
            raise RuntimeError("too many")
        return [None if texts[0].endswith("3") else [float(len(texts[0]))]]

    assert sorted(r.msg_id for r in vectors.embed_corpus(corpus, embed).collect()) == [0, 1, 2, 4]


def test_block_records(spark, tmp_path):
    folder = tmp_path / "t" / "subagents"
    folder.mkdir(parents=True)
    lines = [
        '{"type": "user", "uuid": "u1", "timestamp": "2024-01-01T00:00:00Z", "cwd": "/w/p", "message": {"role": "user", "content": "plain"}}', "", "{broken", '{"type": "progress"}',
        '{"type": "assistant", "uuid": "u2", "message": {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "thinking", "thinking": ""}, {"type": "tool_use", "name": "sh", "input": {"k": 1}}, {"type": "tool_result", "content": "out"}]}}',
        '{"type": "summary", "summary": "short", "leafUuid": "u3"}', '{"type": "user", "message": {"role": "user", "content": ""}}',
    ]
    (tmp_path / "t" / "abc.jsonl").write_text("\n".join(lines))
    (folder / "kid.jsonl").write_text(lines[0])
    raw = transcripts.lines(spark, str(tmp_path))
    got = [(r.session_id, r.role, r.content, r.uuid) for r in transcripts.read_block_jsonl(raw).orderBy("session_id", "line").collect()]
    assert got == [("abc", "user", "plain", "u1"), ("abc", "assistant", 'a [THINKING]  [TOOL:sh] {"k": 1} [TOOL_RESULT] out', "u2"), ("abc", "summary", "[SUMMARY] short", "u3"), ("t/kid", "user", "plain", "u1")]
    assert one(spark, registry.detect_source, "/x/rollout-1.jsonl", "/x/steps/1.jsonl", "/x/y.jsonl", "/x/y.txt") == ["rollout", "steps", "blocks", None]
    mixed = registry.read_mixed(raw)
    assert {(r.session_id, r.source) for r in mixed.collect()} == {("abc", "blocks"), ("t/kid", "blocks")}


def test_written_records_are_read_again(spark, tmp_path):
    m = talk(spark, ("s", "user", "one"), ("s", "odd", "two"), ("r", "assistant", "drei ü"))
    transcripts.write_block_jsonl(m, f"file://{tmp_path}/out")
    back = spark.read.text(f"file://{tmp_path}/out")
    assert back.count() == 3 and {r.session_id for r in back.collect()} == {"s", "r"}
