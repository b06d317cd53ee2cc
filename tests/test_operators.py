"""Small cases with known answers, metamorphic checks, and batch against stream."""

import base64
import hashlib

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from ownerloom.functions import scalars
from ownerloom.operators import cutting, documents, ingest, merging, paths, reports
from ownerloom.sources import corpus
from ownerloom.streaming import observations


def _one(spark, column, **values):
    row = spark.createDataFrame([Row(**values)], ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [("", "", 1.0), ("alpha beta", "alpha beta", 1.0), ("alpha beta", "alpha gamma", 1 / 3), ("alpha\n\nbeta", "alpha", 0.5), ("a b c\n\nd", "a b\n\nd", (2 / 3 + 1) / 2), (" \n ", "", 1.0)],
)
def test_text_similarity(spark, a, b, expected):
    assert _one(spark, scalars.text_similarity(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(expected)


def test_refined_similarity_counts_characters_and_bytes(spark):
    got = _one(spark, scalars.refined_similarity(F.col("a"), F.col("b"), F.lit(0), F.lit(0), F.lit(1), F.lit(1)), a="äb", b="ab")
    assert got == pytest.approx(0.7 * 0.5 + 0.15 * 2 / 3 + 0.15)


@pytest.mark.parametrize(("text", "slug"), [("Hello, World!", "hello-world"), ("", "section"), ("--ß--", "section"), ("A1 b", "a1-b")])
def test_slugify(spark, text, slug):
    assert _one(spark, scalars.slugify(F.col("a")), a=text) == slug


@pytest.mark.parametrize(("text", "ok"), [("2024-02-29T23:59:59Z", True), ("2023-02-29T23:59:59Z", False), ("2024-01-01T00:00:00.123Z", True), ("2024-01-01T00:00:00+00:00", False), ("2024-01-01T24:00:00Z", False), ("x", False)])
def test_rfc3339(spark, text, ok):
    assert _one(spark, scalars.is_rfc3339_utc(F.col("a")), a=text) is ok


def test_hash_bucket(spark):
    assert _one(spark, scalars.hash_bucket(F.col("a"), 100), a="abc") == int(hashlib.sha256(b"abc").hexdigest(), 16) % 100 == 65


def test_verified_bytes(spark):
    good = base64.b64encode(b"data").decode()
    digest = hashlib.sha256(b"data").hexdigest()
    rows = [(good, None, 4, digest, None, None), (good, "r", 4, digest, None, "shape"), ("!!", None, 4, digest, None, "base64"), (None, "r", 4, digest, None, "missing_resource"), (None, "r", 4, digest, bytearray(b"data"), None), (good, None, 5, digest, None, "length"), (good, None, 4, "0", None, "digest")]
    df = spark.createDataFrame(rows, "i string, r string, n int, d string, res binary, want string")
    for row in df.select(scalars.verified_bytes(*[F.col(c) for c in ("i", "r", "n", "d", "res")]).alias("got"), "want").collect():
        assert row["got"] == row["want"]


def test_blocks_with_odd_white_space(spark):
    docs = spark.createDataFrame([(1, "\r\n a  b \r\n\r\n\r\nc\n\n \n\nd "), (2, ""), (3, None)], "doc_id int, text string")
    rows = {(r["index"], r["normalized"], r["start"], r["end"]) for r in cutting.text_blocks(docs).collect()}
    assert rows == {(0, "a b", 0, 3), (1, "c", 5, 6), (2, "d", 8, 9)}


def _lines(spark, text, doc=1):
    return spark.createDataFrame([(doc, k, t) for k, t in enumerate(text.split("\n"), 1)], "doc_id int, line int, text string")


@pytest.mark.parametrize(
    ("text", "reason"),
    [("# a\nx\n# b\ny", None), ("x\n# a", "text_before_first"), ("plain", "no_headings"), ("# a\n## b", "nested_headings"), ("# a\n# a", "duplicate_heading"), ("# a\ntitle\n===", "setext_heading"), ("# a\n```\n# no\n```", None), ("# a\n```\n~~~\n# a\n```\n# b", None), ("# a\n````\n```\n# a\n`````\n# b", None), ("# a\n``` x`y\n# a", "duplicate_heading"), ("# a\n~~~\n~~~ x\n# a\n~~~", None)],
)
def test_markdown_sections(spark, text, reason):
    sections, rejected = cutting.markdown_sections(_lines(spark, text))
    got = rejected.collect()
    assert ([r["reason"] for r in got] == [reason]) if reason else not got
    if not reason:
        assert "\n".join(r["text"] for r in sections.orderBy("start_line").collect()) == text


def _byte_lines(spark, text):
    return cutting.doc_lines(spark.createDataFrame([(1, text)], "doc_id int, text string"))


def test_conflict_regions(spark):
    text = "a\n<<<<<<< x\n1\n||||||| b\n2\n=======\n3\n>>>>>>> y\nz"
    good, bad = cutting.conflict_regions(_byte_lines(spark, text))
    row = good.first()
    assert [row[c] for c in ("start_line", "base_line", "separator_line", "end_line")] == [2, 4, 6, 8] and not bad.count()
    part = lambda a, b: text.encode()[row[a] : row[b]].decode()
    assert [part("ours_start", "ours_end"), part("base_start", "base_end"), part("theirs_start", "theirs_end")] == ["1\n", "2\n", "3\n"]
    assert part("start_byte", "end_byte") == text[2:-1]
    for text, line in (("<<<<<<<\n<<<<<<<\n=======\n>>>>>>>", 2), ("=======", 1), ("<<<<<<<\n=======", 1), ("x\n<<<<<<<\n>>>>>>>", 3), ("<<<<<<<\n=======\n=======\n>>>>>>>", 3), ("<<<<<<<\n======= x\n>>>>>>>", 3)):
        good, bad = cutting.conflict_regions(_byte_lines(spark, text))
        assert not good.count() and [tuple(r) for r in bad.collect()] == [(1, line, "invalid_markers")], text
    with pytest.raises(ValueError, match="marker size"):
        cutting.conflict_regions(_byte_lines(spark, "a"), 0)


def test_conflict_marks_at_the_edges(spark):
    text = "\ufeff<<<<<<<\tä\r\nä\r\n=======\r\n>>>>>>>"
    row = cutting.conflict_regions(_byte_lines(spark, text))[0].first()
    raw = text.encode()
    assert row["start_byte"] == 3 and raw[row["ours_start"] : row["ours_end"]].decode() == "ä\r\n" and row["theirs_start"] == row["theirs_end"] and row["end_byte"] == len(raw)
    assert cutting.conflict_regions(_byte_lines(spark, "<<<<<<<x\n=======x"))[0].count() == 0 and cutting.conflict_regions(_byte_lines(spark, "<<<<<<<x\n=======x"))[1].count() == 0
    two = "<<<<<<<\n=======\n>>>>>>>\n" * 2
    assert cutting.conflict_regions(_byte_lines(spark, two), max_regions=1)[1].first()["code"] == "region_limit"
    assert cutting.conflict_regions(_byte_lines(spark, two), max_bytes=10)[1].first()["code"] == "input_limit"


def test_freeze_blocks(spark):
    found = lambda text, token="k.p": tuple({tuple(r)[1:] for r in df.collect()} for df in cutting.freeze_blocks(_lines(spark, text), token))
    assert found("# k.p:freeze why\nx\n# K.P: Unfreeze") == ({(1, 3, "why")}, set())
    assert found("# kxp:freeze\n# kxp:unfreeze") == (set(), set())
    assert found("# k.p:freeze\n# k.p:freeze") == (set(), {("nested_freeze_open", 2), ("unclosed_freeze_open", 1)})
    assert found("# k.p:unfreeze\n# k.p:freeze\n# k.p:unfreeze") == (set(), {("unmatched_freeze_close", 1)})
    lines = _lines(spark, "# k.p:freeze\nx\n# k.p:unfreeze\ny")
    rows = cutting.freeze_block_of_lines(lines, cutting.freeze_blocks(lines, "k.p")[0]).orderBy("line").collect()
    assert [(r["start_line"], r["end_line"]) for r in rows] == [(1, 3)] * 3 + [(None, None)]


def test_json_owners_tell_where_they_were_cut(spark):
    docs = spark.createDataFrame([(1, '{"a":{"b/c":[1,{"d":2}]},"e":{}}')], "doc_id int, j string")
    rows = {r["path"]: (r["match_key"], r["parent"], r["cut"]) for r in cutting.json_owners(docs, "j", 2).collect()}
    assert rows == {"/a": ("a", "", False), "/a/b~1c": ("b/c", "/a", True), "/e": ("e", "", False)}
    rows = {r["path"]: r["cut"] for r in cutting.json_owners(docs, "j").collect()}
    assert rows["/a/b~1c/1/d"] is False and not any(rows.values())


def test_edits(spark):
    docs = spark.createDataFrame([(1, "häuser"), (2, "abc"), (3, "abc"), (4, "abc"), (5, "é")], "doc_id int, text string")
    edits = spark.createDataFrame([(1, 0, 3, "HÄ"), (1, 5, 5, "+"), (2, 0, 2, "x"), (2, 1, 3, "y"), (3, 1, 9, "z"), (5, 1, 2, "?")], "doc_id int, start_byte long, end_byte long, replacement string")
    got = {r["doc_id"]: (r["text"], r["error"]) for r in cutting.apply_edits(docs, edits).collect()}
    assert got == {1: ("HÄus+er", None), 2: (None, "overlap"), 3: (None, "range"), 4: ("abc", None), 5: (None, "char_boundary")}


def test_byte_lines_and_gap_removal(spark):
    docs = spark.createDataFrame([(1, "ä\nb\n")], "doc_id int, text string")
    assert [tuple(r)[1:] for r in cutting.doc_lines(docs).orderBy("line").collect()] == [(1, "ä", 0, 3), (2, "b", 3, 5)]
    lines = _lines(spark, "a\n\nb")
    owners = spark.createDataFrame([(1, "x", 1, 1), (1, "y", 3, 3)], "doc_id int, owner_id string, start_line int, end_line int")
    gone = spark.createDataFrame([(1, "y")], "doc_id int, owner_id string")
    assert cutting.blank_gaps(lines, owners).first()["controller"] == "y" and cutting.blank_gaps(lines, owners, gone).first()["controller"] == "x"


OWNERS = "case_id int, role string, owner_id string, path string, pos int, text string"


def _owners(spark, base, ours, theirs):
    rows = [(1, role, k, k, n, v) for role, part in (("base", base), ("ours", ours), ("theirs", theirs)) for n, (k, v) in enumerate(part.items())]
    return spark.createDataFrame(rows, OWNERS).withColumn("fingerprint", F.md5("text"))


def test_three_way_table(spark):
    base, ours, theirs = dict(a="1", b="1", c="1", d="1", e="1", f="1"), dict(a="1", b="2", c="2", d="1", f="2", g="9", h="8"), dict(a="1", b="1", c="3", e="5", f="2", g="7", i="4")
    got = {r["owner_id"]: r["decision"] for r in merging.three_way_classify(_owners(spark, base, ours, theirs)).collect()}
    assert got == dict(a="select_ours", b="select_ours", c="conflict_edit_edit", d="delete", e="conflict_delete_modify", f="select_ours", g="conflict_add_add", h="select_ours", i="select_theirs")


def test_merge_laws(spark):
    b, x = dict(a="1", b="2"), dict(b="3", a="1", c="4")
    merged = lambda o: merging.render_merged(o, merging.three_way_classify(o)).first()["output"]
    text = lambda d: "\n".join(d.values())
    assert merged(_owners(spark, b, x, b)) == text(x)
    assert merged(_owners(spark, b, x, x)) == text(x)
    assert sorted(merged(_owners(spark, b, b, x)).split("\n")) == sorted(x.values())
    o = _owners(spark, b, b, x)
    assert merging.whole_source(o).first()["whole_source"] == "theirs"
    assert merging.merge_preconditions(o, merging.three_way_classify(o)).first()["outcome"] == "clean"
    same = o.where("role = 'base'").drop("role")
    assert merging.owner_diff(same, same).count() == 0


def test_rendered_conflicts_are_found_again(spark):
    o = _owners(spark, dict(a="1", b="1"), dict(a="2"), dict(a="3", b="2"))
    rows = merging.render_conflicts(merging.three_way_classify(o)).collect()
    assert len(rows) == 2
    for r in rows:
        good, bad = cutting.conflict_regions(_byte_lines(spark, r["block"]))
        assert good.count() == 1 and not bad.count()


def test_segments_of_a_merge_verify(spark):
    o = _owners(spark, dict(a="1", b="zwei", c="3"), dict(b="zwei", a="ä9", c="3"), dict(a="1", b="zwei", d="neu"))
    d = merging.three_way_classify(o)
    output = merging.render_merged(o, d).first()["output"].encode()
    found = merging.merged_segments(o, d).orderBy("out_start").collect()
    assert [(r["segment_id"], r["revision"]) for r in found] == [("b", "ours"), ("a", "ours"), ("d", "theirs")]
    assert all(hashlib.sha256(output[r["out_start"] : r["out_end"]]).hexdigest() == r["sha256"] for r in found)
    # With the separators given to the segments before them, they cover the output.
    rows = [(1, r["segment_id"], bytearray(output), r["out_start"], min(r["out_end"] + 1, len(output))) for r in found]
    frame = spark.createDataFrame([(c, s, t, a, b, t, a, b, hashlib.sha256(t[a:b]).hexdigest()) for c, s, t, a, b in rows], "case_id int, segment_id string, src binary, src_start long, src_end long, out binary, out_start long, out_end long, sha256 string")
    assert merging.verify_byte_segments(frame).first()["error"] is None


def test_conflicts_laid_into_ours(spark):
    o = _owners(spark, dict(a="1", b="1", c="1"), dict(c="1", a="2"), dict(a="3", b="2", c="1", e="5"))
    row = merging.render_conflict_documents(o, merging.three_way_classify(o)).first()
    assert row["n_conflicts"] == 2 and row["output"] == "1\n<<<<<<< ours\n2\n||||||| base\n1\n=======\n3\n>>>>>>> theirs\n<<<<<<< ours\n||||||| base\n1\n=======\n2\n>>>>>>> theirs\n"


def test_identities(spark):
    node = "case_id int, pos int, primary array<string>, aliases array<array<string>>"
    t = spark.createDataFrame([(1, 0, ["f"], [["g"]]), (1, 1, ["g"], []), (1, 2, ["h"], [["old"]])], node)
    d = spark.createDataFrame([(1, 0, ["g"], []), (1, 1, ["old"], []), (1, 2, ["f"], [])], node)
    assert {(r["template_pos"], r["destination_pos"]) for r in merging.match_identities(t, d).collect()} == {(0, 2), (1, 0), (2, 1)}
    # The first signature with a free node wins over a later one whose node stands before it; null meets nothing.
    t = spark.createDataFrame([(1, 0, ["p"], [["x"], ["y"]]), (1, 1, None, [])], node)
    d = spark.createDataFrame([(1, 0, ["y"], []), (1, 1, ["x"], []), (1, 2, None, [])], node)
    assert {(r["template_pos"], r["destination_pos"]) for r in merging.match_identities(t, d).collect()} == {(0, 1)}


def test_owner_diff_numbers_from_zero(spark):
    node = "case_id int, owner_id string, path string, pos int, text string"
    before = spark.createDataFrame([(1, "a", "p", 0, "1"), (1, "b", "p", 1, "1"), (1, "c", "p", 2, "1"), (1, "d", "p", 3, "1")], node)
    after = spark.createDataFrame([(1, "n", "p", 0, "1"), (1, "d", "q", 1, "1"), (1, "b", "p", 2, "2"), (1, "a", "p", 3, "1")], node)
    rows = sorted(tuple(r)[1:] for r in merging.owner_diff(before, after).collect())
    assert rows == [("b", "edited", "change-0", "p", "p"), ("c", "deleted", "change-1", "p", None), ("d", "edited", "change-2", "p", "q"), ("n", "added", "change-3", None, "p")]


def test_refused_unions_stay(spark):
    node = "case_id int, parent_policy string, side string, pos int, node_id string, signature string"
    rows = spark.createDataFrame([(1, "commutative", "right", 0, "x", "s"), (1, "commutative", "base", 0, "y", "s"), (2, "ordered", "base", 0, "z", ""), (3, None, "base", 0, "w", "")], node)
    assert sorted((r["case_id"], r["node_id"], r["resolved"]) for r in merging.union_commutative_children(rows).collect()) == [(1, "y", True), (2, None, False), (3, None, False)]


@pytest.mark.parametrize(("a", "b", "same"), [("a\n", "a", True), ("a\n\n", "a\n", False), ("a \t\nb", "a\r\nb\r\n", True), ("a\rb", "a\nb", True), ("", "\n", False), ("", "", True), ("\na", "a", False)])
def test_agreement_of_lines(spark, a, b, same):
    rows = reports.score_agreement(spark.createDataFrame([(1, a, b)], "case_id int, expected string, output string"))
    assert rows.first()["normalized"] is same


def test_benchmark_outcomes_come_from_the_contract(spark):
    results = spark.createDataFrame([(1, 1, "clean"), (1, 2, "false_auto_merge"), (1, 3, "unsupported"), (1, 4, "odd")], "run_id int, case_id int, outcome string")
    known = spark.createDataFrame([("clean",), ("false_auto_merge",), ("unsupported",), ("conflict",)], "outcome string")
    cases = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False)], "case_id int, score_eligible boolean")
    rows = reports.benchmark_summary(results, known, cases).collect()
    assert {(r["outcome"], r["known"], r["n"]) for r in rows} == {("clean", True, 1), ("false_auto_merge", True, 1), ("unsupported", True, 1), ("conflict", True, 0), ("odd", False, 1)}
    assert {(r["eligible"], r["excluded"], r["false_auto_merges"], r["safety"]) for r in rows} == {(2, 1, 1, "fail")}


@pytest.mark.parametrize(
    ("sequences", "selected", "status", "ids"),
    [(["abc", "adc"], "abcd", "ordered", "abdc"), (["ab", "ba"], "ab", "incompatible_order", "ab"), (["aab"], "ab", "duplicate_identity", "a"), (["ab"], "aa", "duplicate_selection", "a"), (["abc"], "cxa", "ordered", "acx")],
)
def test_merge_order(spark, sequences, selected, status, ids):
    seq = spark.createDataFrame([(1, s, n, x) for s, part in enumerate(sequences) for n, x in enumerate(part)], "case_id int, sequence int, pos int, node_id string")
    row = merging.merge_order(seq, spark.createDataFrame([(1, n, x) for n, x in enumerate(selected)], "case_id int, pos int, node_id string")).first()
    assert (row["status"], "".join(row["node_ids"])) == (status, ids)


def test_archive_paths(spark):
    for path, normal, bad in (("a/../b", "b", False), ("../x", "x", True), ("/a", "a", True), ("a\\.\\b//c", "a/b/c", False), ("a/../../b", "b", True)):
        assert _one(spark, merging.normalize_archive_path(F.col("a")), a=path) == normal
        assert _one(spark, merging.escapes_root(F.col("a")), a=path) is bad


def test_byte_segments(spark):
    out = bytearray(b"abcdef")
    row = lambda case, k, s, e, digest=None: (case, f"s{k}", out, s, e, out, s, e, digest or hashlib.sha256(out[s:e]).hexdigest())
    rows = [row(1, 0, 0, 3), row(1, 1, 3, 6), row(2, 0, 0, 3), row(3, 0, 1, 6), row(4, 0, 0, 6, "0")]
    got = {r["case_id"]: r["error"] for r in merging.verify_byte_segments(spark.createDataFrame(rows, "case_id int, segment_id string, src binary, src_start long, src_end long, out binary, out_start long, out_end long, sha256 string")).collect()}
    assert got == {1: None, 2: "length", 3: "gap", 4: "digest"}


def test_paths(spark):
    assert _one(spark, paths.classify_path(F.col("a")), a="./x/CITATION.cff").family == "yaml"
    assert _one(spark, paths.classify_path(F.col("a")), a=".env.local").dialect == "dotenv"
    rows = [("java/o/r/c/h/Base.java",), ("java/o/r/c/h/Base.py",), ("java/o/../c/h/Base.java",), ("/java/o/r/c/h/Base.java",), ("java/o/r/c/h/Other.java",)]
    rows += [("x/./y//java/o/r/c/g/final_path",), ("java/o/r/c/h/deep/Base.java",), ("java/o/r/c/java",)]
    found = paths.locate_case(spark.createDataFrame(rows, "path string"), ["java"]).collect()
    assert sorted((r["case_id"], r["file"]) for r in found) == [("java/o/r/c/g", "final_path"), ("java/o/r/c/h", "Base")]


def test_corpus_round_trip(spark, tmp_path):
    for k in (1, 2):
        for f in paths.CASE_FILES[: 4 if k == 1 else 3]:
            p = tmp_path / f"tree/java/own/repo/c/h{k}/{f}.java"
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text(f * k)
    (tmp_path / "tree/java/own/repo/c/h1/file_name").write_text("Other.java")
    (tmp_path / "tree/java/own/repo/c/h1/final_path").write_text(" src/A.java\n")
    cases = corpus.read_case_corpus(corpus.read_file_tree(spark, str(tmp_path / "tree")), ["java"])
    row = cases.first()
    assert cases.count() == 1 and row["repository"] == "own/repo" and row["estimated_input_bytes"] == 13 and row["path_name"] == "src/A.java" and bytes(row["expected"]) == b"Expected"
    corpus.write_manifest(cases.withColumn("shard", F.lit(3)), str(tmp_path / "m"))
    assert corpus.read_manifest(spark, str(tmp_path / "m"), 3).count() == 1 and corpus.read_manifest(spark, str(tmp_path / "m"), 4).count() == 0
    assert corpus.pending_cases(cases, cases).count() == 0
    lines = spark.createDataFrame([('{"case_id":"a","status":"oversize"}',), ("{bad",), ('{"case_id":"b","status":"completed","own_artifact":"x","other_artifact":"y"}',), ('{"case_id":"c","status":"completed","own_artifact":"x","other_artifact":"z"}',)], "value string")
    valid, legacy = corpus.repair_results(lines, spark.createDataFrame([("x",), ("y",)], "path string"))
    assert {r["case_id"] for r in valid.collect()} == {"a", "b"} and {r["case_id"] for r in legacy.collect()} == {"c"}


def test_shards_keep_repositories(spark):
    cases = spark.createDataFrame([(k, f"r{k % 7}", None if k % 5 == 0 else k * 10) for k in range(50)], "case_id int, repository string, estimated_input_bytes int")
    told, loads = reports.assign_shards(cases, 3)
    assert told.groupBy("repository").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
    assert told.count() == 50 and loads.count() == 3
    # The others are dealt up to the mean: no shard is above it by more than one repository.
    many = spark.createDataFrame([(k, f"r{k}", 10 + k % 90) for k in range(600)], "case_id int, repository string, estimated_input_bytes int")
    told, loads = reports.assign_shards(many, 5, greedy_rows=20)
    costs = [r["load"] for r in loads.collect()]
    assert told.count() == 600 and len(costs) == 5 and max(costs) - sum(costs) / 5 <= 100


OBSERVED = "producer_id string, scope string, observation_id string, seq long, payload_digest string, revision_ref string, expected_prior string, projection string"
OBSERVATIONS = [("p", "s", "1", 1, "d", "r1", None, "x"), ("p", "s", "1", 2, "d", "r1", None, "x"), ("p", "s", "1", 3, "other", "r1", None, "x"), ("p", "s", "2", 4, "d", "r2", None, "x"), ("p", "s", "2", 5, "d", "r2", "r1", "x"), ("p", "s", "3", 6, "d", "r1", "r2", "y"), ("q", "s", "1", 7, "d", "r9", None, "x")]
EXPECTED = {1: "accepted", 2: "accepted", 3: "conflicting_retry", 4: "precondition", 5: "accepted", 6: "revision", 7: "accepted"}


def test_observations_in_batch_and_stream(spark, tmp_path):
    rows = spark.createDataFrame(OBSERVATIONS, OBSERVED)
    batch = {r["seq"]: r["decision"] for r in ingest.accept_observations(rows).collect()}
    assert batch == EXPECTED
    for k, part in enumerate((OBSERVATIONS[:3], OBSERVATIONS[3:5], OBSERVATIONS[5:])):
        spark.createDataFrame(part, OBSERVED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(OBSERVED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = observations.accept_observation_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r["seq"]: r["decision"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == EXPECTED


def test_incremental_merge_writes_once(spark, tmp_path):
    source, results, checkpoint = (str(tmp_path / x) for x in ("in", "out", "c"))
    spark.createDataFrame([("a", 1), ("b", 2)], "case_id string, v int").write.mode("append").json(source)
    run = lambda: observations.incremental_merge(spark.readStream.schema("case_id string, v int").json(source), lambda df: df, results, checkpoint).awaitTermination(120)
    run()
    spark.createDataFrame([("b", 9), ("c", 3)], "case_id string, v int").write.mode("append").json(source)
    run()
    assert sorted((r["case_id"], r["v"]) for r in spark.read.parquet(results).collect()) == [("a", 1), ("b", 2), ("c", 3)]


def test_plugins(spark):
    corpus.register_analyzer("t", lambda d: d.select("case_id", F.lit("o").alias("owner_id"), F.lit(0).cast("long").alias("start_byte"), F.octet_length("text").cast("long").alias("end_byte"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line")))
    docs = spark.createDataFrame([(1, "t", "abc"), (2, "t", ""), (3, "z", "x")], "case_id long, family string, text string")
    owners, faults = corpus.analyze(docs)
    assert [r["case_id"] for r in owners.collect()] == [1] and {(r["case_id"], r["violation"]) for r in faults.collect()} == {(2, "byte_range"), (3, "unknown_family")}
    corpus.register_handler("h", lambda d: d.select("case_id", F.lit(True).alias("resolved"), F.lit("x").alias("output"), F.lit(None).cast("string").alias("diagnostic")))
    got = {r["case_id"]: r["resolved"] for r in corpus.run_handlers(spark.createDataFrame([(1, "h"), (2, "none"), (3, None)], "case_id int, handler_id string")).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_lineage_and_deletions(spark):
    inv = "scope string, chunk_id string, content_hash string"
    prior, current = spark.createDataFrame([("s", "a", "1"), ("s", "b", "2")], inv), spark.createDataFrame([("s", "a", "2"), ("s", "b", "1"), ("s", "c", "3")], inv)
    prior, current = (df.withColumn("ordinal", F.lit(0).cast("long")) for df in (prior, current))
    at = lambda *names, n=0: [(x, n) for x in names]
    row = lambda kind="move", p=at("a"), c=at("a"), status="asserted", basis="authored", authority="A", algorithm=None, version=None, confidence=1.0: (kind, status, p, c, basis, authority, algorithm, version, confidence)
    cases = [
        (row("reorder", at("a", "b"), at("b", "a")), None), (row("reorder", at("a"), at("c")), "reorder_changes_content"), (row("reorder", at("a"), at("c"), status="ambiguous"), None), (row("split", at("z"), at("a")), "unknown_prior"),
        (row("split", at("z"), at("a"), status="unknown"), None), (row("join", at("a"), at("a", n=1)), "unknown_current"), (row("copy", at("a", n=1)), "unknown_prior"), (row("move", []), "empty_side"), (row("move", [], status="unknown"), None),
        (row("merge"), "kind"), (row("rename"), "kind"), (row(None), "kind"), (row(status="sure"), "status"), (row(p=at("")), "reference"), (row(c=[("a", -1)]), "reference"), (row(p=None), "reference"), (row(confidence=2.0), "confidence"),
        (row(confidence=None), None), (row(confidence=float("nan")), "confidence"), (row(authority=None), "provenance"), (row(algorithm="x", version="1"), "provenance"), (row(basis="algorithmic"), "provenance"),
        (row(basis="algorithmic", authority=None, algorithm="x", version="1"), None), (row(basis="algorithmic", authority=None, algorithm="x"), "provenance"), (row(basis="unknown", authority=None), None), (row(basis="unknown"), "provenance"), (row(basis="guess"), "provenance"),
    ]
    shape = "scope string, assertion_id string, kind string, status string, prior_refs array<struct<chunk_id:string,ordinal:bigint>>, current_refs array<struct<chunk_id:string,ordinal:bigint>>, basis string, authority_ref string, algorithm_id string, algorithm_version string, confidence double"
    told = ingest.check_lineage(spark.createDataFrame([("s", str(k), *r) for k, (r, _) in enumerate(cases)], shape), prior, current)
    assert {int(r["assertion_id"]): r["code"] for r in told.collect()} == dict(enumerate(c for _, c in cases))
    delta = ingest.inventory_delta(prior, current)
    assert {(r["chunk_id"], r["change"]) for r in delta.collect()} == {("a", "updated"), ("b", "updated"), ("c", "added")}
    declared = spark.createDataFrame([("s", "a", "updated"), ("s", "c", "removed"), ("s", "q", "added")], "scope string, chunk_id string, change string")
    assert {(r["chunk_id"], r["code"]) for r in ingest.check_delta(declared, delta).collect()} == {("c", "wrong_change"), ("q", "unchanged_or_unknown")}
    req = "producer_id string, scope string, mode string, authority_ref string, scan_complete boolean"
    requests = spark.createDataFrame([("p", "s", "absence", "A", True), ("p", "s", "explicit_source", "A", True)], req)
    authorities = spark.createDataFrame([("A", "p", "s", "absence")], "authority_ref string, producer_id string, scope string, mode string")
    removed = spark.createDataFrame([("s", "b")], "scope string, chunk_id string")
    assert [r["chunk_id"] for r in ingest.authorize_deletions(requests, authorities, removed, prior).collect()] == ["b"]
    shared = spark.createDataFrame([("p", "s", "b"), ("q", "s", "x")], "producer_id string, scope string, chunk_id string")
    assert [r["chunk_id"] for r in ingest.authorize_deletions(requests, authorities, shared, prior).collect()] == ["b"]  # not q's


def test_deletions_are_decided_as_a_whole(spark):
    """Each case: mode, status, targets, removed, prior, current, its authority's (producer, scope, mode, finalization, targets), code."""
    grant = lambda mode="absence", targets=("b",), producer="p", scope="s", final="f": (producer, scope, mode, final, targets)
    cases = [
        ("absence", "complete", "b", "b", "ab", "a", grant(), None), ("absence", "partial", "b", "b", "ab", "a", grant(), "deletion"), ("absence", "complete", "b", "bc", "abc", "a", grant(), "deletion"), ("absence", "complete", "bz", "bz", "ab", "a", grant(targets="bz"), "deletion"),
        ("absence", "complete", "b", "b", "ab", "a", grant(targets="ab"), "authority"), ("absence", "complete", "b", "b", "ab", "a", grant(targets="c"), "authority"), ("absence", "complete", "b", "b", "ab", "a", grant(producer="q"), "authority"), ("absence", "complete", "b", "b", "ab", "a", grant(scope="r"), "authority"),
        ("absence", "complete", "b", "b", "ab", "a", grant("explicit_source"), "authority"), ("absence", "complete", "b", "b", "ab", "a", grant(final=None), "authority"), ("absence", "complete", "b", "b", "ab", "a", None, "authority"), ("absence", "complete", "", "", "ab", "ab", grant(targets=""), None),
        ("explicit_source", "partial", "ab", "ab", "ab", "", grant("explicit_source", "ab"), None), ("explicit_source", "complete", "ab", "a", "ab", "b", grant("explicit_source", "ab"), "deletion"), ("explicit_source", "complete", "a", "ab", "ab", "", grant("explicit_source", "a"), "deletion"),
        ("none", "complete", "", "b", "ab", "a", None, None), ("none", "complete", "b", "b", "ab", "a", None, "deletion"), ("odd", "complete", "", "", "", "", None, "deletion"), (None, "complete", "", "", "", "", None, "deletion"),
    ]
    key = "producer_id string, scope string, observation_id int, "
    each = lambda k: spark.createDataFrame([("p", "s", n, c) for n, case in enumerate(cases) for c in (*case[k], *case[k][:1])], key + "chunk_id string")  # noqa: E731  one of them twice
    observations = spark.createDataFrame([("p", "s", n, c[0], f"A{n}" if c[0] not in ("none", None) else None, c[1], "f") for n, c in enumerate(cases)], key + "mode string, authority_ref string, status string, finalization_ref string")
    authorities = spark.createDataFrame([(f"A{n}", *c[6][:4]) for n, c in enumerate(cases) if c[6]], "authority_ref string, producer_id string, scope string, mode string, finalization_ref string")
    granted = spark.createDataFrame([(f"A{n}", x) for n, c in enumerate(cases) if c[6] for x in c[6][4]], "authority_ref string, chunk_id string")
    decided = ingest.decide_deletions(observations, each(2), each(3), each(4), each(5), authorities, granted)
    assert {r["observation_id"]: r["code"] for r in decided.collect()} == {n: c[7] for n, c in enumerate(cases)}
    dead = {(r["observation_id"], r["chunk_id"], r["authority_ref"]) for r in ingest.tombstones(decided, each(2)).collect()}
    assert dead == {(0, "b", "A0"), (12, "a", "A12"), (12, "b", "A12")}


def test_child_outputs_by_number_and_edits_without_a_place(spark):
    text = "".join(f"```go\n{k}\n```\n" for k in range(2)) + "end\n"
    lines = cutting.doc_lines(spark.createDataFrame([(1, text), (2, text.rstrip("\n"))], "doc_id int, text string"))
    operations = cutting.embedded_surfaces(lines)
    address = "document[0] > fenced_code_block[/code_fence/1]"
    outputs = spark.createDataFrame([(d, k, address, f"out {k}") for d in (1, 2) for k in (9, 10, 2)], "doc_id int, output_index int, address string, output string")
    plan, errors = cutting.resolve_child_outputs(operations, outputs)
    got = {r["doc_id"]: r["text"] for r in cutting.apply_child_outputs(lines, plan).collect()}
    assert errors.count() == 0 and got[1] == "```go\n0\n```\n```go\nout 10\n```\nend\n" and got[2] == got[1].rstrip("\n")
    docs = spark.createDataFrame([(1, "abc"), (2, "abc")], "doc_id int, text string")
    edits = spark.createDataFrame([(1, None, 1, "x"), (2, 0, None, "x")], "doc_id int, start_byte long, end_byte long, replacement string")
    assert [(r["text"], r["error"]) for r in cutting.apply_edits(docs, edits).collect()] == [(None, "range")] * 2


def test_sequence_changes(spark):
    schema = "case_id int, owner_id string, fingerprint string, pos int"
    side = lambda names: spark.createDataFrame([(1, n[0], n, i) for i, n in enumerate(names)], schema)
    found = lambda a, b: {(r["owner_id"], r["kind"]) for r in merging.sequence_changes(side(a), side(b)).collect()}
    assert found(["a", "b", "c"], ["a", "b", "c"]) == set()
    assert found(["a", "b", "c"], ["a", "b2", "x"]) == {("b", "modify"), ("c", "delete"), ("x", "insert")}
    assert found(["a", "b", "c", "d"], ["b", "a", "c", "d"]) == {("a", "move"), ("b", "move"), ("c", "move")}
    assert found(["a"], ["x", "a"]) == {("x", "insert")}
    assert found([], []) == set()


def test_registered_names_have_sql_of_known_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_structural_matches_reports_repeated_bodies(spark):
    nodes = "case_id int, signature string, parent string, pos int, body_hash string"
    before = spark.createDataFrame([(1, "a", "r", 0, "x"), (1, "b", "r", 1, "x"), (1, "c", "r", 2, "y"), (1, "d", "r", 3, "z"), (1, "e", "r", 4, "lone")], nodes)
    after = spark.createDataFrame([(1, "p", "r", 0, "x"), (1, "q", "r", 1, "y"), (1, "s", "r", 2, "y"), (1, "t", "r", 3, "z")], nodes)
    got = {(r["signature"], r["to_signature"], r["kind"], r["before_candidates"], r["after_candidates"]) for r in merging.structural_matches(before, after).collect()}
    assert got == {("a", None, "ambiguous", 2, 1), ("b", None, "ambiguous", 2, 1), ("c", None, "ambiguous", 1, 2), ("d", "t", "rename", None, None)}


JSON3 = "doc_id int, base string, ours string, theirs string"


@pytest.mark.parametrize(
    ("base", "ours", "theirs", "outcome", "output", "conflicts"),
    [
        ('{"a":1}', '{"a":2}', '{"a":3}', "conflict", None, {("/a", "modify_modify")}),
        ('{"a":1,"b":2}', '{"a":3,"b":2}', '{"a":1,"b":4}', "clean", '{"a":3,"b":4}', set()),
        ('{"x":1}', '{"x":1}', '{"x":"é"}', "clean", '{"x":"é"}', set()),
        ('{"a":1,"b":1}', '{"b":2}', '{"a":1,"b":1,"c":0}', "clean", '{"b":2,"c":0}', set()),
        ('{"a":1,"b":1}', '{"a":1,"b":2}', '{"b":1}', "conflict", None, {("/a", "delete_requires_owner_edit")}),
        ('{"a":1,"b":1}', '{"a":2,"b":1}', '{"b":3}', "conflict", None, {("/a", "ambiguous_owner_change")}),
        ('{"a":[1]}', '{"a":[2]}', '{"a":[3]}', "conflict", None, {("/a/0", "modify_modify")}),  # aligned by place
        ('{"a":[1,2]}', '{"a":[2]}', '{"a":[1,2,3]}', "conflict", None, {("/a", "atomic_array_edit")}),  # no element in conflict
        ('{"a":[{"id":1,"v":1},{"id":2,"v":1}]}', '{"a":[{"id":2,"v":2}]}', '{"a":[{"id":1,"v":1},{"id":2,"v":3}]}', "conflict", None, {("/a/1", "modify_modify")}),
        ('{"a":[{"id":1,"v":1},2]}', '{"a":[2]}', '{"a":[2,{"v":9,"id":1}]}', "conflict", None, {("/a/0", "delete_modify")}),
        ('{"a":[1]}', '{"a":[1,{"id":"n","v":1}]}', '{"a":[{"id":"n","v":2},1]}', "conflict", None, {("/a", "duplicate_insertion")}),
        ('{"a":[1,2,3]}', '{"a":[3,2,1]}', '{"a":[2,1,3]}', "conflict", None, {("/a", "order")}),
        ('{"a":[1,2,3]}', '{"a":[3,2,1]}', '{"a":[3,2,1,4]}', "conflict", None, {("/a", "atomic_array_edit")}),  # turned alike
        ('{"a":[{"id":null,"v":1},{"id":[1],"v":1}]}', '{"a":[{"id":null,"v":2},{"id":[1],"v":2}]}', '{"a":[{"id":null,"v":3},{"id":[1],"v":3}]}', "conflict", None, {("/a/0", "modify_modify"), ("/a/1", "modify_modify")}),
        ('{"a":[]}', '{"a":[1]}', '{"a":[2]}', "conflict", None, {("/a", "duplicate_insertion")}),
        ('{"a":{"b":[[1],null]}}', '{"a":{"b":[[2],null]}}', '{"a":{"b":[[3],null]}}', "conflict", None, {("/a/b/0", "modify_modify")}),
        ('{"a/b":{"c":1,"d":1}}', '{"a/b":{"c":2,"d":1}}', '{"a/b":{"c":1,"d":3}}', "clean", '{"a/b":{"c":2,"d":3}}', set()),
        ('{"a":1,"a":2}', "{}", "{}", "error", None, set()),
        ("{}", '{"n":1}', '{"n":2}', "conflict", None, {("/n", "ambiguous_owner_change")}),
    ],
)
def test_json_three_way(spark, base, ours, theirs, outcome, output, conflicts):
    rows = documents.merge_json_three_way(spark.createDataFrame([(1, base, ours, theirs)], JSON3))
    told = documents.json_texts(rows).first()
    assert (told["outcome"], told["output"]) == (outcome, output)
    assert {(r["path"], r["category"]) for r in rows.where("kind = 'conflict'").collect()} == conflicts


def test_json_laws_and_depth(spark):
    b, x = '{"a":{"b":{"c":1}},"d":[1]}', '{"a":{"b":{"c":2}},"e":null}'
    merged = lambda *v: documents.json_texts(documents.merge_json_three_way(spark.createDataFrame([(1, *v)], JSON3))).first()["output"]
    canon = lambda v: spark.createDataFrame([(v,)], "v string").selectExpr("to_json(try_parse_json(v)) AS v").first()["v"]
    assert merged(b, x, b) == merged(b, b, x) == merged(b, x, x) == canon(x)
    deep = documents.merge_json_three_way(spark.createDataFrame([(1, b, x, '{"a":{"b":{"c":3}}}')], JSON3), max_depth=1)
    assert ("/a", "cut") in {(r["path"], r["kind"]) for r in deep.collect()}


def test_json_two_way(spark):
    docs = spark.createDataFrame([(1, '{"a":{"x":1,"y":[1]},"b":2,"t":0}', '{"a":{"y":[2],"z":{}},"b":{}}'), (2, "[1]", '{"a":1}'), (3, "{}", "{}")], "doc_id int, t string, d string")
    rows = documents.merge_mapping_two_way(docs, "t", "d")
    assert {r["doc_id"]: r["output"] for r in documents.json_texts(rows).collect()} == {1: '{"a":{"x":1,"y":[2],"z":{}},"b":{},"t":0}', 2: '{"a":1}', 3: "{}"}


def _blocks(spark, text, case=1):
    rows = cutting.text_blocks(spark.createDataFrame([(case, text)], "doc_id int, text string"))
    return rows.select(F.col("doc_id").alias("case_id"), "index", "normalized")


def test_plain_text_merge(spark):
    t, d = _blocks(spark, "Alpha\n\nBeta\n\nAlpha\n\nTemplate only"), _blocks(spark, "Beta\n\nAlpha revised\n\nAlpha\n\nDestination only")
    assert documents.merge_text(t, d).first()["output"] == "Beta\n\nAlpha revised\n\nAlpha\n\nDestination only\n\nAlpha\n\nTemplate only"


def test_text_matching_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9)))
    t = [" ".join(word() for _ in range(rng.randrange(1, 9))) for _ in range(14)]
    d = [x if k % 4 == 0 else "".join(c if rng.random() > 0.12 else rng.choice("abcde") for c in x) for k, x in enumerate(rng.sample(t, 12))]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    def score(a, b, i, j):
        content, length = 1 - distance(a, b) / max(len(a), len(b)), min(len(a), len(b)) / max(len(a), len(b))
        return 0.7 * content + 0.15 * length + 0.15 * (1 - abs(i / (len(t) - 1) - j / (len(d) - 1)))

    used, want = set(), {}
    for j, y in enumerate(d):
        if (i := next((i for i, x in enumerate(t) if i not in used and x == y), None)) is not None:
            used.add(i)
            want[j] = i
    for j, y in enumerate(d):
        if j not in want:
            best = max(((score(x, y, i, j), -i) for i, x in enumerate(t) if i not in used), default=(0, 0))
            if best[0] >= 0.7:
                used.add(-best[1])
                want[j] = -best[1]
    frame = lambda part: spark.createDataFrame([(1, k, x) for k, x in enumerate(part)], "case_id int, index int, normalized string")
    got = {r["destination_index"]: r["template_index"] for r in documents.match_text(frame(t), frame(d)).collect()}
    assert got == want and len(want) > 8


def test_match_text_counts_edits_of_likely_pairs_only(monkeypatch):
    """Edited blocks of one made-up language: any two are near enough in size and signs, few need their edits counted."""
    import random

    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("etaoinshrl", k=5)) for _ in range(30)) for _ in range(80)]
    side = lambda blocks: documents._Side([{"index": k, "text": x} for k, x in enumerate(blocks)], len(blocks))
    calls, edits = [], documents._edits
    monkeypatch.setattr(documents, "_edits", lambda *given: calls.append(1) or edits(*given))
    got = documents._best_pairs(side(texts), side([f"New {x}" for x in reversed(texts)]), 0.7)
    assert {(p["template_index"], p["destination_index"]) for p in got} == {(k, 79 - k) for k in range(80)}
    assert len(calls) <= 1600  # of 3240 pairs of free blocks


def test_edit_distance_up_to_a_bound():
    import random

    def whole(a, b):
        above = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row = [i + 1]
            for j, y in enumerate(b):
                row.append(min(row[-1] + 1, above[j + 1] + 1, above[j] + (x != y)))
            above = row
        return above[-1]

    rng = random.Random(5)
    for _ in range(2000):
        a, b, most = "".join(rng.choices("abé", k=rng.randrange(12))), "".join(rng.choices("abé", k=rng.randrange(12))), rng.randrange(12)
        found = whole(a, b)
        assert documents._edits(a, b, most) == (found if found <= most else None)


@pytest.mark.parametrize(
    ("base", "ours", "theirs", "why", "output"),
    [
        ("# a\n1\n# b\n1", "# a\n2\n# b\n1", "# a\n1\n# b\n1\n# c\n3", "merged", "# a\n2\n# b\n1\n# c\n3"),
        ("# a\n1", "# a\n2", "# a\n3", "section", None),
        ("# a\n1\n# b\n1", "# b\n1\n# a\n2", "# a\n1\n# b\n3", "order", None),
        ("# a\n1\n# b\n1", "# a\n2", "# a\n1\n# b\n1\n# c\n1", "merged", "# a\n2\n# c\n1"),
        ("# a\n1", "# a\n1", "# x\n1", "whole_source_theirs", "# x\n1"),
        ("# a\n1", "text", "# x\n1", "no_headings", None),
    ],
)
def test_markdown_three_way(spark, base, ours, theirs, why, output):
    rows = [(1, role, k, t) for role, text in (("base", base), ("ours", ours), ("theirs", theirs)) for k, t in enumerate(text.split("\n"), 1)]
    row = documents.merge_markdown_three_way(spark.createDataFrame(rows, "case_id int, role string, line int, text string")).first()
    assert (row["why"], row["output"]) == (why, output)


@pytest.mark.parametrize(
    ("text", "shape", "keys"),
    [
        ("{A|B:C} {A} {A|} {A|B|C} {A|B:C}", cutting.TokenShape(), ["A|B:C"]),
        ("<<a.b>> <<a>> <<a.b.c>>", cutting.TokenShape("<<", ">>", (".",), 1, 2, "[a-z]"), ["a.b", "a"]),
        ("{x {A|B} {C|D", cutting.TokenShape(), []),
        ("{A|b} {A|b:c:d}", cutting.TokenShape(min_segments=3), ["A|b:c:d"]),
        ("", cutting.TokenShape(), []),
    ],
)
def test_token_keys(spark, text, shape, keys):
    assert _one(spark, cutting.token_keys(F.col("a"), shape), a=text) == keys


def test_sequence_conflicts(spark):
    schema = "case_id int, owner_id string, fingerprint string, pos int"
    side = lambda names: spark.createDataFrame([(1, n[0], n, i) for i, n in enumerate(names)], schema)
    found = lambda b, o, t: {(r["category"], r["owner_id"]) for r in merging.sequence_conflicts(side(b), side(o), side(t)).collect()}
    assert found(["a", "b"], ["a2", "b"], ["b"]) == {("delete_modify", "a")}
    assert found(["a", "b"], ["a2", "b"], ["a3", "b"]) == {("modify_modify", "a")}
    assert found(["a"], ["a", "x1"], ["a", "x2"]) == {("duplicate_insertion", "x")}
    assert found(["a", "b", "c"], ["b", "a", "c"], ["a", "c", "b"]) == {("order", None)}
    assert found(["a", "b", "c"], ["b", "a", "c"], ["b", "a", "c"]) == set()
    assert found(["a", "b", "c"], ["b", "a", "c"], ["a", "b", "c"]) == set()


@pytest.mark.parametrize(
    ("change", "code"),
    [
        ({}, None), ({"extra": 1}, "fields"), ({"scan": None}, None), ({"revision_parents": ["a", "a"]}, "ancestry"), ({"revision_parents": ["r"]}, "ancestry"), ({"revision_parents": [1]}, "ancestry"), ({"revision_parents": "a"}, "ancestry"),
        ({"revision_parents": [], "expected_prior_revision_ref": "a"}, "ancestry"), ({"revision_parents": ["a", "b"], "expected_prior_revision_ref": "b"}, None), ({"revision_parents": ["a"], "expected_prior_revision_ref": "r"}, None),
        ({"revision_parents": ["a"], "expected_prior_revision_ref": "c"}, "ancestry"), ({"source_time_start": "2024-01-01T00:00:00Z"}, "time"), ({"source_time_start": 1, "source_time_end": 2}, "time"),
        ({"source_time_start": "2024-01-01T00:00:00Z", "source_time_end": "2024-01-01T00:00:00Z"}, None), ({"drop": "scan"}, "fields"), ({"raw": "[]"}, "fields"), ({"raw": '{"a":1,"a":2}'}, "json"), ({"raw": "x"}, "json"),
    ],
)
def test_envelopes(spark, change, code):
    import json

    payload = dict.fromkeys(ingest.REQUIRED_FIELDS) | {"revision_ref": "r"} | {k: v for k, v in change.items() if k not in ("drop", "raw")}
    payload.pop(change.get("drop"), None)
    text = change.get("raw") or json.dumps(payload)
    rows = spark.createDataFrame([(1, "v", text, hashlib.sha256(text.encode()).hexdigest()), (2, "v", text, "0"), (3, None, text, "0")], "observation_key int, schema string, payload_json string, payload_digest string")
    got = {r["observation_key"]: r["code"] for r in ingest.check_envelope(rows, "v").collect()}
    assert got == {1: code, 2: "payload_digest", 3: "schema"}


@pytest.mark.parametrize(
    ("base", "ours", "theirs", "selected", "status", "ids"),
    [
        ("abc", "abc", "abc", "abc", "ordered", "abc"),
        ("abc", "acb", "abc", "abc", "ordered", "acb"),
        ("abc", "axbc", "abyc", "abcxy", "ordered", "axbyc"),
        ("ab", "xab", "aby", "abxy", "ordered", "xaby"),
        ("abc", "abc", "ac", "ac", "ordered", "ac"),
        ("ab", "axyb", "ayxb", "abxy", "cycle", ""),
        ("", "a", "a", "a", "unsupported", ""),
        ("ab", "ab", "ab", "abz", "unsupported", ""),
        ("aab", "ab", "ab", "ab", "unsupported", ""),
    ],
)
def test_merge_owner_order(spark, base, ours, theirs, selected, status, ids):
    owners = [(1, role, k, x) for role, part in (("base", base), ("ours", ours), ("theirs", theirs)) for k, x in enumerate(part)]
    rows = merging.merge_owner_order(spark.createDataFrame(owners, "case_id int, role string, pos int, owner_id string"), spark.createDataFrame([(1, x) for x in selected], "case_id int, owner_id string"))
    row = rows.first()
    assert (row["status"], "".join(row["owner_ids"])) == (status, ids)


def test_pairwise_order_against_all_pairs():
    """The order of a tournament of pairs, or none, as found by comparing all pairs."""
    import random

    rng, seen = random.Random(9), set()
    for _ in range(3000):
        base, tips = list("abcdef")[: rng.randrange(7)], []
        for _ in range(2):
            tip = base[:: rng.choice((1, 1, -1))]
            for _ in range(rng.randrange(3) if base else 0):
                tip.insert(rng.randrange(len(tip)), tip.pop(rng.randrange(len(tip))))
            tips.append({x: k for k, x in enumerate(tip)})
        wins = dict.fromkeys(base, 0)
        for k, x in enumerate(base):
            for y in base[k + 1 :]:
                wins[x if all(t[x] < t[y] for t in tips) else y] += 1
        want = sorted(base, key=wins.__getitem__, reverse=True) if sorted(wins.values()) == list(range(len(base))) else None
        assert merging._pairwise_order(base, *tips) == want
        seen.add(want is None)
    assert seen == {True, False}


def test_orders_of_large_cases_list_no_pairs():
    """A case of 20,000 owners that a tip turned around, and 20,000 nodes that were selected twice."""
    import time

    ids, began = [str(k) for k in range(20_000)], time.process_time()
    assert merging._owner_order(ids, ids[::-1], ids, ids) == {"status": "ordered", "owner_ids": ids[::-1]}
    assert merging._node_order(ids * 2, [])["status"] == "duplicate_selection"
    assert time.process_time() - began < 15


def test_text_similarity_query_cuts_each_text_once(spark, tmp_path):
    """Blocks of a text are cut in one place of the plan for each side of a pair."""
    from ownerloom.jobs import texts

    spark.createDataFrame([(k, f"a b c {k}.\nd e") for k in range(4)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = texts.text_similarity(spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 4  # blocks and words of two sides
    assert [r["score"] for r in df.orderBy("doc_id").collect()] == [0.8] * 3


def test_deletion_query_joins_lines_once(spark, tmp_path):
    """What is known of orders' lines is one written table, read by all sets and by both uses of the decisions."""
    from ownerloom.jobs import evaluation

    spark.range(40).selectExpr("id AS o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(120).selectExpr("id div 3 AS l_orderkey", "cast(id % 3 + 1 AS int) AS l_linenumber").write.parquet(str(tmp_path / "lineitem.parquet"))
    df = evaluation.decide_deletions(spark, str(tmp_path))
    assert not [f for f in df.inputFiles() if f"{tmp_path}/lineitem.parquet" in f] and df.count() == 40


def test_keyed_members_have_a_bounded_number_of_rows_a_task(spark, monkeypatch):
    from ownerloom.operators import merging
    from ownerloom.sources import scratch

    monkeypatch.setattr(scratch, "ROWS_A_TASK", 10)
    members = spark.range(400).selectExpr("id div 4 AS case_id", "if(id % 4 < 2, 'base', 'left') AS side", "id % 4 AS pos", "cast(id % 2 as string) AS key", "cast(id % 4 as string) AS value")
    rows = merging.merge_keyed_members(members)
    assert rows.rdd.getNumPartitions() >= 40
    assert {(r.key, r.value, r["rank"], r.resolved) for r in rows.collect()} == {("0", "2", 0, True), ("1", "3", 1, True)} and rows.count() == 200


def test_json_merge_sends_no_table_through_the_driver(spark, monkeypatch):
    """Tables between steps pack well, so Spark takes them for small at sizes at which their rows fill the driver."""
    from ownerloom.jobs import documents as queries

    first_plans, written = [], documents.written

    def noted(df, label):
        first_plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return written(df, label)

    monkeypatch.setattr(documents, "written", noted)
    noted(queries.merge_json_three_way(spark, "/root/testdata/sf0.001"), "result")
    assert {"array-to-o", "array-to-t", "json-arrays", "result"} <= {label for label, plan in first_plans if "SortMergeJoin" in plan}
    assert [label for label, plan in first_plans if "Broadcast" in plan] == []
