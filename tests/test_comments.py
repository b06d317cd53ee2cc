"""Comment attachment, gaps and line dispositions: known cases and a walk over lines in plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ownerloom.operators import comments

LINES = "doc_id int, line int, text string"
OWNERS = "doc_id int, owner_id string, start_line int, end_line int, indent int"
COMMENTS = "doc_id int, line int, full_line boolean, indent int, root_scope boolean, structural_prefix boolean"
REGIONS = "doc_id int, region_id string, kind string, owner_id string, selection_key string, start_line int, end_line int"
GAPS = "doc_id int, gap_id string, kind string, start_line int, end_line int, before_owner string, after_owner string, controller_side string, controller string, selection_key string"


def frames(spark, docs):
    """docs: id -> (source, owners, comments); comments are (line, full_line, indent, root_scope, structural_prefix)."""
    lines = [(d, k, t) for d, (source, _, _) in docs.items() for k, t in enumerate(source.removesuffix("\n").split("\n"), 1)]
    owners = [(d, *o) for d, (_, own, _) in docs.items() for o in own]
    notes = [(d, *c) for d, (_, _, cs) in docs.items() for c in cs]
    return spark.createDataFrame(lines, LINES).repartition(3), spark.createDataFrame(owners, OWNERS), spark.createDataFrame(notes, COMMENTS)


def plain(line, full=True, indent=0, root=False, prefix=False):
    return (line, full, indent, root, prefix)


KNOWN = {
    1: ("# header\n\nalpha() # inline alpha\n\nbeta()\n# footer\n", [("alpha", 3, 3, 0), ("beta", 5, 5, 0)], [plain(1), plain(3, False), plain(6)]),
    2: ("alpha()\nunknown syntax\n", [("alpha", 1, 1, 0)], []),
    3: ("# orphan\n\nunknown syntax\n", [], [plain(1)]),
    4: ("alpha()\n\n\n# beta docs\nbeta()\n", [("alpha", 1, 1, 0), ("beta", 5, 5, 0)], [plain(4)]),
    5: ('extern "C" {\n    // nested comment\n}\nfn value() {}\n', [("foreign", 1, 3, 0), ("value", 4, 4, 0)], [plain(2, root=True)]),
    6: ("// Retiring owner.\n\n/// Following owner.\nfn following() {}\n", [("following", 4, 4, 0)], [plain(1), plain(3)]),
}
KNOWN_LINES = {
    1: ["root:preamble", "gap:preamble:root:alpha", "owner:alpha", "gap:interstitial:alpha:beta", "owner:beta", "comment:beta:trailing"],
    2: ["owner:alpha", "unmanaged:2"],
    3: ["root:orphan:0", "unmanaged:2", "unmanaged:3"],
    4: ["owner:alpha", "gap:interstitial:alpha:beta", "gap:interstitial:alpha:beta", "comment:beta:leading", "owner:beta"],
    5: ["owner:foreign", "owner:foreign", "owner:foreign", "owner:value"],
    6: ["root:preamble", "gap:preamble:root:following", "comment:following:leading", "owner:following"],
}


def test_known_documents_have_one_disposition_a_line(spark):
    lines, owners, notes = frames(spark, KNOWN)
    regions = comments.regions_in_owners(comments.attach_comments(lines, owners, notes), owners)
    gaps = comments.edge_gaps(lines, owners, regions)
    rows, errors = comments.line_dispositions(lines, owners, regions, gaps)
    assert errors.collect() == []
    got = {}
    for r in sorted(rows.collect(), key=lambda r: (r["doc_id"], r["line"])):
        got.setdefault(r["doc_id"], []).append(r)
    assert {d: [r["selection_key"] for r in v] for d, v in got.items()} == KNOWN_LINES
    assert [r["kind"] for r in got[1]] == ["root_region", "layout_gap", "structural_owner", "layout_gap", "structural_owner", "comment_owner"]
    inline = got[1][2]
    assert (inline["region_ids"], inline["comment_kind"], inline["owner_id"]) == (["comment-region:inline:3-3"], "inline", "alpha")
    assert (got[1][0]["root_kind"], got[1][0]["region_ids"], got[1][0]["owner_id"]) == ("preamble", ["comment-region:preamble:1-1"], None)
    assert (got[4][1]["controller"], got[4][1]["gap_id"]) == ("alpha", "layout-gap:2-3")
    assert (got[5][1]["root_kind"], got[5][1]["owner_id"], got[5][1]["region_ids"]) == ("orphan", "foreign", ["comment-region:orphan:2-2"])


def test_an_attached_comment_inside_another_owner_is_given_to_it(spark):
    lines, owners, _ = frames(spark, {1: KNOWN[5]})
    region = spark.createDataFrame([(1, "nested-comment", "leading", "value", "comment:value:leading", 2, 2)], REGIONS)
    moved = comments.regions_in_owners(region, owners)
    assert moved.select("owner_id", "selection_key").first() == ("foreign", "comment:foreign:leading")
    rows, errors = comments.line_dispositions(lines, owners, moved, spark.createDataFrame([], GAPS))
    nested = rows.where("line = 2").first()
    assert errors.count() == 0 and (nested["kind"], nested["owner_id"], nested["region_ids"]) == ("structural_owner", "foreign", ["nested-comment"])
    # Told as it came, it is a conflict, and the document has no dispositions.
    rows, errors = comments.line_dispositions(lines, owners, region, spark.createDataFrame([], GAPS))
    assert rows.count() == 0 and [tuple(r) for r in errors.collect()] == [(1, "region_conflict", "2")]


def test_every_fault_is_told_and_voids_its_document(spark):
    docs = {d: ("a\n\nb\nc\n", [("x", 1, 1, None), ("y", 3, 4, None)], []) for d in range(1, 16)}
    lines, owners, _ = frames(spark, docs)
    more = [(1, "x", 2, 2, None), (2, "z", 4, 4, None), (3, "z", 4, 9, None), (3, "", 2, 2, None)]
    owners = owners.unionByName(spark.createDataFrame(more, OWNERS))
    region = lambda d, name, kind, owner, s, e: (d, name, kind, owner, "k", s, e)
    regions = [region(4, "r", "leading", "nobody", 2, 2), region(5, "r", "preamble", "x", 1, 1), region(6, "r", "leading", "y", 1, 1), region(7, "r", "orphan", None, 2, 3), region(8, "r", "orphan", None, 2, 2), region(8, "q", "preamble", None, 2, 2)]
    regions += [region(9, "r", "inline", "y", 3, 3), region(9, "q", "leading", "y", 3, 3), region(10, "r", "inline", "x", 0, 1), region(15, "r", "orphan", None, 3, 4)]
    gap = lambda d, kind, s, e, before, after, side, controller: (d, f"g{s}", kind, s, e, before, after, side, controller, "k")
    gaps = [gap(11, "interstitial", 2, 2, "x", "y", "before", "y"), gap(12, "preamble", 2, 3, None, "y", "after", "y"), gap(13, "odd", 2, 2, "x", "nobody", "after", "nobody"), gap(14, "interstitial", 2, 2, "x", "y", "after", "y"), gap(15, "interstitial", 2, 2, "x", "y", "after", "y")]
    rows, errors = comments.line_dispositions(lines, owners, spark.createDataFrame(regions, REGIONS), spark.createDataFrame(gaps, GAPS))
    found = sorted({(r["doc_id"], r["code"]) for r in errors.collect()})
    assert found == [
        (1, "owner_identity"), (2, "owner_overlap"), (3, "owner_identity"), (3, "owner_overlap"), (3, "owner_range"), (4, "region_owner"), (5, "region_kind"), (6, "region_conflict"), (7, "region_conflict"), (8, "region_conflict"), (9, "region_conflict"), (10, "region_range"),
        (11, "gap_controller"), (12, "gap_conflict"), (12, "gap_not_blank"), (13, "gap_edges"), (13, "gap_owner"),
    ]
    assert {r["doc_id"] for r in rows.select("doc_id").distinct().collect()} == {14, 15}


def walk(source, owners, notes, policy):
    """Regions (kind, owner, start, end, comments) by walking the lines up and down from each owner."""
    text = [""] + source.removesuffix("\n").split("\n")
    n = len(text) - 1
    blank = lambda k: 1 <= k <= n and not text[k].strip()
    owners = sorted(owners, key=lambda o: (o[1], o[2], o[0]))
    notes = sorted(notes)
    full = {c[0]: c for c in notes if c[1]}
    own = {k: c for k, c in full.items() if not c[3]}
    used, out = set(), []
    for i, (name, start, end, indent) in enumerate(owners):
        lead, k = [], start - 1
        while k > 0:
            if k in own and k not in used:
                lead.append(k)
                k -= 1
                continue
            above = max((c for c in full if c < k and c not in used), default=None)
            prefix = above is not None and full[above][4] and all(blank(j) for j in range(above + 1, k))
            if blank(k) and (policy == "preceding_owner" or (lead and own[lead[-1]][4]) or prefix):
                k -= 1
                continue
            break
        lead.reverse()
        first_gap = next((k for k in range(1, start) if blank(k)), None)
        if lead and lead[0] == 1 and first_gap:
            lead = [k for k in lead if k > first_gap]
        inline = [c[0] for c in notes if not c[1] and not c[3] and start <= c[0] <= end]
        trail, k = [], end + 1
        bound = owners[i + 1][1] - 1 if i + 1 < len(owners) else n
        if policy == "preceding_owner" and k <= bound and not blank(k):
            while k <= bound and k in own and k not in used and not (own[k][2] is not None and indent is not None and own[k][2] != indent):
                trail.append(k)
                k += 1
                while k <= bound and blank(k):
                    k += 1
        for kind, found in (("leading", lead), ("inline", inline), ("trailing", trail)):
            if found:
                out.append((kind, name, min(found), max(found), len(found)))
        used |= {*lead, *trail}
    post = [k for k in sorted(own) if owners and k > owners[-1][2] and k not in used]
    if post:
        out.append(("postlude", None, post[0], post[-1], len(post)))
    used |= {*post}
    groups = []
    for k in sorted(set(full) - used):
        if groups and all(blank(j) for j in range(groups[-1][-1] + 1, k)):
            groups[-1].append(k)
        else:
            groups.append([k])
    for i, group in enumerate(groups):
        head = i == 0 and bool(owners) and group[-1] < owners[0][1]
        cut = next((k for k in range(group[-1] - 1, group[0], -1) if blank(k)), None) if head and group[0] == 1 else None
        parts = [([k for k in group if k < cut], "preamble"), ([k for k in group if k > cut], "orphan")] if cut else [(group, "preamble" if head else "orphan")]
        out += [(kind, None, part[0], part[-1], len(part)) for part, kind in parts if part]
    return sorted(out, key=str)


@pytest.mark.parametrize("policy", comments.POLICIES)
def test_attachment_equals_a_walk_over_the_lines(spark, policy):
    rng = np.random.default_rng(31)
    docs = {}
    for d in range(400):
        n = int(rng.integers(1, 16))
        text, owners, notes, k = [], [], [], 1
        while k <= n:
            draw = rng.random()
            if draw < 0.25:
                text.append(" \t" if rng.random() < 0.3 else "")
            elif draw < 0.65:
                text.append("# note")
                notes.append((k, True, int(rng.integers(0, 2)) if rng.random() < 0.6 else None, bool(rng.random() < 0.1), bool(rng.random() < 0.2)))
            elif draw < 0.9:
                size = min(int(rng.integers(1, 4)), n - k + 1)
                owners.append((f"o{k}", k, k + size - 1, int(rng.integers(0, 2)) if rng.random() < 0.7 else None))
                for j in range(size):
                    text.append("code")
                    if rng.random() < 0.3:
                        notes += [(k + j, False, None, False, False)] * int(rng.integers(1, 3))
                    elif j and j < size - 1 and rng.random() < 0.4:
                        notes.append((k + j, True, 0, False, False))
                k += size - 1
            else:
                text.append("other")
            k += 1
        docs[d] = ("\n".join(text) + "\n", owners, notes)
    lines, owners, notes = frames(spark, docs)
    got = {d: [] for d in docs}
    for r in comments.attach_comments(lines, owners, notes, policy).collect():
        got[r["doc_id"]].append((r["kind"], r["owner_id"], r["start_line"], r["end_line"], r["n_comments"]))
    for d, (source, own, cs) in docs.items():
        assert sorted(got[d], key=str) == walk(source, own, cs, policy), (d, source, own, cs)
    # Only regions that lie across each other, as around a comment of the document, are in conflict; else each line has one disposition.
    regions = comments.regions_in_owners(comments.attach_comments(lines, owners, notes, policy), owners)
    rows, errors = comments.line_dispositions(lines, owners, regions, comments.edge_gaps(lines, owners, regions))
    bad = {(r["doc_id"], r["code"]) for r in errors.collect()}
    spans = {}
    for r in regions.where("kind <> 'inline'").collect():
        spans.setdefault(r["doc_id"], []).append((r["start_line"], r["end_line"]))
    across = {d for d, v in spans.items() if any(a[1] >= b[0] for a, b in zip(sorted(v), sorted(v)[1:], strict=False))}
    assert {c for _, c in bad} <= {"region_conflict"} and {d for d, _ in bad} <= across
    kept = rows.select("doc_id", "line").collect()
    assert len(kept) == len(set(kept)) == sum(len(s.removesuffix("\n").split("\n")) for d, (s, _, _) in docs.items() if d not in {d for d, _ in bad})


def test_unknown_policy_and_documents_without_comments(spark):
    lines, owners, notes = frames(spark, {1: KNOWN[2]})
    with pytest.raises(ValueError):
        comments.attach_comments(lines, owners, notes, "both")
    assert comments.attach_comments(lines, owners, notes).count() == 0
    bare = comments.attach_comments(lines, owners.drop("indent"), spark.createDataFrame([(1, 2, True)], "doc_id int, line int, full_line boolean"))
    assert bare.select("kind", "owner_id", F.col("selection_key")).collect() == [("trailing", "alpha", "comment:alpha:trailing")]


def test_a_task_has_a_bounded_number_of_rows_however_well_they_pack(spark, monkeypatch):
    from ownerloom.sources import scratch

    monkeypatch.setattr(scratch, "ROWS_A_TASK", 10)
    lines = spark.range(400).selectExpr("id div 4 AS doc_id", "cast(id % 4 + 1 as int) AS line", "if(id % 4 = 0, ' ', 'x') AS text")
    owners = lines.where("line = 4").selectExpr("doc_id", "'o' AS owner_id", "line AS start_line", "line AS end_line")
    notes = lines.where("line IN (2, 3)").selectExpr("doc_id", "line", "true AS full_line")
    regions = comments.attach_comments(lines, owners, notes)
    assert regions.rdd.getNumPartitions() >= 80
    assert {(r.kind, r.start_line, r.end_line) for r in regions.collect()} == {("leading", 2, 3)} and regions.count() == 100
