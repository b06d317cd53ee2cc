"""Merges that keep the bytes between owners: known cases, a plain walk over lines, odd rows and faults of segments."""

import hashlib
import random

import pytest

from ownerloom.jobs import layout as queries
from ownerloom.operators import layout

SOURCES = "case_id int, role string, text string"
OWNERS = "case_id int, role string, owner_id string, fingerprint string, start_byte long, end_byte long"
ROLES = ("base", "ours", "theirs")


def source(text, *names):
    """A text and its owners: name or name=words, each found in the text from the last one on."""
    owners, at = [], 0
    for name in names:
        name, _, words = name.partition("=")
        start = text.index(words or name, at)
        at = start + len(words or name)
        owners.append((name, len(text[:start].encode()), len(text[:at].encode())))
    return text, owners


def frames(spark, cases):
    sources = [(c, r, text) for c, revisions in cases.items() for r, (text, _) in zip(ROLES, revisions)]
    owners = [(c, r, name, None, s, e) for c, revisions in cases.items() for r, (_, own) in zip(ROLES, revisions) for name, s, e in own]
    return spark.createDataFrame(sources, SOURCES).repartition(3), spark.createDataFrame(owners, OWNERS).repartition(3)


def merged(spark, cases):
    sources, owners = frames(spark, cases)
    verdicts, segments = layout.merge_with_layout(sources, owners)
    outputs = layout.render_segments(verdicts, segments)
    assert [r for r in layout.verify_segments(sources, outputs, segments).collect() if r.error is not None] == []
    told = {r.case_id: (r.outcome, r.why) for r in verdicts.collect()}
    return told, {r.case_id: r.output for r in outputs.collect()}, segments


KNOWN = {
    1: (source("one\n\ntwo\n", "left=one", "right=two"), source("ONE\n\ntwo\n", "left=ONE", "right=two"), source("one\n\nTWO\n", "left=one", "right=TWO")),
    2: (source("left\n\nright\n", "left", "right"), source("right\n\nLEFT\n", "right", "left=LEFT"), source("RIGHT\n\nleft\n", "right=RIGHT", "left")),
    3: (source("left\n\nright\n", "left", "right"), source("right\n\nLEFT\n", "right", "left=LEFT"), source("left\n\nRIGHT\n", "left", "right=RIGHT")),
    4: (source("one\n\ntwo\n", "left=one", "right=two"), source("ONE\n\ntwo\n", "left=ONE", "right=two"), source("one\n", "left=one")),
    5: (source("one\n", "left=one"), source("ONE\n", "left=ONE"), source("one\n\nthree\n", "left=one", "third=three")),
    6: (source("one\n\ntwo\n", "left=one", "right=two"), source("ONE\n\ntwo\n", "left=ONE", "right=two"), source("one\n\n\nTWO\n", "left=one", "right=TWO")),
    7: (source("one\n\ntwo\n", "left=one", "right=two"), source("ONE\n\ntwo\n", "left=ONE", "right=two"), source("TWO\n\ntwo\n", "left=TWO", "right=two")),
    8: (source("one\n\ntwo\n", "left=one", "right=two"), source("ONE\n\ntwo\n\nfour\n", "left=ONE", "right=two", "fourth=four"), source("one\n\nthree\n", "left=one", "third=three")),
    9: (source(""), source(""), source("")),
    10: (source("﻿é\r\n"), source("﻿é\r\n"), source("﻿é\r\n")),
    11: (source("a\n", "a"), source("a\n  b # é\n", "a", "b"), source("a\n  c # x\n  d\n", "a", "c", "d")),
    12: (source("a; b\n", "a", "b"), source("a; b\nc\n", "a", "b", "c"), source("a; B\n", "a", "b=B")),
    13: (source("x"), source("y"), source("z")),
    14: (source("a\n# end\n", "a"), source("a\nb\n# end\n", "a", "b"), source("a\nc\n# end\n", "a", "c")),
}
VERDICTS = {
    1: ("clean", "ours"), 2: ("clean", "ours"), 3: ("error", "owner_order"), 4: ("clean", "theirs"), 5: ("clean", "theirs"), 6: ("error", "layout"), 7: ("conflict", "owner_conflict"), 8: ("error", "membership"),
    9: ("clean", "whole_source"), 10: ("clean", "whole_source"), 11: ("clean", "ours_extended"), 12: ("error", "shared_line"), 13: ("error", "layout"), 14: ("error", "render_layout"),
}
OUTPUTS = {1: "ONE\n\nTWO\n", 2: "RIGHT\n\nLEFT\n", 4: "ONE\n", 5: "ONE\n\nthree\n", 9: "", 10: "﻿é\r\n", 11: "a\n  b # é\n  c # x\n  d\n"}


def test_known_cases(spark):
    told, outputs, segments = merged(spark, KNOWN)
    assert told == VERDICTS
    assert outputs == OUTPUTS
    rows = [(r.revision, r.owner_id, r.src_start, r.src_end, r.out_start, r.out_end) for r in segments.where("case_id = 1").orderBy("ordinal").collect()]
    assert rows == [("ours", "left", 0, 3, 0, 3), ("ours", None, 3, 5, 3, 5), ("theirs", "right", 5, 8, 5, 8), ("ours", None, 8, 9, 8, 9)]
    assert segments.where("case_id = 9").count() == 0 and segments.where("case_id = 10").count() == 1


def test_merge_with_an_unchanged_tip_is_the_other_tip(spark):
    base, tip = source("# head\n\n  a = é # x\n\n\nb\n# tail", "a=a = é", "b"), source("# new head\n b\n", "b")
    told, outputs, _ = merged(spark, {1: (base, base, tip), 2: (base, tip, base), 3: (base, tip, tip)})
    assert set(told.values()) == {("clean", "whole_source")} and set(outputs.values()) == {tip[0]}


def test_pieces_hold_every_byte_and_say_whose_line_they_are(spark):
    text, owners = source("# h\n  a = é; # x\n\n# free\n  b\nrest", "a=a = é;", "b")
    sources, own = frames(spark, {1: ((text, owners),) * 3})
    rows = layout.source_pieces(sources, own).where("role = 'base'").orderBy("pos").collect()
    assert "".join(r.gap + (r.text or "") for r in rows) == text
    assert [(r.owner_id, r.rest, r.between, r.indent, r.line_rest) for r in rows] == [("a", "", "# h\n", "  ", " # x\n"), ("b", " # x\n", "\n# free\n", "  ", "\n"), (None, "\n", "rest", "", None)]


#: Owners that do not fit the text of ours, and the fault.
UNFIT = [
    ([("a", 0, 1), ("a", 2, 3)], "owner_identity"), ([(None, 0, 1)], "owner_identity"), ([("", 0, 1)], "owner_identity"), ([("a", 1, 1)], "owner_range"), ([("a", 0, 99)], "owner_range"),
    ([("a", None, 1)], "owner_range"), ([("a", -1, 1)], "owner_range"), ([("a", 0, 3), ("b", 2, 4)], "owner_overlap"), ([("a", 0, 1), ("b", 1, 5)], "owner_range"),
]


def test_owners_that_do_not_fit_their_source(spark):
    """The last case ends within the two bytes of a letter."""
    good = source("abc\n", "a")
    told, outputs, _ = merged(spark, {c: (good, ("a\nbcé\n", owners), source("abcd\n", "a")) for c, (owners, _) in enumerate(UNFIT)})
    assert told == {c: ("error", fault) for c, (_, fault) in enumerate(UNFIT)} and outputs == {}


def test_null_texts_missing_revisions_and_empty_tables(spark):
    sources = spark.createDataFrame([(1, "base", None), (1, "ours", ""), (1, "theirs", "x"), (2, "base", "x"), (2, "ours", "x")], SOURCES)
    none = spark.createDataFrame([], OWNERS)
    verdicts, segments = layout.merge_with_layout(sources, none)
    assert {(r.case_id, r.outcome, r.why, r.baseline) for r in verdicts.collect()} == {(1, "clean", "whole_source", "theirs"), (2, "error", "missing_revision", None)}
    assert {(r.case_id, r.output) for r in layout.render_segments(verdicts, segments).collect()} == {(1, "x")}
    verdicts, segments = layout.merge_with_layout(sources.limit(0), none)
    assert verdicts.count() == segments.count() == 0


def test_verify_segments_tells_the_first_fault(spark):
    sources, owners = frames(spark, {c: KNOWN[1] for c in range(1, 9)})
    verdicts, segments = layout.merge_with_layout(sources, owners)
    rows = [r.asDict() for r in segments.collect()]
    for r in rows:
        at = (r["case_id"], r["ordinal"])
        r |= {(1, 1): {"src_end": 4}, (2, 2): {"sha256": None}, (3, 1): {"ordinal": 0}, (4, 3): {"out_start": 8, "out_end": 8}, (5, 1): {"src_end": 900}, (6, 1): {"revision": "other"}}.get(at, {})
    rows = [r for r in rows if (r["case_id"], r["ordinal"]) != (7, 2) and r["case_id"] != 8]
    told = layout.verify_segments(sources, layout.render_segments(verdicts, segments), spark.createDataFrame(rows, segments.schema))
    assert {r.case_id: r.error for r in told.collect()} == {1: "bytes", 2: "digest", 3: "duplicate_id", 4: "empty_range", 5: "range", 6: "range", 7: "gap", 8: "length"}


def walk(revisions):
    """Verdict and output by lines: (outcome, why), text or None. Owners lie whole on their lines here and have distinct names."""
    texts, owners = [t for t, _ in revisions], [o for _, o in revisions]
    cut = [{n: t.encode()[s:e].decode() for n, s, e in o} for t, o in revisions]
    if texts[1] == texts[2] or texts[0] == texts[2]:
        return ("clean", "whole_source"), texts[1]
    if texts[0] == texts[1]:
        return ("clean", "whole_source"), texts[2]
    picked = {}
    for name in {n for c in cut for n in c}:
        b, o, t = (c.get(name) for c in cut)
        if o == t or b == t:
            choice = (1, o)
        elif b == o:
            choice = (2, t)
        else:
            return ("conflict", "owner_conflict"), None
        if choice[1] is not None:
            picked[name] = choice[0]
    names = [[n for n, _, _ in o] for o in owners]
    extended = False
    if set(picked) == set(names[1]):
        tip = 1
    elif set(picked) == set(names[2]):
        tip = 2
    elif set(names[1]) <= set(picked):
        tip, extended = 1, True
    else:
        return ("error", "membership"), None
    firm = set(names[0]) & set(names[1]) & set(names[2])
    orders = [[n for n in ns if n in firm] for ns in names]
    if orders[1] != orders[2]:
        return ("error", "owner_order"), None

    def lines(text, spans):
        at, out = 0, []
        for line in text.splitlines(keepends=True):
            end = at + len(line.encode())
            out.append((line, [n for n, s, e in spans if s < end and e > at]))
            at = end
        return out

    def free(text, spans):
        """What lies between the stable owners, on lines without an owner; None if two owners share a line."""
        found, part, last = [], "", None
        for line, on in lines(text, spans):
            if len(on) > 1:
                return None
            if not on:
                part += line
            elif on[0] != last:
                last = on[0]
                if last in firm:
                    found.append(part)
                    part, loose = "", False
                elif found:
                    loose = True
                if last not in firm and found and loose and spans[-1][0] == last:
                    part = ""
        return [*found, part]

    changed = names[0] != names[1] or names[0] != names[2]

    def gaps(text, spans):
        raw, at, out = text.encode(), 0, []
        for _, s, e in spans:
            out.append(raw[at:s])
            at = e
        return [*out, raw[at:]]

    seen = [(free if changed else gaps)(t, o) for t, o in revisions]
    if changed and not firm:
        return ("error", "layout"), None
    if None in seen:
        return ("error", "shared_line"), None
    if seen[1] != seen[2] or (orders[0] == orders[1] and seen[0] != seen[1]):
        return ("error", "layout"), None
    out, spans = "", []
    for gap, name in zip(gaps(*revisions[tip]), [*names[tip], None]):
        out += gap.decode()
        if name is not None:
            start = len(out.encode())
            out += cut[picked[name]][name]
            spans.append((name, start, len(out.encode())))
    if extended:
        for line, on in lines(*revisions[2]):
            for name in on:
                if name not in names[1] and picked.get(name) == 2:
                    start = len((out + line[: line.index(cut[2][name])]).encode())
                    out += line
                    spans.append((name, start, start + len(cut[2][name].encode())))
    if changed and free(out, spans) != seen[tip]:
        return ("error", "render_layout"), None
    return ("clean", "ours_extended" if extended else ("ours", "theirs")[tip - 1]), out


def revision(rng, names, edit, noise):
    """A source with an owner for each name; edited texts and changed gaps now and then."""
    text, owners = rng.choice(["", "# é\n"]) if noise else "# é\n", []
    for k, name in enumerate(names):
        indent, words = "  " * (ord(name) % 2), name + (edit if rng.random() < 0.2 else "")
        start = len((text + indent).encode())
        owners.append((name, start, start + len(words)))
        text += indent + words + (" # x" if ord(name) % 3 == 0 else "") + ("; " if noise and rng.random() < 0.05 and k + 1 < len(names) else "\n")
        text += "\n" * (ord(name) % 4 == 1) + ("# free\n" if noise and rng.random() < 0.1 else "")
    return text, owners


def test_equal_to_a_walk_over_lines(spark):
    rng, cases = random.Random(5), {}
    for c in range(400):
        names = rng.sample("abcdefgh", rng.randint(0, 5))
        tips = []
        for _ in range(2):
            own = [n for n in names if rng.random() < 0.93]
            if rng.random() < 0.3:
                own.insert(rng.randint(0, len(own)), rng.choice("uvwxyz"))
            if rng.random() < 0.1:
                own.reverse()
            tips.append(own)
        noise = rng.random() < 0.4
        cases[c] = (revision(rng, names, "", noise), revision(rng, tips[0], "O", noise), revision(rng, tips[1], "T", noise))
    told, outputs, _ = merged(spark, cases)
    expected = {c: walk(r) for c, r in cases.items()}
    assert told == {c: verdict for c, (verdict, _) in expected.items()}
    assert outputs == {c: out for c, (_, out) in expected.items() if out is not None}
    assert len({why for _, why in told.values()}) >= 8


def test_check_of_segments_deals_them_once(spark):
    """Texts and segments of a case meet in one shuffle of each, and once more for what outputs have no segment."""
    sources = spark.createDataFrame([(1, "ours", "ab")], "case_id int, role string, text string")
    outputs = spark.createDataFrame([(1, "ab")], "case_id int, output string")
    rows = spark.createDataFrame([(1, 0, "ours", 0, 2, 0, 2, hashlib.sha256(b"ab").hexdigest())], "case_id int, ordinal int, revision string, src_start int, src_end int, out_start int, out_end int, sha256 string")
    told = layout.verify_segments(sources, outputs, rows)
    assert told.collect()[0]["error"] is None
    plan = told._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning(case_id") <= 5
    assert plan.count("Exchange hashpartitioning(") == plan.count("Exchange hashpartitioning(case_id")


@pytest.mark.parametrize("name", ["merge_with_layout", "layout_segments", "render_with_layout", "verify_merged_bytes"])
def test_no_table_of_cases_goes_through_the_driver(spark, monkeypatch, name):
    """Tables between steps pack well, so Spark takes them for small at sizes at which their rows fill the driver."""
    first_plans, written = [], layout.written

    def noted(df, label):
        first_plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return written(df, label)

    monkeypatch.setattr(layout, "written", noted)
    monkeypatch.setattr(queries, "written", noted)
    noted(queries.QUERIES[name](spark, "/root/testdata/sf0.001"), "result")
    assert len(first_plans) >= 8 and sum("SortMergeJoin" in plan for _, plan in first_plans) >= 6
    assert [label for label, plan in first_plans if "Broadcast" in plan] == []
