"""Merges that keep every byte between owners: pieces of a source, the gate on layout, segments of the output and their check.

Sources are rows (case_id, role, text), one a revision; owners are rows (case_id, role, owner_id, start_byte, end_byte and,
if there is one, fingerprint) with byte places in the UTF-8 text. Places are told by windows over the owners of one source, and a source is
joined once with the list of all its ranges, so that no row carries a source for one owner. A source is one row, as in the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ownerloom.operators.merging import ROLES, three_way_classify
from ownerloom.sources.scratch import shuffled, written

_SOURCE = ["case_id", "role"]


def cut_ranges(sources: DataFrame, rows: DataFrame, keys: list[str], ranges: dict[str, tuple[str, str]]) -> DataFrame:
    """rows with one binary column for each of ranges (name -> columns of start and end byte), cut from the text of their source.

    The rows of a source are gathered to one list beside it and cut in one pass. Ranges must lie in the text; a null place gives null."""
    listed = rows.groupBy(*keys).agg(F.collect_list(F.struct(*[c for c in rows.columns if c not in keys])).alias("rs"))
    both = shuffled(listed).join(sources.select(*keys, F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("raw")), keys)
    piece = lambda r, s, e: F.substring("raw", (r[s] + 1).cast("int"), (r[e] - r[s]).cast("int"))
    out = F.explode(F.transform("rs", lambda r: F.struct(r.alias("r"), *[piece(r, s, e).alias(name) for name, (s, e) in ranges.items()])))
    return both.select(*keys, out.alias("x")).select(*keys, "x.r.*", *[f"x.{name}" for name in ranges])


def source_faults(sources: DataFrame, owners: DataFrame) -> DataFrame:
    """case_id, role, fault: the first fault by place of a source whose owners do not fit it: owner_identity (null, empty or twice),
    owner_range (null, empty or beyond the text) or owner_overlap (begins before the one above ends)."""
    size = sources.select(*_SOURCE, F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    start, end = F.col("start_byte"), F.col("end_byte")
    by_place = Window.partitionBy(*_SOURCE).orderBy("start_byte", "end_byte", "owner_id")
    rows = owners.join(shuffled(size), _SOURCE).withColumns({"copies": F.count("*").over(Window.partitionBy(*_SOURCE, "owner_id")), "above": F.max("end_byte").over(by_place.rowsBetween(Window.unboundedPreceding, -1)), "nth": F.row_number().over(by_place)})
    fault = (
        F.when(F.coalesce(F.col("owner_id").cast("string"), F.lit("")).eqNullSafe("") | (F.col("copies") > 1), "owner_identity")
        .when(F.coalesce((start < 0) | (start >= end) | (end > F.col("size")), F.lit(True)), "owner_range")
        .when(start < F.col("above"), "owner_overlap")
    )
    return rows.withColumn("fault", fault).where("fault IS NOT NULL").groupBy(*_SOURCE).agg(F.min_by("fault", "nth").alias("fault"))


def source_pieces(sources: DataFrame, owners: DataFrame, faults: DataFrame | None = None) -> DataFrame:
    """Every source as a chain of pieces: case_id, role, pos (from 0), owner_id, fingerprint, gap_start, start_byte, end_byte, gap, text, the
    parts of the gap (rest, between, indent), line_rest, shares_line and torn. The last piece has the suffix as its gap and no owner.

    rest belongs to the line that the owner above ends on, indent to the line that this owner begins on, between is what lies on
    lines without an owner; line_rest is the rest of the owner's own last line. shares_line: two owners on one line. torn: a place within a
    character. Sources with faults (source_faults(), if not given) are left out; fingerprint is the digest of the text where owners bring none."""
    faults = source_faults(sources, owners) if faults is None else faults
    good = sources.join(shuffled(faults.select(*_SOURCE)), _SOURCE, "left_anti")
    size = good.select(*_SOURCE, F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    printed = F.col("fingerprint").cast("string") if "fingerprint" in owners.columns else F.lit(None).cast("string")
    spans = owners.select(*_SOURCE, "owner_id", printed.alias("fingerprint"), F.col("start_byte").cast("long"), F.col("end_byte").cast("long"))
    suffix = size.select(*_SOURCE, F.lit(None).cast(owners.schema["owner_id"].dataType).alias("owner_id"), F.lit(None).cast("string").alias("fingerprint"), F.col("size").alias("start_byte"), F.col("size").alias("end_byte"), F.lit(1).alias("is_suffix"))
    # An owner ends behind its start, so the suffix is last even where an owner ends with the text.
    w = Window.partitionBy(*_SOURCE).orderBy(F.coalesce("is_suffix", F.lit(0)), "start_byte")
    rows = spans.join(shuffled(size.select(*_SOURCE)), _SOURCE, "left_semi").unionByName(suffix, allowMissingColumns=True)
    rows = rows.withColumns({"pos": F.row_number().over(w) - 1, "gap_start": F.coalesce(F.lag("end_byte").over(w), F.lit(0).cast("long"))}).drop("is_suffix")
    rows = cut_ranges(good, rows, _SOURCE, {"gap_raw": ("gap_start", "start_byte"), "text_raw": ("start_byte", "end_byte")})
    gap, text = F.col("gap_raw").cast("string"), F.col("text_raw").cast("string")
    rows = rows.withColumns({"gap": gap, "text": F.when(F.col("owner_id").isNotNull(), text), "torn": ~F.is_valid_utf8(gap) | ~F.is_valid_utf8(text)}).drop("gap_raw", "text_raw")
    w = Window.partitionBy(*_SOURCE).orderBy("pos")
    ended, line_end = F.coalesce(F.endswith(F.lag("text").over(w), F.lit("\n")), F.lit(True)), F.instr("gap", "\n")
    rows = rows.withColumns({"ended": ended, "line_end": line_end})
    rest = F.when(F.col("ended"), "").when(F.col("line_end") == 0, F.col("gap")).otherwise(F.substring("gap", F.lit(1), F.col("line_end")))
    rows = rows.withColumns({"rest": rest, "after": F.substring("gap", F.length(rest) + 1, F.length("gap"))})
    rows = rows.withColumn("indent", F.when(F.col("owner_id").isNull(), "").otherwise(F.substring_index("after", "\n", -1)))
    return rows.select(
        *_SOURCE, "pos", "owner_id", F.coalesce("fingerprint", F.sha2("text", 256)).alias("fingerprint"), "gap_start", "start_byte", "end_byte", "gap", "text", "rest",
        F.substring("after", F.lit(1), F.length("after") - F.length("indent")).alias("between"), "indent", F.lead("rest").over(w).alias("line_rest"),
        (~F.col("ended") & (F.col("line_end") == 0) & F.col("owner_id").isNotNull()).alias("shares_line"), "torn",
    )


def _whole(sources: DataFrame) -> DataFrame:
    """case_id, missing (a revision has no source) and whole (ours or theirs, where two sources are equal)."""
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    s = sources.groupBy("case_id").agg(*[F.max(F.when(F.col("role") == r, digest)).alias(r) for r in ROLES])
    b, o, t = (F.col(r) for r in ROLES)
    return s.select("case_id", (b.isNull() | o.isNull() | t.isNull()).alias("missing"), F.when((o == t) | (b == t), "ours").when(b == o, "theirs").alias("whole"))


def _membership(decisions: DataFrame) -> DataFrame:
    """One row a case: counts that tell conflicts, whose membership is chosen, and whether lists and orders of owners agree."""
    kept, places = F.col("selected").isNotNull(), [F.col(f"{r}_pos") for r in ROLES]
    stable = places[0].isNotNull() & places[1].isNotNull() & places[2].isNotNull()
    member = decisions.groupBy("case_id").agg(
        F.count_if(F.startswith("decision", F.lit("conflict"))).alias("conflicts"), F.count_if(stable).alias("stable"),
        F.count_if(~(places[0].eqNullSafe(places[1]) & places[0].eqNullSafe(places[2]))).alias("changed"),
        *[F.count_if(kept & F.col(f"{r}_pos").isNull()).alias(f"beyond_{r}") for r in ROLES[1:]], *[F.count_if(~kept & F.col(f"{r}_pos").isNotNull()).alias(f"lost_{r}") for r in ROLES[1:]],
    )
    above = lambda role: F.lag("owner_id").over(Window.partitionBy("case_id").orderBy(f"{role}_pos"))
    b, o, t = (F.col(r) for r in ROLES)
    order = decisions.where(stable).select("case_id", *[above(r).alias(r) for r in ROLES]).groupBy("case_id").agg(F.count_if(~o.eqNullSafe(t)).alias("out_of_order"), F.count_if(~b.eqNullSafe(o)).alias("reordered"))
    return member.join(shuffled(order), "case_id", "left").fillna(0, ["out_of_order", "reordered"])


def _layout(pieces: DataFrame, member: DataFrame) -> DataFrame:
    """case_id, shares_line, layout_differs of cases without conflicts.

    Where all lists of owners agree, gaps are compared place by place. Else what lies on lines without an owner is compared between
    neighbouring stable owners; behind the last of them, if other owners follow, only what follows the last owner."""
    cases = member.where("conflicts = 0").select("case_id", (F.col("changed") > 0).alias("changed"), (F.col("reordered") > 0).alias("reordered"))
    rows = pieces.select(*_SOURCE, "pos", "owner_id", "gap", "between", "shares_line").join(shuffled(cases), "case_id")
    # No source has an owner twice. All windows and groups lie within a case, as the join left them.
    owned, sources_with = F.col("owner_id").isNotNull(), F.count("*").over(Window.partitionBy("case_id", "owner_id"))
    rows = rows.withColumn("firm", F.when(owned & (sources_with == len(ROLES)), 1))
    by_pos = Window.partitionBy(*_SOURCE).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    passed, all_firm = F.count("firm").over(by_pos), F.count("firm").over(Window.partitionBy(*_SOURCE))
    rows = rows.withColumns({"slot": F.when(F.col("changed"), passed).otherwise(F.col("pos")), "part": F.when(F.col("changed"), F.col("between")).otherwise(F.col("gap")), "all_firm": all_firm})
    behind = F.col("changed") & (F.col("all_firm") > 0) & (F.col("slot") == F.col("all_firm")) & F.col("owner_id").isNotNull()
    rows = rows.withColumn("part", F.when(behind, "").otherwise(F.col("part")))
    joined = lambda r: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == r, F.struct("pos", "part")))), lambda x: x.part), "")
    found = lambda r: F.count_if(F.col("role") == r) > 0
    slots = rows.groupBy("case_id", "changed", "reordered", "slot").agg(*[joined(r).alias(r) for r in ROLES], *[found(r).alias(f"{r}_in") for r in ROLES], F.bool_or("shares_line").alias("shares_line"))
    differ = lambda a, b: (F.col(a) != F.col(b)) | (F.col(f"{a}_in") != F.col(f"{b}_in"))
    bad = F.when(F.col("reordered") & F.col("changed"), differ("ours", "theirs")).otherwise(differ("base", "ours") | differ("base", "theirs"))
    return slots.groupBy("case_id").agg(F.bool_or("shares_line").alias("shares_line"), F.bool_or(bad).alias("layout_differs"))


def _chosen(pieces: DataFrame, decisions: DataFrame) -> DataFrame:
    """case_id, owner_id, selected and the places, text and line parts of the revision that a kept owner is taken from."""
    taken = pieces.select("case_id", "owner_id", F.col("role").alias("selected"), "start_byte", "end_byte", "text", "indent", "line_rest")
    return decisions.where("selected IS NOT NULL").select("case_id", "owner_id", "selected", "ours_pos", "theirs_pos").join(shuffled(taken), ["case_id", "owner_id", "selected"])


def _render_faults(pieces: DataFrame, decisions: DataFrame, plan: DataFrame) -> DataFrame:
    """case_id of cases whose output would have other lines between its owners than its baseline: a chosen text ends its line where
    the baseline's does not (or the reverse) and something follows, or additions would not begin on a line of their own right behind the last owner."""
    chosen = _chosen(pieces, decisions)
    w = Window.partitionBy(*_SOURCE).orderBy("pos")
    base = pieces.withColumns({"next_gap": F.lead("gap").over(w), "next_owner": F.lead("owner_id").over(w), "last_gap": F.col("gap")}).join(plan.select("case_id", F.col("baseline").alias("role"), "additions"), _SOURCE)
    ends = lambda c: F.endswith(c, F.lit("\n"))
    turned = base.where("owner_id IS NOT NULL").select("case_id", "owner_id", ends("text").alias("was"), (F.col("next_gap") != "").alias("follows"), F.col("next_owner").isNotNull().alias("more"), "additions")
    turned = shuffled(turned).join(chosen.select("case_id", "owner_id", ends("text").alias("is")), ["case_id", "owner_id"])
    moved = turned.where("was <> is AND (follows OR more)")
    unended = turned.where("additions AND NOT more AND NOT follows AND NOT is")
    suffix = base.where("owner_id IS NULL AND additions").where((F.col("between") != "") | ((F.col("gap") != "") & ~ends("gap")))
    return moved.select("case_id").unionByName(unended.select("case_id")).unionByName(suffix.select("case_id")).distinct()


def merge_with_layout(sources: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts, segments) of three revisions whose gaps must agree.

    verdicts: case_id, outcome (clean, conflict, error), why, baseline (the revision whose gaps are kept). In this order: missing_revision;
    faults of base, ours, theirs (owner_identity, owner_range, owner_overlap); whole_source; owner_conflict; membership (the chosen owners
    are neither those of a tip nor ours and more); owner_order; shared_line; layout; render_layout (the output would not have the
    baseline's lines between owners). Clean reasons are whole_source, ours, theirs and ours_extended.

    segments of clean cases: case_id, ordinal (from 0), revision, owner_id (null: a gap or a whole source), src_start, src_end, out_start,
    out_end (bytes), sha256, text. Gaps come from the baseline, owners from the chosen revision, and what theirs adds to ours
    follows as whole lines in theirs' order. Empty pieces are no segments. Null texts count as empty."""
    misfits = written(source_faults(sources, owners), "faults")
    pieces = source_pieces(sources, owners, misfits)
    given = "fingerprint" in owners.columns
    pieces = written(pieces if given else pieces.drop("fingerprint"), "pieces")
    torn = pieces.where("torn").select(*_SOURCE, F.lit("owner_range").alias("fault"))
    rank = F.when(F.col("role") == "base", 0).when(F.col("role") == "ours", 1).otherwise(2)
    faults = misfits.unionByName(torn).groupBy("case_id").agg(F.min_by("fault", rank).alias("fault"))
    state = written(_whole(sources).join(shuffled(faults), "case_id", "left"), "state")
    open_cases = state.where("NOT missing AND fault IS NULL AND whole IS NULL").select("case_id")
    pieces_open = pieces.join(open_cases, "case_id", "left_semi")
    # A text that is shorter than its digest stands for itself.
    mark = F.col("fingerprint") if given else F.when(F.octet_length("text") < 64, F.concat(F.lit("="), "text")).otherwise(F.sha2("text", 256))
    compared = pieces_open.where("owner_id IS NOT NULL").withColumns({"fingerprint": mark, "path": F.lit(None).cast("string")})
    decisions = written(three_way_classify(compared).drop("alternatives"), "decisions")
    member = written(_membership(decisions), "membership")
    kept = lambda r: (F.col(f"beyond_{r}") == 0) & (F.col(f"lost_{r}") == 0)
    baseline = F.when(kept("ours"), "ours").when(kept("theirs"), "theirs").when(F.col("lost_ours") == 0, "ours")
    plan = member.select("*", baseline.alias("baseline"), (~kept("ours") & ~kept("theirs")).alias("additions"))
    changed = plan.where("conflicts = 0 AND changed > 0 AND baseline IS NOT NULL")
    rendered = _render_faults(pieces_open, decisions, changed).withColumn("bad_render", F.lit(True))
    judged = state.join(plan, "case_id", "left").join(shuffled(_layout(pieces_open, member)), "case_id", "left").join(shuffled(rendered), "case_id", "left")
    why = (
        F.when(F.col("missing"), "missing_revision").when(F.col("fault").isNotNull(), F.col("fault")).when(F.col("whole").isNotNull(), "whole_source").when(F.col("conflicts") > 0, "owner_conflict")
        .when(F.col("conflicts").isNull(), "layout").when(F.col("baseline").isNull(), "membership").when(F.col("out_of_order") > 0, "owner_order")
        .when(F.col("shares_line") & (F.col("changed") > 0) & (F.col("stable") > 0), "shared_line").when(F.col("layout_differs") | ((F.col("changed") > 0) & (F.col("stable") == 0)), "layout")
        .when(F.col("bad_render"), "render_layout").when(F.col("additions"), "ours_extended").otherwise(F.col("baseline"))
    )
    clean = F.col("why").isin("whole_source", "ours", "theirs", "ours_extended")
    outcome = F.when(clean, "clean").when(F.col("why") == "owner_conflict", "conflict").otherwise("error")
    verdicts = judged.withColumn("why", why).select("case_id", outcome.alias("outcome"), "why", F.when(clean, F.coalesce("whole", "baseline")).alias("baseline"))
    verdicts = written(verdicts, "verdicts")
    return verdicts, _segments(sources, pieces, decisions, verdicts)


def _segments(sources: DataFrame, pieces: DataFrame, decisions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The segments of merge_with_layout()."""
    merged = verdicts.where("outcome = 'clean' AND why <> 'whole_source'").select("case_id", "baseline")
    chosen = _chosen(pieces, decisions.join(merged, "case_id", "left_semi"))
    owner_type = pieces.schema["owner_id"].dataType
    at = lambda part, pos, kind: F.struct(F.lit(part).alias("part"), F.col(pos).alias("pos"), F.lit(kind).alias("kind")).alias("place")
    none = F.lit(None).cast(owner_type).alias("owner_id")
    lines = pieces.join(merged.withColumnRenamed("baseline", "role"), _SOURCE)
    gaps = lines.select("case_id", at(0, "pos", 0), F.col("role").alias("revision"), none, F.col("gap_start").alias("src_start"), F.col("start_byte").alias("src_end"), F.col("gap").alias("text"))
    placed = lines.where("owner_id IS NOT NULL").select("case_id", "owner_id", "pos").join(shuffled(chosen), ["case_id", "owner_id"])
    kept = placed.select("case_id", at(0, "pos", 1), F.col("selected").alias("revision"), "owner_id", F.col("start_byte").alias("src_start"), F.col("end_byte").alias("src_end"), "text")
    extra = chosen.where("ours_pos IS NULL").join(merged.where("baseline = 'ours'"), "case_id", "left_semi")
    added = extra.select("case_id", at(1, "theirs_pos", 1), F.col("selected").alias("revision"), "owner_id", (F.col("start_byte") - F.octet_length("indent")).alias("src_start"), (F.col("end_byte") + F.octet_length("line_rest")).alias("src_end"), F.concat("indent", "text", "line_rest").alias("text"))
    equal = verdicts.where("why = 'whole_source'").select("case_id", F.col("baseline").alias("role"))
    whole = sources.join(equal, _SOURCE).select("case_id", F.struct(F.lit(0).alias("part"), F.lit(0).alias("pos"), F.lit(0).alias("kind")).alias("place"), F.col("role").alias("revision"), none, F.lit(0).cast("long").alias("src_start"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("src_end"), F.coalesce("text", F.lit("")).alias("text"))
    rows = gaps.unionByName(kept).unionByName(added).unionByName(whole).where("src_end > src_start")
    w = Window.partitionBy("case_id").orderBy("place")
    size = F.col("src_end") - F.col("src_start")
    start = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return rows.select("case_id", (F.row_number().over(w) - 1).alias("ordinal"), "revision", "owner_id", "src_start", "src_end", start.alias("out_start"), (start + size).alias("out_end"), F.sha2("text", 256).alias("sha256"), "text")


def render_segments(verdicts: DataFrame, segments: DataFrame) -> DataFrame:
    """case_id, output of clean cases; a case without segments is an empty output. One document is one row, as in the input."""
    parts = segments.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "text"))).alias("ps"))
    text = F.array_join(F.transform("ps", lambda p: p.text), "")
    return verdicts.where("outcome = 'clean'").select("case_id").join(shuffled(parts), "case_id", "left").select("case_id", F.coalesce(text, F.lit("")).alias("output"))


def verify_segments(sources: DataFrame, outputs: DataFrame, segments: DataFrame) -> DataFrame:
    """case_id, error: whether segments (without their texts) account for outputs (case_id, output), byte by byte.

    The first error by place of the output, null where all hold: duplicate_id (an ordinal twice), empty_range, gap (does not begin
    where the one above ends), length (the last does not end with the output, or there is none for an output with bytes), range (beyond the source or
    output, or no such source), bytes (source and output differ) or digest. Sources and outputs are cut beside the list of a case's segments."""
    raw = lambda column: F.encode(F.coalesce(column, F.lit("")), "utf-8")
    given = sources.groupBy("case_id").agg(F.collect_list(F.struct("role", raw("text").alias("raw"))).alias("given"))
    made = outputs.select("case_id", raw("output").alias("made"))
    segment = F.struct(F.col("revision").alias("role"), "ordinal", *[F.col(c).cast("long").alias(c) for c in ("src_start", "src_end", "out_start", "out_end")], "sha256")
    listed = segments.groupBy("case_id").agg(F.collect_list(segment).alias("rs"))

    def cut(whole: Column, start: Column, end: Column) -> Column:
        """The bytes of a range, null where it does not lie in whole."""
        inside = (start >= 0) & (start <= end) & (end <= F.octet_length(whole))
        return F.when(inside, F.substring(whole, (start + 1).cast("int"), (end - start).cast("int")))

    source = lambda r: F.get(F.filter("given", lambda g: g.role == r.role), 0).raw
    pieces = F.transform("rs", lambda r: F.struct(r.alias("r"), cut(source(r), r.src_start, r.src_end).alias("src"), cut(F.col("made"), r.out_start, r.out_end).alias("out")))
    # A case's texts, segments and places all lie by case: each is shuffled once at most.
    both = shuffled(listed).join(given, "case_id", "left").join(shuffled(made), "case_id", "left")
    rows = both.select("case_id", F.octet_length("made").cast("long").alias("out_size"), F.explode(pieces).alias("p")).select("case_id", "out_size", "p.r.*", "p.src", "p.out")
    w = Window.partitionBy("case_id").orderBy("out_start", "ordinal")
    rows = rows.withColumns({
        "fits": F.col("src").isNotNull() & F.col("out").isNotNull(), "copies": F.count("*").over(Window.partitionBy("case_id", "ordinal")),
        "above": F.coalesce(F.lag("out_end").over(w), F.lit(0).cast("long")), "is_last": F.lead("ordinal").over(w).isNull(),
    })
    error = _first(
        (F.col("copies") > 1, "duplicate_id"), (F.col("out_end") <= F.col("out_start"), "empty_range"), (F.col("above") != F.col("out_start"), "gap"), (F.col("is_last") & (F.col("out_end") != F.col("out_size")), "length"),
        (~F.col("fits"), "range"), (F.col("src") != F.col("out"), "bytes"), (~F.sha2("out", 256).eqNullSafe(F.col("sha256")), "digest"),
    )
    told = rows.withColumn("error", error).groupBy("case_id").agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.struct("out_start", "ordinal"))).alias("error"), F.lit(True).alias("any"))
    told = made.select("case_id", F.octet_length("made").alias("n")).join(told, "case_id", "full_outer")
    return told.select("case_id", F.when(F.col("any").isNull() & (F.col("n") > 0), "length").otherwise(F.col("error")).alias("error"))


def _first(*cases: tuple[Column, str]) -> Column:
    """The name of the first condition that holds."""
    return F.coalesce(*[F.when(condition, name) for condition, name in cases])
