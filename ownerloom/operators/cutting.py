"""Cutting documents into blocks, sections, gaps, marker regions and JSON members.

Lines are rows (doc_id, line from 1, text). Windows are partitioned by document; where only a few
lines matter (markers, headings), the others are filtered out before the window.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ownerloom.functions.scalars import normalized_blocks

MAX_REVIEW_BYTES = 8 * 1024 * 1024
MAX_REVIEW_REGIONS = 10_000


def doc_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line, text, start_byte, end_byte (with the line break): lines of whole documents.

    A final line break ends the last line and begins none. Byte places are summed inside the row.
    """
    ends = F.expr("if(endswith(text, '\n'), slice(split(text, '\n'), 1, size(split(text, '\n')) - 1), split(text, '\n'))")
    rows = docs.where("text <> ''").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), ends.alias("parts"))
    rows = rows.select("doc_id", "n_bytes", F.posexplode("parts").alias("p", "text"))
    w = Window.partitionBy("doc_id").orderBy("p")
    start = F.coalesce(F.sum(F.octet_length("text") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("doc_id", (F.col("p") + 1).alias("line"), "text", start.alias("start_byte"), F.least(start + F.octet_length("text") + 1, F.col("n_bytes")).alias("end_byte"))


def text_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, index, normalized, start, end: blocks between blank lines with byte places in the normalized
    text (two bytes between blocks)."""
    rows = docs.select("doc_id", F.posexplode(normalized_blocks(F.coalesce("text", F.lit("")))).alias("index", "normalized"))
    w = Window.partitionBy("doc_id").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("normalized") + 2).over(w), F.lit(0)).cast("long")
    return rows.withColumn("start", start).withColumn("end", F.col("start") + F.octet_length("normalized"))


def fence_state(lines: DataFrame) -> DataFrame:
    """lines with is_fence (opens or closes a fence) and in_fence (within one, its end included).

    Three or more backticks or tildes open a fence; only a line of as many or more of the same sign, with nothing
    after them, closes it. Which lines do is one state carried over a document's candidate lines (a list of numbers and
    signs for each document, no texts)."""
    sign = F.regexp_extract("text", r"^ {0,3}(`{3,}(?=[^`]*$)|~{3,})", 1)
    candidates = lines.where(F.col("text").rlike(r"^ {0,3}(```|~~~)") & (sign != "")).select("doc_id", "line", F.substring(sign, 1, 1).alias("c"), F.length(sign).alias("n"), F.col("text").rlike(r"^ {0,3}(`+|~+)[ \t\r]*$").alias("bare"))
    listed = candidates.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line", "c", "n", "bare"))).alias("marks"))
    step = """aggregate(marks, named_struct('c', '', 'n', 0, 'hits', cast(array() AS array<int>)), (s, m) ->
      CASE WHEN s.c = '' THEN named_struct('c', m.c, 'n', m.n, 'hits', array_append(s.hits, cast(m.line AS int)))
           WHEN m.c = s.c AND m.n >= s.n AND m.bare THEN named_struct('c', '', 'n', 0, 'hits', array_append(s.hits, cast(m.line AS int))) ELSE s END, s -> s.hits)"""
    hits = listed.select("doc_id", F.explode(F.expr(step)).alias("line"), F.lit(True).alias("hit"))
    w = Window.partitionBy("doc_id").orderBy("line")
    rows = lines.join(hits, ["doc_id", "line"], "left").withColumn("is_fence", F.coalesce("hit", F.lit(False))).drop("hit")
    before = F.coalesce(F.sum(F.col("is_fence").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("in_fence", before % 2 == 1)


#: Info words of fenced code blocks, with the family and dialect they stand for.
FENCE_FAMILIES = {
    "ts": ("typescript", "typescript"), "typescript": ("typescript", "typescript"), "rust": ("rust", "rust"), "rs": ("rust", "rust"), "go": ("go", "go"), "json": ("json", "json"), "jsonc": ("json", "jsonc"),
    "yaml": ("yaml", "yaml"), "yml": ("yaml", "yaml"), "toml": ("toml", "toml"),
}


def embedded_surfaces(lines: DataFrame) -> DataFrame:
    """Fenced code blocks of lines whose info word stands for a family: doc_id, operation_id, address, path, language, family,
    dialect, start_line and end_line of the fence (end_line null where nothing closes it).

    Blocks are numbered from 0 among all of a document, operations among those with a family. Only fence lines reach the windows."""
    marks = fence_state(lines).where("is_fence")
    w = Window.partitionBy("doc_id").orderBy("line")
    opened = marks.withColumn("end_line", F.lead("line").over(w)).where("NOT in_fence").withColumn("block", F.row_number().over(w) - 1)
    word = F.lower(F.regexp_extract("text", r"^ {0,3}(?:`+|~+)[ \t]*([^ \t\r]*)", 1))
    table = F.create_map(*[x for k, (f, d) in FENCE_FAMILIES.items() for x in (F.lit(k), F.struct(F.lit(f).alias("family"), F.lit(d).alias("dialect")))])
    found = opened.withColumn("kind", table[word]).where("kind IS NOT NULL")
    path = F.concat(F.lit("/code_fence/"), "block")
    number = (F.row_number().over(w) - 1).cast("string")
    language = F.regexp_extract("text", r"^ {0,3}(?:`+|~+)[ \t]*([^ \t\r]*)", 1)
    return found.select("doc_id", F.concat(F.lit("markdown-fence-"), number).alias("operation_id"), F.concat(F.lit("document[0] > fenced_code_block["), path, F.lit("]")).alias("address"), path.alias("path"), language.alias("language"), "kind.family", "kind.dialect", F.col("line").alias("start_line"), "end_line")


def resolve_child_outputs(operations: DataFrame, outputs: DataFrame, prefix: str = "request", default_family: str = "text") -> tuple[DataFrame, DataFrame]:
    """(plan, errors): outputs (doc_id, output_index, address, output) meet operations (doc_id, operation_id, address, family, ...) by
    address. A document with an output of an unknown address has one error, that of the first, and no plan."""
    known = operations.select("doc_id", "address")
    missing = outputs.join(known, ["doc_id", "address"], "left_anti").groupBy("doc_id").agg(F.min_by("address", "output_index").alias("address"))
    good = outputs.join(missing.select("doc_id"), "doc_id", "left_anti").join(operations, ["doc_id", "address"])
    request = F.concat(F.lit(f"{prefix}:"), F.col("output_index").cast("string"))
    plan = good.select("doc_id", request.alias("request_id"), "output_index", "operation_id", "address", F.coalesce("family", F.lit(default_family)).alias("family"), "start_line", "end_line", "output")
    return plan, missing.select("doc_id", "address", F.lit("missing_surface").alias("code"))


def apply_child_outputs(lines: DataFrame, plan: DataFrame) -> DataFrame:
    """doc_id and text: lines of documents with the bodies of planned fences replaced by their outputs, each ended by a line break
    of the body's kind unless it is empty or has its own. Where a fence has several outputs, the last one counts. lines with byte
    places (doc_lines) keep the line break at a document's end."""
    spans = plan.groupBy("doc_id", "start_line").agg(F.max_by("end_line", "output_index").alias("end_line"), F.max_by("output", "output_index").alias("output"))
    owners = spans.select("doc_id", F.col("start_line").cast("string").alias("owner_id"), (F.col("start_line") + 1).alias("start_line"), (F.coalesce("end_line", F.lit(2147483647)) - 1).alias("end_line"))
    rows = _with_owner(lines, owners)
    crlf = rows.where("owner_id IS NOT NULL").groupBy("doc_id", F.col("owner_id").cast("int").alias("start_line")).agg(F.bool_or(F.endswith("text", F.lit("\r"))).alias("crlf"))
    body = F.when((F.col("output") == "") | F.endswith("output", F.lit("\n")) | F.endswith("output", F.lit("\r")), F.col("output")).otherwise(F.concat("output", F.when(F.col("crlf"), F.lit("\r\n")).otherwise(F.lit("\n"))))
    put = spans.join(crlf, ["doc_id", "start_line"], "left").withColumn("body", body)
    # A body stands behind its opening line; the break after its last line is its own.
    put = put.where("body <> ''").select("doc_id", F.col("start_line").alias("line"), F.lit(1).alias("k"), F.regexp_replace("body", r"\n\z", "").alias("text"))
    kept = rows.where("owner_id IS NULL").select("doc_id", "line", F.lit(0).alias("k"), "text")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "k", "text"))), lambda x: x.text), "\n")
    out = kept.unionByName(put).groupBy("doc_id").agg(text.alias("text"))
    if "end_byte" not in lines.columns:
        return out
    ended = lines.groupBy("doc_id").agg((F.max_by(F.col("end_byte") - F.col("start_byte") - F.octet_length("text"), "line") > 0).alias("ended"))
    return out.join(ended, "doc_id", "left").select("doc_id", F.when(F.col("ended"), F.concat("text", F.lit("\n"))).otherwise(F.col("text")).alias("text"))


def markdown_sections(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections, rejected): doc_id, section_id, level, title, start_line, end_line, text; and doc_id, reason.

    Sections begin at ATX headings outside fences. A document is rejected without headings, with
    headings of several levels, with text before the first, with a setext heading or with equal headings.
    """
    rows = fence_state(lines)
    heading = ~F.col("in_fence") & F.col("text").rlike(r"^ {0,3}#{1,6}([ \t]+.*)?$")
    w = Window.partitionBy("doc_id").orderBy("line")
    below = F.lag(F.when(~F.col("in_fence") & ~F.col("is_fence"), F.col("text"))).over(w)
    setext = ~F.col("in_fence") & F.col("text").rlike(r"^ {0,3}(=+|-+)[ \t]*$") & F.coalesce(F.trim(below) != "", F.lit(False)) & ~F.coalesce(below.rlike(r"^ {0,3}#{1,6}([ \t]|$)"), F.lit(False))
    rows = rows.withColumns({"heading": heading, "setext": setext})
    rows = rows.withColumn("section", F.sum(F.col("heading").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    level = F.length(F.regexp_extract("text", r"^ {0,3}(#+)", 1))
    title = F.trim(F.regexp_replace(F.regexp_replace("text", r"^ {0,3}#+[ \t]*", ""), r"[ \t]+#+[ \t]*$", ""))
    heads = rows.where("heading").select("doc_id", "section", F.col("line").alias("start_line"), level.alias("level"), title.alias("title"))
    twice = heads.groupBy("doc_id", "level", "title").agg(F.count("*").alias("n")).where("n > 1").select("doc_id").distinct().withColumn("twice", F.lit(True))
    shape = rows.groupBy("doc_id").agg(F.count_if("heading").alias("n"), F.min(F.when(F.col("heading"), F.col("line"))).alias("first"), F.count_if("setext").alias("setexts")).join(heads.groupBy("doc_id").agg(F.min("level").alias("lo"), F.max("level").alias("hi")), "doc_id", "left").join(twice, "doc_id", "left")
    reason = F.when(F.col("n") == 0, "no_headings").when(F.col("setexts") > 0, "setext_heading").when(F.col("lo") != F.col("hi"), "nested_headings").when(F.col("first") > 1, "text_before_first").when(F.col("twice"), "duplicate_heading")
    judged = shape.select("doc_id", reason.alias("reason"))
    good = judged.where("reason IS NULL").select("doc_id")
    bodies = rows.join(good, "doc_id", "left_semi").groupBy("doc_id", "section").agg(F.max("line").alias("end_line"), F.sort_array(F.collect_list(F.struct("line", "text"))).alias("ls"))
    sections = heads.join(bodies, ["doc_id", "section"]).select("doc_id", F.to_json(F.array(F.col("level").cast("string"), "title")).alias("section_id"), "level", "title", "start_line", "end_line", F.array_join(F.transform("ls", lambda x: x.text), "\n").alias("text"))
    return sections, judged.where("reason IS NOT NULL")


def layout_gaps(owners: DataFrame, docs: DataFrame) -> DataFrame:
    """Slots between owners (case_id, owner_id, start_byte, end_byte) of docs (case_id, text): one before each
    owner and one at the end, with before, after and controller owner and the digest of its bytes."""
    w = Window.partitionBy("case_id").orderBy("start_byte")
    before = owners.select("case_id", F.coalesce(F.lag("end_byte").over(w), F.lit(0)).cast("long").alias("start"), F.col("start_byte").cast("long").alias("end"), F.lag("owner_id").over(w).alias("before_owner"), F.col("owner_id").alias("after_owner"))
    final = owners.groupBy("case_id").agg(F.max(F.struct("end_byte", "owner_id")).alias("z"))
    size = docs.select("case_id", F.octet_length("text").cast("long").alias("n"))
    suffix = size.join(final, "case_id", "left").select("case_id", F.coalesce(F.col("z.end_byte"), F.lit(0)).cast("long").alias("start"), F.col("n").alias("end"), F.col("z.owner_id").alias("before_owner"), F.lit(None).cast(dict(owners.dtypes)["owner_id"]).alias("after_owner"))
    slots = before.unionByName(suffix).join(docs.select("case_id", F.encode("text", "utf-8").alias("raw")), "case_id")
    digest = F.sha2(F.expr("substring(raw, cast(start + 1 as int), cast(end - start as int))"), 256)
    return slots.select("case_id", "start", "end", "before_owner", "after_owner", F.coalesce("after_owner", "before_owner").alias("controller"), digest.alias("sha256"))


def blank_gaps(lines: DataFrame, owners: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Maximal runs of blank lines that touch an owner (doc_id, owner_id, start_line, end_line): doc_id,
    start_line, end_line, kind (preamble, postlude, interstitial), before, after, controller.

    The following owner controls a gap, else the one before; where that is in removed, the other does."""
    w = Window.partitionBy("doc_id").orderBy("line")
    blank = lines.where(F.trim("text") == "").select("doc_id", "line").withColumn("island", F.col("line") - F.row_number().over(w))
    runs = blank.groupBy("doc_id", "island").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line")).drop("island")
    before = owners.select("doc_id", (F.col("end_line") + 1).alias("start_line"), F.col("owner_id").alias("before_owner"))
    after = owners.select("doc_id", (F.col("start_line") - 1).alias("end_line"), F.col("owner_id").alias("after_owner"))
    gaps = runs.join(before, ["doc_id", "start_line"], "left").join(after, ["doc_id", "end_line"], "left").where("before_owner IS NOT NULL OR after_owner IS NOT NULL")
    kind = F.when(F.col("before_owner").isNull(), "preamble").when(F.col("after_owner").isNull(), "postlude").otherwise("interstitial")
    out = gaps.withColumns({"kind": kind, "controller": F.coalesce("after_owner", "before_owner")})
    if removed is not None:
        gone = removed.select("doc_id", F.col("owner_id").alias("controller"), F.lit(True).alias("gone"))
        other = F.when(F.col("controller").eqNullSafe(F.col("after_owner")), F.col("before_owner")).otherwise(F.col("after_owner"))
        out = out.join(gone, ["doc_id", "controller"], "left").withColumn("controller", F.when(F.col("gone"), other).otherwise(F.col("controller"))).drop("gone")
    return out.select("doc_id", "start_line", "end_line", "kind", "before_owner", "after_owner", "controller")


def _with_owner(lines: DataFrame, owners: DataFrame) -> DataFrame:
    """lines with the owner that covers them, by the last owner start at or before: no range join."""
    starts = owners.select("doc_id", F.col("start_line").alias("line"), F.lit(0).alias("k"), F.struct("owner_id", "end_line").alias("o"), F.lit(None).cast("string").alias("text"))
    both = lines.select("doc_id", "line", F.lit(1).alias("k"), F.lit(None).cast(starts.schema["o"].dataType).alias("o"), "text").unionByName(starts)
    last = F.last("o", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line", "k").rowsBetween(Window.unboundedPreceding, 0))
    rows = both.withColumn("near", last).where("k = 1")
    return rows.select("doc_id", "line", "text", F.when(F.col("near.end_line") >= F.col("line"), F.col("near.owner_id")).alias("owner_id"))


def line_ownership(lines: DataFrame, owners: DataFrame, gaps: DataFrame) -> DataFrame:
    """Every line's kind: structural_owner, layout_gap or unmanaged, with its owner (a gap's controller)."""
    rows = _with_owner(lines, owners)
    spans = gaps.select("doc_id", F.explode(F.sequence("start_line", "end_line")).alias("line"), "controller")
    rows = rows.join(spans, ["doc_id", "line"], "left")
    kind = F.when(F.col("owner_id").isNotNull(), "structural_owner").when(F.col("controller").isNotNull(), "layout_gap").otherwise("unmanaged")
    return rows.select("doc_id", "line", kind.alias("kind"), F.coalesce("owner_id", "controller").alias("owner_id"))


def unmanaged_fingerprint(lines: DataFrame, owners: DataFrame) -> DataFrame:
    """doc_id, n_lines and digest of the lines outside every owner, in order."""
    free = _with_owner(lines, owners).where("owner_id IS NULL")
    return free.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x.text), "\n"), 256).alias("digest"))


def freeze_blocks(lines: DataFrame, token: str, style: str = "hash_comment") -> tuple[DataFrame, DataFrame]:
    """(blocks, diagnostics) of `token:freeze` ... `token:unfreeze` comments; any fault voids a document's blocks."""
    shapes = {"hash_comment": r"^#(.*)$", "c_style_line": r"^//(.*)$", "html_comment": r"^<!--(.*)-->$", "c_style_block": r"^/\*(.*)\*/$"}
    content = F.trim(F.regexp_extract(F.trim("text"), shapes[style], 1))
    mark = r"^\Q" + token.lower().replace("\\E", r"\E\\E\Q") + r"\E:\s*"
    found = F.regexp_extract(F.lower(content), mark + "(unfreeze|freeze)", 1)
    marks = lines.withColumn("action", found).where("action <> ''").withColumn("reason", F.trim(F.regexp_replace(content, f"(?i){mark}(unfreeze|freeze)", "")))
    w, whole = Window.partitionBy("doc_id").orderBy("line"), Window.partitionBy("doc_id")
    prev = F.lag("action").over(w)
    fault = F.when((F.col("action") == "freeze") & (prev == "freeze"), "nested_freeze_open").when((F.col("action") == "unfreeze") & (prev.isNull() | (prev == "unfreeze")), "unmatched_freeze_close")
    closed = F.max(F.when(F.col("action") == "unfreeze", F.col("line"))).over(whole)
    rows = marks.withColumns({"category": fault, "end_line": F.lead("line").over(w), "closed": closed})
    # An open that no close follows is told at the line that opened it, also where others are nested in it.
    unclosed = rows.where("line > coalesce(closed, 0)").groupBy("doc_id").agg(F.min("line").alias("line")).select("doc_id", F.lit("unclosed_freeze_open").alias("category"), "line")
    bad = rows.where("category IS NOT NULL").select("doc_id", "category", "line").unionByName(unclosed)
    blocks = rows.where("action = 'freeze'").join(bad.select("doc_id").distinct(), "doc_id", "left_anti")
    return blocks.select("doc_id", F.col("line").alias("start_line"), "end_line", "reason"), bad


def freeze_block_of_lines(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """lines (doc_id, line) with start_line and end_line of the freeze block that holds them, null outside."""
    owners = blocks.select("doc_id", F.concat_ws("-", "start_line", "end_line").alias("owner_id"), "start_line", "end_line")
    rows = _with_owner(lines.select("doc_id", "line", F.lit(None).cast("string").alias("text")), owners)
    part = lambda k: F.split("owner_id", "-")[k].cast("int")
    return rows.select("doc_id", "line", part(0).alias("start_line"), part(1).alias("end_line"))


def conflict_regions(lines: DataFrame, marker_size: int = 7, max_bytes: int = MAX_REVIEW_BYTES, max_regions: int = MAX_REVIEW_REGIONS) -> tuple[DataFrame, DataFrame]:
    """(regions, errors) of Git conflict markers in lines of doc_lines(); only marker lines reach the window.

    A region has its lines and the byte ranges of ours, base (null without) and theirs, without the markers. Nothing may
    follow the signs of a separator; a space or tab may follow the others. A byte order mark before the first
    marker belongs to the document. A document with nested, missing or misordered markers, too many bytes or too many
    regions has one error (its first, with code and line) and no regions."""
    if not 1 <= marker_size <= 128:
        raise ValueError("marker size must be between 1 and 128")
    bom = F.when((F.col("line") == 1) & F.startswith("text", F.lit("\ufeff")), 3).otherwise(0)
    bare = F.regexp_replace(F.when(bom > 0, F.expr("substring(text, 2)")).otherwise(F.col("text")), "\r$", "")
    shape = lambda c, rest=r"([ \t][\s\S]*)?": bare.rlike(f"^{c}{{{marker_size}}}{rest}$")
    kind = F.when(shape("<"), "<").when(shape(r"\|"), "|").when(shape("=", ""), "=").when(shape(">"), ">")
    large = lines.where(F.col("end_byte") > max_bytes).select("doc_id").distinct().select("doc_id", F.lit(None).cast("int").alias("line"), F.lit("input_limit").alias("code"))
    marks = lines.withColumns({"kind": kind, "start_byte": F.col("start_byte") + bom}).where("kind IS NOT NULL").join(large.select("doc_id"), "doc_id", "left_anti")
    w = Window.partitionBy("doc_id").orderBy("line")
    prev = F.lag("kind").over(w)
    ok = (
        F.when(F.col("kind") == "<", prev.isNull() | (prev == ">")).when(F.col("kind") == "|", F.coalesce(prev == "<", F.lit(False)))
        .when(F.col("kind") == "=", F.coalesce(prev.isin("<", "|"), F.lit(False))).otherwise(F.coalesce(prev == "=", F.lit(False)))
    )
    region = F.sum((F.col("kind") == "<").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    opened = F.last(F.when(F.col("kind") == "<", F.col("line")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = marks.withColumns({"ok": ok, "open": (F.col("kind") != ">") & F.lead("kind").over(w).isNull(), "region": region, "opened": opened})
    # The first error in reading order; an open end is found last, and told at the line that opened it.
    code = F.when(~F.col("ok"), "invalid_markers").when((F.col("kind") == "<") & (F.col("region") >= max_regions), "region_limit")
    faults = rows.select("doc_id", F.when(code.isNotNull(), F.struct(F.col("line").alias("at"), F.col("line"), code.alias("code"))).when(F.col("open"), F.struct(F.lit(2147483647).alias("at"), F.col("opened").alias("line"), F.lit("invalid_markers").alias("code"))).alias("f"))
    errors = faults.where("f IS NOT NULL").groupBy("doc_id").agg(F.min("f").alias("f")).select("doc_id", "f.line", "f.code").unionByName(large)
    at = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    good = rows.join(errors.select("doc_id"), "doc_id", "left_anti").groupBy("doc_id", "region").agg(
        at("<", "line").alias("start_line"), at("=", "line").alias("separator_line"), at(">", "line").alias("end_line"), at("|", "line").alias("base_line"),
        at("<", "start_byte").alias("start_byte"), at(">", "end_byte").alias("end_byte"), at("<", "end_byte").alias("ours_start"), F.coalesce(at("|", "start_byte"), at("=", "start_byte")).alias("ours_end"),
        at("|", "end_byte").alias("base_start"), F.when(at("|", "line").isNotNull(), at("=", "start_byte")).alias("base_end"), at("=", "end_byte").alias("theirs_start"), at(">", "start_byte").alias("theirs_end"),
    )
    return good, errors


def json_owners(docs: DataFrame, column: str, max_depth: int = 8) -> DataFrame:
    """doc_id, path (JSON pointer), kind (member, element), match_key (the member's name, else the element's place), parent
    (the path above), depth, node (object, array, scalar), value as JSON and cut.

    Levels are unrolled one by one, each a lateral explode without a shuffle; documents that are no JSON give one row with
    kind parse_error. Containers at the last level that are not empty have cut true: what is below them has no rows but
    is whole in their value."""
    base = docs.select("doc_id", F.try_parse_json(F.col(column)).alias("v"))
    view = "{rows}"
    spark = docs.sparkSession
    level = base.where("v IS NOT NULL").select("doc_id", F.lit("").alias("path"), "v")
    none = F.lit(None).cast("string")
    out = base.where("v IS NULL").select("doc_id", F.lit("").alias("path"), F.lit("parse_error").alias("kind"), none.alias("match_key"), none.alias("parent"), F.lit(0).alias("depth"), none.alias("node"), none.alias("value"), F.lit(False).alias("cut"))
    for depth in range(1, max_depth + 1):
        rows = spark.sql(f"SELECT doc_id, path AS parent, e.pos AS pos, e.key AS key, e.value AS v FROM {view}, LATERAL variant_explode(v) e", rows=level)
        key = F.coalesce("key", F.col("pos").cast("string"))
        name = F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
        kind = F.schema_of_variant("v")
        node = F.when(F.startswith(kind, F.lit("OBJECT")), "object").when(F.startswith(kind, F.lit("ARRAY")), "array").otherwise("scalar")
        value = F.to_json("v")
        cut = (node != "scalar") & ~value.isin("{}", "[]") if depth == max_depth else F.lit(False)
        rows = rows.select("doc_id", F.concat("parent", F.lit("/"), name).alias("path"), F.when(F.col("key").isNull(), "element").otherwise("member").alias("kind"), key.alias("match_key"), "parent", F.lit(depth).alias("depth"), node.alias("node"), value.alias("value"), cut.alias("cut"), "v")
        out = out.unionByName(rows.drop("v"))
        level = rows.where("node <> 'scalar'").select("doc_id", "path", "v")
    return out


def json_equivalent(a: Column, b: Column) -> Column:
    """True where two JSON texts mean the same, whatever their layout and key order; null where one is no JSON."""
    return F.to_json(F.try_parse_json(a)) == F.to_json(F.try_parse_json(b))


@dataclass(frozen=True)
class TokenShape:
    """What a token looks like: pre, segments of one class of characters parted by separators (the last one again
    where there are more), post. Fixed values by default."""

    pre: str = "{"
    post: str = "}"
    separators: tuple[str, ...] = ("|", ":")
    min_segments: int = 2
    max_segments: int | None = None
    segment: str = "[A-Za-z0-9_]"

    def key_pattern(self) -> str:
        """The pattern of a whole key."""
        most, part = self.max_segments, f"{self.segment}+"
        named = [re.escape(s) + part for s in self.separators[: None if most is None else max(0, most - 1)]]
        more = max(0, (most or 0) - 1 - len(self.separators)) if most is not None else None
        tail = f"(?:{re.escape(self.separators[-1])}{part})" + ("*" if more is None else f"{{0,{more}}}")
        out = tail
        for k in range(len(named) - 1, -1, -1):
            # The first min_segments - 1 separators must be there.
            out = f"(?:{named[k]}{out})" + ("" if k + 1 < self.min_segments else "?")
        short = max(0, self.min_segments - 1 - len(named))
        if short:
            raise ValueError("min_segments beyond the listed separators are not supported")
        return f"^{part}{out}$"


def token_keys(text: Column, shape: TokenShape = TokenShape()) -> Column:  # noqa: B008
    """Distinct keys of a text's tokens in first-seen order. A token runs from pre to the first post after it, and the
    next is looked for behind it, whether its key is valid or not."""
    found = F.regexp_extract_all(text, F.lit(f"(?s){re.escape(shape.pre)}(.*?){re.escape(shape.post)}"), 1)
    return F.array_distinct(F.filter(found, lambda k: k.rlike(shape.key_pattern())))


def template_tokens(docs: DataFrame, shape: TokenShape = TokenShape()) -> DataFrame:  # noqa: B008
    """doc_id, keys: distinct tokens of docs (doc_id, text), in first-seen order."""
    return docs.select("doc_id", token_keys(F.coalesce("text", F.lit("")), shape).alias("keys"))


def resolve_template_tokens(docs: DataFrame, replacements: DataFrame, shape: TokenShape = TokenShape()) -> DataFrame:  # noqa: B008
    """docs (doc_id, text, strategy, destination_path), replacements (key, replacement) -> doc_id, unresolved keys,
    blocked, text: tokens replaced one key after the other, null where blocked.

    Keys meet their replacements by an equi-join on the key. Kept destinations, raw copies and omitted entries (no
    destination) need no replacement: their text stays."""
    rows = docs.withColumn("keys", token_keys(F.coalesce("text", F.lit("")), shape))
    wanted = rows.select("doc_id", F.explode("keys").alias("key")).join(replacements.dropDuplicates(["key"]), "key").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "replacement"))).alias("known"))
    rows = rows.join(wanted, "doc_id", "left").withColumn("known", F.coalesce("known", F.create_map().cast("map<string,string>")))
    unresolved = F.filter("keys", lambda k: ~F.map_contains_key("known", k))
    needed = F.col("destination_path").isNotNull() & ~F.coalesce(F.col("strategy").isin("keep_destination", "raw_copy"), F.lit(False))
    replaced = F.aggregate("keys", F.coalesce("text", F.lit("")), lambda s, k: F.when(F.map_contains_key("known", k), F.replace(s, F.concat(F.lit(shape.pre), k, F.lit(shape.post)), F.element_at("known", k))).otherwise(s))
    blocked = needed & (F.size(unresolved) > 0)
    return rows.select("doc_id", unresolved.alias("unresolved"), blocked.alias("blocked"), F.when(blocked, F.lit(None)).when(needed, replaced).otherwise(F.coalesce("text", F.lit(""))).alias("text"))


def validate_owners(owners: DataFrame) -> DataFrame:
    """case_id, owner_id, violation: empty_id, duplicate_id, byte_range, overlap, line_range."""
    w = Window.partitionBy("case_id").orderBy("start_byte", "end_byte", "owner_id")
    reach = F.max("end_byte").over(w.rowsBetween(Window.unboundedPreceding, -1))
    faults = {
        "empty_id": F.coalesce(F.col("owner_id").cast("string"), F.lit("")) == "",
        "duplicate_id": F.count("*").over(Window.partitionBy("case_id", "owner_id")) > 1,
        "byte_range": (F.col("start_byte") < 0) | (F.col("end_byte") <= F.col("start_byte")),
        "overlap": F.coalesce(reach > F.col("start_byte"), F.lit(False)),
        "line_range": (F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")),
    }
    rows = owners.withColumn("violations", F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in faults.items()])))
    return rows.select("case_id", "owner_id", F.explode("violations").alias("violation"))


def apply_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs (doc_id, text) under edits (doc_id, start_byte, end_byte, replacement): text or error.

    Edits of a document are laid between kept slices and joined in order; a bad range, an overlap or two
    edits at one place reject the document. Byte places are in UTF-8."""
    w = Window.partitionBy("doc_id").orderBy("start_byte", "end_byte")
    raw = docs.select("doc_id", F.encode("text", "utf-8").alias("raw"))
    rows = edits.join(raw, "doc_id").withColumns({"prev_end": F.coalesce(F.lag("end_byte").over(w), F.lit(0)), "prev_start": F.lag("start_byte").over(w)})
    n = F.octet_length("raw")
    boundary = lambda c: (F.col(c) < n) & (F.expr(f"conv(hex(substring(raw, cast({c} + 1 as int), 1)), 16, 10)").cast("int").between(128, 191))
    error = (
        F.when(F.col("start_byte").isNull() | F.col("end_byte").isNull() | (F.col("start_byte") < 0) | (F.col("end_byte") < F.col("start_byte")) | (F.col("end_byte") > n), "range")
        .when(boundary("start_byte") | boundary("end_byte"), "char_boundary")
        .when(F.coalesce(F.col("prev_start") == F.col("start_byte"), F.lit(False)), "equal_start")
        .when(F.col("prev_end") > F.col("start_byte"), "overlap")
    )
    kept = F.expr("substring(raw, cast(prev_end + 1 as int), cast(start_byte - prev_end as int))")
    rows = rows.withColumns({"error": error, "piece": F.concat(kept, F.encode("replacement", "utf-8"))})
    done = rows.groupBy("doc_id").agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.coalesce("start_byte", F.lit(-1)))).alias("error"), F.max("end_byte").alias("reach"), F.sort_array(F.collect_list(F.struct("start_byte", "piece"))).alias("pieces"))
    out = docs.select("doc_id", F.encode("text", "utf-8").alias("raw")).join(done, "doc_id", "left")
    tail = F.expr("substring(raw, cast(reach + 1 as int), octet_length(raw))")
    joined = F.aggregate(F.transform("pieces", lambda p: p.piece), F.lit(b""), lambda s, p: F.concat(s, p))
    text = F.when(F.col("pieces").isNull(), F.decode("raw", "utf-8")).when(F.col("error").isNull(), F.decode(F.concat(joined, tail), "utf-8"))
    return out.select("doc_id", text.alias("text"), "error")
