"""Comments of documents, attached to owners or to the document, and the one disposition of every line.

Lines are rows (doc_id, line from 1, text); owners (doc_id, owner_id, start_line, end_line, optionally indent) do not
overlap; comments (doc_id, line, full_line, optionally indent, root_scope, structural_prefix) come from an analyzer. Only comments,
blank lines and owner edges enter the windows of a document, not its other lines; dispositions are made by equi-joins
on (doc_id, line), so that a giant document is spread over its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ownerloom.sources.scratch import spread, written

POLICIES = ("preceding_owner", "following_owner")
ATTACHED = ("leading", "inline", "trailing")
ROOT = ("preamble", "postlude", "orphan")


def is_blank(text: str = "text") -> Column:
    """The line has nothing but Unicode white space."""
    return F.col(text).rlike(r"(?U)^\s*$")


def _or_null(df: DataFrame, name: str, kind: str, default=None) -> Column:
    return F.coalesce(F.col(name).cast(kind), F.lit(default).cast(kind)) if name in df.columns else F.lit(default).cast(kind)


def _placed(lines: DataFrame, owners: DataFrame, comments: DataFrame, n: int) -> DataFrame:
    """Every comment with what lies around it, dealt by document for about n rows.

    filled and blanks: how many lines up to it are blank or an owner-scoped full-line comment, and how many are blank; two
    such lines touch if their distance is that of their filled. before: the last owner that ends above; opened: the last that begins
    at or above; after: the next that begins below. last_blank, first_blank, first_owner, last_owner: lines."""
    indent = _or_null(owners, "indent", "int")
    none = lambda kind: F.lit(None).cast(kind)
    shape = lambda df, line, k, mark, owner=None, **more: df.select(
        "doc_id", line.cast("int").alias("line"), F.lit(k).alias("k"), F.lit(mark).alias("mark"),
        (F.struct(F.col("owner_id").cast("string").alias("owner_id"), F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), indent.alias("indent")) if owner else none("struct<owner_id:string,start_line:int,end_line:int,indent:int>")).alias("owner"),
        more.get("full", none("boolean")).alias("full_line"), more.get("indent", none("int")).alias("indent"), more.get("root", F.lit(False)).alias("root_scope"), more.get("prefix", F.lit(False)).alias("structural_prefix"),
    )
    rows = shape(owners, F.col("start_line"), 0, "start", owner=True)
    rows = rows.unionByName(shape(owners, F.col("end_line"), 2, "end", owner=True))
    rows = rows.unionByName(shape(lines.where(is_blank()), F.col("line"), 1, "blank"))
    rows = rows.unionByName(shape(comments, F.col("line"), 1, "comment", full=F.col("full_line"), indent=_or_null(comments, "indent", "int"), root=_or_null(comments, "root_scope", "boolean", False), prefix=_or_null(comments, "structural_prefix", "boolean", False)))
    rows = spread(rows, n, "doc_id")
    up = Window.partitionBy("doc_id").orderBy("line", "k").rowsBetween(Window.unboundedPreceding, 0)
    down, whole = Window.partitionBy("doc_id").orderBy("line", "k").rowsBetween(0, Window.unboundedFollowing), Window.partitionBy("doc_id")
    is_ = lambda mark: F.col("mark") == mark
    run = (is_("comment") & F.col("full_line") & ~F.col("root_scope")) | is_("blank")
    rows = rows.withColumns({"filled": F.sum(run.cast("int")).over(up), "blanks": F.sum(is_("blank").cast("int")).over(up)})
    edge = F.when(F.col("owner").isNotNull(), F.struct("owner.*", "filled", "blanks"))
    rows = rows.withColumn("edge", edge)
    rows = rows.withColumns(
        {
            "before": F.last(F.when(is_("end"), F.col("edge")), ignorenulls=True).over(up),
            "opened": F.last(F.when(is_("start"), F.col("edge")), ignorenulls=True).over(up),
            "after": F.first(F.when(is_("start"), F.col("edge")), ignorenulls=True).over(down),
            "last_blank": F.last(F.when(is_("blank"), F.col("line")), ignorenulls=True).over(up),
            "first_blank": F.min(F.when(is_("blank"), F.col("line"))).over(whole),
            "first_owner": F.min(F.when(is_("start"), F.col("line"))).over(whole),
            "last_owner": F.max(F.when(is_("end"), F.col("line"))).over(whole),
        }
    )
    return rows.where(is_("comment"))


def attach_comments(lines: DataFrame, owners: DataFrame, comments: DataFrame, policy: str = "preceding_owner") -> DataFrame:
    """doc_id, region_id, kind, owner_id (null in regions of the document), selection_key, start_line, end_line, n_comments, floating.

    inline: comments beside code within an owner. trailing (preceding_owner alone): the run that begins right under an
    owner, as long as indents that are known agree. leading: the run that ends right above the next owner, of what no
    trailing run has; blank lines part a run unless the policy is preceding_owner or a structural prefix stands beside them; a
    run from line 1 on stays with the document up to the first blank line. What is left, full lines only: below the last
    owner postlude; else groups parted by anything but blank lines, of which the first is the preamble if it ends above all
    owners (from line 1 on up to its last blank line), and others are orphans, numbered in the document's order."""
    if policy not in POLICIES:
        raise ValueError(f"unknown attachment policy {policy!r}")
    preceding = policy == "preceding_owner"
    # A line gives a blank or a comment, or an owner's start and end.
    n = 2 * lines.count()
    rows = _placed(lines, owners, comments, n)
    inline = rows.where(~F.col("full_line") & ~F.col("root_scope") & (F.col("opened.end_line") >= F.col("line")))
    full = rows.where("full_line")

    # Trailing: touching the line under the owner before, and no owner has begun since.
    under = F.lit(preceding) & ~F.col("root_scope") & (F.coalesce(F.col("opened.start_line"), F.lit(0)) <= F.col("before.end_line")) & (F.col("filled") - F.col("before.filled") == F.col("line") - F.col("before.end_line"))
    full = full.withColumn("under", F.coalesce(under, F.lit(False)))
    of_before = Window.partitionBy("doc_id", "under", "before.owner_id").orderBy("line")
    parted = F.coalesce(F.col("indent") != F.col("before.indent"), F.lit(False))
    begins = F.min("line").over(of_before.rowsBetween(Window.unboundedPreceding, 0)) == F.col("before.end_line") + 1
    full = full.withColumn("trailing", F.col("under") & begins & (F.sum(parted.cast("int")).over(of_before.rowsBetween(Window.unboundedPreceding, 0)) == 0))

    # Leading: every step from the comment down to the owner touches, over blank lines where that is allowed.
    full = full.withColumn("open", ~F.col("trailing") & ~F.col("root_scope") & F.col("after").isNotNull())
    of_after = Window.partitionBy("doc_id", "open", "after.owner_id").orderBy("line")
    below = lambda c, at_owner: F.coalesce(F.lead(c).over(of_after), at_owner)
    distance = below("line", F.col("after.start_line")) - F.col("line")
    touches = below("filled", F.col("after.filled") + 1) - F.col("filled") == distance
    over_blank = F.lit(preceding) | F.col("structural_prefix") | F.coalesce(F.lead("structural_prefix").over(of_after), F.lit(False))
    full = full.withColumn("step", touches & ((distance == 1) | over_blank))
    full = full.withColumn("chosen", F.col("open") & F.min("step").over(of_after.rowsBetween(0, Window.unboundedFollowing)))
    of_chosen = Window.partitionBy("doc_id", "chosen", "after.owner_id")
    header = (F.min("line").over(of_chosen) == 1) & F.coalesce(F.col("first_blank") < F.col("after.start_line"), F.lit(False))
    full = full.withColumn("leading", F.col("chosen") & (~header | (F.col("line") > F.col("first_blank"))))
    full = full.withColumn("floats", F.col("leading") & (F.col("after.start_line") - F.max(F.when(F.col("leading"), F.col("line"))).over(of_chosen) > 1))

    # The document's own: a group goes on over blank lines.
    full = full.withColumn("postlude", ~F.col("trailing") & ~F.col("leading") & ~F.col("root_scope") & F.coalesce(F.col("line") > F.col("last_owner"), F.lit(False)))
    full = full.withColumn("rest", ~F.col("trailing") & ~F.col("leading") & ~F.col("postlude"))
    of_rest = Window.partitionBy("doc_id", "rest").orderBy("line")
    apart = F.coalesce(F.col("line") - F.lag("line").over(of_rest) - 1 != F.col("blanks") - F.lag("blanks").over(of_rest), F.lit(True))
    full = full.withColumn("group", F.sum(apart.cast("int")).over(of_rest.rowsBetween(Window.unboundedPreceding, 0)))
    of_group = Window.partitionBy("doc_id", "rest", "group")
    first, last = F.min("line").over(of_group), F.max("line").over(of_group)
    cut = F.max("last_blank").over(of_group)
    full = full.withColumns({"is_head": (F.col("group") == 1) & F.coalesce(last < F.col("first_owner"), F.lit(False)), "cut": F.when((first == 1) & (cut > first), cut)})
    kind = F.when(F.col("trailing"), "trailing").when(F.col("leading"), "leading").when(F.col("postlude"), "postlude").when(F.col("is_head") & (F.col("cut").isNull() | (F.col("line") < F.col("cut"))), "preamble").otherwise("orphan")
    owner = F.when(F.col("trailing"), F.col("before.owner_id")).when(F.col("leading"), F.col("after.owner_id"))
    parts = full.select("doc_id", kind.alias("kind"), owner.alias("owner_id"), F.when(F.col("rest"), F.col("group")).alias("group"), "line", "floats")
    parts = parts.unionByName(inline.select("doc_id", F.lit("inline").alias("kind"), F.col("opened.owner_id").alias("owner_id"), F.lit(None).cast("long").alias("group"), "line", F.lit(False).alias("floats")))
    regions = spread(parts, n, "doc_id").groupBy("doc_id", "kind", "owner_id", "group").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.count("*").alias("n_comments"), F.bool_or("floats").alias("floating"))
    orphan = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("start_line")) - 1
    key = F.when(F.col("owner_id").isNotNull(), F.concat_ws(":", F.lit("comment"), "owner_id", "kind")).when(F.col("kind") == "orphan", F.concat(F.lit("root:orphan:"), orphan)).otherwise(F.concat(F.lit("root:"), "kind"))
    name = F.concat(F.lit("comment-region:"), "kind", F.lit(":"), "start_line", F.lit("-"), "end_line")
    return regions.select("doc_id", name.alias("region_id"), "kind", "owner_id", key.alias("selection_key"), "start_line", "end_line", "n_comments", "floating")


def edge_gaps(lines: DataFrame, owners: DataFrame, regions: DataFrame) -> DataFrame:
    """Maximal runs of blank lines that touch an owner or a region attached outside of its owner: doc_id, gap_id, kind
    (preamble, interstitial, postlude), start_line, end_line, before_owner, after_owner, controller_side, controller, selection_key.

    What follows controls a gap, unless an owner ends right above it and only a leading comment begins below."""
    w = Window.partitionBy("doc_id").orderBy("line")
    blank = lines.where(is_blank()).select("doc_id", "line").withColumn("island", F.col("line") - F.row_number().over(w))
    runs = blank.groupBy("doc_id", "island").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line")).drop("island")
    own = owners.select("doc_id", F.col("owner_id").cast("string").alias("owner_id"), F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    outside = regions.where(F.col("kind").isin("leading", "trailing")).join(own, ["doc_id", "owner_id"])
    outside = outside.where(((F.col("kind") == "leading") & (F.col("end_line") < F.col("s"))) | ((F.col("kind") == "trailing") & (F.col("start_line") > F.col("e"))))
    edge = lambda df, line, name, alias: df.groupBy("doc_id", line.alias(name)).agg(F.min("owner_id").alias(alias))
    gaps = runs.join(edge(own, F.col("e") + 1, "start_line", "above"), ["doc_id", "start_line"], "left").join(edge(own, F.col("s") - 1, "end_line", "below"), ["doc_id", "end_line"], "left")
    gaps = gaps.join(edge(outside.where("kind = 'trailing'"), F.col("end_line") + 1, "start_line", "above_comment"), ["doc_id", "start_line"], "left")
    gaps = gaps.join(edge(outside.where("kind = 'leading'"), F.col("start_line") - 1, "end_line", "below_comment"), ["doc_id", "end_line"], "left")
    before, after = F.coalesce("above", "above_comment"), F.coalesce("below", "below_comment")
    gaps = gaps.withColumns({"before_owner": before, "after_owner": after}).where("before_owner IS NOT NULL OR after_owner IS NOT NULL")
    kind = F.when(F.col("before_owner").isNull(), "preamble").when(F.col("after_owner").isNull(), "postlude").otherwise("interstitial")
    side = F.when(F.col("after_owner").isNull() | (F.col("above").isNotNull() & F.col("below").isNull() & F.col("below_comment").isNotNull()), "before").otherwise("after")
    gaps = gaps.withColumns({"kind": kind, "controller_side": side})
    key = F.concat_ws(":", F.lit("gap"), "kind", F.coalesce("before_owner", F.lit("root")), F.coalesce("after_owner", F.lit("root")))
    name = F.concat(F.lit("layout-gap:"), "start_line", F.lit("-"), "end_line")
    controller = F.when(F.col("controller_side") == "before", F.col("before_owner")).otherwise(F.col("after_owner"))
    return gaps.select("doc_id", name.alias("gap_id"), "kind", "start_line", "end_line", "before_owner", "after_owner", "controller_side", controller.alias("controller"), key.alias("selection_key"))


def regions_in_owners(regions: DataFrame, owners: DataFrame) -> DataFrame:
    """regions, those of an owner that lie within another owner's lines given to that one (an as-of window, no range join)."""
    own = owners.select("doc_id", F.col("start_line").alias("line"), F.lit(0).alias("k"), F.struct(F.col("owner_id").cast("string").alias("id"), "end_line").alias("o"), F.lit(None).cast(regions.select(F.struct("*").alias("r")).schema["r"].dataType).alias("r"))
    both = regions.select("doc_id", F.col("start_line").alias("line"), F.lit(1).alias("k"), F.lit(None).cast(own.schema["o"].dataType).alias("o"), F.struct("*").alias("r")).unionByName(own)
    near = F.last("o", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line", "k").rowsBetween(Window.unboundedPreceding, 0))
    rows = both.withColumn("near", near).where("k = 1").select("r.*", F.when(F.col("near.end_line") >= F.col("r.end_line"), F.col("near.id")).alias("within"))
    moved = F.col("owner_id").isNotNull() & F.col("within").isNotNull()
    key = F.when(moved, F.concat_ws(":", F.lit("comment"), "within", "kind")).otherwise(F.col("selection_key"))
    return rows.withColumns({"selection_key": key, "owner_id": F.when(moved, F.col("within")).otherwise(F.col("owner_id"))}).drop("within")


def line_dispositions(lines: DataFrame, owners: DataFrame, regions: DataFrame, gaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, errors). lines: doc_id, line, kind (structural_owner, comment_owner, root_region, layout_gap, unmanaged), selection_key,
    owner_id, region_ids, comment_kind, root_kind, gap_id, controller. errors: doc_id, code, subject.

    Each line has one disposition; comments within their own owner, and regions of the document within any, are added to the
    owner's. A document with an error has no dispositions. Codes: *_identity (empty or twice), *_range, owner_overlap, region_owner, region_kind,
    region_conflict, gap_edges, gap_owner, gap_controller, gap_not_blank, gap_conflict; subject is an id or a line."""
    size = lines.groupBy("doc_id").agg(F.max("line").alias("n"))
    own = owners.select("doc_id", F.col("owner_id").cast("string").alias("owner_id"), "start_line", "end_line")
    code = lambda name, test: F.when(F.coalesce(test, F.lit(False)), F.lit(name))

    def judged(df: DataFrame, what: str, name: str, *more: Column) -> DataFrame:
        """df with fits (a sound place) and codes, the errors that its row has."""
        rows = df.join(size, "doc_id", "left").withColumn("fits", F.coalesce((F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line")) & (F.col("end_line") <= F.col("n")), F.lit(False)))
        named = F.col(name).isNull() | (F.col(name) == "") | (F.count("*").over(Window.partitionBy("doc_id", name)) > 1)
        return rows.withColumn("codes", F.array_compact(F.array(code(f"{what}_range", ~F.col("fits")), code(f"{what}_identity", named), *more))).drop("n")

    told = lambda df, subject: df.select("doc_id", F.explode("codes").alias("code"), F.col(subject).cast("string").alias("subject"))
    names = own.select("doc_id", F.col("owner_id").alias("known")).distinct()

    def known(df: DataFrame, column: str) -> DataFrame:
        """df with unknown_<column>: it names an owner that the document does not have."""
        found = names.withColumnsRenamed({"known": column}).withColumn("there", F.lit(True))
        return df.join(found, ["doc_id", column], "left").withColumn(f"unknown_{column}", F.col(column).isNotNull() & F.col("there").isNull()).drop("there")

    reach = F.max("end_line").over(Window.partitionBy("doc_id").orderBy("start_line", "end_line", "owner_id").rowsBetween(Window.unboundedPreceding, -1))
    own = judged(own.withColumn("reach", reach), "owner", "owner_id", code("owner_overlap", F.col("reach") >= F.col("start_line")))
    of_region = F.when(F.col("owner_id").isNull(), F.col("kind").isin(*ROOT)).otherwise(F.col("kind").isin(*ATTACHED))
    regions = judged(known(regions, "owner_id"), "region", "region_id", code("region_owner", F.col("unknown_owner_id")), code("region_kind", ~of_region))
    expected = F.when(F.col("controller_side") == "before", F.col("before_owner")).when(F.col("controller_side") == "after", F.col("after_owner"))
    edges = ~F.col("kind").isin("preamble", "interstitial", "postlude") | (F.col("before_owner").isNull() & F.col("after_owner").isNull())
    strange = F.col("unknown_before_owner") | F.col("unknown_after_owner")
    gaps = judged(known(known(gaps, "before_owner"), "after_owner"), "gap", "gap_id", code("gap_edges", edges), code("gap_owner", strange), code("gap_controller", F.coalesce(expected != F.col("controller"), F.lit(True))))

    each = lambda df: df.where("fits").withColumn("line", F.explode(F.sequence("start_line", "end_line")))
    of_line = each(own).groupBy("doc_id", "line").agg(F.min("owner_id").alias("own"))
    # A region of the document counts as contained where all its lines have one owner.
    whole = Window.partitionBy("doc_id", "r.region_id")
    covered = each(regions).select("doc_id", "line", F.struct("start_line", "region_id", "kind", "owner_id", "selection_key").alias("r")).join(of_line, ["doc_id", "line"], "left")
    inside = F.col("r.owner_id").isNull() & (F.count("own").over(whole) == F.count("*").over(whole)) & (F.min("own").over(whole) == F.max("own").over(whole))
    per_line = covered.withColumn("inside", F.coalesce(inside, F.lit(False))).groupBy("doc_id", "line").agg(F.sort_array(F.collect_list(F.struct("r.start_line", "r.region_id", "r.kind", "r.owner_id", "r.selection_key", "inside"))).alias("rs"))
    in_gap = each(gaps).groupBy("doc_id", "line").agg(F.count("*").alias("n_gaps"), F.first(F.struct("gap_id", "selection_key", "controller")).alias("g"))
    rows = spread(lines.select("doc_id", "line", is_blank().alias("blank")), lines.count(), "doc_id", "line").join(of_line, ["doc_id", "line"], "left").join(per_line, ["doc_id", "line"], "left").join(in_gap, ["doc_id", "line"], "left")

    outer = F.filter("rs", lambda r: ~r.inside)
    kinds = F.array_distinct(F.transform(outer, lambda r: r.kind))
    clash = F.when(F.col("own").isNull(), F.size("rs") > 1).otherwise(F.exists(outer, lambda r: ~r.owner_id.eqNullSafe(F.col("own"))) | (F.size(kinds) > 1))
    crossed = (F.col("n_gaps") > 1) | (F.col("n_gaps").isNotNull() & (F.col("own").isNotNull() | F.col("rs").isNotNull()))
    rows = rows.withColumn("codes", F.array_compact(F.array(code("region_conflict", clash), code("gap_not_blank", F.col("n_gaps").isNotNull() & ~F.col("blank")), code("gap_conflict", crossed))))
    rows = written(rows, "dispositions")  # lines and errors are both made of it
    bad = told(own, "owner_id").unionByName(told(regions, "region_id")).unionByName(told(gaps, "gap_id")).unionByName(told(rows, "line"))

    lone = F.when(F.col("own").isNull(), F.element_at("rs", 1))
    kind = F.when(F.col("own").isNotNull(), "structural_owner").when(lone.owner_id.isNotNull(), "comment_owner").when(lone.isNotNull(), "root_region").when(F.col("g").isNotNull(), "layout_gap").otherwise("unmanaged")
    key = F.when(F.col("own").isNotNull(), F.concat(F.lit("owner:"), "own")).otherwise(F.coalesce(lone.selection_key, F.col("g.selection_key"), F.concat(F.lit("unmanaged:"), "line")))
    attached, root = F.filter("rs", lambda r: r.owner_id.isNotNull()), F.filter("rs", lambda r: r.owner_id.isNull())
    good = rows.join(bad.select("doc_id").distinct(), "doc_id", "left_anti")
    out = good.select(
        "doc_id", "line", kind.alias("kind"), key.alias("selection_key"), F.coalesce("own", lone.owner_id).alias("owner_id"), F.coalesce(F.transform("rs", lambda r: r.region_id), F.array().cast("array<string>")).alias("region_ids"),
        F.when(F.size(attached) > 0, F.element_at(attached, 1).kind).alias("comment_kind"), F.when(F.size(root) > 0, F.element_at(root, -1).kind).alias("root_kind"), F.col("g.gap_id").alias("gap_id"), F.col("g.controller").alias("controller"),
    )
    return out, bad
