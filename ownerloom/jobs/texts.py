"""Queries over documents, lines, paths and JSON, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ownerloom.functions import scalars
from ownerloom.jobs.demo_data import LINES_CTE, lines, table
from ownerloom.operators import cutting, paths

#: Unicode white space as a DuckDB class.
_WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_BLOCKS = rf"""list_filter(list_transform(string_split(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^{_WS}+|{_WS}+$', '', 'g'), chr(10) || chr(10)),
  lambda b: regexp_replace(regexp_replace(b, '^{_WS}+|{_WS}+$', '', 'g'), '{_WS}+', ' ', 'g')), lambda b: b <> '')"""


def sample_hash_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.sample_hash_bucket(table(spark, sf_dir, "documents"), "doc_id", 16, 3).select("doc_id")


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutting.text_blocks(_paragraphs(spark, sf_dir)).select("doc_id", F.col("index").cast("long").alias("index"), F.md5("normalized").alias("digest"), "start", "end")


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with every other line break doubled, so that they have blocks."""
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"\.\n", ".\n\n").alias("text"))


_TEXT_BLOCKS_SQL = f"""WITH p AS (SELECT doc_id, replace(text, '.' || chr(10), '.' || chr(10) || chr(10)) AS text FROM documents), b AS (SELECT doc_id, {_BLOCKS} AS bs FROM p),
u AS (SELECT doc_id, unnest(range(len(bs))) AS index, unnest(bs) AS b FROM b)
SELECT doc_id, index, md5(b) AS digest, CAST(sum(strlen(b) + 2) OVER w - strlen(b) - 2 AS BIGINT) AS start, CAST(sum(strlen(b) + 2) OVER w - 2 AS BIGINT) AS "end" FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY index)"""


def jaccard_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("lang").alias("lang_b"), F.col("text").alias("text_b"))
    pairs = docs.join(other, "doc_id").where("lang = lang_b")
    return pairs.select("doc_id", F.round(scalars.jaccard_similarity(F.col("text"), F.col("text_b")), 9).alias("score"))


_SIMILARITY_SQL = rf"""WITH t AS (SELECT doc_id, lang, list_distinct(list_filter(regexp_split_to_array(text, '{_WS}+'), lambda x: x <> '')) AS w FROM documents)
SELECT a.doc_id, CASE WHEN len(a.w) + len(b.w) = 0 THEN 1.0 ELSE round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))::DOUBLE, 9) END AS score
FROM t a JOIN t b ON b.doc_id = a.doc_id + 1 AND a.lang = b.lang"""


def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against the next one, block by block."""
    docs = _paragraphs(spark, sf_dir)
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("text_b"))
    # Blocks, words and scores are made once each.
    words = docs.join(other, "doc_id").select("doc_id", scalars.text_words(F.col("text")).alias("a"), scalars.text_words(F.col("text_b")).alias("b"))
    scored = words.select("doc_id", scalars.words_similarity(F.col("a"), F.col("b")).alias("score"))
    return scored.select("doc_id", F.round("score", 9).alias("score"), (F.col("score") >= 0.1).alias("similar"))


_BLOCK_SIMILARITY_SQL = f"""WITH p AS (SELECT doc_id, replace(text, '.' || chr(10), '.' || chr(10) || chr(10)) AS text FROM documents), b AS (SELECT doc_id, {_BLOCKS} AS bs FROM p),
n AS (SELECT a.doc_id, greatest(len(a.bs), len(b.bs)) AS n, list_transform(list_zip(a.bs[1:least(len(a.bs), len(b.bs))], b.bs[1:least(len(a.bs), len(b.bs))]), lambda z: [list_distinct(string_split(z[1], ' ')), list_distinct(string_split(z[2], ' '))]) AS ws FROM b a JOIN b ON b.doc_id = a.doc_id + 1),
s AS (SELECT doc_id, CASE WHEN n = 0 THEN 1.0 ELSE coalesce(list_sum(list_transform(ws, lambda w: len(list_intersect(w[1], w[2]))::DOUBLE / (len(w[1]) + len(w[2]) - len(list_intersect(w[1], w[2]))))), 0.0) / n END AS score FROM n)
SELECT doc_id, round(score, 9) AS score, score >= 0.1 AS similar FROM s"""


def refined_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    other = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.concat("p_type", F.lit(" "), F.col("p_name")).alias("b"))
    rows = part.join(other, "p_partkey").withColumn("a", F.concat("p_name", F.lit(" "), F.col("p_type")))
    score = scalars.refined_similarity(F.col("a"), F.col("b"), F.col("p_partkey") % 5, F.col("p_partkey") % 3, F.lit(5), F.lit(3))
    return rows.select("p_partkey", F.round(score, 9).alias("score"))


_REFINED_SQL = """WITH r AS (SELECT x.p_partkey, x.p_name || ' ' || x.p_type AS a, y.p_type || ' ' || y.p_name AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1)
SELECT p_partkey, round(0.7::DOUBLE * (CASE WHEN a = b THEN 1.0 ELSE 1.0::DOUBLE - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE END) + 0.15::DOUBLE * (least(strlen(a), strlen(b)) / greatest(strlen(a), strlen(b))::DOUBLE)
  + 0.15::DOUBLE * (1.0 - abs((p_partkey % 5) / 4::DOUBLE - (p_partkey % 3) / 2::DOUBLE)), 9) AS score FROM r"""


def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", scalars.slugify(F.col("url")).alias("slug"))


def _page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(x) for x in (".rb", ".yml", ".md", ".json", ".jsonc", ".sh", ".toml", ".txt", ".env", "/Gemfile", ".go")]), (F.col("page_id") % 11 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_extract("url", r"^[a-z]+://[^/?#]*/([^?#]*?)/?(?:[?#].*)?$", 1), ext).alias("path"))


_PATHS_CTE = r"""p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*/([^?#]*?)/?(?:[?#].*)?$', 1) || ['.rb', '.yml', '.md', '.json', '.jsonc', '.sh', '.toml', '.txt', '.env', '/Gemfile', '.go'][page_id % 11 + 1] AS path FROM pages)"""


def classify_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_paths(spark, sf_dir).withColumn("k", paths.classify_path(F.col("path"))).select("page_id", "path", "k.file_type", "k.family", "k.dialect")


_CLASSIFY_SQL = f"""WITH {_PATHS_CTE} SELECT page_id, path, ['ruby', 'yaml', 'markdown', 'json', 'json', 'bash', 'toml', 'text', CASE WHEN path LIKE '%/.env' OR path = '.env' THEN 'dotenv' ELSE 'text' END, 'gemfile', 'text'][page_id % 11 + 1] AS file_type,
  ['ruby', 'yaml', 'markdown', 'json', 'json', 'bash', 'toml', 'text', CASE WHEN path LIKE '%/.env' OR path = '.env' THEN 'dotenv' ELSE 'text' END, 'ruby', 'text'][page_id % 11 + 1] AS family,
  ['ruby', 'yaml', 'markdown', 'json', 'jsonc', 'bash', 'toml', 'text', CASE WHEN path LIKE '%/.env' OR path = '.env' THEN 'dotenv' ELSE 'text' END, 'ruby', 'text'][page_id % 11 + 1] AS dialect FROM p"""


def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.when(F.col("page_id") % 13 == 0, " GoLang ").when(F.col("page_id") % 17 == 0, "JSON with comments")
    return _page_paths(spark, sf_dir).select("page_id", paths.detect_language(named, F.col("path")).alias("language"))


_LANGUAGE_SQL = f"""WITH {_PATHS_CTE} SELECT page_id, CASE WHEN page_id % 13 = 0 THEN 'go' WHEN page_id % 17 = 0 THEN 'jsonc' WHEN page_id % 11 = 3 THEN 'json' WHEN page_id % 11 = 4 THEN 'jsonc' WHEN page_id % 11 = 10 THEN 'go' ELSE 'text' END AS language FROM p"""


def blank_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, own = _blanked(spark, sf_dir)
    return cutting.blank_gaps(rows, own).select("doc_id", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "kind", "controller")


def _blanked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines with some made blank, and an owner for every sixth line."""
    rows = lines(spark, sf_dir).withColumn("text", F.when(F.col("line") % 3 == 0, "  ").otherwise(F.col("text")))
    own = rows.where("line % 6 = 1").select("doc_id", F.concat(F.lit("o"), F.col("line").cast("string")).alias("owner_id"), F.col("line").alias("start_line"), (F.col("line") + 1).alias("end_line"))
    return rows, own


_BLANKED = f"""{LINES_CTE}, b AS (SELECT doc_id, line, CASE WHEN line % 3 = 0 THEN '  ' ELSE text END AS text FROM lines), o AS (SELECT doc_id, 'o' || line AS owner_id, line AS s, line + 1 AS e FROM b WHERE line % 6 = 1),
x AS (SELECT doc_id, line, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS g FROM b WHERE trim(text) = ''), r AS (SELECT doc_id, min(line) AS s, max(line) AS e FROM x GROUP BY doc_id, g),
gaps AS (SELECT r.doc_id, r.s AS start_line, r.e AS end_line, CASE WHEN p.owner_id IS NULL THEN 'preamble' WHEN n.owner_id IS NULL THEN 'postlude' ELSE 'interstitial' END AS kind, coalesce(n.owner_id, p.owner_id) AS controller
  FROM r LEFT JOIN o p ON p.doc_id = r.doc_id AND p.e + 1 = r.s LEFT JOIN o n ON n.doc_id = r.doc_id AND n.s - 1 = r.e WHERE p.owner_id IS NOT NULL OR n.owner_id IS NOT NULL)"""


def line_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, own = _blanked(spark, sf_dir)
    out = cutting.line_ownership(rows, own, cutting.blank_gaps(rows, own))
    return out.select("doc_id", F.col("line").cast("long").alias("line"), "kind", "owner_id")


_OWNERSHIP_SQL = f"""WITH {_BLANKED} SELECT b.doc_id, b.line, CASE WHEN o.owner_id IS NOT NULL THEN 'structural_owner' WHEN g.controller IS NOT NULL THEN 'layout_gap' ELSE 'unmanaged' END AS kind, coalesce(o.owner_id, g.controller) AS owner_id
FROM b LEFT JOIN o ON o.doc_id = b.doc_id AND b.line BETWEEN o.s AND o.e LEFT JOIN gaps g ON g.doc_id = b.doc_id AND b.line BETWEEN g.start_line AND g.end_line"""


def unmanaged_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutting.unmanaged_fingerprint(*_blanked(spark, sf_dir))


_UNMANAGED_SQL = f"WITH {_BLANKED} SELECT doc_id, count(*) AS n_lines, sha256(string_agg(text, chr(10) ORDER BY line)) AS digest FROM b WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.doc_id = b.doc_id AND b.line BETWEEN o.s AND o.e) GROUP BY 1"


def conflict_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, errors = cutting.conflict_regions(_marked(spark, sf_dir), max_regions=6)
    out = good.unionByName(errors.select("doc_id", F.col("line").alias("start_line"), "code"), allowMissingColumns=True)
    return out.select("doc_id", *[F.col(c).cast("long").alias(c) for c in (*_REGION, "start_byte", "end_byte", *_RANGES)], "code")


_REGION = ("start_line", "separator_line", "end_line", "base_line")
_RANGES = ("ours_start", "ours_end", "base_start", "base_end", "theirs_start", "theirs_end")


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with marker lines in place of some; some are faulty, some only look like markers."""
    k, d = F.col("line"), F.col("doc_id")
    text = (
        F.when((k == 1) & (d % 11 == 0), F.lit("\ufeff<<<<<<< first")).when((k == 3) & (d % 11 == 0), "=======").when((k == 4) & (d % 11 == 0), ">>>>>>>")
        .when(k % 8 == 2, F.when(d % 11 != 0, "<<<<<<<\tours").otherwise("")).when((k % 8 == 4) & (d % 2 == 0), F.when(d % 11 != 0, "||||||| base").otherwise("|||||||x"))
        .when((k % 8 == 5) & (d % 11 != 0), F.when(d % 13 == 0, "======= x").otherwise("=======")).when((k % 8 == 7) & (d % 11 != 0), ">>>>>>> theirs").otherwise(F.col("text"))
    )
    rows = lines(spark, sf_dir).withColumn("text", text)
    docs = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x.text), "\n").alias("text"))
    return cutting.doc_lines(docs)


_REGIONS_SQL = f"""WITH {LINES_CTE}, m0 AS (SELECT doc_id, line, CASE WHEN line = 1 AND doc_id % 11 = 0 THEN chr(65279) || '<<<<<<< first' WHEN line = 3 AND doc_id % 11 = 0 THEN '=======' WHEN line = 4 AND doc_id % 11 = 0 THEN '>>>>>>>'
  WHEN line % 8 = 2 THEN CASE WHEN doc_id % 11 <> 0 THEN '<<<<<<<' || chr(9) || 'ours' ELSE '' END WHEN line % 8 = 4 AND doc_id % 2 = 0 THEN CASE WHEN doc_id % 11 <> 0 THEN '||||||| base' ELSE '|||||||x' END
  WHEN line % 8 = 5 AND doc_id % 11 <> 0 THEN CASE WHEN doc_id % 13 = 0 THEN '======= x' ELSE '=======' END WHEN line % 8 = 7 AND doc_id % 11 <> 0 THEN '>>>>>>> theirs' ELSE text END AS text FROM lines),
z AS (SELECT doc_id, max(line) AS last FROM m0 GROUP BY 1), b AS (SELECT doc_id, line, text, sum(strlen(text) + 1) OVER (PARTITION BY doc_id ORDER BY line) - CASE WHEN line = last THEN 1 ELSE 0 END AS e, sum(strlen(text) + 1) OVER (PARTITION BY doc_id ORDER BY line) - strlen(text) - 1 AS s FROM m0 JOIN z USING (doc_id)),
k AS (SELECT doc_id, line, CASE WHEN line = 1 AND starts_with(text, chr(65279)) THEN s + 3 ELSE s END AS s, e, regexp_extract(CASE WHEN line = 1 THEN ltrim(text, chr(65279)) ELSE text END, '^(?:(<)<<<<<<(?:[ \t].*)?|([|])[|][|][|][|][|][|](?:[ \t].*)?|(=)======|(>)>>>>>>(?:[ \t].*)?)$', 0)[1] AS c FROM b),
w AS (SELECT *, lag(c) OVER v AS p, lead(c) OVER v AS n, sum(CASE WHEN c = '<' THEN 1 ELSE 0 END) OVER v - 1 AS r, max(CASE WHEN c = '<' THEN line END) OVER v AS opened FROM k WHERE c <> '' WINDOW v AS (PARTITION BY doc_id ORDER BY line)),
f AS (SELECT *, CASE WHEN NOT (CASE c WHEN '<' THEN p IS NULL OR p = '>' WHEN '|' THEN coalesce(p = '<', false) WHEN '=' THEN coalesce(p IN ('<', '|'), false) ELSE coalesce(p = '=', false) END) THEN 'invalid_markers' WHEN c = '<' AND r >= 6 THEN 'region_limit' END AS code FROM w),
x AS (SELECT doc_id, line AS place, line, code FROM f WHERE code IS NOT NULL UNION ALL SELECT doc_id, 2147483647, opened, 'invalid_markers' FROM f WHERE code IS NULL AND c <> '>' AND n IS NULL),
er AS (SELECT doc_id, arg_min(line, place) AS line, arg_min(code, place) AS code FROM x GROUP BY 1),
g AS (SELECT doc_id, r, max(line) FILTER (c = '<') AS start_line, max(line) FILTER (c = '=') AS separator_line, max(line) FILTER (c = '>') AS end_line, max(line) FILTER (c = '|') AS base_line, max(s) FILTER (c = '<') AS start_byte, max(e) FILTER (c = '>') AS end_byte,
  max(e) FILTER (c = '<') AS ours_start, coalesce(max(s) FILTER (c = '|'), max(s) FILTER (c = '=')) AS ours_end, max(e) FILTER (c = '|') AS base_start, max(s) FILTER (c = '=') AS sep, max(e) FILTER (c = '=') AS theirs_start, max(s) FILTER (c = '>') AS theirs_end FROM f WHERE doc_id NOT IN (SELECT doc_id FROM er) GROUP BY ALL)
SELECT doc_id, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("start_line", "separator_line", "end_line", "base_line", "start_byte", "end_byte", "ours_start", "ours_end", "base_start"))}, CAST(CASE WHEN base_line IS NOT NULL THEN sep END AS BIGINT) AS base_end, CAST(theirs_start AS BIGINT) AS theirs_start, CAST(theirs_end AS BIGINT) AS theirs_end, CAST(NULL AS VARCHAR) AS code FROM g
UNION ALL SELECT doc_id, line, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, code FROM er"""


def freeze_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("line")
    text = F.when(k % 7 == 2, "# ke.ep:freeze because").when((k % 7 == 4) & (F.col("doc_id") % 3 != 0), "  #  Ke.ep:  UNFREEZE").when(k % 7 == 5, "# keXep:freeze").otherwise(F.concat(F.lit("x"), F.col("text")))
    blocks, bad = cutting.freeze_blocks(lines(spark, sf_dir).withColumn("text", text), "ke.ep")
    out = blocks.select("doc_id", "start_line", "end_line", "reason", F.lit(None).cast("string").alias("category")).unionByName(bad.select("doc_id", F.col("line").alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.lit(None).cast("string").alias("reason"), "category"))
    return out.select("doc_id", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "reason", "category")


_FREEZE_SQL = f"""WITH {LINES_CTE}, m AS (SELECT doc_id, line, CASE WHEN line % 7 = 2 THEN 'freeze' ELSE 'unfreeze' END AS a FROM lines WHERE line % 7 = 2 OR (line % 7 = 4 AND doc_id % 3 <> 0)),
w AS (SELECT *, lag(a) OVER v AS p, lead(line) OVER v AS e FROM m WINDOW v AS (PARTITION BY doc_id ORDER BY line)), z AS (SELECT doc_id, coalesce(max(line) FILTER (a = 'unfreeze'), 0) AS closed FROM m GROUP BY 1),
c AS (SELECT doc_id, line, CASE WHEN a = 'freeze' THEN 'nested_freeze_open' ELSE 'unmatched_freeze_close' END AS category FROM w WHERE (a = 'freeze' AND p = 'freeze') OR (a = 'unfreeze' AND (p IS NULL OR p = 'unfreeze'))
  UNION ALL SELECT doc_id, min(line), 'unclosed_freeze_open' FROM m JOIN z USING (doc_id) WHERE line > closed GROUP BY 1)
SELECT doc_id, line AS start_line, e AS end_line, 'because' AS reason, CAST(NULL AS VARCHAR) AS category FROM w WHERE a = 'freeze' AND doc_id NOT IN (SELECT doc_id FROM c)
UNION ALL SELECT doc_id, line, NULL, NULL, category FROM c"""


def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    k = F.col("turn")
    part = F.array(F.concat(F.lit("## turn "), F.when((F.col("conv_id") % 7 == 0) & (k > 1), F.lit("x")).otherwise(k.cast("string"))), F.regexp_replace("text", r"\n", " "), F.lit(""))
    docs = turns.select(F.col("conv_id").alias("doc_id"), F.posexplode(part).alias("p", "text"), k.alias("k"))
    from pyspark.sql import Window

    rows = docs.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("k", "p")).alias("line"), "text")
    sections, rejected = cutting.markdown_sections(rows)
    out = sections.select("doc_id", "title", "start_line", "end_line", F.md5("text").alias("digest"), F.lit(None).cast("string").alias("reason")).unionByName(rejected.select("doc_id", F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.lit(None).cast("string").alias("digest"), "reason"))
    return out.select("doc_id", "title", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "digest", "reason")


_SECTIONS_SQL = """WITH t AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, CASE WHEN conv_id % 7 = 0 AND turn > 1 THEN 'x' ELSE CAST(turn AS VARCHAR) END AS name FROM conversations),
bad AS (SELECT DISTINCT conv_id FROM t GROUP BY conv_id, name HAVING count(*) > 1)
SELECT conv_id AS doc_id, 'turn ' || name AS title, 3 * n + 1 AS start_line, 3 * n + 3 AS end_line, md5('## turn ' || name || chr(10) || replace(text, chr(10), ' ') || chr(10)) AS digest, CAST(NULL AS VARCHAR) AS reason FROM t WHERE conv_id NOT IN (SELECT conv_id FROM bad)
UNION ALL SELECT conv_id, NULL, NULL, NULL, NULL, 'duplicate_heading' FROM bad"""


def json_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    doc = F.concat(F.lit('{"a/b":{"t":"'), "event_type", F.lit('"},"l":[1,'), (F.col("event_id") % 7).cast("string"), F.lit('],"p":'), "props", F.when(F.col("event_id") % 50 == 0, "").otherwise("}"))
    return cutting.json_owners(events.select(F.col("event_id").alias("doc_id"), doc.alias("j")), "j").select("doc_id", "path", "kind", "match_key", "parent", F.col("depth").cast("long").alias("depth"), "node", "value", "cut")


_JSON_SQL = """WITH e AS (SELECT event_id AS doc_id, event_type AS t, replace(props, ' ', '') AS p, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, event_id % 50 = 0 AS bad FROM events)
SELECT doc_id, '' AS path, 'parse_error' AS kind, NULL AS match_key, NULL AS parent, 0::BIGINT AS depth, NULL AS node, NULL AS value, false AS cut FROM e WHERE bad
UNION ALL SELECT doc_id, '/a~1b', 'member', 'a/b', '', 1, 'object', '{"t":"' || t || '"}', false FROM e WHERE NOT bad UNION ALL SELECT doc_id, '/a~1b/t', 'member', 't', '/a~1b', 2, 'scalar', '"' || t || '"', false FROM e WHERE NOT bad
UNION ALL SELECT doc_id, '/l', 'member', 'l', '', 1, 'array', '[1,' || doc_id % 7 || ']', false FROM e WHERE NOT bad UNION ALL SELECT doc_id, '/l/0', 'element', '0', '/l', 2, 'scalar', '1', false FROM e WHERE NOT bad UNION ALL SELECT doc_id, '/l/1', 'element', '1', '/l', 2, 'scalar', CAST(doc_id % 7 AS VARCHAR), false FROM e WHERE NOT bad
UNION ALL SELECT doc_id, '/p', 'member', 'p', '', 1, 'object', p, false FROM e WHERE NOT bad UNION ALL SELECT doc_id, '/p/k', 'member', 'k', '/p', 2, 'scalar', k, false FROM e WHERE NOT bad"""


def json_equivalent(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    a = F.concat(F.lit('{"x":1, "p":'), "props", F.lit("}"))
    b = F.concat(F.lit('{"p":'), F.when(F.col("event_id") % 4 == 0, F.lit('{"k":-1}')).otherwise(F.col("props")), F.lit(' ,"x":1}'))
    return events.select("event_id", scalars_equal(a, b).alias("equivalent"))


def scalars_equal(a, b):
    return cutting.json_equivalent(a, b)


def validate_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("case_id"), F.when(F.col("l_partkey") % 97 == 0, "").otherwise(F.concat(F.lit("o"), F.col("l_linenumber").cast("string"))).alias("owner_id"), (F.col("l_linenumber") * 10).cast("long").alias("start_byte"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("long") % 13).alias("end_byte"), F.col("l_linenumber").alias("start_line"), (F.col("l_linenumber") + F.col("l_suppkey") % 5 - 1).alias("end_line"))
    return cutting.validate_owners(rows.distinct())


_VALIDATE_SQL = """WITH o AS (SELECT DISTINCT l_orderkey AS case_id, CASE WHEN l_partkey % 97 = 0 THEN '' ELSE 'o' || l_linenumber END AS owner_id, l_linenumber * 10 AS s, l_linenumber * 10 + CAST(l_quantity AS BIGINT) % 13 AS e, l_linenumber AS sl, l_linenumber + l_suppkey % 5 - 1 AS el FROM lineitem),
f AS (SELECT *, count(*) OVER (PARTITION BY case_id, owner_id) AS n, max(e) OVER (PARTITION BY case_id ORDER BY s, e, owner_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o)
SELECT case_id, owner_id, 'empty_id' AS violation FROM f WHERE owner_id = '' UNION ALL SELECT case_id, owner_id, 'duplicate_id' FROM f WHERE n > 1 UNION ALL SELECT case_id, owner_id, 'byte_range' FROM f WHERE s < 0 OR e <= s
UNION ALL SELECT case_id, owner_id, 'overlap' FROM f WHERE reach > s UNION ALL SELECT case_id, owner_id, 'line_range' FROM f WHERE sl < 1 OR el < sl"""


def has_conflict_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("\n=======\n"))).otherwise(F.col("text")))
    return docs.select("doc_id", scalars.has_conflict_markers(F.col("text")).alias("markers"))


def flag_oversize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return paths.flag_oversize(docs.select("doc_id", "text"), ("text",), 4096).select("doc_id", "status")


def layout_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third line of every document is an owner."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    own = cutting.doc_lines(docs).where("line % 3 = 2").select(F.col("doc_id").alias("case_id"), F.concat(F.lit("o"), F.col("line").cast("string")).alias("owner_id"), "start_byte", "end_byte")
    return cutting.layout_gaps(own, docs.withColumnRenamed("doc_id", "case_id"))


_GAPS_SQL = f"""WITH {LINES_CTE}, d AS (SELECT doc_id AS case_id, hex(encode(text)) AS h, strlen(text) AS n FROM documents),
b AS (SELECT doc_id AS case_id, line, sum(strlen(text) + 1) OVER v - strlen(text) - 1 AS s, sum(strlen(text) + 1) OVER v AS e FROM lines WINDOW v AS (PARTITION BY doc_id ORDER BY line)),
o AS (SELECT b.case_id, 'o' || line AS owner_id, s, least(e, n) AS e, line FROM b JOIN d USING (case_id) WHERE line % 3 = 2 AND s < n),
g AS (SELECT case_id, coalesce(lag(e) OVER v, 0) AS s, s AS e, lag(owner_id) OVER v AS before_owner, owner_id AS after_owner FROM o WINDOW v AS (PARTITION BY case_id ORDER BY line)
  UNION ALL SELECT d.case_id, coalesce(max(o.e), 0), any_value(d.n), arg_max(o.owner_id, o.line), NULL FROM d LEFT JOIN o USING (case_id) GROUP BY 1)
SELECT case_id, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", before_owner, after_owner, coalesce(after_owner, before_owner) AS controller, sha256(unhex(substr(h, CAST(2 * s + 1 AS BIGINT), CAST(2 * (e - s) AS BIGINT)))) AS sha256 FROM g JOIN d USING (case_id)"""


def apply_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second line of documents replaced; some documents have a second edit that overlaps, begins alike or lies beyond."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    second = cutting.doc_lines(docs).where("line = 2")
    edit = lambda rows, a, b, text: rows.select("doc_id", a.alias("start_byte"), b.alias("end_byte"), F.lit(text).alias("replacement"))
    a, b = F.col("start_byte"), F.col("end_byte")
    edits = edit(second, a, b, "ä\n").unionByName(edit(second.where("doc_id % 5 = 1 AND end_byte > start_byte + 1"), b - 1, b, "x")).unionByName(edit(second.where("doc_id % 5 = 2"), a, b, "y")).unionByName(edit(second.where("doc_id % 5 = 3"), b, b + 1_000_000, "z"))
    return cutting.apply_edits(docs, edits).select("doc_id", F.md5("text").alias("digest"), "error")


_EDITS_SQL = f"""WITH {LINES_CTE}, n AS (SELECT doc_id, any_value(text) AS text, count(*) FILTER (line < m OR t <> '') AS n, max(t) FILTER (line = 2) AS t FROM (SELECT d.doc_id, d.text, l.line, l.text AS t, max(l.line) OVER (PARTITION BY d.doc_id) AS m FROM documents d JOIN lines l USING (doc_id)) GROUP BY 1),
p AS (SELECT doc_id, text, n >= 2 AND text <> '' AS has, strlen(t) + CASE WHEN n > 2 OR ends_with(text, chr(10)) THEN 1 ELSE 0 END AS size, string_split(text, chr(10)) AS parts FROM n),
e AS (SELECT *, CASE WHEN NOT has THEN NULL WHEN doc_id % 5 = 1 AND size > 1 THEN 'overlap' WHEN doc_id % 5 = 2 THEN 'equal_start' WHEN doc_id % 5 = 3 THEN 'range' END AS error FROM p)
SELECT doc_id, CASE WHEN error IS NULL THEN md5(CASE WHEN has THEN parts[1] || chr(10) || 'ä' || chr(10) || array_to_string(parts[3:], chr(10)) ELSE text END) END AS digest, error FROM e"""


def _fenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of conversations' turns as documents: some fenced with a language, some in longer or unknown fences, one open at the end."""
    k, t = F.col("conv_id"), F.col("turn")
    info = F.element_at(F.array(*[F.lit(x) for x in ("json", "YML extra", "", "python", "rs")]), (t % 5 + 1).cast("int"))
    parts = F.array(F.concat(F.when(t % 3 == 0, "~~~~").otherwise("```"), info), F.lit("```x"), F.concat(F.lit("body "), t.cast("string")), F.when(t % 3 == 0, "~~~~~").otherwise("```"), F.lit("between"))
    rows = table(spark, sf_dir, "conversations").select(k.alias("doc_id"), t, F.posexplode(parts).alias("p", "text"))
    from pyspark.sql import Window

    return rows.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("turn", "p")).alias("line"), "text")


def embedded_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cutting.embedded_surfaces(_fenced(spark, sf_dir))
    return out.select("doc_id", "operation_id", "path", "language", "family", "dialect", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


_FENCES = """f AS (SELECT conv_id AS doc_id, turn AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, ['json', 'YML', '', 'python', 'rs'][turn % 5 + 1] AS language FROM conversations),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY t) - 1 AS op, CASE language WHEN 'json' THEN 'json' WHEN 'YML' THEN 'yaml' ELSE 'rust' END AS family FROM f WHERE language IN ('json', 'YML', 'rs'))"""
_SURFACES_SQL = f"""WITH {_FENCES} SELECT doc_id, 'markdown-fence-' || op AS operation_id, '/code_fence/' || n AS path, language, family, family AS dialect, 5 * n + 1 AS start_line, 5 * n + 4 AS end_line FROM s"""


def apply_child_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of all known fences replaced; some documents have an output for a fence that is not there."""
    lines_ = _fenced(spark, sf_dir)
    operations = cutting.embedded_surfaces(lines_)
    number = F.regexp_extract("operation_id", r"(\d+)$", 1).cast("int")
    output = F.when(number % 3 == 0, "").when(number % 3 == 1, "new\nlines\n").otherwise(F.concat(F.lit("new "), "operation_id"))
    outputs = operations.select("doc_id", number.alias("output_index"), "address", output.alias("output"))
    stray = lines_.where("doc_id % 4 = 0").select("doc_id").distinct().select("doc_id", F.lit(999).alias("output_index"), F.lit("document[0] > fenced_code_block[/code_fence/999]").alias("address"), F.lit("x").alias("output"))
    plan, errors = cutting.resolve_child_outputs(operations, outputs.unionByName(stray))
    done = cutting.apply_child_outputs(lines_.join(errors.select("doc_id"), "doc_id", "left_anti"), plan)
    return done.select("doc_id", F.md5("text").alias("digest"), F.lit(None).cast("string").alias("code")).unionByName(errors.select("doc_id", F.lit(None).cast("string").alias("digest"), "code"))


_CHILD_SQL = f"""WITH {_FENCES}, b AS (SELECT f.doc_id, f.t, concat(CASE WHEN f.t % 3 = 0 THEN '~~~~' ELSE '```' END, CASE f.language WHEN 'YML' THEN 'YML extra' ELSE f.language END, chr(10),
  CASE WHEN op IS NULL THEN concat('```x', chr(10), 'body ', f.t, chr(10)) WHEN op % 3 = 0 THEN '' WHEN op % 3 = 1 THEN concat('new', chr(10), 'lines', chr(10)) ELSE concat('new markdown-fence-', op, chr(10)) END, CASE WHEN f.t % 3 = 0 THEN '~~~~~' ELSE '```' END, chr(10), 'between') AS part FROM f LEFT JOIN s ON s.doc_id = f.doc_id AND s.t = f.t)
SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN md5(string_agg(part, chr(10) ORDER BY t)) END AS digest, CASE WHEN doc_id % 4 = 0 THEN 'missing_surface' END AS code FROM b GROUP BY 1"""


QUERIES = {
    f.__name__: f
    for f in (sample_hash_bucket, text_blocks, jaccard_similarity, text_similarity, refined_similarity, slugify, classify_path, detect_language, blank_gaps, line_ownership, unmanaged_fingerprint, conflict_regions, freeze_blocks, markdown_sections, json_owners, json_equivalent, validate_owners, has_conflict_markers, flag_oversize, layout_gaps, apply_edits, embedded_surfaces, apply_child_outputs)
}

SQL = {
    "sample_hash_bucket": "SELECT doc_id FROM documents WHERE CAST('0x' || right(sha256(CAST(doc_id AS VARCHAR)), 1) AS INT) % 16 = 3",
    "text_blocks": _TEXT_BLOCKS_SQL,
    "jaccard_similarity": _SIMILARITY_SQL,
    "text_similarity": _BLOCK_SIMILARITY_SQL,
    "refined_similarity": _REFINED_SQL,
    "slugify": "SELECT page_id, CASE WHEN s = '' THEN 'section' ELSE s END AS slug FROM (SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM pages)",
    "classify_path": _CLASSIFY_SQL,
    "detect_language": _LANGUAGE_SQL,
    "blank_gaps": f"WITH {_BLANKED} SELECT * FROM gaps",
    "line_ownership": _OWNERSHIP_SQL,
    "unmanaged_fingerprint": _UNMANAGED_SQL,
    "conflict_regions": _REGIONS_SQL,
    "freeze_blocks": _FREEZE_SQL,
    "markdown_sections": _SECTIONS_SQL,
    "json_owners": _JSON_SQL,
    "json_equivalent": "SELECT event_id, event_id % 4 <> 0 AS equivalent FROM events",
    "validate_owners": _VALIDATE_SQL,
    "has_conflict_markers": "SELECT doc_id, doc_id % 5 = 0 OR contains(text, '=======') OR contains(text, '<<<<<<<') AS markers FROM documents",
    "flag_oversize": "SELECT doc_id, CASE WHEN strlen(text) > 4096 THEN 'oversize' ELSE 'pending' END AS status FROM documents",
    "layout_gaps": _GAPS_SQL,
    "apply_edits": _EDITS_SQL,
    "embedded_surfaces": _SURFACES_SQL,
    "apply_child_outputs": _CHILD_SQL,
}
