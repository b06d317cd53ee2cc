"""Column functions: text similarity, slugs, timestamps, hash buckets, path tests. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of content, length and position in refined_similarity, and its threshold (fixed values).
CONTENT_WEIGHT, LENGTH_WEIGHT, POSITION_WEIGHT = 0.7, 0.15, 0.15
REFINED_THRESHOLD = 0.7
SPACE = r"(?U)\s+"


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(text, SPACE), ""))


def jaccard_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of white-space words; 1 for two texts without words."""
    both = F.size(F.array_union(_tokens(a), _tokens(b)))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(_tokens(a), _tokens(b))) / both)


def normalized_blocks(text: Column) -> Column:
    """Blocks of a text: line ends made \\n, trimmed, cut at blank lines, white space collapsed, empty blocks dropped."""
    unix = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\r", "\n")
    trimmed = F.regexp_replace(unix, r"(?U)\A\s+|\s+\z", "")
    blocks = F.transform(F.split(trimmed, "\n\n"), lambda b: F.regexp_replace(F.regexp_replace(b, r"(?U)\A\s+|\s+\z", ""), SPACE, " "))
    return F.filter(blocks, lambda b: b != "")


def text_words(text: Column) -> Column:
    """The distinct words of each of a text's blocks."""
    return F.transform(normalized_blocks(text), _tokens)


def words_similarity(left: Column, right: Column) -> Column:
    """text_similarity of two texts' text_words(), which should be columns: each is read more than once."""
    total = F.greatest(F.size(left), F.size(right))
    # Sizes stand beside one another, so that words are compared once.
    sizes = F.zip_with(left, right, lambda x, y: F.struct((F.size(x) + F.size(y)).alias("n"), F.size(F.array_intersect(x, y)).alias("common")))
    scores = F.transform(sizes, lambda s: F.when(s.n.isNull() | (s.n < 0), F.lit(0.0)).when(s.n == 0, F.lit(1.0)).otherwise(s.common / (s.n - s.common)))
    return F.when(total == 0, F.lit(1.0)).otherwise(F.aggregate(scores, F.lit(0.0), lambda s, v: s + v) / total)


def text_similarity(a: Column, b: Column) -> Column:
    """Mean Jaccard similarity of the blocks at equal places; a missing block counts 0, two empty texts 1."""
    return words_similarity(text_words(a), text_words(b))


def is_similar(a: Column, b: Column, threshold: float) -> Column:
    return text_similarity(a, b) >= threshold


def relative_position(index: Column, total: Column) -> Column:
    return F.when(total > 1, index / (total - 1)).otherwise(F.lit(0.5))


def _length_and_position(a: Column, b: Column, index_a: Column, index_b: Column, total_a: Column, total_b: Column) -> tuple[Column, Column]:
    most = F.greatest(F.octet_length(a), F.octet_length(b))
    length = F.when(F.octet_length(a) == F.octet_length(b), F.lit(1.0)).otherwise(F.least(F.octet_length(a), F.octet_length(b)) / most)
    return length, 1.0 - F.abs(relative_position(index_a, total_a) - relative_position(index_b, total_b))


def refined_similarity(a: Column, b: Column, index_a: Column, index_b: Column, total_a: Column, total_b: Column, edits: Column | None = None) -> Column:
    """Content by edit distance on characters, length by bytes, and place in the text, weighed 0.7, 0.15 and 0.15.

    edits: the edit distance, if it is known."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    edits = F.levenshtein(a, b) if edits is None else edits
    content = F.when(a == b, F.lit(1.0)).when((F.char_length(a) == 0) | (F.char_length(b) == 0), F.lit(0.0)).otherwise(1.0 - edits / longest)
    length, position = _length_and_position(a, b, index_a, index_b, total_a, total_b)
    return CONTENT_WEIGHT * content + LENGTH_WEIGHT * length + POSITION_WEIGHT * position


#: Letters that are counted one by one to bound edit distances (any choice is right; frequent ones tell texts apart best).
COUNTED = "etaoinshrl"


def slugify(text: Column) -> Column:
    """Lower case, runs of other than ASCII letters and digits become one hyphen, none at the ends; `section` if nothing is left."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", F.lit("section")).otherwise(slug)


def is_rfc3339_utc(text: Column) -> Column:
    """True for a valid instant like 2024-02-29T23:59:59.5Z."""
    shape = text.rlike(r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z\z")
    instant = F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return F.coalesce(shape & instant.isNotNull(), F.lit(False))


def hash_bucket(text: Column, modulus: int) -> Column:
    """int(sha256(text), 16) % modulus, by Horner's rule over the hexadecimal digits."""
    digits = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.conv(F.substring(F.sha2(text, 256), i, F.lit(1)), 16, 10).cast("long"))
    return F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: (a * 16 + d) % modulus)


def has_conflict_markers(text: Column) -> Column:
    return F.contains(text, F.lit("<<<<<<<")) | F.contains(text, F.lit("======="))


def verified_bytes(inline: Column, reference: Column, n_bytes: Column, sha256: Column, resource: Column) -> Column:
    """First fault of a byte descriptor, null if it holds: exactly one of inline (base64) and reference is
    given, the base64 is canonical, a reference is known, and length and digest match."""
    raw = F.try_to_binary(inline, F.lit("base64"))
    payload = F.coalesce(raw, resource)
    return (
        F.when(inline.isNull() == reference.isNull(), "shape")
        .when(inline.isNotNull() & (raw.isNull() | (F.base64(raw) != inline)), "base64")
        .when(reference.isNotNull() & resource.isNull(), "missing_resource")
        .when(F.octet_length(payload) != n_bytes, "length")
        .when(F.sha2(payload, 256) != sha256, "digest")
    )
