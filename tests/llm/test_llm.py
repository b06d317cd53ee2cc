"""The operators of the llm subpackage against brute force, round trips and odd inputs."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ownerloom.llm import compaction, components, decontaminate, encoding, langid, nearcopies, packing, quality, rules, simhash, sstable, urls, warc
from ownerloom.llm._common import held_out, materialize, scratch

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, score string"
ODD = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it.", "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog and runs away from it.", "en", "a"),
    (2, None, "en", "b"),
    (3, "", None, None),
    (None, "no id here but words all the same", "en", "c"),
    (4, " \t\n ", "en", "d"),
    (5, "a  b   c <|endoftext|> \n\n x\ty ", "fr", "e"),
    (6, "word " * 30_000, "en", "f"),
    (7, "Äpfel, Ströme\nund Öl ß 中文 \U0001f600", "de", "g"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# -- encoding, tables, packing --------------------------------------------------------------

TRICKY = ["", " ", "a", "a ", " a", "a  b", "a   b", "a \nb", "a\n b", "a\n\n  b", "\n", "it's  5 o'clock\t x", "don't, we'll... (see) x_y \"q\"", "<|endoftext|> <|x", "\r\n a\r b", "中文 字\x1cz \x85 q", "Ä́ ́x, é", "A,b. C!! d%%% İ", "a\n\t\tb", " a  b "]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_agrees_with_the_library(name, docs):
    from tokenizers import Tokenizer

    enc, plain = encoding.WordEncoder(encoding.vocabulary_path(name)), Tokenizer.from_file(encoding.vocabulary_path(name))
    rng = np.random.default_rng(4)
    letters = list("abcdefXYZ'stre   \n\n\t\r019²½.,!?<|>_-éÄßİǅ中文ā\xa0 \x85\x1c\x00́­Σσςﬁ€😀")
    odd_texts = ["".join(rng.choice(letters, int(rng.integers(1, 40)))) for _ in range(4000)]
    texts = odd_texts + ["x <|endoftext|> y", "<|ENDOFTEXT|><|startoftext|> a", "\n\n", "a\r\n\r\n b"] + TRICKY + [r["text"] for r in docs.limit(60).collect()]
    for _ in range(2):  # the second time from kept words
        for text, packed in zip(texts, map(enc.encode, texts), strict=True):
            assert packed == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text[:80])


def _ids(name, text, end):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(encoding.vocabulary_path(name))
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_sorted_tables_round_trip(spark, odd, empty):
    manifest = sstable.write_tables(odd, scratch(spark, "t"))
    rows = sorted(sstable.scan_tables(manifest).collect(), key=lambda r: r["start"])
    expected = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    assert len(rows) == len(ODD)
    for row, (doc_id, text, *_) in zip(rows, expected, strict=True):
        ids = _ids("byte_bpe_50k.json", text, 0)
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        assert row["ids"] == ids.tolist()
        at += len(ids)
    found = sstable.lookup(manifest, spark.createDataFrame([(1,), (5,), (None,), (99,)], "doc_id long")).collect()
    assert Counter(r["doc_id"] for r in found) == {1: 2, 5: 1, None: 1}
    assert sstable.scan_tables(sstable.write_tables(empty, scratch(spark, "t"))).count() == 0


def test_repeated_ids_are_dealt_over_files(spark):
    """A third of the rows have one id and a third none; every file gets its share, starts are gapless, lookups whole."""
    rows = [(k if k % 3 == 0 else 500 if k % 3 == 1 else None, f"text number {k}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = sstable.write_tables(docs, scratch(spark, "t"), files=9)
    sizes = [r["n_records"] for r in manifest.collect()]
    assert sum(sizes) == 3000 and max(sizes) < 700
    told = sorted(sstable.scan_tables(manifest, with_ids=False).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in told] == [sum(q["n_tokens"] for q in told[:k]) for k in range(3000)]
    assert [r["doc_id"] for r in told] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    found = Counter(r["doc_id"] for r in sstable.lookup(manifest, spark.createDataFrame([(500,), (None,), (3,), (4,)], "doc_id long")).collect())
    assert found == {500: 1000, None: 1000, 3: 1}


def test_table_blocks_and_filter(tmp_path):
    path = tmp_path / "t.sst"
    with open(path, "wb") as out:
        writer = sstable.TableWriter(out, 2)
        for k in range(-500, 20_000, 3):
            writer.add(sstable.key_bytes(k), np.arange(k % 50, dtype="<u2").tobytes())
        writer.close()

    class Source:
        def __init__(self):
            self.f = open(path, "rb")
            self.seek, self.read = self.f.seek, self.f.read

        def size(self):
            return path.stat().st_size

    table = sstable.TableReader(Source())
    assert len(table.index) > 3
    assert [sstable.key_value(k) for k, _ in table] == list(range(-500, 20_000, 3))
    for k in (-500, 1, 10_000, 19_999, -501, 0, 25_000):
        assert len(table.get(sstable.key_bytes(k))) == int(k in range(-500, 20_000, 3))


@pytest.mark.parametrize("histogram", [{1500: 40}, {1: 5000}, {2047: 3, 1: 1}, {1024: 10, 700: 9, 648: 9}, {3: 1}, {}])
def test_plan_places_every_tail_once(histogram):
    h = np.zeros(2048, np.int64)
    for k, v in histogram.items():
        h[k] = v
    plan = packing.Plan(h)
    table, full = plan.table(), Counter()
    for tail, n in histogram.items():
        breaks, ranges = table[tail]
        for rank in range(n):
            places = sorted((p[1], p[2], p[3] + rank - p[0], p[4]) for p in ranges[int(np.searchsorted(breaks, rank, "right")) - 1])
            assert [p[0] for p in places] == [sum(q[1] for q in places[:k]) for k in range(len(places))]
            assert sum(p[1] for p in places) == tail
            for _, length, sequence, offset in places:
                full[sequence] += length
                assert offset + length <= 2048
    assert sorted(full) == list(range(plan.sequences))
    assert sum(n != 2048 for n in full.values()) <= 1


def test_packing_keeps_every_id(spark, odd, empty, docs):
    mixed = odd.select("doc_id", "text").unionByName(docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    pieces = packing.pack(mixed).collect()
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        assert len(p["ids"]) == 4 * p["length"] > 0
    for places in by_sequence.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
    assert sum(sum(n for _, n in places) != 2048 for places in by_sequence.values()) <= 1
    for doc_id, text in ((5, ODD[6][1]), (6, ODD[7][1]), (7, ODD[8][1]), (None, ODD[4][1])):
        own = sorted((p for p in pieces if p["doc_id"] == doc_id), key=lambda p: p["start"])
        ids = _ids("word_bpe_49k.json", text, 1)
        assert b"".join(p["ids"] for p in own) == ids.tobytes()
        assert own[0]["doc_tokens"] == len(ids)
    assert packing.pack(empty).count() == 0


# -- records ----------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    big, same = "é" * 700_000, "<p>" + "x" * 200
    rows = [(5, "http://a/\n1", same), (3, "http://b", same), (9, None, big), (1, "u", "short"), (2, "v", "short"), (4, "w", None), (None, "n", same), (3, "again", "y" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit("clash"), "task": F.lit(7), "data": F.lit(b"x")})
    cut = warc.cut_payloads(pages, chunk_bytes=100_000).where("record_id = 9").orderBy("chunk").collect()
    whole = big.encode()
    assert [r["digest_so_far"] for r in cut] == [hashlib.sha256(whole[: 100_000 * (k + 1)]).hexdigest() for k in range(14)] and cut[0]["digest"] == cut[-1]["digest_so_far"]
    manifest = warc.write_archives(warc.chunk_table(pages, chunk_bytes=100_000), scratch(spark, "w"))
    chunks = warc.read_archives(manifest, 64_000).collect()
    assert {r["record_id"] for r in chunks if r["record_type"] == "revisit"} == {5}
    assert next(r["refers_to"] for r in chunks if r["record_id"] == 5) == 3
    body = b"".join(r["data"] for r in sorted((r for r in chunks if r["record_id"] == 9), key=lambda r: r["chunk"]))
    assert body.decode() == big
    last = next(r for r in chunks if r["record_id"] == 9 and r["last"])
    assert last["digest_so_far"] == last["digest"] == hashlib.sha256(big.encode()).hexdigest()
    assert max(len(r["data"]) for r in chunks) <= 64_000
    assert sum(r["last"] for r in chunks) == len(rows)
    assert warc.read_archives(warc.write_archives(warc.chunk_table(pages.limit(0)), scratch(spark, "w"))).count() == 0


@pytest.mark.parametrize("repeats", [0, 3])
def test_warc_records_stay_whole_in_small_splits(spark, tmp_path, repeats):
    rng = np.random.default_rng(6)
    bodies = ["".join(rng.choice(list("abcdefgh<> "), 120_000)) for _ in range(60)]
    rows = [(k, f"http://h/{k}", t) for k, t in enumerate(bodies + bodies[:repeats])]
    path = str(tmp_path / "pages")
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.option("parquet.block.size", 200_000).parquet(path)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "300000")
        manifest = warc.write_archives(warc.chunk_table(spark.read.parquet(path), chunk_bytes=5_000), scratch(spark, "w"))
        chunks = warc.read_archives(manifest, 50_000).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r["last"] for r in chunks) == len(rows) == sum(r["n_records"] for r in manifest.collect())
    assert sorted((r["record_id"], r["refers_to"]) for r in chunks if r["record_type"] == "revisit") == [(60 + k, k) for k in range(repeats)]
    parts = {}
    for r in sorted(chunks, key=lambda r: (r["record_id"], r["chunk"])):
        parts[r["record_id"]] = parts.get(r["record_id"], b"") + r["data"]
    assert all(parts[k].decode() == t for k, t in enumerate(bodies))


# -- near-duplicates --------------------------------------------------------------------------


def _plain_print(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(odd):
    for row in simhash.fingerprints(odd.where("doc_id <> 6")).collect():
        texts = [t for d, t, *_ in ODD if d == row["doc_id"]]
        assert row["fp"] & (1 << 64) - 1 == _plain_print(texts[0])


def _brute_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {frozenset(fps[k] for k in range(len(fps)) if find(k) == r) for r in {find(k) for k in range(len(fps))}}


@pytest.mark.parametrize("cell_limit", [0, 3, 24])
def test_links_keep_every_component(spark, cell_limit):
    rng = np.random.default_rng(5)
    fps = set(rng.integers(-(1 << 63), 1 << 63, 60).tolist())
    for seed in list(fps)[:6]:  # chains, stars and groups at two bits, and some at three
        at = seed
        for _ in range(12):
            flips = rng.choice(64, rng.integers(1, 4), replace=False)
            at ^= sum(1 << int(b) for b in flips)
            at = at - (1 << 64) if at >= 1 << 63 else at + (1 << 64) if at < -(1 << 63) else at
            fps.add(int(np.int64(np.uint64(at & (1 << 64) - 1).astype(np.int64))))
    fps = sorted(fps)
    distinct = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = components.connected_components(simhash.links(distinct, cell_limit=cell_limit)).collect()
    groups = {}
    for r in found:
        groups.setdefault(r["component"], set()).add(r["node"])
    singles = {frozenset([f]) for f in fps if f not in {r["node"] for r in found}}
    assert {frozenset(g) for g in groups.values()} | singles == _brute_components(fps)


def test_components_of_long_chain_and_star(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(301)} == {0} and {got[1000 + k] for k in range(200)} == {1000}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_and_keep_one(odd, empty, spark):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[2]["fingerprint"] == "0" * 16 and by_id[2]["component_id"] == by_id[3]["component_id"] == by_id[4]["component_id"] == 2
    assert by_id[None]["component_id"] is None
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids == {1: 1, 2: 1, None: 1, 5: 1, 6: 1, 7: 1}
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


# -- benchmark passages -----------------------------------------------------------------------


def _edit_distance_within(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_myers_agrees_with_the_table():
    rng = np.random.default_rng(3)
    for _ in range(200):
        pattern = "".join(rng.choice(list("abc"), rng.integers(1, 90)))
        text = "".join(rng.choice(list("abc"), rng.integers(0, 60)))
        if rng.random() < 0.5:
            text += pattern[: len(pattern) // 2] + "x" + pattern[len(pattern) // 2 :]
        best, edits = _edit_distance_within(pattern, text), int(rng.integers(0, 12))
        got = decontaminate.myers(pattern, text, edits)
        assert (got[0] if got else None) == (best if text and best <= edits else None)


def test_passages_within_budget(spark):
    item = "whoever reads this passage of the benchmark should find that it is long enough to count as evidence of leakage"
    edited = item.replace("reads", "raeds").replace("long", "longg")
    far = "completely other words that have nothing to do with it at all and never will, however long the text goes on"
    rows = [(1, f"x {item.upper()}! y"), (2, f"{far} {edited} {far}"), (3, far), (4, None), (5, ""), (None, item), (6, item[:50]), (6, item.replace(" ", "\n  "))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(9))
    bench = spark.createDataFrame([(7, item), (8, item), (9, None), (10, "short")], "item_id long, text string")
    for chars in (10, 10_000):
        found = decontaminate.contaminated(docs, bench, block_chars=chars).collect()
        assert {(r["doc_id"], r["item_id"]) for r in found} == {(d, i) for d in (1, 2, None, 6) for i in (7, 8)}
        assert {r["distance"] for r in found if r["doc_id"] == 2} == {decontaminate.myers(decontaminate.normalize(item), decontaminate.normalize(edited), 99)[0]}
    kept = decontaminate.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6]
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_short_items_as_whole_words(spark):
    rows = [(1, "So: who wrote Hamlet? Nobody."), (2, "who wrote hamlets"), (3, "who wrotte hamlet"), (4, "前中国的首都是哪里后"), (5, "Who wrote\nHAMLET"), (6, "xwho wrote hamlet who wrote hamlet"), (7, "and")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "Who wrote Hamlet?"), (2, "中国的首都是哪里"), (3, "?!"), (4, "")], "item_id long, text string")
    found = decontaminate.contaminated(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in found} == {(1, 1, 0), (4, 2, 0), (5, 1, 0), (6, 1, 0)}


def test_the_budget_alone_decides_how_items_of_any_length_are_found(spark):
    item = "alpha beta gamma delta eps"  # 26 characters, one edit
    rows = [(1, "x alpha beta gamma delto eps y"), (2, "x alpha beta gamma delta epsilon"), (3, "x alpha beta gamma dolto eps y"), (4, "ALPHA beta, gamma delta eps."), (5, "the cathedral"), (6, "a cat here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "cat")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.contaminated(docs, bench).collect()}
    assert found == {(1, 1): 1, (2, 1): 0, (4, 1): 0, (6, 2): 0}
    anywhere = decontaminate.contaminated(docs, bench, exact_words=False).where("item_id = 2").collect()
    assert sorted(r["doc_id"] for r in anywhere) == [5, 6]
    for n in range(1, 120):
        words = "".join(np.random.default_rng(n).choice(list("abcdefgh"), n))
        edits = decontaminate.budget(n)
        k = n // 2
        changed = words[:k] + "z" * edits + words[k + edits :]
        assert decontaminate.Matcher([(1, words)], decontaminate.EDITS_PER_100).find(f"q {changed} q")[0][1] <= edits
        beyond = words[:k] + "z" * (edits + 1) + words[k + edits + 1 :]
        assert not decontaminate.Matcher([(1, words)], decontaminate.EDITS_PER_100).find(f"q {beyond} q")


def test_matcher_finds_all_random_edits():
    rng = np.random.default_rng(8)
    letters = list("abcdefgh ")
    for _ in range(60):
        item = decontaminate.normalize("".join(rng.choice(letters, 160)))
        edits = decontaminate.budget(len(item))
        text = list(item)
        for _ in range(edits):
            k = int(rng.integers(0, len(text)))
            if rng.random() < 0.5:
                text[k] = "z"
            elif rng.random() < 0.5:
                del text[k]
            else:
                text.insert(k, "y")
        hay = decontaminate.normalize("q" * 50 + " " + "".join(text) + " " + "w" * 50)
        want = decontaminate.myers(item, hay, edits)
        got = decontaminate.Matcher([(1, item)], decontaminate.EDITS_PER_100).find(hay)
        assert (got[0][1] if got else None) == (want[0] if want else None)


# -- language, quality, urls, rules -----------------------------------------------------------


def test_languages_are_learned_where_ids_are_null_or_repeat(spark, docs):
    given = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    want = {r["lang"] for r in given.distinct().collect()}
    for ids in ("CAST(NULL AS LONG)", "7L"):  # 7 is not held out
        rows = given.select(F.expr(ids).alias("doc_id"), "text", "lang")
        rows = rows.unionByName(rows).unionByName(rows.limit(1).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("k"))
        learned = langid.training_rows(rows, per_language=20)
        sizes = {r["lang"]: r["n"] for r in learned.groupBy("lang").agg(F.count("*").alias("n")).collect()}
        assert set(sizes) == want and all(1 <= n <= 60 for n in sizes.values())
        prototypes = langid.fit_prototypes(rows)
        assert set(prototypes) == want
        told = langid.identify(rows.limit(200), prototypes)
        assert told.where("lang_pred = lang").count() > 0.95 * told.where(f"lang_pred <> '{langid.UNKNOWN}'").count()


def test_quality_learns_from_a_bounded_sample_where_ids_repeat(spark):
    texts = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("some words "), F.repeat(F.lit("and more "), F.col("id").cast("int") % 97), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(7, 1, 0)] * 50 + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.training_rows(texts, labels, bound=300)
    assert 150 <= rows.count() <= 600
    assert quality.training_rows(texts.limit(10), labels, bound=300).count() == 10


def test_language(spark, docs, odd, empty):
    prototypes = langid.fit_prototypes(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rows = langid.identify(docs, prototypes).where(held_out()).select("lang", "lang_pred", "score").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    told = {r["doc_id"]: r for r in langid.identify(odd, prototypes).collect()}
    assert told[2]["lang_pred"] == told[3]["lang_pred"] == told[4]["lang_pred"] == "und" and told[2]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in told.values()) and len(told) == 8
    assert langid.identify(empty, prototypes).count() == 0
    assert langid.fit_prototypes(empty) == {}
    assert {r["lang_pred"] for r in langid.identify(odd, {}).collect()} == {"und"}


def test_bundle_is_the_sum_of_bound_trigrams():
    text = "Ab c"
    letters = [0, ord("a"), ord("b"), 0, ord("c"), 0]
    expected = sum(np.roll(langid.letter_vector(a), 2) * np.roll(langid.letter_vector(b), 1) * langid.letter_vector(c) for a, b, c in zip(letters, letters[1:], letters[2:], strict=False))
    assert (langid.Bundler().bundles([text, None, "12 34"]) == np.stack([expected, expected * 0, expected * 0])).all()


def test_quality_rules_compiled_and_weighed(spark):
    """A compiled score is the logistic of the intercept and the weights of the rules that hold, worked out by hand."""
    model = quality.RuleModel(-0.5, [((("bang_rate", False, 0.1),), 2.0), ((("bang_rate", True, 0.4), ("log_words", False, 1.5)), -3.0)])
    docs = spark.createDataFrame([(1, "a!! b!", 7.0), (2, "a b c d e f", 8.0), (3, "wow! one two three four five six", 9.0), (4, None, 1.0)], "doc_id long, text string, stats double")
    rows = quality.scored(docs, model).collect()
    values = {r["doc_id"]: r["stats"] for r in quality.statistics(docs.drop("stats")).collect()}
    assert {r["doc_id"]: r["stats"] for r in rows} == {1: 7.0, 2: 8.0, 3: 9.0, 4: 1.0}
    for r in rows:
        v = values[r["doc_id"]]
        total = -0.5 + 2.0 * (v["bang_rate"] > 0.1) - 3.0 * (v["bang_rate"] <= 0.4 and v["log_words"] > 1.5)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-total)))


def test_quality_classifier(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit_quality(docs, labels)
    assert model.rules and model.constant is None
    rows = quality.scored(docs, model).join(labels, "doc_id").where(held_out()).select("predicted", "quality").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.9
    out = quality.scored(odd, model)
    assert set(out.columns) == {*odd.columns, "predicted"}
    assert all(0 <= r["score"] <= 1 for r in out.collect()) and out.count() == len(ODD)
    assert quality.scored(empty, model).count() == 0
    turned = docs.orderBy(F.desc("doc_id")).repartition(7)
    assert quality.fit_quality(turned, labels.repartition(3)) == model
    assert quality.fit_quality(docs, labels.where("quality = 1")).constant == 1.0
    assert quality.fit_quality(docs, labels.limit(0)).constant == 0.5


def _plain_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_rule_ledger_against_plain_count(spark, odd, empty):
    texts = ["a b c d e f g h i " * 5, "a b c d e f g h a b c d e f g h", "x " * 9, "one two\n\none two\n \none two\r\n" + "## | <> $ % &" * 3, "a b c d e f g h i"]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    book = rules.verdicts(rules.ledger(docs))
    want = Counter((d, *_plain_rules(t)) for d, t in [(r[0], r[1]) for r in ODD] + [(100 + k, t) for k, t in enumerate(texts)])
    rows = book.collect()
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows) == want
    for r in rows:
        base = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert bool(r["failures"] & rules.BASE) == base and r["kept"] == (r["failures"] == 0)
    told = {r["rule"]: r for r in rules.ablations(book).collect()}
    assert told["few_words"]["failed"] == sum(r["n_words"] < 20 for r in rows)
    assert told["few_words"]["kept_without"] == sum(r["failures"] in (0, rules.BIT["few_words"]) for r in rows)
    assert rules.ledger(empty).count() == 0 and len(rules.ablations(rules.ledger(empty)).collect()) == len(rules.RULES)


def test_url_rules_and_model(spark):
    listed = [(1, "https://A.Example.ORG/es/1"), (2, "http://example.org/en/12"), (3, "http://example.org/fr"), (4, "x.com://b.com/fr/?q"), (5, None), (6, "no scheme"), (7, "http://notorg"), (8, "http://org"), (9, "http://a.com/de/x://org/"), (10, "http://com/fr/é#/"), (11, "http://b.net/fr/1")]
    pages = spark.createDataFrame(listed, "page_id long, url string").withColumn("host", F.lit("clash"))
    for compiled in (256, 0):
        rows = {r["page_id"]: r for r in urls.with_rules(urls.host_and_path(pages.select("page_id", "url")), compiled=compiled).collect()}
        assert {k: r["rule"] for k, r in rows.items()} == {1: "example.org/es/", 2: "example.org/en/1", 3: "org/", 4: "com/fr/", 5: None, 6: None, 7: None, 8: None, 9: "com/de/", 10: "com/fr/", 11: None}
        assert (rows[1]["host"], rows[1]["path"], rows[5]["host"], rows[6]["path"]) == ("a.example.org", "/es/1", "", "")
    out = {r["page_id"]: r["verdict"] for r in urls.judged(pages).collect()}
    assert len(out) == 11 and set(out.values()) <= {"allow", "block"} and out[1] == "block" and out[3] == "allow"
    assert urls.judged(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in urls.judged(pages.where("page_id in (3, 11)")).collect()} == {"allow"}


def test_url_trees_compiled_and_fitted(spark):
    """The compiled trees say what Spark's model says, over urls that were not learned from."""
    rows = urls.with_rules(urls.host_and_path(spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")))
    told = rows.where("rule IS NOT NULL").select("url", (F.col("rule_verdict") == "allow").cast("double").alias("label"))
    model = urls.fit_urls(told.where("hash(url) % 3 <> 0"))
    held = model.with_shares(urls.lexical(urls.host_and_path(rows.where("rule IS NULL OR hash(url) % 3 = 0").select("page_id", "url"))))
    fitted = {r["page_id"]: r["prediction"] for r in model.fitted.transform(urls.feature_vectors(held)).collect()}
    compiled = {r["page_id"]: float(r["model_verdict"] == "allow") for r in model.verdict(held.drop("suffix_share")).collect()}
    assert fitted == compiled and len(set(fitted.values())) == 2


def test_a_url_does_not_know_its_own_label(spark):
    """Each suffix stands once, so without its own label every url's share is the prior, and nothing can be learned."""
    labelled = spark.createDataFrame([(f"http://site.x{chr(97 + k % 26)}{chr(97 + k // 26)}/p", float(k % 2)) for k in range(200)], "url string, label double")
    model = urls.fit_urls(labelled)
    split = str(model.trees)
    assert "suffix_share" not in split
    assert urls.training_urls(labelled.union(labelled)).count() == 200


# -- shards -----------------------------------------------------------------------------------


def test_compaction_keeps_rows_and_versions(spark, odd, docs):
    rows = docs.select("doc_id", "text", "lang", F.lit(None).cast("string").alias("score"))
    store = compaction.ShardStore(spark, scratch(spark, "s"), target_bytes=60_000, smallest_bytes=1_000)
    assert store.version() == 0 and store.read().columns == []
    store.append(rows.repartition(9))
    before = store.manifest().count()
    store.append(odd.select(rows.columns).repartition(3))
    store.append(rows.limit(0))
    last = store.compact_fully()
    assert last > 3 and store.manifest().count() < before + 3
    everything = rows.unionByName(odd.select(rows.columns))
    key = lambda df: Counter((r["doc_id"], r["text"], r["lang"]) for r in df.collect())
    assert key(store.read()) == key(everything)
    assert key(store.read(1)) == key(rows)  # older versions stay until vacuum
    assert store.manifest().agg(F.sum("n_rows")).first()[0] == everything.count()
    assert store.compact() == last
    with pytest.raises(Exception, match="(?i)exist"):
        store._commit(store.manifest(), last - 1)
    with pytest.raises(ValueError, match="columns"):
        store.append(rows.select("doc_id"))
    assert store.vacuum() > 0 and key(store.read()) == key(everything)
    assert store.vacuum() == 0


def test_registered_compaction_merges(spark):
    """The query's rows are the table's, and they come out of merged shards."""
    sf = "/root/testdata/sf0.001"
    rows = compaction.op10_compaction(spark, sf).collect()
    want = Counter((r["doc_id"], len(r["text"].encode()), hashlib.md5(r["text"].encode()).hexdigest()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert Counter((r["doc_id"], r["text_bytes"], r["text_md5"]) for r in rows) == want and all(r["merged"] for r in rows)


# -- near copies by five-word shingles ----------------------------------------------------------


def _word_sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def _jaccard_groups(texts):
    """Component of each text by all pairs of word sets: the first index that each reaches."""
    found = [_word_sets(t) for t in texts]
    root = list(range(len(found)))
    for i, a in enumerate(found):
        for j in range(i):
            common = len(a & found[j])
            if root[i] != root[j] and 9 * common >= 4 * (len(a) + len(found[j])):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


@pytest.mark.parametrize("cell_limit", [24, 3])
def test_near_copies_against_all_pairs(spark, cell_limit):
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()]
    line = "this common line of ten words stands in many texts "
    for base in range(8):
        words = rng.choice(vocabulary, 60 + 40 * base).tolist()
        for copy in range(12):
            changed = list(words)
            for at in rng.integers(0, len(words), copy % 6 * (1 + base // 3)):
                changed[at] = str(rng.choice(vocabulary))
            texts.append((line if copy % 2 else "") + " ".join(changed))
    texts += ["", None, " \n", "a b", "A  b", "a b c d", "a b c d e", "a b c d e f g h", "a b c d e f g h i"] + [line + f"x{i} y{i}" for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = materialize(nearcopies.sets(docs, nearcopies.frequent_shingles(docs)), "prints")
    found = {r["node"]: r["component"] for r in components.connected_components(nearcopies.links(prints, docs, cell_limit=cell_limit, stars=1)).collect()}
    names = {r["doc_id"]: found.get(r["fp"], r["fp"]) for r in prints.select("doc_id", "fp").collect()}
    first: dict = {}
    told = [first.setdefault(names[i], i) for i in range(len(texts))]
    assert told == _jaccard_groups(texts) and 80 < len(set(told)) < len(texts) - 20


def _just_unlike(spark, bases=3, copies=50):
    """Texts whose pairs lie about the least similarity: of 110 words, one or two of them changed where no other copy's are."""
    rng = np.random.default_rng(11)
    rows = []
    for base in range(bases):
        words = [f"b{base}w{i}" for i in range(110)]
        for copy in range(copies):
            changed = list(words)
            for at in rng.choice(np.arange(5, 105, 6), 1 + copy % 2, replace=False):
                changed[at] = f"c{base}x{copy}y{at}"
            rows.append(" ".join(changed))
    return rows, spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


@pytest.mark.parametrize("block_rows", [1024, 16])
def test_near_copies_of_one_shingle_in_blocks(spark, monkeypatch, block_rows):
    monkeypatch.setattr(nearcopies, "BLOCK_ROWS", block_rows)
    texts, docs = _just_unlike(spark)
    prints = materialize(nearcopies.sets(docs, nearcopies.frequent_shingles(docs)), "prints")
    found = nearcopies.links(prints, docs, cell_limit=3, stars=0)
    groups = {r["node"]: r["component"] for r in components.connected_components(found).collect()}
    names = {r["doc_id"]: groups.get(r["fp"], r["fp"]) for r in prints.select("doc_id", "fp").collect()}
    first: dict = {}
    told = [first.setdefault(names[i], i) for i in range(len(texts))]
    assert told == _jaccard_groups(texts) and 3 < len(set(told)) < len(texts)


def test_crowded_shingle_gives_a_forest(spark):
    texts, docs = _just_unlike(spark, bases=1, copies=120)
    prints = materialize(nearcopies.sets(docs, nearcopies.frequent_shingles(docs)), "prints")
    crowded = prints.select(F.lit(1).alias("shingle"), "fp", "n", F.col("fp").alias("component"), F.lit(len(texts)).cast("long").alias("members"))
    pairs = [(r["a"], r["b"]) for r in nearcopies.across(crowded, prints).collect()]
    # Sets meet in two classes of size each; all pairs would be thousands.
    assert 0 < len(pairs) <= 3 * len(texts) and all(a < b for a, b in pairs)


def test_pipeline_drops_languages_not_learned(spark):
    import corpus_pipeline

    others = {
        -1: "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, ché la diritta via era smarrita. Ahi quanto a dir qual era è cosa dura esta selva selvaggia e aspra e forte che nel pensier rinova la paura! Tant' è amara che poco è più morte; ma per trattar del ben ch'i' vi trovai, dirò de l'altre cose ch'i' v'ho scorte. Io non so ben ridir com' i' v'intrai, tant' era pien di sonno a quel punto che la verace via abbandonai.",
        -2: "Litwo! Ojczyzno moja! ty jesteś jak zdrowie. Ile cię trzeba cenić, ten tylko się dowie, kto cię stracił. Dziś piękność twą w całej ozdobie widzę i opisuję, bo tęsknię po tobie. Panno święta, co Jasnej bronisz Częstochowy i w Ostrej świecisz Bramie! Ty, co gród zamkowy nowogródzki ochraniasz z jego wiernym ludem! Jak mnie dziecko do zdrowia powróciłaś cudem.",
    }
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 3000").select("doc_id", "text", "lang")
    rows = [(k, t, None) for k, t in others.items()] + [(-3, "ok then", None), (-4, "123", None)]
    given = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, given, SF).select("doc_id").collect()}
    assert {k for k in kept if k < 0} == {-3}
    assert len({k for k in kept if k >= 0}) >= 0.995 * docs.count()


def test_pipeline_drops_near_copies_of_many_bits(spark):
    import corpus_pipeline

    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id IN (2465, 5733)").collect()}
    docs = spark.createDataFrame([(1, rows[2465]), (2, rows[5733]), (3, rows[2465]), (3, "some other text of more than five words"), (None, rows[5733])], "doc_id long, text string")
    assert (_plain_print(rows[2465]) ^ _plain_print(rows[5733])).bit_count() == 5
    kept = corpus_pipeline.unlike(spark, docs, SF)
    assert sorted((r["doc_id"], len(r["text"])) for r in kept.collect()) == [(1, len(rows[2465])), (3, 39)]


# -- pipeline ---------------------------------------------------------------------------------


def test_pipeline_stages_against_brute_force(spark, docs):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "decontamination", "packing"]
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").withColumn("label", F.lit(1)).cache()
    stages = dict(corpus_pipeline.STAGES)
    kept = rows
    for name in ("language", "quality", "near_duplicates", "decontamination"):
        out = stages[name](spark, kept, sf)
        assert out.columns == rows.columns, name
        before, out = {r["doc_id"] for r in kept.collect()}, out.cache()
        after = {r["doc_id"] for r in out.collect()}
        assert after <= before and out.count() == len(after) > 0
        kept = out
        if name == "near_duplicates":
            fps = [(r["doc_id"], _plain_print(r["text"])) for r in kept.collect()]
            assert not any((a ^ b).bit_count() <= 2 for k, (_, a) in enumerate(fps) for _, b in fps[:k])
    items = [decontaminate.normalize(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(i in decontaminate.normalize(r["text"]) for r in kept.collect() for i in items)
    pieces = stages["packing"](spark, kept, sf)
    totals = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).collect()
    assert {r["doc_id"] for r in totals} == {r["doc_id"] for r in kept.collect()} and all(r["n"] == r["t"] for r in totals)
    bad = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").collect()} & {r["doc_id"] for r in rows.collect()}
    assert len(bad & {r["doc_id"] for r in kept.collect()}) <= 0.05 * len(bad)
    empty = rows.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_pipeline_takes_odd_rows(spark):
    """Null and empty texts, null and repeated ids, a very long text and columns with the names that operators use."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    long = " ".join(f"{r['text']}" for r in docs.where("lang = 'en'").limit(200).collect())
    odd = [(None, None, "en"), (None, "", None), (-1, None, None), (-2, long, "en"), (-2, long, "en"), (None, long + " and more", None)]
    rows = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    for name in ("score", "stats", "fp", "task", "row", "label", "component", "text_hash", "key"):
        rows = rows.withColumn(name, F.lit("mine"))
    kept = rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = materialize(stage(spark, kept, sf), f"odd-{name}")
        assert kept.columns == rows.columns, name
        assert kept.where("score <> 'mine' OR stats <> 'mine' OR fp <> 'mine' OR key <> 'mine'").count() == 0, name
    told = Counter(r["doc_id"] for r in kept.where("doc_id IS NULL OR doc_id < 0").collect())
    assert sum(told.values()) <= 1 and set(told) <= {-2}  # one of the near copies of the long text at most
    assert kept.where("text IS NULL OR text = ''").count() == 0
    pieces = dict(corpus_pipeline.STAGES)["packing"](spark, kept, sf)
    assert pieces.agg(F.sum("length")).first()[0] == pieces.where("start = 0").agg(F.sum("doc_tokens")).first()[0]


def test_worker_keeps_one_operators_memory_at_a_time():
    from ownerloom.llm import _common, encoding

    path = encoding.vocabulary_path("word_bpe_49k.json")
    first = encoding.encoder(path)
    assert encoding.encoder(path) is first
    # What a task of the language stage runs, in the worker that packing used before.
    _common.worker_keeps("langid")
    assert list(_common._worker_keeps) == ["langid"]
    assert encoding.encoder(path) is not first


def test_each_stage_begins_with_the_drivers_free_memory_given_back(spark, monkeypatch):
    import corpus_pipeline

    from ownerloom.llm import _common

    assert _common.give_back_on_driver(spark)

    class GivenBack(Exception):
        pass

    def told(session):
        raise GivenBack

    monkeypatch.setattr(corpus_pipeline, "give_back_on_driver", told)
    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(GivenBack):
            stage(spark, None, "")


def test_bundler_makes_room_in_steps():
    import numpy as np

    from ownerloom.llm import langid

    bundler = langid.Bundler()
    text = "".join(chr(0x4E00 + k) for k in range(9000))
    (vector,) = bundler.bundles([text])
    assert len(bundler.rows) == 9000 and len(bundler.matrix) < 1.3 * 9000 + 2 * langid.TRIGRAMS_AT_ONCE
    keys, n = langid.trigrams(text)
    assert np.array_equal(vector, (n[:, None] * bundler.matrix[bundler.places(keys)].astype(np.int64)).sum(axis=0))
