"""Whitening, curriculum and ranked search against brute force and odd inputs."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ownerloom.llm import curriculum, lexical, whitening

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, component string, x int"
DOCS = "doc_id long, text string, source string, size string, row int"
ITEMS = "item_id long, text string, rank string"


# -- whitening --------------------------------------------------------------------------------


def spectrum(rng, values):
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize(
    "values",
    [
        [5.0, 3.0, 2.0, 1.0, 0.5],
        [1.0] * 20 + [1e-3] * 5,  # one eigenvalue twenty times
        [2.0, 2.0 + 1e-9, 1.0, 1.0 - 1e-7, 0.5, 0.5, 1e-6],  # near ties
        list(np.linspace(1, 2, 60)),
        list(10.0 ** np.linspace(-9, 3, 40)),
        [4.0, 0.0, 0.0],
        [7.0],
    ],
)
def test_feast_finds_the_leading_pairs(values):
    v = spectrum(np.random.default_rng(3), values)
    v = (v + v.T) / 2
    asked = min(32, sum(x > whitening.RANK_FLOOR * max(values) * 2 for x in values))
    found = whitening.intervals(v, asked)
    assert sum(n for _, _, n in found) >= asked
    pairs = [whitening.feast(v, *part) for part in found]
    got = np.sort(np.concatenate([p[0] for p in pairs]))[::-1][:asked]
    np.testing.assert_allclose(got, np.sort(values)[::-1][:asked], atol=1e-12 * max(values))
    u = np.concatenate([p[1] for p in pairs], axis=1)
    np.testing.assert_allclose(u.T @ u, np.eye(u.shape[1]), atol=1e-7)
    e = np.concatenate([p[0] for p in pairs])
    assert np.abs(v @ u - u * e).max() <= 1e-12 * max(values)


def test_inertia_counts_eigenvalues():
    rng = np.random.default_rng(5)
    v = rng.standard_normal((23, 23))
    v = v + v.T
    form, values = whitening.tridiagonal(v), np.linalg.eigvalsh(v)
    for shift in np.linspace(values[0] - 1, values[-1] + 1, 101):
        assert whitening.count_below(form, shift) == (values < shift).sum()
    diagonal = whitening.tridiagonal(np.diag([1.0, 2.0, 2.0, 3.0]))
    assert [whitening.count_below(diagonal, s) for s in (0.5, 1.5, 2.5, 3.5)] == [0, 1, 3, 4]


def brute_whitening(vectors, k=32):
    x = np.floor(64 * np.asarray(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    off = n * x - s
    v = (off.T.astype(object) @ off.astype(object) / n**3).astype(float)
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e)[: min(k, len(e))]
    return n, (off.astype(object) ** 2).sum(axis=1), (off / n) @ u[:, order] / np.sqrt(e[order]), e[order] / np.trace(v)


def test_whitening_equals_dense_eigenvectors(spark):
    from ownerloom.llm.queries import queries

    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    given = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    n, deviation, whitened, explained = brute_whitening([v for _, v in given])
    rows = queries()["op11_whitening"](spark, SF).collect()
    assert len(rows) == 32 * len(given) and {r["n"] for r in rows} == {n}
    error = {r["identity_error"] for r in rows}
    assert len(error) == 1 and 0 <= error.pop() <= 1e-9
    by = {(r["vec_id"], r["component"]): r for r in rows}
    mine = np.array([[by[i, c]["whitened"] for c in range(1, 33)] for i, _ in given])
    signs = np.sign((mine * whitened).sum(axis=0))
    np.testing.assert_allclose(mine, whitened * signs, atol=1e-8)
    for k, (i, _) in enumerate(given):
        assert by[i, 1]["deviation"] == by[i, 32]["deviation"] == deviation[k]
    np.testing.assert_allclose([by[given[0][0], c]["explained"] for c in range(1, 33)], explained, rtol=1e-10)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(8)
    good = [[float(v) for v in row] for row in rng.standard_normal((50, 4)).astype(np.float32)]
    rows = [(k % 40, v, "c", 1) for k, v in enumerate(good)]
    odd = [(100, None, "c", 1), (101, [], "c", 1), (102, [1.0, None, 2.0, 3.0], "c", 1), (103, [float("nan")] * 4, "c", 1), (104, [float("inf"), 0.0, 0.0, 0.0], "c", 1), (105, [1.0, 2.0], "c", 1)]
    table = spark.createDataFrame([*rows, (None, good[0], "c", 1), *odd], VECTORS).repartition(5)
    taken = whitening.whole_vectors(table)
    model = whitening.fit(taken)
    n, deviation, whitened, explained = brute_whitening([*good, good[0]])
    assert model.n == n == 51
    np.testing.assert_allclose(model.values / model.trace, explained, rtol=1e-10)
    out = whitening.whiten(taken, model).collect()
    assert Counter(r["vec_id"] for r in out if r["component"] == 1) == Counter([*(k % 40 for k in range(50)), None])
    assert sorted(r["deviation"] for r in out if r["component"] == 2) == sorted(deviation)
    assert whitening.identity_error(taken, model) < 1e-10
    # Ranks below the number of dimensions, a single row, no row.
    flat = spark.createDataFrame([(k, [float(k), 2.0 * k, 5.0], "c", 1) for k in range(9)], VECTORS)
    assert len(whitening.fit(whitening.whole_vectors(flat)).values) == 1
    single = whitening.fit(whitening.whole_vectors(flat.limit(1)))
    assert single.n == 1 and len(single.values) == 0
    assert whitening.fit(whitening.whole_vectors(flat.limit(0))) is None


def test_whitening_of_large_entries_is_exact(spark):
    rng = np.random.default_rng(9)
    big = [[float(v) for v in row] for row in (rng.standard_normal((20, 3)) * 1e9).astype(np.float32)]
    taken = whitening.whole_vectors(spark.createDataFrame([(k, v, "c", 1) for k, v in enumerate(big)], VECTORS).repartition(3))
    model = whitening.fit(taken)
    _, deviation, whitened, _ = brute_whitening(big)
    out = {(r["vec_id"], r["component"]): r for r in whitening.whiten(taken, model).collect()}
    for k in range(20):
        assert out[k, 1]["deviation"] == (int(deviation[k]) if deviation[k] < 1 << 63 else None)
        assert abs(abs(out[k, 1]["whitened"]) - abs(whitened[k, 0])) < 1e-9


# -- curriculum -------------------------------------------------------------------------------


def brute_targets(words, weights=(5, 2, 1), most=3):
    """Targets by rounds: share by weight, cut at the caps, share the excess anew."""
    order = sorted((s for s in words if s is not None)) + [None] * (None in words)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(words.values()))
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] >= most * words[s]}
        if not over:
            return target | {s: share * weight[s] for s in open_}
        for s in over:
            target[s] = float(most * words[s])
            left -= target[s]
        open_ -= over
    return target


def words_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(12)
    names = ["b", "a", None, "", "\U0001f600", "￮", "tiny", "bare"]
    share = [0.4, 0.3, 0.1, 0.05, 0.08, 0.05, 0.02]
    rows = [(int(k), " ".join(["w"] * int(rng.integers(0, 60))), names[rng.choice(7, p=share)], "s", 1) for k in range(900)]
    rows += [(None, "same words here", "b", "s", 1)] * 40 + [(3, "\x0b\x0c  x", "a", None, 1), (4, None, "tiny", "s", 1), (5, "", "bare", "s", 1), (6, None, "bare", "s", 1)]
    return rows, spark.createDataFrame(rows, DOCS).repartition(7)


def test_targets_share_all_words_under_caps(mixed):
    rows, table = mixed
    words = defaultdict(int)
    for _, text, source, *_ in rows:
        words[source] += words_of(text)
    got = {r["source"]: r for r in curriculum.source_targets(curriculum.sized(table)).collect()}
    want = brute_targets(words)
    assert set(got) == set(words) and got["bare"]["target"] == 0
    for source, r in got.items():
        assert r["source_size"] == words[source]
        assert math.isclose(r["target"], want[source], rel_tol=1e-12, abs_tol=1e-9)
    assert math.isclose(sum(r["target"] for r in got.values()), sum(words.values()), rel_tol=1e-12)
    assert [r["source"] for r in sorted(got.values(), key=lambda r: r["turn"])] == ["", "a", "b", "bare", "tiny", "￮", "\U0001f600", None]


def integral(schedule, t, steps=20_000):
    xs = np.linspace(0, t, steps)
    return np.trapezoid(np.interp(xs, *zip(*schedule, strict=True)), xs)


def test_positions_invert_the_schedules(spark):
    shares = [k / 50 for k in range(51)]
    for schedule in (*curriculum.SCHEDULES, ((0.0, 0.0), (0.3, 0.0), (0.6, 2.0), (1.0, 0.0))):
        rows = spark.createDataFrame([(s,) for s in shares], "s double").select("s", curriculum.due_time(F.col("s"), schedule).alias("t")).collect()
        for r in rows:
            assert abs(integral(schedule, r["t"]) / integral(schedule, 1.0) - r["s"]) < 1e-6
    for wrong in (((0.0, 1.0), (0.5, 1.0)), ((0.0, 0.0), (1.0, 0.0)), ((0.0, -1.0), (1.0, 2.0)), ((0.0, 1.0), (0.7, 1.0), (0.7, 2.0), (1.0, 1.0))):
        with pytest.raises(ValueError):
            curriculum.due_time(F.lit(0.5), wrong)


def test_the_order_takes_each_demand_and_is_gapless(mixed):
    rows, table = mixed
    order = curriculum.curriculum(table).collect()
    taken = [r for r in order if r["pass"] is not None]
    assert len({r["row"] for r in order}) == len(rows)
    by_source, at = defaultdict(int), 0
    for r in sorted(taken, key=lambda r: r["first_word"]):
        assert r["first_word"] == at and 0 < r["words"] <= r["size"]
        at += r["words"]
        by_source[r["source"]] += r["words"]
    for r in order:
        assert abs(by_source[r["source"]] - r["target"]) <= 0.5
    positions = [r["position"] for r in sorted(taken, key=lambda r: r["first_word"])]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] < 1
    per_row = defaultdict(list)
    for r in taken:
        per_row[r["row"]].append(r)
    assert all(sum(r["words"] for r in v) <= 3 * v[0]["size"] and [r["pass"] for r in sorted(v, key=lambda r: r["position"])] == list(range(len(v))) for v in per_row.values())
    # By half of the time a falling schedule has used 5/8 of its demand, an even one half, a late one a quarter.
    turns = {s: k for k, s in enumerate(["", "a", "b", "bare", "tiny", "￮", "\U0001f600", None])}
    for source in ("a", "b", None):
        due = sum(r["words"] for r in taken if r["source"] == source and r["position"] < 0.5) / by_source[source]
        assert abs(due - (5 / 8, 1 / 2, 1 / 4)[turns[source] % 3]) < 0.03
    again = curriculum.curriculum(table.repartition(3)).collect()
    key = lambda r: (str(r["source"]), str(r["doc_id"]), str(r["pass"]), r["words"], str(r["position"]), str(r["first_word"]))
    assert sorted(map(key, again)) == sorted(map(key, order))


def test_an_empty_table_and_texts_without_words_mix_to_nothing(spark):
    assert curriculum.curriculum(spark.createDataFrame([], DOCS)).collect() == []
    bare = curriculum.curriculum(spark.createDataFrame([(1, None, "a", "s", 1), (2, " \t", None, "s", 1)], DOCS)).collect()
    assert [(r["words"], r["pass"], r["target"]) for r in bare] == [(0, None, 0.0)] * 2


def test_running_totals_follow_the_order(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 3)) or None, int(rng.integers(0, 50)), int(k)) for k in range(500)]
    table = spark.createDataFrame(rows, "g int, o int, v long").repartition(6)
    for by in (None, "g"):
        got = curriculum.running_totals(table, [F.col("o"), F.col("v")], {"v": "sum"}, by=by).collect()
        want = defaultdict(int)
        for r in sorted(got, key=lambda r: (r["o"], r["v"])):
            assert r["sum"] == want[r["g"] if by else 0]
            want[r["g"] if by else 0] += r["v"]


# -- ranked search ----------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def lower(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, top=10):
    found = [(i, lower(t)) for i, t in docs]
    found = [(i, len(t), Counter(t)) for i, t in found if t]
    n_docs, n_terms = len(found), sum(n for _, n, _ in found)
    df = Counter(t for _, _, c in found for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, n, c in found:
            m = 25 + (75 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in lower(text) if t in c)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        out += [(item_id, k, d, -s) for k, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return out


def rows_of(found):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect()), key=str)


@pytest.fixture(scope="module")
def library():
    rng = np.random.default_rng(21)
    words = [f"w{k}" for k in range(30)] + ["Ärger", "ärger", "ÄRGER", "中文", "x_y", "A1b", "don't", " z"]
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 25)))) for _ in range(150)]
    docs = [(int(k), t) for k, t in enumerate(texts)]
    docs += [(1000 + k, texts[3] + (". " if k % 2 else " !")) for k in range(60)]  # one bag, many members
    docs += [(None, texts[5]), (None, texts[5]), (7, texts[5]), (7, texts[5]), (2000, None), (2001, ""), (2002, " .,;\n\x00"), (2003, "W1 w1-w1/w1" * 3000), (2004, "other words alone")]
    items = [(int(k), " ".join(rng.choice(words, int(rng.integers(1, 12))))) for k in range(20)]
    items += [(3, "w1 w1 w1 w2"), (None, "W4"), (50, None), (51, "?!"), (52, "nowhere to be found"), (53, texts[3])]
    return docs, items


@pytest.mark.parametrize(("block_terms", "matrix", "held"), [(500_000, 2_000_000, 16 << 20), (25, 60, 900)])
def test_ranked_search_equals_brute_force(spark, library, monkeypatch, block_terms, matrix, held):
    docs, items = library
    monkeypatch.setattr(lexical, "MATRIX", matrix)
    monkeypatch.setattr(lexical, "HELD_BYTES", held)
    table = spark.createDataFrame([(i, t, "s", "z", 1) for i, t in docs], DOCS).repartition(5)
    asked = spark.createDataFrame([(i, t, "r") for i, t in items], ITEMS).repartition(2)
    assert rows_of(lexical.search(table, asked, block_terms=block_terms)) == sorted(brute_search(docs, items), key=str)


def test_copies_are_one_class_and_expand_by_id(spark, library):
    docs, _ = library
    table = spark.createDataFrame([(i, t, "s", "z", 1) for i, t in docs], DOCS).repartition(5)
    vocabulary = sorted({t.encode() for _, text in docs for t in lower(text)})
    found = lexical.bags(table, vocabulary)
    terms = [len(lower(t)) for _, t in docs if lower(t)]
    grouped = lexical.classes(found, len(terms), sum(terms)).collect()
    assert len(grouped) == len({(25 + 75 * len(lower(t)) * len(terms) // sum(terms), tuple(sorted(Counter(lower(t)).items()))) for _, t in docs if lower(t)})
    assert [r["ids"] for r in grouped if 1000 in r["ids"]] == [[3, *range(1000, 1009)]]
    assert [r["ids"] for r in grouped if None in r["ids"]] == [[5, 7, 7, None, None]]


def test_search_over_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b", "r")], ITEMS)
    assert lexical.search(docs, items).collect() == []
    assert lexical.search(spark.createDataFrame([(1, "a b", "s", "z", 1)], DOCS), items.limit(0)).collect() == []
    assert rows_of(lexical.search(spark.createDataFrame([(1, "a b", "s", "z", 1)], DOCS), items)) == brute_search([(1, "a b")], [(1, "a b")])
