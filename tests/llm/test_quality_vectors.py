"""Line-first cleaning, centroid clustering and whitening against brute force, SQL and odd inputs."""

from __future__ import annotations

import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pytest

from logweave.llm import centroids, quality, registry, whitening
from test_catalog import TABLES, rows_of
from test_llm import odd_rows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string"
VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("name", ["op11_quality", "op12_centroids"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    frame = registry.QUERIES[name](spark, SF)
    result = con.execute(registry.ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert rows_of(frame.collect(), frame.columns) == rows_of(result.fetchall(), names)


# --- line-first cleaning


def base_counts(text):
    words = re.findall(quality.WORD, text or "")
    lines, seen, dups = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(quality.WORD, line):
            dups += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)} if len(grams) < 3000 else None
    return len(words), sum(map(len, words)), len(re.findall(quality.SYMBOL, text or "")), dups, None if covered is None else len(covered)


def judged(spark, rows, schema=DOCS):
    return quality.clean_lines(spark.createDataFrame(rows, schema)).collect()


def test_base_counts_by_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abcdef", k=rng.randrange(60))).replace("a b", "a\nb").replace("c", "c#") for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(r[0], r[1]) for r in odd_rows()] + [(99, "x \x0b y\xa0z　w ퟿"), (100, "one\r\ntwo\r\none\r\n")]
    for r in judged(spark, rows):
        want = base_counts(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == want[:4]
        if want[4] is not None:
            assert r["n_repeat_words"] == want[4]
            assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])


PROSE = "The river ran past the old mill and on towards the sea, as it had for a thousand years."
OTHER = "Nobody who lived in the valley could say when the wheel had last turned under its own weight."


def test_lines_are_removed_by_rule(spark):
    text = "\n".join(["Home | News | Sport | Contact", "Our valley", PROSE, "", OTHER, PROSE, "Read more", "All rights reserved.", "stuff### more$$$ and*** this%%% here&&&"])
    (r,) = judged(spark, [(1, text)])
    assert r["clean_text"] == "\n".join([PROSE, "", OTHER])
    assert (r["n_navigation"], r["n_boilerplate"], r["n_repeated"], r["n_lines"]) == (2, 1, 1, 8)
    assert r["n_punctuation"] == 4  # the menu, the heading, "Read more" and the symbols
    assert not r["kept"] or r["lost_chars"] * 2 <= r["word_chars"]


def test_clean_documents_stay_and_junk_goes(spark):
    wrapped = "it was a bright cold day in april and the clocks were\nstriking thirteen while winston smith with his chin nuzzled\ninto his breast slipped quickly through the glass doors"
    chinese = "这是一个很长的句子，用来测试没有空格的文字是否会被保留。\n" * 1 + " ".join("第二行也有足够的文字。" for _ in range(1)) + " " + " ".join(f"词{i}" for i in range(12)) + "。"
    costs = "The shop sold 40% of its stock for $12 & gave the rest away to whoever came by first that day."
    menu = "\n".join(" | ".join(f"item{i}{k}" for k in range(9)) for i in range(4))
    symbols = " ".join(f"w{i}###" for i in range(40))
    got = {r["doc_id"]: r["kept"] for r in judged(spark, [(1, PROSE + "\n" + OTHER), (2, wrapped), (3, chinese), (4, costs), (5, menu), (6, symbols), (7, PROSE + "\n" + menu), (8, None), (9, "")])}
    assert got == {1: True, 2: True, 3: True, 4: True, 5: False, 6: False, 7: False, 8: False, 9: False}


def test_cleaning_odd_tables(spark):
    schema = "doc_id long, text string, kept string, N_WORDS string, clean_text int"
    got = quality.clean_lines(spark.createDataFrame([(1, PROSE, "mine", "too", 7), (1, PROSE, "mine", "too", 7), (None, None, None, None, None)], schema))
    assert got.columns[:5] == ["doc_id", "text", "kept", "N_WORDS", "clean_text"] and {"kept1", "n_words1", "clean_text1"} <= set(got.columns)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[1]["kept1"] and rows[1]["clean_text1"] == PROSE and rows[1]["kept"] == "mine"
    assert rows[None]["clean_text1"] is None and rows[None]["kept1"] is False and rows[None]["n_words1"] == 0
    assert quality.clean_lines(spark.createDataFrame([], DOCS)).collect() == []
    long = "\n".join(f"line {i} goes on {PROSE}" for i in range(20_000))
    (r,) = judged(spark, [(1, long)])
    assert r["n_words"] == len(long.split()) and r["n_dup_lines"] == 0


# --- centroid clustering


def lloyd(rows, k=8, rounds=10, scale=1024, dims=64, seed=3):
    kept = [(i, np.floor(np.array(v, np.float32).astype(float) * scale).astype(np.int64)) for i, v in rows if v is not None and len(v) == dims and None not in v and np.isfinite(v).all()]
    kept.sort(key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1].tolist()))
    x = np.array([r[1] for r in kept])
    c = x[:k].copy()
    own = lambda: ((x[:, None, :] - c[None]) ** 2).sum(2)
    for _ in range(rounds):
        near = own().argmin(1)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = x[near == j].sum(0) // (near == j).sum()
    far = own()
    return sorted((str(r[0]), int(n), int(d)) for r, n, d in zip(kept, far.argmin(1), far.min(1))), c


def vectors(n, dims, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(5, dims)) * spread
    return [(i, (middle[i % 5] + rng.normal(size=dims) * 0.2).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("spread,bits,part_rows", [(1.0, 6, 64), (0.05, 3, 64), (0.0, 1, 4096)])
def test_clusters_by_brute_force(spark, spread, bits, part_rows):
    rows = vectors(400, 64, 1, spread)
    rows += [(1000 + i, rows[0][1]) for i in range(100)] + [(5, rows[7][1]), (5, rows[7][1]), (None, rows[3][1])]
    odd = [(2000, None), (2001, [1.0] * 63), (2002, [float("nan")] * 64), (2003, [None] + [1.0] * 63), (2004, [float("inf")] * 64), (2005, [])]
    frame = spark.createDataFrame([(*r, 0) for r in rows + odd], VECTORS).repartition(5)
    got, c = centroids.cluster_vectors(frame, bits=bits, part_rows=part_rows)
    want, truth = lloyd(rows + odd)
    assert (c == truth).all()
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in got.collect()) == want


def test_few_and_no_vectors_cluster(spark):
    few = [(i, [float(i)] * 64) for i in range(3)]
    got, c = centroids.cluster_vectors(spark.createDataFrame([(*r, 0) for r in few], VECTORS))
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in got.collect()) == lloyd(few)[0] and len(c) == 3
    got, c = centroids.cluster_vectors(spark.createDataFrame([], VECTORS))
    assert got.collect() == [] and len(c) == 0 and got.columns == ["vec_id", "cluster", "distance"]


def test_intervals_hold_the_distances_and_settle_most(spark):
    x = np.floor(1024 * np.array([v for _, v in vectors(2000, 64, 2)])).astype(np.int64)
    grid = centroids.Cells(x[:500])
    cells = grid.decode(__import__("pyarrow").array([r.tobytes() for r in grid.encode(x)]))
    c = x[:8]
    bounds = centroids.Bounds(grid, c)
    for r in range(8):
        low, high = bounds.intervals(cells, r)
        exact = ((x[:, None] - c[None]) ** 2).sum(2) - ((x - c[r]) ** 2).sum(1)[:, None]
        assert (low <= exact).all() and (exact <= high).all()
    among = bounds.candidates(cells)
    assert among[np.arange(len(x)), ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)].all() and (among.sum(1) == 1).mean() > 0.5


# --- whitening


def test_pivoted_cholesky_and_jacobi():
    rng = np.random.default_rng(0)
    for d, rank in ((1, 1), (2, 2), (7, 7), (12, 5), (64, 64)):
        b = rng.normal(size=(d, rank)) * np.logspace(0, -4, rank)
        a = b @ b.T
        factor, order = whitening.pivoted_cholesky(a)
        assert factor.shape[1] == rank and np.allclose(factor @ factor.T, a[np.ix_(order, order)], atol=1e-12)
        values, components = whitening.eigen(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:rank], rtol=1e-9, atol=1e-14)
        assert np.allclose(a @ components, components * values, atol=1e-10) and np.allclose(components.T @ components, np.eye(rank), atol=1e-10)
    assert whitening.eigen(np.zeros((3, 3)))[0].size == 0


def whiten_truth(rows, most=32):
    kept = [(i, np.floor(np.array(v, np.float32).astype(float) * 64).astype(np.int64) + 1_000_000) for i, v in rows]
    x = np.array([r[1] for r in kept], object)
    n, s = len(x), x.sum(0)
    y = ((n * x - s) / n).astype(float)
    values, components = np.linalg.eigh(y.T @ y / n)
    values, components = values[::-1][:most], components[:, ::-1][:, :most]
    return [r[0] for r in kept], ((n * x - s) ** 2).sum(1), y @ components / np.sqrt(values), values / np.trace(y.T @ y / n)


def test_whitening_by_brute_force(spark):
    rows = vectors(300, 40, 3) + [(1000, vectors(1, 40, 9)[0][1])] * 2 + [(None, vectors(1, 40, 8)[0][1])]
    odd = [(2000, None), (2001, [1.0] * 39), (2002, [float("nan")] * 40), (2003, [None] + [1.0] * 39), (2005, [])]
    got, model = whitening.whitened(spark.createDataFrame([(*r, 0) for r in rows + odd], VECTORS).repartition(3))
    ids, deviation, w, explained = whiten_truth(rows)
    found = got.collect()
    by = lambda i, d: (str(i), d)
    assert sorted(by(r["vec_id"], r["deviation"]) for r in found) == sorted(by(i, d) for i, d in zip(ids, deviation))
    truth = {by(i, d): v for i, d, v in zip(ids, deviation, w)}
    sign = np.sign(sum(np.array(r["w"]) * truth[by(r["vec_id"], r["deviation"])] for r in found))
    for r in found:
        assert np.allclose(np.array(r["w"]) * sign, truth[by(r["vec_id"], r["deviation"])], atol=1e-9)
    assert np.allclose(model.values / model.trace, explained, rtol=1e-9)
    assert whitening.identity_error(got, 32) < 1e-9


def test_whitening_few_equal_and_no_vectors(spark):
    make = lambda rows: whitening.whitened(spark.createDataFrame([(*r, 0) for r in rows], VECTORS))
    got, model = make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert [list(r["w"]) for r in got.collect()] == [[], []] and len(model.values) == 0
    got, model = make([(1, [1.0, 2.0, 3.0]), (2, [2.0, 4.0, 3.0])])
    assert len(model.values) == 1 and sorted(abs(round(r["w"][0], 9)) for r in got.collect()) == [1.0, 1.0]
    got, model = whitening.whitened(spark.createDataFrame([], VECTORS))
    assert got.collect() == [] and model is None
    got, model = make([(1, [1e8, 0.0]), (2, [0.0, 1e8]), (3, [5.0, 5.0])])
    assert len(model.values) >= 1 and whitening.identity_error(got, len(model.values)) < 1e-6


def test_op13_query(spark):
    frame = registry.QUERIES["op13_whitening"](spark, SF)
    rows = frame.collect()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    assert len(rows) == 32 * len(table) and {r["component"] for r in rows} == set(range(1, 33)) and rows[0]["identity_error"] < 1e-9
    ids, deviation, w, explained = whiten_truth([(r["vec_id"], r["embedding"]) for r in table])
    at = {i: k for k, i in enumerate(ids)}
    sums = {}
    for r in rows:
        assert r["n"] == len(table) and r["deviation"] == deviation[at[r["vec_id"]]] and abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9
        sums[r["component"]] = sums.get(r["component"], 0) + np.sign(r["whitened"] * w[at[r["vec_id"]], r["component"] - 1])
    assert all(abs(s) > 0.9 * len(table) for s in sums.values())
