"""The stages of the corpus pipeline, each on what its predecessor kept, against brute force."""

from __future__ import annotations

import collections
import random
import re

import pytest
from sentencepiece import SentencePieceProcessor

import corpus_pipeline
from logweave.llm import mixing, pieces, toxicity
from test_llm import components, line_truth, shingles

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean and toxic texts, near copies, repeated lines, nulls, empty texts, a null id."""
    folder = tmp_path_factory.mktemp("corpus")
    rng = random.Random(31)
    words = [f"{a}{b}" for a in ("river", "stone", "cloud", "field", "light", "paper") for b in ("bed", "less", "ward", "ing", "man", "top", "line", "side")]
    shared = " ".join(rng.choices(words, k=14))
    rows = []
    for i in range(120):
        body = [" ".join(rng.choices(words, k=rng.randint(12, 25))) for _ in range(3)]
        if i % 10 == 3:
            body.append(shared)
        if i % 12 == 5:
            body = [" ".join(rng.choices(["idiot", "damn", "awful", "scum"], k=12)) for _ in range(3)]
        rows.append((i, "\n".join(body), "en", ["web", "books", None][i % 3], 0))
    for i in range(30):
        w = rows[i][1].split(" ")
        w[len(w) // 2] = "changed"
        rows.append((200 + i, " ".join(w), "en", "web", 0))
    rows += [(300, None, None, None, None), (301, "", "en", "web", 0), (None, "a text without any id at all", "en", "books", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 12 == 5)) for i in range(120)], "doc_id long, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder)


def rows_of(frame):
    return [tuple(r) for r in frame.select("doc_id", "text").collect()]


def test_stages(spark, corpus, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "minhash_near_dedup", "mixing", "sentencepiece"] and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, corpus)
        out.write.parquet(str(tmp_path / name))
        kept[name] = before, after = docs, spark.read.parquet(str(tmp_path / name))
        docs = after
        assert name == "sentencepiece" or after.columns == COLUMNS

    before, after = kept["toxicity"]
    bad = {r for r in rows_of(before) if re.search("idiot|damn|awful|scum", r[1] or "")}
    assert collections.Counter(rows_of(after)) == collections.Counter(r for r in rows_of(before) if r not in bad)

    before, after = kept["line_dedup"]
    rows = rows_of(before)
    place = lambda d, i: (d is not None, d or 0, i)  # noqa: E731  null ids first
    renamed = [(-1 if d is None else d, t) for d, t in rows]
    truth = line_truth(renamed)
    want = {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if truth[(d, i)] == (d, i)) for d, t in renamed}
    assert {-1 if d is None else d: t for d, t in rows_of(after)} == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after.collect())

    before, after = kept["minhash_near_dedup"]
    sets = {d: shingles(t, 5) for d, t in rows_of(before) if d is not None}
    roots = components(sorted(sets), lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    assert collections.Counter(rows_of(after)) == collections.Counter(r for r in rows_of(before) if r[0] is None or roots[r[0]] == r[0])

    before, after = kept["mixing"]
    taken = {r.doc_id: (r.size, r.taken) for r in mixing.mix(before).collect()}
    times = collections.Counter(rows_of(after))
    assert all(times[r] == (taken[r[0]][1] // taken[r[0]][0] if taken[r[0]][0] else 1) for r in rows_of(before))

    before, after = kept["sentencepiece"]
    library = SentencePieceProcessor(model_file=pieces.VOCABULARY)
    want = collections.Counter((d, tuple(library.encode(t or ""))) for d, t in rows_of(before))
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in after.collect()) == want and all(r.round_trip for r in after.collect())


def test_run_on_empty_tables(spark, tmp_path):
    for name, kinds in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, toxic int")):
        spark.createDataFrame([], kinds).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_an_operator_frees_the_driver_while_it_runs(spark, monkeypatch):
    from logweave.llm import common

    freed = []
    monkeypatch.setattr(common, "release", lambda s: freed.append(s))
    scratch = common.Scratch(spark, "freed")
    used = [0]
    monkeypatch.setattr(common, "heap", lambda s: (used[0], 800))
    scratch.release()
    freed.clear()
    scratch.save(spark.range(3), "little")
    assert not freed
    used[0] = 101  # more than an eighth since the last time
    scratch.save(spark.range(3), "much")
    assert len(freed) == 1
    scratch.save(spark.range(3), "again")
    assert len(freed) == 1
