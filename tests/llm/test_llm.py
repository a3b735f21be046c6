"""The training-data operators against brute force, exact round trips and odd inputs."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from logweave.llm import chat, langid, lines, media, minhash, mixing, neighbours, pieces, toxicity, warc
from logweave.llm.linking import prefix_pairs, prefix_tokens, union_find
from logweave.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(300)]


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], schema)


def odd_rows():
    """Nulls, empty texts, repeated rows, a long text and multi-byte characters."""
    long = " ".join(random.Random(3).choices(WORDS, k=6000))
    return [(1, "a b c d e f g h\nline two is here\n\nline two is here"), (1, "a b c d e f g h\nline two is here\n\nline two is here"), (2, None), (3, ""), (None, "a b c d e f g h"), (4, "日本語 é ▁ \\ # <tag>"), (5, long), (6, long + " tail"), (7, "  \t\n "), (8, "x")]


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


# --- line dedup


def line_truth(rows):
    at = sorted(((d, i), x.strip(" \t\r\x0b\x0c\xa0").lower()) for d, t in {(r[0], r[1]) for r in rows if r[1] is not None} for i, x in enumerate(t.split("\n")))
    first = {}
    for place, line in at:
        first.setdefault(line, place)
    grams = {x: ({x[i : i + 8] for i in range(len(x) - 7)} or {x}) for x in first if x}
    roots = components(sorted(grams, key=first.get), lambda a, b: 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b]))
    best = {}
    for line, root in roots.items():
        best[root] = min(best.get(root, first[line]), first[line])
    return {place: best[roots[line]] if line else place for place, line in at}


def test_lines_match_brute_force(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choices(WORDS, k=30)) for _ in range(12)]
    rows = []
    for i in range(40):
        picked = []
        for b in rng.sample(base, 3):
            w = b.split()
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            picked.append(" ".join(w))
        rows.append((i, "\n".join(picked)))
    got = {(r.doc, r.line_no): (r.rep_doc, r.rep_line) for r in lines.line_components(docs(spark, rows)).collect()}
    assert got == line_truth(rows)


def test_lines_odd_rows(spark):
    rows = [r for r in odd_rows() if r[0] is not None]
    frame = docs(spark, rows)
    got = {(r.doc, r.line_no): (r.rep_doc, r.rep_line) for r in lines.line_components(frame).collect()}
    assert got == line_truth(rows)
    out = {r.doc_id: r.text for r in lines.drop_lines(frame).collect()}
    assert out[1] == "a b c d e f g h\nline two is here\n" and out[2] is None and out[3] == ""
    assert lines.line_components(docs(spark, [])).count() == 0
    assert lines.drop_lines(docs(spark, odd_rows())).count() == len(odd_rows())


# --- WARC


def test_warc_revisits_and_round_trip(spark, tmp_path):
    big = "<p>\r\n\r\nWARC/1.1\r\n</p>" * 20
    rows = [(5, "http://a/ b", big), (2, None, big), (9, "http://c", big), (9, "http://c", big), (2, None, big), (4, "u", "small"), (3, "v", "small"), (7, "w", None), (None, "n", big), (8, "é", "日" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path)
    got = warc.read_archives(spark, path, payloads=True).collect()
    assert len(got) == len(rows)
    for r in got:
        html = {i: h for i, _, h in rows}[r.id] or ""
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), hashlib.sha256(html.encode()).hexdigest())
        later = r.id is not None and len(html) >= 100 and html == big and r.id > 2
        assert (r.record_type, r.refers_to) == (("revisit", 2) if later else ("response", None))
        if not later:
            assert r.payload == html.encode()
    empty = str(tmp_path / "empty")
    warc.write_archives(pages.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


# --- chat


def test_chat_round_trip(spark):
    marker = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", marker), (1, 2, "user", None), (1, 3, "assistant", "\\\\h#<\\"), (2, 0, "user", "alone"), (3, None, None, ""), (None, 1, "assistant", "x: </turn>\n"), (4, 0, "as:sistant", "é日"), (5, 0, "assistant", "a"), (5, 0, "assistant", "a")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", chat.F.lit("clash")).withColumn("rows", chat.F.lit(1))
    shown = chat.examples(turns)
    got = {r.conv_id: r for r in chat.read_back(shown).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        own = [(role, text) for _, _, role, text in own]
        loss = "".join(t for role, t in own if role == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].loss_chars, got[conv].loss_sha256) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in shown.collect():
        loss = r.text[r.loss_start : r.loss_start + r.loss_chars]
        assert (r.target_turn is None) == (r.loss_chars == 0 and loss == "") or r.target_turn
        assert not r.target_turn or r.text.endswith(loss + chat.TAIL)
    assert chat.read_back(chat.examples(turns.limit(0))).count() == 0


# --- language


def test_language_learns_and_handles_odd_rows(spark):
    rng = random.Random(2)
    alphabets = {"aa": "abcde", "bb": "vwxyz", "cc": "абвгд"}
    rows = [(i, " ".join("".join(rng.choices(alphabets[k], k=5)) for _ in range(20)), k) for i in range(90) for k in [list(alphabets)[i % 3]]]
    frame = docs(spark, rows + [(100, None), (101, "123 !"), (102, ""), (None, "abcde abc")])
    got = {r.doc_id: r for r in langid.identify(frame, langid.F.col("doc_id") < 60).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows)
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (100, 101, 102)) and got[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())
    none = langid.identify(frame, langid.F.lit(False)).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert langid.identify(frame.limit(0), langid.F.lit(True)).count() == 0


def letter_grams(text):
    """The n-grams as the docstrings define them, one text at a time."""
    out = [" "]
    for c in text:
        low = c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " "
        if low != " " or out[-1] != " ":
            out.append(low)
    s = "".join(out) + " " * (out[-1] != " ")
    return collections.Counter(s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1) if s[i : i + n] != " ") if s.strip() else collections.Counter({" ": 0})


def test_language_model_is_naive_bayes(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(i, "".join(rng.choices("ab cdÉß1\n" if i % 3 else "xyz cd", k=rng.randint(0, 60))), ["aa", "bb"][i % 3 == 0]) for i in range(60)] + [(60, None), (61, "12"), (62, "ab" * 300)]
    frame = docs(spark, rows)
    counts = {lang: sum((letter_grams(t) for _, t, name in rows[:60] if name == lang), collections.Counter()) for lang in ("aa", "bb")}

    def bucket(gram):
        x = np.frombuffer(gram.encode("utf-32-le"), np.uint32)
        return [int(b[0]) for b, _ in langid.grams(x, np.zeros(len(x), np.int32), 0, langid.BUCKETS, (len(gram),))][0]

    sums = {lang: collections.Counter() for lang in counts}
    for lang, grams in counts.items():
        for gram, n in grams.items():
            sums[lang][bucket(gram)] += n
    logs = {lang: (lambda g, n=n, all_=sum(n.values()) + 0.5 * langid.BUCKETS: np.log((n[bucket(g)] + 0.5) / all_)) for lang, n in sums.items()}
    first = None
    for piece, languages, parts in ((1 << 20, 64, 1), (7, 64, 5), (50, 1, 3)):  # cuts inside texts, one language a pass, other partitions
        monkeypatch.setattr(langid, "PIECE", piece)
        monkeypatch.setattr(langid, "LANGUAGES", languages)
        model = [(names, matrix) for names, matrix in langid.fit(frame.where("lang is not null").repartition(parts))]
        got = {r.doc_id: r for r in langid.predict(frame.repartition(parts), ["doc_id"], model).collect()}
        first = first or got
        for i, t, *_ in rows:
            grams = letter_grams(t or "")
            if not sum(grams.values()):
                assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
                continue
            v = {lang: sum(n * f(g) for g, n in grams.items()) / sum(grams.values()) ** 0.5 for lang, f in logs.items()}
            best = max(v, key=v.get)
            assert abs(got[i].score - 1 / sum(np.exp(x - v[best]) for x in v.values())) < 1e-4
            assert got[i].lang_pred == best or abs(v["aa"] - v["bb"]) < 1e-4
        if piece == 1 << 20:
            again = {r.doc_id: r for r in langid.predict(frame.repartition(7), ["doc_id"], model).collect()}
            assert again == got  # bit for bit


# --- SentencePiece


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces(pieces.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=pieces.VOCABULARY)


def hard_texts(rng, n):
    """Words, texts without any blank, runs of one character, unknown characters and literal marks."""
    for k in range(n):
        size = rng.randrange(200, 700)
        parts = (["the ", "quick", "international", " ", "  ", "é", "日本", "x", "ing", "\n", "\t"], list("abcdefgh"), ["abc", "the", "ing", "tion", "日", "inter", "national", "e"], list("ab aé日😀▁\n\t  <>"), ["="], [" "])[k % 6]
        yield "".join(rng.choice(parts) for _ in range(size // max(1, len(parts[0]))))


def scanned(vocabulary, text, chunk):
    """A text's ids by chunks alone: matrices, their path, and each chunk between its states."""
    n = len(text) // chunk
    cut = []
    for i in range(n):
        begin, end = max(0, i * chunk - vocabulary.longest), len(text) if i == n - 1 else (i + 1) * chunk
        cut.append((text[begin : end + vocabulary.longest], i * chunk - begin, end - i * chunk, i == 0, i == n - 1))
    made = [vocabulary.transfer(*x) for x in cut]
    total = made[0]
    for m in made[1:]:
        total = pieces.combine(total, m)
    assert total.tolist() == [[0]]
    ids = []
    for (window, begin, size, first, last), (i, j) in zip(cut, pieces.best_path(made)):
        ids += vocabulary.encode(window[begin if first else vocabulary.states(window, begin)[i][1] : begin + size if last else vocabulary.states(window, begin + size)[j][1]])
    return ids


def test_scan_equals_the_whole_encoding(vocabulary):
    for text in hard_texts(random.Random(5), 36):
        whole = vocabulary.encode(" " + text)
        assert scanned(vocabulary, " " + text, 64) == whole == vocabulary.encode_array(pa.array([" " + text]))[1].tolist()


def test_ids_are_those_of_the_models_own_encoder(spark, library):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: library.encode(r.text or "") for r in table.collect()}
    for chunk in (pieces.CHUNK, 200):  # with 200 characters, most documents are scanned
        got = pieces.encode(table, chunk=chunk)
        assert {r.doc_id: r.ids for r in got.collect()} == want
    rows = list(enumerate(hard_texts(random.Random(6), 24)))  # a literal mark reads as a space here
    got = {r.doc_id: r.ids for r in pieces.encode(docs(spark, rows), chunk=64).collect()}
    assert got == {i: library.encode(t) for i, t in rows}


def test_encode_round_trip(spark):
    rng = random.Random(8)
    giant = " ".join("".join(rng.choices("abcdefghij日é", k=rng.randint(1, 12))) for _ in range(1500))
    blob = "".join(rng.choices("abcdefghijklmnop", k=3000))
    rows = odd_rows() + [(20, giant), (20, giant), (21, blob)]
    frame = docs(spark, rows)
    back = pieces.decode(pieces.encode(frame, chunk=512), ["doc_id", "n_chunks", "ids"]).collect()
    assert len(back) == len(rows)
    want = collections.Counter((r[0], (r[1] or "").replace(pieces.MARK, " ")) for r in rows)
    assert collections.Counter((r.doc_id, r.decoded) for r in back) == want
    whole = {r.doc_id: r.ids for r in pieces.encode(frame).collect()}
    assert max(r.n_chunks for r in back) > 5 and all(r.ids == whole[20] for r in back if r.doc_id == 20)
    assert pieces.encode(docs(spark, [])).count() == 0


def test_round_trip_keeps_literal_marks(spark):
    rows = [(1, "▁"), (2, "a ▁▁ b▁c é▁日 ▁"), (3, " ▁ x"), (4, ""), (5, None), (6, "▁▂▃ bars 😀▁" * 90), (7, "plain text")]
    assert all(r.round_trip for r in pieces.round_trip(docs(spark, rows)).collect())
    broken = spark.createDataFrame([(1, [3 + 0xE2, 3 + 0x96]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in pieces.decode(broken, ["doc_id"]).collect()} == {1: "\ufffd", 2: "", 3: ""}
    for chunk in (pieces.CHUNK, 256):
        encoded = pieces.encode(docs(spark, rows), chunk=chunk, exact=True)
        got = {r.doc_id: r for r in pieces.decode(encoded, ["doc_id", "n_chunks", "text_sha256"]).collect()}
        assert {i: got[i].decoded for i, _ in rows} == {i: t or "" for i, t in rows}
        assert all(got[i].text_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for i, t in rows)
    assert got[6].n_chunks > 2


# --- MinHash


def shingles(text, k=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower() if (text or "").isascii() else (text or "").encode())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(4)
    rows, n = [], 0
    for _ in range(8):
        base = rng.choices(WORDS, k=120)
        for _ in range(12):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 9])):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(500, "one two"), (501, "ONE two"), (502, ""), (503, None), (504, "   ")]
    sets = {i: shingles(t) for i, t in rows}
    want = components(sorted(sets), lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))
    got = {r.doc_id: r for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert {i: (len(sets[i]), want[i], want[i] == i) for i in sets} == {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()}


def test_near_duplicates_odd_rows(spark):
    got = minhash.near_duplicates(docs(spark, odd_rows())).collect()
    assert len(got) == len(odd_rows())
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert {r.component_id for r in got if r.doc_id in (5, 6)} == {5}
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    assert minhash.keep_first(docs(spark, odd_rows())).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_prefix_filter_loses_nothing(spark):
    rng = random.Random(6)
    sets = {i: set(rng.sample(range(60), rng.randint(8, 20))) for i in range(60)}
    for i in range(60, 90):
        sets[i] = (sets[i - 60] | {rng.randrange(60)}) - {rng.randrange(60)}
    frame = spark.createDataFrame([(i, sorted(s), i) for i, s in sets.items()], "id long, items array<long>, root long")
    got, plain = ({(r.a, r.b) for r in prefix_pairs(prefix_tokens(frame, 80, 100, n), 80, 100, n).collect()} for n in (16, 0))
    want = {(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert want and want <= got and want <= plain


def test_union_find(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 140)] + [(3, 3)]
    near = {frozenset(e) for e in edges}
    nodes = sorted({x for a, b in edges if a != b for x in (a, b)})
    want = components(nodes, lambda a, b: frozenset((a, b)) in near)
    got = union_find(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"), "t")
    assert {r.id: r.root for r in got.collect()} == want


# --- mixing


def test_mix_reaches_targets(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), None, rng.choice(["a", "b", None, "z"])) for i in range(400)] + [(1000, None, None, "empty"), (None, "x y", None, "a"), (None, "x y", None, "a")]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-6
    assert all(target[s] <= 3 * sizes[s] + 1e-9 and abs(taken[s] - target[s]) < 3 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs(spark, rows).repartition(7)).collect()))
    assert mixing.mix(docs(spark, [])).count() == 0


def test_repeated_documents(spark):
    rows = [(i, "w " * (i % 9), None, "ab"[i % 2]) for i in range(60)]
    plan = {r.doc_id: (r.size, r.taken) for r in mixing.mix(docs(spark, rows)).collect()}
    got = collections.Counter(r.doc_id for r in mixing.repeat_documents(docs(spark, rows)).collect())
    assert all(got[i] == (taken // size if size else 1) for i, (size, taken) in plan.items())


# --- toxicity


def test_toxicity_tells_classes_apart(spark):
    rng = random.Random(10)
    rows, labels = [], []
    for i in range(400):
        words = rng.choices(WORDS, k=40)
        if i % 4 == 0:
            words[rng.randrange(40)] = rng.choice(["vile", "viler", "vilest"])
            words[rng.randrange(40)] = "nasty"
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    labels += [(0, None), (None, 1), (3, 0)]
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    frame = docs(spark, rows + [(900, None), (901, ""), (None, "nasty vile")])
    crc = toxicity.F.crc32(toxicity.F.col("doc_id").cast("string")) % 5
    fitted = toxicity.fit(frame, known, crc != 0)
    got = {r.doc_id: r.score for r in toxicity.score_rows(frame, ["doc_id"], fitted).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((got[i] >= 0.5) == (i % 4 == 0) for i in held)
    assert right >= 0.95 * len(held) and got[900] == got[901] and all(0 <= x <= 1 for x in got.values())
    kept = toxicity.filter_toxic(frame.withColumn("__extra", toxicity.F.lit(1)), known, crc != 0)
    assert kept.columns == [*frame.columns, "__extra"] and 0 < kept.count() < frame.count()


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    frame = docs(spark, [(1, "a"), (2, None)])
    assert {r.score for r in toxicity.score_rows(frame, ["doc_id"], toxicity.fit(frame, none)).collect()} == {0.0}


def test_toxicity_sample_keeps_the_level(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choices(WORDS, k=30))) for i in range(2000)]
    known = spark.createDataFrame([(i, int(i % 10 == 0)) for i, _ in rows], "doc_id long, toxic int")
    frame = docs(spark, rows)
    mean = lambda fitted: toxicity.score_rows(frame, ["doc_id"], fitted).agg(toxicity.F.avg("score")).first()[0]
    assert abs(mean(toxicity.fit(frame, known)) - 0.1) < 0.05
    assert abs(mean(toxicity.fit(frame, known, sample=40)) - 0.1) < 0.05
    early = toxicity.F.crc32(toxicity.F.col("doc_id").cast("string")) % 5 != 4
    model, _, share = toxicity.fit(frame, known, early, sample=40)
    assert model is None and abs(share - 0.1) < 0.02


def test_toxicity_models_know_all_labelled_texts(spark, monkeypatch):
    rng = random.Random(13)
    rows = [(i, " ".join([*rng.choices(WORDS, k=10), f"rare{rng.randrange(9999)}", "".join(rng.choices("abcdé日", k=6)), *["vile"] * (i % 5 == 0)])) for i in range(400)]
    known = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int")
    frame = docs(spark, rows + [(900, None), (901, ""), (902, "vile unseen vile"), (902, "vile unseen vile"), (None, "Größe " * 3)])
    whole, few = toxicity.fit(frame, known), toxicity.fit(frame, known, sample=20)
    assert np.array_equal(whole[0].grams, few[0].grams) and np.array_equal(whole[0].contexts, few[0].contexts)
    # a model beyond the limit of the broadcast is joined, and no n-gram of it is lost
    monkeypatch.setattr(toxicity, "OFTEN", 20, raising=False)
    learned = frame.join(known, "doc_id").selectExpr("text", "toxic as label")
    small, joined = toxicity.fit_models(learned), toxicity.fit_models(learned, max_grams=100)
    a, b = ([sorted(r, key=lambda r: (str(r[0]), *r[1:])) for r in [toxicity.rates(frame, ["doc_id"], m).collect()]][0] for m in (small, joined))
    assert [r[:2] for r in a] == [r[:2] for r in b] and len(a) == len(rows) + 5
    assert np.allclose([r[2:] for r in a], [r[2:] for r in b], atol=1e-4)


def kneser_ney(texts, order, discount):
    """Ratios of words by direct sums over all n-grams, as the docstrings define them."""
    tops = [collections.Counter(), collections.Counter()]
    for text, label in texts:
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            s = f"\x02{w}\x03"
            for i in range(1, len(s)):
                tops[label][s[max(0, i - order + 1) : i + 1]] += 1
    every = set(tops[0]) | set(tops[1])
    levels, current = [], every
    for _ in range(order - 1):
        current = collections.Counter(g[1:] for g in current if len(g) > 1)
        levels.append(current)

    def shared(gram, n):
        after = [v for g, v in levels[n].items() if g[:-1] == gram[:-1]]
        own = max(levels[n][gram] - discount, 0) / sum(after)
        weight = discount * len(after) / sum(after)
        return own + weight * (1 / len(after) if len(gram) == 1 else shared(gram[1:], n + 1))

    def ratio(gram):
        p, sides = None, []
        for top in tops:
            after = [v for g, v in top.items() if g[:-1] == gram[:-1]]
            left = discount * len(after) / sum(after) if after else 1.0
            if gram in every:
                p = shared(gram[1:], 0) if p is None else p
                sides.append(max(top[gram] - discount, 0) / sum(after) + left * p if after else p)
            else:
                sides.append(left)
        return float(np.log(sides[1] / sides[0]))

    return lambda w: sum(ratio(f"\x02{w}\x03"[max(0, i - order + 1) : i + 1]) for i in range(1, len(w) + 2))


def test_toxicity_ratios_are_kneser_ney(spark):
    rng = random.Random(21)
    texts = [(" ".join("".join(rng.choices("abcé", k=rng.randint(1, 8))) for _ in range(6)), i % 2) for i in range(24)] + [("", 0), ("damn awful", 1)]
    rows = spark.createDataFrame(texts, "text string, label int")
    direct = kneser_ney(texts, toxicity.ORDER, toxicity.DISCOUNT)
    words = sorted({w for t, _ in texts for w in t.split()}) + ["unseen", "abcabcabc", "z", "damned"]
    model = toxicity.fit_models(rows)
    assert np.allclose(model.words(words), [direct(w) for w in words], atol=1e-4)
    again = toxicity.fit_models(rows.repartition(3))
    assert again.words(words).tolist() == model.words(words).tolist()


def test_toxicity_columns_may_clash(spark):
    rng = random.Random(22)
    rows = [(i, " ".join(rng.choices(["fine", "good", "day"] if i % 3 else ["awful", "damn", "idiot"], k=12)), 777, "x") for i in range(240)] + [(None, "fine day", 1, None), (900, None, 1, None), (901, "", 1, None), (7, rng.choice(["good"]), 2, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, __words long, __score string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 240)], "doc_id long, toxic int")
    got = toxicity.filter_toxic(frame, labels)
    assert got.columns == frame.columns
    kept = collections.Counter(tuple(r) for r in got.collect())
    want = collections.Counter(r for r in rows if not (r[1] or "").split(" ")[0] in ("awful", "damn", "idiot"))
    assert kept == want
    assert toxicity.filter_toxic(frame.limit(0), labels).count() == 0


def test_mixing_columns_may_clash(spark):
    rows = [(i, "a b c d"[: 1 + 2 * (i % 4)], "s", 777, i) for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, __words long, __copy long")
    got = mixing.repeat_documents(frame)
    assert got.columns == frame.columns and {tuple(r) for r in got.collect()} <= set(rows)
    assert mixing.repeat_documents(frame.limit(0)).count() == 0


def test_rows_that_repeat_an_id_keep_their_texts(spark):
    """Another text under a known id is a document of its own; a whole row that repeats is one."""
    same = "one unique sentence about rivers\nkeep a"
    rows = [(1, same, 5, 1), (2, same, 5, 1), (2, "an entirely different unique sentence\nkeep c", 5, 1), (2, same, 6, 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, __gone long, __row long")
    got = collections.Counter(tuple(r) for r in lines.drop_lines(frame).collect())
    assert got == collections.Counter([rows[0], (2, "", 5, 1), rows[2], (2, "", 6, 2)])
    long = "\n".join(f"line number {i} of many" if i % 2 else "the same words each time" for i in range(400))
    out = lines.drop_lines(docs(spark, [(1, long)])).first().text.split("\n")
    truth_ = line_truth([(1, long)])
    assert out == [x for i, x in enumerate(long.split("\n")) if truth_[(1, i)] == (1, i)]
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words, 1), (2, words, 2), (2, "quite another text " * 9, 3), (1, words, 4), (None, words, 5), (3, None, 6), (3, "", 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, __doc long")
    kept = minhash.keep_first(frame).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:4]) for r in kept) == [(0, "word"), (1, "word"), (2, "quit"), (3, ""), (3, "")]
    assert minhash.keep_first(frame).columns == frame.columns and minhash.keep_first(frame.limit(0)).count() == 0


# --- media


def png(pixels=b"\x00abc"):
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(pixels)) + chunk(b"IEND", b"")


def test_sniffing(spark):
    import gzip

    signs = media.automaton()
    gif = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
    bmp = b"BM" + struct.pack("<IIII", 58, 0, 54, 40) + bytes(36) + b"\0\0\0\0"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cd\x01\x02\xff\xd9"
    pdf = b"%PDF-1.4\nstartxref\n0\n%%EOF"
    good = {"png": png(), "gif": gif, "bmp": bmp, "jpeg": jpeg, "pdf": pdf, "wav": media.wav_of(b"abc"), "gzip": gzip.compress(b"hello" * 50)}
    for kind, data in good.items():
        assert media.sniff(data, signs) == [(0, len(data), kind)]
        assert [(a, n) for a, n, k in media.sniff(b"xx" + data + b"yy", signs) if k == kind] == [(2, len(data))]
        assert not [x for x in media.sniff(data[:-3], signs) if x[2] == kind]
    assert media.sniff(b"BM RIFF and GIF89a in a text", signs) == []
    frame = spark.createDataFrame([(1, png(), "image/gif"), (2, b"", "a/b"), (3, None, None), (4, b"--" + png() + gif, "x/y"), (5, b"plain", "text/plain")], "id long, blob binary, said string")
    got = {r.id: r for r in media.sniff_column(frame, "blob", "said", ["id"]).collect()}
    assert (got[1].sniffed, got[1].corrected) == ("image/png", "image/png")
    assert [got[i].corrected for i in (2, 3, 4, 5)] == ["a/b", None, "x/y", "text/plain"]
    assert [p.type for p in got[4].parts] == ["image/png", "image/gif"]


def test_nested_media(spark):
    import io
    import zipfile

    signs = media.automaton()
    thumb = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cd\x01\x02\xff\xd9"
    photo = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(thumb) + 2) + thumb + b"\xff\xda\x00\x04cd\x09\xff\xd9"
    assert media.sniff(photo, signs) == [(0, len(photo), "jpeg"), (6, len(thumb), "jpeg")]

    def archive(**files):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for name, data in files.items():
                z.writestr(name, data)
        return held.getvalue()

    outer = archive(a=png(), b=archive(c=b"text"), d=b"end")
    got = media.sniff(outer, signs)
    assert [k for _, _, k in got] == ["zip", "png", "zip"] and got[0][:2] == (0, len(outer)) and media.parents(got) == [None, 0, 0]
    pdf = b"%PDF-1.4\nxref\nstartxref\n9\n%%EOF\n"
    update = lambda old: old + png() + b"\nxref\nstartxref\n" + str(len(old + png()) + 1).encode() + b"\n%%EOF\r\n"
    for data in (pdf, update(pdf), update(update(pdf)), pdf + b"1 0 obj\nstartxref\n0\n%%EOF\n"):
        assert media.sniff(data, signs)[0] == (0, len(data), "pdf")
    assert [x for x in media.sniff(pdf + pdf + b"xx", signs)] == [(0, len(pdf), "pdf"), (len(pdf), len(pdf), "pdf")]
    assert media.sniff(pdf + png() + b"startxref %%EOF", signs)[0] == (0, len(pdf), "pdf")
    frame = spark.createDataFrame([(1, len(photo), "x/y", media.wav_of(photo + outer))], "key long, n_bytes long, declared string, media binary")
    parts = media.sniff_column(frame, "media", "declared", ["key"]).first().parts
    assert [(p.type.split("/")[1], p.parent) for p in parts] == [("wav", None), ("jpeg", 0), ("jpeg", 1), ("zip", 0), ("png", 3), ("zip", 3)]
    feature = media.features(frame).first().feature
    assert feature.startswith("audio/wav@0+") and feature.endswith(";blob=audio/wav;declared=x/y;inner=5")


def test_media_payloads(spark):
    rows = odd_rows()
    got = media.features(media.media_of(docs(spark, rows), "doc_id", "text")).collect()
    assert len(got) == len(rows)
    want = collections.Counter()
    for i, t in [(r[0], r[1]) for r in rows]:
        data = (t or "").encode()
        full = data + b"\xff" * (-len(data) % 576 if data else 576)
        want[(i, len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))] += 1
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want


def test_media_are_carved_and_corrected(spark):
    """All forms, with and without notes around them, also of texts that hold media marks themselves."""
    rows = [(i, t) for i, t in enumerate([f"text {i} BM RIFF %PDF- startxref 0 %%EOF" * (i % 7) for i in range(120)])]
    blobs = {r.key: r for r in media.media_of(docs(spark, rows), "doc_id", "text").collect()}
    assert len({media.hashlib.sha256((t or "").encode()).digest() for _, t in rows}) > 90
    got = {r.doc_id: r for r in media.features(media.media_of(docs(spark, rows), "doc_id", "text")).collect()}
    seen = collections.Counter()
    for i, t in rows:
        data = t.encode()
        full = data + b"\xff" * (-len(data) % 576 if data else 576)
        digest = hashlib.sha256(full).digest()
        blob, r = bytes(blobs[i].media), got[i]
        made = (media.wav_of, media.png_of, media.bmp_of, lambda x: media.zip_of(b"sound.wav", media.wav_of(x)))[digest[0] % 4](full)
        noted = digest[1] % 4 == 0
        assert blob == (media.NOTE + made + media.NOTE if noted else made)
        assert r.media_sha256 == hashlib.sha256(blob).hexdigest() and r.payload_sha256 == hashlib.sha256(full).hexdigest()
        wave = np.frombuffer(full, np.uint8).astype(int)
        kind = ("audio/wav", "image/png", "image/bmp", "audio/wav")[digest[0] % 4]
        want = ("audio/wav", "image/png", "image/bmp", "application/zip")[digest[0] % 4] if not noted else blobs[i].declared
        place = (len(media.NOTE) if noted else 0) + (30 + len("sound.wav") if digest[0] % 4 == 3 else 0)
        size = len(made) if digest[0] % 4 < 3 else len(media.wav_of(full))
        assert r.feature.startswith(f"{kind}@{place}+{size};samples={len(full)};mean={wave.sum() / len(full):.6f};delta={np.abs(np.diff(wave)).sum()};blob={want};declared={blobs[i].declared};inner=")
        seen[digest[0] % 4, noted] += 1
    assert len(seen) == 8
    assert media.features(media.media_of(docs(spark, []), "doc_id", "text")).count() == 0


def test_archives_and_images_are_readable():
    import io
    import zipfile

    data = bytes(range(256)) * 9
    z = zipfile.ZipFile(io.BytesIO(media.zip_of(b"sound.wav", media.wav_of(data))))
    assert z.testzip() is None and z.read("sound.wav") == media.wav_of(data)
    assert media.samples_of(media.png_of(data), "png") == media.samples_of(media.bmp_of(data), "bmp") == data


def test_hostile_blobs_take_linear_time():
    import time

    signs = media.automaton()
    for part in (b"%PDF-", b"%PDF-1 startxref 0 ", b"PK\x03\x04", b"PK\x05\x06" + bytes(18), b"\xff\xd8\xff\xda\x00\x04", b"GIF89a", b"BM"):
        began = time.perf_counter()
        media.sniff(part * 40_000, signs)
        assert time.perf_counter() - began < 5
    for n, part in ((40_000, b"%PDF-1.4 %%EOF\n"), (30_000, b"%PDF-1 startxref 0 %%EOF\n"), (20_000, b"GIF89a %PDF- startxref 9 %%EOF\n")):
        for blob in (part * n, b"%PDF-" * n + b"%%EOF\n" * n, b"%PDF- startxref 7 " * n + b"startxref 1 %%EOF\n" * n):
            began = time.perf_counter()
            media.sniff(blob, signs)
            assert time.perf_counter() - began < 5, part


# --- neighbours


def truth(vectors, q, k):
    s = sorted(((-float(np.dot(vectors[q], v)), i) for i, v in vectors.items() if i != q))
    return [i for _, i in s[:k]]


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(0)
    vectors = {i: rng.normal(size=16).astype(np.float32).astype(np.float64) for i in range(600)}
    for i in range(600, 660):
        vectors[i] = vectors[7]
    rows = [(i, v.tolist()) for i, v in vectors.items()] + [(7, vectors[7].tolist()), (9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [1.0] * 5), (9005, [None] * 16), (None, [1.0] * 16), (9020, [float("inf")] * 16)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in neighbours.nearest_neighbours(frame, "vec_id % 20 = 0", k=20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert abs(r.score - float(np.dot(vectors[r.query_id], vectors[r.vec_id]))) < 1e-9
    queries = [i for i in vectors if i % 20 == 0]
    assert set(got) == set(queries) and all(len(v) == 20 and len({i for i, _ in v}) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & set(truth(vectors, q, 20))) for q in queries)
    assert hits >= 0.9 * 20 * len(queries)
    assert [i for i, _ in got[620]] == [7, *[i for i in range(600, 621) if i != 620]][:20]


def test_neighbours_small_tables(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = neighbours.nearest_neighbours(frame, "vec_id % 20 = 0").orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 0.5), (0, 2, 20, 0.0), (20, 1, 1, 0.5), (20, 2, 0, 0.0)]
    assert neighbours.nearest_neighbours(frame.limit(0), "true").count() == 0


def test_odd_rows_in_held_out_splits(spark, tmp_path):
    """op4 and op8 as queries: rows without an id, repeated rows, null, empty and letterless texts."""
    from logweave.llm import langid, toxicity

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.limit(1).drop("doc_id", "text").crossJoin(spark.createDataFrame([(None, "plain words of no one"), (None, None), (900001, None), (900002, ""), (900003, "12 34 !?"), (900004, "the same text twice"), (900004, "the same text twice")], "doc_id long, text string"))
    docs.unionByName(odd.select(docs.columns)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    n = docs.count() + 7
    told = langid.op4_langid(spark, str(tmp_path)).collect()
    nobody = sorted((r.held_out, r.lang_pred == "und") for r in told if r.doc_id is None)
    assert len(told) == n and nobody == [(False, False), (False, True)] and all(0 <= r.score <= 1 for r in told)
    assert all(r.lang_pred == "und" for r in told if r.doc_id in (900001, 900002, 900003)) and len({(r.lang_pred, r.score) for r in told if r.doc_id == 900004}) == 1
    scored = toxicity.op8_toxicity(spark, str(tmp_path)).collect()
    assert len(scored) == n and [r.held_out for r in scored if r.doc_id is None] == [False, False] and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)
    assert len({r.score for r in scored if r.doc_id in (900001, 900002)}) == 1 and len({r.score for r in scored if r.doc_id == 900004}) == 1
