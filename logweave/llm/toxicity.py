"""Toxicity by class-conditional Kneser-Ney models.

Two character n-gram models of words, one of texts labelled toxic and one of ordinary ones, are
discounted and interpolated with one shared lower-order Kneser-Ney distribution, whose
continuation counts come from both classes. What neither class has seen then has the same
probability in both, so rare words don't speak for a class. A text's log-likelihood ratio is
summed over its words and normalised by their number, as it is and above several levels (a few
insults in a long text weigh more than a drift over all words); a logistic fit on labelled rows
that the models haven't seen turns these rates into a score.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.common import Scratch, blocks, fresh, possibly, table

ORDER = 6
DISCOUNT = 0.75
SAMPLE = 20_000  # labelled rows per class that the logistic curve is fitted on at most, by hash of the id
MAX_GRAMS = 1 << 21  # n-grams of a model that is broadcast; a larger one is joined with the words
OFTEN = 1 << 18  # most frequent words whose ratio is broadcast beside a model that is joined
OFTEN_CHARS = 48  # characters of such a word at most
LEVELS = (0.0, 1.0, 2.0, 3.0, 4.0, 6.0)
WORD = re.compile(r"[^\W\d_]+")
START, END = "\x02", "\x03"
CACHE = 1 << 16  # words whose ratio a task remembers, beside those of the block at hand
FEATURES = ["__words", "__total", *[f"__over{i}" for i in range(len(LEVELS))]]


def _keys(text: str, at: np.ndarray, place: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the n-grams that end at the positions, and of their contexts. place: distance from the word's start."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    gram, context = np.zeros(len(at), np.uint64), np.full(len(at), 0x51ED270B, np.uint64)
    for k in range(order):
        x = np.where(place >= k, cps[np.maximum(at - k, 0)] + np.uint64(1), np.uint64(0))
        x *= np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
        x ^= x >> np.uint64(29)
        gram = (gram ^ x) * np.uint64(0xBF58476D1CE4E5B9)
        if k:
            context = (context ^ x) * np.uint64(0xBF58476D1CE4E5B9)
    return gram, context


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.float32)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[i] == wanted, values[i]


def word_keys(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the words' n-grams and of their contexts, word by word, and where each word's begin."""
    text = "".join([f"{START}{w}{END}" for w in words])
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(text)) - np.repeat(starts, sizes)
    at = np.flatnonzero(place)
    return *_keys(text, at, place[at], order), starts - np.arange(len(words))


class Model:
    """Log-likelihood ratios of n-grams seen in either class, and of the backoff weights of seen contexts."""

    def __init__(self, grams: pa.Table, contexts: pa.Table, order: int):
        self.order = order
        self.grams, self.ratios = self._sorted(grams)
        self.contexts, self.backoffs = self._sorted(contexts)

    @staticmethod
    def _sorted(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        keys, values = (c.to_numpy() for c in rows.columns)
        keys = keys.view(np.uint64)
        order = np.argsort(keys)
        return keys[order], values[order]

    def words(self, words: list[str]) -> np.ndarray:
        """The log-likelihood ratio of each word."""
        gram, context, starts = word_keys(words, self.order)
        seen, ratio = _found(self.grams, self.ratios, gram)
        known, backoff = _found(self.contexts, self.backoffs, context)
        each = np.where(seen, ratio, np.where(known, backoff, 0.0))
        return np.add.reduceat(each, starts)


class Tables:
    """The same ratios as tables of (key, r) in the shared folder, for a model of any size."""

    def __init__(self, grams: DataFrame, contexts: DataFrame, order: int):
        self.grams, self.contexts, self.order = grams, contexts, order


class Often:
    """Ratios of frequent words. Others have 0, which adds nothing to any rate."""

    def __init__(self, ratios: dict[str, float]):
        self.ratios = ratios

    def words(self, words: list[str]) -> np.ndarray:
        return np.array([self.ratios.get(w, 0.0) for w in words])


def keyed(rows: DataFrame, order: int, kind: int) -> DataFrame:
    """(key, r) of rows (text, r): the n-gram's key (kind 0), or the key of the context that a text is (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                # a context is keyed as the n-gram it begins; that one's last character takes no part
                texts = [t + " " * kind for t in batch.column("text").to_pylist()]
                sizes = np.array([len(t) for t in texts], np.int64)
                keys = _keys("".join(texts), np.cumsum(sizes) - 1, sizes - 1, order)[kind]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column("r")], ["key", "r"])

    return rows.mapInArrow(run, "key long, r float")


def labelled(labels: DataFrame, key: str, label: str, usable: Column) -> DataFrame:
    """(key, label), one row per id. Null ids and labels don't count; any 1 makes an id a 1."""
    return labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & usable).groupBy(F.col(key).alias("key")).agg(F.max((F.col(label) > 0).cast("int")).alias("label"))


def count_grams(rows: DataFrame, order: int) -> DataFrame:
    """(gram, n0, n1) over rows of (text, label): n-grams inside words, each with its class counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "text", 2 << 20):
                counts: list[dict[str, int]] = [{}, {}]
                for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                    held = counts[label]
                    for w in WORD.findall((text or "").lower()):
                        held[w] = held.get(w, 0) + 1
                for label, held in enumerate(counts):
                    grams: dict[str, int] = {}
                    for w, n in held.items():
                        s = f"{START}{w}{END}"
                        for i in range(1, len(s)):
                            g = s[max(0, i - order + 1) : i + 1]
                            grams[g] = grams.get(g, 0) + n
                    n = pa.array(grams.values(), pa.int64())
                    none = pa.array([0] * len(grams), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(grams.keys(), pa.string()), none if label else n, n if label else none], ["gram", "n0", "n1"])

    counted = rows.select("text", "label").mapInArrow(run, "gram string, n0 long, n1 long")
    return counted.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def shared_probability(grams: DataFrame, order: int, discount: float, scratch: Scratch) -> DataFrame:
    """(low, p): interpolated Kneser-Ney probability of each n-gram's last character after the rest.

    Counts are numbers of distinct left extensions, level by level down to single characters.
    """
    drop = lambda c: F.expr(f"substring({c}, 2)")
    levels, current = [], grams.select(F.col("gram"))
    for _ in range(order - 1):
        current = current.where(F.length("gram") > 1).groupBy(drop("gram").alias("gram")).agg(F.count("*").alias("v"))
        current = scratch.save(current, f"level{len(levels)}")
        context = F.expr("left(gram, length(gram) - 1)")
        after = current.groupBy(context.alias("h")).agg(F.sum("v").alias("c"), F.count("*").alias("t"))
        levels.append(current.withColumn("h", context).join(after, "h"))
    p = None
    for n, level in enumerate(reversed(levels)):
        own = F.greatest(F.col("v") - discount, F.lit(0.0)) / F.col("c")
        weight = discount * F.col("t") / F.col("c")
        ends = level.where(F.length("gram") == 1).select("gram", (own + weight / F.col("t")).alias("p"))
        if p is None:
            p = ends
        else:
            longer = level.where(F.length("gram") > 1).withColumn("low", drop("gram"))
            longer = longer.join(p.select(F.col("gram").alias("low"), F.col("p").alias("q")), "low").select("gram", (own + weight * F.col("q")).alias("p"))
            p = longer.unionByName(ends)
        p = scratch.save(p, f"shared{n}")
    return p.select(F.col("gram").alias("low"), "p")


def fit_models(rows: DataFrame, order: int = ORDER, discount: float = DISCOUNT, max_grams: int = MAX_GRAMS) -> Model | Tables:
    """The class models of rows (text, label), of all their n-grams; the driver gets at most max_grams and their contexts."""
    scratch = Scratch(rows.sparkSession, "kneser-ney")
    grams = scratch.save(count_grams(rows, order), "grams")
    context = F.expr("left(gram, length(gram) - 1)")
    contexts = grams.groupBy(context.alias("h")).agg(*[f(F.col(f"n{k}")).alias(f"{name}{k}") for k in (0, 1) for name, f in (("a", F.sum), ("t", lambda c: F.count_if(c > 0)))])
    lower = shared_probability(grams, order, discount, scratch)
    joined = grams.withColumns({"h": context, "low": F.expr("substring(gram, 2)")}).join(contexts, "h").join(lower, "low")

    def probability(k: int) -> Column:
        mixed = F.greatest(F.col(f"n{k}") - discount, F.lit(0.0)) + discount * F.col(f"t{k}") * F.col("p")
        return F.when(F.col(f"a{k}") > 0, mixed / F.col(f"a{k}")).otherwise(F.col("p"))

    def backoff(k: int) -> Column:
        return F.when(F.col(f"a{k}") > 0, discount * F.col(f"t{k}") / F.col(f"a{k}")).otherwise(F.lit(1.0))

    ratios = joined.select(F.col("gram").alias("text"), F.log(probability(1) / probability(0)).cast("float").alias("r"))
    backoffs = contexts.select(F.col("h").alias("text"), F.log(backoff(1) / backoff(0)).cast("float").alias("r"))
    ratios, backoffs = keyed(ratios, order, 0), keyed(backoffs, order, 1)
    if grams.count() > max_grams:
        return Tables(scratch.save(ratios, "ratios"), scratch.save(backoffs, "backoffs"), order)
    return Model(ratios.toArrow(), backoffs.toArrow(), order)


def _word_id(word: str) -> bytes:
    return hashlib.blake2b(word.encode(), digest_size=16).digest()


def word_ratios(words: DataFrame, model: Tables) -> DataFrame:
    """words (id, word, ...) + v, each word's log-likelihood ratio, by joins of its n-grams with the model's tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "word"):
                texts = batch.column("word").to_pylist()
                gram, context, _ = word_keys(texts, model_order)
                row = np.repeat(np.arange(len(texts)), [len(w) + 1 for w in texts])
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), pa.array(gram.view(np.int64)), pa.array(context.view(np.int64))], ["id", "gram", "context"])

    model_order = model.order
    places = words.select("id", "word").mapInArrow(run, "id binary, gram long, context long")
    ratios = model.grams.withColumnRenamed("key", "gram")
    seen = places.join(ratios, "gram").select("id", "r")
    backed = places.join(ratios, "gram", "left_anti").join(model.contexts.withColumnRenamed("key", "context"), "context").select("id", "r")
    sums = seen.unionByName(backed).groupBy("id").agg(F.sum(F.col("r").cast("double")).alias("v"))
    return words.join(sums, "id", "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def joined_rates(rows: DataFrame, keep: list[str], model: Tables, text: str) -> DataFrame:
    """rates() by a model that isn't broadcast: the ratios of all distinct words are joined, only frequent ones go to all tasks."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "toxic-words")
    whole_text = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = rows.withColumn("__digest", F.unhex(F.sha2(whole_text.cast("binary"), 256)))
    texts = rows.select("__digest", whole_text.alias("__text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "__text", 8 << 20):
                held = Counter(w for t in batch.column("__text").to_pylist() for w in WORD.findall(t.lower()))
                yield pa.RecordBatch.from_arrays([pa.array([_word_id(w) for w in held], pa.binary()), pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["id", "word", "n"])

    words = texts.mapInArrow(count, "id binary, word string, n long").groupBy("id").agg(F.first("word").alias("word"), F.sum("n").alias("n"))
    known = scratch.save(word_ratios(scratch.save(words, "words"), model), "ratios")
    top = known.where(F.length("word") <= OFTEN_CHARS).orderBy(F.desc("n"), "id").limit(OFTEN).select("word", "v").toArrow()
    often = Often(dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist())))
    shared = spark.sparkContext.broadcast(often)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = shared.value.ratios
        for whole in batches:
            for batch in blocks(whole, "__text"):
                held = [Counter(w for w in WORD.findall(t.lower()) if w not in ratios) for t in batch.column("__text").to_pylist()]
                row = pa.array(np.repeat(np.arange(len(held)), [len(c) for c in held]))
                yield pa.RecordBatch.from_arrays([batch.column("__digest").take(row), pa.array([_word_id(w) for c in held for w in c], pa.binary()), pa.array([n for c in held for n in c.values()], pa.int64())], ["__digest", "id", "n"])

    # equal texts have equal counts, so they are one text here
    rare = texts.mapInArrow(others, "__digest binary, id binary, n long").groupBy("__digest", "id").agg(F.max("n").alias("n")).join(known.select("id", "v"), "id")
    parts = [F.col("v"), *[F.greatest(F.col("v") - level, F.lit(0.0)) for level in LEVELS]]
    more = rare.groupBy("__digest").agg(*[F.sum(F.col("n") * c).alias(f"__more{n}") for n, c in zip(FEATURES[1:], parts)])
    got = rates(rows, [*keep, "__digest"], often, text).join(more, "__digest", "left")
    return got.select(*keep, FEATURES[0], *[(F.col(n) + F.coalesce(f"__more{n}", F.lit(0.0))).alias(n) for n in FEATURES[1:]])


def rates(rows: DataFrame, keep: list[str], model: Model | Tables | Often, text: str = "text") -> DataFrame:
    """keep + the number of words and the sums of their ratios above each level. Whole texts; null is empty."""
    if isinstance(model, Tables):
        return joined_rates(rows, keep, model, text)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    fields = list(rows.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = shared.value, {}
        for whole in batches:
            for batch in blocks(whole, "__text", 1 << 20):
                texts = [WORD.findall((t or "").lower()) for t in batch.column("__text").to_pylist()]
                if len(cache) > CACHE:
                    cache.clear()
                if new := list({w for t in texts for w in t if w not in cache}):
                    cache.update(zip(new, model.words(new).tolist()))
                out = np.zeros((len(texts), len(FEATURES)))
                for row, words in zip(out, texts):
                    v = np.fromiter((cache[w] for w in words), np.float64, len(words))
                    row[:2] = len(v), v.sum()
                    row[2:] = [np.maximum(v - level, 0.0).sum() for level in LEVELS]
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], *[pa.array(c) for c in out.T]], [*[f.name for f in fields], *FEATURES])

    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{n} double" for n in FEATURES])
    return rows.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, kinds)


def feature_columns() -> list[Column]:
    """Length-normalised log rates, drawn to a common prior in short texts."""
    return [F.col("__total") / (F.col("__words") + 50.0), *[F.log((F.col(n) + 0.5) / (F.col("__words") + 50.0)) for n in FEATURES[2:]]]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, times: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and intercept by Newton's method on standardised features; a row counts `times`, once if not given."""
    times = np.ones(len(x)) if times is None else times
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (times * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (times * (p - y)) + ridge * np.r_[0, w[1:]])
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w[1:] / scale, float(w[0] - (w[1:] * mean / scale).sum())


def fit(
    docs: DataFrame, labels: DataFrame, usable: Column | None = None, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, max_grams: int = MAX_GRAMS
) -> tuple[Model | Tables | None, np.ndarray, float]:
    """(models, weights, bias) learned from labelled rows; usable says by `key` which may be learned from.

    Rows whose crc32(key) mod 5 is 4 only fit the logistic curve, those of at most `sample` ids per class;
    the models learn from all others. Without labels of both classes in both parts there is no model, and
    the bias is the share of toxic rows among those labelled (0 if none). Sampled rows count as often as
    their class has rows for each of them, so scores keep the natural share.
    """
    scratch = Scratch(docs.sparkSession, "labelled")
    known = scratch.save(labelled(labels, key, label, F.lit(True) if usable is None else usable), "ids")
    hashed = F.xxhash64(F.col("key").cast("string")).alias("id")
    # the bitmap keeps most texts without a label from the shuffle
    rows = possibly(known.select(hashed), docs.select(F.col(key).alias("key"), F.col(text).alias("text")).select("*", hashed)).drop("id")
    rows = scratch.save(rows.join(known, "key").withColumn("late", F.crc32(F.col("key").cast("string")) % 5 == 4), "texts")
    counts = {(r["late"], r["label"]): r["count"] for r in rows.groupBy("late", "label").count().collect()}
    if not all(counts.get((part, v)) for part in (False, True) for v in (0, 1)):
        total, ones = sum(counts.values()), sum(n for (_, v), n in counts.items() if v)
        return None, np.zeros(0), ones / total if total else 0.0
    model = fit_models(rows.where(~F.col("late")), max_grams=max_grams)
    late = rows.where("late")
    pick = lambda v: late.where(F.col("label") == v).select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(sample)
    curve = late.join(F.broadcast(pick(0).unionByName(pick(1))), "key")  # 2 * sample ids at any input size
    seen = rates(curve, ["label"], model).select(*[c.alias(f"f{i}") for i, c in enumerate(feature_columns())], "label").toPandas().to_numpy(np.float64)
    scratch.drop("texts")
    toxic = seen[:, -1] > 0
    weights, bias = logistic(seen[:, :-1], seen[:, -1], times=np.where(toxic, counts[True, 1] / toxic.sum(), counts[True, 0] / (~toxic).sum()))
    return model, weights, bias


def score_rows(docs: DataFrame, keep: list[str], fitted: tuple[Model | Tables | None, np.ndarray, float], text: str = "text", name: str = "score") -> DataFrame:
    """keep + the probability that a row's text is toxic. Null and empty texts get that of a text without words, equal texts equal ones.

    The columns kept travel as one struct, so none can clash with those made here; `name` shouldn't be among them.
    """
    model, weights, bias = fitted
    if model is None:
        return docs.select(*keep, F.lit(bias).alias(name))
    logit = sum((c * float(w) for c, w in zip(feature_columns(), weights)), F.lit(bias))
    held = docs.select(F.struct(*keep).alias("kept"), F.col(text).alias("text"))
    return rates(held, ["kept"], model).select("kept.*", (1 / (1 + F.exp(-logit))).alias(name))


def filter_toxic(docs: DataFrame, labels: DataFrame, usable: Column | None = None, most: float = 0.5) -> DataFrame:
    """docs without the rows that score `most` or more; all else stays as it is, also null texts, null ids and repeated rows. An empty table stays empty."""
    (score,) = fresh(docs, "__score")
    scored = score_rows(docs, docs.columns, fit(docs, labels, usable), name=score)
    return scored.where(F.col(score) < most).drop(score)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of all documents; rows whose crc32(doc_id) mod 5 is 0 are never learned from.

    Rows without an id have no label, aren't held out, and are scored; null texts score as the empty text. Rows that
    repeat an id are rows of their own, equal texts score alike. An empty table gives no rows.
    """
    docs, crc = table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5
    got = score_rows(docs, ["doc_id"], fit(docs, table(spark, sf_dir, "labels"), crc != 0))
    return got.select("doc_id", F.coalesce(crc == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
