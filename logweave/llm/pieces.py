"""SentencePiece encoding and decoding by a max-plus parallel scan.

The ids are those of the model's own encoder (BPE merges, byte pieces for characters that the
vocabulary lacks). In such an encoding any run of pieces is the encoding of the text it covers, and
a sequence of pieces is an encoding if all its neighbours are one. So the encoding of a giant
document is a path over boundary states: a state of a cut is a piece that covers the character
before it and reaches some characters past it. Which one the encoding holds isn't known when the
text is cut, so each chunk yields a transfer matrix in the max-plus semiring: entry (i, j) is 0 if
the chunk's text between states i and j is encoded with both pieces at its ends, else minus
infinity. Products of these matrices are associative: blocks of chunks are combined, then blocks,
then states are read off from right to left, and every chunk is encoded on its own between its two
states.

No piece runs over the start of a word (a space after another character) or a control character
that no piece holds. Words are encoded once and remembered; a batch's words are dictionary-encoded
and their ids gathered by offsets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from logweave.llm.common import Scratch, blocks, fresh, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CHUNK = 16_384  # characters; documents of two chunks or more are scanned in parallel
BLOCK = 64  # chunks whose matrices are combined at once
LOW = -(1 << 60)
CACHE = 1 << 16  # words that a worker remembers
PLAIN = 256  # characters of such a word at most
TEXT_BYTES = 1 << 20  # of text that a task encodes at once


class Pieces:
    """The encoder and decoder of a SentencePiece BPE model whose pieces hold the space mark only at their front."""

    def __init__(self, path: str):
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = model.SentencePiece
        bare = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        fits = model.trainer_spec.model_type == model.trainer_spec.BPE and not model.trainer_spec.treat_whitespace_as_suffix
        fits &= not (model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces)
        if not fits or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces) or any(MARK in n.lstrip(MARK) for n in bare):
            raise ValueError("a BPE model is needed that doesn't normalize and holds the space mark only before words")
        model.normalizer_spec.add_dummy_prefix = False  # the texts here begin with their space
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.bare = {n.replace(MARK, " ") for n in bare}
        self.longest = max(map(len, bare), default=1)
        shown = [p.piece.replace(MARK, " ").encode() if p.type == kinds.NORMAL else bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else b"" for p in model.pieces]
        shown[self.library.unk_id()] = model.trainer_spec.unk_surface.encode()
        self.shown = pa.array(shown, pa.binary())
        spelled = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.literal = [spelled.get(f"<0x{b:02X}>", self.library.unk_id()) for b in MARK.encode()]
        used = set("".join(bare))
        self.sure = np.zeros(256, bool)  # bytes that are pieces of their own
        self.sure[[b for b in range(32) if chr(b) not in used]] = True
        self.near: dict[tuple[str, str], bool] = {}
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def words(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where words of these bytes begin; texts begin at `begins`."""
        edge = np.zeros(len(data), bool)
        edge[1:] = (data[1:] == 32) & (data[:-1] != 32)
        own = self.sure[data]
        edge |= own
        edge[1:] |= own[:-1]
        mark = MARK.encode()
        if len(data) >= 3:  # a mark that the text itself holds
            found = np.flatnonzero((data[:-2] == mark[0]) & (data[1:-1] == mark[1]) & (data[2:] == mark[2]))
            edge[found] = True
            edge[found[found + 3 < len(data)] + 3] = True
        edge[begins[begins < len(data)]] = True
        return np.flatnonzero(edge)

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of texts (strings without nulls), each encoded as it stands."""
        texts = pa.concat_arrays([texts.cast(pa.large_string())])  # offsets begin at 0
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if not len(data):
            return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int32)
        at = self.words(data, offsets[:-1])
        cut = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        coded = cut.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        slots = np.fromiter(map(self.place.get, distinct, repeat(-1)), np.int64, len(distinct))
        if len(self.place) > CACHE:
            self.forget()
            slots[:] = -1
        starts, sizes = self.starts[slots], self.sizes[slots]
        new = np.flatnonzero(slots < 0)
        words = [distinct[i] for i in new.tolist()]
        made = self.library.encode(words, num_threads=1) if words else []
        for n in [n for n, w in enumerate(words) if w == MARK]:
            made[n] = self.literal
        sizes[new] = np.fromiter(map(len, made), np.int64, len(made))
        extra = np.fromiter(chain.from_iterable(made), np.int32, int(sizes[new].sum()))
        known = len(self.ids)
        starts[new] = known + np.cumsum(sizes[new]) - sizes[new]
        ids = np.concatenate([self.ids, extra])
        code = coded.indices.to_numpy(zero_copy_only=False)
        each = sizes[code]
        ends = np.cumsum(each)
        out = ids[np.arange(ends[-1]) + np.repeat(starts[code] - (ends - each), each)]
        if max(map(len, words), default=0) <= PLAIN:  # else a rare block, which isn't remembered
            self.place.update(zip(words, range(len(self.starts), len(self.starts) + len(words))))
            self.ids, self.starts, self.sizes = ids, np.concatenate([self.starts, starts[new]]), np.concatenate([self.sizes, sizes[new]])
        bounds = np.searchsorted(at, offsets)  # the first word of each text
        return np.concatenate([[0], ends])[bounds], out

    def encode(self, text: str) -> list[int]:
        return self.encode_array(pa.array([text], pa.string()))[1].tolist() if MARK in text else self.library.encode(text)

    def decode_array(self, lists: pa.Array) -> pa.Array:
        """The texts of lists of ids: the bytes of all pieces in a row, without the space that stands before each text."""
        lists = lists.cast(pa.large_list(pa.int32()))
        offsets = lists.offsets.to_numpy()
        flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
        joined = self.shown.cast(pa.large_binary()).take(flat)
        ends = np.frombuffer(joined.buffers()[1], np.int64)[: len(flat) + 1]
        data = np.frombuffer(joined.buffers()[2] or b"", np.uint8)
        bounds = ends[offsets - offsets[0]]
        spaced = (bounds[:-1] < bounds[1:]) & (data[np.minimum(bounds[:-1], max(len(data) - 1, 0))] == 32) if len(data) else np.zeros(len(lists), bool)
        keep = np.ones(len(data), bool)
        keep[bounds[:-1][spaced]] = False
        bounds = bounds - np.concatenate([[0], np.cumsum(spaced)])
        made = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[keep]))])
        try:
            return made.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:  # ids that spell no UTF-8
            return pa.array([x.decode("utf-8", "replace") for x in made.to_pylist()], pa.string())

    def single(self, piece: str) -> bool:
        """Whether a text is encoded as one piece, or is one character."""
        return len(piece) == 1 or piece in self.bare and len(self.encode(piece)) == 1

    def follows(self, a: str, b: str) -> bool:
        """Whether two single pieces are neighbours in the encoding of their text."""
        found = self.near.get((a, b))
        if found is None:
            if len(self.near) > CACHE:
                self.near.clear()
            found = self.near[a, b] = self.encode(a + b) == self.encode(a) + self.encode(b)
        return found

    def states(self, window: str, cut: int) -> list[tuple[int, int]]:
        """(begin, end) of all pieces in the window that cover the character before a cut; a character of no piece is one."""
        near = ((b, e) for b in range(max(0, cut - self.longest), cut) for e in range(cut, min(len(window), b + self.longest) + 1))
        return [(b, e) for b, e in near if self.single(window[b:e])]

    def ahead(self, window: str, state: tuple[int, int], end: int, known: list[int] | None) -> list[int]:
        """For each place up to `end`, where the last piece of the encoding that goes on from a state begins; -1 where it has no boundary.

        There is one such piece at most. If the last ones agree with another state's result over the
        longest piece, both go on alike.
        """
        last, alike, alive = [-1] * (end + 1), 0, state[1]
        last[state[1]] = state[0]
        for to in range(state[1] + 1, end + 1):
            if to - alive > self.longest:
                break
            for b in range(max(state[1], to - self.longest), to):
                if last[b] >= 0 and self.single(window[b:to]) and self.follows(window[last[b] : b], window[b:to]):
                    last[to], alive = b, to
                    break
            alike = alike + 1 if known is not None and known[to] == last[to] else 0
            if alike > self.longest:
                return last[: to + 1] + known[to + 1 :]
        return last

    def sure_places(self, window: str, begin: int, end: int) -> list[int]:
        """The first and the last place in [begin, end) that no piece runs over, if there is any."""
        ok = lambda i: i == 0 or (window[i] == " " and window[i - 1] != " ") or any(x == MARK or ord(x) < 32 and self.sure[ord(x)] for x in window[i - 1 : i + 1])
        first = next((i for i in range(begin, end) if ok(i)), None)
        return [] if first is None else [first, next(i for i in range(end - 1, begin - 1, -1) if ok(i))]

    def transfer(self, window: str, begin: int, size: int, first: bool, last: bool) -> np.ndarray:
        """The (entry, exit) matrix of a chunk: `size` characters of the window from `begin` on; it reaches over the longest piece on both sides."""
        end = begin + size
        entries = [(begin, begin)] if first else self.states(window, begin)
        exits = [(end, end)] if last else self.states(window, end)
        starts = lambda state, got: (ids := self.encode(window[state[0] : state[1]])) == got[: len(ids)]
        stops = lambda state, got: (ids := self.encode(window[state[0] : state[1]])) == got[len(got) - len(ids) :]
        sure = self.sure_places(window, begin, end)
        if sure:
            a = np.array([0 if starts(s, self.encode(window[s[0] : sure[0]])) else LOW for s in entries])
            b = np.array([0 if s[0] >= sure[1] and stops(s, self.encode(window[sure[1] : s[1]])) else LOW for s in exits])
            if last:
                b[:] = 0
            return np.maximum(a[:, None] + b, LOW)
        out, known = np.full((len(entries), len(exits)), LOW, np.int64), None
        for i, s in enumerate(entries):
            last = self.ahead(window, s, min(len(window), end + self.longest), known)
            known = known or last
            for j, t in enumerate(exits):
                if t[0] < t[1] and last[t[1]] == t[0] or t[0] == t[1] and last[t[1]] >= 0:
                    out[i, j] = 0
        return out


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return np.maximum((a[:, :, None] + b[None]).max(1), LOW)


def best_path(matrices: list[np.ndarray], entry: int = 0, leaving: int = 0) -> list[tuple[int, int]]:
    """(entry, exit) states of the best path through matrices in order, from one state to another."""
    value = np.full(len(matrices[0]), LOW, np.int64)
    value[entry] = 0
    values = [value]
    for m in matrices:
        value = np.maximum((value[:, None] + m).max(0), LOW)
        values.append(value)
    state, out = leaving, []
    for m, before in zip(reversed(matrices), reversed(values[:-1])):
        came = int((before + m[:, state]).argmax())
        out.append((came, state))
        state = came
    return out[::-1]


_LOADED: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    """One per Python worker; its word cache outlives tasks."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def _stack(rows: pa.Table) -> list[np.ndarray]:
    return [np.array(m, np.int64).reshape(h, -1) for m, h in zip(rows.column("m").to_pylist(), rows.column("h").to_pylist())]


def _states(steps: list[tuple[int, int]], numbers: list[int], rows: pa.Table, names: list[str]) -> pa.Table:
    return pa.table({**{n: rows.column(n) for n in names}, "n": pa.array(numbers, pa.int32()), "i": pa.array([x for x, _ in steps], pa.int32()), "j": pa.array([x for _, x in steps], pa.int32())})


def _lists(offsets: np.ndarray, ids: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, chunk: int = CHUNK, exact: bool = False) -> DataFrame:
    """(key, text_sha256, n_chunks, ids) per row: the ids that the model's own encoder gives. Null texts are empty; empty ones have no ids.

    A space stands before every text, as the vocabulary expects. exact: a mark U+2581 that the text itself
    holds is spelled by its byte pieces, and text_sha256 is that of the text; else it reads as a space, as
    the model's encoder reads it, and text_sha256 is that of the text with marks as spaces. Equal rows are
    encoded alike; other columns are left out, so none can clash. A document's ids make one row. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pieces")
    chunk = max(chunk, 4 * pieces_of(vocabulary).longest)
    whole_text = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), (whole_text if exact else F.replace(whole_text, F.lit(MARK), F.lit(" "))).alias("text"))
    rows = rows.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256)).withColumn("text", F.when(F.col("text") == "", F.col("text")).otherwise(F.concat(F.lit(" "), "text")))
    kind = dict(rows.dtypes)["key"]
    giant = F.length("text") > 2 * chunk

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(vocabulary)
        for held in batches:
            for batch in blocks(held, "text", TEXT_BYTES):
                ids = _lists(*pieces.encode_array(batch.column("text")))
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("sha"), pa.array([1] * len(ids), pa.int32()), ids], ["key", "sha", "n_chunks", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = pieces_of(vocabulary).longest
        for held in batches:
            for k, sha, t in zip(*(held.column(c).to_pylist() for c in ("key", "sha", "text"))):
                n = len(t) // chunk  # the last chunk takes the rest
                for at in range(0, n, 64):
                    part = range(at, min(at + 64, n))
                    begins = [max(0, i * chunk - longest) for i in part]
                    ends = [len(t) if i == n - 1 else (i + 1) * chunk for i in part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k] * len(part), held.schema.field("key").type), pa.array([sha] * len(part)), pa.array([n] * len(part), pa.int32()), pa.array(part, pa.int32()),
                         pa.array([i * chunk - b for i, b in zip(part, begins)], pa.int32()), pa.array([e - i * chunk for i, e in zip(part, ends)], pa.int32()),
                         pa.array([t[b : e + longest] for b, e in zip(begins, ends)])],
                        ["key", "sha", "n_chunks", "n", "begin", "size", "window"],
                    )

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(vocabulary)
        for b in (x for held in batches for x in blocks(held, "window")):
            made = [pieces.transfer(t, begin, size, n == 0, n == of - 1) for t, begin, size, n, of in zip(*(b.column(c).to_pylist() for c in ("window", "begin", "size", "n", "n_chunks")))]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("sha"), b.column("n"), pa.array([len(m) for m in made], pa.int32()), pa.array([m.ravel() for m in made], pa.list_(pa.int64()))], ["key", "sha", "n", "h", "m"])

    def product(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("n")
        out = None
        for m in _stack(rows):
            out = m if out is None else combine(out, m)
        return pa.table({"key": rows.column("key")[:1], "sha": rows.column("sha")[:1], "n": rows.column("block")[:1], "h": pa.array([len(out)], pa.int32()), "m": pa.array([out.ravel()], pa.list_(pa.int64()))})

    def between_blocks(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("n")
        return _states(best_path(_stack(rows)), rows.column("n").to_pylist(), rows, ["key", "sha"])

    def inside_block(rows: pa.Table, states: pa.Table) -> pa.Table:
        rows = rows.sort_by("n")
        if not (rows.num_rows and states.num_rows):
            return _states([], [], rows[:0], ["key", "sha"])
        return _states(best_path(_stack(rows), states.column("i")[0].as_py(), states.column("j")[0].as_py()), rows.column("n").to_pylist(), rows, ["key", "sha"])

    def backtrace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(vocabulary)
        for b in (x for held in batches for x in blocks(held, "window")):
            texts = []
            for t, begin, size, n, of, i, j in zip(*(b.column(c).to_pylist() for c in ("window", "begin", "size", "n", "n_chunks", "i", "j"))):
                end = begin + size
                texts.append(t[begin if n == 0 else pieces.states(t, begin)[i][1] : end if n == of - 1 else pieces.states(t, end)[j][1]])
            ids = _lists(*pieces.encode_array(pa.array(texts, pa.string())))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("sha"), b.column("n_chunks"), b.column("n"), ids], ["key", "sha", "n_chunks", "n", "ids"])

    short = rows.where(~giant).mapInArrow(whole, f"key {kind}, sha string, n_chunks int, ids array<int>")
    copies = rows.where(giant).groupBy("key", "sha").agg(F.count("*").alias("copies"))
    chunks = rows.where(giant).mapInArrow(cut, f"key {kind}, sha string, n_chunks int, n int, begin int, size int, window string")
    chunks = scratch.save(chunks.dropDuplicates(["key", "sha", "n"]), "chunks")
    steps = scratch.save(chunks.mapInArrow(matrices, f"key {kind}, sha string, n int, h int, m array<long>"), "matrices").withColumn("block", F.floor(F.col("n") / BLOCK).cast("int"))
    state = f"key {kind}, sha string, n int, i int, j int"
    products = steps.groupBy("key", "sha", "block").applyInArrow(product, f"key {kind}, sha string, n int, h int, m array<long>")
    outer = products.groupBy("key", "sha").applyInArrow(between_blocks, state).withColumnRenamed("n", "block")
    inner = steps.groupBy("key", "sha", "block").cogroup(outer.groupBy("key", "sha", "block")).applyInArrow(inside_block, state)
    same = [F.col("c.key").eqNullSafe(F.col("s.key")), F.col("c.sha") == F.col("s.sha"), F.col("c.n") == F.col("s.n")]
    ready = chunks.alias("c").join(inner.alias("s"), same).select("c.*", "s.i", "s.j")
    parts = ready.mapInArrow(backtrace, f"key {kind}, sha string, n_chunks int, n int, ids array<int>")
    joined = parts.groupBy("key", "sha").agg(F.first("n_chunks").alias("n_chunks"), F.sort_array(F.collect_list(F.struct("n", "ids"))).alias("parts"))
    long = joined.select("key", "sha", "n_chunks", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"))
    same = [F.col("l.key").eqNullSafe(F.col("k.key")), F.col("l.sha") == F.col("k.sha")]
    long = long.alias("l").join(copies.alias("k"), same).select("l.*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k.copies"))).alias("one")).drop("one")
    return short.unionByName(long).select(F.col("key").alias(key), F.col("sha").alias("text_sha256"), "n_chunks", "ids")


def decode(encoded: DataFrame, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """keep + decoded, the text of each row's ids. Null ids give an empty text; ids that spell no UTF-8 show replacement characters."""
    fields = list(encoded.select(*keep).schema)
    ids, text = fresh(encoded.select(*keep), "__ids", "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = pieces.decode_array(part.column(ids))
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in fields], texts], [*[f.name for f in fields], text])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return encoded.select(*keep, F.coalesce("ids", F.array().cast("array<int>")).alias(ids)).mapInArrow(run, f"{kinds}, `{text}` string")


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, n_chunks, n_pieces, ids and whether decoding them gives the text back.

    Null texts count as the empty text, which has no pieces. Every row gives one row, also those that repeat an id or
    have none; equal texts get equal pieces. Other columns aren't read; an empty table gives no rows.
    """
    back = decode(encode(docs, exact=True), ["doc_id", "text_sha256", "n_chunks", "ids"])
    same = F.sha2(F.col("decoded").cast("binary"), 256) == F.col("text_sha256")
    return back.select("doc_id", "n_chunks", F.size("ids").alias("n_pieces"), "ids", same.alias("round_trip"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded: doc_id, n_chunks, n_pieces, ids, round_trip; odd rows as in round_trip."""
    return round_trip(table(spark, sf_dir, "documents"))
