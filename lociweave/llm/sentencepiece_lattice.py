"""SentencePiece encoding and decoding with a relational lattice.

The distinct words of all documents become a table. Their substrings of bounded length are exploded and
equi-joined to the piece table; what matches are the edges of each word's lattice. The edges are grouped
by word and folded by ``aggregate``:

* **Unigram models**: Viterbi. The state holds the best score and the borders of the best path of every prefix.
* **BPE models**: the library does not take the best-scoring path there; it merges neighbours, best
  piece first, leftmost of equals. The fold replays that on the same lattice: the state is a bit per
  border between characters, an edge may merge if both its ends are borders and exactly one border lies
  between, and each step clears the border inside the best edge that may merge.

So both give the ids of the library. A word's segmentation is one number (a bit per border), and returns
to the documents in side tables, one per block of rows; the documents themselves are never shuffled. A
word of over 62 characters does not fit a number: it is segmented where it stands, by the same rules.

A word here is what lies between two characters that stand side by side in no piece: no piece and no merge
can cross such a border. That parts texts at white space and punctuation, and leaves few distinct words.
"""

from __future__ import annotations

import heapq
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociweave.llm.side_tables import BLOCK, read_side, released, runs, sliced, with_blocks, write_side
from lociweave.runtime import drop_stored, small_batches, store

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
MOST_CHARS = 62
#: More pieces than this are joined by shuffle; fewer are below 16 MB, which every executor may hold.
BROADCAST_PIECES = 300_000

# Fixed values of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes):
    """(number, value) of a protocol buffer message; groups do not occur."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            yield number, varint()
        elif kind == 2:
            size = varint()
            yield number, data[at : at + size]
            at += size
        else:
            size = {1: 8, 5: 4}[kind]
            yield number, data[at : at + size]
            at += size


@dataclass(frozen=True)
class Model:
    """Pieces in the order of their ids, and the flags that matter here."""

    pieces: tuple  # (text, score, type)
    kind: int
    dummy_prefix: bool
    bigrams: frozenset = field(default=frozenset(), repr=False)  # characters that stand side by side in some piece

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, t in self.pieces if t == NORMAL)


def load_model(path: str = MODEL) -> Model:
    """Read a model file on the driver. Only models without normalisation rules that keep white space are handled."""
    with open(path, "rb") as f:
        data = f.read()
    pieces, kind, rules, prefix, squeeze = [], UNIGRAM, b"", True, True
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
        elif number == 2:
            kind = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            spec = dict(_fields(value))
            rules, prefix, squeeze = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
    if rules or squeeze or kind not in (UNIGRAM, BPE):
        raise ValueError("the model rewrites text before encoding or is neither unigram nor BPE")
    if any(t in (USER_DEFINED, UNUSED) for _, _, t in pieces):
        raise ValueError("user-defined and unused pieces are not handled")
    if not all(f"<0x{b:02X}>" in {p for p, _, t in pieces if t == BYTE} for b in range(256)):
        raise ValueError("the model has no piece for every byte, so texts would not come back")
    return Model(tuple(pieces), kind, prefix, frozenset(p[i : i + 2] for p, _, t in pieces if t == NORMAL for i in range(len(p) - 1)))


class Cutter:
    """Texts -> (their words one after another, number of words of each text), on all characters at once."""

    def __init__(self, model: Model):
        letters = sorted({c for pair in model.bigrams for c in pair})
        self.number = np.zeros(0x110000, np.uint16)
        self.number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        apart = np.ones((self.width, self.width), bool)
        for a, b in model.bigrams:
            apart[self.number[ord(a)], self.number[ord(b)]] = False
        self.apart = apart.ravel()
        self.first = SPACE if model.dummy_prefix else ""

    def __call__(self, texts: list) -> tuple[pa.Array, np.ndarray]:
        spelt = [self.first + t if t else "" for t in texts]
        text = "".join(spelt).replace(" ", SPACE)
        if not text:
            return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
        x = self.number[np.frombuffer(text.encode("utf-32-le"), np.uint32)].astype(np.int32)
        upto = np.cumsum(np.fromiter(map(len, spelt), np.int64, len(spelt)))
        border = np.empty(len(x), bool)
        border[:-1] = self.apart[x[:-1] * self.width + x[1:]]
        border[upto[upto > 0] - 1] = True
        ends = np.flatnonzero(border) + 1
        count = np.diff(np.searchsorted(ends, upto, side="right"), prepend=0)
        data = text.encode()
        return _strings(data, np.append(_starts(data), len(data))[ends]), count


def _starts(data) -> np.ndarray:
    """Where the characters of UTF-8 bytes start."""
    return np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)


def _strings(data, ends: np.ndarray) -> pa.Array:
    """The strings that end at these bytes, one after another, without a copy."""
    offsets = np.zeros(len(ends) + 1, np.int32)
    offsets[1:] = ends
    return pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(data))


def _grouped(texts: list, size: int = 2_000_000):
    """Neighbouring texts, of about so many characters together."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t or "") > size:
            yield texts[start:i]
            start, held = i, 0
        held += len(t or "")
    yield texts[start:]


# --- Segmentation of one word, for words that no number holds ---------------------------------------


def segment_bpe(word: str, scores: dict) -> list[str]:
    """Merges by a heap over a linked list of symbols."""
    n = len(word)
    sym, before, after = list(word), list(range(-1, n - 1)), [*range(1, n), -1]
    heap: list = []

    def offer(i):
        j = after[i]
        if j >= 0 and (merged := sym[i] + sym[j]) in scores:
            heapq.heappush(heap, (-scores[merged], i, merged))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, merged = heapq.heappop(heap)
        j = after[i] if sym[i] is not None else -1
        if j < 0 or sym[i] + sym[j] != merged:
            continue
        sym[i], sym[j], after[i] = merged, None, after[j]
        if after[i] >= 0:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [s for s in sym if s is not None]


def segment_unigram(word: str, scores: dict, longest: int, unknown: float) -> list[str]:
    best = [(0.0, 0)] + [(float("-inf"), 0)] * len(word)
    for e in range(1, len(word) + 1):
        for s in range(max(0, e - longest), e):
            score = scores.get(word[s:e], unknown if e - s == 1 else None)
            if score is not None and best[s][0] + score > best[e][0]:
                best[e] = (best[s][0] + score, s)
    out, e = [], len(word)
    while e:
        out.append(word[best[e][1] : e])
        e = best[e][1]
    return out[::-1]


# --- The lattice -----------------------------------------------------------------------------------


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def lattice(words: DataFrame, model: Model) -> DataFrame:
    """Distinct words -> (word, n, edges): the substrings that are pieces, by rising cost.

    Of a BPE model, an edge is (place, ends, inside): its place in the order of merging (rank of the score, then
    start), the bits of its ends and of what lies inside. Of a unigram model it is (cost, s, e).
    """
    spark, is_bpe = words.sparkSession, model.kind == BPE
    least = 2 if is_bpe else 1  # single characters never merge, so BPE needs no edges for them
    normal = [(p, s) for p, s, t in model.pieces if t == NORMAL and len(p) >= least]
    rank = {s: i for i, s in enumerate(sorted({s for _, s in normal}, reverse=True))}
    pieces = spark.createDataFrame([(p, float(s), rank[s] * 64) for p, s in normal], "piece string, score double, place long")
    if len(normal) <= BROADCAST_PIECES:
        pieces = F.broadcast(pieces)
    # Rows of a word stay in the partition of its group; sorting them by a hash first spares comparing strings.
    cut = words.select("word", F.xxhash64("word").alias("h"), F.length("word").alias("n")).filter(F.col("n") >= least)
    starts = cut.select("word", "h", "n", F.explode(F.sequence(F.lit(0), F.col("n") - least)).alias("s"))
    spans = starts.select("word", "h", "n", "s", F.explode(F.sequence(F.lit(least), F.least(F.lit(max(least, model.longest)), F.col("n") - F.col("s")))).alias("k"))
    found = spans.withColumn("piece", F.substring("word", F.col("s") + 1, F.col("k"))).join(pieces, "piece")
    s, e = F.col("s"), F.col("s") + F.col("k")
    edge = F.struct((F.col("place") + s).alias("place"), _bit(s).bitwiseOR(_bit(e)).alias("ends"), (_bit(e) - _bit(s + 1)).alias("inside")) if is_bpe else F.struct((-F.col("score")).alias("cost"), s, e.alias("e"))
    return found.groupBy("h", "word").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(edge)).alias("edges")).drop("h")


def fold_bpe(n: Column, edges: Column) -> Column:
    """Borders after all merges: bit i is set if a piece starts or ends at character i."""
    may = lambda mask: lambda x: (mask.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(mask.bitwiseAND(x["inside"])) == 1)
    # The highest bit, beside all borders, says that nothing can merge any more: later steps need no search.
    found = lambda mask: mask.bitwiseAND(F.bitwise_not(F.get(F.filter(edges, may(mask)), F.lit(0))["inside"]))
    step = lambda mask, _: F.when(mask < 0, mask).otherwise(F.coalesce(found(mask), mask.bitwiseOR(F.lit(-(2**63)))))
    return F.aggregate(F.sequence(F.lit(1), n - 1), _bit(n + 1) - 1, step).bitwiseAND(F.lit(2**63 - 1))


def fold_viterbi(n: Column, edges: Column, unknown: float) -> Column:
    """Borders of the path with the least cost. A character without a piece costs what the model charges for unknown ones."""
    missing = F.lit(-unknown)
    State = "struct<cost:double,mask:bigint>"
    start = F.array(F.struct(F.lit(0.0).alias("cost"), F.lit(1).cast("long").alias("mask")).cast(State))

    def step(state, e):
        ending = F.filter(edges, lambda x: x["e"] == e)
        known = F.exists(ending, lambda x: x["s"] == e - 1)
        paths = F.transform(ending, lambda x: F.struct((F.get(state, x["s"])["cost"] + x["cost"]).alias("cost"), F.get(state, x["s"])["mask"].bitwiseOR(_bit(e)).alias("mask")).cast(State))
        alone = F.struct((F.get(state, e - 1)["cost"] + missing).alias("cost"), F.get(state, e - 1)["mask"].bitwiseOR(_bit(e)).alias("mask")).cast(State)
        return F.concat(state, F.array(F.array_min(F.when(known, paths).otherwise(F.concat(paths, F.array(alone))))))

    return F.get(F.aggregate(F.sequence(F.lit(1), n), start, step), n)["mask"]


def unknown_score(model: Model) -> float:
    return min((s for _, s, t in model.pieces if t == NORMAL), default=0.0) - 10.0


def segment(words: DataFrame, model: Model) -> DataFrame:
    """(word, mask) of the words that have any edge; others stay single characters."""
    edges = lattice(words, model)
    mask = fold_bpe(F.col("n"), F.col("edges")) if model.kind == BPE else fold_viterbi(F.col("n"), F.col("edges"), unknown_score(model))
    return edges.select("word", mask.alias("mask"))


# --- Documents -------------------------------------------------------------------------------------


def _words_of(model: Model):
    """Batches of (block, text) -> the distinct words of each block, without those that need no lattice: single characters and too long ones."""

    def run(batches):
        now, found, held, cut = None, [], 0, Cutter(model)

        def distinct():
            return pa.concat_arrays(found).unique() if found else pa.array([], pa.string())

        def sent():
            words = distinct()
            for i in range(0, len(words), 50_000):
                part = words.slice(i, 50_000)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(now, pa.string()), len(part)), part], names=[BLOCK, "word"])

        for batch in sliced(batches, 500):
            for a, b, block in runs(batch.column(0).to_pylist()):
                if block != now:
                    yield from sent()
                    now, found, held = block, [], 0
                for some in _grouped(batch.column(1).slice(a, b - a).to_pylist()):
                    words = cut(some)[0].unique()
                    n = pc.utf8_length(words)
                    found.append(words.filter(pc.and_(pc.greater(n, 1), pc.less_equal(n, MOST_CHARS))))
                    held += len(found[-1])
                    if held > 1_000_000:
                        found = [distinct()]
                        held = len(found[0]) // 2
        yield from sent()

    return run


class Speller:
    """A table of words and their ids; ``load`` takes the words of a block with their borders, unknown ones are spelt when met."""

    def __init__(self, model: Model):
        self.model, self.scores = model, {p: s for p, s, t in model.pieces if t == NORMAL}
        self.longest, self.unknown = model.longest, unknown_score(model)
        names = [(p, i) for i, (p, _, t) in enumerate(model.pieces) if t == NORMAL]
        self.pieces, self.number = pa.array([p for p, _ in names], pa.string()), np.array([i for _, i in names], np.int32)
        self.byte = np.zeros(256, np.int32)
        for i, (p, _, t) in enumerate(model.pieces):
            if t == BYTE:
                self.byte[int(p[3:5], 16)] = i
        self.load(pa.array([], pa.string()), np.zeros(0, np.int64))

    def _ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after another, and where each piece's end. What is no piece is spelt by its bytes."""
        at = pc.index_in(pieces, value_set=self.pieces)
        known = np.asarray(at.is_valid())
        offsets = np.frombuffer(pieces.buffers()[1], np.int32)[: len(pieces) + 1].astype(np.int64)
        n = np.where(known, 1, np.diff(offsets))
        ends = np.cumsum(n)
        out = np.empty(ends[-1] if len(ends) else 0, np.int32)
        out[ends[known] - 1] = self.number[np.asarray(at.drop_null())]
        if not known.all():
            size = n[~known]
            within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            data = np.frombuffer(pieces.buffers()[2], np.uint8)
            out[np.repeat((ends - n)[~known], size) + within] = self.byte[data[np.repeat(offsets[:-1][~known], size) + within]]
        return out, ends

    def load(self, words: pa.Array, masks: np.ndarray) -> None:
        """A piece ends after character i of a word if bit i + 1 of its mask is set."""
        data = "".join(words.to_pylist()).encode()
        size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.cumsum(size)
        within = np.arange(size.sum()) - np.repeat(upto - size, size)
        last = np.flatnonzero((np.repeat(masks, size) >> (within + 1)) & 1) + 1
        ids, ends = self._ids(_strings(data, np.append(_starts(data), len(data))[last]))
        self.words, self.flat = words, ids
        self.offsets = np.concatenate(([0], ends[np.searchsorted(last, upto, side="right") - 1])) if len(words) else np.zeros(1, np.int64)

    def learn(self, words: pa.Array) -> None:
        """Words that the block's table does not have: no edge is in them, or no number holds them."""
        found = []
        for w in words.to_pylist():
            pieces = list(w) if len(w) <= MOST_CHARS else segment_bpe(w, self.scores) if self.model.kind == BPE else segment_unigram(w, self.scores, self.longest, self.unknown)
            found.append(self._ids(pa.array(pieces, pa.string()))[0] if len(pieces) > 1 else self._one(w))
        self.words = pa.concat_arrays([self.words, words])
        self.offsets = np.concatenate((self.offsets, self.offsets[-1] + np.cumsum([len(x) for x in found])))
        self.flat = np.concatenate((self.flat, *found))

    def _one(self, letter: str) -> np.ndarray:
        return self._ids(pa.array([letter], pa.string()))[0]

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of words one after another, where each word's end)."""
        at = pc.index_in(words, value_set=self.words)
        if at.null_count:
            self.learn(words.filter(at.is_null()).unique())
            at = pc.index_in(words, value_set=self.words)
        at = at.to_numpy()
        begin = self.offsets[at]
        n = self.offsets[at + 1] - begin
        ends = np.cumsum(n)
        return self.flat[np.repeat(begin - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], ends


class Decoder:
    """Ids one after another and their number of each text -> texts."""

    def __init__(self, model: Model):
        texts = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t in (CONTROL, UNKNOWN) else p.replace(SPACE, " ").encode() for p, _, t in model.pieces]
        self.length = np.array([len(x) for x in texts], np.int64)
        self.begin, self.every = np.cumsum(self.length) - self.length, np.frombuffer(b"".join(texts), np.uint8)
        self.skip = int(model.dummy_prefix)

    def __call__(self, ids: np.ndarray, sizes) -> list[str]:
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.length):
            raise ValueError("an id is not in the model")
        n = self.length[ids]
        upto = np.concatenate(([0], np.cumsum(n)))
        data = self.every[np.arange(upto[-1]) + np.repeat(self.begin[ids] - upto[:-1], n)].tobytes()
        out, a = [], 0
        for b in upto[np.cumsum(np.asarray(sizes, np.int64))].tolist():
            own = data[a:b]
            out.append((own[self.skip :] if self.skip and own[:1] == b" " else own).decode("utf-8", "replace"))
            a = b
        return out


def encode(docs: DataFrame, model: Model, text_col: str = "text", ids_col: str = "ids", keep_text: bool = True, decoded_col: str | None = None) -> DataFrame:
    """``docs`` and an array of ids, equal to the library's; one row per input row.

    Null or empty text: no ids. Literal white space symbols in a text are encoded like spaces, as the library
    does. All other columns pass through (the text itself only with ``keep_text``); one named as the ids is
    replaced. With ``decoded_col`` the ids are decoded again in the same pass. The order of rows is kept. A column of :func:`with_blocks` is used if there is one. Of equally
    good merges the leftmost comes first; of paths of equal cost that with the smaller border bits. Texts of any
    length are read whole, about two million characters at a time where there are several. An empty table gives an empty one.
    """
    docs = docs.drop(ids_col, *([decoded_col] if decoded_col else []))
    held = docs.select(*[c for c in docs.columns if c != BLOCK], BLOCK) if BLOCK in docs.columns else with_blocks(docs)
    kept = [c for c in held.columns if c != BLOCK and (keep_text or c != text_col)]
    asked = store(held.select(BLOCK, F.col(text_col).cast("string")).mapInArrow(released(_words_of(model)), f"{BLOCK} string, word string"), "block-words")
    answers = asked.join(segment(asked.select("word").distinct(), model), "word").select(BLOCK, "word", "mask")
    path = write_side(answers, "block-segments")
    drop_stored(asked)

    schema = T.StructType([*(held.schema[c] for c in kept), T.StructField(ids_col, T.ArrayType(T.IntegerType())), *([T.StructField(decoded_col, T.StringType())] if decoded_col else [])])
    at = held.columns.index(text_col)

    def ids_of(batches):
        now, cut, spell, back = None, Cutter(model), Speller(model), Decoder(model)
        for batch in sliced(batches, 1000):
            texts, ids, sizes, decoded = batch.column(at).cast(pa.string()), [], [], []
            for a, b, block in runs(batch.column(batch.num_columns - 1).to_pylist()):
                if block != now:
                    side, now = read_side(path, block), block
                    if side is None:
                        spell.load(pa.array([], pa.string()), np.zeros(0, np.int64))
                    else:
                        spell.load(pa.concat_arrays(side.column("word").chunks), side.column("mask").to_numpy())
                for some in _grouped(texts.slice(a, b - a).to_pylist()):
                    words, count = cut(some)
                    flat, ends = spell(words)
                    ids.append(flat)
                    sizes.append(np.diff(np.concatenate(([0], ends))[np.cumsum(count)], prepend=0))
                    if decoded_col:
                        decoded += back(flat, sizes[-1])
            offsets = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), lists, *([pa.array(decoded, pa.string())] if decoded_col else [])], names=schema.names)

    return held.mapInArrow(released(ids_of), schema)


def decode(docs: DataFrame, model: Model, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` and the text of the ids; bytes that are no UTF-8 become U+FFFD. Null or empty ids: empty text.

    Control and unknown pieces have no text. Ids outside the model raise.
    """
    docs = docs.drop(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(text_col, T.StringType())])
    at = docs.columns.index(ids_col)

    def run(batches):
        back = Decoder(model)
        for batch in sliced(batches, 200):
            column = batch.column(at)
            sizes = [n or 0 for n in column.value_lengths().to_pylist()]
            texts = back(column.flatten().to_numpy(zero_copy_only=False), sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return docs.mapInArrow(released(run), schema)


def op7_sentencepiece(spark, sf_dir):
    small_batches(spark)
    model = load_model()
    docs = with_blocks(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    docs = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("before"), BLOCK)
    out = encode(docs, model, keep_text=False, decoded_col="decoded")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("before")).alias("round_trip"))
