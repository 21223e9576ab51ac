"""Near-duplicate documents: an exact Jaccard self-join on word shingles by token-combination prefixes.

Tokens are 64-bit hashes of five consecutive words. Tokens in many documents form the frequent class,
all others the rare class, and the common order is: rare before frequent, by hash within a class.

* **Rare class, single tokens.** With similarity t, two linked sets share a token within the first
  ``n - ceil(t n) + 1`` tokens of each. Where that token is rare, it is an index key by itself.
* **Frequent class, pairs of tokens.** If the first shared token is frequent, both prefixes hold all rare
  tokens of their sets, and none of these is shared. All of the overlap is then among frequent tokens.
  The prefix over these is extended to ``2 (1 - t) n + 2`` tokens: so many that more tokens are shared than
  there are differences between them, hence two neighbours in one set's order are neighbours in the
  other's. The keys are pairs of neighbours; a set has as many as it has frequent tokens in its prefix.

Any assignment of classes is right as long as it is common to all, so the class table may be bounded: it
holds the most frequent tokens, 8 bytes each, and at most ``MOST_FREQUENT`` of them.

Documents with the same set are one class from the start. Keys and counts cross the network as packed
arrays. A bucket's members are paired with its first member. Of these pairs, each member's one with most
shared keys is verified first, and links found that way are closed to components; the others are verified
only where they lead to another component. So a group of copies costs one comparison a member. What is left are buckets whose members are in different
components; only members of different components meet there, and each two in the first bucket they
share: every member knows its last buckets before this one, and two that share one of these have met
already. They are compared in units of two blocks of a bucket's members, as a matrix, and a unit gives no more links
than connect its members; no rows of pairs are made. Where one component is large, the other's members are paired with the component instead of its
members, and compared with blocks of it in one task; one link connects them. So no link is lost. Every
link is found on the tokens of whole texts. Only candidates move: texts compressed, or the last 24 bits of their tokens.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociweave.operators.graph import connected_components
from lociweave.llm.side_tables import BLOCK, read_side, released, runs, sliced, with_blocks, write_side
from lociweave.runtime import drop_stored, shuffle_partitions, store

#: A token in more documents than this is frequent.
RARE_MOST = 32
#: The class table holds no more tokens than this (8 MiB); the limit above doubles until it fits.
MOST_FREQUENT = 1 << 20
#: Tokens are counted by their first bits. About 3 more than the logarithm of the number of tokens keeps false counts away.
COUNT_BITS = 36
#: Packed arrays are dealt by the first bits of their keys: so many at least and at most, one more than the input's partitions have.
PART_BITS = (8, 16)
#: A hub's candidates are verified in groups of about this many.
UNIT = 256
#: A component of so many classes is compared in blocks.
LARGE = 64
#: So many earlier buckets a member knows.
EARLIER = 4
#: Tokens that a task gathers before it sends them off.
FLUSH = 2_000_000
BYTES_CHUNK = 1_000_000
#: In place of a bucket's name: the row is a pair to verify.
PAIR = -(2**63)


@dataclass(frozen=True)
class Similarity:
    """Links where ``over * intersection >= num * union``, on shingles of ``width`` words."""

    num: int = 80
    over: int = 100
    width: int = 5

    def least_overlap(self, n):
        """No linked set shares less with a set of n."""
        return -(-self.num * n // self.over)

    def prefix(self, n):
        return n - self.least_overlap(n) + 1

    def extended(self, n):
        return 2 * (self.over - self.num) * n // self.over + 2

    def sizes_fit(self, a, b):
        return self.over * np.minimum(a, b) >= self.num * np.maximum(a, b)

    def linked(self, common, a, b):
        return self.over * common >= self.num * (a + b - common)


# --- Shingles --------------------------------------------------------------------------------------

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, each once; ``x`` is not empty. A sort and a mask, which for short arrays is less than :func:`numpy.unique` does."""
    x = np.sort(x)
    new = np.empty(len(x), bool)
    new[0] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


#: A-Z in lower case, white space as spaces.
PLAIN = bytes(32 if i in (32, *range(9, 14)) else i + 32 if 65 <= i <= 90 else i for i in range(256))


class Shingler:
    """Sorted distinct shingle hashes of texts; works on the words of many texts at once, and hashes each distinct word once."""

    def __init__(self, width: int):
        self.width = width
        self.letter = _mix(np.arange(256, dtype=_U))
        self.power = np.cumprod(np.full(4096, 0x5851F42D4C957F2D, _U))
        self.place = _mix(np.arange(width, dtype=_U) + _U(1000)) | _U(1)

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        out, start, size = [], 0, 0
        for i, t in enumerate(texts):
            if i > start and size + len(t) > BYTES_CHUNK:
                out += self._sets(texts[start:i])
                start, size = i, 0
            size += len(t)
        return out + self._sets(texts[start:])

    def _words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and where each text's end among them."""
        parts = pc.split_pattern(pa.array([t.translate(PLAIN) for t in texts], pa.binary()), " ")
        flat, ends = parts.flatten(), np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False))
        some = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
        if not some.all():
            flat, ends = flat.filter(pa.array(some)), np.concatenate(([0], np.cumsum(some)))[ends]
        if not len(flat):
            return np.zeros(0, _U), ends
        named = flat.dictionary_encode()
        _, offsets, data = named.dictionary.buffers()
        offsets = np.frombuffer(offsets, np.int32)[: len(named.dictionary) + 1].astype(np.int64)
        data, length = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], np.diff(offsets)
        begin = offsets[:-1] - offsets[0]
        if length.max() > len(self.power):
            self.power = np.cumprod(np.full(int(length.max()) * 2, 0x5851F42D4C957F2D, _U))
        within = np.arange(len(data)) - np.repeat(begin, length)
        hashes = _mix(np.add.reduceat(self.letter[data] * self.power[within], begin) + length.astype(_U))
        return hashes[named.indices.to_numpy()], ends

    def _sets(self, texts: list[bytes]) -> list[np.ndarray]:
        if not texts:
            return []
        words, ends = self._words(texts)
        w = self.width
        if len(words) >= w:
            rows = len(words) - w + 1
            shingles = _mix(sum(words[k : k + rows] * self.place[k] for k in range(w)))
        out, a = [], 0
        for b in ends.tolist():
            n = b - a
            if n >= w:
                out.append(_distinct(shingles[a : b - w + 1]))
            elif n:
                out.append(_mix(np.array([(words[a:b] * self.place[:n]).sum() + _U(7919 * n)], _U)))
            else:
                out.append(np.zeros(0, _U))
            a = b
        return out


def _texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    a, b = np.frombuffer(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest(), np.int64)
    return int(a), int(b)


# --- First pass: sizes, identities, counts ---------------------------------------------------------

_FIRST = "part int, doc_id long, block string, n long, d1 long, d2 long, cells binary"


def _planes(values: np.ndarray) -> bytes:
    """Sorted numbers below 2^64 as zstd-compressed byte planes of their differences."""
    gaps = np.diff(values, prepend=_U(0))
    return pa.Codec("zstd").compress(gaps.view(np.uint8).reshape(-1, 8).T.tobytes(), asbytes=True) if len(gaps) else b""


def _from_planes(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.Codec("zstd").decompress(data, decompressed_size=8 * n, asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, n).T).view(_U).ravel())


def _part_bits(docs: DataFrame) -> int:
    """The parts grow with the input, so that each stays about as large as a partition of it."""
    return min(max(PART_BITS[0], (docs.rdd.getNumPartitions() - 1).bit_length() + 1), PART_BITS[1])


def _first_pass(docs: DataFrame, sim: Similarity, bits: int) -> DataFrame:
    """A row per document (cells null), and rows of packed token counts for the parts of the count space."""
    parts = 1 << bits

    def run(batches):
        shingler, held, size = Shingler(sim.width), [], 0

        def packed():
            cells = np.sort(np.concatenate(held) >> _U(64 - COUNT_BITS))
            part = (cells >> _U(COUNT_BITS - bits)).astype(np.int64)
            cuts = np.searchsorted(part, np.arange(parts + 1))
            rows = [(p, int(b - a), _planes(cells[a:b])) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            none = [None] * len(rows)
            return _batch_first([r[0] for r in rows], none, none, [r[1] for r in rows], none, none, [r[2] for r in rows])

        for batch in sliced(batches):
            sets = shingler.sets(_texts(batch.column(1)))
            digests = [_digest(s) for s in sets]
            yield _batch_first([d[0] % parts for d in digests], batch.column(0), batch.column(2), [len(s) for s in sets], [d[0] for d in digests], [d[1] for d in digests], [None] * len(sets))
            held += [s for s in sets if len(s)]
            size += sum(len(s) for s in sets)
            if size >= FLUSH:
                yield packed()
                held, size = [], 0
        if size:
            yield packed()

    return docs.mapInArrow(released(run), _FIRST)


def _batch_first(part, doc_id, block, n, d1, d2, cells):
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    columns = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip((part, doc_id, block, n, d1, d2, cells), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _FIRST.split(", ")])


def _counted(first: DataFrame, bits: int) -> DataFrame:
    """Document rows as they are; instead of packed counts the cells in over RARE_MOST documents (doc_id null, n the count, d1 the cell)."""

    def run(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            mask = batch.column(6).is_null()
            yield batch.filter(mask).drop_columns(["cells"])
            other = batch.filter(pc.invert(mask))
            for p, n, cells in zip(*(other.column(i).to_pylist() for i in (0, 3, 6)), strict=True):
                held.setdefault(p, []).append(_from_planes(cells, n))
        for p, many in held.items():
            cells, count = np.unique(np.concatenate(many), return_counts=True)
            often = count > RARE_MOST
            k = int(often.sum())
            none = [None] * k
            yield _batch_first([p] * k, none, none, count[often], cells[often].astype(np.int64), none, none).drop_columns(["cells"])

    out = ", ".join(x for x in _FIRST.split(", ") if not x.startswith("cells"))
    return first.repartition(1 << bits, "part").mapInArrow(released(run), out)


def _frequent_cells(counted: DataFrame) -> np.ndarray:
    """The sorted cells of the frequent class, at most MOST_FREQUENT."""
    cells = counted.filter("block is null").select(F.col("n").alias("count"), F.col("d1").alias("cell"))
    steps = cells.groupBy(F.floor(F.log2("count")).cast("int").alias("step")).count().collect()
    total, least = 0, 0
    for step, count in sorted(steps, reverse=True):
        total += count
        if total > MOST_FREQUENT:
            least = 2 ** (step + 1)
            break
    table = cells.filter(F.col("count") >= least).select("cell").toArrow()
    return np.sort(table.column(0).to_numpy().astype(_U))


# --- Second pass: keys and buckets -----------------------------------------------------------------

_KEYS = "part int, n int, keys binary, owners binary, classes binary"


def signatures(tokens: np.ndarray, frequent: np.ndarray, sim: Similarity) -> np.ndarray:
    """Index keys of one set: single rare tokens of its prefix, or these and pairs of neighbouring frequent ones."""
    n = len(tokens)
    if len(frequent):
        cells = tokens >> _U(64 - COUNT_BITS)
        often = frequent[np.minimum(np.searchsorted(frequent, cells), len(frequent) - 1)] == cells
        rare = tokens[~often]
    else:
        rare = tokens
    if len(rare) >= sim.prefix(n):
        return rare[: sim.prefix(n)]
    many = tokens[often][: sim.extended(n)]
    return np.concatenate((rare, _mix(many[:-1] * _U(0x2545F4914F6CDD1D) + many[1:])))


def _second_pass(docs: DataFrame, frequent, sim: Similarity, bits: int) -> DataFrame:
    def run(batches):
        shingler, table = Shingler(sim.width), np.frombuffer(frequent.value, _U)
        seen: set[int] = set()
        keys, classes, size = [], [], 0

        def packed():
            flat = np.concatenate(keys)
            owner = np.repeat(np.arange(len(keys), dtype=np.uint32), [len(k) for k in keys])
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            which = np.array(classes, np.int64).reshape(-1, 2)
            cuts = np.searchsorted(flat >> _U(64 - bits), np.arange((1 << bits) + 1))
            rows = []
            for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if b > a:
                    own, back = np.unique(owner[a:b], return_inverse=True)
                    rows.append((p, int(b - a), _planes(flat[a:b]), back.astype(np.uint16 if len(own) < 65536 else np.uint32).tobytes(), which[own].tobytes()))
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _KEYS.split(", ")])

        for batch in sliced(batches):
            for s in shingler.sets(_texts(batch.column(1))):
                if not len(s) or (name := _digest(s)[0]) in seen:
                    continue
                seen.add(name)
                keys.append(signatures(s, table, sim))
                classes.append((name, len(s)))
                size += len(keys[-1])
            if size >= FLUSH // 4:
                yield packed()
                keys, classes, size = [], [], 0
                seen.clear()
        if size:
            yield packed()

    return docs.mapInArrow(released(run), _KEYS)


_BUCKETS = "bucket long, a long, b long, shared long"


def _buckets(keys: DataFrame, sim: Similarity, bits: int) -> DataFrame:
    """Rows (PAIR, first member, other member, shared keys) to verify, and rows (bucket, member, size, null) of buckets of three and more."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for p, n, k, owners, classes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                which = np.frombuffer(classes, np.int64).reshape(-1, 2)
                own = np.frombuffer(owners, np.uint16 if len(which) < 65536 else np.uint32)
                held.setdefault(p, []).append((_from_planes(k, n), which[own]))
        for many in held.values():
            key, member = np.concatenate([x[0] for x in many]), np.concatenate([x[1] for x in many])
            many.clear()
            order = np.lexsort((member[:, 0], key))
            key, cls, size = key[order], member[order, 0], member[order, 1]
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])))
            key, cls, size = key[new], cls[new], size[new]
            begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            count = np.diff(np.append(begin, len(key)))
            shared = np.repeat(count > 1, count)
            head = np.repeat(begin, count)
            at = np.flatnonzero(shared & (head != np.arange(len(key))))
            fit = sim.sizes_fit(size[head[at]], size[at])
            pairs, shared = np.unique(np.stack((cls[head[at][fit]], cls[at[fit]]), 1), axis=0, return_counts=True)
            yield from _bucket_rows(np.full(len(pairs), PAIR), pairs[:, 0], pairs[:, 1], shared)
            large = np.flatnonzero(count > 2)
            names = _mix(np.add.reduceat(_mix(cls.astype(_U)), begin) + count.astype(_U)) if len(begin) else np.zeros(0, _U)
            large = large[np.sort(np.unique(names[large], return_index=True)[1])]  # of equal buckets the first
            rows = np.concatenate([np.arange(begin[i], begin[i] + count[i]) for i in large]) if len(large) else np.zeros(0, np.int64)
            yield from _bucket_rows(np.repeat(key[begin[large]].astype(np.int64), count[large]), cls[rows], size[rows], np.zeros(len(rows), np.int64))

    return keys.repartition(1 << bits, "part").mapInArrow(released(run), _BUCKETS)


def _bucket_rows(bucket, a, b, shared, step: int = 50_000):
    for i in range(0, len(a), step):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + step], pa.int64()) for x in (bucket, a, b, shared)], names=["bucket", "a", "b", "shared"])


_OPEN = "kind int, a long, b long, cls long, component long"


def _open_work(members: DataFrame, large: DataFrame, sim: Similarity) -> DataFrame:
    """What is open between one bucket's members (bucket, cls, size, component) of different components: (kind, a, b, cls, component).

    Kind 0: the class takes part in unit b of bucket a, where it has a partner to be compared with; neither's
    component is in ``large`` (component). Kind 1: a is a large component, b a class of another. Kind 2: both are
    large components.

    A bucket's members are dealt to blocks of about UNIT, and a unit is a pair of blocks, so no task holds a whole
    bucket. Common buckets come in the same order for both of a pair. In the first of them, neither knows an earlier one
    that the other knows too, so there the pair is open; in nearly all later ones they see an earlier one in common.
    """
    mixed = members.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("bucket")
    before = Window.partitionBy("cls").orderBy("bucket")
    # Written before the window, so that a component with many members can be split in the join.
    marked = store(members.join(large.withColumn("large", F.lit(1).cast("long")), "component", "left"), "marked")
    earlier = [f"e{i}" for i in range(1, EARLIER + 1)]
    known = marked.join(mixed, "bucket").select("bucket", "component", "cls", "size", F.coalesce("large", F.lit(0)).cast("long").alias("large"), *[F.lag("bucket", i + 1).over(before).alias(e) for i, e in enumerate(earlier)])
    known = store(known, "mixed")
    drop_stored(marked)
    small = known.filter("large = 0")
    parts = small.groupBy("bucket").agg(F.ceil(F.count("*") / UNIT).cast("long").alias("parts"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    own = F.pmod(F.xxhash64("cls"), F.col("parts"))
    ours = small.join(parts, "bucket").select("bucket", "component", "cls", "size", "large", own.alias("own"), each.alias("other"), *earlier)
    ours = ours.select("bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "component", "cls", "size", "large", "own", *earlier)
    none = [F.lit(None).cast("long").alias(e) for e in ("cls", "size")], [F.lit(None).cast("long").alias(e) for e in earlier]
    theirs = known.filter("large = 1").select("bucket", "component").distinct().join(parts, "bucket", "left").select("bucket", "component", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("x"))
    theirs = theirs.select("bucket", "x", F.col("x").alias("y"), "component", *none[0], F.lit(1).cast("long").alias("large"), F.col("x").alias("own"), *none[1])
    unit = ["bucket", "x", "y"]
    dealt = ours.unionAll(theirs).repartition(shuffle_partitions(members.sparkSession), *unit).sortWithinPartitions(*unit, "component", "cls")

    def run(batches):
        now, held = None, []

        def opened():
            table = np.concatenate(held)
            (bucket, x, y), wide = now, table[:, 3] == 1
            groups, rest = np.unique(table[wide, 0]), table[~wide]
            if x == y and len(groups):
                yield _open_rows(1, np.repeat(groups, len(rest)), np.tile(rest[:, 1], len(groups)))
                if x == 0:
                    low, high = np.triu_indices(len(groups), 1)
                    yield _open_rows(2, groups[low], groups[high])
            comp, size, block, known = rest[:, 0], rest[:, 2], rest[:, 4], rest[:, 5:]
            needed = np.zeros(len(rest), bool)
            for i in range(len(rest) - 1):
                at = np.flatnonzero((comp[i + 1 :] != comp[i]) & sim.sizes_fit(size[i + 1 :], size[i]) & ((x == y) | (block[i + 1 :] != block[i]))) + i + 1
                mine = known[i][known[i] != PAIR]
                if len(mine) and len(at):
                    at = at[~np.isin(known[at], mine).any(1)]
                if len(at):
                    needed[i] = needed[at] = True
            if needed.any():
                n = int(needed.sum())
                yield _open_rows(0, np.full(n, bucket), np.full(n, x << 32 | y), rest[needed, 1], comp[needed])

        for batch in batches:
            units = list(zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True))
            table = np.stack([c.fill_null(PAIR).to_numpy(zero_copy_only=False) for c in batch.columns[3:]], 1)
            for a, b, key in runs(units):
                if key != now and held:
                    yield from opened()
                    held = []
                now = key
                held.append(table[a:b])
        if held:
            yield from opened()

    return dealt.mapInArrow(released(run), _OPEN)


def _open_rows(kind: int, a: np.ndarray, b: np.ndarray, cls: np.ndarray | None = None, component: np.ndarray | None = None) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int64())
    columns = [pa.array(np.full(len(a), kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), none if cls is None else pa.array(cls, pa.int64()), none if component is None else pa.array(component, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _OPEN.split(", ")])


# --- Verification ----------------------------------------------------------------------------------


def _short(tokens: np.ndarray) -> bytes:
    """The distinct last 24 bits of tokens, packed: about two bytes each."""
    values = _distinct(tokens & _U(0xFFFFFF))
    return len(values).to_bytes(4, "little") + _planes(values)


def _from_short(data: bytes) -> np.ndarray:
    return _from_planes(data[4:], int.from_bytes(data[:4], "little"))


def _fetched(wanted: DataFrame, reps: DataFrame, docs: DataFrame, sim: Similarity, short: bool = False) -> DataFrame:
    """(d1, n, packed): of the classes in ``wanted`` (d1) the number of tokens, and the compressed text or (``short``) the distinct last 24 bits of the tokens.

    ``docs`` are doc_id, text, block; ``reps`` say where each class has its text.
    """
    path = write_side(reps.join(wanted, "d1", "left_semi").select(F.col("block").alias(BLOCK), "doc_id", "d1").distinct(), "candidates")

    def fetch(batches):
        import zstandard

        shingler, squeeze, loaded, places = Shingler(sim.width), zstandard.ZstdCompressor(3), None, {}
        for batch in sliced(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            out = {}
            for a, b, block in runs(batch.column(2).to_pylist()):
                if block != loaded:
                    side, places, loaded = read_side(path, block), {}, block
                    if side is not None:
                        for i, d in zip(side.column("doc_id").to_pylist(), side.column("d1").to_pylist(), strict=True):
                            places.setdefault(i, set()).add(d)
                here = [i for i in range(a, b) if ids[i] in places]
                found = [texts[i].as_py() or b"" for i in here]
                for i, text, own in zip(here, found, shingler.sets(found), strict=True):
                    d1 = _digest(own)[0]
                    if d1 in places[ids[i]]:
                        out[d1] = (len(own), _short(own) if short else squeeze.compress(text))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array([x[0] for x in out.values()], pa.int64()), pa.array([x[1] for x in out.values()], pa.binary())], names=["d1", "n", "packed"])

    return docs.mapInArrow(released(fetch), "d1 long, n long, packed binary")


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, sim: Similarity) -> DataFrame:
    """(a, b) of the pairs of classes that link."""
    shipped = _fetched(pairs.select(F.col("a").alias("d1")).unionAll(pairs.select("b")).distinct(), reps, docs, sim)
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / UNIT).cast("int").alias("units"))
    dealt = pairs.join(hubs, "a").select("a", F.pmod(F.xxhash64("b"), "units").cast("int").alias("unit"), F.col("b").alias("d1"))
    sides = dealt.unionAll(dealt.select("a", "unit", "a").distinct())
    units = sides.join(shipped, "d1").repartition(shuffle_partitions(pairs.sparkSession), "a", "unit").sortWithinPartitions("a", "unit", F.col("d1") != F.col("a"), "d1").select("a", "unit", "d1", "packed")

    def compare(batches):
        import zstandard

        shingler, expand = Shingler(sim.width), zstandard.ZstdDecompressor()
        now, hub, before = None, None, None
        for batch in sliced(batches):
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            sets = shingler.sets([expand.decompress(r[3]) for r in rows])
            linked = []
            for (a, unit, d1, _), own in zip(rows, sets, strict=True):
                if (a, unit) != now:
                    now, hub = (a, unit), own
                elif d1 != before:
                    common = len(np.intersect1d(hub, own, assume_unique=True))
                    if sim.linked(common, len(hub), len(own)):
                        linked.append((a, d1))
                before = d1
            if linked:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*linked, strict=True)], names=["a", "b"])

    return units.mapInArrow(released(compare), "a long, b long")


def common_tokens(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, as a matrix product over blocks of tokens."""
    found, flat, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1  # a token of one set only adds nothing
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = times[flat] > 1
    owner, token = owner[shared], place[flat[shared]]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for first in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        a, b = np.searchsorted(token, (first, first + width))
        there = np.zeros((len(sets), width), np.float32)
        there[owner[a:b], token[a:b] - first] = 1
        total += there @ there.T
    return total.astype(np.int64)


def _unit_candidates(work: DataFrame, tokens: DataFrame, sim: Similarity, whole: bool) -> DataFrame:
    """(bucket, unit, a, b): of each unit (bucket, unit, cls, component) as many pairs that may link as connect all that may.

    ``tokens`` are (cls, n, packed) with the last 24 bits of each token. Tokens of one set that agree in these count
    for the overlap, so no link is missed. With the ``whole`` texts instead every pair is a link.
    """
    unit = ["bucket", "unit"]
    dealt = work.join(tokens, "cls").select(*unit, "component", "cls", "n", "packed").repartition(shuffle_partitions(work.sparkSession), *unit).sortWithinPartitions(*unit, "cls")

    def run(batches):
        import zstandard

        shingler, expand = Shingler(sim.width), zstandard.ZstdDecompressor()
        now, names, comps, sizes, sets = None, [], [], [], []

        def unpacked(packed):
            return shingler.sets([expand.decompress(p) for p in packed]) if whole else map(_from_short, packed)

        def pairs():
            size, comp = np.array(sizes), np.array(comps)
            merged = size - np.array([len(s) for s in sets])
            hits = sim.linked(common_tokens(sets) + np.maximum(merged[:, None], merged), size[:, None], size) & (comp[:, None] != comp)
            top = {c: c for c in comps}

            def root(c):
                while top[c] != c:
                    top[c] = c = top[top[c]]
                return c

            for i, j in np.argwhere(np.triu(hits, 1)).tolist():
                u, v = root(comps[i]), root(comps[j])
                if u != v:
                    top[u] = v
                    yield (*now, names[i], names[j])

        def sent(found):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=[*unit, "a", "b"])

        for batch in sliced(batches):
            found = []
            columns = [c.to_pylist() for c in batch.columns]
            for *key, comp, cls, n, own in zip(*columns[:-1], unpacked(columns[-1]), strict=True):
                if key != now:
                    if len(sets) > 1:
                        found += pairs()
                    now, names, comps, sizes, sets = key, [], [], [], []
                names.append(cls)
                comps.append(comp)
                sizes.append(n)
                sets.append(own)
            if found:
                yield sent(found)
        if len(sets) > 1 and (found := list(pairs())):
            yield sent(found)

    return dealt.mapInArrow(released(run), "bucket long, unit long, a long, b long")


def _unit_links(work: DataFrame, reps: DataFrame, docs: DataFrame, sim: Similarity) -> DataFrame:
    """(a, b): links that connect what is linked within each unit (bucket, unit, cls, component).

    Units name as few candidates as connect them. Should one not hold on the whole tokens, its unit is compared again
    on the whole texts of its classes, so a unit moves each of them once more and not once for each of its pairs.
    """
    tokens = _fetched(work.select(F.col("cls").alias("d1")).distinct(), reps, docs, sim, short=True).withColumnRenamed("d1", "cls")
    found = store(_unit_candidates(work, tokens, sim, whole=False), "unit-candidates")
    links = store(_verified(found.select("a", "b").distinct(), reps, docs, sim), "links")
    wrong = store(found.join(links, ["a", "b"], "left_anti").select("bucket", "unit").distinct(), "wrong-units")
    if wrong.limit(1).count():
        again = store(work.join(wrong, ["bucket", "unit"], "left_semi"), "again")
        texts = _fetched(again.select(F.col("cls").alias("d1")).distinct(), reps, docs, sim).withColumnRenamed("d1", "cls")
        links = links.unionAll(store(_unit_candidates(again, texts, sim, whole=True).select("a", "b").distinct(), "links"))
    return links


def _block_links(wide: DataFrame, members: DataFrame, reps: DataFrame, docs: DataFrame, sim: Similarity) -> DataFrame:
    """(a, b): for each (component, cls) of ``wide`` a link of the class into each block of the component that has one. ``members`` are all (component, cls) of these components."""
    shipped = _fetched(wide.select(F.col("cls").alias("d1")).unionAll(members.select("cls")).distinct(), reps, docs, sim).withColumnRenamed("d1", "cls")
    parts = lambda df, name: df.groupBy("component").agg(F.ceil(F.count("*") / UNIT).cast("int").alias(name))
    sizes = parts(members, "blocks").join(parts(wide, "groups"), "component")
    part = lambda n: F.pmod(F.xxhash64("cls"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    inner = members.join(sizes, "component").select("component", part(F.col("blocks")).alias("block"), each("groups").alias("group"), F.lit(0).alias("role"), "cls")
    outer = wide.join(sizes, "component").select("component", each("blocks").alias("block"), part(F.col("groups")).alias("group"), F.lit(1).alias("role"), "cls")
    unit = ["component", "block", "group"]
    dealt = inner.unionAll(outer).join(shipped, "cls").select(*unit, "role", "cls", "packed").repartition(shuffle_partitions(wide.sparkSession), *unit).sortWithinPartitions(*unit, "role", "cls")

    def run(batches):
        import zstandard

        shingler, expand = Shingler(sim.width), zstandard.ZstdDecompressor()
        now, names, sets, flat, owner, sizes = None, [], [], None, None, None
        for batch in sliced(batches):
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            found = []
            for (*key, role, cls, _), own in zip(rows, shingler.sets([expand.decompress(r[-1]) for r in rows]), strict=True):
                if key != now:
                    now, names, sets, flat = key, [], [], None
                if role == 0:
                    names.append(cls)
                    sets.append(own)
                elif names:
                    if flat is None:
                        flat, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
                        owner = np.repeat(np.arange(len(sets)), sizes)
                    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                    common = np.bincount(owner[own[at] == flat], minlength=len(names))
                    hits = np.flatnonzero(sim.linked(common, len(own), sizes))
                    if len(hits):
                        found.append((names[hits[0]], cls))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return dealt.mapInArrow(released(run), "a long, b long").distinct()


# --- The operator ----------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, sim: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id reachable by links).

    Null or wordless texts have an empty set, no links and their own id as component. Texts of fewer words
    than a shingle are one shingle. Rows that repeat are equal, so they share a component; a null id is never
    the smallest unless all are. Columns beside the two are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    held = with_blocks(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(BLOCK))
    bits = _part_bits(held)
    counted = store(_counted(_first_pass(held, sim, bits), bits), "shingle-counts")
    rows = counted.filter("block is not null").select("doc_id", "block", "n", "d1", "d2")
    frequent = spark.sparkContext.broadcast(_frequent_cells(counted).tobytes())

    place = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "block"))
    reps = rows.filter("n > 0").groupBy("d1", "d2").agg(place.alias("p"), F.max("n").alias("n")).select("d1", "d2", "n", "p.doc_id", "p.block")
    reps = store(reps, "shingle-classes")

    buckets = store(_buckets(_second_pass(held, frequent, sim, bits), sim, bits), "shingle-buckets")
    pairs = store(buckets.filter(F.col("bucket") == PAIR).groupBy("a", "b").agg(F.sum("shared").alias("shared")), "pairs")
    likely = store(pairs.groupBy("b").agg(F.max(F.struct("shared", F.bitwise_not(F.col("a")).alias("other"))).alias("x")).select(F.bitwise_not(F.col("x.other")).alias("a"), "b"), "likely")
    first = store(_verified(likely, reps, held, sim), "links")
    near = connected_components(first, "a", "b")
    side = lambda end: near.select(F.col("node").alias(end), F.col("component").alias(f"{end}_component"))
    apart = pairs.join(likely, ["a", "b"], "left_anti").join(side("a"), "a", "left").join(side("b"), "b", "left")
    apart = apart.filter(F.coalesce("a_component", "a") != F.coalesce("b_component", "b")).select("a", "b")
    links = first.unionAll(store(_verified(store(apart, "apart"), reps, held, sim), "links"))
    large = buckets.filter(F.col("bucket") != PAIR).select("bucket", F.col("a").alias("cls"), F.col("b").alias("size")).distinct()
    parts = connected_components(links, "a", "b")
    known = large.join(parts, F.col("cls") == F.col("node"), "left").select("bucket", "cls", "size", F.coalesce("component", "cls").alias("component"))
    classes = known.select("component", "cls").distinct()
    heavy = store(classes.groupBy("component").count().filter(F.col("count") >= LARGE).select("component"), "heavy")
    still = store(_open_work(known, heavy, sim), "open")
    second = _unit_links(still.filter("kind = 0").select(F.col("a").alias("bucket"), F.col("b").alias("unit"), "cls", "component"), reps, held, sim)
    # Of two large components, all classes of one are compared with the other.
    between = still.filter("kind = 2").select(F.col("a").alias("big"), F.col("b").alias("component")).join(classes, "component").select(F.col("big").alias("component"), "cls")
    wide = store(still.filter("kind = 1").select(F.col("a").alias("component"), F.col("b").alias("cls")).unionAll(between).distinct(), "wide")
    inner = parts.select("component", F.col("node").alias("cls")).join(wide.select("component").distinct(), "component", "left_semi")
    links = links.unionAll(second).unionAll(store(_block_links(wide, inner, reps, held, sim), "links"))
    for done in (buckets, pairs, likely, still):
        drop_stored(done)

    # From classes to documents.
    name = reps.select("d1", "doc_id")
    ends = links.join(name.select(F.col("d1").alias("a"), F.col("doc_id").alias("u")), "a").join(name.select(F.col("d1").alias("b"), F.col("doc_id").alias("v")), "b")
    found = connected_components(ends.select("u", "v")).select("node", "component")
    classes = reps.join(found, F.col("doc_id") == F.col("node"), "left").select("d1", "d2", F.coalesce("component", "doc_id").alias("component_id"))
    out = rows.filter("n > 0").join(classes, ["d1", "d2"]).select("doc_id", "n", "component_id")
    alone = rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return out.unionAll(alone).select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, sim: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the smallest id of each component; ids are expected to be distinct and not null.

    Rows with a null id, and all rows without words, stay.
    """
    found = near_duplicates(docs, sim, id_col, text_col).filter(F.col(id_col).isNotNull() & (F.col(id_col) != F.col("component_id")))
    return docs.join(found.select(F.col(id_col)).distinct(), id_col, "left_anti").select(docs.columns)


def op4_jaccard_join(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
