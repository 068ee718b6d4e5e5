"""Repeated byte strings, by merging the Burrows-Wheeler transforms of shards.

Only strings that share an anchor can be equal, so texts are first cut into segments
of consecutive windows with one anchor: the 32-byte run of smallest hash, the leftmost
of equals, which depends on a window's content alone. Segments whose anchor occurs
nowhere else hold nothing repeated. The others meet by anchor. There they are taken in
shards, each shard's rotations are put in order by their first LENGTH bytes, and the
shards' transforms are merged: starting from shard after shard, the interleaving is
refined by the bytes that stand before each rotation, a stride at a time, and with it
the places where neighbours begin to differ. After LENGTH bytes, neighbours that
never differed are one repeated interval.
"""

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.llm.shared import stored

LENGTH = 200
GRAM = 32
#: Anchor positions of a window.
SPAN = LENGTH - GRAM + 1
#: Bytes hashed in one go; a longer text is cut into pieces that overlap.
PIECE = 1 << 18
#: Bytes in one order; codes of so many rotations fit in 16 bits.
CHUNK = 60_000
SHARDS = 4
STRIDE = 25
#: Different segments of an anchor that meet at once. Others are cut finer, by the
#: distance of window and anchor, until at last each window is a key of its own.
MOST = 120
STEPS = (24, 1)

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LOW = np.uint64((1 << 20) - 1)


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def segments(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, windows, place and hash of the anchor of every segment."""
    found: list[list[np.ndarray]] = [[], [], [], []]
    for start in range(0, max(0, len(text) - LENGTH + 1), PIECE):
        raw = np.frombuffer(text, np.uint8, min(PIECE + LENGTH - 1, len(text) - start), start)
        h, size, power = raw.astype(np.uint64) + np.uint64(1), 1, _BASE
        while size < GRAM:
            h = h[:-size] * np.uint64(power) + h[size:]
            size, power = 2 * size, power * power % 2**64
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
        places = _window_min((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), SPAN) & _LOW
        first = np.concatenate([[0], np.flatnonzero(places[1:] != places[:-1]) + 1])
        anchor = places[first].astype(np.int64)
        found[0].append(first + start)
        found[1].append(np.diff(np.append(first, len(places))))
        found[2].append(anchor + start)
        found[3].append(h[anchor].view(np.int64))
    if not found[0]:
        return (np.empty(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in found)  # type: ignore[return-value]


class Rotations:
    """Rotations of some strings, each with an end that no byte equals."""

    def __init__(self, strings: list[bytes]):
        sizes = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
        self.base = np.cumsum(sizes) - sizes
        n = int(sizes.sum())
        symbols = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int32) + 1
        self.string = np.repeat(np.arange(len(strings)), sizes)
        self.place = np.arange(n) - self.base[self.string]
        self.size = sizes[self.string]
        symbols[self.base + sizes - 1] = 0
        #: Rotations that begin with LENGTH bytes of their string.
        self.window = self.place + LENGTH < self.size
        # Codes of the next STRIDE symbols, in their order: of two, of four, ...
        codes, length = symbols, 1
        while length < STRIDE:
            step = min(length, STRIDE - length)
            pairs = codes.astype(np.int64) << 32 | codes[self.at(step)]
            codes = np.unique(pairs, return_inverse=True)[1].astype(np.int32)
            length += step
        self.codes = codes.astype(np.uint16) if n <= 65_536 else codes
        self.before = self.codes[self.at(-STRIDE)]

    def at(self, step: int) -> np.ndarray:
        """The rotation that begins `step` symbols further on in the same string."""
        return self.base[self.string] + (self.place + step) % self.size

    def order(self, rotations: np.ndarray) -> np.ndarray:
        """Some rotations in the order of their first LENGTH symbols."""
        for step in range(LENGTH - STRIDE, -1, -STRIDE):
            keys = self.codes[(self.base[self.string] + (self.place + step) % self.size)[rotations]]
            rotations = rotations[np.argsort(keys, kind="stable")]
        return rotations


def merged(strings: list[bytes], shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray, Rotations]:
    """All rotations in the order of their first LENGTH symbols, the number of each
    one's interval of equal ones, and the rotations themselves.

    Every shard of strings is ordered on its own, and what stands before each of its
    rotations, its transform, is all that the merging reads.
    """
    own = Rotations(strings)
    shard_of = (np.arange(len(strings)) * min(shards, len(strings)) // len(strings))[own.string]
    orders = [own.order(np.flatnonzero(shard_of == k)) for k in range(int(shard_of.max()) + 1)]
    transform = np.concatenate([own.before[o] for o in orders])
    # The interleaving: which shard the rotation at each place comes from.
    weave = np.repeat(np.arange(len(orders), dtype=np.uint8), [len(o) for o in orders])
    interval = np.zeros(len(weave), np.int32)
    for _ in range(0, LENGTH, STRIDE):
        # Each shard's rotations stand in its own order, so its transform is read on.
        before = np.empty_like(transform)
        before[np.argsort(weave, kind="stable")] = transform
        turn = np.argsort(before, kind="stable")
        weave, before, interval = weave[turn], before[turn], interval[turn]
        differs = (before[1:] != before[:-1]) | (interval[1:] != interval[:-1])
        interval = np.concatenate([[0], np.cumsum(differs, dtype=np.int32)])
    rotations = np.empty(len(weave), np.int64)
    rotations[np.argsort(weave, kind="stable")] = np.concatenate(orders)
    return rotations, interval, own


def repeated(strings: list[bytes], counts: list[int]) -> list[np.ndarray]:
    """Ranges (start, end) of windows of each string that occur more than once.

    counts: how often each of the different strings occurs.
    """
    rotations, interval, own = merged(strings)
    full = own.window[rotations]
    weight = np.bincount(interval[full], np.array(counts)[own.string[rotations[full]]], int(interval.max()) + 1)
    hit = np.zeros(len(rotations), bool)
    hit[rotations[full & (weight[interval] > 1)]] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).reshape(-1, 2)
    owner = own.string[edges[:, 0]] if len(edges) else np.empty(0, np.int64)
    # A string's last rotation is never a window, so no range crosses strings.
    ranges = edges - own.base[owner][:, None] if len(edges) else edges
    return np.split(ranges, np.searchsorted(owner, np.arange(1, len(strings))))


def _mark(raw: bytes) -> tuple[int, int]:
    mark = xxhash.xxh3_128_intdigest(raw)
    return (mark & (2**64 - 1)) - 2**63, (mark >> 64) - 2**63


def _anchored(docs: DataFrame) -> DataFrame:
    """(id, copy, key, start, n, off): segments of every text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = [segments(t.as_buffer().to_pybytes()) if t.is_valid else segments(b"") for t in batch.column(2)]
                row = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
                start, n, anchor, key = (np.concatenate([f[i] for f in found]) for i in range(4))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(row),
                        batch.column(1).take(row),
                        pa.array(key),
                        pa.array(start.astype(np.int32)),
                        pa.array(n.astype(np.int16)),
                        pa.array((anchor - start).astype(np.int16)),
                    ],
                    ["id", "copy", "key", "start", "n", "off"],
                )

    return docs.select("id", "copy", F.col("text").cast("binary")).mapInArrow(
        cut, "id long, copy int, key long, start int, n short, off short"
    )


def _compressed(docs: DataFrame) -> DataFrame:
    """The texts packed, as they travel twice."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            raw = [press.compress(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(raw, pa.binary())], ["id", "copy", "z"])

    return docs.select("id", "copy", F.col("text").cast("binary")).mapInArrow(pack, "id long, copy int, z binary")


def _cut_out(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """Occurrences (id, copy, start, a, b) and, in the same table, the different
    segments of a batch (key, off, a, b, raw, n)."""
    lists = wanted.groupBy("id", "copy").agg(
        F.collect_list(F.struct("start", "n", "off", "key")).alias("parts")
    )
    met = texts.join(
        lists.withColumnsRenamed({"id": "of", "copy": "of_copy"}),
        F.col("id").eqNullSafe(F.col("of")) & (F.col("copy") == F.col("of_copy")),
    ).select("id", "copy", "z", "parts")
    names = ["id", "copy", "start", "a", "b", "key", "off", "raw", "n"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.binary(), pa.int64()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for whole in batches:
            for at in range(0, whole.num_rows, 300):
                batch = whole.slice(at, 300)
                counts: dict[tuple, int] = defaultdict(int)
                raws: dict[tuple, bytes] = {}
                owner, starts, marks = [], [], []
                for i in range(batch.num_rows):
                    text = unpress.decompress(batch.column(2)[i].as_py())
                    parts = batch.column(3)[i].values
                    columns = (parts.field(c).to_pylist() for c in ("start", "n", "off", "key"))
                    for start, n, off, key in zip(*columns, strict=True):
                        raw = text[start : start + n + LENGTH - 1]
                        mark = _mark(raw)
                        counts[(key, off, *mark)] += 1
                        raws[(key, off, *mark)] = raw
                        owner.append(i)
                        starts.append(start)
                        marks.append(mark)
                rows = pa.array(owner, pa.int64())
                a, b = zip(*marks, strict=True) if marks else ((), ())
                first = [batch.column(0).take(rows), batch.column(1).take(rows), starts, a, b, None, None, None, None]
                key, off, a, b = zip(*counts, strict=True) if counts else ((),) * 4
                second = [None, None, None, a, b, key, off, [raws[k] for k in counts], list(counts.values())]
                for part, size in ((first, len(owner)), (second, len(counts))):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.nulls(size, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t)
                            for c, t in zip(part, kinds, strict=True)
                        ],
                        names,
                    )

    return met.mapInArrow(
        cut, "id long, copy int, start int, a long, b long, key long, off short, raw binary, n long"
    )


def _finer(crowded: DataFrame, step: int) -> DataFrame:
    """Segments cut so that the windows of a part are up to `step` distances from
    their anchor. What all these windows contain is the part's key.

    Returns the links (up_a, up_b, shift, a, b) and the parts in one table.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 300):
                batch = whole.slice(at, 300)
                links, parts, raws = [], defaultdict(int), {}
                columns = (batch.column(c).to_pylist() for c in ("off", "a", "b", "raw", "n"))
                for off, a, b, raw, n in zip(*columns, strict=True):
                    first = 0
                    windows = len(raw) - LENGTH + 1
                    while first < windows:
                        # Window w is off - w away from its anchor.
                        lowest = (off - first) // step * step
                        end = min(windows, off - lowest + 1)
                        own = raw[first : end + LENGTH - 1]
                        core = raw[off - lowest : off - lowest - step + 1 + LENGTH]
                        key = _mark(b"%d %d " % (step, lowest) + core)[0]
                        mark = _mark(own)
                        links.append((a, b, first, *mark))
                        parts[(key, off - first, *mark)] += n
                        raws[(key, off - first, *mark)] = own
                        first = end
                size = len(links)
                cols = list(zip(*links, strict=True)) if links else [()] * 5
                key, off, a, b = zip(*parts, strict=True) if parts else ((),) * 4
                longs, shorts = pa.int64(), pa.int16()
                names = ["up_a", "up_b", "shift", "a", "b", "key", "off", "raw", "n"]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(cols[i], t) for i, t in enumerate((longs, longs, shorts, longs, longs))),
                        pa.nulls(size, longs), pa.nulls(size, shorts), pa.nulls(size, pa.binary()), pa.nulls(size, longs),
                    ],
                    names,
                )
                size = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.nulls(size, longs), pa.nulls(size, longs), pa.nulls(size, shorts),
                        pa.array(a, longs), pa.array(b, longs), pa.array(key, longs), pa.array(off, shorts),
                        pa.array([raws[k] for k in parts], pa.binary()), pa.array(list(parts.values()), longs),
                    ],
                    names,
                )

    return crowded.select("key", "off", "a", "b", "raw", "n").mapInArrow(
        cut,
        "up_a long, up_b long, shift short, a long, b long, key long, off short, raw binary, n long",
    )


def _repeats(grouped: DataFrame) -> DataFrame:
    """(a, b, first, last): ranges of windows of segments that occur again.

    grouped: different segments, each anchor's in one task and side by side. They are
    taken in chunks of whole anchors.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("key", "a", "b", "raw", "n"))
            size = sum(len(r[3]) for r in held)
            for row in zip(*columns, strict=True):
                if held and size > CHUNK and row[0] != held[-1][0]:
                    yield _found(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield _found(held)

    return grouped.select("key", "a", "b", "raw", "n").mapInArrow(find, "a long, b long, first int, last int")


def _found(rows: list[tuple]) -> pa.RecordBatch:
    """Segments that meet no other are repeated as a whole or not at all; the rest
    go through the merging."""
    owner: list[int] = []
    ranges: list[np.ndarray] = []
    keys = np.array([r[0] for r in rows])
    alone = np.ones(len(rows), bool)
    same = keys[1:] == keys[:-1]
    alone[1:] &= ~same
    alone[:-1] &= ~same
    for i in np.flatnonzero(alone):
        if rows[i][4] > 1:
            owner.append(i)
            ranges.append(np.array([[0, len(rows[i][3]) - LENGTH + 1]]))
    others = np.flatnonzero(~alone)
    if len(others):
        found = repeated([rows[i][3] for i in others], [rows[i][4] for i in others])
        owner += others.tolist()
        ranges += found
    at = np.repeat(np.array(owner, np.int64), [len(r) for r in ranges])
    flat = np.concatenate([np.empty((0, 2), np.int64), *ranges])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.array([r[1] for r in rows])[at]),
            pa.array(np.array([r[2] for r in rows])[at]),
            pa.array(flat[:, 0].astype(np.int32)),
            pa.array(flat[:, 1].astype(np.int32)),
        ],
        ["a", "b", "first", "last"],
    )


_RANGES = "array<struct<first:int,last:int>>"


def _joined_up(ranges: Column) -> Column:
    """Ranges that overlap or touch, as one."""

    def add(done: Column, own: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["first"].alias("first"), F.greatest(last["last"], own["last"]).alias("last"))
        rest = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(own["first"] <= last["last"], F.concat(rest, F.array(longer))).otherwise(
            F.concat(done, F.array(own))
        )

    return F.aggregate(F.array_sort(ranges), F.array().cast(_RANGES), add)


def _all_repeats(parts: DataFrame, steps: tuple[int, ...]) -> DataFrame:
    """(a, b, ranges): repeats of all segments, one row each; anchors with many different
    ones are cut finer."""
    different = stored(
        parts.groupBy("key", "a", "b").agg(
            F.sum("n").alias("n"), F.first("raw").alias("raw"), F.first("off").alias("off")
        ),
        "segments",
    )
    if not steps:
        return _per_segment(_repeats(different.repartition("key").sortWithinPartitions("key")))
    sizes = different.groupBy("key").agg(F.count("*").alias("size"))
    crowded = sizes.where(F.col("size") > MOST).select("key")
    few = different.join(sizes.where(F.col("size") <= MOST).select("key"), "key")
    # The join may leave an anchor in many tasks: it need not shuffle if sizes are broadcast.
    found = _repeats(few.repartition("key").sortWithinPartitions("key"))
    finer = stored(_finer(different.join(crowded, "key", "left_semi"), steps[0]), "finer")
    below = stored(
        _all_repeats(finer.where("raw IS NOT NULL").select("key", "off", "a", "b", "raw", "n"), steps[1:]), "repeats"
    )
    links = finer.where("raw IS NULL").select("up_a", "up_b", "shift", "a", "b")
    moved = F.transform(
        "ranges",
        lambda r: F.struct((r["first"] + F.col("shift")).alias("first"), (r["last"] + F.col("shift")).alias("last")),
    )
    up = links.join(below, ["a", "b"]).groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b"))
    up = up.agg(_joined_up(F.flatten(F.collect_list(moved))).alias("ranges"))
    return _per_segment(found).union(up)


def _per_segment(found: DataFrame) -> DataFrame:
    """A row per segment, so that what is joined with segments does not multiply."""
    ranges = F.collect_set(F.struct("first", "last"))
    return found.groupBy("a", "b").agg(_joined_up(ranges).alias("ranges"))


def _removed(texts: DataFrame, covered: DataFrame) -> DataFrame:
    """Counts and the hash of what is left of every text."""
    met = texts.join(
        covered.withColumnsRenamed({"id": "of", "copy": "of_copy"}),
        F.col("id").eqNullSafe(F.col("of")) & (F.col("copy") == F.col("of_copy")),
        "left",
    ).select("id", "z", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[tuple] = []
            for z, spans in zip(batch.column(1), batch.column(2), strict=True):
                text = unpress.decompress(z.as_py())
                runs = _union(spans.values) if spans.is_valid else []
                at, left = 0, hashlib.sha256()
                for a, b in runs:
                    left.update(text[at:a])
                    at = b
                left.update(text[at:])
                out.append((len(text), sum(b - a for a, b in runs), len(runs), left.hexdigest()))
            n, gone, count, left = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(left, pa.string())],
                ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return met.mapInArrow(
        remove, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def _union(spans: pa.StructArray) -> list[tuple[int, int]]:
    """Spans that overlap or touch, as one."""
    first, last = spans.field("first").to_numpy(), spans.field("last").to_numpy()
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.flatnonzero(np.concatenate([[True], first[1:] > last[:-1]]))
    ends = np.append(new[1:], len(first)) - 1
    return list(zip(first[new].tolist(), last[ends].tolist(), strict=True))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What is left of every text without the bytes of repeated 200-byte strings.

    Every byte goes that is covered by a string of LENGTH bytes that also starts
    anywhere else, in this text or another; all occurrences go, as judged on the
    texts as given. Returns id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text is an empty one; texts of fewer than LENGTH bytes stay whole;
    repeated rows are copies of one another; a null id is as good as any; an empty
    table gives no rows; other columns are not read.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.hash(text_col).alias("copy"), F.col(text_col).alias("text")
    )
    anchored = stored(_anchored(rows), "anchors")
    often = anchored.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key")
    wanted = anchored.join(often, "key", "left_semi")
    texts = _compressed(rows)
    cut = stored(_cut_out(wanted, texts), "cut")
    found = _all_repeats(cut.where("raw IS NOT NULL").select("key", "off", "a", "b", "raw", "n"), STEPS)
    places = cut.where("raw IS NULL").select("id", "copy", "start", "a", "b").distinct()

    def span(r: Column) -> Column:
        start = F.col("start")
        return F.struct((start + r["first"]).alias("first"), (start + r["last"] + (LENGTH - 1)).alias("last"))

    covered = (
        places.join(stored(found, "found"), ["a", "b"])
        .select("id", "copy", F.transform("ranges", span).alias("spans"))
        .groupBy("id", "copy")
        .agg(F.flatten(F.collect_list("spans")).alias("spans"))
    )
    return _removed(texts, covered).withColumnRenamed("id", id_col)
