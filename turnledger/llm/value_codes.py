"""Vectors as codes of their parts, by dictionaries of the integers in each dimension.

Components become integers. A chunk of vectors keeps, for each dimension, the distinct
integers and every vector's place among them. To compare the chunk with a codebook, the
squared differences of every distinct integer to all entries are tabulated once; the
distances of the parts are then gathered from those tables and added up.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.llm.shared import stored

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Components of a chunk: bounds its dictionaries and their tables of distances.
CHUNK_VALUES = 2**19
#: Vectors whose distances to all entries are held at once.
STEP = 2048
#: A label of more than this share of the vectors is frequent; there are fewer of those
#: than its inverse.
FREQUENT = 1 / 1000


def limit_for(width: int) -> int:
    """Largest size of an integer for which squared distances fit 64 bits."""
    return int((2**62 / width) ** 0.5 / 2)


def integers(values: np.ndarray, width: int, scale: int = SCALE) -> np.ndarray:
    """Components scaled and rounded down; what is beyond the limit is cut to it."""
    limit = limit_for(width)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values.astype(np.float64) * scale), -limit, limit).astype(np.int64)


def nearest(values: list[np.ndarray], places: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of one part's codebook (ties to the lower) and its squared distance.

    values: distinct integers of each dimension; places: vector x dimension, into those;
    entries: entry x dimension.
    """
    n, width = places.shape
    code, away = np.zeros(n, np.int64), np.zeros(n, np.int64)
    furthest = max(int(np.abs(v).max()) for v in values) + int(np.abs(entries).max())
    kind = np.int32 if width * furthest**2 < 2**31 else np.int64
    tables = [((v[:, None] - entries[None, :, d]) ** 2).astype(kind) for d, v in enumerate(values)]
    for start in range(0, n, STEP):
        part = places[start : start + STEP]
        total = tables[0][part[:, 0]]
        for d in range(1, width):
            total += tables[d][part[:, d]]
        best = total.argmin(axis=1)
        code[start : start + STEP] = best
        away[start : start + STEP] = total[np.arange(len(best)), best]
    return code, away


def usable(vector: Column) -> Column:
    """Neither null nor with null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine


def _points(vectors: pa.ListArray, width: int, scale: int) -> np.ndarray:
    """Integers of some vectors, shorter ones filled up with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = integers(vectors.flatten().to_numpy(zero_copy_only=False), width, scale)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _chunks(vectors: DataFrame, width: int, scale: int) -> DataFrame:
    """(ids, labels, places, sizes, distinct): a row for each chunk of vectors.

    vectors: (id, label, x). `distinct` holds the dictionaries of all dimensions, one
    after the other, `sizes` their sizes; `places` has two bytes a component, or four
    where a dictionary needs them.
    """
    rows = max(1, CHUNK_VALUES // width)
    names = ["ids", "labels", "places", "sizes", "distinct"]

    def chunk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        points = np.concatenate([_points(b.column(2), width, scale) for b in held])
        places, values = np.zeros(points.shape, np.uint32), []
        for d in range(width):
            distinct, places[:, d] = np.unique(points[:, d], return_inverse=True)
            values.append(distinct)
        if max(map(len, values)) <= 2**16:
            places = places.astype(np.uint16)
        whole = [pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1)]
        sizes = np.array([len(v) for v in values], np.int64)
        return pa.RecordBatch.from_arrays(
            [
                *(pa.ListArray.from_arrays(pa.array([0, len(points)], pa.int32()), x) for x in whole),
                pa.array([places.tobytes()], pa.binary()),
                pa.array([sizes.tobytes()], pa.binary()),
                pa.array([b"".join(v.tobytes() for v in values)], pa.binary()),
            ],
            names,
        )

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        room = rows
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, room))
                at += held[-1].num_rows
                room -= held[-1].num_rows
                if not room:
                    yield chunk(held)
                    held, room = [], rows
        if held:
            yield chunk(held)

    label = vectors.schema["label"].dataType.simpleString()
    return vectors.mapInArrow(
        code, f"ids array<long>, labels array<{label}>, places binary, sizes binary, distinct binary"
    )


def _read(batch: pa.RecordBatch, row: int, first: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Dictionaries and places of a chunk; its columns begin at `first`."""
    raw, sizes, distinct = (batch.column(first + i)[row].as_py() for i in range(3))
    sizes = np.frombuffer(sizes, np.int64)
    values = np.split(np.frombuffer(distinct, np.int64), np.cumsum(sizes)[:-1])
    kind = np.uint16 if sizes.max() <= 2**16 else np.uint32
    return values, np.frombuffer(raw, kind).reshape(-1, len(sizes))


def _sums(chunks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(cell, place, total): sums of the vectors nearest to each entry, and at place -1
    their number. A task adds up its chunks first."""
    entries, width = books[0].shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(books) * entries, width + 1), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                values, places = _read(batch, row, 0)
                for p, book in enumerate(books):
                    dims = range(p * width, (p + 1) * width)
                    code, _ = nearest([values[d] for d in dims], places[:, dims.start : dims.stop], book)
                    order = code.argsort(kind="stable")
                    used, begin = np.unique(code[order], return_index=True)
                    own = totals[p * entries :]
                    own[used, 0] += np.diff([*begin, len(code)])
                    for k, d in enumerate(dims):
                        own[used, k + 1] += np.add.reduceat(values[d][places[order, d]], begin)
        cell = np.flatnonzero(totals[:, 0])
        place = np.tile(np.arange(-1, width, dtype=np.int32), len(cell))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(cell, width + 1)), pa.array(place), pa.array(totals[cell].ravel())],
            ["cell", "place", "total"],
        )

    return (
        chunks.select("places", "sizes", "distinct")
        .mapInArrow(add, "cell long, place int, total long")
        .groupBy("cell", "place")
        .agg(F.sum("total").alias("total"))
    )


def _assigned(chunks: DataFrame, books: list[np.ndarray], label: str) -> DataFrame:
    """(id, label, code, error) of every vector."""
    width = books[0].shape[1]
    digits = max(2, len(f"{len(books[0]) - 1:x}"))
    written = np.array([f"{i:0{digits}x}" for i in range(len(books[0]))], object)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                values, places = _read(batch, row, 2)
                text, error = "", np.zeros(len(places), np.int64)
                for p, book in enumerate(books):
                    dims = slice(p * width, (p + 1) * width)
                    code, away = nearest(values[dims], places[:, dims], book)
                    text, error = text + written[code], error + away
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[row].values, batch.column(1)[row].values, pa.array(text, pa.string()), pa.array(error)],
                    ["id", "label", "code", "error"],
                )

    return chunks.mapInArrow(assign, f"id long, label {label}, code string, error long")


def with_label_errors(rows: DataFrame) -> DataFrame:
    """Adds the sum of `error` over equal labels, nulls being equal to each other.

    Sums are made per task first. A label of a great share of all rows does not gather
    in one task to get its sum back: there are fewer than 1 / FREQUENT of those, and
    they are sent to all tasks. All other labels are joined by shuffle.
    """
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    sums = stored(sums, "label-errors")
    least = int((sums.agg(F.sum("n")).first()[0] or 0) * FREQUENT)
    frequent = F.broadcast(sums.where(F.col("n") > least).drop("n"))
    rare = sums.where(F.col("n") <= least).drop("n")
    same = F.col("label").eqNullSafe(F.col("of"))
    often = rows.join(frequent, same)
    rest = rows.join(frequent, same, "left_anti").join(rare, same)
    return often.union(rest).drop("of")


def compressed(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(id, label, code, error, label_error, codebooks_sha256) of every usable vector.

    A component x is the integer floor(scale * x). Vectors are cut into `parts` equal
    parts, each with a codebook: at first that part of the vectors with the smallest ids
    (equal ids by value, null ids last), then `rounds` times each entry is replaced by
    the floored mean of the parts nearest to it; an unused entry stays. `code` has the
    entries' numbers in hexadecimal, two digits each (more if there are over 256),
    `error` the squared distance, `label_error` its sum over equal labels.

    Vectors that are null or hold null or non-finite components are left out. Vectors
    shorter than the longest one, and all if its length is no multiple of `parts`, are
    filled up with zeros, empty ones to `parts` components at least. Integers beyond `limit_for` the
    width, 2**27 for 64 components, are cut to it, so that distances fit 64 bits.
    Fewer vectors than `entries` make smaller codebooks. Repeated rows count as often
    as they come; a null id stays null; an empty table gives no rows; other columns are
    not read.

    Only codebooks and their sums, `entries` x components, pass the driver. Each round
    reads the chunks once and shuffles at most that many sums a task.
    """
    kept = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("x")
    ).where(usable(F.col("x")))
    longest = kept.agg(F.max(F.size("x"))).first()[0]
    width = -(-max(longest or 0, 1) // parts)
    first = kept.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").toArrow()
    points = np.concatenate([np.zeros((0, width * parts), np.int64)] + [_points(x, width * parts, scale) for x in first.column(0).chunks])
    label = kept.schema["label"].dataType.simpleString()
    if not len(points):
        schema = f"id long, label {label}, code string, error long, label_error long, codebooks_sha256 string"
        return vectors.sparkSession.createDataFrame([], schema).withColumnsRenamed({"id": id_col, "label": label_col})
    books = [points[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    chunks = stored(_chunks(kept, width * parts, scale), "chunks")
    for _ in range(rounds):
        found = _sums(chunks, books).toArrow()
        totals = np.zeros((parts * len(points), width + 1), np.int64)
        totals[found.column("cell").to_numpy(), found.column("place").to_numpy() + 1] = found.column("total").to_numpy()
        for p, book in enumerate(books):
            own = totals[p * len(points) : (p + 1) * len(points)]
            used = own[:, 0] > 0
            book[used] = own[used, 1:] // own[used, :1]
    written = ",".join(str(x) for book in books for x in book.ravel().tolist())
    rows = stored(_assigned(chunks, books, label), "codes")
    return (
        with_label_errors(rows)
        .withColumn("codebooks_sha256", F.lit(hashlib.sha256(written.encode()).hexdigest()))
        .withColumnsRenamed({"id": id_col, "label": label_col})
    )
