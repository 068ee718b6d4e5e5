"""Near-duplicate vectors through an inverted multi-index.

Each half of the unit vectors has its own codebook; pairs of codes form a grid of
cells, and every vector is listed in one cell. A search walks the grid from the
nearest cell outwards, in the order of the two distances' sum, until it has gone as
far as the recall aimed at needs, and checks whatever is listed there.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.llm.minhash import _small_batches
from turnledger.llm.shared import components, stored

COSINE = 0.9
#: Vectors that the codebooks and the reach of a search are fitted on, by hash of id.
SAMPLE = 20_000
ROUNDS = 12
#: Codes of a half: the square root of the vectors over this, at least so many.
CELL_ROOT, FEWEST = 7, 2
#: Recall aimed at for the hardest case, a vector at the similarity itself.
TARGET = 0.98
#: Vectors of a cell, and searches that reach it, compared in one step.
BLOCK = 256


def squared(points: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distances from points to codes."""
    return (points**2).sum(axis=1)[:, None] - 2 * points @ codes.T + (codes**2).sum(axis=1)


def _codebook(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    codes = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(ROUNDS):
        own = squared(points, codes).argmin(axis=1)
        for c in np.unique(own):
            codes[c] = points[own == c].mean(axis=0)
    return codes


class Index:
    """Codebooks of both halves and how far a search goes."""

    def __init__(self, sample: np.ndarray, n: int, cosine: float, target: float, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.half = sample.shape[1] // 2
        k = min(len(sample), max(FEWEST, round(math.sqrt(n) / CELL_ROOT)))
        self.codes = [_codebook(x, k, rng) for x in self.halves(sample)]
        # Planted partners in random directions at exactly the similarity: how much
        # farther than the nearest cell is the one that lists the partner?
        away = rng.normal(size=sample.shape)
        away -= (away * sample).sum(axis=1, keepdims=True) * sample
        norm = np.linalg.norm(away, axis=1, keepdims=True)
        away = np.divide(away, norm, out=np.zeros_like(away), where=norm > 0)
        near = cosine * sample + math.sqrt(1 - cosine**2) * away
        extra = np.zeros(len(sample))
        for x, y, codes in zip(self.halves(sample), self.halves(near), self.codes, strict=True):
            d = squared(x, codes)
            extra += d[np.arange(len(d)), squared(y, codes).argmin(axis=1)] - d.min(axis=1)
        self.reach = float(np.quantile(extra, target))

    def halves(self, points: np.ndarray) -> list[np.ndarray]:
        return [points[:, : self.half], points[:, self.half :]]

    def cell(self, points: np.ndarray) -> np.ndarray:
        a, b = (squared(x, c).argmin(axis=1) for x, c in zip(self.halves(points), self.codes, strict=True))
        return a * len(self.codes[1]) + b

    def walk(self, points: np.ndarray) -> Iterator[np.ndarray]:
        """Cells that a search visits, per point.

        With each half's codes sorted by distance, the cells within reach lie under
        a staircase: the farther one code, the fewer of the other's fit with it.
        """
        far = [squared(x, c) for x, c in zip(self.halves(points), self.codes, strict=True)]
        orders = [d.argsort(axis=1) for d in far]
        sorted_ = [np.take_along_axis(d, o, axis=1) for d, o in zip(far, orders, strict=True)]
        for a, b, d, e in zip(*orders, *sorted_, strict=True):
            left = self.reach + 1e-12 - (d - d[0])
            rows = int((left >= 0).sum())
            fits = np.searchsorted(e - e[0], left[:rows], "right")
            first = np.repeat(a[:rows], fits)
            second = b[np.concatenate([np.arange(f) for f in fits])]
            yield first * len(self.codes[1]) + second


def unit(raw: list[bytes]) -> np.ndarray:
    """Unit vectors in double precision."""
    points = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    # Scaled first, so that no square over- or underflows.
    points = points / np.abs(points).max(axis=1, keepdims=True)
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def _packed(vectors: DataFrame) -> DataFrame:
    """(id, size, v) with the components as doubles; v is null if it can't link."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, sizes = [], []
            for x in batch.column(1):
                part = x.values if x.is_valid else None
                if part is None or not len(part) or part.null_count:
                    out.append(None)
                    sizes.append(0)
                    continue
                point = part.to_numpy(zero_copy_only=False).astype(np.float64)
                good = np.isfinite(point).all() and point.any()
                # Minus zero is zero.
                out.append((point + 0.0).tobytes() if good else None)
                sizes.append(len(point) if good else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int32()), pa.array(out, pa.binary())], ["id", "size", "v"]
            )

    return vectors.mapInArrow(pack, "id long, size int, v binary")


def _visiting(cells: np.ndarray, listed: pa.ListArray) -> np.ndarray:
    """Whether each listed vector's own search visits some cells: listed x cell."""
    single, back = np.unique(cells, return_inverse=True)
    flat = listed.flatten().to_numpy()
    of = np.repeat(np.arange(len(listed)), np.diff(listed.offsets.to_numpy()))
    place = np.minimum(np.searchsorted(single, flat), len(single) - 1)
    visits = np.zeros((len(listed), len(single)), bool)
    met = single[place] == flat
    visits[of[met], place[met]] = True
    return visits[:, back]


def _compared(meeting: DataFrame, cosine: float) -> DataFrame:
    """Of blocks of searches and blocks of a cell: links per vector, and for every
    vector with a link the smallest id that it is connected with in the two blocks.

    A search may find a vector whose own search does not come back. A link counts at
    its search's end wherever it is found, and at the other end as well if that one's
    search does not visit the cell of the first; so both ends count it once. No pair
    leaves the task, only sums and one row per connected vector.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                left, right = batch.column(0)[i].values, batch.column(1)[i].values
                ids, own = left.field("id").to_numpy(), right.field("id").to_numpy()
                near = unit(left.field("v").to_pylist()) @ unit(right.field("v").to_pylist()).T >= cosine
                near |= ids[:, None] == own[None, :]
                links = near @ right.field("n").to_numpy()
                back = near.T & ~_visiting(left.field("cell").to_numpy(), right.field("visited"))
                others = back @ left.field("n").to_numpy()
                low, lows = ids.copy(), own.copy()
                top = np.iinfo(np.int64).max
                while True:
                    new = np.minimum(low, np.where(near, lows[None, :], top).min(axis=1))
                    down = np.minimum(lows, np.where(near, new[:, None], top).min(axis=0))
                    if (new == low).all() and (down == lows).all():
                        break
                    low, lows = new, down
                a, b = np.concatenate([ids, own]), np.concatenate([low, lows])
                n = np.concatenate([links, others])
                keep = (a != b) | (n > 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[keep]), pa.array(b[keep]), pa.array(n[keep])], ["a", "b", "n"]
                )

    return meeting.mapInArrow(compare, "a long, b long, n long")


def _of_one_size(listed: DataFrame, cosine: float, target: float) -> DataFrame:
    """(a, b, n) of distinct vectors of one dimension."""
    count = listed.count()
    sample = listed.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("v").toArrow()
    index = Index(unit(sample.column(0).to_pylist()), count, cosine, target)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                points = unit(part.column(1).to_pylist())
                cells = pa.array(index.cell(points))
                visited = pa.array([x.tolist() for x in index.walk(points)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, cells, visited], ["id", "v", "n", "cell", "visited"])

    placed = stored(
        listed.select("id", "v", "n").mapInArrow(place, "id long, v binary, n long, cell long, visited array<long>"),
        "placed",
    )

    def blocks(rows: DataFrame, name: str, fields: list) -> DataFrame:
        """Rows of each cell in blocks of about the size; a full cell is many blocks."""
        sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("_of"))
        dealt = rows.join(sizes, "cell").withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_of")))
        return dealt.groupBy("cell", "_block").agg(F.collect_list(F.struct(*fields)).alias(name)).drop("_block")

    searches = placed.select("id", "v", "n", F.col("cell").alias("home"), F.explode("visited").alias("cell"))
    meeting = blocks(searches, "searches", ["id", "v", "n", F.col("home").alias("cell")]).join(
        blocks(placed, "listed", ["id", "v", "n", "visited"]), "cell"
    )
    return _compared(meeting.select("searches", "listed"), cosine)


def near_vectors(
    vectors: DataFrame,
    cosine: float = COSINE,
    target: float = TARGET,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(id, n_links, component_id, kept) for every vector.

    Vectors are linked if their cosine, in double precision, is at least `cosine`;
    vectors of different dimension aren't. Every pair found is checked; the reach of
    a search is set so that `target` of the partners at exactly that cosine are
    found, and closer ones more often. Equal vectors count as one in the search.

    Vectors that are null, empty, zero, or hold null or non-finite components link
    with nothing. Repeated rows are vectors of their own that share an id; a row
    without id is named after its component and kept if that has no id; an empty table gives no rows; other
    columns are not read.
    """
    spark = vectors.sparkSession
    packed = stored(
        _packed(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x"))), "packed"
    )
    good = packed.where("v IS NOT NULL")
    # Equal vectors are one entry with a number of its own, whatever their ids.
    listed = stored(
        good.groupBy("v")
        .agg(F.min("id").alias("first"), F.count("*").alias("n"), F.first("size").alias("size"))
        .withColumn("id", F.monotonically_increasing_id()),
        "listed",
    )
    found = None
    for r in listed.select("size").distinct().collect():
        part = _searched(listed.where(F.col("size") == r["size"]), cosine, target)
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "a long, b long, n long")
    of = stored(components(found.select("a", "b")), "components").withColumnRenamed("node", "id")
    links = found.groupBy("a").agg(F.sum("n").alias("links")).withColumnRenamed("a", "id")
    # The search finds every entry itself, so each has links and a component.
    entries = stored(listed.join(links, "id").join(of, "id"), "entries")
    names = entries.groupBy("component").agg(F.min("first").alias("name"))
    linked = entries.join(names, "component").select("v", "links", "name")
    return (
        packed.join(linked, "v", "left")
        .select("id", F.coalesce(F.col("links") - 1, F.lit(0)).alias("n_links"), F.coalesce("name", "id").alias("name"))
        .select(
            F.col("id").alias(id_col),
            "n_links",
            F.col("name").alias("component_id"),
            F.coalesce(F.col("name") == F.col("id"), F.lit(True)).alias("kept"),
        )
    )


def _searched(listed: DataFrame, cosine: float, target: float) -> DataFrame:
    with _small_batches(listed.sparkSession, 16):
        return stored(_of_one_size(listed, cosine, target), "compared")
