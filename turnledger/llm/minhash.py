"""Near duplicates: banded MinHash candidates, Bayesian pruning, exact sets.

Candidates are pairs whose signatures agree in a band. Their signatures are then
compared batch by batch; after each batch a pair is dropped if, given the matches so
far and a uniform prior, it reaches the similarity with less than the chosen
probability. Whatever is left is decided on the full sets.
"""

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.llm.shared import components, release, stored

SHINGLE = 5
PERCENT = 80
#: A pair at the similarity shares no band with a chance of (1 - 0.8**4)**28 = 4e-7.
BANDS, ROWS = 28, 4
HASHES, BATCH = 256, 32
#: Chance of reaching the similarity below which a pair is dropped unseen.
MISS = 1e-5
#: Members of a bucket that are compared with one another in one step, and how many
#: shingles they may have in all: a block of very long texts has fewer members.
BLOCK, BLOCK_SHINGLES = 128, 2_000_000
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

_rng = np.random.default_rng(20240)
_A = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased A to Z, cut at blanks and the control characters 9 to 13."""
    return text.encode().lower().split() if text else []


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word runs of every text.

    A text of fewer words is one run, its length hashed with it.
    """
    held = [words_of(t) for t in texts]
    number: dict[bytes, int] = {}
    coded = [np.array([number.setdefault(w, len(number)) for w in words], np.int64) for words in held]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
    found = []
    for ids in coded:
        if not len(ids):
            found.append(np.empty(0, np.uint64))
            continue
        n = min(k, len(ids))
        own = hashes[ids]
        runs = np.full(len(ids) - n + 1, n, np.uint64)
        for j in range(n):
            runs = _mixed(runs * _MIX + own[j : j + len(runs)])
        found.append(np.unique(runs))
    return found


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Smallest value of every hash function over every set that isn't empty."""
    starts = np.cumsum([0, *map(len, sets[:-1])])
    values = np.concatenate(sets)
    out = np.empty((len(sets), HASHES), np.uint32)
    for j in range(HASHES):
        out[:, j] = np.minimum.reduceat(values * _A[j] + _B[j], starts) >> np.uint64(32)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    keys = np.empty((len(signature), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(signature), b + 1, np.uint64)
        for r in range(ROWS):
            key = _mixed(key * _MIX + signature[:, b * ROWS + r])
        keys[:, b] = key
    return keys.view(np.int64)


def least_matches(percent: int, miss: float) -> dict[int, int]:
    """Matches a pair needs after each batch to stay.

    Given m matches of n, the similarity reaches t with the chance that a binomial
    of n + 1 trials at t gives at most m.
    """
    t, out = percent / 100, {}
    for n in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += math.exp(
                math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m)
                + m * math.log(t) + (n + 1 - m) * math.log(1 - t)
            )
        out[n] = m
    return out


def survivors(left: np.ndarray, right: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the row pairs that no batch drops, and their matches."""
    at, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for n, m in least.items():
        matches = matches + (left[at, n - BATCH : n] == right[at, n - BATCH : n]).sum(axis=1)
        stay = matches >= m
        at, matches = at[stay], matches[stay]
        if not len(at):
            break
    return at, matches


def packed(values: np.ndarray) -> bytes:
    """The hashes, sorted, in all their bits."""
    return np.unique(values).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _marks(sets: list[np.ndarray]) -> list[pa.Array]:
    """Two halves of a hash of every set that isn't empty."""
    marks = [xxhash.xxh128_intdigest(s.tobytes()) if len(s) else None for s in sets]
    return [pa.array([None if m is None else ((m >> shift) % 2**64) - 2**63 for m in marks], pa.int64()) for shift in (0, 64)]


def _signed(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, n_shingles, set_a, set_b, sig, bands) of every text."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                sets = shingle_sets(batch.column(1).to_pylist(), shingle)
                full = [i for i, s in enumerate(sets) if len(s)]
                sig: list = [None] * len(sets)
                bands: list = [None] * len(sets)
                if full:
                    found = signatures([sets[i] for i in full])
                    keys = band_keys(found).tolist()
                    for i, row, key in zip(full, found.astype(np.uint16), keys, strict=True):
                        sig[i], bands[i] = row.tobytes(), key
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        *_marks(sets),
                        pa.array(sig, pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    ["id", "n_shingles", "set_a", "set_b", "sig", "bands"],
                )

    return docs.mapInArrow(
        sign, "id long, n_shingles long, set_a long, set_b long, sig binary, bands array<long>"
    )


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, set_a, set_b, members) with the packed full set."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                sets = shingle_sets(batch.column(1).to_pylist(), shingle)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *_marks(sets), pa.array([packed(s) for s in sets], pa.binary())],
                    ["id", "set_a", "set_b", "members"],
                )

    return docs.mapInArrow(pack, "id long, set_a long, set_b long, members binary")


def _rows_of(column: pa.Array) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint16)
    return raw.reshape(-1, HASHES)


def _pruned(pairs: DataFrame, signed: DataFrame, least: dict[int, int]) -> DataFrame:
    """(a, b, matches) of the pairs that the signatures don't rule out."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                at, matches = survivors(_rows_of(batch.column(2)), _rows_of(batch.column(3)), least)
                kept = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(kept), batch.column(1).take(kept), pa.array(matches)],
                    ["a", "b", "matches"],
                )

    own = signed.select("id", "sig")
    return (
        pairs.join(own.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")
        .join(own.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a")
        .select("a", "b", "sig_a", "sig_b")
        .mapInArrow(prune, "a long, b long, matches long")
    )


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are linked, by their full sets."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            good = [
                i
                for i in range(batch.num_rows)
                if linked(unpacked(left[i].as_py()), unpacked(right[i].as_py()), percent)
            ]
            kept = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(kept), batch.column(1).take(kept)], ["a", "b"]
            )

    with_b = pairs.select("a", "b").join(
        sets.select(F.col("id").alias("b"), F.col("members").alias("members_b")), "b"
    )
    both = with_b.join(sets.select(F.col("id").alias("a"), F.col("members").alias("members_a")), "a")
    return both.select("a", "b", "members_a", "members_b").mapInArrow(confirm, "a long, b long")


@contextmanager
def _small_batches(spark: SparkSession, rows: int):
    """Fewer rows per Arrow batch while rows are wide."""
    before = spark.conf.get(_ARROW_ROWS)
    spark.conf.set(_ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_ARROW_ROWS, before)


def _across(
    members: DataFrame,
    of: DataFrame,
    signed: DataFrame,
    sets: DataFrame,
    least: dict[int, int],
    percent: int,
) -> DataFrame:
    """Links (a, b) of pairs in one bucket but in different components.

    members: (key, id, n_shingles). Each bucket's largest component is its major part, the rest
    its minor one. Both are dealt into blocks; blocks of the minor part meet all
    others, and a task compares two blocks at a time, each pair in the first band
    that it shares: signatures first, full sets where they don't rule it out. No
    candidate leaves the task, only one link of a document to each component.
    """
    placed = members.join(of, "id")
    kinds = placed.groupBy("key", "component").agg(
        F.count("*").alias("n"), F.sum("n_shingles").alias("size")
    )

    def blocks_for(n, size):
        return F.ceil(F.greatest(n / BLOCK, size / BLOCK_SHINGLES))

    open_ = (
        kinds.groupBy("key")
        .agg(F.max(F.struct("n", "size", "component")).alias("major"), F.sum("n").alias("n"), F.sum("size").alias("size"))
        .where((F.col("major.n") < F.col("n")) & (F.col("n") > 2))
        .select(
            "key",
            F.col("major.component").alias("major"),
            blocks_for(F.col("major.n"), F.col("major.size")).alias("major_blocks"),
            blocks_for(F.col("n") - F.col("major.n"), F.col("size") - F.col("major.size")).alias("minor_blocks"),
        )
    )
    # An id may have several sets; each goes into the buckets of its own bands. Whether a
    # set is the signature's own is no key of the join: all of it then is dealt by id.
    own = F.col("set_a").bitwiseXOR(F.col("own_a")).bitwiseOR(F.col("set_b").bitwiseXOR(F.col("own_b")))
    rows = (
        placed.join(open_, "key")
        .join(signed.select("id", "set_a", "set_b", "sig", "bands"), "id")
        .where(F.array_contains("bands", F.col("key")))
        .join(sets.withColumnsRenamed({"set_a": "own_a", "set_b": "own_b"}), "id")
        .where(own == 0)
        .drop("set_a", "set_b", "own_a", "own_b")
    )
    is_major = F.col("component") == F.col("major")
    blocks = (
        rows.withColumn("is_major", is_major)
        .withColumn(
            "block",
            F.pmod(F.xxhash64("id"), F.when(is_major, F.col("major_blocks")).otherwise(F.col("minor_blocks"))),
        )
        .groupBy("key", "is_major", "block")
        .agg(F.collect_list(F.struct("id", "component", "sig", "bands", "members")).alias("rows"))
    )
    meeting = (
        blocks.where("NOT is_major")
        .select("key", F.col("block").alias("left_block"), F.col("rows").alias("left_rows"))
        .join(blocks, "key")
        .where("is_major OR block >= left_block")
        .select("key", "left_rows", "rows")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                key = batch.column(0)[i].as_py()
                sides = []
                for column in (1, 2):
                    part = batch.column(column)[i].values
                    sides.append(
                        (
                            part.field("id").to_numpy(),
                            part.field("component").to_numpy(),
                            _rows_of(part.field("sig")),
                            np.array(part.field("bands").to_pylist(), np.int64),
                            part.field("members"),
                        )
                    )
                (ids, own, sig, bands, raw), (ids2, own2, sig2, bands2, raw2) = sides
                for x in range(len(ids)):
                    band = int(np.flatnonzero(bands[x] == key)[0])
                    other = np.flatnonzero(own2 != own[x])
                    earlier = (bands2[other, :band] == bands[x, :band]).any(axis=1)
                    other = other[~earlier]
                    at, _ = survivors(np.broadcast_to(sig[x], (len(other), HASHES)), sig2[other], least)
                    mine, joined = unpacked(raw[x].as_py()), set()
                    for y in other[at].tolist():
                        if own2[y] not in joined and linked(mine, unpacked(raw2[y].as_py()), percent):
                            joined.add(own2[y])
                            found.append((min(ids[x], ids2[y]), max(ids[x], ids2[y])))
            unique = np.array(sorted(set(found)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(unique[:, 1]), pa.array(unique[:, 0])], ["a", "b"]
            )

    return meeting.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    miss: float = MISS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row.

    Documents are linked if their sets of word runs have at least `percent` of their
    union in common; component_id is the smallest id reachable, kept tells whether it
    is the row's own. Equal sets count as one throughout. The members of a bucket are
    first compared with its smallest one, best guesses first, and then, only where
    that leaves a bucket in several components, with those in other components.

    A null text, or one without words, has an empty set and links with nothing; rows
    that share an id are one document, linked by any of its texts; a null id links with nothing, has no component
    and is kept; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    least = least_matches(percent, miss)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = stored(_signed(texts, shingle), "signed")
    named = signed.where("id IS NOT NULL AND sig IS NOT NULL")
    # One document for each set, whatever other sets its id may have.
    heads = stored(
        named.groupBy("set_a", "set_b").agg(
            F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n_shingles", "sig", "bands")]
        ),
        "heads",
    )
    first = heads.select("set_a", "set_b", F.col("id").alias("first"))
    members = named.select("id", "set_a", "set_b").join(first, ["set_a", "set_b"])
    same = stored(members.where("id <> first").select("id", "first"), "same")
    # From here on only the heads' signatures are read.
    sizes = stored(signed.select("id", "n_shingles"), "sizes")
    release(signed)
    banded = heads.select("id", "n_shingles", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("top"))
    buckets = stored(
        banded.join(shared.where("pivot < top"), "key").select("key", "id", "n_shingles", "pivot"), "buckets"
    )
    stars = buckets.where("id > pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    candidates = stored(_pruned(stars, heads, least), "candidates")
    wanted = buckets.select("id").distinct()
    sets = stored(_sets(texts.join(wanted, "id", "left_semi"), shingle), "sets")

    def component_of(links: DataFrame) -> DataFrame:
        return stored(components(links), "components")

    def apart(pairs: DataFrame, of: DataFrame) -> DataFrame:
        """The pairs whose ends aren't in one component yet."""
        return (
            pairs.join(of.select(F.col("node").alias("a"), F.col("component").alias("at_a")), "a", "left")
            .join(of.select(F.col("node").alias("b"), F.col("component").alias("at_b")), "b", "left")
            .where(F.coalesce("at_a", "a") != F.coalesce("at_b", "b"))
            .select("a", "b")
        )

    best = candidates.groupBy("a").agg(F.max(F.struct("matches", "b")).alias("best"))
    links = stored(_confirmed(best.select("a", F.col("best.b").alias("b")), sets, percent), "links")
    of = component_of(links)
    more = stored(_confirmed(apart(candidates, of), sets, percent), "links")
    release(candidates, of)
    links = links.union(more)
    of = component_of(links)
    placed = wanted.join(of.withColumnRenamed("node", "id"), "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )
    with _small_batches(spark, 16):
        across = _across(buckets.select("key", "id", "n_shingles"), placed, heads, sets, least, percent)
        links = links.union(stored(across, "across"))
    release(of, buckets, sets, heads)
    of = component_of(links.union(same.select(F.col("id").alias("a"), F.col("first").alias("b"))))
    return (
        sizes.join(of.withColumnRenamed("node", "id"), "id", "left")
        .select(
            F.col("id").alias(id_col),
            "n_shingles",
            F.coalesce("component", "id").alias("component_id"),
            F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"),
        )
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One document of each group of near duplicates, the columns as they were."""
    gone = near_duplicates(docs, id_col=id_col, **options).where("NOT kept").select(id_col)
    return docs.join(gone, id_col, "left_anti").select(*(f"`{c}`" for c in docs.columns))
