"""Ranked search over documents, by groups of documents that hold the same terms.

For every item, the documents of a block are grouped by which of its terms they hold:
one bit a term, set from the terms' lists of documents. All documents of a group are
bounded by the sum of what each of those terms adds at most anywhere in the block.
Groups are scored in descending order of that bound, until no group left can reach the
best documents found so far.
"""

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnledger.llm.shared import stored

TOP = 10
#: Share of a document's length, in percent, that its terms' counts are held against.
LENGTH_SHARE = 90
#: Documents of a block, and postings after which a block is full before that.
BLOCK, BLOCK_POSTINGS = 8192, 4_000_000
#: Bytes of items searched for in one pass over the documents.
MAX_ITEM_BYTES = 4_000_000
#: Bytes of text cut into terms in one go.
STEP = 1 << 20
#: Documents scored in one go at least, so that small groups go together.
AT_LEAST = 64
#: An estimate beyond this may overflow 64 bits and is worked out in whole numbers of Python.
SAFE = 2**62

#: Letters and digits of ASCII, lower-cased, and all that is not ASCII make terms.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32
    for b in range(256)
)


def terms_in(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece; no piece ends inside a term."""
    raw = text.encode().translate(_TERM_BYTES) if text else b""
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + STEP)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def _indexed(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """(id, size, terms, counts): all terms of a document are counted in `size`; those
    that are asked for are listed by number, with how often they occur."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                sizes, terms, counts = [], [], []
                for text in batch.column(1).to_pylist():
                    size, found = 0, [np.zeros(0, np.int32)]
                    for own in terms_in(text):
                        size += len(own)
                        ids = np.fromiter(map(number.get, own, repeat(-1)), np.int32, len(own))
                        found.append(ids[ids >= 0])
                    own, n = np.unique(np.concatenate(found), return_counts=True)
                    sizes.append(size)
                    terms.append(own.tobytes())
                    counts.append(n.astype(np.int64).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())],
                    ["id", "size", "terms", "counts"],
                )

    return docs.mapInArrow(count, "id long, size long, terms binary, counts binary")


def _spread(index: DataFrame, terms: int) -> np.ndarray:
    """Documents that hold each term. Every task sends one sum a term at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32)
            total += np.bincount(flat, minlength=terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["term", "n"])

    found = index.select("terms").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(terms, np.int64)
    out[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return out


def relative_sizes(sizes: np.ndarray, documents: int, length: int, share: int = LENGTH_SHARE) -> np.ndarray:
    """100 for a document of average length; `share` of it follows the length."""
    factor = share * documents
    if int(sizes.max(initial=0)) * factor < SAFE:
        return 100 - share + sizes * factor // max(length, 1)
    return np.array([100 - share + factor * n // length for n in sizes.tolist()], np.int64)


class Block:
    """Some documents with the lists of their terms, and what each term adds to each."""

    def __init__(self, batches: list[pa.RecordBatch], weights: np.ndarray, documents: int, length: int):
        table = pa.Table.from_batches(batches)
        self.size = table.num_rows
        ids = table.column("id").combine_chunks()
        self.no_id = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()
        held = [np.frombuffer(b"".join(table.column(c).to_pylist()), k) for c, k in (("terms", np.int32), ("counts", np.int64))]
        listed = np.fromiter((len(x) // 4 for x in table.column("terms").to_pylist()), np.int64, self.size)
        docs = np.repeat(np.arange(self.size, dtype=np.int32), listed)
        order = held[0].argsort(kind="stable")
        terms, counts, self.docs = held[0][order], held[1][order], docs[order]
        self.ends = np.cumsum(np.bincount(terms, minlength=len(weights)))
        m = relative_sizes(table.column("size").to_numpy(), documents, length)[self.docs]
        self.adds = weights[terms] * (1_000_000_000 * counts // (1000 * counts + 8 * m))
        #: What each term adds at most.
        self.most = np.zeros(len(weights), np.int64)
        starts = np.concatenate([[0], self.ends[:-1]])
        present = np.flatnonzero(self.ends > starts)
        if len(present):
            self.most[present] = np.maximum.reduceat(self.adds, starts[present])
        self.starts = starts

    def postings(self, term: int) -> slice:
        return slice(int(self.starts[term]), int(self.ends[term]))

    def groups(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bounds, documents, ends) of the groups of equal masks, highest bound first.

        The documents of all groups follow each other; `ends` says where each one ends.
        """
        masks = np.zeros((self.size, -(-len(terms) // 64)), np.uint64)
        for j, t in enumerate(terms.tolist()):
            masks[self.docs[self.postings(t)], j // 64] |= np.uint64(1) << np.uint64(j % 64)
        rows = np.flatnonzero(masks.any(axis=1))
        if masks.shape[1] == 1:
            kinds, of = np.unique(masks[rows, 0], return_inverse=True)
            kinds = kinds[:, None]
        else:
            wide = np.ascontiguousarray(masks[rows]).view(f"V{8 * masks.shape[1]}").ravel()
            _, first, of = np.unique(wide, return_index=True, return_inverse=True)
            kinds = masks[rows][first]
        bounds = np.zeros(len(kinds), np.int64)
        for j, most in enumerate(self.most[terms].tolist()):
            bounds += ((kinds[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64) * most
        order = np.argsort(-bounds, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        turn = place[of]
        return bounds[order], rows[np.argsort(turn, kind="stable")], np.cumsum(np.bincount(turn, minlength=len(order)))

    def scores(self, terms: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Exact scores of some documents."""
        total = np.zeros(len(docs), np.int64)
        for t in terms.tolist():
            own = self.postings(t)
            listed = self.docs[own]
            at = np.minimum(np.searchsorted(listed, docs), len(listed) - 1)
            total += np.where(listed[at] == docs, self.adds[own][at], 0)
        return total


class Best:
    """The best documents of an item so far: highest score, then lowest id."""

    def __init__(self, top: int):
        self.top = top
        self.score, self.no_id, self.id = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """A score below this is of no use."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, no_id: np.ndarray, id: np.ndarray) -> None:
        use = score >= self.least
        score, no_id, id = (np.concatenate(p) for p in ((self.score, score[use]), (self.no_id, no_id[use]), (self.id, id[use])))
        order = np.lexsort((id, no_id, -score))[: self.top]
        self.score, self.no_id, self.id = score[order], no_id[order], id[order]

    def search(self, block: Block, terms: np.ndarray) -> int:
        """Takes the block's best documents in; returns how many were scored."""
        terms = terms[block.ends[terms] > block.starts[terms]]
        if not len(terms) or int(block.most[terms].sum()) < self.least:
            return 0
        bounds, docs, ends = block.groups(terms)
        at = done = 0
        while at < len(bounds) and bounds[at] >= self.least:
            # Some groups at once, none of which is known to be of no use.
            upto = int(np.searchsorted(ends, done + AT_LEAST)) + 1
            upto = min(upto, at + int(np.searchsorted(-bounds[at:], -self.least, "right")))
            part = docs[done : ends[upto - 1]]
            self.add(block.scores(terms, part), block.no_id[part], block.ids[part])
            at, done = upto, int(ends[upto - 1])
        return done


def _best(index: DataFrame, asked: list[np.ndarray], weights: np.ndarray, documents: int, length: int, top: int) -> DataFrame:
    """(item, id, score): each task's best documents of every item."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in asked]

        def take(held: list[pa.RecordBatch]) -> None:
            block = Block(held, weights, documents, length)
            for own, terms in zip(best, asked, strict=True):
                own.search(block, terms)

        held: list[pa.RecordBatch] = []
        n = postings = 0
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                part = whole.slice(start, 500)
                held.append(part)
                n += part.num_rows
                postings += sum(map(len, part.column("terms").to_pylist())) // 4
                if n >= BLOCK or postings >= BLOCK_POSTINGS:
                    take(held)
                    held, n, postings = [], 0, 0
        if held:
            take(held)
        for item, own in enumerate(best):
            ids = pa.array(own.id, mask=own.no_id)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), item, np.int32)), ids, pa.array(own.score)], ["item", "id", "score"]
            )

    return index.mapInArrow(search, "item int, id long, score long")


def ranked(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    max_item_bytes: int = MAX_ITEM_BYTES,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of each item, best first.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII; only
    A to Z are lower-cased. Of N documents with terms, L terms in all and df documents
    that hold a term, its weight is floor(1000 * ln((2N + 2) / (2df + 1))). A document
    of n terms that holds it tf times gets weight * (10**9 * tf div (1000 * tf + 8 * m))
    with m = 10 + 90 * n * N div L, summed over the item's distinct terms. Scores above
    0 count, equal ones go by ascending id.

    Every document is read whole, and every one that may be among the best is scored;
    nothing is left out by a sample or a limit. Items go through in slices of
    `max_item_bytes`, one pass over the documents each, so that many items take more
    passes and not more memory. A task returns `top` rows an item at most, and ranks
    are given after those are limited once more before they are shuffled.

    A null or empty text has no terms: such a document is in no result and not in N,
    such an item gets no rows. Repeated documents are ranked one by one, repeated items
    get their rows once each; a null document id comes after all others of its score, a
    null item id stays null. Empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_id).alias("name"), F.col(item_text).alias("text")).where(F.col("text").isNotNull())
    size = asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    slices = -(-size // max_item_bytes) or 1
    kind = items.schema[item_id].dataType.simpleString()
    out = None
    for k in range(slices):
        part = asked if slices == 1 else asked.where(F.pmod(F.xxhash64("name", "text"), F.lit(slices)) == k)
        found = _slice(spark, texts, part.collect(), kind, top)
        out = found if out is None else out.union(found)
    return out.withColumnsRenamed({"item_id": item_id, "doc_id": id_col})


def _slice(spark, texts: DataFrame, rows: list, kind: str, top: int) -> DataFrame:
    """The result for some items: (name, text), their number bounded by their bytes."""
    number: dict[bytes, int] = {}
    names, asked = [], []
    for r in rows:
        own = {number.setdefault(t, len(number)) for part in terms_in(r["text"]) for t in part}
        if own:
            names.append(r["name"])
            asked.append(np.array(sorted(own), np.int64))
    index = stored(_indexed(texts, number), "index")
    documents, length = index.agg(F.count_if(F.col("size") > 0), F.coalesce(F.sum("size"), F.lit(0))).first()
    spread = _spread(index, len(number))
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in spread.tolist()], np.int64)
    # A term of no document is in no block, whatever its weight.
    found = stored(_best(index.where(F.octet_length("terms") > 0), asked, weights, documents, length, top), "best")
    best_first = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranks = found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= top)
    named = spark.createDataFrame(list(enumerate(names)), f"item int, item_id {kind}")
    return ranks.join(named, "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")
