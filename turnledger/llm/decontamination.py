"""Benchmark passages in documents, by a suffix automaton of all items.

The automaton holds every run of words of every item. A document's words are
streamed through it; the state says which runs of items end at a word and how long
the longest one is.
"""

import hashlib
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.llm.shared import stored

WINDOW = 10
#: Bytes of items in one automaton. More items go through in several passes.
MAX_ITEM_BYTES = 16_000_000

#: Digits and letters of ASCII, lower-cased, and all that is not ASCII make words.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32
    for b in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split() if text else []


class Automaton:
    """Generalised suffix automaton of the words of some items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        coded = [
            (name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words])
            for name, words in items
            if words
        ]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in coded:
            last = 0
            for w in words:
                last = self._extended(last, w)
        #: Shortest run of words that can be a hit.
        self.shortest = min((min(len(w), window) for _, w in coded), default=window)
        self.items: dict[int, set[str]] = defaultdict(set)
        short: dict[int, dict[int, set[str]]] = defaultdict(lambda: defaultdict(set))
        for name, words in coded:
            state = length = 0
            for w in words:
                state, length = self.step(state, length, w)
                if length >= window:
                    self.items[self._window_state(state)].add(name)
            if len(words) < window:
                short[state][len(words)].add(name)
        # Short items that end where a state's runs end, shorter runs included.
        self.short: dict[int, list[tuple[int, set[str]]]] = {}
        if short:
            for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
                own = [*short[state].items()] if state in short else []
                if found := self.short.get(self.link[state], []) + own:
                    self.short[state] = found

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, at: int, w: int, old: int) -> int:
        """The part of `old` that also ends runs one word longer than `at`'s."""
        new = self._state(self.length[at] + 1)
        self.next[new] = dict(self.next[old])
        self.link[new], self.link[old] = self.link[old], new
        while at >= 0 and self.next[at].get(w) == old:
            self.next[at][w] = new
            at = self.link[at]
        return new

    def _extended(self, last: int, w: int) -> int:
        known = self.next[last].get(w)
        if known is not None:
            longer = self.length[known] > self.length[last] + 1
            return self._split(last, w, known) if longer else known
        new, at = self._state(self.length[last] + 1), last
        while at >= 0 and w not in self.next[at]:
            self.next[at][w] = new
            at = self.link[at]
        if at >= 0:
            old = self.next[at][w]
            longer = self.length[old] > self.length[at] + 1
            self.link[new] = self._split(at, w, old) if longer else old
        return new

    def step(self, state: int, length: int, w: int) -> tuple[int, int]:
        """The state and length of the longest run that ends at the next word."""
        while state and w not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        found = self.next[state].get(w)
        return (0, 0) if found is None else (found, length + 1)

    def _window_state(self, state: int) -> int:
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Merged spans of hit words, items found, longest match in words."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        longest = 0
        get, follow, link, lengths = self.vocabulary.get, self.next, self.link, self.length
        window, short, whole = self.window, self.short, self.items
        ids = np.fromiter([get(w, -1) for w in words], np.int32, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (ids >= 0).view(np.int8), [0]])))
        for a, b in edges.reshape(-1, 2).tolist():
            # Words that no item has reset the match; shorter runs hold no window.
            if b - a < self.shortest:
                continue
            state = length = 0
            for at, w in enumerate(ids[a:b].tolist(), a + 1):
                follows = follow[state]
                while state and w not in follows:
                    state = link[state]
                    length = lengths[state]
                    follows = follow[state]
                state = follows.get(w, 0)
                length = length + 1 if state else 0
                hit = 0
                if length >= window:
                    hit = window
                    longest = max(longest, length)
                    ends = state
                    while lengths[link[ends]] >= window:
                        ends = link[ends]
                    items |= whole[ends]
                if short and state in short:
                    for n, names in short[state]:
                        if n <= length:
                            hit = max(hit, n)
                            longest = max(longest, length)
                            items |= names
                if hit:
                    start = at - hit
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, at))
        return spans, items, longest


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without some spans of its words."""
    raw, kept, at = text.encode(), [], 0
    places = [m.span() for m in _WORD.finditer(raw)]
    for a, b in spans:
        kept.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*kept, raw[at:]]).decode()


_built: dict[str, Automaton] = {}


def _automaton(key: str, items: list[tuple[str, list[bytes]]], window: int) -> Automaton:
    """The automaton of this pass, built once by each Python worker."""
    if key not in _built:
        _built.clear()
        _built[key] = Automaton(items, window)
    return _built[key]


def contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    max_item_bytes: int = MAX_ITEM_BYTES,
) -> DataFrame:
    """Adds to every document what it shares with the items.

    `hit_of` (its words), `hit_words`, `hit_spans` (array of word spans, end excluded, merged),
    `hit_items` (sorted ids as strings), `longest_match` (words), `clean_text`
    (without the spans). A window is `window` consecutive words of an item, or a
    whole item of fewer; a document word inside any occurrence of one is hit.

    The items are sent to the tasks in slices of a bounded size, one pass each, so
    a large set takes more passes and not more memory. Null or wordless items match
    nothing; an item without id counts under an empty id; a null text has no words
    and stays null; repeated rows give repeated results; an empty table gives no
    rows. Other columns pass through, those named as above are replaced.
    """
    names = ["hit_of", "hit_words", "hit_spans", "hit_items", "longest_match", "clean_text"]
    size = items.agg(F.sum(F.octet_length(item_text) + 64)).first()[0] or 0
    slices = -(-size // max_item_bytes) or 1
    named = items.where(F.col(item_text).isNotNull()).select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name"),
        F.col(item_text).alias("words"),
    )
    spans = "array<struct<start:int,end:int>>"
    plain = docs.drop(*names)
    found = plain.withColumn("hit_of", F.lit(0).cast("long"))
    found = found.withColumn("hit_words", F.lit(0).cast("long"))
    found = found.withColumn("hit_spans", F.array().cast(spans))
    found = found.withColumn("hit_items", F.array().cast("array<string>"))
    found = found.withColumn("longest_match", F.lit(0).cast("long"))
    found = found.withColumn("clean_text", F.lit(None).cast("string"))
    for k in range(slices):
        part = named if slices == 1 else named.where(F.pmod(F.xxhash64("name", "words"), F.lit(slices)) == k)
        held = [(r["name"], words_of(r["words"])) for r in part.collect()]
        if k:
            found = stored(found, "contamination")
        found = _passed(found, held, window, text_col, last=k == slices - 1)
    return found


def _passed(
    docs: DataFrame, held: list[tuple[str, list[bytes]]], window: int, text_col: str, last: bool
) -> DataFrame:
    key = uuid.uuid4().hex
    at = docs.columns.index(text_col)
    n_own = len(docs.columns) - 6

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, held, window)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                rows: list[list] = [[], [], [], [], [], []]
                before = batch.select(range(n_own, n_own + 6)).to_pylist()
                for text, old in zip(batch.column(at).to_pylist(), before, strict=True):
                    words = words_of(text)
                    spans, items, longest = automaton.hits(words)
                    if old["hit_spans"]:
                        both = sorted([*spans, *((s["start"], s["end"]) for s in old["hit_spans"])])
                        spans = []
                        for a, b in both:
                            if spans and spans[-1][1] >= a:
                                a, b = spans[-1][0], max(b, spans.pop()[1])
                            spans.append((a, b))
                    rows[0].append(len(words))
                    rows[1].append(sum(b - a for a, b in spans))
                    rows[2].append([{"start": a, "end": b} for a, b in spans])
                    rows[3].append(sorted(items.union(old["hit_items"])))
                    rows[4].append(max(longest, old["longest_match"]))
                    rows[5].append((cut(text, spans) if spans else text) if last else None)
                kinds = [batch.schema.field(n_own + i).type for i in range(6)]
                columns = [pa.array(r, t) for r, t in zip(rows, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:n_own], *columns], names=batch.schema.names
                )

    return docs.mapInArrow(judge, docs.schema)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: counts and a hash of the items found."""
    return found.select(
        id_col,
        F.col("hit_of").alias("n_words"),
        F.col("hit_words").alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.col("hit_words") > 0).alias("contaminated"),
        "longest_match",
    )


def decontaminated(
    docs: DataFrame, items: DataFrame, max_share: float = 0.5, text_col: str = "text"
) -> DataFrame:
    """The documents without their hit spans, and without those of which the spans
    are more than `max_share`. The columns stay as they are."""
    found = contamination(docs, items, text_col=text_col)
    return found.where(F.col("hit_words") <= F.col("hit_of") * F.lit(max_share)).select(
        *(F.col("clean_text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns)
    )
