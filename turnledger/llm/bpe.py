"""Byte-level BPE: propose tokens greedily, check all neighbours at once, merge the rest.

A sequence of tokens is the encoding of a word exactly if every token encodes to
itself and no two neighbours would have merged across the seam between them. So a
longest-match proposal is checked pair by pair, many words in one go, and only the
words that fail are merged by the rules.
"""

import gc
import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import chain, count
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The pattern and the byte alphabet of this family of tokenizers; fixed values.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [(0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)]
FIRST_OTHER = 0x100

#: Runs of words remembered by one Python worker, and the longest word that is checked
#: after a proposal; longer ones are merged.
MAX_RUNS = 150_000
MAX_WORD = 200
#: Words proposed for, and merged, in one go; runs looked up in one go.
TOGETHER, AT_ONCE = 8192, 100_000
#: Rank of a pair that never merges.
NEVER = np.int64(2**62)
NONE = (2**62, -1)
#: Characters of text encoded in one go.
STEP = 2_000_000
RUNS = re.compile(r"(?<=\S)(?= \S)")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte."""
    shown = [b for low, high in PRINTABLE for b in range(low, high + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    pairs = {chr(b): b for b in shown}
    return pairs | {chr(FIRST_OTHER + i): b for i, b in enumerate(hidden)}


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs that begin at `starts`, one run after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


class Remembered:
    """A table of bounded size: what was not asked for since it last filled up goes."""

    def __init__(self):
        self.table: dict = {}
        self.older: dict = {}

    def missing(self, keys: Iterable) -> list:
        """The keys that have to be made; all others are in the table from here on."""
        if len(self.table) > MAX_RUNS:
            self.older, self.table = self.table, {}
        table, older, new = self.table, self.older, []
        for key in keys:
            if key not in table:
                if (known := older.get(key)) is None:
                    new.append(key)
                else:
                    table[key] = known
        return new


class Encoder:
    """Encodes and decodes with the vocabulary and merges of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        model, byte_of = given["model"], byte_alphabet()

        def raw(token: str) -> bytes:
            return bytes(byte_of[c] for c in token)

        self.ids = {raw(token): i for token, i in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in given["added_tokens"]}
        self.bytes_of = {i: token for token, i in self.ids.items()}
        self.bytes_of |= {i: text.encode() for text, i in self.special.items()}
        self.size = n = max(self.bytes_of) + 1
        self.names = [str(i) for i in range(n)]
        self.name_sizes = np.array([len(x) for x in self.names])
        self.byte_sizes = np.array([len(self.bytes_of.get(i, b"")) for i in range(n)])
        merges = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        pairs = np.array([[self.ids[raw(a)], self.ids[raw(b)]] for a, b in merges], dtype=np.int64)
        made = np.array([self.ids[raw(a + b)] for a, b in merges], dtype=np.int64)
        self.rank_of = {(a, b): (r, t) for r, ((a, b), t) in enumerate(zip(pairs.tolist(), made.tolist(), strict=True))}
        # How each token comes about: its halves and the rank of that merge.
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.rank = np.full(n, NEVER)
        for (a, b), r, t in zip(pairs[::-1].tolist(), range(len(made))[::-1], made[::-1].tolist()):
            self.left[t], self.right[t], self.rank[t] = a, b, r
        keys = pairs[:, 0] * n + pairs[:, 1]
        order = np.argsort(keys)
        self._keys, self._ranks = keys[order], order.astype(np.int64)
        self._made = made
        self._byte_ids = np.array([self.ids.get(bytes([b]), -1) for b in range(256)], np.int64)
        self._grow_trie()
        self._own: dict[int, bool] = {}
        self._runs = Remembered()
        specials = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self._split = regex.compile(f"({specials})") if specials else None
        self._pattern = regex.compile(PATTERN)

    def _grow_trie(self) -> None:
        """All tokens by their bytes: children as sorted keys, and the token at a node."""
        children: dict[int, int] = {}
        tokens = [-1]
        for token, i in self.ids.items():
            node = 0
            for b in token:
                key = node << 8 | b
                if (child := children.get(key)) is None:
                    child = children[key] = len(tokens)
                    tokens.append(-1)
                node = child
            tokens[node] = i
        keys = np.fromiter(children, np.int64, len(children))
        order = np.argsort(keys)
        self._edges = keys[order]
        self._child = np.fromiter(children.values(), np.int64, len(children))[order]
        self._token_at = np.array(tokens, np.int64)

    # Whole words.

    def merged(self, word: bytes) -> list[int]:
        """The exact rule: merge the pair of lowest rank, the leftmost first."""
        if len(word) > MAX_WORD:
            return self._merged_long(word)
        ids, rank_of = self.ids, self.rank_of
        parts = [ids[word[i : i + 1]] for i in range(len(word))]
        ranks = [rank_of.get(pair, NONE) for pair in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best is NONE:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [best[1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of.get((parts[i - 1], parts[i]), NONE)
            if i < len(ranks):
                ranks[i] = rank_of.get((parts[i], parts[i + 1]), NONE)
        return parts

    def _merged_long(self, word: bytes) -> list[int]:
        """The same with a heap of pairs and a linked list of parts, so that a word
        of a million bytes does not take the square of that."""
        ids, rank_of = self.ids, self.rank_of
        parts = [ids[word[i : i + 1]] for i in range(len(word))]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if found := rank_of.get((parts[i], parts[i + 1])):
                heap.append((found[0], i, found[1], parts[i], parts[i + 1]))
        heapify(heap)
        while heap:
            _, i, new, a, b = heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := rank_of.get((new, parts[k])):
                    heappush(heap, (found[0], i, found[1], new, parts[k]))
            h = before[i]
            if h >= 0 and (found := rank_of.get((parts[h], new))):
                heappush(heap, (found[0], h, found[1], parts[h], new))
        return [t for t in parts if t >= 0]

    def proposed(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest match from the left, of many words in step: tokens, and how many.

        words: word x byte, filled up with zeros. Each word walks down the trie by its
        next byte; where it can't, it takes the last token it passed and goes on there.
        """
        out, n = np.full(words.shape, -1, np.int64), np.zeros(len(words), np.int64)
        rows = np.flatnonzero(sizes)
        node, at, token, end = (np.zeros(len(rows), np.int64) for _ in range(4))
        while len(rows):
            left = at < sizes[rows]
            key = node << 8 | words[rows, np.where(left, at, 0)]
            place = np.minimum(np.searchsorted(self._edges, key), len(self._edges) - 1)
            down = left & (self._edges[place] == key)
            node = np.where(down, self._child[place], 0)
            at = np.where(down, at + 1, end)
            here = self._token_at[node]
            passed = down & (here >= 0)
            stuck = ~down
            out[rows[stuck], n[rows[stuck]]] = token[stuck]
            n[rows[stuck]] += 1
            token, end = np.where(passed, here, token), np.where(passed, at, end)
            going = down | (end < sizes[rows])
            if not going.all():
                rows, node, at, token, end = rows[going], node[going], at[going], token[going], end[going]
        return out, n

    def merged_together(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`merged` of many words in step: tokens, -1 where there is none, and how
        many. Parts stay where they began and know their neighbours."""
        n, longest = words.shape
        places = np.arange(longest)
        parts = np.where(places < sizes[:, None], self._byte_ids[words], -1)
        ranks = np.full((n, longest), NEVER)
        pairs = places[:-1] + 1 < sizes[:, None]
        ranks[:, :-1][pairs] = self._pair_rank(parts[:, :-1][pairs], parts[:, 1:][pairs])
        after = np.tile(places + 1, (n, 1))
        before = np.tile(places - 1, (n, 1))
        rows = np.arange(n)
        while len(rows):
            i = ranks[rows].argmin(axis=1)
            best = ranks[rows, i]
            some = best < NEVER
            rows, i, best = rows[some], i[some], best[some]
            j = after[rows, i]
            k = after[rows, j]
            new = self._made[best]
            parts[rows, i], parts[rows, j] = new, -1
            ranks[rows, j] = NEVER
            after[rows, i] = k
            ends = k >= sizes[rows]
            k = np.where(ends, 0, k)
            before[rows[~ends], k[~ends]] = i[~ends]
            ranks[rows, i] = np.where(ends, NEVER, self._pair_rank(new, parts[rows, k]))
            h = before[rows, i]
            has = h >= 0
            ranks[rows[has], h[has]] = self._pair_rank(parts[rows[has], h[has]], new[has])
        return parts, (parts >= 0).sum(axis=1)

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self._keys, key := a * self.size + b), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], NEVER)

    def _seam(self, tokens: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts of each token that touch its seam, from the smallest to the
        whole, and the rank at which each becomes the next."""
        chain = [tokens]
        while (inner := halves[chain[-1]]).max(initial=-1) >= 0:
            chain.append(np.where(inner >= 0, inner, chain[-1]))
        parts = np.stack(chain[::-1], axis=1)
        grown = np.concatenate([self.rank[parts[:, 1:]], np.full((len(tokens), 1), NEVER)], axis=1)
        same = np.zeros(grown.shape, bool)
        same[:, :-1] = parts[:, 1:] == parts[:, :-1]
        grown[same] = -1
        return parts, grown

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a and b stay apart when they stand side by side.

        Both grow towards their final form, whichever merges first by rank. They
        don't stay apart if, at any moment, the parts at the seam may merge before
        either grows. Of equal ranks the left place goes first.
        """
        lp, lr = self._seam(a, self.right)
        rp, rr = self._seam(b, self.left)
        rows = np.arange(len(a))
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        apart, open_ = np.ones(len(a), bool), np.ones(len(a), bool)
        while open_.any():
            x, y = lr[rows, i], rr[rows, j]
            across = self._pair_rank(lp[rows, i], rp[rows, j])
            joins = open_ & (across < NEVER) & (across < x) & (across <= y) & (x >= 0) & (y >= 0)
            apart[joins] = False
            open_ &= ~joins & ((x < NEVER) | (y < NEVER))
            left = open_ & (x <= y)
            i[left] += 1
            j[open_ & ~left] += 1
        return apart

    def _is_own(self, token: int) -> bool:
        own = self._own.get(token)
        if own is None:
            own = self._own[token] = self.merged(self.bytes_of[token]) == [token]
        return own

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Speculate, verify, and merge only what fails: all tokens, and how many of them
        each word has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = lengths.argsort(kind="stable")
        short = order[: np.searchsorted(lengths[order], MAX_WORD, "right")]
        parts = []
        for start in range(0, len(short), TOGETHER):
            own = short[start : start + TOGETHER]
            sizes = lengths[own]
            table = np.zeros((len(own), max(1, int(sizes.max()))), np.uint8)
            inside = np.arange(table.shape[1]) < sizes[:, None]
            table[inside] = np.frombuffer(b"".join([words[i] for i in own.tolist()]), np.uint8)
            tokens, n = self.proposed(table, sizes)
            failing = np.flatnonzero(~self.holds(tokens, n))
            if len(failing):
                tokens[failing], n[failing] = self.merged_together(table[failing], sizes[failing])
            parts.append((own, n, tokens[tokens >= 0]))
        for i in order[len(short) :].tolist():
            alone = self.merged(words[i])
            parts.append((np.array([i]), np.array([len(alone)]), np.array(alone, np.int64)))
        counts = np.zeros(len(words), np.int64)
        for own, n, _ in parts:
            counts[own] = n
        starts = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int64)
        for own, n, tokens in parts:
            out[spread(starts[own], n)] = tokens
        return out, counts

    def holds(self, tokens: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether each row of proposed tokens is the encoding: all are their own, and
        all neighbours stay apart."""
        good = np.ones(len(tokens), bool)
        there = tokens >= 0
        single, back = np.unique(tokens[there], return_inverse=True)
        own = np.fromiter((self._is_own(t) for t in single.tolist()), bool, len(single))
        word = np.nonzero(there)[0]
        good[word[~own[back]]] = False
        beside = np.arange(tokens.shape[1] - 1) + 1 < n[:, None]
        pairs, back = np.unique(tokens[:, :-1][beside] * self.size + tokens[:, 1:][beside], return_inverse=True)
        if len(pairs):
            apart = self.compatible(pairs // self.size, pairs % self.size)
            good[np.nonzero(beside)[0][~apart[back]]] = False
        return good

    # Whole texts.

    def sections(self, text: str) -> list[tuple[str, list[str]]]:
        """A text as (special token or "", runs between single spaces) in order.

        A space between two other visible characters always begins a word, so a text
        can be cut there, and runs can be remembered instead of searched again.
        """
        if self._split is None or not self._split.search(text):
            return [("", RUNS.split(text))]
        return [
            (part, []) if i % 2 else ("", RUNS.split(part))
            for i, part in enumerate(self._split.split(text))
            if part
        ]

    def known(self, runs: Iterable[str]) -> dict[str, tuple[str, int, bytes]]:
        """Ids as text, their number and the bytes they decode to, by run, each given once."""
        new = self._runs.missing(runs)
        table = self._runs.table
        for start in range(0, len(new), AT_ONCE):
            part = new[start : start + AT_ONCE]
            found = [self._pattern.findall(r) for r in part]
            number = numbering()
            word = np.fromiter(map(number.__getitem__, chain.from_iterable(found)), np.int64)
            tokens, sizes = self.encode_words([w.encode() for w in number])
            # The tokens of all runs one after the other, then their texts and bytes.
            flat = tokens[spread((np.cumsum(sizes) - sizes)[word], sizes[word])]
            ends = np.cumsum(sizes[word])
            ends = np.concatenate([[0], ends])[np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))]
            listed = flat.tolist()
            text = ",".join(map(self.names.__getitem__, listed))
            raw = self.decode_bytes(listed)
            at_text = np.concatenate([[0], np.cumsum(self.name_sizes[flat] + 1)])
            at_raw = np.concatenate([[0], np.cumsum(self.byte_sizes[flat])])
            starts = np.concatenate([[0], ends[:-1]])
            rows = zip(
                part,
                *(x.tolist() for x in (at_text[starts], np.maximum(at_text[ends] - 1, at_text[starts]), ends - starts, at_raw[starts], at_raw[ends])),
                strict=True,
            )
            for r, a, b, n, c, d in rows:
                table[r] = (text[a:b], n, raw[c:d])
        return table

    def forget(self) -> None:
        """Let the runs remembered go."""
        self._runs = Remembered()

    def special_row(self, special: str) -> tuple[str, int, bytes]:
        return str(self.special[special]), 1, self.bytes_of[self.special[special]]

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def numbering() -> defaultdict:
    """Numbers keys in the order in which they are first asked for."""
    return defaultdict(count().__next__)


def coded(texts: list[str], own: Encoder) -> Iterator[tuple[int, str, str]]:
    """Number of ids, hash of the ids and hash of the decoded text, per text."""
    at = 0
    while at < len(texts):
        number, held, size, special_runs = numbering(), [], 0, []
        while at < len(texts) and size < STEP:
            size += len(texts[at])
            runs = []
            for special, plain in own.sections(texts[at]):
                if special:
                    # A run of its own kind, as a tuple is no text.
                    special_runs.append((special,))
                    plain = special_runs[-1:]
                runs += map(number.__getitem__, plain)
            held.append(runs)
            at += 1
        if special_runs:
            table = own.known(r for r in number if isinstance(r, str))
            rows = [table[r] if isinstance(r, str) else own.special_row(*r) for r in number]
        else:
            rows = list(map(own.known(number).__getitem__, number))
        ids, sizes, raw = zip(*rows)
        for runs in held:
            # Of one run alone it gives no tuple, so the first is asked for twice.
            pick = itemgetter(runs[0], *runs)
            text = b"".join(pick(raw)[1:]).decode("utf-8", "replace").encode()
            joined = ",".join(pick(ids)[1:]).encode()
            yield sum(pick(sizes)[1:]), hashlib.sha256(joined).hexdigest(), hashlib.sha256(text).hexdigest()


def round_trip(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encodes every text and decodes it again.

    Returns id, n_tokens, ids_sha256 (decimal ids joined by commas) and
    decoded_sha256. Special tokens in a text are taken as such, as the tokenizers
    library does by default. A null text is encoded as an empty one; repeated rows
    give repeated results; an empty table gives none; other columns are not read.
    The tokenizer file has to lie at `path` on every executor.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        # Millions of live strings and no cycles: looking for those takes a tenth of the time.
        gc.disable()
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, 500):
                    part = batch.slice(start, 500)
                    found = list(coded([t or "" for t in part.column(1).to_pylist()], own))
                    n, ids, text = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0),
                            pa.array(n, pa.int64()),
                            pa.array(ids, pa.string()),
                            pa.array(text, pa.string()),
                        ],
                        ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                    )
        finally:
            # Other work of this Python process has other uses for the memory.
            own.forget()
            gc.enable()

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return (
        docs.select(id_col, text_col)
        .mapInArrow(encode, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
        .withColumnRenamed("id", id_col)
    )
