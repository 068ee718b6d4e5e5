"""Tokens of whole documents, attributed to sections by their character spans."""

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

#: Where a token goes that crosses a boundary.
RULES = ("first", "last", "largest")


@cache
def tokenizer(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding of a file of ranks, and the bytes of every token."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def token_spans(text: str, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """First character of every token, and the one after its last.

    A token of a part of a character's bytes spans that character.
    """
    encoding, sizes = tokenizer(path, pattern)
    ids = np.array(encoding.encode_ordinary(text), np.int64)
    ends = np.cumsum(sizes[ids])
    starts = ends - sizes[ids]
    if text.isascii():
        return starts, ends
    raw = np.frombuffer(text.encode(), np.uint8)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1
    return character[starts], character[ends - 1] + 1


def attributed(
    starts: np.ndarray, ends: np.ndarray, begins: np.ndarray, stops: np.ndarray, rule: str
) -> tuple[np.ndarray, np.ndarray]:
    """Section of every token (-1: none) and whether it crosses a boundary.

    begins, stops: sorted sections that don't overlap. A token belongs to the
    section of its first character or of its last one, or to the one that holds most
    of it, the earlier of two alike. Of a token that begins between sections, only
    the part inside sections counts.
    """
    first = np.searchsorted(stops, starts, "right")  # first section that ends later
    last = np.searchsorted(begins, ends, "left") - 1  # last one that begins earlier
    touched = (first <= last) & (len(begins) > 0)
    n = len(begins)
    at_first, at_last = np.minimum(first, n - 1), np.maximum(last, 0)
    if n:
        inside = (begins[at_first] <= starts) & (ends <= stops[at_first])
    else:
        inside = np.zeros(len(starts), bool)
    chosen = np.where(touched, at_last if rule == "last" else at_first, -1)
    if rule == "largest":
        for t in np.flatnonzero(touched & (first < last)):
            parts = range(first[t], last[t] + 1)
            chosen[t] = max(parts, key=lambda s: (min(ends[t], stops[s]) - max(starts[t], begins[s]), -s))
    return chosen, touched & ~inside


def count_tokens(
    docs: DataFrame,
    path: str,
    pattern: str,
    sections: str | None = None,
    rule: str = "first",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Tokens per document and section, every document encoded once as a whole.

    sections: a column array<struct<name:string,start:int,end:int>> of character
    spans that don't overlap, in any order; None takes the lines of the text, each
    with its line feed, named by their number. Returns id, section, start, end,
    n_tokens, n_crossing (tokens of the section that reach beyond it or began before
    it), and one row per document with a null section for tokens in no section, if
    there are any. So the counts of a document add up to its tokens.

    A null or empty text has no tokens: its sections, if given, count 0, and without
    it has one empty line. Null or empty sections count 0. Repeated rows give
    repeated results; an empty table gives none; other columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule: one of {', '.join(RULES)}")
    given = [sections] if sections else []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                out: list[list] = [[], [], [], [], [], []]
                for i, text in enumerate(batch.column(1).to_pylist()):
                    spans = batch.column(2)[i].as_py() if given else None
                    for row in _counted(text or "", spans, path, pattern, rule, bool(given)):
                        out[0].append(i)
                        for column, value in zip(out[1:], row, strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(out[0], pa.int64())),
                        pa.array(out[1], pa.string()),
                        pa.array(out[2], pa.int64()),
                        pa.array(out[3], pa.int64()),
                        pa.array(out[4], pa.int64()),
                        pa.array(out[5], pa.int64()),
                    ],
                    ["id", "section", "start", "end", "n_tokens", "n_crossing"],
                )

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return (
        docs.select(id_col, text_col, *given)
        .mapInArrow(
            count,
            f"id {kind}, section string, start long, `end` long, n_tokens long, n_crossing long",
        )
        .withColumnRenamed("id", id_col)
    )


_LINE = re.compile("\n")


def _counted(text, spans, path, pattern, rule, given) -> Iterator[tuple]:
    if given:
        spans = sorted(
            (
                (s["start"], s["end"], s["name"])
                for s in spans or []
                if s and s["start"] is not None and s["end"] is not None
            ),
            key=lambda s: s[:2],
        )
        begins, stops = [s[0] for s in spans], [s[1] for s in spans]
        names = [s[2] for s in spans]
    else:
        stops = [m.end() for m in _LINE.finditer(text)]
        stops.append(len(text))
        begins, names = [0, *stops[:-1]], [str(i) for i in range(len(stops))]
    begin, stop = np.array(begins, np.int64), np.array(stops, np.int64)
    starts, ends = token_spans(text, path, pattern)
    full = np.flatnonzero(stop > begin)  # an empty section cannot hold a token
    chosen, crossing = attributed(starts, ends, begin[full], stop[full], rule)
    n, crossed = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
    inside = chosen >= 0
    n[full] = np.bincount(chosen[inside], minlength=len(full))
    crossed[full] = np.bincount(chosen[inside & crossing], minlength=len(full))
    yield from zip(names, begins, stops, n.tolist(), crossed.tolist(), strict=True)
    if not inside.all():
        yield None, None, None, int((~inside).sum()), 0
