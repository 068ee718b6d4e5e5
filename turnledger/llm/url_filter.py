"""URL rules as wildcard patterns, all simulated at once in the bits of a few words.

Every rule becomes one or more patterns over a canonical URL: host, path and query,
without scheme and fragment. The positions of all patterns lie one after the other in
a row of 64-bit words. A character moves every live position on with one shift and one
mask, and keeps those that stand at a wildcard with another mask, whatever the number
of patterns.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

ALLOW, BLOCK = "allow", "block"

#: (verdict, host, path): a host with all its subdomains, and how its paths begin.
RULES = (
    (ALLOW, "org", "/"),
    (BLOCK, "example.org", "/es/"),
    (BLOCK, "example.org", "/en/1"),
    (ALLOW, "com", "/fr/"),
    (BLOCK, "com", "/de/"),
)
#: (verdict, glob) for URLs that no rule fits: `*` is any run within a part of the URL,
#: `**` any run, `?` a character within a part, `\` makes the next one plain.
GLOBS = (
    (BLOCK, "ads-track.**"),
    (BLOCK, "*.ads-track.**"),
    (BLOCK, "**/wp-login.php**"),
)
#: The verdict if nothing fits.
OTHERWISE = ALLOW

#: URL rows that go through the automaton together.
ROWS = 4096
#: Bytes of state that one step may hold; wide rule sets take fewer rows at a time.
STATE_BYTES = 8_000_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes that end a part of a URL, so that `*` and `?` do not pass them.
_ENDS = b"/?"
_FOLLOW = range(0x80, 0xC0)


def parts_of(url: str | None) -> tuple[str, str, str]:
    """Host, path and query (with its question mark); empty without `://`."""
    if url is None or (at := url.find("://")) < 0:
        return "", "", ""
    rest = url[at + 3 :]
    if (cut := rest.find("#")) >= 0:
        rest = rest[:cut]
    if (cut := rest.find("?")) >= 0:
        rest, query = rest[:cut], rest[cut:]
    else:
        query = ""
    cut = rest.find("/")
    host, path = (rest, "") if cut < 0 else (rest[:cut], rest[cut:])
    return host.encode("utf-8", "replace").translate(_LOWER).decode(), path, query


def escaped(text: str) -> str:
    return "".join("\\" + c if c in "*?\\" else c for c in text)


def rule_globs(host: str, path: str) -> list[str]:
    """Patterns that together fit a host, its subdomains, and paths that begin so; none
    for what no host or path of a URL can be."""
    if any(c in host for c in "/?#") or any(c in path for c in "?#") or path[:1] not in ("", "/"):
        return []
    ends = [escaped(path) + "**"] if path else ["", "/**", "\\?**"]
    return [start + escaped(host) + end for start in ("", "*.") for end in ends]


def _tokens(glob: str) -> list[tuple[str, int]]:
    """A pattern as (kind, byte): `byte`, `one` (`?`), `part` (`*`), `any` (`**`)."""
    out, at = [], 0
    while at < len(glob):
        c = glob[at]
        if c == "*":
            wide = glob.startswith("**", at)
            out.append(("any" if wide else "part", 0))
            at += 2 if wide else 1
            continue
        if c == "?":
            out.append(("one", 0))
        else:
            if c == "\\" and at + 1 < len(glob):
                at += 1
                c = glob[at]
            out += [("byte", b) for b in c.encode()]
        at += 1
    return out


class Automaton:
    """All patterns side by side; those given first win over later ones.

    A pattern of m characters has m + 1 positions, the first of which is live at the
    start. `moves[c]` holds the positions that c leads into, `stays[c]` those where a
    wildcard lets c pass without moving.
    """

    def __init__(self, globs: list[str]):
        coded = [_tokens(g) for g in globs]
        total = sum(1 + sum(kind in ("byte", "one") for kind, _ in own) for own in coded)
        self.words = max(1, -(-total // 64))
        self.start = np.zeros(self.words, np.uint64)
        self.final = np.zeros(self.words, np.uint64)
        self.moves = np.zeros((256, self.words), np.uint64)
        self.stays = np.zeros((256, self.words), np.uint64)
        #: The pattern that ends at a position.
        self.ends_at = np.full(self.words * 64, -1, np.int64)
        inside = [b for b in range(256) if b not in _ENDS]
        at = 0

        def bit(rows, place: int) -> None:
            rows[..., place // 64] |= np.uint64(1) << np.uint64(place % 64)

        def bits(table: np.ndarray, chars, place: int) -> None:
            table[list(chars), place // 64] |= np.uint64(1) << np.uint64(place % 64)

        for number, own in enumerate(coded):
            bit(self.start, at)
            for kind, byte in own:
                if kind == "any":
                    bits(self.stays, range(256), at)
                elif kind == "part":
                    bits(self.stays, inside, at)
                elif kind == "one":
                    at += 1
                    # The rest of a character of several bytes does not move on.
                    bits(self.moves, [b for b in inside if b not in _FOLLOW], at)
                    bits(self.stays, _FOLLOW, at)
                else:
                    at += 1
                    bits(self.moves, [byte], at)
            bit(self.final, at)
            self.ends_at[at] = number
            at += 1

    def first(self, urls: list[bytes]) -> np.ndarray:
        """Number of the first pattern that fits each URL as a whole, -1 for none."""
        out = np.full(len(urls), -1, np.int64)
        step = max(1, min(ROWS, STATE_BYTES // (8 * self.words)))
        order = sorted(range(len(urls)), key=lambda i: -len(urls[i]))
        for begin in range(0, len(order), step):
            rows = order[begin : begin + step]
            out[rows] = self._first([urls[i] for i in rows])
        return out

    def _first(self, urls: list[bytes]) -> np.ndarray:
        """The same for some URLs, the longest of them first."""
        sizes = np.fromiter(map(len, urls), np.int64, len(urls))
        flat = np.frombuffer(b"".join(urls), np.uint8)
        starts = np.cumsum(sizes) - sizes
        live = np.tile(self.start, (len(urls), 1))
        one, top = np.uint64(1), np.uint64(63)
        # How many URLs are longer than each position.
        longer = len(urls) - np.searchsorted(sizes[::-1], np.arange(sizes[0] if len(urls) else 0), "right")
        for at, n in enumerate(longer.tolist()):
            now, chars = live[:n], flat[starts[:n] + at]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            live[:n] = (moved & self.moves[chars]) | (now & self.stays[chars])
        ended = live & self.final
        word = (ended != 0).argmax(axis=1)
        last = ended[np.arange(len(urls)), word]
        place = word * 64 + np.bitwise_count((last & (~last + one)) - one).astype(np.int64)
        return np.where(last != 0, self.ends_at[np.minimum(place, len(self.ends_at) - 1)], -1)


@dataclass(frozen=True)
class Filter:
    """Rules and globs in the order in which they win, as one automaton."""

    automaton: Automaton
    names: list[str | None]
    verdicts: list[str]


def built(rules=RULES, globs=GLOBS) -> Filter:
    """The longest rule wins, of equally long ones the longer host, then `block`; any
    rule wins over any glob, and of globs the first given."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != BLOCK, r[1], r[2]))
    patterns, names, verdicts = [], [], []
    for verdict, host, path in ranked:
        for glob in rule_globs(host, path):
            patterns.append(glob)
            names.append(host + path)
            verdicts.append(verdict)
    for verdict, glob in globs:
        patterns.append(glob)
        names.append(None)
        verdicts.append(verdict)
    return Filter(Automaton(patterns), names, verdicts)


def judged(
    pages: DataFrame,
    rules=RULES,
    globs=GLOBS,
    otherwise: str = OTHERWISE,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """(id, host, path, rule, verdict, by_glob) for every row.

    The host is what stands between the first `://` and the next `/`, `?`, `#` or the
    end, A to Z lower-cased; the path goes on to the next `?`, `#` or the end. A null
    URL, or one without `://`, has an empty host and path, and no rule but one for an
    empty host fits it. `rule` is the host and path of the rule that fits, else null;
    then the verdict is that of the first glob that fits, else `otherwise`.

    One pass, without a shuffle; each distinct URL of a batch is judged once. The rules
    are sent to every task: 4 kB and a half per 64 characters of patterns. Very long
    URLs are read to their end; repeated rows give repeated results; an empty table
    gives no rows; other columns are not read.
    """
    own = built(rules, globs)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.array([*own.names, None], pa.string())
        says = pa.array([*own.verdicts, otherwise], pa.string())
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                seen = pc.dictionary_encode(batch.column(1), null_encoding="encode")
                parts = [parts_of(u) for u in seen.dictionary.to_pylist()]
                found = own.automaton.first(["".join(p).encode("utf-8", "replace") for p in parts])
                fits = pa.array(np.where(found < 0, len(own.names), found))
                columns = [
                    pa.array([p[0] for p in parts], pa.string()),
                    pa.array([p[1] for p in parts], pa.string()),
                    kinds.take(fits),
                    says.take(fits),
                    pa.array((found >= 0) & np.array([n is None for n in [*own.names, None]])[found]),
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(c.take(seen.indices) for c in columns)],
                    ["id", "host", "path", "rule", "verdict", "by_glob"],
                )

    kind = pages.schema[id_col].dataType.simpleString()
    return (
        pages.select(id_col, url_col)
        .mapInArrow(judge, f"id {kind}, host string, path string, rule string, verdict string, by_glob boolean")
        .withColumnRenamed("id", id_col)
    )
