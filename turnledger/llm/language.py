"""Languages of spans of words: script first, then Viterbi over word scores."""

import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.llm.shared import stored

#: First code points of blocks and the script their letters belong to.
SCRIPTS = [
    (0x41, "latin"),
    (0x370, "greek"),
    (0x400, "cyrillic"),
    (0x530, "armenian"),
    (0x590, "hebrew"),
    (0x600, "arabic"),
    (0x900, "indic"),
    (0xE00, "thai"),
    (0x1000, "other"),
    (0x1100, "hangul"),
    (0x1200, "other"),
    (0x1E00, "latin"),
    (0x1F00, "greek"),
    (0x2000, "other"),
    (0x2C60, "latin"),
    (0x3040, "kana"),
    (0x3100, "han"),
    (0xA000, "other"),
    (0xAC00, "hangul"),
    (0xD7B0, "other"),
    (0xF900, "han"),
    (0xFB00, "other"),
    (0xFF21, "latin"),
    (0xFF66, "kana"),
    (0x20000, "han"),
]
_STARTS = [s for s, _ in SCRIPTS]

#: Documents per language of a sample, by hash of the id.
SAMPLE = 1500
#: Different words of a language that a task holds while it counts.
_HELD_WORDS = 200_000
#: Ranges that values are counted in at once.
RANGES = 4096
#: Size of the table of character sequences, their lengths, weight of their sum.
BUCKETS = 2**17
LENGTHS = (2, 3, 4)
WEIGHT = 1 / len(LENGTHS)
SMOOTHING = 0.5
#: What a change of language costs, in the units of the scores (log odds).
SWITCH = 12.0
#: A script counts as a language's own from this share of its words on.
SCRIPT_SHARE = 0.002
FOREIGN = -1e4

#: A text of at least so many letters whose words speak for their languages less than this
#: share of what is usual is in none of those known.
ENOUGH_LETTERS, LEAST_EVIDENCE = 60, 0.25

UNDETERMINED = "und"
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)
_LETTER = re.compile(r"[^\W\d_]")
_CHUNK = 40_000


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_LETTERS).split() if text else []


def script_of(word: bytes) -> str | None:
    """Script of a word's first letter; None without letters."""
    if word.isascii():
        return "latin"
    for c in word.decode("utf-8", "replace"):
        if c.isalpha():
            return SCRIPTS[max(0, bisect(_STARTS, ord(c)) - 1)][1]
    return None


def _sequences(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed character sequences, which of them exist, and where each word begins.

    Words keep the blank on both sides, so beginnings and ends tell as well.
    """
    text = np.frombuffer(b" " + b" ".join(words) + b" " * (max(LENGTHS) + 1), np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    n = int(ends[-1])
    left = np.repeat(ends, sizes) - np.arange(n)  # bytes up to the blank after the word
    hashes, valid = [], []
    for k in LENGTHS:
        h = np.full(n, k, np.uint32)
        for j in range(k):
            h = (h ^ text[j : j + n]) * np.uint32(0x01000193)
        hashes.append((h ^ (h >> np.uint32(15))) % np.uint32(BUCKETS))
        valid.append(left >= k - 1)
    return np.stack(hashes), np.stack(valid), ends - sizes


class Model:
    """Log odds of hashed sequences per language, and each language's scripts."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: dict[str, np.ndarray]):
        self.languages = languages
        chance = counts.astype(np.float64) + SMOOTHING
        logs = np.log(chance / chance.sum(axis=1, keepdims=True)).T
        self.table = ((logs - logs.mean(axis=1, keepdims=True)) * WEIGHT).astype(np.float32)
        total = np.maximum(sum(scripts.values(), np.zeros(len(languages))), 1)
        shares = {s: n / total >= SCRIPT_SHARE for s, n in scripts.items()}
        #: Languages that a script rules out; an unknown script rules out none.
        self.foreign = {s: ~own for s, own in shares.items() if own.any() and not own.all()}

    def scores(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Score of every language for every word, and which words have letters."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        lettered = np.ones(len(words), bool)
        for start in range(0, len(words), _CHUNK):
            part = words[start : start + _CHUNK]
            hashes, valid, begin = _sequences(part)
            each = np.zeros((hashes.shape[1], len(self.languages)), np.float32)
            for h, v in zip(hashes, valid, strict=True):
                each[v] += self.table[h[v]]
            out[start : start + len(part)] = np.add.reduceat(each, begin, axis=0)
        for i, w in enumerate(words):
            script = script_of(w)
            if script is None:
                lettered[i] = False
                out[i] = 0
            elif script in self.foreign:
                out[i, self.foreign[script]] = FOREIGN
        return out, lettered


def path(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language for each word if every change costs `switch`.

    Most texts stay in one language. That is certain if no run of words gains more
    in other languages than leaving and coming back costs, which running minima
    tell; only other texts are walked word by word.
    """
    n = len(scores)
    best = int(scores.sum(axis=0, dtype=np.float64).argmax())
    if not _worth_leaving(scores, best, switch):
        return np.full(n, best)
    rows = scores.tolist()
    value, steps = rows[0], []
    for row in rows[1:]:
        top = max(value)
        floor = top - switch
        steps.append((value.index(top), floor, value))
        value = [(v if v >= floor else floor) + s for v, s in zip(value, row)]
    at = value.index(max(value))
    ways = [at]
    for top, floor, before in reversed(steps):
        if before[at] < floor:
            at = top
        ways.append(at)
    return np.array(ways[::-1])


def _worth_leaving(scores: np.ndarray, best: int, switch: float) -> bool:
    """False only if staying in `best` is certainly the best path.

    k stays in other languages cost at least k - 1 changes, and one alone cannot
    be better as `best` is the best single language. So none pays if no run of
    words gains more than half a change over `best`.
    """
    over = np.cumsum(scores.astype(np.float64) - scores[:, best : best + 1], axis=0)
    over = np.concatenate([np.zeros((1, scores.shape[1])), over])
    return bool((over - np.minimum.accumulate(over, axis=0)).max() > switch / 2)


def labelled(texts: list[str | None], model: Model) -> Iterator[tuple[str, float, list[dict], float, int]]:
    """Language, share of the letters it has, spans of words, mean score of the letters
    in the languages of their spans, and number of letters, per text."""
    held = [words_of(t) for t in texts]
    number: dict[bytes, int] = {}
    coded = [[number.setdefault(w, len(number)) for w in words] for words in held]
    if number:
        table, lettered = model.scores(list(number))
        weight = np.fromiter(map(len, number), np.int64, len(number)) * lettered
    for ids in coded:
        if not ids or not lettered[(at := np.array(ids))].any():
            yield UNDETERMINED, 0.0, [], 0.0, 0
            continue
        ways = path(table[at])
        letters = int(weight[at].sum())
        evidence = float(table[at, ways].sum(dtype=np.float64)) / letters
        share = np.bincount(ways, weight[at], len(model.languages))
        first = int(share.argmax())
        turns = np.flatnonzero(np.diff(ways)) + 1
        starts, ends = [0, *turns.tolist()], [*turns.tolist(), len(ids)]
        spans = [
            {"start": a, "end": b, "lang": model.languages[ways[a]]} for a, b in zip(starts, ends, strict=True)
        ]
        yield model.languages[first], float(share[first] / share.sum()), spans, evidence, letters


def sampled(labelled_docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(text, lang) of at most `sample` documents per language, the first by hash of id
    and text.

    Which those are is told by counts of the hashes' first 16 bits: all below a language's
    cut are taken, and only the few at the cut are ranked. So texts do not move, but for
    those few, and no task sees a whole language.
    """
    rows = labelled_docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(text_col).alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
        F.xxhash64(id_col, text_col).alias("h"),
    )
    rows = rows.withColumn("part", F.shiftright("h", 48).cast("int"))
    counts = rows.groupBy("lang", "part").agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.expr("sum(n) OVER (PARTITION BY lang ORDER BY part)"))
    cuts = (
        upto.where(F.col("upto") >= sample)
        .groupBy("lang")
        .agg(F.min(F.struct("part", "upto", "n")).alias("cut"))
        .select("lang", F.col("cut.part").alias("cut"), (F.col("cut.n") - F.col("cut.upto") + sample).alias("room"))
        .collect()  # a row per language
    )
    schema = "lang string, cut int, room long"
    placed = rows.join(F.broadcast(rows.sparkSession.createDataFrame(cuts, schema)), "lang", "left")
    inside = placed.where(F.col("cut").isNull() | (F.col("part") < F.col("cut")))
    edge = (
        placed.where(F.col("part") == F.col("cut"))
        .withColumn("nth", F.expr("row_number() OVER (PARTITION BY lang ORDER BY h)"))
        .where(F.col("nth") <= F.col("room"))
    )
    return inside.select("text", "lang").union(edge.select("text", "lang"))


def fitted(labelled_docs: DataFrame, sample: int | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model of the labelled rows; None if there are none.

    Counted over all of them, or over `sample` documents per language (:func:`sampled`).
    Each task counts its share in tables of a fixed size, and the sums of those, fixed in
    size as well, go to the driver.
    """
    if sample is not None:
        return _counted(sampled(labelled_docs, sample, id_col, text_col, lang_col))
    text, lang = F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    return _counted(labelled_docs.select(text, lang).where("text IS NOT NULL AND lang IS NOT NULL"))


def _counted(picked: DataFrame) -> Model | None:
    """The model of (text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        scripts: dict[tuple[str, str], int] = {}
        words: dict[str, Counter[bytes]] = {}

        def settle(lang: str) -> None:
            held = [(w, n, s) for w, n in words.pop(lang).items() if (s := script_of(w))]
            if not held:
                return
            hashes, valid, _ = _sequences([w for w, _, _ in held])
            sizes = np.fromiter((len(w) + 1 for w, _, _ in held), np.int64, len(held))
            times = np.repeat(np.fromiter((n for _, n, _ in held), np.int64, len(held)), sizes)
            times = np.broadcast_to(times, hashes.shape)[valid]
            own = tables.setdefault(lang, np.zeros(BUCKETS, np.int64))
            own += np.bincount(hashes[valid], times, BUCKETS).astype(np.int64)
            for _, n, s in held:
                scripts[lang, s] = scripts.get((lang, s), 0) + n

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = words.setdefault(lang, Counter())
                found.update(words_of(text.as_py()))
                if len(found) > _HELD_WORDS:
                    settle(lang)
        for lang in list(words):
            settle(lang)
        for lang, own in tables.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array([""] * len(at)), pa.array(at), pa.array(own[at])],
                ["lang", "script", "bucket", "n"],
            )
        for (lang, s), n in scripts.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([s]), pa.array([-1], pa.int64()), pa.array([n], pa.int64())],
                ["lang", "script", "bucket", "n"],
            )

    sums = (
        picked.mapInArrow(count, "lang string, script string, bucket long, n long")
        .groupBy("lang", "script", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    if sums.empty:
        return None
    languages = sorted(sums["lang"].unique())
    place = sums["lang"].map({lang: i for i, lang in enumerate(languages)}).to_numpy()
    bucket, n = sums["bucket"].to_numpy(), sums["n"].to_numpy()
    counts = np.zeros((len(languages), BUCKETS))
    counts[place[bucket >= 0], bucket[bucket >= 0]] = n[bucket >= 0]
    scripts: dict[str, np.ndarray] = {}
    for i, s, k in zip(place[bucket < 0], sums["script"][bucket < 0], n[bucket < 0], strict=True):
        scripts.setdefault(s, np.zeros(len(languages)))[i] = k
    return Model(languages, counts, scripts)


def identified(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Adds lang_pred, lang_score (0 to 1), lang_spans, lang_evidence and lang_letters to
    every document.

    Spans are runs of words, end excluded. The language is the one whose spans hold
    most letters, the score its share of them; the evidence is what a letter speaks for the
    language of its span, in log odds, on the mean. A text that is null or has no letter
    is `und` with score 0, and so is everything if nothing was labelled; repeated
    rows give repeated results; an empty table gives no rows; only the text is
    looked at. Other columns pass through, those five are replaced.
    """
    plain = docs.drop("lang_pred", "lang_score", "lang_spans", "lang_evidence", "lang_letters")
    at = plain.columns.index(text_col)
    schema = plain.limit(0).selectExpr(
        "*",
        "cast('' AS string) AS lang_pred",
        "cast(0 AS double) AS lang_score",
        "cast(array() AS array<struct<start:int,end:int,lang:string>>) AS lang_spans",
        "cast(0 AS double) AS lang_evidence",
        "cast(0 AS bigint) AS lang_letters",
    ).schema
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    names = [f.name for f in schema]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                texts = batch.column(at).to_pylist()
                found = list(labelled(texts, model)) if model else [(UNDETERMINED, 0.0, [], 0.0, 0)] * len(texts)
                kinds = [pa.string(), pa.float64(), spans, pa.float64(), pa.int64()]
                own = [pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=names)

    return plain.mapInArrow(label, schema)


def in_training(id_col: str = "doc_id", folds: int = 5, held: int = 0):
    """Whether a document is one of those to learn from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds != held


def median(values: DataFrame, name: str) -> float | None:
    """The mean of a column's two middle values; None without any.

    Its range is cut into RANGES that are counted, and the one that holds a middle value
    is cut again, until it is one value. No task and not the driver sees more than counts.
    """
    n, low, high = values.agg(F.count(name), F.min(name), F.max(name)).first()
    if not n:
        return None
    first = _ranked(values, name, (n - 1) // 2, low, high)
    return first if n % 2 else (first + _ranked(values, name, n // 2, low, high)) / 2


def _ranked(values: DataFrame, name: str, place: int, low: float, high: float) -> float:
    """The value with so many before it in ascending order, all between low and high."""
    while low < high:
        x = F.col(name)
        at = F.least(F.floor((x - low) / ((high - low) / RANGES)), F.lit(RANGES - 1))
        inside = values.where(x.between(low, high)).groupBy(at.alias("at"))
        for r in inside.agg(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high")).orderBy("at").collect():
            if place < r["n"]:
                low, high = r["low"], r["high"]
                break
            place -= r["n"]
    return low


def accepted(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """The documents in languages that the labelled ones show, be it one or several.

    A text without letters goes, and so does one of ENOUGH_LETTERS whose letters speak for
    the languages of its spans with less than LEAST_EVIDENCE of what they do in the median
    labelled document: it is in another language, or in none. Shorter texts stay, and
    so do texts that change from one known language to another, as every span is judged by
    its own. Model and median are of all documents to learn from. If nothing was labelled to
    judge them by, all that have letters stay. The columns stay as they are.
    """
    model = fitted(docs.where(in_training(id_col)), None, id_col, text_col, lang_col)
    if model is None:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    names = [f"_{i}" for i in range(len(docs.columns))]
    taught = in_training(id_col) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()
    plain = docs.select("*", taught.alias("taught")).toDF(*names, "_taught")
    found = identified(plain, model, names[docs.columns.index(text_col)])
    found = stored(found.drop("lang_spans"), "judged")
    enough = F.col("lang_letters") >= ENOUGH_LETTERS
    usual = median(found.where(F.col("_taught") & enough), "lang_evidence")
    weak = enough & (F.col("lang_evidence") < LEAST_EVIDENCE * (usual or 0.0))
    return found.where((F.col("lang_pred") != UNDETERMINED) & ~weak).select(*names).toDF(*docs.columns)
