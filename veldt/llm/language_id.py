"""Language identification: scripts narrow the candidates, Viterbi over per-word scores labels the spans.

A word is a run of letters. Character n-grams of the words give it a log score in each learned language. The scripts of its
letters (ranges of code points) rule languages out that the training texts never or hardly write in that script. A path
through the words of a text then collects the scores and pays a penalty for each switch; the best path labels spans of
mixed-language text. The language with most letters in its spans is the text's language.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldt.llm.common import slices, text_once

#: Training takes about so many labelled documents of each language at most, chosen by a hash of the key.
TRAIN_DOCS = 2000
#: N-grams are hashed to so many counters for each language.
BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
SMOOTHING = 0.5
#: What a switch of language costs, in nats.
SWITCH = 12.0
#: A language is a candidate for a script from this share of the language's letters on.
SCRIPT_SHARE = 0.005
FOLDS = 5
UNKNOWN = "und"
#: A worker keeps the scores of words of so many letters together, and of as many that it met before; it scores new words by so many letters.
KEPT_LETTERS = 600_000
COUNTED_WORDS = 100_000
LETTERS_AT_ONCE = 100_000

WORD = re.compile(r"[^\W\d_]+")

# fixed values: first code points of script ranges of the Unicode standard, and the script from there on
SCRIPT_STARTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "other"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "other"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
)
_STARTS = np.array([a for a, _ in SCRIPT_STARTS])
SCRIPTS = tuple(dict.fromkeys(s for _, s in SCRIPT_STARTS))
_SCRIPT = np.array([SCRIPTS.index(s) for _, s in SCRIPT_STARTS])


def letters_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words, each with a boundary mark 0 before and after; length of each word)."""
    flat = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return flat, np.fromiter(map(len, words), np.int64, len(words))


def scripts_of(points: np.ndarray) -> np.ndarray:
    return _SCRIPT[np.searchsorted(_STARTS, points, side="right") - 1]


def ngrams(flat: np.ndarray, lengths: np.ndarray, at_once: int = LETTERS_AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of (bucket of an n-gram, number of its word) for every order. Boundary marks count from order 2 on."""
    starts = np.cumsum(lengths + 1) - lengths  # where each word's letters begin
    for begin in range(0, len(flat), at_once):
        points = flat[begin : begin + at_once + max(ORDERS) - 1]
        inner, mixed = points != 0, points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for n in ORDERS:
            size = min(at_once, len(points) - n + 1)
            if size < 1:
                continue
            h = np.full(size, n, np.uint64)
            for k in range(n):
                h = (h ^ mixed[k : size + k]) * np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(31)
            # an n-gram lies in one word if no mark is inside it, whatever its ends
            ok = np.ones(size, bool)
            for k in range(n) if n == 1 else range(1, n - 1):
                ok &= inner[k : size + k]
            if n > 1:
                ok &= inner[:size] | inner[n - 1 : size + n - 1]
            at = np.flatnonzero(ok)
            # a mark in front of a word belongs to that word
            yield (h[at] % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(starts - 1, begin + at + ~inner[at], side="right") - 1


def word_scripts(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The script that most letters of each word are written in; of equal ones the first in SCRIPTS."""
    if int(flat.max(initial=0)) < SCRIPT_STARTS[1][0]:
        return np.zeros(len(lengths), np.int64)
    word = np.repeat(np.arange(len(lengths)), lengths)
    found = np.bincount(word * len(SCRIPTS) + scripts_of(flat[flat != 0]), minlength=len(lengths) * len(SCRIPTS))
    return found.reshape(len(lengths), len(SCRIPTS)).argmax(axis=1)


class Model:
    """Log scores by n-gram bucket and the scripts each language is written in."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        counts = counts + SMOOTHING
        self.log = np.log(counts / counts.sum(axis=1, keepdims=True)).T.astype(np.float32) if langs else np.zeros((BUCKETS, 0), np.float32)
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        self.written = share >= SCRIPT_SHARE

    def score(self, words: list[str]) -> np.ndarray:
        """(words, languages): mean log score over the n-grams of a word times its length, candidates only."""
        flat, lengths = letters_of(words)
        total, seen = np.zeros((len(words), len(self.langs))), np.zeros(len(words))
        for bucket, word in ngrams(flat, lengths):
            seen += np.bincount(word, minlength=len(words))
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(word, weights=self.log[bucket, k], minlength=len(words))
        out = total / np.maximum(seen, 1)[:, None] * np.sqrt(lengths)[:, None] * 2
        possible = self.written[:, word_scripts(flat, lengths)].T
        possible |= ~possible.any(axis=1, keepdims=True)
        out -= np.where(possible, out, -np.inf).max(axis=1, keepdims=True)
        return np.where(possible, np.maximum(out, -30.0), -30.0)


def best_path(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Labels of the path with the largest sum of scores less ``switch`` for each change of label.

    Of one-label paths that are best the first label is taken. No path beats the best one-label path (the base) if no
    stretch of words gains more than ``switch`` by leaving the base, and no first stretch together with no last stretch
    does: m stretches away from the base cost m changes at least, or m - 1 if nothing of the base is left, and then one
    of them is first and one is last. Sums over prefixes show it without a loop. Otherwise the usual recursion runs.
    """
    n, k = scores.shape
    if n == 0 or k == 1:
        return np.zeros(n, np.int64)
    base = int(scores.sum(0).argmax())
    gain = np.cumsum(scores - scores[:, base : base + 1], axis=0)
    before = np.vstack([np.zeros((1, k)), gain[:-1]])
    if (gain - np.minimum.accumulate(before, axis=0)).max() <= switch and gain.max() + (gain[-1] - before).max() <= switch:
        return np.full(n, base)
    # a few labels: plain lists are faster than arrays here
    rows = scores.tolist()
    value, back = rows[0], []
    for row in rows[1:]:
        top = max(value)
        floor = top - switch
        if min(value) >= floor:
            back.append(None)
            value = [v + x for v, x in zip(value, row)]
        else:
            back.append((value.index(top), [v < floor for v in value]))
            value = [(v if v >= floor else floor) + x for v, x in zip(value, row)]
    now = value.index(max(value))
    path = [now]
    for step in reversed(back):
        if step is not None and step[1][now]:
            now = step[0]
        path.append(now)
    return np.array(path[::-1], np.int64)


def held_out(key: str):
    """Column: whether crc32 of the key as text is 0 modulo FOLDS. A null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """The model of the documents that have a language and a text and are not held out.

    About TRAIN_DOCS of each language are taken, by a hash of the key, whole texts. Tasks count words and turn them into
    n-gram counters of fixed size; the driver gets the summed counters, whose size is set by the number of languages.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), held_out(key).alias("held"))
    rows = rows.where("NOT held AND lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, BUCKETS)), np.zeros((0, len(SCRIPTS))))
    keep = F.lit(False)
    unit = F.shiftrightunsigned(F.xxhash64("key", F.lit("train")), 11).cast("double") / float(1 << 53)
    for name in langs:
        keep |= (F.col("lang") == name) & (unit < min(1.0, TRAIN_DOCS / sizes[name]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros((len(langs), BUCKETS), np.int64)
        scripts = np.zeros((len(langs), len(SCRIPTS)), np.int64)
        words: dict[str, Counter[str]] = {name: Counter() for name in langs}

        def add() -> None:
            for k, name in enumerate(langs):
                if words[name]:
                    flat, lengths = letters_of(list(words[name]))
                    n = np.fromiter(words[name].values(), np.float64, len(words[name]))
                    for bucket, word in ngrams(flat, lengths):
                        grams[k] += np.bincount(bucket, weights=n[word], minlength=BUCKETS).astype(np.int64)
                    scripts[k] += np.bincount(scripts_of(flat[flat != 0]), weights=np.repeat(n, lengths), minlength=len(SCRIPTS)).astype(np.int64)
                    words[name].clear()

        for batch in batches:
            for t, name in zip(batch.column(0), batch.column(1).to_pylist()):
                words[name].update(WORD.findall(t.as_py().lower()))
                if sum(map(len, words.values())) > COUNTED_WORDS:
                    add()
        add()
        for k in range(len(langs)):
            for table, column in enumerate((grams[k], scripts[k])):
                at = np.flatnonzero(column)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), k, np.int32)), pa.array(np.full(len(at), table, np.int32)), pa.array(at.astype(np.int32)), pa.array(column[at])], ["k", "part", "at", "n"]
                )

    counted = rows.where(keep).select("text", "lang").mapInArrow(count, "k int, part int, at int, n long")
    found: pd.DataFrame = counted.groupBy("k", "part", "at").agg(F.sum("n").alias("n")).toPandas()
    tables = np.zeros((len(langs), BUCKETS)), np.zeros((len(langs), len(SCRIPTS)))
    for part, table in enumerate(tables):
        own = found[found["part"] == part]
        table[own["k"].to_numpy(int), own["at"].to_numpy(int)] = own["n"].to_numpy()
    return Model(langs, *tables)


class Labeller:
    """Labels texts; keeps the scores of words it has met, up to a bound."""

    def __init__(self, model: Model):
        self.model, self.row, self.letters, self.scores = model, {}, 0, np.zeros((1024, len(model.langs)), np.float32)
        self.old = {}, self.scores

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, language) in code points: stretches of words with one label, from the first letter to the last."""
        found = list(WORD.finditer(text or ""))
        if not found or not self.model.langs:
            return []
        words = [m.group().lower() for m in found]
        self.learn([words])
        path = best_path(self._of(words))
        edges = np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1]))).tolist()
        return [(found[a].start(), found[b - 1].end(), self.model.langs[path[a]]) for a, b in zip(edges, [*edges[1:], len(found)])]

    def labels(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text: the language with most letters and their share of all letters; ties go to the first name."""
        split = [WORD.findall((t or "").lower()) for t in texts]
        self.learn(split)
        return [self._label(words) for words in split]

    def _label(self, words: list[str]) -> tuple[str, float]:
        # \w also holds numbers such as one half, which are no letters
        if not self.model.langs or not any(c.isalpha() for w in words for c in w):
            return UNKNOWN, 0.0
        path = best_path(self._of(words))
        first = int(path[0])
        if (path == first).all():
            return self.model.langs[first], 1.0
        letters = np.bincount(path, weights=np.fromiter(map(len, words), float, len(words)), minlength=len(self.model.langs))
        best = int(letters.argmax())
        return self.model.langs[best], float(letters[best] / letters.sum())

    def learn(self, split: list[list[str]]) -> None:
        """Score the words that are not kept yet, together. The table starts anew where it would pass its bound."""
        if not self.model.langs:
            return
        words = set().union(*split)
        new = words.difference(self.row)
        if self.letters + sum(map(len, new)) > KEPT_LETTERS:  # the words of late become the old ones
            self.old, self.row, self.letters, self.scores, new = (self.row, self.scores), {}, 0, self.scores[:0], words
        if not new:
            return
        self.letters += sum(map(len, new))
        n = len(self.row)
        if n + len(new) > len(self.scores):
            grown = np.zeros((max(n + len(new), 2 * n), self.scores.shape[1]), np.float32)
            grown[:n] = self.scores[:n]
            self.scores = grown
        row, scores = self.old
        known = [w for w in new if w in row]
        unknown = list(new.difference(row))
        self.row.update(zip(known + unknown, range(n, n + len(new))))
        self.scores[n : n + len(known)] = scores[[row[w] for w in known]]
        n += len(known)
        part = np.cumsum([len(w) for w in unknown]) // LETTERS_AT_ONCE
        edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(unknown)]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                self.scores[n + a : n + b] = self.model.score(unknown[a:b])

    def _of(self, words: list[str]) -> np.ndarray:
        return self.scores[np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))].astype(float)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred (string) and score (double, 0 to 1) added; columns of these names are replaced.

    Predictions see the whole text and nothing else. A null text, or one without a letter, is ``und`` with score 0; so is
    every text if no language was learned. Rows are independent, so repeated rows, null keys and empty tables need no care.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # size: languages times BUCKETS
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows, at = text_once(docs, keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in slices(batches, at):
            found = labeller.labels(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], [*keep, "lang_pred", "score"]
            )

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
