"""Toxicity: every passage whose words' log-odds add up to more than chance explains, and one calibrated score a document.

Words are runs of letters in lower case. The toxic share of a word starts from that of its prefix, which starts from that of the
next shorter one, down to two letters and then to all words: each is a Beta (two-class Dirichlet) posterior whose prior has the mean
of its parent and the weight PRIOR. So a rare or new word counts as its stem does. Its score is the log-odds against all words less
DRIFT; neutral words therefore cost a little, and sums of scores are local alignments of a text with toxicity. Repeats of a word are
little evidence: in its m-th place of a text a word of positive log-odds has the m-th part of them.

A linear scan finds all maximal segments of a text (Ruzzo and Tompa). Of the best segment of a clean text of n words the chance to
pass S is 1 - exp(-K n e^(-lambda S)); lambda and K are fitted to clean texts that no word was counted on. A segment is a toxic passage
if fewer than CHANCE such are expected in the text; the passages' excesses over chance, in nats, are added and put on the
scale of a probability by a logistic curve of two parameters.

The classifier is fitted on a bounded sample of labelled rows: about TRAIN_DOCS documents of each class, by a hash of the id, whole
texts; near copies among them (equal in two minima over hashed runs of five words) count once. All documents are scored, whole.
Null and empty texts have no passage and get the score of a text without one. Without both labels all scores are the share of toxic labels
(0 without labels). Scores see nothing but the text, so repeated rows, null ids and other columns need no care. An empty table gives none.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldt.llm.common import slices, stored, text_once

FOLDS = 5
TRAIN_DOCS = 20_000
#: One of so many groups of near copies is kept for the calibration.
CALIBRATION = 4
WORD = re.compile(r"[^\W\d_]+")
#: Prefixes of these lengths that are shorter than the word are its stems.
SHORTEST, LONGEST = 2, 8
PRIOR, DRIFT, CHANCE = 5.0, 0.3, 0.5
#: Fewer toxic documents than this don't make a word or stem toxic.
SUPPORT = 2
#: A word or stem is left out of the model if its score is that of its parent, this close.
CLOSE = 0.02
#: Scores of words kept by a task, in letters.
KEPT_LETTERS = 4 << 20
RUN = 5


def parent_of(node: str) -> str:
    """The stem a node starts from: ``-`` ends stems, ``$`` whole words; "" is all words."""
    length = min(LONGEST, len(node) - 2)
    return node[:length] + "-" if length >= SHORTEST else ""


@dataclass
class Model:
    #: Log-odds of words and stems; those that aren't listed have their nearest stem's, and 0 without one.
    odds: dict[str, float]
    scale: float = 1.0
    k: float = 1.0
    base: float = 0.0
    slope: float = 0.0
    #: The score of every text, if there was nothing to learn from.
    fixed: float | None = None

    def word(self, word: str) -> float:
        found = self.odds.get(word + "$")
        if found is None:
            for n in range(min(LONGEST, len(word) - 1), SHORTEST - 1, -1):
                found = self.odds.get(word[:n] + "-")
                if found is not None:
                    break
        return (found or 0.0) - DRIFT

    def excess(self, scores: np.ndarray, n: int) -> np.ndarray:
        """What each segment of a text of ``n`` words has above chance, in nats; toxic passages are those above -log CHANCE."""
        return self.scale * scores - max(0.0, np.log(self.k * max(n, 1)))

    def probability(self, excess: float) -> float:
        return self.fixed if self.fixed is not None else float(1 / (1 + np.exp(-(self.base + self.slope * np.log1p(excess)))))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(first, end, sum) of all maximal scoring segments, by position, in linear time.

    A candidate holds the sums before and up to its end. A new one looks back for the last candidate that starts lower; if that
    one ends lower too, the two and all between become one, which looks back again. Candidates that don't start lower are
    jumped over by a pointer, so each is passed once.
    """
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    found: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum at the end, last candidate that starts lower
    for at in np.flatnonzero(scores > 0).tolist():
        first, end, before, up = at, at + 1, float(sums[at]), float(sums[at + 1])
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= up:
                found.append((first, end, before, up, j))
                break
            first, before, j = found[j][0], found[j][2], found[j][4]
            del found[_place(found, first) :]
    return [(f, e, u - b) for f, e, b, u, _ in found]


def _place(found: list, first: int) -> int:
    """Where the candidate that starts at ``first`` lies; candidates are in order of their starts."""
    low, high = 0, len(found)
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if found[middle][0] < first else (low, middle)
    return low


class Scorer:
    """Scores texts; keeps the scores of words it has met, up to a bound."""

    def __init__(self, model: Model):
        self.model, self.known, self.letters = model, {}, 0

    def segments(self, texts: list[str | None]) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
        """(words, maximal segments) of each text."""
        split = [WORD.findall(t.lower()) if t else [] for t in texts]
        new = set().union(*split).difference(self.known) if split else set()
        self.letters += sum(map(len, new))
        if self.letters > KEPT_LETTERS:
            self.known = {}
            new = set().union(*split)
            self.letters = sum(map(len, new))
        self.known.update((w, self.model.word(w)) for w in new)
        for words in split:
            scores = np.fromiter(map(self.known.__getitem__, words), float, len(words))
            met: dict[str, int] = {}
            for at in np.flatnonzero(scores > 0).tolist():
                met[words[at]] = times = met.get(words[at], 0) + 1
                scores[at] = (scores[at] + DRIFT) / times - DRIFT
            yield len(words), maximal_segments(scores)

    def judged(self, texts: list[str | None]) -> Iterator[tuple[float, list[tuple[int, int, float]]]]:
        """(score, toxic passages as first word, end and excess) of each text."""
        for n, found in self.segments(texts):
            over = self.model.excess(np.array([s for _, _, s in found]), n)
            toxic = [(f, e, float(x)) for (f, e, _), x in zip(found, over) if x > -np.log(CHANCE)]
            yield self.model.probability(sum(x for _, _, x in toxic)), toxic


def sketch(words: list[str]) -> int:
    """Two minima over hashed runs of five words in one number: near copies mostly share it, other texts don't."""
    codes = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)
    runs = np.zeros(max(1, len(codes) - RUN + 1), np.uint64)
    for k in range(min(RUN, len(codes))):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + len(runs)]
    ends = []
    for odd in (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)):
        mixed = (runs ^ (runs >> np.uint64(29))) * odd
        ends.append(int((mixed ^ (mixed >> np.uint64(32))).min()))
    return zlib.crc32(f"{ends[0]}:{ends[1]}".encode()) << 31 | ends[0] >> 33


def held_out(key: str):
    """Column: whether crc32 of the key as text is 0 modulo FOLDS. A null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def node_scores(counts: pd.DataFrame, toxic: float, clean: float) -> dict[str, float]:
    """Log-odds of nodes from their counts (node, a, b) and those of all words.

    On the way down to a node each stem adds only the words that the next one on the way doesn't hold, so nothing counts twice.
    """
    of = {node: (a, b) for node, a, b in counts.itertuples(index=False)}
    root = toxic / (toxic + clean)
    odds = {}
    for node, (a, b) in of.items():
        way, up = [(a, b), (0, 0)], parent_of(node)
        while up:
            way[-1:] = [of.get(up, way[-2]), (0, 0)]
            up = parent_of(up)
        share = root
        for (more_a, more_b), (less_a, less_b) in zip(way[-2::-1], [*way[-3::-1], (0, 0)]):
            share = (more_a - less_a + PRIOR * share) / (more_a - less_a + more_b - less_b + PRIOR)
        odds[node] = float(np.log(share / (1 - share)) - np.log(root / (1 - root)))
    return odds


def pruned(odds: dict[str, float]) -> dict[str, float]:
    """Nodes without those that score as what is found in their place."""
    kept: dict[str, float] = {}
    for node in sorted(odds, key=lambda n: (n[-1] == "$", len(n))):
        up = parent_of(node)
        while up and up not in kept:
            up = parent_of(up)
        if abs(odds[node] - kept.get(up, 0.0)) > CLOSE:
            kept[node] = odds[node]
    return kept


def extremes(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """(lambda, K) of greatest likelihood for the best scores of clean texts of ``n`` words, lambda between 0.05 and 5."""
    low, high = 0.05, 5.0
    if not len(best):
        return 1.0, 1.0
    for _ in range(60):  # the slope of the likelihood falls with lambda
        scale = (low + high) / 2
        weight = n * np.exp(-scale * best)
        slope = 1 / scale - best.mean() + (weight * best).sum() / weight.sum()
        low, high = (scale, high) if slope > 0 else (low, scale)
    return low, len(best) / float((n * np.exp(-low * best)).sum())


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.02) -> tuple[float, float]:
    """(base, slope) of a weighted logistic curve by Newton's steps; the ridge keeps it finite where classes part."""
    beta, design = np.zeros(2), np.stack([np.ones(len(x)), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weight * (y - p)) - ridge * beta
        bend = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(bend, slope)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """The model of the labelled documents that aren't held out. An id with both labels isn't used."""
    told = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("toxic"), held_out(key).alias("held")).where("NOT held AND key IS NOT NULL AND toxic IN (0, 1)")
    told = told.groupBy("key").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    sizes = {r["toxic"]: r["count"] for r in told.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Model({}, fixed=float(max(sizes, default=0)))
    unit = F.shiftrightunsigned(F.xxhash64("key", F.lit("toxicity")), 11).cast("double") / float(1 << 53)
    drawn = told.where(unit < F.when(F.col("toxic") == 1, min(1.0, TRAIN_DOCS / sizes[1])).otherwise(min(1.0, TRAIN_DOCS / sizes[0])))
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL").join(F.broadcast(drawn), "key").select("text", "toxic")

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            texts, out = batch.column(0).to_pylist(), []
            for t in texts:
                words = WORD.findall(t.lower())
                near = sketch(words)
                kept = near % CALIBRATION == 0
                out.append((near, zlib.crc32(t.encode("utf-8", "surrogatepass")), t if kept else None, None if kept else list(dict.fromkeys(words))))
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.list_(pa.string())), batch.column(1)], ["near", "h", "text", "words", "toxic"]
            )

    read = rows.mapInArrow(sketched, "near long, h long, text string, words array<string>, toxic int")
    once = stored(read.groupBy("near", "toxic").agg(F.min_by(F.struct("text", "words"), F.struct("h", F.coalesce("text", F.lit("")))).alias("one")).select("toxic", "one.*"), "labelled")
    words = once.where("words IS NOT NULL").select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    stems = F.transform(F.sequence(F.lit(SHORTEST), F.lit(LONGEST)), lambda n: F.when(n < F.length("word"), F.concat(F.substring("word", F.lit(1), n), F.lit("-"))))
    named = words.select(F.explode(F.array_append(F.filter(stems, lambda s: s.isNotNull()), F.concat("word", F.lit("$")))).alias("node"), "a", "b")
    nodes = stored(named.groupBy("node").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "nodes")
    totals = words.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    if not totals["a"] or not totals["b"]:
        return Model({}, fixed=sizes[1] / (sizes[0] + sizes[1]))
    frequent = nodes.where(F.col("a") >= SUPPORT).toPandas()  # what at least SUPPORT of the sample's toxic documents hold
    odds = node_scores(frequent, totals["a"], totals["b"])
    # words and stems with fewer toxic documents matter only below a stem that looks toxic
    up = docs.sparkSession.createDataFrame([(n,) for n, v in odds.items() if v > DRIFT and n[-1] == "-"], "up string")
    length = F.least(F.lit(LONGEST), F.length("node") - 2)
    below = nodes.where(F.col("a") < SUPPORT).withColumn("up", F.concat(F.substring("node", F.lit(1), length), F.lit("-")))
    rare = below.join(F.broadcast(up), "up", "left_semi").select("node", "a", "b").toPandas()
    model = Model(pruned(node_scores(pd.concat([frequent, rare]), totals["a"], totals["b"])))
    return calibrated(model, once.where("text IS NOT NULL").select("text", "toxic"), sizes)


def calibrated(model: Model, rows: DataFrame, sizes: dict[int, int]) -> Model:
    """The model with lambda, K and the logistic curve fitted to rows (text, toxic) it hasn't seen; classes weigh as in ``sizes``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches, 0):
            found = list(scorer.segments(batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([n for n, _ in found], pa.int64()), pa.array([[s for _, _, s in f] for _, f in found], pa.list_(pa.float64()))], ["toxic", "n", "scores"])

    seen = rows.mapInArrow(measured, "toxic int, n long, scores array<double>").toPandas().sort_values(["toxic", "n"], kind="stable")
    clean = seen[seen["toxic"] == 0]
    best = np.array([max(s, default=0.0) for s in clean["scores"]])
    model.scale, model.k = extremes(best, np.maximum(clean["n"].to_numpy(float), 1.0))
    x = []
    for n, scores in zip(seen["n"], seen["scores"]):
        over = model.excess(np.asarray(scores, float), n)
        x.append(np.log1p(over[over > -np.log(CHANCE)].sum()))
    y = seen["toxic"].to_numpy(float)
    both = sizes[0] + sizes[1]
    if len(set(y)) < 2:
        model.base, model.slope = float(np.log(sizes[1] / sizes[0])), 1.0
        return model
    weight = np.where(y == 1, sizes[1] / both / y.mean(), sizes[0] / both / (1 - y.mean()))
    model.base, model.slope = logistic(np.array(x), y, weight)
    return model


def find(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with toxic_score (double, 0 to 1) and toxic_passages added: start and end in code points and the excess of each, by position.

    Columns of these names are replaced. Passages go from the first to the last letter of their words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # words and stems of the sample that score unlike their parents
    keep = [c for c in docs.columns if c not in ("toxic_score", "toxic_passages")]
    rows, at = text_once(docs, keep, text)
    passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("excess", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches, at):
            texts, scores, spans = batch.column(at).to_pylist(), [], []
            for t, (score, toxic) in zip(texts, scorer.judged(texts)):
                scores.append(score)
                spans.append(_placed(t, toxic) if toxic else [])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores, pa.float64()), pa.array(spans, passage)], [*keep, "toxic_score", "toxic_passages"])

    schema = T.StructType([*(docs.schema[c] for c in keep), *T.StructType.fromDDL("toxic_score double, toxic_passages array<struct<start: int, end: int, excess: double>>")])
    return rows.mapInArrow(run, schema)


def _placed(text: str, toxic: list[tuple[int, int, float]]) -> list[dict]:
    """Passages by letters. Lower case may change the length of a text, so words are looked up in the text as it is."""
    words = [m.span() for m in WORD.finditer(text)]
    lower = text.lower()
    if len(lower) != len(text):  # each letter's lower case is as long as it was or longer
        starts = np.cumsum([0] + [len(c.lower()) for c in text])
        words = [(int(np.searchsorted(starts, m.start(), "right")) - 1, int(np.searchsorted(starts, m.end(), "left"))) for m in WORD.finditer(lower)]
    return [{"start": words[f][0], "end": words[e - 1][1], "excess": x} for f, e, x in toxic]


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = find(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))
