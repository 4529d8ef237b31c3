"""Repetition inside a single document.

A word is repeated if it lies in a run of RUN consecutive words that also
starts at an earlier word of the same text.

Method: log-likelihood ratio of hashed n-grams between two multinomials. Every
word of a text gives one symbol: the bucket of the hash of the n-gram (RUN
words) that starts at it, and whether the word lies in an n-gram whose hash has
already started in this text. The symbols of all documents make the raw corpus,
those of documents that repeat at most TRUSTED of their words the trusted one;
the score of a document is the mean over its words of log(trusted / raw). A text
that says things again scores low, however common its words are elsewhere.

``repetitive`` holds every document against one threshold. It is the highest
score a document with the wanted share can have under the fitted weights, so no
such document is lost; of the documents below it, the exact share (runs compared
word by word) decides.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadlake.llm.tokens import LONG_TEXT, text_batches
from quadlake.session import ship

#: Words of a run, and the share from which a document counts as repetitive.
RUN, SHARE = 8, 0.5
#: Share of repeated words up to which a document is of the trusted corpus.
TRUSTED = 0.1
#: Buckets of hashed n-grams, and the words that each multinomial holds before
#: it sees a document, spread evenly over the buckets.
BUCKETS, PRIOR = 256, 100_000
#: Share of repeated words in the prior of the trusted and of the raw corpus.
PRIOR_TRUSTED, PRIOR_RAW = 0.01, 0.25
#: Distinct words a worker numbers before it starts again.
WORDS = 500_000
_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    """Word to number, in order of first sight, and the hash of every word,
    which is the same in every worker."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes = array("Q")

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return n


def _numbered(text: str, number: Callable[[str], int]) -> np.ndarray:
    if len(text) <= LONG_TEXT:
        return np.fromiter(map(number, _WORD.findall(text)), np.int64)
    return np.fromiter((number(m[0]) for m in _WORD.finditer(text)), np.int64)  # not all words at once


class _Runs:
    """The runs of words of a batch of texts.

    words: numbers of all words; text: the text of each; sizes: words of each
    text; code: hash of the run that starts at each word; later and first: runs
    whose hash has started before in the same text, and the first such start.
    """

    def __init__(self, texts: list[str | None], run: int, numbers: _Numbers | None = None):
        numbers = _Numbers() if numbers is None else numbers
        each = [_numbered(t or "", numbers.__getitem__) for t in texts]
        self.run = run
        self.sizes = np.fromiter(map(len, each), np.int64, len(each))
        self.words = np.concatenate(each) if each else np.zeros(0, np.int64)
        self.text = np.repeat(np.arange(len(texts)), self.sizes)
        self.code = np.zeros(0, np.uint64)
        self.later = self.first = np.zeros(0, np.int64)
        last = len(self.words) - run + 1
        if last < 1:
            return
        inside = np.flatnonzero(self.text[:last] == self.text[run - 1 :])
        hashes = np.frombuffer(numbers.hashes, np.uint64)[self.words]
        code = np.zeros(last, np.uint64)
        for k in range(run):
            code = code * _BASE + hashes[k : k + last]
        self.code = code ^ (code >> np.uint64(29))
        own = ((self.code * _BASE + self.text[:last].astype(np.uint64)) * _BASE)[inside]
        order = np.argsort(own, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = own[order][1:] != own[order][:-1]
        first = inside[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else inside
        self.later, self.first = inside[order][~new], first[~new]

    def covered(self, starts: np.ndarray) -> np.ndarray:
        """Which words lie in a run that starts at one of starts."""
        edge = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + self.run, -1)
        return np.cumsum(edge)[:-1] > 0

    def exact(self, wanted: np.ndarray | None = None) -> np.ndarray:
        """Number of repeated words of the wanted texts (all by default), every
        run compared word by word: hashes decide nothing."""
        later, first, text = self.later, self.first, self.text
        if wanted is not None:
            keep = wanted[text[later]]
            later, first = later[keep], first[keep]
        same = text[later] == text[first]
        for k in range(self.run):
            same &= self.words[later + k] == self.words[first + k]
        starts = later[same]
        for t in np.unique(text[later[~same]]):  # a hash collision: decide this text by its words
            starts = np.concatenate([starts[text[starts] != t], _starts(self.words, np.flatnonzero(text == t), self.run)])
        return np.bincount(text[self.covered(starts)], minlength=len(self.sizes))

    def symbols(self) -> tuple[np.ndarray, np.ndarray]:
        """The symbol of every word of a text of at least run words, below
        2 * BUCKETS (from BUCKETS on: said before), and its text. The last words
        of a text take the run that ends it."""
        ends = np.cumsum(self.sizes)
        start = np.minimum(np.arange(len(self.words)), (ends - self.run)[self.text])
        has = (self.sizes >= self.run)[self.text]
        bucket = (self.code[start[has]] >> np.uint64(40)).astype(np.int64) % BUCKETS
        return bucket + BUCKETS * self.covered(self.later)[has], self.text[has]


def _starts(words: np.ndarray, at: np.ndarray, run: int) -> np.ndarray:
    seen, out = set(), []
    for i in at[: len(at) - run + 1]:
        key = tuple(words[i : i + run])
        if key in seen:
            out.append(i)
        seen.add(key)
    return np.array(out, np.int64)


def repeated_words(texts: list[str | None], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Number of words and of repeated words of every text."""
    runs = _Runs(texts, run)
    return runs.sizes, runs.exact()


# --------------------------------------------------------------------- the ratio
@dataclass(frozen=True)
class Ratio:
    """log(trusted / raw) of each of the 2 * BUCKETS symbols."""

    weights: tuple[float, ...]

    def threshold(self, share: float) -> float:
        """The highest score of a text of which at least share is said before:
        with w1 and w0 the largest weights of symbols said before and not, it is
        share * w1 + (1 - share) * w0 (or w1, if that is the larger)."""
        fresh, again = max(self.weights[:BUCKETS]), max(self.weights[BUCKETS:])
        return share * again + (1 - share) * max(fresh, again) + 1e-9

    def middle(self, share: float) -> float:
        """The score of a text of average symbols of which share is said before."""
        w = np.array(self.weights)
        return float(share * w[BUCKETS:].mean() + (1 - share) * w[:BUCKETS].mean())

    def scores(self, runs: _Runs) -> np.ndarray:
        """Mean weight of the words of each text; NaN for texts shorter than a run."""
        symbol, text = runs.symbols()
        sums = np.bincount(text, weights=np.array(self.weights)[symbol], minlength=len(runs.sizes))
        return np.where(runs.sizes >= runs.run, sums / np.maximum(runs.sizes, 1), np.nan)


def ratio_of(trusted: np.ndarray, raw: np.ndarray) -> Ratio:
    """The ratio of two corpora from their numbers of each symbol."""

    def shares(counts: np.ndarray, prior: float) -> np.ndarray:
        held = PRIOR / BUCKETS * np.repeat([1 - prior, prior], BUCKETS)
        return (counts + held) / (counts.sum() + PRIOR)

    return Ratio(tuple(np.log(shares(trusted, PRIOR_TRUSTED) / shares(raw, PRIOR_RAW)).tolist()))


def _workers_runs(batches: Iterable[pa.RecordBatch], column: int, run: int) -> Iterator[tuple[pa.RecordBatch, _Runs]]:
    numbers = _Numbers()
    for batch in text_batches(batches, column):
        if len(numbers) > WORDS:
            numbers = _Numbers()
        yield batch, _Runs(batch.column(column).to_pylist(), run, numbers)


def fit_ratio(df: DataFrame, text_column: str = "text", run: int = RUN, trusted: float = TRUSTED) -> Ratio:
    """Fitted on every document of df. Each task counts its own symbols; only
    2 * BUCKETS pairs of numbers reach the driver. The counts are whole numbers,
    so the result does not depend on how the rows lie."""
    ship(df.sparkSession)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_trusted, of_all = np.zeros(2 * BUCKETS, np.int64), np.zeros(2 * BUCKETS, np.int64)
        for _, runs in _workers_runs(batches, 0, run):
            symbol, text = runs.symbols()
            again = np.bincount(text[symbol >= BUCKETS], minlength=len(runs.sizes))
            calm = again <= trusted * runs.sizes
            of_all += np.bincount(symbol, minlength=2 * BUCKETS)
            of_trusted += np.bincount(symbol[calm[text]], minlength=2 * BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(range(2 * BUCKETS), pa.int32()), pa.array(of_trusted), pa.array(of_all)], names=["symbol", "trusted", "raw"])

    counted = df.select(df[text_column]).mapInArrow(count, "symbol int, trusted bigint, raw bigint")
    rows = counted.groupBy("symbol").agg(F.sum("trusted").alias("trusted"), F.sum("raw").alias("raw")).collect()
    sums = np.zeros((2, 2 * BUCKETS))
    for r in rows:
        sums[:, r.symbol] = r.trusted, r.raw
    return ratio_of(*sums)


def _measured(df: DataFrame, id_column: str, text_column: str, run: int, columns: str, measure: Callable[[_Runs], list[pa.Array]]) -> DataFrame:
    """id_column and what measure gives for every text. No shuffle."""
    ship(df.sparkSession)
    rows = df.select(df[id_column], df[text_column])
    schema = T.StructType([T.StructField(id_column, rows.schema[0].dataType), *T.StructType.fromDDL(columns)])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, runs in _workers_runs(batches, 1, run):
            yield pa.RecordBatch.from_arrays([batch.column(0), *measure(runs)], names=schema.names)

    return rows.mapInArrow(work, schema)


def repetition(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", run: int = RUN) -> DataFrame:
    """id_column, n_words, n_repeated and share (n_repeated / n_words).

    A null or empty text, and one without words, has no words and share null;
    fewer than run + 1 words repeat nothing. Texts are read whole, however long.
    Equal rows give equal rows. Empty input gives no rows. No shuffle.
    """
    out = _measured(df, id_column, text_column, run, "n_words bigint, n_repeated bigint", lambda runs: [pa.array(runs.sizes), pa.array(runs.exact())])
    return out.withColumn("share", F.when(F.col("n_words") > 0, F.col("n_repeated") / F.col("n_words")))


def scores(df: DataFrame, ratio: Ratio, id_column: str = "doc_id", text_column: str = "text", run: int = RUN) -> DataFrame:
    """id_column, n_words and score, the length-normalised log-likelihood ratio
    of every document; null for texts shorter than a run."""
    return _measured(df, id_column, text_column, run, "n_words bigint, score double", lambda runs: [pa.array(runs.sizes), pa.array(ratio.scores(runs), from_pandas=True)])


def repetitive(df: DataFrame, share: float = SHARE, id_column: str = "doc_id", text_column: str = "text", run: int = RUN, ratio: Ratio | None = None) -> DataFrame:
    """id_column, score and share of the documents at least share of whose words
    are repeated: those whose score is at most the threshold, and whose exact
    share, which is measured for these alone, is large enough.

    ratio: by default fitted on df itself, which reads the texts twice. Nulls,
    short texts and equal rows as in ``repetition``.
    """
    ratio = fit_ratio(df, text_column, run) if ratio is None else ratio
    limit = ratio.threshold(share)

    def measure(runs: _Runs) -> list[pa.Array]:
        score = ratio.scores(runs)
        near = score <= limit
        return [pa.array(score, from_pandas=True), pa.array(np.where(near, runs.exact(near) / np.maximum(runs.sizes, 1), np.nan), from_pandas=True)]

    return _measured(df, id_column, text_column, run, "score double, share double", measure).where(F.col("share") >= share)
