"""Quality classifier: a linear model over n-gram indicators scaled by Naive Bayes log-count ratios.

A text's n-grams are single words and pairs of words, and single, paired and tripled word shapes (a
run of punctuation is its own shape; a word has case and whether it repeats the word before).
Each is an indicator in one of 2^BITS cells, scaled by the log ratio of its smoothed frequencies in the
two classes; a row has unit length. The hinge loss is minimised by dual coordinate descent (Hsieh et
al. 2008), the weights are drawn towards their mean size (Wang and Manning 2012), and a logistic curve,
fitted on rows that the weights have not seen, turns margins into scores.

The model is fitted on a sample of about FIT_ROWS labelled documents, picked by a hash of doc_id, or fewer in
order of that hash if they have over FIT_CELLS cells in all; long documents are as likely in it as short ones; those of the held-out fold (crc32 of doc_id as text divisible by 5) are never in it. Every document is scored by its
whole text; nothing but the text enters a score.

Defined results: null and empty texts have no n-grams and get the score of a zero margin; rows without a
doc_id or a label are not fitted on; of rows that share a doc_id one is fitted on; equal rows get equal scores; where labels lack one of the classes,
each score is 0.5; a null doc_id counts as held out; an empty table gives an empty table; other columns of
the input are kept, a column named score is replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import discard, in_slices, mix64, small_batches, table, utf8, written

BITS = 18
#: The fit sample's bound: documents, and cells of all of them (a document has at most 2^BITS).
FIT_ROWS, FIT_CELLS = 10_000, 10_000_000
#: Cells sent to the driver at once (or one document's): the sample reaches it in parts, by ranges of doc_id.
SENT_CELLS = 1 << 20
FOLDS = 5
KEPT_FROM = 0.3
COST, ROUNDS, SMOOTHING, BLEND, SEED = 1.0, 12, 1.0, 0.25, 7
SPACE, PUNCTUATION, DIGIT, LETTER = 0, 1, 2, 3


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, LETTER, np.uint8)
    kinds[:128] = PUNCTUATION
    kinds[:33] = SPACE
    kinds[127] = SPACE
    kinds[48:58] = DIGIT
    kinds[65:91] = LETTER
    kinds[97:123] = LETTER
    return kinds


KINDS = _byte_kinds()
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes whose tokens are read at once: what a task holds beside its batch doesn't grow with a text.
PIECE = 1 << 17
with np.errstate(over="ignore"):
    POWERS = np.cumprod(np.concatenate(([np.uint64(1)], np.full(PIECE - 1, BASE))))


@dataclass
class Tokens:
    """Words and runs of digits or punctuation in order: the row, a hash of the bytes and the shape of each."""

    row: np.ndarray
    word: np.ndarray
    shape: np.ndarray
    letters: np.uint64 | None  # the last word's hash

    def tail(self) -> Tokens:
        return Tokens(self.row[-2:], self.word[-2:], self.shape[-2:], self.letters)

    def then(self, more: Tokens) -> Tokens:
        return Tokens(*(np.concatenate([getattr(t, c) for t in (self, more)]) for c in ("row", "word", "shape")), more.letters)


def tokens(raw: np.ndarray, at: np.ndarray, before: np.uint64 | None = None) -> Tokens:
    """Of at most PIECE bytes, or of one token of any length. ``before``: the word before, if the first row goes on from there."""
    kind = KINDS[raw[:1]] if len(raw) > PIECE else KINDS[raw]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[at[:-1][at[:-1] < len(kind)]] = True
    begin = np.flatnonzero(new)
    if len(raw) > PIECE:
        word, upper, lower = (np.array([x]) for x in long_token(raw))
    else:
        place = np.arange(len(raw)) - np.repeat(begin, np.diff(np.append(begin, len(raw))))
        word = np.add.reduceat((raw.astype(np.uint64) + np.uint64(1)) * POWERS[place], begin)
        upper, lower = (np.add.reduceat(((raw >= least) & (raw <= most)).astype(np.int32), begin) for least, most in ((65, 90), (97, 122)))
    seen = kind[begin] != SPACE
    kind, word, row = kind[begin][seen], mix64(word[seen]), np.searchsorted(at, begin[seen], "right") - 1
    upper, lower = upper[seen], lower[seen]
    letters = np.flatnonzero(kind == LETTER)
    same = np.zeros(len(word), bool)
    same[letters[1:]] = (word[letters[1:]] == word[letters[:-1]]) & (row[letters[1:]] == row[letters[:-1]])
    if before is not None and len(letters) and row[letters[0]] == 0:
        same[letters[0]] = word[letters[0]] == before
    case = np.where((upper > 1) & (lower == 0), 3, np.where(upper > 0, 2, 1)) + 4 * same
    shape = np.where(kind == LETTER, case, np.where(kind == DIGIT, 9, 0)).astype(np.uint64)
    shape = np.where(kind == PUNCTUATION, word | np.uint64(16), shape)
    return Tokens(row, word, shape, word[letters[-1]] if len(letters) else before)


def long_token(raw: np.ndarray) -> tuple[np.uint64, int, int]:
    """The hash of a token over PIECE bytes, and how many upper and lower case letters it has."""
    word, upper, lower, power = np.zeros(1, np.uint64), 0, 0, np.ones(1, np.uint64)
    for k in range(0, len(raw), len(POWERS)):
        part = raw[k : k + len(POWERS)]
        word += ((part.astype(np.uint64) + np.uint64(1)) * POWERS[: len(part)]).sum(keepdims=True) * power
        power = power * POWERS[-1:] * BASE
        upper += int(((part >= 65) & (part <= 90)).sum())
        lower += int(((part >= 97) & (part <= 122)).sum())
    return word[0], upper, lower


def gram_cells(t: Tokens, seen: int = 0) -> np.ndarray:
    """Distinct cells of each row's grams, packed with the row, ascending; of the grams that end after the first ``seen`` tokens."""
    row, word, shape = t.row, t.word, t.shape
    two = row[1:] == row[:-1]
    three = two[1:] & two[:-1]
    two[: max(seen - 1, 0)] = three[: max(seen - 2, 0)] = False
    mixed = mix64(shape + np.uint64(11))
    grams = [
        (row[seen:], word[seen:]),
        (row[1:][two], mix64(word[:-1] * np.uint64(3) + word[1:] + np.uint64(1))[two]),
        (row[seen:], mixed[seen:]),
        (row[1:][two], mix64(mixed[:-1] * np.uint64(5) + mixed[1:] + np.uint64(2))[two]),
        (row[2:][three], mix64(mixed[:-2] * np.uint64(25) + mixed[1:-1] * np.uint64(5) + mixed[2:] + np.uint64(3))[three]),
    ]
    both = np.concatenate([(r << BITS) | (h >> np.uint64(64 - BITS)).astype(np.int64) for r, h in grams])
    both.sort()
    return both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both


def long_text_cells(raw: np.ndarray) -> np.ndarray:
    """Distinct cells of one text, piece by piece. Pieces end between tokens; the two tokens before a piece lead its first grams."""
    found = np.zeros(1 << BITS, bool)
    last: Tokens | None = None
    begin = 0
    while begin < len(raw):
        kind = KINDS[raw[begin : begin + PIECE]]
        borders = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        if begin + PIECE >= len(raw):
            end = len(raw)
        elif len(borders):
            end = begin + int(borders[-1])
        else:
            end = token_end(raw, begin)
        own = tokens(raw[begin:end], np.array([0, end - begin]), last.letters if last else None)
        if len(own.row):
            whole = last.then(own) if last else own
            found[gram_cells(whole, len(whole.row) - len(own.row))] = True
            last = whole.tail()
        begin = end
    return np.flatnonzero(found)


def token_end(raw: np.ndarray, begin: int) -> int:
    at = begin + 1
    while at < len(raw):
        other = KINDS[raw[at : at + PIECE]] != KINDS[raw[begin]]
        if other.any():
            return at + int(other.argmax())
        at += len(other)
    return at


def ngram_cells(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells of each text, as rows and cells side by side, rows ascending. ``raw``, ``at``: bytes and offsets as from utf8()."""
    rows, cells, begin = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    while begin < len(at) - 1:
        end = int(np.searchsorted(at, at[begin] + PIECE, "right")) - 1
        if end <= begin:
            end = begin + 1
            found = long_text_cells(raw[at[begin] : at[end]])
        elif at[end] > at[begin]:
            found = gram_cells(tokens(raw[at[begin] : at[end]], at[begin : end + 1] - at[begin]))
        else:
            found = cells[0]
        rows.append((found >> BITS) + begin)
        cells.append(found & ((1 << BITS) - 1))
        begin = end
    return np.concatenate(rows), np.concatenate(cells)


@dataclass
class Model:
    weights: np.ndarray | None  # of each cell, log-count ratios included
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, row: np.ndarray, cell: np.ndarray, scale: np.ndarray, rows: int) -> np.ndarray:
        """Of rows with unit length; ``scale`` is each cell's squared log-count ratio."""
        sums = np.bincount(row, self.weights[cell], rows)
        size = np.sqrt(np.bincount(row, scale[cell], rows))
        return np.divide(sums, size, out=np.zeros(rows), where=size > 0) + self.bias


@dataclass
class Classifier:
    model: Model
    scale: np.ndarray | None

    def scores(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = len(at) - 1
        if self.model.weights is None:
            return np.full(n, 0.5)
        m = self.model.margins(*ngram_cells(raw, at), self.scale, n)
        return 1 / (1 + np.exp(-np.clip(self.model.slope * m + self.model.shift, -60, 60)))


@dataclass
class UnitRows:
    """Each row's values at unit length, made when asked for: kept, they would be twice as large as all cells."""

    rows: list[np.ndarray]
    ratio: np.ndarray

    def __getitem__(self, i: int) -> np.ndarray:
        x = self.ratio[self.rows[i]]
        size = np.sqrt(x @ x)
        return x / size if size else x


def descend(rows: list[np.ndarray], values: list[np.ndarray] | UnitRows, y: np.ndarray, cost: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias of least hinge loss, by dual coordinate descent. Each row has unit length, and a constant of 1 for the bias."""
    w, bias = np.zeros(1 << BITS), 0.0
    alpha = np.zeros(len(y))
    rng = np.random.default_rng(SEED)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            cells, x = rows[i], values[i]
            gradient = y[i] * (w[cells] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / 2, 0.0), cost[i])
            if (step := new - alpha[i]) != 0:
                alpha[i] = new
                w[cells] += step * y[i] * x
                bias += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def train(row: np.ndarray, cell: np.ndarray, good: np.ndarray) -> Classifier:
    """From the distinct cells of the sample's rows and their labels."""
    n = len(good)
    held = np.arange(n) % 5 == 4
    fitted = ~held
    if len(set(good[fitted])) < 2:
        return Classifier(Model(None), None)
    # Row by row: whole columns beside the cells would be several times as large as these.
    own = [cell[a:b] for a, b in pairwise(np.searchsorted(row, np.arange(n + 1, dtype=row.dtype)))]
    p, q = np.full(1 << BITS, SMOOTHING), np.full(1 << BITS, SMOOTHING)
    for i in np.flatnonzero(fitted):
        (p if good[i] else q)[own[i]] += 1
    ratio = np.log((p / (fitted & good).sum()) / (q / (fitted & ~good).sum()))
    ratio[p + q <= 2 * SMOOTHING] = 0  # in no row that is fitted
    rows = [own[i] for i in np.flatnonzero(fitted)]
    y = np.where(good[fitted], 1.0, -1.0)
    cost = np.where(y > 0, COST, COST * min(20.0, (y > 0).sum() / (y < 0).sum()))
    w, bias = descend(rows, UnitRows(rows, ratio), y, cost)
    used = w != 0
    mean = np.abs(w[used]).mean() if used.any() else 0.0
    w = np.where(used, (1 - BLEND) * mean * np.sign(w) + BLEND * w, 0) if mean else w
    model, scale = Model(w * ratio, bias), ratio**2
    margin = np.array([model.margins(np.zeros(len(own[i]), np.int64), own[i], scale, 1)[0] for i in np.flatnonzero(held)])
    model.slope, model.shift = logistic(margin, good[held])
    return Classifier(model, scale)


def logistic(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method, with Platt's smoothed targets."""
    up, down = good.sum(), (~good).sum()
    if not up or not down:
        return 1.0, 0.0
    target = np.where(good, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -60, 60)))
        d, weight = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([d @ margin + 1e-3 * a, d.sum()])
        h = np.array([[weight @ margin**2 + 1e-3, weight @ margin], [weight @ margin, weight.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Classifier:
    """From the labelled rows outside the held-out fold, about ``fit_rows`` of them by a hash of doc_id."""
    small_batches(docs.sparkSession)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = min(1.0, fit_rows / max(1, known.count()))
    picked = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # About fit_rows rows of a few bytes: a bound by construction.
    sample = docs.select(F.col("doc_id"), F.col("text").cast("string")).join(F.broadcast(picked), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", 1 << 20):
            row, cell = ngram_cells(*utf8(batch.column("text")))
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("quality").cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(cell.astype(np.int32)))], ["doc_id", "quality", "cells"])

    rows = sample.select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality long, cells array<int>")
    # One row of each doc_id: FIT_ROWS rows, to a sampling error.
    one = rows.groupBy("doc_id").agg(F.min(F.struct(F.size("cells").alias("n"), "cells", "quality")).alias("r"))
    one = written(one.select("doc_id", F.xxhash64("doc_id").alias("h"), "r.n", "r.quality", "r.cells"), "quality-sample")
    sizes = one.select("doc_id", "h", "n", "quality").toArrow().sort_by("doc_id")
    doc_id, h, n, marks = (sizes[c].to_numpy() for c in sizes.column_names)
    order = np.lexsort((n, h))
    within = int((np.cumsum(n[order]) <= FIT_CELLS).sum())
    if not within:
        discard(one)
        return Classifier(Model(None), None)
    last = h[order[within - 1]]
    doc_id, n, marks = (x[h <= last] for x in (doc_id, n, marks))
    at = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
    cell = np.empty(at[-1], np.int32)
    begin = 0
    while begin < len(n):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + SENT_CELLS, "right")) - 1)
        part = one.filter(F.col("doc_id").between(int(doc_id[begin]), int(doc_id[end - 1])) & (F.col("h") <= int(last)))
        for batch in part.select("doc_id", "cells").toArrow().to_batches():
            place, cells = np.searchsorted(doc_id, batch.column("doc_id").to_numpy()), batch.column("cells")
            found, cuts = cells.values.to_numpy(), cells.offsets.to_numpy()
            for k, a, b in zip(place, cuts, cuts[1:], strict=False):
                cell[at[k] : at[k + 1]] = found[a:b]
        begin = end
    discard(one)
    return train(np.repeat(np.arange(len(n), dtype=np.int32), n), cell, marks == 1)


def score(df: DataFrame, classifier: Classifier, text: str = "text", into: str = "score") -> DataFrame:
    """``df`` with the column ``into``, 0 to 1."""
    small_batches(df.sparkSession)
    schema = T.StructType([f for f in df.schema if f.name != into])
    kept = list(schema.names)
    schema = schema.add(into, T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, text, 1 << 20):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(classifier.scores(*utf8(batch.column(text))))], [*kept, into])

    return df.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns."""
    own = f"_score_{uuid.uuid4().hex}"
    return score(docs, fit(docs, labels), into=own).filter(F.col(own) >= KEPT_FROM).drop(own)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEPT_FROM).cast("int").alias("predicted"))
