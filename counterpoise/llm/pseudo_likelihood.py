"""Language-model scores by masked pseudo-likelihood.

A network predicts each word from ``REACH`` words on either side: vectors of the neighbours, one set per
place, are summed and bent by tanh, and a two-level softmax gives the word's class and the word in its
class.  All words of all documents are counted in a table.  The most frequent ones have numbers of their own;
the network says how likely one of the others is at a place, and its share among them is its share of their
count, which is joined from the table.  So every word has a chance of its own, and the table grows with the
corpus.  Every partition trains its own copy on all of its words, in numpy; the copies are averaged by words
seen, in a tree, and the average starts the next round.  A document's score is the sum of its words'
conditional log-probabilities.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from counterpoise.llm.shared import word_hashes
from counterpoise.session import cut_lineage

REACH = 2
DEPTH = 12
CLASSES = 24
WORDS = CLASSES * CLASSES       # numbers; the last is shared by all other words, the one before is a text's border
RATE = 0.05
_STEP = 16_384                  # words in a training step
_FAN = 64                       # copies that are averaged in one task


def counted(docs: DataFrame) -> DataFrame:
    """Rows ``(word, times)``: hashes of all lower-case words of ``docs`` and how often each occurs; written."""

    def counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            words, _ = word_hashes(_bytes(frame["text"].tolist()))
            names, times = np.unique(words, return_counts=True)
            yield pd.DataFrame({"word": names.astype(np.int64), "times": times.astype(np.int64)})

    found = docs.select("text").mapInPandas(counts, "word long, times long")
    return cut_lineage(found.groupBy("word").agg(F.sum("times").alias("times")))


def vocabulary(counts: DataFrame) -> np.ndarray:
    """Hashes of the ``WORDS - 2`` most frequent words, most frequent first: those with numbers of their own."""
    top = counts.orderBy(F.desc("times"), "word").limit(WORDS - 2).collect()         # bounded by WORDS
    return np.array([row["word"] for row in top], dtype=np.int64).astype(np.uint64)


def _bytes(texts: list[str | None]) -> list[bytes]:
    return [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]


class Coder:
    """Words of texts as numbers by frequency rank, with borders of REACH between texts."""

    def __init__(self, words: np.ndarray):
        self.order = np.argsort(words)
        self.sorted = words[self.order]

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers with borders, and where each text's words start (and end, REACH before the next)."""
        words, bounds = word_hashes(_bytes(texts))
        self.hashes = words         # of the texts read last
        code = np.full(len(words), WORDS - 1, dtype=np.int64)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, words), len(self.sorted) - 1)
            known = self.sorted[at] == words
            code[known] = self.order[at[known]]
        starts = bounds + REACH * (1 + np.arange(len(bounds)))
        out = np.full(len(words) + REACH * (len(texts) + 1), WORDS - 2, dtype=np.int64)
        place = np.arange(len(words)) + REACH * (1 + np.repeat(np.arange(len(texts)), np.diff(bounds)))
        out[place] = code
        return out, starts


def fresh(seed: int = 3) -> list[np.ndarray]:
    draw = np.random.default_rng(seed)
    return [draw.normal(0, 0.1, (2 * REACH, WORDS, DEPTH)).astype(np.float32), np.zeros(DEPTH, np.float32),
            draw.normal(0, 0.1, (CLASSES, DEPTH)).astype(np.float32), np.zeros(CLASSES, np.float32),
            draw.normal(0, 0.1, (CLASSES, CLASSES, DEPTH)).astype(np.float32), np.zeros((CLASSES, CLASSES), np.float32)]


def packed(weights: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([w.ravel() for w in weights])


def unpacked(flat: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for like in fresh():
        out.append(flat[at:at + like.size].reshape(like.shape).astype(np.float32))
        at += like.size
    return out


def _places() -> list[int]:
    return [d for d in range(-REACH, REACH + 1) if d]


def _softmax(x: np.ndarray) -> np.ndarray:
    """In place: probabilities by row."""
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def _forward(weights: list[np.ndarray], numbers: np.ndarray, at: np.ndarray):
    """Words at ``at``, sorted by class: order, hidden values, class and word probabilities."""
    near, bias, of_class, class_bias, of_word, word_bias = weights
    target = numbers[at]
    order = np.argsort(target // CLASSES, kind="stable")
    at, target = at[order], target[order]
    hidden = np.tile(bias, (len(at), 1))
    for k, d in enumerate(_places()):
        hidden += near[k][numbers[at + d]]
    np.tanh(hidden, out=hidden)
    classes = _softmax(hidden @ of_class.T + class_bias)
    group, inside = np.divmod(target, CLASSES)
    cuts = np.searchsorted(group, np.arange(CLASSES + 1))
    words = np.empty((len(at), CLASSES), np.float32)
    for c in range(CLASSES):
        low, high = cuts[c], cuts[c + 1]
        if high > low:
            words[low:high] = hidden[low:high] @ of_word[c].T + word_bias[c]
    _softmax(words)
    return order, at, hidden, classes, group, words, inside, cuts


def log_chances(weights: list[np.ndarray], numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Conditional log-probability of each word at ``at`` given its neighbours on both sides."""
    out = np.empty(len(at))
    for low in range(0, len(at), _STEP):
        order, where, _, classes, group, words, inside, _ = _forward(weights, numbers, at[low:low + _STEP])
        rows = np.arange(len(where))
        out[low + order] = np.log(classes[rows, group] + 1e-12) + np.log(words[rows, inside] + 1e-12)
    return out


def train_step(weights: list[np.ndarray], squares: list[np.ndarray], numbers: np.ndarray, at: np.ndarray) -> None:
    """One step of gradient descent with rates by past gradients, in place."""
    near, bias, of_class, class_bias, of_word, word_bias = weights
    _, where, hidden, classes, group, words, inside, cuts = _forward(weights, numbers, at)
    rows, n = np.arange(len(where)), len(where)
    classes[rows, group] -= 1
    words[rows, inside] -= 1
    back = classes @ of_class
    g_word, g_word_bias = np.zeros_like(of_word), np.zeros_like(word_bias)
    for c in range(CLASSES):
        low, high = cuts[c], cuts[c + 1]
        if high > low:
            back[low:high] += words[low:high] @ of_word[c]
            g_word[c] = words[low:high].T @ hidden[low:high]
            g_word_bias[c] = words[low:high].sum(axis=0)
    back *= 1 - hidden * hidden
    g_near = np.zeros_like(near)
    for k, d in enumerate(_places()):
        seen = numbers[where + d]
        order = np.argsort(seen, kind="stable")
        names, starts = np.unique(seen[order], return_index=True)
        g_near[k][names] = np.add.reduceat(back[order], starts, axis=0)
    grads = [g_near, back.sum(axis=0), classes.T @ hidden, classes.sum(axis=0), g_word, g_word_bias]
    for w, s, g in zip(weights, squares, grads):
        g /= n
        s += g * g
        w -= RATE * g / (np.sqrt(s) + 1e-6)


def _trainer(words: np.ndarray, start: np.ndarray):
    def rows(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, weights, seen = Coder(words), unpacked(start), 0
        squares = [np.zeros_like(w) for w in weights]
        for frame in frames:
            for low in range(0, len(frame), 256):
                numbers, starts = coder.numbers(frame["text"].iloc[low:low + 256].tolist())
                at = _inner(starts)
                for step in range(0, len(at), _STEP):
                    train_step(weights, squares, numbers, at[step:step + _STEP])
                seen += len(at)
        if seen:
            yield pd.DataFrame({"words": [seen], "flat": [(packed(weights).astype(np.float64) * seen).tobytes()]})

    return rows


def _inner(starts: np.ndarray) -> np.ndarray:
    """Places of words; ``starts`` as :meth:`Coder.numbers` gives them."""
    sizes = np.diff(starts) - REACH
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts[:-1], sizes)


def _summed(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words, flat = 0, None
    for frame in frames:
        for n, part in zip(frame["words"], frame["flat"]):
            values = np.frombuffer(part, dtype=np.float64)
            words, flat = words + int(n), values if flat is None else flat + values
    if flat is not None:
        yield pd.DataFrame({"words": [words], "flat": [flat.tobytes()]})


def trained(docs: DataFrame, words: np.ndarray, rounds: int = 1) -> list[np.ndarray]:
    """The network, trained on every word of ``docs``; untrained where there is no word."""
    flat = packed(fresh())
    for _ in range(rounds):
        schema = "words long, flat binary"
        copies = cut_lineage(docs.select("text").mapInPandas(_trainer(words, flat), schema))
        count = copies.count()
        while count > 1:
            count = math.ceil(count / _FAN)
            copies = cut_lineage(copies.repartition(count).mapInPandas(_summed, schema))
        last = copies.first()
        if last is not None:
            flat = np.frombuffer(last["flat"], dtype=np.float64) / last["words"]
    return unpacked(flat)


def score_of(weights: list[np.ndarray], words: np.ndarray, text: Column | str = "text") -> Column:
    """A struct ``(n, total, rare, times)``: words of the whole text, the sum of their log-probabilities as far as the
    network goes, and the hashes and numbers of the words without numbers of their own; empty for null texts."""

    @pandas_udf("n long, total double, rare array<long>, times array<int>")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = Coder(words)
        for batch in batches:
            texts, n, total, rare, times = batch.tolist(), [], [], [], []
            for low in range(0, len(texts), 256):
                part = texts[low:low + 256]
                numbers, starts = coder.numbers(part)
                at = _inner(starts)
                sizes = np.diff(starts) - REACH
                chances = np.append(log_chances(weights, numbers, at), 0)
                sums = np.add.reduceat(chances, np.minimum(np.cumsum(sizes) - sizes, len(chances) - 1))
                n.append(sizes)
                total.append(np.where(sizes > 0, sums, 0.0))
                own, hashes = numbers[at] == WORDS - 1, coder.hashes
                cuts = np.concatenate([[0], np.cumsum(own)])[np.concatenate([[0], np.cumsum(sizes)])]
                left = hashes[own].astype(np.int64)
                for low_cut, high_cut in zip(cuts, cuts[1:]):
                    names, often = np.unique(left[low_cut:high_cut], return_counts=True)
                    rare.append(names)
                    times.append(often.astype(np.int32))
            yield pd.DataFrame({"n": np.concatenate(n or [np.zeros(0, np.int64)]).astype(np.int64),
                                "total": np.concatenate(total or [np.zeros(0)]), "rare": rare, "times": times})

    return told(text)


def scored(docs: DataFrame, weights: list[np.ndarray], words: np.ndarray, counts: DataFrame) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: ``doc_id``, ``n`` words and ``total``, the sum of their log-probabilities.

    A word without number of its own has the network's chance of such a word times its share of their count; one
    that ``counts`` lacks is counted as half.  Words and counts meet by a shuffle on the word: none of these words
    is among the most frequent, so none is hot."""
    rows = cut_lineage(docs.select("doc_id", score_of(weights, words).alias("s")).select(
        "doc_id", "s.*", F.monotonically_increasing_id().alias("row")))
    known = counts.where(~F.col("word").isin([int(w) for w in words.astype(np.int64)])) if len(words) else counts
    others = float(known.agg(F.sum("times")).first()[0] or 1)
    asked = rows.select("row", F.inline(F.arrays_zip(F.col("rare").alias("word"), F.col("times").alias("here"))))
    share = F.log(F.coalesce(F.col("times").cast("double"), F.lit(0.5)) / F.lit(others))
    sums = asked.join(known.hint("shuffle_merge"), "word", "left").groupBy("row").agg(
        F.sum(F.col("here") * share).alias("within"))
    return rows.join(sums, "row", "left").select(
        "doc_id", "n", (F.col("total") + F.coalesce("within", F.lit(0.0))).alias("total"))


def report(docs: DataFrame) -> DataFrame:
    """Per document its words, the sum of their conditional log-probabilities, and the mean (null without words).

    Repeated rows count as often as they stand there, in counts and in training, and each has a row here, also with a
    null doc_id.  Texts of any length are read whole; null and empty ones have no words and a sum of 0."""
    counts = counted(docs)
    words = vocabulary(counts)
    weights = trained(docs, words)
    return scored(docs, weights, words, counts).select(
        "doc_id", F.col("n").alias("n_words"), F.col("total").alias("log_likelihood"),
        F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("mean_log_likelihood"))
