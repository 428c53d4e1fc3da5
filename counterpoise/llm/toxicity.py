"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

The kernel of two words counts the subsequences of ``ORDER`` characters that they share, gaps at a discount,
so an insult with characters put in between or left out stays near the insult.  A sentence is described by
its nearest word to each landmark; landmarks are the words that tell toxic training documents best.  A
linear machine on the Nyström features learns from labelled sentences: all sentences of clean documents,
and of each toxic document the one that scores highest.  A document scores as its most toxic sentence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from counterpoise.llm.labelled import calibrate, remainder, training_sample
from counterpoise.llm.shared import factors
from counterpoise.llm.shingles import shingle_sets

ORDER = 4
DECAY = 0.75
LANDMARKS = 48
SHARED = 0.6            # share of a landmark's characters that a word has in their order
FLOOR = 0.1             # kernel values below count as 0
WIDTH = 32              # characters of a word seen at once; longer words go through in overlapping windows
CUTOFF = 0.3
STEMS = (5, 6, 7, 8)    # lengths of beginnings, the start sign included
START = "^"             # stands before a word, so that its beginning counts
RARE = 0.02             # share of toxic training documents that must hold a landmark
APART = 0.4            # least kernel value at which a word needs no landmark of its own
TELLING = 8.0           # least log-likelihood gain of a landmark
_WORDS_KEPT = 200_000
_SPACED = re.compile(r"(?<!\S)\S(?:\s\S){3,}(?!\S)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


_GAPS = {ord(c): "\0" for c in _EDGE if c != START}


def windows(word: str) -> list[str]:
    """A word cut into overlapping windows where it is long."""
    return [word[i:i + WIDTH] for i in range(0, max(1, len(word) - WIDTH // 2), WIDTH // 2)]


def codes_of(words: list[str]) -> np.ndarray:
    """Code points, one row per word of up to WIDTH characters, 0 behind the end and for signs, which are
    gaps that match nothing."""
    padded = "".join(w.ljust(WIDTH, "\0") for w in words).translate(_GAPS)
    return np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(-1, WIDTH)


def _steps(size: int) -> np.ndarray:
    gap = np.subtract.outer(np.arange(size), np.arange(size))
    return np.where(gap > 0, DECAY ** np.maximum(gap, 0), 0).astype(np.float32)


def subsequence_kernel(words: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Kernel of each row of ``words`` with the same row of ``others`` (or with its only row)."""
    same = (words[:, :, None] == others[:, None, :]) & (words[:, :, None] > 0)
    left, right = _steps(words.shape[1]), _steps(others.shape[1]).T
    paths = same * np.float32(DECAY ** 2)
    for _ in range(ORDER - 1):
        paths = same * (np.matmul(left, paths) @ right)
    return paths.sum(axis=(1, 2), dtype=np.float64)


def _shares_enough(masks: dict[int, np.ndarray], word: str, count: int) -> np.ndarray:
    """Whether rows have a common subsequence with ``word`` of SHARED of its characters; else the kernel
    counts as 0 (it is 0 below ORDER characters)."""
    open_ = np.full(count, 2 ** WIDTH - 1, dtype=np.uint64)
    for c in word:
        hit = open_ & masks[ord(c)]
        open_ = ((open_ + hit) | (open_ - hit)) & np.uint64(2 ** WIDTH - 1)
    return np.bitwise_count(open_) <= WIDTH - max(ORDER, int(np.ceil(SHARED * len(word))))


def _by_length(rows: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
    """Pieces of ``rows`` with words of about equal length, the longest last."""
    rows = rows[np.argsort(length[rows], kind="stable")]
    cuts = np.flatnonzero(np.diff(length[rows]) > 0) + 1
    return [piece[at:at + 2048] for piece in np.split(rows, cuts) if len(piece) for at in range(0, len(piece), 2048)]


class Nearness:
    """Normalised kernels of words with the landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.codes = codes_of(landmarks) if landmarks else np.zeros((0, WIDTH), np.uint32)
        self.own = np.sqrt(subsequence_kernel(self.codes, self.codes)) if landmarks else np.zeros(0)

    def of(self, words: list[str]) -> np.ndarray:
        """One row per word (up to WIDTH characters), one column per landmark."""
        out = np.zeros((len(words), len(self.landmarks)))
        if not len(words) or not self.landmarks:
            return out
        codes = codes_of(words)
        length = np.maximum(1, WIDTH - (codes[:, ::-1] > 0).argmax(axis=1))
        bits = np.uint64(1) << np.arange(WIDTH, dtype=np.uint64)
        masks = {ord(c): (codes == ord(c)) @ bits for c in set("".join(self.landmarks))}
        some = np.zeros(len(words), dtype=bool)
        for j, landmark in enumerate(self.landmarks):
            near = np.flatnonzero(_shares_enough(masks, landmark, len(words)))
            some[near] = True
            for rows in _by_length(near, length):
                out[rows, j] = subsequence_kernel(codes[rows, :length[rows[-1]]], self.codes[j:j + 1, :len(landmark)])
        for rows in _by_length(np.flatnonzero(some), length):
            part = codes[rows, :length[rows[-1]]]
            out[rows] /= np.sqrt(subsequence_kernel(part, part))[:, None] * self.own[None, :]
        out[out < FLOOR] = 0
        return out


class Reader:
    """Turns texts into the nearness of their sentences to the landmarks, remembering words."""

    def __init__(self, nearness: Nearness):
        self.nearness = nearness
        self.seen: set[str] = set()
        self.place: dict[str, int] = {}
        self.rows = [np.zeros((0, len(nearness.landmarks)))]

    def learn(self, words: set[str]) -> None:
        if len(self.seen) > _WORDS_KEPT:
            self.seen, self.place, self.rows = set(), {}, [self.rows[0][:0]]
        new = sorted(words - self.seen)
        if not new:
            return
        flat = [START + w.strip(_EDGE) for w in new]
        starts = np.arange(len(new))
        if any(len(w) > WIDTH for w in flat):
            parts = [[w] if len(w) <= WIDTH else windows(w) for w in flat]
            flat = [p for part in parts for p in part]
            starts = np.cumsum([0] + [len(p) for p in parts])[:-1]
        near = np.maximum.reduceat(self.nearness.of(flat), starts, axis=0)
        hot = np.flatnonzero(near.any(axis=1))
        base = len(self.place)
        self.place.update({new[i]: base + n for n, i in enumerate(hot)})
        self.rows = [np.concatenate([*self.rows, near[hot]])]
        self.seen.update(new)

    def sentences(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nearness of each sentence with a word near a landmark, and its text's position."""
        lowered = [_SPACED.sub(lambda m: "".join(m.group().split()), (t or "").lower()) for t in texts]
        words: set[str] = set()
        for text in lowered:
            words.update(text.split())
        self.learn(words)
        place, owner, marks = self.place, [], []
        starts: list[int] = []
        for at, text in enumerate(lowered):
            for sentence in _SENTENCE.split(text):
                found = [place[w] for w in sentence.split() if w in place]
                if found:
                    starts.append(len(marks))
                    marks += found
                    owner.append(at)
        if not marks:
            return np.zeros((0, len(self.nearness.landmarks))), np.zeros(0, np.int64)
        return np.maximum.reduceat(self.rows[0][marks], starts, axis=0), np.array(owner)


def choose_landmarks(texts: list[str], label: np.ndarray, count: int = LANDMARKS) -> list[str]:
    """Words, and beginnings of words, that more toxic documents hold than chance would have it."""
    held = {0: Counter(), 1: Counter()}
    for text, y in zip(texts, label):
        words = {START + w.strip(_EDGE) for w in text.lower().split()}
        found = {w[:n] for w in words for n in STEMS if len(w) >= n}
        found.update(w for w in words if ORDER <= len(w) <= WIDTH)
        held[int(y)].update(found)
    n1, n0 = max(1, int(label.sum())), max(1, int((1 - label).sum()))
    scored = []
    for word, k1 in held[1].items():
        p1, p0 = k1 / n1, held[0][word] / n0
        p = (k1 + held[0][word]) / (n1 + n0)
        if k1 >= max(3, RARE * n1) and p1 > 3 * p0:
            gain = k1 * np.log(p1 / p) + (held[0][word] * np.log(p0 / p) if p0 else 0)
            scored.append((-gain, -len(word), word))
    chosen: list[str] = []
    for gain, _, word in sorted(scored):
        if len(chosen) == count or -gain <= TELLING:
            break
        if not chosen or Nearness(chosen).of([word]).max() < APART:      # one landmark for words alike
            chosen.append(word)
    return chosen


def without_copies(texts: list[str]) -> np.ndarray:
    """Positions of texts that aren't near copies of an earlier one, by two min-hashes of their shingles;
    the words of a group of copies would pass for telling ones."""
    seen, out = [set(), set()], []
    for i, tokens in enumerate(shingle_sets(texts)):
        marks = [int((tokens * f).min()) for f in factors(2, 40)] if len(tokens) else [0, 0]
        if not any(mark in known for mark, known in zip(marks, seen)):
            out.append(i)
        for mark, known in zip(marks, seen):
            known.add(mark)
    return np.array(out, dtype=np.int64)


def hinge_fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, strength: float = 1e-4, steps: int = 400) -> np.ndarray:
    """Weights (last one the offset) of a linear machine with squared hinge loss, by accelerated gradient steps."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = weight / weight.sum()
    bound = 2 * np.linalg.eigvalsh((x * weight[:, None]).T @ x)[-1] + strength
    w = z = np.zeros(x.shape[1])
    t = 1.0
    for _ in range(steps):
        short = np.maximum(0, 1 - y * (x @ z))
        new = z - (-2 * x.T @ (weight * y * short) + strength * np.r_[z[:-1], 0]) / bound
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w


def _best(values: np.ndarray, owner: np.ndarray, count: int, empty: float) -> np.ndarray:
    out = np.full(count, empty)
    np.maximum.at(out, owner, values)
    return out


class Model:
    """Landmarks, the machine's weight per landmark kernel, and the curve from a text's sentences to its chance."""

    def __init__(self, landmarks: list[str], weights: np.ndarray, offset: float, curve: tuple):
        self.landmarks, self.weights, self.offset, self.curve = landmarks, weights, offset, curve

    def told(self, margin: np.ndarray, owner: np.ndarray, texts: list[str | None]) -> np.ndarray:
        """Per text its best sentence's margin, that of the second best, and the logarithm of its length."""
        best = _best(margin, owner, len(texts), self.offset)
        order = np.lexsort((-margin, owner))
        later = np.r_[False, owner[order][1:] == owner[order][:-1]] if len(order) else np.zeros(0, bool)
        next_ = _best(margin[order][later], owner[order][later], len(texts), self.offset)
        return np.column_stack([best, next_, [np.log1p(len(t or "")) for t in texts]])

    def scores(self, reader: Reader, texts: list[str | None]) -> np.ndarray:
        near, owner = reader.sentences(texts)
        told = self.told(near @ self.weights + self.offset, owner, texts)
        return 1 / (1 + np.exp(-np.clip(told @ self.curve[:-1] + self.curve[-1], -30, 30)))


def fit(texts: list[str], label: np.ndarray, share: float, rounds: int = 4) -> Model:
    """Without both labels or any telling word every text gets ``share`` as its score."""
    kept = without_copies(texts)
    texts, label = [texts[i] for i in kept], label[kept]
    landmarks = choose_landmarks(texts, label)
    if not landmarks:
        rest = min(max(share, 1e-6), 1 - 1e-6)
        return Model([], np.zeros(0), 0.0, (0.0, 0.0, 0.0, float(np.log(rest / (1 - rest)))))
    nearness = Nearness(landmarks)
    reader = Reader(nearness)
    near, owner = reader.sentences(texts)
    gram = nearness.of(landmarks)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    whiten = vectors / np.sqrt(np.maximum(values, 1e-3))
    whiten = whiten @ vectors.T
    x = near @ whiten
    of_toxic = label[owner] == 1
    clean = np.vstack([x[~of_toxic], np.zeros((1, x.shape[1]))])
    margin = near.max(axis=1) - 0.6
    for _ in range(rounds):
        best = _best(np.where(of_toxic, margin, -np.inf), owner, len(texts), -np.inf)
        witness = np.flatnonzero(of_toxic & ((margin >= 0) | (margin >= best[owner] - 1e-12)))
        both = np.vstack([x[witness], clean])
        y = np.r_[np.ones(len(witness)), -np.ones(len(clean))]
        weight = np.where(y > 0, 0.5 / max(1, len(witness)), 0.5 / len(clean))
        w = hinge_fit(both, y, weight)
        margin = x @ w[:-1] + w[-1]
    model = Model(landmarks, whiten @ w[:-1], float(w[-1]), (0.0, 0.0, 0.0, 0.0))
    model.curve = calibrate(model.told(margin, owner, texts), label, share)
    return model


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from labels of documents whose crc32(doc_id) mod 4 is not 2."""
    sample, share = training_sample(docs, labels, "toxic", remainder("doc_id", 4) != 2)
    return fit(sample["text"].tolist(), sample["label"].to_numpy(), share)


def score_of(model: Model, text="text"):
    """The score of whole texts as a column; null and empty texts have that of a text without a word near a
    landmark."""

    @pandas_udf("double")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(Nearness(model.landmarks))
        for batch in batches:
            texts = batch.tolist()
            yield pd.Series(np.concatenate([model.scores(reader, texts[i:i + 2048])
                                            for i in range(0, len(texts), 2048)] or [np.zeros(0)]))

    return told(text)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document whether it is held out of learning (a null doc_id is not), its score, and the prediction."""
    model = learned(docs, labels)
    return docs.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
                       score_of(model).alias("score")).withColumn(
        "predicted", (F.col("score") >= CUTOFF).cast("int"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted toxic; other columns pass through."""
    model = learned(docs, labels)
    return docs.where(score_of(model) < CUTOFF)
