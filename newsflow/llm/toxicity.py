"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

Kernel of two words: they share a subsequence of three characters if both hold them in this order within five characters; each
occurrence weighs DECAY for every character that it spans, so inserted or missing characters lower the value of an insult but
don't erase it. Characters are compared by their code points, in lower case, so every script has its own. The kernel
is normalised, k(x, y) / sqrt(k(x, x) k(y, y)), and raised to the power SHARP, which leaves it a kernel and parts insults
from words that merely share a syllable. Kernel of two texts: the sum over all pairs of their distinct words, each with its
beginnings of BEGINNINGS characters, as inflected languages hang endings on their insults.

Landmarks are words, or such beginnings, of the training texts: those that tell toxic from clean texts best, chosen one by one so that no two are
alike, and some frequent ones. With K the kernel matrix of the landmarks and k(T) the kernel values of a text with them, its features are
K^(-1/2) k(T), so that inner products of features approximate the text kernel (Nyström; eigenvalues below RIDGE count as RIDGE). A
linear SVM, fitted by dual coordinate descent on standardised features, and Platt scaling turn them into a score.

Words lie between white space, without the punctuation around them; letters spelled out one by one are joined to a word, and a
word with other characters between its letters counts as its letters alone, too.

Training reads at most `max_rows` labelled texts of at most `max_chars` characters each (documented bounds: 3,000 of either label,
16,384), chosen by a hash of their ids, and takes landmarks from the first 1,200 of either label. Scores are made for every whole text; a worker keeps the values of words it has met, up to
KEPT words, and evaluates only new ones.

Defined results: null and empty texts get the score of a text without words; unlabelled, null or contradictory labels teach nothing
(a document with both labels is left out), nor does an id with several texts; words of fewer than three characters have no kernel and count
nothing; very long words and texts are taken whole; scripts without spaces give words as long as their lines, in which a landmark weighs
little; with labels of one kind only, every score is that label; with none, 0; repeated rows are scored one by one; an
empty table gives an empty result; extra columns are ignored (`score_documents`) or kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DECAY = 0.8
#: Steps from the first to the second and from there to the third character.
STEPS = ((1, 1), (1, 2), (2, 1), (1, 3), (2, 2), (3, 1))
SHARP = 6
BEGINNINGS = (5, 7)
RIDGE = 0.05
KEPT, SMALL = 250_000, 20_000
#: Kernel values that are 0 in the precision of 32-bit numbers.
NONE = 1e-7
#: Texts of either label that landmarks are chosen from.
LANDMARK_TEXTS = 1200
#: Kernel value with a chosen landmark from which a word is no landmark of its own.
ALIKE = 0.5
_RUN = re.compile("1{3,}")
_INSIDE = re.compile(r"[^\W\d_][\W\d_]+[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")
_EDGES = "".join(c for c in map(chr, range(33, 0x250)) if not c.isalnum()) + "‘’“”„…–—"


def words_of(text: str | None) -> list[str]:
    """The distinct lower-case words, and for each of them its beginnings."""
    split = (text or "").lower().split()
    words = set(split)
    if 1 in (sizes := list(map(len, split))):
        # runs of three or more single characters are words spelled out
        single = "".join(["1" if n == 1 else "0" for n in sizes])
        words.update("".join(split[m.start() : m.end()]) for m in _RUN.finditer(single))
    words = {w.strip(_EDGES) for w in words}
    words |= {_OTHER.sub("", w) for w in words if not w.isalpha() and _INSIDE.search(w)}
    words.discard("")
    return [*words, *(w[:k] for k in BEGINNINGS for w in words if len(w) > k)]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all words: word number, code and weight of each distinct subsequence, by word."""
    points = np.frombuffer(("\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    breaks = points == 10
    number = np.cumsum(breaks) - breaks
    at, codes, weights, begins, used = [], [], [], [], []
    for a, b in STEPS:
        span = a + b
        if len(points) <= span:
            continue
        i = np.flatnonzero((number[:-span] == number[span:]) & ~breaks[span:])
        begins.append(i)
        used.append((a, b))
        at.append(number[i])
        codes.append((points[i] << 42) | (points[i + a] << 21) | points[i + span])
        weights.append(np.full(len(i), DECAY ** (span - 2)))
    if not at or not sum(map(len, at)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    at, codes, weights = np.concatenate(at), np.concatenate(codes), np.concatenate(weights)
    known, dense = np.unique(points, return_inverse=True)
    bits = len(known).bit_length()
    if 3 * bits + len(words).bit_length() < 64:
        # one number for word and subsequence sorts several times faster than two
        near = np.concatenate([dense[i] << 2 * bits | dense[i + a] << bits | dense[i + a + b] for i, (a, b) in zip(begins, used, strict=True)])
        order = np.argsort(at << 3 * bits | near)
    else:
        order = np.lexsort((codes, at))
    at, codes = at[order], codes[order]
    first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (codes[1:] != codes[:-1])))
    return at[first], codes[first], np.add.reduceat(weights[order], first)


def lengths(n: int, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """sqrt(k(x, x)) of n words; 1 where there is no subsequence."""
    squares = np.bincount(at, weights * weights, minlength=n)
    return np.sqrt(np.where(squares > 0, squares, 1))


@dataclass
class Landmarks:
    """Landmark words. Code `codes[i]` occurs in the landmarks `of_[begins[i]:begins[i + 1]]`, with weights `values` there as
    shares of the landmarks' lengths."""

    words: list[str]
    codes: np.ndarray
    begins: np.ndarray
    of_: np.ndarray
    values: np.ndarray
    #: Which hashes of codes occur, to pass over most others at once.
    marks: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> Landmarks:
        at, codes, weights = subsequences(words)
        order = np.argsort(codes, kind="stable")
        known, begins = np.unique(codes[order], return_index=True)
        marks = np.zeros(1 << 16, bool)
        marks[cls.mark(known)] = True
        return cls(words, known, np.append(begins, len(codes)), at[order], (weights / lengths(len(words), at, weights)[at])[order], marks)

    @staticmethod
    def mark(codes: np.ndarray) -> np.ndarray:
        return (codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)

    def kernel(self, words: list[str]) -> np.ndarray:
        """Sharpened kernel values of words (rows) with each landmark."""
        at, codes, weights = subsequences(words)
        length = lengths(len(words), at, weights)
        hit = np.flatnonzero(self.marks[self.mark(codes)]) if len(self.codes) else np.zeros(0, np.int64)
        row = np.minimum(np.searchsorted(self.codes, codes[hit]), max(len(self.codes) - 1, 0))
        own = self.codes[row] == codes[hit] if len(hit) else np.zeros(0, bool)
        hit, row = hit[own], row[own]
        # a term for each landmark that holds the subsequence
        terms = self.begins[row + 1] - self.begins[row]
        each = np.repeat(self.begins[row] - np.cumsum(terms) + terms, terms) + np.arange(terms.sum())
        cells = np.repeat(at[hit], terms) * len(self.words) + self.of_[each]
        sums = np.bincount(cells, np.repeat(weights[hit], terms) * self.values[each], minlength=len(words) * len(self.words))
        return (sums.reshape(len(words), len(self.words)) / length[:, None]) ** SHARP


class WordCache:
    """Kernel values of the words met so far, as rows of a table; words like no landmark share row 0."""

    def __init__(self, landmarks: Landmarks, kept: int = KEPT):
        self.landmarks, self.kept = landmarks, kept
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.table, self.used = np.zeros((1024, len(self.landmarks.words)), np.float32), 1

    def shrink(self) -> None:
        """What a worker keeps between two tasks: nothing beyond SMALL words, so that later stages have the room."""
        if len(self.rows) > SMALL:
            self.clear()

    def learn(self, words: list[str]) -> None:
        values = self.landmarks.kernel(words)
        like = np.flatnonzero(values.max(axis=1, initial=0) > NONE)
        end = self.used + len(like)
        if end > len(self.table):
            self.table = np.concatenate([self.table[: self.used], np.zeros((end, values.shape[1]), np.float32)])
        self.table[self.used : end] = values[like]
        number = np.zeros(len(words), np.int64)
        number[like] = np.arange(self.used, end)
        self.used = end
        self.rows.update(zip(words, number.tolist(), strict=True))

    def pooled(self, texts: list[str | None], rows_at_once: int = 256) -> np.ndarray:
        """For each text the sum of its words' kernel values with each landmark; the words of rows_at_once texts are held at once."""
        parts = [self._pooled(texts[a : a + rows_at_once]) for a in range(0, len(texts), rows_at_once)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.landmarks.words)))

    def _pooled(self, texts: list[str | None]) -> np.ndarray:
        split = [words_of(t) for t in texts]
        if len(self.rows) > self.kept:
            self.clear()
        new = list(set().union(*split).difference(self.rows)) if split else []
        for a in range(0, len(new), 1 << 12):
            self.learn(new[a : a + (1 << 12)])
        out = np.zeros((len(texts), len(self.landmarks.words)))
        for i, words in enumerate(split):
            out[i] = self.table[[self.rows[w] for w in words]].sum(axis=0, dtype=np.float64)
        return out


@dataclass
class ToxicityModel:
    landmarks: Landmarks
    whiten: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    platt: tuple[float, float]

    def margins(self, pooled: np.ndarray) -> np.ndarray:
        x = (pooled @ self.whiten - self.mean) / self.scale
        return x @ self.weights[:-1] + self.weights[-1]

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * self.margins(pooled) + b, -30, 30)))


def choose_landmarks(texts: list[str], toxic: np.ndarray, count: int = 64, frequent: int = 16, least_gain: float = 3.5) -> list[str]:
    """Words of three or more characters by how well their presence tells the labels apart (difference of shares over its
    standard error, at least least_gain), then the most frequent ones."""
    total = np.bincount(toxic, minlength=2).astype(float)
    seen: list[Counter[str]] = [Counter(), Counter()]
    for text, y in sorted(zip(texts, toxic.tolist(), strict=True), key=lambda x: -x[1]):
        words = set(words_of(text))
        # only words that three toxic texts share are told apart by label
        seen[y].update(words if y else [w for w in words if seen[1][w] >= 3])
    words = sorted(w for w, n in seen[1].items() if n >= 3 and len(w) >= 3)
    clean, bad = (np.array([seen[y][w] for w in words]) / total[y] for y in (0, 1))
    gain = (bad - clean) / np.sqrt(bad * (1 - bad) / total[1] + clean * (1 - clean) / total[0] + 1e-6)
    by_gain = [words[i] for i in np.lexsort((np.arange(len(words)), -np.round(gain, 9))) if gain[i] >= least_gain]
    by_share = [words[i] for i in np.lexsort((np.arange(len(words)), -clean))]
    chosen: list[str] = []
    for ranked, most in ((by_gain[: 40 * count], count), (by_share[: 20 * frequent], frequent)):
        room = len(chosen) + most
        for w in ranked:
            if len(chosen) < room and (not chosen or Landmarks.of(chosen).kernel([w]).max() < ALIKE):
                chosen.append(w)
    return chosen


def fit_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30, seed: int = 5) -> np.ndarray:
    """Weights (the last one is the bias) of a linear SVM with hinge loss, by dual coordinate descent. y: -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, alpha, q = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(axis=1)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * (w @ x[i]) - 1) / q[i], 0.0), cost[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def fit_platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b so that 1 / (1 + exp(-(a m + b))) fits the labels (0, 1), by Newton steps."""
    ab = np.array([1.0, 0.0])
    x = np.column_stack([margin, np.ones_like(margin)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - y) + 1e-3 * (ab - [1, 0]))
        ab = ab - step
        if np.abs(step).max() < 1e-8:
            break
    return float(ab[0]), float(ab[1])


def fit(texts: list[str], toxic: np.ndarray, toxic_share: float | None = None) -> ToxicityModel | None:
    """None without both labels. toxic_share: of all labelled documents, where the texts were drawn by label."""
    if not len(toxic) or toxic.min() == toxic.max():
        return None
    some = np.sort(np.concatenate([np.flatnonzero(toxic == y)[:LANDMARK_TEXTS] for y in (0, 1)]))
    landmarks = Landmarks.of(choose_landmarks([texts[i] for i in some], toxic[some]))
    value, vector = np.linalg.eigh(landmarks.kernel(landmarks.words))
    whiten = (vector / np.sqrt(np.maximum(value, RIDGE))) @ vector.T
    pooled = WordCache(landmarks, SMALL).pooled(texts)
    features = pooled @ whiten
    model = ToxicityModel(landmarks, whiten, features.mean(axis=0), features.std(axis=0) + 1e-3, np.zeros(1), (1.0, 0.0))
    x, y = (features - model.mean) / model.scale, 2.0 * toxic - 1
    share = toxic.mean() if toxic_share is None else toxic_share
    weight = np.where(toxic == 1, share / toxic.mean(), (1 - share) / (1 - toxic.mean()))
    cost = 0.02 * weight
    # margins for Platt scaling come from models that have not seen the text
    fold, out = np.arange(len(x)) % 4, np.zeros(len(x))
    for k in range(4):
        if len(set(toxic[fold != k])) == 2:
            w = fit_svm(x[fold != k], y[fold != k], cost[fold != k])
            out[fold == k] = x[fold == k] @ w[:-1] + w[-1]
    model.weights = fit_svm(x, y, cost)
    a, b = fit_platt(out, toxic.astype(float))
    model.platt = (max(a, 1e-3), b + float(np.log(share / (1 - share)) - np.log(toxic.mean() / (1 - toxic.mean()))))
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 3000, max_chars: int = 16384, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel | int:
    """A model from at most max_rows texts of either label, without held-out ids; or the only label there is (0 if none)."""
    one = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("z")).where("y = z").select("id", "y")
    counts = {r["y"]: r["count"] for r in one.groupBy("y").count().collect()}
    if len(counts) < 2:
        return next(iter(counts), 0)
    pick = lambda y: one.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    # ids of at most 2 max_rows documents are broadcast
    chosen = F.broadcast(pick(0).unionByName(pick(1)))
    rows = docs.where(F.length(text_col) <= max_chars).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id")
    # repeated rows of an id count once; an id with different texts has no label of its own
    rows = rows.groupBy("id", "y").agg(F.min("text").alias("text"), F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b")).where("a = b").select("id", "y", "text").toPandas()
    rows = rows.sort_values("id").sample(frac=1, random_state=1)
    toxic = rows["y"].to_numpy().astype(np.int64)
    got = fit(rows["text"].tolist(), toxic, counts[1] / (counts[0] + counts[1]))
    return got if got is not None else int(toxic[0]) if len(toxic) else 0


_CACHES: dict[str, WordCache] = {}


def add_scores(docs: DataFrame, model: ToxicityModel | int, text_col: str = "text", rows_at_once: int = 256) -> DataFrame:
    """docs with a last column `score`."""
    if isinstance(model, int):
        return docs.select("*", F.lit(float(model)).alias("score"))
    import uuid

    name = uuid.uuid4().hex

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from newsflow.llm import toxicity

        if name not in toxicity._CACHES:
            toxicity._CACHES.clear()
            toxicity._CACHES[name] = WordCache(model.landmarks)
        cache = toxicity._CACHES[name]
        for batch in texts:
            parts = [model.scores(cache.pooled(batch.iloc[a : a + rows_at_once].tolist())) for a in range(0, len(batch), rows_at_once)]
            yield pd.Series(np.concatenate(parts) if parts else [], dtype="float64")
        cache.shrink()

    return docs.select("*", score(F.col(f"`{text_col}`")).alias("score"))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """A row for each document: id_col, held_out, score, predicted."""
    scored = add_scores(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), train(docs, labels, id_col=id_col, text_col=text_col, **bounds))
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """docs without those that score at least the threshold."""
    cols = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)]).alias("row"), F.col(text_col).alias("text"))
    kept = add_scores(whole, train(docs, labels, id_col=id_col, text_col=text_col, **bounds)).where(F.col("score") < threshold)
    return kept.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(cols)])
