"""Toxicity by a weighted lexicon, matched by Aho-Corasick after folding.

Folding lower-cases, maps look-alike letters of other scripts to Latin and digits and signs that stand for letters to these. The lexicon
holds beginnings of folded words and whole words of two or three letters, weighted by their log-odds in labelled training texts, of which
equal ones count once; phrases in the list of exceptions cover what they contain. A text's score is logistic in the sum of its weights and in that sum by length.

Learning reads at most SAMPLE labelled training rows, chosen by a hash of their id; rows of the held-out fold are never among them. Labels,
ids, languages and sources are no inputs of a score.

Defined cases: a null, empty or clean text gets the base score; repeated rows get equal scores; without labelled training rows all scores
are the prior 0; an id that is null is not held out and has no label; a very long text is matched whole, in one pass; an empty table gives
no rows; extra columns are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored

#: Parameters of learning: labelled rows read at most, least toxic texts with an entry, least log-odds.
SAMPLE, LEAST_ROWS, LEAST_ODDS = 20_000, 5, 3.5
#: Letters of beginnings, and of words that are entries only as a whole (marked by a space at their end).
LENGTHS, WHOLE = range(4, 11), range(2, 4)

#: Letters that look like Latin ones, and what digits and signs stand for.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ε": "e", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ν": "v", "ι": "i", "κ": "k", "χ": "x",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ｌ": "l", "ո": "n", "ս": "u", "ց": "g", "օ": "o",
}
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
EXCEPTIONS = ("trash can", "trash bin", "class clown", "clown fish", "stupid mistake of mine")

_FOLD = {ord(k): v for k, v in (HOMOGLYPHS | LEET).items()} | {c: " " for c in (9, 10, 11, 12, 13)} | {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
_FOLD |= {0xFF41 + k: chr(97 + k) for k in range(26)}
_NAME = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """text as it is matched."""
    return text.lower().translate(_FOLD)


def held_out(id_col: Column, folds: int, fold_no: int) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold_no, F.lit(False))


def _count_beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            folded = fold(text.as_py() or "")
            for phrase in EXCEPTIONS:  # what they cover teaches nothing
                folded = folded.replace(phrase, " ")
            words = set(_NAME.findall(folded))
            (toxic if label else clean).update({w[:n] for w in words for n in LENGTHS if len(w) >= n} | {f"{w} " for w in words if len(w) in WHOLE})
    keys = [*{*toxic, *clean}]
    for a in range(0, len(keys), 50_000):
        part = keys[a : a + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([toxic[k] for k in part], pa.int64()), pa.array([clean[k] for k in part], pa.int64())], ["entry", "toxic", "clean"])


class Lexicon:
    """Weighted beginnings of words and exception phrases, compiled on first use in a process."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.weights, self.exceptions, self.automaton = weights, tuple(fold(e) for e in exceptions), None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"automaton": None}

    def found(self, text: str) -> tuple[float, int]:
        """The sum of weights and the number of words."""
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for word, weight in self.weights.items():
                self.automaton.add_word(word.rstrip(), (len(word.rstrip()), weight, word.endswith(" ")))
            for phrase in self.exceptions:
                self.automaton.add_word(phrase, (len(phrase), None, False))
            self.automaton.make_automaton()
        folded = fold(text)
        hits, safe = [], []
        if self.weights or self.exceptions:
            for end, (n, weight, whole) in self.automaton.iter(folded):
                start = end - n + 1
                if (start == 0 or not folded[start - 1].isalpha()) and not (whole and folded[end + 1 : end + 2].isalpha()):
                    (safe if weight is None else hits).append((start, end, weight))
        total, reach = 0.0, -1
        # Both by start: what a hit's exceptions reach to is the furthest end of those that start no later.
        safe.sort()
        k = 0
        for start, end, weight in sorted(hits):
            while k < len(safe) and safe[k][0] <= start:
                reach, k = max(reach, safe[k][1]), k + 1
            total += weight if end > reach else 0.0
        return total, len(folded.split())


def features(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    """1, the sum of weights and the sum by length, both on a log scale."""
    return np.stack([np.ones(len(total)), np.log1p(total), np.log1p(100 * total / np.maximum(words, 1))], axis=1)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method, with a ridge on all but the constant."""
    beta = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        move = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ beta)
        beta += np.clip(move, -4, 4)
        if np.abs(move).max() < 1e-8:
            break
    return beta


def learn(docs: DataFrame, labels: DataFrame, *, folds: int = 5, fold_no: int = 0, sample: int = SAMPLE) -> tuple[Lexicon, np.ndarray]:
    """The lexicon and the three coefficients. docs: doc_id, text; labels: doc_id, toxic."""
    train = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold_no)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = stored(train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "toxic-sample")
    # At most sample rows of two numbers: a proven bound for the broadcast.
    rows = stored(docs.select("doc_id", "text").join(F.broadcast(chosen.withColumnRenamed("doc_id", "__id")), F.col("doc_id") == F.col("__id")).groupBy("text").agg((F.max("toxic") == 1).alias("label")), "toxic-rows")
    n = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = n.get(True, 0), n.get(False, 0)
    if not n_toxic or not n_clean:
        return Lexicon({}), np.array([math.log((n_toxic + 1e-3) / (n_clean + 1)) if n_toxic + n_clean else -30.0, 0.0, 0.0])
    counts = rows.mapInArrow(_count_beginnings, "entry string, toxic bigint, clean bigint").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    best = counts.withColumn("odds", odds).where((F.col("toxic") >= LEAST_ROWS) & (F.col("odds") >= LEAST_ODDS)).orderBy(F.length("entry"), "entry")
    weights: dict[str, float] = {}
    for r in best.collect():  # of at most sample texts; shortest first: what begins with an entry needs none of its own
        if not any(r.entry[:k] in weights for k in LENGTHS):
            weights[r.entry] = float(r.odds)
    lexicon = Lexicon(weights)
    seen = rows.mapInArrow(_found(lexicon), "label boolean, total double, words bigint").toPandas()  # at most sample rows of three numbers
    return lexicon, fit(features(seen["total"].to_numpy(), seen["words"].to_numpy()), seen["label"].to_numpy().astype(float))


def _found(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [lexicon.found(t.as_py() or "") for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([m[0] for m in made], pa.float64()), pa.array([m[1] for m in made], pa.int64())], ["label", "total", "words"])

    return run


def _scored(lexicon: Lexicon, beta: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([lexicon.found(t.as_py() or "") for t in batch.column("text")], dtype=np.float64).reshape(-1, 2)
            p = 1 / (1 + np.exp(-np.clip(features(made[:, 0], made[:, 1]) @ beta, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, fold_no: int = 0, sample: int = SAMPLE) -> DataFrame:
    """Per row of docs: doc_id, held_out, score and predicted."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lexicon, beta = learn(docs, labels, folds=folds, fold_no=fold_no, sample=sample)
    return docs.withColumn("held_out", held_out(F.col("doc_id"), folds, fold_no)).mapInArrow(_scored(lexicon, beta), "doc_id bigint, held_out boolean, score double, predicted int")
