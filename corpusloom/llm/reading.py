"""Reading level of documents by label propagation over a graph of documents and words.

Documents and the words they hold form a bipartite graph. Graded examples are clamped to their level, and levels spread
by harmonic iterations: a word's level is the weighted mean over its documents, with graded documents counting most; a
document's level is the weighted mean over its words, where words that occur on few levels count most. Words are hashed
into ``BUCKETS`` buckets, so that the words' side of the graph has a fixed size and can be sent to every task; the
documents' side stays distributed. Cuts between levels are set where the graded documents are told apart best.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Hash buckets of words (a broadcast of 2 MB), and weight of a document that has no label.
BUCKETS, UNLABELLED = 1 << 18, 0.1
#: Iterations end when levels of words move by less than this on average, each word counted by its documents, or after so many.
TOLERANCE, MAX_ROUNDS = 0.01, 40
#: A word's spread of levels is taken for at least this; documents a word must have to be an edge between documents.
LEAST_SPREAD, LEAST_DOCS = 0.05, 2
#: Share of a text's words that must be frequent English ones; the graded texts have 0.15 to 0.5.
ENGLISH_SHARE = 0.04
WORDS = re.compile(r"[^\W\d_]+")
ASCII_WORDS = re.compile(r"[a-z]+")
#: Frequent words by which languages written in Latin letters are told apart.
STOPWORDS = {
    "en": "the of and to in is that it for with as are this be by on not or from when if each any an you no has have its which was will can at all every hence into",
    "de": "der die das und ist nicht ein eine einen einer zu den dem des mit für auf wird werden sich sie es im von wenn noch beim oder aber auch als nach bei zum zur",
    "fr": "le la les des une et est dans pour que qui sur pas plus par avec ce cette ces au aux du il elle en ne se si sont lorsque déjà un puis aucune",
    "es": "el los las una y es en para que por con del al se no un como más su sus este esta cuando lo está si ya todavía primero",
    "it": "il gli della di che per con una non del nel sono alla questo quando se è più dei delle",
    "pt": "os uma não para com por dos das no na ao um que se é mais quando esta este",
    "nl": "het een van en niet met voor op zijn wordt als bij naar ook dat deze wanneer de",
}
LANGUAGE_OF = {}
for _language, _words in STOPWORDS.items():
    for _word in _words.split():
        LANGUAGE_OF.setdefault(_word, []).append(_language)


def is_english(counts: Counter, letters: int) -> bool:
    """Whether words of these counts are English: Latin letters, enough of its frequent words, and more than of any other language."""
    seen: Counter = Counter()
    for word in LANGUAGE_OF.keys() & counts.keys():
        for language in LANGUAGE_OF[word]:
            seen[language] += counts[word]
    latin = sum(n * len(w) for w, n in counts.items() if w.isascii())
    if not latin or latin < 0.6 * letters:
        return False
    others = max((n for language, n in seen.items() if language != "en"), default=0)
    return seen["en"] > others and seen["en"] >= ENGLISH_SHARE * counts.total()


_BUCKET: dict[str, int] = {}


def _bucket(word: str) -> int:
    known = _BUCKET.get(word)
    if known is None:
        if len(_BUCKET) > 300_000:
            _BUCKET.clear()
        known = _BUCKET[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)
    return known


def word_graph(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, english, words, weights) of each document: its edges to word buckets. Null texts have none."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = _bucket
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                english, words, weights, ends = [], [], [], [0]
                for t in batch.column(1).to_pylist():
                    t = (t or "").lower()
                    counts = Counter((ASCII_WORDS if t.isascii() else WORDS).findall(t))
                    mine = is_english(counts, sum(n * len(w) for w, n in counts.items()))
                    english.append(mine)
                    if mine:
                        merged: dict[int, int] = {}
                        for w, n in counts.items():
                            b = bucket(w)
                            merged[b] = merged.get(b, 0) + n
                        words += merged
                        weights += merged.values()
                    ends.append(len(words))
                offsets = pa.array(ends, pa.int32())
                columns = [batch.column(0), pa.array(english), pa.ListArray.from_arrays(offsets, pa.array(words, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(1 + np.log(np.array(weights, np.float64)), pa.float32()))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "english", "words", "weights"])

    kind = dict(documents.dtypes)[key]
    return documents.select(key, text).mapInArrow(edges, f"key {kind}, english boolean, words array<int>, weights array<float>")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges of a batch: row, word, weight; and each row's level, NaN for none."""
    words = batch.column(1)
    sizes = np.diff(words.offsets.to_numpy())
    rows = np.repeat(np.arange(batch.num_rows), sizes)
    return rows, words.flatten().to_numpy(), batch.column(2).flatten().to_numpy().astype(np.float64), batch.column(3).to_numpy(zero_copy_only=False).astype(np.float64)


def _document_levels(rows: np.ndarray, words: np.ndarray, weights: np.ndarray, n: int, state: np.ndarray | None, prior: float) -> np.ndarray:
    if state is None:
        return np.full(n, prior)
    w = weights * state[1][words]
    total = np.bincount(rows, weights=w, minlength=n)
    return np.where(total > 0, np.bincount(rows, weights=w * state[0][words], minlength=n) / np.where(total > 0, total, 1), prior)


def levels(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "level") -> DataFrame:
    """(key, english, score, level) of each document: level 1 to 5, null for documents that are not English.

    ``labels`` (key, level) may repeat keys with different levels, which count as their mean; labels that are null, or
    of unknown keys, are ignored. Labelled documents get the level of the graph, as single labels may be wrong. Without
    labels all levels are 3. Empty and null texts are not English. Repeated rows of a key count once.
    """
    graded = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.avg(label).alias("graded"))
    graph = word_graph(documents.where(F.col(key).isNotNull()), key, text)
    edges = materialize(graph.join(graded, "key", "left"), "reading")
    english = edges.where("english").select("key", "words", "weights", "graded")
    prior = english.agg(F.avg("graded")).first()[0]
    prior = 3.0 if prior is None else float(prior)
    spark = documents.sparkSession
    state = None
    for _ in range(MAX_ROUNDS):
        sent = spark.sparkContext.broadcast(state)

        def spread(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((4, BUCKETS))
            for batch in batches:
                rows, words, weights, graded = _flat(batch)
                known = ~np.isnan(graded)
                level = np.where(known, graded, _document_levels(rows, words, weights, batch.num_rows, sent.value, prior))
                trust = np.where(known, 1.0, UNLABELLED if sent.value is not None else 0.0)
                w = weights * trust[rows]
                x = level[rows]
                for k, values in enumerate((w, w * x, w * x * x, None)):
                    sums[k] += np.bincount(words, weights=values, minlength=BUCKETS)
            held = np.flatnonzero(sums[3])
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), *[pa.array(s[held]) for s in sums]], ["word", "w", "x", "xx", "n"])

        words = english.mapInArrow(spread, "word int, w double, x double, xx double, n double").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("w", "x", "xx", "n")])
        got = words.toArrow()  # at most BUCKETS rows
        before, state = state, np.zeros((2, BUCKETS), np.float32)
        at = got["word"].to_numpy()
        w, x, xx, n = (got[c].to_numpy() for c in ("w", "x", "xx", "n"))
        some = (w > 0) & (n >= min(LEAST_DOCS, n.max(initial=0)))
        mean = np.where(w > 0, x / np.where(w > 0, w, 1), prior)
        var = np.maximum(np.where(w > 0, xx / np.where(w > 0, w, 1), 0) - mean * mean, 0)
        state[0][at] = mean
        state[1][at] = np.where(some, (LEAST_SPREAD + var) ** -0.5, 0)
        sent.unpersist()
        if before is not None:
            moved = np.abs(state[0][at] - before[0][at]) * n * some
            if moved.sum() <= TOLERANCE * max(1.0, (n * some).sum()):
                break
    sent = spark.sparkContext.broadcast(state)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, words, weights, _ = _flat(batch)
            found = _document_levels(rows, words, weights, batch.num_rows, sent.value, prior)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), batch.column(3), batch.column(4)], ["key", "score", "graded", "english"])

    kind = dict(edges.dtypes)["key"]
    scored = edges.select("key", "words", "weights", "graded", "english").mapInArrow(score, f"key {kind}, score double, graded double, english boolean")
    table = scored.where("english and graded is not null").groupBy(F.floor(F.col("score") * 100).cast("int").alias("bin"), F.round(F.col("graded")).cast("int").alias("graded")).count()
    cuts = best_cuts([(r[0], r[1], r[2]) for r in table.collect()])  # at most 5 rows for each hundredth of a level
    level = F.lit(1)
    for cut in cuts:
        level = level + F.when(F.col("score") >= cut, 1).otherwise(0)
    one = scored.groupBy("key").agg(F.max("english").alias("english"), F.max("score").alias("score"))
    return one.select(F.col("key").alias(key), "english", F.when(F.col("english"), F.col("score")).alias("score"), F.when(F.col("english"), level).cast("int").alias("level"))


def best_cuts(table: list[tuple[int, int, int]], top: int = 5) -> list[float]:
    """For each level above 1 the score from which on it begins: where the fewest graded documents fall on the wrong side.

    ``table`` has (hundredths of score, level, documents). Among equally good cuts, the middle.
    """
    cuts: list[float] = []
    if not table:
        return [k + 0.5 for k in range(1, top)]
    low, high = min(t[0] for t in table), max(t[0] for t in table) + 1
    for k in range(2, top + 1):
        above, below = np.zeros(high - low + 1), np.zeros(high - low + 1)
        for at, level, n in table:
            (above if level >= k else below)[at - low] += n
        wrong = np.concatenate([[0], np.cumsum(above)])[:-1] + (below.sum() - np.concatenate([[0], np.cumsum(below)])[:-1])
        good = np.flatnonzero(wrong == wrong.min())
        runs = np.split(good, np.flatnonzero(np.diff(good) > 1) + 1)
        run = max(runs, key=len)
        cuts.append(max([*cuts[-1:], (low + (run[0] + run[-1]) / 2) / 100]))
    return cuts
