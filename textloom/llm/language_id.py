"""Language identification: known words by their frequencies, unseen ones by ever shorter n-grams."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.shared import drop_tables, held_out, least_hashes, per_worker, slices, table, write_table

#: Labelled documents that the model is fitted on, at most: those with the smallest hashes of their ids.
TRAIN_ROWS = 8_000
#: Words and n-grams that the sample has so often in a language are learnt, every one of them.
LEAST_SEEN = 2
LONGEST = 5
SMOOTHING = 0.5
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    import re

    return re.findall(r"[^\W\d_]+", text.lower())


def grams_of(word: str, n: int) -> list[str]:
    """n-grams of the word between marks of its ends, n counted without them for n = 1."""
    marked = f"^{word}$"
    return list(word) if n == 1 else [marked[k : k + n] for k in range(len(marked) - n + 1)]


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, most: int) -> DataFrame:
    """text and lang of at most `most` documents with a language outside the held-out fold, one for each id; of rows
    repeated in id, the first by language, then by text."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    ids = least_hashes(known.select(F.col(id_col).alias("_id")).distinct(), "_id", most)
    rows = known.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).join(F.broadcast(ids), "_id")
    return rows.groupBy("_id").agg(F.min(F.struct("lang", "text")).alias("first")).select("first.text", "first.lang")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_ROWS) -> list[tuple[str, str, int]]:
    """(entry, language, count): entries are words after "=" and n-grams after their length. Held-out documents are not read.

    What the sample says often enough is learnt, so the sample's bound is the model's bound too. Words are counted by
    executors; texts never meet in one task.
    """
    chosen = training_rows(docs, id_col, text_col, lang_col, most).repartition(16)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            seen: dict[str, Counter] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                seen.setdefault(lang, Counter()).update(words_of(text))
            rows: Counter = Counter()
            for lang, words in seen.items():
                for w, n in words.items():
                    rows["=" + w, lang] += n
                    for k in range(1, LONGEST + 1):
                        for g in grams_of(w, k):
                            rows[f"{k}{g}", lang] += n
            yield pa.RecordBatch.from_arrays([pa.array([e for e, _ in rows], pa.string()), pa.array([lang for _, lang in rows], pa.string()), pa.array(list(rows.values()), pa.int64())], names=["entry", "lang", "n"])

    counts = write_table(chosen.mapInArrow(count, "entry string, lang string, n long").groupBy("entry", "lang").agg(F.sum("n").alias("n")), "language-counts")
    model = sorted(tuple(r) for r in counts.where(F.col("n") >= LEAST_SEEN).collect())
    drop_tables(counts)
    return model


class Scorer:
    """Log probabilities of words by language; remembers words up to a bound."""

    def __init__(self, model: list[tuple[str, str, int]], most_words: int = 150_000):
        import numpy as np

        self.langs = sorted({lang for _, lang, _ in model})
        self.most_words = most_words
        place = {lang: k for k, lang in enumerate(self.langs)}
        counts: dict[str, np.ndarray] = {}
        for entry, lang, n in model:
            if entry not in counts:
                counts[entry] = np.zeros(len(self.langs))
            counts[entry][place[lang]] = n
        total: dict[str, np.ndarray] = {}
        kinds: Counter = Counter()
        for entry, c in counts.items():
            total[entry[0]] = total.get(entry[0], 0) + c
            kinds[entry[0]] += 1
        self.logs = {e: np.log((c + SMOOTHING) / (total[e[0]] + SMOOTHING * kinds[e[0]])) for e, c in counts.items()}
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.langs)))

    def word(self, word: str):
        """The word's own log probabilities, or the mean of those of its longest known n-grams, or None."""
        import numpy as np

        if "=" + word in self.logs:
            return self.logs["=" + word]
        for n in range(LONGEST, 0, -1):
            found = [x for g in grams_of(word, n) if (x := self.logs.get(f"{n}{g}")) is not None]
            if found:
                return np.mean(found, axis=0)
        return None

    def row(self, word: str) -> int:
        import numpy as np

        k = self.rows.get(word)
        if k is None:
            k = len(self.rows)
            if k >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            logs = self.word(word)
            self.table[k] = 0 if logs is None else logs
            self.rows[word] = k
        return k

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, probability). A word counts by the logarithm of how often it occurs, so that no repeated word decides alone."""
        import numpy as np

        if not text or not self.langs or not any(c.isalpha() for c in text):
            return UNKNOWN, 0.0
        if len(self.rows) > self.most_words:
            self.rows.clear()
        words = Counter(words_of(text))
        if not words:
            return UNKNOWN, 0.0
        at = np.fromiter((self.row(w) for w in words), int, len(words))
        often = np.log1p(np.fromiter(words.values(), float, len(words)))
        logs = often @ self.table[at]
        odds = np.exp(logs - logs.max())
        best = int(np.argmax(logs))
        return self.langs[best], float(odds[best] / odds.sum())


def identify_language(docs: DataFrame, model: list[tuple[str, str, int]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score. Whole texts are scored; nothing but the text is looked at.

    - Null texts and texts without a letter, and all texts if nothing was learnt, are `und` with score 0.
    - Equal texts get equal results; ties go to the language first in order. Null ids are kept, repeated rows repeated.
    - No rows give no rows; other columns are ignored, whatever their names.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    key = uuid.uuid4().hex
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = per_worker(f"language {key}", lambda: Scorer(held.value))
        for batch in slices(batches):
            found = [scorer.predict(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["id", "lang_pred", "score"])

    out = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify_language(docs, fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_language_id": op8_language_id}
