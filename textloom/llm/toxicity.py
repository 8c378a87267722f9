"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, trained from document labels."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.shared import drop_tables, held_out, least_hashes, slices, table, write_table

#: Labelled documents that the classifier is fitted on, at most: those with the smallest hashes of their ids.
TRAIN_ROWS = 8_000
#: Words that may carry a weight: those whose presence in a sentence is this much tied to the label (likelihood
#: ratio, two-sided 1 in 10,000), in at least so many different sentences; and a whole word
#: that differs from its beginning that much (1 in 100).
LEAST_TIE, LEAST_SENTENCES, LEAST_DIFFERENCE = 15.2, 3, 6.6
#: A word starts at the log odds of a toxic label in its sentences and this many average ones, and is pulled back there.
PRIOR = 10
#: Lengths of the beginnings of words.
PREFIXES = (8, 7, 6, 5, 4)
STEPS, RATE, DECAY = 300, 0.05, 1e-4
START_BIAS = -7.0
#: Without any toxic or any clean label there is nothing to learn; then every sentence has these log odds, and is clean.
NO_MODEL = -9.0


def sentences_of(text: str) -> list[tuple[int, str]]:
    """(start in code points, sentence): split after . ! ? and at line ends; at least one, which may be empty."""
    import re

    found = [(m.start(), m.group()) for m in re.finditer(r"[^.!?\n]+[.!?]*", text)]
    return found or [(0, "")]


def words_of(sentence: str) -> set[str]:
    import re

    return set(re.findall(r"\w+", sentence.lower()))


def features_of(word: str) -> list[str]:
    """What may carry a word's weight: the word itself (marked =) and its beginnings, which inflected forms share."""
    return ["=" + word, *(word[:n] for n in PREFIXES if len(word) >= n)]


class Lexicon:
    """Finds the feature of a word with the strongest tie to the label; on a tie the longest. Remembers words up to a bound."""

    def __init__(self, ties: dict[str, float], most: int = 100_000):
        self.ties, self.most, self.known = ties, most, {}

    def feature(self, word: str) -> str | None:
        if word not in self.known:
            if len(self.known) >= self.most:
                self.known.clear()
            found = [f for f in features_of(word) if f in self.ties]
            self.known[word] = max(found, key=lambda f: (self.ties[f], len(f))) if found else None
        return self.known[word]

    def features(self, sentence: str) -> set[str]:
        return {f for w in words_of(sentence) if (f := self.feature(w))}


def sentence_logits(sentences: list[tuple[int, str]], weights: dict[str, float], bias: float, lexicon: Lexicon) -> list[float]:
    """Log odds of each sentence: the bias and the weights of its distinct features."""
    return [bias + sum(weights[f] for f in sorted(lexicon.features(s))) for _, s in sentences]


def noisy_or(logits: list[float]) -> float:
    """Probability that at least one sentence is toxic: 1 - prod(1 - sigmoid(z))."""
    import math

    total = math.fsum(z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z)) for z in logits)
    return -math.expm1(-total)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """text and label of at most `most` labelled documents outside the held-out fold, one for each id; of rows repeated in
    id, the first by text, of repeated labels the greatest."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("label"))
    chosen = least_hashes(known, "_id", most)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id")
    return rows.groupBy("_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def loss_and_gradient(weight, at, col, sentence_doc, plain, label):
    """Mean negative log likelihood of document labels under noisy-or, and its gradient, each document's part of it cut at 10.

    weight: of features, then the bias. at, col: which sentence has which feature; sentence_doc: the document of each such
    sentence; plain: how many sentences of a document have none, and the bias alone for log odds.
    """
    import numpy as np

    docs, sentences = len(label), len(sentence_doc)
    sum_of = lambda where, values, n: np.bincount(where, values, n) if len(where) else np.zeros(n)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    z = weight[-1] + sum_of(at, weight[col], sentences)
    # A document is clean with the probability exp(-miss).
    miss = sum_of(sentence_doc, np.logaddexp(0, z), docs) + plain * np.logaddexp(0, weight[-1])
    bounded = np.clip(miss, 1e-9, 50)
    loss = np.where(label > 0, -np.log(-np.expm1(-bounded)), miss).mean()
    pull = np.maximum(np.where(label > 0, -1 / np.expm1(bounded), 1.0) / docs, -10.0)
    each = pull[sentence_doc] * sigmoid(z)
    return loss, np.append(sum_of(col, each[at], len(weight) - 1), each.sum() + (pull * plain).sum() * sigmoid(weight[-1]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_ROWS) -> tuple[dict[str, float], float, dict[str, float]]:
    """Weights of features, the bias and the features' ties. Executors count words and cut sentences; the driver sees word hashes of the sample alone.

    Two passes over the sample: the first counts in how many different sentences of toxic and of clean documents a word
    is and keeps those tied to the label; the second gives, for each sentence with such a word, their numbers. Gradient
    steps on the log likelihood of the document labels under noisy-or follow.
    """
    import numpy as np

    sample = write_table(training_rows(docs, labels, id_col, text_col, most).repartition(16, "_id"), "toxicity-train")
    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return {}, NO_MODEL, {}

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in slices(batches):
            seen: dict[tuple[bytes, bool], list[str]] = {}
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                for _, sentence in sentences_of(text or ""):
                    if words := words_of(sentence):
                        seen[sha256(" ".join(sorted(words)).encode()).digest(), label > 0] = sorted({f for w in words for f in features_of(w)})
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in seen], pa.binary()), pa.array([x for _, x in seen], pa.bool_()), pa.array(list(seen.values()), pa.list_(pa.string()))], names=["hash", "toxic", "words"])

    # Copies of a document would tie its every word to its label; a sentence counts once for each label.
    once = sample.mapInArrow(vocabulary, "hash binary, toxic boolean, words array<string>").groupBy("hash", "toxic").agg(F.first("words").alias("words"))
    once = write_table(once, "toxicity-sentences")
    of = {r["toxic"]: r["n"] for r in once.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = of.get(True, 0), of.get(False, 0)
    counted = once.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count_if("toxic").alias("toxic"), F.count_if(~F.col("toxic")).alias("clean"))
    n, share = bad + good, bad / max(1, bad + good)
    has, t = F.col("toxic") + F.col("clean"), F.col("toxic")
    term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    tie = 2 * (term(t, has * share) + term(F.col("clean"), has * (1 - share)) + term(bad - t, (n - has) * share) + term(good - F.col("clean"), (n - has) * (1 - share)))
    # A sample of bounded size has a bounded vocabulary; of it, a few words pass.
    seen = write_table(counted.where(has >= LEAST_SENTENCES).select("word", "toxic", "clean", has.alias("has"), tie.alias("tie")), "toxicity-words")
    tied = {r["word"]: (r["toxic"], r["has"], r["tie"]) for r in seen.where((F.col("has") < n) & (F.col("tie") >= LEAST_TIE)).collect()}
    rate = {f: (t + PRIOR * share) / (h + PRIOR) for f, (t, h, _) in tied.items()}
    ties = {f: tie for f, (_, _, tie) in tied.items()}
    # A whole word whose label differs from that of its beginning in general is told apart from it.
    begins = F.lit(False)
    for k in PREFIXES:
        begins = begins | F.substring("word", 2, k).isin([f for f in tied if f[0] != "=" and len(f) == k])
    for r in seen.where(F.col("word").startswith("=") & begins).collect():
        stem = max((f for f in features_of(r["word"][1:]) if f in tied and f[0] != "="), key=lambda f: (ties[f], len(f)))
        expected = min(max(rate[stem], 1e-6), 1 - 1e-6)
        differs = sum(2 * x * np.log(x / (r["has"] * p)) for x, p in ((r["toxic"], expected), (r["clean"], 1 - expected)) if x)
        if differs >= LEAST_DIFFERENCE:
            rate[r["word"]], ties[r["word"]] = (r["toxic"] + PRIOR * share) / (r["has"] + PRIOR), np.inf
    drop_tables(once, seen)
    words = sorted(rate)
    start = np.array([rate[w] for w in words])
    number = {w: k for k, w in enumerate(words)}

    def instances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(ties)
        for batch in slices(batches):
            marked, plain = [], []
            for text in batch.column("text").to_pylist():
                sets = [[number[f] for f in lexicon.features(s)] for _, s in sentences_of(text or "")]
                marked.append([sorted(x) for x in sets if x])
                plain.append(sum(not x for x in sets))
            yield pa.RecordBatch.from_arrays([batch.column("_id").cast(pa.string()), batch.column("label"), pa.array(marked, pa.list_(pa.list_(pa.int32()))), pa.array(plain, pa.int64())], names=["id", "label", "marked", "plain"])

    rows = sorted(sample.mapInArrow(instances, "id string, label int, marked array<array<int>>, plain long").collect(), key=lambda r: (r["id"], r["marked"]))
    drop_tables(sample)
    label = np.array([r["label"] > 0 for r in rows], float)
    plain = np.array([r["plain"] for r in rows], float)
    sentence_doc = np.array([d for d, r in enumerate(rows) for _ in r["marked"]], int)
    flat = [(s, w) for s, x in enumerate(x for r in rows for x in r["marked"]) for w in x]
    at, col = (np.array(x, int) for x in zip(*flat)) if flat else (np.empty(0, int), np.empty(0, int))
    first = np.log(start / (1 - start)) - START_BIAS
    weight = np.append(first, START_BIAS)
    m, v = np.zeros_like(weight), np.zeros_like(weight)
    for step in range(1, STEPS + 1):
        _, grad = loss_and_gradient(weight, at, col, sentence_doc, plain, label)
        grad += DECAY * np.append(weight[:-1] - first, 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        weight -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return {w: float(x) for w, x in zip(words, weight)}, float(weight[-1]), ties


def score_toxicity(docs: DataFrame, model: tuple[dict[str, float], float, dict[str, float]], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns of keep, score (0 to 1), worst_start and worst_length (code points of the worst sentence), n_offending.

    A sentence offends if it is toxic more likely than not. Texts are scored whole; nothing but the text is looked at.

    - Null and empty texts have one empty sentence, and so the lowest score but for words that speak against toxicity.
    - Repeated rows get equal scores; null ids are kept; no rows give no rows; clashing names of other columns do not matter.
    """
    weights, bias, ties = model
    own = [id_col, *keep]
    schema = docs.select(*[F.col(f"`{c}`") for c in own]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(ties)
        for batch in slices(batches):
            out: list[list] = [[], [], [], []]
            for text in batch.column(len(own)):
                text = text.as_py() or ""
                sentences = sentences_of(text)
                logits = sentence_logits(sentences, weights, bias, lexicon)
                worst = max(range(len(logits)), key=lambda k: (logits[k], -k))
                start, sentence = sentences[worst]
                for column, value in zip(out, (noisy_or(logits), start, len(sentence), sum(z > 0 for z in logits))):
                    column.append(value)
            arrays = [pa.array(x, kind) for x, kind in zip(out, (pa.float64(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(own))), *arrays], names=[*(f"c{k}" for k in range(len(own))), "score", "worst_start", "worst_length", "n_offending"])

    kinds = ", ".join([*(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(schema)), "score double, worst_start long, worst_length long, n_offending long"])
    scored = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(own)], F.col(f"`{text_col}`").alias("_text")).mapInArrow(run, kinds)
    return scored.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(own)], "score", "worst_start", "worst_length", "n_offending")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int")).select("doc_id", "held_out", "score", "predicted", "worst_start", "worst_length", "n_offending")


QUERIES = {"op6_toxicity": op6_toxicity}
