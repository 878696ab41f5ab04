"""Quality classifier: supervised subword embeddings.

Each word has a learned vector for its own hash and one for each of its character n-grams (3 to 5 bytes, with marks at the
word's ends), all in hashed tables; a word is their mean. Word bigrams have hashed vectors too, in which a word that repeats
the one before it is written as a mark. A document is the mean of its words plus the mean of its bigrams, and a softmax over two classes
follows. Vectors and output weights are trained together by stochastic gradient descent in numpy. As the document vector is
a mean and the output is linear, the trained model folds into one number for each hashed feature, which is what executors
get (``BUCKETS`` floats, a fixed size).

Defined results: a null, empty or wordless text scores the bias alone; very long texts are read whole; equal texts have
equal scores, and a score of exactly ``MIN_SCORE`` is predicted 1; labels count once per doc_id (the least quality
wins where they differ) and null labels not at all; repeated rows are scored one by one; without labelled rows of both
classes the score is the share of label 1 (0.5 without any); labels, lang, source and doc_id are never inputs.

Training takes at most ``SAMPLE_ROWS`` labelled rows (whole texts), those with the smallest hash of the id, so the driver's
share is bounded; scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import mapped
from strandline.llm.words import BLANK_SEPARATED, U, Words, chunks, mix, powers

BUCKETS, DIMENSIONS, GRAMS, SAMPLE_ROWS, FOLDS = 1 << 17, 8, (3, 4, 5), 3_000, 5
EPOCHS, RATE, BATCH, BOOST = 6, 0.3, 32, 20.0
MIN_SCORE = 0.3
#: The hashes of two marks: the start of a text, and a word once more.
START, AGAIN = U(0x51), U(0xA6)
_A = U(0xD6E8FEB86659FD93)


def word_features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of a chunk: (place of each word among them, features, where each word's features start, their number)."""
    h = words.hashes()
    _, one, place = np.unique(h, return_index=True, return_inverse=True)
    start, lens = words.start[one], words.lens[one]
    at = np.concatenate([[0], np.cumsum(lens + 2)])
    local = np.arange(at[-1]) - np.repeat(at[:-1], lens + 2)
    source = np.clip(np.repeat(start - 1, lens + 2) + local, 0, max(0, len(words.data) - 1))
    last = np.repeat(lens + 1, lens + 2)
    data = np.where(local == 0, U(2), np.where(local == last, U(3), words.data[source].astype(U) + U(8)))
    grams, owners = [mix(h[one] ^ U(77))], [np.arange(len(one))]
    owner = np.repeat(np.arange(len(one)), lens + 2)
    run = data
    for k in range(2, max(GRAMS) + 1):
        run = run[:-1] * _A + data[k - 1 :] if len(run) > 1 else run[:0]
        if k in GRAMS and len(run):
            whole = owner[: len(run)] == owner[k - 1 :]
            grams.append(mix(run[whole] + U(k)))
            owners.append(owner[: len(run)][whole])
    features, owners = np.concatenate(grams) & U(BUCKETS - 1), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=len(one))
    return place, features[order].astype(np.int64), np.cumsum(counts) - counts, counts


def bigrams(words: Words, h: np.ndarray) -> np.ndarray:
    """The hashed feature of the bigram that ends at each word; the first word of a text follows a mark, and a word that repeats the one before it is another mark, whatever the word."""
    before = np.full(len(h), START)
    same_text = words.doc[1:] == words.doc[:-1]
    before[1:][same_text] = h[:-1][same_text]
    pair = mix(mix(before) * _A + h + U(2))
    pair[before == h] = mix(np.array([AGAIN]))[0]
    return (pair & U(BUCKETS - 1)).astype(np.int64)


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The features of a document and their weights: those of its words sum to one, and so do those of its bigrams."""
    data = np.frombuffer(text.encode(), np.uint8)
    words = Words(data, np.array([0, len(data)]), BLANK_SEPARATED)
    if not len(words.start):
        return np.empty(0, np.int64), np.empty(0)
    place, features, _, counts = word_features(words)
    share = np.bincount(place, minlength=len(counts)) / len(place) / counts
    pairs = bigrams(words, words.hashes())
    found, inverse = np.unique(np.concatenate([features, pairs]), return_inverse=True)
    return found, np.bincount(inverse, weights=np.concatenate([np.repeat(share, counts), np.full(len(pairs), 1 / len(pairs))]))


def train(texts: list[str], labels: np.ndarray, seed: int = 5) -> tuple[np.ndarray, float]:
    """The folded model: a number for each feature, and the bias; a document's logit is their weighted mean plus the bias."""
    n, ones = len(labels), int(labels.sum())
    if not n or ones in (0, n):
        share = min(max(ones / n, 1e-6), 1 - 1e-6) if n else 0.5
        return np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    batches = []
    for at in range(0, n, BATCH):
        rows = order[at : at + BATCH]
        docs = [document_features(texts[r]) for r in rows]
        size = np.array([len(x[0]) for x in docs])
        distinct, inverse = np.unique(np.concatenate([x[0] for x in docs]), return_inverse=True)
        batches.append((distinct, inverse, np.concatenate([x[1] for x in docs]), np.repeat(np.arange(len(rows)), size), np.eye(2)[labels[rows]]))
    vectors = rng.uniform(-0.5, 0.5, (BUCKETS, DIMENSIONS)) / DIMENSIONS
    output, bias = rng.normal(0, 0.5, (DIMENSIONS, 2)), np.array([np.log(1 - ones / n), np.log(ones / n)])
    steps, total = 0, EPOCHS * len(batches)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(batches)):
            distinct, inverse, weight, owner, target = batches[i]
            rate = RATE * (1 - steps / total)
            steps += 1
            own = vectors[distinct]
            hidden = np.stack([np.bincount(owner, weights=own[inverse, d] * weight, minlength=len(target)) for d in range(DIMENSIONS)], 1)
            logit = hidden @ output + bias
            error = np.exp(logit - logit.max(1, keepdims=True))
            error = error / error.sum(1, keepdims=True) - target
            # steps in proportion to what a document's features can bear: short texts have few and heavy ones
            heavy = np.bincount(owner, weights=weight * weight, minlength=len(target))
            back = (error @ output.T) * (rate * np.minimum(BOOST, 0.5 / np.maximum(heavy, 1e-9)))[:, None] / max(1.0, float((output * output).sum()) / DIMENSIONS)
            output -= rate * (hidden.T @ error) / (1 + float((hidden * hidden).sum(1).mean()) * len(target))
            bias -= rate * error.mean(0)
            vectors[distinct] = own - np.stack([np.bincount(inverse, weights=back[owner, d] * weight, minlength=len(distinct)) for d in range(DIMENSIONS)], 1)
    return (vectors @ (output[:, 1] - output[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def remainder(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """Trains on labelled rows whose fold is not 0."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    sample = documents.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label")
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rows).toArrow()
    return train(sample.column("text").to_pylist(), (np.array(sample.column("label").to_pylist(), int) > 0).astype(int))


def scored(documents: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and score (0 to 1) for each row of documents."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded, bias = shared.value
        for batch in batches:
            out = []
            for lo, hi, data, off in chunks(batch.column(1)):
                words = Words(data, off, BLANK_SEPARATED)
                logit = np.full(hi - lo, bias)
                if len(words.start):
                    place, features, starts, counts = word_features(words)
                    value = np.add.reduceat(folded[features].astype(float), starts) / counts
                    logit += np.bincount(words.doc, weights=value[place] + folded[bigrams(words, words.hashes())], minlength=hi - lo) / np.maximum(words.counts, 1)
                out.append(1 / (1 + np.exp(-logit)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.empty(0))], names=["doc_id", "score"])

    return mapped(documents.select("doc_id", "text"), step, f"doc_id {dict(documents.dtypes)['doc_id']}, score double")


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of documents."""
    out = scored(documents, fit(documents, labels))
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= MIN_SCORE).cast("int").alias("predicted"))
