"""A quality classifier by votes of the nearest labelled texts in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import id_and_text, slices

#: Labelled texts at most, latent dimensions, neighbours that vote, and the score from which a text is predicted good.
SAMPLE, DIMENSIONS, NEIGHBOURS, GOOD = 4096, 64, 15, 0.7
#: Folds of an id's check sum, and the one that is held out.
FOLDS, HELD_OUT = 4, 2
#: Hashed terms of either family of runs of bytes, and places of the family of words: whether a word is the one before it
#: again, the share of different words among those of a piece, in tenths, and the number of words by its power of two.
HASHED, SAME, SHARES, LENGTHS, WORDS = 1024, 0, 2, 16, 64
SIZE = 2 * HASHED + WORDS
#: How much each family counts: runs of three bytes in small letters, runs of four kinds of characters, words.
WEIGHTS = (0.5, 1.0, 0.5)
#: Bytes of a text whose terms are counted at once, and texts whose products are made at once.
PIECE, BATCH = 1 << 16, 256
#: Rounds and spare columns of the search for the latent dimensions.
ROUNDS, SPARE = 6, 32


def _kinds() -> np.ndarray:
    """A byte's kind: small letter or part of a character beyond ASCII, capital, digit, blank, line break, or one of 26 kinds of other signs."""
    byte = np.arange(256)
    kind = 6 + byte % 26
    for k, inside in enumerate(((byte >= 97) & (byte <= 122) | (byte > 127), (byte >= 65) & (byte <= 90), (byte >= 48) & (byte <= 57), byte == 32, byte == 10), 1):
        kind[inside] = k
    return kind.astype(np.uint64)


LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)
KINDS = _kinds()


def _hashed(codes: np.ndarray) -> np.ndarray:
    """How many of the codes fall to each of HASHED places."""
    codes = codes * np.uint64(0x9E3779B97F4A7C15)
    codes = (codes ^ (codes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.bincount(((codes >> np.uint64(32)) % np.uint64(HASHED)).astype(np.int64), minlength=HASHED)


def term_counts(data: bytes) -> np.ndarray:
    """The counts of a text's terms, family after family. Pieces overlap by what a run needs, and are cut at blanks for words."""
    out = np.zeros(SIZE)
    for at in range(0, len(data), PIECE):
        b = np.frombuffer(data, np.uint8, min(PIECE + 3, len(data) - at), at)
        low, kind = LOWER[b[: PIECE + 2]], KINDS[b]
        out[:HASHED] += _hashed((low[:-2] << np.uint64(16)) + (low[1:-1] << np.uint64(8)) + low[2:])
        out[HASHED : 2 * HASHED] += _hashed((((kind[:-3] << np.uint64(5)) + kind[1:-2] << np.uint64(5)) + kind[2:-1] << np.uint64(5)) + kind[3:])
    words, at, n = out[2 * HASHED :], 0, 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        piece = data[at:end].split()
        if piece:
            again = sum(map(eq, piece[1:], piece))
            words[SAME] += again
            words[SAME + 1] += len(piece) - again
            words[SHARES + min(9, 10 * len(set(piece)) // len(piece))] += len(piece)
        n, at = n + len(piece), end
    words[LENGTHS + min(WORDS - LENGTHS - 1, (n + 1).bit_length() - 1)] += max(n, 1)
    return out


def weighted(counts: np.ndarray) -> np.ndarray:
    """Roots of the terms' shares in their family, so that a family has the same length in every text, times its weight."""
    out = np.empty(counts.shape, np.float32)
    for family, weight in zip((slice(0, HASHED), slice(HASHED, 2 * HASHED), slice(2 * HASHED, SIZE)), WEIGHTS, strict=True):
        own = counts[..., family]
        out[..., family] = weight * np.sqrt(own / np.maximum(own.sum(-1, keepdims=True), 1))
    return out


class Space:
    """The latent space of the labelled texts: their mean, the directions of the most variance, and their own places in it."""

    def __init__(self, terms: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS):
        self.labels, self.mean = labels.astype(np.float32), terms.mean(0)
        around = terms - self.mean
        # Subspace iteration: the directions of the largest singular values.
        start = np.random.default_rng(1).standard_normal((len(around), min(dimensions + SPARE, *around.shape))).astype(np.float32)
        basis = np.linalg.qr(around.T @ start)[0]
        for _ in range(ROUNDS):
            basis = np.linalg.qr(around.T @ (around @ basis))[0]
        turn = np.linalg.svd(around @ basis, full_matrices=False)[2]
        self.basis = np.ascontiguousarray((basis @ turn.T)[:, :dimensions])
        self.places = self.at(terms)

    def at(self, terms: np.ndarray) -> np.ndarray:
        """Unit vectors of texts."""
        out = (terms - self.mean) @ self.basis
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def votes(self, terms: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """The share of label 1 among the nearest labelled texts, each counted by its cosine. Of equal cosines (to five digits) the first count."""
        near = np.rint(self.at(terms) @ self.places.T * 1e5).astype(np.int64)
        n = len(self.labels)
        order = near * n - np.arange(n)
        k = min(neighbours, n)
        best = np.argpartition(-order, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, best, 1), 0).astype(float)
        total = weight.sum(1)
        return np.where(total > 0, (weight * self.labels[best]).sum(1) / np.maximum(total, 1), self.labels.mean())


def _held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, label) of at most `most` labelled texts outside the held-out fold, those of the least hashes of ids. Several labels of an id are averaged."""
    known = labels.where(~_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("label").alias("label")).where("label IS NOT NULL AND doc_id IS NOT NULL")
    return docs.select("doc_id").distinct().join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fitted(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, dimensions: int = DIMENSIONS) -> Space | None:
    """The space of a bounded sample; None without labelled texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            terms = [weighted(term_counts(x)).astype(np.float16).tobytes() for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(terms, pa.binary())], names=["doc_id", "label", "terms"])

    few = F.broadcast(sampled(docs, labels, most))  # `most` rows of two numbers
    rows = docs.join(few, "doc_id").select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label double, terms binary")
    # Ids may repeat, so the bound is set once more.
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("terms")).limit(most).collect()
    if not rows:
        return None
    return Space(np.stack([np.frombuffer(r.terms, np.float16) for r in rows]).astype(np.float32), np.array([r.label for r in rows]), dimensions)


def quality_votes(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS) -> DataFrame:
    """One row per text: (doc_id, held_out, score, predicted).

    Texts are vectors of hashed terms: short runs of bytes, runs of kinds of characters, and how words repeat. A bounded
    sample of at most `sample` labelled texts, none from the held-out fold, gives the latent space, their main directions
    of variance, and its vectors in it, which every task holds (a MB). Every text, in whole, is placed there, its cosine
    with every labelled text is taken in blocks, and the nearest ones vote, each with its cosine. No text is shuffled.
    The score depends on the text alone, so repeated rows get equal ones. Null and empty texts have a length as their only
    term and are scored like others; a null id stays null and is not held out; labels are joined by `id_col`, null ones are
    passed over and several of one id averaged; without any, every score is 0.5; an empty table gives no rows; other
    columns aren't read, whatever their names.
    """
    rows = id_and_text(docs, id_col, text_col)
    space = fitted(rows, labels.select(labels[id_col].alias("doc_id"), labels[label_col].alias("label")), sample, dimensions)
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches):
            scores = [np.zeros(0)]
            for at in range(0, batch.num_rows, BATCH):
                texts = batch.column(1).slice(at, BATCH).cast(pa.binary()).to_pylist()
                scores.append(np.full(len(texts), 0.5) if own is None else own.votes(weighted(np.stack([term_counts(x) for x in texts])), neighbours))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.round(np.concatenate(scores), 6))], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
