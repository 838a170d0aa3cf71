"""Quality rules by compression bands."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyweave.llm.common import id_and_text, slices

#: (bytes of text from, least ratio, greatest ratio) for whole documents: compressed bytes over bytes. Short texts carry
#: the frame and an untrained entropy coder, so their ratios run higher and their band is wider: a text of 10 bytes that
#: doesn't repeat takes 19 to 23, one of 50 bytes about 50 to 63.
BANDS = ((0, 0.9, 20.0), (10, 0.8, 2.4), (25, 0.6, 1.6), (50, 0.5, 1.3), (100, 0.40, 1.10), (200, 0.36, 1.00), (400, 0.28, 0.90), (800, 0.24, 0.80), (3200, 0.20, 0.75), (12800, 0.16, 0.70))
#: Bytes of a fixed chunk (the last of a text is what is left), how much wider a chunk's band is than that of a document of
#: its length, and the share of a text's bytes in chunks outside their band that rejects it.
CHUNK, CHUNK_LOW, CHUNK_HIGH, CHUNK_SHARE = 4096, 0.7, 1.07, 0.5
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
SPACES, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, chunks_outside long, n_chunks long"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of words found twice or more. Windows with equal 64-bit sums are compared word by word."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    sums = np.zeros(n, np.uint64)
    for j in range(window):
        sums = sums * np.uint64(0x9E3779B97F4A7C15) + (hashes[j : j + n] ^ (hashes[j : j + n] >> np.uint64(29)))
    _, inverse, counts = np.unique(sums, return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[inverse] > 1).tolist()
    if not at:
        return 0
    found = Counter(tuple(words[i : i + window]) for i in at)
    edges = np.zeros(len(words) + 1, np.int64)
    for i in at:
        if found[tuple(words[i : i + window])] > 1:
            edges[i] += 1
            edges[i + window] -= 1
    return int((np.cumsum(edges[:-1]) > 0).sum())


def band(n: int) -> tuple[float, float]:
    """The limits of the ratio for a text of n bytes."""
    return next((low, high) for start, low, high in reversed(BANDS) if n >= start)


def measure(text: str, compress) -> tuple:
    """The counts and the verdict of one text, in the order of SCHEMA from n_words on."""
    data = text.encode()
    words = data.split()  # bytes split at exactly \x20 and \x09-\x0D
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeated = repeated_words(words)
    failed = len(words) < LEAST_WORDS or 100 * repeated > MOST_REPEATED * len(words)
    ratio = len(compress(data)) / len(data) if data else 0.0
    low, high = band(len(data))
    outside = bytes_outside = 0
    for i in range(0, len(data), CHUNK):
        chunk = data[i : i + CHUNK]
        least, most = band(len(chunk))
        if not CHUNK_LOW * least <= len(compress(chunk)) / len(chunk) <= CHUNK_HIGH * most:
            outside, bytes_outside = outside + 1, bytes_outside + len(chunk)
    kept = not failed and low <= ratio <= high and bytes_outside <= CHUNK_SHARE * len(data)
    chars = len(text) - sum(map(text.count, SPACES))
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, failed, kept, ratio, outside, -(-len(data) // CHUNK)


def compression_bands(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = 3) -> DataFrame:
    """One row per input row: word and line counts, the zstandard ratio of the whole text and of fixed chunks, and a verdict.

    A text is kept if it passes the base rules (enough words, few repeated windows), its ratio lies in the band for its
    length, and no more than half of its bytes lie in chunks outside the band for the chunk's length; every byte lies in a
    chunk, the last of which is shorter. Null and empty texts have no words, no chunks and ratio zero, and fail; a null id stays null; repeated rows are judged one by one; an empty table gives no rows. Row by row, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=level).compress
        for batch in slices(batches):
            rows = [measure(text, compress) for text in batch.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2
            arrays = [batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in SCHEMA.split(", ")])

    return id_and_text(df, id_col, text_col).mapInArrow(run, SCHEMA)


def passing(df: DataFrame, text_col: str = "text", level: int = 3) -> DataFrame:
    """The rows of `df`, with all its columns, whose texts `compression_bands` keeps. No shuffle.

    Null and empty texts fail and go; rows of null or equal ids are judged one by one by their own texts, so repeated rows
    stay or go together; no other column is read, whatever its name; an empty table gives no rows.
    """
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=level).compress
        kept = [x.split()[0] for x in SCHEMA.split(", ")].index("kept") - 1
        for batch in slices(batches, text_col):
            yield batch.filter(pa.array([measure(text or "", compress)[kept] for text in batch.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)
