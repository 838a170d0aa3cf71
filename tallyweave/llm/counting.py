"""Token counts by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tallyweave.llm.common import id_and_text, slices

#: Pieces whose counts a worker remembers; beyond it starts anew.
REMEMBERED = 600_000
#: Counts by vocabulary and pattern; they last from task to task of one worker.
KNOWN: dict[tuple[str, str], dict[str, int]] = {}
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class Merges:
    """The merge table of a byte-level BPE vocabulary as sorted arrays: pair key, rank, merged id."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            tokenizer = json.load(f)
        vocab, merges = tokenizer["model"]["vocab"], tokenizer["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.uint64)
        self.order = np.argsort(keys)
        self.keys, self.made = keys[self.order], np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.first = np.zeros(256, np.int64)
        for letter, byte in byte_letters().items():
            self.first[byte] = vocab[letter]
        specials = [x["content"] for x in tokenizer["added_tokens"]]
        self.specials = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols that survive in each piece. All pieces of the batch take their lowest-rank pair in the same round."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbols = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        result = lengths.copy()
        none = np.int64(len(self.keys))
        while len(symbols) > 1:
            key = (symbols[:-1].astype(np.uint64) << np.uint64(32)) | symbols[1:].astype(np.uint64)
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            rank = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.order[at], none)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            low = np.minimum.reduceat(np.r_[rank, none], starts)  # a sequence's last symbol has no pair of its own
            per = np.repeat(low, np.diff(np.r_[starts, len(symbols)]))
            hit = (np.r_[rank, none] == per) & (per < none)
            # Of overlapping pairs (a run such as "aaaa") every second one is taken, from the left.
            idx = np.arange(len(symbols))
            run_start = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], idx, 0))
            hit &= (idx - run_start) % 2 == 0
            symbols[hit] = self.made[per[hit]]
            keep = ~np.r_[False, hit[:-1]]
            np.subtract.at(result, owner[~keep], 1)
            keep &= per < none  # a sequence without a pair is done
            symbols, owner = symbols[keep], owner[keep]
        return result


@lru_cache(maxsize=2)
def merges_of(path: str) -> Merges:
    return Merges(path)


def count_batch(texts: list[str], merges: Merges, split, known: dict[str, int]) -> list[int]:
    """Tokens of each text. A special string counts as one token and parts the text, as the library's default does.

    Added tokens' own flags (stripping blanks beside them, whole words alone) are taken as unset, as in the given vocabularies.
    """
    cut, extra = [], []
    for text in texts:
        if merges.specials is not None and merges.specials.search(text):
            parts = merges.specials.split(text)
            cut.append([p for part in parts for p in split(part)])
            extra.append(len(parts) - 1)
        else:
            cut.append(split(text))
            extra.append(0)
    new = set().union(*cut)
    if len(known) + len(new) > REMEMBERED:
        known.clear()
    else:
        new -= known.keys()
    if new:
        pieces = list(new)
        known.update(zip(pieces, merges.counts([p.encode() for p in pieces]).tolist(), strict=True))
    get = known.__getitem__
    return [sum(map(get, pieces)) + more for pieces, more in zip(cut, extra, strict=True)]


def token_counts(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per input row with the bytes and tokens of its text and whether the tokens exceed `limit`.

    `vocabulary` is the path of a byte-level BPE tokenizer's JSON file, read by each worker. Null and empty texts have no
    tokens; a null id stays null; repeated rows are counted one by one; an empty table gives no rows. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        merges, split, known = merges_of(vocabulary), regex.compile(pattern).findall, KNOWN.setdefault((vocabulary, pattern), {})
        for batch in slices(batches, most_bytes=2 << 20):
            texts = batch.column(1).to_pylist()
            n = pa.array(count_batch(texts, merges, split, known), pa.int64())
            sizes = pc.binary_length(batch.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), sizes, n, pc.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, SCHEMA)
