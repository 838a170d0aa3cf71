"""Byte-level BPE encoding by dynamic programming over byte prefixes, and decoding."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyweave.llm.common import id_and_text, slices

#: Pieces whose encodings, and token pairs whose verdicts, a task remembers; beyond it starts anew.
REMEMBERED = 1_500_000
#: Encodings by vocabulary and pattern; they last from task to task of one worker.
KNOWN: dict[tuple[str, str], dict[str, bytes]] = {}
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Ranks:
    """A vocabulary of ranked byte strings. A token's parts are the two tokens of its last merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.texts = {i: t for t, i in ranks.items()}
        lengths: dict[bytes, set[int]] = {}
        for t in ranks:
            lengths.setdefault(t[-3:], set()).add(len(t))
        #: By the last three bytes (fewer in shorter tokens) the lengths of the tokens that end so, longest first.
        self.lengths = {b: tuple(sorted(x, reverse=True)) for b, x in lengths.items()}
        self.longest = max(map(len, ranks), default=1)
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.agree: dict[tuple[int, int], bool] = {}
        self.four = {i: i.to_bytes(4, "little") for i in self.texts}.__getitem__

    def merged(self, text: bytes, down_to: int = 1) -> list[bytes]:
        """Merges by the definition (the lowest rank, the leftmost first) until `down_to` parts are left; for vocabulary entries only."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > down_to:
            best = min(((self.ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in self.ranks), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def halves(self, token: int) -> tuple[int, int] | None:
        """The tokens of the last merge that makes `token`; None for a single byte."""
        if token not in self.parts:
            text = self.texts[token]
            two = self.merged(text, 2) if len(text) > 1 else [text]
            self.parts[token] = (self.ranks[two[0]], self.ranks[two[1]]) if len(two) == 2 else None
        return self.parts[token]

    def stand(self, left: int, right: int) -> bool:
        """Whether `left` and `right` stay apart when their joined bytes are encoded.

        Undoes the merges of both from the latest to the earliest. At each point the two tokens at the border would have
        been joined if their pair ranks below every merge that was still to come there.
        """
        verdict = self.agree.get((left, right))
        if verdict is not None:
            return verdict
        a, b, limit = left, right, (1 << 40, 0)
        texts, ranks = self.texts, self.ranks
        while True:
            joined = ranks.get(texts[a] + texts[b])
            # A pair at the border stands to the right of merges in `left` and to the left of those in `right`.
            if joined is not None and (joined, 1) < limit:
                verdict = False
                break
            whole_a, whole_b = self.halves(a), self.halves(b)
            if whole_a is None and whole_b is None:
                verdict = True
                break
            if whole_b is None or whole_a is not None and a > b:
                limit, a = (a, 0), whole_a[1]
            else:
                limit, b = (b, 2), whole_b[0]
        if len(self.agree) > REMEMBERED:
            self.agree.clear()
        self.agree[left, right] = verdict
        return verdict


class Prefixes:
    """For each byte prefix of a piece its last token: the one token that ends there and stands beside the last token of the prefix before it."""

    __slots__ = ("vocabulary", "data", "last")

    def __init__(self, vocabulary: Ranks, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> Prefixes:
        """Adds bytes. What is stored for the shorter prefixes stays as it is."""
        v, start = self.vocabulary, len(self.data)
        data = self.data = self.data + more
        get, lengths, agree, stand, last = v.ranks.get, v.lengths, v.agree, v.stand, self.last
        for end in range(start + 1, len(data) + 1):
            for n in (*lengths.get(data[max(0, end - 3) : end], ()), 2, 1):
                if n > end or (token := get(data[end - n : end])) is None:
                    continue
                if n < end:
                    pair = last[end - n - 1], token
                    if not (stand(*pair) if (verdict := agree.get(pair)) is None else verdict):
                        continue
                last.append(token)
                break
            else:
                raise ValueError(f"the vocabulary has no token for byte {data[end - 1]}")
        return self

    def replace(self, start: int, stop: int, new: bytes) -> Prefixes:
        """Re-encodes near an edit: the prefixes before `start` are kept; those behind it are made anew until the last tokens agree again.

        A prefix's last token follows from its last bytes and the last tokens before it, no farther back than the longest
        token. So once that many in a row are as before the edit, all behind them are.
        """
        old, rest = self.last, self.data[stop:]
        self.data, self.last = self.data[:start], self.last[:start]
        self.append(new)
        same, reach, shift = 0, self.vocabulary.longest, start + len(new) - stop
        for i in range(len(rest)):
            if same == reach:
                self.data += rest[i:]
                self.last += old[stop + i :]
                break
            self.append(rest[i : i + 1])
            same = same + 1 if self.last[-1] == old[len(self.last) - 1 - shift] else 0
        return self

    def ids(self) -> list[int]:
        out, end, texts = [], len(self.data), self.vocabulary.texts
        while end:
            out.append(self.last[end - 1])
            end -= len(texts[out[-1]])
        return out[::-1]


@lru_cache(maxsize=2)
def ranks_of(path: str) -> Ranks:
    with open(path, "rb") as f:
        return Ranks({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def encode_pieces(pieces: Iterable[str], vocabulary: Ranks) -> Iterator[tuple[str, bytes]]:
    """Each piece and its ids as little-endian unsigned 32-bit integers. In sorted order a piece mostly differs from the one before near its end, so most prefixes are kept."""
    prefixes, four = Prefixes(vocabulary), vocabulary.four
    for data, piece in sorted((p.encode(), p) for p in pieces):
        if (token := vocabulary.ranks.get(data)) is not None:
            yield piece, four(token)
            continue
        old = prefixes.data
        same = next((i for i, (x, y) in enumerate(zip(old, data, strict=False)) if x != y), min(len(old), len(data)))
        yield piece, b"".join(map(four, prefixes.replace(same, len(old), data[same:]).ids()))


def encode_texts(texts: list[str], vocabulary: Ranks, split, known: dict[str, bytes]) -> Iterator[np.ndarray]:
    """Token ids of each text. The batch's new pieces are encoded first, each once."""
    cut = [split(text) for text in texts]
    new = set().union(*cut)
    if len(known) + len(new) > REMEMBERED:
        known.clear()
    else:
        new -= known.keys()
    known.update(encode_pieces(new, vocabulary))
    for pieces in cut:
        yield np.frombuffer(b"".join(map(known.__getitem__, pieces)), "<u4")


def decode_ids(ids: np.ndarray, vocabulary: Ranks) -> bytes:
    return b"".join(map(vocabulary.texts.__getitem__, ids.tolist()))


def bpe_round_trip(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per input row: encodes its text, decodes the ids, and returns their count and both digests (and `ids` if asked).

    `vocabulary` is the path of a rank file, read by each worker; `pattern` parts a text into pieces that are encoded one
    by one. Null and empty texts have no tokens; a null id stays null; repeated rows are encoded one by one; an empty
    table gives no rows. Row by row, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        ranks, split, known = ranks_of(vocabulary), regex.compile(pattern).findall, KNOWN.setdefault((vocabulary, pattern), {})
        for batch in slices(batches, most_bytes=2 << 20):
            n, first, second, ids = [], [], [], []
            for x in encode_texts(batch.column(1).to_pylist(), ranks, split, known):
                n.append(len(x))
                first.append(hashlib.sha256(x.tobytes()).hexdigest())
                second.append(hashlib.sha256(decode_ids(x, ranks)).hexdigest())
                if with_ids:
                    ids.append(x.astype(np.int32))
            arrays, names = [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays, names = [*arrays, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return id_and_text(df, id_col, text_col).mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
