"""Katz backoff language model: counts in bucketed tables, Good-Turing discounts, exactly normalised backoff weights.

Texts are dealt into batches of a bounded size by a hash of their rows. A batch asks for what it needs about its distinct
words and word pairs in arrays, one per bucket of the count tables, and gets arrays in the same order back. So tokens
are not shuffled one by one, and a frequent word or pair is one entry of a batch. Orders above two go the same way, one
after the other: a batch that knows its tokens' shares at one order asks for what it needs of the next.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import id_and_text, slices, written

#: Bytes of text in a batch, counts that are discounted, and the most parts into which one word's successors are dealt.
BATCH, DISCOUNTED = 6 << 20, 5
#: Successors of one word beyond this share of a bucket go to several buckets.
SHARE = 4
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Stand for the start and the end of a text among the word hashes.
START, END = np.uint64(0x5354415254000001), np.uint64(0x454E440000000001)
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
WORDS = "bucket int, batch int, words binary, counts binary"
REPLY = "batch int, kind int, bucket int, one binary, two binary"
PAIRS = "bucket int, batch int, firsts binary, n_seconds binary, seconds binary, counts binary, second_counts binary"
STATS = "bucket int, firsts binary, mass binary, lower binary"
#: Above order two: an entry of a batch for the grams of a bucket (asked 0), or for the histories of a bucket (asked 1), whose hashes and counts are `firsts` and `counts`.
GRAMS = "asked int, bucket int, batch int, firsts binary, n_seconds binary, seconds binary, counts binary, second_counts binary, wholes binary"


def packed(x: np.ndarray) -> bytes:
    """An array as compressed planes of bytes: the high bytes of small numbers take next to nothing."""
    import zstandard

    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T
    return zstandard.compress(planes.tobytes(), 1)


def unpacked(x: bytes, kind: str) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(x), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


class Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def mixed(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    x = (a ^ (a >> np.uint64(31))) * MIX ^ b
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Batch:
    """The tokens of a batch: distinct word hashes in order, each token's and each history's place among them, and the texts' ends."""

    def __init__(self, rows: pa.Table):
        import xxhash
        import zstandard

        ids, held, texts = (rows.column(c).to_pylist() for c in ("doc_id", "held", "text"))
        expand = zstandard.ZstdDecompressor().decompress
        texts = [expand(x) for x in texts]
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.ids, self.held = [ids[i] for i in order], np.array([held[i] for i in order], bool)
        numbers, local, sizes = Numbers(), [], []
        for i in order:
            words = texts[i].lower().split()  # of bytes: A-Z, and \x20 and \x09-\x0D, alone
            local.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
            sizes.append(len(words) + 1)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers))
        self.words, place = np.unique(np.r_[hashes, START, END], return_inverse=True)
        start, end = place[-2], place[-1]
        self.sizes = np.array(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)
        self.tokens = np.concatenate([np.r_[place[x], end] for x in local])
        self.history = np.r_[start, self.tokens[:-1]]
        self.history[self.ends[:-1]] = start
        self.train = np.repeat(~self.held, self.sizes)

    def word_counts(self) -> np.ndarray:
        """Training tokens of each distinct word; for the start, the training texts."""
        counts = np.bincount(self.tokens[self.train], minlength=len(self.words))
        counts[np.searchsorted(self.words, START)] = int((~self.held).sum())
        return counts

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(history, word, training count) of the distinct pairs, in order, and each token's place among them."""
        n = len(self.words)
        keys, place = np.unique(self.history * n + self.tokens, return_inverse=True)
        return keys // n, keys % n, np.bincount(place[self.train], minlength=len(keys)), place


    def contexts(self, order: int) -> np.ndarray:
        """A hash of the order - 1 tokens before each token; before a text's start there are starts."""
        begins, padding, out = np.r_[0, self.ends[:-1]], np.array([START]), self.words[self.history]
        for _ in range(order - 2):
            before = np.r_[padding, out[:-1]]
            before[begins] = padding
            out = mixed(before, self.words[self.history])
            padding = mixed(padding, np.array([START]))
        return out

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct histories, and of the distinct grams, in order, the history, the word, the training count and a token; each token's place among them."""
        n = len(self.words)
        contexts, of = np.unique(self.contexts(order), return_inverse=True)
        keys, first, place = np.unique(of * n + self.tokens, return_index=True, return_inverse=True)
        return contexts, keys // n, keys % n, np.bincount(place[self.train], minlength=len(keys)), first, place

    def history_counts(self, found: np.ndarray, texts: int) -> np.ndarray:
        """The training count of each token's history at an order, from the counts of the tokens' grams at the one below."""
        out = np.r_[0, found[:-1]]
        out[np.r_[0, self.ends[:-1]]] = texts
        return out


def word_buckets(words: np.ndarray, n: int) -> np.ndarray:
    return (mixed(words, np.uint64(1)) % np.uint64(n)).astype(np.int64)


def pair_buckets(firsts: np.ndarray, seconds: np.ndarray, counts: np.ndarray, total: int, n: int) -> np.ndarray:
    """The bucket of each pair: by its first word, and for words of which there are many also by a part of the second."""
    parts = np.maximum(1, -(-counts * n * SHARE // max(1, total))).astype(np.uint64)
    return (mixed(mixed(firsts, np.uint64(2)), mixed(seconds, np.uint64(3)) % parts) % np.uint64(n)).astype(np.int64)


def by_bucket(buckets: np.ndarray):
    """(bucket, places) for each bucket, the places in order."""
    order = np.argsort(buckets, kind="stable")
    cuts = np.flatnonzero(np.r_[True, buckets[order][1:] != buckets[order][:-1]]) if len(order) else np.array([], np.int64)
    for a, b in zip(cuts, np.r_[cuts[1:], len(order)], strict=True):
        yield int(buckets[order[a]]), order[a:b]


def table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[f for f, _ in fields])


def discounts(n: np.ndarray) -> np.ndarray:
    """Good-Turing factors of the counts 0 to DISCOUNTED from n[r], the number of items with count r; 1 where the counts of counts allow none."""
    d = np.ones(DISCOUNTED + 1)
    if (n[1 : DISCOUNTED + 2] > 0).all():
        common = (DISCOUNTED + 1) * n[DISCOUNTED + 1] / n[1]
        for r in range(1, DISCOUNTED + 1):
            x = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if common < 1 else 1.0
            d[r] = x if 0 < x <= 1 else 1.0
    return d


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * np.where(counts <= DISCOUNTED, d[np.minimum(counts, DISCOUNTED)], 1.0)


class Unigrams:
    """The lower order: discounted shares of the known words; what is left goes to the one event of an unknown word."""

    def __init__(self, total: int, n: np.ndarray, rest: int):
        # rest: tokens of words with greater counts than the discounted.
        self.total, self.d = total, discounts(n)
        mass = float(rest + sum(self.d[r] * r * n[r] for r in range(1, DISCOUNTED + 1)))
        # Without any discount one count is set apart for the unknown.
        self.scale = 1.0 if mass < total - 1e-9 * max(1, total) else total / (total + 1) if total else 0.0
        self.unknown = 1.0 - mass * self.scale / total if total else 1.0

    def p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, discounted(counts, self.d) * self.scale / max(1, self.total), self.unknown)


def _words(rows: pa.Table, n_buckets: int) -> pa.Table:
    batch, number = Batch(rows), rows.column("batch")[0].as_py()
    counts = batch.word_counts()
    return table(WORDS, [(b, number, batch.words[i].tobytes(), packed(counts[i].astype(np.uint32))) for b, i in by_bucket(word_buckets(batch.words, n_buckets))])


def _merged(rows: pa.Table) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """The batches' word arrays, the distinct words, their counts, and each entry's place among them."""
    parts = [np.frombuffer(x, np.uint64) for x in rows.column("words").to_pylist()]
    counts = np.concatenate([unpacked(x, np.uint32) for x in rows.column("counts").to_pylist()]).astype(np.int64)
    words, place = np.unique(np.concatenate(parts), return_inverse=True)
    return parts, words, np.bincount(place, counts, len(words)).astype(np.int64), place


STAT_COLUMNS = [f"n{r}" for r in range(1, DISCOUNTED + 2)]
STAT_SCHEMA = ", ".join(f"{c} long" for c in ("tokens", "types", "rest", *STAT_COLUMNS))


def stat_row(counts: np.ndarray) -> pa.Table:
    ns = [int((counts == r).sum()) for r in range(1, DISCOUNTED + 2)]
    return table(STAT_SCHEMA, [(int(counts.sum()), int((counts > 0).sum()), int(counts[counts > DISCOUNTED].sum()), *ns)])


def _word_stats(rows: pa.Table) -> pa.Table:
    _, words, totals, _ = _merged(rows)
    return stat_row(totals[words != START])


def _word_replies(rows: pa.Table, n_buckets: int) -> pa.Table:
    """To each batch the counts of its words and their numbers among all words: small ones for frequent words, so that pairs of them take few bytes."""
    parts, _, totals, place = _merged(rows)
    rank = np.empty(len(totals), np.uint64)
    rank[np.argsort(-totals, kind="stable")] = np.arange(len(totals), dtype=np.uint64)
    buckets = rows.column("bucket").to_pylist()
    number = rank * np.uint64(n_buckets) + np.uint64(buckets[0])
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    each = zip(rows.column("batch").to_pylist(), buckets, np.split(totals[place], cuts), np.split(number[place], cuts), strict=True)
    return table(REPLY, [(b, 0, k, packed(x.astype(np.uint64)), packed(y)) for b, k, x, y in each])


def _answers(batch: Batch, replies: pa.Table, n_buckets: int, kind: int, column: str, what: str) -> np.ndarray:
    """What the word tables' replies of a kind say about each of the batch's words."""
    out = np.zeros(len(batch.words), what)
    at = dict(by_bucket(word_buckets(batch.words, n_buckets)))
    for k, bucket, data in zip(*(replies.column(c).to_pylist() for c in ("kind", "bucket", column)), strict=True):
        if k == kind:
            out[at[bucket]] = unpacked(data, what)
    return out


def _model(rows: pa.Table, prefix: str = "") -> tuple[int, int, int, np.ndarray]:
    first = {c: rows.column(prefix + c)[0].as_py() or 0 for c in ("tokens", "types", "rest", *STAT_COLUMNS)}
    return first["tokens"], first["types"], first["rest"], np.array([0] + [first[c] for c in STAT_COLUMNS], float)


def _pairs(rows: pa.Table, replies: pa.Table, n_buckets: int) -> pa.Table:
    batch, number = Batch(rows), rows.column("batch")[0].as_py()
    counts, total = _answers(batch, replies, n_buckets, 0, "one", "u8").astype(np.int64), _model(replies)[0]
    numbers = _answers(batch, replies, n_buckets, 0, "two", "u8")
    first, second, trained, _ = batch.pairs()
    out = []
    for b, i in by_bucket(pair_buckets(batch.words[first], batch.words[second], counts[first], total, n_buckets)):
        firsts, n = np.unique(first[i], return_counts=True)
        out.append((b, number, batch.words[firsts].tobytes(), packed(n.astype(np.uint32)), packed(numbers[second[i]]), packed(trained[i].astype(np.uint32)), packed(counts[second[i]].astype(np.uint64))))
    return table(PAIRS, out)


def _merged_pairs(rows: pa.Table):
    """(first words, totals of the distinct pairs, their second words' counts, each entry's place among them, entries by batch)."""
    sizes = [unpacked(x, np.uint32) for x in rows.column("n_seconds").to_pylist()]
    firsts = np.concatenate([np.repeat(np.frombuffer(x, np.uint64), n) for x, n in zip(rows.column("firsts").to_pylist(), sizes, strict=True)])
    seconds = np.concatenate([unpacked(x, np.uint64) for x in rows.column("seconds").to_pylist()])
    counts = np.concatenate([unpacked(x, np.uint32) for x in rows.column("counts").to_pylist()]).astype(np.int64)
    lower = np.concatenate([unpacked(x, np.uint64) for x in rows.column("second_counts").to_pylist()]).astype(np.int64)
    _, one, place = np.unique(mixed(mixed(firsts, np.uint64(5)), seconds), return_index=True, return_inverse=True)
    return firsts[one], np.bincount(place, counts, len(one)).astype(np.int64), lower[one], place, [int(n.sum()) for n in sizes]


def _pair_stats(rows: pa.Table) -> pa.Table:
    return stat_row(_merged_pairs(rows)[1])


def _pair_replies(rows: pa.Table, kind: int = 1) -> pa.Table:
    _, totals, _, place, sizes = _merged_pairs(rows)
    return table(REPLY, [(b, kind, k, packed(x.astype(np.uint64)), b"") for b, k, x in zip(rows.column("batch").to_pylist(), rows.column("bucket").to_pylist(), np.split(totals[place], np.cumsum(sizes)[:-1]), strict=True)])


def _history_stats(rows: pa.Table, n_buckets: int) -> pa.Table:
    """For each first word of the bucket's seen pairs: the discounted counts and the lower order's shares of their seconds, summed, to the words' own buckets."""
    firsts, totals, lower, _, _ = _merged_pairs(rows)
    uni, d = Unigrams(*(lambda t, _, r, n: (t, n, r))(*_model(rows))), discounts(_model(rows, "pair_")[3])
    seen = totals > 0
    words, place = np.unique(firsts[seen], return_inverse=True)
    mass = np.bincount(place, discounted(totals[seen], d), len(words))
    share = np.bincount(place, uni.p(lower[seen]), len(words))
    return table(STATS, [(b, words[i].tobytes(), packed(mass[i]), packed(share[i])) for b, i in by_bucket(word_buckets(words, n_buckets))])


def _history_replies(rows: pa.Table, stats: pa.Table, kind: int = 2) -> pa.Table:
    """To each batch its words' backoff weights as histories; negative where no successor is discounted, so that one count is set apart."""
    if not rows.num_rows:
        return table(REPLY, [])
    parts, words, totals, place = _merged(rows)
    firsts = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x, np.uint64) for x in stats.column("firsts").to_pylist()]])
    at = np.searchsorted(words, firsts)
    mass, share = (np.bincount(at, np.concatenate([np.zeros(0), *[unpacked(x, np.float64) for x in stats.column(k).to_pylist()]]), len(words)) for k in ("mass", "lower"))
    c = np.maximum(totals, 1).astype(float)
    bare = (totals > 0) & (mass >= c - 1e-9 * c)
    weight = np.where((totals > 0) & (mass > 0), (1 - mass / np.where(bare, c + 1, c)) / (1 - share), 1.0)
    signed = np.where(bare, -weight, weight)[place]
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    return table(REPLY, [(b, kind, k, packed(x), b"") for b, k, x in zip(rows.column("batch").to_pylist(), rows.column("bucket").to_pylist(), np.split(signed, cuts), strict=True)])


def _shares(batch: Batch, replies: pa.Table, n_buckets: int, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token its gram's training count, its history's count (with the one that is set apart) and its share, at an order for which the replies are there."""
    total, types, rest, n = _model(replies)
    uni, d = Unigrams(total, n, rest), discounts(_model(replies, prefix(2))[3])
    counts = _answers(batch, replies, n_buckets, 0, "one", "u8").astype(np.int64)
    signed = _answers(batch, replies, n_buckets, 2, "one", "f8")
    asked = list(zip(*(replies.column(c).to_pylist() for c in ("kind", "bucket", "one")), strict=True))

    def answered(out: np.ndarray, kind: int, at: dict[int, np.ndarray], what: str) -> np.ndarray:
        for k, bucket, data in asked:
            if k == kind:
                out[at[bucket]] = unpacked(data, what)
        return out

    first, second, _, place = batch.pairs()
    at = dict(by_bucket(pair_buckets(batch.words[first], batch.words[second], counts[first], total, n_buckets)))
    found = answered(np.zeros(len(first), np.int64), 1, at, "u8")
    c = counts.astype(float)
    weight, whole = np.abs(signed), np.where(signed < 0, c + 1, c)
    lower = uni.p(counts)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = np.where(found > 0, discounted(found, d) / whole[first], weight[first] * lower[second])
    found, whole, p = found[place], whole[first][place], p[place]
    texts = int(counts[np.searchsorted(batch.words, START)])
    for k in range(3, order + 1):
        contexts, of, second, _, first, place = batch.grams(k)
        c = batch.history_counts(found, texts)[first]
        at = dict(by_bucket(pair_buckets(contexts[of], batch.words[second], c, total, n_buckets)))
        found = answered(np.zeros(len(of), np.int64), 2 * k - 3, at, "u8")
        count = np.zeros(len(contexts), np.int64)
        count[of] = c
        seen = np.flatnonzero(count > 0)
        at = {b: seen[i] for b, i in by_bucket(word_buckets(contexts[seen], n_buckets))}
        signed = answered(np.ones(len(contexts)), 2 * k - 2, at, "f8")
        whole = np.where(signed < 0, count + 1, count).astype(float)[of]
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(found > 0, discounted(found, discounts(_model(replies, prefix(k))[3])) / whole, np.abs(signed)[of] * p[first])
        found, whole, p = found[place], whole[place], p[place]
    return found, whole, p


def prefix(order: int) -> str:
    """What the columns of an order's counts of counts begin with."""
    return {1: "", 2: "pair_"}.get(order, f"gram{order}_")


def _grams(rows: pa.Table, replies: pa.Table, n_buckets: int, order: int) -> pa.Table:
    """What a batch asks at an order above two: its grams, with the counts one order below, and the histories that training texts have."""
    batch, number = Batch(rows), rows.column("batch")[0].as_py()
    found, whole, _ = _shares(batch, replies, n_buckets, order - 1)
    numbers, counts = (_answers(batch, replies, n_buckets, 0, c, "u8") for c in ("two", "one"))
    total, texts = _model(replies)[0], int(counts[np.searchsorted(batch.words, START)])
    contexts, of, second, trained, first, _ = batch.grams(order)
    c = batch.history_counts(found, texts)[first]
    out = []
    for b, i in by_bucket(pair_buckets(contexts[of], batch.words[second], c, total, n_buckets)):
        firsts, at, n = np.unique(of[i], return_index=True, return_counts=True)
        wholes = whole[first[i][at]]
        out.append((0, b, number, contexts[firsts].tobytes(), packed(n.astype(np.uint32)), packed(numbers[second[i]]), packed(trained[i].astype(np.uint32)), packed(found[first[i]].astype(np.uint64)), packed(wholes.astype(np.uint64))))
    mine = np.bincount(of, trained, len(contexts)).astype(np.uint32)
    count = np.zeros(len(contexts), np.int64)
    count[of] = c
    seen = np.flatnonzero(count > 0)
    for b, i in by_bucket(word_buckets(contexts[seen], n_buckets)):
        out.append((1, b, number, contexts[seen[i]].tobytes(), b"", b"", packed(mine[seen[i]]), b"", b""))
    return table(GRAMS, out)


def _gram_history_stats(rows: pa.Table, n_buckets: int, order: int) -> pa.Table:
    """As `_history_stats`: a seen gram's ending is seen too, so its share one order below is its discounted count there over its history's."""
    firsts, totals, lower, place, _ = _merged_pairs(rows)
    sizes = [unpacked(x, np.uint32) for x in rows.column("n_seconds").to_pylist()]
    whole = np.zeros(len(firsts))
    whole[place] = np.concatenate([np.repeat(unpacked(x, np.uint64), n) for x, n in zip(rows.column("wholes").to_pylist(), sizes, strict=True)])
    d, below = (discounts(_model(rows, prefix(k))[3]) for k in (order, order - 1))
    seen = totals > 0
    words, place = np.unique(firsts[seen], return_inverse=True)
    mass = np.bincount(place, discounted(totals[seen], d), len(words))
    share = np.bincount(place, discounted(lower[seen], below) / whole[seen], len(words))
    return table(STATS, [(b, words[i].tobytes(), packed(mass[i]), packed(share[i])) for b, i in by_bucket(word_buckets(words, n_buckets))])


def _scores(rows: pa.Table, replies: pa.Table, n_buckets: int, order: int) -> pa.Table:
    batch = Batch(rows)
    total, types, _, _ = _model(replies)
    counts = _answers(batch, replies, n_buckets, 0, "one", "u8").astype(np.int64)
    logs = np.log10(_shares(batch, replies, n_buckets, order)[2])
    base = np.log10((counts + 0.5) / (total + 0.5 * (types + 1)))[batch.tokens]
    starts = np.r_[0, batch.ends[:-1]]
    sums = [np.add.reduceat(x, starts) for x in ((counts > 0)[batch.tokens].astype(np.int64), base, logs)]
    return table(SCHEMA, list(zip(batch.ids, batch.held.tolist(), batch.sizes.tolist(), sums[0].tolist(), [total] * len(batch.ids), sums[1].tolist(), sums[2].tolist(), strict=True)))


def katz_scores(df: DataFrame, held_out=None, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH, order: int = 2) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, log10 probabilities of the text.

    Tokens are words, A-Z lower-cased, and one end. The model, of order two or, with `order`, more, learns from the rows that aren't held out
    (`held_out`, a condition; by default those whose id's crc32 mod 5 isn't 1). A pair of count r has the share d(r) r / c of
    its history of count c, d the Good-Turing factor up to a count of five; another word has the history's weight times
    its share of the lower order, where the weight is what the seen pairs leave, over what the lower order gives to words
    not seen there, so that each history's shares add up to one. The lower order is discounted likewise, and its rest is
    the share of the one unknown word. Above order two a gram backs off to the gram without its first token in the same way,
    and before a text's start there are starts. A history not seen in training has weight one. All counts are of all training
    rows. Null and empty texts have the end alone; a null id counts as the empty text for the default fold and stays null;
    repeated rows are texts of their own; an empty table gives no rows.
    """
    fold = F.crc32(F.coalesce(df[id_col].cast("string"), F.lit("")).cast("binary")) % 5 == 1 if held_out is None else held_out
    texts = id_and_text(df, id_col, text_col, F.coalesce(fold, F.lit(False)).alias("held"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + size // batch_bytes
    texts = texts.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("batch"), "doc_id", "held", F.col("text").cast("binary").alias("text"))

    def shrink(batches):
        import zstandard

        compress = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([compress(x) for x in batch.column(3).to_pylist()], pa.binary())], names=["batch", "doc_id", "held", "text"])

    texts = texts.mapInArrow(shrink, "batch int, doc_id long, held boolean, text binary")
    if order < 2:
        raise ValueError("order is 2 or more")
    batches = lambda: texts.groupBy("batch")
    words = batches().applyInArrow(lambda t: _words(t, n), WORDS).repartition("bucket")
    sums = lambda prefix: [F.sum(c).alias(prefix + c) for c in ("tokens", "types", "rest", *STAT_COLUMNS)]
    word_stats = words.groupBy("bucket").applyInArrow(_word_stats, STAT_SCHEMA).agg(*sums(""))
    # One row of totals joins all rows.
    counted = words.groupBy("bucket").applyInArrow(lambda t: _word_replies(t, n), REPLY).join(F.broadcast(word_stats))
    pairs = batches().cogroup(counted.groupBy("batch")).applyInArrow(lambda t, r: _pairs(t, r, n), PAIRS).repartition("bucket")
    pair_stats = pairs.groupBy("bucket").applyInArrow(_pair_stats, STAT_SCHEMA).agg(*sums("pair_"))
    found = pairs.groupBy("bucket").applyInArrow(lambda t: _pair_replies(t), REPLY)
    history = pairs.join(F.broadcast(word_stats)).join(F.broadcast(pair_stats)).groupBy("bucket").applyInArrow(lambda t: _history_stats(t, n), STATS)
    weights = words.groupBy("bucket").cogroup(history.groupBy("bucket")).applyInArrow(lambda t, s: _history_replies(t, s), REPLY)
    if order == 2:
        replies = counted.select("batch", "kind", "bucket", "one", F.lit(b"").alias("two")).union(found).union(weights).join(F.broadcast(word_stats)).join(F.broadcast(pair_stats))
        return batches().cogroup(replies.groupBy("batch")).applyInArrow(lambda t, r: _scores(t, r, n, 2), SCHEMA)
    # Each order's answers and counts of counts are tables, so that the next one doesn't make them anew; totals are one row.
    known = written(counted.select("batch", "kind", "bucket", "one", "two").union(found).union(weights))
    totals = written(word_stats.join(F.broadcast(pair_stats)))

    def climbed(known: DataFrame, totals: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        asks = written(batches().cogroup(known.join(F.broadcast(totals)).groupBy("batch")).applyInArrow(lambda t, r: _grams(t, r, n, k), GRAMS))
        grams = asks.where("asked = 0").drop("asked")
        stats = grams.groupBy("bucket").applyInArrow(_pair_stats, STAT_SCHEMA).agg(*sums(prefix(k)))
        totals = written(totals.join(F.broadcast(stats)))
        found = grams.groupBy("bucket").applyInArrow(lambda t: _pair_replies(t, 2 * k - 3), REPLY)
        history = grams.join(F.broadcast(totals)).groupBy("bucket").applyInArrow(lambda t: _gram_history_stats(t, n, k), STATS)
        asked = asks.where("asked = 1").select("bucket", "batch", F.col("firsts").alias("words"), "counts")
        weights = asked.groupBy("bucket").cogroup(history.groupBy("bucket")).applyInArrow(lambda t, s: _history_replies(t, s, 2 * k - 2), REPLY)
        return known.union(written(found.union(weights))), totals

    for k in range(3, order + 1):
        known, totals = climbed(known, totals, k)
    return batches().cogroup(known.join(F.broadcast(totals)).groupBy("batch")).applyInArrow(lambda t, r: _scores(t, r, n, order), SCHEMA)
