"""The text operators against brute force, over the whole of a small table and over awkward rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import bpe, counting, debruijn, katz, quality, simhash
from tallyweave.llm.components import components
from tallyweave.llm.decontam import contamination

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, key string, words int, batch int, copy boolean"


@pytest.fixture(scope="module")
def docs(spark):
    """A whole table, with columns whose names clash with the operators' own, and awkward rows."""
    random.seed(7)
    words = [f"w{i}" for i in range(40)]
    passage = " ".join(random.choice(words) for _ in range(60))
    odd = [None, "", " \n\t", "one two", passage, passage, f"x {passage[:150]} y z", ("la " * 300).strip(), "a" * 70_000, "b c " * 20_000, "日本語 テキスト " * 30, "<|endoftext|>a<|endoftext|> b", "\x00\x1f\x85  x"]
    rows = [(1000 + i, t, "k", i, 3, True) for i, t in enumerate(odd)] + [(None, passage, "k", 1, 1, None), (1004, passage, "r", 1, 1, None)]
    own = spark.createDataFrame(rows, SCHEMA)
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit("k").alias("key"), F.lit(0).alias("words"), F.lit(0).alias("batch"), F.lit(False).alias("copy"))
    return table.unionByName(own).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def same(got, want):
    assert sorted(got, key=str) == sorted(want, key=str)


def test_quality(docs, rows):
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.compression_bands(docs).collect()]
    want = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)))
    same(got, want)


def test_quality_verdict(spark):
    import base64

    random.seed(1)
    prose = " ".join("".join(random.choice(["ta", "re", "mo", "li", "su", "en", "or"]) for _ in range(random.randint(1, 4))) for _ in range(400))
    noise = " ".join(base64.b85encode(random.randbytes(60)).decode() for _ in range(60))
    verdicts = quality.compression_bands(spark.createDataFrame([(1, prose), (2, noise), (3, "spam and ham or so " * 80)], "doc_id long, text string")).collect()
    assert [r.kept for r in sorted(verdicts)] == [True, False, False]
    table = spark.createDataFrame([(1, prose, "x"), (2, noise, "y")], "doc_id long, text string, lang string")
    assert [tuple(r)[::2] for r in quality.passing(table).collect()] == [(1, "x")]


def test_quality_bands(docs, rows):
    """The verdict from its definition: chunks of every byte, limits by length."""
    import zstandard

    limits = lambda n: [(low, high) for start, low, high in quality.BANDS if n >= start][-1]
    ratio = lambda x: len(zstandard.ZstdCompressor(level=3).compress(x)) / len(x)
    want = []
    for r in quality.compression_bands(docs).collect():
        want.append((r.doc_id, r.n_words, r.kept, r.chunks_outside, r.n_chunks, round(r.ratio, 9), r.base_failed))
    got, failed = [], {(x[0], x[1], x[5]): x[6] for x in want}
    for i, t in rows:
        b, n = t.encode(), len(t.encode().split())
        parts = [b[k : k + 4096] for k in range(0, len(b), 4096)]
        out = [x for x in parts if not 0.7 * limits(len(x))[0] <= ratio(x) <= 1.07 * limits(len(x))[1]]
        whole = round(ratio(b), 9) if b else 0.0
        good = not failed[i, n, whole] and limits(len(b))[0] <= whole <= limits(len(b))[1] and 2 * sum(map(len, out)) <= len(b)
        got.append((i, n, good, len(out), len(parts), whole, failed[i, n, whole]))
    same(got, want)
    assert 0 < sum(x[2] for x in got) < len(got)


def test_quality_judges_every_chunk(spark):
    import base64

    random.seed(4)
    prose = " ".join("".join(random.choice(["ta", "re", "mo", "li", "su", "en", "or"]) for _ in range(random.randint(1, 4))) for _ in range(2000))[:5000]
    noise = base64.b85encode(random.randbytes(3000)).decode()
    noise = " ".join(noise[i : i + 40] for i in range(0, len(noise), 40))
    short = ["go " * 25, "the cat sat on a red mat and we ran to the big dog by the sea at ten as it was hot", "a b c d e f g h i j k l m n o p q r s t u v w"]
    texts = [prose, prose[:4096] + " " + noise[:3900] + " x", prose[:3000], *short]
    got = {r.doc_id: r for r in quality.compression_bands(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].kept for i in (0, 2, 4, 5)] == [True] * 4 and got[3].base_failed
    assert (got[0].n_chunks, got[1].n_chunks, got[1].chunks_outside) == (2, 2, 1)


def test_bpe_is_the_library(docs, rows):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks_of(path).ranks, special_tokens={})
    want = []
    for i, t in rows:
        ids = np.array(library.encode_ordinary(t), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    same([tuple(r) for r in bpe.bpe_round_trip(docs, path, P.PATTERN).collect()], want)


def test_bpe_appends_and_edits():
    v = bpe.ranks_of(P.path("byte_bpe_multi_50k.tiktoken"))
    random.seed(5)
    for _ in range(200):
        data = bytes(random.choice(b"aeionrst lh") for _ in range(random.randint(0, 30)))
        cut, new = random.randint(0, len(data)), bytes(random.choice(b"aeionrst") for _ in range(4))
        assert bpe.Prefixes(v, data[:cut]).append(data[cut:]).ids() == bpe.Prefixes(v, data).ids() == [v.ranks[p] for p in v.merged(data)]
        assert bpe.Prefixes(v, data).replace(cut, len(data), new).ids() == bpe.Prefixes(v, data[:cut] + new).ids()


def test_bpe_edits_stop_where_tokens_agree():
    v = bpe.ranks_of(P.path("byte_bpe_multi_50k.tiktoken"))
    random.seed(6)
    data = bytes(random.choice(b"aeionrst lh") for _ in range(3000))
    for _ in range(20):
        start = random.randint(0, len(data))
        stop, new = min(len(data), start + random.randint(0, 5)), bytes(random.choice(b"aeionrst") for _ in range(random.randint(0, 5)))
        edited, fresh = bpe.Prefixes(v, data), bpe.Prefixes(v, data[:start] + new + data[stop:])
        edited.replace(start, stop, new)
        assert edited.data == fresh.data and edited.last == fresh.last


def test_counts_are_the_library(docs, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for i, t in rows:
        n = len(library.encode(t, add_special_tokens=False).ids)
        want.append((i, len(t.encode()), n, n > 1024))
    same([tuple(r) for r in counting.token_counts(docs, P.path("byte_bpe_50k.json"), P.PATTERN).collect()], want)


def test_substrings(docs, rows):
    key = lambda i: 2**63 - 1 if i is None else i
    first, want = {}, []
    for i, t in sorted(rows, key=lambda r: key(r[0])):
        w = t.encode().split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), key(i))
    for i, t in rows:
        w = t.encode().split()
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < key(i) for j in range(13)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        want.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    same([tuple(r) for r in debruijn.substring_dedup(docs).collect()], want)


def test_rows_whose_keys_agree_by_chance(spark, monkeypatch):
    """Sources, copies and short rows whose 64-bit keys are the same stay rows of their own, with the same result."""
    draw = random.Random(13)
    words = lambda n: " ".join(f"w{draw.randrange(10_000)}" for _ in range(n))
    a, b = words(40), words(30)
    rows = [(1, f"{a} {words(9)}"), (2, f"{words(5)} {b}"), (3, "a b"), (4, ""), (5, f"{words(20)} {a}"), (6, f"{b} {words(3)}"), (7, words(50)), (8, f"{words(2)} {b} {a}"), (9, a), (10, a)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = [tuple(r) for r in debruijn.substring_dedup(table).collect()]
    assert [w[2] for w in sorted(want)] == [0, 0, 0, 0, 40, 30, 0, 70, 40, 40]
    own = debruijn.row_key
    same_key = {1: 1, 2: 1, 3: 3, 5: 3, 6: 6, 7: 6, 9: 9, 4: 9, 8: 8, 10: 8}
    monkeypatch.setattr(debruijn, "row_key", lambda i, t: F.when(i.isin(*same_key), F.create_map(*[F.lit(x).cast("long") for p in same_key.items() for x in p])[i]).otherwise(own(i, t)))
    same([tuple(r) for r in debruijn.substring_dedup(table).collect()], want)


@pytest.mark.parametrize("size", [1 << 20, 300])
def test_common_passages(spark, monkeypatch, size):
    """Passages that many rows share, whole and in part, in one run of texts and over many, equal, null and negative ids among them."""
    monkeypatch.setattr(debruijn, "SLICE", size)
    draw = random.Random(12)
    words = lambda n: [f"w{draw.randrange(400)}" for _ in range(n)]
    passages = [words(60) for _ in range(5)]
    rows = []
    for i in range(150):
        own = words(draw.randint(0, 30))
        for _ in range(draw.randint(1, 3)):
            p = draw.choice(passages)
            a = draw.choice([0, 0, 0, draw.randrange(40)])
            own += p[a : a + draw.choice([60, 60, 25])] + words(draw.randint(0, 9))
        rows.append((draw.choice([i - 20, i - 20, i - 20, 7, None]), " ".join(own)))
    key = lambda i: 2**63 - 1 if i is None else i
    first, want = {}, []
    for i, t in rows:
        w = t.encode().split()
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(key(i), first.get(g, 2**63 - 1))
    for i, t in rows:
        w = t.encode().split()
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < key(i) for j in range(13)}
        want.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    same([tuple(r) for r in debruijn.substring_dedup(table).collect()], want)
    assert 0 < sum(x[2] for x in want) < sum(x[1] for x in want)


def linked(nodes, near):
    root = list(range(len(nodes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(nodes)):
        for j in range(i):
            if near(nodes[i], nodes[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(nodes))]


def test_simhash(docs, rows):
    import xxhash

    prints = []
    for _, t in rows:
        w = t.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    roots = linked(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    same([tuple(r) for r in simhash.simhash_components(docs).collect()], [(i, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(rows, prints, roots, strict=True)])


@pytest.mark.parametrize("block", [1024, 8])
def test_links_of_crowded_fingerprints(spark, block):
    random.seed(11)
    centres = [random.getrandbits(64) for _ in range(6)]
    nodes = sorted({c ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 4))) for c in centres for _ in range(60)})
    signed = [x - (1 << 64) if x >> 63 else x for x in nodes]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), block=block)
    got = {r.node: r.root for r in components(edges).collect()}
    roots = linked(nodes, lambda a, b: (a ^ b).bit_count() <= 2)
    groups = collections.defaultdict(set), collections.defaultdict(set)
    for x, r in zip(signed, roots, strict=True):
        groups[0][r].add(x)
        groups[1][got.get(x, x)].add(x)
    assert sorted(map(sorted, groups[0].values())) == sorted(map(sorted, groups[1].values()))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 5000)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {k: 100 for k in range(100, 5000)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_hubs_are_dealt_out(spark):
    from tallyweave.llm.common import PARTS, heavy_keys, spread_join

    rows = spark.range(3000).selectExpr("if(id < 2000, 7, id) AS k", "id")
    table = spark.createDataFrame([(7, "hub"), (2500, "leaf"), (9, "none")], "k long, name string")
    heavy = heavy_keys(rows.groupBy("k").count(), "k", "count")
    assert [r.heavy for r in heavy.collect()] == [7]
    got = spread_join(rows, table, "k", "id", heavy)
    same([(r.k, r.id, r.name) for r in got.collect()], [(7, i, "hub") for i in range(2000)] + [(2500, 2500, "leaf")])
    assert spread_join(rows, table, "k", "id", heavy, "left").count() == 3000 and PARTS > 1


def test_counts_meet_hot_keys_in_parts(spark):
    from tallyweave.llm.common import PARTS, with_sizes

    rows = spark.range(6000).selectExpr("if(id < 4000, 7, if(id < 4002, 9, id)) AS k", "if(id % 2 = 0, 0, null) AS other", "id")
    got = with_sizes(rows, ["k"], "id")
    assert got.columns == ["k", "other", "id", "n"]
    same([(r.k, r.id, r.n) for r in got.collect()], [(7, i, 4000) for i in range(4000)] + [(9, 4000, 2), (9, 4001, 2)])
    assert with_sizes(rows.limit(0), ["k"], "id").count() == 0 and PARTS == 64


def test_near_duplicates(docs, rows):
    sets = []
    for _, t in rows:
        w = t.encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))))
    roots = linked(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    same([tuple(r) for r in simhash.near_duplicates(docs).collect()], [(i, least.get(r)) for (i, _), r in zip(rows, roots, strict=True)])


def test_near_duplicates_around_the_limit(spark):
    """Clusters of variants of one text near the limit, and short texts, against all pairs; recall of links between different texts is 1 here."""
    draw, texts = random.Random(9), []
    for size in [8, 9, 9, 10, 12, 16, 30, 60, 120, 250] * 4:
        words = [f"v{draw.randrange(10**9)}" for _ in range(size)]
        for _ in range(12):
            w = list(words)
            for _ in range(draw.randint(0, max(1, size // 30))):
                w[draw.randrange(size)] = f"u{draw.randrange(10**9)}"
            texts.append(" ".join(w[draw.randint(0, 1) :]))
    sets = [frozenset(tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))) for t in texts]
    roots = linked(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for settings in ({"block": 1024}, {"block": 7}, {"distance": None}):
        got = simhash.near_duplicates(table, **settings).collect()
        same([tuple(r) for r in got], list(enumerate(roots)))
    assert 40 < len(set(roots)) < len(texts) - 40


def test_one_of_each(spark):
    words = lambda k, n=40: " ".join(f"w{k}x{i}" for i in range(n))
    near = words(1).rsplit(" ", 1)[0] + " other"
    rows = [(3, words(1)), (2, near), (None, words(1)), (2, words(2)), (2, words(2)), (1, words(2)), (None, words(3)), (None, words(3)), (None, words(4)), (5, None), (6, ""), (7, " \n")]
    table = spark.createDataFrame([(i, t, "a", 1, 2, "b") for i, t in rows], "doc_id long, text string, node string, id int, row int, gone_id string")
    got = simhash.one_of_each(table)
    assert got.columns == table.columns
    same([(r.doc_id, r.text) for r in got.collect()], [(2, near), (1, words(2)), (None, words(3)), (None, words(4)), (5, None)])
    assert simhash.one_of_each(table.limit(0)).count() == 0


def test_near_duplicates_on_one_template(spark):
    draw = random.Random(2)
    words = lambda n: [f"w{draw.randrange(10**9)}" for _ in range(n)]
    template, shared = words(160), words(6)
    # All pairs are near 0.76, the first alone is at 0.81; its fingerprints are not the closest.
    texts = [" ".join(template + (shared if i < 2 else []) + words(19 if i < 2 else 25)) for i in range(40)]
    got = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i for i in range(40)} | {1: 0}


def test_true_links():
    draw = np.random.default_rng(3)
    sets = [np.unique(draw.integers(-9000, 9000, 12000 + 100 * i, dtype=np.int32)) for i in range(20)] + [np.array([k], np.int32) for k in (1, 1, 2)]
    near = lambda a, b: len(np.intersect1d(a, b)) >= 0.33 * len(np.union1d(a, b))
    roots = linked([frozenset(x.tolist()) for x in sets], lambda a, b: len(a & b) >= 0.33 * len(a | b))
    found = simhash.true_links(sets, 0.33)
    assert all(near(sets[i], sets[j]) and roots[i] == roots[j] for i, j in found)
    assert len(found) == len(sets) - len(set(roots))


def test_contamination(spark, docs, rows):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = collections.defaultdict(set)
    for r in items.collect():
        w = words(r.text)
        for k in range(len(w) - 12):
            grams[tuple(w[k : k + 13])].add(r.item_id)
    want = {(i, x) for i, t in rows for w in [words(t)] for k in range(len(w) - 12) for x in grams.get(tuple(w[k : k + 13]), ())}
    assert {(r.doc_id, r.item_id) for r in contamination(docs, items).collect()} == want


def test_contamination_with_other_slots(spark):
    items = spark.createDataFrame([(1, "Maria buys 12 apples for 3 dollars each and gives 5 apples to her brother before lunch, how many apples are left")], "item_id long, text string")
    same_question = "quiz: Joseph buys 40 apples for 7 euros each and gives 9 apples to her brother before lunch, how many apples are left"
    mixed = "Peter buys 12 apples for 3 dollars each and gives 12 apples to her brother before lunch"
    docs = spark.createDataFrame([(10, same_question), (11, "something else entirely that nobody asked about at any time of any day"), (12, None), (13, mixed)], "doc_id long, text string")
    got = {r.doc_id: r for r in contamination(docs, items).collect()}
    assert 10 in got and got[10].consistent == 1.0 and 11 not in got and 12 not in got


def test_contamination_keeps_whole_numbers_and_names(spark):
    item = "Maria Lopez pays 1,250.50 dollars for twenty-five red lamps and sells 3.5 of them each day until none is left in her shop"
    asked = "Joe pays 980 euros for 12 red lamps and sells 40 of them each day until none is left in her shop"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, asked), (2, item.upper()), (3, "Joe pays for red lamps and a day")], "doc_id long, text string")
    assert {r.doc_id for r in contamination(docs, items).collect()} == {1, 2}


def test_contamination_of_words_on_end(spark):
    item = "before noon Anna Maria Lopez and her old friend walk down to the quiet harbour " + " ".join(f"and word{'abcdefghij'[i]} then" for i in range(10))
    part = " ".join(item.split()[1:14])
    docs = spark.createDataFrame([(1, f"zz {part} yy"), (2, "zz " + " ".join(item.split()[3:13]) + " yy")], "doc_id long, text string")
    got = contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [r.doc_id for r in got] == [1]


def test_contamination_by_a_shuffle(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = [contamination(docs, items, broadcast_bytes=b).collect() for b in (0, 1 << 30)]
    same(*[[tuple(r) for r in x] for x in got])
    assert got[0]


def test_decontaminated(spark):
    from tallyweave.llm.decontam import decontaminated

    item = "how many brown apples does the old man sell on the long road before the rain comes down again"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, "so: " + item), (None, "clean"), (4, item), (4, "clean too"), (5, None), (6, ""), (6, "")]
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, gone_id int, row_key string")
    got = decontaminated(table, items)
    assert got.columns == table.columns
    same([(r.doc_id, r.text) for r in got.collect()], [x for x in rows if item not in (x[1] or "")])
    assert decontaminated(table, items.limit(0)).count() == len(rows) and decontaminated(table.limit(0), items).count() == 0


def test_katz(spark, docs, rows):
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in katz.katz_scores(docs, batch_bytes=60_000).collect()]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    one, two, starts = collections.Counter(), collections.Counter(), 0
    for i, t in rows:
        if not held(i):
            w = [*t.encode().lower().split(), "END"]
            one.update(w)
            two.update(zip(["START", *w], w, strict=False))
            starts += 1
    total, types = sum(one.values()), len(one)

    def factors(counts):
        n = collections.Counter(counts)
        if not all(n[r] for r in range(1, 7)):
            return lambda c: 1.0
        common = 6 * n[6] / n[1]
        d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if common < 1 else 1.0 for r in range(1, 6)}
        return lambda c: d[c] if 0 < d.get(c, 0) <= 1 else 1.0

    d1, d2 = factors(one.values()), factors(two.values())
    mass = sum(d1(c) * c for c in one.values())
    scale = 1.0 if mass < total - 1e-9 * total else total / (total + 1)
    low = {w: d1(c) * c * scale / total for w, c in one.items()}
    unknown = 1 - sum(low.values())
    after = collections.defaultdict(dict)
    for (a, b), c in two.items():
        after[a][b] = c
    whole, weight = {}, {}
    for a, x in after.items():
        c, m = starts if a == "START" else one[a], sum(d2(c) * c for c in x.values())
        whole[a] = c + 1 if m >= c - 1e-9 * max(1, c) else c
        weight[a] = (1 - m / whole[a]) / (1 - sum(low[b] for b in x))
    for a in list(after)[:20]:  # exactly normalised
        assert math.isclose(sum(d2(c) * c / whole[a] for c in after[a].values()) + weight[a] * (unknown + sum(p for b, p in low.items() if b not in after[a])), 1.0, rel_tol=1e-9)
    want = []
    for i, t in rows:
        w = [*t.encode().lower().split(), "END"]
        base = sum(math.log10((one[x] + 0.5) / (total + 0.5 * (types + 1))) for x in w)
        p = [d2(two[a, b]) * two[a, b] / whole[a] if two[a, b] else weight.get(a, 1.0) * low.get(b, unknown) for a, b in zip(["START", *w], w, strict=False)]
        want.append((i, held(i), len(w), sum(x in one for x in w), total, base, sum(map(math.log10, p))))
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=str), sorted(want, key=str), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-6, abs_tol=1e-4) and math.isclose(a[6], b[6], rel_tol=1e-6, abs_tol=1e-4)


@pytest.mark.parametrize("order", [3, 4])
def test_katz_of_higher_order(docs, rows, order):
    """Dicts of whole histories, and the recursion as it is written down."""
    got = [(r.doc_id, r.held_out, r.n_tokens, round(r.base_score, 5), r.score) for r in katz.katz_scores(docs, batch_bytes=150_000, order=order).collect()]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    counts = [collections.Counter() for _ in range(order + 1)]
    for i, t in rows:
        if not held(i):
            w = [*["START"] * (order - 1), *t.encode().lower().split(), "END"]
            for k in range(1, order + 1):
                counts[k].update(tuple(w[j - k + 1 : j + 1]) for j in range(order - 1, len(w)))
    total = sum(counts[1].values())

    def factors(items):
        n = collections.Counter(items)
        if not all(n[r] for r in range(1, 7)):
            return {}
        common = 6 * n[6] / n[1]
        d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if common < 1 else 1.0 for r in range(1, 6)}
        return {r: x for r, x in d.items() if 0 < x <= 1}

    d = [factors(c.values()) for c in counts]
    cut = lambda k, c: d[k].get(c, 1.0) * c
    mass = sum(cut(1, c) for c in counts[1].values())
    scale = 1.0 if mass < total - 1e-9 * total else total / (total + 1)
    unknown = 1 - mass * scale / total
    after = [collections.defaultdict(list) for _ in range(order + 1)]
    for k in range(2, order + 1):
        for g in counts[k]:
            after[k][g[:-1]].append(g[-1])
    memo = {}

    def history(h):
        """(what counts are divided by, weight) of a history seen in training."""
        k = len(h) + 1
        if h not in memo:
            c, m = sum(counts[k][*h, w] for w in after[k][h]), sum(cut(k, counts[k][*h, w]) for w in after[k][h])
            whole = c + 1 if m >= c - 1e-9 * c else c
            memo[h] = whole, (1 - m / whole) / (1 - sum(share(h[1:], w) for w in after[k][h]))
        return memo[h]

    def share(h, w):
        k = len(h) + 1
        if k == 1:
            return cut(1, counts[1][w,]) * scale / total if counts[1][w,] else unknown
        if h not in after[k]:
            return share(h[1:], w)
        whole, weight = history(h)
        return cut(k, counts[k][*h, w]) / whole if counts[k][*h, w] else weight * share(h[1:], w)

    everything = [w for (w,) in counts[1]]
    for h in sorted(after[order], key=str)[:5]:  # exactly normalised
        assert math.isclose(sum(share(h, w) for w in everything) + share(h, "never seen"), 1.0, rel_tol=1e-9)
    want = []
    for i, t in rows:
        w = [*["START"] * (order - 1), *t.encode().lower().split(), "END"]
        base = sum(math.log10((counts[1][x,] + 0.5) / (total + 0.5 * (len(counts[1]) + 1))) for x in w[order - 1 :])
        want.append((i, held(i), len(w) - order + 1, round(base, 5), sum(math.log10(share(tuple(w[j - order + 1 : j]), w[j])) for j in range(order - 1, len(w)))))
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=str), sorted(want, key=str), strict=True):
        assert a[:3] == b[:3] and math.isclose(a[3], b[3], rel_tol=1e-6, abs_tol=1e-4) and math.isclose(a[4], b[4], rel_tol=1e-6, abs_tol=1e-4)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert quality.compression_bands(none).count() == 0
    assert bpe.bpe_round_trip(none, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0
    assert counting.token_counts(none, P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0
    assert debruijn.substring_dedup(none).count() == 0
    assert simhash.simhash_components(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert katz.katz_scores(none).count() == 0
    assert katz.katz_scores(none, order=3).count() == 0
    assert contamination(none, none.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_stages_on_awkward_rows(spark, tmp_path):
    """Each stage alone: null, equal and repeated ids, null and empty texts, clashing names, an empty table."""
    import corpus_pipeline

    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    prose = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars between 300 and 2000").orderBy("doc_id").limit(3).collect()
    a, b, c = (r.text for r in prose)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(1, a), (1, a), (None, a), (1, b + " password = hunter2hunter2"), (None, item + " " + c), (1, item + " " + b), (2, None), (None, ""), (3, "x")]
    fields = "doc_id long, text string, lang string, source string, n_chars long, gone_id int, row int, id int, node int, row_key int, blob int, path int, spans int"
    table = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *[1] * 8) for i, t in rows], fields)
    texts = {name: [(r.doc_id, r.text) for r in f(spark, table, str(tmp_path)).collect()] for name, f in corpus_pipeline.STAGES[:-1]}
    assert all(f(spark, table, str(tmp_path)).columns == table.columns for _, f in corpus_pipeline.STAGES[:-1])
    assert len(texts["quality"]) == 6
    same(texts["near_duplicates"], [rows[0], *rows[3:7], rows[8]])
    same(texts["decontamination"], [r for r in rows if item not in (r[1] or "")])
    same(texts["secrets"], [(i, t and t.replace("password = hunter2hunter2", "[SECRET]")) for i, t in rows])
    assert corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path)).count() == len(rows)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, table.limit(0), str(tmp_path)).count() == 0


def test_pipeline_by_brute_force(spark, tmp_path):
    """The whole pipeline's rows, each stage in plain Python over all that the one before it kept."""
    import corpus_pipeline
    import tiktoken
    import zstandard

    from tallyweave.llm import secrets

    table = spark.read.parquet(f"{SF}/documents.parquet")
    prose = table.where("n_chars between 500 and 1500 and lang = 'en'").orderBy("doc_id").first()
    told = " ".join(reversed(prose.text.split())) + " password = hunter2hunter2, AKIA" + "B7" * 10
    more = spark.createDataFrame([(900_001, told, "en", "s", len(told)), (900_002, None, "en", "s", 0)], table.schema)
    sf_dir = str(tmp_path)
    table.unionByName(more).write.parquet(f"{sf_dir}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{sf_dir}/benchmark.parquet")
    docs = sorted((r.doc_id, r.text or "") for r in table.unionByName(more).collect())
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    compress = zstandard.ZstdCompressor(level=3).compress
    docs = [(i, t) for i, t in docs if quality.measure(t, compress)[6]]
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for _, t in docs for w in [t.encode().lower().split()]]
    docs = [d for k, (d, r) in enumerate(zip(docs, linked(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b)), strict=True)) if k == r]
    grams = lambda t: {tuple(w[k : k + 13]) for w in [re.findall(r"[^\W_]+", t.lower())] for k in range(len(w) - 12)}
    known = set().union(*map(grams, items))
    docs = [(i, t) for i, t in docs if not grams(t) & known]

    def redacted(t):
        spans = sorted((m.start(), m.end()) for r in secrets.RULES for m in re.finditer(r.pattern, t) if len(m[2 if r.kind == "assign" and m.re.groups > 1 else r.group]) >= r.least)
        out, at = "", 0
        for a, b in spans:
            out, at = (out + t[at:a] + "[SECRET]", b) if a >= at else (out, max(at, b))
        return out + t[at:]

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks_of(P.path("byte_bpe_multi_50k.tiktoken")).ranks, special_tokens={})
    want = [(i, library.encode_ordinary(redacted(t))) for i, t in docs]
    got = [(r.doc_id, list(r.ids)) for r in corpus_pipeline.run(spark, sf_dir).collect()]
    same(got, want)
    assert 100 < len(got) < 202 and any("[SECRET]" in redacted(t) for _, t in docs)


def test_pipeline(spark):
    import corpus_pipeline

    start = spark.read.parquet(f"{SF}/documents.parquet")
    docs, columns = start, start.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF)
        if name != "encoding":
            docs = docs.cache()
            assert docs.columns == columns and docs.count() <= before.count()
        if name == "near_duplicates":
            assert docs.groupBy("text").count().where("count > 1").count() == 0
        if name == "decontamination":
            assert contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert docs.count() == before.count() > 100
