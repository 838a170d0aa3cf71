"""Reversed search and the prefix trie against brute force, neighbour votes on held-out labels; all over awkward rows too."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import neighbours, search, trie

SF = "/root/testdata/sf0.001"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return re.findall(TERM, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, top=20):
    counts = [(i, collections.Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, length = len(counts), sum(n for *_, n in counts)
    df = collections.Counter(w for _, c, _ in counts for w in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c, n in counts:
            m = 75 + 25 * n * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in terms(text) if w in c)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, k, i, -s) for k, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(30)] + ["Öl", "日本", "x1"]
    odd = [None, "", " .,;\n", "w1 W1, w2", "w1 W1, w2", "w3 " * 50_000, "q" * 90_000, "w1-w2_w3\x00w4\x7fw5"] + [" ".join(random.choices(words, k=random.randint(1, 60))) for _ in range(150)]
    rows = [(1000 + k, t, 7, "x") for k, t in enumerate(odd)] + [(None, "w1 w2", 7, "x"), (None, "w1 w2", 7, "x"), (1003, "w1 W1, w2", 7, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, score int, terms string").repartition(5)


def test_search(spark, docs, monkeypatch):
    items = [(1, "w1 w2 w2 日本"), (2, "Öl ÖL öl"), (3, None), (4, ""), (5, "none here"), (6, "W3! w4 x1"), (6, "W3! w4 x1"), (None, "w5"), (7, "w29 w28 w27 w26")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(1))
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted(brute_search(pairs, items), key=str)
    assert sorted(map(tuple, search.reversed_search(docs, table).collect()), key=str) == want and len({r[0] for r in want}) == 5
    # Blocks of an item or two, small tables of scores and pieces of a text.
    for name, small in (("CELLS", 7), ("PIECE", 10), ("MERGES", 2)):
        monkeypatch.setattr(search, name, small)
    assert sorted(map(tuple, search.reversed_search(docs, table, item_bytes=20).collect()), key=str) == want
    assert sorted(map(tuple, search.reversed_search(docs, table, top=3).collect()), key=str) == sorted(brute_search(pairs, items, 3), key=str)
    assert search.reversed_search(docs.limit(0), table).count() == search.reversed_search(docs, table.limit(0)).count() == 0
    assert search.reversed_search(docs.where("text = ''"), table).count() == 0


def test_search_whole_table(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = sorted(map(tuple, search.reversed_search(docs, items).collect()))
    assert got == sorted(brute_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])) and len(got) > 500


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest(), r, x))
    own = {c: [s[3:] for s in sorted(v)] for c, v in own.items()}
    members, ends, kids = (collections.defaultdict(list) for _ in range(3))
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seq = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved, size = {}, {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0)
        size[k] = sum(size[x] for x in kids[k]) + 1
    entered, todo = {}, [(k, 0) for k in members if not k]
    while todo:
        k, at = todo.pop()
        entered[k], at = at, at + 1
        for x in sorted(kids[k], key=lambda x: min(members[x])):
            todo.append((x, at))
            at += 2 * size[x]
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return [(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], sha(ends.get(k, [])), entered[k], entered[k] + 2 * size[k] - 1) for k, m in members.items()]


@pytest.mark.parametrize("block", [1 << 16, 3])
def test_trie(spark, block, monkeypatch):
    """Long conversations, a first turn that very many share, copies, equal and null turns, ids around zero and without their group's first."""
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "IDS", block)
    random.seed(3)
    turn = lambda: (random.choice(["user", "assistant", None]), random.choice(["a b", "c", None, "", "d\te f"]))
    rows = [(c, t, *turn()) for c in [*range(-45, 70), 990, 10**15] for t in range(random.randint(1, 7))]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 160) for t in range(5)] + [(c, 0, "user", "same 0") for c in range(200, 260)] + [(c, 1, "user", f"own {c}") for c in range(200, 260)]
    rows += [(500, t, "user", f"long {t}") for t in range(700)] + [(501, None, "x", "first"), (501, 3, "x", "tie"), (501, 3, "x", "tie"), (501, 3, "y", "tie"), (None, 1, "x", "nobody's"), (521, 2, "user", "z" * 80_000)]
    random.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("x")).repartition(4)
    want = brute_trie(rows)
    assert sorted(map(tuple, trie.prefix_trie(table).collect())) == sorted(want, key=lambda r: r[:2]) and len(want) > 900
    if block > 3:
        assert trie.prefix_trie(table.limit(0)).count() == trie.prefix_trie(table.where("conv_id IS NULL")).count() == 0


def test_trie_whole_table(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    assert sorted(map(tuple, trie.prefix_trie(table).collect())) == sorted(brute_trie([(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]), key=lambda r: r[:2])


def test_scan():
    key, values = np.array([1, 1, 2, 2, 2, 3]), np.array([1, 2, 3, 4, 5, 6])
    for cuts in ([0, 6], [0, 1, 2, 3, 6], [0, 4, 5, 6]):
        scan = trie.Scan(np.add, np.subtract)
        assert np.concatenate([scan(key[a:b], values[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]).tolist() == [1, 3, 3, 7, 12, 6]


def test_votes_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = neighbours.quality_votes(docs, labels)
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert got.count() == docs.count() and len(rows) > 60
    assert sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows) and len({r.quality for r in rows}) == 2
    # The other labels decide nothing for held-out rows.
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(tuple, neighbours.quality_votes(docs, turned).collect())) == sorted(map(tuple, got.collect()))


def test_votes_of_awkward_rows(spark):
    random.seed(2)
    good = lambda: " ".join("".join(random.choices(["ta", "re", "mo", "li"], k=random.randint(1, 3))) for _ in range(60)) + "."
    bad = lambda: " ".join(x.upper() + "!!" for x in good().split())
    rows = [(i, good() if i % 2 else bad(), i) for i in range(80)] + [(900, None, 0), (901, "", 0), (None, good(), 0), (902, bad() * 300, 0), (902, bad(), 0), (903, "a" * 200_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)] + [(1, None, 0), (None, 1, 0), (5000, 0, 0), (3, 1, 1)], "doc_id long, quality int, text int")
    got = neighbours.quality_votes(docs, labels, sample=50).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got) and all((r.predicted == 1) == (r.score >= 0.7) for r in got)
    assert {r.predicted for r in got if r.doc_id is not None and r.doc_id < 80 and r.doc_id % 2} == {1} and {r.predicted for r in got if r.doc_id is not None and (r.doc_id == 902 or r.doc_id < 80 and not r.doc_id % 2)} == {0}
    assert [r.held_out for r in got if r.doc_id is None] == [False] and {r.held_out for r in got if r.doc_id == 3} == {zlib.crc32(b"3") % 4 == 2}
    assert len({r.score for r in got if r.doc_id in (900, 901)}) == 1
    assert {r.score for r in neighbours.quality_votes(docs, labels.limit(0)).collect()} == {0.5} and neighbours.quality_votes(docs.limit(0), labels).count() == 0


def test_votes_by_brute_force(spark):
    """The nearest of all labelled texts, one by one."""
    random.seed(6)
    texts = [" ".join(random.choices(["some", "Text", "of", "few", "!!", "words", "WITH", "signs", "--"], k=random.randint(1, 80))) for _ in range(60)]
    counted = np.stack([neighbours.weighted(neighbours.term_counts(x.encode())) for x in texts])
    space = neighbours.Space(counted[:40], np.arange(40) % 3 > 0)
    near, want = space.at(counted[40:]), []
    for v in near:
        best = sorted((-round(float(v @ p) * 1e5), i) for i, p in enumerate(space.places))[: neighbours.NEIGHBOURS]
        weight = [max(-c, 0) for c, _ in best]
        want.append(sum(w * space.labels[i] for w, (_, i) in zip(weight, best, strict=True)) / sum(weight))
    assert np.allclose(space.votes(counted[40:]), want, atol=1e-3)
    # The dimensions are those of the singular value decomposition.
    around = counted[:40] - counted[:40].mean(0)
    exact = np.linalg.svd(around, full_matrices=False)[2][:20]
    assert np.allclose(np.abs((space.basis[:, :20] * exact.T).sum(0)), 1, atol=1e-2)


def test_terms_of_long_texts():
    """Pieces give the counts of the whole text."""
    random.seed(8)
    text = " ".join("".join(random.choices("abCD1é#\n", k=random.randint(1, 9))) for _ in range(40_000)).encode()
    low, want = text.lower(), collections.Counter()
    for i in range(len(text) - 2):
        want[int.from_bytes(low[i : i + 3], "big")] += 1
    codes = np.repeat(np.fromiter(want.keys(), np.uint64), np.fromiter(want.values(), np.int64))
    assert (neighbours.term_counts(text)[: neighbours.HASHED] == neighbours._hashed(codes)).all() and len(text) > 2 * neighbours.PIECE
