"""Operators against their SQL over texts that the driver's tables don't have."""

import duckdb
import pandas as pd
import pytest

from tallyweave.llm import licenses, oracles, pii
from tallyweave.llm.decontam import contamination

WORDS = "whence does that grey river flow below our old stone bridge"


@pytest.fixture(scope="module")
def by_sql():
    def run(sql, **tables):
        c = duckdb.connect()
        for name, rows in tables.items():
            c.register(name, pd.DataFrame(rows, columns=["doc_id" if name == "documents" else "item_id", "text"]))
        return sorted(map(str, c.execute(sql).fetchall()))

    return run


def told(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_items_of_any_length(spark, by_sql):
    """Items of one word to eleven, ones of numbers and names, copied whole in any case and with other punctuation; renamed copies of those that have a template."""
    short = [(n, " ".join(WORDS.split()[:n]).capitalize() + "?") for n in range(1, 12)]
    rich = [(20, "Name the capital city of Peru"), (21, "What is 3 + 5 * 7 - 2 + 9 * 4 - 8 ?"), (22, "12 34 56 78 90 11 22 33 44 55"), (23, "Anna Bea Carl Dora Emil Fritz Gerd Hans Ida"), (24, "3"), (25, "7 8")]
    items = [*short, *rich, (30, ""), (31, None), (32, "?!"), (33, "Name the capital city of Peru")]
    docs = [(100 + i, f"so they asked: {t} and nobody knew") for i, t in short + rich] + [(200 + i, t.upper() if i % 2 else t) for i, t in rich]
    docs += [(300, None), (301, ""), (302, "what is 3 5 7 2 9 4 and then some"), (303, "12 34 56 78 90 11 22 33"), (304, "name the capital city of Chile"), (305, "Carl Dora Emil Fritz Gerd Hans Ida Anna Bea"), (306, "clean words alone " * 3), (307, rich[1][1] * 2), (308, "33")]
    frames = [spark.createDataFrame(rows, f"{c} long, text string") for rows, c in ((docs, "doc_id"), (items, "item_id"))]
    got = contamination(*frames)
    assert told(got) == by_sql(oracles.template_decontamination(), documents=docs, benchmark=items)
    pairs = {(r.doc_id, r.item_id) for r in got.collect()}
    assert {(100 + i, i) for i, _ in short + rich} | {(200 + i, i) for i, _ in rich} <= pairs
    # Every text that holds an item's words on end, and of longer ones no others.
    known = {i: [w.lower() for w in pd.Series([t]).str.findall(r"[^\W_]+")[0]] for i, t in items if t}
    for d, t in docs:
        w = [x.lower() for x in pd.Series([t or ""]).str.findall(r"[^\W_]+")[0]]
        for i, words in known.items():
            held = bool(words) and any(w[k : k + len(words)] == words for k in range(len(w)))
            assert ((d, i) in pairs) >= held and (held or len(words) > 8 or (d, i) not in pairs), (d, i)
    assert not {d for d, _ in pairs} & {300, 301, 304, 306, 308}
    shuffled = contamination(*frames, broadcast_bytes=0)
    assert told(shuffled) == told(got)
    assert contamination(frames[0].limit(0), frames[1]).count() == contamination(frames[0], frames[1].where("item_id > 29 AND item_id < 33")).count() == 0


def test_repeated_notices(spark, by_sql):
    line = "Released under the MIT license"
    texts = ["\n".join([line] * k) for k in range(1, 5)] + [None, "", "This work is licensed under the GNU General Public License. See the GNU General Public License", f"{line} {line} not released to the public", "released under the the mit license " * 3]
    texts += ["all rights reserved cc by " * 4, " ".join(["licensed under the apache license version 2 0 " * 5, line]), "under the mit license " * 6]
    docs = list(enumerate(texts))
    got = licenses.license_scan(spark.createDataFrame(docs, "doc_id long, text string"))
    assert told(got) == by_sql(oracles.diagonal_licenses(), documents=docs)
    labels = {r.doc_id: r.labels for r in got.collect()}
    assert [labels[i] for i in range(6)] == ["mit"] * 4 + [""] * 2 and labels[6] == "gpl,gpl-notice"


def test_terms_are_counted_one_way(spark):
    """A name inside other addresses isn't a term there, and lower case may part a word."""
    near = [f"filler{'abcde'[i]} Petrovsky vip@x.org" for i in range(5)] + [f"filler{'abcde'[i]} İstanbulov van@y.org" for i in range(5)]
    inside = [f"write petrovsky@h{i}.org, x.Petrovsky@mail or petrovsky_{i} and -petrovsky" for i in range(9)]
    texts = near + inside + [f"nothing here but word{'abcdefghij'[i % 10]}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hit = {(r.doc_id, r.text[s.start : s.stop]) for r in docs.join(pii.personal_data(docs), "doc_id").collect() for s in r.spans if s.kind == "term"}
    assert hit == {(i, "Petrovsky") for i in range(5)} | {(i, "İstanbulov") for i in range(5, 10)}
