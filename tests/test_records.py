"""The record operators on hand-made registers, and the driver's SQL."""

import random
from datetime import UTC, datetime

import duckdb
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyweave.functions import rules, text
from tallyweave.operators import compare, consolidate, exclude, match, register, reorder, validate
from tallyweave.plans import queries
from tallyweave.sources import reports, sheet, sheet_format, state
from tallyweave.streaming import jobs, learning, queue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"

AF = [
    (1, "A100000001", "甲一", "教務處", "P1", "41,755", "S1", "23,000", "C1009", "5,500"),
    (2, "A100000001", "甲一", "", "", "", "", "", "C1014", "3,000"),
    (3, "b100000002", "甲二", "總務處", "P1", "30000", "S1", "20000", "", ""),
    (4, "B100000003", "乙同", "教務處", "P1", "40000", "S1", "22000", "C1001", "4,000"),
    (5, "B100000004", "乙同", "輔導室", "P1", "40000", "S1", "22000", "", ""),
    (6, "C100000005", "丙三", "", "P1", "abc", "", "999", "X9999", "700"),
    (7, "", "無號", "", "P1", "1", "S1", "1", "", ""),
    (8, "D100000006", "丁四五六", "", "P1", "35000", "S1", "21000", "", ""),
]
SLIPS = [
    (1, "甲一", "教師", 41755, 23000, 5500, 3000, 73255),
    (2, "甲二", "幹事", 31000, 20000, 0, 0, 51000),
    (3, "乙同", "教師兼教學組長", 40000, 22000, 4000, 0, 66000),
    (4, "乙同", "教師", 40000, 22000, 0, 0, 62000),
    (5, "丁四伍六", "教師", 35000, 21000, 0, 0, 56000),
    (6, "戊七", "代理教師", 28000, 18000, 0, 0, 46000),
]


@pytest.fixture(scope="module")
def af(spark):
    return spark.createDataFrame([("b", *r) for r in AF], "batch_id string, row_ord long, person_id string, name string, dept string, pay_code string, pay_amt string, prof_code string, prof_amt string, duty_code string, duty_amt string")


@pytest.fixture(scope="module")
def slips(spark):
    return spark.createDataFrame([("b", *r, "") for r in SLIPS], "batch_id string, row_ord long, name string, title string, pay long, prof long, mgr long, tutor long, gross long, person_id string")


def test_consolidation(af):
    got = [tuple(r) for r in consolidate.consolidate(af).orderBy("row_ord").select("person_id", "name", "dept", "pay", "prof", "mgr", "tutor", "n_rows").collect()]
    assert got == [
        ("A100000001", "甲一", "教務處", 41755, 23000, 5500, 3000, 2),
        ("B100000002", "甲二", "總務處", 30000, 20000, 0, 0, 1),
        ("B100000003", "乙同", "教務處", 40000, 22000, 4000, 0, 1),
        ("B100000004", "乙同", "輔導室", 40000, 22000, 0, 0, 1),
        ("C100000005", "丙三", "", 0, 0, 0, 0, 1),
        ("D100000006", "丁四五六", "", 35000, 21000, 0, 0, 1),
    ]
    assert [tuple(r)[1:] for r in consolidate.unknown_codes(af).collect()] == [("X9999", "丙三")]
    assert [tuple(r)[1:] for r in consolidate.namesakes(consolidate.consolidate(af)).collect()] == [("乙同", 2)]
    with pytest.raises(KeyError, match="duty_code"):
        consolidate.consolidate(af.drop("duty_code"))


def test_comparison(af, slips):
    records, people = consolidate.consolidate(af), exclude.mark(slips)
    matched = match.match_cascade(people, records)
    results = compare.compare(people, records, matched)
    rows = compare.ordered(results).collect()
    assert [(r.name, r.status, r.match_basis) for r in rows] == [
        ("甲二", "diff", "姓名"), ("戊七", "pdf_only", ""), ("丙三", "af_only", ""), ("丁四五六", "ok", "姓名相近（AF 為「丁四五六」，請確認是否同一人）"), ("乙同", "ok", "單位（教務處）"), ("乙同", "ok", "主管職"), ("甲一", "ok", "姓名"),
    ]
    assert [tuple(d) for d in rows[0].diffs] == [("pay", "薪俸／本俸", 31000, 30000, -1000)]
    assert [(r.dept, r.person_id, r.title) for r in rows[:4]] == [("總務處", "B100000002", "幹事"), ("", "", "代理教師"), ("", "C100000005", ""), ("", "D100000006", "教師")]
    assert [r.place for r in compare.placed(results).orderBy("place").collect()] == list(range(7))
    main, aside = compare.parts(results)
    assert [r.name for r in aside.collect()] == ["戊七"] and main.count() == 6
    assert rows[1].secondary_reason == "職稱含「代理」" and rows[0].needs_confirm is False and rows[3].needs_confirm is True
    (s,) = compare.summary(results, matched).collect()
    assert (s.ok, s.diff, s.pdf_only, s.af_only, s.ambiguous, s.secondary, s.secondary_diff) == (4, 1, 0, 1, 0, 1, 1)
    assert validate.annotate_sums(slips).where("not arith_ok").count() == 0


def test_amounts_never_match_other_names(spark):
    left = spark.createDataFrame([("b", 1, "王小明", "教師", 1, 2, 3, 4, "")], "batch_id string, row_ord long, name string, title string, pay long, prof long, mgr long, tutor long, person_id string")
    right = spark.createDataFrame([("b", 1, "X1", "李大華", "", 1, 2, 3, 4)], "batch_id string, row_ord long, person_id string, name string, dept string, pay long, prof long, mgr long, tutor long")
    assert sorted(r.status for r in compare.compare(left, right).collect()) == ["af_only", "pdf_only"]


def sequential(left, right):
    """The tiers one row after another."""
    used, pairs = set(), {}
    free = lambda test: [r for r in right if r["ord"] not in used and test(r)]

    def take(a, b, basis):
        used.add(b["ord"])
        pairs[a["ord"]] = (b["ord"], basis)

    ids = {r["id"]: r for r in right if r["id"]}
    for a in left:
        if a["id"] in ids and ids[a["id"]]["ord"] not in used:
            take(a, ids[a["id"]], 0)
    pending = []
    for a in left:
        if a["ord"] in pairs:
            continue
        c = free(lambda r: r["name"] == a["name"])
        if len(c) == 1:
            take(a, c[0], 1)
        elif c:
            pending.append(a)
    for tier, test in ((2, lambda a, r: a["dept"] and r["dept"] == a["dept"]), (3, lambda a, r: (r["mgr"] > 0) == (a["mgr"] > 0)), (4, lambda a, r: all(a[m] == r[m] for m in rules.MEASURES))):
        for a in pending:
            if a["ord"] not in pairs:
                c = free(lambda r: r["name"] == a["name"] and test(a, r))
                if len(c) == 1:
                    take(a, c[0], tier)
    for name in {a["name"] for a in pending}:
        rest, c = [a for a in pending if a["name"] == name and a["ord"] not in pairs], free(lambda r: r["name"] == name)
        if len(rest) == len(c) == 1:
            take(rest[0], c[0], 5)
    return pairs


def test_tiers_are_the_sequential_ones(spark):
    rng, left, right, want = random.Random(3), [], [], {}
    depts = {"教學組長": "教務處", "訓育組長": "學生事務處", "幹事": ""}
    for b in range(300):
        make = lambda i: {"ord": i, "name": rng.choice(["甲", "乙"]), "mgr": rng.choice([0, 5]), "pay": rng.randint(1, 3), "prof": 0, "tutor": 0}  # noqa: B023, E731
        ls = [make(i) | {"title": rng.choice(list(depts)), "id": rng.choice(["", "", f"I{i}"])} for i in range(rng.randint(0, 5))]
        ids = rng.sample(["I0", "I1", "I2", "I3", "I4", "J5"], 6)
        rs = [make(i) | {"dept": rng.choice(["教務處", "學務處", ""]), "id": rng.choice(["", ids[i]])} for i in range(rng.randint(0, 5))]
        norm = lambda d: {"教務處": "教務", "學務處": "學生事務", "學生事務處": "學生事務"}.get(d, "")
        want |= {(b, k): v for k, v in sequential([x | {"dept": norm(depts[x["title"]])} for x in ls], [x | {"dept": norm(x["dept"])} for x in rs]).items()}
        left += [(b, x["ord"], x["name"], x["title"], x["pay"], 0, x["mgr"], 0, x["id"]) for x in ls]
        right += [(b, x["ord"], x["id"], x["name"], x["dept"], x["pay"], 0, x["mgr"], 0) for x in rs]
    lf = spark.createDataFrame(left, "batch_id long, row_ord long, name string, title string, pay long, prof long, mgr long, tutor long, person_id string")
    rf = spark.createDataFrame(right, "batch_id long, row_ord long, person_id string, name string, dept string, pay long, prof long, mgr long, tutor long")
    rows = match.match_cascade(lf, rf)
    basis = {name: k for k, (name, _, _) in enumerate(match.TIERS)}
    got = {(r.batch_id, r.row_ord): (r.partner, basis[r.basis]) for r in rows.where("side = 'L' and partner is not null").collect()}
    assert got == want and {v[1] for v in want.values()} == set(range(6))
    # Each side's rows are in one pair at most, and pairs agree from both sides.
    back = {(r.batch_id, r.partner): r.row_ord for r in rows.where("side = 'R' and partner is not null").collect()}
    assert back == {k: v[0] for k, v in got.items()}


def test_closest_names():
    assert match.closest("ABC", ["AXC"], 0.75) is None and match.closest("ABCD", ["AXCD"], 0.75) == "AXCD"
    assert match.closest("ABC", ["AXC"], 0.5) == "AXC" and match.closest("AB", ["AX"], 0.5) == "AX" and match.closest("ABC", ["AXX"], 0.5) is None
    assert match.closest("ABC", ["AXC", "AYC"], 0.5) == "AYC"


def test_reordering(spark):
    roster = spark.createDataFrame([("b", i, s, n) for i, (s, n) in enumerate([("2", "甲一"), ("1", "甲二"), ("5", "甲一"), ("x", "丙"), ("3", ""), ("4", "己")])], "batch_id string, row_ord long, seq string, name string")
    table = spark.createDataFrame([("b", i, n, o) for i, (o, n) in enumerate([("a", "甲一"), ("b", "甲二"), ("c", "庚"), ("d", "甲一"), ("e", "庚")])], "batch_id string, row_ord long, name string, ord string")
    rows = reorder.reorder(roster, table).orderBy("part", "pos", "row_ord").collect()
    assert [(r.roster_seq, r.ord) for r in rows] == [(1, "b"), (5, "a"), (5, "d"), (5, "a"), (5, "d"), (5, "c"), (5, "e")]
    assert rows[0].asDict().keys() and reorder.reorder(roster, table).columns[0] == "roster_seq"
    assert [r.name for r in reorder.missing(roster, table).collect()] == ["己"]
    assert [r.name for r in reorder.extra_names(roster, table).collect()] == ["庚"]
    assert [r.name for r in reorder.duplicated_names(roster).collect()] == ["甲一"]


def one(spark, expr, **values):
    return spark.range(1).select(expr).first()[0]


def test_scalars(spark):
    money = {"1,234": 1234, "12.9": 12, "-3.7": -3, "nan": 0, "inf": 0, "1e3": 1000, "": 0, "abc": 0, " 5 ": 5, "１２": 12, "12d": 0, None: 0, "1_000": 1000, "1__0": 0, "_1": 0, "1_.5": 0, "1.2_5": 1, "\x1c7\x85": 7}
    money |= {"-0.5": 0, ".5": 0, "1.9999999999999": 1, "9007199254740993": 9007199254740992, "1.99999999999999999999": 2, "999999999999999": 999999999999999, "1/2": 0, "+-1": 0, "0x10": 0, "-007": -7, "\x001": 0, "1.5.2": 0}
    rows = spark.createDataFrame([(k, v) for k, v in money.items()], "x string, want long").select(text.money(F.col("x")), "want").collect()
    assert all(a == b for a, b in rows)
    lit = lambda f, *a: one(spark, f(*[F.lit(x) for x in a]))
    assert [lit(text.one_letter_apart, a, b) for a, b in (("ABC", "AXC"), ("ABC", "AXX"), ("AB", "ABC"), ("ABC", "ABC"))] == [True, False, False, False]
    assert [lit(text.title_head, t) for t in ("教師兼代理主任", "代理教師", "兼X")] == ["教師", "代理教師", ""]
    assert [lit(text.is_scanned_number, t) for t in ("93940_", "245(無)")] == [True, False]
    assert [one(spark, text.from_first_thousand(F.array(*[F.lit(n) for n in x]))) for x in ([245, 300, 41755, 80], [90, 80])] == [[41755, 80], None]
    assert [tuple(spark.range(1).select(*text.file_parts(F.lit(f))).first()) for f in ("x_123_11407001.xlsx", "x.xlsx")] == [("123", "11407"), ("", "")]
    assert [lit(text.title_department, t) for t in ("教師兼教務主任", "人事管理員", "教師", " ", "教學組長兼學務主任")] == ["教務處", "人事室", None, None, "教務處"]
    assert [lit(text.department, d) for d in ("學務處", " 健康中心", "輔導處", None)] == ["學生事務", "健康", "輔導", ""]
    assert lit(text.strip, "　a b\t") == "a b" and lit(text.is_formal, "代理教師") is False and lit(text.is_formal, "教師兼代理主任") is True
    assert [lit(text.sheet_number, x) for x in ("1,200", "12.7", "無", "0", "")] == ["1200", "12", "無", "0", ""]
    assert [one(spark, text.poll_seconds(F.lit(a), F.lit(b))) for a, b in ((1, 999), (0, 599), (0, 600))] == [3, 3, 60]
    assert [one(spark, text.clamp(F.lit(x))) for x in (1, 30, 99)] == [3, 30, 60]
    g = spark.createDataFrame([(0, 5), (5, 5), (9, 5)], "gross long, pay long")
    assert [tuple(r) for r in g.select(*text.sum_check(F.col("gross"), F.col("pay"))).collect()] == [(None, 0), (True, 0), (False, 4)]


def test_validation(spark):
    af = spark.createDataFrame([("b", 1, "A1", "王小明"), ("b", 2, "A2", "陳大華")], "batch_id string, row_ord long, person_id string, name string")
    rows = [
        ("b", 1, "王小明", "1 教師", "", False, "10", "5", "0", "0", "15", 0.9),
        ("b", 2, "王小朋", "教師", "", False, "10", "5", "0", "0", "15", None),
        ("b", 3, "誤認名", "教師", "a2", True, "10", "5", "0", "0", "15", 0.2),
        ("b", 4, "", "教師", "Z9", False, "10", "5", "0", "0", "1,016", 0.25),
        ("b", 5, "王小明", "教師", "", False, "10", "5", "0", "0", "", 0.9),
    ]
    scanned = spark.createDataFrame(rows, "batch_id string, row_ord long, name string, title string, person_id string, id_valid boolean, pay string, prof string, mgr string, tutor string, gross string, confidence double")
    out = validate.validate(scanned, af).orderBy("row_ord").collect()
    assert [(r.good, r.name) for r in out] == [(True, "王小明"), (True, "王小明"), (True, "陳大華"), (False, ""), (False, "王小明")]
    assert out[0].title == "教師" and len(out[3].reasons) == 4 and out[3].reasons[2] == "四項相加 15 與應發金額 1,016 不符（差 +1,001）" and out[4].reasons == ["未讀到應發金額，無法驗算"]
    good = validate.good_rows(validate.validate(scanned, af))
    fixed = spark.createDataFrame([("b", 9, " 陳大華 ", "教師", "1", "2", "0", "0", "3"), ("b", 10, "　", "", "", "", "", "", "")], "batch_id string, row_ord long, name string, title string, pay string, prof string, mgr string, tutor string, gross string")
    assert [r.name for r in validate.corrected(good, fixed).where("row_ord >= 9").collect()] == ["陳大華"]
    assert {r.person_id for r in good.collect()} == {"", "A2"}
    need = exclude.mark(validate.quarantined(validate.validate(scanned, af)).withColumn("name", F.col("suggested_name")).withColumn("title", F.lit("代課")))
    assert validate.promote(good, need).count() == 5


def test_registers(spark):
    tables = [[["序號\n姓名\n職稱", "1\n甲一\n教師", "2\n甲二"], ["本俸", "1,000", "2,000"], ["導師費", "30", None], ["特教加給", "4"], ["其他", "9", "9"]], [["序號\n姓名", "1\n改名\n工友"], ["本俸", "1,500"]], [["無關", "3\n丙"]], []]
    flat = [[["單位", "x"], ["姓 名/姓名", "職稱", "薪俸", "應發金額"], ["甲一", "教師", "10", "20"], ["合計", "", "10", "20"], ["甲一", "重複", "99", "99"], ["乙二", "幹事"]]]
    docs = spark.createDataFrame([("v", tables), ("h", flat)], "batch_id string, tables array<array<array<string>>>")
    rows = register.parse(register.cells(docs)).orderBy("batch_id", "row_ord").collect()
    assert [(r.batch_id, r.layout, r.name, r.title, r.pay, r.tutor, r.gross) for r in rows] == [
        ("h", "horizontal", "甲一", "教師", 10, 0, 20), ("h", "horizontal", "乙二", "幹事", 0, 0, None),
        ("v", "vertical", "甲一", "教師", 1500, 34, None), ("v", "vertical", "甲二", "", 2000, 0, None),
    ]
    pages = spark.createDataFrame([("a", 1, " "), ("a", 4, "x"), ("b", 2, "x")], "batch_id string, page_no int, text string")
    assert {r.batch_id: r.has_text for r in register.has_text_layer(pages).collect()} == {"a": False, "b": True}


def test_learning(spark):
    people = spark.createDataFrame([(b, "業務助理", f"n{b}{i}") for b in "xy" for i in range(2)] + [("x", "教師", "n"), ("x", "代理教師", "known")], "batch_id string, title string, name string")
    known = spark.createDataFrame([("x", "known")], "batch_id string, name string")
    seen = exclude.observe(people, known)
    assert {(r.title, r.verdict) for r in exclude.learn(exclude.merge(seen.union(seen))).collect()} == {("業務助理", "suggest"), ("代理教師", "wrong")}
    assert [tuple(r) for r in exclude.learned_by_batch(seen.withColumn("batch_ord", F.ascii("batch_id"))).collect()] == [("業務助理", ord("y"))]
    named = spark.createDataFrame([("x", ["助理"], ["n"], False)], "batch_id string, titles array<string>, names array<string>, use_default boolean")
    got = {r.name: r.secondary_reason for r in exclude.mark(people.where("batch_id = 'x'"), named).collect()}
    saved = named.withColumnRenamed("batch_id", "tenant")
    after = exclude.with_learned(saved, exclude.merge(seen)).first()
    assert (after.titles, after.names, after.use_default, after.changed) == (["助理", "業務助理"], ["n"], False, True)
    assert not exclude.with_learned(exclude.remember(saved, saved), exclude.merge(seen).limit(0)).first().changed
    assert [tuple(r) for r in exclude.suggested_titles(people).collect()] == [("x", ["代理教師"])]
    assert [r.title for r in exclude.by_total(exclude.merge(seen)).orderBy("place").collect()] == ["業務助理", "代理教師", "教師"]
    assert got == {"nx0": "職稱含「助理」", "nx1": "職稱含「助理」", "n": "個別指定", "known": None}


def test_sheets(spark, tmp_path):
    rows = spark.createDataFrame([("f", 2, "甲<一", "1,200"), ("f", 1, "乙", "無")], "batch_id string, row_ord long, `姓名` string, `總金額.1` string")
    typed = rows.withColumn("總金額.1", text.sheet_number(F.col("`總金額.1`")))
    content = sheet.write_sheets(typed, ["姓名", "總金額.1"], ["row_ord"]).first().content
    (tmp_path / "f.xlsx").write_bytes(content)
    got = sheet.read_sheets(spark, str(tmp_path)).orderBy("row_ord")
    assert [r.cells for r in got.collect()] == [{"姓名": "乙", "總金額.1": "無"}, {"姓名": "甲<一", "總金額.1": "1200"}]
    assert [tuple(r)[1:] for r in sheet.columns_of(got, {"name": "姓名", "dept": "單位"}).collect()] == [(0, "乙", ""), (1, "甲<一", "")]
    assert sheet.deduplicated(["x", "x ", "x", ""]) == ["x", "x", "x.1", "Unnamed: 3"]
    assert sheet.table_columns(rows).columns == ["姓名", "總金額.1"]
    with pytest.raises(ValueError, match="no sheet"):
        list(sheet.sheet_rows(content, "input"))


def test_reports(spark):
    rows = spark.createDataFrame([("b", 2, "<x>", None), ("b", 1, "y", 3)], "batch_id string, row_ord long, name string, n long")
    html = reports.html_tables(rows, ["name", "n"], ["row_ord"], "name").first().html
    assert html.index('<td class="name">y</td><td>3</td>') < html.index('<td class="name">&lt;x&gt;</td><td></td>')
    page = spark.range(1).select(reports.html_page(F.lit("t"), F.lit("a&b"), F.lit(html)), reports.audit_form(F.lit("u"), F.lit("1"), F.lit("2"))).first()
    assert "a&amp;b" in page[0] and page[1].count("<tr>") == 22 and page[1].count("錯誤情形") == 8 and "技工工友稽核筆數" in page[1]


def test_template(spark):
    import io
    import zipfile

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>{{{{un</w:t></w:r><w:r><w:t>it}}}} no</w:t></w:r></w:p><w:txbxContent><w:p><w:r><w:t>no</w:t></w:r></w:p></w:txbxContent></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
    got = zipfile.ZipFile(io.BytesIO(reports.fill_template(out.getvalue(), {"{{unit}}": "U"}, {"no": "7"}))).read("word/document.xml").decode()
    assert "U no" in got and ">7<" in got


def test_state(spark, tmp_path):
    spark.conf.set("tallyweave.state", str(tmp_path))
    assert state.load(spark, "events").count() == 0
    for n in (1, 2):
        state.append(spark.createDataFrame([("visits", n)], "key string, n long"), "events")
    assert [tuple(r) for r in state.counters(state.load(spark, "events")).collect()] == [("visits", 3)]
    spark.conf.unset("tallyweave.state")
    settings = exclude.save_settings(spark.createDataFrame([("t", ["a"], ["n"], False)], state.SCHEMAS["settings"]), spark.createDataFrame([("t", [" b ", "", "b"], ["m"], None), (" ", ["z"], [], None)], state.SCHEMAS["settings"]))
    assert {r.tenant: (r.titles, r.names, r.use_default) for r in settings.collect()} == {"t": (["b"], ["m"], False), "_default": (["z"], [], True)}


def test_state_upserts_and_results(spark, tmp_path):
    spark.conf.set("tallyweave.state", str(tmp_path))
    schema = "title string, total long, in_af long, files long, at int"
    state.upsert(spark.createDataFrame([("a", 1, 0, 1, 1), ("a", 2, 0, 2, 2), ("b", 5, 5, 1, 1)], schema), "title_stats", ["title"], "at")
    state.upsert(spark.createDataFrame([("b", 6, 5, 2, 1), ("c", 1, 1, 1, 1)], schema), "title_stats", ["title"], "at")
    assert sorted(tuple(r) for r in state.current(spark, "title_stats").collect()) == [("a", 2, 0, 2), ("b", 6, 5, 2), ("c", 1, 1, 1)]
    assert state.current(spark, "settings").count() == 0 and state.diagnosis(spark).first().on_volume
    spark.conf.unset("tallyweave.state")
    assert not state.diagnosis(spark).first().on_volume
    folder = str(tmp_path / "kept")
    state.keep_result(spark.createDataFrame([(1, 0, "x", None), (2, 1, "b", 1), (2, 0, "a", 2)], "batch_id int, place int, name string, n int"), folder)
    state.keep_result(spark.createDataFrame([(1, 0, "y", 3)], "batch_id int, place int, name string, n int"), folder)
    got = {r.batch_id: r.records for r in state.kept_records(spark, folder, "place").collect()}
    assert got == {1: '[{"name":"y","n":"3"}]', 2: '[{"name":"a","n":"2"},{"name":"b","n":"1"}]'}


def test_large_files_are_refused(spark, tmp_path):
    from tallyweave.sources import scans

    (tmp_path / "x.xlsx").write_bytes(b"x" * 100)
    with pytest.raises(Exception, match="larger than 10 bytes"):
        sheet.read_sheets(spark, str(tmp_path), most_bytes=10).collect()
    inbox = scans.inbox(spark, str(tmp_path), 10)
    (tmp_path / "y.pdf").write_bytes(b"abc")
    q = inbox.writeStream.format("memory").queryName("inbox").option("checkpointLocation", str(tmp_path.parent / "inbox")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = {r.path.rsplit("/", 1)[-1]: (r.content, r.error) for r in spark.table("inbox").collect()}
    assert got == {"x.xlsx": (None, "larger than 10 bytes"), "y.pdf": ("YWJj", None)}
    assert [bytes(r.content) for r in scans.received(spark.table("inbox")).collect()] == [b"abc"]


def test_likeness_is_the_library():
    import difflib

    rng = random.Random(8)
    names = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))) for _ in range(60)})
    own = match.Likeness(names)
    for _ in range(400):
        name = "".join(rng.choice("abcde") for _ in range(rng.randint(1, 6)))
        for cutoff in (0.5, 0.75):
            assert own.closest(name, cutoff) == next(iter(difflib.get_close_matches(name, names, 1, cutoff)), None)


def test_corrections_and_warnings(af, slips):
    records = consolidate.consolidate(af)
    assert sorted(r.warning for r in consolidate.warnings(af, records).collect()) == ["AF 出現未知職務加給代碼 X9999（丙三），未納入比對", "AF 有 2 位同名「乙同」，將以職稱／單位區辨"]
    assert consolidate.names(records).first().names == ["丁四五六", "丙三", "乙同", "甲一", "甲二"]
    wrong = validate.annotate_sums(slips.withColumn("gross", F.when(F.col("row_ord") <= 2, 1).otherwise(F.col("gross"))))
    assert validate.bad_sums(wrong).first().warning == "薪資清冊本身加總不符（各項相加 ≠ 應發金額）：甲一、甲二，請先確認清冊是否正確"
    good = slips.where("row_ord < 6").select("batch_id", "row_ord", "name", "title", "person_id", "pay", "prof", "mgr", "tutor", "gross")
    fixed = slips.where("row_ord = 6").withColumn("name", F.lit(" 丙三 "))
    got = {(r.name, r.status) for r in compare.with_corrections(good, fixed, records).collect()}
    assert ("丙三", "diff") in got and len(got) == 5


def test_job_steps():
    s = jobs.step(None, 0, "upload", 0)
    for command, ts, told in (("claim", 1, "held"), ("start", 2, "pending"), ("status", 100, "pending"), ("status", 123, "timeout"), ("claim", 124, "processing"), ("result", 130, "done"), ("review", 131, "need_review"), ("submit", 140, "removed"), ("status", 141, "unknown")):
        s = jobs.step(s[0], s[1], command, ts)
        assert s[2] == told, command
    assert jobs.step("pending", 0, "claim", 601)[2] == "unknown"


def test_job_stream(spark, tmp_path):
    commands = [("j", 0.0, "upload"), ("j", 1.0, "start"), ("k", 1.0, "upload"), ("j", 2.0, "claim"), ("j", 3.0, "result"), ("j", 4.0, "finish"), ("k", 5.0, "claim")]
    spark.createDataFrame(commands, "job_id string, ts double, command string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job_id string, ts double, command string").parquet(str(tmp_path / "in"))
    q = jobs.job_states(stream).writeStream.format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert [r.status for r in spark.table("told").where("job_id = 'j'").orderBy("ts").collect()] == ["held", "pending", "processing", "done", "removed"]
    assert [r.status for r in spark.table("told").where("job_id = 'k'").orderBy("ts").collect()] == ["held", "held"]


def test_title_stream(spark, tmp_path):
    rows = [("x", "t", 2, 0), ("x", "t", 2, 0), ("y", "t", 1, 1)]
    spark.createDataFrame(rows, state.SCHEMAS["observations"]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(state.SCHEMAS["observations"]).parquet(str(tmp_path / "in"))
    q = jobs.title_totals(stream).writeStream.format("memory").queryName("totals").option("checkpointLocation", str(tmp_path / "c")).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert [tuple(r) for r in spark.table("totals").collect()] == [("t", 3, 1, 2)]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in queries.SQL])
def test_driver_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and v == int(v) else v
    lines = lambda f: sorted(str([plain(v) for v in r]) for r in f[columns].astype(object).itertuples(index=False))
    assert lines(got) == lines(want)


def test_scan_messages(spark):
    from tallyweave.sources import scans

    raw = spark.createDataFrame([('{"job_id":"j","people":[{"姓名":"甲","薪俸":10,"應發金額":"10","身分證有效":true,"欄位信心":{"a":0.9,"b":0.4}},{"姓名":"乙"}]}',), ('{"job_id":"k","error":"' + "x" * 400 + '"}',)], "value string")
    assert [(r.name, r.pay, r.id_valid, r.confidence) for r in scans.people(raw).orderBy("row_ord").collect()] == [("甲", "10", True, 0.4), ("乙", None, False, None)]
    assert [(r.job_id, r.status, len(r.error or "")) for r in scans.messages(raw).orderBy("job_id").collect()] == [("j", "done", 0), ("k", "failed", 300)]
    assert [tuple(r) for r in scans.scan_summary(scans.people(raw)).collect()] == [("j", 2, 1)]
    assert len(spark.range(1).select(scans.job_id()).first()[0]) == 12


def _told(spark, source, folder, **how):
    """What the queue has told of the files there are by now."""
    with queue.several_states(spark):
        stream = queue.queues(spark.readStream.schema(queue.COMMANDS).option("maxFilesPerTrigger", 1).parquet(source), **how)
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    assert spark.conf.get(queue.several_states.KEY, "").endswith("HDFSBackedStateStoreProvider") or spark.conf.get(queue.several_states.KEY, None) is None
    return sorted(((r.queue, r.ts // 1000 - 1_000_000, r.command, r.job_id, r.status, r.changed) for r in spark.read.parquet(f"{folder}/out").collect()), key=str)


def test_queue_claims_and_clock(spark, tmp_path):
    """Claims name no job and are given once, over several batches and a restart; waiting jobs time out and lapse with nobody asking."""
    source = str(tmp_path / "in")

    def send(*rows):
        frame = spark.createDataFrame([(q, i, float(s), c, j) for i, (q, s, c, j) in enumerate(rows)], "queue string, seq long, s double, command string, job_id string")
        frame.select("queue", "seq", F.timestamp_seconds(F.col("s") + 1_000_000).alias("ts"), "command", "job_id").coalesce(1).write.mode("append").parquet(source)

    send(("a", 0, "upload", "1"), ("a", 1, "upload", "2"), ("a", 2, "start", "2"), ("a", 3, "start", "1"), ("a", 4, "claim", None), ("b", 4, "claim", None))
    first = _told(spark, source, tmp_path / "x", late="0 seconds")
    assert ("a", 4, "claim", "1", "processing", True) in first and ("b", 4, "claim", None, "none", False) in first and len(first) == 6
    # In another run: the second claim gets the other job, the third none; the first job's result comes, the second's never.
    send(("a", 10, "claim", None), ("a", 11, "claim", None), ("a", 12, "result", "1"), ("a", 13, "review", "1"), ("c", 14, "upload", "9"))
    told = [x for x in _told(spark, source, tmp_path / "x", late="0 seconds") if x not in first]
    assert [x[3:5] for x in told if x[2] == "claim"] == [("2", "processing"), (None, "none")] and not [x for x in told if x[2] == "timer"]
    # Only another queue speaks, and time goes by: job 2 times out, and later all that are left lapse, each told once.
    send(("b", 130, "claim", None))
    timers = lambda: [x for x in _told(spark, source, tmp_path / "x", late="0 seconds") if x[2] == "timer"]
    assert timers() == [("a", 122, "timer", "2", "timeout", False)]
    send(("b", 2000, "claim", None))
    lapsed = [("a", 122, "timer", "2", "timeout", False), ("a", 602, "timer", "2", "expired", True), ("a", 603, "timer", "1", "expired", True), ("c", 614, "timer", "9", "expired", True)]
    assert timers() == sorted(lapsed, key=str)
    send(("a", 2001, "status", "2"), ("a", 2002, "claim", None))
    assert [x[4] for x in _told(spark, source, tmp_path / "x", late="0 seconds") if x[1] > 2000] == ["unknown", "none"]


def test_queue_by_one_list():
    """Random commands in random batches against a plain list of jobs."""
    random.seed(4)
    commands, t = [], 0
    for i in range(600):
        t += random.choice([0, 5_000, 40_000, 200_000])
        kind = random.choice(["upload", "upload", "start", "start", "claim", "result", "error", "status", "submit"])
        commands.append((t, i, kind, None if kind == "claim" else f"j{i}" if kind == "upload" else f"j{random.randint(max(0, i - 12), i)}"))
    want, live = [], {}
    for now, seq, kind, job in commands:
        for name, (_, created, late) in list(live.items()):
            if live[name][0] in ("pending", "processing") and not late and now - created > 120_000:
                want.append((created + 120_001, None, "timer", name, "timeout", False))
                live[name] = live[name][0], created, True
            if now - created > 600_000:
                want.append((created + 600_001, None, "timer", name, "expired", True))
                del live[name]
        if kind == "claim":
            job = next((name for name, x in live.items() if x[0] == "pending"), None)
            if job is None:
                want.append((now, seq, kind, None, "none", False))
                continue
        status, created, late = live.get(job, (None, 0, False))
        to, since, told, changed = jobs.step(status, created, kind, now, 600_000, 120_000)
        if to is None:
            live.pop(job, None)
        else:
            live[job] = to, since, late and since == created
        want.append((now, seq, kind, job, told, changed))
    got, state_ = [], {}
    while commands:
        n = random.randint(1, 40)
        own = queue.Jobs(dict(state_), 600_000, 120_000)
        for c in commands[:n]:
            got += own.take(*c)
        state_, commands = own.jobs, commands[n:]
    assert sorted(got, key=str) == sorted(want, key=str) and len({x[4] for x in got}) > 7


def test_corrected_rows_are_validated_once(spark, monkeypatch, capsys):
    """Good and corrected rows of a comparison come of one pass over the scanned rows."""
    frames, keep = [], match.checkpointed
    for module in (match, queries):
        monkeypatch.setattr(module, "checkpointed", lambda df: (frames.append(df), keep(df))[1], raising=False)
    frames.append(queries.corrected_comparison(spark, "/root/testdata/sf0.001"))
    capsys.readouterr()
    passes = 0
    for df in frames:
        df.explain()
        passes += capsys.readouterr().out.split("Initial Plan")[-1].count("FlatMapCoGroupsInPandas")
    assert passes == 1


def test_queue_calls_of_the_store():
    """A job that comes and goes within one batch makes no call of the store, and many answers are few rows."""

    class Store(dict):
        def __init__(self):
            self.calls, self.timers = [], set()

        def iterator(self):
            return iter([((k,), v) for k, v in self.items()])

        def updateValue(self, key, value):
            self.calls.append("put")
            self[key[0]] = value

        def removeKey(self, key):
            self.calls.append("remove")
            del self[key[0]]

        def registerTimer(self, at):
            self.timers.add(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    own = queue.Queue(600, 120)
    own.state = own.handle = store = Store()
    row = Row("queue", "queue", "ts", "seq", "command", "job_id")
    command = lambda s, seq, what, job: row("a", "a", datetime.fromtimestamp(s, UTC), seq, what, job)
    many = [command(i, 2 * i + k, what, f"j{i}") for i in range(15_000) for k, what in enumerate(("upload", "submit"))]
    told = list(own.handleInputRows(("a",), iter([*many, command(15_000, 30_000, "upload", "last")]), None))
    assert [len(x.seq) for x in told] == [10_000, 10_000, 10_000, 1] and told[0].status[:2] == ("held", "removed") and told[3].ts == (15_000_000,)
    assert store.calls == ["put"] and store == {"last": (15_000, "held", 15_000_000, False)} and store.timers == {15_600_001}
    # In the next batch the stored job goes, with its timer.
    assert [x.status for x in own.handleInputRows(("a",), iter([command(15_001, None, "submit", "last")]), None)] == [("removed",)]
    assert store.calls == ["put", "remove"] and not store and not store.timers


def test_queue_clock_in_another_time_zone(spark, tmp_path):
    """Times are those of the clock, whatever the session's time zone; commands without a queue form one of their own."""
    rows = [(None, 0, 0.0, "upload", "1"), (None, 1, 1.0, "start", "1"), ("b", 2, 100.0, "upload", "2")]
    frame = spark.createDataFrame(rows, "queue string, seq long, s double, command string, job_id string")
    frame.select("queue", "seq", F.timestamp_seconds(F.col("s") + 1_000_000).alias("ts"), "command", "job_id").coalesce(1).write.parquet(str(tmp_path / "in"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Taipei")
    try:
        told = _told(spark, str(tmp_path / "in"), tmp_path / "x", late="0 seconds", timeout=60)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert told == sorted([(None, 0, "upload", "1", "held", True), (None, 1, "start", "1", "pending", True), ("b", 100, "upload", "2", "held", True), (None, 61, "timer", "1", "timeout", False)], key=str)


PEOPLE = "batch_id string, tenant string, batch_ord long, title string, name string"


def _taught():
    """Helpers are seen in 1, 2 and 4, and known in 5; aides in 3 and 6, never enough."""
    rows = [("01", "A", 1, "業務助理", "a"), ("01", "A", 1, "業務助理", "b"), ("02", "B", 2, "業務助理兼組長", "c"), ("02", "B", 2, "業務助理", "d"), ("02", "B", 2, None, "e")]
    rows += [("03", "A", 3, "業務助理", "f"), ("03", "A", 3, "隊輔員", "g"), ("04", "C", 4, "業務助理", "h"), ("05", "D", 5, "業務助理", "known"), ("06", "D", 6, "業務助理", "i"), ("06", "D", 6, "隊輔員", "j"), ("07", "C", 7, "業務助理", "k"), ("07", "C", 7, "代理教師", "l")]
    # The title is suggested after batches 2, 3 and 4, so B, A and C learn it there and keep it; D comes when it isn't any more.
    return rows, {"c": "職稱含「業務助理」", "d": "職稱含「業務助理」", "f": "職稱含「業務助理」", "h": "職稱含「業務助理」", "k": "職稱含「業務助理」", "l": "職稱含「代理」"}


def test_learning_as_of_a_batch(spark):
    rows, want = _taught()
    people = spark.createDataFrame(rows, PEOPLE)
    batches = people.select("batch_id", "tenant", "batch_ord").distinct()
    known = spark.createDataFrame([("05", "known")], "batch_id string, name string")
    seen = exclude.observe(people, known).join(batches, "batch_id")
    assert {(r.title, r.since, r.until) for r in exclude.learned_spans(seen).collect()} == {("業務助理", 2, 5)}
    got = exclude.mark_as_of(people, seen, batches)
    assert {r.name: r.secondary_reason for r in got.collect() if r.secondary} == want and got.count() == len(rows)
    # A tenant's own words go by their order among the learned ones, and stay without any.
    own = spark.createDataFrame([("A", ["助理", "隊輔員"], ["b"], False), ("C", ["教師"], [], False)], "tenant string, titles array<string>, names array<string>, use_default boolean")
    got = {r.name: r.secondary_reason for r in exclude.mark_as_of(people, seen, batches, own).collect()}
    assert (got["a"], got["f"], got["g"], got["h"], got["l"], got["d"]) == ("職稱含「助理」", "職稱含「助理」", "職稱含「隊輔員」", "職稱含「業務助理」", "職稱含「教師」", "職稱含「業務助理」")
    assert exclude.mark_as_of(people.limit(0), seen, batches).count() == 0 and exclude.mark_as_of(people, seen.limit(0), batches).where("secondary").count() == 1


def test_learning_stream_and_restart(spark, tmp_path, monkeypatch):
    rows, want = _taught()
    known = spark.createDataFrame([("05", "known")], "batch_id string, name string")
    read = lambda: spark.readStream.schema(PEOPLE).parquet(str(tmp_path / "in"))
    run = lambda: learning.learn_and_mark(read(), known, str(tmp_path / "state"), str(tmp_path / "progress")).awaitTermination(120)
    reasons = lambda: {r.name: r.secondary_reason for r in learning.marked(spark, str(tmp_path / "state")).collect() if r.secondary}
    send = lambda *which: spark.createDataFrame([r for r in rows if r[2] in which], PEOPLE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    send(1, 2)
    run()
    assert reasons() == {k: want[k] for k in "cd"}
    # A part fails after its observations are written; the stream is started again and takes the part once more.
    send(3, 4, 5)
    keep = state.keep_result
    monkeypatch.setattr(learning.state, "keep_result", lambda df, folder: keep(df, folder) if folder.endswith("seen") else 1 / 0)
    with pytest.raises(Exception, match="ZeroDivision|division"):
        run()
    monkeypatch.setattr(learning.state, "keep_result", keep)
    assert set(reasons()) == set("cd") and learning.remembered(spark, str(tmp_path / "state")).where("batch_id = '03'").count() == 3
    run()
    send(6, 7)
    run()
    assert reasons() == want and learning.marked(spark, str(tmp_path / "state")).count() == len(rows)
    # The same parts over again leave the same rows.
    before = sorted(map(str, learning.marked(spark, str(tmp_path / "state")).collect()))
    learning.step(spark.createDataFrame([r for r in rows if r[2] in (6, 7)], PEOPLE), known, str(tmp_path / "state"))
    assert sorted(map(str, learning.marked(spark, str(tmp_path / "state")).collect())) == before


def test_sheet_format(spark, tmp_path):
    spark.dataSource.register(sheet_format.SheetSource)
    df = spark.createDataFrame([("b/1", 2, "二", 7), ("b/1", 1, "一", None), ("c", 1, "", 9)], "batch_id string, row_ord long, ` 姓名 ` string, n int")
    folder = str(tmp_path / "out")
    sheet_format.save_sheets(df, folder, ["row_ord"])
    assert sorted(x.name for x in (tmp_path / "out").iterdir()) == ["b%2F1.xlsx", "c.xlsx"]
    rows = spark.read.format("sheet").load(folder)
    assert rows.columns == ["batch_id", "row_ord", "姓名", "n"] and rows.rdd.getNumPartitions() == 2
    assert sorted(map(tuple, rows.collect())) == [("b/1.xlsx", 0, "一", ""), ("b/1.xlsx", 1, "二", "7"), ("c.xlsx", 0, "", "9")]
    # A given schema chooses columns, and one that a workbook lacks is ''; other files in the folder aren't read.
    (tmp_path / "out" / "note.txt").write_text("x")
    assert sorted(map(tuple, spark.read.format("sheet").schema("n string, `單位` string").load(folder).collect())) == [("", ""), ("7", ""), ("9", "")]
    assert spark.read.format("sheet").option("sheet", "result").load(f"{folder}/c.xlsx").count() == 1
    with pytest.raises(Exception, match="no sheet named"):
        spark.read.format("sheet").option("sheet", "input").load(folder).count()
    with pytest.raises(Exception, match="larger than 10 bytes"):
        spark.read.format("sheet").option("maxBytes", 10).load(folder).count()
    with pytest.raises(Exception, match="no such path"):
        spark.read.format("sheet").load(f"{folder}/none").count()
    # Overwriting takes the old workbooks away, appending leaves them.
    sheet_format.save_sheets(df.where("batch_id = 'c'").withColumn("batch_id", F.lit("d")), folder, ["row_ord"])
    sheet_format.save_sheets(df.where("batch_id = 'c'").withColumn("batch_id", F.lit("e")), folder, ["row_ord"], mode="overwrite")
    assert sorted(x.name for x in (tmp_path / "out").iterdir()) == ["e.xlsx", "note.txt"]


def test_a_failed_task_leaves_no_sheet(spark, tmp_path):
    folder = str(tmp_path / "out")
    df = spark.range(0, 40, 1, 4).select((F.col("id") / 10).cast("int").cast("string").alias("batch_id"), "id")
    spark.dataSource.register(sheet_format.SheetSource)

    def killed(frames):
        for frame in frames:
            if (frame.id >= 30).any():
                raise RuntimeError("the task is lost")
            yield frame

    with pytest.raises(Exception, match="the task is lost"):
        df.mapInPandas(killed, df.schema).write.format("sheet").mode("append").save(folder)
    # A task that still ran may have left its own file beside the results, none among them.
    assert not list((tmp_path / "out").glob("*.xlsx")) and spark.read.format("sheet").load(folder).count() == 0
    # A second attempt's files count, the first one's don't; rows of a batch in two tasks fail as a whole.
    writer = sheet_format.SheetWriter(df.schema, {"path": folder}, False)
    row = [("x", 1), ("x", 2)]
    writer.write(iter(row[:1]))
    writer.commit([writer.write(iter(row))])
    assert len(list(sheet.sheet_rows((tmp_path / "out" / "x.xlsx").read_bytes()))) == 3 and [x.name for x in (tmp_path / "out").glob("*.xlsx")] == ["x.xlsx"]
    with pytest.raises(ValueError, match="several tasks"):
        writer.commit([writer.write(iter(row)), writer.write(iter(row))])
    assert len(list((tmp_path / "out").glob("*.xlsx"))) == 1


def test_extractors(spark, tmp_path):
    (tmp_path / "a.txt").write_text("姓名\t本俸\n甲一\t100\n\n姓名\t本俸\n乙二\t2,000\n")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "c.txt").write_text("no table here")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    docs = register.extracted(files, lambda data: [[line.split("\t") for line in t.splitlines()] for t in data.decode().split("\n\n") if "\t" in t])
    assert {(r.batch_id, r.name, r.pay) for r in register.parse(register.cells(docs)).collect()} == {("a.txt", "甲一", 100), ("a.txt", "乙二", 2000)}
    assert {(r.batch_id, r.error.split(":")[0]) for r in register.refused(docs).collect()} == {("b.txt", "UnicodeDecodeError"), ("c.txt", "no tables")}


def test_unreadable_state(spark, tmp_path):
    spark.conf.set("tallyweave.state", str(tmp_path))
    try:
        assert state.unreadable(spark, "events").count() == 0
        state.append(spark.createDataFrame([("k", 1)], state.SCHEMAS["events"]), "events")
        (tmp_path / "events" / "part-broken.parquet").write_bytes(b"not a table")
        (tmp_path / "schools").mkdir()
        (tmp_path / "schools" / "part-0.parquet").write_bytes(b"PAR1")
        assert [tuple(r) for r in state.load(spark, "events").collect()] == [("k", 1)] and state.load(spark, "schools").count() == 0
        assert [r.path.rpartition("/")[2] for r in state.unreadable(spark, "events").collect()] == ["part-broken.parquet"]
        # A version counts only when its number is there.
        row = lambda n: spark.createDataFrame([("t", n, 0, 1)], state.SCHEMAS["title_stats"])
        state.save(row(1), "title_stats")
        row(2).write.parquet(f"{tmp_path}/title_stats/version=2")
        assert [r.total for r in state.current(spark, "title_stats").collect()] == [1]
        state.save(row(3), "title_stats")
        assert [r.total for r in state.current(spark, "title_stats").collect()] == [3]
    finally:
        spark.conf.unset("tallyweave.state")
