"""Report texts: HTML rows and pages, JSON payloads, and template filling in documents."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.text import escaped

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def html_row(columns: list[str], name: str | None = None) -> Column:
    """A table row of escaped cells; the name's cell has its class."""
    cells = [F.concat(F.lit('<td class="name">' if c == name else "<td>"), escaped(F.col(f"`{c}`")), F.lit("</td>")) for c in columns]
    return F.concat(F.lit("<tr>"), *cells, F.lit("</tr>"))


def html_tables(df: DataFrame, columns: list[str], order: list[str], name: str | None = None) -> DataFrame:
    """(batch_id, html): one table per batch, its rows in order; a batch is one file."""
    rows = df.select("batch_id", F.struct(*order, html_row(columns, name).alias("row")).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["row"]), "\n")
    head = "<tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr>"
    return rows.groupBy("batch_id").agg(F.concat(F.lit(f"<table><thead>{head}</thead><tbody>"), body, F.lit("</tbody></table>")).alias("html"))


def html_page(title: Column, unit: Column, table: Column) -> Column:
    return F.concat(F.lit('<!DOCTYPE html><html lang="zh-TW"><head><meta charset="UTF-8"><title>'), escaped(title), F.lit("</title></head><body><h2>"), escaped(unit), F.lit("</h2><h3>"), escaped(title), F.lit("</h3>"), table, F.lit("</body></html>"))


#: The audit form's texts, and the columns that its cells span.
AUDIT_TITLE = "高雄市政府教育局所屬機關學校 待遇稽核情形紀錄表"
AUDIT_GROUPS = ("一般人員<br>(含約脩僱人員)稽核筆數", "技工工友稽核筆數")
AUDIT_COUNTS = (("錯誤筆數", 2, 3), ("正確率", 3, None))
AUDIT_NAME, AUDIT_ITEMS = "姓　名", "抽　驗　項　目"
AUDIT_COLUMNS = (("薪俣表別", 1), ("薪俣支領數額", 2), ("專業加給表別", 2), ("專業加給支領數額", 1), ("職務加給表別", 2), ("職務加給支領數額", 1), ("地域加給表別", 2), ("地域加給支領數額", 1))
AUDIT_STATES = ("錯誤情形", "正確情形")
AUDIT_HEAD = (("編號：", "　　　", "　　"), ("學校名稱：", "　　　　　　　", "　　"), ("稽核月份：", "　　　", ""))
AUDIT_FOOT = ("稽核人員機關學校：　　　　　　　　　　　　職稱：　　　　　　姓名：＿＿＿＿＿＿＿", "該組負責人核章：＿＿＿＿＿＿＿＿＿＿＿", "本局承辦人：＿＿＿＿＿＿＿＿＿＿＿　　人事主任：＿＿＿＿＿＿＿＿＿＿＿＿＿")


def _cell(tag: str, text: str = "", columns: int = 1, rows: int = 1) -> str:
    spans = (f' colspan="{columns}"' if columns > 1 else "") + (f' rowspan="{rows}"' if rows > 1 else "")
    return f"<{tag}{spans}>{text}</{tag}>"


def _audit_table(group: str, blocks: int) -> str:
    row = lambda *cells: f"<tr>{''.join(cells)}</tr>"
    (wrong, wide, gap), (rate, broad, _) = AUDIT_COUNTS
    first = row(_cell("th", group, 2), _cell("th", "", 2), _cell("th", wrong, wide), _cell("th", "", gap), _cell("th", rate, broad), _cell("th", "%", 2))
    second = row(_cell("th", AUDIT_NAME, 2, 2), _cell("th", AUDIT_ITEMS, sum(n for _, n in AUDIT_COLUMNS)))
    third = row(*[_cell("th", text, n) for text, n in AUDIT_COLUMNS])
    blank = "".join(_cell("td", "", n) for _, n in AUDIT_COLUMNS)
    person = "".join(row(_cell("td", "", 1, len(AUDIT_STATES)) if k == 0 else "", _cell("td", state), blank) for k, state in enumerate(AUDIT_STATES))
    return f'<table class="audit-tbl"><thead>{first}{second}{third}</thead><tbody>{person * blocks}</tbody></table>'


def audit_form(unit: Column, number: Column, month: Column, blocks: int = 4) -> Column:
    """The audit form: title, number, school and month, a table of `blocks` blank persons for each of the two groups, and the lines to sign. Blank values leave room to write."""
    given = [F.concat(F.lit(label), F.when(F.coalesce(x, F.lit("")) != "", escaped(x)).otherwise(room), F.lit(behind)) for (label, room, behind), x in zip(AUDIT_HEAD, (number, unit, month), strict=True)]
    tables = "<br>".join(_audit_table(group, blocks) for group in AUDIT_GROUPS)
    return F.concat(F.lit(f'<div class="audit-title">{AUDIT_TITLE}</div><div>'), *given, F.lit(f"</div>{tables}<div>{'<br>'.join(AUDIT_FOOT)}</div>"))


def sample_template() -> bytes:
    """A small document with a placeholder parted between runs, and one both in its body and in a text box."""
    w = WORD.strip("{}")
    run = lambda *texts: "<w:p>" + "".join(f"<w:r><w:t>{t}</w:t></w:r>" for t in texts) + "</w:p>"
    body = run("for &lt;學", "校&gt; &lt;編號&gt;") + f"<w:txbxContent>{run('&lt;編號&gt;')}</w:txbxContent>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def template_texts(filled: DataFrame) -> DataFrame:
    """(batch_id, body, box) of filled documents: the paragraphs' texts outside and inside text boxes, on lines."""

    def run(batches):
        for batch in batches:
            trees = [ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(c)).read("word/document.xml")) for c in batch.content]
            text = lambda p: "".join(t.text or "" for t in p.iter(f"{WORD}t"))
            boxes = [[p for b in t.iter(f"{WORD}txbxContent") for p in b.iter(f"{WORD}p")] for t in trees]
            body = ["\n".join(text(p) for p in t.iter(f"{WORD}p") if p not in inside) for t, inside in zip(trees, boxes, strict=True)]
            yield batch[["batch_id"]].assign(body=body, box=["\n".join(map(text, inside)) for inside in boxes])

    return filled.mapInPandas(run, f"batch_id {filled.schema['batch_id'].dataType.simpleString()}, body string, box string")


def filled_templates(df: DataFrame, template: bytes, values: dict[str, str], boxes: dict[str, str]) -> DataFrame:
    """(batch_id, content): the template filled for each row; `values` and `boxes` name the column for each placeholder."""
    columns = sorted({*values.values(), *boxes.values()})

    def run(batches):
        for batch in batches:
            filled = [fill_template(template, {k: row[c] for k, c in values.items()}, {k: row[c] for k, c in boxes.items()}) for row in batch.to_dict("records")]
            yield batch[["batch_id"]].assign(content=filled)

    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]
    return df.select("batch_id", *texts).mapInPandas(run, f"batch_id {df.schema['batch_id'].dataType.simpleString()}, content binary")


def payload(**columns: Column) -> Column:
    """A JSON object of the columns."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in columns.items()]))


def fill_template(template: bytes, values: dict[str, str], boxes: dict[str, str] | None = None) -> bytes:
    """A .docx with placeholders replaced: `values` in every paragraph, `boxes` in text boxes alone. A placeholder may be parted between runs; the text then goes to the first."""
    src, out = zipfile.ZipFile(io.BytesIO(template)), io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for item in src.namelist():
            data = src.read(item)
            if item == "word/document.xml":
                tree = ElementTree.fromstring(data)
                for old, new in values.items():
                    _replace(tree, old, new)
                for box in tree.iter(f"{WORD}txbxContent"):
                    for old, new in (boxes or {}).items():
                        _replace(box, old, new)
                data = ElementTree.tostring(tree, encoding="utf-8", xml_declaration=True)
            z.writestr(item, data)
    return out.getvalue()


def _replace(tree: ElementTree.Element, old: str, new: str) -> None:
    for p in tree.iter(f"{WORD}p"):
        texts = [t for r in p.findall(f"{WORD}r") for t in r.findall(f"{WORD}t")]
        whole = "".join(t.text or "" for t in texts)
        if old in whole:
            texts[0].text = whole.replace(old, new)
            for t in texts[1:]:
                t.text = ""
