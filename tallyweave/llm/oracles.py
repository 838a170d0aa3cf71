"""SQL for the text operators that SQL can express, over the same tables."""

from __future__ import annotations

from tallyweave.llm import decontam, licenses, secrets
from tallyweave.llm.common import LOWER, UPPER

SUBSTRINGS = r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
  placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
  windows AS (SELECT doc_id, i, string_agg(word, ' ') OVER here AS g, count(*) OVER here AS n FROM placed WINDOW here AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
  grams AS (SELECT * FROM windows WHERE n = 13),
  covered AS (SELECT doc_id, i FROM grams JOIN (SELECT g, min(doc_id) AS first FROM grams GROUP BY g) USING (g) WHERE first < doc_id),
  gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM covered),
  kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM placed ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, len(words) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""


SEARCH = r"""WITH d AS (SELECT row_number() OVER () AS doc, doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS terms FROM documents),
  q AS (SELECT item_id, unnest(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
  totals AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
  tf AS (SELECT doc, doc_id, n, term, count(*) AS tf FROM (SELECT doc, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
  w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, totals GROUP BY term),
  scores AS (SELECT item_id, doc_id, doc, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score FROM q JOIN tf USING (term) JOIN w USING (term), totals GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM scores WHERE score > 0)
SELECT item_id, r::INTEGER AS rank, doc_id, score FROM ranked WHERE r <= 20"""


#: The check sum of a conversation's id bit by bit; prefixes are whole lists of turns.
TRIE = r"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p FROM conversations WHERE conv_id IS NOT NULL),
  c AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 20 AS grp, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT) AS codes FROM t GROUP BY conv_id),
  crc AS (SELECT conv_id, n, grp, xor(list_reduce(list_concat([4294967295::BIGINT], codes), lambda a, ch: list_reduce(list_concat([xor(a, ch)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 4 AS h FROM c),
  lent AS (SELECT crc.*, least(h, coalesce(g.n, 0)) AS lent FROM crc LEFT JOIN (SELECT conv_id AS grp, n FROM c) g USING (grp)),
  r AS (SELECT l.conv_id, p AS depth, role, text FROM lent l JOIN t ON t.conv_id = l.grp AND p <= lent UNION ALL SELECT l.conv_id, p - h + lent, role, text FROM lent l JOIN t ON t.conv_id = l.conv_id AND p > h),
  m AS (SELECT conv_id, depth, list({'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY depth) AS prefix, text, max(depth) OVER (PARTITION BY conv_id) = depth AS last FROM r
    UNION ALL SELECT conv_id, 0, [], '', conv_id NOT IN (SELECT conv_id FROM r) FROM lent),
  own AS (SELECT depth, prefix, min(conv_id) AS node, count(*) AS n_convs, (count(*) - 1) * len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) AS cost, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM m GROUP BY depth, prefix),
  spots AS (SELECT conv_id, depth, node FROM m JOIN own USING (depth, prefix)),
  tied AS (SELECT own.node, own.depth, n_convs, cost, ends_sha256, spots.node AS parent FROM own LEFT JOIN spots ON spots.conv_id = own.node AND spots.depth = own.depth - 1),
  kids AS (SELECT parent, depth - 1 AS depth, count(*) AS n FROM tied WHERE parent IS NOT NULL GROUP BY ALL),
  under AS (SELECT spots.node, spots.depth, sum((k.n IS NULL)::INT)::BIGINT AS n_leaves, sum(cost)::BIGINT AS saved FROM tied v LEFT JOIN kids k ON k.parent = v.node AND k.depth = v.depth JOIN spots ON spots.conv_id = v.node AND spots.depth <= v.depth GROUP BY ALL),
  final AS (SELECT v.*, coalesce(k.n, 0)::BIGINT AS n_children, n_leaves, saved FROM tied v LEFT JOIN kids k ON k.parent = v.node AND k.depth = v.depth JOIN under u ON u.node = v.node AND u.depth = v.depth),
  -- The tour goes down by smallest members: a node is entered after those that come before it in such an order of paths.
  paths AS (SELECT v.node, v.depth, list(spots.node ORDER BY spots.depth) AS path FROM tied v JOIN spots ON spots.conv_id = v.node AND spots.depth <= v.depth GROUP BY ALL),
  sizes AS (SELECT spots.node, spots.depth, count(*) AS n FROM tied v JOIN spots ON spots.conv_id = v.node AND spots.depth <= v.depth GROUP BY ALL),
  pre AS (SELECT node, depth, row_number() OVER (ORDER BY path) - 1 AS i FROM paths)
SELECT final.node AS conv_id, final.depth::BIGINT AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved AS saved_tokens, ends_sha256, (2 * i - final.depth)::BIGINT AS entered, (2 * i - final.depth + 2 * sizes.n - 1)::BIGINT AS left
FROM final JOIN sizes USING (node, depth) JOIN pre USING (node, depth)"""


def _spans(rule: secrets.Rule, rank: int) -> str:
    p = rule.pattern.replace("'", "''")
    sums = "list_sum(list_transform({}[1:{}], lambda x: length(x)))"
    start = f"({sums.format('gaps', 'i')} + coalesce({sums.format('found', 'i - 1')}, 0))::BIGINT"
    return f"""SELECT doc_id, list_filter(list_transform(range(1, len(found) + 1), lambda i: {{'start': {start}, 'rank': {rank}, 'kind': '{rule.kind}', 'stop': {start} + length(found[i]), 'n': length(part[i])}}), lambda s: s.n >= {rule.least}) AS spans
      FROM (SELECT doc_id, regexp_extract_all(text, '{p}', 0) AS found, regexp_extract_all(text, '{p}', {rule.group}) AS part, string_split_regex(text, '{p}') AS gaps FROM docs)"""


def blob_ledger(rules: tuple[secrets.Rule, ...] = secrets.RULES) -> str:
    line = lambda x: f"array_to_string(list_transform({x}, lambda s: s.kind || ':' || s.start || ':' || s.stop), ',')"
    base = ", ".join(f"'{k}'" for k in secrets.BASE)
    every = " UNION ALL ".join(_spans(r, i) for i, r in enumerate(rules))
    counts = ", ".join(f"len(list_filter(spans, lambda s: s.kind = '{k}'))::BIGINT AS n_{k}" for k in secrets.BASE)
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
  parts AS ({every}),
  spans AS (SELECT doc_id, list_sort(flatten(list(spans))) AS spans FROM parts GROUP BY doc_id)
SELECT doc_id, {counts}, sha256({line(f"list_filter(spans, lambda s: s.kind IN ({base}))")}) AS base_sha256, {line("spans")} AS spans FROM spans"""


def diagonal_licenses() -> str:
    known = [*licenses.BASE, *licenses.NOTICES]
    text = lambda x: "NULL" if x is None else f"'{x}'"
    grams, sizes = [], []
    for k, (label, phrase) in enumerate(known):
        w = phrase.split()
        n = min(licenses.GRAM, len(w))
        sizes.append(f"({k}, '{label}', {len(w) - n + 1}, {licenses.LONGEST * max(len(w), licenses.GRAM)}, {'true' if k < len(licenses.BASE) else 'false'})")
        grams += [f"({', '.join(map(text, [*w[i : i + n], *[None] * (3 - n)]))}, {k}, {i})" for i in range(len(w) - n + 1)]
    return rf"""WITH t(t0, t1, t2, template, t_pos) AS (VALUES {", ".join(grams)}),
  s(template, label, n_grams, longest, is_base) AS (VALUES {", ".join(sizes)}),
  docs AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
  w AS (SELECT doc_id, unnest(words) AS w0, unnest(range(len(words))) AS pos FROM docs),
  g AS (SELECT *, lead(w0) OVER o AS w1, lead(w0, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
  h AS (SELECT doc_id, template, pos, t_pos, pos - t_pos AS diagonal FROM g JOIN t ON w0 = t0 AND w1 = t1 AND (t2 IS NULL OR w2 = t2)),
  d AS (SELECT doc_id, template, diagonal, count(*) AS votes, min(pos) AS start, max(pos) AS last FROM h GROUP BY ALL),
  f AS (SELECT *, coalesce(is_base OR diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > {licenses.NEAR}, true) AS fresh FROM d JOIN s USING (template)),
  p AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS part FROM f),
  whole AS (SELECT doc_id, template, part, is_base, label, longest, n_grams, min(start) AS start, least(1.0::DOUBLE, sum(votes) / n_grams) AS share, max(last) - min(start) + {licenses.GRAM} <= longest AS short FROM p GROUP BY doc_id, template, is_base, label, n_grams, longest, part),
  long AS (SELECT doc_id, template, part, pos, t_pos, label, longest, n_grams FROM h JOIN p USING (doc_id, template, diagonal) JOIN (SELECT doc_id, template, part FROM whole WHERE NOT is_base AND NOT short) USING (doc_id, template, part)),
  stretches AS (SELECT a.doc_id, a.template, a.label, a.n_grams, a.pos, count(DISTINCT b.t_pos) AS votes FROM long a JOIN long b ON b.doc_id = a.doc_id AND b.template = a.template AND b.part = a.part AND b.pos BETWEEN a.pos AND a.pos + a.longest - {licenses.GRAM} GROUP BY ALL),
  spans AS (SELECT doc_id, is_base, label, start, share, short FROM whole UNION ALL SELECT doc_id, false, label, 0, least(1.0::DOUBLE, votes / n_grams), true FROM stretches),
  ok AS (SELECT *, is_base AND share = 1 AS base_hit, (is_base AND share = 1) OR (NOT is_base AND share >= {licenses.LEAST} AND short) AS found FROM spans)
SELECT doc_id, len(words)::BIGINT AS n_words, count(*) FILTER (base_hit) AS n_base, min(start) FILTER (base_hit) AS first_word, max(start) FILTER (base_hit) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base_hit), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (found), '') AS labels, coalesce(max(share) FILTER (found), 0.0)::DOUBLE AS score
FROM docs LEFT JOIN ok USING (doc_id) GROUP BY doc_id, words"""


def template_decontamination() -> str:
    words = "regexp_extract_all(coalesce(text, ''), '\\p{N}+(?:[.,]\\p{N}+)*[\\p{L}\\p{N}]*|[\\p{L}\\p{N}]+')"
    lists = {k: ", ".join(f"'{x}'" for x in v) for k, v in (("number", decontam.NUMBERS), ("unit", decontam.UNITS))}

    def kind(word: str, names: bool = True) -> str:
        name = f"WHEN regexp_matches({word}, '^\\p{{Lu}}\\p{{Ll}}+$') THEN '<name>' " if names else ""
        return f"CASE WHEN regexp_matches({word}, '^\\p{{N}}') THEN '<number>' {name}WHEN lower({word}) IN ({lists['number']}) THEN '<number>' WHEN lower({word}) IN ({lists['unit']}) THEN '<unit>' ELSE lower({word}) END"

    def windows(source: str, id_: str, names: bool) -> str:
        typed = f"SELECT {id_}, pos, word, {kind('word', names)} AS kind FROM {source}"
        alone = f"SELECT *, count(*) OVER (PARTITION BY {id_}) AS n_words, coalesce(kind NOT IN ('<name>', '<number>') OR kind <> lag(kind) OVER (PARTITION BY {id_} ORDER BY pos), true) AS alone FROM ({typed})"
        placed = f"SELECT {id_}, word, kind, pos AS here, coalesce(lead(pos) OVER (PARTITION BY {id_} ORDER BY pos), n_words) AS until, row_number() OVER (PARTITION BY {id_} ORDER BY pos) - 1 AS pos FROM ({alone}) WHERE alone"
        return f"""SELECT {id_}, pos, here, last_value(until) OVER h AS until, string_agg(kind, ' ') OVER h AS g, list(word) OVER h AS w, count(*) OVER h AS n, count(*) FILTER (NOT starts_with(kind, '<')) OVER h AS plain
    FROM ({placed}) WINDOW h AS (PARTITION BY {id_} ORDER BY pos ROWS BETWEEN CURRENT ROW AND {decontam.WINDOW - 1} FOLLOWING)"""

    full = f"n = {decontam.WINDOW} AND plain >= {decontam.PLAIN}"
    return f"""WITH d AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM (SELECT doc_id, {words} AS words FROM documents)),
  b AS (SELECT item_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM (SELECT item_id, {words} AS words FROM benchmark)),
  ours AS (SELECT * FROM ({windows("d", "doc_id", True)}) WHERE {full}),
  named AS (SELECT * FROM ({windows("b", "item_id", True)}) WHERE {full}),
  unnamed AS (SELECT * FROM ({windows("b", "item_id", False)}) WHERE {full}),
  theirs AS (SELECT item_id, pos AS item_pos, here AS item_first, until AS item_until, g, w AS item_w FROM named UNION SELECT item_id, pos, here, until, g, w FROM unnamed),
  sizes AS (SELECT item_id, coalesce(n, m) AS item_windows FROM (SELECT item_id, count(*) AS m FROM unnamed GROUP BY item_id) FULL JOIN (SELECT item_id, count(*) AS n FROM named GROUP BY item_id) USING (item_id)),
  weak AS (SELECT item_id, words, least(len(words), {decontam.WINDOW}) AS n FROM (SELECT item_id, list_transform({words}, lambda x: lower(x)) AS words FROM benchmark) WHERE len(words) > 0 AND item_id NOT IN (SELECT item_id FROM named)),
  spoken AS (SELECT doc_id, list_transform({words}, lambda x: lower(x)) AS words FROM documents),
  said AS (SELECT doc_id, n, pos, array_to_string(words[pos + 1:pos + n], ' ') AS g FROM (SELECT doc_id, n, words, unnest(range(len(words) - n + 1)) AS pos FROM spoken, (SELECT DISTINCT n FROM weak))),
  asked AS (SELECT item_id, n, pos AS item_pos, array_to_string(words[pos + 1:pos + n], ' ') AS g FROM (SELECT item_id, n, words, unnest(range(len(words) - n + 1)) AS pos FROM weak)),
  every AS (SELECT item_id, 0 AS way, item_windows FROM sizes UNION ALL SELECT item_id, 1, len(words) - n + 1 FROM weak),
  hits AS (SELECT DISTINCT doc_id, item_id, 0 AS way, ours.pos, item_pos, item_first, item_until, ours.pos - item_pos AS off, w, item_w FROM ours JOIN theirs USING (g)
    UNION ALL SELECT doc_id, item_id, 1, pos, item_pos, item_pos, item_pos + n, pos - item_pos, [], [] FROM said JOIN asked USING (n, g)),
  runs AS (SELECT doc_id, item_id, way, off, max(n) AS longest_run, max(words) AS words FROM (SELECT doc_id, item_id, way, off, k, count(*) AS n, max(item_until) - min(item_first) AS words FROM (SELECT doc_id, item_id, way, off, item_first, item_until, item_pos - row_number() OVER (PARTITION BY doc_id, item_id, way, off ORDER BY item_pos) AS k FROM hits) GROUP BY ALL) GROUP BY ALL),
  slots AS (SELECT doc_id, item_id, way, off, count(*) AS slots, count(DISTINCT a) AS va, count(DISTINCT b) AS vb FROM (SELECT DISTINCT doc_id, item_id, way, off, a, b FROM (SELECT doc_id, item_id, way, off, unnest(item_w) AS a, unnest(w) AS b FROM hits) WHERE starts_with({kind("a")}, '<')) GROUP BY ALL),
  aligned AS (SELECT doc_id, item_id, way, off, count(*) AS n_windows, min(pos) AS start_word FROM hits GROUP BY ALL),
  leaks AS (SELECT *, coalesce(slots, 0) AS n_slots, CASE WHEN slots IS NULL THEN 1.0::DOUBLE ELSE least(va, vb) / slots END AS consistent FROM aligned JOIN runs USING (doc_id, item_id, way, off) LEFT JOIN slots USING (doc_id, item_id, way, off) JOIN every USING (item_id, way))
SELECT doc_id, item_id, n_windows, item_windows, longest_run, n_slots AS slots, consistent::DOUBLE AS consistent, start_word::BIGINT AS start_word
FROM leaks WHERE consistent >= {decontam.CONSISTENT} AND (n_windows >= {decontam.LEAST} * item_windows OR words >= {decontam.RUN_WORDS})
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_windows DESC, longest_run DESC, start_word, consistent DESC, item_windows DESC, n_slots DESC) = 1"""
