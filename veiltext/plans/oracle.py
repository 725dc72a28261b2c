"""The same questions as SQL for DuckDB, written independently of the Spark expressions.

RE2 has no look-behind and reads `(?U)` as "ungreedy", so patterns are adapted by `_re`.
"""

from __future__ import annotations

import re

from veiltext import rules
from veiltext.plans.tables import NAMES, notes_sql


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _chars(text: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in text)


def _re(pattern: str) -> str:
    """A pattern as RE2 text; word characters take in letters beyond ASCII, as in Spark."""
    pattern = pattern.replace("(?iU)", "(?i)").replace("(?U)", "")
    pattern = pattern.replace(r"[\w\-]", r"[\p{L}\p{N}_\-]").replace(r"\w", r"[\p{L}\p{N}_]")
    return _q(pattern)


def _sub(text: str, pattern: str, tag: str, flags: str = "g") -> str:
    return f"regexp_replace({text}, {_re(pattern)}, {_q(tag)}, '{flags}')"


def _normal(text: str) -> str:
    one = f"regexp_replace({text}, '\\r\\n?', chr(10), 'g')"
    two = f"regexp_replace({one}, '[ \\t]+', ' ', 'g')"
    three = f"regexp_replace({two}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"trim({three}, {_chars(' ' + chr(9) + chr(10) + chr(11) + chr(12) + chr(13))})"


def _strip(text: str) -> str:
    return f"trim({text}, {_chars(rules.WHITESPACE)})"


# --- spans --------------------------------------------------------------------------------------
def _spans(table: str, detectors: tuple[rules.Detector, ...], keys: str = "doc_id") -> str:
    parts = []
    for rank, d in enumerate(detectors, 1):
        p = _re(d.pattern)
        luhn = (
            " where list_sum(list_transform(range(1, 17), lambda j: case when j % 2 = 1 then "
            "case when cast(regexp_replace(hit, '[^0-9]', '', 'g')[j] as int) * 2 > 9 "
            "then cast(regexp_replace(hit, '[^0-9]', '', 'g')[j] as int) * 2 - 9 "
            "else cast(regexp_replace(hit, '[^0-9]', '', 'g')[j] as int) * 2 end "
            "else cast(regexp_replace(hit, '[^0-9]', '', 'g')[j] as int) end)) % 10 = 0"
            if d.luhn else ""
        )
        parts.append(f"""
          select {keys}, {rank} as rk, '{d.entity}' as entity, s, s + length(hit) as e, hit from (
            select {keys}, m[i] as hit,
              cast(list_sum(list_transform(g[1:i], lambda x: length(x)))
              + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) as bigint) as s
            from (select {keys}, m, g, unnest(range(1, len(m) + 1)) as i from (
              select {keys}, regexp_extract_all(text, {p}) as m,
                regexp_split_to_array(text, {p}) as g
              from {table} where len(regexp_extract_all(text, {p})) > 0))){luhn}""")
    return " union all ".join(parts)


def _kept(spans: str) -> tuple[str, str]:
    """The greedy pass as a recursion over span numbers: (ordered, recursion) bodies."""
    ordered = (
        "select *, row_number() over (partition by doc_id order by s, s - e, rk) as rn "
        f"from {spans}"
    )
    recursion = """
      select doc_id, rn, entity, hit, s, e, e as edge, true as keep from {o} where rn = 1
      union all
      select o.doc_id, o.rn, o.entity, o.hit, o.s, o.e,
        case when o.s >= r.edge then o.e else r.edge end, o.s >= r.edge
      from {r} r join {o} o on o.doc_id = r.doc_id and o.rn = r.rn + 1"""
    return ordered, recursion


def _masked(docs: str, kept: str) -> str:
    tag = "case k.entity " + " ".join(
        f"when '{e}' then '{t}'" for e, t in rules.TAGS.items()
    ) + " else '[REDACTED_' || k.entity || ']' end"
    return f"""
      select d.doc_id, d.file_name,
        case when b.doc_id is null then d.text else b.body || substr(d.text, b.edge + 1) end as text,
        coalesce(b.n, 0) as entities
      from {docs} d left join (
        select doc_id, string_agg(piece, '' order by s) as body, max(e) as edge, count(*) as n from (
          select k.doc_id, k.s, k.e, substr(d.text,
            coalesce(lag(k.e) over (partition by k.doc_id order by k.s), 0) + 1,
            k.s - coalesce(lag(k.e) over (partition by k.doc_id order by k.s), 0)) || {tag} as piece
          from {kept} k join {docs} d using (doc_id) where k.keep)
        group by doc_id) b using (doc_id)"""


def _items(table: str, keys: str = "doc_id") -> str:
    return f"""
      select {keys}, rk, entity, hit, s, e from (
        select *, row_number() over (partition by {keys}, s, e order by rk) as nth
        from ({_spans(table, rules.VALUE_DETECTORS, keys)})) where nth = 1"""


def _by_value(table: str, items: str, keys: str = "doc_id", extra: str = "") -> str:
    """Replace values one after the other, in detector order and then text order."""
    using = keys
    return f"""
      select {", ".join("t." + k.strip() for k in keys.split(","))}{extra},
        case when l.items is null then t.text else list_reduce(l.items,
          lambda a, x: replace(a, split_part(x, chr(1), 1), '[' || split_part(x, chr(1), 2) || ']'),
          t.text) end as masked, coalesce(l.n, 0) as n
      from {table} t left join (
        select {keys}, list(hit || chr(1) || entity order by rk, s) as items, count(*) as n
        from {items} group by {keys}) l using ({using})"""


# --- cleanse chain ------------------------------------------------------------------------------
_FULL_ADDRESS = r"\d{1,5}\s+[A-Za-z0-9\s]+?,?\s*[A-Za-z\s]+?,?\s*[A-Z]{2}\s+\d{5}(-\d{4})?"
_SIMPLE_ADDRESS = r"\d{1,5}\s+[A-Za-z0-9\s]+?\s+[A-Za-z]{2}\s+\d{5}"


def _terms(text: str) -> str:
    terms = [*rules.CLIENT_TERMS, "global tech solutions", "Global Tech Solutions",
             "Acme Corporation", "Tech Innovations Inc", "Secure Systems LLC"]
    # Twice, because a match takes the character after it, which the next match may need; with a
    # mark in place of the tag, because the tag holds a term itself.
    other = "[^\\p{L}\\p{N}_]"
    for term in [t for t in terms for _ in range(2)]:
        text = (
            f"regexp_replace({text}, '(^|{other}){term}({other}|$)', "
            "'\\1[' || chr(2) || ']\\2', 'gi')"
        )
    return f"replace({text}, chr(2), 'CLIENT TERM')"


_STEPS = {
    "email": lambda x: _sub(x, rules.CLEANSE_EMAIL, "[EMAIL]"),
    "phone": lambda x: _sub(x, rules.CLEANSE_PHONE, "[PHONE]"),
    "ssn": lambda x: _sub(x, rules.CLEANSE_SSN, "[SSN]"),
    "card": lambda x: _sub(x, rules.CLEANSE_CARD, "[CREDIT CARD]"),
    "ip": lambda x: _sub(x, rules.CLEANSE_IP, "[IP ADDRESS]"),
    "date": lambda x: _sub(x, rules.CLEANSE_DATE, "[DATE]"),
    "address": lambda x: _sub(_sub(x, _FULL_ADDRESS, "[ADDRESS]"), _SIMPLE_ADDRESS, "[ADDRESS]"),
    "mac": lambda x: _sub(x, rules.CLEANSE_MAC, "[MAC ADDRESS]"),
    "license": lambda x: _sub(x, rules.CLEANSE_LICENSE, "[DRIVER LICENSE]"),
    "passport": lambda x: _sub(x, rules.CLEANSE_PASSPORT, "[PASSPORT]"),
    "client_terms": _terms,
}


def _client(text: str, name: str) -> str:
    stem = f"regexp_replace({name}, '\\.[^.]*$', '')"
    return (
        f"case when length({stem}) > 3 then regexp_replace({text}, '(?i)' || regexp_escape({stem}), "
        f"'[CLIENT NAME]', 'g') else {text} end"
    )


def _chain(text: str, name: str | None = None) -> str:
    for step in list(_STEPS)[:-1]:
        text = _STEPS[step](text)
    if name:
        text = _client(text, name)
    return _terms(text)


# --- insight ------------------------------------------------------------------------------------
def _sentences(text: str) -> str:
    parts = f"regexp_split_to_array(regexp_replace({text}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    stripped = f"list_transform({parts}, lambda x: {_strip('x')})"
    return f"list_filter({stripped}, lambda x: x <> '')"


def _description(text: str) -> str:
    return (
        f"case when {_strip(text)} = '' then {_q(rules.DESCRIPTION_NONE)} "
        f"else left(array_to_string(({_sentences(text)})[1:2], ' '), 300) end"
    )


def _keyword_findings(text: str) -> str:
    tests = []
    for words, finding in rules.FINDINGS:
        hit = " or ".join(f"contains(lower({text}), {_q(w)})" for w in words)
        tests.append(f"case when {hit} then {_q(finding)} end")
    return f"list_filter([{', '.join(tests)}], lambda x: x is not null)"


def _key_findings(base: str, text: str) -> str:
    highlights = (
        f"list_transform(list_filter({_sentences(text)}, lambda x: length(x) > 25), "
        "lambda x: 'Highlights: ' || left(replace(x, chr(10), ' '), 140))"
    )
    filled = (
        f"case when len({base}) < 3 then list_concat({base}, ({highlights})[1:5 - len({base})]) "
        f"else {base}[1:5] end"
    )
    return filled


def _padded(f: str) -> str:
    pad = _q(rules.FINDING_PAD)
    return (
        f"case len({f}) when 0 then [{_q(rules.FINDING_NONE)}, {pad}, {pad}] "
        f"when 1 then list_concat({f}, [{pad}, {pad}]) when 2 then list_concat({f}, [{pad}]) "
        f"else {f} end"
    )


def _facts(text: str, patterns: tuple[str, ...]) -> str:
    lists = [f"regexp_extract_all({text}, {_re('(?i)' + p)})" for p in patterns]
    out = lists[0]
    for more in lists[1:]:
        out = f"list_concat({out}, {more})"
    return out


def _section(heading: str, facts: str) -> str:
    lines = f"list_transform((list_sort(list_distinct({facts})))[1:10], lambda x: '  - ' || x)"
    return (
        f"case when len({facts}) > 0 then list_concat([{_q(heading)}], list_concat({lines}, [''])) "
        "else [] end"
    )


def _report(columns: list[str]) -> str:
    sections = [_section(h, c) for (_, h, _), c in zip(rules.SECURITY, columns)]
    out = sections[0]
    for more in sections[1:]:
        out = f"list_concat({out}, {more})"
    return (
        f"case when len({out}) = 0 then {_q(rules.SECURITY_NONE)} "
        f"else array_to_string({out}, chr(10)) end"
    )


def _text(value: str) -> str:
    """A string literal with its line ends as characters."""
    return " || chr(10) || ".join(_q(part) for part in value.split("\n"))


# --- common tables ------------------------------------------------------------------------------
_ROUTES = {
    "upload": "case when x in ('png','jpg','jpeg') then 'image' when x = 'pdf' then 'pdf' "
              "when x = 'txt' then 'text' when x = 'xlsx' then 'excel' when x = 'docx' then 'word' "
              "else 'copy' end",
    "report": "case when x in ('png','jpg','jpeg') then 'image' "
              "when x in ('pdf','pptx','xlsx','txt') then x else 'copy' end",
    "directory": "case when z in ('.png','.jpg','.jpeg','.bmp','.tiff') then 'image' "
                 "when z = '.pdf' then 'pdf' when z in ('.xlsx','.xls') then 'excel' "
                 "when z = '.pptx' then 'pptx' when z = '.txt' then 'text' when z = '.csv' then 'csv' "
                 "else 'fail' end",
}


def _tables() -> dict[str, str]:
    t: dict[str, str] = {}
    t["notes"] = notes_sql().replace("{orders}", "orders")
    t["corpus"] = (
        "select * from notes union all "
        "select -1 - doc_id, concat(source, '_', doc_id, '.txt'), text from documents"
    )
    t["norm"] = f"select doc_id, file_name, {_normal('text')} as text from corpus"
    t["spans"] = _spans("norm", rules.SPAN_DETECTORS)
    t["span_order"], recursion = _kept("spans")
    t["kept"] = recursion.format(o="span_order", r="kept")
    t["masked"] = _masked("norm", "kept")
    t["raw_spans"] = _spans("corpus", rules.SPAN_DETECTORS)
    t["raw_order"], _ = _kept("raw_spans")
    t["raw_kept"] = recursion.format(o="raw_order", r="raw_kept")
    t["raw_masked"] = _masked("corpus", "raw_kept")
    t["items"] = _items("corpus")
    t["files"] = (
        "select doc_id, file_name, strlen(text) as length, "
        "lower(string_split(file_name, '.')[-1]) as x, "
        "lower(substr(file_name, strpos(file_name, '.'))) as z, "
        "left(file_name, length(file_name) - length(string_split(file_name, '.')[-1]) - 1) as stem "
        "from corpus"
    )
    t["note_pages"] = """
      select doc_id, i as page_no, parts[i] as text
      from (select doc_id, parts, unnest(range(1, len(parts) + 1)) as i from (
        select doc_id, regexp_split_to_array(
          regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) as parts from corpus))
      where parts[i] <> ''"""
    t["ocr_words"] = """
      select doc_id as image_id, i - 1 as word_no, w[i] as text,
        cast((doc_id * 31 + (i - 1) * 17) % 100 as int) as conf,
        cast(60 * ((i - 1) % 8) as int) as "left", cast(20 * floor((i - 1) / 8) as int) as top,
        cast(10 * length(w[i]) as int) as width, 16 as height
      from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from (
        select doc_id, regexp_split_to_array(text, '\\s+') as w from notes))"""
    t["words"] = """
      select image_id, row_number() over (partition by image_id order by word_no) - 1 as word_no,
        text, "left" as x, top as y, width as w, height as h
      from ocr_words where text <> '' and conf > 40"""
    t["near"] = """
      select a.*, b.text as t2, b.x as x2, b.y as y2, b.w as w2, b.h as h2,
        c.text as t3, c.x as x3, c.y as y3, c.w as w3, c.h as h3
      from words a left join words b on b.image_id = a.image_id and b.word_no = a.word_no + 1
      left join words c on c.image_id = a.image_id and c.word_no = a.word_no + 2"""
    t["grams"] = """
      select image_id, word_no, 1 as n, text, x, y, w, h from near
      union all
      select image_id, word_no, 2, text || ' ' || t2, least(x, x2), least(y, y2),
        greatest(x + w, x2 + w2) - least(x, x2), greatest(y + h, y2 + h2) - least(y, y2)
      from near where abs(y - y2) < h * 0.5
      union all
      select image_id, word_no, 3, text || ' ' || t2 || ' ' || t3, least(x, x2, x3),
        least(y, y2, y3), greatest(x + w, x2 + w2, x3 + w3) - least(x, x2, x3),
        greatest(y + h, y2 + h2, y3 + h3) - least(y, y2, y3)
      from near where abs(y - y2) < h * 0.5 and abs(y2 - y3) < h2 * 0.5"""
    hits = " or ".join(f"regexp_matches(text, {_re(d.pattern)})"
                       for d in rules.VALUE_DETECTORS if not d.luhn)
    # A card of four words never fits in three; one or two joined words may hold one.
    card = _spans("grams", tuple(d for d in rules.VALUE_DETECTORS if d.luhn), "image_id, word_no, n")
    t["cards"] = f"select distinct image_id, word_no, n from ({card})"
    t["pii_grams"] = (
        f"select g.*, row_number() over (partition by image_id order by length(text) desc, word_no, n)"
        f" as rn from grams g left join cards c using (image_id, word_no, n) "
        f"where {hits} or c.image_id is not null"
    )
    t["pick"] = """
      select image_id, rn, word_no, n, range(word_no, word_no + n) as used, true as keep
      from pii_grams where rn = 1
      union all
      select p.image_id, p.rn, p.word_no, p.n,
        case when list_has_any(r.used, range(p.word_no, p.word_no + p.n)) then r.used
          else list_concat(r.used, range(p.word_no, p.word_no + p.n)) end,
        not list_has_any(r.used, range(p.word_no, p.word_no + p.n))
      from pick r join pii_grams p on p.image_id = r.image_id and p.rn = r.rn + 1"""
    t["picked"] = (
        "select g.image_id, g.word_no, g.n, g.text, g.x, g.y, g.w, g.h "
        "from pick k join grams g using (image_id, word_no, n) where k.keep"
    )
    t["units"] = (
        "select conv_id as doc_id, case when role = 'user' then 'cell' else 'paragraph' end "
        "as unit_kind, turn as unit_no, text from conversations"
    )
    t["note_units"] = (
        "select doc_id, case when page_no % 2 = 0 then 'cell' else 'paragraph' end as unit_kind, "
        "page_no as unit_no, case when (doc_id + page_no) % 10 = 0 then ' Time In ' else text end "
        "as text from note_pages"
    )
    t["wide"] = notes_sql(", o_custkey, o_orderkey, o_orderpriority").replace("{orders}", "orders")
    t["cells"] = """
      select o_custkey as doc_id, cast(left(o_orderpriority, 1) as int) as sheet_no,
        o_orderpriority as sheet, o_orderkey as "row", c.col_no, c.col, c.value
      from (select *, unnest([
        {'col_no': 0, 'col': 'file', 'value': file_name},
        {'col_no': 1, 'col': 'note', 'value': case when doc_id % 9 <> 0 then text end},
        {'col_no': 2, 'col': 'label', 'value': case when doc_id % 2 = 0 then 'Time In' else '  ' end}
      ]) as c from wide)"""
    t["grid"] = """
      select doc_id, file_name, case when doc_id % 9 <> 0 then text end as note,
        case when doc_id % 2 = 0 then ' time in ' else '  ' end as label,
        ' user' || doc_id || '@x.org ' as contact from notes"""
    t["responses"] = (
        "select doc_id, case when doc_id % 5 = 0 then '' else 'Summary of document ' || doc_id end "
        "as response from corpus where doc_id % 3 <> 0"
    )
    t["cleansed"] = f"select doc_id, file_name, {_chain('text', 'file_name')} as text from corpus"
    t["facts"] = "select doc_id, " + ", ".join(
        f"{_facts('text', p)} as {name}" for name, _, p in rules.SECURITY
    ) + " from corpus"
    t["cleansed_facts"] = "select doc_id, " + ", ".join(
        f"{_facts('text', p)} as {name}" for name, _, p in rules.SECURITY
    ) + " from cleansed"
    t["found"] = f"select doc_id, {_keyword_findings('text')} as base, text from masked"
    t["filled"] = f"select doc_id, {_key_findings('base', 'text')} as f from found"
    t["reports"] = (
        f"select d.doc_id, d.file_name, lower(string_split(d.file_name, '.')[-1]) as file_type, "
        f"{_description('d.text')} as file_description, "
        f"array_to_string({_padded('f')}, ' | ') as key_findings "
        "from masked d join filled using (doc_id)"
    )
    # dictionary names
    t["persons"] = _name_spans("corpus")
    t["real_persons"] = (
        "select * from persons where lower(hit) not in ('time in', 'cadence')"
    )
    t["named_spans"] = (
        "select doc_id, 0 as rk, 'PERSON' as entity, s, e, hit from real_norm_persons "
        "union all select doc_id, rk, entity, s, e, hit from spans"
    )
    t["real_norm_persons"] = (
        f"select * from ({_name_spans('norm')}) where lower(hit) not in ('time in', 'cadence')"
    )
    t["named_order"], _ = _kept("named_spans")
    t["named_kept"] = recursion.format(o="named_order", r="named_kept")
    t["named_masked"] = _masked("norm", "named_kept")
    t["place_docs"] = (
        "select c_custkey as doc_id, c_name || ' moved from ' || upper(left(n_name, 1)) || "
        "lower(substr(n_name, 2)) || ' (in ' || lower(r_name) || ') to ' || n_name || '.' as text "
        "from customer join nation on c_nationkey = n_nationkey "
        "join region on n_regionkey = r_regionkey"
    )
    t["named_found"] = f"select doc_id, {_keyword_findings('text')} as base, text from named_masked"
    t["named_filled"] = f"select doc_id, {_key_findings('base', 'text')} as f from named_found"
    t["named_reports"] = (
        "select d.doc_id, d.file_name, lower(string_split(d.file_name, '.')[-1]) as file_type, "
        f"{_description('d.text')} as file_description, "
        f"array_to_string({_padded('f')}, ' | ') as key_findings "
        "from named_masked d join named_filled using (doc_id)"
    )
    t["enabled_spans"] = _spans(
        "norm", (
            *(d for d in rules.SPAN_DETECTORS if d.entity in ("EMAIL", "SSN")),
            rules.Detector("TICKET", "Ticket [0-9]+", ""),
        )
    )
    t["enabled_order"], _ = _kept("enabled_spans")
    t["enabled_kept"] = recursion.format(o="enabled_order", r="enabled_kept")
    t["enabled_masked"] = _masked("norm", "enabled_kept")
    t["stripped_cells"] = (
        f"select doc_id, \"row\", col_no, sheet, value, {_strip('value')} as text from cells "
        "where value is not null and " + _strip("value") + " not in ('', 'Time In')"
    )
    t["cell_items"] = _items("stripped_cells", "doc_id, \"row\", col_no")
    t["cell_masked"] = _by_value("stripped_cells", "cell_items", "doc_id, \"row\", col_no", ", t.sheet")
    t["norm_items"] = _items("norm")
    t["page_items"] = _items("note_pages", "doc_id, page_no")
    t["page_masked"] = _by_value("note_pages", "page_items", "doc_id, page_no")
    t["unit_rows"] = (
        "select doc_id * 100000 + unit_no as doc_id, doc_id as d, unit_no, unit_kind, text as raw, "
        "'' as file_name, text from note_units"
    )
    t["unit_spans"] = _spans("unit_rows", rules.SPAN_DETECTORS)
    t["unit_order"], _ = _kept("unit_spans")
    t["unit_kept"] = recursion.format(o="unit_order", r="unit_kept")
    t["unit_masked"] = _masked("unit_rows", "unit_kept")
    t["unit_value_rows"] = (
        f"select doc_id, case when unit_kind = 'cell' then {_strip('text')} else text end as text "
        "from unit_rows"
    )
    t["unit_items"] = _items("unit_value_rows")
    t["unit_values"] = _by_value("unit_value_rows", "unit_items")
    t["cell_rows"] = (
        "select \"row\" * 10 + col_no as doc_id, '' as file_name, coalesce(value, '') as text, "
        "doc_id as d, sheet_no, sheet, \"row\", col_no, col from cells"
    )
    t["cell_spans"] = _spans("cell_rows", rules.SPAN_DETECTORS)
    t["cell_order"], _ = _kept("cell_spans")
    t["cell_kept"] = recursion.format(o="cell_order", r="cell_kept")
    t["cell_span_masked"] = _masked("cell_rows", "cell_kept")
    for kind in ("cell", "unit"):
        t[f"{kind}_persons"] = _name_spans(f"{kind}_rows")
        t[f"named_{kind}_spans"] = (
            f"select doc_id, 0 as rk, 'PERSON' as entity, s, e, hit from {kind}_persons "
            "where lower(hit) not in ('time in', 'cadence') "
            f"union all select doc_id, rk, entity, s, e, hit from {kind}_spans"
        )
        t[f"named_{kind}_order"], _ = _kept(f"named_{kind}_spans")
        t[f"named_{kind}_kept"] = recursion.format(o=f"named_{kind}_order", r=f"named_{kind}_kept")
        t[f"named_{kind}_masked"] = _masked(f"{kind}_rows", f"named_{kind}_kept")
    t["page_entities"] = (
        "select doc_id, hit, min(s) as s, min_by(entity, s) as entity from ("
        "select doc_id, hit, s, entity from kept where keep union all "
        "select doc_id, hit, s, entity from real_norm_persons union all "
        "select doc_id, hit, s, entity from norm_items where entity = 'IP_ADDRESS') "
        "group by doc_id, hit"
    )
    return t


def _name_spans(docs: str) -> str:
    """Each listed name as a whole-word pattern of its own; a mark at its end needs no word's end."""
    def pattern(name: str) -> str:
        body = r"\s+".join(re.escape(word) for word in name.split())
        return "(?i)" + r"\b" * name[0].isalnum() + body + r"\b" * name[-1].isalnum()

    patterns = tuple(rules.Detector("PERSON", pattern(name), "") for name in NAMES)
    return _spans(docs, patterns)


_TABLES = _tables()


def _needs(sql: str) -> set[str]:
    return {w for w in re.findall(r"\b(?:from|join)\s+([a-z_]+)", sql) if w in _TABLES}


def _with(select: str) -> str:
    """Put the common tables a select uses, directly or not, in front of it."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for other in sorted(_needs(_TABLES[name]) - {name}):
            visit(other)
        order.append(name)

    for name in sorted(_needs(select)):
        visit(name)
    body = ", ".join(f"{name} as ({_TABLES[name]})" for name in order)
    return f"with recursive {body} {select}" if order else select


def _found(entity: str) -> str:
    d = next(x for x in rules.SPAN_DETECTORS + rules.VALUE_DETECTORS if x.entity == entity)
    if d.luhn:
        hits = f"({_spans('corpus', (d,))})"
        return (
            "select doc_id, cast(count(s) as int) as n, "
            "coalesce(string_agg(hit, ' | ' order by s), '') as hits "
            f"from corpus left join {hits} using (doc_id) group by doc_id"
        )
    p = _re(d.pattern)
    return (
        f"select doc_id, cast(len(regexp_extract_all(text, {p})) as int) as n, "
        f"array_to_string(regexp_extract_all(text, {p}), ' | ') as hits from corpus"
    )


def _ordered(keys: str, order: str, text: str, separator: str, source: str) -> str:
    return f"select {keys}, string_agg({text}, {separator} order by {order}) as text from {source} group by {keys}"


def _label(name: str) -> str:
    return (
        f"array_to_string(list_transform(string_split(lower({name}), '_'), "
        "lambda x: upper(x[1]) || x[2:]), ' ')"
    )


def _selects() -> dict[str, str]:
    span_cols = "cast(s as int) as start, cast(e as int) as \"end\""
    q: dict[str, str] = {
        "file_inventory": "select 'txt' as ext, true as found, sum(strlen(text) + 1)::bigint as bytes from notes",
        "read_text_docs": "select doc_id, text from documents",
        "read_csv_docs": "select cast(doc_id as varchar) as doc_id, file_name, text from corpus",
        "write_clean_text": (
            "select doc_id, m.file_name, c.text as raw_text, m.text as cleaned_text "
            "from masked m join corpus c using (doc_id)"
        ),
        "write_report_json": "select * from reports",
        "write_report_array": "select * from reports",
        "write_masked_csv": (
            "select cast(g.doc_id as varchar) as doc_id, g.file_name, "
            "case when m.n > 0 then m.masked else g.note end as note, g.label, "
            "'[EMAIL_ADDRESS]' as contact from grid g left join cell_masked m "
            "on m.\"row\" = g.doc_id and m.col_no = 1"
        ),
        # An upload: the typed redactor, then the basic chain, then a copy.
        "manifest": (
            "select doc_id, file_name as original_filename, case "
            "when status <> 'cleansed' then 'cleansed_' || id || '_' || file_name "
            "when not typed_failed then 'redacted_' || id || '_' || file_name "
            "when x = 'xlsx' then 'cleansed_' || id || '_' || string_split(file_name, '.')[1] || '.csv' "
            "else 'cleansed_' || id || '_' || file_name end as cleansed_filename, "
            "'metadata_' || id || '_' || string_split(file_name, '.')[1] || '.txt' as metadata_filename, "
            "x as file_type, case when status = 'failed' then 'Error cleansing file: unreadable' end as error, "
            "status from (select *, case when x = 'pptx' then 'copied' "
            "when typed_failed and doc_id % 22 = 0 then 'failed' else 'cleansed' end as status "
            "from (select *, left(sha256(cast(doc_id as varchar)), 32) as id, "
            "doc_id % 11 = 0 or z in ('.v2.txt', '.docx') as typed_failed from files))"
        ),
        "allowed_files": (
            "select doc_id, file_name, x in ('pdf','png','jpg','jpeg','pptx','xlsx','txt') "
            "as report_type from files where x in ('pdf','png','jpg','jpeg','pptx','xlsx','txt','docx')"
        ),
        "file_type": "select doc_id, x as file_type from files",
        "compound_suffix": "select doc_id, z as suffix from files",
        "route_handler": "select doc_id, " + ", ".join(
            f"{sql} as {name}" for name, sql in _ROUTES.items()) + " from files",
        "size_limit": "select doc_id, file_name, length from files where length <= 16777216",
        "safe_filename": (
            "select doc_id, 'fichier____' || file_name || '_' as safe from files"
        ),
        "artifact_names": (
            "select doc_id, 'masked_' || left(sha256(cast(doc_id as varchar)), 32) || '_' || file_name "
            "as masked, stem || '_raw.txt' as raw, stem || '_clean.txt' as clean, "
            "stem || '_report.json' as report, "
            "'metadata_' || string_split(file_name, '.')[1] || '.txt' as metadata, "
            "'redacted_' || file_name as redacted, "
            "'analyzed_' || string_split(file_name, '.')[1] || '.txt' as analyzed, "
            "'gemini_analysis_' || string_split(file_name, '.')[1] || '.txt' as model from files"
        ),
        "blank_filter": "select doc_id, label from grid where coalesce(trim(note), '') <> ''",
        "structural_label": (
            f"select doc_id, unit_no, upper({_strip('text')}) = 'TIME IN' as structural from note_units"
        ),
        "client_name": "select doc_id, case when length(stem) > 3 then stem end as client from files",
        "normalize_text": "select * from norm",
        "detect_person_dict": (
            f"select doc_id, 'PERSON' as entity, hit as text, {span_cols}, 'names' as source from persons"
        ),
        "person_filter": (
            f"select doc_id, 'PERSON' as entity, hit as text, {span_cols}, 'names' as source "
            "from real_persons"
        ),
        "detect_location_dict": (
            "select doc_id, 'LOCATION' as entity, hit as text, cast(s as int) as start, "
            "cast(s + length(hit) as int) as \"end\", 'places' as source from ("
            "select doc_id, upper(left(n_name, 1)) || lower(substr(n_name, 2)) as hit, "
            "length(c_name) + 12 as s from named union all "
            "select doc_id, lower(r_name), length(c_name) + 12 + length(n_name) + 5 from named union all "
            "select doc_id, n_name, length(c_name) + 12 + length(n_name) + 5 + length(r_name) + 5 from named)"
        ),
        "spans": (
            f"select doc_id, entity, hit as text, {span_cols}, 'regex' as source from spans"
        ),
        "resolve_overlaps": (
            f"select doc_id, entity, hit as text, {span_cols}, 'regex' as source from kept where keep"
        ),
        "dedup_exact_span": f"select doc_id, entity as type, hit as text, {span_cols} from items",
        "entity_counts_by_doc": "select doc_id, " + ", ".join(
            f"count(*) filter (entity = '{d.entity}') as {d.entity.lower()}"
            for d in rules.SPAN_DETECTORS) + " from kept where keep group by doc_id",
        "mask_by_offset": "select doc_id, text as masked from raw_masked",
        "mask_by_value": f"select doc_id, masked from ({_by_value('corpus', 'items')})",
        "mask_text": "select doc_id, text as cleaned_text from masked",
        "mask_text_names": (
            "select doc_id, cast(entities as int) as entities, text as cleaned_text from named_masked"
        ),
        "mask_table_strings": (
            f"select doc_id, {_chain('file_name', 'file_name')} as file_name, "
            f"{_chain('note', 'file_name')} as note, "
            f"{_chain('label', 'file_name')} as label, {_chain('contact', 'file_name')} as contact from grid"
        ),
        "mask_table_all": (
            "select cast(g.doc_id as varchar) as doc_id, g.file_name, "
            "case when m.n > 0 then m.masked else g.note end as note, g.label, "
            "'[EMAIL_ADDRESS]' as contact from grid g left join cell_masked m "
            "on m.\"row\" = g.doc_id and m.col_no = 1"
        ),
        "mask_cells_long": (
            "select r.d as doc_id, r.sheet_no, r.sheet, r.\"row\", r.col_no, r.col, m.text as value "
            "from cell_rows r join cell_span_masked m using (doc_id)"
        ),
        "mask_cells_names": (
            "select r.d as doc_id, r.sheet_no, r.sheet, r.\"row\", r.col_no, r.col, m.text as value "
            "from cell_rows r join named_cell_masked m using (doc_id)"
        ),
        "mask_slide_units_names": (
            "select u.d as doc_id, u.unit_no, s.text as masked from unit_rows u join named_unit_masked s using (doc_id)"
        ),
        "mask_paragraphs": (
            "select *, text <> masked as changed from (select doc_id, unit_kind, unit_no, text, "
            f"{_chain('text', 'file_name')} as masked from (select u.*, n.file_name "
            "from note_units u join corpus n using (doc_id)))"
        ),
        "mask_slide_units": (
            "select u.d as doc_id, u.unit_no, s.text as by_span, "
            "case when v.n > 0 then v.masked else u.raw end as by_value "
            "from unit_rows u join unit_masked s using (doc_id) join unit_values v using (doc_id)"
        ),
        "mask_pages_doc_entities": (
            "select p.doc_id, p.page_no, case when l.items is null then p.text else "
            "list_reduce(l.items, lambda a, x: replace(a, split_part(x, chr(1), 1), "
            "'[' || split_part(x, chr(1), 2) || ']'), p.text) end as masked "
            "from note_pages p left join (select doc_id, list(hit || chr(1) || entity order by s, hit) "
            "as items from page_entities group by doc_id) l using (doc_id)"
        ),
        "mask_pages_own_entities": (
            "select doc_id, page_no, masked, cast(n as int) as redacted from page_masked"
        ),
        "cleanse_client_name": (
            "select doc_id, " + _client("text", "string_split(file_name, '.')[1] || '.txt'")
            + " as text from corpus"
        ),
        "cleanse_full": "select doc_id, text from cleansed",
        "ocr_confident_words": "select * from words",
        "ocr_ngrams": "select image_id, word_no, n, text from grams",
        "ocr_bbox_union": "select image_id, word_no, n, x, y, w, h from grams",
        "ocr_pick_ngrams": "select * from picked",
        "ocr_picked_counts": (
            "select 'redacted' as counter, count(*) as items from picked union all "
            "select lower(entity) || '_redacted', count(*) from ("
            + _items("picked", "image_id, word_no, n") + ") group by 1"
        ),
        "ocr_redaction_boxes": (
            "select image_id, word_no, n, x - 5 as x0, y - 5 as y0, x + w + 5 as x1, y + h + 5 as y1 "
            "from picked"
        ),
        "ocr_match_entities": (
            "select image_id, word_no, text, \"left\", top, width, height from ocr_words w "
            "where text <> '' and (" + " or ".join(
                f"regexp_matches(text, {_re(d.pattern)})" for d in rules.SPAN_DETECTORS)
            + " or exists (select 1 from (select doc_id, unnest(regexp_split_to_array(lower(hit), "
            "'\\W+')) as token from kept where keep) k where k.doc_id = w.image_id and token <> '' "
            "and token = regexp_replace(lower(w.text), '\\W+', '', 'g')))"
        ),
        "ocr_match_basic": " union all ".join(
            f"select image_id, word_no, text, \"left\", top, width, height, '{label}' as label "
            f"from ocr_words where text <> '' and regexp_matches(text, {_re('(?i)' + p.replace('(?U)', ''))})"
            for label, p in rules.OCR_WORD_PATTERNS
        ),
        "assemble_lines": _ordered("doc_id", "unit_no", "nullif(text, '')", "chr(10)", "units"),
        "assemble_pages": (
            f"select doc_id, {_strip('text')} as text from ("
            + _ordered("doc_id", "page_no", "text", "chr(10)", "note_pages") + ")"
        ),
        "assemble_pages_concat": _ordered("doc_id", "page_no", "text", "''", "note_pages"),
        "assemble_paragraphs": _ordered(
            "doc_id", "unit_no", "text || chr(10)", "''",
            "(select * from units where unit_kind = 'paragraph')"),
        "assemble_sheets": (
            "select doc_id, string_agg('Sheet: ' || sheet || chr(10) || chr(10) || 'file note label' "
            "|| chr(10) || grid, chr(10) || chr(10) order by sheet_no) as text from ("
            "select doc_id, sheet_no, sheet, string_agg(line, chr(10) order by \"row\") as grid from ("
            "select doc_id, sheet_no, sheet, \"row\", "
            "string_agg(coalesce(value, ''), ' ' order by col_no) as line from cells "
            "group by all) group by all) group by doc_id"
        ),
        "extraction_fallback": (
            "select n.doc_id, case when n.doc_id % 4 = 0 then p.text else n.text end as text "
            f"from notes n join (select doc_id, {_strip('text')} as text from ("
            + _ordered("doc_id", "page_no", "text", "chr(10)", "note_pages")
            + ")) p using (doc_id)"
        ),
        "unsupported_text": (
            f"select doc_id, case when x = 'pptx' then {_q(rules.NOT_EXTRACTABLE)} else text end "
            "as upload_text, case when x = 'docx' then '' else text end as report_text "
            "from files join corpus using (doc_id)"
        ),
        "split_sentences": (
            "select doc_id, cast(i - 1 as int) as no, l[i] as sentence from (select doc_id, l, "
            f"unnest(range(1, len(l) + 1)) as i from (select doc_id, {_sentences('text')} as l from norm))"
        ),
        "description": f"select doc_id, {_description('text')} as description from masked",
        "keyword_findings": "select doc_id, array_to_string(base, ' | ') as findings from found",
        "key_findings": f"select doc_id, array_to_string({_padded('f')}, ' | ') as findings from filled",
        "report_rows": "select * from reports",
        "report_rows_names": "select * from named_reports",
        "dedup_exact_span_names": (
            f"select doc_id, entity as type, hit as text, {span_cols} from (select *, row_number() over "
            "(partition by doc_id, s, e order by rk) as nth from (select doc_id, 0 as rk, "
            "'PERSON' as entity, s, e, hit from real_persons union all "
            "select doc_id, rk, entity, s, e, hit from items)) where nth = 1"
        ),
        "finding_counts": (
            "select finding, count(*) as docs from (select unnest(base) as finding from found) group by 1"
        ),
        "sec_long": " union all ".join(
            f"select doc_id, '{name}' as category, cast(i - 1 as int) as match_no, {name}[i] as \"match\" "
            f"from (select doc_id, {name}, unnest(range(1, len({name}) + 1)) as i from facts)"
            for name, _, _ in rules.SECURITY
        ),
        "sec_top10": " union all ".join(
            f"select doc_id, '{name}' as category, cast(rn - 1 as int) as place, \"match\" from ("
            f"select doc_id, \"match\", row_number() over (partition by doc_id order by \"match\") as rn "
            f"from (select distinct doc_id, unnest({name}) as \"match\" from facts)) where rn <= 10"
            for name, _, _ in rules.SECURITY
        ),
        "sec_report_text": (
            f"select doc_id, {_report([n for n, _, _ in rules.SECURITY])} as report from facts"
        ),
        "analysis_text": (
            f"select c.doc_id, {_text(rules.CONTENT_HEADING + chr(10) + rules.RULER + chr(10))} || c.text || "
            f"{_text(chr(10) * 3 + rules.SECURITY_HEADING + chr(10) + rules.RULER + chr(10))} || "
            f"{_report([n for n, _, _ in rules.SECURITY])} || case when coalesce(r.response, '') = '' "
            f"then '' else {_text(chr(10) * 3 + rules.MODEL_HEADING + chr(10) + rules.RULER + chr(10))} "
            "|| r.response end as analysis from cleansed c join cleansed_facts using (doc_id) "
            "left join responses r using (doc_id)"
        ),
        "previews": "select doc_id, " + ", ".join(
            f"case when length(text) > {n} then left(text, {n}) || '...' else text end as first_{n}"
            for n in (500, 1000, 2000)) + " from corpus",
        "llm_prompt_table": (
            "select doc_id, " + " || ".join([
                _text(rules.ANALYSIS_PROMPT.split("{kind}")[0]),
                "upper(string_split(file_name, '.')[-1])",
                _text(rules.ANALYSIS_PROMPT.split("{kind}")[1].split("{content}")[0]),
                "text", _text(rules.ANALYSIS_PROMPT.split("{content}")[1]),
            ]) + " as prompt from cleansed"
        ),
        "llm_security_prompt_table": (
            "select doc_id, " + " || text || ".join(
                _text(part) for part in rules.SECURITY_PROMPT.split("{content}")
            ) + " as prompt from cleansed"
        ),
        "llm_join_responses": (
            "select d.doc_id, r.doc_id is not null as success, case when r.doc_id is not null then "
            f"case when r.response = '' then {_q(rules.NO_ANALYSIS)} else r.response end end as analysis, "
            "case when r.doc_id is null then 'No response' end as error, "
            "lower(string_split(d.file_name, '.')[-1]) as file_type, "
            "cast(length(d.text) as int) as content_length "
            "from corpus d left join responses r using (doc_id)"
        ),
        "llm_join_security_responses": (
            "select d.doc_id, r.doc_id is not null as success, case when r.doc_id is not null then "
            f"case when r.response = '' then {_q(rules.NO_SECURITY_ANALYSIS)} else r.response end end "
            "as security_analysis, case when r.doc_id is null then 'No response' end as error "
            "from corpus d left join responses r using (doc_id)"
        ),
        "redactions_by_type": (
            "select lower(entity) || '_redacted' as counter, count(*) as items from items group by 1"
        ),
        "redactions_observed": (
            "select lower(entity) || '_redacted' as counter, count(*) as items from items group by 1"
        ),
        "files_outcome": (
            f"select count(*) as files_processed, count(*) filter (r <> 'fail') as successful, "
            f"count(*) filter (r = 'fail') as failed from (select {_ROUTES['directory']} as r from files)"
        ),
        "summary_report": (
            f"select {_label('entity')} as label, count(*) as items, "
            "cast(sum(count(*)) over () as bigint) as total from items group by 1"
        ),
        "cells_changed": (
            "select sheet, count(*) filter (n > 0) as changed_cells, "
            "cast(sum(coalesce(n, 0)) as bigint) as items from cells left join "
            "(select doc_id, \"row\", col_no, n from cell_masked) using (doc_id, \"row\", col_no) "
            "group by sheet"
        ),
        "redactions_per_unit": (
            "select doc_id, page_no, count(*) as items from page_items group by all"
        ),
        "type_rollup": (
            "select x as source, entity as type, count(*) as items from items join files using (doc_id) "
            "group by rollup (x, entity)"
        ),
        "stream_cleanse": (
            "select doc_id, file_name, text as cleaned_text, 'cleansed' as status from masked"
        ),
        "stream_counters": "select entity as type, count(*) as items from items group by 1",
        "sql_functions": (
            "select doc_id, n.text as normal, m.text as masked, c.text as cleansed, "
            "f.text as cleansed_by_name from norm n join masked m using (doc_id) "
            f"join (select doc_id, {_chain('text')} as text from corpus) c using (doc_id) "
            "join cleansed f using (doc_id)"
        ),
        "pii_spans": f"select doc_id, entity, hit as text, {span_cols} from kept where keep",
        "detector_switches": "select doc_id, text as masked from enabled_masked",
    }
    q["detect_location_dict"] = q["detect_location_dict"].replace("from named", (
        "from (select c_custkey as doc_id, c_name, n_name, r_name from customer "
        "join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"
    ))
    for name, entity in (
        ("detect_email", "EMAIL"), ("detect_phone", "PHONE"), ("detect_aadhaar", "AADHAAR"),
        ("detect_ssn", "SSN"), ("detect_ip_url", "IP_ADDRESS"),
        ("detect_credit_card", "CREDIT_CARD"), ("detect_date", "DATE_TIME"),
    ):
        q[name] = _found(entity)
    for step, build in _STEPS.items():
        q[f"cleanse_{step}"] = f"select doc_id, {build('text')} as text from corpus"
    for name, category in (
        ("sec_firewall", "firewall_rules"), ("sec_iam", "iam_policies"),
        ("sec_access", "access_controls"), ("sec_password", "password_policies"),
        ("sec_encryption", "encryption_info"), ("sec_vulnerability", "vulnerabilities"),
    ):
        q[name] = f"select doc_id, array_to_string({category}, ' | ') as facts from facts"
    return q


def oracle_sql() -> dict[str, str]:
    return {name: _with(select) for name, select in _selects().items()}
