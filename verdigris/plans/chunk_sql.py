"""SQL for split texts: the same folds over paragraphs, sentences and words, written as reductions of lists."""

from __future__ import annotations

_CUT = (
    r"regexp_split_to_array({t}, '\n\s*\n')",
    r"string_split(regexp_replace({t}, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1))",
    r"regexp_split_to_array({t}, '\s+')",
)
_JOINT = ("chr(10) || chr(10)", "' '", "' '")


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _level(text: str, size: str, overlap: int, least: int, level: int) -> str:
    """A level's chunks. The state is a list: the chunks so far and, last, what is held, empty if nothing is."""
    s, a, h = f"s{level}", f"a{level}", f"s{level}[-1]"
    unit, done, joint = f"{a}[1]", f"{s}[1:len({s}) - 1]", _JOINT[level]
    units = f"list_transform(list_filter(list_transform({_CUT[level].format(t=text)}, lambda u{level}: {_strip(f'u{level}')}), lambda u{level}: u{level} <> ''), lambda u{level}: [u{level}])"
    end, half = f"right({h}, {overlap})", f"length(right({h}, {overlap})) // 2"
    tail = f"CASE WHEN length({h}) > {overlap} AND instr({end}, ' ') > 1 AND instr({end}, ' ') - 1 < {half} THEN substr({end}, instr({end}, ' ') + 1) ELSE {end} END"
    begun = f"{unit}" if overlap <= 0 else f"CASE WHEN {tail} <> '' THEN {tail} || {joint} || {unit} ELSE {unit} END"
    finer = f"WHEN length({unit}) > {size} THEN list_concat(list_concat({done}, CASE WHEN {h} <> '' THEN [{_strip(h)}] ELSE [] END), list_append({_level(unit, size, overlap, least, level + 1)}, ''))" if level < 2 else ""
    full = f"WHEN {h} <> '' AND length({h}) + length({joint}) + length({unit}) > {size} THEN list_append(list_append({done}, {_strip(h)}), {begun})"
    fold = f"list_reduce({units}, lambda {s}, {a}: CASE {finer} {full} WHEN {h} <> '' THEN list_append({done}, {h} || {joint} || {unit}) ELSE list_append({done}, {unit}) END, [''])"
    closed = f"lambda r{level}: list_concat(r{level}[1:len(r{level}) - 1], CASE WHEN r{level}[-1] <> '' AND length({_strip(f'r{level}[-1]')}) >= {least} THEN [{_strip(f'r{level}[-1]')}] ELSE [] END)"
    return f"list_transform([{fold}], {closed})[1]"


def split(text: str, size: str | int, overlap: int, least: int) -> str:
    """An expression: the list of a text's chunks."""
    return rf"CASE WHEN length({text}) > {size} THEN {_level(text, str(size), overlap, least, 0)} WHEN {_strip(text)} <> '' THEN [{_strip(text)}] ELSE [] END"


def numbered(source: str, key: str, text: str, size: str | int, overlap: int, least: int) -> str:
    """(key, chunk_no, chunk) of a source's rows."""
    rows = f"SELECT {key}, unnest(list_transform({split(text, size, overlap, least)}, lambda c, i: {{'no': i - 1, 'chunk': c}})) AS c FROM {source}"
    return f"SELECT {key}, CAST(c.no AS INTEGER) AS chunk_no, c.chunk AS chunk FROM ({rows})"


def hierarchy(source: str, key: str, text: str) -> str:
    big = numbered(source, key, text, 4000, 0, 200)
    return f"""
WITH big AS (SELECT {key} || '_' || chunk_no AS id, chunk FROM ({big})), small AS ({numbered('big', 'id', 'chunk', 512, 64, 50)})
SELECT id, NULL AS parent_id, 0 AS level, chunk FROM big UNION ALL SELECT id || '_' || chunk_no, id, 1, chunk FROM small"""


def sections(source: str, size: int, overlap: int, least: int) -> str:
    """source: (key, section, text, head). Places are looked for one after the other, from the end of the one before."""
    begin, part = "CAST(s[-1] AS BIGINT)", "a[1]"
    found = f"instr(substr(text, {begin} + 1), {part}[1:100])"
    at = f"CASE WHEN {found} > 0 THEN {begin} + {found} - 1 ELSE {begin} END"
    places = f"list_reduce(list_transform(parts, lambda p: [p]), lambda s, a: list_concat(s[1:len(s) - 1], [CAST({at} AS VARCHAR), CAST(greatest({begin}, {at} + length({part}) - {overlap}) AS VARCHAR)]), ['0'])"
    room = f"greatest({size} - length(head), {2 * least})"
    return f"""
WITH d AS ({source}), p AS (SELECT *, {split('text', room, overlap, least)} AS parts FROM d WHERE length(text) >= {least}), f AS (SELECT *, {places} AS places FROM p),
c AS (SELECT key, section, head, parts, places, unnest(range(1, len(parts) + 1)) AS i FROM f)
SELECT concat_ws('_', key, section, i - 1) AS chunk_id, key AS doc_id, section, CAST(i - 1 AS INTEGER) AS chunk_no, head || parts[i] AS chunk, CAST(places[i] AS INTEGER) AS char_start,
  CAST(places[i] AS INTEGER) + length(parts[i]) AS char_end, len(parts) AS n_chunks FROM c"""
