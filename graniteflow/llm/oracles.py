"""DuckDB SQL for the rows of those operators that SQL can express, over whole tables."""

from __future__ import annotations

from graniteflow.llm.fingerprints import DIGITS, LEAF


def _paragraphs(section: str) -> str:
    return rf"regexp_extract_all({section}, '[^\n]*\n|[^\n]+')"


def _tree(text: str) -> str:
    return rf"list_transform(regexp_extract_all({text}, '(?s).*?\n{{2,}}|.+'), lambda s: {_paragraphs('s')})"


def _tags(paragraph: str) -> str:
    return f"list_transform(regexp_extract_all({paragraph}, '{LEAF}'), lambda x: left(md5(x), 8))"


def _digest(section: str) -> str:
    return f"sha256(array_to_string(list_transform({section}, lambda p: sha256(p)), ''))"


def _printed(tree: str, root: str) -> str:
    part = f"':' || left(sha256(q), {DIGITS}) || '=' || array_to_string({_tags('q')}, '')"
    return f"{root} || array_to_string(list_transform({tree}, lambda s: '/' || left({_digest('s')}, {DIGITS}) || array_to_string(list_transform(s, lambda q: {part}), '')), '')"


def _near(other: str) -> str:
    both = f"(len(a_tags) + len({other}_tags))"
    shared = f"len(list_intersect(a_tags, {other}_tags))"
    return f"CASE WHEN a_root = {other}_root THEN 1.0::DOUBLE WHEN {both} = 0 THEN 0.0::DOUBLE ELSE least(2.0::DOUBLE * {shared} / {both}, 1.0::DOUBLE - 1.0::DOUBLE / (2.0::DOUBLE * {both})) END"


_ROOTS = ", ".join(f"sha256(array_to_string(list_transform({x}, lambda s: {_digest('s')}), '')) AS {x}_root" for x in "abc")
_ALL_TAGS = ", ".join(f"list_distinct(flatten(list_transform(flatten({x}), lambda p: {_tags('p')}))) AS {x}_tags" for x in "abc")

FINGERPRINT = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS nxt
    FROM documents WINDOW w AS (ORDER BY doc_id DESC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  e AS (SELECT *, left(text, length(text) - length(text) // 3) || left(nxt, length(text) // 3) AS edited FROM d),
  t AS (SELECT *, {_tree("text")} AS a, {_tree("edited")} AS b, {_tree("nxt")} AS c FROM e),
  f AS (SELECT *, {_ROOTS}, {_ALL_TAGS} FROM t)
  SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, {_printed("a", "a_root")} AS fingerprint, {_printed("b", "b_root")} AS edited_fingerprint,
    {_near("b")} AS near_edited, {_near("c")} AS near_next,
    array_to_string(flatten(list_transform(b, lambda s, i: list_filter(list_transform(s, lambda p, j: CASE WHEN a[i][j] IS DISTINCT FROM p THEN concat(i - 1, '.', j - 1) END),
      lambda x: x IS NOT NULL))), ',') AS edited_branches
  FROM f"""

#: A SHA-1 has 160 bits: 8 times 5 hex digits, each of which are 4 letters of base32.
_BASE32 = """array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  ((('0x' || substr(sha1(html), (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - i % 4 * 5)::INT) & 31)::INT + 1, 1)), '')"""

WARC = f"""SELECT page_id, strlen(html) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id < leader THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id < leader THEN leader END AS refers_to
  FROM (SELECT page_id, html, max(page_id) OVER (PARTITION BY html) AS leader FROM (SELECT page_id, coalesce(html, '') AS html FROM pages))"""

_REST = r"(<SYS>>|</SYS>>|/?INST\]|/?s>|TURN [0-9A-F]*\]|/TURN\])"
_MARKS = "CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 14 + 2 * strlen(role) END"

CHAT = rf"""WITH given AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')))
  SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum({_MARKS} + length(regexp_replace(text, '([<\[])(\\*){_REST}', '\1\\\2\3', 'g')))::BIGINT AS formatted_chars
  FROM given GROUP BY conv_id"""

ORACLES = {"op1_fingerprint": FINGERPRINT, "op6_warc": WARC, "op12_chat": CHAT}
