"""Line-first cleaning: rules judge each line, failed lines go, then documents that lose too much text go.

A line fails if it is a navigation strip, holds a boilerplate phrase, is full of symbols, shouts, runs on without any punctuation, or
repeats an earlier line of its document.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwell.llm._common import map_texts

#: Phrases of page furniture, matched in the lower-cased line.
BOILERPLATE = (
    "all rights reserved|privacy policy|terms of (use|service)|cookie policy|accept (all )?cookies|enable javascript|click here"
    "|sign (in|up) (to|for)|log in to|subscribe to|share (this|on)|powered by|lorem ipsum|licensed under the|read more"
)
#: A document is rejected if fewer than this percentage of its words are left.
LEAST_LEFT = 50
MIN_WORDS, MOST_REPEATED = 50, 50

_split = re.compile("[\x20\x09-\x0d]+").split
_boiler = re.compile(BOILERPLATE)
_symbols = re.compile(r"[#*$%&|<>]")
_ends = re.compile(r"[.!?…:;,][\"'”’)\]]*($|[\x20\x09-\x0d])")


def words_of(text: str) -> list[str]:
    return [w for w in _split(text) if w]


def line_fails(line: str, words: int) -> str:
    """The rule that the line fails, or the empty string.  Lines without a word fail none."""
    if not words:
        return ""
    if (bars := line.count("|")) >= 3 and 4 * bars >= words:
        return "navigation"
    if _boiler.search(line.lower()):
        return "boilerplate"
    if 2 * len(_symbols.findall(line)) > words and words >= 3:
        return "symbols"
    if words >= 3 and line == line.upper() and line != line.lower():
        return "shouting"
    if words >= 12 and not _ends.search(line):
        return "punctuation"
    return ""


def repeated_words(words: list[str]) -> int:
    """Words in 3-word windows that the text holds twice or more, the first included."""
    first: dict[tuple, int] = {}
    mark = bytearray(len(words))
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        j = first.setdefault(w, i)
        if j != i:
            mark[i : i + 3] = b"\1\1\1"
            mark[j : j + 3] = b"\1\1\1"
    return sum(mark)


def judge(text: str | None) -> dict:
    """All counts and decisions for one text."""
    text = text or ""
    words = words_of(text)
    n = len(words)
    seen: set[str] = set()
    dup = left = 0
    kept: list[str] = []
    failed: dict[str, int] = {}
    for line in text.split("\n"):
        k = len(words_of(line))
        again = k > 0 and line in seen
        dup += again
        if k:
            seen.add(line)
        why = "repeat" if again else line_fails(line, k)
        if why:
            failed[why] = failed.get(why, 0) + 1
        else:
            kept.append(line)
            left += k
    repeat = repeated_words(words)
    base_failed = n < MIN_WORDS or 100 * repeat > MOST_REPEATED * n
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": len(_symbols.findall(text)),
        "n_dup_lines": dup,
        "n_repeat_words": repeat,
        "base_failed": base_failed,
        "kept": not base_failed and 100 * left >= LEAST_LEFT * n,
        "words_left": left,
        "lines_failed": failed,
        "clean_text": "\n".join(kept),
    }


FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "words_left long, lines_failed map<string,int>, clean_text string"
)


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """A row per row of ``docs``: id, counts, base_failed, kept, words_left, lines_failed (rule to lines) and the cleaned text.

    Null or empty text: no words, base_failed.  Null ids and repeated rows: each row is judged.  A line equal to an earlier one fails as a
    repeat, the first stays.  Empty table: no rows.  Very long texts are judged whole, in time linear in their length.  Other columns are
    ignored, whatever their names.
    """
    names = [f.split()[0] for f in FIELDS.split(", ")]
    use = [i for i, n in enumerate(names) if with_text or n != "clean_text"]

    def setup():
        def make(texts):
            rows = [judge(t) for t in texts]
            return list(range(len(rows))), [[list(r[names[i]].items()) if names[i] == "lines_failed" else r[names[i]] for r in rows] for i in use]

        return make

    fields = ", ".join(FIELDS.split(", ")[i] for i in use)
    return map_texts(docs, [F.col(id_col).alias("_id")], F.col(text_col).alias("_text"), setup, fields).withColumnRenamed("_id", id_col)


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS u FROM documents),
w AS (SELECT u, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
base AS (
  SELECT u, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars FROM w
), sym AS (SELECT u, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols FROM d),
pos AS (SELECT u, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT u, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
win AS (SELECT u, i FROM (SELECT u, i, count(*) OVER (PARTITION BY u, a, b, c) AS k FROM pos) WHERE k > 1),
rep AS (SELECT u, count(DISTINCT j) AS n_repeat_words FROM (SELECT u, i AS j FROM win UNION ALL SELECT u, i + 1 FROM win UNION ALL SELECT u, i + 2 FROM win) GROUP BY u),
lines AS (SELECT u, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM d),
counted AS (
  SELECT u, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS k, row_number() OVER (PARTITION BY u, line ORDER BY n) AS nth,
    length(line) - length(replace(line, '|', '')) AS bars, len(regexp_extract_all(line, '[#*$%&|<>]')) AS sy
  FROM lines
), told AS (
  SELECT u, k, k > 0 AND nth > 1 AS again,
    k > 0 AND (nth > 1 OR (bars >= 3 AND 4 * bars >= k) OR regexp_matches(lower(line), '{BOILERPLATE}') OR (k >= 3 AND 2 * sy > k)
      OR (k >= 3 AND line = upper(line) AND line <> lower(line))
      OR (k >= 12 AND NOT regexp_matches(line, '[.!?…:;,]["''”’)\\]]*($|[\\x20\\x09-\\x0D])'))) AS fails
  FROM counted
), l AS (SELECT u, count(*) FILTER (again) AS n_dup_lines, coalesce(sum(k) FILTER (NOT fails), 0) AS words_left FROM told GROUP BY u),
j AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(words_left, 0) AS words_left
  FROM d JOIN base USING (u) JOIN sym USING (u) JOIN l USING (u) LEFT JOIN rep USING (u)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND 100 * words_left >= {LEAST_LEFT} * n_words AS kept,
  CAST(words_left AS BIGINT) AS words_left
FROM j
"""
