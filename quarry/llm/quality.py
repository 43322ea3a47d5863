"""Quality rules, line first: failing lines go, then documents that lose too much text."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import free_name, load, on_texts

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document goes if failing lines hold more than this share of its words.
MAX_LOST_PERCENT = 30

#: What ends a sentence in Latin, Cyrillic, Greek (;), Chinese, Arabic, Urdu, Indic, Ethiopic, Armenian, Khmer, Burmese and Tibetan script, or announces a list.
ENDS, CLOSERS = ".!?:;…。！？．｡：；؟۔؛।॥።፧։។။།‽", "\"'”’»)]）」』】›"
#: A line ends a sentence: closing quotes and brackets may follow.
ENDED = rf"""[{ENDS}][{CLOSERS.replace("]", "")}\]]*[\x20\x09-\x0D]*$"""
#: Cells of a menu, a path or a table.
CELLS = r"[|»›]"
MARKS = r"[#*$%&<>{}~^]"
SHOUTS = r"!!"
BOILERPLATE = (
    r"(?i)all rights reserved|cookie policy|cookies to|privacy policy|terms of (?:use|service)|enable javascript|lorem ipsum"
    r"|click here|read more|subscribe to our|sign (?:in|up) (?:to|for|now)|log ?in to|skip to (?:main )?content|add to cart|share on (?:facebook|twitter)"
)

RESULT = (
    "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,"
    "n_lines:long,n_bad_lines:long,n_lost_words:long,base_failed:boolean,kept:boolean,text:string>"
)

_CELLS, _MARKS, _BOILERPLATE = re.compile(CELLS), re.compile(MARKS), re.compile(BOILERPLATE)
#: Each phrase of BOILERPLATE has one of these; the letters are those that count as i, k or s regardless of case.
_PARTS = ("rights", "cookie", "privacy", "terms of", "javascript", "lorem", "click", "read more", "subscribe", "sign", "log", "skip to", "add to", "share on", "ı", "i̇", "ſ")


_ENDS = frozenset(ENDS)


def may_have_phrases(text: str) -> bool:
    low = text.lower()
    return any(p in low for p in _PARTS)


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows found twice or more, the first included."""
    windows = list(zip(words, words[1:], words[2:]))
    found = Counter(windows)
    if len(found) == len(windows):
        return 0
    total, last = 0, -1
    for i, w in enumerate(windows):
        if found[w] > 1:
            total += i + 2 - max(last, i - 1)
            last = i + 2
    return total


def bad_line(line: str, n_words: int, phrases: bool = True) -> str | None:
    """The first rule that a line with words fails, of: punctuation, navigation, marks, shouting, boilerplate. Without ``phrases`` it has none of the last."""
    if line.rstrip(" \t\n\v\f\r").rstrip(CLOSERS)[-1:] not in _ENDS:
        return "punctuation"
    cells = len(_CELLS.findall(line))
    if cells >= 3 and 5 * cells >= n_words:
        return "navigation"
    marks = len(_MARKS.findall(line))
    if marks >= 3 and 2 * marks >= n_words:
        return "marks"
    shouts = line.count(SHOUTS)
    if shouts >= 3 and 3 * shouts >= n_words:
        return "shouting"
    if phrases and _BOILERPLATE.search(line):
        return "boilerplate"
    return None


def judge(text: str | None) -> dict:
    text = text or ""
    words = text.encode().split()
    n = len(words)
    seen: set[str] = set()
    good, dup, lines, bad, lost = [], 0, 0, 0, 0
    phrases = may_have_phrases(text)
    for line in text.split("\n"):
        n_line = len(line.encode().split())
        if not n_line:
            continue
        lines += 1
        dup += line in seen
        seen.add(line)
        if bad_line(line, n_line, phrases):
            bad += 1
            lost += n_line
        else:
            good.append(line)
    repeated = repeat_words(words)
    base_failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
    return {
        "n_words": n, "word_chars": len(text) - sum(map(text.count, " \t\n\v\f\r")), "n_symbols": sum(map(text.count, "#*$%&|<>")),
        "n_dup_lines": dup, "n_repeat_words": repeated, "n_lines": lines, "n_bad_lines": bad, "n_lost_words": lost,
        "base_failed": base_failed, "kept": not base_failed and 100 * lost <= MAX_LOST_PERCENT * n, "text": "\n".join(good),
    }


_judged = on_texts(lambda texts: [judge(t) for t in texts], RESULT)


def line_quality(documents: DataFrame, result: str = "quality") -> DataFrame:
    """``documents`` with a struct column ``result``: counts, verdicts, and the text of the lines that pass.

    A line fails if it doesn't end a sentence, is a row of cells (menus, tables), is full of
    marks or shouting, or holds a stock phrase. The document is kept if it passes the base
    (enough words, few of them in repeated 3-word windows) and failing lines hold at most
    ``MAX_LOST_PERCENT`` of its words. Lines without words are neither good nor bad, and go.
    A null text counts as empty and fails the base. Rows are judged one by one, so repeated
    rows and null ids need no rule, and an empty table gives an empty table; a very long text
    is judged whole. A column already named ``result`` is replaced, others stay as they are.
    """
    return documents.withColumn(result, _judged(F.col("text").cast("string")))


def keep_good(documents: DataFrame) -> DataFrame:
    """The documents that are kept, with the lines that pass as their text; columns as they were."""
    name = free_name(documents, "quality")
    kept = line_quality(documents, name).where(F.col(f"{name}.kept"))
    columns = [F.col(f"{name}.text").alias(c) if c == "text" else F.length(f"{name}.text").cast(documents.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in documents.columns]
    return kept.select(*columns)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    found = line_quality(load(spark, sf_dir, "documents").select("doc_id", "text"), "q")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_bad_lines", "n_lost_words"]
    return found.select("doc_id", *[F.col(f"q.{n}").alias(n) for n in names])


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_WORDS = r"'[^\x20\x09-\x0D]+'"
OP1_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, {_WORDS}) AS ws FROM t),
tri AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)),
again AS (SELECT doc_id, unnest(list(i)) AS i FROM tri GROUP BY doc_id, a, b, c HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM t),
lw AS (SELECT *, len(regexp_extract_all(line, {_WORDS})) AS n FROM l),
lj AS (SELECT doc_id, line, n, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS nth,
  len(regexp_extract_all(line, {_quoted(CELLS)})) AS cells, len(regexp_extract_all(line, {_quoted(MARKS)})) AS marks, len(regexp_extract_all(line, '!!')) AS shouts FROM lw WHERE n > 0),
lb AS (SELECT *, NOT regexp_matches(line, {_quoted(ENDED)}) OR (cells >= 3 AND 5 * cells >= n) OR (marks >= 3 AND 2 * marks >= n)
  OR (shouts >= 3 AND 3 * shouts >= n) OR regexp_matches(line, {_quoted(BOILERPLATE)}) AS bad FROM lj),
ls AS (SELECT doc_id, count(*) AS n_lines, count_if(bad) AS n_bad_lines, sum(CASE WHEN bad THEN n ELSE 0 END) AS n_lost_words, count_if(nth > 1) AS n_dup_lines FROM lb GROUP BY doc_id),
r AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
  coalesce(n_bad_lines, 0)::BIGINT AS n_bad_lines, coalesce(n_lost_words, 0)::BIGINT AS n_lost_words
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN ls ON ls.doc_id = w.doc_id),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM r)
SELECT *, NOT base_failed AND 100 * n_lost_words <= {MAX_LOST_PERCENT} * n_words AS kept FROM b
"""
