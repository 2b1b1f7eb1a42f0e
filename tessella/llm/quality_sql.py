"""The quality digest as DuckDB SQL, out of the same constants."""

from __future__ import annotations

from .quality import CLASSES, COMMON_WORDS, MAX_CHAR_DISTANCE, MAX_JOINT_DISTANCE, MIN_CHARS, MIN_WORDS, UNIT

_WHITE = r"[\x20\x09-\x0D]"


def _texts(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _term(p: str, q: str) -> str:
    half = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) / 2 ELSE 0 END"
    return f"({half(p)} + {half(q)})"


def quality_sql() -> str:
    """Both passes: references as sums of whole millionths, then the verdicts."""
    lists = ", ".join(f"('{lang}', [{_texts(words)}])" for lang, words in COMMON_WORDS.items())
    shares = ", ".join(f"'{k}'" for k in CLASSES)
    return rf"""
WITH lists(lang, words) AS (VALUES {lists}),
forms AS (SELECT lang, unnest(words) AS word FROM lists),
spelled AS (SELECT lang, word, word AS form FROM forms UNION SELECT lang, word, upper(word[1]) || word[2:] FROM forms),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT rid, doc_id, words, len(words) AS n,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         regexp_replace(regexp_replace(t, '[a-z]+', '', 'g'), '{_WHITE}+', '', 'g') AS r2,
         length(t) - length(regexp_replace(t, '[a-z]+', '', 'g')) AS lower FROM d
), c AS (
  SELECT *, regexp_replace(r2, '[A-Z]+', '', 'g') AS r3, regexp_replace(regexp_replace(r2, '[A-Z]+', '', 'g'), '[0-9]+', '', 'g') AS r4 FROM s
), e AS (
  SELECT *, regexp_replace(r4, '\p{{L}}+', '', 'g') AS r5 FROM c
), b AS (
  SELECT rid, doc_id, n, words, lower + length(r2) AS chars,
         length(r2) - length(regexp_replace(r2, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         [lower, length(r2) - length(r3), length(r3) - length(r4), length(r4) - length(r5),
          length(r5) - length(regexp_replace(r5, '[.,;:!?''"()-]+', '', 'g')), length(regexp_replace(r5, '[.,;:!?''"()-]+', '', 'g'))] AS counts
  FROM e
), windows AS (
  SELECT rid, i, words[i:i + 4] AS gram FROM (SELECT rid, words, unnest(range(1, n - 3)) AS i FROM b WHERE n >= 5)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS k FROM windows) WHERE k > 1
), repeated AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat FROM twice, range(5) AS o(k) GROUP BY rid
), common AS (
  SELECT w.rid, x.lang, x.word, count(*) AS k FROM (SELECT rid, unnest(words) AS form FROM b) w JOIN spelled x USING (form) GROUP BY ALL
), hits AS (
  SELECT rid, max(ROW(k, lang)) AS best FROM (SELECT rid, lang, sum(k) AS k FROM common GROUP BY ALL) GROUP BY rid
), q AS (
  SELECT b.rid, b.doc_id, n, chars, n_symbols, n_dup_lines, coalesce(n_repeat, 0) AS n_repeat, counts, best[2] AS lang
  FROM b LEFT JOIN repeated USING (rid) LEFT JOIN hits USING (rid)
), own AS (
  SELECT q.rid, q.lang, n, chars, word, k FROM q JOIN common USING (rid, lang)
), class_rows AS (
  SELECT rid, lang, n, chars, unnest([{shares}]) AS name, unnest(counts) AS k FROM q
), fits AS (
  SELECT lang, count(*) AS docs FROM q WHERE n >= {MIN_WORDS} AND chars >= {MIN_CHARS} AND lang IS NOT NULL GROUP BY lang
), class_refs AS (
  SELECT lang, name, sum(floor(k * {UNIT} / chars)::BIGINT) / {UNIT} / any_value(docs) AS share FROM class_rows JOIN fits USING (lang)
  WHERE n >= {MIN_WORDS} AND chars >= {MIN_CHARS} GROUP BY lang, name
), word_refs AS (
  SELECT lang, word, sum(floor(k * {UNIT} / n)::BIGINT) / {UNIT} / any_value(docs) AS share FROM own JOIN fits USING (lang)
  WHERE n >= {MIN_WORDS} AND chars >= {MIN_CHARS} GROUP BY lang, word
), totals AS (
  SELECT lang, coalesce(sum(share), 0) AS total FROM fits LEFT JOIN word_refs USING (lang) GROUP BY lang
), judged AS (
  SELECT q.rid, f.lang AS ref FROM q JOIN fits f ON q.lang = f.lang OR q.lang IS NULL AND 2 * counts[4] <= chars
), char_js AS (
  SELECT j.rid, j.ref, sqrt(greatest(sum({_term("(k / chars)", "coalesce(share, 0)")}), 0)) AS js
  FROM judged j JOIN class_rows c USING (rid) LEFT JOIN class_refs r ON r.lang = j.ref AND r.name = c.name WHERE chars >= {MIN_CHARS} GROUP BY ALL
), word_terms AS (
  SELECT j.rid, j.ref, sum({_term("(o.k / q.n)", "coalesce(r.share, 0)")}) AS terms, sum(o.k) AS taken, sum(coalesce(r.share, 0)) AS present
  FROM judged j JOIN q USING (rid) JOIN own o USING (rid) LEFT JOIN word_refs r ON r.lang = j.ref AND r.word = o.word GROUP BY ALL
), word_js AS (
  SELECT j.rid, j.ref, sqrt(greatest(coalesce(terms, 0) + {_term("((q.n - coalesce(taken, 0)) / q.n)", "(1.0::DOUBLE - t.total)")} + (t.total - coalesce(present, 0)) / 2, 0)) AS js
  FROM judged j JOIN q USING (rid) JOIN totals t ON t.lang = j.ref LEFT JOIN word_terms w ON w.rid = j.rid AND w.ref = j.ref WHERE q.n >= {MIN_WORDS}
), far AS (
  SELECT q.rid, min(c.js) AS char_js, min(w.js) AS word_js FROM q LEFT JOIN char_js c USING (rid) LEFT JOIN word_js w USING (rid) GROUP BY q.rid
)
SELECT doc_id, n AS n_words, chars AS word_chars, n_symbols, n_dup_lines, n_repeat AS n_repeat_words,
       n < 10 OR 100 * n_repeat > 20 * n AS base_failed,
       NOT (n < 10 OR 100 * n_repeat > 20 * n) AND NOT coalesce(char_js > {MAX_CHAR_DISTANCE}, false) AND NOT coalesce(char_js + word_js > {MAX_JOINT_DISTANCE}, false) AS kept
FROM q JOIN far USING (rid)
"""
