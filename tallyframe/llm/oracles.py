"""SQL that gives the rows of those queries that SQL can express."""

from __future__ import annotations

from .quality import LEAST_EVENTS, LEAST_WORDS, MEASURES, MOST_REPEATED, PRIOR

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD, _SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"

CAPTURES = """WITH d AS (SELECT page_id, url, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
  g AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to, url
FROM d LEFT JOIN g ON d.digest = g.digest"""


def _quality() -> str:
    values = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {v.replace(' div ', ' // ')} AS v FROM c WHERE NOT base_failed" for m, (v, *_) in MEASURES.items())
    inside = " AND ".join(f"({e} < {LEAST_EVENTS} OR ({v.replace(' div ', ' // ')}) BETWEEN max(low) FILTER (WHERE measure = '{m}') AND max(high) FILTER (WHERE measure = '{m}'))" for m, (v, e, *_) in MEASURES.items())
    counts = "n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"
    drop = "greatest(0, length(bin(v)) - 7)"
    fact = lambda k: "CASE measure " + " ".join(f"WHEN '{m}' THEN {'NULL' if own[k] is None else own[k]}" for m, own in MEASURES.items()) + " END"
    quantile = lambda k: f"min(bin) FILTER (WHERE upto * 100 >= whole * CAST({fact(k)} AS HUGEINT))"
    same = lambda a, b, keys: " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in keys.split())
    return f"""WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
  w0 AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS k FROM t),
  w3 AS (SELECT doc_id, k, w, lead(w) OVER s AS w2, lead(w, 2) OVER s AS w3 FROM w0 WINDOW s AS (PARTITION BY doc_id ORDER BY k)),
  rep AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS n FROM w3 WHERE w3 IS NOT NULL) WHERE n > 1),
  cov AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
  c0 AS (SELECT t.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')))) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words FROM t LEFT JOIN cov ON t.doc_id = cov.doc_id),
  c AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM c0),
  x AS ({values}),
  sketch AS (SELECT lang, source, measure, (v >> {drop}) << {drop} AS bin, count(*) AS n FROM x GROUP BY ALL),
  wp AS (SELECT measure, bin, CAST(sum(n) AS HUGEINT) AS n FROM sketch GROUP BY ALL), wa AS (SELECT measure, CAST(sum(n) AS HUGEINT) AS n FROM sketch GROUP BY ALL),
  lp AS (SELECT lang, measure, bin, CAST(sum(n) AS HUGEINT) AS n FROM sketch GROUP BY ALL), la AS (SELECT lang, measure, CAST(sum(n) AS HUGEINT) AS n FROM sketch GROUP BY ALL),
  lm AS (SELECT la.lang, la.measure, wp.bin, coalesce(lp.n, 0) * wa.n + {PRIOR} * wp.n AS mass, (la.n + {PRIOR}) * wa.n AS whole FROM la JOIN wa ON la.measure = wa.measure JOIN wp ON la.measure = wp.measure LEFT JOIN lp ON {same("la", "lp", "lang measure")} AND wp.bin = lp.bin),
  ga AS (SELECT lang, source, measure, CAST(sum(n) AS HUGEINT) AS n FROM sketch GROUP BY ALL),
  gm AS (SELECT ga.lang, ga.source, ga.measure, lm.bin, coalesce(s.n, 0) * lm.whole + {PRIOR} * lm.mass AS mass, (ga.n + {PRIOR}) * lm.whole AS whole FROM ga JOIN lm ON {same("ga", "lm", "lang measure")} LEFT JOIN sketch s ON {same("ga", "s", "lang source measure")} AND lm.bin = s.bin),
  gu AS (SELECT *, sum(mass) OVER (PARTITION BY lang, source, measure ORDER BY bin) AS upto FROM gm WHERE mass > 0),
  gq AS (SELECT lang, source, measure, {quantile(2)} AS q_low, {quantile(3)} AS q_mid, {quantile(4)} AS q_high FROM gu GROUP BY ALL),
  fences AS (SELECT lang, source, measure, coalesce(floor(q_low - {fact(5)} * (q_high - q_mid)), -1) AS low, ceil(q_high + {fact(5)} * (q_high - q_mid)) AS high FROM gq),
  v AS (SELECT doc_id, {counts}, base_failed, CASE WHEN base_failed THEN FALSE ELSE {inside} END AS kept
    FROM c LEFT JOIN fences f ON c.lang IS NOT DISTINCT FROM f.lang AND c.source IS NOT DISTINCT FROM f.source GROUP BY doc_id, {counts}, base_failed)
SELECT doc_id, {counts}, base_failed, kept FROM v"""


LINKS = f"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS g FROM t),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  link AS (SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
  reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(t.doc_id, coalesce(r.m, t.doc_id)) AS component_id
FROM t LEFT JOIN n ON t.doc_id = n.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON t.doc_id = r.a"""

QUALITY = _quality()
