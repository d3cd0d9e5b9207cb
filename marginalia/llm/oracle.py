"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .line_templates import TemplateParams
from .url_filter import TWO_LABEL_SUFFIXES, ReputationParams

_T = TemplateParams()
_R = ReputationParams()
_TWO = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)

_LINES = f"""
WITH texts AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL),
numbered AS (SELECT row_number() OVER () AS tid, text FROM texts),
lines AS (
  SELECT tid, unnest(range(len(l))) AS pos, unnest(l) AS raw FROM (SELECT tid, string_split(text, chr(10)) AS l FROM numbered)),
sized AS (
  SELECT tid, pos, line, len(string_split(line, ' ')) AS n_tok, array_to_string(string_split(line, ' ')[1:{_T.leading_tokens}], ' ') AS lead
  FROM (SELECT tid, pos, regexp_replace(raw, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS line FROM lines WHERE raw <> '')),
per_line AS (SELECT n_tok, lead, line, count(DISTINCT tid) AS docs FROM sized GROUP BY ALL),
totals AS (SELECT n_tok, lead, sum(docs) AS total FROM per_line GROUP BY ALL),
tokens AS (
  SELECT n_tok, lead, line, docs, unnest(range(n_tok)) AS place, unnest(string_split(line, ' ')) AS token FROM per_line),
often AS (SELECT n_tok, lead, place, token, sum(docs) AS n FROM tokens WHERE token <> '<*>' GROUP BY ALL HAVING n >= {_T.min_docs}),
marked AS (
  SELECT n_tok, lead, line, place, token, n * 100 / total AS pct
  FROM tokens LEFT JOIN often USING (n_tok, lead, place, token) JOIN totals USING (n_tok, lead)),
levels AS (SELECT unnest([{", ".join(map(str, _T.constant_pcts))}]) AS least),
template AS (
  SELECT DISTINCT n_tok, lead, line, template FROM (
    SELECT n_tok, lead, line, least, string_agg(place || ' ' || token, ' ' ORDER BY place) FILTER (pct >= least) AS template
    FROM marked, levels GROUP BY ALL HAVING count(*) FILTER (pct >= least) * 100 >= count(*) * {_T.min_constant_pct})),
named AS (SELECT s.*, template FROM sized s JOIN template USING (n_tok, lead, line)),
recurring AS (SELECT n_tok, lead, template FROM named GROUP BY ALL HAVING count(DISTINCT tid) >= {_T.min_docs}),
gone AS (SELECT DISTINCT tid, pos, n_tok FROM named JOIN recurring USING (n_tok, lead, template)),
found AS (SELECT tid, list(pos) AS gone, sum(n_tok) AS words FROM gone GROUP BY tid),
judged AS (
  SELECT doc_id, d.text, gone,
    coalesce(words * 100 <= (length(d.text) - length(translate(d.text, ' ' || chr(10), '')) + 1) * {_T.copy_pct}, false) AS cut
  FROM documents d LEFT JOIN numbered n ON d.text = n.text LEFT JOIN found USING (tid))
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines,
  CASE WHEN cut THEN len(gone) ELSE 0 END AS n_dropped, CASE WHEN cut THEN 0 ELSE coalesce(len(gone), 0) END AS n_spared,
  md5(CASE WHEN cut THEN array_to_string([x FOR x, i IN string_split(text, chr(10)) IF NOT list_contains(gone, i - 1)], chr(10)) ELSE text END) AS text_md5
FROM judged
"""


def _strength(level: str, parent: str) -> str:
    """Prior strength of a level's groups around their parents' rates, by moments."""
    return f"""(SELECT CASE WHEN more > 1e-9 AND (spread - pure) / more > 1e-9
        THEN least({_R.most_strength}, greatest({_R.least_strength}, more / (spread - pure) - 1)) ELSE {_R.most_strength} END
      FROM (SELECT sum(spread) AS spread, sum(v * (k - 1)) AS pure, sum(v * (n - nn / n - (k - 1))) AS more
        FROM (SELECT k, n, nn, gg - g * g / n AS spread, g / n * (1 - g / n) AS v
          FROM (SELECT count(*) AS k, sum(n)::DOUBLE AS n, sum(good)::DOUBLE AS g, sum(n * n)::DOUBLE AS nn, sum(good * good / n) AS gg
            FROM {level} WHERE n > 0 GROUP BY {parent}))))"""


_URLS = f"""
WITH split AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
outcomes AS (SELECT doc_id AS page_id, CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END AS good FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
counts AS (SELECT host, count(good) AS n, coalesce(sum(good), 0) AS good, string_split(host, '.') AS l FROM split LEFT JOIN outcomes USING (page_id) GROUP BY host),
hosts AS (
  SELECT host, n, good, CASE WHEN two THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain,
    CASE WHEN two THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix
  FROM (SELECT *, array_to_string(l[-2:], '.') IN ({_TWO}) AS two FROM counts)),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM domains GROUP BY ALL),
overall AS (SELECT sum(n)::DOUBLE AS n, sum(good)::DOUBLE AS good, coalesce(sum(good) / nullif(sum(n), 0), 0.5)::DOUBLE AS mean FROM suffixes),
strengths AS (SELECT {_strength("suffixes", "()")} AS ss, {_strength("domains", "suffix")} AS sd, {_strength("hosts", "suffix, domain")} AS sh),
m_all AS (SELECT suffix, s.n, s.good, CASE WHEN o.n - s.n > 0 THEN (o.good - s.good) / (o.n - s.n) ELSE mean END AS m FROM suffixes s, overall o),
m_suffix AS (SELECT suffix, domain, d.n, d.good, (s.good - d.good + m * ss) / (s.n - d.n + ss) AS m FROM domains d JOIN m_all s USING (suffix), strengths),
posterior AS (
  SELECT host, good + m * sh AS a, n - good + (1 - m) * sh AS b FROM (
    SELECT host, h.n, h.good, sh, (d.good - h.good + m * sd) / (d.n - h.n + sd) AS m FROM hosts h JOIN m_suffix d USING (suffix, domain), strengths)),
tails AS (
  SELECT *, CASE WHEN low THEN a ELSE b END AS p, CASE WHEN low THEN b ELSE a END AS q, CASE WHEN low THEN {_R.threshold} ELSE {1 - _R.threshold} END AS y
  FROM (SELECT *, a >= (a + b) * {_R.threshold} AS low FROM posterior)),
summed AS (
  SELECT *, list_sum(list_transform(range((80 / (1 - y) + 13 * sqrt(p / (1 - y)))::BIGINT + 1),
    lambda n: exp(lgamma(p + q + n) - lgamma(p + 1 + n) - lgamma(q) + (p + n) * ln(y) + q * ln(1 - y)))) AS tail
  FROM tails WHERE a > 0 AND b > 0),
known AS (
  SELECT host, CASE WHEN low THEN 1 - tail ELSE tail END AS above FROM summed
  UNION ALL SELECT host, CASE WHEN b <= 0 THEN 1 ELSE 0 END FROM posterior WHERE a <= 0 OR b <= 0),
ruled AS (
  SELECT page_id, host, path, above, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule
  FROM split JOIN known USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN above >= {_R.confidence} THEN 'allow' ELSE 'block' END AS verdict
FROM ruled
"""

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: CRC-32 by its byte table, over the distinct words.
_RESAMPLE = f"""
WITH bytes AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
    FROM range(256) r(i))),
words AS (
  SELECT doc_id, 0 AS aim, unnest(regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT NULL, 1, unnest(regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) FROM benchmark),
hexed AS (SELECT DISTINCT w, hex(encode(w)) AS h FROM words),
coded AS (
  SELECT w, list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)) AS b FROM hexed),
hashed AS (
  SELECT w, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM coded, bytes),
counts AS (SELECT bucket, count(*) FILTER (aim = 0) AS s, count(*) FILTER (aim = 1) AS t FROM words JOIN hashed USING (w) GROUP BY bucket),
total AS (SELECT sum(s)::BIGINT AS s, sum(t)::BIGINT AS t FROM counts),
gains AS (
  SELECT bucket, floor(1000 * ln(((c.t + 1)::DOUBLE * (total.s + 10000)::DOUBLE) / ((c.s + 1)::DOUBLE * (total.t + 10000)::DOUBLE)))::BIGINT AS gain FROM counts c, total),
sums AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS g FROM words JOIN hashed USING (w) JOIN gains USING (bucket) WHERE aim = 0 GROUP BY doc_id),
noise AS (SELECT doc_id, (('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE AS u FROM documents),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0)::BIGINT AS weight, u FROM noise LEFT JOIN sums USING (doc_id)),
final AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln(u)))::BIGINT AS score FROM scored),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS able FROM final WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * able // 100 THEN rank END AS rank FROM final LEFT JOIN placed USING (doc_id)
"""

_TERMS = "regexp_extract_all(translate(text, '{up}', '{low}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".format(up=_UP, low=_LOW)
_SEARCH = f"""
WITH words AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
postings AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM postings GROUP BY doc_id),
total AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, total GROUP BY term, big_n),
asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
impacts AS (
  SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l)) AS impact FROM postings JOIN sizes USING (doc_id), total),
scores AS (
  SELECT item_id, doc_id, sum(w * impact)::BIGINT AS score FROM asked JOIN impacts USING (term) JOIN weights USING (term) GROUP BY item_id, doc_id),
placed AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM placed WHERE rank <= 10
"""

SQL: dict[str, str] = {"op3_url_filter": _URLS, "op6_line_templates": _LINES, "op11_importance_resampling": _RESAMPLE, "op12_lexical_search": _SEARCH}
