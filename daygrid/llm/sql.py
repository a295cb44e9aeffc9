"""SQL counterparts of the registered queries, for DuckDB."""

from __future__ import annotations

import re

from daygrid.llm import chat as chat_format
from daygrid.llm import quality_rules as quality
from daygrid.llm import secret_scans as secrets
from daygrid.llm import url_filters as urls

WORD = r"[^\x20\x09-\x0D]+"

QUALITY_MEASURES = rf"""
words AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines
  FROM documents),
placed AS (
  SELECT doc_id, i, w[i] AS word, lag(w[i]) OVER (PARTITION BY doc_id ORDER BY i) AS last_word,
         CASE WHEN i + 7 <= len(w) THEN array_to_string(w[i:i + 7], ' ') END AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words)),
counted AS (SELECT *, win IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, win) > 1 AS again FROM placed),
covered AS (
  SELECT doc_id, word = last_word AS run,
         max(again::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hit
  FROM counted),
repeats AS (SELECT doc_id, sum(hit)::BIGINT AS n, count(*) FILTER (WHERE run) AS runs FROM covered GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(r.runs, 0)::BIGINT AS n_word_runs,
         length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::BIGINT AS n_letters,
         length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper
  FROM words LEFT JOIN repeats r USING (doc_id)),
judged AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 100 * n_upper > 60 * n_letters THEN 64 ELSE 0 END
    + CASE WHEN 100 * n_word_runs > 30 * n_words THEN 128 ELSE 0 END)::BIGINT AS fail_bits
  FROM m)"""

QUALITY_RULES = f"""WITH {QUALITY_MEASURES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits
FROM judged"""


def quality_ablation() -> str:
    cases = [(p, r.name, quality.policy_mask(p), r.mask) for p in quality.POLICIES for r in quality.RULES if quality.policy_mask(p) & r.mask]
    return f"""WITH {QUALITY_MEASURES},
cases(policy, rule, mask, bit) AS (VALUES {", ".join(map(str, cases))})
SELECT policy, rule, count(*) FILTER (WHERE fail_bits & mask <> 0) AS rejected,
       count(*) FILTER (WHERE fail_bits & mask = bit) AS only_this_rule,
       count(*) FILTER (WHERE fail_bits & mask & ~bit <> 0) AS rejected_without
FROM judged CROSS JOIN cases GROUP BY policy, rule"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def url_filters() -> str:
    """PageRank unrolled: one CTE per round."""
    after = "substr({u}, strpos({u}, '://') + 3)"
    host = lambda u: (
        f"coalesce(CASE WHEN strpos({u}, '://') > 0 THEN translate(regexp_extract({after.format(u=u)}, '^([^/?#]*)', 1), "
        f"'{urls.UPPER}', '{urls.LOWER}') ELSE '' END, '')"
    )
    path = lambda u: (
        f"coalesce(CASE WHEN strpos({u}, '://') > 0 THEN regexp_extract({after.format(u=u)}, '^[^/?#]*([^?#]*)', 1) ELSE '' END, '')"
    )
    rules = sorted(urls.RULES, key=lambda r: -len(r.text))
    fits = lambda r: f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    rule = "CASE " + " ".join(f"{fits(r)} THEN '{r.text}'" for r in rules) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{r.text}' THEN '{r.verdict}'" for r in rules) + " END"

    def rank(name: str, seed: str, links: str) -> str:
        out = [f"{name}0 AS (SELECT host, coalesce({seed} / nullif(sum({seed}) OVER (), 0), 0) AS seed, "
               f"coalesce({seed} / nullif(sum({seed}) OVER (), 0), 0) AS score FROM hosts)"]
        for n in range(1, urls.ROUNDS + 1):
            out.append(
                f"{name}{n} AS MATERIALIZED (SELECT h.host, h.seed, {1 - urls.DAMPING} * h.seed + {urls.DAMPING} * coalesce(sum(p.score * l.weight), 0) AS score "
                f"FROM {name}0 h LEFT JOIN {links} l ON l.dst = h.host LEFT JOIN {name}{n - 1} p ON p.host = l.src GROUP BY h.host, h.seed)"
            )
        return ",\n".join(out)

    link = r"""(?i:href)\x20*=\x20*["']?(?:[A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#"'\x20<>]+)"""
    return f"""WITH p AS (SELECT page_id, html, {host('url')} AS host, {path('url')} AS path FROM pages),
judged AS (SELECT *, {verdict} AS given FROM (SELECT page_id, html, host, path, {rule} AS rule FROM p)),
raw AS (SELECT host AS src, {host('to_url')} AS dst FROM
  (SELECT host, 'x:' || unnest(regexp_extract_all(html, {quoted(link)}, 1)) AS to_url FROM p)),
pairs AS (SELECT src, dst, count(*) AS n FROM raw WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst),
links AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS weight FROM pairs),
back AS (SELECT dst AS src, src AS dst, weight / sum(weight) OVER (PARTITION BY dst) AS weight FROM links),
hosts AS (SELECT host, max(good) AS good, max(bad) AS bad FROM (
  SELECT host, avg((given IS NOT DISTINCT FROM 'allow')::INT) AS good, avg((given IS NOT DISTINCT FROM 'block')::INT) AS bad FROM judged GROUP BY host
  UNION ALL SELECT dst, 0, 0 FROM links) WHERE host <> '' GROUP BY host),
{rank('t', 'good', 'links')},
{rank('d', 'bad', 'back')},
bad AS (SELECT host FROM t{urls.ROUNDS} t JOIN d{urls.ROUNDS} d USING (host)
  WHERE d.score > 0 AND d.score >= {urls.BLOCK_AT} * (SELECT avg(score) FROM d{urls.ROUNDS}) AND d.score > t.score)
SELECT page_id, host, path, rule, coalesce(given, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged"""


def secret_scans() -> str:
    each = " UNION ALL ".join(
        f"SELECT doc_id, {n} AS kind, '{k.name}' AS name, '{k.sort}' AS sort, {k.least} AS least, "
        f"string_split_regex(t, {quoted(k.pattern)}) AS gap, regexp_extract_all(t, {quoted(k.pattern)}, 0) AS whole, "
        f"regexp_extract_all(t, {quoted(k.pattern)}, {k.group}) AS counted FROM d"
        for n, k in enumerate(secrets.KINDS)
    )
    count = ", ".join(f"count(*) FILTER (WHERE kind = {n}) AS n_{k.name}" for n, k in enumerate(secrets.BASE))
    listed = "string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind)"
    n = len(secrets.BASE)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({each}),
placed AS (SELECT doc_id, kind, name, sort, least, i, length(gap[i]) AS gap, length(whole[i]) AS width, length(counted[i]) AS counted
  FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM raw)),
ends AS (SELECT *, sum(gap + width) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e FROM placed),
parts AS (SELECT doc_id, kind, name, sort, e - width AS s, e FROM ends WHERE counted >= least),
found AS (SELECT * FROM parts p WHERE kind < {n} OR EXISTS (SELECT 1 FROM parts o WHERE o.doc_id = p.doc_id AND o.sort <> p.sort
  AND o.s <= p.e + {secrets.SCOPE} AND p.s <= o.e + {secrets.SCOPE} AND (o.e <= p.s OR p.e <= o.s))),
sums AS (SELECT doc_id, {count}, {listed} AS spans, {listed} FILTER (WHERE kind < {n}) AS base FROM found GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in secrets.BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN sums USING (doc_id)"""


def chat() -> str:
    """Sizes follow from the template: 9 characters a turn and one for each escaped string."""
    control = "|".join(["\\\\", *[re.escape(c) for c in chat_format.CONTROL]])
    added = lambda c, more="": f"length({c}) + len(regexp_extract_all({c}, {quoted(control + more)}))"
    newline = r"|\n"
    return f"""WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sums AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
  sum({added('text')} + {added('role', newline)} + 9)::BIGINT AS formatted_chars
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM sums"""
