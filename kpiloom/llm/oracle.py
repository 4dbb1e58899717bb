"""DuckDB SQL of the queries that SQL can express, each written from the operator's definition."""

from . import mixing

CHAT = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
w AS (SELECT DISTINCT conv_id, role AS speaker FROM conversations WHERE role IS NOT NULL AND role <> 'system'),
p AS (
  SELECT t.conv_id, speaker, CAST(floor(turn / 512.0) AS BIGINT) AS part, turn, role, text,
         coalesce(role = speaker, false) AS own,
         '<|im_start|>' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system'
           ELSE 'user' || coalesce(' name=' || role, '') END || chr(10) AS head
  FROM t JOIN w ON t.conv_id IS NOT DISTINCT FROM w.conv_id),
s AS (
  SELECT *, head || text || '<|im_end|>' || chr(10) AS shown,
         sum(length(head) + length(text) + 11) OVER (PARTITION BY conv_id, speaker, part
           ORDER BY turn NULLS FIRST, role NULLS FIRST, text ROWS UNBOUNDED PRECEDING) AS upto
  FROM p)
SELECT conv_id, speaker, part, count(*) AS n_turns, string_agg(shown, '' ORDER BY upto) AS text,
       coalesce(string_agg(CASE WHEN own THEN CAST(upto - length(text) - 11 AS VARCHAR) || ':' || CAST(upto - 1 AS VARCHAR) END,
                           ',' ORDER BY upto), '') AS trained
FROM s GROUP BY conv_id, speaker, part
"""

URLS = r"""
WITH c AS (
  SELECT DISTINCT page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 365 AS INTEGER) AS fetched,
         nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9a-f:.]+\]|[^/:?#]+)', 1), '\.$', ''), '') AS host
  FROM pages),
k AS (
  SELECT c.*, unnest(CASE WHEN host IS NULL THEN [NULL] WHEN length(host) > 253 OR instr(host, '.') = 0 OR host LIKE '[%' THEN [host]
    ELSE list_transform(range(1, len(string_split(host, '.'))), lambda i: array_to_string(string_split(host, '.')[i:], '.')) END) AS key
  FROM c),
e AS (
  SELECT key, CAST('0x' || substr(md5(key), 1, 6) AS INTEGER) AS h FROM (SELECT DISTINCT key FROM k WHERE key IS NOT NULL)
  WHERE instr(key, '.') > 0),
l AS (
  SELECT key, ['adult', 'malware', 'spam'][h % 3 + 1] AS category, unnest(list_filter([
      {'f': h % 200, 't': CASE WHEN h % 4 < 2 THEN h % 200 + 30 + h % 97 END},
      CASE WHEN h % 8 = 0 THEN {'f': h % 200 + 80 + h % 97, 't': NULL} END], lambda x: x IS NOT NULL)) AS x
  FROM e WHERE (h // 1000) % 2 = 0),
m AS (
  SELECT k.page_id, k.url, k.fetched, k.host, l.key AS k, l.category
  FROM k LEFT JOIN l ON k.key = l.key AND k.fetched >= DATE '2024-01-01' + x.f
    AND (x.t IS NULL OR k.fetched < DATE '2024-01-01' + x.t))
SELECT page_id, url, fetched, host, count(k) AS n_active, count(k) > 0 AS blocked,
       first(k ORDER BY length(k) DESC NULLS LAST, category) AS entry,
       first(category ORDER BY length(k) DESC NULLS LAST, category) AS category
FROM m GROUP BY page_id, url, fetched, host
"""


def mixing_sql(powers=mixing.POWERS, rate=mixing.RATE, rounds=mixing.ROUNDS, steps=mixing.CAP_STEPS, seed=mixing.SEED) -> str:
    rules = " ".join(f"WHEN {c} THEN '{n}'" for n, c in mixing.TOPICS)
    dims = ", ".join(powers)
    out = [f"""r AS MATERIALIZED (SELECT doc_id, source, lang, CASE {rules} ELSE '{mixing.OTHER}' END AS topic,
    CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')), 0) AS BIGINT) AS tokens FROM documents)""",
           f"c AS MATERIALIZED (SELECT {dims}, sum(tokens)::DOUBLE AS mass FROM r GROUP BY ALL)",
           "w AS MATERIALIZED (SELECT *, mass / (SELECT CASE WHEN sum(mass) > 0 THEN sum(mass) ELSE 1 END FROM c) AS share FROM c)"]
    for d, p in powers.items():
        out.append(f"g_{d} AS MATERIALIZED (SELECT {d} AS v, t / sum(t) OVER () AS t FROM "
                   f"(SELECT {d}, pow(sum(share), {p}) AS t FROM w GROUP BY {d}))")
    last = "w0"
    out.append("w0 AS MATERIALIZED (SELECT *, share AS w FROM w)")
    n = 0
    for _ in range(rounds):
        for d in powers:
            n += 1
            out.append(f"w{n} AS MATERIALIZED (SELECT {dims}, share, CASE WHEN s > 0 THEN w * t / s ELSE 0 END AS w FROM "
                       f"(SELECT *, sum(w) OVER (PARTITION BY {d}) AS s FROM {last}) x JOIN g_{d} ON x.{d} IS NOT DISTINCT FROM g_{d}.v)")
            last = f"w{n}"
    out.append(f"q AS MATERIALIZED (SELECT *, CASE WHEN share > 0 THEN w / share ELSE 0 END AS ratio FROM {last})")
    out.append(f"k0 AS MATERIALIZED (SELECT {rate}::DOUBLE AS k)")
    for i in range(steps):
        out.append(f"""k{i + 1} AS MATERIALIZED (SELECT CASE WHEN b > 0 THEN greatest({rate} - a, 0) / b ELSE k END AS k FROM
    (SELECT sum(CASE WHEN ratio * k >= 1 THEN share ELSE 0 END) AS a, sum(CASE WHEN ratio * k >= 1 THEN 0 ELSE w END) AS b,
            max(k) AS k FROM q, k{i}))""")
    same = " AND ".join(f"r.{d} IS NOT DISTINCT FROM z.{d}" for d in powers)
    return f"""WITH {", ".join(out)},
z AS MATERIALIZED (SELECT {dims}, ratio, round(least(1, ratio * (SELECT k FROM k{steps})), 9) AS prob FROM q)
SELECT doc_id, r.source, r.lang, r.topic, tokens, round(ratio, 6) AS weight, round(prob, 6) AS prob,
       CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{seed}'), 1, 8) AS BIGINT) / 4294967296.0 < prob AS sampled
FROM r JOIN z ON {same}
"""


ORACLE: dict[str, str] = {"op6_perspectives": CHAT, "op7_url_filter": URLS, "op10_mixing": mixing_sql()}
