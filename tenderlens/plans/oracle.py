"""The registered queries as DuckDB SQL over the same tables, written apart from the Spark code.

Reference values (names, keywords, coordinates) come in as VALUES lists; rules are plain SQL. Where a query
reads text or XML that was made from the tables, the SQL states the expected result straight from the tables.
"""

from __future__ import annotations

from tenderlens import refdata as ref, schema

GROUP = "supplier, buyer, contract_type, fiscal_year"


def lit(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, int | float):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


INE = values("ine", "code, province", list(ref.INE_PROVINCES.items()))
PROVINCES = values(
    "prov", "ord, province, region", [(i, p, r) for i, (p, r) in enumerate(ref.PROVINCE_REGION.items())]
)
REGION_KEYS = values("rkey", "ord, word, region", [(i, w, r) for i, (w, r) in enumerate(ref.REGION_KEYWORDS)])
TYPE_KEYS = values("tkey", "ord, word, label", [(i, w, t) for i, (w, t) in enumerate(ref.BUYER_TYPE_KEYWORDS)])

BUYERS = """
town AS (
  SELECT c_custkey, c_mktsegment, nation_code, province, region, 'Villa ' || (c_custkey % 2) AS villa
  FROM customer
  JOIN (SELECT n_nationkey, lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') AS nation_code FROM nation) n
    ON c_nationkey = n_nationkey
  JOIN ine ON ine.code = nation_code
  JOIN prov USING (province)
),
named AS (
  SELECT c_custkey, nation_code, province, region,
    CASE c_mktsegment
      WHEN 'BUILDING' THEN 'Ayuntamiento de ' || villa || ' (' || province || ')'
      WHEN 'AUTOMOBILE' THEN 'Diputación Provincial de ' || province
      WHEN 'MACHINERY' THEN 'Universidad de ' || province
      WHEN 'HOUSEHOLD' THEN 'Hospital de ' || province
      ELSE 'Gobierno de ' || region END AS buyer,
    CASE WHEN c_mktsegment = 'BUILDING' THEN villa END AS municipality
  FROM town
),
kinds AS (
  SELECT buyer, arg_min(label, ord) AS buyer_type
  FROM (SELECT DISTINCT buyer FROM named) JOIN tkey ON contains(lower(buyer), lower(word)) GROUP BY buyer
),
geo AS (
  SELECT b.buyer,
    CASE WHEN g.region IS NULL THEN p.province END AS province, coalesce(g.region, p.region) AS region
  FROM (SELECT DISTINCT buyer FROM named) b
  LEFT JOIN (
    SELECT buyer, arg_min(region, ord) AS region
    FROM (SELECT DISTINCT buyer FROM named) JOIN rkey ON contains(lower(buyer), lower(word)) GROUP BY buyer
  ) g USING (buyer)
  LEFT JOIN (
    SELECT buyer, province, region FROM (
      SELECT buyer, prov.province, prov.region,
        row_number() OVER (PARTITION BY buyer ORDER BY length(prov.province) DESC, ord) AS k
      FROM (SELECT DISTINCT buyer FROM named) JOIN prov ON contains(lower(buyer), lower(prov.province))
    ) WHERE k = 1
  ) p USING (buyer)
)"""

CONTRACTS = """
k AS (
  SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey, nation_code, buyer, buyer_type, province, region,
    municipality,
    CASE WHEN l_orderkey % 31 <> 0 THEN
      CASE p_type WHEN 'ECONOMY' THEN 'Obras' WHEN 'PROMO' THEN 'Concesión de obras' WHEN 'SMALL' THEN 'Suministros'
        ELSE 'Servicios' END END AS contract_type,
    'Suministro de ' || p_name AS subject,
    CASE WHEN p_size % 3 <> 0 THEN lpad(CAST(p_size AS VARCHAR), 2, '0') || '000000' END AS cpv,
    CASE WHEN l_orderkey % 17 <> 0 THEN s_name ELSE 'No consta' END AS supplier,
    CASE WHEN l_orderkey % 17 <> 0 THEN s_name END AS supplier_key,
    CASE WHEN l_orderkey % 29 <> 0 THEN CAST(CAST(l_shipdate AS DATE) + INTERVAL 28 YEAR AS DATE) END AS award_date,
    CAST(CASE WHEN l_orderkey % 29 <> 0 THEN year(l_shipdate) + 28 END AS INTEGER) AS fiscal_year,
    CAST(floor(round(l_extendedprice * 100) / 10) AS BIGINT) / 100.0::DOUBLE AS amount,
    'https://contratos.example.org/' || l_orderkey || '-' || l_linenumber AS file_url
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN named ON o_custkey = c_custkey
  LEFT JOIN kinds USING (buyer)
  JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
),
c AS (
  SELECT buyer, buyer_type, province, region, municipality, contract_type, subject, cpv, supplier, supplier_key,
    award_date, fiscal_year, amount, file_url
  FROM k
)"""

BASE = f"WITH {INE}, {PROVINCES}, {REGION_KEYS}, {TYPE_KEYS}, {BUYERS}, {CONTRACTS}"


def money(x: str) -> str:
    return f"coalesce(CAST(sum(CAST({x} AS DECIMAL(18,2))) AS DOUBLE), 0.0)"


def euros(x: str) -> str:
    return f"(replace(replace(replace(format('{{:,.2f}}', {x}), ',', 'X'), '.', ','), 'X', '.') || ' €')"


def pct(x: str) -> str:
    return f"(replace(printf('%.1f', {x}), '.', ',') || ' %')"


def fold(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({x})), '\\s+', ' ', 'g'))"


def groups(min_contracts: int = 2, threshold: str | None = None) -> str:
    """Radar CTEs on top of the contracts: g (groups) and r (scored)."""
    own = threshold or "CASE WHEN contract_type = 'Obras' THEN 36000 ELSE 13500 END"
    return f"""{BASE},
g AS (
  SELECT supplier_key AS supplier, buyer, contract_type, fiscal_year, {money('amount')} AS total,
    count(*) AS n_contracts, min(award_date) AS first_date, max(award_date) AS last_date,
    coalesce(bool_or(CASE WHEN contract_type = 'Obras' THEN amount BETWEEN 39000 AND 40000
      ELSE amount BETWEEN 14000 AND 15000 END), false) AS has_near_limit,
    count(DISTINCT amount) < count(*) AS has_repeats,
    string_agg({euros('amount')}, ' | ' ORDER BY amount DESC) AS individual_amounts
  FROM c WHERE supplier_key IS NOT NULL AND buyer IS NOT NULL AND contract_type IS NOT NULL
    AND fiscal_year IS NOT NULL AND amount IS NOT NULL
  GROUP BY 1, 2, 3, 4
),
a AS (
  SELECT *, n_contracts >= {min_contracts} AND total >= {own} AS is_alert,
    CASE WHEN contains(lower(contract_type), 'obra') THEN 40000.0::DOUBLE ELSE 15000.0::DOUBLE END AS limit_amount,
    date_diff('day', first_date, last_date) AS days_between
  FROM g
),
b AS (
  SELECT *, round_even(total / limit_amount * 100 * 10, 0) / 10 AS pct_limit,
    CASE WHEN NOT is_alert THEN '✅ Sin alerta' WHEN total / limit_amount >= 1 THEN '🚨 Acumulado > límite legal'
      WHEN total / limit_amount >= 0.95 THEN '🔴 Roza el límite (>95%)' ELSE '🟠 Cerca del límite (>90%)' END AS risk_level
  FROM a
),
s AS (
  SELECT *, coalesce(nullif(concat_ws(' · ',
      CASE WHEN pct_limit >= 100 THEN 'acumulado superior al límite legal'
        WHEN pct_limit >= 95 THEN 'acumulado por encima del 95 % del límite'
        WHEN pct_limit >= 90 THEN 'acumulado por encima del 90 % del límite' END,
      CASE WHEN n_contracts >= 4 THEN 'proveedor recurrente (' || n_contracts || ' contratos)'
        WHEN n_contracts >= 2 THEN 'varios contratos al mismo proveedor' END,
      CASE WHEN has_near_limit THEN 'importe individual pegado al umbral' END,
      CASE WHEN has_repeats THEN 'importes repetidos exactamente' END,
      CASE WHEN n_contracts >= 2 AND days_between <= 45 THEN 'contratos concentrados en ' || days_between || ' días' END
    ), ''), 'Sin señales adicionales') AS signals
  FROM b
),
i AS (
  SELECT *, CAST(round_even(least(100.0::DOUBLE, least(45.0::DOUBLE, pct_limit / 100 * 35)
      + CASE WHEN pct_limit / 100 >= 1 THEN 20 WHEN pct_limit / 100 >= 0.95 THEN 15 WHEN pct_limit / 100 >= 0.9 THEN 10 ELSE 0 END
      + least(20, (n_contracts - 1) * 8) + CASE WHEN has_near_limit THEN 10 ELSE 0 END
      + CASE WHEN contains(signals, 'concentrados') THEN 8 ELSE 0 END
      + CASE WHEN has_repeats THEN 5 ELSE 0 END), 0) AS INTEGER) AS risk_index
  FROM s
),
r AS (
  SELECT {GROUP}, total, n_contracts, first_date, last_date, is_alert, limit_amount, pct_limit, risk_level,
    days_between, signals, risk_index,
    CASE WHEN risk_index >= 75 THEN 'Alta' WHEN risk_index >= 50 THEN 'Media' WHEN risk_index >= 25 THEN 'Baja'
      ELSE 'Informativa' END AS priority,
    {pct('pct_limit')} AS pct_text, {euros('total')} AS total_text, {euros('limit_amount')} AS limit_text
  FROM i
)"""


RISK_ORDER = f"risk_index DESC, total DESC, {GROUP}"

FEED = f"""{BASE},
f AS (
  SELECT k.*, CASE WHEN l_linenumber = 7 THEN l_extendedprice ELSE amount END AS feed_amount,
    municipality IS NOT NULL OR l_orderkey % 3 = 0 AS placed
  FROM k WHERE l_orderkey % 101 <> 0
),
fc AS (
  SELECT buyer, buyer_type,
    CASE WHEN placed THEN f.province ELSE geo.province END AS province,
    CASE WHEN placed THEN f.region ELSE geo.region END AS region,
    municipality, coalesce(contract_type, 'Otros') AS contract_type, subject, cpv, supplier, supplier_key,
    award_date, fiscal_year, feed_amount AS amount, file_url
  FROM f JOIN geo USING (buyer) WHERE feed_amount <= 50000
)"""

PAGE = "(CAST(floor(l_orderkey / 250.0) AS BIGINT) + (l_linenumber // 8) * 1000000000)"
PAGES = f"""WITH p AS (
  SELECT DISTINCT {PAGE} AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {PAGE} % 7 <> 3
), chain AS (
  SELECT 'page-' || n || '.atom' AS page, 'https://feeds.example.org/minor/page-' || (n + 1) || '.atom' AS next_url,
    'page-' || (n + 1) || '.atom' AS next_page, (n + 1) IN (SELECT n FROM p) AS next_is_present
  FROM p
)"""

# Every walk along the links, with the pages passed; a walk ends where no page follows or where it meets itself.
CHAINS = f"""WITH RECURSIVE p AS (
  SELECT DISTINCT {PAGE} AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {{there}}
), link AS (
  SELECT n, {{link}} AS nx FROM p
), walk AS (
  SELECT n AS start, n AS here, [n] AS seen, false AS met FROM link
  UNION ALL
  SELECT w.start, l.nx, list_append(w.seen, l.nx), list_contains(w.seen, l.nx)
  FROM walk w JOIN link l ON l.n = w.here JOIN p ON p.n = l.nx WHERE NOT w.met
), over AS (
  SELECT start, here, seen, met FROM walk QUALIFY row_number() OVER (PARTITION BY start ORDER BY len(seen) DESC) = 1
), named AS (
  SELECT nx, count(*) AS c FROM link GROUP BY nx
), ranked AS (
  SELECT o.start AS n, CASE WHEN met THEN
      list_min(list_transform(seen[list_position(seen, here):], lambda x: 'https://feeds.example.org/minor/page-' || x || '.atom'))
    ELSE 'https://feeds.example.org/minor/page-' || here || '.atom' END AS chain,
    CASE WHEN NOT met THEN len(seen) - 1 END AS pages_after,
    CASE WHEN met THEN 'cycle' WHEN l.nx IS NULL THEN 'last' ELSE 'missing' END AS ends_in, met AND start = here AS on_cycle,
    coalesce(c, 0) AS n_named_by
  FROM over o JOIN link l ON l.n = o.here LEFT JOIN named m ON m.nx = o.start
), chains AS (
  SELECT 'https://feeds.example.org/minor/page-' || n || '.atom' AS page, chain,
    max(pages_after) OVER (PARTITION BY chain) - pages_after + 1 AS position, pages_after, ends_in, on_cycle, n_named_by
  FROM ranked
)"""
TANGLED = CHAINS.format(
    there=f"{PAGE} % 50 <> 40",
    link="CASE WHEN n % 50 = 49 THEN NULL WHEN n % 50 = 20 THEN n - 5 WHEN n % 50 = 30 THEN n + 2 ELSE n + 1 END")

BUDGET = """WITH lines AS (
  SELECT o_custkey AS idente, CASE WHEN l_returnflag = 'R' THEN 'I' ELSE 'G' END AS tipreig,
    l_linenumber || '' || (l_partkey % 100) AS cdcta,
    CASE WHEN l_orderkey % 23 <> 0 THEN CAST(round(l_extendedprice * 100) AS BIGINT) / 100.0::DOUBLE END AS importer,
    (CAST(round(l_extendedprice * 100) AS BIGINT) + 1000) / 100.0::DOUBLE AS imported,
    CAST(floor(CAST(round(l_extendedprice * 100) AS BIGINT) / 2) AS BIGINT) / 100.0::DOUBLE AS importel
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), entities AS (
  SELECT c_custkey AS idente, CASE WHEN c_custkey % 500 % 7 = 0 THEN 'Entidad "' || (c_custkey % 500) || '", zona' || chr(10) || 'dos'
    ELSE 'Entidad ' || (c_custkey % 500) END AS entity,
    lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0') AS code
  FROM customer
)"""

LINE = """WITH l AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
    CAST(l_shipdate AS DATE) AS day, CAST(CAST(l_shipdate AS DATE) + INTERVAL 28 YEAR AS DATE) AS later
  FROM lineitem
)"""
PRICE = "(cents / 100.0::DOUBLE)"
WHOLE = "CAST(floor(cents / 100.0::DOUBLE) AS BIGINT)"
FLAG_BANDS = " ".join(f"WHEN {PRICE} BETWEEN {low} AND {high} THEN {lit(text)}" for low, high, text in ref.AMOUNT_FLAGS)


def graph() -> str:
    """Graph CTEs: e (edges) and n (nodes)."""
    parts = []
    for column, prefix, label, depth in (
        ("contract_type", "tipo", "Tipo", 2), ("cpv", "cpv", "CPV", 3), ("municipality", "mun", "Municipio", 2),
        ("province", "prov", "Provincia", 3),
    ):
        parts.append(f"""SELECT * FROM (
    SELECT 'adj::' || supplier AS source, '{prefix}::' || {column} AS target, '{label}' AS label, {money('amount')} AS total,
      count(*) AS n_contracts, {depth} AS depth
    FROM known WHERE supplier IN (SELECT supplier FROM pairs) AND {column} IS NOT NULL GROUP BY supplier, {column}
    ORDER BY total DESC, supplier, {column} LIMIT 160)""")
    secondary = "\n  UNION ALL ".join(parts)
    return f"""{BASE},
known AS (SELECT * FROM c WHERE lower(trim(supplier)) <> 'no consta'),
pairs AS (
  SELECT buyer, supplier, {money('amount')} AS total, count(*) AS n_contracts FROM known GROUP BY 1, 2
  ORDER BY total DESC, buyer, supplier LIMIT 80
),
links AS (
  SELECT 'org::' || buyer AS source, 'adj::' || supplier AS target, format('{{:,.0f}}', total) || ' €' AS label, total,
    n_contracts, 1 AS depth FROM pairs
  UNION ALL {secondary}
),
e AS (SELECT *, 0.9::DOUBLE + 5.5::DOUBLE * (total / (SELECT max(total) FROM links)) AS width FROM links),
ends AS (
  SELECT target AS node, total FROM links UNION ALL SELECT source, total FROM links WHERE depth = 1
),
sums AS (SELECT node, {money('total')} AS total FROM ends GROUP BY node),
n AS (
  SELECT node, regexp_replace(node, '^[a-z]+::', '') AS label,
    CASE split_part(node, '::', 1) WHEN 'org' THEN 'organo' WHEN 'adj' THEN 'adjudicatario' ELSE split_part(node, '::', 1) END
      AS node_group,
    CAST(CASE split_part(node, '::', 1) WHEN 'org' THEN 1 WHEN 'adj' THEN 2 ELSE 3 END AS INTEGER) AS level, total,
    greatest(9.0::DOUBLE, 9 + 34 * (total / (SELECT max(total) FROM sums))) AS size
  FROM sums
)"""


BIPARTITE = f"""{BASE},
links AS (
  SELECT buyer, supplier, {money('amount')} AS total, count(*) AS n_contracts
  FROM c WHERE lower(supplier) <> 'no consta' GROUP BY 1, 2 ORDER BY total DESC, buyer, supplier LIMIT 35
)"""

TEXT_PAGES = """WITH pages_of_text AS (
  SELECT doc_id, 1 AS page, text FROM documents
  UNION ALL
  SELECT l_orderkey + 1000000000, l_linenumber,
    'Factura ' || l_orderkey || chr(10) || 'NIF ' || d || CASE WHEN l_orderkey % 2 = 0 THEN '-' ELSE '' END || 'Z fecha '
    || strftime(l_shipdate, '%d/%m/%Y') || ' importe ' || (price // 1000) || '.'
    || lpad(CAST(price % 1000 AS VARCHAR), 3, '0')
    || CASE l_orderkey % 3 WHEN 0 THEN ' €' WHEN 1 THEN ' EUR' ELSE 'euros' END
    || chr(10) || 'tel. 6' || substr(d, 1, 2) || ' ' || substr(d, 3, 3) || ' ' || substr(d, 6, 3)
    || ' cuenta ES12 3456 ' || substr(d, 1, 4) || ' ' || substr(d, 5, 4) || ' 0001 22, correo linea' || l_linenumber
    || '@ejemplo.es; IVA incluido 18.000 € y 14.500 EUR.'
  FROM (SELECT *, lpad(CAST(l_orderkey * 7919 % 100000000 AS VARCHAR), 8, '0') AS d,
    CAST(floor(l_extendedprice) AS BIGINT) AS price FROM lineitem)
)"""


def scan() -> str:
    """Matches by their offset: text between matches, then the running length."""
    parts = []
    for kind, pattern in ref.SCAN_PATTERNS.items():
        p = lit(pattern)
        parts.append(f"""SELECT doc_id, page, {lit(kind)} AS kind, text, regexp_extract_all(text, {p}) AS hits,
      regexp_split_to_array(text, {p}) AS gaps FROM pages_of_text WHERE regexp_matches(text, {p})""")
    union = "\n    UNION ALL ".join(parts)
    return f"""{TEXT_PAGES},
found AS ({union}),
each AS (
  SELECT doc_id, page, kind, text, unnest(hits) AS value, unnest(range(1, len(hits) + 1)) AS i, hits, gaps FROM found
),
placed AS (
  SELECT *, CAST(coalesce(list_sum([length(x) for x in gaps[1:i]]), 0)
    + coalesce(list_sum([length(x) for x in hits[1:i-1]]), 0) AS BIGINT) AS start
  FROM each
)"""


def sql() -> dict[str, str]:
    out: dict[str, str] = {}

    def on(base: str, **selects: str) -> None:
        for name, select in selects.items():
            out[name] = f"{base}\n{select}"

    # Sources and sinks
    out["feed_entries"] = f"""
SELECT 'https://feeds.example.org/minor/page-' || {PAGE} || '.atom' AS source_file, count(*) + 1 AS n_entries,
  0 AS first_ord, CAST(count(*) AS INTEGER) AS last_ord, count(*) + 1 AS n_whole
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY {PAGE}"""
    on(FEED, feed_contracts="SELECT * FROM fc", feed_contracts_split="SELECT * FROM fc", stream_contracts="SELECT * FROM fc", contracts_load=f"""
SELECT 2024 AS max_year, CASE WHEN fiscal_year <= 2024 THEN fiscal_year END AS fiscal_year, region, count(*) AS n_contracts,
  {money('amount')} AS total FROM fc GROUP BY 1, 2, 3
UNION ALL
SELECT 2030, fiscal_year, region, count(*), {money('amount')} FROM fc GROUP BY 1, 2, 3""")
    on(FEED, feed_latest_revisions=r"""SELECT * EXCLUDE (l_orderkey, l_linenumber) REPLACE (CASE WHEN (CAST(floor(l_orderkey / 250.0) AS BIGINT) + (l_linenumber // 8) * 1000000000) % 3 = 1
  THEN 'Rectificado: ' || subject ELSE subject END AS subject)
FROM (SELECT *, CAST(regexp_extract(file_url, '/(\d+)-(\d+)$', 1) AS BIGINT) AS l_orderkey,
  CAST(regexp_extract(file_url, '/(\d+)-(\d+)$', 2) AS BIGINT) AS l_linenumber FROM fc)
QUALIFY row_number() OVER (PARTITION BY file_url ORDER BY """ + ", ".join(f"{c} DESC NULLS LAST" for c in schema.CONTRACTS.fieldNames()) + ") = 1")
    on(FEED.replace(" WHERE feed_amount <= 50000", ""), feed_contracts_any_amount="SELECT * FROM fc")
    on(BASE, feed_rejects=f"""
SELECT 'https://feeds.example.org/minor/page-' || {PAGE} || '.atom' AS source_file, reason, count(*) AS n
FROM (SELECT *, CASE WHEN l_orderkey % 101 = 0 THEN 'no buyer'
    WHEN CASE WHEN l_linenumber = 7 THEN l_extendedprice ELSE amount END > 50000 THEN 'over limit' END AS reason FROM k)
WHERE reason IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT DISTINCT 'https://feeds.example.org/minor/page-' || {PAGE} || '.atom', 'malformed', 1 FROM k""")
    on(PAGES.replace(f" WHERE {PAGE} % 7 <> 3", ""), feed_page_chain_whole="SELECT * FROM chain")
    on(PAGES, feed_page_chain="SELECT * FROM chain",
       feed_missing_pages="SELECT page, next_url, next_page FROM chain WHERE NOT next_is_present")
    on(CHAINS.format(there="true", link="n + 1"), feed_chain_rank_whole="SELECT * FROM chains")
    on(TANGLED, feed_chain_rank="SELECT * FROM chains", feed_chains="""SELECT *, ends_in = 'last' AND n_beginnings = 1 AND n_forks = 0
  AS is_complete FROM (SELECT chain, max(ends_in) AS ends_in, count(*) AS n_pages, count(*) FILTER (n_named_by = 0) AS n_beginnings,
  count(*) FILTER (n_named_by > 1) AS n_forks, max(pages_after) AS most_after FROM chains GROUP BY chain)""")
    out["manifest_source"] = """
SELECT '2024-01-01T00:00:00Z#' || (page_id // 100) AS fetched_at, 'contratos menores' AS source,
  CAST(row_number() OVER w - 1 AS INTEGER) AS visit, url,
  url = last_value(url) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS is_last, 0 AS n_errors
FROM pages WINDOW w AS (PARTITION BY page_id // 100 ORDER BY page_id)"""
    out["budget_source"] = f"""{BUDGET}
SELECT entity, CAST(sum(CAST(importer AS DECIMAL(24,4))) AS DOUBLE) AS total, count(*) AS n_lines
FROM lines JOIN entities USING (idente) WHERE tipreig = 'G' AND cdcta LIKE '2%' GROUP BY entity"""
    on(groups(), export_tables="""
SELECT '01_alertas' AS table_name, concat_ws('|', supplier, buyer, contract_type, fiscal_year, risk_index, priority, signals, first_date,
  total_text) AS content, total AS value FROM r WHERE is_alert
UNION ALL SELECT '02_radar_completo', concat_ws('|', supplier, buyer, contract_type, fiscal_year, risk_index, priority, signals, first_date,
  total_text), total FROM r
UNION ALL SELECT '03_top_adjudicatarios', supplier, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) FROM c GROUP BY supplier
UNION ALL SELECT '04_relaciones_organo_adjudicatario', concat_ws('|', buyer, supplier), CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE)
  FROM c GROUP BY buyer, supplier
UNION ALL SELECT '05_contratos_filtrados', concat_ws('|', file_url, buyer, subject, award_date, cpv), amount FROM c""")

    # Filters, search and facets
    on_screen = """SELECT {} FROM c
WHERE buyer IN ('Hospital de Cádiz', 'Universidad de León', 'Gobierno de Andalucía') AND fiscal_year IN (2022, 2023)
  AND contract_type IN ('Obras', 'Servicios') AND contains(lower(supplier), 'supplier#') AND amount BETWEEN 0 AND 40000"""
    on(
        BASE,
        contracts_parquet_sink="SELECT * FROM c",
        contracts_part_rewritten=f"""SELECT fiscal_year, CAST(regexp_matches(file_url, '[13579]$') AS INTEGER) AS half, count(*) AS n_contracts,
  count(DISTINCT file_url) AS n_urls, {money('amount')} AS total FROM c
WHERE regexp_matches(file_url, '[02468]$') OR fiscal_year IN (2024, 2026, 2027) GROUP BY 1, 2""",
        export_filtered_contracts=on_screen.format(
            "award_date, region, province, municipality, buyer_type, buyer, fiscal_year, contract_type, cpv, subject, "
            "supplier, amount, file_url"
        ),
        ui_filter_semantics=on_screen.format("*"),
        query_contracts="""SELECT * FROM c
WHERE region IN ('Galicia', 'Andalucía', 'Cataluña', 'Castilla y León') AND contract_type IN ('Servicios', 'Suministros')
  AND fiscal_year IN (2021, 2022, 2023, 2024) AND lower(supplier) LIKE '%supplier#0000000%'
  AND lower(subject) LIKE '%de %' AND (lower(buyer) LIKE '%hospital%' OR lower(buyer) LIKE '%ayuntamiento%')
  AND amount >= 500 AND amount <= 9000""",
        query_contracts_table="""SELECT * FROM c
WHERE region IN ('Galicia', 'Andalucía', 'Cataluña', 'Castilla y León') AND contract_type IN ('Servicios', 'Suministros')
  AND fiscal_year IN (2021, 2022, 2023, 2024) AND lower(supplier) LIKE '%supplier#0000000%'
  AND lower(subject) LIKE '%de %' AND (lower(buyer) LIKE '%hospital%' OR lower(buyer) LIKE '%ayuntamiento%')
  AND amount >= 500 AND amount <= 9000""",
        query_contracts_like="""SELECT * FROM c
WHERE lower(supplier) LIKE '%supplier%1_%' AND lower(buyer) LIKE '%universidad de %a%'""",
        facet_values="""SELECT DISTINCT buyer AS value FROM c
WHERE buyer IS NOT NULL AND region IN ('Galicia', 'Aragón', 'Castilla y León')""",
        facet_cascade="""
SELECT 'region' AS facet, region AS value, count(*) AS n FROM c WHERE region IS NOT NULL GROUP BY 2
UNION ALL SELECT 'province', province, count(*) FROM c
  WHERE province IS NOT NULL AND region IN ('Andalucía', 'Castilla y León') GROUP BY 2
UNION ALL SELECT 'municipality', municipality, count(*) FROM c
  WHERE municipality IS NOT NULL AND region IN ('Andalucía', 'Castilla y León')
    AND province IN ('Granada', 'León', 'Cádiz') GROUP BY 2
UNION ALL SELECT 'buyer_type', buyer_type, count(*) FROM c WHERE buyer_type IS NOT NULL GROUP BY 2""",
        dataset_metadata=f"""
SELECT count(*) AS n_contracts, count(DISTINCT buyer) AS n_buyers, count(DISTINCT supplier) AS n_suppliers,
  {money('amount')} AS total_amount, min(award_date) AS first_date, max(award_date) AS last_date,
  count(DISTINCT region) AS n_regions FROM c""",
        search_buyers=f"""SELECT * FROM c
WHERE (contains({fold('buyer')}, 'hospital') AND contains({fold('buyer')}, 'leon'))
  OR contains({fold('buyer')}, 'diputacion provincial de cadiz')""",
        search_buyer_or_place=f"""
SELECT c.* FROM c, (SELECT 1) WHERE
  (contains({fold("buyer || ' ' || coalesce(municipality, '')")}, '1')
   AND contains({fold("buyer || ' ' || coalesce(municipality, '')")}, 'villa')
   AND contains({fold("buyer || ' ' || coalesce(municipality, '')")}, 'avila'))
  OR (contains({fold('buyer')}, 'coruna') AND contains({fold('buyer')}, 'universidad'))""",
        municipal_coverage="""
SELECT min(award_date) AS first_date, max(award_date) AS last_date, count(DISTINCT municipality) AS n_municipalities,
  count(DISTINCT buyer) AS n_buyers,
  count(DISTINCT buyer) FILTER (lower(buyer) LIKE '%ayuntamiento%') AS n_municipal_buyers,
  count(*) FILTER (municipality = 'Villa 1') AS contracts_located,
  count(DISTINCT buyer) FILTER (buyer LIKE '%Villa 1%') AS buyers_named,
  count(DISTINCT buyer) FILTER (buyer LIKE 'Ayuntamiento%' AND municipality = 'Villa 1') AS municipal_located
FROM c""",
        municipal_coverage_rows="""
SELECT * FROM (SELECT DISTINCT 'buyer_name' AS match_set, buyer, municipality, province, region, award_date FROM c
  WHERE buyer LIKE '%Villa 1%'
  ORDER BY buyer NULLS LAST, municipality NULLS LAST, province NULLS LAST, region NULLS LAST, award_date NULLS LAST LIMIT 50)
UNION ALL
SELECT * FROM (SELECT DISTINCT 'located' AS match_set, buyer, municipality, province, region, award_date FROM c
  WHERE municipality = 'Villa 1'
  ORDER BY buyer NULLS LAST, municipality NULLS LAST, province NULLS LAST, region NULLS LAST, award_date NULLS LAST LIMIT 50)""",
        reviewable_contracts="""
SELECT award_date, supplier, buyer, contract_type, amount, subject FROM c
ORDER BY amount DESC NULLS LAST, award_date NULLS FIRST, supplier NULLS FIRST, buyer NULLS FIRST,
  contract_type NULLS FIRST, subject NULLS FIRST LIMIT 40""",
    )
    on(groups(), case_detail="""
SELECT c.award_date, c.buyer, c.fiscal_year, c.contract_type, c.subject, c.supplier, c.amount
FROM c JOIN r ON c.supplier_key = r.supplier AND c.buyer = r.buyer AND c.contract_type = r.contract_type
  AND c.fiscal_year = r.fiscal_year WHERE r.is_alert""")

    # Scalar functions
    on(
        LINE,
        parse_money=f"""SELECT l_orderkey, l_linenumber,
  CASE WHEN l_linenumber IN (1, 2) THEN {PRICE} WHEN l_linenumber IN (3, 4, 6) THEN {WHOLE} END AS amount FROM l""",
        format_euros=f"""SELECT l_orderkey, l_linenumber,
  CASE WHEN l_linenumber = 7 THEN '—' ELSE {euros('cents * 37 / 100.0::DOUBLE')} END AS text FROM l""",
        format_pct=f"""SELECT l_orderkey, l_linenumber,
  CASE WHEN l_linenumber = 7 THEN '—' ELSE {pct('cents / 1000.0::DOUBLE')} END AS text FROM l""",
        province_from_postcode=f""", {INE} SELECT l_orderkey, l_linenumber, province
FROM l LEFT JOIN ine ON lpad(CAST(l_partkey % 60 AS VARCHAR), 2, '0') = code""",
        normalize_award_date="""SELECT l_orderkey, l_linenumber,
  CASE WHEN l_linenumber <= 3 THEN later WHEN l_linenumber = 4 AND year(day) >= 2010 THEN day END AS award_date FROM l""",
        parse_mixed_dates="""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 6 THEN day END AS day FROM l""",
        contract_type_label=f""", {values("codes", "code, label", list(ref.CONTRACT_TYPES.items()))}
SELECT l_orderkey, l_linenumber,
  CASE WHEN l_linenumber <= 5 THEN coalesce(label, 'Tipo ' || (l_partkey % 55)) WHEN l_linenumber = 6 THEN 'Obras'
    ELSE 'Otros' END AS contract_type
FROM l LEFT JOIN codes ON code = CAST(l_partkey % 55 AS VARCHAR)""",
        amount_flag=f"""SELECT l_orderkey, l_linenumber,
  CASE WHEN l_linenumber = 7 THEN 'OK' {FLAG_BANDS} ELSE 'OK' END AS flag FROM l""",
    )
    out["fold_text"] = f"SELECT doc_id, md5({fold('text')}) AS folded_md5 FROM documents"
    small = ", ".join(lit(w) for w in ref.PLACE_STOP_WORDS)
    on(
        BASE,
        title_place=f"""SELECT buyer, array_to_string([
  CASE WHEN i > 1 AND w IN ({small}) THEN w ELSE upper(w[1]) || w[2:] END
  for w, i in string_split('la ' || lower(buyer) || ' de los ríos', ' ')], ' ') AS titled
FROM (SELECT DISTINCT buyer FROM c)""",
        normalize_province="SELECT DISTINCT province, province AS normal FROM c",
        province_in_text=f"""SELECT buyer, arg_max(prov.province, length(prov.province) * 100 - ord) AS province
FROM (SELECT DISTINCT buyer FROM c) b LEFT JOIN prov ON contains({fold('buyer')}, {fold('prov.province')}) GROUP BY buyer""",
        normalize_municipality="""SELECT DISTINCT municipality, province, municipality || ' de los Montes' AS normal FROM c""",
        region_from_province="SELECT DISTINCT province, region FROM c",
        contract_territory="""SELECT DISTINCT buyer, nation_code, municipality, province, region FROM k""",
        extract_buyer_amount_from_summary="SELECT l_orderkey, l_linenumber, buyer, amount FROM k",
        infer_municipality="""SELECT buyer, regexp_extract(buyer, 'Ayuntamiento de (Villa [0-9]+)', 1) AS town
FROM (SELECT DISTINCT buyer FROM c WHERE buyer LIKE 'Ayunt%') UNION ALL
SELECT DISTINCT buyer, NULL FROM c WHERE buyer NOT LIKE 'Ayunt%'""",
        infer_geography="SELECT buyer, province, region FROM geo WHERE buyer IN (SELECT buyer FROM c)",
        infer_buyer_type="SELECT DISTINCT buyer, buyer_type FROM c",
        legal_limit="""SELECT DISTINCT contract_type,
  CASE WHEN contract_type IN ('Obras', 'Concesión de obras') THEN 40000.0::DOUBLE ELSE 15000.0::DOUBLE END AS limit_amount FROM c""",
    )

    # Radar
    report = """supplier, buyer, contract_type, fiscal_year, n_contracts, total_text, limit_text, pct_text, risk_index,
  priority, risk_level, signals, days_between, individual_amounts"""
    texts = f"(SELECT {GROUP}, individual_amounts FROM g) USING ({GROUP})"
    on(
        groups(),
        radar="SELECT * FROM r",
        stream_radar="SELECT * FROM r", stream_radar_replayed="SELECT * FROM r",
        radar_groups="SELECT * EXCLUDE (individual_amounts) FROM g",
        radar_amounts=f"""SELECT supplier_key AS supplier, buyer, contract_type, fiscal_year, amount, count(*) AS n FROM c
WHERE supplier_key IS NOT NULL AND buyer IS NOT NULL AND contract_type IS NOT NULL AND fiscal_year IS NOT NULL GROUP BY 1, 2, 3, 4, 5""",
        radar_summary="""SELECT count(*) FILTER (risk_level LIKE '🚨%') AS over_limit,
  count(*) FILTER (risk_level LIKE '🔴%') AS over_95, count(*) FILTER (risk_level LIKE '🟠%') AS over_90,
  count(*) AS n_groups FROM r""",
        priority_case=f"SELECT * FROM r JOIN {texts} WHERE is_alert ORDER BY {RISK_ORDER} LIMIT 1",
        priority_alerts=f"""SELECT * FROM r JOIN {texts} WHERE is_alert OR NOT (SELECT bool_or(is_alert) FROM r)
ORDER BY {RISK_ORDER} LIMIT 18""",
        report_summary=f"""SELECT (SELECT count(*) FROM c) AS n_contracts, (SELECT {money('amount')} FROM c) AS total_amount,
  (SELECT count(DISTINCT buyer) FROM c) AS n_buyers, (SELECT count(DISTINCT supplier) FROM c) AS n_suppliers,
  count(*) AS n_groups, count(*) FILTER (is_alert) AS n_alerts,
  coalesce(CAST(sum(CAST(total AS DECIMAL(18,2))) FILTER (is_alert) AS DOUBLE), 0) AS alert_amount FROM r""",
        report_alert_table=f"SELECT {report} FROM r JOIN {texts} WHERE is_alert",
        report_alert_amounts=f"""SELECT {GROUP}, risk_index, risk_level, total_text, amount, count(*) AS n FROM r JOIN (
  SELECT supplier_key AS supplier, buyer, contract_type, fiscal_year, amount FROM c WHERE amount IS NOT NULL) USING ({GROUP})
WHERE is_alert GROUP BY ALL""",
        report_alert_table_short=f"""SELECT supplier, buyer, contract_type, fiscal_year, n_contracts, total_text, pct_text,
  risk_index FROM r WHERE is_alert ORDER BY {RISK_ORDER} LIMIT 40""",
        risk_scatter=f"SELECT {GROUP}, n_contracts, total, total_text, risk_level FROM r",
    )
    out["treemap_suppliers"] = f"""{groups()}, top30 AS (SELECT * FROM r ORDER BY total DESC, {GROUP} LIMIT 30)
SELECT {GROUP}, total, n_contracts, risk_level, total_text, pct_text, pct_limit AS pct,
  least(120.0::DOUBLE, greatest(0.0::DOUBLE, pct_limit)) AS pct_clipped,
  total / (SELECT {money('total')} FROM top30) AS share FROM top30"""
    on(groups(3, "0.9::DOUBLE * CASE WHEN contains(lower(contract_type), 'obra') THEN 40000 ELSE 15000 END"),
       radar_alerts=f"SELECT {GROUP}, total, n_contracts, is_alert, limit_amount, pct_limit, risk_level FROM r")

    # Rankings and charts
    months = ", ".join(
        f"coalesce(CAST(sum(CAST(amount AS DECIMAL(18,2))) FILTER (month(award_date) = {m}) AS DOUBLE), 0) AS m{m:02d}"
        for m in range(1, 13)
    )
    by_place = f"SELECT {{0}} AS place, {money('amount')} AS value FROM c WHERE {{0}} IS NOT NULL GROUP BY 1"
    levels = "\nUNION ALL ".join(
        f"SELECT '{level}' AS level, {level} AS place, {money('amount')} AS total, count(amount) AS n_contracts "
        f"FROM c WHERE {level} IS NOT NULL GROUP BY 2"
        for level in ("region", "province", "municipality")
    )
    on(
        BASE,
        top_suppliers=f"""SELECT supplier, {money('amount')} AS total, count(*) AS n_contracts FROM c GROUP BY 1
ORDER BY total DESC, supplier LIMIT 20""",
        buyer_supplier_relations=f"""SELECT buyer, supplier, {money('amount')} AS total, count(*) AS n_contracts FROM c
GROUP BY 1, 2 ORDER BY total DESC, buyer, supplier LIMIT 20""",
        main_relations=f"""SELECT buyer, supplier, {money('amount')} AS total, count(*) AS n_contracts FROM c
WHERE lower(trim(supplier)) <> 'no consta' GROUP BY 1, 2 ORDER BY total DESC, buyer, supplier LIMIT 18""",
        spend_by_year_type=f"""SELECT fiscal_year, contract_type, {money('amount')} AS total FROM c
WHERE fiscal_year IS NOT NULL GROUP BY 1, 2""",
        spend_by_territory=by_place.format("province"),
        spend_by_territory_count="""SELECT municipality AS place, count(*) AS value FROM c
WHERE municipality IS NOT NULL GROUP BY 1""",
        territory_all_levels=levels,
        first_territory=f"""SELECT 'region' AS level, region AS place, {money('amount')} AS total,
  count(amount) AS n_contracts FROM c WHERE region IS NOT NULL GROUP BY region""",
        first_territory_province=f"""SELECT 'province' AS level, province AS place, {money('amount')} AS total,
  count(amount) AS n_contracts FROM c GROUP BY province""",
        monthly_heatmap=f"SELECT CAST(year(award_date) AS INTEGER) AS year, {months} FROM c WHERE award_date IS NOT NULL GROUP BY 1",
        amount_histogram="""SELECT * FROM (
  SELECT CAST(bin AS INTEGER) AS bin, low + (bin - 1) * width AS bin_start, contract_type, count(*) AS n_contracts
  FROM (
    SELECT contract_type, low, (high - low) / bins AS width,
      CASE WHEN high = low THEN 1 ELSE least(bins, CAST(floor((amount - low) / ((high - low) / bins)) AS BIGINT) + 1) END AS bin
    FROM c, (SELECT min(amount) AS low, max(amount) AS high,
        least(60, greatest(10, CAST(floor(sqrt(count(*))) AS BIGINT))) AS bins FROM c WHERE amount > 0)
    WHERE amount > 0)
  GROUP BY 1, 2, 3)""",
        top_supplier_contracts=f"""SELECT supplier, file_url, amount FROM c WHERE supplier IN (
  SELECT supplier FROM c GROUP BY 1 ORDER BY {money('amount')} DESC, supplier LIMIT 10)""",
        supplier_timeline=f""", dated AS (SELECT * FROM c WHERE award_date IS NOT NULL),
shown AS (SELECT * FROM dated WHERE supplier IN (
  SELECT supplier FROM dated GROUP BY 1 ORDER BY {money('amount')} DESC, supplier LIMIT 18))
SELECT award_date, supplier, buyer, contract_type, subject, fiscal_year, amount,
  8 + 20 * sqrt(amount / (SELECT max(amount) FROM shown)) AS marker_size FROM shown""",
        spend_concentration=f""", t AS (SELECT supplier, sum(CAST(amount AS DECIMAL(18,2))) AS exact FROM c GROUP BY 1
  ORDER BY exact DESC, supplier LIMIT 25)
SELECT supplier, CAST(exact AS DOUBLE) AS total,
  CAST(sum(exact) OVER (ORDER BY exact DESC, supplier ROWS UNBOUNDED PRECEDING) AS DOUBLE)
    / (SELECT CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) FROM c) * 100 AS running_pct FROM t""",
    )
    for name, level, centroids, metric in (
        ("territory_map", "province", ref.PROVINCE_CENTROIDS, money("amount")),
        ("territory_map_regions", "region", ref.REGION_CENTROIDS, "count(*)"),
    ):
        points = values("points", "place, lat, lon", [(p, *xy) for p, xy in centroids.items()])
        out[name] = f"""{BASE}, {points}
SELECT {level} AS place, {metric} AS value, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon
FROM c JOIN points ON place = {level} GROUP BY {level}, lat, lon"""

    # Graph
    on(
        graph(),
        graph_edges="SELECT * FROM e",
        graph_nodes="SELECT * FROM n",
        graph_filter=""", v AS (SELECT * FROM e WHERE depth <= 2 AND source NOT LIKE 'mun::%' AND target NOT LIKE 'mun::%')
SELECT n.*, degree FROM n JOIN (
  SELECT node, count(DISTINCT other) AS degree FROM (
    SELECT source AS node, target AS other FROM v UNION ALL SELECT target, source FROM v) GROUP BY node) USING (node)""",
    )
    on(
        BIPARTITE,
        bipartite_links="SELECT *, 0.8::DOUBLE + 5.2::DOUBLE * (total / (SELECT max(total) FROM links)) AS width FROM links",
        bipartite_layout_data=f""", t AS (
  SELECT 'buyer' AS side, buyer AS name, {money('total')} AS total FROM links GROUP BY buyer
  UNION ALL SELECT 'supplier', supplier, {money('total')} FROM links GROUP BY supplier)
SELECT side, name, total,
  CASE WHEN count(*) OVER s = 1 THEN 0.5::DOUBLE
    ELSE 1 - (row_number() OVER (PARTITION BY side ORDER BY total DESC, name) - 1) / (count(*) OVER s - 1)::DOUBLE END AS position,
  14 + 28 * (total / max(total) OVER s) AS marker_size
FROM t WINDOW s AS (PARTITION BY side)""",
    )

    # Budget
    spent = "CAST(sum(CAST(importer AS DECIMAL(24,4))) AS DOUBLE)"
    on(
        BUDGET,
        budget_ranking=f"""SELECT entity, {spent} AS total, count(*) AS n_lines FROM lines JOIN entities USING (idente)
WHERE tipreig = 'G' AND cdcta LIKE '2%' AND code IN ('15', '08', '01') GROUP BY entity""",
        budget_ranking_by_id=f"""SELECT CAST(idente AS VARCHAR) AS idente, entity, {spent} AS total, count(*) AS n_lines
FROM lines JOIN entities USING (idente) WHERE tipreig = 'G' AND cdcta LIKE '4%' GROUP BY 1, 2
ORDER BY total DESC NULLS LAST, 1, 2 LIMIT 100""",
        budget_ranking_total=f""", r AS (SELECT entity, {spent} AS total FROM lines JOIN entities USING (idente)
  WHERE tipreig = 'G' AND cdcta LIKE '1%' GROUP BY entity)
SELECT (SELECT count(*) FROM r) AS n_entities,
  coalesce((SELECT CAST(sum(CAST(total AS DECIMAL(24,4))) AS DOUBLE)
    FROM (SELECT total FROM r ORDER BY total DESC NULLS LAST, entity LIMIT 100)), 0) AS shown_total""",
        budget_entity_detail="""SELECT entity, tipreig, cdcta AS account, imported AS planned, importer AS recognised,
  importel AS settled FROM lines JOIN entities USING (idente) WHERE lower(entity) LIKE 'entidad 1_' AND cdcta LIKE '2%'""",
    )

    # Forensic text
    amount = "CAST(nullif(regexp_replace(regexp_replace(value, '[^0-9.]', '', 'g'), '\\.', '', 'g'), '') AS DOUBLE)"
    bands = " ".join(f"WHEN n BETWEEN {low} AND {high} THEN {lit(text)}" for low, high, text in ref.AMOUNT_FLAGS)
    on(
        scan(),
        scan_text=f"""SELECT doc_id, page, 'Pág. ' || page AS location, kind, value, CAST(i - 1 AS INTEGER) AS ordinal,
  '...' || replace(substr(text, greatest(start - {ref.SCAN_CONTEXT}, 0) + 1,
    start + length(value) + {ref.SCAN_CONTEXT} - greatest(start - {ref.SCAN_CONTEXT}, 0)), chr(10), ' ') || '...' AS context
FROM placed""",
        flag_findings=f"""SELECT kind, CASE WHEN kind <> {lit(ref.AMOUNTS)} THEN 'OK' {bands} ELSE 'OK' END AS flag, count(*) AS n
FROM (SELECT kind, CASE WHEN kind = {lit(ref.AMOUNTS)} THEN {amount} END AS n FROM placed) GROUP BY 1, 2""",
    )
    # An index changes no answer.
    for name in ("search_buyers", "search_buyer_or_place", "query_contracts"):
        out[f"{name}_indexed"] = out[name]
    return out
