"""Independent DuckDB SQL for every registered query.

Written directly against the raw test tables (pre-registered views), in
the join-then-group form of the original reports, so it checks the Spark
plans (eager aggregation, semi-join reduction, partition layout, CSV round
trip) rather than repeating them. Integer sums are cast to BIGINT (DuckDB
widens them) and money to DOUBLE as the last step.
"""

from __future__ import annotations

# The test-table mapping (same definitions as claimscope.sources.testtables).
MODEL = """
WITH provider_registry AS (
    SELECT CAST(1000000000 + s.s_suppkey AS VARCHAR) AS npi,
           '2' AS entity_type,
           s.s_name AS org_name,
           CAST(NULL AS VARCHAR) AS first_name,
           CAST(NULL AS VARCHAR) AS last_name,
           CAST(NULL AS VARCHAR) AS credentials,
           'Clinic' AS taxonomy_1,
           CAST(s.s_suppkey AS VARCHAR) || ' Main St' AS address,
           'City_' || CAST(s.s_suppkey % 20 AS VARCHAR) AS city,
           n.n_name AS state,
           lpad(CAST(s.s_suppkey % 100000 AS VARCHAR), 5, '0') AS zip,
           '555-' || lpad(CAST(s.s_suppkey % 10000 AS VARCHAR), 4, '0') AS phone
    FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
    WHERE s.s_suppkey % 10 <> 9
    UNION ALL
    SELECT CAST(2000000000 + c.c_custkey AS VARCHAR),
           '1',
           CAST(NULL AS VARCHAR),
           c.c_mktsegment,
           CASE WHEN c.c_custkey % 11 <> 0 THEN c.c_name END,
           CASE WHEN c.c_custkey % 2 = 0 THEN 'MD' ELSE 'NP' END,
           c.c_mktsegment,
           CAST(c.c_custkey AS VARCHAR) || ' Oak Ave',
           'City_' || CAST(c.c_custkey % 20 AS VARCHAR),
           n.n_name,
           lpad(CAST(c.c_custkey % 100000 AS VARCHAR), 5, '0'),
           '555-' || lpad(CAST(c.c_custkey % 10000 AS VARCHAR), 4, '0')
    FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
    WHERE c.c_custkey % 13 <> 0
),
code_reference AS (
    SELECT code,
           CASE CAST(substring(code, 7) AS INTEGER) % 7
               WHEN 0 THEN 'Intake'
               WHEN 1 THEN 'Diagnostics'
               WHEN 2 THEN 'Treatment'
               WHEN 3 THEN 'Outreach'
               WHEN 4 THEN 'Follow-up & Review'
               WHEN 5 THEN 'Reporting'
               WHEN 6 THEN 'Support'
           END AS category,
           'Procedure ' || code AS description
    FROM (SELECT DISTINCT p_brand AS code FROM part
          WHERE CAST(substring(p_brand, 7) AS INTEGER) <= 14)
),
claim_lines AS (
    SELECT CAST(1000000000 + l.l_suppkey AS VARCHAR) AS billing_npi,
           CASE WHEN l.l_linenumber <> 7
                THEN CAST(2000000000 + l.l_partkey % 150 AS VARCHAR) END AS servicing_npi,
           p.p_brand AS code,
           CASE WHEN l.l_orderkey % 97 <> 0 THEN strftime(l.l_shipdate, '%Y-%m') END AS month,
           CAST(round(l.l_quantity) AS BIGINT) AS claims,
           CAST(o.o_custkey AS VARCHAR) AS beneficiary_id,
           CAST(l.l_extendedprice * (1 - l.l_discount) AS DECIMAL(18, 4)) AS paid
    FROM lineitem l
    JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN part p ON l.l_partkey = p.p_partkey
),
claims_monthly AS (
    SELECT billing_npi, servicing_npi, code, month,
           CAST(SUM(claims) AS BIGINT) AS total_claims,
           COUNT(DISTINCT beneficiary_id) AS total_unique_beneficiaries,
           CAST(ROUND(SUM(paid), 2) AS DECIMAL(18, 2)) AS total_paid
    FROM claim_lines
    GROUP BY 1, 2, 3, 4
),
claims AS (
    SELECT m.*, r.state AS practice_state, LEFT(m.month, 4) AS claim_year
    FROM claims_monthly m LEFT JOIN provider_registry r ON m.billing_npi = r.npi
)
"""

STATES = "('NATION_12', 'NATION_15')"
YEARS = "('1998', '1999')"
CODES = "('Brand#3', 'Brand#10')"
CATEGORY = "'Outreach'"
SEARCH = "'machinery'"
CATEGORIES = (
    "Diagnostics",
    "Outreach",
    "Follow-up & Review",
    "Reporting",
    "Intake",
    "Support",
    "Treatment",
)

CLAIM_COLS = (
    "billing_npi, servicing_npi, code, month, total_claims, total_unique_beneficiaries, "
    "CAST(total_paid AS DOUBLE) AS total_paid, practice_state, claim_year"
)
REG_ATTRS = (
    "entity_type", "org_name", "first_name", "last_name", "credentials", "taxonomy_1",
    "address", "city", "state", "zip", "phone",
)


def _m4(providers: str = "providers", t: str = "t.") -> str:
    return (
        f"COUNT(DISTINCT {t}billing_npi) AS {providers}, "
        f"CAST(SUM({t}total_claims) AS BIGINT) AS total_claims, "
        f"CAST(SUM({t}total_unique_beneficiaries) AS BIGINT) AS total_beneficiaries, "
        f"CAST(ROUND(SUM({t}total_paid), 2) AS DOUBLE) AS total_paid"
    )


def _where(states: bool = False, years: bool = False, codes: str | None = None) -> str:
    w = "WHERE t.practice_state IS NOT NULL"
    if states:
        w += f" AND t.practice_state IN {STATES}"
    if years:
        w += f" AND LEFT(t.month, 4) IN {YEARS}"
    if codes:
        w += f" AND t.code IN {codes}"
    return w


CATEGORY_CODES = f"(SELECT code FROM code_reference WHERE category = {CATEGORY})"

# ---------------------------------------------------------------- reports

OVERVIEW = (
    "SELECT t.practice_state AS state, " + _m4("total_providers")
    + " FROM claims t {where} GROUP BY 1"
)


def overview(where: str) -> str:
    return OVERVIEW.format(where=where)


def by_ref(select: str, group: str, where: str) -> str:
    return (
        f"SELECT {select} FROM claims t JOIN code_reference h ON t.code = h.code "
        f"{where} GROUP BY {group}"
    )


CODE_DETAIL = "h.code AS hcpcs_code, h.category, h.description, " + _m4()
MONTHLY = "t.month AS month, " + _m4()


def directory(view: str, where: str, money: str = "DOUBLE") -> str:
    """Directory rows: tracked claims, their sums by provider (pair), then the registry."""
    keys = {"billing": "billing_npi", "servicing": "servicing_npi", "combined": "billing_npi, servicing_npi"}[view]
    tracked = f"SELECT t.*, ref.category AS served FROM claims t JOIN code_reference ref USING (code) {where}"
    sums = (
        f"SELECT {keys}, COUNT(DISTINCT served) AS hiv_service_categories, "
        "STRING_AGG(DISTINCT served, ', ' ORDER BY served) AS categories_served, "
        "CAST(SUM(total_claims) AS BIGINT) AS total_hiv_claims, "
        "CAST(SUM(total_unique_beneficiaries) AS BIGINT) AS total_beneficiaries, "
        f"CAST(ROUND(SUM(total_paid), 2) AS {money}) AS total_paid FROM ({tracked}) tracked GROUP BY {keys}"
    )
    shown = ", ".join(
        "agg." + c for c in
        ("hiv_service_categories", "categories_served", "total_hiv_claims", "total_beneficiaries", "total_paid")
    )

    def organisation(r: str) -> str:
        return f"COALESCE({r}.org_name, {r}.first_name || ' ' || {r}.last_name)"

    def person(r: str) -> str:
        return (
            f"COALESCE(CASE WHEN {r}.entity_type = '2' THEN {r}.org_name "
            f"ELSE {r}.first_name || ' ' || {r}.last_name END, 'Unknown')"
        )

    if view == "combined":
        return (
            f"SELECT agg.billing_npi, {organisation('payee')} AS billing_name, payee.entity_type AS billing_entity_type, "
            f"agg.servicing_npi, {person('renderer')} AS servicing_name, renderer.credentials AS servicing_credentials, "
            f"renderer.taxonomy_1 AS servicing_taxonomy, payee.city, payee.state, payee.zip, {shown} "
            f"FROM ({sums}) agg LEFT JOIN provider_registry payee ON payee.npi = agg.billing_npi "
            "LEFT JOIN provider_registry renderer ON renderer.npi = agg.servicing_npi"
        )
    name = organisation("reg") if view == "billing" else person("reg")
    return (
        f"SELECT agg.{keys} AS npi, reg.entity_type, {name} AS provider_name, reg.credentials, "
        f"reg.taxonomy_1 AS taxonomy, reg.address, reg.city, reg.state, reg.zip, reg.phone, {shown} "
        f"FROM ({sums}) agg LEFT JOIN provider_registry reg ON reg.npi = agg.{keys}"
    )


DIR_COLS = (
    "npi", "entity_type", "provider_name", "credentials", "taxonomy", "address", "city",
    "state", "zip", "phone", "hiv_service_categories", "categories_served",
    "total_hiv_claims", "total_beneficiaries",
)
SERVICING_DIR = directory("servicing", _where(states=True, years=True), money="DECIMAL(38, 2)")
PAIR_COLS = (
    "billing_npi", "billing_name", "billing_entity_type", "servicing_npi", "servicing_name",
    "servicing_credentials", "servicing_taxonomy", "city", "state", "zip", "hiv_service_categories",
    "categories_served", "total_hiv_claims", "total_beneficiaries",
)
SERVICING_DIR_OUT = ", ".join(DIR_COLS) + ", CAST(total_paid AS DOUBLE) AS total_paid"
POST_CATEGORY = f"list_contains(string_split(categories_served, ', '), {CATEGORY})"
SEARCH_MATCH = (
    "contains(lower(concat_ws(chr(10), "
    + ", ".join(f"CAST({c} AS VARCHAR)" for c in DIR_COLS + ("total_paid",))
    + f")), {SEARCH})"
)


def servicing_dir(cond: str | None = None) -> str:
    where = f" WHERE {cond}" if cond else ""
    return f"SELECT {SERVICING_DIR_OUT} FROM ({SERVICING_DIR}) d{where}"


CATEGORY_TREND = (
    "SELECT t.month AS month, h.category, CAST(SUM(t.total_claims) AS BIGINT) AS total_claims "
    "FROM claims t JOIN code_reference h ON t.code = h.code "
    "WHERE t.practice_state IS NOT NULL GROUP BY 1, 2"
)

PIVOT = (
    "SELECT month, "
    + ", ".join(
        f"CAST(COALESCE(SUM(CASE WHEN category = '{c}' THEN total_claims END), 0) AS BIGINT) AS \"{c}\""
        for c in CATEGORIES
    )
    + f" FROM ({CATEGORY_TREND}) x WHERE month IS NOT NULL AND category IS NOT NULL GROUP BY month"
)


def registry_join(prefix: str, key: str) -> tuple[str, str]:
    """Prefixed registry columns and the LEFT JOIN clause on ``j.<key>``."""
    cols = ", ".join(f"{prefix}.{a} AS {prefix}_{a}" for a in REG_ATTRS)
    return cols, f"LEFT JOIN provider_registry {prefix} ON j.{key} = {prefix}.npi"


JOINED = (
    "SELECT t.billing_npi, t.servicing_npi, t.code, t.month, t.total_claims, "
    "t.total_unique_beneficiaries, CAST(t.total_paid AS DOUBLE) AS total_paid, "
    "t.practice_state, t.claim_year, h.category, h.description "
    "FROM claims t JOIN code_reference h ON t.code = h.code"
)
_B_COLS, _B_JOIN = registry_join("b", "billing_npi")
_S_COLS, _S_JOIN = registry_join("s", "servicing_npi")

CODE_FILE = (
    "SELECT 'P' || CAST(p_partkey AS VARCHAR) AS code, concat_ws(' ', p_name, p_type) AS description FROM part"
)
KEYWORD_MATCH = (
    "(contains(lower(description), 'gear') OR contains(lower(description), 'widget') "
    "OR contains(lower(description), 'promo'))"
)
KEYWORD_CODES = f"SELECT code, description FROM ({CODE_FILE}) f WHERE {KEYWORD_MATCH}"
CROSSWALK = (
    "SELECT code, description, CASE "
    "WHEN contains(lower(description), 'gear') THEN 'Treatment' "
    "WHEN contains(lower(description), 'widget') OR contains(lower(description), 'gizmo') THEN 'Outreach' "
    "WHEN contains(lower(description), 'promo') THEN 'Support' "
    f"ELSE 'Unassigned' END AS category FROM ({KEYWORD_CODES}) k"
)

REFERENCE = "SELECT code AS hcpcs_code, category, description FROM code_reference"
MONTHLY_ALL = by_ref(MONTHLY, "1", _where())
MONTHLY_STATES = by_ref(MONTHLY, "1", _where(states=True))
OVERVIEW_ALL = overview(_where())
CATEGORY_ALL = by_ref("h.category, " + _m4(), "1", _where())

VIEW_SEARCH = "'city_1'"


def _shown(view: str, cond: str | None = None) -> str:
    """A view over every state, optionally with a condition on the shown rows."""
    cols = PAIR_COLS if view == "combined" else DIR_COLS
    where = f" WHERE {cond}" if cond else ""
    rows = directory(view, _where(), money="DECIMAL(38, 2)")
    return f"SELECT {', '.join(cols)}, CAST(total_paid AS DOUBLE) AS total_paid FROM ({rows}) d{where}"


def _text_match(view: str) -> str:
    cols = PAIR_COLS if view == "combined" else DIR_COLS
    parts = ", ".join(f"CAST({c} AS VARCHAR)" for c in (*cols, "total_paid"))
    return f"contains(lower(concat_ws(chr(10), {parts})), {VIEW_SEARCH})"


def _views() -> dict[str, str]:
    out = {}
    for view in ("billing", "servicing", "combined"):
        out[f"directory_{view}_all"] = _shown(view)
        out[f"directory_{view}_category"] = directory(view, _where(states=True, years=True, codes=CATEGORY_CODES))
        out[f"directory_{view}_codes"] = directory(view, _where(states=True, years=True, codes=CODES))
        out[f"directory_{view}_all_post_category"] = _shown(view, POST_CATEGORY)
        out[f"directory_{view}_all_search"] = _shown(view, _text_match(view))
        rows = directory(view, _where(), money="DECIMAL(38, 2)")
        out[f"directory_{view}_all_count"] = (
            f"SELECT COUNT(*) AS rows_shown FROM ({rows}) d WHERE {POST_CATEGORY} AND {_text_match(view)}"
        )
        out[f"kpi_directory_{view}_all"] = (
            "SELECT COUNT(*) AS providers, CAST(COALESCE(SUM(total_hiv_claims), 0) AS BIGINT) AS total_hiv_claims, "
            "CAST(COALESCE(SUM(total_beneficiaries), 0) AS BIGINT) AS total_beneficiaries, "
            f"CAST(COALESCE(SUM(total_paid), 0) AS DOUBLE) AS total_paid FROM ({rows}) d"
        )
    return out


_BODY = {
    "scan_claims": f"SELECT {CLAIM_COLS} FROM claims",
    "code_reference": REFERENCE,
    "scan_registry": "SELECT * FROM provider_registry",
    "export_reference": REFERENCE,
    "export_state_summary": overview(_where(states=True, years=True)),
    "export_services": by_ref(CODE_DETAIL, "1, 2, 3", _where(states=True, years=True)),
    "export_directory": servicing_dir(f"{POST_CATEGORY} AND {SEARCH_MATCH}"),
    "export_trends": MONTHLY_STATES,
    "materialize_reports": OVERVIEW_ALL,
    "filter_known_state": f"SELECT {CLAIM_COLS} FROM claims WHERE practice_state IS NOT NULL",
    "filter_state": f"SELECT {CLAIM_COLS} FROM claims WHERE practice_state IN {STATES}",
    "filter_year": f"SELECT {CLAIM_COLS} FROM claims WHERE claim_year IN {YEARS}",
    "filter_code": f"SELECT {CLAIM_COLS} FROM claims WHERE code IN {CODES}",
    "filter_category": f"SELECT {CLAIM_COLS} FROM claims WHERE code IN {CATEGORY_CODES}",
    "filter_cascade": JOINED + " WHERE t.practice_state IS NOT NULL AND t.code IN " + CODES,
    "trend_monthly_state": MONTHLY_STATES,
    "directory_post_category": servicing_dir(POST_CATEGORY),
    "directory_search": servicing_dir(SEARCH_MATCH),
    "reference_by_category": REFERENCE + f" WHERE category = {CATEGORY}",
    "scalar_year": "SELECT month, LEFT(month, 4) AS year FROM claims",
    "scalar_billing_name": (
        "SELECT npi, COALESCE(org_name, first_name || ' ' || last_name) AS billing_name FROM provider_registry"
    ),
    "scalar_servicing_name": (
        "SELECT d.npi, COALESCE(CASE WHEN r.entity_type = '2' THEN r.org_name "
        "ELSE r.first_name || ' ' || r.last_name END, 'Unknown') AS servicing_name "
        "FROM (SELECT DISTINCT servicing_npi AS npi FROM claims) d "
        "LEFT JOIN provider_registry r ON d.npi = r.npi"
    ),
    "code_labels": (
        "SELECT code AS hcpcs_code, COALESCE(code, 'None') || ' — ' || COALESCE(description, 'None') AS label "
        f"FROM code_reference WHERE category = {CATEGORY}"
    ),
    "code_labels_parse": (
        "SELECT split_part(COALESCE(code, 'None') || ' — ' || COALESCE(description, 'None'), ' — ', 1) "
        "AS hcpcs_code FROM code_reference"
    ),
    "join_reference": JOINED,
    "join_billing": f"SELECT j.*, {_B_COLS} FROM ({JOINED}) j {_B_JOIN}",
    "join_servicing": f"SELECT j.*, {_S_COLS} FROM ({JOINED}) j {_S_JOIN}",
    "join_both": f"SELECT j.*, {_B_COLS}, {_S_COLS} FROM ({JOINED}) j {_B_JOIN} {_S_JOIN}",
    "enrich_claims": f"SELECT {CLAIM_COLS} FROM claims",
    "state_overview": OVERVIEW_ALL,
    "state_overview_filtered": overview(_where(states=True, years=True)),
    "service_category": CATEGORY_ALL,
    "service_category_filtered": by_ref("h.category, " + _m4(), "1", _where(states=True, years=True)),
    "service_category_state": by_ref("h.category, t.practice_state AS state, " + _m4(), "1, 2", _where()),
    "service_code": by_ref(CODE_DETAIL, "1, 2, 3", _where()),
    "service_code_filtered": by_ref(
        CODE_DETAIL, "1, 2, 3", _where(states=True, years=True, codes=CATEGORY_CODES)
    ),
    "directory_billing": directory("billing", _where(states=True, years=True)),
    "directory_servicing": directory("servicing", _where(states=True, years=True)),
    "directory_combined": directory("combined", _where(states=True, years=True)),
    "trend_monthly": MONTHLY_ALL,
    "trend_yearly": by_ref("LEFT(t.month, 4) AS year, " + _m4(), "1", _where()),
    "trend_category": CATEGORY_TREND,
    "reference_category_counts": (
        "SELECT category, COUNT(*) AS code_count FROM code_reference WHERE category IS NOT NULL GROUP BY 1"
    ),
    "kpi_reference": "SELECT COUNT(*) AS total_codes, COUNT(DISTINCT category) AS service_categories FROM code_reference",
    "kpi_overview": (
        "SELECT COUNT(*) AS states, CAST(COALESCE(SUM(total_providers), 0) AS BIGINT) AS providers, "
        "CAST(COALESCE(SUM(total_claims), 0) AS BIGINT) AS total_claims, "
        f"CAST(COALESCE(SUM(CAST(total_paid AS DECIMAL(38, 2))), 0) AS DOUBLE) AS total_paid FROM ({OVERVIEW_ALL}) o"
    ),
    "kpi_services": (
        "SELECT COUNT(*) AS service_categories, CAST(COALESCE(SUM(providers), 0) AS BIGINT) AS providers, "
        "CAST(COALESCE(SUM(total_claims), 0) AS BIGINT) AS total_claims, "
        f"CAST(COALESCE(SUM(CAST(total_paid AS DECIMAL(38, 2))), 0) AS DOUBLE) AS total_paid FROM ({CATEGORY_ALL}) c"
    ),
    "kpi_directory": (
        "SELECT COUNT(*) AS providers, CAST(COALESCE(SUM(total_hiv_claims), 0) AS BIGINT) AS total_hiv_claims, "
        "CAST(COALESCE(SUM(total_beneficiaries), 0) AS BIGINT) AS total_beneficiaries, "
        f"CAST(COALESCE(SUM(total_paid), 0) AS DOUBLE) AS total_paid FROM ({SERVICING_DIR}) d"
    ),
    "directory_search_count": (
        f"SELECT COUNT(*) AS rows_shown FROM ({SERVICING_DIR}) d WHERE {POST_CATEGORY} AND {SEARCH_MATCH}"
    ),
    "facet_states": "SELECT DISTINCT practice_state AS state FROM claims WHERE practice_state IS NOT NULL",
    "facet_years": "SELECT DISTINCT LEFT(month, 4) AS year FROM claims WHERE month IS NOT NULL",
    "facet_categories": "SELECT DISTINCT category FROM code_reference WHERE category IS NOT NULL",
    "facet_codes": REFERENCE + f" WHERE category = {CATEGORY}",
    "facet_served_categories": (
        "SELECT DISTINCT unnest(string_split(categories_served, ', ')) AS category FROM ("
        + directory("billing", _where(states=True, years=True))
        + ") d WHERE categories_served IS NOT NULL"
    ),
    "trend_category_pivot": PIVOT,
    "series_claims": f"SELECT month, total_claims FROM ({MONTHLY_ALL}) m",
    "series_providers": f"SELECT month, providers FROM ({MONTHLY_ALL}) m",
    "series_beneficiaries": f"SELECT month, total_beneficiaries FROM ({MONTHLY_ALL}) m",
    "prep_monthly_rollup": (
        "SELECT billing_npi, servicing_npi, code, month, total_claims, total_unique_beneficiaries, "
        "CAST(total_paid AS DOUBLE) AS total_paid FROM claims_monthly"
    ),
    "prep_suppress": (
        "SELECT billing_npi, servicing_npi, code, month, total_claims, total_unique_beneficiaries, "
        "CAST(total_paid AS DOUBLE) AS total_paid FROM claims_monthly WHERE total_claims >= 12"
    ),
    "prep_keyword_codes": KEYWORD_CODES,
    "prep_crosswalk": CROSSWALK,
    **_views(),
    "materialize_service_category": CATEGORY_ALL,
    "materialize_service_code": by_ref(CODE_DETAIL, "1, 2, 3", _where()),
    "materialize_trend_monthly": MONTHLY_ALL,
    "trend_yearly_state": by_ref("LEFT(t.month, 4) AS year, " + _m4(), "1", _where(states=True)),
    "trend_category_state": CATEGORY_TREND.replace("NOT NULL GROUP", f"NOT NULL AND t.practice_state IN {STATES} GROUP"),
    "service_category_state_filtered": by_ref(
        "h.category, t.practice_state AS state, " + _m4(), "1, 2", _where(states=True, years=True)
    ),
    "state_overview_fact": OVERVIEW_ALL,
    "service_category_fact": CATEGORY_ALL,
    "service_category_state_fact": by_ref("h.category, t.practice_state AS state, " + _m4(), "1, 2", _where()),
    "service_code_fact": by_ref(CODE_DETAIL, "1, 2, 3", _where()),
    "trend_monthly_fact": MONTHLY_ALL,
    "trend_yearly_fact": by_ref("LEFT(t.month, 4) AS year, " + _m4(), "1", _where()),
    "trend_category_fact": CATEGORY_TREND,
    "series_state_claims": f"SELECT state, total_claims FROM ({OVERVIEW_ALL}) o",
    "series_category_claims": f"SELECT category, total_claims FROM ({CATEGORY_ALL}) c",
    "series_category_codes": (
        "SELECT category, COUNT(*) AS code_count FROM code_reference WHERE category IS NOT NULL GROUP BY 1"
    ),
    "reference_shown_count": f"SELECT COUNT(*) AS rows_shown FROM code_reference WHERE category = {CATEGORY}",
    "stream_publication": f"SELECT {CLAIM_COLS} FROM claims WHERE total_claims >= 12",
    "stream_provider_summary": (
        "SELECT billing_npi, code, practice_state, CAST(SUM(total_claims) AS BIGINT) AS total_claims, "
        "CAST(SUM(total_unique_beneficiaries) AS BIGINT) AS total_unique_beneficiaries, "
        "CAST(SUM(total_paid) AS DOUBLE) AS total_paid, claim_year FROM claims WHERE total_claims >= 12 GROUP BY ALL"
    ),
}

# Other plans for the same questions.
for _plain, _other in (
    ("prep_monthly_rollup", "prep_monthly_rollup_stream"),
    ("state_overview_fact", "state_overview_bitmap"),
    ("service_category_fact", "service_category_bitmap"),
    ("service_category_state_fact", "service_category_state_bitmap"),
    ("service_code_fact", "service_code_bitmap"),
    ("trend_monthly_fact", "trend_monthly_bitmap"),
    ("trend_yearly_fact", "trend_yearly_bitmap"),
    ("directory_billing_all", "directory_billing_bucketed"),
    ("directory_servicing_all", "directory_servicing_bucketed"),
    ("directory_combined_all", "directory_combined_bucketed"),
    ("prep_crosswalk", "prep_crosswalk_table"),
    ("directory_billing_all_search", "directory_billing_indexed_search"),
    ("directory_servicing_all_search", "directory_servicing_indexed_search"),
    ("directory_combined_all_search", "directory_combined_indexed_search"),
):
    _BODY[_other] = _BODY[_plain]

ORACLE_SQL = {name: MODEL + body for name, body in _BODY.items()}
