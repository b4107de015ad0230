"""

``entry(spark)`` runs the flagship report (billing-provider directory) on
sf0.001. ``queries()`` maps every implemented operator to a callable
``(spark, sf_dir) -> DataFrame``; ``oracle_sql()`` gives, for the same keys,
DuckDB SQL over the raw test tables that must return the same rows.

The claims model is derived from the test tables (see
``claimscope.sources.testtables``) and written once per source version as a
partitioned warehouse under ``spark.checkpoint.dir``; the reports read it.
Money is DECIMAL inside the engine and cast to DOUBLE only in the final
projection here, where both engines must agree on the schema.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

# Importable when loaded by file path from another working directory.
_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.functions import scalars
from claimscope.operators import facets, joins, refine, reshape
from claimscope.operators import filters as flt
from claimscope.operators.filters import ClaimsFilter
from claimscope.plans import bitmaps, kpis, prep, reports
from claimscope.plans import directory as dirs
from claimscope.session import settings
from claimscope.sinks import csv as csv_sink
from claimscope.sinks import tables as table_sink
from claimscope.sinks import text_index
from claimscope.sources import catalog, schemas, storage, testtables
from claimscope.sources.loaders import load_claims
from claimscope.sources.warehouse import derived, drop_folder, open_test_tables, scratch_root, source_fingerprint
from claimscope.streaming import publish, rollup

SF_SMOKE = "/root/testdata/sf0.001"

# Fixed arguments of the registered queries.
STATES = ("NATION_12", "NATION_15")
YEARS = ("1998", "1999")
CATEGORY = "Outreach"
CODES = ("Brand#3", "Brand#10")
OTHER_CATEGORY = "Treatment"
SEARCH = "machinery"
VIEW_SEARCH = "city_1"
KEYWORDS = ("gear", "WIDGET", "promo")
CROSSWALK_RULES = (
    (("gear",), "Treatment"),
    (("widget", "gizmo"), "Outreach"),
    (("promo",), "Support"),
)
CROSSWALK_DEFAULT = "Unassigned"

NO_FILTER = ClaimsFilter()
STATE_YEAR = ClaimsFilter(states=STATES, years=YEARS)
STATE_YEAR_CATEGORY = ClaimsFilter(states=STATES, years=YEARS, category=CATEGORY)
STATE_YEAR_CODES = ClaimsFilter(states=STATES, years=YEARS, codes=CODES)
CASCADE = ClaimsFilter(category=OTHER_CATEGORY, codes=CODES)
# Every state of the test registry.
EVERY_STATE = ClaimsFilter(states=tuple(f"NATION_{n}" for n in range(25)))


def _out(df: DataFrame) -> DataFrame:
    """Final projection: DECIMAL money -> DOUBLE (engines differ in decimal width)."""
    cols = [
        F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    return df.select(*cols)


def _tables(spark: SparkSession, sf: str):
    return open_test_tables(spark, sf)


def _export_dir(spark: SparkSession, sf: str, name: str) -> str:
    return f"{scratch_root(spark)}/claimscope/exports/{source_fingerprint(spark, sf)}/{name}"


# Columns of the provider summary; reports reading only these use it.
SUMMARY_COLS = ("billing_npi", "code", "practice_state", "claim_year")


def _grain(t):
    """Provider summary if built, else the fact (reports without month/servicing)."""
    return t.claims_for(*SUMMARY_COLS)


def _month_grain(t):
    """Monthly provider summary if built (an option), else the fact."""
    return t.claims_for(*SUMMARY_COLS, "month")


def _servicing_dir(spark: SparkSession, sf: str) -> DataFrame:
    t = _tables(spark, sf)
    return dirs.directory(t.claims, t.reference, t.registry, STATE_YEAR, "servicing")


# ---------------------------------------------------------------- queries


def _q_scan_claims(spark, sf):
    return _out(_tables(spark, sf).claims)


def _q_code_reference(spark, sf):
    return reports.code_reference(_tables(spark, sf).reference)


def _q_scan_registry(spark, sf):
    return _tables(spark, sf).registry


def _q_export_reference(spark, sf):
    ref = reports.code_reference(_tables(spark, sf).reference)
    return csv_sink.export(ref, _export_dir(spark, sf, "hcpcs_reference"), single_file=True)


def _q_export_state_summary(spark, sf):
    t = _tables(spark, sf)
    df = reports.state_overview(_grain(t), STATE_YEAR)
    return _out(csv_sink.export(df, _export_dir(spark, sf, "state_summary"), single_file=True))


def _q_export_services(spark, sf):
    t = _tables(spark, sf)
    df = reports.code_detail(_grain(t), t.reference, STATE_YEAR)
    return _out(csv_sink.export(df, _export_dir(spark, sf, "services"), single_file=True))


def _q_export_directory(spark, sf):
    shown = refine.refine(_servicing_dir(spark, sf), CATEGORY, SEARCH)
    return _out(csv_sink.export(shown, _export_dir(spark, sf, "directory")))


def _q_export_trends(spark, sf):
    t = _tables(spark, sf)
    df = reports.monthly(_month_grain(t), t.reference, STATE_YEAR)
    return _out(csv_sink.export(df, _export_dir(spark, sf, "trends"), single_file=True))


def _materialized(name, report, *args):
    """A written report table: the first call writes it, later ones read it."""

    def run(spark, sf):
        t = _tables(spark, sf)
        key = f"{source_fingerprint(spark, sf)}|{args}"
        return _out(table_sink.reuse(name, report(t, *args), f"{scratch_root(spark)}/claimscope/reports", key))

    return run


def _q_filter_known_state(spark, sf):
    return _out(flt.known_state(_tables(spark, sf).claims))


def _q_filter_state(spark, sf):
    return _out(flt.by_states(_tables(spark, sf).claims, STATES))


def _q_filter_year(spark, sf):
    return _out(flt.by_years(_tables(spark, sf).claims, YEARS))


def _q_filter_code(spark, sf):
    return _out(flt.by_codes(_tables(spark, sf).claims, CODES))


def _q_filter_category(spark, sf):
    t = _tables(spark, sf)
    return _out(flt.by_category(t.claims, t.reference, CATEGORY))


def _q_filter_cascade(spark, sf):
    t = _tables(spark, sf)
    return _out(reports.service_base(t.claims, t.reference, CASCADE))


def _q_trend_monthly_state(spark, sf):
    t = _tables(spark, sf)
    return _out(reports.monthly(_month_grain(t), t.reference, STATE_YEAR))


def _q_directory_post_category(spark, sf):
    return _out(refine.post_category(_servicing_dir(spark, sf), CATEGORY))


def _q_directory_search(spark, sf):
    return _out(refine.search(_servicing_dir(spark, sf), SEARCH))


def _q_reference_by_category(spark, sf):
    return reports.reference_by_category(_tables(spark, sf).reference, CATEGORY)


def _q_scalar_year(spark, sf):
    c = _tables(spark, sf).claims
    return c.select("month", scalars.year_of("month").alias("year"))


def _q_scalar_billing_name(spark, sf):
    r = _tables(spark, sf).registry
    return r.select("npi", scalars.billing_name().alias("billing_name"))


def _q_scalar_servicing_name(spark, sf):
    t = _tables(spark, sf)
    npis = t.claims.select(F.col("servicing_npi").alias("npi")).distinct()
    named = npis.join(t.registry, "npi", "left")
    return named.select("npi", scalars.servicing_name().alias("servicing_name"))


def _q_code_labels(spark, sf):
    return reshape.code_labels(facets.codes(_tables(spark, sf).reference, CATEGORY))


def _q_code_labels_parse(spark, sf):
    labels = reshape.code_labels(facets.codes(_tables(spark, sf).reference))
    return reshape.parse_labels(labels)


def _q_join_reference(spark, sf):
    t = _tables(spark, sf)
    return _out(joins.with_reference(t.claims, t.reference))


def _q_join_billing(spark, sf):
    t = _tables(spark, sf)
    return _out(joins.with_billing(joins.with_reference(t.claims, t.reference), t.registry))


def _q_join_servicing(spark, sf):
    t = _tables(spark, sf)
    return _out(joins.with_servicing(joins.with_reference(t.claims, t.reference), t.registry))


def _q_join_both(spark, sf):
    t = _tables(spark, sf)
    return _out(joins.with_both(joins.with_reference(t.claims, t.reference), t.registry))


def _q_enrich_claims(spark, sf):
    monthly = testtables.claims_monthly(spark, sf)
    return _out(prep.enrich_claims(monthly, testtables.registry(spark, sf)))


def _q_state_overview(spark, sf):
    return _out(reports.state_overview(_grain(_tables(spark, sf))))


def _q_state_overview_filtered(spark, sf):
    return _out(reports.state_overview(_grain(_tables(spark, sf)), STATE_YEAR))


def _q_service_category(spark, sf):
    t = _tables(spark, sf)
    return _out(reports.category_summary(_grain(t), t.reference))


def _q_service_category_filtered(spark, sf):
    t = _tables(spark, sf)
    return _out(reports.category_summary(_grain(t), t.reference, STATE_YEAR))


def _q_service_category_state(spark, sf):
    t = _tables(spark, sf)
    return _out(reports.category_state(_grain(t), t.reference))


def _q_service_code(spark, sf):
    t = _tables(spark, sf)
    return _out(reports.code_detail(_grain(t), t.reference))


def _q_service_code_filtered(spark, sf):
    t = _tables(spark, sf)
    return _out(reports.code_detail(_grain(t), t.reference, STATE_YEAR_CATEGORY))


def _directory_query(view):
    def run(spark, sf):
        t = _tables(spark, sf)
        # The billing view needs no servicing NPI or month: provider summary.
        claims = _grain(t) if view == "billing" else t.claims
        return _out(dirs.directory(claims, t.reference, t.registry, STATE_YEAR, view))

    return run


def _q_trend_monthly(spark, sf):
    t = _tables(spark, sf)
    return _out(reports.monthly(_month_grain(t), t.reference))


def _q_trend_yearly(spark, sf):
    t = _tables(spark, sf)
    return _out(reports.yearly(_grain(t), t.reference))


def _q_trend_category(spark, sf):
    t = _tables(spark, sf)
    return reports.category_trend(_month_grain(t), t.reference)


def _q_reference_category_counts(spark, sf):
    return reports.category_counts(_tables(spark, sf).reference)


def _q_kpi_reference(spark, sf):
    return kpis.reference_kpis(_tables(spark, sf).reference)


def _q_kpi_overview(spark, sf):
    return _out(kpis.overview_kpis(reports.state_overview(_grain(_tables(spark, sf)))))


def _q_kpi_services(spark, sf):
    t = _tables(spark, sf)
    return _out(kpis.services_kpis(reports.category_summary(_grain(t), t.reference)))


def _q_kpi_directory(spark, sf):
    return _out(kpis.directory_kpis(_servicing_dir(spark, sf)))


def _q_directory_search_count(spark, sf):
    return kpis.shown_rows(refine.refine(_servicing_dir(spark, sf), CATEGORY, SEARCH))


def _q_facet_states(spark, sf):
    return facets.states(_grain(_tables(spark, sf)))


def _q_facet_years(spark, sf):
    return facets.years(_grain(_tables(spark, sf)))


def _q_facet_categories(spark, sf):
    return facets.categories(_tables(spark, sf).reference)


def _q_facet_codes(spark, sf):
    return facets.codes(_tables(spark, sf).reference, CATEGORY)


def _q_facet_served_categories(spark, sf):
    t = _tables(spark, sf)
    d = dirs.directory(_grain(t), t.reference, t.registry, STATE_YEAR, "billing")
    return facets.served_categories(d)


def _q_trend_category_pivot(spark, sf):
    t = _tables(spark, sf)
    root, key = f"{scratch_root(spark)}/claimscope/reports", f"{source_fingerprint(spark, sf)}|{NO_FILTER}"
    long = table_sink.reuse("trend_category", reports.category_trend(_month_grain(t), t.reference), root, key)
    return reshape.pivot_wide(long)


def _series_query(measure):
    def run(spark, sf):
        t = _tables(spark, sf)
        return _out(reshape.series(reports.monthly(_month_grain(t), t.reference), "month", measure))

    return run


def _q_prep_monthly_rollup(spark, sf):
    return _out(testtables.claims_monthly(spark, sf))


def _q_prep_suppress(spark, sf):
    return _out(prep.suppress(testtables.claims_monthly(spark, sf)))


def _q_prep_keyword_codes(spark, sf):
    return prep.keyword_codes(testtables.code_file(spark, sf), KEYWORDS)


def _q_prep_crosswalk(spark, sf):
    codes = prep.keyword_codes(testtables.code_file(spark, sf), KEYWORDS)
    return prep.crosswalk(codes, CROSSWALK_RULES, default=CROSSWALK_DEFAULT)


def _q_prep_crosswalk_table(spark, sf):
    """The same rules as rows of a table."""
    codes = prep.keyword_codes(testtables.code_file(spark, sf), KEYWORDS)
    rows = [(k, word, category) for k, (words, category) in enumerate(CROSSWALK_RULES) for word in words]
    rules = spark.createDataFrame(rows, "rule long, keyword string, category string")
    return prep.crosswalk_table(codes, rules, default=CROSSWALK_DEFAULT)


def _indexed_search(view):
    """Free-text search in the written directory of every state through its n-gram index."""

    def run(spark, sf):
        t = _tables(spark, sf)
        rows = dirs.directory(t.claims, t.reference, t.registry, EVERY_STATE, view)
        home = f"{scratch_root(spark)}/claimscope/search/{source_fingerprint(spark, sf)}/{view}"
        order = ("state", "city", rows.columns[0])
        folder = derived(spark, home, lambda to: text_index.write_indexed(rows, to, order))
        return _out(text_index.search_indexed(spark, folder, rows.schema, VIEW_SEARCH))

    return run


def _q_stream_publication(spark, sf):
    """A batch-written fact up to 1996; the stream publishes later months and one of 1996 again."""
    home = f"{scratch_root(spark)}/claimscope/streams/{source_fingerprint(spark, sf)}"
    drop_folder(spark, home)  # earlier runs
    run = f"{home}/{uuid.uuid4().hex[:12]}"
    t = _tables(spark, sf)
    early = F.coalesce(F.col("claim_year") <= "1996", F.lit(False))
    prep.write_claims(prep.suppress(t.claims.where(early)), f"{run}/fact")
    late = t.claims.where(~early | (F.col("month") == "1996-07"))
    late.select(*schemas.CLAIMS_MONTHLY.fieldNames()).write.parquet(f"{run}/landing")
    q = publish.start_publication(spark, f"{run}/landing", t.registry, f"{run}/published", f"{run}/checkpoint")
    q.awaitTermination()
    return _out(publish.load_published(spark, f"{run}/published", load_claims(spark, f"{run}/fact")))


def _q_stream_summary(spark, sf):
    """The provider summary that a stream keeps: the fact up to 1996 is batch-written, later months come in
    two micro-batches of one release, then one month in a second release."""
    home = f"{scratch_root(spark)}/claimscope/summary-streams/{source_fingerprint(spark, sf)}"
    drop_folder(spark, home)  # earlier runs
    run = f"{home}/{uuid.uuid4().hex[:12]}"
    t = _tables(spark, sf)
    early = F.coalesce(F.col("claim_year") <= "1996", F.lit(False))
    prep.write_claims(prep.suppress(t.claims.where(early)), f"{run}/fact")
    fact = load_claims(spark, f"{run}/fact")
    monthly = t.claims.select(*schemas.CLAIMS_MONTHLY.fieldNames(), early.alias("early"))
    late, half = monthly.where(~F.col("early")).drop("early"), F.pmod(F.xxhash64("billing_npi"), F.lit(2)) == 0
    again = monthly.where(F.col("month") == "1996-07").drop("early")
    for release, part in ((1, late.where(half)), (1, late.where(~half)), (2, again)):
        part.write.mode("append").parquet(f"{run}/landing/release={release}")
        publish.start_publication(
            spark, f"{run}/landing", t.registry, f"{run}/published", f"{run}/checkpoint", fact=fact, releases=True
        ).awaitTermination()
    return _out(publish.load_summary(spark, f"{run}/published", prep.provider_summary(fact)))


def _q_stream_rollup(spark, sf):
    """Raw claim lines in three arrivals, late and repeated ones included, rolled up by the stateful stream."""
    home = f"{scratch_root(spark)}/claimscope/rollups/{source_fingerprint(spark, sf)}"
    drop_folder(spark, home)  # earlier runs
    run = f"{home}/{uuid.uuid4().hex[:12]}"
    with settings(spark, {rollup.DROP_SHUFFLED: "true", "spark.sql.maxConcurrentOutputFileWriters": "3"}):
        # Joined and written once, not for every arrival; no sort to tell the arrivals apart.
        dealt = testtables.in_arrivals(testtables.landed_lines(spark, sf)).write.partitionBy("arrival")
        dealt.option("compression", "zstd").parquet(f"{run}/lines")
    dealt_lines = T.StructType([*rollup.LANDED_LINES.fields, T.StructField("arrival", T.IntegerType())])
    arrivals, dropped = testtables.arrivals(spark.read.schema(dealt_lines).parquet(f"{run}/lines")), 0
    for k in range(len(arrivals)):  # each is the files of one folder
        storage.move_files(spark, f"{run}/lines/arrival={k}", f"{run}/landing", f"{k}-")
        q = rollup.start_rollup(spark, f"{run}/landing", f"{run}/rolled", f"{run}/checkpoint", lateness=2, count_state=False)
        q.awaitTermination()
        dropped += rollup.dropped_late(q)
    drop_folder(spark, f"{run}/checkpoint")  # nothing lands any more
    if dropped:
        with settings(spark, {rollup.DROP_SHUFFLED: "true"}):
            rollup.reconcile(spark, f"{run}/landing", f"{run}/rolled")
    return _out(rollup.load_rollup(spark, f"{run}/landing", f"{run}/rolled"))


def _cells(spark, sf):
    """Provider bitmaps per code, state and month, written once per source version."""
    t = _tables(spark, sf)
    home = f"{scratch_root(spark)}/claimscope/bitmaps/{source_fingerprint(spark, sf)}"
    write = lambda folder: bitmaps.write_cells(bitmaps.provider_cells(t.claims, bitmaps.provider_numbers(t.claims)), folder)
    return t, bitmaps.load_cells(spark, derived(spark, home, write))


def _on_cells(report, *args):
    """A report computed from the bitmaps instead of the fact or a provider summary."""

    def run(spark, sf):
        t, cells = _cells(spark, sf)
        inputs = (cells,) if report is bitmaps.state_overview else (cells, t.reference)
        return _out(report(*inputs, *args))

    return run


def _bucketed_directory(view):
    """A directory over every state from the bucketed tables."""

    def run(spark, sf):
        t, version = _tables(spark, sf), source_fingerprint(spark, sf)
        opened = {}
        for name in catalog.tables_of(view):
            home = f"{scratch_root(spark)}/claimscope/catalog/{version}/{name}"
            folder = derived(spark, home, lambda to, name=name: catalog.write_table(t, name, f"{to}/{name}"))
            key, schema = catalog.TABLES[name]
            opened[name] = catalog.register(spark, f"claimscope_{name}_{folder[-12:]}", f"{folder}/{name}", key, schema)
        tables = catalog.Bucketed(**opened)
        return _out(dirs.directory(tables.claims_for(view, t.claims), t.reference, tables.registry, EVERY_STATE, view))

    return run


def _directory(view, filt, then=lambda d: d):
    """A directory over the fact, and what follows from it."""

    def run(spark, sf):
        t = _tables(spark, sf)
        return _out(then(dirs.directory(t.claims, t.reference, t.registry, filt, view)))

    return run


def _on_fact(report, *args):
    """A report computed from the fact itself instead of a summary."""

    def run(spark, sf):
        t = _tables(spark, sf)
        inputs = (t.claims,) if report is reports.state_overview else (t.claims, t.reference)
        return _out(report(*inputs, *args))

    return run


def _q_series_state_claims(spark, sf):
    t = _tables(spark, sf)
    return _out(reshape.series(reports.state_overview(_grain(t)), "state", "total_claims"))


def _q_series_category_claims(spark, sf):
    t = _tables(spark, sf)
    return _out(reshape.series(reports.category_summary(_grain(t), t.reference), "category", "total_claims"))


def _q_series_category_codes(spark, sf):
    return reshape.series(reports.category_counts(_tables(spark, sf).reference), "category", "code_count")


def _q_reference_shown_count(spark, sf):
    return kpis.shown_rows(reports.reference_by_category(_tables(spark, sf).reference, CATEGORY))


def _view_queries():
    """What the directory page shows below each view, over every state."""
    out = {}
    for view in dirs.VIEWS:
        out[f"directory_{view}_all"] = _directory(view, EVERY_STATE)
        out[f"directory_{view}_category"] = _directory(view, STATE_YEAR_CATEGORY)
        out[f"directory_{view}_codes"] = _directory(view, STATE_YEAR_CODES)
        out[f"directory_{view}_all_post_category"] = _directory(view, EVERY_STATE, lambda d: refine.post_category(d, CATEGORY))
        out[f"directory_{view}_all_search"] = _directory(view, EVERY_STATE, lambda d: refine.search(d, VIEW_SEARCH))
        out[f"directory_{view}_all_count"] = _directory(view, EVERY_STATE, lambda d: kpis.shown_rows(refine.refine(d, CATEGORY, VIEW_SEARCH)))
        out[f"kpi_directory_{view}_all"] = _directory(view, EVERY_STATE, kpis.directory_kpis)
    return out


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_claims": _q_scan_claims,
    "code_reference": _q_code_reference,
    "scan_registry": _q_scan_registry,
    "export_reference": _q_export_reference,
    "export_state_summary": _q_export_state_summary,
    "export_services": _q_export_services,
    "export_directory": _q_export_directory,
    "export_trends": _q_export_trends,
    "materialize_reports": _materialized("state_overview", lambda t, f: reports.state_overview(_grain(t), f), NO_FILTER),
    "materialize_service_category": _materialized(
        "service_category", lambda t, f: reports.category_summary(_grain(t), t.reference, f), NO_FILTER
    ),
    "materialize_service_code": _materialized("service_code", lambda t, f: reports.code_detail(_grain(t), t.reference, f), NO_FILTER),
    "materialize_trend_monthly": _materialized(
        "trend_monthly", lambda t, f: reports.monthly(_month_grain(t), t.reference, f), NO_FILTER
    ),
    "filter_known_state": _q_filter_known_state,
    "filter_state": _q_filter_state,
    "filter_year": _q_filter_year,
    "filter_code": _q_filter_code,
    "filter_category": _q_filter_category,
    "filter_cascade": _q_filter_cascade,
    "trend_monthly_state": _q_trend_monthly_state,
    "directory_post_category": _q_directory_post_category,
    "directory_search": _q_directory_search,
    "reference_by_category": _q_reference_by_category,
    "scalar_year": _q_scalar_year,
    "scalar_billing_name": _q_scalar_billing_name,
    "scalar_servicing_name": _q_scalar_servicing_name,
    "code_labels": _q_code_labels,
    "code_labels_parse": _q_code_labels_parse,
    "join_reference": _q_join_reference,
    "join_billing": _q_join_billing,
    "join_servicing": _q_join_servicing,
    "join_both": _q_join_both,
    "enrich_claims": _q_enrich_claims,
    "state_overview": _q_state_overview,
    "state_overview_filtered": _q_state_overview_filtered,
    "service_category": _q_service_category,
    "service_category_filtered": _q_service_category_filtered,
    "service_category_state": _q_service_category_state,
    "service_code": _q_service_code,
    "service_code_filtered": _q_service_code_filtered,
    "directory_billing": _directory_query("billing"),
    "directory_servicing": _directory_query("servicing"),
    "directory_combined": _directory_query("combined"),
    "trend_monthly": _q_trend_monthly,
    "trend_yearly": _q_trend_yearly,
    "trend_category": _q_trend_category,
    "reference_category_counts": _q_reference_category_counts,
    "kpi_reference": _q_kpi_reference,
    "kpi_overview": _q_kpi_overview,
    "kpi_services": _q_kpi_services,
    "kpi_directory": _q_kpi_directory,
    "directory_search_count": _q_directory_search_count,
    "facet_states": _q_facet_states,
    "facet_years": _q_facet_years,
    "facet_categories": _q_facet_categories,
    "facet_codes": _q_facet_codes,
    "facet_served_categories": _q_facet_served_categories,
    "trend_category_pivot": _q_trend_category_pivot,
    "series_claims": _series_query("total_claims"),
    "series_providers": _series_query("providers"),
    "series_beneficiaries": _series_query("total_beneficiaries"),
    "prep_monthly_rollup": _q_prep_monthly_rollup,
    "prep_suppress": _q_prep_suppress,
    "prep_keyword_codes": _q_prep_keyword_codes,
    "prep_crosswalk": _q_prep_crosswalk,
    "stream_publication": _q_stream_publication,
    **_view_queries(),
    "trend_yearly_state": _on_fact(reports.yearly, STATE_YEAR),
    "trend_category_state": _on_fact(reports.category_trend, STATE_YEAR),
    "service_category_state_filtered": _on_fact(reports.category_state, STATE_YEAR),
    "state_overview_fact": _on_fact(reports.state_overview),
    "service_category_fact": _on_fact(reports.category_summary),
    "service_category_state_fact": _on_fact(reports.category_state),
    "service_code_fact": _on_fact(reports.code_detail),
    "trend_monthly_fact": _on_fact(reports.monthly),
    "trend_yearly_fact": _on_fact(reports.yearly),
    "trend_category_fact": _on_fact(reports.category_trend),
    "series_state_claims": _q_series_state_claims,
    "series_category_claims": _q_series_category_claims,
    "series_category_codes": _q_series_category_codes,
    "reference_shown_count": _q_reference_shown_count,
    "prep_monthly_rollup_stream": _q_stream_rollup,
    "stream_provider_summary": _q_stream_summary,
    "prep_crosswalk_table": _q_prep_crosswalk_table,
    **{f"directory_{view}_indexed_search": _indexed_search(view) for view in dirs.VIEWS},
    "state_overview_bitmap": _on_cells(bitmaps.state_overview),
    "service_category_bitmap": _on_cells(bitmaps.category_summary),
    "service_category_state_bitmap": _on_cells(bitmaps.category_state),
    "service_code_bitmap": _on_cells(bitmaps.code_detail),
    "trend_monthly_bitmap": _on_cells(bitmaps.monthly),
    "trend_yearly_bitmap": _on_cells(bitmaps.yearly),
    **{f"directory_{view}_bucketed": _bucketed_directory(view) for view in dirs.VIEWS},
}


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: billing-provider directory for two states and two years, sf0.001."""
    return _QUERIES["directory_billing"](spark, SF_SMOKE)


try:  # the training-data operators are an optional part
    from claimscope.llm import queries as _llm
except ImportError:
    _llm = None


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**_QUERIES, **(_llm.queries() if _llm else {})}


def oracle_sql() -> dict[str, str]:
    from duckdb_oracle import ORACLE_SQL

    return {**ORACLE_SQL, **(_llm.oracle_sql() if _llm else {})}
