"""Registry of named queries: name → callable(spark, sf_dir) → DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orderpulse.plans import dashboard

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, Query]:
    return {
        "top_categories": dashboard.top_categories,
        "kpi_summary": dashboard.kpi_summary,
        "avg_order_value_page": dashboard.avg_order_value_page,
        "avg_order_value_sql": dashboard.avg_order_value_sql,
        "complete_rate": dashboard.complete_rate,
        "total_sales": dashboard.total_sales,
        "total_orders": dashboard.total_orders,
        "daily_orders": dashboard.daily_orders,
        "daily_sales": dashboard.daily_sales,
        "monthly_orders": dashboard.monthly_orders,
        "status_distribution": dashboard.status_distribution,
        "payment_distribution": dashboard.payment_distribution,
        "customer_order_distribution": dashboard.customer_order_distribution,
        "category_sales": dashboard.category_sales,
        "category_order_counts": dashboard.category_order_counts,
        **_extended(),
    }


def _extended() -> dict[str, Query]:
    from orderpulse.plans import io, layout, listing, messages, payload, streams
    return {
        "order_page": listing.order_page,
        "order_page_deep": listing.order_page_deep,
        "order_page_nulls": listing.order_page_nulls,
        "order_page_indexed": listing.order_page_indexed,
        "order_page_after": listing.order_page_after,
        "item_page": listing.item_page,
        "page_metadata": listing.page_metadata,
        "json_extract": messages.json_extract,
        "clean_categories": messages.clean_categories,
        "status_severity": messages.status_severity,
        "item_listing": messages.item_listing,
        "kpi_display": messages.kpi_display,
        "epoch_to_timestamp": messages.epoch_to_timestamp,
        "payload_routing": messages.payload_routing,
        "tombstone_routing": messages.tombstone_routing,
        "result_map": messages.result_map,
        "message_bytes": messages.message_bytes,
        "result_rows_roundtrip": messages.result_rows_roundtrip,
        "csv_header_roundtrip": io.csv_header_roundtrip,
        "csv_positional": io.csv_positional,
        "csv_quoted_roundtrip": io.csv_quoted_roundtrip,
        "ensured_table": io.ensured_table,
        "publish_json": io.publish_json,
        "csv_page_kpis": io.csv_page_kpis,
        "csv_page_top_categories": io.csv_page_top_categories,
        "csv_raw_listing": io.csv_raw_listing,
        "stream_category_counts": streams.stream_category_counts,
        "stream_paced_bytes": streams.stream_paced_bytes,
        "stream_snapshot_rows": streams.stream_snapshot_rows,
        "snapshot_reload": streams.snapshot_reload,
        "snapshot_many_parts": streams.snapshot_many_parts,
        "snapshot_reload_plain": streams.snapshot_reload_plain,
        "snapshot_reload_late": streams.snapshot_reload_late,
        "snapshot_reload_empty": streams.snapshot_reload_empty,
        "topic_start_policies": streams.topic_start_policies,
        "stream_reseeded_counts": streams.stream_reseeded_counts,
        "stream_restart_counts": streams.stream_restart_counts,
        "append_results": streams.append_results,
        "append_from_envelopes": streams.append_from_envelopes,
        "append_from_array": streams.append_from_array,
        "append_compacted": streams.append_compacted,
        "keyed_growth": streams.keyed_growth,
        "quarantine": streams.quarantine,
        "upsert_latest": streams.upsert_latest,
        "stream_dashboard_kpis": streams.stream_dashboard_kpis,
        "stream_dashboard_payload": streams.stream_dashboard_payload,
        "stream_dashboard_top_categories": streams.stream_dashboard_top_categories,
        "dashboard_payload": payload.dashboard_payload,
        "dashboard_payload_rows": payload.dashboard_payload_rows,
        "layout_kpis": layout.layout_kpis,
    }
