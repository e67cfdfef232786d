"""Label -> query function over the materialised core (``dict[str, DataFrame]``)."""

from __future__ import annotations

from quayline.operators import checks, constraints
from quayline.streaming import snapshots
from quayline.plans import amenity, explore, frequency, hub, ingest, morning, peak, platform, profile, semantic

QUERIES = {
    "a01_annualised_departures_by_hour": peak.a01_annualised_departures_by_hour,
    "a02_naive_timetable_rows_by_hour": peak.a02_naive_timetable_rows_by_hour,
    "a03_rank_divergence": peak.a03_rank_divergence,
    "a04_peak_by_daytype": peak.a04_peak_by_daytype,
    "a05_peak_hour_headline": peak.a05_peak_hour_headline,
    "a06_platform_ranking": platform.a06_platform_ranking,
    "a07_platform_top3": platform.a07_platform_top3,
    "a08_unallocated_platform_calls": platform.a08_unallocated_platform_calls,
    "a09_platform_hourly_congestion": platform.a09_platform_hourly_congestion,
    "a10_platform_peak_pressure": platform.a10_platform_peak_pressure,
    "a11_hub_comparison": platform.a11_hub_comparison,
    "a12_morning_destinations_ranked": morning.a12_morning_destinations_ranked,
    "a13_top3_destinations": morning.a13_top3_destinations,
    "a14_morning_vs_afternoon": morning.a14_morning_vs_afternoon,
    "a15_morning_departure_profile": morning.a15_morning_departure_profile,
    "a16_morning_destinations_multilingual": morning.a16_morning_destinations_multilingual,
    "a17_calendar_flags": frequency.a17_calendar_flags,
    "a18_frequency_classification": frequency.a18_frequency_classification,
    "a19_days_per_week_distribution": frequency.a19_days_per_week_distribution,
    "a20_active_service_only": frequency.a20_active_service_only,
    "a21_trip_weighted": frequency.a21_trip_weighted,
    "a22_weekday_coverage": frequency.a22_weekday_coverage,
    "a23_definition_sensitivity": frequency.a23_definition_sensitivity,
    "a24_network_amenity_coverage": amenity.a24_network_amenity_coverage,
    "a25_amenity_by_mode": amenity.a25_amenity_by_mode,
    "a26_route_amenity_ratios": amenity.a26_route_amenity_ratios,
    "a27_worst_routes_all_sizes": amenity.a27_worst_routes_all_sizes,
    "a28_worst_routes_by_exposure": amenity.a28_worst_routes_by_exposure,
    "a29_amenity_by_route_category": amenity.a29_amenity_by_route_category,
    "a30_station_accessibility_gap": amenity.a30_station_accessibility_gap,
    "a31_hub_structural_leaderboard": hub.a31_hub_structural_leaderboard,
    "a32_hub_hourly_shape": hub.a32_hub_hourly_shape,
    "a33_hub_composite_score": hub.a33_hub_composite_score,
    "a34_realtime_coverage": hub.a34_realtime_coverage,
    "a35_hub_punctuality": hub.a35_hub_punctuality,
    "a36_punctuality_all_stations": hub.a36_punctuality_all_stations,
    "a37_delay_distribution": hub.a37_delay_distribution,
    "a38_active_service_alerts": hub.a38_active_service_alerts,
    "v01_departures": semantic.v01_departures,
    "v02_trip_service_days": semantic.v02_trip_service_days,
    "v03_trip_origin": semantic.v03_trip_origin,
    "v04_service_frequency": semantic.v04_service_frequency,
    "v05_trip_amenity": semantic.v05_trip_amenity,
    "v06_station_daily_departures": semantic.v06_station_daily_departures,
    "v07_rt_departure_performance": semantic.v07_rt_departure_performance,
    "t21_reject_counts": semantic.t21_reject_counts,
    "b01_boardable_calls_by_hour": explore.b01_boardable_calls_by_hour,
    "b02_boardable_calls_at_stop": explore.b02_boardable_calls_at_stop,
    "b03_service_days_by_weekday": explore.b03_service_days_by_weekday,
    "b04_annualised_by_hour_base_tables": explore.b04_annualised_by_hour_base_tables,
    "b05_station_platform_calls": explore.b05_station_platform_calls,
    "b06_table_sizes": explore.b06_table_sizes,
    "s03_s04_ragged_records": explore.s03_s04_ragged_records,
    "s07_feed_roundtrip": explore.s07_feed_roundtrip,
    "s08_s19_shred_roundtrip": explore.s08_s19_shred_roundtrip,
    "s11_s15_alert_shred": ingest.s11_s15_alert_shred,
    "t21_rejected_rows": ingest.t21_rejected_rows,
    "r02_replay": ingest.r02_replay,
    "r02_late_after_compaction": ingest.r02_late_after_compaction,
    "r03_latest_stream": ingest.r03_latest_stream,
    "r04_match_rate": ingest.r04_match_rate,
    "s20_rows_written": ingest.s20_rows_written,
    "r05_stream": ingest.r05_stream,
    "r05_late_rows": ingest.r05_late_rows,
    "d01_feed_provenance": explore.d01_feed_provenance,
    "d02_ingestion_runs": explore.d02_ingestion_runs,
    "d03_headline_counts": explore.d03_headline_counts,
    "d04_method_comparison": explore.d04_method_comparison,
    "d05_morning_trip_span": explore.d05_morning_trip_span,
    "d06_station_picker": explore.d06_station_picker,
    "d07_station_platform_ranking": explore.d07_station_platform_ranking,
    "d08_station_hour_platform": explore.d08_station_hour_platform,
    "d09_station_coverage": explore.d09_station_coverage,
    "d10_dq_evidence": explore.d10_dq_evidence,
    "d11_feed_characteristics": explore.d11_feed_characteristics,
    "d12_rejected_rows": explore.d12_rejected_rows,
    "d13_fk_violations": explore.d13_fk_violations,
    "d13_reference_report": explore.d13_reference_report,
    "x01_x21_integrity_checks": checks.check_table,
    "x18_x20_run_log_checks": checks.run_log_checks,
    "r05_delay_history": snapshots.delay_history,
    "t25_constraint_report": constraints.constraint_report,
}

QUERIES.update({
    name: getattr(profile, name)
    for name in sorted(dir(profile))
    if name[:1] == "p" and name[1:3].isdigit() and callable(getattr(profile, name))
})
