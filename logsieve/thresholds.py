"""All limits of the detectors, in one place; tests scale them down."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    # The default limits.
    # paths
    crawl_requests: int = 1000
    crawl_ips: int = 20
    crawl_variants: int = 100
    crawl_variant_ratio: float = 0.2
    crawl_repeated_ips: int = 10
    repeated_ip_requests: int = 5
    crawl_repeated_share: float = 0.45
    saturation_requests: int = 10_000
    saturation_variants: int = 1000
    saturation_variant_ratio: float = 0.5
    saturation_repeated_ips: int = 20
    saturation_repeated_share: float = 0.8
    strong_requests: int = 1000
    strong_variant_ratio: float = 0.75
    strong_repeated_ips: int = 30
    peak_served: int = 120
    large_churn_requests: int = 20_000
    large_churn_peak_served: int = 60
    sustained_query_requests: int = 5000
    sustained_query_variants: int = 1000
    sustained_query_ratio: float = 0.5
    sustained_query_ips: int = 200
    sustained_query_peak: int = 50
    sustained_repeat_requests: int = 5000
    sustained_repeat_ips: int = 10
    sustained_repeat_share: float = 0.75
    sustained_repeat_peak: int = 20
    blocked_ratio: int = 5
    blocked_query_requests: int = 2500
    blocked_query_served: int = 100
    blocked_query_peak: int = 120
    distress_5xx: int = 100
    post_requests: int = 200
    explosion_requests: int = 500
    explosion_variants: int = 150
    explosion_ratio: float = 0.5
    # clients
    burst_rps: int = 50
    burst_seconds: int = 3
    spike_rps: int = 100
    spike_times_p95: int = 5
    spike_seconds: int = 10
    storm_4xx: int = 200
    storm_5xx: int = 200
    fake_bot_requests: int = 10
    ai_medium_requests: int = 500
    ai_minute_paths: int = 10
    ai_high_minutes: int = 3
    ai_peak_served: int = 120
    ai_5xx: int = 100
    fingerprint_paths: int = 20
    many_paths: int = 500
    many_paths_per_minute: float = 10
    many_agents: int = 8
    many_agents_requests: int = 100
    many_agents_peak: int = 5
    head_requests: int = 500
    head_ratio: float = 0.7
    head_peak: int = 25
    subnet_rps: int = 200
    subnet_ips: int = 10
    subnet_seconds: int = 5
    # counts of distinct values stop here
    cap_paths: int = 501
    cap_agents: int = 9
    cap_bot_paths: int = 1001
    cap_bot_ips: int = 5001
    cap_subnet_ips: int = 5001
    top_ips: int = 100
    late_seconds: int = 60
    #: a frame of so many addresses at most is broadcast
    broadcast_ips: int = 500_000


DEFAULT = Thresholds()
