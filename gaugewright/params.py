"""Every threshold of the rules, as one frozen set of parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

LEVEL, BATTERY, RAIN, DISCHARGE = "0001", "0002", "0006", "0007"


@dataclass(frozen=True)
class Params:
    # Thresholds and sensor codes that results depend on.
    level: str = LEVEL
    battery: str = BATTERY
    rain: str = RAIN
    discharge: str = DISCHARGE
    #: sensor -> lower bound, upper bound, whether values outside are replaced
    limits: dict = field(default_factory=lambda: {LEVEL: (0.0, 2000.0, False), RAIN: (0.0, 25.0, True), DISCHARGE: (0.0, 3000.0, False)})
    battery_nominal: float = 12.0
    battery_alert: float = 11.0
    battery_no_return: float = 8.0
    battery_overcharge: float = 15.0
    flatline_part_h: float = 6.0
    flatline_long_h: float = 72.0
    silence_h: float = 6.0
    state_silence_h: float = 48.0
    drift_per_day: float = 0.05
    drift_window_days: int = 7
    drift_min_rows: int = 10
    drift_min_days: float = 2.0
    drift_urgent_days: float = 14.0
    recharge_level: float = 12.5
    recharge_share: float = 0.10
    recharge_min_rows: int = 50
    outlier_k: float = 6.0
    outlier_min_rows: int = 100
    mad_scale: float = 1.4826
    trend_r2: float = 0.7
    trend_min_rows: int = 30
    trend_min_days: float = 4.0
    trend_min_history: int = 200
    shift_p: float = 0.01
    shift_min_days: int = 60
    shift_margin_days: int = 15
    history_days: int = 120
    history_min_rows: int = 3
    response_rain_mm: float = 10.0
    response_rain_h: int = 24
    response_h: int = 36
    response_rise: float = 3.0
    response_drought_days: int = 20
    already_high: float = 1.5
    neighbours: int = 8
    neighbour_km: float = 80.0
    neighbour_alt_m: float = 300.0
    neighbour_min: int = 3
    wet_mm: float = 3.0
    expected_mm: float = 4.0
    expected_severe_mm: float = 15.0
    full_day_rows: int = 24
    wave_slow_kmh: float = 2.0
    wave_fast_kmh: float = 10.0
    wave_margin_h: float = 2.0
    flood_k: float = 6.0
    flood_rise_up: float = 10.0
    flood_rise_down: float = 5.0
    flood_share: float = 0.1
    recession_per_h: float = -0.5
    flood_min_rows: int = 100
    flood_coverage: float = 0.5
    flood_max_km: float = 100.0
    max_filled_steps: int = 4
    recovery_h: float = 24.0


DEFAULTS = Params()
