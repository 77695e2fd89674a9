"""Parameters of the site-selection operators, and a scaled set for the derived world."""

from __future__ import annotations

from dataclasses import dataclass, field

# Weights, bonuses and rules that define scores.
COMPONENTS: dict[str, dict[str, float]] = {
    "demand": {"pop_5km": 0.5, "pop_1km": 0.25, "pop_10km": 0.25},
    "access": {"dist_road_m": 0.5, "dist_trunk_m": 0.5},
    "host_commercial": {"poi_1km": 0.5, "poi_3km": 0.5},
    "charging_gap": {"dist_charger_m": 0.5, "chargers_10km": 0.25, "chargers_25km": 0.25},
    "grid_evidence": {"dist_substation_m": 0.5, "dist_line_m": 0.5},
}
PROFILES: dict[str, dict[str, float]] = {
    "urban": {"demand": 0.30, "access": 0.20, "host_commercial": 0.25, "charging_gap": 0.15, "grid_evidence": 0.10},
    "corridor": {"demand": 0.15, "access": 0.30, "host_commercial": 0.15, "charging_gap": 0.25, "grid_evidence": 0.15},
}
HOST_BONUS = {"fuel": 10, "mall": 10, "supermarket": 5, "logistics": 5, "hotel": 5, "industrial": 0, "none": 0}
ROAD_BONUS = {"trunk": 10, "primary": 5}
LOG_FEATURES = ("poi_1km", "poi_3km", "chargers_10km", "chargers_25km")
LOWER_IS_BETTER = ("dist_road_m", "dist_trunk_m", "dist_substation_m", "dist_line_m", "chargers_10km", "chargers_25km")
HOST_PRIORITY = ("fuel", "mall", "supermarket", "logistics", "industrial", "hotel", "none")
UNKNOWNS = ("grid connection capacity", "transformer capacity", "land availability", "landowner willingness", "permit requirements")


@dataclass(frozen=True)
class Settings:
    """Radii in metres, and counts."""

    population_m: tuple[float, float, float] = (1000, 5000, 10000)
    poi_m: tuple[float, float] = (1000, 3000)
    chargers_m: tuple[float, float] = (10000, 25000)
    grid_missing_m: float = 5000
    town_m: float = 3000
    centre_m: float = 10000
    dedup_m: float = 300
    merge_m: float = 50
    snap_m: float = 2000
    road_m: float = 500
    spacing_m: float = 2000
    service_m: float = 10000
    sparse_below: float = 0.5
    remote_pois: int = 0
    sites: int = 30
    budget: int = 300
    percentile: float = 50.0
    charger_factor: float = 0.5
    score_weight: float = 0.01
    hit_m: float = 1000
    k: tuple[int, ...] = (10, 20, 30)
    start_m: float = field(default=2000)


#: Radii at which every rule is exercised on the derived world's 50 km square.
WORLD = Settings(population_m=(300, 1000, 2000), poi_m=(500, 1500), chargers_m=(2000, 5000), grid_missing_m=1500, town_m=3000, centre_m=10000, dedup_m=1000, merge_m=2500, snap_m=800, road_m=2500, spacing_m=2000, service_m=3000, hit_m=1000)
