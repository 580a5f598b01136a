"""Every tunable of the engine in one record."""

from __future__ import annotations

from dataclasses import dataclass

# Names, places, lists and limits that results depend on.
CATEGORIES = ("GROC", "FOOD", "FUEL", "RETAIL", "PHARM", "TRAVEL", "ELEC", "GIFT", "CRYPTO", "GAMBLING")
CITIES = (
    ("Hyderabad", 17.3850, 78.4867),
    ("Mumbai", 19.0760, 72.8777),
    ("Delhi", 28.6139, 77.2090),
    ("Bengaluru", 12.9716, 77.5946),
    ("Chennai", 13.0827, 80.2707),
    ("Kolkata", 22.5726, 88.3639),
    ("Pune", 18.5204, 73.8567),
    ("Ahmedabad", 23.0225, 72.5714),
)
TIERS = {"CRYPTO": 3, "GAMBLING": 3, "GIFT": 3, "ELEC": 2, "TRAVEL": 1, "P2P": 1}
SANCTIONED = ("m_CRYPTO_0013", "m_GAMBLING_0007")
HARD_RULES = ("HARD_BLOCK_MERCHANT", "AMOUNT_CAP")
CHANNELS = {"CARD": 0, "UPI": 1, "P2P": 2}
EARTH_KM = 6371.0088


@dataclass(frozen=True)
class EngineConfig:
    dedup_ttl_ms: int = 3_600_000
    windows: tuple = (("1m", 60_000, 8), ("5m", 300_000, 20), ("1h", 3_600_000, 60))
    min_samples: int = 10
    min_std: float = 1.0
    max_kmh: float = 900.0
    min_km: float = 100.0
    min_gap_s: int = 60
    max_edges: int = 50
    edge_ttl_ms: int = 86_400_000
    max_cycle: int = 5
    min_cycle: int = 3
    pass_window_ms: int = 3_600_000
    pass_low: float = 0.80
    pass_high: float = 1.02
    pass_depth: int = 1
    chain_cap: int = 10
    sample_rate: float = 0.01
    block: float = 0.99
    review: float = 0.60
    min_signals: int = 2
    min_severity: float = 0.5
    amount_cap: float = 200_000.0
    sanctioned: tuple = SANCTIONED
    history_cap: int = 50


DEFAULT = EngineConfig()
