"""Tunables as frozen dataclasses; the per-shop policy as a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession

from spreadlake import schemas


@dataclass(frozen=True)
class FeeConfig:
    transaction_fee_pct: float = 0.09
    processing_fee_pct: float = 0.03
    min_transaction_fee: float = 5.0
    shipping: float = 7.0
    undercut: float = 0.0


@dataclass(frozen=True)
class SecondVenueConfig:
    """A second sale venue whose prices are unknown but whose fees are known."""

    enabled: bool = True
    name: str = "Second venue"
    search_url: str = "https://second-venue.example/search?query="
    commission_pct: float = 0.095
    cashout_pct: float = 0.029
    seller_fee: float = 5.0
    shipping: float = 7.0


@dataclass(frozen=True)
class VatConfig:
    enabled: bool = False
    rate: float = 0.24
    input_vat_reclaimable: bool = False
    output_vat_on_sale: bool = False


@dataclass(frozen=True)
class FilterConfig:
    min_profit: float = 25.0
    require_live_bid: bool = True
    max_retail_price: float = 500.0
    alert_min_confidence: float = 0.90
    min_bids: int = 1
    min_sales_72h: int = 0
    strict_liquidity: bool = False


@dataclass(frozen=True)
class AlertConfig:
    max_per_scan: int = 10
    re_alert_delta: float = 10.0


@dataclass(frozen=True)
class VenueConfig:
    """The marketplace the catalog and the quotes come from."""

    name: str = "Marketplace"
    base_url: str = "https://marketplace.example/"
    currency: str = "EUR"
    daily_request_budget: int = 20000
    refresh_minutes: int = 60
    calls_per_scan: int = 150
    resolutions_per_scan: int = 300
    gtin_lookups_per_scan: int = 400
    refresh_minutes_hot: int = 45
    refresh_minutes_warm: int = 240
    refresh_minutes_cold: int = 1440
    near_miss: float = 30.0
    negative_cache_days: int = 3


@dataclass(frozen=True)
class RetailerPolicy:
    retailer: str
    enabled: bool = True
    scan_interval_minutes: int = 30
    extra_cost_eur: float = 0.0
    discount_pct: float = 0.0
    sale_discount_pct: float = 0.0
    buy_note: str = ""
    prefer_retailer: str = ""
    slug_filters: tuple[str, ...] = ()
    slice_per_scan: int = 120


@dataclass(frozen=True)
class EngineConfig:
    fees: FeeConfig = field(default_factory=FeeConfig)
    second_venue: SecondVenueConfig = field(default_factory=SecondVenueConfig)
    vat: VatConfig = field(default_factory=VatConfig)
    filters: FilterConfig = field(default_factory=FilterConfig)
    alerts: AlertConfig = field(default_factory=AlertConfig)
    venue: VenueConfig = field(default_factory=VenueConfig)
    retailers: tuple[RetailerPolicy, ...] = ()

    def policy_frame(self, spark: SparkSession) -> DataFrame:
        """One row per shop; its size is the number of configured shops."""
        rows = [
            (p.retailer, p.enabled, p.scan_interval_minutes, p.extra_cost_eur, p.discount_pct,
             p.sale_discount_pct, p.buy_note or None, p.prefer_retailer or None)
            for p in self.retailers
        ]
        return spark.createDataFrame(rows, schemas.POLICY)


# The values the shipped configuration sets; dataclass defaults differ.
SHIPPED = EngineConfig(
    fees=FeeConfig(shipping=10.0),
    filters=FilterConfig(min_profit=0.0),
    alerts=AlertConfig(max_per_scan=20),
    venue=VenueConfig(
        daily_request_budget=23500, calls_per_scan=1500, resolutions_per_scan=2000,
        refresh_minutes_warm=180, refresh_minutes_cold=720, near_miss=60.0,
    ),
)


def from_mapping(raw: dict) -> EngineConfig:
    """Build the configuration from a parsed mapping; unknown keys are errors."""

    def section(cls, values, **extra):
        names = {f.name for f in fields(cls)}
        unknown = set(values or {}) - names
        if unknown:
            raise ValueError(f"unknown {cls.__name__} keys: {sorted(unknown)}")
        return cls(**{**(values or {}), **extra})

    sections = {
        "fees": FeeConfig, "second_venue": SecondVenueConfig, "vat": VatConfig,
        "filters": FilterConfig, "alerts": AlertConfig, "venue": VenueConfig,
    }
    unknown = set(raw) - set(sections) - {"retailers"}
    if unknown:
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    built = {name: section(cls, raw.get(name)) for name, cls in sections.items()}
    shops = []
    for name, values in (raw.get("retailers") or {}).items():
        values = dict(values or {})
        values["slug_filters"] = tuple(values.get("slug_filters", ()))
        shops.append(section(RetailerPolicy, values, retailer=name))
    return replace(EngineConfig(), retailers=tuple(shops), **built)
