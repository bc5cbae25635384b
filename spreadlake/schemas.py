"""Fixed record layouts, as Spark schemas."""

from __future__ import annotations

SIZE = "struct<label:string,system:string,us_size:string,ean:string,in_stock:boolean>"

LISTING = f"""
    retailer string, name string, brand string, style_code string, retailer_sku string,
    category string, ean string, colorway string, url string, price double, currency string,
    sizes array<{SIZE}>, in_stock boolean, pickup_available boolean, price_verified boolean,
    size_stock_unverified boolean, stock_note string, on_sale boolean, list_price double,
    scraped_at timestamp
"""

CATALOG_PRODUCT = """
    product_id string, style_id string, title string, brand string, url_key string,
    gender string, retail_price double, product_type string, ordinal bigint
"""

CATALOG_VARIANT = """
    product_id string, variant_id string, size string, size_system string,
    conversions map<string,string>
"""

QUOTE = """
    product_id string, variant_id string, currency string, lowest_ask double, highest_bid double,
    num_asks int, num_bids int, sales_72h int, sales_30d int, last_sale double,
    fetched_at timestamp
"""

POLICY = """
    retailer string, enabled boolean, scan_interval_minutes int, extra_cost_eur double,
    discount_pct double, sale_discount_pct double, buy_note string, prefer_retailer string
"""

RAW_PAGE = "retailer string, url string, fetched_at timestamp, body string"

RESOLUTION = """
    cache_key string, found boolean, product_id string, style_id string, title string,
    brand string, url_key string, confidence double, resolved_at timestamp
"""

GTIN_MAP = "gtin string, found boolean, product_id string, variant_id string, looked_up_at timestamp"

WATCH = "product_id string, best_profit double, checked_at timestamp"

REVIEW = """
    created_at timestamp, retailer string, url string, style_code string, reason string,
    detail string
"""

REVIEW_EVENT = "review_id string, resolved_at timestamp"

ALERT_STATE = """
    key string, first_alerted timestamp, last_alerted timestamp, last_profit double,
    was_in_stock boolean, payload string
"""

# What the next scan compares a listing with.
LISTING_STATE = """
    retailer string, url string, name string, brand string, style_code string, currency string,
    price double, in_stock boolean, first_seen timestamp, last_seen timestamp
"""

SCAN_LOG = """
    started_at timestamp, retailer string, products_seen bigint, candidates bigint,
    opportunities bigint, alerts_sent bigint
"""

SALE = """
    sold_at timestamp, retailer string, style_code string, title string, size_label string,
    variant_id string, paid_eur double, bid_eur double, payout_eur double,
    predicted_payout double, note string
"""

REQUEST = "ts timestamp"
