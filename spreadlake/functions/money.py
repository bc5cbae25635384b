"""Cost, fee and profit arithmetic on doubles, in one fixed order of steps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from spreadlake.config import FeeConfig, FilterConfig, SecondVenueConfig, VatConfig
from spreadlake.functions.binding import bind

SELL_NOW = "sell_now"
LIST_ASK = "list_ask"
BREAKDOWN_FIELDS = (
    "scenario", "sale_price", "transaction_fee", "processing_fee", "shipping", "vat_wedge",
    "payout", "profit", "margin_pct", "roic",
)

_MANTISSA = 52


def round_half_even(x: Column, digits: int) -> Column:
    """Round the exact binary value of a double to 1 or 2 places, ties to even.

    `round` works on the shortest decimal text of the double and so turns 2.675
    (really 2.67499...) into 2.68. Here the fraction is scaled to an integer and
    all comparisons are integer ones.
    """
    if digits not in (1, 2):
        raise ValueError("digits must be 1 or 2")
    unit = 10**digits
    half = F.lit(1 << _MANTISSA)

    def rounded(v: Column) -> Column:
        whole = F.floor(F.abs(v))
        return bind((F.abs(v) - whole) * F.lit(float(1 << _MANTISSA)), lambda f: F.signum(v) * of_fraction(whole, f))

    def of_fraction(whole: Column, scaled: Column) -> Column:
        # a fraction below one half has bits under the scale; they are scaled apart
        under = (scaled - F.floor(scaled)) * F.lit(float(unit))
        product = F.floor(scaled) * F.lit(unit) + F.floor(under)
        beyond = under > F.floor(under)
        return bind(product, lambda p: (whole * F.lit(unit) + step(p, beyond)) / F.lit(float(unit)))

    def step(product: Column, beyond: Column) -> Column:
        down = F.shiftright(product, _MANTISSA)
        rest = (product - F.shiftleft(down, _MANTISSA)) * F.lit(2)
        up = (rest > half) | ((rest == half) & (beyond | (down % F.lit(2) == 1)))
        return down + up.cast("bigint")

    return bind(x, rounded)


def cents(x: Column) -> Column:
    """Money as integer cents: sums of these do not depend on row order."""
    return F.round(x * F.lit(100.0)).cast("bigint")


def cents(amount: Column) -> Column:
    """To whole cents, half up, for messages."""
    return F.floor(amount * 100 + 0.5) / 100


def landed_cost(price: Column, discount: Column, sale_discount: Column, on_sale: Column, extra: Column) -> Column:
    """Price less the standing discount, less the sale discount on marked-down
    items only, plus forwarding cost."""
    base = price * (F.lit(1) - discount)
    return F.when(F.coalesce(on_sale, F.lit(False)), base * (F.lit(1) - sale_discount)).otherwise(base) + extra


def discount_rank(price: Column, list_price: Column, on_sale: Column) -> Column:
    marked = F.coalesce(on_sale & (list_price > price), F.lit(False))
    return F.when(marked, (list_price - price) / list_price).otherwise(F.lit(0.0))


def vat_wedge(sale: Column, cost: Column, vat: VatConfig) -> Column:
    """Net VAT of one flip; negative means a net reclaim."""
    wedge = F.lit(0.0)
    if not vat.enabled:
        return wedge
    rate, gross = F.lit(vat.rate), F.lit(1 + vat.rate)
    if vat.output_vat_on_sale:
        wedge = wedge + sale * rate / gross
    if vat.input_vat_reclaimable:
        wedge = wedge - cost * rate / gross
    return wedge


def fee_breakdown(scenario: str, sale: Column, cost: Column, fees: FeeConfig, vat: VatConfig) -> Column:
    tx = F.greatest(sale * F.lit(fees.transaction_fee_pct), F.lit(fees.min_transaction_fee))
    proc = sale * F.lit(fees.processing_fee_pct)
    ship = F.lit(fees.shipping)
    wedge = vat_wedge(sale, cost, vat)
    payout = sale - tx - proc - ship - wedge
    profit = payout - cost
    capital = cost + ship

    def ratio(bottom: Column) -> Column:
        return F.when(bottom != 0, profit / bottom).otherwise(F.lit(0.0))

    values = (F.lit(scenario), sale, tx, proc, ship, wedge, payout, profit, ratio(cost), ratio(capital))
    return F.struct(*[v.alias(n) for v, n in zip(values, BREAKDOWN_FIELDS)])


def sell_now(bid: Column, cost: Column, fees: FeeConfig, vat: VatConfig) -> Column:
    """NULL when there is no live bid; a bid of 0 is no bid."""
    return F.when(bid > 0, fee_breakdown(SELL_NOW, bid, cost, fees, vat))


def list_ask(ask: Column, cost: Column, fees: FeeConfig, vat: VatConfig) -> Column:
    price = F.greatest(ask - F.lit(fees.undercut), F.lit(0.0))
    return F.when(ask > 0, fee_breakdown(LIST_ASK, price, cost, fees, vat))


def gate_profit(sell_now_profit: Column, list_ask_profit: Column, filters: FilterConfig) -> Column:
    """The figure the profit floor judges. NULL stands for minus infinity."""
    if filters.require_live_bid:
        return sell_now_profit
    return F.greatest(sell_now_profit, list_ask_profit)


def best_profit(sell_now_profit: Column, list_ask_profit: Column) -> Column:
    return F.coalesce(F.greatest(sell_now_profit, list_ask_profit), F.lit(0.0))


def second_venue_payout(sale: Column, venue: SecondVenueConfig) -> Column:
    keep = 1 - venue.commission_pct - venue.cashout_pct
    return sale * F.lit(keep) - F.lit(venue.seller_fee) - F.lit(venue.shipping)


def second_venue_breakeven(target_payout: Column, venue: SecondVenueConfig) -> Column:
    """Sale price the second venue must reach to match a payout."""
    keep = 1 - venue.commission_pct - venue.cashout_pct
    if keep <= 0:
        return F.lit(None).cast("double")
    return (target_payout + F.lit(venue.seller_fee) + F.lit(venue.shipping)) / F.lit(keep)


def days_to_clear(sales_72h: Column, num_asks: Column) -> Column:
    """Queue over velocity, one decimal; unknown without sales."""
    queue = F.greatest(F.coalesce(num_asks, F.lit(1)), F.lit(1))
    raw = queue / (sales_72h / F.lit(3.0))
    return F.when(sales_72h != 0, round_half_even(raw, 1))


def score_unrounded(gated: Column, sell_now_profit: Column, sales_72h: Column, highest_bid: Column) -> Column:
    """Gated profit weighted by liquidity. Only an unknown bid halves the
    score; a bid of 0 does not."""
    viable = F.when(sell_now_profit > 0, F.lit(2.0)).otherwise(F.lit(1.0))
    velocity = F.when(
        sales_72h != 0, F.lit(1.0) + F.least(sales_72h, F.lit(10)) / F.lit(10.0)
    ).otherwise(F.lit(1.0))
    no_bid = F.when(highest_bid.isNull(), F.lit(0.5)).otherwise(F.lit(1.0))
    return gated * (viable * velocity * no_bid)


def opportunity_score(gated: Column, sell_now_profit: Column, sales_72h: Column, highest_bid: Column) -> Column:
    return round_half_even(score_unrounded(gated, sell_now_profit, sales_72h, highest_bid), 2)


def liquidity_ok(num_bids: Column, sales_72h: Column, filters: FilterConfig) -> Column:
    """Unknown figures pass unless strict; known ones must reach the floor."""

    def passes(value: Column, floor: int) -> Column:
        unknown = not (filters.strict_liquidity and floor > 0)
        return F.coalesce(value >= F.lit(floor), F.lit(unknown))

    return passes(num_bids, filters.min_bids) & passes(sales_72h, filters.min_sales_72h)


def opportunity_key(retailer: Column, variant_id: Column, size_label: Column) -> Column:
    """Same shop, same variant, same size; a size-less item has no third part."""
    return F.concat_ws("|", retailer, variant_id, F.nullif(size_label, F.lit("")))


def unverified_key(retailer: Column, product_id: Column) -> Column:
    return F.concat_ws("|", retailer, product_id, F.lit("unverified"))


def catalog_url(base: str, url_key: Column, style_id: Column, product_id: Column) -> Column:
    slug = F.nullif(url_key, F.lit(""))
    term = F.coalesce(F.nullif(style_id, F.lit("")), product_id)
    return F.concat(F.lit(base), F.coalesce(slug, F.concat(F.lit("search?s="), term)))
