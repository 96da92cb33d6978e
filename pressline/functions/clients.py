"""Client attributes and prices."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- fixed values: US dollars per million tokens ---
MODEL_PRICES = [
    ("gpt-4o-mini", 0.15, 0.60),
    ("gpt-4o", 2.50, 10.00),
    ("gpt-4o-mini-2024-07-18", 0.15, 0.60),
    ("gpt-4o-2024-08-06", 2.50, 10.00),
    ("gpt-5-nano", 0.05, 0.40),
]
DEFAULT_MODEL = "gpt-4o-mini"


def token_cost(model: Column, input_tokens: Column, output_tokens: Column, prices=None) -> Column:
    """Dollars for one call, rounded to six places; unknown models use the default price."""
    prices = prices or MODEL_PRICES
    table = {name: (i, o) for name, i, o in prices}
    rate_in, rate_out = F.lit(table[DEFAULT_MODEL][0]), F.lit(table[DEFAULT_MODEL][1])
    for name, (price_in, price_out) in table.items():
        rate_in = F.when(model == name, F.lit(price_in)).otherwise(rate_in)
        rate_out = F.when(model == name, F.lit(price_out)).otherwise(rate_out)
    spent = input_tokens / F.lit(1e6) * rate_in + output_tokens / F.lit(1e6) * rate_out
    return F.round(spent.cast("decimal(18,10)"), 6).cast("decimal(10,6)")


def classify_device(user_agent: Column) -> Column:
    """Android tablets count as mobile because that test comes first."""
    ua = F.lower(F.coalesce(user_agent, F.lit("")))
    return (
        F.when(ua.rlike("mobile|android|iphone"), F.lit("mobile"))
        .when(ua.rlike("tablet|ipad"), F.lit("tablet"))
        .when(ua.contains("tv"), F.lit("tv"))
        .otherwise(F.lit("desktop"))
    )


def recommended_quality(device: Column) -> Column:
    """T20."""
    return F.when(device.isin("desktop", "tv"), F.lit("high")).otherwise(F.lit("medium"))


def client_ip(forwarded_for: Column, remote_addr: Column) -> Column:
    """First hop of X-Forwarded-For, else the peer address."""
    first = F.trim(F.get(F.split(F.coalesce(forwarded_for, F.lit("")), ","), F.lit(0)))
    given = F.coalesce(forwarded_for, F.lit("")) != ""
    return F.when(given, first).otherwise(F.coalesce(remote_addr, F.lit("")))
