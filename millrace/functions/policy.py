"""What is compressed, kept and vaulted, by the pressure of a conversation and the kind of its upstream."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SETTINGS = ["compress", "keep_recent", "least_lines", "vault_at", "body_lines"]
# Settings, in the order of SETTINGS, of (pressure, whether the upstream is local).
TIERS = {
    ("low", True): (False, 3, 120, 100_000, 8),
    ("low", False): (True, 3, 60, 60_000, 6),
    ("medium", True): (True, 2, 60, 60_000, 4),
    ("medium", False): (True, 2, 40, 30_000, 4),
    ("high", True): (True, 1, 30, 24_000, 3),
    ("high", False): (True, 1, 30, 16_000, 2),
}
# Estimated tokens from which pressure is medium and high.
MEDIUM_AT, HIGH_AT = 15_000, 45_000


def pressure(tokens: Column, medium: int = MEDIUM_AT, high: int = HIGH_AT) -> Column:
    return F.when(tokens >= high, "high").when(tokens >= medium, "medium").otherwise("low")


def setting(level: Column, local: Column, name: str) -> Column:
    """The value of one of SETTINGS."""
    at = SETTINGS.index(name)
    out = F.lit(None)
    for (tier, here), values in TIERS.items():
        out = F.when((level == tier) & (local == here), F.lit(values[at])).otherwise(out)
    return out


def decision(bypass: Column, disabled: Column, tokens: Column, least: int) -> Column:
    """Why a request is or isn't compressed; the first reason counts."""
    return F.when(bypass, "bypass").when(disabled, "disabled").when(tokens == 0, "empty").when(tokens < least, "small").otherwise("compress")
