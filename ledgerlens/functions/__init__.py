"""Reusable Column expressions (all JVM-side, whole-stage-codegen friendly)."""

from ledgerlens.functions.columns import (  # noqa: F401
    epoch_micros,
    haversine_km,
    r6,
    sha256_hex,
    sha256_trimmed,
    money_text,
    ts_text,
)
