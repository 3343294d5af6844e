"""Tenant scoping and the partition function of events."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLATFORM_TENANT = "00000000-0000-0000-0000-000000000000"
UUID = r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"


def tenant_view(df: DataFrame, tenant_id: str) -> DataFrame:
    """One tenant's rows; an id that is no UUID is an error, so nothing is shown by mistake."""
    return df.filter(F.col("tenant_id") == str(uuid.UUID(str(tenant_id))))


def tenant_or_platform(tenant_id: Column) -> Column:
    return F.when(tenant_id.rlike(UUID), F.lower(tenant_id)).otherwise(F.lit(PLATFORM_TENANT))


def month_of(at: Column) -> Column:
    """The month partition of an event; the session's time zone is UTC."""
    return F.date_format(at, "yyyy.MM")
