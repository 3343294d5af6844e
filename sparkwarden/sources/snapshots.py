"""Read-through snapshots of dimension tables with an age limit, for decisions in a stream.

A snapshot is a written version of a small table (statuses of tenants or devices, plans). It is used until it is `ttl_s` old,
also while its source is out of reach; then it is read again. With no valid snapshot and no source, nothing is known, and
what depends on it is denied, to be tried again.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.storage import written

TTL_S, RETRY_AFTER_S = 60.0, 30


class SourceUnavailable(RuntimeError):
    """There is no valid snapshot and its source cannot be read."""


class Snapshot:
    """read: makes the table's DataFrame; it may fail, then or when it is run."""

    def __init__(self, read: Callable[[], DataFrame], name: str, ttl_s: float = TTL_S, clock: Callable[[], float] = time.monotonic):
        self.read, self.name, self.ttl_s, self.clock = read, name, ttl_s, clock
        self.version, self.read_at, self._frame = 0, 0.0, None

    def frame(self) -> DataFrame:
        """The valid version: the same rows for all that ask within its time, whatever the source holds meanwhile."""
        now = self.clock()
        if self._frame is not None and now - self.read_at < self.ttl_s:
            return self._frame
        self._frame = None
        try:
            self._frame = written(self.read(), f"{self.name}-{self.version + 1}")
        except Exception as cause:  # whatever a source may raise
            raise SourceUnavailable(self.name) from cause
        self.version, self.read_at = self.version + 1, now
        return self._frame

    def invalidate(self) -> None:
        """Forget the version, after a change that must count at once."""
        self._frame = None


def admit(requests: DataFrame, tenants: Snapshot, devices: Snapshot | None = None) -> DataFrame:
    """requests(tenant_id, and with devices: device_id, serial, at) with code (null: admitted) and retry_after_s.

    tenants(tenant_id, status, abuse_frozen); devices(tenant_id, device_id, status, cert_serial, prev_cert_serial,
    prev_valid_until). The device is looked at first. Unknown tenants and devices are denied. A device may still show its
    former serial for as long as that is valid. Where a snapshot is to be had from nowhere, all requests are denied."""
    try:
        of_tenant = tenants.frame().select(F.col("tenant_id").alias("_t"), F.col("status").alias("_status"), F.col("abuse_frozen").alias("_frozen"))
        of_device = None if devices is None else devices.frame()
    except SourceUnavailable:
        return requests.withColumns({"code": F.lit("SERVICE_UNAVAILABLE"), "retry_after_s": F.lit(RETRY_AFTER_S)})
    rows = requests.join(of_tenant, F.col("tenant_id") == F.col("_t"), "left")
    code = (
        F.when(F.col("_t").isNull(), "AUTH_REQUIRED").when(F.col("_frozen"), "TENANT_FROZEN")
        .when(F.col("_status").isin("frozen", "purged"), "TRIAL_EXPIRED").when(F.coalesce(F.col("_status") != "active", F.lit(True)), "SERVICE_UNAVAILABLE")
    )
    if of_device is not None:
        known = of_device.select(F.col("tenant_id").alias("_dt"), F.col("device_id").alias("_d"), F.col("status").alias("_ds"), F.lower("cert_serial").alias("_serial"), F.lower("prev_cert_serial").alias("_prev"), F.col("prev_valid_until").alias("_until"))
        rows = rows.join(known, (F.col("tenant_id") == F.col("_dt")) & (F.col("device_id") == F.col("_d")), "left")
        shown = F.lower("serial")
        fits = (shown == F.col("_serial")) | (shown == F.col("_prev")) & (F.col("at") <= F.col("_until"))
        by_device = F.when(F.col("_d").isNull(), "DEVICE_IDENTITY_INVALID").when(F.col("_ds") != "active", "DEVICE_REVOKED").when(~F.coalesce(fits, F.lit(False)), "DEVICE_IDENTITY_INVALID")
        code = F.coalesce(by_device, code)
    retry = F.when(F.col("code") == "SERVICE_UNAVAILABLE", RETRY_AFTER_S)
    return rows.withColumn("code", code).withColumn("retry_after_s", retry).select(*requests.columns, "code", "retry_after_s")
