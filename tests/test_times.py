"""Zones of schedules."""

import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from provlake.functions import times

ZONES = ["Europe/Berlin", "America/New_York", "Japan", "Singapore", "EST", "UTC", "Europe/Nowhere", "nowhere", "", "europe/berlin", None]


def test_zones_as_the_zone_library_has_them(spark):
    """Any IANA name; UTC for what isn't one. Daily runs keep their local hour over the change of clocks."""
    starts = [datetime.datetime(2024, m, d, 22, 30, tzinfo=datetime.UTC) for m, d in ((1, 5), (3, 9), (3, 30), (7, 1), (10, 26), (11, 2))]
    rows = [(i, int(s.timestamp() * 1000), z) for i, (s, z) in enumerate((s, z) for s in starts for z in ZONES)]
    frame = spark.createDataFrame(rows, "id int, ms long, zone string")
    none = F.lit(None).cast("string")
    got = frame.select("id", times.next_run(F.col("ms"), F.col("zone"), F.lit("daily"), none, F.lit(None).cast("int"), F.lit("09:15"), none, none).alias("run")).collect()
    for (_, ms, z), r in zip(rows, sorted(got)):
        try:
            zone = ZoneInfo(z or "UTC") if z != "europe/berlin" else ZoneInfo("UTC")
        except Exception:
            zone = ZoneInfo("UTC")
        here = datetime.datetime.fromtimestamp(ms / 1000, zone)
        run = here.replace(hour=9, minute=15, second=0, microsecond=0)
        if run <= here:
            run = (run.replace(tzinfo=None) + datetime.timedelta(days=1)).replace(tzinfo=zone)
        assert r.run == int(run.timestamp() * 1000), (z, here)
