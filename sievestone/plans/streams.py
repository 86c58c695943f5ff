"""Streaming queries over events, run to the end of the available input."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.storage import shared_dir
from ..streaming import events as S
from ._base import ORACLES, QUERIES


def _folder(spark) -> str:
    """A new folder that executors share; a local one only where no checkpoint folder is named."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def stream_novel_routes(spark, sf_dir):
    at = _folder(spark)
    out = S.run_to_table(S.novel_routes(S.read_events(spark, sf_dir)).select("user_id", "event_type"), f"{at}/out", f"{at}/state")
    return out.select("user_id", "event_type")


def stream_windows(spark, sf_dir):
    """Complete windows: what the watermark has not passed at the end of input stays open, so the result is read in complete mode."""
    at = _folder(spark)
    out = S.run_to_table(S.windowed(S.read_events(spark, sf_dir), "6 hours"), f"{at}/out", f"{at}/state", "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_bounded_sessions(spark, sf_dir):
    at = _folder(spark)
    return S.run_to_table(S.bounded_sessions(S.read_events(spark, sf_dir)), f"{at}/out", f"{at}/state", "update").select("user_id", "recent", "stalls", "n")


QUERIES |= {"stream_novel_routes": stream_novel_routes, "stream_windows": stream_windows, "stream_bounded_sessions": stream_bounded_sessions}
ORACLES["stream_novel_routes"] = "SELECT DISTINCT user_id, event_type FROM events"
ORACLES["stream_windows"] = "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"
ORACLES["stream_bounded_sessions"] = """
WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events),
s AS (SELECT user_id, count(*) AS n, coalesce(min(k) FILTER (event_type <> f), count(*) + 1) - 2 AS stalls FROM r JOIN (SELECT user_id, event_type AS f FROM r WHERE k = 1) USING (user_id) GROUP BY user_id)
SELECT user_id, (SELECT string_agg(event_type, ',' ORDER BY k DESC) FROM r WHERE r.user_id = s.user_id AND k <= 16) AS recent, stalls, n FROM s
"""
