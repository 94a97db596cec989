"""The generic ``events`` table read as a click log, for tests and benchmarks (FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HAS_ITEM = "event_name IN ('item_view','photo_swipe','seller_page_view','contact_phone_show','contact_chat_open','contact_message_sent','favorite_add')"
_CLICKS = {
    "cookie_id": "user_id",
    "event_ts": "date_trunc('second', ts)",
    "event_name": "event_name",
    "platform": "CASE p WHEN 0 THEN element_at(array('WEB','Web','web'), int(event_id % 3) + 1) WHEN 1 THEN 'desktop' WHEN 2 THEN 'ANDROID' ELSE IF(event_id % 2 = 0, 'iphone', 'IOS') END",
    "user_agent": "CASE WHEN user_id % 12 = 3 THEN concat(element_at(array('python-requests/2.', 'node-fetch/1.', 'python-urllib3/2.'), int(k % 3) + 1), k % 5) WHEN p = 0 AND user_id % 5 = 0 THEN 'Mozilla/5.0 (Macintosh) Version/17 Safari/605' WHEN p = 0 THEN concat('Mozilla/5.0 Chrome/', 100 + user_id % 20, ' Safari/537') WHEN p = 1 THEN concat('Mozilla/5.0 Firefox/', 110 + user_id % 9)"
    " WHEN p = 2 THEN concat('NativeApp/', 120 + user_id % 5, ' (Android ', 10 + user_id % 4, '; Pixel ', user_id % 6, ')') ELSE concat('NativeApp/121 (iPhone; iOS 16.2; Phone ', user_id % 6, ')') END",
    "item_id": f"CASE WHEN {_HAS_ITEM} THEN 100000 + (k * 97 + user_id * 13 + event_id % 5) % 5000 END",
    "item_category": f"CASE WHEN {_HAS_ITEM} THEN concat('cat_', k % 15) END",
    "item_location": f"CASE WHEN {_HAS_ITEM} THEN concat('loc_', (k + user_id) % 60) END",
    "search_query": "CASE WHEN event_name = 'search_results_view' THEN IF(k % 30 = 7, \"o'q.7\", concat('q_', k % 30)) END",
    "search_page": "CASE WHEN event_name = 'search_results_view' THEN int(1 + floor(value / 15)) END",
    "seller_type": f"CASE WHEN {_HAS_ITEM} AND k % 10 <> 9 THEN IF(k % 4 = 0, 'pro', 'private') END",
    "pointer_x": "CASE WHEN p IN (0, 1) AND event_id % 3 <> 0 THEN double(floor(value * 40) % 1920) END",
    "pointer_y": "CASE WHEN p IN (0, 1) AND event_id % 3 <> 0 THEN double((k * 11) % 1080) END",
}
_NAME = """CASE event_type WHEN 'view' THEN IF(k % 2 = 0, 'item_view', 'search_results_view') WHEN 'click' THEN IF(k % 3 = 0, 'seller_page_view', 'photo_swipe')
 WHEN 'signup' THEN IF(k % 2 = 0, 'favorite_add', 'login') WHEN 'purchase' THEN element_at(array('contact_phone_show','contact_chat_open','contact_message_sent'), int(k % 3) + 1)
 ELSE IF(k % 4 = 0, 'captcha_shown', 'search_results_view') END"""


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    raw = raw.withColumn("p", F.expr("IF(event_id % 11 = 0, (user_id + 1) % 4, user_id % 4)")).withColumn("event_name", F.expr(_NAME))
    return raw.select("event_id", *(F.expr(e).alias(c) for c, e in _CLICKS.items()))


def cookies(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("cookie_id")).distinct()
    start = "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(int(cookie_id % 8))"
    return ids.select(
        "cookie_id",
        F.expr(f"{start} - make_dt_interval(0, int(cookie_id * 37 % 400))").alias("cookie_created_at"),
        F.expr(start).alias("window_start_ts"),
        F.expr(f"{start} + INTERVAL 14 DAYS").alias("window_end_ts"),
        F.expr("cookie_id % 8").alias("day_index"),
        F.expr("cookie_id % 8 < 5").alias("is_fit"),
        F.expr("int(cookie_id % 12 IN (3, 7))").alias("target"),
    )
