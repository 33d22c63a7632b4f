"""The driver's tables as asset tables: deterministic arithmetic on ids stands for model scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: column -> expression over events, valid in Spark and in DuckDB.
EVENT_ASSET = {
    "id": "event_id",
    "shoot": "user_id",
    "ts": "ts",
    "topiq": "cast((event_id * 37) % 997 as double) / 997",
    "laion": "cast((event_id * 53 + 11) % 997 as double) / 997",
    "clipiqa": "cast((event_id * 71 + 5) % 997 as double) / 997",
    "exposure": "value / 500",
    "composition": "case when event_id % 9 = 0 then null else cast((event_id * 41 + 3) % 997 as double) / 997 end",
    "taste": "case when event_id % 4 = 0 then null else cast((event_id * 61 + 7) % 997 as double) / 997 end",
    "taste_labels": "cast(event_id % 30 as int)",
    "tilt": "case when event_id % 7 = 0 then null else cast((event_id * 13) % 120 as double) / 16 - 3.5 end",
    "keystone": "case when event_id % 7 = 0 then null else cast((event_id * 17) % 140 as double) / 16 - 4.25 end",
    "subject": "case when event_id % 3 = 0 then null else cast((event_id * 29) % 1400 as double) end",
    "is_bokeh": "event_id % 5 = 0",
    "has_portrait": "event_id % 2 = 0",
    "eye_left": "case when event_id % 6 = 0 then null else cast((event_id * 19) % 1200 as double) end",
    "eye_right": "case when event_id % 10 = 0 then null else cast((event_id * 23) % 1200 as double) end",
    "eyes_closed": "event_id % 11 = 0",
    "occluded": "event_id % 13 = 0",
    "tenengrad": "cast((event_id * 31) % 400 as double)",
    "fft_ratio": "cast((event_id * 43) % 997 as double) / 9970",
    "motion": "cast((event_id * 59) % 1000 as double) / 100",
    "noise": "cast((event_id * 67) % 997 as double) / 997",
    "clip_high": "cast((event_id * 73) % 997 as double) / 9970",
    "clip_low": "cast((event_id * 79) % 997 as double) / 2500",
    "cast_a": "cast((event_id * 83) % 400 as double) / 16 - 12.5",
    "cast_b": "cast((event_id * 89) % 600 as double) / 16 - 18.75",
}
#: What a first stage, a second opinion and a duplicate search would say of an event.
EVENT_STAGE = EVENT_ASSET | {
    "s1_known": "event_id % 17 <> 0",
    "passed": "(event_id * 31) % 400 >= 60 and (event_id * 67) % 997 < 800",
    "reject_reason": "case when (event_id * 31) % 400 < 60 then 'blur' when (event_id * 67) % 997 >= 800 then 'noise' end",
    "s3_known": "event_id % 3 <> 1",
    "kept": "case when event_id % 19 = 0 then null else event_id % 2 = 1 end",
    "confidence": "cast((event_id * 47) % 997 as double) / 997",
    "duplicate": "event_id % 23 = 0",
    "shutter": "case event_id % 5 when 0 then '1/' || cast(60 + event_id % 300 as varchar(9)) || 's' when 1 then '1/30s' when 2 then cast(1 + event_id % 3 as varchar(9)) || 's' when 3 then 'auto' end",
    "name": "case when event_id % 29 = 0 then 'synth_blur_' || cast(event_id as varchar(20)) || '.jpg' else 'IMG_' || cast(event_id as varchar(20)) || '.jpg' end",
}


def events(spark: SparkSession, sf_dir: str, columns: dict[str, str] = EVENT_ASSET) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*[f"{v.replace('varchar(9)', 'string').replace('varchar(20)', 'string')} as {k}" for k, v in columns.items()])


def events_sql(columns: dict[str, str] = EVENT_ASSET) -> str:
    return "SELECT " + ", ".join(f"{v} AS {k}" for k, v in columns.items()) + " FROM events"
