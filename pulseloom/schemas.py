"""Schemas as DDL, declared once; vendor JSON is never inferred."""

SAMPLE = "user_id bigint, metric_type string, value double, unit string, start_time timestamp, end_time timestamp, source string"
RING_HEART_RATE = "user_id bigint, data array<struct<bpm:double,timestamp:string>>"
RING_SLEEP = "user_id bigint, data array<struct<average_hrv:double,lowest_heart_rate:double,total_sleep_duration:double,bedtime_start:string,bedtime_end:string>>"
RING_READINESS = "user_id bigint, data array<struct<temperature_deviation:double,day:string>>"
FIT_HEART_RATE = "user_id bigint, bucket array<struct<dataset:array<struct<point:array<struct<startTimeNanos:string,endTimeNanos:string,value:array<struct<fpVal:double>>>>>>>>"
PREFERENCES = "user_id bigint, ambient_optin boolean, ambient_optin_date string, preferred_volume double, cooldown_minutes int, disabled boolean, headphones_trusted boolean, session_count int, voiceover boolean"
SESSION_LOG = "user_id bigint, session_id string, timestamp timestamp, element string, tier string, duration_seconds int, hrv_change_pct double"
