"""Preferences: defaults, stored values and updates merged per user, and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseloom import schemas
from pulseloom.functions import scalars as S

# The defaults, and the keys that an update may set.
DEFAULTS = {"ambient_optin": False, "ambient_optin_date": None, "preferred_volume": 0.3, "cooldown_minutes": 30, "disabled": False, "headphones_trusted": False, "session_count": 0, "voiceover": True}
UPDATABLE = ("ambient_optin", "disabled", "preferred_volume", "cooldown_minutes", "headphones_trusted", "voiceover")
VOICEOVER_SESSIONS = 3


def merge_preferences(stored: DataFrame, updates: DataFrame, now: str | None = None) -> DataFrame:
    """Update over stored over default, key by key; users in either table. Volume and cooldown are
    clamped; opting in sets the date to `now`. Other columns of `updates` are ignored."""
    s = stored.select("user_id", *[F.col(c).alias(f"_s_{c}") for c in DEFAULTS if c in stored.columns])
    u = updates.select("user_id", *[F.col(c).alias(f"_u_{c}") for c in UPDATABLE if c in updates.columns])
    j = s.join(u, "user_id", "full")
    types = dict(field.split() for field in schemas.PREFERENCES.split(", "))

    def value(c: str):
        new = F.col(f"_u_{c}") if f"_u_{c}" in u.columns else F.lit(None)
        if c == "preferred_volume":
            new = S.clamp(new, 0.0, 1.0)
        elif c == "cooldown_minutes":
            new = S.clamp(new, 1, 1440)
        elif c == "ambient_optin_date":
            new = F.when(S.strictly_true(F.col("_u_ambient_optin")), F.lit(now)) if "_u_ambient_optin" in u.columns else F.lit(None)
        old = F.col(f"_s_{c}") if f"_s_{c}" in s.columns else F.lit(None)
        return F.coalesce(new, old, F.lit(DEFAULTS[c])).cast(types[c]).alias(c)

    return j.select("user_id", *[value(c) for c in DEFAULTS])


def session_counts(starts: DataFrame, ms: str, order: str, initial_voiceover: bool = True, switch: str | None = None) -> DataFrame:
    """session_count after each start, and voiceover, which a start switches off from the third on.

    `switch` names a boolean column that is null for starts; other rows are no starts but switch
    the voice-over on (true) or off (false). A start before the third leaves it as it is."""
    w = Window.partitionBy("user_id").orderBy(ms, order).rowsBetween(Window.unboundedPreceding, 0)
    to = F.col(switch) if switch else F.lit(None).cast("boolean")
    out = starts.withColumn("session_count", F.sum(to.isNull().cast("long")).over(w))
    before = F.coalesce(F.last(to, ignorenulls=True).over(w), F.lit(initial_voiceover))
    return out.withColumn("voiceover", F.when(to.isNull() & (F.col("session_count") >= VOICEOVER_SESSIONS), F.lit(False)).otherwise(before))


def save_preferences(merged: DataFrame, path: str) -> None:
    """Write merged preferences as JSON, one row per user, under a name of their own in `path`; the
    newest is the one read, so a reader never meets half a rewrite."""
    merged.withColumn("saved_at", F.current_timestamp()).write.mode("append").option("ignoreNullFields", "false").json(path)


def load_preferences(spark: SparkSession, path: str) -> DataFrame:
    """The newest preferences of each user that `path` holds; unreadable records count as none."""
    rows = spark.read.schema(schemas.PREFERENCES + ", saved_at timestamp").json(path).filter(F.col("user_id").isNotNull())
    cols = [f.split()[0] for f in schemas.PREFERENCES.split(", ")]
    newest = rows.groupBy("user_id").agg(F.max_by(F.struct(*cols[1:]), "saved_at").alias("p"))
    return newest.select("user_id", "p.*")


def connected(sources: list[str], registry: DataFrame) -> DataFrame:
    """Which sources are in the registry (column source)."""
    known = registry.sparkSession.createDataFrame([(s,) for s in sources], "source string")
    have = registry.select("source").distinct().withColumn("_c", F.lit(True))
    return known.join(have, "source", "left").select("source", F.when(F.col("_c"), "connected").otherwise("not_connected").alias("status"))


def connected_by_user(users: DataFrame, sources: tuple[str, ...], registry: DataFrame) -> DataFrame:
    """user_id, source and status of each user and source. registry: (user_id, source), repeats allowed."""
    each = users.select("user_id").distinct().withColumn("source", F.explode(F.array(*[F.lit(s) for s in sources])))
    have = registry.select("user_id", "source").distinct().withColumn("_c", F.lit(True))
    return each.join(have, ["user_id", "source"], "left").select("user_id", "source", F.when(F.col("_c"), "connected").otherwise("not_connected").alias("status"))
