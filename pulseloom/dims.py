"""Closed dimensions, as small seed tables. Their sizes are fixed, so joins broadcast them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The five elements, in their significant order.
ELEMENTS = ("wood", "fire", "earth", "metal", "water")
# Texts of the elements, which outputs must match.
ELEMENT_ROWS = [
    (0, "wood", "Wood", "Liver", "ambient_downtempo", "stagnation detected", "The Detox · Cleansing & Qi flow", "Low HRV detected — Liver Qi stagnation.", "Deep breathing steadies and restores Liver Qi."),
    (1, "fire", "Fire", "Heart", "lofi_chill_jazz", "restlessness detected", "The Vessel · Circulation & clarity", "Elevated resting heart rate — Heart Fire rising.", "Slow breathing settles Shen and draws Fire down."),
    (2, "earth", "Earth", "Spleen", "acoustic_folk_calm", "imbalance detected", "The Core · Digestion & absorption", "Low activity — Spleen Qi grows sluggish.", "Breathing from the center awakens Spleen Qi."),
    (3, "metal", "Metal", "Lung", "nature_soundscape_pads", "tension detected", "The Shield · Immunity & defense", "Unsteady breathing — Lung Qi faltering.", "Deep breathing steadies and restores Lung Qi."),
    (4, "water", "Water", "Kidney", "drone_deep_ambient", "depletion detected", "The Reservoir · Energy & vitality", "Weak recovery at rest — Kidney Essence low.", "Breathing roots Qi in Dan Tian, nourishing Kidneys."),
]
ELEMENT_COLUMNS = "ord int, element string, label string, organ string, genre string, summary string, description string, activation_reason string, practice_reason string"

# Quadrants.
QUADRANT_ROWS = [
    ("peak", "In Flow", "Your energy is in harmony. Maintain this state."),
    ("pushing_it", "Pushing It", "Active but under-recovered. Consider rest soon."),
    ("recharging", "Recharging", "Well-recovered but low activity. Your body is conserving energy."),
    ("burnout", "Running on Empty", "Under-recovered and inactive. Gentle movement and rest recommended."),
]

# Metric types and their units.
METRIC_ROWS = [
    ("heart_rate", "bpm"), ("heart_rate_variability", "ms"), ("resting_heart_rate", "bpm"),
    ("sleep_analysis", "seconds"), ("body_temperature", "celsius"),
]

# Names of built-in speakers, which do not count as headphones.
BUILTIN_SPEAKERS = [
    "macbook pro speakers", "macbook air speakers", "macbook speakers", "built-in output",
    "built-in speaker", "internal speakers", "display audio", "imac speakers", "mac mini",
    "mac pro speakers", "mac studio speakers",
]
# Kinds and makers of headphones among wireless devices.
HEADPHONE_KINDS = "(?i)headphone|headset|speaker|earphone"
HEADPHONE_NAMES = "(?i)airpod|beats|bose|sony|jabra|sennheiser"

# The session every element offers.
SESSION_SECONDS, BREATHS_PER_MINUTE = 300, 6.0


def elements(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(ELEMENT_ROWS, ELEMENT_COLUMNS))


def quadrants(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(QUADRANT_ROWS, "quadrant string, quadrant_label string, quadrant_description string"))


def metrics(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(METRIC_ROWS, "metric_type string, unit string"))
