"""Small fixed dimensions: taxonomy, stage order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: pattern id, family, severity weight, cross-stage, temporal
TAXONOMY = (
    ("anchoring.reference_price", "anchoring", 0.55, False, False),
    ("pricing.charm", "pricing", 0.20, False, False),
    ("pricing.drip", "pricing", 0.95, True, False),
    ("scarcity.stock", "scarcity", 0.65, False, False),
    ("urgency.countdown", "urgency", 0.70, False, False),
    ("defaults.preselected", "defaults", 0.80, False, False),
    ("social_proof.live_activity", "social_proof", 0.70, False, False),
    ("confirmshaming.decline_copy", "confirmshaming", 0.60, False, False),
    ("goal_gradient.threshold", "goal_gradient", 0.55, False, False),
    ("interference.visual_asymmetry", "interference", 0.75, False, False),
    ("decoy.asymmetric_dominance", "decoy", 0.60, False, False),
    ("nagging.repeat_interstitial", "nagging", 0.50, False, False),
    ("framing.savings_ratio", "framing", 0.45, False, False),
    ("loss_aversion.exit_intent", "loss_aversion", 0.50, False, False),
    ("basket.sneak", "basket", 0.95, True, False),
    ("temporal.evergreen_countdown", "temporal", 1.0, False, True),
    ("temporal.stock_nonmonotonic", "temporal", 0.9, False, True),
    ("temporal.reference_price_ungrounded", "temporal", 1.0, False, True),
    ("temporal.social_proof_synthetic", "temporal", 0.85, False, True),
)
# fixed values: funnel stages in order
STAGES = ("browse", "pdp", "cart", "checkout", "payment")
LOG_THRESHOLD, SURFACE_THRESHOLD = 0.35, 0.75
GATE_MS, EPHEMERAL_GATE_MS = 800, 400
RULEPACK_VERSION = "1.0.1"


def taxonomy(spark: SparkSession) -> DataFrame:
    """The taxonomy as a DataFrame; a fixed handful of rows."""
    rows = ", ".join(f"('{i}', '{f}', double({w}))" for i, f, w, _, _ in TAXONOMY)
    return spark.sql(f"select * from values {rows} as t(pattern_id, family, severity)")


def stage_order(stage: Column) -> Column:
    return F.coalesce(*(F.when(stage == name, F.lit(k)) for k, name in enumerate(STAGES)))
