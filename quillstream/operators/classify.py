"""Rule classification of episodes: what is worth remembering, as conditions on sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import text as T

#: Type, then remember, relevance, importance, confidence, lifetime, destination.
PROFILES = [
    ("user_preference", True, 0.9, 0.7, 0.8, "long_term", "user"),
    ("decision", True, 0.9, 0.8, 0.8, "long_term", "wiki"),
    ("learning", True, 0.8, 0.7, 0.7, "long_term", "wiki"),
    ("environment", True, 0.8, 0.6, 0.7, "long_term", "wiki"),
    ("configuration", True, 0.8, 0.6, 0.7, "long_term", "wiki"),
    ("noise", False, 0.1, 0.0, 0.9, "transient", "none"),
]
PREFERENCE = r"(?iu)\b(?:i (?:always|never|usually)? ?(?:prefer|like|want|use|hate)|please always|from now on|ich bevorzuge|ich möchte (?:immer|nie)|immer bitte)\b"
CONFIRM = r"(?iu)^\s*(?:yes|yep|ok(?:ay)?|sounds good|agreed|let's do (?:it|that)|go ahead|ja|einverstanden|machen wir)\b"
PROPOSE = r"(?iu)\b(?:i (?:suggest|propose|recommend)|we (?:could|should)|let's|ich schlage vor|wir sollten)\b"
DECIDE = r"(?iu)\b(?:we (?:decided|will go with|chose)|decision:|wir haben (?:beschlossen|entschieden))\b"
NOT = r"(?iu)\b(?:no|not|don't|nein|nicht|kein)\b"
FACT = r"(?iu)\b(?:runs on|is at|listens on|lives in|has \d|port \d|version \d|hostname|läuft auf)\b"


def classify(turns: DataFrame) -> DataFrame:
    """turns (session_id, id, user_text, assistant_text, failed, recovered): id, type and its profile, a row per type
    found, a preference and at most one of the others, else noise. A confirmation needs a proposal in the turn before."""
    w = Window.partitionBy("session_id").orderBy("id")
    said = T.sentences(F.col("user_text"))
    statement = lambda s, p: s.rlike(p) & ~s.endswith("?") & (F.size(F.split(s, r"\s+")) >= 4)
    rows = turns.withColumn("_before", F.lag("assistant_text").over(w)).withColumn("_said", said)
    preference = F.exists("_said", lambda s: statement(s, PREFERENCE))
    decided = F.exists("_said", lambda s: statement(s, DECIDE)) | (F.coalesce(F.col("user_text"), F.lit("")).rlike(CONFIRM) & ~F.col("user_text").rlike(NOT) & F.coalesce(F.col("_before"), F.lit("")).rlike(PROPOSE))
    learned = F.coalesce("failed", F.lit(False)) & F.coalesce("recovered", F.lit(False))
    stated = F.exists("_said", lambda s: statement(s, FACT))
    other = F.when(decided, "decision").when(learned, "learning").when(stated, "environment")
    kinds = F.array_compact(F.array(F.when(preference, "user_preference"), other))
    found = rows.select("session_id", "id", F.explode(F.when(F.size(kinds) > 0, kinds).otherwise(F.array(F.lit("noise")))).alias("type"))
    names = ("remember", "relevance", "importance", "confidence", "lifetime", "destination")
    table = turns.sparkSession.createDataFrame(PROFILES, "type string, remember boolean, relevance double, importance double, confidence double, lifetime string, destination string")
    return found.join(F.broadcast(table), "type").select("session_id", "id", "type", *names)  # six rows
