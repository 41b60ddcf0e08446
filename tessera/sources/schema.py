"""Explicit schemas. Records are never schema-inferred."""

from pyspark.sql import types as T

_S = T.StringType()

# Raw case record (one JSON object per line). ``legal_base`` is kept as raw JSON text
# (two nested shapes) and normalised by ``functions.citations``; dates are read as
# strings and converted with ``try_to_date``. Unknown keys are ignored.
CASE_SCHEMA = T.StructType([
    T.StructField("doc_id", _S), T.StructField("case_id", _S), T.StructField("case_name", _S),
    T.StructField("content", _S), T.StructField("basics_text", _S), T.StructField("tf_content", _S),
    T.StructField("publish_date", _S), T.StructField("upload_date", _S), T.StructField("trial_date", _S),
    T.StructField("trial_round", _S), T.StructField("case_type", _S), T.StructField("settle_type", _S),
    T.StructField("cause", _S), T.StructField("court_name", _S), T.StructField("court_province", _S),
    T.StructField("court_city", _S), T.StructField("court_region", _S), T.StructField("court_district", _S),
    T.StructField("pub_prosecution_org", _S), T.StructField("lawyer", _S), T.StructField("law_firm", _S),
    T.StructField("appellor", _S), T.StructField("admin_behavior_type", _S), T.StructField("admin_manage_scope", _S),
    T.StructField("effect_level", _S), T.StructField("legal_base", _S),
    T.StructField("judge_record_text", _S), T.StructField("judge_result_text", _S), T.StructField("judge_member_text", _S),
    T.StructField("abbr_adjudication_text", _S), T.StructField("case_skb_text", _S), T.StructField("judge_reson_text", _S),
    T.StructField("additional_text", _S), T.StructField("correction_text", _S), T.StructField("private_reason", _S),
    T.StructField("crawl_time", _S), T.StructField("browse_count", _S),
])

VECTOR_TYPE = T.ArrayType(T.FloatType(), containsNull=False)
