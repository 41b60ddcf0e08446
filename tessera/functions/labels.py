"""Display labels for record fields and the stop-word rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Record fields in display order with their labels (the detail view shows
# non-empty fields in exactly this order).
FIELD_LABELS: list[tuple[str, str]] = [
    ("publish_date", "发布日期"),
    ("upload_date", "上传日期"),
    ("trial_date", "审理日期"),
    ("trial_round", "审理程序"),
    ("lawyer", "律师"),
    ("law_firm", "律所"),
    ("court_name", "法院名称"),
    ("court_province", "法院省份"),
    ("court_city", "法院地市"),
    ("court_region", "法院区域"),
    ("court_district", "法院区县"),
    ("pub_prosecution_org", "审理机关名称"),
    ("admin_behavior_type", "行政行为种类"),
    ("admin_manage_scope", "行政管理范围"),
    ("case_name", "案件名称"),
    ("case_type", "案件类型"),
    ("appellor", "当事人"),
    ("settle_type", "结案方式"),
    ("cause", "案由"),
    ("basics_text", "案情"),
    ("tf_content", "案情"),
    ("judge_record_text", "诉讼记录"),
    ("judge_result_text", "判决结果"),
    ("judge_member_text", "诉讼参与人"),
    ("abbr_adjudication_text", "裁判要旨"),
    ("case_skb_text", "诉控辩"),
    ("judge_reson_text", "判决理由"),
    ("additional_text", "附加内容"),
    ("correction_text", "补正文书"),
    ("private_reason", "不公开理由"),
    ("legal_base", "法律依据"),
    ("content", "原文"),
]

# The ten facet fields in display order.
FACET_FIELDS: list[str] = [
    "court_name", "court_province", "court_city", "court_region", "court_district",
    "pub_prosecution_org", "trial_round", "case_type", "cause", "legal_base",
]


def is_rule_stop_word(token) -> Column:
    """Default stop-word rule: tokens made only of digits carry no topical signal.

    Word lists are parameters (``stop_words=`` on the operators, or a one-word-per-line
    file read with ``sources.io.read_stop_words``); ``operators.analysis.corpus_stop_words``
    derives one from document frequencies.
    """
    return token.rlike("^[0-9]+$")


def keep_token(token, stop: Column | None) -> Column:
    base = ~is_rule_stop_word(token)
    if stop is None:
        return base
    return base & ~F.array_contains(stop, token)
