from pyspark.sql import functions as F

from tessera.functions.citations import normalize_citations
from tessera.functions.facts import extract_facts
from tessera.operators import prep as pr

# FIXTURES 4.1: (input, extracted, valid, pattern)
GOLDEN_FACTS = [
    ("经审理查明，甲向乙借款。本院认为，应还。", "甲向乙借款。", 1, 3),
    ("公诉机关指控，张某盗窃。公诉机关认为有罪", "张某盗窃。", 1, 9),
    ("无模式", "无模式", 0, 0),
    ("本院查明：本院认为", "", 1, 5),
    ("本院查明：A本院认为B本院认为C", "A本院认为B", 1, 5),
    ("本院认定如下事实，丙欠丁五万元。上述事实有借条为证", "丙欠丁五万元。", 1, 2),
    ("事实和理由：戊违约。本院依照法律", "戊违约。", 1, 7),
    ("检察院指控己受贿。如不服本判决", "受贿。", 1, 10),
    ("经审理\n查明，换行。本院认为", "换行。", 1, 3),
    ("", "", 0, 0),
    ("确认以下基本事实：庚。合议庭评议认为", "庚。", 1, 1),
    ("本院根据上述认证查明：辛。本院经审查认为", "辛。", 1, 5),
]


def test_fact_extraction_golden(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_rest) in enumerate(GOLDEN_FACTS)], "i int, t string")
    rows = {r.i: r for r in df.select("i", extract_facts("t").alias("f")).select("i", "f.*").collect()}
    for i, (_, text, valid, pattern) in enumerate(GOLDEN_FACTS):
        assert (rows[i].text, rows[i].matched, rows[i].pattern) == (text, valid, pattern), GOLDEN_FACTS[i]


def test_validity_rules(spark):
    rows = [
        (1, "事实和理由：甲。本院认为", "无模式", "判决书"),     # basics present: always valid
        (2, None, "无模式", "判决书"),                           # content without a match: invalid
        (3, "", "", None),                                       # nothing: invalid
        (4, None, "经审理查明，乙。本院认为", "民事裁定 书"),   # content match: valid
    ]
    df = spark.createDataFrame(rows, "doc_id int, basics_text string, content string, case_name string")
    out = {r.doc_id: r for r in pr.facts_with_validity(df).collect()}
    assert (out[1].is_valid, out[1].basics_text) == (1, "甲。")
    assert (out[2].is_valid, out[2].basics_text) == (0, None)
    assert out[3].is_valid == 0
    assert (out[4].is_valid, out[4].basics_text, out[4].fact_source) == (1, "乙。", "content")


def test_reject_title_rule(spark):
    titles = ["民事裁定 书", "决定书", None, "判决书"]
    df = spark.createDataFrame([(i, t, "正文", 0) for i, t in enumerate(titles)], "doc_id int, case_name string, content string, is_valid int")
    logged = sorted(r.doc_id for r in pr.filter_rejects(df).collect())
    assert logged == [2, 3]


def test_reject_sample_stops_at_n(spark):
    df = spark.createDataFrame([(i, "判决书", "正文", 0) for i in range(10)], "doc_id int, case_name string, content string, is_valid int")
    assert [r.doc_id for r in pr.reject_sample(df, 4).orderBy("doc_id").collect()] == [0, 1, 2, 3]


GOLDEN_CITATIONS = [
    ('[{"法规名称":"《合同法》","条文":[{"a":"第0条"},{"a":"第二条"}]}]', ["《合同法》第0条", "《合同法》第二条"], False),
    ('[{"fgmc":"《民法》","tkx":"第1条"}]', ["《民法》第1条"], False),
    ('[{"fgmc":"《民法》","tkx":"第三条"},{"zzz":"bad"},{"fgmc":"《刑法》","tkx":"第一条"}]', ["《民法》第三条"], True),
    ("[]", [], False),
    (None, [], False),
]


def test_citation_golden(spark):
    df = spark.createDataFrame([(i, r) for i, (r, *_x) in enumerate(GOLDEN_CITATIONS)], "i int, raw string")
    out = {r.i: r for r in df.select("i", normalize_citations("raw").alias("c")).select("i", "c.*").collect()}
    for i, (_, items, rejected) in enumerate(GOLDEN_CITATIONS):
        assert list(out[i]["items"]) == items and out[i]["rejected"] == rejected


def test_safe_cast_and_defaults(spark):
    df = spark.createDataFrame([(1, "2013-04-13"), (2, "n/a")], "doc_id int, publish_date_raw string")
    out = {r.doc_id: r.publish_date for r in pr.safe_cast(df).collect()}
    assert str(out[1]) == "2013-04-13" and out[2] is None


def test_prep_stats(spark):
    df = spark.createDataFrame([(1,), (0,), (1,)], "is_valid int")
    r = pr.prep_stats(df).first()
    assert (r.kept, r.skipped, r.valid_tf_content_count) == (2, 1, 2)
