"""Golden tests of the rule chain, validation, summaries and parsing."""

import hashlib

from pyspark.sql import functions as F

from triagelake.functions import text as T
from triagelake.operators import chunking, quality, rules

DECISION = (
    "content string, department string, authority string, collaborators array<string>, status string, facts array<string>, "
    "items array<struct<evidence_id: string, claim: string, quote: string>>, conclusion string, refs array<string>, boundary string, "
    "confidence double, risk string, evidence array<struct<evidence_id: string, knowledge_base_id: string, document_title: string, content: string>>"
)
LAW = ("e-1", "regulations", "条例", "## 区城管局\n负责处理占道经营投诉并依法查处")
HISTORY = ("e-2", "historical_cases", "案例", "历史案例里的处理情况说明")


def decide(spark, content, **changes):
    row = dict(
        content=content, department="城管局", authority=None, collaborators=[], status="supported", facts=[], items=[], conclusion="结论",
        refs=["e-1"], boundary=None, confidence=0.86, risk=None, evidence=[LAW, HISTORY],
    ) | changes
    df = rules.validate(spark.createDataFrame([tuple(row.values())], DECISION))
    return rules.consistency(df).first()


def test_history_alone_caps_confidence(spark):
    r = decide(spark, "小区垃圾", refs=["e-2"])
    assert (r.status, r.confidence, len(r.facts)) == ("needs_fact_check", 0.6, 1)


def test_direct_basis_stays(spark):
    r = decide(spark, "小区垃圾", collaborators=[" 水务局 ", "", "水务局", "广州市城管局（本级）"])
    assert (r.reject, r.status, r.confidence, r.collaborators) == (None, "multi_agency", 0.86, ["水务局"])


def test_several_districts(spark):
    r = decide(spark, "天河区和白云区交界", collaborators=["水务局"], authority="市局", confidence=None)
    assert r.department.startswith("暂不确定") and r.authority is None and r.collaborators == [] and r.confidence == 0.3
    assert r.facts == ["工单同时出现白云区、天河区，须先核实准确属地"] and r.conclusion.startswith("工单同时出现白云区、天河区")


def test_quotes_are_checked(spark):
    items = [("e-1", "有据", "负责处理占道经营投诉"), ("e-1", "短", "负责处理"), ("e-1", "无", "这句话不在证据原文之中"), ("e-2", "史", "历史案例里的处理情况"), ("e-9", "x", "负责处理占道经营投诉")]
    r = decide(spark, "占道经营", items=items)
    assert [(i.evidence_id, i.source) for i in r["items"]] == [("e-1", "白云区城管局")]


def test_rejects(spark):
    assert decide(spark, "x", refs=["e-7"]).reject == "unknown evidence"
    assert decide(spark, "x", confidence=1.2).reject == "confidence"
    assert decide(spark, "x", status="maybe").reject == "status"
    assert decide(spark, "x", conclusion=" 　").reject == "empty conclusion"
    assert decide(spark, "x", department=None).reject == "missing field"


def test_risk_sentences_and_lights(spark):
    r = decide(spark, "路灯不亮，权属不明", risk="请尽快处理。可能涉及诈骗！注意安全；")
    assert r.risk == "请尽快处理。注意安全；" and r.status == "needs_fact_check" and r.confidence == 0.7
    assert decide(spark, "遭遇诈骗并有冲突", risk="涉及诈骗。").risk == "涉及诈骗。"


def test_named_town(spark):
    r = decide(spark, "白云区同和街有人占道", department="属地街道办事处", facts=["需确认属地", "需核实时间"])
    assert r.department == "同和街道办事处" and r.facts == ["需核实时间"]
    assert decide(spark, "反映，太和镇垃圾", department="属地镇人民政府").department == "太和镇人民政府"


def test_school_fallback(spark):
    duty = ("e-3", "department_duties", "教育", "# 标题\n## 区教育局\n负责全区义务教育招生计划的编制工作\n其他")
    r = decide(spark, "孩子入学学位问题", department="白云区教育局", refs=["e-3"], evidence=[duty])
    assert [i.quote for i in r["items"]] == ["负责全区义务教育招生计划的编制工作"] and r.refs == ["e-3"]


def test_context(spark):
    rows = [("无地址",), ("白 云区和天河区",), ("天河区",), ("广东省内",), (None,)]
    got = [(r.explicit_district, r.outside_default_jurisdiction) for r in rules.case_context(spark.createDataFrame(rows, "content string")).collect()]
    assert got == [(None, False), ("白云区", False), ("天河区", True), (None, True), (None, False)]


def test_grouped_summary(spark):
    items = [("甲局", "负责 市容管理"), ("乙局", "处理噪声"), ("甲局", "市容管理"), ("乙局", "　负责路面"), (None, "其他"), ("丙局", " ")]
    df = spark.createDataFrame([(items,)], "items array<struct<source: string, quote: string>>")
    want = "“甲局”负责：\n\n- 市容管理\n\n“乙局”负责：\n\n- 处理噪声\n- 路面\n\n“职责来源”负责：\n\n- 其他"
    assert df.select(T.grouped_summary(F.col("items")).alias("s")).first().s == want


def test_parse_case(spark):
    text = "# 头\n\n## 标题一\n【诉求类型】\n投诉\n【留言时间】\n2024-05-06 07:08\n【事项内容】\n路灯坏了\n第二行\n——\n【实际承办单位】\n白云区人民政府-同和街\n---\n"
    digest = hashlib.sha256(text.encode()).hexdigest()
    rows = [(f"root/投诉__拆分/00012_题目__{digest[:10]}.md", text), (f"root/咨询__拆分/00013_题__{'0' * 10}.md", text), ("root/x/readme.md", text)]
    good, bad = quality.parse_cases(spark.createDataFrame(rows, "source_path string, text string")).orderBy("seq").collect()
    assert (good.request_type, good.seq, good.title, good.source_case_id) == ("投诉", 12, "标题一", f"HC-投诉-{digest[:10]}")
    assert good.content == "路灯坏了\n第二行" and good.actual_department_raw == "白云区人民政府-同和街" and str(good.event_time) == "2024-05-06 07:08:00" and good.issues == []
    assert len(bad.issues) == 2 and bad.issues[0] == "request_type mismatch: folder=咨询 field=投诉"


def test_department_tiers(spark):
    names = spark.createDataFrame([("水务局", 1), ("广州市白云区人民政府-同和街", 2)], "name string, id int")
    raw = spark.createDataFrame([("水 务局",), ("广州市水务局",), ("白云区人民政府-同和街",), ("白云区政府—x",), ("",), (None,)], "raw string")
    got = quality.tiered_match(raw, "raw", names, quality.department_rewrites())
    assert sorted((r.raw or "", r.matched_id or 0) for r in got.collect()) == [("", 0), ("", 0), ("广州市水务局", 1), ("水 务局", 1), ("白云区人民政府-同和街", 2), ("白云区政府—x", 0)]


def test_chunks_of_a_document(spark):
    body = "标题\n## 一\n" + "甲" * 700 + "。" + "乙" * 500 + "\n## 二\n短"
    docs = spark.createDataFrame([("01_x/a.md", "01_机构职责", body), ("04/b.md", "04_国家法律法规", "总则\n第一条 甲\n第二条 乙"), ("e.md", "c", "")], "source_path string, category string, text string")
    rows = chunking.chunk_documents(docs).orderBy("source_path", "ordinal").collect()
    a = [r for r in rows if r.source_path == "01_x/a.md"]
    assert [r.section for r in a] == ["标题", "## 一", "## 一", "## 二"] and a[1].end - a[1].start == 706 and a[2].start == a[1].end - 120
    assert [r.section for r in rows if r.source_path == "04/b.md"] == ["总则", "第一条 甲", "第二条 乙"]
    assert a[0].chunk_id == hashlib.sha256(f"01_x/a.md:{a[0].start}:{a[0].end}:{hashlib.sha256(body.encode()).hexdigest()}".encode()).hexdigest()
    assert a[1].content.startswith("文件：标题\n类别：01_机构职责\n章节：## 一\n")


def test_metadata_precedence(spark):
    text = "---\n标题: 甲\n来源: 一\n---\n**来源**：二\n**文号**：三\n【文号】\n四\n【日期】\n五\n"
    got = spark.createDataFrame([(text,)], "t string").select("t", chunking.read_front(F.col("t")).alias("f")).select(chunking.metadata(F.col("t"), F.col("f")).alias("m")).first().m
    assert got == {"标题": "甲", "来源": "一", "文号": "三", "日期": "五"}


def test_json_answers(spark):
    rows = [('{"a": 1}',), ("```json\n{\"a\": 2}\n```",), ('text {"a": 3} more',), ("[1]",), ("none",)]
    got = spark.createDataFrame(rows, "t string").select(T.parse_json_object(F.col("t")).alias("v"))
    assert [r.a for r in got.select(F.expr("try_variant_get(v, '$.a', 'int')").alias("a")).collect()] == [1, 2, 3, None, None]


def test_persist(spark):
    rows = [("a1", "城管局", None, ["水务局"], "supported", ["何时"], ["E2", "E1"]), ("a2", "x", "y", [], "supported", [], ["E1", "E9"])]
    decisions = spark.createDataFrame(rows, "analysis_id string, department string, authority string, collaborators array<string>, status string, facts array<string>, refs array<string>")
    evidence = spark.createDataFrame([(a, e, f"{a}{e}") for a in ("a1", "a2") for e in ("E1", "E2")], "analysis_id string, evidence_id string, content string")
    records, citations, rejected = rules.persist(decisions, evidence)
    got = [tuple(x) for x in records.first().recommended_departments]
    assert got == [("first_dispatch", "城管局", None), ("competent_authority", "", None), ("collaborating", "水务局", None), ("decision_status", None, "supported"), ("missing_fact", None, "何时")]
    assert [(r.place, r.content) for r in citations.orderBy("place").collect()] == [(0, "a1E2"), (1, "a1E1")]
    assert [tuple(r) for r in rejected.collect()] == [("a2", ["E9"])] and records.count() == 1


def test_chunk_file(spark):
    """Front matter and its title, offsets in the whole file, both colons, the first of a key, stripped pieces."""
    front = "---\ntitle: 甲法\n部门: '乙局'\ntitle2: \n---\n"
    text = front + "# 头\n**部门**: 丙\n**电话** ： 123 \n**电话**：456\n【文号】\n 一号 \n【长】\n" + "长" * 301 + "\n## 二\n 正文 \n\n"
    docs = spark.createDataFrame([("01/a.md", "01", text), ("01/b.md", "01", "---\n- x\n---\n正文"), ("01/c.md", "01", "#\n"), ("01/d.md", "01", None), ("01/e.md", "01", "")], "source_path string, category string, text string")
    got = {}
    for r in chunking.chunk_documents(docs).orderBy("source_path", "ordinal").collect():
        got.setdefault(r.source_path, []).append(r)
    a = got["01/a.md"]
    assert [(r.title, r.section) for r in a] == [("甲法", "# 头"), ("甲法", "## 二")]
    assert a[0].start == len(front) and text[a[1].start : a[1].end] == "## 二\n 正文"
    assert a[0].metadata == {"title": "甲法", "部门": "乙局", "title2": "", "电话": "123", "文号": "一号"}
    assert a[1].content == "文件：甲法\n类别：01\n章节：## 二\n## 二\n 正文"
    # a list is YAML: the block goes, it gives no metadata
    assert got["01/b.md"][0].start == len("---\n- x\n---\n") and got["01/b.md"][0].title == "正文" and got["01/c.md"][0].title == "c"
    assert not {"01/d.md", "01/e.md"} & set(got)
    sha = hashlib.sha256(text.encode()).hexdigest()
    assert a[1].chunk_id == hashlib.sha256(f"01/a.md:{a[1].start}:{a[1].end}:{sha}".encode()).hexdigest()


YAML_CASES = [
    ("a: 1\nb: [x, 'y z', {k: v}]\nc:\n- p\n- q: 2\n  r: true\nd:\n  e:\n    f: null\n  g: 1.5", {"a": 1, "b": ["x", "y z", {"k": "v"}], "c": ["p", {"q": 2, "r": True}], "d": {"e": {"f": None}, "g": 1.5}}),
    ("# note\ntitle: 甲 # behind\n'quoted: key': \"a\\n\\u4e59\"\n\nlink: http://x/y#z\ndate: 2024-01-05", {"title": "甲", "quoted: key": "a\n乙", "link": "http://x/y#z", "date": "2024-01-05"}),
    ("a: |\n  one\n   two\n\n  three\nb: >-\n  fold\n  ed\nc: more\n  lines here", {"a": "one\n two\n\nthree\n", "b": "fold ed", "c": "more lines here"}),
    ("tags:\n  - a\n  - - b\n    - c\n  -\n    k: v\nflow: {a: [1, 2],\n  b: ~}\nempty:", {"tags": ["a", ["b", "c"], {"k": "v"}], "flow": {"a": [1, 2], "b": None}, "empty": None}),
    ("true: x\n3: y", {"true": "x", "3": "y"}),
]


def test_yaml_blocks():
    import json

    from triagelake.functions import yaml_block

    for text, want in YAML_CASES:
        assert json.loads(yaml_block.as_json(text)) == want, text
    for text in ("- x", "only text", "", "# note", "a: &x 1\nb: *x", "a: !!str 1"):
        assert yaml_block.as_json(text) == "{}", text
    for text in ("a: b: c", "a: 'open", "a: [1, 2", "a:\n\tb: 1", "a: 1\n  b: 2", "a: 1\nfoo", "a: \"x\" y", "a: @x", "a: \"\\q\""):
        assert yaml_block.as_json(text) is None, text


def test_front_matter_of_documents(spark):
    front = "---\ntitle: 甲\ntags:\n- a\n- b\nmap:\n  x: [1]\nnone:\n---\n"
    texts = [("l.md", front + "# 头\n正文"), ("bad.md", "---\na: b: c\n---\n正文"), ("no.md", "正文"), ("none.md", None)]
    docs = spark.createDataFrame([(p, "c", t) for p, t in texts], "source_path string, category string, text string")
    got = {r.source_path: r for r in chunking.chunk_documents(docs).collect()}
    assert got["l.md"].title == "甲" and got["l.md"].start == len(front) and got["l.md"].metadata == {"title": "甲", "tags": '["a","b"]', "map": '{"x":[1]}', "none": ""}
    assert got["bad.md"].title == "---" and got["bad.md"].start == 0 and got["no.md"].title == "正文"
    values = docs.select("source_path", chunking.read_front(F.col("text")).alias("f")).select("source_path", chunking.front_values(F.col("f")).alias("v"))
    tags = values.select("source_path", F.expr("try_variant_get(v, '$.tags[1]', 'string')").alias("t"), F.expr("try_variant_get(v, '$.map.x[0]', 'int')").alias("x"))
    assert {r.source_path: (r.t, r.x) for r in tags.collect()} == {"l.md": ("b", 1), "bad.md": (None, None), "no.md": (None, None), "none.md": (None, None)}


def test_persist_keeps_the_last_and_summarises(spark):
    rows = [("a", "局", None, [], "supported", [], ["E1"], [("甲", "负责 一"), ("甲", "二"), (None, "三"), ("乙", " ")])]
    schema = "analysis_id string, department string, authority string, collaborators array<string>, status string, facts array<string>, refs array<string>, items array<struct<source: string, quote: string>>"
    evidence = spark.createDataFrame([("a", "E1", 1, "old", "z"), ("a", "E1", 2, "new", "a")], "analysis_id string, evidence_id string, arrival int, content string, other string")
    records, citations, _ = rules.persist(spark.createDataFrame(rows, schema), evidence)
    assert [(r.content, r.other) for r in citations.collect()] == [("new", "a")]
    assert records.first().evidence_summary == "“甲”负责：\n\n- 一\n- 二\n\n“职责来源”负责：\n\n- 三"


def test_rendered_results(spark):
    schema = "e array<struct<role: string, unit: string, value: string>>, d string, c double, s string, k string, b string, w string"
    full = [("first_dispatch", "城管局", None), ("competent_authority", "水务局", None), ("collaborating", "街道", None), ("collaborating", None, "村"), ("decision_status", None, "supported"), ("missing_fact", None, "时间")]
    df = spark.createDataFrame([(full, "x", 0.845, "依据", "结论", "边界", ""), ([], None, None, None, "结论", None, "风险")], schema)
    got = [r.t for r in df.select(rules.rendered(*[F.col(c) for c in df.columns]).alias("t")).collect()]
    assert got[0] == (
        "【建议承办单位】\n建议首派：**城管局**\n业务主管：**水务局**\n协同单位：街道、村\n\n【决策状态】\nsupported\n\n【AI置信度】\n**85%**\n\n"
        "【直接职责依据】\n依据\n\n【待核实条件】\n- 时间\n\n【研判说明】\n结论\n\n【责任边界】\n边界\n\n【使用提示】本意见仅供人工复核。")
    assert "建议首派：**暂不确定**\n业务主管：**暂不确定**\n协同单位：无明确协同单位" in got[1] and "**0%**" in got[1] and "【待核实条件】\n- 无" in got[1]
    assert "needs_fact_check" in got[1] and rules.NO_DUTY in got[1] and "【责任边界】" not in got[1] and "【风险提示】\n风险" in got[1]
