"""Deterministic checks of proposed decisions: context, validation, consistency.

Each rule reads the state that the rules before it left, so the chain is a
sequence of column definitions over one row: text, the decision's fields and its
evidence.  No rule needs a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.text import contains_any, first_filled, grouped_summary, ordered_distinct, sentences, squeeze, strip

# Districts in the order of the context's first match, keywords of
# other areas, and the districts in the order of the first rule.
DISTRICTS = ["白云区", "越秀区", "海珠区", "荔湾区", "天河区", "黄埔区", "花都区", "番禺区", "南沙区", "从化区", "增城区"]
OTHER_AREAS = [
    "深圳市", "佛山市", "东莞市", "中山市", "珠海市", "惠州市", "江门市", "肇庆市", "广东省",
    "越秀区", "海珠区", "荔湾区", "天河区", "黄埔区", "花都区", "番禺区", "南沙区", "从化区", "增城区",
]
NAMED_DISTRICTS = ["白云区", "天河区", "越秀区", "海珠区", "荔湾区", "黄埔区", "番禺区", "花都区", "南沙区", "从化区", "增城区"]
SPECIAL_AREAS = ["人和镇周口", "空港经济区", "机场控制区"]
STATUSES = ["supported", "needs_fact_check", "multi_agency"]
HISTORY = "historical_cases"


def first_match(text: Column, names: list[str]) -> Column:
    out = F.lit(None).cast("string")
    for name in reversed(names):
        out = F.when(text.contains(name), F.lit(name)).otherwise(out)
    return out


def case_context(df: DataFrame, text: str = "content", districts: list[str] = DISTRICTS, default: str = "白云区",
                 other: list[str] = OTHER_AREAS, inside: str = "广州市白云区", outside: str = "非白云区（需核实转派范围）") -> DataFrame:
    """Adds explicit_district, outside_default_jurisdiction and case_jurisdiction."""
    flat = squeeze(F.coalesce(F.col(text), F.lit("")))
    district = first_match(flat, districts)
    is_out = F.when(district.isNotNull(), district != default).otherwise(contains_any(flat, other))
    return df.withColumns({
        "explicit_district": district,
        "outside_default_jurisdiction": is_out,
        "case_jurisdiction": F.when(is_out, outside).otherwise(inside),
    })


def checked_items(items: Column, evidence: Column) -> Column:
    """Items (evidence_id, claim, quote) whose quote stands in the evidence they name;
    history is no direct basis.  evidence: array<struct<evidence_id,
    knowledge_base_id, document_title, content>>."""
    def source(e: Column) -> Column:
        head = F.trim(F.regexp_extract(e["content"], r"(?m)^##\s+(.+?)\s*$", 1))
        label = F.coalesce(F.nullif(head, F.lit("")), F.nullif(e["document_title"], F.lit("")), F.lit("职责来源"))
        return F.when(label.startswith("区"), F.concat(F.lit("白云"), label)).otherwise(label)

    def found(i: Column) -> Column:
        return F.get(F.filter(evidence, lambda e: e["evidence_id"] == i["evidence_id"]), 0)

    def valid(i: Column) -> Column:
        e = found(i)
        filled = (strip(i["evidence_id"]) != "") & (strip(i["claim"]) != "") & (strip(i["quote"]) != "")
        return F.coalesce(
            filled & (F.length(strip(i["quote"])) >= 8) & e["content"].contains(i["quote"]) & (e["knowledge_base_id"] != HISTORY),
            F.lit(False),
        )

    return F.transform(F.filter(items, valid), lambda i: F.struct(
        i["evidence_id"].alias("evidence_id"), source(found(i)).alias("source"), i["claim"].alias("claim"), i["quote"].alias("quote")))


def validate(df: DataFrame) -> DataFrame:
    """Adds ``reject`` (the first reason, or null) and normalises the lists.

    df: department, conclusion, refs, confidence, status, collaborators, facts,
    items, evidence."""
    known = F.transform("evidence", lambda e: e["evidence_id"])
    reject = (
        F.when(F.col("department").isNull() | F.col("conclusion").isNull() | F.col("refs").isNull(), "missing field")
        .when(F.size(F.array_except("refs", known)) > 0, "unknown evidence")
        .when(F.col("confidence").isNotNull() & ~F.col("confidence").between(0.0, 1.0), "confidence")
        .when(~F.coalesce("status", F.lit("needs_fact_check")).isin(STATUSES), "status")
        .when(strip(F.col("department")) == "", "empty department")
        .when(strip(F.col("conclusion")) == "", "empty conclusion")
    )
    return df.withColumns({
        "reject": reject,
        "status": F.coalesce("status", F.lit("needs_fact_check")),
        "authority": F.nullif("authority", F.lit("")),
        "boundary": F.nullif("boundary", F.lit("")),
        "risk": F.nullif("risk", F.lit("")),
        "collaborators": ordered_distinct(F.coalesce("collaborators", F.array().cast("array<string>"))),
        "facts": ordered_distinct(F.coalesce("facts", F.array().cast("array<string>"))),
        "items": checked_items(F.col("items"), F.col("evidence")),
        "refs": F.array_distinct("refs"),
    })


def capped(confidence: Column, cap: float) -> Column:
    return F.least(F.coalesce(confidence, F.lit(cap)), F.lit(cap))


def unit(c: Column) -> Column:
    """A unit's name for comparison: without brackets, city and prefix."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"[（(].*?[）)]", "")
    return squeeze(F.replace(F.replace(bare, F.lit("广州市"), F.lit("")), F.lit("人民政府-"), F.lit("")))


def consistency(df: DataFrame, text: str = "content") -> DataFrame:
    """The ordered rules on validated decisions (columns as in ``validate``)."""
    t = F.coalesce(F.col(text), F.lit(""))
    facts, conf, status = F.col("facts"), F.col("confidence"), F.col("status")
    check = F.lit("needs_fact_check")

    # several districts in the text: nothing is decided before the place is known
    named = F.filter(F.array(*[F.when(t.contains(d), F.lit(d)) for d in NAMED_DISTRICTS]), lambda x: x.isNotNull())
    df = df.withColumn("_named", F.array_join(named, "、")).withColumn("_many", F.size(named) > 1)
    many, names = F.col("_many"), F.col("_named")
    fact = F.concat(F.lit("工单同时出现"), names, F.lit("，须先核实准确属地"))
    df = df.withColumns({
        "facts": F.when(many, F.concat(F.array(fact), F.filter(facts, lambda x: x != fact))).otherwise(facts),
        "status": F.when(many, check).otherwise(status),
        "confidence": F.when(many, capped(conf, 0.3)).otherwise(conf),
        "department": F.when(many, "暂不确定（须先核实准确属地）").otherwise(F.col("department")),
        "authority": F.when(~many, F.col("authority")),
        "collaborators": F.when(many, F.array().cast("array<string>")).otherwise(F.col("collaborators")),
        "conclusion": F.when(many, F.concat(
            F.lit("工单同时出现"), names,
            F.lit("，现有信息无法可靠确定事项实际所在地。历史案例只能作为受理经验，不能替代本案地址核实；建议先确认准确区、镇街和具体点位，再按实际所在地及事项类型确定首派和业务主管单位。"),
        )).otherwise(F.col("conclusion")),
        "boundary": F.when(many, "在准确属地确认前，不宜指定具体区级部门或镇街承担本案职责。").otherwise(F.col("boundary")),
        "risk": F.when(many, "应优先核实事发位置，避免跨区误派和重复转派；如事项正在发生，可先记录现场证据并联系实际所在地热线。").otherwise(F.col("risk")),
    })

    # special areas; decisions that rest on history alone
    cited = F.filter("evidence", lambda e: F.array_contains("refs", e["evidence_id"]))
    only_history = (F.size("refs") > 0) & ~F.exists(cited, lambda e: e["knowledge_base_id"] != HISTORY)
    for when, fact in (
        (contains_any(squeeze(t), SPECIAL_AREAS), "须核实是否位于空港经济区等特殊管理区域及其实际管辖边界"),
        (only_history, "当前首派主要依据历史同类受理记录，仍需核实现行职责及具体管辖"),
    ):
        df = df.withColumns({
            "facts": F.when(when, F.array_distinct(F.concat(facts, F.array(F.lit(fact))))).otherwise(facts),
            "status": F.when(when, check).otherwise(status),
            "confidence": F.when(when, capped(conf, 0.6)).otherwise(conf),
        })

    # what the state of facts, status and partners implies
    df = df.withColumn("status", F.when((F.size("facts") > 0) & (status == "supported"), check).otherwise(status))
    df = df.withColumn("confidence", F.when(status == check, capped(conf, 0.7)).otherwise(conf))
    df = df.withColumn("status", F.when((F.size("collaborators") > 0) & (status == "supported"), "multi_agency").otherwise(status))
    owned = F.concat(F.array_join("facts", " "), t).rlike("权属|移交|路灯编号")
    lights = t.rlike("路灯|道路照明|照明设施") & owned
    df = df.withColumns({
        "status": F.when(lights, check).otherwise(status),
        "confidence": F.when(lights, capped(conf, 0.7)).otherwise(conf),
    })

    # partners that are the main unit; risks and evidence that the text does not support
    primary = F.filter(F.array(unit(F.col("department")), unit(F.col("authority"))), lambda x: x != "")
    df = df.withColumn("collaborators", F.filter("collaborators", lambda c: ~F.array_contains(primary, unit(c))))
    fraud, crowd = t.rlike("诈骗|骗取|冒充|欺诈"), t.rlike("聚集|群体|多人讨薪|冲突|威胁|情绪激动")

    def unsupported(s: Column) -> Column:
        return (~fraud & contains_any(s, ["诈骗", "报案", "公安机关"])) | (~crowd & contains_any(s, ["群体性", "情绪激动", "维稳"]))

    kept = strip(F.array_join(F.filter(sentences(F.col("risk")), lambda s: ~unsupported(s)), ""))
    df = df.withColumn("risk", F.when(fraud & crowd, F.col("risk")).otherwise(F.nullif(kept, F.lit(""))))
    for pattern, phrase in (("公共秩序|聚集|群体|冲突", "严重影响公共秩序事件"), ("托幼|幼儿园|卫生室", "托幼机构"), ("职业健康检查", "职业健康检查")):
        df = df.withColumn("items", F.filter("items", lambda i: t.rlike(pattern) | ~i["quote"].contains(phrase)))

    # a named town settles the place
    town = F.coalesce(
        F.nullif(F.regexp_extract(t, r"白云区([\x{4e00}-\x{9fff}]{1,6}(?:街|镇))", 1), F.lit("")),
        F.nullif(F.regexp_extract(t, r"(?U)(?:^|[，,。；;\s])([\x{4e00}-\x{9fff}]{1,6}(?:街|镇))", 1), F.lit("")),
    )
    generic = F.col("department").rlike("属地(?:街道办事处|镇人民政府|街道|镇街)")
    df = df.withColumns({
        "facts": F.when(town.isNotNull(), F.filter("facts", lambda f: ~(f.rlike("确定|确认|明确") & f.rlike("属地|镇街")))).otherwise(facts),
        "department": F.when(
            town.isNotNull() & generic,
            F.when(town.endswith("街"), F.concat(town, F.lit("道办事处"))).otherwise(F.concat(town, F.lit("人民政府"))),
        ).otherwise(F.col("department")),
    })

    # schooling: without evidence, a line of the department's own duties
    terms = ["义务教育", "基础教育", "招生", "教育"]

    def hits(line: Column) -> Column:
        out = F.lit(0)
        for x in terms:
            out = out + F.when(line.contains(x), 1).otherwise(0)
        return out

    def label(e: Column) -> Column:
        head = strip(F.regexp_extract(e["content"], r"(?m)^##\s+(.+?)\s*$", 1))
        return F.when(head.startswith("区"), F.concat(F.lit("白云"), head)).otherwise(head)

    def lines(e: Column) -> Column:
        stripped = F.transform(F.split(e["content"], r"\r\n|\r|\n"), strip)
        return F.filter(stripped, lambda x: (F.length(x) >= 12) & x.rlike("义务教育|基础教育|招生计划|教育招生"))

    duty = F.get(F.filter("evidence", lambda e: (
        (e["knowledge_base_id"] == "department_duties") & (label(e) != "")
        & (unit(label(e)) == unit(F.col("department"))) & (F.size(lines(e)) > 0))), 0)
    best = F.aggregate(lines(duty), F.lit("").cast("string"), lambda b, x: F.when((b == "") | (hits(x) > hits(b)), x).otherwise(b))
    df = df.withColumn("_duty", duty).withColumn("_quote", F.when(F.col("_duty").isNotNull(), best))
    school = (F.size("items") == 0) & t.rlike("教育|学位|入学|招生|公办小学") & F.col("_duty").isNotNull()
    own = F.array(F.struct(
        F.col("_duty.evidence_id").alias("evidence_id"), label(F.col("_duty")).alias("source"),
        F.lit("该部门原文职责直接支持教育事项承办判断").alias("claim"), F.col("_quote").alias("quote")))
    df = df.withColumns({
        "items": F.when(school, own).otherwise(F.col("items")),
        "refs": F.when(school, F.array_distinct(F.concat("refs", F.array("_duty.evidence_id")))).otherwise(F.col("refs")),
        "facts": F.array_distinct("facts"),
    })
    return df.drop("_named", "_many", "_duty", "_quote")


# Roles of a record's entries that name a unit, and of those that hold a value.
UNIT_ROLES, VALUE_ROLES = ("first_dispatch", "competent_authority", "collaborating"), ("decision_status", "missing_fact")


def entries(role: str, field: str, *values: Column) -> Column:
    both = {"unit": F.lit(None).cast("string"), "value": F.lit(None).cast("string")}
    return F.array(*[F.struct(F.lit(role).alias("role"), *[(v if n == field else e).alias(n) for n, e in both.items()]) for v in values])


def many(role: str, field: str, values: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.transform(
        F.coalesce(values, F.array().cast("array<string>")),
        lambda v: F.struct(F.lit(role).alias("role"), (v if field == "unit" else none).alias("unit"), (v if field == "value" else none).alias("value")),
    )


def persist(decisions: DataFrame, evidence: DataFrame, key: str = "analysis_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """decisions: key, department, authority, collaborators, status, facts, refs and, if
    there, items (evidence cited: source, quote); evidence: key, evidence_id, what is to
    be kept of it and, if there, arrival.

    (records, citations, rejected): decisions that cite evidence they did not have are
    rejected with these ids; of the others, the record's role-tagged entries with the
    summary of its items, and one citation for each cited id in the order cited.  Of
    several evidences of one id the last counts (by arrival; without one, the greatest)."""
    cited = decisions.select(key, F.posexplode("refs").alias("place", "evidence_id"))
    rest = [c for c in evidence.columns if c not in (key, "evidence_id")]
    last = F.max_by(F.struct(*rest), F.struct(*(["arrival"] if "arrival" in rest else rest))).alias("_last")
    known = evidence.groupBy(key, "evidence_id").agg(last).select(key, "evidence_id", "_last.*") if rest else evidence.distinct()
    unknown = cited.join(known.select(key, "evidence_id"), [key, "evidence_id"], "left_anti")
    # the ids that one decision cites
    rejected = unknown.groupBy(key).agg(F.array_sort(F.collect_set("evidence_id")).alias("unknown"))
    good = decisions.join(rejected.select(key), key, "left_anti")
    roles = F.concat(
        entries("first_dispatch", "unit", F.col("department")), entries("competent_authority", "unit", F.coalesce("authority", F.lit(""))),
        many("collaborating", "unit", F.col("collaborators")), entries("decision_status", "value", F.col("status")), many("missing_fact", "value", F.col("facts")),
    )
    citations = cited.join(good.select(key), key, "left_semi").join(known, [key, "evidence_id"])
    records = good.withColumn("recommended_departments", roles)
    if "items" in decisions.columns:
        records = records.withColumn("evidence_summary", grouped_summary(F.col("items")))
    return records, citations, rejected


# Texts of a rendered result.
UNSURE, NO_PARTNER, NO_FACT = "暂不确定", "无明确协同单位", "- 无"
NO_DUTY = "- 本次未召回可直接证明承办职责的原文依据；历史案例仅供内部参考，不作为直接职责依据展示。"
FOR_REVIEW = "【使用提示】本意见仅供人工复核。"


def rendered(entries: Column, department: Column, confidence: Column, summary: Column, conclusion: Column, boundary: Column, warning: Column) -> Column:
    """A record as Markdown sections; ``entries``: array<struct<role, unit, value>>."""
    def unit_of(role: str) -> Column:
        return F.nullif(F.get(F.filter(entries, lambda e: e["role"] == role), 0)["unit"], F.lit(""))

    def values_of(role: str) -> Column:
        said = F.transform(F.filter(entries, lambda e: e["role"] == role), lambda e: first_filled(e["unit"], e["value"]))
        return F.coalesce(F.array_compact(said), F.array().cast("array<string>"))

    def bold(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}**"), value, F.lit("**"))

    def section(name: str, value: Column, always: bool = True) -> Column:
        lines = F.array(F.lit(""), F.lit(f"【{name}】"), value)
        return lines if always else F.when(first_filled(value).isNotNull(), lines).otherwise(F.array().cast("array<string>"))

    partners, facts = values_of("collaborating"), values_of("missing_fact")
    status = F.nullif(F.get(F.filter(entries, lambda e: e["role"] == "decision_status"), 0)["value"], F.lit(""))
    percent = F.floor(F.coalesce(confidence, F.lit(0.0)) * 100 + 0.5).cast("string")
    asked = F.when(F.size(facts) > 0, F.array_join(F.transform(facts, lambda f: F.concat(F.lit("- "), f)), "\n")).otherwise(NO_FACT)
    lines = F.concat(
        F.array(
            F.lit("【建议承办单位】"), bold("建议首派：", F.coalesce(unit_of("first_dispatch"), F.nullif(department, F.lit("")), F.lit(UNSURE))),
            bold("业务主管：", F.coalesce(unit_of("competent_authority"), F.lit(UNSURE))),
            F.concat(F.lit("协同单位："), F.when(F.size(partners) > 0, F.array_join(partners, "、")).otherwise(NO_PARTNER)),
        ),
        section("决策状态", F.coalesce(status, F.lit("needs_fact_check"))), section("AI置信度", bold("", F.concat(percent, F.lit("%")))),
        section("直接职责依据", F.coalesce(F.nullif(summary, F.lit("")), F.lit(NO_DUTY))), section("待核实条件", asked),
        section("研判说明", F.coalesce(conclusion, F.lit(""))), section("责任边界", boundary, False), section("风险提示", warning, False),
        F.array(F.lit(""), F.lit(FOR_REVIEW)),
    )
    return F.array_join(lines, "\n")
