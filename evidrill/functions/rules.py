"""Ordered rule tables of the retrieval service, folded into single Catalyst expressions.

A table of rules becomes one ``when`` chain or one product of them, so the plan stays a projection whatever the number
of rules, and can be read in ``explain``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidrill.functions.text import blank, col, contains_any, count_terms

# Terms, keywords, weights and factors that results depend on.
AUTHORITY_WEIGHTS = {"national_pharmacopoeia": 1.0, "clinical_guideline": 0.9, "expert_consensus": 0.7, "textbook": 0.6, "case_report": 0.3, "default": 0.5}
AUTHORITY_KEYWORDS = (
    ("处方集", "national_pharmacopoeia"),
    ("基本药物目录", "national_pharmacopoeia"),
    ("basic_drug", "national_pharmacopoeia"),
    ("诊疗指南", "clinical_guideline"),
    ("诊疗规范", "clinical_guideline"),
    ("肺炎支原体肺炎", "clinical_guideline"),
    ("社区获得性肺炎", "clinical_guideline"),
    ("内科分册", "clinical_guideline"),
    ("指导原则", "clinical_guideline"),
    ("NICE", "clinical_guideline"),
    ("guideline", "clinical_guideline"),
    ("超说明书", "expert_consensus"),
    ("专家共识", "expert_consensus"),
    ("consensus", "expert_consensus"),
)
REQUIRED_TERM_GROUPS = (
    ("阿奇霉素",),
    ("氨溴索", "沐舒坦"),
    ("红霉素",),
    ("罗红霉素",),
    ("克拉霉素",),
    ("阿莫西林",),
    ("美罗培南",),
    ("头孢",),
    ("静脉", "静点", "静注", "静滴", "静脉注射", "静脉滴注"),
)
COMBINATION_TERMS = ("同时", "联合", "联用", "合并", "多种", "两种", "三种", "交替", "一起")
AUDIT_TERMS = ("过敏史", "肝肾功能", "肝功能", "肾功能", "相互作用", "审方", "用药前", "监测")
BOUNDARY_TERMS = ("基本药物目录", "目录", "作为依据", "剂量依据", "治疗依据")
CATALOG_SOURCES = ("基本药物目录", "Essential_Medicines", "Essential Medicines", "Model_List")
CLINICAL_SOURCES = ("诊疗指南", "诊疗规范", "指导原则", "NICE", "guideline", "Guideline")
SAFETY_TERMS = ("联合用药", "抗菌药物联合", "3种及3种以上", "不良反应", "相互作用", "肝肾功能", "用药合理性", "药师", "审核", "combination", "drug interaction", "renal function", "liver function")
FEVER = ("布洛芬", "对乙酰氨基酚", "退热", "发热")
COUGH = ("止咳", "化痰", "祛痰", "咳嗽", "有痰")
ORGANS = ("肝肾功能", "肝功能", "肾功能", "相互作用", "审方")
EXPANSIONS = (
    (FEVER, "ibuprofen paracetamol acetaminophen antipyretic fever simultaneously alternating distress next dose"),
    (COUGH, "acute cough mucolytic antitussive upper respiratory tract infection acute bronchitis"),
    (("过敏史", "过敏", "用药前"), "drug allergy allergy status prescribing dispensing administering penicillin cephalosporin"),
    (("肝肾功能", "肝功能", "肾功能", "相互作用", "多种药物", "审方"), "renal function liver function drug interaction medication review pharmacist prescription order"),
    (("联合", "联用", "合并", "同时", "大环内酯", "头孢"), "antimicrobial combination antibiotic combination adverse reactions macrolide cephalosporin"),
    (("基本药物目录", "剂量依据", "治疗依据", "作为依据"), "essential medicines list formulation dose evidence source scope"),
)
FALLBACKS = (
    (FEVER, "NICE_NG143_Fever_in_under_5s.pdf", ("paracetamol", "ibuprofen", "antipyretic", "fever", "simultaneously", "alternating", "distress")),
    (COUGH, "NICE_NG120_Acute_cough_antimicrobial_prescribing.pdf", ("acute cough", "upper respiratory tract infection", "acute bronchitis", "honey", "self-care", "mucolytic", "antitussive")),
    (("布地奈德", "雾化", "长期", "每天使用", "哮喘"), "NICE_NG245_Asthma_diagnosis_monitoring_management.pdf", ("asthma", "inhaled corticosteroid", "ICS", "budesonide", "review", "monitoring", "dose")),
    (("喘息", "毛细支气管炎", "雾化药物", "抗生素同时"), "NICE_NG9_Bronchiolitis_in_children.pdf", ("bronchiolitis", "antibiotics", "salbutamol", "ipratropium bromide", "systemic or inhaled corticosteroids", "do not use")),
    (("联合", "联用", "合并", "同时", "多种", "头孢", "抗生素"), "抗菌药物临床应用指导原则（2015年版）.pdf", ("联合用药", "抗菌药物联合", "2种", "3种", "不良反应", "单一药物", "联合应用")),
    (("基本药物目录", "剂量依据", "治疗依据", "作为依据"), "国家基本药物目录（2018年版）.pdf", ("国家基本药物目录", "药品名称", "剂型", "规格", "阿奇霉素")),
    (("48-72", "48～72", "48 至 72", "48 小时", "没有好转", "换药", "疗效不佳", "无改善", "再次评估", "治疗无效"), "儿童社区获得性肺炎诊疗规范（2019年版）.pdf", ("48", "72", "再次评估", "症状无改善", "疗效", "抗生素覆盖", "剂量", "耐药", "基础疾病", "并发症")),
    (("肝肾功能", "肝功能", "肾功能", "相互作用", "多种药物", "审方", "药师"), "抗菌药物临床应用指导原则（2015年版）.pdf", ("电子处方系统", "药师审方", "肝肾功能检查结果", "用药医嘱", "临床指南", "药物相互作用", "肾功能不全")),
)
TITLES = ("儿童社区获得性肺炎诊疗规范2019年版", "儿童肺炎支原体肺炎诊疗指南2023年版", "中国儿科超药品说明书用药专家共识", "国家基本药物目录2018年版")
MEDICAL_SIGNALS = ("治疗", "评估", "推荐", "剂量", "疗程", "用药", "抗生素", "症状", "检查", "预防", "接种", "免疫", "住院", "重症", "病原体", "疗效", "给药", "静脉", "口服", "qd", "bid", "mg")
REFERENCE_HEADING = r"(?m)^\s*##\s*[［\[]?\s*参\s*考\s*文\s*献"
PICTURE_PLACEHOLDER = r"(?i)\*\*==>\s*picture\s*\[[^\]]+\]\s*intentionally omitted\s*<==\*\*"
PICTURE_MARKER = r"(?i)\*\*-----\s*(Start|End)\s+of picture text\s*-----\*\*"
TITLE_PUNCTUATION = r"[\s#　，。、《》（）()：:;；·.\-]+"
# Factors by groups; of a group the first row counts whose words are asked for and found: (asked, ((where, any of), ...), factor).
BOOSTS = (
    ((BOUNDARY_TERMS, (("source", CATALOG_SOURCES),), 1.45), (COMBINATION_TERMS + AUDIT_TERMS, (("source", CATALOG_SOURCES),), 0.45)),
    ((COMBINATION_TERMS + AUDIT_TERMS, (("source", CLINICAL_SOURCES),), 1.12),),
    ((FEVER, (("either", ("NICE_NG143", "Fever", "paracetamol", "ibuprofen")),), 1.65),),
    ((COUGH, (("either", ("NICE_NG120", "acute cough", "mucolytic", "antitussive")),), 1.65),),
    ((("过敏",), (("either", ("NICE_CG183", "Drug_allergy", "drug allergy", "过敏史")),), 1.6),),
    ((ORGANS, (("either", ("抗菌药物临床应用指导原则", "肝肾功能", "药师审方", "renal function")),), 1.45),),
    ((ORGANS, (("content", ("电子处方系统", "药师审方", "肝肾功能检查结果", "用药医嘱")),), 1.55),),
    ((("48-72", "48～72", "48 小时", "没有好转", "无改善", "再次评估"), (("source", ("儿童社区获得性肺炎诊疗规范",)), ("content", ("再次评估",)), ("content", ("48",)), ("content", ("72",))), 1.65),),
    (
        (COMBINATION_TERMS, (("content", ("联合用药通常采用",)),), 1.75),
        (COMBINATION_TERMS, (("content", ("联合用药",)), ("content", ("3种", "不良反应亦可能增多"))), 1.75),
        (COMBINATION_TERMS, (("content", ("联合用药", "抗菌药物联合", "combination")),), 1.25),
    ),
)
# What a fallback's share gains beside its words, for sources of a name: (all of these hold one of their words, gain).
FALLBACK_GAINS = {"抗菌药物临床应用指导原则": (((("联合用药通常采用",),), 0.35), ((("3种及3种以上", "3 种及 3 种以上"), ("不良反应亦可能增多",)), 0.25))}
# End of the fixed values.


def first_match(x: str | Column, rules: Sequence[tuple[str, float | str]], default: float | str) -> Column:
    """The value of the first keyword, in the order of the table, that the text holds."""
    t, out = blank(x), None
    for keyword, value in rules:
        hit = F.contains(t, F.lit(keyword))
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def authority_level(source: str | Column, rules: Sequence[tuple[str, str]] = AUTHORITY_KEYWORDS) -> Column:
    return first_match(source, rules, "default")


def authority_weight(source: str | Column, rules: Sequence[tuple[str, str]] = AUTHORITY_KEYWORDS, weights: dict[str, float] = AUTHORITY_WEIGHTS) -> Column:
    return first_match(source, [(k, weights.get(level, weights["default"])) for k, level in rules], weights["default"])


def expand_query(query: str | Column, rules: Iterable[tuple[Sequence[str], str]] = EXPANSIONS) -> Column:
    """The query and, after it, the distinct additions of all rules that it triggers."""
    q = col(query)
    added = F.array_distinct(F.array_compact(F.array(*[F.when(contains_any(q, triggers), F.lit(text)) for triggers, text in rules])))
    return F.when(F.size(added) == 0, q).otherwise(F.concat_ws(" ", q, F.array_join(added, " ")))


def is_broad_review(query: str | Column) -> Column:
    return contains_any(query, (*COMBINATION_TERMS, *AUDIT_TERMS, *BOUNDARY_TERMS))


def has_safety_signal(content: str | Column) -> Column:
    return contains_any(content, SAFETY_TERMS, ignore_case=True)


def required_terms_state(query: str | Column, content: str | Column, groups: Sequence[Sequence[str]] = REQUIRED_TERM_GROUPS) -> tuple[Column, Column]:
    """(any group is required, every required group is met) for a pair of query and content."""
    needed, met = F.lit(False), F.lit(True)
    for group in groups:
        asked = contains_any(query, group)
        needed = needed | asked
        met = met & (~asked | contains_any(content, group))
    return needed, met


def boost(query: str | Column, source: str | Column, content: str | Column, groups: Sequence = BOOSTS) -> Column:
    """The product of one factor of each group of rules, 1 where none of a group holds."""
    where = {"source": blank(source), "content": blank(content)}
    where["either"] = F.concat_ws(" ", where["source"], where["content"])
    out = F.lit(1.0)
    for group in groups:
        factor = F.lit(1.0)
        for asked, found, value in reversed(group):
            holds = reduce(Column.__and__, [contains_any(where[place], words) for place, words in found], contains_any(query, asked))
            factor = F.when(holds, F.lit(value)).otherwise(factor)
        out = out * factor
    return out


def fallback_relevance(rule: tuple[Sequence[str], str, Sequence[str]], content: str | Column) -> Column:
    """min(0.92, 0.52 + 0.40 * lexical share) for a chunk of the rule's source; null where no term is found."""
    _, source, terms = rule
    share = count_terms(content, terms) / F.lit(float(len(dict.fromkeys(t.lower() for t in terms))))
    for name, gains in FALLBACK_GAINS.items():
        for parts, gain in gains if name in source else ():
            share = share + F.when(reduce(Column.__and__, [contains_any(content, words) for words in parts]), gain).otherwise(0.0)
    lexical = F.least(F.lit(1.0), share)
    return F.when(lexical > 0, F.least(F.lit(0.92), F.lit(0.52) + F.lit(0.40) * lexical))


def is_title_only(content: str | Column) -> Column:
    """A chunk that is a heading: short without a medical word, or a known title alone."""
    c = blank(content)
    lines = F.filter(F.transform(F.split(c, r"\R"), lambda x: F.trim(F.trim(F.trim(x), F.lit("#")))), lambda x: F.trim(x) != "")
    filled = F.size(F.filter(F.split(c, r"\R"), lambda x: F.trim(x) != ""))
    compact = F.regexp_replace(F.array_join(lines, ""), TITLE_PUNCTUATION, "")
    signal, title = contains_any(c, MEDICAL_SIGNALS), contains_any(compact, TITLES)
    return (filled == 0) | (compact == "") | (title & (filled <= 2) & ~signal) | (compact.startswith("附录") & title & (F.length(compact) <= 40)) | ((F.length(compact) < 28) & ~signal)


def is_noise(content: str | Column) -> Column:
    """What is never shown as evidence: nothing, reference lists, picture leftovers and bare titles."""
    c = blank(content)
    return (c == "") | c.rlike(REFERENCE_HEADING) | c.rlike(PICTURE_PLACEHOLDER) | c.rlike(PICTURE_MARKER) | is_title_only(c)


# Asking for a prescription, and whom it would be for.
PRESCRIPTION_TERMS = ("开处方", "帮我开处方", "开药", "帮我开药", "处方", "用药方案")
PATIENT_TERMS = ("这个孩子", "患儿", "宝宝", "婴儿", "儿童", "发热", "咳嗽")


def asks_prescription(query: str | Column) -> Column:
    """a question that asks to prescribe for a patient, whatever white space is in it."""
    t = F.regexp_replace(blank(query), r"(?U)\s+", "")
    return contains_any(t, PRESCRIPTION_TERMS) & contains_any(t, PATIENT_TERMS)
