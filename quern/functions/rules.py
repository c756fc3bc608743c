"""The word lists and patterns of document review, as data.

Operators take a rule set as a parameter; REVIEW is the one for Chinese
construction plans, ENGLISH a small one over ASCII words.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ReviewRules:
    """Signals by name, topics in order, and routing rules as (domain, code, pattern, classes)."""

    number_with_unit: str
    numeric_control: str
    obligation: str
    inspection: str
    safety: str
    procedure: str
    material: str
    structural: str
    context: str
    topics: tuple[tuple[str, str], ...]
    general_topic: str
    domains: tuple[tuple[str, str, str, tuple[str, ...]], ...] = ()
    least_obligation: int = 4
    signals: tuple[str, ...] = field(default=("number_with_unit", "numeric_control", "obligation", "inspection", "safety", "procedure", "material", "structural"))

    def any_signal(self) -> str:
        return "|".join(f"(?:{getattr(self, s)})" for s in self.signals)


CLASSES = (
    "NUMERIC_CONTROL", "INSPECTION_REQUIREMENT", "MATERIAL_REQUIREMENT", "SAFETY_REQUIREMENT",
    "STRUCTURAL_CONFIGURATION", "PROCEDURAL_REQUIREMENT", "CONSTRUCTION_REQUIREMENT", "UNRESOLVED",
)

REVIEW = ReviewRules(
    number_with_unit=r"(?i)(?<![\d.])[+-]?(?:\d+(?:\.\d+)?|\.\d+)\s*(?:MPa|kPa|kN|mm|cm|N|m|%|°|℃|毫米|厘米|千牛|兆帕|千帕|米)(?![A-Za-z])",
    numeric_control="不(?:得)?(?:大于|小于|超过|高于|低于)|至少|至多|最大不得超过|最小不得低于|控制在|控制值|上限|下限|应达到|应满足",
    obligation="不得|严禁|必须|应当|需要|宜|应",
    inspection="检查|验收|检测|监测|复核",
    safety="安全|防护|临边|坠落|消防|警戒",
    procedure="安装|拆除|搭设|施工|浇筑|吊装|开挖|回填|顺序|工序",
    material="材料|钢管|混凝土|钢筋|水泥|砂浆|型钢|扣件|木材|强度等级",
    structural="立杆|水平杆|剪刀撑|连墙件|模板支撑|脚手架|支撑架|梁|柱|节点",
    context="施工|作业|安装|拆除|搭设|浇筑|开挖|回填|模板|脚手架|支撑|钢管|混凝土|钢筋|构件|材料|设备|人员|现场|工序|管理",
    topics=(
        ("可调托撑", "可调托撑"), ("立杆", "立杆"), ("水平杆", "水平杆"), ("剪刀撑", "剪刀撑"), ("连墙件", "连墙件"),
        ("模板支撑", "模板支撑|支撑架"), ("钢管", "钢管"), ("脚手架", "脚手架"), ("材料", "材料|混凝土|钢筋|水泥|砂浆|型钢|扣件|木材"),
        ("施工荷载", "施工荷载|荷载"), ("安全防护", "安全|防护|临边|坠落|消防|警戒"), ("检查验收", "检查|验收|检测|监测|复核"),
    ),
    general_topic="一般审查目标",
    domains=(
        (
            "scaffold_and_support", "GB55023-2022",
            r"可调托撑|脚手架|模板支撑|支撑架|剪刀撑|连墙件|立杆(?=[^。；，,\n]{0,30}(?:钢管|间距|水平杆|支撑))|(?:钢管|间距|水平杆|支撑)[^。；，,\n]{0,30}立杆",
            CLASSES[:-1],
        ),
    ),
)

ENGLISH = ReviewRules(
    number_with_unit=r"[0-9]+(?:\.[0-9]+)?(?:%|#)",
    numeric_control="that|from",
    obligation="the|der|les",
    inspection="and|und",
    safety="was|ist",
    procedure="with|mit",
    material="for|des",
    structural="this|das",
    context="of|en|in",
    topics=(("articles", "The|Der"), ("links", "And|Und"), ("places", "In|Im")),
    general_topic="general",
    domains=(("plain", "S1", "tion", CLASSES), ("german", "S2", "keit|heit", CLASSES[:4]), ("french", "S3", "ment", CLASSES)),
)

#: Operators in the order of their patterns; the worded ones come first.
NUMBER = r"[+-]?(?:\d+(?:\.\d+)?|\.\d+)"
UNIT = r"(?:%|℃|°C|[A-Za-zµμ]+|毫米|厘米|千米|米|千克|公斤|吨|分钟|小时|秒|度)"
NUMERIC_LIMITS = (
    ("<=", r"(?:不得超过|不应超过|不得大于|不应大于|不大于|至多|小于或等于|小于等于|must\s+not\s+exceed|shall\s+not\s+exceed|no\s+more\s+than)"),
    (">=", r"(?:不得低于|不应低于|不得小于|不应小于|不小于|至少|大于或等于|大于等于|at\s+least|not\s+less\s+than)"),
    ("<", r"(?:应小于|必须小于|shall\s+be\s+less\s+than|must\s+be\s+less\s+than)"),
    (">", r"(?:应大于|必须大于|shall\s+be\s+greater\s+than|must\s+be\s+greater\s+than)"),
    ("=", r"(?:应等于|必须等于|应为|必须为|shall\s+equal|must\s+equal)"),
    ("<=", "(?:<=|≤)"),
    (">=", "(?:>=|≥)"),
    ("<", "(?<![<>=])<"),
    (">", "(?<![<>=])>"),
    ("=", "(?<![<>=])="),
)
CONDITION = r"(?i)(?:^|[，,；;。.]\s*)(?:当|若|如果|if\b|when\b)"
EXCEPTION = "除外|但|除[^，。；;]{0,20}外|特殊情况"
NORMATIVE_CUE = r"(?i)不得|禁止|不应|应当|应|必须|shall\b|must\b"
NUMBERED_ITEM = r"(?:^|\n)\s*(?:\d+[、.)）]|[（(]\d+[)）])"

#: Reasons to reject a clause as a plan fact, in order.
CLAUSE_REJECTS = (
    ("CONDITIONAL_UNSUPPORTED", "当|若|如果|时[，,]"),
    ("LOCATION_QUALIFIER_UNSUPPORTED", "处|部位|范围内|位置"),
    ("PROHIBITED_VALUE_NOT_FACT", "严禁采用|不得采用|禁止使用"),
    ("COMPOUND_DIMENSION_UNSUPPORTED", rf"{NUMBER}\s*[×xX*]\s*{NUMBER}"),
    ("RANGE_UNSUPPORTED", rf"{NUMBER}\s*(?:[-~～至到])\s*{NUMBER}"),
)
ASSERTIONS = (
    ("UPPER_BOUND_CONTROL", "≤|<=|不(?:得)?(?:大于|超过|高于)|至多|上限"),
    ("LOWER_BOUND_CONTROL", "≥|>=|不(?:得)?(?:小于|低于)|至少|下限"),
    ("DESIGN_CONTROL", "设计|控制为|取值"),
    ("EXACT_VALUE", "为|采用|="),
)

#: Consistency review: object and parameter profiles (name, anchors in order), units and assertions in order.
OBJECTS = (
    ("SUPPORT_STRUCTURE", ("支护结构",)), ("RETAINING_WALL", ("围护墙",)), ("CROWN_BEAM", ("冠梁",)), ("UPRIGHT_MEMBER", ("立杆",)),
    ("HORIZONTAL_MEMBER", ("水平杆",)), ("EXCAVATION", ("开挖",)), ("STEEL_SUPPORT", ("钢支撑",)), ("ANGLE_WELD", ("角焊缝",)),
)
PARAMETERS = (
    ("HORIZONTAL_DISPLACEMENT_ALARM_VALUE", ("水平位移", "报警值")), ("HORIZONTAL_DISPLACEMENT_PREWARNING_VALUE", ("水平位移", "预警值")),
    ("HORIZONTAL_DISPLACEMENT_CONTROL_VALUE", ("水平位移", "控制值")), ("SPACING", ("间距",)), ("STEP_SPACING", ("步距",)), ("THICKNESS", ("厚度",)),
    ("DEPTH", ("深度",)), ("HEIGHT", ("高度",)), ("SUPPORT_AXIAL_FORCE", ("轴力",)), ("MONITORING_FREQUENCY", ("监测频率",)),
)
CONSISTENCY_NUMBER = r"(?<![\d.])[+-]?(?:\d+(?:\.\d+)?|\.\d+)"
CONSISTENCY_UNIT = r"(?i)(?<![\d.])([+-]?(?:\d+(?:\.\d+)?|\.\d+))\s*(MPa|kPa|kN|mm|cm|N|m|%|℃)(?![A-Za-z])"
CONSISTENCY_ASSERTIONS = (
    ("UPPER_BOUND_CONTROL", "≤|<=|不(?:得)?(?:大于|超过|高于)|不大于|不超过|至多|上限|控制在[^，。！？；;]{0,30}以内"),
    ("LOWER_BOUND_CONTROL", "≥|>=|不(?:得)?(?:小于|低于)|不小于|不低于|至少|下限"),
    ("EXACT_MEASURED_VALUE", "(?:实测|测得|测量值|监测值)[^，。！？；;]{0,30}(?:控制为|取值为|为|=)"),
    ("DECLARED_CONTROL_VALUE", "(?:报警值|预警值|控制值|设计值)[^，。！？；;]{0,40}(?:控制为|取值为|为|=)|(?:间距|步距|厚度|深度|高度|轴力|监测频率)[^，。！？；;]{0,24}(?:控制为|取值为|为|采用|=)"),
)
GAP_MOST = 48

#: Completeness: check, evidence kinds for PASS, for PARTIAL, and whether a missing section is MISSING (else NOT_APPLICABLE).
CHECKS = (
    ("CR-001", "chapters > 0 and fields > 0", "chapters > 0 or fields > 0", True),
    ("CR-002", "(chapters > 0 and items >= 1) or (chapters = 0 and items >= 2)", "chapters > 0 or items > 0", True),
    ("CR-003", "chapters > 0 and fields > 0", "chapters > 0 or fields > 0", True),
    ("CR-004", "broad > 0 or components >= 2", "components > 0", True),
    ("CR-005", "chapters > 0 and items > 0", "chapters > 0 or items > 0", True),
    ("CR-006", "items >= 3 and chapters > 0", "items > 0", True),
    ("CR-007", "chapters > 0 and flag", "chapters > 0 or flag", True),
    ("CR-008", "chapters > 0 and flag", "chapters > 0 or flag", True),
    ("CR-009", "chapters > 0 and flag", "chapters > 0 or flag", False),
    ("CR-010", "chapters > 0 and flag", "chapters > 0 or flag", True),
    ("CR-011", "broad > 0 and components > 0", "broad > 0 or components > 0 or chapters > 0", True),
    ("CR-012", "chapters > 0 and components > 0", "chapters > 0 or components > 0 or broad > 0", True),
    ("CR-013", "chapters > 0", "components > 0", False),
    ("CR-014", "chapters > 0", "components > 0", False),
)

#: Chapter titles that are evidence, by check and kind.
CHAPTER_EVIDENCE = (
    ("CR-001", "chapters", "工程概况|项目概况|工程简介"),
    ("CR-002", "chapters", "编制依据|编制说明及依据|依据文件|主要规范标准"),
    ("CR-003", "chapters", "施工计划|施工进度|进度计划|工期计划"),
    ("CR-004", "broad", "施工准备|施工部署|前期准备"),
    ("CR-004", "components", "技术准备|材料准备|人员准备|劳动力准备|机具准备|机械.*准备"),
    ("CR-005", "chapters", "材料.*(?:计划|准备)|主要材料|材料与设备|主要机具|施工机械|设备.*计划"),
    ("CR-006", "chapters", "施工工艺|施工方法|工艺流程|安装施工|施工工艺技术"),
    ("CR-007", "chapters", "质量保证(?:措施|体系)|质量管理(?:措施|体系)|质量控制(?:措施)?|质量标准"),
    ("CR-008", "chapters", "安全(?:生产)?保证措施|安全技术措施|安全管理(?:措施|体系)|安全保证体系"),
    ("CR-009", "chapters", "应急处置|应急预案|应急救援|应急措施|事故应急|应急响应|应急组织"),
    ("CR-010", "chapters", "文明施工|绿色施工|环境保护|环保措施|扬尘控制|噪声控制|水土保持"),
    ("CR-011", "broad", "施工组织(?:管理|机构)?|项目组织机构|管理组织机构"),
    ("CR-011", "components", "岗位职责|人员职责|职责分工"),
    ("CR-011", "chapters", "项目管理人员|劳动力配置|劳动力计划|人员配置|管理人员表"),
    ("CR-012", "chapters", "检查验收|验收要求|验收管理"),
    ("CR-012", "components", "验收程序|验收条件|验收人员|验收内容|验收流程|验收记录|验收标准"),
    ("CR-012", "broad", "验收合格后|经.*验收.*合格|报.*验收"),
    ("CR-013", "chapters", "监测监控|监测方案|施工监测|变形监测|沉降监测|位移监测|监控量测"),
    ("CR-013", "components", "(?:变形|沉降|位移|应力|挠度).{0,10}(?:监测|量测)|(?:监测|量测).{0,10}(?:变形|沉降|位移|应力|挠度)"),
    ("CR-014", "chapters", "计算书|附图及计算书|设计计算|验算|计算分析|荷载计算"),
    ("CR-014", "components", "经计算|计算结果|计算复核"),
)
#: Fields of an analysis that are evidence, by the start of their path.
FIELD_EVIDENCE = (
    ("CR-001", "fields", "project."), ("CR-003", "fields", "schedule."), ("CR-002", "items", "compilation_basis["), ("CR-005", "items", "main_materials["), ("CR-006", "items", "main_methods["),
    ("CR-007", "flag", "section_presence.quality"), ("CR-008", "flag", "section_presence.safety"), ("CR-009", "flag", "section_presence.emergency"), ("CR-010", "flag", "section_presence.environment"),
)
#: Fixed value: the check that only special plans must pass.
SPECIAL_CHECK = "CR-009"
