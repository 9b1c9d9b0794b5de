"""Domain profiles: the word lists and thresholds that the rules take as an argument."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Profile:
    """Word lists are matched by containment, in the order given; the first match wins where a rule names one."""

    entity_types: tuple[str, ...]
    critical: tuple[str, ...]
    places: tuple[str, ...]
    actions: tuple[str, ...]
    stop: tuple[str, ...]
    boosts: dict[str, float]
    legacy_boosts: dict[str, float]
    classes: tuple[tuple[str, tuple[str, ...]], ...]
    legacy_classes: tuple[tuple[str, tuple[str, ...]], ...]
    #: (stage, words); the first rule of all needs a word of day_time and one of first_stage.
    day_time: tuple[str, ...]
    first_stage: tuple[str, tuple[str, ...]]
    stages: tuple[tuple[str, tuple[str, ...]], ...]
    default_stage: str
    corrections: tuple[str, ...]
    conflicts: tuple[str, ...]
    authority: tuple[str, ...]
    pins: tuple[str, ...]
    #: class: patterns of key entities, group 0 or 1 is the entity
    key_patterns: dict[str, tuple[str, ...]]
    split: str
    #: (pattern, kind) of causal texts, and the words of implied changes
    causal_patterns: tuple[tuple[str, str], ...]
    cause_word: str
    effect_word: str
    condition_word: str
    condition_needs: tuple[str, ...]
    condition_split: str
    changes: tuple[str, ...]
    location_label: str
    other_class: str = "material"
    legacy_other_class: str = "status"
    join: str = "；"
    image_mark: str = "图像证据:"
    title_suffix: str = "态势"
    default_title: str = "火场态势"
    #: how the context lines of events, entities, stages and causes begin
    line_marks: tuple[str, str, str, str] = ("[事件]", "[实体]", "[时序]", "[因果]")


# The word lists of the default profile.
DEFAULT = Profile(
    entity_types=("person", "location", "equipment", "material", "building_area", "hazard"),
    critical=("起火", "火势", "烟雾", "爆炸", "坍塌", "受困", "伤亡", "高温", "易燃", "化学品", "疏散", "消防", "灭火", "救援", "出口", "楼梯", "电梯", "排烟", "水源"),
    places=("楼", "层", "室", "区", "门", "号", "路", "街"),
    actions=("发现", "报告", "前往", "疏散", "灭火", "救援", "检查", "关闭", "启动"),
    stop=("可以", "这个", "那个", "需要", "进行", "系统", "用户", "问题", "回答", "情况", "信息", "现场", "火灾"),
    boosts={"hazard": 0.15, "person": 0.12, "location": 0.10, "equipment": 0.08, "trigger": 0.14, "outcome": 0.12},
    legacy_boosts={"incident": 0.22, "hazard": 0.20, "person": 0.16, "location": 0.12, "equipment": 0.10, "visual_evidence": 0.12, "action": 0.10, "constraint": 0.08},
    classes=(
        ("person", ("受困", "人员", "消防员", "指挥员", "队员", "伤员")),
        ("location", ("东", "西", "南", "北", "楼", "层", "区", "室", "出口", "通道", "仓库", "坐标")),
        ("equipment", ("灭火器", "水枪", "喷淋", "排烟", "防火门", "摄像头", "热成像", "泵")),
        ("hazard", ("易燃", "化学品", "燃气", "爆炸", "高温", "有毒", "坍塌")),
        ("building_area", ("建筑", "机房", "厂房", "仓库", "走廊", "楼梯间")),
    ),
    legacy_classes=(
        ("location", ("东", "西", "南", "北", "楼", "层", "区", "室", "出口", "通道", "仓库", "坐标")),
        ("person", ("受困", "人员", "消防员", "指挥员", "队员", "伤员")),
        ("equipment", ("灭火器", "水枪", "喷淋", "排烟", "防火门", "摄像头", "热成像", "泵")),
        ("hazard", ("易燃", "化学品", "燃气", "爆炸", "高温", "有毒", "坍塌")),
        ("action", ("疏散", "灭火", "封控", "救援", "切断", "排烟", "转移", "部署")),
        ("visual_evidence", ("图像", "照片", "画面", "视频", "航拍", "红外", "热成像")),
        ("constraint", ("必须", "禁止", "限制", "无法", "不能", "需要")),
        ("incident", ("起火", "火势", "烟雾", "蔓延", "报警", "坍塌", "发生")),
    ),
    day_time=("上午", "下午", "中午", "凌晨", "清晨", "傍晚", "夜间", "深夜"),
    first_stage=("起火发现", ("起火", "火灾", "燃烧", "着火")),
    stages=(
        ("初期预警", ("报警器", "触发", "烟感", "热成像", "首次")),
        ("火势蔓延", ("蔓延", "扩散", "升温", "温度升", "浓烟")),
        ("指挥部署", ("指挥员", "到达", "部署", "关闭电源", "命令")),
        ("救援行动", ("受困", "救援", "救出", "应急广播", "掩护")),
        ("灭火行动", ("水源", "消防栓", "排烟", "水枪", "灭火")),
        ("善后处理", ("扑灭", "清理", "清点", "降至", "控制", "死亡", "伤亡")),
        ("风险监测", ("复燃", "监控", "待命", "泄漏", "风险")),
        ("人员疏散", ("疏散", "撤离", "逃生")),
        ("起火发现", ("起火", "火灾", "燃烧", "着火", "烟蒂", "点燃")),
    ),
    default_stage="现场处置",
    corrections=("经专家评定", "经调查", "实际是", "真实原因是", "并非", "不是", "纠正", "澄清", "其实"),
    conflicts=("并非", "不是", "实际是", "其实是", "真实原因", "经专家评定", "经调查", "纠正", "修正", "错误", "误导", "澄清", "重新认定", "排除", "否定", "推翻", "改为", "更改", "更正"),
    authority=("经专家", "经调查", "警方认定", "官方", "权威", " confirmed", "verified"),
    pins=("起火原因", "受困", "伤亡", "爆炸", "坍塌"),
    key_patterns={
        "location": ("([一-龥]{2,4}(?:市|县|镇|村|区|路|街|栋|仓库|房屋|工厂|学校))", "(工业园区|农村|城区|郊区|市区)"),
        "person": ("([张王李赵刘陈杨黄周吴]{1,2}[某]?)", "(管理员|消防员|警察|负责人|户主)"),
        "event": ("(火灾|爆炸|泄漏|坍塌)",),
    },
    split="[。；;，,\n]",
    causal_patterns=(("因.*导致", "direct_cause"), ("由于.*使", "direct_cause"), ("因为.*所以", "direct_cause"), (".*导致.*", "state_change"), ("由于.*", "condition_cause"), (".*原因是.*", "explanation")),
    cause_word="因",
    effect_word="导致",
    condition_word="由于",
    condition_needs=("使", "成功"),
    condition_split="，",
    changes=("温度", "降至", "升至", "恢复", "改善", "完成"),
    location_label="位于",
)

#: For texts in Latin letters: the same rules over frequent syllables.
ASCII = replace(
    DEFAULT,
    entity_types=("ing", "ver", "men", "tion", "ció", "heit"),
    critical=("thing", "ation", "with", "this", "ver", "ment", "that", "erst", "sch", "ando"),
    places=("the", "und", "les", "las"),
    actions=("ing", "ieren", "ment", "ando"),
    stop=("th", "he", "en", "er", "in", "an"),
    classes=(
        ("person", ("wha", "enst", "ungs", "quel")),
        ("location", ("from", "tothe", "gen", "dans", "para")),
        ("equipment", ("ble", "keit", "eaux")),
        ("hazard", ("reed", "stör", "émen")),
        ("building_area", ("sted", "bau", "tre")),
    ),
    legacy_classes=(
        ("location", ("from", "tothe", "gen", "dans", "para")),
        ("person", ("wha", "enst", "ungs", "quel")),
        ("equipment", ("ble", "keit", "eaux")),
        ("hazard", ("reed", "stör", "émen")),
        ("action", ("ering", "ieren", "iss")),
        ("visual_evidence", ("sees", "bild", "vois")),
        ("constraint", ("must", "nicht", "pas")),
        ("incident", ("fire", "brand", "feu")),
    ),
    day_time=("on", "am"),
    first_stage=("start", ("thest", "fire")),
    stages=(("warning", ("whti", "alarm")), ("spread", ("wher", "ausb")), ("command", ("reor", "bef")), ("rescue", ("thand", "rett")), ("fight", ("ntre", "lösch")), ("clean", ("inha", "aufr"))),
    default_stage="scene",
    corrections=("not", "rather", "nicht", "pas "),
    conflicts=("that", "not", "wher", "rath", "nicht", "pas "),
    authority=("this", " confirmed", "verified"),
    pins=("thing", "brand"),
    key_patterns={"location": ("[a-z]{2,4}tion", "[a-z]{2,4}heit"), "person": ("the[a-z]{2}",), "event": ("thing|ation|erst",)},
    split="[.;,\n]",
    causal_patterns=(("an.*thing", "direct_cause"), ("for.*with", "direct_cause"), (".*thing.*", "state_change"), ("for.*", "condition_cause")),
    cause_word="an",
    effect_word="thing",
    condition_word="for",
    condition_needs=("with", "and"),
    condition_split=":",
    changes=("ent", "ing"),
    location_label="at",
    join="; ",
    image_mark="image:",
    title_suffix=" scene",
    default_title="scene",
    line_marks=("[event]", "[entity]", "[stage]", "[cause]"),
)


@dataclass(frozen=True)
class Params:
    """Thresholds of the graph.

    Fixed values: those of the rules' published defaults."""

    cold_start: int = 6
    cluster: float = 0.24
    new_event: float = 0.34
    entity_merge: float = 0.78
    temporal_merge: float = 0.75
    density: float = 0.65
    half_life: float = 21600.0
    compress: float = 0.16
    alpha: float = 0.35
    beta: float = 0.25
    gamma: float = 0.25
    delta: float = 0.15
