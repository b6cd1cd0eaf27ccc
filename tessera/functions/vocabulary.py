"""Word lists of the domain, as fixed values, and the terms protected from stop words by default."""

from __future__ import annotations

# Synonyms by term, in order of preference.
SYNONYMS: dict[str, tuple[str, ...]] = {
    "pcb": ("印制板", "印制电路板", "线路板", "printed circuit board"),
    "印制板": ("PCB", "印制电路板", "线路板"),
    "fpc": ("柔性电路板", "挠性板", "flexible printed circuit"),
    "hdi": ("高密度互连", "high density interconnect"),
    "测试": ("试验", "检验", "检测", "test", "测量"),
    "试验": ("测试", "检验", "检测", "测量"),
    "检测": ("测试", "试验", "检验"),
    "阻燃": ("防火", "耐燃", "抗燃", "flame retardant", "阻燃型"),
    "镀金": ("沉金", "ENIG", "化金"),
    "喷锡": ("HASL", "热风整平"),
    "沉银": ("immersion silver",),
    "osp": ("有机保焊膜", "有机涂覆"),
    "蚀刻": ("etching", "腐蚀", "化学蚀刻"),
    "电镀": ("plating", "镀覆", "镀层"),
    "覆铜板": ("CCL", "copper clad laminate", "基材", "铜板"),
    "层压板": ("laminate", "叠层板"),
    "介质": ("dielectric", "绝缘", "介电"),
    "半固化片": ("prepreg", "PP", "粘结片"),
    "铜箔": ("copper foil", "铜皮"),
    "聚酰亚胺": ("PI", "polyimide", "亚胺薄膜"),
    "绝缘": ("insulation", "介质", "绝缘材料"),
    "焊盘": ("pad", "land", "盘"),
    "孔环": ("annular ring", "环宽"),
    "过孔": ("via", "导通孔", "通孔"),
    "盲孔": ("blind via", "盲埋孔"),
    "埋孔": ("buried via",),
    "导线": ("trace", "走线", "线路", "导体"),
    "线宽": ("trace width", "走线宽度"),
    "阻抗": ("impedance", "特性阻抗"),
    "差分": ("differential", "diff", "差分对"),
    "单端": ("single ended", "single-ended"),
    "带状线": ("stripline",),
    "微带线": ("microstrip",),
    "电阻": ("resistance", "阻值"),
    "击穿": ("breakdown", "击穿电压"),
    "耐压": ("withstand voltage", "电压测试"),
    "温度": ("temperature", "热", "高温", "低温"),
    "湿度": ("humidity", "潮湿", "湿热"),
    "尺寸": ("dimension", "规格", "size"),
    "厚度": ("thickness", "板厚"),
    "剥离": ("peel", "剥离强度"),
    "翘曲": ("warpage", "弯曲", "变形"),
    "语句": ("statement", "指令", "命令"),
    "属性": ("attribute", "参数", "property"),
    "格式": ("format", "规格", "file format"),
    "定义": ("definition", "规定", "描述"),
    "要求": ("requirement", "规范", "标准"),
    "程序": ("procedure", "步骤", "流程", "方法"),
    "国标": ("GB", "GB/T", "国家标准"),
    "行标": ("行业标准", "SJ", "SJ/T"),
    "标志": ("mark", "标记", "标识", "marking"),
    "颜色": ("color", "色标"),
}

# Classes of queries in order: patterns, keywords, regular expressions, weights of the vector and the
# lexical route, number of queries.
CLASSES: dict[str, dict] = {
    "definition": {"patterns": ("什么是", "定义", "含义", "概念", "是什么", "指的是", "meaning", "definition"), "keywords": (), "weights": (0.6, 0.4), "queries": 4},
    "procedure": {"patterns": ("如何", "怎么", "怎样", "步骤", "方法", "流程", "过程", "工艺", "how to", "process"), "keywords": ("制造", "生产", "加工", "组装", "焊接", "蚀刻", "电镀", "钻孔"), "weights": (0.5, 0.5), "queries": 5},
    "specification": {"patterns": ("参数", "规格", "标准", "要求", "规定", "指标", "公差", "尺寸", "厚度", "宽度"), "keywords": ("mm", "mil", "oz", "μm", "ohm", "Ω", "层", "孔径"), "weights": (0.3, 0.7), "queries": 4},
    "comparison": {"patterns": ("区别", "对比", "差异", "不同", "比较", "优缺点", "选择", "vs", "versus", "difference"), "keywords": (), "weights": (0.55, 0.45), "queries": 5},
    "troubleshoot": {"patterns": ("为什么", "原因", "故障", "问题", "失败", "缺陷", "不良", "异常", "why", "cause", "failure"), "keywords": ("分层", "起泡", "短路", "断路", "翘曲", "偏移", "漏铜"), "weights": (0.5, 0.5), "queries": 5},
    "standard": {"patterns": (), "keywords": ("GB", "GB/T", "IPC", "JEDEC", "MIL", "ISO", "标准", "规范"), "regex": (r"GB[/T]*[-\s]*\d+", r"IPC[-\s]*\d+", r"JEDEC", r"MIL[-\s]*STD", r"ISO[-\s]*\d+"), "weights": (0.25, 0.75), "queries": 3},
    "material": {"patterns": ("材料", "基材", "介质", "铜箔", "树脂", "玻纤", "覆铜板"), "keywords": ("FR-4", "FR4", "CEM", "高频", "PTFE", "PI", "聚酰亚胺", "Tg", "Dk", "Df", "CTI"), "weights": (0.4, 0.6), "queries": 4},
    "test": {"patterns": ("测试", "试验", "检验", "检测", "验证", "test", "inspection"), "keywords": ("AOI", "X-ray", "飞针", "ICT", "FCT", "可靠性", "耐热", "剥离强度"), "weights": (0.4, 0.6), "queries": 4},
    "eda_operation": {"patterns": ("命令", "菜单", "操作", "设置", "配置", "面板", "对话框", "按钮", "选项"), "keywords": ("Altium", "Cadence", "Allegro", "OrCAD", "KiCad", "PADS", "AD", "PCB Editor", "原理图", "封装", "网表", "布线", "布局", "DRC", "BOM"), "weights": (0.35, 0.65), "queries": 4},
}
GENERAL = {"weights": (0.45, 0.55), "queries": 4}

# Words that refer back to what was said before.
REFERRING = ("它", "这个", "那个", "上述", "前面", "刚才", "上面", "该", "其", "此", "这些", "那些", "还有呢", "继续", "接着", "然后呢", "补充", "详细")


def protected_terms(path: str | None = None) -> frozenset[str]:
    """Terms that are kept though they are stop words, and that weigh more: a deployment's list, one a line, or by
    default the lower-case terms of the word lists above."""
    if path:
        with open(path, encoding="utf-8") as f:
            return frozenset(x.strip() for x in f if x.strip())
    words = [*SYNONYMS, *(w for v in SYNONYMS.values() for w in v), *(k for c in CLASSES.values() for k in c["keywords"])]
    return frozenset(w.lower() for w in words if " " not in w)
