"""Metadata from paths and texts, as column expressions. A null text or path gives nulls, and false for flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import SPACE

# Folders that tell the kind of a source, in order of precedence.
SOURCE_FOLDERS = (
    ("/标准/国际标准/", "standard_international"), ("/标准/国家标准/", "standard_national"), ("/标准/", "standard"),
    ("/文献/", "literature"), ("/PCB设计/", "pcb_design"), ("/PCB资料/", "pcb_material"),
)
# Names that stand for a vendor or a design tool, in order of precedence.
VENDORS = (("jlcpcb", "JLCPCB"), ("嘉立创", "JLCPCB"), ("pcbway", "PCBWay"), ("捷配", "JiePei"), ("nextpcb", "NextPCB"))
TOOLS = (
    ("kicad", "kicad"), ("altium", "altium"), ("altiumdesigner", "altium"), ("ad", "altium"), ("allegro", "allegro"),
    ("orcad", "orcad"), ("pads", "pads"), ("eagle", "eagle"),
)
# What is looked for in a text; the first group is what is kept, where there is one.
ENTITIES = {
    "standard_gb": r"GB[/T]*\s*[\d\.\-]+(?:\-\d{4})?",
    "standard_ipc": r"IPC-[A-Z]*-?\d+[A-Z]*",
    "standard_sj": r"SJ[/T]*\s*[\d\.\-]+(?:\-\d{4})?",
    "standard_iso": r"ISO\s*\d+(?:\-\d+)?(?:\:\d{4})?",
    "material_fr4": r"\bFR[-\s]?4\b",
    "material_cem": r"\bCEM[-\s]?\d\b",
    "material_rogers": r"\bRogers\s*\d+",
    "material_pi": r"\b(聚酰亚胺|PI|Polyimide)\b",
    "process_hasl": r"\b(HASL|喷锡|热风整平)\b",
    "process_enig": r"\b(ENIG|沉金|化金|镀金)\b",
    "process_osp": r"\b(OSP|有机保焊|有机涂覆)\b",
    "process_immersion": r"\b(沉银|沉锡|Immersion)\b",
    "param_impedance": r"\b(阻抗|impedance|特性阻抗)\b",
    "param_thickness": r"\b(厚度|thickness)\b",
    "param_copper_weight": r"\b(\d+(?:\.\d+)?\s*oz)\b",
    "param_trace_width": r"\b(线宽|trace\s*width)\b",
    "test_aoi": r"\b(AOI|自动光学检测)\b",
    "test_flying_probe": r"\b(飞针|flying\s*probe)\b",
    "test_ict": r"\b(ICT|在线测试)\b",
}
# What tells the type of a document: standards first, then words by type, then fallbacks.
STANDARD_TYPES = (("GB[/T]*\\s*\\d+", "national_standard"), ("IPC-[A-Z]*-?\\d+", "ipc_standard"), ("SJ[/T]*\\s*\\d+", "industry_standard"), ("ISO\\s*\\d+", "international_standard"))
TYPE_WORDS = {
    "national_standard": ("GB", "GB/T", "国家标准", "中华人民共和国"),
    "industry_standard": ("SJ", "SJ/T", "行业标准", "电子行业"),
    "international_standard": ("IPC", "ISO", "IEC", "JEDEC", "国际标准"),
    "test_procedure": ("测试方法", "试验方法", "检验方法", "测试规范", "试验规范"),
    "design_guide": ("设计指南", "设计规范", "设计要求", "Layout", "布局"),
    "manufacturing_spec": ("制造规范", "工艺规范", "加工要求", "生产规范"),
    "material_spec": ("材料规格", "基材", "覆铜板", "半固化片", "铜箔"),
    "quality_standard": ("质量标准", "验收标准", "检验标准", "合格判定"),
}
TYPE_FALLBACKS = {
    "test_procedure": ("测试", "试验", "检验", "检测"),
    "design_guide": ("设计", "layout", "布局", "走线"),
    "manufacturing_spec": ("制造", "工艺", "加工", "生产"),
}
# Headings of standards, with their level.
HEADINGS = (
    (r"^(\d+)\s+(\S.{0,50})$", 1), (r"^(\d+\.\d+)\s+(\S.{0,50})$", 2), (r"^(\d+\.\d+\.\d+)\s+(\S.{0,50})$", 3),
    (r"^(\d+(?:\.\d+){3,})\s+(\S.{0,40})$", 4), (r"^(附录\s*[A-Z])\s*(.*)$", 1),
)
TABLE, FORMULA, LIST = r"(?:\t.*){3,}|\|.*\|.*\|", r"[=≤≥±×÷∑∏√∫]{2,}|[a-zA-Z]\s*[=]\s*\d", r"(?:^|\n)\s*(?:[\d]+[.、)]|[a-z][.)]|[-•·])\s+\S"
#: Flags under which Java reads a pattern as Unicode-aware and with the line feed as the only end of line.
JAVA = "(?Ud)"


def _first(pairs, test, otherwise: Column | None = None) -> Column:
    """The name of the first pair whose test holds."""
    out = reduce(lambda c, p: (F if c is None else c).when(test(p[0]), F.lit(p[1])), pairs, None)
    return out.otherwise(otherwise) if otherwise is not None else out


def source_type(path: Column) -> Column:
    rooted = F.concat(F.lit("/"), F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+|/+$", ""), F.lit("/"))
    return _first(SOURCE_FOLDERS, lambda folder: rooted.contains(folder), F.lit("unknown"))


def effective_date(text: Column) -> Column:
    """The first ``20yy-m-d`` (or with points or underscores), else the first ``20yymmdd``, as text; null if out of range."""

    def read(pattern: str) -> Column:
        year, month, day = (F.regexp_extract(text, pattern, k) for k in (1, 2, 3))
        ok = month.try_cast("int").between(1, 12) & day.try_cast("int").between(1, 31)
        return F.when(ok, F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))

    return F.coalesce(read(r"(20\d{2})[-._](\d{1,2})[-._](\d{1,2})"), read(r"(20\d{2})(\d{2})(\d{2})"))


def vendor(text: Column) -> Column:
    return _first(VENDORS, lambda needle: F.lower(text).contains(needle))


def design_tool(text: Column, exact_short_names: bool = False) -> Column:
    """The design tool named in a text. ``exact_short_names``: the two-letter name has to stand alone."""
    low = F.lower(text)
    return _first(TOOLS, lambda needle: low.rlike(rf"\b{needle}\b") if exact_short_names and len(needle) == 2 else low.contains(needle))


def _number(text: Column, pattern: str, kind: str) -> Column:
    return F.nullif(F.regexp_extract(F.lower(text), JAVA + pattern, 1), F.lit("")).try_cast(kind)


def layer_count(text: Column) -> Column:
    return F.coalesce(_number(text, r"(?<!\d)(\d{1,2})\s*(?:层|layer|layers)\b", "int"), _number(text, r"(?<!\d)(\d{1,2})\s*l\b", "int"))


def copper_oz(text: Column) -> Column:
    return _number(text, r"(?<!\d)(\d+(?:\.\d+)?)\s*oz\b", "double")


def path_metadata(path: Column) -> Column:
    """All that a path tells, as a struct."""
    return F.struct(
        source_type(path).alias("source_type"), F.regexp_replace(path, "^/+|/+$", "").alias("source_path"), vendor(path).alias("vendor"),
        design_tool(path).alias("eda"), layer_count(path).alias("layer_count"), copper_oz(path).alias("copper_oz"), effective_date(path).alias("effective_date"),
    )


def document_type(text: Column, path: Column | None = None) -> Column:
    low = F.lower(F.concat_ws(" ", F.coalesce(text, F.lit("")), F.coalesce(path, F.lit("")) if path is not None else F.lit("")))
    steps = [(text.rlike("(?i)" + JAVA + p), name) for p, name in STANDARD_TYPES]
    for words in (TYPE_WORDS, TYPE_FALLBACKS):
        steps += [(reduce(lambda a, b: a | b, (low.contains(w.lower()) for w in ws)), name) for name, ws in words.items()]
    return _first(steps, lambda test: test, F.lit("general"))


def _group(pattern: str) -> int:
    return int("(" in pattern.replace("(?", ""))


def entities_of(text: Column, kind: str, most: int = 10) -> Column:
    """Distinct matches of a kind in order, ``most`` at most."""
    found = F.regexp_extract_all(text, F.lit("(?i)" + JAVA + ENTITIES[kind]), F.lit(_group(ENTITIES[kind])))
    return F.filter(F.transform(F.slice(F.array_distinct(found), 1, most), F.trim), lambda m: m != "")


def entities(text: Column) -> Column:
    """A map from each kind that occurs to its entities."""
    each = F.array(*(F.struct(F.lit(k).alias("key"), entities_of(text, k).alias("value")) for k in ENTITIES))
    return F.map_from_entries(F.filter(each, lambda e: F.size(e["value"]) > 0))


def standards(text: Column, most: int = 5) -> Column:
    return F.slice(F.concat(*(F.coalesce(entities_of(text, k), F.array().cast("array<string>")) for k in ENTITIES if k.startswith("standard_"))), 1, most)


def section(text: Column) -> Column:
    """``section, subsection`` by the first heading pattern found in the first 500 characters."""
    head = F.substring(text, 1, 500)
    title = lambda p: F.regexp_replace(F.concat_ws(" ", F.regexp_extract(head, "(?m)" + JAVA + p, 1), F.regexp_extract(head, "(?m)" + JAVA + p, 2)), rf"[{SPACE}]+\z", "")
    found = reduce(lambda c, h: (F if c is None else c).when(head.rlike("(?m)" + JAVA + h[0]), F.struct(F.lit(h[1]).alias("level"), title(h[0]).alias("title"))), HEADINGS, None)
    upper = F.coalesce(found["level"] <= 2, F.lit(False))
    return F.struct(F.when(upper, found["title"]).otherwise("").alias("section"), F.when(~upper & found.isNotNull(), found["title"]).otherwise("").alias("subsection"))


def has_table(text: Column) -> Column:
    return F.coalesce(text.rlike(TABLE), F.lit(False))


def has_formula(text: Column) -> Column:
    return F.coalesce(text.rlike(JAVA + FORMULA), F.lit(False))


def has_list(text: Column) -> Column:
    return F.coalesce(text.rlike("(?m)" + JAVA + LIST), F.lit(False))


def chunk_metadata(chunk: Column, document: Column, path: Column | None = None) -> Column:
    """All that a chunk tells, with the type of its document, as a struct."""
    found, at = entities(chunk), section(chunk)
    return F.struct(
        document_type(F.substring(document, 1, 5000), path).alias("doc_type"), at["section"].alias("section"), at["subsection"].alias("subsection"),
        has_table(chunk).alias("has_table"), has_formula(chunk).alias("has_formula"), has_list(chunk).alias("has_list"),
        F.map_keys(found).alias("entity_types"), standards(chunk).alias("standards"), F.length(chunk).alias("char_count"),
        (F.length(chunk) - F.length(F.replace(chunk, F.lit("\n"), F.lit(""))) + 1).alias("line_count"),
    )
