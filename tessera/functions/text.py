"""Text quality measures and cleaning, as column expressions.

Every function takes and returns a ``Column``; a null text gives null, an empty one 0 or an empty text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The blocks of code points that count as proper characters, as (first, last).
VALID_RANGES = (
    (0x0000, 0x007F), (0x00A0, 0x00FF), (0x2000, 0x206F), (0x2070, 0x209F), (0x20A0, 0x20CF), (0x2100, 0x214F),
    (0x2150, 0x218F), (0x2190, 0x21FF), (0x2200, 0x22FF), (0x2300, 0x23FF), (0x2460, 0x24FF), (0x2500, 0x257F),
    (0x25A0, 0x25FF), (0x2600, 0x26FF), (0x3000, 0x303F), (0x3040, 0x309F), (0x30A0, 0x30FF), (0x3100, 0x312F),
    (0x3200, 0x32FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFE30, 0xFE4F), (0xFF00, 0xFFEF),
)
# Runs of these characters are scanning debris. The second class holds the capital letters I and J.
OCR_RUNS = ("[ӡưճƬ֧أ͵һڱ]+", "[ͶĄIJ]+")

#: What counts as white space, inside a character class of Java's and RE2's syntax.
SPACE = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: What ends a line.
LINE_END = r"\x{d}\x{a}|[\x{a}-\x{d}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
VALID = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in VALID_RANGES)
CHINESE = r"\x{4e00}-\x{9fff}"
REPLACEMENT = "�"


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is made once, however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def _dropped(*classes: str) -> str:
    """A pattern of runs of what any of the classes names or of what is neither proper nor white space. Single characters
    below 256 are looked up in one table of the matcher, ranges are tried in turn; so only others come to the ranges."""
    kept = re.compile(f"[{_python(VALID + SPACE)}]").match
    bad = re.compile(f"[{_python(''.join(classes))}]").match
    stays = lambda c: kept(chr(c)) and not bad(chr(c))
    low = "".join(rf"\x{{{c:x}}}" for c in range(0x100) if not stays(c))
    runs: list[list[int]] = []
    for c in filter(stays, range(0x100, 0x10000)):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    high = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in runs)
    return rf"[{low}[[^\x{{0}}-\x{{ff}}]&&[^{high}]]]+"


def _python(characters: str) -> str:
    """A character class of Java's syntax in Python's."""
    return re.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{int(m[1], 16):04x}", characters)


def without(text: Column, characters: str) -> Column:
    return F.regexp_replace(text, f"[{characters}]+", "")


def count_of(text: Column, characters: str) -> Column:
    """How many characters of a text are in the class."""
    return F.length(text) - F.length(without(text, characters))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.when(whole.isNotNull(), 0.0))


def strip(text: Column) -> Column:
    # most texts have nothing to strip: their ends tell
    edge = F.substring(text, 1, 1).rlike(f"[{SPACE}]") | F.substring(text, -1, 1).rlike(f"[{SPACE}]")
    return F.when(edge, F.regexp_replace(text, rf"\A[{SPACE}]+|[{SPACE}]++\z", "")).otherwise(text)


def is_valid_char(char: Column) -> Column:
    return char.rlike(rf"\A[{VALID}]\z")


def garbage_ratio(text: Column, of_visible: bool = True) -> Column:
    """Characters outside the proper blocks, as a part of the visible characters or of all of them."""
    bad = F.length(without(text, VALID + SPACE))
    return share(bad, F.length(without(text, SPACE)) if of_visible else F.length(text))


def chinese_ratio(text: Column) -> Column:
    return share(count_of(text, CHINESE), F.length(text))


def replacement_ratio(text: Column) -> Column:
    return share(F.length(text) - F.length(F.replace(text, F.lit(REPLACEMENT), F.lit(""))), F.length(text))


def mojibake_ratio(text: Column) -> Column:
    return share(count_of(text, r"\x{c0}-\x{ff}"), F.length(text))


def quality_score(text: Column, of_visible: bool = True) -> Column:
    """The lower the better: debris counts against a text, Chinese counts for it."""
    chinese = chinese_ratio(text)
    base = garbage_ratio(text, of_visible) + replacement_ratio(text) * 2.0 + mojibake_ratio(text) * 0.6
    return base + F.when((F.length(text) > 50) & (chinese < 0.01), 0.05).otherwise(-F.least(chinese, F.lit(0.2)) * 0.5)


def needs_repair(text: Column) -> Column:
    """True for texts that look like bytes decoded by the wrong table."""
    wrong = (replacement_ratio(text) > 0.002) | ((mojibake_ratio(text) > 0.08) & (chinese_ratio(text) < 0.02))
    return (F.length(text) >= 50) & wrong


def clean_text(text: Column, strict: bool = False) -> Column:
    """Drops control characters, debris and improper characters and evens out white space.

    ``strict`` also drops runs of three or more accented letters that touch no plain letter, and indents.
    """
    debris = rf"\x{{0}}-\x{{8}}\x{{b}}\x{{c}}\x{{e}}-\x{{1f}}{REPLACEMENT}" + "".join(run[1:-2] for run in OCR_RUNS)
    if strict:
        accented = r"\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}"
        out = F.regexp_replace(without(text, debris), rf"(?<![a-zA-Z])[{accented}]{{3,}}(?![a-zA-Z])", "")
        out = F.regexp_replace(out, f"[^{VALID}{SPACE}]+", "")
    else:  # single characters go, whatever the order, so in one pass
        out = F.regexp_replace(text, _dropped(debris), "")
    # most texts have no such run: to look for one costs less than to match; a lone space stays as it is
    out = _once(out, lambda t: F.when(t.contains("\t") | t.contains("  "), F.regexp_replace(t, r"\t[ \t]*+| [ \t]++", " ")).otherwise(t))
    out = _once(out, lambda t: F.when(t.contains("\n\n\n"), F.regexp_replace(t, r"\n{3,}+", "\n\n")).otherwise(t))
    if strict:
        out = F.regexp_replace(out, rf"(?md)^[{SPACE}]+", "")
    return _once(out, strip)


def lines_of(text: Column) -> Column:
    """The lines of a text; an end of line at the very end opens no further one."""
    return F.split(F.regexp_replace(text, rf"(?:{LINE_END})\z", ""), LINE_END, -1)


def is_aligned_row(line: Column) -> Column:
    """True for a line that looks like a row of a table: by bars, tabs or three columns set apart by spaces."""
    bare = strip(line)
    bars = F.length(bare) - F.length(F.replace(bare, F.lit("|"), F.lit("")))
    columns = F.size(F.filter(F.split(bare, " {2,}"), lambda c: c != ""))
    row = (F.length(bare) >= 4) & ((bars >= 2) | line.contains("\t") | (columns >= 3))
    # most lines have nothing that could set columns apart
    return F.when(line.contains("|") | line.contains("\t") | line.contains("  "), row).otherwise(False)


def utf8_length(text: Column) -> Column:
    return F.octet_length(text)


def path_stem(path: Column) -> Column:
    """The last part of a path without its last suffix; a leading point is no suffix."""
    name = F.regexp_replace(F.regexp_replace(path, "/+$", ""), "^.*/", "")
    return F.regexp_replace(name, r"(?s)^(.+)\.[^.]+$", "$1")
