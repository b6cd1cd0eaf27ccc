"""Documents to chunks: by structure, by parents and children, by meaning, by length.

A splitter is a function from a text to ``[(chunk, fields)]``; it folds over one text in order. ``chunk`` applies one
to every row, streaming Arrow batches, and passes on each time that ``PIECE_CHARS`` of chunks are made, so a task holds a
batch of texts and a piece's chunks at a time. Chunk ids follow from the document's id and
the chunk's place, hence reruns give the same ids.

Cases: null, empty and blank texts give no chunk; texts of any length are one row, so one task's work; repeated rows
are chunked each (under the same ids).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.metadata import HEADINGS

#: Characters of the chunks that are passed on together, and how many chunks, at most but for the last text's.
PIECE_CHARS, PIECE_ROWS = 1 << 20, 2048

Chunk = tuple[str, dict]
Splitter = Callable[[str], list[Chunk]]

# The heading of a Chinese chapter; what starts a block of a list or of code; the name of what stands before all headings.
CHAPTER = (r"^(第[一二三四五六七八九十百]+[章节条款])\s*(.*)$", 1)
LIST_START = re.compile(r"^(?:[\d]+[.、)]|[a-z][.)]|[-•·※])\s+", re.M)
CODE_START = re.compile(r"^[\s]*(?:def |class |import |from |if |for |while |#)", re.M)
PREFACE, TITLE_MARK = "前言", "标题："
# Line patterns of the section report, in order, with the kind of section.
LINE_SECTIONS = (
    (r"^(\d+)\s+([^\n]{2,50})$", "chapter"), (r"^(\d+\.\d+)\s+([^\n]{2,50})$", "section"), (r"^(\d+\.\d+\.\d+)\s+([^\n]{2,50})$", "subsection"),
    (r"^(\d+(?:\.\d+){3,})\s+([^\n]{2,40})$", "subsubsection"), (r"^(附录\s*[A-Z])\s*([^\n]*)$", "appendix"),
    (r"^(表\s*[\dA-Z]+(?:\.\d+)?)\s*(.*)$", "table"), (r"^(图\s*[\dA-Z]+(?:\.\d+)?)\s*(.*)$", "figure"),
)
_STRUCTURE = [(re.compile(p, re.M), level) for p, level in HEADINGS]
_PARENTS = [*_STRUCTURE, (re.compile(CHAPTER[0], re.M), CHAPTER[1])]
_MEANING = [p for p, level in (*_STRUCTURE[:3], _PARENTS[5], _STRUCTURE[4])]
_LINES = [(re.compile(p), kind) for p, kind in LINE_SECTIONS]
_PARAGRAPHS = re.compile(r"\n{2,}")


@dataclass(frozen=True)
class Heading:
    start: int
    level: int
    title: str


def headings(text: str, patterns=_STRUCTURE) -> list[Heading]:
    found = [Heading(m.start(), level, f"{m[1]} {m[2]}".strip()) for p, level in patterns for m in p.finditer(text)]
    return sorted(found, key=lambda h: h.start)


def line_sections(text: str) -> list[tuple[int, int, str, str, str]]:
    """``start, end, number, title, kind`` of each line that is a heading, a table's or a figure's."""
    out, at = [], 0
    for line in text.split("\n"):
        bare = line.strip()
        hit = next(((m, kind) for p, kind in _LINES if (m := p.match(bare))), None)
        if hit:
            out.append((at, at + len(line), hit[0][1], hit[0][2].strip(), hit[1]))
        at += len(line) + 1
    return out


def sections(text: Column) -> Column:
    """``line_sections`` for a column of texts."""

    @F.pandas_udf("array<struct<start: int, stop: int, number: string, title: string, kind: string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if t is None else [dict(zip(("start", "stop", "number", "title", "kind"), x, strict=True)) for x in line_sections(t)] for t in s], dtype=object)

    return run(text)


def mark_sections(text: str) -> str:
    """A comment that names the section before each heading."""
    out, at = [], 0
    for start, _, number, title, kind in line_sections(text):
        out += [text[at:start], f"\n\n<!-- SECTION: {kind} | {number} | {title} -->\n"]
        at = start
    return "".join(out) + text[at:]


def _paragraphs(text: str) -> list[str]:
    return [p for p in map(str.strip, _PARAGRAPHS.split(text)) if p]


def _cuts(text: str, heads: list[Heading]) -> Iterator[tuple[Heading, str]]:
    ends = [h.start for h in heads[1:]] + [len(text)]
    for h, end in zip(heads, ends, strict=True):
        yield h, text[h.start : end].strip()


def split_paragraphs(text: str, most: int = 2000, least: int = 200, keep_short: bool = True) -> list[Chunk]:
    """Paragraphs packed in order; a pack below ``least`` takes in the next, or is dropped without ``keep_short``."""
    packs: list[str] = []
    for p in _paragraphs(text):
        if packs and len(packs[-1]) + len(p) + 2 <= most:
            packs[-1] += "\n\n" + p
        else:
            packs.append(p)
    return merge_short([(p, {}) for p in packs], least) if keep_short else [(p, {}) for p in packs if len(p) >= least]


def split_long(text: str, section: str, level: int, most: int = 2000, overlap: int = 100) -> list[Chunk]:
    """A section's paragraphs packed in order, each pack after the tail of the one before. A lone paragraph that is
    too long is cut in strides; one that comes while a pack is open is not."""
    done: list[str] = []
    held = ""
    for p in _paragraphs(text):
        if len(held) + len(p) + 2 <= most:
            held = held + "\n\n" + p if held else p
        elif held:
            done.append(held)
            held = held[-overlap:] + "\n\n" + p if 0 < overlap < len(held) else p
        elif len(p) > most:
            done += [part for at in range(0, len(p), most - overlap) if (part := p[at : at + most]).strip()]
        else:
            held = p
    parts = [(t, {"section": section, "level": level, "part": i}) for i, t in enumerate(done)]
    if held:
        parts.append((held, {"section": section, "level": level, "part": len(done) or None}))
    return parts


def merge_short(chunks: list[Chunk], least: int) -> list[Chunk]:
    """A chunk below ``least`` takes in those that follow it; its own fields stay."""
    out: list[Chunk] = []
    for text, fields in chunks:
        if out and len(out[-1][0]) < least:
            out[-1] = (out[-1][0] + "\n\n" + text, out[-1][1])
        else:
            out.append((text, fields))
    return out


def split_structure(text: str, most: int = 2000, least: int = 200, overlap: int = 100, keep_short: bool = True) -> list[Chunk]:
    """A chunk a section. Sections below ``least`` are merged into the next, or dropped without ``keep_short``."""
    if not text.strip():
        return []
    heads = headings(text)
    if not heads:
        return split_paragraphs(text, most, least, keep_short)
    floor, out = (1 if keep_short else least), []
    intro = text[: heads[0].start].strip()
    if len(intro) >= floor:
        out.append((intro, {"section": PREFACE, "level": 0}))
    for h, body in _cuts(text, heads):
        if len(body) > most:
            out += split_long(body, h.title, h.level, most, overlap)
        elif len(body) >= floor:
            out.append((body, {"section": h.title, "level": h.level}))
    return merge_short(out, least)


def blocks(text: str) -> list[tuple[str, int, int, str]]:
    """``text, start, end, kind`` of the paragraphs; the kind shows in the first 100 characters."""
    out, at = [], 0
    for p in _paragraphs(text):
        start = text.index(p, at)
        at = start + len(p)
        head = p[:100]
        out.append((p, start, at, "list" if LIST_START.search(head) else "code" if CODE_START.search(head) else "paragraph"))
    return out


def parents(text: str, most: int = 3000, least: int = 200, least_section: int = 120, keep_short: bool = True) -> list[dict]:
    """Sections, or packed paragraphs where there is no heading; without ``keep_short`` short ones are dropped."""
    made: list[dict] = []
    new = lambda t, a, b, kind, title="", level=0: {"text": t, "start": a, "end": b, "type": kind, "title": title, "level": level}

    def append(to: dict, t: str, end: int) -> None:
        to["text"] += "\n\n" + t
        to["end"] = end

    heads = headings(text, _PARENTS)
    if heads:
        intro = text[: heads[0].start].strip()
        if len(intro) >= (1 if keep_short else least):
            made.append(new(intro, 0, heads[0].start, "section", PREFACE))
        ends = [h.start for h in heads[1:]] + [len(text)]
        for (h, body), end in zip(_cuts(text, heads), ends, strict=True):
            if len(body) >= min(least, least_section) or (keep_short and not made and body):
                made.append(new(body, h.start, end, "section", h.title, h.level))
            elif made:
                append(made[-1], body, end)
        return made
    held: dict | None = None
    for t, a, b, kind in blocks(text):
        if held is not None and len(held["text"]) + len(t) + 2 <= most and (held["type"] == kind or len(held["text"]) < least):
            append(held, t, b)
            held["type"] = kind if held["type"] == kind else "mixed"
            continue
        # a full parent, or one that another kind of block closes
        if held is not None and (keep_short or len(held["text"]) >= least):
            made.append(held)
        held = new(t, a, b, kind)
    if held is not None:
        if made and len(held["text"]) < least:
            append(made[-1], held["text"], held["end"])
        else:
            made.append(held)
    return made


def split_length(text: str, most: int = 800, least: int = 150, overlap: int = 80) -> list[str]:
    """Sentences packed in order, each pack after the last sentence's rest in the tail of the one before."""
    if len(text) <= most:
        return [text]
    out: list[str] = []
    held = ""
    for sentence in re.split(r"(?<=[。！？.!?])", text):
        if not sentence.strip():
            continue
        if len(held) + len(sentence) > most and held and len(held) >= least:
            out.append(held.strip())
            tail = held[-overlap:] if overlap > 0 else ""
            end = tail.rfind("。") if "。" in tail else tail.rfind(".")
            held = tail[end + 1 :] if end > 0 else tail
        held += sentence
    if held and (len(held) >= least or not out):
        out.append(held.strip())
    elif held:
        out[-1] += held
    return out


@dataclass(frozen=True)
class Meaning:
    """Splitting by meaning: where neighbouring units are least alike. ``embed``: texts to an array of vectors. Without
    ``keep_short`` a rest below ``least`` that does not fit beside its neighbour is dropped."""

    embed: Callable[[list[str]], np.ndarray]
    most: int = 1000
    least: int = 80
    threshold: float = 0.45
    percentile: float = 22
    overlap: int = 220
    window: int = 6
    keep_short: bool = True

    def units(self, text: str) -> list[tuple[str, int]]:
        """``unit, start``: paragraphs, short neighbours joined, long ones cut into groups of sentences."""
        joined: list[list] = []
        for m in re.finditer(r"[^\n]+(?:\n[^\n]+)*", text):
            p = m[0].strip()
            if len(p) <= 5:
                continue
            if joined and len(joined[-1][0]) + len(p) + 2 <= self.most * 0.5:
                joined[-1][0] += "\n" + p
            else:
                joined.append([p, m.start()])
        out: list[tuple[str, int]] = []
        for p, start in joined:
            if len(p) <= self.most:
                out.append((p, start))
                continue
            group: list[list] = []
            for m in re.finditer(r"[^。！？\n]+[。！？]?", p):
                s = m[0].strip()
                if s and group and len(group[-1][0]) + len(s) < max(400, self.most * 0.4):
                    group[-1][0] += s
                elif s:
                    group.append([s, start + m.start()])
            out += [(t, a) for t, a in group] or [(p, start)]
        return out or [(text, 0)]

    def alike(self, vectors: np.ndarray) -> np.ndarray:
        """The cosine of each vector with the one before; 1 for the first and where there is none."""
        out = np.ones(len(vectors))
        if len(vectors) > 1:
            norm = np.linalg.norm(vectors, axis=1)
            c = (vectors[1:] * vectors[:-1]).sum(axis=1) / (norm[1:] * norm[:-1] + 1e-8)
            out[1:] = np.where(np.isfinite(c), c, 1.0)
        return out

    def smooth(self, scores: np.ndarray) -> np.ndarray:
        """The mean over half a window on either side; few scores stay as they are."""
        n, half = len(scores), self.window // 2
        if n <= self.window:
            return scores
        total = np.concatenate([[0.0], np.cumsum(scores)])
        at = np.arange(n)
        a, b = np.maximum(0, at - half), np.minimum(n, at + half + 1)
        return (total[b] - total[a]) / (b - a)

    def breaks(self, units: list[tuple[str, int]], scores: np.ndarray, starts: set[int]) -> list[int]:
        """Where a chunk ends, at a unit's start. A chunk that is long enough ends at the start of a part (``starts``);
        below ``most`` else only at a marked dip, from double the least length on; above it at any dip, where scores
        vary at all, and at 1.3 times it anywhere."""
        if len(units) < 2:
            return []
        s = self.smooth(scores)
        low = s < min(float(np.percentile(s[1:], self.percentile)), self.threshold)
        marked = np.zeros(len(s), bool)
        marked[1:-1] = low[1:-1] & (s[1:-1] < np.minimum(s[:-2], s[2:]) - 0.15)
        varied = float(np.std(s[1:])) >= 0.08
        out, length = [], 0
        for i, (unit, start) in enumerate(units):
            length += len(unit)
            part = start in starts and length >= self.least * 0.5
            dip = marked[i] and (length >= self.most or length >= self.least * 2)
            full = length >= self.most and ((low[i] and varied) or length >= self.most * 1.3)
            if length >= self.least and (part or dip or full):
                out.append(start)
                length = 0
        return sorted(set(out))

    def by_sentence(self, text: str) -> list[str]:
        out = [""]
        for s in re.findall(r"[^。！？\n]*[。！？\n]|[^。！？\n]+\Z", text):
            if len(out[-1]) + len(s) <= self.most:
                out[-1] += s
            else:
                out.append(s)
        return [y for x in out if (y := x.strip())]

    def assemble(self, text: str, breaks: list[int]) -> list[Chunk]:
        """The parts between the breaks, packed in order; parts that are too long by sentence."""
        points = sorted({0, *breaks, len(text)})
        enough = lambda t: self.keep_short or len(t) >= self.least
        out: list[tuple[str, dict]] = []
        held = ""
        for part in filter(None, (text[a:b].strip() for a, b in zip(points, points[1:], strict=False))):
            both = f"{held}\n{part}" if held else part
            if len(both) <= self.most:
                held = both
                continue
            if held and enough(held):
                out.append((held, {}))
                held = ""
            if len(part) <= self.most:
                held = part
            else:
                out += [(t, {"force_split": True}) for t in self.by_sentence(part) if enough(t)]
        if held and out and len(held) < self.least:
            out[-1] = (f"{out[-1][0]}\n{held}", out[-1][1])
        elif held:
            out.append((held, {}))
        chunks = [(t.strip(), {"split_method": "semantic", "chunk_idx": i, **more}) for i, (t, more) in enumerate(out)]
        return self.overlapped(self.merged(chunks))

    def merged(self, chunks: list[Chunk]) -> list[Chunk]:
        """Small chunks join the next while there is room, else the one before."""
        if len(chunks) <= 1:
            return chunks
        out: list[Chunk] = []
        held, fields = chunks[0]

        def close() -> None:
            if len(held) < self.least and out and len(out[-1][0]) + len(held) <= self.most:
                out[-1] = ((out[-1][0] + "\n" + held).strip(), out[-1][1])
            else:
                out.append((held.strip(), fields))

        for text, more in chunks[1:]:
            joined = (held + "\n" + text).strip()
            if len(held) < self.least and len(joined) <= self.most:
                held = joined
            else:
                close()
                held, fields = text, more
        close()
        return out

    def overlapped(self, chunks: list[Chunk]) -> list[Chunk]:
        """Each chunk after what follows the first end of a sentence in the tail of the one before."""
        if self.overlap <= 0:
            return chunks
        out = chunks[:1]
        for (before, _), (text, fields) in zip(chunks, chunks[1:], strict=False):
            tail = before[-self.overlap :]
            end = re.search(r"[。！？.!?]\s*", tail)
            tail = tail[end.end() :] if end else tail
            out.append((f"{tail} {text}", {**fields, "has_overlap": True}) if tail else (text, fields))
        return out

    def fallback(self, text: str) -> list[Chunk]:
        """Without vectors: paragraphs packed, long ones by sentence."""
        enough = lambda t: self.keep_short or len(t) >= self.least
        out: list[str] = []
        held = ""
        for p in _paragraphs(text):
            if len(held) + len(p) <= self.most:
                held = held + "\n\n" + p if held else p
                continue
            out += [held] * (bool(held) and enough(held))
            held = p
            if len(p) > self.most:
                out += [x for x in self.by_sentence(p) if enough(x)]
                held = ""
        out += [held] * (bool(held) and enough(held))
        return [(t, {"split_method": "fallback", "chunk_idx": i}) for i, t in enumerate(out)]

    def __call__(self, text: str) -> list[Chunk]:
        text = text.strip()
        if not text:
            return []
        whole = [(text, {"split_method": "semantic", "chunk_idx": 0})]
        if len(text) <= self.most:
            return whole
        units = self.units(text)
        if len(units) < 2:
            return whole
        vectors = np.asarray(self.embed([u for u, _ in units]), float)
        if not len(vectors):
            return self.fallback(text)
        starts = {m.start() for p in _MEANING for m in p.finditer(text)}
        return self.assemble(text, self.breaks(units, self.alike(vectors), starts)) or whole

    def varies(self, text: str, longer_than: int = 1600, spread: float = 0.15) -> bool:
        """Whether a parent is long and varied enough to be split by meaning."""
        if len(text) <= longer_than:
            return False
        units = self.units(text)
        return len(units) >= 3 and float(np.std(self.alike(np.asarray(self.embed([u for u, _ in units]), float))[1:])) >= spread


def split_children(text: str, meaning: Meaning | None = None, most: int = 800, least: int = 150, overlap: int = 80, parent: dict | None = None) -> list[Chunk]:
    """Parents, then their children: whole, by meaning (given a ``Meaning`` and a varied parent) or by length. A child
    that does not show its section's title early gets it as a prefix. ``parent``: the arguments of ``parents``."""
    if not text.strip():
        return []
    out: list[Chunk] = []
    made = parents(text, **(parent or {}))
    if not made:
        return [(text.strip(), {"parent_idx": 0, "child_idx": 0, "parent_type": "document", "split_method": "none", "chunk_idx": 0})]
    for p_idx, p in enumerate(made):
        if len(p["text"]) <= most:
            how, kids = "none", [p["text"]]
        elif meaning is not None and meaning.varies(p["text"]):
            how, kids = "semantic", [t for t, _ in meaning(p["text"])]
        else:
            how, kids = "length", split_length(p["text"], most, least, overlap)
        title = p["title"].strip() if p["type"] == "section" else ""
        for c_idx, kid in enumerate(kids):
            fields = {
                "parent_idx": p_idx, "parent_type": p["type"], "parent_title": p["title"], "parent_level": p["level"], "parent_size": len(p["text"]),
                "child_idx": c_idx, "children_count": len(kids), "split_method": how, "chunk_idx": len(out),
            }
            out.append((f"{TITLE_MARK}{title}\n{kid}" if title and title not in kid[:120] else kid, fields))
    return out


def split_tokens(text: str, size: int = 384, overlap: int = 150) -> list[Chunk]:
    """Sentences packed to ``size`` words, each pack after whole sentences of ``overlap`` words of the one before."""
    sentences = [s for s in re.findall(r"[.!?。！？\n]*[^.!?。！？\n]+[.!?。！？\n]*\s*|[.!?。！？\n]+", text) if s.strip()]
    words = lambda s: len(re.findall(r"[一-鿿]|[^\s一-鿿]+", s))
    pieces: list[tuple[str, int]] = []
    for s in sentences:
        if words(s) <= size:
            pieces.append((s, words(s)))
        else:  # a sentence that is too long, by words
            found = re.findall(r"[一-鿿]\s*|[^\s一-鿿]+\s*", s)
            pieces += [("".join(part), len(part)) for at in range(0, len(found), size) if (part := found[at : at + size])]
    out, held = [], []
    for piece in pieces:
        if held and sum(n for _, n in held) + piece[1] > size:
            out.append("".join(t for t, _ in held).strip())
            tail, total = [], 0
            for t, n in reversed(held):
                if total + n > min(overlap, size - piece[1]):
                    break
                tail.insert(0, (t, n))
                total += n
            held = tail
        held.append(piece)
    if held:
        out.append("".join(t for t, _ in held).strip())
    return [(t, {"split_method": "sentence", "chunk_idx": i}) for i, t in enumerate(out) if t]


def split_levels(text: str, sizes: tuple[int, ...] = (1024, 384, 128), floor: int = 256) -> list[Chunk]:
    """Chunks of each size, the smaller cut from the larger; ``parent_idx`` is the place of the chunk it was cut from."""
    out: list[Chunk] = []

    def cut(body: str, level: int, parent: int | None) -> None:
        for t, _ in split_tokens(body, max(floor, sizes[level]), 20):
            out.append((t, {"split_method": "hierarchical", "chunk_idx": len(out), "parent_idx": parent, "parent_level": level}))
            if level + 1 < len(sizes):
                cut(t, level + 1, len(out) - 1)

    cut(text, 0, None)
    return out


def split_by_distance(text: str, embed, buffer: int = 1, percentile: float = 90, most: int = 3000) -> list[Chunk]:
    """Sentences cut where a window of ``buffer`` on either side differs most from the next; at most ``most`` long."""
    sentences = [s for s in re.split(r"(?<=[.!?。！？])\s*", text) if s.strip()]
    groups: list[list[str]] = [sentences[:1]] if sentences else []
    if len(sentences) > 1:
        windows = [" ".join(sentences[max(0, i - buffer) : i + buffer + 1]) for i in range(len(sentences))]
        far = 1 - Meaning(embed).alike(np.asarray(embed(windows), float))[1:]
        limit = np.percentile(far, percentile)
        for s, d in zip(sentences[1:], far, strict=True):
            if d > limit:
                groups.append([])
            groups[-1].append(s)
    parts = [p for g in groups for p in split_length(" ".join(g), most, 1, 0)]
    return [(t, {"split_method": "semantic", "chunk_idx": i}) for i, t in enumerate(parts)]


#: The fields that splitters may set, with their types.
FIELDS = {
    "section": pa.string(), "level": pa.int32(), "part": pa.int32(), "parent_idx": pa.int32(), "parent_type": pa.string(), "parent_title": pa.string(),
    "parent_level": pa.int32(), "parent_size": pa.int32(), "child_idx": pa.int32(), "children_count": pa.int32(), "split_method": pa.string(),
    "has_overlap": pa.bool_(), "force_split": pa.bool_(),
}
_DDL = {pa.string(): "string", pa.int32(): "int", pa.bool_(): "boolean"}


def chunk(docs: DataFrame, split: Splitter, mark: str = "-", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, chunk_idx, chunk_id, text`` and the fields of each chunk. ``mark`` goes into the ids: ``-`` for
    structure, ``-pc-`` for children, ``-sem-`` for meaning."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        data = [pa.array([r[k] for r in rows], kind) for k, kind in ((0, pa.string()), (1, pa.int32()), (2, pa.string()))]
        data += [pa.array([r[3].get(name) for r in rows], kind) for name, kind in FIELDS.items()]
        return pa.RecordBatch.from_arrays(data, names=["doc_id", "chunk_idx", "text", *FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, chars = [], 0
            for i, body in zip(b.column(0), b.column(1), strict=True):
                if not (body := body.as_py()):
                    continue
                own = split(body)
                rows += [(i.as_py(), n, t, f) for n, (t, f) in enumerate(own)]
                chars += sum(len(t) for t, _ in own)
                if chars >= PIECE_CHARS or len(rows) >= PIECE_ROWS:
                    yield made(rows)
                    rows, chars = [], 0
            if rows:
                yield made(rows)

    schema = ", ".join(["doc_id string, chunk_idx int, text string", *(f"{n} {_DDL[k]}" for n, k in FIELDS.items())])
    rows = docs.select(F.col(doc_id).cast("string"), F.col(text).cast("string")).mapInArrow(run, schema)
    return rows.withColumn("chunk_id", F.md5(F.concat("doc_id", F.lit(mark), "chunk_idx")))


def link(chunks: DataFrame) -> DataFrame:
    """Chunks with ``prev_id, next_id, doc_node_id, is_first_in_parent, is_last_in_parent, total_chunks_in_doc``.

    Neighbours are met in windows over one document, which one task made and one holds.
    """
    by_doc = Window.partitionBy("doc_id").orderBy("chunk_idx")
    by_parent = Window.partitionBy("doc_id", "parent_idx")
    return chunks.withColumns({
        "doc_node_id": F.md5(F.concat(F.lit("doc-"), "doc_id")),
        "prev_id": F.lag("chunk_id", 1, "").over(by_doc), "next_id": F.lead("chunk_id", 1, "").over(by_doc),
        "total_chunks_in_doc": F.count("*").over(Window.partitionBy("doc_id")).cast("int"),
        "is_first_in_parent": F.col("chunk_idx") == F.min("chunk_idx").over(by_parent), "is_last_in_parent": F.col("chunk_idx") == F.max("chunk_idx").over(by_parent),
    })


def link_sections(chunks: DataFrame, levels: int = 8) -> DataFrame:
    """Chunks with ``section_num, section_title, section_level, parent_id``.

    A chunk whose first 200 characters hold a numbered heading hangs under the last earlier chunk of a smaller level;
    one without hangs under the last heading; else the document is the parent. Levels beyond ``levels`` count as it.
    """
    head, pattern = F.substring("text", 1, 200), r"(?Umd)^(\d+(?:\.\d+)*)\s+(.+?)$"
    has = head.rlike(pattern)
    level = F.when(has, F.least(F.size(F.split(F.regexp_extract(head, pattern, 1), r"\.")), F.lit(levels)))
    seen = chunks.withColumns({"section_num": F.when(has, F.regexp_extract(head, pattern, 1)), "section_title": F.when(has, F.regexp_extract(head, pattern, 2)), "section_level": level, "doc_node_id": F.md5(F.concat(F.lit("doc-"), "doc_id"))})
    before = Window.partitionBy("doc_id").orderBy("chunk_idx").rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(F.col("chunk_idx").alias("i"), F.col("chunk_id").alias("id"))
    last = [F.max(F.when(F.col("section_level") < k, at)).over(before)["id"] for k in range(1, levels + 1)]
    under = F.max(F.when(F.col("section_level").isNotNull(), at)).over(before)["id"]
    parent = under
    for k, above in enumerate(last, 1):
        parent = F.when(F.col("section_level") == k, above).otherwise(parent)
    return seen.withColumn("parent_id", F.coalesce(parent, "doc_node_id"))


def limit_bytes(chunks: DataFrame, most: int = 60_000, target: int = 12_000) -> DataFrame:
    """Chunks above ``most`` bytes are split to ``target``; the first part keeps the id, the others get ids of their own."""
    from tessera.functions.folds import CUT_MARK, in_budget, truncated

    small = F.coalesce(F.octet_length("text") <= most, F.lit(True))
    parts = chunks.where(~small).withColumn("_p", in_budget(F.col("text"), target)).select("*", F.posexplode("_p").alias("_i", "_t"))
    new_id = F.when(F.col("_i") == 0, F.col("chunk_id")).otherwise(F.md5(F.concat("chunk_id", F.lit("-"), "_i")))
    cut = parts.withColumns({"chunk_id": new_id, "text": truncated(F.col("_t"), most, CUT_MARK)}).drop("_p", "_i", "_t")
    return chunks.where(small).unionByName(cut)


def length_stats(chunks: DataFrame) -> DataFrame:
    n = F.length("text")
    return chunks.agg(F.count("*").alias("chunks"), F.avg(n).alias("mean_chars"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"))
