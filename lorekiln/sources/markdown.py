"""Markdown and MDX: frontmatter, component downgrade, sections, segments and analysis units.

Parsing is sequential within a document and independent between documents, so each document is
one row of an Arrow batch.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Components with a Markdown form, and readable names of callouts.
STRUCTURAL = ("Callout", "Steps", "Step", "Cards", "Card", "Accordions", "Accordion", "Tabs", "Tab")
CALLOUTS = {"info": "Note", "note": "Note", "warn": "Warning", "warning": "Warning", "tip": "Tip", "danger": "Danger", "error": "Error", "success": "Success", "caution": "Caution"}
# Code point ranges of wide characters, as functions.text.WIDE has them.
WIDE = ((0x1100, 0x115F), (0x2E80, 0x303E), (0x3041, 0x33FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA4CF), (0xAC00, 0xD7A3), (0xF900, 0xFAFF), (0xFE30, 0xFE4F), (0xFF00, 0xFF60), (0xFFE0, 0xFFE6))

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_TAG = re.compile(r"<(/?)([A-Z][\w.]*)((?:\s+[\w:-]+(?:=(?:\"[^\"]*\"|'[^']*'|\{[^{}]*\}))?)*)\s*(/?)>")
_ATTRIBUTE = re.compile(r"([\w:-]+)(?:=(?:\"([^\"]*)\"|'([^']*)'|(\{[^{}]*\})))?")
_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_LINK = re.compile(r"\[([^\]]*)\]\(([^)\s]+)[^)]*\)")


def estimate_tokens(text: str) -> int:
    wide = sum(any(a <= ord(c) <= b for a, b in WIDE) for c in text if ord(c) > 0x10FF)
    return math.ceil(2 * wide / 3) + math.ceil((len(text) - wide) / 4) + (not text)


def split_frontmatter(raw: str) -> tuple[dict[str, str], str, str | None]:
    """Keys (lower case) and values, the rest, and a diagnostic. An unterminated block is left in place."""
    lines = raw.replace("\r\n", "\n").split("\n")
    if lines[0].rstrip() != "---":
        return {}, raw, None
    end = next((i for i, x in enumerate(lines[1:], 1) if x.rstrip() in ("---", "...")), None)
    if end is None:
        return {}, raw, "frontmatter without an end"
    values = {}
    for line in lines[1:end]:
        key, colon, value = line.partition(":")
        if colon and key.strip() and not key.startswith((" ", "\t", "#", "-")):
            value = value.strip()
            if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
                value = value[1:-1]
            values[key.strip().lower()] = value
    return values, "\n".join(lines[end + 1 :]), None


def _fenced(lines: list[str]) -> list[bool]:
    """Which lines are inside or edges of fenced code."""
    out, open_ = [], ""
    for line in lines:
        mark = _FENCE.match(line)
        if open_:
            out.append(True)
            if mark and mark[1][0] == open_[0] and len(mark[1]) >= len(open_) and not line.strip().strip(open_[0]):
                open_ = ""
        else:
            open_ = mark[1] if mark else ""
            out.append(bool(mark))
    return out


def downgrade(body: str) -> tuple[str, list[str], list[str]]:
    """Markdown for components, the components that were rewritten, and diagnostics for what is kept as it is."""
    lines = body.split("\n")
    done, notes, records = [], [], []
    steps, open_ = 0, []

    def marker(name: str, attributes: dict[str, str]) -> str | None:
        nonlocal steps
        if name == "Callout":
            kind = attributes.get("type", "").strip().lower()
            return f"**{CALLOUTS.get(kind, kind.capitalize())}:**" if kind else ""
        if name == "Steps":
            steps = 0
        if name == "Step":
            steps += 1
            return f"{steps}."
        title = attributes.get("label") or attributes.get("title") if name == "Tab" else attributes.get("title")
        if name == "Card":
            if not title:
                return None
            return f"[{title}]({attributes['href']})" if attributes.get("href") else f"**{title}**"
        return f"**{title}**" if name in ("Accordion", "Tab") and title else ""

    def rewrite(m: re.Match) -> str:
        closing, name, raw, self_closing = m[1], m[2], m[3], m[4]
        if closing:
            if name in STRUCTURAL:
                if name not in open_:
                    notes.append(f"closing tag without an opening one: {name}")
                    return m[0]
                del open_[len(open_) - 1 - open_[::-1].index(name)]
            return ""
        values, literal = {}, True
        for a in _ATTRIBUTE.finditer(raw):
            literal &= a[4] is None
            values[a[1]] = next((x for x in (a[2], a[3]) if x is not None), "")
        if name not in STRUCTURAL:
            if not literal:
                notes.append(f"attribute is not literal: {name}")
                return m[0]
            return " ".join(v for v in values.values() if v)
        if not literal:
            notes.append(f"attribute is not literal: {name}")
            return m[0]
        text = marker(name, values)
        if text is None:
            notes.append(f"no literal title: {name}")
            return m[0]
        records.append(name)
        if not self_closing:
            open_.append(name)
        rest = m.string[m.end() :]
        return text + (" " if text and rest and not rest.startswith((" ", "\n")) else "")

    for line, code in zip(lines, _fenced(lines), strict=True):
        if code:
            done.append(line)
            continue
        if re.fullmatch(r"\s*\{/\*.*\*/\}\s*", line):
            continue
        line = re.sub(r"<!--.*?-->", "", line)
        changed = _TAG.sub(rewrite, line)
        if re.match(r"\s*<[A-Z]", changed) and not _TAG.search(changed):
            notes.append(f"unterminated tag: {line.strip()[:40]}")
        if re.match(r"\s*\{[^/]", changed):
            notes.append(f"expression is kept: {line.strip()[:40]}")
        if changed.strip() or not line.strip():
            done.append(changed)
    notes += [f"never closed: {name}" for name in open_]
    return "\n".join(done), records, notes


@dataclass
class Section:
    level: int
    heading: str
    path: list[str]
    content: str
    start: int
    end: int
    links: list[tuple[str, str]] = field(default_factory=list)


def sections(text: str) -> list[Section]:
    """Sections under ATX and underlined headings. Text before the first is one of its own unless it is blank.

    start and end are UTF-8 byte places of the trimmed content.
    """
    lines = text.split("\n")
    code = _fenced(lines)
    heads: list[tuple[int, int, int, str]] = []  # first line, line after the heading, level, title
    for i, line in enumerate(lines):
        if code[i]:
            continue
        if m := _HEADING.match(line):
            heads.append((i, i + 1, len(m[1]), (m[2] or "").strip()))
        elif i and not code[i - 1] and (m := _UNDERLINE.match(line)) and lines[i - 1].strip() and not _HEADING.match(lines[i - 1]) and not re.match(r"\s*([-*+>|]|\d+[.)])", lines[i - 1]):
            heads.append((i - 1, i + 1, 1 if m[1][0] == "=" else 2, lines[i - 1].strip()))
    offsets = [0]
    for line in lines:
        offsets.append(offsets[-1] + len(line.encode("utf-8", "surrogatepass")) + 1)
    found: list[Section] = []

    def add(first: int, last: int, level: int, title: str, path: list[str]) -> None:
        raw = "\n".join(lines[first:last])
        content = raw.strip()
        if not content and not level:
            return
        start = offsets[first] + len(raw[: len(raw) - len(raw.lstrip())].encode("utf-8", "surrogatepass")) if content else offsets[min(first, len(offsets) - 1)]
        size = len(content.encode("utf-8", "surrogatepass"))
        links = [m.groups() for x, c in zip(lines[first:last], code[first:last], strict=True) if not c for m in _LINK.finditer(x)]
        found.append(Section(level, title, path, content, start, start + size, links))

    add(0, heads[0][0] if heads else len(lines), 0, "", [])
    stack: list[tuple[int, str]] = []
    for n, (_, after, level, title) in enumerate(heads):
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, title))
        add(after, heads[n + 1][0] if n + 1 < len(heads) else len(lines), level, title, [t for _, t in stack])
    return found


def segments(content: str, most_tokens: int) -> list[tuple[int, int]]:
    """Byte ranges of runs of blocks (parted by blank lines) within a budget. A block over it is left whole."""
    if estimate_tokens(content) <= most_tokens:
        return [(0, len(content.encode()))]
    gaps = [m.span() for m in re.finditer("\n\n", content)]
    blocks = [(a, b) for a, b in zip([0, *[e for _, e in gaps]], [*[s for s, _ in gaps], len(content)], strict=True) if b > a]
    runs: list[list[int]] = []
    for start, end in blocks:
        if runs and estimate_tokens(content[runs[-1][0] : end]) <= most_tokens:
            runs[-1][1] = end
        else:
            runs.append([start, end])
    size = lambda i: len(content[:i].encode())
    return [(size(a), size(b)) for a, b in runs]


def pack_units(tokens: list[int], most: int) -> list[int]:
    """Number of the unit that each section goes to: sections in order fill a unit up to the budget, larger ones stand alone."""
    unit, spent, out = 0, 0, []
    for n in tokens:
        if spent and spent + n > most:
            unit, spent = unit + 1, 0
        out.append(unit)
        spent += n
    return out


SECTIONS = "path string, language string, diagnostics array<string>, ord int, level int, heading string, heading_path array<string>, content string, start long, end long, links array<struct<text:string,url:string>>"


def read_sections(files: DataFrame) -> DataFrame:
    """A row for each section of each file (path, raw): frontmatter stripped, components downgraded."""

    def part(batches):
        for rows in batches:
            out = []
            for path, raw in zip(rows["path"], rows["raw"], strict=True):
                keys, body, note = split_frontmatter(unicodedata.normalize("NFC", raw or ""))
                text, _, notes = downgrade(body) if str(path).endswith(".mdx") else (body, [], [])
                notes = ([note] if note else []) + notes
                for i, s in enumerate(sections(text)):
                    out.append((path, keys.get("lang") or keys.get("language"), notes, i, s.level, s.heading, s.path, s.content, s.start, s.end, s.links))
            yield pd.DataFrame(out, columns=["path", "language", "diagnostics", "ord", "level", "heading", "heading_path", "content", "start", "end", "links"])

    return files.select("path", "raw").mapInPandas(part, SECTIONS)


def read_chunks(section_rows: DataFrame, most_tokens: int = 6000) -> DataFrame:
    """path, ord, ordinal, start, end, body: sections cut into segments within a token budget."""

    def part(batches):
        for rows in batches:
            out = []
            for path, i, content, start in zip(rows["path"], rows["ord"], rows["content"], rows["start"], strict=True):
                raw = content.encode()
                out += [(path, i, n, start + a, start + b, raw[a:b].decode()) for n, (a, b) in enumerate(segments(content, most_tokens))]
            yield pd.DataFrame(out, columns=["path", "ord", "ordinal", "start", "end", "body"])

    return section_rows.select("path", "ord", "content", "start").mapInPandas(part, "path string, ord int, ordinal int, start long, end long, body string")


def downgraded(files: DataFrame) -> DataFrame:
    """path, text, components, diagnostics."""

    def part(batches):
        for rows in batches:
            made = [downgrade(split_frontmatter(raw or "")[1]) for raw in rows["raw"]]
            yield pd.DataFrame({"path": rows["path"], "text": [m[0] for m in made], "components": [m[1] for m in made], "diagnostics": [m[2] for m in made]})

    return files.select("path", "raw").mapInPandas(part, "path string, text string, components array<string>, diagnostics array<string>")


def frontmatter_of(files: DataFrame) -> DataFrame:
    """path, keys (map), rest, diagnostic."""

    def part(batches):
        for rows in batches:
            made = [split_frontmatter(raw or "") for raw in rows["raw"]]
            yield pd.DataFrame({"path": rows["path"], "keys": [m[0] for m in made], "rest": [m[1] for m in made], "diagnostic": [m[2] for m in made]})

    return files.select("path", "raw").mapInPandas(part, "path string, keys map<string,string>, rest string, diagnostic string")


def units(section_rows: DataFrame, most_tokens: int = 32_000) -> DataFrame:
    """path, ord, unit: sections of a document packed into units for analysis. A document's sections are one group."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord")
        return pd.DataFrame({"path": rows["path"], "ord": rows["ord"], "unit": pack_units(rows["tokens"].tolist(), most_tokens)})

    from ..functions.text import estimate_tokens as estimate

    return section_rows.select("path", "ord", estimate(F.col("content")).alias("tokens")).groupBy("path").applyInPandas(pack, "path string, ord int, unit int")
