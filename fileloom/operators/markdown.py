"""Markdown to blocks, and blocks to DOCX, with the standard library.

Blocks are dictionaries: kind, level, depth (of lists), quote, and spans or rows. A span is (text, styles, link). Nesting
follows CommonMark: a quote's style reaches the paragraphs in it, loose and nested list items keep their marker and
indent, and a formula between dollars of its own stands where it is written.
"""

from __future__ import annotations

import io
import re
import zipfile
from dataclasses import dataclass, field
from xml.sax.saxutils import escape

from fileloom.functions.text import HEADING_SIZES

# Colours and sizes of the styles.
QUOTE, CODE, INLINE_CODE, MATH, LINK, IMAGE, BORDER = "555555", "333333", "A71D5D", "4A154B", "0000FF", "888888", "CCCCCC"
LIST_INDENT, QUOTE_INDENT, MATH_SIZE, BORDER_SIZE = 360, 720, 24, 4

HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
RULE = re.compile(r"^ {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
ITEM = re.compile(r"^( {0,3})([-*+]|\d{1,9}[.)])( +|$)(.*)$")
QUOTED = re.compile(r"^ {0,3}> ?(.*)$")
DELIMITER = re.compile(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")
TASK = re.compile(r"^\[([ xX])\]\s+")


@dataclass
class Block:
    kind: str  # paragraph, heading, code, math, table
    spans: list = field(default_factory=list)
    rows: list = field(default_factory=list)
    level: int = 0
    depth: int = 0
    quote: bool = False
    marker: str = ""


def cells(line: str) -> list[str]:
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    line = line[:-1] if line.endswith("|") and not line.endswith("\\|") else line
    return [x.strip().replace("\\|", "|") for x in re.split(r"(?<!\\)\|", line)]


INLINE = re.compile(
    r"\\(?P<escaped>[!-/:-@\[-`{-~])|(?P<ticks>`+)(?P<code>.+?)(?<!`)(?P=ticks)(?!`)"
    r"|\$(?P<math>[^$\s](?:[^$]*[^$\s])?)\$(?!\d)"
    r"|!\[(?P<alt>[^\]]*)\]\((?P<src>[^\s)]*)(?:\s+\"(?P<title>[^\"]*)\")?\)"
    r"|\[(?P<label>(?:[^\[\]]|!\[[^\]]*\]\([^)]*\))*)\]\((?P<url>[^\s)]*)(?:\s+\"[^\"]*\")?\)"
    r"|<(?P<auto>https?://[^>\s]+)>"
    r"|(?P<mark>\*\*|__|~~|\*|_)|(?P<br> *\n| {2,}\n|\\\n)",
    re.DOTALL,
)


def inline(text: str, styles: frozenset = frozenset(), link: str | None = None) -> list[tuple[str, frozenset, str | None]]:
    """Spans of a text: strong, emphasis, strike, code, math, links, images, breaks."""
    out: list[tuple[str, frozenset, str | None]] = []
    at, plain = 0, []

    def flush() -> None:
        if plain:
            out.append(("".join(plain), styles, link))
            plain.clear()

    while at < len(text):
        m = INLINE.search(text, at)
        if not m:
            plain.append(text[at:])
            break
        plain.append(text[at : m.start()])
        at = m.end()
        if m["escaped"]:
            plain.append(m["escaped"])
        elif m["code"] is not None:
            flush()
            out.append((m["code"].replace("\n", " ").strip() or m["code"], frozenset({"code"}), link))
        elif m["math"] is not None:
            flush()
            out.append((m["math"], styles | {"math"}, link))
        elif m["src"] is not None:
            flush()
            name = f"{m['title']} - {m['src']}" if m["title"] else m["src"]
            out.append((f"[Image: {name}]", frozenset({"image"}), None))
            out += inline(m["alt"], styles, link) if m["alt"] else []
        elif m["url"] is not None:
            flush()
            out += inline(m["label"], styles, m["url"])
        elif m["auto"]:
            flush()
            out.append((m["auto"], styles, m["auto"]))
        elif m["br"] is not None:
            flush()
            out.append(("\n", frozenset({"break"}), None))
        else:
            mark = m["mark"]
            before, after = text[m.start() - 1] if m.start() else " ", text[at] if at < len(text) else " "
            style = {"**": "bold", "__": "bold", "*": "italic", "_": "italic", "~~": "strike"}[mark]
            close = _closing(text, at, mark) if not after.isspace() and not (mark[0] == "_" and before.isalnum()) else -1
            if close < 0:
                plain.append(mark)
            else:
                flush()
                out += inline(text[at:close], styles | {style}, link)
                at = close + len(mark)
    flush()
    return out


def _closing(text: str, at: int, mark: str) -> int:
    """Where an opened emphasis ends, or -1."""
    k = at
    while (k := text.find(mark, k)) >= 0:
        longer = len(mark) == 1 and (text[k : k + 2] == mark * 2)
        if longer:
            k += 2
            continue
        after = text[k + len(mark)] if k + len(mark) < len(text) else " "
        if k > at and not text[k - 1].isspace() and text[k - 1] != "\\" and not (mark[0] == "_" and after.isalnum()):
            return k
        k += len(mark)
    return -1


def _interrupts(line: str) -> bool:
    return bool(HEADING.match(line) or RULE.match(line) or FENCE.match(line) or QUOTED.match(line) or ITEM.match(line) and ITEM.match(line)[4])


def _paragraph(text: str, depth: int, quote: bool, marker: str) -> list[Block]:
    """A paragraph, cut where formulas of their own stand in it."""
    out: list[Block] = []
    for k, part in enumerate(re.split(r"\$\$(.+?)\$\$", text, flags=re.DOTALL)):
        if k % 2:
            out.append(Block("math", [(part.strip(), frozenset({"math"}), None)], depth=depth, quote=quote))
        elif part.strip():
            out.append(Block("paragraph", inline(part.strip()), depth=depth, quote=quote, marker=marker))
            marker = ""
    return out


def parse(source: str, depth: int = 0, quote: bool = False, marker: str = "") -> list[Block]:
    """Blocks in document order."""
    lines = source.replace("\r\n", "\n").replace("\r", "\n").expandtabs(4).split("\n")
    out: list[Block] = []
    i = 0

    def lead() -> str:
        nonlocal marker
        now, marker = marker, ""
        return now

    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
        elif m := FENCE.match(line):
            body, i = [], i + 1
            while i < len(lines) and not re.match(rf"^ {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}\s*$", lines[i]):
                body.append(lines[i])
                i += 1
            i += 1
            out.append(Block("code", [("\n".join(body), frozenset(), None)], depth=depth, quote=quote, marker=lead()))
        elif m := HEADING.match(line):
            out.append(Block("heading", inline(m[2] or ""), level=len(m[1]), depth=depth, quote=quote, marker=lead()))
            i += 1
        elif RULE.match(line):
            i += 1
        elif QUOTED.match(line):
            body = []
            while i < len(lines) and (QUOTED.match(lines[i]) or body and lines[i].strip() and not _interrupts(lines[i])):
                body.append(QUOTED.match(lines[i])[1] if QUOTED.match(lines[i]) else lines[i])
                i += 1
            out += parse("\n".join(body), depth, True, lead())
        elif (m := ITEM.match(line)) and (m[4] or not m[3]):
            number = int(m[2][:-1]) if m[2][:-1].isdigit() else None
            kind = m[2][-1]
            lead()
            while i < len(lines) and (m := ITEM.match(lines[i])) and m[2][-1] == kind and not RULE.match(lines[i]):
                width = len(m[1]) + len(m[2]) + (len(m[3]) if 0 < len(m[3]) < 5 else 1)
                body, i, loose = [m[4]], i + 1, False
                while i < len(lines):
                    if not lines[i].strip():
                        loose = True
                        body.append("")
                    elif len(lines[i]) - len(lines[i].lstrip()) >= width:
                        body.append(lines[i][width:])
                    elif loose or _interrupts(lines[i]):
                        break
                    else:
                        body.append(lines[i].strip())
                    i += 1
                text = "\n".join(body)
                sign = f"{number}. " if number is not None else "\u2022  "
                if t := TASK.match(text):
                    sign, text = sign + ("\u2611 " if t[1] in "xX" else "\u2610 "), text[t.end() :]
                inner = parse(text, depth + 1, quote, sign)
                out += inner or [Block("paragraph", [], depth=depth + 1, quote=quote, marker=sign)]
                number = number + 1 if number is not None else None
        elif "|" in line and i + 1 < len(lines) and DELIMITER.match(lines[i + 1]) and "-" in lines[i + 1] and len(cells(line)) == len(cells(lines[i + 1])):
            width, rows = len(cells(line)), [cells(line)]
            i += 2
            while i < len(lines) and lines[i].strip() and not _interrupts(lines[i]):
                rows.append((cells(lines[i]) + [""] * width)[:width])
                i += 1
            out.append(Block("table", rows=[[inline(c) for c in row] for row in rows], depth=depth, quote=quote))
        elif line.startswith("    ") and line.strip():
            body = []
            while i < len(lines) and (lines[i].startswith("    ") or not lines[i].strip()):
                body.append(lines[i][4:])
                i += 1
            out.append(Block("code", [("\n".join(body).rstrip("\n"), frozenset(), None)], depth=depth, quote=quote, marker=lead()))
        else:
            body = [line.strip()]
            i += 1
            while i < len(lines) and lines[i].strip() and not _interrupts(lines[i]):
                if re.match(r"^ {0,3}(=+|-+)\s*$", lines[i]):
                    break
                body.append(lines[i].lstrip())
                i += 1
            if i < len(lines) and (m := re.match(r"^ {0,3}(=+|-+)\s*$", lines[i])) and lines[i].strip():
                out.append(Block("heading", inline("\n".join(body)), level=1 if m[1][0] == "=" else 2, depth=depth, quote=quote, marker=lead()))
                i += 1
            elif not body[0].startswith("<") or not re.match(r"^<(/?[a-zA-Z][^>]*|!--)", body[0]):
                out += _paragraph("\n".join(body), depth, quote, lead())
    return out


def plain_text(block: Block) -> str:
    if block.kind == "table":
        return "\n".join("\t".join("".join(t for t, _, _ in c) for c in row) for row in block.rows)
    return block.marker + "".join(t for t, _, _ in block.spans)


# --- DOCX -----------------------------------------------------------------

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
TYPES = """<?xml version="1.0" encoding="UTF-8" standalone="yes"?>
<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>"""
ROOT_RELS = """<?xml version="1.0" encoding="UTF-8" standalone="yes"?>
<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>"""
CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff\ufffe\uffff]")


def _run(text: str, bold: bool = False, italic: bool = False, strike: bool = False, colour: str | None = None, size: int | None = None, underline: bool = False) -> str:
    style = ("<w:b/>" * bold) + ("<w:i/>" * italic) + ("<w:strike/>" * strike) + (f'<w:color w:val="{colour}"/>' if colour else "") + (f'<w:sz w:val="{size}"/>' if size else "") + ('<w:u w:val="single"/>' * underline)
    parts = "<w:br/>".join(f'<w:t xml:space="preserve">{escape(x)}</w:t>' for x in CONTROL.sub("", text).split("\n"))
    return f"<w:r>{f'<w:rPr>{style}</w:rPr>' if style else ''}{parts}</w:r>"


class Docx:
    """Collects the parts of a document."""

    def __init__(self) -> None:
        self.links: list[str] = []
        self.body: list[str] = []

    def _span(self, text: str, styles: frozenset, link: str | None, block: Block) -> str:
        if "break" in styles:
            return "<w:r><w:br/></w:r>"
        heading = HEADING_SIZES[min(block.level, 6) - 1] if block.kind == "heading" else None
        quote = block.quote and link is None
        bold, italic, strike = "bold" in styles or heading is not None and link is None, "italic" in styles or quote, "strike" in styles
        if "image" in styles:
            return _run(text, italic=True, colour=IMAGE)
        if "code" in styles:
            run = _run(text, colour=INLINE_CODE, underline=link is not None, size=heading)
        elif "math" in styles:
            run = _run(text, italic=True, colour=MATH, size=heading)
        elif block.kind == "code":
            run = _run(text, colour=CODE)
        elif link is not None:
            run = _run(text, "bold" in styles, "italic" in styles, strike, LINK, None, True)
        else:
            run = _run(text, bold, italic, strike, QUOTE if quote else None, heading)
        if link is None:
            return run
        self.links.append(link)
        return f'<w:hyperlink r:id="rLink{len(self.links)}">{run}</w:hyperlink>'

    def paragraph(self, block: Block) -> str:
        if block.kind == "math":
            runs = _run(block.spans[0][0], italic=True, colour=MATH, size=MATH_SIZE)
            return f'<w:p><w:pPr><w:jc w:val="center"/></w:pPr>{runs}</w:p>'
        left = LIST_INDENT * block.depth if block.depth else QUOTE_INDENT if block.quote else 0
        runs = (self._span(block.marker, frozenset(), None, block) if block.marker else "") + "".join(self._span(*s, block) for s in block.spans)
        return f"<w:p>{f'<w:pPr><w:ind w:left="{left}"/></w:pPr>' if left else ''}{runs}</w:p>"

    def table(self, block: Block) -> str:
        sides = "".join(f'<w:{x} w:val="single" w:sz="{BORDER_SIZE}" w:color="{BORDER}"/>' for x in ("top", "left", "bottom", "right", "insideH", "insideV"))
        rows = "".join("<w:tr>" + "".join(f"<w:tc>{self.paragraph(Block('paragraph', c))}</w:tc>" for c in row) + "</w:tr>" for row in block.rows)
        return f"<w:tbl><w:tblPr><w:tblBorders>{sides}</w:tblBorders></w:tblPr>{rows}</w:tbl>"

    def pack(self, blocks: list[Block]) -> bytes:
        body = "".join(self.table(b) if b.kind == "table" else self.paragraph(b) for b in blocks)
        links = "".join(f'<Relationship Id="rLink{k}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/hyperlink" Target="{escape(CONTROL.sub("", u), {chr(34): "&quot;"})}" TargetMode="External"/>' for k, u in enumerate(self.links, 1))
        head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
        parts = {
            "[Content_Types].xml": TYPES,
            "_rels/.rels": ROOT_RELS,
            "word/document.xml": f"{head}<w:document {W}><w:body>{body}</w:body></w:document>",
            "word/_rels/document.xml.rels": f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>',
        }
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in parts.items():
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text.encode("utf-8"))  # equal input, equal bytes
        return out.getvalue()


def to_docx(source: bytes) -> bytes:
    """A DOCX of Markdown bytes; they must be UTF-8."""
    try:
        text = source.decode("utf-8")
    except UnicodeDecodeError as error:
        raise ValueError(f"Invalid input data: not UTF-8 ({error.reason})") from error
    return Docx().pack(parse(text))
