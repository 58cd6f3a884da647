"""Notes and pages from HTML to Markdown, by a stack of open elements.

One pass over the tags: each open element is a frame that gathers finished blocks and a run of inline Markdown, and hands
its own Markdown to the frame below when it is closed, by its end tag or by one that implies it. Nothing
recurses, so markup nested thousands deep is no harder than other markup.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements without an end tag, elements that are blocks, and what an opening tag closes within which bounds.
VOID = set("br img hr input meta link col wbr area source base".split())
BLOCKS = set(
    """p div h1 h2 h3 h4 h5 h6 ul ol li blockquote pre table thead tbody tfoot tr td th hr section article header footer
    figure figcaption dl dt dd center details summary aside main nav address caption""".split()
)
# a whole page's frame, which notes don't have, is no run of text either
BLOCKS |= {"html", "head", "body"}
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
IMPLIED |= dict.fromkeys(("thead", "tbody", "tfoot"), ("thead", "tbody", "tfoot", "tr", "td", "th"))
BOUNDS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",)}
# Inline marks, elements of code, elements whose content isn't text, colours and entities by name.
MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "cite": "*", "dfn": "*", "s": "~~", "strike": "~~", "del": "~~"}
CODE = {"code", "kbd", "samp", "tt"}
SILENT = {"math", "svg", "button", "select", "textarea", "iframe", "object", "video", "audio", "canvas"}
COLOURS = {"#ffd400": "yellow", "#ff6666": "red", "#5fb236": "green", "#2ea8e5": "blue", "#a28ae5": "purple", "#e56eee": "pink", "#f19837": "orange"}
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\xa0", "ndash": "–", "mdash": "—", "hellip": "…", "lsquo": "‘", "rsquo": "’",
    "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "middot": "·", "bull": "•", "copy": "©", "reg": "®", "deg": "°", "times": "×", "minus": "−",
    "plusmn": "±", "shy": "\xad", "zwj": "\u200d", "zwnj": "\u200c",
}

_TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<[!?](?:[^>"']|"[^"]*"|'[^']*')*+>|<(/?)([A-Za-z](?:[^\s>"']|"[^"]*"|'[^']*')*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<|[^<]+""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s]*)))?""")
_ENTITY = re.compile(r"&(?:#[xX]([0-9A-Fa-f]+)|#([0-9]+)|([A-Za-z0-9]+));")
_SPECIAL = re.compile(r"""[*`]|\\(?=[!-/:-@\[-`{-~])|(?<![^\W_])_|_(?![^\W_])|<(?=[A-Za-z/!])|~(?=~)|(?<=~)~""")
_LINE_START = re.compile(r"^(\s*)(?:([0-9]+)(?=[.)] )|(?=[#>|]|```|~~~|[-+] |-$|---|===))", re.M)
_EDGES = " \xa0\n"


def decode(text: str) -> str:
    """Character references, named and numeric; unknown ones stay."""

    def sign(m: re.Match) -> str:
        if m[3] is not None:
            return ENTITIES.get(m[3], m[0])
        code = int(m[1], 16) if m[1] is not None else int(m[2])
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    return _ENTITY.sub(sign, text) if "&" in text else text


def _spaced(text: str) -> str:
    return re.sub(r"[ \t\n\r]+", " ", text).replace("\xa0", " ")


def _escape(text: str) -> str:
    text = _SPECIAL.sub(r"\\\g<0>", text)
    return re.sub(r"[\[\]]", r"\\\g<0>", text) if "](" in text else text


def _guard(text: str) -> str:
    """Line starts that would read as a heading, quote, list, table or fence."""
    return _LINE_START.sub(lambda m: f"{m[1]}{m[2] or ''}\\", text)


def _indent(block: str) -> str:
    return re.sub(r"(?m)^(?=.)", "    ", block)


def _longest(text: str, sign: str) -> int:
    return max(map(len, re.findall(re.escape(sign) + "+", text)), default=0)


def _target(href: str) -> str:
    href = href.replace(" ", "%20")
    return "<" + href.replace("<", "%3C").replace(">", "%3E") + ">" if re.search(r"[()<>]", href) else href


def _split(text: str) -> tuple[str, str, str]:
    inner = text.strip(_EDGES)
    at = text.find(inner) if inner else len(text)
    return text[:at], inner, text[at + len(inner) :]


class _Frame:
    __slots__ = ("name", "attrs", "blocks", "run", "raw", "flat", "number", "quoted", "annotation")

    def __init__(self, name: str, attrs: dict[str, str], flat: bool = False) -> None:
        self.name, self.attrs, self.flat = name, attrs, flat
        self.blocks: list = []  # finished blocks; of a list its items, of a table its rows, of a row its cells
        self.run: list[str] = []
        self.raw: list[str] = []
        self.number, self.quoted, self.annotation = 1, False, None

    @property
    def inline(self) -> bool:
        """Its content is one run of inline text."""
        return self.name not in BLOCKS and self.name != "" or self.name in ("h1", "h2", "h3", "h4", "h5", "h6")


class Writer:
    """Markdown of one text; ``sources``: source ids by the keys of attachments and items that highlights name."""

    def __init__(self, sources: dict[str, str] | None = None) -> None:
        self.sources = sources or {}
        self.stack = [_Frame("", {})]

    def write(self, html: str) -> str:
        at, end = 0, len(html)
        while at < end:
            m = _TOKEN.match(html, at)
            at = m.end()
            if m[2] is None:
                if not m[0].startswith(("<!", "<?")):
                    self.text(decode(m[0]))
                continue
            name = m[2].rstrip("/").lower()
            if m[1]:
                self.end(name)
                continue
            if name in ("script", "style"):
                close = re.compile(rf"</{name}[^>]*>", re.I).search(html, at)
                at = close.end() if close else end
                continue
            attrs = {}
            for k, a, b, c in _ATTRIBUTE.findall(m[3].rstrip().rstrip("/")):
                attrs.setdefault(k.lower(), decode(a or b or c))
            self.start(name, attrs, (m[2] + m[3]).rstrip().endswith("/"))
        while len(self.stack) > 1:
            self.close()
        root = self.stack[0]
        self.flush(root)
        return re.sub("\n{3,}", "\n\n", "\n\n".join(root.blocks)).strip()

    # the stack

    def start(self, name: str, attrs: dict[str, str], closed: bool) -> None:
        if name in BLOCKS:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].name == "p":
                    self.close_to(i)
                if self.stack[min(i, len(self.stack) - 1)].name in BLOCKS:
                    break
        if name in IMPLIED:
            bounds = BOUNDS.get(name, ("table",))
            outer = hit = 0
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].name in bounds:
                    outer = i
                    break
                if self.stack[i].name in IMPLIED[name]:
                    hit = i  # the outermost: a row closes the row before it, not its cell alone
            if hit > outer:
                self.close_to(hit)
        below = self.stack[-1]
        frame = _Frame(name, attrs, flat=below.flat and name not in BLOCKS or name[:1] == "h" and name[1:].isdigit())
        if name == "ol" and re.fullmatch(r"\s*[+-]?[0-9]+\s*", attrs.get("start", "")):
            frame.number = int(attrs["start"])
        self.stack.append(frame)
        if closed or name in VOID:
            self.close()

    def end(self, name: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].name == name:
                return self.close_to(i)

    def close_to(self, i: int) -> None:
        while len(self.stack) > i:
            self.close()

    def text(self, text: str) -> None:
        frame = self.stack[-1]
        frame.raw.append(text)
        self.inline(frame, _escape(_spaced(text)), blank=not text.strip())

    # what frames get

    def inline(self, frame: _Frame, md: str, blank: bool = False) -> None:
        """Inline Markdown for a frame: a list makes an item of it, tables and rows have no place for it."""
        if frame.name in ("ul", "ol"):
            if not blank and (item := _spaced(md).strip()):
                frame.blocks.append(f"- {item}")
        elif frame.name not in ("table", "thead", "tbody", "tfoot", "tr"):
            if frame.quoted:  # behind a highlight
                if blank:
                    return
                frame.quoted = False
            frame.run.append(md)

    def add(self, frame: _Frame, blocks: list[str]) -> None:
        """Finished blocks for a frame; inside a run they are words like others."""
        if not blocks:
            return
        if frame.inline or frame.name in ("ul", "ol"):
            words = " ".join(blocks).replace("\n", " ")
            if frame.run and not "".join(frame.run[-1:]).endswith(" "):
                words = " " + words
            self.inline(frame, words)
        elif frame.name not in ("table", "thead", "tbody", "tfoot", "tr"):
            self.flush(frame)
            frame.blocks += blocks

    def flush(self, frame: _Frame) -> None:
        """A frame's run becomes a paragraph."""
        text = "".join(frame.run).strip(_EDGES)
        frame.run = []
        if text and not re.fullmatch(r"[\\/ \xa0]*", text):
            frame.blocks.append(_guard(text))

    # what frames make

    def close(self) -> None:
        frame, below = self.stack.pop(), self.stack[-1]
        name = frame.name
        below.raw += ["\n"] if name == "br" else frame.raw
        if name in BLOCKS:
            make = getattr(self, f"_{name}", None) or (self._heading if frame.inline else None)
            if make:
                make(frame, below)
            else:
                self.flush(frame)
                self.add(below, frame.blocks)
            return
        inner = "".join(frame.run)
        if name == "br":
            self.inline(below, " " if frame.flat else "\\\n")
        elif name in MARKS:
            self._wrap(below, MARKS[name], inner)
        elif name in CODE:
            if below.name == "pre" and "class" in frame.attrs and not below.annotation:
                below.annotation = next((c[9:] for c in frame.attrs["class"].split() if c.startswith("language-")), "")
            self._code(below, _spaced("".join(frame.raw)))
        elif name == "a":
            href, (lead, label, trail) = frame.attrs.get("href", "").strip(), _split(inner)
            plain = not href or href.startswith("javascript:") or not inner.strip()
            self.inline(below, inner if plain else f"{lead}[{label}]({_target(href)}){trail}")
        elif name == "img":
            src = frame.attrs.get("src", "")
            if src.startswith(("http://", "https://")):
                self.inline(below, f"![{re.sub(r'[][]', '', frame.attrs.get('alt', ''))}]({_target(src)})")
        elif name == "span" and "data-annotation" in frame.attrs:
            self._highlight(frame, below)
        elif name == "span" and below.quoted and "citation" in frame.attrs.get("class", "").split():
            below.quoted = False  # says again where the highlight is from
        elif name not in SILENT and inner:
            self.inline(below, inner)

    def _wrap(self, below: _Frame, mark: str, inner: str) -> None:
        lead, core, trail = _split(inner)
        if not core:
            self.inline(below, inner)
        elif not lead and below.run and below.run[-1].endswith(mark) and not below.run[-1].endswith("\\" + mark):
            # marks of one kind side by side are one run
            below.run[-1] = below.run[-1][: -len(mark)] + f"{core}{mark}{trail}"
        else:
            self.inline(below, f"{lead}{mark}{core}{mark}{trail}")

    def _code(self, below: _Frame, text: str) -> None:
        if text.strip():
            ticks = "`" * (_longest(text, "`") + 1)
            pad = " " if text.startswith("`") or text.endswith("`") else ""
            self.inline(below, f"{ticks}{pad}{text}{pad}{ticks}")

    def _highlight(self, frame: _Frame, below: _Frame) -> None:
        """A highlight in a paragraph is a quote of its own; elsewhere it is text."""
        text = "".join(frame.raw)
        quote = None
        if not below.inline and below.name not in ("ul", "ol") and {"highlight", "underline"} & set(frame.attrs.get("class", "").split()):
            quote = self._quote(frame.attrs["data-annotation"], _spaced(text).strip())
        if quote is None:
            self.inline(below, _escape(_spaced(text)))
        else:
            self.flush(below)
            below.blocks.append(quote)
            below.quoted = True

    def _quote(self, data: str, text: str) -> str | None:
        try:
            data = json.loads(unquote(data))
        except ValueError:
            return None
        if text.startswith("“") and text.endswith("”"):
            text = text[1:-1]
        if not isinstance(data, dict) or not (text := text.strip()):
            return None
        body = _escape(text)
        item = (data.get("citationItem") or {}).get("uris") or [None]
        keys = [u.rsplit("/items/", 1)[1] for u in (data.get("attachmentURI"), item[0]) if isinstance(u, str) and "/items/" in u]
        source = next((self.sources[k] for k in keys if k in self.sources), None)
        if source is None:
            return re.sub("(?m)^", "> ", body)
        told = {"source": source, "page": (data.get("position") or {}).get("pageIndex"), "color": COLOURS.get(str(data.get("color", "")).strip().lower())}
        quoted = (f'{k}="' + str(v).replace("\\", "\\\\").replace('"', '\\"').replace("\n", " ") + '"' for k, v in told.items() if v is not None)
        fence = "`" * (max(_longest(body, "`"), 2) + 1)
        return f"{fence}quote {' '.join(quoted)}\n{body}\n{fence}"

    def _heading(self, frame: _Frame, below: _Frame) -> None:
        text = _spaced("".join(frame.run)).strip()
        self.add(below, [f"{'#' * int(frame.name[1])} {text}"] if text else [])

    def _blockquote(self, frame: _Frame, below: _Frame) -> None:
        self.flush(frame)
        inner = "\n\n".join(frame.blocks)
        self.add(below, [re.sub("(?m)^(?=(.?))", lambda m: "> " if m[1] else ">", inner)] if inner.strip() else [])

    def _pre(self, frame: _Frame, below: _Frame) -> None:
        code = "".join(frame.raw).strip("\n")
        fence = "`" * (max(_longest(code, "`"), 2) + 1)
        self.add(below, [f"{fence}{frame.annotation or ''}\n{code}\n{fence}"] if code.strip() else [])

    def _hr(self, frame: _Frame, below: _Frame) -> None:
        self.add(below, ["---"])

    def _li(self, frame: _Frame, below: _Frame) -> None:
        self.flush(frame)
        listed = below.name in ("ul", "ol")
        marker = "- "
        if below.name == "ol":
            marker = f"{below.number}. "
            below.number += 1
        if not frame.blocks:
            return
        item, was_list = marker + frame.blocks[0].replace("\n", "\n    "), False
        for block in frame.blocks[1:]:
            is_list = re.match(r"- |[0-9]*\. ", block) is not None
            item += ("\n" if is_list and not was_list else "\n\n") + _indent(block)
            was_list = is_list
        if listed:
            below.blocks.append(item)
        else:
            self.add(below, [item])

    def _ul(self, frame: _Frame, below: _Frame) -> None:
        inner = "\n".join(frame.blocks)
        if inner and below.name in ("ul", "ol"):
            # a list right in a list belongs to the item before it
            below.blocks[-1:] = [f"{below.blocks[-1]}\n{_indent(inner)}" if below.blocks else inner]
        else:
            self.add(below, [inner] if inner else [])

    _ol = _ul

    def _td(self, frame: _Frame, below: _Frame) -> None:
        self.flush(frame)
        if below.name == "tr":
            below.blocks.append(" ".join(frame.blocks).replace("\n", " ").replace("|", "\\|").strip())
        else:
            self.add(below, frame.blocks)

    _th = _td

    def _tr(self, frame: _Frame, below: _Frame) -> None:
        for above in reversed(self.stack):
            if above.name == "table":
                if frame.blocks:
                    above.blocks.append(frame.blocks)
                return
            if above.name in ("td", "th"):
                break
        self.add(below, frame.blocks)

    def _table(self, frame: _Frame, below: _Frame) -> None:
        rows = frame.blocks
        if not rows:
            return
        wide = max(map(len, rows))
        lines = ["| " + " | ".join(cell or " " for cell in row + [""] * (wide - len(row))) + " |" for row in rows]
        lines.insert(1, "|" + " --- |" * wide)
        self.add(below, ["\n".join(lines)])


def html_to_markdown(html: Column, sources: Column | None = None) -> Column:
    """Markdown of HTML: headings, emphasis, code, links, images, nested and numbered lists, quotes, fenced code, tables, rules.

    ``sources``: a map from keys to source ids; a highlight whose attachment or item has one becomes a quote block
    that names its source, page and colour, others become quotes. A null text gives null.
    """

    @F.pandas_udf("string")
    def plain(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else Writer().write(t))

    @F.pandas_udf("string")
    def sourced(texts: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else Writer(dict(k) if k is not None else None).write(t) for t, k in zip(texts, known, strict=True)], dtype=object)

    return plain(html) if sources is None else sourced(html, sources)


def note_text(html: Column) -> Column:
    """A note's plain text: tags of blocks break lines, other tags go, six entities are decoded, lines are trimmed and empty ones left out.

    A ``<`` inside a tag begins the tag anew; a tag that doesn't end takes the rest along.
    """
    out = F.regexp_replace(html, r"(?i)<(?:[^>]*<)?/*(?:p|br|div|li|h[1-4]|tr|blockquote)(?:[\s/][^<>]*)?>", "\n")
    out = F.regexp_replace(F.regexp_replace(out, "<[^>]*>", ""), "<[^>]*$", "")
    out = reduce(lambda o, e: F.replace(o, F.lit(e[0]), F.lit(e[1])), [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")], out)
    return F.array_join(F.filter(F.transform(F.split(out, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""), "\n")
