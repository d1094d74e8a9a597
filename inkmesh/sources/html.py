"""HTML to Markdown: ATX headings, ``-`` bullets, fenced code, ``*`` and ``**``, inlined links."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_DROPPED = {"script", "style", "noscript"}
_BLOCKS = {"p", "div", "section", "article", "header", "footer", "nav", "main", "aside", "ul", "ol", "table", "tr", "figure", "form", "body", "html", "head", "title", "dl", "dd", "dt", "address", "fieldset", "h1", "h2", "h3", "h4", "h5", "h6"}
_VOID = {"br", "hr", "img", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Markdown(HTMLParser):
    """Writes as it reads; ``stack`` holds (tag, index into ``out`` where it began, attributes)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.stack: list[tuple[str, int, dict]] = []
        self.hidden = self.pre = 0

    def handle_starttag(self, tag: str, attrs) -> None:  # noqa: ANN001
        attrs = {k: v or "" for k, v in attrs}
        # what HTML ends without being told
        ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, ("p",) if tag in _BLOCKS | {"pre", "blockquote", "li"} else ())
        while self.stack and self.stack[-1][0] in ends:
            self.close(*self.stack.pop())
        if tag in _DROPPED:
            self.hidden += 1
        if tag == "br":
            self.out.append("  \n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag == "img" and attrs.get("src"):
            self.out.append(f"![{attrs.get('alt', '')}]({attrs['src']})")
        if tag in _VOID:
            return
        if tag == "pre":
            self.pre += 1
        self.stack.append((tag, len(self.out), attrs))

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, *_ in self.stack):
            return
        while self.stack:
            own, at, attrs = self.stack.pop()
            self.close(own, at, attrs)
            if own == tag:
                return

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        if not self.pre:
            data = re.sub(r"[ \t\r\n]+", " ", data)
            data = re.sub(r"([\\`*_\[\]])", r"\\\1", data)
        self.out.append(data)

    def close(self, tag: str, at: int, attrs: dict) -> None:
        inner = "".join(self.out[at:])
        if tag in _DROPPED:
            self.hidden -= 1
            inner = ""
        elif tag == "pre":
            self.pre -= 1
            fence = "`" * max(3, max((len(m) + 1 for m in re.findall("`+", inner)), default=0))
            inner = f"\n\n{fence}\n{inner.rstrip(chr(10))}\n{fence}\n\n"
        elif re.fullmatch("h[1-6]", tag):
            inner = f"\n\n{'#' * int(tag[1])} {' '.join(inner.split())}\n\n"
        elif tag in ("b", "strong", "i", "em"):
            mark = "**" if tag in ("b", "strong") else "*"
            core = inner.strip()
            inner = inner.replace(core, f"{mark}{core}{mark}", 1) if core else inner
        elif tag == "code" and not self.pre:
            inner = f"`{inner}`" if inner else ""
        elif tag == "a" and attrs.get("href"):
            inner = f"[{inner.strip()}]({attrs['href']})"
        elif tag == "li":
            ordered = next((t == "ol" for t, *_ in reversed(self.stack) if t in ("ul", "ol")), False)
            head = "1.  " if ordered else "-   "
            inner = "\n" + head + re.sub(r"\n", "\n    ", inner.strip()) + "\n"
        elif tag == "blockquote":
            inner = "\n\n" + "\n".join(f"> {x}".rstrip() for x in _tidy(inner).split("\n")) + "\n\n"
        elif tag in _BLOCKS:
            inner = f"\n\n{inner.strip(' ')}\n\n"
        self.out[at:] = [inner]


def _tidy(text: str) -> str:
    text = re.sub(r"(?m)^ +(?=\S)(?!    )|(?<! ) $", lambda m: "" if len(m[0]) < 4 else m[0], text)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def to_markdown(html: str) -> str:
    """Empty for a page without text, else ended by one line end."""
    parser = _Markdown()
    parser.feed(html)
    while parser.stack:
        parser.close(*parser.stack.pop())
    text = _tidy("".join(parser.out))
    return f"{text}\n" if text else ""


@F.pandas_udf(StringType())
def markdown(html: pd.Series) -> pd.Series:
    return html.map(lambda h: None if h is None else to_markdown(h))
