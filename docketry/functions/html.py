"""HTML to plain text with its block structure."""

from __future__ import annotations

import html
from html.parser import HTMLParser
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that begin and end a line, and elements whose content is no text of the page.
BLOCKS = {
    "article", "aside", "blockquote", "br", "div", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav",
    "ol", "p", "pre", "section", "table", "tbody", "thead", "tr", "ul",
}
DROPPED = {"noscript", "script", "style", "template"}
_CHARSET_AREA = 4096  # bytes in which a page may declare its charset


class _Recorder(HTMLParser):
    """Notes what the parser meets, in order, as (kind, element, value); it decides nothing."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.seen: list[tuple[str, str, object]] = []
        self.handle_starttag = lambda tag, attrs: self.seen.append(("open", tag, {k: v for k, v in reversed(attrs) if v}))
        self.handle_endtag = lambda tag: self.seen.append(("close", tag, None))
        self.handle_data = lambda data: self.seen.append(("text", "", data))
        self.feed(source)
        self.close()


def _split(seen):
    """The events of the page's body, and the text of its title up to the last title that was closed."""
    body, heading, title = [], [], None
    hidden, inside = 0, set()
    for event in seen:
        kind, element, value = event
        if element in DROPPED:
            hidden = max(0, hidden + (1 if kind == "open" else -1))
        elif element in ("head", "title"):
            (inside.add if kind == "open" else inside.discard)(element)
            if (kind, element) == ("close", "title"):
                title = "".join(heading).strip() or None
        elif hidden:
            continue
        elif kind == "text" and "title" in inside:
            heading.append(value)
        elif "head" not in inside:
            body.append(event)
    return body, title


#: What an element puts down where it opens; any other block element begins a line.
_OPENING = {
    "br": lambda given: "\n",
    "li": lambda given: "\n- ",
    "a": lambda given: "" if "href" in given else None,
    "img": lambda given: f"[image: {given['alt']}]" if "alt" in given else None,
}


def _lines(body) -> list[str]:
    """The body as lines: list items marked, links followed by their address, images by their description."""
    parts, targets, marked = [""], [], False
    for kind, element, value in body:
        if kind == "text":
            parts.append(value.lstrip() if marked else value)
            marked = False
            continue
        if kind == "close":
            put = f" ({targets.pop()})" if element == "a" and targets else "\n" if element in BLOCKS else None
        elif element in _OPENING:
            put = _OPENING[element](value)
            marked |= element == "li"
            targets += [value["href"]] if element == "a" and "href" in value else []
        else:
            put = "\n" if element in BLOCKS and len(parts) > 1 and not parts[-1].endswith("\n") else None
        if put is not None:
            parts.append(put)
    return [x.rstrip() for x in "".join(parts).split("\n")]


def charset_of(raw: bytes) -> str:
    """The charset that a meta element in the first bytes declares, else utf-8."""
    head = raw[:_CHARSET_AREA].decode("latin-1")
    at = 0
    while (at := head.lower().find("<meta", at)) >= 0:
        end = head.find(">", at)
        inner = head[at : end if end >= 0 else len(head)]
        name, sign, value = inner[inner.lower().find("charset") + 7 :].partition("=") if "charset" in inner.lower()[6:] else ("x", "", "")
        word = value.lstrip().lstrip("'\"") if sign and not name.strip() else ""
        size = next((i for i, c in enumerate(word) if not (c.isascii() and (c.isalnum() or c in "_-:."))), len(word))
        if size:
            return word[:size].lower()
        at += 5
    return "utf-8"


def render(raw: bytes) -> tuple[str, str | None, str]:
    """(text, title, charset). Entities are resolved before parsing, so escaped markup becomes markup. Two or more blank lines become one."""
    charset = charset_of(raw)
    try:
        source = raw.decode(charset, "replace")
    except LookupError:
        charset, source = "utf-8", raw.decode("utf-8", "replace")
    body, title = _split(_Recorder(html.unescape(source)).seen)
    runs = [list(run) if full else [""] for full, run in groupby(_lines(body), key=bool)]
    text = "\n".join(x for run in runs for x in run).strip()
    return text + "\n" if text else "", title, charset


def _render_all(raw: pd.Series) -> pd.DataFrame:
    out = [render(bytes(r)) if r is not None else (None, None, None) for r in raw]
    return pd.DataFrame(out, columns=["text", "title", "charset"])


def rendered(raw: Column) -> Column:
    """Struct (text, title, charset) of HTML bytes; nulls for null."""
    return F.pandas_udf(_render_all, "text string, title string, charset string")(raw)
