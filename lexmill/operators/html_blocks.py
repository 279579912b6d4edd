"""HTML to text that keeps blocks: paragraphs apart, list items marked."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements that end a block, and those whose content is not text.
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tr", "ul"}
SILENT = {"script", "style", "head", "title", "template", "noscript", "iframe", "textarea", "select"}


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.done: list[tuple[str, bool]] = []
        self.parts: list[str] = []
        self.silent, self.item = 0, False

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.done.append((("  • " if self.item else "") + text, self.item))
            self.item = False
        self.parts = []

    def handle_starttag(self, tag, attrs) -> None:
        if tag in SILENT:
            self.silent += 1
        elif tag == "br":
            self.parts.append(" ")
        elif tag in BLOCK:
            self.flush()
            self.item = tag == "li"

    def handle_endtag(self, tag) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in BLOCK:
            self.flush()
            self.item = False

    def handle_data(self, data) -> None:
        if not self.silent:
            self.parts.append(data)


def html_blocks(page: str | bytes | None) -> str | None:
    """Blocks with an empty line between them; neighbouring list items on lines of their own."""
    if page is None:
        return None
    parser = _Blocks()
    parser.feed(page.decode("utf-8", "ignore") if isinstance(page, bytes) else page)
    parser.close()
    parser.flush()
    out = ""
    for k, (text, item) in enumerate(parser.done):
        out += ("\n" if item and parser.done[k - 1][1] else "\n\n") * (k > 0) + text
    return out


def extract_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, text) of pages (page_id, html), a string or bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["page_id"], pa.array([html_blocks(h) for h in batch["html"].to_pylist()], pa.string())], names=["page_id", "text"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, text string")
