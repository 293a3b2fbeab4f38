"""Broker statements in HTML (S1, S2): one row per statement, with its tables, in parallel by file.

The Python stage only turns markup into cells. A task holds a hundred statements at a time, and
everything after it (sections, columns, rows) is column expressions without a shuffle.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.cleaning import SPACES
from tallyforge.operators.staging import dealt_out

# Encodings tried after the declared one, spaces, elements without an end tag.
ENCODINGS = ("utf-8", "cp1251", "koi8-r")
SPACE = re.compile("[ \\t\\r\\n          ]+")
#: A file without any of these has single spaces already.
ODD = ("  ", "&", "\t", "\r", "\n", *SPACES)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An element of the key ends open elements of the value, up to the nearest one of the last item.
ENDS = {
    "td": (("td", "th"), "tr"), "th": (("td", "th"), "tr"), "tr": (("td", "th", "tr"), "table"), "li": (("li",), "ul"),
    **{t: (("td", "th", "tr", "thead", "tbody", "tfoot"), "table") for t in ("thead", "tbody", "tfoot")},
    **{t: (("p",), "td") for t in ("p", "div", "table", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6")},
}
NUMERIC = re.compile(r"[-+(]?[\d\s .,]+\)?")
CHARSET = re.compile(rb"""charset\s*=\s*["']?([A-Za-z0-9_-]+)""", re.I)
#: Tags without attributes of elements whose content is markup: most of a statement, and nothing else needs the library's full reading of a tag.
PLAIN_START = re.compile(r"<(td|th|tr|table|thead|tbody|tfoot|caption|div|p|span|b|i|li|ul|ol|h[1-6])>")
PLAIN_END = re.compile(PLAIN_START.pattern.replace("<", "</", 1))
#: Cuts a file at rows of nothing but plain cells (group 1) and at such tags (group 2); where no < is left over, the library would read no more than this.
PLAIN = re.compile(r"<(?:tr>((?:<td>[^<&]*</td>|<th>[^<&]*</th>)*)</tr|(/?(?:html|head|body|" + PLAIN_START.pattern[2:-2] + r")))>")
PLAIN_CELL = re.compile("<(td|th)>([^<]*)")
SECTIONS = ("thead", "tbody", "tfoot")
#: Texts before a table that are kept.
TEXTS = 3

TEXT_LIST = pa.list_(pa.string())
TABLES_ARROW = pa.list_(pa.struct([("idx", pa.int32()), ("caption", pa.string()), ("before", TEXT_LIST), ("headers", TEXT_LIST), ("rows", pa.list_(TEXT_LIST))]))
TABLES = "array<struct<idx int, caption string, before array<string>, headers array<string>, rows array<array<string>>>>"


def readable(content: bytes, name: str) -> bool:
    """Whether the bytes are valid in the encoding, and the encoding is known."""
    try:
        codecs.getincrementaldecoder(name)("strict").decode(content, True)
    except (LookupError, UnicodeDecodeError):
        return False
    return True


def decode(content: bytes | None) -> str:
    """The text in the declared encoding, if the bytes are valid in it, else in the first usual one in which they are."""
    content = bytes(content or b"")
    declared = [m.decode("ascii").lower() for m in CHARSET.findall(content[:4096])[:1]]
    encoding = next(filter(lambda name: readable(content, name), chain(declared, ENCODINGS)), None)
    return content.decode(encoding) if encoding else content.decode("utf-8", "replace")


class Tables(HTMLParser):
    """Collects tables while it reads; open elements are a stack, texts are spans of one list of pieces."""

    def __init__(self, markup: str):
        super().__init__()
        self.pieces: list[str] = []
        self.open: list[dict] = [{"tag": "", "start": 0, "lead": None, "closed": []}]
        self.found: list[dict] = []
        self.single = not any(x in markup for x in ODD)
        parts = PLAIN.split(markup)
        if not any("<" in x for x in parts[::3]):
            self.cut(parts)
        else:
            self.feed(markup)
            self.close()
        while len(self.open) > 1:
            self.end()

    def cut(self, parts: list[str | None]) -> None:
        """Texts, each with the row or the tag after it."""
        for text, row, tag in zip(parts[::3], [*parts[1::3], None], [*parts[2::3], None]):
            if text:
                self.handle_data(unescape(text) if "&" in text else text)
            if row is not None:
                self.row(PLAIN_CELL.findall(row if self.single else SPACE.sub(" ", row)))
            elif tag is not None:
                self.handle_endtag(tag[1:]) if tag[0] == "/" else self.handle_starttag(tag, [])

    def row(self, cells: list[tuple[str, str]]) -> None:
        """A row of (tag, text with single spaces): in a table at once, elsewhere tag by tag."""
        parent = self.open[-1]
        table = self.open[-2] if parent["tag"] in SECTIONS else parent
        if table["tag"] == "table":
            start = len(self.pieces)
            if parent["lead"] is None:
                parent["lead"] = start
            self.pieces += [text for _, text in cells]
            table["table"]["lines"].append([(tag, text.strip(" ")) for tag, text in cells])
            parent["closed"].append(("tr", start, len(self.pieces)))
            return
        self.handle_starttag("tr", [])
        for tag, text in cells:
            self.handle_starttag(tag, [])
            self.handle_data(text)
            self.handle_endtag(tag)
        self.handle_endtag("tr")

    def text(self, start: int, end: int | None = None) -> str:
        x = "".join(self.pieces[start:end]) if start != end else ""
        # two pieces may meet in two spaces
        return (x if self.single and "  " not in x else SPACE.sub(" ", x)).strip(" ")

    def nearest(self, tag: str) -> dict | None:
        return next((e for e in reversed(self.open) if e["tag"] == tag), None)

    def before(self) -> list[str]:
        """Up to ``TEXTS`` texts before here: earlier siblings of every open element, back to a table, and what opens its parent."""
        out: list[str] = []
        for e in reversed(self.open):
            for tag, start, end in reversed(e["closed"]):
                if tag == "table" or len(out) >= TEXTS:
                    break
                if t := self.text(start, end):
                    out.append(t)
            lead = self.text(e["start"], e["lead"]) if e["lead"] is not None else ""
            if lead and len(out) < TEXTS:
                out.append(lead)
        return out[::-1]

    def updatepos(self, i, j):
        return j  # lines are not counted

    def parse_starttag(self, i):
        m = PLAIN_START.match(self.rawdata, i)
        if m is None:
            return super().parse_starttag(i)
        self.handle_starttag(m[1], [])
        return m.end()

    def parse_endtag(self, i):
        m = PLAIN_END.match(self.rawdata, i) if self.cdata_elem is None else None
        if m is None:
            return super().parse_endtag(i)
        self.handle_endtag(m[1])
        return m.end()

    def handle_starttag(self, tag, attrs):
        if tag in ENDS:
            over, until = ENDS[tag]
            at = len(self.open)
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i]["tag"] in (until, "table"):
                    break
                if self.open[i]["tag"] in over:
                    at = i
            while len(self.open) > at:
                self.end()
        parent, here = self.open[-1], len(self.pieces)
        if parent["lead"] is None:
            parent["lead"] = here
        e = {"tag": tag, "start": here, "lead": None, "closed": []}
        if tag == "table":
            e["table"] = {"idx": len(self.found), "caption": None, "before": self.before(), "lines": []}
            self.found.append(e["table"])
        elif tag == "tr" and (t := self.nearest("table")):
            e["cells"] = []
            t["table"]["lines"].append(e["cells"])
        elif tag in ("td", "th") and (r := self.nearest("tr")) and "cells" in r:
            e["cell"] = [tag, ""]
            r["cells"].append(e["cell"])
        if tag not in VOID:
            self.open.append(e)
        else:
            parent["closed"].append((tag, here, here))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i]["tag"] == tag:
                while len(self.open) > i:
                    self.end()
                return
            if self.open[i]["tag"] == "table":
                return

    def end(self):
        e = self.open.pop()
        if "cell" in e:
            e["cell"][1] = self.text(e["start"])
        if e["tag"] == "caption" and (t := self.nearest("table")) and t["table"]["caption"] is None:
            t["table"]["caption"] = self.text(e["start"])
        self.open[-1]["closed"].append((e["tag"], e["start"], len(self.pieces)))

    def handle_data(self, data):
        self.pieces.append(data)


def table_of(found: dict) -> dict:
    """The header row and the rows under it: a row of only ``th``, else a first row without numbers."""
    header, rows, taken = [], [], False
    for cells in found["lines"]:
        values = [v for _, v in cells]
        if cells and not taken and all(t == "th" for t, _ in cells):
            header, taken = values, True
        elif cells:
            rows.append(values)
    if not taken and rows and not any(NUMERIC.fullmatch(v) and any(c.isdigit() for c in v) for v in rows[0]):
        header, rows = rows[0], rows[1:]
    return {"idx": found["idx"], "caption": found["caption"] or "", "before": found["before"], "headers": header, "rows": rows}


#: Statements whose tables are held at once.
TOGETHER = 100


def statements(files: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """(report, text, tables) of every file: its decoded markup and its tables in document order.

    Null or blank content has no tables; equal files give equal rows.
    """
    d = files.select(F.col(id_col).cast("string").alias("report"), F.col(content_col).cast("binary").alias("content"))
    # parsing is dear and bytes are few: by size alone many statements would be one task's
    d = dealt_out(d, "report")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                reports, contents = batch.slice(at, TOGETHER).columns
                texts = [decode(x) for x in contents.to_pylist()]
                tables = [[table_of(t) for t in Tables(x).found] if x.strip() else [] for x in texts]
                yield pa.RecordBatch.from_arrays([reports, pa.array(texts, pa.string()), pa.array(tables, TABLES_ARROW)], ["report", "text", "tables"])

    return d.mapInArrow(run, f"report string, text string, tables {TABLES}")


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """Statements from a folder of HTML files, keyed by their content's sha256; a file stored twice counts once and one without bytes not at all."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.htm*").load(path)
    return statements(files.select(F.sha2("content", 256).alias("report"), "content").dropDuplicates(["report"]), "report", "content")
