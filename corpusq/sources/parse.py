"""Document parsing: files to text blocks.

Text formats are read with Spark's own readers and column functions; formats
that need a parser are read as binary files and parsed in Arrow batches, one
file per row, with a typed warning row where a library or a format is missing.
"""

from __future__ import annotations

import base64
import csv
import importlib.util
import io
import json
import re
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.functions.text import strip_html

# File types that may be parsed and media types that may not.
ALLOWED = (
    "txt", "md", "markdown", "log", "json", "csv", "tsv", "html", "htm", "xml", "yaml", "yml", "py", "js", "ts",
    "java", "pdf", "doc", "docx", "ppt", "pptx", "xls", "xlsx", "png", "jpg", "jpeg", "gif", "bmp", "webp",
)
DENIED = ("mp3", "mp4", "wav", "avi", "mov", "mkv", "flac", "ogg", "webm", "m4a")
IMAGES = ("png", "jpg", "jpeg", "gif", "bmp", "webp")
ENGINES = ("", "builtin", "plain")
BLOCKS = "path string, block_index int, kind string, text string, metadata map<string,string>, warning string"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def allowed(path: Column) -> Column:
    return suffix(path).isin(*ALLOWED) & ~suffix(path).isin(*DENIED)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as one block each; blank files give none."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.lit(0).alias("block_index"), F.col("value").alias("text")).where(
        F.length(F.trim("text")) > 0
    )


def read_csv_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV rows as lines with cells joined by `` | ``, empty cells included."""
    rows = spark.read.schema(schema).csv(path)
    return rows.select(F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]).alias("line"))


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """HTML files without tags, scripts and styles."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), strip_html(F.col("value")).alias("text"))


def read_dataset(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON evaluation dataset; a path without files gives no rows."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except Exception as e:  # noqa: BLE001  only the missing path is answered
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


Block = tuple[str, str, dict, str | None]


def _text_blocks(data: bytes, kind: str) -> list[Block]:
    text = data.decode("utf-8", "ignore")
    if kind == "json":
        try:
            text = json.dumps(json.loads(text), indent=2, ensure_ascii=False)
        except ValueError:
            pass
    elif kind in ("csv", "tsv"):
        rows = csv.reader(io.StringIO(text), delimiter="\t" if kind == "tsv" else ",")
        text = "\n".join(" | ".join(r) for r in rows)
    elif kind in ("html", "htm"):
        bare = re.sub(r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>", "", text)
        text = re.sub(r"(?s)<[^>]+>", " ", bare)
    return [("text", text, {}, None)] if text.strip() else []


_IMAGE = re.compile(r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)")


def _markdown_blocks(data: bytes) -> list[Block]:
    """Text between images; embedded images become blocks, those elsewhere a warning."""
    text, out, at = data.decode("utf-8", "ignore"), [], 0
    for m in _IMAGE.finditer(text):
        target = m[2]
        if target.startswith(("data:", "http://", "https://")):
            if text[at : m.start()].strip():
                out.append(("text", text[at : m.start()], {}, None))
            at = m.end()
            if target.startswith("data:"):
                head, _, body = target.partition(",")
                try:
                    size = len(base64.b64decode(body, validate=True))
                    out.append(("image", m[1], {"mime": head[5:].split(";")[0], "bytes": str(size)}, None))
                except ValueError:
                    out.append(("image", m[1], {}, "image cannot be decoded"))
            else:
                out.append(("image", m[1], {"url": target}, "remote image is not fetched"))
        else:
            out.append(("warning", "", {"target": target}, "relative image stays text"))
    if text[at:].strip():
        out.append(("text", text[at:], {}, None))
    return out


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _docx_blocks(data: bytes) -> list[Block]:
    """Body paragraphs and tables in order; heading levels from style names."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out: list[Block] = []
    for node in body if body is not None else []:
        if node.tag == f"{_W}p":
            text = "".join(t.text or "" for t in node.iter(f"{_W}t"))
            style = node.find(f"{_W}pPr/{_W}pStyle")
            level = re.search(r"(?i)heading\s*(\d)", style.get(f"{_W}val", "") if style is not None else "")
            if text.strip():
                out.append(("text", text, {"heading": level[1]} if level else {}, None))
        elif node.tag == f"{_W}tbl":
            rows = [
                " | ".join("".join(t.text or "" for t in cell.iter(f"{_W}t")) for cell in row.findall(f"{_W}tc"))
                for row in node.findall(f"{_W}tr")
            ]
            out.append(("text", "\n".join(rows), {"table": str(len(rows))}, None))
    return out


def _pptx_blocks(data: bytes) -> list[Block]:
    """Text of each slide in slide order."""
    out: list[Block] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)]
        for name in sorted(names, key=lambda n: int(re.findall(r"\d+", n)[0])):
            root = ElementTree.fromstring(z.read(name))
            lines = ["".join(t.text or "" for t in p.iter(f"{_A}t")) for p in root.iter(f"{_A}p")]
            text = "\n".join(x for x in lines if x.strip())
            number = re.findall(r"\d+", name)[0]
            if text:
                out.append(("text", f"Slide {number}\n{text}", {"slide": number}, None))
    return out


def _cell_column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n


def _xlsx_blocks(data: bytes) -> list[Block]:
    """Non-empty rows of each sheet; the first of them is the header of the others."""
    out: list[Block] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        strings = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            strings = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in root.findall(f"{_S}si")]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        for sheet in sheets:
            header: dict[int, str] | None = None
            for row in ElementTree.fromstring(z.read(sheet)).iter(f"{_S}row"):
                cells, sources = {}, set()
                for c in row.findall(f"{_S}c"):
                    value = c.find(f"{_S}v")
                    text = value.text or "" if value is not None else "".join(t.text or "" for t in c.iter(f"{_S}t"))
                    if c.get("t") == "s" and text:
                        text = strings[int(text)]
                    formula = c.find(f"{_S}f") is not None
                    sources.add("cached" if formula and text else "formula" if formula else "literal")
                    if text.strip():
                        cells[_cell_column(c.get("r", "A1"))] = text
                if not cells:
                    continue
                if header is None:
                    header = cells
                    continue
                text = " | ".join(f"{header.get(k, '')}: {v}" if header.get(k) else v for k, v in sorted(cells.items()))
                about = {"sheet": re.findall(r"\d+", sheet)[0], "row": row.get("r", ""), "columns": f"{min(cells)}-{max(cells)}", "source": ",".join(sorted(sources))}
                out.append(("record", text, about, None))
    return out


def _image_blocks(data: bytes, kind: str) -> list[Block]:
    """Kind and size of an image from its first bytes."""
    about, size = {"type": kind, "bytes": str(len(data))}, None
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        about["mime"], size = "image/png", struct.unpack(">II", data[16:24])
    elif data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        about["mime"], size = "image/gif", struct.unpack("<HH", data[6:10])
    elif data[:2] == b"\xff\xd8":
        about["mime"] = "image/jpeg"
    elif data[:2] == b"BM" and len(data) >= 26:
        about["mime"], size = "image/bmp", struct.unpack("<ii", data[18:26])
    else:
        return [("image", "", about, "image cannot be read")]
    if size:
        about |= {"width": str(size[0]), "height": str(abs(size[1]))}
    return [("image", "", about, None)]


def _pdf_blocks(data: bytes) -> list[Block]:
    if importlib.util.find_spec("pypdf") is None:
        return [("warning", "", {}, "no PDF library is installed")]
    import pypdf

    out: list[Block] = []
    for i, page in enumerate(pypdf.PdfReader(io.BytesIO(data)).pages):
        text = page.extract_text() or ""
        about = {"page": str(i + 1)}
        out.append(("text", text, about, None) if text.strip() else ("warning", "", about, "page without text"))
    return out


def parse_bytes(path: str, data: bytes, engine: str = "") -> list[Block]:
    """Blocks (kind, text, metadata, warning) of a file, by its suffix; an
    unknown suffix is read as text, a broken file gives a warning."""
    if engine not in ENGINES:
        raise ValueError(f"engine is one of {ENGINES}")
    kind = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if kind in DENIED:
        return [("warning", "", {"type": kind}, "file type is not accepted")]
    if engine == "plain":
        return _text_blocks(data, "")
    try:
        if kind in ("md", "markdown"):
            return _markdown_blocks(data)
        if kind in ("doc", "ppt", "xls"):
            return [("warning", "", {"type": kind}, "legacy office formats are not converted")]
        special = {"docx": _docx_blocks, "pptx": _pptx_blocks, "xlsx": _xlsx_blocks, "pdf": _pdf_blocks}.get(kind)
        if special:
            return special(data)
        if kind in IMAGES:
            return _image_blocks(data, kind)
    except Exception as e:  # noqa: BLE001  one bad file must not end the job
        return [("warning", "", {"type": kind}, f"cannot be parsed: {type(e).__name__}")]
    return _text_blocks(data, kind)


def parse_files(files: DataFrame, engine: str = "") -> DataFrame:
    """Blocks of files given as (path, content), such as the binaryFile source reads."""
    if engine not in ENGINES:
        raise ValueError(f"engine is one of {ENGINES}")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = [
                (path, i, *block)
                for path, content in zip(frame["path"], frame["content"])
                for i, block in enumerate(parse_bytes(path, bytes(content or b""), engine))
            ]
            yield pd.DataFrame(rows, columns=["path", "block_index", "kind", "text", "metadata", "warning"])

    return files.select("path", "content").mapInPandas(parse, BLOCKS)


def read_files(spark: SparkSession, path: str, engine: str = "") -> DataFrame:
    """Blocks of all accepted files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return parse_files(files.where(allowed(F.col("path"))), engine)
