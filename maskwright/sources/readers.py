"""Text of document files, and documents written back. Files come through Spark's binaryFile source, from any file system."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Encodings in the order they are tried; name spaces of document formats.
ENCODINGS = ("utf-8", "utf-8-sig", "cp1251", "latin-1")
WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL_NS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
ODT_TEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"


class Unsupported(ValueError):
    """A format that this installation can't read."""


def decode(data: bytes) -> str:
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    raise AssertionError("latin-1 takes any bytes")


def _paragraph(p: ElementTree.Element) -> str:
    return "".join("\t" if t.tag == WORD_NS + "tab" else "\n" if t.tag == WORD_NS + "br" else t.text or "" for t in p.iter() if t.tag in (WORD_NS + "t", WORD_NS + "tab", WORD_NS + "br"))


def docx_parts(box: zipfile.ZipFile) -> list[str]:
    """The body first, then headers and footers."""
    names = [n for n in box.namelist() if re.fullmatch(r"word/(?:header|footer)\d*\.xml", n)]
    return ["word/document.xml", *sorted(names)]


def docx(data: bytes) -> str:
    """Paragraphs by line; a table's row by line with tabs between cells; then headers and footers, each different one once."""
    lines: list[str] = []
    with zipfile.ZipFile(io.BytesIO(data)) as box:
        for name in docx_parts(box):
            root, own = ElementTree.fromstring(box.read(name)), []

            def walk(node: ElementTree.Element, own: list[str] = own) -> None:
                for child in node:
                    if child.tag == WORD_NS + "p":
                        own.append(_paragraph(child))
                    elif child.tag == WORD_NS + "tr":
                        own.append("\t".join(" ".join(map(_paragraph, cell.iter(WORD_NS + "p"))) for cell in child.iter(WORD_NS + "tc")))
                    else:
                        walk(child)

            walk(root)
            text = "\n".join(own)
            if name == "word/document.xml" or text.strip() and text not in lines:
                lines.append(text)
    return "\n".join(lines)


def docx_rebuilt(data: bytes, replace: dict[str, str]) -> bytes:
    """The document with each surface form replaced in its paragraphs. Structure stays; a changed paragraph keeps its first run's format."""
    word = "0-9A-Za-zА-Яа-яЁё"
    bound = lambda v: (f"(?<![{word}])" if v[0].isalnum() else "") + re.escape(v) + (f"(?![{word}])" if v[-1].isalnum() else "")
    pattern = re.compile("|".join(map(bound, sorted(filter(None, replace), key=len, reverse=True)))) if any(replace) else None
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as box, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as to:
        texts = set(docx_parts(box))
        for item in box.infolist():
            body = box.read(item.filename)
            if pattern and item.filename in texts:
                root = ElementTree.fromstring(body)
                for p in root.iter(WORD_NS + "p"):
                    runs = list(p.iter(WORD_NS + "t"))
                    old = "".join(t.text or "" for t in runs)
                    new = pattern.sub(lambda m: replace[m[0]], old)
                    if runs and new != old:
                        runs[0].text = new
                        for t in runs[1:]:
                            t.text = ""
                body = ElementTree.tostring(root, encoding="utf-8", xml_declaration=True)
            to.writestr(item, body)
    return out.getvalue()


def xlsx(data: bytes) -> str:
    """All sheets' rows, cells by tabs; stored values, not formulas."""
    with zipfile.ZipFile(io.BytesIO(data)) as box:
        names = set(box.namelist())
        shared = ["".join(t.text or "" for t in x.iter(SHEET_NS + "t")) for x in ElementTree.fromstring(box.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        lines = []
        for name in sheets:
            for row in ElementTree.fromstring(box.read(name)).iter(SHEET_NS + "row"):
                cells = []
                for c in row.iter(SHEET_NS + "c"):
                    v = c.find(SHEET_NS + "v")
                    inline = "".join(t.text or "" for t in c.iter(SHEET_NS + "t"))
                    cells.append(shared[int(v.text)] if c.get("t") == "s" and v is not None else v.text if v is not None else inline)
                if any(cells):
                    lines.append("\t".join(x or "" for x in cells))
    return "\n".join(lines)


def xml(data: bytes) -> str:
    return "\n".join(t.strip() for t in ElementTree.fromstring(data).itertext() if t.strip())


def odt(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as box:
        root = ElementTree.fromstring(box.read("content.xml"))
    return "\n".join("".join(p.itertext()) for p in root.iter() if p.tag in (ODT_TEXT + "p", ODT_TEXT + "h"))


def rtf(data: bytes) -> str:
    """Without control words; byte and Unicode escapes become characters."""
    text = data.decode("latin-1")
    text = re.sub(r"\{\\\*?\\?(?:fonttbl|colortbl|stylesheet|info)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", text)
    text = re.sub(r"(?:\\'[0-9a-fA-F]{2})+", lambda m: bytes.fromhex(m[0].replace("\\'", "")).decode("cp1251", "replace"), text)
    text = re.sub(r"\\u(-?\d+)\??", lambda m: chr(int(m[1]) % 65536), text)
    text = re.sub(r"\\(?:par|line)\b ?", "\n", text)
    return re.sub(r"\\[a-zA-Z]+-?\d* ?|[{}]|\\(?=[^a-zA-Z])", "", text).strip()


def pdf(data: bytes) -> str:
    try:
        from pypdf import PdfReader
    except ImportError:
        raise Unsupported("reading .pdf needs pypdf") from None
    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)


def xls(data: bytes) -> str:
    try:
        import xlrd
    except ImportError:
        raise Unsupported("reading .xls needs xlrd") from None
    book = xlrd.open_workbook(file_contents=data)
    return "\n".join("\t".join(str(v) for v in s.row_values(k)) for s in book.sheets() for k in range(s.nrows))


def doc(data: bytes) -> str:
    import shutil
    import subprocess

    for tool in ("antiword", "catdoc"):
        if shutil.which(tool):
            done = subprocess.run([tool, "-"], input=data, capture_output=True, timeout=120)
            if done.returncode == 0:
                return decode(done.stdout)
    raise Unsupported("reading .doc needs antiword or catdoc")


def refused(data: bytes) -> str:
    raise Unsupported("presentations aren't read")


READERS: dict[str, Callable[[bytes], str]] = {
    "docx": docx, "xlsx": xlsx, "xlsm": xlsx, "xml": xml, "odt": odt, "rtf": rtf, "pdf": pdf, "xls": xls, "doc": doc, "pptx": refused, "ppt": refused,
}


def text_of(name: str, data: bytes) -> str:
    """By the name's extension; unknown ones are decoded as text."""
    return READERS.get(name.rpartition(".")[2].lower(), decode)(data)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, name, text, error: one row for each file. A file that can't be read has null text and an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = error = None
                try:
                    text = text_of(path, data or b"")
                except Exception as e:  # noqa: BLE001 - one bad file is a row with an error
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_pylist([{"path": path, "name": path.rpartition("/")[2], "text": text, "error": error}], schema=pa.schema([(c, pa.string()) for c in ("path", "name", "text", "error")]))

    return files.mapInArrow(run, "path string, name string, text string, error string")


def mask_files(spark: SparkSession, path: str, config=None) -> DataFrame:
    """path, masked, mapping (JSON), rebuilt (a .docx with its structure, else null), error: one row for each file. Documents are rebuilt
    from surface forms, so that inflected and merged names don't stay readable."""
    import json

    from ..plans.masking import PipelineConfig, mask

    config = config or PipelineConfig()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    schema = pa.schema([("path", pa.string()), ("masked", pa.string()), ("mapping", pa.string()), ("rebuilt", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detectors = config.detectors()
        for batch in batches:
            for where, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = dict.fromkeys(schema.names) | {"path": where}
                try:
                    r = mask(text_of(where, data or b""), config, detectors)
                    row |= {"masked": r.masked, "mapping": None if config.irreversible else json.dumps(r.mapping, ensure_ascii=False)}
                    row["rebuilt"] = docx_rebuilt(data, r.surfaces) if where.lower().endswith(".docx") else None
                except Exception as e:  # noqa: BLE001 - one bad file is a row with an error, never its text
                    row["error"] = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    return files.mapInArrow(run, "path string, masked string, mapping string, rebuilt binary, error string")


def read_benchmark(spark: SparkSession, path: str, sample: float | None = None, seed: int = 42, limit: int | None = None) -> DataFrame:
    """row, text, tokens, ner_tags from a CSV with text, tokens and ner_tags (JSON arrays)."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"').select("text", F.from_json("tokens", "array<string>").alias("tokens"), F.from_json("ner_tags", "array<string>").alias("ner_tags"))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "text", "tokens", "ner_tags")
    rows = rows if sample is None else rows.sample(sample, seed)
    return rows if limit is None else rows.orderBy("row").limit(limit)


def write_masked(results: DataFrame, path: str, mapping_path: str | None, id_col: str = "doc_id") -> None:
    """Masked texts and mappings as JSON lines in separate places; mapping_path None: no mapping is written."""
    results.select(id_col, "masked").write.mode("append").json(path)
    if mapping_path is not None:
        results.select(id_col, "mapping").write.mode("append").json(mapping_path)


#: Signs of filled and of blank forms.
FORM_FEATURES = {
    "placeholders": r"_{3,}|\.{5,}|…{2,}",
    "markers": r"(?i)\((?:фио|подпись|дата|указать|наименование)[^)]*\)",
    "fio": r"[А-ЯЁ][а-яё]+\s+[А-ЯЁ][а-яё]+\s+[А-ЯЁ][а-яё]+(?:вич|вна)|[А-ЯЁ][а-яё]+\s+[А-ЯЁ]\.\s?[А-ЯЁ]\.",
    "dates": r"\b\d{1,2}\.\d{1,2}\.\d{4}\b",
    "money": r"(?i)\d[\d\s]*(?:руб|₽)",
    "requisites": r"(?i)(?:ИНН|КПП|БИК|ОГРН)\D{0,5}\d{5,}",
}


def form_features(docs: DataFrame) -> DataFrame:
    """docs with chars, counts of FORM_FEATURES, pii, filled (null: can't tell) and a hash for dropDuplicates."""
    from ..functions.extract import pieces

    n = lambda p: ((F.size(pieces(F.coalesce("text", F.lit("")), "(?U)" + p)) - 1) / 2).cast("int")
    out = docs.withColumns({k: n(p) for k, p in FORM_FEATURES.items()} | {"chars": F.length(F.coalesce("text", F.lit(""))), "sha256": F.sha2("text", 256)})
    out = out.withColumn("pii", F.col("fio") + F.col("dates") + F.col("money") + F.col("requisites"))
    signs = F.col("placeholders") + F.col("markers")
    filled = F.when(F.col("chars") < 120, None).when(F.col("pii") >= 4, True).when((F.col("pii") >= 2) & (F.col("placeholders") <= 3) & (F.col("markers") == 0), True).when((signs >= 6) | (F.col("pii") == 0), False)
    return out.withColumn("filled", filled)
