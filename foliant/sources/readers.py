"""Readers: a folder of mixed files to document rows, the event log, definition and evaluation files.

Files come through ``binaryFile``; text formats are decoded by expressions, the others by an Arrow
function on the executors. A file that can't be read gives a row with an error, never a failed job.
"""

from __future__ import annotations

import csv
import io
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import newlines, strip, suffix, title_case

#: Source types by suffix (fixed values).
TYPES = {".txt": "text", ".md": "text", ".html": "html", ".htm": "html", ".pdf": "pdf", ".docx": "docx", ".xlsx": "xlsx", ".xlsm": "xlsx", ".csv": "csv"}
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def decoded(content: Column) -> Column:
    """UTF-8 text without undecodable bytes, newlines made one kind."""
    return newlines(F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit("")))


class _TextNodes(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.skip:
            self.skip -= 1

    def handle_data(self, data):
        if not self.skip and data.strip():
            self.out.append(data.strip())


def html_lines(raw: bytes) -> str:
    """Every text node on a line of its own; scripts, styles and comments left out."""
    p = _TextNodes()
    p.feed(raw.decode("utf-8", "ignore"))
    p.close()
    return "\n".join(p.out)


def csv_lines(raw: bytes) -> str:
    return "\n".join(" | ".join(row) for row in csv.reader(io.StringIO(raw.decode("utf-8", "ignore"))))


def docx_lines(raw: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    texts = ("".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in body.findall(f"{_WORD}p"))
    return "\n".join(t for t in texts if t.strip())


def xlsx_lines(raw: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(f"{_SHEET}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"):
            out.append(f"[Sheet: {sheet.get('name')}]")
            target = links[sheet.get(f"{_REL}id")].lstrip("/")
            for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_SHEET}row"):
                cells = [_cell(c, shared) for c in row.findall(f"{_SHEET}c")]
                if any(cells):
                    out.append(" | ".join(cells))
    return "\n".join(out)


def _cell(c, shared: list[str]) -> str:
    if c.get("t") == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_SHEET}t"))
    v = c.find(f"{_SHEET}v")
    if v is None or v.text is None:
        return ""
    return shared[int(v.text)] if c.get("t") == "s" else v.text


def pdf_lines(raw: bytes) -> str:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF needs the optional package pypdf") from e
    return "\n\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(raw)).pages)


_BINARY = {"html": html_lines, "csv": csv_lines, "docx": docx_lines, "xlsx": xlsx_lines, "pdf": pdf_lines}


_GOT = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])


def _read(content, kind):
    if kind not in _BINARY:
        return None
    try:
        return {"text": _BINARY[kind](bytes(content)), "error": None}
    except Exception as e:  # a row tells of it; other files go on
        return {"text": None, "error": f"{type(e).__name__}: {e}"}


def read_folder(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(source_path, source_type, suffix, filename, text, error): unsupported files have the error ``unsupported``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return documents(files)


def documents(files: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Document rows of a ``binaryFile`` frame, batch or streaming; ``also``: columns of it that stay."""
    end = suffix(F.col("path"))
    kinds = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    f = files.select(F.col("path").alias("source_path"), F.regexp_extract("path", "([^/]*)$", 1).alias("filename"), end.alias("suffix"), F.try_element_at(kinds, end).alias("source_type"), "content", *also)
    got = F.when(F.col("source_type").isin(*_BINARY), F.udf(_read, _GOT, useArrow=True)("content", "source_type"))
    f = f.withColumn("got", got)
    text = F.when(F.col("source_type") == "text", decoded(F.col("content"))).otherwise(F.col("got.text"))
    error = F.when(F.col("source_type").isNull(), F.lit("unsupported")).otherwise(F.col("got.error"))
    return f.select("source_path", "source_type", "suffix", "filename", text.alias("text"), error.alias("error"), *also)


EVENT_SCHEMA = "ts string, event string, path string, status string, error string, document_kind string, client_name string, source_type string, text_chars long, total_chunks long, chunk_index long"


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """The JSONL event log; blank and malformed lines are dropped, a missing event is ``unknown``."""
    log = spark.read.schema(EVENT_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return log.withColumn("event", F.coalesce("event", F.lit("unknown"))).withColumn("ts", F.try_to_timestamp("ts")).withColumn("line", F.monotonically_increasing_id())


#: The fields and questions asked for where a file defines none.
DEFAULT_FIELDS = (
    ("scope", "Project Scope", "What is this project about and what is the scope of work?"),
    ("participants", "Participants", "Who are the key people, teams, or stakeholders involved?"),
    ("timeline", "Timeline", "What dates, milestones, or sequencing are known?"),
    ("commercial", "Commercial", "What budget, quote, PO, invoice, or logistics details are known?"),
    ("findings", "Findings", "What key findings, issues, or risks are documented?"),
    ("recommendations", "Recommendations", "What actions or recommendations are documented?"),
    ("gaps", "Known Gaps", "What important information is missing or uncertain?"),
)
DEFAULT_QUESTIONS = (
    ("scope", "What is this project about and what is the work scope?"),
    ("participants", "Who are the key people or teams involved?"),
    ("timeline", "What dates, milestones, or sequencing are relevant?"),
    ("commercial", "What budget, quote, PO, invoice, or logistics status is evidenced?"),
    ("risks_actions", "What key risks/issues and recommended actions are evidenced?"),
    ("missing_info", "What important information is still missing or uncertain?"),
)


def _definition_lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, v): the lines of one definition file that are neither blank nor comments, in their order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(newlines(F.col("value")), "\n")).alias("at", "v"))
    return lines.withColumn("v", strip(F.col("v"))).where("v != '' and not startswith(v, '#')")


def key_fields(spark: SparkSession, path: str) -> DataFrame:
    """(position, key, label, prompt) of lines ``key|label|prompt``, ``key|prompt`` (the label is the key in words) or ``key`` (the
    prompt asks what is known); a line without a key or a prompt is left out. A file without any gives the default fields."""
    cut = F.transform(F.split("v", r"\|"), strip)
    lines = _definition_lines(spark, path).withColumn("cut", cut).withColumn("n", F.size("cut"))
    key, in_words = F.col("cut")[0], title_case(F.replace(F.col("cut")[0], F.lit("_"), F.lit(" ")))
    label = F.when(F.col("n") >= 3, F.coalesce(F.nullif(F.get("cut", F.lit(1)), F.lit("")), key)).otherwise(in_words)
    asked = F.concat(F.lit("What is known about "), F.lower(in_words), F.lit(" for this project?"))
    prompt = F.when(F.col("n") >= 3, strip(F.array_join(F.slice("cut", 3, 1 << 30), "|"))).when(F.col("n") == 2, F.get("cut", F.lit(1))).otherwise(asked)
    return _or_default(lines.select("at", key.alias("key"), label.alias("label"), prompt.alias("prompt")).where("key != '' and prompt != ''"), DEFAULT_FIELDS)


def questionnaire(spark: SparkSession, path: str) -> DataFrame:
    """(position, key, question) of lines ``key|question``; a question without a key gets ``q<n>``, n its place among the questions. A file
    without any gives the default questions."""
    bar = F.instr("v", "|")
    key = F.when(bar > 0, strip(F.substring(F.col("v"), F.lit(1), bar - 1))).otherwise("")
    question = F.when(bar > 0, strip(F.substring(F.col("v"), bar + 1, F.length("v")))).otherwise(F.col("v"))
    out = _or_default(_definition_lines(spark, path).select("at", key.alias("key"), question.alias("question")).where("question != ''"), DEFAULT_QUESTIONS)
    return out.withColumn("key", F.coalesce(F.nullif("key", F.lit("")), F.concat(F.lit("q"), F.col("position"))))


def _or_default(rows: DataFrame, default: tuple[tuple[str, ...], ...]) -> DataFrame:
    """``rows`` of a definition file numbered from 1 in place of ``at``, or the default ones if there are none."""
    if rows.isEmpty():
        columns = ", ".join(f"{c} string" for c in rows.columns[1:])
        return rows.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(default, 1)], f"position int, {columns}")
    return rows.withColumn("at", F.row_number().over(Window.orderBy("at"))).withColumnRenamed("at", "position")


def evaluation_set(spark: SparkSession, path: str) -> DataFrame:
    """Queries with the sources that they should find; ``source_documents`` and ``metadata_filters`` (a list is kept as JSON) bound the
    search. Rows without a query or without expected sources are left out."""
    shape = "id string, query string, client_name string, expected_sources array<string>, source_documents array<string>, metadata_filters map<string,string>"
    rows = spark.read.option("multiLine", True).schema(shape).json(path)
    return rows.withColumn("query", strip(F.col("query"))).where("query != '' and size(expected_sources) > 0")


def expected_financials(spark: SparkSession, path: str) -> DataFrame:
    """(client_name, revenue, cost, profit) of a JSON object keyed by client."""
    whole = spark.read.text(path, wholetext=True)
    m = F.from_json("value", "map<string,struct<revenue:double,cost:double,profit:double>>")
    return whole.select(F.explode(m).alias("client_name", "v")).select("client_name", "v.*")
