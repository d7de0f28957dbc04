"""Sources: files of any format as rows of documents, and files of commands.

``load`` lists and reads files on the executors (binaryFile), so any store that Spark reads will do. Formats are told by the
suffix of the name; what is neither an image nor a known container is text. Text is decoded in the JVM. Containers that
only Python can open (DOCX; PDF where pdfplumber is installed) pass through Arrow functions, alone.
"""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions.text import redact

#: Suffixes of images.
IMAGES = ["png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp", "gif"]
#: A PDF with less text than this is a scan; pages that are drawn of a scan, and their resolution.
LEAST_TEXT, SCAN_PAGES, SCAN_DPI = 20, 20, 200
WORD_SPACE = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

DOCUMENT = "doc_id long, path string, name string, format string, bytes long, kind string, text string, images array<binary>, pages int, encoding string, notes array<string>"


def options(environ: dict[str, str] | None = None) -> dict[str, str | None]:
    """What the environment sets: OCR languages, the folder of reference tables, the key of a language model."""
    env = os.environ if environ is None else environ
    return {"ocr_languages": env.get("LEXIFORGE_OCR_LANGS", "eng"), "reference_folder": env.get("LEXIFORGE_REFERENCES"), "model_key": env.get("LEXIFORGE_MODEL_KEY")}


def decoded(content: Column) -> Column:
    """Struct (text, encoding) of bytes: UTF-16 by its byte-order mark, else UTF-8 (a mark at the start goes), else Latin-1."""
    head = F.hex(F.substring(content, 1, 2))
    utf8 = content.cast("string")
    text = F.when(head.isin("FFFE", "FEFF"), F.decode(content, "UTF-16")).when(F.is_valid_utf8(utf8), F.regexp_replace(utf8, "^﻿", "")).otherwise(F.decode(content, "ISO-8859-1"))
    name = F.when(head.isin("FFFE", "FEFF"), "utf-16").when(F.is_valid_utf8(utf8), "utf-8").otherwise("latin-1")
    return F.struct(text.alias("text"), name.alias("encoding"))


def docx_text(content: bytes) -> str:
    """The paragraphs of a DOCX file's body, a line each; tables are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD_SPACE}body")
    marks = {f"{WORD_SPACE}tab": "\t", f"{WORD_SPACE}br": "\n"}
    lines = []
    for p in () if body is None else body.findall(f"{WORD_SPACE}p"):
        lines.append("".join(x.text or "" if x.tag == f"{WORD_SPACE}t" else marks.get(x.tag, "") for x in p.iter()))
    return "\n".join(lines)


def pdf_content(content: bytes) -> tuple[str | None, int | None, list[bytes], str | None]:
    """(text, pages, drawn pages of a scan, what went wrong) of a PDF."""
    try:
        import pdfplumber
    except ImportError:
        return None, None, [], "PDF files need pdfplumber, which is not installed"
    with pdfplumber.open(io.BytesIO(content)) as pdf:
        text = "\n".join(page.extract_text() or "" for page in pdf.pages)
        images = []
        if len(text.strip()) < LEAST_TEXT:
            for page in pdf.pages[:SCAN_PAGES]:
                out = io.BytesIO()
                page.to_image(resolution=SCAN_DPI).save(out)
                images.append(out.getvalue())
        return text, len(pdf.pages), images, "no text layer; the pages are treated as images" if images else None


def _containers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for path, kind, content in zip(b["path"], b["format"], b["content"], strict=True):
            try:
                text, pages, images, note = (docx_text(content), None, [], None) if kind == "docx" else pdf_content(content)
            except Exception as e:  # noqa: BLE001 - a damaged file is a row with a note, not the end of the job
                text, pages, images, note = None, None, [], f"the file cannot be read: {type(e).__name__}"
            rows.append((path, text, pages, images, note))
        yield pd.DataFrame(rows, columns=["path", "text", "pages", "images", "note"])


def load(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """A row for each file at path, of the form DOCUMENT; doc_id is a hash of the path. The text is not redacted yet."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.when(F.contains(name, F.lit(".")), F.element_at(F.split(name, r"\."), -1)).otherwise(F.lit("")))
    files = files.select(F.xxhash64("path").alias("doc_id"), "path", name.alias("name"), suffix.alias("format"), F.col("length").alias("bytes"), "content")
    none, notes = F.lit(None), F.array().cast("array<string>")
    image = files.filter(F.col("format").isin(IMAGES))
    image = image.select("doc_id", "path", "name", "format", "bytes", F.lit("image").alias("kind"), F.lit("").alias("text"), F.array("content").alias("images"), F.lit(1).alias("pages"), none.cast("string").alias("encoding"), notes.alias("notes"))
    boxed = files.filter(F.col("format").isin("docx", "pdf"))
    opened = boxed.select("doc_id", "name", "bytes", "path", "format", "content").mapInPandas(_containers_of, "doc_id long, path string, name string, format string, bytes long, text string, pages int, images array<binary>, note string")
    boxed = opened.select(
        "doc_id", "path", "name", "format", "bytes", F.when(F.size("images") > 0, "image").otherwise("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"),
        "images", "pages", none.cast("string").alias("encoding"), F.array_compact(F.array("note")).alias("notes"),
    )
    plain = files.filter(~F.col("format").isin([*IMAGES, "docx", "pdf"])).withColumn("d", decoded(F.col("content")))
    fallback = F.when(F.col("d.encoding") == "latin-1", F.lit("not valid UTF-8; read as Latin-1"))
    plain = plain.select(
        "doc_id", "path", "name", "format", "bytes", F.lit("text").alias("kind"), F.col("d.text").alias("text"), F.array().cast("array<binary>").alias("images"),
        none.cast("int").alias("pages"), F.col("d.encoding").alias("encoding"), F.array_compact(F.array(fallback)).alias("notes"),
    )
    return plain.unionByName(boxed).unionByName(image)


def _containers_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        (opened,) = _containers(iter([b[["path", "format", "content"]]]))
        yield pd.concat([b[["doc_id", "path", "name", "format", "bytes"]].reset_index(drop=True), opened[["text", "pages", "images", "note"]]], axis=1)


def safe(docs: DataFrame) -> DataFrame:
    """Loaded documents with credentials replaced, and a note on how many there were: what all analysis starts from."""
    out = redact(docs)
    note = F.when(F.col("hits") > 0, F.concat(F.col("hits").cast("string"), F.lit(" strings that look like credentials were replaced before the analysis")))
    return out.withColumn("notes", F.concat(F.coalesce("notes", F.array().cast("array<string>")), F.array_compact(F.array(note)))).drop("hits")


def read_words(docs: DataFrame, read: Callable[[bytes], list[tuple[str, float]]] | None = None) -> DataFrame:
    """doc_id, page, at, word, conf of the pages' images by an OCR function; without one, pytesseract where it is installed, else no rows."""
    languages = options()["ocr_languages"]

    def ocr(image: bytes) -> list[tuple[str, float]]:
        try:
            import pytesseract
            from PIL import Image
        except ImportError:
            return []
        found = pytesseract.image_to_data(Image.open(io.BytesIO(image)), lang=languages, output_type=pytesseract.Output.DICT)
        return [(w, float(c)) for w, c in zip(found["text"], found["conf"], strict=True)]

    use = read or ocr

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, p, i, w, c) for d, p, img in zip(b["doc_id"], b["page"], b["image"], strict=True) for i, (w, c) in enumerate(use(bytes(img)))]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "at", "word", "conf"])

    pages = docs.filter("kind = 'image'").select("doc_id", F.posexplode("images").alias("page", "image"))
    return pages.mapInPandas(run, "doc_id long, page int, at int, word string, conf double")


def ocr_text(words: DataFrame) -> DataFrame:
    """doc_id, text (a line for each page), mean_conf, n_words of recognised words with a confidence."""
    w = words.filter(F.col("conf") >= 0).filter(F.trim("word") != "")
    pages = w.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("t"), F.sum("conf").alias("s"), F.count("*").alias("n"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda x: x["t"]), "\n")
    return pages.groupBy("doc_id").agg(lines.alias("text"), F.round(F.sum("s") / F.sum("n"), 2).alias("mean_conf"), F.sum("n").alias("n_words"))


def command_lines(spark: SparkSession, path: str) -> list[str]:
    """The commands of a file: one a line, without blanks and comments; or a JSON list of objects, turned to commands.

    A list of commands is written by hand and read to the driver.
    """
    if not path.lower().endswith(".json"):
        return [r["value"] for r in spark.read.text(path).collect() if r["value"].strip() and not r["value"].startswith("#")]
    schema = "type string, token string, meaning string, anchor string, role string, affix string, map map<string,string>, language string"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path).collect()
    out = []
    for r in rows:
        pairs = " ".join(f"{k}={v}" for k, v in (r["map"] or {}).items())
        out.append({
            "gloss": f"gloss {r['token']} = {r['meaning']}" + (f" near {r['anchor']}" if r["anchor"] else ""), "role": f"role {r['token']} {r['role']}",
            "affix": f"affix {r['affix']} = {r['meaning']}", "sign_values": f"values {pairs} in {r['language'] or 'en'}",
        }.get(r["type"], f"{r['type']}"))
    return out
