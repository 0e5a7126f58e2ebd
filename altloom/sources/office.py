"""Scans of slide decks and word documents.

A package is opened where the scan has read it and gives narrow rows at once:
shapes, drawings and linked pictures with what the package's own relations say
of them (slide number, notes, picture hashes). Pictures are hashed there and
their bytes dropped; no part of a package is ever shuffled, and no join is
needed to put one together. Keys, kinds and texts are column expressions over
those rows. The same reader serves batch scans and file streams.

What cannot be read becomes a row in the error table, never a failed job: a
file that is no package, a damaged member, XML that does not parse, a number
that is none. Reading goes on after each: a bad number counts as 0. A shape
without an id gets a negative one from its place on the slide, so that no two
of them share an owner.
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from altloom.functions import rules
from altloom.functions.base import SPACE_CHARS
from altloom.functions.geometry import emu_to_pt, emu_to_px
from altloom.functions.keys import digest, instance_key
from altloom.functions.review import existing_alt, lookup
from altloom.session import materialize

DECK_TYPES = ("pptx", "ppt")
PART = "deck string, part string, content binary, media_key string, image_hash string, error string"
DECK_PARTS = r"ppt/(presentation\.xml|_rels/presentation\.xml\.rels|slides/[^/]+\.xml|slides/_rels/[^/]+\.rels|charts/_rels/[^/]+\.rels|notesSlides/[^/]+\.xml|media/[^/]+)"
DOCUMENT_PARTS = r"word/((document|header\d*|footer\d*)\.xml|_rels/(document|header\d*|footer\d*)\.xml\.rels|media/[^/]+)"

# One narrow row per shape, drawing, linked picture or error; ``kind`` tells which fields it fills.
FACT = (
    "kind string, deck string, part string, seq int, slide_idx int, shape_idx int, shape_id bigint, parent_id bigint, parent_seq int, depth int, "
    "tag string, shape_name string, descr string, title string, marked_decorative boolean, x bigint, y bigint, cx bigint, cy bigint, "
    "text string, fill_kind string, has_line boolean, text_box boolean, placeholder boolean, linked boolean, uri string, rel_id string, "
    "chart string, file_name string, media_key string, image_hash string, slide_text string, slide_notes string, "
    "child_descr array<string>, child_title array<string>, error string"
)
ARROW = {
    "string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(),
    "array<string>": pa.list_(pa.string()),
}

IMAGE = re.compile(r"(?i)\.(png|jpe?g|gif|bmp|tiff?|svg|wmf|emf)$")
UNREADABLE = (zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError, NotImplementedError, ValueError, OverflowError)

MOST_BYTES = 1 << 30
SHAPE_TAGS = ("sp", "pic", "cxnSp", "graphicFrame", "grpSp")
FILL_TAGS = {"noFill": "none", "solidFill": "solid", "gradFill": "gradient", "blipFill": "picture", "pattFill": "pattern"}


def scan_files(spark: SparkSession, path: str, exts: tuple[str, ...] = DECK_TYPES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Files under a folder, glob or file, without lock files.

    A scan gives each file once and in its own partitions, and content is read
    only where a later step asks for it. A file of more than ``most_bytes`` is
    not read: its content is null, and a step that opens it reports an error.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    name = F.element_at(F.split("path", "/"), -1)
    wanted = "(?i)\\.(" + "|".join(exts) + ")$"
    found = reader.load(path).filter(name.rlike(wanted) & ~name.startswith("~$"))
    small, large = found.filter(F.col("length") <= most_bytes), found.filter(F.col("length") > most_bytes)
    return small.unionByName(large.withColumn("content", F.lit(None).cast("binary")))


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, ARROW[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def first(node: ElementTree.Element, name: str) -> ElementTree.Element | None:
    return next((n for n in node.iter() if local(n.tag) == name), None)


def attribute(node: ElementTree.Element | None, name: str) -> str | None:
    if node is None:
        return None
    return next((v for k, v in node.attrib.items() if local(k) == name), None)


def paragraphs(node: ElementTree.Element) -> str:
    lines = ("".join(t.text or "" for t in p.iter() if local(t.tag) == "t") for p in node.iter() if local(p.tag) == "p")
    return "\n".join(lines)


def members(content: bytes | None, wanted: re.Pattern) -> Iterator[tuple[str | None, bytes | None, str | None]]:
    """(part, data, error) of the wanted members of a package; a bad one does not end the others."""
    if content is None:
        yield None, None, "FileTooLarge: not read"
        return
    try:
        package = zipfile.ZipFile(io.BytesIO(content))
    except UNREADABLE as problem:
        yield None, None, told(problem)
        return
    with package:
        for part in dict.fromkeys(filter(wanted.fullmatch, package.namelist())):
            try:
                yield part, package.read(part), None
            except UNREADABLE as problem:
                yield part, None, told(problem)


def told(problem: Exception) -> str:
    return f"{type(problem).__name__}: {problem}"


def hashes(data: bytes) -> dict:
    return {"media_key": hashlib.sha256(data).hexdigest(), "image_hash": hashlib.md5(data).hexdigest()}


def per_package(files: DataFrame, rows_of, ddl: str) -> DataFrame:
    """``rows_of(path, content)`` for every package, one package at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(ddl)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                yield pa.RecordBatch.from_pylist(rows_of(row["path"], row["content"]), schema=schema)

    return files.select("path", "content").mapInArrow(run, ddl)


def package_parts(files: DataFrame, wanted: str) -> DataFrame:
    """The wanted parts of every package; of media only the hashes."""
    pattern = re.compile(wanted)

    def opened(path: str, content: bytes | None) -> list[dict]:
        rows = []
        for part, data, error in members(content, pattern):
            row = {"deck": path, "part": part, "error": error}
            if data is not None:
                row |= hashes(data) if "/media/" in part else {"content": data}
            rows.append(row)
        return rows

    return per_package(files, opened, PART)


def package_facts(files: DataFrame, wanted: str) -> DataFrame:
    """Shapes, drawings, linked pictures and errors of every package. ``files`` may be a stream."""
    pattern = re.compile(wanted)

    def opened(path: str, content: bytes | None) -> list[dict]:
        found = Package()
        for part, data, error in members(content, pattern):
            if error is not None:
                found.errors.append({"part": part, "error": error})
            elif "/media/" in part:
                found.media[part] = hashes(data)
            else:
                try:
                    found.take(part, ElementTree.fromstring(data))
                except (ElementTree.ParseError, RecursionError) as problem:
                    found.errors.append({"part": part, "error": told(problem)})
        return [{"deck": path} | row for row in found.rows()]

    return per_package(files, opened, FACT)


def facts(files: DataFrame, wanted: str) -> DataFrame:
    """The facts of every package, written out once."""
    return materialize(package_facts(files, wanted))


class Package:
    """What has been read of one package, by part."""

    def __init__(self):
        self.links: dict[str, dict[str, str]] = {}
        self.media: dict[str, dict] = {}
        self.order: list[str | None] = []
        self.slides: dict[str, list[dict]] = {}
        self.notes: dict[str, str] = {}
        self.drawings: dict[str, list[dict]] = {}
        self.errors: list[dict] = []

    def take(self, part: str, root: ElementTree.Element) -> None:
        """Read one XML part."""
        if part.endswith(".rels"):
            folder, _, name = part.replace("_rels/", "").removesuffix(".rels").rpartition("/")
            self.links[f"{folder}/{name}"] = {node.get("Id"): full_name(folder, node.get("Target") or "") for node in root}
        elif part == "ppt/presentation.xml":
            shown = (n for n in root.iter() if local(n.tag) == "sldId")
            self.order = [next((v for k, v in n.attrib.items() if k.endswith("}id")), None) for n in shown]
        elif part.startswith("ppt/notesSlides/"):
            spoken = (paragraphs(n).strip() for n in root.iter() if local(n.tag) == "sp")
            self.notes[part] = " ".join(t for t in spoken if t)
        else:
            of, read = (self.slides, slide_facts) if part.startswith("ppt/slides/") else (self.drawings, drawing_facts)
            numbers = Numbers()
            of[part] = read(root, numbers)
            self.errors += [{"part": part, "error": error} for error in numbers.errors]

    def rows(self) -> Iterator[dict]:
        yield from ({"kind": "error"} | error for error in self.errors)
        shown = self.links.get("ppt/presentation.xml", {})
        for number, rel in enumerate(self.order):
            part = shown.get(rel)
            if part in self.slides:
                yield from self.shapes(part, number)
            yield from self.pictures(part, number)
        for part, drawings in self.drawings.items():
            links = self.links.get(part, {})
            for fact in drawings:
                target = links.get(fact["rel_id"], "")
                yield {"kind": "drawing", "part": part} | fact | (self.media.get(target, {}) if IMAGE.search(target) else {})

    def shapes(self, part: str, number: int) -> Iterator[dict]:
        """Shapes of a shown slide, with its text and notes and the pictures they hold."""
        links, shapes = self.links.get(part, {}), self.slides[part]
        notes = next((self.notes[t] for t in links.values() if t in self.notes), None)
        texts = (f["text"].strip(SPACE_CHARS) for f in shapes if f["depth"] == 0 and f["tag"] != "graphicFrame")
        common = {
            "kind": "shape", "part": part, "slide_idx": number, "slide_notes": notes and notes[:300],
            "slide_text": " ".join(t for t in texts if t)[:500],
        }
        for fact in shapes:
            target = links.get(fact["rel_id"])
            picture = {"file_name": target.rpartition("/")[2], **self.media[target]} if target in self.media else {}
            yield common | fact | picture

    def pictures(self, part: str | None, number: int) -> Iterator[dict]:
        """Pictures that a slide refers to, itself or through one of its charts."""
        for rel, target in self.links.get(part, {}).items():
            through = self.links.get(target, {}).items() if target.startswith("ppt/charts/") else ()
            for chart, name, held in ((None, rel, target), *((target, r, t) for r, t in through)):
                if held in self.media:
                    yield {
                        "kind": "picture", "part": part, "slide_idx": number, "chart": chart, "rel_id": name,
                        "file_name": held.rpartition("/")[2], **self.media[held],
                    }


class Numbers:
    """Whole numbers of attributes; those that are none count as 0 and are remembered."""

    def __init__(self):
        self.errors: list[str] = []

    def of(self, node: ElementTree.Element | None, name: str) -> int:
        raw = attribute(node, name)
        try:
            value = int(raw) if raw else 0
            if -(1 << 63) <= value < 1 << 63:
                return value
        except ValueError:
            pass
        self.errors.append(f"BadNumber: {name}={raw[:40]!r}")
        return 0


def full_name(folder: str, target: str) -> str:
    steps = [] if target.startswith("/") else folder.split("/")
    for step in target.strip("/").split("/"):
        steps = steps[:-1] if step == ".." else [*steps, step]
    return "/".join(steps)


def slide_facts(root: ElementTree.Element, numbers: Numbers) -> list[dict]:
    """Shapes of a slide in reading order, groups before their children."""
    found: list[dict] = []

    def visit(node: ElementTree.Element, above: dict | None) -> None:
        for number, child in enumerate(n for n in node if local(n.tag) in SHAPE_TAGS):
            row = shape_row(child, numbers) | {"seq": len(found), "shape_idx": number, "depth": 0, "child_descr": [], "child_title": []}
            row["shape_id"] = row["shape_id"] or -1 - row["seq"]
            if above is not None:
                row |= {"parent_id": above["shape_id"], "parent_seq": above["seq"], "depth": above["depth"] + 1}
                if row["tag"] in ("sp", "pic"):
                    above["child_descr"].append(row["descr"])
                    above["child_title"].append(row["title"])
            found.append(row)
            if row["tag"] == "grpSp":
                visit(child, row)

    tree = first(root, "spTree")
    if tree is not None:
        visit(tree, None)
    return found


def drawing_facts(root: ElementTree.Element, numbers: Numbers) -> list[dict]:
    """Drawings of a document part."""
    found = []
    for n, node in enumerate(n for n in root.iter() if local(n.tag) == "drawing"):
        prop, extent = first(node, "docPr"), first(node, "extent")
        found.append(
            {
                "seq": n, "shape_name": attribute(prop, "name"), "descr": attribute(prop, "descr"),
                "cx": numbers.of(extent, "cx"), "cy": numbers.of(extent, "cy"), "rel_id": attribute(first(node, "blip"), "embed"),
            }
        )
    return found


def shape_row(node: ElementTree.Element, numbers: Numbers) -> dict:
    """What one shape says about itself, without its children."""
    tag = local(node.tag)
    head = node[0] if len(node) else node
    prop = first(head, "cNvPr")
    own = [n for n in node if local(n.tag) in ("spPr", "grpSpPr", "xfrm", "blipFill")]
    look = next((n for n in own if local(n.tag) in ("spPr", "grpSpPr")), None)
    box = next((b for b in (first(n, "xfrm") for n in own) if b is not None), None)
    off, ext = (None, None) if box is None else (first(box, "off"), first(box, "ext"))
    fills = [] if look is None else [FILL_TAGS[local(n.tag)] for n in look if local(n.tag) in FILL_TAGS]
    return {
        "tag": tag,
        "shape_id": numbers.of(prop, "id"),
        "shape_name": attribute(prop, "name") or "",
        "descr": attribute(prop, "descr"),
        "title": attribute(prop, "title"),
        "marked_decorative": attribute(first(head, "decorative"), "val") == "1",
        "x": numbers.of(off, "x"),
        "y": numbers.of(off, "y"),
        "cx": numbers.of(ext, "cx"),
        "cy": numbers.of(ext, "cy"),
        "text": "" if tag == "grpSp" else paragraphs(node),
        "fill_kind": fills[0] if fills else "none",
        "has_line": look is not None and any(local(n.tag) == "ln" and first(n, "noFill") is None for n in look),
        "text_box": attribute(first(head, "cNvSpPr"), "txBox") == "1",
        "placeholder": first(head, "ph") is not None,
        "linked": first(head, "stCxn") is not None or first(head, "endCxn") is not None,
        "uri": attribute(first(node, "graphicData"), "uri") if tag == "graphicFrame" else None,
        "rel_id": None if tag == "grpSp" else attribute(first(node, "blip"), "embed"),
    }


def shape_kind() -> Column:
    """Kind of a shape from its tag and marks."""
    uri = F.coalesce("uri", F.lit(""))
    return (
        F.when(F.col("tag") == "pic", "PICTURE")
        .when(F.col("tag") == "grpSp", "GROUP")
        .when((F.col("tag") == "cxnSp") & F.col("linked"), "CONNECTOR")
        .when(F.col("tag") == "cxnSp", "LINE")
        .when(uri.endswith("/table"), "TABLE")
        .when(uri.endswith("/chart"), "CHART")
        .when(F.col("tag") == "graphicFrame", "OLE_OBJECT")
        .when(F.col("placeholder"), "PLACEHOLDER")
        .when(F.col("text_box"), "TEXT_BOX")
        .otherwise("AUTO_SHAPE")
    )


def deck_elements(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(elements, errors) of slide decks given as (path, content)."""
    read = facts(files, DECK_PARTS)
    return shown_elements(read), problems(read)


def problems(read: DataFrame) -> DataFrame:
    return read.filter("kind = 'error'").select("deck", "part", "error")


def shown_elements(read: DataFrame) -> DataFrame:
    """Elements from the facts of decks, row by row."""
    made = F.concat_ws("|", "tag", "shape_name", *[F.col(c).cast("string") for c in ("x", "y", "cx", "cy")], "text")
    kind, none = F.col("shape_type"), F.lit(None).cast("string")
    kids = F.zip_with("child_descr", "child_title", lambda descr, title: existing_alt(descr, title, none))
    child_alt = F.get(F.filter(kids, lambda alt: alt != ""), F.lit(0))
    return read.filter("kind = 'shape'").withColumn("shape_type", shape_kind()).select(
        "deck", "slide_idx", "shape_idx", "shape_id",
        instance_key("slide_idx", "shape_id").alias("instance_key"),
        F.coalesce("media_key", digest(made, "sha256")).alias("content_key"),
        "image_hash", "parent_id", "depth", "shape_type",
        F.coalesce(lookup(rules.ELEMENT_TYPES, kind), F.lit("unknown")).alias("element_type"),
        "shape_name", "file_name", "text",
        F.col("parent_id").isNotNull().alias("is_group_child"),
        F.struct(*[emu_to_pt(c).alias(n) for n, c in (("left", "x"), ("top", "y"), ("width", "cx"), ("height", "cy"))]).alias("bbox"),
        *[emu_to_px(c).alias(n) for n, c in (("width_px", "cx"), ("height_px", "cy"), ("left_px", "x"), ("top_px", "y"))],
        "fill_kind", "has_line", F.col("image_hash").isNotNull().alias("has_picture"),
        "descr", "title", "marked_decorative",
        existing_alt("descr", "title", F.when(kind == "GROUP", child_alt)).alias("existing_alt"),
        F.coalesce("slide_text", F.lit("")).alias("slide_text"),
        F.coalesce("slide_notes", F.lit("")).alias("slide_notes"),
        F.col("seq").alias("z_order"),
    )


def linked_pictures(files: DataFrame) -> DataFrame:
    """Every picture a slide refers to, itself or through one of its charts, with or without a shape that shows it."""
    read = facts(files, DECK_PARTS)
    return read.filter("kind = 'picture'").select("deck", "slide_idx", "chart", "rel_id", "file_name", "media_key", "image_hash")


def document_drawings(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(drawings, errors) of word documents: body, headers and footers."""
    read = facts(files, DOCUMENT_PARTS)
    drawings = read.filter("kind = 'drawing'").select(
        "deck", "part", "seq", F.col("shape_name").alias("name"), "descr", (emu_to_px("cx") * emu_to_px("cy")).alias("pixels"),
        "rel_id", F.left("media_key", F.lit(16)).alias("image_hash"),
    )
    return drawings, problems(read)
