"""The intermediate markup of positioned spans: parsing into tables, and building it from tables.

One row a document (doc_id, xhtml). Everything is regular expressions and higher-order functions in the JVM. Defined
results: null or empty markup gives no rows; entities stay as they are; spans with fewer than four numbers in the box
are skipped; page numbers count matches from 1, paragraph numbers count all paragraphs of a document from 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioloom.functions.text import token_estimate, trimmed

#: The markup contract.
PAGE = r'(?s)<div class="page"[^>]*>(.*?)</div>'
PARAGRAPH = r"(?s)<p[^>]*>(.*?)</p>"
SPAN = r'<span class="([^"]*)" data-bbox="([^"]*)" data-line="([^"]*)" data-segment="([^"]*)">([^<]*)</span>'
META = r'<meta\s+name="([^"]*)"[^>]*content="([^"]*)"[^>]*/?>'
STYLE = r"\.(\w+)\s*\{\s*font-family:\s*([^;]*);\s*font-size:\s*([^;]*);\s*font-style:\s*([^;]*);\s*font-weight:\s*([^;]*);\s*color:\s*([^;]*);"
BOOKMARK = r"<li>([^<]+)</li>"
META_NAMES = {
    "dc:title": "title", "dc:creator": "author", "dc:language": "language", "xmpTPg:NPages": "page_count", "dc:publisher": "publisher", "xmp:CreatorTool": "creator_tool",
    "pdf:producer": "producer", "pdf:PDFVersion": "pdf_version", "dcterms:created": "created", "dcterms:modified": "modified", "dc:description": "description",
    "pdf:encrypted": "encrypted", "pdf:hasMarkedContent": "has_marked_content",
}


def _all(text: str, pattern: str, group: int):
    return F.regexp_extract_all(text, F.lit(pattern), group)


def pages(markup: DataFrame) -> DataFrame:
    """doc_id, page_number, page."""
    return markup.select("doc_id", F.posexplode(_all("xhtml", PAGE, 1)).alias("p", "page")).select("doc_id", (F.col("p") + 1).alias("page_number"), "page")


def paragraphs(markup: DataFrame) -> DataFrame:
    """doc_id, page_number, paragraph_number, paragraph.

    Numbers come from one array per document, flattened over its pages, so that no window is needed.
    """
    per_page = F.transform(_all("xhtml", PAGE, 1), lambda p, i: F.transform(F.regexp_extract_all(p, F.lit(PARAGRAPH), 1), lambda t: F.struct((i + 1).alias("page_number"), t.alias("paragraph"))))
    return markup.select("doc_id", F.posexplode(F.flatten(per_page)).alias("paragraph_number", "x")).select("doc_id", "x.page_number", "paragraph_number", "x.paragraph")


def spans(markup: DataFrame) -> DataFrame:
    """doc_id, page and paragraph number, place, class_name, text, box, line_number, segment_number."""
    zipped = F.arrays_zip(*[_all("paragraph", SPAN, g).alias(n) for g, n in ((1, "class_name"), (2, "box"), (3, "line"), (4, "segment"), (5, "text"))])
    rows = paragraphs(markup).select("doc_id", "page_number", "paragraph_number", F.posexplode(zipped).alias("place", "s"))
    parts = F.split("s.box", ",")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("float")
    out = rows.select(
        "doc_id", "page_number", "paragraph_number", "place", "s.class_name", trimmed(F.col("s.text")).alias("text"),
        F.when(F.size(parts) == 4, F.struct(number(0).alias("x"), number(1).alias("y"), number(2).alias("width"), number(3).alias("height"))).alias("bounding_box"),
        F.coalesce(F.col("s.line").try_cast("int"), F.lit(0)).alias("line_number"), F.coalesce(F.col("s.segment").try_cast("int"), F.lit(0)).alias("segment_number"),
    )
    b = F.col("bounding_box")
    return out.filter((F.col("text") != "") & b["x"].isNotNull() & b["y"].isNotNull() & b["width"].isNotNull() & b["height"].isNotNull())


def font_classes(markup: DataFrame) -> DataFrame:
    """The classes of the last style block; the last definition of a class counts, an unreadable size is 12."""
    last = F.when(F.instr("xhtml", "<style") > 0, F.substring_index("xhtml", "<style", -1))
    block = markup.select("doc_id", F.substring_index(last, "</style>", 1).alias("css"))
    names = ("class_name", "font_family", "size", "font_style", "font_weight", "color")
    rows = block.select("doc_id", F.posexplode(F.arrays_zip(*[_all("css", STYLE, i + 1).alias(n) for i, n in enumerate(names)])).alias("pos", "c")).select("doc_id", "pos", "c.*")
    size = F.coalesce(F.regexp_replace(F.trim("size"), "px$", "").try_cast("float"), F.lit(12.0).cast("float"))
    values = F.struct(F.trim("font_family").alias("font_family"), size.alias("font_size"), F.trim("font_style").alias("font_style"), F.trim("font_weight").alias("font_weight"), F.trim("color").alias("color"))
    return rows.groupBy("doc_id", "class_name").agg(F.max_by(values, "pos").alias("v")).select("doc_id", "class_name", "v.*")


def metadata(markup: DataFrame) -> DataFrame:
    """The named fields of each document; of repeated names the last counts."""
    pairs = markup.select("doc_id", F.posexplode(F.arrays_zip(_all("xhtml", META, 1).alias("name"), _all("xhtml", META, 2).alias("content"))).alias("pos", "m"))
    last = pairs.groupBy("doc_id", F.col("m.name").alias("name")).agg(F.max_by("m.content", "pos").alias("content"))
    cols = []
    for name, column in META_NAMES.items():
        value = F.max(F.when(F.col("name") == name, F.col("content")))
        if column == "page_count":
            value = value.try_cast("int")
        elif column in ("encrypted", "has_marked_content"):
            value = value == "true"
        cols.append(value.alias(column))
    return markup.select("doc_id").join(last.groupBy("doc_id").agg(*cols), "doc_id", "left")


def bookmarks(markup: DataFrame) -> DataFrame:
    """doc_id, title, order: the items of the last plain list, empty ones left out."""
    last = F.when(F.instr("xhtml", "<ul>") > 0, F.substring_index(F.substring_index("xhtml", "<ul>", -1), "</ul>", 1))
    kept = F.filter(F.transform(F.regexp_extract_all(last, F.lit(BOOKMARK), 1), trimmed), lambda t: t != "")
    return markup.select("doc_id", F.posexplode(kept).alias("order", "title")).select("doc_id", "title", "order")


def text_elements(markup: DataFrame) -> DataFrame:
    """The element table of each document: spans with their fonts and bookmarks, in reading order (page, y, x, place).

    The fonts and first-matching bookmarks are joined on document and class or title.
    """
    s = spans(markup)
    fonts = font_classes(markup)
    marks = bookmarks(markup).groupBy("doc_id", "title").agg(F.min("order").alias("order")).select("doc_id", F.col("title").alias("text"), F.struct("title", "order").alias("bookmark_match"))
    by_page = Window.partitionBy("doc_id", "page_number").orderBy("bounding_box.y", "bounding_box.x", "paragraph_number", "place")
    ahead = s.groupBy("doc_id", "page_number").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("r", F.row_number().over(by_page)).join(ahead, ["doc_id", "page_number"]).withColumn("reading_order", (F.col("ahead") + F.col("r") - 1).cast("int"))
    s = s.join(fonts, ["doc_id", "class_name"], "left").join(marks, ["doc_id", "text"], "left")
    style = F.struct(
        "class_name", F.coalesce("font_family", F.lit("unknown")).alias("font_family"), F.coalesce("font_size", F.lit(12.0).cast("float")).alias("font_size"),
        F.coalesce("font_style", F.lit("normal")).alias("font_style"), F.coalesce("font_weight", F.lit("normal")).alias("font_weight"), F.coalesce("color", F.lit("#000000")).alias("color"),
    )
    return s.select("doc_id", "text", style.alias("style_info"), "bounding_box", "page_number", "paragraph_number", "line_number", "segment_number", "reading_order", "bookmark_match", token_estimate(F.col("text")).alias("token_count"))


def build(elements: DataFrame, classes: DataFrame | None = None, titles: DataFrame | None = None) -> DataFrame:
    """doc_id, xhtml from element, class and title tables; the inverse of the parsers for texts without angle brackets."""
    num = lambda c: F.col(f"bounding_box.{c}").cast("string")
    span = F.concat(
        F.lit('<span class="'), "style_info.class_name", F.lit('" data-bbox="'), F.concat_ws(",", num("x"), num("y"), num("width"), num("height")),
        F.lit('" data-line="'), F.col("line_number").cast("string"), F.lit('" data-segment="'), F.col("segment_number").cast("string"), F.lit('">'), F.translate("text", "<", ""), F.lit("</span>"),
    )
    paras = elements.groupBy("doc_id", "page_number", "paragraph_number").agg(F.min("reading_order").alias("ro"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("reading_order", span.alias("s")))), lambda x: x["s"]), "\n").alias("body"))
    page = paras.groupBy("doc_id", "page_number").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ro", "body"))), lambda x: F.concat(F.lit("<p>"), x["body"], F.lit("</p>"))), "\n").alias("body"))
    docs = page.groupBy("doc_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_number", "body"))), lambda x: F.concat(F.lit('<div class="page" data-page="'), x["page_number"].cast("string"), F.lit('">'), x["body"], F.lit("</div>"))), "\n").alias("body")
    )
    if classes is not None:
        rule = F.format_string(".%s { font-family: %s; font-size: %spx; font-style: %s; font-weight: %s; color: %s; }", "class_name", "font_family", F.col("font_size").cast("string"), "font_style", "font_weight", "color")
        docs = docs.join(classes.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set(rule)), "\n").alias("css")), "doc_id", "left")
    else:
        docs = docs.withColumn("css", F.lit(None).cast("string"))
    docs = docs.join(titles.select("doc_id", F.concat(F.lit('<meta name="dc:title" content="'), F.translate("title", '"', "'"), F.lit('"/>')).alias("meta")), "doc_id", "left") if titles is not None else docs.withColumn("meta", F.lit(None).cast("string"))
    return docs.select("doc_id", F.concat(F.lit("<html><head>"), F.coalesce("meta", F.lit("")), F.lit("<style>"), F.coalesce("css", F.lit("")), F.lit("</style></head><body>"), "body", F.lit("</body></html>")).alias("xhtml"))
