"""List detection (opt-in): markers, sequences, items, validation and containers.

Elements are numbered by ``index`` (0-based, by reading order inside a document). All steps are windows by blocks,
running counts and aggregates; no list is collected before it is turned into its container's text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioloom.config import Lists
from folioloom.functions.blocks import before, previous
from folioloom.functions.text import trimmed
from folioloom.session import checkpointed


def is_bullet(text: Column, config: Lists) -> Column:
    t = trimmed(text)
    out = F.lit(False)
    for b in config.bullets:
        out = out | t.startswith(b)
    return out


def is_numbered(text: Column, config: Lists) -> Column:
    return trimmed(text).rlike("|".join(f"(?:{p})" for p in config.numbered))


def indexed(parsed: DataFrame) -> DataFrame:
    return before(parsed, ["doc_id"], "reading_order", F.lit(1), "index")


def markers(parsed: DataFrame, config: Lists) -> DataFrame:
    """The elements that start with a bullet or a number, with index and kind."""
    m = indexed(parsed).withColumn("bullet", is_bullet(F.col("text"), config)).withColumn("numbered", is_numbered(F.col("text"), config))
    return m.filter("bullet or numbered")


def sequences(parsed: DataFrame, config: Lists) -> DataFrame:
    """doc_id, list_no, start, last_marker, end, markers: markers at most the look-ahead apart are one sequence."""
    m = previous(markers(parsed, config).select("doc_id", F.col("index")), ["doc_id"], "index", ["index"])
    new = F.coalesce(F.col("index") - F.col("prev_index") > config.sequence_lookahead_elements, F.lit(True)).cast("int")
    m = m.withColumn("new", new)
    m = before(m, ["doc_id"], "index", F.col("new"), "list_no").withColumn("list_no", F.col("list_no") + F.col("new"))
    n = parsed.groupBy("doc_id").agg(F.count("*").alias("n"))
    s = m.groupBy("doc_id", "list_no").agg(F.min("index").alias("start"), F.max("index").alias("last_marker"), F.count("*").alias("markers"))
    return s.join(n, "doc_id").select("doc_id", "list_no", "start", "last_marker", F.least(F.col("last_marker") + config.sequence_boundary_extension, F.col("n") - 1).alias("end"), "markers")


def items(parsed: DataFrame, config: Lists) -> DataFrame:
    """doc_id, list_no, item_no, text, first and last index, box: each marker with the elements up to the next one.

    The last item of a sequence goes on only while elements follow closely: within the extension, a vertical gap of at
    most ``last_item_boundary_gap`` and tops at most ``y_tolerance`` apart.
    """
    rows = indexed(parsed).withColumn("marker", (is_bullet(F.col("text"), config) | is_numbered(F.col("text"), config)).cast("int"))
    rows = before(rows, ["doc_id"], "index", F.col("marker"), "m").withColumn("m", F.col("m") + F.col("marker"))
    rows = checkpointed(rows)
    heads = rows.filter("marker = 1").select("doc_id", "m", F.col("index").alias("head"))
    follow = heads.select("doc_id", (F.col("m") - 1).alias("m"), F.col("head").alias("next_head"))
    heads = heads.join(follow, ["doc_id", "m"], "left")
    gap = F.col("next_head") - F.col("head")
    heads = heads.withColumn("inner", F.coalesce(gap <= config.sequence_lookahead_elements, F.lit(False)))
    rows = rows.join(heads, ["doc_id", "m"]).filter(F.col("inner") | (F.col("index") <= F.col("head") + config.sequence_boundary_extension))
    w = Window.partitionBy("doc_id", "m").orderBy("index")
    y, low = F.col("bounding_box.y"), F.col("bounding_box.y") + F.col("bounding_box.height")
    gap_y = F.greatest(y - F.lag(low).over(w), F.lit(0.0))
    far = F.coalesce((gap_y > config.last_item_boundary_gap) | (F.abs(y - F.lag(y).over(w)) > config.y_tolerance), F.lit(False))
    rows = rows.withColumn("far", (~F.col("inner") & far).cast("int"))
    rows = rows.withColumn("cut", F.max("far").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("cut = 0")
    x = F.col("bounding_box.x")
    grouped = rows.groupBy("doc_id", "m").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", trimmed(F.col("text")).alias("t")))), lambda s: s["t"]), " ").alias("text"),
        F.min("index").alias("first"), F.max("index").alias("last"), F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x + F.col("bounding_box.width")).alias("x1"), F.max(low).alias("y1"),
    )
    lists = sequences(parsed, config).select("doc_id", "list_no", "start", "last_marker")
    # a marker's list is found by the number of markers before its list's start
    first = grouped.select("doc_id", "m", "first").join(lists, F.expr("start = first") & (grouped["doc_id"] == lists["doc_id"])).select(grouped["doc_id"], "m", "list_no")
    starts = first.withColumnRenamed("m", "m0")
    ordered = before(grouped.join(starts.withColumn("is_start", F.lit(1)).select("doc_id", F.col("m0").alias("m"), "is_start"), ["doc_id", "m"], "left").na.fill(0, ["is_start"]), ["doc_id"], "m", F.col("is_start"), "list_no")
    out = ordered.withColumn("list_no", F.col("list_no") + F.col("is_start")).join(starts, ["doc_id", "list_no"])
    box = F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"))
    return out.select("doc_id", "list_no", (F.col("m") - F.col("m0")).alias("item_no"), "text", "first", "last", box.alias("bounding_box"))


def valid_lists(found: DataFrame, config: Lists) -> DataFrame:
    """doc_id, list_no of the lists that pass all checks that are switched on."""
    t = F.col("text")
    p = previous(found.withColumn("_k", F.col("list_no") * 1_000_000 + F.col("item_no")), ["doc_id", "list_no"], "_k", ["text"])
    digits = lambda c: F.regexp_extract(c, r"^\(?(\d+)[.)]", 1).try_cast("bigint")
    letter = lambda c: F.when(c.rlike(r"^[a-zA-Z][.)]"), F.ascii(F.lower(F.substring(c, 1, 1))) - 96)
    value = lambda c: F.coalesce(digits(c), letter(c)) if config.allow_letter_sequences else digits(c)
    gap = F.greatest(value(t) - value(F.col("prev_text")) - 1, F.lit(0))
    first = F.min_by("text", "item_no")
    math = lambda c: F.exists(F.array(*map(F.lit, config.math_symbols)), lambda s: c.contains(s))
    notation = r"\w+\^\w+|\w+_\w+|[α-ω]|\b[xy]\s*=|\d+\s*="
    maths = F.exists(F.array(*map(F.lit, config.math_terms)), lambda s: F.lower(t).contains(s)) | F.lower(t).rlike(notation)
    hyphen = t.startswith("-")
    proper = t.startswith("- " if config.require_space_after else "-")
    word = t.rlike(r"^[^-]*\p{L}[^-]*-.*\p{L}")
    minus = t.rlike(r"-\s*\d")
    a = p.groupBy("doc_id", "list_no").agg(
        F.count("*").alias("n"), first.alias("first"), F.bool_or(is_numbered(t, config)).alias("numbered"), F.bool_or(t.rlike(r"^\(\d+\)")).alias("paren"),
        F.coalesce(F.max(gap), F.lit(0)).alias("gap"), F.bool_or(math(t)).alias("symbols"), F.bool_or(maths).alias("maths"), F.bool_or(hyphen).alias("hyphen"),
        F.bool_and(proper & ~word & ~minus).alias("strict"), F.bool_or(word | minus).alias("doubtful"),
    )
    f = F.col("first")
    ok = F.lit(True)
    if config.minimum_size_check:
        ok = ok & (F.col("n") > 1)
    if config.first_item_validation:
        ok = ok & (~F.coalesce(is_numbered(f, config), F.lit(False)) | f.rlike(r"^(?:1[.)]|\(1\)|[aA][.)])"))
    if config.parenthetical_context_check:
        ok = ok & (~F.col("paren") | f.rlike(r"^\(1\)"))
    if config.sequential_numbering_check:
        ok = ok & (F.col("gap") <= config.max_gap_tolerance) & (value(f).isNull() | (value(f) == 1))
    if config.mathematical_context_check:
        ok = ok & ~(F.col("symbols") & F.col("maths"))
    if config.hyphen_context_check:
        context = {"reject": F.lit(False), "strict": F.col("strict"), "context_aware": ~F.col("doubtful")}.get(config.hyphen_strategy, F.lit(True))
        ok = ok & (~F.col("hyphen") | context)
    return a.filter(ok).select("doc_id", "list_no")


def detect_lists(parsed: DataFrame, config: Lists) -> DataFrame:
    """``parsed`` with the elements of valid lists replaced by one List each, or by ListItems; order is kept.

    All results are kept in order, also with containers off or items preserved.
    """
    every = checkpointed(items(parsed, config))
    found = every.join(valid_lists(every, config), ["doc_id", "list_no"], "left_semi")
    rows = indexed(parsed)
    spans = found.select("doc_id", "list_no", "item_no", "text", "bounding_box", F.explode(F.sequence("first", "last")).alias("index"), F.col("first").alias("head"))
    rest = rows.join(spans.select("doc_id", "index"), ["doc_id", "index"], "left_anti").drop("index")
    firsts = rows.join(found.select("doc_id", F.col("first").alias("index"), "list_no", "item_no", F.col("text").alias("item_text"), F.col("bounding_box").alias("item_box"), "last"), ["doc_id", "index"])
    if config.create_list_containers and not config.preserve_list_items:
        b = F.col("item_box")
        agg = firsts.groupBy("doc_id", "list_no").agg(
            F.min_by(F.struct(*[c for c in parsed.columns if c != "doc_id"]), "item_no").alias("f"),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item_no", "item_text"))), lambda s: s["item_text"]), "\n").alias("t"),
            F.min(b["x"]).alias("x0"), F.min(b["y"]).alias("y0"), F.max(b["x"] + b["width"]).alias("x1"), F.max(b["y"] + b["height"]).alias("y1"), F.sum("token_count").alias("k"),
        )
        box = F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"))
        new = {"element_type": F.lit("List"), "text": F.col("t"), "bounding_box": box.cast(parsed.schema["bounding_box"].dataType), "token_count": F.col("k")}
        lists = agg.select(*[(new[c] if c in new else F.col("doc_id") if c == "doc_id" else F.col(f"f.{c}")).alias(c) for c in parsed.columns])
    else:
        new = {"element_type": F.lit("ListItem"), "text": F.col("item_text"), "bounding_box": F.col("item_box").cast(parsed.schema["bounding_box"].dataType)}
        lists = firsts.select(*[(new[c] if c in new else F.col(c)).alias(c) for c in parsed.columns])
    return rest.select(*parsed.columns).unionByName(lists)


def patterns_to_sections(parsed: DataFrame, patterns: tuple[str, ...], min_size: float, use_bold: bool, respect: bool = True) -> DataFrame:
    """Paragraphs whose text matches a pattern become sections, if their style allows it; levels stay."""
    for p in patterns:
        re.compile(p)
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.col("text").rlike(p)
    bold = F.coalesce(F.lower("style_info.font_weight").contains("bold"), F.lit(False))
    style = F.coalesce((F.col("style_info.font_size") >= min_size) | (F.lit(use_bold) & bold), F.lit(False)) if respect else F.lit(True)
    return parsed.withColumn("element_type", F.when((F.col("element_type") == "Paragraph") & hit & style, "Section").otherwise(F.col("element_type")))
