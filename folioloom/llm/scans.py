"""Noise in text from scanned pages (problem 3).

No column says which documents are scanned, and their lines may stand apart or run together. Documents count as scanned by
evidence: words cut in two that the vocabulary knows whole, digits or signs inside known words, and page numbers. In them

* words are grouped by a confusable-glyph skeleton, under which glyphs that scanners mix up are one stroke class; a rare
  form whose group has a far more frequent one, from which it differs by listed confusions only, is a misread of it;
* lines are masked (digits and roman numerals out, then the skeleton) to find running heads: masked lines that come
  again in the document, repeat its title or a heading, or stand beside a page number. Where lines run together, page
  numbers, capitals and the document's masked heads are found inside the text;
* the remaining text is reflowed: a word cut at a line or page end, or before a head, is joined with the rest of it. SQL
  windows over the nodes' order lead from a page's last line to the next page's first one.

Vocabulary, heads and statistics cover all documents. Texts stay where they are read; only candidates (short lines, cuts,
rare tokens) move between tasks. Windows over a document's nodes run by blocks of text order whose borders are bridged by
one summary row a block, since one document may hold a third of all nodes.

Defined results: null texts, ids and documents give nothing; empty lines are skipped; repeated rows count once; nodes without a
text order take no part in joins across nodes; of several forms the one with the fewest confusions is taken, then the one
that the words before support most, then the more frequent, then the smaller one; documents without evidence give nothing.
"""

from __future__ import annotations

import functools
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioloom.llm.lookalikes import BLANK, IGNORABLE, LOOKALIKES
from folioloom.session import checkpointed

#: A printed line has at most so many characters; a longer stretch is no page head by itself.
LINE = 200
#: Of a paragraph's lines, those of at most this part of the widest one's length are short.
SHORT = 0.85
#: Long texts of which at least this share stands in lines are one sign of a scan.
PRINTED = 0.6
#: A misread form is at most this part as frequent as the true one, and still rarer in documents that aren't scanned.
RARER, RARER_CLEAN = 10, 50
#: Confusions allowed in one word.
MOST_CONFUSIONS = 2
#: Tables of at most so many rows are broadcast (they are counted first); larger ones are joined by shuffles.
FEW = 1 << 16
BLOCK = 512
#: What is printed, and what a scanner makes of it.
CONFUSIONS = (
    "e c, c e, a o, o a, t f, f t, n ri, o 0, s 5, l !, i !, i 1, l 1, l |, i |, d cl, cl d, u ii, g 9, h b, b h, b 6, m rn, rn m, in m, m in, "
    "i l, l i, w vv, h li, li h, b 8, a 4, q 9, z 2, e f, ri n"
)
#: Single glyphs and their stroke class; the classes then stand for strokes of the wider letters.
GLYPHS_FROM, GLYPHS_TO = "ceoa04ft" "s5z2" "g9q" "il1!|r" "68", "cccccccc" "ssss" "ggg" "iiiiii" "bb"
STROKES = (("n", "ii"), ("u", "ii"), ("h", "ii"), ("b", "ii"), ("m", "iii"), ("d", "ci"), ("w", "vv"))
#: Hyphens at a line's end.
HYPHENS = "-‐‑¬­"
_DIGITS = "[0-9lIO|!]+"
_NUMBER = rf"(?:(?:p[aoe4]g[ec]|p\.|pg\.|seite)\s*)?[\[(—–-]?\s*(?:{_DIGITS}|[ivxlc]+|[IVXLC]+)\s*[\])—–.-]?(?:\s*(?:of|o[fl]|von|/)\s*{_DIGITS})?"
NUMBER_LINE = rf"^(?i:{_NUMBER})$"
DECORATED = r"^(?i:(?:p[aoe4]g[ec]|p\.|pg\.|seite)\s*.*|[\[(—–-].*)$"
_APART = r"(?:\s{2,}|\s*\|\s*)"
HEAD_AND_NUMBER = rf"^(?:(?i:{_NUMBER}){_APART}\S.*|\S.*?{_APART}(?i:{_NUMBER}))$"
HAS_LETTERS = r"\p{L}{2}"
#: Page numbers inside running text: with a sign of their own, or bare ones set apart by blanks or a bar.
_SIGNED = rf"(?:(?i:p[aoe4]g[ec]|seite) {_DIGITS}(?: (?:of|o[fl]|von) {_DIGITS})?|(?i:p)\. ?{_DIGITS}|[—–-] {_DIGITS} [—–-]|\[{_DIGITS}\])"
_BARE = rf"(?:{_DIGITS}|[ivxlc]+)\.?"
_CAPITAL = r"(?>\p{Lu}{2}[\p{Lu}0-9]*+|\p{Lu}[\p{Lu}0-9]{3,}+)(?![\p{L}\p{N}])"
_CAPITALS = rf"{_CAPITAL}(?: {_CAPITAL})++"
_AFTER_TEXT = rf"(?<=[{HYPHENS}\p{{Ll}}\p{{N}}.,;:!?)] )"
SPAN = (
    rf"{_AFTER_TEXT}(?:(?:{_SIGNED}|{_BARE})(?: {{2,}}| \| )|{_SIGNED} )?{_CAPITALS}(?:(?: {{2,}}| \| | )(?:{_SIGNED}|{_BARE})(?= ))?(?= +\S*\p{{Ll}})"
    rf"|{_AFTER_TEXT}(?:\| )?{_SIGNED}(?= )|{_AFTER_TEXT}\| {_BARE}(?= )"
    rf"|(?<=[^{HYPHENS}\s]) {{2,}}{_BARE}(?= )|{_AFTER_TEXT}{_BARE} {{2,}}(?=\p{{Lu}})"
)
#: What every span has; texts without it are not searched for spans, and what every text of note has.
SPAN_HINT = r" (?:[ \[|]|[—–-] |[Pp]\. ?[0-9lIO|!]|(?i:p[aoe4]g[ec]|seite) |\p{Lu}{2})"
#: A cut word inside a line, in groups: first half, hyphen, rest.
CUT = rf"(?<!\S)(\S*\p{{L}})([{HYPHENS}])[ \t]+([\p{{Ll}}0-9!|]\S*)"
HAS_CUT = rf"[{HYPHENS}](?<=\p{{L}}.)(?:\s|$)"
#: A digit or sign between small letters.
ODD = r"[0-9!|](?<=\p{Ll}.)(?=\p{Ll})"
ODD_TOKEN = rf"(?<!\S)\S*?{ODD}\S*"
NOTABLE = rf"{HAS_CUT}|{ODD}|{SPAN_HINT}"


@functools.cache
def _disguise() -> str:
    """A pattern that finds whatever may be a disguised character: the ranges in which such characters lie, ASCII passed over first."""
    points = sorted({ord(p[0]) for p in LOOKALIKES.split()} | {ord(c) for c in BLANK + IGNORABLE if c > "\x7e"} | {0xFB00, 0xFB06, *range(0xFF01, 0xFFEF, 32), 0xFFEE})
    ranges = [[points[0], points[0]]]
    for k in points[1:]:
        if k - ranges[-1][1] <= 64:
            ranges[-1][1] = k
        else:
            ranges.append([k, k])
    return "[^\\x00-\\x7e](?<=[" + "".join(f"\\x{{{x:x}}}-\\x{{{y:x}}}" for x, y in ranges) + "])"


def _plain(text: Column) -> Column:
    """The text without disguised characters, blanks of all kinds as spaces; other text is left alone."""
    return F.when(text.rlike(_disguise()), _undisguised(text)).otherwise(text)


def _undisguised(text: Column) -> Column:
    """Disguised characters by table, blanks as spaces, ignorables out (what stands at a line's end is cut off before)."""
    pairs = [p for p in LOOKALIKES.split() if p[1] != "-"]
    src = "".join(p[0] for p in pairs) + BLANK + IGNORABLE
    to = "".join(p[1] for p in pairs) + " " * len(BLANK)
    full = "".join(chr(k) for k in range(0xFF01, 0xFF5F))
    text = F.translate(text, full, "".join(chr(k - 0xFEE0) for k in range(0xFF01, 0xFF5F)))
    for lig, plain in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        text = F.replace(text, F.lit(lig), F.lit(plain))
    return F.translate(text, src, to)


def skeleton(word: Column) -> Column:
    """The stroke classes of a word, without regard to case."""
    out = F.translate(F.lower(word), GLYPHS_FROM, GLYPHS_TO)
    for wide, strokes in STROKES:
        out = F.replace(out, F.lit(wide), F.lit(strokes))
    return out


def masked(line: Column) -> Column:
    """A line without its numbers, as a coarse skeleton that also bridges the confusions of capitals."""
    bare = F.regexp_replace(line, rf"^(?i:{_NUMBER}){_APART}|{_APART}(?i:{_NUMBER})$", "")
    bare = F.regexp_replace(_plain(bare), r"[\p{P}\p{S}\s]|\d(?=\d)", "")
    return F.translate(skeleton(bare), "v", "i")


def bare_word(token: Column) -> Column:
    """A token in small letters without the punctuation around it; ! and | stay, as a scanner may print them for letters."""
    return F.lower(F.regexp_replace(token, r"^[\p{P}&&[^!]]+|[\p{P}&&[^!]]+$", ""))


@functools.cache
def _confusions() -> dict[str, list[tuple[str, str]]]:
    out: dict[str, list[tuple[str, str]]] = {}
    for pair in CONFUSIONS.split(", "):
        true, seen = pair.split(" ")
        out.setdefault(seen[0], []).append((true, seen))
    return out


def confusions_between(seen: str, true: str, most: int = MOST_CONFUSIONS) -> int | None:
    """The least number of listed confusions that make ``seen`` out of ``true``, or None above ``most``."""
    table = _confusions()
    level = {(0, 0)}
    for cost in range(most + 1):
        # along equal glyphs first
        todo, reached = list(level), set(level)
        while todo:
            i, j = todo.pop()
            if i < len(seen) and j < len(true) and seen[i] == true[j] and (i + 1, j + 1) not in reached:
                reached.add((i + 1, j + 1))
                todo.append((i + 1, j + 1))
        if (len(seen), len(true)) in reached:
            return cost
        level = {
            (i + len(s), j + len(t))
            for i, j in reached
            if i < len(seen)
            for t, s in table.get(seen[i], ())
            if seen.startswith(s, i) and true.startswith(t, j)
        }
    return None


def _costs(seen: pd.Series, true: pd.Series) -> pd.Series:
    return pd.Series([confusions_between(s, t) for s, t in zip(seen, true)], dtype="Int32")


def _cost(seen: str, true: str) -> Column:
    return F.pandas_udf(_costs, "int")(seen, true)


def _strip(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\x0b\x0c\r\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"))


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _tokens(text: Column) -> Column:
    return F.split(_plain(text), "[ \n\t]")


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns that filters may use without computing them again (a filter isn't pushed below the inline)."""
    return df.select("*", F.inline_outer(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def _few(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it has FEW rows at most."""
    return F.broadcast(df) if df.count() <= FEW else df


def _name() -> Column:
    """Whether a token with a capital stands neither first in its line nor after the end of a sentence: it may be a name."""
    return F.col("token").rlike(r"^[\"'(\[]*\p{Lu}") & _yes(~F.col("ahead").rlike(r"(?:[.!?:][\"')\]]*|^[–•*]|^\(?\w{1,3}[.)])$"))


class Scans:
    """The stages for one pair of tables; each is a DataFrame, made when it is first asked for."""

    def __init__(self, nodes: DataFrame, metadata: DataFrame) -> None:
        self.nodes = nodes.filter("content.text is not null and id is not null and node_type is not null").select(
            "doc_id", "id", "node_type", "text_order", F.col("content.text").alias("text"), F.col("style_info.font_size").alias("size"),
            F.col("location.physical.bounding_box.y").alias("y"),
        )
        self.metadata = metadata
        self.body = self.nodes.filter("doc_id is not null and node_type in ('Paragraph', 'ListItem')")

    # Arrays that take work are exploded by the outer forms: before the others the optimizer puts a filter on the array's
    # size, which computes it once more; the rows of empty arrays go by the filters that follow.

    # -- lines and furniture

    @cached_property
    def pages(self) -> DataFrame:
        """doc_id, body_size (that of most characters), top and bottom of long texts and headings, printed (whether long texts stand in lines)."""
        long = (F.char_length("text") > LINE / 2) & F.col("node_type").isin("Paragraph", "ListItem")
        in_lines = F.count_if(long & F.col("text").contains("\n"))
        y = F.when(long | (F.col("node_type") == "Section"), F.col("y"))
        sizes = self.nodes.groupBy("doc_id", "size").agg(F.sum(F.when(long, F.char_length("text"))).alias("w"), F.min(y).alias("top"), F.max(y).alias("bottom"), in_lines.alias("l"), F.count_if(long).alias("n"))
        pages = sizes.filter("doc_id is not null").groupBy("doc_id").agg(
            F.max_by("size", F.struct("w", "size")).alias("body_size"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), ((F.sum("n") > 0) & (F.sum("l") >= PRINTED * F.sum("n"))).alias("printed")
        )
        return checkpointed(pages)

    def _candidates(self) -> DataFrame:
        """Lines that may be furniture, with their neighbours: short ones, ones with a number, paragraphs of one line; and headings."""
        keys = ["doc_id", "id", "node_type", "size", "y"]
        many, section = F.col("text").contains("\n"), F.col("node_type") == "Section"
        split = F.filter(F.transform(F.split("text", "\n"), lambda p, i: F.struct(i.alias("line_no"), _strip(p).alias("line"))), lambda x: x["line"] != "")
        one = F.array(F.struct(F.lit(0).alias("line_no"), _strip(F.col("text")).alias("line")))
        wanted = section | F.col("node_type").isin("Paragraph", "ListItem") & many | (F.col("node_type") == "Paragraph") & (F.char_length("text") <= LINE)
        c = self.nodes.filter(F.col("doc_id").isNotNull() & wanted).select(*keys, F.when(many & ~section, split).otherwise(one).alias("lines")).filter("size(lines) > 0")
        c = c.withColumn("widest", F.array_max(F.transform("lines", lambda x: F.char_length(x["line"]))))
        beside = F.transform(
            "lines",
            lambda x, i: F.struct(
                x["line_no"].alias("line_no"), x["line"].alias("line"), F.get("lines", i - 1)["line"].alias("before"), F.get("lines", i + 1)["line"].alias("after")
            ),
        )
        c = c.select(*keys, "widest", F.size("lines").alias("n_lines"), F.inline_outer(beside))
        return c.filter((F.col("line") != "") & ((F.col("n_lines") == 1) | (F.char_length("line") <= SHORT * F.col("widest")) | F.col("line").rlike(HEAD_AND_NUMBER)))

    @cached_property
    def furniture(self) -> DataFrame:
        """doc_id, id, line_no, furniture, sure: lines of heads, feet and page numbers, if the document is a scan."""
        line = F.col("line")
        both = lambda c: _yes(c.rlike(HEAD_AND_NUMBER) & c.rlike(HAS_LETTERS))
        number = lambda c: _yes(c.rlike(NUMBER_LINE))
        single = F.col("n_lines") == 1
        short = F.char_length("line") <= SHORT * F.col("widest")
        c = _once(self._candidates().join(_few(self.pages), "doc_id"), number=number(line), both=both(line), short=short, decorated=line.rlike(DECORATED))
        small = _yes(F.col("size") < F.col("body_size")).cast("int")
        margin = _yes((F.col("y") < F.col("top")) | (F.col("y") > F.col("bottom"))).cast("int")
        sure = (F.col("number") & F.col("decorated") & ~line.rlike(r"^[(\[—–-]?\s*\d+[.)]$") | F.col("both")).cast("int")
        c = _once(c, signs=small + margin + (F.col("number") | F.col("both")).cast("int") + sure)
        # a mask decides only where another sign speaks for a whole paragraph, or for a short line
        c = c.withColumn("mask", F.when(~F.col("number") & F.when(single, (F.col("node_type") == "Section") | (F.col("signs") > 0)).otherwise(F.col("short") | F.col("both")), F.nullif(masked(line), F.lit(""))))
        # what no rule below can take goes before anything moves
        open_end = ~line.rlike(r"[.!?;,]$")
        c = c.filter((F.col("node_type") == "Section") | F.when(single, F.col("signs") > 0).otherwise(F.col("number") | F.col("both") | F.col("short") & open_end))
        c = checkpointed(c.drop("size", "y", "body_size", "top", "bottom", "printed").distinct())
        titles = self.metadata.select("doc_id", masked(F.col("title")).alias("mask")).filter("mask <> ''")
        headings = c.filter("node_type = 'Section' and mask is not null").select("doc_id", "mask")
        c = c.filter("node_type <> 'Section'")
        again = c.filter(F.col("mask").isNotNull() & (single & F.col("node_type").eqNullSafe("Paragraph") | ~single & F.col("short")) & ~line.rlike(r"[.!?:;,]$"))
        again = again.groupBy("doc_id", "mask").agg(F.count("*").alias("times")).filter("times > 1").select("doc_id", "mask")
        heads = titles.unionByName(headings).unionByName(again).distinct().withColumn("head", F.lit(True))
        c = c.filter("mask is not null").join(heads, ["doc_id", "mask"], "left").unionByName(c.filter("mask is null").withColumn("head", F.lit(False)))
        head = _yes(F.col("head"))
        whole = single & F.col("node_type").eqNullSafe("Paragraph") & (F.col("signs") + head.cast("int") >= 2)
        caps = line.rlike(r"\p{Lu}{2}") & ~line.rlike(r"\p{Ll}")
        ended = _yes(F.col("before").rlike(r"[.!?:][\"')\]]*$"))
        inner_number = F.col("number") & (F.col("after").isNotNull() | F.col("decorated") | ended)
        # a head that comes once shows by the page number beside it, or by its capitals
        beside = number(F.col("before")) | number(F.col("after")) | both(F.col("before")) | both(F.col("after"))
        alone = beside & (F.char_length("line") <= 0.7 * F.col("widest")) & line.rlike(r"^[\p{Lu}\p{N}]") & ~line.rlike(r"[.!?]\s")
        inner_head = F.col("short") & ~line.rlike(r"[.!?;,]$") & (head | alone | caps & F.col("after").isNotNull())
        inside = ~single & (inner_number | F.col("both") | inner_head)
        found = c.withColumn("furniture", F.when(whole, "furniture").when(inside, "inline_furniture")).filter("furniture is not null")
        pattern = F.col("both") | F.col("number") & F.when(single, F.col("signs") > 1).otherwise(F.col("decorated") & F.col("after").isNotNull())
        return checkpointed(found.select("doc_id", "id", "line_no", "furniture", pattern.alias("sure"), "line", F.when(~F.col("number"), F.col("mask")).alias("mask")))

    # -- running text

    @staticmethod
    def _flat(body: DataFrame, *more: str) -> DataFrame:
        """Paragraphs and items with the page numbers and capitals of heads taken out where lines run together."""
        one = ~F.col("text").contains("\n") & F.col("text").rlike(SPAN_HINT)
        flat = F.when(one, F.regexp_replace("text", SPAN, " ")).otherwise(F.col("text"))
        return body.select("doc_id", "id", "node_type", "text_order", "text", flat.alias("flat"), *more)

    @cached_property
    def marks(self) -> DataFrame:
        """doc_id, id, text_order, kind, line_no, half, hyphen, rest, followers: what a look at each text alone shows.

        kind 'span' is a head or number inside a line, 'odd' a token with a digit or sign between its letters (in half),
        'cut' a word cut inside a line, 'end' a line that ends in a hyphen, with the first tokens of the lines that follow.
        """
        flat = F.col("flat")
        cut = flat.rlike(HAS_CUT)
        f = self._flat(self.body.filter(F.col("text").rlike(NOTABLE))).withColumn("spanned", flat != F.col("text"))
        none, no = F.lit(None).cast("string"), F.lit(-1)
        row = lambda kind, n, half, hyphen, rest, more: F.struct(F.lit(kind).alias("kind"), n.alias("line_no"), half.alias("half"), hyphen.alias("hyphen"), rest.alias("rest"), more.alias("followers"))
        nobody = F.array().cast("array<struct<line_no:int,first:string>>")
        f = f.withColumn("lines", F.when(cut, F.filter(F.transform(F.split("flat", "\n"), lambda p, i: F.struct(i.alias("line_no"), _strip(p).alias("line"))), lambda x: x["line"] != "")))
        f = f.withColumn("firsts", F.transform("lines", lambda x: F.struct(x["line_no"].alias("line_no"), F.regexp_extract(x["line"], r"^\S+", 0).alias("first"))))
        inside = F.flatten(
            F.transform(
                F.filter("lines", lambda x: x["line"].rlike(rf"[{HYPHENS}](?<=\p{{L}}.)[ \t]")),
                lambda x: F.transform(
                    F.regexp_extract_all(x["line"], F.lit(CUT), F.lit(0)),
                    lambda m: row("cut", x["line_no"], F.regexp_extract(m, CUT, 1), F.regexp_extract(m, CUT, 2), F.regexp_extract(m, CUT, 3), nobody),
                ),
            )
        )
        # the lines that follow up to one that is surely no furniture; mostly the next one
        widths = F.array(F.array_max(F.transform("lines", lambda x: F.char_length(x["line"]))))
        f = f.withColumn("doubts", F.flatten(F.transform(widths, lambda w: F.transform("lines", lambda x: (F.char_length(x["line"]) <= SHORT * w) | x["line"].rlike(HEAD_AND_NUMBER)))))
        sure = lambda i, n: F.array_position(F.slice("doubts", i + 2, n), F.lit(False)).cast("int")
        followers = lambda i: F.when(sure(i, F.lit(8)) > 0, F.slice("firsts", i + 2, sure(i, F.lit(8)))).otherwise(
            F.slice("firsts", i + 2, F.coalesce(F.nullif(sure(i, F.size("doubts")), F.lit(0)), F.size("firsts")))
        )
        hyphened = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("i"), x["line_no"].alias("line_no"), F.when(F.right(x["line"], F.lit(1)).isin(*HYPHENS), F.regexp_extract(x["line"], rf"(\S*\p{{L}}).$", 1)).alias("half"), F.right(x["line"], F.lit(1)).alias("hyphen"))), lambda e: e["half"] != "")
        ends = F.transform(hyphened, lambda e: row("end", e["line_no"], e["half"], e["hyphen"], none, followers(e["i"])))
        odd = F.when(flat.rlike(ODD), F.transform(F.regexp_extract_all("flat", F.lit(ODD_TOKEN), F.lit(0)), lambda t: row("odd", no, t, none, none, nobody)))
        span = F.when(F.col("spanned"), F.array(row("span", no, none, none, none, nobody)))
        empty = F.array().cast("array<struct<kind:string,line_no:int,half:string,hyphen:string,rest:string,followers:array<struct<line_no:int,first:string>>>>")
        every = F.concat(*[F.coalesce(a, empty) for a in (inside, ends, odd, span)])
        return checkpointed(f.select("doc_id", "id", "text_order", F.inline_outer(every)).filter("kind is not null"))

    @cached_property
    def cuts(self) -> DataFrame:
        """Cuts in running text: keys, first half, hyphen, rest, node and line of the rest, the bare halves and their joins."""
        lined = self.furniture.groupBy("doc_id", "id").agg(F.collect_set("line_no").alias("out"), F.max(F.col("furniture") == "furniture").alias("whole"))
        m = self.marks.filter("kind in ('cut', 'end')").join(lined, ["doc_id", "id"], "left")
        nothing = F.array().cast("array<int>")
        m = m.filter(~_yes(F.col("whole")) & ~F.array_contains(F.coalesce("out", nothing), F.col("line_no"))).withColumn("out", F.coalesce("out", nothing))
        follow = F.get(F.filter("followers", lambda x: ~F.array_contains(F.col("out"), x["line_no"])), F.lit(0))
        m = checkpointed(m.withColumn("follow", F.when(F.col("kind") == "end", follow)))
        inside = m.filter("kind = 'cut'").select("doc_id", "id", "line_no", "half", "hyphen", "rest", F.col("id").alias("rest_id"), F.col("line_no").alias("rest_line"))
        next_line = m.filter("follow is not null").select("doc_id", "id", "line_no", "half", "hyphen", F.col("follow.first").alias("rest"), F.col("id").alias("rest_id"), F.col("follow.line_no").alias("rest_line"))
        # a node's last line goes on with the next node's first one
        open_ = m.filter("kind = 'end' and follow is null and text_order is not null")
        docs = checkpointed(open_.select("doc_id").distinct())
        starts = self.body.filter("text_order is not null").join(_few(docs), "doc_id", "left_semi").select("doc_id", "id", "text_order", F.regexp_extract("text", r"^\s*(\S+)", 1).alias("first"))
        whole = self.furniture.filter("furniture = 'furniture'").select("doc_id", "id").distinct()
        starts = starts.filter("first <> ''").join(_few(checkpointed(whole)), ["doc_id", "id"], "left_anti").withColumn("block", F.floor(F.col("text_order") / BLOCK))
        # a repeated row stands beside itself and goes after the window has seen it
        in_block = Window.partitionBy("doc_id", "block").orderBy("text_order", "id")
        starts = starts.withColumn("again", F.lag("id").over(in_block) == F.col("id")).filter("again is null or not again").drop("again")
        starts = starts.withColumn("next", F.lead(F.struct("first", "id")).over(in_block))
        opening = starts.groupBy("doc_id", "block").agg(F.min(F.struct("text_order", "id", "first")).alias("h"))
        bridge = opening.withColumn("onward", F.lead(F.struct("h.first", "h.id")).over(Window.partitionBy("doc_id").orderBy("block"))).select("doc_id", "block", "onward")
        starts = starts.join(bridge, ["doc_id", "block"]).select("doc_id", "id", F.coalesce("next", "onward").alias("next")).filter("next is not null")
        across = open_.join(starts, ["doc_id", "id"]).select("doc_id", "id", "line_no", "half", "hyphen", F.col("next.first").alias("rest"), F.col("next.id").alias("rest_id"), F.lit(0).alias("rest_line"))
        every = inside.unionByName(next_line).unionByName(across)
        every = _once(every.filter(F.col("rest").rlike(r"^[\p{Ll}0-9!|]")), h=bare_word(_plain(F.col("half"))), r=bare_word(_plain(F.col("rest"))))
        # of a compound only the part at the cut counts
        every = _once(every, a=F.regexp_extract("h", r"([^-]*)$", 1), b=F.regexp_extract("r", r"^([^-]*)", 1)).drop("h", "r").filter("a <> '' and b <> ''")
        return checkpointed(every.withColumn("joined", F.concat("a", "b")).withColumn("compound", F.concat_ws("-", "a", "b")).distinct())

    # -- words

    @cached_property
    def raw(self) -> DataFrame:
        """token, n: every printed token of the corpus; halves of cut words don't count."""
        marked = F.when(F.col("text").rlike(HAS_CUT), F.regexp_replace("text", rf"(?<!\S)\S*\p{{L}}[{HYPHENS}](?:\s+\S+|$)", " ")).otherwise(F.col("text"))
        tokens = self.nodes.filter("node_type in ('Paragraph', 'ListItem', 'Section')").select(marked.alias("text")).select(F.explode_outer(_tokens(F.col("text"))).alias("token"))
        return checkpointed(tokens.filter("token <> ''").groupBy("token").agg(F.count("*").alias("n")))

    def _by_word(self, tokens: DataFrame, count: str) -> DataFrame:
        """token, word, count: compounds count as themselves and by their parts."""
        word = tokens.select("token", bare_word(F.col("token")).alias("word"), count)
        forms = F.when(F.col("word").contains("-"), F.concat(F.array("word"), F.split("word", "-"))).otherwise(F.array("word"))
        return word.select("token", F.explode(forms).alias("word"), count).filter("word <> ''")

    @cached_property
    def words(self) -> DataFrame:
        """word, n, joined (whether only a cut word): raw tokens were counted first, so that each is stripped once."""
        counted = self._by_word(self.raw, "n").select("word", "n")
        # the rest at a page's start stands among the tokens of the next node
        moved = self.cuts.filter("rest_id <> id").select(F.col("b").alias("word"), F.lit(-1).cast("bigint").alias("n"))
        joined = self.cuts.select(F.col("joined").alias("word"), F.lit(0).cast("bigint").alias("n"))
        return checkpointed(counted.unionByName(moved).unionByName(joined).groupBy("word").agg(F.greatest(F.sum("n"), F.lit(0)).alias("n")))

    @cached_property
    def near(self) -> DataFrame:
        """word, n, form, n_form, cost: far more frequent forms with the same skeleton that listed confusions lead to."""
        keyed = self.words.filter(F.col("word").rlike(r"\p{L}") & (F.char_length("word") > 1) & ~F.col("word").contains("-"))
        # what is RARER times as frequent as any word comes that often
        true = keyed.filter((F.col("n") >= RARER) & F.col("word").rlike(r"^\p{L}+$")).select(skeleton(F.col("word")).alias("key"), F.col("word").alias("form"), F.col("n").alias("n_form"))
        seen = keyed.select("word", F.greatest("n", F.lit(1)).alias("n"), skeleton(F.col("word")).alias("key"))
        alike = F.abs(F.char_length("word") - F.char_length("form")) <= MOST_CONFUSIONS
        pairs = seen.join(true, "key").filter((F.col("n_form") >= RARER * F.col("n")) & alike & (F.col("word") != F.col("form")))
        return checkpointed(pairs.withColumn("cost", _cost("word", "form")).filter("cost > 0").drop("key"))

    @cached_property
    def scanned(self) -> DataFrame:
        """doc_id of the documents with evidence."""
        c = self._judged(self.cuts.withColumn("form", F.lit(None).cast("string"))).filter("kind = 'word'").select("doc_id")
        odd = self.marks.filter("kind = 'odd'").select("doc_id", F.explode(F.split(bare_word(_plain(F.col("half"))), "-")).alias("word"))
        odd = odd.join(self.near.select("word").distinct(), "word", "left_semi").select("doc_id")
        sure = self.furniture.filter("sure").select("doc_id").unionByName(self.pages.filter("printed").select("doc_id"))
        return checkpointed(c.unionByName(odd).unionByName(sure).distinct())

    def _in_scans(self, rows: DataFrame) -> DataFrame:
        return rows.join(_few(self.scanned), "doc_id", "left_semi")

    @cached_property
    def _out(self) -> DataFrame:
        """doc_id, id, line_no: the furniture's lines."""
        return checkpointed(self._in_scans(self.furniture).select("doc_id", "id", "line_no").distinct())

    @cached_property
    def nearest(self) -> DataFrame:
        """``near`` at the least cost of each word, and how many forms are as near."""
        each = Window.partitionBy("word")
        return checkpointed(self.near.withColumn("least", F.min("cost").over(each)).filter("cost = least").withColumn("forms", F.count("*").over(each)).drop("cost", "least"))

    @cached_property
    def rare(self) -> DataFrame:
        """doc_id, id, line_no, at, token, ahead: the scans' tokens that hold a word that may be misread, or one of several forms of such a word."""
        near = self.nearest.select("word").union(self.nearest.filter("forms > 1").select("form")).distinct()
        tokens = self._tokens_of(near).unionByName(self._all_tokens.filter(F.col("token").rlike(ODD)).select("token"))
        return checkpointed(self._running().join(_few(checkpointed(tokens.distinct())), "token", "left_semi"))

    @cached_property
    def _all_tokens(self) -> DataFrame:
        """token, n: all printed tokens; those at cuts, which don't count, with n = 0."""
        at_cuts = self.cuts.select(F.explode(F.array(F.concat("half", "hyphen"), "half", "rest")).alias("token")).select(F.explode(_tokens(F.col("token"))).alias("token"))
        return checkpointed(self.raw.unionByName(at_cuts.filter("token <> ''").distinct().withColumn("n", F.lit(0).cast("bigint"))))

    def _tokens_of(self, words: DataFrame) -> DataFrame:
        """The tokens that hold one of the words."""
        return self._by_word(self._all_tokens, "n").join(words, "word", "left_semi").select("token")

    @cached_property
    def forms(self) -> DataFrame:
        """word, form: forms that are misreads of more frequent ones."""
        # outside scans a misread form is rarer still
        inside = self._by_word(self.rare.withColumn("s", F.lit(1).cast("bigint")), "s").groupBy("word").agg(F.sum("s").alias("s"))
        clean = F.greatest(F.col("n") - F.coalesce("s", F.lit(0)), F.lit(0))
        found = checkpointed(self.nearest.join(inside, "word", "left").filter(F.col("n_form") >= RARER_CLEAN * clean).select("word", "form", "n_form", "forms"))
        # where several forms are as near, the one that follows the same words more often in the scans is taken
        several = found.filter("forms > 1")
        pairs = self._pairs(several.select("word").union(several.select("form")).distinct())
        seen = several.join(pairs.select("word", "ahead").distinct(), "word")
        support = seen.join(pairs.select("ahead", F.col("word").alias("form"), F.col("n").alias("s")), ["ahead", "form"]).groupBy("word", "form").agg(F.sum("s").alias("support"))
        ranked = found.join(support, ["word", "form"], "left").na.fill(0, ["support"])
        best = ranked.groupBy("word").agg(F.min(F.struct((-F.col("support")).alias("s"), (-F.col("n_form")).alias("n"), "form")).alias("b"))
        return checkpointed(best.select("word", "b.form"))

    def _pairs(self, words: DataFrame) -> DataFrame:
        """ahead, word, n: the words before the given ones in the scans' running text."""
        tokens = checkpointed(self._by_word(self._all_tokens, "n").join(words, "word", "left_semi").select("token", "word").distinct())
        if tokens.isEmpty():
            return tokens.select(F.col("token").alias("ahead"), "word", F.lit(0).cast("bigint").alias("n"))
        seen = self.rare.filter("ahead is not null").select("token", "ahead").join(_few(tokens), "token")
        return checkpointed(seen.groupBy(bare_word(F.col("ahead")).alias("ahead"), "word").agg(F.count("*").alias("n")))

    @cached_property
    def misprints(self) -> DataFrame:
        """token, word, form: printed tokens that hold a misread form, or one glyph that no word has (form null)."""
        words = self._by_word(self._all_tokens, "n").select("token", "word").distinct().join(self.forms, "word", "left")
        # a digit or sign between small letters is no code, even if the word isn't known
        odd = F.col("token").rlike(ODD) & F.col("word").rlike(r"^(?:\p{Ll}{2,}[0-9!|]\p{Ll}+|\p{Ll}+[0-9!|]\p{Ll}{2,})$")
        return checkpointed(words.filter(F.col("form").isNotNull() | odd).select("token", "word", "form"))

    def _running(self) -> DataFrame:
        """doc_id, id, line_no, at, token, ahead: tokens of scans; those of furniture lines are among them."""
        lines = self._flat(self._in_scans(self.body)).select("doc_id", "id", F.posexplode_outer(F.split("flat", "\n")).alias("line_no", "line"))
        lines = lines.withColumn("words", F.split(_strip(_plain(F.col("line"))), " "))
        pairs = F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("token"), F.get("words", i - 1).alias("ahead")))
        return lines.select("doc_id", "id", "line_no", F.inline_outer(pairs)).filter("token <> ''")

    # -- heads inside running lines

    @cached_property
    def named(self) -> DataFrame:
        """doc_id, id, at, until, half, rest: known heads inside text whose lines run together, by their tokens' places.

        An anchor is a token with a capital or an underscore; it meets the document's heads that begin with the same two masked tokens.
        """
        bare = lambda c: F.regexp_replace(c, rf"^(?i:{_NUMBER}){_APART}|{_APART}(?i:{_NUMBER})$", "")
        # a key without patterns: the stroke classes of two tokens
        two = lambda c: skeleton(F.translate(c, " .,:;|()[]-_'", ""))
        title = self._in_scans(self.metadata.select("doc_id", F.trim(F.regexp_replace(_plain(F.col("title")), r"\s+", " ")).alias("head"))).filter("head <> ''")
        heads = title.unionByName(self._in_scans(self.furniture.filter("mask is not null")).select("doc_id", F.trim(bare(F.col("line"))).alias("head"))).distinct()
        heads = heads.withColumn("w", F.split("head", " +")).select("doc_id", two(F.array_join(F.slice("w", 1, 2), " ")).alias("key"), masked(F.col("head")).alias("mask"), F.size("w").alias("k")).filter("length(mask) > 3").distinct()
        one = self._in_scans(self.body.filter(~F.col("text").contains("\n"))).join(_few(self._out).select("doc_id", "id"), ["doc_id", "id"], "left_anti")
        # only texts with a page number or capitals of a head, or with the document's title, are searched
        spans = _few(checkpointed(self.marks.filter("kind = 'span'").select("doc_id", "id", F.lit(True).alias("spanned")).distinct()))
        named = _few(checkpointed(title.select("doc_id", two(F.col("head")).alias("title")).filter("length(title) > 3").distinct()))
        one = one.join(spans, ["doc_id", "id"], "left").join(named, "doc_id", "left").filter(F.col("spanned") | two(F.col("text")).contains(F.col("title"))).drop("spanned", "title")
        one = checkpointed(one.distinct())
        capital = r"\p{Lu}\S* +\S+"
        anchors = F.when(F.col("text").contains("_"), F.regexp_extract_all("text", F.lit(rf"\s(?=({capital}|\S*_\S*))"), F.lit(1)))
        key = F.transform(anchors.otherwise(F.regexp_extract_all("text", F.lit(rf"\s(?=({capital}))"), F.lit(1))), two)
        heads = _few(checkpointed(heads))
        met = one.select("doc_id", "id", F.explode_outer(F.array_distinct(key)).alias("key")).join(heads, ["doc_id", "key"]).drop("key").distinct()
        # of the few texts that meet a head, the tokens are those of running text
        texts = self._flat(one.join(_few(checkpointed(met)), ["doc_id", "id"]), "mask", "k")
        words = texts.select("doc_id", "id", "mask", "k", F.split(_strip(_plain(F.col("flat"))), " ").alias("w")).filter("size(w) > 2")
        starts = F.filter(F.sequence(F.lit(1), F.size("w") - 1), lambda i: masked(F.array_join(F.slice("w", i + 1, F.col("k")), " ")) == F.col("mask"))
        hit = words.withColumn("at", F.explode_outer(starts))
        # a bare page number beside it belongs to it
        end = F.col("at") + F.col("k")
        end = end + F.when(_yes(F.get("w", end).rlike(rf"^{_BARE}$")), 1).otherwise(0)
        hit = hit.withColumn("until", end).filter(F.col("until") < F.size("w"))
        return checkpointed(hit.select("doc_id", "id", "at", "until", F.get("w", F.col("at") - 1).alias("half"), F.get("w", F.col("until")).alias("rest")).distinct())

    # -- results

    @cached_property
    def _words_few(self) -> DataFrame:
        return _few(self.words)

    def _judged(self, cuts: DataFrame) -> DataFrame:
        """The cuts with the word, if the vocabulary knows the halves as one word, or else as a compound with its own hyphen."""
        keys = ("word", "compound", "a", "b")
        c = cuts.withColumn("word", F.coalesce("form", "joined"))
        # one row a word of the cut, so that the vocabulary is joined once
        each = c.withColumn("asked", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("text")) for k in keys])))
        each = each.join(self._words_few.select(F.col("word").alias("_word"), F.col("n").alias("_n")), F.col("asked.text") == F.col("_word"), "left")
        c = each.groupBy(*c.columns).agg(*[F.coalesce(F.max(F.when(F.col("asked.key") == k, F.col("_n"))), F.lit(0)).alias(f"n_{k}") for k in keys])
        n = {k: F.col(f"n_{k}") for k in keys}
        known = (n["word"] > 0) & (n["word"] >= n["compound"])
        fragments = (n["compound"] == 0) & (n["word"] == 0) & (n["a"] == 0) & (n["b"] == 0)
        kind = F.when(known | fragments, "word").when(n["compound"] > 0, "compound")
        return c.withColumn("kind", kind).select(*cuts.columns, "word", "kind")

    @cached_property
    def judged(self) -> DataFrame:
        """All cuts, also those before a known head: the columns of ``cuts``, the joined word's true form if it is misread, word and kind."""
        c = self.named.filter(F.col("half").rlike(rf"\p{{L}}[{HYPHENS}]$") & F.col("rest").rlike(r"^[\p{Ll}0-9!|]"))
        a, b = F.regexp_extract(bare_word(F.regexp_extract("half", rf"(\S*\p{{L}})[{HYPHENS}]$", 1)), r"([^-]*)$", 1), F.regexp_extract(bare_word(F.col("rest")), r"^([^-]*)", 1)
        c = c.select(
            "doc_id", "id", F.lit(0).alias("line_no"), F.regexp_extract("half", rf"(\S*\p{{L}})[{HYPHENS}]$", 1).alias("half"), F.right("half", F.lit(1)).alias("hyphen"), "rest",
            F.col("id").alias("rest_id"), F.lit(0).alias("rest_line"), a.alias("a"), b.alias("b"), F.concat(a, b).alias("joined"), F.concat_ws("-", a, b).alias("compound"),
        ).filter("a <> '' and b <> ''")
        every = self.cuts.unionByName(c)
        every = every.join(self.forms.select(F.col("word").alias("joined"), "form"), "joined", "left")
        return checkpointed(self._judged(every))

    @property
    def broken(self) -> DataFrame:
        """Words that were cut in two."""
        return self.judged.filter("kind = 'word'")

    @cached_property
    def misread(self) -> DataFrame:
        """Misread words: doc_id, id, word, form (null where a glyph is wrong but the word isn't known)."""
        seen = self.rare.join(_few(self.misprints), "token")
        seen = seen.filter(~_name() | F.col("word").rlike(r"[0-9!|]"))
        seen = seen.join(_few(self._out), ["doc_id", "id", "line_no"], "left_anti")
        inner = self.named.select("doc_id", "id", F.lit(0).alias("line_no"), F.explode(F.sequence(F.col("at"), F.col("until") - 1)).alias("at"))
        seen = seen.join(inner.distinct(), ["doc_id", "id", "line_no", "at"], "left_anti")
        # halves of cut words are judged joined
        halves = self.broken.select("doc_id", "id", F.col("a").alias("word")).unionByName(self.broken.select("doc_id", F.col("rest_id").alias("id"), F.col("b").alias("word"))).distinct()
        seen = seen.join(halves, ["doc_id", "id", "word"], "left_anti").select("doc_id", "id", "word", "form")
        joined = self.broken.filter(F.col("form").isNotNull() & (~F.col("half").rlike(r"^\p{Lu}") | F.col("joined").rlike(r"[0-9!|]")))
        # the wrong glyph is in the second half where the first one is as it should be
        joined = joined.select("doc_id", F.when(F.col("form").startswith(F.col("a")), F.col("rest_id")).otherwise(F.col("id")).alias("id"), F.col("joined").alias("word"), "form")
        return seen.unionByName(joined)

    def defects(self) -> DataFrame:
        """node_id, defect: one row per node of a scanned document and kind of defect."""
        found = self._in_scans(self.furniture).select("id", F.col("furniture").alias("defect"))
        whole = self.furniture.select("doc_id", "id").distinct()
        inline = self._in_scans(self.marks.filter("kind = 'span'")).select("doc_id", "id").unionByName(self.named.select("doc_id", "id")).distinct().join(whole, ["doc_id", "id"], "left_anti")
        inline = inline.select("id", F.lit("inline_furniture").alias("defect"))
        broken = self.broken.select("id", F.lit("broken_word").alias("defect"))
        misread = self.misread.select("id", F.lit("misread").alias("defect"))
        every = found.unionByName(inline).unionByName(broken).unionByName(misread).distinct()
        return every.withColumnRenamed("id", "node_id")

    def repaired(self) -> DataFrame:
        """doc_id, node_id, node_type, text_order, text: running text without furniture, cuts and misreads, one line a node.

        A word cut at a page end stands whole in the node of its first half.
        """
        at = ["doc_id", "id", "line_no", "at"]
        whole = self.furniture.filter("furniture = 'furniture'").select("doc_id", "id").distinct()
        run = self._running().join(_few(self._out), ["doc_id", "id", "line_no"], "left_anti").distinct()
        inner = self.named.select("doc_id", "id", F.lit(0).alias("line_no"), F.explode(F.sequence(F.col("at"), F.col("until") - 1)).alias("at")).distinct()
        run = run.join(inner, at, "left_anti")
        # a first half takes the whole word, the rest goes; a compound keeps its hyphen, anything else stays as it is printed
        cuts = self.judged.filter("kind is not null")
        whole_word = F.concat("half", F.when(F.col("kind") == "word", "").otherwise(F.col("hyphen")), "rest")
        mended = cuts.select("doc_id", "id", "line_no", _plain(F.concat("half", "hyphen")).alias("token"), _plain(whole_word).alias("mended"))
        mended = mended.groupBy("doc_id", "id", "line_no", "token").agg(F.min("mended").alias("mended"))
        moved = cuts.select("doc_id", F.col("rest_id").alias("id"), F.col("rest_line").alias("line_no"), _plain(F.col("rest")).alias("token")).distinct().withColumn("moved", F.lit(True))
        run = run.join(mended, ["doc_id", "id", "line_no", "token"], "left").join(moved, ["doc_id", "id", "line_no", "token"], "left")
        # of a moved token only the one after a cut, at the line's start or behind its first half, is the rest
        behind = Window.partitionBy("doc_id", "id", "line_no").orderBy("at")
        first = (F.col("at") == F.min("at").over(Window.partitionBy("doc_id", "id", "line_no"))) | _yes(F.lag("mended").over(behind).isNotNull())
        run = run.withColumn("gone", _yes(F.col("moved")) & first).filter("not gone").withColumn("token", F.coalesce("mended", "token")).drop("mended", "moved", "gone")
        fixes = self.misprints.filter("form is not null").select("word", "form").distinct()
        rare = run.join(_few(self.misprints).select("token").distinct(), "token", "left_semi").select(*at, _name().alias("name"), F.explode(F.split(bare_word(F.col("token")), "-")).alias("word"))
        rare = rare.filter(~F.col("name") | F.col("word").rlike(r"[0-9!|]"))
        forms = rare.join(fixes, "word").groupBy(*at).agg(F.collect_set(F.struct("word", "form")).alias("fixes"))
        fixed = F.aggregate(
            F.col("fixes"),
            F.col("token"),
            lambda t, f: F.when(
                F.substring(t, 1, 1).rlike(r"\p{Lu}") & F.lower(t).startswith(f["word"]), F.concat(F.initcap(f["form"]), F.substring(t, F.char_length(f["word"]) + 1, F.char_length(t)))
            ).otherwise(F.replace(t, f["word"], f["form"])),
        )
        run = run.join(forms, at, "left").withColumn("token", F.when(F.col("fixes").isNotNull(), fixed).otherwise(F.col("token")))
        text = run.groupBy("doc_id", "id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "at", "token"))), lambda x: x["token"]), " ").alias("text"))
        keys = self._in_scans(self.body).groupBy("doc_id", "id").agg(F.min("node_type").alias("node_type"), F.min("text_order").alias("text_order")).join(whole, ["doc_id", "id"], "left_anti")
        return keys.join(text, ["doc_id", "id"]).select("doc_id", F.col("id").alias("node_id"), "node_type", "text_order", "text")
