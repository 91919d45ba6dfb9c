"""One form for text that looks the same (problem 2).

Tokens (between blanks) that hold anything beyond plain ASCII are suspicious. The vocabulary is every token spelling of
the corpus with its count. Tries of the vocabulary, each of many different words, are traversed for each suspicious token by a
weighted edit automaton: against a look-alike a character costs nothing, an ignorable character costs nothing to insert or
drop, every other edit costs its weight, and paths whose cost exceeds the bound (0 here) end. Of the clean spellings so
reached the most frequent one is the canonical spelling; a token that reaches none is normalised by table. All spellings of
one look therefore get the same canonical one, and two texts look the same exactly if their canonical texts are equal.

A vocabulary may be of any size, so it is never broadcast: tries are built per shard of the vocabulary. What a token reaches at
no cost has its skeleton (each character replaced by its class, ignorables dropped), so that a hash of the skeleton names
the one shard that holds all of it; the tests hold this against a search of the whole vocabulary.

Defined results: a null text has a null canonical text; an empty one an empty one; every blank becomes a space (their
number is kept, since a reader sees it); a class that has an ASCII spelling in the corpus takes it, so that plain texts are
never rewritten; ties go to the smaller spelling; null ids are kept in canonical texts and pair with nothing.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom.session import checkpointed

#: Letters of other scripts that print like a Latin one, as pairs (look-alike, Latin).
LOOKALIKES = (
    "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ԌG ԚQ ԜW "
    "аa еe оo рp сc уy хx ѕs іi јj ԁd һh ԛq ԝw ӏl "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX "
    "οo νv ϲc ϳj ρp ιi αa ‐- ‑-"
)
#: Characters that print nothing.
IGNORABLE = "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩︀︁︂︃︄︅︆︇︈︉︊︋︌︍︎️﻿"
#: Blanks of every kind.
BLANK = "\t\n\x0b\x0c\r\u0085                 ⠀　ㅤﾠ"
#: What makes a token suspicious.
SUSPICIOUS = "[^\\u0000-\\u007e]"
#: Weights of the edits that a reader sees: another character, one more or one less.
REPLACED, ADDED = 1, 1
#: Rows of one look that one task pairs with the others; larger looks are spread over salts.
PAIRED = 1024
#: Characters of vocabulary in one trie; a shard with more is cut between two looks.
TRIE_CHARS = 1_000_000


@functools.cache
def classes() -> dict[str, str]:
    """Each character's class where it isn't itself: width and ligature forms by rule, look-alikes by table."""
    out = {c: "" for c in IGNORABLE}
    for low, high in ((0xFB00, 0xFB06), (0xFF01, 0xFFEE)):
        for k in range(low, high + 1):
            plain = unicodedata.normalize("NFKC", chr(k))
            if plain != chr(k) and chr(k) not in BLANK:
                out[chr(k)] = plain
    out |= {p[0]: p[1] for p in LOOKALIKES.split()}
    return {k: "".join(out.get(c, c) for c in v) for k, v in out.items()}


@functools.cache
def _table() -> dict[int, str]:
    return {ord(k): v for k, v in classes().items()} | {ord(b): " " for b in BLANK}


def skeleton(token: str) -> str:
    """The token by classes, composed: equal for tokens that look the same."""
    if token.isascii():
        return token.translate(_table()) if not token.isprintable() else token
    # accents first, so that a look-alike under an accent is found; twice, as a class may compose anew
    bare = unicodedata.normalize("NFD", token.translate(_table()))
    return unicodedata.normalize("NFC", bare.translate(_table()))


def clean(token: str) -> bool:
    """Whether a spelling may be canonical: composed, without ignorables or width forms, and of one script."""
    if token.isascii():
        return True
    if unicodedata.normalize("NFC", token) != token:
        return False
    scripts = set()
    for c in token:
        if c in IGNORABLE or c in BLANK or 0xFB00 <= ord(c) <= 0xFB06 or 0xFF01 <= ord(c) <= 0xFFEE:
            return False
        if c.isalpha():
            name = unicodedata.name(c, "").split(" ")[0]
            scripts.add({"HIRAGANA": "CJK", "KATAKANA": "CJK", "KATAKANA-HIRAGANA": "CJK", "FEMININE": "LATIN", "MASCULINE": "LATIN", "MICRO": "LATIN"}.get(name, name))
    return len(scripts) <= 1 or scripts <= {"CJK", "LATIN"} and not any(c in classes() for c in token)


class Trie:
    """Vocabulary spellings by their decomposed characters; a node is [edges, spellings]."""

    def __init__(self) -> None:
        self.root: list = [{}, []]

    def add(self, spelling: str, count: int) -> None:
        node = self.root
        for c in unicodedata.normalize("NFD", spelling):
            node = node[0].setdefault(c, [{}, []])
        node[1].append((count, spelling))

    def reach(self, token: str, bound: int = 0) -> list[tuple[int, str]]:
        """All spellings at a cost of at most ``bound`` from ``token``.

        The automaton reads the token's characters as the classes they look like. Its states are trie nodes with a place in the
        token; a state is entered again only at a lower cost.
        """
        look = classes()
        read = unicodedata.normalize("NFD", skeleton(token))
        best: dict[tuple[int, int], int] = {}
        ends: dict[int, list] = {}
        todo = [(0, self.root, 0)]
        while todo:
            cost, node, at = todo.pop()
            if best.get((id(node), at), bound + 1) <= cost:
                continue
            best[id(node), at] = cost
            if at == len(read) and node[1]:
                ends[id(node)] = node[1]
            if at < len(read) and cost + ADDED <= bound:
                todo.append((cost + ADDED, node, at + 1))
            for c, child in node[0].items():
                edge = look.get(c, c)
                # an ignorable's edge is empty and free, a ligature's reads all its letters
                wrong = sum(a != b for a, b in zip(edge, read[at : at + len(edge)]))
                if at + len(edge) <= len(read) and cost + wrong * REPLACED <= bound:
                    todo.append((cost + wrong * REPLACED, child, at + len(edge)))
                if edge and cost + len(edge) * ADDED <= bound:
                    todo.append((cost + len(edge) * ADDED, child, at))
        return [s for spellings in ends.values() for s in spellings]


def canonical_spelling(token: str, trie: Trie) -> str:
    """The most frequent clean spelling at cost 0, an ASCII one before others; else the token by table."""
    reached = [(s.isascii(), n, s) for n, s in trie.reach(token) if clean(s)]
    if not reached:
        return skeleton(token)
    most = max(r[:2] for r in reached)
    return min(s for a, n, s in reached if (a, n) == most)


def _blanks(text: Column) -> Column:
    return F.translate(text, BLANK, " " * len(BLANK))


def _skeletons(kind: str = "string"):
    @F.pandas_udf(kind)
    def of(tokens: pd.Series) -> pd.Series:
        return pd.Series([skeleton(t) for t in tokens], dtype=object)

    return of


def spellings(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, canonical) for every suspicious token of the texts whose canonical spelling differs."""
    tokens = (
        texts.select(F.explode(F.split(_blanks(F.col(text_col)), " ")).alias("token")).filter("token <> ''").groupBy("token").agg(F.count("*").alias("n"))
    )
    # one row a distinct token from here on; its shard is that of its skeleton
    keyed = tokens.withColumn("skeleton", F.when(F.col("token").rlike(SUSPICIOUS), _skeletons()(F.col("token"))).otherwise(F.col("token")))
    keyed = keyed.select("token", "n", "skeleton")
    shards = max(8, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    keyed = keyed.repartition(shards, "skeleton").sortWithinPartitions("skeleton")

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a look's spellings stand together in one shard, so that one trie answers for them
        trie, odd, chars, last = Trie(), [], 0, None
        for b in batches:
            out = []
            for token, n, look in zip(b["token"], b["n"], b["skeleton"]):
                if look != last and chars > TRIE_CHARS:
                    out += [(t, canonical_spelling(t, trie)) for t in odd]
                    trie, odd, chars = Trie(), [], 0
                last = look
                if clean(token):
                    trie.add(token, int(n))
                    chars += len(token)
                if not token.isascii():
                    odd.append(token)
            yield pd.DataFrame([x for x in out if x[0] != x[1]], columns=["token", "canonical"])
        rest = [(t, canonical_spelling(t, trie)) for t in odd]
        yield pd.DataFrame([x for x in rest if x[0] != x[1]], columns=["token", "canonical"])

    return keyed.mapInPandas(match, "token string, canonical string")


def canonical_texts(rows: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys``, the text and its canonical form; rows that repeat keys and text may come once.

    Only the tokens of suspicious texts are exploded and joined with the changed spellings; they come together again by
    the row's keys and text hash.
    """
    base = rows.select(*keys, F.col(text_col).alias("text"))
    changes = spellings(base, "text")
    odd = F.col("text").rlike(SUSPICIOUS)
    plain = base.filter(F.col("text").isNull() | ~odd).withColumn("canonical", _blanks(F.col("text")))
    marked = base.filter(odd).distinct().withColumn("_h", F.xxhash64("text"))
    tokens = marked.select(*keys, "_h", F.posexplode(F.split(_blanks(F.col("text")), " ")).alias("at", "token"))
    # plain tokens never change and stay out of the join, so that the most frequent words can't make it uneven
    plain_tokens = tokens.filter(~F.col("token").rlike(SUSPICIOUS))
    odd_tokens = tokens.filter(F.col("token").rlike(SUSPICIOUS))
    spelt = odd_tokens.join(changes, "token", "left").select(*keys, "_h", "at", F.coalesce("canonical", "token").alias("token")).unionByName(plain_tokens)
    whole = spelt.groupBy(*keys, "_h").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]), " ").alias("canonical")
    )
    on = F.col("m._h") == F.col("w._h")
    for k in keys:
        on = on & F.col(f"m.{k}").eqNullSafe(F.col(f"w.{k}"))
    again = marked.alias("m").join(whole.alias("w"), on).select(*[F.col(f"m.{k}") for k in keys], F.col("m.text"), F.col("w.canonical"))
    return plain.unionByName(again)


def looks(rows: DataFrame, scope: list[str], id_col: str, text_col: str) -> DataFrame:
    """Scope, id, look and own (hashes of canonical and given text) of the rows whose look has different texts in the scope, and how many rows it has.

    Looks of which all texts are the same string are dropped.
    """
    known = rows.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(*scope, F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = checkpointed(canonical_texts(known, [*scope, "id"]).select(*scope, "id", F.unhex(F.sha2("canonical", 256)).alias("look"), F.unhex(F.sha2("text", 256)).alias("own")))
    at = [*scope, "look"]
    mixed = texts.groupBy(*at).agg(F.min("own").alias("a"), F.max("own").alias("b"), F.min("id").alias("first_id"), F.count("*").alias("n")).filter("a <> b").select(*at, "first_id", "n")
    return texts.join(mixed, at)


def members(rows: DataFrame, scope: list[str], id_col: str, text_col: str) -> DataFrame:
    """Scope, id, class_id (the look's smallest id), spelling (the SHA-256 of the text): one row a text with equal-looking others."""
    few = looks(rows, scope, id_col, text_col).select(*scope, "id", F.col("first_id").alias("class_id"), F.hex("own").alias("spelling"))
    return few.distinct()


def equal_looking(rows: DataFrame, scope: list[str], id_col: str, text_col: str) -> DataFrame:
    """Pairs (id_a < id_b) inside a scope whose texts look the same but aren't the same string.

    Of a look only different strings meet; a look of many rows is spread over as many salts as it has PAIRED rows.
    """
    few = looks(rows, scope, id_col, text_col).withColumn("salts", F.ceil(F.col("n") / PAIRED).cast("int"))
    at = [*scope, "look", "_salt"]
    left = few.withColumn("_salt", F.pmod(F.xxhash64("id"), "salts").cast("int")).select(*at, "id", "own")
    other = few.select(*scope, "look", F.col("id").alias("id_b"), F.col("own").alias("own_b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("_salt"))
    return left.join(other, at).filter("id < id_b and own <> own_b").select(F.col("id").alias("id_a"), "id_b").distinct()


def memberships(nodes: DataFrame, metadata: DataFrame) -> DataFrame:
    """field, id, class_id, spelling: the classes of equal-looking texts, without their pairs."""
    texts = members(nodes.select("doc_id", "id", F.col("content.text").alias("text")), ["doc_id"], "id", "text")
    titles = members(metadata.select("root_id", "title"), [], "root_id", "title")
    return texts.select(F.lit("text").alias("field"), "id", "class_id", "spelling").unionByName(titles.select(F.lit("title").alias("field"), "id", "class_id", "spelling"))


def pairs(nodes: DataFrame, metadata: DataFrame) -> DataFrame:
    """field, id_a, id_b: equal-looking node texts of one document and equal-looking titles of any documents."""
    texts = equal_looking(nodes.select("doc_id", "id", F.col("content.text").alias("text")), ["doc_id"], "id", "text")
    titles = equal_looking(metadata.select("root_id", "title"), [], "root_id", "title")
    return texts.select(F.lit("text").alias("field"), "id_a", "id_b").unionByName(titles.select(F.lit("title").alias("field"), "id_a", "id_b"))
