"""Garbled text from a wrong character encoding (problem 7).

1. Adjacent character pairs and single characters of the whole corpus are counted, pairs in a hashed table of fixed size.
   A pair's pointwise mutual information is pmi(a, b) = log2 p(a, b) - log2 p(a) - log2 p(b), and its share of the corpus'
   mutual information p(a, b) * pmi(a, b). (The pointwise value alone would favour garbling, which binds its characters
   tightly; its share of the whole is small all the same, since such pairs are few.) Values of pmi beside LEAST_PMI and
   MOST_PMI count as these.
2. In each text a pair scores the bits of its share, -log2 of it, less the corpus' mean and a margin, so that pairs that carry
   the corpus' mutual information count against a run and others for it; maximum-scoring segments are the improbable runs.
3. Only inside these runs inverse mappings are tested: bytes of a wrong encoding that are well-formed UTF-8, and
   single-byte and Japanese encodings read as another one. A mapping is taken if the restored characters, with their
   neighbours, need fewer bits than the garbled ones by a margin. Runs garbled twice are restored twice.

The replacement character U+FFFD shows a lossy decoding; such texts are found but cannot be restored there.

Defined results: null and empty texts have no runs; repeated rows give repeated rows; an empty table gives an empty
result; a text without garbling is returned as it is.
"""

from __future__ import annotations

import codecs
import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of the hashed pair table; it bounds what is collected and broadcast (4 bytes a bucket) at any input size.
BITS = 20
#: Wrong encodings through which UTF-8 bytes were read.
UTF8_VIA = ("cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "cp437", "cp850", "cp852", "mac-roman", "koi8-r", "cp1253", "cp1254", "cp866")
#: (wrong, right): bytes of the right encoding read through the wrong one.
OTHER = (
    ("cp1252", "cp1251"), ("latin-1", "cp1251"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1252", "koi8-r"), ("cp1251", "cp866"),
    ("cp1252", "cp1253"), ("cp1252", "cp1250"), ("cp1252", "cp932"), ("latin-1", "cp932"), ("cp1252", "euc_jp"), ("latin-1", "euc_jp"),
    ("cp1252", "mac-roman"), ("mac-roman", "cp1252"), ("cp1252", "cp437"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1251", "cp1252"),
)
#: Bits that a restored run must save: at all, and per restored pair where the length stays the same.
LEAST_BITS, BITS_A_PAIR = 10.0, 3.0
#: Fixed value: signs that count as letters in Unicode.
LETTERLIKE = "µªºƒˆ˜"
#: A run ends where the score has fallen this far below its best.
DROP = 16.0
#: Bits above the corpus' mean from which a pair counts as improbable.
MARGIN = 2.0
ROUNDS = 3
LOST = "�"
SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Bounds within which a pair's pointwise mutual information counts.
LEAST_PMI, MOST_PMI = 0.5, 4.0
CODES = 0x110000


def bucket(codes: np.ndarray) -> np.ndarray:
    """The bucket of each adjacent pair."""
    a = codes[:-1].astype(np.uint64)
    key = (a << np.uint64(21)) | codes[1:].astype(np.uint64)
    return ((key * SPREAD) >> np.uint64(64 - BITS)).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def pair_counts(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """(bucket, n, pair) over all texts; each task adds up its own pairs first.

    Buckets up to 2 ** BITS hold adjacent pairs (and one of the pairs that share the bucket), those above it single characters.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, chars, some = np.zeros(1 << BITS, dtype=np.int64), np.zeros(CODES, dtype=np.int64), np.zeros(1 << BITS, dtype=np.int64)
        for batch in batches:
            # a line feed stands between texts, so that no pair spans two of them
            codes = _codes("\n".join(["", *(t for t in batch.column(0).to_pylist() if t), ""]))
            at = bucket(codes)
            pairs += np.bincount(at, minlength=1 << BITS)
            some[at] = (codes[:-1].astype(np.int64) << 21) | codes[1:]
            seen = np.bincount(codes)
            chars[: len(seen)] += seen
        p, c = np.flatnonzero(pairs), np.flatnonzero(chars)
        columns = (np.concatenate([p, c + (1 << BITS)]), np.concatenate([pairs[p], chars[c]]), np.concatenate([some[p], c]))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["bucket", "n", "pair"])

    return documents.select(text_col).mapInArrow(count, "bucket bigint, n bigint, pair bigint").groupBy("bucket").agg(F.sum("n").alias("n"), F.max("pair").alias("pair"))


def share_bits(pair: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """-log2 of pairs' shares of the mutual information, from the bits (-log2 p) of the pairs and of their characters."""
    return pair - np.log2(np.clip(first + second - pair, LEAST_PMI, MOST_PMI))


def information(documents: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray, float]:
    """Bits of every bucket's pairs, bits of every character, and the mean of the share's bits over the corpus."""
    n, chars, pair = np.zeros(1 << BITS), np.zeros(CODES), np.zeros(1 << BITS, dtype=np.int64)
    for at, times, key in pair_counts(documents, text_col).toLocalIterator():  # at most 2 ** BITS rows and one a character
        if at < 1 << BITS:
            n[at], pair[at] = times, key
        else:
            chars[key] = times
    bits = (-np.log2(np.maximum(n, 0.5) / max(n.sum(), 2.0))).astype(np.float32)
    single = (-np.log2(np.maximum(chars, 0.5) / max(chars.sum(), 2.0))).astype(np.float32)
    shares = share_bits(bits, single[pair >> 21], single[pair & (1 << 21) - 1])
    return bits, single, float((n * shares).sum() / max(n.sum(), 2.0))


@functools.cache
def _byte_chars(enc: str) -> dict[int, str]:
    """The character of each byte from 0x80 on; bytes that the encoding lacks stand for the control character."""
    out = {}
    for b in range(128, 256):
        try:
            out[b] = bytes([b]).decode(enc)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


@functools.cache
def _back(enc: str) -> dict[str, int]:
    return {c: b for b, c in _byte_chars(enc).items()}


@functools.cache
def _charmap(enc: str):
    """For codecs.charmap_encode: text read through ``enc`` back to its bytes."""
    return codecs.charmap_build("".join(map(chr, range(128))) + "".join(_byte_chars(enc)[b] for b in range(128, 256)))


@functools.cache
def _utf8_pattern(enc: str) -> re.Pattern:
    """Well-formed UTF-8 sequences as they look through ``enc``."""
    chars = _byte_chars(enc)

    def one(a: int, b: int) -> str:
        return "[" + "".join(re.escape(chars[x]) for x in range(a, b + 1)) + "]"

    more = one(0x80, 0xBF)
    return re.compile(f"(?:{one(0xC2, 0xDF)}{more}|{one(0xE0, 0xEF)}{more}{{2}}|{one(0xF0, 0xF4)}{more}{{3}})+")


DRAWING = re.compile("[\u2500-\u259f]")
GBK_RUN = re.compile("[¤-￥]*[⺀-﫿][¤-￥]*")
LINE = re.compile("[^\n]+")
NON_ASCII = re.compile("[^\x00-\x7e]")


class Pairs(dict):
    """Bits of single pairs' shares, remembered up to a bound."""

    def __init__(self, bits: np.ndarray, single: np.ndarray) -> None:
        self.bits, self.single = bits, single

    def __missing__(self, pair: tuple[str, str]) -> float:
        if len(self) > 1 << 18:
            self.clear()
        codes = np.array([ord(pair[0]), ord(pair[1])], dtype=np.uint32)
        self[pair] = value = float(share_bits(self.bits[bucket(codes)], *self.single[codes])[0])
        return value


class Model:
    """Pair information and the tests that use it."""

    def __init__(self, bits: np.ndarray, single: np.ndarray, mean: float) -> None:
        self.bits, self.single, self.mean, self.pairs = bits, single, mean, Pairs(bits, single)
        # runs recur; the answer depends on nothing but the run and its neighbours
        self.restored = functools.lru_cache(maxsize=1 << 16)(self._restored)

    def info(self, text: str) -> float:
        return sum(map(self.pairs.__getitem__, zip(text, text[1:])))

    def runs(self, text: str) -> list[tuple[int, int]]:
        """Maximum-scoring segments that hold a character beyond ASCII, as (start, end)."""
        first = NON_ASCII.search(text)
        if not first:
            return []
        codes = _codes(text)
        odd = np.flatnonzero(codes > 126)
        own = self.single[codes]
        values = (share_bits(self.bits[bucket(codes)], own[:-1], own[1:]) - np.float32(self.mean + MARGIN)).tolist()
        out: list[tuple[int, int]] = []
        done = 0
        for p in odd.tolist():
            if p < done:
                continue
            # from each such character both ways, as far as the best sum
            best, total, end = 0.0, 0.0, p
            for k in range(p, len(values)):
                total += values[k]
                if total > best:
                    best, end = total, k + 1
                elif total < best - DROP:
                    break
            best, total, start = 0.0, 0.0, p
            for k in range(p - 1, done - 1, -1):
                total += values[k]
                if total > best:
                    best, start = total, k
                elif total < best - DROP:
                    break
            # the second byte of a Japanese character may be a plain letter
            start, end = max(start, done), min(len(text), end + 1)
            if end < len(text) and "\x7f" < text[end - 1] < "\xa0" and "@" <= text[end] < "\x7f":
                end += 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], end)
            else:
                out.append((start, end))
            done = end
        # garbling does not cross lines, and mappings are tested on one line's run at a time
        return [
            (start + m.start(), start + m.end())
            for start, end in out
            for m in LINE.finditer(text[start:end])
            if NON_ASCII.search(m.group())
        ]

    def gain(self, before: str, old: str, new: str, after: str) -> float:
        return self.info(before + old + after) - self.info(before + new + after)

    def _restored(self, before: str, run: str, after: str) -> tuple[str, str] | None:
        """(new text of the run, mapping), or None if no mapping fits inside the run.

        The mapping that covers most of the run's characters beyond ASCII wins, then the one that saves most bits.
        """
        size = len(NON_ASCII.findall(run))
        best: tuple[float, float, str, str] | None = None
        for enc in UTF8_VIA:
            saved, at, parts, covered = 0.0, 0, [], 0
            for m in _utf8_pattern(enc).finditer(run):
                try:
                    new = codecs.charmap_encode(m.group(), "strict", _charmap(enc))[0].decode()
                except UnicodeDecodeError:
                    continue
                if not _proper(new):
                    continue
                gain = self.gain(run[m.start() - 1 : m.start()] if m.start() else before, m.group(), new, run[m.end() : m.end() + 1] or after)
                if gain < LEAST_BITS or _weak(m.group(), gain) or _drawn(m, run):
                    continue
                parts += [run[at : m.start()], new]
                at, saved, covered = m.end(), saved + gain, covered + len(m.group())
            if parts and (best is None or (covered / size, saved) > best[:2]):
                best = (covered / size, saved, "".join([*parts, run[at:]]), f"utf-8 via {enc}")
        for new, covered, saved, name in (*self._multi(run, before, after), *(self._swapped(run, before, after) if size > 2 else ())):
            if best is None or (covered / size, saved) > best[:2]:
                best = (covered / size, saved, new, name)
        return best and best[2:]

    def _multi(self, run: str, before: str, after: str) -> Iterator[tuple[str, int, float, str]]:
        """UTF-8 read as GB 18030: stretches of ideographs whose bytes are well-formed UTF-8."""
        at, parts, saved, covered = 0, [], 0.0, 0
        for m in GBK_RUN.finditer(run):
            try:
                data = m.group().encode("gb18030")
            except UnicodeEncodeError:
                continue
            new = data.decode("utf-8", "replace")
            # a last byte may have been swallowed with its neighbour
            if new.count(LOST) > max(0, len(new) // 6) or not _proper(new.replace(LOST, "")) or new.strip(LOST) == "":
                continue
            gain = self.gain(run[m.start() - 1 : m.start()] if m.start() else before, m.group(), new.replace(LOST, ""), run[m.end() : m.end() + 1] or after)
            if gain >= LEAST_BITS:
                parts += [run[at : m.start()], new]
                at, saved, covered = m.end(), saved + gain, covered + len(m.group())
        if parts:
            yield "".join([*parts, run[at:]]), covered, saved, "utf-8 via gb18030"

    def _swapped(self, run: str, before: str, after: str) -> Iterator[tuple[str, int, float, str]]:
        for wrong, right in OTHER:
            try:
                data = codecs.charmap_encode(run, "strict", _charmap(wrong))[0]
                new = data.decode(right)
            except UnicodeError:
                continue
            odd = len(NON_ASCII.findall(new))
            if odd < 3 or new == run or not _proper(new):
                continue
            gain = self.gain(before, run, new, after)
            if gain >= LEAST_BITS * 2 and gain / odd >= BITS_A_PAIR:
                yield new, len(NON_ASCII.findall(run)), gain, f"{right} via {wrong}"

    def repair(self, text: str | None) -> tuple[str | None, int, list[str], bool]:
        """(text, restored runs, mappings, whether characters are lost)."""
        if not text:
            return text, 0, [], False
        lost, found, names = LOST in text, 0, []
        for _ in range(ROUNDS):
            changed, parts, at = False, [], 0
            for start, end in self.runs(text):
                got = self.restored(text[max(0, start - 1) : start], text[start:end], text[end : end + 1])
                if got:
                    parts += [text[at:start], got[0]]
                    at, changed, found = end, True, found + 1
                    names.append(got[1])
            if not changed:
                break
            text = "".join([*parts, text[at:]])
        return text, found, sorted(set(names)), lost


def _proper(new: str) -> bool:
    """Whether all characters are ones that texts have, or ones of a text garbled twice."""
    return all(c >= "\x80" or c >= " " or c in "\t\n\r" for c in new) and all(unicodedata.category(c) not in ("Cn", "Co", "Cs") for c in new if c > "\xff")


def _drawn(m: re.Match, run: str) -> bool:
    """Whether a sequence is but a part of a drawing: only drawing characters, and another one right beside it."""
    beside = run[m.start() - 1 : m.start()] + run[m.end() : m.end() + 1] if m.start() else run[m.end() : m.end() + 1]
    return bool(DRAWING.search(beside)) and len(DRAWING.findall(m.group())) == len(m.group())


def _weak(old: str, gain: float) -> bool:
    """Letters alone may be a real word: they need more evidence than sequences with signs in them."""
    return gain < 2 * LEAST_BITS and len(old) <= 3 and all(c.isalpha() and c not in LETTERLIKE for c in old)


REPAIRED = "text string, runs int, mappings array<string>, lost boolean"


def repair(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, restored text, number of restored runs, mappings used, whether characters are lost."""
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(information(documents, text_col))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*model.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            done = [m.repair(t) for t in texts]
            new = [d[0] for d in done]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(new, pa.string()), pa.array([d[1] for d in done], pa.int32()), pa.array([d[2] for d in done], pa.list_(pa.string())), pa.array([d[3] for d in done], pa.bool_())],
                names=[id_col, "text", "runs", "mappings", "lost"],
            )

    chosen = documents.select(id_col, F.col(text_col).alias("text"))
    kind = chosen.schema[0].dataType.simpleString()
    return chosen.mapInArrow(work, f"`{id_col}` {kind}, {REPAIRED}")


def affected(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold a garbled passage, with their restored texts."""
    return repair(documents, id_col, text_col).filter("runs > 0 or lost")
