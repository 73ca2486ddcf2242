"""Evaluation passages inside corpus documents: q-gram lemma filter in diagonal bands, then banded alignment (problem 9).

Documents stream through once; the evaluation items, a stated query set, go along as an index of their character
q-grams, in blocks of bounded size. Nothing of the corpus is shuffled or collected.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborweft.sources.tables import load, spread

Q = 8  # characters of a q-gram
STRETCH = 15  # words of a passage that must stand together
ONE_IN = 9  # at most about one word in so many is changed or lost
MARGIN = 3  # least (words - ONE_IN * edits) of a stretch: one edit in fifteen words, two in twenty-one, three in thirty
EDITS = 3  # edits counted in one stretch: see holds_ids
BAND = 8  # word diagonals of a band; bands overlap by half
HALF = 8  # words by which an alignment may leave the middle of its band, either way
BLOCK_CHARS = 2_000_000  # of item text per pass over the documents

_INLINE = re.compile(r"</?(?:b|i|u|em|strong|code|span|a|mark|sub|sup|small|font|tt)(?:\s[^<>]{0,200})?/?>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_HIDDEN = re.compile("[­​-‏‪-‮⁠-⁤﻿]")
_LEAD = r"[ \t]*(?:(?:>+|//+!?|#+|\*+|--+|;+|%+|\||[-+•]|\(?\d{1,6}[:.)|](?=[ \t])|@[\w.-]+:)[ \t]*)*"
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐‑]\r?\n" + _LEAD + r"(?=[^\W\d_])")
_PREFIX = re.compile(r"(?m)^" + _LEAD)
_ENTITY = re.compile(r"&(?:nbsp|#160|amp|lt|gt|quot|#39|apos|shy|#173);")
#: Words; a sign of Chinese or Japanese writing, which sets no blanks, is a word of its own.
_WORD = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]|[^\W_\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]+")
# Cyrillic and Greek letters that look like Latin ones.
_ALIKE = str.maketrans("аеорсухіјѕԁһԛԝвмнткАВЕКМНОРСТУХІЈЅαοενικρτυχ", "aeopcyxijsdhqwbmhtkABEKMHOPCTYXIJSaoevikptux")
_LOOKALIKE = re.compile("[\u0370-\u052f]")


_LATIN_MARKS = re.compile("[\u0300-\u036f]+")
_FAR = re.compile("[\u0483-\u1fff\u20d0-\u20ff\u2cef-\U0010ffff]")


@lru_cache(1)
def _marks() -> re.Pattern:
    """Combining characters."""
    return re.compile("[" + "".join(c for c in map(chr, range(0x300, 0x1F000)) if unicodedata.combining(c)) + "]+")


def normal_words(text: str) -> list[str]:
    """Words in plain lower-case form: without markup, line prefixes, word breaks, hidden characters and punctuation."""
    if _HIDDEN.search(text):
        text = _HIDDEN.sub("", text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = _ENTITY.sub(" ", text)
    if "-\n" in text or "-\r\n" in text or "‐" in text or "‑" in text:
        text = _HYPHEN.sub("", text)
    text = _PREFIX.sub("", text)
    if not text.isascii():
        text = _LATIN_MARKS.sub("", unicodedata.normalize("NFKD", text))
        if _FAR.search(text):
            text = _marks().sub("", text)
        if _LOOKALIKE.search(text):
            text = text.translate(_ALIKE)
    text = text.lower().replace("'", "").replace("’", "")
    return _WORD.findall(text)


_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, Q + 1)], np.uint64)


def _packed(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all q-grams of the words joined by blanks, and the word number at each character. Eight ASCII characters are
    their own 64 bits; a q-gram with any other character is a hash of its code points with the top bit set."""
    text = " ".join(words)
    if len(text) < Q:
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    plain = text.isascii()
    raw = np.frombuffer(text.encode("ascii") if plain else text.encode("utf-32-le"), np.uint8 if plain else np.uint32)
    low = raw if plain else raw.astype(np.uint8)
    codes = np.empty(len(raw) - Q + 1, np.uint64)
    for k in range(min(Q, len(codes))):
        codes[k::Q] = low[k : k + (len(raw) - k) // Q * Q].view(np.uint64)
    if not plain:
        sums = np.concatenate([[0], np.cumsum(raw > 127)])
        at = np.flatnonzero(sums[Q:] > sums[:-Q])
        hashed = np.zeros(len(at), np.uint64)
        for k in range(Q):
            hashed += raw[at + k].astype(np.uint64) * _POWERS[k]
        codes[at] = (hashed ^ (hashed >> np.uint64(29))) | np.uint64(1 << 63)
    return codes, np.cumsum(raw == 32, dtype=np.int32)


class ItemIndex:
    """Sorted q-gram codes of a block of items, with the least number of shared q-grams a leaked stretch must have.

    Items of fewer than STRETCH words count as a whole: with fewer than ONE_IN words exactly, else with one edit. Their
    halves (or the whole) are sought by an automaton over the normal text, and the alignment decides."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.words, self.need, self.span = [], [], [], []
        self.short: dict[str, list[tuple[int, list[str], int]]] = {}  # piece -> (item id, words, first word of the piece)
        codes, item, pos, word = [], [], [], []
        for ident, text in items:
            ws = normal_words(text)
            if len(ws) < STRETCH:
                half = (len(ws) + 1) // 2 if len(ws) >= ONE_IN else len(ws)
                for k in range(0, len(ws), half or 1):
                    self.short.setdefault(f" {' '.join(ws[k : k + half])} ", []).append((ident, ws, k))
                continue
            c, at = _packed(ws)
            k = len(self.ids)
            lens = np.array([len(w) for w in ws])
            # q-gram lemma: an edit takes away the q-grams that touch the word and the blank beside it. A stretch holds a part
            # of 15 words with one edit, or of as many words as MARGIN asks for two or three
            least, widest = 10**9, 0
            for edits in range(1, EDITS + 1):
                n = max(STRETCH, ONE_IN * edits + MARGIN)
                if n > len(ws):
                    break
                for part in np.lib.stride_tricks.sliding_window_view(lens, n):
                    chars = int(part.sum()) + n - 1
                    least = min(least, chars - Q + 1 - int(np.sort(part)[-edits:].sum()) - edits * Q)
                    widest = max(widest, chars)
            self.ids.append(ident)
            self.words.append(ws)
            self.need.append(max(least, 1))
            self.span.append(widest + 120)  # words added inside, however long, are edits: three of 40 characters
            codes.append(c)
            item.append(np.full(len(c), k, np.int32))
            pos.append(np.arange(len(c), dtype=np.int32))
            word.append(at[: len(c)])
        cat = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        codes = cat(codes, np.uint64)
        order = np.argsort(codes, kind="stable")
        self.codes, self.item, self.word = codes[order], cat(item, np.int32)[order], cat(word, np.int32)[order]
        self.need, self.span = np.array(self.need, np.int64), np.array(self.span, np.int64)
        self.number = {w: i for i, w in enumerate(dict.fromkeys(w for ws in self.words for w in ws))}
        self.words = [np.array([self.number[w] for w in ws]) for ws in self.words]
        # a table of bits by a hash of the code tells most codes that no item has
        self.bits = min(25, max(16, int(len(self.codes) * 24).bit_length()))
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self._slots(self.codes)] = True
        self.automaton = None  # built by the worker: it does not travel

    def _slots(self, codes: np.ndarray) -> np.ndarray:
        return (codes * _POWERS[0]) >> np.uint64(64 - self.bits)

    def search(self, text: str) -> list[int]:
        """Ids of the items of which the text holds a stretch."""
        ws = normal_words(text)
        found = self._short_items(ws) if self.short else []
        if not len(self.codes) or len(ws) < STRETCH - EDITS:
            return found
        codes, at = _packed(ws)
        least, width = int(self.need.min()), int(self.span.max())
        hit = np.flatnonzero(self.table[self._slots(codes)])
        if len(hit) < least:
            return found
        lo = np.searchsorted(self.codes, codes[hit], "left")
        ok = self.codes[np.minimum(lo, len(self.codes) - 1)] == codes[hit]
        hit, lo = hit[ok], lo[ok]
        if len(hit) < least:
            return found
        # regions: positions whose neighbourhood holds enough q-grams that occur in any item at all
        before = np.searchsorted(hit, hit - width, "left")
        after = np.searchsorted(hit, hit + width, "right")
        near = after - before >= least
        hit, lo = hit[near], lo[near]
        if not len(hit):
            return found
        n = np.searchsorted(self.codes, codes[hit], "right") - lo
        idx = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        # items that share fewer q-grams than they need with the whole text go first: templates share some with many items
        much = np.bincount(self.item[idx], minlength=len(self.need)) >= self.need
        some = np.flatnonzero(much[self.item[idx]])
        if not len(some):
            return found
        idx, where = idx[some], np.repeat(hit, n)[some]
        # each edit moves the word diagonal by one at most, so the q-grams of one stretch lie on EDITS + 1 neighbouring
        # diagonals and therefore in one of two bands; an alignment around the band's middle reaches all of its paths
        item, diag = self.item[idx].astype(np.int64), at[where].astype(np.int64) - self.word[idx]
        done: set[int] = set()
        doc = None
        for shift in (0, BAND // 2):
            key = item * (1 << 40) + (diag + shift) // BAND + (1 << 35)
            order = np.argsort(key, kind="stable")  # positions rise already
            k, w = key[order], where[order]
            fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (w[1:] != w[:-1])])  # a position counts once per band
            k, w = k[fresh], w[fresh]
            its = k >> 40
            end = np.arange(len(k)) + self.need[its] - 1
            end_ok = np.minimum(end, len(k) - 1)
            good = (end < len(k)) & (k[end_ok] == k) & (w[end_ok] - w <= self.span[its])
            for band in np.unique(k[good]).tolist():
                it = band >> 40
                if it in done:
                    continue
                if doc is None:
                    doc = np.array([self.number.get(w, -1) for w in ws])
                if holds_ids(self.words[it], doc, ((band & ((1 << 40) - 1)) - (1 << 35)) * BAND + BAND // 2 - shift):
                    done.add(it)
                    found.append(self.ids[it])
        return found

    def _short_items(self, ws: list[str]) -> list[int]:
        """Ids of the items of fewer than STRETCH words that the words hold as a whole."""
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for piece, owners in self.short.items():
                self.automaton.add_word(piece, (len(piece), owners))
            self.automaton.make_automaton()
        text = f" {' '.join(ws)} "
        out: list[int] = []
        for end, (size, owners) in self.automaton.iter(text):
            first = None
            for ident, item, k in owners:
                if ident in out:
                    continue
                if len(item) >= ONE_IN:
                    first = text.count(" ", 0, end - size + 1) if first is None else first
                    if not _whole(item, ws[max(0, first - k - 1) : first - k + len(item) + 1]):
                        continue
                out.append(ident)
        return out


def _whole(item: list[str], part: list[str]) -> bool:
    """Whether some run of the words differs from the item by one changed, lost or added word at most."""
    n = len(item)
    for begin in range(3):
        for size in (n, n - 1, n + 1):
            run = part[begin : begin + size]
            if len(run) < size:
                continue
            same = 0
            while same < min(n, size) and item[same] == run[same]:
                same += 1
            tail = 0
            while tail < min(n, size) - same and item[n - 1 - tail] == run[size - 1 - tail]:
                tail += 1
            if same + tail >= n - 1:
                return True
    return False


_NONE = -(10**6)


def holds_ids(item: np.ndarray, doc: np.ndarray, diag: int) -> bool:
    """Banded alignment of item word i with document words i + diag - HALF to i + diag + HALF: is there a stretch of at
    least STRETCH item words with (words - ONE_IN * edits) >= MARGIN? An edit is a changed, lost or added word. Words are
    numbers; a document number below 0 equals nothing.

    First a bound: a word found nowhere in its band is an edit; if that alone leaves no stretch, nothing does. Then, cell by
    cell, the longest stretch that ends there with 0 to EDITS edits: exact, not one best path. Three edits are enough: call
    the runs of found words between edits gaps. A stretch with e edits has gaps of 8 e + 3 words in all, and where none of
    its parts meets the rule, neighbouring gaps sum to 13 at most and any three to 18 at most. Five gaps then sum to 31 of
    the 35 that four edits ask for, six to 36 of 43, and with every further edit the lack grows.
    """
    n, width = len(item), 2 * HALF + 1
    lo = diag - HALF
    seg = np.full(n + 2 * HALF, -1, doc.dtype)
    x, y = max(0, lo), min(len(doc), lo + len(seg))
    if y <= x:
        return False
    seg[x - lo : y - lo] = doc[x:y]
    same = np.lib.stride_tricks.sliding_window_view(seg, width) == item[:, None]
    if not _stretch(same.any(1)):
        return False
    prev = np.full((EDITS + 1, width), _NONE)
    cost = ONE_IN * np.arange(EDITS + 1)[:, None]
    for i in range(n):
        row = np.full((EDITS + 1, width), _NONE)
        hit = same[i]
        row[:, hit] = prev[:, hit] + 1
        row[0, hit] = np.maximum(prev[0, hit], 0) + 1  # a stretch may begin at any word that is found
        np.maximum(row[1:], prev[:-1] + 1, out=row[1:])  # changed
        np.maximum(row[1:, :-1], prev[:-1, 1:] + 1, out=row[1:, :-1])  # lost
        for e in range(1, EDITS + 1):
            np.maximum(row[e, 1:], row[e - 1, :-1], out=row[e, 1:])  # added
        if ((row >= STRETCH) & (row - cost >= MARGIN)).any():
            return True
        prev = row
    return False


def _stretch(found: np.ndarray) -> bool:
    n = len(found)
    if n < STRETCH:
        return False
    sums = np.concatenate([[0], np.cumsum(1 - ONE_IN * ~found)])
    return bool((sums[STRETCH:] - np.minimum.accumulate(sums)[: n + 1 - STRETCH]).max() >= MARGIN)


def holds(item: list[str], doc: list[str], diag: int) -> bool:
    """The same over lists of words."""
    number = {w: i for i, w in enumerate(dict.fromkeys(item))}
    return holds_ids(np.array([number[w] for w in item]), np.array([number.get(w, -1) for w in doc]), diag)


def _search(index: ItemIndex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, items = [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                hits = index.search(t) if t else ()
                docs += [d] * len(hits)
                items += hits
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int64())], names=["doc_id", "item_id"])

    return run


def leaks(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id) for each document row that holds an item's passage or a stretch of it.

    Whole texts are searched. Null and blank texts hold nothing; an item of fewer than 15 words is found where the whole of it
    stands; an item without a word is never found; a repeated document or item row gives repeated pairs. Items are read in blocks of `block_chars` characters, one pass each, so
    the index that goes to the executors has a fixed size bound whatever the number of items.
    """
    spark = docs.sparkSession
    src = spread(docs.select("doc_id", "text").filter(F.col("text").isNotNull()))
    out, block, chars = None, [], 0

    def run(part: list) -> None:
        nonlocal out
        res = src.mapInArrow(_search(ItemIndex(part)), "doc_id long, item_id long")
        out = res if out is None else out.unionByName(res)

    for r in items.select("item_id", "text").filter("text is not null and item_id is not null").toLocalIterator():
        block.append((r[0], r[1]))
        chars += len(r[1])
        if chars >= block_chars:
            run(block)
            block, chars = [], 0
    if block:
        run(block)
    return out if out is not None else spark.createDataFrame([], "doc_id long, item_id long")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p9_found: documents with the items they hold, each pair once."""
    return leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items")).distinct()


def leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaked items, with the number of documents that hold them."""
    return found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_docs"))
