"""Text quality: plain statistics as column expressions, and line labels from a hidden Markov model (problem 10).

Each line of a document is labelled prose, list, table or junk by the Viterbi path of a four-state model whose emissions
are discrete line statistics; a document is not prose when less than half of its characters stand on prose lines.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborweft.sources.tables import load, spread

# Frequent function words of English, German, French and Spanish (and a few of Italian, Portuguese, Dutch).
COMMON = tuple(
    """the a an of and to is in that it we for with but not was are as by at from this its on be or if so when than then which
our their they has have no you
der die das und ist nicht ein eine einen einem mit für auf den dem von zu es im wird sich aus nach bei dass wie wir oder aber nur
denn so diese jede vor
le la les de des du et pas un une pour dans il elle qui sur au ne se par en ce est mais ou sa son nous vous que plus avec
el los las por con para lo su al del como más y o cada sin está esta hemos
il di che non per una sono con più
não uma um os as em com
het een van niet op te dat zijn""".split()
)
_COMMON = frozenset(COMMON)

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_BULLET = re.compile(r"\s*(?:[-*+•◦–·‣]|\(?\d{1,4}[.):]|\(?[a-zA-Z][.)]|\d{1,4} -|\[[ xX]\])\s+")
_PREFIX = re.compile(r"\s*(?:>+|//+|#+(?=\s)|--|;|%|\|(?=\s)|@[\w.-]+:|\d+:(?=\s)|\*(?=\s))\s?")
_HEAD = re.compile(r"\s*#{1,6}\s+\S|\s*={3,}\s*$|\s*-{3,}\s*$")
_SET = re.compile(r"\s*[\w.\[\]()-]+\s*(?:=|->|=>|:=|→)\s*\S")
_KEYED = re.compile(r"\s*[\w.\[\]-]+\s*(?:=|->|=>|:=|→|:\s)|\s*[\w.]+\(\)?\s*->")
_VOWELS = frozenset("aeiouyäöüáéíóúàèêâîôûœæ")  # words are in lower case
_ODD = re.compile("[¤¢£¥¦§©®±¶¹²³¼½¾¿€™¬�]")  # signs that wrongly decoded text is full of
_FRONT = re.compile(r"(?!---\s*$)(?:\s*$|\s*#|\s+\S|- |[\w.\"'-][\w.\"' -]*:|[}\]])")  # lines of front matter
_FENCE = re.compile(r"\s*(?:```|~~~)")

STATES = ("prose", "list", "table", "junk")
# Emission probabilities per feature level, in the order of STATES.
_FUNCTION = ((0.03, 0.45, 0.55, 0.70), (0.12, 0.15, 0.15, 0.18), (0.25, 0.15, 0.12, 0.07), (0.60, 0.25, 0.18, 0.05))
_SHAPE = {"flow": (0.62, 0.05, 0.02, 0.12), "sentence": (0.30, 0.06, 0.02, 0.10), "plain": (0.06, 0.20, 0.05, 0.28), "bullet": (0.015, 0.55, 0.06, 0.05), "keyed": (0.004, 0.11, 0.15, 0.05), "cells": (0.001, 0.03, 0.70, 0.10)}
_NOISE = ((0.90, 0.80, 0.62, 0.25), (0.08, 0.15, 0.30, 0.30), (0.005, 0.05, 0.08, 0.45))
_REPEAT = ((0.985, 0.90, 0.90, 0.60), (0.002, 0.10, 0.10, 0.40))
_STAY, _START = 0.82, (0.30, 0.23, 0.23, 0.24)

_log = lambda t: tuple(math.log(x) for x in t)
_LF, _LS, _LN, _LR = [_log(t) for t in _FUNCTION], {k: _log(t) for k, t in _SHAPE.items()}, [_log(t) for t in _NOISE], [_log(t) for t in _REPEAT]
_SAME, _MOVE = math.log(_STAY), math.log((1 - _STAY) / 3)


def _shape(line: str, core: str, bullet: bool, n: int, share: float) -> str:
    gaps = len(re.findall(r"\S {2,}(?=\S)", core))
    pipes, tabs, commas = core.count("|"), core.count("\t"), core.count(",") + core.count(";")
    slashes = core.count(" > ") + core.count(" / ") + core.count(" » ") + core.count(" · ")
    if pipes >= 2 or tabs >= 2 or slashes >= 2:
        return "cells"
    if commas >= 3 and n / (commas + 1) < 2.6 and share < 0.3:
        return "cells"
    if gaps >= 2 and n <= 3 * (gaps + 1) and not (share >= 0.2 and gaps >= 0.6 * (n - 1)):
        return "cells"
    if core[:1] in "{[" and core.count('"') >= 4:
        return "cells"
    if bullet:
        return "bullet"
    if n < 12 and _SET.match(line):
        return "keyed"
    if _KEYED.match(line) and share < 0.25 and n < 12:
        return "keyed"
    return "sentence" if n >= 9 or (n >= 2 and core.rstrip("\"'”’»)* ")[-1:] in ".!?…") else "plain"


def _even(line: str) -> str:
    """A line whose words mostly stand two or more blanks apart evenly is text set wide, not columns."""
    wide = len(re.findall(r"\S {2}(?=\S)", line))
    return re.sub(r"(?<=\S) {2,}(?=\S)", " ", line) if wide >= 6 and wide >= 0.7 * (len(line.split()) - 1) else line


def _noise(core: str, words: list[str]) -> int:
    pieces = core.split()
    solid = sum(map(len, pieces))
    if not solid:
        return 0
    letters = sum(map(len, words))
    if not core.isascii() and len(_ODD.findall(core)) > 0.08 * solid:
        return 2
    longest = max(map(len, pieces))
    if longest > 36 and longest > 0.5 * solid and "://" not in core:
        return 2
    odd = len([w for w in words if len(w) > 3 and (len(w) > 22 or _VOWELS.isdisjoint(w))])
    if letters < 0.45 * solid or (words and odd > 0.34 * len(words)):
        return 2
    return 1 if letters < 0.72 * solid or (words and odd > 0.12 * len(words)) else 0


def _repeats(words: list[str]) -> bool:
    """Most runs of three words have been seen within the last 120 words."""
    if len(words) < 12:
        return False
    last: dict[tuple, int] = {}
    again = 0
    for i in range(len(words) - 2):
        t = (words[i], words[i + 1], words[i + 2])
        again += i - last.get(t, -999) <= 120
        last[t] = i
    return again > 0.55 * (len(words) - 2)


def label_lines(text: str) -> list[tuple[str, int]]:
    """(label, characters) of each line that counts: blank lines, headings, rules, front matter and code fences do not."""
    lines = text.split("\n")
    start = 0
    if lines and lines[0].strip() == "---":
        end = next((i for i, x in enumerate(lines[1:], 1) if not _FRONT.match(x)), len(lines))
        start = end + 1 if end < len(lines) and lines[end].strip() == "---" else 0
    blocks: list[list[str]] = [[]]
    fence = False
    for raw in lines[start:]:
        x = raw.rstrip("\r ")
        if _FENCE.match(x):
            fence = not fence
            blocks.append([])
        elif fence or not x.strip() or (_HEAD.match(x) and len(x) < 60 and not (blocks[-1] and blocks[-1][-1].lstrip()[:2] == "# ")):
            blocks.append([])
        else:
            # a long line is a paragraph of its own, and so is a run of lines with or without a mark before them
            if blocks[-1] and (len(x) > 110 or len(blocks[-1][-1]) > 110 or bool(_BULLET.match(x)) != bool(_BULLET.match(blocks[-1][-1]))):
                blocks.append([])
            blocks[-1].append(x)
    seen: dict[str, int] = {}
    obs, sizes = [], []
    for block in blocks:
        if not block:
            continue
        marks = [bool(_BULLET.match(x)) for x in block]
        block = [_even(x) for x in block]
        cores = [_PREFIX.sub("", _BULLET.sub("", x, count=1) if m else x, count=1).strip() for x, m in zip(block, marks)]
        words = [_WORD.findall(c.lower()) for c in cores]
        width = max(map(len, block))
        fits = [len(block[i]) + 1 + len(cores[i + 1].split(" ", 1)[0]) > width - 1 for i in range(len(block) - 1)]
        flow = len(block) >= 3 and sum(fits) >= 0.85 * len(fits) or len(block) == 2 and fits[0] and not marks[0] and cores[0][-1:] not in ".!?:;"
        hits = [len([w for w in ws if w in _COMMON]) for ws in words]
        repeated = _repeats([w for ws in words for w in ws])
        for i, (x, core) in enumerate(zip(block, cores)):
            lo, hi = (max(0, i - 2), i + 3) if flow else (i, i + 1)
            n = sum(len(ws) for ws in words[lo:hi])
            share = sum(hits[lo:hi]) / n if n else 0.0
            noise = _noise(core, words[i])
            if noise == 2:
                share = 0.0  # stray letters are no words
            shape = _shape(x, core, marks[i], len(words[i]), share)
            if flow and share > 0.05 and (shape in ("bullet", "sentence", "plain") or shape == "keyed" and not _SET.match(x)):
                shape = "flow"
            level = 0 if share == 0 else 1 if share < 0.13 else 2 if share < 0.22 else 3
            times = seen[core] = seen.get(core, 0) + 1
            again = repeated or (times > 2 and len(core) > 3)
            obs.append((level, shape, noise, int(again)))
            sizes.append(len(core))
    if not obs:
        return []
    score, back = None, []
    for level, shape, noise, again in obs:
        emit = [_LF[level][s] + _LS[shape][s] + _LN[noise][s] + _LR[again][s] for s in range(4)]
        if score is None:
            score = [math.log(_START[s]) + emit[s] for s in range(4)]
            continue
        new, come = [], []
        best = max(range(4), key=lambda s: score[s])
        for s in range(4):
            stay, move = score[s] + _SAME, score[best] + _MOVE
            come.append(s if stay >= move or best == s else best)
            new.append(max(stay, move) + emit[s])
        score = new
        back.append(come)
    path = [max(range(4), key=lambda s: score[s])]
    for come in reversed(back):
        path.append(come[path[-1]])
    return [(STATES[s], n) for s, n in zip(reversed(path), sizes)]


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = {s: [] for s in STATES}
        total = []
        for text in b.column(1).to_pylist():
            sums = dict.fromkeys(STATES, 0)
            for s, n in label_lines(text or ""):
                sums[s] += n
            all_ = sum(sums.values())
            total.append(all_)
            for s in STATES:
                out[s].append(round(sums[s] / all_, 6) if all_ else 0.0)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(out[s], pa.float64()) for s in STATES), pa.array(total, pa.int64())], names=["doc_id", *(f"{s}_share" for s in STATES), "n_counted"])


def line_shares(docs: DataFrame) -> DataFrame:
    """doc_id, prose_share, list_share, table_share, junk_share, n_counted per row of `docs` (doc_id, text): shares of the
    counted characters. Null, empty and blank texts have n_counted 0 and all shares 0. Whole texts are read, however long;
    large scans are not shuffled. Other columns of docs are not read."""
    return spread(docs.select("doc_id", "text")).mapInArrow(_shares, "doc_id long, prose_share double, list_share double, table_share double, junk_share double, n_counted long")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p10_found: documents of which less than half is prose; a document without any counted line is one of them."""
    return line_shares(load(spark, sf_dir, "documents")).filter("prose_share < 0.5").select("doc_id").distinct()


_TOKEN = re.compile(r"[^ \t\n\r]+")
_KNOWN = re.compile(r"[^\W_]+|[ \t\n\r]+")
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_POINT = re.compile(r"[.!?:;…][\"')\]”’»]*[ \t]*\Z")
_COUNTS = ("n_words", "n_word_chars", "n_chars", "n_symbols", "n_lines", "n_punct", "n_common")


def count_text(t: str) -> tuple[int, ...]:
    """The numbers behind the statistics of one text, in the order of _COUNTS."""
    ws = _TOKEN.findall(t)
    common = sum((w.lower() if w.isalpha() else _EDGE.sub("", w.lower())) in _COMMON for w in ws)
    lines = [x for x in re.split("[\n\r]+", t) if x.strip(" ")]
    return len(ws), sum(map(len, ws)), len(t), len(_KNOWN.sub("", t)), len(lines), sum(_POINT.search(x) is not None for x in lines), common


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [count_text(t or "") for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(_COUNTS)))], names=["doc_id", *_COUNTS])


def stats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, mean_word_len, symbol_ratio, punct_line_share, common_share; large scans are not shuffled.

    Null text counts as ''. Ratios are 0 where nothing is counted. Words are runs without white space; common words are
    compared in lower case without the marks around them; symbols are characters that are no letter, digit or white space.
    One Arrow function counts: a set of common words costs a look-up a word there, a scan of the list in an expression.
    """
    t = spread(docs.select("doc_id", "text")).mapInArrow(_count, "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(F.lit(0.0))
    return t.select("doc_id", "n_words", ratio("n_word_chars", "n_words").alias("mean_word_len"), ratio("n_symbols", "n_chars").alias("symbol_ratio"), ratio("n_punct", "n_lines").alias("punct_line_share"), ratio("n_common", "n_words").alias("common_share"))


def stats_sql() -> str:
    common = "[" + ", ".join("'" + c.replace("'", "''") + "'" for c in COMMON) + "]"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda x: x <> '') AS w,
 list_filter(regexp_split_to_array(coalesce(text, ''), '[\\n\\r]+'), lambda x: trim(x, ' ') <> '') AS l FROM documents)
SELECT doc_id, len(w) AS n_words,
 CASE WHEN len(w) > 0 THEN round(list_sum(list_transform(w, lambda x: length(x)))::DOUBLE / len(w), 6) ELSE 0.0 END AS mean_word_len,
 CASE WHEN length(t) > 0 THEN round(length(regexp_replace(t, '[\\p{{L}}\\p{{N}} \\t\\n\\r]', '', 'g'))::DOUBLE / length(t), 6) ELSE 0.0 END AS symbol_ratio,
 CASE WHEN len(l) > 0 THEN round(len(list_filter(l, lambda x: regexp_matches(x, '[.!?:;…]["'')\\]”’»]*[ \\t]*$')))::DOUBLE / len(l), 6) ELSE 0.0 END AS punct_line_share,
 CASE WHEN len(w) > 0 THEN round(len(list_filter(list_transform(w, lambda x: regexp_replace(lower(x), '^[^\\p{{L}}]+|[^\\p{{L}}]+$', '', 'g')), lambda x: list_contains({common}, x)))::DOUBLE / len(w), 6) ELSE 0.0 END AS common_share
FROM d"""
