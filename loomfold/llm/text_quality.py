"""Statistics of a text by which natural prose is told from lists, tables and junk.

Counted per text: words, their mean length, shares of symbols, digits, of lines
that end in punctuation, of common words, and how readable the characters are.
Layout: how far the delimiters of a line stand where those of its neighbours
stand (by number and by column), at which lag the indentation repeats, how the
lengths of lines agree with those one, two and three lines on, how full lines are.

A logistic model weighs all of them at once, each with its square, so that no
single count switches the kind.  Its weights lie in ``text_quality.json``; ``fit``
makes them from labelled texts.  They were fitted on at most ``SAMPLE`` pages,
stretches of pages and some strings of random signs (junk); the pages were
labelled by an earlier set of rules.  How many lines or
characters a text has is no feature, so a page of any size is treated alike.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfold.llm.canonical_form import _OTHER, LOOK_ALIKES, plain_form

#: Labelled texts that the model is fitted on, at most.
SAMPLE = 40_000
#: Frequent words of running text in both languages.
COMMON_ENGLISH = frozenset(
    "the of and a an to in is are was be that it its for on with as by at from this these those which or each every any some one both has have not when while what how under over between within through during before after"
    .split()
)
COMMON_THAI = ("และ", "หรือ", "ของ", "ที่", "ใน", "การ", "ให้", "เป็น", "จาก", "โดย", "เพื่อ", "ซึ่ง", "ทั้ง", "อย่าง", "ได้", "ตาม", "หลังจาก", "รวมทั้ง", "ตลอดจน", "เมื่อ", "หาก", "สำหรับ")
_COMMON_THAI = re.compile("|".join(COMMON_THAI))
#: Signs that set cells apart: how often each stands in a stripped line.
DELIMITERS = {
    "tab": lambda x: x.count("\t"),
    "bar": lambda x: x.count("│") + x.count("|") + x.count("┃") + x.count("¦") + x.count("║"),
    "gap": lambda x: len(_GAP.findall(x)) if "  " in x else 0,
    "comma": lambda x: x.count(",") - x.count(", "),
    "semicolon": lambda x: x.count(";"),
    "slash": lambda x: x.count(" / "),
    "dot": lambda x: x.count(" · "),
    "caret": lambda x: x.count("^") + x.count("~"),
}
_GAP = re.compile(r"(?<=\S) {2,}(?=\S)")
_CELL = re.compile(r"\S(?: {2,}|\t|[|│┃¦║])(?=\s*\S)")
_WORD = re.compile(r"[A-Za-z]+(?:[-'’][A-Za-z]+)*|[ก-๛]+|\d+")
_LATIN = re.compile("[A-Za-z]+")
_RULE = re.compile(r"[\s─━═\-=_+|│┼├┤┬┴~*.]*")
_NUMBER = re.compile(
    r"(?:[-–~\[(]?\s*(?:(?:page|p\.?|หน้า|หน้าที่)\s*)?(?:\d{1,4}|[๐-๙]{1,4}|[ivxlc]{1,7})(?:\s*(?:/|of|จาก|ของ)\s*(?:\d{1,4}|[๐-๙]{1,4}))?\s*[-–~\])]?)", re.I
)
_SHOWN = str.maketrans(LOOK_ALIKES)
_CID = re.compile(r"\(cid:\d+\)")
_STOP = re.compile(r"[.!?…ฯ:;]['\"”’)\]]*$")
#: Longest mean cell of a row, in characters.
CELL = 45
#: Lags of indentation and of line lengths, and characters from which a line counts as long.
LAGS, LONG = (1, 2, 3, 4), 70
KINDS = ("prose", "list", "table", "junk")
#: The features in the order of the weights.
FEATURES = (
    "table_share", "column_share", "cells_share", "length_lag_1", "length_lag_2", "length_lag_3", "indent_lag_1", "indent_periodicity", "indent_share", "line_length", "line_spread", "line_variation", "full_share", "line_median", "line_longest",
    "mean_word_length", "words_a_line", "symbol_ratio", "digit_ratio", "stop_line_share", "common_word_share", "running_share", "running_twice_share", "long_line_share", "readable_share", "digit_end_share", "capital_share", "small_share", "letter_end_share", "odd_word_share", "alike_start_share", "alike_end_share", "alike_values_share",
)


def _kinds() -> np.ndarray:
    """For each code point: 1 letter of either language or digit, 2 ordinary punctuation, 3 another Latin letter, 4 white space."""
    table = np.zeros(0x110000, dtype=np.uint8)
    table[[ord(c) for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = 1
    table[0x0E01:0x0E5C] = 1
    table[[ord(c) for c in ".,;:()\"'“”/-"]] = 2
    table[0xC0:0x250] = 3
    table[[0xD7, 0xF7]] = 0
    table[[c for c in range(0x3001) if chr(c).isspace()]] = 4
    return table


_TABLE = _kinds()
_DRAWN = re.compile(r"([.·…‥_\-=─━═│┃|+*])(?:\s?\1)+")
_BARS = str.maketrans("", "", "│┃|")
_MANGLED = re.compile(r"à[¸¹]|[ÐØß÷×þðæ]{3}")


def readable_share(text: str) -> float:
    """The share of the signs that are letters of either language, digits or (half) ordinary
    punctuation, where lines and leaders drawn of dots and dashes count for nothing."""
    t = _CID.sub("\ufffe\ufffe\ufffe", text) if "(cid:" in text else text
    t = _DRAWN.sub("", t).translate(_BARS) if not t.isalnum() and _DRAWN.search(t) else t.replace("|", "").replace("│", "")
    n = np.bincount(_TABLE[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)], minlength=5)
    solid = int(n[:4].sum())
    if not solid:
        return 1.0 if text.strip() else 0.0
    return float((n[1] + (n[3] if n[3] and not _MANGLED.search(t) else 0) + 0.5 * n[2]) / solid)


_ALNUM = re.compile(r"[A-Za-z0-9]{3,}")
_VOWEL = re.compile("[aeiouyAEIOUY]")
_DIGITS, _LETTERS = re.compile(r"[\d๐-๙]+"), re.compile("[A-Za-zก-๛]+")


def odd_word_share(text: str) -> float:
    """Share of the words with Latin letters that mix letters and digits or have no vowel."""
    words = [w for w in _ALNUM.findall(text) if not w.isdigit()]
    return sum(not w.isalpha() or not _VOWEL.search(w) for w in words) / len(words) if words else 0.0


def alike_start_share(lines: list[str]) -> float:
    """Share of the lines that begin with a sign or number, as a line beside them does."""
    start = [_LETTERS.sub("a", _DIGITS.sub("9", x.split(" ", 1)[0][:12]))[:4] for x in lines]
    return sum(s != "a" and s in (start[i - 1] if i else "", start[i + 1] if i + 1 < len(start) else "") for i, s in enumerate(start)) / len(start) if start else 0.0


def alike_end_share(lines: list[str]) -> float:
    """Share of the lines that end in a number or sign of the form that ends a line beside them."""
    end = [_LETTERS.sub("a", _DIGITS.sub("9", x.rsplit(" ", 1)[-1][-16:])) for x in lines]
    return sum("9" in s and s in (end[i - 1] if i else "", end[i + 1] if i + 1 < len(end) else "") for i, s in enumerate(end)) / len(end) if end else 0.0


def alike_values_share(lines: list[str]) -> float:
    """Share of the lines with words that hold digits, as many as a line beside them has."""
    held = [sum(bool(_DIGITS.search(w)) for w in x.split()) for x in lines]
    return sum(k > 0 and k in (held[i - 1] if i else 0, held[i + 1] if i + 1 < len(held) else 0) for i, k in enumerate(held)) / len(held) if held else 0.0


def body_lines(text: str) -> list[str]:
    """Lines that are neither blank, nor drawn rules, nor page numbers alone."""
    return [x for x in text.splitlines() if x.strip() and not _RULE.fullmatch(x) and not _NUMBER.fullmatch(x.strip())]


def _delimited(lines: list[str]) -> tuple[float, str]:
    """The delimiter that makes rows of three or more cells of most neighbouring lines, and its
    share of the lines: a row counts when a line beside it has about as many cells."""
    best = (0.0, "")
    bare = [x.strip().strip("|│¦") for x in lines]
    for name, count in DELIMITERS.items():
        cells = [count(x) + 1 for x in bare]
        if max(cells) < 3:
            continue
        cells = [c if len(x) <= CELL * c else 1 for c, x in zip(cells, lines, strict=True)]
        rows = sum(
            1 for i, c in enumerate(cells)
            if c >= 3 and any(0 <= j < len(cells) and abs(cells[j] - c) <= 1 for j in (i - 1, i + 1))
        )
        share = rows / len(lines)
        if share > best[0]:
            best = (share, name)
    return best


def _columns(lines: list[str]) -> tuple[float, float]:
    """How far the cells of a line begin where those of a neighbour do, give or take one character, on the mean; and
    the share of lines with three or more cells."""
    starts = [{m.end() for m in _CELL.finditer(x)} for x in lines]
    met = 0.0
    for i, own in enumerate(starts):
        if own:
            near = {p + d for j in (i - 1, i + 1) if 0 <= j < len(starts) for p in starts[j] for d in (-1, 0, 1)}
            met += len(own & near) / len(own)
    return met / len(lines), sum(len(c) >= 2 for c in starts) / len(lines)


def autocorrelation(values: Sequence[float], lag: int = 1) -> float:
    """Of values ``lag`` apart, from -1 to 1; 0 where there are fewer than two such pairs or all are equal."""
    if len(values) < max(3, lag + 2):
        return 0.0
    v = np.asarray(values, dtype=float)
    v = v - v.mean()
    d = float(v @ v)
    return float(v[:-lag] @ v[lag:]) / d if d > 1e-9 else 0.0


def _quantile(ordered: list[int], q: float) -> float:
    """Of sorted values, between two of them in proportion."""
    at = q * (len(ordered) - 1)
    i = int(at)
    return ordered[i] + (at - i) * (ordered[min(i + 1, len(ordered) - 1)] - ordered[i])


def measure(text: str) -> dict[str, float | int | str]:
    """All statistics of one whole text; see ``SCHEMA``.  The text is taken in its plain
    character form, so that look-alike letters count as the letters they show."""
    return kinds_of([_measured(text)])[0]


def _measured(text: str) -> dict[str, float | int | str]:
    size = len(text)
    if _OTHER.search(text):
        text = plain_form(text).translate(_SHOWN)
    lines = body_lines(text)
    n = len(lines)
    bare = [x.strip() for x in lines]
    words = _WORD.findall(text)
    solid = "".join(text.split())
    letters = sum(map(len, words))
    common = [sum(w.lower() in COMMON_ENGLISH for w in _LATIN.findall(s)) + len(_COMMON_THAI.findall(s)) for s in bare]
    indents = [len(x) - len(x.lstrip()) for x in lines]
    sizes = [len(x.rstrip()) for x in lines] or [0]
    lengths, ordered = np.array(sizes, dtype=float), sorted(sizes)
    mean_length, spread, width = float(lengths.mean()), float(lengths.std()), _quantile(ordered, 0.9)
    chars = max(1, sum(map(len, bare)))
    table, sign = _delimited(lines) if lines else (0.0, "")
    column, cells = _columns(lines) if lines else (0.0, 0.0)
    lags = [autocorrelation(indents, k) for k in LAGS]
    mean = lambda many: sum(many) / n if n else 0.0
    part = lambda many: sum(len(s) for s, ok in zip(bare, many, strict=True) if ok) / chars
    out = {
        "n_chars": size, "n_words": len(words), "n_lines": n, "delimiter": sign,
        "table_share": table, "column_share": column, "cells_share": cells,
        "length_lag_1": autocorrelation(lengths, 1), "length_lag_2": autocorrelation(lengths, 2), "length_lag_3": autocorrelation(lengths, 3),
        "indent_lag_1": lags[0], "indent_periodicity": max(lags), "indent_share": mean([i > 0 for i in indents]),
        "line_length": mean_length / 100, "line_spread": spread / 100, "line_variation": spread / (mean_length + 1),
        "full_share": mean([k >= 0.8 * width for k in sizes]), "line_median": _quantile(ordered, 0.5) / 100, "line_longest": min(ordered[-1], 400) / 100,
        "mean_word_length": letters / len(words) if words else 0.0, "words_a_line": len(words) / max(1, n) / 10,
        "symbol_ratio": 1 - letters / len(solid) if solid else 0.0, "digit_ratio": sum(map(str.isdigit, solid)) / max(1, len(solid)),
        "stop_line_share": mean([bool(_STOP.search(s)) for s in bare]), "common_word_share": 10 * sum(common) / max(1, letters),
        "running_share": part([c >= 1 for c in common]), "running_twice_share": part([c >= 2 for c in common]), "long_line_share": part([len(s) > LONG for s in bare]),
        "readable_share": readable_share(text), "digit_end_share": mean([s[-1].isdigit() for s in bare]), "capital_share": mean([s[0].isupper() for s in bare]),
        "small_share": mean([s[0].islower() for s in bare]), "letter_end_share": mean([s[-1].isalpha() for s in bare]), "odd_word_share": odd_word_share(text), "alike_start_share": alike_start_share(bare),
        "alike_end_share": alike_end_share(bare), "alike_values_share": alike_values_share(bare),
    }
    return out | {"blank": not solid}


def _terms(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """The features in units of their spread, within four of them, their squares, and a constant."""
    z = np.clip((x - mean) / spread, -4, 4)
    return np.concatenate([z, z * z, np.ones((*z.shape[:-1], 1))], axis=-1)


def fit(features: np.ndarray, kinds: Sequence[str], steps: int = 3_000, rate: float = 0.3, shrink: float = 3e-5) -> dict[str, list]:
    """Weights of the logistic model from labelled texts, by descent with momentum; a random ``SAMPLE`` of more."""
    x, y = np.asarray(features, dtype=float), np.array([KINDS.index(k) for k in kinds])
    if len(x) > SAMPLE:
        at = np.random.RandomState(0).permutation(len(x))[:SAMPLE]
        x, y = x[at], y[at]
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-3)
    a, target = _terms(x, mean, spread), np.eye(len(KINDS))[y]
    w = np.zeros((a.shape[1], len(KINDS)))
    v = np.zeros_like(w)
    for _ in range(steps):
        p = np.exp((s := a @ w) - s.max(1, keepdims=True))
        v = 0.9 * v - rate * (a.T @ (p / p.sum(1, keepdims=True) - target) / len(a) + shrink * w)
        w += v
    return {"mean": mean.round(5).tolist(), "spread": spread.round(5).tolist(), "weights": (w - w[:, :1]).T[1:].round(3).tolist()}


_MODEL = {k: np.array(v) for k, v in json.loads((Path(__file__).parent / "text_quality.json").read_text()).items()}


def kinds_of(many: list[dict]) -> list[dict]:
    """The statistics of texts with their ``kind``: ``blank``, or whichever of ``KINDS`` the model finds likeliest."""
    if not many:
        return []
    scores = _terms(np.array([[m[f] for f in FEATURES] for m in many]), _MODEL["mean"], _MODEL["spread"]) @ _MODEL["weights"].T
    best = np.concatenate([np.zeros((len(many), 1)), scores], axis=1).argmax(1)
    return [{k: v for k, v in m.items() if k != "blank"} | {"kind": "blank" if m["blank"] else KINDS[i]} for m, i in zip(many, best, strict=True)]


SCHEMA = {"n_chars": pa.int32(), "n_words": pa.int32(), "n_lines": pa.int32(), "delimiter": pa.string()} | dict.fromkeys(FEATURES, pa.float64()) | {"kind": pa.string()}
_DDL = ", ".join(f"{k} {'int' if t == pa.int32() else 'double' if t == pa.float64() else 'string'}" for k, t in SCHEMA.items())


def text_statistics(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, ...)`` with the columns of ``SCHEMA``, one row for each row; null counts as
    empty, and empty or blank texts are of kind ``blank``.  Other columns are not read."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = kinds_of([_measured(t or "") for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([m[k] for m in found], t) for k, t in SCHEMA.items())], [key, *SCHEMA])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, {_DDL}")


def beside_stored(stats: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """The statistics beside the stored scores of the same key: repeated stored rows are
    reduced to the one with the most characters, values out of range become null,
    ``stored_stale`` tells a stored length that is not the text's."""
    one = stored.groupBy(key).agg(F.max(F.struct(F.coalesce("extracted_char_count", F.lit(-1)).alias("n"), "extracted_char_count", "out_of_charset_ratio", "domain_lexicon_match_count")).alias("s"))
    ratio = F.col("s.out_of_charset_ratio")
    return stats.join(one, key, "left").select(
        stats["*"], F.col("s.extracted_char_count").alias("stored_char_count"),
        F.when((ratio >= 0) & (ratio <= 1), ratio).alias("stored_out_of_charset_ratio"),
        F.when(F.col("s.domain_lexicon_match_count") >= 0, F.col("s.domain_lexicon_match_count")).alias("stored_lexicon_count"),
        (F.col("s.extracted_char_count") != F.col("n_chars")).alias("stored_stale"),
    )
