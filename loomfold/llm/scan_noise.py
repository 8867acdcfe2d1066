"""Repair of text read from scanned pages into continuous paragraphs.

A noisy channel: what a line shows is a word sent through character
confusions.  The words and their neighbours are counted over all pages with a
text layer; a word gets the known words that the confusions may have turned
into it as candidates, and Viterbi over the candidates of the
line picks the likeliest: confusion probabilities times word-pair likelihood.
The probabilities are counted over all scanned texts, on the words that only one
known word explains.  Frequent words and pairs are sent to every task; readings
that none of them explains are joined with the table of all words.  Words divided between lines are joined when the joined word is likelier than
its parts.  The head of a document is the line that comes back at the edges of
its pages; page numbers are looked for at the edges too.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfold.llm.canonical_form import LOOK_ALIKES, plain_form
from loomfold.sources.shared import checkpoint

#: What the engines take Latin letters for (shown form, true form).
LATIN_CONFUSIONS = [
    ("c", "e"), ("f", "t"), ("b", "h"), ("0", "o"), ("1", "i"), ("1", "l"), ("I", "l"), ("|", "l"), ("|", "i"), ("l", "i"), ("5", "s"),
    ("@", "a"), ("9", "g"), ("ii", "u"), ("1i", "u"), ("i1", "u"), ("11", "u"), ("rn", "m"), ("m", "rn"), ("vv", "w"), ("d", "cl"), ("8", "b"), ("6", "b"), ("2", "z"),
]
#: Letters that stand for digits in course codes.
DIGIT_CONFUSIONS = str.maketrans({"O": "0", "o": "0", "Q": "0", "I": "1", "l": "1", "|": "1", "i": "1", "Z": "2", "z": "2", "S": "5", "s": "5", "b": "6", "G": "6", "B": "8", "g": "9", "q": "9"})
#: Thai letters that the engines take for each other, as classes.
THAI_CLASSES = ["าๅ", "รธ", "กถ", "ชซ", "บษ", "คดตศ", "พฟ", "ฉณ", "ีิ", "ฎฏ"]
#: Probability of a confusion before any is counted, and the number of letters that this counts for.
P_CONFUSION, PRIOR = 0.01, 200
#: Words rarer than this share of all are looked up in the table of all words where a reading needs them, pairs rarer than theirs
#: count as pairs that were never met: what is sent to every task has at most 1 / share entries, whatever the corpus.
WORD_SHARE, PAIR_SHARE = 1e-4, 5e-6
#: Readable words a text is credited with when its share of junk is taken.
READABLE = 20
#: Lines at either end of a page in which heads and page numbers are looked for.
EDGE = 3
#: Least length of a head, and likeness (of pairs of characters) by which a line repeats it.
HEAD_LENGTH, HEAD_LIKENESS = 12, 0.6

#: Thai letters by class, in the one-byte Thai code: a place in the bytes is a place in the text.
_THAI = bytes.maketrans(*("".join(x).encode("cp874") for x in zip(*((c, group[0]) for group in THAI_CLASSES for c in group), strict=True)))
_LATIN_WORD = re.compile(r"(?<![A-Za-z0-9\-])[A-Za-z]+(?:-[A-Za-z]+)*(?![A-Za-z0-9\-])")
_TOKEN = re.compile(r"[A-Za-z0-9@|]+(?:-[A-Za-z0-9@|]+)*")
_WORDY = re.compile(r"(?=[0-9|]*[A-Za-z@])[A-Za-z0-9@|]+(?:-[A-Za-z0-9@|]+)*")
_CODE = re.compile(r"(?<![A-Za-z0-9|])[0-9OoQIl|iZzSsbGBgq]{8}(?![A-Za-z0-9|])")
_ODD = re.compile(r"[a-z]\d|\d[a-z]")
_FOREIGN = re.compile(r"[^\x00-\x7f฀-๿]")
_LATIN_LETTER = re.compile("[A-Za-zＡ-ｚͰ-ϿЀ-ԯ]")
_TAIL = re.compile(r"([A-Za-z0-9@|]+(?:-[A-Za-z0-9@|]+)*)([-–—‐‑¬~=\xad]?)[ \t]*$")
_ENDS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789@|-–—‐‑¬~=\xad")
_START = re.compile(r"[ \t]*([A-Za-z0-9@|]+(?:-[A-Za-z0-9@|]+)*)")
_TABLE = re.compile(r"[│|\t]|\S {2,}\S|,\S")
_SIGNS = re.compile(r"[│|\t]|\S {2,}\S")
_NUMBER_FORMS = re.compile(
    r"(?:\[\s*{n}\s*\]|[-–~]\s*{n}\s*[-–~]|หน้า(?:ที่)?\s*{n}(?:\s*(?:จาก|/)\s*{n})?|[Pp]age\s*{n}(?:\s*(?:of|/)\s*{n})?|{n}\s*/\s*{n}|{n}|\(\s*{n}\s*\))".replace("{n}", r"(?:[\dOoIlS|]{1,4}|[๐-๙]{1,4})")
)
_SHOWN = str.maketrans(LOOK_ALIKES)


def shape(shown: str) -> str:
    """The same for all readings that differ by confusions of single letters."""
    return shown.replace("I", "l").lower().translate(_SKELETON)


def shapes(word: str) -> set[str]:
    """The shapes of all readings of a word: confusions of several letters each taken or not."""
    forms = {""}
    i = 0
    ends: dict[int, set[str]] = {0: forms}
    for i in range(len(word)):
        here = ends.pop(i, set())
        ends.setdefault(i + 1, set()).update(f + word[i] for f in here)
        for shown, true in LATIN_CONFUSIONS:
            if len(shown) + len(true) > 2 and word.startswith(true, i):
                ends.setdefault(i + len(true), set()).update(f + shown for f in here)
    return {shape(f) for f in ends.get(len(word), ())}


_SKELETON = str.maketrans({"e": "c", "t": "f", "h": "b", "o": "0", "i": "1", "l": "1", "|": "1", "s": "5", "a": "@", "g": "9", "8": "b", "6": "b", "z": "2"})


def channel(shown: str, word: str, cost: Mapping[tuple[str, str], float] | None = None) -> float:
    """Log probability that ``word`` shows as ``shown``: the likeliest way through the confusions."""
    return _way(shown, word, cost)[0]


def _way(shown: str, word: str, cost: Mapping[tuple[str, str], float] | None = None) -> tuple[float, list[tuple[str, str]]]:
    """The log probability of the likeliest way from ``word`` to ``shown``, and its confusions."""
    a, b = shown, word
    plain = math.log(P_CONFUSION)
    best: dict[tuple[int, int], tuple[float, list[tuple[str, str]]]] = {(0, 0): (0.0, [])}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            here = best.get((i, j))
            if here is None:
                continue
            p, used = here
            steps = []
            if i < len(a) and j < len(b) and a[i].lower() == b[j]:
                steps.append((1, 1, 0.0 if a[i] == b[j] or i == 0 else plain, None))
            for x, y in LATIN_CONFUSIONS:
                if (a.startswith(x, i) or a[i : i + len(x)].lower() == x and i == 0) and b.startswith(y, j):
                    steps.append((len(x), len(y), cost.get((x, y), plain) if cost else plain, (x, y)))
            for di, dj, q, what in steps:
                at = (i + di, j + dj)
                if at not in best or best[at][0] < p + q:
                    best[at] = (p + q, [*used, what] if what else used)
    return best.get((len(a), len(b)), (-1e9, []))


def thai_form(text: str) -> bytes:
    """One byte for each character, the same for Thai letters of one class."""
    return text.encode("cp874", "replace").translate(_THAI)


@dataclass
class Model:
    """Words and pairs with their counts, and the share of each word's capitals."""

    words: dict[str, int]
    pairs: dict[tuple[str, str], int]
    capital: dict[str, float]
    thai: list[str] = field(default_factory=list)
    cost: dict[tuple[str, str], float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.total = sum(self.words.values()) or 1
        self.plain: set[str] = set()
        self.by_form: dict[str, list[str]] = defaultdict(list)
        for w in self.words:
            self._learn_form(w)
        self.terms = [(t, thai_form(t)) for t in self.thai]
        self.kept: dict[str, list[tuple[str, float]]] = {}

    def _learn_form(self, w: str) -> None:
        self.plain |= {w, w[0].upper() + w[1:]}
        for f in shapes(w):
            self.by_form[f].append(w)
            if len(self.by_form[f]) > 1:
                # these can be taken for each other, so seeing one does not settle it
                self.plain.difference_update(x for v in self.by_form[f] for x in (v, v[0].upper() + v[1:]))

    def know(self, more: Iterable[Mapping]) -> None:
        """Adds rare words of the corpus that a text may hold.  They are words like all others: what a text gives does not depend on them
        unless it has a reading of their shape, and then it brings them along."""
        for r in more:
            if r["word"] not in self.words:
                self.words[r["word"]] = r["n"]
                self.capital[r["word"]] = r["capital"]
                self._learn_form(r["word"])
                self.kept.clear()

    def likely(self, before: str | None, word: str) -> float:
        """Log probability of a word after another, mixed with its own."""
        own = (self.words.get(word, 0) + 0.01) / (self.total + 1)
        if before not in self.words:
            return math.log(own)
        return math.log(0.9 * self.pairs.get((before, word), 0) / self.words[before] + 0.1 * own)

    def candidates(self, shown: str) -> list[tuple[str, float]]:
        """Known words with the log probability to be shown so; a known word is read as itself or, by confusion, as another."""
        if shown not in self.kept:
            low = shown.lower()
            found = [(low, 0.0)] if low in self.words else []
            found += [(w, p) for w in self.by_form.get(shape(shown), ()) if w != low and (p := channel(shown, w, self.cost)) > -1e8]
            if len(self.kept) > 100_000:
                self.kept.clear()
            self.kept[shown] = found
        return self.kept[shown]

    def cased(self, shown: str, word: str) -> str:
        """``word`` with a capital where the reading has one, or where it is usual and the reading cannot tell."""
        first = shown[0]
        if first.lower() == word[0]:
            capital = first.isupper()
        else:
            capital = self.capital.get(word, 0.0) > 0.5
        return word[0].upper() + word[1:] if capital else word

    def decode(self, shown: list[str]) -> list[str | None]:
        """The likeliest words of a line, by Viterbi; None where a word has no candidate."""
        columns = [self.candidates(s) or [(None, 0.0)] for s in shown]
        back: list[list[int]] = []
        score = [0.0]
        last: list[str | None] = [None]
        for col in columns:
            now, come = [], []
            for w, p in col:
                ways = [s + (self.likely(b, w) if w else 0.0) for s, b in zip(score, last, strict=True)]
                k = max(range(len(ways)), key=ways.__getitem__)
                now.append(ways[k] + p)
                come.append(k)
            back.append(come)
            score, last = now, [w for w, _ in col]
        if not columns:
            return []
        k = max(range(len(score)), key=score.__getitem__)
        out: list[str | None] = []
        for col, come in zip(reversed(columns), reversed(back), strict=True):
            out.append(col[k][0])
            k = come[k]
        return out[::-1]


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        keys = list(held)
        b = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([held[k] for k in keys], pa.int64())], ["a", "b", "n"])
        held.clear()
        return b

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if not _LATIN_LETTER.search(text):
                continue
            for line in text.split("\n"):
                if not _LATIN_LETTER.search(line):
                    continue
                if _FOREIGN.search(line):
                    line = plain_form(line).translate(_SHOWN)
                before, end = None, -9
                for m in _LATIN_WORD.finditer(line):
                    w = m.group()
                    low = w.lower()
                    held["", w] += 1
                    if before and m.start() == end + 1:
                        held[before, low] += 1
                    before, end = low, m.end()
        if len(held) > 200_000:
            yield out()
    if held:
        yield out()


def learn(clean: DataFrame, terms: DataFrame, scans: DataFrame) -> tuple[Model, DataFrame]:
    """The model from all texts of ``clean`` (column ``text``), the Thai ``term`` of a fixed list and the scanned
    texts ``scans`` (``src, item_id, text``); and ``(src, item_id, rare)``, the rare words that readings of a scanned text may stand for."""
    counts = checkpoint(clean.select("text").filter("text <> ''").mapInArrow(_count, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n")))
    single = F.col("a") == ""
    sums = counts.groupBy(single.alias("single")).agg(F.sum("n").alias("total"))
    total = {r.single: r.total for r in sums.collect()}  # two numbers
    words = counts.filter(single).groupBy(F.lower("b").alias("word")).agg(F.sum("n").alias("n"), (F.sum(F.when(F.substring("b", 1, 1).rlike("[A-Z]"), F.col("n")).otherwise(0)) / F.sum("n")).alias("capital"))
    least = WORD_SHARE * total.get(True, 0)
    known = words.filter(F.col("n") >= least).collect()
    pairs = counts.filter(~single & (F.col("n") >= PAIR_SHARE * total.get(False, 0))).select("a", "b", "n").collect()
    thai = [r.term for r in terms.select("term").distinct().collect() if r.term and re.match("[ก-๙]", r.term)]
    model = Model({r.word: r.n for r in known}, {(r.a, r.b): r.n for r in pairs}, {r.word: r.capital for r in known}, thai)
    seen = checkpoint(_survey(scans, model))
    model.cost = _costs(seen)
    model.kept.clear()
    readings = seen.filter("kind = 'open'").select("src", "item_id", F.col("a").alias("shown"), "shape")
    rare = words.filter(F.col("n") < least).mapInArrow(_shaped, "word string, n long, capital double, shape string")
    met = readings.join(rare, "shape").groupBy("src", "item_id").agg(F.collect_set(F.struct("word", "n", "capital")).alias("rare"))
    return model, met


def _shaped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of a word for each of its shapes."""
    for b in batches:
        forms = [sorted(shapes(w)) for w in b.column(0).to_pylist()]
        at = pa.array([i for i, f in enumerate(forms) for _ in f], pa.int64())
        yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(3)), pa.array([x for f in forms for x in f], pa.string())], ["word", "n", "capital", "shape"])


def _survey(scans: DataFrame, model: Model) -> DataFrame:
    """One pass over the scanned texts: ``open`` readings that no frequent word explains, with their shape,
    and how often each true form was shown (``shown``), and as what else (``taken``), in the words that just one known word explains."""
    held = scans.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("kind", pa.string()), ("src", pa.string()), ("item_id", pa.int64()), ("a", pa.string()), ("b", pa.string()), ("n", pa.int64()), ("shape", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        true = sorted({y for _, y in LATIN_CONFUSIONS})
        tally: Counter = Counter()
        only: dict[str, str | None] = {}
        for batch in batches:
            rows = []
            for src, item, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                for t in readings(text):
                    if t in m.plain:
                        tally[t] += 1
                        continue
                    if t not in only:
                        found = m.candidates(t)
                        only[t] = found[0][0] if len(found) == 1 else "" if found else None
                    if only[t] is None:
                        rows.append(("open", src, item, t, None, None, shape(t)))
                    elif only[t]:
                        tally[t, only[t]] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 7, schema, strict=True)], schema=schema)
        sums: Counter = Counter()
        for k, n in tally.items():
            word = k.lower() if isinstance(k, str) else k[1]
            for y in true:
                if y in word:
                    sums["shown", y, None] += n * word.count(y)
            if not isinstance(k, str):
                for x, y in _way(k[0], word)[1]:
                    sums["taken", x, y] += n
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*[(k, None, None, a, b, n, None) for (k, a, b), n in sums.items()], strict=True) if sums else [[]] * 7, schema, strict=True)], schema=schema)

    return scans.select("src", "item_id", "text").filter("text <> ''").mapInArrow(run, "kind string, src string, item_id long, a string, b string, n long, shape string")


def readings(text: str) -> set[str]:
    """The words a text shows, and what the words at the ends of its lines show together with those at the next one's beginning."""
    out = set(_WORDY.findall(text))
    lines = [x for x in text.split("\n") if x.strip()]
    for line, following in zip(lines, lines[1:], strict=False):
        end = line.rstrip()
        if end[-1] in _ENDS and (start := _START.match(following)) and (tail := _TAIL.search(line, end.rfind(" ") + 1)):
            out |= {tail.group(1) + start.group(1), f"{tail.group(1)}-{start.group(1)}"}
    return out


def _costs(seen: DataFrame) -> dict[tuple[str, str], float]:
    """Log probabilities of the confusions.  The table has a row for each confusion and true form of the fixed list."""
    rows = seen.filter("kind <> 'open'").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    shown = {r.a: r.n for r in rows if r.kind == "shown"}
    taken = {(r.a, r.b): r.n for r in rows if r.kind == "taken"}
    return {(x, y): math.log((taken.get((x, y), 0) + PRIOR * P_CONFUSION) / (shown.get(y, 0) + PRIOR)) for x, y in LATIN_CONFUSIONS}


def _bare(line: str) -> str:
    """A line without a number of at most three digits before or behind it."""
    s = re.sub(r"\s+", " ", line.strip())
    s = re.sub(r"^\d{1,3} +(?=\D)", "", s)
    return re.sub(r"(?<=[^\d\s]) *\|? *\d{1,3}$|(?<=\d{4}) *\|? +\d{1,3}$|(?<=\d) *\| *\d{1,3}$", "", s)


def _pairs_of(s: str) -> set[str]:
    s = s.replace(" ", "")
    return {s[i : i + 2] for i in range(len(s) - 1)}


def is_head(line: str, head: str | None) -> bool:
    """Whether a line repeats the head, perhaps with a number or errors."""
    if not head:
        return False
    s = _bare(line)
    if s == head:
        return True
    if not 0.7 * len(head) - 4 <= len(s) <= 1.3 * len(head) + 8:
        return False
    a, b = _pairs_of(s), _pairs_of(head)
    return 2 * len(a & b) >= HEAD_LIKENESS * (len(a) + len(b))


def edge_lines(text: Column) -> Column:
    """The distinct first and last ``EDGE`` lines of a text that are not blank, trimmed."""
    white = F.lit(" \t\n\x0b\f\r")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, white)) > 0)
    # bound once: the array is taken at both ends
    ends = F.get(F.transform(F.array(lines), lambda v: F.concat(F.slice(v, 1, EDGE), F.reverse(F.slice(F.reverse(v), 1, EDGE)))), F.lit(0))
    return F.array_distinct(F.transform(ends, lambda x: F.btrim(x, white)))


def heads(texts: DataFrame) -> DataFrame:
    """``(document_id, head)``: the line found most at the edges of the pages of a document,
    on two pages at least and a twentieth of all.  Documents without one have no row."""
    edges = F.col("edge") if "edge" in texts.columns else edge_lines(F.col("text"))
    # forms are made in the array, so that the filters see values and do not make them again
    bare = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"^\d{1,3} +(?=\D)", ""), r"(?<=[^\d\s]) *\|? *\d{1,3}$|(?<=\d{4}) *\|? +\d{1,3}$|(?<=\d) *\| *\d{1,3}$", "")
    long = F.filter(edges, lambda x: F.length(x) >= HEAD_LENGTH)
    edge = texts.filter("document_id IS NOT NULL").select("document_id", "page_id", F.explode(F.transform(long, bare)).alias("head"))
    edge = edge.filter((F.length("head") >= HEAD_LENGTH) & F.col("head").rlike("[A-Za-zก-๙]{2}")).distinct()
    pages = texts.filter("document_id IS NOT NULL").groupBy("document_id").agg(F.count_distinct("page_id").alias("pages"))
    often = edge.groupBy("document_id", "head").agg(F.count("*").alias("n")).filter("n >= 2")
    return often.groupBy("document_id").agg(F.max(F.struct("n", F.length("head").alias("k"), "head")).alias("m")).join(pages, "document_id").filter("m.n >= pages / 20").select("document_id", F.col("m.head").alias("head"))


@dataclass
class Repair:
    """What was found in one text, and the text repaired."""

    found: set[tuple[str, str]]
    text: str


def repair(text: str, head: str | None, model: Model, whole: bool = True) -> Repair:
    """Finds the noise of one whole text and, if ``whole``, puts the text into paragraphs."""
    found: set[tuple[str, str]] = set()
    lines = [x.rstrip("\r") for x in text.split("\n")]
    solid = [i for i, x in enumerate(lines) if x.strip()]
    edges = set(solid[:EDGE] + solid[-EDGE:])
    furniture = set()
    for i in sorted(edges):
        s = lines[i].strip()
        if is_head(s, head):
            found.add(("running_head", s))
            furniture.add(i)
    # a page number stands first or last, at most a head beside it
    rest = [i for i in solid if i not in furniture]
    for i in {*rest[:1], *rest[-1:]} if rest else ():
        s = lines[i].strip()
        if len(rest) > 1 and _NUMBER_FORMS.fullmatch(s) and re.search(r"[\d๐-๙]", s):
            found.add(("page_number", s))
            furniture.add(i)
    body = [i for i in solid if i not in furniture]
    if _is_junk(text, model):
        return Repair({f for f in found if f[0] in ("running_head", "page_number")}, text)
    form = thai_form(text) if model.terms else b""
    terms = [(t, z) for t, z in model.terms if form.count(z) > text.count(t)]
    out: dict[int, str] = {}
    cut = 0  # characters of the next line that belong to the word before
    joined_to: dict[int, tuple[int, str]] = {}
    for k, i in enumerate(body):
        line = lines[i]
        after = body[k + 1] if k + 1 < len(body) else None
        join = _division(line, lines[after], cut, model) if after is not None else None
        out[i], more = _mend_line(line, cut, join, model, terms)
        found |= more
        cut = 0
        if join:
            shown, word, cut, _ = join
            found.add(("broken_word", word))
            if word.replace("-", "").lower() != shown.replace("-", "").lower():
                found.add(("misread", word))
            joined_to[after] = (i, word)
    return Repair(found, _paragraphs(lines, body, out, joined_to) if whole else "")


def _is_junk(text: str, model: Model) -> bool:
    if text.count("�") * 10 > len(text) or "(cid:" in text:
        return True
    if len(_ODD.findall(text)) <= 0.5 * READABLE:
        return False  # too few to outweigh the readable words a text is credited with
    words = [t for t in _TOKEN.findall(text) if len(t) > 2 and not t.isdigit()]
    return sum(bool(_ODD.search(t)) and not model.candidates(t) for t in words) > 0.5 * (len(words) + READABLE)


def _known(shown: str, model: Model) -> str | None:
    """The word of one reading: itself, or the likeliest that shows so."""
    if shown.lower() in model.words:
        return shown.lower()
    found = model.candidates(shown)
    return max(found, key=lambda c: c[1] + model.likely(None, c[0]))[0] if found else None


def _division(line: str, following: str, cut: int, model: Model) -> tuple[str, str, int, int] | None:
    """``(shown, word, end in the next line, start in this line)`` of a word divided between two lines."""
    end = line.rstrip(" \t")
    start = _START.match(following) if end and end[-1] in _ENDS else None
    tail = _TAIL.search(line, max(cut, end.rfind(" ") + 1)) if start else None
    if not tail:
        return None
    left, sign, right = tail.group(1), tail.group(2), start.group(1)
    if not _WORDY.match(left) or not _WORDY.match(right) or _SIGNS.search(line[: tail.start()].strip()) and _SIGNS.search(following.strip()):
        return None
    options = [left + right, f"{left}-{right}"]
    for shown in options:
        word = _known(shown, model)
        if word is None:
            continue
        if not sign:
            both = left.lower() in model.words and right.lower() in model.words
            if both:
                if "-" in shown:
                    continue
                earlier = _TOKEN.findall(line[cut : tail.start()])
                later = _TOKEN.findall(following[start.end() :])
                b = earlier[-1].lower() if earlier else None
                c = later[0].lower() if later else None
                one = model.likely(b, word) + (model.likely(word, c) if c in model.words else 0.0)
                two = model.likely(b, left.lower()) + model.likely(left.lower(), right.lower()) + (model.likely(right.lower(), c) if c in model.words else 0.0)
                if one <= two + math.log(20):
                    continue
            elif "-" in shown and "-" not in word:
                continue
        same = word.lower() == shown.lower()
        return shown, shown if same else model.cased(shown, word), start.end(), tail.start()
    return None


def _mend_line(line: str, cut: int, join: tuple | None, model: Model, terms: list[tuple[str, bytes]]) -> tuple[str, set[tuple[str, str]]]:
    """The line from ``cut`` on with its misread words, terms and codes put right, and what was misread."""
    found: set[tuple[str, str]] = set()
    stop = join[3] if join else len(line)
    mid = line[cut:stop]
    codes = {}
    for m in _CODE.finditer(mid):
        shown = m.group()
        if not shown.isdigit() and sum(map(str.isdigit, shown)) >= 4:
            codes[m.span()] = shown.translate(DIGIT_CONFUSIONS)
            found.add(("misread", codes[m.span()]))
    changes = dict(codes)
    if not model.plain.issuperset(_WORDY.findall(mid)):
        spans = [m for m in _WORDY.finditer(mid) if m.span() not in codes]
        shown = [m.group() for m in spans]
        if any(s not in model.plain for s in shown):
            for m, s, w in zip(spans, shown, model.decode(shown), strict=True):
                if w and s.lower() != w and len(w) > 1:
                    right = model.cased(s, w)
                    found.add(("misread", right))
                    changes[m.span()] = right
    if terms:
        form = thai_form(mid)
        for term, shown in terms:
            at = form.find(shown)
            while at >= 0:
                if mid[at : at + len(term)] != term:
                    found.add(("misread", term))
                    changes[at, at + len(term)] = term
                at = form.find(shown, at + len(shown))
    parts, pos = [], 0
    for (a, b), new in sorted(changes.items()):
        if a >= pos:
            parts += [mid[pos:a], new]
            pos = b
    parts.append(mid[pos:])
    if join:
        parts.append(join[1])
    return "".join(parts), found


def _paragraphs(lines: list[str], body: list[int], out: dict[int, str], joined: dict[int, tuple[int, str]]) -> str:
    """Lines that fill the width run on; short ones, entries and rows stay lines."""
    width = max((len(lines[i].rstrip()) for i in body if not _TABLE.search(lines[i].strip())), default=0)
    text, before = "", None
    for i in body:
        new = out[i].strip()
        if before is None:
            text = new
        else:
            old, gap = lines[before].rstrip(), any(not lines[j].strip() for j in range(before + 1, i))
            first = lines[i].strip().split(" ")[0]
            if i in joined:
                text += new if not new or not new[0].isalnum() else " " + new
            elif gap or lines[i].startswith("   ") or _TABLE.search(old.strip()):
                text += ("\n\n" if gap else "\n") + new
            elif len(old) + 1 + len(first) > width:
                text += " " + new
            else:
                text += "\n" + new
        before = i
    return text


def scan_rows(page: DataFrame, stage_result: DataFrame) -> DataFrame:
    """``(src, item_id, page_id, text)`` of the scanned pages and of what the engines read."""
    return page.filter("extraction_method LIKE 'ocr_%'").select(F.lit("page").alias("src"), F.col("page_id").alias("item_id"), "page_id", F.col("page_text").alias("text")).unionByName(
        stage_result.select(F.lit("stage_result").alias("src"), F.col("stage_result_id").alias("item_id"), "page_id", "text")
    )


def with_document(scans: DataFrame, page: DataFrame) -> DataFrame:
    """``(src, item_id, page_id, edge, document_id)`` of scan rows: the lines at the edges instead of the text, which stays where it is."""
    return checkpoint(scans.select("src", "item_id", "page_id", edge_lines(F.col("text")).alias("edge")).join(page.select("page_id", "document_id"), "page_id", "left"))


def clean_texts(page: DataFrame) -> DataFrame:
    """The texts of all pages that have a text layer."""
    return page.filter("NOT coalesce(extraction_method LIKE 'ocr_%', false)").select(F.col("page_text").alias("text"))


def _repairs(texts: DataFrame, model: Model, rare: DataFrame, placed: DataFrame | None, schema: str, rows) -> DataFrame:
    held = texts.sparkSession.sparkContext.broadcast(model)
    where = texts if placed is None else placed
    # what belongs to a text is put together without it, so that the texts move once
    beside = where.select("src", "item_id", "document_id").join(heads(where), "document_id").select("src", "item_id", "head")
    beside = beside.join(rare, ["src", "item_id"], "full_outer")
    known = texts.select("src", "item_id", "text").filter("text <> ''").join(beside, ["src", "item_id"], "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            more = batch.column(4).to_pylist()
            for r in more:
                m.know(r or ())
            yield rows(zip(*(batch.column(c).to_pylist() for c in ("src", "item_id", "text", "head")), strict=True), m)

    return known.select("src", "item_id", "text", "head", "rare").mapInArrow(run, schema)


def noise(texts: DataFrame, model: Model, rare: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """``(src, item_id, kind, found)``, distinct, for ``texts`` with ``src, item_id, text`` and ``page_id, document_id``,
    which ``placed``, as ``with_document`` gives it, may have instead.

    Null and empty texts have no noise; texts without a document have no head."""

    def rows(items, m: Model) -> pa.RecordBatch:
        out = [(src, item, kind, what) for src, item, text, head in items for kind, what in sorted(repair(text, head, m, False).found)]
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["src", "item_id", "kind", "found"])

    return _repairs(texts, model, rare, placed, "src string, item_id long, kind string, found string", rows)


def repaired(texts: DataFrame, model: Model, rare: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """``(src, item_id, text)``: the texts as continuous paragraphs; null and empty texts do not come out."""

    def rows(items, m: Model) -> pa.RecordBatch:
        out = [(src, item, repair(text, head, m).text) for src, item, text, head in items]
        cols = list(zip(*out, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string()), strict=True)], ["src", "item_id", "text"])

    return _repairs(texts, model, rare, placed, "src string, item_id long, text string", rows)
