"""Encoding of a corpus with a public byte-level BPE tokenizer.

Two passes over the texts, both on whole Arrow batches with array operations.
The first counts words: the pieces that the tokenizer's pattern cuts.  The
frequent ones, with their ids, are compiled into a minimal acyclic transducer:
a suffix-sharing automaton whose transitions carry numbers that add up to the
place of the word's ids.  Its arrays are written once to the shared folder and
memory-mapped by the workers.  In the second pass each distinct word of a batch
walks the automaton; words it does not hold are merged exactly from the
vocabulary file.  The ids therefore equal the tokenizer's for every text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfold.llm.arrays import CHUNK, chunks, code_points, prefix, ragged, stretch_hash, strings
from loomfold.sources.shared import checkpoint, shared_path

TOKENIZERS = "/opt/tokenizers"
#: Words compiled into the automaton; it speeds up the encoding and changes no id.
LEXICON_WORDS = 32_768
#: Fixed value: the pattern that cuts a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LETTER, _NUMBER, _SPACE = 1, 2, 3
_HELD: dict = {}


def _classes() -> np.ndarray:
    """Letter, number, white space or none of them, for each code point."""
    if "classes" not in _HELD:
        import regex

        table = np.zeros(0x110000, dtype=np.uint8)
        every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
        for kind, pat in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
            for m in regex.finditer(pat, every):
                a, b = m.span()
                shift = 0x800 if a >= 0xD800 else 0
                table[a + shift : b + shift] = kind
                if a < 0xD800 < b:
                    table[0xD800:0xE000] = 0
        _HELD["classes"] = table
    return _HELD["classes"]


def word_starts(cp: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True where ``PATTERN`` begins a piece; ``ends`` are the limits of the texts."""
    n = len(cp)
    kind = _classes()[cp]
    first = np.zeros(n + 1, dtype=bool)
    first[ends] = True
    first = first[:n]
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    # white space before other text gives its last sign away: a plain space joins the next piece
    after = np.flatnonzero(start[1:] & (kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~first[1:]) + 1
    start[after - 1] = True
    start[after[cp[after - 1] == 32]] = False
    quote = np.flatnonzero((cp == 39) & start)
    if len(quote):
        limit = ends[np.searchsorted(ends, quote, side="right")]
        at = lambda k: np.where(quote + k < limit, cp[np.minimum(quote + k, n - 1)], 0)
        a, b = at(1), at(2)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for hit, length in ((one, 2), (two, 3)):
            q = quote[hit]
            for k in range(1, length):
                start[q + k] = False
            stop = q + length
            start[stop[stop < n]] = True
    return start


class Words:
    """The distinct pieces of some texts: ``inverse`` gives the piece of each place."""

    def __init__(self, texts: list[str]):
        cp, self.ends = code_points(texts)
        self.joined = "".join(texts)
        self.starts = np.flatnonzero(word_starts(cp, self.ends))
        self.stops = np.append(self.starts[1:], len(cp)) if len(self.starts) else self.starts
        keys = stretch_hash(prefix(cp), self.starts, self.stops)
        _, self.first, self.inverse = np.unique(keys, return_index=True, return_inverse=True)
        # equal hashes are held to be equal words only when their characters are
        size = self.stops - self.starts
        rep = self.first[self.inverse]
        if len(cp):
            same = size == size[rep]
            shift = np.repeat(self.starts[rep] - self.starts, size)
            at = np.minimum(np.arange(len(cp)) + shift, len(cp) - 1)
            odd = np.flatnonzero(cp != cp[at])
            same[np.searchsorted(self.starts, odd, side="right") - 1] = False
            if not same.all():
                extra = np.flatnonzero(~same)
                self.inverse[extra] = len(self.first) + np.arange(len(extra))
                self.first = np.concatenate([self.first, extra])

    def words(self) -> list[str]:
        s = self.joined
        return [s[a:b] for a, b in zip(self.starts[self.first].tolist(), self.stops[self.first].tolist(), strict=True)]


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, int] = {}

    def out() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return b

    for batch in batches:
        texts = strings(batch.column(0))
        for a, b in chunks(texts):
            w = Words(texts[a:b])
            for word, n in zip(w.words(), np.bincount(w.inverse, minlength=len(w.first)).tolist(), strict=True):
                held[word] = held.get(word, 0) + n
            if len(held) > 100_000:
                yield out()
    if held:
        yield out()


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``(word, n)``: how often each piece of ``PATTERN`` occurs in all texts.  Null and empty texts have none."""
    return df.select(text).filter(F.col(text) != "").mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# --- the transducer ---------------------------------------------------------


def build_transducer(entries: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """A minimal acyclic automaton of the words, as arrays.

    ``edge_key`` holds state * 256 + byte in order, ``edge_to`` the next state and
    ``edge_add`` the number of words before it; ``final`` tells where words end.
    The numbers on a word's way add up to its rank, ``offsets`` leads from there
    to its ``ids``.
    """
    words = sorted(entries)
    final, edges = [False], [{}]
    known: dict[tuple, int] = {}
    path: list[tuple[int, int, int]] = []  # parent, byte, child

    def settle(depth: int) -> None:
        while len(path) > depth:
            parent, byte, child = path.pop()
            sign = (final[child], tuple(sorted(edges[child].items())))
            edges[parent][byte] = known.setdefault(sign, child)

    last = b""
    for w in words:
        same = 0
        while same < min(len(w), len(last)) and w[same] == last[same]:
            same += 1
        settle(same)
        at = path[-1][2] if path else 0
        for byte in w[same:]:
            final.append(False)
            edges.append({})
            child = len(final) - 1
            edges[at][byte] = child
            path.append((at, byte, child))
            at = child
        final[at] = True
        last = w
    settle(0)
    number, order = {0: 0}, [0]
    for s in order:
        for _, t in sorted(edges[s].items()):
            if t not in number:
                number[t] = len(order)
                order.append(t)
    size: dict[int, int] = {}

    def below(s: int) -> int:
        todo = [s]
        while todo:
            x = todo[-1]
            missing = [t for t in edges[x].values() if t not in size]
            if missing:
                todo.extend(missing)
            else:
                size[x] = final[x] + sum(size[t] for t in edges[x].values())
                todo.pop()
        return size[s]

    below(0)
    key, to, add = [], [], []
    for s in order:
        before = int(final[s])
        for byte, t in sorted(edges[s].items()):
            key.append(number[s] * 256 + byte)
            to.append(number[t])
            add.append(before)
            before += size[t]
    lengths = np.array([len(entries[w]) for w in words], dtype=np.int64)
    return {
        "edge_key": np.array(key, dtype=np.int64),
        "edge_to": np.array(to, dtype=np.int32),
        "edge_add": np.array(add, dtype=np.int32),
        "final": np.array([final[s] for s in order], dtype=bool),
        "offsets": np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64),
        "ids": np.array([i for w in words for i in entries[w]], dtype=np.int32),
    }


def look_up(auto: dict[str, np.ndarray], words: list[bytes]) -> np.ndarray:
    """The rank of each word in the automaton, -1 for those it does not hold.  All words take each step together."""
    n = len(words)
    rank, state = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    begin = np.cumsum(sizes) - sizes
    live, k = np.flatnonzero(sizes > 0), 0
    key, to, add = auto["edge_key"], auto["edge_to"], auto["edge_add"]
    if not len(key):
        return np.full(n, -1, dtype=np.int64)
    while len(live):
        want = state[live] * 256 + data[begin[live] + k]
        e = np.minimum(np.searchsorted(key, want), len(key) - 1)
        hit = key[e] == want
        lost = live[~hit]
        state[lost], rank[lost] = -1, -1
        live, e = live[hit], e[hit]
        rank[live] += add[e]
        state[live] = to[e]
        k += 1
        live = live[sizes[live] > k]
    ended = (state >= 0) & auto["final"][np.maximum(state, 0)]
    return np.where(ended, rank, -1)


def _merger(tokenizers: str, name: str):
    """Exact merging by the vocabulary file, for words the automaton does not hold."""
    if ("bpe", tokenizers, name) not in _HELD:
        import tiktoken

        with open(os.path.join(tokenizers, f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _HELD["bpe", tokenizers, name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _HELD["bpe", tokenizers, name]


def _mapped(folder: str) -> dict[str, np.ndarray]:
    if ("auto", folder) not in _HELD:
        _HELD["auto", folder] = {n: np.load(f"{folder}/{n}.npy", mmap_mode="r") for n in ("edge_key", "edge_to", "edge_add", "final", "offsets", "ids")}
    return _HELD["auto", folder]


def compile_lexicon(df: DataFrame, text: str = "text", words: int = LEXICON_WORDS, tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k"):
    """The most frequent words of all texts, at most ``words``, as an automaton with their ids.

    Words are taken down to the least power of two as count that keeps within
    ``words``: the driver sees 64 sums and then those words, whatever the corpus.  The
    arrays go to the shared folder; where that is no mounted folder they are
    broadcast instead (a few MB).  Returns what ``encode`` takes as ``lexicon``.
    """
    spark = df.sparkSession
    counts = checkpoint(word_counts(df, text))
    level = F.floor(F.log2("n")).cast("int")
    sums = {r["level"]: r["k"] for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect()}
    held, least = 0, 64
    for b in sorted(sums, reverse=True):
        held += sums[b]
        if held > words:
            break
        least = b
    top = counts.filter(level >= least).select("word").collect()
    bpe = _merger(tokenizers, name)
    auto = build_transducer({r.word.encode(): bpe._encode_single_piece(r.word.encode()) for r in top})
    path = shared_path(spark, "lexicon")
    if path.startswith(("file:", "/")):
        local = path.removeprefix("file://").removeprefix("file:")
        os.makedirs(local)
        for k, v in auto.items():
            np.save(f"{local}/{k}.npy", v)
        return local
    return spark.sparkContext.broadcast(auto)


class Encoder:
    """Encodes texts in the workers.  Words met before are kept with the place of their
    ids, at most ``KEPT`` of them; only new ones walk the automaton or are merged."""

    KEPT = 300_000

    def __init__(self, lexicon, tokenizers: str, name: str):
        self.auto = lexicon.value if hasattr(lexicon, "value") else _mapped(lexicon) if lexicon else None
        self.bpe = _merger(tokenizers, name)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.count = np.zeros(1 << 16, dtype=np.int64)
        self.start = np.zeros(1 << 16, dtype=np.int64)
        self.pool = np.zeros(1 << 18, dtype=np.int32)
        self.used = 0

    def _learn(self, words: list[str]) -> None:
        raw = [x.encode() for x in words]
        rank = look_up(self.auto, raw).tolist() if self.auto is not None else [-1] * len(raw)
        offsets, held = (self.auto["offsets"], self.auto["ids"]) if self.auto is not None else (None, None)
        ids = [held[offsets[k] : offsets[k + 1]] if k >= 0 else self.bpe._encode_single_piece(w) for w, k in zip(raw, rank, strict=True)]
        sizes = np.array([len(i) for i in ids], dtype=np.int64)
        n, total = len(self.place), int(sizes.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while n + len(words) > len(self.count):
            self.count, self.start = (np.concatenate([x, np.zeros_like(x)]) for x in (self.count, self.start))
        self.pool[self.used : self.used + total] = np.concatenate([np.asarray(i, dtype=np.int32) for i in ids])
        self.count[n : n + len(words)] = sizes
        self.start[n : n + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.used += total
        self.place.update(zip(words, range(n, n + len(words)), strict=True))

    def pieces(self, w: Words) -> np.ndarray:
        """The place of each piece of the texts in ``start`` and ``count``."""
        words = list(dict.fromkeys(w.words()))
        if len(self.place) > self.KEPT:
            self._forget()
        if new := [x for x in words if x not in self.place]:
            self._learn(new)
        return np.array([self.place[x] for x in w.words()], dtype=np.int64)[w.inverse]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the limits of each text's."""
        w = Words(texts)
        at = self.pieces(w) if len(w.starts) else np.zeros(0, dtype=np.int64)
        count = self.count[at]
        return self.pool[ragged(self.start[at], count)], self._limits(w, count)

    def sizes(self, texts: list[str]) -> np.ndarray:
        w = Words(texts)
        at = self.pieces(w) if len(w.starts) else np.zeros(0, dtype=np.int64)
        return np.diff(self._limits(w, self.count[at]))

    @staticmethod
    def _limits(w: Words, count: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(count)])
        return total[np.searchsorted(w.starts, w.ends)]


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", lexicon=None, tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """``(key, ids)``: the ids of each whole text, without special tokens; spellings of
    special tokens inside a text are ordinary text.  Null and empty texts have an
    empty list; repeated keys are kept; other columns are not read."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(lexicon, tokenizers, name)
        for batch in batches:
            texts = strings(batch.column(1))
            for a, b in chunks(texts, CHUNK):
                ids, limits = enc.encode(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(limits, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], [key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", lexicon=None, tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """``(key, n_tokens)``: the length of each text in tokens; 0 for null and empty texts."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(lexicon, tokenizers, name)
        for batch in batches:
            texts = strings(batch.column(1))
            n = [enc.sizes(texts[a:b]) for a, b in chunks(texts, CHUNK)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n) if n else [], pa.int32())], [key, "n_tokens"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens int")
