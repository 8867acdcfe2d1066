"""Functions that users bring along: embedders, language models, recognisers.  A failure costs its row, not the job."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    """Vectors of ``dim`` numbers, one for each text."""

    dim: int

    def encode(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


class LanguageModel(Protocol):
    def generate(self, prompt: str, max_tokens: int = 512) -> str: ...


class StubEmbedder:
    """Unit vectors that depend on the text only."""

    def __init__(self, dim: int = 8) -> None:
        self.dim = dim

    def encode(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            raw = [b - 127.5 for i in range(0, self.dim, 32) for b in hashlib.sha256(f"{i}:{t}".encode()).digest()][: self.dim]
            size = sum(x * x for x in raw) ** 0.5
            out.append([x / size for x in raw])
        return out


class StubLanguageModel:
    """A fixed reply, or what a function makes of the prompt."""

    def __init__(self, reply: str | Callable[[str], str] = "") -> None:
        self.reply = reply

    def generate(self, prompt: str, max_tokens: int = 512) -> str:
        text = self.reply(prompt) if callable(self.reply) else self.reply
        return text[: 4 * max_tokens]


def embed(df: DataFrame, key: str, text: str, embedder: Embedder, batch: int = 64) -> DataFrame:
    """``(key, vector, problem)``: the vector of each text; of a batch that fails each text is tried by itself, and
    where it fails or has a vector of another length, ``vector`` is null and ``problem`` says why.  A null text is a problem, an empty one is not."""
    kind = dict(df.dtypes)[key]

    def one(texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
        try:
            found = [[float(x) for x in v] for v in embedder.encode(texts)]
            if len(found) != len(texts):
                raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
            return [(v, None) if len(v) == embedder.dim else (None, f"{len(v)} numbers instead of {embedder.dim}") for v in found]
        except Exception as e:  # what a user's function raises is not known here
            return [(None, str(e)[:200])] if len(texts) == 1 else [r for t in texts for r in one([t])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            out: list[tuple[list[float] | None, str | None]] = [(None, "no text")] * len(texts)
            some = [i for i, t in enumerate(texts) if t is not None]
            for a in range(0, len(some), batch):
                for i, r in zip(some[a : a + batch], one([texts[i] for i in some[a : a + batch]]), strict=True):
                    out[i] = r
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v for v, _ in out], pa.list_(pa.float32())), pa.array([p for _, p in out], pa.string())], [key, "vector", "problem"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, vector array<float>, problem string")


def index_vectors(embedded: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``embed`` that have a vector, and those that were rejected with their problem."""
    return embedded.filter("vector IS NOT NULL").select(key, "vector"), embedded.filter("vector IS NULL").select(key, "problem")


def generate(df: DataFrame, key: str, prompt: str, model: LanguageModel, max_tokens: int = 512) -> DataFrame:
    """``(key, reply, problem)``: the reply to each prompt; null with its problem where the model fails or the prompt is null."""
    kind = dict(df.dtypes)[key]

    def ask(p: str | None) -> tuple[str | None, str | None]:
        if p is None:
            return None, "no prompt"
        try:
            return model.generate(p, max_tokens), None
        except Exception as e:
            return None, str(e)[:200]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [ask(p) for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r for r, _ in out], pa.string()), pa.array([p for _, p in out], pa.string())], [key, "reply", "problem"])

    return df.select(key, prompt).mapInArrow(run, f"`{key}` {kind}, reply string, problem string")


def pages_of(files: DataFrame, key: str, content: str, pages: Callable[[bytes], Iterable[tuple[int, Callable[[], dict]]]], most: int | None = None) -> DataFrame:
    """``(key, page_number, text, width_pt, height_pt, image_count, image_area_ratio, problem)`` of documents.

    ``pages`` opens the bytes of a document and gives page numbers with a function that reads the
    page: a page that cannot be read is a row with its ``problem``, and so is a document
    that cannot be opened (page 0).  One page is held at a time.  ``most`` limits the pages of a document, as for its head.
    The image share of a page is at most 1."""
    kind = dict(files.dtypes)[key]
    names = ["page_number", "text", "width_pt", "height_pt", "image_count", "image_area_ratio", "problem"]
    types = [pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.float64(), pa.string()]

    def read(data: bytes) -> Iterator[dict]:
        try:
            for n, page in pages(data):
                if most is not None and n > most:
                    return
                try:
                    p = page()
                    area = (p.get("width_pt") or 0) * (p.get("height_pt") or 0)
                    share = min(1.0, sum(w * h for w, h in p.get("images", ())) / area) if area else 0.0
                    yield {"page_number": n, "text": p.get("text") or "", "width_pt": p.get("width_pt"), "height_pt": p.get("height_pt"), "image_count": len(p.get("images", ())), "image_area_ratio": share, "problem": None}
                except Exception as e:
                    yield dict.fromkeys(names) | {"page_number": n, "problem": str(e)[:200]}
        except Exception as e:
            yield dict.fromkeys(names) | {"page_number": 0, "problem": str(e)[:200]}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data in enumerate(b.column(1).to_pylist()):
                held = list(read(data or b""))
                keys = b.column(0).take(pa.array([i] * len(held), pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, *(pa.array([r[n] for r in held], t) for n, t in zip(names, types, strict=True))], [key, *names])

    return files.select(key, content).mapInArrow(run, f"`{key}` {kind}, page_number int, text string, width_pt double, height_pt double, image_count int, image_area_ratio double, problem string")


def quarantined(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pages that were read, and those with a problem."""
    return pages.filter(F.col("problem").isNull()).drop("problem"), pages.filter(F.col("problem").isNotNull())
