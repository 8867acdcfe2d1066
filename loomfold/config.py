"""Settings out of TOML files, with the ranges and the rules between them."""

from __future__ import annotations

import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path

#: Least and greatest value of each setting.
RANGES = {
    "weight_chars": (0, 1), "weight_charset": (0, 1), "weight_images": (0, 1), "weight_terms": (0, 1), "fast_images": (0, 1), "deep_images": (0, 1),
    "lexical_top_k": (1, 1000), "dense_top_k": (1, 1000), "fusion_top_k": (1, 2000), "rerank_depth": (1, 1000), "nodes_per_hop": (1, 1000), "nodes_per_request": (1, 10_000),
    "answer_seconds": (1, 600), "request_seconds": (1, 600), "response_cap": (1, 500),
}


@dataclass(frozen=True)
class Settings:
    weight_chars: float = 0.45
    weight_charset: float = 0.20
    weight_images: float = 0.20
    weight_terms: float = 0.15
    fast_images: float = 0.30
    deep_images: float = 0.60
    lexical_top_k: int = 30
    dense_top_k: int = 30
    fusion_top_k: int = 50
    rerank_depth: int = 20
    nodes_per_hop: int = 10
    nodes_per_request: int = 60
    answer_seconds: float = 60
    request_seconds: float = 120
    response_cap: int = 500
    host: str = "127.0.0.1"


def problems(s: Settings, synonyms: Mapping[str, str] | None = None, accepted: frozenset[str] = frozenset()) -> list[str]:
    """What is wrong with the settings, each setting by itself and several together."""
    out = [f"{n} is not between {lo} and {hi}" for n, (lo, hi) in RANGES.items() if not lo <= getattr(s, n) <= hi]
    rules = {
        "weights do not sum to 1": abs(s.weight_chars + s.weight_charset + s.weight_images + s.weight_terms - 1) <= 1e-9,
        "fast_images is not below deep_images": s.fast_images < s.deep_images,
        "fusion_top_k is above what retrieval gives": s.fusion_top_k <= s.lexical_top_k + s.dense_top_k,
        "rerank_depth is above fusion_top_k": s.rerank_depth <= s.fusion_top_k,
        "nodes_per_hop is above nodes_per_request": s.nodes_per_hop <= s.nodes_per_request,
        "answer_seconds is above request_seconds": s.answer_seconds <= s.request_seconds,
        "host is not this machine": s.host in ("127.0.0.1", "::1", "localhost"),
    }
    out += [text for text, holds in rules.items() if not holds]
    return out + [f"synonym {k} has no accepted value" for k, v in (synonyms or {}).items() if v not in accepted]


def load(*paths: str | Path) -> Settings:
    """The settings of TOML files, tables flattened, later files first; unknown names, wrong types and broken rules raise ValueError."""
    held: dict[str, object] = {}

    def take(table: Mapping) -> None:
        for k, v in table.items():
            if isinstance(v, Mapping):
                take(v)
            else:
                held[k] = v

    for p in paths:
        take(tomllib.loads(Path(p).read_text(encoding="utf-8")))
    known = {f.name: f.default for f in fields(Settings)}
    wrong = [f"unknown setting {k}" for k in held if k not in known]
    wrong += [f"{k} has the wrong type" for k, v in held.items() if k in known and (isinstance(v, bool) or not isinstance(v, str if isinstance(known[k], str) else (int,) if isinstance(known[k], int) and not isinstance(known[k], bool) and k not in ("answer_seconds", "request_seconds") else (int, float)))]
    if not wrong:
        found = Settings(**held)
        wrong = problems(found)
    if wrong:
        raise ValueError("; ".join(wrong))
    return found
