"""What a user can put in place: a language, an embedder, a judge."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import entities, temporal, text

LANGUAGE = "normalize slug tokenize significant_terms phrases normalize_for_match content_words derive_slug forms_for scope_of hard_specifics is_enumerative wants_specifics is_historical is_correction age_tag humanize humanize_relation parse_date_range people references".split()


class English:
    """The language that comes with the engine."""

    id = "english"


for _name in LANGUAGE:
    setattr(English, _name, staticmethod(next(getattr(m, _name) for m in (text, temporal, entities) if hasattr(m, _name))))

_LANGUAGES: dict[str, object] = {"english": English}


def register_language(service: object) -> None:
    """Add a language under its id; one that lacks a method is refused."""
    name = getattr(service, "id", None)
    lacking = [m for m in LANGUAGE if not callable(getattr(service, m, None))]
    if not isinstance(name, str) or not name or lacking:
        raise ValueError(f"a language needs an id and {', '.join(lacking) or 'nothing else'}")
    _LANGUAGES[name] = service


def language(name: str | object | None = None) -> object:
    if name is None:
        return English
    if not isinstance(name, str):
        register_language(name)
        return name
    if name not in _LANGUAGES:
        raise ValueError(f"no language {name!r}; there are {', '.join(_LANGUAGES)}")
    return _LANGUAGES[name]


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed hashes of words and neighbouring words, unit length: deterministic and without a model file."""

    def __init__(self, dimensions: int = 384) -> None:
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), dtype=np.float32)
        for i, t in enumerate(texts):
            words = "".join(c if c.isalnum() else " " for c in t.lower()).split()
            for g in words + [" ".join(p) for p in zip(words, words[1:])]:
                h = hash_of(g)
                out[i, h % self.dimensions] += 1.0 if h >> 40 & 1 else -1.0
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)


def hash_of(s: str) -> int:
    from hashlib import blake2b

    return int.from_bytes(blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def embedded(df: DataFrame, embedder: Embedder, *, text_column: str = "fact", into: str = "embedding") -> DataFrame:
    """``df`` with a vector column, in Arrow batches."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(embedder.embed(s.fillna("").tolist())))

    return df.withColumn(into, vectors(F.col(text_column)))


#: A judge reads a report and gives decisions; the engine validates them before anything changes.
Judge = Callable[[DataFrame], DataFrame]


def similarity(a: Column, b: Column) -> Column:
    from ..functions.vector import dot

    return dot(a, b)
