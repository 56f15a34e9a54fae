"""Embedding of texts: providers, and the batched operator over a DataFrame."""

from __future__ import annotations

import hashlib
import json
import math
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

BATCH, LONGEST_WAIT = 32, 8


class EmbeddingError(RuntimeError):
    """The provider could not be reached, or gave an answer that does not fit."""


class Embedder(Protocol):
    model_id: str

    def embed_documents(self, texts: list[str]) -> list[list[float]]: ...

    def embed_query(self, text: str) -> list[float]: ...


def l2_normalized(vector: list[float]) -> list[float]:
    """The unit vector; a zero vector stays."""
    n = math.sqrt(sum(x * x for x in vector))
    return [x / n for x in vector] if n else list(vector)


@dataclass(frozen=True)
class HashEmbedder:
    """Vectors from hashes of the text's words: needs no model and no network, and gives the same everywhere."""

    dimension: int = 64
    model_id: str = "hash-64"

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        return [self._embed(t) for t in texts]

    def embed_query(self, text: str) -> list[float]:
        return self._embed(text)

    def _embed(self, text: str) -> list[float]:
        v = [0.0] * self.dimension
        for w in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "big")
            v[h % self.dimension] += 1.0 if (h >> 32) & 1 else -1.0
        return l2_normalized(v)


@dataclass
class HttpEmbedder:
    """Common parts of the HTTP providers: batches, retries with growing waits, checks, normalization."""

    base_url: str
    model: str
    api_key: str | None = None
    batch: int = BATCH
    retries: int = 3
    timeout: float = 60.0
    normalize: bool = True
    truncate: bool = True
    dimension_: int | None = None
    sleep: Callable[[float], None] = field(default=time.sleep, repr=False)
    retry_on: tuple[int, ...] = (429, 500, 502, 503, 504)
    path: str = ""

    def __post_init__(self):
        if self.batch < 1:
            raise ValueError("batch must be at least 1")

    @property
    def model_id(self) -> str:
        return self.model

    @property
    def dimension(self) -> int:
        """The vectors' width, asked for once."""
        if self.dimension_ is None:
            self.dimension_ = len(self.embed_query("ping"))
        return self.dimension_

    def embed_query(self, text: str) -> list[float]:
        return self.embed_documents([text])[0]

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for at in range(0, len(texts), self.batch):
            part = texts[at : at + self.batch]
            vectors = self.vectors(self.post(self.body(part)))
            if len(vectors) != len(part):
                raise EmbeddingError(f"{len(part)} texts, {len(vectors)} vectors")
            out += [l2_normalized(v) if self.normalize else v for v in vectors]
        return out

    def body(self, texts: list[str]) -> dict:
        raise NotImplementedError

    def vectors(self, answer) -> list[list[float]]:
        raise NotImplementedError

    def post(self, body: dict):
        url = self.base_url.rstrip("/") + self.path
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        for attempt in range(self.retries + 1):
            try:
                request = urllib.request.Request(url, json.dumps(body).encode(), headers)
                with urllib.request.urlopen(request, timeout=self.timeout) as r:
                    return json.loads(r.read())
            except urllib.error.HTTPError as e:
                if e.code not in self.retry_on or attempt == self.retries:
                    raise EmbeddingError(f"{url}: status {e.code}") from e
            except (urllib.error.URLError, TimeoutError, ValueError) as e:
                if attempt == self.retries:
                    raise EmbeddingError(f"{url}: {e}") from e
            self.sleep(min(2 ** (attempt + 1), LONGEST_WAIT))


@dataclass
class OpenAICompatible(HttpEmbedder):
    """POST /embeddings below a base URL that ends in its version; answers are ordered by their index."""

    path: str = "/embeddings"
    output_dimension: int | None = None

    def body(self, texts):
        return {"model": self.model, "input": texts} | ({"dimensions": self.output_dimension} if self.output_dimension else {})

    def vectors(self, answer):
        return [x["embedding"] for x in sorted(answer["data"], key=lambda x: x["index"])]


@dataclass
class TextEmbeddingsInference(HttpEmbedder):
    path: str = "/embed"
    retry_on: tuple[int, ...] = (429,)

    def body(self, texts):
        return {"inputs": texts, "truncate": self.truncate}

    def vectors(self, answer):
        return list(answer)


@dataclass
class Ollama(HttpEmbedder):
    path: str = "/api/embed"
    retry_on: tuple[int, ...] = (500, 502, 503, 504)

    def body(self, texts):
        return {"model": self.model, "input": texts, "truncate": self.truncate}

    def vectors(self, answer):
        return answer["embeddings"]


PROVIDERS = {"openai": OpenAICompatible, "tei": TextEmbeddingsInference, "ollama": Ollama}


def build_embedder(provider: str, **options) -> Embedder:
    """A provider by name; ValueError for an unknown one."""
    if provider == "hash":
        return HashEmbedder(options.get("dimension", 64), f"hash-{options.get('dimension', 64)}")
    if provider not in PROVIDERS:
        raise ValueError(f"unknown provider {provider!r}")
    return PROVIDERS[provider](**options)


def embed(df: DataFrame, embedder: Embedder, text_col: str = "text") -> DataFrame:
    """The table with `embedding` array<float>: each task sends its texts in batches. Null texts get null."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            some = [t for t in texts if t is not None]
            vectors = iter(embedder.embed_documents(some) if some else [])
            column = pa.array([None if t is None else next(vectors) for t in texts], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=schema.names)

    return df.mapInArrow(run, schema)
