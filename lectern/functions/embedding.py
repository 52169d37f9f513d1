"""Embedding texts: an injectable embedder, a deterministic one for tests, one over HTTP."""

from __future__ import annotations

import hashlib
import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.session import with_fields

BATCH = 32


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Signed hashing of words; equal texts have equal vectors, no model is needed."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim), "f8")
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = hashlib.blake2b(w.encode(), digest_size=8).digest()
                out[i, int.from_bytes(h[:4], "little") % self.dim] += 1 if h[4] & 1 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms > 0, norms, 1)).astype("f4").tolist()


def normalize_host(host: str) -> str:
    host = host.strip().rstrip("/")
    return host if "://" in host or not host else f"http://{host}"


def resolve_host(hosts: list[str], model: str, override: str = "", default: str = "http://localhost:11434", timeout: float = 2.0) -> str:
    """The override, else the first host that lists the model, else the default."""
    if override:
        return normalize_host(override)
    for host in map(normalize_host, hosts):
        try:
            with urllib.request.urlopen(f"{host}/api/tags", timeout=timeout) as r:
                names = [m.get("name", "") for m in json.load(r).get("models", [])]
        except (OSError, ValueError):
            continue
        if any(n == model or n.startswith(f"{model}:") for n in names):
            return host
    return normalize_host(default)


class HttpEmbedder:
    """One request per batch, order kept; any failure fails the batch, and Spark retries the task."""

    def __init__(self, host: str, model: str, batch: int = BATCH, timeout: float = 300.0):
        self.host, self.model, self.timeout = normalize_host(host), model, timeout
        self.batch = batch if batch > 0 else BATCH

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for i in range(0, len(texts), self.batch):
            body = json.dumps({"model": self.model, "input": texts[i : i + self.batch]}).encode()
            req = urllib.request.Request(f"{self.host}/api/embed", body, {"Content-Type": "application/json"})
            with urllib.request.urlopen(req, timeout=self.timeout) as r:
                got = json.load(r)["embeddings"]
            if len(got) != len(texts[i : i + self.batch]):
                raise ValueError("the model server gave another number of vectors than texts")
            out += got
        return out


def embed(chunks: DataFrame, embedder: Embedder, text_col: str = "content") -> DataFrame:
    """``chunks`` with an ``embedding``; batches stay within Arrow batches."""
    schema = with_fields(chunks.schema, embedding=T.ArrayType(T.FloatType()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["embedding"] = embedder(frame[text_col].fillna("").tolist()) if len(frame) else []
            yield frame

    return chunks.mapInPandas(run, schema)


def serialize(vector: list[float]) -> bytes:
    return np.asarray(vector, "<f4").tobytes()


def deserialize(data: bytes) -> list[float]:
    """Little-endian floats; a partial one at the end is dropped."""
    return np.frombuffer(data[: len(data) // 4 * 4], "<f4").tolist()


@F.pandas_udf(T.BinaryType())
def serialize_udf(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else serialize(v))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def deserialize_udf(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else deserialize(b))
