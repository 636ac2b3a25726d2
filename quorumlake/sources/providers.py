"""Pluggable model calls. Real chat and embedding services are given as functions;
the default is a deterministic stub that needs no network."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Batch = Callable[[list[str]], list]


def stub_embeddings(texts: list[str], dims: int = 48) -> list[list[float]]:
    """Hashed bag of words, so that equal texts have equal vectors."""
    out = []
    for t in texts:
        v = [0.0] * dims
        for w in (t or "").split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
            v[h % dims] += 1.0 if h >> 63 else -1.0
        out.append(v)
    return out


def stub_bullets(texts: list[str]) -> list[str]:
    """The first sentence of each text in tags, or an empty answer."""
    first = [(t or "").strip().split(". ")[0].strip() for t in texts]
    return [f"<BULLET>{f}</BULLET>" if f else "<EMPTY/>" for f in first]


def map_batches(df: DataFrame, id_column: str, text_column: str, call: Batch, result: str = "string", batch: int = 64) -> DataFrame:
    """(id, result, state, error) from batched calls; a failed batch is reported as
    such and can be tried again, and never stops the others."""
    kind = df.schema[id_column].dataType.simpleString()

    def run(frames):
        import pandas as pd

        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                texts = part[text_column].tolist()
                try:
                    got, state, error = call(texts), "success", None
                except Exception as e:  # any failure of the service is a state
                    got, state, error = [None] * len(texts), "failed", str(e)
                yield pd.DataFrame({id_column: part[id_column].tolist(), "result": got, "state": state, "error": error})

    return df.select(id_column, text_column).mapInPandas(run, f"`{id_column}` {kind}, result {result}, state string, error string")


def pending(work: DataFrame, status: DataFrame | None, key: str, version: str, done: tuple[str, ...] = ("success", "no_usable_quotes")) -> DataFrame:
    """Work without a finished state under this version: failed rows come again."""
    if status is None:
        return work
    finished = status.where(F.col("state").isin(*done) & (F.col("version") == version)).select(key)
    return work.join(finished, key, "left_anti")
