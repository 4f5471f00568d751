"""Likeness of sentences to questions: cosines of term counts projected on their leading axes.

Axes come from a randomised singular value decomposition of the sentences' term counts: terms are hashed to
columns, so the matrix has as many rows as there are sentences but a stated number of columns; each pass adds up
one product, columns by axes, over the partitions.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS, AXES, PASSES = 4096, 24, 5
#: Sentences counted at once.
AT_ONCE = 512
_TERM = re.compile(r"[a-z0-9]{2,}")


def counts(texts: list[str | None]) -> np.ndarray:
    """Terms of each text by the column that they are hashed to."""
    out = np.zeros((len(texts), COLUMNS))
    for i, text in enumerate(texts):
        for term in _TERM.findall((text or "").lower()):
            out[i, zlib.crc32(term.encode()) % COLUMNS] += 1
    return out


def leading_axes(texts: DataFrame, text: str = "sentence", axes: int = AXES, passes: int = PASSES, seed: int = 3) -> np.ndarray:
    """(COLUMNS, axes): orthonormal axes along which the counts of all texts vary most, the strongest first."""
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((COLUMNS, axes)))[0]
    picked = texts.select(F.col(text).cast("string"))
    plus = lambda a, b: b if a is None else a if b is None else a + b
    for left in range(passes, 0, -1):
        shared = texts.sparkSession.sparkContext.broadcast(basis)

        def products(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for at in range(0, b.num_rows, AT_ONCE):
                    a = counts(b.column(0).slice(at, AT_ONCE).to_pylist())
                    total = plus(total, a.T @ (a @ shared.value))
            if total is not None:
                yield pa.RecordBatch.from_pydict({"p": [total.tobytes()]})

        summed = picked.mapInArrow(products, "p binary").rdd.map(lambda r: np.frombuffer(r["p"]).reshape(COLUMNS, -1)).treeAggregate(None, plus, plus)
        if summed is None:
            return basis
        if left > 1:
            basis = np.linalg.qr(summed)[0]
    values, turn = np.linalg.eigh(basis.T @ summed)
    return basis @ turn[:, np.argsort(-values)]


def likeness(sentence: Column, question: Column, axes: np.ndarray) -> Column:
    """Cosine of both texts' projected counts; 0 where one has no terms, or none that the axes tell of."""
    basis = axes

    @F.pandas_udf("double")
    def cosine(sentences: pd.Series, questions: pd.Series) -> pd.Series:
        out = np.zeros(len(sentences))
        for at in range(0, len(out), AT_ONCE):
            a, b = (counts(list(x.iloc[at : at + AT_ONCE])) @ basis for x in (sentences, questions))
            norms = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
            out[at : at + AT_ONCE] = np.where(norms > 1e-9, (a * b).sum(axis=1) / np.maximum(norms, 1e-9), 0.0)
        return pd.Series(out)

    return cosine(sentence, question)
