"""Language identification by hierarchical discrimination.

A text's letters are counted in hashed byte n-grams (one to three bytes, lower
case, other characters as one blank).  A first linear support vector machine
per pair of families decides the family; one machine per pair of languages of
that family then decides the language, by votes and then margins.  Families are
a parameter; a learned language of no listed family is a family of its own.

Training takes a bounded sample of the rows allowed for it: rows enter by the
hash of their id (of their text, where that is null), at a rate that gives ``per_language`` rows of each language
on average; the counts behind the rates cover all rows.

Cases: null texts and texts without a letter are ``und`` with score 0; rows
without a language teach nothing, and if no row teaches, all is ``und``; one
learned language is predicted everywhere, with score 1; repeated rows are
judged alike; whole texts are read, however long, in pieces of bounded size; an
empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.llm.common import bounded_batches, held_out, table

DIMENSIONS = 4096
FAMILIES = {"germanic": ("en", "de", "nl", "sv", "da", "no"), "romance": ("fr", "es", "it", "pt", "ro", "ca")}
_LETTER = re.compile(r"[^\W\d_]")
#: Bytes: letters and all bytes above ASCII stay, the rest is blank.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def features(text: str) -> np.ndarray:
    """Square roots of n-gram shares, of length one, for one whole text."""
    raw = _FOLD[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)]
    counts = np.zeros(DIMENSIONS)
    for at in range(0, len(raw), 1 << 20):
        b = np.concatenate(([32], raw[at : at + (1 << 20) + 2])).astype(np.uint32)
        for n in (1, 2, 3):
            if len(b) < n:
                continue
            code = b[: len(b) - n + 1].copy()
            for k in range(1, n):
                code = code * np.uint32(257) + b[k : len(b) - n + 1 + k]
            code = (code + np.uint32(n * 7919)) * np.uint32(2654435761)
            counts += np.bincount(code >> np.uint32(20), minlength=DIMENSIONS)
    root = np.sqrt(counts)
    norm = np.linalg.norm(root)
    return (root / norm if norm else root).astype(np.float32)


def fit_machine(x: np.ndarray, y: np.ndarray, c: float = 30.0, rounds: int = 100) -> np.ndarray:
    """A linear support vector machine (squared hinge, both classes weighing alike); the bias comes last."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    y = y.astype(np.float32)  # one precision throughout: mixed, each product would copy the whole matrix
    weight = (np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * c).astype(np.float32)
    w, v = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    step = np.float32(1.0 / (1.0 + 2 * 2 * c))
    for t in range(rounds):  # Nesterov's accelerated gradient
        slack = np.maximum(0.0, 1 - y * (x @ v))
        grad = v - 2 * x.T @ (weight * slack * y)
        following = v - step * grad
        v = following + np.float32(t / (t + 3)) * (following - w)
        w = following
    return w


class Hierarchy:
    def __init__(self, x: np.ndarray, langs: list[str], families: dict[str, tuple[str, ...]]):
        family = {lang: name for name, members in families.items() for lang in members}
        self.langs = sorted(set(langs))
        of = {lang: family.get(lang, f"only-{lang}") for lang in self.langs}
        self.members = {f: [lang for lang in self.langs if of[lang] == f] for f in sorted(set(of.values()))}
        lang = np.array(langs)
        kin = np.array([of[i] for i in langs])
        self.between = self._pairs(x, kin, list(self.members))
        self.within = {f: self._pairs(x, lang, m) for f, m in self.members.items()}

    @staticmethod
    def _pairs(x: np.ndarray, label: np.ndarray, names: list[str]):
        machines = []
        for a, b in combinations(range(len(names)), 2):
            rows = np.flatnonzero((label == names[a]) | (label == names[b]))
            machines.append((a, b, fit_machine(x[rows], np.where(label[rows] == names[a], 1.0, -1.0))))
        return names, machines

    @staticmethod
    def _choose(pairs, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner and its least margin over the others, for each row."""
        names, machines = pairs
        votes, worst = np.zeros((len(x), len(names))), np.full((len(x), len(names)), np.inf)
        for a, b, w in machines:
            m = x @ w[:-1] + w[-1]
            votes[:, a] += m > 0
            votes[:, b] += m <= 0
            worst[:, a] = np.minimum(worst[:, a], m)
            worst[:, b] = np.minimum(worst[:, b], -m)
        best = np.argmax(votes + np.tanh(np.clip(worst, -50, 50)) / 4, axis=1)
        return best, worst[np.arange(len(x)), best]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        kin, margin = self._choose(self.between, x)
        out = np.empty(len(x), object)
        for f, (name, members) in enumerate(self.members.items()):
            rows = np.flatnonzero(kin == f)
            if len(rows):
                best, m = self._choose(self.within[name], x[rows])
                out[rows] = np.array(members, object)[best]
                margin[rows] = np.minimum(margin[rows], m)
        return out.tolist(), 1 / (1 + np.exp(-4 * np.minimum(margin, 50)))


def fit(rows: DataFrame, per_language: int = 1000, families: dict[str, tuple[str, ...]] | None = None) -> Hierarchy | None:
    """``rows``: id, text, lang of the rows that may teach."""
    usable = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return None
    scale = 1 << 30
    limit = F.lit(0)
    for lang, n in counts.items():
        limit = F.when(F.col("lang") == lang, int(min(1.0, per_language / n) * scale)).otherwise(limit)
    place = F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id", F.lit(17)))
    chosen = usable.where(F.pmod(place, F.lit(scale)) < limit).select("lang", "text")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, at, values = [], [], []
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if _LETTER.search(text):
                    x = features(text)
                    some = np.flatnonzero(x)
                    langs.append(lang)
                    at.append(some.astype("<u2").tobytes())
                    values.append(x[some].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(at, pa.binary()), pa.array(values, pa.binary())], ["lang", "at", "value"])

    found = chosen.mapInArrow(sparse, "lang string, at binary, value binary").collect()
    if not found:
        return None
    x = np.zeros((len(found), DIMENSIONS), np.float32)
    for i, r in enumerate(found):
        x[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["value"], "<f4")
    return Hierarchy(x, [r["lang"] for r in found], FAMILIES if families is None else families)


def predict(docs: DataFrame, model: Hierarchy | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row."""
    picked = bounded_batches(docs).select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([picked.schema["id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            for at in range(0, len(texts), 256):
                some = [i for i in range(at, min(at + 256, len(texts))) if texts[i] and _LETTER.search(texts[i])]
                if some and shared.value is not None:
                    names, values = shared.value.predict(np.array([features(texts[i]) for i in some]))
                    scores[some] = values
                    for i, name in zip(some, names, strict=True):
                        langs[i] = name
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores)], schema.names)

    return picked.mapInArrow(label, schema).withColumnRenamed("id", id_col)


def op9(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang")
    model = fit(docs.where(~held_out("doc_id")).select(F.col("doc_id").alias("id"), "text", "lang"))
    return predict(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
