"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verso.llm.common import fold

UNKNOWN = "und"
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
#: The model is broadcast, and has one row of 2^bits numbers for each language.
MAX_LANGUAGES = 1000


def grams(texts: list[str], orders: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of every n-gram of the lower-cased texts, one order at a time; line ends mark both ends."""
    framed = [f"\n{t.lower()}\n" for t in texts]
    lens = np.fromiter(map(len, framed), dtype=np.int64, count=len(framed))
    points = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    of = np.repeat(np.arange(len(framed)), lens)
    code = np.zeros(len(points), dtype=np.uint64)
    for n in range(1, max(orders) + 1):
        code = code[: len(points) - n + 1] * MIX[0] + points[n - 1 :]
        if n in orders:
            inside = of[: len(code)] == of[n - 1 :]
            bucket = ((code + np.uint64(n)) * MIX[1]) >> np.uint64(64 - bits)
            yield of[: len(code)][inside], bucket[inside].astype(np.int64)


def _batches(texts: list[str], size: int = 400_000) -> Iterator[tuple[int, int]]:
    first = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _count(orders: tuple[int, ...], bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for pdf in batches:
            for lang, part in pdf.groupby("_lang"):
                own = counts.setdefault(lang, np.zeros(1 << bits, np.int64))
                rows[lang] = rows.get(lang, 0) + len(part)
                texts = part["_text"].tolist()
                for a, b in _batches(texts):
                    for _, bucket in grams(texts[a:b], orders, bits):
                        own += np.bincount(bucket, minlength=1 << bits)
        for lang, own in counts.items():
            seen = np.flatnonzero(own)
            yield pd.DataFrame({"_lang": lang, "bucket": seen.astype(np.int32), "n": own[seen]})
            yield pd.DataFrame({"_lang": [lang], "bucket": np.array([-1], np.int32), "n": [rows[lang]]})

    return run


def train(df: DataFrame, text_col: str, lang_col: str, orders: tuple[int, ...], bits: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log priors and the log-probability matrix (buckets by languages), with add-one smoothing."""
    rows = df.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("_lang"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    if rows.select("_lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = rows.mapInPandas(_count(orders, bits), "_lang string, bucket int, n long")
    model = counts.groupBy("_lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(model["_lang"].unique())
    matrix, prior = np.ones((1 << bits, len(langs))), np.ones(len(langs))
    for i, lang in enumerate(langs):
        own = model[model["_lang"] == lang]
        bucket, n = own["bucket"].to_numpy(), own["n"].to_numpy()
        matrix[bucket[bucket >= 0], i] += n[bucket >= 0]
        prior[i] = n[bucket < 0].sum()
    return langs, np.log(prior / max(prior.sum(), 1)), np.log(matrix / matrix.sum(axis=0)).astype(np.float32)


def _score(model, orders: tuple[int, ...], bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        langs, prior, matrix = model.value
        names = np.array([*langs, UNKNOWN], dtype=object)
        for pdf in batches:
            texts = pdf.pop("_text").fillna("").tolist()
            best, score = np.full(len(texts), len(langs)), np.zeros(len(texts))
            known = np.fromiter((any(map(str.isalpha, t)) for t in texts), dtype=bool, count=len(texts))
            for a, b in _batches(texts) if langs else ():
                total = np.tile(prior, (b - a, 1))
                for of, bucket in grams(texts[a:b], orders, bits):
                    if len(of):
                        new = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
                        total[of[new]] += np.add.reduceat(matrix[bucket], new, axis=0, dtype=np.float64)
                share = np.exp(total - total.max(axis=1, keepdims=True))
                share /= share.sum(axis=1, keepdims=True)
                own = known[a:b]
                best[a:b][own] = share.argmax(axis=1)[own]
                score[a:b][own] = share.max(axis=1)[own]
            yield pdf.assign(lang_pred=names[best], score=score)

    return run


def identify(
    df: DataFrame,
    training: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    orders: tuple[int, ...] = (1, 2, 3),
    bits: int = 16,
) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row.

    The model is learned from the whole texts of the rows in `training` (by default the folds 0, 1 and
    3 of the identifier) that have a language; a prediction sees the text alone. Null texts and texts
    without letters are `und` with score 0, as is everything when there is nothing to learn from. Ties
    go to the first language by name. Repeated rows get equal results; an empty table gives none.
    """
    held_out = fold(F.col(id_col)) == 2
    model = train(df.filter(~held_out if training is None else training), text_col, lang_col, orders, bits)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("_id"), held_out.alias("held_out"), F.col(text_col).alias("_text"))
    out = rows.mapInPandas(_score(shared, orders, bits), f"_id {kind}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("_id", id_col)
