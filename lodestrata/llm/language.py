"""Operator 9: language identification with bit-sliced Bloom filters of byte n-grams.

Training counts every n-gram of every labelled text.  A language's filter holds the n-grams whose rate in that language is
at least `SHARE` of their highest rate in any; the filters of all languages lie side by side as bits of one array of
cells, so that one probe of K cells, combined with AND, returns every language that holds the n-gram.  A text's bits are
counted per language, each count is corrected for the rate of false positives that the language's fill predicts, and
the highest wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import broadcast_arrays, crc_remainder, load, mapped, materialize, mix64, steps

GRAM = 4
PROBES = 3
SHARE = 0.25
#: An n-gram must make up this share of a language's n-grams, so a filter holds a million at most; every n-gram of a language
#: with less text than that counts.
LEAST_RATE = 1e-6
#: Cells a distinct n-gram gets, and the most cells of all languages together: 8 bytes each, so 128 MB.
CELLS_PER_GRAM, MOST_CELLS = 8, 1 << 24
#: Cells that travel to the driver as one row.
BLOCK_CELLS = 1 << 16
UNDETERMINED = "und"
_KEEP = np.full(256, 32, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def has_letter(text) -> bool:
    return isinstance(text, str) and any(map(str.isalpha, text))


def _lower(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.assign(text=[t.lower() if isinstance(t, str) else "" for t in frame["text"]])


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of lower-case texts, with runs of other ASCII as one space, and the text that holds each."""
    joined = b"".join(b" " + t + b"  " for t in texts)
    data = _KEEP[np.frombuffer(joined, np.uint8)]
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 3 for t in texts])
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32) | (doc[1:] != doc[:-1])
    data, doc = data[keep], doc[keep]
    if len(data) < GRAM:
        return np.zeros(0, np.uint32), np.zeros(0, np.int32)
    code = np.zeros(len(data) - GRAM + 1, np.uint32)
    for i in range(GRAM):
        code = (code << np.uint32(8)) | data[i : len(data) - GRAM + 1 + i]
    same = doc[: len(code)] == doc[GRAM - 1 :]
    return code[same], doc[: len(code)][same]


def _cells(gram: np.ndarray, cells: int) -> list[np.ndarray]:
    h = mix64(gram.astype(np.uint64) + np.uint64(0x51ED270B))
    return [((h >> np.uint64(21 * i)) & np.uint64(cells - 1)).astype(np.int64) for i in range(PROBES)]


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows with a text and a label."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts):
            gram = np.concatenate([p[0] for p in parts])
            order = np.argsort(gram, kind="stable")
            gram, n = gram[order], np.concatenate([p[1] for p in parts])[order]
            first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, int)
            return gram[first], np.add.reduceat(n, first) if len(first) else n

        for frame in batches:
            for lang, rows in frame.groupby("lang"):
                for _, texts in steps(iter([_lower(rows)])):
                    gram, n = np.unique(_grams(texts)[0], return_counts=True)
                    parts = held.setdefault(lang, [])
                    parts.append((gram, n.astype(np.int64)))
                    if len(parts) > 8:
                        held[lang] = [merged(parts)]
        for lang, parts in held.items():
            gram, n = merged(parts)
            yield pd.DataFrame({"lang": lang, "gram": gram.astype(np.int64), "n": n})

    known = labelled.where("text is not null and lang is not null").select("text", "lang")
    return known.mapInPandas(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filters:
    """Bit-sliced filters: `cells[plane][cell]` has bit l set where language 64 * plane + l holds an n-gram that probes it."""

    def __init__(self, langs: list[str], cells: np.ndarray, weight: np.ndarray):
        self.langs, self.cells, self.weight = langs, cells, weight
        size = cells.shape[1]
        fill = np.array([np.count_nonzero(cells[i // 64] & np.uint64(1 << (i % 64))) / size for i in range(len(langs))])
        self.false_rate = fill**PROBES

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Index of each text's language and the share of its n-grams, corrected, that the language holds."""
        gram, doc = _grams(texts)
        total = np.bincount(doc, minlength=len(texts)).astype(float)
        probes = _cells(gram, self.cells.shape[1])
        held = np.zeros((len(self.langs), len(texts)))
        for plane in range(len(self.cells)):
            mask = self.cells[plane][probes[0]]
            for p in probes[1:]:
                mask &= self.cells[plane][p]
            for i in range(64 * plane, min(len(self.langs), 64 * plane + 64)):
                held[i] = np.bincount(doc[(mask >> np.uint64(i % 64)) & np.uint64(1) == 1], minlength=len(texts))
        rate = self.false_rate[:, None]
        share = np.clip((held - rate * total) / np.maximum(total * (1 - rate), 1e-9), 0, 1)
        # ties go to the language with more training text
        best = np.argmax(share + 1e-9 * self.weight[:, None], axis=0)
        return best, share[best, np.arange(len(texts))]


def learn(labelled: DataFrame) -> tuple[list[str], dict[str, np.ndarray]]:
    """Filters of all languages.  The driver holds their cells, MOST_CELLS at most, which arrive in blocks; more labels share them."""
    counts = materialize(gram_counts(labelled), "grams")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    if not langs:
        return [], {"cells": np.zeros((1, 1), np.uint64), "weight": np.zeros(0)}
    rates = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(k, float(v)) for k, v in totals.items()], "lang string, total double")), "lang")
    rates = rates.withColumn("rate", F.col("n") / F.col("total"))
    members = (
        rates.groupBy("gram")
        .agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang", "n", "rate")).alias("each"))
        .select("gram", F.explode(F.filter("each", lambda x: (x["rate"] >= SHARE * F.col("top")) & (x["rate"] >= LEAST_RATE))).alias("x"))
        .select("gram", "x.lang")
    )
    number = {lang: i for i, lang in enumerate(langs)}
    distinct = counts.select(F.approx_count_distinct("gram", 0.02)).first()[0]
    planes = 1 + (len(langs) - 1) // 64
    size = min(MOST_CELLS >> (planes - 1).bit_length(), 1 << max(10, int(CELLS_PER_GRAM * distinct).bit_length()))
    # each task sets the bits of its n-grams; they meet by blocks of cells, which arrive packed
    index = F.create_map(*[x for k, v in number.items() for x in (F.lit(k), F.lit(v))])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            lang = frame["i"].to_numpy()
            for cell in _cells(frame["gram"].to_numpy(), size):
                yield pd.DataFrame({"plane": lang // 64, "cell": cell, "bits": (np.uint64(1) << (lang % 64).astype(np.uint64)).view(np.int64)})

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        block = int(frame["block"].iloc[0])
        cells = np.zeros(min(size, BLOCK_CELLS), np.uint64)
        np.bitwise_or.at(cells, frame["cell"].to_numpy() - block * BLOCK_CELLS, frame["bits"].to_numpy().view(np.uint64))
        return pd.DataFrame({"plane": frame["plane"].iloc[:1], "block": [block], "cells": [cells.tobytes()]})

    placed = members.select("gram", index[F.col("lang")].cast("long").alias("i")).mapInPandas(place, "plane long, cell long, bits long")
    placed = placed.withColumn("block", F.floor(F.col("cell") / BLOCK_CELLS)).groupBy("plane", "block").applyInPandas(joined, "plane long, block long, cells binary")
    cells = np.zeros((planes, size), np.uint64)
    for row in placed.toLocalIterator():
        part = np.frombuffer(row.cells, np.uint64)
        cells[row.plane, row.block * BLOCK_CELLS : row.block * BLOCK_CELLS + len(part)] = part
    weight = np.array([totals[x] for x in langs], float)
    return langs, {"cells": cells, "weight": weight / weight.sum()}


def identify(documents: DataFrame, labelled: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns of every document with lang_pred and score (0 to 1).

    Null texts and texts without a letter are `und` with score 0, as is every text where nothing was learned.  Labels are
    read in `labelled` alone.  Repeated rows give repeated rows.  Of languages that hold the same share of a text the one with more
    training text counts.  Very long texts are counted whole, in steps; an empty table gives no rows; a column whose name is that of a
    result must not be in `keep`, and others are not read.
    """
    langs, arrays = learn(labelled)
    shared = broadcast_arrays(documents.sparkSession, MOST_CELLS * 8 + 8 * len(langs) + 1024, **arrays)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filters = Filters(langs, **shared.value) if langs else None
        for frame in batches:
            for part, lowered in _paired(frame):
                pred = np.full(len(part), UNDETERMINED, object)
                score = np.zeros(len(part))
                known = np.array([has_letter(t) for t in part["text"]], bool)
                if filters is not None and known.any():
                    best, share = filters.predict(lowered)
                    pred = np.where(known, np.array(langs, object)[best], UNDETERMINED)
                    score = np.where(known, share, 0.0)
                yield part[keep].assign(lang_pred=pred, score=score)

    return mapped(documents, keep, ["text"], run, "lang_pred string, score double")


def _paired(frame: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    """Runs of rows with their lower-case UTF-8 texts."""
    for rows, texts in steps(iter([_lower(frame)])):
        yield frame.loc[rows.index], texts


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    documents = documents.withColumn("held_out", F.coalesce(crc_remainder(F.col("doc_id"), 4) == 2, F.lit(False)))
    return identify(documents, documents.where("not held_out"), ["doc_id", "held_out"])
