"""Language identification with string kernels.

The blended-spectrum presence kernel of two texts counts the character n-grams of length 1 to
``order`` that both hold, divided by the geometric mean of how many each holds. Landmarks (a
Nystroem sample of the labelled texts) turn a text into a row of kernel values; one-versus-rest
kernel ridge regression on these rows gives a score for each language. Texts are scored in
batches, by two matrix products: presence times landmarks, then kernel rows times weights.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KEY, TEXT, keyed, map_texts

BINS = 1 << 14
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _fold_table() -> np.ndarray:
    """Code point to lower-case letter, anything that is no letter to 32; built once per process."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low[0])
    return table


def grams(text: str | None, order: int = 3) -> np.ndarray | None:
    """Bins of the n-grams of the whole text, with repeats; None if it has no letter.

    Runs of other characters count as one space, and so do the ends.
    """
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    low = _fold_table()[points] if len(points) else points
    blank = low == 32
    if blank.all():
        return None
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # the first blank of a run
    row = low[keep]
    row = np.concatenate([np.full(int(row[0] != 32), 32, np.uint32), row, np.full(int(row[-1] != 32), 32, np.uint32)])
    out, h = [], np.zeros(len(row), np.uint32)
    for n in range(1, order + 1):
        if len(row) < n:
            break
        h = (h[: len(row) - n + 1] if n > 1 else h) * np.uint32(0x9E3779B1) + row[n - 1 :] + np.uint32(n)
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        out.append(mixed >> np.uint32(18))
    return np.concatenate(out)


def presence(texts: list, order: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(texts, BINS) float32 of zeros and ones, and whether each text has a letter."""
    out, known = np.zeros((len(texts), BINS), np.float32), np.zeros(len(texts), bool)
    for i, x in enumerate(texts):
        bins = grams(x, order)
        if bins is not None:
            out[i, bins] = 1
            known[i] = True
    return out, known


@dataclass
class Model:
    langs: list[str]
    landmarks: np.ndarray  # (landmarks, BINS) packed bits
    weights: np.ndarray  # (landmarks, langs)
    order: int

    def scorer(self):
        marks = np.unpackbits(self.landmarks, axis=1).astype(np.float32)
        columns, size, any_mark = np.ascontiguousarray(marks.T), np.sqrt(marks.sum(axis=1)), marks.max(axis=0)

        def score(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Scores by language, whether there is a letter, and the share of the text's n-grams that some landmark has."""
            rows, known = presence(texts, self.order)
            held = np.maximum(rows.sum(axis=1), 1)
            kernel = rows @ columns
            kernel /= np.sqrt(held)[:, None] * size
            return kernel @ self.weights, known, rows @ any_mark / held

        return score


def fit(rows: list[tuple[str, bytes]], landmarks: int = 128, ridge: float = 1e-3, order: int = 3) -> Model | None:
    """From (language, packed presence) rows; None if there are none. Landmarks are spread over the languages."""
    if not rows:
        return None
    langs = sorted({lang for lang, _ in rows})
    bits = np.stack([np.frombuffer(b, np.uint8) for _, b in rows])
    own = np.array([langs.index(lang) for lang, _ in rows])
    place = np.zeros(len(rows), np.int64)  # the how-manieth of its language
    for k in range(len(langs)):
        place[own == k] = np.arange((own == k).sum())
    chosen = np.lexsort((own, place))[:landmarks]
    x = np.unpackbits(bits, axis=1).astype(np.float32)
    size = np.sqrt(np.maximum(x.sum(axis=1), 1))
    kernel = (x @ x[chosen].T) / (size[:, None] * size[chosen])
    target = np.where(own[:, None] == np.arange(len(langs)), 1.0, -1.0)
    k = kernel.astype(np.float64)
    weights = np.linalg.solve(k.T @ k + ridge * len(rows) * (k[chosen] + 1e-6 * np.eye(len(chosen))), k.T @ target)
    return Model(langs, bits[chosen], weights.astype(np.float32), order)


def training_rows(documents: DataFrame, key: str, text: str, lang: str, per_language: int, order: int, most_languages: int = 256) -> list[tuple[str, bytes]]:
    """About ``per_language`` labelled texts of each language, chosen by a hash of the key.

    Only key and label are read to choose; the driver gets the chosen texts' presence bits, 2 KB each.
    """
    usable = documents.where(F.col(f"`{lang}`").isNotNull())
    counts = usable.groupBy(F.col(f"`{lang}`").alias("lang")).count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    if not counts:
        return []
    draw = F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string")), F.lit(1 << 30))
    rate = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], int(min(1.0, per_language / r["count"]) * (1 << 30)) + 1)])
    picked = usable.where(draw < F.element_at(rate, F.col(f"`{lang}`"))).select(F.struct(F.col(f"`{lang}`").cast("string").alias("lang"), draw.alias("draw")).alias(KEY), F.col(f"`{text}`").alias(TEXT))

    def make():
        def each(texts):
            rows, known = presence(texts, order)
            packed = np.packbits(rows.astype(np.uint8), axis=1)
            return [[p.tobytes() if k else None for p, k in zip(packed, known, strict=True)]]

        return lambda texts: [sum((each(texts[i : i + 256])[0] for i in range(0, len(texts), 256)), [])]

    rows = map_texts(picked, [("bits", T.BinaryType())], make, "k").where("bits is not null")
    most = 2 * per_language * len(counts)  # far above what the hash draws
    got = rows.orderBy("k.draw", "k.lang", "bits").limit(most).collect()
    return [(r["k"]["lang"], bytes(r["bits"])) for r in got]


def identify(documents: DataFrame, train: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 500, landmarks: int = 128, ridge: float = 1e-3, order: int = 3, train_key: str = "doc_id", most_languages: int = 256) -> DataFrame:
    """For every row of ``documents``: key, ``lang_pred``, ``score`` (0 to 1) and ``familiar`` (0 to 1).

    Learns from ``train`` only (key ``train_key``): texts with a label, about ``per_language`` of each of the
    ``most_languages`` most frequent languages, so the fit is bounded whatever the input. A text that is null or
    has no letter is ``und`` with score 0, and so are all where nothing could be learned. Equal
    scores go to the language first in order. Repeated rows each get a row. ``familiar`` is the share of the text's
    n-grams that some landmark has: near 1 in the learned languages, low in other scripts and languages, whichever is nearest.
    """
    model = fit(training_rows(train, train_key, text, lang, per_language, order, most_languages), landmarks, ridge, order)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded by the landmarks

    def make():
        score = shared.value.scorer() if shared.value else None

        def each(texts):
            preds, tops, shares = [], [], []
            for at in range(0, len(texts), 256):
                part = texts[at : at + 256]
                if score is None:
                    preds += [UNKNOWN] * len(part)
                    tops += [0.0] * len(part)
                    shares += [0.0] * len(part)
                    continue
                values, known, familiar = score(part)
                best = values.argmax(axis=1)
                preds += [shared.value.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                tops += np.where(known, np.clip((values.max(axis=1) + 1) / 2, 0, 1), 0).astype(float).tolist()
                shares += np.where(known, familiar, 0).astype(float).tolist()
            return [preds, tops, shares]

        return each

    return map_texts(keyed(documents, key, text), [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("familiar", T.DoubleType())], make, key)
