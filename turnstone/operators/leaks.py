"""Which of many secrets still stand in any of many texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut

#: Bytes of the windows by which texts and secrets meet.
WIDTHS = (1, 2, 4, 8, 16, 32)
#: The filter of the secrets' windows has so many bits for each of them, but at most 2**BITS (8 MB): beyond, more windows pass, which costs time, not results.
BITS_EACH, BITS, PROBES = 512, 26, 3
#: Bytes of texts that are looked at together.
SLICE = 1 << 20
#: Bytes of secrets, or of what was found, that go to all tasks; more are joined, secrets in SALTS places each.
SENT, SALTS = 32 << 20, 16
_MASK = (1 << 64) - 1


def window_hashes(data: np.ndarray, widths: Iterable[int] = WIDTHS) -> Iterator[tuple[int, np.ndarray]]:
    """(width, numbers) for ascending widths (powers of two): a number for every `width` neighbouring bytes, equal for equal bytes."""
    h, w, base = data.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    for width in widths:
        while w < width:
            h = h[:-w] * np.uint64(base) + h[w:]
            w, base = 2 * w, base * base & _MASK
        yield width, (h ^ np.uint64(width)) * np.uint64(0xBF58476D1CE4E5B9)


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def _anchors(secrets: DataFrame) -> DataFrame:
    """(secret, width, hash) of distinct secrets: the widest window that fits, from their middle, as many begin or end alike."""

    def middle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for secret in f["secret"]:
                data = _bytes(secret)
                width = max(w for w in WIDTHS if w <= len(data))
                at = (len(data) - width) // 2
                ((_, h),) = window_hashes(data[at : at + width], [width])
                rows.append((secret, width, int(h.view(np.int64)[0])))
            yield pd.DataFrame(rows, columns=["secret", "width", "hash"])

    some = secrets.select("secret").where("secret <> ''").distinct()
    return some.mapInPandas(middle, "secret string, width int, hash long")


def _place(h: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The k-th places of hashes in the filter."""
    return (h * np.uint64(0x94D049BB133111EB * (2 * k + 1) & _MASK)) >> np.uint64(64 - bits)


def _filter(anchors: DataFrame, bits: int) -> np.ndarray:
    """The bits of all anchors' hashes, put together on the executors."""

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in range(PROBES):
                yield pd.DataFrame({"at": _place(f["hash"].to_numpy().view(np.uint64), k, bits).astype(np.int64)})

    words = anchors.select("hash").mapInPandas(places, "at long").groupBy(F.expr("shiftright(at, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits"))
    out = np.zeros(1 << (bits - 6), np.uint64)
    for row in words.toLocalIterator():  # 2**(BITS - 6) rows at most
        out[row.word] = row.bits & _MASK
    return out


def _candidates(texts: DataFrame, widths: list[int], held: np.ndarray, bits: int) -> DataFrame:
    """(mark, hash) of the texts' windows that may be anchors."""

    def pieces(frame: pd.DataFrame) -> Iterator[tuple[list[str], list[np.ndarray]]]:
        """Texts' marks and bytes, together about a slice; long texts in overlapping slices."""
        marks, parts, size, more = [], [], 0, widths[-1] - 1
        for mark, text in zip(frame["mark"], frame["text"]):
            data = _bytes(text)
            for lo in range(0, len(data), SLICE):
                part = data[lo : lo + SLICE + more]
                marks.append(mark)
                parts.append(part)
                size += len(part)
                if size >= SLICE:
                    yield marks, parts
                    marks, parts, size = [], [], 0
        if parts:
            yield marks, parts

    def passing(parts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ends = np.cumsum([len(p) for p in parts])
        for width, h in window_hashes(np.concatenate(parts), widths):
            at = None
            for k in range(PROBES):
                place = _place(h if at is None else h[at], k, bits)
                ok = np.flatnonzero((held[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1))
                at = ok if at is None else at[ok]
            text = np.searchsorted(ends, at, side="right")
            inside = at + width <= ends[text]  # no windows across texts
            yield text[inside], h[at[inside]].view(np.int64)

    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for marks, parts in pieces(f) if widths else ():
                for text, h in passing(parts):
                    if len(h):
                        yield pd.DataFrame({"mark": np.array(marks, object)[text], "hash": h}).drop_duplicates()

    return texts.mapInPandas(windows, "mark string, hash long").distinct()


def search(texts: DataFrame, secrets: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, secret): every secret (column secret) that a text holds, as it is written, once for each row of texts.

    Null and empty texts hold nothing; null and empty secrets are held by nothing; repeated secrets count once, repeated rows of texts each; keys may
    be null. Texts are read in slices, so that long ones take bounded memory, and no pair of a text and a secret is made unless they share the window
    from the secret's middle; what remains is looked up in the text. Other columns don't matter.
    """
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text <> ''").withColumn("mark", F.sha2("text", 256))
    anchors = cut(_anchors(secrets))
    widths = sorted(r.width for r in anchors.select("width").distinct().collect())  # WIDTHS at most
    weight = lambda d, more: d.agg(F.coalesce(F.sum(F.octet_length("secret") + more), F.lit(0)), F.count("*")).first()
    size, n = weight(anchors, 64)
    bits = min(BITS, max(16, (BITS_EACH * n).bit_length()))
    met = _candidates(rows.select("mark", "text"), widths, _filter(anchors, bits), bits)
    if size <= SENT:
        pairs = met.join(F.broadcast(anchors.select("hash", "secret")), "hash")
    else:  # a window that many texts hold is dealt by the text
        spread = anchors.select("hash", "secret", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        pairs = met.withColumn("salt", F.pmod(F.xxhash64("mark"), F.lit(SALTS)).cast("int")).join(spread, ["hash", "salt"])
    pairs = cut(pairs.select("mark", "secret"))
    few = weight(pairs, 128)[0] <= SENT
    held = rows.join(F.broadcast(pairs) if few else pairs, "mark").where(F.contains("text", "secret"))
    return held.select(F.col("key").alias(key), "secret")
