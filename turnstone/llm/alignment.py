"""Alignment of two tokenizers over a corpus (operator 13).

A first pass aligns every text and counts, in its tasks, which tokens of A and B end together. The distinct pairs get a
minimal perfect hash: they are dealt to buckets of bounded size, and in each bucket levels of bits give every key a place of
its own, its rank among the bits that are set. Counts are dense vectors indexed by that hash, summed as a tree (parts of a bucket,
then the bucket); the keys lie beside them in the same order, so that a lookup is verified. A second pass
aligns the texts again and looks the counts up. Tables up to a stated size go to all tasks; larger ones stay
where they are, and the second pass' pairs are joined with them instead.

Texts are aligned by segments where both tokenizers are known to cut (one space between two other characters),
and a worker keeps the segments it has seen; other texts and tokenizers are aligned whole.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .words import mix, slices

U = np.uint64
#: Pairs of a bucket, about; parts of a bucket's sum; pairs that a task counts before it hands them on.
BUCKET, PARTS, HELD = 1 << 15, 16, 1 << 20
_MARK = "▁"
#: Pre-tokens of byte-level vocabularies (fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space between two characters that are white space in no reading.
_CUT = re.compile(r"(?<=[^\s\x1c-\x1f\x85]) (?=[^\s\x1c-\x1f\x85])")


def _grown(array: np.ndarray, n: int) -> np.ndarray:
    return array if n <= len(array) else np.concatenate([array, np.zeros((max(n, 2 * len(array)) - len(array), *array.shape[1:]), array.dtype)])


class Aligner:
    """Alignments of segments of texts under a tokenizers file (A) and a sentencepiece model (B), kept by slot.

    ok: whether both give the segment back; sizes: tokens of A, of B, and links; groups: as text; pairs from first[slot] to
    first[slot + 1]: the links, as A id * width + B id.
    """

    def __init__(self, a_file: str, b_file: str, most: int = 300_000, most_chars: int = 1 << 25):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        self.width = self.b.get_piece_size()
        to_byte = {c: b for b, c in _byte_letters().items()}
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (1 + max(vocabulary.values()))
        for entry, i in vocabulary.items():
            self.a_bytes[i] = bytes(to_byte[c] for c in entry) if all(c in to_byte for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.width)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in table]) for table in (self.a_bytes, self.b_bytes))
        #: Ids as text: of A with ',' and '|' after them, of B with ',' and ';'.
        self.names = [f"{i}{after}" for n, afters in ((len(self.a_bytes), ",|"), (self.width, ",;")) for after in afters for i in range(n)]
        a = json.loads(self.a.to_str())
        self.cuts = self._cuts(a, pieces)
        self.fast = self._same_as_ranks(a) if self.cuts else None
        self.most, self.most_chars = most, most_chars
        self.clear()

    def _cuts(self, a: dict, pieces: list[str]) -> bool:
        """Whether both cut before a single space between two other characters: A by its pre-tokens, B as no piece has a mark after another character."""
        pre, encode = a["pre_tokenizer"] or {}, self.b.encode
        plain = encode("a  b", out_type=str) == ["▁a", "▁", "▁b"] and encode(" a", out_type=str) == ["▁", "▁a"]
        return pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and a["normalizer"] is None and plain and not any(re.search(f"[^{_MARK}]{_MARK}", p) for p in pieces)

    def _same_as_ranks(self, a: dict):
        """The same tokenizer as ranks, several times as fast on rare words: if its ids number its bytes and then its merges."""
        vocabulary, merges = a["model"]["vocab"], a["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        plain = a["model"]["type"] == "BPE" and not any(a["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not plain or any(vocabulary.get(x + y) != 256 + i for i, (x, y) in enumerate(pairs)):
            return None
        import tiktoken

        special = {t["content"] for t in a["added_tokens"]}
        ranks = {self.a_bytes[i]: i for entry, i in vocabulary.items() if entry not in special}
        return tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == 256 + len(pairs) else None

    def clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.groups: list[str] = []
        self.ok, self.sizes, self.first, self.pairs, self.chars = np.zeros(0, bool), np.zeros((0, 3), np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64), 0

    @property
    def full(self) -> bool:
        return len(self.slots) > self.most or self.chars > self.most_chars

    def _add(self, segments: list[str]) -> None:
        """Slots for new segments."""
        for i in range(0, len(segments), 4000):
            some = segments[i : i + 4000]
            long = [s for s in some if not self.fast or len(s) > 100]
            found = dict(zip(long, (x.ids for x in self.a.encode_batch([" " + s for s in long], add_special_tokens=False))))
            a = [found[s] if s in found else self.fast.encode_ordinary(" " + s) for s in some] if len(found) < len(some) else [found[s] for s in some]
            self._align(some, a, self.b.encode(some, num_threads=1))

    def _align(self, segments: list[str], a: list[list[int]], b: list[list[int]]) -> None:
        texts = [(" " + s).encode() for s in segments]
        n, at = len(segments), len(self.groups)
        sizes = np.array([list(map(len, x)) for x in (a, b, texts)])
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b))
        good = np.ones(n, bool)
        joined = b"".join(texts)
        bounds = [np.concatenate([[0], np.cumsum(k)]) for k in sizes[:2]]
        spans = [np.concatenate([[0], np.cumsum(table[x])])[c] for table, x, c in ((self.a_sizes, flat_a, bounds[0]), (self.b_sizes, flat_b, bounds[1]))]
        if any((np.diff(x) != sizes[2]).any() for x in spans) or any(b"".join(map(table.__getitem__, x.tolist())) != joined for table, x in ((self.a_bytes, flat_a), (self.b_bytes, flat_b))):
            good = np.array([b"".join(map(self.a_bytes.__getitem__, x)) == t == b"".join(map(self.b_bytes.__getitem__, y)) for t, x, y in zip(texts, a, b)])
            flat_a, flat_b = flat_a[np.repeat(good, sizes[0])], flat_b[np.repeat(good, sizes[1])]
        ends_a, ends_b = np.cumsum(self.a_sizes[flat_a]), np.cumsum(self.b_sizes[flat_b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)  # no token is empty, so each has an end of its own
        in_a, in_b = np.searchsorted(ends_a, common), np.searchsorted(ends_b, common)
        links = np.diff(np.searchsorted(common, np.concatenate([[0], np.cumsum(np.where(good, sizes[2], 0))]), "right"))
        # tokens of both by group, those of A first, each with what follows it
        last_a, last_b = np.zeros(len(flat_a), bool), np.zeros(len(flat_b), bool)
        last_a[in_a], last_b[in_b] = True, True
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        n_a, n_b = len(self.a_bytes), self.width
        codes = np.concatenate([flat_a + n_a * last_a, 2 * n_a + flat_b + n_b * last_b])
        codes = codes[np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")].tolist()
        to = np.cumsum(np.where(good, sizes[0] + sizes[1], 0)).tolist()
        named = list(map(self.names.__getitem__, codes))
        self.groups += ["".join(named[i:j])[:-1] for i, j in zip([0, *to[:-1]], to)]
        self.ok, self.sizes, self.first = _grown(self.ok, at + n), _grown(self.sizes, at + n), _grown(self.first, at + n + 1)
        self.ok[at : at + n] = good
        self.sizes[at : at + n] = np.stack([sizes[0], sizes[1], links], 1)
        self.first[at + 1 : at + n + 1] = self.first[at] + np.cumsum(links)
        self.pairs = _grown(self.pairs, self.first[at + n])
        self.pairs[self.first[at] : self.first[at + n]] = flat_a[in_a] * self.width + flat_b[in_b]
        for k, s in enumerate(segments):
            self.slots[s] = at + k
            self.chars += len(s)

    def place(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The slots of the texts' segments, and where each text's begin and end in them; a text without tokens has none."""
        cut = [(_CUT.split(t) if self.cuts else [t]) if t else [] for t in texts]
        slots = self.slots
        self._add(list({s for parts in cut for s in parts if s not in slots}))
        found = np.fromiter(map(slots.__getitem__, chain.from_iterable(cut)), np.int64)
        if not self.ok[found].all():
            for k, (text, parts) in enumerate(zip(texts, cut)):
                if not all(self.ok[slots[s]] for s in parts):  # the whole text decides
                    if text not in slots:
                        self._add([text])
                    cut[k] = [text] if self.ok[slots[text]] else []
            found = np.fromiter(map(slots.__getitem__, chain.from_iterable(cut)), np.int64)
        return found, np.cumsum([0, *map(len, cut)])

    def links(self, slots: np.ndarray) -> np.ndarray:
        """The links of the slots, in order."""
        n = self.sizes[slots, 2]
        return self.pairs[np.repeat(self.first[slots] - np.cumsum(n) + n, n) + np.arange(n.sum())]


@functools.lru_cache(1)
def _aligner(a_file: str, b_file: str) -> Aligner:
    """One for each worker, kept from task to task."""
    return Aligner(a_file, b_file)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


# --- minimal perfect hashing ---
def _places(keys: np.ndarray, level: int, n: int) -> np.ndarray:
    return (mix(keys.astype(U) * U(0x9E3779B97F4A7C15) + U(level + 1)) % U(n)).astype(np.int64)


def build_hash(keys: np.ndarray) -> list[np.ndarray]:
    """The minimal perfect hash of distinct keys: levels of places, each with an index of its own or -1.

    A key has a place on the first level where no other key that is still without one falls on it.
    """
    levels, before = [], 0
    while len(keys):
        n = 2 * len(keys)
        at = _places(keys, len(levels), n)
        alone = np.bincount(at, minlength=n) == 1
        levels.append(np.where(alone, before + np.cumsum(alone) - 1, -1).astype(np.int32))
        before += int(alone.sum())
        keys = keys[~alone[at]]
    return levels


def hash_index(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The keys' indexes, 0 to n - 1. A key that wasn't among those of the hash gets any index, or -1."""
    out = np.full(len(keys), -1, np.int64)
    for level, ranks in enumerate(levels):
        todo = np.flatnonzero(out < 0)
        if not len(todo):
            break
        out[todo] = ranks[_places(keys[todo], level, len(ranks))]
    return out


def n_buckets(pairs: int) -> int:
    return -(-pairs // BUCKET) | 1  # odd, so that both ids of a pair matter


class Table:
    """Counts by key: a perfect hash for each bucket, and keys and counts in its order. best: the highest count of each B id."""

    def __init__(self, rows: list[tuple[int, bytes, bytes]], buckets: int, best: np.ndarray):
        """rows: (bucket, keys, counts) as counted() gives them."""
        self.keys, self.counts = ([np.zeros(0, np.int64)] * buckets for _ in "kc")
        for b, keys, counts in rows:
            self.keys[b], self.counts[b] = np.frombuffer(keys, np.int64), np.frombuffer(counts, np.int64)
        self.levels, self.best = [build_hash(k) for k in self.keys], best

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        """The keys' counts; a key without one raises."""
        distinct, back = np.unique(keys, return_inverse=True)
        of, out = distinct % len(self.keys), np.empty(len(distinct), np.int64)
        for b in np.unique(of).tolist():
            mine = np.flatnonzero(of == b)
            at = hash_index(self.levels[b], distinct[mine])
            if (at < 0).any() or (self.keys[b][at] != distinct[mine]).any():
                raise KeyError("a pair that the first pass hasn't counted")
            out[mine] = self.counts[b][at]
        return out[back]


def _batch(names: list[str], *columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=names)


def pair_counts(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """(pair, n): how often the texts' links hold each pair, summed in each task; a pair may have rows of several tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, none = _aligner(a_file, b_file), np.zeros(0, np.int64)
        kept, times = (none, none), none

        def summed() -> tuple[np.ndarray, np.ndarray]:
            n = np.repeat(times, aligner.sizes[: len(times), 2])
            both, at = np.unique(np.concatenate([kept[0], aligner.pairs[: len(n)][n > 0]]), return_inverse=True)
            return both, np.bincount(at, np.concatenate([kept[1], n[n > 0]]), len(both)).astype(np.int64)

        for batch in slices(batches):
            slots, _ = aligner.place(batch.column(0).to_pylist())
            times = _grown(times, len(aligner.groups))
            times += np.bincount(slots, minlength=len(times))
            if aligner.full:
                times = times[: len(aligner.groups)]
                kept, times = summed(), none
                aligner.clear()
            if len(kept[0]) > HELD:
                yield _batch(["pair", "n"], *kept)
                kept = (none, none)
        times = times[: len(aligner.groups)]
        yield _batch(["pair", "n"], *summed())

    return docs.mapInArrow(count, "pair long, n long")


def counted(parts: DataFrame, pairs: int) -> DataFrame:
    """(bucket, keys, counts): of every bucket its distinct keys in the order of its perfect hash, and the dense vector of their counts."""
    buckets = n_buckets(pairs)

    def hashed(key, rows):
        keys = rows["pair"].to_numpy()
        ordered = np.empty_like(keys)
        ordered[hash_index(build_hash(keys), keys)] = keys
        return pd.DataFrame({"bucket": [key[0]], "keys": [ordered.tobytes()]})

    def vector(key, rows, hashes):
        ordered, pair = np.frombuffer(hashes["keys"][0], np.int64), rows["pair"].to_numpy()
        at = hash_index(build_hash(ordered), pair)
        if (at < 0).any() or (ordered[at] != pair).any():
            raise KeyError("a pair that isn't in its bucket's hash")
        return pd.DataFrame({"bucket": [key[0]], "counts": [np.bincount(at, rows["n"].to_numpy(), len(ordered)).astype(np.int64).tobytes()]})

    def total(key, rows):
        return pd.DataFrame({"bucket": [key[0]], "counts": [sum(np.frombuffer(c, np.int64) for c in rows["counts"]).tobytes()]})

    rows = parts.withColumn("bucket", F.col("pair") % buckets)
    keys = written(rows.select("bucket", "pair").distinct().groupBy("bucket").applyInPandas(hashed, "bucket long, keys binary"), "pair-keys")
    rows = rows.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))  # where a row is summed doesn't change the sum
    each = keys.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    vectors = rows.groupBy("bucket", "part").cogroup(each.groupBy("bucket", "part")).applyInPandas(vector, "bucket long, counts binary")
    return keys.join(vectors.groupBy("bucket").applyInPandas(total, "bucket long, counts binary"), "bucket")


def align(docs: DataFrame, a_file: str, b_file: str, text: str = "text", most_pairs: int = 1_000_000) -> DataFrame:
    """docs without the text, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    A encodes space + text, B the text (and adds the space itself), both without special tokens, whose strings are plain text.
    Offsets where tokens of both end cut them into groups; the last tokens of a group are a link. A pair's
    count is how many links of the whole corpus hold it; n_best: links whose count is the highest of their B id, count_sum: the sum
    of the links' counts. groups_sha256: hex sha256 of the groups as `a1,a2|b1;a3|b2,b3`.

    Null and empty texts, and those whose tokens don't give space + text back byte by byte, have no tokens: zeros, and ''.
    Repeated rows each get a row and each count; texts of any length are taken whole; other columns are kept (one with the
    name of a new column is replaced). An empty table gives an empty one. Up to most_pairs distinct pairs
    (16 bytes each, and the hash) go to all tasks; more are joined with the links instead.
    """
    spark = docs.sparkSession
    width = Aligner(a_file, b_file).width
    parts = written(pair_counts(docs.select(text), a_file, b_file), "pair-parts")
    pairs = parts.agg(F.count_distinct("pair")).first()[0]
    table = written(counted(parts, pairs), "pair-counts")
    fixed, new = ["n_a", "n_b", "n_groups", "n_links"], ["n_best", "count_sum"]
    keep = [c for c in docs.columns if c not in [*fixed, *new, "groups_sha256", text]]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(text).alias("text"))

    def loose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair, n in zip(*(c.to_pylist() for c in batch.columns)):
                yield _batch(["pair", "n"], np.frombuffer(pair, np.int64), np.frombuffer(n, np.int64))

    flat = table.select("keys", "counts").mapInArrow(loose, "pair long, n long")
    highest = flat.groupBy((F.col("pair") % width).alias("b")).agg(F.max("n").alias("high"))
    lookup = None
    if pairs <= most_pairs:
        best = np.zeros(width, np.int64)
        for r in highest.collect():  # at most one for each entry of B's vocabulary
            best[r.b] = r.high
        lookup = spark.sparkContext.broadcast(Table([tuple(r) for r in table.select("bucket", "keys", "counts").collect()], n_buckets(pairs), best))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, scores, scored = _aligner(a_file, b_file), np.zeros((0, 2), np.int64), np.zeros(0, bool)
        for batch in slices(batches):
            if aligner.full:
                aligner.clear()
                scored[:] = False
            slots, ends = aligner.place(batch.column(1).to_pylist())
            numbers = aligner.sizes[slots]
            if lookup:  # of the segments of this task's texts; the worker may know others
                scores, scored = _grown(scores, len(aligner.groups)), _grown(scored, len(aligner.groups))
                new = np.unique(slots[~scored[slots]])
                pair = aligner.links(new)
                n = lookup.value[pair]
                sums = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(np.stack([n == lookup.value.best[pair % width], n], 1), 0)])
                at = np.concatenate([[0], np.cumsum(aligner.sizes[new, 2])])
                scores[new], scored[new] = sums[at[1:]] - sums[at[:-1]], True
                numbers = np.concatenate([numbers, scores[slots]], 1)
            sums = np.concatenate([np.zeros((1, numbers.shape[1]), np.int64), np.cumsum(numbers, 0)])
            a, b, links, *more = (sums[ends[1:]] - sums[ends[:-1]]).T
            if not lookup:
                more = [pa.LargeListArray.from_arrays(sums[ends, 2], pa.array(aligner.links(slots))).cast(pa.list_(pa.int64()))]
            text_of, order = aligner.groups.__getitem__, slots.tolist()
            digests = [hashlib.sha256(";".join(map(text_of, order[i:j])).encode()).hexdigest() if j > i else "" for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield _batch(schema.names, batch.column(0), a, b, links, links, *more, pa.array(digests, pa.string()))

    zeros = lambda *cs: [F.lit(0).cast("long").alias(c) for c in cs]
    if lookup:
        schema = rows.select("row", *zeros(*fixed, *new), F.lit("").alias("groups_sha256")).schema
        found = rows.mapInArrow(second, schema)
    else:
        schema = rows.select("row", *zeros(*fixed), F.lit(None).cast("array<long>").alias("links"), F.lit("").alias("groups_sha256")).schema
        held = written(rows.mapInArrow(second, schema).withColumn("r", F.monotonically_increasing_id()), "aligned")
        once = held.select("r", F.explode("links").alias("pair")).groupBy("r", "pair").agg(F.count("*").alias("times"))
        scored = flat.withColumn("b", F.col("pair") % width).join(highest, "b").select("pair", "n", (F.col("n") == F.col("high")).cast("long").alias("is_best"))
        sums = once.join(written(scored, "pair-scores"), "pair").groupBy("r").agg(F.sum(F.col("times") * F.col("is_best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        found = held.drop("links").join(sums, "r", "left").fillna(0, new)
    return found.select(*(F.col(f"row.`{c}`") for c in keep), *fixed, *new, "groups_sha256")
