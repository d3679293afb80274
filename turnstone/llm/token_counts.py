"""Token counts of whole texts by a public sentencepiece model (operator 3).

Two tiers, both on the map side, and no shuffle of pre-tokens: a broadcast table holds the token
counts of frequent pre-tokens; the rest is encoded once per worker and kept in a bounded cache.
The tables decide speed only: every count is the library's own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE = "\n"


class PreTokens:
    """Counts tokens by pre-tokens: a line's words, the first with the line break before it.

    A model can be cut there if no piece has a word mark after another character and none holds a
    line break; others encode the whole text. Texts that hold the word mark itself, or runs of
    spaces, are counted as the same marks.
    """

    def __init__(self, model_file: str, frequent: dict[str, int], cache_size: int):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.cuts = not any(re.search("[^▁]▁|\n", p) for p in pieces) and self._plain()
        #: one word mark with nothing after it, as before a line break
        self.frequent = {"": len(self.model.encode(LINE)) - 1, **frequent}
        self.counts, self.most = dict(self.frequent), len(frequent) + cache_size

    def _plain(self) -> bool:
        """Whether white space is kept and a mark put before each text, as the cutting assumes."""
        encode = self.model.encode
        return encode("a  b", out_type=str) == ["▁a", "▁", "▁b"] and encode(" a", out_type=str) == ["▁", "▁a"] and not encode("") and len(encode("\na")) == 1 + len(encode("\n"))

    def encoded(self, tokens: list[str]) -> list[int]:
        """Counts of pre-tokens; those that start with a line break count without the mark before it."""
        return [len(x) - (t[0] == LINE) for t, x in zip(tokens, self.model.encode(tokens, num_threads=1))]

    def learn(self, tokens: list[str]) -> dict[str, int]:
        """The counts of new pre-tokens, kept for later texts; a full cache starts anew."""
        if len(self.counts) + len(tokens) > self.most:
            self.counts = dict(self.frequent)
        fresh = dict(zip(tokens, self.encoded(tokens)))
        if len(self.counts) + len(fresh) <= self.most:
            self.counts.update(fresh)
        return fresh

    def split(self, text: str) -> list[str]:
        """Pre-tokens whose counts add up to the text's. Each has a mark before it but for those that
        start with a line break; k marks with nothing after them are k - 1 spaces."""
        parts = text.replace("▁", " ").replace(LINE, " " + LINE).split(" ")
        if "" not in parts:
            return parts
        out, marks = [], 0
        for p in parts:
            if not p:
                marks += 1
            elif p[0] == LINE:
                out += [" " * (marks - 1), p] if marks else [p]
                marks = 0
            else:
                out.append(" " * marks + p)
                marks = 0
        return [*out, " " * (marks - 1)] if marks else out

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.cuts:
            return len(self.model.encode(text, num_threads=1))
        tokens = self.split(text)
        get = self.counts.get
        found = list(map(get, tokens))
        if None not in found:
            return sum(found)
        missing = [t for t, n in zip(tokens, found) if n is None]
        fresh = self.learn(list({t for t in missing if len(t) <= 200}))
        long = [t for t in missing if len(t) > 200]  # such junk is not worth a place in the cache
        return sum(n for n in found if n is not None) + sum(fresh[t] for t in missing if len(t) <= 200) + sum(self.encoded(long))


def frequent_pretokens(docs: DataFrame, model_file: str, sample_rows: int, size: int, text: str = "text") -> dict[str, int]:
    """Counts of the most frequent pre-tokens of a bounded sample; a cache's warm start, nothing else."""
    rows = docs.count()  # from the files' footers
    words = (
        docs.select(F.col(text).alias("t")).sample(min(1.0, 2 * sample_rows / max(rows, 1)), 5).limit(sample_rows)
        .select(F.explode(F.split(F.regexp_replace("t", "\n", " \n"), " ")).alias("w"))
        .where((F.length("w") > 0) & (F.length("w") <= 40) & ~F.col("w").contains("▁"))
    )
    top = [r.w for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(size).collect()]
    counter = PreTokens(model_file, {}, size)
    if top and counter.cuts:
        counter.learn(top)
    return counter.counts


def token_counts(docs: DataFrame, model_file: str, text: str = "text", n_tokens: str = "n_tokens", sample_rows: int = 2000, table_size: int = 50_000, cache_size: int = 400_000) -> DataFrame:
    """docs with the column n_tokens: the library's token count of each whole text.

    No begin, end or special tokens are added and special strings are ordinary text. Null and empty
    texts have 0 tokens; repeated rows and other columns are kept as they are, and an existing
    column n_tokens is replaced. An empty table gives an empty table. sample_rows bounds the rows that the
    frequent table is taken from, table_size that table, cache_size each worker's cache.
    """
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_pretokens(docs, model_file, sample_rows, table_size, text))
    docs = docs.drop(n_tokens)
    schema = docs.select("*", F.lit(0).cast("long").alias(n_tokens)).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PreTokens(model_file, frequent.value, cache_size)
        for batch in batches:
            counts = [counter.count(t.as_py() or "") for t in batch.column(batch.schema.names.index(text))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=[*batch.schema.names, n_tokens])

    return docs.mapInArrow(count, schema)
