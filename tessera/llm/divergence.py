"""Source divergence audit: how far each source's word use lies from every other's, by two-dimensional group-block tiling.

A group is a (lang, source) pair; its vector holds the counts of its language's kept
terms. Vectors are packed by vocabulary chunk: one row of places and counts for each
group and chunk, without zeros. Groups of a language fall into about sqrt(G) blocks, of
BLOCK groups at most on average; the packed vectors are replicated to the tiles of their block
with every block, and a tile's task walks through the vocabulary chunk by chunk, holding
one chunk of two blocks and its part of the pair matrix. So neither a language's
vocabulary nor its pairs meet in one task, and a hot source is one vector like others.

Counting comes before the first shuffle: a task sums the words of its own texts and hands
on (lang, source, term, count, documents) whenever it holds HELD terms. Long texts are
read in slices that end between words.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import utf8, write_scratch

#: Runs of letters A-Z, a-z and of everything beyond ASCII, as bytes of UTF-8.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
BREAK = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
LEAST_DOCUMENTS = 30
SCALE, PRIOR = 1_000_000_000, 5
TOP_TERMS = 50
#: Terms a chunk of the vocabulary has, most groups a block has on average, distinct terms a counting task holds, bytes of a slice of text.
CHUNK, BLOCK, HELD, SLICE = 1024, 256, 400_000, 1 << 20


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a slice at a time."""
    at = 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            stop = BREAK.search(text, end)
            end = stop.start() if stop else len(text)
        yield TERM.findall(text[at:end].lower())
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, documents = defaultdict(Counter), defaultdict(Counter)

    def handed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), each in counts.items():
            terms = list(each)
            for i in range(0, len(terms), 20_000):
                part = terms[i : i + 20_000]
                n = len(part)
                columns = [[lang] * n, [source] * n, pa.array(part, pa.binary()).cast(pa.string()), [each[t] for t in part], [documents[lang, source][t] for t in part]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c for c, t in zip(columns, (pa.string(), pa.string(), None, pa.int64(), pa.int64()), strict=True)], ["lang", "source", "term", "count", "documents"])
        counts.clear()
        documents.clear()

    held = 0
    for batch in batches:
        data, ends = utf8(batch.column("text"))
        for i, (lang, source) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)):
            mine, seen = counts[lang, source], set()
            held -= len(mine)
            for part in _words(data[ends[i] : ends[i + 1]].tobytes()):
                mine.update(part)
                seen.update(part)
            documents[lang, source].update(seen)
            held += len(mine)
            if held > HELD:
                yield from handed_on()
                held = 0
    yield from handed_on()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, documents: occurrences of each term in each group, and how many of its documents have it."""
    counted = _plain(docs).mapInArrow(_counted, "lang string, source string, term string, count long, documents long")
    # the tasks have summed already, so rows are dealt as they come and summed once
    return counted.repartition("lang", "source", "term").groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("documents").alias("documents"))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])


def share(count: Column | str, total: Column | str, terms: Column | str) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exactly."""
    wide = lambda x: (F.col(x) if isinstance(x, str) else x).cast("decimal(20,0)")
    above, below = (wide(count) + PRIOR) * F.lit(SCALE), wide(total) + wide(terms) * PRIOR
    return (F.call_function("div", above, below) + 1).cast("long")


def _shares(count: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The same in 64-bit integers, three digits of the quotient at a time: exact while ``below`` is under 9e15."""
    above = count + PRIOR
    out = above // below
    for _ in range(3):
        above = (above % below) * 1000
        out = out * 1000 + above // below
    return out + 1


class _Tile:
    """The part of a language's pair matrix of two blocks of groups."""

    def __init__(self, rows: list[dict]):
        self.own = rows[0]["one"] == rows[0]["other"]
        self.lang = rows[0]["lang"]
        self.sides = [[r for r in rows if r["block"] == rows[0][side]] for side in ("one", "other")]
        self.names = [[r["source"] for r in side] for side in self.sides]
        self.place = [{name: i for i, name in enumerate(side)} for side in self.names]
        self.terms = rows[0]["terms"]
        self.below = [np.array([max(r["total"] + PRIOR * self.terms, 1) for r in side], np.int64) for side in self.sides]
        self.none = [_shares(np.zeros_like(b), b) for b in self.below]
        self.apart = np.abs(self.none[0][:, None] - self.none[1][None, :]) * self.terms

    def add(self, rows: list[dict]) -> None:
        """Take in one chunk of the vocabulary; terms that no group here has are in ``apart`` already."""
        places = np.unique(np.concatenate([np.asarray(r["places"], np.int64) for r in rows]))
        full = [np.repeat(none[:, None], len(places), 1) for none in self.none]
        for r in rows:
            for side in (0, 1):
                i = self.place[side].get(r["source"])
                if i is not None:
                    at = np.searchsorted(places, np.asarray(r["places"], np.int64))
                    full[side][i, at] = _shares(np.asarray(r["counts"], np.int64), self.below[side][i])
        for i, row in enumerate(full[0]):
            self.apart[i] += np.abs(full[1] - row).sum(1) - len(places) * np.abs(self.none[1] - self.none[0][i])

    def pairs(self) -> pa.RecordBatch:
        a, b = np.meshgrid(*[np.arange(len(side)) for side in self.names], indexing="ij")
        a, b, value = a.ravel(), b.ravel(), self.apart.ravel()
        if self.own:
            a, b, value = (x[a != b] for x in (a, b, value))
            left, right = a, b
            names = [[self.names[0][i] for i in left], [self.names[1][i] for i in right]]
        else:
            names = [[self.names[0][i] for i in a] + [self.names[1][i] for i in b], [self.names[1][i] for i in b] + [self.names[0][i] for i in a]]
            value = np.concatenate([value, value])
        return pa.RecordBatch.from_arrays([pa.array([self.lang] * len(value), pa.string()), pa.array(names[0], pa.string()), pa.array(names[1], pa.string()), pa.array(value)], ["lang", "source", "item", "value"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tile and chunk; chunk -1 names the groups of the tile."""
    rows = (row for batch in batches for i in range(0, len(batch), 32) for row in batch.slice(i, 32).to_pylist())
    for _, tile in groupby(rows, key=lambda r: (r["lang"], r["one"], r["other"])):
        matrix = None
        for chunk, part in groupby(tile, key=lambda r: r["chunk"]):
            if chunk < 0:
                matrix = _Tile(list(part))
            else:
                matrix.add(list(part))
        yield matrix.pairs()


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: sources apart (part ``pair``) and the terms a source uses more than its language (part ``term``).

    A null text, lang or source reads as ''. A language keeps the terms found in at least
    LEAST_DOCUMENTS of its documents; a group without terms still has pairs; a language
    that keeps none has pairs of value 0. Ties of a value go by the item's UTF-8 bytes.
    Repeated rows count again; other columns are ignored; an empty table gives an empty
    result. All arithmetic is in integers, exact below 1.8e15 words and terms a group.
    """
    plain = _plain(docs)
    counted = write_scratch(term_counts(docs), "terms")
    vocabulary = counted.groupBy("lang", "term").agg(F.sum("count").alias("lang_count"), F.sum("documents").alias("documents")).where(F.col("documents") >= LEAST_DOCUMENTS).drop("documents")
    vocabulary = write_scratch(vocabulary, "vocabulary")
    languages = vocabulary.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_count").alias("lang_total"))
    kept = write_scratch(counted.drop("documents").join(vocabulary, ["lang", "term"]), "kept")
    totals = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = plain.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(languages, "lang", "left")
    groups = write_scratch(groups.fillna(0, ["total", "terms", "lang_total"]), "groups")

    # what a group uses more than its language: no more than the first ranks of each group leave a task
    more = kept.join(groups, ["lang", "source"]).withColumn("p", share("count", "total", "terms")).withColumn("q", share("lang_count", "lang_total", "terms")).where("p > q")
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    more = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    more = more.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TOP_TERMS)

    apart = _apart(kept, vocabulary, groups)
    pairs = apart.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
    return pairs.unionByName(more)


def _apart(kept: DataFrame, vocabulary: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: each pair of groups of a language, both ways."""
    blocks = groups.groupBy("lang").agg(F.count("*").alias("n")).select("lang", F.greatest(F.ceil(F.sqrt("n")), F.ceil(F.col("n") / BLOCK)).cast("int").alias("blocks"))
    placed = groups.join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    # as many chunks in every language as the largest needs, so that no language's terms meet in one task
    chunks = max(1, -(-(groups.agg(F.max("terms")).first()[0] or 0) // CHUNK))
    numbered = vocabulary.select("lang", "term", F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("int").alias("chunk"))
    numbered = numbered.withColumn("place", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")))
    packed = kept.join(numbered, ["lang", "term"]).groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("place", "count")).alias("_pairs"))
    packed = packed.select("lang", "source", "chunk", F.col("_pairs.place").alias("places"), F.col("_pairs.count").alias("counts"))
    heads = placed.select("lang", "source", F.lit(-1).alias("chunk"), F.lit(None).cast("array<int>").alias("places"), F.lit(None).cast("array<bigint>").alias("counts"))
    columns = ["lang", "source", "block", "blocks", "total", "terms"]
    rows = packed.unionByName(heads).join(placed.select(columns), ["lang", "source"])
    other = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiled = other.select("lang", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("other"), "chunk", "source", "block", "total", "terms", "places", "counts")
    dealt = tiled.repartition("lang", "one", "other").sortWithinPartitions("lang", "one", "other", "chunk", "source")
    return dealt.mapInArrow(_tiles, "lang string, source string, item string, value long")


_SHARE = "1 + CAST(1000000000::HUGEINT * ({} + 5) // ({} + 5 * {}) AS BIGINT)"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents),
w AS (SELECT i, lang, source, unnest(words) AS term FROM d),
v AS (SELECT lang, term, count(*) AS lang_count FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
l AS (SELECT lang, count(*) AS terms, sum(lang_count) AS lang_total FROM v GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN v USING (lang, term) GROUP BY ALL),
g AS (SELECT d.lang, d.source, coalesce(max(t.total), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) t USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, {_SHARE.format("coalesce(c.n, 0)", "g.total", "l.terms")} AS p, {_SHARE.format("v.lang_count", "l.lang_total", "l.terms")} AS q
  FROM g JOIN v USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f
  ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 50
"""
