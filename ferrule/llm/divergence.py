"""Source divergence audit with late string materialization.

How far the term frequencies of a source lie from those of the other sources of its language,
and which terms it uses more than its language does. All arithmetic is on integers and exact.

Counting shuffles a fixed-width 64-bit digest of every term, never the term. A dictionary of the
digests holds the smallest and the largest term of each: where they differ, several terms share
the digest, and only those digests are counted again by their text. Text is joined back for the
rows of the report alone.

A pair of sources sums over all kept terms. A term that one of both lacks has there the share
that the count 0 gives, so the sum is taken apart: terms that neither has, terms that one has
(from the source's histogram of shares, no larger than its number of different counts), and a
correction for each term that both have, made from one sorted stream of (term, source) rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.udf_support import ship_by_value
from ferrule.llm.common import materialise, split_words, text_slices

#: Terms are runs of A-Z, a-z and all of Unicode beyond ASCII; only A-Z are lower-cased. Every other byte separates.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SCALE = 1_000_000_000
#: Counts under this times SCALE fit a long.
NARROW = 9_000_000_000
#: Bytes of texts that are counted together before a task hands their counts on.
HELD = 16_000_000
#: Cells of one block of term-by-source-by-source sums.
CELLS = 2_000_000
#: Parts into which the pairs of a language's sources are dealt.
SALTS = 16

FIELDS = {"lang": "string", "source": "string", "digest": "long", "term": "string", "tf": "long", "df": "long"}


def _scan(docs: DataFrame, columns: tuple[str, ...], digest_bits: int) -> DataFrame:
    """``columns`` of (lang, source, digest, term, tf, df), summed over some MB of texts; without ``lang`` and ``source`` one row a term."""
    mask = (1 << digest_bits) - 1
    grouped = "lang" in columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 2, most=HELD):
            words, size = split_words(part.column(2), TERM_BYTES)
            if not len(words):
                continue
            coded = words.dictionary_encode()
            kinds, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            digest = np.fromiter((xxhash.xxh64_intdigest(t) & mask for t in kinds.to_pylist()), np.uint64, len(kinds)).view(np.int64)
            if not grouped:
                yield pa.RecordBatch.from_pydict({"digest": pa.array(digest), "term": kinds.cast(pa.string())})
                continue
            lang, source = (part.column(i).dictionary_encode() for i in range(2))
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            # One row for each (document, term), then one for each (group, term) with its occurrences and its documents.
            cell, tf = np.unique(np.repeat(np.arange(len(size)), size) * len(kinds) + code, return_counts=True)
            cell = group[cell // len(kinds)] * len(kinds) + cell % len(kinds)
            order = np.argsort(cell, kind="stable")
            cell, tf = cell[order], tf[order]
            edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            term, group = cell[edge] % len(kinds), cell[edge] // len(kinds)
            make = {"lang": lambda: lang.dictionary.take(pa.array(group // len(source.dictionary))),  # noqa: B023
                    "source": lambda: source.dictionary.take(pa.array(group % len(source.dictionary))),  # noqa: B023
                    "digest": lambda: pa.array(digest[term]), "term": lambda: kinds.take(pa.array(term)).cast(pa.string()),  # noqa: B023
                    "tf": lambda: pa.array(np.add.reduceat(tf, edge)), "df": lambda: pa.array(np.diff(np.append(edge, len(cell))))}  # noqa: B023
            yield pa.RecordBatch.from_pydict({c: make[c]() for c in columns})

    named = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return named.mapInArrow(work, ", ".join(f"{c} {FIELDS[c]}" for c in columns))


def _vocabulary(counts: DataFrame, min_docs: int) -> DataFrame:
    """``lang, digest, apart, total``: what at least ``min_docs`` documents of the language hold."""
    sums = counts.groupBy("lang", "digest", "apart").agg(F.sum("c").alias("total"), F.sum("d").alias("docs"))
    return sums.where(F.col("docs") >= min_docs).drop("docs")


def _kept_counts(docs: DataFrame, min_docs: int, digest_bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts of the kept terms, ``lang, source, digest, apart, c, total``; ``lang, digest, apart, total``; the dictionary ``digest, text``.

    ``apart`` is empty, and the term itself where its digest stands for several.
    """
    summed = [F.sum("tf").alias("c"), F.sum("df").alias("d")]
    counts = _scan(docs, ("lang", "source", "digest", "tf", "df"), digest_bits).groupBy("lang", "source", "digest").agg(*summed)
    counts = materialise(counts.withColumn("apart", F.lit("")), "term-counts")
    # Terms that share a digest only add to its documents, so the digest of a kept term is always among these.
    vocabulary = materialise(_vocabulary(counts, min_docs), "vocabulary")
    likely = vocabulary.select("digest").distinct()
    found = _scan(docs, ("digest", "term"), digest_bits).groupBy("digest").agg(F.min("term").alias("text"), F.max("term").alias("last"))
    found = materialise(found.join(likely, "digest", "left_semi"), "term-dictionary")
    shared = found.where("text <> last").select("digest")
    if not shared.isEmpty():
        split = _scan(docs, ("lang", "source", "digest", "term", "tf", "df"), digest_bits).join(shared, "digest", "left_semi")
        split = split.groupBy("lang", "source", "digest", F.col("term").alias("apart")).agg(*summed)
        counts = materialise(counts.join(shared, "digest", "left_anti").unionByName(split), "term-counts-apart")
        vocabulary = materialise(_vocabulary(counts, min_docs), "vocabulary")
    kept = counts.drop("d").join(vocabulary, ["lang", "digest", "apart"])
    kept = materialise(kept.select("lang", "source", "digest", "apart", "c", "total"), "kept-terms")
    return kept, vocabulary, found.select("digest", "text")


def _share(count: str, size: str, kinds: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (size + kinds)), null where nothing is kept."""
    narrow = f"1 + (({count} + 1L) * {SCALE}L) div nullif({size} + {kinds}, 0L)"
    wide = f"1 + (cast({count} + 1L AS decimal(20,0)) * {SCALE}) div nullif({size} + {kinds}, 0L)"
    return F.when(F.expr(f"{count} < {NARROW}L"), F.expr(narrow)).otherwise(F.expr(wide))


def _distance(p: Column, q: Column) -> Column:
    """floor((p - q) * (p - q) / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def _shared_terms(rows: DataFrame) -> DataFrame:
    """``lang, source, other, more``: for the terms that both sources have, what they add over their parts with a count of 0.

    The rows of a term lie together in a sorted stream. Terms of the same number of sources are
    taken as one block of cells, cut to ``CELLS``; each batch hands on one sum a pair.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = (pa.concat_tables([held, table]) if held is not None else table).combine_chunks()
            start = runs(table)
            if len(start) > 1:
                yield from block(table.slice(0, int(start[-1])), start)
            held = table.slice(int(start[-1])) if len(start) else None
        if held is not None and held.num_rows:
            yield from block(held, np.array([0, held.num_rows]))

    def runs(table: pa.Table) -> np.ndarray:
        """Where a term's rows begin."""
        change = np.zeros(max(0, table.num_rows - 1), dtype=bool)
        for name in ("digest", "lang", "apart"):
            column = table.column(name)
            change |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False) if table.num_rows > 1 else change
        return np.concatenate([[0], np.flatnonzero(change) + 1]).astype(np.int64) if table.num_rows else np.zeros(0, np.int64)

    def block(table: pa.Table, edge: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Sums of the whole terms that begin at ``edge[:-1]``."""
        code = {c: table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source")}
        lang, source = ((x.chunk(0) if isinstance(x, pa.ChunkedArray) else x) for x in code.values())
        tongue, place = (x.indices.to_numpy().astype(np.int64) for x in (lang, source))
        p, z = (table.column(c).to_numpy() for c in ("p", "z"))
        kinds, sizes = len(source.dictionary), np.diff(edge)
        for m in np.unique(sizes[sizes > 1]).tolist():
            begin = edge[:-1][sizes == m]
            step = max(1, CELLS // (m * m))
            for lo in range(0, len(begin), step):
                at = begin[lo:lo + step, None] + np.arange(m)
                for i in range(0, m, wide := max(1, CELLS // (len(at) * m))):
                    yield sums(at[:, i:i + wide, None], at[:, None, :], tongue, place, p, z, kinds, lang.dictionary, source.dictionary)

    def sums(one, two, tongue, place, p, z, kinds, langs, sources) -> pa.RecordBatch:
        far = lambda a, b: (a - b) ** 2 // b
        more = far(p[one], p[two]) - far(p[one], z[two]) - far(z[one], p[two]) + far(z[one], z[two])
        pair, which = np.unique(((tongue[one] * kinds + place[one]) * kinds + place[two]).ravel(), return_inverse=True)
        total = np.zeros(len(pair), dtype=np.int64)
        np.add.at(total, which.ravel(), more.ravel())
        apart = pair // kinds % kinds != pair % kinds
        pair, total = pair[apart], total[apart]
        pick = lambda values, index: values.take(pa.array(index)).cast(pa.string())
        return pa.RecordBatch.from_pydict({"lang": pick(langs, pair // kinds // kinds), "source": pick(sources, pair // kinds % kinds),
                                           "other": pick(sources, pair % kinds), "more": pa.array(total)})

    rows = rows.select("lang", "digest", "apart", "source", "p", "z").repartition("lang", "digest", "apart")
    sent = rows.sortWithinPartitions("digest", "lang", "apart").mapInArrow(work, "lang string, source string, other string, more long")
    return sent.groupBy("lang", "source", "other").agg(F.sum("more").alias("more"))


def _pairs(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for every source and every other source of its language."""
    bars = rows.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("n")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "n")).alias("bars"))
    ends = groups.join(bars, ["lang", "source"], "left").select("lang", "source", "v", "z", F.coalesce("bars", F.array().cast("array<struct<p:bigint,n:bigint>>")).alias("bars"))
    left = ends.withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(SALTS)).cast("int"))
    right = ends.select("lang", F.col("source").alias("other"), F.col("z").alias("oz"), F.col("bars").alias("obars"),
                        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    both = left.join(right, ["lang", "salt"]).where("source <> other")
    base = _distance(F.col("z"), F.col("oz"))
    zero = F.lit(0).cast("long")
    own = F.aggregate("bars", zero, lambda s, b: s + b["n"] * (_distance(b["p"], F.col("oz")) - base))
    others = F.aggregate("obars", zero, lambda s, b: s + b["n"] * (_distance(F.col("z"), b["p"]) - base))
    both = both.select("lang", "source", "other", F.when(F.col("v") > 0, F.col("v") * base + own + others).otherwise(zero).alias("value"))
    full = both.join(_shared_terms(rows), ["lang", "source", "other"], "left")
    return full.select("lang", "source", F.col("other").alias("item"), (F.col("value") + F.coalesce("more", zero)).alias("value"))


def _rising(rows: DataFrame, names: DataFrame, top: int) -> DataFrame:
    """``lang, source, item, value, rank``: the ``top`` kept terms of each group that it uses more than its language.

    Values alone choose: those of the ``top``-th and above, ties included. Only these get their text, which then breaks the ties.
    """
    here = Window.partitionBy("lang", "source")
    rise = rows.where("p > q").select("lang", "source", "digest", "apart", _distance(F.col("p"), F.col("q")).alias("value"))
    least = rise.select("lang", "source", "value", F.row_number().over(here.orderBy(F.desc("value"))).alias("place")).where(F.col("place") <= top)
    least = least.groupBy("lang", "source").agg(F.min("value").alias("least"))
    near = rise.join(least, ["lang", "source"]).where("value >= least")
    told = near.join(names, "digest").select("lang", "source", F.expr("if(apart = '', text, apart)").alias("item"), "value")
    return told.withColumn("rank", F.row_number().over(here.orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)


def audit(docs: DataFrame, min_docs: int = 3, top: int = 200, digest_bits: int = 64) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every (lang, source) group.

    Part ``pair``: every other source of the language, by the summed distance of the kept terms'
    shares; part ``term``: the ``top`` terms that the group uses more than its language. A language
    keeps the terms of at least ``min_docs`` of its rows. Ranks go by value, then by the item's UTF-8.

    Reads ``lang``, ``source`` and ``text``; nulls count as empty, other columns aren't read. Rows
    are documents: repeated ones count again. A group without kept terms has pairs but no terms, a
    language without any has pairs of value 0; an empty table gives an empty result. Fewer
    ``digest_bits`` only make more digests to be split; the result is the same. The result holds
    every pair of sources of a language, so it grows with the square of their number; so does no
    other step but the sums of those pairs.
    """
    kept, vocabulary, names = _kept_counts(docs, min_docs, digest_bits)
    langs = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    groups = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n", "v", "lang_n"])
    groups = materialise(groups.withColumn("z", _share("0L", "n", "v")), "groups")
    rows = materialise(kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "digest", "apart", "z", _share("c", "n", "v").alias("p"), _share("total", "lang_n", "v").alias("q")), "shares")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = _pairs(groups, rows).withColumn("rank", rank).withColumn("part", F.lit("pair"))
    rising = _rising(rows, names, top).withColumn("part", F.lit("term"))
    return pairs.unionByName(rising).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


ship_by_value(__name__)
