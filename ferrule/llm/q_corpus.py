"""Queries of the operators over corpus-wide counts: language model, token alignment, source divergence."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ferrule.llm import brown_lm, divergence, token_alignment
from ferrule.llm.catalog import register
from ferrule.llm.common import crc_fold, read


@register("op11_brown_lm")
def op11_brown_lm(spark, sf_dir):
    """Log probability of every document under class bigrams; folds 1 to 9 of 10 are learned from."""
    docs = read(spark, sf_dir, "documents")
    model = brown_lm.learn(docs.where(crc_fold("doc_id", 10) != 0))
    return brown_lm.score(docs, model).withColumn("held_out", crc_fold("doc_id", 10) == F.lit(0))


@register("op12_token_alignment")
def op12_token_alignment(spark, sf_dir):
    """Groups and links of the tokens of two vocabularies in every document, rated by how many documents hold a link."""
    return token_alignment.align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@register("op13_source_divergence", """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')),
                                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
tongue AS (SELECT lang, count(*) AS v, sum(total)::HUGEINT AS ln FROM kept GROUP BY lang),
own AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
grp AS (SELECT lang, source, coalesce(n, 0) AS n, coalesce(v, 0) AS v, coalesce(ln, 0) AS ln
        FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(c)::HUGEINT AS n FROM own GROUP BY lang, source) USING (lang, source)
        LEFT JOIN tongue USING (lang)),
cell AS (SELECT lang, source, term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (n + v) AS p,
                1 + (1000000000::HUGEINT * (total + 1)) // (ln + v) AS q
         FROM grp JOIN kept USING (lang) LEFT JOIN own USING (lang, source, term)),
apart AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::HUGEINT AS value
          FROM cell a JOIN cell b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value
         FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source),
term AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM cell WHERE c > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM pair
           UNION ALL
           SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) FROM term
           QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) <= 200)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked""")
def op13_source_divergence(spark, sf_dir):
    """Distances between all sources of a language, and the 200 terms that each uses more than its language."""
    return divergence.audit(read(spark, sf_dir, "documents"))
