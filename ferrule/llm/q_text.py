"""Queries of the row-wise operators: quality rules, packing, secret scans, sharding, BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ferrule.llm import bpe, packing, quality_rules, secret_scan, sharding
from ferrule.llm.catalog import register
from ferrule.llm.common import read

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@register("op10_bpe_round_trip")
def op10_bpe_round_trip(spark, sf_dir):
    """Ids of every whole document and the text that they decode to, as digests."""
    both = bpe.round_trip(read(spark, sf_dir, "documents"), BYTE_BPE)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op7_cost_balanced_packing")
def op7_cost_balanced_packing(spark, sf_dir):
    """Every document's tokens in sequences of at most 2048 tokens."""
    pieces = packing.pack(read(spark, sf_dir, "documents"), WORD_BPE)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


_U = "(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || i), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE"


@register("op9_rendezvous_sharding", f"""
WITH d AS (
  SELECT doc_id, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o, coalesce(text, '') AS t,
         row_number() OVER () AS r FROM documents),
scored AS (
  SELECT d.*, i, -1.0::DOUBLE / ln({_U}) AS s FROM d, range(41) g(i)),
best AS (
  SELECT r, doc_id, o, t, max_by(i, (s, i)) FILTER (i < 40) AS shard, max_by(i, (s, i)) AS grown FROM scored GROUP BY r, doc_id, o, t),
crc_table AS (
  SELECT list(list_reduce(list_concat([n::BIGINT], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY n) AS tab
  FROM range(256) x(n)),
hexed AS (SELECT *, hex(encode(t)) AS h FROM best),
summed AS (
  SELECT hexed.*, length(h) // 2 + 16 AS size,
    xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT],
      list_transform(range(length(h) // 2), lambda p: ('0x' || substr(h, 2 * p + 1, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]))) AS crc
  FROM hexed, crc_table)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY o, doc_id NULLS FIRST, crc, size) - 1 AS slot,
       CAST(grown AS INTEGER) AS grown_shard
FROM summed""")
def op9_rendezvous_sharding(spark, sf_dir):
    """All documents over 40 equal shards; a 41st takes rows only into itself."""
    return sharding.assign_shards(read(spark, sf_dir, "documents"))


#: The line rules written out again for the oracle, from the rules' description.
_NAV_WORDS = ("(home|menu|login|log in|sign in|sign up|register|next|previous|prev|back|read more|more|share|click here|skip to content|"
              "back to top|search|contact us|about us|sitemap|print this page|follow us|tags?:.*|categories:.*|page [0-9]+ of [0-9]+|"
              "startseite|men[üÜ]|anmelden|registrieren|weiter|zur[üÜ]ck|weiterlesen|mehr lesen|suche|kontakt|[üÜ]ber uns|impressum|nach oben|seite teilen|seite [0-9]+ von [0-9]+|"
              "inicio|men[úÚ]|iniciar sesi[óÓ]n|reg[íÍ]strate|siguiente|anterior|leer m[áÁ]s|buscar|contacto|sobre nosotros|mapa del sitio|volver arriba|compartir|p[áÁ]gina [0-9]+ de [0-9]+|"
              "accueil|connexion|se connecter|s.inscrire|suivant|pr[éÉ]c[éÉ]dent|lire la suite|rechercher|contactez-nous|[àÀ] propos|plan du site|haut de page|partager|page [0-9]+ sur [0-9]+)")
_BOILERPLATE = ("(all rights reserved|licensed under|terms of (use|service)|privacy policy|cookie(s)? (policy|settings)|we use cookies|"
                "copyright \\(c\\)|©|lorem ipsum|enable javascript|subscribe to our newsletter|unsubscribe|"
                "provided .as is. without warranty|permission is hereby granted|redistribution and use in source|"
                "alle rechte vorbehalten|datenschutzerkl[äÄ]rung|nutzungsbedingungen|wir verwenden cookies|cookie-einstellungen|javascript aktivieren|newsletter abonnieren|"
                "todos los derechos reservados|pol[íÍ]tica de (privacidad|cookies)|t[éÉ]rminos de uso|utilizamos cookies|habilite javascript|suscr[íÍ]bete a nuestro|"
                "tous droits r[éÉ]serv[éÉ]s|politique de (confidentialit[éÉ]|cookies)|conditions d.utilisation|nous utilisons des cookies|activez javascript|abonnez-vous [àÀ] notre)")


@register("op1_line_rules", f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
win AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(3) x(k) GROUP BY r),
l AS (SELECT r, i, parts[i] AS line FROM (SELECT r, string_split(t, chr(10)) AS parts, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM d)
      WHERE regexp_matches(parts[i], '[^\x20\x09-\x0D]')),
j AS (SELECT r, i, line,
        length(regexp_replace(line, '[^#*$%&|<>!]', '', 'g')) > length(line) * 0.08::DOUBLE
          OR (len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) >= 40 AND NOT regexp_matches(line, '[.!?…。:;]')) AS p,
        regexp_matches(line, '^[^|>»·]{{0,30}}([|>»·][^|>»·]{{0,30}}){{2,}}$')
          OR regexp_matches(line, '^[\x20\x09-\x0D]*{_NAV_WORDS}[\x20\x09-\x0D.!…]*$', 'i') AS n,
        regexp_matches(line, '{_BOILERPLATE}', 'i') AS b FROM l),
a AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dups, count(*) FILTER (p) AS np, count(*) FILTER (n) AS nn, count(*) FILTER (b) AS nb,
        coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT (p OR n OR b)), '') AS clean FROM j GROUP BY r),
s AS (SELECT d.doc_id, len(words) AS nw, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS wc, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS sy,
        coalesce(dups, 0) AS dups, coalesce(covered.n, 0) AS rep, coalesce(n_lines, 0) AS n_lines, coalesce(np, 0) AS np, coalesce(nn, 0) AS nn, coalesce(nb, 0) AS nb,
        coalesce(clean, '') AS clean, len(list_filter(regexp_split_to_array(coalesce(clean, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS cw
      FROM d JOIN w USING (r) LEFT JOIN covered USING (r) LEFT JOIN a USING (r))
SELECT doc_id, nw::BIGINT AS n_words, wc::BIGINT AS word_chars, sy::BIGINT AS n_symbols, dups::BIGINT AS n_dup_lines, rep::BIGINT AS n_repeat_words,
       (nw < 50 OR 100 * rep > 50 * nw) AS base_failed,
       NOT (nw < 50 OR 100 * rep > 50 * nw) AND wc - length(regexp_replace(clean, '[\x20\x09-\x0D]', '', 'g')) <= wc * 0.3::DOUBLE AND cw >= 50 AS kept,
       n_lines::BIGINT AS n_lines, np::BIGINT AS n_punctuation, nn::BIGINT AS n_navigation, nb::BIGINT AS n_boilerplate, cw::BIGINT AS clean_words, md5(clean) AS clean_md5
FROM s""")
def op1_line_rules(spark, sf_dir):
    """Base counts, line rules and verdict of every document."""
    return quality_rules.quality_rules(read(spark, sf_dir, "documents")).withColumn("clean_md5", F.md5("clean_text")).drop("clean_text")


@register("op8_secret_scan")
def op8_secret_scan(spark, sf_dir):
    """Secrets of every document, as counts and as lists of spans."""
    found = secret_scan.find_secrets(read(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
