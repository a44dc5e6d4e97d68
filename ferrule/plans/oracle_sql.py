"""DuckDB SQL for the fixtures and the value oracles.

Fragments are composed into one self-contained statement per query over the
pre-registered views (documents, conversations, embeddings, events, ...).
DuckDB lambdas are ``lambda x, i: ...`` with a 1-based index.
"""

from __future__ import annotations

# white space of Python's str.split(), Unicode included
SPACE = r"[\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def fold(expr: str) -> str:
    return rf"regexp_replace({expr}, '[^\x00-\x7F]', '?', 'g')"


def tok(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '{SPACE}+'), lambda x: x <> '')"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def rev_words(tok_expr: str, key: str, mod: int) -> str:
    return (f"array_to_string(list_transform({tok_expr}, lambda w, i: "
            f"CASE WHEN (i - 1 + {key}) % {mod} = 0 THEN reverse(w) ELSE w END), ' ')")


def extract_source(expr: str) -> str:
    return (f"{strip(f'CASE WHEN instr({expr}, chr(58) || chr(32)) > 0 THEN '
                     f'substr({expr}, instr({expr}, chr(58) || chr(32)) + 2) ELSE {expr} END')}")


def bucket(n_expr: str) -> str:
    return f"CASE WHEN {n_expr} <= 128 THEN 'short' WHEN {n_expr} <= 256 THEN 'medium' ELSE 'long' END"


def domain_name(expr: str) -> str:
    return f"CASE {expr} WHEN 0 THEN 'code' WHEN 1 THEN 'math' WHEN 2 THEN 'chat' END"


F1 = f"""
f1_tok AS NOT MATERIALIZED (
  SELECT doc_id AS pair_id, {tok(fold('text'))} AS tok FROM documents),
f1 AS NOT MATERIALIZED (
  SELECT pair_id,
         'Fix this text: ' || {rev_words('tok', 'pair_id', 7)} AS src,
         {rev_words('tok', 'pair_id', 7)} AS source,
         array_to_string(tok, ' ') AS reference,
         {rev_words('tok', 'pair_id', 14)} AS candidate,
         {rev_words('tok', 'pair_id', 21)} AS candidate_2
  FROM f1_tok)"""

F2 = f"""
conv_next AS (
  SELECT conv_id, turn, role, text,
         lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
         lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text
  FROM conversations),
f2 AS (
  SELECT conv_id, turn, {fold('text')} AS src, {fold('next_text')} AS tgt
  FROM conv_next WHERE role = 'user' AND next_role = 'assistant')"""


def f3(after: bool = False, name: str = "f3") -> str:
    logits = "CAST(embedding[3 * layer + 1 : 3 * layer + 3] AS DOUBLE[])"
    if after:
        logits = f"list_transform({logits}, lambda x, i: CASE WHEN i - 1 = domain_id THEN x + 1.0 ELSE x END)"
    return f"""
{name}_base AS (
  SELECT vec_id // 16 AS block_id, CAST(vec_id % 16 AS INTEGER) AS pos,
         CASE WHEN vec_id % 16 < 16 - (vec_id // 16) % 4 THEN CAST((vec_id // 16) % 3 AS INTEGER) ELSE -100 END AS domain_id,
         CASE WHEN vec_id % 16 < 16 - (vec_id // 16) % 4 THEN 1 ELSE 0 END AS mask,
         CAST(label % 3 AS INTEGER) AS token, embedding, CAST(layer AS INTEGER) AS layer
  FROM embeddings, range(0, 21) t(layer)),
{name} AS (
  SELECT layer, block_id, pos, domain_id, mask, token, {logits} AS logits FROM {name}_base)"""


def lse(z: str) -> str:
    return f"(list_max({z}) + ln(list_sum(list_transform({z}, lambda x: exp(x - list_max({z}))))))"


def argmax(z: str) -> str:
    return f"(list_position({z}, list_max({z})) - 1)"


def f4(after: bool = False, name: str = "f4") -> str:
    return f3(after, name + "_rl") + f""",
{name}_lead AS (
  SELECT block_id, pos, token, mask, domain_id, logits,
         lead(token) OVER (PARTITION BY block_id ORDER BY pos) AS next_token,
         lead(mask) OVER (PARTITION BY block_id ORDER BY pos) AS next_mask
  FROM {name}_rl WHERE layer = 0),
{name} AS (
  SELECT block_id, pos, token, mask, domain_id,
         {lse('logits')} - logits[next_token + 1] AS nll
  FROM {name}_lead WHERE next_mask = 1)"""


F5 = f"""
f5 AS (
  SELECT doc_id, {domain_name("CAST(substr(source, 4) AS INTEGER) % 3")} AS domain,
         CAST(CAST(substr(source, 4) AS INTEGER) % 3 AS INTEGER) AS domain_id,
         list_concat({tok('text')}, ['<eos>']) AS tokens
  FROM documents)"""

F6 = """
f6 AS (
  SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS input
  FROM conversations GROUP BY conv_id)"""

F7 = f"""
f7 AS (
  SELECT event_id AS row_idx, event_type AS phase, CAST(event_id + 1 AS VARCHAR) AS step,
         CASE WHEN user_id % 2 = 0 THEN '' ELSE {domain_name('user_id % 3')} END AS domain,
         CASE WHEN event_id % 5 = 0 THEN '' ELSE CAST(value AS VARCHAR) END AS loss,
         CASE WHEN (event_id + 1) % 10 = 0 THEN CAST(value AS VARCHAR) ELSE '' END AS val_loss,
         'n' || CAST(event_id AS VARCHAR) AS note
  FROM events)"""


def distances(table: str, pairs: dict[str, tuple[str, str]], name: str = "dist", key: str = "pair_id", parts: int = 4) -> str:
    """CTE ``name(key, <pair>..)`` of edit distances; equal texts are 0 without filling a table.

    Every pair and every ``parts``-th key is an arm of its own; arms run side by side as long as ``table``
    is not materialised.
    """
    arms = "\n    UNION ALL ".join(
        f"SELECT {key}, '{p}' AS pair, CAST(CASE WHEN {a} = {b} THEN 0 ELSE levenshtein({a}, {b}) END AS BIGINT) AS d "
        f"FROM {table} WHERE {key} % {parts} = {k}" for p, (a, b) in pairs.items() for k in range(parts))
    cols = ", ".join(f"max(d) FILTER (WHERE pair = '{p}') AS {p}" for p in pairs)
    return f"""
{name} AS MATERIALIZED (SELECT {key}, {cols} FROM (
    {arms}) GROUP BY {key})"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes) + "\n"


def ngram_rows(table: str, key: str, roles: dict[str, str], max_n: int = 4, extra: str = "") -> str:
    """SQL rows ``(key, [extra,] role, n, gram)`` for the given role -> text columns."""
    parts = []
    for role, col in roles.items():
        parts.append(f"SELECT {key}{extra}, '{role}' AS role, {tok(col)} AS tok FROM {table}")
    union = "\n  UNION ALL ".join(parts)
    return f"""
roles AS (
  {union}),
grams AS (
  SELECT {key}{extra}, role, n,
         unnest(list_transform(range(1, len(tok) - n + 2), lambda i: array_to_string(tok[i : i + n - 1], chr(1)))) AS gram
  FROM roles, (SELECT CAST(unnest(range(1, {max_n + 1})) AS INTEGER) AS n) nn)"""


def spaced_13a(col: str) -> str:
    """Blanks between the tokens of the public "13a" tokenization."""
    x = f"replace(replace(replace({col}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    x = f"replace(replace(replace(replace({x}, '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"
    x = f"regexp_replace(' ' || {x} || ' ', '([{{-~[-` -&(-+:-@/])', ' \\1 ', 'g')"
    x = f"regexp_replace({x}, '([^0-9])([.,])', '\\1 \\2 ', 'g')"
    x = f"regexp_replace({x}, '([.,])([^0-9])', ' \\1 \\2', 'g')"
    return f"regexp_replace({x}, '([0-9])(-)', '\\1 \\2 ', 'g')"


def gleu_expr(max_n: int = 4) -> str:
    p = [f"(CASE WHEN num_{n} > 0 THEN num_{n} / den_{n} ELSE 1.0 / (2.0 * den_{n}) END)" for n in range(1, max_n + 1)]
    any_zero = " OR ".join(f"den_{n} = 0" for n in range(1, max_n + 1))
    logs = " + ".join(f"ln({x})" for x in p)
    return (f"CASE WHEN {any_zero} THEN 0.0 WHEN cand_len = 0 THEN 0.0 ELSE "
            f"(CASE WHEN cand_len >= ref_len THEN 1.0 ELSE exp(1.0 - ref_len / cand_len) END) * exp(({logs}) / {max_n}.0) END")


def bleu_expr(max_n: int = 4) -> str:
    any_zero = " OR ".join(f"den_{n} = 0 OR match_{n} = 0" for n in range(1, max_n + 1))
    logs = " + ".join(f"ln(match_{n} / den_{n})" for n in range(1, max_n + 1))
    bp = ("(CASE WHEN ref_len = 0 THEN 1.0 WHEN cand_len = 0 THEN 0.0 WHEN cand_len > ref_len THEN 1.0 "
          "ELSE exp(1.0 - ref_len / cand_len) END)")
    return f"CASE WHEN {any_zero} THEN 0.0 ELSE {bp} * exp(({logs}) / {max_n}.0) END"


def sentence_stats(models: list[str], key: str = "pair_id", extra: str = "") -> str:
    """CTEs ``cnt`` and ``sent(key[, extra], n, model, m, p, c)`` over the ``grams`` CTE."""
    cs = ", ".join(f"count(*) FILTER (WHERE role = 'c_{m}') AS c_{m}" for m in models)
    arms = "\n    UNION ALL ".join(
        f"SELECT {key}{extra}, n, '{m}' AS model, least(c_{m}, r) AS m, "
        f"greatest(0, least(c_{m}, s) - least(c_{m}, r)) AS p, c_{m} AS c FROM cnt WHERE c_{m} > 0"
        for m in models)
    return f"""
cnt AS (
  SELECT {key}{extra}, n, gram, count(*) FILTER (WHERE role = 's') AS s,
         count(*) FILTER (WHERE role = 'r') AS r, {cs}
  FROM grams GROUP BY ALL),
long AS (
    {arms}),
sent AS (
  SELECT {key}{extra}, n, model, sum(m) AS matches, sum(p) AS penalties, sum(c) AS cand_ngrams,
         greatest(0, sum(m) - sum(p)) AS gleu_num
  FROM long GROUP BY ALL)"""


def corpus_cols(max_n: int = 4) -> str:
    cols = []
    for n in range(1, max_n + 1):
        cols += [f"CAST(coalesce(sum(gleu_num) FILTER (WHERE n = {n}), 0) AS BIGINT) AS num_{n}",
                 f"CAST(coalesce(sum(matches) FILTER (WHERE n = {n}), 0) AS BIGINT) AS match_{n}",
                 f"CAST(coalesce(sum(cand_ngrams) FILTER (WHERE n = {n}), 0) AS BIGINT) AS den_{n}"]
    return ", ".join(cols)
