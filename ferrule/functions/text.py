"""Text column expressions (STR_*).

All functions build JVM-side expressions (no Python UDFs), so they stay inside
whole-stage codegen and run at scan speed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: prompt format markers --------------------------------------
COMPLETION_PREFIX = "\nCorrection:"      # appended to a source to build the prompt
COMPLETION_MARKER = "Correction:"        # text after its last occurrence is the answer
TEXT_SEPARATOR = " ###>"                 # single-text (notebook) format separator
TEXT_MARKER = "###>"
INSTRUCTION_SEPARATOR = ": "             # instruction / sentence separator in sources
SUBWORD_SPACE = "Ġ"                 # byte-level BPE marker for a leading space
EOS_TOKEN = "<eos>"
LENGTH_BUCKETS = ("short", "medium", "long")
SHORT_MAX_TOKENS = 128
MEDIUM_MAX_TOKENS = 256
# -----------------------------------------------------------------------------

# Python's str.split()/strip() whitespace: Unicode White_Space plus the
# information separators U+001C..U+001F.
PY_WS = r"(?U)[\s\x1c-\x1f]"
# The same class restricted to ASCII (what the SQL oracle uses on folded text).
ASCII_WS = r"[\t\n\x0b\f\r \x1c-\x1f]"
NGRAM_JOINER = "\u0001"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def fold_ascii(col) -> Column:
    """Replace every non-ASCII code point by ``?``."""
    return F.regexp_replace(_c(col), r"[^\x00-\x7F]", "?")


def tokens(col, ws: str = PY_WS) -> Column:
    """Whitespace tokens without empty strings (Python ``str.split()``)."""
    return F.filter(F.split(_c(col), ws + "+"), lambda x: x != "")


def py_strip(col, ws: str = PY_WS) -> Column:
    """Python ``str.strip()`` with its whitespace class."""
    return F.regexp_replace(_c(col), f"^{ws}+|{ws}+$", "")


def token_count(col) -> Column:
    return F.size(tokens(col))


def format_prompt(src) -> Column:
    """Inference prompt: ``src`` followed by the completion prefix."""
    return F.concat(_c(src), F.lit(COMPLETION_PREFIX))


def sft_completion(tgt, eos: str = EOS_TOKEN) -> Column:
    """Completion field for completion-only SFT: leading space, target, EOS."""
    return F.concat(F.lit(" "), _c(tgt), F.lit(eos))


def format_text(src, tgt, separator: str = TEXT_SEPARATOR) -> Column:
    """Single-text training form ``src ‖ separator ‖ tgt``."""
    return F.concat(_c(src), F.lit(separator), _c(tgt))


def extract_after_last(col, marker: str = COMPLETION_MARKER) -> Column:
    """Text after the last ``marker`` (whole text if absent), stripped."""
    parts = F.split(_c(col), re.escape(marker), -1)
    return py_strip(F.element_at(parts, -1))


def extract_source_sentence(col, sep: str = INSTRUCTION_SEPARATOR) -> Column:
    """Text after the first ``sep``, stripped; no separator -> whole text stripped.

    Later separators stay in the sentence (a partition, not a split).
    """
    c = _c(col)
    pos = F.instr(c, sep)
    after = c.substr(pos + F.lit(len(sep)), F.length(c) + F.lit(1))
    return py_strip(F.when(pos > 0, after).otherwise(c))


def ngrams(tok_col, n: int) -> Column:
    """Word n-grams of a token array, each joined by an unprintable separator.

    Built from shifted slices with ``zip_with`` so the token array is only an
    argument of the higher-order functions; a lambda that referenced it would
    let the optimiser inline (and re-evaluate) the tokenizer per element.
    """
    return ngram_family(tok_col, n)[n - 1]


def ngram_family(tok_col, max_n: int) -> list[Column]:
    """``[1-grams, 2-grams, ..., max_n-grams]`` of a token array."""
    t = _c(tok_col)
    size = F.size(t)
    out = [t]
    prev = t
    for k in range(2, max_n + 1):
        zipped = F.zip_with(prev, F.slice(t, k, F.greatest(size, F.lit(1))),
                            lambda a, b: F.concat(a, F.lit(NGRAM_JOINER), b))
        prev = F.slice(zipped, 1, F.greatest(size - F.lit(k - 1), F.lit(0)))
        out.append(prev)
    return out


# The public "13a" tokenization, in the order in which its steps apply.
PLAIN_13A = [("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
SPACED_13A = [(r"([\x20-\x26\x28-\x2B\x2F\x3A-\x40\x5B-\x60\x7B-\x7E])", " {0} "),    # marks other than ' , - .
              (r"([^0-9])([.,])", "{0} {1} "), (r"([.,])([^0-9])", " {0} {1}"), ("([0-9])(-)", "{0} {1} ")]


def spaced_13a(col) -> Column:
    """A text with blanks between its "13a" tokens, so that splitting on white space gives them; null stays null."""
    out = _c(col)
    for old, new in PLAIN_13A:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.concat(F.lit(" "), out, F.lit(" "))
    for pattern, spaced in SPACED_13A:
        out = F.regexp_replace(out, pattern, spaced.format("$1", "$2"))
    return out


def length_bucket(n) -> Column:
    c = _c(n)
    return (F.when(c <= SHORT_MAX_TOKENS, F.lit("short"))
            .when(c <= MEDIUM_MAX_TOKENS, F.lit("medium"))
            .otherwise(F.lit("long")))


# Strings Python's float() accepts (without digit-group underscores).
_FLOAT_RE = (r"(?i)^" + PY_WS + r"*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?"
             r"|nan|inf|infinity)" + PY_WS + r"*$")


def lenient_float(col) -> Column:
    """Blank, null or unparseable text -> null; otherwise the double value.

    ``try_cast`` alone would also accept ``3.5d`` or ``1f``; the regex keeps
    exactly Python's float syntax (``1_000`` is treated as unparseable).
    """
    c = _c(col)
    return F.when(c.rlike(_FLOAT_RE), py_strip(c).try_cast("double"))


def series_key(phase, domain) -> Column:
    """Non-empty phase and domain joined by ``' / '``; ``'run'`` if both empty."""
    label = F.concat_ws(" / ", F.nullif(_c(phase), F.lit("")), F.nullif(_c(domain), F.lit("")))
    return F.coalesce(F.nullif(label, F.lit("")), F.lit("run"))


def clean_subword(col) -> Column:
    """Turn the byte-level BPE space marker into a plain space."""
    return F.replace(_c(col), F.lit(SUBWORD_SPACE), F.lit(" "))


def reverse_words_where(tok_col, key_col, modulus: int) -> Column:
    """Reverse word ``i`` (0-based) when ``(i + key) % modulus == 0``."""
    t, k = _c(tok_col), _c(key_col)
    return F.transform(t, lambda w, i: F.when((i + k) % modulus == 0, F.reverse(w)).otherwise(w))
