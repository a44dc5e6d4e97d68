"""Line-first quality rules. [native: DataFrame functions only]

Every line that holds a word is judged alone: punctuation (symbol-ridden lines, runs of
exclamation marks, table rows, long lines that never end a sentence), navigation (menus, page
links) and boilerplate (legal, cookie, licence and script notices), both in English, German,
Spanish and French. Failing lines are removed.
A document is rejected when the base counts fail, when removal takes more than
``max_lost`` of its word characters, or when fewer than ``min_words`` words stay.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words, as a class for the pattern functions.
GAPS = "[\\x20\\x09-\\x0D]+"
ANY_WORD = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"

# The line rules, with English, German, Spanish and French menu words and notices (accented letters in both
# cases, as ignoring case covers ASCII only). Written without look-around, so any pattern engine reads them alike.
#: Share of symbols and exclamation marks among a line's characters from which it fails.
MAX_MARKS = 0.08
NAV_SEPARATED = "^[^|>»·]{0,30}([|>»·][^|>»·]{0,30}){2,}$"
NAV_WORDS = ("(?i)^[\\x20\\x09-\\x0D]*(home|menu|login|log in|sign in|sign up|register|next|previous|prev|back|read more|more|share|"
             "click here|skip to content|back to top|search|contact us|about us|sitemap|print this page|follow us|tags?:.*|categories:.*|"
             "page [0-9]+ of [0-9]+|"
             "startseite|men[üÜ]|anmelden|registrieren|weiter|zur[üÜ]ck|weiterlesen|mehr lesen|suche|kontakt|[üÜ]ber uns|impressum|nach oben|seite teilen|seite [0-9]+ von [0-9]+|"
             "inicio|men[úÚ]|iniciar sesi[óÓ]n|reg[íÍ]strate|siguiente|anterior|leer m[áÁ]s|buscar|contacto|sobre nosotros|mapa del sitio|volver arriba|compartir|p[áÁ]gina [0-9]+ de [0-9]+|"
             "accueil|connexion|se connecter|s.inscrire|suivant|pr[éÉ]c[éÉ]dent|lire la suite|rechercher|contactez-nous|[àÀ] propos|plan du site|haut de page|partager|page [0-9]+ sur [0-9]+)[\\x20\\x09-\\x0D.!…]*$")
BOILERPLATE = ("(?i)(all rights reserved|licensed under|terms of (use|service)|privacy policy|cookie(s)? (policy|settings)|we use cookies|"
               "copyright \\(c\\)|©|lorem ipsum|enable javascript|subscribe to our newsletter|unsubscribe|"
               "provided .as is. without warranty|permission is hereby granted|redistribution and use in source|"
               "alle rechte vorbehalten|datenschutzerkl[äÄ]rung|nutzungsbedingungen|wir verwenden cookies|cookie-einstellungen|javascript aktivieren|newsletter abonnieren|"
               "todos los derechos reservados|pol[íÍ]tica de (privacidad|cookies)|t[éÉ]rminos de uso|utilizamos cookies|habilite javascript|suscr[íÍ]bete a nuestro|"
               "tous droits r[éÉ]serv[éÉ]s|politique de (confidentialit[éÉ]|cookies)|conditions d.utilisation|nous utilisons des cookies|activez javascript|abonnez-vous [àÀ] notre)")
#: Lower-case strings of which every text with a boilerplate line holds one or more, as each choice of ``BOILERPLATE`` does.
NOTICE_PARTS = ("all rights reserved", "licensed under", "terms of ", "privacy policy", "cookie", "copyright (c)", "©", "lorem ipsum", "javascript",
                "newsletter", "unsubscribe", "without warranty", "permission is hereby", "redistribution and use", "alle rechte vorbehalten",
                "datenschutzerkl", "nutzungsbedingungen", "todos los derechos", "privacidad", "rminos de uso", "bete a nuestro", "tous droits r",
                "confidentialit", "conditions d", "abonnez-vous")
#: A line of this many words or more must hold a sentence end.
LONG_LINE = 40
ENDS = "[.!?…。:;]"


def _without(text: Column, characters: str) -> Column:
    """Length of a text without the characters of a class."""
    return F.length(F.regexp_replace(text, f"[{characters}]", ""))


def line_fails(line: Column) -> dict[str, Column]:
    """The three rules for one line, as boolean columns."""
    n_words = F.size(F.split(F.trim(F.regexp_replace(line, GAPS, " ")), " "))
    return {"punctuation": (F.length(line) - _without(line, SYMBOLS + "!") > F.length(line) * F.lit(MAX_MARKS)) | (~line.rlike(ENDS) & (n_words >= LONG_LINE)),
            "navigation": line.rlike(NAV_SEPARATED) | line.rlike(NAV_WORDS),
            "boilerplate": line.rlike(BOILERPLATE)}


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", max_lost: float = 0.3, min_words: int = 50,
                  max_repeat_percent: int = 50) -> DataFrame:
    """``key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines,
    n_punctuation, n_navigation, n_boilerplate, clean_text, clean_words`` for every row.

    Words are ``[^\\x20\\x09-\\x0D]+``. ``n_repeat_words`` counts the words inside 3-word windows that
    occur twice or more in the text (windows are compared by a 64-bit hash: a collision inside one
    text of 10,000 words has a chance of about 3e-12). A line may fail several rules. Null and empty
    texts have no word, fail the base rules and clean to the empty text. Row for row: repeated rows stay,
    other columns aren't read, an empty table gives an empty result; nothing is shuffled.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    # The words between single spaces; each later step uses a column of the step before more than once, so nothing is computed twice.
    step = docs.select(F.col(key), t.alias("_t")).withColumn("_flat", F.trim(F.regexp_replace("_t", GAPS, " ")))
    step = step.withColumn("_words", F.when(F.length("_flat") > 0, F.split("_flat", " ")).otherwise(F.array().cast("array<string>")))
    step = step.withColumn("_windows", F.expr(
        "sort_array(transform(if(size(_words) < 3, array(), sequence(0, size(_words) - 3)),"
        " i -> struct(xxhash64(_words[i], _words[i + 1], _words[i + 2]) AS h, i AS i)))"))
    step = step.withColumn("_starts", F.expr(
        "transform(filter(_windows, (w, k) -> (k > 0 AND w.h = _windows[k - 1].h) OR (k < size(_windows) - 1 AND w.h = _windows[k + 1].h)), w -> w.i)"))
    step = step.withColumn("n_repeat_words", F.expr("size(array_distinct(flatten(transform(_starts, i -> array(i, i + 1, i + 2)))))").cast("long"))
    step = step.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike(ANY_WORD)))
    # The notices' pattern tries its many choices at every character, so only texts that hold a part of one are searched line by line.
    step = step.withColumn("_low", F.lower("_t"))

    def judged(notices: bool) -> Column:
        return F.transform("_lines", lambda x: F.struct(
            x.alias("line"), *((c if notices or n != "boilerplate" else F.lit(False)).alias(n) for n, c in line_fails(x).items())))

    held = reduce(or_, (F.contains("_low", F.lit(x)) for x in NOTICE_PARTS))
    step = step.withColumn("_judged", F.when(held, judged(True)).otherwise(judged(False)))
    step = step.withColumn("_clean", F.array_join(F.transform(
        F.filter("_judged", lambda x: ~(x["punctuation"] | x["navigation"] | x["boilerplate"])), lambda x: x["line"]), "\n"))
    # Words stand between single spaces, so their characters are the length less the spaces.
    counts = lambda flat, words: F.struct(words.cast("long").alias("n"), (F.length(flat) - F.greatest(words - 1, F.lit(0))).cast("long").alias("chars"))
    step = step.withColumn("_all", counts(F.col("_flat"), F.size("_words")))
    step = step.withColumn("_clean_flat", F.when(F.expr("exists(_judged, x -> x.punctuation OR x.navigation OR x.boilerplate)"),
                                                 F.trim(F.regexp_replace("_clean", GAPS, " "))))
    left = F.when(F.length("_clean_flat") > 0, counts(F.col("_clean_flat"), F.size(F.split("_clean_flat", " ")))).when(
        F.col("_clean_flat").isNull(), F.col("_all")).otherwise(F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("chars")))
    step = step.withColumn("_left", left)
    step = step.select(
        key, F.col("_all.n").alias("n_words"), F.col("_all.chars").alias("word_chars"),
        (F.length("_t") - _without(F.col("_t"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        F.size("_lines").cast("long").alias("n_lines"),
        *(F.expr(f"cast(size(filter(_judged, x -> x.{r})) AS bigint) AS n_{r}") for r in ("punctuation", "navigation", "boilerplate")),
        F.col("_clean").alias("clean_text"), F.col("_left.n").alias("clean_words"), F.col("_left.chars").alias("_left_chars"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    lost = F.col("word_chars") - F.col("_left_chars")
    return step.select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (lost <= F.col("word_chars") * F.lit(max_lost)) & (F.col("clean_words") >= min_words)).alias("kept"),
        "n_lines", "n_punctuation", "n_navigation", "n_boilerplate", "clean_text", "clean_words")
