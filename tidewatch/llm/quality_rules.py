"""Quality rules: line-first cleaning.

Every line is judged by punctuation, navigation and boilerplate rules, failing lines are removed, and a
document is rejected when it loses too much of its text. All in DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import NOT_SPACE, SPACE_RUN, text_or_empty, words_of

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Phrases of site furniture in English, German, French and Spanish (a dot for an accented letter); a short
#: line that holds one of them fails.
BOILERPLATE = (
    "accept cookies|cookie policy|enable javascript|lorem ipsum|terms of use|terms of service"
    "|privacy policy|sign in|log in|sign up|subscribe now|click here|read more|share this"
    "|skip to content|back to top"
    "|cookies akzeptieren|cookies ablehnen|mehr erfahren|mehr lesen|weiterlesen|jetzt abonnieren|jetzt anmelden|hier klicken|nach oben|zum inhalt springen"
    "|accepter les cookies|refuser les cookies|en savoir plus|lire la suite|cliquez ici|se connecter|haut de page|aller au contenu|mentions l.gales"
    "|aceptar cookies|rechazar cookies|leer m.s|haz clic|haga clic|suscr.bete ahora|volver arriba|saltar al contenido|aviso legal"
)
#: A line with such a phrase fails only if it has at most so many characters.
BOILERPLATE_CHARS = 120
#: A line is navigation if it has one separator for so many words, or for fewer.
NAV_WORDS = 4
#: A line fails if over this share (per cent) of its characters are symbols.
SYMBOL_PERCENT = 10
#: A line with at least LOUD_LEAST exclamation marks fails if it has one for LOUD_WORDS words, or for fewer.
LOUD_WORDS, LOUD_LEAST = 3, 3
#: A document is rejected if failing lines hold over this share (per cent) of its word characters.
LOST_PERCENT = 50
WINDOW = 5


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{SYMBOLS}]"))


def _has_word(line: Column) -> Column:
    return line.rlike(NOT_SPACE)


def line_fails(line: Column) -> Column:
    """Whether a line breaks a punctuation, navigation or boilerplate rule; words are counted only where needed."""
    n_words = F.size(words_of(line))
    bars = _count(line, "|")
    loud = _count(line, "!")
    return (
        ((bars > 0) & (bars * NAV_WORDS >= n_words))
        | (_symbols(line) * 100 > F.length(line) * SYMBOL_PERCENT)
        | ((loud >= LOUD_LEAST) & (loud * LOUD_WORDS >= n_words))
        | ((F.length(line) <= BOILERPLATE_CHARS) & F.lower(line).rlike(f"\\b({BOILERPLATE})\\b"))
    )


def _once(value: Column, f) -> Column:
    """f of a value that is computed once for all its uses, even where the optimizer moves it into a lambda's body."""
    return F.get(F.transform(F.array(value), f), 0)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of five words which the text has twice or more.

    Windows are compared by a 64-bit hash. A text without repeats, the usual case, is known from the number
    of distinct hashes; else hashes are sorted with their places and neighbours compared.
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def same(a: Column, b: Column) -> Column:
        return F.coalesce(a["h"] == b["h"], F.lit(False))

    def covered(sorted_: Column) -> Column:
        twice = F.filter(
            F.transform(sorted_, lambda s, k: F.when(same(s, F.get(sorted_, k - 1)) | same(s, F.get(sorted_, k + 1)), s["i"])),
            lambda p: p.isNotNull(),
        )
        places = F.array_sort(twice)
        return F.aggregate(
            places,
            F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
            lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")),
            lambda acc: acc["n"],
        )

    return F.when(n < WINDOW, 0).otherwise(
        _once(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(
            _once(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered)
        ))
    )


def quality_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Judge every document: its columns, base measures, `base_failed`, `kept` and `clean_text`.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept (boolean) and
    clean_text (the lines that pass, in order). Null and empty texts have no words: base_failed. Repeated rows
    are judged alike, each for itself; an empty table gives an empty result. Columns of the same names in the
    input are replaced.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text"]
    own = docs.drop(*[c for c in added if c != text])
    t = text_or_empty(text)
    lines = F.filter(F.split(t, "\n"), _has_word)
    good = F.filter(F.split(t, "\n"), lambda x: ~line_fails(x))
    measured = own.withColumns({"__words": words_of(t), "__lines": lines, "__good": good})
    measured = measured.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": _symbols(t).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": _once(F.col("__words"), _repeat_words).cast("long"),
        "clean_text": F.array_join("__good", "\n"),
    })
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    lost = F.col("word_chars") - F.length(F.regexp_replace("clean_text", SPACE_RUN, ""))
    return measured.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (lost * 100 <= F.col("word_chars") * LOST_PERCENT)
    ).drop("__words", "__lines", "__good")


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
win AS (
  SELECT doc_id, unnest(x) AS k, generate_subscripts(x, 1) AS i
  FROM (SELECT doc_id, list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) AS x FROM d)),
rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
cov AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2, i+3, i+4]) AS p FROM rep) GROUP BY 1),
ln AS (
  SELECT doc_id, l, len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) AS nw,
         length(regexp_replace(l, '[\\x20\\x09-\\x0D]', '', 'g')) AS solid,
         length(l) - length(replace(l, '|', '')) AS bars,
         length(l) - length(replace(l, '!', '')) AS loud,
         length(l) - length(regexp_replace(l, '[#*$%&|<>]', '', 'g')) AS syms
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)),
agg AS (
  SELECT doc_id, count(*) FILTER (WHERE nw > 0) - count(DISTINCT l) FILTER (WHERE nw > 0) AS dups,
         sum(solid) AS solid,
         coalesce(sum(solid) FILTER (WHERE
           (bars > 0 AND bars * {NAV_WORDS} >= nw) OR syms * 100 > length(l) * {SYMBOL_PERCENT}
           OR (loud >= {LOUD_LEAST} AND loud * {LOUD_WORDS} >= nw)
           OR (length(l) <= {BOILERPLATE_CHARS} AND regexp_matches(lower(l), '\\b({BOILERPLATE})\\b'))), 0) AS lost
  FROM ln GROUP BY 1),
m AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(agg.solid AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(agg.dups AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, agg.lost
  FROM d JOIN agg USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND lost * 100 <= word_chars * {LOST_PERCENT} AS kept
FROM b
"""
