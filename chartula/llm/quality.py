"""Quality rules, line first: lines that fail a rule go, then documents that lost too much text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, WORD, documents, strip, whole

#: Fixed values. Ends of a sentence and what may close after them, marks of a menu; its words and the phrases of page
#: furniture (lower case) in English, German, French and Spanish.
TERMINAL, CLOSERS, MARKS = ".!?…。！？؟।:;", "\"'”’»)]", "|›»•>"
MENU_WORDS = (
    "home", "menu", "next", "previous", "back to top", "skip to content", "skip to main content", "log ?in", "sign ?in", "sign ?up", "read more", "share this", "search",
    "startseite", "menü", "weiter", "zurück", "nach oben", "anmelden", "registrieren", "mehr lesen", "suche",
    "accueil", "suivant", "précédent", "haut de page", "connexion", "inscription", "lire la suite", "recherche",
    "inicio", "menú", "siguiente", "anterior", "volver arriba", "iniciar sesión", "registrarse", "leer más", "buscar",
)
FURNITURE = (
    "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "enable javascript", "javascript is disabled", "lorem ipsum", "subscribe to our", "click here to", "we use cookies",
    "datenschutzerklärung", "nutzungsbedingungen", "alle rechte vorbehalten", "wir verwenden cookies",
    "politique de confidentialité", "conditions d'utilisation", "tous droits réservés", "nous utilisons des cookies",
    "política de privacidad", "términos de uso", "todos los derechos reservados", "utilizamos cookies",
)
MENU = rf"^\W*(?:{'|'.join(MENU_WORDS)})\W*$"
SYMBOL = "#*$%&|<>"
#: Share of a line's words that may end in a symbol, words a line needs to be held to the sentence rule, and the share of word characters a document must keep.
MOST_SYMBOLS, SENTENCE_WORDS, LEAST_KEPT = 0.1, 3, 0.5


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeated(triples: str) -> str:
    """SQL for the words that lie in windows found twice or more; triples: an array column with a hash for each window.

    Equal windows are neighbours once sorted; their places, sorted again, cover three words each, less what overlaps.
    Most documents repeat none, so the sort of pairs is held back for those that do.
    """
    pairs = f"sort_array(transform({triples}, (h, i) -> struct(h AS h, i AS i)))"
    twice = f"(p -> sort_array(transform(filter(transform(p, (x, k) -> struct(x.i AS i, x.h <=> get(p, k + 1).h OR x.h <=> get(p, k - 1).h AS two)), x -> x.two), x -> x.i)))"
    places = f"element_at(transform(array({pairs}), {twice}), 1)"
    cover = f"element_at(transform(array({places}), q -> aggregate(q, struct(0L AS n, -3 AS last), (a, i) -> struct(a.n + least(3, i - a.last) AS n, i AS last), a -> a.n)), 1)"
    return f"CASE WHEN size(array_distinct({triples})) = size({triples}) THEN 0L ELSE {cover} END"


def furnished(low: Column) -> Column:
    return reduce(Column.__or__, (F.contains(low, F.lit(x)) for x in FURNITURE))


def line_fails(line: Column, of: Column) -> Column:
    """Whether a line with a word breaks a rule: symbols for words, menu, furniture, or a sentence left open.

    Rules that few documents touch look at the document's own counts first (of: n_symbols, n_marks, furniture).
    """
    low, count = F.lower(line), F.regexp_count(line, F.lit(WORD))
    symbols, marks = (F.length(line) - F.length(F.translate(line, x, "")) for x in (SYMBOL, MARKS))
    menu = ((of.n_marks >= 3) & (marks >= 3) & (marks * 40 >= F.length(line))) | ((F.length(line) < 60) & low.rlike(MENU))
    open_end = ~F.right(F.rtrim(line, F.lit(WHITE + CLOSERS)), F.lit(1)).isin(*TERMINAL) & (count >= SENTENCE_WORDS)
    return ((of.n_symbols > 0) & (symbols > MOST_SYMBOLS * count + 1)) | menu | open_end | (of.furniture & furnished(low))


def measure(docs: DataFrame, *also: str) -> DataFrame:
    """Counts of each document (doc_id, text) and its clean lines; ``also`` names columns to carry, in a struct of that name.

    One row each, without a shuffle: every count is an expression over the row's own arrays, sorted where it must find
    repeats, so a text of any length costs n log n. A null or empty text has no word, line or symbol: all counts are 0.
    A line is kept if it has a word and breaks no rule.
    """
    a = docs.select("doc_id", F.struct(*also, F.lit(0).alias("none_")).alias("carried"), whole().alias("text_"))
    b = a.select(
        "*", words(F.col("text_")).alias("w"), F.filter(F.split("text_", "\n"), lambda x: strip(x) != "").alias("lines"), furnished(F.lower("text_")).alias("furniture"),
        *((F.length("text_") - F.length(F.translate("text_", x, ""))).cast("long").alias(n) for x, n in ((SYMBOL, "n_symbols"), (MARKS, "n_marks"))),
    )
    c = b.select("*", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    c = c.select("*", F.expr("CASE WHEN size(h) < 3 THEN array() ELSE transform(sequence(0, size(h) - 3), i -> xxhash64(h[i], h[i + 1], h[i + 2])) END").alias("triples"))
    # Bound to a lambda's variable, the document's counts are found once; as columns, the optimizer would move them into the test of each line.
    clean = F.element_at(F.transform(F.array(F.struct("n_symbols", "n_marks", "furniture")), lambda of: F.filter("lines", lambda x: ~line_fails(x, of))), 1)
    d = c.select(
        "doc_id", "carried", "text_", F.size("w").cast("long").alias("n_words"), F.length(F.translate("text_", WHITE, "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(repeated("triples")).alias("n_repeat_words"), clean.alias("clean"),
    )
    return d.select("*", F.length(F.translate(F.array_join("clean", ""), WHITE, "")).cast("long").alias("clean_chars"))


def judge(docs: DataFrame, *also: str) -> DataFrame:
    """measure() with base_failed and kept: not base_failed, and LEAST_KEPT of the word characters left in clean lines; and
    cleaned: the text as it stands where no line fails, else its clean lines.

    The columns named in ``also`` come after them, as they are.
    """
    m = measure(docs, *also).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return m.withColumn("kept", ~F.col("base_failed") & (F.col("clean_chars") >= LEAST_KEPT * F.col("word_chars"))).withColumn("cleaned", F.when(F.col("clean_chars") == F.col("word_chars"), F.col("text_")).otherwise(F.array_join("clean", "\n"))).drop("text_").select("*", *[F.col("carried")[c].alias(c) for c in also]).drop("clean", "carried")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
