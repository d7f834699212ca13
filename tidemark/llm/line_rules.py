"""Quality rules, line first.

Every line of a text is judged alone by punctuation, navigation and boilerplate rules; lines that fail are
removed from the text, and a document that loses more than half its words is rejected. Document-wide base figures
(words, symbols, repeated lines and 5-word windows) are counted over the whole text beside it.

All of it is built-in expressions on one row, so no row moves. Null or empty text has no words and fails the base
rule; a line without a word is neither judged nor counted; doc_id is only carried, null and repeated ones as
they are; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, texts, words

#: A document stays if at least this part of its words stand in lines that pass.
MIN_KEPT_SHARE = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = r"[#*$%&|<>]"
#: What ends a sentence, what separates menu entries, and phrases of page furniture.
SENTENCE_END = "[.!?…。]"
SHOUTS = "[!?]"
SEPARATORS = "[|»›•·]"
BOILERPLATE = (
    "all rights reserved|licensed under|released under|copyright|cookie|javascript|privacy policy|terms of (use|service)|lorem ipsum|click here|subscribe|sign up|log in"
    "|alle rechte vorbehalten|datenschutz|impressum|nutzungsbedingungen|hier klicken|jetzt anmelden|newsletter"
    "|tous droits réservés|mentions légales|politique de confidentialité|conditions d'utilisation|cliquez ici|s'abonner|se connecter"
    "|todos los derechos reservados|política de privacidad|aviso legal|términos de uso|haga clic aquí|suscríbete|iniciar sesión"
)
BOILERPLATE_MAX_WORDS = 20


def _count(text: Column, pattern: str) -> Column:
    """How many characters of text the one-character pattern matches."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def line_failures(line: Column, n_words: Column) -> Column:
    """The rule that a line with a word breaks, null if none."""
    separators = _count(line, SEPARATORS)
    return (
        F.when((separators >= 2) & (separators * 4 >= n_words), "navigation")
        .when(~line.rlike(SENTENCE_END), "punctuation")
        .when(_count(line, SYMBOLS) * 3 >= n_words, "punctuation")
        .when(_count(line, SHOUTS) >= n_words, "punctuation")
        .when((n_words <= BOILERPLATE_MAX_WORDS) & line.rlike(f"(?iu)({BOILERPLATE})"), "boilerplate")
    )


def _repeat_words(hashes: Column) -> Column:
    """Words within windows that occur twice or more. Sorted (hash, place) pairs show repeats as neighbours; the places, sorted again, add what each covers beyond the one before."""

    def places(s: Column) -> Column:
        same = lambda k, i: (k >= 0) & (F.get(s, k)["h"] == F.get(s, i)["h"])
        return F.array_sort(F.transform(F.filter(s, lambda x, i: F.coalesce(same(i - 1, i), F.lit(False)) | F.coalesce(same(i + 1, i), F.lit(False))), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(p, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("at")), lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["at"])).alias("n"), x.alias("at")), lambda a: a["n"])

    pairs = F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    once = lambda value, f: F.transform(F.array(value), f)[0]  # noqa: E731  binds a value once inside an expression
    return once(pairs, lambda s: once(places(s), covered))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the base figures, cleaned text and verdict of each document."""
    d = texts(docs).withColumn("w", words(F.col("text"))).withColumn("lines", F.split("text", "\n"))
    n = F.size("w")
    d = d.withColumn("hashes", F.transform(F.slice("w", F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(F.col("w"), i + k) for k in range(1, WINDOW)))))
    d = d.withColumn("full", F.filter("lines", lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != ""))
    # each line is judged once: its words are counted and its failure is kept beside it, so that failed and passing lines are told apart without looking lines up
    count = lambda x: F.size(F.split(F.btrim(x, F.lit(" \t\x0b\f\r")), SPACE))
    d = d.withColumn("judged", F.transform(F.transform("full", lambda x: F.struct(x.alias("line"), count(x).alias("n"))), lambda x: F.struct(x["line"].alias("line"), x["n"].alias("n"), line_failures(x["line"], x["n"]).isNotNull().alias("bad"))))
    d = d.withColumn("bad", F.filter("judged", lambda x: x["bad"]))
    d = d.select(
        "doc_id", "text", "judged", "bad",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _count(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("hashes")) == F.size("hashes"), F.lit(0).cast("long")).otherwise(_repeat_words(F.col("hashes"))).alias("n_repeat_words"),
        F.aggregate("bad", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_lost_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    d = d.withColumn("base_failed", failed)
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("n_lost_words") <= (1 - MIN_KEPT_SHARE) * F.col("n_words")))


def _clean() -> Column:
    """The text of the lines that pass, joined by newlines, from the columns of judged()."""
    return F.array_join(F.transform(F.filter("judged", lambda x: ~x["bad"]), lambda x: x["line"]), "\n")


def cleaned(docs: DataFrame) -> DataFrame:
    """doc_id, kept and the cleaned text of each document."""
    return judged(docs).select("doc_id", "kept", _clean().alias("clean_text"))


def verdicts(docs: DataFrame) -> DataFrame:
    """One row per document with its base figures and verdict, what its failed lines take with them, and the digest of the text without these."""
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_words", F.size("bad").cast("long").alias("n_lost_lines"), F.sha2(_clean().cast("binary"), 256).alias("clean_sha256"))


def passing(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with all columns and whole texts. A narrow filter: no join, no shuffle."""
    packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc_id"), "text")
    # explode() keeps the optimizer from moving the filter below the verdict, which would write all of the verdict out in it
    return judged(packed).select(F.explode(F.array(F.struct("doc_id", "kept"))).alias("x")).where("x.kept").select("x.doc_id.*")
