"""Text expressions: markup, paragraphs and sentences, search terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chunk sizes in characters: pack up to the target, split paragraphs above the maximum.
TARGET_CHARS = 1000
MAX_CHARS = 1500

# Function words left out of search terms, on both the index and the query side.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in",
              "is", "it", "its", "of", "on", "that", "the", "to", "was", "were", "will", "with")


def strip_markup(html: Column) -> Column:
    """Plain text that keeps paragraph breaks, because paragraphs are the chunk boundary."""
    # fixed by the format, in this order
    steps = ((r"(?i)<br\s*/?>", "\n"), (r"(?i)</?(?:div|p)\b[^>]*>", "\n\n"), (r"<[^>]*>", ""),
             (r"\r", ""), (r"[ \t]+", " "), (r"[ \t]*\n[ \t]*", "\n"), (r"\n{3,}", "\n\n"),
             (r"^\s+|\s+$", ""))
    for pattern, replacement in steps:
        html = F.regexp_replace(html, pattern, replacement)
    return html


def _atoms(text: Column) -> Column:
    """Short paragraphs whole (`grp` 0), long ones as sentences sharing their paragraph's `grp`."""
    clean = F.transform(F.split(text, r"\n{2,}"),
                        lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    paragraphs = F.filter(clean, lambda p: p != "")

    def parts(p: Column, i: Column) -> Column:
        sentences = F.transform(F.split(p, r"(?<=[.!?])\s+"),
                                lambda s: F.struct(s.alias("text"), (i + 1).alias("grp")))
        whole = F.array(F.struct(p.alias("text"), F.lit(0).alias("grp")))
        return F.when(F.length(p) > MAX_CHARS, sentences).otherwise(whole)

    return F.flatten(F.transform(paragraphs, parts))


def chunk(text: Column) -> Column:
    """Pack a text into chunks: one left-to-right fold over its paragraphs and sentences.

    A chunk never mixes a long paragraph's sentences with other paragraphs, and no sentence is
    cut: a single one above the target stays whole.
    """
    nothing = F.array().cast("array<string>")
    start = F.struct(nothing.alias("done"), F.lit("").alias("buf"), F.lit(-1).alias("grp"))

    def push(acc: Column) -> Column:
        return F.when(acc["buf"] == "", acc["done"]).otherwise(
            F.concat(acc["done"], F.array(acc["buf"])))

    def step(acc: Column, atom: Column) -> Column:
        sep = F.when(atom["grp"] == 0, "\n\n").otherwise(" ")
        size = F.length(acc["buf"]) + F.length(sep) + F.length(atom["text"])
        fits = (acc["buf"] != "") & (acc["grp"] == atom["grp"]) & (size <= TARGET_CHARS)
        return F.struct(
            F.when(fits, acc["done"]).otherwise(push(acc)).alias("done"),
            F.when(fits, F.concat(acc["buf"], sep, atom["text"])).otherwise(atom["text"])
            .alias("buf"), atom["grp"].alias("grp"))

    return F.aggregate(_atoms(text), start, step, push)


def words(text: Column) -> Column:
    """Lower-cased words in reading order; the array index is the word position."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def is_term(word: Column) -> Column:
    return (word != "") & ~word.isin(*STOP_WORDS)


def stem(word: Column) -> Column:
    """Light suffix stripping; the same expression serves documents and queries."""
    ends = word.endswith("s") | word.endswith("ed") | word.endswith("ing")  # spares most words the regular expression
    return F.when((F.length(word) > 4) & ends, F.regexp_replace(word, r"(ing|ed|es|s)$", "")).otherwise(word)
