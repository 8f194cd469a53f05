"""Column functions on texts: cleaning, tokens, word lists, labels."""

from __future__ import annotations

import string
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters a token may hold: Latin with the accents of the corpus's languages.
LETTERS = r"a-zàâäéèêëîïôöùûüÿçœæ"
#: Frequent French function words left out of topics.
STOP_WORDS = """au aux avec ce ces cette dans de des du elle en et eux il ils je la le les leur leurs lui ma mais me même mes moi mon ne nos notre nous on
ou où par pas pour qu que qui sa se ses son sont sur ta te tes toi ton tu un une vos votre vous c d j l à m n s t y été étée étées étés étant suis es est
sommes êtes était étaient ai as avons avez ont avait avaient eu plus lors alors afin sans sous entre""".split()


def clean(c: Column) -> Column:
    """H1. Lower case, punctuation deleted (not replaced), blanks to one space."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), string.punctuation, ""), r"\s+", " "))


def clean_spaced(c: Column) -> Column:
    """H2. Lower case, everything but letters and digits to a space, blanks to one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), f"[^{LETTERS}0-9]+", " "), r"\s+", " "))


def tokens(c: Column, least: int = 2) -> Column:
    """H3. Words of letters only, of at least so many; a word with a digit attached gives none."""
    words = F.split(F.lower(c), r"[^\p{L}\p{N}_\p{M}]+")
    return F.filter(words, lambda w: w.rlike(f"^[{LETTERS}]{{{least},}}$"))


def runs(c: Column, least: int = 2) -> Column:
    """H4. Runs of letters wherever they stand."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))


def valid_word(w: Column, stop: list[str] | None = None) -> Column:
    """H6. Three letters or more, not only digits, not a stop word."""
    return (F.length(w) >= 3) & ~w.rlike(r"^\d+$") & ~w.isin(*(STOP_WORDS if stop is None else stop))


def clean_words(words: Column, stop: list[str] | None = None) -> Column:
    """H5, H7. Trimmed, lower case, valid words, each once, in order."""
    return F.array_distinct(F.filter(F.transform(words, lambda w: F.lower(F.trim(w))), lambda w: valid_word(w, stop)))


def packed_words(cell: Column, stop: list[str] | None = None) -> Column:
    """H8. Words of a packed cell, separated by blanks or commas."""
    return clean_words(F.split(F.coalesce(cell, F.lit("")), r"[\s,;]+"), stop)


def packed_sentences(cell: Column, n: int | None = None) -> Column:
    """H9. The first n sentences, or all, of a cell joined by ||."""
    found = F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), r"\s*\|\|\s*"), lambda s: F.trim(s)), lambda s: s != "")
    return found if n is None else F.slice(found, 1, n)


def clamped_label(words: Column, padding: list[str], low: int, high: int) -> Column:
    """H10. A label of low to high words: padded from a list, or cut and marked with an ellipsis."""
    full = F.concat(words, F.slice(F.array(*map(F.lit, padding)), 1, F.greatest(F.lit(low) - F.size(words), F.lit(0))))
    return F.concat(F.concat_ws(" ", F.slice(full, 1, high)), F.when(F.size(full) > high, "…").otherwise(""))


def fallback_label(words: Column, n: int = 3, most: int = 60) -> Column:
    """H11. A title from the first words, of at most so many characters; a dash if there are none."""
    return F.when(F.size(words) > 0, F.left(F.concat_ws(", ", F.slice(words, 1, n)), F.lit(most))).otherwise("-")


def embedded_json(c: Column, schema: str) -> Column:
    """H12. The value of the outermost braces of a reply; null if there are none or they don't parse."""
    return F.from_json(F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit("")), schema)


def _accents() -> tuple[str, str]:
    pairs = [(ch, unicodedata.normalize("NFD", ch)[0]) for ch in map(chr, range(0xC0, 0x250)) if unicodedata.normalize("NFD", ch)[0] != ch]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def unaccented(c: Column) -> Column:
    """H15. Precomposed accented Latin letters to their base letters, combining marks deleted."""
    return F.regexp_replace(F.translate(c, *_accents()), r"\p{M}", "")


def slug(c: Column) -> Column:
    """H15. Lower-case letters and digits without accents, joined by single underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(unaccented(c)), r"[^a-z0-9]+", "_"), "^_+|_+$", "")


def shortened(c: Column, most: int = 200) -> Column:
    """H18."""
    return F.left(c, F.lit(most))


def label_or(summary: Column, fallback: Column, raw: Column, most: int = 48) -> Column:
    """H16. The summary, else the fallback label, else the raw name; cut to so many characters with an ellipsis."""
    pick = F.coalesce(F.nullif(F.trim(summary), F.lit("")), F.nullif(F.trim(fallback), F.lit("")), raw)
    return F.when(F.length(pick) > most, F.concat(F.left(pick, F.lit(most - 1)), F.lit("…"))).otherwise(pick)


def spans(text: Column, sentences: Column) -> Column:
    """H19. Each sentence's place (start, end, from 0) in the text, searched from the end of the one before; start -1 if absent."""
    zero = F.struct(F.lit(1).alias("cursor"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))

    def step(state: Column, s: Column) -> Column:
        # locate with a column cursor: search in what is left of the text
        left = F.substring(text, state["cursor"], F.lit(2**30))
        at = F.position(s, left) + state["cursor"] - 1
        hit = F.position(s, left) > 0
        span = F.struct(F.when(hit, at - 1).otherwise(-1).alias("start"), F.when(hit, at - 1 + F.length(s)).otherwise(-1).alias("end"))
        return F.struct(F.when(hit, at + F.length(s)).otherwise(state["cursor"]).alias("cursor"), F.concat(state["found"], F.array(span)).alias("found"))

    return F.aggregate(sentences, zero, step, lambda s: s["found"])
