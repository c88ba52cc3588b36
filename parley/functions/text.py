"""Column functions of transcript cleaning.

Rewrites, tidying, tests and tokens are built-in expressions; Python runs, in
Arrow batches, only for Unicode normalisation of non-ASCII text and for the
run-collapsing filler removal, whose replacement depends on the match.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rx
from .batches import of_text
from .lexicon_clean import VIETNAMESE, CleaningLexicon


_nfc = of_text(lambda t: unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Canonical composition.  ASCII text never goes to Python."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, text).otherwise(_nfc(F.when(~ascii_only, text)))


def rewrite(text: Column, lexicon: CleaningLexicon = VIETNAMESE) -> Column:
    """The ordered rewrites, with web addresses put aside and restored in their order."""
    address = rx.java(lexicon.address, False)
    shielded = F.regexp_replace(text, address, "\x00")
    for pattern, by in lexicon.rewrites:
        shielded = rx.replace(shielded, pattern, by)
    parts = F.split(shielded, "\x00", -1)
    found = F.regexp_extract_all(text, F.lit(address), F.lit(0))
    restored = F.array_join(F.flatten(F.zip_with(parts, found, lambda p, a: F.array(p, F.coalesce(a, F.lit(""))))), "")
    return F.when(text.rlike(address), restored).otherwise(shielded)


def filler_remover(lexicon: CleaningLexicon = VIETNAMESE):
    """Function from text to text without filler words, for Arrow batches and tests.

    A run of three or more fillers shrinks to one first (the last that may bear
    meaning, else the last), so that the fix-point after it takes few steps
    however long the run is.
    """
    flags = re.IGNORECASE
    if lexicon.fillers is None:
        return lambda text: text
    bracketed, filler = re.compile(lexicon.bracketed_filler, flags), re.compile(lexicon.fillers, flags)
    run = re.compile(rf"\b(?:{lexicon.filler_word}[\s,]+){{2,}}({lexicon.filler_word}\b)", flags)
    bears = lambda w: w in lexicon.meaningful or (w.lower() in lexicon.meaningful and w.lower() != "nha")

    def shrink(match: re.Match) -> str:
        kept = next((w for w in reversed(re.findall(r"\w+", match[0])) if bears(w)), match[1])
        return f", {kept}" if "," in match[0] else kept

    def remove(text: str | None) -> str | None:
        if text is None:
            return None
        text, before = run.sub(shrink, bracketed.sub("", text)), None
        while text != before:
            before, text = text, filler.sub("", text)
        return text

    return remove


def drop_fillers(text: Column, lexicon: CleaningLexicon = VIETNAMESE) -> Column:
    """Text without fillers; rows without any filler word never go to Python."""
    if lexicon.fillers is None:
        return text
    removed = of_text(filler_remover(lexicon))
    may = rx.search(text, rf"(?<!\w){lexicon.filler_word}(?!\w)|{lexicon.fillers}")
    return F.when(may, removed(F.when(may, text))).otherwise(text)


def tidy(text: Column, lexicon: CleaningLexicon = VIETNAMESE) -> Column:
    """White space and punctuation put in order."""
    for pattern, by in lexicon.tidy:
        text = rx.replace(text, pattern, by)
    return rx.replace(text, r"^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    """No word character at all."""
    return ~rx.search(text, r"\w")


def join_compounds(text: Column, lexicon: CleaningLexicon = VIETNAMESE) -> Column:
    """Set phrases become one token, joined by underscores."""
    for phrase in lexicon.compounds:
        words = phrase.split()
        pattern = r"(?<!\S)" + r"[\s_]+".join(f"({re.escape(w)})" for w in words) + r"(?!\S)"
        text = rx.replace(text, pattern, "_".join(f"\\{i + 1}" for i in range(len(words))))
    return text


def is_small_talk(text: Column, lexicon: CleaningLexicon = VIETNAMESE) -> Column:
    """Short, timeless, and made of greetings and closers only, with at least one greeting."""
    words = F.filter(F.split(text, rx.java(r"\s+")), lambda w: w != "")
    clauses = F.filter(F.transform(F.split(text, "[,.?!;]"), lambda c: rx.replace(c, r"^\s+|\s+$", "")), lambda c: c != "")
    greeting = "|".join(f"(?:{p})" for p in lexicon.greetings)
    greets = lambda c: ~rx.search(c, lexicon.assigns) & rx.search(c, greeting)
    closes = lambda c: rx.search(c, lexicon.closers)
    return (
        (F.size(words) < lexicon.small_talk_words)
        & ~rx.search(text, lexicon.times)
        & F.exists(clauses, greets)
        & F.forall(clauses, lambda c: greets(c) | closes(c))
    )


def clean(text: Column, lexicon: CleaningLexicon = VIETNAMESE) -> Column:
    """All cleaning steps, composition first."""
    return tidy(drop_fillers(rewrite(nfc(text), lexicon), lexicon), lexicon)
