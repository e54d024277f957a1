"""Tokens, content terms and entity names, as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no content.
STOPWORDS = (
    "a about an and are as at be been being but by can could did do does for from he how i if in into is it its may "
    "must no not of on or our she should so than that the then these they this those to was we were what when where "
    "which who will with would you your"
).split()
#: Names that are pronouns.
PRONOUNS = (
    "he her hers him his i it its me mine my myself our ours she their theirs them they us we you your yours yourself"
).split()
#: Marks of facts that do not last.
TRANSIENT = ["current date", "current time", "o'clock", "the date is", "the time is", "today's date"]

#: Letters with a stroke and the like, which have no decomposition, and what they fold to.
_STROKES = {"ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ŧ": "t", "ı": "i", "ð": "d", "ƀ": "b", "ɓ": "b", "ƈ": "c", "ɗ": "d", "ɠ": "g", "ƙ": "k", "ƞ": "n", "ɵ": "o", "ƥ": "p", "ƭ": "t", "ʈ": "t", "ʋ": "v", "ƴ": "y", "ƶ": "z"}


def _folds() -> dict[str, str]:
    """Letter -> base letter, and mark -> nothing, by canonical decomposition; letters of several bases stay as they are."""
    out = dict(_STROKES)
    for c in map(chr, (*range(0x80, 0xAC00), *range(0xF900, 0x10000))):
        base = [d for d in unicodedata.normalize("NFD", c) if not unicodedata.combining(d)]
        if not base:
            out[c] = ""
        elif len(base) == 1 and base[0] != c:
            out[c] = _STROKES.get(base[0], base[0])
    return out


#: The one table that names are folded by, in expressions and in Python.
FOLDS = _folds()
_FROM = "".join(sorted(FOLDS, key=lambda c: (FOLDS[c] == "", c)))
_TO = "".join(FOLDS[c] for c in _FROM)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, marks and digits, repeats kept."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda t: t != "")


def content_terms(text: Column) -> Column:
    """The set of tokens without stopwords."""
    return F.array_except(tokens(text), F.array(*map(F.lit, STOPWORDS)))


def shared_terms(query_terms: Column, text: Column) -> Column:
    """How many content terms two texts share."""
    return F.size(F.array_intersect(query_terms, content_terms(text)))


def folded(text: Column) -> Column:
    """Lower case without diacritics, in any script."""
    return F.translate(F.lower(text), _FROM, _TO)


def name_tokens(name: Column) -> Column:
    """The set of folded tokens of two characters or more."""
    return F.array_distinct(F.filter(tokens(folded(name)), lambda t: F.char_length(t) > 1))


def initials(name: Column) -> Column:
    """First letters of the name's tokens; empty for fewer than two."""
    own = F.filter(tokens(folded(name)), lambda t: F.char_length(t) > 1)
    return F.when(F.size(own) > 1, F.array_join(F.transform(own, lambda t: F.left(t, F.lit(1))), "")).otherwise("")


def tokens_match(a: Column, initials_a: Column, b: Column, initials_b: Column) -> Column:
    """Whether two names match, given their token sets and initials: equal, subset, or one the other's initials."""
    subset = (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)
    short = ((F.size(a) == 1) & (F.element_at(a, 1) == initials_b)) | ((F.size(b) == 1) & (F.element_at(b, 1) == initials_a))
    return (F.size(a) > 0) & (F.size(b) > 0) & (subset | F.coalesce(short, F.lit(False)))


def names_match(a: Column, b: Column) -> Column:
    """Whether two entity names match; symmetric, not transitive."""
    return tokens_match(name_tokens(a), initials(a), name_tokens(b), initials(b))


def is_junk(subject: Column, object_: Column, fact_text: Column) -> Column:
    """Facts about pronouns, or of the moment only. No trimming: "I " is no pronoun."""
    pronoun = F.lower(subject).isin(PRONOUNS) | F.coalesce(F.lower(object_).isin(PRONOUNS), F.lit(False))
    text = F.lower(fact_text)
    for mark in TRANSIENT:
        pronoun = pronoun | F.contains(text, F.lit(mark))
    return F.coalesce(pronoun, F.lit(False))


def episode_text(user_text: Column, assistant_text: Column, known_user_name: Column) -> Column:
    """What a model reads of a chat turn."""
    head = F.when(F.coalesce(known_user_name, F.lit("")) == "", "").otherwise(F.concat(F.lit("Known user name: "), known_user_name, F.lit("\n")))
    return F.concat(head, F.lit("user: "), user_text, F.lit("\nassistant: "), assistant_text)


def joined_lines(order: Column, text: Column) -> Column:
    """Aggregate: texts in order, one a line."""
    rows = F.sort_array(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), "\n")
