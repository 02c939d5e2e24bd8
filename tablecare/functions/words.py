"""Words inside cells: tokens, word forms, spelling folds, match scores."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word families; every form folds to the first word of its line.
WORD_FAMILIES = [
    ["treat", "treats", "treated", "treating", "treatment", "treatments"],
    ["prescribe", "prescribed", "prescribing", "prescription", "prescriptions"],
    ["diagnose", "diagnosed", "diagnosing", "diagnosis", "diagnoses"],
    ["medication", "medications", "medicine", "medicines", "med", "meds"],
    ["duration", "durations", "lasting", "lasted"],
    ["length", "lengths"],
    ["admit", "admits", "admitted", "admitting", "admission", "admissions"],
    ["visit", "visits", "visited", "visiting"],
    ["result", "results", "resulted"],
    ["indicate", "indicated", "indication", "indications"],
]

# Clinical short forms and the spellings they stand for.
SHORT_FORMS = {
    "e coli": ["escherichia coli"],
    "ecoli": ["escherichia coli"],
    "escherichia": ["escherichia coli"],
    "staph": ["staphylococcus", "staphylococcus aureus"],
    "staph aureus": ["staphylococcus aureus"],
    "mrsa": ["methicillin resistant staphylococcus aureus", "staphylococcus aureus"],
    "mssa": ["methicillin susceptible staphylococcus aureus", "staphylococcus aureus"],
    "strep": ["streptococcus"],
    "gbs": ["group b streptococcus", "streptococcus agalactiae"],
    "vre": ["vancomycin resistant enterococcus", "enterococcus"],
    "esbl": ["extended spectrum beta lactamase"],
    "klebs": ["klebsiella", "klebsiella pneumoniae"],
    "pseudomonas": ["pseudomonas aeruginosa"],
    "psa": ["pseudomonas aeruginosa"],
    "c diff": ["clostridioides difficile", "clostridium difficile"],
    "cdiff": ["clostridioides difficile", "clostridium difficile"],
}


def tokens(c: Column) -> Column:
    """Lower-case alphanumeric words."""
    return F.filter(F.split(F.lower(c.cast("string")), "[^a-z0-9]+"), lambda w: w != "")


# Plural endings (a pattern, the part that goes, what comes instead, the
# least length of the word); the first that fits is taken.
PLURALS = [
    ("oses$", "oses$", "osis", 0),
    ("(ches|shes|xes|sses)$", "es$", "", 0),
    ("ies$", "ies$", "y", 0),
    ("[^s]s$", "s$", "", 4),
]

# Spellings that fold together, in the order they are applied.
SPELLINGS = [("ae", "e"), ("oe", "e"), (r"ise\b", "ize"), (r"isation\b", "ization"), ("ll", "l")]


def singular(w: Column) -> Column:
    """Plural to singular by ending."""
    return F.coalesce(*[
        F.when(w.rlike(ending) & (F.length(w) >= least), F.regexp_replace(w, goes, comes)) for ending, goes, comes, least in PLURALS
    ], w)


def fold_word(w: Column) -> Column:
    """One word to the form it is compared by."""
    forms = {form: family[0] for family in WORD_FAMILIES for form in family}
    lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(forms.items())])
    return F.when(F.length(w) < 3, w).otherwise(F.coalesce(F.try_element_at(lookup, w), singular(w)))


def fold_words(words: Column) -> Column:
    return F.transform(words, fold_word)


def fold_spelling(w: Column) -> Column:
    """British and American spellings to one form."""
    for pattern, to in SPELLINGS:
        w = F.regexp_replace(w, pattern, to)
    return w


def typo_budget(length: Column) -> Column:
    """Edits allowed for a word of this length."""
    return F.when(length < 4, 0).when(length <= 6, 1).otherwise(2)


def edit_distance(a: Column, b: Column, budget: int) -> Column:
    """Edit distance, null past the budget."""
    d = F.levenshtein(a, b, budget)
    return F.when(d >= 0, d)


def _token_score(query: Column, value: Column) -> Column:
    whole = lambda w: F.array_contains(value, w)
    prefix = lambda w: F.exists(value, lambda v: (F.length(v) > F.length(w)) & v.startswith(w))
    return F.when(
        (F.size(query) > 0) & (F.size(value) > 0),
        F.when(
            F.forall(query, whole), F.when(F.size(query) == F.size(value), F.lit(3.0)).otherwise(F.lit(2.0))
        ).when(F.forall(query, lambda w: whole(w) | prefix(w)), F.lit(1.0)),
    )


def match_score(query: Column, value: Column, query_folded: Column, value_folded: Column) -> Column:
    """3 same words, 2 all words found, 1 by prefix, 0.5 only by word form, else null."""
    changed = (query != query_folded) | (value != value_folded)
    by_form = F.when(changed & (_token_score(query_folded, value_folded) >= 2), F.lit(0.5))
    return F.coalesce(_token_score(query, value), by_form)


def short_form_key(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def expand_short_form(c: Column) -> Column:
    """The long spellings of a clinical short form, or an empty array."""
    entries = chain.from_iterable(
        (F.lit(k), F.array(*[F.lit(v) for v in forms])) for k, forms in SHORT_FORMS.items()
    )
    return F.coalesce(
        F.try_element_at(F.create_map(*entries), short_form_key(c)), F.array().cast("array<string>")
    )
