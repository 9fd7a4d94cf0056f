"""Verdict labels."""

from pyspark.sql import functions as F

from verdictflow.schemas import FLAIR_SPELLINGS


def code_outcome(flair):
    """Outcome code 0.0 - 4.0 of a flair, NULL when it is no verdict."""
    upper = F.upper(flair)
    coded = F.lit(None).cast("double")
    for code, spellings in FLAIR_SPELLINGS.items():
        coded = F.when(upper.isin(*spellings), F.lit(code)).otherwise(coded)
    return coded


def is_class(flair, code: float):
    """True when the flair is one of the spellings of the outcome code."""
    return F.upper(flair).isin(*FLAIR_SPELLINGS[code])


def is_two_class(flair):
    """True for the two outcomes the classifier is trained on."""
    return F.upper(flair).isin(*FLAIR_SPELLINGS[1.0], *FLAIR_SPELLINGS[0.0])


def is_decided(flair):
    """A verdict was given: neither NULL nor empty."""
    return flair.isNotNull() & (flair != "")


def binary_label(flair, positive="YTA"):
    """1 for exactly the positive spelling (case counts), 0 for all else, NULL included."""
    return F.when(flair == positive, F.lit(1)).otherwise(F.lit(0))
