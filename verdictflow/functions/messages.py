"""Rendered messages."""

from string import Formatter

from pyspark.sql import functions as F

from verdictflow.functions.hashing import md5_int
from verdictflow.functions.scores import grade
from verdictflow.functions.text import truncate_words
from verdictflow.schemas import OUTCOME_NAMES, REMARKS, TEMPLATES


def outcome_name(code):
    """Display name of an outcome code."""
    name = F.lit(None).cast("string")
    for value, label in OUTCOME_NAMES.items():
        name = F.when(code == value, F.lit(label)).otherwise(name)
    return name


def pick_remark(verdict, key, seed, remarks=REMARKS):
    """One remark of the verdict's list, chosen by the hash of the row's key."""
    number = md5_int(F.concat(key, F.lit(f":{seed}")), 8)
    picked = F.lit(None).cast("string")
    for name, texts in remarks.items():
        options = F.array(*[F.lit(text) for text in texts])
        place = (number % len(texts) + 1).cast("int")
        picked = F.when(verdict == name, F.element_at(options, place)).otherwise(picked)
    return picked


def message_id(title, url, run_date):
    """Id of the message about a post in a run; a rerun gives the same one."""
    parts = [F.coalesce(part.cast("string"), F.lit("")) for part in (title, url, run_date)]
    return md5_int(F.concat_ws("|", *parts), 15)


def _quoted(title):
    return F.concat(F.lit('"'), truncate_words(F.coalesce(title, F.lit(""))), F.lit('"'))


def render(template, **fields):
    """A template with its fields as columns; NULL when one of them is NULL."""
    parts = []
    for text, field, _, _ in Formatter().parse(template):
        parts += [F.lit(text)] if text else []
        parts += [fields[field].cast("string")] if field else []
    return F.concat(*parts)


def ruling_message(title, pred, url, seed, templates=TEMPLATES, remarks=REMARKS):
    """Message that announces a prediction."""
    label = outcome_name(pred)
    return render(
        templates["ruling"],
        title=_quoted(title),
        label=label,
        remark=pick_remark(F.lower(label), url, seed, remarks),
        url=url,
    )


def update_message(
    title, pred, outcome, outcome_str, url, sent_id, seed, templates=TEMPLATES, remarks=REMARKS
):
    """Message that compares a prediction with the final verdict."""
    result = grade(pred, outcome)
    return render(
        templates["update"],
        title=_quoted(title),
        label=outcome_name(pred),
        verdict=outcome_name(outcome),
        result=F.when(result == "mistrial", render(templates["mistrial"], flair=outcome_str))
        .when(result == "correct", F.lit(templates["correct"]))
        .otherwise(F.lit(templates["incorrect"])),
        remark=pick_remark(result, url, seed, remarks),
        link=render(templates["link"], id=sent_id),
    )
