"""Table schemas, label values and message wording shared by every job."""

from pyspark.sql import types as T


def _schema(*fields):
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


POSTS = _schema(
    ("submission_id", T.StringType()),
    ("title", T.StringType()),
    ("selftext", T.StringType()),
    ("link_flair_text", T.StringType()),
    ("created_utc", T.DoubleType()),
    ("url", T.StringType()),
)

PENDING = _schema(
    ("title", T.StringType()),
    ("post_date", T.DateType()),
    ("url", T.StringType()),
    ("date_created", T.DateType()),
    ("logits", T.DoubleType()),
    ("pred", T.IntegerType()),
    ("message_id", T.LongType()),
)

RESOLVED = T.StructType(
    PENDING.fields
    + _schema(("outcome_str", T.StringType()), ("outcome", T.DoubleType())).fields
)

DAILY_LOG = _schema(
    ("submission_id", T.StringType()),
    ("title", T.StringType()),
    ("selftext", T.StringType()),
    ("outcome_str", T.StringType()),
    ("combined_text", T.StringType()),
    ("outcome", T.DoubleType()),
    ("logits", T.DoubleType()),
    ("pred", T.IntegerType()),
    ("accurate", T.IntegerType()),
    ("post_date", T.DateType()),
)

HISTORY = _schema(
    ("date", T.DateType()),
    ("outcome_type", T.StringType()),
    ("success", T.LongType()),
    ("n", T.LongType()),
    ("rate", T.DoubleType()),
    ("se", T.DoubleType()),
    ("min_post_date", T.DateType()),
    ("max_post_date", T.DateType()),
)

OUTBOX = _schema(
    ("message_id", T.LongType()),
    ("kind", T.StringType()),
    ("message", T.StringType()),
    ("day", T.DateType()),
)

MODEL = _schema(
    ("vocabulary", T.IntegerType()),
    ("bias_micro", T.LongType()),
    ("unseen_micro", T.LongType()),
    ("weights", T.ArrayType(T.LongType())),
    ("settings", T.MapType(T.StringType(), T.StringType())),
)

TRAINING_CSV = _schema(
    ("submission_id", T.StringType()),
    ("title", T.StringType()),
    ("selftext", T.StringType()),
    ("link_flair_text", T.StringType()),
)

# Upper-cased flair spellings accepted for each outcome code.
FLAIR_SPELLINGS = {
    1.0: ("ASSHOLE", "YTA", "YOU'RE THE ASSHOLE"),
    0.0: ("NOT THE A-HOLE", "NOT THE ASSHOLE", "NTA"),
    2.0: (
        "EVERYONE SUCKS",
        "ESH",
        "EVERBODY SUCKS",
        "EVERYONE SUCKS HERE",
        "EVERYBODY SUCKS HERE",
    ),
    3.0: ("NOT ENOUGH INFO", "NEI", "NOT ENOUGH INFO HERE"),
    4.0: ("NO A-HOLES HERE", "NAH", "NO A-HOLES"),
}

# How each outcome code is spelled in messages.
OUTCOME_NAMES = {
    0: "NTA",
    1: "YTA",
    2: "Everybody sucks",
    3: "Not enough info",
    4: "NAH",
}

# Message templates; pass another dict with the same keys to change them. The fields in
# braces are filled in from the row.
TEMPLATES = {
    "ruling": "{remark} Forecast for {title}: {label} ({url})",
    "update": "{title} closed as {verdict}; forecast was {label}. {result} {remark} {link}",
    "correct": "Forecast met.",
    "incorrect": "Forecast missed.",
    "mistrial": "No forecasts are made for {flair}: not counted.",
    "link": "https://example.org/message/{id}",
}

# Remarks added to messages, one list per verdict.
REMARKS = {
    "yta": [
        "The evidence was not on your side.",
        "An apology would be a good start.",
        "Perhaps sleep on it next time.",
    ],
    "nta": [
        "You may leave the room with your head up.",
        "Nothing to be sorry for.",
        "The case is dismissed.",
        "Carry on as you were.",
    ],
    "correct": [
        "One more for the record.",
        "The training was worth it.",
        "As expected.",
    ],
    "incorrect": [
        "Noted for the next training run.",
        "Even judges err.",
    ],
    "mistrial": [
        "Both sides go home without a ruling.",
        "The docket moves on.",
    ],
}
