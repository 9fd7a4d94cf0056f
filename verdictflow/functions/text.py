"""Text expressions: dates, composition, truncation and tokens."""

from pyspark.sql import functions as F

# Words are hashed into a vocabulary of so many ids unless another size is given, so a model
# over them has a fixed size whatever the amount of text.
VOCABULARY = 1 << 20

_BLANK = r"[\s\x1c-\x1f\x85\p{Z}]+"


def utc_date(epoch_seconds):
    """UTC calendar date of an epoch time, whatever the session time zone."""
    return F.date_from_unix_date(F.floor(epoch_seconds / 86400).cast("int"))


def combine_text(title, body, sep=" ", null_text=""):
    """Title and body as one text; `null_text=None` makes a missing part yield NULL."""
    if null_text is not None:
        title, body = (F.coalesce(part, F.lit(null_text)) for part in (title, body))
    return F.concat(title, F.lit(sep), body)


def strip(value):
    """Remove blanks of every kind from both ends."""
    return F.regexp_replace(value, rf"^{_BLANK}|{_BLANK}\z", "")


def truncate_words(value, length=100, suffix="..."):
    """Stripped text; past `length` characters it is cut at the last space before and suffixed."""
    text = strip(value)
    head = F.regexp_replace(F.substring(text, 1, length), r" [^ ]*\z", "")
    return F.when(F.length(text) <= length, text).otherwise(F.concat(head, F.lit(suffix)))


def words(value, max_words=None):
    """Lower-case letter runs of the whole text, or of its first `max_words` words."""
    found = F.filter(F.split(F.lower(value), r"[^\p{L}]+"), lambda word: word != "")
    return found if max_words is None else F.slice(found, 1, max_words)


def word_id(word, vocabulary=VOCABULARY):
    """Id of a word in a hashed vocabulary: the CRC-32 of its UTF-8 bytes modulo the size."""
    return (F.crc32(word.cast("binary")) % vocabulary).cast("int")
