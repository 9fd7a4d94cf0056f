from datetime import date

import pytest
from pyspark.sql import functions as F

from verdictflow.functions import labels, messages, scores, text
from verdictflow.schemas import FLAIR_SPELLINGS, REMARKS


def column(spark, values, expression, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_every_flair_spelling_in_three_cases(spark):
    for code, spellings in FLAIR_SPELLINGS.items():
        values = [form for s in spellings for form in (s, s.lower(), s.title())]
        assert column(spark, values, labels.code_outcome) == [code] * len(values)


def test_flairs_that_are_no_verdict(spark):
    assert column(spark, [" NTA", "META", "", None, "NTA "], labels.code_outcome) == [None] * 5


def test_decided_is_not_null_and_not_empty(spark):
    flairs = [None, "", " ", "nta", "META"]
    got = column(spark, flairs, lambda c: F.coalesce(labels.is_decided(c), F.lit(False)))
    assert got == [False, False, True, True, True]


def test_binary_label_is_exact(spark):
    assert column(spark, ["YTA", "yta", "NTA", "", None], labels.binary_label) == [1, 0, 0, 0, 0]


def test_threshold(spark):
    values = [0.5, 0.5000001, float("nan"), None, -1.0, 0.6]
    assert column(spark, values, scores.over_threshold, "double") == [0, 1, 0, 0, 0, 1]
    higher = column(spark, [0.6], lambda c: scores.over_threshold(c, 0.7), "double")
    assert higher == [0]


def test_accuracy_flag_and_grade(spark):
    rows = [(1, None), (1, 2.0), (1, 1.0), (1, 0.0), (0, 0.0)]
    df = spark.createDataFrame(rows, "pred int, outcome double")
    pred, outcome = F.col("pred"), F.col("outcome")
    got = df.select(scores.accuracy_flag(pred, outcome), scores.grade(pred, outcome)).collect()
    assert [r[0] for r in got] == [0, 0, 1, 0, 1]
    assert [r[1] for r in got[1:]] == ["mistrial", "correct", "incorrect", "correct"]


def plain_truncate(content, length=100, suffix="..."):
    """The expected text, character by character."""
    content = content.strip()
    if len(content) <= length:
        return content
    head = content[:length]
    cut = head.rfind(" ")
    return (head if cut < 0 else head[:cut]) + suffix


@pytest.mark.parametrize(
    "title",
    [
        "",
        "short",
        "a" * 100,
        "a" * 101,
        "ab " * 40,
        "a" * 99 + " b",
        "a" * 100 + " b",
        " " + "a" * 50 + " " + "b" * 60,
        "\t x y \n",
        " no-break ",
        "\x1cseparator\x1f",
        "\x85next line\x85",
        "😀" * 101,
        "word\nbreak " * 12,
        " " * 200,
    ],
)
def test_truncation(spark, title):
    assert column(spark, [title], text.truncate_words) == [plain_truncate(title)]


def test_utc_date_does_not_depend_on_the_session_zone(spark, setting):
    setting("spark.sql.session.timeZone", "Asia/Tokyo")
    values = [0.0, 86399.9, 86400.0, -1.0, None]
    assert column(spark, values, text.utc_date, "double") == [
        date(1970, 1, 1),
        date(1970, 1, 1),
        date(1970, 1, 2),
        date(1969, 12, 31),
        None,
    ]


def test_combine_text_modes(spark):
    df = spark.createDataFrame([("a", "b"), ("a", None), (None, "b")], "t string, s string")
    t, s = F.col("t"), F.col("s")

    def got(**options):
        return [r[0] for r in df.select(text.combine_text(t, s, **options)).collect()]

    assert got() == ["a b", "a ", " b"]
    assert got(sep="", null_text=None) == ["ab", None, None]
    assert got(null_text="None") == ["a b", "a None", "None b"]


def test_words_are_letter_runs_of_the_whole_text(spark):
    assert column(spark, ["Don't—stop, ÉTÉ 42x"], text.words) == [["don", "t", "stop", "été", "x"]]
    assert column(spark, [""], text.words) == [[]]
    long = "word " * 10_000
    assert len(column(spark, [long], text.words)[0]) == 10_000
    assert len(column(spark, [long], lambda c: text.words(c, 4096))[0]) == 4096


def test_remarks_are_repeatable_and_belong_to_the_verdict(spark):
    keys = [f"k{i}" for i in range(200)]
    for verdict, texts in REMARKS.items():
        first = column(spark, keys, lambda c: messages.pick_remark(F.lit(verdict), c, 1))
        again = column(spark, keys, lambda c: messages.pick_remark(F.lit(verdict), c, 1))
        assert first == again and set(first) == set(texts)


def test_ruling_message(spark):
    df = spark.createDataFrame([("A title", 1, "u"), (None, 0, "u")], "t string, p int, u string")
    remarks = {"yta": ["Y."], "nta": ["N."]}
    message = messages.ruling_message(F.col("t"), F.col("p"), F.col("u"), 0, remarks=remarks)
    assert [r[0] for r in df.select(message).collect()] == [
        'Y. Forecast for "A title": YTA (u)',
        'N. Forecast for "": NTA (u)',
    ]


def test_update_message(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "yta"), (1, 0.0, "nta"), (0, 3.0, "NEI")], "p int, o double, s string"
    )
    remarks = {name: [name] for name in REMARKS}
    message = messages.update_message(
        F.lit("T"), F.col("p"), F.col("o"), F.col("s"), F.lit("u"), F.lit(9), 0, remarks=remarks
    )
    link = "https://example.org/message/9"
    assert [r[0] for r in df.select(message).collect()] == [
        f'"T" closed as YTA; forecast was YTA. Forecast met. correct {link}',
        f'"T" closed as NTA; forecast was YTA. Forecast missed. incorrect {link}',
        '"T" closed as Not enough info; forecast was NTA. '
        f"No forecasts are made for NEI: not counted. mistrial {link}",
    ]
