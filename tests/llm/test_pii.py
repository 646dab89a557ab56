"""Personal data of every shape that the operator names, and texts that it leaves alone."""

from __future__ import annotations

import datetime
import re
import time

import pytest

from brindle.llm import pii


def pseudonyms(spark, texts, key="k"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in pii.pseudonymize(df, key=key).collect()}


SHAPES = [
    ("0a9f" * 40, r"[0-9a-f]{160}", "secret = {}"),
    ("24BE64439E3E49CF46B2D7C90F3602A3D0B907FF", r"[0-9A-F]{40}", "TOKEN = \"{}\""),
    ("hunter2secret", r"[a-z]{6}\d[a-z]{6}", "password={}"),
    ("sk_live_A1b2C3d4", r"[a-z]{2}_[a-z]{4}_[A-Z]\d[a-z]\d[A-Z]\d[a-z]\d", "api_key: '{}'"),
    ("123456", r"\d{6}", "\"pwd\": \"{}\""),
    ("1895-03-04", r"\d{4}-\d\d-\d\d", "born {}."),
    ("2150-01-02", r"\d{4}-\d\d-\d\d", "until {}."),
    ("31.12.1999", r"\d\d\.\d\d\.(?:19|20)\d\d", "on {}!"),
    ("555-123-4567", r"\d{3}-\d{3}-\d{4}", "call {} now"),
    ("555.123.4567", r"\d{3}\.\d{3}\.\d{4}", "({})"),
    ("5551234567", r"\d{10}", "Tel: {}"),
    ("912-70-1234", r"\d{3}-\d\d-\d{4}", "ssn {}"),
]


def test_every_shape_changes_and_stays_linked(spark):
    texts = [frame.format(value) for value, _, frame in SHAPES] + [f"again {frame.format(value)} twice" for value, _, frame in SHAPES]
    got, other = pseudonyms(spark, texts), pseudonyms(spark, texts, "another key")
    for k, (value, shape, frame) in enumerate(SHAPES):
        left, right = frame.split("{}")
        new = re.fullmatch(re.escape(left) + f"({shape})" + re.escape(right), got[k]["text"])
        assert new and new[1] != value and got[k]["n_found"] == 1, (texts[k], got[k]["text"])
        assert got[k + len(SHAPES)]["text"] == f"again {frame.format(new[1])} twice"
        assert other[k]["text"] != got[k]["text"]


def test_one_number_in_several_shapes_stays_linked(spark):
    got = pseudonyms(spark, ["555-123-4567", "+1 (555) 123-4567", "555.123.4567", "password=hunter2secret", "password=hunter2secret.", "token: \"hunter2secret\","])
    digits = {re.sub("[^0-9]", "", got[k]["text"])[-10:] for k in range(3)}
    assert len(digits) == 1 and digits != {"5551234567"}
    assert len({re.sub('^.*[=:][ "]*|[^a-z0-9]+$', '', got[k]["text"]) for k in (3, 4, 5)}) == 1


@pytest.mark.parametrize(
    "text",
    ["password: required, token: yes", "the key: patience", "key = x1", "at 5551234567 rows", "1.555.123.4567", "555-123-45678", "31.02.1984 and 0000-01-01", "666-12-1234 000-12-1234 123-00-1234", "secret = None", "11111-555-123-4567"],
)
def test_left_alone(spark, text):
    row = pseudonyms(spark, [text])[0]
    assert row["text"] == text and row["n_found"] == 0


def test_dates_are_permuted_within_their_time(spark):
    first, last = datetime.date(1, 1, 1), datetime.date(9999, 12, 31)
    assert (datetime.date(1900, 1, 1) - first).days == pii.DAYS_BEFORE and (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days == pii.DAYS_NEAR
    assert pii.NEAR[0] * pii.NEAR[1] == pii.DAYS_NEAR and pii.FAR[0] * pii.FAR[1] + pii.DAYS_NEAR == (last - first).days + 1
    days = [first, last, *(datetime.date(1900, 1, 1) + datetime.timedelta(days=k) for k in (-2, -1, 0, 1, 73_047, 73_048, 73_049))]
    days += [first + datetime.timedelta(days=k * 3001) for k in range(1200)]
    got = pseudonyms(spark, [f"d {x.isoformat()} e" for x in days])
    new = [datetime.date.fromisoformat(got[k]["text"][2:-2]) for k in range(len(days))]
    assert all(1900 <= b.year < 2100 if 1900 <= a.year < 2100 else not 1900 <= b.year < 2100 for a, b in zip(days, new, strict=True))
    assert len(set(new)) == len(set(days))


def test_short_secrets_are_permuted(spark):
    values = [f"ab{k:04d}cd" for k in range(3000)] + [f"{k:016x}" for k in range(0, 3000 * 7919, 7919)]
    got = pseudonyms(spark, [f"token={v}" for v in values])
    assert len({got[k]["text"] for k in range(len(values))}) == len(values)


def test_work_grows_with_the_length(spark):
    began = time.perf_counter()
    got = pseudonyms(spark, ["key=" + "0a9f" * 50_000, "token=token=" * 20_000, "secret=" + "xY1" * 60_000, "9" * 200_000, "a." * 100_000, "+1" * 100_000])
    assert [got[k]["n_found"] for k in range(6)] == [1, 0, 1, 0, 0, 0] and time.perf_counter() - began < 60


def test_session_key(spark):
    assert pii.session_key(spark) == pii.DEMO_KEY
    spark.conf.set(pii.KEY_SETTING, "another")
    assert pii.session_key(spark) == "another"
    spark.conf.unset(pii.KEY_SETTING)
