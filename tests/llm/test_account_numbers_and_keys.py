import pytest

from cueloom.llm import pii

IBANS = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "BE68 5390 0754 7034", "AT61 1904 3002 3457 3201", "NO93 8601 1117 947", "FR14 2004 1010 0505 0001 3M02 606", "MT84 MALT 0110 0001 2345 MTLC AST0 01S", "GB29 NWBK 6016 1331 9268 19"]
AFTER = ["", ".", " The account", " Please pay", " USD now", " CALL me", " A", " X12 days", " and", "\nIt", " " + IBANS[0] + " The"]


def found(spark, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    return [r.spans for r in pii.find(frame).orderBy("doc_id").collect()], [r.text for r in frame.select("doc_id", pii.redact(frame.text).alias("text")).orderBy("doc_id").collect()]


def test_account_numbers_before_any_word(spark):
    cases = [(i, a) for i in IBANS for a in AFTER]
    spans, clean = found(spark, [f"IBAN {i}{a}" for i, a in cases])
    for (i, a), s, c in zip(cases, spans, clean, strict=True):
        assert f"iban:5:{5 + len(i)}" in s.split(",") and c == "IBAN <IBAN>" + a.replace(IBANS[0], "<IBAN>"), (i, a, s, c)


@pytest.mark.parametrize("number", ["DE89370400440532013001", "DE89 3704 0044 0532 0130 01", "DE89", "XDE89370400440532013000", "DE893704004405320130001"])
def test_no_account_numbers(spark, number):
    spans, _ = found(spark, [f"IBAN {number} The"])
    assert "iban" not in spans[0]


def test_keys_in_any_case_and_with_a_prefix(spark):
    value = "abcDEF0123456789xyz"
    names = ["token", "api_key", "apikey", "API_KEY", "X-Api-Key", "aws_secret", "AWS_SECRET_ACCESS_KEY", "clientSecret", "DB_PASSWORD", "Password"]
    spans, clean = found(spark, [f"set {n}={value} now" for n in names])
    assert all("secret" in s for s in spans) and not any(value in c for c in clean)
    assert found(spark, [f"monkey={value}", "token=short"])[0] == ["", ""]
