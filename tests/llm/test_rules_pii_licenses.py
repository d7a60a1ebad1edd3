import hashlib
import re

from pyspark.sql import functions as F

from cueloom.llm import licenses, pii, quality, queries
from tests.comparing import same_rows


def test_quality_equals_sql(spark, sf_dir):
    same_rows(queries.op8_quality(spark, sf_dir), quality.ORACLE_SQL, sf_dir)


def measured(text):
    words = (text or "").encode().split()
    words = [w.decode() for w in words]
    at, seen = {}, set()
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    for starts in at.values():
        if len(starts) > 1:
            for i in starts:
                seen.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(map(len, words)), len(re.findall(quality.SYMBOLS, text or "")), len(lines) - len(set(lines)), len(seen)


def test_quality_of_odd_rows(spark):
    texts = [None, "", " \n\t", "a b c d e f g h " * 3, "x " * 30_000, " ", "one\none\n\n one\none", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 x", " ".join(map(str, range(30_000)))]
    frame = spark.createDataFrame([(1, t, "mine") for t in texts], "doc_id long, text string, n_words string")
    got = quality.apply_policy(quality.ledger(frame)).collect()
    for t, r in zip(texts, got, strict=True):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measured(t)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    assert quality.keep_good(frame).count() == sum(r.kept for r in got)
    assert quality.ledger(frame.limit(0)).count() == 0


def test_ablation_counts_from_bits(spark, sf_dir):
    book = quality.ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    bits = [r.fail_bits for r in book.select("fail_bits").collect()]
    for r in quality.ablation(book).collect():
        b = quality.BIT[r.rule]
        assert (r.n_failed, r.n_only) == (sum(1 for x in bits if x & b), sum(1 for x in bits if x == b))


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for no, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), no, kind, m.end()))
    return sorted(out)


PII = [
    None, "", "a@b.com_x@d.org é@x.y", "x.y@z.co.uk.", "1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.255 1.1.1.256", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (743) 555-3824 +44 20 7946 0958 4465758382889437", "+1((((((((", "\x01 4111111111111111 \x01a@b.c",
    "😀 mail: joe@x.org", "a" * 3000, "1" * 3000, "a." * 1000 + "@" + "b." * 1000 + "c", "1.1." * 1000, "+12345678901 " * 500, "IBAN GB82 WEST 1234 5698 7654 32 and DE89370400440532013000", "my ssn is 123-45-6789", "123-45-6789", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "1 2 3", "0.0.0.0 00000000000000 0000 0000 0000",
]


def test_pii_against_regular_expressions(spark):
    frame = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(PII)], "doc_id long, text string, spans string")
    for r, t in zip(pii.find(frame).collect(), PII, strict=True):
        want = base_spans(t)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in want).encode()).hexdigest(), (t or "")[:80]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, _, n, _ in want) for k in BASE]
    kinds = {r.doc_id: {s.split(":")[0] for s in r.spans.split(",")} for r in pii.find(frame).collect()}
    assert "iban" in kinds[15] and "ssn" in kinds[16] and "ssn" not in kinds[17] and "secret" in kinds[18]
    assert pii.find(frame.limit(0)).count() == 0


def test_pii_of_very_long_texts(spark):
    texts = ["a" * 1_000_000, "1" * 1_000_000, "a." * 300_000 + "@" + "b." * 300_000 + "c", "1.1." * 20_000]
    got = pii.find(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert [(r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got] == [(0, 0, 0, 0), (0, 0, 0, 0), (1, 0, 0, 0), (0, 10_000, 0, 0)]


def test_pii_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    same_rows(queries.op4_pii(spark, folder).drop("spans", "max_score"), pii.BASE_SQL, folder)


def test_redaction(spark):
    frame = spark.createDataFrame([(t,) for t in PII], "text string")
    out = [r.t for r in frame.select(pii.redact(F.col("text")).alias("t")).collect()]
    for t, clean in zip(PII, out, strict=True):
        if t is None:
            assert clean is None
            continue
        for a, _, _, b in base_spans(t):
            assert t[a:b] not in clean or len(t[a:b]) < 12 or t.count(t[a:b]) > 1
        if not base_spans(t) and len(t) > 1000:
            assert clean == t
    assert out[9] == "😀 mail: <EMAIL>" and out[4].startswith("<IP>.<IP> 999")


def test_licenses_equal_sql(spark):
    folder = "/root/testdata/sf0.01"
    same_rows(queries.op2_licenses(spark, folder), queries.ORACLES["op2_licenses"], folder)


def test_licence_inheritance_and_odd_rows(spark):
    mit, gpl = licenses.TEMPLATES[1][1], licenses.TEMPLATES[5][1]
    rows = [
        ("a/LICENSE", mit), ("a/b/COPYING", gpl), ("a/b/c/x.py", "code"), ("a/d/y.py", "code"), ("z/q.py", "code"), ("a/own.py", "# Licensed under the Apache License, Version 2.0.\ncode"),
        (None, "code"), ("top.py", None), ("a/b/c/x.py", "code"), ("e/long.txt", "word " * 50_000), ("ab/x.py", "code"), ("a/LICENSE.txt", ""),
    ]
    frame = spark.createDataFrame([(p, t, "n", "f") for p, t in rows], "path string, text string, near string, score string")
    got = licenses.scan(frame).collect()
    assert len(got) == len(rows)
    by = {r.path: (r.license, r.inherited, r.license_from) for r in got}
    assert by["a/b/c/x.py"] == ("GPL-3.0", True, "a/b") and by["a/d/y.py"] == ("MIT", True, "a") and by["z/q.py"] == (None, False, None)
    assert by["a/own.py"] == ("Apache-2.0", False, None) and by["a/LICENSE"][0] == "MIT" and by[None] == (None, False, None) and by["ab/x.py"] == (None, False, None)
    assert all(r.near == "n" for r in got) and licenses.scan(frame.limit(0)).count() == 0
