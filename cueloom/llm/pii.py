"""Personal data: patterns propose spans, checksums confirm, context words adjust the score.

Everything is a built-in expression over one row, so nothing is shuffled. Spans are
``start`` (code points) and ``end`` (exclusive). The base kinds (email, ip, card, phone) are
reported whenever their check passes; the added kinds (iban, ssn, secret) when their score,
raised by context words nearby, reaches ``threshold``.

Defined results: a null text counts as empty, a text without personal data has zero counts and
empty lists; very long texts are searched whole, in time in proportion to their length; spans of two kinds may overlap and are
all reported, by start, then in the order of kinds; characters 1 and 2 of a text both count as character 2, which is in
no pattern; repeated rows are judged one by one; an empty table gives an empty result; columns of the input other than the text
are passed on unless one has the name of an output column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Marks the edges of a match while a text is being split. A text's own such characters count as MARK_ALT.
MARK, MARK_ALT = "\x01", "\x02"
NEAR = 40
#: Parts of a text, matches and what is between, walked at once; even.
RUN = 512


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def total(d: Column) -> Column:
        places = F.sequence(F.lit(1), F.length(d))

        def value(i: Column) -> Column:
            v = F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int")
            twice = v * 2
            return F.when(i % 2 == 1, v).when(twice > 9, twice - 9).otherwise(twice)

        return F.aggregate(places, F.lit(0), lambda a, i: a + value(i))

    return let(digits, lambda d: (F.length(d) > 0) & (F.when(F.length(d) > 0, total(d)).otherwise(1) % 10 == 0))


def mod97(code: Column) -> Column:
    """Whether an account number passes the mod-97 check (letters count as 10 to 35)."""

    def remainder(s: Column) -> Column:
        moved = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))

        def step(acc: Column, c: Column) -> Column:
            return F.when(c.between("0", "9"), acc * 10 + c.cast("int")).otherwise(acc * 100 + F.ascii(c) - 55) % 97

        return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step)

    return let(F.regexp_replace(code, " ", ""), lambda s: (F.length(s) >= 15) & (F.length(s) <= 34) & (remainder(s) == 1))


#: Characters of account numbers by length, and the countries that have them.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV",
    22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR",
    27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
#: By the country's length, so that a word that follows is not taken in; else one run, groups of four and a shorter one, or any grouping.
_IBAN = (
    r"(?<![A-Za-z0-9])(?:(?:"
    + "|".join(rf"(?:{of})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, of in IBAN_COUNTRIES.items())
    + r")(?![A-Za-z0-9])|[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+"
    r"|(?:\x20[A-Z0-9]{4}(?![A-Za-z0-9])){2,7}+(?:\x20[A-Z0-9]{1,3}(?![A-Za-z0-9]))?+"
    r"|(?:\x20?[A-Z0-9]){11,30}+)(?![A-Za-z0-9]))"
)
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


@dataclass(frozen=True)
class Kind:
    """pattern: possessive, and starting only where a longest run starts or the match before
    ended, so that no text takes more than time in proportion to its length."""

    name: str
    pattern: str
    present: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    score: float
    context: str
    base: bool = True


KINDS = [
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda t: t.contains("@"),
        lambda x: F.lit(True),
        0.9,
        "mail|contact|write|address",
    ),
    Kind(
        "ip",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        lambda t: t.rlike(r"[0-9]\.[0-9]"),
        lambda x: x.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
        0.6,
        "ip|address|host|server|login",
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
        lambda x: let(_digits(x), lambda d: F.length(d).between(12, 19) & luhn(d)),
        0.8,
        "card|visa|credit|debit|pay",
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        lambda t: t.contains("+"),
        lambda x: F.length(_digits(x)).between(9, 15),
        0.7,
        "phone|call|tel|mobile|fax",
    ),
    Kind(
        "iban",
        _IBAN,
        lambda t: t.rlike("[A-Z]{2}[0-9]{2}"),
        mod97,
        0.8,
        "iban|account|bank|transfer",
        False,
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        lambda t: t.rlike("[0-9]-[0-9]{2}-[0-9]"),
        lambda x: ~x.rlike("^(000|666|9)|-00-|-0000$"),
        0.3,
        "ssn|social security|tax id",
        False,
    ),
    Kind(
        "secret",
        r"(?:(?<![A-Za-z0-9])|(?<=[a-z])(?=[A-Z]))(?i:token|api[_-]?key|access[_-]?key|secret[_-]?key|password|secret)\x20?[=:]\x20?\x22?[A-Za-z0-9_/+-]{16,}+",
        lambda t: t.rlike(r"(?i)(token|key|password|secret)\x20?[=:]"),
        lambda x: F.lit(True),
        0.7,
        "token|key|secret|login",
        False,
    ),
]
THRESHOLD = 0.5
_SPAN = "array<struct<start:int,kind_no:int,end:int,score:double>>"


def _spans_of(text: Column, no: int, kind: Kind) -> Column:
    """Ascending spans of a kind in a text that has none of MARK."""

    def walk(parts: Column) -> Column:
        n = F.size(parts)
        start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

        def step(acc: Column, i: Column) -> Column:
            x = F.get(parts, i)
            end = acc["at"] + F.length(x)

            def scored(_: Column) -> Column:
                near = F.concat(F.right(F.get(parts, i - 1), F.lit(NEAR)), F.lit(" "), F.left(F.get(parts, i + 1), F.lit(NEAR)))
                score = F.lit(kind.score) + F.when(F.lower(near).rlike(rf"\b(?:{kind.context})"), 0.3).otherwise(0.0)
                score = F.least(score, F.lit(1.0))
                span = F.struct(acc["at"].alias("start"), F.lit(no).alias("kind_no"), end.alias("end"), score.alias("score"))
                good = F.lit(True) if kind.base else score >= THRESHOLD
                return F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])

            found = F.when((i % 2 == 1) & kind.valid(x), let(i, scored)).otherwise(acc["out"])
            return F.struct(end.alias("at"), found.alias("out"))

        # blocks of parts have places of their own, so that a text with very many spans takes no quadratic time
        blocks = F.transform(
            F.sequence(F.lit(0), F.call_function("div", n - 1, F.lit(RUN)).cast("int")),
            lambda b: F.aggregate(F.sequence(b * RUN, F.least(n, (b + 1) * RUN) - 1), start, step),
        )

        def placed(found: Column) -> Column:
            def moved(block: Column, b: Column) -> Column:
                ahead = F.aggregate(F.slice(found, F.lit(1), b), F.lit(0), lambda a, x: a + x["at"])
                return let(ahead, lambda o: F.transform(block["out"], lambda s: F.struct((s["start"] + o).alias("start"), s["kind_no"].alias("kind_no"), (s["end"] + o).alias("end"), s["score"].alias("score"))))

            return F.flatten(F.transform(found, moved))

        return let(blocks, placed)

    parts = F.split(F.regexp_replace(text, f"({kind.pattern})", f"{MARK}$1{MARK}"), MARK)
    found = let(parts, lambda p: F.when(F.size(p) > 1, walk(p)).otherwise(F.array().cast(_SPAN)))
    return F.when(kind.present(text), found).otherwise(F.array().cast(_SPAN))


def spans(text: Column) -> Column:
    """All spans of a text by start, then kind: array<struct<start, kind_no, end, score>>."""
    safe = F.translate(F.coalesce(text, F.lit("")), MARK, MARK_ALT)
    return let(safe, lambda t: F.sort_array(F.concat(*[_spans_of(t, i, k) for i, k in enumerate(KINDS)])))


def _joined(found: Column) -> Column:
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with the counts of base kinds, base_sha256, spans and max_score."""
    base = [i for i, k in enumerate(KINDS) if k.base]
    new = [f"n_{KINDS[i].name}" for i in base] + ["base_sha256", "spans", "max_score"]
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text and c not in new]

    def count(s: Column, no: int) -> Column:
        return F.size(F.filter(s, lambda x: x["kind_no"] == no)).cast("long")

    def report(s: Column) -> Column:
        return F.struct(
            *[count(s, i).alias(f"n_{KINDS[i].name}") for i in base],
            F.sha2(_joined(F.filter(s, lambda x: x["kind_no"] <= max(base))), 256).alias("base_sha256"),
            _joined(s).alias("spans"),
            F.coalesce(F.array_max(F.transform(s, lambda x: x["score"])), F.lit(0.0)).alias("max_score"),
        )

    return docs.select(*rest, F.inline(F.array(let(spans(F.col(f"`{text}`")), report))))


def redact(text: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; null stays null.

    Of overlapping spans the first names the replacement, which covers them all. Spans are cut in blocks, so that
    one text with very many takes no quadratic time.
    """
    names = F.array(*[F.lit(f"<{k.name.upper()}>") for k in KINDS])

    def cut(pair: Column) -> Column:
        t, found = pair["t"], pair["s"]

        def block(b: Column) -> Column:
            """What stands for the text from the last end before a block of spans to the last end in it."""
            here = F.slice(found, b * RUN + 1, F.lit(RUN))
            reach = lambda s: F.coalesce(F.array_max(F.transform(s, lambda x: x["end"])), F.lit(0))
            before = reach(F.slice(found, F.lit(1), b * RUN))

            def cut_block(own: Column) -> Column:
                start = F.struct(own["from"].alias("at"), F.lit("").alias("out"))

                def step(acc: Column, x: Column) -> Column:
                    gap = F.concat(acc["out"], F.substring(own["t"], acc["at"] - own["from"] + 1, x["start"] - acc["at"]), F.get(names, x["kind_no"]))
                    return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], gap).otherwise(acc["out"]).alias("out"))

                return F.aggregate(own["s"], start, step, lambda acc: acc["out"])

            own = let(F.struct(before.alias("from"), here.alias("s")), lambda o: F.struct(o["from"].alias("from"), o["s"].alias("s"), F.substring(t, o["from"] + 1, F.greatest(reach(o["s"]) - o["from"], F.lit(0))).alias("t")))
            return let(own, cut_block)

        blocks = F.transform(F.sequence(F.lit(0), F.call_function("div", F.size(found) - 1, F.lit(RUN)).cast("int")), block)
        last = F.array_max(F.transform(found, lambda x: x["end"]))
        done = F.concat(F.array_join(blocks, ""), let(last, lambda e: F.substring(t, e + 1, F.length(t))))
        return F.when(F.size(found) == 0, t).otherwise(done)

    return F.when(text.isNotNull(), let(F.struct(text.alias("t"), spans(text).alias("s")), cut))


def _oracle() -> str:
    """DuckDB SQL of the base spans and of the added kinds' spans."""
    fixed = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    octet = "list_bool_and([try_cast(v AS HUGEINT) <= 255 FOR v IN string_split(x, '.')])"
    digits = r"regexp_replace(x, '[^0-9]', '', 'g')"
    luhn_sql = (
        f"list_sum([CASE WHEN i % 2 = 1 THEN v WHEN v * 2 > 9 THEN v * 2 - 9 ELSE v * 2 END FOR v, i IN "
        f"list_reverse([c::INT FOR c IN string_split({digits}, '')])]) % 10 = 0"
    )
    valid = {
        "email": "true",
        "ip": octet,
        "card": f"length({digits}) BETWEEN 12 AND 19 AND {luhn_sql}",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
    }
    parts = []
    for no, (name, pattern) in enumerate(fixed.items()):
        parts.append(
            f"SELECT doc_id, '{name}' AS kind, {no} AS no, s, s + length(x) AS e FROM ("
            f"SELECT doc_id, x, i, coalesce(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM ("
            f"SELECT doc_id, unnest(p) AS x, unnest(range(len(p))) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '({pattern})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM d))) "
            f"WHERE i % 2 = 1 AND {valid[name]}"
        )
    return (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS ("
        + " UNION ALL ".join(parts)
        + "), a AS (SELECT doc_id, "
        + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in fixed)
        + ", string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no) AS j FROM s GROUP BY doc_id) "
        "SELECT doc_id, "
        + ", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in fixed)
        + ", sha256(coalesce(j, '')) AS base_sha256 FROM d LEFT JOIN a USING (doc_id)"
    )


BASE_SQL = _oracle()
