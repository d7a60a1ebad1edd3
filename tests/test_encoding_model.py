import collections
import pickle
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueloom.functions import bytepairs, encoding, sequences


def held_out(piece):
    return len(piece.strip()) > 2 and zlib.crc32(piece.strip().encode()) % 5 == 0


@pytest.fixture(scope="module")
def split():
    """A model of four fifths of the words, and the others by group."""
    pieces = list(bytepairs.pieces())
    rest = collections.defaultdict(list)
    for piece, weight in pieces:
        if held_out(piece):
            for group in bytepairs.groups_of(piece):
                rest[group].append((piece, weight))
    plain = [(p, w) for p, w in pieces if p.isascii() and p.strip().isalpha() and p[0] == " "][:800]
    return bytepairs.Model(bytepairs.learn(p for p in pieces if not held_out(p[0]))), rest, plain


def text_of(rng, own, plain, group, size):
    out, spaced = "", group not in ("japanese", "simplified", "traditional")
    while len(out) < size:
        pool = plain if group in bytepairs.LATIN and rng.random() < 0.6 else own
        word = rng.choices([p for p, _ in pool], [w for _, w in pool])[0]
        out += word if not spaced or word[0] == " " else rng.choice(["", " "]) + word
        out += rng.choice([". ", ",", "! "]) if rng.random() < 0.05 else ""
    return out[:size]


#: Least share of right names by length. Ten letters leave a doubt in Latin scripts.
@pytest.mark.parametrize("size,share,latin", [(10, 0.9, 0.75), (50, 0.95, 0.93), (200, 0.98, 0.98), (5000, 1.0, 1.0)])
def test_held_out_words(split, size, share, latin):
    model, rest, plain = split
    rng, seen = random.Random(size), 0
    for group, encodings in bytepairs.ENCODINGS.items():
        if len(rest[group]) < 3:
            continue  # Baltic words are not in the vocabulary; fixed samples test them
        for name in encodings:
            right = wrong = n = 0
            while n < (40 if size < 1000 else 6):
                text = text_of(rng, rest[group], plain, group, size)
                data = "".join(c for c in text if encoding_of(c, name)).encode(name)
                if data.isascii():
                    continue
                n += 1
                found, used, reliable, second = encoding.detect_bytes(data, None, model)
                same = found != "binary" and data.decode(found, "replace") == data.decode(name)
                right += same
                wrong += reliable and not same
                assert used == len(data) and second != found
            assert right / n >= (latin if group in bytepairs.LATIN else share), (name, size, right / n)
            assert wrong <= n * 0.03, (name, size)
            seen += 1
    assert seen >= 19


def encoding_of(c, name):
    try:
        return c.encode(name)
    except UnicodeEncodeError:
        return b""


@pytest.mark.parametrize(
    "text,codec",
    [("Ça va? L’été", "cp1252"), ("© 2020 Müller", "cp1252"), ("日本語", "utf-16-le"), ("Straße", "gb18030"), ("5 °C", "cp1252"), ("£100", "cp1252"), ("Größe 10 €", "cp1252"), ("안녕하세요", "euc_kr"), ("as=é", "cp1252"), ("it’s", "cp1252"), ("привет", "koi8_r"), ("ПРИВЕТ", "koi8_r"), ("こんにちは", "euc_jp"), ("中國", "big5")],
)
def test_short_texts(text, codec):
    assert encoding.detect_bytes(text.encode(codec))[0] == codec


def test_what_is_doubtful_is_not_reliable():
    assert encoding.detect_bytes("Â£".encode()) == ("utf-8-utf-8", 4, False, "utf-8")
    assert encoding.detect_bytes(b"caf\xe9 \xff\xfe\x80")[2] is False
    long = ("déjà vu — ünï " * 30).encode()
    assert encoding.detect_bytes(long + b"\xff") == ("utf-8", len(long) + 1, False, None)
    assert encoding.detect_bytes(b"\xe9" + long)[:3:2] == ("utf-8", False)
    for cut in (b"as=\xc3\xa9 \xc3\xa8 \xc3", "日本語の".encode()[:-1], "x😀😀".encode()[:-2]):
        assert encoding.detect_bytes(cut)[0] == "utf-8"
    assert encoding.detect_bytes("日本語の文章".encode()[:-1])[2] is True


def test_utf8_sequences_against_the_decoder():
    rng = random.Random(4)
    for _ in range(400):
        raw = b"".join(rng.choice([b"a", "é".encode(), "€".encode(), "😀".encode(), bytes([rng.randrange(128, 256)]), b"\xe0\x80", b"\xed\xa0\x80"]) for _ in range(rng.randrange(1, 9)))
        data = np.frombuffer(raw, np.uint8)
        good, stray, _ = sequences.utf8(data, int((data > 127).sum()))
        kept = raw.decode("utf-8", "ignore")
        assert good == sum(c > "\x7f" for c in kept) and stray == sum(b > 127 for b in raw) - sum(len(c.encode()) for c in kept if c > "\x7f")


def test_sequences_of_seven_bits():
    text = "これは日本語です。\nそして"
    assert sequences.iso2022_jp(text.encode("iso2022_jp")) == (2, 0)
    assert sequences.iso2022_jp(b"\x1b$B$3$\x1b(B \x1b$B$3\x1b(B") == (1, 1)
    assert sequences.iso2022_kr("한국어 문장".encode("iso2022_kr"))[1] == 0 and sequences.iso2022_kr(b"\x0eab\x0f") == (0, 1)
    assert sequences.hz("汉字 abc 中国".encode("hz"))[1] == 0 and sequences.hz(b"~{VP~} ~{V~}") == (1, 1)
    assert sequences.utf7("naïve £5 日本".encode("utf-7"))[1] == 0 and sequences.utf7(b"1+1=2 a+b- C++")[0] == 0
    for name in ("iso2022_jp", "iso2022_kr", "hz", "utf-7"):
        words = {"iso2022_jp": text, "iso2022_kr": "한국어 문장", "hz": "汉字 中国", "utf-7": "naïve £5 日本"}[name]
        assert encoding.detect_bytes(words.encode(name))[:3] == (name, len(words.encode(name)), True)
    assert encoding.detect_bytes(b"a+b- c ~{ d \x1b[0m")[0] == "ascii"
    assert sequences.euc_jp("日本語ｱ".encode("euc_jp"), 8) == (4, 0)


def test_binary_content():
    rng = np.random.default_rng(1)
    assert encoding.detect_bytes(rng.integers(0, 256, 5000, np.uint8).tobytes())[0] == "binary"
    assert encoding.detect_bytes(bytes(b for b in rng.integers(1, 256, 5000, np.uint8).tolist()))[0] == "binary"
    assert sequences.binary_density(np.bincount(np.frombuffer(b"ab\x01\x02", np.uint8), minlength=256)) == 0.5


def test_hints_decide_doubt_and_no_more():
    assert encoding.detect_bytes("£100".encode("cp1252"), encoding.hinted("iso-8859-9"))[0] == "iso8859_9"
    assert encoding.detect_bytes("5 °C".encode("cp1252"), encoding.hinted(None, "tr"))[0] == "iso8859_9"
    assert encoding.detect_bytes("£100".encode("cp1252"), encoding.hinted(None, None, "example.co.uk"))[0] == "cp1252"
    long = "Съешь ещё этих мягких французских булок".encode("cp1251")
    for hints in (encoding.hinted("shift_jis"), encoding.hinted("utf-8", "ja", "x.jp"), encoding.hinted(guess="koi8-r", corpus="big5")):
        assert encoding.detect_bytes(long, hints)[0] == "cp1251"
    page = b"<meta " + b"x" * 5000 + b' charset="windows-1251"><p>\xc4\xe0'
    assert encoding.declared_charset(page) == "windows-1251" and encoding.detect_bytes(page)[0] == "cp1251"


def test_the_rest_of_a_text_is_validated():
    # the leader of the first windows cannot decode the end
    late = ("très élégant " * 3000).encode("cp1252") + b"\x81\x8d"
    name = encoding.detect_bytes(late)[0]
    assert name != "cp1252" and late.decode(name)


def test_a_model_of_texts(spark, sf_dir):
    rows = [("fr", "çéç èéè ûû"), ("fr", None), (None, "ñ"), ("ru", "да да"), ("en", "plain"), ("fr", "é" * 10)]
    counts = bytepairs.count_pairs(spark.createDataFrame(rows, "lang string, text string"))
    assert counts["fr"]["é", "é"] == 9.0 and counts["fr"]["ç", "é"] == 1.0 and set(counts) == {"fr", "ru"} and ("l", "a") not in counts["fr"]
    assert len(bytepairs.count_pairs(spark.createDataFrame(rows, "lang string, text string"), most=2)["fr"]) == 2
    model = bytepairs.Model(bytepairs.default_model().groups, counts)
    assert model.group_of(counts["fr"]) == "western" and model.group_of(counts["ru"]) == "cyrillic"
    again = pickle.loads(pickle.dumps(model))
    assert (again.tables[0] == model.tables[0]).all() and len(pickle.dumps(model)) < 3_000_000
    nothing = bytepairs.Model(bytepairs.learn(bytepairs.pieces("/no/such/file")))
    # alphabets alone leave some doubt
    assert encoding.detect_bytes("привет всем".encode("cp1251"), None, nothing)[0] in encoding.CANDIDATES


def test_bytes_a_second():
    """More than 20 MB a second on one core on long texts; half of that here, for a machine that is busy."""
    for data in (("plain text " * 100_000 + "café crème").encode("cp1252"), ("Съешь ещё этих мягких французских булок. " * 30_000).encode("koi8_r"), ("今天天气很好，我们一起去公园玩。" * 40_000).encode("gb18030")):
        encoding.detect_bytes(data)
        began = time.process_time()
        encoding.detect_bytes(data)
        assert len(data) / 1e6 / (time.process_time() - began) > 10


def test_letters_that_stand_alone_are_latin():
    # the last words of a document that repeats each of its words
    data = ("Le Le Le Le eux eux eux eux aiquement aiquement du. du. " + "Ê " * 8 + "Ê").encode("cp1252")
    assert encoding.detect_bytes(data)[0] == "cp1252" and encoding.detect_bytes(data, encoding.hinted(None, "de"))[0] == "cp1252"
    assert encoding.detect_bytes(("plain text " * 50 + "Съешь ещё").encode("cp1251"))[0] == "cp1251"


def test_runs_of_seven_bits_are_counted_in_one_pass_as_one_by_one():
    rng = random.Random(7)
    parts = [b"\x1b$B", b"\x1b(B", b"\x1b$(D", b"3$", b"3", b"\n", b" ", b"\x0e", b"\x0f", b"\x1b$)C", b"~{", b"~}", b"~", b"VP"]
    good = [re.compile(rb"(?!)")] * 3
    for _ in range(3000):
        data = b"".join(rng.choice(parts) for _ in range(rng.randrange(1, 9)))
        fast = sequences.iso2022_jp(data), sequences.iso2022_kr(data), sequences.hz(data)
        kept = sequences._JP_GOOD, sequences._KR_GOOD, sequences._HZ_GOOD
        sequences._JP_GOOD, sequences._KR_GOOD, sequences._HZ_GOOD = good
        slow = sequences.iso2022_jp(data), sequences.iso2022_kr(data), sequences.hz(data)
        sequences._JP_GOOD, sequences._KR_GOOD, sequences._HZ_GOOD = kept
        assert fast == slow, data


def test_a_letter_that_stands_alone_is_transcoded(spark):
    text = "eux eux eux eux du. du. du. du. Ê Ê Ê Ê Ê Ê Ê Ê Ê"
    frame = spark.createDataFrame([(text.encode("iso8859-1"),)], "content binary")
    assert bytes(frame.select(encoding.to_utf8(F.col("content")).alias("t")).first().t).decode() == text


#: One-byte texts of Latin letters with one odd word, alone or repeated, that were read as Hebrew, Thai, Cyrillic or with signs for the letter.
ODD_WORDS = {
    "two letters": "Pfeinung ensttzer von, die ää des auung dem in.", "two others": "Onqueque de èê de, du.", "often": "Mentonen " * 200 + "aimentonen " * 100 + "èè " * 71 + "le.",
    "a quotation mark": "È " * 23 + "tion " * 30 + "des " * 30 + "pour " * 30, "a division": "Ö " * 26 + "die " * 30 + "enerie " * 30 + "Ö " * 26 + "enerie.", "both": "Des le.iebkm Étre. È aitrement la.\nReleased under the MIT License.",
}


@pytest.mark.parametrize("kind", ODD_WORDS)
def test_odd_words_among_latin_ones_are_latin(kind):
    text = ODD_WORDS[kind]
    for hints in (None, encoding.hinted(None, "de")):
        name = encoding.detect_bytes(text.encode("cp1252"), hints)[0]
        assert text.encode("cp1252").decode(name) == text and (hints is None or name == "cp1252")


def test_other_alphabets_among_latin_words_are_still_found():
    for text, codec in (("plain text " * 3000 + "Съешь ещё", "cp1251"), ("plain text " * 3000 + "הילדים משחקים", "cp1255"), ("plain text " * 3000 + "これは日本語", "shift_jis")):
        assert encoding.detect_bytes(text.encode(codec))[0] == codec
    assert encoding.detect_bytes("« oui » 6 ÷ 2 ÷ x".encode("mac_roman"))[0] == "mac_roman"
    # what is declared counts, whatever stands around
    assert encoding.detect_bytes(("plain text " * 50 + "да").encode("cp1251"), encoding.hinted(None, "ru"))[0] == "cp1251"


def test_odd_words_are_transcoded(spark):
    rows = [(k, t.encode("iso8859-1")) for k, t in ODD_WORDS.items()]
    frame = spark.createDataFrame(rows, "kind string, content binary")
    assert {r.kind: bytes(r.t).decode() for r in frame.select("kind", encoding.to_utf8(F.col("content")).alias("t")).collect()} == ODD_WORDS


def test_counts_of_bytes_bound_sequences_of_utf8():
    rng = random.Random(5)
    for _ in range(400):
        raw = b"".join(rng.choice([b"a", "é".encode(), "€".encode(), "😀".encode(), bytes([rng.randrange(128, 256)])]) for _ in range(rng.randrange(1, 30)))
        data = np.frombuffer(raw, np.uint8)
        high = int((data > 127).sum())
        assert high - sequences.utf8(data, high)[1] <= sequences.utf8_most(np.bincount(data, minlength=256)) or not high


def test_code_pages_are_encoded_as_by_python():
    text = "".join(map(chr, [*range(0x600), *range(0xE00, 0xE80), *range(0x2000, 0x2600), 0xFFFE, 0x1F600]))
    for name in encoding.CANDIDATES:
        assert encoding._in_charset(text, name) == text.encode(name, "replace")


def test_signs_after_characters_of_several_bytes():
    text = "的了在*** 说个%%% 的我的在### 来了一&&& 了的有一*** 的在是大### 他的来&&& 的在国的们的$$$ 的在出大有一$$$ 他的在.*** 的了在是中人的了在出大"
    assert encoding.detect_bytes((text * 5).encode("gb18030"))[0] == "gb18030"
    table = bytepairs.table({("的", "在"): 9.0}, "simplified", "gb18030")
    assert table["的".encode("gb18030")[-1], ord("*")] > -12
