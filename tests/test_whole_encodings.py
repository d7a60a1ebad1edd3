import pytest

from cueloom.functions import encoding


@pytest.mark.parametrize("ahead", [24_000, 300_000])
@pytest.mark.parametrize("text,codec", [("café crème", "cp1252"), ("Съешь ещё этих мягких французских булок", "cp1251"), ("これは日本語の文章です。今日はとても良い天気でした。", "shift_jis"), ("café", "utf-8")])
def test_letters_after_much_ascii(ahead, text, codec):
    data = (("plain text " * ahead)[:ahead] + text).encode(codec)
    name, used, _, _ = encoding.detect_bytes(data)
    assert name == codec and used == len(data) and data.decode(name).endswith(text)
