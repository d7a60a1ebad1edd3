from cueloom.llm import pieces
from cueloom.llm.vocabulary import load_pieces


def test_ids_do_not_depend_on_the_memory_of_parts():
    texts = ["one two three", "two two  four", None, "", "five " * 40, "one six"]
    table = load_pieces()
    whole, little = pieces.Encoder(table), pieces.Encoder(table, 3)
    for one in (texts, texts[::-1]):
        (a, n), (b, m) = whole.encode(one), little.encode(one)
        assert a.tolist() == b.tolist() and n.tolist() == m.tolist()
    assert len(little.memory) <= len(whole.memory)
