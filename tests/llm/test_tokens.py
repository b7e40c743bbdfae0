import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pricelens.llm import tokens
from pricelens.llm.tokens import Encoder, tokenizer_path

PIECES = ["the", "Word,", "x.", "é,", ",", "..", "7,", "Ω.", "\nx,", "été", "x's", "don't", "12345", "!?…", "\n", "\n\n", " ", "  ", "\t", " ", "　", "é", "́", "ΟΔΟΣ", "İ", "<|endoftext|>", "<|startoftext|>", "\x01", "日本語", "\x1c", "A" * 50, "’", "ß.", "\r\n", "\x85", " ", "🙂"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("per_string", [3, 2000])
def test_same_ids_as_whole_texts(name, per_string, monkeypatch):
    monkeypatch.setattr(tokens, "PER_STRING", per_string)
    rng = random.Random(5)
    texts = [None, "", " ", "\n", "a", " a", "\na", "a\n", "a ", "a b\nc d"]
    for _ in range(1500):
        gap = rng.choice(["", " ", " ", " "])
        texts.append(gap.join(rng.choice(PIECES[: rng.choice([8, len(PIECES)])]) for _ in range(rng.randint(1, 12))))
    whole = Tokenizer.from_file(tokenizer_path(name))
    e = Encoder(tokenizer_path(name))
    for lo in range(0, len(texts), 400):
        part = texts[lo : lo + 400]
        ids, bounds = e.encode(pa.array(part, pa.string()))
        for k, t in enumerate(part):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == whole.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_kept_pieces_give_the_same_ids_and_are_not_encoded_again():
    path = tokenizer_path("byte_bpe_50k.json")
    plain, keeping = Encoder(path), Encoder(path, 20_000)
    asked = []
    joined = keeping._joined
    keeping._joined = lambda pieces, head: (asked.append(len(pieces)), joined(pieces, head))[1]
    small = [f"word{k} {'y' * (k % 5 + 1)} Thé,\nline{k}. x{k}" for k in range(40)]
    large = [f"other{k} plain{k}, {k}" for k in range(2_000)]  # more than may be kept
    for texts in (small, small, ["", None, "\n"], large, small, [*small, "word1 brandnew"]):
        column, before = pa.array(texts, pa.string()), len(asked)
        ids, bounds = keeping.encode(column)
        expected, places = plain.encode(column)
        assert ids.tolist() == expected.tolist() and bounds.tolist() == places.tolist()
        assert sum(x.nbytes for held in keeping.kept.values() for x in held) <= 20_000
        asked[before:] = [asked[before:]]
    # A call asks for pieces after a space, lines and row starts; only row starts are encoded each time.
    assert [asked[0], asked[1], asked[5]] == [[86, 40, 40], [0, 0, 40], [1, 0, 41]]
