import random

import pyarrow as pa
import pytest

from mnemospark.llm import tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer())


@pytest.fixture
def encoder(library):
    return tokens.Encoder(library.to_str())


@pytest.mark.parametrize("text", [
    "", " ", "\n", "a", " a", "a ", "a \nb", "a\n", "\na", "don't stop.", "we'll x?! y", "日本語 テキスト。 a", "<|endoftext|> a", "a b", "é\nè", "a\tb", "...",
    "1,2 3.", "a's 'tis", "\n\n", "a\r\nb", "ﬁ ǅ ª", "when***, (so) %%%", "x\x1cy z", "naïve, Ünder. ça? 12th", "word\n, word", ". , ;", "_a -b a_b", "a\0, \0 b",
])
def test_encoder_agrees_with_the_library(library, encoder, text):
    assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_encoder_agrees_over_slices_and_trims(library, encoder, monkeypatch):
    """Words come and go: more slices than the words that are kept."""
    monkeypatch.setattr(tokens, "CACHE_WORDS", 150)
    monkeypatch.setattr(tokens, "CALL_WORDS", 40)
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdéß", k=rng.randint(1, 6))) for _ in range(400)]
    tails = ["", "", ".", ",", "!?", "'s", "***", "3", "\nand"]
    texts = [" ".join(rng.choice(words) + rng.choice(tails) for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None]
    found = [ids.tolist() for lo, part in tokens.slices(pa.array(texts), most=900) for ids in encoder.encode_many(part)]
    assert found == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
