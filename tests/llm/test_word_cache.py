"""The cache of parts: ids of the library, frequent parts made once, stops after a word without the library's pipeline."""
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rebaja.llm.wordcache import Library, PartCache

KINDS = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]
TEXTS = ["", " ", "\n", "word", "Word, word. WORD!! word### word,### wört... ñandú; İstanbul. ΣΑΣ, straße?", " lead  two\n\nlines \n end ",
         "it's we'll 'tis O'Neil.", "a.b,c 12,5 12. 3rd, #tag $5 %x &amp; *b* (c) [d] -- e–f “g” <|endoftext|>.", "é é. ﬁn, ½. 中文。 🙂!  x. y\u0085. tab\t. z.\r\n.", ".\n.", "x.\n,y"]


@pytest.mark.parametrize("name, spaced", KINDS)
def test_ids_are_those_of_the_library(name, spaced):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    cache = PartCache(Library(path, spaced), spaced, limit=8)  # so small that all parts leave it now and then
    for text in TEXTS + [" ".join(TEXTS)] + TEXTS:
        assert np.frombuffer(cache(text), "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("name, spaced", KINDS)
def test_frequent_parts_outlast_rare_ones(name, spaced):
    library = Library(public_tokenizers.path(name), spaced)
    cache, made, merges = PartCache(library, spaced, limit=40), [], library.merges
    library.merges = lambda data: made.append(data) or merges(data)
    letters = "abcdefghijklmnop"
    for i in range(200):  # far more rare words than the cache holds
        rare = "".join(letters[int(d)] for d in f"{i:04d}")
        cache(f"x often q{rare}")
    assert sum("often" in data for data in made) <= 2


@pytest.mark.parametrize("name, spaced", KINDS)
def test_stops_after_words_take_the_plain_path(name, spaced):
    library = Library(public_tokenizers.path(name), spaced)
    cache, made = PartCache(library, spaced), []

    class Watched:
        def encode_batch_fast(self, parts, **options):
            made.extend(parts)
            return library_pipeline.encode_batch_fast(parts, **options)

    library_pipeline, library.tokenizer = library.tokenizer, Watched()
    cache("say word### and wört!! or ciudad,%%% end")
    assert not made
