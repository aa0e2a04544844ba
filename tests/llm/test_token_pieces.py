import random

import pyarrow as pa
import public_tokenizers

from loomwork.llm import tokenbin

PARTS = "a b 's 're ' don't 'll ve S 'S of the 1 ٣ é ß 漢 字 🎉 ! ... — ’ ² Ⅷ ª <|endoftext|>".split()
PARTS += [" ", " ", "  ", "\n", "\r\n", "\t", "\x85", "\xa0", " ", "　", "​", "́", "\x1c", "\x00"]


def test_odd_texts_have_the_librarys_ids(monkeypatch):
    """Cuts at white space of all kinds, contractions, marks and foreign letters, against the library over whole texts."""
    monkeypatch.setattr(tokenbin.PieceEncoder, "RECENT", 50)
    monkeypatch.setattr(tokenbin.PieceEncoder, "KNOWN", 20)
    r = random.Random(3)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 14))) for _ in range(6000)]
    texts += [None, "", "'", "'s", " 's", "''s", "a 's", "\n's", "a\n's", "'s's", "it's5", "'r", " ", "\n "]
    encode = tokenbin.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert encode.plain
    for at in range(0, len(texts), 500):
        own = texts[at : at + 500]
        ids, lengths = encode(pa.array(own, pa.string()))
        want = [e.ids for e in encode.tokenizer.encode_batch_fast([t or "" for t in own], add_special_tokens=False)]
        assert lengths.tolist() == list(map(len, want))
        assert ids.tolist() == [i for w in want for i in w]


def test_other_vocabularies_pass_the_whole_tokenizer():
    encode = tokenbin.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    encode.plain = False
    ids, lengths = encode(pa.array(["one two", None, "three"]))
    want = [e.ids for e in encode.tokenizer.encode_batch_fast(["one two", "", "three"], add_special_tokens=False)]
    assert lengths.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
